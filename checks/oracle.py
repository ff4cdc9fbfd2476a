"""DuckDB SQL that restates the engine's queries on the driver tables.

Written from the product rules, not from the engine's code: rates are formulas
and step lists, and the roll-forward is a recursive query.
"""

from __future__ import annotations

PRODUCTS = "['UVL01', 'UVL02', 'UVL03', 'ILP01']"
RIDERS = "['ADD01', 'PPD01', 'CIR01', 'CIR02', 'SUP01', 'HOP02', 'WOP01', 'WOP02']"

PLANS = """
spans AS (
  SELECT o_custkey AS k, CAST(2 + 6 * (o_orderkey % 16) AS INT) AS y_from,
         CAST(2 + 6 * (o_orderkey % 16) + max((o_orderkey // 16) % 4) AS INT) AS y_to,
         CAST(sum(1 + o_orderkey % 20) AS DOUBLE) * 1e6 AS amount
  FROM orders GROUP BY o_custkey, o_orderkey % 16),
plan_years AS (
  SELECT k, CAST(unnest(generate_series(y_from, y_to)) AS INT) AS year, amount FROM spans)
"""

PORTFOLIO = f"""
drawn AS (
  SELECT c_custkey AS k, c_nationkey, DATE '2025-01-01' + CAST((c_custkey * 37) % 365 AS INT) AS rcd
  FROM customer),
born AS (SELECT *, CAST(rcd - CAST((k * 7919) % 21900 AS INT) AS DATE) AS dob FROM drawn),
pf AS (
  SELECT k, CAST(k AS VARCHAR) AS policy_id, {PRODUCTS}[CAST(1 + k % 4 AS INT)] AS product,
    CAST(1 + c_nationkey % 2 AS INT) AS gender, c_nationkey, CAST(rcd AS DATE) AS rcd, dob,
    CAST(k % 11 AS DOUBLE) * 0.25e0 AS em, CAST(k % 21 AS INT) AS em_term,
    CAST(k % 16 AS INT) AS pm, CAST(1 + k % 20 AS INT) AS pm_term,
    5e7 + CAST((k * 104729) % 400 AS DOUBLE) * 5e6 AS si, CAST(k % 7 AS DOUBLE) * 1e6 AS base_ep,
    CAST(7 + k % 20 AS INT) AS opted_tp_term, CAST(4 + k % 3 AS INT) AS opted_ep_term,
    k % 3 < 2 AS option_a, CASE WHEN k % 10 = 9 THEN 2 ELSE 1 END AS maturity_option,
    CAST(1 + k % 5 AS INT) AS acc_ben_coeff
  FROM born)
"""


def years_between(birth: str, on: str) -> str:
    return (
        f"CAST(year({on}) - year({birth}) - CASE WHEN month({on}) * 100 + day({on}) < "
        f"month({birth}) * 100 + day({birth}) THEN 1 ELSE 0 END AS INT)"
    )


def months_between(birth: str, on: str) -> str:
    return (
        f"CAST((year({on}) - year({birth})) * 12 + month({on}) - month({birth}) - "
        f"CASE WHEN day({on}) < day({birth}) THEN 1 ELSE 0 END AS INT)"
    )


def prem_rate(age: str) -> str:
    x = f"({age} / 66e0)"
    return f"(10.6e0 + 0.12e0 * {age} + 57.5e0 * {x} * {x} * {x})"


def coi_rate(product: str, gender: str, age: str) -> str:
    x = f"({age} / 99e0)"
    x4 = f"({x} * {x} * ({x} * {x}))"
    return (
        f"((0.7e-3 + 0.2e-4 * {age} + 0.99732e0 * ({x4} * {x4})) * "
        f"CASE WHEN {gender} = 2 THEN 0.8e0 ELSE 1e0 END * "
        f"CASE WHEN {product} IN ('UVL02', 'ILP01') THEN 0.8e0 ELSE 1e0 END)"
    )


def extra_prem_rate(age: str, term: str) -> str:
    return f"(0.5e0 + 0.02e0 * {age} + 0.5e-2 * {term})"


def tp_alloc_chrg_rate(product: str, year: str) -> str:
    return (
        f"CASE {product} WHEN 'UVL02' THEN coalesce([0.7e0, 0.45e0, 0.25e0][{year}], 0e0) "
        f"WHEN 'UVL03' THEN coalesce([0.3e0, 0.15e0, 0.1e0][{year}], 0e0) ELSE coalesce("
        "[0.55e0, 0.4e0, 0.25e0, 0.2e0, 0.1e0, 0.07e0, 0.07e0, 0.04e0, 0.04e0]"
        f"[{year}], 0.02e0) END"
    )


def ep_alloc_chrg_rate(product: str) -> str:
    return f"CASE WHEN {product} IN ('UVL02', 'UVL03') THEN 0.015e0 ELSE 0.02e0 END"


def srr_chrg_rate(product: str, year: str) -> str:
    return (
        f"CASE {product} WHEN 'UVL02' THEN coalesce([1e0, 1e0, 1e0, 0.85e0, 0.65e0, 0.45e0, "
        f"0.25e0, 0.2e0, 0.1e0][{year}], 0e0) "
        f"WHEN 'UVL03' THEN coalesce([0.45e0, 0.4e0, 0.3e0, 0.2e0, 0.1e0][{year}], 0e0) "
        "ELSE coalesce([1e0, 1e0, 1e0, 1e0, 0.8e0, 0.6e0, 0.4e0, 0.2e0, 0.1e0]"
        f"[{year}], 0e0) END"
    )


def lb_rate(product: str, year: str) -> str:
    return (
        f"CASE WHEN {year} > 20 THEN 0e0 "
        f"WHEN {product} = 'UVL02' THEN CASE WHEN {year} % 3 = 0 THEN "
        f"[0.03e0, 0.06e0, 0.09e0, 0.12e0, 0.15e0, 0.18e0][{year} // 3] ELSE 0e0 END "
        f"WHEN {product} = 'UVL03' THEN CASE WHEN {year} % 3 = 0 THEN "
        f"[0.03e0, 0.04e0, 0.05e0, 0.06e0, 0.07e0, 0.08e0][{year} // 3] ELSE 0e0 END "
        f"WHEN {year} % 4 = 0 THEN [0.06e0, 0.12e0, 0.18e0, 0.24e0, 0.3e0][{year} // 4] "
        "ELSE 0e0 END"
    )


def lien_rate(product: str, age: str) -> str:
    return (
        f"CASE WHEN {product} = 'UVL01' THEN 1e0 "
        f"ELSE coalesce([0.2e0, 0.4e0, 0.6e0, 0.8e0][{age} + 1], 1e0) END"
    )


def admin_chrg(product: str, cal_year: str) -> str:
    return (
        f"CASE WHEN {product} = 'UVL01' THEN CASE WHEN {cal_year} BETWEEN 2016 AND 2115 "
        f"THEN 25e3 ELSE 0e0 END WHEN {cal_year} BETWEEN 2024 AND 2123 THEN "
        f"least(40e3 + 2e3 * ({cal_year} - 2024), 66e3) ELSE 0e0 END"
    )


def up_to_thousand(amount: str) -> str:
    return f"ceil({amount} / 1e3) * 1e3"


MODES = ((1, "1e0"), (2, "0.5e0"), (4, "0.25e0"), (12, "0.083333333e0"))
TERMS = (
    "terms AS (SELECT *, "
    "CASE WHEN product <> 'ILP01' THEN 0e0 WHEN tp_1 >= 1e8 THEN tp_1 * 0.05e0 "
    "WHEN tp_1 >= 5e7 THEN tp_1 * 0.03e0 END AS big_case_bonus FROM (SELECT *, "
    + ", ".join(
        f"{up_to_thousand(f'({f} * (prem_rate * si / 1e3))')} AS tp_{m}, "
        f"{up_to_thousand(f'({f} * base_ep)')} AS ep_{m}" for m, f in MODES
    )
    + f""" FROM (
    SELECT *, {years_between('dob', 'rcd')} AS entry_age, year(rcd) AS rcd_year,
      CASE maturity_option WHEN 1 THEN 100 ELSE 66 END AS maturity_age,
      CASE maturity_option WHEN 1 THEN 100 ELSE 66 END - {years_between('dob', 'rcd')} AS term,
      66 - {years_between('dob', 'rcd')} AS acc_ben_term,
      {prem_rate(years_between('dob', 'rcd'))} AS prem_rate,
      CASE WHEN em_term >= 1 THEN
        {extra_prem_rate(years_between('dob', 'rcd'), 'least(em_term - 1, 99)')} END
        AS extra_prem_rate,
      CASE product WHEN 'UVL01' THEN 4 ELSE 3 END AS must_pay_period,
      CASE WHEN product = 'ILP01' THEN 0e0 ELSE 0.75e-4 END AS acc_coi_rate,
      CASE WHEN product = 'ILP01' THEN 0.05e0 ELSE 0.07e0 END AS hir,
      CASE WHEN product = 'ILP01' THEN 0.09e0 ELSE 0.05e0 END AS lir,
      CASE WHEN product = 'ILP01' THEN 0e0 ELSE 0.02e0 END AS gir
    FROM pf))),
judged AS (SELECT *, CASE WHEN big_case_bonus IS NULL THEN 'no big-case bonus tier'
  WHEN extra_prem_rate IS NULL THEN 'no extra premium rate' END AS reject_reason FROM terms),
accepted AS (SELECT * FROM judged WHERE reject_reason IS NULL)
"""
)


def due(rate: str) -> str:
    m = f"(pow(1e0 + {rate}, 1e0 / 12e0) - 1e0)"
    return (
        f"CASE WHEN {rate} = 0e0 THEN 'NaN'::DOUBLE ELSE (pow(1e0 + {m}, 12e0) - 1e0) / 12e0 / "
        f"(1e0 - pow(1e0 + {m}, -1e0)) / (1e0 + {rate}) END"
    )


PATHS = f"""
scenarios AS (
  SELECT CAST(1 + 6 * i + 3 * r + t AS INT) AS scenario_no,
    ['High', 'Low', 'Guaranteed'][1 + i] AS int_rate_scenario,
    ['Standard', 'Subrisk'][1 + r] AS risk_scenario,
    ['Policy', 'Opted', 'Must-pay'][1 + t] AS term_scenario
  FROM range(3) a(i), range(2) b(r), range(3) c(t)),
paths AS (
  SELECT *, {due('annual_int_rate')} AS due_a_n1_m12 FROM (
    SELECT a.*, s.*, risk_scenario = 'Subrisk' AS risk_flag,
      CASE int_rate_scenario WHEN 'High' THEN hir WHEN 'Low' THEN lir ELSE gir END
        AS annual_int_rate,
      CAST(CASE term_scenario WHEN 'Policy' THEN term WHEN 'Opted' THEN opted_tp_term
        ELSE must_pay_period END AS INT) AS tp_term,
      CAST(CASE term_scenario WHEN 'Policy' THEN term WHEN 'Opted' THEN opted_ep_term
        ELSE must_pay_period END AS INT) AS ep_term
    FROM accepted a CROSS JOIN scenarios s))
"""

RATES_AT_YEAR = f"""
  {tp_alloc_chrg_rate('product', 'year')} AS tp_alloc_chrg_rate,
  {ep_alloc_chrg_rate('product')} AS ep_alloc_chrg_rate,
  {srr_chrg_rate('product', 'year')} AS srr_chrg_rate,
  {lb_rate('product', 'year')} AS lb_rate,
  {coi_rate('product', 'gender', '(entry_age - 1 + year)')} AS coi_rate,
  {lien_rate('product', '(entry_age - 1 + year)')} AS juvenile_lien_rate,
  {admin_chrg('product', '(rcd_year - 1 + year)')} AS admin_chrg
"""
TIME = """
  CAST(entry_age - 1 + year AS INT) AS age, CAST(rcd_year - 1 + year AS INT) AS cal_year,
  year <= term AS pol_term_flag, year <= acc_ben_term AS acc_ben_term_flag,
  year <= em_term AS em_load_term_flag, year <= pm_term AS pm_load_term_flag
"""
GRID = f"""
grid AS (
  SELECT *, {TIME} FROM (
    SELECT *, CAST(unnest(generate_series(1, term)) AS INT) AS year FROM accepted)),
fixed AS (
  SELECT *, {RATES_AT_YEAR} FROM (
    SELECT g.*, coalesce(w.amount, 0e0) AS withdrawal_input
    FROM grid g LEFT JOIN plan_years w ON w.k = g.k AND w.year = g.year))
"""

# The roll-forward: constants carried along, then each year as nested layers.
CONSTANTS = (
    "k", "policy_id", "scenario_no", "product", "gender", "entry_age", "rcd_year", "term",
    "acc_ben_term", "em_term", "pm_term", "em", "pm", "tp_1", "ep_1", "big_case_bonus",
    "option_a", "acc_ben_coeff", "extra_prem_rate", "acc_coi_rate", "tp_term", "ep_term",
    "risk_flag", "annual_int_rate", "due_a_n1_m12", "wl",
)
RING = tuple(f"w{i}" for i in range(1, 10))
_WHEN = "CASE WHEN {} THEN {} ELSE {} END"
LAYERS = (
    RATES_AT_YEAR + ", wl[year] AS withdrawal_input, "
    "year <= acc_ben_term AS acc_on, year <= em_term AND risk_flag AS em_on, "
    "year <= pm_term AND risk_flag AS pm_on, year <= tp_term AS tp_on, "
    "start_tav + start_eav AS start_pav",
    "CASE WHEN tp_on THEN CASE WHEN year = 1 THEN tp_1 + big_case_bonus ELSE tp_1 END "
    "ELSE 0e0 END AS tp, CASE WHEN tp_on THEN ep_1 ELSE 0e0 END AS ep, "
    "CASE WHEN option_a THEN greatest(start_si, start_pav) ELSE start_si END "
    "* juvenile_lien_rate AS ben, "
    "CASE WHEN acc_on THEN start_si * acc_ben_coeff ELSE 0e0 END AS acc_ben, "
    "least(start_eav, withdrawal_input) AS ask_eav",
    "tp * srr_chrg_rate AS srr_chrg, tp * tp_alloc_chrg_rate AS tp_alloc_chrg, "
    "ep * ep_alloc_chrg_rate AS ep_alloc_chrg, withdrawal_input - ask_eav AS ask_tav, "
    "CASE WHEN em_on THEN extra_prem_rate * em * ben / 1e3 / (1e0 - ep_alloc_chrg_rate) "
    "ELSE 0e0 END AS unrounded_em_load, "
    "CASE WHEN pm_on THEN pm * ben / 1e3 / (1e0 - ep_alloc_chrg_rate) "
    "ELSE 0e0 END AS unrounded_pm_load, "
    "CASE WHEN option_a THEN greatest(ben - start_pav, 0e0) ELSE ben END AS sar, "
    "CASE WHEN option_a THEN start_si ELSE greatest(start_pav, start_si) - withdrawal_input END "
    "AS ask_si",
    "greatest(start_tav - srr_chrg, 0e0) + start_eav AS srr_val, tp - tp_alloc_chrg AS tp_alloc, "
    "ep - ep_alloc_chrg AS ep_alloc, "
    "CASE WHEN withdrawal_input = 0e0 THEN 'No withdrawal.' "
    "WHEN withdrawal_input > start_pav THEN 'Withdrawal amount exceeds policy account value.' "
    "WHEN (start_eav - ask_eav) + (start_tav - ask_tav) < tp_1 "
    "THEN 'After withdrawal, end PAV is below acceptable limit.' "
    "WHEN ask_si < 1e8 THEN 'After withdrawal, end SI is below acceptable limit.' "
    "ELSE 'Successfully withdraw.' END AS withdrawal_log, "
    "ceil(unrounded_em_load / 1e3) * 1e3 AS em_load, "
    "ceil(unrounded_pm_load / 1e3) * 1e3 AS pm_load, sar * coi_rate AS standard_coi, "
    "CASE WHEN risk_flag THEN pm * sar / 1e3 ELSE 0e0 END AS pm_load_coi, "
    "CASE WHEN acc_on THEN acc_ben * acc_coi_rate * 12e0 ELSE 0e0 END AS acc_coi",
    "withdrawal_log = 'Successfully withdraw.' AS paid, em_load + pm_load AS load, "
    "CASE WHEN risk_flag THEN em * standard_coi ELSE 0e0 END AS em_load_coi",
    "CASE WHEN paid THEN withdrawal_input ELSE 0e0 END AS withdrawal, "
    "CASE WHEN paid THEN ask_eav ELSE 0e0 END AS eav_withdrawal, "
    "CASE WHEN paid THEN ask_tav ELSE 0e0 END AS tav_withdrawal, "
    "CASE WHEN paid THEN ask_si ELSE start_si END AS end_si, "
    "load * ep_alloc_chrg_rate AS load_alloc_chrg, "
    "standard_coi + em_load_coi + pm_load_coi + acc_coi AS coi",
    "load - load_alloc_chrg AS load_alloc, "
    "load_alloc_chrg + ep_alloc_chrg + tp_alloc_chrg AS alloc_chrg, "
    "coi + admin_chrg * 12e0 AS plan_nom_deduction, "
    "start_tav - tav_withdrawal + tp_alloc AS tav_after_wdrl_and_alloc",
    "load_alloc + ep_alloc + tp_alloc AS alloc, "
    "start_eav - eav_withdrawal + ep_alloc + load_alloc AS eav_after_wdrl_and_alloc, "
    "plan_nom_deduction * due_a_n1_m12 AS plan_deduction",
    "eav_after_wdrl_and_alloc + tav_after_wdrl_and_alloc AS pav_after_wdrl_and_alloc",
    "NOT isnan(plan_deduction) AND plan_deduction <= pav_after_wdrl_and_alloc AS deduction_flag",
    "CASE WHEN deduction_flag THEN plan_nom_deduction ELSE 0e0 END AS nom_deduction, "
    "CASE WHEN deduction_flag THEN plan_deduction ELSE 0e0 END AS deduction, "
    "deduction_flag AND lb_rate > 0e0 AS lb_due, "
    "CASE WHEN deduction_flag AND product IN ('UVL02', 'UVL03') AND year = 11 "
    "THEN CASE WHEN start_si >= 1e9 THEN 0.4e0 ELSE 0.2e0 END "
    "WHEN deduction_flag AND product IN ('UVL02', 'UVL03') AND year = 21 "
    "THEN CASE WHEN start_si >= 1e9 THEN 1.2e0 ELSE 0.6e0 END ELSE 0e0 END AS sb_rate",
    "CASE WHEN deduction_flag THEN least(tav_after_wdrl_and_alloc, deduction) ELSE 0e0 END "
    "AS tav_deduction, "
    "CASE WHEN lb_due THEN CASE WHEN product = 'UVL01' THEN w3 ELSE 0e0 END + w2 + w1 "
    "+ tav_withdrawal ELSE 0e0 END AS lb_tav_withdrawal_review, "
    "CASE WHEN sb_rate > 0e0 THEN w9 + w8 + w7 + w6 + w5 + w4 + w3 + w2 + w1 + tav_withdrawal "
    "ELSE 0e0 END AS sb_tav_withdrawal_review",
    "deduction - tav_deduction AS eav_deduction, "
    "CASE WHEN deduction_flag THEN (tav_after_wdrl_and_alloc - tav_deduction) * annual_int_rate "
    "ELSE 0e0 END AS tav_int, "
    "lb_due AND lb_tav_withdrawal_review = 0e0 AS lb_flag, "
    "sb_rate > 0e0 AND sb_tav_withdrawal_review = 0e0 AS sb_flag",
    "CASE WHEN deduction_flag THEN (eav_after_wdrl_and_alloc - eav_deduction) * annual_int_rate "
    "ELSE 0e0 END AS eav_int, CASE WHEN lb_flag THEN lb_rate * tp_1 ELSE 0e0 END AS lb, "
    "CASE WHEN sb_flag THEN sb_rate * tp_1 ELSE 0e0 END AS sb",
    "eav_int + tav_int AS int, lb + sb AS bonus",
    "CASE WHEN deduction_flag THEN eav_after_wdrl_and_alloc - eav_deduction + eav_int ELSE 0e0 END "
    "AS end_eav, CASE WHEN deduction_flag THEN tav_after_wdrl_and_alloc - tav_deduction + tav_int "
    "+ bonus ELSE 0e0 END AS end_tav",
    "end_eav + end_tav AS end_pav",
)
VARIED_DOUBLES = (
    "start_si", "start_eav", "start_tav", "start_pav", "srr_val", "ben", "acc_ben",
    "withdrawal", "eav_withdrawal", "tav_withdrawal", "unrounded_em_load",
    "unrounded_pm_load", "em_load", "pm_load", "load", "load_alloc_chrg", "load_alloc",
    "alloc_chrg", "alloc", "sar", "standard_coi", "em_load_coi", "pm_load_coi", "acc_coi",
    "coi", "eav_after_wdrl_and_alloc", "tav_after_wdrl_and_alloc",
    "pav_after_wdrl_and_alloc", "plan_nom_deduction", "plan_deduction", "nom_deduction",
    "deduction", "tav_deduction", "eav_deduction", "eav_int", "tav_int", "int",
    "lb_tav_withdrawal_review", "lb", "sb_rate", "sb_tav_withdrawal_review", "sb", "bonus",
    "end_si", "end_eav", "end_tav", "end_pav",
)
VARIED_FLAGS = ("cont_flag", "deduction_flag", "lb_flag", "sb_flag")


def _year(source: str) -> str:
    for layer in LAYERS:
        source = f"SELECT *, {layer} FROM ({source})"
    kept = ", ".join(
        CONSTANTS + ("year",) + RING + VARIED_DOUBLES + VARIED_FLAGS[1:] + ("withdrawal_log",)
    )
    return f"SELECT {kept} FROM ({source})"


_constants = ", ".join(CONSTANTS)
_fresh_ring = ", ".join(f"0e0 AS {w}" for w in RING)
_next_ring = ", ".join(
    ["tav_withdrawal AS w1"] + [f"{a} AS {b}" for a, b in zip(RING, RING[1:])]
)
FOLD = f"""
wlists AS (
  SELECT k, list(withdrawal_input ORDER BY year) AS wl FROM fixed GROUP BY k),
fold AS (
  {_year(f"SELECT {_constants.replace('k,', 'p.k AS k,', 1)}, 1 AS year, si AS start_si, "
         f"0e0 AS start_eav, 0e0 AS start_tav, {_fresh_ring} "
         "FROM paths p JOIN wlists l ON p.k = l.k")}
  UNION ALL
  {_year(f"SELECT {_constants}, year + 1 AS year, end_si AS start_si, end_eav AS start_eav, "
         f"end_tav AS start_tav, {_next_ring} FROM fold WHERE deduction_flag AND year < term")})
"""
_after = ", ".join(f"coalesce(f.{c}, 0e0) AS {c}" for c in VARIED_DOUBLES)
_flags = ", ".join(f"coalesce(f.{c}, false) AS {c}" for c in VARIED_FLAGS[1:])
RESULTS = f"""
premiums AS (
  SELECT *, tp * srr_chrg_rate AS srr_chrg, tp * tp_alloc_chrg_rate AS tp_alloc_chrg,
    ep * ep_alloc_chrg_rate AS ep_alloc_chrg, tp - tp * tp_alloc_chrg_rate AS tp_alloc,
    ep - ep * ep_alloc_chrg_rate AS ep_alloc
  FROM (SELECT *, CASE WHEN tp_term_flag THEN CASE WHEN year = 1 THEN tp_1 + big_case_bonus
      ELSE tp_1 END ELSE 0e0 END AS tp, CASE WHEN tp_term_flag THEN ep_1 ELSE 0e0 END AS ep
    FROM (SELECT x.*, s.scenario_no, s.int_rate_scenario, s.risk_scenario, s.term_scenario,
        s.risk_flag, s.annual_int_rate, s.due_a_n1_m12,
        x.year <= s.tp_term AS tp_term_flag, x.year <= s.ep_term AS ep_term_flag
      FROM fixed x JOIN paths s ON x.k = s.k))),
results AS (
  SELECT p.*, f.k IS NOT NULL AS cont_flag, {_after}, {_flags},
    coalesce(f.withdrawal_log, 'No withdrawal.') AS withdrawal_log
  FROM premiums p LEFT JOIN fold f
    ON p.k = f.k AND p.scenario_no = f.scenario_no AND p.year = f.year)
"""

POLICY_LEVEL = (PLANS, PORTFOLIO, TERMS)
PATH_LEVEL = POLICY_LEVEL + (PATHS,)
GRID_LEVEL = POLICY_LEVEL + (GRID,)
PREMIUM_LEVEL = PATH_LEVEL + (GRID, RESULTS[:RESULTS.index("results AS")].rstrip().rstrip(","))
RESULT_LEVEL = PATH_LEVEL + (GRID, FOLD, RESULTS)


def query(parts: tuple[str, ...], select: str) -> str:
    return f"WITH RECURSIVE {', '.join(part.strip() for part in parts)} {select}"

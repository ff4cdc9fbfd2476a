"""The oracle SQL of every registered query."""

from __future__ import annotations

from checks.oracle import (
    GRID_LEVEL,
    MODES,
    PATH_LEVEL,
    PLANS,
    POLICY_LEVEL,
    PORTFOLIO,
    PREMIUM_LEVEL,
    PRODUCTS,
    RESULT_LEVEL,
    RIDERS,
    TERMS,
    VARIED_DOUBLES,
    VARIED_FLAGS,
    coi_rate,
    months_between,
    query,
    years_between,
)

KEYS = "policy_id, product, gender, entry_age"


def digest(name: str) -> str:
    value = f"CASE WHEN isnan({name}) THEN 0e0 ELSE {name} END"
    return (
        f"CAST(sum(CAST(floor(({value}) * 1e2 + 0.5e0) * year AS HUGEINT)) AS DOUBLE) AS {name}"
    )


def int_digest(name: str) -> str:
    return f"CAST(sum(CAST({name} AS HUGEINT) * 100 * year) AS DOUBLE) AS {name}"


def flag_digest(name: str) -> str:
    return f"CAST(sum(CASE WHEN {name} THEN year ELSE 0 END) AS BIGINT) AS {name}"


LOG = (
    "CAST(sum(year * list_position(['No withdrawal.', "
    "'Withdrawal amount exceeds policy account value.', "
    "'After withdrawal, end PAV is below acceptable limit.', "
    "'After withdrawal, end SI is below acceptable limit.', 'Successfully withdraw.'], "
    "withdrawal_log)) AS BIGINT) AS withdrawal_log"
)


def by_path(table: str, columns=(), flags=(), extra=(), where: str = "true", ints=(), nan=()) -> str:
    items = (
        [digest(c) for c in columns] + [int_digest(c) for c in ints]
        + [flag_digest(c) for c in flags] + list(extra)
        + [f"count_if(isnan({c})) AS {c}_nan" for c in nan]
    )
    return (
        f"SELECT policy_id, scenario_no, {', '.join(items)} FROM {table} WHERE {where} "
        "GROUP BY policy_id, scenario_no"
    )


def _policy(select: str) -> str:
    return query(POLICY_LEVEL, f"SELECT {select} FROM judged")


def _grid(select: str) -> str:
    return query(GRID_LEVEL, f"SELECT {select} FROM fixed")


def _path(select: str) -> str:
    return query(PATH_LEVEL, f"SELECT policy_id, scenario_no, {select} FROM paths")


FLAWED = f"""
raw AS (
  SELECT p.*, CASE WHEN k % 13 = 1 THEN '123' ELSE lpad(CAST(k AS VARCHAR), 12, '0') END AS owner_ssn,
    CASE WHEN k % 31 = 1 THEN '1234567890123' ELSE lpad(CAST(k + 1 AS VARCHAR), 12, '0') END
      AS insured_ssn,
    CASE WHEN k % 23 = 1 THEN rcd + 1 ELSE dob END AS f_dob,
    CASE WHEN k % 13 = 3 THEN 2.15e0 WHEN k % 13 = 2 THEN 3.5e0 ELSE em END AS f_em,
    CASE WHEN k % 13 = 4 THEN -1 ELSE em_term END AS f_em_term,
    CASE WHEN k % 17 = 1 THEN 18 ELSE pm END AS f_pm,
    CASE WHEN k % 17 = 4 THEN -2 ELSE pm_term END AS f_pm_term,
    CASE WHEN k % 23 = 2 THEN 'ILP02' ELSE product END AS f_product,
    CASE WHEN k % 23 = 3 THEN -1e0 ELSE si END AS f_si,
    CASE WHEN k % 23 = 4 THEN 9 ELSE acc_ben_coeff END AS f_coeff,
    CASE WHEN k % 23 = 5 THEN 3 ELSE maturity_option END AS f_option,
    CASE WHEN k % 23 = 6 THEN -1000e0 ELSE base_ep END AS f_ep,
    CASE WHEN k % 23 = 7 THEN -3 ELSE opted_tp_term END AS f_tp_term,
    CASE k % 29 WHEN 2 THEN 99 WHEN 3 THEN 1 WHEN 4 THEN -1 ELSE opted_ep_term END AS f_ep_term,
    CASE k % 17 WHEN 2 THEN [('F000', 90, 100)] WHEN 3 THEN []
      WHEN 5 THEN [('F003', 120, -20), ('F000', -20, 120)] WHEN 6 THEN [('F000', 100, 80)]
      ELSE CASE WHEN k % 4 < 3 THEN [('F000', 100, 100)]
        ELSE [('F001', 60, 40), ('F002', 40, 60)] END END AS funds,
    CASE k % 19 WHEN 1 THEN [(9, 5)] WHEN 2 THEN [(4, 8), (8, 9)] WHEN 3 THEN [(1, 3), (5, 6)]
      WHEN 4 THEN [(-2, 3)] ELSE plan END AS plan
  FROM pf p LEFT JOIN (
    SELECT k, list((y_from, y_to) ORDER BY y_from) AS plan FROM spans GROUP BY k) s
  USING (k)),
checked AS (
  SELECT *, CASE WHEN f_product = 'ILP02' OR f_dob > rcd THEN NULL
      ELSE CASE f_option WHEN 1 THEN 100 ELSE 66 END - {years_between('f_dob', 'rcd')} END AS f_term,
    CASE f_product WHEN 'ILP02' THEN NULL WHEN 'UVL01' THEN 4 ELSE 3 END AS must_pay
  FROM raw)
"""
# rule, condition; in the engine's order.
RULES = (
    ("owner_ssn", "length(owner_ssn) <> 12"),
    ("insured_ssn", "length(insured_ssn) <> 12"),
    ("em_load_step", "f_em * 4e0 <> floor(f_em * 4e0)"),
    ("em_load_range", "f_em < 0e0 OR f_em > 2.5e0"),
    ("em_load_term_range", "f_em_term < 0"),
    ("pm_load_range", "f_pm < 0 OR f_pm > 15"),
    ("pm_load_term_range", "f_pm_term < 0"),
    ("si_range", "f_si < 0e0"),
    ("ep_range", "f_ep < 0e0"),
    ("opted_tp_term_range", "f_tp_term < 0"),
    ("opted_ep_term_range", "f_ep_term < 0"),
    ("maturity_option_range", "f_option NOT IN (1, 2)"),
    ("acc_ben_coeff_range", "f_coeff < 1 OR f_coeff > 5"),
    ("fund_pct_range", "len(list_filter(funds, lambda f: f[2] < 0 OR f[2] > 100 OR f[3] < 0 "
                       "OR f[3] > 100)) > 0"),
    ("fund_empty", "len(funds) = 0"),
    ("fund_tp_total", "len(funds) > 0 AND list_sum(list_transform(funds, lambda f: f[2])) <> 100"),
    ("fund_ep_total", "len(funds) > 0 AND list_sum(list_transform(funds, lambda f: f[3])) <> 100"),
    ("withdrawal_range", "len(list_filter(plan, lambda w: w[1] < 0 OR w[2] < 0)) > 0"),
    ("withdrawal_reversed", "len(list_filter(plan, lambda w: w[1] > w[2])) > 0"),
    ("withdrawal_order", "len(list_filter(range(2, len(plan) + 1), "
                         "lambda i: plan[i][1] <= plan[i - 1][2])) > 0"),
    ("term_unknown", "f_term IS NULL"),
    ("tp_term", "f_tp_term > f_term"),
    ("ep_term", "f_ep_term > f_tp_term"),
    ("must_pay", "f_ep_term < must_pay"),
    ("em_load_term", "f_em_term > f_term"),
    ("pm_load_term", "f_pm_term > f_term"),
    ("withdrawal_start", "plan[1][1] < CASE f_product WHEN 'ILP02' THEN 0 ELSE 2 END"),
    ("default_fund", "f_product LIKE 'UVL%' AND (len(funds) <> 1 OR funds[1][1] <> 'F000')"),
)
# Published wording of the rules.
MESSAGES = {
    "owner_ssn": "Owner SSN is not 12 characters.",
    "insured_ssn": "Insured SSN is not 12 characters.",
    "em_load_step": "EM load is not a multiple of 0.25.",
    "em_load_range": "EM load is not within 0 and 2.5.",
    "em_load_term_range": "EM load term is negative.",
    "pm_load_range": "PM load is not within 0 and 15.",
    "pm_load_term_range": "PM load term is negative.",
    "si_range": "Sum insured is negative.",
    "ep_range": "EP is negative.",
    "opted_tp_term_range": "Opted TP term is negative.",
    "opted_ep_term_range": "Opted EP term is negative.",
    "maturity_option_range": "Maturity option is not 1 or 2.",
    "acc_ben_coeff_range": "Accident coefficient is not within 1 and 5.",
    "fund_pct_range": "A fund percentage is not within 0 and 100.",
    "fund_empty": "Fund allocation is empty.",
    "fund_tp_total": "TP fund allocation is not 100% in total.",
    "fund_ep_total": "EP fund allocation is not 100% in total.",
    "withdrawal_range": "A withdrawal year or amount is negative.",
    "withdrawal_reversed": "A withdrawal starts after it ends.",
    "withdrawal_order": "A withdrawal starts before the previous one has ended.",
    "term_unknown": "Unsupported product, or birth date after contract date.",
    "tp_term": "Opted TP term exceeds the policy term.",
    "ep_term": "Opted EP term exceeds the opted TP term.",
    "must_pay": "Opted EP term is under the must-pay period.",
    "em_load_term": "EM load term exceeds the policy term.",
    "pm_load_term": "PM load term exceeds the policy term.",
    "withdrawal_start": "The first withdrawal is too early.",
    "default_fund": "The product takes exactly one fund, F000.",
}
CROSSING = 20
VIOLATED = "broken AS (" + " UNION ALL ".join(
    f"SELECT policy_id, {i} AS place, '{rule}' AS rule, '{MESSAGES[rule]}' AS message FROM checked WHERE {condition}"
    for i, (rule, condition) in enumerate(RULES)
) + ")"
FLAWED_LEVEL = (PLANS, PORTFOLIO, FLAWED, VIOLATED)

RIDER_LEVEL = (PORTFOLIO, f"""
numbered AS (
  SELECT *, k + position AS n, {RIDERS}[CAST(1 + (k + position) % 8 AS INT)] AS rider_id,
    dob + CAST(position * 400 AS INT) AS rider_dob
  FROM (SELECT *, CAST(unnest(range(CAST(k % 3 + 1 AS BIGINT))) AS INT) AS position
    FROM pf WHERE k % 5 > 0)),
limits(product, lo, hi, maturity) AS (VALUES ('ADD01', 18, 60, 61), ('PPD01', NULL, 70, 71),
  ('HOP02', 2, 59, 60), ('CIR02', 1, 65, 75), ('CIR01', 1, 58, 65), ('SUP01', 20, 59, 60),
  ('WOP01', 18, 60, 65), ('WOP02', 18, 60, 65)),
r AS (
  SELECT policy_id, position, rider_id AS product, CASE WHEN rider_dob <= rcd THEN
      {years_between('rider_dob', 'rcd')} END AS entry_age,
    CASE WHEN n % 8 < 6 THEN CAST(1 + n % 10 AS DOUBLE) * 1e7 END AS si,
    CASE WHEN rider_id = 'HOP02' THEN CAST(1 + n % 3 AS INT) END AS hop2_option,
    CASE WHEN n % 3 > 0 THEN CAST(n % 4 AS INT) END AS pm_load
  FROM numbered
  UNION ALL SELECT policy_id, NULL, NULL, NULL, NULL, NULL, NULL FROM pf WHERE k % 5 = 0)
""")

READ = f"""
SELECT layout, read_error, CASE WHEN coalesce(read_error, '') <> 'malformed document' THEN policy_id END AS policy_id,
  CASE WHEN read_error IS NOT NULL THEN true END AS has_text,
  {', '.join(f"CASE WHEN read_error IS NULL THEN {expression} END AS {name}" for name, expression in (
      ('product', 'product'), ('si', 'si'),
      ('dob', "strftime(dob, '%Y-%m-%d')"), ('em_load', 'em'),
      ('n_funds', 'CASE WHEN k % 4 < 3 THEN 1 ELSE 2 END'),
      ('n_withdrawals', 'CAST(coalesce(n, 0) AS INT)'),
      ('n_riders', 'CASE WHEN k % 5 > 0 THEN CAST(k % 3 + 1 AS INT) ELSE 0 END'),
  ))}
FROM (SELECT *, CASE k % 41 WHEN 1 THEN 'malformed document'
    WHEN 2 THEN CASE WHEN k % 4 < 3 THEN 'unknown code' END WHEN 3 THEN 'missing field' END AS read_error
  FROM pf) LEFT JOIN (SELECT k, count(*) AS n FROM spans GROUP BY k) USING (k),
  (VALUES ('lines'), ('several')) layouts(layout)
"""
WRITTEN = (
    f"SELECT int_rate_scenario, scenario_no, {digest('end_pav')}, count(*) AS n FROM results "
    "GROUP BY int_rate_scenario, scenario_no")
REVIEWED = """
SELECT scenario_no, review, count(*) AS n, count_if(passed) AS n_passed, CAST(0 AS BIGINT) AS n_differing FROM (
  SELECT scenario_no, 'loyalty' AS review, lb_flag AS passed FROM results WHERE deduction_flag AND lb_rate > 0e0
  UNION ALL
  SELECT scenario_no, 'special', sb_flag FROM results WHERE deduction_flag AND sb_rate > 0e0)
GROUP BY scenario_no, review
"""

ROLL_STEPS = {
    "start_values": (("start_si", "start_eav", "start_tav", "start_pav"), ("cont_flag",)),
    "surrender_value": (("srr_val",), ()),
    "benefit": (("ben",), ()),
    "accident_benefit": (("acc_ben",), ()),
    "em_load": (("unrounded_em_load", "em_load"), ()),
    "pm_load": (("unrounded_pm_load", "pm_load"), ()),
    "load_totals": (("load", "load_alloc_chrg", "load_alloc", "alloc_chrg", "alloc"), ()),
    "accounts_after_allocation": (
        ("eav_after_wdrl_and_alloc", "tav_after_wdrl_and_alloc", "pav_after_wdrl_and_alloc"), ()),
    "sum_at_risk": (("sar",), ()),
    "cost_of_insurance": (
        ("standard_coi", "em_load_coi", "pm_load_coi", "acc_coi", "coi"), ()),
    "planned_deduction": (("plan_nom_deduction", "plan_deduction"), ("deduction_flag",)),
    "deduction_split": (("nom_deduction", "deduction", "tav_deduction", "eav_deduction"), ()),
    "interest": (("eav_int", "tav_int", "int"), ()),
    "loyalty_bonus": (("lb_tav_withdrawal_review", "lb"), ("lb_flag",)),
    "special_bonus": (("sb_rate", "sb_tav_withdrawal_review", "sb", "bonus"), ("sb_flag",)),
    "end_values": (("end_si", "end_eav", "end_tav", "end_pav"), ()),
}
PREMIUM_AMOUNTS = (
    "tp", "ep", "srr_chrg", "tp_alloc_chrg", "ep_alloc_chrg", "tp_alloc", "ep_alloc",
)
RATES = (
    "withdrawal_input", "tp_alloc_chrg_rate", "ep_alloc_chrg_rate", "srr_chrg_rate", "lb_rate",
    "coi_rate", "juvenile_lien_rate", "admin_chrg",
)
TIME_FLAGS = ("pol_term_flag", "acc_ben_term_flag", "em_load_term_flag", "pm_load_term_flag")
CHECK = (
    "SELECT CAST(count_if(year NOT IN (3, 4)) AS BIGINT) AS matched, "
    "CAST(count_if(year = 3) AS BIGINT) AS only_left, "
    "CAST(0 AS BIGINT) AS only_right, CAST(count_if(year = 4) AS BIGINT) AS repeated, "
    "CAST(count_if(year % 5 = 0) AS BIGINT) AS diff_coi_rate, "
    "CAST(count_if(year % 9 = 0) AS BIGINT) AS diff_pol_term_flag, "
    "CAST(0 AS BIGINT) AS diff_admin_chrg FROM fixed"
)


def _results(select: str) -> str:
    return query(RESULT_LEVEL, select)


RESULT_DIGESTS = ", ".join([
    *[digest(c) for c in VARIED_DOUBLES + RATES + PREMIUM_AMOUNTS + ("annual_int_rate", "due_a_n1_m12")],
    *[int_digest(c) for c in ("age", "cal_year")],
    *[flag_digest(c) for c in VARIED_FLAGS + TIME_FLAGS + ("tp_term_flag", "ep_term_flag", "risk_flag")], LOG,
])
WHOLE_WRITTEN = (
    "SELECT scenario_no, int_rate_scenario, risk_scenario, term_scenario, count(*) AS n, CAST(sum(year) AS BIGINT) AS year, "
    "CAST(sum(CAST(policy_id AS HUGEINT) * year) AS DOUBLE) AS policy_id, "
    f"{RESULT_DIGESTS} FROM results GROUP BY scenario_no, int_rate_scenario, risk_scenario, term_scenario")

ORACLE = {
    "read_policies": query((PLANS, PORTFOLIO), READ),
    "scan_rates": _policy(f"{KEYS}, {coi_rate('product', 'gender', 'entry_age')} AS coi_rate"),
    "load_rate_csv": _policy("policy_id, tp_1, tp_12, reject_reason"),
    "write_result": _results(WHOLE_WRITTEN),
    "write_result_csv": _results(WRITTEN),
    "ordered_output": _results(
        "SELECT int_rate_scenario, CAST(count(*) AS BIGINT) AS n, CAST(0 AS BIGINT) AS rows_back, "
        "CAST(0 AS BIGINT) AS files_back FROM results GROUP BY int_rate_scenario"),
    "decode_dimensions": query((PORTFOLIO,), (
        "SELECT policy_id, product, gender, [1, 2, 4, 12][CAST(1 + k % 4 AS INT)] AS mode, "
        "1 AS base_flag, product || ' name' AS product_name, "
        "CASE gender WHEN 1 THEN 'Male' ELSE 'Female' END AS gender_text, "
        "['Annual', 'Semi-annual', 'Quarterly', 'Monthly'][CAST(1 + k % 4 AS INT)] "
        "AS paymode_text FROM pf")),
    "prem_rate": _policy(f"{KEYS}, prem_rate"),
    "extra_prem_rate": _policy(f"{KEYS}, em_term AS em_load_term, extra_prem_rate"),
    "modal_factor": _policy(f"{KEYS}, " + ", ".join(f"{f} AS modal_factor_{m}" for m, f in MODES)),
    **{
        name: _grid("policy_id, year, age, cal_year, " + columns)
        for name, columns in (
            ("alloc_chrg_rate", "tp_alloc_chrg_rate, ep_alloc_chrg_rate"),
            ("srr_chrg_rate", "srr_chrg_rate"), ("lb_rate", "lb_rate"),
            ("coi_rate", "coi_rate"), ("juvenile_lien_rate", "juvenile_lien_rate"),
            ("admin_chrg", "admin_chrg"),
        )
    },
    "int_rate": _policy(
        "policy_id, product, hir AS int_rate_high, lir AS int_rate_low"),
    "int_rate_tuple": _policy(
        "policy_id, hir AS int_rate_high, lir AS int_rate_low, gir AS int_rate_guaranteed"),
    "age_limits": _policy(
        f"{KEYS}, CAST(NULL AS INT) AS limit_min_entry_age, 60 AS limit_max_entry_age, "
        "CAST(NULL AS INT) AS limit_maturity_age, entry_age > 60 AS over_max"),
    "acc_coi_rate": _policy(f"{KEYS}, acc_coi_rate"),
    "age_years": query((PORTFOLIO,), (
        f"SELECT policy_id, {years_between('dob', 'rcd')} AS insured_age, "
        f"{years_between('(dob - 9000)', 'rcd')} AS owner_age, "
        "CASE WHEN rcd <= dob THEN 0 END AS reversed_age FROM pf")),
    "age_months": query((PORTFOLIO,), (
        f"SELECT policy_id, {months_between('dob', 'rcd')} AS insured_months, "
        f"{months_between('(dob - 9000)', 'rcd')} AS owner_months FROM pf")),
    "entry_age": _policy(
        f"{KEYS}, CASE WHEN entry_age = 0 THEN {months_between('dob', 'rcd')} END "
        "AS entry_month_age"),
    "policy_term": _policy(f"{KEYS}, maturity_age, term, acc_ben_term"),
    "withdrawal_years": query((PLANS, PORTFOLIO), (
        "SELECT policy_id, year, amount AS withdrawal_input FROM pf JOIN plan_years USING (k)")),
    "modal_tp": _policy(f"{KEYS}, tp_1, tp_2, tp_4, tp_12"),
    "modal_ep": _policy(f"{KEYS}, ep_1, ep_2, ep_4, ep_12"),
    "big_case_bonus": _policy(f"{KEYS}, tp_1, big_case_bonus"),
    "product_params": _policy(
        f"{KEYS}, must_pay_period, must_pay_period AS lb_review_period, 10 AS sb_review_period, "
        "1e8 AS min_si, 2 AS withdrawal_start_year"),
    "policy_terms": _policy(
        f"{KEYS}, term, prem_rate, extra_prem_rate, tp_1, ep_1, big_case_bonus, "
        "hir AS int_rate_high, reject_reason"),
    "rejects": query(
        POLICY_LEVEL,
        "SELECT policy_id, reject_reason FROM judged WHERE reject_reason IS NOT NULL"),
    "rejects_all_reasons": query(POLICY_LEVEL, """
        SELECT policy_id, reject_reason, 'policies' AS flawed FROM (
          SELECT policy_id, CASE k % 11 WHEN 1 THEN 'missing field' WHEN 2 THEN 'birth date after contract date'
            WHEN 3 THEN 'unsupported product' WHEN 4 THEN 'no policy year'
            ELSE coalesce(reject_reason, CASE WHEN k % 11 = 5 AND term >= 8 THEN 'overlapping withdrawal years' END)
            END AS reject_reason FROM judged)
        WHERE reject_reason IS NOT NULL
        UNION ALL
        SELECT policy_id, reject_reason, 'rates' FROM (
          SELECT policy_id, CASE WHEN product = 'ILP01' THEN 'no interest rate'
            WHEN product = 'UVL02' THEN 'modal factors incomplete'
            WHEN product = 'UVL03' AND entry_age >= 40 THEN 'no premium rate'
            WHEN extra_prem_rate IS NULL THEN 'no extra premium rate'
            WHEN product = 'UVL03' THEN 'excess premium charge of 100%' ELSE 'unreadable rate row'
            END AS reject_reason FROM judged)"""),
    "violations": query(FLAWED_LEVEL, "SELECT policy_id, rule, message FROM broken"),
    "first_failure": query(FLAWED_LEVEL, (
        "SELECT policy_id, f.rule AS first_failure FROM checked LEFT JOIN ("
        f"SELECT policy_id, arg_min(rule, place) AS rule FROM broken WHERE place >= {CROSSING} "
        "GROUP BY policy_id) f USING (policy_id)")),
    "quarantine": query(
        FLAWED_LEVEL,
        "SELECT policy_id, CAST(count(*) AS INT) AS n_rules FROM broken GROUP BY policy_id"),
    "fixed_init": _grid("policy_id, year, age, cal_year, " + ", ".join(TIME_FLAGS)),
    "fixed_mapping": _grid("policy_id, year, " + ", ".join(RATES)),
    "fixed": _grid("policy_id, year, age, cal_year, " + ", ".join(TIME_FLAGS + RATES)),
    "scenario_grid": _path("int_rate_scenario, risk_scenario, term_scenario"),
    "scenario_interest": _path("annual_int_rate"),
    "annuity_factor": _path("due_a_n1_m12"),
    "scenario_term": _path("term_scenario, tp_term, ep_term"),
    "scenario_columns": query(PREMIUM_LEVEL, by_path(
        "premiums", ("annual_int_rate",), ("tp_term_flag", "ep_term_flag", "risk_flag"))),
    "premium": query(PREMIUM_LEVEL, by_path("premiums", ("tp", "ep"), ("risk_flag",))),
    "charges_and_allocation": query(PREMIUM_LEVEL, by_path("premiums", PREMIUM_AMOUNTS[2:])),
    "result_defaults": _results(by_path(
        "results", VARIED_DOUBLES + ("tp", "ep"), VARIED_FLAGS,
        (LOG, "count(*) AS n_years"), "NOT cont_flag")),
    **{name: _results(by_path("results", *step, nan=step[0])) for name, step in ROLL_STEPS.items()},
    "withdrawal": _results(by_path(
        "results", ("withdrawal", "eav_withdrawal", "tav_withdrawal", "end_si"), extra=(LOG,))),
    "lapse": _results(by_path("results", extra=(
        "max(CASE WHEN cont_flag THEN year END) AS last_year",
        "max(CASE WHEN cont_flag AND NOT deduction_flag THEN year END) AS lapse_year",
        "count(*) AS n_years"))),
    "varied": _results(by_path("results", VARIED_DOUBLES, VARIED_FLAGS, (LOG,))),
    "union_scenarios": query(PREMIUM_LEVEL, (
        "SELECT policy_id, scenario_no, int_rate_scenario, risk_scenario, term_scenario, "
        "count(*) AS n_years, max(year) AS last_year FROM premiums "
        "GROUP BY policy_id, scenario_no, int_rate_scenario, risk_scenario, term_scenario")),
    "project_portfolio": _results(by_path(
        "results",
        VARIED_DOUBLES + RATES + PREMIUM_AMOUNTS + ("annual_int_rate", "due_a_n1_m12"),
        VARIED_FLAGS + TIME_FLAGS + ("tp_term_flag", "ep_term_flag", "risk_flag"), (LOG,),
        ints=("age", "cal_year"))),
    "portfolio_totals": _results(
        "SELECT scenario_no, int_rate_scenario, risk_scenario, term_scenario, year, "
        "CASE int_rate_scenario WHEN 'High' THEN 0 WHEN 'Low' THEN 1 ELSE 2 END "
        "AS int_rate_scenario_code, count(*) AS n, "
        + ", ".join(digest(c) for c in
                    ("tp", "ep", "coi", "deduction", "withdrawal", "bonus", "end_pav"))
        + " FROM results WHERE cont_flag GROUP BY ALL"),
    "reconcile": query(GRID_LEVEL, CHECK),
    "compare_frames": query(GRID_LEVEL, "SELECT count(*) > 0 AS equal FROM fixed"),
    "compare_repeated_keys": query(GRID_LEVEL, (
        "SELECT policy_id, CAST(count(*) AS BIGINT) AS n, "
        "CAST(count_if(CAST(policy_id AS BIGINT) % 10 = 2) AS BIGINT) AS n_unpaired, "
        "CAST(count_if(CAST(policy_id AS BIGINT) % 10 = 1) AS BIGINT) AS n_differing "
        "FROM fixed GROUP BY policy_id")),
    "bonus_review_check": _results(REVIEWED),
    "riders": query(RIDER_LEVEL, (
        "SELECT policy_id, position, r.product, entry_age, si, hop2_option, pm_load, "
        "CASE WHEN r.product IN ('ADD01', 'HOP02') THEN 0.083333333e0 "
        "WHEN r.product IS NOT NULL THEN 0.09e0 END AS modal_factor_12, "
        "lo AS limit_min_entry_age, hi AS limit_max_entry_age, maturity AS limit_maturity_age "
        "FROM r LEFT JOIN limits l ON l.product = r.product")),
}

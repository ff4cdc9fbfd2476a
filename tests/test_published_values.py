"""A policy under the published rates, against the published table and anchors of its projection."""

import pytest
from conftest import person, policies, policy
from pyspark.sql import functions as F

from tidefold.fixtures.rates import demo_book
from tidefold.plans.fixed import FIXED_COLUMNS, fixed_table
from tidefold.plans.projection import project_portfolio
from tidefold.plans.terms import accepted, policy_terms
from tidefold.sources.rates import TABLES, RateBook, local_table

# Premium rate of UVL01 for women of age 0, and their cost rates at ages 0 to 99.
PREMIUM_RATE = 10.6128
COST_RATES = [
    0.00188, 0.00084, 0.00080, 0.00078, 0.00077, 0.00075, 0.00073, 0.00071, 0.00070, 0.00069,
    0.00068, 0.00070, 0.00073, 0.00077, 0.00082, 0.00087, 0.00092, 0.00096, 0.00100, 0.00103,
    0.00106, 0.00108, 0.00110, 0.00112, 0.00115, 0.00117, 0.00120, 0.00124, 0.00128, 0.00132,
    0.00137, 0.00142, 0.00147, 0.00154, 0.00161, 0.00170, 0.00182, 0.00196, 0.00213, 0.00232,
    0.00253, 0.00275, 0.00298, 0.00320, 0.00344, 0.00368, 0.00392, 0.00419, 0.00448, 0.00479,
    0.00513, 0.00550, 0.00592, 0.00638, 0.00685, 0.00733, 0.00780, 0.00825, 0.00870, 0.00920,
    0.00980, 0.01054, 0.01149, 0.01263, 0.01392, 0.01529, 0.01671, 0.01813, 0.01959, 0.02123,
    0.02316, 0.02553, 0.02847, 0.03199, 0.03605, 0.04056, 0.04545, 0.05068, 0.05632, 0.06257,
    0.06967, 0.07783, 0.08725, 0.09790, 0.10962, 0.12229, 0.13582, 0.15018, 0.16538, 0.18154,
    0.19885, 0.21768, 0.23869, 0.26341, 0.29523, 0.34102, 0.41388, 0.53724, 0.74396, 1.00000,
]
# Published columns by the first policy year of each value.
PUBLISHED = {
    "acc_ben_term_flag": [(1, True), (67, False)],
    "admin_chrg": [(1, 25000.0), (92, 0.0)],
    "em_load_term_flag": [(1, True), (21, False)],
    "ep_alloc_chrg_rate": [(1, 0.02)],
    "juvenile_lien_rate": [(1, 1.0)],
    "lb_rate": [(1, 0.0), (4, 0.06), (5, 0.0), (8, 0.12), (9, 0.0), (12, 0.18), (13, 0.0), (16, 0.24), (17, 0.0),
                (20, 0.3), (21, 0.0)],
    "pm_load_term_flag": [(1, True), (21, False)],
    "pol_term_flag": [(1, True)],
    "srr_chrg_rate": [(1, 1.0), (5, 0.8), (6, 0.6), (7, 0.4), (8, 0.2), (9, 0.1), (10, 0.0)],
    "tp_alloc_chrg_rate": [(1, 0.55), (2, 0.4), (3, 0.25), (4, 0.2), (5, 0.1), (6, 0.07), (8, 0.04), (10, 0.02)],
    "withdrawal_input": [(1, 0.0), (5, 1e6), (8, 0.0), (12, 5e6), (16, 0.0), (20, 1e7), (24, 0.0)],
}
ANNUAL_PREMIUM = 1_072_000.0
# Anchors at standard risk, worked out by hand from the published formulas: interest scenario, discount factor,
# deduction of year 1, excess accounts after years 1, 2 and 100, target account after year 2, last year of must-pay.
ANCHORS = [
    ("High", 0.9696493103980939, 739435.171123, 5177692.3669, 10992850.8326, 49265463696.4508, 10522.4345, 25),
    ("Low", 0.977982343618824, 745789.775597, 5074240.7356, 10678752.7724, 10252847632.9116, 4521.305, 22),
    ("Guaranteed", 0.9909809395757825, 755702.244902, 4919151.7102, 10211053.6615, 1294967566.5232, 0.0, 15),
]
OPTED_HIGH = 43012528896.9371


@pytest.fixture(scope="module")
def published(spark):
    tables = dict(demo_book(spark).tables)
    girls = (F.col("product") == "UVL01") & (F.col("gender") == 2)
    for name, rows in {
        "prem_rate": [("UVL01", 2, 0, PREMIUM_RATE)],
        "coi_rate": [("UVL01", 2, age, rate) for age, rate in enumerate(COST_RATES)],
    }.items():
        rates = local_table(spark, rows, TABLES[name].columns)
        tables[name] = tables[name].where(~girls).unionByName(rates)
    return RateBook.of(tables)


@pytest.fixture(scope="module")
def terms(spark, published):
    return accepted(policy_terms(_policies(spark), published))


def _policies(spark):
    child = dict(person(dob="2024-05-23"), gender="Female")
    plan = [{"from": a, "to": b, "amount": amount} for a, b, amount in ((5, 7, 1e6), (12, 15, 5e6), (20, 23, 1e7))]
    return policies(spark, policy(
        rcd="2025-02-23", paymode="Annual", insured=child, si=101e6, opted_tp_term=35, ep=5.2e6, opted_ep_term=24,
        death_tpd_option="A", maturity_option=1, acc_ben_coeff=3, withdrawal_plan=plan,
        load={"em_load": 0.75, "em_load_term": 20, "pm_load": 2, "pm_load_term": 20},
    ))


def test_published_premium(terms):
    assert terms.select("tp_1", "ep_1", "term").first() == (ANNUAL_PREMIUM, 5.2e6, 100)


def test_published_fixed_table(terms, published):
    rows = fixed_table(terms, published).orderBy("year").collect()
    assert [(r.year, r.age, r.cal_year) for r in rows] == [(y, y - 1, 2024 + y) for y in range(1, 101)]
    assert [r.coi_rate for r in rows] == COST_RATES
    assert set(FIXED_COLUMNS) == {"year", "age", "cal_year", "coi_rate", *PUBLISHED}
    for name, steps in PUBLISHED.items():
        found = [(r.year, r[name]) for i, r in enumerate(rows) if not i or r[name] != rows[i - 1][name]]
        assert found == steps, name


def test_anchors_of_the_projection(spark, published):
    results = project_portfolio(_policies(spark), published).where("risk_scenario = 'Standard'")
    found = {(r.int_rate_scenario, r.term_scenario, r.year): r for r in results.collect()}
    for scenario, due, deduction, eav_1, eav_2, eav_100, tav_2, last in ANCHORS:
        for term in ("Policy", "Opted", "Must-pay"):
            first, second = found[scenario, term, 1], found[scenario, term, 2]
            assert first.due_a_n1_m12 == pytest.approx(due, rel=1e-14)
            assert first.deduction == pytest.approx(deduction, rel=1e-11)
            assert first.end_eav == pytest.approx(eav_1, abs=1e-4)
            assert second.end_eav == pytest.approx(eav_2, abs=1e-4)
            assert second.end_tav == pytest.approx(tav_2, abs=1e-4)
        assert found[scenario, "Policy", 100].end_eav == pytest.approx(eav_100, abs=1e-3)
        lapsed = min(y for (s, t, y), r in found.items() if (s, t) == (scenario, "Must-pay") and not r.deduction_flag)
        assert lapsed == last
    assert found["High", "Opted", 100].end_eav == pytest.approx(OPTED_HIGH, abs=1e-3)

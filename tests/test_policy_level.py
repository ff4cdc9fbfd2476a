import datetime as dt
import json

import pytest
from conftest import documents, person, policies, policy
from pyspark.sql import functions as F

from tidefold.functions.dates import age_months, age_years
from tidefold.functions.premiums import annuity_due_monthly
from tidefold.operators.validation import first_failures, valid, validate, violations, wrong_ssn
from tidefold.plans.options import ProjectionOptions
from tidefold.plans.terms import flatten, policy_terms, withdrawal_years
from tidefold.sources.policies import loadable, read_policies, unreadable
from tidefold.sources.rates import TABLES, RateBook, local_table, load_rate_csv

# Birth, date, completed years, completed months: the day before, on and after a
# birthday; the same for a month; leap days; month ends; the future.
AGES = [
    ("1987-09-10", "2023-09-09", 35, 431),
    ("1987-09-10", "2023-09-10", 36, 432),
    ("1987-09-10", "2023-09-11", 36, 432),
    ("2023-05-19", "2023-11-18", 0, 5),
    ("2023-05-19", "2023-11-19", 0, 6),
    ("2020-02-29", "2023-02-28", 2, 35),
    ("2020-02-29", "2023-03-01", 3, 36),
    ("2023-01-31", "2023-06-30", 0, 4),
    ("2023-07-01", "2023-06-30", None, None),
]


def test_ages(spark):
    rows = [tuple(map(dt.date.fromisoformat, case[:2])) for case in AGES]
    frame = spark.createDataFrame(rows, "birth date, on date")
    found = frame.select(
        age_years(F.col("birth"), F.col("on")), age_months(F.col("birth"), F.col("on"))
    ).collect()
    assert [tuple(row) for row in found] == [case[2:] for case in AGES]


def test_annuity_factors(spark):
    rates = spark.createDataFrame([(0.07,), (0.05,), (0.02,)], "i double")
    found = [r[0] for r in rates.select(annuity_due_monthly(F.col("i"), False)).collect()]
    assert found == [0.9696493103980939, 0.977982343618824, 0.9909809395757825]
    zero = spark.createDataFrame([(0.0,)], "i double")
    assert zero.select(F.isnan(annuity_due_monthly(F.col("i"), False))).first()[0]
    assert zero.select(annuity_due_monthly(F.col("i"), True)).first()[0] == 1.0


def test_unreadable_documents_are_split_off(spark):
    unknown = policy(id="XXX01")
    missing = policy()
    del missing["base"]["si"]
    read = documents(spark, policy(), '{"id": "9", "owner"', unknown, missing)
    assert loadable(read).count() == 1
    errors = sorted(row["read_error"] for row in unreadable(read).collect())
    assert errors == ["malformed document", "missing field", "unknown code"]


def test_both_file_layouts(spark, tmp_path):
    (tmp_path / "pretty").mkdir()
    (tmp_path / "pretty" / "a.json").write_text(json.dumps(policy(), indent=2))
    (tmp_path / "lines.json").write_text("\n".join([json.dumps(policy())] * 3))
    assert loadable(read_policies(spark, str(tmp_path / "pretty"), multi_line=True)).count() == 1
    assert loadable(read_policies(spark, str(tmp_path / "lines.json"))).count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_policies(spark, str(tmp_path / "none.json"))


def test_withdrawal_years(spark):
    rows = withdrawal_years(flatten(policies(spark, policy()))).collect()
    assert sorted((r["year"], r["withdrawal_input"]) for r in rows) == (
        [(y, 2e6) for y in (6, 7, 8)] + [(y, 4e6) for y in (14, 15)]
    )


def _load(**changes):
    return dict(policy()["base"]["load"], **changes)


# One broken rule each, just outside its limit.
CASES = {
    "em_load_range": policy(load=_load(em_load=2.75)),
    "em_load_step": policy(load=_load(em_load=0.6)),
    "pm_load_range": policy(load=_load(pm_load=16)),
    "insured_ssn": policy(insured=person(ssn="9000000000170")),
    "tp_term": policy(opted_tp_term=72),
    "ep_term": policy(opted_ep_term=29),
    "must_pay": policy(opted_ep_term=3),
    "default_fund": policy(fund_alloc=[{"fund": "F004", "tp_pct": 100, "ep_pct": 100}]),
    "fund_ep_total": policy(fund_alloc=[{"fund": "F000", "tp_pct": 100, "ep_pct": 99}]),
    "withdrawal_start": policy(withdrawal_plan=[{"from": 1, "to": 1, "amount": 7.0}]),
    "withdrawal_reversed": policy(withdrawal_plan=[{"from": 4, "to": 3, "amount": 7.0}]),
    "withdrawal_order": policy(withdrawal_plan=[{"from": 4, "to": 9, "amount": 7.0},
                                                {"from": 9, "to": 9, "amount": 7.0}]),
    "term_unknown": policy(id="ILP02"),
}


def test_validation_rules(spark):
    docs = []
    for name, doc in CASES.items():
        docs.append(dict(doc, id=name))
    good = [dict(policy(), id="good"), dict(policy(withdrawal_plan=[]), id="empty"),
            dict(policy(withdrawal_plan=None), id="none")]
    checked = validate(policies(spark, *docs, *good))
    found = {(r["policy_id"], r["rule"]) for r in violations(checked).collect()}
    assert found == {(name, name) for name in CASES}
    assert {r["id"] for r in valid(checked).collect()} == {"good", "empty", "none"}
    verdicts = {r["policy_id"]: r["first_failure"] for r in first_failures(checked).collect()}
    assert verdicts["must_pay"] == "must_pay" and verdicts["good"] is None


def test_age_limits_are_an_extra_rule(spark, book):
    old = dict(policy(insured=person(dob="1950-01-01")), id="old")
    plain = violations(validate(policies(spark, old))).collect()
    extra = violations(validate(policies(spark, old), book)).collect()
    assert {r["rule"] for r in extra} - {r["rule"] for r in plain} == {"max_entry_age"}


def _without(book, **gone):
    """The book without the rows of a table that a condition names."""
    return RateBook.of(dict(book.tables, **{
        name: book.tables[name].where(f"not ({condition})") for name, condition in gone.items()
    }))


def test_reject_reasons(spark, book):
    overlapping = [{"from": 3, "to": 5, "amount": 1.0}, {"from": 4, "to": 6, "amount": 1.0}]
    docs = [
        dict(policy(), id="fine"),
        dict(policy(insured=person(dob="2023-07-01")), id="unborn"),
        dict(policy(id="ILP02"), id="product"),
        dict(policy(load=_load(em_load_term=0)), id="no extra"),
        dict(policy(id="ILP01"), id="small"),
        dict(policy(withdrawal_plan=overlapping), id="overlap"),
        dict(policy(insured=person(dob="1950-01-01"), maturity_option=2), id="over"),
    ]
    terms = policy_terms(policies(spark, *docs), book)
    reasons = {r["policy_id"]: r["reject_reason"] for r in terms.collect()}
    assert reasons == {
        "fine": None, "unborn": "birth date after contract date",
        "product": "unsupported product", "no extra": "no extra premium rate",
        "small": "no big-case bonus tier", "overlap": "overlapping withdrawal years",
        "over": "no policy year",
    }
    lenient = policy_terms(
        policies(spark, docs[4]), book, ProjectionOptions(small_case_bonus_zero=True)
    ).first()
    assert lenient["reject_reason"] is None and lenient["big_case_bonus"] == 0.0


def test_books_with_missing_rates_reject_policies(spark, book):
    def reason(changed):
        return policy_terms(policies(spark, policy()), changed).first()["reject_reason"]

    assert reason(_without(book, int_rate="product = 'UVL01' and scenario = 1")) == "no interest rate"
    assert reason(_without(book, modal_factor="product = 'UVL01' and mode = 4")) == "modal factors incomplete"
    assert reason(_without(book, prem_rate="product = 'UVL01'")) == "no premium rate"


def test_a_charge_of_everything_rejects_its_product_only(spark, book):
    whole = book.tables["alloc_chrg_rate"].withColumn(
        "ep_rate", F.when(F.expr("product = 'UVL01' and year = 2"), 1.0).otherwise(F.col("ep_rate")))
    strict = RateBook.of(dict(book.tables, alloc_chrg_rate=whole))
    docs = [dict(policy(), id="a"), dict(policy(id="UVL02"), id="b")]
    reasons = {r["policy_id"]: r["reject_reason"]
               for r in policy_terms(policies(spark, *docs), strict).collect()}
    assert reasons == {"a": "excess premium charge of 100%", "b": None}


@pytest.mark.parametrize("path", [
    "base.si", "base.opted_tp_term", "base.rcd", "base.insured.dob", "base.insured.gender",
    "base.load.em_load_term", "base.load.pm_load", "base.id", "base.death_tpd_option",
])
def test_missing_fields_are_rejected(spark, book, path):
    top, *inner = path.split(".")
    column = F.col(top).withField(".".join(inner), F.lit(None))
    holed = policies(spark, policy()).withColumn(top, column)
    assert policy_terms(holed, book).first()["reject_reason"] == "missing field"


def test_last_load_term_reads_the_last_rate(spark, book):
    """A load term of 100 reads term 99, and so do longer ones."""
    rates = book.tables["extra_prem_rate"].where("product = 'UVL01' and term <> 99").unionByName(
        local_table(spark, [("UVL01", 1, 29, 99, 4.25)], TABLES["extra_prem_rate"].columns))
    long_book = RateBook.of(dict(book.tables, extra_prem_rate=rates))
    docs = [dict(policy(load=_load(em_load_term=n)), id=str(n)) for n in (100, 120)]
    found = policy_terms(policies(spark, *docs), long_book).collect()
    assert [r["extra_prem_rate"] for r in found] == [4.25, 4.25]


def test_csv_fix_ups(spark, tmp_path):
    modal = tmp_path / "modal_factor.csv"
    modal.write_text("id,product,mode, rate\n1,UVL01,1,1\n2,UVL01,2,0.5\n")
    assert [tuple(r) for r in load_rate_csv(spark, "modal_factor", str(modal)).collect()] == [
        ("UVL01", 1, 1.0), ("UVL01", 2, 0.5)]
    srr = tmp_path / "srr.csv"
    srr.write_text("id,product,pol_year,rate\n1,UVL01,1,1.00\n")
    assert load_rate_csv(spark, "srr_chrg_rate", str(srr)).columns == ["product", "year", "rate"]


def test_repeated_rate_keys_are_refused(spark, book):
    twice = book.tables["lb_rate"].unionByName(book.tables["lb_rate"])
    with pytest.raises(ValueError, match="lb_rate"):
        RateBook.of(dict(book.tables, lb_rate=twice))


def test_large_tables_get_no_broadcast_hint(spark, book):
    small = book.side("lb_rate")._jdf.queryExecution().analyzed().toString()
    large = RateBook(book.tables, dict(book.rows, lb_rate=10**9)).side("lb_rate")
    assert "ResolvedHint" in small
    assert "ResolvedHint" not in large._jdf.queryExecution().analyzed().toString()


def test_rate_scan_filters_reach_parquet(spark, book, tmp_path):
    book.write_parquet(str(tmp_path / "rates"))
    stored = RateBook.from_parquet(spark, str(tmp_path / "rates"))
    assert stored.rows == book.rows
    scan = stored.scan("coi_rate", product="UVL01", gender=1).select("age", "rate")
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(product,UVL01)" in plan and "EqualTo(gender,1)" in plan


def test_local_tables_keep_their_schema(spark):
    frame = local_table(spark, [("A", 1, 2, 3.0)], TABLES["coi_rate"].columns)
    assert frame.dtypes == [("product", "string"), ("gender", "int"), ("age", "int"),
                            ("rate", "double")]


def test_ssn_rule_takes_any_person(spark):
    people = spark.createDataFrame(
        [("agent", "900000000001"), ("beneficiary", "90")], "role string, ssn string")
    found = people.select("role", wrong_ssn(F.struct("ssn")).alias("wrong")).collect()
    assert {r["role"]: r["wrong"] for r in found} == {"agent": False, "beneficiary": True}

import math
import os
import re
import subprocess
import sys

import pytest
from conftest import person, policies, policy
from pyspark.sql import Row
from pyspark.sql import functions as F

from checks.queries import portfolio, projection
from tidefold.fixtures.portfolio import PLAN_RANGES, withdrawal_plans
from tidefold.operators.lookups import DENSE
from tidefold.operators.reconcile import compare_frames, reconcile
from tidefold.plans.fixed import fixed_table
from tidefold.plans.options import ProjectionOptions
from tidefold.plans.projection import RESULT_COLUMNS, policy_inputs, project_portfolio
from tidefold.plans.terms import accepted, policy_terms
from tidefold.sources.rates import TABLES, RateBook, local_table
from tidefold.sources.sinks import write_result


@pytest.fixture(scope="module")
def results(spark, sf):
    return projection(spark, sf).cache()


def test_result_columns(results):
    assert results.columns == ["policy_id", "scenario_no", *RESULT_COLUMNS]
    assert len(RESULT_COLUMNS) == 82


def test_invariants(results):
    live = F.col("deduction_flag")
    broken = {
        "negative account": (F.col("end_eav") < 0) | (F.col("end_tav") < -1e-6),
        "split": live & (F.abs(
            F.col("deduction") - F.col("tav_deduction") - F.col("eav_deduction")) > 1e-3),
        "paid": (F.col("withdrawal") > 0) != (F.col("withdrawal_log") == "Successfully withdraw."),
        "after lapse": ~F.col("cont_flag") & (
            live | (F.col("end_pav") != 0) | (F.col("ben") != 0) | (F.col("alloc") != 0)),
        "null": F.greatest(*[F.col(c).isNull() for c in results.columns]),
    }
    counts = results.agg(*[F.count_if(c).alias(n) for n, c in broken.items()]).first().asDict()
    assert counts == dict.fromkeys(broken, 0)


def test_each_year_starts_where_the_last_ended(results):
    keys = ["policy_id", "scenario_no", "year"]
    states = ("si", "eav", "tav")
    ended = results.where("deduction_flag").select(
        *keys[:2], (F.col("year") + 1).alias("year"),
        *[F.col(f"end_{name}").alias(f"ended_{name}") for name in states],
    )
    same = F.col("cont_flag")
    for name in states:
        same = same & (F.col(f"start_{name}") == F.col(f"ended_{name}"))
    joined = results.join(ended, keys)
    assert joined.count() > 0 and joined.where(~same).count() == 0


def test_all_outcomes_and_bonuses_occur(results):
    row = list(results.agg(
        F.count_distinct("withdrawal_log"), F.count_if("lb_flag"), F.count_if("sb_flag"),
        F.count_if(F.col("lb_tav_withdrawal_review") > 0),
        F.count_if(F.col("sb_tav_withdrawal_review") > 0),
        F.count_if(F.col("cont_flag") & ~F.col("deduction_flag")),
    ).first())
    assert row[0] == 5 and all(count > 0 for count in row[1:])


def test_projection_moves_only_policies(spark, sf, results):
    """Shuffles: plan building and the spread of policies. No pairs, no windows."""
    plan = project_portfolio(
        portfolio(spark, sf), _book(spark), partitions=4
    )._jdf.queryExecution().executedPlan().toString()
    main = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line
            or "RoundRobinPartitioning" in line]
    assert sum("RoundRobinPartitioning" in line for line in main) == 1
    for operator in ("CartesianProduct", "NestedLoopJoin", "Window", "ArrowEvalPython"):
        assert operator not in plan
    assert plan.index("MapInArrow") < plan.index("RoundRobinPartitioning")


def test_result_code_is_small_enough_to_compile(spark, sf):
    """The JVM leaves methods over 8,000 bytes to the interpreter."""
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = project_portfolio(
            portfolio(spark, sf), _book(spark)
        )._jdf.queryExecution().explainString(mode)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    results_stage = re.findall(r"maxMethodCodeSize:(\d+)", text)[-1]
    assert int(results_stage) < 8000


def _book(spark):
    from checks.queries import demo_book

    return demo_book(spark)


def _project(spark, book, options=ProjectionOptions(), **changes):
    return project_portfolio(policies(spark, policy(**changes)), book, options)


def test_policy_without_plan_or_long_term(spark, book):
    rows = _project(
        spark, book, withdrawal_plan=None, maturity_option=2, insured=person(dob="1958-12-01"),
        load={"em_load": 0.0, "em_load_term": 1, "pm_load": 0, "pm_load_term": 0},
    ).where("scenario_no = 1").orderBy("year").collect()
    assert [r["year"] for r in rows] == [1, 2]
    assert all(r["withdrawal_log"] == "No withdrawal." for r in rows)


def test_options(spark, book):
    def column(name, **options):
        frame = _project(spark, book, ProjectionOptions(**options), id="UVL02")
        return [r[0] for r in frame.where("scenario_no = 2").orderBy("year").select(name).collect()]

    assert [y for y, v in enumerate(column("ep"), 1) if v > 0][-1] == 28
    assert [y for y, v in enumerate(column("ep", ep_uses_ep_term=True), 1) if v > 0][-1] == 17
    assert [y for y, v in enumerate(column("sb_rate"), 1) if v > 0] == [11, 21]
    assert [y for y, v in enumerate(column("sb_rate", sb_year_offset=1), 1) if v > 0] == [10, 20]


def test_zero_guaranteed_rate(spark, book):
    def guaranteed(**options):
        frame = _project(
            spark, book, ProjectionOptions(small_case_bonus_zero=True, **options), id="ILP01"
        )
        return frame.where("scenario_no = 13 AND year = 1").first()

    lapsed = guaranteed()
    assert math.isnan(lapsed["plan_deduction"]) and not lapsed["deduction_flag"]
    kept = guaranteed(zero_rate_annuity_one=True)
    assert kept["due_a_n1_m12"] == 1.0 and kept["deduction_flag"]


def test_hot_customer_keeps_a_bounded_plan(spark):
    """A third of all orders on one key combine before the shuffle."""
    orders = spark.range(30000).select(
        F.col("id").alias("o_orderkey"),
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") + 1000).alias("o_custkey"),
    )
    plans = withdrawal_plans(orders)
    hot = plans.where("k = 7").first()["withdrawal_plan"]
    assert len(hot) == PLAN_RANGES
    total = orders.where("o_custkey = 7").agg(F.sum(1 + F.col("o_orderkey") % 20)).first()[0]
    assert sum(w["amount"] for w in hot) == total * 1e6
    assert plans.count() == 20001


def test_written_results(results, tmp_path, spark):
    some = results.where("year <= 2")
    for kind in ("parquet", "csv"):
        write_result(some, str(tmp_path / kind), kind)
        back = spark.read.option("header", True).format(kind).load(str(tmp_path / kind))
        assert back.count() == some.count() and set(back.columns) == set(some.columns)


def test_reconcile_counts(spark):
    nan = float("nan")
    left = spark.createDataFrame([
        Row(k=1, v=1.0, s="a"), Row(k=2, v=2.0, s="b"), Row(k=3, v=None, s="c"),
        Row(k=4, v=nan, s="d"), Row(k=5, v=5.0, s=None), Row(k=6, v=6.0, s="f"),
    ], "k int, v double, s string")
    right = spark.createDataFrame([
        Row(k=1, v=1.0 + 1e-12, s="a"), Row(k=2, v=2.1, s="x"), Row(k=3, v=None, s="c"),
        Row(k=4, v=1.0, s="d"), Row(k=5, v=None, s=None), Row(k=7, v=7.0, s="g"),
    ], "k int, v double, s string")
    counts = reconcile(left, right, ["k"]).first().asDict()
    assert counts == {"matched": 5, "only_left": 1, "only_right": 1, "repeated": 0,
                      "diff_v": 3, "diff_s": 1}  # NaN is no number
    exact = reconcile(left, right, ["k"], rel_tol=0.0).first()
    assert exact["diff_v"] == 4
    assert compare_frames(left, left, ["k"]).first()["equal"]
    close = left.withColumn("v", F.col("v") + F.when(F.col("k") == 1, 1e-16).otherwise(0.0))
    assert compare_frames(left, close, ["k"]).first()["equal"]
    assert not compare_frames(left, right, ["k"]).first()["equal"]
    assert not compare_frames(left, left.drop("s"), ["k"]).first()["equal"]


def test_reconcile_never_pairs_up_repeats(spark):
    hot = spark.range(5000).select(F.lit(1).alias("k"), F.col("id").alias("v"))
    counts = reconcile(hot, hot, ["k"]).first()
    assert counts["repeated"] == 1 and counts["matched"] == 0


def test_comparison_takes_repeats_as_multisets(spark):
    def frame(*rows):
        return spark.createDataFrame(rows, "k int, v double")

    def equal(a, b):
        return compare_frames(a, b, ["k"]).first()["equal"]

    repeated = frame((1, 1.0), (1, 1.0), (1, 2.0), (2, 5.0))
    assert equal(repeated, frame((1, 2.0), (2, 5.0), (1, 1.0), (1, 1.0)))
    assert not equal(repeated, frame((1, 2.0), (2, 5.0), (1, 1.0), (1, 2.0)))
    assert not equal(repeated, frame((1, 1.0), (1, 2.0), (2, 5.0)))
    assert not equal(frame((1, 1.0)), frame((1, 1.0), (2, 1.0)))
    whole = spark.createDataFrame([(1, 5)], "k int, v int")
    assert not equal(whole, whole.withColumn("v", F.col("v").cast("double")))


def test_charges_of_far_years_change_nothing(spark, book):
    far = local_table(spark, [("UVL01", 9999, 1.0), ("UVL01", -44, 1.0)], TABLES["admin_chrg"].columns)
    wide = RateBook.of(dict(book.tables, admin_chrg=book.tables["admin_chrg"].unionByName(far)))
    plain = _project(spark, book)
    assert compare_frames(plain, _project(spark, wide), ["policy_id", "scenario_no", "year"]).first()["equal"]
    grid = fixed_table(accepted(policy_terms(policies(spark, policy()), wide)), wide)
    same = plain.where("scenario_no = 1").select(grid.columns)
    assert compare_frames(grid, same, ["policy_id", "year"]).first()["equal"]


def test_paths_carry_no_curves(spark, book):
    inputs = policy_inputs(accepted(policy_terms(policies(spark, policy()), book)))
    assert not set(DENSE) & set(inputs.columns)


def test_one_row_a_policy_goes_to_python(spark, sf, results):
    """What the workers read is one row a policy; scenarios come after them."""
    terms = accepted(policy_terms(portfolio(spark, sf), _book(spark)))
    assert policy_inputs(terms).count() == results.select("policy_id").distinct().count()
    plan = project_portfolio(portfolio(spark, sf), _book(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("inline") < plan.index("MapInArrow")


def test_rate_tables_are_read_once(spark, book, tmp_path):
    """After the curves are collected, results take them from a local relation."""
    book.write_parquet(str(tmp_path / "book"))
    stored = RateBook.from_parquet(spark, str(tmp_path / "book"))
    plan = _project(spark, stored)._jdf.queryExecution().executedPlan().toString()
    assert sum("FileScan" in line for line in plan.split("\n")) == 4  # premiums, loads, modes, interest
    assert "tp_rate" not in plan and "cal_year#" not in plan.split("MapInArrow")[1]


def test_policies_with_holes_do_not_stop_a_portfolio(spark, book):
    two = policies(spark, policy(), dict(policy(id="UVL02"), id="holed"))
    si = F.when(F.col("id") != "holed", F.col("base.si"))
    holed = two.withColumn("base", F.col("base").withField("si", si))
    assert {r[0] for r in project_portfolio(holed, book).select("policy_id").distinct().collect()} == {"p-1"}


def test_grid_is_spread_before_it_grows(spark, sf, book):
    terms = policy_terms(portfolio(spark, sf), book, partitions=7)
    assert fixed_table(accepted(terms), book).rdd.getNumPartitions() == 7


def test_package_reaches_workers_elsewhere(tmp_path):
    """A session started in another folder, whose workers do not have the package."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path[:0] = [{root!r}, {root!r} + "/tests"]
from tidefold.session import local_session, ship_package
spark = local_session("elsewhere", cores="2")
ship_package(spark)
from conftest import policies, policy
from tidefold.fixtures.rates import demo_book
from tidefold.plans.projection import project_portfolio
print("rows", project_portfolio(policies(spark, policy()), demo_book(spark)).count())
"""
    clean = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=clean, capture_output=True,
                         text=True, timeout=300)
    assert "rows 1278" in run.stdout, run.stderr[-2000:]

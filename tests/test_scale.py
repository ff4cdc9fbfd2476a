"""Work that must not grow beyond what a query needs: rows that move, sorts, passes."""

import glob

from pyspark.sql import functions as F

from checks import queries
from checks.queries import WRITTEN, demo_book, portfolio, projection
from tidefold.operators.lookups import Curves
from tidefold.operators.reconcile import compare_frames, ranked_pairs
from tidefold.plans import roll
from tidefold.plans.formulas import evaluate
from tidefold.plans.projection import policy_inputs, project_portfolio
from tidefold.plans.review import bonus_reviews, differing
from tidefold.plans.scenarios import SCENARIOS, scenario_sources
from tidefold.plans.terms import accepted, policy_terms
from tidefold.sources import sinks
from tidefold.sources.sinks import order_breaks, write_result


def test_reviews_need_only_years_with_a_withdrawal_or_a_review(spark, sf):
    results = projection(spark, sf).where("scenario_no in (1, 8)")
    terms = accepted(queries._terms(spark, sf))
    quiet = (F.col("tav_withdrawal") == 0.0) & ~F.col("lb_flag") & ~F.col("sb_flag") & (
        F.col("lb_rate") == 0.0) & (F.col("sb_rate") == 0.0)
    whole = bonus_reviews(results, terms)
    assert whole.where("withdrawn_again > 0").count() > 0
    thinned = bonus_reviews(results.where(~quiet), terms)
    assert whole.exceptAll(thinned).count() == 0 == thinned.exceptAll(whole).count()
    changed = whole.withColumn("bonus", F.when(F.col("review") == "loyalty", F.col("bonus") + 1.0).otherwise(F.col("bonus")))
    marked = differing(changed, mark="wrong")
    assert marked.count() == whole.count()
    assert marked.where("wrong").count() == differing(changed).count() == whole.where("review = 'loyalty'").count()


def test_gathered_tasks_write_their_rows_without_moving_or_sorting_them(spark, sf, tmp_path):
    made = projection(spark, sf).where("year <= 3").select(*WRITTEN, F.monotonically_increasing_id().alias("made"))
    assert made.rdd.getNumPartitions() > 2
    path = str(tmp_path / "results")
    write_result(made, path, gathered=2)
    assert len(glob.glob(f"{path}/*/part-*")) == 6
    rows = spark.read.parquet(path).selectExpr("_metadata.file_path as f", "_metadata.row_index as i", "made")
    backwards = rows.selectExpr("*", "lag(made) over (partition by f order by i) as before").where("before >= made")
    assert backwards.count() == 0 and rows.count() == made.count()
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
    write_result(made, str(tmp_path / "csv"), "csv", gathered=2, compression="gzip")
    assert len(glob.glob(f"{tmp_path}/csv/*/part-*.csv.gz")) == 6
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == made.count()


def test_whole_results_are_written_and_read_back(spark, sf, monkeypatch):
    paths = []

    def kept(result, path, *args, **options):
        paths.append(path)
        write_result(result, path, *args, **options)

    monkeypatch.setattr(queries, "write_result", kept)
    whole = set(projection(spark, sf).columns)
    back = queries.write_and_read_result(spark, sf)
    queries.write_and_read_csv(spark, sf)
    assert set(spark.read.parquet(paths[0]).columns) == whole and len(whole) == 84
    assert set(spark.read.option("header", True).csv(paths[-1]).columns) == whole
    assert whole <= set(back.columns)


def test_large_digests_are_exact(spark):
    rows = [(1, 2.5), (7, -3.004), (100, 9.2e14), (100, 9.1e14), (3, float("nan"))] * 40
    made = spark.createDataFrame(rows, "year int, v double")
    both = made.agg(queries.digest("v").alias("a"), queries.large_digest("v").alias("b")).first()
    assert both.a == both.b > 2.0**63


def test_order_comes_from_the_policies_and_breaks_are_found(spark, sf, tmp_path):
    some = project_portfolio(portfolio(spark, sf), demo_book(spark), ordered=5).where("year <= 20").select(*WRITTEN)
    n = some.count() // 3
    write_result(some, str(tmp_path / "made"), in_order=True, file_rows=700)
    write_result(projection(spark, sf).where("year <= 20").select(*WRITTEN), str(tmp_path / "sorted"), ordered=3, file_rows=700)
    for folder in ("made", "sorted"):
        found = order_breaks(spark, str(tmp_path / folder)).collect()
        assert {tuple(r) for r in found} == {(s, n, 0, 0) for s in ("High", "Low", "Guaranteed")}
    made = spark.read.parquet(str(tmp_path / "made"))
    assert made.exceptAll(spark.read.parquet(str(tmp_path / "sorted")).select(made.columns)).count() == 0
    rows = [("p1", 1, 1), ("p1", 1, 3), ("p1", 1, 2), ("p1", 1, 2), ("p0", 9, 9), ("p2", 1, 1)]
    one = spark.createDataFrame([(*r, "Low") for r in rows], "policy_id string, scenario_no int, year int, int_rate_scenario string")
    write_result(one.coalesce(1), str(tmp_path / "planted"), in_order=True)
    assert [tuple(r) for r in order_breaks(spark, str(tmp_path / "planted")).collect()] == [("Low", 6, 3, 0)]
    write_result(one.coalesce(1), str(tmp_path / "files"), in_order=True, file_rows=2)
    assert [tuple(r) for r in order_breaks(spark, str(tmp_path / "files")).collect()] == [("Low", 6, 1, 2)]


def test_order_of_rows_is_checked_without_python_unless_torn(spark, tmp_path, monkeypatch):
    sent = []
    monkeypatch.setattr(sinks, "_by_row", lambda rows, f=sinks._by_row: sent.append(1) or f(rows))

    def breaks(name, rows):
        made = spark.createDataFrame([(*r, "Low") for r in rows], "policy_id string, scenario_no int, year int, int_rate_scenario string")
        write_result(made.coalesce(1), str(tmp_path / name), in_order=True)
        return [tuple(r) for r in order_breaks(spark, str(tmp_path / name)).collect()]

    paths = [("p1", 1, y) for y in range(1, 9)] + [("p1", 2, y) for y in range(1, 5)] + [("p2", 1, 1)]
    assert breaks("whole", paths) == [("Low", 13, 0, 0)]
    assert breaks("turned", paths[8:] + paths[:8]) == [("Low", 13, 1, 0)]
    assert breaks("again", paths + paths) == [("Low", 26, 1, 0)]
    assert breaks("skipped", [("p1", 1, 1), ("p1", 1, 3), ("p1", 1, 2)]) == [("Low", 3, 1, 0)] and not sent
    torn = [("p1", 1, 1), ("p0", 5, 5), ("p1", 1, 3), ("p1", 1, 4)]
    assert breaks("torn", torn) == [("Low", 4, 1, 0)] and sent


def test_compared_rows_move_by_key_once(spark):
    left = spark.range(1000).selectExpr("id % 100 as k", "cast(id % 7 as double) as v")
    pairs = ranked_pairs(left, left.repartition(3), ["k"])
    assert pairs.agg(F.sum("rows"), F.count_if(F.col("unpaired") | F.col("differs"))).first() == (1000, 0)
    shown = pairs._jdf.queryExecution().executedPlan().toString()
    assert shown.count("Exchange hashpartitioning") == 2
    assert compare_frames(left, left, ["k"]).first()["equal"]


def test_paths_leave_the_roll_forward_when_they_lapse(spark, sf, book, monkeypatch):
    """Years after lapse are neither stepped through nor sent back."""
    inputs = policy_inputs(accepted(policy_terms(portfolio(spark, sf), book)))
    part, widths = inputs.toArrow().combine_chunks().to_batches()[0], []

    def counted(formulas, values):
        widths.append(values["start_eav"].size)
        evaluate(formulas, values)

    monkeypatch.setattr(roll, "evaluate", counted)
    columns = roll._roll_slice(part, Curves(book), scenario_sources())
    lived = columns[-len(roll.STATE_COLUMNS) - 2].values.to_numpy()
    assert 0 < lived.sum() < len(SCENARIOS) * part.column("term").to_numpy().sum()
    assert sum(widths) == 2 * lived.sum()
    assert all(len(column.values) == lived.sum() for column in columns[-len(roll.STATE_COLUMNS):])

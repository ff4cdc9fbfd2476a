"""Files in and out: rejected documents and rate rows, file counts, repeated runs, order, comparison."""

import glob
import json
import re

from conftest import documents, person, policies, policy
from pyspark.sql import functions as F

from checks.queries import _csv_book, projection
from tidefold.operators.lookups import with_grid_rates
from tidefold.operators.reconcile import compare_frames, ranked_pairs, reconcile
from tidefold.plans.fixed import fixed_init
from tidefold.plans.projection import project_portfolio
from tidefold.plans.review import bonus_reviews, differing
from tidefold.plans.terms import accepted, policy_terms, rejects
from tidefold.sources.policies import load_policies, loaded, rejected, unreadable
from tidefold.sources.rates import ANY_PRODUCT, RateBook
from tidefold.sources.sinks import write_result


def test_documents_go_to_two_tables(spark, tmp_path):
    docs = [policy(), dict(policy(), id="p-2"), {**policy(paymode="Weekly"), "id": "p-3"}]
    missing = {k: v for k, v in policy().items() if k != "created_date"}
    lines = "\n".join(map(json.dumps, [*docs, missing])) + '\n{"id": "cut off'
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "a.json").write_text(lines)
    (tmp_path / "several").mkdir()
    (tmp_path / "several" / "list.json").write_text(json.dumps([*docs, missing], indent=1))
    (tmp_path / "several" / "cut.json").write_text('{"id":\n"cut off')
    for layout in ("lines", "several"):
        target = str(tmp_path / f"{layout}-out")
        load_policies(spark, str(tmp_path / layout), target, multi_line=layout == "several")
        assert {r.id for r in loaded(spark, target).collect()} == {"p-1", "p-2"}
        bad = {r.read_error: r for r in rejected(spark, target).collect()}
        assert set(bad) == {"unknown code", "missing field", "malformed document"}
        assert bad["unknown code"].id == "p-3" and "Weekly" in bad["unknown code"].document
        assert "cut off" in bad["malformed document"].document
        assert project_portfolio(loaded(spark, target), _demo(spark)).count() == 2 * 1278
    texts = unreadable(documents(spark, *docs, "{")).collect()
    assert {r.read_error for r in texts} == {"unknown code", "malformed document"} and all(r.document for r in texts)


def _demo(spark):
    from checks.queries import demo_book

    return demo_book(spark)


def test_bad_rate_rows_reject_their_product(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("checks.queries.new_shared_path", lambda _, name: str(tmp_path / name))
    _csv_book(spark)
    (file,) = glob.glob(str(tmp_path / "rate-csv" / "ul_coi_rate.csv" / "part-*.csv"))
    text = open(file).read().split("\n")
    place = next(i for i, line in enumerate(text) if "UVL02" in line)
    cells = text[place].split(",")
    text[place] = ",".join([*cells[:-1], "not a number"])
    (tmp_path / "coi.csv").write_text("\n".join(text))
    book = RateBook.from_csv(spark, str(tmp_path / "rate-csv"), {"coi_rate": str(tmp_path / "coi.csv")},
                             rejects=str(tmp_path / "bad"))
    bad = spark.read.parquet(str(tmp_path / "bad" / "unread")).collect()
    assert [(r.name, r.product) for r in bad] == [("coi_rate", "UVL02")] and "not a number" in bad[0].text
    assert book.unread == ("UVL02",) and book.rows["coi_rate"] == _demo(spark).rows["coi_rate"] - 1
    two = policies(spark, policy(), {**policy(id="UVL02"), "id": "p-2"})
    terms = policy_terms(two, book)
    assert [tuple(r) for r in rejects(terms).collect()] == [("p-2", "unreadable rate row")]
    everything = RateBook(book.tables, book.rows, unread=(ANY_PRODUCT,))
    assert rejects(policy_terms(two, everything)).count() == 2


def test_every_reason_is_given(spark, book):
    plan = [{"from": 3, "to": 6, "amount": 1.0}, {"from": 6, "to": 8, "amount": 1.0}]
    flawed = {
        "missing field": policy(), "birth date after contract date": policy(insured=person(dob="2024-01-01")),
        "unsupported product": policy(id="ILP02"),
        "no policy year": policy(maturity_option=2, insured=person(dob="1950-01-01")),
        "no premium rate": policy(insured=person(dob="1953-01-01")),
        "no big-case bonus tier": policy(id="ILP01"),
        "no extra premium rate": policy(load={"em_load": 0.5, "em_load_term": 0, "pm_load": 3, "pm_load_term": 9}),
        "overlapping withdrawal years": policy(withdrawal_plan=plan),
    }
    frame = policies(spark, *[{**doc, "id": reason} for reason, doc in flawed.items()])
    si = F.when(F.col("id") != "missing field", F.col("base.si"))
    holed = frame.withColumn("base", F.col("base").withField("si", si))
    found = {r.policy_id: r.reject_reason for r in rejects(policy_terms(holed, book)).collect()}
    assert found == {reason: reason for reason in flawed}
    charged = RateBook.of(dict(book.tables, alloc_chrg_rate=book.tables["alloc_chrg_rate"].withColumn("ep_rate", F.lit(1.0))))
    short = RateBook(dict(book.tables, modal_factor=book.tables["modal_factor"].where("mode > 1")), book.rows)
    rateless = RateBook(dict(book.tables, int_rate=book.tables["int_rate"].where("scenario > 0")), book.rows)
    for broken, reason in ((charged, "excess premium charge of 100%"), (short, "modal factors incomplete"),
                           (rateless, "no interest rate")):
        assert [r.reject_reason for r in rejects(policy_terms(policies(spark, policy()), broken)).collect()] == [reason]


def test_rates_by_product_are_pruned(spark, book, tmp_path):
    book.write_parquet(str(tmp_path / "rates"), by_product=True)
    stored = RateBook.from_parquet(spark, str(tmp_path / "rates"))
    one = stored.scan("coi_rate", product="UVL02", gender=1)
    text = one._jdf.queryExecution().executedPlan().toString()
    (filters,) = re.findall(r"rs: \[([^]]*)\], PushedFilters", text)
    assert "UVL02" in filters and "gender" not in filters and one.count() == 100
    assert stored.rows == book.rows
    grid = fixed_init(accepted(policy_terms(policies(spark, policy(id="UVL03")), book)))
    assert compare_frames(with_grid_rates(grid, book), with_grid_rates(grid, stored), ["policy_id", "year"]).first()["equal"]


def test_gathered_results_are_few_files_and_runs_repeat(spark, sf, tmp_path):
    some = projection(spark, sf).where("year <= 3").repartition(40)
    path = str(tmp_path / "results")
    write_result(some, path, gathered=True)
    assert len(glob.glob(f"{path}/*/part-*")) == 3
    before = spark.read.parquet(path).count()
    for _ in range(2):
        write_result(some.where("int_rate_scenario = 'High'"), path, mode="replace", gathered=True)
    assert len(glob.glob(f"{path}/*/part-*")) == 3 and spark.read.parquet(path).count() == before == some.count()
    write_result(some, str(tmp_path / "small"), file_rows=500)
    assert spark.read.parquet(str(tmp_path / "small")).groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] <= 500


def test_repeated_keys_compare_within_the_tolerance(spark):
    def frame(*rows):
        return spark.createDataFrame(rows, "k int, s string, v double")

    def pairs(a, b, **options):
        return sorted((r.k, r.rows, r.unpaired, r.differs) for r in ranked_pairs(a, b, ["k"], **options).collect())

    left = frame((1, "a", 1.0), (1, "a", 1.0), (1, "a", 2.0), (1, "b", 5.0), (2, "x", None))
    near = frame((1, "b", 5.0), (1, "a", 2.0), (1, "a", 1.0 + 1e-13), (1, "a", 1.0), (2, "x", None))
    assert not any(u or d for _, _, u, d in pairs(left, near))
    assert any(d for *_, d in pairs(left, near, rel_tol=0.0, abs_tol=0.0))
    assert compare_frames(left, frame((1, "a", 1.0 + 1e-16), *left.collect()[1:]), ["k"]).first()["equal"]
    fewer = frame((1, "a", 1.0), (1, "a", 2.0), (1, "b", 5.0), (2, "x", None))
    assert sum(n for _, n, u, _ in pairs(left, fewer) if u) == 1
    other = frame((1, "a", 1.0), (1, "a", 1.0), (1, "a", 2.5), (1, "b", 5.0), (2, "x", 0.0))
    assert sum(n for _, n, _, d in pairs(left, other) if d) == 2
    hot = spark.range(100_000).select(F.lit(1).alias("k"), F.lit(0.5).alias("v"))
    assert pairs(hot, hot.withColumn("v", F.lit(0.5 + 1e-14))) == [(1, 100_000, False, False)]


def test_nan_passes_only_in_the_plain_comparison(spark):
    nan, inf = float("nan"), float("inf")
    left = spark.createDataFrame([(1, nan), (2, nan), (3, inf), (4, 1.0)], "k int, v double")
    right = spark.createDataFrame([(1, nan), (2, 1.0), (3, inf), (4, inf)], "k int, v double")
    assert reconcile(left, right, ["k"]).first()["diff_v"] == 2
    assert compare_frames(left.where("k < 4"), right.where("k < 4"), ["k"]).first()["equal"]
    assert not compare_frames(left, right, ["k"]).first()["equal"]


def test_a_planted_review_is_found(spark, sf):
    from checks.queries import _terms

    results = projection(spark, sf).where("scenario_no = 1")
    terms = accepted(_terms(spark, sf))
    reviews = bonus_reviews(results, terms)
    assert reviews.where("passed").count() > 0 and reviews.where("withdrawn > 0").count() > 0
    assert differing(reviews).count() == 0
    review = reviews.where("passed and review = 'loyalty'").select("policy_id", "year").first()
    here = (F.col("policy_id") == review.policy_id) & (F.col("year") == review.year)
    for column, value in (("lb_flag", False), ("lb", 1.0), ("lb_tav_withdrawal_review", 5.0)):
        planted = results.withColumn(column, F.when(here, F.lit(value)).otherwise(F.col(column)))
        found = differing(bonus_reviews(planted, terms)).collect()
        assert [(r.policy_id, r.year, r.review) for r in found] == [(review.policy_id, review.year, "loyalty")]

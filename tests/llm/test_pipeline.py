"""The corpus pipeline, stage by stage."""

import collections

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tidefold.llm.common import stored


@pytest.fixture(scope="module")
def stages(spark, sf):
    """Rows before and after each stage."""
    docs, found = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, docs, sf), name)
        found[name] = (docs, after)
        docs = after
    return found


def test_stages_in_order(stages):
    assert list(stages) == ["quality", "line_dedup", "near_dedup", "mixing", "packing"]
    for name, (before, after) in stages.items():
        if name != "packing":
            assert after.columns == before.columns


def test_filters_keep_good_documents(stages, spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    before, after = stages["quality"]
    good = before.join(labels.where("quality = 1"), "doc_id")
    kept = good.join(after, "doc_id", "left_semi").count()
    assert kept >= 0.97 * good.count() and after.count() < before.count()


def test_near_duplicates_leave_one_of_a_group(stages):
    from test_operators import brute_components

    before, after = stages["near_dedup"]
    groups = brute_components({r.doc_id: r.text for r in before.collect()}, 5, 80)
    assert {r.doc_id for r in after.collect()} == {i for i, (_, g) in groups.items() if i == g}


def test_packing_holds_all_mixed_documents(stages):
    before, after = stages["packing"]
    assert after.where("start = 0").count() == before.count()


def test_whole_run(spark, sf, stages):
    assert corpus_pipeline.run(spark, sf).count() == stages["packing"][1].count()


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
ODD = [
    (1, "a b c d e f g h", "en", "s1", 15), (1, "a b c d e f g h", "en", "s1", 15), (1, "a b c d e f g h", "de", None, 15),
    (2, None, None, None, None), (2, None, None, None, None), (3, "", "en", "s1", 0), (4, " \t\n ", "en", "s2", 4),
    (5, LONG, "en", "s2", len(LONG)), (6, LONG + " end", None, "s2", None),
    (None, "no id at all here", "en", None, 17), (7, "A B C D E F G H", "de", "s1", 15),
]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, sf, name, stage):
    """Nulls, empty, blank and long texts, repeated rows and clashing names; then no rows at all."""
    odd = spark.createDataFrame(ODD, SCHEMA).withColumns({"size": F.lit("clash"), "kept": F.lit(1), "shard": F.lit(2)})
    rows = stage(spark, odd, sf).collect()
    if name != "packing":
        assert [f for f in rows[0].__fields__] == list(corpus_pipeline.COLUMNS)
    if name == "packing":
        assert sum(r.start == 0 for r in rows) == len(ODD)
    if name == "near_dedup":
        left = collections.Counter((r.doc_id, r.text) for r in rows)
        assert left == {(i, t): 1 for i, t, *_ in ODD if i not in (6, 7)}
    assert stage(spark, spark.createDataFrame([], SCHEMA), sf).count() == 0

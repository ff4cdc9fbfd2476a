"""The Jaccard join against brute force, and on awkward input."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import LONG, brute_components

from tidefold.llm import jaccard_join


def found_in(docs, **options):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_join(docs, **options).collect()}


@pytest.mark.parametrize("tile", [1, 32 << 20])
def test_equals_brute_force(spark, sf, tile, monkeypatch):
    if tile == 1:  # tiles of several blocks: meetings and grids
        monkeypatch.setattr(jaccard_join, "TILE_BYTES", 1)
        monkeypatch.setattr(jaccard_join, "LEAST_TILE", 3)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert found_in(docs) == brute_components(texts, 3, 90)


@pytest.mark.parametrize("least", [4, 64])
def test_copies_with_changed_words(spark, least, monkeypatch):
    """Groups of copies around the threshold, sizes around the edges of bands, a passage in all."""
    monkeypatch.setattr(jaccard_join, "LEAST_TILE", least)
    if least < 64:
        monkeypatch.setattr(jaccard_join, "TILE_BYTES", 1)
    random, texts = np.random.default_rng(6), {}
    passage = [f"common{i}" for i in range(40)]
    for group, n in enumerate([9, 10, 11, 14, 20, 31, 33, 60, 64, 66, 70, 128, 140, 250, 270]):
        base = [f"g{group}w{i}" for i in range(n)]
        for _ in range(14):
            words = list(base)
            for i in random.integers(0, n, random.integers(0, max(2, n // 22))):
                words[i] = f"x{random.integers(0, 10**6)}"
            words = words[random.integers(0, max(1, n // 16)):]
            texts[len(texts)] = " ".join(passage + words if random.random() < 0.3 else words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    expected = brute_components(texts, 3, 90)
    assert 30 < len({c for _, c in expected.values()}) < len(texts) - 30
    assert found_in(docs) == expected


def test_bitmaps_bound_the_overlap():
    random = np.random.default_rng(8)
    for _ in range(300):
        n = int(random.integers(1, 300))
        a = np.unique(random.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.append(a[random.random(len(a)) > random.choice([0.02, 0.1, 0.5])],
                                random.integers(0, 1 << 63, int(random.integers(0, 20))).astype(np.uint64)))
        if not len(b):
            continue
        band = max(len(a), len(b)).bit_length() - 1
        bits = jaccard_join.bitmaps([a, b], band)
        differ = int(np.bitwise_count(bits[0] ^ bits[1]).sum())
        assert differ <= len(np.setxor1d(a, b))
        fits = jaccard_join.possible(np.array([len(b)]), len(a), bits[1:], bits[0], 90)[0] >= 0
        assert fits or not jaccard_join.similar(a, b, 90)
        wide = jaccard_join.bitmaps([a], band + 1)[0]
        assert (jaccard_join._widened(wide, band) == bits[0]).all()


def test_odd_rows(spark):
    rows = [
        (1, "a b c d"), (1, "a b c d"), (1, "other words of one id"), (2, None), (3, ""), (4, " \t\n "), (5, LONG),
        (6, LONG + " end"), (None, "A b C d"), (7, "x"), (8, "X"), (9, "x y"), (None, "only null ids here"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn(
        "cls", F.lit(1))
    found = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_join(docs).collect()), key=str)
    n = len({tuple(LONG.split()[i : i + 3]) for i in range(29_998)})
    assert found == sorted([
        (1, 2, 1), (1, 2, 1), (1, 3, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (5, n, 5), (6, n + 1, 5), (None, 2, 1),
        (7, 1, 7), (8, 1, 7), (9, 1, 9), (None, 2, None),
    ], key=str)
    assert jaccard_join.jaccard_join(docs.limit(0)).count() == 0

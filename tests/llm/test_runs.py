"""Periodic runs against brute force, and on awkward input."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidefold.llm import runs


def brute_runs(words):
    """(start, length, smallest period) of all runs, by comparing the words with themselves."""
    ids = np.unique(np.array(words, object), return_inverse=True)[1] if words else np.empty(0, int)
    found = []
    for q in range(1, len(ids) // 4 + 1):
        edges = np.concatenate([[-1], np.flatnonzero(ids[:-q] != ids[q:]), [len(ids) - q]])
        for a, b in zip((edges[:-1] + 1).tolist(), (edges[1:] + q).tolist()):
            inside = any(q % d == 0 and s <= a and b <= s + n for s, n, d in found)
            if b - a >= max(6, 4 * q) and not inside:
                found.append((a, b - a, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text, planted):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if planted and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    top = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    left = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(found), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left).hexdigest())


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    expected = [brute_row(r.doc_id, r.text, True) for r in docs.collect()]
    assert sum(e[1] for e in expected) > 5
    assert rows_of(runs.QUERIES["op12_runs"](spark, sf)) == sorted(expected, key=str)


@pytest.mark.parametrize("trials", [5, 1 << 21])
def test_random_words(trials, monkeypatch):
    monkeypatch.setattr(runs, "TRIALS", trials)
    random = np.random.default_rng(4)
    for _ in range(300):
        docs = []
        for _ in range(random.integers(1, 5)):
            ids = random.integers(0, random.integers(1, 5), random.integers(0, 70))
            if len(ids) and random.random() < 0.7:
                a = random.integers(0, len(ids))
                ids[a:] = np.resize(ids[a : a + random.integers(1, 10)], len(ids) - a)
            docs.append(ids)
        ends = np.cumsum([len(d) for d in docs])
        start, end, period = runs.runs_of(np.concatenate(docs).astype(np.int64), ends)
        found = list(zip(start.tolist(), (end - start).tolist(), period.tolist()))
        assert found == [(s + stop - len(d), m, q) for d, stop in zip(docs, ends.tolist()) for s, m, q in brute_runs(d.tolist())]


def test_rules_derive_the_texts():
    random = np.random.default_rng(2)
    ids, ends = random.integers(0, 4, 500), np.array([0, 200, 200, 499, 500])
    rules, left = runs.re_pair(ids, ends)
    assert len(left) < 250
    for rule in np.unique(rules.rule):
        places = np.flatnonzero(rules.rule == rule)
        assert len({tuple(ids[rules.start[i] : rules.end[i]]) for i in places}) == 1
    top = runs.balanced(left, ends, 10_000)
    assert {(0, 200), (200, 499)} <= set(zip(top.start.tolist(), top.end.tolist()))


def test_odd_rows(spark):
    long = " ".join(["ab"] * 50_000 + [f"w{i}" for i in range(20_000)])
    rows = [(1, "a b " * 5), (1, "a b " * 5), (2, None), (3, ""), (4, " \t\n"), (None, "x x x x x x"), (5, "x " * 5),
            (6, "A a A a A a A a"), (7, "           ")]
    docs = spark.createDataFrame([*rows, (8, long)], "doc_id long, text string").withColumn("period", F.lit("clash"))
    for planted in (False, True):
        assert rows_of(runs.periodic_runs(docs.where("doc_id <> 8 or doc_id is null"), planted)) == sorted(
            (brute_row(i, t, planted) for i, t in rows), key=str)
    one = runs.periodic_runs(docs.where("doc_id = 8")).first()
    assert (one.n_runs, one.start, one.length, one.period) == (1, 0, 50_000, 1)
    assert runs.periodic_runs(docs.limit(0)).count() == 0

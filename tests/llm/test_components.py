"""Components of edges, by tasks that join their own edges and by star steps."""

import numpy as np
import pytest

from tidefold.llm import common


def brute_components(edges):
    low = {n: n for e in edges for n in e}
    while True:
        before = dict(low)
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
        if low == before:
            return low


def found_in(spark, edges, parts):
    frame = spark.createDataFrame(edges, "a long, b long").repartition(parts)
    return {r.node: r.component for r in common.components(frame).collect()}


@pytest.mark.parametrize("most", [3, 1 << 16])
def test_components_equal_brute_force(spark, most, monkeypatch):
    """Paths, a hub, repeated edges, loops and negative ids; also with star steps only."""
    monkeypatch.setattr(common, "MOST_EDGES", most)
    random = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in random.integers(-60, 60, (55, 2))]
    edges += [(i, i + 1) for i in range(100, 130)] + [(500, i) for i in range(501, 540)] + [(7, 7), (200, 200)]
    edges += edges[:20]
    expected = brute_components([(a, b) for a, b in edges if a != b])
    assert found_in(spark, edges, 5) == expected
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_few_tables_for_a_long_path(spark, monkeypatch):
    """A path took a table for each halving of it, each by six shuffles."""
    made, stored = [], common.stored
    monkeypatch.setattr(common, "stored", lambda frame, name: made.append(name) or stored(frame, name))
    order = np.random.default_rng(4).permutation(2_000).tolist()
    assert set(found_in(spark, list(zip(order, order[1:])), 7).values()) == {0}
    assert len(made) <= 3

"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.session import new_shared_path

#: A word of every contract here: no space and none of \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
#: Words that a task remembers before it starts anew; bounds its memory.
MAX_REMEMBERED = 150_000
#: Edges that a task joins at a time.
MOST_EDGES = 1 << 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder; cuts lineage and survives lost executors."""
    path = new_shared_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def words(text: str) -> list[bytes]:
    """Words of a text with A-Z lower-cased; ``bytes`` methods know ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower().split()


class Remembered(dict):
    """A bounded memory of a function of a word."""

    def __init__(self, function):
        super().__init__()
        self.function = function

    def __missing__(self, key):
        value = self[key] = self.function(key)
        return value

    def trim(self):
        if len(self) > MAX_REMEMBERED:
            self.clear()


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (the one of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    """Odd multipliers drawn from a seed."""
    start = np.uint64(seed) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mixed(start) | np.uint64(1)


def word_hashes(texts: Iterable[str], memory: Remembered) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in one array, and the number of words of each text."""
    split = [words(t or "") for t in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    flat = np.fromiter(
        map(memory.__getitem__, chain.from_iterable(split)), np.uint64, int(counts.sum())
    )
    memory.trim()
    return flat, counts


def word_memory() -> Remembered:
    return Remembered(xxhash.xxh3_64_intdigest)


def shingle_sets(texts: list[str], width: int, memory: Remembered) -> list[np.ndarray]:
    """Sorted distinct hashes of the word shingles of each text.

    A text of fewer words than ``width`` has its whole sequence as one shingle; one
    without words has none.
    """
    flat, counts = word_hashes(texts, memory)
    factors = odd_numbers(width, 17)
    ends = np.cumsum(counts)
    if len(flat) >= width:
        windows = np.zeros(len(flat) - width + 1, np.uint64)
        for i in range(width):
            windows += flat[i : len(flat) - width + 1 + i] * factors[i]
        windows = mixed(windows)
    sets = []
    for end, n in zip(ends.tolist(), counts.tolist()):
        if n >= width:
            sets.append(np.unique(windows[end - n : end - width + 1]))
        elif n:
            short = (flat[end - n : end] * factors[:n]).sum(dtype=np.uint64) + np.uint64(n)
            sets.append(mixed(np.array([short], np.uint64)))
        else:
            sets.append(np.empty(0, np.uint64))
    return sets


def chunks_of(batch: pa.RecordBatch, column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with some ``most`` bytes of text each, so that memory is bounded."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    ends = np.cumsum(lengths.to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def key_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of consecutive rows with equal (non-null) integer keys.

    The partition has to be sorted by the keys; a group may span batches.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for values in columns:
            change |= values[1:] != values[:-1]
        starts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(starts[:-1], starts[1:]):
            key = tuple(values[a] for values in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def binary(arrays: Iterable[np.ndarray]) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())


def smallest_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (``a``, ``b``) and the smallest node that each of them reaches."""
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.split(places, 2)
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        low = label.copy()
        for ends in (x, y, label[x], label[y]):
            np.minimum.at(low, ends, least)
        low = low[low]
        if (low == label).all():
            return nodes, nodes[label]
        label = low


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges that join what ``edges`` joins: of some ``MOST_EDGES`` rows of a task at a time, as stars."""
    schema, most = pa.schema([("a", pa.int64()), ("b", pa.int64())]), MOST_EDGES

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        nodes, low = smallest_reached(rows.column("a").to_numpy(), rows.column("b").to_numpy())
        return pa.record_batch([pa.array(x[nodes != low]) for x in (nodes, low)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= most:
                yield stars(held)
                held, rows = [], 0
        if rows:
            yield stars(held)

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """A large-star or small-star step; ``b`` of the result is smaller than ``a``."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
    joined = both.join(low, "a")
    if large:
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return joined.select(F.explode(F.array("a", "b")).alias("a"), F.col("low").alias("b")).where(
        "a <> b").distinct()


def _is_forest(edges: DataFrame) -> bool:
    """Whether each node has one edge up or edges down only (``b`` smaller than ``a``)."""
    ends = edges.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("b").alias("a"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not nodes.where("up > 1 or (up = 1 and down = 1)").agg(F.count("*")).first()[0]


def forest(edges: DataFrame, name: str = "components") -> DataFrame:
    """``a``, each node but the smallest of its component, and ``b``, that smallest node.

    Tasks first join their own edges, ``MOST_EDGES`` at a time. Where that shortens the table no
    more, large-star and small-star steps (Kiveris et al., 2014) follow on tables: no node's
    neighbours are gathered, a hub is a sum of partial minima. Only totals come to the driver.
    """
    current = stored(_contracted(edges.where("a <> b")), name)
    rows = current.count()
    while not _is_forest(current):
        before = rows
        current = stored(_contracted(current.coalesce(rows // MOST_EDGES + 1)), name)
        rows = current.count()
        if 10 * rows > 9 * before and not _is_forest(current):
            current = stored(_star(_star(current, True), False), name)
            rows = current.count()
    return current


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node`` and the smallest node it can reach, from undirected edges (``a``, ``b``)."""
    rooted = forest(edges, name).select(F.col("a").alias("node"), F.col("b").alias("component"))
    return rooted.unionByName(rooted.select(F.col("component").alias("node"), "component").distinct())

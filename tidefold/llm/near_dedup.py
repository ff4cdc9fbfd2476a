"""Near-duplicate documents: bottom-k MinHash, inverted lists, union sketches, exact Jaccard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.llm.common import (
    binary, chunks_of, forest, key_groups, mixed, shingle_sets, stored, table, word_memory,
)

#: Words of a shingle and least similarity in percent, where nothing else is asked for.
WIDTH = 5
PERCENT = 80
#: Retained values of a sketch. At a similarity of 0.8 two sketches share fewer than
#: ``SHARED`` of them with a chance of about 1e-8 (binomial, 64 draws).
RETAINED = 64
SHARED = 32
#: Documents of a candidate group that one step holds at a time.
BLOCK = 256


def _sketches(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id``, set size ``n``, 128-bit set digest and bottom-k ``sketch`` of each row."""
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()),
        ("sketch", pa.list_(pa.int64())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = word_memory()
        for batch in batches:
            for part in chunks_of(batch, "text"):
                sets = shingle_sets(part.column("text").to_pylist(), width, memory)
                n = np.array([len(s) for s in sets], np.int64)
                d1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                d2 = np.array([mixed(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                kept = [s[:RETAINED].view(np.int64) for s in sets]
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in kept])]).astype(np.int32)
                values = np.concatenate(kept) if kept else np.empty(0, np.int64)
                yield pa.record_batch([
                    part.column("doc_id"), pa.array(n), pa.array(d1), pa.array(d2),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int64())),
                ], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n long, d1 long, d2 long, sketch array<long>"
    )


def _lists(classes: DataFrame, percent: int) -> DataFrame:
    """Inverted lists (``value``, ``rep``, ``n``) of the rarest retained values.

    Two sketches of similar sets share at least ``SHARED`` values (of a whole small set:
    its ``percent``), so one of them is among all but the last ``SHARED`` - 1 values in
    any common order. In order of rarity, common passages come last and make no lists,
    unless they are most of a document; a value of one document alone makes none either.
    """
    rows = classes.select("rep", "n", F.explode("sketch").alias("value"))
    frequent = rows.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    small = RETAINED * percent // 100
    shared = F.when(F.col("n") <= small, F.ceil(F.col("n") * percent / 100)).otherwise(SHARED)
    prefix = F.least(F.col("n"), F.lit(RETAINED)) - shared + 1
    alone = F.least(F.col("n"), F.lit(RETAINED)) - F.size("found")
    return (
        rows.join(frequent, "value").groupBy("rep", "n")
        .agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("found"))
        .select("rep", "n", F.explode(
            F.slice("found", F.lit(1), F.greatest(F.lit(0), prefix - alone).cast("int"))
        ).alias("kept"))
        .select(F.col("kept.value").alias("value"), "rep", "n")
    )


def _whole_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """Adds the full shingle ``set`` (sorted 64-bit hashes) to the rows of ``wanted``."""
    texts = docs.select("doc_id", "text").join(wanted.hint("shuffle_hash"), "doc_id")
    keys = [c for c in wanted.columns if c != "doc_id"]
    schema = pa.schema([("rep", pa.int64()), *((k, pa.int64()) for k in keys), ("set", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = word_memory()
        for batch in batches:
            for part in chunks_of(batch, "text"):
                sets = shingle_sets(part.column("text").to_pylist(), width, memory)
                yield pa.record_batch(
                    [part.column("doc_id"), *(part.column(k) for k in keys), binary(sets)],
                    schema=schema,
                )

    return texts.select("doc_id", *keys, "text").mapInArrow(
        run, ", ".join(["rep long", *(f"{k} long" for k in keys), "set binary"])
    )


def union_estimates(sketch: np.ndarray, others: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Similarity of one sketch to each row of ``others`` by the bottom-k of their union.

    Rows are sorted and filled up with the largest value; ``sizes`` are their lengths.
    The estimate is exact where both sketches hold their whole sets.
    """
    k = others.shape[1]
    place = np.searchsorted(sketch, others)
    inside = np.arange(k) < sizes[:, None]
    found = inside & (sketch[np.minimum(place, len(sketch) - 1)] == others)
    before = np.cumsum(found, axis=1) - found
    rank = np.arange(k) + place - before  # in the union
    union = np.minimum(len(sketch) + sizes - found.sum(axis=1), RETAINED)
    return (found & (rank < union[:, None])).sum(axis=1) / np.maximum(union, 1)


def least_estimate(percent: int) -> float:
    """Six standard deviations below the similarity asked for."""
    p = percent / 100
    return p - 6 * (p * (1 - p) / RETAINED) ** 0.5


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def links_of_block(ids: np.ndarray, sets: list[np.ndarray], percent: int,
                   label: np.ndarray | None = None, asking: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Verified links that join the similar documents of a block.

    Candidates share a retained value. ``label`` tells documents that are joined already;
    a pair of those needs no comparison. With ``asking``, only these documents are
    compared, with those not asking; else all with each other.
    """
    n = len(sets)
    filled = np.full((n, RETAINED), np.iinfo(np.uint64).max, np.uint64)
    lengths = np.array([min(len(s), RETAINED) for s in sets])
    for row, s in zip(filled, sets):
        row[: min(len(s), RETAINED)] = s[:RETAINED]
    full = np.array([len(s) for s in sets])
    label = np.arange(n) if label is None else np.unique(label, return_inverse=True)[1]
    least, links = least_estimate(percent), []
    for i in range(n) if asking is None else np.flatnonzero(asking).tolist():
        near = label != label[i]
        if asking is None:
            near[i:] = False
        else:
            near &= ~asking
        near &= (100 * full >= percent * full[i]) & (100 * full[i] >= percent * full)
        near = np.flatnonzero(near)
        if not len(near):
            continue
        guess = union_estimates(filled[i, : lengths[i]], filled[near], lengths[near])
        order = near[np.argsort(-guess, kind="stable")][: int((guess >= least).sum())]
        for j in order.tolist():
            if label[j] != label[i] and linked(sets[i], sets[j], percent):
                links.append((int(ids[i]), int(ids[j])))
                label[label == label[i]] = label[j]
    return links


def _set_of(value) -> np.ndarray:
    return np.frombuffer(value.as_py(), np.uint64)


def _links_in_groups(grouped: DataFrame, percent: int, keys: list[str]) -> DataFrame:
    """Links of each group of rows with equal ``keys``; ``component`` and ``asking`` as in
    ``links_of_block``, where the rows have them."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    names = grouped.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int]] = []
        for group in key_groups(batches, keys):
            if group.num_rows > 1:
                held += links_of_block(
                    group.column("rep").to_numpy(), [_set_of(v) for v in group.column("set")], percent,
                    group.column("component").to_numpy() if "component" in names else None,
                    group.column("asking").to_numpy() if "asking" in names else None,
                )
            if len(held) > 10_000:
                yield _pairs(held, schema)
                held = []
        if held:
            yield _pairs(held, schema)

    return grouped.repartition(*keys).sortWithinPartitions(*keys, "rep").mapInArrow(run, "a long, b long")


def _pairs(rows: list[tuple[int, int]], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)


def _filtered(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs (``a``, ``b``) whose union sketches leave the similarity possible."""
    side = sketches.select("rep", "sketch")
    joined = pairs.join(side.withColumnsRenamed({"rep": "a", "sketch": "sa"}), "a").join(
        side.withColumnsRenamed({"rep": "b", "sketch": "sb"}), "b"
    )
    least = least_estimate(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                x = np.asarray(x.values).view(np.uint64)
                y = np.asarray(y.values).view(np.uint64)
                guess = union_estimates(x, y[None, :], np.array([len(y)]))[0]
                keep.append(guess >= least)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    joined = pairs.join(sets.withColumnsRenamed({"rep": "a", "set": "sa"}), "a").join(
        sets.withColumnsRenamed({"rep": "b", "set": "sb"}), "b"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [linked(_set_of(x), _set_of(y), percent)
                    for x, y in zip(batch.column("sa"), batch.column("sb"))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _labelled(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Adds each document's component so far."""
    return rows.join(found.select(F.col("a").alias("rep"), F.col("b").alias("component")), "rep", "left").withColumn(
        "component", F.coalesce("component", "rep"))


def _block_of(blocks) -> F.Column:
    return F.pmod(F.xxhash64("rep"), F.greatest(blocks, F.lit(1)).cast("long"))


def _numbers_below(n) -> F.Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1))


def _join_large_groups(large: DataFrame, sets: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """The forest ``found``, joined further so that all documents of groups of several blocks are compared.

    Blocks of one group are components by themselves at first. Delegates of each
    component (some 16, by hash) meet in new blocks as long as that joins any. What
    then lies outside a group's largest component is compared with all of the group, in a
    grid of blocks; documents that are joined already are not compared.
    """
    again = True
    while again:
        labelled = stored(_labelled(large, found), "labelled")
        sizes = labelled.groupBy("lead", "component").agg(F.count("*").alias("m"))
        delegates = labelled.join(sizes, ["lead", "component"]).where(
            F.pmod(F.xxhash64("rep", F.lit(1)), F.greatest(F.floor(F.col("m") / 16), F.lit(1))) == 0)
        counts = delegates.groupBy("lead").agg(
            F.count("*").alias("size"), F.count_distinct("component").alias("k")).where("k > 1")
        met = stored(delegates.join(counts, "lead").select(
            "rep", "lead", "component", _block_of(F.ceil(F.col("size") / BLOCK)).alias("block")), "met")
        last = met.agg(F.max("block")).first()[0]
        if last is None:
            break
        more = stored(_links_in_groups(met.join(sets, "rep"), percent, ["lead", "block"]), "links")
        if not more.head(1):
            break
        found = forest(found.unionByName(more))
        labelled = _labelled(large, found)
        again = last > 0  # else all delegates have met in one block, and would meet there again
    sizes = labelled.groupBy("lead", "component").agg(F.count("*").alias("m"))
    mains = sizes.groupBy("lead").agg(
        F.max(F.struct("m", "component")).alias("top"), F.sum("m").alias("size"), F.count("*").alias("k")
    ).where("k > 1").select(
        "lead", F.col("top.component").alias("main"), F.ceil(F.col("size") / BLOCK).alias("rows"),
        F.ceil((F.col("size") - F.col("top.m")) / BLOCK).alias("columns"))
    open_ = stored(labelled.join(mains, "lead"), "open")
    if not open_.head(1):
        return found
    asked = open_.select(
        "rep", "lead", "component", F.lit(False).alias("asking"), _block_of(F.col("rows")).alias("r"),
        _numbers_below(F.col("columns")).alias("c"))
    asking = open_.where("component <> main").select(
        "rep", "lead", "component", F.lit(True).alias("asking"), _numbers_below(F.col("rows")).alias("r"),
        _block_of(F.col("columns")).alias("c"))
    grid = asked.unionByName(asking).join(sets, "rep")
    return forest(found.unionByName(stored(_links_in_groups(grid, percent, ["lead", "r", "c"]), "links")))


def _between(lists: DataFrame, led: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Pairs of a list that lie in different groups, and in different components so far.

    The largest component of a list is not paired with itself, only with the rest.
    """
    labelled = lists.join(_labelled(led, found), "rep")
    counts = labelled.groupBy("value", "component").agg(
        F.count("*").alias("m"), F.min("lead").alias("low"), F.max("lead").alias("high"))
    open_ = stored(labelled.join(
        counts.groupBy("value").agg(
            F.max(F.struct("m", "component")).alias("top"), F.count("*").alias("k"),
            F.min("low").alias("low"), F.max("high").alias("high"),
        ).where("k > 1 and low < high").select("value", F.col("top.component").alias("main")), "value"), "open")
    some = open_.where("component <> main").select(
        "value", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("component").alias("ca"),
        F.col("lead").alias("la"))
    every = open_.select(
        "value", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb"),
        F.col("lead").alias("lb"), "main")
    return some.join(every, "value").where(
        (F.col("la") != F.col("lb")) & (F.col("ca") != F.col("cb"))
        & ((F.col("cb") == F.col("main")) | (F.col("a") < F.col("b")))
        & (F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent)
    ).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of each row of ``docs``.

    1. One hash function gives each document's shingle set and the 64 smallest values of
       it. Equal sets (by size and 128-bit digest) form a class, stood for by its
       smallest id; from here on only these stand-ins are compared.
    2. Retained values make inverted lists (see ``_lists``); no list is cut.
    3. Each listed document goes to the group of the smallest id that it shares a list
       with, or that a document on its lists does. Groups are worked in blocks of ``BLOCK``: union sketches filter, full sets
       verify, and pairs that are joined already are skipped. So a group of thousands of
       near copies collapses without a row per pair (``_join_large_groups``).
    4. What the lists still leave between different groups and components is paired,
       filtered and verified likewise. Every candidate pair is thus verified, or joined over verified
       links; components of the links are found by star steps on tables.

    A document without words (or with null text) has size 0 and is its own component.
    Rows with one ``doc_id`` are one document and share a component; a null id is linked
    with nothing, has a null component and is kept. Other columns are not read; an empty
    table gives no rows.
    """
    sketched = stored(_sketches(docs, width), "sketches")
    filled = sketched.where("n > 0 and doc_id is not null")
    classes = stored(
        filled.groupBy("n", "d1", "d2").agg(
            F.min("doc_id").alias("rep"), F.count("*").alias("members"),
            F.min_by("sketch", "doc_id").alias("sketch"),
        ), "classes",
    )
    lists = stored(_lists(classes, percent), "lists")

    led = lists.select("value", "rep", F.col("rep").alias("lead"))
    for step in range(2):  # the second step joins what the first has led to several members
        leads = led.groupBy("value").agg(F.min("lead").alias("low"))
        led = led.join(leads, "value").groupBy("rep").agg(F.min("low").alias("lead"))
        led = stored(led if step else lists.select("value", "rep").join(led, "rep"), "led")
    groups = led.where("rep <> lead").groupBy("lead").agg((F.count("*") + 1).alias("size"))
    members = led.where("rep <> lead").join(groups, "lead").select(
        "rep", "lead", "size", _block_of(F.ceil(F.col("size") / BLOCK)).alias("block"), F.lit(1).cast("long").alias("once"))
    # A lead belongs to its group, even if its own lists lead it elsewhere, and is in each of its blocks,
    # so that blocks of near copies join over it. One that leads itself and no other is compared later
    # on, so its set is needed, too. ``once`` marks one row of each document.
    own = led.where("rep = lead").select("lead", F.lit(True).alias("own"))
    heads = groups.join(own, "lead", "full").withColumn("size", F.coalesce("size", F.lit(1).cast("long"))).select(
        F.col("lead").alias("rep"), "lead", "size", _numbers_below(F.ceil(F.col("size") / BLOCK)).alias("block"),
        "own").withColumn("once", (F.col("own").isNotNull() & (F.col("block") == 0)).cast("long")).drop("own")
    wanted = members.unionByName(heads).withColumnRenamed("rep", "doc_id")
    grouped = stored(_whole_sets(docs, wanted, width), "sets")
    sets = grouped.where("once = 1").select("rep", "set")

    found = forest(stored(_links_in_groups(grouped, percent, ["lead", "block"]), "links"))
    large = stored(grouped.where(
        (F.col("size") > BLOCK) & ((F.col("rep") != F.col("lead")) | (F.col("block") == 0))
    ).select("rep", "lead").distinct(), "large")
    if large.head(1):
        found = _join_large_groups(large, stored(sets.join(
            large.select("rep").distinct(), "rep", "left_semi"), "sets"), found, percent)
    pairs = stored(_between(lists, led, found, percent), "pairs")
    if pairs.head(1):
        pairs = stored(_filtered(pairs, classes, percent), "pairs")
        found = found.unionByName(stored(_verified(pairs, sets, percent), "links"))
    # Rows that repeat an id with another text tie their classes together.
    ties = filled.join(classes.select("n", "d1", "d2", "rep"), ["n", "d1", "d2"]).where("doc_id <> rep").select(
        F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = forest(found.unionByName(ties)).withColumnsRenamed({"a": "node", "b": "component"})
    return sketched.join(
        found.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left"
    ).select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept"),
    )


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents by four-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


QUERIES = {"op1_near_dedup": op1_near_dedup}
SQL: dict[str, str] = {}

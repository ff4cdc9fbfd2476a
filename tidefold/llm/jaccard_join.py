"""N-gram Jaccard join: size-banded tiles, bitmap signatures, exact sorted-array intersection."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.llm.common import (
    binary, chunks_of, components, key_groups, shingle_sets, stored, table, word_memory,
)

#: Words of a shingle and least similarity in percent.
WIDTH = 3
PERCENT = 90
#: Values at least by which the head of a set is longer than its prefix.
SPARE = 8
#: Bytes of sets that a tile holds, and its documents at least.
TILE_BYTES = 32 << 20
LEAST_TILE = 64
#: Documents that a component sends to a meeting of blocks, roughly.
DELEGATES = 8

TILE = ["value", "band"]


def prefix_length(n: int, percent: int) -> int:
    """Values of a set of which one at least is in a similar set, in any common order."""
    return n * (100 - percent) // 100 + 1


def head_length(n: int, percent: int) -> int:
    """Smallest values that are kept: similar sets share ``head - prefix + 1`` of them."""
    prefix = prefix_length(n, percent)
    return min(n, prefix - 1 + max(prefix, SPARE))


def bitmaps(sets: list[np.ndarray], band: int) -> np.ndarray:
    """Parities of hashed positions, 4 to 8 bits a value of sets of the band below ``2 ** (band + 1)``.

    A value that only one of two sets has changes one bit, so the number of bits that
    differ is at most the number of values that the sets do not share.
    """
    width = max(64, 4 << band)
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values = np.concatenate(sets) & np.uint64(width - 1)
    flips = np.bincount(rows * width + values.astype(np.int64), minlength=len(sets) * width) & 1
    return np.packbits(flips.astype(bool)).reshape(len(sets), -1).view(np.uint64)


def possible(sizes: np.ndarray, size: int, bits: np.ndarray, own: np.ndarray, percent: int) -> np.ndarray:
    """Bits that differ, where these leave the similarity possible, else -1."""
    total = sizes + size
    most = total - 2 * -(-percent * total // (100 + percent))  # values that may not be shared
    differ = np.bitwise_count(bits ^ own).sum(axis=1, dtype=np.int64)
    return np.where(differ <= most, differ, -1)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _heads(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``doc_id``, ``key``, set size ``n``, ``digest`` of the set and ``head``, its smallest values, of each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("head", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = word_memory()
        for batch in batches:
            for part in chunks_of(batch, "text"):
                sets = shingle_sets(part.column("text").to_pylist(), width, memory)
                heads = [s[: head_length(len(s), percent)].view(np.int64) for s in sets]
                offsets = np.concatenate([[0], np.cumsum([len(h) for h in heads])]).astype(np.int32)
                yield pa.record_batch([
                    part.column("doc_id"), part.column("key"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_digest(s) for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int64), *heads]))),
                ], schema=schema)

    return docs.mapInArrow(run, "doc_id long, key long, n long, digest binary, head array<long>")


def _digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=24).digest()


def _lists(classes: DataFrame, percent: int) -> DataFrame:
    """``value``, ``cls``, ``n``: the rarest values of each head that other sets have in theirs, too.

    Heads of similar sets share so many values that one of them is among the first
    ``prefix_length`` of each head in any common order; in order of rarity, passages
    that many documents share come last and make no lists, unless they are most of
    a document. A value of one head alone takes a place there but makes no list.
    """
    rows = classes.select("cls", "n", F.size("head").alias("size"), F.explode("head").alias("value"))
    shared = rows.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    prefix = F.floor(F.col("n") * (100 - percent) / 100) + 1
    held = rows.join(shared, "value").groupBy("cls", "n", "size").agg(
        F.sort_array(F.collect_list(F.struct("df", "value"))).alias("found"))
    room = F.greatest(F.lit(0), prefix - (F.col("size") - F.size("found")))
    return held.select("cls", "n", F.explode(F.slice("found", F.lit(1), room.cast("int"))).alias("kept")).select(
        F.col("kept.value").alias("value"), "cls", "n")


def _tiles(lists: DataFrame, percent: int) -> DataFrame:
    """Rows of tiles (``value``, ``band``) of two sets or more.

    Band b has the sizes from 2 ** b on. A set that may be similar to one of the band
    above visits that band's tile; two visitors are compared in their own tile.
    """
    own = F.length(F.bin("n")) - 1
    edge = F.pow(F.lit(2.0), own + 1) * percent
    banded = lists.select(
        "value", "cls", "n", F.explode(F.when(F.col("n") * 100 >= edge, F.array(own, own + 1)).otherwise(F.array(own))).alias("band"))
    return _where_several(banded, TILE)


def _where_several(rows: DataFrame, keys: list[str], name: str = "members") -> DataFrame:
    counts = rows.groupBy(*keys).agg(F.count("*").alias(name)).where(F.col(name) > 1)
    return rows.join(counts, keys)


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``cls`` and full ``set`` (sorted 64-bit hashes); ``wanted`` has ``cls``, ``key``, ``digest``.

    A row whose text is not the wanted one, though its key is, has another digest.
    """
    schema = pa.schema([("cls", pa.int64()), ("set", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = word_memory()
        for batch in batches:
            for part in chunks_of(batch, "text"):
                sets = shingle_sets(part.column("text").to_pylist(), width, memory)
                same = [_digest(s) == d for s, d in zip(sets, part.column("digest").to_pylist())]
                rows = pa.array(same, pa.bool_())
                yield pa.record_batch(
                    [part.column("cls").filter(rows), binary(s for s, ok in zip(sets, same) if ok)], schema=schema)

    joined = docs.join(wanted.hint("shuffle_hash"), "key")
    return joined.select("cls", "digest", "text").mapInArrow(run, "cls long, set binary").groupBy("cls").agg(
        F.any_value("set").alias("set"))


def links_of_tile(ids: np.ndarray, sets: list[np.ndarray], band: int, percent: int,
                  component: np.ndarray, block: np.ndarray) -> list[tuple[int, int]]:
    """Verified links that join the similar sets of a tile.

    Sets of one component need no comparison, and those of one block only among
    themselves where the tile is that block alone. The nearest bitmaps come first.
    """
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    ids, sizes, block = ids[order], sizes[order], block[order]
    sets = [sets[i] for i in order]
    label = np.unique(component[order], return_inverse=True)[1]
    bits, links = bitmaps(sets, band), []
    for i, near in _partners(sizes, band, percent, lambda: label, block):
        differ = possible(sizes[near], int(sizes[i]), bits[near], bits[i], percent)
        near = near[np.argsort(differ, kind="stable")][int((differ < 0).sum()):]
        for j in near.tolist():
            if label[j] != label[i] and similar(sets[i], sets[j], percent):
                links.append((int(ids[i]), int(ids[j])))
                label[label == label[i]] = label[j]
    return links


def _partners(sizes: np.ndarray, band: int, percent: int, labels, block: np.ndarray):
    """Each set of a tile, in order of size, with the smaller ones it has to be compared with."""
    first = np.searchsorted(100 * sizes, percent * sizes)
    across = block[0] != block[-1] or (block != block[0]).any()
    for i in np.flatnonzero(sizes >= 1 << band).tolist():
        label = labels()
        near = label[first[i] : i] != label[i]
        if across:
            near &= block[first[i] : i] != block[i]
        near = np.flatnonzero(near) + first[i]
        if len(near):
            yield i, near


def _cap(band: Column | str = "band") -> Column:
    """Documents of a tile that fit its bytes."""
    return F.greatest(F.lit(LEAST_TILE), F.floor(F.lit(TILE_BYTES / 16) / F.pow(F.lit(2.0), F.col(band))))


def _deal(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("cls"), F.greatest(blocks, F.lit(1)).cast("long"))


def _links(rows: DataFrame, percent: int) -> DataFrame:
    """Links within each tile and cell of ``rows`` (``cls``, ``set``, ``component``, ``block``)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    keys = [*TILE, "cell_a", "cell_b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int]] = []
        for group in key_groups(batches, keys):
            if group.num_rows > 1:
                held += links_of_tile(
                    group.column("cls").to_numpy(), [np.frombuffer(s.as_py(), np.uint64) for s in group.column("set")],
                    group.column("band")[0].as_py(), percent, group.column("component").to_numpy(),
                    group.column("block").to_numpy())
            if len(held) > 10_000:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*held)], schema=schema)
                held = []
        if held:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*held)], schema=schema)

    return rows.select(*keys, "cls", "component", "block", "set").repartition(*keys).sortWithinPartitions(
        *keys, "cls").mapInArrow(run, "a long, b long")


def _labelled(rows: DataFrame, joined: DataFrame) -> DataFrame:
    return rows.join(joined.select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn(
        "component", F.coalesce("component", "cls"))


def _alone(rows: DataFrame, blocks: Column) -> DataFrame:
    """Each block of a tile by itself."""
    return rows.withColumn("block", _deal(blocks)).withColumn("cell_a", F.col("block")).withColumn("cell_b", F.col("block"))


def _grid(rows: DataFrame) -> DataFrame:
    """All pairs of blocks of a tile, each a cell; a tile of one block is one cell."""
    blocks = F.ceil(F.col("members") / _cap())
    dealt = rows.withColumn("block", _deal(blocks)).withColumn("other", F.explode(
        F.sequence(F.lit(0).cast("long"), F.greatest(blocks, F.lit(1)).cast("long") - 1)))
    return dealt.withColumn("cell_a", F.least("block", "other")).withColumn(
        "cell_b", F.greatest("block", "other")).drop("other")


def _meetings(large: DataFrame, sets: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """More links: delegates of the components of tiles of several blocks meet while that joins any."""
    while True:
        labelled = _labelled(large, components(links))
        sizes = labelled.groupBy(*TILE, "component").agg(F.count("*").alias("m"))
        sent = labelled.join(sizes, [*TILE, "component"]).where(
            F.pmod(F.xxhash64("cls", F.lit(1)), F.greatest(F.floor(F.col("m") / DELEGATES), F.lit(1))) == 0)
        counts = sent.groupBy(*TILE).agg(
            F.count("*").alias("sent"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
        met = stored(_alone(sent.join(counts, TILE), F.ceil(F.col("sent") / _cap())), "met")
        more = stored(_links(met.join(sets, "cls"), percent), "links")
        if not more.head(1):
            return links
        links = links.unionByName(more)


def _flagged(rows: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """Rows of tiles whose bitmap leaves a link to another component possible.

    One row a set and cell at most, however many partners it may have.
    """
    keys = [*TILE, "cell_a", "cell_b"]
    schema = pa.schema([*((k, pa.int64()) for k in keys), ("cls", pa.int64()), ("component", pa.int64()), ("block", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in key_groups(batches, keys):
            sizes = group.column("n").to_numpy()
            order = np.argsort(sizes, kind="stable")
            band, sizes = group.column("band")[0].as_py(), sizes[order]
            label, block = group.column("component").to_numpy()[order], group.column("block").to_numpy()[order]
            raw = [np.frombuffer(group.column("bits")[int(i)].as_py(), np.uint64) for i in order]
            bits = np.stack([_widened(b, band) for b in raw])
            found = np.zeros(len(order), bool)
            for i, near in _partners(sizes, band, percent, lambda: label, block):
                hits = near[possible(sizes[near], int(sizes[i]), bits[near], bits[i], percent) >= 0]
                if len(hits):
                    found[hits] = found[i] = True
            rows = pa.array(np.sort(order[found]))
            if len(rows):
                out = group.select([f.name for f in schema]).take(rows).cast(schema)
                yield from out.to_batches()

    return rows.join(heads, "cls").select(*keys, "cls", "n", "component", "block", "bits").withColumn(
        "band", F.col("band").cast("long")).repartition(*keys).sortWithinPartitions(*keys, "cls").mapInArrow(
        run, ", ".join(f"{f.name} long" for f in schema))


def jaccard_join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of each row of ``docs``.

    Rows are linked if the sets of their word shingles have a Jaccard similarity of
    ``percent`` or more; ``component_id`` is the smallest ``doc_id`` reachable by links.

    1. Equal sets (by size and a 192-bit digest) are one class; only classes are compared.
    2. Each class is listed under its rarest values (``_lists``), and lists are cut into tiles
       by bands of sizes (``_tiles``). No list is cut short; similar sets share a tile.
    3. In each band a set first goes to one home tile, that of its smallest value, which
       most similar sets have in common. Tiles are worked in blocks of bounded bytes: bit counts of
       parity bitmaps bound the overlap, the sorted arrays of hashes are then intersected,
       and sets that are joined already are skipped. Components of large tiles send delegates to common blocks.
    4. Tiles that still hold several components are worked whole, in a grid of their blocks:
       bitmaps tell which sets may have a link to another component, and only
       those are intersected. So every pair of similar sets is verified or joined over verified links.

    A row without words (or with null text) has size 0 and is linked with nothing. Fewer
    words than ``width`` are one shingle. Rows of one id and different texts are documents
    of their own. Null ids are linked like others but are no ``component_id``, unless all
    rows of a component have null. Other columns are not read; an empty table gives no rows.
    """
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("key"), "text")
    rows = stored(_heads(docs, width, percent).withColumn("mark", F.monotonically_increasing_id()), "heads")
    classes = stored(rows.where("n > 0").groupBy("n", "digest").agg(
        F.min("mark").alias("cls"), F.min("doc_id").alias("doc_id"), F.min_by(F.struct("key", "head"), "mark").alias("first"),
    ).select("n", "digest", "cls", "doc_id", "first.key", "first.head"), "classes")
    tiles = stored(_tiles(_lists(classes, percent), percent), "tiles")
    wanted = classes.join(tiles.select("cls").distinct(), "cls").select("cls", "key", "digest")
    sets = stored(_sets(docs, wanted, width), "sets")

    homes = tiles.groupBy("cls", "band").agg(F.min("value").alias("value"))
    homes = stored(_where_several(homes, TILE), "homes").withColumn("component", F.col("cls"))
    first = _alone(homes, F.ceil(F.col("members") / _cap())).join(sets, "cls")
    links = stored(_links(first, percent), "links")
    large = homes.where(F.col("members") > _cap()).select(*TILE, "cls")
    if large.head(1):
        links = _meetings(large, sets, links, percent)

    labelled = _labelled(tiles, components(links))
    several = labelled.groupBy(*TILE).agg(F.min("component").alias("low"), F.max("component").alias("high")).where(
        "low < high").select(*TILE)
    cells = _grid(labelled.join(several, TILE))
    asked = stored(_flagged(cells, _bits(sets), percent), "asked")
    links = links.unionByName(stored(_links(asked.join(sets, "cls"), percent), "links"))

    joined = components(links).withColumnRenamed("node", "cls")
    lowest = classes.select("cls", "doc_id").join(joined, "cls").groupBy("component").agg(
        F.min("doc_id").alias("lowest"))
    named = classes.select("n", "digest", "cls", "doc_id").join(joined, "cls", "left").join(
        lowest, "component", "left").select("n", "digest", F.coalesce("lowest", "doc_id").alias("component_id"))
    return rows.join(named, ["n", "digest"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _bits(sets: DataFrame) -> DataFrame:
    """``cls`` and ``bits``, the bitmap of each set in the width of the band above its own.

    That is the wider one of its two tiles; it folds to the other.
    """
    schema = pa.schema([("cls", pa.int64()), ("bits", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(s.as_py(), np.uint64) for s in batch.column("set")]
            yield pa.record_batch([
                batch.column("cls"), binary(bitmaps([s], len(s).bit_length())[0] for s in found)], schema=schema)

    return sets.mapInArrow(run, "cls long, bits binary")


def _widened(bits: np.ndarray, band: int) -> np.ndarray:
    """A bitmap in the width of a band: a wider one is folded, as parities of parts add up."""
    words = max(64, 4 << band) // 64
    return np.bitwise_xor.reduce(bits.reshape(-1, words), axis=0)


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by three-word shingles."""
    return jaccard_join(table(spark, sf_dir, "documents"))


QUERIES = {"op11_jaccard_join": op11_jaccard_join}
SQL: dict[str, str] = {}

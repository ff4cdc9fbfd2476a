"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidefold.llm.common import WORD, chunks_of, stored, table, words

#: Tokens of a block, documents of a shard, share of all tokens that the mix holds,
#: and how often a source may be repeated.
BLOCK_TOKENS = 16
SHARD_DOCS = 16_384
SHARE = 1.5
MOST_REPEATS = 2
#: Weights of sources in order; they repeat.
WEIGHTS = (3, 1, 2)

_WORDS = re.compile(WORD)


def sainte_lague(weights: list[float], most: list[int], seats: int) -> list[int]:
    """Seats of each party by highest quotients weight / (2 k + 1), none above ``most``.

    Equals handing out seats one by one, but starts from the proportional shares, which
    are off by less than a seat a party, so that a trillion seats take no longer than
    ten. Ties go to the first party.
    """
    result = [0] * len(weights)
    open_ = [i for i, (w, m) in enumerate(zip(weights, most)) if w > 0 and m > 0]
    seats = min(seats, sum(most[i] for i in open_))
    while open_:  # parties whose share is above what they can hold are full
        left = seats - sum(result)
        divisor = sum(weights[i] for i in open_) / max(left, 1)
        full = [i for i in open_ if weights[i] / divisor >= most[i] + 1]
        if not full:
            for i in open_:
                result[i] = min(most[i], max(0, int(weights[i] / divisor)))
            break
        for i in full:
            result[i] = most[i]
        open_ = [i for i in open_ if i not in full]
    # Seats that the start gave against the order of quotients are moved.
    able = [i for i in range(len(weights)) if weights[i] > 0]
    gain = [(-weights[i] / (2 * result[i] + 1), i) for i in able if result[i] < most[i]]
    loss = [(weights[i] / (2 * result[i] - 1), -i) for i in able if result[i] > 0]
    heapq.heapify(gain)
    heapq.heapify(loss)
    while True:
        while gain and (gain[0][1] not in able or -gain[0][0] != weights[gain[0][1]] / (2 * result[gain[0][1]] + 1)
                        or result[gain[0][1]] >= most[gain[0][1]]):
            heapq.heappop(gain)
        while loss and (not result[-loss[0][1]]
                        or loss[0][0] != weights[-loss[0][1]] / (2 * result[-loss[0][1]] - 1)):
            heapq.heappop(loss)
        total = sum(result)
        if total < seats:
            move = (gain[0][1], 1)
        elif total > seats:
            move = (-loss[0][1], -1)
        elif gain and loss and (-gain[0][0], -gain[0][1]) > (loss[0][0], loss[0][1]):
            move = (-loss[0][1], -1)
        else:
            return result
        i, step = move
        result[i] += step
        if result[i] < most[i]:
            heapq.heappush(gain, (-weights[i] / (2 * result[i] + 1), i))
        if result[i] > 0:
            heapq.heappush(loss, (weights[i] / (2 * result[i] - 1), -i))


def targets(sizes: list[int], weights: list[float], share: float, repeats: float) -> list[float]:
    """Token targets: shares by weight of ``share`` times all sizes, none above ``repeats`` times
    its source's size; what that leaves goes to the others by weight."""
    total = share * sum(sizes)
    result = [0.0] * len(sizes)
    open_ = [i for i, n in enumerate(sizes) if n > 0]
    left = total
    while open_:
        weight = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / weight > repeats * sizes[i]]
        if not full:
            for i in open_:
                result[i] = left * weights[i] / weight
            break
        for i in full:
            result[i] = float(repeats * sizes[i])
        left -= sum(repeats * sizes[i] for i in full)
        open_ = [i for i in open_ if i not in full]
    return result


def plan(sizes: list[int], names: list, blocks: list[int], share: float, repeats: int,
         block_tokens: int) -> list[tuple[float, int]]:
    """Target and quota of blocks of each source, in code point order with null last."""
    order = sorted(range(len(names)), key=lambda i: (names[i] is None, (names[i] or "").encode()))
    weights = [0.0] * len(names)
    for place, i in enumerate(order):
        weights[i] = float(WEIGHTS[place % len(WEIGHTS)])
    goal = targets(sizes, weights, share, repeats)
    capped = [goal[i] >= repeats * sizes[i] for i in range(len(names))]
    open_ = [i for i in order if not capped[i]]
    seats = round(sum(goal[i] for i in open_) / block_tokens)
    given = sainte_lague([weights[i] for i in open_], [blocks[i] for i in open_], seats)
    quota = [blocks[i] if capped[i] else 0 for i in range(len(names))]
    for i, q in zip(open_, given):  # the last block of a shard is short: count mean blocks
        mean = repeats * sizes[i] / blocks[i] if blocks[i] else 1.0
        quota[i] = min(blocks[i], round(q * block_tokens / mean))
    return list(zip(goal, quota))


def shard_quotas(by_shard: DataFrame, repeats: int, block_tokens: int) -> DataFrame:
    """Tokens that each shard gives: its source's blocks, handed to shards by highest quotients
    of their sizes. Each source is one group of one row a shard."""

    def hand_out(shards: pd.DataFrame) -> pd.DataFrame:
        shards = shards.sort_values("shard")
        sizes = shards["shard_size"].tolist()
        most = [-(-n * repeats // block_tokens) for n in sizes]
        blocks = int(shards["blocks"].iloc[0])
        if blocks * block_tokens >= repeats * sum(sizes):  # all there is: last blocks of shards are short
            blocks = sum(most)
        blocks = sainte_lague([float(n) for n in sizes], most, blocks)
        return pd.DataFrame({
            "q_source": shards["source"], "q_shard": shards["shard"], "shard_size": sizes,
            "quota": [min(q * block_tokens, repeats * n) for q, n in zip(blocks, sizes)],
        })

    return by_shard.groupBy("source").applyInPandas(
        hand_out, "q_source string, q_shard long, shard_size long, quota long")


def mix(docs: DataFrame, share: float = SHARE, repeats: int = MOST_REPEATS,
        block_tokens: int = BLOCK_TOKENS, shard_docs: int = SHARD_DOCS, seed: int = 7) -> DataFrame:
    """Adds ``size``, ``source_size``, ``target`` and ``taken`` to ``doc_id``, ``text``, ``source``.

    Sainte-Lague hands blocks of ``block_tokens`` to sources by weight, and each source's
    blocks to its shards by size, as integers. Shards hold some ``shard_docs`` documents each, however many a source has,
    dealt by a seeded hash of id and text. A shard's documents are laid end to end in a
    seeded order, and the blocks of this line, repeated ``repeats`` times, are taken up to the shard's
    quota: all documents as often as the whole line fits, and of the last, partial line whole
    documents. Only the one document in which a shard's quota ends is taken in part.
    So a document's share is arithmetic on its place in the line: no block is ever a row.
    Only source totals (one row a source) reach the driver.

    Null text and text without words have size 0 and take 0; a null source is a source
    of its own, last in order. Repeated rows count as often as they occur; rows equal in
    id and text share a shard, rows without id do not. An empty table gives no rows. Other
    columns of ``docs`` are not used.
    """
    spark = docs.sparkSession
    sized = stored(docs.select(
        "doc_id", "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), "doc_id", "text").alias("mark"),
    ), "sizes")
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")).collect()
    planned = plan(
        [r.source_size for r in by_source], [r.source for r in by_source],
        [-(-r.source_size * repeats // block_tokens) for r in by_source], share, repeats, block_tokens,
    )
    sources = spark.createDataFrame(
        [(r.source, r.source_size, float(t), int(q), -(-r.n // shard_docs))
         for r, (t, q) in zip(by_source, planned)],
        "p_source string, source_size long, target double, blocks long, shards long",
    )
    dealt = sized.join(sources, F.col("source").eqNullSafe(F.col("p_source"))).withColumn(
        "shard", F.pmod("mark", "shards"))
    quotas = shard_quotas(
        dealt.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("blocks").alias("blocks")),
        repeats, block_tokens)
    line = Window.partitionBy("source", "shard").orderBy("mark", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    placed = dealt.withColumn("stop", F.sum("size").over(line)).join(
        quotas, F.col("source").eqNullSafe(F.col("q_source")) & (F.col("shard") == F.col("q_shard")))
    copies = F.floor(F.col("quota") / F.greatest("shard_size", F.lit(1)))
    left = F.col("quota") - copies * F.col("shard_size") - (F.col("stop") - F.col("size"))
    rest = F.greatest(F.lit(0), F.least(F.col("size"), left))
    return placed.select(
        "doc_id", "size", "source_size", "target",
        (F.col("size") * copies + rest).cast("long").alias("taken"), "source",
    )


def _first_words(text: str, n: int) -> str:
    """The text up to the end of its n-th word."""
    for i, found in enumerate(_WORDS.finditer(text), 1):
        if i == n:
            return text[: found.end()]
    return text


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, as often as the mix takes them: whole
    copies for whole sizes taken, then the first words for the rest (of one document a
    shard); none that it does not take. Copies carry the id of their document. Documents without words go.

    Rows that repeat an id take as much as the row of that id of which most is taken,
    but no more than the repeats of their own text.
    """
    taken = mix(docs.select("doc_id", "text", "source"), **options).where("taken > 0").groupBy("doc_id").agg(
        F.max("taken").alias("taken")).select(F.col("doc_id").alias("taken_id"), "taken")
    repeats = options.get("repeats", MOST_REPEATS)
    names = ["_" * max(map(len, docs.columns)) + n for n in ("id", "taken")]
    joined = docs.join(
        taken.toDF(*names), docs["doc_id"].eqNullSafe(F.col(names[0]))
    ).select(*docs.columns, names[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks_of(batch, "text"):
                rows, texts = [], []
                for i, (text, n) in enumerate(zip(part.column("text").to_pylist(), part.column(-1).to_pylist())):
                    size = len(words(text or ""))
                    n = min(n, repeats * size)
                    for _ in range(n // size if size else 0):
                        rows.append(i)
                        texts.append(text)
                    if size and n % size:
                        rows.append(i)
                        texts.append(_first_words(text, n % size))
                out = part.take(pa.array(rows, pa.int64()))
                place = part.schema.get_field_index("text")
                columns = out.columns[:-1]
                columns[place] = pa.array(texts, pa.string())
                yield pa.record_batch(columns, names=part.schema.names[:-1])

    return joined.mapInArrow(run, docs.schema)


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


QUERIES = {"op7_mix_sources": op7_mix_sources}
SQL: dict[str, str] = {}

"""Document fingerprints by order MinHash, which follows edit distance."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.llm.common import mixed, odd_numbers, table

#: Code points of a k-mer, k-mers of a tuple, tuples of a fingerprint.
K = 6
TUPLE = 2
SKETCHES = 64
SEED = 5
#: Documents in one stretch of the id order, and the most stretches; beyond, they are longer.
STRETCH = 1024
MOST_STRETCHES = 50_000

#: Hashes that are held at once.
_CELLS = 200_000

_POSITION_BITS = np.uint64(24)
_POSITIONS = np.uint64((1 << 24) - 1)


def numbered_kmers(text: str, k: int = K) -> np.ndarray:
    """A hash of each k-mer with its occurrence number, in text order.

    A text of fewer code points than ``k`` is one k-mer; an empty one has none.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if not len(codes):
        return np.empty(0, np.uint64)
    width = min(k, len(codes))
    factors = odd_numbers(width, 3)
    plain = np.zeros(len(codes) - width + 1, np.uint64)
    for i in range(width):
        plain += codes[i : len(codes) - width + 1 + i] * factors[i]
    plain = mixed(plain)
    # Equal k-mers sort together in text order when the position is in the low bits.
    # A text over 2^24 k-mers is sorted in two steps instead.
    n = len(plain)
    if n <= int(_POSITIONS):
        packed = np.sort((plain & ~_POSITIONS) | np.arange(n, dtype=np.uint64))
        place, same = (packed & _POSITIONS).astype(np.int64), packed >> _POSITION_BITS
    else:
        place = np.argsort(plain >> _POSITION_BITS, kind="stable")
        same = plain[place] >> _POSITION_BITS
    starts = np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1]]))
    run = np.diff(np.append(starts, n))
    number = np.arange(n) - np.repeat(starts, run)
    numbers = np.empty(n, np.uint64)
    numbers[place] = number.astype(np.uint64)
    return plain + numbers * np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: str, k: int = K, size: int = TUPLE, sketches: int = SKETCHES) -> np.ndarray:
    """``sketches`` 32-bit values: for each hash function the ``size`` numbered k-mers of
    smallest hash, in text order, hashed together. An empty text has all zeros."""
    kmers = numbered_kmers(text, k)
    if not len(kmers):
        return np.zeros(sketches, np.uint32)
    size = min(size, len(kmers))
    short = (kmers >> np.uint64(32)).astype(np.uint32)
    factors = odd_numbers(sketches, SEED).astype(np.uint32)[:, None]
    shifts = odd_numbers(sketches, SEED + 2).astype(np.uint32)[:, None]
    chosen = np.empty((sketches, size), np.int64)
    step = max(1, _CELLS // len(kmers))
    for start in range(0, sketches, step):
        rows = slice(start, start + step)
        hashes = short * factors[rows] + shifts[rows]
        line = np.arange(len(hashes))
        for j in range(size):
            least = hashes.argmin(axis=1)
            chosen[rows, j] = least
            hashes[line, least] = 0xFFFFFFFF
    chosen.sort(axis=1)
    tuples = (kmers[chosen] * odd_numbers(size, SEED + 1)).sum(axis=1, dtype=np.uint64)
    return (mixed(tuples + np.arange(sketches, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The last third of a text replaced by as many first code points of the next one."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n] if n else text


RESULT = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
    ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
    ("near_edited", pa.float64()), ("near_next", pa.float64()),
])


def in_stretches(docs: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Rows dealt by ranges of ``doc_id``, each stretch with the first row of the next one.

    Ranges come from quantiles of the ids (a bounded sketch); the head of each range is
    one id, found by one pass over ids alone. Text moves once.
    """
    spark = docs.sparkSession
    ids = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"))
    count = max(1, min(MOST_STRETCHES, -(-ids.count() // stretch)))
    cuts = [i / count for i in range(1, count)]
    bounds = sorted(set(ids.approxQuantile("id", cuts, 1 / (4 * count)))) if cuts else []
    bounds = [int(b) for b in bounds]
    # Stretch number: how many bounds lie above the id; documents go in descending order.
    sent = spark.sparkContext.broadcast(np.array(bounds, np.int64))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            id_ = batch.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
            stretch_ = len(sent.value) - np.searchsorted(sent.value, id_, side="right")
            yield pa.record_batch(
                [*batch.columns, pa.array(stretch_.astype(np.int64))],
                names=[*batch.schema.names, "stretch"],
            )

    heads = sorted(
        (r.stretch, r.id) for r in ids.mapInArrow(number, "id long, stretch long")
        .groupBy("stretch").agg(F.max("id").alias("id")).collect()
    )
    # The head of a stretch also ends the stretch before it; the very first ends the last.
    ends = {id_: heads[i - 1][0] for i, (_, id_) in enumerate(heads)}
    sent_ends = spark.sparkContext.broadcast(ends)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in number(batches):
            id_ = batch.column("id").to_pylist()
            yield pa.record_batch(
                [*batch.columns, pa.array([False] * batch.num_rows)],
                names=[*batch.schema.names, "extra"],
            )
            again = [i for i, x in enumerate(id_) if x in sent_ends.value]
            if again:
                part = batch.take(pa.array(again))
                stretch_ = pa.array([sent_ends.value[id_[i]] for i in again], pa.int64())
                yield pa.record_batch(
                    [*part.columns[:-1], stretch_, pa.array([True] * len(again))],
                    names=[*part.schema.names, "extra"],
                )

    rows = docs.select(
        F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), "doc_id",
        F.coalesce("text", F.lit("")).alias("text"),
    )
    dealt = rows.mapInArrow(deal, "id long, doc_id long, text string, stretch long, extra boolean")
    return dealt.repartition("stretch").sortWithinPartitions(
        F.col("stretch"), F.col("extra"), F.col("id").desc(), F.xxhash64("text")
    )


def fingerprints(docs: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Order MinHash of each text and of its edited form, and how alike they are.

    The next document is the one with the next smaller ``doc_id``, after the last comes
    the first; a null id is the smallest; rows with one id follow each other by a hash of
    their text (of several with the largest id, the first follows the last row). A single
    row is its own next. Null text is empty; empty texts have a fingerprint of zeros and
    are alike. Whole texts are used, one at a time. Other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = None, []

        def close(row, following):
            stretch_, id_, text, print_ = row
            changed = edited(text, following[2])
            after = fingerprint(changed) if changed != text else print_
            return (
                id_, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
                print_.tobytes().hex(), after.tobytes().hex(),
                likeness(print_, after), likeness(print_, following[3]),
            )

        for batch in batches:
            columns = (batch.column(n).to_pylist() for n in ("stretch", "doc_id", "text", "extra"))
            for stretch_, id_, text, extra in zip(*columns):
                row = (stretch_, id_, text, fingerprint(text))
                if held is not None and held[0] == stretch_:
                    out.append(close(held, row))
                    if len(out) == 2000:
                        yield _rows(out)
                        out = []
                held = None if extra else row
        if out:
            yield _rows(out)

    return in_stretches(docs, stretch).mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string,"
        " edited_fingerprint string, near_edited double, near_next double"
    )


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), RESULT)], schema=RESULT)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {"op10_fingerprints": op10_fingerprints}
SQL: dict[str, str] = {}

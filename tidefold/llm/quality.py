"""Quality classifier: random Fourier features, ridge by summed normal equations, isotonic scores."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.llm.common import stored, table

#: Fourier features, kernel width (in standard deviations of a statistic), ridge weight
#: per row, seed, and bins of equal width in which ridge scores are calibrated.
FEATURES = 256
WIDTH = 4.0
RIDGE = 1e-4
SEED = 11
BINS = 2000
#: A document is predicted good from this score on.
THRESHOLD = 0.3

_BYTES = np.arange(256)
#: Classes of bytes whose shares are statistics of a text.
BYTE_CLASSES = {
    "upper": (_BYTES >= 65) & (_BYTES <= 90),
    "lower": (_BYTES >= 97) & (_BYTES <= 122),
    "digit": (_BYTES >= 48) & (_BYTES <= 57),
    "space": (_BYTES == 32) | (_BYTES == 9),
    "line": (_BYTES == 10) | (_BYTES == 13),
    "stop": np.isin(_BYTES, [ord(c) for c in ".,;:?"]),
    "shout": _BYTES == ord("!"),
    "bar": np.isin(_BYTES, [ord(c) for c in "|\\/"]),
    "symbol": np.isin(_BYTES, [ord(c) for c in "#$%&*+=@^~<>_"]),
    "bracket": np.isin(_BYTES, [ord(c) for c in "()[]{}\"'`"]),
    "high": _BYTES >= 128,
}
STATISTICS = (
    *BYTE_CLASSES, "no_words", "log_words", "word_length", "distinct_words", "repeated_lines",
    "symbol_words", "upper_words",
)
_CLASS_MATRIX = np.stack(list(BYTE_CLASSES.values())).astype(np.float64)
_SYMBOL_WORD = re.compile(rb"[#$%&*+=@^~<>_|!]")


def statistics(text: str | None) -> np.ndarray:
    """Statistics of a whole text; all are finite, and 0 but for ``no_words`` without words."""
    data = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(len(STATISTICS))
    split = data.split()
    if not split:
        out[len(BYTE_CLASSES)] = 1.0
        return out
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    out[: len(BYTE_CLASSES)] = np.sqrt(_CLASS_MATRIX @ counts / len(data))
    lines = data.split(b"\n")
    n = len(split)
    out[len(BYTE_CLASSES) + 1 :] = (
        np.log(n), np.log(len(data) / n), len(set(split)) / n, 1 - len(set(lines)) / len(lines),
        len(_SYMBOL_WORD.findall(data)) / n if n else 0.0,
        sum(map(bytes.isupper, split)) / n,
    )
    return out


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    low: float
    high: float
    calibrated: np.ndarray

    def ridge_scores(self, x: np.ndarray) -> np.ndarray:
        return fourier((x - self.mean) / self.scale) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        raw = self.ridge_scores(x)
        place = (raw - self.low) / (self.high - self.low) * len(self.calibrated)
        return self.calibrated[np.clip(place, 0, len(self.calibrated) - 1).astype(int)]


def fourier(z: np.ndarray) -> np.ndarray:
    """Features whose products approximate exp(-|a - b|^2 / (2 WIDTH^2)), and a constant."""
    draw = np.random.default_rng(SEED)
    directions = draw.standard_normal((z.shape[1], FEATURES)) / WIDTH
    phases = draw.uniform(0, 2 * np.pi, FEATURES)
    waves = np.cos(z @ directions + phases) * np.sqrt(2 / FEATURES)
    return np.hstack([waves, np.ones((len(z), 1))])


def _held_out(doc_id: int | None) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0 if doc_id is not None else False


def with_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out`` and the statistics of every row's text, in row order."""
    schema = pa.schema([
        ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("stats", pa.list_(pa.float64())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            yield pa.record_batch([
                pa.array(ids, pa.int64()), pa.array(map(_held_out, ids), pa.bool_()),
                pa.array([statistics(t.as_py()) for t in batch.column("text")], pa.list_(pa.float64())),
            ], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, held_out boolean, stats array<double>"
    )


def _sums(rows: DataFrame, function, names: list[str]) -> list[np.ndarray]:
    """Sums over all rows of arrays that each partition adds up first.

    A partition sends one row of arrays of a fixed length; those are added in groups,
    so what reaches the driver does not grow with the data.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.vstack(batch.column("stats").to_numpy(zero_copy_only=False))
            y = batch.column("quality").to_numpy(zero_copy_only=False).astype(float)
            part = [np.asarray(a, float).ravel() for a in function(x, y)]
            total = part if total is None else [a + b for a, b in zip(total, part)]
        if total:
            yield pa.RecordBatch.from_pydict({n: pa.array([a]) for n, a in zip(names, total)})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for row in batch.to_pylist():
                part = [np.array(row[n]) for n in names]
                total = part if total is None else [a + b for a, b in zip(total, part)]
        if total:
            yield pa.RecordBatch.from_pydict({n: pa.array([a]) for n, a in zip(names, total)})

    schema = ", ".join(f"{n} array<double>" for n in names)
    partial = rows.mapInArrow(run, schema)
    found = partial.repartition(8).mapInArrow(add, schema).collect()
    if not found:
        return []
    return [np.sum([r[n] for r in found], axis=0) for n in names]


def isotonic(ones: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Non-decreasing rates of bins in order, by pooling adjacent violators; empty bins take
    the rate of the bin below (the first filled one at the start)."""
    pools: list[list[float]] = []
    for i in np.flatnonzero(counts):
        pools.append([ones[i], counts[i], i])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1][0] += last[0]
            pools[-1][1] += last[1]
    rates = np.empty(len(counts))
    starts = [0, *[int(p[2]) for p in pools[1:]], len(counts)]
    for pool, a, b in zip(pools, starts[:-1], starts[1:]):
        rates[a:b] = pool[0] / pool[1]
    return rates


def fit(stats: DataFrame, labels: DataFrame) -> Model | None:
    """The model from all labelled rows that are not held out; None without any.

    Three passes of sums: moments, normal equations of fixed size, and score bins.
    A document labelled more than once counts with the mean of its labels.
    """
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        F.avg("quality").alias("quality")
    )
    rows = stored(stats.where("not held_out").join(marks, "doc_id").select("stats", "quality"), "labelled")
    sums = _sums(rows, lambda x, y: ([len(y)], x.sum(0), (x * x).sum(0)), ["n", "s", "q"])
    if not sums:
        return None
    n, s, q = sums[0][0], sums[1], sums[2]
    mean = s / n
    scale = np.sqrt(np.maximum(q / n - mean**2, 0))
    scale[scale < 1e-9] = 1.0

    def normal(x, y):
        z = fourier((x - mean) / scale)
        return z.T @ z, z.T @ y, [y.sum()]

    left, right, total = _sums(rows, normal, ["l", "r", "t"])
    size = len(right)
    weights = np.linalg.solve(left.reshape(size, size) + RIDGE * n * np.eye(size), right)
    edges = (-0.5, 1.5)
    raw = Model(mean, scale, weights, *edges, np.zeros(BINS))

    def binned(x, y):
        place = (raw.ridge_scores(x) - raw.low) / (raw.high - raw.low) * BINS
        place = np.clip(place, 0, BINS - 1).astype(int)
        return np.bincount(place, y, BINS), np.bincount(place, minlength=BINS)

    ones, counts = _sums(rows, binned, ["o", "c"])
    return Model(mean, scale, weights, *edges, isotonic(ones, counts))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` of each row of ``docs``.

    Statistics of the whole text (shares of bytes, words, lines; none of labels, language,
    source, id or table) go through random Fourier features of a Gaussian kernel; ridge
    weights come from normal equations that each partition sums, and isotonic
    calibration turns them into rates. Labels are joined to narrow rows by id only.

    Null and empty texts have the statistics of no words and get a score too. A null id
    is never held out and never labelled. Repeated rows score alike; without labels every
    score is 0.5. Other columns are not read.
    """
    stats = with_statistics(docs)
    model = fit(stats, labels)
    schema = pa.schema([
        ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            if model is None:
                scores = np.full(batch.num_rows, 0.5)
            else:
                scores = model.scores(np.vstack(batch.column("stats").to_numpy(zero_copy_only=False)))
            yield pa.record_batch([
                batch.column("doc_id"), batch.column("held_out"), pa.array(scores),
                pa.array((scores >= threshold).astype(np.int32)),
            ], schema=schema)

    return stats.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score at least ``threshold``.

    Scores as ``score_quality`` does, where the rows are: no text is shuffled. Without
    labels all rows stay.
    """
    model = fit(with_statistics(docs), labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if model is None or not batch.num_rows:
                yield batch
                continue
            x = np.vstack([statistics(t.as_py()) for t in batch.column("text")])
            yield batch.filter(pa.array(model.scores(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score of every document."""
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op6_quality": op6_quality}
SQL: dict[str, str] = {}

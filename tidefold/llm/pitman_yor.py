"""Language-model scores by a hierarchical Pitman-Yor model of words."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.llm.common import stored, table, words
from tidefold.session import new_shared_path

#: Strengths of the root and of contexts; discounts are estimated from counts of counts.
ROOT_STRENGTH, CONTEXT_STRENGTH = 1.0, 1.0
#: Passes that update all restaurants, samples of the last one, sweeps before the first
#: sample and between samples, and most customers of a cell reseated in a sweep.
PASSES, SAMPLES, BURN_IN, BETWEEN, RESEATED = 2, 3, 4, 2, 8
SEED = 23
#: Added to each count by the unigram base.
ADDED = 0.1
#: Tokens of a bucket of words, of a pack of documents, and the smallest share of all
#: tokens from which a word is split by context (at most one over it such words).
BUCKET_TOKENS, PACK_TOKENS, LEAST_SPLIT_SHARE = 4_000_000, 1_000_000, 1e-6
#: Occurrences in a pack up to which a word is not counted as a frequent one.
LEAST_COUNTED = 4

#: Bits of the number of a context in its bucket.
_CONTEXT_BITS = np.int64(32)
_END = xxhash.xxh3_64_intdigest(b"\n")  # no word holds a line end
_PACK_DOCS = 50_000


def squeezed(values: np.ndarray, steps: bool = False) -> bytes:
    """The array as compressed bytes, those of equal place together; ``steps``: differences to the value before."""
    if steps:
        values = np.diff(values, prepend=values.dtype.type(0))
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def opened(data: bytes, kind: type, steps: bool = False) -> np.ndarray:
    """The array that ``squeezed`` was given."""
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
    planes = np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    values = np.ascontiguousarray(planes.T).view(kind).ravel()
    return np.cumsum(values, dtype=kind) if steps else values


class _Vocabulary(dict):
    """Numbers of the words of a pack, in order of appearance."""

    def __init__(self):
        super().__init__({b"\n": 0})
        self.hashes = [_END]

    def __missing__(self, word):
        number = self[word] = len(self)
        self.hashes.append(xxhash.xxh3_64_intdigest(word))
        return number


@dataclass
class _Pack:
    ids: list
    held: list
    lengths: list
    tokens: np.ndarray  # numbers of words, documents end to end, each with its end token
    hashes: np.ndarray


def _is_held(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[_Pack]:
    def fresh():
        return _Vocabulary(), [], [], [], []

    vocabulary, ids, held, lengths, parts = fresh()
    for batch in batches:
        for id_, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            split = words(text.as_py() or "")
            numbers = np.fromiter(map(vocabulary.__getitem__, split), np.int32, len(split))
            parts += [numbers, np.zeros(1, np.int32)]
            ids.append(id_)
            held.append(_is_held(id_))
            lengths.append(len(split) + 1)
            if sum_reached(lengths) or len(ids) >= _PACK_DOCS:
                yield _Pack(ids, held, lengths, np.concatenate(parts), np.array(vocabulary.hashes, np.uint64))
                vocabulary, ids, held, lengths, parts = fresh()
    if ids:
        yield _Pack(ids, held, lengths, np.concatenate(parts), np.array(vocabulary.hashes, np.uint64))


def sum_reached(lengths: list) -> bool:
    # checked now and then only, so that a pack costs one pass
    return len(lengths) % 64 == 0 and sum(lengths) >= PACK_TOKENS


def _bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes >> np.uint64(20)) % np.uint64(buckets)


def _labels(spark: SparkSession, buckets: int) -> np.ndarray:
    """A number for each bucket, such that Spark deals them by hash to as many tasks, one to each."""
    n = 4 * buckets
    while True:
        rows = spark.range(n).select(F.col("id").cast("int").alias("label")).groupBy(
            F.pmod(F.hash("label"), F.lit(buckets))).agg(F.min("label").alias("label")).toArrow()
        if rows.num_rows == buckets:
            return np.sort(rows.column("label").to_numpy())
        n *= 2


def _packed(docs: DataFrame, buckets: int, split: dict[int, int]) -> DataFrame:
    """Tokens by bucket of their word and by pack of documents, as arrays.

    The context of a token is the word before, by its whole hash: a row lists its distinct contexts,
    the frequent ones first, and each token has a place in that list. A frequent word (``split``:
    its number of parts) is spread by context, so that a cell (word and context) is always in one bucket.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((split, _labels(spark, buckets)))
    schema = pa.schema([("bucket", pa.int32()), ("pack", pa.int64()), *((n, pa.binary()) for n in _ARRAYS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        split, labels = sent.value
        for k, pack in enumerate(_packs(batches)):
            n = len(pack.tokens)
            lengths = np.array(pack.lengths)
            doc = np.repeat(np.arange(len(lengths), dtype=np.uint16), lengths)
            before = np.empty(n, np.int32)
            before[1:] = pack.tokens[:-1]
            before[0] = 0
            # the end of the document before starts one: contexts of first words are equal
            parts = np.array([split.get(h, 1) for h in pack.hashes.tolist()], np.uint64)
            home = _bucket_of(pack.hashes, buckets)
            bucket = home[pack.tokens]
            spread = parts[pack.tokens]
            many = spread > 1
            if many.any():
                step = (pack.hashes[before[many]] >> np.uint64(11)) % spread[many]
                bucket[many] = (bucket[many] + step * np.uint64(0x5BD1E995)) % np.uint64(buckets)
            rank = np.empty(len(pack.hashes), np.int64)
            rank[np.argsort(pack.hashes)] = np.arange(len(pack.hashes))
            word = rank[pack.tokens]
            order = np.argsort(bucket.astype(np.int64) * len(rank) + word, kind="stable")
            sorted_hashes = np.sort(pack.hashes)
            bucket, word, context, doc = bucket[order], word[order], rank[before[order]], doc[order]
            held = np.packbits(np.array(pack.held)).tobytes()
            edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
            name = part << 32 | k
            rows = [(  # the documents themselves
                -1 - name % buckets, name, squeezed(np.array([i or 0 for i in pack.ids], np.int64)),
                squeezed(lengths.astype(np.int64)), squeezed(np.array([i is None for i in pack.ids])), b"", b"", held,
            )]
            for a, b in zip(edges[:-1], edges[1:]):
                starts = np.flatnonzero(np.concatenate([[True], word[a + 1 : b] != word[a : b - 1]]))
                counts = np.diff(np.append(starts, b - a)).astype(np.uint32)
                contexts, places, times = np.unique(context[a:b], return_inverse=True, return_counts=True)
                frequent = np.argsort(-times, kind="stable")
                place = np.empty(len(contexts), np.uint32)
                place[frequent] = np.arange(len(contexts))
                rows.append((
                    int(labels[int(bucket[a])]), name, squeezed(sorted_hashes[word[a:b][starts]], True), squeezed(counts),
                    squeezed(sorted_hashes[contexts[frequent]], True), squeezed(place[places]),
                    squeezed(doc[a:b], True), held,
                ))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(
        run, "bucket int, pack long, " + ", ".join(f"{n} binary" for n in _ARRAYS)
    )


#: Arrays of a pack's tokens in a bucket; of the documents themselves ids, lengths, nulls and ``held``.
_ARRAYS = ("words", "counts", "heads", "contexts", "docs", "held")


@dataclass
class _Bucket:
    """Cells (word and context, sorted) of a bucket."""

    words: np.ndarray  # distinct hashes
    contexts: np.ndarray  # distinct hashes
    word: np.ndarray  # of each cell
    context: np.ndarray  # of each cell
    count: np.ndarray  # training tokens of each cell


def _built(rows: pa.Table) -> tuple[list[bytes], list[bytes]]:
    """The arrays of a bucket's cells and of its tokens, of its rows from all packs."""
    rows = rows.sort_by("pack")
    n, names = rows.num_rows, rows.column("pack").to_numpy()

    def each(name: str, kind: type, steps: bool = False) -> Iterator[np.ndarray]:
        return (opened(x.as_py(), kind, steps) for x in rows.column(name))

    words, w_place = _numbered(list(each("words", np.uint64, True)))
    contexts, c_place = _numbered(list(each("heads", np.uint64, True)))
    key = np.concatenate([
        np.repeat(w, counts) << _CONTEXT_BITS | c[context]
        for w, counts, c, context in zip(w_place, each("counts", np.uint32), c_place, each("contexts", np.uint32))
    ])
    del w_place, c_place
    docs = list(each("docs", np.uint16, True))
    held = (np.unpackbits(np.frombuffer(x.as_py(), np.uint8)).astype(bool) for x in rows.column("held"))
    trained = np.concatenate([~h[doc] for h, doc in zip(held, docs)])
    pack = np.repeat(np.arange(n, dtype=np.uint32), [len(doc) for doc in docs])
    docs = np.concatenate(docs)
    del rows
    pa.default_memory_pool().release_unused()
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    cells = key[starts]
    del key
    return [
        squeezed(words, True), squeezed(contexts, True),
        squeezed(np.bincount(cells >> _CONTEXT_BITS, minlength=len(words)).astype(np.uint32)),
        squeezed((cells & (1 << _CONTEXT_BITS) - 1).astype(np.uint32), True),
        squeezed(np.add.reduceat(trained[order], starts, dtype=np.uint32)),
    ], [
        squeezed(np.diff(np.append(starts, len(order))).astype(np.uint32)),
        squeezed(pack[order], True), squeezed(docs[order]), squeezed(names),
    ]


def _numbered(parts: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    distinct, places = np.unique(np.concatenate(parts), return_inverse=True)
    return distinct, np.split(places.astype(np.int64), np.cumsum([len(p) for p in parts])[:-1])


def _bucket(rows: pa.Table) -> _Bucket:
    words, contexts, cells, context, count = rows.column("cells")[0].as_py()
    words, contexts = opened(words, np.uint64, True), opened(contexts, np.uint64, True)
    return _Bucket(
        words, contexts, np.repeat(np.arange(len(words)), opened(cells, np.uint32)),
        opened(context, np.uint32, True).astype(np.int64), opened(count, np.uint32).astype(np.int64),
    )


def _states(packed: DataFrame, buckets: int) -> DataFrame:
    """``bucket``, and as lists of arrays ``cells``, ``tokens`` (of which scores alone are made) and, for negative
    buckets, the ``documents`` of their packs.

    Packs' rows move once. States are a table in the shared folder that Spark knows to be dealt by
    bucket, so that they stay where they are in all passes; the catalog forgets its name at once.
    """
    kinds = ("cells", "tokens", "documents")
    schema = pa.schema([("bucket", pa.int32()), *((kind, pa.list_(pa.binary())) for kind in kinds)])

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        name = key[0].as_py()
        if name >= 0:
            return _table([(name, *_built(rows), None)], schema)
        arrays = [x for row in rows.to_pylist() for x in (squeezed(np.array([row["pack"]])), *(row[n] for n in _DOCUMENTS))]
        return _table([(name, None, None, arrays)], schema)

    spark = packed.sparkSession
    path = new_shared_path(spark, "buckets")
    name = "tidefold_" + path[-32:]
    states = packed.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(
        run, "bucket int, " + ", ".join(f"{kind} array<binary>" for kind in kinds))
    states.write.bucketBy(buckets, "bucket").option("path", path).option("compression", "none").saveAsTable(name)
    states = spark.table(name)
    spark.sql(f"drop table {name}")
    return states


_DOCUMENTS = ("words", "counts", "heads", "held")


@lru_cache(maxsize=2)
def lone_rates(discount: float, most: int = 200) -> np.ndarray:
    """Chance that one of c customers at t tables sits alone: S(c-1, t-1) / S(c, t) of the
    generalized Stirling numbers, by rows of c and columns of t."""
    log = np.full((most + 1, most + 2), -np.inf)
    log[0, 0] = 0.0
    rates = np.zeros((most + 1, most + 2))
    t = np.arange(1, most + 2)
    for c in range(1, most + 1):
        weight = np.maximum(c - 1 - discount * t, 0)
        with np.errstate(divide="ignore"):
            log[c, 1:] = np.logaddexp(log[c - 1, :-1], np.log(weight) + log[c - 1, 1:])
        filled = np.isfinite(log[c, 1:])
        rates[c, 1:][filled] = np.exp(log[c - 1, :-1][filled] - log[c, 1:][filled])
    return rates


def sweep(counts: np.ndarray, tables: np.ndarray, pull: np.ndarray, discount: float,
          random: np.random.Generator) -> None:
    """One Gibbs sweep over cells of two customers or more, in place.

    ``pull`` is the weight of a new table: (strength + discount * tables of the
    restaurant) * probability in its parent. A step takes a customer away, who leaves an
    empty table with the chance that the seating of c customers at t tables gives, and
    seats the customer again. At most ``RESEATED`` customers of a cell move in a sweep.
    """
    rates = lone_rates(discount)
    most = len(rates) - 1
    for step in range(RESEATED):
        live = np.flatnonzero(counts > max(step, 1))
        if not len(live):
            return
        c, t, a = counts[live], tables[live], pull[live]
        small = c <= most
        lone = np.where(
            small, rates[np.where(small, c, 0), np.where(small, t, 0)], discount * (t - 1) / c
        )
        t = t - (random.random(len(c)) < lone)
        new = random.random(len(c)) * (a + c - 1 - discount * t) < a
        tables[live] = t + (new | (t == 0))


@dataclass
class _Shared:
    """What all buckets share; its size is that of the split words."""

    types: int
    discounts: tuple[float, float]  # of the root and of contexts
    root: np.ndarray  # customers of the root in each sample
    split: dict[int, np.ndarray]  # split word -> training count, root customers in each sample


def _root(sums: np.ndarray, customers: float, shared: _Shared) -> np.ndarray:
    """Probabilities of words in the root by their root customers; 0: of all unknown words.

    The base is spread over endless words: each type has one root table, and what is
    left for new ones is the probability of the class of words never seen.
    """
    d = shared.discounts[0]
    known = np.maximum(sums - d, 0) / (ROOT_STRENGTH + customers)
    unknown = (ROOT_STRENGTH + d * shared.types) / (ROOT_STRENGTH + customers)
    return np.where(sums > 0, known, unknown)


def _by_word(b: _Bucket, per_cell: np.ndarray, shared: _Shared | None, place: int) -> np.ndarray:
    """Sums by word; those of split words over all buckets. place: 0 counts, else sample."""
    sums = np.bincount(b.word, per_cell, len(b.words))
    if shared and shared.split:
        for i in _split_places(b, shared):
            sums[i] = shared.split[int(b.words[i])][place]
    return sums


def _split_places(b: _Bucket, shared: _Shared) -> list[int]:
    listed = np.fromiter(shared.split, np.uint64, len(shared.split))
    return np.flatnonzero(np.isin(b.words, listed)).tolist()


def _samples(b: _Bucket, key: int, number: int, shared: _Shared, held: np.ndarray) -> list[np.ndarray]:
    """Tables of each cell in each sample of a pass; the same whenever it runs. ``held``: tables of the
    bucket's contexts before the pass, in each sample."""
    random = np.random.default_rng([SEED, number, key])
    d = shared.discounts[1]
    of_context = CONTEXT_STRENGTH + d * held.mean(axis=0)[b.context]
    root = shared.root.mean()
    tables = (b.count > 0).astype(np.int64)

    def pull():
        return of_context * _root(_by_word(b, tables, shared, 1), root, shared)[b.word]

    a = pull()
    start = np.round(1 + a * np.log((a + b.count) / (a + 1)))
    tables = np.where(b.count > 0, np.clip(start, 1, np.maximum(b.count, 1)), 0).astype(np.int64)
    found = []
    for n in [BURN_IN] + [BETWEEN] * (SAMPLES - 1):
        for _ in range(n):
            sweep(b.count, tables, pull(), d, random)
        found.append(tables.copy())
    return found


#: Parts of sums that go to the driver; others are ranges of contexts.
_WORD, _TOTAL = -1, -2
_SENT = "part int, bucket int, keys binary, sums binary"
_SENT_SCHEMA = pa.schema([
    ("part", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("sums", pa.binary())])


def _sends(b: _Bucket, bucket: int, parts: int, contexts: np.ndarray, words: np.ndarray, by_word: list[np.ndarray],
           totals: list[int], per_cell: list[np.ndarray]) -> pa.Table:
    """What a bucket sends: sums of its contexts, to the ranges of hashes that have them, and sums of
    split words and of all, to the driver. ``contexts``: hashes, or their places in their range."""
    sums = np.stack([np.bincount(b.context, v, len(b.contexts)) for v in per_cell]).astype(np.int64)
    first = np.searchsorted(_part_of(b.contexts, parts), np.arange(parts + 1)).tolist()
    rows = [(p, bucket, squeezed(contexts[x:y], True), squeezed(sums[:, x:y]))
            for p, (x, y) in enumerate(zip(first[:-1], first[1:])) if x < y]
    rows.append((_TOTAL, bucket, squeezed(np.arange(len(totals), dtype=np.uint64)), squeezed(np.array(totals, np.int64))))
    if len(words):
        rows.append((_WORD, bucket, squeezed(words, True), squeezed(np.stack(by_word).astype(np.int64))))
    return _table(rows, _SENT_SCHEMA)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array([row[i] for row in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _exchanged(sends: DataFrame, name: str) -> tuple[DataFrame, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Sums over all buckets: a table in which each bucket has those of its own contexts, in their order,
    with their places in their range, and on the driver keys and sums of split words and totals.

    Contexts are added up by ranges of their hashes, so neither the driver nor a task holds all of them.
    """
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        part = key[0].as_py()
        listed = rows.sort_by("bucket").to_pylist()
        keys = [opened(row["keys"], np.uint64, True) for row in listed]
        distinct, places = _numbered(keys)
        sums = np.concatenate([opened(row["sums"], np.int64).reshape(-1, len(k)) for row, k in zip(listed, keys)], axis=1)
        place = np.concatenate(places)
        added = np.stack([np.bincount(place, v, len(distinct)) for v in sums]).astype(np.int64)
        if part < 0:
            return _table([(0, part, squeezed(distinct, True), squeezed(added))], _SENT_SCHEMA)
        return _table([
            (part, row["bucket"], squeezed(own.astype(np.uint64), True), squeezed(added[:, own]))
            for row, own in zip(listed, places)
        ], _SENT_SCHEMA)

    replies = stored(sends.groupBy("part").applyInArrow(run, _SENT), name)
    found = {}
    for row in replies.where("bucket < 0").collect():
        keys = opened(row["keys"], np.uint64, True)
        found[row["bucket"]] = keys, opened(row["sums"], np.int64).reshape(-1, len(keys))
    return replies.where("bucket >= 0"), found


def _own(replies: pa.Table, sums: int) -> np.ndarray:
    """The ``sums`` of each of a bucket's contexts that replies from all parts hold."""
    rows = replies.sort_by("part").column("sums").to_pylist()
    return np.concatenate([opened(row, np.int64).reshape(sums, -1) for row in rows], axis=1)


def _places(replies: pa.Table) -> np.ndarray:
    """The places of a bucket's contexts in their ranges: shorter keys than hashes."""
    rows = replies.sort_by("part").column("keys").to_pylist()
    return np.concatenate([opened(row, np.uint64, True) for row in rows])


def _counts(buckets: DataFrame, split: dict[int, int], parts: int) -> tuple[int, _Shared, DataFrame]:
    """Number of training tokens, the state in which every cell has one table, and customers and
    tables of contexts in it."""
    listed = np.fromiter(split, np.uint64, len(split))

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        b = _bucket(rows)
        seen = np.minimum(b.count, 1)
        count, wide = _by_word(b, b.count, None, 0), _by_word(b, seen, None, 0)
        over = np.isin(b.words, listed)
        own = ~over & (count > 0)
        totals = [b.count.sum(), own.sum(), (b.count == 1).sum(), (b.count == 2).sum(),
                  (wide[own] == 1).sum(), (wide[own] == 2).sum(), seen.sum()]
        return _sends(b, key[0].as_py(), parts, b.contexts, b.words[over], [count[over], wide[over]], totals, [b.count, seen])

    replies, found = _exchanged(buckets.groupBy("bucket").applyInArrow(run, _SENT), "contexts")
    totals = found[_TOTAL][1][0] if found else np.zeros(7, np.int64)
    words_, values = found.get(_WORD, (np.empty(0, np.uint64), np.empty((2, 0))))
    spread = {int(h): np.array([v[0], *[v[1]] * SAMPLES]) for h, v in zip(words_, values.T) if v[0]}

    def discount(once: int, twice: int) -> float:  # the estimate of Ney, Essen and Kneser
        return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5

    return int(totals[0]), _Shared(
        int(totals[1]) + len(spread), (discount(totals[4], totals[5]), discount(totals[2], totals[3])),
        np.full(SAMPLES, float(totals[6])), spread,
    ), replies


def _resampled(buckets: DataFrame, number: int, before: _Shared, held: DataFrame, sums: int,
               parts: int) -> tuple[_Shared, DataFrame]:
    """The shared state after a pass of Gibbs sampling from the state before it, and the tables of
    contexts. ``held``: replies of ``sums`` sums whose last ones are tables before the pass."""
    sent = buckets.sparkSession.sparkContext.broadcast(before)

    def run(key: tuple, rows: pa.Table, replies: pa.Table) -> pa.Table:
        b, name = _bucket(rows), key[0].as_py()
        found = _samples(b, name, number, sent.value, _own(replies, sums)[-SAMPLES if number else -1:])
        places = _split_places(b, sent.value)
        by_word = [np.bincount(b.word, t, len(b.words))[places] for t in found]
        return _sends(b, name, parts, _places(replies), b.words[places], by_word, [t.sum() for t in found], found)

    replies, found = _exchanged(
        buckets.groupBy("bucket").cogroup(held.groupBy("bucket")).applyInArrow(run, _SENT), "contexts")
    split = dict(before.split)
    words_, values = found.get(_WORD, (np.empty(0, np.uint64), np.empty((SAMPLES, 0))))
    for h, v in zip(words_, values.T):
        split[int(h)] = np.array([before.split[int(h)][0], *v])
    root = found[_TOTAL][1][0].astype(float) if found else np.zeros(SAMPLES)
    return _Shared(before.types, before.discounts, root, split), replies


def _scored(buckets: DataFrame, number: int, before: _Shared, after: _Shared, trained: int,
            counts: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Sums of each bucket for each document of each pack that has tokens in it. ``counts``, ``old`` and
    ``new``: replies with customers of contexts, with their tables before and after the last pass."""
    sent = buckets.sparkSession.sparkContext.broadcast((before, after))
    schema = pa.schema([("pack", pa.int64()), *((n, pa.binary()) for n in _SCORES)])
    first = 2 if number == 0 else SAMPLES

    def run(key: tuple, rows: pa.Table, replies: pa.Table) -> pa.Table:
        old, new = sent.value
        b, name = _bucket(rows), key[0].as_py()
        customers = _own(replies.filter(pc.equal(replies.column("pass"), 0)), 2)[0][b.context]
        tables_before, tables_after = (
            _own(replies.filter(pc.equal(replies.column("pass"), i)), n) for i, n in ((1, first), (2, SAMPLES)))
        count = _by_word(b, b.count, new, 0)
        base = np.log10((count + ADDED) / (trained + ADDED * (new.types + 1)))[b.word]
        d = new.discounts[1]
        total = np.zeros(len(b.count))
        for k, tables in enumerate(_samples(b, name, number, old, tables_before[-SAMPLES if number else -1:])):
            root = _root(_by_word(b, tables, new, k + 1), new.root[k], new)[b.word]
            held = tables_after[k][b.context]
            total += np.where(
                customers > 0,
                (b.count - d * tables + (CONTEXT_STRENGTH + d * held) * root) / (CONTEXT_STRENGTH + customers),
                root,
            )
        per_cell = (count > 0)[b.word], base, np.log10(total / SAMPLES)
        data = rows.column("tokens")[0].as_py()
        del b, base, count, customers, total, tables, root, held, tables_before, tables_after, rows, replies
        documents, sums, names = _by_document(data, per_cell)
        edges = np.searchsorted(documents >> 16, np.arange(len(names) + 1)).tolist()
        return _table([(
            int(names[i]), squeezed((documents[x:y] & 0xFFFF).astype(np.uint16), True),
            *(squeezed(v[x:y]) for v in sums),
        ) for i, (x, y) in enumerate(zip(edges[:-1], edges[1:]))], schema)

    replies = reduce(DataFrame.unionByName, [r.drop("keys").withColumn("pass", F.lit(i)) for i, r in enumerate((counts, old, new))])
    return buckets.groupBy("bucket").cogroup(replies.groupBy("bucket")).applyInArrow(
        run, "pack long, " + ", ".join(f"{n} binary" for n in _SCORES))


def _by_document(data: list[bytes], per_cell: tuple[np.ndarray, ...]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Documents of a bucket's tokens, as numbers of packs times 2^16 and places in them, the sums of the values
    of their tokens' cells, and the packs' names."""
    names = opened(data[3], np.int64)
    kind = np.uint32 if len(names) <= 1 << 16 else np.uint64
    document = opened(data[1], np.uint32, True).astype(kind) << kind(16) | opened(data[2], np.uint16)
    order = np.argsort(document, kind="stable")
    document = document[order]
    size = opened(data[0], np.uint32)
    cell = np.repeat(np.arange(len(size), dtype=np.uint32), size)[order]
    del order
    starts = np.flatnonzero(np.append(True, document[1:] != document[:-1]))
    known, *scores = (np.add.reduceat(v[cell], starts, dtype=np.int32 if v.dtype == bool else float) for v in per_cell)
    return document[starts].astype(np.int64), [known, *(np.round(v * _POINT).astype(np.int64) for v in scores)], names


#: Scores of documents are added up as numbers of 2^-32, which is exact in any order and shorter than doubles.
_POINT = 2.0**32
#: Arrays of a bucket's sums for the documents of a pack.
_SCORES = ("docs", "known", "base", "score")


def _per_document(scored: DataFrame, packs: DataFrame, trained: int) -> DataFrame:
    """Adds up a pack's sums and gives its documents their rows."""
    schema = pa.schema([
        ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
        ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()),
    ])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        own = left.to_pylist()[0]
        ids, lengths = opened(own["words"], np.int64), opened(own["counts"], np.int64)
        n = len(ids)
        known, base, score = np.zeros((3, n), np.int64)
        for row in right.to_pylist():
            docs = opened(row["docs"], np.uint16, True)
            known[docs] += opened(row["known"], np.int32)
            base[docs] += opened(row["base"], np.int64)
            score[docs] += opened(row["score"], np.int64)
        return pa.table([
            pa.array(ids, mask=opened(own["heads"], np.bool_)),
            pa.array(np.unpackbits(np.frombuffer(own["held"], np.uint8), count=n).astype(bool)),
            pa.array(lengths), pa.array(known), pa.array(np.full(n, trained, np.int64)),
            pa.array(base / _POINT), pa.array(score / _POINT),
        ], schema=schema)

    return packs.groupBy("pack").cogroup(scored.groupBy("pack")).applyInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long,"
        " base_score double, score double"
    )


def _documents(state: DataFrame) -> DataFrame:
    """A row for each pack, of the states of negative buckets."""
    schema = pa.schema([("pack", pa.int64()), *((n, pa.binary()) for n in _DOCUMENTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for arrays in batch.column("documents"):
                found, size = arrays.as_py(), 1 + len(_DOCUMENTS)
                rows = [found[i : i + size] for i in range(0, len(found), size)]
                yield from _table([(int(opened(name, np.int64)[0]), *data) for name, *data in rows], schema).to_batches()

    return state.where("bucket < 0").select("documents").mapInArrow(
        run, "pack long, " + ", ".join(f"{n} binary" for n in _DOCUMENTS))


def _frequent(docs: DataFrame) -> tuple[int, dict[int, float]]:
    """Number of tokens, and words that fill a quarter of a bucket, with their numbers.

    Words of a share under ``LEAST_SPLIT_SHARE`` are left out, so there are at most one over it.
    A pack counts the words that it has more than ``LEAST_COUNTED`` times, which misses
    no more than that many of a word in a pack; counts are added up before they move, and
    stored, as texts are read for them.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack in _packs(batches):
            counts = np.bincount(pack.tokens, minlength=len(pack.hashes))
            some = counts > LEAST_COUNTED
            yield pa.RecordBatch.from_pydict({
                "hash": pa.array(np.append(pack.hashes[some].view(np.int64), 0)),
                "n": pa.array(np.append(counts[some], len(pack.tokens))),
                "whole": pa.array([False] * int(some.sum()) + [True]),
            })

    sums = stored(docs.select("doc_id", "text").mapInArrow(run, "hash long, n long, whole boolean").groupBy(
        "hash", "whole").agg(F.sum("n").alias("n")), "sums")
    total = sums.where("whole").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = max(1, BUCKET_TOKENS // 4, int(total * LEAST_SPLIT_SHARE))
    rows = sums.where(~F.col("whole") & (F.col("n") >= least)).collect()
    return total, {r["hash"] & (1 << 64) - 1: r["n"] for r in rows}


def score_texts(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and
    ``score`` of each row of ``docs``.

    The model is a two-level hierarchy: one restaurant for each context (the word before,
    by its 64-bit hash), all with the root as parent. Documents with crc32 of their id
    mod 10 not 0 train it. Tokens move once, packed as arrays, to the bucket of their
    word; a frequent word is spread over buckets by context. A bucket thus has whole
    cells, samples their tables by Gibbs steps, and needs from others only sums by
    spread word, whose number is bounded, and sums of its own contexts: after each pass
    buckets send theirs to tasks by ranges of contexts, which add them up and send them
    back. The predictive probabilities of
    the samples of the last pass are averaged; each sample's sum to one. A word never
    seen in training is of one class of unknown words, as in the base.

    Null and empty texts have the end token alone. A null id is never held out. Repeated
    rows count as often as they occur. Without training tokens all words are unknown.
    Other columns are not read.
    """
    spark = docs.sparkSession
    total, frequent = _frequent(docs)
    buckets = max(1, -(-total // BUCKET_TOKENS))
    split = {h: -(-n * 4 // BUCKET_TOKENS) for h, n in frequent.items() if n * 4 > BUCKET_TOKENS}
    state = _states(_packed(docs, buckets, split), buckets)
    state, packs = state.where("bucket >= 0"), _documents(state)
    cells = state.select("bucket", "cells")
    trained, shared, counts = _counts(cells, split, buckets)
    replies, sums = counts, 2
    for number in range(PASSES):
        before, old = shared, replies
        shared, replies = _resampled(cells, number, before, old, sums, buckets)
        sums = SAMPLES
    scored = _scored(state.select("bucket", "cells", "tokens"), PASSES - 1, before, shared, trained, counts, old, replies)
    return _per_document(scored, packs, trained)


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents under the unigram base and the model."""
    return score_texts(table(spark, sf_dir, "documents"))


QUERIES = {"op9_lm_scores": op9_lm_scores}
SQL: dict[str, str] = {}

"""Packing documents into windows with their lexical neighbours (BM25)."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.llm.common import chunks_of, key_groups, odd_numbers, stored, table

#: Ids of a sequence, and the id that ends a document.
WINDOW = 2048
END = 1
#: Documents of a shard on average.
SHARD_DOCS = 4096
#: BM25 parameters; a term in more than this share of a shard's documents has a column
#: instead of a list.
K1, B = 1.2, 0.75
COMMON = 0.1
#: Numbers of a document's projection; documents that the split of shards is found on,
#: for each shard and at most; bytes of ids worked at once.
DIMENSIONS = 64
SPLIT_DOCS, MOST_SPLIT_DOCS = 64, 65_536
_SLICE = 1 << 21

#: Bytes of ids of a shard, about, but for a longer document; bytes of text encoded at once.
SHARD_BYTES = 16 << 20
#: Shards of a task, where they are more than the session's partitions.
TASK_SHARDS = 16
_TEXT_SLICE = 8 << 20

#: Texts whose words cannot be encoded one by one (RE2): with control characters, spaces
#: other than the single one and the line end, or several of these in a row.
_ODD_SPACE = (
    r"[\x00-\x09\x0b-\x1f\x7f-\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
    r"|[ \n][ \n]"
)


def default_ranks() -> str:
    """Path of the public byte-level BPE vocabulary, as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """The vocabulary, with the bytes that each id stands for."""

    def __init__(self, ranks: bytes):
        import public_tokenizers
        import tiktoken

        parsed = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        if max(parsed.values()) >= 1 << 16:
            raise ValueError("ids are kept in 16 bits")
        self.encoding = tiktoken.Encoding(
            "public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=parsed, special_tokens={})
        self.sizes = np.zeros(1 << 16, np.int64)
        self.sizes[list(parsed.values())] = list(map(len, parsed))

    def function(self, text: str) -> bytes:
        """Ids of a text as unsigned 16-bit numbers."""
        return np.array(self.encoding.encode_ordinary(text), "<u2").tobytes()

    def words(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and the number of ids of each word.

        Words begin with their space or are parted by a line end, so one text holds them
        all; the bytes of the ids tell where a word ends.
        """
        parted = pc.if_else(pc.starts_with(distinct, " "), distinct, pc.binary_join_element_wise("\n", distinct, ""))
        text = pc.binary_join(pa.ListArray.from_arrays([0, len(parted)], parted), "")[0].as_py()
        ids = np.array(self.encoding.encode_ordinary(text), np.int64)
        ends = np.cumsum(pc.binary_length(parted).to_numpy(zero_copy_only=False))
        last = np.searchsorted(np.cumsum(self.sizes[ids]), ends, side="left") + 1
        last[ends == 0] = 0
        spaced = pc.starts_with(distinct, " ").to_numpy(zero_copy_only=False)
        first = np.concatenate([[0], last[:-1]])
        keep = np.ones(len(ids), bool)
        keep[first[~spaced]] = False  # the line ends between words
        return ids[keep].astype("<u2"), last - first - ~spaced


@lru_cache(maxsize=2)
def _encoder(ranks: bytes) -> Encoder:
    return Encoder(ranks)


def encode_texts(texts: pa.Array, encoder: Encoder, end: bytes = b"") -> pa.Array:
    """Ids of each text as unsigned 16-bit numbers, then ``end``; null is empty.

    The vocabulary's pattern never joins what lies on both sides of a single space or
    line end, so the distinct words (with the space ahead) of all texts are encoded once.
    Texts with other spaces are encoded whole.
    """
    texts = pc.fill_null(texts, "")
    odd = pc.match_substring_regex(texts, _ODD_SPACE)
    plain = pc.if_else(odd, "", texts)
    marked = pc.replace_substring(pc.replace_substring(plain, " ", "\x00 "), "\n", "\x00\n\x00")
    split = pc.split_pattern(marked, "\x00")
    coded = split.flatten().dictionary_encode()
    number = coded.indices.to_numpy(zero_copy_only=False)
    distinct = coded.dictionary
    # the empty word and the line end itself are no words to part
    line = pc.equal(distinct, "\n")
    own = pc.invert(pc.or_(line, pc.equal(distinct, "")))
    ids, counts = np.empty(0, "<u2"), np.zeros(len(distinct), np.int64)
    if pc.any(own).as_py():
        ids, counts[own.to_numpy(zero_copy_only=False)] = encoder.words(distinct.filter(own))
    starts = np.cumsum(counts) - counts
    for at in np.flatnonzero(line.to_numpy(zero_copy_only=False)):
        alone = np.frombuffer(encoder.function("\n"), "<u2")
        starts[at], counts[at] = len(ids), len(alone)
        ids = np.concatenate([ids, alone])
    lengths = counts[number]
    ends = np.cumsum(lengths)
    flat = ids[np.repeat(starts[number] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
    bounds = np.concatenate([[0], ends])[split.offsets.to_numpy()].tolist()
    whole = odd.to_numpy(zero_copy_only=False)
    found = [flat[2 * a : 2 * b] + end for a, b in zip(bounds[:-1], bounds[1:])]
    for i in np.flatnonzero(whole).tolist():
        found[i] = encoder.function(texts[i].as_py()) + end
    return pa.array(found, pa.binary())


def encode(text: str, encoder: Encoder) -> bytes:
    """Ids of one text as unsigned 16-bit numbers."""
    return encode_texts(pa.array([text], pa.string()), encoder)[0].as_py()


def _encoded(docs: DataFrame, ranks: bytes) -> DataFrame:
    """``mark`` (a hash of id and text), ``doc_id`` and ``ids`` (with the end id) of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(ranks)
    schema = pa.schema([("mark", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.binary())])
    end = np.array([END], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(sent.value)
        for batch in batches:
            for part in chunks_of(batch, "text", _TEXT_SLICE):
                ids = encode_texts(part.column("text"), encoder, end)
                yield pa.record_batch([part.column("mark"), part.column("doc_id"), ids], schema=schema)

    return docs.select(F.xxhash64("doc_id", "text").alias("mark"), "doc_id", "text").mapInArrow(
        run, "mark long, doc_id long, ids binary")


def _postings(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, term and frequency of each distinct term of each document, in order."""
    lengths = [len(d) for d in docs]
    key = np.repeat(np.arange(len(docs)), lengths) << 16 | np.concatenate(docs).astype(np.int64)
    key.sort()
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[starts] >> 16, key[starts] & 0xFFFF, np.diff(np.append(starts, len(key)))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for part in chunks_of(batch, "ids", _SLICE):
            yield part, [np.frombuffer(v.as_py(), "<u2") for v in part.column("ids")]


class Totals:
    """Documents, mean length and document frequency of each id over all documents."""

    def __init__(self, n: int, mean: float, df: np.ndarray):
        self.n, self.mean, self.df = n, mean, df

    @classmethod
    def of(cls, docs: list[np.ndarray]) -> Totals:
        return cls(len(docs), sum(map(len, docs)) / len(docs), np.bincount(_postings(docs)[1], minlength=1 << 16))

    def idf(self) -> np.ndarray:
        return np.log1p((self.n - self.df + 0.5) / (self.df + 0.5))


def _totals(encoded: DataFrame) -> Totals:
    """Totals of the table: one row of counts (64 K ids) a partition, summed by id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(1 << 16, np.int64)
        for _, docs in _slices(batches):
            df += np.bincount(_postings(docs)[1], minlength=1 << 16)
        term = np.flatnonzero(df)
        yield pa.record_batch([pa.array(term.astype(np.int32)), pa.array(df[term])], names=["term", "df"])

    n, length = encoded.agg(F.count("*"), F.sum(F.length("ids"))).first()
    rows = encoded.select("ids").mapInArrow(run, "term int, df long").groupBy("term").agg(
        F.sum("df").alias("df")).toArrow()
    df = np.zeros(1 << 16, np.int64)
    df[rows.column("term").to_numpy()] = rows.column("df").to_numpy()
    return Totals(n, (length or 0) / 2 / max(n, 1), df)


def projections(docs: list[np.ndarray], totals: Totals) -> np.ndarray:
    """A row of ``DIMENSIONS`` numbers a document: its BM25 weights times a matrix of random
    signs, of length 1. Its products follow the likeness of the documents' weights."""
    doc, term, tf = _postings(docs)
    lengths = np.array([len(d) for d in docs])
    weight = totals.idf()[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[doc] / totals.mean))
    ends = np.searchsorted(doc, np.arange(len(docs)))
    bits = odd_numbers(1 << 16, 11) >> np.uint64(1)
    signs = np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)[:, :DIMENSIONS] * 2 - 1
    rows = np.empty((len(docs), DIMENSIONS), np.float32)
    weight = weight.astype(np.float32)
    for i, (a, b) in enumerate(zip(ends.tolist(), [*ends[1:].tolist(), len(doc)])):
        rows[i] = weight[a:b] @ signs[term[a:b]]
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def split_tree(rows: np.ndarray, leaves: int):
    """A tree of ``leaves`` leaves: rows are parted across their main direction, so that
    each side has rows in proportion to its leaves. None is a leaf."""
    if leaves < 2:
        return None
    if len(rows) < 2:
        axis, bound, left = np.ones(rows.shape[1], np.float32), 0.0, np.zeros(len(rows), bool)
    else:
        centred = (rows - rows.mean(axis=0)).astype(np.float64)
        axis = np.linalg.eigh(centred.T @ centred)[1][:, -1].astype(np.float32)
        along = rows @ axis
        bound = float(np.quantile(along, (leaves // 2) / leaves))
        left = along <= bound
    few = leaves // 2
    return axis, bound, few, split_tree(rows[left], few), split_tree(rows[~left], leaves - few)


def leaf_of(rows: np.ndarray, tree) -> np.ndarray:
    """Number of the leaf of each row."""
    found = np.zeros(len(rows), np.int64)
    if tree is not None and len(rows):
        axis, bound, few, low, high = tree
        left = rows @ axis <= bound
        found[left] = leaf_of(rows[left], low)
        found[~left] = few + leaf_of(rows[~left], high)
    return found


def _dealt(encoded: DataFrame, totals: Totals, shard_docs: int) -> tuple[DataFrame, int]:
    """``encoded`` with ``shard``: documents of like content have the same one.

    The tree is found on documents of smallest ``mark``; all documents go down it, once to
    count and once to move, so that ids are kept in one table only. A leaf of over twice
    ``shard_docs`` documents or ``SHARD_BYTES``, such as a group of copies, is dealt by
    ``mark`` over several shards, and rows of one mark in turn. Only two numbers a leaf and
    the projections of the documents that the tree is found on reach the driver. The
    second result is the number of shards.
    """
    context = encoded.sparkSession.sparkContext
    leaves = -(-totals.n // shard_docs)
    if leaves < 2:
        return encoded.select(F.lit(0).alias("shard"), "doc_id", "ids"), 1
    sent = context.broadcast(totals)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, docs in _slices(batches):
            rows = projections(docs, sent.value)
            yield pa.record_batch([part.column("mark"), pa.array([r.tobytes() for r in rows], pa.binary())],
                                  names=["mark", "row"])

    first = encoded.select("mark", "doc_id").orderBy("mark", "doc_id").limit(
        min(MOST_SPLIT_DOCS, SPLIT_DOCS * leaves)).select(F.max("mark")).first()[0]
    few = encoded.where(F.col("mark") <= first).select("mark", "ids").dropDuplicates(["mark"])
    chosen = sorted((r.mark, r.row) for r in few.mapInArrow(project, "mark long, row binary").collect())
    tree = context.broadcast(split_tree(np.array([np.frombuffer(r, np.float32) for _, r in chosen]), leaves))

    def leaves_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        for part, docs in _slices(batches):
            yield part, leaf_of(projections(docs, sent.value), tree.value)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, size = np.zeros(leaves, np.int64), np.zeros(leaves, np.int64)
        for part, leaf in leaves_of(batches):
            docs += np.bincount(leaf, minlength=leaves)
            np.add.at(size, leaf, pc.binary_length(part.column("ids")).to_numpy(zero_copy_only=False))
        some = np.flatnonzero(docs)
        yield pa.record_batch([pa.array(some), pa.array(docs[some]), pa.array(size[some])],
                              names=["leaf", "docs", "size"])

    parts = np.ones(leaves, np.int64)
    for r in encoded.select("ids").mapInArrow(fill, "leaf long, docs long, size long").groupBy("leaf").agg(
            F.sum("docs").alias("docs"), F.sum("size").alias("size")).collect():
        parts[r["leaf"]] = max(1, -(-r["docs"] // (2 * shard_docs)), -(-r["size"] // SHARD_BYTES))
    shares = context.broadcast((np.cumsum(parts) - parts, parts))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, parts = shares.value
        for part, leaf in leaves_of(batches):
            mark = part.column("mark").to_numpy()
            order = np.argsort(mark, kind="stable")
            first = np.searchsorted(mark[order], mark[order], side="left")
            repeat = np.empty(len(mark), np.int64)
            repeat[order] = np.arange(len(mark)) - first
            shard = starts[leaf] + (mark % parts[leaf] + repeat) % parts[leaf]
            yield pa.record_batch([pa.array(shard.astype(np.int32)), part.column("doc_id"), part.column("ids")],
                                  names=["shard", "doc_id", "ids"])

    return encoded.mapInArrow(deal, "shard int, doc_id long, ids binary"), int(parts.sum())


class Neighbours:
    """A BM25 inverted index over the ids of a shard's documents."""

    def __init__(self, docs: list[np.ndarray], totals: Totals | None = None):
        totals = totals or Totals.of(docs)
        n = len(docs)
        lengths = np.array([len(d) for d in docs])
        doc, term, tf = _postings(docs)
        here = np.bincount(term, minlength=1 << 16)
        use = here[term] > 1
        doc, term, tf = doc[use], term[use], tf[use]
        weight = totals.idf()[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[doc] / totals.mean))
        weight = weight.astype(np.float32)
        # a document's terms; common ones have a column, others a list
        self.terms = term
        self.first = np.searchsorted(doc, np.arange(n + 1))
        common = np.flatnonzero(here > max(2, COMMON * n))
        self.column = np.full(1 << 16, -1)
        self.column[common] = np.arange(len(common))
        self.matrix = np.zeros((n, len(common)), np.float32)
        wide = self.column[term] >= 0
        self.matrix[doc[wide], self.column[term[wide]]] = weight[wide]
        doc, term, weight = doc[~wide], term[~wide], weight[~wide]
        by_term = np.argsort(term, kind="stable")
        self.docs, self.weights = doc[by_term], weight[by_term]
        self.ends = np.searchsorted(term[by_term], np.arange((1 << 16) + 1))

    def of(self, seed: int, unused: np.ndarray, most: int) -> list[int]:
        """Up to ``most`` unused documents by BM25 score against all terms of the seed."""
        terms = self.terms[self.first[seed] : self.first[seed + 1]]
        columns = self.column[terms]
        asked = np.zeros(self.matrix.shape[1], np.float32)
        asked[columns[columns >= 0]] = 1
        rare = terms[columns < 0]
        start, n = self.ends[rare], self.ends[rare + 1] - self.ends[rare]
        places = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
        scores = self.matrix @ asked + np.bincount(self.docs[places], self.weights[places], len(unused))
        found = np.flatnonzero(unused & (scores > 0))
        if len(found) > most:  # all that tie with the last one stay until the order is known
            least = np.partition(scores[found], len(found) - most)[len(found) - most]
            found = found[scores[found] >= least]
        return found[np.lexsort((found, -scores[found]))[:most]].tolist()


def pack(docs: list[np.ndarray], window: int = WINDOW, totals: Totals | None = None) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that fill windows to the last id.

    A window begins with what the one before left of its last document, or with the next
    unused one: its seed. Unused neighbours of the seed follow in order of score, then
    those of the last neighbour; without any, the next unused document. The document that
    reaches the end of the window is cut there.
    """
    index = Neighbours(docs, totals)
    unused = np.ones(len(docs), bool)
    pieces, sequence, offset, next_ = [], 0, 0, 0
    queue: list[int] = []
    last = None

    def put(doc: int):
        nonlocal sequence, offset
        start, n = 0, len(docs[doc])
        while start < n:
            length = min(n - start, window - offset)
            pieces.append((doc, start, length, sequence, offset))
            start, offset = start + length, offset + length
            if offset == window:
                sequence, offset = sequence + 1, 0
                queue.clear()  # the rest of this document seeds the next window
        return doc

    while True:
        while queue and not unused[queue[0]]:
            queue.pop(0)
        if not queue and last is not None and offset:
            queue = index.of(last, unused, 32)
        if queue:
            doc = queue.pop(0)
        else:
            while next_ < len(docs) and not unused[next_]:
                next_ += 1
            if next_ == len(docs):
                return pieces
            doc = next_
        unused[doc] = False
        last = put(doc)


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, ranks: str | None = None, shard_docs: int = SHARD_DOCS,
                   window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """One row for each piece of a document in a sequence of at most ``window`` ids.

    Documents are encoded, dealt by content over shards of some ``shard_docs`` (``_dealt``)
    and packed within their shard (see ``pack``), where one BM25 index with the document
    frequencies and mean length of all documents serves all its seeds. Every term counts.
    Neighbours that the dealing puts into other shards are not found. All sequences but the last of a shard are full. Only ids move, two bytes each; a shard
    has some 16 MB of ids, or one longer document. ``with_ids`` adds the piece's ids.

    Null and empty texts hold the end id alone. Repeated rows are packed as often as they
    occur, a null id is kept. ``sequence_id`` is shard * 2^32 + number. Other columns are
    not read; an empty table gives no rows. The vocabulary file is read by the driver
    only and sent to executors.
    """
    with open(ranks or default_ranks(), "rb") as file:
        content = file.read()
    spark = docs.sparkSession
    encoded = stored(_encoded(docs, content), "encoded")
    totals = _totals(encoded)
    sent = spark.sparkContext.broadcast(totals)
    dealt, shards = _dealt(encoded, totals, shard_docs)
    least = shards // TASK_SHARDS
    many = (least,) if least > int(spark.conf.get("spark.sql.shuffle.partitions")) else ()
    dealt = dealt.repartition(*many, "shard").sortWithinPartitions("shard", "doc_id", F.length("ids"))
    text = SCHEMA + (", ids array<int>" if with_ids else "")
    schema = pa.schema([(c.split(" ")[0], pa.int64()) for c in SCHEMA.split(", ")])
    if with_ids:
        schema = schema.append(pa.field("ids", pa.list_(pa.int32())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in key_groups(batches, ["shard"]):
            shard = group.column("shard")[0].as_py()
            names = group.column("doc_id").to_pylist()
            ids = [np.frombuffer(v.as_py(), "<u2") for v in group.column("ids")]
            rows = []
            for doc, start, length, sequence, offset in pack(ids, window, sent.value):
                own = ids[doc][start : start + length]
                row = (names[doc], start, length, zlib.crc32(own.astype("<u4").tobytes()), len(ids[doc]),
                       (shard << 32) + sequence, offset)
                rows.append((*row, own.tolist()) if with_ids else row)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return dealt.mapInArrow(run, text)


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 ids."""
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op8_pack": op8_pack}
SQL: dict[str, str] = {}

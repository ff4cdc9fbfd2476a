"""Line dedup: globally repeated, content-defined chunks of lines are removed, with equal lines beside them."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.llm.common import Remembered, chunks_of, stored, table

#: A chunk ends where the rolling hash of the last ``WINDOW`` lines is 0 mod ``MEAN``.
WINDOW = 2
MEAN = 3
#: A line of so many words is a chunk by itself: passages come as one line, too.
LONG_LINE = 20
#: Words that a chunk needs in order to be removed.
LEAST_WORDS = 12
#: Words of a passage in whole lines that is found whatever surrounds it.
PASSAGE_WORDS = 50

_PRIME = 0x100000001B3
_MASK = (1 << 64) - 1


def line_chunks(lines: list[str], memory: Remembered) -> list[tuple[int, int, int]]:
    """Chunks (first line, line after the last, words).

    Boundaries depend on the lines just before them only, so text put in ahead shifts
    chunks but does not change them from the next boundary on.
    """
    found, start, words, rolling = [], 0, 0, []
    for i, line in enumerate(lines):
        hash_, n = memory[line]
        if n >= LONG_LINE:
            if start < i:
                found.append((start, i, words))
            found.append((i, i + 1, n))
            start, words, rolling = i + 1, 0, []
            continue
        words += n
        rolling = [*rolling[1 - WINDOW :], hash_]
        value = 0
        for h in rolling:
            value = (value * _PRIME + h) & _MASK
        if (value >> 17) % MEAN == 0:
            found.append((start, i + 1, words))
            start, words = i + 1, 0
    if start < len(lines):
        found.append((start, len(lines), words))
    return found


def line_runs(lines: list[str], memory: Remembered) -> list[tuple[int, int, int]]:
    """The shortest runs of lines with ``LEAST_WORDS`` words from each line on, and up to each.

    Runs depend on their own lines only. Those inside a longer run cover all its lines: one
    with too few words from itself to the end and from the start to itself lies in the run
    from the start. Runs begin and end with a line that has words.
    """
    places = [i for i, line in enumerate(lines) if memory[line][1]]
    counts = [memory[lines[i]][1] for i in places]
    found = set()
    after = total = 0
    for i, n in enumerate(counts):
        while total < LEAST_WORDS and after < len(counts):
            total += counts[after]
            after += 1
        if total < LEAST_WORDS:
            break
        found.add((places[i], places[after - 1] + 1, total))
        total -= n
    first = total = 0
    for j, n in enumerate(counts):
        total += n
        while total - counts[first] >= LEAST_WORDS:
            total -= counts[first]
            first += 1
        if total >= LEAST_WORDS:
            found.add((places[first], places[j] + 1, total))
    return sorted(found)


def _spans(lines: list[str], memory: Remembered, runs: bool) -> list[tuple[int, int, int]]:
    """What may be removed of a text, in order: runs of lines, or chunks that count."""
    return line_runs(lines, memory) if runs else [c for c in line_chunks(lines, memory) if _countable(c)]


def _line_memory() -> Remembered:
    return Remembered(lambda line: (
        xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")), len(line.encode("utf-8", "surrogatepass").split())))


def _countable(chunk: tuple[int, int, int]) -> bool:
    first, after, words = chunk
    return words >= LEAST_WORDS and (after - first > 1 or words >= LONG_LINE)


def _bytes_of(lines: list[str], chunk: tuple[int, int, int]) -> bytes:
    return "\n".join(lines[chunk[0] : chunk[1]]).encode("utf-8", "surrogatepass")


def _columns(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _chunk_rows(named: DataFrame, runs: bool) -> DataFrame:
    """Place and hash of every chunk or run that may be removed."""
    schema = pa.schema([("row", pa.int64()), ("key", pa.int64()), ("chunk", pa.int32()), ("hash", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _line_memory()
        for batch in batches:
            for part in chunks_of(batch, "text"):
                rows = []
                for row, key, text in zip(*(part.column(n).to_pylist() for n in ("row", "key", "text"))):
                    lines = (text or "").split("\n")
                    rows += [
                        (row, key, k, xxhash.xxh3_64_intdigest(_bytes_of(lines, chunk)) - (1 << 63))
                        for k, chunk in enumerate(_spans(lines, memory, runs))
                    ]
                memory.trim()
                yield _columns(rows, schema)

    return named.select("row", "key", "text").mapInArrow(run, "row long, key long, chunk int, hash long")


def _bodies(named: DataFrame, suspects: DataFrame, runs: bool) -> DataFrame:
    """The bytes of suspected chunks or runs."""
    schema = pa.schema([("row", pa.int64()), ("key", pa.int64()), ("chunk", pa.int32()), ("body", pa.binary())])
    wanted = suspects.groupBy("row").agg(F.collect_list("chunk").alias("chunks"))
    joined = named.select("row", "key", "text").join(wanted.hint("shuffle_hash"), "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _line_memory()
        for batch in batches:
            for part in chunks_of(batch, "text"):
                rows = []
                for row, key, text, chunks in zip(
                    *(part.column(n).to_pylist() for n in ("row", "key", "text", "chunks"))
                ):
                    lines = text.split("\n")
                    found = _spans(lines, memory, runs)
                    rows += [(row, key, k, _bytes_of(lines, found[k])) for k in chunks]
                memory.trim()
                yield _columns(rows, schema)

    return joined.select("row", "key", "text", "chunks").mapInArrow(
        run, "row long, key long, chunk int, body binary")


def _without(lines: list[str], spans: list[tuple[int, int]], memory: Remembered, gaps: bool) -> tuple[str, int, int]:
    """The text without the lines of ``spans``; lines and words removed."""
    gone = sorted({i for first, after in spans for i in range(first, after)})
    if gaps:  # blank lines between two removed lines go with them
        gaps = [range(a + 1, b) for a, b in zip(gone, gone[1:])]
        gone += [i for gap in gaps if not any(memory[lines[i]][1] for i in gap) for i in gap]
    cut = set(gone)
    return (
        "\n".join(line for i, line in enumerate(lines) if i not in cut),
        len(cut),
        sum(memory[lines[i]][1] for i in cut),
    )


ADDED = "n_lines long, removed_lines long, removed_words long"


def _cut(joined: DataFrame, columns: list[str],
         spans_of: Callable[[list[str], Remembered, list[int]], list[tuple[int, int]]], gaps: bool) -> DataFrame:
    """Cuts what ``spans_of`` finds for the list in the last column."""
    kept = [c for c in columns if c != "text"]
    source = joined.select(*kept, "text", joined.columns[-1])
    target = joined.select(*kept, "text").schema
    for name in ADDED.split(", "):
        target = target.add(*name.split(" "))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _line_memory()
        for batch in batches:
            for part in chunks_of(batch, "text"):
                rows = []
                for text, cuts in zip(part.column("text").to_pylist(), part.column(part.num_columns - 1).to_pylist()):
                    n = text.count("\n") + 1 if text else 0
                    if not cuts:
                        rows.append((text, 0, 0, n))
                        continue
                    lines = text.split("\n")
                    rows.append((*_without(lines, spans_of(lines, memory, cuts), memory, gaps), n))
                memory.trim()
                text, lines, words, n = map(list, zip(*rows))
                yield pa.record_batch(
                    [*(part.column(c) for c in kept), pa.array(text, pa.string()), pa.array(n, pa.int64()),
                     pa.array(lines, pa.int64()), pa.array(words, pa.int64())],
                    names=[f.name for f in target],
                )

    return source.mapInArrow(run, target).select(*columns, *[n.split(" ")[0] for n in ADDED.split(", ")])


def remove_repeated_lines(docs: DataFrame, runs: bool = False) -> DataFrame:
    """``docs`` with repeated chunks (or ``runs``) of lines cut from ``text``, and ``n_lines``, ``removed_lines``,
    ``removed_words``; all rows and other columns stay.

    1. Each text's lines are cut into chunks; only place and hash of a chunk move.
    2. Of hashes that occur more than once, the chunks' bytes are fetched and compared by
       grouping on them; the first occurrence (smallest ``doc_id``, then place) is kept.
       A hot chunk is a sum of partial minima: no occurrence is paired with another.
    3. All others are cut out; each text is joined with its own list of cuts.

    Chunks count if they have ``LEAST_WORDS`` words and two lines, or are one line of
    ``LONG_LINE`` words. A chunk that repeats within one text is removed there too.

    With ``runs`` the same is done with overlapping runs instead of chunks (``line_runs``):
    every line goes that lies in any run of whole lines of ``LEAST_WORDS`` words which
    occurs before, whatever surrounds it. An equal earlier line is always left; of runs
    that overlap their own copies (a short line over and over) only the first lines are.
    Parts of a line are not compared.

    Null and empty texts stay as they are; a text all of whose lines repeat becomes empty.
    A null id counts as the smallest. Identical rows are one document and share their
    fate; rows with one id and different texts are told apart by a hash of the text.
    Columns of ``docs`` with the names of added ones are replaced. An empty table gives
    no rows.
    """
    columns = [c for c in docs.columns if c not in {n.split(" ")[0] for n in ADDED.split(", ")}]
    docs = docs.select(*columns)
    narrow = docs.select(
        F.xxhash64("doc_id", "text").alias("row"), F.col("doc_id").cast("long").alias("key"), "text")
    chunks = stored(_chunk_rows(narrow, runs), "chunks")
    repeated = chunks.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1")
    suspects = stored(
        chunks.join(repeated, "hash", "left_semi").select("row", "chunk").distinct(), "suspects")
    kept = _bodies(narrow, suspects, runs).groupBy("body").agg(
        F.min(F.struct("key", "row", "chunk")).alias("keep")
    ).select(F.col("keep.row").alias("row"), F.col("keep.chunk").alias("chunk"))
    cuts = suspects.join(kept, ["row", "chunk"], "left_anti").groupBy("row").agg(
        F.collect_list("chunk").alias("cuts"))
    # Names longer than any column of the documents clash with none.
    mark, list_ = ("_" * max(map(len, columns)) + n for n in ("row", "cuts"))
    joined = docs.withColumn(mark, F.xxhash64("doc_id", "text")).join(
        cuts.withColumnsRenamed({"row": mark, "cuts": list_}), mark, "left"
    ).select(*columns, list_)

    def spans_of(lines: list[str], memory: Remembered, cut: list[int]) -> list[tuple[int, int]]:
        spans = _spans(lines, memory, runs)
        return [spans[k][:2] for k in cut]

    return _cut(joined, columns, spans_of, runs)


def passage_chunks(lines: list[str], memory: Remembered) -> list[tuple[int, int]]:
    """Content-defined chunks (first line, line after the last) of a text, in order.

    A rolling hash goes over the hashes of ``WINDOW`` lines. Of the lines that make up the
    next ``LEAST_WORDS`` words from any line on, the one with the smallest rolling hash is a
    boundary: what stands before or after moves no boundary. A chunk runs from a boundary
    until it has ``LEAST_WORDS`` words and two lines; a line of ``LONG_LINE`` words is a chunk
    by itself. So two texts that share a passage of ``PASSAGE_WORDS`` in whole lines share a chunk in it.
    Lines without words are never a boundary nor counted.
    """
    places = [i for i, line in enumerate(lines) if memory[line][1]]
    hashes, counts = [memory[lines[i]][0] for i in places], [memory[lines[i]][1] for i in places]
    rolling = []
    for p in range(len(places)):
        value = 0
        for h in hashes[p : p + WINDOW]:
            value = (value * _PRIME + h) & _MASK
        rolling.append((value * _PRIME) & _MASK)
    boundaries = {p for p, n in enumerate(counts) if n >= LONG_LINE}
    least: deque[int] = deque()
    after = total = 0
    for start, n in enumerate(counts):
        while total < LEAST_WORDS and after < len(counts):
            while least and rolling[least[-1]] > rolling[after]:
                least.pop()
            least.append(after)
            total += counts[after]
            after += 1
        if total < LEAST_WORDS:
            break
        boundaries.add(least[0])
        if least[0] == start:
            least.popleft()
        total -= n
    chunks = []
    for p in sorted(boundaries):
        end, n = p, 0
        while end < len(counts) and n < LONG_LINE and (n < LEAST_WORDS or end - p < 2):
            n += counts[end]
            end += 1
        if n >= LEAST_WORDS and (end - p > 1 or n >= LONG_LINE):
            chunks.append((places[p], places[end - 1] + 1))
    return chunks


def chunk_extensions(lines: list[str], memory: Remembered, repeated: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """Chunks of ``repeated`` with one, two, .. more lines on one side.

    They reach as far as a passage can go on without another chunk of its own: less than
    ``LEAST_WORDS`` words ahead of the chunk, less than ``PASSAGE_WORDS`` after its first line.
    """
    found = set()
    for first, after in repeated:
        total = sum(memory[line][1] for line in lines[first + 1 : after])
        for q in range(after, len(lines)):
            n = memory[lines[q]][1]
            total += n
            if total >= PASSAGE_WORDS:
                break
            if n:
                found.add((first, q + 1))
        total = 0
        for q in range(first - 1, -1, -1):
            n = memory[lines[q]][1]
            total += n
            if total >= LEAST_WORDS:
                break
            if n:
                found.add((q, after))
    return sorted(found)


def _code(span: tuple[int, int]) -> int:
    return span[0] << 32 | span[1]


def _span(code: int) -> tuple[int, int]:
    return code >> 32, code & 0xFFFFFFFF


def _found(texts: DataFrame, find: Callable[[list[str], Remembered, list[int]], Iterator[tuple]]) -> DataFrame:
    """Rows (span, hash, body) that ``find`` makes of each text and its list of spans."""
    schema = pa.schema([("row", pa.int64()), ("key", pa.int64()), ("span", pa.int64()), ("hash", pa.int64()),
                        ("body", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _line_memory()
        for batch in batches:
            for part in chunks_of(batch, "text"):
                rows = [
                    (row, key, *found)
                    for row, key, text, spans in zip(*(part.column(n).to_pylist() for n in ("row", "key", "text", "spans")))
                    for found in find((text or "").split("\n"), memory, spans)
                ]
                memory.trim()
                yield _columns(rows, schema)

    return texts.select("row", "key", "text", "spans").mapInArrow(
        run, "row long, key long, span long, hash long, body binary")


def _hash_of(lines: list[str], span: tuple[int, int]) -> int:
    return xxhash.xxh3_64_intdigest(_bytes_of(lines, span)) - (1 << 63)


def _repeated(found: DataFrame, name: str) -> DataFrame:
    """The spans of each text whose hash occurs more than once."""
    often = found.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1")
    spans = found.join(often, "hash", "left_semi")
    return stored(spans.groupBy("row", "key").agg(F.collect_set("span").alias("spans")), name)


def _copies(bodies: DataFrame) -> DataFrame:
    """All spans but the first of those that are equal byte by byte."""
    first = bodies.groupBy("body").agg(F.min(F.struct("key", "row", "span")).alias("keep")).select("keep.*")
    return bodies.select("row", "key", "span").join(first, ["row", "key", "span"], "left_anti")


def remove_repeated_passages(docs: DataFrame) -> DataFrame:
    """``docs`` with passages of lines that occur before cut from ``text``, and ``n_lines``, ``removed_lines``,
    ``removed_words``; all rows and other columns stay.

    1. Texts are cut into chunks (``passage_chunks``); only place and hash of a chunk move.
    2. The bytes of chunks whose hash occurs more than once are compared by grouping on
       them; the first occurrence (smallest ``doc_id``, then place) is kept. A hot chunk is
       a sum of partial minima: no occurrence is paired with another.
    3. Those chunks are the anchors of longer matches: each is taken with one, two, .. lines
       more on either side (``chunk_extensions``), and these runs are hashed, counted and
       compared in the same way. So a passage goes up to its first and last whole line.
    4. All but the first occurrences are cut out; each text is joined with its own list of cuts.

    Every passage of 50 words or more in whole lines is found, whatever surrounds it; of
    passages of ``LEAST_WORDS`` to 50 words those that hold a chunk. Single lines under
    ``LONG_LINE`` words and parts of a line never go by themselves. An equal earlier line is
    always left. Blank lines between two removed lines go with them.

    Null and empty texts stay as they are; a text all of whose lines repeat becomes empty.
    A null id counts as the smallest. Identical rows are one document and share their
    fate; rows are told apart by their id and a hash of id and text. Columns of ``docs``
    with the names of added ones are replaced. An empty table gives no rows.
    """
    columns = [c for c in docs.columns if c not in {n.split(" ")[0] for n in ADDED.split(", ")}]
    docs = docs.select(*columns)
    row = F.xxhash64("doc_id", "text")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    narrow = docs.select(row.alias("row"), key.alias("key"), "text")

    def chunks(lines: list[str], memory: Remembered, _: None) -> Iterator[tuple]:
        return ((_code(c), _hash_of(lines, c), None) for c in passage_chunks(lines, memory))

    def around(lines: list[str], memory: Remembered, spans: list[int]) -> Iterator[tuple]:
        anchors = {*map(_span, spans)}
        yield from ((code, None, _bytes_of(lines, _span(code))) for code in spans)
        yield from ((_code(e), _hash_of(lines, e), None) for e in chunk_extensions(lines, memory, anchors))

    def bodies(lines: list[str], _: Remembered, spans: list[int]) -> Iterator[tuple]:
        return ((code, None, _bytes_of(lines, _span(code))) for code in spans)

    def texts(spans: DataFrame) -> DataFrame:
        return narrow.join(spans.hint("shuffle_hash"), ["row", "key"])

    spans = narrow.withColumn("spans", F.lit(None).cast("array<long>"))
    anchors = _repeated(stored(_found(spans, chunks), "chunks"), "anchors")
    near = stored(_found(texts(anchors), around), "around")
    longer = _repeated(near.where("body is null"), "longer")
    cuts = _copies(near.where("body is not null")).unionByName(_copies(_found(texts(longer), bodies)))
    # Names longer than any column of the documents clash with none.
    names = ["_" * max(map(len, columns)) + n for n in ("row", "key", "cuts")]
    cuts = cuts.groupBy("row", "key").agg(F.collect_set("span").alias("cuts")).toDF(*names)
    joined = docs.withColumns({names[0]: row, names[1]: key}).join(cuts, names[:2], "left").select(*columns, names[2])
    return _cut(joined, columns, lambda lines, memory, cut: [*map(_span, cut)], True)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the passages of lines seen before."""
    cleaned = remove_repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select(
        "doc_id", "n_lines", "removed_lines", "removed_words", F.sha2("text", 256).alias("text_sha256"),
        F.length("text").alias("n_chars_left"),
    )


QUERIES = {"op2_line_dedup": op2_line_dedup}
SQL: dict[str, str] = {}

"""Periodic runs of words by grammar compression.

Re-Pair turns the word ids of a chunk of texts into binary rules; what it leaves of each
text is joined by a balanced tree of further rules, so that one rule derives each text.
Any run of a text spans two words or more, so it crosses the boundary between the two
sides of exactly one node of the derivation, and is whole there. Runs that cross a rule's boundary are
computed once a rule, whatever the number of its places; they are translated to
all places of the rule, and only intervals that no other of their period contains stay.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.llm.common import chunks_of, mixed, odd_numbers, table

#: A run repeats its period so many times, and has so many words, at least.
REPEATS = 4
LEAST_WORDS = 6
#: Trials (rule, period) that are looked at together.
TRIALS = 1 << 21


@dataclass
class Rules:
    """Occurrences of rules in a derivation: rule, first word, boundary and end of each."""

    rule: np.ndarray
    start: np.ndarray
    middle: np.ndarray
    end: np.ndarray


def _ranges(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. below each count, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def re_pair(ids: np.ndarray, ends: np.ndarray) -> tuple[Rules, np.ndarray]:
    """Rules of texts laid end to end (``ends``: the word after each), and the starts of what is left.

    Each round replaces pairs that occur twice or more by new symbols, in all places where
    no pair that overlaps occurs more often; it ends when no pair occurs twice. The pair
    that occurs most often is replaced in every round, as Re-Pair does one at a time.
    """
    symbol, start = ids.astype(np.int64), np.arange(len(ids))
    size = np.ones(len(ids), np.int64)
    last = np.zeros(len(ids), bool)
    last[ends[ends > 0] - 1] = True
    symbols, found = int(ids.max(initial=-1)) + 1, []
    while len(symbol) > 1:
        open_ = np.flatnonzero(~last[:-1])
        if not len(open_):
            break
        pair, which, counts = np.unique(
            symbol[open_] * symbols + symbol[open_ + 1], return_inverse=True, return_counts=True)
        if counts.max() < 2:
            break
        order = np.full(len(symbol) + 1, -1)  # by number of occurrences, then by symbols
        order[open_ + 1] = np.where(counts[which] > 1, counts[which] * len(pair) + which, -1)
        here = order[1:]
        best = (here >= 0) & (here >= order[:-1]) & (here[: len(symbol)] >= np.append(here[1:], -1))
        places = np.flatnonzero(best)
        # Neighbours among the best are one pair of equal symbols: every second place counts.
        heads = np.flatnonzero(np.append(True, np.diff(places) > 1))
        places = places[_ranges(np.diff(np.append(heads, len(places)))) % 2 == 0]
        where = np.empty(len(symbol), np.int64)
        where[open_] = which
        chosen, number = np.unique(where[places], return_inverse=True)
        left, right = size[places], size[places + 1]
        found.append(Rules(number + symbols, start[places], start[places] + left, start[places] + left + right))
        symbol[places] = number + symbols
        size[places] += right
        last[places] = last[places + 1]
        stay = np.ones(len(symbol), bool)
        stay[places + 1] = False
        symbol, start, size, last = symbol[stay], start[stay], size[stay], last[stay]
        symbols += len(chosen)
    return _joined(found), start


def _joined(parts: list[Rules]) -> Rules:
    empty = np.empty(0, np.int64)
    return Rules(*[np.concatenate([empty, *[getattr(p, f) for p in parts]])
                   for f in ("rule", "start", "middle", "end")])


def balanced(starts: np.ndarray, ends: np.ndarray, first_rule: int) -> Rules:
    """Rules that join what is left of each text, two neighbours a level."""
    text = np.searchsorted(ends, starts, side="right")
    found, rule = [], first_rule
    while len(starts):
        heads = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
        seat = _ranges(np.diff(np.append(heads, len(text))))
        after = np.append(starts[1:], ends[-1])
        lefts = np.flatnonzero((seat[:-1] % 2 == 0) & (text[1:] == text[:-1]))
        if not len(lefts):
            break
        found.append(Rules(rule + np.arange(len(lefts)), starts[lefts], starts[lefts + 1], after[lefts + 1]))
        rule += len(lefts)
        stay = seat % 2 == 0
        starts, text = starts[stay], text[stay]
    return _joined(found)


class Blocks:
    """Compares blocks of words by hashes of prefixes."""

    def __init__(self, ids: np.ndarray):
        self.powers = np.cumprod(np.append(np.uint64(1), np.full(len(ids), odd_numbers(1, 29)[0])), dtype=np.uint64)
        values = mixed(ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * self.powers[:-1]
        self.sums = np.append(np.uint64(0), np.cumsum(values, dtype=np.uint64))

    def repeat(self, first: np.ndarray, length: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """Whether the blocks at ``first`` and ``first + shift`` look alike."""
        here = (self.sums[first + length] - self.sums[first]) * self.powers[shift]
        return here == self.sums[first + shift + length] - self.sums[first + shift]


def crossing(ids: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs that cross the boundaries of rules: number of the rule, first word, end, period.

    Half of a run at least lies on one side of the boundary, and that holds its period
    twice. So periods are tried by comparing two blocks next to the boundary, on each
    side; what looks alike is compared word by word and extended. A longer period whose
    blocks lie in a run found before is a multiple of its period and no smallest one.
    """
    blocks, found = Blocks(ids), []
    length = end - start
    trials = length // REPEATS
    trials[length < LEAST_WORDS] = 0
    stops = np.cumsum(trials)
    first = 0
    while first < len(trials):
        done = stops[first - 1] if first else 0
        after = max(first + 1, int(np.searchsorted(stops, done + TRIALS, side="right")))
        rule = np.repeat(np.arange(first, after), trials[first:after])
        period = _ranges(trials[first:after]) + 1
        half = np.maximum(-(-LEAST_WORDS // 2), REPEATS // 2 * period)
        for right in (True, False):
            near = middle[rule]
            fits = near + half <= end[rule] if right else near - half >= start[rule]
            rows = np.flatnonzero(fits)
            side = near[rows] if right else near[rows] - half[rows]
            edge = near[rows] if right else near[rows] - 1
            step = period[rows] if right else -period[rows]
            alike = ids[edge] == ids[edge + step]
            rows, side = rows[alike], side[alike]
            alike = blocks.repeat(side, half[rows] - period[rows], period[rows])
            rows, side = rows[alike], side[alike]
            _extended(ids, start, end, rule[rows], side, half[rows], period[rows], right, found)
        first = after
    return tuple(np.array(c, np.int64) for c in zip(*found)) if found else (np.empty(0, np.int64),) * 4


def _extended(ids, start, end, rule, side, half, period, right, found) -> None:
    """Adds the runs around blocks that look alike; ``rule`` ascends, and ``period`` within it."""
    heads = np.flatnonzero(np.append(True, rule[1:] != rule[:-1])) if len(rule) else []
    for head, tail in zip(heads, np.append(heads[1:], len(rule))):
        low, high, at = int(start[rule[head]]), int(end[rule[head]]), int(head)
        while at < tail:
            q, a, b = int(period[at]), int(side[at]), int(side[at] + half[at])
            differ = np.flatnonzero(ids[low : high - q] != ids[low + q : high]) + low
            place = int(np.searchsorted(differ, a))
            if place < len(differ) and differ[place] < b - q:  # they only looked alike
                at += 1
                continue
            s = int(differ[place - 1]) + 1 if place else low
            e = int(differ[place]) + q if place < len(differ) else high
            if e - s >= max(LEAST_WORDS, REPEATS * q):
                found.append((int(rule[head]), s, e, q))
            inside = side[at:tail] + half[at:tail] > e if right else side[at:tail] < s
            inside[0] = False
            rest = np.flatnonzero(inside)
            at = at + int(rest[0]) if len(rest) else tail


def runs_of(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, end and smallest period of all runs, by first word, then period."""
    rules, left = re_pair(ids, ends)
    rules = _joined([rules, balanced(left, ends, int(max(rules.rule.max(initial=-1), ids.max(initial=-1))) + 1)])
    long = rules.end - rules.start >= LEAST_WORDS
    rules = Rules(rules.rule[long], rules.start[long], rules.middle[long], rules.end[long])
    _, once = np.unique(rules.rule, return_index=True)
    number, start, end, period = crossing(ids, rules.start[once], rules.middle[once], rules.end[once])
    # All places of the rules that have runs.
    order = np.argsort(rules.rule, kind="stable")
    kinds = rules.rule[order]
    own = rules.rule[once][number]
    first, after = np.searchsorted(kinds, own), np.searchsorted(kinds, own, side="right")
    times = after - first
    shift = rules.start[order[np.repeat(first, times) + _ranges(times)]] - np.repeat(rules.start[once][number], times)
    start, end, period = np.repeat(start, times) + shift, np.repeat(end, times) + shift, np.repeat(period, times)
    return maximal(start, end, period)


def maximal(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals that no other one of the same period contains, each once, in order."""
    order = np.lexsort((-end, start, period))
    start, end, period = start[order], end[order], period[order]
    if len(start):
        span = int(end.max()) + 1
        _, kind = np.unique(period, return_inverse=True)
        reach = np.maximum.accumulate(kind * span + end)
        stay = np.append(True, kind[1:] * span + end[1:] > reach[:-1])
        start, end, period = start[stay], end[stay], period[stay]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


SCHEMA = ("n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
          "collapsed_sha256 string")
_TYPES = pa.schema([(c.split(" ")[0], pa.int64() if c.endswith("long") else pa.string()) for c in SCHEMA.split(", ")])


def _word_ids(texts: list[str | None], planted: list[tuple[int, int] | None]) -> tuple[list, np.ndarray, np.ndarray]:
    known: dict[bytes, int] = {}
    split, ids, ends = [], [], 0
    for text, plant in zip(texts, planted):
        words = (text or "").encode("utf-8", "surrogatepass").split()
        if plant and words:
            first, period = plant[0] % len(words), plant[1]
            period = 1 + (len(words) - first) // period
            part = words[first : first + period]
            words = words[:first] + (part * (-(-(len(words) - first) // period)))[: len(words) - first]
        split.append(words)
        ids += [known.setdefault(w, len(known)) for w in words]
    return split, np.array(ids, np.int64), np.cumsum([len(w) for w in split])


def _planted(doc_id: int | None) -> tuple[int, int] | None:
    """Where a tenth of the texts is made periodic: seed of the first word, parts of the rest."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    return (h // 10, 3 + h // 10 % 8) if h % 10 == 0 else None


def _rows(split: list[list[bytes]], ids: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
    start, end, period = runs_of(ids, ends)
    ends = np.asarray(ends, np.int64)
    first = np.searchsorted(start, np.append(0, ends[:-1])) if len(ends) else []
    after = np.searchsorted(start, ends) if len(ends) else []
    change = np.bincount(start + period, minlength=len(ids) + 1) - np.bincount(end, minlength=len(ids) + 1)
    keep = np.cumsum(change)[:-1] <= 0
    rows = []
    for words, stop, a, b in zip(split, ends.tolist(), first, after):
        base = stop - len(words)
        if a == b:
            rows.append((0, None, None, None, None, hashlib.sha256().hexdigest(),
                         hashlib.sha256(b" ".join(words)).hexdigest()))
            continue
        s, n, q = (start[a:b] - base).tolist(), (end[a:b] - start[a:b]).tolist(), period[a:b].tolist()
        lines = "".join(f"{x},{y},{z}\n" for x, y, z in zip(s, n, q))
        top = min(range(len(s)), key=lambda i: (-n[i], s[i], q[i]))
        kept = b" ".join(compress(words, keep[base:stop].tolist()))
        rows.append((len(s), s[top], n[top], q[top], 1000 * n[top] // q[top],
                     hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
    columns = zip(*rows) if rows else [[] for _ in _TYPES]
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _TYPES)], schema=_TYPES)


def periodic_runs(docs: DataFrame, planted: bool = False) -> DataFrame:
    """Adds to ``doc_id`` what is periodic in each whole ``text``.

    A run is a stretch of words with smallest period q and ``max(LEAST_WORDS, REPEATS * q)``
    words or more, which no neighbouring word extends. ``n_runs`` counts them; ``start``
    (word number from 0), ``length``, ``period`` and ``exponent_milli`` (1000 * length /
    period) are those of the longest (ties: smallest start, then period), null without a run;
    ``runs_sha256`` is of the lines ``start,length,period`` of all, ``collapsed_sha256`` of
    the words that are left, joined by one space, when each run is cut down to its first
    period.

    Texts are independent: nothing is shuffled, a task holds some 2 MB of texts (one text
    at least) and its grammar, which is linear in its words. ``planted`` makes the texts of a
    tenth of the ids periodic first, as the query asks for.

    Null, empty and blank texts have no words and no runs; words are bytes between ASCII
    white space, case and all. Null ids are worked like others, but nothing is planted in
    their texts. Repeated rows give repeated results, an empty table none. Other columns are not read.
    """
    schema = pa.schema([("doc_id", pa.int64()), *_TYPES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks_of(batch, "text"):
                names = part.column("doc_id").to_pylist()
                plants = [_planted(i) if planted else None for i in names]
                rows = _rows(*_word_ids(part.column("text").to_pylist(), plants))
                yield pa.record_batch([part.column("doc_id"), *rows.columns], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, {SCHEMA}")


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words of all documents, after a tenth of them was made periodic."""
    return periodic_runs(table(spark, sf_dir, "documents"), planted=True)


QUERIES = {"op12_runs": op12_runs}
SQL: dict[str, str] = {}

"""Each training-data operator against a brute-force version, and on awkward input."""

import collections
import hashlib
import math
import tracemalloc
import zlib


import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tidefold.llm import (
    chat, line_dedup, mixing, near_dedup, order_minhash, packing, pitman_yor, quality, search, urls,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, a clashing column."""
    rows = [
        (1, "a b c d e f g h", "en", "s1", 15), (1, "a b c d e f g h", "en", "s1", 15),
        (2, None, None, None, None), (3, "", "en", "s1", 0), (4, " \t\n ", "en", "s2", 4),
        (5, LONG, "en", "s2", len(LONG)), (6, LONG + " end", None, "s2", None),
        (None, "no id at all here", "en", None, 17), (7, "A B C D E F G H", "de", "s1", 15),
    ]
    return spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("clash")).withColumn("hash", F.lit(1))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")


def shingles(text, width):
    words = (text or "").encode().lower().split()
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute_components(texts, width, percent):
    sets = {i: shingles(t, width) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("block", [3, 256])
def test_near_duplicates_equal_brute_force(docs, texts, block, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    found = near_dedup.near_duplicates(docs, width=4, percent=80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components(texts, 4, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_near_duplicates_of_odd_rows(odd, none):
    found = near_dedup.near_duplicates(odd).collect()
    assert len(found) == 9
    groups = {(r.doc_id, r.component_id) for r in found}
    assert groups == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 5), (7, 1), (None, None)}
    assert near_dedup.near_duplicates(none).count() == 0


def test_union_estimates_are_exact_for_small_sets():
    random = np.random.default_rng(1)
    for _ in range(50):
        a = np.unique(random.integers(0, 60, 30)).astype(np.uint64)
        b = np.unique(random.integers(0, 60, 30)).astype(np.uint64)
        row = np.full((1, near_dedup.RETAINED), np.iinfo(np.uint64).max, np.uint64)
        row[0, : len(b)] = b
        both, either = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        assert near_dedup.union_estimates(a, row, np.array([len(b)]))[0] == pytest.approx(both / either)


def test_line_dedup_equals_brute_force(docs, texts):
    memory, seen, expected = line_dedup._line_memory(), set(), {}
    for i in sorted(texts):
        lines, left = texts[i].split("\n"), []
        for chunk in line_dedup.line_chunks(lines, memory):
            body = "\n".join(lines[chunk[0] : chunk[1]])
            if line_dedup._countable(chunk):
                if body in seen:
                    continue
                seen.add(body)
            left += lines[chunk[0] : chunk[1]]
        expected[i] = "\n".join(left)
    cleaned = line_dedup.remove_repeated_lines(docs)
    assert {r.doc_id: r.text for r in cleaned.collect()} == expected
    assert cleaned.columns[: len(docs.columns)] == docs.columns


def test_line_dedup_finds_shifted_passages(spark, none, odd):
    passage = "\n".join(" ".join(f"p{i}q{j}" for j in range(25)) for i in range(4))
    rows = [(1, "one head\n" + passage), (2, "other\nlonger head\n" + passage + "\ntail"), (3, "own words")]
    found = {r.doc_id: r for r in line_dedup.remove_repeated_lines(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1].removed_lines == 0 and found[3].text == "own words"
    assert found[2].removed_words == 100 and found[2].text == "other\nlonger head\ntail"
    assert line_dedup.remove_repeated_lines(none).count() == 0
    left = line_dedup.remove_repeated_lines(odd)
    assert left.count() == 9 and left.where("doc_id = 1").select("text").distinct().count() == 1


def repeated_lines(texts, least):
    """Lines of each text that lie in a run of whole lines of ``least`` words which occurs before."""
    def runs(lines):
        sizes = [len(line.encode().split()) for line in lines]
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                if sizes[a] and sizes[b - 1] and sum(sizes[a:b]) >= least:
                    yield a, b, "\n".join(lines[a:b])

    seen, expected = set(), {}
    for i in sorted(texts):
        lines, gone = texts[i].split("\n"), set()
        for a, b, body in runs(lines):
            if body in seen:
                gone.update(range(a, b))
            seen.add(body)
        ends = sorted(gone)
        for a, b in zip(ends, ends[1:]):
            if not "".join(lines[a + 1 : b]).strip():
                gone.update(range(a + 1, b))
        expected[i] = gone
    return expected


def without(texts, gone):
    return {i: "\n".join(line for k, line in enumerate(text.split("\n")) if k not in gone[i]) for i, text in texts.items()}


def test_line_dedup_finds_every_repeated_run(docs, texts):
    cleaned = line_dedup.remove_repeated_lines(docs, runs=True)
    assert {r.doc_id: r.text for r in cleaned.collect()} == without(texts, repeated_lines(texts, 12))


def test_passages_equal_brute_force(docs, texts):
    """All that repeats with 50 words goes, nothing goes that does not repeat, and chunks decide between."""
    memory, seen, spans = line_dedup._line_memory(), collections.Counter(), {}
    for i in sorted(texts):
        lines = texts[i].split("\n")
        chunks = line_dedup.passage_chunks(lines, memory)
        spans[i] = [(c, "\n".join(lines[slice(*c)])) for c in chunks]
        seen.update(body for _, body in spans[i])
    for i in spans:
        lines = texts[i].split("\n")
        again = {c for c, body in spans[i] if seen[body] > 1}
        spans[i] += [(c, ("longer", "\n".join(lines[slice(*c)])))
                     for c in line_dedup.chunk_extensions(lines, memory, again)]
    met, gone = set(), {i: set() for i in spans}
    for i in sorted(spans):
        for span, body in sorted(spans[i], key=lambda found: found[0]):
            if body in met:
                gone[i].update(range(*span))
            met.add(body)
        ends, lines = sorted(gone[i]), texts[i].split("\n")
        for a, b in zip(ends, ends[1:]):
            if not "".join(lines[a + 1 : b]).strip():
                gone[i].update(range(a + 1, b))
    cleaned = line_dedup.remove_repeated_passages(docs)
    assert {r.doc_id: r.text for r in cleaned.collect()} == without(texts, gone)
    assert cleaned.columns[: len(docs.columns)] == docs.columns
    least, most = repeated_lines(texts, 50), repeated_lines(texts, 12)
    assert any(least.values()) and all(least[i] <= gone[i] <= most[i] for i in texts)


def test_passages_of_50_words_hold_a_common_chunk():
    draw = np.random.default_rng(5)
    for trial in range(2000):
        sizes = []
        while sum(sizes) < 50:
            sizes.append(int(draw.integers(1, 60 if trial % 4 == 0 else 20)))
        passage = [" ".join(f"p{trial}x{i}y{j}" for j in range(n)) for i, n in enumerate(sizes)]
        found = []
        for side in "ab":
            own = [" ".join(f"{side}{k}z{j}" for j in range(int(draw.integers(1, 15)))) for k in range(8)]
            lines = own[:4] + passage + own[4:]
            chunks = line_dedup.passage_chunks(lines, line_dedup._line_memory())
            found.append({(a - 4, b - 4) for a, b in chunks if 4 <= a and b <= 4 + len(passage)})
        assert found[0] & found[1], sizes


def test_line_dedup_finds_passages_of_short_lines(spark, none, odd):
    rows, left = [], {}
    for shape, (lines, width) in enumerate([(1, 15), (4, 15), (5, 12), (6, 10), (8, 8), (10, 15), (60, 1)]):
        passage = [" ".join(f"p{shape}x{i}y{j}" for j in range(width)) for i in range(lines)]
        for doc in range(20):
            own = [[f"d{shape}x{doc}{side}{i} own" for i in range(doc % 3 + 1)] for side in "ab"]
            key = 100 * shape + doc
            rows.append((key, "\n".join(own[0] + passage + own[1])))
            left[key] = rows[-1][1] if not doc else "\n".join(own[0] + own[1])
    found = line_dedup.remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), runs=True)
    assert {r.doc_id: r.text for r in found.collect()} == left
    assert line_dedup.remove_repeated_lines(none, runs=True).count() == 0
    assert line_dedup.remove_repeated_lines(odd, runs=True).count() == 9
    longer = {k: text for k, text in left.items() if k >= 100}  # a single line of 15 words is no passage
    found = line_dedup.remove_repeated_passages(
        spark.createDataFrame([r for r in rows if r[0] >= 100], "doc_id long, text string"))
    assert {r.doc_id: r.text for r in found.collect()} == longer
    assert line_dedup.remove_repeated_passages(none).count() == 0
    kept = line_dedup.remove_repeated_passages(odd)
    assert kept.count() == 9 and kept.where("doc_id = 1").select("text").distinct().count() == 1
    assert kept.where("doc_id is null").first().text == "no id at all here"
    assert kept.select("hash").distinct().first()[0] == 1


def test_url_rules(spark):
    rows = [
        (1, "http://Sub.Example.NET/en/x?y#z"), (2, "https://net/"), (3, "x://a.example.com/de/1"),
        (4, "http://a.org/fr/"), (5, "http://a.org/FR/"), (6, None), (7, "no scheme"), (8, "http://planet/x"),
        (9, "http://cheap-pills.example.com/"), (10, "http://example.net/en"), (11, "http://a.org?u=/fr/"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    for most in (2, 1000):
        found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(
            pages, max_rules=most).collect()}
        assert found == {
            1: ("sub.example.net", "/en/x", "example.net/en/", "allow"), 2: ("net", "/", "net/", "block"),
            3: ("a.example.com", "/de/1", "example.com/de/", "block"), 4: ("a.org", "/fr/", "org/fr/", "allow"),
            5: ("a.org", "/FR/", None, "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"),
            8: ("planet", "/x", None, "allow"), 9: ("cheap-pills.example.com", "/", None, "block"),
            10: ("example.net", "/en", "net/", "block"), 11: ("a.org", "", None, "allow"),
        }


def test_urls_of_odd_rows(spark):
    """Repeated rows, very long URLs, nulls; thousands of rules over several passes; no rows."""
    long = "http://a.example.net/en/" + "x-y/" * 50_000
    rows = [(1, long), (1, long), (2, "http://"), (2, "://"), (None, "http://h77.test/a"), (3, "http://x.h4999.test/b"), (4, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({"rule": F.lit(1), "s_rule": F.lit("clash")})
    many = list(urls.SITE_RULES) + [urls.Rule(f"h{i}.test/", "block", urls.SITE) for i in range(5000)]
    for most in (700, 10_000):
        found = collections.Counter(
            (r.page_id, r.host, len(r.path), r.rule, r.verdict) for r in urls.filter_urls(pages, many, max_rules=most).collect())
        assert found == collections.Counter([
            (1, "a.example.net", 200_004, "example.net/en/", "allow"), (1, "a.example.net", 200_004, "example.net/en/", "allow"),
            (2, "", 0, None, "allow"), (2, "", 0, None, "allow"), (None, "h77.test", 2, "h77.test/", "block"),
            (3, "x.h4999.test", 2, "h4999.test/", "block"), (4, "", 0, None, "allow"),
        ])
    assert urls.filter_urls(pages.limit(0)).count() == 0


def test_rules_are_kept_under_their_rarest_token():
    rules = list(enumerate(urls.SITE_RULES + urls.PATTERN_RULES))
    index, rest = urls.token_index(rules)
    assert {e[4] for e in index["en"]} == {"example.net/en/"}
    assert {e[4] for e in rest} == {"*casino-*.*"}  # "casino" may go on to the left
    assert urls.token_index([(0, urls.Rule("*abc*", "block", urls.PATTERN))])[1]


def compare_with_sql(spark, sf, name, queries, sql):
    from checks.compare import _rows, connect

    frame = queries[name](spark, sf)
    cursor = connect(sf).execute(sql[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(frame.columns)
    assert _rows(frame.collect(), frame.columns) == _rows(cursor.fetchall(), columns)


@pytest.mark.parametrize("name, module", [
    ("op3_filter_urls", urls), ("op4_chat_pairs", chat), ("op5_search", search),
])
def test_queries_equal_sql(spark, sf, name, module):
    compare_with_sql(spark, sf, name, module.QUERIES, module.SQL)


def test_preference_pairs(spark):
    kind = "pair_id long, turn long, role string, text string"
    chosen = spark.createDataFrame([
        (1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", None), (2, 0, None, "q"), (None, 0, "user", "x"),
    ], kind)
    rejected = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "no")], kind)
    found = {r.pair_id: r for r in chat.format_preferences(chosen, rejected).collect()}
    assert set(found) == {1, 2}
    one = found[1]
    assert one.prompt == "<|user|>\nhi<|end|>\n" and one.shared_turns == 1
    span = one.chosen_mask[0]
    assert one.chosen[span.start : span.stop] == "yes<|end|>" and len(one.chosen_mask) == 1
    span = one.rejected_mask[0]
    assert one.rejected[span.start : span.stop] == "no<|end|>"
    assert found[2].prompt == "" and found[2].chosen == "<|user|>\nq<|end|>\n" and found[2].rejected == ""


def _brute_pairs(chosen, rejected):
    def turns(rows):
        found = collections.defaultdict(list)
        for pair, turn, role, text in rows:
            if pair is not None:
                found[pair].append((turn is not None, turn or 0, role or "user", text or ""))
        return {p: [t[2:] for t in sorted(v)] for p, v in found.items()}

    def side(rest):
        text, spans = "", []
        for role, said in rest:
            text += f"<|{role}|>\n"
            if role == "assistant":
                spans.append((len(text), len(text) + len(said) + len("<|end|>")))
            text += said + "<|end|>\n"
        return text, spans

    left, right = turns(chosen), turns(rejected)
    for pair in left.keys() | right.keys():
        a, b = left.get(pair, []), right.get(pair, [])
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        yield pair, (n, side(a[:n])[0], *side(a[n:]), *side(b[n:]))


def test_preference_pairs_equal_brute_force(spark):
    """Ties, repeated rows, nulls, thousands of turns, very long ones, sides without rows, extra columns."""
    kind = "pair_id long, turn long, role string, text string"
    many = [(1, i, ("user", "assistant")[i % 2], f"turn {i} é") for i in range(3000)]
    chosen = many + [
        (2, 0, "user", "q"), (2, 0, "user", "q"), (2, 0, "assistant", "b"), (2, None, "assistant", "first"),
        (3, 1, "assistant", LONG), (4, 0, "user", "same"), (4, 1, "assistant", "same"), (5, 0, None, None),
        (None, 0, "assistant", "none"),
    ]
    rejected = many[:2000] + [(1, 2000, "assistant", "else"), (2, 0, "user", "q"), (2, 0, "assistant", "b"),
                              (3, 1, "assistant", LONG + "!"), (4, 0, "user", "same"), (4, 1, "assistant", "same"),
                              (6, 9, "assistant", "")]
    clash = {"prompt": F.lit(1), "stop": F.lit("x"), "chosen_turns": F.lit(None)}
    found = chat.format_preferences(*(
        spark.createDataFrame(rows, kind).repartition(3).withColumns(clash) for rows in (chosen, rejected)))
    assert {r.pair_id: (r.shared_turns, r.prompt, r.chosen, [tuple(s) for s in r.chosen_mask], r.rejected,
                        [tuple(s) for s in r.rejected_mask]) for r in found.collect()} == dict(_brute_pairs(chosen, rejected))
    empty = spark.createDataFrame([], kind)
    assert chat.format_preferences(empty, empty).count() == 0


def test_search_of_odd_rows(odd, none):
    queries = odd.select(F.col("doc_id").alias("query"), "text")
    found = search.search(odd, queries, k=3)
    best = {r["query"]: r.doc_id for r in found.where("rank = 1").collect()}
    assert best == {1: 1, 5: 5, 6: 6, 7: 1}
    assert search.search(none, queries).count() == 0


def test_search_over_many_shards_is_exact_and_skips(spark, docs, texts):
    """Several rounds of shards give what one shard does; blocks that cannot win are not read."""
    queries = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query"), "text")
    one, many = (sorted(map(tuple, search.search(docs, queries, shard_docs=d).collect())) for d in (1000, 7))
    assert one == many and len(one) == 100
    assert search._rounds(30) == [(0, 1), (1, 4), (4, 16), (16, 30)]
    memory = search.word_memory()
    shard = search.Shard([texts[i] for i in sorted(texts)], np.array(sorted(texts)), 300.0, memory)
    held = len(shard.doc)
    flat = np.unique(search.word_hashes([texts[20]], memory)[0])
    ids, scores = shard.top(flat, np.ones(len(flat)), 3, 0.0)
    shard.read = 0
    again = shard.top(flat, np.ones(len(flat)), 3, float(scores[-1]))
    assert again[0].tolist() == ids.tolist() and 0 < shard.read < held
    shard.read = 0
    assert not len(shard.top(flat, np.ones(len(flat)), 3, float(scores[0]) * 100)[0]) and not shard.read


def test_queries_that_read_a_shard_together_find_what_each_finds():
    """Common and rare lists, several blocks, queries with and without a score to reach."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{w}" for w in rng.zipf(1.3, rng.integers(0, 60)) % 500) for _ in range(700)]
    memory = search.word_memory()
    shard = search.Shard(pa.chunked_array([texts[:300], texts[300:]]), np.arange(700), 30.0, memory)
    assert 0 < shard.dense.shape[2] < len(shard.terms) and shard.blocks > search.FIRST_BLOCKS
    sets = [np.unique(search.word_hashes([t], memory)[0]) for t in texts[:40]]
    weights = [rng.random(len(terms)) + 0.1 for terms in sets]
    flat, counts = search.word_hashes(texts, memory)
    brute = []
    for terms, weight in zip(sets, weights):
        scores, weight_of = [], dict(zip(terms.tolist(), weight.tolist()))
        for i, (end, n) in enumerate(zip(np.cumsum(counts), counts)):
            tf = collections.Counter(w for w in flat[end - n : end].tolist() if w in weight_of)
            part = {w: t * 2.2 / (t + 1.2 * (0.25 + 0.75 * n / 30.0)) for w, t in tf.items()}
            scores.append((-round(sum(weight_of[w] * part[w] for w in tf), 6), i))
        brute.append([(i, -s) for s, i in sorted(s for s in scores if s[0] < 0)[:5]])
    least = np.array([found[-1][1] if i % 2 and found else 0.0 for i, found in enumerate(brute)])
    ends = np.append(0, np.cumsum([len(s) for s in sets]))
    together = shard.top_of_each(ends, np.concatenate(sets), np.concatenate(weights), 5, least)
    for found, (ids, scores) in zip(brute, together):
        assert [i for i, _ in found] == ids.tolist()
        assert np.allclose([s for _, s in found], scores, atol=2e-6)


def test_memory_of_building_a_shard():
    """No Python object for each word: building stays under 60 bytes a word, all results included."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"word{w}" for w in rng.integers(0, 20_000, 400)) for _ in range(1000)]
    search.Shard(texts[:10], np.arange(10), 400.0, search.word_memory())  # imports are not counted
    tracemalloc.start()
    try:
        shard = search.Shard(texts, np.arange(1000), 400.0, search.word_memory())
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(shard.ids) == 1000 and peak < 60 * 400_000

def test_quality_on_held_out_rows(spark, docs, labels, odd, none):
    scored = quality.score_quality(docs, labels)
    rows = {r.doc_id: r for r in scored.collect()}
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [rows[i].predicted == q for i, q in truth.items() if rows[i].held_out]
    assert np.mean(held) > 0.85
    assert quality.score_quality(odd, labels).count() == 9
    assert quality.score_quality(none, labels).count() == 0
    assert quality.score_quality(odd, labels.limit(0)).where("score <> 0.5").count() == 0


def test_isotonic_rates():
    rates = quality.isotonic(np.array([0, 2.0, 1, 0, 3]), np.array([1, 2.0, 2, 0, 3]))
    assert rates.tolist() == [0.0, 0.75, 0.75, 0.75, 1.0]


def test_sainte_lague_hands_out_by_quotients():
    random = np.random.default_rng(3)
    for _ in range(300):
        weights = random.choice([0, 1, 2, 3, 5.5], random.integers(1, 7)).tolist()
        most = random.integers(0, 9, len(weights)).tolist()
        seats, result = int(random.integers(0, 30)), [0] * len(weights)
        for _ in range(min(seats, sum(m for w, m in zip(weights, most) if w))):
            able = [i for i in range(len(weights)) if weights[i] and result[i] < most[i]]
            result[max(able, key=lambda i: (weights[i] / (2 * result[i] + 1), -i))] += 1
        assert mixing.sainte_lague(weights, most, seats) == result


def test_mix_meets_its_targets(docs, odd, none):
    rows = mixing.mix(docs).collect()
    by_source = collections.defaultdict(list)
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"]
        by_source[r.source].append(r)
    total = sum(r["size"] for r in rows)
    assert sum(v[0].target for v in by_source.values()) == pytest.approx(1.5 * total)
    for own in by_source.values():
        assert sum(r["size"] for r in own) == own[0].source_size
        assert sum(r.taken for r in own) == pytest.approx(own[0].target, rel=0.03)
    assert sorted(rows) == sorted(mixing.mix(docs.repartition(5)).collect())
    found = mixing.mix(odd).collect()
    assert len(found) == 9 and {r["size"] for r in found if r.doc_id in (2, 3, 4)} == {0}
    assert mixing.mix(none).count() == 0


def test_mix_equals_brute_force(spark):
    """Targets by repeated sharing, seats one by one to sources and to shards, then documents in a shard's order."""
    draw = np.random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(draw.integers(0, 90))), [None, "a", "b", "c", "d"][min(i % 9, 4)]) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    marks = {r.doc_id: r.mark for r in docs.select("doc_id", F.xxhash64(F.lit(7), "doc_id", "text").alias("mark")).collect()}
    sizes = {i: len(text.split()) for i, text, _ in rows}
    names = ["a", "b", "c", "d", None]
    own = {n: [i for i, _, source in rows if source == n] for n in names}
    held = {n: sum(sizes[i] for i in own[n]) for n in names}
    weight = dict(zip(names, (3, 1, 2, 3, 1)))
    goal = {}
    while len(goal) < len(names):
        left, open_ = 1.5 * sum(held.values()) - sum(goal.values()), [n for n in names if n not in goal]
        fair = {n: left * weight[n] / sum(weight[m] for m in open_) for n in open_}
        full = [n for n in open_ if fair[n] > 2 * held[n]]
        goal.update({n: 2 * held[n] for n in full} or fair)

    def seats(weights, most, n):
        given = [0] * len(weights)
        for _ in range(n):
            able = [k for k in range(len(weights)) if weights[k] and given[k] < most[k]]
            given[max(able, key=lambda k: (weights[k] / (2 * given[k] + 1), -k))] += 1
        return given

    found = {r.doc_id: r for r in mixing.mix(docs, shard_docs=40).collect()}
    cut = 0
    for n in names:
        count = -(-len(own[n]) // 40)
        shards = [sorted((i for i in own[n] if marks[i] % count == k), key=lambda i: marks[i]) for k in range(count)]
        line = [sum(sizes[i] for i in shard) for shard in shards]
        taken = sum(found[i].taken for i in own[n])
        assert found[own[n][0]].target == pytest.approx(goal[n]) and abs(taken - goal[n]) <= 16 * (count + 1)
        if goal[n] < 2 * held[n]:  # the blocks of a source come from all its taken words
            given = seats(line, [-(-2 * x // 16) for x in line], round(taken / 16))
            quotas = [min(16 * q, 2 * x) for q, x in zip(given, line)]
        else:
            quotas = [2 * x for x in line]
        for shard, quota, whole in zip(shards, quotas, line):
            left = quota % whole if whole else 0
            for i in shard:
                rest = min(sizes[i], left)
                assert found[i].taken == sizes[i] * (quota // max(whole, 1)) + rest
                left -= rest
                cut += 0 < rest < sizes[i]
    assert cut and any(len(own[n]) > 80 for n in names)


def test_mixed_documents_hold_what_is_taken(docs):
    taken = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    out = collections.Counter()
    for r in mixing.mixed_documents(docs).collect():
        out[r.doc_id] += len(r.text.encode().split())
    assert {i: n for i, n in taken.items() if n} == dict(out)


def test_mix_takes_whole_documents(docs):
    split = collections.Counter(r.source for r in mixing.mix(docs).collect() if r["size"] and r.taken % r["size"])
    assert max(split.values(), default=0) <= 1
    whole = collections.Counter(r.text for r in docs.collect())
    cut = collections.Counter(r.source for r in mixing.mixed_documents(docs).collect() if r.text not in whole)
    assert max(cut.values(), default=0) <= 1


def test_packing_is_a_round_trip(docs, texts, odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    ids = {i: tokenizer.encode(t, add_special_tokens=False).ids + [1] for i, t in texts.items()}
    rows = packing.pack_documents(docs, shard_docs=64, with_ids=True).collect()
    whole, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == len(whole[r.doc_id]) and r.length == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        whole[r.doc_id] += r.ids
    assert dict(whole) == ids
    for r in sorted(rows, key=lambda r: r.offset):
        assert sum(sequences[r.sequence_id]) == r.offset
        sequences[r.sequence_id].append(r.length)
    sizes = [sum(s) for s in sequences.values()]
    assert max(sizes) <= 2048 and sum(s < 2048 for s in sizes) <= 4
    tokens = packing.pack_documents(odd).groupBy().sum("length").first()[0]
    assert tokens == sum(len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in odd.collect())
    assert packing.pack_documents(none).count() == 0


@pytest.mark.parametrize("text", [
    "", " ", "\n", "a  b", "a \n b", "it's ok\n\nx", "tab\there", "é\u00a0 ü", "<|endoftext|> x", " lead", "trail ", "a\x00b c",
])
def test_words_are_encoded_as_in_their_text(text):
    with open(packing.default_ranks(), "rb") as file:
        pieces = packing._encoder(file.read())
    assert packing.encode(text, pieces) == pieces.function(text)


def test_shards_of_packing_are_bounded(spark, docs, monkeypatch):
    """A leaf of long texts or of equal rows is dealt over several shards; nothing is lost."""
    rows = [(7, "the same words again and again " * 20, "en")] * 300 + [
        (100 + i, f"long {i} " * 4000, "en") for i in range(20)]
    same = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    monkeypatch.setattr(packing, "SHARD_BYTES", 1 << 16)
    found = packing.pack_documents(same, shard_docs=40).collect()
    assert collections.Counter(r.doc_id for r in found if r.start == 0) == collections.Counter(r[0] for r in rows)
    for id_, n in ((7, 300), (100, 1)):
        assert sum(r.length for r in found if r.doc_id == id_) == n * next(r.doc_tokens for r in found if r.doc_id == id_)
    shards = collections.Counter(r.sequence_id >> 32 for r in found if r.doc_id == 7 and r.start == 0)
    assert len(shards) > 2 and max(shards.values()) <= 120


def test_texts_are_encoded_together_as_alone(texts):
    import pyarrow as pa

    with open(packing.default_ranks(), "rb") as file:
        encoder = packing._encoder(file.read())
    all_ = [*texts.values(), None, "", "a", "\na", " a", "a\n", "\n", "a  b", "'s it's\n's", "　x y", "1a ,,.\n."]
    found = packing.encode_texts(pa.array(all_, pa.string()), encoder, b"\1\0").to_pylist()
    assert found == [encoder.function(t or "") + b"\1\0" for t in all_]
    assert packing.encode_texts(pa.array([], pa.string()), encoder).to_pylist() == []


def test_neighbours_share_rare_ids():
    docs = [np.array(d, np.uint16) for d in ([5, 900, 901], [6, 7, 8], [900, 9, 901], [5, 6, 7])]
    assert packing.Neighbours(docs).of(0, np.array([False, True, True, True]), 2)[0] == 2


def test_neighbours_equal_brute_force(texts):
    """All terms count, also those that most documents hold: copies are found in a large group."""
    with open(packing.default_ranks(), "rb") as file:
        pieces = packing._encoder(file.read())
    docs = [np.frombuffer(packing.encode(texts[i], pieces) + b"\1\0", "<u2") for i in sorted(texts)[:80]]
    docs += [docs[0]] * 60
    index, n, mean = packing.Neighbours(docs), len(docs), np.mean([len(d) for d in docs])
    sets = [collections.Counter(d.tolist()) for d in docs]
    df = collections.Counter(t for c in sets for t in c)
    unused = np.ones(n, bool)
    for seed in (0, 5, 100):
        unused[seed] = False
        scores = [sum(math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2
                      / (c[t] + 1.2 * (0.25 + 0.75 * len(d) / mean)) for t in sets[seed] if t in c)
                  for c, d in zip(sets, docs)]
        found = index.of(seed, unused, 10)
        best = sorted((s for i, s in enumerate(scores) if unused[i]), reverse=True)[:10]
        assert [scores[i] for i in found] == pytest.approx(best, rel=1e-4)


def test_packing_deals_by_content(spark, docs):
    """Copies of documents with a word changed meet in a shard; hashing keeps 1 in 8 together."""
    both = docs.select("doc_id", "text").unionByName(
        docs.select((F.col("doc_id") + 1_000_000).alias("doc_id"), F.concat("text", F.lit(" changed")).alias("text")))
    rows = packing.pack_documents(both, shard_docs=50).where("start = 0").collect()
    shard = {r.doc_id: r.sequence_id >> 32 for r in rows}
    assert len(shard) == 400 and len(set(shard.values())) >= 8
    assert np.mean([shard[i] == shard[i + 1_000_000] for i in shard if i < 1_000_000]) > 0.8


def test_language_model_counts_and_base(docs, texts, monkeypatch):
    counts, tokens = collections.Counter(), {}
    for i, text in texts.items():
        tokens[i] = text.encode().lower().split() + [b"\n"]
        if zlib.crc32(str(i).encode()) % 10:
            counts.update(tokens[i])
    n, v = sum(counts.values()), len(counts)
    for size in (4_000_000, 9_000):  # the second spreads frequent words over buckets
        monkeypatch.setattr(pitman_yor, "BUCKET_TOKENS", size)
        rows = pitman_yor.score_texts(docs.where("doc_id <> 3")).collect() if size < 10_000 else \
            pitman_yor.score_texts(docs).collect()
        if size < 10_000:
            assert len(rows) == len(texts) - 1 and all(math.isfinite(r.score) for r in rows)
            continue
        for r in rows:
            own = tokens[r.doc_id]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(counts[w] > 0 for w in own), n)
            base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
            assert r.base_score == pytest.approx(base)
        held = [r for r in rows if r.held_out]
        assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_model_of_odd_rows(odd, none):
    rows = pitman_yor.score_texts(odd).collect()
    assert len(rows) == 9 and all(math.isfinite(r.score) for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (2, 3, 4)} == {1}
    assert pitman_yor.score_texts(none).count() == 0


def test_language_model_tells_all_contexts_apart(spark, monkeypatch):
    """Two words of one class of 2^16, as contexts were once, keep their own followers in all buckets."""
    seen = {}
    for i in range(100_000):
        key = xxhash.xxh3_64_intdigest(f"w{i}".encode()) >> 7 & 0xFFFF
        if key in seen:
            break
        seen[key] = i
    a, b = f"w{seen[key]}", f"w{i}"
    ids = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 10]
    out = [i for i in range(3000) if not zlib.crc32(str(i).encode()) % 10]
    rows = [(i, f"{a} x" if k % 2 else f"{b} y") for k, i in enumerate(ids[:400])]
    rows += [(out[0], f"{a} x"), (out[1], f"{a} y"), (out[2], f"{b} y"), (out[3], f"{b} x")]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (4_000_000, 200):
        monkeypatch.setattr(pitman_yor, "BUCKET_TOKENS", size)
        score = {r.doc_id: r.score for r in pitman_yor.score_texts(made).where("held_out").collect()}
        assert score[out[0]] > score[out[1]] + 1 and score[out[2]] > score[out[3]] + 1


def test_language_model_arrays_and_sums():
    random = np.random.default_rng(3)
    for values in (np.empty(0, np.uint64), random.integers(0, 1 << 63, 50).astype(np.uint64), np.array([3, 1], np.uint16)):
        for steps in (False, True):
            back = pitman_yor.opened(pitman_yor.squeezed(values, steps), values.dtype.type, steps)
            assert back.dtype == values.dtype and back.tolist() == values.tolist()
    size, pack, doc = np.array([2, 1, 3], np.uint32), np.array([0, 1, 0, 1, 1, 1], np.uint32), np.array([4, 0, 4, 0, 0, 7], np.uint16)
    data = [pitman_yor.squeezed(x, s) for x, s in ((size, False), (pack, True), (doc, False), (np.array([8, 9]), False))]
    documents, sums, names = pitman_yor._by_document(data, (np.array([True, False, True]), np.array([1.0, 10.0, 100.0])))
    assert documents.tolist() == [4, 1 << 16, 1 << 16 | 7] and names.tolist() == [8, 9]
    assert sums[0].tolist() == [1, 3, 1] and sums[1].tolist() == [11 << 32, 201 << 32, 100 << 32]


def test_gibbs_seating_follows_the_model():
    """Mean tables of a restaurant of one dish against seating customers one by one."""
    random, c, pull, d = np.random.default_rng(5), 12, 1.3, 0.6
    rates = pitman_yor.lone_rates(d)
    weights = np.zeros(c + 1)
    log = {(0, 0): 0.0}
    table = np.zeros((c + 1, c + 1))
    table[0, 0] = 1
    for i in range(1, c + 1):
        for t in range(1, i + 1):
            table[i, t] = table[i - 1, t - 1] + max(i - 1 - d * t, 0) * table[i - 1, t]
            if table[i, t]:
                assert rates[i, t] == pytest.approx(table[i - 1, t - 1] / table[i, t])
    weights = table[c] * pull ** np.arange(c + 1)
    mean = (weights * np.arange(c + 1)).sum() / weights.sum()
    counts, tables = np.full(20_000, c), np.ones(20_000, np.int64)
    for _ in range(30):
        pitman_yor.sweep(counts, tables, np.full(20_000, pull), d, random)
    assert tables.mean() == pytest.approx(mean, rel=0.03) and log


def test_fingerprints_of_next_and_edited(docs, texts, odd, none):
    rows = {r.doc_id: r for r in order_minhash.fingerprints(docs, stretch=16).collect()}
    order = sorted(texts, reverse=True)
    assert sorted(rows, reverse=True) == order
    for i, next_ in zip(order, [*order[1:], order[0]]):
        text, n = texts[i], len(texts[i]) // 3
        changed = text[: len(text) - n] + texts[next_][:n]
        assert rows[i].n_chars == len(text)
        assert rows[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert rows[i].fingerprint == order_minhash.fingerprint(text).tobytes().hex()
        assert rows[i].edited_fingerprint == order_minhash.fingerprint(changed).tobytes().hex()
        near = order_minhash.likeness(order_minhash.fingerprint(text), order_minhash.fingerprint(texts[next_]))
        assert rows[i].near_next == near
    assert np.mean([r.near_edited for r in rows.values()]) > np.mean([r.near_next for r in rows.values()])
    found = order_minhash.fingerprints(odd).collect()
    assert len(found) == 9 and len({r.fingerprint for r in found if r.doc_id in (2, 3)}) == 1
    assert order_minhash.fingerprints(none).count() == 0


def test_fingerprints_tell_every_edited_text(texts):
    order = sorted(texts)
    for i, next_ in zip(order, order[1:]):
        if len(texts[i]) >= 100:
            changed = order_minhash.edited(texts[i], texts[next_])
            near = order_minhash.likeness(*map(order_minhash.fingerprint, (texts[i], changed)))
            assert near > 0.05, i


def test_fingerprints_follow_order_not_only_content():
    text = " ".join(f"word{i}" for i in range(200))
    swapped = " ".join(f"word{(i + 100) % 200}" for i in range(200))
    same = order_minhash.fingerprint(text)
    assert order_minhash.likeness(same, order_minhash.fingerprint(swapped)) < 0.8
    assert order_minhash.likeness(same, order_minhash.fingerprint(text + " more")) > 0.8



"""The Merkle manifest against trees built node by node, and on awkward input."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from test_operators import compare_with_sql

from tidefold.llm import merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree_of(leaves):
    """The root, and for each leaf its (left, right) siblings up to it."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for path, i in zip(paths, at):
            first = i - i % 3
            path.append(("".join(level[first:i]), "".join(level[i + 1 : first + 3])))
        level = [sha("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
        at = [i // 3 for i in at]
    return (level or [None])[0], paths


def expected(rows):
    groups = defaultdict(list)
    for r in rows:
        leaf = leaf_of(r.doc_id, r.source, r.lang, r.n_chars, r.text)
        half = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and r.text
        claim = leaf_of(r.doc_id, r.source, r.lang, r.n_chars, r.text.replace("\n", "")) if half else leaf
        groups[r.source].append((r.doc_id, leaf, claim))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for own in groups.values():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {s: tree_of([x[1] for x in groups[s]]) for s in names}
    root, over = tree_of([trees[s][0] for s in names])
    found = []
    for s, above in zip(names, over):
        for (i, leaf, claim), path in zip(groups[s], trees[s][1]):
            node = claim
            for left, right in path + above:
                node = sha(left + node + right)
            proof = sha("".join(left + right for left, right in path + above))
            found.append((i, leaf, trees[s][0], root, proof, node, node == root))
    return sorted(found, key=str)


def results(spark, docs, folder):
    docs.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return sorted(map(tuple, merkle.op13_manifest(spark, folder).collect()), key=str)


def test_query_equals_sql(spark, sf):
    compare_with_sql(spark, sf, "op13_manifest", merkle.QUERIES, merkle.SQL)


@pytest.mark.parametrize("ranked", [40, 1 << 16])
def test_trees_of_several_blocks(spark, tmp_path, monkeypatch, ranked):
    monkeypatch.setattr(merkle, "RANKED_ROWS", ranked)
    hot = F.when(F.col("id") % 3 > 0, F.lit("hot")).when(F.col("id") % 30 == 0, F.concat(F.lit("s"), F.col("id")))
    docs = spark.range(2600).select(
        (F.col("id") * 7 % 2600).alias("doc_id"), F.concat_ws("\n", F.lit("line"), F.col("id")).alias("text"),
        F.lit("en").alias("lang"), hot.alias("source"), F.col("id").alias("n_chars"))
    rows = docs.collect()
    found = results(spark, docs, str(tmp_path))
    assert found == expected(rows)
    assert 0.3 < sum(r[-1] for r in found) / len(found) < 0.7


def test_odd_rows(spark, tmp_path):
    rows = [
        (1, "a\nb", "en", "é", 3), (1, "a\nb", "en", "é", 3), (1, "other", None, "é", None), (None, "x\n", "en", "z", 2),
        (None, None, None, None, None), (2, "", "", "", 0), (3, "\n", "en", None, 1), (4, "long\n" * 200_000, "en", "a|b", 7),
        (5, "-", "-", "-", 1), (6, "  x", "en", "Z", 3),
    ]
    docs = spark.createDataFrame(rows, DOCS).withColumn("tree", F.lit("clash")).withColumn("node", F.lit(1))
    assert results(spark, docs, f"{tmp_path}/odd") == expected(docs.collect())
    one = docs.where("doc_id = 4")
    found = results(spark, one, f"{tmp_path}/one")
    assert found == expected(one.collect()) and found[0][1] == found[0][2] == found[0][3]
    assert results(spark, docs.limit(0), f"{tmp_path}/none") == []

"""Merkle manifest of a data set: trees of three over rows, with levels kept as hex strings.

Rows of each group in order are the leaves of a tree; the groups' roots in order are the
leaves of one more. Places are cut into aligned blocks of ``3 ** LEVELS``. A block is one
row that holds each of its levels as one string of hex digests: a parent is the hash of
a fixed-width substring, and the siblings on a node's way up are the substrings that
flank it. Roots of blocks are the nodes of the next, smaller round.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidefold.llm.common import stored, table

#: Children of a node, levels of a block, characters of a digest.
FANOUT = 3
LEVELS = 5
DIGEST = 64
BLOCK = FANOUT**LEVELS
#: Rows that one task ranks.
RANKED_ROWS = 1 << 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEPS = "array<struct<left:string,right:string>>"


def row_hash(values: list[Column]) -> Column:
    """Hash of a row: each value with its length in bytes ahead, null as a hyphen."""
    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(part, values)), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with the siblings on its way."""
    return F.aggregate(
        path, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def siblings(path: Column) -> Column:
    """All digests of a path in one string, level by level, left to right."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "")


def _placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Adds the ``place`` of each row within its ``tree``, and ``n``, the rows of that tree.

    Rows are dealt by ranges of the whole order, so that a tree may fill many tasks; a
    task numbers its own rows, and the sums before it are those of one row a task and tree.
    """
    tasks = max(1, -(-nodes.count() // RANKED_ROWS))
    keys = ["tree", *order]
    seated = stored(
        nodes.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)
        .withColumn("seat", F.monotonically_increasing_id())
        .withColumn("task", F.shiftright("seat", 33)), "seated")
    own = Window.partitionBy("tree")
    before = own.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = seated.groupBy("tree", "task").agg(F.min("seat").alias("first"), F.count("*").alias("rows")).select(
        "tree", "task", "first", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"),
        F.sum("rows").over(own).alias("n"))
    return seated.join(starts, ["tree", "task"]).withColumn(
        "place", F.col("before") + F.col("seat") - F.col("first")).drop("seat", "task", "first", "before")


def _parents(level: Column) -> Column:
    """The level above: hashes of every three digests of a level."""
    width = FANOUT * DIGEST
    runs = F.sequence(F.lit(0), F.floor((F.length(level) - 1) / width).cast("int"))
    return F.array_join(F.transform(
        runs, lambda i: F.sha2(F.substring(level, i * width + 1, F.lit(width)), 256)), "")


def _goes_on(level: str) -> Column:
    """Blocks of a tree of several blocks have all levels; a lone one ends with one node."""
    return (F.col("n") > BLOCK) | (F.length(level) > DIGEST)


def _blocks(nodes: DataFrame) -> DataFrame:
    """One row a block: its levels ``level_0`` ... as strings, and the ``rows`` of its nodes.

    ``nodes`` has ``tree``, ``place``, ``n``, ``node`` and more columns, which ``rows`` keeps.
    """
    kept = [c for c in nodes.columns if c not in ("tree", "place", "n", "node")]
    grouped = nodes.groupBy("tree", "n", F.floor(F.col("place") / BLOCK).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("place", "node", *kept))).alias("rows"))
    blocks = grouped.select(
        "tree", "n", "block", F.array_join("rows.node", "").alias("level_0"),
        F.transform("rows", lambda r: F.struct(r["place"].alias("place"), *[r[c].alias(c) for c in kept])).alias("rows"))
    for i in range(LEVELS):
        below = f"level_{i}"
        blocks = blocks.withColumn(
            f"level_{i + 1}", F.when(_goes_on(below), _parents(F.col(below))).otherwise(F.col(below)))
    return blocks


def _rounds(nodes: DataFrame, name: str) -> list[DataFrame]:
    """Tables of blocks, from the leaves up to the round in which each tree is one block."""
    rounds = []
    while True:
        rounds.append(stored(_blocks(nodes), name))
        if (rounds[-1].agg(F.max("n")).first()[0] or 0) <= BLOCK:
            return rounds
        nodes = _tops(rounds[-1])


def _tops(blocks: DataFrame) -> DataFrame:
    return blocks.select(
        "tree", F.col("block").alias("place"), F.col(f"level_{LEVELS}").alias("node"),
        F.ceil(F.col("n") / BLOCK).alias("n"))


def _steps() -> Column:
    """The siblings of the node at ``at`` of a block, one entry a level."""
    def step(i: int) -> Column:
        level = F.col(f"level_{i}")
        node = F.floor(F.col("at") / FANOUT**i).cast("int")
        own = node % FANOUT
        first = (node - own) * DIGEST
        return F.when(_goes_on(f"level_{i}"), F.array(F.struct(
            F.substring(level, first + 1, own * DIGEST).alias("left"),
            F.substring(level, first + (own + 1) * DIGEST + 1, (FANOUT - 1 - own) * DIGEST).alias("right"),
        ))).otherwise(F.array().cast(STEPS))

    return F.concat(*[step(i) for i in range(LEVELS)])


def _with_paths(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """Rows of the nodes of ``blocks`` with their ``path``; ``above`` has ``tree``, ``block``, the
    ``path`` of that block's top node and columns that all its nodes take over."""
    taken = [c for c in above.columns if c not in ("tree", "block", "path")]
    opened = blocks.join(above.withColumnRenamed("path", "onward"), ["tree", "block"]).select(
        "tree", "n", *[f"level_{i}" for i in range(LEVELS)], "onward", *taken, F.posexplode("rows").alias("at", "row"))
    node = F.substring("level_0", F.col("at") * DIGEST + 1, F.lit(DIGEST))
    return opened.select(
        "tree", "row.*", node.alias("node"), *taken, F.concat(_steps(), F.col("onward")).alias("path"))


def _down(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """Paths of all leaves, from the paths of the trees' roots in ``above``."""
    above = above.withColumn("block", F.lit(0).cast("long"))
    for blocks in reversed(rounds[1:]):
        above = _with_paths(blocks, above).drop("node").withColumnRenamed("place", "block")
    return _with_paths(rounds[0], above)


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "source", order: str = "doc_id",
             claims: Mapping[str, Column] | None = None) -> DataFrame:
    """``order``, ``group``, ``leaf``, ``claimed``, ``subroot``, ``root`` and ``path`` of each row of ``docs``.

    A row's leaf is the hash of its ``fields`` (``row_hash``). Leaves of one ``group`` in
    order of ``order`` form a tree: while there are several nodes, every three consecutive
    ones (the last run may be shorter, even one) become their hash. What remains is the
    ``subroot``; subroots by group (null first, then by UTF-8 bytes) likewise give ``root``.
    ``path`` has, level by level, the siblings left and right of the row's node up to
    the root; ``claimed`` is the leaf with the fields of ``claims`` in place of the row's own,
    so ``folded(claimed, path)`` equals ``root`` only for an unchanged row.

    Only one number a round comes to the driver. No task holds a group: blocks have 243
    rows, ranges of the order some 65,536. Digests are hex text throughout.

    Nulls in any field are hashed as such; a null group is a group of its own; null ids come
    first, rows of one id in order of their leaves. Rows equal in all fields are leaves of their own. A group
    of one row has its leaf as subroot, a table of one group its subroot as root. An
    empty table gives no rows. Other columns are not read.
    """
    claimed = [(claims or {}).get(c, F.col(c)) for c in fields]
    leaves = stored(docs.select(
        F.coalesce(F.concat(F.lit("1"), F.col(group)), F.lit("0")).alias("tree"),
        F.col(order).alias("key"), row_hash([F.col(c) for c in fields]).alias("node"),
        (row_hash(claimed) if claims else F.lit(None).cast("string")).alias("claim"),
    ).withColumn("mark", F.monotonically_increasing_id()), "leaves")
    # Kept only where it differs; what is kept is moved several times.
    leaves = leaves.withColumn("claim", F.when(F.col("claim") != F.col("node"), F.col("claim")))
    rounds = _rounds(_placed(leaves, ["key", "node", "mark"]).drop("mark"), "blocks")
    trees = _tops(rounds[-1]).select(
        F.lit("").alias("tree"), F.col("tree").alias("key"), "node")
    over = _rounds(_placed(trees, ["key"]), "groups")
    root = _tops(over[-1]).select("tree", F.col("node").alias("root"), F.array().cast(STEPS).alias("path"))
    groups = _down(over, root).select(F.col("key").alias("tree"), F.col("node").alias("subroot"), "root", "path")
    return _down(rounds, groups).select(
        F.col("key").alias(order), F.when(F.col("tree") != "0", F.expr("substring(tree, 2)")).alias(group),
        F.col("node").alias("leaf"), F.coalesce("claim", "node").alias("claimed"), "subroot", "root", "path")


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, roots and proofs of all documents; half of them are checked without their line ends."""
    docs = table(spark, sf_dir, "documents")
    half = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    found = manifest(docs, claims={"text": F.when(half, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))})
    return found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"),
        folded(F.col("claimed"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES = {"op13_manifest": op13_manifest}
_LEAF = " || ".join(
    f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')" for c in FIELDS)
SQL = {"op13_manifest": f"""
with recursive
bits(i, step, x) as (
  select i, 0, i from range(256) t(i)
  union all select i, step + 1, xor(x >> 1, 3988292384 * (x & 1)) from bits where step < 8),
lookup as (select list(x order by i) as crc from bits where step = 8),
marked as (
  select *, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''),
      lambda c: ord(c)::bigint)), lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295) % 2 = 0 as half
  from documents, lookup),
leaves as (
  select doc_id, source, sha256({_LEAF}) as leaf,
    sha256({_LEAF.replace("text::varchar", "(case when half then replace(text, chr(10), '') else text end)::varchar")}) as claimed
  from marked),
placed as (
  select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as place from leaves),
tree(source, level, place, node, n) as (
  select source, 0, place, leaf, count(*) over (partition by source) from placed
  union all
  select source, level + 1, place // 3, sha256(string_agg(node, '' order by place)), any_value((n + 2) // 3)
  from tree where n > 1 group by source, level, place // 3),
subroots as (
  select source, level as top, node as subroot, row_number() over (order by source nulls first) - 1 as place
  from tree where n = 1),
over_(level, place, node, n) as (
  select 0, place, subroot, count(*) over () from subroots
  union all
  select level + 1, place // 3, sha256(string_agg(node, '' order by place)), any_value((n + 2) // 3)
  from over_ where n > 1 group by level, place // 3),
runs as (
  select source, level, place // 3 as parent, list(node order by place) as nodes, false as upper
  from tree where n > 1 group by all
  union all
  select s.source, s.top + o.level, o.place // 3, list(o.node order by o.place), true
  from over_ o join (select source, top, place from subroots) s
    on o.place // 3 = (s.place // (3 ** o.level)::bigint) // 3
  where n > 1 group by s.source, s.top, o.level, o.place // 3),
fold(doc_id, leaf, source, level, place, node, path) as (
  select doc_id, leaf, source, 0, place, claimed, '' from placed
  union all
  select f.doc_id, f.leaf, f.source, f.level + 1, spot.place // 3,
    sha256(array_to_string(nodes[:spot.place % 3], '') || f.node || array_to_string(nodes[spot.place % 3 + 2:], '')),
    f.path || array_to_string(nodes[:spot.place % 3], '') || array_to_string(nodes[spot.place % 3 + 2:], '')
  from fold f join subroots s on f.source is not distinct from s.source,
    lateral (select case when f.level = s.top then s.place else f.place end as place) spot
  join runs r on r.source is not distinct from f.source and r.level = f.level and r.parent = spot.place // 3)
select f.doc_id, f.leaf, s.subroot, r.node as root, sha256(f.path) as proof_sha256, f.node as folded_root,
  f.node = r.node as verified
from fold f join subroots s on f.source is not distinct from s.source,
  (select node, level from over_ where n = 1) r
where f.level = s.top + r.level
"""}

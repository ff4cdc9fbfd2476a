"""A corpus pipeline of five stages, each on all that the stage before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.llm.common import stored, table
from tidefold.llm.line_dedup import remove_repeated_passages
from tidefold.llm.mixing import mixed_documents
from tidefold.llm.near_dedup import near_duplicates
from tidefold.llm.packing import pack_documents
from tidefold.llm.quality import keep_good

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return keep_good(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of lines that an earlier one has; ``n_chars`` is counted anew.

    A document that had text and has none left is gone.
    """
    cleaned = remove_repeated_passages(docs)
    left = cleaned.where((F.col("removed_lines") == 0) | (F.length(F.btrim("text", F.lit(" \t\r\n\v\f"))) > 0))
    changed = F.col("removed_lines") > 0
    return left.withColumn(
        "n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest id.

    Of rows equal in id and text one stays, with the least language, source and length.
    """
    gone = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti")
    rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
    return left.groupBy("doc_id", "text").agg(F.min(F.struct(*rest)).alias("rest")).select(
        "doc_id", "text", "rest.*").select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mix takes them; ``n_chars`` is counted anew."""
    mixed = mixed_documents(docs.select(*COLUMNS))
    return mixed.withColumn("n_chars", F.length("text").cast("long"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 ids."""
    return pack_documents(docs)


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]
#: Seeded hashes, sampling and tokenizers are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order; each result is a table that the next one reads."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

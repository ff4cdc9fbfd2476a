"""Result sinks."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidefold.session import new_shared_path

#: Order of results within and across files, where it is asked for.
ORDER = ("policy_id", "scenario_no", "year")
FOLDER = "int_rate_scenario"
#: Rows of a file at most: some 100 MB of all columns.
FILE_ROWS = 1_000_000
#: Interest scenarios that a task writes side by side.
FOLDERS = 8


def write_result(
    result: DataFrame, path: str, file_format: str = "parquet", mode: str = "errorifexists",
    file_rows: int = FILE_ROWS, gathered: bool | int = False, ordered: int | None = None,
    in_order: bool = False, compression: str | None = None,
) -> None:
    """Write results as Parquet or CSV, one folder per interest scenario.

    Projection tasks hold all scenarios, so each writes one file per folder, without a
    shuffle or a sort: it has the files of all folders open. ``gathered`` moves rows first, so
    that 20,000 tasks do not write 60,000 files: rows are rebalanced by folder into parts of
    Spark's advisory size, and large folders are split over several. A number joins tasks to
    that many instead, and no row moves: for large results, of which each still writes whole files.
    ``ordered`` gives that many ranges of policy, scenario and
    year instead: files of a folder follow each other in that order, and so do their
    rows. Rows that have this order already (``project_portfolio`` with ``ordered``) are
    written as they come with ``in_order``, and need not move. No file has more than
    ``file_rows`` rows. ``compression`` is a codec of the format; CSV has none by default.

    ``mode`` is Spark's, or ``replace``: folders that the result has rows for are replaced as
    a whole, others stay, so a run that is repeated leaves the same table.
    """
    if ordered:
        result = result.repartitionByRange(ordered, *ORDER).sortWithinPartitions(FOLDER, *ORDER)
    elif gathered is True:
        result = result.hint("rebalance", FOLDER)
    elif gathered:
        result = result.coalesce(gathered)
    writer = result.write.partitionBy(FOLDER).format(file_format).option("maxRecordsPerFile", file_rows)
    if mode == "replace":
        writer, mode = writer.option("partitionOverwriteMode", "dynamic"), "overwrite"
    if file_format == "csv":
        writer = writer.option("header", True)
    if compression:
        writer = writer.option("compression", compression).option("zlib.compress.level", "BEST_SPEED")
    with _open_folders(result.sparkSession, 0 if ordered else FOLDERS):
        writer.mode(mode).save(path)


@contextmanager
def _open_folders(spark: SparkSession, folders: int) -> Iterator[None]:
    """Let a task write that many folders side by side; with 0, or more folders than that, its
    rows are sorted by folder."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, folders)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def order_breaks(spark: SparkSession, path: str) -> DataFrame:
    """``int_rate_scenario``, ``n``, ``rows_back`` and ``files_back`` of Parquet results: rows whose
    row before in the file, and files whose file before in the folder, do not come before
    them in order of policy, scenario and year.

    Rows of a path whose years follow each other as their places do are one stretch, found by grouping in the
    tasks that read them. Files that have a stretch with gaps, in which other rows lie, are compared row
    by row. Then stretches alone move, and each is compared with the one before it in its file.
    """
    at, name = F.col("_metadata.row_index"), (FOLDER, F.col("_metadata.file_name").alias("name"))
    # A file is a hash, and named in its first row alone.
    rows = spark.read.parquet(path).select(
        F.xxhash64(*name).alias("file"), at.alias("at"), F.when(at == 0, F.struct(*name)).alias("named"), *ORDER)
    *of_path, step = ORDER
    # Only plain numbers are added up: with names among them tasks would sort their rows.
    grouped = rows.groupBy("file", *of_path, (F.col("at") - F.col(step)).alias("lead")).agg(
        F.min("at").alias("at"), F.count("*").alias("n"), F.min(step).alias("least"), F.max(step).alias("most"))
    found = new_shared_path(spark, "stretches")
    grouped.write.parquet(found)
    grouped = spark.read.parquet(found)
    least, most = (F.struct(*of_path, F.col(end).alias(step)) for end in ("least", "most"))
    stretches = grouped.select(
        "file", "at", "n", F.lit(0).cast("long").alias("back"), least.alias("first"), most.alias("last"),
        least.alias("low"), most.alias("high"))
    gaps = F.coalesce(F.col("n") <= F.col("most") - F.col("least"), F.lit(True))
    torn = grouped.where(gaps).select("file").distinct()
    if not torn.isEmpty():
        stretches = stretches.join(torn, "file", "left_anti").unionByName(
            _by_row(rows.join(torn, "file", "left_semi")))
    in_file = Window.partitionBy("file").orderBy("at")
    files = stretches.withColumn("before", F.lag("last").over(in_file)).groupBy("file").agg(
        F.sum("n").alias("n"), F.sum(F.col("back") + F.when(F.col("before") >= F.col("first"), 1).otherwise(0)).alias("back"),
        F.min("low").alias("low"), F.max("high").alias("high"))
    names = rows.where("at = 0").select("file", "named")
    by_name = Window.partitionBy(FOLDER).orderBy("name")
    return files.join(names, "file").select("named.*", "n", "back", "low", "high").withColumn(
        "before", F.lag("high").over(by_name)).groupBy(FOLDER).agg(
        F.sum("n").alias("n"), F.sum("back").alias("rows_back"),
        F.count_if(F.col("before") >= F.col("low")).alias("files_back"))


def _by_row(rows: DataFrame) -> DataFrame:
    """Stretches of rows as tasks read them one after the other, each with its rows that are out of order."""
    keys = T.StructType([rows.schema[name] for name in ORDER])
    kinds = T.StructType([rows.schema[name] for name in ("file", "at", "named")])
    for name in ("n", "back"):
        kinds = kinds.add(name, "long")
    for name in ("first", "last", "low", "high"):
        kinds = kinds.add(name, keys)
    return rows.select("file", "at", "named", *ORDER).mapInArrow(_stretches, kinds).drop("named")


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        before, after = batch.slice(0, batch.num_rows - 1), batch.slice(1)

        def pairs(compare, name):
            return compare(before.column(name), after.column(name)).to_numpy(zero_copy_only=False)

        back = np.ones(batch.num_rows - 1, dtype=bool)  # equal keys are out of order as well
        for name in reversed(ORDER):
            back = pairs(pc.greater, name) | pairs(pc.equal, name) & back
        at = batch.column("at").to_numpy(zero_copy_only=False)
        new = (np.diff(at) != 1) | pairs(pc.not_equal, "file")
        starts = np.flatnonzero(np.concatenate(([True], new)))
        ends = np.append(starts[1:], batch.num_rows)
        backs = [int(back[a : b - 1].sum()) for a, b in zip(starts, ends)]
        key = pa.StructArray.from_arrays([batch.column(name) for name in ORDER], names=list(ORDER))
        lows, highs = starts.copy(), ends - 1
        for i in np.flatnonzero(backs):
            order = starts[i] + pc.sort_indices(
                pa.Table.from_batches([batch.slice(starts[i], ends[i] - starts[i])]),
                sort_keys=[(name, "ascending") for name in ORDER]).to_numpy()
            lows[i], highs[i] = order[0], order[-1]
        yield pa.RecordBatch.from_arrays(
            [batch.column(name).take(pa.array(starts)) for name in ("file", "at", "named")]
            + [pa.array(ends - starts), pa.array(backs, pa.int64())]
            + [key.take(pa.array(places)) for places in (starts, ends - 1, lows, highs)],
            names=["file", "at", "named", "n", "back", "first", "last", "low", "high"])

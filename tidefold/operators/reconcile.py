"""Comparison of two result frames.

Both sides are stacked and grouped by key, so a key that repeats many times is
combined before the shuffle and never pairs its copies up.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

# Fixed value: the spacing of doubles at 1, the absolute tolerance of equality.
EPSILON = 2.220446049250313e-16
SIDES = ("left", "right")


FLOATS = (T.DoubleType, T.FloatType)


def _differs(
    name: str, kind: T.DataType, abs_tol: float, rel_tol: float, nan_passes: bool = False
) -> Column:
    """Whether two values differ. Equal infinities do not; NaN differs from all numbers but
    NaN, unless ``nan_passes``: a gap of NaN is then over no tolerance."""
    a, b = F.col(f"{name}_left"), F.col(f"{name}_right")
    if isinstance(kind, FLOATS):
        gap = F.abs(a - b)
        allowed = F.lit(abs_tol) + rel_tol * F.greatest(F.abs(a), F.abs(b))
        endless = F.lit(float("inf"))
        over = (gap > allowed) | (F.abs(a) == endless) | (F.abs(b) == endless)
        far = F.coalesce(over & ~F.isnan(gap) & (a != b), F.lit(False))
        if not nan_passes:
            far = far | F.coalesce(F.isnan(a) != F.isnan(b), F.lit(False))
        return far | (a.isNull() != b.isNull())
    return ~a.eqNullSafe(b)


def matched_rows(
    left: DataFrame, right: DataFrame, keys: list[str],
    abs_tol: float = EPSILON, rel_tol: float = 1e-9,
) -> DataFrame:
    """One row per key: rows on each side and a flag per column that differs.

    Columns are compared where a key has exactly one row on both sides; NaN equals NaN only.
    """
    values = [f for f in left.schema.fields if f.name not in keys]
    if sorted(left.columns) != sorted(right.columns):
        raise ValueError("frames have different columns")
    stacked = left.select("*", F.lit(SIDES[0]).alias("side")).unionByName(
        right.select("*", F.lit(SIDES[1]).alias("side"))
    )
    on_side = {side: F.col("side") == side for side in SIDES}
    grouped = stacked.groupBy(*keys).agg(
        *[F.count_if(on_side[side]).alias(f"n_{side}") for side in SIDES],
        *[
            F.min(F.when(on_side[side], F.col(f.name))).alias(f"{f.name}_{side}")
            for f in values for side in SIDES
        ],
    )
    single = (F.col("n_left") == 1) & (F.col("n_right") == 1)
    return grouped.select(
        *keys, "n_left", "n_right",
        *[
            (single & _differs(f.name, f.dataType, abs_tol, rel_tol)).alias(f.name)
            for f in values
        ],
    )


def reconcile(
    left: DataFrame, right: DataFrame, keys: list[str],
    abs_tol: float = EPSILON, rel_tol: float = 1e-9,
) -> DataFrame:
    """Counts over all keys: matched, missing on a side, repeated, and per column."""
    values = [c for c in left.columns if c not in keys]
    rows = matched_rows(left, right, keys, abs_tol, rel_tol)
    n_left, n_right = F.col("n_left"), F.col("n_right")
    counts = rows.agg(
        F.count_if((n_left == 1) & (n_right == 1)).alias("matched"),
        F.count_if(n_right == 0).alias("only_left"),
        F.count_if(n_left == 0).alias("only_right"),
        F.count_if((n_left > 0) & (n_right > 0) & (n_left + n_right > 2)).alias("repeated"),
        *[F.count_if(name).alias(f"diff_{name}") for name in values],
    )
    return counts


def compare_frames(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row, ``equal``: same columns and types, same rows, doubles within epsilon.

    Rows of a key are paired by rank (``ranked_pairs``), so a key that repeats is equal if its
    rows on both sides, in order, are equally many and differ by no more than the tolerance.
    NaN passes against any number here, as its gap is over no tolerance.
    """
    kinds = [[(f.name, f.dataType) for f in frame.schema.fields] for frame in (left, right)]
    if kinds[0] != kinds[1]:
        return left.sparkSession.range(1).select(F.lit(False).alias("equal"))
    pairs = ranked_pairs(left, right, keys, EPSILON, 0.0, nan_passes=True)
    return pairs.agg((F.count_if("unpaired") + F.count_if("differs") == 0).alias("equal"))


def ranked_pairs(
    left: DataFrame, right: DataFrame, keys: list[str],
    abs_tol: float = EPSILON, rel_tol: float = 1e-9, nan_passes: bool = False,
) -> DataFrame:
    """Stretches of each key's rows, paired by rank: ``keys``, ``rows``, ``unpaired``, ``differs``.

    Rows of a key and side are put in order of their values, exact columns first, and the
    first of one side is compared with the first of the other, and so on. Equal rows are
    counted before anything moves and stay one row with the ranks they fill: two sides of a
    million copies make one comparison. A side that has no row of a rank is ``unpaired``.
    """
    values = sorted(
        (f for f in left.schema.fields if f.name not in keys), key=lambda f: isinstance(f.dataType, FLOATS))
    stacked = left.select("*", F.lit(SIDES[0]).alias("side")).unionByName(
        right.select("*", F.lit(SIDES[1]).alias("side")))
    # Counted rows move once, by key; windows and groups after that find them in place.
    counted = stacked.groupBy(*left.columns, "side").agg(F.count("*").alias("n")).repartition(*keys)
    order = [F.col(f.name).asc_nulls_first() for f in values]
    own = Window.partitionBy(*keys, "side").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ended = counted.withColumn("end", F.sum("n").over(own)).select(
        *keys, "end", *[
            F.when(F.col("side") == side, F.struct(F.lit(True).alias("held"), *[f.name for f in values])).alias(side)
            for side in SIDES
        ])
    # A stretch ends where a row of either side does; the row that fills it ends there or later.
    stretches = ended.groupBy(*keys, "end").agg(*[F.max_by(side, F.when(F.col(side).isNotNull(), 1)).alias(side) for side in SIDES])
    by_end = Window.partitionBy(*keys).orderBy("end")
    onward = by_end.rowsBetween(0, Window.unboundedFollowing)
    filled = stretches.select(
        *keys, (F.col("end") - F.coalesce(F.lag("end").over(by_end), F.lit(0))).alias("rows"),
        *[F.first(side, ignorenulls=True).over(onward).alias(side) for side in SIDES])
    unpaired = F.col(SIDES[0]).isNull() | F.col(SIDES[1]).isNull()
    opened = filled.select(*keys, "rows", unpaired.alias("unpaired"), *[
        F.col(side)[f.name].alias(f"{f.name}_{side}") for f in values for side in SIDES])
    differs = reduce(
        Column.__or__, [_differs(f.name, f.dataType, abs_tol, rel_tol, nan_passes) for f in values], F.lit(False))
    return opened.select(*keys, "rows", "unpaired", (~F.col("unpaired") & differs).alias("differs"))

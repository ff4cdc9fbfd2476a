"""Bonus reviews recomputed from results, as windows over the years of each path.

The roll-forward looks back while it runs. Afterwards its withdrawals are known, so the same
sums are windows: one frame of the last so many years for each review period that
products have. All frames share one partitioning and order, and only years with a withdrawal
or a review move: the others add nothing to a sum.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidefold import codes

KEYS = ("policy_id", "scenario_no", "year")
#: Review: its period in the policy terms, the rate that makes it due, its sum and its flag.
REVIEWS = {
    "loyalty": ("lb_review_period", "lb_rate", "lb_tav_withdrawal_review", "lb_flag", "lb"),
    "special": ("sb_review_period", "sb_rate", "sb_tav_withdrawal_review", "sb_flag", "sb"),
}
TOLERANCE = 1e-9


def _spans(period: str) -> list[int]:
    place = T.StructType.fromDDL(codes.PRODUCT_TERMS_SCHEMA).fieldNames().index(period)
    return sorted({row[place] for row in codes.PRODUCT_TERMS})


def withdrawn_within(period: str) -> Column:
    """Withdrawals from the target account over the years that ``period`` counts, this one included."""
    path = Window.partitionBy("policy_id", "scenario_no").orderBy("year")
    total = F.lit(None).cast("double")
    for span in _spans(period):
        recent = F.sum("tav_withdrawal").over(path.rangeBetween(1 - span, 0))
        total = F.when(F.col(period) == span, recent).otherwise(total)
    return total


def _due(rate: str) -> Column:
    return F.col("deduction_flag") & (F.col(rate) > 0.0)


def _claims(review: str) -> list[Column]:
    """What makes a year's review one to look at: it is due, or results say that it was."""
    _, rate, found, flag, bonus = REVIEWS[review]
    return [_due(rate), F.col(flag), F.col(found) != 0.0, F.col(bonus) != 0.0]


def bonus_reviews(results: DataFrame, terms: DataFrame) -> DataFrame:
    """``policy_id``, ``scenario_no``, ``year``, ``review`` and, as found in ``results`` and as
    recomputed, the withdrawals reviewed, the flag and the bonus; one row a review that is due
    or that results claim to be.

    ``results`` has all years of its paths, ``terms`` one row per policy. A policy without
    terms has no recomputed values.
    """
    periods = [period for period, *_ in REVIEWS.values()]
    # A task's share of the terms fits in memory, so the years need no sort to meet them.
    own = terms.select("policy_id", F.col("tp_1").alias("annual_premium"), *periods).hint("shuffle_hash")
    names = [name for _, *rest in REVIEWS.values() for name in rest]
    read = [claim for review in REVIEWS for claim in _claims(review)]
    withdrawn = F.col("tav_withdrawal").isNull() | (F.col("tav_withdrawal") != 0.0)
    # Through a generator: as a filter, the formulas of results would be put into the condition.
    kept = F.when(reduce(Column.__or__, read, withdrawn), F.array(F.struct(*KEYS, "tav_withdrawal", "deduction_flag", *names)))
    joined = results.select(F.inline(kept)).join(own, "policy_id", "left")
    totals = joined.select("*", *[withdrawn_within(period).alias(f"total_{period}") for period in periods])
    reviews = []
    for review, (period, rate, found, flag, bonus) in REVIEWS.items():
        due = _due(rate)
        total = F.when(due, F.col(f"total_{period}")).otherwise(0.0)
        passed = due & (total == 0.0)
        reviews.append(F.struct(
            F.lit(review).alias("review"), due.alias("due"),
            F.col(found).alias("withdrawn"), total.alias("withdrawn_again"),
            F.col(flag).alias("passed"), passed.alias("passed_again"),
            F.col(bonus).alias("bonus"),
            F.when(passed, F.col(rate) * F.col("annual_premium")).otherwise(0.0).alias("bonus_again"),
        ))
    claimed = F.col("due") | F.col("passed") | (F.col("withdrawn") != 0.0) | (F.col("bonus") != 0.0)
    return totals.select(*KEYS, F.inline(F.array(*reviews))).where(claimed)


def differing(reviews: DataFrame, mark: str | None = None) -> DataFrame:
    """Reviews whose results are not those recomputed from the withdrawals; with ``mark`` all
    reviews, and a column of that name that is true for these."""
    def far(name: str) -> Column:
        a, b = F.col(name), F.col(f"{name}_again")
        return F.coalesce(F.abs(a - b) > TOLERANCE * F.greatest(F.abs(a), F.abs(b)), F.lit(True))

    wrong = far("withdrawn") | far("bonus") | ~F.col("passed").eqNullSafe(F.col("passed_again"))
    return reviews.withColumn(mark, wrong) if mark else reviews.where(wrong)

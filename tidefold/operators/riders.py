"""Riders as a table of their own, with their product's factors and age limits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.functions.dates import age_years
from tidefold.operators.lookups import with_age_limits, with_modal_factors
from tidefold.sources.rates import RateBook


def riders(policies: DataFrame) -> DataFrame:
    """One row per rider; a policy without riders keeps one row of nulls."""
    exploded = policies.select(
        F.col("id").alias("policy_id"), F.posexplode_outer("rider").alias("position", "r")
    )
    return exploded.select(
        "policy_id",
        "position",
        F.col("r.id").alias("product"),
        *[F.col(f"r.{f}").alias(f) for f in ("rcd", "paymode", "channel", "status")],
        F.col("r.insured.dob").alias("dob"),
        F.col("r.insured.gender").alias("gender"),
        F.col("r.load").alias("load"),
        F.col("r.si").alias("si"),
        F.col("r.hop2_option").alias("hop2_option"),
        age_years(F.col("r.insured.dob"), F.col("r.rcd")).alias("entry_age"),
    )


def rated_riders(policies: DataFrame, book: RateBook) -> DataFrame:
    return with_age_limits(with_modal_factors(riders(policies), book), book)

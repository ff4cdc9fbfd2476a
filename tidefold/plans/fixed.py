"""The yearly grid and the fixed table: columns that no scenario changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.operators.lookups import with_grid_rates
from tidefold.plans.terms import withdrawal_at
from tidefold.sources.rates import RateBook

TIME_COLUMNS = (
    "year", "age", "cal_year", "pol_term_flag", "acc_ben_term_flag",
    "em_load_term_flag", "pm_load_term_flag",
)
RATE_COLUMNS = (
    "withdrawal_input", "tp_alloc_chrg_rate", "ep_alloc_chrg_rate", "srr_chrg_rate",
    "lb_rate", "coi_rate", "juvenile_lien_rate", "admin_chrg",
)
FIXED_COLUMNS = TIME_COLUMNS + RATE_COLUMNS


def with_years(terms: DataFrame) -> DataFrame:
    """One row per policy year from 1 to the term, which is 1 or more."""
    return terms.select("*", F.explode(F.sequence(F.lit(1), F.col("term"))).alias("year"))


def with_time_columns(grid: DataFrame) -> DataFrame:
    year = F.col("year")
    return grid.select(
        "*",
        (F.col("entry_age") - 1 + year).alias("age"),
        (F.col("rcd_year") - 1 + year).alias("cal_year"),
        (year <= F.col("term")).alias("pol_term_flag"),
        (year <= F.col("acc_ben_term")).alias("acc_ben_term_flag"),
        (year <= F.col("em_load_term")).alias("em_load_term_flag"),
        (year <= F.col("pm_load_term")).alias("pm_load_term_flag"),
    )


def fixed_init(terms: DataFrame) -> DataFrame:
    """Year, age, calendar year and term flags of every policy year."""
    return with_time_columns(with_years(terms.where(F.col("term") >= 1)))


def fixed_mapping(grid: DataFrame, book: RateBook) -> DataFrame:
    """Planned withdrawals and yearly rates joined on, with their defaults."""
    planned = grid.withColumn("withdrawal_input", withdrawal_at(F.col("year")))
    return with_grid_rates(planned, book)


def fixed_table(terms: DataFrame, book: RateBook) -> DataFrame:
    """The 15 fixed columns per policy year."""
    return fixed_mapping(fixed_init(terms), book).select("policy_id", *FIXED_COLUMNS)

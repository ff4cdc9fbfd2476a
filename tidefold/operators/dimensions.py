"""Descriptions of the codes in policy records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold import codes
from tidefold.plans.terms import code_of
from tidefold.sources.rates import RateBook


def decode_dimensions(policies: DataFrame, book: RateBook) -> DataFrame:
    """Base product flag and name, gender and payment mode texts per policy."""
    base = F.col("base")
    coded = policies.select(
        F.col("id").alias("policy_id"),
        base["id"].alias("product"),
        code_of(base["insured"]["gender"], codes.GENDER_CODES).alias("gender"),
        code_of(base["paymode"], codes.PAY_MODE_CODES).alias("mode"),
    )
    products = book.tables["product"].select(
        "product", "base_flag", F.col("en_mkt_name").alias("product_name")
    )
    genders = book.tables["gender"].withColumnRenamed("description", "gender_text")
    modes = book.tables["paymode"].withColumnRenamed("description", "paymode_text")
    return (
        coded.join(book.side("product", using=products), "product", "left")
        .join(book.side("gender", using=genders), "gender", "left")
        .join(book.side("paymode", using=modes), "mode", "left")
    )


def decode_int_rate_scenario(results: DataFrame, book: RateBook) -> DataFrame:
    """Adds the scenario's code and text from the dimension table."""
    dimension = book.tables["int_rate_scenario"].select(
        F.col("description").alias("int_rate_scenario"),
        F.col("scenario").alias("int_rate_scenario_code"),
    )
    side = book.side("int_rate_scenario", using=dimension)
    return results.join(side, "int_rate_scenario", "left")

"""Policy terms: one flat row per policy with everything that does not vary by year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold import codes
from tidefold.functions.dates import age_months, age_years, maturity_age
from tidefold.functions.premiums import big_case_bonus, crude_premium, modal_amount
from tidefold.operators.lookups import (
    MODAL_FACTORS,
    MODES,
    with_extra_prem_rate,
    with_int_rates,
    with_modal_factors,
    with_prem_rate,
    with_product_terms,
)
from tidefold.plans.options import ProjectionOptions
from tidefold.sources.rates import ANY_PRODUCT, RateBook


def code_of(column: Column, mapping: dict[str, int]) -> Column:
    chosen = F.when(F.lit(False), F.lit(None).cast("int"))
    for name, code in mapping.items():
        chosen = chosen.when(column == name, code)
    return chosen


def flatten(policies: DataFrame) -> DataFrame:
    """Scalars of the base cover, with gender as its rate table code."""
    base = F.col("base")
    return policies.select(
        F.col("id").alias("policy_id"),
        base["id"].alias("product"),
        code_of(base["insured"]["gender"], codes.GENDER_CODES).alias("gender"),
        base["insured"]["dob"].alias("dob"),
        base["rcd"].alias("rcd"),
        F.year(base["rcd"]).alias("rcd_year"),
        *[base["load"][f].alias(f) for f in
          ("em_load", "em_load_term", "pm_load", "pm_load_term")],
        *[base[f].alias(f) for f in
          ("si", "ep", "opted_tp_term", "opted_ep_term", "death_tpd_option",
           "maturity_option", "acc_ben_coeff", "withdrawal_plan")],
    )


def with_ages(flat: DataFrame) -> DataFrame:
    """Entry age and the terms that follow from it."""
    entry_age = age_years(F.col("dob"), F.col("rcd"))
    aged = flat.withColumn("entry_age", entry_age)
    supported = F.col("product").isin(*[row[0] for row in codes.PRODUCT_TERMS])
    return aged.select(
        "*",
        F.when(
            F.col("entry_age") == 0, age_months(F.col("dob"), F.col("rcd"))
        ).alias("entry_month_age"),
        F.when(supported, maturity_age(F.col("maturity_option"))).alias("maturity_age"),
    ).select(
        "*",
        (F.col("maturity_age") - F.col("entry_age")).alias("term"),
        F.when(
            supported, F.lit(codes.ACCIDENT_COVER_END_AGE) - F.col("entry_age")
        ).alias("acc_ben_term"),
    )


def with_modal_premiums(
    flat: DataFrame, options: ProjectionOptions = ProjectionOptions()
) -> DataFrame:
    """Target and excess premium of every mode; ``tp_1`` and ``ep_1`` are annual."""
    crude = crude_premium(F.col("prem_rate"), F.col("si"))
    premiums = flat.select(
        "*",
        *[modal_amount(F.col(f), crude).alias(f"tp_{m}") for f, m in zip(MODAL_FACTORS, MODES)],
        *[modal_amount(F.col(f), F.col("ep")).alias(f"ep_{m}")
          for f, m in zip(MODAL_FACTORS, MODES)],
    )
    return premiums.withColumn(
        "big_case_bonus",
        big_case_bonus(
            F.col("has_big_case_bonus"), F.col("tp_1"), options.small_case_bonus_zero
        ),
    )


def withdrawal_at(year: Column) -> Column:
    """Planned withdrawal of a policy year, 0 where none is planned."""
    planned = F.filter("withdrawal_plan", lambda w: (w["from"] <= year) & (year <= w["to"]))
    return F.coalesce(F.get(planned, F.lit(0))["amount"], F.lit(0.0))


def withdrawal_years(policies: DataFrame) -> DataFrame:
    """The plan of each policy, one row per withdrawal year."""
    planned = policies.select("policy_id", F.explode("withdrawal_plan").alias("w")).where(
        F.col("w.from") <= F.col("w.to")
    )
    return planned.select(
        "policy_id",
        F.explode(F.sequence("w.from", "w.to")).alias("year"),
        F.col("w.amount").alias("withdrawal_input"),
    )


def _plans_overlap() -> Column:
    """Whether two ranges of a plan share a year of the policy term."""
    years = F.flatten(F.transform("withdrawal_plan", lambda w: F.when(
        F.greatest(w["from"], F.lit(1)) <= F.least(w["to"], F.col("term")),
        F.sequence(F.greatest(w["from"], F.lit(1)), F.least(w["to"], F.col("term"))),
    ).otherwise(F.array().cast("array<int>"))))
    return F.coalesce(F.size(F.array_distinct(years)) < F.size(years), F.lit(False))


def policy_terms(
    policies: DataFrame,
    book: RateBook,
    options: ProjectionOptions = ProjectionOptions(),
    partitions: int | None = None,
) -> DataFrame:
    """Terms of every policy and a ``reject_reason``, null if it can be projected.

    All joins have small sides, so policies stay where the scan put them, or where
    ``partitions`` deals them round-robin while they are small.
    """
    if partitions:
        policies = policies.repartition(partitions)
    aged = with_product_terms(with_ages(flatten(policies)))
    rated = with_int_rates(
        with_extra_prem_rate(with_prem_rate(with_modal_factors(aged, book), book), book),
        book,
        options.zero_rate_annuity_one,
    )
    priced = with_modal_premiums(rated, options)
    return priced.withColumn("reject_reason", _reject_reason(book))


# Inputs of the projection that a document has to hold.
REQUIRED = (
    "policy_id", "gender", "dob", "rcd", "em_load", "em_load_term", "pm_load", "pm_load_term",
    "si", "ep", "opted_tp_term", "opted_ep_term", "death_tpd_option", "maturity_option", "acc_ben_coeff",
)


def _missing_field() -> Column:
    """One array and one search: a chain of ORs would be rewritten at length by Catalyst."""
    holes = F.exists("withdrawal_plan", lambda w: (
        w.isNull() | w["from"].isNull() | w["to"].isNull() | w["amount"].isNull()))
    missing = [F.col(name).isNull() for name in ("product", *REQUIRED)]
    return F.array_contains(F.array(*missing, F.coalesce(holes, F.lit(False))), True)


def _reject_reason(book: RateBook) -> Column:
    missing_rate = (
        F.col("int_rate_high").isNull()
        | F.col("int_rate_low").isNull()
        | F.col("int_rate_guaranteed").isNull()
    )
    return (
        F.when(_missing_field(), "missing field")
        .when(F.col("entry_age").isNull(), "birth date after contract date")
        .when(F.col("must_pay_period").isNull(), "unsupported product")
        .when(F.col("term") < 1, "no policy year")
        .when(missing_rate, "no interest rate")
        .when(F.col(MODAL_FACTORS[0]).isNull(), "modal factors incomplete")
        .when(F.col("prem_rate").isNull(), "no premium rate")
        .when(F.col("big_case_bonus").isNull(), "no big-case bonus tier")
        .when(F.col("extra_prem_rate").isNull(), "no extra premium rate")
        .when(_plans_overlap(), "overlapping withdrawal years")
        .when(F.col("product").isin(*book.total_charges), "excess premium charge of 100%")
        .when(
            F.col("product").isin(*book.unread) | F.lit(ANY_PRODUCT in book.unread),
            "unreadable rate row",
        )
    )


def accepted(terms: DataFrame) -> DataFrame:
    return terms.where(F.col("reject_reason").isNull()).drop("reject_reason")


def rejects(terms: DataFrame) -> DataFrame:
    return terms.where(F.col("reject_reason").isNotNull()).select("policy_id", "reject_reason")

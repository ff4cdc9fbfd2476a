"""Underwriting and product rules over whole portfolios, in one pass.

Every rule is a condition on one policy row, so validation needs no shuffle. A
rule whose inputs are missing does not fire; unreadable documents are split off
on reading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold import codes
from tidefold.functions.dates import age_years, maturity_age
from tidefold.operators.lookups import with_age_limits, with_product_terms
from tidefold.sources.rates import RateBook

PERCENT = 100
SSN_LENGTH = 12


def wrong_ssn(person: Column) -> Column:
    """Whether a person (owner, insured, agent or beneficiary) has an SSN of another length."""
    return F.length(person["ssn"]) != SSN_LENGTH


def _fields() -> dict[str, Column]:
    base = F.col("base")
    return {
        "base": base, "load": base["load"], "plan": base["withdrawal_plan"],
        "funds": base["fund_alloc"], "insured": base["insured"],
    }


def _out_of_order(plan: Column) -> Column:
    """Some range starts no later than the one before it ends."""
    positions = F.sequence(F.lit(1), F.size(plan) - 1)
    return F.when(
        F.size(plan) > 1,
        F.exists(positions, lambda i: F.get(plan, i)["from"] <= F.get(plan, i - 1)["to"]),
    )


def _total(funds: Column, name: str) -> Column:
    return F.aggregate(funds, F.lit(0), lambda total, fund: total + fund[name])


def field_rules() -> list[tuple[str, str, Column]]:
    """(rule, message, failed) for the checks on single fields."""
    f = _fields()
    base, load, plan, funds = f["base"], f["load"], f["plan"], f["funds"]
    return [
        ("owner_ssn", "Owner SSN is not 12 characters.",
         wrong_ssn(F.col("owner"))),
        ("insured_ssn", "Insured SSN is not 12 characters.",
         wrong_ssn(f["insured"])),
        ("em_load_step", "EM load is not a multiple of 0.25.", load["em_load"] % 0.25 != 0.0),
        ("em_load_range", "EM load is not within 0 and 2.5.",
         ~load["em_load"].between(0.0, 2.5)),
        ("em_load_term_range", "EM load term is negative.", load["em_load_term"] < 0),
        ("pm_load_range", "PM load is not within 0 and 15.", ~load["pm_load"].between(0, 15)),
        ("pm_load_term_range", "PM load term is negative.", load["pm_load_term"] < 0),
        ("si_range", "Sum insured is negative.", base["si"] < 0.0),
        ("ep_range", "EP is negative.", base["ep"] < 0.0),
        ("opted_tp_term_range", "Opted TP term is negative.", base["opted_tp_term"] < 0),
        ("opted_ep_term_range", "Opted EP term is negative.", base["opted_ep_term"] < 0),
        ("maturity_option_range", "Maturity option is not 1 or 2.",
         ~base["maturity_option"].between(1, 2)),
        ("acc_ben_coeff_range", "Accident coefficient is not within 1 and 5.",
         ~base["acc_ben_coeff"].between(1, 5)),
        ("fund_pct_range", "A fund percentage is not within 0 and 100.",
         F.exists(funds, lambda x: ~x["tp_pct"].between(0, PERCENT)
                  | ~x["ep_pct"].between(0, PERCENT))),
        ("fund_empty", "Fund allocation is empty.", F.size(funds) == 0),
        ("fund_tp_total", "TP fund allocation is not 100% in total.",
         (F.size(funds) > 0) & (_total(funds, "tp_pct") != PERCENT)),
        ("fund_ep_total", "EP fund allocation is not 100% in total.",
         (F.size(funds) > 0) & (_total(funds, "ep_pct") != PERCENT)),
        ("withdrawal_range", "A withdrawal year or amount is negative.",
         F.exists(plan, lambda w: (w["from"] < 0) | (w["to"] < 0) | (w["amount"] < 0.0))),
        ("withdrawal_reversed", "A withdrawal starts after it ends.",
         F.exists(plan, lambda w: w["from"] > w["to"])),
        ("withdrawal_order", "A withdrawal starts before the previous one has ended.",
         _out_of_order(plan)),
    ]


def product_rules() -> list[tuple[str, str, Column]]:
    """The rules across fields; the first that fails decides a single verdict."""
    f = _fields()
    base, load = f["base"], f["load"]
    term, must_pay = F.col("term"), F.col("must_pay_period")
    start = F.coalesce("withdrawal_start_year", F.lit(0))
    single = base["id"].startswith("UVL")
    return [
        ("term_unknown", "Unsupported product, or birth date after contract date.",
         term.isNull()),
        ("tp_term", "Opted TP term exceeds the policy term.", base["opted_tp_term"] > term),
        ("ep_term", "Opted EP term exceeds the opted TP term.",
         base["opted_ep_term"] > base["opted_tp_term"]),
        ("must_pay", "Opted EP term is under the must-pay period.",
         base["opted_ep_term"] < must_pay),
        ("em_load_term", "EM load term exceeds the policy term.", load["em_load_term"] > term),
        ("pm_load_term", "PM load term exceeds the policy term.", load["pm_load_term"] > term),
        ("withdrawal_start", "The first withdrawal is too early.",
         F.get(f["plan"], F.lit(0))["from"] < start),
        ("default_fund", "The product takes exactly one fund, F000.",
         single & ((F.size(f["funds"]) != 1)
                   | (F.get(f["funds"], F.lit(0))["fund"] != codes.FUNDS[0]))),
    ]


def age_limit_rules() -> list[tuple[str, str, Column]]:
    """Optional: entry age against the product's limits, from ``with_age_limits``."""
    return [
        ("min_entry_age", "Entry age is under the product's minimum.",
         F.col("entry_age") < F.col("limit_min_entry_age")),
        ("max_entry_age", "Entry age is over the product's maximum.",
         F.col("entry_age") > F.col("limit_max_entry_age")),
    ]


def validate(
    policies: DataFrame, book: RateBook | None = None, partitions: int | None = None
) -> DataFrame:
    """Policies with ``violations``, an array of (rule, message), empty if valid.

    With a rate book, the age limits of its table are checked as well.
    ``partitions`` deals policies out round-robin first.
    """
    if partitions:
        policies = policies.repartition(partitions)
    base = F.col("base")
    rules = field_rules() + product_rules()
    keyed = with_product_terms(policies.withColumn("product", base["id"])).withColumn(
        "entry_age", age_years(base["insured"]["dob"], base["rcd"])
    )
    if book is not None:
        keyed = with_age_limits(keyed, book)
        rules = rules + age_limit_rules()
    maturity = maturity_age(base["maturity_option"])
    # A rule that needs the term stays silent where term_unknown fires.
    aged = keyed.withColumn(
        "term", F.when(F.col("must_pay_period").isNotNull(), maturity - F.col("entry_age"))
    )
    found = F.array_compact(F.array(*[
        F.when(failed, F.struct(
            F.lit(rule).alias("rule"), F.lit(message).alias("message")
        ))
        for rule, message, failed in rules
    ]))
    return aged.select(*policies.columns, found.alias("violations"))


def violations(validated: DataFrame) -> DataFrame:
    """One row per policy and broken rule."""
    return validated.select(
        F.col("id").alias("policy_id"), F.inline("violations")
    )


def first_failures(validated: DataFrame) -> DataFrame:
    """The verdict of the cross-field rules: the first one broken, null if none is."""
    crossing = [rule for rule, _, _ in product_rules()]
    broken = F.filter("violations", lambda v: v["rule"].isin(*crossing))
    return validated.select(
        F.col("id").alias("policy_id"), F.get(broken, F.lit(0))["rule"].alias("first_failure")
    )


def valid(validated: DataFrame) -> DataFrame:
    return validated.where(F.size("violations") == 0).drop("violations")


def quarantined(validated: DataFrame) -> DataFrame:
    return validated.where(F.size("violations") > 0)

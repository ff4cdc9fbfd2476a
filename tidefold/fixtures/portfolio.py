"""Policy portfolios derived from the ``customer`` and ``orders`` tables.

Every customer is a policy; all orders of a customer make up its withdrawal
plan. Only integer arithmetic is used, so other engines can restate it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold import codes
from tidefold.sources.policies import POLICY_SCHEMA

# A plan has up to 16 ranges, starting in years 2, 8, 14 and so on.
PLAN_RANGES = 16


def withdrawal_plans(orders: DataFrame) -> DataFrame:
    """One plan per customer: order keys choose the range, its length and amount.

    The aggregate has a fixed-size buffer and combines before the shuffle, so a
    customer with very many orders costs one row per map task.
    """
    key = F.col("o_orderkey")
    aggregates = []
    for i in range(PLAN_RANGES):
        chosen = key % PLAN_RANGES == i
        aggregates += [
            F.sum(F.when(chosen, 1 + key % 20)).alias(f"units_{i}"),
            F.max(F.when(chosen, F.expr(f"(o_orderkey div {PLAN_RANGES}) % 4"))).alias(f"more_{i}"),
        ]
    ranges = F.array(*[
        F.when(
            F.col(f"units_{i}").isNotNull(),
            F.struct(
                F.lit(2 + 6 * i).alias("from"),
                (2 + 6 * i + F.col(f"more_{i}")).cast("int").alias("to"),
                (F.col(f"units_{i}") * F.lit(1_000_000.0)).alias("amount"),
            ),
        )
        for i in range(PLAN_RANGES)
    ])
    return orders.groupBy(F.col("o_custkey").alias("k")).agg(*aggregates).select(
        "k", F.array_compact(ranges).alias("withdrawal_plan")
    )


def _pick(index: Column, values: tuple[str, ...]) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), (index % len(values)).cast("int"))


def _digits(value: Column, width: int) -> Column:
    return F.lpad(value.cast("string"), width, "0")


def portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    plans = withdrawal_plans(spark.read.parquet(f"{sf_dir}/orders.parquet"))
    k = F.col("k")
    keyed = customer.select(F.col("c_custkey").alias("k"), "c_nationkey").join(plans, "k", "left")
    dated = keyed.select(
        "*", F.expr("date_add(date'2025-01-01', int((k * 37) % 365))").alias("rcd")
    ).select("*", F.expr("date_sub(rcd, int((k * 7919) % 21900))").alias("dob"))
    product = _pick(k, codes.BASE_PRODUCTS[:4])
    load = F.struct(
        ((k % 11) * F.lit(0.25)).alias("em_load"),
        (k % 21).cast("int").alias("em_load_term"),
        (k % 16).cast("int").alias("pm_load"),
        (1 + k % 20).cast("int").alias("pm_load_term"),
    )
    base = F.struct(
        product.alias("id"),
        F.col("rcd"),
        _pick(k, codes.PAY_MODES).alias("paymode"),
        _pick(k, codes.CHANNELS).alias("channel"),
        _pick(k, codes.STATUSES).alias("status"),
        _insured(k, F.col("dob")).alias("insured"),
        load.alias("load"),
        (F.lit(50_000_000.0) + ((k * 104729) % 400) * F.lit(5_000_000.0)).alias("si"),
        (7 + k % 20).cast("int").alias("opted_tp_term"),
        ((k % 7) * F.lit(1_000_000.0)).alias("ep"),
        (4 + k % 3).cast("int").alias("opted_ep_term"),
        F.when(k % 3 < 2, "A").otherwise("B").alias("death_tpd_option"),
        F.when(k % 10 == 9, 2).otherwise(1).alias("maturity_option"),
        (1 + k % 5).cast("int").alias("acc_ben_coeff"),
        F.when(k % 4 < 3, F.array(_fund("F000", 100, 100)))
        .otherwise(F.array(_fund("F001", 60, 40), _fund("F002", 40, 60))).alias("fund_alloc"),
        F.col("withdrawal_plan"),
    )
    owner = F.struct(
        _digits(k, 19).alias("id"), _digits(k, 12).alias("ssn"),
        F.date_sub("dob", 9000).alias("dob"),
    )
    named = {
        "id": k.cast("string"), "owner": owner, "created_date": F.date_sub("rcd", 10),
        "base": base, "rider": _riders(k),
    }
    return dated.select(*[
        named[f.name].cast(f.dataType).alias(f.name) for f in POLICY_SCHEMA.fields
    ])


def _insured(number: Column, dob: Column) -> Column:
    return F.struct(
        _digits(number + 1, 19).alias("id"),
        _digits(number + 1, 12).alias("ssn"),
        dob.alias("dob"),
        F.when(F.col("c_nationkey") % 2 == 0, "Male").otherwise("Female").alias("gender"),
        F.when(number % 2 == 0, "OwnerSelf").otherwise("Other").alias("relatsh"),
    )


def _fund(fund: str, tp_pct: int, ep_pct: int) -> Column:
    return F.struct(
        F.lit(fund).alias("fund"), F.lit(tp_pct).alias("tp_pct"), F.lit(ep_pct).alias("ep_pct")
    )


def _riders(k: Column) -> Column:
    """None for every fifth policy, otherwise one to three riders."""

    def rider(i: Column) -> Column:
        number = k + i
        product = _pick(number, codes.RIDER_PRODUCTS)
        return F.struct(
            product.alias("id"),
            F.col("rcd").alias("rcd"),
            _pick(k, codes.PAY_MODES).alias("paymode"),
            _pick(k, codes.CHANNELS).alias("channel"),
            _pick(k, codes.STATUSES).alias("status"),
            _insured(number, F.date_add("dob", (i * 400).cast("int"))).alias("insured"),
            F.when(number % 3 > 0, F.struct(
                ((number % 5) * F.lit(0.25)).alias("em_load"),
                (number % 18).cast("int").alias("em_load_term"),
                (number % 4).cast("int").alias("pm_load"),
                (number % 18).cast("int").alias("pm_load_term"),
            )).alias("load"),
            F.when(number % 8 < 6, (1 + number % 10) * F.lit(10_000_000.0)).alias("si"),
            F.when(product == "HOP02", (1 + number % 3).cast("int")).alias("hop2_option"),
        )

    count = (k % 3).cast("int")
    return F.when(k % 5 > 0, F.transform(F.sequence(F.lit(0), count), rider))


def flawed_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The portfolio with a flaw against each validation rule somewhere in it."""
    k = F.col("id").cast("bigint")
    base, owner = F.col("base"), F.col("owner")
    load, insured = base["load"], base["insured"]

    def flaw(value: Column, *cases: tuple[int, int, Column]) -> Column:
        changed = value
        for modulus, remainder, wrong in cases:
            changed = F.when(k % modulus == remainder, wrong).otherwise(changed)
        return changed

    def span(first: int, last: int) -> Column:
        return F.struct(
            F.lit(first).alias("from"), F.lit(last).alias("to"), F.lit(5_000_000.0).alias("amount")
        )

    new_load = (
        load.withField("em_load", flaw(load["em_load"], (13, 2, F.lit(3.5)), (13, 3, F.lit(2.15))))
        .withField("em_load_term", flaw(load["em_load_term"], (13, 4, F.lit(-1))))
        .withField("pm_load", flaw(load["pm_load"], (17, 1, F.lit(18))))
        .withField("pm_load_term", flaw(load["pm_load_term"], (17, 4, F.lit(-2))))
    )
    new_insured = insured.withField("ssn", flaw(insured["ssn"], (31, 1, F.lit("1234567890123"))))
    new_insured = new_insured.withField(
        "dob", flaw(insured["dob"], (23, 1, F.date_add(base["rcd"], 1)))
    )
    new_base = (
        base.withField("load", new_load)
        .withField("insured", new_insured)
        .withField("id", flaw(base["id"], (23, 2, F.lit("ILP02"))))
        .withField("si", flaw(base["si"], (23, 3, F.lit(-1.0))))
        .withField("acc_ben_coeff", flaw(base["acc_ben_coeff"], (23, 4, F.lit(9))))
        .withField("maturity_option", flaw(base["maturity_option"], (23, 5, F.lit(3))))
        .withField("ep", flaw(base["ep"], (23, 6, F.lit(-1000.0))))
        .withField("opted_tp_term", flaw(base["opted_tp_term"], (23, 7, F.lit(-3))))
        .withField("opted_ep_term", flaw(
            base["opted_ep_term"], (29, 2, F.lit(99)), (29, 3, F.lit(1)), (29, 4, F.lit(-1))
        ))
        .withField("fund_alloc", flaw(
            base["fund_alloc"],
            (17, 2, F.array(_fund("F000", 90, 100))),
            (17, 3, F.array().cast("array<struct<fund: string, tp_pct: int, ep_pct: int>>")),
            (17, 5, F.array(_fund("F003", 120, -20), _fund("F000", -20, 120))),
            (17, 6, F.array(_fund("F000", 100, 80))),
        ))
        .withField("withdrawal_plan", flaw(
            base["withdrawal_plan"],
            (19, 1, F.array(span(9, 5))),
            (19, 2, F.array(span(4, 8), span(8, 9))),
            (19, 3, F.array(span(1, 3), span(5, 6))),
            (19, 4, F.array(span(-2, 3))),
        ))
    )
    new_owner = owner.withField("ssn", flaw(owner["ssn"], (13, 1, F.lit("123"))))
    return (
        portfolio(spark, sf_dir)
        .withColumns({"base": new_base, "owner": new_owner})
        .to(POLICY_SCHEMA)
    )

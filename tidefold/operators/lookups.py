"""Rate lookups as left joins with small sides.

Policy frames carry ``product``, ``gender`` (code) and ``entry_age``; grid frames
also ``year``, ``age`` and ``cal_year``. A missing key leaves null in policy
lookups, for the caller to reject, and the table's default in grid lookups.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold import codes
from tidefold.functions.premiums import annuity_due_monthly
from tidefold.sources.rates import RateBook, local_table

MODES = (1, 2, 4, 12)
MODAL_FACTORS = tuple(f"modal_factor_{mode}" for mode in MODES)

# table, grid key, {source column: result column}, default
GRID_RATES = (
    ("alloc_chrg_rate", "year",
     {"tp_rate": "tp_alloc_chrg_rate", "ep_rate": "ep_alloc_chrg_rate"}, 0.0),
    ("srr_chrg_rate", "year", {"rate": "srr_chrg_rate"}, 0.0),
    ("lb_rate", "year", {"rate": "lb_rate"}, 0.0),
    ("coi_rate", "age", {"rate": "coi_rate"}, 0.0),
    ("juvenile_lien_rate", "age", {"rate": "juvenile_lien_rate"}, 1.0),
    ("admin_chrg", "cal_year", {"amount": "admin_chrg"}, 0.0),
)
GRID_DEFAULTS = {
    column: default for _, _, columns, default in GRID_RATES for column in columns.values()
}
GRID_KEYS = {column: key for _, key, columns, _ in GRID_RATES for column in columns.values()}
FLOATING = tuple(name for name, key in GRID_KEYS.items() if key == "cal_year")
BY_GENDER = "coi_rate"

# Curves by policy year and age cover all years and ages a policy can reach: the
# latest maturity age bounds both. Rates by calendar year stay keyed by it.
LAST_AGE = max(*codes.MATURITY_AGE.values(), codes.MATURITY_AGE_OTHERWISE)
CURVE_DOMAINS = {"year": (1, LAST_AGE), "age": (0, LAST_AGE)}
DENSE = tuple(name for name in GRID_DEFAULTS if name not in FLOATING)
# Curves exist for supported products and all genders only, whatever the book holds.
CURVE_KEYS = tuple(
    (row[0], gender) for row in codes.PRODUCT_TERMS for gender in codes.GENDER_CODES.values()
)
CURVE_NO = "curve_no"


def with_prem_rate(policies: DataFrame, book: RateBook) -> DataFrame:
    rates = book.tables["prem_rate"].select(
        "product", "gender", F.col("age").alias("entry_age"), F.col("rate").alias("prem_rate")
    )
    return policies.join(
        book.side("prem_rate", using=rates), ["product", "gender", "entry_age"], "left"
    )


def with_extra_prem_rate(policies: DataFrame, book: RateBook) -> DataFrame:
    """Rate by load term; the table's last term is 99 and its terms start at 0."""
    rates = book.tables["extra_prem_rate"].select(
        "product", "gender", F.col("age").alias("entry_age"),
        F.col("term").alias("load_term_key"), F.col("rate").alias("extra_prem_rate"),
    )
    keyed = policies.withColumn(
        "load_term_key",
        F.least(F.col("em_load_term") - 1, F.lit(codes.MAX_EXTRA_PREM_TERM)),
    )
    keys = ["product", "gender", "entry_age", "load_term_key"]
    return keyed.join(
        book.side("extra_prem_rate", using=rates), keys, "left"
    ).drop("load_term_key")


def modal_factors(book: RateBook) -> DataFrame:
    """One row per product with its four factors in mode order; others drop out."""
    factors = book.tables["modal_factor"].groupBy("product").agg(
        F.count("*").alias("n"),
        F.array_sort(F.collect_list(F.struct("mode", "rate"))).alias("by_mode"),
    )
    return factors.where(F.col("n") == len(MODES)).select(
        "product",
        *[F.col("by_mode")[i]["rate"].alias(name) for i, name in enumerate(MODAL_FACTORS)],
    )


def with_modal_factors(policies: DataFrame, book: RateBook) -> DataFrame:
    return policies.join(
        book.side("modal_factor", using=book.derived("modal", lambda: modal_factors(book))),
        "product", "left",
    )


def int_rates(book: RateBook, zero_rate_is_one: bool = False) -> DataFrame:
    """Per product the first rate of each interest scenario and its annuity factor.

    Products that guarantee no rate get 0 for the guaranteed scenario.
    """
    spark = book.tables["int_rate"].sparkSession
    first = book.tables["int_rate"].groupBy("product").agg(*[
        F.min_by("rate", F.when(F.col("scenario") == code, F.col("id"))).alias(name)
        for name, code in codes.INT_RATE_CODES.items()
    ])
    rates = product_terms(spark).select("product", "has_guaranteed_rate").join(
        book.side("int_rate", using=first), "product", "left"
    ).select(
        "product",
        F.col("High").alias("int_rate_high"),
        F.col("Low").alias("int_rate_low"),
        F.when(F.col("has_guaranteed_rate"), F.col("Guaranteed"))
        .otherwise(0.0).alias("int_rate_guaranteed"),
    )
    return rates.select("*", *[
        annuity_due_monthly(F.col(f"int_rate_{name}"), zero_rate_is_one).alias(f"due_{name}")
        for name in ("high", "low", "guaranteed")
    ])


def with_int_rates(
    policies: DataFrame, book: RateBook, zero_rate_is_one: bool = False
) -> DataFrame:
    rates = book.derived(
        ("int_rate", zero_rate_is_one), lambda: int_rates(book, zero_rate_is_one)
    )
    return policies.join(
        book.side("int_rate", using=rates, rows=len(codes.PRODUCT_TERMS)), "product", "left")


def product_terms(spark: SparkSession) -> DataFrame:
    return local_table(spark, codes.PRODUCT_TERMS, codes.PRODUCT_TERMS_SCHEMA)


def with_product_terms(policies: DataFrame) -> DataFrame:
    terms = product_terms(policies.sparkSession)
    return policies.join(F.broadcast(terms), "product", "left")


def with_age_limits(covers: DataFrame, book: RateBook) -> DataFrame:
    """Entry and maturity age limits; null where a limit needs manual handling."""
    limits = book.tables["age_limits"].select("product", *[
        F.when(F.col(name) != -1, F.col(name)).alias(f"limit_{name}")
        for name in ("min_entry_age", "max_entry_age", "maturity_age")
    ])
    return covers.join(book.side("age_limits", using=limits), "product", "left")


def with_grid_rates(
    grid: DataFrame, book: RateBook, only: tuple[str, ...] | None = None
) -> DataFrame:
    """The join form of the yearly rates: one left join per table, nulls defaulted."""
    for name, key, columns, default in GRID_RATES:
        if only and name not in only:
            continue
        keys = ["product", "gender", key] if name == BY_GENDER else ["product", key]
        side = book.tables[name].select(
            *keys, *[F.col(source).alias(f"found_{result}") for source, result in columns.items()]
        )
        joined = grid.join(book.side(name, using=side), keys, "left")
        grid = joined.select(
            *grid.columns,
            *[F.coalesce(f"found_{c}", F.lit(default)).alias(c) for c in columns.values()],
        )
    return grid


def rate_curves(book: RateBook) -> DataFrame:
    """The yearly rates as arrays, one row per supported product and gender.

    A curve holds its rates without holes, by policy year from 1 or by age from 0.
    Rates by calendar year are a map, as the table's years may lie anywhere. No curve is null.
    """
    entries = reduce(DataFrame.unionByName, [
        book.tables[name].select(
            "product",
            F.col("gender") if name == BY_GENDER else F.explode(_genders()).alias("gender"),
            F.lit(result).alias("curve"),
            F.col(key).alias("key"),
            F.col(source).alias("rate"),
        )
        for name, key, columns, _ in GRID_RATES
        for source, result in columns.items()
    ])
    spark = book.tables["coi_rate"].sparkSession
    keys = product_terms(spark).select(
        "product", F.explode(_genders()).alias("gender"),
        F.lit(None).cast("string").alias("curve"), F.lit(None).cast("int").alias("key"),
        F.lit(None).cast("double").alias("rate"),
    )
    chosen = {name: F.col("curve") == name for name in GRID_DEFAULTS}
    supported = F.col("product").isin(*[row[0] for row in codes.PRODUCT_TERMS])
    gathered = entries.where(supported).unionByName(keys).groupBy("product", "gender").agg(*[
        F.map_from_entries(
            F.collect_list(F.when(is_curve, F.struct("key", "rate")))
        ).alias(name)
        for name, is_curve in chosen.items()
    ])
    return gathered.select(
        "product", "gender", *FLOATING, *[_dense(name, GRID_DEFAULTS[name]).alias(name) for name in DENSE],
    )


def _genders() -> Column:
    return F.array(*[F.lit(code) for code in codes.GENDER_CODES.values()])


def _dense(name: str, default: float) -> Column:
    keys = F.sequence(*[F.lit(end) for end in CURVE_DOMAINS[GRID_KEYS[name]]])
    return F.transform(keys, lambda key: F.coalesce(F.col(name)[key], F.lit(default)))


class Curves:
    """The yearly rates of all supported products and genders, read from the book once.

    They are the same for all policies, so they go to executors once, not with each
    policy: a few thousand numbers, whatever the portfolio holds, and for rates by calendar
    year as many as the book has.
    """

    def __init__(self, book: RateBook):
        rows = rate_curves(book).select("product", "gender", *DENSE, *FLOATING).collect()
        rows.sort(key=lambda r: CURVE_KEYS.index((r["product"], r["gender"])))
        self.matrices = {name: np.array([r[name] for r in rows]) for name in DENSE}
        self.dated = {}
        for name in FLOATING:
            found = sorted((_dated(i, year), rate) for i, r in enumerate(rows) for year, rate in r[name].items())
            self.dated[name] = tuple(np.array(c) for c in zip(*found)) if found else (np.array([_dated(0, 0)]), np.array([GRID_DEFAULTS[name]]))

    def at(self, name: str, number: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Rates of curves at their keys; accepted policies reach no key outside the domain,
        and rows past their term, whose key may lie there, are not used. A calendar year
        that the book does not have gets the default."""
        if name in FLOATING:
            keys, rates = self.dated[name]
            wanted = _dated(number.astype(np.int64), key)
            place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            return np.where(keys[place] == wanted, rates[place], GRID_DEFAULTS[name])
        first, last = CURVE_DOMAINS[GRID_KEYS[name]]
        return self.matrices[name][number, np.clip(key, first, last) - first]

    def side(self, spark: SparkSession) -> DataFrame:
        """The curves by year and age as a local relation: no rate table is read again."""
        doubles = ", ".join(f"{name} array<double>" for name in DENSE)
        rows = [(*key, *[self.matrices[name][i].tolist() for name in DENSE]) for i, key in enumerate(CURVE_KEYS)]
        whole = local_table(spark, rows, f"product string, gender int, {doubles}")
        # Neither curves nor their rates are null; saying so keeps the results' code small.
        none = F.array(F.lit(0.0))
        return whole.select("product", "gender", *[
            F.coalesce(F.transform(name, lambda rate: F.coalesce(rate, F.lit(0.0))), none).alias(name) for name in DENSE])


def _dated(number, year):
    """One number for a curve and a calendar year, in that order."""
    return number * (1 << 33) + year + (1 << 32)


def with_rate_curves(policies: DataFrame, curves: Curves) -> DataFrame:
    """Attach the curves by year and age; policies of unsupported products drop out."""
    side = curves.side(policies.sparkSession)
    return policies.join(F.broadcast(side), ["product", "gender"])


def with_curve_no(policies: DataFrame) -> DataFrame:
    """Attach the place of a policy's product and gender in ``CURVE_KEYS``."""
    names = F.array(*[F.lit(f"{product}|{gender}") for product, gender in CURVE_KEYS])
    place = F.array_position(names, F.concat_ws("|", "product", F.col("gender").cast("string"))) - 1
    return policies.withColumn(CURVE_NO, place.cast("int"))


def curve_at(name: str, within: str = "") -> Column:
    """The rate of a grid row read from its curve, a field of struct ``within``."""
    if name in FLOATING:
        return F.col(within + name)[F.col("year") - 1]
    key = GRID_KEYS[name]
    return F.col(within + name)[F.col(key) - F.lit(CURVE_DOMAINS[key][0])]

"""A rate book built from rules, for trials without a rate folder.

Premium, extra-premium and insurance rates are invented smooth curves; the
other tables hold the published values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidefold import codes
from tidefold.sources.rates import TABLES, RateBook, local_table

PRODUCTS = ("UVL01", "UVL02", "UVL03", "ILP01")
YEARS = 100
PREM_AGES = 66
COI_AGES = 100
EXTRA_TERMS = 100

# Charge rates by policy year, then the rate of all later years.
TP_ALLOC = {
    "UVL01": ([0.55, 0.4, 0.25, 0.2, 0.1, 0.07, 0.07, 0.04, 0.04], 0.02),
    "UVL02": ([0.7, 0.45, 0.25], 0.0),
    "UVL03": ([0.3, 0.15, 0.1], 0.0),
    "ILP01": ([0.55, 0.4, 0.25, 0.2, 0.1, 0.07, 0.07, 0.04, 0.04], 0.02),
}
EP_ALLOC = {"UVL01": 0.02, "UVL02": 0.015, "UVL03": 0.015, "ILP01": 0.02}
SURRENDER = {
    "UVL01": ([1.0, 1.0, 1.0, 1.0, 0.8, 0.6, 0.4, 0.2, 0.1], 0.0),
    "UVL02": ([1.0, 1.0, 1.0, 0.85, 0.65, 0.45, 0.25, 0.2, 0.1], 0.0),
    "UVL03": ([0.45, 0.4, 0.3, 0.2, 0.1], 0.0),
    "ILP01": ([1.0, 1.0, 1.0, 1.0, 0.8, 0.6, 0.4, 0.2, 0.1], 0.0),
}
# Loyalty bonus rates, paid every so many years of the first 20.
LOYALTY = {
    "UVL01": (4, [0.06, 0.12, 0.18, 0.24, 0.3]),
    "UVL02": (3, [0.03, 0.06, 0.09, 0.12, 0.15, 0.18]),
    "UVL03": (3, [0.03, 0.04, 0.05, 0.06, 0.07, 0.08]),
    "ILP01": (4, [0.06, 0.12, 0.18, 0.24, 0.3]),
}
LOYALTY_YEARS = 20
# Share of the benefit paid at ages 0 to 3.
LIEN = {
    "UVL01": [1.0, 1.0, 1.0, 1.0],
    "UVL02": [0.2, 0.4, 0.6, 0.8],
    "UVL03": [0.2, 0.4, 0.6, 0.8],
    "ILP01": [0.2, 0.4, 0.6, 0.8],
}
# Monthly administration charge: first calendar year, amount in
# that year, yearly rise and highest amount.
ADMIN = {
    "UVL01": (2016, 25000.0, 0.0, 25000.0),
    "UVL02": (2024, 40000.0, 2000.0, 66000.0),
    "UVL03": (2024, 40000.0, 2000.0, 66000.0),
    "ILP01": (2024, 40000.0, 2000.0, 66000.0),
}
# Yearly interest rate by product and scenario code.
INT_RATES = [
    (1, "UVL01", 0, 0.07), (2, "UVL01", 1, 0.05), (3, "UVL01", 2, 0.02),
    (4, "UVL02", 0, 0.07), (5, "UVL02", 1, 0.05), (6, "UVL02", 2, 0.02),
    (7, "UVL03", 0, 0.07), (8, "UVL03", 1, 0.05), (9, "UVL03", 2, 0.02),
    (10, "ILP01", 0, 0.05), (11, "ILP01", 1, 0.09),
]
# Factors of modes 1, 2, 4 and 12 by product.
EVEN_MODES = (1.0, 0.5, 0.25, 0.083333333)
LOADED_MODES = (1.0, 0.53, 0.27, 0.09)
MODAL = {
    "UVL01": EVEN_MODES, "UVL02": EVEN_MODES, "UVL03": EVEN_MODES, "ILP01": EVEN_MODES,
    "HOP02": EVEN_MODES, "ADD01": EVEN_MODES, "PPD01": LOADED_MODES, "CIR01": LOADED_MODES,
    "CIR02": LOADED_MODES, "SUP01": LOADED_MODES, "WOP01": LOADED_MODES, "WOP02": LOADED_MODES,
}
# Minimum and maximum entry age and maturity age, -1 for manual.
AGE_LIMITS = [
    ("UVL01", -1, 60, -1), ("UVL02", -1, 60, -1), ("UVL03", -1, 60, -1),
    ("ILP01", -1, 60, -1), ("ADD01", 18, 60, 61), ("PPD01", -1, 70, 71),
    ("HOP02", 2, 59, 60), ("CIR02", 1, 65, 75), ("CIR01", 1, 58, 65),
    ("SUP01", 20, 59, 60), ("WOP01", 18, 60, 65), ("WOP02", 18, 60, 65),
]
# Descriptions of the code dimensions.
GENDER = [(0, "Unknown"), (1, "Male"), (2, "Female"), (9, "Inapplicable")]
PAYMODE = [(1, "Annual"), (2, "Semi-annual"), (4, "Quarterly"), (12, "Monthly")]
SCENARIO = [(0, "High"), (1, "Low"), (2, "Guaranteed")]


def _stepped(steps: list[float], tail: float) -> list[float]:
    return steps + [tail] * (YEARS - len(steps))


def _rule_rows() -> dict[str, list[tuple]]:
    rows: dict[str, list[tuple]] = {name: [] for name in (
        "alloc_chrg_rate", "srr_chrg_rate", "lb_rate", "juvenile_lien_rate", "admin_chrg",
    )}
    for product in PRODUCTS:
        tp_rates, srr_rates = _stepped(*TP_ALLOC[product]), _stepped(*SURRENDER[product])
        first_year, amount, rise, highest = ADMIN[product]
        every, bonus_rates = LOYALTY[product]
        for year in range(1, YEARS + 1):
            rows["alloc_chrg_rate"].append((product, year, tp_rates[year - 1], EP_ALLOC[product]))
            rows["srr_chrg_rate"].append((product, year, srr_rates[year - 1]))
            charge = min(amount + rise * (year - 1), highest)
            rows["admin_chrg"].append((product, first_year + year - 1, charge))
        for year in range(1, LOYALTY_YEARS + 1):
            pays = year % every == 0
            rows["lb_rate"].append((product, year, bonus_rates[year // every - 1] if pays else 0.0))
        for age, rate in enumerate(LIEN[product]):
            rows["juvenile_lien_rate"].append((product, age, rate))
    rows["int_rate"] = INT_RATES
    rows["modal_factor"] = [
        (product, mode, rate)
        for product, rates in MODAL.items()
        for mode, rate in zip((1, 2, 4, 12), rates)
    ]
    rows["age_limits"] = AGE_LIMITS
    rows["product"] = [
        (p, f"{p} local name", f"{p} name", int(p in codes.BASE_PRODUCTS)) for p in MODAL
    ]
    rows["gender"], rows["paymode"], rows["int_rate_scenario"] = GENDER, PAYMODE, SCENARIO
    return rows


def _generated(spark: SparkSession, name: str, n: int, **columns: str) -> DataFrame:
    product = F.element_at(F.array(*[F.lit(p) for p in PRODUCTS]), F.expr(columns.pop("product")))
    frame = spark.range(0, n, 1, 1).select(
        product.alias("product"), *[F.expr(text).alias(c) for c, text in columns.items()]
    )
    rate = {
        "prem_rate": "10.6D + 0.12D * age + 57.5D * (age / 66D) * (age / 66D) * (age / 66D)",
        "extra_prem_rate": "0.5D + 0.02D * age + 0.005D * term",
        "coi_rate": (
            "(0.0007D + 0.00002D * age + 0.99732D * x8) * if(gender = 2, 0.8D, 1D)"
            " * if(product IN ('UVL02', 'ILP01'), 0.8D, 1D)"
        ),
    }[name]
    wanted = T.StructType.fromDDL(TABLES[name].columns)
    return frame.select("*", F.expr(rate).alias("rate")).select(
        *[F.col(f.name).cast(f.dataType) for f in wanted.fields]
    )


def demo_book(spark: SparkSession) -> RateBook:
    rows = _rule_rows()
    tables = {name: local_table(spark, data, TABLES[name].columns) for name, data in rows.items()}
    counts = {name: len(data) for name, data in rows.items()}
    x4 = "(age / 99D) * (age / 99D) * ((age / 99D) * (age / 99D))"
    generated = {
        "prem_rate": (len(PRODUCTS) * 2 * PREM_AGES, dict(
            product="int(id div 132) + 1", gender="1 + (id div 66) % 2", age="id % 66",
        )),
        "extra_prem_rate": (len(PRODUCTS) * 2 * PREM_AGES * EXTRA_TERMS, dict(
            product="int(id div 13200) + 1", gender="1 + (id div 6600) % 2",
            age="(id div 100) % 66", term="id % 100",
        )),
        "coi_rate": (len(PRODUCTS) * 2 * COI_AGES, dict(
            product="int(id div 200) + 1", gender="1 + (id div 100) % 2", age="id % 100",
            x8=x4.replace("age", "(id % 100)") + " * (" + x4.replace("age", "(id % 100)") + ")",
        )),
    }
    for name, (n, columns) in generated.items():
        tables[name] = _generated(spark, name, n, **columns)
        counts[name] = n
    return RateBook(tables, counts)

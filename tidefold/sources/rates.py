"""Rate tables: CSV loading with fix-ups, Parquet storage, keyed scans.

Rate tables are the only sides this engine broadcasts. A :class:`RateBook`
knows each table's row count, taken when the book is opened, and withholds the
broadcast hint from any table over ``MAX_BROADCAST_ROWS``; Catalyst then joins
by shuffle, where AQE splits skewed keys. Frames derived from tables are judged
by their own bound.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BROADCAST_ROWS = 1_000_000
#: Stands for all products where a bad row does not tell its own.
ANY_PRODUCT = "*"
CORRUPT = "_corrupt_record"


@dataclass(frozen=True)
class RateTable:
    """One table: CSV file stem and header, renames, kept columns and unique key."""

    file: str
    header: str
    columns: str
    key: tuple[str, ...]
    renames: tuple[tuple[str, str], ...] = ()


# File stems and headers of the published CSV layout.
TABLES = {
    "prem_rate": RateTable(
        "ul_prem_rate",
        "id int, product string, age int, gender int, rate double",
        "product string, gender int, age int, rate double",
        ("product", "gender", "age"),
    ),
    "extra_prem_rate": RateTable(
        "ul_extra_prem_rate",
        "product string, gender int, age int, term int, rate double",
        "product string, gender int, age int, term int, rate double",
        ("product", "gender", "age", "term"),
    ),
    "modal_factor": RateTable(
        "modal_factor",
        "id int, product string, mode int, rate double",
        "product string, mode int, rate double",
        ("product", "mode"),
    ),
    "alloc_chrg_rate": RateTable(
        "ul_alloc_chrg_rate",
        "id int, product string, year int, tp_rate double, ep_rate double",
        "product string, year int, tp_rate double, ep_rate double",
        ("product", "year"),
    ),
    "srr_chrg_rate": RateTable(
        "ul_srr_chrg_rate",
        "id int, product string, pol_year int, rate double",
        "product string, year int, rate double",
        ("product", "year"),
        (("pol_year", "year"),),
    ),
    "lb_rate": RateTable(
        "ul_lb_rate",
        "id int, product string, year int, rate double",
        "product string, year int, rate double",
        ("product", "year"),
    ),
    "coi_rate": RateTable(
        "ul_coi_rate",
        "id int, product string, gender int, age int, rate double",
        "product string, gender int, age int, rate double",
        ("product", "gender", "age"),
    ),
    "juvenile_lien_rate": RateTable(
        "ul_juvenile_lien_rate",
        "id int, product string, age int, rate double",
        "product string, age int, rate double",
        ("product", "age"),
    ),
    "admin_chrg": RateTable(
        "ul_admin_chrg",
        "id int, product string, cal_year int, amount double",
        "product string, cal_year int, amount double",
        ("product", "cal_year"),
    ),
    "int_rate": RateTable(
        "ul_int_rate",
        "id int, product string, scenario int, year int, rate double",
        "id int, product string, scenario int, rate double",
        ("id",),
    ),
    "age_limits": RateTable(
        "age_validation",
        "product string, min_entry_age int, max_entry_age int, maturity_age int",
        "product string, min_entry_age int, max_entry_age int, maturity_age int",
        ("product",),
    ),
    "product": RateTable(
        "product",
        "product string, vn_mkt_name string, en_mkt_name string, base_flag int",
        "product string, vn_mkt_name string, en_mkt_name string, base_flag int",
        ("product",),
    ),
    "gender": RateTable(
        "gender",
        "gender int, description string",
        "gender int, description string",
        ("gender",),
    ),
    "paymode": RateTable(
        "paymode",
        "mode int, description string",
        "mode int, description string",
        ("mode",),
    ),
    "int_rate_scenario": RateTable(
        "int_rate_scenario",
        "scenario int, description string",
        "scenario int, description string",
        ("scenario",),
    ),
}


@dataclass(frozen=True)
class RateBook:
    """Rate tables by name, with their row counts.

    ``total_charges`` names products that charge all of an excess premium in some
    year, which leaves loads undefined; their policies are rejected. So are those of
    ``unread`` products, which have a row that could not be read (``ANY_PRODUCT``: a row
    whose product could not be read either).
    """

    tables: dict[str, DataFrame]
    rows: dict[str, int]
    total_charges: tuple[str, ...] = ()
    unread: tuple[str, ...] = ()
    _derived: dict[object, DataFrame] = field(default_factory=dict)

    @classmethod
    def from_csv(
        cls, spark: SparkSession, folder: str, files: dict[str, str] | None = None,
        rejects: str | None = None,
    ) -> RateBook:
        """Load ``<folder>/<stem>.csv`` for every table; ``files`` overrides paths.

        A row that does not parse refuses the book. With ``rejects``, a new folder, the
        rows that do are written there as a table each, and the others to ``rejects/unread``:
        rate table, product, what could be read, text. Policies of their products are rejected.
        """
        paths = {name: f"{folder}/{table.file}.csv" for name, table in TABLES.items()}
        paths.update(files or {})
        if rejects is None:
            return cls.of({name: load_rate_csv(spark, name, path) for name, path in paths.items()})
        for name, path in paths.items():
            # Spark checks only the columns that are read, so rows are sorted out once, on writing all.
            read = _csv(spark, TABLES[name], path, "PERMISSIVE")
            _in_layout(TABLES[name], read.where(F.col(CORRUPT).isNull())).write.parquet(f"{rejects}/{name}")
            _unread(name, read).write.mode("append").parquet(f"{rejects}/unread")
        broken = spark.read.parquet(f"{rejects}/unread").agg(
            F.collect_set(F.coalesce("product", F.lit(ANY_PRODUCT)))).first()[0]
        return replace(cls.from_parquet(spark, rejects), unread=tuple(sorted(broken)))

    @classmethod
    def from_parquet(cls, spark: SparkSession, folder: str) -> RateBook:
        return cls.of({
            name: spark.read.schema(table.columns).parquet(f"{folder}/{name}") for name, table in TABLES.items()})

    @classmethod
    def of(cls, tables: dict[str, DataFrame]) -> RateBook:
        """Count all tables in one job; refuse repeated keys, note total charges."""
        profiles = [
            tables[name].agg(
                F.lit(name).alias("name"),
                F.count("*").alias("n"),
                F.count_distinct(*TABLES[name].key).alias("n_keys"),
                _takes_all(name).alias("takes_all"),
            )
            for name in tables
        ]
        counted = reduce(DataFrame.unionByName, profiles).collect()
        repeated = sorted(row["name"] for row in counted if row["n"] != row["n_keys"])
        if repeated:
            raise ValueError(f"repeated or null keys in rate tables: {', '.join(repeated)}")
        total = sorted({product for row in counted for product in row["takes_all"]})
        return cls(dict(tables), {row["name"]: row["n"] for row in counted}, tuple(total))

    def write_parquet(self, folder: str, by_product: bool = False) -> None:
        """One table each; ``by_product`` makes a folder a product, which scans and joins prune."""
        for name, table in self.tables.items():
            writer = table.write.mode("errorifexists")
            if by_product and "product" in TABLES[name].key:
                writer = writer.partitionBy("product")
            writer.parquet(f"{folder}/{name}")

    def scan(self, name: str, **keys) -> DataFrame:
        """One table filtered on key values; the filters reach a Parquet scan."""
        table = self.tables[name]
        for column, value in keys.items():
            table = table.where(F.col(column) == F.lit(value))
        return table

    def derived(self, key: object, build: Callable[[], DataFrame]) -> DataFrame:
        """The plan of a small frame computed from rate tables; nothing is cached."""
        if key not in self._derived:
            self._derived[key] = build()
        return self._derived[key]

    def side(self, *names: str, using: DataFrame | None = None, rows: int | None = None) -> DataFrame:
        """The table, or a frame derived from ``names``, as a join side.

        ``rows`` bounds a derived frame; without it, it counts as its sources do.
        """
        frame = self.tables[names[0]] if using is None else using
        if (sum(self.rows[name] for name in names) if rows is None else rows) <= MAX_BROADCAST_ROWS:
            return F.broadcast(frame)
        return frame


def _takes_all(name: str):
    if name == "alloc_chrg_rate":
        return F.collect_set(F.when(F.col("ep_rate") >= 1.0, F.col("product")))
    return F.array().cast("array<string>")


def load_rate_csv(spark: SparkSession, name: str, path: str) -> DataFrame:
    """One CSV file, its header checked, trimmed, renamed and cut to its columns."""
    return _in_layout(TABLES[name], _csv(spark, TABLES[name], path, "FAILFAST"))


def _in_layout(table: RateTable, read: DataFrame) -> DataFrame:
    return read.withColumnsRenamed(dict(table.renames)).select(*T.StructType.fromDDL(table.columns).fieldNames())


def _unread(name: str, read: DataFrame) -> DataFrame:
    fields = T.StructType.fromDDL(TABLES[name].header).fieldNames()
    product = F.col("product") if "product" in fields else F.lit(None).cast("string")
    return read.where(F.col(CORRUPT).isNotNull()).select(
        F.lit(name).alias("name"), product.alias("product"),
        F.to_json(F.struct(*fields)).alias("values"), F.col(CORRUPT).alias("text"))


def _csv(spark: SparkSession, table: RateTable, path: str, mode: str) -> DataFrame:
    schema = table.header if mode == "FAILFAST" else f"{table.header}, {CORRUPT} string"
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .option("mode", mode)
        .option("columnNameOfCorruptRecord", CORRUPT)
        .csv(path)
    )


def local_table(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A small table of given rows that Catalyst sees as a local relation."""
    fields = T.StructType.fromDDL(schema).fieldNames()
    columns = list(zip(*rows))
    data = pa.table({field: list(values) for field, values in zip(fields, columns)})
    frame = spark.createDataFrame(data)
    return frame.select(*[
        F.col(f.name).cast(f.dataType) for f in T.StructType.fromDDL(schema).fields
    ])

"""Policy documents: schema, readers and the split of unreadable records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidefold import codes

STRING, DATE, INT, DOUBLE = T.StringType(), T.DateType(), T.IntegerType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


OWNER = _struct(id=STRING, ssn=STRING, dob=DATE)
INSURED = _struct(id=STRING, ssn=STRING, dob=DATE, gender=STRING, relatsh=STRING)
LOAD = _struct(em_load=DOUBLE, em_load_term=INT, pm_load=INT, pm_load_term=INT)
COVER = dict(id=STRING, rcd=DATE, paymode=STRING, channel=STRING, status=STRING)
FUND_ALLOC = _struct(fund=STRING, tp_pct=INT, ep_pct=INT)
WITHDRAWAL = _struct(**{"from": INT, "to": INT, "amount": DOUBLE})
BASE = _struct(
    **COVER, insured=INSURED, load=LOAD, si=DOUBLE, opted_tp_term=INT, ep=DOUBLE,
    opted_ep_term=INT, death_tpd_option=STRING, maturity_option=INT, acc_ben_coeff=INT,
    fund_alloc=T.ArrayType(FUND_ALLOC), withdrawal_plan=T.ArrayType(WITHDRAWAL),
)
RIDER = _struct(**COVER, insured=INSURED, load=LOAD, si=DOUBLE, hop2_option=INT)
POLICY_SCHEMA = _struct(
    id=STRING, owner=OWNER, created_date=DATE, base=BASE, rider=T.ArrayType(RIDER)
)

CORRUPT = "_corrupt_record"
READ_SCHEMA = T.StructType(POLICY_SCHEMA.fields + [T.StructField(CORRUPT, T.StringType())])


def read_policies(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Read policy documents with a fixed schema and a ``read_error`` column.

    The default layout, one document per line, splits within a file.
    ``multi_line`` reads pretty-printed files, one task per file at least.
    """
    raw = (
        spark.read.schema(READ_SCHEMA)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("multiLine", multi_line)
        .json(path)
    )
    return _with_read_error(raw)


def parse_policies(texts: DataFrame, column: str = "value") -> DataFrame:
    """The same as :func:`read_policies` for documents held in a string column."""
    parsed = F.from_json(
        F.col(column),
        READ_SCHEMA,
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT},
    )
    return _with_read_error(texts.select(parsed.alias("doc")).select("doc.*"))


def loadable(policies: DataFrame) -> DataFrame:
    return policies.where(F.col("read_error").isNull()).drop("read_error", CORRUPT)


def unreadable(policies: DataFrame) -> DataFrame:
    """Id (null if not even that could be read), reason and text of documents with a ``read_error``."""
    read = F.to_json(F.struct(*[F.col(f.name) for f in POLICY_SCHEMA.fields]))
    return policies.where(F.col("read_error").isNotNull()).select(
        "id", "read_error", F.coalesce(F.col(CORRUPT), read).alias("document")
    )


def load_policies(spark: SparkSession, path: str, target: str, multi_line: bool = False) -> None:
    """Read documents once and write two tables: ``target/state=loaded`` with the good
    policies, ``target/state=rejected`` with id, reason and text of the others."""
    read = read_policies(spark, path, multi_line)
    fields = [f.name for f in POLICY_SCHEMA.fields]
    good, text = F.col("read_error").isNull(), F.to_json(F.struct(*fields))
    read.select(
        F.when(good, "loaded").otherwise("rejected").alias("state"),
        F.col("id"), *[F.when(good, F.col(name)).alias(name) for name in fields if name != "id"],
        "read_error", F.when(~good, F.coalesce(F.col(CORRUPT), text)).alias("document"),
    ).write.partitionBy("state").parquet(target)


def loaded(spark: SparkSession, target: str) -> DataFrame:
    """Good policies of a table that :func:`load_policies` wrote."""
    return spark.read.schema(POLICY_SCHEMA).parquet(f"{target}/state=loaded")


def rejected(spark: SparkSession, target: str) -> DataFrame:
    """Id, reason and text of the documents that :func:`load_policies` set aside."""
    return spark.read.schema("id string, read_error string, document string").parquet(f"{target}/state=rejected")


def _with_read_error(raw: DataFrame) -> DataFrame:
    return raw.withColumn(
        "read_error",
        F.when(F.col(CORRUPT).isNotNull(), "malformed document")
        .when(_any_missing(), "missing field")
        .when(_any_unknown(), "unknown code"),
    )


def _any(conditions: list[Column]) -> Column:
    found = conditions[0]
    for condition in conditions[1:]:
        found = found | condition
    return found


PERSON_FIELDS = ("id", "ssn", "dob")
COVER_FIELDS = ("id", "rcd", "paymode", "channel", "status")
LOAD_FIELDS = ("em_load", "em_load_term", "pm_load", "pm_load_term")


def _required(root: Column, *names: str) -> list[Column]:
    return [root[name].isNull() for name in names]


def _any_missing() -> Column:
    base, insured, load = F.col("base"), F.col("base.insured"), F.col("base.load")
    return _any(
        [F.col("id").isNull(), F.col("created_date").isNull()]
        + _required(F.col("owner"), *PERSON_FIELDS)
        + _required(base, *COVER_FIELDS)
        + _required(insured, *PERSON_FIELDS, "gender", "relatsh")
        + _required(load, *LOAD_FIELDS)
        + _required(
            base, "si", "opted_tp_term", "ep", "opted_ep_term", "death_tpd_option",
            "maturity_option", "acc_ben_coeff", "fund_alloc",
        )
        + [
            F.exists("base.fund_alloc", lambda x: _any(_required(x, "fund", "tp_pct", "ep_pct"))),
            _exists("base.withdrawal_plan", lambda x: _any(_required(x, "from", "to", "amount"))),
            _exists(
                "rider",
                lambda x: _any(
                    _required(x, *COVER_FIELDS)
                    + _required(x["insured"], *PERSON_FIELDS, "gender", "relatsh")
                    + [x["load"].isNotNull() & _any(_required(x["load"], *LOAD_FIELDS))]
                ),
            ),
        ]
    )


def _exists(column: str, test) -> Column:
    """``exists`` that holds for no element of a null array."""
    return F.coalesce(F.exists(column, test), F.lit(False))


def _unknown_cover(cover: Column, products: tuple[str, ...]) -> list[Column]:
    return [
        ~cover["id"].isin(*products),
        ~cover["paymode"].isin(*codes.PAY_MODES),
        ~cover["channel"].isin(*codes.CHANNELS),
        ~cover["status"].isin(*codes.STATUSES),
        ~cover["insured"]["gender"].isin(*codes.GENDERS),
        ~cover["insured"]["relatsh"].isin(*codes.RELATIONSHIPS),
    ]


def _any_unknown() -> Column:
    return _any(
        _unknown_cover(F.col("base"), codes.BASE_PRODUCTS)
        + [
            ~F.col("base.death_tpd_option").isin(*codes.BENEFIT_OPTIONS),
            F.exists("base.fund_alloc", lambda x: ~x["fund"].isin(*codes.FUNDS)),
            _exists("rider", lambda x: _any(_unknown_cover(x, codes.RIDER_PRODUCTS))),
        ]
    )

"""Queries over the driver tables, one per operator."""

from __future__ import annotations

from dataclasses import replace
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.oracle import VARIED_DOUBLES, VARIED_FLAGS
from tidefold import codes
from tidefold.fixtures import portfolio as portfolios
from tidefold.fixtures import rates as demo_rates
from tidefold.functions.dates import age_months, age_years
from tidefold.operators import lookups
from tidefold.operators.dimensions import decode_dimensions, decode_int_rate_scenario
from tidefold.operators.lookups import with_product_terms
from tidefold.operators.reconcile import compare_frames, ranked_pairs, reconcile
from tidefold.operators.riders import rated_riders
from tidefold.operators.validation import first_failures, quarantined, validate, violations
from tidefold.plans.fixed import FIXED_COLUMNS, TIME_COLUMNS, fixed_init, fixed_table
from tidefold.plans.fixed import fixed_mapping as mapped
from tidefold.plans.formulas import PREMIUM_LAYERS, add_layers
from tidefold.plans.projection import OUTCOME_TEXTS, project_portfolio
from tidefold.plans.review import bonus_reviews, differing
from tidefold.plans.scenarios import SCENARIO_COLUMNS, with_scenarios
from tidefold.plans.terms import (
    accepted,
    flatten,
    policy_terms,
    rejects,
    with_ages,
    withdrawal_years,
)
from tidefold.session import new_shared_path
from tidefold.sources.policies import load_policies, loaded, rejected
from tidefold.sources.rates import TABLES, RateBook
from tidefold.sources.sinks import order_breaks, write_result

POLICY_KEYS = ("policy_id", "product", "gender", "entry_age")


# Plans are built once per session and data set; every run reads the data anew.
plan_once = lru_cache(maxsize=None)


@plan_once
def demo_book(spark: SparkSession) -> RateBook:
    return demo_rates.demo_book(spark)


@plan_once
def portfolio(spark: SparkSession, sf: str) -> DataFrame:
    return portfolios.portfolio(spark, sf)


@plan_once
def flawed_portfolio(spark: SparkSession, sf: str) -> DataFrame:
    return portfolios.flawed_portfolio(spark, sf)


@plan_once
def _aged(spark: SparkSession, sf: str) -> DataFrame:
    return with_ages(flatten(portfolio(spark, sf)))


@plan_once
def _terms(spark: SparkSession, sf: str) -> DataFrame:
    return policy_terms(portfolio(spark, sf), demo_book(spark), partitions=_spread(spark))


def _grid(spark: SparkSession, sf: str) -> DataFrame:
    return fixed_init(accepted(_terms(spark, sf)))


def _paths(spark: SparkSession, sf: str) -> DataFrame:
    return with_scenarios(accepted(_terms(spark, sf)))


def _spread(spark: SparkSession) -> int:
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(spark.sparkContext.defaultParallelism, shuffle)


@plan_once
def projection(spark: SparkSession, sf: str) -> DataFrame:
    return project_portfolio(
        portfolio(spark, sf), demo_book(spark), partitions=_spread(spark)
    )


# -- digests -----------------------------------------------------------------

def _weighted_cents(name: str) -> Column:
    return F.floor(F.nanvl(F.col(name), F.lit(0.0)) * 100.0 + 0.5) * F.col("year")


def digest(name: str) -> Column:
    """Sum over years of year times value in cents; exact in any order."""
    return F.sum(_weighted_cents(name).cast("decimal(20,0)")).cast("double").alias(name)


def path_digest(name: str) -> Column:
    """The same within one path, whose 100 years at most fit a long."""
    return F.sum(_weighted_cents(name)).cast("double").alias(name)


def large_digest(name: str, value: Column | None = None) -> Column:
    """``digest`` of any number of rows, summed as two longs: quicker than decimals for many columns."""
    value = _weighted_cents(name) if value is None else value
    high, low = F.sum(F.shiftright(value, 32)), F.sum(value.bitwiseAND(F.lit(0xFFFFFFFF)))
    return (high.cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)") + low.cast("decimal(20,0)")).cast(
        "double").alias(name)


def flag_digest(name: str) -> Column:
    return F.sum(F.when(F.col(name), F.col("year")).otherwise(0)).cast("bigint").alias(name)


def by_path(frame: DataFrame, columns=(), flags=(), extra=(), nan=()) -> DataFrame:
    """Digests by path; those of ``nan`` columns count NaN apart, which digests take for 0."""
    holes = [F.count_if(F.isnan(F.col(c))).alias(f"{c}_nan") for c in nan]
    return frame.groupBy("policy_id", "scenario_no").agg(
        *[path_digest(c) for c in columns], *[flag_digest(c) for c in flags], *extra, *holes
    )


def _log_digest() -> Column:
    place = F.array_position(F.array(*[F.lit(t) for t in OUTCOME_TEXTS]), F.col("withdrawal_log"))
    return F.sum(place * F.col("year")).cast("bigint").alias("withdrawal_log")


# Columns and flags of each step of the roll-forward.
ROLL_STEPS = {
    "start_values": (("start_si", "start_eav", "start_tav", "start_pav"), ("cont_flag",)),
    "surrender_value": (("srr_val",), ()),
    "benefit": (("ben",), ()),
    "accident_benefit": (("acc_ben",), ()),
    "em_load": (("unrounded_em_load", "em_load"), ()),
    "pm_load": (("unrounded_pm_load", "pm_load"), ()),
    "load_totals": (("load", "load_alloc_chrg", "load_alloc", "alloc_chrg", "alloc"), ()),
    "accounts_after_allocation": (
        ("eav_after_wdrl_and_alloc", "tav_after_wdrl_and_alloc", "pav_after_wdrl_and_alloc"), ()),
    "sum_at_risk": (("sar",), ()),
    "cost_of_insurance": (
        ("standard_coi", "em_load_coi", "pm_load_coi", "acc_coi", "coi"), ()),
    "planned_deduction": (("plan_nom_deduction", "plan_deduction"), ("deduction_flag",)),
    "deduction_split": (("nom_deduction", "deduction", "tav_deduction", "eav_deduction"), ()),
    "interest": (("eav_int", "tav_int", "int"), ()),
    "loyalty_bonus": (("lb_tav_withdrawal_review", "lb"), ("lb_flag",)),
    "special_bonus": (("sb_rate", "sb_tav_withdrawal_review", "sb", "bonus"), ("sb_flag",)),
    "end_values": (("end_si", "end_eav", "end_tav", "end_pav"), ()),
}


def _roll_step(columns, flags):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return by_path(projection(spark, sf), columns, flags, nan=columns)

    return run


def withdrawal(spark: SparkSession, sf: str) -> DataFrame:
    columns = ("withdrawal", "eav_withdrawal", "tav_withdrawal", "end_si")
    return by_path(projection(spark, sf), columns, extra=(_log_digest(),))


def lapse(spark: SparkSession, sf: str) -> DataFrame:
    lapsed = F.col("cont_flag") & ~F.col("deduction_flag")
    return by_path(projection(spark, sf), extra=(
        F.max(F.when(F.col("cont_flag"), F.col("year"))).alias("last_year"),
        F.max(F.when(lapsed, F.col("year"))).alias("lapse_year"),
        F.count("*").alias("n_years"),
    ))


def result_defaults(spark: SparkSession, sf: str) -> DataFrame:
    """Rows after lapse: all results are at their defaults, premiums are not."""
    after = projection(spark, sf).where(~F.col("cont_flag"))
    return by_path(
        after, VARIED_DOUBLES + ("tp", "ep"), VARIED_FLAGS,
        (_log_digest(), F.count("*").alias("n_years")),
    )


RESULT_VALUES = VARIED_DOUBLES + FIXED_COLUMNS[7:] + (
    "age", "cal_year", "tp", "ep", "srr_chrg", "tp_alloc_chrg", "ep_alloc_chrg",
    "tp_alloc", "ep_alloc", "annual_int_rate", "due_a_n1_m12",
)
RESULT_FLAGS = VARIED_FLAGS + TIME_COLUMNS[3:] + ("tp_term_flag", "ep_term_flag", "risk_flag")


def project(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: every result column of every policy under every scenario."""
    return by_path(projection(spark, sf), RESULT_VALUES, RESULT_FLAGS, (_log_digest(),))


def varied(spark: SparkSession, sf: str) -> DataFrame:
    return by_path(projection(spark, sf), VARIED_DOUBLES, VARIED_FLAGS, (_log_digest(),))


def portfolio_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Totals of live policies per scenario and year; premiums count until lapse."""
    live = projection(spark, sf).where("cont_flag")
    named = ("tp", "ep", "coi", "deduction", "withdrawal", "bonus", "end_pav")
    return decode_int_rate_scenario(
        live.groupBy("scenario_no", *SCENARIO_COLUMNS, "year").agg(
            F.count("*").alias("n"), *[digest(c) for c in named]
        ),
        demo_book(spark),
    )


# -- sources and sinks -------------------------------------------------------

def _documents(spark: SparkSession, sf: str) -> DataFrame:
    """Every policy as JSON text; some are cut off, have an unknown code or lack a field."""
    k = F.col("id").cast("bigint")
    text = F.to_json(F.struct("id", "owner", "created_date", "base", "rider"))
    broken = (
        F.when(k % 41 == 1, F.substring(text, 1, 200))
        .when(k % 41 == 2, F.replace(text, F.lit('"F000"'), F.lit('"F999"')))
        .when(k % 41 == 3, F.replace(text, F.lit('"created_date"'), F.lit('"made"')))
        .otherwise(text)
    )
    return portfolio(spark, sf).select(k.alias("k"), broken.alias("value"))


def _write_documents(documents: DataFrame, folder: str) -> None:
    """The same documents one to a line, and in files of several lines: lists of some hundred
    documents, and a file for each document that is cut off."""
    documents.select("value").write.text(f"{folder}/lines")
    cut = F.col("k") % 41 == 1
    listed = documents.groupBy(
        F.when(cut, F.col("k")).otherwise(-1 - F.floor(F.col("k") / 100)).alias("file")
    ).agg(F.concat(
        F.when(F.col("file") < 0, "[\n").otherwise(""),
        F.array_join(F.sort_array(F.collect_list("value")), ",\n"),
        F.when(F.col("file") < 0, "\n]").otherwise(""),
    ).alias("value"))
    listed.write.partitionBy("file").text(f"{folder}/several")


def read_policies(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written in both layouts, read into a table of policies and one of rejects."""
    folder = new_shared_path(spark, "documents")
    _write_documents(_documents(spark, sf), folder)
    load_policies(spark, f"{folder}/lines", f"{folder}/from-lines")
    load_policies(spark, f"{folder}/several/file=*", f"{folder}/from-several", multi_line=True)
    tables = []
    for layout in ("lines", "several"):
        good, bad = loaded(spark, f"{folder}/from-{layout}"), rejected(spark, f"{folder}/from-{layout}")
        tables.append(good.select(
            F.lit(layout).alias("layout"), F.lit(None).cast("string").alias("read_error"),
            F.col("id").alias("policy_id"), F.col("base.id").alias("product"), "base.si",
            F.col("base.insured.dob").cast("string").alias("dob"), "base.load.em_load",
            F.size("base.fund_alloc").alias("n_funds"),
            F.coalesce(F.size("base.withdrawal_plan"), F.lit(0)).alias("n_withdrawals"),
            F.when(F.col("rider").isNull(), 0).otherwise(F.size("rider")).alias("n_riders"),
            F.lit(None).cast("boolean").alias("has_text"),
        ))
        tables.append(bad.select(
            F.lit(layout).alias("layout"), "read_error",
            F.when(F.col("read_error") != "malformed document", F.col("id")).alias("policy_id"),
            (F.length("document") > 150).alias("has_text")))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def _csv_book(spark: SparkSession) -> RateBook:
    """The demo book through CSV files in the published layout."""
    folder = new_shared_path(spark, "rate-csv")
    for name, table in demo_book(spark).tables.items():
        layout = TABLES[name]
        back = {new: old for old, new in layout.renames}
        header = [part.strip().split(" ")[0] for part in layout.header.split(",")]
        source = table.withColumnsRenamed(back)
        source = source.select(*[
            F.col(c) if c in source.columns else F.lit(0).alias(c) for c in header
        ])
        if name == "modal_factor":
            source = source.withColumnRenamed("rate", " rate")
        source.coalesce(1).write.option("header", True).option(
            "ignoreLeadingWhiteSpace", False
        ).csv(f"{folder}/{layout.file}.csv")
    return RateBook.from_csv(spark, folder)


def load_rate_csv(spark: SparkSession, sf: str) -> DataFrame:
    terms = policy_terms(portfolio(spark, sf), _csv_book(spark))
    return terms.select("policy_id", "tp_1", "tp_12", "reject_reason")


def scan_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Insurance rates of all policies from storage by product, for the ages at the contract date."""
    folder = new_shared_path(spark, "rate-parquet")
    demo_book(spark).write_parquet(folder, by_product=True)
    book = RateBook.from_parquet(spark, folder)
    rates = book.scan("coi_rate").select(
        "product", "gender", F.col("age").alias("entry_age"), F.col("rate").alias("coi_rate"))
    side = book.side("coi_rate", using=rates)
    return _aged(spark, sf).join(side, ["product", "gender", "entry_age"], "left").select(
        *POLICY_KEYS, "coi_rate")


WRITTEN = ("policy_id", "scenario_no", "int_rate_scenario", "year", "end_pav")


def _written(spark: SparkSession, sf: str) -> DataFrame:
    """The results as they are: keys and all result columns."""
    return projection(spark, sf)


def _gathered(spark: SparkSession) -> int:
    return 4 * spark.sparkContext.defaultParallelism


def _by_scenario(table: DataFrame) -> DataFrame:
    return table.groupBy("int_rate_scenario", "scenario_no").agg(digest("end_pav"), F.count("*").alias("n"))


def _all_by_scenario(table: DataFrame) -> DataFrame:
    """Digests of every column by scenario."""
    place = F.col("policy_id").cast("bigint") * F.col("year")
    return table.groupBy("scenario_no", *SCENARIO_COLUMNS).agg(
        F.count("*").alias("n"), F.sum("year").alias("year"), large_digest("policy_id", place),
        *[large_digest(c) for c in RESULT_VALUES], *[flag_digest(c) for c in RESULT_FLAGS], _log_digest())


def write_and_read_result(spark: SparkSession, sf: str) -> DataFrame:
    """All result columns gathered into few files; one folder is then written again, as by a
    repeated run, and every column is read back."""
    path = new_shared_path(spark, "results")
    kept = _written(spark, sf)
    write_result(kept, path, gathered=_gathered(spark))
    write_result(kept.where("int_rate_scenario = 'Low'"), path, mode="replace", gathered=_gathered(spark))
    return _all_by_scenario(spark.read.parquet(path))


def write_and_read_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = new_shared_path(spark, "results-csv")
    kept = _written(spark, sf)
    write_result(kept, path, "csv", gathered=_gathered(spark), compression="gzip")
    return _by_scenario(spark.read.schema(kept.schema).option("header", True).csv(path))


def ordered_output(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and files that do not follow the order of policy, scenario and year."""
    path = new_shared_path(spark, "results-ordered")
    ordered = project_portfolio(portfolio(spark, sf), demo_book(spark), ordered=_spread(spark))
    write_result(ordered.select(*WRITTEN), path, in_order=True, file_rows=100_000)
    return order_breaks(spark, path)


# -- policy level ------------------------------------------------------------

def _policy_query(*columns: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _terms(spark, sf).select(*POLICY_KEYS, *columns)

    return run


def _product_query(*columns: str):
    """Ages and product terms need no rate table and no premium."""
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return with_product_terms(_aged(spark, sf)).select(*POLICY_KEYS, *columns)

    return run


def prem_rate(spark: SparkSession, sf: str) -> DataFrame:
    return lookups.with_prem_rate(_aged(spark, sf), demo_book(spark)).select(
        *POLICY_KEYS, "prem_rate"
    )


def extra_prem_rate(spark: SparkSession, sf: str) -> DataFrame:
    return lookups.with_extra_prem_rate(_aged(spark, sf), demo_book(spark)).select(
        *POLICY_KEYS, "em_load_term", "extra_prem_rate"
    )


def modal_factor(spark: SparkSession, sf: str) -> DataFrame:
    return lookups.with_modal_factors(_aged(spark, sf), demo_book(spark)).select(
        *POLICY_KEYS, *lookups.MODAL_FACTORS
    )


def _grid_rate(table: str, *columns: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rated = lookups.with_grid_rates(_grid(spark, sf), demo_book(spark), only=(table,))
        return rated.select("policy_id", "year", "age", "cal_year", *columns)

    return run


def int_rate(spark: SparkSession, sf: str) -> DataFrame:
    """High and low rates of every policy."""
    rated = lookups.with_int_rates(_aged(spark, sf), demo_book(spark))
    return rated.select("policy_id", "product", "int_rate_high", "int_rate_low")


def int_rate_tuple(spark: SparkSession, sf: str) -> DataFrame:
    rated = lookups.with_int_rates(_aged(spark, sf), demo_book(spark))
    return rated.select("policy_id", "int_rate_high", "int_rate_low", "int_rate_guaranteed")


def age_limits(spark: SparkSession, sf: str) -> DataFrame:
    limited = lookups.with_age_limits(_aged(spark, sf), demo_book(spark))
    return limited.select(
        *POLICY_KEYS, "limit_min_entry_age", "limit_max_entry_age", "limit_maturity_age",
        (F.col("entry_age") > F.col("limit_max_entry_age")).alias("over_max"),
    )


def policy_ages(spark: SparkSession, sf: str) -> DataFrame:
    """Completed years of insured and owner at the contract date."""
    return portfolio(spark, sf).select(
        F.col("id").alias("policy_id"),
        age_years(F.col("base.insured.dob"), F.col("base.rcd")).alias("insured_age"),
        age_years(F.col("owner.dob"), F.col("base.rcd")).alias("owner_age"),
        age_years(F.col("base.rcd"), F.col("base.insured.dob")).alias("reversed_age"),
    )


def policy_month_ages(spark: SparkSession, sf: str) -> DataFrame:
    return portfolio(spark, sf).select(
        F.col("id").alias("policy_id"),
        age_months(F.col("base.insured.dob"), F.col("base.rcd")).alias("insured_months"),
        age_months(F.col("owner.dob"), F.col("base.rcd")).alias("owner_months"),
    )


def planned_withdrawals(spark: SparkSession, sf: str) -> DataFrame:
    return withdrawal_years(flatten(portfolio(spark, sf)))


def rejected_policies(spark: SparkSession, sf: str) -> DataFrame:
    return rejects(_terms(spark, sf))


def _holed_book(spark: SparkSession) -> RateBook:
    """The demo book without some rates, with a charge of 100% and a product whose rates were not all read."""
    tables = demo_book(spark).tables
    charges, product = tables["alloc_chrg_rate"], F.col("product")
    whole = (product == "UVL03") & (F.col("year") == 30)
    holed = dict(
        tables,
        int_rate=tables["int_rate"].where(product != "ILP01"),
        modal_factor=tables["modal_factor"].where((product != "UVL02") | (F.col("mode") != 12)),
        prem_rate=tables["prem_rate"].where((product != "UVL03") | (F.col("age") < 40)),
        alloc_chrg_rate=charges.withColumn("ep_rate", F.when(whole, 1.0).otherwise(F.col("ep_rate"))),
    )
    return replace(RateBook.of(holed), unread=("UVL01",))


def rejected_for_every_reason(spark: SparkSession, sf: str) -> DataFrame:
    """Rejects of a portfolio with holes under whole rates, and of the plain one under rates with holes."""
    base, insured = F.col("base"), F.col("base")["insured"]
    flaw = F.col("id").cast("bigint") % 11
    born = F.when(flaw == 2, F.date_add(base["rcd"], 1)).when(
        flaw == 4, F.date_sub(base["rcd"], 25_600)).otherwise(insured["dob"])
    overlapping = F.array(*[
        F.struct(F.lit(a).alias("from"), F.lit(b).alias("to"), F.lit(5e6).alias("amount")) for a, b in ((4, 8), (8, 9))])
    holes = (
        base.withField("si", F.when(flaw != 1, base["si"]))
        .withField("insured", insured.withField("dob", born))
        .withField("id", F.when(flaw == 3, "ILP02").otherwise(base["id"]))
        .withField("maturity_option", F.when(flaw == 4, 2).otherwise(base["maturity_option"]))
        .withField("withdrawal_plan", F.when(flaw == 5, overlapping).otherwise(base["withdrawal_plan"]))
    )
    plain, spread = portfolio(spark, sf), _spread(spark)
    of_policies = rejects(policy_terms(plain.withColumn("base", holes), demo_book(spark), partitions=spread))
    of_rates = rejects(policy_terms(plain, _holed_book(spark), partitions=spread))
    return of_policies.withColumn("flawed", F.lit("policies")).unionByName(
        of_rates.withColumn("flawed", F.lit("rates")))


def _validated(spark: SparkSession, sf: str) -> DataFrame:
    return validate(flawed_portfolio(spark, sf), partitions=_spread(spark))


def broken_rules(spark: SparkSession, sf: str) -> DataFrame:
    return violations(_validated(spark, sf)).select("policy_id", "rule", "message")


def first_broken_rule(spark: SparkSession, sf: str) -> DataFrame:
    return first_failures(_validated(spark, sf))


def quarantine(spark: SparkSession, sf: str) -> DataFrame:
    held = quarantined(_validated(spark, sf))
    return held.select(F.col("id").alias("policy_id"), F.size("violations").alias("n_rules"))


def dimensions(spark: SparkSession, sf: str) -> DataFrame:
    return decode_dimensions(portfolio(spark, sf), demo_book(spark))


def rider_table(spark: SparkSession, sf: str) -> DataFrame:
    rated = rated_riders(portfolio(spark, sf), demo_book(spark))
    return rated.select(
        "policy_id", "position", "product", "entry_age", "si", "hop2_option",
        F.col("load.pm_load").alias("pm_load"), "modal_factor_12", "limit_min_entry_age",
        "limit_max_entry_age", "limit_maturity_age",
    )


# -- grid and scenarios ------------------------------------------------------

def fixed_time_columns(spark: SparkSession, sf: str) -> DataFrame:
    return _grid(spark, sf).select("policy_id", *TIME_COLUMNS)


def fixed(spark: SparkSession, sf: str) -> DataFrame:
    return fixed_table(accepted(_terms(spark, sf)), demo_book(spark))


def fixed_mapping(spark: SparkSession, sf: str) -> DataFrame:
    """The rate columns that the joins put on the yearly grid."""
    return mapped(_grid(spark, sf), demo_book(spark)).select("policy_id", "year", *FIXED_COLUMNS[7:])


def _path_query(*columns: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _paths(spark, sf).select("policy_id", "scenario_no", *columns)

    return run


def _premiums(spark: SparkSession, sf: str) -> DataFrame:
    grid = fixed_init(_paths(spark, sf).drop("ep"))
    return add_layers(lookups.with_grid_rates(
        grid, demo_book(spark), only=("alloc_chrg_rate", "srr_chrg_rate")
    ), PREMIUM_LAYERS)


def scenario_columns(spark: SparkSession, sf: str) -> DataFrame:
    return by_path(
        _premiums(spark, sf), ("annual_int_rate",), ("tp_term_flag", "ep_term_flag", "risk_flag")
    )


def premium(spark: SparkSession, sf: str) -> DataFrame:
    return by_path(_premiums(spark, sf), ("tp", "ep"), ("risk_flag",))


def charges_and_allocation(spark: SparkSession, sf: str) -> DataFrame:
    return by_path(
        _premiums(spark, sf),
        ("srr_chrg", "tp_alloc_chrg", "ep_alloc_chrg", "tp_alloc", "ep_alloc"),
    )


def union_scenarios(spark: SparkSession, sf: str) -> DataFrame:
    return projection(spark, sf).groupBy("policy_id", "scenario_no", *SCENARIO_COLUMNS).agg(
        F.count("*").alias("n_years"), F.max("year").alias("last_year")
    )


# -- comparison --------------------------------------------------------------

def reconciliation(spark: SparkSession, sf: str) -> DataFrame:
    """The fixed table against a copy with rows lost, repeated and changed."""
    table = fixed(spark, sf)
    year = F.col("year")
    changed = table.withColumn(
        "coi_rate", F.when(year % 5 == 0, F.col("coi_rate") * 1.000001).otherwise(F.col("coi_rate"))
    ).withColumn("pol_term_flag", F.col("pol_term_flag") & (year % 9 != 0))
    copy = changed.where(year != 3).unionByName(changed.where(year == 4))
    return reconcile(table, copy, ["policy_id", "year"]).select(
        "matched", "only_left", "only_right", "repeated", "diff_coi_rate", "diff_pol_term_flag",
        "diff_admin_chrg",
    )


def equal_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Join form and array form of the fixed table hold the same values."""
    by_join = fixed(spark, sf)
    by_array = projection(spark, sf).where("scenario_no = 1").select(by_join.columns)
    return compare_frames(by_join, by_array, ["policy_id", "year"])


def repeated_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Rates of each policy, a key of many rows, against a copy within the tolerance, but for
    policies that were changed or left out."""
    rates = fixed(spark, sf).select("policy_id", "coi_rate", "lb_rate", "pol_term_flag")
    k = F.col("policy_id").cast("bigint")
    copy = rates.where(k % 10 != 2).withColumn("coi_rate", F.when(k % 10 == 1, F.col("coi_rate") + 1.0).otherwise(
        F.col("coi_rate") * (1 + 1e-12)))
    return ranked_pairs(rates, copy, ["policy_id"]).groupBy("policy_id").agg(
        F.sum("rows").alias("n"), F.sum(F.when(F.col("unpaired"), F.col("rows")).otherwise(0)).alias("n_unpaired"),
        F.sum(F.when(F.col("differs"), F.col("rows")).otherwise(0)).alias("n_differing"))


def bonus_review_check(spark: SparkSession, sf: str) -> DataFrame:
    """Bonus reviews recomputed by windows over the results, and those that do not agree."""
    reviews = bonus_reviews(projection(spark, sf), accepted(_terms(spark, sf)))
    return differing(reviews, mark="wrong").groupBy("scenario_no", "review").agg(
        F.count("*").alias("n"), F.count_if("passed_again").alias("n_passed"),
        F.count_if("wrong").alias("n_differing"))


QUERIES = {
    "read_policies": read_policies,
    "scan_rates": scan_rates,
    "load_rate_csv": load_rate_csv,
    "write_result": write_and_read_result,
    "write_result_csv": write_and_read_csv,
    "ordered_output": ordered_output,
    "decode_dimensions": dimensions,
    "prem_rate": prem_rate,
    "extra_prem_rate": extra_prem_rate,
    "modal_factor": modal_factor,
    "alloc_chrg_rate": _grid_rate("alloc_chrg_rate", "tp_alloc_chrg_rate", "ep_alloc_chrg_rate"),
    "srr_chrg_rate": _grid_rate("srr_chrg_rate", "srr_chrg_rate"),
    "lb_rate": _grid_rate("lb_rate", "lb_rate"),
    "coi_rate": _grid_rate("coi_rate", "coi_rate"),
    "juvenile_lien_rate": _grid_rate("juvenile_lien_rate", "juvenile_lien_rate"),
    "admin_chrg": _grid_rate("admin_chrg", "admin_chrg"),
    "int_rate": int_rate,
    "int_rate_tuple": int_rate_tuple,
    "age_limits": age_limits,
    "acc_coi_rate": _product_query("acc_coi_rate"),
    "age_years": policy_ages,
    "age_months": policy_month_ages,
    "entry_age": _product_query("entry_month_age"),
    "policy_term": _product_query("maturity_age", "term", "acc_ben_term"),
    "withdrawal_years": planned_withdrawals,
    "modal_tp": _policy_query("tp_1", "tp_2", "tp_4", "tp_12"),
    "modal_ep": _policy_query("ep_1", "ep_2", "ep_4", "ep_12"),
    "big_case_bonus": _policy_query("tp_1", "big_case_bonus"),
    "product_params": _product_query(
        "must_pay_period", "lb_review_period", "sb_review_period", "min_si",
        "withdrawal_start_year",
    ),
    "policy_terms": _policy_query(
        "term", "prem_rate", "extra_prem_rate", "tp_1", "ep_1", "big_case_bonus",
        "int_rate_high", "reject_reason",
    ),
    "rejects": rejected_policies,
    "rejects_all_reasons": rejected_for_every_reason,
    "violations": broken_rules,
    "first_failure": first_broken_rule,
    "quarantine": quarantine,
    "fixed_init": fixed_time_columns,
    "fixed_mapping": fixed_mapping,
    "fixed": fixed,
    "scenario_grid": _path_query(*SCENARIO_COLUMNS),
    "scenario_interest": _path_query("annual_int_rate"),
    "annuity_factor": _path_query("due_a_n1_m12"),
    "scenario_term": _path_query("term_scenario", "tp_term", "ep_term"),
    "scenario_columns": scenario_columns,
    "premium": premium,
    "charges_and_allocation": charges_and_allocation,
    "result_defaults": result_defaults,
    **{name: _roll_step(*step) for name, step in ROLL_STEPS.items()},
    "withdrawal": withdrawal,
    "lapse": lapse,
    "varied": varied,
    "union_scenarios": union_scenarios,
    "project_portfolio": project,
    "portfolio_totals": portfolio_totals,
    "reconcile": reconciliation,
    "compare_frames": equal_frames,
    "compare_repeated_keys": repeated_keys,
    "bonus_review_check": bonus_review_check,
    "riders": rider_table,
}

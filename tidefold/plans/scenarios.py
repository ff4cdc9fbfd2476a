"""The 18 scenarios and what each sets for a policy."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold import codes
from tidefold.plans.options import ProjectionOptions

SCENARIO_COLUMNS = ("int_rate_scenario", "risk_scenario", "term_scenario")
SCENARIOS = tuple(
    product(codes.INT_RATE_SCENARIOS, codes.RISK_SCENARIOS, codes.TERM_SCENARIOS)
)


def _grid() -> Column:
    return F.array(*[
        F.struct(
            F.lit(number).alias("scenario_no"),
            *[F.lit(label).alias(name) for name, label in zip(SCENARIO_COLUMNS, labels)],
        )
        for number, labels in enumerate(SCENARIOS, start=1)
    ])


# Columns of policy terms that a scenario's value is taken from, by label.
RATE_SOURCES = {
    label: {"annual_int_rate": f"int_rate_{label.lower()}", "due_a_n1_m12": f"due_{label.lower()}"}
    for label in codes.INT_RATE_SCENARIOS
}
TERM_SOURCES = dict(zip(codes.TERM_SCENARIOS, (
    {"tp_term": "term", "ep_term": "term"},
    {"tp_term": "opted_tp_term", "ep_term": "opted_ep_term"},
    {"tp_term": "must_pay_period", "ep_term": "must_pay_period"},
)))
SOURCE_COLUMNS = tuple(dict.fromkeys(
    column for sources in (RATE_SOURCES, TERM_SOURCES) for chosen in sources.values() for column in chosen.values()
))


def scenario_sources(options: ProjectionOptions = ProjectionOptions()) -> list[dict]:
    """For each scenario in order the column of each of its values, and its ``risk_flag``."""
    found = []
    for interest, risk, term in SCENARIOS:
        chosen = {**RATE_SOURCES[interest], **TERM_SOURCES[term]}
        chosen["ep_paid_term"] = chosen["ep_term" if options.ep_uses_ep_term else "tp_term"]
        found.append({**chosen, "risk_flag": risk == codes.RISK_SCENARIOS[1]})
    return found


def with_scenarios(
    terms: DataFrame, options: ProjectionOptions = ProjectionOptions()
) -> DataFrame:
    """One row per policy and scenario, with its rate, annuity factor and terms."""
    crossed = terms.select("*", F.inline(_grid()))
    return crossed.select(
        "*",
        *[_chosen("int_rate_scenario", RATE_SOURCES, name) for name in ("annual_int_rate", "due_a_n1_m12")],
        *[_chosen("term_scenario", TERM_SOURCES, name) for name in ("tp_term", "ep_term")],
        (F.col("risk_scenario") == codes.RISK_SCENARIOS[1]).alias("risk_flag"),
    ).withColumn("ep_paid_term", F.col("ep_term" if options.ep_uses_ep_term else "tp_term"))


def _chosen(scenario: str, sources: dict[str, dict[str, str]], name: str) -> Column:
    *first, last = sources
    value = F.col(sources[last][name])
    for label in reversed(first):
        value = F.when(F.col(scenario) == label, F.col(sources[label][name])).otherwise(value)
    return value.alias(name)

"""The roll-forward: account values carried from year to year until lapse.

A year starts where the last one ended, and bonuses look back over withdrawals
that were or were not paid, so no window expresses it. Each policy is independent:
``mapInArrow`` takes one row a policy and steps a slice of policies through the years
under all scenarios at once, as NumPy arrays of one value for each path that still runs,
with no shuffle and no grouping; rates are read once a policy. Only the carried state of the
years up to lapse comes back; every other result column is a projection of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidefold.operators.lookups import CURVE_NO, DENSE, FLOATING, GRID_KEYS, Curves
from tidefold.plans.formulas import (
    ACCOUNT_LAYERS,
    END_LAYERS,
    PREMIUM_LAYERS,
    evaluate,
    needed,
)
from tidefold.plans.options import ProjectionOptions
from tidefold.plans.scenarios import SCENARIOS, SOURCE_COLUMNS, scenario_sources

SLICE_POLICIES = 256

STATE_COLUMNS = (
    "start_si", "start_eav", "start_tav",
    "lb_tav_withdrawal_review", "sb_tav_withdrawal_review",
)
LAST_YEARS = "last_years"
FIRST_STATES = "first_states"
WITHDRAWALS = "withdrawal_plan_by_year"
SCALARS = tuple(dict.fromkeys((
    "term", "entry_age", "rcd_year", "acc_ben_term", "em_load_term", "pm_load_term", "si",
    "tp_1", "ep_1", "big_case_bonus", "option_a",
    "acc_ben_coeff", "em_load_pct", "pm_load_rate", "extra_prem_rate", "acc_coi_rate",
    "min_si", "lb_review_period", "sb_review_period", "has_special_bonus", "sb_year_offset",
    *SOURCE_COLUMNS,
)))

_END = {"end_si", "end_eav", "end_tav"}
_TO_END = needed(END_LAYERS, _END)
_ACCOUNTS = needed(
    PREMIUM_LAYERS + ACCOUNT_LAYERS,
    _END | {"tav_withdrawal"} | {i for _, _, inputs in _TO_END for i in inputs},
)
# What a path carries of its policy: inputs of formulas, and what ends covers, reviews and itself.
_READ = {i for _, _, inputs in (*_ACCOUNTS, *_TO_END) for i in inputs} | {
    "term", "acc_ben_term", "em_load_term", "pm_load_term", "lb_review_period", "sb_review_period",
}


def roll_forward(
    policies: DataFrame, curves: Curves, options: ProjectionOptions = ProjectionOptions()
) -> DataFrame:
    """Add to each policy its rates by calendar year, one for each policy year, and lists
    over scenarios, one after the other: ``last_years``, the lapse or last year of each,
    ``first_states``, the place in the lists of states where its own start, and the state of
    each of its policy years up to the last; it is 0 after that."""
    names = [name for name in policies.columns if name != CURVE_NO]
    doubles = T.ArrayType(T.DoubleType(), containsNull=False)
    kinds = {name: policies.schema[name].dataType for name in names}
    kinds[WITHDRAWALS] = doubles
    kinds.update(dict.fromkeys(FLOATING, doubles))
    kinds.update(dict.fromkeys((LAST_YEARS, FIRST_STATES), T.ArrayType(T.IntegerType(), containsNull=False)))
    kinds.update(dict.fromkeys(STATE_COLUMNS, doubles))
    # Accepted policies have no null term. Saying so keeps null checks out of
    # the code generated for the result columns, which halves its size.
    schema = T.StructType([T.StructField(name, kind, False) for name, kind in kinds.items()])
    sent = policies.sparkSession.sparkContext.broadcast(curves)
    sources = scenario_sources(options)

    def roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE_POLICIES):
                part = batch.slice(first, SLICE_POLICIES)
                yield pa.RecordBatch.from_arrays(
                    [part.column(name) for name in names] + _roll_slice(part, sent.value, sources),
                    names=list(kinds),
                )

    return policies.mapInArrow(roll, schema)


def _roll_slice(part: pa.RecordBatch, curves: Curves, sources: list[dict]) -> list[pa.Array]:
    values = {name: part.column(name).to_numpy(zero_copy_only=False) for name in SCALARS}
    terms, paths = values["term"], part.num_rows * len(SCENARIOS)
    years = int(terms.max(initial=0))
    yearly = _by_policy_year(part, values, curves)
    by_scenario = {
        name: np.stack([values[source[name]] for source in sources], axis=1).ravel()
        for name in ("annual_int_rate", "due_a_n1_m12", "tp_term", "ep_paid_term")
    }
    by_scenario["risk_flag"] = np.tile([s["risk_flag"] for s in sources], part.num_rows)
    # Paths go by policy and scenario, and leave when they lapse or their term ends.
    own = {name: np.repeat(value, len(SCENARIOS)) for name, value in values.items() if name in _READ}
    own.update(by_scenario, start_si=np.repeat(values["si"].astype(float), len(SCENARIOS)),
               start_eav=np.zeros(paths), start_tav=np.zeros(paths), cont_flag=np.ones(paths, dtype=bool),
               path=np.arange(paths), first=np.repeat(np.cumsum(terms) - terms, len(SCENARIOS)))
    history = np.zeros((years, paths))
    kept = {name: [np.zeros(0)] for name in STATE_COLUMNS}
    lived = [np.zeros(0, dtype=np.int64)]

    for year in range(1, years + 1):
        now = dict(own, year=year)
        at = own["first"] + (year - 1)
        for name, rates in yearly.items():
            now[name] = rates[at]
        for cover in ("acc_ben", "em_load", "pm_load"):
            now[f"{cover}_term_flag"] = year <= own[f"{cover}_term"]
        evaluate(_ACCOUNTS, now)

        history[year - 1, own["path"]] = now["tav_withdrawal"]
        for name, due in (("lb", now["lb_reviewed"]), ("sb", now["sb_rate"] > 0.0)):
            now[f"{name}_tav_withdrawal_review"] = _review(
                history, year, own[f"{name}_review_period"], due, own["path"])
        evaluate(_TO_END, now)

        lived.append(own["path"])
        for name, parts in kept.items():
            parts.append(now[name])
        own.update(start_si=now["end_si"], start_eav=now["end_eav"], start_tav=now["end_tav"])
        goes_on = now["deduction_flag"] & (year < own["term"])
        if not goes_on.all():
            stay = np.flatnonzero(goes_on)
            own = {name: value[stay] for name, value in own.items()}

    counts = [len(path) for path in lived[1:]]
    lived = np.concatenate(lived)
    last_year = np.bincount(lived, minlength=paths)
    # Years were kept one after the other; each value goes to its place in its path.
    place = (np.cumsum(last_year) - last_year)[lived] + np.repeat(np.arange(len(counts)), counts)
    in_policy = last_year.reshape(part.num_rows, len(SCENARIOS))
    each = np.full(part.num_rows, len(SCENARIOS))
    return [
        *[_lists(yearly[name], terms) for name in FLOATING],
        _lists(last_year.astype(np.int32), each),
        _lists((np.cumsum(in_policy, axis=1) - in_policy).astype(np.int32).ravel(), each),
        *[_lists(_placed(np.concatenate(parts), place), in_policy.sum(axis=1)) for parts in kept.values()],
    ]


def _by_policy_year(part: pa.RecordBatch, values: dict, curves: Curves) -> dict[str, np.ndarray]:
    """Rates and planned withdrawals, which no scenario changes, of each policy year in turn."""
    terms = values["term"]
    policy = np.repeat(np.arange(part.num_rows), terms)
    year = np.arange(len(policy)) - (np.cumsum(terms) - terms)[policy] + 1
    keys = {
        "year": year,
        "age": values["entry_age"][policy] - 1 + year,
        "cal_year": values["rcd_year"][policy].astype(np.int64) - 1 + year,
    }
    number = part.column(CURVE_NO).to_numpy(zero_copy_only=False)[policy]
    found = {name: curves.at(name, number, keys[GRID_KEYS[name]]) for name in DENSE + FLOATING}
    return dict(found, withdrawal_input=_ByYear(part, WITHDRAWALS).at(policy, year))


def _placed(values: np.ndarray, place: np.ndarray) -> np.ndarray:
    placed = np.empty_like(values)
    placed[place] = values
    return placed


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    offsets = pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(values))


def _review(history: np.ndarray, year: int, span: np.ndarray, due: np.ndarray, path: np.ndarray) -> np.ndarray:
    """Withdrawals from the target account over the last ``span`` years, oldest first."""
    total, at = np.zeros(len(due)), np.flatnonzero(due)
    if len(at):
        span, path, reviewed = span[at], path[at], np.zeros(len(at))
        for back in range(min(int(span.max()), year) - 1, -1, -1):
            reviewed = reviewed + np.where(back < span, history[year - 1 - back, path], 0.0)
        total[at] = reviewed
    return total


class _ByYear:
    """A list column with one number for each policy year of its row."""

    def __init__(self, part: pa.RecordBatch, name: str):
        lists = part.column(name)
        offsets = lists.offsets.to_numpy()
        self.start, self.length = offsets[:-1], np.diff(offsets)
        self.amounts = lists.values.to_numpy(zero_copy_only=False)

    def at(self, row: np.ndarray, year: np.ndarray) -> np.ndarray:
        if not len(self.amounts):
            return np.zeros(len(row))
        # Clipping only keeps the reads in bounds; years past a row's list get 0.
        found = self.amounts.take(self.start[row] + (year - 1), mode="clip")
        return np.where(year <= self.length[row], found, 0.0)

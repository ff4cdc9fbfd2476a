"""Premium amounts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidefold import codes


def up_to_thousand(amount: Column) -> Column:
    return F.ceil(amount / 1000.0) * F.lit(1000.0)


def crude_premium(prem_rate: Column, si: Column) -> Column:
    return prem_rate * si / 1000.0


def modal_amount(factor: Column, annual: Column) -> Column:
    return up_to_thousand(factor * annual)


def big_case_bonus(pays_bonus: Column, annual_tp: Column, small_case_zero: bool) -> Column:
    """Share of a large annual premium; null where no tier covers the case."""
    bonus = F.when(~pays_bonus, F.lit(0.0))
    for minimum, share in codes.BIG_CASE_TIERS:
        bonus = bonus.when(annual_tp >= minimum, annual_tp * share)
    return bonus.otherwise(F.lit(0.0) if small_case_zero else F.lit(None).cast("double"))


def annuity_due_monthly(annual_rate: Column, zero_rate_is_one: bool) -> Column:
    """Value at the start of a year of 1/12 paid at the start of each month.

    A zero rate makes the closed form 0/0, hence NaN; ANSI division would raise.
    """
    at_zero = F.lit(1.0) if zero_rate_is_one else F.lit(float("nan"))
    monthly = F.pow(1.0 + annual_rate, F.lit(1.0) / 12.0) - 1.0
    discount = 1.0 - F.pow(1.0 + monthly, F.lit(-1.0))
    grown = F.pow(1.0 + monthly, F.lit(12.0)) - 1.0
    return F.when(discount == 0.0, at_zero).otherwise(
        grown / 12.0 / discount / (1.0 + annual_rate)
    )

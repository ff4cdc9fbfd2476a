"""Switches for points where the product rules can be read in two ways."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ProjectionOptions:
    """Defaults give the published results; each switch gives the other reading.

    ep_uses_ep_term: stop excess premium at the excess, not the target, term.
    sb_year_offset: 0 pays special bonus in years 11 and 21, 1 in 10 and 20.
    small_case_bonus_zero: no bonus, rather than a reject, under the lowest tier.
    zero_rate_annuity_one: annuity factor 1 at a zero rate, rather than lapse.
    """

    ep_uses_ep_term: bool = False
    sb_year_offset: int = 0
    small_case_bonus_zero: bool = False
    zero_rate_annuity_one: bool = False

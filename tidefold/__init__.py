"""Portfolio cashflow projection for universal-life and investment-linked policies."""

from tidefold.plans.options import ProjectionOptions
from tidefold.plans.projection import project_portfolio
from tidefold.sources.policies import parse_policies, read_policies
from tidefold.sources.rates import RateBook

__all__ = [
    "ProjectionOptions",
    "RateBook",
    "parse_policies",
    "project_portfolio",
    "read_policies",
]

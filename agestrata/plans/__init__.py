"""Queries over the driver's tables, each with its SQL counterpart."""

from agestrata.plans import curves, ratios, schedules, tables  # noqa: F401
from agestrata.plans.registry import ORACLES, QUERIES


def all_queries():
    return dict(QUERIES)


def all_oracles():
    return dict(ORACLES)

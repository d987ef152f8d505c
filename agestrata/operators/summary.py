"""Summaries of population tables over replicates."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agestrata.functions.aggregates import total
from agestrata.functions.quantiles import group_quantiles
from agestrata.operators.filters import at_horizon, latest_year
from agestrata.operators.reshape import union_missing

# Reported quantiles.
PROFILE_QUANTILES = {"Lower": 0.1, "Upper": 0.9}
TOTAL_QUANTILES = {"Median": 0.5, "Lo95": 0.025, "Up95": 0.975, "Lo80": 0.1, "Up80": 0.9}


def column_range(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: ``min_<column>, max_<column>`` for each column."""
    return df.agg(
        *[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))]
    )


def age_profile_summary(
    sim: DataFrame,
    keys: Sequence[str] = ("Sex", "Age", "Year"),
    na_rm: bool = False,
) -> DataFrame:
    """``keys, Mean, Lower, Upper`` of Population over replicates."""
    return group_quantiles(sim, keys, "Population", PROFILE_QUANTILES, "Mean", na_rm)


def total_population(
    pop: DataFrame, keys: Sequence[str] = ("Sex", "Year"), na_rm: bool = False
) -> DataFrame:
    """Population over all ages, in thousands of the input unit."""
    return pop.groupBy(*keys).agg((total(F.col("Population"), na_rm) / 1000.0).alias("Population"))


def total_population_summary(
    sim: DataFrame,
    keys: Sequence[str] = ("Sex", "Year"),
    na_rm: bool = False,
) -> DataFrame:
    """Total per replicate, then mean and quantiles over replicates."""
    totals = total_population(sim, ["Rep", *keys], na_rm)
    return group_quantiles(totals, keys, "Population", TOTAL_QUANTILES, "Mean", na_rm)


def total_population_table(history: DataFrame, sim: DataFrame, **options) -> DataFrame:
    """Observed totals, followed by the forecast summary; columns that a part lacks
    are NULL."""
    return union_missing(
        total_population(history).withColumn("Part", F.lit("history")),
        total_population_summary(sim, **options).withColumn("Part", F.lit("forecast")),
    )


def pyramid_table(history: DataFrame, sim: DataFrame, ahead: int = 20, **options) -> DataFrame:
    """Last observed age profile and the summary of the simulated ones ``ahead`` years
    later; the other years of ``sim`` are dropped before anything is summarised."""
    horizon = at_horizon(sim, history, ahead)
    return union_missing(latest_year(history), age_profile_summary(horizon, **options))

"""Restrictions and rescalings. All are plain predicates and projections, so
Catalyst pushes them into the scan and prunes partitions stored by Year."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agestrata.functions.aggregates import total
from agestrata.schema import FERTILE_AGES, OPEN_AGE


def restrict_ages(df: DataFrame, lo: int = 0, hi: int = OPEN_AGE) -> DataFrame:
    """Keep ages ``lo..hi``; older ages are dropped, not folded into ``hi``."""
    return df.where(F.col("Age").between(lo, hi))


def collapse_open_age(
    df: DataFrame,
    keys: Sequence[str] = ("Year", "Sex"),
    top: int = OPEN_AGE,
    measure: str = "Population",
    na_rm: bool = False,
) -> DataFrame:
    """Sum all ages from ``top`` on into one open group."""
    return (
        df.withColumn("Age", F.when(F.col("Age") > top, top).otherwise(F.col("Age")))
        .groupBy(*keys, "Age")
        .agg(total(F.col(measure), na_rm).alias(measure))
    )


def restrict_years(df: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Keep years from ``first`` to ``last``; either end may be open or lie
    beyond the data."""
    if first is not None:
        df = df.where(F.col("Year") >= first)
    if last is not None:
        df = df.where(F.col("Year") <= last)
    return df


def shift_and_cap_years(sim: DataFrame, shift: int = 1, last: int = 2050) -> DataFrame:
    """Relabel years by ``shift``, then drop those after ``last``."""
    return restrict_years(sim.withColumn("Year", (F.col("Year") + shift).cast("int")), last=last)


def years_from_latest(df: DataFrame, history: DataFrame, ahead: int = 0) -> DataFrame:
    """Rows ``ahead`` years after the last year of ``history``. The year is a
    scalar subquery: one value, whatever the size of ``history``."""
    latest = history.agg((F.max("Year") + ahead).cast("int").alias("Year"))
    return df.where(F.col("Year") == latest.scalar())


def latest_year(df: DataFrame) -> DataFrame:
    """Rows of the last year present."""
    return years_from_latest(df, df)


def at_horizon(df: DataFrame, history: DataFrame, ahead: int = 20) -> DataFrame:
    """Forecast rows ``ahead`` years after the last observed year."""
    return years_from_latest(df, history, ahead)


def policy_slice(policy: DataFrame, name: str, first_year: int | None = None) -> DataFrame:
    """One policy as a scheme: ``Year, age_months``."""
    return restrict_years(policy.where(F.col("Policy") == name), first_year).drop(
        "Policy", "policy_rank"
    )


def scale_measure(df: DataFrame, factor: float, measure: str = "Population") -> DataFrame:
    return df.withColumn(measure, F.col(measure) * F.lit(float(factor)))


def fertility_slice(df: DataFrame, region: str, ages: tuple[int, int] = FERTILE_AGES) -> DataFrame:
    """One region and single fertile ages of a fertility file whose Age column is
    text. Labels that are not exactly a single age ("15-19", "050") are dropped."""
    labels = [str(a) for a in range(ages[0], ages[1] + 1)]
    return df.where((F.col("Region") == region) & F.col("Age").isin(labels)).select(
        F.col("Time").cast("int").alias("Year"),
        F.col("Age").try_cast("int").alias("Age"),
        "Measure",
        "Value",
    )


def measure_slice(df: DataFrame, measure: str, factor: float = 1.0) -> DataFrame:
    """Rows of one measure with its value rescaled."""
    kept = df.where(F.col("Measure") == measure).drop("Measure")
    return scale_measure(kept, factor, "Value")

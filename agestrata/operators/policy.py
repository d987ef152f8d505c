"""Pension-age policies and how a population gets its pension age."""

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the published policies, in months. Proposed adds half a year
# every second year after 2015 up to 70; Current is the same up to 67.
BASE_AGE = 65 * 12
BASE_YEAR = 2015
STEP_MONTHS = 6
STEP_YEARS = 2
CAPS = {"Proposed": 70 * 12, "Current": 67 * 12, "Age65": 65 * 12}
FIRST_YEAR, LAST_YEAR = 1920, 2050
MOST_YEARS = 2000


def year_spine(spark: SparkSession, first: int = FIRST_YEAR, last: int = LAST_YEAR) -> DataFrame:
    return spark.range(first, last + 1).select(F.col("id").cast("int").alias("Year"))


def policy_schedule(
    years: DataFrame,
    base_year: int = BASE_YEAR,
    base_age: int = BASE_AGE,
    step_months: int = STEP_MONTHS,
    step_years: int = STEP_YEARS,
    caps: Mapping[str, int] = CAPS,
) -> DataFrame:
    """``Year, Policy, policy_rank, age_months`` for each distinct year of ``years``.

    The order of ``caps`` is the order of the policies (rank 1 first)."""
    steps = F.greatest(F.lit(0), F.col("Year") - base_year)
    risen = F.lit(base_age) + step_months * F.expr("cast(_s div %d as int)" % step_years)
    arms = F.array(
        *[
            F.struct(
                F.lit(name).alias("Policy"),
                F.lit(rank).alias("policy_rank"),
                F.lit(cap).alias("cap"),
            )
            for rank, (name, cap) in enumerate(caps.items(), 1)
        ]
    )
    # Distinct years as one array: one row at most, which Catalyst knows to be small
    # and so broadcasts, however large the table the years come from. More years than a
    # calendar has are refused, before they are gathered.
    held = years.select("Year").distinct().limit(MOST_YEARS + 1).agg(F.collect_list("Year").alias("_y"))
    too_many = F.raise_error(F.lit(f"more than {MOST_YEARS} years")).cast("array<int>")
    spine = held.select(
        F.explode(F.when(F.size("_y") <= MOST_YEARS, F.col("_y").cast("array<int>")).otherwise(too_many)).alias("Year")
    )
    return (
        spine.select("Year", steps.alias("_s"), F.explode(arms).alias("_p"))
        .select(
            "Year",
            "_p.Policy",
            "_p.policy_rank",
            F.least(risen, F.col("_p.cap")).cast("int").alias("age_months"),
        )
    )


def checked_scheme(scheme: DataFrame, on: Sequence[str] = ("Year",)) -> DataFrame:
    """The scheme, refusing two rows for one year, which would double people."""
    twice = F.raise_error(F.lit("a scheme has two pension ages for one year")).cast("int")
    return scheme.groupBy(*on).agg(
        F.when(F.count(F.lit(1)) > 1, twice).otherwise(F.max("age_months")).alias("age_months")
    )


def attach_scheme(
    pop: DataFrame,
    scheme: DataFrame,
    on: Sequence[str] = ("Year",),
    fill: bool = True,
    fill_keys: Sequence[str] = (),
) -> DataFrame:
    """Add ``age_months`` to every row of ``pop``.

    Rows outside the scheme get the lowest pension age among the scheme rows that
    ``pop`` does meet. That is one scalar for the whole table, or one per group of
    ``fill_keys`` when groups cover different years. ``fill=False`` leaves NULL and
    saves a scan of the join columns; use it when the scheme covers every year. The ratios
    of ``operators.ratio`` fill from the scan that they make anyway.
    The scheme is far smaller than the population, so Catalyst broadcasts it if
    its size allows, and otherwise joins by key.
    """
    joined = pop.join(checked_scheme(scheme, on), list(on), "left")
    if not fill:
        return joined
    met = pop.select(*fill_keys, *on).distinct().join(checked_scheme(scheme, on), list(on))
    lowest = F.min("age_months").alias("_lowest")
    if fill_keys:
        joined = joined.join(met.groupBy(*fill_keys).agg(lowest), list(fill_keys), "left")
        return joined.withColumn("age_months", F.coalesce("age_months", "_lowest")).drop("_lowest")
    return joined.withColumn("age_months", F.coalesce("age_months", met.agg(lowest).scalar()))


def order_by_policy(df: DataFrame) -> DataFrame:
    """Presentation order; sort only what is about to be written or shown."""
    return df.orderBy("policy_rank", "Year")

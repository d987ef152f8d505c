"""Rates, life tables and cohort accounting.

Tables are keyed by ``keys, Sex, Year, Age``. Windows run over the ages of one
curve, or the years of one birth cohort, so each holds at most about a hundred
rows; everything else is an aggregate or an equi-join.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from agestrata.functions.aggregates import total
from agestrata.schema import OPEN_AGE

# Fixed value: boys born per girl.
SEX_RATIO_AT_BIRTH = 1.05
# People who die within a year of age live half of it.
YEAR_SHARE = 0.5


def rate_from_counts(
    events: DataFrame, exposure: DataFrame, on: Sequence[str] = ("Year", "Age")
) -> DataFrame:
    """``on, events, exposure, rate`` for cells in both tables."""
    return events.join(exposure, list(on)).withColumn("rate", F.try_divide("events", "exposure"))


def counts_from_rate(rates: DataFrame) -> DataFrame:
    """Adds ``events = rate * exposure``."""
    return rates.withColumn("events", F.col("rate") * F.col("exposure"))


def central_rates(
    records: DataFrame, keys: Sequence[str] = ("series", "Sex", "Year", "Age"), na_rm: bool = False
) -> DataFrame:
    """Events per person at risk, from records with ``events`` and ``exposure``
    (either may come many rows per cell)."""
    return (
        records.groupBy(*keys)
        .agg(
            total(F.col("events"), na_rm).alias("events"),
            total(F.col("exposure"), na_rm).alias("exposure"),
        )
        .withColumn("rate", F.try_divide("events", "exposure"))
    )


def life_table(
    rates: DataFrame, keys: Sequence[str] = ("series", "Sex", "Year"), top: int = OPEN_AGE
) -> DataFrame:
    """``keys, Age, rate, q, l, d, lived, survival`` with radix 1 and ``top`` the open age.

    ``survival`` is the share of people of an age still alive a year later; for the
    last two ages, the share that survives into (or within) the open group. Who is left
    after an age whose row or rate is missing is not known, and NULL; so is everybody
    in a curve that does not start at age 0."""
    curve = Window.partitionBy(*keys).orderBy("Age")
    before = curve.rowsBetween(Window.unboundedPreceding, -1)
    # As many rows before an age as there are younger ages: none is missing.
    whole = F.col("_whole")
    m, q, age, lived = F.col("rate"), F.col("q"), F.col("Age"), F.col("lived")
    dying = m / (1 + (1 - YEAR_SHARE) * m)
    # A running product of survival; ln(0) is NULL, so certain death is kept apart.
    log_survivors = F.coalesce(F.sum(F.when(q < 1, F.ln(1 - q))).over(before), F.lit(0.0))
    none_left = F.count_if((q >= 1) & whole).over(before) > 0
    unknown = ~whole | (F.count_if(q.isNull()).over(before) > 0)
    older = F.first("lived").over(curve.rangeBetween(1, 1))
    younger = F.first("lived").over(curve.rangeBetween(-1, -1))
    survival = (
        F.when(age == top, F.try_divide(lived, younger + lived))
        .when(age == top - 1, F.try_divide(older, lived + older))
        .otherwise(F.try_divide(older, lived))
    )
    return (
        rates.select(*keys, "Age", "rate")
        .withColumn("q", F.when((age == top) | (dying > 1), 1.0).otherwise(dying))
        .withColumn("_whole", age == F.row_number().over(curve) - 1)
        .withColumn("l", F.when(none_left, 0.0).when(~unknown, F.exp(log_survivors)))
        .withColumn("d", F.col("l") * q)
        .withColumn(
            "lived",
            F.when(age == top, F.try_divide(F.col("l"), m)).otherwise(
                F.col("l") - (1 - YEAR_SHARE) * F.col("d")
            ),
        )
        .withColumn("survival", survival)
        .drop("_whole")
    )


def births_by_sex(
    births: DataFrame,
    keys: Sequence[str] = (),
    sex_ratio: float = SEX_RATIO_AT_BIRTH,
    na_rm: bool = False,
) -> DataFrame:
    """``keys, Year, Sex, births`` from births by age of mother."""
    shares = {"Male": sex_ratio / (1 + sex_ratio), "Female": 1 / (1 + sex_ratio)}
    arms = F.array(
        *[F.struct(F.lit(sex).alias("Sex"), F.lit(share).alias("share")) for sex, share in shares.items()]
    )
    return (
        births.groupBy(*keys, "Year")
        .agg(total(F.col("births"), na_rm).alias("_all"))
        .select(*keys, "Year", "_all", F.explode(arms).alias("_s"))
        .select(*keys, "Year", "_s.Sex", (F.col("_all") * F.col("_s.share")).alias("births"))
    )


def cohort_join(pop: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Adds ``next_population``: the same cohort a year later, ``P_{t+1}(x+1)``.

    A window over a birth cohort reads the table once, where a self-join would read
    and shuffle it twice. Rows without a later year are dropped."""
    cohort = Window.partitionBy(*keys, "Sex", F.col("Year") - F.col("Age")).orderBy("Year")
    later = F.first("Population").over(cohort.rangeBetween(1, 1))
    return pop.withColumn("next_population", later).where(F.col("next_population").isNotNull())


def cohort_deaths(
    pop: DataFrame,
    life: DataFrame,
    births: DataFrame,
    keys: Sequence[str] = (),
    top: int = OPEN_AGE,
) -> DataFrame:
    """``keys, Sex, Year, Age, start, deaths`` by age at the end of the year.

    ``start`` is who was there: the people a year younger at the beginning of the
    year (for the open group, its members too), or the births at age 0. People or births
    without a survival in the life table keep their ``start``; their deaths are NULL."""
    cell = [*keys, "Sex", "Year"]
    people = pop.join(life.select(*cell, "Age", "survival"), [*cell, "Age"], "left").select(
        *cell,
        F.least(F.col("Age") + 1, F.lit(top)).cast("int").alias("Age"),
        F.col("Population").alias("start"),
        (F.col("Population") * (1 - F.col("survival"))).alias("deaths"),
    )
    first_age = life.where(F.col("Age") == 0).select(*cell, (F.col("lived") / F.col("l")).alias("_s"))
    newborn = births.join(first_age, cell, "left").select(
        *cell,
        F.lit(0).alias("Age"),
        F.col("births").alias("start"),
        (F.col("births") * (1 - F.col("_s"))).alias("deaths"),
    )
    return (
        people.unionByName(newborn)
        .groupBy(*cell, "Age")
        .agg(total(F.col("start")).alias("start"), total(F.col("deaths")).alias("deaths"))
    )


def net_migration(
    pop: DataFrame, deaths: DataFrame, keys: Sequence[str] = (), absent_is_zero: bool = False
) -> DataFrame:
    """``keys, Sex, Year, Age, net_migration`` by growth balance: who is there a year
    later, less who was there, plus who died. ``deaths`` is from ``cohort_deaths``.

    A cell of one side only (all came, or all went) is NULL, or with ``absent_is_zero``
    counts nobody on the other. Years are those in which either side has rows for the
    sex; cells meet in one aggregate, so nothing is joined."""
    cell = [*keys, "Sex", "Year", "Age"]
    nobody = F.lit(None).cast("double")
    later = pop.select(
        *keys, "Sex", (F.col("Year") - 1).cast("int").alias("Year"), "Age",
        F.lit(1).alias("_ends"), F.col("Population").alias("end"),
        F.lit(0).alias("_starts"), nobody.alias("start"), nobody.alias("deaths"),
    )
    before = deaths.select(
        *cell, F.lit(0).alias("_ends"), nobody.alias("end"), F.lit(1).alias("_starts"), "start", "deaths"
    )
    both = later.unionByName(before).groupBy(*cell).agg(
        *[F.sum(c).alias(c) for c in ("_ends", "_starts", "end", "start", "deaths")]
    )
    curve = Window.partitionBy(*keys, "Sex", "Year")
    seen = both.withColumns({f"_any{c}": F.max(c).over(curve) for c in ("_ends", "_starts")})
    end, start, dead = (F.col(c) for c in ("end", "start", "deaths"))
    if absent_is_zero:
        end = F.when(F.col("_ends") == 0, 0.0).otherwise(end)
        start, dead = (F.when(F.col("_starts") == 0, 0.0).otherwise(c) for c in (start, dead))
    return seen.where("_any_ends > 0 AND _any_starts > 0").select(
        *cell, (end - start + dead).alias("net_migration")
    )

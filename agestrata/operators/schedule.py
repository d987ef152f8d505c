"""Search for the pension-age schedule that holds a target ratio.

For each year the ratio falls as the pension age rises, so the age a year needs is
the lowest candidate month that meets the target. Candidates come from one pass:
the number of people above each whole age gives the ratio at every month, because
the months in between are a linear mix of two whole ages.
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agestrata.functions.ages import MONTHS
from agestrata.functions.aggregates import total_where
from agestrata.functions.quantiles import interval_probabilities
from agestrata.operators.ratio import interval_summary, oadr_by_column
from agestrata.schema import WORKING_AGE

YEARLY_CAP = 12


def _with_value(
    df: DataFrame, value: int | float | DataFrame, column: str, keys: Sequence[str]
) -> DataFrame:
    """``df`` with ``column``: one value for all, or a table's (``keys``, ``column``) by key.
    A key that the table lacks gets NULL."""
    if not isinstance(value, DataFrame):
        return df.withColumn(column, F.lit(value))
    twice = F.raise_error(F.lit(f"two rows of {column} for one key")).cast("double")
    one = F.when(F.count(F.lit(1)) > 1, twice).otherwise(F.max(column)).alias(column)
    return df.join(value.groupBy(*keys).agg(one), list(keys), "left")


def _reachable(reach: int, ages: tuple[int, int] | None) -> Column:
    """``start_month``, NULL where no schedule can begin there."""
    start = F.col("start_month").cast("int")
    inside = start >= (WORKING_AGE + 1) * MONTHS
    if ages:
        inside = inside & (start >= ages[0] * MONTHS) & (start + reach < (ages[1] + 1) * MONTHS)
    return F.when(inside, start)


def candidate_ratios(
    sim: DataFrame,
    start_month: int | DataFrame,
    first_year: int,
    last_year: int,
    keys: Sequence[str] = (),
    yearly_cap: int = YEARLY_CAP,
    na_rm: bool = False,
    ages: tuple[int, int] | None = None,
) -> DataFrame:
    """``keys, Rep, Year, age_months, OADR`` for every month the schedule could have
    reached by then: ``start_month`` to ``start_month + yearly_cap * n`` in year n.

    One shuffle, of one short array per replicate and year; months are expanded
    after it. ``start_month`` must lie above working age. It may be a table ``keys,
    start_month``: then each key counts the people above the whole ages that its own
    schedule can reach, no more than any other. Keys without a start, whose start is not
    above working age, or whose schedule can leave ``ages`` (the youngest and the oldest
    whole age, where stated), have no candidates."""
    years = last_year - first_year + 1
    reach = yearly_cap * years
    age, people = F.col("Age"), F.col("Population")
    rows = sim.where(F.col("Year").between(first_year, last_year))
    if isinstance(start_month, DataFrame):
        rows = _with_value(rows, start_month, "start_month", keys).withColumn("_start", _reachable(reach, ages))
        rows = rows.where("_start IS NOT NULL")
        lowest, by, span = F.expr(f"_start div {MONTHS}"), ["_start"], reach // MONTHS + 2
    else:
        if start_month // MONTHS <= WORKING_AGE:
            raise ValueError("start_month must lie above working age")
        lowest, by = F.lit(start_month // MONTHS), []
        span = (start_month + reach) // MONTHS + 1 - start_month // MONTHS
    above = [F.sum(F.when(age >= lowest + k, people)) for k in range(span + 1)]
    adults = total_where(age >= WORKING_AGE, people, na_rm)
    per_year = rows.groupBy(*keys, "Rep", "Year", *by).agg(adults.alias("_adults"), F.array(*above).alias("_above"))
    started = per_year if by else per_year.withColumn("_start", F.lit(start_month))
    start = F.col("_start").cast("int")
    last_month = start + yearly_cap * (F.col("Year") - (first_year - 1))
    months = started.withColumn("age_months", F.explode(F.sequence(start, last_month.cast("int"))))
    step = F.expr(f"cast(age_months div {MONTHS} - _start div {MONTHS} as int)")
    part = F.col("age_months") % MONTHS
    # Nobody past the whole age itself leaves no pensioners (NULL, as in ``oadr``);
    # nobody past the next one is a count of zero.
    older = F.coalesce(F.get("_above", step + 1), F.lit(0.0))
    pension = (MONTHS - part) * F.get("_above", step) + part * older
    work = MONTHS * F.col("_adults") - pension
    return months.select(
        *keys, "Rep", "Year", "age_months", F.try_divide(pension, work).alias("OADR")
    )


def oadr_grid(ratios: DataFrame, keys: Sequence[str] = (), level: float = 80, **options) -> DataFrame:
    """``keys, Year, age_months, Lo, Hi, OADR`` from ``candidate_ratios``."""
    return interval_summary(ratios, [*keys, "Year", "age_months"], level, **options)


def need_month(grid: DataFrame, target: float, statistic: str = "OADR", keys: Sequence[str] = ()):
    """Lowest candidate whose statistic is at or below the target; NULL if none."""
    met = F.col(statistic) <= F.lit(float(target))
    return grid.groupBy(*keys, "Year").agg(F.min(F.when(met, F.col("age_months"))).alias("need"))


def _quantile_at_most(prob: float) -> Column:
    """Whether a group's quantile is at or below its ``_target``, from aggregates that
    combine before the shuffle. With c values at or below the target, the quantile's
    two order statistics both lie below it or both above it, unless c equals the rank
    of the lower one; then they are the largest value below and the least above."""
    ratio, bound = F.col("OADR"), F.col("_target")
    position = (F.count("OADR") - 1) * F.lit(float(prob))
    rank, share = F.floor(position) + 1, position - F.floor(position)
    below = F.count_if(ratio <= bound)
    largest_below = F.max(F.when(ratio <= bound, ratio))
    least_above = F.min(F.when(ratio > bound, ratio))
    straddling = largest_below + share * (least_above - largest_below) <= F.max(bound)
    return (
        F.when(F.count("OADR") == 0, False)
        .when(below > rank, True)
        .when(below < rank, False)
        .otherwise(F.coalesce(straddling, F.lit(True)))
    )


def need_months(
    ratios: DataFrame,
    target: float | DataFrame,
    level: float = 80,
    keys: Sequence[str] = (),
    na_rm: bool = False,
) -> DataFrame:
    """``keys, Year, lower, optimal, upper``: the month each year needs for the
    interval's lower end, the mean and the upper end to meet the target, one for all or
    a table ``keys, target``.

    Gives what ``need_month`` reads off ``oadr_grid``, without computing any
    quantile, so nothing grows with the number of replicates."""
    probs = interval_probabilities(level)
    met = {
        "lower": _quantile_at_most(probs["Lo"]),
        "optimal": F.avg("OADR") <= F.max("_target"),
        "upper": _quantile_at_most(probs["Hi"]),
    }
    complete = F.lit(True) if na_rm else F.count_if(F.col("OADR").isNull()) == 0
    aimed = _with_value(ratios, target, "target", keys).withColumn("_target", F.col("target").cast("double"))
    by_month = aimed.groupBy(*keys, "Year", "age_months").agg(
        *[(complete & c).alias(name) for name, c in met.items()]
    )
    return by_month.groupBy(*keys, "Year").agg(
        *[F.min(F.when(F.col(name), F.col("age_months"))).alias(name) for name in met]
    )


def capped_schedule(
    need: DataFrame,
    start_month: int | DataFrame,
    first_year: int,
    last_year: int,
    keys: Sequence[str] = (),
    columns: Mapping[str, str] | None = None,
    yearly_cap: int = YEARLY_CAP,
) -> DataFrame:
    """``keys, Year`` and one schedule per entry of ``columns`` (output: need column).

    From one year to the next the age may stay or rise by up to ``yearly_cap``; it
    rises to what the year needs if that is in reach. NULL need means out of reach.
    Each year depends on the one before, so a key's years (one row each) are folded
    in order. A year without any simulated row makes the schedules of its key NULL, and
    raises where there are no keys."""
    columns = dict(columns or {"age_months": "need"})
    years = last_year - first_year + 1
    needed = list(dict.fromkeys(columns.values()))
    rows = F.array_sort(F.collect_list(F.struct("Year", *needed)))
    row_type = "array<struct<Year:int,%s>>" % ",".join(f"{c}:int" for c in needed)
    whole = F.size("_rows") == years
    lacking = F.raise_error(F.lit("a schedule year has no simulated population")).cast(row_type)
    checked = F.col("_rows") if keys else F.when(whole, F.col("_rows")).otherwise(lacking)
    all_years = F.sequence(F.lit(first_year), F.lit(last_year))
    unknown = F.array_repeat(F.lit(None).cast("int"), years)

    def fold(need_column):
        def step(ages, row):
            last = F.element_at(ages, -1)
            reach = last + yearly_cap
            wanted = F.coalesce(row[need_column], reach)
            return F.concat(ages, F.array(F.least(reach, F.greatest(last, wanted)).cast("int")))

        # A leading start value keeps element_at off an empty array.
        begin = F.array(F.col("_start").cast("int"))
        folded = F.slice(F.aggregate(F.col("_rows"), begin, step), 2, years)
        return F.when(whole, folded).otherwise(unknown)

    in_range = need.where(F.col("Year").between(first_year, last_year))
    typed = in_range.select(
        *keys,
        F.col("Year").cast("int").alias("Year"),
        *[F.col(c).cast("int").alias(c) for c in needed],
    )
    folded = (
        typed.groupBy(*keys)
        .agg(rows.alias("_rows"))
    )
    folded = (
        _with_value(folded, start_month, "start_month", keys)
        .withColumnRenamed("start_month", "_start")
        .withColumn("_rows", checked)
        .select(*keys, all_years.alias("Year"), *[fold(c).alias(name) for name, c in columns.items()])
    )
    zipped = F.explode(F.arrays_zip("Year", *columns)).alias("_z")
    return folded.select(*keys, zipped).select(*keys, "_z.Year", *[f"_z.{c}" for c in columns])


def schedule_band(
    sim: DataFrame,
    start_month: int | DataFrame,
    first_year: int,
    last_year: int,
    target: float | DataFrame,
    level: float = 80,
    keys: Sequence[str] = (),
    yearly_cap: int = YEARLY_CAP,
    na_rm: bool = False,
    **options,
) -> DataFrame:
    """``keys, Year, lower, optimal, upper`` schedules in months, from one pass. Start and
    target may be tables by key, as in ``candidate_ratios`` and ``need_months``; a key of
    the starts that has no candidates has NULL schedules, and no influence on others."""
    ratios = candidate_ratios(sim, start_month, first_year, last_year, keys, yearly_cap, na_rm, **options)
    need = need_months(ratios, target, level, keys, na_rm)
    bands = {name: name for name in ("lower", "optimal", "upper")}
    found = capped_schedule(need, start_month, first_year, last_year, keys, bands, yearly_cap)
    if not isinstance(start_month, DataFrame):
        return found
    spine = start_month.select(*keys).distinct().select(
        *keys, F.explode(F.sequence(F.lit(first_year), F.lit(last_year))).alias("Year")
    )
    return spine.join(found, [*keys, "Year"], "left").select(*keys, "Year", *bands)


def prepend_start(band: DataFrame, start: DataFrame, columns=("lower", "optimal", "upper")) -> DataFrame:
    """Years of the starting scheme before the searched ones, unchanged in each
    schedule, then the searched years."""
    first = band.agg(F.min("Year").alias("Year"))
    before = start.where(F.col("Year") < first.scalar()).select(
        "Year", *[F.col("age_months").alias(c) for c in columns]
    )
    return before.unionByName(band.select("Year", *columns))


def schedule_forecast_table(band: DataFrame, level: float = 80, keys: Sequence[str] = ()) -> DataFrame:
    """The band in years: ``keys, Year, mean, lower, upper, level``."""
    years = [
        (F.col(c) / float(MONTHS)).alias(name)
        for name, c in (("mean", "optimal"), ("lower", "lower"), ("upper", "upper"))
    ]
    return band.select(*keys, "Year", *years, F.lit(float(level)).alias("level"))


def compare_schemes(policy: DataFrame, band: DataFrame, first_year: int = 2005) -> DataFrame:
    """The optimal schedule ahead of the policies, as one policy table."""
    optimal = band.select(
        "Year",
        F.lit("Optimal").alias("Policy"),
        F.lit(1).alias("policy_rank"),
        F.col("optimal").cast("int").alias("age_months"),
    )
    others = policy.withColumn("policy_rank", F.col("policy_rank") + 1)
    return optimal.unionByName(others).where(F.col("Year") >= first_year)


# Series names, in reporting order.
BAND_NAMES = {"optimal": "Optimal", "lower": "Lower boundary", "upper": "Upper boundary"}


def oadr_under_band(sim: DataFrame, band: DataFrame, **options) -> DataFrame:
    """Ratio under the optimal, lower and upper schedules, as ``oadr_by_column``: for any
    years, also those before the searched ones."""
    return oadr_by_column(sim, band, BAND_NAMES, **options)


def searched_ratios(
    ratios: DataFrame, band: DataFrame, keys: Sequence[str] = (), level: float = 80, na_rm: bool = False
) -> DataFrame:
    """``oadr_under_band`` for the searched years, from the ``candidate_ratios`` that the
    band came from: its months are among them, so the simulation is read once."""
    arms = [
        F.struct(F.lit(name).alias("Policy"), F.lit(rank).alias("policy_rank"), F.col(c).alias("age_months"))
        for rank, (c, name) in enumerate(BAND_NAMES.items(), 1)
    ]
    chosen = band.select(*keys, "Year", F.explode(F.array(*arms)).alias("_a")).select(*keys, "Year", "_a.*")
    met = ratios.join(chosen, [*keys, "Year", "age_months"])
    return interval_summary(met, [*keys, "Policy", "policy_rank", "Year"], level, na_rm=na_rm)

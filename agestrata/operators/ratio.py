"""Old-age dependency ratio: pensioners per person of working age.

The pension age may fall inside a year of age; people of that age are then split
by birth month. Splitting is a weight of 0..12 months per row, so the ratio is one
aggregate with two sums: no window, no pivot and no dependence on row order. With
whole-number populations both sums are exact.
"""

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agestrata.functions.ages import GROUPS, MONTHS, pensioner_months, worker_months
from agestrata.functions.aggregates import total_where
from agestrata.functions.quantiles import group_quantiles, interval_probabilities
from agestrata.operators.policy import CAPS, checked_scheme
from agestrata.operators.reshape import union_labelled
from agestrata.schema import WORKING_AGE


def split_partial_age(aged: DataFrame) -> DataFrame:
    """Row form of the split: each row as its pensioners, its workers and its children;
    adds ``Group``. People of the pension age's whole year stay at that age, so no
    other row is needed. Without an age or a pension age the row stays whole, its group
    NULL.

    Use it to inspect rows. ``oadr`` gets the same ratio without them."""
    age, months, people = F.col("Age"), F.col("age_months"), F.col("Population")
    pension = pensioner_months(age, months)
    work = worker_months(age, months)
    arms = F.array(
        *[
            F.struct(F.lit(group).alias("Group"), share.alias("share"))
            for group, share in zip(GROUPS, (MONTHS - pension - work, work, pension))
        ]
    )
    unknown = F.array(F.struct(F.lit(None).cast("string").alias("Group"), F.lit(MONTHS).alias("share")))
    held = F.when(pension.isNull(), unknown).otherwise(F.filter(arms, lambda a: a["share"] > 0))
    parts = aged.withColumn("_part", F.explode(held))
    return (
        parts.withColumn("Group", F.col("_part.Group"))
        .withColumn("Population", people * F.col("_part.share") / MONTHS)
        .drop("_part")
    )


def _month_sums(df: DataFrame, keys: Sequence[str], na_rm: bool) -> DataFrame:
    age, months, people = F.col("Age"), F.col("age_months"), F.col("Population")
    pension, work = pensioner_months(age, months), worker_months(age, months)
    child = (age < WORKING_AGE) & (pension == 0)
    return df.groupBy(*keys).agg(
        total_where(child, people * MONTHS, na_rm).alias("_child"),
        total_where(work > 0, people * work, na_rm).alias("_work"),
        total_where(pension > 0, people * pension, na_rm).alias("_pension"),
    )


def group_population(
    aged: DataFrame, keys: Sequence[str] = ("Year",), na_rm: bool = False
) -> DataFrame:
    """``keys, Child, Workers, Pension`` from rows that carry ``age_months``. A group
    nobody is in is NULL."""
    return _month_sums(aged, keys, na_rm).select(
        *keys,
        *[
            (F.col(c) / MONTHS).alias(name)
            for c, name in zip(("_child", "_work", "_pension"), GROUPS)
        ],
    )


def _filled_sums(
    pop: DataFrame,
    schemes: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str],
    on: Sequence[str],
    fill_keys: Sequence[str],
    common: Sequence[Column],
    own: Callable[[Column], Sequence[Column]],
) -> DataFrame:
    """``keys, _i``, the sums ``common`` and those of ``own``, given the pension months of the
    i-th of ``columns``. Missing months are filled as ``attach_scheme`` fills them.

    Which age fills a row is known only once all rows are seen. A row that lacks an age is
    therefore summed under every age of the schemes, in months some tens of numbers, and
    the age that applies is picked among the sums: the population is read once. Rows that
    have their ages are summed once. Both the ages met and the sums come from one shuffle,
    which Spark reuses as both ask for all of its columns."""
    keys, on = list(keys), list(on)
    apart = list(dict.fromkeys([*keys, *on, *fill_keys]))
    ages = schemes.select(F.explode(F.array(*columns)).alias("_m")).agg(F.collect_set("_m").alias("_m")).scalar()
    known = F.array(F.lit(None).cast("int"))
    lacks = reduce(or_, [F.col(c).isNull() for c in columns])
    tried = (
        pop.join(schemes, on, "left")
        .withColumn("_ages", F.when(lacks, F.concat(known, ages)).otherwise(known))
        # An outer one, of lists that are never empty, asks for no filter on their size.
        .withColumn("_try", F.explode_outer("_ages"))
    )
    per_column = [own(F.coalesce(c, "_try")) for c in columns]
    names = [f"_s{n}" for n in range(len(per_column[0]))]
    shared = [f"_t{n}" for n in range(len(common))]
    sums = tried.groupBy(*apart, "_try").agg(
        *[s.alias(name) for s, name in zip(common, shared)],
        *[s.alias(f"{name}_{i}") for i, parts in enumerate(per_column) for s, name in zip(parts, names)],
        *[F.max(c).alias(c) for c in columns],
    )
    everything = F.struct(*sums.columns).alias("_all")
    has_group = reduce(and_, [F.col(k).isNotNull() for k in fill_keys], F.lit(True))
    lowest = F.struct(
        *[
            F.min(F.when(has_group & F.col("_try").isNull() & F.col(c).isNotNull(), F.struct(c, everything)))[c].alias(c)
            for c in columns
        ]
    ).alias("_low")
    if fill_keys:
        # A comparison that NULL passes keeps the optimizer from filtering one side only.
        low = sums.groupBy(*[F.col(k).alias(f"_of_{k}") for k in fill_keys]).agg(lowest)
        same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in fill_keys]
        sums = sums.join(low, reduce(and_, same), "left")
    else:
        sums = sums.withColumn("_low", sums.agg(lowest).scalar())
    arms = [
        F.struct(
            F.lit(i).alias("_i"),
            F.when(F.col(c).isNull(), F.col("_low")[c]).alias("_fill"),
            *[F.col(f"{name}_{i}").alias(name) for name in names],
        )
        for i, c in enumerate(columns)
    ]
    picked = (
        sums.select(*apart, "_try", *shared, F.explode(F.array(*arms)).alias("_a"))
        .where(F.col("_try").eqNullSafe(F.col("_a._fill")))
        .select(*apart, *shared, "_a.*")
    )
    if len(apart) == len(keys):
        return picked.select(*keys, "_i", *shared, *names)
    return picked.groupBy(*keys, "_i").agg(*[F.sum(c).alias(c) for c in [*shared, *names]])


def _ratio_sums(months: Column) -> list[Column]:
    age, people = F.col("Age"), F.col("Population")
    pension, work = pensioner_months(age, months), worker_months(age, months)
    return [
        F.sum(F.when(work > 0, people * work)),
        F.sum(F.when(pension > 0, people * pension)),
        F.count_if(people.isNull() & ((work > 0) | (pension > 0))),
    ]


def oadr(
    pop: DataFrame,
    scheme: DataFrame,
    keys: Sequence[str] = (),
    on: Sequence[str] = ("Year",),
    fill: bool = True,
    fill_keys: Sequence[str] = (),
    na_rm: bool = False,
) -> DataFrame:
    """``keys, Year, OADR``. NULL without workers or without pensioners.

    ``on`` joins the scheme; add ``Sex`` for a scheme that differs by sex."""
    by, checked = [*keys, "Year"], checked_scheme(scheme, on)
    if fill:
        sums = _filled_sums(pop, checked, ["age_months"], by, on, fill_keys, [], _ratio_sums)
    else:
        aged = pop.join(checked, list(on), "left")
        parts = _ratio_sums(F.col("age_months"))
        sums = aged.groupBy(*by).agg(*[s.alias(f"_s{n}") for n, s in enumerate(parts)])
    ratio = F.try_divide("_s1", "_s0")
    return sums.select(*by, (ratio if na_rm else F.when(F.col("_s2") == 0, ratio)).alias("OADR"))


def interval_summary(
    df: DataFrame,
    keys: Sequence[str],
    level: float = 80,
    value: str = "OADR",
    na_rm: bool = False,
) -> DataFrame:
    """``keys, Lo, Hi, <value>``: central interval and mean over replicates."""
    probs = interval_probabilities(level)
    return group_quantiles(df, keys, value, probs, value, na_rm)


def oadr_sim(
    sim: DataFrame,
    scheme: DataFrame,
    level: float = 80,
    keys: Sequence[str] = (),
    fill: bool = True,
    fill_keys: Sequence[str] = (),
    na_rm: bool = False,
) -> DataFrame:
    """Ratio per replicate, then interval and mean per ``keys, Year``. Replicates that
    cover different years may need ``fill_keys=["Rep"]``."""
    ratios = oadr(sim, scheme, [*keys, "Rep"], fill=fill, fill_keys=fill_keys, na_rm=na_rm)
    return interval_summary(ratios, [*keys, "Year"], level, na_rm=na_rm)


def oadr_rolling(rolling_sim: DataFrame, scheme: DataFrame, level: float = 80, **options):
    """As ``oadr_sim``, with the forecast origin ``id`` kept."""
    return oadr_sim(rolling_sim, scheme, level, keys=["id"], **options)


def oadr_by_column(
    sim: DataFrame,
    schemes: DataFrame,
    names: Mapping[str, str],
    level: float = 80,
    keys: Sequence[str] = (),
    on: Sequence[str] = ("Year",),
    fill: bool = True,
    fill_keys: Sequence[str] = (),
    na_rm: bool = False,
) -> DataFrame:
    """``keys, Policy, policy_rank, Year, Lo, Hi, OADR`` for schemes held side by side:
    ``schemes`` has one row per ``on`` and a column of pension months per entry of
    ``names`` (column: policy), in the order of their ranks.

    A population row is read, joined and grouped once for all policies: a policy adds
    one sum, since everyone of working age or over is either a worker or a pensioner.
    The shuffle carries one row per replicate and year. Pension ages must lie at or
    above working age. ``fill`` and ``fill_keys`` are as in ``attach_scheme``; without
    ``fill``, a year that a policy lacks is NULL."""
    on, columns = list(on), list(names)
    too_low = F.raise_error(F.lit("a pension age lies below working age")).cast("int")
    checked = schemes.select(
        *on,
        *[
            F.when(F.col(c) < WORKING_AGE * MONTHS, too_low).otherwise(F.col(c)).cast("int").alias(f"_m{i}")
            for i, c in enumerate(columns)
        ],
    )
    months = [f"_m{i}" for i in range(len(columns))]
    age, people = F.col("Age"), F.col("Population")
    adult = age >= WORKING_AGE
    adults = [F.sum(F.when(adult, people)), F.count_if(adult & people.isNull())]

    def pensions(m: Column) -> list[Column]:
        share = pensioner_months(age, m)
        return [F.sum(F.when(share > 0, people * share))]

    per_rep = [*keys, "Rep", "Year"]

    def ratio(pension: Column) -> Column:
        whole = F.col("_t0") if na_rm else F.when(F.col("_t1") == 0, F.col("_t0"))
        return F.try_divide(pension, MONTHS * whole - pension).alias("OADR")

    policies = [(F.lit(name).alias("Policy"), F.lit(rank).alias("policy_rank")) for rank, name in enumerate(names.values(), 1)]
    if fill:
        sums = _filled_sums(sim, checked, months, per_rep, on, fill_keys, adults, pensions)
        named = F.array(*[F.struct(*p) for p in policies])
        ratios = sums.select(*per_rep, named[F.col("_i")].alias("_a"), ratio(F.col("_s0"))).select(*per_rep, "_a.*", "OADR")
    else:
        sums = sim.join(checked, on, "left").groupBy(*per_rep).agg(
            *[s.alias(f"_t{n}") for n, s in enumerate(adults)],
            *[pensions(F.col(m))[0].alias(f"_p{i}") for i, m in enumerate(months)],
        )
        arms = [F.struct(*p, ratio(F.col(f"_p{i}"))) for i, p in enumerate(policies)]
        ratios = sums.select(*per_rep, F.explode(F.array(*arms)).alias("_a")).select(*per_rep, "_a.*")
    return interval_summary(ratios, [*keys, "Policy", "policy_rank", "Year"], level, na_rm=na_rm)


def oadr_by_policy(
    sim: DataFrame,
    policy: DataFrame,
    names: Sequence[str] = tuple(CAPS),
    on: Sequence[str] = ("Year",),
    **options,
) -> DataFrame:
    """``oadr_by_column`` for the named policies of a policy table."""
    columns = {f"_c{i}": name for i, name in enumerate(names)}
    twice = F.raise_error(F.lit("a policy has two pension ages for one year")).cast("int")
    side_by_side = policy.groupBy(*on).agg(
        *[
            F.when(F.count_if(F.col("Policy") == name) > 1, twice)
            .otherwise(F.max(F.when(F.col("Policy") == name, F.col("age_months"))))
            .alias(c)
            for c, name in columns.items()
        ]
    )
    return oadr_by_column(sim, side_by_side, columns, on=on, **options)


def oadr_under_schedules(
    sim: DataFrame, schedules: Mapping[str, DataFrame], **options
) -> DataFrame:
    """``oadr_by_policy`` for named schedules (``Year, age_months``)."""
    parts = {name: df.select("Year", "age_months") for name, df in schedules.items()}
    return oadr_by_policy(sim, union_labelled(parts, "Policy"), list(parts), **options)

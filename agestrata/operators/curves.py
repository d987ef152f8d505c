"""Curves over age: smoothing, pairing of sexes, centring.

A curve table is ``keys, Year, Age`` and a value; the sexes of one population are
rows of it until they are paired.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def log_rates(rates: DataFrame, floor: float | None = None) -> DataFrame:
    """``value = ln(rate)`` and ``weight``, the number of events behind it, which is
    the inverse of the variance of a log rate. Cells with no events have no
    logarithm: they are dropped, or raised to ``floor`` if one is given."""
    rate = F.col("rate")
    if floor is not None:
        rate = F.when(rate < floor, floor).otherwise(rate)
    return (
        rates.withColumn("value", F.when(rate > 0, F.ln(rate)))
        .withColumn("weight", rate * F.col("exposure"))
        .where(F.col("value").isNotNull())
    )


def smooth_by_age(
    curves: DataFrame,
    keys: Sequence[str],
    bandwidth: int = 5,
    value: str = "value",
    weight: str | None = "weight",
) -> DataFrame:
    """``keys, Year, Age, smooth``: local-linear fit with tricube weights over the
    ages within ``bandwidth``. Years are not mixed. A cell without value or weight adds
    to neither sum and is filled from its neighbours, if it has any.

    Each age reads its neighbours from window frames of one age each, so a curve is
    shuffled once and never multiplied, and a missing age is simply not there."""
    curve = Window.partitionBy(*keys, "Year").orderBy("Age")
    own = F.when(F.col(value).isNotNull(), F.col(weight) if weight else F.lit(1.0))
    cells = curves.withColumn("_c", F.struct(F.col(value).alias("y"), own.alias("w")))
    offsets = range(-bandwidth, bandwidth + 1)
    near = cells.select(
        *keys, "Year", "Age",
        *[F.first("_c").over(curve.rangeBetween(d, d)).alias(f"_n{d + bandwidth}") for d in offsets],
    )

    def moment(distance_power: int, of_value: bool) -> Column:
        terms = []
        for d in offsets:
            kernel = (1 - (abs(d) / (bandwidth + 1)) ** 3) ** 3 * float(d) ** distance_power
            cell = F.col(f"_n{d + bandwidth}")
            term = cell["w"] * cell["y"] if of_value else cell["w"]
            terms.append(F.coalesce(term * F.lit(kernel), F.lit(0.0)))
        out = terms[0]
        for t in terms[1:]:
            out = out + t
        return out

    sums = near.select(
        *keys, "Year", "Age",
        moment(0, False).alias("s0"), moment(1, False).alias("s1"), moment(2, False).alias("s2"),
        moment(0, True).alias("t0"), moment(1, True).alias("t1"),
    )
    s0, s1, s2, t0, t1 = (F.col(c) for c in ("s0", "s1", "s2", "t0", "t1"))
    spread = s0 * s2 - s1 * s1
    # One age in reach: no slope to fit. The bound allows for rounding in the sums.
    flat = spread <= F.lit(1e-12) * s0 * s2
    intercept = F.when(flat, F.try_divide(t0, s0)).otherwise(
        F.try_divide(s2 * t0 - s1 * t1, spread)
    )
    return sums.select(*keys, "Year", "Age", intercept.alias("smooth"))


def pair_cells(
    df: DataFrame,
    keys: Sequence[str],
    name: str,
    values: Sequence[str],
    value: str,
    drop_unpaired: bool = False,
) -> DataFrame:
    """Two labelled rows of a cell as two columns, by one aggregate instead of a
    self-join. A part that a cell lacks is NULL, unless such cells are to be dropped; a
    repeated row raises."""
    twice = F.raise_error(F.lit("two rows for one cell")).cast("double")
    out = []
    for v in values:
        cell = F.when(F.col(name) == v, F.col(value))
        out.append(F.when(F.count(cell) > 1, twice).otherwise(F.max(cell)).alias(v))
    paired = df.groupBy(*keys).agg(*out)
    if not drop_unpaired:
        return paired
    return paired.where(F.col(values[0]).isNotNull() & F.col(values[1]).isNotNull())


def pair_sexes(df: DataFrame, keys: Sequence[str] = (), value: str = "value") -> DataFrame:
    """``keys, Year, Age, Male, Female``."""
    return pair_cells(df, [*keys, "Year", "Age"], "Sex", ["Male", "Female"], value)


def product_ratio(df: DataFrame, keys: Sequence[str] = (), value: str = "value") -> DataFrame:
    """``product = sqrt(M F)`` and ``ratio = sqrt(M / F)``, for positive rates."""
    m, f = F.col("Male"), F.col("Female")
    return pair_sexes(df, keys, value).select(
        *keys, "Year", "Age",
        F.sqrt(m * f).alias("product"),
        F.sqrt(F.try_divide(m, f)).alias("ratio"),
    )


def sum_difference(df: DataFrame, keys: Sequence[str] = (), value: str = "value") -> DataFrame:
    """``half_sum`` and ``half_difference``, for measures that may be negative."""
    m, f = F.col("Male"), F.col("Female")
    return pair_sexes(df, keys, value).select(
        *keys, "Year", "Age",
        ((m + f) / 2).alias("half_sum"),
        ((m - f) / 2).alias("half_difference"),
    )


def _by_sex(df: DataFrame, keys: Sequence[str], male: Column, female: Column) -> DataFrame:
    arms = F.array(
        F.struct(F.lit("Male").alias("Sex"), male.alias("value")),
        F.struct(F.lit("Female").alias("Sex"), female.alias("value")),
    )
    return df.select(*keys, "Year", "Age", F.explode(arms).alias("_s")).select(
        *keys, "_s.Sex", "Year", "Age", "_s.value"
    )


def recombine_product_ratio(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Inverse of ``product_ratio``: ``keys, Sex, Year, Age, value``."""
    p, r = F.col("product"), F.col("ratio")
    return _by_sex(df, keys, p * r, F.try_divide(p, r))


def recombine_sum_difference(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Inverse of ``sum_difference``: ``keys, Sex, Year, Age, value``."""
    s, d = F.col("half_sum"), F.col("half_difference")
    return _by_sex(df, keys, s + d, s - d)


def mean_curve(curves: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """``keys, Age, mu``: average over years."""
    return curves.groupBy(*keys, "Age").agg(F.avg(value).alias("mu"))


def center_curves(curves: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """``keys, Year, Age, mu, centered``. One age of one series over its years is a
    window's worth of rows, so the table is read and shuffled once; averaging and
    joining back would do both twice."""
    years = Window.partitionBy(*keys, "Age")
    return curves.withColumn("mu", F.avg(value).over(years)).select(
        *keys, "Year", "Age", "mu", (F.col(value) - F.col("mu")).alias("centered")
    )

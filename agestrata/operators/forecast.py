"""Forecasts of component scores.

Two closed-form models per score series: a random walk with drift, and for
differences between the sexes a first-order autoregression that returns to its
mean, so that the sexes do not drift apart.
"""

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

HORIZON = 33
# The autoregressive slope stays inside this bound, so its path converges.
SLOPE_BOUND = 0.99


def drift_forecast(
    scores: DataFrame,
    keys: Sequence[str],
    horizon: int = HORIZON,
    value: str = "beta",
    level: float | None = None,
) -> DataFrame:
    """``keys, h, Year, <value>``: the last value plus h average yearly changes. With
    ``level`` also ``lower`` and ``upper``, the ends of the central interval."""
    return mixed_forecast(scores, keys, F.lit(False), horizon, value, level)


def mean_reverting_forecast(
    scores: DataFrame,
    keys: Sequence[str],
    horizon: int = HORIZON,
    value: str = "beta",
    level: float | None = None,
) -> DataFrame:
    """``keys, h, Year, <value>`` from ``y_t = c + s y_{t-1}`` by least squares, and
    ``lower`` and ``upper`` with ``level``. The window that pairs a year with the one
    before holds one score series."""
    return mixed_forecast(scores, keys, F.lit(True), horizon, value, level)


def mixed_forecast(
    scores: DataFrame,
    keys: Sequence[str],
    reverting: Column,
    horizon: int = HORIZON,
    value: str = "beta",
    level: float | None = None,
) -> DataFrame:
    """Both models from one pass over the scores: series that meet ``reverting``, a
    condition on ``keys``, return to their mean, the others follow their drift.

    With ``level`` (80 for the central 80 percent) also ``lower`` and ``upper``, normal
    intervals from the mean square ``v`` of the n one-year errors. A drift that is itself
    estimated gives ``v h (1 + h / n)``, with v over n - 1; an autoregression
    ``v (1 - s^2h) / (1 - s^2)``, with v over n - 2. Too few years for v give NULL."""
    yearly = Window.partitionBy(*keys).orderBy("Year").rangeBetween(-1, -1)
    paired = scores.withColumn("_prev", F.first(value).over(yearly))
    y, prev = F.col(value), F.col("_prev")
    step = y - prev
    fit = paired.groupBy(*keys).agg(
        F.regr_slope(y, prev).alias("_slope"),
        # Over the pairs that the slope is from.
        F.avg(F.when(prev.isNotNull(), y)).alias("_y"),
        F.avg(F.when(y.isNotNull(), prev)).alias("_x"),
        F.regr_sxx(y, prev).alias("_sxx"),
        F.regr_syy(y, prev).alias("_syy"),
        F.regr_sxy(y, prev).alias("_sxy"),
        F.count(step).cast("double").alias("_n"),
        F.sum(step).alias("_d"),
        F.sum(step * step).alias("_dd"),
        F.min("Year").alias("_first"),
        F.max("Year").alias("_last"),
        F.min_by(value, "Year").alias("_begin"),
        F.max_by(value, "Year").alias("_end"),
    )
    bounded = F.expr(
        f"""CASE WHEN _slope > {SLOPE_BOUND} THEN {SLOPE_BOUND}D
                 WHEN _slope < -{SLOPE_BOUND} THEN -{SLOPE_BOUND}D
                 WHEN _slope IS NOT NULL THEN _slope ELSE 0D END"""
    )
    path = F.expr("_level + pow(_s, h) * (_end - _level)")
    drift = F.expr("_end + h * coalesce(try_divide(_end - _begin, _last - _first), 0D)")
    ahead = (
        fit.withColumn("_s", bounded)
        .withColumn("_level", F.expr("coalesce((_y - _s * _x) / (1 - _s), _end)"))
        .withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
        .withColumn("_mean", F.when(reverting, path).otherwise(drift))
    )
    out = [*keys, "h", F.expr("cast(_last + h as int) AS Year"), F.col("_mean").alias(value)]
    if level is not None:
        # Errors of the fitted lines: y - c - s x with c from the means, and steps less
        # their average. greatest() keeps rounding from going below zero.
        of_path = F.expr(
            """try_divide(greatest(_syy - 2 * _s * _sxy + _s * _s * _sxx, 0D), _n - 2)
               * (1 - pow(_s, 2 * h)) / (1 - _s * _s)"""
        )
        of_drift = F.expr(
            "try_divide(greatest(_dd - _d * _d / nullif(_n, 0D), 0D), _n - 1) * h * (1 + h / nullif(_n, 0D))"
        )
        enough = F.when(reverting, F.col("_n") > 2).otherwise(F.col("_n") > 1)
        variance = F.when(enough, F.when(reverting, of_path).otherwise(of_drift))
        half = F.lit(NormalDist().inv_cdf(0.5 + level / 200)) * F.sqrt(variance)
        out += [(F.col("_mean") - half).alias("lower"), (F.col("_mean") + half).alias("upper")]
    return ahead.select(*out)

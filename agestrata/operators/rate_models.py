"""Forecasts of whole curves: components fitted, scores extended, curves rebuilt."""

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agestrata.operators.components import (
    COMPONENTS,
    component_scores,
    leading_components,
    reconstruct,
)
from agestrata.operators.curves import (
    center_curves,
    pair_cells,
    product_ratio,
    recombine_product_ratio,
    recombine_sum_difference,
    sum_difference,
)
from agestrata.operators.forecast import HORIZON, drift_forecast, mixed_forecast
from agestrata.operators.gaps import gappy_basis, gappy_fit, gappy_mean, gappy_scores


def _fit(curves: DataFrame, keys: Sequence[str], components: int, value: str, fill: bool):
    """Mean curve, loadings, scores, and a function that gives ``keys, Age, residual``."""
    if fill:
        fit = gappy_fit(curves, keys, components, value)
        mean = gappy_mean(fit, keys)
        left = mean.select(*keys, "Age", "residual")
        return mean.select(*keys, "Age", "mu"), gappy_basis(fit, keys), gappy_scores(fit, keys), lambda: left
    # Joins drop NULL keys anyway. Saying so here gives every branch the same input, so
    # that the curves are scanned and shuffled once.
    for k in [*keys, "Year", "Age"]:
        curves = curves.where(F.col(k).isNotNull())
    centered = center_curves(curves, keys, value)
    basis = leading_components(centered, keys, components)
    # The mean is the same in every year. Taking it by year keeps the rows behind it the
    # same as those of the scores, so that Spark reuses their shuffle.
    mu = centered.groupBy(*keys, "Age").agg(F.max_by("mu", "Year").alias("mu"))
    scores = component_scores(centered, basis, keys, components)
    return mu, basis, scores, lambda: residual_variance(centered, basis, scores, keys)


def residual_variance(centered: DataFrame, basis: DataFrame, scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, Age, residual``: variance over years of what the components leave of complete
    curves. Loadings are orthonormal, so it is the sum of squares less what each
    component has of it; nothing is rebuilt."""
    keys = list(keys)
    size = scores.groupBy(*keys, "j").agg(F.sum(F.col("beta") * F.col("beta")).alias("_size"))
    held = basis.join(size, [*keys, "j"]).groupBy(*keys, "Age").agg(
        F.sum(F.col("_size") * F.col("phi") * F.col("phi")).alias("_held")
    )
    whole = centered.groupBy(*keys, "Age").agg(
        F.sum(F.col("centered") * F.col("centered")).alias("_whole"), F.count("centered").alias("_n")
    )
    left = F.greatest(F.col("_whole") - F.col("_held"), F.lit(0.0))
    return whole.join(held, [*keys, "Age"]).select(*keys, "Age", F.try_divide(left, F.col("_n") - 1).alias("residual"))


def _width(level: float) -> float:
    return NormalDist().inv_cdf(0.5 + level / 200)


def curve_variance(
    residual: DataFrame, basis: DataFrame, ahead: DataFrame, keys: Sequence[str], components: int, level: float
) -> DataFrame:
    """``keys, Year, Age, variance`` of rebuilt curves: that of every score, from its interval
    of ``level``, times its squared loading, and the residual. It is linear in the scores'
    variances, so it is rebuilt as a curve is. NULL where a score has no interval."""
    half = (F.col("upper") - F.col("lower")) / (2 * _width(level))
    # What is not a number stays so through the sums.
    known = ahead.withColumn("beta", F.coalesce(half * half, F.lit(float("nan"))))
    squared = basis.withColumn("phi", F.col("phi") * F.col("phi"))
    whole = reconstruct(residual.withColumnRenamed("residual", "mu"), squared, known, keys, components)
    return whole.select(
        *keys, "Year", "Age", F.when(~F.isnan("fitted"), F.col("fitted")).alias("variance")
    )


def component_forecast(
    curves: DataFrame,
    keys: Sequence[str],
    horizon: int = HORIZON,
    components: int = COMPONENTS,
    value: str = "value",
    level: float | None = None,
    fill: bool = False,
) -> DataFrame:
    """``keys, Year, Age, fitted``: every score follows its drift. With ``level`` (80 for the
    central 80 percent) also ``lower`` and ``upper``, of complete curves: scores are taken
    as independent, and what the components leave varies as it did in the past. Ends of
    an interval of logs are those of the rates, exponentiated.

    A missing cell counts as its age's mean; with ``fill`` it is filled from the components
    (``gaps``), and intervals are for curves with gaps too."""
    mu, basis, scores, residual = _fit(curves, keys, components, value, fill)
    ahead = drift_forecast(scores, [*keys, "j"], horizon, level=level)
    fitted = reconstruct(mu, basis, ahead, keys, components)
    if level is None:
        return fitted
    spread = curve_variance(residual(), basis, ahead, keys, components, level)
    half = _width(level) * F.sqrt("variance")
    return fitted.join(spread, [*keys, "Year", "Age"]).select(
        *keys, "Year", "Age", "fitted", (F.col("fitted") - half).alias("lower"), (F.col("fitted") + half).alias("upper")
    )


def shared_and_apart(df: DataFrame, keys: Sequence[str], value: str, log: bool) -> DataFrame:
    """``keys, Year, Age, part, value``: what the sexes share and what sets them apart; cells
    of one sex alone are left out."""
    if log:
        paired = product_ratio(df, keys, value)
        shared, apart = F.ln("product"), F.ln("ratio")
    else:
        paired = sum_difference(df, keys, value)
        shared, apart = F.col("half_sum"), F.col("half_difference")
    parts = F.array(
        F.struct(F.lit("shared").alias("part"), shared.alias("value")),
        F.struct(F.lit("apart").alias("part"), apart.alias("value")),
    )
    return (
        paired.select(*keys, "Year", "Age", F.explode(parts).alias("_p"))
        .select(*keys, "Year", "Age", "_p.part", "_p.value")
        .where(F.col("value").isNotNull())
    )


def by_sex_again(fitted: DataFrame, keys: Sequence[str], log: bool) -> DataFrame:
    """``keys, Sex, Year, Age, value`` from both parts of each cell."""
    both = pair_cells(fitted, [*keys, "Year", "Age"], "part", ["shared", "apart"], "fitted")
    if log:
        both = both.select(
            *keys, "Year", "Age", F.exp("shared").alias("product"), F.exp("apart").alias("ratio")
        )
        return recombine_product_ratio(both, keys)
    both = both.withColumnsRenamed({"shared": "half_sum", "apart": "half_difference"})
    return recombine_sum_difference(both, keys)


def coherent_forecast(
    df: DataFrame,
    keys: Sequence[str] = (),
    horizon: int = HORIZON,
    components: int = COMPONENTS,
    value: str = "value",
    log: bool = True,
    level: float | None = None,
    fill: bool = False,
) -> DataFrame:
    """``keys, Sex, Year, Age, value`` forecast for both sexes without divergence.

    What the sexes share follows its drift; what sets them apart returns to its mean.
    With ``log`` that is the product and the ratio of positive rates, on the log scale;
    without, the half sum and half difference, for net migration. Both parts are one
    more key, so they are fitted together.

    With ``level`` also ``lower`` and ``upper``: a sex is the sum or the difference of the two
    parts, whose variances (``component_forecast``) add up; with ``log`` the ends are
    exponentiated. ``fill`` is that of ``component_forecast``, for each part."""
    curves = shared_and_apart(df, keys, value, log)
    keyed = [*keys, "part"]
    mu, basis, scores, residual = _fit(curves, keyed, components, "value", fill)
    ahead = mixed_forecast(scores, [*keyed, "j"], F.col("part") == "apart", horizon, level=level)
    fitted = reconstruct(mu, basis, ahead, keyed, components)
    by_sex = by_sex_again(fitted, keys, log)
    if level is None:
        return by_sex
    spread = curve_variance(residual(), basis, ahead, keyed, components, level)
    parts = pair_cells(spread, [*keys, "Year", "Age"], "part", ["shared", "apart"], "variance")
    half = _width(level) * F.sqrt(F.col("shared") + F.col("apart"))
    ends = (F.col("value") * F.exp(-half), F.col("value") * F.exp(half)) if log else (F.col("value") - half, F.col("value") + half)
    return by_sex.join(parts, [*keys, "Year", "Age"]).select(
        *keys, "Sex", "Year", "Age", "value", ends[0].alias("lower"), ends[1].alias("upper")
    )

"""Components of curves with missing cells.

``components`` counts a missing cell as its age's mean, which draws scores towards zero.
Here missing cells are filled from the components themselves, over and over, so that mean
curve, loadings and scores are those of the cells there are. Complete curves have the same
components either way.
"""

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agestrata.operators.components import (
    COMPONENTS,
    YEARS_PER_BLOCK,
    _cells,
    _key_types,
    _vectors,
    _with_keys,
)
from agestrata.operators.rolling import packed_years

# As in components: executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A fit ends when no filled cell moves by more than this share of the largest deviation from
# the mean curve, at the latest after so many rounds.
TOLERANCE, ROUNDS = 1e-11, 2_000


def pairwise_covariance(centered: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, Age_i, Age_j, years, moment``: the number of years in which both ages have a
    value, and the mean of the products of their centred values over these. Pairs that share no
    year have no row.

    As in ``curve_covariance``, a block of years is one matrix product; its sums travel as
    arrays, one row per age and block."""
    keys = list(keys)
    block = F.expr(f"cast(Year div {YEARS_PER_BLOCK} as int)")
    cells = centered.select(*keys, "Year", "Age", "centered", block.alias("_block"))

    def moments(group: pd.DataFrame) -> pd.DataFrame:
        values = group["centered"].to_numpy(float)
        x, _, ages, _ = _cells(group["Year"].to_numpy(), group["Age"].to_numpy(), values)
        known = ~np.isnan(x)
        x, known = np.where(known, x, 0.0), known.astype(np.int64)
        out = pd.DataFrame({"Age_i": ages, "_ages": [ages] * len(ages)})
        out["_years"], out["_sums"] = list(known.T @ known), list(x.T @ x)
        return _with_keys(out, group, keys)

    schema = _key_types(centered, keys) + "Age_i int, _ages array<int>, _years array<long>, _sums array<double>"
    blocks = cells.groupBy(*keys, "_block").applyInPandas(moments, schema)
    pairs = blocks.select(*keys, "Age_i", F.explode(F.arrays_zip("_ages", "_years", "_sums")).alias("_p"))
    return (
        pairs.groupBy(*keys, "Age_i", F.col("_p._ages").alias("Age_j"))
        .agg(F.sum("_p._years").alias("years"), F.sum("_p._sums").alias("_sum"))
        .where("years > 0")
        .select(*keys, "Age_i", "Age_j", "years", (F.col("_sum") / F.col("years")).alias("moment"))
    )


def _directions(x: np.ndarray):
    """Scores and loadings of all components of centred ``x``, largest first, from the smaller
    of its two square matrices, and their squared sizes."""
    turned = x.shape[0] < x.shape[1]
    values, vectors = np.linalg.eigh(x @ x.T if turned else x.T @ x)
    values, vectors = np.clip(values[::-1], 0.0, None), vectors[:, ::-1]
    return values, (vectors, vectors.T @ x) if turned else (x @ vectors, vectors.T)


def _refilled(x: np.ndarray, known: np.ndarray, filled: np.ndarray, base: np.ndarray, drawn: np.ndarray):
    """Each row of ``filled`` as a sum of the orthonormal columns of ``base``, whose
    coefficients are ``drawn`` times those of the row filled from that very sum: one small
    system of normal equations a row, weighted by what is known of it. Where nothing decides,
    coefficients stay as they are."""
    absent = np.einsum("ra,aj,ak->rjk", 1.0 - known, base, base, optimize=True)
    system = np.eye(len(drawn)) - drawn[:, None] * absent
    now = filled @ base
    right = (np.where(known, x, 0.0) @ base) * drawn - np.einsum("rjk,rk->rj", system, now)
    return (now + np.einsum("rjk,rk->rj", np.linalg.pinv(system, rcond=1e-10), right)) @ base.T


def _unit(columns: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(columns, axis=0)
    return np.divide(columns, size, out=np.zeros_like(columns), where=size > 0)


def _nearest(x: np.ndarray, components: int):
    """Mean curve, loadings, shares, scores and the fitted table of ``x``, years by ages with
    not-a-numbers, of which no row and no column is without a number.

    Missing cells start as their age's mean. Then the components of the filled table are
    taken, and missing cells filled from scores that suit the loadings, or in turn from means
    and loadings that suit the scores, until they stay. What fills is drawn in by the size of
    the largest component left out, so that noise is not carried into cells without a value;
    where the components leave nothing out, it is the plain least-squares fit. With as many
    components as there can be, missing cells keep their age's mean."""
    known = ~np.isnan(x)
    mu = np.nansum(x, axis=0) / known.sum(axis=0)
    filled = np.where(known, x, mu)
    scale = np.abs(filled - mu).max(initial=0.0) or 1.0
    rank = min(len(x) - 1, x.shape[1])
    kept = min(components, rank)
    constant = np.full((len(x), 1), len(x) ** -0.5)
    moved = [np.inf, np.inf]
    for turn in range(0 if known.all() or kept == rank else ROUNDS):
        mean = filled.mean(axis=0)
        size, (scores, loadings) = _directions(filled - mean)
        size, noise = size[:kept], size[kept]
        drawn = np.divide(size - noise, size, out=np.zeros(kept), where=size > 0)
        if turn % 2:
            base = np.hstack([constant, _unit(scores[:, :kept])])
            fitted = _refilled(x.T, known.T, filled.T, base, np.append(1.0, drawn)).T
        else:
            base = _unit(loadings[:kept].T)
            fitted = mean + _refilled(x - mean, known, filled - mean, base, drawn)
        moved = [moved[1], np.abs(np.where(known, 0.0, fitted - filled)).max()]
        filled = np.where(known, x, fitted)
        if max(moved) <= TOLERANCE * scale:
            break
    mean = filled.mean(axis=0)
    whole = filled - mean
    phi, share = _vectors(whole.T @ whole, kept)
    scores = whole @ phi
    return mean, phi, share, scores, mean + scores @ phi.T


def gappy_fit(
    curves: DataFrame, keys: Sequence[str], components: int = COMPONENTS, value: str = "value"
) -> DataFrame:
    """One row per series with all of its fit, for ``gappy_mean``, ``gappy_basis`` and
    ``gappy_scores``.

    A series enters one Python call as one row a year, whose number the calendar bounds. Cells
    that are absent, NULL or not a number are missing; a repeated or infinite one raises. A
    year without a value has no score, an age without one a NULL mean and loadings of 0, and a
    series without one no row. There are at most as many components as years less one."""
    keys = list(keys)

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        x, years, ages, _ = _cells(
            np.repeat(group["Year"].to_numpy(), group["_ages"].map(len)),
            np.concatenate(group["_ages"].to_list()),
            np.concatenate(group["_values"].to_list()).astype(float),
        )
        known = ~np.isnan(x)
        rows, columns = known.any(axis=1), known.any(axis=0)
        if not rows.any():
            return pd.DataFrame(columns=[*keys, *names])
        mu, phi, share, scores, fitted = _nearest(x[np.ix_(rows, columns)], components)
        n = known.sum(axis=0)[columns]
        square = np.nansum((x[np.ix_(rows, columns)] - fitted) ** 2, axis=0)
        means, residual = np.full(len(ages), None), np.full(len(ages), None)
        loadings = np.zeros((phi.shape[1], len(ages)))
        means[columns], loadings[:, columns] = mu, phi.T
        residual[columns] = [s / (k - 1) if k > 1 else None for s, k in zip(square, n)]
        out = pd.DataFrame({
            "_ages": [ages], "_mu": [means], "_residual": [residual],
            "_phi": [list(loadings)], "_share": [share], "_years": [years[rows]], "_beta": [list(scores.T)],
        })
        return _with_keys(out, group, keys)

    shape = {
        "_ages": "array<int>", "_mu": "array<double>", "_residual": "array<double>",
        "_phi": "array<array<double>>", "_share": "array<double>", "_years": "array<int>",
        "_beta": "array<array<double>>",
    }
    names = list(shape)
    packed = packed_years(curves, keys, value)
    schema = _key_types(packed, keys) + ", ".join(f"{k} {v}" for k, v in shape.items())
    fits = packed.groupBy(*keys).applyInPandas(fit, schema)
    # A shuffle of one row per series. Those who read the same columns of the fit share it,
    # so mean, loadings and scores are fitted once each and not for every use of them.
    return fits.repartition(*keys) if keys else fits.repartition(1)


def gappy_mean(fit: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, Age, mu, residual``: the mean over all years, filled cells included, and the
    variance of what the components leave of the cells there are."""
    cells = fit.select(*keys, F.explode(F.arrays_zip("_ages", "_mu", "_residual")).alias("_c"))
    return cells.select(
        *keys, F.col("_c._ages").alias("Age"), F.col("_c._mu").alias("mu"), F.col("_c._residual").alias("residual")
    )


def _by_component(fit: DataFrame, keys: Sequence[str], labels: str, values: str, also: Sequence[str] = ()) -> DataFrame:
    each = fit.select(*keys, *also, labels, F.posexplode(values).alias("_j", "_v"))
    return each.withColumn("j", (F.col("_j") + 1).cast("int")).select(
        *keys, "j", *[F.col(c)[F.col("_j")].alias(c) for c in also],
        F.explode(F.arrays_zip(F.col(labels).alias("label"), F.col("_v").alias("value"))).alias("_c"),
    )


def gappy_basis(fit: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, j, Age, phi, share``, as ``components.leading_components`` has it; ``share`` is
    the component's part of the variation of the filled table."""
    cells = _by_component(fit, keys, "_ages", "_phi", ["_share"])
    return cells.select(
        *keys, "j", F.col("_c.label").alias("Age"), F.col("_c.value").alias("phi"), F.col("_share").alias("share")
    )


def gappy_scores(fit: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, Year, j, beta``."""
    cells = _by_component(fit, keys, "_years", "_beta")
    return cells.select(*keys, F.col("_c.label").alias("Year"), "j", F.col("_c.value").alias("beta"))

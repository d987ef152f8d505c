"""Refits of curves at every origin of a rolling evaluation.

Training years of neighbouring origins overlap almost wholly. A series is therefore packed
into one row a year and read once, and second moments move along with the window: a year
that enters is added, one that leaves is taken away. No row is copied for an origin.
"""

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agestrata.operators.components import COMPONENTS, _cells, _key_types, _vectors, _with_keys
from agestrata.operators.forecast import SLOPE_BOUND

# As in components: executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def packed_years(curves: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """``keys, Year, _ages, _values``: a year of a series is one row. Rows without a key, a
    year or an age are left out."""
    for k in [*keys, "Year", "Age"]:
        curves = curves.where(F.col(k).isNotNull())
    # By series, so that years and series are both gathered with this one shuffle.
    if keys:
        curves = curves.repartition(*keys)
    cells = F.collect_list(F.struct("Age", F.col(value).cast("double").alias("value")))
    packed = curves.groupBy(*keys, "Year").agg(cells.alias("_c"))
    return packed.select(*keys, "Year", F.col("_c.Age").alias("_ages"), F.col("_c.value").alias("_values"))


class _Moments:
    """Moments of a moving window of years: products, sums and counts over the years in which
    both ages have a value. Values are taken from the mean of all years, so that what is
    left after a subtraction is no small difference of large numbers."""

    def __init__(self, x: np.ndarray):
        self.known = ~np.isnan(x)
        some = np.maximum(self.known.sum(axis=0), 1)
        self.shift = np.where(self.known, x, 0.0).sum(axis=0) / some
        self.x = np.where(self.known, x - self.shift, 0.0)
        self._clear(0)

    def _clear(self, at: int) -> None:
        ages = self.x.shape[1]
        self.first = self.last = at
        self.products, self.sums, self.counts = (np.zeros((ages, ages)) for _ in range(3))

    def _add(self, years: slice, sign: int) -> None:
        x, p = self.x[years], self.known[years].astype(float)
        self.products += sign * (x.T @ x)
        self.sums += sign * (x.T @ p)
        self.counts += sign * (p.T @ p)

    def move(self, first: int, last: int):
        """Means and centred second moments of years ``first`` up to ``last``, that not in it."""
        if first < self.first or last < self.last or first >= self.last:
            self._clear(first)
        self._add(slice(self.last, last), 1)
        self._add(slice(self.first, first), -1)
        self.first, self.last = first, last
        n = np.diag(self.counts)
        mu = np.divide(np.diag(self.sums), n, out=np.zeros(len(n)), where=n > 0)
        cross = self.sums * mu
        return mu, self.products - cross - cross.T + np.outer(mu, mu) * self.counts, n > 0


def _ahead(years: np.ndarray, beta: np.ndarray, horizon: int, reverting: bool) -> np.ndarray:
    """What ``forecast.mixed_forecast`` gives for each column of ``beta``."""
    h = np.arange(1, horizon + 1)[:, None]
    begin, end = beta[0], beta[-1]
    if not reverting:
        return end + h * ((end - begin) / max(years[-1] - years[0], 1))
    pairs = np.flatnonzero(np.diff(years) == 1)
    if not len(pairs):
        return np.repeat(end[None], horizon, axis=0)
    x, y = beta[pairs], beta[pairs + 1]
    dx, dy = x - x.mean(axis=0), y - y.mean(axis=0)
    sxx = (dx * dx).sum(axis=0)
    slope = np.divide((dx * dy).sum(axis=0), sxx, out=np.zeros(len(sxx)), where=sxx > 0)
    slope = np.clip(slope, -SLOPE_BOUND, SLOPE_BOUND)
    level = (y.mean(axis=0) - slope * x.mean(axis=0)) / (1 - slope)
    return level + slope**h * (end - level)


def rolling_fits(
    curves: DataFrame,
    folds: DataFrame,
    keys: Sequence[str],
    horizon: int,
    components: int = COMPONENTS,
    value: str = "value",
    reverting: Column | None = None,
) -> DataFrame:
    """``keys, id, train_to, Year, Age, fitted``: for each origin what ``component_forecast``
    gives of its training years, or, for series that meet ``reverting`` (a condition on
    ``keys``), the same with scores that return to their mean.

    One Python call per series gets one row a year, whose number the calendar bounds. As
    there, a cell without a value counts as its age's mean, an age without any value in
    training is NULL, and origins without a value have no rows."""
    keys = list(keys)
    origins = folds.agg(F.sort_array(F.collect_list(F.struct("train_from", "train_to", "id")))).scalar()
    years = packed_years(curves, keys, value).withColumn("_origins", origins)
    for c in ("train_from", "train_to", "id"):
        years = years.withColumn(f"_{c}", F.col(f"_origins.{c}"))
    turns = F.lit(False) if reverting is None else F.coalesce(reverting, F.lit(False))
    years = years.drop("_origins").withColumn("_reverting", turns)

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        sizes = group["_ages"].map(len)
        x, labels, ages, rows = _cells(
            np.repeat(group["Year"].to_numpy(), sizes),
            np.concatenate(group["_ages"].to_list()),
            np.concatenate(group["_values"].to_list()).astype(float),
        )
        moments, out, first = _Moments(x), [], group.iloc[0]
        for start, end, number in zip(first["_train_from"], first["_train_to"], first["_id"]):
            lo, hi = np.searchsorted(labels, [start, end + 1])
            if not moments.known[lo:hi].any():
                continue
            mu, matrix, known = moments.move(lo, hi)
            at = np.flatnonzero(rows[lo:hi].any(axis=0))
            phi, _ = _vectors(matrix[np.ix_(at, at)], components)
            # Years without a value have no score.
            held = lo + np.flatnonzero(moments.known[lo:hi].any(axis=1))
            centered = np.where(moments.known[held], moments.x[held] - mu, 0.0)[:, at]
            scores = _ahead(labels[held], centered @ phi, horizon, bool(first["_reverting"]))
            fitted = (moments.shift + mu)[at] + scores @ phi.T
            fitted = np.where(known[at], fitted, None)
            last = int(labels[held[-1]])
            out += [(number, end, last + h, ages[at], fitted[h - 1]) for h in range(1, horizon + 1)]
        found = pd.DataFrame(out, columns=["id", "train_to", "Year", "_ages", "_fitted"])
        return _with_keys(found, group, keys)

    schema = _key_types(years, keys) + "id int, train_to int, Year int, _ages array<int>, _fitted array<double>"
    cells = years.groupBy(*keys).applyInPandas(fit, schema)
    return cells.select(
        *keys, "id", "train_to", "Year", F.explode(F.arrays_zip("_ages", "_fitted")).alias("_c")
    ).select(*keys, "id", "train_to", "Year", F.col("_c._ages").alias("Age"), F.col("_c._fitted").alias("fitted"))

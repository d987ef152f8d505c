"""Principal components of curves over age.

The heavy step, second moments over years, is split into blocks of years and
summed by Spark; only one small symmetric matrix per series (ages by ages) is
handed to numpy.
"""

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The functions below reach the tasks by value, so executors need numpy and pandas but
# not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

COMPONENTS = 6
# Rows handed to one Python call: at most this many years of one series.
YEARS_PER_BLOCK = 256


def _key_types(df: DataFrame, keys: Sequence[str]) -> str:
    return "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)


def _cells(rows: np.ndarray, columns: np.ndarray, values: np.ndarray):
    """Long cells as a dense matrix, absent and NULL ones not numbers; the sorted labels of
    its rows and columns; and which cells there are. A cell that comes twice, or is
    infinite, raises."""
    row_labels, i = np.unique(rows, return_inverse=True)
    labels, j = np.unique(columns, return_inverse=True)
    if len(np.unique(i * len(labels) + j)) < len(values):
        raise ValueError("two rows for one cell")
    if np.isinf(values).any():
        raise ValueError("an infinite cell")
    x, there = np.full((len(row_labels), len(labels)), np.nan), np.zeros((len(row_labels), len(labels)), bool)
    x[i, j], there[i, j] = values, True
    return x, row_labels, labels, there


def _matrix(rows: pd.Series, columns: pd.Series, values: pd.Series):
    """``_cells`` with zeros for absent and NULL cells, and the sorted column labels."""
    x, _, labels, _ = _cells(rows.to_numpy(), columns.to_numpy(), values.to_numpy(float))
    return np.nan_to_num(x, copy=False, nan=0.0), labels


def _with_keys(out: pd.DataFrame, group: pd.DataFrame, keys: Sequence[str]) -> pd.DataFrame:
    for k in reversed(keys):
        out.insert(0, k, group[k].iloc[0])
    return out


BASIS = "j int, Age int, phi double, share double"


def _vectors(matrix: np.ndarray, components: int):
    """Leading eigenvectors of one matrix as columns, and their shares; the largest loading
    is positive."""
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(values)[::-1][:components]
    whole = np.clip(values, 0.0, None).sum()
    phi = vectors[:, order]
    phi = phi * np.sign(phi[np.abs(phi).argmax(axis=0), np.arange(phi.shape[1])])
    return phi, np.clip(values[order], 0.0, None) / whole if whole > 0 else np.zeros(len(order))


def _leading(matrix: np.ndarray, ages: np.ndarray, components: int) -> pd.DataFrame:
    """``_vectors`` as rows."""
    phi, share = _vectors(matrix, components)
    kept = len(share)
    return pd.DataFrame(
        {
            "j": np.repeat(np.arange(1, kept + 1), len(ages)),
            "Age": np.tile(ages, kept),
            "phi": phi.T.ravel(),
            "share": np.repeat(share, len(ages)),
        }
    )


def curve_covariance(centered: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, Age_i, Age_j, moment``: sum over years of products of centred values.

    A block of years becomes a years-by-ages matrix and one matrix product, so pairs
    of ages are formed once per block instead of once per year."""
    keys = list(keys)
    block = F.expr(f"cast(Year div {YEARS_PER_BLOCK} as int)")
    # Age and Year only index the matrix, a missing cell adds nothing.
    cells = centered.select(*keys, "Year", "Age", "centered", block.alias("_block"))

    def moments(group: pd.DataFrame) -> pd.DataFrame:
        x, ages = _matrix(group["Year"], group["Age"], group["centered"])
        out = pd.DataFrame(
            {"Age_i": ages, "_ages": [ages] * len(ages), "_moments": list(x.T @ x)}
        )
        return _with_keys(out, group, keys)

    # A row of the matrix travels as two arrays and is expanded by Spark.
    schema = _key_types(centered, keys) + "Age_i int, _ages array<int>, _moments array<double>"
    partial = cells.groupBy(*keys, "_block").applyInPandas(moments, schema)
    pairs = partial.select(
        *keys, "Age_i", F.explode(F.arrays_zip("_ages", "_moments")).alias("_p")
    )
    return pairs.groupBy(*keys, "Age_i", F.col("_p._ages").alias("Age_j")).agg(
        F.sum("_p._moments").alias("moment")
    )


def principal_components(
    covariance: DataFrame, keys: Sequence[str], components: int = COMPONENTS
) -> DataFrame:
    """``keys, j, Age, phi, share`` for the leading components; ``share`` is the
    component's part of the total variation. The loading of largest size is positive."""
    keys = list(keys)

    def decompose(group: pd.DataFrame) -> pd.DataFrame:
        matrix, ages = _matrix(group["Age_i"], group["Age_j"], group["moment"])
        return _with_keys(_leading(matrix, ages, components), group, keys)

    return covariance.groupBy(*keys).applyInPandas(decompose, _key_types(covariance, keys) + BASIS)


def leading_components(
    centered: DataFrame, keys: Sequence[str], components: int = COMPONENTS
) -> DataFrame:
    """``principal_components`` of centred curves, without the matrix as rows: a block of
    years sends its moments as one packed triangle, and one call per series adds them up
    and decomposes the sum."""
    keys = list(keys)
    block = F.expr(f"cast(Year div {YEARS_PER_BLOCK} as int)")
    cells = centered.select(*keys, "Year", "Age", "centered", block.alias("_block"))

    def moments(group: pd.DataFrame) -> pd.DataFrame:
        x, ages = _matrix(group["Year"], group["Age"], group["centered"])
        packed = (x.T @ x)[np.triu_indices(len(ages))]
        return _with_keys(pd.DataFrame({"_ages": [ages], "_packed": [packed]}), group, keys)

    def decompose(group: pd.DataFrame) -> pd.DataFrame:
        labels = np.unique(np.concatenate(group["_ages"].to_list()))
        matrix = np.zeros((len(labels), len(labels)))
        for ages, packed in zip(group["_ages"], group["_packed"]):
            at = np.searchsorted(labels, ages)
            i, j = np.triu_indices(len(ages))
            matrix[at[i], at[j]] += packed
        upper = np.triu(matrix, 1)
        return _with_keys(_leading(matrix + upper.T, labels, components), group, keys)

    types = _key_types(centered, keys)
    blocks = cells.groupBy(*keys, "_block").applyInPandas(
        moments, types + "_ages array<int>, _packed array<double>"
    )
    return blocks.groupBy(*keys).applyInPandas(decompose, types + BASIS)


def variance_shares(basis: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, j, share``."""
    return basis.groupBy(*keys, "j").agg(F.max("share").alias("share"))


def _wide_basis(basis: DataFrame, keys: Sequence[str], components: int) -> DataFrame:
    loading = [F.max(F.when(F.col("j") == j, F.col("phi"))) for j in range(1, components + 1)]
    return basis.groupBy(*keys, "Age").agg(F.array(*loading).alias("_phi"))


def component_scores(
    centered: DataFrame, basis: DataFrame, keys: Sequence[str], components: int = COMPONENTS
) -> DataFrame:
    """``keys, Year, j, beta``. A row meets its age's loadings once, as an array, and
    all scores are sums of one aggregate."""
    sums = [F.sum(F.col("centered") * F.col("_phi")[j]) for j in range(components)]
    return (
        centered.join(_wide_basis(basis, keys, components), [*keys, "Age"])
        .groupBy(*keys, "Year")
        .agg(F.array(*sums).alias("_beta"))
        .select(*keys, "Year", F.posexplode("_beta").alias("_j", "beta"))
        .where(F.col("beta").isNotNull())
        .select(*keys, "Year", (F.col("_j") + 1).cast("int").alias("j"), "beta")
    )


def reconstruct(
    mu: DataFrame,
    basis: DataFrame,
    scores: DataFrame,
    keys: Sequence[str],
    components: int = COMPONENTS,
) -> DataFrame:
    """``keys, Year, Age, fitted``: ``mu + sum_j beta_j phi_j`` for the years of
    ``scores``, observed or forecast.

    The curves of a series (ages by components) form one row, so the join brings each
    year one partner and the ages are expanded after it."""
    loadings = mu.join(_wide_basis(basis, keys, components), [*keys, "Age"])
    curves = loadings.groupBy(*keys).agg(
        F.collect_list(F.struct("Age", "mu", F.col("_phi").alias("phi"))).alias("_ages")
    )
    beta = [F.max(F.when(F.col("j") == j, F.col("beta"))) for j in range(1, components + 1)]
    years = scores.groupBy(*keys, "Year").agg(F.array(*beta).alias("_beta"))
    cells = years.join(curves, list(keys)).select(
        *keys, "Year", "_beta", F.explode("_ages").alias("_a")
    )
    fitted = F.col("_a.mu")
    for j in range(components):
        fitted = fitted + F.coalesce(F.col("_beta")[j] * F.col("_a.phi")[j], F.lit(0.0))
    return cells.select(*keys, "Year", "_a.Age", fitted.alias("fitted"))

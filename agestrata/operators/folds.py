"""Rolling-origin evaluation."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from agestrata.functions.aggregates import mean_absolute, root_mean_square
from agestrata.operators.components import COMPONENTS
from agestrata.operators.rate_models import by_sex_again, shared_and_apart
from agestrata.operators.rolling import rolling_fits


def fold_table(years: DataFrame, train: int, horizon: int) -> DataFrame:
    """``id, train_from, train_to, base_year, test_from, test_to``, one row per origin.

    The years present span ``t`` years; there are ``t - train - horizon`` origins.
    The starting population of an origin is that of the year after its training."""
    span = years.agg(F.min("Year").alias("_first"), F.max("Year").alias("_last"))
    count = F.col("_last") - F.col("_first") + 1 - train - horizon
    ids = F.when(count >= 1, F.sequence(F.lit(1), count.cast("int")))
    start = F.col("_first") - 1 + F.col("id")
    return span.withColumn("id", F.explode(ids)).select(
        F.col("id").cast("int").alias("id"),
        start.cast("int").alias("train_from"),
        (start + train - 1).cast("int").alias("train_to"),
        (start + train).cast("int").alias("base_year"),
        (start + train).cast("int").alias("test_from"),
        (start + train + horizon - 1).cast("int").alias("test_to"),
    )


def fold_years(folds: DataFrame, part: str) -> DataFrame:
    """``id, train_to, Year`` for the ``train`` or ``test`` years of each origin. Joining on
    Year is then an equi-join, not a range join."""
    return folds.select("id", "train_to", F.explode(F.sequence(f"{part}_from", f"{part}_to")).alias("Year"))


def horizon_number(rolling: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    """Adds ``h``: 1 for the first year of each origin. One window per origin, over
    its forecast years only."""
    return rolling.withColumn(
        "h", F.row_number().over(Window.partitionBy(*keys).orderBy("Year"))
    )


def attach_actual(
    forecast: DataFrame, actual: DataFrame, on: Sequence[str] = ("Year",), value: str = "OADR"
) -> DataFrame:
    """``Forecast`` beside the observed ``Actual``, and ``error``; years without an
    observation keep NULL."""
    observed = actual.select(*on, F.col(value).alias("Actual"))
    return (
        forecast.withColumnRenamed(value, "Forecast")
        .join(observed, list(on), "left")
        .withColumn("error", F.col("Actual") - F.col("Forecast"))
    )


def horizon_rmse(errors: DataFrame, keys: Sequence[str] = ("h",), na_rm: bool = False) -> DataFrame:
    return errors.groupBy(*keys).agg(root_mean_square(F.col("error"), na_rm).alias("RMSE"))


def horizon_mae(errors: DataFrame, keys: Sequence[str] = ("h",), na_rm: bool = False) -> DataFrame:
    return errors.groupBy(*keys).agg(mean_absolute(F.col("error"), na_rm).alias("MAE"))


def backtest_errors(rolling_oadr: DataFrame, history: DataFrame) -> DataFrame:
    """Forecast errors by origin and horizon, from ``oadr_rolling`` and ``oadr``."""
    return attach_actual(horizon_number(rolling_oadr).select("id", "Year", "h", "OADR"), history)


def backtest_rmse(rolling_oadr: DataFrame, history: DataFrame, na_rm: bool = False) -> DataFrame:
    return horizon_rmse(backtest_errors(rolling_oadr, history), na_rm=na_rm)


def rolling_rate_forecast(
    curves: DataFrame,
    folds: DataFrame,
    keys: Sequence[str],
    horizon: int,
    components: int = COMPONENTS,
) -> DataFrame:
    """``keys, id, h, Year, Age, fitted``: for each origin, components of the training
    curves, scores extended with drift, curves rebuilt, all origins in one job that reads
    every cell once (``rolling.rolling_fits``)."""
    fitted = rolling_fits(curves, folds, keys, horizon, components)
    ahead = (F.col("Year") - F.col("train_to")).cast("int").alias("h")
    return fitted.select(*keys, "id", ahead, "Year", "Age", "fitted")


def rolling_rate_backtest(
    curves: DataFrame,
    folds: DataFrame,
    keys: Sequence[str],
    horizon: int,
    components: int = COMPONENTS,
) -> DataFrame:
    """``keys, h, RMSE`` of rolling forecasts over ages and origins."""
    forecast = rolling_rate_forecast(curves, folds, keys, horizon, components)
    actual = curves.select(*keys, "Year", "Age", "value")
    errors = attach_actual(
        forecast.withColumnRenamed("fitted", "value"), actual, [*keys, "Year", "Age"], "value"
    )
    return horizon_rmse(errors, [*keys, "h"])


def rolling_coherent_forecast(
    df: DataFrame,
    folds: DataFrame,
    keys: Sequence[str],
    horizon: int,
    components: int = COMPONENTS,
    value: str = "value",
    log: bool = True,
) -> DataFrame:
    """``keys, id, h, Sex, Year, Age, value``: ``coherent_forecast`` of both sexes from the
    training years of each origin, all origins in one job."""
    curves = shared_and_apart(df, keys, value, log)
    parted = [*keys, "part"]
    fitted = rolling_fits(curves, folds, parted, horizon, components, reverting=F.col("part") == "apart")
    by_sex = by_sex_again(fitted, [*keys, "id", "train_to"], log)
    ahead = (F.col("Year") - F.col("train_to")).cast("int").alias("h")
    return by_sex.select(*keys, "id", ahead, "Sex", "Year", "Age", "value")


def rolling_coherent_backtest(
    df: DataFrame,
    folds: DataFrame,
    keys: Sequence[str],
    horizon: int,
    components: int = COMPONENTS,
    value: str = "value",
    log: bool = True,
) -> DataFrame:
    """``keys, Sex, h, RMSE`` of those forecasts over ages and origins, on the scale of
    ``value``."""
    forecast = rolling_coherent_forecast(df, folds, keys, horizon, components, value, log)
    cell = [*keys, "Sex", "Year", "Age"]
    actual = df.select(*cell, F.col(value).alias("value"))
    return horizon_rmse(attach_actual(forecast, actual, cell, "value"), [*keys, "Sex", "h"])

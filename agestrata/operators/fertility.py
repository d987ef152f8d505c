"""Joining a new fertility file to an older fertility history."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agestrata.operators.accounting import counts_from_rate
from agestrata.operators.filters import fertility_slice
from agestrata.operators.reshape import append_after

# Measures of the published file, births being in thousands.
BIRTHS_MEASURE = "Births"
FEMALES_MEASURE = "Female population"
BIRTHS_UNIT = 1000.0


def births_and_pop(
    sliced: DataFrame, keys: Sequence[str] = ("Year", "Age"), births_unit: float = BIRTHS_UNIT
) -> DataFrame:
    """``keys, births, females``: both measures of a cell from one aggregate. A cell
    with two rows of one measure raises."""
    twice = F.raise_error(F.lit("two rows for one cell")).cast("double")

    def cell(measure):
        value = F.when(F.col("Measure") == measure, F.col("Value"))
        return F.when(F.count(value) > 1, twice).otherwise(F.max(value))

    return (
        sliced.where(F.col("Measure").isin(BIRTHS_MEASURE, FEMALES_MEASURE))
        .groupBy(*keys)
        .agg((cell(BIRTHS_MEASURE) * births_unit).alias("births"), cell(FEMALES_MEASURE).alias("females"))
    )


def merge_fertility(history: DataFrame, file: DataFrame, region: str, births_unit: float = BIRTHS_UNIT) -> DataFrame:
    """``Year, Age, rate, exposure``: the history up to the first year of the file,
    then the file, with rates recomputed from births and females."""
    new = births_and_pop(fertility_slice(file, region), births_unit=births_unit)
    old = counts_from_rate(history).select(
        "Year", "Age", F.col("events").alias("births"), F.col("exposure").alias("females")
    )
    merged = append_after(old, new)
    return merged.select(
        "Year",
        "Age",
        F.try_divide("births", "females").alias("rate"),
        F.col("females").alias("exposure"),
    )

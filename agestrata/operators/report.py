"""Report layouts. Inputs are finished schedules: one row per year."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agestrata.functions.ages import age_label


def schedule_report(schedule: DataFrame, columns: Sequence[str] = ("age_months",)) -> DataFrame:
    """``Year`` and a label such as ``67Y+6M`` per column."""
    return schedule.select("Year", *[age_label(F.col(c)).alias(c) for c in columns])


def side_by_side(
    report: DataFrame,
    columns: Sequence[str],
    first_year: int,
    last_year: int,
    block: int = 10,
) -> DataFrame:
    """Blocks of years next to each other: ``row, Year_1, <columns>_1, Year_2, ...``."""
    offset = F.col("Year") - first_year
    cells = report.where(F.col("Year").between(first_year, last_year)).select(
        (offset % block).cast("int").alias("row"),
        F.floor(offset / block).cast("int").alias("_block"),
        "Year",
        *columns,
    )
    blocks = (last_year - first_year) // block + 1
    out = [
        F.max(F.when(F.col("_block") == b, F.col(c))).alias(f"{c}_{b + 1}")
        for b in range(blocks)
        for c in ("Year", *columns)
    ]
    return cells.groupBy("row").agg(*out)

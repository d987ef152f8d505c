"""Unions, long and wide forms."""

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_sexes(male: DataFrame, female: DataFrame) -> DataFrame:
    """Stack two tables with a Sex label."""
    return union_labelled({"Male": male, "Female": female}, "Sex")


def union_missing(*tables: DataFrame) -> DataFrame:
    """Stack tables with different columns; absent ones become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def union_labelled(tables: Mapping[str, DataFrame], label: str = "Policy") -> DataFrame:
    """Stack results, naming the source of each row in column ``label``."""
    return reduce(
        DataFrame.unionByName,
        [df.withColumn(label, F.lit(name)) for name, df in tables.items()],
    )


def append_after(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` before the first year of ``new``, then all of ``new``."""
    first = new.agg(F.min("Year").alias("Year"))
    # With no new year at all, every old row stays.
    year = F.coalesce(first.scalar(), F.lit(2**31 - 1))
    return old.where(F.col("Year") < year).unionByName(new)


def wide_to_long(
    df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str, value: str
) -> DataFrame:
    """One row per id and column; ``name`` holds the column name."""
    doubles = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns])
    return doubles.unpivot(list(ids), list(columns), name, value)


def year_columns_to_long(
    df: DataFrame, ids: Sequence[str], years: Sequence[int], value: str = "Population"
) -> DataFrame:
    """As ``wide_to_long`` for columns named by year; Year becomes an int."""
    long = wide_to_long(df, ids, [str(y) for y in years], "Year", value)
    return long.withColumn("Year", F.col("Year").cast("int"))


def long_to_wide(
    df: DataFrame, ids: Sequence[str], name: str, value: str, columns: Sequence
) -> DataFrame:
    """One column per entry of ``columns``. Stating them keeps this to one
    aggregate; a second row for one cell raises, as a key must be unique."""
    cell = F.when(F.count(value) > 1, F.raise_error(F.lit("two rows for one cell")).cast("double"))
    return df.groupBy(*ids).pivot(name, list(columns)).agg(cell.otherwise(F.max(value)))


def array_to_long(
    df: DataFrame,
    keys: Sequence[str],
    values: str,
    first: int,
    index: str = "Year",
    measure: str = "Population",
) -> DataFrame:
    """Array cells to rows: position 0 of column ``values`` is ``index`` = ``first``."""
    position = df.select(*keys, F.posexplode(values).alias("_pos", measure))
    return position.select(*keys, (F.col("_pos") + first).cast("int").alias(index), measure)


def simulation_from_arrays(
    df: DataFrame, first_year: int, shift: int = 1, last: int = 2050, divisor: float = 1000.0
) -> DataFrame:
    """Simulated paths held as two arrays over years, ``male`` and ``female``, per
    ``Rep, Age`` to the long simulation table, with both sexes from one scan."""
    pairs = df.select("Rep", "Age", F.posexplode(F.arrays_zip("male", "female")).alias("_pos", "_p"))
    both = F.explode(
        F.array(
            *[
                F.struct(F.lit(sex).alias("Sex"), F.col(f"_p.{sex.lower()}").alias("value"))
                for sex in ("Male", "Female")
            ]
        )
    )
    return (
        pairs.select("Rep", "Age", (F.col("_pos") + first_year + shift).cast("int").alias("Year"), both.alias("_s"))
        .where(F.col("Year") <= last)
        .select(
            "Rep", "Year", "_s.Sex", "Age", (F.col("_s.value") / F.lit(divisor)).alias("Population")
        )
    )

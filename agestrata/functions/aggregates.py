"""Aggregates that refuse to hide missing values.

Spark aggregates skip NULL. Here a group with a NULL gives NULL unless
``na_rm=True``, so that an incomplete table cannot pass for a complete one.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _guard(value: Column, result: Column, na_rm: bool) -> Column:
    if na_rm:
        return result
    return F.when(F.count_if(value.isNull()) == 0, result)


def total(value: Column, na_rm: bool = False) -> Column:
    return _guard(value, F.sum(value), na_rm)


def mean(value: Column, na_rm: bool = False) -> Column:
    return _guard(value, F.avg(value), na_rm)


def total_where(condition: Column, value: Column, na_rm: bool = False) -> Column:
    """Sum over the rows that meet ``condition``; NULL when there are none."""
    part = F.sum(F.when(condition, value))
    if na_rm:
        return part
    return F.when(F.count_if(condition & value.isNull()) == 0, part)


def root_mean_square(error: Column, na_rm: bool = False) -> Column:
    return F.sqrt(mean(error * error, na_rm))


def mean_absolute(error: Column, na_rm: bool = False) -> Column:
    return mean(F.abs(error), na_rm)

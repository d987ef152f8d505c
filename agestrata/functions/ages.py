"""Age arithmetic in whole months.

Pension ages move in months. Holding them as an integer number of months keeps
repeated one-month steps exact, which a fraction of a year does not.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from agestrata.schema import WORKING_AGE

MONTHS = 12
# Names of the groups, from young to old.
GROUPS = ("Child", "Workers", "Pension")


def months_from_years(age: Column) -> Column:
    """An age in (possibly fractional) years as whole months."""
    return F.round(age.cast("double") * MONTHS).cast("int")


def pensioner_months(age: Column, age_months: Column) -> Column:
    """How many of the 12 birth months of single-year ``age`` are at or above the
    pension age. Birthdays are spread evenly over the year, so of the people aged
    67 under a pension age of 67 years 6 months, six twelfths are pensioners. NULL if
    either age is, which ``least`` and ``greatest`` would hide."""
    past = (age + 1) * MONTHS - age_months
    return F.when(past >= MONTHS, MONTHS).when(past > 0, past).when(past <= 0, 0)


def worker_months(age: Column, age_months: Column) -> Column:
    """The rest of the 12 birth months, from working age on."""
    return F.when(
        age >= WORKING_AGE, MONTHS - pensioner_months(age, age_months)
    ).otherwise(F.lit(0))


def age_label(age_months: Column) -> Column:
    """``804 -> 67Y`` and ``810 -> 67Y+6M``."""
    months = age_months % MONTHS
    return F.concat(
        F.floor(age_months / MONTHS).cast("string"),
        F.lit("Y"),
        F.when(months > 0, F.concat(F.lit("+"), months.cast("string"), F.lit("M"))).otherwise(""),
    )

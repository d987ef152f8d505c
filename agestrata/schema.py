"""Table shapes used across the library.

Ages are whole years as int, pension ages are whole months as int, measures are
double. Nothing is inferred from data.
"""

from pyspark.sql import types as T


def _fields(*pairs):
    return T.StructType([T.StructField(name, kind, True) for name, kind in pairs])


_INT, _STR, _DBL = T.IntegerType(), T.StringType(), T.DoubleType()

POPULATION = _fields(("Year", _INT), ("Sex", _STR), ("Age", _INT), ("Population", _DBL))

SIMULATION = _fields(
    ("Rep", T.LongType()), ("Year", _INT), ("Sex", _STR), ("Age", _INT), ("Population", _DBL)
)

SCHEME = _fields(("Year", _INT), ("age_months", _INT))

POLICY = _fields(
    ("Year", _INT), ("Policy", _STR), ("policy_rank", _INT), ("age_months", _INT)
)

RATES = _fields(
    ("series", _STR),
    ("Sex", _STR),
    ("Year", _INT),
    ("Age", _INT),
    ("rate", _DBL),
    ("exposure", _DBL),
)

FERTILITY_HISTORY = _fields(
    ("Year", _INT), ("Age", _INT), ("rate", _DBL), ("exposure", _DBL)
)

# Age stays a string here: the published file mixes single ages with bands.
FERTILITY_CSV = _fields(
    ("Region", _STR), ("Age", _STR), ("Time", _INT), ("Measure", _STR), ("Value", _DBL)
)

# Fixed values of the data model: open age group, working age, fertile ages.
OPEN_AGE = 100
WORKING_AGE = 15
FERTILE_AGES = (15, 49)

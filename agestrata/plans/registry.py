"""Registry of queries."""

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Sums of doubles depend on their order, so both sides round. Halves are no place to
# round: short fractions such as 1/128 lie on them, and noise in the last bit would
# decide. The boundary is put a thousandth below a half.
SCALE = 1e6
SHIFT = 0.501


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function name, with its SQL counterpart."""

    def register(f: Query) -> Query:
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"two queries named {key}")
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = sql
        return f

    return register


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.floor(F.col(c) * SCALE + SHIFT) / SCALE for c in columns})


def r(expression: str) -> str:
    """The same rounding in SQL."""
    return f"floor(CAST({expression} AS DOUBLE) * {SCALE:.0f} + {SHIFT}) / {SCALE:.0f}"


_folders: dict[str, str] = {}


def results_folder(spark: SparkSession) -> str:
    """Where queries that store something put it: a folder of this program's own under the
    one named in ``spark.checkpoint.dir``. A local session that names none, as in tests,
    uses a temporary one. Removed when the program ends, if it can be reached then."""
    context = spark.sparkContext
    if context.applicationId not in _folders:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if context.master.startswith("local-cluster") or not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
            shared = tempfile.gettempdir()
        path = f"{shared.rstrip('/')}/agestrata-{uuid.uuid4().hex}"
        if "://" not in path or path.startswith("file:"):
            atexit.register(shutil.rmtree, path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)
        _folders[context.applicationId] = path
    return _folders[context.applicationId]

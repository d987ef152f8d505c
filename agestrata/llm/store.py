"""Intermediate tables in the folder that all executors share."""

import atexit
import shutil
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = str(8 << 20)
_own: dict[str, str] = {}
_written: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_root(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. A local session that names none, as
    in tests, gets a temporary one that is removed when the program ends."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _own:
        folder = tempfile.mkdtemp(prefix="llm-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own[context.applicationId] = "file://" + folder
    return _own[context.applicationId]


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """The rows of ``df``, written to the shared folder and read back: lineage ends here,
    a lost executor loses nothing, and the planner knows the size."""
    folder = new_folder(df.sparkSession, name)
    df.write.options(**options).parquet(folder)
    table = df.sparkSession.read.schema(df.schema).parquet(folder)
    _written[table] = folder
    return table


def remove(table: DataFrame) -> None:
    """Delete the files of a ``written`` table that nothing reads any more."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop(table))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, after rows of its session travel to Python in batches of ``BATCH_BYTES``,
    unless the user has set another size: a task holds several batches at a time, in the
    JVM and in Python."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name, None) is None:
        conf.set(name, BATCH_BYTES)
    return df

"""Reading landed tables with stated schemas, and storing results by name."""

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agestrata import schema as shapes


def _read(spark: SparkSession, path: str, shape: T.StructType, form: str) -> DataFrame:
    reader = spark.read.schema(shape)
    if form == "csv":
        return reader.csv(path, header=True, enforceSchema=False)
    if form == "parquet":
        return reader.parquet(path)
    raise ValueError(f"format must be csv or parquet, not {form}")


def read_fertility_csv(spark: SparkSession, path: str) -> DataFrame:
    """Fertility file with columns Region, Age, Time, Measure, Value. Its header must
    list them in that order; Spark checks it."""
    return _read(spark, path, shapes.FERTILITY_CSV, "csv")


def read_population(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    return _read(spark, path, shapes.POPULATION, form)


def read_simulation(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    return _read(spark, path, shapes.SIMULATION, form)


def read_rates(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    return _read(spark, path, shapes.RATES, form)


def read_fertility_history(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    return _read(spark, path, shapes.FERTILITY_HISTORY, form)


def read_checked(
    spark: SparkSession,
    path: str,
    shape: T.StructType,
    form: str = "csv",
    keys: Sequence[str] = (),
    ranges: Mapping[str, tuple[float, float]] | None = None,
) -> DataFrame:
    """The columns of ``shape``, and ``problems``, what is wrong with the row: a value that its
    type cannot hold, an absent key, a value outside its range, a key that comes twice. A
    row without problems has an empty list.

    A CSV is read as text and cast here, so that a bad value is seen whichever columns are
    asked for later. ``accepted`` and ``quarantined`` part the rows. Keys are counted before
    they are shuffled; only those that come twice are joined."""
    names = [f.name for f in shape]
    text = T.StructType([T.StructField(n, T.StringType()) for n in names])
    raw = _read(spark, path, text if form == "csv" else shape, form)
    typed = [F.col(n).try_cast(f.dataType).alias(n) for n, f in zip(names, shape)]
    said = [
        F.when(F.col(f"_raw.{f.name}").isNotNull() & F.col(f.name).isNull(), f"{f.name} is not {f.dataType.simpleString()}")
        for f in shape
    ]
    said += [F.when(F.col(f"_raw.{k}").isNull(), f"{k} is missing") for k in keys]
    said += [
        F.when(~F.col(c).between(low, high), f"{c} is out of range") for c, (low, high) in (ranges or {}).items()
    ]
    rows = raw.select(*typed, F.struct(*names).alias("_raw")).withColumn("problems", F.array_compact(F.array(*said)))
    if keys:
        twice = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1")
        complete = F.lit(True)
        for k in keys:
            complete = complete & F.col(k).isNotNull()
        twice = twice.where(complete).select(*keys, F.lit("key comes twice").alias("_twice"))
        rows = rows.join(twice, list(keys), "left").withColumn(
            "problems", F.array_compact(F.array_append("problems", F.col("_twice")))
        )
    return rows.select(*names, "problems")


def accepted(checked: DataFrame, most: int = 0) -> DataFrame:
    """Rows of ``read_checked`` without problems. More than ``most`` others raise."""
    bad = checked.where(F.size("problems") > 0).agg(F.count("*")).scalar()
    many = F.raise_error(F.concat(bad.cast("string"), F.lit(f" rows have problems, at most {most} may"))).cast("boolean")
    return checked.where(F.when(bad > most, many).otherwise(F.size("problems") == 0)).drop("problems")


def quarantined(checked: DataFrame) -> DataFrame:
    """The other rows, with what is wrong with them; a value that could not be read is NULL."""
    return checked.where(F.size("problems") > 0)


def _versions(spark: SparkSession, path: str) -> list[tuple[int, bool]]:
    """Numbers of the versions under ``path``, and whether each was committed."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []
    for status in files.listStatus(root) if files.exists(root) else ():
        name = status.getPath().getName()
        if name.startswith("v") and name[1:].isdigit():
            done = files.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS"))
            found.append((int(name[1:]), done))
    return sorted(found)


def _drop_version(spark: SparkSession, path: str, number: int) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v{number}")
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def save_result(
    df: DataFrame,
    name: str,
    folder: str,
    partition_by: Sequence[str] = (),
    files: int = 8,
    replace: bool = True,
    keep: int = 2,
) -> None:
    """Store a result under its name in ``folder``, one that all executors reach. Partition
    large tables that are read by year by Year; each of its folders gets at most
    ``files`` files, however many tasks there were. A stored table also cuts lineage and
    survives the loss of executors.

    Every call writes a version of its own. Readers take the last one that was committed,
    so a failed job leaves the earlier result in place, and a table may be loaded, changed
    and saved under one name. Of the committed ones ``keep`` stay, for readers that have
    begun. Without ``replace`` only the partitions that ``df`` has rows of are replaced; the
    others are carried over from the last version. Of two writers at a time, the
    second fails."""
    spark, path = df.sparkSession, f"{folder.rstrip('/')}/{name}"
    before = _versions(spark, path)
    if not replace and any(done for _, done in before):
        if not partition_by:
            raise ValueError("only a partitioned table can be replaced in parts")
        touched = df.select(*partition_by).distinct()
        df = load_result(spark, name, folder).join(touched, list(partition_by), "left_anti").unionByName(df)
    if partition_by:
        spread = F.pmod(F.xxhash64(*df.columns), F.lit(files))
        df = df.repartition(*[F.col(c) for c in partition_by], spread)
    number = max((n for n, _ in before), default=0) + 1
    df.write.mode("error").partitionBy(*partition_by).parquet(f"{path}/v{number}")
    committed = [n for n, done in before if done][::-1]
    for n, done in before:
        if not done or n in committed[max(keep, 1) - 1 :]:
            _drop_version(spark, path, n)


def load_result(
    spark: SparkSession, name: str, folder: str, shape: T.StructType | None = None
) -> DataFrame:
    """The last committed version of a stored result."""
    path = f"{folder.rstrip('/')}/{name}"
    committed = [n for n, done in _versions(spark, path) if done]
    if not committed:
        raise FileNotFoundError(f"no committed result in {path}")
    reader = spark.read if shape is None else spark.read.schema(shape)
    return reader.parquet(f"{path}/v{committed[-1]}")

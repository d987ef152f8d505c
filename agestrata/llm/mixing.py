"""Mixing sources to target weights by weighted sampling without replacement."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from agestrata.llm.store import written

WORD = r"[^\x20\x09-\x0D]+"
#: Steps of the key per source when its prefix sums are formed; one of them is then
#: resolved row by row.
STEPS = 4096


def quality(text: str, size: str) -> Column:
    """Weight of a document in the draw: 1 for a mean word length of 3 to 10 code points,
    as prose has, else a half."""
    mean = F.coalesce(F.length(text), F.lit(0)) / F.greatest(F.col(size), F.lit(1))
    return F.when(mean.between(3, 10), 1.0).otherwise(0.5)


def draw_key(doc_id: str, weight: Column) -> Column:
    """Exponential with rate ``weight``: -ln(u) / weight, where u comes from the digest of
    the id, so that reruns agree. The smallest keys are drawn first."""
    digits = F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(2**52))
    return -F.log(u) / weight


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_size`` and ``_key``."""
    sized = docs.withColumn("_size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    return sized.withColumn("_key", draw_key("doc_id", quality("text", "_size")))


def targets(sizes: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    Sources in order of code points, NULL last, weigh ``weights``, repeating, and share
    the sum of all sizes; no target exceeds ``most`` times its source, and the excess goes
    to the others by weight, round after round. A round brings two sums to the driver.
    """
    spark = sizes.sparkSession
    order = sizes.orderBy(F.col("source").asc_nulls_last()).rdd.zipWithIndex()
    n = len(weights)
    weighed = spark.createDataFrame(
        order.map(lambda x: (x[0]["source"], x[0]["source_size"], float(weights[x[1] % n]))),
        "source string, source_size long, weight double",
    )
    weighed = written(weighed, "mixing-weights")
    total = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    cap = F.col("source_size") * F.lit(float(most))
    level = 0.0
    while True:
        # Sources below the level reached so far keep their cap.
        kept = cap < F.col("weight") * F.lit(level)
        full, open_weight = weighed.agg(
            F.coalesce(F.sum(F.when(kept, cap)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~kept, F.col("weight"))), F.lit(0.0)),
        ).first()
        if not open_weight:
            break
        new = (total - full) / open_weight
        if new <= level:
            break
        level = new
    return weighed.select("source", "source_size", F.least(cap, F.col("weight") * F.lit(level)).alias("target"))


def plan(rows: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """Per source, from rows of ``source, _size, _key``: ``source, source_size, target,
    epochs, cutoff``. Every document is taken ``epochs`` times, and once more if its key is
    at most ``cutoff`` (NULL: none).

    The rest of the target after whole epochs is met by prefix sums of sizes in the order
    of keys. They are formed in two steps, so that no task sorts a source: sums over
    ``STEPS`` steps of the key, combined before the shuffle, find the step in which the
    rest is met, and only the rows of that step are sorted. The last document is taken if
    that brings the sum nearer.
    """
    step = F.least(F.floor((1 - F.exp(-F.col("_key"))) * STEPS), F.lit(STEPS - 1)).cast("int")
    stepped = rows.withColumn("_step", step)
    steps = written(stepped.groupBy("source", "_step").agg(F.sum("_size").alias("_sum")), "mixing-steps")
    goal = targets(steps.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, most)
    goal = goal.withColumn(
        "epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    ).withColumn("_rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    goal = written(goal, "mixing-targets")
    named = goal.select(F.col("source").alias("_source"), "_rest")
    by_step = Window.partitionBy("source").orderBy("_step")
    crossing = (
        steps.join(named, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("_before", F.sum("_sum").over(by_step) - F.col("_sum"))
        .where("_rest > 0 and _sum > 0 and _before < _rest and _before + _sum >= _rest")
        .select("_source", F.col("_step").alias("_at"), "_rest", "_before")
    )
    by_key = Window.partitionBy("source").orderBy("_key")
    tied = (
        stepped.join(crossing, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_step") == F.col("_at")))
        .groupBy("source", "_key", "_rest", "_before")
        .agg(F.sum("_size").alias("_sum"))
        .withColumn("_upto", F.col("_before") + F.sum("_sum").over(by_key))
    )
    fits = F.col("_upto") - F.col("_rest") < F.col("_rest") - (F.col("_upto") - F.col("_sum"))
    cut = (
        tied.where((F.col("_upto") <= F.col("_rest")) | fits)
        .groupBy("source")
        .agg(F.max("_key").alias("_cut"))
    )
    # Where not even the first row of the step fits, the steps before it are taken whole.
    floor = crossing.select("_source", (-F.log(1 - F.col("_at") / F.lit(float(STEPS)))).alias("_floor"))
    return (
        goal.join(cut.withColumnRenamed("source", "_c"), F.col("source").eqNullSafe(F.col("_c")), "left")
        .join(floor, F.col("source").eqNullSafe(F.col("_source")), "left")
        .select("source", "source_size", "target", F.col("epochs").cast("long").alias("epochs"),
                F.coalesce("_cut", "_floor").alias("cutoff"))
    )


def _with_plan(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """``rows`` with ``_times``, how often each is taken. A plan has a row per source."""
    named = decided.select(
        F.col("source").alias("_s"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"),
        F.col("epochs").alias("_epochs"), F.col("cutoff").alias("_cutoff"),
    )
    times = F.col("_epochs") + F.coalesce((F.col("_key") <= F.col("_cutoff")).cast("long"), F.lit(0))
    return rows.join(named, F.col("source").eqNullSafe(F.col("_s"))).withColumn("_times", times)


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken``: how many words of each document
    a mix of the sources takes, repeats counted.

    Whole epochs of a source come first; the rest of its target is drawn without
    replacement with chances by document quality. Rows with one doc_id in a source share
    a key and are drawn together. NULL texts have size 0, a NULL source is a source, a
    NULL doc_id has a key like any other; an empty table gives no rows. Other columns are
    left out, whatever their names.
    """
    rows = written(measured(docs).select("doc_id", "source", "_size", "_key"), "mixing-rows")
    mixed = _with_plan(rows, written(plan(rows, weights, most), "mixing-plan"))
    return mixed.select(
        "doc_id", "source", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"), (F.col("_size") * F.col("_times")).alias("taken"),
    )


def mixed_rows(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3) -> DataFrame:
    """The mix itself: the rows of ``docs`` that are taken, each as often as it is."""
    columns = docs.columns
    rows = measured(docs.select("doc_id", "source", "text", F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row")))
    skinny = written(rows.select("source", "_size", "_key"), "mixing-rows")
    mixed = _with_plan(rows, written(plan(skinny, weights, most), "mixing-plan"))
    return (
        mixed.where("_times > 0")
        .select("_row", F.explode(F.array_repeat(F.lit(0), F.col("_times").cast("int"))).alias("_n"))
        .select("_row.*")
    )

"""What filters do in every order: counts over the lattice of filters already applied."""

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: NULL ids are dealt out over so many keys of a join that none of them can meet.
SALTS = 64


def lattice(n: int) -> list[tuple[int, int, int]]:
    """``state, filter, orders`` for every edge: in ``state`` (the bits of the filters
    applied so far) ``filter`` comes next in that many orders. Paths that reach a state are
    counted forwards from none applied, those that leave it backwards from all applied."""
    full = (1 << n) - 1
    reach, leave = [0] * (full + 1), [0] * (full + 1)
    reach[0] = leave[full] = 1
    for state in range(full + 1):
        for f in range(n):
            if not state >> f & 1:
                reach[state | 1 << f] += reach[state]
    for state in range(full, -1, -1):
        for f in range(n):
            if not state >> f & 1:
                leave[state] += leave[state | 1 << f]
    return [
        (state, f, reach[state] * leave[state | 1 << f])
        for state in range(full + 1) for f in range(n) if not state >> f & 1
    ]


def failures(docs: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """``doc_id, part, digest, fails``: a bit of ``fails`` for every condition that holds of
    a row, the first one lowest. A condition that is NULL does not hold. ``part`` is the
    language, an empty string where it is NULL. Other columns are for the conditions only."""
    bits = sum(
        (F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(conditions.values())), F.lit(0)
    )
    return docs.select(
        "doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.sha2("text", 256).alias("digest"),
        bits.cast("int").alias("fails"),
    )


def mark_copies(rows: DataFrame, bit: int) -> DataFrame:
    """``doc_id, digest, part, fails, n``: equal rows counted, with ``bit`` set where a
    smaller doc_id has the same digest. They are counted before the first shuffle, and a
    copy meets no other copy: the smallest doc_id of every digest is a minimum with
    map-side combine, joined by digest and doc_id. A NULL doc_id is neither smaller nor
    larger than another, so it has no smaller one."""
    counted = rows.groupBy("doc_id", "part", "digest", "fails").agg(F.count("*").alias("n"))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null")
    first = first.withColumn("_first", F.lit(True))
    later = F.col("_first").isNull() & F.col("doc_id").isNotNull()
    return counted.join(first, ["digest", "doc_id"], "left").select(
        "doc_id", "digest", "part",
        F.when(later, F.col("fails").bitwiseOR(F.lit(1 << bit))).otherwise(F.col("fails")).alias("fails"),
        "n",
    )


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``good`` and ``toxic`` beside every row: whether a label of its doc_id has quality 1,
    or toxic 1. Documents without a label, or without an id, have neither."""
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("_good"), F.max((F.col("toxic") == 1).cast("int")).alias("_toxic")
    )
    # Rows without an id match nothing and are spread, so that they are not one task.
    spread = F.pmod(F.xxhash64("digest"), F.lit(SALTS))
    salt = F.when(F.col("doc_id").isNull(), spread).otherwise(F.lit(0))
    salted = rows.withColumn("_salt", salt)
    joined = salted.join(
        marks.withColumn("_none", F.lit(0).cast("long")),
        (salted["doc_id"] == F.col("_id")) & (salted["_salt"] == F.col("_none")), "left",
    )
    is_one = lambda c: F.coalesce(F.col(c) == 1, F.lit(False))
    return joined.select(*rows.columns, is_one("_good").alias("good"), is_one("_toxic").alias("toxic"))


def audit(rows: DataFrame, names: str) -> DataFrame:
    """One row per part, order of the filters and step, from ``part, fails, n, good, toxic``.

    ``names`` has a letter for every bit of ``fails``. A row is removed by the first filter of
    an order that it fails, so what a step does depends on the set of filters before it,
    not on their order: every part has 2^n states, and n 2^(n-1) edges that add a filter.
    Counts are taken once per edge. A filter's Shapley sum weighs the removals of its edges
    by the orders that go through them (``lattice``), and the steps of every order are read
    from the same edges. All n! orders are returned: meant for a handful of filters.

    Rows are added up to at most 4 * 2^n counts a part before anything is expanded; a part
    has all its rows, zeros included, and an empty table gives none.
    """
    spark, n = rows.sparkSession, len(names)
    counts = rows.groupBy("part", "fails", "good", "toxic").agg(F.sum("n").alias("n"))
    edges = F.array(*(
        F.struct(F.lit(state).alias("state"), F.lit(f).alias("filter"), F.lit(1 << f).alias("own"), F.lit(o).cast("long").alias("orders"))
        for state, f, o in lattice(n)
    ))
    own = F.col("own")
    hit, before = F.col("fails").bitwiseAND(own) != 0, F.col("fails").bitwiseAND(F.col("state")) != 0
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(F.lit(0))).alias
    per_edge = counts.select("*", F.inline(edges)).groupBy("part", "state", "filter", "orders").agg(
        total(~hit & ~before)("kept"), total(hit & ~before)("removed"), total(hit & before)("redundant"),
        total(F.col("fails") == own)("unique_fails"),
        total(hit & ~before & F.col("good"))("good_lost"), total(hit & ~before & F.col("toxic"))("toxic_lost"),
    )
    shapley = per_edge.groupBy("part", "filter").agg(F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    steps = [
        ("".join(names[f] for f in order), k + 1, sum(1 << f for f in order[:k]), order[k])
        for order in permutations(range(n)) for k in range(n)
    ]
    paths = spark.createDataFrame(steps, "filter_order string, step int, state int, filter int")
    return per_edge.join(shapley, ["part", "filter"]).join(F.broadcast(paths), ["state", "filter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def document_filters() -> dict[str, Column]:
    """When a document fails, over the columns ``text`` and ``_words``."""
    words = F.size("_words")
    return {
        "A": words < 200,
        "B": F.size(F.array_distinct("_words")) * 100 < words * 50,
        "C": F.length(F.regexp_replace("text", "[^A-Z]+", "")) * 100 > F.length("text") * 3,
        "D": F.col("text").rlike(r"[#$%&*|]"),
    }


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``audit`` of the five filters over ``docs``: too few words (A), too few different
    ones (B), too many capitals (C), marks of markup (D), a text met before (E).

    Whole texts are judged; a NULL text is empty. Repeated rows count each. Rows that share
    a doc_id share its labels, and are no copies of each other. Extra columns are
    left out, whatever their names. An empty table gives no rows, empty labels no losses."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang")
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    filters = document_filters()
    rows = mark_copies(failures(docs.withColumn("_words", words), filters), len(filters))
    return audit(with_labels(rows, labels.select("doc_id", "quality", "toxic")), "".join(filters) + "E")

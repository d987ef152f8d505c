"""Document fingerprints from closed syncmers, by DataFrame functions only."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from agestrata.llm.store import written

#: Units of an anchor, units of the inner runs that decide whether it is one, and anchors
#: that a fingerprint keeps; likeness is judged on all.
K, S, KEPT = 5, 2, 128
#: A unit is up to four code points of a word, counted from its start; words are split at
#: ASCII white space. So an anchor spans some three words, and texts of a few words have
#: several. In a run of more than ``WORD`` code points, as text without spaces has them, every
#: code point is a unit, so that what comes before a passage does not move its units. Code
#: points beyond the 16-bit plane count twice in a look behind: words with them are cut finer.
WORD, PIECE = 16, 4
_SIGN = r"[^\x20\x09-\x0D]"
UNIT = "|".join(
    [rf"(?<=(?<!{_SIGN}){_SIGN}{{{at}}})(?={_SIGN}{{1,{WORD - at}}}(?!{_SIGN})){_SIGN}{{1,{PIECE}}}" for at in range(0, WORD, PIECE)]
    + [_SIGN]
)
#: Documents that one task has in order, on average, and ranges that come from quantiles;
#: ranges are cut evenly beyond that.
ORDERED, RANGES = 2_000, 128


def _hashed(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out_h``, a hash per unit, and ``out_g``, one per inner run of S words."""
    df = df.withColumn(f"{out}_u", F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(UNIT), 0))
    df = df.withColumn(f"{out}_h", F.transform(f"{out}_u", lambda w: F.xxhash64(w))).drop(f"{out}_u")
    h, n = F.col(f"{out}_h"), F.size(f"{out}_h")
    pairs = F.zip_with(F.slice(h, 1, n - 1), F.slice(h, 2, n - 1), lambda a, b: F.xxhash64(a, b))
    return df.withColumn(f"{out}_g", F.when(n >= K, pairs))


def anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: ``struct<at, hash>`` for every closed syncmer of the whole ``text``, in
    order: runs of K units whose smallest inner run of S units is the first or the last in
    them. Whether a run is one depends on its own units only, so equal passages have equal
    anchors wherever they stand. A text of too few units, or without a syncmer, has one
    anchor, of all its units, and an empty or NULL text none.
    """
    df = _hashed(df, text, out)
    h, g, n = F.col(f"{out}_h"), F.col(f"{out}_g"), F.size(f"{out}_h")
    inner = K - S + 1

    def closed(i: Column) -> Column:
        return F.least(g[i], g[i + inner - 1]) <= F.least(*[g[i + j] for j in range(1, inner - 1)])

    places = F.when(n >= K, F.filter(F.sequence(F.lit(0), n - K), closed)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn(f"{out}_p", places)
    found = F.transform(
        f"{out}_p", lambda i: F.struct(i.alias("at"), F.xxhash64(*[h[i + j] for j in range(K)]).alias("hash"))
    )
    whole = F.array(F.struct(F.lit(0).alias("at"), F.xxhash64(h).alias("hash")))
    none = F.when(n > 0, whole).otherwise(F.array().cast("array<struct<at: int, hash: bigint>>"))
    return df.withColumn(out, F.when(F.size(f"{out}_p") > 0, found).otherwise(none)).drop(
        f"{out}_h", f"{out}_g", f"{out}_p"
    )


def marks(found: str, out: str) -> Callable[[DataFrame], DataFrame]:
    """Adds ``out``: a number for every anchor of ``found``, which is the same in two texts for
    the first, second and so on of equal anchors, so that sets of them count repeats."""

    def add(df: DataFrame) -> DataFrame:
        df = df.withColumn(f"{out}_s", F.sort_array(F.transform(found, lambda a: a["hash"])))
        s, n = F.col(f"{out}_s"), F.size(f"{out}_s")
        places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        df = df.withColumn(f"{out}_f", F.filter(places, lambda i: (i == 0) | (s[i] != s[F.greatest(i - 1, F.lit(0))])))
        f, m = F.col(f"{out}_f"), F.size(f"{out}_f")

        def numbered(at: Column, j: Column) -> Column:
            count = F.when(j + 1 < m, f[F.least(j + 1, m - 1)]).otherwise(n) - at
            return F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.when(k == 0, s[at]).otherwise(F.xxhash64(s[at], k)))

        return df.withColumn(out, F.flatten(F.transform(f, numbered))).drop(f"{out}_s", f"{out}_f")

    return add


def sketch(found: Column, kept: int = KEPT) -> Column:
    """The ``kept`` smallest distinct anchors, by the upper 32 bits of their hashes: all
    anchors of a text of some 150 words, an even sample of a longer one's."""
    short = F.transform(found, lambda a: F.shiftright(a["hash"], 32).cast("int"))
    return F.slice(F.sort_array(F.array_distinct(short)), 1, kept)


def as_text(marks: str) -> Column:
    """Eight hex digits for each anchor."""
    unsigned = F.lit(2**32 - 1)
    return F.array_join(
        F.transform(marks, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(unsigned))), 8, "0")), ""
    )


def likeness(a: str, b: str) -> Column:
    """Share of the anchors of both texts that both have (Jaccard), judged on all ``marks`` of
    both, so repeats count. Two texts without any are alike."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, 1.0).otherwise(common / union)


def _dealt(docs: DataFrame, ordered: int) -> DataFrame:
    """``docs`` with ``_range`` and ``_at``, numbers that grow with doc_id: ranges between
    quantiles, and cells of some ``ordered`` rows each, into which they are cut evenly. NULL
    ids get the last."""
    shares = F.array(*[F.lit(i / RANGES) for i in range(RANGES + 1)])
    n, marks = docs.agg(F.count("*"), F.percentile_approx("doc_id", shares, F.lit(20_000))).first()
    marks = sorted(set(marks or [0]))
    lows, widths = marks[:-1] or marks, [b - a for a, b in zip(marks, marks[1:])] or [1]
    cells = max(1, -(-n // (ordered * len(lows))))

    def choose(lo: int, hi: int) -> Column:
        if hi - lo == 1:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("doc_id") < lows[mid], choose(lo, mid)).otherwise(choose(mid, hi))

    at = F.col("_range")
    cell = F.floor((F.col("doc_id") - F.lit(lows)[at]) / F.lit(widths)[at] * cells)
    cell = F.least(F.greatest(cell, F.lit(0)), F.lit(cells - 1))
    bucket = F.when(F.col("doc_id").isNull(), F.lit(len(lows) * cells)).otherwise(at * cells + cell)
    ranges = F.when(F.col("doc_id").isNull(), F.lit(len(lows))).otherwise(choose(0, len(lows)))
    return docs.withColumn("_range", ranges).withColumn("_at", bucket.cast("long"))


def with_next(
    docs: DataFrame, prepare: Callable[[DataFrame], DataFrame] = lambda df: df, ordered: int = ORDERED
) -> DataFrame:
    """``doc_id, text`` and what ``prepare`` adds to them, and as ``_next`` the same, without
    doc_id, of the next row in order of (doc_id, NULL last, text), after the last that of
    the first.

    No task orders more than some ``ordered`` rows: rows are dealt out by ranges of
    doc_id, and each range also gets the first document of the range after it. That one is
    found from ids alone and stored, a row per range, so that the planner knows whether
    it can be broadcast; texts are then shuffled once, before ``prepare`` adds to them.
    """
    rows = _dealt(docs.select("doc_id", "text"), ordered)
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id"))
    edges = rows.groupBy("_range", "_at").agg(F.min(rank).alias("_r"))
    # The cell before the first of a range is the last of the range before; there are
    # RANGES of them at most, so their order is one small task.
    ends = edges.groupBy("_range").agg(F.max("_at").alias("_end"))
    following = Window.orderBy("_range")
    everything = following.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(
        "_range", F.coalesce(F.lag("_end").over(following), F.last("_end").over(everything)).alias("_end")
    )
    within = Window.partitionBy("_range").orderBy("_at")
    edges = edges.withColumn("_lag", F.lag("_at").over(within)).join(ends, "_range").select(
        F.coalesce("_lag", "_end").alias("_before"), F.col("_at").alias("_own"),
        F.col("_r").getField("doc_id").alias("_first"),
    )
    edges = written(edges, "fingerprints-edges")
    guards = rows.join(
        edges, (F.col("_at") == F.col("_own")) & F.col("doc_id").eqNullSafe(F.col("_first"))
    ).select("doc_id", "text", "_range", F.col("_before").alias("_at"), F.lit(1).alias("_guard"))
    order = Window.partitionBy("_at").orderBy("_guard", F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_last())
    both = prepare(rows.withColumn("_guard", F.lit(0)).unionByName(guards).repartition("_at"))
    carried = [c for c in both.columns if c not in ("doc_id", "_range", "_at", "_guard")]
    following = F.lead(F.struct(*carried)).over(order)
    return both.withColumn("_next", following).where("_guard = 0").select("doc_id", *carried, "_next")


def edited(text: str, following: str) -> Column:
    """``text`` with its last floor(n / 2) code points replaced by the first as many of
    ``following``, or all it has."""
    own, n = F.coalesce(F.col(text), F.lit("")), F.length(F.coalesce(F.col(text), F.lit("")))
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(own, F.lit(1), n - half), F.substring(F.coalesce(F.col(following), F.lit("")), F.lit(1), half))


def fingerprints(docs: DataFrame, kept: int = KEPT) -> DataFrame:
    """``doc_id, fingerprint`` of every whole text, eight hex digits for each anchor kept."""
    marked = anchors(docs.select("doc_id", "text"), "text", "_a").withColumn("_m", sketch(F.col("_a"), kept))
    return marked.select("doc_id", as_text("_m").alias("fingerprint"))


def edit_report(docs: DataFrame, kept: int = KEPT) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next`` per row: how like all anchors of a text are to those of the text with its
    last half replaced by the beginning of the next document's, and to the next's own.
    The fingerprints are samples of the anchors beside that.

    A NULL text is empty. Rows with one doc_id follow each other in order of their texts,
    equal rows in any order; NULL ids come last; a single row is next to itself. Other
    columns are left out, whatever their names. An empty table gives no rows.
    """

    def marked(df: DataFrame, text: str, out: str) -> DataFrame:
        df = anchors(df, text, f"{out}_all")
        return marks(f"{out}_all", out)(df.withColumn(f"{out}_m", sketch(F.col(f"{out}_all"), kept))).drop(f"{out}_all")

    both = with_next(docs, lambda df: marked(df, "text", "_a")).select(
        "doc_id", "text", "_a", "_a_m", F.col("_next._a").alias("_c"), edited("text", "_next.text").alias("_edited")
    )
    both = marked(both, "_edited", "_b")
    return both.select(
        "doc_id", F.length(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("n_chars"),
        F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        as_text("_a_m").alias("fingerprint"), as_text("_b_m").alias("edited_fingerprint"),
        likeness("_a", "_b").alias("near_edited"), likeness("_a", "_c").alias("near_next"),
    )

"""Byte strings that stand more than once in a corpus, by run-length indexes over the places
where they can be."""

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from agestrata.llm.run_index import repeated_starts
from agestrata.llm.store import in_small_batches, new_folder, remove, written

#: Bytes of an anchor; bytes of an index; different contexts of an anchor that one index takes.
ANCHOR, INDEX_BYTES, MOST = 32, 1 << 20, 4096
#: Bytes of text that one file of the stored texts has at most, about.
FILE_BYTES = 64 << 20
_MULTIPLY, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _grams(text: np.ndarray) -> np.ndarray:
    """A hash of every ``ANCHOR`` consecutive bytes."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    view = np.lib.stride_tricks.as_strided(padded, (len(text), 8), (1, 1))
    h = np.ascontiguousarray(view).view(np.uint64).ravel() * _MULTIPLY
    h ^= h >> np.uint64(29)
    h *= _MULTIPLY
    size = 8
    while size < ANCHOR:
        h = h[:-size] * _MIX + (h[size:] ^ (h[size:] >> np.uint64(31)))
        h ^= h >> np.uint64(32)
        h *= _MULTIPLY
        size *= 2
    return h[: len(text) - ANCHOR + 1]


def contexts(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``anchor, start, end``: every window of ``length`` bytes has the anchor with the least
    hash in it, the first of equals, so equal windows have equal anchors at equal places;
    consecutive windows of one anchor are its context."""
    none = np.zeros(0, np.int64)
    if len(text) < length:
        return none, none, none
    hashes = _grams(np.frombuffer(text, np.uint8))
    at, least, size, width = np.arange(len(hashes)), hashes, 1, length - ANCHOR + 1
    while size < width:
        step = min(size, width - size)
        later = least[step:] < least[:-step]
        at, least = np.where(later, at[step:], at[:-step]), np.where(later, least[step:], least[:-step])
        size += step
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return hashes[at[first]].view(np.int64), first, np.append(first[1:], len(at)) - 1 + length


def _texts(docs: DataFrame) -> tuple[DataFrame, str]:
    """``t1, t2, n, doc_id, text``: the different texts with the number of their rows, stored
    by ``t1``, so that later joins on it do not move them, and the table's name. Copies in
    a batch are counted before the shuffle."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, first, n = {}, [], []
            for i, key in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                k = place.setdefault(key, len(first))
                if k == len(first):
                    first.append(i)
                    n.append(0)
                n[k] += 1
            part = batch.take(pa.array(first, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n, pa.int64())], [*batch.schema.names, "n"])

    rows = docs.select("doc_id", "t1", "t2", "text")
    stored = rows.select(F.count("*"), F.sum(F.length("text"))).first()
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (stored[1] or 0) // FILE_BYTES + 1)
    different = (
        in_small_batches(rows)
        .mapInArrow(run, f"doc_id {kind}, t1 long, t2 long, text binary, n long")
        .repartition(files, "t1")
        .groupBy("t1", "t2")
        .agg(F.sum("n").alias("n"), F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
    )
    name = f"long_repeats_{uuid.uuid4().hex}"
    different.write.options(path=new_folder(spark, "repeat-texts"), compression="zstd").bucketBy(files, "t1").saveAsTable(name)
    return spark.table(name), name


def _met(texts: DataFrame, length: int) -> DataFrame:
    """``t1, anchors``: for every text its anchors that are met more than once. An anchor met
    twice in a batch is known; of the others, and of the first of every batch, one row
    goes to the count, so a frequent anchor has no more rows there than there are batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, which, weight = [], [], []
            for i, text in enumerate(batch.column(2)):
                anchors = contexts(text.as_py(), length)[0]
                found.append(anchors)
                which.append(np.full(len(anchors), i))
                weight.append(np.full(len(anchors), min(batch.column(1)[i].as_py(), 2)))
            if not found:
                continue
            anchors, which, weight = map(np.concatenate, (found, which, weight))
            _, first, group = np.unique(anchors, return_index=True, return_inverse=True)
            known = np.bincount(group, weights=weight)[group] > 1 if len(anchors) else np.zeros(0, bool)
            is_first = np.zeros(len(anchors), bool)
            is_first[first] = True
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchors), batch.column(0).take(pa.array(which)), pa.array(known), pa.array(is_first)],
                ["anchor", "t1", "known", "first"],
            )

    rows = in_small_batches(texts.select("t1", "n", "text")).mapInArrow(
        run, "anchor long, t1 long, known boolean, first boolean"
    )
    rows = written(rows, "repeat-anchors", compression="zstd")
    over = Window.partitionBy("anchor")
    # A known anchor needs no text: its row only tells the others.
    counted = rows.where("first").select("anchor", F.when(~F.col("known"), F.col("t1")).alias("t1"))
    counted = counted.select(
        "*", F.count("*").over(over).alias("n"), F.count("t1").over(over).alias("unknown")
    ).where("t1 is not null and (n > 1 or unknown < n)")
    both = rows.where("known").select("anchor", "t1").unionByName(counted.select("anchor", "t1"))
    return written(both.groupBy("t1").agg(F.collect_set("anchor").alias("anchors")), "repeat-met", compression="zstd")


def _contexts(texts: DataFrame, met: DataFrame, length: int) -> DataFrame:
    """``anchor, context, t1, t2, start, n, size, bytes``: the contexts of anchors that are met
    more than once. Of those that are equal in a batch one has the bytes, and ``n``, the
    number of places; the others have their place only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, out, which = {}, [[] for _ in range(6)], []
            for i, (n, text, met) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4))):
                text = text.as_py()
                anchors, starts, ends = contexts(text, length)
                keep = np.isin(anchors, met.values.to_numpy())
                for a, s, e in zip(anchors[keep].tolist(), starts[keep].tolist(), ends[keep].tolist()):
                    piece = text[s:e]
                    c = xxhash.xxh64_intdigest(piece) - (1 << 63)
                    at = seen.setdefault((a, c), len(which))
                    new = at == len(which)
                    which.append(i)
                    for column, value in zip(out, (a, c, s, 0, e - s if new else 0, piece if new else None)):
                        column.append(value)
                    out[3][at] += min(n, 2)
            index = pa.array(which, pa.int64())
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
            a, c, s, n, size, piece = (pa.array(v, k) for v, k in zip(out, kinds))
            yield pa.RecordBatch.from_arrays(
                [a, c, batch.column(0).take(index), batch.column(1).take(index), s, n, size, piece],
                ["anchor", "context", "t1", "t2", "start", "n", "size", "bytes"],
            )

    rows = texts.join(met, "t1").select("t1", "t2", "n", "text", "anchors")
    return written(
        in_small_batches(rows).mapInArrow(
            run, "anchor long, context long, t1 long, t2 long, start int, n long, size int, bytes binary"
        ),
        "repeat-contexts", compression="zstd",
    )


def _spans(starts: np.ndarray, length: int) -> list[dict]:
    """Maximal runs of places covered by windows, from their starts in order."""
    if not len(starts):
        return []
    border = np.flatnonzero(np.diff(starts) > length)
    return [
        {"start": int(s), "end": int(e) + length}
        for s, e in zip(starts[np.r_[0, border + 1]], starts[np.r_[border, len(starts) - 1]])
    ]


def _by_index(rows: DataFrame, length: int, buckets: int) -> DataFrame:
    """``anchor, context, spans`` of contexts with something repeated: the anchors are dealt
    out over ``buckets``, and each builds the index of its different contexts."""

    def run(table: pa.Table) -> pa.Table:
        pieces = {}
        for a, c, n, piece in zip(*(table.column(x).to_pylist() for x in ("anchor", "context", "n", "bytes"))):
            pieces.setdefault((a, c), [piece, 0])[1] += n
        found = repeated_starts([piece for piece, _ in pieces.values()], length)
        keys, spans = [], []
        for key, (piece, n), starts in zip(pieces, pieces.values(), found):
            whole = [{"start": 0, "end": len(piece)}]
            spans_here = whole if n > 1 else _spans(starts, length)
            if spans_here:
                keys.append(key)
                spans.append(spans_here)
        return pa.table(
            [pa.array([a for a, _ in keys], pa.int64()), pa.array([c for _, c in keys], pa.int64()), pa.array(spans, _SPANS)],
            ["anchor", "context", "spans"],
        )

    return (
        rows.select("anchor", "context", "n", "bytes", F.pmod("anchor", F.lit(buckets)).alias("bucket"))
        .groupBy("bucket")
        .applyInArrow(run, "anchor long, context long, spans array<struct<start: int, end: int>>")
    )


def _by_window(rows: DataFrame, length: int) -> DataFrame:
    """The same for contexts of anchors that have too many for one index: their windows are
    counted by hash, before and after the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[] for _ in range(6)]
            for a, c, n, piece in zip(*(x.to_pylist() for x in batch.columns)):
                for start in range(len(piece) - length + 1):
                    h = xxhash.xxh3_128_intdigest(piece[start : start + length])
                    low = (h & (1 << 64) - 1) - (1 << 63)
                    for column, value in zip(out, (a, c, start, (h >> 64) - (1 << 63), low, n)):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(out, kinds)], ["anchor", "context", "start", "high", "low", "n"]
            )

    windows = in_small_batches(rows.select("anchor", "context", "n", "bytes")).mapInArrow(
        run, "anchor long, context long, start int, high long, low long, n long"
    )
    twice = windows.groupBy("high", "low").agg(F.sum("n").alias("_n")).where("_n > 1")
    span = F.struct("start", (F.col("start") + length).alias("end"))
    return windows.join(twice, ["high", "low"]).groupBy("anchor", "context").agg(F.collect_set(span).alias("spans"))


def remove_long_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """``doc_id, n_bytes, kept, spans`` per row: bytes covered by a string of ``length`` bytes
    that also starts at another place of the table are removed, all its occurrences. Matches
    do not cross rows, may overlap, and are judged on the input, not on what is left.
    ``kept`` (binary) has what is left, ``spans`` the maximal removed runs, as first byte
    and end.

    Equal strings share the anchor chosen from their content, so they meet in the part of
    the corpus around equal anchors. Only anchors met more than once go on. Their contexts
    are dealt out by anchor; every part of some ``INDEX_BYTES`` builds a run-compressed
    Burrows-Wheeler transform with sampled run ends, and streams the matching statistics
    of all its contexts from the samples (``run_index``). Equal contexts are one text of the
    index. Anchors with more than ``MOST`` contexts, which no index is to hold, are dealt out
    by the hash of every window instead, with the same result.

    Rows of equal texts are all repeated, and only one of them goes through the index. A NULL
    text is empty; a text shorter than ``length`` stays. A NULL or repeated doc_id has no
    influence: rows are judged by their texts. Other columns are left out, whatever
    their names. An empty table gives no rows. ``length`` is at least twice ``ANCHOR``.
    """
    if length < 2 * ANCHOR:
        raise ValueError(f"length is at least {2 * ANCHOR}")
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    # Two hashes of the text: 128 bits tell texts apart.
    docs = docs.select("doc_id", text.alias("text")).select(
        "doc_id", "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(length), "text").alias("t2")
    )
    texts, name = _texts(docs)
    met = _met(texts, length)
    places = _contexts(texts, met, length)
    remove(met)
    shipped = places.where("size > 0")
    total = shipped.agg(F.sum("size")).first()[0] or 0
    hot = written(shipped.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > MOST).select("anchor"), "repeat-hot")
    marks = _by_index(shipped.join(hot, "anchor", "left_anti"), length, total // INDEX_BYTES + 1).unionByName(
        _by_window(shipped.join(hot, "anchor", "left_semi"), length)
    )
    span = F.transform(
        "spans", lambda s: F.struct("t2", (s["start"] + F.col("start")).alias("start"), (s["end"] + F.col("start")).alias("end"))
    )
    found = (
        places.select("anchor", "context", "t1", "t2", "start")
        .join(marks, ["anchor", "context"])
        .groupBy("t1")
        .agg(F.flatten(F.collect_list(span)).alias("found"))
    )

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, kept, spans = [], [], []
            for t2, text, found in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                text = np.frombuffer(text.as_py(), np.uint8)
                step = np.zeros(len(text) + 1, np.int64)
                if found.is_valid:
                    mine = found.values.field("t2").to_numpy() == t2
                    np.add.at(step, found.values.field("start").to_numpy()[mine], 1)
                    np.add.at(step, found.values.field("end").to_numpy()[mine], -1)
                gone = np.cumsum(step)[:-1] > 0
                edges = np.flatnonzero(np.diff(np.r_[0, gone.astype(np.int8), 0])).reshape(-1, 2)
                sizes.append(len(text))
                kept.append(text[~gone].tobytes() if len(edges) else text.tobytes())
                spans.append([{"start": int(s), "end": int(e)} for s, e in edges])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, _SPANS)],
                ["doc_id", "n_bytes", "kept", "spans"],
            )

    single = texts.where("n = 1").join(found, "t1", "left").select("doc_id", "t2", "text", "found")
    schema = f"doc_id {kind}, n_bytes long, kept binary, spans array<struct<start: int, end: int>>"
    alone = in_small_batches(single).mapInArrow(keep, schema)
    # Texts of several rows are removed whole, or too short: no text travels.
    size = F.length("text").cast("int")
    long_ = size >= length
    whole = F.array(F.struct(F.lit(0).alias("start"), size.alias("end")))
    copies = texts.where("n > 1").select(
        "t1", "t2", size.cast("long").alias("n_bytes"),
        F.when(long_, F.lit(b"")).otherwise(F.col("text")).alias("kept"),
        F.when(long_, whole).otherwise(F.array().cast("array<struct<start: int, end: int>>")).alias("spans"),
    )
    return alone.unionByName(docs.drop("text").join(copies, ["t1", "t2"]).select("doc_id", "n_bytes", "kept", "spans"))

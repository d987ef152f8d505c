"""Passages that were seen before: seeds by winnowing, extended and removed."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from agestrata.llm.store import in_small_batches, remove, written

#: Words in a seed.
SEED_WORDS = 5
#: Seeds with more occurrences are dealt out by window, over so many salts.
HOT, SALTS = 10_000, 64
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def _runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` consecutive words, from the hashes of words."""
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        out = out * _BASE + hashes[i : i + len(out)]
    out ^= out >> np.uint64(31)
    return out * _BASE


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def anchors(words: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all seeds, and for every window of ``window`` words the place of its
    smallest seed, the first of equals: the same seed wherever the window stands."""
    seeds = _runs(words, seed)
    view = np.lib.stride_tricks.sliding_window_view(seeds, window - seed + 1)
    return seeds, view.argmin(axis=1) + np.arange(len(view))


def _dealt(doc_id, copy: int, start: int) -> int:
    """Where a place goes, from what the row holds alone: a task that is run again after the
    loss of an executor may meet its rows in another order, and deals them out alike."""
    return xxhash.xxh64_intdigest(f"{doc_id}:{copy}:{start}") >> 1


def _first_of_runs(values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, values[1:] != values[:-1]])


def _seed_rows(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """``hash, doc_id, copy, at``: the winnowed seeds of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, hashes, places = [], [], []
            for i, text in enumerate(batch.column(1)):
                words = words_of(text.as_py())
                if len(words) < window:
                    continue
                seeds, at = anchors(_hashes(words), window, seed)
                at = at[_first_of_runs(at)]
                which.append(np.full(len(at), i))
                hashes.append(seeds[at].view(np.int64))
                places.append(at.astype(np.int32))
            if which:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(hashes)), *(batch.column(c).take(pa.array(np.concatenate(which))) for c in (0, 2)),
                     pa.array(np.concatenate(places))],
                    ["hash", "doc_id", "copy", "at"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_small_batches(docs.select("doc_id", "text", "copy")).mapInArrow(
        run, f"hash long, doc_id {kind}, copy long, at int"
    )


def _occurrences(docs: DataFrame, met: DataFrame, window: int, seed: int) -> DataFrame:
    """Seeds that occur more than once, each with the hashes of the windows it was picked
    for: the seed extended both ways as far as a window can reach. Very frequent seeds
    are split into rows of one window, dealt out over salts by document, text and place, so
    that copies do not meet in one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column(0).to_pylist()
            out = [[] for _ in range(6)]
            for i, (text, copy, met) in enumerate(zip(batch.column(1), batch.column(2), batch.column(3))):
                if not met.is_valid:
                    continue
                hashes = _hashes(words_of(text.as_py()))
                if len(hashes) < window:
                    continue
                seeds, at = anchors(hashes, window, seed)
                whole = _runs(hashes, window).view(np.int64)
                marked = met.values.to_numpy()
                hot = dict(zip((marked >> 1).tolist(), (marked & 1).tolist()))
                first = _first_of_runs(at)
                for s, e in zip(first.tolist(), [*first[1:].tolist(), len(at)]):
                    place = int(at[s])
                    frequent = hot.get(place)
                    if frequent is None:
                        continue
                    key = seeds[place : place + 1]
                    if not frequent:
                        rows = [(int(key.view(np.int64)[0]), -1, s, whole[s:e])]
                    else:
                        keys = (key * _BASE ^ whole[s:e].view(np.uint64)).view(np.int64).tolist()
                        rows = [
                            (k, _dealt(docs[i], copy.as_py(), s + j) % SALTS, s + j, whole[s + j : s + j + 1])
                            for j, k in enumerate(keys)
                        ]
                    for row in rows:
                        for column, value in zip(out, (i, copy.as_py(), *row)):
                            column.append(value)
            if out[0]:
                which, copies, keys, salts, starts, windows = out
                lengths = np.cumsum([0, *map(len, windows)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(which)), pa.array(copies, pa.int64()), pa.array(keys, pa.int64()),
                     pa.array(salts, pa.int32()), pa.array(starts, pa.int32()),
                     pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(np.concatenate(windows)))],
                    ["doc_id", "copy", "key", "salt", "start", "windows"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _joined(docs, met).select("doc_id", "text", "copy", "met").mapInArrow(
        run, f"doc_id {kind}, copy long, key long, salt int, start int, windows array<long>"
    )


def _joined(docs: DataFrame, more: DataFrame) -> DataFrame:
    """``docs`` with what ``more`` has for their doc_id and text."""
    more = more.withColumnsRenamed({"doc_id": "_id", "copy": "_copy"})
    return docs.join(more, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("copy").eqNullSafe(F.col("_copy")), "left")


def _seen_before(rows: DataFrame, kind: str) -> DataFrame:
    """``doc_id, copy, start, run, key, first``: runs of windows that stand earlier too, and
    with ``first`` the first of every salt of a frequent window, which only the other
    salts can show to be a repeat. Rows come in order of document and start, so what was
    seen under a key stood earlier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen = None, {}
        for batch in batches:
            which, starts, runs, keys, firsts = [], [], [], [], []
            columns = [c.to_pylist() for c in batch.columns]
            for i, (doc, copy, key, salt, start, windows) in enumerate(zip(*columns)):
                if (key, salt) != now:
                    now, seen = (key, salt), {}
                length = 0
                for k, w in enumerate([*windows, None]):
                    place = (doc, start + k)
                    if w is not None and seen.setdefault(w, place) != place:
                        length += 1
                        continue
                    if length:
                        which.append(i), starts.append(start + k - length), runs.append(length)
                        keys.append(_dealt(doc, copy, start + k)), firsts.append(False)
                        length = 0
                    if w is not None and salt >= 0:
                        which.append(i), starts.append(start + k), runs.append(1)
                        keys.append(key), firsts.append(True)
            index = pa.array(which, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(index), batch.column(1).take(index), pa.array(starts, pa.int32()),
                 pa.array(runs, pa.int32()), pa.array(keys, pa.int64()), pa.array(firsts, pa.bool_())],
                ["doc_id", "copy", "start", "run", "key", "first"],
            )

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        rows.repartition(n, "key", "salt")
        .sortWithinPartitions("key", "salt", F.col("doc_id").asc_nulls_last(), "start")
        .mapInArrow(run, f"doc_id {kind}, copy long, start int, run int, key long, first boolean")
    )


def remove_repeats(docs: DataFrame, window: int = 20, seed: int = SEED_WORDS) -> DataFrame:
    """``doc_id, n_words, n_removed, kept, spans`` per row: words covered by a window of
    ``window`` words that also starts earlier, in a row with a smaller doc_id or earlier in
    the same one, are removed. ``kept`` is what is left, joined by spaces; ``spans`` are the
    maximal repeats, as first word and end.

    Documents are joined on winnowed seeds of ``seed`` words: every window holds one, and
    equal windows hold the same. Only seeds met more than once go further. They are
    extended both ways by hashes of the windows around them, compared under their seed,
    and windows that overlap or touch add up to maximal repeats. Windows are judged on
    the input, not on what is left.

    A NULL text has no words. Rows that share a doc_id are one document for the order and
    are otherwise apart; equal rows keep or lose the same words. A NULL doc_id comes last.
    Other columns are left out, whatever their names. An empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("copy"))
    seeds = written(_seed_rows(texts, window, seed), "repeats-seeds")
    met = written(
        seeds.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1"), "repeats-met"
    )
    mark = (F.col("at") * 2 + (F.col("n") > HOT).cast("int")).alias("mark")
    marked = seeds.join(met, "hash").select("doc_id", "copy", mark)
    marked = marked.groupBy("doc_id", "copy").agg(F.collect_set("mark").alias("met"))
    marked = written(marked, "repeats-marked")
    remove(seeds)
    remove(met)
    found = _seen_before(_occurrences(texts, marked, window, seed), kind)
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "start")
    first = F.min(F.when(F.col("first"), place)).over(Window.partitionBy("key"))
    repeats = found.withColumn("_repeat", ~F.col("first") | (place != first)).where("_repeat")
    # Equal rows have the same repeats, so a set of them does not grow with their number.
    by_doc = repeats.groupBy("doc_id", "copy").agg(F.collect_set(F.struct("start", "run")).alias("found"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, gone, kept, spans = [], [], [], []
            for text, found in zip(batch.column(1), batch.column(2)):
                words = words_of(text.as_py())
                step = np.zeros(len(words) + 1, np.int64)
                if found.is_valid:
                    f = found.values
                    start, run = f.field("start").to_numpy(), f.field("run").to_numpy()
                    np.add.at(step, start, 1)
                    np.add.at(step, start + run + window - 1, -1)
                covered = np.cumsum(step)[:-1] > 0
                edge = np.flatnonzero(np.diff(np.r_[0, covered.astype(np.int8), 0]))
                counts.append(len(words))
                gone.append(int(covered.sum()))
                kept.append(b" ".join([words[i] for i in np.flatnonzero(~covered)] if gone[-1] else words))
                spans.append([{"start": int(s), "end": int(e)} for s, e in edge.reshape(-1, 2)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()),
                 pa.array([k.decode("utf-8", "surrogatepass") for k in kept], pa.string()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                ["doc_id", "n_words", "n_removed", "kept", "spans"],
            )

    return _joined(texts, by_doc).select("doc_id", "text", "found").mapInArrow(
        keep,
        f"doc_id {kind}, n_words long, n_removed long, kept string, spans array<struct<start: int, end: int>>",
    )

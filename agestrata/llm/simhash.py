"""Near-duplicates by SimHash, found through an inverted index over byte positions."""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from agestrata.llm.components import connected_components
from agestrata.llm.store import in_small_batches, written

SEED = 42
BYTES = 8


def _bits_over_half(hashes: np.ndarray) -> int:
    """A bit of the result is 1 if it is set in over half of the 64-bit hashes."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, BYTES), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_of(text: str | None, shingle: int) -> int:
    """SimHash of a text: A-Z lowered, words split at ASCII white space, ``shingle`` words
    joined by a space and hashed with XXH64, repeats included. Fewer words give one
    shingle, none give 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest = xxhash.xxh64_intdigest
    runs = zip(*(words[i:] for i in range(shingle)))
    hashes = np.fromiter((digest(b" ".join(run), SEED) for run in runs), np.uint64, len(words) - shingle + 1)
    return _bits_over_half(hashes)


def simhash(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, key, fp``: the fingerprint of every whole text as a signed long, and a hash
    of the row's id and text. A NULL text counts as empty. Other columns are left out,
    whatever their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint_of(t.as_py(), shingle) for t in batch.column(1)]
            fps = pa.array(np.array(fps, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), fps], ["doc_id", "key", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_small_batches(docs.select("doc_id", "text", row_key())).mapInArrow(run, f"doc_id {kind}, key long, fp long")


def row_key() -> Column:
    return F.xxhash64("doc_id", "text").alias("key")


def _postings(nodes: DataFrame, distance: int) -> DataFrame:
    """The inverted index: ``places, held, fps`` with the fingerprints that hold the same
    bytes at a set of ``8 - distance`` byte positions, where there are two at least.

    Fingerprints within ``distance`` bits differ in at most that many bytes, so they meet
    in one posting at least. Those in a posting differ only in ``distance`` bytes, so it
    has at most 256 ** distance of them, however many documents there are.
    """
    masks = []
    for free in combinations(range(BYTES), distance):
        mask = (1 << 64) - 1
        for place in free:
            mask &= ~(0xFF << (8 * place))
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    places = F.array(*[F.struct(F.lit(i).alias("places"), F.lit(m).cast("long").alias("mask")) for i, m in enumerate(masks)])
    return (
        nodes.select("fp", F.explode(places).alias("k"))
        .select("k.places", F.col("fp").bitwiseAND(F.col("k.mask")).alias("held"), "fp")
        .groupBy("places", "held")
        .agg(F.collect_list("fp").alias("fps"))
        .where(F.size("fps") > 1)
    )


def _links_within(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges that connect all fingerprints of one posting that are linked in it. The
    equal bytes of a pair are tallied, pairs with the ``8 - distance`` that a link cannot
    lack are kept, and their differing bits are counted. Only fingerprints not reached
    yet are compared, so n of them give less than n edges."""
    fps = np.unique(fps).view(np.uint64)
    planes = fps.view(np.uint8).reshape(len(fps), BYTES)
    unseen, links = np.arange(len(fps)), []
    while len(unseen) > 1:
        reached, unseen = [unseen[0]], unseen[1:]
        while reached and len(unseen):
            i = reached.pop()
            shared = (planes[unseen] == planes[i]).sum(axis=1)
            near = shared >= BYTES - distance
            near[near] = np.bitwise_count(fps[unseen[near]] ^ fps[i]) <= distance
            for j in unseen[near]:
                links.append((int(fps[i].view(np.int64)), int(fps[j].view(np.int64))))
                reached.append(j)
            unseen = unseen[~near]
    return links


def fingerprint_links(nodes: DataFrame, distance: int = 2) -> DataFrame:
    """``a, b``: edges between distinct fingerprints ``fp`` that join the same ones as all
    pairs within ``distance`` bits would."""
    if not 0 < distance < BYTES:
        raise ValueError("distance must be 1 to 7 bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges = [e for fps in batch.column(0) for e in _links_within(fps.values.to_numpy(), distance)]
            a, b = zip(*edges) if edges else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return _postings(nodes, distance).select("fps").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """``doc_id, key, fp, component_id, class_fp`` per row of ``docs``: documents whose
    fingerprints differ in at most ``distance`` bits are linked, and ``component_id`` is the
    smallest doc_id that links lead to; ``class_fp`` is the same for all rows of a component.

    Copies meet in one fingerprint before anything is paired, with map-side combine, so a
    text that fills a third of the rows is one node. NULL texts count as empty; empty texts
    link like others through fingerprint 0. Repeated rows each give a row. A NULL doc_id
    takes part but is never a ``component_id``, unless all of its component are NULL. An
    empty table gives no rows.
    """
    fps = written(simhash(docs, shingle), "simhash")
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    linked = connected_components(fingerprint_links(nodes, distance))
    named = nodes.join(linked, nodes["fp"] == linked["node"], "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("class_fp")
    )
    smallest = named.groupBy("class_fp").agg(F.min("first").alias("component_id"))
    classes = named.join(smallest, "class_fp").select("fp", "class_fp", "component_id")
    return fps.join(classes, "fp").select("doc_id", "key", "fp", "component_id", "class_fp")


def one_of_each(docs: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """The rows of ``docs`` that stay when each component keeps one: that with the smallest
    doc_id, and of several such rows one by a hash. All columns stay. Equal rows are one;
    a component without any doc_id keeps one row too."""
    best = Window.partitionBy("class_fp").orderBy("key")
    chosen = (
        near_duplicates(docs, shingle, distance)
        .where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .withColumn("_n", F.row_number().over(best)).where("_n = 1")
        .select(F.col("key").alias("_key"), F.col("doc_id").alias("_id"))
    )
    names = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*names).alias("_row"), row_key().alias("_own"), F.col("doc_id").alias("_doc"))
    same = Window.partitionBy("_own", "_doc").orderBy("_own")
    return (
        rows.join(chosen, (F.col("_own") == F.col("_key")) & F.col("_doc").eqNullSafe(F.col("_id")))
        .withColumn("_n", F.row_number().over(same)).where("_n = 1")
        .select("_row.*")
    )


def hex16(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))

"""Connected components of an edge table, by rounds of joins."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agestrata.llm.store import remove, written


def _nearest(pairs: DataFrame) -> DataFrame:
    """``u, m``: the smallest of every node and its neighbours."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _state(edges: DataFrame):
    """A count and an order-free checksum of an edge table, both single numbers."""
    row = edges.agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
    ).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges (a long, b long)``; the component is
    its smallest node.

    Each round hangs larger neighbours on the smallest one seen from a node, first over
    all neighbours and then over the smaller ones (large star, small star), until the
    table is a set of stars. A node's neighbours are never gathered: rounds are minima
    with map-side combine and joins, whose hot keys AQE can split. Every round is
    written, and the one before it removed.

    Loops and repeated edges are harmless, NULL ends are left out, an empty table gives
    an empty result.
    """
    now = written(
        edges.where("a is not null and b is not null and a != b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "components",
    )
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            both.join(_nearest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).distinct()
        low = _nearest(large)
        small = (
            large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .where("u != v")
            .distinct()
        )
        new = written(small, "components")
        remove(now)
        now, before, state = new, state, _state(new)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )

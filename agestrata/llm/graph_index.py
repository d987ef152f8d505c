"""Nearest neighbours by a robust-pruned directed graph in every shard."""

import math


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from agestrata.llm.store import written

#: Vectors of a shard and queries of a block, on average.
SHARD_ROWS, BLOCK_ROWS = 8192, 2048
#: Out-edges of a node, width of searches that build the graph, of those that query it,
#: and the factor by which pruning is relaxed.
DEGREE, BUILD_BEAM, BEAM, RELAX = 32, 64, 96, 1.2
#: Nodes that searches begin at: one near the middle, some far from each other, and others at
#: random, so that a crowd of near copies does not hold a search that has to leave it.
ENTRIES = 24
#: Nodes that are inserted together; searches of so many run side by side.
BATCH = 256
NO_NODE = -1


def _distances(x: np.ndarray, nodes: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances from each query to its own row of nodes; infinite for no node. From
    the differences, so that near copies far from zero are told apart."""
    apart = x[nodes] - q[:, None, :]
    d = np.einsum("bnd,bnd->bn", apart, apart)
    d[nodes == NO_NODE] = np.inf
    return d


def _scaled(x: np.ndarray) -> tuple[np.ndarray, float]:
    """``x`` over its largest component, so that no square overflows, and that component."""
    most = float(np.abs(x).max(initial=0)) or 1.0
    return x / most, most


def _lengths(apart: np.ndarray) -> np.ndarray:
    """Euclidean lengths of the rows; scaled where squares leave the range of doubles."""
    most = np.abs(apart).max(axis=1, initial=0)
    far = (most >= 1e150) | ((most > 0) & (most <= 1e-120))
    out = np.zeros(len(apart))
    out[~far] = np.sqrt((apart[~far] ** 2).sum(axis=1))
    scale = most[far]
    out[far] = np.sqrt(((apart[far] / scale[:, None]) ** 2).sum(axis=1)) * scale
    return out


def entry_nodes(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """At most ``ENTRIES`` different rows: the one nearest the mean, then a third of them each
    as far as can be from those before, then rows at random."""
    nearest = ((x - x.mean(axis=0)) ** 2).sum(axis=1)
    chosen = [int(nearest.argmin())]
    apart = ((x - x[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) <= ENTRIES // 3 and apart.max() > 0:
        chosen.append(int(apart.argmax()))
        apart = np.minimum(apart, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    others = np.setdiff1d(np.random.default_rng(seed).permutation(len(x))[:ENTRIES], chosen)
    return np.r_[chosen, others][:ENTRIES].astype(np.int64)


def beam_search(x, graph, entries: np.ndarray, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """``width`` best nodes found for each query and their squared distances, nearest first.

    Greedy: the nearest node that was not expanded yet is, and its out-edges compete for
    the beam, until each node of a beam has been expanded. Queries advance together.
    """
    n, rows = len(q), np.arange(len(q))
    nodes = np.full((n, width), NO_NODE, np.int64)
    dist = np.full((n, width), np.inf)
    starts = np.asarray(entries)[None, :width].repeat(n, 0)
    d = _distances(x, starts, q)
    order = np.argsort(d, axis=1, kind="stable")
    nodes[:, : starts.shape[1]] = np.take_along_axis(starts, order, 1)
    dist[:, : starts.shape[1]] = np.take_along_axis(d, order, 1)
    done = np.zeros((n, width), bool)
    active = rows
    while len(active):
        open_ = ~done[active] & np.isfinite(dist[active])
        some = open_.any(axis=1)
        active, open_ = active[some], open_[some]
        if not len(active):
            break
        at = open_.argmax(axis=1)
        done[active, at] = True
        near = graph[nodes[active, at]]
        d = _distances(x, near, q[active])
        # A node that is in the beam already does not enter it again.
        d[(near[:, :, None] == nodes[active][:, None, :]).any(axis=2)] = np.inf
        all_nodes = np.concatenate([nodes[active], near], axis=1)
        all_dist = np.concatenate([dist[active], d], axis=1)
        all_done = np.concatenate([done[active], np.zeros(near.shape, bool)], axis=1)
        order = np.argsort(all_dist, axis=1, kind="stable")[:, :width]
        nodes[active] = np.take_along_axis(all_nodes, order, 1)
        dist[active] = np.take_along_axis(all_dist, order, 1)
        done[active] = np.take_along_axis(all_done, order, 1)
    nodes[~np.isfinite(dist)] = NO_NODE
    return nodes, dist


def robust_prune(x, own: np.ndarray, candidates: np.ndarray, dist: np.ndarray, degree: int, relax: float):
    """Out-edges for each node of ``own``: again and again the nearest candidate left, after
    which candidates that are closer to it than to the node, by the factor ``relax``, go.
    What stays is near or in a direction of its own."""
    b, c = candidates.shape
    dist = np.where((candidates == NO_NODE) | (candidates == own[:, None]), np.inf, dist)
    order = np.argsort(dist, axis=1, kind="stable")
    candidates, dist = np.take_along_axis(candidates, order, 1), np.take_along_axis(dist, order, 1)
    # Seen from the node, so that what is near it is measured finely.
    v = x[candidates] - x[own][:, None, :]
    norms = np.einsum("bnd,bnd->bn", v, v)
    between = norms[:, :, None] + norms[:, None, :] - 2 * (v @ v.transpose(0, 2, 1))
    alive, edges = np.isfinite(dist), np.full((b, degree), NO_NODE, np.int64)
    rows, squared = np.arange(b), relax * relax
    for k in range(degree):
        some = alive.any(axis=1)
        if not some.any():
            break
        at = alive.argmax(axis=1)
        edges[some, k] = candidates[rows, at][some]
        alive &= squared * np.maximum(between[rows, at], 0) > dist
        alive[rows, at] = False
    return edges


def build_graph(x: np.ndarray, degree: int, beam: int, relax: float, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The graph over the rows of ``x`` as an array of out-edges, and its entries. The
    others enter in a random order after those, batches of growing size at a time, searched
    for in the graph so far; edges are pruned, and so are the lists of the nodes that get
    edges back."""
    n = len(x)
    entries = entry_nodes(x, seed)
    graph = np.full((n, degree), NO_NODE, np.int64)
    order = np.random.default_rng(seed).permutation(n)
    order = np.r_[entries, order[~np.isin(order, entries)]]
    for passes, slack in ((0, 1.0), (1, relax)):
        at = 1 if passes == 0 else 0
        while at < n:
            step = min(BATCH, max(1, at)) if passes == 0 else BATCH
            own = order[at : at + step]
            begin = entries if passes else entries[:at]
            at += step
            found, dist = beam_search(x, graph, begin, x[own], beam)
            mates = own[None, :].repeat(len(own), 0)
            if passes == 0 and len(own) > 1:
                # Those that enter together do not find each other in the graph yet.
                d = _distances(x, mates, x[own])
                keep = np.argsort(d, axis=1)[:, : min(len(own), degree)]
                found = np.concatenate([found, np.take_along_axis(mates, keep, 1)], axis=1)
                dist = np.concatenate([dist, np.take_along_axis(d, keep, 1)], axis=1)
            elif passes:
                old = graph[own]
                fresh = ~(old[:, :, None] == found[:, None, :]).any(axis=2)
                old = np.where(fresh, old, NO_NODE)
                d = _distances(x, old, x[own])
                found, dist = np.concatenate([found, old], axis=1), np.concatenate([dist, d], axis=1)
            graph[own] = robust_prune(x, own, found, dist, degree, slack)
            _add_back(x, graph, own, degree, slack)
    return graph, entries


def _add_back(x, graph, own, degree, slack) -> None:
    """Edges back to ``own`` from the nodes they point to; lists that overflow are pruned."""
    source = np.repeat(own, degree)
    target = graph[own].ravel()
    source, target = source[target != NO_NODE], target[target != NO_NODE]
    have = (graph[target] == source[:, None]).any(axis=1)
    source, target = source[~have], target[~have]
    if not len(target):
        return
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    nodes, first, count = np.unique(target, return_index=True, return_counts=True)
    wide = np.full((len(nodes), int(count.max())), NO_NODE, np.int64)
    wide[np.repeat(np.arange(len(nodes)), count), np.arange(len(target)) - np.repeat(first, count)] = source
    both = np.concatenate([graph[nodes], wide], axis=1)
    size = (both != NO_NODE).sum(axis=1)
    fits = size <= degree
    packed = np.take_along_axis(both, np.argsort(both == NO_NODE, axis=1, kind="stable"), 1)
    graph[nodes[fits]] = packed[fits][:, :degree]
    if not fits.all():
        over, lists = nodes[~fits], packed[~fits]
        for i in range(0, len(over), BATCH):
            part, cand = over[i : i + BATCH], lists[i : i + BATCH]
            d = _distances(x, cand, x[part])
            graph[part] = robust_prune(x, part, cand, d, degree, slack)


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, v, dim`` of the vectors that take part: not NULL, not empty, not zero, all
    components finite, and with a vec_id."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vectors.select("vec_id", v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda c: c != 0)
    ).withColumn("dim", F.size("v"))


def _classes(vectors: DataFrame, k: int) -> DataFrame:
    """``v, dim, ids``: distinct vectors, each with its ``k + 1`` smallest ids; others of a
    class can never be among the ``k`` nearest. The limit is applied before the shuffle
    too, so a vector that fills a third of the rows sends few of them."""
    first = Window.partitionBy("v").orderBy(F.col("vec_id").asc_nulls_last())
    return (
        vectors.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k + 1)
        .groupBy("v", "dim").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    )


def build_index(vectors: DataFrame, k: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``dim, shard, nodes``: the graph of every shard, as one row of arrays. Distinct vectors
    of a dimension are dealt out over shards by their hash; each shard is built by one
    task from ``shard_rows`` vectors on average, so shards grow in number, not in size."""
    classes = written(_classes(vectors, k), "graph-classes")
    sizes = {r["dim"]: r["count"] for r in classes.groupBy("dim").count().collect()}
    shards = F.lit(0)
    for dim, n in sizes.items():
        shards = F.when(F.col("dim") == dim, F.pmod(F.xxhash64("v"), F.lit(math.ceil(n / shard_rows)))).otherwise(shards)

    def build(key, rows: pd.DataFrame) -> pd.DataFrame:
        x = np.array(rows["v"].tolist(), float)
        graph, entries = build_graph(_scaled(x)[0], DEGREE, BUILD_BEAM, RELAX)
        ids = rows["ids"].tolist()
        return pd.DataFrame({
            "dim": [key[0]], "shard": [key[1]], "entries": [entries.astype(np.int32)], "vectors": [x.ravel()],
            "edges": [graph.astype(np.int32).ravel()], "ids": [np.concatenate(ids)], "n_ids": [[len(i) for i in ids]],
        })

    dealt = classes.withColumn("shard", shards.cast("int"))
    return written(
        dealt.groupBy("dim", "shard").applyInPandas(
            build, "dim int, shard int, entries array<int>, vectors array<double>, edges array<int>, ids array<long>, n_ids array<int>"
        ),
        "graph-index",
    )


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row ``vec_id, embedding`` of ``queries`` the
    ``k`` nearest found among ``vectors``, by Euclidean distance in double precision, its own
    vec_id left out; ties go to the smaller vec_id.

    Approximate: beam search in the graph of every shard of the query's dimension, blocks
    of queries against shards; every vector is indexed. Equal vectors are one node, so
    they never crowd a beam. Vectors that are NULL, zero or not finite take no part.
    Rows without vec_id neither. A repeated (vec_id, vector) is one candidate and one query. Other columns are left out, whatever their names.
    """
    index = build_index(usable(vectors).distinct(), k, shard_rows)
    asked = written(usable(queries).distinct(), "graph-queries")
    blocks = max(1, math.ceil(asked.count() / BLOCK_ROWS))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block")
    shards = index.groupBy("dim").agg(F.collect_list("shard").alias("shards"))
    dealt = asked.select("vec_id", "v", "dim", block).join(shards, "dim")
    dealt = dealt.select("vec_id", "v", "dim", "block", F.explode("shards").alias("shard"))
    graphs = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(key, graph: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": pd.Series([], dtype="int64"), "vec_id": pd.Series([], dtype="int64"), "score": pd.Series([], dtype="float64")})
        if graph.empty or rows.empty:
            return empty
        g = graph.iloc[0]
        x = np.array(g["vectors"], float).reshape(-1, key[0])
        edges = np.array(g["edges"], np.int64).reshape(len(x), DEGREE)
        counts = np.array(g["n_ids"])
        ids, first = np.array(g["ids"]), np.r_[0, np.cumsum(counts)]
        scaled, most = _scaled(x)
        out = []
        for i in range(0, len(rows), BATCH):
            part = rows.iloc[i : i + BATCH]
            q = np.array(part["v"].tolist(), float)
            # A query beyond what squares can hold is as far from all of them.
            with np.errstate(over="ignore"):
                asked = np.clip(q / most, -1e150, 1e150)
            nodes, _ = beam_search(scaled, edges, np.array(g["entries"], np.int64), asked, BEAM)
            for query, own, found in zip(part["vec_id"].tolist(), q, nodes):
                found = found[found != NO_NODE]
                exact = _lengths(x[found] - own)
                pairs = [(s, v) for s, c in zip(exact.tolist(), found) for v in ids[first[c] : first[c + 1]].tolist() if v != query]
                out += [(query, v, s) for s, v in sorted(pairs)[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]) if out else empty

    by = ["dim", "shard", "block"]
    dealt = dealt.toDF(*dealt.columns)
    found = graphs.groupBy(*by).cogroup(dealt.groupBy(*by)).applyInPandas(
        search, "query_id long, vec_id long, score double"
    )
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )

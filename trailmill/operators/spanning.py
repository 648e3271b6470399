"""Minimum spanning forests by Borůvka rounds, and what they hold: single linkage and density clusters at any height."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import links
from .storage import discard, stored


def least_edges(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The places of the edges of the minimum spanning forest of edges a < b, ties of weight to the smaller a, then b."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    root, order, out = list(range(len(nodes))), np.lexsort((b, a, w)), []
    x, y = ends[: len(a)][order].tolist(), ends[len(a) :][order].tolist()
    for i, (p, q) in enumerate(zip(x, y, strict=True)):
        while root[p] != p:
            root[p] = p = root[root[p]]
        while root[q] != q:
            root[q] = q = root[root[q]]
        if p != q:
            root[q] = p
            out.append(i)
    return order[out]


def _thinned(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Edges (a, b, w) without those that the forest of a task's own edges does without: they are the last ones on some circle, and no forest of all edges has them."""

    def thin(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b, w = (np.concatenate([x.column(c).to_numpy() for x in held]) for c in "abw")
        at = least_edges(a, b, w)
        return pa.RecordBatch.from_arrays([pa.array(x[at]) for x in (a, b, w)], names=list("abw"))

    held: list[pa.RecordBatch] = []
    for x in batches:
        held.append(x)
        if sum(h.num_rows for h in held) >= most:
            held = [thin(held)]
            if held[0].num_rows > most // 2:
                yield held.pop()
    if held:
        yield thin(held)


def spanning_forest(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(a, b, w) with a < b: the minimum spanning forest of edges (a, b, w), ties of weight to the smaller a, then b, so that it is one and the same whatever the partitions.

    Each round every component takes its least edge to another one, and what hangs together by these becomes one; of the edges between two components only the least goes on. Rounds are cut from their lineage by tables in the
    shared folder; there are no more than the logarithm of the number of nodes. Loops and edges with a null count for nothing; parallel edges are as good as their least. Before all, each task's edges are thinned to a forest of their own. Nodes are integers.
    """
    plain = edges.filter("a <> b AND w IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("w").cast("double").alias("w"))
    plain = plain.selectExpr("CAST(a AS BIGINT) AS a", "CAST(b AS BIGINT) AS b", "w").mapInArrow(_thinned, "a long, b long, w double")
    now = stored(plain.groupBy("a", "b").agg(F.min("w").alias("w")).select(F.col("a").alias("ca"), F.col("b").alias("cb"), F.struct("w", "a", "b").alias("e")), "edges")
    kept = []
    for _ in range(max_rounds):
        if now.isEmpty():
            out = [stored(plain.limit(0), "none")] if not kept else kept
            first, *rest = out
            for x in rest:
                first = first.unionByName(x)
            return first
        least = now.select(F.col("ca").alias("c"), "e").union(now.select("cb", "e")).groupBy("c").agg(F.min("e").alias("e"))
        # the edge's own components say which two it ties
        chosen = stored(least.select("e").distinct().join(now.select(F.col("e").alias("_e"), "ca", "cb"), F.col("e") == F.col("_e")).select("e.a", "e.b", "e.w", "ca", "cb"), "chosen")
        kept.append(chosen.select("a", "b", "w"))
        roots = stored(links.components(chosen, a="ca", b="cb"), "roots")
        a, b = (roots.select(F.col("node").alias(f"_{c}"), F.col("root").alias(f"r{c}")) for c in ("ca", "cb"))
        moved = now.join(a, F.col("ca") == F.col("_ca")).join(b, F.col("cb") == F.col("_cb")).filter("rca <> rcb")
        new = stored(moved.groupBy(F.least("rca", "rcb").alias("ca"), F.greatest("rca", "rcb").alias("cb")).agg(F.min("e").alias("e")), "edges")
        discard(now, roots)
        now = new
    raise RuntimeError(f"no end within {max_rounds} rounds")


def heights(forest: DataFrame) -> DataFrame:
    """(height, merges): at which heights single linkage merges clusters, and how many merges there are: the forest's weights, which are the same for every minimum forest."""
    return forest.groupBy(F.col("w").alias("height")).agg(F.count("*").alias("merges"))


def clusters_at(nodes: DataFrame, forest: DataFrame, at: list[float]) -> DataFrame:
    """(height, id, cluster): single linkage of nodes (id) cut at each height, from one forest; cluster is the smallest id that edges up to the height reach."""
    out = None
    for h in at:
        root = links.components(forest.filter(F.col("w") <= h))
        one = nodes.select("id").join(root.withColumnRenamed("node", "id"), "id", "left").select(F.lit(float(h)).alias("height"), "id", F.coalesce("root", "id").alias("cluster"))
        out = one if out is None else out.unionByName(one)
    return out


def core_distances(nodes: DataFrame, pairs: DataFrame, min_points: int) -> DataFrame:
    """(id, core): the distance within which a node has min_points nodes, itself included; null where its pairs (a, b, distance) don't reach so far. Where nodes have a column n, each stands for n nodes at one place."""
    if min_points < 2:
        return nodes.select("id", F.lit(0.0).alias("core"))
    size = nodes.select("id", F.col("n") if "n" in nodes.columns else F.lit(1).cast("long").alias("n"))
    both = pairs.select(F.col("a").alias("id"), "b", "distance").union(pairs.select("b", "a", "distance"))
    order = Window.partitionBy("id").orderBy("distance", "b")
    # every neighbour counts for one at least, so no more are wanted
    near = both.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= min_points - 1).join(size.select(F.col("id").alias("b"), F.col("n").alias("more")), "b")
    near = near.withColumn("sum", F.sum("more").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    core = near.join(size, "id").filter(F.col("n") + F.col("sum") >= min_points).groupBy("id").agg(F.min("distance").alias("core"))
    return size.join(core, "id", "left").select("id", F.when(F.col("n") >= min_points, 0.0).otherwise(F.col("core")).alias("core"))


def reachability_forest(nodes: DataFrame, pairs: DataFrame, min_points: int) -> tuple[DataFrame, DataFrame]:
    """core_distances(), and the minimum spanning forest of mutual reachability: the largest of a pair's distance and its ends' core distances. Pairs with an end without core distance are no links."""
    core = stored(core_distances(nodes, pairs, min_points), "cores")
    a, b = (core.filter("core IS NOT NULL").select(F.col("id").alias(e), F.col("core").alias(f"core_{e}")) for e in ("a", "b"))
    met = pairs.join(a, "a").join(b, "b").select("a", "b", F.greatest("distance", "core_a", "core_b").alias("w"))
    return core, spanning_forest(met)


def density_clusters(core: DataFrame, forest: DataFrame, at: list[float]) -> DataFrame:
    """(radius, id, cluster) for each radius: density clusters of the nodes whose core distance is no more than the radius, null for all others, all from one forest of mutual reachability."""
    out = None
    for r in at:
        dense = core.filter(F.col("core") <= r).select("id")
        one = core.select("id").join(clusters_at(dense, forest, [r]).select("id", "cluster"), "id", "left").select(F.lit(float(r)).alias("radius"), "id", "cluster")
        out = one if out is None else out.unionByName(one)
    return out

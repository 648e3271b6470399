"""Exact neighbours by a tree of boxes: queries meet only the blocks of rows that can hold one of their neighbours.

The tree has two levels. The upper one is cut at medians of a bounded sample, each time across the widest axis, so it fits on every task; the rows of each of its
leaves are cut again, by their own medians, into blocks. Boxes are those of all rows in a block or leaf, so results don't depend on the sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored

#: How much nearer a box must be than the k-th best to be left out: distances that differ by rounding are ties.
_SLACK = 1e-7


def _matrix(lists: pa.Array) -> np.ndarray:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 0)


def _unpacked(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def cuts(x: np.ndarray, leaves: int) -> list[tuple[int, float, int, int]]:
    """Inner nodes (axis, value, left, right) of a tree that halves x by medians across its widest axis; children from 0 on are nodes, below it leaves (-1 - leaf). Rows up to the value go left."""
    nodes: list[tuple[int, float, int, int]] = []
    made = 0

    def grow(rows: np.ndarray, depth: int) -> int:
        nonlocal made
        spread = np.ptp(x[rows], axis=0) if len(rows) else np.zeros(0)
        axis = int(spread.argmax()) if len(spread) else 0
        if 2 << depth > leaves or not len(spread) or spread[axis] == 0:
            made += 1
            return -made
        v = x[rows, axis]
        value = float(np.sort(v)[(len(v) - 1) // 2])
        left = v <= value
        if left.all():  # the median is the largest value
            value = float(v[v < value].max())
            left = v <= value
        at = len(nodes)
        nodes.append((axis, value, 0, 0))
        nodes[at] = (axis, value, grow(rows[left], depth + 1), grow(rows[~left], depth + 1))
        return at

    grow(np.arange(len(x)), 0)
    return nodes


def leaf_of(nodes: list[tuple[int, float, int, int]], x: np.ndarray) -> np.ndarray:
    """The leaf that each row of x falls to."""
    out = np.zeros(len(x), np.int64)
    if not nodes:
        return out
    axis, value, left, right = (np.array(c) for c in zip(*nodes, strict=True))
    at, live = np.zeros(len(x), np.int64), np.arange(len(x))
    while len(live):
        n = at[live]
        at[live] = np.where(x[live, axis[n]] <= value[n], left[n], right[n])
        done = live[at[live] < 0]
        out[done] = -1 - at[done]
        live = live[at[live] >= 0]
    return out


def box_distance(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Distance of each row of q to each box."""
    out = np.zeros((len(q), len(low)))
    for d in range(q.shape[1]):  # axis by axis, so that no array of all three sizes stands in memory
        v = q[:, d, None]
        gap = np.maximum(np.maximum(low[None, :, d] - v, v - high[None, :, d]), 0)
        out += gap * gap
    return np.sqrt(out)


class SpaceTree:
    """The upper nodes and the blocks (leaf, block, n, least, low, high, ids, vs) of the rows of a table (id: long, v: array<double>).

    Null vectors take no part; components must be finite and vectors of one length. sample rows, those first by a hash of their id, reach the driver.
    """

    def __init__(self, rows: DataFrame, *, leaves: int = 256, block: int = 256, sample: int = 16_384, group: int = 32_768) -> None:
        spark = rows.sparkSession
        rows = rows.select("id", F.col("v").cast("array<double>").alias("v")).filter("v IS NOT NULL")
        some = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()
        x = np.array([r[0] for r in some], float)
        self.dim = x.shape[1] if len(x) else 0
        self.nodes = nodes = cuts(x, max(1, min(leaves, len(x) // 8))) if len(x) else []

        @F.arrow_udf("int")
        def leaf(v: pa.Array) -> pa.Array:
            return pa.array(leaf_of(nodes, _matrix(v)).astype(np.int32))

        rows = stored(rows.withColumn("leaf", leaf("v")), "leaves")
        # a leaf of more than group rows, such as one of equal vectors, is cut by hash of the id
        size = rows.groupBy(F.col("leaf").alias("_leaf")).agg(F.ceil(F.count("*") / group).cast("int").alias("pieces"))
        dealt = rows.join(F.broadcast(size), F.col("leaf") == F.col("_leaf")).withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"))

        def pack(t: pa.Table) -> pa.Table:
            ids, x = t.column("id").to_numpy(), _matrix(t.column("v"))
            own = leaf_of(cuts(x, 1 << max(0, int(np.ceil(np.log2(max(1, len(ids) / block)))))), x)
            order = np.lexsort((ids, own))
            ids, x, own = ids[order], x[order], own[order]
            edge = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(ids)]
            parts = [(a, min(a + block, z)) for s, z in zip(edge, edge[1:], strict=False) for a in range(s, z, block)]  # equal vectors aren't cut by medians
            cols = [
                pa.array([t.column("leaf")[0].as_py()] * len(parts), pa.int32()), pa.array([int(ids[a]) for a, _ in parts], pa.int64()), pa.array([z - a for a, z in parts], pa.int32()),
                *[pa.array([f(x[a:z], axis=0).tolist() for a, z in parts], pa.list_(pa.float64())) for f in (np.min, np.max)],
                pa.array([ids[a:z].astype(np.int64).tobytes() for a, z in parts], pa.binary()), pa.array([x[a:z].tobytes() for a, z in parts], pa.binary()),
            ]
            return pa.Table.from_arrays(cols, names=["leaf", "first", "n", "low", "high", "ids", "vs"])

        blocks = dealt.select("leaf", "piece", "id", "v").groupBy("leaf", "piece").applyInArrow(pack, "leaf int, first long, n int, low array<double>, high array<double>, ids binary, vs binary")
        self.blocks = stored(blocks.withColumn("block", F.monotonically_increasing_id()), "blocks")
        axes = range(self.dim)
        top = self.blocks.groupBy("leaf").agg(F.sum("n").alias("n"), *[F.min(F.col("low")[i]).alias(f"l{i}") for i in axes], *[F.max(F.col("high")[i]).alias(f"h{i}") for i in axes])
        # as many rows as the upper tree has leaves
        found = sorted(tuple(r) for r in top.select("leaf", "n", F.array(*[f"l{i}" for i in axes]).alias("low"), F.array(*[f"h{i}" for i in axes]).alias("high")).collect()) if self.dim else []
        self.leaves = np.array([r[0] for r in found], np.int64)
        self.low, self.high = (np.array([r[k] for r in found], float).reshape(len(found), self.dim) for k in (2, 3))
        self.spark = spark

    def _met(self, pairs: DataFrame, k: int | None, exclude_self: bool, chunk: int) -> DataFrame:
        """(query_id, id, distance) of the rows of the blocks that pairs (block, query_id, q, limit) name, no farther than limit; with k no more than the k best of a block, ties at the edge included.

        The queries of a block meet it by chunks, so a block that very many queries name is no single task's."""
        dim = self.dim

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                block = b.column("block").to_numpy()
                edge = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)] if len(block) else [0]
                ids, limit, q = b.column("query_id").to_numpy(), b.column("limit").to_numpy(), _matrix(b.column("q"))
                parts = [(a, min(a + chunk, z)) for s, z in zip(edge, edge[1:], strict=False) for a in range(s, z, chunk)]
                cols = [pa.array([int(block[a]) for a, _ in parts], pa.int64()), *[pa.array([x[a:z].tobytes() for a, z in parts], pa.binary()) for x in (ids, limit, q)]]
                yield pa.RecordBatch.from_arrays(cols, names=["_block", "q_ids", "limits", "qs"])

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    r = {c: b.column(c)[i].as_py() for c in b.schema.names}
                    ids, x = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["vs"], np.float64).reshape(-1, dim)
                    q_ids, limit, q = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["limits"], np.float64), np.frombuffer(r["qs"], np.float64).reshape(-1, dim)
                    d = np.zeros((len(q), len(x)))
                    for axis in range(dim):
                        gap = q[:, axis, None] - x[None, :, axis]
                        d += gap * gap
                    d = np.sqrt(d)
                    if exclude_self:
                        d[q_ids[:, None] == ids[None, :]] = np.inf
                    if k is not None:
                        edge = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
                        limit = np.minimum(limit, edge)
                    at, j = np.nonzero((d <= limit[:, None] + _SLACK) & np.isfinite(d))
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[at]), pa.array(ids[j]), pa.array(d[at, j])], names=["query_id", "id", "distance"])

        packed = pairs.select("block", "query_id", "limit", "q").repartition("block").sortWithinPartitions("block").mapInArrow(gather, "_block long, q_ids binary, limits binary, qs binary")
        return packed.join(self.blocks.select("block", "ids", "vs"), F.col("_block") == F.col("block")).drop("_block", "block").mapInArrow(meet, "query_id long, id long, distance double")

    def reached(self, queries: DataFrame) -> DataFrame:
        """(block, query_id, q, limit, gap) for each block whose box is no farther from a query (query_id, q, limit) than its limit; gap is that distance."""
        low, high, leaves = self.low, self.high, self.leaves

        @F.arrow_udf("array<int>")
        def near(q: pa.Array, limit: pa.Array) -> pa.Array:
            d = box_distance(_matrix(q), low, high) <= limit.to_numpy(zero_copy_only=False)[:, None] + _SLACK
            return pa.array([leaves[x].astype(np.int32).tolist() for x in d], pa.list_(pa.int32()))

        @F.arrow_udf("double")
        def gap(q: pa.Array, lo: pa.Array, hi: pa.Array) -> pa.Array:
            a, b, c = _matrix(q), _matrix(lo), _matrix(hi)
            away = np.maximum(np.maximum(b - a, a - c), 0)
            return pa.array(np.sqrt((away * away).sum(axis=1)) if len(a) else np.zeros(0))

        at = queries.select("query_id", "q", "limit", F.explode(near("q", "limit")).alias("_leaf"))
        met = at.join(self.blocks.select("leaf", "block", "low", "high", "n"), F.col("_leaf") == F.col("leaf"))
        return met.withColumn("gap", gap("q", "low", "high")).filter(F.col("gap") <= F.col("limit") + _SLACK).select("block", "query_id", "q", "limit", "gap", "n")

    def nearest(self, queries: DataFrame, *, k: int | None = None, radius: float | None = None, exclude_self: bool = True, chunk: int = 1024) -> DataFrame:
        """query_id, id, distance and rank of the k nearest rows of each query (id, v), ties to the smaller id; or query_id, id and distance of all within radius. Distances are Euclidean.

        With k, a query first meets the nearest blocks of the nearest leaf that hold k rows between them; the k-th best of these bounds how far other boxes may be. Null query vectors have no neighbours.
        """
        if (k is None) == (radius is None):
            raise ValueError("give k or radius")
        q = queries.select(F.col("id").alias("query_id"), F.col("v").cast("array<double>").alias("q")).filter("q IS NOT NULL")
        if not self.dim:
            none = q.select("query_id", F.lit(0).cast("long").alias("id"), F.lit(0.0).alias("distance")).filter("false")
            return none if k is None else none.withColumn("rank", F.lit(1))
        if k is None:
            return self._met(self.reached(q.withColumn("limit", F.lit(float(radius)))), None, exclude_self, chunk).filter(F.col("distance") <= radius)
        limited = stored(q.join(self.limits(q, k, exclude_self, chunk), "query_id", "left").withColumn("limit", F.coalesce("limit", F.lit(float("inf")))), "limits")
        found = self._met(self.reached(limited), k, exclude_self, chunk)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("distance", 9), "id"))
        return found.withColumn("rank", rank).filter(F.col("rank") <= k)

    def limits(self, q: DataFrame, k: int, exclude_self: bool, chunk: int = 1024) -> DataFrame:
        """(query_id, limit): a distance within which each query (query_id, q) has k rows; queries whose nearest leaf has fewer don't come out."""
        low, high, leaves = self.low, self.high, self.leaves

        @F.arrow_udf("int")
        def home(v: pa.Array) -> pa.Array:
            return pa.array(leaves[box_distance(_matrix(v), low, high).argmin(axis=1)].astype(np.int32) if len(v) else [], pa.int32())

        boxes = self.blocks.select("leaf", "block", "low", "high", "n")
        met = q.withColumn("_leaf", home("q")).join(boxes, F.col("_leaf") == F.col("leaf"))
        middle = F.zip_with("low", "high", lambda a, b: (a + b) / 2)
        away = F.aggregate(F.zip_with("q", middle, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
        # the block whose middle is nearest, and more until there are rows enough
        order = Window.partitionBy("query_id").orderBy(away, "block")
        first = met.withColumn("before", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).filter(F.col("before") < k + int(exclude_self))
        some = self._met(first.select("block", "query_id", "q", F.lit(float("inf")).alias("limit")), k, exclude_self, chunk)
        best = some.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("distance"))).filter(F.col("r") == k)
        return best.select("query_id", F.col("distance").alias("limit"))

    def share_met(self, queries: DataFrame, k: int) -> float:
        """The share of all meetings of queries and blocks that the search for k neighbours has in its last round."""
        q = queries.select(F.col("id").alias("query_id"), F.col("v").cast("array<double>").alias("q"))
        met = self.reached(q.join(self.limits(q, k, True), "query_id")).count()
        return met / max(1, queries.count() * self.blocks.count())

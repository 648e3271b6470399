"""Exact top-k inner-product search by an impact-ordered, score-at-a-time index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Quantised components are below this in size; others are an error.
LIMIT = 1 << 61


def exact(vectors: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products, in 64 bits where these surely hold every sum, else by integers of any size; an OverflowError where one doesn't fit into 64 bits."""
    if _bound(vectors, q) < 2.0**62:
        return vectors @ q
    return np.array([int(x) for x in vectors.astype(object) @ q.astype(object)], np.int64) if len(vectors) else np.zeros(0, np.int64)


def _bound(vectors: np.ndarray, q: np.ndarray) -> float:
    return float(np.abs(vectors).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, len(q))


class ImpactIndex:
    """Postings of a block of integer vectors: for each dimension the rows in segments of one quantised value range, with the range's bounds."""

    def __init__(self, vectors: np.ndarray, levels: int = 32) -> None:
        self.vectors = vectors.astype(np.int64)
        n, d = vectors.shape
        self.rows, self.start, self.dim, self.low, self.high = [], [], [], [], []
        at = 0
        for j in range(d):
            v = self.vectors[:, j]
            lo, hi = int(v.min()), int(v.max())
            step = max(1, -(-(hi - lo + 1) // levels))
            level = (v - lo) // step
            order = np.argsort(level, kind="stable")
            kinds, first = np.unique(level[order], return_index=True)
            self.rows.append(order)
            self.start.append(first + at)
            self.dim.append(np.full(len(kinds), j))
            self.low.append(np.minimum.reduceat(v[order], first))
            self.high.append(np.maximum.reduceat(v[order], first))
            at += n
        self.rows = np.concatenate(self.rows)
        self.start = np.concatenate(self.start)
        self.length = np.diff(np.append(self.start, at))
        self.dim, self.low, self.high = np.concatenate(self.dim), np.concatenate(self.low), np.concatenate(self.high)

    def search(self, q: np.ndarray, k: int, allowed: np.ndarray, floor: int | None = None, few: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """Rows (of those allowed) that can be among the k best, with exact scores; all rows scoring the k-th best or more are among them, as far as they reach floor.

        Segments are taken in descending impact, the most that a member gains over the dimension's least. After each
        of a few rounds every row's bound is what it has gathered and the heads of all dimensions; rows whose bound is below the k-th best of some exactly
        scored rows are out. The search stops when this proof leaves few rows, or at the last segment, and rescores what is left.
        """
        n, d = self.vectors.shape
        # beyond 53 bits the bounds are rounded, and slack makes up for it
        rounded = _bound(self.vectors, q) >= 2.0**52
        w = q[self.dim].astype(float) if rounded else q[self.dim]
        most = np.where(w > 0, w * self.high, w * self.low)
        least = np.full(d, np.inf) if rounded else np.full(d, np.iinfo(np.int64).max)
        np.minimum.at(least, self.dim, np.where(w > 0, w * self.low, w * self.high))
        impact = most - least[self.dim]
        order = np.argsort(-impact, kind="stable")
        order = order[impact[order] > 0]
        base = least.sum() if rounded else int(least.sum())
        slack = 0.5 + (1e-9 * (float(np.abs(most).sum()) + float(np.abs(least).sum())) if rounded else 0)
        gathered = np.zeros(n)
        done = np.cumsum(self.length[order])
        alive = np.flatnonzero(allowed)
        best = floor
        at = 0
        for share in (0.35, 0.6, 0.8, 1.0):
            end = int(np.searchsorted(done, share * done[-1], side="left")) + 1 if len(order) else 0
            end = min(end, len(order))
            now = order[at:end]
            if len(now):
                size = self.length[now]
                pick = np.repeat(self.start[now] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
                gathered += np.bincount(self.rows[pick], weights=np.repeat(impact[now], size).astype(float), minlength=n)
            at = end
            heads = np.zeros(d, impact.dtype)
            rest = order[at:]
            np.maximum.at(heads, self.dim[rest], impact[rest])
            if len(alive) > k:
                top = alive[np.argpartition(-gathered[alive], k - 1)[: min(len(alive), 4 * k)]] if len(alive) > 4 * k else alive
                known = np.sort(exact(self.vectors[top], q))[::-1]
                if len(known) >= k:
                    best = int(known[k - 1]) if best is None else max(best, int(known[k - 1]))
            if best is not None:
                alive = alive[base + gathered[alive] + float(heads.sum()) >= best - slack]
            if len(alive) <= few:
                break
        return alive, exact(self.vectors[alive], q)


def _block(data: bytes, n: int, d: int) -> np.ndarray:
    return np.frombuffer(data, np.int32 if len(data) == 4 * n * d else np.int64).reshape(n, d)


def _pack(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Blocks of at most size rows (id, v: array<double>) as bytes: ids, dim, values. Each partition packs its own rows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, size):
                part = b.slice(at, size)
                lists = part.column("v")
                flat, off = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
                x = np.floor(256.0 * flat.astype(np.float64))
                most = np.abs(x).max(initial=0)
                if most >= LIMIT:
                    raise OverflowError("a component is too large")
                kind = np.int32 if most < 1 << 31 else np.int64
                x = x.astype(kind)
                d = int(off.max()) if len(off) else 0
                full = np.zeros((len(off), d), kind)
                full[np.arange(d)[None, :] < off[:, None]] = x
                ids = part.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
                tag = part.column("tag").to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([tag.tobytes()], pa.binary()), pa.array([d], pa.int32()), pa.array([full.tobytes()], pa.binary())], names=["ids", "tags", "d", "x"])

    return stored(rows.mapInArrow(pack, "ids binary, tags binary, d int, x binary"), name)


def top_k(df: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", is_query: Column, k: int = 5, block: int = 2048, query_block: int = 256) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows by inner product of floor(256 * x) for each query.

    is_query is a condition over vec_id (a column of that name). Candidates are all rows but those with the query's own id; ties go to the smaller id. Rows with a
    null id, a null vector, or null or non-finite components take no part; shorter vectors count as padded with zeros. Sums are exact; where floor(256 * x) reaches 2^61, or a score of a candidate that may be among the best doesn't fit into a long, the query fails. Repeated rows are candidates
    each, but as queries are asked once. An empty table gives no rows.

    Rows are packed into blocks of at most block vectors where they lie; each block of queries meets each block of candidates once, by an equal join on the number of the candidates' block, and the best of each meeting are merged by rank.
    """
    v = F.col("v")
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & v.isNotNull()).filter(F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))))
    asked = rows.filter(is_query).dropDuplicates(["vec_id", "v"]).select(F.col("vec_id").alias("id"), "v", F.xxhash64("v").alias("tag"))
    stored_queries = stored(asked, "asked")
    n_queries = stored_queries.count()
    queries = _pack(stored_queries.repartition(max(1, -(-n_queries // query_block))), query_block, "queries")
    cands = _pack(rows.select(F.col("vec_id").alias("id"), "v", F.lit(0).cast("long").alias("tag")), block, "candidates")
    groups = max(1, cands.count())
    cands = cands.select(F.pmod(F.xxhash64("ids", "x"), F.lit(groups)).cast("int").alias("g"), F.col("ids").alias("c_ids"), F.col("d").alias("c_d"), F.col("x").alias("c_x"))
    spread = queries.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_g"), "ids", "tags", "d", "x")
    met = cands.join(spread.hint("merge"), F.col("g") == F.col("_g")).select("g", "c_ids", "c_d", "c_x", "ids", "tags", "d", "x").sortWithinPartitions("g", "c_ids")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, index, ids = None, None, None
        best: dict[tuple[int, int], int] = {}
        for b in batches:
            for r in b.to_pylist():
                d = max(r["d"], r["c_d"], 1)
                if last != (r["c_ids"], r["c_x"], d):
                    last = (r["c_ids"], r["c_x"], d)
                    ids = np.frombuffer(r["c_ids"], np.int64)
                    x = np.zeros((len(ids), d), np.int64)
                    x[:, : r["c_d"]] = _block(r["c_x"], len(ids), r["c_d"])
                    index = ImpactIndex(x)
                q_ids, tags = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["tags"], np.int64)
                q = np.zeros((len(q_ids), d), np.int64)
                q[:, : r["d"]] = _block(r["x"], len(q_ids), r["d"])
                out = []
                for i in range(len(q)):
                    key = (int(q_ids[i]), int(tags[i]))
                    rows_, score = index.search(q[i], k, ids != q_ids[i], best.get(key))
                    order = np.lexsort((ids[rows_], -score))[:k]
                    if len(order) == k:
                        best[key] = max(best.get(key, -(1 << 62)), int(score[order[-1]]))
                    out.append((np.full(len(order), q_ids[i]), np.full(len(order), tags[i]), ids[rows_][order], score[order]))
                if len(best) > 1_000_000:
                    best = {}
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[c] for o in out]).astype(np.int64)) for c in range(4)], names=["query_id", "tag", "vec_id", "score"])

    found = met.mapInArrow(solve, "query_id bigint, tag bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id", "tag").orderBy(F.desc("score"), "vec_id")).alias("rank")
    return found.select("query_id", rank, "vec_id", "score").filter(F.col("rank") <= k)

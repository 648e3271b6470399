"""Clustering features: sums that stand for balls of rows, built by part, merged level by level, and kept up on a stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, shared_dir, stored

SCHEMA = "n double, s array<double>, q double"


class Features:
    """Entries (n rows, their sum s, the sum q of their squared lengths), each of a radius (root mean square distance from the mean) of no more than threshold.

    When there are more than most entries the threshold grows and they are merged anew, so memory is bounded whatever is added."""

    def __init__(self, threshold: float, most: int = 1000) -> None:
        self.threshold, self.most, self.size = threshold, most, 0
        self.n = self.s = self.q = None

    def _room(self, dim: int) -> None:
        if self.n is None:
            self.n, self.s, self.q = np.zeros(64), np.zeros((64, dim)), np.zeros(64)
        elif self.size == len(self.n):
            self.n, self.q = np.append(self.n, np.zeros(self.size)), np.append(self.q, np.zeros(self.size))
            self.s = np.concatenate([self.s, np.zeros_like(self.s)])

    def add(self, n: np.ndarray, s: np.ndarray, q: np.ndarray) -> None:
        """Add entries in order: each goes to the one whose mean is nearest, if that stays within the threshold, else it is a new one. Equal rows make up one entry first."""
        for a, b, c in zip(n, s, q, strict=True):
            k = self.size
            if k:
                mean = self.s[:k] / self.n[:k, None]
                j = int(((mean - b / a) ** 2).sum(axis=1).argmin())
                m, t, u = self.n[j] + a, self.s[j] + b, self.q[j] + c
                if u / m - (t / m) @ (t / m) <= self.threshold**2 * (1 + 1e-9):
                    self.n[j], self.s[j], self.q[j] = m, t, u
                    continue
            self._room(len(b))
            self.n[k], self.s[k], self.q[k], self.size = a, b, c, k + 1
            if self.size > self.most:
                self._grow()

    def add_rows(self, x: np.ndarray) -> None:
        rows, n = np.unique(x, axis=0, return_counts=True)
        self.add(n.astype(float), rows * n[:, None], (rows * rows).sum(axis=1) * n)

    def _grow(self) -> None:
        n, s, q = self.n[: self.size], self.s[: self.size], self.q[: self.size]
        mean = s / n[:, None]
        some = mean[: min(len(mean), 200)]
        d = np.sqrt(np.maximum(((some[:, None] - mean[None]) ** 2).sum(axis=2), 0))
        d[d == 0] = np.inf
        near = np.median(d.min(axis=1))
        self.threshold = max(self.threshold * 1.5, float(near) / 2 if np.isfinite(near) else 0.0, 1e-12)
        self.size = 0
        old = (n.copy(), s.copy(), q.copy())
        self.n = self.s = self.q = None
        self.add(*old)

    def batch(self, part: int) -> pa.RecordBatch:
        k = self.size
        s = self.s[:k].tolist() if k else []
        cols = [pa.array([part] * k, pa.int64()), pa.array([float(self.threshold)] * k), pa.array(self.n[:k] if k else [], pa.float64()), pa.array(s, pa.list_(pa.float64())), pa.array(self.q[:k] if k else [], pa.float64())]
        return pa.RecordBatch.from_arrays(cols, names=["part", "threshold", "n", "s", "q"])


def _merge(t: pa.Table, threshold: float, most: int, part: int) -> Features:
    # wider thresholds first: what was merged under one must hold under the result
    f = Features(max([threshold, *t.column("threshold").to_pylist()]), most)
    s = t.column("s").combine_chunks()
    dim = len(s[0]) if len(s) else 0
    f.add(t.column("n").to_numpy(), s.flatten().to_numpy().reshape(-1, dim), t.column("q").to_numpy())
    return f


def features(rows: DataFrame, *, threshold: float, most: int = 1000, fan: int = 8) -> DataFrame:
    """(threshold, n, s, q): entries for all rows (v: array<double>), no more than most and each of a radius within threshold, which has grown where they would have been more.

    Each task builds the entries of its rows in one pass; then fan parts at a time are merged until one is left, so no task holds more than fan times most entries. Sums lose nothing on the way: those of all entries are those of all rows. Null vectors take no part; an empty table has no entries.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Features(threshold, most)
        for b in batches:
            v = b.column("v")
            if len(v):
                f.add_rows(v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(v), -1))
        yield f.batch(TaskContext.get().partitionId())

    schema = f"part long, threshold double, {SCHEMA}"
    now = stored(rows.select("v").filter("v IS NOT NULL").mapInArrow(build, schema), "features")
    parts = now.agg(F.max("part")).head()[0]
    while parts:
        up = now.withColumn("part", F.floor(F.col("part") / fan).cast("long"))
        new = stored(up.groupBy("part").applyInArrow(lambda t: pa.Table.from_batches([_merge(t, threshold, most, 0).batch(t.column("part")[0].as_py())]), schema), "features")
        discard(now)
        now, parts = new, parts // fan
    return now.drop("part")


def assign(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """id and entry (place of the entry in the order of its sums) whose mean is nearest, ties to the smaller place, for each row (id, v). entries, of a stated most, reach every task."""
    found = sorted((list(r["s"]), r["n"]) for r in entries.select("n", "s").collect())
    mean = np.array([np.array(s) / n for s, n in found]) if found else np.zeros((0, 0))

    @F.arrow_udf("int")
    def nearest(v: pa.Array) -> pa.Array:
        x = v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(v), -1)
        out = np.zeros(len(x), np.int32)
        for at in range(0, len(x), 256):
            out[at : at + 256] = ((x[at : at + 256, None] - mean[None]) ** 2).sum(axis=2).argmin(axis=1)
        return pa.array(out)

    return rows.filter("v IS NOT NULL").select("id", nearest("v").alias("entry"))


class StreamedFeatures:
    """Entries of all rows that a stream has brought: pass update as foreachBatch. Each batch's result is a table of its own in the shared folder, named by the batch's number,
    so a batch that is run again after a failure starts from the one before it and is counted once."""

    def __init__(self, name: str, *, threshold: float, most: int = 1000) -> None:
        self.name, self.threshold, self.most = name, threshold, most

    def _path(self, df: DataFrame, batch: int) -> str:
        return f"{shared_dir(df.sparkSession)}/{self.name}/batch={batch}"

    def update(self, batch: DataFrame, number: int) -> None:
        spark, now = batch.sparkSession, features(batch, threshold=self.threshold, most=self.most)
        if number > 0:
            now = now.unionByName(spark.read.parquet(self._path(batch, number - 1)))
        schema = f"part long, threshold double, {SCHEMA}"
        merged = now.withColumn("part", F.lit(0).cast("long")).groupBy("part").applyInArrow(lambda t: pa.Table.from_batches([_merge(t, self.threshold, self.most, 0).batch(0)]), schema)
        merged.drop("part").write.mode("overwrite").parquet(self._path(batch, number))

    def entries(self, like: DataFrame, number: int) -> DataFrame:
        """The entries after a batch."""
        return like.sparkSession.read.parquet(self._path(like, number))

"""Counting classifiers, isolation forests, iterated gradient models, column elimination and inspection."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decomposition import summed
from .gram import Moments
from .models import Linear


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """label, n and the weight that balances the classes: rows / (classes * n)."""
    c = df.groupBy(label).agg(F.count("*").alias("n"))
    t = c.agg(F.sum("n").alias("t"), F.count("*").alias("k"))
    return c.crossJoin(F.broadcast(t)).select(label, "n", (F.col("t") / (F.col("k") * F.col("n"))).alias("weight"))


def bernoulli_nb_stats(counts: DataFrame, labels: DataFrame, doc: str, alpha: float = 1.0) -> DataFrame:
    """label, term and the log probabilities that a document of the label has the term (log_p) or not (log_q), from long counts (doc, term) and labels (doc, label)."""
    n = labels.groupBy("label").agg(F.count("*").alias("docs"))
    c = counts.select(doc, "term").distinct().join(labels, doc).groupBy("label", "term").agg(F.count("*").alias("n"))
    p = (F.col("n") + alpha) / (F.col("docs") + 2 * alpha)
    return c.join(n, "label").select("label", "term", F.ln(p).alias("log_p"), F.ln(1 - p).alias("log_q"))


def complement_nb_stats(counts: DataFrame, labels: DataFrame, doc: str, alpha: float = 1.0) -> DataFrame:
    """label, term and weight: minus the log probability of the term in the documents of all other labels. Only terms that the label has are listed."""
    c = counts.join(labels, doc).groupBy("label", "term").agg(F.sum("n").alias("n"))
    every = c.groupBy("term").agg(F.sum("n").alias("t"))
    size = c.groupBy("label").agg(F.sum("n").alias("s"))
    all_ = c.agg(F.sum("n").alias("a"), F.count_distinct("term").alias("v"))
    j = c.join(every, "term").join(size, "label").crossJoin(F.broadcast(all_))
    return j.select("label", "term", (-F.ln((F.col("t") - F.col("n") + alpha) / (F.col("a") - F.col("s") + alpha * F.col("v")))).alias("weight"))


def categorical_nb_stats(df: DataFrame, label: str, columns: Sequence[str], alpha: float = 1.0) -> DataFrame:
    """label, feature, value and log probability of the value among the label's rows."""
    u = df.select(label, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns])).alias("s")).select(label, "s.*")
    c = u.groupBy(label, "feature", "value").agg(F.count("*").alias("n"))
    k = c.groupBy("feature").agg(F.count_distinct("value").alias("k"))
    t = c.groupBy(label, "feature").agg(F.sum("n").alias("t"))
    return c.join(k, "feature").join(t, [label, "feature"]).select(label, "feature", "value", F.ln((F.col("n") + alpha) / (F.col("t") + alpha * F.col("k"))).alias("log_p"))


# ---- isolation forest


def _harmonic(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class IsolationForest:
    """Trees as arrays: column to split (-1: leaf), threshold, children and, at leaves, path length."""

    trees: list[tuple[np.ndarray, ...]]
    sample: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; about one half is ordinary, near 1 is isolated early."""
        depth = np.zeros(len(x))
        for col, cut, left, right, length in self.trees:
            at = np.zeros(len(x), int)
            while (col[at] >= 0).any():
                inner = col[at] >= 0
                go = x[np.arange(len(x)), np.maximum(col[at], 0)] < cut[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
            depth += length[at]
        return 2.0 ** (-depth / max(1, len(self.trees)) / max(float(_harmonic(np.array(self.sample))), 1e-12))

    def column(self, v: Column) -> Column:
        @F.arrow_udf("double")
        def of(x: pa.Array) -> pa.Array:
            return pa.array(self.score(x.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(x), -1)))

        return of(v)


def isolation_forest(df: DataFrame, *, trees: int = 100, sample: int = 256, seed: int = 0) -> IsolationForest:
    """Each tree splits a sample of rows (id, v) by random columns and thresholds. The method itself asks for small samples; all trees' rows, trees * sample at most, are the first by a hash."""
    rows = df.select("v").orderBy(F.xxhash64(F.lit(seed), "v")).limit(trees * sample).collect()
    x = np.array([r[0] for r in rows], float)
    rng = np.random.default_rng(seed)
    size = min(sample, len(x))
    out = []
    for _ in range(trees if size > 1 else 0):
        part = x[rng.choice(len(x), size, replace=False)]
        nodes: list[list[float]] = []

        def grow(p: np.ndarray, depth: int) -> int:
            me = len(nodes)
            nodes.append([-1, 0.0, 0, 0, 0.0])
            spread = np.ptp(p, axis=0) if len(p) else np.zeros(x.shape[1])
            if len(p) <= 1 or depth >= np.ceil(np.log2(size)) or not (spread > 0).any():
                nodes[me][4] = depth + float(_harmonic(np.array(len(p))))
                return me
            c = int(rng.choice(np.flatnonzero(spread > 0)))
            t = rng.uniform(p[:, c].min(), p[:, c].max())
            nodes[me][:2] = [c, t]
            nodes[me][2] = grow(p[p[:, c] < t], depth + 1)
            nodes[me][3] = grow(p[p[:, c] >= t], depth + 1)
            return me

        grow(part, 0)
        a = np.array(nodes)
        out.append((a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4]))
    return IsolationForest(out, size)


# ---- gradient models: full passes, so results don't depend on the partitions

LOSSES: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "squared": lambda p, y: p - y,
    "log": lambda p, y: 1 / (1 + np.exp(-np.clip(p, -30, 30))) - y,
    "hinge": lambda p, y: np.where((2 * y - 1) * p < 1, -(2 * y - 1), 0.0),
    "squared_hinge": lambda p, y: np.where((2 * y - 1) * p < 1, -2 * (2 * y - 1) * (1 - (2 * y - 1) * p), 0.0),
    "perceptron": lambda p, y: np.where((2 * y - 1) * p <= 0, -(2 * y - 1), 0.0),
    "huber": lambda p, y: np.clip(p - y, -1.35, 1.35),
    "quantile": lambda p, y: np.where(p >= y, 0.5, -0.5),
}


def gradient_fit(df: DataFrame, target: str, columns: Sequence[str], *, loss: str = "log", alpha: float = 1e-4, rounds: int = 60, rate: float = 0.5) -> Linear:
    """A linear model of standardised columns for one of LOSSES (labels 0 and 1 for classifiers), by gradient steps with momentum; each step is one pass whose tasks return a sum of as many numbers as there are columns."""
    k = len(columns)
    rows = df.select(F.array(*[F.col(c).cast("double") for c in [*columns, target]]).alias("v")).cache()
    s = summed(rows, lambda x: np.concatenate([[len(x)], x[:, :k].sum(axis=0), (x[:, :k] ** 2).sum(axis=0)]), 1 + 2 * k)
    n = max(s[0], 1.0)
    mean = s[1 : 1 + k] / n
    scale = np.sqrt(np.maximum(s[1 + k :] / n - mean**2, 1e-12))
    w, speed, g_of = np.zeros(k + 1), np.zeros(k + 1), LOSSES[loss]
    for r in range(rounds):

        def grad(x: np.ndarray, w: np.ndarray = w) -> np.ndarray:
            z = np.column_stack([(x[:, :k] - mean) / scale, np.ones(len(x))])
            return z.T @ g_of(z @ w, x[:, k])

        g = summed(rows, grad, k + 1) / n + alpha * np.append(w[:-1], 0)
        speed = 0.8 * speed - rate / (1 + 0.05 * r) * g
        w = w + speed
    rows.unpersist()
    coef = w[:-1] / scale
    return Linear(coef, float(w[-1] - coef @ mean))


# ---- columns and inspection


def eliminate(m: Moments, k: int) -> list[int]:
    """k columns, by dropping the one with the smallest standardised least-squares weight again and again."""
    left = list(range(len(m.xy)))
    while len(left) > k:
        w = np.linalg.lstsq(m.xx[np.ix_(left, left)], m.xy[left], rcond=None)[0] * np.sqrt(np.diag(m.xx)[left])
        left.pop(int(np.abs(w).argmin()))
    return left


def best_columns(scores: DataFrame, score: str, k: int) -> list[str]:
    """Names of the k features with the highest score, ties by name."""
    return [r["feature"] for r in scores.orderBy(F.desc(score), "feature").limit(k).collect()]


def partial_dependence(df: DataFrame, predict: Column, column: str, values: Sequence[float]) -> DataFrame:
    """value and the mean prediction when column is set to it in every row; predict is an expression over columns, values are a few."""
    many = df.withColumn(column, F.explode(F.array(*[F.lit(float(v)) for v in values])))
    return many.groupBy(F.col(column).alias("value")).agg(F.avg(predict).alias("mean_prediction"))


def voting(df: DataFrame, columns: Sequence[str], out: str = "vote") -> DataFrame:
    """The commonest of several predictions, ties to the smallest."""
    a = F.array(*columns)
    best = F.array_max(F.transform(F.array_distinct(a), lambda x: F.struct(F.size(F.filter(a, lambda y: y == x)).alias("n"), (-x).alias("m"))))
    return df.withColumn(out, -best["m"])

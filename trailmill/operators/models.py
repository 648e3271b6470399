"""Models whose fit is a sum over rows: normal equations, naive Bayes, Gaussian mixtures of one, and wrappers of pyspark.ml."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Estimator, Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .classification import ratio


def cross_products(df: DataFrame, columns: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, sums and sums of products of columns in one aggregation."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    x = [F.col(c).cast("double") for c in columns]
    row = df.agg(F.count("*"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(x)], *[F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i, j in pairs]).head()
    k = len(columns)
    s = np.array([v or 0.0 for v in row[1 : 1 + k]])
    m = np.zeros((k, k))
    for (i, j), v in zip(pairs, row[1 + k :], strict=True):
        m[i, j] = m[j, i] = v or 0.0
    return row[0], s, m


@dataclass
class Linear:
    coef: np.ndarray
    intercept: float

    def predict(self, columns: Sequence[str]) -> Column:
        return sum((F.col(c) * float(w) for c, w in zip(columns, self.coef, strict=True)), F.lit(float(self.intercept)))


def least_squares(df: DataFrame, target: str, columns: Sequence[str], ridge: float = 0.0) -> Linear:
    """Ordinary (or ridge) least squares with an unpenalised intercept, by centred normal equations."""
    n, s, m = cross_products(df, [*columns, target])
    mean = s / max(n, 1)
    c = m - n * np.outer(mean, mean)
    w = np.linalg.lstsq(c[:-1, :-1] + ridge * np.eye(len(columns)), c[:-1, -1], rcond=None)[0]
    return Linear(w, float(mean[-1] - mean[:-1] @ w))


def covariance(df: DataFrame, columns: Sequence[str], shrinkage: float = 0.0) -> np.ndarray:
    """Population covariance, shrunk towards a multiple of the identity."""
    n, s, m = cross_products(df, columns)
    c = m / n - np.outer(s / n, s / n)
    return (1 - shrinkage) * c + shrinkage * np.trace(c) / len(c) * np.eye(len(c))


def principal_components(df: DataFrame, columns: Sequence[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """k components (rows, signed so that the largest entry is positive) and their variances (sample)."""
    n, s, m = cross_products(df, columns)
    values, vectors = np.linalg.eigh((m - np.outer(s, s) / n) / max(1, n - 1))
    order = np.argsort(-values)[:k]
    v = vectors[:, order].T
    v *= np.sign(v[np.arange(len(v)), np.abs(v).argmax(axis=1)])[:, None]
    return v, values[order]


def gaussian_nb_stats(df: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    """label, feature, n, mean and population variance."""
    from .selection import unpivot

    return unpivot(df, [label], columns).groupBy(label, "feature").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("var"))


def gaussian_nb_predict(df: DataFrame, stats: DataFrame, label: str, columns: Sequence[str], smoothing: float = 1e-9) -> DataFrame:
    """df with predicted: the class of highest posterior. The statistics, classes times features, are collected and become an expression."""
    rows = stats.collect()
    if len(rows) > 100_000:
        raise ValueError("too many classes for an expression")
    eps = smoothing * max((r["var"] for r in rows), default=0.0)
    classes = sorted({r[label] for r in rows})
    by = {(r[label], r["feature"]): r for r in rows}
    total = sum(by[c, columns[0]]["n"] for c in classes)
    scores = []
    for c in classes:
        s = F.lit(float(np.log(by[c, columns[0]]["n"] / total)))
        for f in columns:
            v = by[c, f]["var"] + eps
            s = s - (F.pow(F.col(f) - by[c, f]["mean"], F.lit(2)) / (2 * v)) - float(0.5 * np.log(2 * np.pi * v))
        scores.append(F.struct(s.alias("s"), F.lit(c).alias("c")))
    return df.withColumn("predicted", F.array_max(F.array(*scores))["c"])


def multinomial_nb_stats(counts: DataFrame, labels: DataFrame, doc: str, alpha: float = 1.0) -> DataFrame:
    """label, term, log probability with additive smoothing, from long counts (doc, term, n) and labels (doc, label)."""
    c = counts.join(labels, doc).groupBy("label", "term").agg(F.sum("n").alias("n"))
    v = c.select("term").distinct().count()
    total = c.groupBy("label").agg(F.sum("n").alias("t"))
    return c.join(total, "label").select("label", "term", F.ln((F.col("n") + alpha) / (F.col("t") + alpha * v)).alias("log_p"))


def dummy(df: DataFrame, label: str) -> DataFrame:
    """One row: the most frequent label and its share."""
    c = df.groupBy(label).agg(F.count("*").alias("n"))
    return c.agg(F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias("label"), ratio(F.max("n"), F.sum("n")).alias("share"))


def fit_ml(estimator: Estimator, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df with what a pyspark.ml estimator, fitted on columns, predicts. Trees, forests, boosting, logistic regression, k-means, mixtures, factorisation and topic models are pyspark.ml's own."""
    return Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="features"), estimator]).fit(df).transform(df)

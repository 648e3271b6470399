"""Decompositions of vectors (column v: array<double>): each pass over the rows returns sums of fixed size, and the rest is small algebra."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from .mapping import _map, project


def summed(df: DataFrame, f: Callable[[np.ndarray], np.ndarray], size: int, groups: int = 8) -> np.ndarray:
    """Sum over all rows' matrices of f(matrix), an array of size numbers. Tasks add up their rows, groups of tasks add up theirs, the driver adds groups sums."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(size)
        for b in batches:
            v = b.column("v")
            if len(v):
                total += f(v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(v), -1)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % groups], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["g", "s"])

    def merge(t: pa.Table) -> pa.Table:
        return pa.table({"s": pa.array([sum(np.frombuffer(x) for x in t.column("s").to_pylist()).tobytes()], pa.binary())})

    rows = df.select("v").mapInArrow(part, "g int, s binary").groupBy("g").applyInArrow(merge, "s binary").collect()
    return sum((np.frombuffer(r[0]) for r in rows), np.zeros(size))


def second_moments(df: DataFrame, dim: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and uncentred second moments (averages)."""
    s = summed(df, lambda x: np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()]), 1 + dim + dim * dim)
    n = max(s[0], 1.0)
    return int(s[0]), s[1 : 1 + dim] / n, s[1 + dim :].reshape(dim, dim) / n


def _signed(v: np.ndarray) -> np.ndarray:
    return v * np.sign(v[np.arange(len(v)), np.abs(v).argmax(axis=1)])[:, None]


def pca(df: DataFrame, dim: int, k: int, whiten: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, k components (rows; divided by their deviations with whiten) and their variances (population)."""
    _, mean, m = second_moments(df, dim)
    values, vectors = np.linalg.eigh(m - np.outer(mean, mean))
    order = np.argsort(-values)[:k]
    c = _signed(vectors[:, order].T)
    return mean, c / np.sqrt(np.maximum(values[order], 1e-12))[:, None] if whiten else c, values[order]


def truncated_svd(df: DataFrame, dim: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """k right singular vectors (rows) of the uncentred rows, and the singular values."""
    n, _, m = second_moments(df, dim)
    values, vectors = np.linalg.eigh(m * n)
    order = np.argsort(-values)[:k]
    return _signed(vectors[:, order].T), np.sqrt(np.maximum(values[order], 0))


def factor_analysis(df: DataFrame, dim: int, k: int, rounds: int = 500, tol: float = 1e-8) -> tuple[np.ndarray, np.ndarray]:
    """Loadings (k x dim) and noise variances: the loadings follow from the eigenvectors of the covariance scaled by the noise, the noise from what they leave, in turn."""
    _, mean, m = second_moments(df, dim)
    c = m - np.outer(mean, mean)
    psi = np.maximum(np.diag(c).copy(), 1e-12)
    for _ in range(rounds):
        root = np.sqrt(psi)
        values, vectors = np.linalg.eigh(c / np.outer(root, root))
        w = root[:, None] * vectors[:, -k:] * np.sqrt(np.maximum(values[-k:] - 1, 0))
        new = np.maximum(np.diag(c) - (w * w).sum(axis=1), 1e-12)
        done = np.abs(new - psi).max() < tol
        psi = new
        if done:
            break
    return w.T, psi


def fast_ica(df: DataFrame, dim: int, k: int, rounds: int = 50, tol: float = 1e-6, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Mean and unmixing matrix (k x dim) by the fixed-point iteration with tanh; each round is one pass."""
    mean, white, _ = pca(df, dim, k, whiten=True)
    w = np.linalg.qr(np.random.default_rng(seed).normal(size=(k, k)))[0]
    for _ in range(rounds):

        def step(x: np.ndarray, w: np.ndarray = w) -> np.ndarray:
            z = (x - mean) @ white.T
            g = np.tanh(z @ w.T)
            return np.concatenate([(g.T @ z).ravel(), (1 - g * g).sum(axis=0), [len(x)]])

        s = summed(df, step, k * k + k + 1)
        new = s[: k * k].reshape(k, k) / s[-1] - (s[k * k : -1] / s[-1])[:, None] * w
        u, _, vt = np.linalg.svd(new)
        new = u @ vt
        done = np.abs(np.abs((new * w).sum(axis=1)) - 1).max() < tol
        w = new
        if done:
            break
    return mean, w @ white


def _weights(x: np.ndarray, h: np.ndarray, rounds: int) -> np.ndarray:
    """Non-negative weights of rows x over parts h, by multiplicative updates from a fixed start."""
    w = np.full((len(x), len(h)), max(x.mean(), 1e-9) / max(h.mean() * len(h), 1e-12))
    xh, hh = x @ h.T, h @ h.T
    for _ in range(rounds):
        w *= xh / np.maximum(w @ hh, 1e-12)
    return w


def nmf(df: DataFrame, dim: int, k: int, rounds: int = 50, inner: int = 50, seed: int = 0) -> np.ndarray:
    """k non-negative parts (k x dim). A pass finds each row's weights given the parts and returns the products from which the parts are updated; weights are never kept."""
    mean = summed(df, lambda x: np.append(x.sum(axis=0), len(x)), dim + 1)
    h = np.random.default_rng(seed).uniform(0.5, 1.5, (k, dim)) * (mean[:-1] / max(mean[-1], 1))
    for _ in range(rounds):

        def step(x: np.ndarray, h: np.ndarray = h) -> np.ndarray:
            w = _weights(x, h, inner)
            return np.concatenate([(w.T @ w).ravel(), (w.T @ x).ravel()])

        s = summed(df, step, k * k + k * dim)
        ww, wx = s[: k * k].reshape(k, k), s[k * k :].reshape(k, dim)
        for _ in range(10):
            h = h * wx / np.maximum(ww @ h, 1e-12)
    return h


def nmf_weights(v: Column, parts: np.ndarray, inner: int = 200) -> Column:
    return _map(v, lambda x: _weights(x, parts, inner))


def cross_svd(df: DataFrame, left: int, dim: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """k pairs of directions of the first left components and of the others with the largest covariance, and those covariances."""
    _, mean, m = second_moments(df, dim)
    c = (m - np.outer(mean, mean))[:left, left:]
    u, s, vt = np.linalg.svd(c, full_matrices=False)
    return u[:, :k].T, vt[:k], s[:k]


def canonical_correlation(df: DataFrame, left: int, dim: int, k: int, ridge: float = 1e-9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """k pairs of directions with the largest correlation, and those correlations."""
    _, mean, m = second_moments(df, dim)
    c = m - np.outer(mean, mean) + ridge * np.eye(dim)

    def root(a: np.ndarray) -> np.ndarray:
        values, vectors = np.linalg.eigh(a)
        return vectors / np.sqrt(np.maximum(values, 1e-12)) @ vectors.T

    a, b = root(c[:left, :left]), root(c[left:, left:])
    u, s, vt = np.linalg.svd(a @ c[:left, left:] @ b, full_matrices=False)
    return (a @ u[:, :k]).T, (b @ vt[:k].T).T, s[:k]


def sparse_code(v: Column, dictionary: np.ndarray, k: int) -> Column:
    """Weights over the rows of dictionary, k of them not zero at most, each time adding the row most alike to what is left."""
    d = dictionary / np.maximum(np.linalg.norm(dictionary, axis=1, keepdims=True), 1e-12)

    def code(x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(d)))
        for r, row in enumerate(x):
            chosen: list[int] = []
            rest = row
            for _ in range(min(k, len(d))):
                if np.linalg.norm(rest) < 1e-12:
                    break
                a = np.abs(d @ rest)
                a[chosen] = -1
                chosen.append(int(a.argmax()))
                w = np.linalg.lstsq(d[chosen].T, row, rcond=None)[0]
                rest = row - w @ d[chosen]
            if chosen:
                out[r, chosen] = w
        return out

    return _map(v, code)


transform = project

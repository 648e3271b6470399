"""Kernel models on landmarks: the kernel of all rows with few landmark rows stands for the whole kernel, so that fits are sums over rows. With every row a landmark they are exact."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decomposition import summed
from .model_selection import share_of


def landmarks(df: DataFrame, n: int, id: str = "id", v: str = "v", seed: int = 0) -> np.ndarray:  # noqa: A002
    """The vectors of the n rows first by digest of their id; they are collected."""
    rows = df.select(id, v).orderBy(share_of(F.col(id), seed), id).limit(n).collect()
    return np.array([r[v] for r in rows], float).reshape(len(rows), -1)


def gaussian(x: np.ndarray, z: np.ndarray, gamma: float) -> np.ndarray:
    d = (x * x).sum(axis=1)[:, None] + (z * z).sum(axis=1)[None] - 2 * x @ z.T
    return np.exp(-gamma * np.maximum(d, 0))


def _matrix(v: pa.Array) -> np.ndarray:
    return v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(v), -1)


@dataclass
class KernelModel:
    z: np.ndarray
    gamma: float
    weights: np.ndarray
    #: Of the Gaussian process: what the data leave of the prior variance, as a quadratic form of the kernel with the landmarks.
    known: np.ndarray | None = None
    noise: float = 0.0

    def predict(self, v: Column) -> Column:
        z, gamma, w = self.z, self.gamma, self.weights

        @F.arrow_udf("double")
        def of(v: pa.Array) -> pa.Array:
            return pa.array(gaussian(_matrix(v), z, gamma) @ w)

        return of(v)

    def variance(self, v: Column) -> Column:
        z, gamma, known = self.z, self.gamma, self.known

        @F.arrow_udf("double")
        def of(v: pa.Array) -> pa.Array:
            k = gaussian(_matrix(v), z, gamma)
            return pa.array(1 - ((k @ known) * k).sum(axis=1))

        return of(v)


def _sums(df: DataFrame, z: np.ndarray, gamma: float, v: str, y: str) -> tuple[np.ndarray, np.ndarray]:
    """Sums of k k' and of k y over the rows, k being a row's kernel with the landmarks."""
    m = len(z)

    def one(x: np.ndarray) -> np.ndarray:
        k = gaussian(x[:, :-1], z, gamma)
        return np.column_stack([k.T @ k, k.T @ x[:, -1]]).ravel()

    s = summed(df.select(F.concat(F.transform(v, lambda c: c.cast("double")), F.array(F.col(y).cast("double"))).alias("v")), one, m * (m + 1)).reshape(m, m + 1)
    return s[:, :m], s[:, m]


def kernel_ridge(df: DataFrame, z: np.ndarray, *, gamma: float, alpha: float, v: str = "v", y: str = "y") -> KernelModel:
    """Least squares in the span of the landmarks' kernels with alpha times the function's squared norm."""
    kk, ky = _sums(df, z, gamma, v, y)
    return KernelModel(z, gamma, np.linalg.lstsq(kk + alpha * gaussian(z, z, gamma), ky, rcond=None)[0])


def gaussian_process(df: DataFrame, z: np.ndarray, *, gamma: float, noise: float, v: str = "v", y: str = "y") -> KernelModel:
    """Mean and variance of a Gaussian process with a Gaussian kernel and noise variance, given all rows, through the landmarks (deterministic training conditional)."""
    kk, ky = _sums(df, z, gamma, v, y)
    kz = gaussian(z, z, gamma) + 1e-10 * np.eye(len(z))
    inner = np.linalg.inv(kz + kk / noise)
    return KernelModel(z, gamma, inner @ ky / noise, np.linalg.inv(kz) - inner, noise)


def kernel_components(df: DataFrame, z: np.ndarray, k: int, *, gamma: float, v: str = "v") -> tuple[np.ndarray, Column]:
    """Variances of the k main components of the rows in the landmarks' feature space, and the rows' places on them (array), signed so that the largest weight is positive."""
    m = len(z)
    values, vectors = np.linalg.eigh(gaussian(z, z, gamma))
    ok = values > 1e-10 * values.max()
    root = vectors[:, ok] / np.sqrt(values[ok])
    dim = root.shape[1]

    def one(x: np.ndarray) -> np.ndarray:
        f = gaussian(x, z, gamma) @ root
        return np.concatenate([[len(x)], f.sum(axis=0), (f.T @ f).ravel()])

    s = summed(df.select(F.transform(v, lambda c: c.cast("double")).alias("v")), one, 1 + dim + dim * dim)
    n, mean = s[0], s[1 : 1 + dim] / s[0]
    w, u = np.linalg.eigh(s[1 + dim :].reshape(dim, dim) / n - np.outer(mean, mean))
    order = np.argsort(-w)[:k]
    u = u[:, order]
    u = u * np.sign(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])])

    @F.arrow_udf("array<double>")
    def of(v: pa.Array) -> pa.Array:
        p = (gaussian(_matrix(v), z, gamma) @ root - mean) @ u
        return pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))

    return w[order], of(F.col(v))

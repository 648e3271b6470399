"""Row-wise feature maps with parameters drawn or fitted once: random Fourier features, Nystroem, random projection, hashing, one-class limits."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _map(v: Column, f: Callable[[np.ndarray], np.ndarray]) -> Column:
    @F.arrow_udf("array<double>")
    def of(x: pa.Array) -> pa.Array:
        m = f(x.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(x), -1)) if len(x) else np.zeros((0, 1))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))

    return of(v)


def fourier_features(v: Column, dim: int, n: int, gamma: float, seed: int = 0) -> Column:
    """n random Fourier features of the Gaussian kernel exp(-gamma |x - y|^2)."""
    rng = np.random.default_rng(seed)
    w, b = rng.normal(size=(dim, n)) * np.sqrt(2 * gamma), rng.uniform(0, 2 * np.pi, n)
    return _map(v, lambda x: np.sqrt(2 / n) * np.cos(x @ w + b))


def nystroem(df: DataFrame, v: str, n: int, gamma: float) -> Column:
    """Features whose products approximate the Gaussian kernel, from n landmark rows, the first by a hash."""
    marks = np.array([r[0] for r in df.select(v).orderBy(F.xxhash64(v)).limit(n).collect()], float)
    kernel = lambda a, b: np.exp(-gamma * np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    root = vectors / np.sqrt(np.maximum(values, 1e-12)) @ vectors.T
    return _map(F.col(v), lambda x: kernel(x, marks) @ root)


def random_projection(v: Column, dim: int, n: int, density: float | None = None, seed: int = 0) -> Column:
    """n random projections that keep distances in the mean: Gaussian, or sparse with the given density of signs."""
    rng = np.random.default_rng(seed)
    if density is None:
        w = rng.normal(size=(dim, n)) / np.sqrt(n)
    else:
        w = rng.choice([-1.0, 0.0, 1.0], size=(dim, n), p=[density / 2, 1 - density, density / 2]) / np.sqrt(n * density)
    return _map(v, lambda x: x @ w)


def safe_dimension(n: int, eps: float = 0.1) -> int:
    """Dimensions that keep the distances of n points within 1 +- eps."""
    return int(4 * np.log(n) / (eps**2 / 2 - eps**3 / 3))


def project(v: Column, components: np.ndarray, mean: np.ndarray | None = None) -> Column:
    m = np.zeros(components.shape[1]) if mean is None else mean
    return _map(v, lambda x: (x - m) @ components.T)


def power_transform(df: DataFrame, column: str, lam: float, out: str, method: str = "yeo-johnson") -> DataFrame:
    """Yeo-Johnson or Box-Cox with a given exponent."""
    x = F.col(column)
    if method == "box-cox":
        y = F.ln(x) if lam == 0 else (F.pow(x, F.lit(lam)) - 1) / lam
    else:
        pos = F.log1p(x) if lam == 0 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
        neg = -F.log1p(-x) if lam == 2 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
        y = F.when(x >= 0, pos).otherwise(neg)
    return df.withColumn(out, y)


def power_likelihood(df: DataFrame, column: str, lams: Sequence[float]) -> list[tuple[float, float]]:
    """Log likelihood of Yeo-Johnson exponents, all in one pass."""
    wide = df.select(column)
    for i, lam in enumerate(lams):
        wide = power_transform(wide, column, float(lam), f"_y{i}")
    x = F.col(column)
    row = wide.agg(F.count("*"), F.sum(F.signum(x) * F.log1p(F.abs(x))), *[F.var_pop(f"_y{i}") for i in range(len(lams))]).head()
    return [(float(lam), -row[0] / 2 * float(np.log(max(row[2 + i], 1e-300))) + (lam - 1) * row[1]) for i, lam in enumerate(lams)]


def hashed_vector(terms: Column, n: int) -> Column:
    """Counts of terms (array of strings) by hash, with a sign by another, as an array of n doubles."""
    idx = F.transform(terms, lambda t: F.pmod(F.xxhash64(t), F.lit(n)))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.size(F.filter(idx, lambda j: j == i)).cast("double"))

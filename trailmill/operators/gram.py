"""Models that need no more of the rows than their sums of products: the rows are read once, and what follows works on a matrix of columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .models import Linear, cross_products


@dataclass
class Moments:
    """Rows, means and centred products (sums, not averages) of columns and, last, a target."""

    n: int
    mean: np.ndarray
    c: np.ndarray

    @property
    def xx(self) -> np.ndarray:
        return self.c[:-1, :-1]

    @property
    def xy(self) -> np.ndarray:
        return self.c[:-1, -1]

    @property
    def yy(self) -> float:
        return float(self.c[-1, -1])

    def linear(self, w: np.ndarray) -> Linear:
        return Linear(w, float(self.mean[-1] - self.mean[:-1] @ w))


def moments(df: DataFrame, columns: Sequence[str], target: str) -> Moments:
    n, s, m = cross_products(df, [*columns, target])
    mean = s / max(n, 1)
    return Moments(n, mean, m - n * np.outer(mean, mean))


def ridge(m: Moments, alpha: float) -> Linear:
    return m.linear(np.linalg.solve(m.xx + alpha * np.eye(len(m.xx)), m.xy))


def ridge_path(m: Moments, alphas: Sequence[float]) -> list[Linear]:
    values, vectors = np.linalg.eigh(m.xx)
    z = vectors.T @ m.xy
    return [m.linear(vectors @ (z / (values + a))) for a in alphas]


def elastic_net(m: Moments, alpha: float, l1_ratio: float = 1.0, rounds: int = 1000, tol: float = 1e-10) -> Linear:
    """Least (1 / 2n) |y - Xw|^2 + alpha * (l1_ratio |w|_1 + (1 - l1_ratio) / 2 |w|_2^2), by coordinate descent on the products."""
    a, b = m.xx / m.n, m.xy / m.n
    w, l1, l2 = np.zeros(len(b)), alpha * l1_ratio, alpha * (1 - l1_ratio)
    for _ in range(rounds):
        was = w.copy()
        for j in range(len(w)):
            if a[j, j] > 0:
                r = b[j] - a[j] @ w + a[j, j] * w[j]
                w[j] = np.sign(r) * max(abs(r) - l1, 0) / (a[j, j] + l2)
        if np.abs(w - was).max() < tol:
            break
    return m.linear(w)


def lasso_path(m: Moments, n: int = 100, eps: float = 1e-3) -> list[tuple[float, Linear]]:
    most = np.abs(m.xy / m.n).max()
    return [(float(a), elastic_net(m, float(a))) for a in np.geomspace(most, most * eps, n)]


def orthogonal_pursuit(m: Moments, k: int) -> Linear:
    """k columns, each time the one most correlated with what is left."""
    chosen: list[int] = []
    w = np.zeros(len(m.xy))
    norm = np.sqrt(np.maximum(np.diag(m.xx), 1e-300))
    for _ in range(min(k, len(w))):
        r = np.abs(m.xy - m.xx @ w) / norm
        r[chosen] = -1
        chosen.append(int(r.argmax()))
        w = np.zeros(len(m.xy))
        w[chosen] = np.linalg.lstsq(m.xx[np.ix_(chosen, chosen)], m.xy[chosen], rcond=None)[0]
    return m.linear(w)


def bayesian_ridge(m: Moments, rounds: int = 300, tol: float = 1e-6) -> tuple[Linear, float, float]:
    """Ridge with noise and weight precision by evidence maximisation; the model and both precisions."""
    values, vectors = np.linalg.eigh(m.xx)
    values = np.maximum(values, 0)
    z = vectors.T @ m.xy
    noise, prior = m.n / max(m.yy, 1e-12), 1.0
    w = np.zeros(len(z))
    for _ in range(rounds):
        new = vectors @ (z * noise / (noise * values + prior))
        sse = m.yy - 2 * new @ m.xy + new @ m.xx @ new
        gamma = (noise * values / (noise * values + prior)).sum()
        prior, noise = (gamma + 2e-6) / (new @ new + 2e-6), (m.n - gamma + 2e-6) / (max(sse, 0) + 2e-6)
        if np.abs(new - w).sum() < tol:
            w = new
            break
        w = new
    return m.linear(w), noise, prior


def partial_least_squares(m: Moments, k: int) -> Linear:
    """k components of largest covariance with the target, deflated one after the other."""
    a, b, ws, ps, qs = m.xx.copy(), m.xy.copy(), [], [], []
    for _ in range(k):
        if np.linalg.norm(b) < 1e-12:
            break
        w = b / np.linalg.norm(b)
        t = w @ a @ w
        p, q = a @ w / t, b @ w / t
        ws.append(w)
        ps.append(p)
        qs.append(q)
        a, b = a - t * np.outer(p, p), b - t * q * p
    w, p, q = np.array(ws).T, np.array(ps).T, np.array(qs)
    return m.linear(w @ np.linalg.solve(p.T @ w, q)) if len(qs) else m.linear(np.zeros(len(m.xy)))


# ---- covariance


def ledoit_wolf(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, float]:
    """Covariance shrunk towards the scaled identity by the asymptotically best amount, and that amount. The fourth moments come from one more pass."""
    n, s, m = cross_products(df, columns)
    mean, p = s / n, len(columns)
    c = m / n - np.outer(mean, mean)
    mu = np.trace(c) / p
    norm = sum((F.pow(F.col(k) - float(v), F.lit(2)) for k, v in zip(columns, mean, strict=True)), F.lit(0.0))
    fourth = df.agg(F.sum(norm * norm)).head()[0]
    delta = ((c - mu * np.eye(p)) ** 2).sum() / p
    beta = min((fourth / n - (c**2).sum()) / (n * p), delta)
    k = 0.0 if delta == 0 else beta / delta
    return (1 - k) * c + k * mu * np.eye(p), float(k)


def oracle_shrinkage(c: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """Covariance shrunk by the oracle-approximating amount."""
    p = len(c)
    mu, alpha = np.trace(c) / p, (c**2).mean()
    num, den = alpha + mu**2, (n + 1.0) * (alpha - mu**2 / p)
    k = 1.0 if den == 0 else min(num / den, 1.0)
    return (1 - k) * c + k * mu * np.eye(p), float(k)


def graphical_lasso(c: np.ndarray, alpha: float, rounds: int = 100, tol: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Covariance and sparse precision: column by column, a lasso of each on the others."""
    p = len(c)
    w = c.copy()
    w[np.diag_indices(p)] = np.diag(c)
    beta = np.zeros((p, p - 1))
    for _ in range(rounds):
        was = w.copy()
        for j in range(p):
            o = np.arange(p) != j
            a, b, x = w[np.ix_(o, o)], c[o, j], beta[j]
            for _ in range(200):
                old = x.copy()
                for k in range(p - 1):
                    r = b[k] - a[k] @ x + a[k, k] * x[k]
                    x[k] = np.sign(r) * max(abs(r) - alpha, 0) / a[k, k]
                if np.abs(x - old).max() < tol:
                    break
            w[o, j] = w[j, o] = a @ x
        if np.abs(w - was).max() < tol:
            break
    return w, np.linalg.inv(w)


def mahalanobis(df: DataFrame, columns: Sequence[str], mean: np.ndarray, precision: np.ndarray, out: str = "distance") -> DataFrame:
    """Squared Mahalanobis distance of each row as an expression."""
    d = [F.col(c) - float(v) for c, v in zip(columns, mean, strict=True)]
    return df.withColumn(out, sum((d[i] * d[j] * float(precision[i, j]) for i in range(len(d)) for j in range(len(d))), F.lit(0.0)))


# ---- discriminant analysis


@dataclass
class Discriminant:
    classes: list
    priors: np.ndarray
    means: np.ndarray
    precisions: list[np.ndarray]
    logdets: np.ndarray

    def predict(self, columns: Sequence[str]) -> Column:
        scores = []
        for c, p, m, q, ld in zip(self.classes, self.priors, self.means, self.precisions, self.logdets, strict=True):
            d = [F.col(k) - float(v) for k, v in zip(columns, m, strict=True)]
            maha = sum((d[i] * d[j] * float(q[i, j]) for i in range(len(d)) for j in range(len(d))), F.lit(0.0))
            scores.append(F.struct((float(np.log(p)) - 0.5 * float(ld) - 0.5 * maha).alias("s"), F.lit(c).alias("c")))
        return F.array_max(F.array(*scores))["c"]


def discriminant(df: DataFrame, label: str, columns: Sequence[str], quadratic: bool = False) -> Discriminant:
    """Linear (one shared covariance) or quadratic discriminant analysis; classes times columns squared are collected."""
    k = len(columns)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    x = [F.col(c).cast("double") for c in columns]
    rows = df.groupBy(label).agg(F.count("*").alias("n"), *[F.sum(c) for c in x], *[F.sum(x[i] * x[j]) for i, j in pairs]).orderBy(label).collect()
    n = np.array([r["n"] for r in rows], float)
    means = np.array([r[2 : 2 + k] for r in rows], float) / n[:, None]
    within = []
    for r, m, c in zip(rows, means, n, strict=True):
        a = np.zeros((k, k))
        for (i, j), v in zip(pairs, r[2 + k :], strict=True):
            a[i, j] = a[j, i] = v
        within.append(a - c * np.outer(m, m))
    covs = [a / max(c - 1, 1) for a, c in zip(within, n, strict=True)] if quadratic else [sum(within) / n.sum()] * len(rows)
    return Discriminant([r[0] for r in rows], n / n.sum(), means, [np.linalg.pinv(c) for c in covs], np.array([np.linalg.slogdet(c)[1] for c in covs]))


def merged(a: Moments, b: Moments) -> Moments:
    """The moments of two sets of rows together: fits can go on with more rows without the old ones."""
    n = a.n + b.n
    if not n:
        return a
    d = b.mean - a.mean
    return Moments(n, a.mean + d * (b.n / n), a.c + b.c + np.outer(d, d) * (a.n * b.n / n))

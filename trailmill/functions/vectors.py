"""Arithmetic on array columns inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def manhattan(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def chebyshev(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null where a vector has no length."""
    return 1 - F.try_divide(dot(a, b), norm(a) * norm(b))


def scaled(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: F.try_divide(x.cast("double"), by))


def unit(a: Column, kind: str = "l2") -> Column:
    """a by its l1, l2 or maximum norm; a vector without length stays as it is."""
    n = {"l2": norm(a), "l1": total(F.transform(a, lambda x: F.abs(x.cast("double")))), "max": F.array_max(F.transform(a, lambda x: F.abs(x.cast("double"))))}[kind]
    return scaled(a, F.when(n == 0, F.lit(1.0)).otherwise(n))


def rbf(a: Column, b: Column, gamma: float) -> Column:
    return F.exp(-gamma * squared_distance(a, b))


def polynomial(a: Column, b: Column, gamma: float, degree: int = 3, coef: float = 1.0) -> Column:
    return F.pow(gamma * dot(a, b) + coef, F.lit(float(degree)))


def laplacian(a: Column, b: Column, gamma: float) -> Column:
    return F.exp(-gamma * manhattan(a, b))


def sigmoid(a: Column, b: Column, gamma: float, coef: float = 1.0) -> Column:
    return F.tanh(gamma * dot(a, b) + coef)


def additive_chi2(a: Column, b: Column) -> Column:
    """Minus the sum of squared differences over sums; components that are both 0 count nothing."""
    return -total(F.zip_with(a, b, lambda x, y: F.coalesce(F.try_divide((x.cast("double") - y) * (x.cast("double") - y), x.cast("double") + y), F.lit(0.0))))


def chi2_kernel(a: Column, b: Column, gamma: float = 1.0) -> Column:
    return F.exp(gamma * additive_chi2(a, b))


def nan_euclidean(a: Column, b: Column) -> Column:
    """Distance over the components that both have, scaled up to all; null where there are none."""
    d = F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))
    known = F.filter(d, lambda x: x.isNotNull() & ~F.isnan(x))
    return F.sqrt(F.try_divide(total(known) * F.size(d), F.size(known)))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on a sphere of radius 1, from radians."""
    u, v = F.sin((lat2 - lat1) / 2), F.sin((lon2 - lon1) / 2)
    return 2 * F.asin(F.sqrt(u * u + F.cos(lat1) * F.cos(lat2) * v * v))


def additive_chi2_features(a: Column, steps: int = 2, interval: float = 0.8) -> Column:
    """Features whose products approximate the additive chi-squared kernel, by sampling its Fourier transform: sqrt(x * interval), then cosines and sines for each further step."""

    def of(x: Column) -> Column:
        x = x.cast("double")
        out = [F.when(x > 0, F.sqrt(x * interval)).otherwise(0.0)]
        for k in range(1, steps):
            size, turn = F.sqrt(2 * x * interval / F.cosh(F.lit(3.141592653589793 * k * interval))), k * interval * F.ln(x)
            out += [F.when(x > 0, size * F.cos(turn)).otherwise(0.0), F.when(x > 0, size * F.sin(turn)).otherwise(0.0)]
        return F.array(*out)

    return F.flatten(F.transform(a, of))


#: Kernels and distances of two array columns by name; those with further arguments take them by keyword.
KERNELS = {"linear": dot, "rbf": rbf, "polynomial": polynomial, "laplacian": laplacian, "sigmoid": sigmoid, "additive_chi2": additive_chi2, "chi2": chi2_kernel}
DISTANCES = {"sqeuclidean": squared_distance, "manhattan": manhattan, "chebyshev": chebyshev, "cosine": cosine_distance, "nan_euclidean": nan_euclidean}

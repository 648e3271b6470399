"""Scores by which features are selected; each is one or two aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .classification import ratio


def unpivot(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """keys, feature, x."""
    return df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])).alias("s")).select(*keys, "s.feature", "s.x")


def variances(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature and population variance."""
    return unpivot(df, [], columns).groupBy("feature").agg(F.var_pop("x").alias("variance"))


def chi2(df: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    """feature and chi-square of non-negative features against a class label."""
    per = unpivot(df, [label], columns).groupBy("feature", label).agg(F.sum("x").alias("o"), F.count("*").alias("n"))
    total = per.groupBy("feature").agg(F.sum("o").alias("t"), F.sum("n").alias("m"))
    e = F.col("n") / F.col("m") * F.col("t")
    return per.join(total, "feature").groupBy("feature").agg(F.sum(ratio((F.col("o") - e) * (F.col("o") - e), e)).alias("chi2"))


def anova_f(df: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    """feature and F of one-way analysis of variance."""
    per = unpivot(df, [label], columns).groupBy("feature", label).agg(F.count("*").alias("n"), F.avg("x").alias("m"), (F.var_pop("x") * F.count("*")).alias("w"))
    total = per.groupBy("feature").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("g"))
    d = F.col("m") - F.col("g")
    s = per.join(total, "feature").groupBy("feature").agg(F.sum(F.col("n") * d * d).alias("between"), F.sum("w").alias("within"), F.count("*").alias("k"), F.sum("n").alias("n"))
    return s.select("feature", ratio(F.col("between") * (F.col("n") - F.col("k")), F.col("within") * (F.col("k") - 1)).alias("f"))


def regression_f(df: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """feature, correlation with target and F of the simple regression."""
    r = unpivot(df, [target], columns).groupBy("feature").agg(F.corr("x", target).alias("r"), F.count("*").alias("n"))
    return r.select("feature", "r", ratio(F.col("r") * F.col("r") * (F.col("n") - 2), 1 - F.col("r") * F.col("r")).alias("f"))


def mutual_information(df: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    """feature and mutual information of discrete values with the label."""
    c = unpivot(df, [label], columns).groupBy("feature", "x", label).agg(F.count("*").cast("double").alias("n"))
    a = c.groupBy("feature", "x").agg(F.sum("n").alias("na"))
    b = c.groupBy("feature", label).agg(F.sum("n").alias("nb"))
    t = c.groupBy("feature").agg(F.sum("n").alias("t"))
    j = c.join(a, ["feature", "x"]).join(b, ["feature", label]).join(t, "feature")
    return j.groupBy("feature").agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("mi"))


def selected(scores: DataFrame, score: str, *, k: int | None = None, percentile: float | None = None, at_least: float | None = None) -> DataFrame:
    """The features (feature, score) that are picked: the k best, the best percentile of them, or those with a score of at least so much; ties go to the smaller name. Null scores come last."""
    from pyspark.sql import Window

    if at_least is not None:
        return scores.filter(F.col(score) >= at_least)
    ranked = scores.withColumn("_r", F.row_number().over(Window.orderBy(F.desc_nulls_last(score), "feature")))
    n = F.lit(k) if k is not None else F.greatest(F.floor(F.count("*").over(Window.partitionBy()) * percentile / 100), F.lit(1))
    return ranked.withColumn("_n", n).filter("_r <= _n").drop("_r", "_n")


def f_tail(f: float, a: float, b: float) -> float:
    """The chance that a value of the F law with a and b degrees of freedom is larger, by the incomplete beta function's continued fraction."""
    from math import exp, lgamma, log

    def fraction(x: float, p: float, q: float) -> float:
        tiny, c, d = 1e-300, 1.0, 1 - (p + q) * x / (p + 1)
        d = 1 / (d if abs(d) > tiny else tiny)
        h = d
        for m in range(1, 1000):
            for top in (m * (q - m) * x / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * x / ((p + 2 * m) * (p + 2 * m + 1))):
                d, c = 1 + top * d, 1 + top / c
                d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
                h *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return h

    if f <= 0:
        return 1.0
    x = b / (b + a * f)
    p, q = b / 2, a / 2
    front = exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * log(x) + q * log(max(1 - x, 1e-300)))
    return front * fraction(x, p, q) / p if x < (p + 1) / (p + q + 2) else 1 - front * fraction(1 - x, q, p) / q


def significant(p_values: dict[str, float], alpha: float = 0.05, control: str = "fpr") -> list[str]:
    """Features whose p-value is small enough: each by itself (fpr), with a bounded share of false ones among those picked (fdr, step-up), or with a bounded chance of any (fwe)."""
    n, order = len(p_values), sorted(p_values, key=lambda f: (p_values[f], f))
    if control == "fpr":
        return [f for f in order if p_values[f] < alpha]
    if control == "fwe":
        return [f for f in order if p_values[f] < alpha / n]
    last = max((i for i, f in enumerate(order, 1) if p_values[f] <= alpha * i / n), default=0)
    return order[:last]

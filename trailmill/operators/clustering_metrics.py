"""Comparison of two labellings, and quality of a labelling of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from .classification import ratio


def contingency(df: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    return df.groupBy(a, b).agg(F.count("*").alias("n"))


def information(df: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row: mutual information, entropies, normalised (arithmetic) information, homogeneity, completeness and V measure."""
    c = contingency(df, a, b)
    side = lambda k: c.groupBy(k).agg(F.sum("n").alias("m"))
    ra, rb = side(a).withColumnRenamed("m", "na"), side(b).withColumnRenamed("m", "nb")
    total = c.agg(F.sum("n").alias("t"))
    joined = c.join(ra, a).join(rb, b).crossJoin(F.broadcast(total))
    n, t = F.col("n").cast("double"), F.col("t")
    mi = joined.agg(F.sum(n / t * F.ln(n * t / (F.col("na") * F.col("nb")))).alias("mi"))
    entropy = lambda r, k, name: r.crossJoin(F.broadcast(total)).agg(F.sum(-F.col(k) / F.col("t") * F.ln(F.col(k) / F.col("t"))).alias(name))
    out = mi.crossJoin(entropy(ra, "na", "ha")).crossJoin(entropy(rb, "nb", "hb"))
    m, ha, hb = F.col("mi"), F.col("ha"), F.col("hb")
    return out.select(m, ha, hb, ratio(2 * m, ha + hb).alias("nmi"), F.coalesce(F.try_divide(m, ha), F.lit(1.0)).alias("homogeneity"), F.coalesce(F.try_divide(m, hb), F.lit(1.0)).alias("completeness"), ratio(2 * m, ha + hb).alias("v_measure"))


def pair_counts(df: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row: Rand, adjusted Rand and Fowlkes-Mallows, from sums over the contingency table."""
    c = contingency(df, a, b)
    two = lambda x: x * (x - 1) / 2
    s = c.agg(F.sum(two(F.col("n").cast("double"))).alias("s"), F.sum("n").cast("double").alias("t"))
    sa = c.groupBy(a).agg(F.sum("n").cast("double").alias("m")).agg(F.sum(two(F.col("m"))).alias("sa"))
    sb = c.groupBy(b).agg(F.sum("n").cast("double").alias("m")).agg(F.sum(two(F.col("m"))).alias("sb"))
    j = s.crossJoin(sa).crossJoin(sb)
    x, t, p, q = F.col("s"), two(F.col("t")), F.col("sa"), F.col("sb")
    return j.select(ratio(t + 2 * x - p - q, t).alias("rand"), F.coalesce(F.try_divide(x - p * q / t, (p + q) / 2 - p * q / t), F.lit(1.0)).alias("adjusted_rand"), ratio(x, F.sqrt(p) * F.sqrt(q)).alias("fowlkes_mallows"))


def centroids(df: DataFrame, label: str = "label", vector: str = "v") -> DataFrame:
    """label, n and mean vector, by sums of components."""
    parts = df.select(label, F.posexplode(vector).alias("i", "x")).groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    return parts.groupBy(label).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", "m"))).alias("c")).select(label, "n", F.col("c.m").alias("centroid"))


def dispersion(df: DataFrame, label: str = "label", vector: str = "v") -> DataFrame:
    """One row: Calinski-Harabasz and the sums of squares within and between clusters."""
    c = centroids(df, label, vector)
    whole = centroids(df.withColumn("_all", F.lit(0)), "_all", vector).select(F.col("centroid").alias("g"), F.col("n").alias("total"))
    within = df.join(F.broadcast(c) if c.count() <= 10_000 else c, label).agg(F.sum(vectors.squared_distance(F.col(vector), F.col("centroid"))).alias("ssw"))
    between = c.crossJoin(F.broadcast(whole)).agg(F.sum(F.col("n") * vectors.squared_distance(F.col("centroid"), F.col("g"))).alias("ssb"), F.count("*").alias("k"), F.max("total").alias("total"))
    j = within.crossJoin(between)
    return j.select("ssw", "ssb", ratio(F.col("ssb") * (F.col("total") - F.col("k")), F.col("ssw") * (F.col("k") - 1)).alias("calinski_harabasz"))


def davies_bouldin(df: DataFrame, label: str = "label", vector: str = "v") -> DataFrame:
    """One row: mean over clusters of the worst ratio of spreads to centroid distance; pairs are of clusters, not of rows."""
    c = centroids(df, label, vector)
    spread = df.join(c, label).groupBy(label).agg(F.avg(F.sqrt(vectors.squared_distance(F.col(vector), F.col("centroid")))).alias("s"))
    j = c.join(spread, label)
    a = j.select(F.col(label).alias("la"), F.col("centroid").alias("ca"), F.col("s").alias("sa"))
    b = j.select(F.col(label).alias("lb"), F.col("centroid").alias("cb"), F.col("s").alias("sb"))
    worst = a.join(b, F.col("la") != F.col("lb")).groupBy("la").agg(F.max(ratio(F.col("sa") + F.col("sb"), F.sqrt(vectors.squared_distance(F.col("ca"), F.col("cb"))))).alias("r"))
    return worst.agg(F.avg("r").alias("davies_bouldin"))


def silhouette(df: DataFrame, label: str = "label", vector: str = "v") -> DataFrame:
    """One row: mean silhouette over squared Euclidean distances. The mean squared distance of a row to a cluster follows from the cluster's size, sum and sum of squares, so no two rows ever meet."""
    c = centroids(df, label, vector)
    sq = df.groupBy(label).agg(F.avg(vectors.dot(F.col(vector), F.col(vector))).alias("q"))
    c = c.join(sq, label).select(F.col(label).alias("l"), "n", "centroid", "q")
    if c.count() > 10_000:
        raise ValueError("too many clusters for one list")
    every = c.agg(F.collect_list(F.struct("l", "n", "centroid", "q")).alias("cs"))
    rows = df.select(label, F.col(vector), vectors.dot(F.col(vector), F.col(vector)).alias("xx")).crossJoin(F.broadcast(every))
    far = F.transform("cs", lambda s: F.struct(s["l"].alias("l"), s["n"].alias("n"), (F.col("xx") + s["q"] - 2 * vectors.dot(F.col(vector), s["centroid"])).alias("d")))
    rows = rows.select(label, far.alias("far"))
    own = F.filter("far", lambda s: s["l"] == F.col(label))[0]
    a = own["d"] * own["n"] / F.greatest(own["n"] - 1, F.lit(1))
    b = F.array_min(F.transform(F.filter("far", lambda s: s["l"] != F.col(label)), lambda s: s["d"]))
    return rows.select(F.when(own["n"] == 1, 0.0).otherwise(ratio(b - a, F.greatest(a, b))).alias("s")).agg(F.avg("s").alias("silhouette"))


def silhouette_samples(df: DataFrame, id: str = "id", label: str = "label", vector: str = "v") -> DataFrame:  # noqa: A002
    """id and silhouette of each row over squared Euclidean distances, by clusters' sizes, sums and sums of squares as in silhouette()."""
    c = centroids(df, label, vector)
    sq = df.groupBy(label).agg(F.avg(vectors.dot(F.col(vector), F.col(vector))).alias("q"))
    c = c.join(sq, label).select(F.col(label).alias("l"), "n", "centroid", "q")
    if c.count() > 10_000:
        raise ValueError("too many clusters for one list")
    every = c.agg(F.collect_list(F.struct("l", "n", "centroid", "q")).alias("cs"))
    rows = df.select(id, label, F.col(vector), vectors.dot(F.col(vector), F.col(vector)).alias("xx")).crossJoin(F.broadcast(every))
    far = F.transform("cs", lambda s: F.struct(s["l"].alias("l"), s["n"].alias("n"), (F.col("xx") + s["q"] - 2 * vectors.dot(F.col(vector), s["centroid"])).alias("d")))
    rows = rows.select(id, label, far.alias("far"))
    own = F.filter("far", lambda s: s["l"] == F.col(label))[0]
    a = own["d"] * own["n"] / F.greatest(own["n"] - 1, F.lit(1))
    b = F.array_min(F.transform(F.filter("far", lambda s: s["l"] != F.col(label)), lambda s: s["d"]))
    return rows.select(id, F.when(own["n"] == 1, 0.0).otherwise(ratio(b - a, F.greatest(a, b))).alias("silhouette"))


def pair_confusion(df: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row: ordered pairs of rows that are apart in both clusterings, together in b only, in a only, in both."""
    n = contingency(df, a, b)
    sq = lambda d, c: d.agg(F.sum(F.col("n").cast("double") * F.col("n")).alias(c))
    total = n.agg(F.sum("n").cast("double").alias("t"))
    both, in_a, in_b = sq(n, "s"), sq(n.groupBy(a).agg(F.sum("n").alias("n")), "a"), sq(n.groupBy(b).agg(F.sum("n").alias("n")), "b")
    one = both.crossJoin(in_a).crossJoin(in_b).crossJoin(total)
    s, x, y, t = (F.col(c) for c in "sabt")
    return one.select((t * t - x - y + s).alias("apart"), (y - s).alias("only_b"), (x - s).alias("only_a"), (s - t).alias("together"))


def adjusted_information(df: DataFrame, a: str = "a", b: str = "b", most: int = 100_000) -> float:
    """Mutual information above what sizes alone would give by chance, as a share of the most that it could be above that (the mean of the entropies). The contingency table is collected, up to most cells."""
    from math import exp, lgamma, log

    cells = contingency(df, a, b).limit(most + 1).collect()
    if len(cells) > most:
        raise ValueError(f"more than {most} pairs of clusters")
    n = sum(r["n"] for r in cells)
    ra, rb = {}, {}
    for r in cells:
        ra[r[a]] = ra.get(r[a], 0) + r["n"]
        rb[r[b]] = rb.get(r[b], 0) + r["n"]
    if len(ra) == len(rb) and len(ra) in (0, 1):
        return 1.0
    mi = sum(r["n"] / n * log(n * r["n"] / (ra[r[a]] * rb[r[b]])) for r in cells)
    ha, hb = (-sum(x / n * log(x / n) for x in m.values()) for m in (ra, rb))
    expected = 0.0
    for x in ra.values():
        for y in rb.values():
            fixed = lgamma(x + 1) + lgamma(y + 1) + lgamma(n - x + 1) + lgamma(n - y + 1) - lgamma(n + 1)
            for k in range(max(1, x + y - n), min(x, y) + 1):
                expected += k / n * log(n * k / (x * y)) * exp(fixed - lgamma(k + 1) - lgamma(x - k + 1) - lgamma(y - k + 1) - lgamma(n - x - y + k + 1))
    return (mi - expected) / ((ha + hb) / 2 - expected)


def ward_distances(df: DataFrame, label: str = "label", vector: str = "v") -> DataFrame:
    """a, b and how much the sum of squares within clusters would grow if two clusters were one: n m / (n + m) times the squared distance of their means."""
    c = centroids(df, label, vector)
    x, y = c.select(F.col(label).alias("a"), F.col("n").alias("n"), F.col("centroid").alias("v")), c.select(F.col(label).alias("b"), F.col("n").alias("m"), F.col("centroid").alias("w"))
    n, m = F.col("n").cast("double"), F.col("m").cast("double")
    return x.join(y, F.col("a") < F.col("b")).select("a", "b", (n * m / (n + m) * vectors.squared_distance(F.col("v"), F.col("w"))).alias("distance"))

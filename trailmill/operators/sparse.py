"""Sparse matrices as tables (i, j, x), one row a stored entry, and graphs as such matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import discard, stored


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """The matrix product: entries meet by the inner index."""
    right = b.select(F.col("i").alias("k"), F.col("j").alias("_j"), F.col("x").alias("_x"))
    return a.withColumnRenamed("j", "k").join(right, "k").groupBy("i", F.col("_j").alias("j")).agg(F.sum(F.col("x") * F.col("_x")).alias("x"))


def density(a: DataFrame, rows: int, columns: int) -> DataFrame:
    """The share of entries that aren't 0."""
    return a.agg((F.count_if(F.col("x") != 0) / F.lit(float(rows * columns))).alias("density"))


def column_moments(a: DataFrame, rows: int) -> DataFrame:
    """(j, n, mean, var) of the columns with stored entries, over rows rows, those that aren't stored being 0."""
    mean = F.sum("x") / rows
    return a.groupBy("j").agg(F.lit(rows).cast("long").alias("n"), mean.alias("mean"), (F.sum(F.col("x") * F.col("x")) / rows - mean * mean).alias("var"))


def merged_moments(a: DataFrame, b: DataFrame) -> DataFrame:
    """(j, n, mean, var) of two sets of rows together, from their column_moments(); a column that one lacks is 0 there, which takes that one's n from any row."""
    n = [x.agg(F.max("n")).head()[0] or 0 for x in (a, b)]
    ren = b.select("j", F.col("mean").alias("_m"), F.col("var").alias("_v"))
    both = a.select("j", "mean", "var").join(ren, "j", "full").select("j", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("mean", "var", "_m", "_v")])
    t = n[0] + n[1]
    mean = (F.col("mean") * n[0] + F.col("_m") * n[1]) / t
    between = F.lit(n[0] * n[1] / (t * t)) * (F.col("mean") - F.col("_m")) * (F.col("mean") - F.col("_m"))
    return both.select("j", F.lit(t).cast("long").alias("n"), mean.alias("mean"), ((F.col("var") * n[0] + F.col("_v") * n[1]) / t + between).alias("var"))


def scaled(a: DataFrame, by: DataFrame, axis: str) -> DataFrame:
    """Entries times the factor (i or j, f) of their row (axis i) or column (axis j)."""
    return a.join(by, axis).select("i", "j", (F.col("x") * F.col("f")).alias("x"))


def swapped(a: DataFrame, axis: str, m: int, n: int) -> DataFrame:
    """Rows (axis i) or columns (axis j) m and n in each other's place."""
    c = F.col(axis)
    return a.withColumn(axis, F.when(c == m, F.lit(n)).when(c == n, F.lit(m)).otherwise(c)).select("i", "j", "x")


def normalized_rows(a: DataFrame, kind: str = "l2") -> DataFrame:
    """Rows by their l1 or l2 norm; rows of zeros stay."""
    x = F.col("x")
    size = a.groupBy("i").agg((F.sum(F.abs(x)) if kind == "l1" else F.sqrt(F.sum(x * x))).alias("f"))
    return a.join(size, "i").select("i", "j", F.when(F.col("f") > 0, x / F.col("f")).otherwise(x).alias("x"))


def weighted_mode(df: DataFrame, group: str, value: str, weight: Column) -> DataFrame:
    """(group, value, weight): the value with the largest total weight, ties to the smaller."""
    w = df.groupBy(group, value).agg(F.sum(weight).alias("w"))
    return w.groupBy(group).agg(F.min_by(value, F.struct(-F.col("w"), F.col(value))).alias(value), F.max("w").alias("weight"))


def shortest_paths(edges: DataFrame, start: DataFrame, *, most: float = float("inf"), max_rounds: int = 1000) -> DataFrame:
    """(start, node, distance) of the nodes that can be reached from each start (start) along edges (a, b, w >= 0), up to a distance of most.

    Each round goes one edge further from the nodes whose distance fell in the round before, and is cut from its lineage by a table in the shared folder.
    """
    e = stored(edges.select(F.col("a").alias("node"), "b", F.col("w").cast("double").alias("w")), "edges")
    now = stored(start.select("start", F.col("start").alias("node"), F.lit(0.0).alias("distance"), F.lit(True).alias("new")), "paths")
    for _ in range(max_rounds):
        step = now.filter("new").join(e, "node").select("start", F.col("b").alias("node"), (F.col("distance") + F.col("w")).alias("distance")).filter(F.col("distance") <= most)
        step = step.groupBy("start", "node").agg(F.min("distance").alias("d"))
        both = now.select("start", "node", "distance").join(step, ["start", "node"], "full")
        fell = F.col("distance").isNull() | (F.col("d") < F.col("distance"))
        after = stored(both.select("start", "node", F.least("distance", "d").alias("distance"), F.coalesce(fell, F.lit(False)).alias("new")), "paths")
        discard(now)
        now = after
        if now.filter("new").isEmpty():
            return now.select("start", "node", "distance")
    raise RuntimeError(f"no end within {max_rounds} rounds")


def closeness(edges: DataFrame, nodes: int) -> DataFrame:
    """(i, j, x): a matrix of links from links (a, b), 1 for each, for tables that are wanted as matrices; nodes is the number of rows."""
    return edges.filter(F.col("b").isNotNull() & (F.col("a") < nodes) & (F.col("b") < nodes)).select(F.col("a").alias("i"), F.col("b").alias("j"), F.lit(1.0).alias("x"))

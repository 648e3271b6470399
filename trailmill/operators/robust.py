"""Lines that outliers don't bend, by candidates from pairs of rows that digests of keys pick."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .model_selection import share_of


def _pairs(df: DataFrame, x: str, y: str, key: str, seed: int, blocks: int) -> DataFrame:
    """Rows in pairs: within a block of rows (by one digest of key) neighbours in the order of another. A row is in one pair at most; there is no pair where x is the same."""
    block = F.floor(share_of(F.col(key), seed + 1) * blocks).cast("int")
    place = F.row_number().over(Window.partitionBy("_block").orderBy(share_of(F.col(key), seed), key)) - 1
    rows = df.select(key, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).na.drop().withColumn("_block", block).withColumn("_at", place)
    two = rows.groupBy("_block", F.floor(F.col("_at") / 2).alias("_pair")).agg(F.min_by("_x", "_at").alias("x1"), F.min_by("_y", "_at").alias("y1"), F.max_by("_x", "_at").alias("x2"), F.max_by("_y", "_at").alias("y2"))
    slope = (F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1"))
    return two.filter("x1 <> x2").select("_block", "_pair", slope.alias("slope"), (F.col("y1") - slope * F.col("x1")).alias("intercept"))


def median_line(df: DataFrame, x: str, y: str, key: str, *, seed: int = 0, blocks: int = 64) -> DataFrame:
    """One row: slope, the median of the slopes of pairs of rows, and intercept, the median of what the slope leaves. All rows take part in pairs, each in one, so the work is in proportion to the rows; a row's partner is a matter of digests."""
    slope = _pairs(df, x, y, key, seed, blocks).agg(F.percentile_approx("slope", 0.5, 1_000_000).alias("slope"))
    left = df.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).na.drop().crossJoin(F.broadcast(slope))
    return left.groupBy("slope").agg(F.percentile_approx(F.col("_y") - F.col("slope") * F.col("_x"), 0.5, 1_000_000).alias("intercept"))


def consensus_line(df: DataFrame, x: str, y: str, key: str, *, within: float, tries: int = 50, seed: int = 0, blocks: int = 64) -> DataFrame:
    """One row: slope, intercept and n of least squares over the rows within that distance of the best of tries lines, each through a pair of rows: the line with most such rows, ties to the least sum of squares among them. The lines, tries of them, are collected."""
    lines = _pairs(df, x, y, key, seed, blocks).filter("_pair = 0").orderBy("_block").limit(tries).collect()
    rows = df.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).na.drop()
    if not lines:
        return rows.agg(F.regr_slope("_y", "_x").alias("slope"), F.regr_intercept("_y", "_x").alias("intercept"), F.count("*").alias("n"))
    off = [F.abs(F.col("_y") - float(r.slope) * F.col("_x") - float(r.intercept)) for r in lines]
    found = rows.agg(*[F.count_if(o <= within) for o in off], *[F.sum(F.when(o <= within, o * o)) for o in off]).head()
    n = len(lines)
    best = min(range(n), key=lambda i: (-found[i], found[n + i] or 0.0, i))
    near = rows.filter(off[best] <= within)
    return near.agg(F.regr_slope("_y", "_x").alias("slope"), F.regr_intercept("_y", "_x").alias("intercept"), F.count("*").alias("n"))

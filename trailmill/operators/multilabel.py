"""Ranking metrics of rows with several true labels, over long scores (row, cls, score, y: 0 or 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .classification import ratio


def _ranked(scores: DataFrame, row: str, score: str) -> DataFrame:
    """rank: how many labels of the row score at least as high."""
    w = Window.partitionBy(row).orderBy(F.desc(score)).rangeBetween(Window.unboundedPreceding, 0)
    return scores.withColumns({"_rank": F.count("*").over(w), "_true": F.sum("y").over(w)})


def coverage_error(scores: DataFrame, row: str = "row", score: str = "score") -> DataFrame:
    """One row: how far down the ranking one must go, on average, to find all true labels."""
    per = _ranked(scores, row, score).groupBy(row).agg(F.max(F.when(F.col("y") == 1, F.col("_rank")).otherwise(0)).alias("c"))
    return per.agg(F.avg("c").alias("coverage_error"))


def ranking_precision(scores: DataFrame, row: str = "row", score: str = "score") -> DataFrame:
    """One row: mean over true labels of the share of true ones among those ranked at least as high; rows without or with only true labels count as 1."""
    r = _ranked(scores, row, score)
    per = r.groupBy(row).agg(F.sum("y").alias("t"), F.count("*").alias("n"), F.avg(F.when(F.col("y") == 1, F.col("_true") / F.col("_rank"))).alias("p"))
    return per.agg(F.avg(F.when((F.col("t") == 0) | (F.col("t") == F.col("n")), 1.0).otherwise(F.col("p"))).alias("ranking_precision"))


def ranking_loss(scores: DataFrame, row: str = "row", score: str = "score") -> DataFrame:
    """One row: share of wrongly ordered pairs of a true and a false label (ties are wrong), from running sums."""
    r = _ranked(scores, row, score)
    per = r.groupBy(row).agg(F.sum("y").alias("t"), F.count("*").alias("n"), F.sum(F.when(F.col("y") == 1, F.col("_rank") - F.col("_true")).otherwise(0)).alias("w"))
    return per.agg(F.avg(ratio(F.col("w"), F.col("t") * (F.col("n") - F.col("t")))).alias("ranking_loss"))


def set_scores(scores: DataFrame, row: str = "row", predicted: str = "p") -> DataFrame:
    """One row: share of rows with exactly the true labels, Hamming loss and mean Jaccard similarity of predicted and true sets."""
    y, p = F.col("y"), F.col(predicted)
    per = scores.groupBy(row).agg(F.min((y == p).cast("int")).alias("e"), F.avg((y != p).cast("double")).alias("h"), F.sum(y * p).alias("i"), F.sum(F.greatest(y, p)).alias("u"))
    return per.agg(F.avg("e").alias("subset_accuracy"), F.avg("h").alias("hamming_loss"), F.avg(F.when(F.col("u") == 0, 0.0).otherwise(F.col("i") / F.col("u"))).alias("jaccard"))

"""Grey images as tables of pixels (i, j, x): patches of them and graphs of neighbouring pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def patches(pixels: DataFrame, height: int, width: int, rows: int, columns: int) -> DataFrame:
    """(pi, pj, di, dj, x): every patch of height x width that lies within the image of rows x columns, by its corner, and its pixels by their places in it. Each pixel goes to the patches that hold it, without a join."""
    step = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    d = pixels.withColumn("di", F.explode(step(height))).withColumn("dj", F.explode(step(width)))
    d = d.withColumns({"pi": F.col("i") - F.col("di"), "pj": F.col("j") - F.col("dj")})
    inside = (F.col("pi") >= 0) & (F.col("pj") >= 0) & (F.col("pi") <= rows - height) & (F.col("pj") <= columns - width)
    return d.filter(inside).select("pi", "pj", "di", "dj", "x")


def from_patches(found: DataFrame) -> DataFrame:
    """(i, j, x): the image whose pixels are the means of what the patches have in their places."""
    return found.groupBy((F.col("pi") + F.col("di")).alias("i"), (F.col("pj") + F.col("dj")).alias("j")).agg(F.avg("x").alias("x"))


def pixel_links(pixels: DataFrame) -> DataFrame:
    """(ai, aj, bi, bj, gradient) for each pixel and its neighbour below or to the right, where both are there: the size of the difference of their values."""
    ends = F.array(F.struct((F.col("i") + 1).alias("bi"), F.col("j").alias("bj")), F.struct(F.col("i").alias("bi"), (F.col("j") + 1).alias("bj")))
    a = pixels.select(F.col("i").alias("ai"), F.col("j").alias("aj"), F.col("x").alias("ax"), F.explode(ends).alias("e")).select("ai", "aj", "ax", "e.bi", "e.bj")
    b = pixels.select(F.col("i").alias("bi"), F.col("j").alias("bj"), F.col("x").alias("bx"))
    return a.join(b, ["bi", "bj"]).select("ai", "aj", "bi", "bj", F.abs(F.col("ax") - F.col("bx")).alias("gradient"))

"""Places in an order of all rows, and quantiles, without one task that sees all rows: rows are dealt by ranges, and what ranges hold is added up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored


def _ranges(df: DataFrame, order: Sequence[str | Column], weight: Column) -> tuple[DataFrame, dict[int, int]]:
    """df dealt by ranges of order, with _range and _weight, and how much weight lies before each range."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = stored(df.withColumn("_weight", weight).repartitionByRange(*cols).withColumn("_range", F.spark_partition_id()), "ranges")
    before, total = {}, 0
    for r in dealt.groupBy("_range").agg(F.sum("_weight").alias("w")).orderBy("_range").collect():
        before[r["_range"]] = total
        total += r["w"]
    before[-1] = total
    return dealt, before


def numbered(df: DataFrame, *order: str | Column, out: str) -> DataFrame:
    """df with each row's place in the order, from 0. The order should tell rows apart; equal ones are numbered as they come."""
    dealt, before = _ranges(df, order, F.lit(1))
    offsets = df.sparkSession.createDataFrame([(k, n) for k, n in before.items()], "_range int, _before long")
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1 + F.col("_before")
    return dealt.join(F.broadcast(offsets), "_range").withColumn(out, place).drop("_range", "_before", "_weight")


def quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> list[float | None]:
    """Exact quantiles, interpolated between neighbours, of a column's values; nulls don't count, without values all are null. Rows are counted by value first."""
    g = df.select(F.col(column).cast("double").alias("x")).filter(F.col("x").isNotNull()).groupBy("x").agg(F.count("*").alias("n"))
    dealt, before = _ranges(g, ["x"], F.col("n"))
    total = before.pop(-1)
    if not total:
        return [None] * len(shares)
    wanted = sorted({int(p) for s in shares for p in (s * (total - 1), min(total - 1, int(s * (total - 1)) + 1))})
    at = {p: max((k for k, b in before.items() if b <= p), key=lambda k: before[k]) for p in wanted}
    upto = F.sum("n").over(Window.partitionBy("_range").orderBy("x"))
    rows = dealt.filter(F.col("_range").isin(sorted(set(at.values())))).withColumn("upto", upto)
    hit = F.lit(False)
    for p, k in at.items():
        hit = hit | ((F.col("_range") == k) & (F.col("upto") > p - before[k]) & (F.col("upto") - F.col("n") <= p - before[k]))
    found = [(before[r["_range"]] + r["upto"] - r["n"], before[r["_range"]] + r["upto"], r["x"]) for r in rows.filter(hit).collect()]
    value = {p: next(x for a, b, x in found if a <= p < b) for p in wanted}
    out = []
    for s in shares:
        p = s * (total - 1)
        a, b = value[int(p)], value[min(total - 1, int(p) + 1)]
        out.append(a + (b - a) * (p - int(p)))
    return out

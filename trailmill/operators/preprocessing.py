"""Feature scaling and encoding. Statistics are one aggregation over all columns and reach the rows as literals, so rows are never shuffled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import numbered, quantiles


def _stats(df: DataFrame, columns: Sequence[str], **aggs) -> dict[str, dict[str, float]]:
    row = df.agg(*[f(F.col(c)).alias(f"{n}|{c}") for n, f in aggs.items() for c in columns]).head()
    return {n: {c: row[f"{n}|{c}"] for c in columns} for n in aggs}


def _safe(x: float | None) -> float:
    return float(x) if x else 1.0


def standard_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Zero mean and unit population deviation; constant columns are only centred."""
    s = _stats(df, columns, m=F.avg, d=F.stddev_pop)
    return df.withColumns({c: (F.col(c) - (s["m"][c] or 0.0)) / _safe(s["d"][c]) for c in columns})


def minmax_scale(df: DataFrame, columns: Sequence[str], low: float = 0.0, high: float = 1.0) -> DataFrame:
    s = _stats(df, columns, a=F.min, b=F.max)
    return df.withColumns({c: (F.col(c) - float(s["a"][c] or 0.0)) / _safe((s["b"][c] or 0.0) - (s["a"][c] or 0.0)) * (high - low) + low for c in columns})


def maxabs_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    s = _stats(df, columns, m=lambda c: F.max(F.abs(c)))
    return df.withColumns({c: F.col(c) / _safe(s["m"][c]) for c in columns})


def robust_scale(df: DataFrame, columns: Sequence[str], low: float = 0.25, high: float = 0.75) -> DataFrame:
    """Median 0 and unit range between two quantiles (interpolated)."""
    s = {c: quantiles(df, c, [0.5, low, high]) for c in columns}
    return df.withColumns({c: (F.col(c) - float(m or 0.0)) / _safe((b or 0.0) - (a or 0.0)) for c, (m, a, b) in s.items()})


def normalize(df: DataFrame, columns: Sequence[str], kind: str = "l2") -> DataFrame:
    """Each row by its l1, l2 or maximum norm over columns; zero rows stay."""
    parts = [F.abs(F.col(c).cast("double")) for c in columns]
    n = {"l1": sum(parts, F.lit(0.0)), "l2": F.sqrt(sum((p * p for p in parts), F.lit(0.0))), "max": F.greatest(*parts) if len(parts) > 1 else parts[0]}[kind]
    return df.withColumns({c: F.col(c) / F.when(n == 0, 1.0).otherwise(n) for c in columns})


def binarize(df: DataFrame, columns: Sequence[str], threshold: float = 0.0) -> DataFrame:
    return df.withColumns({c: (F.col(c) > threshold).cast("int") for c in columns})


def categories(df: DataFrame, column: str) -> DataFrame:
    """column and code: distinct values in order, from 0. Codes go over the distinct values only."""
    return numbered(df.select(column).filter(F.col(column).isNotNull()).distinct(), column, out="code").withColumn("code", F.col("code").cast("int"))


def ordinal(df: DataFrame, column: str, out: str) -> DataFrame:
    """df with the code of column; unknown and null values have none."""
    return df.join(categories(df, column).withColumnRenamed("code", out), column, "left")


def one_hot(df: DataFrame, column: str, values: Sequence[object]) -> DataFrame:
    """df with an indicator column for each of values, named column_value."""
    return df.withColumns({f"{column}_{v}": F.coalesce((F.col(column) == F.lit(v)).cast("int"), F.lit(0)) for v in values})


def bins_uniform(df: DataFrame, column: str, k: int, out: str) -> DataFrame:
    """Number of the bin (0 to k - 1) of equal width between minimum and maximum."""
    s = _stats(df, [column], a=F.min, b=F.max)
    a, width = float(s["a"][column] or 0.0), _safe((s["b"][column] or 0.0) - (s["a"][column] or 0.0))
    return df.withColumn(out, F.greatest(F.least(F.floor((F.col(column) - a) / width * k), F.lit(k - 1)), F.lit(0)).cast("int"))


def bins_quantile(df: DataFrame, column: str, k: int, out: str) -> DataFrame:
    """Number of the bin between k interpolated quantiles; a value on an edge belongs to the bin above."""
    edges = [e for e in quantiles(df, column, [i / k for i in range(1, k)]) if e is not None]
    n: Column = F.lit(0)
    for e in sorted(set(edges)):
        n = n + F.when(F.col(column) >= float(e), 1).otherwise(0)
    return df.withColumn(out, n)


def impute(df: DataFrame, columns: Sequence[str], how: str = "mean") -> DataFrame:
    """Nulls and NaN replaced by the column's mean or median."""
    clean = df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})
    s = _stats(clean, columns, m=F.avg if how == "mean" else (lambda c: F.percentile(c, 0.5)))
    return clean.withColumns({c: F.coalesce(F.col(c), F.lit(s["m"][c])) for c in columns})


def missing_indicator(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{c}_missing": (F.col(c).isNull() | F.isnan(c)).cast("int") for c in columns})


def polynomial(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df with all products of two of columns, squares included, named a*b."""
    return df.withColumns({f"{a}*{b}": F.col(a) * F.col(b) for i, a in enumerate(columns) for b in columns[i:]})


def quantile_rank(df: DataFrame, column: str, out: str, *, group: Sequence[str]) -> DataFrame:
    """Share of the group's rows with a smaller value (0 to 1)."""
    return df.withColumn(out, F.percent_rank().over(Window.partitionBy(*group).orderBy(column)))


def label_sets(df: DataFrame, column: str, values: Sequence[object]) -> DataFrame:
    """df with a column column=value, 1 or 0, for each value that an array column may hold."""
    return df.withColumns({f"{column}={v}": F.coalesce(F.array_contains(column, F.lit(v)).cast("int"), F.lit(0)) for v in values})


def impute_iterative(df: DataFrame, columns: Sequence[str], rounds: int = 10) -> DataFrame:
    """df with the nulls of columns filled: first with means, then rounds times, column by column, with the prediction of a linear model of the other columns, learned from rows that have the column. A model needs one aggregation."""
    from .models import least_squares

    missing = [c for c in columns if df.filter(F.col(c).isNull()).limit(1).count()]
    means = df.agg(*[F.avg(c).alias(c) for c in columns]).head()
    flags = df.withColumns({f"_null_{c}": F.col(c).isNull() for c in missing})
    now = flags.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(means[c])) for c in columns})
    for _ in range(rounds):
        for c in missing:
            others = [x for x in columns if x != c]
            m = least_squares(now.filter(~F.col(f"_null_{c}")), c, others)
            now = now.withColumn(c, F.when(F.col(f"_null_{c}"), m.predict(others)).otherwise(F.col(c)))
    return now.select(*df.columns)

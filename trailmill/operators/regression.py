"""Regression metrics over (y, p) columns: one aggregation each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def errors(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """One row: mean absolute, squared, root squared, squared log and percentage error, largest and median absolute error."""
    d = F.col(y) - F.col(p)
    log = F.log1p(F.col(y)) - F.log1p(F.col(p))
    return df.agg(
        F.avg(F.abs(d)).alias("mae"),
        F.avg(d * d).alias("mse"),
        F.sqrt(F.avg(d * d)).alias("rmse"),
        F.avg(log * log).alias("msle"),
        F.avg(F.abs(d) / F.greatest(F.abs(F.col(y)), F.lit(2.0**-52))).alias("mape"),
        F.max(F.abs(d)).alias("max_error"),
        F.percentile(F.abs(d), 0.5).alias("median_ae"),
    )


def explained(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """One row: R2 and explained variance."""
    d = F.col(y) - F.col(p)
    a = df.agg(F.sum(d * d).alias("sse"), F.var_pop(y).alias("v"), F.var_pop(d).alias("vd"), F.count("*").alias("n"))
    return a.select((1 - F.try_divide(F.col("sse"), F.col("v") * F.col("n"))).alias("r2"), (1 - F.try_divide(F.col("vd"), F.col("v"))).alias("explained_variance"))


def deviances(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """One row: mean Poisson and gamma deviance of positive values, and pinball loss at one half."""
    a, b = F.col(y), F.col(p)
    return df.agg(F.avg(2 * (a * F.ln(a / b) - a + b)).alias("poisson"), F.avg(2 * (F.ln(b / a) + a / b - 1)).alias("gamma"), F.avg(F.when(a >= b, 0.5 * (a - b)).otherwise(0.5 * (b - a))).alias("pinball"))


def tweedie(df: DataFrame, power: float, y: str = "y", p: str = "p") -> DataFrame:
    """One row: mean deviance of the Tweedie law with a power other than 0, 1 and 2 (those are squares, Poisson and gamma)."""
    a, b, k = F.col(y).cast("double"), F.col(p).cast("double"), float(power)
    d = 2 * (F.pow(F.greatest(a, F.lit(0.0)), F.lit(2 - k)) / ((1 - k) * (2 - k)) - a * F.pow(b, F.lit(1 - k)) / (1 - k) + F.pow(b, F.lit(2 - k)) / (2 - k))
    return df.agg(F.avg(d).alias("tweedie"))


def rank_correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: Spearman's correlation, from mean ranks of distinct values. Each column's distinct values are ranked by counts of what is smaller."""
    from pyspark.sql import Window

    def ranks(c: str) -> DataFrame:
        g = df.groupBy(c).agg(F.count("*").alias("n"))
        return g.select(F.col(c).alias(f"_{c}"), (F.sum("n").over(Window.orderBy(c)) - (F.col("n") - 1) / 2).alias(f"r_{c}"))

    j = df.select(x, y).join(ranks(x), F.col(x) == F.col(f"_{x}")).join(ranks(y), F.col(y) == F.col(f"_{y}"))
    return j.agg(F.corr(f"r_{x}", f"r_{y}").alias("rho"))


def increasing(df: DataFrame, x: str, y: str) -> bool:
    """Whether y rises with x, by the sign of the rank correlation."""
    return (rank_correlation(df, x, y).head()[0] or 0.0) >= 0


def isotonic(df: DataFrame, x: str, y: str, rising: bool = True) -> DataFrame:
    """x and fitted for each different x: the best monotone function, every x weighing as many rows as it has."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    g = df.groupBy(x).agg(F.avg(y).alias("label"), F.count("*").cast("double").alias("weight"))
    g = VectorAssembler(inputCols=[x], outputCol="features").transform(g.withColumn(x, F.col(x).cast("double")))
    m = IsotonicRegression(isotonic=rising, weightCol="weight").fit(g)
    return m.transform(g).select(x, F.col("prediction").alias("fitted"))

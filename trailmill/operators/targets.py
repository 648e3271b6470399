"""What a column of labels is like, weights that balance it, and rows in a dealt order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FractionalType

from .model_selection import share_of
from .ranks import numbered


def kinds(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column and kind: multilabel for arrays, continuous for numbers that aren't all whole, else binary with up to two different values, and multiclass."""
    out = []
    for c in columns:
        t = df.schema[c].dataType
        if isinstance(t, ArrayType):
            out.append((c, "multilabel"))
            continue
        broken = F.count_if(F.col(c) != F.floor(c)) if isinstance(t, FractionalType) else F.lit(0)
        few = df.select(c).filter(F.col(c).isNotNull()).distinct().limit(3).count() <= 2
        out.append((c, "continuous" if df.agg(broken).head()[0] else "binary" if few else "multiclass"))
    return df.sparkSession.createDataFrame(out, "column string, kind string")


def all_labels(*columns: DataFrame) -> DataFrame:
    """The different values of tables of one column each, together."""
    out = columns[0]
    for c in columns[1:]:
        out = out.union(c)
    return out.distinct()


def sample_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """df with a weight that gives each label the same sum: rows / (labels * rows of the label)."""
    c = df.groupBy(label).agg(F.count("*").alias("_n"))
    all_ = c.agg(F.sum("_n").alias("_t"), F.count("*").alias("_k"))
    c = c.crossJoin(F.broadcast(all_)).select(label, (F.col("_t") / (F.col("_k") * F.col("_n"))).alias(out))
    return df.join(c, label)


def shuffled(df: DataFrame, key: str, seed: int = 0, out: str = "place") -> DataFrame:
    """df with a place in an order by digest of key."""
    return numbered(df, share_of(F.col(key), seed), F.col(key), out=out)


def drawn(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without repetition: those first by digest of key."""
    return df.orderBy(share_of(F.col(key), seed), key).limit(n)


def asymmetric(matrix: DataFrame) -> DataFrame:
    """(i, j, x, other): the entries above the diagonal of a sparse matrix (i, j, x) that differ from those below, absent ones being 0; none if it is symmetric."""
    up = matrix.filter("i < j").select("i", "j", "x")
    low = matrix.filter("i > j").select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("x").alias("other"))
    return up.join(low, ["i", "j"], "full").select("i", "j", F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("other", F.lit(0.0)).alias("other")).filter("x <> other")

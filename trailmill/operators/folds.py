"""Assignment of rows to folds and splits, by ranks within groups or by hash; nothing is gathered in one place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import numbered


def k_fold(df: DataFrame, key: str, k: int, out: str = "fold") -> DataFrame:
    """fold by a hash of key: stable under new rows and without a shuffle."""
    return df.withColumn(out, F.pmod(F.xxhash64(key), F.lit(k)).cast("int"))


def modular_fold(df: DataFrame, key: str, k: int, out: str = "fold") -> DataFrame:
    """fold by key modulo k, for keys that are numbers without gaps."""
    return df.withColumn(out, F.pmod(F.col(key), F.lit(k)).cast("int"))


def contiguous_fold(df: DataFrame, order: Sequence[str], k: int, out: str = "fold") -> DataFrame:
    """fold by place in an order: k runs of rows, as even as can be, the longer ones first."""
    n = df.count()
    place, big, size = F.col("_place"), n % k, n // k
    late = F.floor((place - big * (size + 1)) / max(1, size)) + big
    fold = F.when(place < big * (size + 1), F.floor(place / (size + 1))).otherwise(late)
    return numbered(df, *order, out="_place").withColumn(out, fold.cast("int")).drop("_place")


def stratified_fold(df: DataFrame, label: str, key: str, k: int, out: str = "fold", salts: int = 64) -> DataFrame:
    """fold such that each label's rows are dealt evenly: rows are ranked within (label, a digest of key), so a label that holds most rows is dealt over salts tasks."""
    from .model_selection import share_of

    w = Window.partitionBy(label, "_salt").orderBy(key)
    return df.withColumn("_salt", F.floor(share_of(F.col(key)) * salts).cast("int")).withColumn(out, F.pmod(F.row_number().over(w) - 1 + F.col("_salt"), F.lit(k)).cast("int")).drop("_salt")


def group_fold(df: DataFrame, group: str, k: int, out: str = "fold") -> DataFrame:
    """fold such that a group's rows stay together: groups by size, dealt in turn."""
    g = df.groupBy(group).agg(F.count("*").alias("_n"))
    g = numbered(g, F.desc("_n"), F.col(group), out="_place").select(group, F.pmod(F.col("_place"), F.lit(k)).cast("int").alias(out))
    return df.join(g, group)


def time_splits(df: DataFrame, order: Sequence[str], k: int, *, group: Sequence[str]) -> DataFrame:
    """split (1 to k), part (train or test) for each row and each split it takes part in, by its place in time within the group: split i tests the i-th of k + 1 pieces and trains on those before."""
    piece = F.ntile(k + 1).over(Window.partitionBy(*group).orderBy(*order)) - 1
    s = df.withColumn("_piece", piece).withColumn("split", F.explode(F.sequence(F.lit(1), F.lit(k))))
    return s.filter(F.col("_piece") <= F.col("split")).withColumn("part", F.when(F.col("_piece") == F.col("split"), "test").otherwise("train")).drop("_piece")


def train_test(df: DataFrame, key: str, test_share: float = 0.25, seed: int = 0, out: str = "part") -> DataFrame:
    """part (train or test) by the MD5 digest of key: the same rows in every run, whatever the partitions."""
    return digest_split(df, key, test_share, seed, out)


def shuffle_splits(df: DataFrame, key: str, n: int, test_share: float = 0.25) -> DataFrame:
    """split (0 to n - 1) and part for each row and split, drawn independently."""
    many = df.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    h = F.pmod(F.xxhash64("split", key), F.lit(1_000_000))
    return many.withColumn("part", F.when(h < int(test_share * 1_000_000), "test").otherwise("train"))


def leave_one_group_out(df: DataFrame, group: str) -> DataFrame:
    """fold of each row: the place of its group among all groups in order."""
    from .preprocessing import ordinal

    return ordinal(df, group, "fold")


def by_digest(df: DataFrame, key: str, n: int, seed: int = 0, out: str = "fold") -> DataFrame:
    """fold by the MD5 digest of key and a seed: the same in any system."""
    from .model_selection import share_of

    return df.withColumn(out, F.floor(share_of(F.col(key), seed) * n).cast("int"))


def repeated(df: DataFrame, key: str, k: int, times: int) -> DataFrame:
    """(repeat, fold) of each row for each of several ways to deal them."""
    from .model_selection import share_of

    many = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    own = F.element_at(F.array(*[F.floor(share_of(F.col(key), s) * k).cast("int") for s in range(times)]), F.col("repeat") + 1)
    return many.withColumn("fold", own)


def digest_split(df: DataFrame, key: str, test_share: float = 0.25, seed: int = 0, out: str = "part") -> DataFrame:
    """part (train or test) by the MD5 digest of key; give a group's column as key and groups stay together."""
    from .model_selection import share_of

    return df.withColumn(out, F.when(share_of(F.col(key), seed) < test_share, "test").otherwise("train"))


def stratified_split(df: DataFrame, label: str, key: str, test_share: float = 0.25, seed: int = 0, blocks: int = 16, out: str = "part") -> DataFrame:
    """part such that each label has its share in each of blocks blocks of rows, to the nearest row: rows are ranked within label and block by digest, so a label that holds most rows is dealt over blocks tasks."""
    from .model_selection import share_of

    rows = df.withColumn("_block", F.floor(share_of(F.col(key), seed + 1) * blocks).cast("int"))
    one = Window.partitionBy(label, "_block")
    place = F.row_number().over(one.orderBy(share_of(F.col(key), seed), key))
    return rows.withColumn(out, F.when(place <= F.round(F.count("*").over(one) * test_share), "test").otherwise("train")).drop("_block")


def leave_out(groups: Sequence[object], p: int) -> list[tuple]:
    """The sets of p groups (or rows) that are left out in turn; there are as many as there are such combinations."""
    from itertools import combinations

    return list(combinations(groups, p))


def leave_groups_out(df: DataFrame, group: str, p: int) -> DataFrame:
    """(split, part) of each row for each combination of p groups that are left out; the groups are collected."""
    values = [r[0] for r in df.select(group).distinct().orderBy(group).collect()]
    sets = leave_out(values, p)
    parts = F.array(*[F.struct(F.lit(i).alias("split"), F.when(F.col(group).isin(*s), "test").otherwise("train").alias("part")) for i, s in enumerate(sets)])
    return df.withColumn("_s", F.explode(parts)).select(*df.columns, "_s.split", "_s.part")


def predefined(df: DataFrame, fold: str) -> DataFrame:
    """(split, part) of each row for each given fold; rows with a fold below 0 always train."""
    values = [r[0] for r in df.select(fold).filter(F.col(fold) >= 0).distinct().orderBy(fold).collect()]
    parts = F.array(*[F.struct(F.lit(i).alias("split"), F.when(F.col(fold) == v, "test").otherwise("train").alias("part")) for i, v in enumerate(values)])
    return df.withColumn("_s", F.explode(parts)).select(*df.columns, "_s.split", "_s.part")


def resampled(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """df with times (0 to 3 and more): how often a bootstrap sample of as many rows takes each, by the Poisson law of mean 1 and the digest of key."""
    from math import exp, factorial

    from .model_selection import share_of

    u, below, times = share_of(F.col(key), seed), 0.0, F.lit(n)
    cuts = []
    for k in range(n):
        below += exp(-1) / factorial(k)
        cuts.append((below, k))
    for cut, k in reversed(cuts):
        times = F.when(u < cut, F.lit(k)).otherwise(times)
    return df.withColumn("times", times)


def even_slices(n: int, k: int) -> list[tuple[int, int]]:
    """k ranges that cover 0 to n, as even as can be, the longer ones first."""
    q, r = divmod(n, k)
    ends = [0]
    for i in range(k):
        ends.append(ends[-1] + q + (i < r))
    return [(a, b) for a, b in zip(ends, ends[1:], strict=False) if b > a]

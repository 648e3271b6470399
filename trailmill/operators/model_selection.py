"""Scores of steps on rows that they haven't learned from, and searches over their parameters."""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .compose import Step

#: Scores are aggregations over the columns target and prediction: the larger the better.
Score = Callable[[Column, Column], Column]


EPSILON = 2.0**-52


def r2(y: Column, p: Column) -> Column:
    return 1 - F.sum((y - p) * (y - p)) / (F.var_pop(y) * F.count(y))


def negative_squares(y: Column, p: Column) -> Column:
    return -F.avg((y - p) * (y - p))


def negative_absolute(y: Column, p: Column) -> Column:
    return -F.avg(F.abs(y - p))


def accuracy(y: Column, p: Column) -> Column:
    return F.avg((y == p).cast("double"))


SCORES: dict[str, Score] = {"r2": r2, "neg_mean_squared_error": negative_squares, "neg_mean_absolute_error": negative_absolute, "accuracy": accuracy}


def scorer(name: str | Score) -> Score:
    return SCORES[name] if isinstance(name, str) else name


def folds_of(df: DataFrame, fold: str) -> list:
    return [r[0] for r in df.select(fold).distinct().orderBy(fold).collect()]


def cross_predict(step: Step, df: DataFrame, fold: str = "fold") -> DataFrame:
    """df with the columns that step makes, each row's by what the other folds taught."""
    out = None
    for k in folds_of(df, fold):
        part = step(df.filter(F.col(fold) != F.lit(k)))(df.filter(F.col(fold) == F.lit(k)))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else step(df)(df)


def cross_validate(step: Step, df: DataFrame, target: str, scores: Sequence[str] = ("r2",), fold: str = "fold", prediction: str = "prediction", train: bool = False) -> DataFrame:
    """(fold, one column a score): each fold's by what the others taught; with train also train_... on the rows learned from. One aggregation for all folds."""
    made = [scorer(s)(F.col(target).cast("double"), F.col(prediction).cast("double")).alias(s) for s in scores]
    out = cross_predict(step, df, fold).groupBy(fold).agg(*made)
    if train:
        own = None
        for k in folds_of(df, fold):
            rest = df.filter(F.col(fold) != F.lit(k))
            part = step(rest)(rest).withColumn("_k", F.lit(k))
            own = part if own is None else own.unionByName(part)
        out = out.join(own.groupBy(F.col("_k").alias(fold)).agg(*[m.alias(f"train_{s}") for m, s in zip(made, scores, strict=True)]), fold)
    return out


def parameter_grid(**values: Sequence) -> list[dict]:
    """All combinations, the last parameter changing fastest."""
    return [dict(zip(values, c, strict=True)) for c in itertools.product(*values.values())]


def parameter_sample(n: int, seed: int = 0, **values: Sequence) -> list[dict]:
    """n of the combinations, drawn by a digest of each without repetition."""
    return sorted(parameter_grid(**values), key=lambda p: hashlib.md5(f"{seed}{json.dumps(p, sort_keys=True)}".encode()).hexdigest())[:n]


def search(make: Callable[..., Step], params: Sequence[dict], df: DataFrame, target: str, score: str = "r2", fold: str = "fold") -> DataFrame:
    """(place, params as JSON, mean and deviation of the score over folds, rank) for each set of parameters; means that are equal, or differ by rounding (two units of the last place), share a rank. The table of results is as long as params."""
    out = None
    for i, p in enumerate(params):
        one = cross_validate(make(**p), df, target, (score,), fold).agg(F.avg(score).alias("mean_score"), F.stddev_pop(score).alias("std_score"))
        one = one.select(F.lit(i).alias("place"), F.lit(json.dumps(p, sort_keys=True)).alias("params"), "mean_score", "std_score")
        out = one if out is None else out.unionByName(one)
    # a mean is worse only by more than what rounding leaves of a score; the list of means is as long as params
    mean, every = F.col("mean_score"), F.collect_list("mean_score").over(Window.partitionBy())
    better = F.filter(every, lambda m: m > mean + 2 * EPSILON * F.greatest(F.abs(mean), F.lit(1.0)))
    return out.withColumn("rank", F.when(mean.isNull(), F.size(every)).otherwise(F.size(better)) + 1)


def best(results: DataFrame) -> dict:
    return json.loads(results.orderBy("rank", "place").head()["params"])


def share_of(key: Column, seed: int = 0) -> Column:
    """A number from 0 up to 1 by the MD5 digest of a key: rows below a share are a sample of that share, and larger shares hold smaller ones."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 12), 16, 10).cast("double") / float(1 << 48)


def halving_search(make: Callable[..., Step], params: Sequence[dict], df: DataFrame, target: str, key: str, *, factor: int = 3, first_share: float = 0.1, score: str = "r2", fold: str = "fold") -> list[tuple[float, list[dict]]]:
    """Rounds of (share of the rows, the parameters still in): each round scores on factor times more rows and keeps the best 1/factor, until one set is left or all rows have been used."""
    left, share, rounds = list(params), first_share, []
    while True:
        rounds.append((share, left))
        if len(left) == 1 or share >= 1:
            return rounds
        some = search(make, left, df.filter(share_of(F.col(key)) < share), target, score, fold).orderBy("rank", "place").limit(max(1, len(left) // factor)).collect()
        left, share = [json.loads(r["params"]) for r in some], min(1.0, share * factor)


def learning_curve(step: Step, df: DataFrame, target: str, key: str, shares: Sequence[float], score: str = "r2", fold: str = "fold") -> DataFrame:
    """(share, fold, score): each fold's by what that share of the other folds' rows taught."""
    out = None
    for s in shares:
        for k in folds_of(df, fold):
            f = step(df.filter((F.col(fold) != F.lit(k)) & (share_of(F.col(key)) < s)))
            part = f(df.filter(F.col(fold) == F.lit(k))).groupBy(fold).agg(scorer(score)(F.col(target).cast("double"), F.col("prediction")).alias(score)).withColumn("share", F.lit(float(s)))
            out = part if out is None else out.unionByName(part)
    return out


def validation_curve(make: Callable[..., Step], name: str, values: Sequence, df: DataFrame, target: str, score: str = "r2", fold: str = "fold") -> DataFrame:
    """(value, fold, train and test score) for each value of one parameter."""
    out = None
    for v in values:
        one = cross_validate(make(**{name: v}), df, target, (score,), fold, train=True).withColumn("value", F.lit(v))
        out = one if out is None else out.unionByName(one)
    return out


def permuted(df: DataFrame, column: str, key: str, seed: int, blocks: int = 1024) -> DataFrame:
    """df with the column's values dealt anew among rows of the same block: rows are put into blocks by one digest of key and ordered within by two others, and each takes the value of the row at its place in the other order."""
    h = lambda s: F.md5(F.concat(F.lit(f"{seed}.{s}:"), F.col(key).cast("string")))
    cut = F.pmod(F.conv(F.substring(h(0), 1, 8), 16, 10).cast("long"), F.lit(blocks)).cast("int")
    rows = df.withColumn("_block", cut)
    own = rows.withColumn("_at", F.row_number().over(Window.partitionBy("_block").orderBy(h(1), key))).drop(column)
    other = rows.select("_block", F.row_number().over(Window.partitionBy("_block").orderBy(h(2), key)).alias("_at"), column)
    return own.join(other, ["_block", "_at"]).drop("_block", "_at")


def permutation_scores(step: Step, df: DataFrame, target: str, key: str, *, rounds: int = 10, score: str = "r2", fold: str = "fold", blocks: int = 1024) -> DataFrame:
    """(round, score): the mean score over folds, with the target as it is (round 0) and permuted."""
    out = None
    for i in range(rounds + 1):
        one = cross_validate(step, df if not i else permuted(df, target, key, i, blocks), target, (score,), fold).agg(F.avg(score).alias(score)).withColumn("round", F.lit(i))
        out = one if out is None else out.unionByName(one)
    return out


def permutation_importance(apply: Callable[[DataFrame], DataFrame], df: DataFrame, columns: Sequence[str], target: str, key: str, *, score: str = "r2", seed: int = 1, blocks: int = 1024) -> DataFrame:
    """(column, drop): how much the score of a learned step falls when a column's values are permuted."""
    made = lambda d: apply(d).agg(scorer(score)(F.col(target).cast("double"), F.col("prediction")).alias("s"))
    out = None
    for c in columns:
        one = made(df).crossJoin(F.broadcast(made(permuted(df, c, key, seed, blocks)).withColumnRenamed("s", "p"))).select(F.lit(c).alias("column"), (F.col("s") - F.col("p")).alias("drop"))
        out = one if out is None else out.unionByName(one)
    return out




def forward_selection(make: Callable[[list[str]], Step], columns: Sequence[str], k: int, df: DataFrame, target: str, score: str = "r2", fold: str = "fold") -> list[tuple[str, float]]:
    """k columns, each the one that adds most to the mean score over folds beside those before it (ties to the first), with that score."""
    chosen: list[tuple[str, float]] = []
    while len(chosen) < k:
        left = [c for c in columns if c not in [x for x, _ in chosen]]
        scores = [cross_validate(make([*[x for x, _ in chosen], c]), df, target, (score,), fold).agg(F.avg(score)).head()[0] for c in left]
        at = max(range(len(left)), key=lambda i: (scores[i], -i))
        chosen.append((left[at], scores[at]))
    return chosen


def trustworthiness(original: DataFrame, embedded: DataFrame, n: int, k: int) -> DataFrame:
    """One row: how far the k nearest rows (query_id, id) in an embedding are near in the original, where embedded has them and original the rank of every row for each query (query_id, id, rank); 1 if all are among the k nearest there. n is the number of rows."""
    far = embedded.join(original, ["query_id", "id"]).select("query_id", F.greatest(F.col("rank") - k, F.lit(0)).alias("off"))
    q = original.agg(F.count_distinct("query_id").alias("q"))
    return far.agg(F.sum("off").alias("s")).crossJoin(F.broadcast(q)).select((1 - 2 / (F.col("q") * k * (2 * n - 3 * k - 1)) * F.col("s")).alias("trustworthiness"))

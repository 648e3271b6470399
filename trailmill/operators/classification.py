"""Classification and ranking metrics over (y, p, score, weight) columns; every one is an aggregation or a cumulative window over distinct scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 for b = 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """y, p, n."""
    return df.groupBy(y, p).agg(F.count("*").alias("n"))


def per_class(df: DataFrame, y: str = "y", p: str = "p", beta: float = 1.0) -> DataFrame:
    """cls, tp, fp, fn, support, precision, recall and f of each class, by one pass over the confusion counts."""
    c = confusion(df, y, p)
    sides = c.select(F.explode(F.array(F.struct(F.col(y).alias("cls"), F.lit(1).alias("t"), (F.col(p) == F.col(y)).alias("hit"), F.col("n")), F.struct(F.col(p).alias("cls"), F.lit(0).alias("t"), (F.col(p) == F.col(y)).alias("hit"), F.col("n")))).alias("s")).select("s.*")
    s = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    agg = sides.groupBy("cls").agg(s((F.col("t") == 1) & F.col("hit")).alias("tp"), s((F.col("t") == 0) & ~F.col("hit")).alias("fp"), s((F.col("t") == 1) & ~F.col("hit")).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    b = beta * beta
    return agg.select("cls", tp, fp, fn, (tp + fn).alias("support"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio((1 + b) * tp, (1 + b) * tp + b * fn + fp).alias("f"), ratio(tp, tp + fp + fn).alias("jaccard"))


def averages(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """One row: macro, weighted and micro precision, recall and F, accuracy and balanced accuracy."""
    c = per_class(df, y, p)
    out = []
    for m in ("precision", "recall", "f"):
        out += [F.avg(m).alias(f"macro_{m}"), ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(f"weighted_{m}")]
    out += [ratio(F.sum("tp"), F.sum(F.col("tp") + F.col("fn"))).alias("accuracy"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy")]
    return c.agg(*out)


def agreement(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """One row: Cohen's kappa, Matthews correlation, Hamming and zero-one loss."""
    c = per_class(df, y, p).agg(F.sum("tp").alias("hit"), F.sum("support").alias("n"), F.sum(F.col("support") * (F.col("tp") + F.col("fp"))).alias("yp"), F.sum(F.col("support") * F.col("support")).alias("yy"), F.sum((F.col("tp") + F.col("fp")) * (F.col("tp") + F.col("fp"))).alias("pp"))
    hit, n, yp, yy, pp = (F.col(k).cast("double") for k in ("hit", "n", "yp", "yy", "pp"))
    return c.select(ratio(hit * n - yp, n * n - yp).alias("kappa"), ratio(hit * n - yp, F.sqrt(n * n - yy) * F.sqrt(n * n - pp)).alias("mcc"), ratio(n - hit, n).alias("hamming"))


def probability_losses(df: DataFrame, y: str = "y", score: str = "score", eps: float = 1e-15) -> DataFrame:
    """One row for labels 0 and 1: log loss and Brier score."""
    s = F.least(F.greatest(F.col(score), F.lit(eps)), F.lit(1 - eps))
    return df.agg(F.avg(-F.when(F.col(y) == 1, F.ln(s)).otherwise(F.ln(1 - s))).alias("log_loss"), F.avg(F.pow(F.col(score) - F.col(y), F.lit(2))).alias("brier"))


def hinge(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """One row: mean hinge loss of labels 0 and 1."""
    return df.agg(F.avg(F.greatest(F.lit(0.0), 1 - F.col(score) * F.when(F.col(y) == 1, 1.0).otherwise(-1.0))).alias("hinge"))


def thresholds(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """score, tps, fps: counts of both labels at or over each distinct score. Rows are summed by score first; the running sums go over ranges of scores that
    are summed in turn, so that no window takes all scores into one task."""
    s = df.groupBy(score).agg(F.count_if(F.col(y) == 1).alias("t"), F.count_if(F.col(y) != 1).alias("f"))
    s = s.withColumn("_r", F.floor(F.col(score) * 1024).cast("long"))
    total = s.groupBy("_r").agg(F.sum("t").alias("rt"), F.sum("f").alias("rf"))
    over = Window.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, -1)
    before = total.select("_r", F.coalesce(F.sum("rt").over(over), F.lit(0)).alias("bt"), F.coalesce(F.sum("rf").over(over), F.lit(0)).alias("bf"))
    w = Window.partitionBy("_r").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    run = s.join(before, "_r").select(F.col(score).alias("score"), (F.sum("t").over(w) + F.col("bt")).alias("tps"), (F.sum("f").over(w) + F.col("bf")).alias("fps"), "t", "f")
    return run


def roc_points(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """score, fpr, tpr at each distinct score."""
    t = thresholds(df, y, score)
    n = df.agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg"))
    return t.crossJoin(F.broadcast(n)).select("score", ratio(F.col("fps"), F.col("neg")).alias("fpr"), ratio(F.col("tps"), F.col("pos")).alias("tpr"))


def ranking_areas(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """One row: area under the ROC curve and average precision."""
    t, f, tps, fps = (F.col(k).cast("double") for k in ("t", "f", "tps", "fps"))
    s = thresholds(df, y, score).agg(F.sum("t").alias("pos"), F.sum("f").alias("neg"), F.sum(f * (tps - t / 2)).alias("area"), F.sum(t * tps / (tps + fps)).alias("ap"))
    return s.select(ratio(F.col("area"), F.col("pos") * F.col("neg")).alias("roc_auc"), ratio(F.col("ap"), F.col("pos")).alias("average_precision"))


def precision_recall_points(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    t = thresholds(df, y, score)
    n = df.agg(F.count_if(F.col(y) == 1).alias("pos"))
    return t.crossJoin(F.broadcast(n)).select("score", ratio(F.col("tps"), F.col("tps") + F.col("fps")).alias("precision"), ratio(F.col("tps"), F.col("pos")).alias("recall"))


def calibration(df: DataFrame, y: str = "y", score: str = "score", bins: int = 10) -> DataFrame:
    """bin, n, mean_score and share of label 1 in bins of equal width over 0 to 1."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int").alias("bin")
    return df.groupBy(b).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(y).cast("double")).alias("share"))


def top_k_accuracy(scores: DataFrame, *, row: str, cls: str, score: str, y: str, k: int) -> DataFrame:
    """One row from long scores (row, cls, score, y): share of rows with the true class among the k best."""
    r = F.row_number().over(Window.partitionBy(row).orderBy(F.desc(score), cls))
    hit = scores.withColumn("_r", r).groupBy(row).agg(F.max(((F.col("_r") <= k) & (F.col(cls) == F.col(y))).cast("int")).alias("hit"))
    return hit.agg(F.avg(F.col("hit").cast("double")).alias("top_k_accuracy"))


def dcg(df: DataFrame, *, query: str, gain: str, score: str, key: str, k: int | None = None) -> DataFrame:
    """query, dcg and ndcg by score; ties by key."""
    w = Window.partitionBy(query)
    r = df.withColumns({"_r": F.row_number().over(w.orderBy(F.desc(score), key)), "_i": F.row_number().over(w.orderBy(F.desc(gain), key))})
    part = lambda rank: F.sum(F.when(F.lit(True) if k is None else F.col(rank) <= k, F.col(gain) / F.log2(F.col(rank) + 1)))
    out = r.groupBy(query).agg(part("_r").alias("dcg"), part("_i").alias("best"))
    return out.select(query, "dcg", ratio(F.col("dcg"), F.col("best")).alias("ndcg"))


def error_points(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """score, false positive and false negative rate at each threshold: the detection error trade-off."""
    p = roc_points(df, y, score)
    return p.select("score", "fpr", (1 - F.col("tpr")).alias("fnr"))


def class_confusions(rows: DataFrame, cls: str = "cls", y: str = "y", p: str = "p") -> DataFrame:
    """cls, tn, fp, fn, tp of each class of a long table with an indicator for truth and prediction."""
    n = lambda a, b: F.count_if((F.col(y) == a) & (F.col(p) == b))
    return rows.groupBy(cls).agg(n(0, 0).alias("tn"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(1, 1).alias("tp"))


def areas_by_class(rows: DataFrame, cls: str = "cls", y: str = "y", score: str = "score") -> DataFrame:
    """cls and area under its ROC curve, by ranks of distinct scores (ties count half); null where a class has no positive or no negative rows."""
    g = rows.groupBy(cls, score).agg(F.count_if(F.col(y) == 1).alias("t"), F.count_if(F.col(y) != 1).alias("f"))
    below = F.sum("f").over(Window.partitionBy(cls).orderBy(score).rowsBetween(Window.unboundedPreceding, -1))
    g = g.withColumn("wins", F.col("t") * (F.coalesce(below, F.lit(0)) + F.col("f") / 2))
    return g.groupBy(cls).agg(F.try_divide(F.sum("wins"), (F.sum("t") * F.sum("f")).cast("double")).alias("roc_auc"))

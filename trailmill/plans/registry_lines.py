"""Fits on one or two columns, where closed forms exist: the same code as for many columns, held against SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decomposition, gram, model_selection, models
from .registry import query
from .registry_models import EV, SEARCH, VALUES, _ridge, _searched, ev

C = F.col
ONE = f"{EV}, m AS (SELECT count(*) AS n, avg(x2) AS mx, avg(y) AS my, covar_pop(x2, y) AS xy, var_pop(x2) AS xx FROM ev)"
TWO = f"{EV}, m AS (SELECT count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, var_pop(x1) AS aa, var_pop(x2) AS bb, covar_pop(x1, x2) AS ab, covar_pop(x1, y) AS ay, covar_pop(x2, y) AS \"by\", var_pop(y) AS yy FROM ev)"


def _row(spark: SparkSession, *values: tuple[str, float, int]) -> DataFrame:
    return spark.createDataFrame([tuple(float(v) for _, v, _ in values)], ", ".join(f"{n} double" for n, _, _ in values)).select(*[F.round(n, d).alias(n) for n, _, d in values])


def _one(spark: SparkSession, sf: str) -> gram.Moments:
    return gram.moments(ev(spark, sf), ["x2"], "y")


def _two(spark: SparkSession, sf: str) -> gram.Moments:
    return gram.moments(ev(spark, sf), ["x1", "x2"], "y")


@query(f"{ONE}, w AS (SELECT *, sign(xy) * greatest(abs(xy) - 100, 0) / xx AS w FROM m) SELECT round(w, 6) AS slope, round(my - w * mx, 5) AS intercept FROM w")
def lasso_line(spark: SparkSession, sf: str) -> DataFrame:
    w = gram.elastic_net(_one(spark, sf), 100.0)
    return _row(spark, ("slope", w.coef[0], 6), ("intercept", w.intercept, 5))


@query(f"{ONE}, w AS (SELECT *, sign(xy) * greatest(abs(xy) - 30, 0) / (xx + 70) AS w FROM m) SELECT round(w, 6) AS slope, round(my - w * mx, 5) AS intercept FROM w")
def elastic_net_line(spark: SparkSession, sf: str) -> DataFrame:
    w = gram.elastic_net(_one(spark, sf), 100.0, 0.3)
    return _row(spark, ("slope", w.coef[0], 6), ("intercept", w.intercept, 5))


@query(f"{ONE} SELECT alpha, round(xy / (xx + alpha / n), 6) AS slope FROM m, (SELECT unnest([0.5, 1000.0, 1000000.0]::DOUBLE[]) AS alpha)")
def ridge_path_line(spark: SparkSession, sf: str) -> DataFrame:
    alphas = [0.5, 1000.0, 1_000_000.0]
    path = gram.ridge_path(_one(spark, sf), alphas)
    return spark.createDataFrame([(a, float(w.coef[0])) for a, w in zip(alphas, path, strict=True)], "alpha double, slope double").withColumn("slope", F.round("slope", 6))


@query(f"{TWO} SELECT round(CASE WHEN abs(ay) / sqrt(aa) >= abs(\"by\") / sqrt(bb) THEN ay / aa ELSE 0 END, 6) AS w1, round(CASE WHEN abs(ay) / sqrt(aa) >= abs(\"by\") / sqrt(bb) THEN 0 ELSE \"by\" / bb END, 6) AS w2 FROM m")
def pursuit_step(spark: SparkSession, sf: str) -> DataFrame:
    w = gram.orthogonal_pursuit(_two(spark, sf), 1)
    return _row(spark, ("w1", w.coef[0], 6), ("w2", w.coef[1], 6))


@query(f"{TWO}, w AS (SELECT *, (ay * ay + \"by\" * \"by\") / (ay * ay * aa + 2 * ay * \"by\" * ab + \"by\" * \"by\" * bb) AS q FROM m) SELECT round(ay * q, 6) AS w1, round(\"by\" * q, 6) AS w2 FROM w")
def partial_least_squares_step(spark: SparkSession, sf: str) -> DataFrame:
    w = gram.partial_least_squares(_two(spark, sf), 1)
    return _row(spark, ("w1", w.coef[0], 6), ("w2", w.coef[1], 6))


def _pair(spark: SparkSession, sf: str) -> DataFrame:
    return ev(spark, sf).select(F.array("x1", "x2").alias("v"))


EIGEN = "SELECT *, (aa + bb) / 2 + sqrt(pow((aa - bb) / 2, 2) + ab * ab) AS l1, (aa + bb) / 2 - sqrt(pow((aa - bb) / 2, 2) + ab * ab) AS l2"


@query(f"{TWO}, e AS ({EIGEN} FROM m), c AS (SELECT *, sqrt(ab * ab + pow(l1 - aa, 2)) AS s FROM e) SELECT round(l1, 4) AS variance_1, round(l2, 4) AS variance_2, round(abs(ab) / s, 6) AS weight_1, round(abs(l1 - aa) / s, 6) AS weight_2 FROM c")
def principal_pair(spark: SparkSession, sf: str) -> DataFrame:
    _, c, v = decomposition.pca(_pair(spark, sf), 2, 2)
    return _row(spark, ("variance_1", v[0], 4), ("variance_2", v[1], 4), ("weight_1", abs(c[0, 0]), 6), ("weight_2", abs(c[0, 1]), 6))


@query(f"{EV}, m AS (SELECT sum(x1 * x1) AS aa, sum(x2 * x2) AS bb, sum(x1 * x2) AS ab FROM ev), e AS ({EIGEN} FROM m) SELECT round(sqrt(l1), 4) AS value_1, round(sqrt(l2), 4) AS value_2 FROM e")
def singular_pair(spark: SparkSession, sf: str) -> DataFrame:
    s = decomposition.truncated_svd(_pair(spark, sf), 2, 2)[1]
    return _row(spark, ("value_1", s[0], 4), ("value_2", s[1], 4))


@query(f"{TWO} SELECT round(abs(\"by\") / sqrt(bb * yy), 6) AS correlation, round(abs(\"by\"), 4) AS covariance FROM m")
def canonical_pair(spark: SparkSession, sf: str) -> DataFrame:
    v = ev(spark, sf).select(F.array("x2", "y").alias("v"))
    return _row(spark, ("correlation", decomposition.canonical_correlation(v, 1, 2, 1)[2][0], 6), ("covariance", decomposition.cross_svd(v, 1, 2, 1)[2][0], 4))


@query(f"{EV}, s AS (SELECT kind, avg(CASE WHEN z > 120 THEN 1.0 ELSE 0.0 END) AS p FROM ev GROUP BY kind) SELECT kind, round(p, 3) AS share FROM s")
def logistic_saturated(spark: SparkSession, sf: str) -> DataFrame:
    """With an indicator for every class the likeliest probabilities are the classes' own shares."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array

    e = ev(spark, sf).withColumns({"label": (C("z") > 120).cast("double"), "is_b": (C("kind") == "b").cast("double"), "is_c": (C("kind") == "c").cast("double")})
    out = models.fit_ml(LogisticRegression(maxIter=200, tol=1e-12, standardization=False), e, ["is_b", "is_c"])
    return out.groupBy("kind").agg(F.round(F.max(vector_to_array("probability")[1]), 3).alias("share"))


_PICKED = model_selection.parameter_sample(4, **VALUES)
_PICKED_SQL = ", ".join(f"({p['alpha']}, '{p['x']}')" for p in _PICKED)


@query(f"{SEARCH} SELECT alpha, x, round(mean_score, 6) AS mean_score, round(std_score, 6) AS std_score, CAST(rank() OVER (ORDER BY mean_score DESC) AS INT) AS rank FROM g WHERE (alpha, x) IN ({_PICKED_SQL})")
def randomized_search(spark: SparkSession, sf: str) -> DataFrame:
    return _searched(model_selection.search(_ridge, _PICKED, ev(spark, sf), "y"))

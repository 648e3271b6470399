"""The registered queries of steps, model selection and models of models, with DuckDB SQL in closed form."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compose, folds, meta, model_selection
from . import tables as t
from .registry import query, rounded

C = F.col
_EV = {
    "id": "event_id",
    "x1": "CAST(user_id AS DOUBLE)",
    "x2": "CAST(event_id % 97 AS DOUBLE)",
    "y": "value + 3 * user_id + 2 * (event_id % 97)",
    "z": "value + 10 * (event_id % 11)",
    "kind": "CASE WHEN event_id % 97 < 30 THEN 'a' WHEN event_id % 97 < 60 THEN 'b' ELSE 'c' END",
    "part": "event_type",
    "fold": "CAST(event_id % 3 AS INT)",
}
EV = "WITH ev AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _EV.items()) + " FROM events)"


def ev(spark: SparkSession, sf: str) -> DataFrame:
    return t.read(spark, sf, "events").selectExpr(*[f"{e} AS {n}" for n, e in _EV.items()])


def line(target: str, out: str, x: str = "x1", alpha: float = 0.0) -> compose.Step:
    return compose.linear([x], target, out, alpha)


# ---- steps


@query(f"{EV}, s AS (SELECT avg(x1) AS m1, stddev_pop(x1) AS s1, avg(x2) AS m2, stddev_pop(x2) AS s2 FROM ev WHERE fold <> 0) SELECT id, round((x1 - m1) / s1, 6) AS x1, round((x2 - m2) / s2, 6) AS x2 FROM ev, s WHERE fold = 0")
def step_standard(spark: SparkSession, sf: str) -> DataFrame:
    e = ev(spark, sf)
    return rounded(compose.standard(["x1", "x2"])(e.filter("fold <> 0"))(e.filter("fold = 0")).select("id", "x1", "x2"), "x1", "x2")


@query(f"{EV}, s AS (SELECT min(x1) AS a, max(x1) AS b, max(abs(x2)) AS m FROM ev WHERE fold <> 0) SELECT id, round((x1 - a) / (b - a) * 2 - 1, 6) AS x1, round(x2 / m, 6) AS x2 FROM ev, s WHERE fold = 0")
def step_between(spark: SparkSession, sf: str) -> DataFrame:
    e = ev(spark, sf)
    step = compose.pipeline(compose.between(["x1"], -1, 1), compose.by_largest(["x2"]))
    return rounded(step(e.filter("fold <> 0"))(e.filter("fold = 0")).select("id", "x1", "x2"), "x1", "x2")


@query(f"{EV}, s AS (SELECT avg(x1) AS m, stddev_pop(x1) AS s FROM ev WHERE fold <> 0), w AS (SELECT regr_slope(y, (x1 - m) / s) AS b, regr_intercept(y, (x1 - m) / s) AS a FROM ev, s WHERE fold <> 0) SELECT id, round(a + b * (x1 - m) / s, 4) AS prediction FROM ev, s, w WHERE fold = 0")
def pipeline_predict(spark: SparkSession, sf: str) -> DataFrame:
    e = ev(spark, sf)
    step = compose.pipeline(compose.standard(["x1"]), compose.linear(["x1"], "y"))
    return rounded(step(e.filter("fold <> 0"))(e.filter("fold = 0")).select("id", "prediction"), "prediction", digits=4)


@query(f"{EV}, s AS (SELECT avg(x1) AS m, stddev_pop(x1) AS s, min(x2) AS a, max(x2) AS b FROM ev) SELECT id, round((x1 - m) / s, 6) AS x1, round((x2 - a) / (b - a), 6) AS x2, CAST(kind = 'a' AS INT) AS \"kind=a\", CAST(kind = 'b' AS INT) AS \"kind=b\", CAST(kind = 'c' AS INT) AS \"kind=c\" FROM ev, s")
def column_transform(spark: SparkSession, sf: str) -> DataFrame:
    e = ev(spark, sf).select("id", "x1", "x2", "kind")
    step = compose.by_columns((["x1"], compose.standard(["x1"])), (["x2"], compose.between(["x2"])), (["kind"], compose.indicators("kind")), (["id"], compose.applied(lambda d: d)))
    return rounded(step(e)(e).drop("kind"), "x1", "x2")


@query(f"{EV}, s AS (SELECT avg(x1) AS m, stddev_pop(x1) AS s, max(abs(x1)) AS b FROM ev) SELECT id, x1, round((x1 - m) / s, 6) AS scaled_x1, round(x1 / b, 6) AS largest_x1, x1 * x1 AS powers_x1_2 FROM ev, s")
def feature_union(spark: SparkSession, sf: str) -> DataFrame:
    e = ev(spark, sf).select("id", "x1")
    step = compose.union(scaled=(["x1"], compose.standard(["x1"])), largest=(["x1"], compose.by_largest(["x1"])), powers=(["x1_2"], compose.powers(["x1"])))
    return rounded(step(e)(e), "scaled_x1", "largest_x1")


@query(f"{EV}, w AS (SELECT regr_slope(ln(y + 1), x1) AS b, regr_intercept(ln(y + 1), x1) AS a FROM ev) SELECT id, round(exp(a + b * x1) - 1, 4) AS prediction FROM ev, w")
def target_transform(spark: SparkSession, sf: str) -> DataFrame:
    e = ev(spark, sf)
    step = compose.transformed_target(lambda y: compose.linear(["x1"], y), "y", lambda c: F.ln(c + 1), lambda c: F.exp(c) - 1)
    return rounded(step(e)(e).select("id", "prediction"), "prediction", digits=4)


@query(f"{EV} SELECT id, ln(x1 + 1) AS x1, 1.0::DOUBLE AS one FROM ev")
def function_transform(spark: SparkSession, sf: str) -> DataFrame:
    e = ev(spark, sf).select("id", "x1")
    return compose.pipeline(compose.applied(lambda d: d.withColumn("x1", F.ln(C("x1") + 1))), compose.constant())(e)(e)


@query(f"{EV}, s AS (SELECT avg(y) AS mean, quantile_cont(y, 0.5) AS median, quantile_cont(y, 0.9) AS q FROM ev WHERE fold <> 0) SELECT id, round(mean, 4) AS mean, round(median, 4) AS median, round(q, 4) AS q FROM ev, s WHERE fold = 0")
def dummy_regression(spark: SparkSession, sf: str) -> DataFrame:
    e = ev(spark, sf)
    step = compose.pipeline(compose.constant_prediction("y", "mean", "mean"), compose.constant_prediction("y", "median", "median"), compose.constant_prediction("y", 0.9, "q"))
    return rounded(step(e.filter("fold <> 0"))(e.filter("fold = 0")).select("id", "mean", "median", "q"), "mean", "median", "q", digits=4)


# ---- model selection

#: Lines learned without a fold, and what they say of its rows.
HELD = f"{EV}, w AS (SELECT k, regr_slope(y, x1) AS b, regr_intercept(y, x1) AS a FROM ev, (SELECT unnest(range(3)) AS k) WHERE fold <> k GROUP BY k), held AS (SELECT ev.*, a + b * x1 AS p FROM ev JOIN w ON k = fold)"
R2 = "1 - sum(pow(y - p, 2)) / (var_pop(y) * count(*))"


@query(f"{HELD} SELECT id, round(p, 4) AS prediction FROM held")
def cross_val_predict(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(model_selection.cross_predict(line("y", "prediction"), ev(spark, sf)).select("id", "prediction"), "prediction", digits=4)


@query(f"{HELD}, own AS (SELECT k AS fold, y, a + b * x1 AS p FROM ev JOIN w ON k <> fold), tr AS (SELECT fold, {R2} AS r FROM own GROUP BY fold) SELECT fold, round({R2}, 6) AS r2, round(-avg(pow(y - p, 2)), 3) AS neg_mean_squared_error, round(r, 6) AS train_r2 FROM held JOIN tr USING (fold) GROUP BY fold, r")
def cross_validate(spark: SparkSession, sf: str) -> DataFrame:
    c = model_selection.cross_validate(line("y", "prediction"), ev(spark, sf), "y", ("r2", "neg_mean_squared_error"), train=True)
    return c.select("fold", F.round("r2", 6).alias("r2"), F.round("neg_mean_squared_error", 3).alias("neg_mean_squared_error"), F.round("train_r2", 6).alias("train_r2"))


@query(f"{HELD}, s AS (SELECT fold, {R2} AS r FROM held GROUP BY fold) SELECT round(avg(r), 6) AS mean_score, round(stddev_pop(r), 6) AS std_score FROM s")
def cross_val_score(spark: SparkSession, sf: str) -> DataFrame:
    c = model_selection.cross_validate(line("y", "prediction"), ev(spark, sf), "y", ("r2",))
    return c.agg(F.round(F.avg("r2"), 6).alias("mean_score"), F.round(F.stddev_pop("r2"), 6).alias("std_score"))


GRID = "[0.0, 1000.0, 100000.0, 10000000.0]"
SEARCH = f"""{EV}, m AS (SELECT k, x, alpha, avg(y) AS my, avg(v) AS mx, regr_sxy(y, v) AS sxy, regr_sxx(y, v) AS sxx FROM (SELECT *, x1 AS v, 'x1' AS x FROM ev UNION ALL SELECT *, x2, 'x2' FROM ev), (SELECT unnest(range(3)) AS k), (SELECT unnest({GRID}::DOUBLE[]) AS alpha) WHERE fold <> k GROUP BY k, x, alpha),
s AS (SELECT alpha, x, fold, 1 - sum(pow(y - (my + sxy / (sxx + alpha) * (CASE x WHEN 'x1' THEN x1 ELSE x2 END - mx)), 2)) / (var_pop(y) * count(*)) AS r FROM ev JOIN m ON k = fold GROUP BY alpha, x, fold),
g AS (SELECT alpha, x, avg(r) AS mean_score, stddev_pop(r) AS std_score FROM s GROUP BY alpha, x)"""
VALUES = {"alpha": [0.0, 1000.0, 100000.0, 10000000.0], "x": ["x1", "x2"]}


def _ridge(alpha: float, x: str = "x1") -> compose.Step:
    return compose.linear([x], "y", "prediction", alpha or 1e-300)


def _searched(found: DataFrame) -> DataFrame:
    got = found.select(F.get_json_object("params", "$.alpha").cast("double").alias("alpha"), F.get_json_object("params", "$.x").alias("x"), F.round("mean_score", 6).alias("mean_score"), F.round("std_score", 6).alias("std_score"), "rank")
    return got.withColumn("rank", C("rank").cast("int"))


@query(f"{SEARCH} SELECT alpha, x, round(mean_score, 6) AS mean_score, round(std_score, 6) AS std_score, CAST(rank() OVER (ORDER BY mean_score DESC) AS INT) AS rank FROM g")
def grid_search(spark: SparkSession, sf: str) -> DataFrame:
    return _searched(model_selection.search(_ridge, model_selection.parameter_grid(**VALUES), ev(spark, sf), "y"))


@query()
def halving_search(spark: SparkSession, sf: str) -> DataFrame:
    rounds = model_selection.halving_search(_ridge, model_selection.parameter_grid(**VALUES), ev(spark, sf), "y", "id")
    return spark.createDataFrame([(i, float(s), float(p["alpha"]), p["x"]) for i, (s, left) in enumerate(rounds) for p in left], "round int, share double, alpha double, x string")


def share_sql(key: str, seed: str = "0") -> str:
    return f"CAST('0x' || substr(md5({seed} || ':' || CAST({key} AS VARCHAR)), 1, 12) AS BIGINT) / 281474976710656.0"


@query(f"{EV}, w AS (SELECT k, s, regr_slope(y, x1) AS b, regr_intercept(y, x1) AS a FROM ev, (SELECT unnest(range(3)) AS k), (SELECT unnest([0.1, 0.5, 1.0]::DOUBLE[]) AS s) WHERE fold <> k AND {share_sql('id', chr(39) + '0' + chr(39))} < s GROUP BY k, s), held AS (SELECT fold, s AS share, y, a + b * x1 AS p FROM ev JOIN w ON k = fold) SELECT fold, share, round({R2}, 6) AS r2 FROM held GROUP BY fold, share")
def learning_curve(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(model_selection.learning_curve(line("y", "prediction"), ev(spark, sf), "y", "id", [0.1, 0.5, 1.0]).select("fold", "share", "r2"), "r2")


@query(f"{SEARCH}, o AS (SELECT alpha, k AS fold, 1 - sum(pow(y - (my + sxy / (sxx + alpha) * (x1 - mx)), 2)) / (var_pop(y) * count(*)) AS tr FROM ev JOIN m ON k <> fold WHERE x = 'x1' GROUP BY alpha, k) SELECT s.alpha AS value, s.fold, round(r, 6) AS r2, round(tr, 6) AS train_r2 FROM s JOIN o ON o.alpha = s.alpha AND o.fold = s.fold WHERE x = 'x1'")
def validation_curve(spark: SparkSession, sf: str) -> DataFrame:
    v = model_selection.validation_curve(_ridge, "alpha", VALUES["alpha"], ev(spark, sf), "y")
    return rounded(v.select("value", "fold", "r2", "train_r2"), "r2", "train_r2")


_BLOCKS = 8


def permuted_sql(column: str, seed: int) -> str:
    """Rows (id and the column's permuted value) by the digests of permuted()."""
    h = lambda s: f"md5('{seed}.{s}:' || CAST(id AS VARCHAR))"
    block = f"CAST('0x' || substr({h(0)}, 1, 8) AS BIGINT) % {_BLOCKS}"
    return f"(SELECT a.id, b.v AS {column} FROM (SELECT id, {block} AS k, row_number() OVER (PARTITION BY {block} ORDER BY {h(1)}, id) AS r FROM ev) a JOIN (SELECT {column} AS v, {block} AS k, row_number() OVER (PARTITION BY {block} ORDER BY {h(2)}, id) AS r FROM ev) b USING (k, r))"


@query(f"{EV}, t AS (SELECT 0 AS round, id, y FROM ev UNION ALL SELECT 1, * FROM {permuted_sql('y', 1)} UNION ALL SELECT 2, * FROM {permuted_sql('y', 2)}), d AS (SELECT round, t.y, x1, fold FROM t JOIN ev USING (id)), w AS (SELECT round, k, regr_slope(y, x1) AS b, regr_intercept(y, x1) AS a FROM d, (SELECT unnest(range(3)) AS k) WHERE fold <> k GROUP BY round, k), held AS (SELECT round, fold, y, a + b * x1 AS p FROM d JOIN w USING (round) WHERE k = fold), s AS (SELECT round, fold, {R2} AS r FROM held GROUP BY round, fold) SELECT CAST(round AS INT) AS round, round(avg(r), 6) AS r2 FROM s GROUP BY round")
def permutation_test(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(model_selection.permutation_scores(line("y", "prediction"), ev(spark, sf), "y", "id", rounds=2, blocks=_BLOCKS), "r2")


@query(f"{EV}, w AS (SELECT regr_slope(y, x1) AS b, regr_intercept(y, x1) AS a FROM ev), o AS (SELECT {R2} AS r FROM (SELECT y, a + b * x1 AS p FROM ev, w)), q AS (SELECT {R2} AS r FROM (SELECT y, a + b * s.x1 AS p FROM ev JOIN {permuted_sql('x1', 1)} s USING (id), w)) SELECT 'x1' AS \"column\", round(o.r - q.r, 6) AS drop FROM o, q UNION ALL SELECT 'x2', 0.0")
def permutation_importance(spark: SparkSession, sf: str) -> DataFrame:
    e = ev(spark, sf)
    return rounded(model_selection.permutation_importance(line("y", "prediction")(e), e, ["x1", "x2"], "y", "id", blocks=_BLOCKS), "drop")


# ---- models of models

LINES = f"{EV}, w AS (SELECT regr_slope(y, x1) AS b1, regr_intercept(y, x1) AS a1, regr_slope(y, x2) AS b2, regr_intercept(y, x2) AS a2 FROM ev)"


@query(f"{LINES} SELECT id, round((a1 + b1 * x1 + 3 * (a2 + b2 * x2)) / 4, 4) AS prediction FROM ev, w")
def voting_regression(spark: SparkSession, sf: str) -> DataFrame:
    e = ev(spark, sf)
    return rounded(meta.voting([partial(line, x="x1"), partial(line, x="x2")], "y", [1, 3])(e)(e).select("id", "prediction"), "prediction", digits=4)


@query(f"""{LINES}, v AS (SELECT k, regr_slope(y, x1) AS b1, regr_intercept(y, x1) AS a1, regr_slope(y, x2) AS b2, regr_intercept(y, x2) AS a2 FROM ev, (SELECT unnest(range(3)) AS k) WHERE fold <> k GROUP BY k),
h AS (SELECT y, a1 + b1 * x1 AS p, a2 + b2 * x2 AS q FROM ev JOIN v ON k = fold), m AS (SELECT avg(y) AS my, avg(p) AS mp, avg(q) AS mq, covar_pop(p, p) AS pp, covar_pop(q, q) AS qq, covar_pop(p, q) AS pq, covar_pop(p, y) AS py, covar_pop(q, y) AS qy FROM h),
c AS (SELECT *, (py * qq - qy * pq) / (pp * qq - pq * pq) AS cp, (qy * pp - py * pq) / (pp * qq - pq * pq) AS cq FROM m)
SELECT id, round(my + cp * (a1 + b1 * x1 - mp) + cq * (a2 + b2 * x2 - mq), 3) AS prediction FROM ev, w, c""")
def stacking_regression(spark: SparkSession, sf: str) -> DataFrame:
    e = ev(spark, sf)
    return rounded(meta.stacking([partial(line, x="x1"), partial(line, x="x2")], "y")(e)(e).select("id", "prediction"), "prediction", digits=3)


@query(f"{EV}, w AS (SELECT s, regr_slope(y, x1) AS b, regr_intercept(y, x1) AS a FROM ev, (SELECT unnest(range(5)) AS s) WHERE {share_sql('id', 'CAST(s AS VARCHAR)')} < 0.5 GROUP BY s) SELECT id, round(avg(a + b * x1), 4) AS prediction FROM ev, w GROUP BY id")
def bagging_regression(spark: SparkSession, sf: str) -> DataFrame:
    e = ev(spark, sf)
    return rounded(meta.bagging(line, "y", "id", n=5)(e)(e).select("id", "prediction"), "prediction", digits=4)


def _classes(step: compose.Step, spark: SparkSession, sf: str) -> DataFrame:
    e = ev(spark, sf)
    return step(e)(e).groupBy("kind", "predicted").agg(F.count("*").alias("n"))


_line2 = partial(line, x="x2")


@query(f"{EV}, w AS (SELECT k, regr_slope(CAST(kind = k AS INT), x2) AS b, regr_intercept(CAST(kind = k AS INT), x2) AS a FROM ev, (SELECT unnest(['a', 'b', 'c']) AS k) GROUP BY k), p AS (SELECT kind, k AS predicted FROM ev, w QUALIFY row_number() OVER (PARTITION BY id ORDER BY a + b * x2 DESC, k) = 1) SELECT kind, predicted, count(*) AS n FROM p GROUP BY ALL")
def one_vs_rest(spark: SparkSession, sf: str) -> DataFrame:
    return _classes(meta.one_against_rest(_line2, "kind"), spark, sf)


@query(f"{EV}, d AS (SELECT unnest([['a', 'b'], ['a', 'c'], ['b', 'c']]) AS d), w AS (SELECT d, regr_slope(CAST(kind = d[1] AS INT), x2) AS b, regr_intercept(CAST(kind = d[1] AS INT), x2) AS a FROM ev, d WHERE list_contains(d, kind) GROUP BY d), v AS (SELECT id, kind, CASE WHEN a + b * x2 > 0.5 THEN d[1] ELSE d[2] END AS won FROM ev, w), p AS (SELECT id, kind, won AS predicted FROM v GROUP BY id, kind, won QUALIFY row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, won) = 1) SELECT kind, predicted, count(*) AS n FROM p GROUP BY kind, predicted")
def one_vs_one(spark: SparkSession, sf: str) -> DataFrame:
    return _classes(meta.one_against_one(_line2, "kind"), spark, sf)


@query(f"{EV}, c(kind, word) AS (VALUES ('a', [0, 0, 1]), ('b', [0, 1, 0]), ('c', [1, 1, 1])), w AS (SELECT i, regr_slope(c.word[i], x2) AS b, regr_intercept(c.word[i], x2) AS a FROM ev JOIN c USING (kind), (SELECT unnest([1, 2, 3]) AS i) GROUP BY i), p AS (SELECT id, ev.kind, c.kind AS predicted FROM ev, c, w GROUP BY id, ev.kind, c.kind, x2 QUALIFY row_number() OVER (PARTITION BY id ORDER BY sum(pow(a + b * x2 - c.word[i], 2)), c.kind) = 1) SELECT kind, predicted, count(*) AS n FROM p GROUP BY ALL")
def output_code(spark: SparkSession, sf: str) -> DataFrame:
    return _classes(meta.output_code(_line2, "kind", {"a": [0, 0, 1], "b": [0, 1, 0], "c": [1, 1, 1]}), spark, sf)


@query(f"{EV}, w AS (SELECT regr_slope(y, x1) AS b1, regr_intercept(y, x1) AS a1, regr_slope(z, x1) AS b2, regr_intercept(z, x1) AS a2 FROM ev) SELECT id, round(a1 + b1 * x1, 4) AS predicted_y, round(a2 + b2 * x1, 4) AS predicted_z FROM ev, w")
def multi_output(spark: SparkSession, sf: str) -> DataFrame:
    e = ev(spark, sf)
    return rounded(meta.each_target(line, ["y", "z"])(e)(e).select("id", "predicted_y", "predicted_z"), "predicted_y", "predicted_z", digits=4)


@query(f"""{EV}, m AS (SELECT regr_slope(y, x1) AS b1, regr_intercept(y, x1) AS a1, avg(z) AS mz, avg(x1) AS mx, avg(y) AS my, covar_pop(x1, x1) AS xx, covar_pop(y, y) AS yy, covar_pop(x1, y) AS xy, covar_pop(x1, z) AS xz, covar_pop(y, z) AS yz FROM ev),
c AS (SELECT *, (xz * yy - yz * xy) / (xx * yy - xy * xy) AS cx, (yz * xx - xz * xy) / (xx * yy - xy * xy) AS cy FROM m)
SELECT id, round(a1 + b1 * x1, 4) AS predicted_y, round(mz + cx * (x1 - mx) + cy * (a1 + b1 * x1 - my), 3) AS predicted_z FROM ev, c""")
def regressor_chain(spark: SparkSession, sf: str) -> DataFrame:
    e = ev(spark, sf)
    out = meta.chain(lambda columns, target, made: compose.linear(columns, target, made), ["x1"], ["y", "z"])(e)(e)
    return out.select("id", F.round("predicted_y", 4).alias("predicted_y"), F.round("predicted_z", 3).alias("predicted_z"))

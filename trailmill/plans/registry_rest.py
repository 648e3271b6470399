"""The registered queries of neighbours, imputation, selection, further metrics, merge trees and generalised linear models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import classification, clustering_metrics, compose, gram, kernel_models, links, metric_registry, model_selection, models, neighbors, preprocessing, regression, robust, selection, sparse, text, tracks
from ..operators.storage import stored
from . import tables as t
from .registry import BASE, BOX, LOG, log, query, rounded
from .registry_ml import DSQ, LONG, ML, N, CUM, CON, _multilabel
from .registry_models import EV, SEARCH, ev, share_sql

C = F.col

# ---- neighbours

NEAR = f"{BASE}, d AS (SELECT a.id AS q, b.id, b.label, sqrt({DSQ}) AS d FROM vec a JOIN vec b ON a.id % 20 = 0 AND a.id <> b.id), n AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(d, 9), id) <= 5)"


def _near(spark: SparkSession, sf: str, **how: float) -> tuple[DataFrame, DataFrame]:
    v = t.vectors(spark, sf)
    q = v.filter("id % 20 = 0").select("id", "v")
    return neighbors.nearest(q, v.select("id", "v"), **(how or {"k": 5})), v


@query(f"{NEAR} SELECT q AS query_id, round(avg(label), 6) AS prediction FROM n GROUP BY q")
def knn_regress(spark: SparkSession, sf: str) -> DataFrame:
    n, v = _near(spark, sf)
    return rounded(neighbors.average(n, v.select("id", C("label").alias("value"))), "prediction")


@query(f"{NEAR} SELECT q AS query_id, round(sum(label / d) / sum(1 / d), 6) AS prediction FROM n GROUP BY q")
def knn_regress_weighted(spark: SparkSession, sf: str) -> DataFrame:
    n, v = _near(spark, sf)
    return rounded(neighbors.average(n, v.select("id", C("label").alias("value")), "distance"), "prediction")


@query(f"{NEAR}, r AS (SELECT max(d) AS r FROM (SELECT q, min(d) AS d FROM d GROUP BY q)) SELECT q AS query_id, round(avg(label), 6) AS prediction FROM d WHERE d <= 1.2 GROUP BY q")
def radius_regress(spark: SparkSession, sf: str) -> DataFrame:
    n, v = _near(spark, sf, radius=1.2)
    return rounded(neighbors.average(n, v.select("id", C("label").alias("value"))), "prediction")


@query(f"{NEAR}, c AS (SELECT q, label, count(*) AS n FROM d WHERE d <= 1.2 GROUP BY q, label) SELECT q AS query_id, arg_min(label, {{'n': -n, 'l': label}}) AS label FROM c GROUP BY q")
def radius_classify(spark: SparkSession, sf: str) -> DataFrame:
    n, v = _near(spark, sf, radius=1.2)
    return neighbors.vote(n, v.select("id", "label"))


@query(f"{NEAR} SELECT q AS query_id, arg_min(id, {{'d': round(d, 9), 'i': id}}) AS id, round(min(d), 6) AS distance FROM d GROUP BY q")
def distance_argmin(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_near(spark, sf, k=1)[0].select("query_id", "id", "distance"), "distance")


@query(f"{BASE}, d AS (SELECT a.id, len(a.v) AS dim, -{DSQ} / (2 * 0.25) AS e FROM vec a JOIN vec b ON a.id % 20 = 0), m AS (SELECT id, dim, max(e) AS top FROM d GROUP BY ALL) SELECT id, round(top + ln(sum(exp(e - top)) / count(*)) - m.dim * ln(0.5) - m.dim / 2.0 * ln(2 * pi()), 5) AS log_density FROM d JOIN m USING (id) GROUP BY id, top, m.dim")
def kernel_density(spark: SparkSession, sf: str) -> DataFrame:
    v = t.vectors(spark, sf).select("id", "v")
    return rounded(neighbors.density(v.filter("id % 20 = 0"), v, len(v.head()["v"]), 0.5), "log_density", digits=5)


HOLES = "list_transform(list_zip({v}, range(len({v}))), lambda z: CASE WHEN ({i} + z[2]) % 29 = 0 THEN NULL ELSE z[1] END)"


@query(f"{BASE}, h AS (SELECT id, {HOLES.format(v='v', i='id')} AS v FROM vec), p AS (SELECT a.id, b.id AS other, a.v, b.v AS w, list_filter(list_transform(list_zip(a.v, b.v), lambda z: pow(z[1] - z[2], 2)), lambda x: x IS NOT NULL) AS d FROM h a JOIN h b ON a.id % 20 = 0 AND a.id <> b.id), f AS (SELECT id, other, round(sqrt(list_sum(d) * len(v) / len(d)), 9) AS d, unnest(range(len(v))) AS i, unnest(v) AS x, unnest(w) AS y FROM p), n AS (SELECT * FROM f WHERE x IS NULL AND y IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id, i ORDER BY d, other) <= 5) SELECT id, CAST(i AS INT) AS i, round(avg(y), 6) AS x FROM n GROUP BY id, i")
def knn_impute(spark: SparkSession, sf: str) -> DataFrame:
    v = t.vectors(spark, sf).select("id", F.transform("v", lambda x, i: F.when((C("id") + i) % 29 != 0, x)).alias("v"))
    return rounded(neighbors.impute_nearest(v.filter("id % 20 = 0"), v), "x")


@query(f"{EV}, h AS (SELECT id, x2, CASE WHEN id % 7 <> 0 THEN y END AS y FROM ev), w AS (SELECT regr_slope(y, x2) AS b, regr_intercept(y, x2) AS a FROM h) SELECT id, x2, round(coalesce(y, a + b * x2), 4) AS y FROM h, w")
def iterative_impute(spark: SparkSession, sf: str) -> DataFrame:
    e = ev(spark, sf).select("id", "x2", F.when(C("id") % 7 != 0, C("y")).alias("y"))
    return rounded(preprocessing.impute_iterative(e, ["x2", "y"], rounds=2), "y", digits=4)


# ---- metrics


@query(f"{CUM} SELECT score, round(fps / neg, 6) AS fpr, round(1 - tps / pos, 6) AS fnr FROM cum, tot")
def det_curve(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(classification.error_points(t.clf(spark, sf)), "fpr", "fnr")


@query(f"{ML} SELECT cls, count_if(y = 0 AND p = 0) AS tn, count_if(y = 0 AND p = 1) AS fp, count_if(y = 1 AND p = 0) AS fn, count_if(y = 1 AND p = 1) AS tp FROM s GROUP BY cls")
def multilabel_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return classification.class_confusions(_multilabel(spark, sf))


@query(f"{ML} SELECT a.cls, round(avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END), 6) AS roc_auc FROM s a JOIN s b ON a.cls = b.cls AND a.y = 1 AND b.y = 0 GROUP BY a.cls")
def roc_auc_by_class(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(classification.areas_by_class(_multilabel(spark, sf)).filter("roc_auc is not null"), "roc_auc")


@query(f"{BASE} SELECT round(count_if(y <> p) / count(*), 6) AS zero_one_loss, round(count_if(y <> p) / 1.0, 1) AS errors FROM clf")
def zero_one_loss(spark: SparkSession, sf: str) -> DataFrame:
    wrong = (C("y") != C("p")).cast("double")
    return t.clf(spark, sf).agg(F.round(F.avg(wrong), 6).alias("zero_one_loss"), F.round(F.sum(wrong), 1).alias("errors"))


@query(f"{BASE}, d AS (SELECT a.id, a.label AS la, b.label AS lb, sum({DSQ}) AS s, count(*) AS n FROM vec a JOIN vec b ON true GROUP BY ALL), m AS (SELECT id, la, max(CASE WHEN la = lb THEN s / greatest(n - 1, 1) END) AS a, max(CASE WHEN la = lb THEN n END) AS n, min(CASE WHEN la <> lb THEN s / n END) AS b FROM d GROUP BY id, la) SELECT id, round(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS silhouette FROM m")
def silhouette_samples(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(clustering_metrics.silhouette_samples(t.vectors(spark, sf)), "silhouette")


@query(f"{CON}, k AS (SELECT (SELECT sum(n * n) FROM con) AS s, (SELECT sum(m * m) FROM ra) AS a, (SELECT sum(m * m) FROM rb) AS b, t FROM tot) SELECT t * t - a - b + s AS apart, b - s AS only_b, a - s AS only_a, s - t AS together FROM k")
def pair_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return clustering_metrics.pair_confusion(t.clf(spark, sf), "lang", "source")


@query(f"""{CON}, c AS (SELECT ra.m AS a, rb.m AS b, t, unnest(range(CAST(greatest(1, ra.m + rb.m - t) AS BIGINT), CAST(least(ra.m, rb.m) AS BIGINT) + 1)) AS k FROM ra, rb, tot),
e AS (SELECT sum(k / t * ln(t * k / (a * b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(t - a + 1) + lgamma(t - b + 1) - lgamma(t + 1) - lgamma(k + 1) - lgamma(a - k + 1) - lgamma(b - k + 1) - lgamma(t - a - b + k + 1))) AS e FROM c),
mi AS (SELECT sum(n / t * ln(n * t / (ra.m * rb.m))) AS mi FROM con JOIN ra USING (lang) JOIN rb USING (source), tot), ha AS (SELECT -sum(m / t * ln(m / t)) AS ha FROM ra, tot), hb AS (SELECT -sum(m / t * ln(m / t)) AS hb FROM rb, tot) SELECT round((mi - e) / ((ha + hb) / 2 - e), 6) AS adjusted_mutual_information FROM mi, ha, hb, e""")
def adjusted_information(spark: SparkSession, sf: str) -> DataFrame:
    x = clustering_metrics.adjusted_information(t.clf(spark, sf), "lang", "source")
    return rounded(spark.createDataFrame([(x,)], "adjusted_mutual_information double"), "adjusted_mutual_information")


@query(f"{BASE}, e AS (SELECT label, unnest(v) AS x, unnest(range(len(v))) AS i FROM vec), c AS (SELECT label, i, avg(x) AS m, count(*) AS n FROM e GROUP BY label, i) SELECT a.label AS a, b.label AS b, round(max(a.n * b.n / (a.n + b.n)) * sum(pow(a.m - b.m, 2)), 6) AS distance FROM c a JOIN c b ON a.i = b.i AND a.label < b.label GROUP BY a.label, b.label")
def ward_distance(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(clustering_metrics.ward_distances(t.vectors(spark, sf)), "distance")


@query(f"{BASE} SELECT round(avg(2 * (pow(y, 0.5) / (-0.5 * 0.5) + y * pow(p, -0.5) / 0.5 + pow(p, 0.5) / 0.5)), 3) AS tweedie FROM reg")
def tweedie_deviance(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(regression.tweedie(t.reg(spark, sf), 1.5), "tweedie", digits=3)


@query(f"{EV}, r AS (SELECT rank() OVER (ORDER BY x2) + (count(*) OVER (PARTITION BY x2) - 1) / 2.0 AS a, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS b FROM ev) SELECT round(corr(a, b), 6) AS rho FROM r")
def check_increasing(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(regression.rank_correlation(ev(spark, sf), "x2", "y"), "rho")


@query(f"{EV}, g AS (SELECT x2, avg(y) AS m, CAST(count(*) AS DOUBLE) AS n FROM ev GROUP BY x2), s AS (SELECT a.x2 AS lo, b.x2 AS hi, sum(c.m * c.n) / sum(c.n) AS v FROM g a JOIN g b ON a.x2 <= b.x2 JOIN g c ON c.x2 BETWEEN a.x2 AND b.x2 GROUP BY a.x2, b.x2), l AS (SELECT g.x2, s.lo, min(s.v) AS v FROM g JOIN s ON s.lo <= g.x2 AND s.hi >= g.x2 GROUP BY g.x2, s.lo) SELECT x2, round(max(v), 4) AS fitted FROM l GROUP BY x2")
def isotonic_regression(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(regression.isotonic(ev(spark, sf), "x2", "y"), "fitted", digits=4)


# ---- preprocessing and selection


@query("WITH u AS (SELECT user_id, list(DISTINCT event_type) AS a FROM events GROUP BY user_id) SELECT user_id, CAST(list_contains(a, 'click') AS INT) AS \"kinds=click\", CAST(list_contains(a, 'view') AS INT) AS \"kinds=view\", CAST(list_contains(a, 'nothing') AS INT) AS \"kinds=nothing\" FROM u")
def label_sets(spark: SparkSession, sf: str) -> DataFrame:
    u = t.read(spark, sf, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("kinds"))
    return preprocessing.label_sets(u, "kinds", ["click", "view", "nothing"]).drop("kinds")


F_SQL = f"{LONG}, p AS (SELECT feature, y, count(*) AS n, avg(x) AS m, var_pop(x) * count(*) AS w FROM u GROUP BY feature, y), g AS (SELECT feature, avg(x) AS g FROM u GROUP BY feature), f AS (SELECT feature, sum(n * pow(m - g, 2)) * (sum(n) - count(*)) / (sum(w) * (count(*) - 1)) AS f FROM p JOIN g USING (feature) GROUP BY feature)"


@query(f"{F_SQL} SELECT feature, round(f, 6) AS f FROM f ORDER BY f DESC, feature LIMIT 2")
def select_k_best(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(selection.selected(selection.anova_f(t.reg(spark, sf), "l_returnflag", N), "f", k=2), "f")


@query(f"{F_SQL} SELECT feature, round(f, 6) AS f FROM f ORDER BY f DESC, feature LIMIT 1")
def select_percentile(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(selection.selected(selection.anova_f(t.reg(spark, sf), "l_returnflag", N), "f", percentile=50), "f")


@query(f"{F_SQL} SELECT feature, round(f, 6) AS f FROM f WHERE f >= (SELECT avg(f) FROM f)")
def select_from_scores(spark: SparkSession, sf: str) -> DataFrame:
    s = selection.anova_f(t.reg(spark, sf), "l_returnflag", N)
    return rounded(selection.selected(s, "f", at_least=s.agg(F.avg("f")).head()[0]), "f")


@query()
def select_significant(spark: SparkSession, sf: str) -> DataFrame:
    r = selection.regression_f(t.reg(spark, sf), "l_extendedprice", N).collect()
    n = t.reg(spark, sf).count()
    p = {x["feature"]: selection.f_tail(x["f"], 1, n - 2) for x in r}
    return spark.createDataFrame([(f, p[f], *[f in selection.significant(p, 0.05, c) for c in ("fpr", "fdr", "fwe")]) for f in p], "feature string, p double, fpr boolean, fdr boolean, fwe boolean")


# ---- events, trees, tracks


@query(f"{LOG}, s AS (SELECT seq, count_if(type = 'MATCH') AS m, count_if(type = 'FP') AS fp, count_if(type = 'MISS') AS fn, count(oid) AS o, sum(d) AS d FROM log GROUP BY seq), a AS (SELECT * FROM s UNION ALL SELECT 'OVERALL', sum(m), sum(fp), sum(fn), sum(o), sum(d) FROM s) SELECT seq, round(1 - (fn + fp) / o, 6) AS mota, round(d / m, 6) AS motp, round(fp / m, 6) AS false_share FROM a")
def metric_registry_compute(spark: SparkSession, sf: str) -> DataFrame:
    m = metric_registry.standard()
    m.register("false_share", lambda f, d: f / d, needs=("num_false_positives", "num_detections"), help="false positives a detection")
    return rounded(m.compute(log(spark, sf), ["mota", "motp", "false_share"]), "mota", "motp", "false_share")


@query("SELECT 1000000 + max(event_id) OVER (PARTITION BY event_id // 10) AS head, unnest(CASE WHEN event_id % 10 = 0 THEN [event_id, event_id + 500000] ELSE [event_id + 500000] END) AS leaf FROM events")
def merge_tree_leaves(spark: SparkSession, sf: str) -> DataFrame:
    # nodes are numbered by kind (0: merge, 1: first leaf, 2: own leaf), so that the numbers asked for, which overlap from 500,000 events on, are only names
    e, at = t.read(spark, sf, "events"), C("event_id") * 3
    m = e.select(at.alias("node"), F.when(C("event_id") % 10 == 0, at + 1).otherwise(at - 3).alias("left"), (at + 2).alias("right"))
    name = lambda c: F.floor(c / 3).cast("long") + F.when(c % 3 == 0, 1000000).when(c % 3 == 2, 500000).otherwise(0)
    return links.tree_leaves(m).select(name(C("head")).alias("head"), name(C("leaf")).alias("leaf"))


@query("SELECT event_id AS i, user_id AS j, 1.0::DOUBLE AS x FROM events")
def link_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return sparse.closeness(t.read(spark, sf, "events").select(C("event_id").alias("a"), C("user_id").alias("b")), 1 << 40)


@query()
def track_gap_fill_curve(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(tracks.fill_curve(t.tracks(spark, sf), max_gap=50), *BOX)


# ---- pyspark.ml's own models, as steps


def _fitted(spark: SparkSession, sf: str, estimator, label) -> DataFrame:  # noqa: ANN001
    e = ev(spark, sf).withColumn("label", label)
    return models.fit_ml(estimator, e, ["x1", "x2"]).select("id", F.col("prediction").cast("double").alias("prediction"))


def _classes() -> F.Column:
    return F.when(C("kind") == "a", 0.0).when(C("kind") == "b", 1.0).otherwise(2.0)


@query(f"{EV} SELECT id, CASE kind WHEN 'a' THEN 0.0 WHEN 'b' THEN 1.0 ELSE 2.0 END::DOUBLE AS prediction FROM ev")
def tree_classification(spark: SparkSession, sf: str) -> DataFrame:
    """Classes are ranges of one column, so a tree of two levels, and what is grown of such trees, must tell them apart without error."""
    from pyspark.ml.classification import DecisionTreeClassifier

    return _fitted(spark, sf, DecisionTreeClassifier(maxDepth=4, maxBins=128), _classes())


@query(f"{EV} SELECT id, CASE kind WHEN 'a' THEN 0.0 WHEN 'b' THEN 1.0 ELSE 2.0 END::DOUBLE AS prediction FROM ev")
def forest_classification(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.ml.classification import RandomForestClassifier

    return _fitted(spark, sf, RandomForestClassifier(numTrees=20, maxDepth=6, maxBins=128, featureSubsetStrategy="all", seed=5), _classes())


@query(f"{EV} SELECT id, CASE WHEN kind = 'a' THEN 0.0 ELSE 1.0 END::DOUBLE AS prediction FROM ev")
def boosted_classification(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.ml.classification import GBTClassifier

    return _fitted(spark, sf, GBTClassifier(maxIter=5, maxDepth=3, maxBins=128, seed=5), (C("kind") != "a").cast("double"))


@query()
def boosted_regression(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.ml.regression import GBTRegressor

    return _fitted(spark, sf, GBTRegressor(maxIter=10, maxDepth=3, maxBins=128, seed=5), C("y"))


@query()
def forest_regression(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.ml.regression import RandomForestRegressor

    return _fitted(spark, sf, RandomForestRegressor(numTrees=10, maxDepth=5, maxBins=128, seed=5), C("y"))


def _glm(spark: SparkSession, sf: str, **how) -> DataFrame:  # noqa: ANN003
    """Means by class of a generalised linear model on class indicators are the classes' own means, whatever the law and link."""
    from pyspark.ml.regression import GeneralizedLinearRegression

    e = ev(spark, sf).withColumns({"label": C("y") + 1, "is_b": (C("kind") == "b").cast("double"), "is_c": (C("kind") == "c").cast("double")})
    out = models.fit_ml(GeneralizedLinearRegression(maxIter=100, tol=1e-12, **how), e, ["is_b", "is_c"])
    return out.groupBy("kind").agg(F.round(F.max("prediction"), 3).alias("mean"))


@query(f"{EV} SELECT kind, round(avg(y + 1), 3) AS mean FROM ev GROUP BY kind")
def poisson_regression(spark: SparkSession, sf: str) -> DataFrame:
    return _glm(spark, sf, family="poisson", link="log")


@query(f"{EV} SELECT kind, round(avg(y + 1), 3) AS mean FROM ev GROUP BY kind")
def gamma_regression(spark: SparkSession, sf: str) -> DataFrame:
    return _glm(spark, sf, family="gamma", link="log")


@query(f"{EV} SELECT kind, round(avg(y + 1), 3) AS mean FROM ev GROUP BY kind")
def tweedie_regression(spark: SparkSession, sf: str) -> DataFrame:
    return _glm(spark, sf, family="tweedie", variancePower=1.5, linkPower=0.0)


@query()
def perceptron_layers(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    return _fitted(spark, sf, MultilayerPerceptronClassifier(layers=[2, 8, 3], maxIter=50, seed=5), _classes())


@query()
def support_vectors_linear(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.ml.classification import LinearSVC

    return _fitted(spark, sf, LinearSVC(maxIter=30), (C("kind") == "a").cast("double"))


@query()
def mixture_of_normals(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.ml.clustering import GaussianMixture

    return _fitted(spark, sf, GaussianMixture(k=3, seed=5, maxIter=20), F.lit(0.0))


# ---- lines, selection forward, moments, edits, kernels


PAIRED = "p AS (SELECT k, floor((r - 1) / 2) AS pair, arg_min(x, r) AS x1, arg_min(y, r) AS y1, arg_max(x, r) AS x2, arg_max(y, r) AS y2 FROM (SELECT x2 AS x, y, floor({one} * 64) AS k, row_number() OVER (PARTITION BY floor({one} * 64) ORDER BY {zero}, id) AS r FROM ev) GROUP BY k, pair), l AS (SELECT k, pair, (y2 - y1) / (x2 - x1) AS slope, y1 - (y2 - y1) / (x2 - x1) * x1 AS intercept FROM p WHERE x1 <> x2)".format(one=share_sql("id", "'1'"), zero=share_sql("id", "'0'"))


@query(f"{EV}, {PAIRED}, s AS (SELECT quantile_disc(slope, 0.5) AS slope FROM l) SELECT round(slope, 5) AS slope, round(quantile_disc(y - slope * x2, 0.5), 4) AS intercept FROM ev, s GROUP BY slope")
def median_line(spark: SparkSession, sf: str) -> DataFrame:
    m = robust.median_line(ev(spark, sf), "x2", "y", "id")
    return m.select(F.round("slope", 5).alias("slope"), F.round("intercept", 4).alias("intercept"))


@query(f"{EV}, {PAIRED}, c AS (SELECT * FROM l WHERE pair = 0 ORDER BY k LIMIT 20), n AS (SELECT k, c.slope, c.intercept, count_if(abs(y - c.slope * x2 - c.intercept) <= 30) AS n, sum(CASE WHEN abs(y - c.slope * x2 - c.intercept) <= 30 THEN pow(y - c.slope * x2 - c.intercept, 2) END) AS s FROM ev, c GROUP BY ALL), b AS (SELECT * FROM n ORDER BY n DESC, s, k LIMIT 1) SELECT round(regr_slope(y, x2), 6) AS slope, round(regr_intercept(y, x2), 5) AS intercept, count(*) AS n FROM ev, b WHERE abs(y - b.slope * x2 - b.intercept) <= 30")
def consensus_line(spark: SparkSession, sf: str) -> DataFrame:
    c = robust.consensus_line(ev(spark, sf), "x2", "y", "id", within=30.0, tries=20)
    return c.select(F.round("slope", 6).alias("slope"), F.round("intercept", 5).alias("intercept"), "n")


@query(f"{EV}, w AS (SELECT regr_slope(CASE WHEN kind = 'a' THEN 1 ELSE -1 END, x2) AS b, regr_intercept(CASE WHEN kind = 'a' THEN 1 ELSE -1 END, x2) AS a FROM ev) SELECT kind, CASE WHEN a + b * x2 > 0 THEN 'a' ELSE 'other' END AS predicted, count(*) AS n FROM ev, w GROUP BY ALL")
def ridge_classifier(spark: SparkSession, sf: str) -> DataFrame:
    e = ev(spark, sf).withColumn("side", F.when(C("kind") == "a", 1.0).otherwise(-1.0))
    out = compose.linear(["x2"], "side")(e)(e).withColumn("predicted", F.when(C("prediction") > 0, "a").otherwise("other"))
    return out.groupBy("kind", "predicted").agg(F.count("*").alias("n"))


@query(f"{SEARCH} SELECT x AS \"column\", round(mean_score, 6) AS score FROM g WHERE alpha = 0 ORDER BY mean_score DESC LIMIT 1")
def forward_selection(spark: SparkSession, sf: str) -> DataFrame:
    chosen = model_selection.forward_selection(lambda c: compose.linear(c, "y"), ["x1", "x2"], 1, ev(spark, sf), "y")
    return rounded(spark.createDataFrame([(c, float(s)) for c, s in chosen], "column string, score double"), "score")


@query(f"{EV} SELECT count(*) AS n, round(avg(x1), 6) AS mean, round(regr_sxy(y, x1) / count(*), 4) AS covariance, round(var_pop(y), 3) AS variance FROM ev")
def incremental_moments(spark: SparkSession, sf: str) -> DataFrame:
    e = ev(spark, sf)
    parts = [gram.moments(e.filter(C("fold") == k), ["x1"], "y") for k in range(3)]
    m = gram.merged(gram.merged(parts[0], parts[1]), parts[2])
    return spark.createDataFrame([(m.n, round(float(m.mean[0]), 6), round(float(m.xy[0] / m.n), 4), round(m.yy / m.n, 3))], "n long, mean double, covariance double, variance double")


@query(f"{BASE}, o AS (SELECT a.id AS q, b.id, row_number() OVER (PARTITION BY a.id ORDER BY round(sqrt({DSQ}), 9), b.id) AS r FROM vec a JOIN vec b ON a.id <> b.id), e AS (SELECT a.id AS q, b.id FROM vec a JOIN vec b ON a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY round(sqrt(pow(a.v[1] - b.v[1], 2) + pow(a.v[2] - b.v[2], 2)), 9), b.id) <= 5) SELECT round(1 - 2.0 / ((SELECT count(DISTINCT q) FROM o) * 5 * (2 * (SELECT count(*) FROM vec) - 16)) * sum(greatest(r - 5, 0)), 6) AS trustworthiness FROM e JOIN o USING (q, id)")
def trustworthiness(spark: SparkSession, sf: str) -> DataFrame:
    v = t.vectors(spark, sf).select("id", "v")
    n = v.count()
    flat = v.select("id", F.slice("v", 1, 2).alias("v"))
    near = stored(neighbors.nearest(flat, flat, k=5).select("query_id", "id"), "near")
    return rounded(model_selection.trustworthiness(neighbors.ranks(v, v, near), near, n, 5), "trustworthiness")


@query(f"{NEAR.replace('a.id % 20 = 0 AND ', '')} SELECT round(avg(m), 6) AS bandwidth FROM (SELECT q, max(d) AS m FROM n GROUP BY q)")
def estimate_bandwidth(spark: SparkSession, sf: str) -> DataFrame:
    v = t.vectors(spark, sf).select("id", "v")
    return neighbors.nearest(v, v, k=5).groupBy("query_id").agg(F.max("distance").alias("m")).agg(F.round(F.avg("m"), 6).alias("bandwidth"))


@query("SELECT event_id, 'kind=' || event_type AS feature, 1.0::DOUBLE AS x FROM events UNION ALL SELECT event_id, 'user', CAST(user_id AS DOUBLE) FROM events WHERE user_id <> 0")
def dict_vectorize(spark: SparkSession, sf: str) -> DataFrame:
    e = t.read(spark, sf, "events").select("event_id", F.create_map(F.lit("kind"), C("event_type"), F.lit("user"), C("user_id").cast("string")).alias("m"))
    return text.vectorized(e, "event_id", "m")


@query(f"{BASE} SELECT seq, track_id, frame, id, CASE WHEN id % 5 = 1 THEN 1.0 ELSE x END AS x, CASE WHEN id % 5 = 1 THEN 2.0 ELSE y END AS y, CASE WHEN id % 5 = 1 THEN w + 1 ELSE w END AS w, h FROM track WHERE id % 7 <> 0")
def edit_boxes(spark: SparkSession, sf: str) -> DataFrame:
    d = t.tracks(spark, sf).select("seq", "track_id", "frame", "id", *BOX)
    edits = d.filter("id % 5 = 1").select("seq", "frame", "id", F.lit(1.0).alias("x"), F.lit(2.0).alias("y"), (C("w") + 1).alias("w"), "h")
    return tracks.delete_boxes(tracks.replace_boxes(d, edits), d.filter("id % 7 = 0")).select("seq", "track_id", "frame", "id", *BOX)


@query(f"{BASE} SELECT DISTINCT seq, track_id FROM track WHERE class_id IN (1, 2)")
def sequences_having_class(spark: SparkSession, sf: str) -> DataFrame:
    return tracks.having_class(t.tracks(spark, sf), [1, 2], ["seq", "track_id"])


def _landmarked(spark: SparkSession, sf: str):  # noqa: ANN202
    v = t.vectors(spark, sf).withColumn("y", C("label").cast("double"))
    return v, kernel_models.landmarks(v, 100)


@query()
def kernel_ridge(spark: SparkSession, sf: str) -> DataFrame:
    v, z = _landmarked(spark, sf)
    return v.select("id", kernel_models.kernel_ridge(v, z, gamma=0.5, alpha=0.1).predict(C("v")).alias("prediction"))


@query()
def gaussian_process(spark: SparkSession, sf: str) -> DataFrame:
    v, z = _landmarked(spark, sf)
    m = kernel_models.gaussian_process(v, z, gamma=0.5, noise=0.1)
    return v.select("id", m.predict(C("v")).alias("mean"), m.variance(C("v")).alias("variance"))


@query()
def kernel_components(spark: SparkSession, sf: str) -> DataFrame:
    v, z = _landmarked(spark, sf)
    return v.select("id", kernel_models.kernel_components(v, z, 3, gamma=0.5)[1].alias("components"))

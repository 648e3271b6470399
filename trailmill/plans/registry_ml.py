"""The registered statistics and learning queries, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lists
from ..operators import classification, clustering, clustering_metrics, decomposition, folds, gram, mapping, models, more_models, multilabel, neighbors, preprocessing, regression, selection, text
from . import tables as t
from .registry import BASE, query, rounded

C = F.col
DSQ = "list_sum(list_transform(list_zip(a.v, b.v), lambda z: pow(z[1] - z[2], 2)))"

# ---- classification

PER = "per AS (SELECT cls, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM (SELECT y AS cls, CASE WHEN y = p THEN 1 ELSE 0 END AS tp, 0 AS fp, CASE WHEN y <> p THEN 1 ELSE 0 END AS fn FROM clf UNION ALL SELECT p, 0, CASE WHEN y <> p THEN 1 ELSE 0 END, 0 FROM clf) GROUP BY cls)"


@query(f"{BASE} SELECT y, p, count(*) AS n FROM clf GROUP BY y, p")
def clf_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return classification.confusion(t.clf(spark, sf))


@query(f"{BASE}, {PER} SELECT cls, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tp + fn AS BIGINT) AS support, round(coalesce(tp / NULLIF(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / NULLIF(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / NULLIF(2 * tp + fn + fp, 0), 0), 6) AS f, round(coalesce(tp / NULLIF(tp + fn + fp, 0), 0), 6) AS jaccard FROM per")
def clf_prf_per_class(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(classification.per_class(t.clf(spark, sf)), "precision", "recall", "f", "jaccard")


@query(f"{BASE}, {PER}, m AS (SELECT tp, fn, tp / NULLIF(tp + fp, 0) AS pr, tp / NULLIF(tp + fn, 0) AS re FROM per) SELECT round((SELECT count(*) FILTER (y = p) / count(*) FROM clf), 6) AS accuracy, round(avg(re), 6) AS balanced_accuracy, round(avg(coalesce(pr, 0)), 6) AS macro_precision FROM m")
def clf_accuracy_balanced(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(classification.averages(t.clf(spark, sf)).select("accuracy", "balanced_accuracy", "macro_precision"), "accuracy", "balanced_accuracy", "macro_precision")


@query(f"""{BASE}, c AS (SELECT CAST(count(*) FILTER (y = 1 AND p = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (y = 0 AND p = 0) AS DOUBLE) AS tn, CAST(count(*) FILTER (y = 0 AND p = 1) AS DOUBLE) AS fp, CAST(count(*) FILTER (y = 1 AND p = 0) AS DOUBLE) AS fn FROM clf),
k AS (SELECT *, tp + tn + fp + fn AS n, ((tp + fn) * (tp + fp) + (tn + fp) * (tn + fn)) / pow(tp + tn + fp + fn, 2) AS e FROM c)
SELECT round(((tp + tn) / n - e) / (1 - e), 6) AS kappa, round(coalesce((tp * tn - fp * fn) / NULLIF(sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn), 0), 0), 6) AS mcc, round((fp + fn) / n, 6) AS hamming FROM k""")
def clf_kappa_mcc(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(classification.agreement(t.clf(spark, sf)), "kappa", "mcc", "hamming")


S = "least(greatest(score, 1e-15), 1 - 1e-15)"


@query(f"{BASE} SELECT round(avg(-CASE WHEN y = 1 THEN ln({S}) ELSE ln(1 - {S}) END), 6) AS log_loss, round(avg(pow(score - y, 2)), 6) AS brier FROM clf")
def clf_log_loss_brier(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(classification.probability_losses(t.clf(spark, sf)), "log_loss", "brier")


@query(f"{BASE} SELECT round(avg(greatest(0, 1 - score * CASE WHEN y = 1 THEN 1 ELSE -1 END)), 6) AS hinge FROM clf")
def clf_hinge(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(classification.hinge(t.clf(spark, sf)), "hinge")


CUM = f"{BASE}, g AS (SELECT score, count(*) FILTER (y = 1) AS t, count(*) FILTER (y <> 1) AS f FROM clf GROUP BY score), cum AS (SELECT score, t, f, sum(t) OVER o AS tps, sum(f) OVER o AS fps FROM g WINDOW o AS (ORDER BY score DESC)), tot AS (SELECT sum(t) AS pos, sum(f) AS neg FROM g)"


@query(f"{CUM} SELECT score, round(fps / neg, 6) AS fpr, round(tps / pos, 6) AS tpr FROM cum, tot")
def clf_roc_points(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(classification.roc_points(t.clf(spark, sf)), "fpr", "tpr")


@query(f"{CUM} SELECT score, round(tps / (tps + fps), 6) AS precision, round(tps / pos, 6) AS recall FROM cum, tot")
def clf_pr_points(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(classification.precision_recall_points(t.clf(spark, sf)), "precision", "recall")


@query(f"{BASE}, pairs AS (SELECT CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END AS win FROM clf a JOIN clf b ON a.y = 1 AND b.y = 0) SELECT round(avg(win), 6) AS roc_auc FROM pairs")
def clf_roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(classification.ranking_areas(t.clf(spark, sf)).select("roc_auc"), "roc_auc")


@query(f"{CUM} SELECT round(sum(t * tps / (tps + fps)) / max(pos), 6) AS average_precision FROM cum, tot")
def clf_pr_ap(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(classification.ranking_areas(t.clf(spark, sf)).select("average_precision"), "average_precision")


@query(f"{BASE} SELECT CAST(least(floor(score * 10), 9) AS INT) AS bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(y), 6) AS share FROM clf GROUP BY ALL")
def clf_calibration(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(classification.calibration(t.clf(spark, sf)), "mean_score", "share")


@query(f"{BASE}, r AS (SELECT source, y, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS r, row_number() OVER (PARTITION BY source ORDER BY y DESC, doc_id) AS i FROM clf), d AS (SELECT source, coalesce(sum(CASE WHEN r <= 10 THEN y / log2(r + 1) END), 0) AS dcg, sum(CASE WHEN i <= 10 THEN y / log2(i + 1) END) AS best FROM r GROUP BY source) SELECT source, round(dcg, 6) AS dcg, round(coalesce(dcg / NULLIF(best, 0), 0), 6) AS ndcg FROM d")
def rank_ndcg(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(classification.dcg(t.clf(spark, sf), query="source", gain="y", score="score", key="doc_id", k=10), "dcg", "ndcg")


# ---- regression


@query(f"{BASE} SELECT round(avg(abs(y - p)), 4) AS mae, round(avg(pow(y - p, 2)), 2) AS mse, round(sqrt(avg(pow(y - p, 2))), 4) AS rmse, round(avg(pow(ln(1 + y) - ln(1 + p), 2)), 6) AS msle, round(avg(abs(y - p) / greatest(abs(y), 2.220446049250313e-16)), 6) AS mape, round(max(abs(y - p)), 4) AS max_error, round(quantile_cont(abs(y - p), 0.5), 4) AS median_ae FROM reg")
def reg_errors(spark: SparkSession, sf: str) -> DataFrame:
    e = regression.errors(t.reg(spark, sf))
    return e.withColumns({c: F.round(c, d) for c, d in (("mae", 4), ("mse", 2), ("rmse", 4), ("msle", 6), ("mape", 6), ("max_error", 4), ("median_ae", 4))})


@query(f"{BASE} SELECT round(1 - sum(pow(y - p, 2)) / (var_pop(y) * count(*)), 6) AS r2, round(1 - var_pop(y - p) / var_pop(y), 6) AS explained_variance FROM reg")
def reg_r2_ev(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(regression.explained(t.reg(spark, sf)), "r2", "explained_variance")


@query(f"{BASE} SELECT round(avg(2 * (y * ln(y / p) - y + p)), 3) AS poisson, round(avg(2 * (ln(p / y) + y / p - 1)), 6) AS gamma, round(avg(0.5 * abs(y - p)), 4) AS pinball FROM reg")
def reg_deviances(spark: SparkSession, sf: str) -> DataFrame:
    d = regression.deviances(t.reg(spark, sf))
    return d.select(F.round("poisson", 3).alias("poisson"), F.round("gamma", 6).alias("gamma"), F.round("pinball", 4).alias("pinball"))


# ---- clusterings

CON = f"{BASE}, con AS (SELECT lang, source, CAST(count(*) AS DOUBLE) AS n FROM clf GROUP BY lang, source), ra AS (SELECT lang, sum(n) AS m FROM con GROUP BY lang), rb AS (SELECT source, sum(n) AS m FROM con GROUP BY source), tot AS (SELECT sum(n) AS t FROM con)"


@query(f"{CON} SELECT lang, source, CAST(n AS BIGINT) AS n FROM con")
def clu_contingency(spark: SparkSession, sf: str) -> DataFrame:
    return clustering_metrics.contingency(t.clf(spark, sf), "lang", "source")


@query(f"""{CON}, mi AS (SELECT sum(n / t * ln(n * t / (ra.m * rb.m))) AS mi FROM con JOIN ra USING (lang) JOIN rb USING (source), tot), ha AS (SELECT -sum(m / t * ln(m / t)) AS ha FROM ra, tot), hb AS (SELECT -sum(m / t * ln(m / t)) AS hb FROM rb, tot)
SELECT round(mi, 6) AS mi, round(ha, 6) AS ha, round(hb, 6) AS hb, round(2 * mi / (ha + hb), 6) AS nmi, round(mi / ha, 6) AS homogeneity, round(mi / hb, 6) AS completeness, round(2 * mi / (ha + hb), 6) AS v_measure FROM mi, ha, hb""")
def clu_mi_nmi_v(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(clustering_metrics.information(t.clf(spark, sf), "lang", "source"), "mi", "ha", "hb", "nmi", "homogeneity", "completeness", "v_measure")


@query(f"{CON}, k AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM con) AS s, (SELECT sum(m * (m - 1) / 2) FROM ra) AS a, (SELECT sum(m * (m - 1) / 2) FROM rb) AS b, (SELECT t * (t - 1) / 2 FROM tot) AS p) SELECT round((p + 2 * s - a - b) / p, 6) AS rand, round((s - a * b / p) / ((a + b) / 2 - a * b / p), 6) AS adjusted_rand, round(s / sqrt(a * b), 6) AS fowlkes_mallows FROM k")
def clu_rand_ari_fmi(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(clustering_metrics.pair_counts(t.clf(spark, sf), "lang", "source"), "rand", "adjusted_rand", "fowlkes_mallows")


CEN = f"{BASE}, e AS (SELECT id, label, unnest(v) AS x, unnest(range(len(v))) AS i FROM vec), cen AS (SELECT label, i, avg(x) AS m, count(*) AS n FROM e GROUP BY label, i), g AS (SELECT i, avg(x) AS g FROM e GROUP BY i)"


@query(f"{CEN}, w AS (SELECT sum(pow(x - m, 2)) AS ssw FROM e JOIN cen USING (label, i)), b AS (SELECT sum(n * pow(m - g, 2)) AS ssb, count(DISTINCT label) AS k FROM cen JOIN g USING (i)) SELECT round(ssw, 6) AS ssw, round(ssb, 6) AS ssb, round(ssb * ((SELECT count(*) FROM vec) - k) / (ssw * (k - 1)), 6) AS calinski_harabasz FROM w, b")
def clu_ch_db(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(clustering_metrics.dispersion(t.vectors(spark, sf)), "ssw", "ssb", "calinski_harabasz")


@query(f"""{CEN}, d AS (SELECT id, label, sqrt(sum(pow(x - m, 2))) AS d FROM e JOIN cen USING (label, i) GROUP BY id, label), s AS (SELECT label, avg(d) AS s FROM d GROUP BY label),
p AS (SELECT a.label AS la, b.label AS lb, sqrt(sum(pow(a.m - b.m, 2))) AS dd FROM cen a JOIN cen b ON a.i = b.i AND a.label <> b.label GROUP BY ALL)
SELECT round(avg(r), 6) AS davies_bouldin FROM (SELECT la, max((sa.s + sb.s) / dd) AS r FROM p JOIN s sa ON sa.label = la JOIN s sb ON sb.label = lb GROUP BY la)""")
def clu_davies_bouldin(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(clustering_metrics.davies_bouldin(t.vectors(spark, sf)), "davies_bouldin")


# ---- preprocessing

Q = ["l_quantity", "l_extendedprice"]
ROWS = "l_orderkey, l_linenumber"


def lineitem(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    return t.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *Q, *more)


def _scaled(expr: str) -> str:
    return f"SELECT {ROWS}, " + ", ".join(f"round({expr.format(c=c)}, 6) AS {c}" for c in Q) + " FROM lineitem"


@query(_scaled("({c} - (SELECT avg({c}) FROM lineitem)) / (SELECT stddev_pop({c}) FROM lineitem)"))
def scale_standard_pop(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(preprocessing.standard_scale(lineitem(spark, sf), Q), *Q)


@query(_scaled("({c} - (SELECT min({c}) FROM lineitem)) / (SELECT max({c}) - min({c}) FROM lineitem)"))
def scale_minmax(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(preprocessing.minmax_scale(lineitem(spark, sf), Q), *Q)


@query(_scaled("{c} / (SELECT max(abs({c})) FROM lineitem)"))
def scale_maxabs(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(preprocessing.maxabs_scale(lineitem(spark, sf), Q), *Q)


@query(_scaled("({c} - (SELECT quantile_cont({c}, 0.5) FROM lineitem)) / (SELECT quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) FROM lineitem)"))
def scale_robust(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(preprocessing.robust_scale(lineitem(spark, sf), Q), *Q)


@query(_scaled("{c} / sqrt(l_quantity * l_quantity + l_extendedprice * l_extendedprice)"))
def normalize_l2(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(preprocessing.normalize(lineitem(spark, sf), Q), *Q)


@query("SELECT l_orderkey, l_linenumber, CAST(l_quantity > 25 AS INT) AS l_quantity, CAST(l_extendedprice > 25 AS INT) AS l_extendedprice FROM lineitem")
def binarize(spark: SparkSession, sf: str) -> DataFrame:
    return preprocessing.binarize(lineitem(spark, sf), Q, 25.0)


@query("SELECT l_orderkey, l_linenumber, l_returnflag, CAST(l_returnflag = 'A' AS INT) AS l_returnflag_A, CAST(l_returnflag = 'N' AS INT) AS l_returnflag_N, CAST(l_returnflag = 'R' AS INT) AS l_returnflag_R FROM lineitem")
def one_hot(spark: SparkSession, sf: str) -> DataFrame:
    df = t.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return preprocessing.one_hot(df, "l_returnflag", ["A", "N", "R"])


@query("SELECT o_orderkey, o_orderpriority, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INT) AS code FROM orders")
def ordinal_sorted(spark: SparkSession, sf: str) -> DataFrame:
    return preprocessing.ordinal(t.read(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "code")


@query("SELECT l_orderkey, l_linenumber, l_quantity, CAST(least(floor((l_quantity - (SELECT min(l_quantity) FROM lineitem)) / (SELECT max(l_quantity) - min(l_quantity) FROM lineitem) * 5), 4) AS INT) AS bin FROM lineitem")
def kbins_uniform(spark: SparkSession, sf: str) -> DataFrame:
    return preprocessing.bins_uniform(lineitem(spark, sf).drop("l_extendedprice"), "l_quantity", 5, "bin")


@query("WITH q AS (SELECT quantile_cont(l_quantity, 0.25) AS a, quantile_cont(l_quantity, 0.5) AS b, quantile_cont(l_quantity, 0.75) AS c FROM lineitem) SELECT l_orderkey, l_linenumber, CAST((l_quantity >= a)::INT + (l_quantity >= b)::INT + (l_quantity >= c)::INT AS INT) AS bin FROM lineitem, q")
def kbins_quantile(spark: SparkSession, sf: str) -> DataFrame:
    return preprocessing.bins_quantile(lineitem(spark, sf), "l_quantity", 4, "bin").select("l_orderkey", "l_linenumber", "bin")


@query("WITH m AS (SELECT *, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS q FROM lineitem) SELECT l_orderkey, l_linenumber, round(coalesce(q, (SELECT avg(q) FROM m)), 6) AS q FROM m")
def impute_mean(spark: SparkSession, sf: str) -> DataFrame:
    df = lineitem(spark, sf).select("l_orderkey", "l_linenumber", F.when(C("l_linenumber") != 3, C("l_quantity")).alias("q"))
    return rounded(preprocessing.impute(df, ["q"]), "q")


@query("SELECT o_orderkey, round(percent_rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice), 6) AS rank FROM orders")
def quantile_rank(spark: SparkSession, sf: str) -> DataFrame:
    df = t.read(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return rounded(preprocessing.quantile_rank(df, "o_totalprice", "rank", group=["o_orderpriority"]).select("o_orderkey", "rank"), "rank")


@query("SELECT l_orderkey, l_linenumber, round(l_quantity * l_quantity, 4) AS qq, round(l_quantity * l_extendedprice, 4) AS qe, round(l_extendedprice * l_extendedprice, 2) AS ee FROM lineitem")
def poly_features(spark: SparkSession, sf: str) -> DataFrame:
    p = preprocessing.polynomial(lineitem(spark, sf), Q)
    names = ("l_quantity*l_quantity", "qq", 4), ("l_quantity*l_extendedprice", "qe", 4), ("l_extendedprice*l_extendedprice", "ee", 2)
    return p.select("l_orderkey", "l_linenumber", *[F.round(C(f"`{a}`"), d).alias(b) for a, b, d in names])


# ---- text

TC = "WITH tc AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_][a-z0-9_]+')) AS term FROM documents) GROUP BY doc_id, term)"


@query(f"{TC} SELECT doc_id, term, n FROM tc")
def count_vectorize(spark: SparkSession, sf: str) -> DataFrame:
    return text.term_counts(t.read(spark, sf, "documents"), "doc_id", "text")


@query(f"{TC}, d AS (SELECT term, ln((1.0 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM tc GROUP BY term), v AS (SELECT doc_id, term, n * idf AS v FROM tc JOIN d USING (term)), l AS (SELECT doc_id, sqrt(sum(v * v)) AS len FROM v GROUP BY doc_id) SELECT doc_id, term, round(v / len, 6) AS value FROM v JOIN l USING (doc_id)")
def tfidf_smooth_l2(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(text.tfidf(t.read(spark, sf, "documents"), "doc_id", "text"), "value")


# ---- selection

N = ["l_quantity", "l_discount", "l_tax"]
LONG = f"{BASE}, u AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS x, l_returnflag AS y, l_extendedprice AS target FROM reg" for c in N) + ")"


@query(f"{LONG} SELECT feature, round(var_pop(x), 6) AS variance FROM u GROUP BY feature")
def variance_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(selection.variances(t.reg(spark, sf), N), "variance")


@query(f"{LONG}, p AS (SELECT feature, y, sum(x) AS o, count(*) AS n FROM u GROUP BY feature, y), q AS (SELECT feature, o, n / sum(n) OVER (PARTITION BY feature) * sum(o) OVER (PARTITION BY feature) AS e FROM p) SELECT feature, round(sum(pow(o - e, 2) / e), 6) AS chi2 FROM q GROUP BY feature")
def chi2_scores(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(selection.chi2(t.reg(spark, sf), "l_returnflag", N), "chi2")


@query(f"{LONG}, p AS (SELECT feature, y, count(*) AS n, avg(x) AS m, var_pop(x) * count(*) AS w FROM u GROUP BY feature, y), g AS (SELECT feature, avg(x) AS g FROM u GROUP BY feature) SELECT feature, round(sum(n * pow(m - g, 2)) * (sum(n) - count(*)) / (sum(w) * (count(*) - 1)), 6) AS f FROM p JOIN g USING (feature) GROUP BY feature")
def f_classif_scores(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(selection.anova_f(t.reg(spark, sf), "l_returnflag", N), "f")


@query(f"{LONG} SELECT feature, round(corr(x, target), 6) AS r, round(pow(corr(x, target), 2) * (count(*) - 2) / (1 - pow(corr(x, target), 2)), 3) AS f FROM u GROUP BY feature")
def f_regression_scores(spark: SparkSession, sf: str) -> DataFrame:
    return selection.regression_f(t.reg(spark, sf), "l_extendedprice", N).select("feature", F.round("r", 6).alias("r"), F.round("f", 3).alias("f"))


@query(f"{LONG}, c AS (SELECT feature, x, y, CAST(count(*) AS DOUBLE) AS n FROM u GROUP BY ALL), w AS (SELECT feature, n, sum(n) OVER (PARTITION BY feature, x) AS a, sum(n) OVER (PARTITION BY feature, y) AS b, sum(n) OVER (PARTITION BY feature) AS t FROM c) SELECT feature, round(sum(n / t * ln(n * t / (a * b))), 6) AS mi FROM w GROUP BY feature")
def mi_discrete(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(selection.mutual_information(t.reg(spark, sf), "l_returnflag", N), "mi")


# ---- neighbours and models

DIST = "sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: pow(z[1] - z[2], 2))))"
KNN = f"{BASE}, d AS (SELECT a.id AS query_id, b.id, b.label, {DIST} AS distance FROM vec a JOIN vec b ON a.id % 20 = 0 AND a.id <> b.id), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), id) AS INT) AS rank FROM d)"


@query(f"{KNN} SELECT query_id, id, round(distance, 6) AS distance, rank FROM k WHERE rank <= 5")
def knn_topk(spark: SparkSession, sf: str) -> DataFrame:
    v = t.vectors(spark, sf).select("id", "v")
    return rounded(neighbors.nearest(v.filter("id % 20 = 0"), v, k=5), "distance")


@query(f"{KNN} SELECT query_id, label FROM (SELECT query_id, label, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, label) AS r FROM k WHERE rank <= 5 GROUP BY query_id, label) WHERE r = 1")
def knn_classify(spark: SparkSession, sf: str) -> DataFrame:
    v = t.vectors(spark, sf)
    near = neighbors.nearest(v.filter("id % 20 = 0").select("id", "v"), v.select("id", "v"), k=5)
    return neighbors.vote(near, v.select("id", "label"))


@query(f"{KNN} SELECT query_id, id, round(distance, 6) AS distance FROM d WHERE distance <= 1.2")
def radius_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    v = t.vectors(spark, sf).select("id", "v")
    return rounded(neighbors.nearest(v.filter("id % 20 = 0"), v, radius=1.2), "distance")


@query(f"{CEN}, d AS (SELECT e.id, cen.label AS predicted, sum(pow(x - m, 2)) AS d FROM e JOIN cen ON e.i = cen.i GROUP BY ALL) SELECT id, predicted FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(d, 12), predicted) AS r FROM d) WHERE r = 1")
def nearest_centroid(spark: SparkSession, sf: str) -> DataFrame:
    return neighbors.nearest_centroid(t.vectors(spark, sf))


@query(f"{LONG} SELECT y AS l_returnflag, feature, count(*) AS n, round(avg(x), 6) AS mean, round(var_pop(x), 6) AS var FROM u GROUP BY ALL")
def nb_gaussian_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(models.gaussian_nb_stats(t.reg(spark, sf), "l_returnflag", N), "mean", "var")


@query(f"{BASE} SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM reg")
def ols_normal_equations(spark: SparkSession, sf: str) -> DataFrame:
    m = models.least_squares(t.reg(spark, sf), "l_extendedprice", ["l_quantity"])
    return spark.createDataFrame([(round(float(m.coef[0]), 4), round(m.intercept, 3))], "slope double, intercept double")


@query(f"{BASE} SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(covar_pop(l_quantity, l_extendedprice), 3) AS c FROM reg UNION ALL SELECT 'l_quantity', 'l_quantity', round(var_pop(l_quantity), 3) FROM reg UNION ALL SELECT 'l_extendedprice', 'l_extendedprice', round(var_pop(l_extendedprice), 1) FROM reg")
def covariance_pop(spark: SparkSession, sf: str) -> DataFrame:
    c = models.covariance(t.reg(spark, sf), Q)
    rows = [(Q[0], Q[1], round(float(c[0, 1]), 3)), (Q[0], Q[0], round(float(c[0, 0]), 3)), (Q[1], Q[1], round(float(c[1, 1]), 1))]
    return spark.createDataFrame(rows, "a string, b string, c double")


@query(f"{BASE}, c AS (SELECT l_returnflag AS label, count(*) AS n FROM reg GROUP BY ALL) SELECT (SELECT label FROM c ORDER BY n DESC, label LIMIT 1) AS label, round(max(n) / sum(n), 6) AS share FROM c")
def dummy_most_frequent(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(models.dummy(t.reg(spark, sf), "l_returnflag"), "share")


@query(f"{BASE}, s AS (SELECT l_returnflag AS c, count(*) AS n, {', '.join(f'avg({c}) AS m_{c}, var_pop({c}) AS v_{c}' for c in N)} FROM reg GROUP BY l_returnflag), e AS (SELECT 1e-9 * max(greatest({', '.join(f'v_{c}' for c in N)})) AS e, sum(n) AS t FROM s), k AS (SELECT row_number() OVER () AS r, * FROM reg), p AS (SELECT l_returnflag, c AS predicted FROM k, s, e QUALIFY row_number() OVER (PARTITION BY r ORDER BY ln(n / t) {' '.join(f'- pow({c} - m_{c}, 2) / (2 * (v_{c} + e)) - 0.5 * ln(2 * pi() * (v_{c} + e))' for c in N)} DESC, c DESC) = 1) SELECT l_returnflag, predicted, count(*) AS n FROM p GROUP BY ALL")
def nb_gaussian_predict(spark: SparkSession, sf: str) -> DataFrame:
    df = t.reg(spark, sf)
    return models.gaussian_nb_predict(df, models.gaussian_nb_stats(df, "l_returnflag", N), "l_returnflag", N).groupBy("l_returnflag", "predicted").agg(F.count("*").alias("n"))


@query()
def pca_components(spark: SparkSession, sf: str) -> DataFrame:
    v, s = models.principal_components(t.reg(spark, sf), N, 2)
    return spark.createDataFrame([(i, float(s[i]), [float(x) for x in v[i]]) for i in range(2)], "i int, variance double, component array<double>")


@query("SELECT o_orderkey, CAST(o_orderkey % 5 AS INT) AS fold FROM orders")
def kfold_assignment(spark: SparkSession, sf: str) -> DataFrame:
    return folds.modular_fold(t.read(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 5)


@query("WITH s AS (SELECT o_orderkey, o_orderstatus, CAST(floor(CAST('0x' || substr(md5('0:' || CAST(o_orderkey AS VARCHAR)), 1, 12) AS BIGINT) / 281474976710656.0 * 64) AS INT) AS s FROM orders) SELECT o_orderkey, o_orderstatus, CAST((row_number() OVER (PARTITION BY o_orderstatus, s ORDER BY o_orderkey) - 1 + s) % 5 AS INT) AS fold FROM s")
def stratified_fold(spark: SparkSession, sf: str) -> DataFrame:
    return folds.stratified_fold(t.read(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey", 5)


@query("WITH g AS (SELECT o_custkey, CAST((row_number() OVER (ORDER BY count(*) DESC, o_custkey) - 1) % 4 AS INT) AS fold FROM orders GROUP BY o_custkey) SELECT o_orderkey, o_custkey, fold FROM orders JOIN g USING (o_custkey)")
def group_fold(spark: SparkSession, sf: str) -> DataFrame:
    return folds.group_fold(t.read(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 4)


@query("WITH p AS (SELECT event_id, event_type, ntile(4) OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS piece FROM events), s AS (SELECT *, unnest(range(1, 4)) AS split FROM p) SELECT event_id, event_type, CAST(split AS INT) AS split, CASE WHEN piece = split THEN 'test' ELSE 'train' END AS part FROM s WHERE piece <= split")
def time_series_split(spark: SparkSession, sf: str) -> DataFrame:
    return folds.time_splits(t.read(spark, sf, "events").select("event_id", "event_type", "ts"), ["ts", "event_id"], 3, group=["event_type"]).drop("ts")


@query(f"{BASE} SELECT a.id, b.id AS other, round(exp(-0.5 * pow({DIST}, 2)), 6) AS k FROM vec a JOIN vec b ON a.id % 20 = 0 AND a.id <> b.id")
def kernel_rbf(spark: SparkSession, sf: str) -> DataFrame:
    return _against_all(spark, sf, "squared").select("id", "other", F.round(F.exp(-0.5 * C("squared")), 6).alias("k"))


def _against_all(spark: SparkSession, sf: str, *sums: str) -> DataFrame:
    """id, other and sums over components of the query vectors (ids divisible by 20) and all others."""
    v = t.vectors(spark, sf).select("id", "v")
    return neighbors.against_all(v.filter("id % 20 = 0"), v, *sums)


# ---- lists and strings

LISTS = "WITH u AS (SELECT user_id, list(DISTINCT event_type ORDER BY event_type) AS a, list(event_id % 5 ORDER BY event_id) AS b FROM events GROUP BY user_id)"


def _lists(spark: SparkSession, sf: str) -> DataFrame:
    e = t.read(spark, sf, "events")
    return e.groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("a"), F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x % 5).alias("b"))


@query(f"{LISTS} SELECT user_id, list_aggregate(list_sort(list_intersect(a, ['click', 'view', 'nothing'])), 'string_agg', ',') AS both, len(list_filter(a, lambda x: NOT list_contains(['click', 'view'], x))) AS extra FROM u")
def list_shared(spark: SparkSession, sf: str) -> DataFrame:
    b = lambda *x: F.array(*[F.lit(i) for i in x])
    df = _lists(spark, sf)
    both = F.array_join(F.array_sort(lists.shared(C("a"), b("click", "view", "nothing"))), ",")
    return df.select("user_id", F.when(both != "", both).alias("both"), F.size(lists.difference(C("a"), b("click", "view"))["left"]).cast("long").alias("extra"))


@query("WITH c AS (SELECT user_id, event_id % 5 AS item, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, string_agg(CAST(item AS VARCHAR), ',' ORDER BY item) AS repeated FROM c WHERE n > 1 GROUP BY user_id")
def list_repeated(spark: SparkSession, sf: str) -> DataFrame:
    r = F.array_join(lists.repeated(C("b")).cast("array<string>"), ",")
    return _lists(spark, sf).select("user_id", r.alias("repeated")).filter("repeated <> ''")


@query("SELECT user_id, item, n FROM (SELECT user_id, event_id % 5 AS item, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_id % 5) AS r FROM events GROUP BY user_id, event_id % 5) WHERE r = 1")
def list_counts(spark: SparkSession, sf: str) -> DataFrame:
    first = lists.counts(C("b"))[0]
    return _lists(spark, sf).select("user_id", first["item"].alias("item"), first["n"].cast("long").alias("n"))


# ---- further models


@query(f"{BASE} SELECT l_linenumber, round(CASE WHEN y >= 0 THEN (pow(y + 1, 0.5) - 1) / 0.5 ELSE 0 END, 4) AS z FROM reg")
def power_transform(spark: SparkSession, sf: str) -> DataFrame:
    return mapping.power_transform(t.reg(spark, sf), "y", 0.5, "z").select("l_linenumber", F.round("z", 4).alias("z"))


def _model(spark: SparkSession, m: models.Linear, names: list[str]) -> DataFrame:
    return spark.createDataFrame([*zip(names, map(float, m.coef), strict=True), ("intercept", float(m.intercept))], "name string, value double")


def _inverse(m: str) -> list[list[str]]:
    """Entries of the inverse of a symmetric matrix with entries m00, m01, ... in SQL."""
    e = lambda i, j: f"{m}{min(i, j)}{max(i, j)}"
    det = f"({e(0, 0)} * ({e(1, 1)} * {e(2, 2)} - {e(1, 2)} * {e(1, 2)}) - {e(0, 1)} * ({e(0, 1)} * {e(2, 2)} - {e(1, 2)} * {e(0, 2)}) + {e(0, 2)} * ({e(0, 1)} * {e(1, 2)} - {e(1, 1)} * {e(0, 2)}))"
    minor = lambda i, j: [(a, b) for a in range(3) if a != i for b in range(3) if b != j]
    out = [[""] * 3 for _ in range(3)]
    for i in range(3):
        for j in range(3):
            (a, b), (c, d), (p, q), (r, s) = minor(i, j)
            out[i][j] = f"({'-' if (i + j) % 2 else ''}({e(a, b)} * {e(r, s)} - {e(c, d)} * {e(p, q)}) / {det})"
    return out


def _ridge_sql(alpha: float) -> str:
    moments = [f"covar_pop({N[i]}, {N[j]}) * count(*) {f'+ {alpha}' if i == j else ''} AS m{i}{j}" for i in range(3) for j in range(i, 3)] + [f"covar_pop({c}, l_extendedprice) * count(*) AS y{i}, avg({c}) AS a{i}" for i, c in enumerate(N)]
    inv = _inverse("m")
    w = ", ".join(f"{' + '.join(f'{inv[i][j]} * y{j}' for j in range(3))} AS w{i}" for i in range(3))
    rows = " UNION ALL ".join([f"SELECT '{c}' AS name, round(w{i}, 3) AS value FROM w" for i, c in enumerate(N)] + ["SELECT 'intercept', round(my - w0 * a0 - w1 * a1 - w2 * a2, 2) FROM w"])
    return f"{BASE}, m AS (SELECT {', '.join(moments)}, avg(l_extendedprice) AS my FROM reg), w AS (SELECT *, {w} FROM m) {rows}"


def _rounded_model(df: DataFrame) -> DataFrame:
    return df.select("name", F.when(C("name") == "intercept", F.round("value", 2)).otherwise(F.round("value", 3)).alias("value"))


@query(_ridge_sql(1.0))
def ridge_fit(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded_model(_model(spark, gram.ridge(gram.moments(t.reg(spark, sf), N, "l_extendedprice"), 1.0), N))


@query()
def lasso_fit(spark: SparkSession, sf: str) -> DataFrame:
    return _model(spark, gram.elastic_net(gram.moments(t.reg(spark, sf), N, "l_extendedprice"), 10.0), N)


@query()
def bayesian_ridge_fit(spark: SparkSession, sf: str) -> DataFrame:
    return _model(spark, gram.bayesian_ridge(gram.moments(t.reg(spark, sf), N, "l_extendedprice"))[0], N)


@query()
def partial_least_squares_fit(spark: SparkSession, sf: str) -> DataFrame:
    return _model(spark, gram.partial_least_squares(gram.moments(t.reg(spark, sf), N, "l_extendedprice"), 2), N)


def _ledoit_wolf_sql() -> str:
    d = [f"({c} - a{i})" for i, c in enumerate(N)]
    cov = ", ".join(f"avg({d[i]} * {d[j]}) AS c{i}{j}" for i in range(3) for j in range(3))
    squares = " + ".join(f"c{i}{j} * c{i}{j}" for i in range(3) for j in range(3))
    delta = " + ".join(f"pow(c{i}{j}{' - mu' if i == j else ''}, 2)" for i in range(3) for j in range(3))
    rows = " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, round((1 - k) * c{i}{j} {'+ k * mu' if i == j else ''}, 6) AS c, round(k, 9) AS shrinkage FROM k" for i in range(3) for j in range(3))
    return f"{BASE}, a AS (SELECT {', '.join(f'avg({c}) AS a{i}' for i, c in enumerate(N))} FROM reg), c AS (SELECT {cov}, sum(pow({' + '.join(f'{x} * {x}' for x in d)}, 2)) AS fourth, count(*) AS n FROM reg, a), m AS (SELECT *, (c00 + c11 + c22) / 3 AS mu FROM c), b AS (SELECT *, ({delta}) / 3 AS delta, (fourth / n - ({squares})) / (n * 3) AS beta FROM m), k AS (SELECT *, least(beta, delta) / delta AS k FROM b) {rows}"


@query(_ledoit_wolf_sql())
def covariance_shrunk(spark: SparkSession, sf: str) -> DataFrame:
    c, k = gram.ledoit_wolf(t.reg(spark, sf), N)
    d = spark.createDataFrame([(i, j, float(c[i, j]), k) for i in range(3) for j in range(3)], "i int, j int, c double, shrinkage double")
    return d.select("i", "j", F.round("c", 6).alias("c"), F.round("shrinkage", 9).alias("shrinkage"))


def _discriminant_sql() -> str:
    within = ", ".join(f"sum(({N[i]} - m{i}) * ({N[j]} - m{j})) / count(*) AS c{i}{j}" for i in range(3) for j in range(i, 3))
    inv = _inverse("c")
    maha = " + ".join(f"({N[i]} - m{i}) * ({N[j]} - m{j}) * {inv[i][j]}" for i in range(3) for j in range(3))
    return f"{BASE}, s AS (SELECT l_returnflag AS c, count(*) AS n, {', '.join(f'avg({c}) AS m{i}' for i, c in enumerate(N))} FROM reg GROUP BY l_returnflag), w AS (SELECT {within} FROM reg JOIN s ON c = l_returnflag), k AS (SELECT row_number() OVER () AS r, * FROM reg), p AS (SELECT l_returnflag, c AS predicted FROM k, s, w QUALIFY row_number() OVER (PARTITION BY r ORDER BY ln(n / (SELECT sum(n) FROM s)) - 0.5 * ({maha}) DESC, c DESC) = 1) SELECT l_returnflag, predicted, count(*) AS n FROM p GROUP BY ALL"


@query(_discriminant_sql())
def discriminant_predict(spark: SparkSession, sf: str) -> DataFrame:
    df = t.reg(spark, sf)
    p = gram.discriminant(df, "l_returnflag", N).predict(N)
    return df.select("l_returnflag", p.alias("predicted")).groupBy("l_returnflag", "predicted").agg(F.count("*").alias("n"))


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return t.tracks(spark, sf).select("id", F.array("x", "y").alias("v"))


@query()
def k_means(spark: SparkSession, sf: str) -> DataFrame:
    return clustering.k_means(t.vectors(spark, sf).select("id", "v"), 10, rounds=10)[1]


@query(f"""WITH RECURSIVE {BASE[5:]}, p AS (SELECT id, x, y FROM track), c AS (SELECT x, y, count(*) AS n, min(id) AS least FROM p GROUP BY x, y),
k AS (SELECT a.x, a.y, a.n, a.least, sum(b.n) AS near FROM c a JOIN c b ON abs(a.x - b.x) + abs(a.y - b.y) <= 1 GROUP BY ALL), core AS (SELECT * FROM k WHERE near >= 4),
walk(x, y, root) USING KEY (x, y) AS (SELECT x, y, least AS root FROM core UNION SELECT a.x, a.y, min(w.root) AS root FROM core a JOIN walk w ON abs(a.x - w.x) + abs(a.y - w.y) = 1 JOIN recurring.walk o ON o.x = a.x AND o.y = a.y WHERE w.root < o.root GROUP BY a.x, a.y),
border AS (SELECT k.x, k.y, arg_min(w.root, core.least) AS root FROM k JOIN core ON abs(k.x - core.x) + abs(k.y - core.y) <= 1 JOIN walk w ON w.x = core.x AND w.y = core.y WHERE k.near < 4 GROUP BY ALL)
SELECT p.id, k.near >= 4 AS core, coalesce(w.root, border.root) AS cluster FROM p JOIN k USING (x, y) LEFT JOIN walk w USING (x, y) LEFT JOIN border USING (x, y)""")
def dbscan(spark: SparkSession, sf: str) -> DataFrame:
    return clustering.dbscan(_points(spark, sf), 1.0, 4)


@query(f"{BASE}, p AS (SELECT id, x, y FROM track) SELECT a.id AS a, b.id AS b, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 6) AS distance FROM p a JOIN p b ON a.id < b.id WHERE sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 1")
def grid_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return clustering.grid_pairs(_points(spark, sf), 1.0, digits=6)


@query(f"""{BASE}, d AS (SELECT a.id AS q, b.id, sqrt({DSQ}) AS d FROM vec a JOIN vec b ON a.id <> b.id), n AS (SELECT q, id, d FROM d QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(d, 9), id) <= 5), kd AS (SELECT q, max(d) AS kd FROM n GROUP BY q),
l AS (SELECT n.q, 1 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM n JOIN kd ON kd.q = n.id GROUP BY n.q) SELECT n.q AS id, round(avg(o.lrd) / max(l.lrd), 6) AS factor FROM n JOIN l ON l.q = n.q JOIN l o ON o.q = n.id GROUP BY n.q""")
def outlier_factor(spark: SparkSession, sf: str) -> DataFrame:
    v = t.vectors(spark, sf).select("id", "v")
    return rounded(clustering.outlier_factor(neighbors.nearest(v, v, k=5), 5), "factor")


@query()
def label_spreading(spark: SparkSession, sf: str) -> DataFrame:
    v = t.vectors(spark, sf)
    e = neighbors.nearest(v.select("id", "v"), v.select("id", "v"), k=5).select(C("query_id").alias("a"), C("id").alias("b"), F.exp(-C("distance")).alias("w"))
    return clustering.spread_labels(e, v.filter("id % 20 = 0").select("id", "label"))


@query()
def fourier_features(spark: SparkSession, sf: str) -> DataFrame:
    v = t.vectors(spark, sf)
    return v.select("id", mapping.fourier_features(C("v"), 64, 32, 0.5).alias("f"))


@query()
def random_projection(spark: SparkSession, sf: str) -> DataFrame:
    return t.vectors(spark, sf).select("id", mapping.random_projection(C("v"), 64, 8).alias("f"))


@query()
def logistic_regression(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.ml.classification import LogisticRegression

    df = t.reg(spark, sf).withColumn("label", (C("l_linestatus") == "O").cast("double"))
    out = models.fit_ml(LogisticRegression(maxIter=10), df, N)
    return out.groupBy("label", "prediction").agg(F.count("*").alias("n"))


@query()
def tree_regression(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.ml.regression import DecisionTreeRegressor

    out = models.fit_ml(DecisionTreeRegressor(maxDepth=4), t.reg(spark, sf).withColumn("label", C("l_extendedprice")), N)
    return regression.errors(out, "label", "prediction")


# ---- more metrics



@query(f"""{BASE}, d AS (SELECT a.id, a.label AS la, b.label AS lb, sum({DSQ}) AS s, count(*) AS n FROM vec a JOIN vec b ON true GROUP BY ALL), m AS (SELECT id, la, max(CASE WHEN la = lb THEN s / greatest(n - 1, 1) END) AS a, max(CASE WHEN la = lb THEN n END) AS n, min(CASE WHEN la <> lb THEN s / n END) AS b FROM d GROUP BY id, la)
SELECT round(avg(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM m""")
def clu_silhouette(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(clustering_metrics.silhouette(t.vectors(spark, sf)), "silhouette")


@query(f"""{BASE} SELECT a.id AS a, b.id AS b, round(list_sum(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2]))), 6) AS manhattan, round(list_max(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2]))), 6) AS chebyshev, round({DSQ}, 6) AS squared
FROM vec a JOIN vec b ON a.id <> b.id""")
def pairwise_distances(spark: SparkSession, sf: str) -> DataFrame:
    v = t.vectors(spark, sf).select("id", "v")
    d = neighbors.against_all(v, v, "manhattan", "chebyshev", "squared")
    return rounded(d.withColumnsRenamed({"id": "a", "other": "b"}), "manhattan", "chebyshev", "squared")


ML = "WITH s AS (SELECT user_id AS row, event_type AS cls, CAST(count(*) % 7 AS DOUBLE) AS score, CAST(count(*) % 2 AS INT) AS y, CAST(count(*) % 3 = 0 AS INT) AS p FROM events GROUP BY ALL), r AS (SELECT *, count(*) OVER w AS k, sum(y) OVER w AS tr FROM s WINDOW w AS (PARTITION BY row ORDER BY score DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"


def _multilabel(spark: SparkSession, sf: str) -> DataFrame:
    g = t.read(spark, sf, "events").groupBy(C("user_id").alias("row"), C("event_type").alias("cls")).agg(F.count("*").alias("n"))
    return g.select("row", "cls", (C("n") % 7).cast("double").alias("score"), (C("n") % 2).cast("int").alias("y"), (C("n") % 3 == 0).cast("int").alias("p"))


@query(f"{ML} SELECT round(avg(c), 6) AS coverage_error FROM (SELECT row, max(CASE WHEN y = 1 THEN k ELSE 0 END) AS c FROM r GROUP BY row)")
def multilabel_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(multilabel.coverage_error(_multilabel(spark, sf)), "coverage_error")


@query(f"{ML} SELECT round(avg(CASE WHEN t = 0 OR t = n THEN 1.0 ELSE p END), 6) AS ranking_precision FROM (SELECT row, sum(y) AS t, count(*) AS n, avg(CASE WHEN y = 1 THEN tr / k END) AS p FROM r GROUP BY row)")
def multilabel_precision(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(multilabel.ranking_precision(_multilabel(spark, sf)), "ranking_precision")


@query(f"{ML}, q AS (SELECT a.row, avg(CASE WHEN a.score <= b.score THEN 1.0 ELSE 0 END) AS w FROM s a JOIN s b ON a.row = b.row AND a.y = 1 AND b.y = 0 GROUP BY a.row) SELECT round(sum(w) / (SELECT count(DISTINCT row) FROM s), 6) AS ranking_loss FROM q")
def multilabel_ranking_loss(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(multilabel.ranking_loss(_multilabel(spark, sf)), "ranking_loss")


@query(f"{ML} SELECT round(avg(e), 6) AS subset_accuracy, round(avg(h), 6) AS hamming_loss, round(avg(j), 6) AS jaccard FROM (SELECT row, min(CASE WHEN y = p THEN 1 ELSE 0 END) AS e, avg(CASE WHEN y <> p THEN 1.0 ELSE 0 END) AS h, coalesce(sum(y * p) / NULLIF(sum(greatest(y, p)), 0), 0) AS j FROM s GROUP BY row)")
def multilabel_sets(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(multilabel.set_scores(_multilabel(spark, sf)), "subset_accuracy", "hamming_loss", "jaccard")


@query("SELECT o_orderkey, CASE WHEN CAST('0x' || substr(md5('0:' || CAST(o_orderkey AS VARCHAR)), 1, 12) AS BIGINT) / 281474976710656.0 < 0.25 THEN 'test' ELSE 'train' END AS part FROM orders")
def train_test_split(spark: SparkSession, sf: str) -> DataFrame:
    return folds.train_test(t.read(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query(f"{BASE}, c AS (SELECT l_returnflag, count(*) AS n FROM reg GROUP BY ALL) SELECT l_returnflag, n, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n), 6) AS weight FROM c")
def class_weights(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(more_models.class_weights(t.reg(spark, sf), "l_returnflag"), "weight")


TL = f"{TC}, lab AS (SELECT doc_id, quality AS label FROM labels)"


def _terms(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    labels = t.read(spark, sf, "labels").select("doc_id", C("quality").alias("label"))
    return text.term_counts(t.read(spark, sf, "documents"), "doc_id", "text"), labels


@query(f"{TL}, c AS (SELECT label, term, sum(n) AS n FROM tc JOIN lab USING (doc_id) GROUP BY label, term), s AS (SELECT label, sum(n) AS t FROM c GROUP BY label) SELECT label, term, round(ln((n + 1) / (t + (SELECT count(DISTINCT term) FROM c))), 6) AS log_p FROM c JOIN s USING (label)")
def nb_multinomial_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(models.multinomial_nb_stats(*_terms(spark, sf), "doc_id"), "log_p")


@query(f"{TL}, d AS (SELECT label, count(*) AS docs FROM lab GROUP BY label), c AS (SELECT label, term, count(*) AS n FROM tc JOIN lab USING (doc_id) GROUP BY label, term) SELECT label, term, round(ln((n + 1) / (docs + 2)), 6) AS log_p, round(ln(1 - (n + 1) / (docs + 2)), 6) AS log_q FROM c JOIN d USING (label)")
def nb_bernoulli_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(more_models.bernoulli_nb_stats(*_terms(spark, sf), "doc_id"), "log_p", "log_q")


@query(f"{TL}, c AS (SELECT label, term, sum(n) AS n FROM tc JOIN lab USING (doc_id) GROUP BY label, term), w AS (SELECT label, term, n, sum(n) OVER (PARTITION BY term) AS t, sum(n) OVER (PARTITION BY label) AS s, sum(n) OVER () AS a FROM c) SELECT label, term, round(-ln((t - n + 1) / (a - s + (SELECT count(DISTINCT term) FROM c))), 6) AS weight FROM w")
def nb_complement_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(more_models.complement_nb_stats(*_terms(spark, sf), "doc_id"), "weight")


@query(f"{BASE}, c AS (SELECT l_returnflag, CAST(l_linenumber AS VARCHAR) AS value, count(*) AS n FROM reg GROUP BY ALL) SELECT l_returnflag, 'l_linenumber' AS feature, value, round(ln((n + 1) / (sum(n) OVER (PARTITION BY l_returnflag) + (SELECT count(DISTINCT value) FROM c))), 6) AS log_p FROM c")
def nb_categorical_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(more_models.categorical_nb_stats(t.reg(spark, sf), "l_returnflag", ["l_linenumber"]), "log_p")


@query()
def isolation_scores(spark: SparkSession, sf: str) -> DataFrame:
    v = t.vectors(spark, sf)
    return v.select("id", more_models.isolation_forest(v, trees=50).column(C("v")).alias("score"))


@query(f"{BASE} SELECT CAST(q AS DOUBLE) AS value, round(avg(2 * q + 3 * l_tax), 6) AS mean_prediction FROM reg, (SELECT unnest([10, 20, 30]) AS q) GROUP BY q")
def partial_dependence(spark: SparkSession, sf: str) -> DataFrame:
    p = more_models.partial_dependence(t.reg(spark, sf), 2 * C("l_quantity") + 3 * C("l_tax"), "l_quantity", [10, 20, 30])
    return rounded(p, "mean_prediction")


@query()
def gradient_logistic(spark: SparkSession, sf: str) -> DataFrame:
    df = t.reg(spark, sf).withColumn("target", (C("l_extendedprice") > 50_000).cast("int"))
    return _model(spark, more_models.gradient_fit(df, "target", N, loss="log", rounds=10), N)


@query()
def factor_loadings(spark: SparkSession, sf: str) -> DataFrame:
    w, psi = decomposition.factor_analysis(t.vectors(spark, sf), 64, 3)
    return spark.createDataFrame([(i, [float(x) for x in w[:, i]], float(psi[i])) for i in range(64)], "i int, loadings array<double>, noise double")


@query()
def truncated_svd(spark: SparkSession, sf: str) -> DataFrame:
    v, s = decomposition.truncated_svd(t.vectors(spark, sf), 64, 4)
    return spark.createDataFrame([(i, float(s[i]), [float(x) for x in v[i]]) for i in range(4)], "i int, value double, vector array<double>")


@query()
def canonical_correlation(spark: SparkSession, sf: str) -> DataFrame:
    s = decomposition.canonical_correlation(t.vectors(spark, sf), 32, 64, 4)[2]
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(s)], "i int, correlation double")

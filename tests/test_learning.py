"""Models fitted by sums against plain NumPy on small tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmill.operators import clustering, gram, mapping, models, neighbors, preprocessing

COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.2], [0, 0, 1]])
    y = x @ [2.0, 0.0, -1.0] + 3 + 0.1 * rng.normal(size=300)
    k = (x[:, 0] + x[:, 1] > 0).astype(int)
    return x, y, k, spark.createDataFrame([(*map(float, r), float(t), int(c)) for r, t, c in zip(x, y, k, strict=True)], "a double, b double, c double, y double, k int").cache()


def test_linear(data):
    x, y, _, df = data
    m = gram.moments(df, COLS, "y")
    xc, yc = x - x.mean(0), y - y.mean()
    assert np.allclose(models.least_squares(df, "y", COLS).coef, np.linalg.lstsq(xc, yc, rcond=None)[0])
    r = gram.ridge(m, 5.0)
    assert np.allclose(r.coef, np.linalg.solve(xc.T @ xc + 5 * np.eye(3), xc.T @ yc)) and np.allclose(gram.ridge_path(m, [5.0])[0].coef, r.coef)
    w = gram.elastic_net(m, 0.2).coef
    g = -xc.T @ (yc - xc @ w) / len(y)
    assert all(abs(g[j] + 0.2 * np.sign(w[j])) < 1e-6 if w[j] else abs(g[j]) <= 0.2 + 1e-9 for j in range(3))
    assert abs(gram.orthogonal_pursuit(m, 2).coef[1]) < 1e-12
    assert np.allclose(gram.partial_least_squares(m, 3).coef, models.least_squares(df, "y", COLS).coef)
    b, noise, _ = gram.bayesian_ridge(m)
    assert np.allclose(b.coef, [2, 0, -1], atol=0.05) and noise == pytest.approx(100, rel=0.3)
    assert gram.lasso_path(m, 3)[0][1].coef == pytest.approx([0, 0, 0])
    p = df.select((F.col("y") - r.predict(COLS)).alias("e")).agg(F.avg("e")).head()[0]
    assert abs(p) < 1e-9


def test_covariances(data):
    x, _, _, df = data
    c = models.covariance(df, COLS)
    assert np.allclose(c, np.cov(x.T, bias=True))
    s, k = gram.ledoit_wolf(df, COLS)
    assert 0 < k < 1 and np.trace(s) == pytest.approx(np.trace(c))
    assert 0 < gram.oracle_shrinkage(c, 300)[1] < 1
    w, q = gram.graphical_lasso(c, 0.0)
    assert np.allclose(w, c, atol=1e-3) and np.allclose(q, np.linalg.inv(c), atol=1e-2)
    assert abs(gram.graphical_lasso(c, 10.0)[1][0, 1]) < 1e-12
    d = gram.mahalanobis(df, COLS, x.mean(0), np.linalg.inv(c)).agg(F.avg("distance")).head()[0]
    assert d == pytest.approx(3)
    v, s = models.principal_components(df, COLS, 2)
    assert np.allclose(np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1][:2], s) and np.allclose(v @ v.T, np.eye(2))


@pytest.mark.parametrize("quadratic", [False, True])
def test_discriminant(data, quadratic):
    _, _, k, df = data
    d = gram.discriminant(df, "k", COLS, quadratic)
    assert df.select((d.predict(COLS) == F.col("k")).cast("double").alias("h")).agg(F.avg("h")).head()[0] > 0.93


def test_naive_bayes(data):
    df = data[3]
    out = models.gaussian_nb_predict(df, models.gaussian_nb_stats(df, "k", COLS), "k", COLS)
    assert out.agg(F.avg((F.col("predicted") == F.col("k")).cast("double"))).head()[0] > 0.85


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.3, (40, 2)) for c in ((0, 0), (5, 5), (0, 6))] + [[[20.0, 20.0]]])
    return x, spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "id long, v array<double>").cache()


def test_k_means(blobs):
    x, df = blobs
    centres, out = clustering.k_means(df.filter("id < 120"), 3)
    got = dict(out.collect())
    inertia = sum(((x[i] - centres[c]) ** 2).sum() for i, c in got.items())
    assert len(got) == 120 and all(got[i] == ((x[i] - centres) ** 2).sum(axis=1).argmin() for i in got) and inertia > 0


def plain_dbscan(x, eps, m):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = (d <= eps).sum(1) >= m
    label = np.where(core, np.arange(len(x)), -1)
    for _ in range(len(x)):
        for i in np.flatnonzero(core):
            label[i] = label[(d[i] <= eps) & core].min()
    out = {}
    for i in range(len(x)):
        near = np.flatnonzero((d[i] <= eps) & core)
        out[i] = (bool(core[i]), int(label[i]) if core[i] else int(label[near[0]]) if len(near) else None)
    return out


def test_dbscan(blobs):
    x, df = blobs
    assert {r.id: (r.core, r.cluster) for r in clustering.dbscan(df, 0.35, 5).collect()} == plain_dbscan(x, 0.35, 5)
    assert len({r.cluster for r in clustering.single_linkage(df, 1.5).collect()}) == 4


def test_neighbours(blobs):
    x, df = blobs
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    got = neighbors.nearest(df.filter("id % 20 = 0"), df, k=3, block=17).collect()
    for i in range(0, 121, 20):
        want = sorted((round(d[i, j], 9), j) for j in range(len(x)) if j != i)[:3]
        assert [r.id for r in sorted((r for r in got if r.query_id == i), key=lambda r: r["rank"])] == [j for _, j in want]
    f = {r.id: r.factor for r in clustering.outlier_factor(neighbors.nearest(df, df, k=5), 5).collect()}
    assert max(f, key=f.get) == 120


def test_label_spreading(spark):
    e = spark.createDataFrame([(i, i + 1, 1.0) for i in range(9)], "a long, b long, w double")
    k = spark.createDataFrame([(0, "x"), (9, "y")], "id long, label string")
    got = {r.id: r.label for r in clustering.spread_labels(e, k, rounds=30).collect()}
    assert all(got[i] == ("x" if i < 5 else "y") for i in range(10))


def test_maps(blobs):
    x, df = blobs
    kernel = np.exp(-0.5 * ((x[:, None] - x[None]) ** 2).sum(2))
    f = np.array([r[0] for r in df.orderBy("id").select(mapping.fourier_features(F.col("v"), 2, 2000, 0.5)).collect()])
    assert np.abs(f @ f.T - kernel).max() < 0.15
    n = np.array([r[0] for r in df.orderBy("id").select(mapping.nystroem(df, "v", 121, 0.5)).collect()])
    assert np.abs(n @ n.T - kernel).max() < 1e-4
    p = df.select(mapping.random_projection(F.col("v"), 2, 5).alias("p")).head().p
    assert len(p) == 5 and mapping.safe_dimension(1000) > 5000
    assert len(df.select(mapping.hashed_vector(F.array(F.lit("a"), F.lit("b")), 8).alias("h")).head().h) == 8


def test_power(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(rng.lognormvariate(0, 1) - 1,) for _ in range(300)], "x double")
    best = max(mapping.power_likelihood(df, "x", [0.0, 0.5, 1.0, 2.0]), key=lambda t: t[1])
    assert best[0] == 0.0


def test_scaling_edges(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, None)], "a double, b double")
    assert [r.a for r in preprocessing.standard_scale(df, ["a"]).collect()] == [0.0, 0.0]
    assert [r.b for r in preprocessing.impute(df, ["b"]).collect()] == [2.0, 2.0]
    assert preprocessing.minmax_scale(df.filter("false"), ["a"]).count() == 0


def vectors_df(spark, x):
    return spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "id long, v array<double>").repartition(3).cache()


def test_decompositions(spark):
    from trailmill.operators import decomposition as dec

    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 2)) @ rng.normal(size=(2, 5)) + 0.1 * rng.normal(size=(400, 5)) + 1
    df = vectors_df(spark, x)
    mean, c, var = dec.pca(df, 5, 2)
    want = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(mean, x.mean(0)) and np.allclose(var, want[1][:2] ** 2 / 400) and np.allclose(np.abs(c @ want[2][:2].T), np.eye(2), atol=1e-6)
    v, s = dec.truncated_svd(df, 5, 3)
    assert np.allclose(s, np.linalg.svd(x, compute_uv=False)[:3])
    w, psi = dec.factor_analysis(df, 5, 2)
    assert np.allclose(w.T @ w + np.diag(psi), np.cov(x.T, bias=True), atol=0.05)
    a, b, r = dec.canonical_correlation(df, 2, 5, 1)
    xc = x - x.mean(0)
    assert r[0] == pytest.approx(np.corrcoef(xc[:, :2] @ a[0], xc[:, 2:] @ b[0])[0, 1], abs=1e-6)
    assert dec.cross_svd(df, 2, 5, 1)[2][0] == pytest.approx(np.linalg.svd(xc[:, :2].T @ xc[:, 2:] / 400)[1][0])
    p = np.array([r[0] for r in df.orderBy("id").select(dec.transform(F.col("v"), c, mean)).collect()])
    assert np.allclose(p, xc @ c.T)


def test_ica_and_nmf(spark):
    from trailmill.operators import decomposition as dec

    rng = np.random.default_rng(6)
    s = np.column_stack([rng.uniform(-1, 1, 1500), rng.choice([-1.0, 1.0], 1500)])
    mean, u = dec.fast_ica(vectors_df(spark, s @ np.array([[1.0, 0.6], [0.4, 1.0]])), 2, 2)
    got = (s @ np.array([[1.0, 0.6], [0.4, 1.0]]) - mean) @ u.T
    corr = np.abs(np.corrcoef(got.T, s.T)[:2, 2:])
    assert corr.max(axis=1).min() > 0.97
    parts = np.array([[1.0, 0, 2, 0, 1], [0, 3, 0, 1, 1]])
    x = rng.uniform(0, 1, (200, 2)) @ parts
    df = vectors_df(spark, x)
    h = dec.nmf(df, 5, 2, rounds=25)
    w = np.array([r[0] for r in df.orderBy("id").select(dec.nmf_weights(F.col("v"), h)).collect()])
    assert (h >= 0).all() and (w >= 0).all() and np.abs(w @ h - x).mean() < 0.03 * x.mean() + 0.02
    code = np.array(df.select(dec.sparse_code(F.col("v"), parts, 2)).head()[0])
    assert (np.abs(code) > 1e-9).sum() <= 2


def test_isolation(blobs):
    from trailmill.operators import more_models

    x, df = blobs
    f = more_models.isolation_forest(df, trees=60, sample=64)
    s = {r.id: r.s for r in df.select("id", f.column(F.col("v")).alias("s")).collect()}
    assert max(s, key=s.get) == 120 and s[120] > 0.6 > np.median(list(s.values()))
    assert more_models.isolation_forest(df.filter("false")).trees == []


@pytest.mark.parametrize("loss", ["log", "hinge", "squared_hinge", "perceptron"])
def test_gradient_classifiers(data, loss):
    from trailmill.operators import more_models

    df = data[3]
    m = more_models.gradient_fit(df, "k", COLS, loss=loss, rounds=25)
    hit = ((m.predict(COLS) > 0).cast("int") == F.col("k")).cast("double")
    assert df.agg(F.avg(hit)).head()[0] > 0.93


def test_columns(data):
    from trailmill.operators import more_models, selection

    df = data[3]
    assert more_models.eliminate(gram.moments(df, COLS, "y"), 2) == [0, 2]
    assert more_models.best_columns(selection.regression_f(df, "y", COLS), "f", 1) == ["a"]
    m = more_models.gradient_fit(df, "y", COLS, loss="squared", rounds=60)
    assert np.allclose(m.coef, models.least_squares(df, "y", COLS).coef, atol=0.05)
    votes = df.select(F.lit(1).alias("p"), F.lit(0).alias("q"), F.lit(1).alias("r"))
    assert more_models.voting(votes, ["p", "q", "r"]).head().vote == 1

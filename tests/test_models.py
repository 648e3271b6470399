"""Steps, searches, models of models and what of the newer operators SQL doesn't cover."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmill.operators import clustering, clustering_metrics, compose, folds, gram, kernel_models, lap, links, meta, metric_registry, model_selection, neighbors, preprocessing, regression, robust, selection, sparse, text, tracks
from trailmill.sources import synthetic


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(1)
    rows = [(i, float(i % 17), rng.gauss(0, 1), i % 4, "abc"[i % 3]) for i in range(400)]
    return spark.createDataFrame([(*r, 2 * r[1] - r[2] + rng.gauss(0, 0.1)) for r in rows], "id long, x1 double, x2 double, fold int, kind string, y double").cache()


def test_steps_learn_from_training_rows_only(spark, table):
    far = spark.createDataFrame([(1, 1000.0, None)], "id long, x1 double, x2 double")
    row = compose.pipeline(compose.filled(["x2"]), compose.standard(["x1", "x2"]))(table)(far).head()
    x = [r.x1 for r in table.collect()]
    assert math.isclose(row.x1, (1000 - statistics.fmean(x)) / statistics.pstdev(x)) and abs(row.x2) < 1e-9
    flat = spark.createDataFrame([(1.0,), (1.0,)], "x1 double")
    assert [r.x1 for r in compose.standard(["x1"])(flat)(flat).collect()] == [0.0, 0.0]
    assert compose.indicators("kind")(table.filter("kind <> 'c'"))(table.filter("kind = 'c'")).agg(F.sum("kind=a"), F.sum("kind=b")).head()[0:2] == (0, 0)
    with pytest.raises(ValueError, match="more than"):
        compose.indicators("id", most=5)(table)
    assert compose.columns_of(table, pattern="^x", kinds=["double"]) == ["x1", "x2"]


def test_robust_step(table):
    out = compose.robust(["x1"])(table)(table)
    q = np.quantile([r.x1 for r in table.collect()], [0.25, 0.5, 0.75])
    got = sorted({round(r.x1, 6) for r in out.select("x1").collect()})
    assert len(got) == 17 and abs(got[8]) < 0.2 and abs(max(got) - (16 - q[1]) / (q[2] - q[0])) < 0.2


def test_searches(table):
    grid = model_selection.parameter_grid(alpha=[0.001, 1e6], x=["x1", "x2"])
    assert len(grid) == 4 and grid[1] == {"alpha": 0.001, "x": "x2"}
    sample = model_selection.parameter_sample(3, seed=1, alpha=[0.001, 1e6], x=["x1", "x2"])
    assert len(sample) == 3 and all(p in grid for p in sample) and sample == model_selection.parameter_sample(3, seed=1, alpha=[0.001, 1e6], x=["x1", "x2"])
    make = lambda alpha, x: compose.linear([x], "y", alpha=alpha)
    assert model_selection.best(model_selection.search(make, grid, table, "y")) == {"alpha": 0.001, "x": "x1"}
    rounds = model_selection.halving_search(make, grid, table, "y", "id", factor=2, first_share=0.3)
    assert [len(left) for _, left in rounds] == [4, 2, 1] and rounds[-1][1] == [{"alpha": 0.001, "x": "x1"}]


def test_permutation_keeps_values(table):
    got = model_selection.permuted(table, "y", "id", 3, blocks=4)
    assert sorted(r.y for r in got.collect()) == sorted(r.y for r in table.collect())
    assert sum(a.y != b.y for a, b in zip(got.orderBy("id").collect(), table.orderBy("id").collect(), strict=True)) > 300


def test_stacking_and_chain_beat_single_models(table):
    make = lambda x: lambda target, out: compose.linear([x], target, out)
    score = lambda d: d.agg(model_selection.r2(F.col("y"), F.col("prediction"))).head()[0]
    assert score(meta.stacking([make("x1"), make("x2")], "y")(table)(table)) > 0.98 > score(meta.voting([make("x1"), make("x2")], "y")(table)(table))
    wide = table.withColumn("z", F.col("y") * 3 + F.col("x2"))
    chain = meta.chain(lambda c, t, o: compose.linear(c, t, o), ["x1", "x2"], ["y", "z"])(wide)(wide)
    assert chain.columns[: len(wide.columns)] == wide.columns and chain.agg(F.corr("z", "predicted_z")).head()[0] > 0.99


def test_leave_out(spark):
    assert folds.leave_out("abcd", 2)[0] == ("a", "b") and len(folds.leave_out(range(6), 3)) == 20
    assert folds.even_slices(10, 3) == [(0, 4), (4, 7), (7, 10)] and folds.even_slices(1, 3) == [(0, 1)]


def test_f_tail():
    for f, a, b, want in ((1.0, 1, 1, 0.5), (4.0, 2, 10, 0.052922), (161.4476, 1, 1, 0.05), (3.4928, 2, 20, 0.05), (0.0, 3, 3, 1.0)):
        assert abs(selection.f_tail(f, a, b) - want) < 2e-5
    p = {"a": 0.001, "b": 0.02, "c": 0.04, "d": 0.9}
    assert selection.significant(p) == ["a", "b", "c"] and selection.significant(p, control="fdr") == ["a", "b"] and selection.significant(p, control="fwe") == ["a"]


def test_metric_registry(spark):
    log = spark.createDataFrame([("s", 1, "MATCH", 1, 1, 0.5), ("s", 2, "MISS", 1, None, None), ("t", 1, "FP", None, 2, None)], "seq string, frame long, type string, oid long, hid long, d double")
    m = metric_registry.standard()
    m.register("half", lambda n: n / 2, needs=["num_frames"])
    got = {r.seq: (r.half, r.mota) for r in m.compute(log, ["half", "mota"]).collect()}
    assert got["s"] == (1.0, 0.5) and got["t"][0] == 0.5 and got["OVERALL"] == (1.5, 0.0)
    assert m.names()[-1] == "half" and m.listed(spark).filter("name = 'mota'").head().needs[0] == "num_misses"
    with pytest.raises(KeyError):
        m.register("bad", lambda x: x, needs=["unknown"])


def test_merge_trees(spark):
    merges = spark.createDataFrame([(10, 1, 2), (11, 10, 3), (20, 4, 5)], "node long, left long, right long")
    assert {r.node for r in links.tree_heads(merges).collect()} == {11, 20}
    assert {(r.head, r.leaf) for r in links.tree_leaves(merges).collect()} == {(11, 1), (11, 2), (11, 3), (20, 4), (20, 5)}


def test_components_with_self_links_and_strings(spark):
    e = spark.createDataFrame([("b", "c"), ("c", "d"), ("x", "x"), ("q", "a"), (None, "z")], "a string, b string")
    assert {r.node: r.root for r in links.components(e).collect()} == {"b": "b", "c": "b", "d": "b", "x": "x", "a": "a", "q": "a"}


def test_fill_curve(spark):
    rows = [("s", 1, f, float(f * f), 5.0 + f, 10.0, 10.0) for f in range(30) if not 10 <= f < 15]
    df = spark.createDataFrame(rows, "seq string, track_id long, frame long, x double, y double, w double, h double")
    got = {r.frame: r for r in tracks.fill_curve(df).collect()}
    assert len(got) == 30 and all(abs(got[f].x - f * f) < 1e-6 and abs(got[f].y - 5 - f) < 1e-6 and got[f].filled for f in range(10, 15))
    assert tracks.fill_curve(df, max_gap=3).count() == 25


def test_label_spreading_reaches_all(spark):
    e = spark.createDataFrame([(i, i + 1, 1.0) for i in range(12)] + [(50, 51, 1.0)], "a long, b long, w double")
    got = {r.id: r.label for r in clustering.spread_labels(e, spark.createDataFrame([(0, "l"), (12, "r")], "id long, label string"), rounds=100, tol=1e-4).collect()}
    assert [got[i] for i in (1, 3, 5)] == ["l"] * 3 and [got[i] for i in (7, 9, 11)] == ["r"] * 3 and got[50] is None and len(got) == 15


def test_shortest_paths_against_plain(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(30), rng.randrange(30), rng.randrange(1, 9)) for _ in range(80)]
    got = {(r.start, r.node): r.distance for r in sparse.shortest_paths(spark.createDataFrame(edges, "a long, b long, w long"), spark.createDataFrame([(0,), (7,)], "start long")).collect()}
    for s in (0, 7):
        d = {s: 0}
        for _ in range(30):
            for a, b, w in edges:
                if a in d and d[a] + w < d.get(b, 10**9):
                    d[b] = d[a] + w
        assert {n: x for (t, n), x in got.items() if t == s} == d


def test_imputers(spark):
    v = spark.createDataFrame([(1, [1.0, None]), (2, [1.1, 5.0]), (3, [0.9, 7.0]), (4, [9.0, 100.0]), (5, [None, None])], "id long, v array<double>")
    got = {(r.id, r.i): r.x for r in neighbors.impute_nearest(v, v, k=2).collect()}
    assert got == {(1, 1): 6.0}
    df = spark.createDataFrame([(float(i), 3.0 * i + 1 if i % 3 else None) for i in range(12)], "a double, b double")
    assert all(abs(r.b - 3 * r.a - 1) < 1e-9 for r in preprocessing.impute_iterative(df, ["a", "b"]).collect())


def test_isotonic_and_information(spark):
    df = spark.createDataFrame([(float(x), float(y)) for x, y in ((1, 1), (2, 3), (3, 2), (4, 4))], "x double, y double")
    assert [r.fitted for r in regression.isotonic(df, "x", "y").orderBy("x").collect()] == [1.0, 2.5, 2.5, 4.0]
    assert regression.increasing(df, "x", "y") and not regression.increasing(df.withColumn("y", -F.col("y")), "x", "y")
    same = spark.createDataFrame([(i % 3, i % 3) for i in range(30)], "a int, b int")
    assert abs(clustering_metrics.adjusted_information(same) - 1) < 1e-9
    mixed = spark.createDataFrame([(i % 2, i // 2 % 2) for i in range(400)], "a int, b int")
    assert abs(clustering_metrics.adjusted_information(mixed)) < 0.01


def test_made_tables(spark):
    d = synthetic.hastie(spark, 3000)
    assert 0.45 < d.agg(F.avg((F.col("y") > 0).cast("double"))).head()[0] < 0.55
    assert abs(d.agg(F.avg("x0")).head()[0]) < 0.1 and abs(d.agg(F.stddev("x3")).head()[0] - 1) < 0.05
    m = {(r.i, r.j): r.x for r in synthetic.positive_definite(spark, 12, 0.5).collect()}
    a = np.array([[m[i, j] for j in range(12)] for i in range(12)])
    assert np.allclose(a, a.T) and np.linalg.eigvalsh(a).min() > 0


def test_lines_resist_outliers(spark):
    rng = random.Random(2)
    rows = [(i, float(i % 50), 3.0 * (i % 50) + 7 + rng.gauss(0, 0.01) if i % 5 else rng.uniform(-500, 500)) for i in range(800)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    m = robust.median_line(df, "x", "y", "id").head()
    assert abs(m.slope - 3) < 0.1 and abs(m.intercept - 7) < 3
    c = robust.consensus_line(df, "x", "y", "id", within=1.0).head()
    assert abs(c.slope - 3) < 0.01 and abs(c.intercept - 7) < 0.1 and 620 <= c.n < 660
    assert robust.consensus_line(df.limit(1), "x", "y", "id", within=1.0).head().n == 1


def test_kernel_models_are_exact_with_all_landmarks(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 2))
    y = np.sin(x[:, 0]) + x[:, 1] ** 2
    df = spark.createDataFrame([(i, [float(c) for c in v], float(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))], "id long, v array<double>, y double")
    z = kernel_models.landmarks(df, 100)
    k = kernel_models.gaussian(x, x, 0.5)
    ridge = {r.id: r.p for r in df.select("id", kernel_models.kernel_ridge(df, z, gamma=0.5, alpha=0.1).predict(F.col("v")).alias("p")).collect()}
    assert np.allclose([ridge[i] for i in range(60)], k @ np.linalg.solve(k + 0.1 * np.eye(60), y), atol=1e-5)
    g = kernel_models.gaussian_process(df, z, gamma=0.5, noise=0.1)
    got = {r.id: (r.m, r.s) for r in df.select("id", g.predict(F.col("v")).alias("m"), g.variance(F.col("v")).alias("s")).collect()}
    want = np.diag(k - k @ np.linalg.solve(k + 0.1 * np.eye(60), k))
    assert np.allclose([got[i][0] for i in range(60)], k @ np.linalg.solve(k + 0.1 * np.eye(60), y), atol=1e-4) and np.allclose([got[i][1] for i in range(60)], want, atol=1e-4)
    c = np.eye(60) - 1 / 60
    values = np.linalg.eigvalsh(c @ k @ c)[::-1][:3] / 60
    assert np.allclose(kernel_models.kernel_components(df, z, 3, gamma=0.5)[0], values, atol=1e-8)


def test_assignment_solvers_agree():
    rng = np.random.default_rng(5)
    for n, m in ((1, 1), (4, 4), (6, 9), (9, 5), (20, 20)):
        cost = rng.uniform(0, 10, (n, m))
        cost[rng.random((n, m)) < 0.2] = np.nan
        (a, b), (c, d) = lap.solve(cost), lap.solver("auction")(cost)
        assert len(a) == len(c) == len(set(c)) == len(set(d)) and abs(cost[a, b].sum() - cost[c, d].sum()) < 1e-4
    assert lap.padded(np.ones((2, 3))).shape == (3, 3) and lap.integer_scale(np.array([[0.5, 2.0]]), 1 << 10) == 512.0


def test_vectorized_and_edits(spark):
    df = spark.createDataFrame([(1, {"a": "2.5", "b": "x"}), (2, {"a": "0", "b": None})], "id long, m map<string,string>")
    assert {(r.id, r.feature, r.x) for r in text.vectorized(df, "id", "m").collect()} == {(1, "a", 2.5), (1, "b=x", 1.0)}
    t = spark.createDataFrame([("s", 1, 7, 1.0, 1.0, 1.0, 1.0), ("s", 2, 7, 2.0, 2.0, 2.0, 2.0)], "seq string, frame long, id long, x double, y double, w double, h double")
    edit = spark.createDataFrame([("s", 1, 7, 9.0, None, 9.0, 9.0), ("s", 8, 8, 0.0, 0.0, 0.0, 0.0)], t.schema)
    assert sorted(map(tuple, tracks.replace_boxes(t, edit).collect())) == [("s", 1, 7, 9.0, None, 9.0, 9.0), ("s", 2, 7, 2.0, 2.0, 2.0, 2.0)]
    assert [r.frame for r in tracks.delete_boxes(t, edit).collect()] == [2]


def test_moments_go_on(spark, table):
    parts = [gram.moments(table.filter(F.col("fold") == k), ["x1", "x2"], "y") for k in range(4)]
    m = parts[0]
    for p in parts[1:]:
        m = gram.merged(m, p)
    whole = gram.moments(table, ["x1", "x2"], "y")
    assert m.n == whole.n and np.allclose(m.mean, whole.mean) and np.allclose(m.c, whole.c)

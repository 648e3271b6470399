"""Queries that must take all of their tables."""

import numpy as np
import pytest

from trailmill.operators import events, neighbors
from trailmill.plans import registry, registry_ml, registry_more, registry_rest


@pytest.fixture
def embeddings(spark, tmp_path):
    """24 vectors, one of them with an id divisible by 20."""
    x = np.random.default_rng(5).normal(size=(24, 4)).astype(np.float32)
    spark.createDataFrame([(i + 1, r.tolist(), i % 2) for i, r in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path), x.astype(float)


@pytest.mark.parametrize("query,a,b", [(registry_more.kernels, "id", "other"), (registry_ml.pairwise_distances, "a", "b")])
def test_every_pair_of_vectors(spark, embeddings, query, a, b):
    sf, x = embeddings
    got = query(spark, sf).toPandas()
    assert sorted(zip(got[a], got[b], strict=True)) == [(i, j) for i in range(1, 25) for j in range(1, 25) if i != j]
    u, v = x[got[a] - 1], x[got[b] - 1]
    if query is registry_more.kernels:
        assert np.allclose(got["linear"], (u * v).sum(axis=1), atol=1e-5)
    else:
        assert np.allclose(got["squared"], ((u - v) ** 2).sum(axis=1), atol=1e-5)


def test_bandwidth_of_every_vector(spark, embeddings):
    sf, x = embeddings
    d = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), axis=1)
    assert np.isclose(registry_rest.estimate_bandwidth(spark, sf).head()[0], d[:, 5].mean(), atol=1e-6)


def test_trustworthiness_of_every_vector(spark, embeddings):
    sf, x = embeddings
    far = lambda y: np.argsort(np.where(np.eye(24, dtype=bool), np.inf, ((y[:, None] - y[None]) ** 2).sum(axis=2)), axis=1)
    rank = np.argsort(far(x), axis=1) + 1
    off = sum(max(rank[i, j] - 5, 0) for i, near in enumerate(far(x[:, :2])[:, :5]) for j in near)
    assert np.isclose(registry_rest.trustworthiness(spark, sf).head()[0], 1 - 2 / (24 * 5 * (48 - 16)) * off, atol=1e-6)


def tracked(spark, path, query, ids):
    """Clusters of one event a frame; boxes of ids n apart are about 2n apart."""
    spark.createDataFrame([(i, 0, "s", k, 0.0) for k, i in enumerate(ids)], "event_id long, user_id long, event_type string, ts long, value double").write.parquet(f"{path}/events.parquet")
    found = {}
    for r in query(spark, str(path)).collect():
        found.setdefault(r.track_id, set()).add(r.id)
    return sorted(map(sorted, found.values()))


def test_complete_linkage_takes_all_pairs_up_to_the_threshold(spark, tmp_path):
    assert tracked(spark, tmp_path, registry.agglomerate_complete, [1, 15, 29]) == [[1, 15, 29]]


@pytest.mark.parametrize("query,want", [("single", [[1, 15, 36]]), ("average", [[1, 15, 36]]), ("complete", [[1, 15], [36]])])
def test_linkages_differ(spark, tmp_path, query, want):
    assert tracked(spark, tmp_path, registry.QUERIES[f"agglomerate_{query}"], [1, 15, 36]) == want


def test_cells_deal_each_row_once(spark, embeddings, monkeypatch):
    sf, _ = embeddings
    monkeypatch.setattr(neighbors, "_CELL", 16)
    df = spark.read.parquet(f"{sf}/embeddings.parquet").selectExpr("vec_id AS id", "CAST(embedding AS array<double>) AS v")
    met = neighbors.against_all(df, df, "dot")
    assert "Generate" not in met._jdf.queryExecution().toString()
    assert met.count() == 24 * 23


def test_summary_in_the_tasks_that_make_the_events(spark, monkeypatch):
    monkeypatch.setattr(events, "_FRAMES", 3)
    rng = np.random.default_rng(8)
    rows = []
    for seq in ("a", "b", "c"):
        for f in range(25):
            o, h = ([int(i) for i in range(5) if rng.random() < p] for p in ((0.0 if seq == "c" else 0.8), 0.6))
            rows.append((seq, f, o, [i + 10 for i in h], [(i, j + 10, float(rng.random())) for i in o for j in h if i == j or rng.random() < 0.3]))
    frames = spark.createDataFrame(rows, events.FRAMES)
    got, want = (d.toPandas().sort_values("seq", ignore_index=True) for d in (events.summary_of(frames), events.mot_summary(events.event_log(frames).cache())))
    assert (got.set_index("seq").loc["OVERALL", ["num_fragmentations", "num_switches", "idfp", "mostly_tracked"]] > 0).all()
    assert sorted(got.columns) == sorted(want.columns)
    for c in want.columns:
        assert got[c].equals(want[c]) if c == "seq" else np.allclose(got[c].astype(float), want[c].astype(float), equal_nan=True), c


def test_summary_keeps_no_events(spark):
    assert "InMemoryRelation" not in registry.mot_summary(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()

"""The tree of boxes, spanning forests and clustering features against plain versions."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmill.operators import birch, space_tree, spanning

KIND = "id long, v array<double>"


def clouds(n=900, dim=3, seed=1):
    """Clouds of points on a coarse grid (many ties), a third of them one and the same."""
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 40, (n, dim)) + rng.choice([0, 300], (n, 1))
    x[: n // 3] = x[0]
    return [(int(i), [float(c) for c in r]) for i, r in zip(rng.permutation(n), x, strict=True)]


def plain_nearest(queries, rows, k):
    out = set()
    for q, v in queries:
        d = sorted((round(float(np.linalg.norm(np.subtract(v, w))), 9), i) for i, w in rows if i != q)
        out |= {(q, i, r, x) for r, (x, i) in enumerate(d[:k], 1)}
    return out


@pytest.mark.parametrize(("leaves", "block", "group", "chunk"), [(256, 256, 32_768, 1024), (8, 16, 50, 7), (1, 1000, 10, 1)])
def test_tree_nearest(spark, leaves, block, group, chunk):
    rows = clouds()
    df = spark.createDataFrame([*rows, (5000, None)], KIND).repartition(3)
    tree = space_tree.SpaceTree(df, leaves=leaves, block=block, group=group)
    queries = [r for r in rows if r[0] % 30 == 0]
    q = df.filter("id % 30 = 0 OR v IS NULL")
    got = {(r.query_id, r.id, r.rank, round(r.distance, 9)) for r in tree.nearest(q, k=4, chunk=chunk).collect()}
    assert got == plain_nearest(queries, rows, 4)
    near = Counter((r.query_id, r.id) for r in tree.nearest(q, radius=9.0, chunk=chunk).collect())
    assert near == Counter((a, b) for a, v in queries for b, w in rows if a != b and np.linalg.norm(np.subtract(v, w)) <= 9)
    assert sum(r.n for r in tree.blocks.collect()) == len(rows)


def test_tree_few_and_none(spark):
    df = spark.createDataFrame(clouds(3), KIND)
    tree = space_tree.SpaceTree(df)
    assert tree.nearest(df, k=5).count() == 6 and tree.nearest(df, k=5, exclude_self=False).count() == 9
    empty = space_tree.SpaceTree(df.filter("false"))
    assert empty.nearest(df, k=2).collect() == [] == empty.nearest(df, radius=1.0).collect()
    with pytest.raises(ValueError, match="k or radius"):
        tree.nearest(df)


def test_tree_leaves_most_blocks_out(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, [float(c) for c in x]) for i, x in enumerate(rng.normal(size=(6000, 3)))], KIND)
    share = space_tree.SpaceTree(df, leaves=32, block=64).share_met(df.filter("id % 50 = 0"), 5)
    print("share of blocks met", share)
    assert share < 0.2


def test_boxes_are_no_farther_than_rows():
    rng = np.random.default_rng(3)
    x, q = rng.normal(size=(50, 4)), rng.normal(size=(20, 4)) * 3
    d = space_tree.box_distance(q, x.min(axis=0)[None], x.max(axis=0)[None])[:, 0]
    assert (d <= np.linalg.norm(q[:, None] - x[None], axis=2).min(axis=1) + 1e-12).all()


def plain_forest(edges):
    root, out = {}, set()

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for w, a, b in sorted((w, min(a, b), max(a, b)) for a, b, w in edges if a != b and w is not None):
        x, y = find(a), find(b)
        if x != y:
            root[x] = y
            out.add((a, b, w))
    return out


def test_spanning_forest(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(80), rng.randrange(80), float(rng.randrange(9))) for _ in range(170)] + [(100, i, 1.0) for i in range(101, 160)] + [(1, 1, 0.0), (200, 201, None), (3, 4, 2.0), (4, 3, 1.0)]
    df = spark.createDataFrame(edges, "a long, b long, w double")
    forest = spanning.spanning_forest(df)
    assert {tuple(r) for r in forest.collect()} == plain_forest(edges)
    nodes = spark.range(210)
    for h in (0.0, 3.0):
        got = {r.id: r.cluster for r in spanning.clusters_at(nodes, forest, [h]).collect()}
        near = {i: {i} for i in range(210)}
        for a, b, w in edges:
            if w is not None and w <= h and near[a] is not near[b]:
                near[a] |= near[b]
                for x in near[a]:
                    near[x] = near[a]
        assert got == {i: min(near[i]) for i in range(210)}
    assert spanning.spanning_forest(df.filter("false")).collect() == []
    assert sum(r.merges for r in spanning.heights(forest).collect()) == forest.count()


def test_features_bound_and_totals(spark):
    rng = np.random.default_rng(7)
    x = np.round(np.concatenate([rng.normal(c, 1, (400, 2)) for c in (0, 20, 40)] + [np.full((300, 2), 5.0)]), 3)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(9999, None)], KIND).repartition(11)
    for threshold, most in ((0.5, 1000), (0.01, 40)):
        e = birch.features(df, threshold=threshold, most=most, fan=3).collect()
        n, s, q = np.array([r.n for r in e]), np.array([r.s for r in e]), np.array([r.q for r in e])
        assert len(e) <= most and n.sum() == len(x) and np.allclose(s.sum(axis=0), x.sum(axis=0)) and np.isclose(q.sum(), (x * x).sum())
        radius = np.sqrt(np.maximum(q / n - ((s / n[:, None]) ** 2).sum(axis=1), 0))
        assert (radius <= [r.threshold + 1e-6 for r in e]).all() and (threshold < 0.1 or {r.threshold for r in e} == {threshold})
    got = birch.assign(df, birch.features(df, threshold=3.0)).collect()
    assert len(got) == len(x) and {tuple(sorted({r.entry for r in got if r.id // 400 == c})) for c in range(3)} and len({r.entry for r in got}) < 12
    assert birch.features(df.filter("false"), threshold=1.0).collect() == []


def test_features_of_a_stream_count_each_batch_once(spark):
    df = spark.createDataFrame(clouds(300), KIND)
    parts = df.randomSplit([1.0, 1.0, 1.0], seed=3)
    state = birch.StreamedFeatures("stream-test", threshold=10.0, most=60)
    for number in (0, 1, 1, 2):  # the second batch fails after it has been written and runs again
        state.update(parts[number], number)
    e = state.entries(df, 2).collect()
    assert sum(r.n for r in e) == 300 and len(e) <= 60
    want = df.select(F.sum(F.col("v")[0]), F.sum(F.col("v")[1])).head()
    assert np.allclose(np.sum([r.s for r in e], axis=0)[:2], list(want))

"""Assignment, events, suppression, filtering and tracking against definitions and golden values."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmill.operators import agglomerate, events, kalman, lap, links, nms, online, pairs, tracks
from trailmill.streaming import online as streaming

NAN = float("nan")


def brute(cost):
    n, m = cost.shape
    best = (0, 0.0)
    for k in range(min(n, m), 0, -1):
        for r in itertools.combinations(range(n), k):
            for c in itertools.permutations(range(m), k):
                d = cost[list(r), list(c)]
                if np.isfinite(d).all() and (best[0] < k or d.sum() < best[1] - 1e-12):
                    best = (k, d.sum())
        if best[0]:
            return best
    return best


@pytest.mark.parametrize("seed", range(30))
def test_lap(seed):
    rng = np.random.default_rng(seed)
    cost = rng.integers(-9, 10, rng.integers(1, 6, 2)).astype(float)
    cost[rng.random(cost.shape) < 0.3] = NAN
    i, j = lap.solve(cost)
    assert len(set(i)) == len(i) and len(set(j)) == len(j) and np.isfinite(cost[i, j]).all()
    k, total = brute(cost)
    assert len(i) == k and cost[i, j].sum() == pytest.approx(total)


def test_lap_edges():
    assert lap.solve(np.zeros((0, 3)))[0].size == 0
    assert lap.solve(np.full((2, 2), NAN))[0].size == 0
    assert [x.tolist() for x in lap.solve(np.array([[6.0, 9, 1], [10, 3, 2], [8, 7, 4]]))] == [[0, 1, 2], [2, 1, 0]]


def frames_df(spark, frames):
    rows = [("s", f, o, h, [(a, b, float(d[i][j])) for i, a in enumerate(o) for j, b in enumerate(h) if d[i][j] is not None] if o and h else []) for f, o, h, d in frames]
    return spark.createDataFrame(rows, events.FRAMES)


def kinds(log):
    return [(r.frame, r.type, r.oid, r.hid, r.d) for r in sorted(log.collect(), key=lambda r: (r.frame, r.event)) if r.type != "RAW"]


SCRIPT = [(0, [], [1, 2], []), (1, [1, 2], [], []), (2, [1, 2], [1, 2], [[1, 0.5], [0.3, 1]]), (3, [1, 2], [1, 2], [[0.2, None], [None, 0.1]]), (4, [1, 2], [1, 2], [[5, 1], [1, 5]]), (5, [], [], [])]


def test_event_log(spark):
    log = events.event_log(frames_df(spark, SCRIPT)).cache()
    assert kinds(log) == [
        (0, "FP", None, 1, None),
        (0, "FP", None, 2, None),
        (1, "MISS", 1, None, None),
        (1, "MISS", 2, None, None),
        (2, "MATCH", 1, 2, 0.5),
        (2, "MATCH", 2, 1, 0.3),
        (3, "TRANSFER", 1, 1, 0.2),
        (3, "SWITCH", 1, 1, 0.2),
        (3, "TRANSFER", 2, 2, 0.1),
        (3, "SWITCH", 2, 2, 0.1),
        (4, "MATCH", 1, 1, 5.0),
        (4, "MATCH", 2, 2, 5.0),
    ]
    m = events.mot_summary(log, overall=False).head()
    assert m.mota == pytest.approx(0.25) and m.motp == pytest.approx(11.1 / 6) and m.num_frames == 6


def test_max_switch_time(spark):
    script = [(1, [1, 2], [1, 2], [[0, 1], [1, 0]]), (2, [1, 2], [1, 2], [[None, 0], [0, None]])]
    n = lambda frames: sum(k[1] == "SWITCH" for k in kinds(events.event_log(frames_df(spark, frames), max_switch_time=1)))
    assert n(script) == 2
    assert n([script[0], (5, *script[1][1:])]) == 0


def test_fragmentation_counts(spark):
    script = [(f, [1], [1] if hit else [], [[0.1]] if hit else []) for f, hit in enumerate([0, 1, 1, 0, 0, 1, 0, 1, 0])]
    assert events.fragmentations(events.event_log(frames_df(spark, script))).head().num_fragmentations == 2


def test_one_sided_frames(spark):
    g = spark.createDataFrame([("s", 1, 1), ("s", 2, 1)], "seq string, frame long, id long")
    h = spark.createDataFrame([("s", 1, 7), ("s", 3, 7)], "seq string, frame long, id long")
    p = spark.createDataFrame([("s", 1, 1, 7, 0.1)], "seq string, frame long, a long, b long, distance double")
    strict = events.event_counts(events.event_log(events.frames_of(g, h, p))).head()
    loose = events.event_counts(events.event_log(events.frames_of(g, h, p, strict=False))).head()
    assert (strict.num_misses, strict.num_false_positives, loose.num_misses, loose.num_false_positives, loose.num_frames) == (1, 1, 0, 0, 3)


def test_event_stream_equals_batch(spark, tmp_path):
    df = frames_df(spark, SCRIPT)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in (0, 1):
        df.filter(F.floor(F.col("frame") / 3) == k).coalesce(1).write.mode("append").parquet(src)
    q = streaming.event_stream(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).start(out)
    q.processAllAvailable()
    q.stop()
    assert kinds(spark.read.schema(events.EVENTS).parquet(out)) == kinds(events.event_log(df))


def test_suppression():
    x = np.array([0.0, 1, 30, 2])
    one = np.full(4, 9.0)
    assert nms.keep_greedy(x, x * 0, one, one, np.array([1, 0, 2, 3]), 0.5).tolist() == [1, 2]
    assert nms.keep_greedy(x, x * 0, one, one, np.array([0, 2, 1, 3]), 0.95).tolist() == [0, 2, 1, 3]


def test_suppression_in_frames(spark):
    det = spark.createDataFrame([(1, 1, 0.9, 0.0, 0.0, 9.0, 9.0), (1, 2, 0.8, 1.0, 0.0, 9.0, 9.0), (2, 3, 0.1, 0.0, 0.0, 9.0, 9.0)], "frame long, id long, score double, x double, y double, w double, h double")
    got = {r.id: r.pick for r in nms.suppress(det, max_overlap=0.5).collect()}
    assert got == {1: 0, 2: None, 3: 0}
    flags = {r.id: r.fp_flag for r in nms.flag_ambiguous(det, max_overlap=0.5, min_score=0.3).collect()}
    assert flags == {1: None, 2: "nms", 3: "score"}


def test_kalman():
    box = np.array([10.0, 20, 0.5, 40])
    mean, cov = kalman.initiate(box)
    assert mean.tolist() == [10, 20, 0.5, 40, 0, 0, 0, 0] and cov[0, 0] == pytest.approx(16) and cov[4, 4] == pytest.approx(6.25)
    for k in range(1, 30):
        mean, cov = kalman.predict(mean, cov)
        mean, cov = kalman.update(mean, cov, box + [2 * k, 0, 0, 0])
    assert mean[4] == pytest.approx(2, abs=0.05) and np.allclose(cov, cov.T)
    near, far = kalman.gating_distance(*kalman.predict(mean, cov), np.array([[70.0, 20, 0.5, 40], [200, 20, 0.5, 40]]))
    assert near < kalman.CHI2_95[4] < far
    assert len(kalman.path_distances(np.array([3, 1, 2]), np.tile(box, (3, 1)))) == 2


def walkers(spark, frames=25, features=True):
    rng = random.Random(4)
    rows = []
    for f in range(1, frames + 1):
        for i in range(3):
            if (f, i) in ((9, 1), (10, 1)):
                continue
            feat = [1.0 if k == i else 0.02 * rng.random() for k in range(3)]
            rows.append(("s", f, len(rows), 100.0 * i + 3 * f, 50.0 + 40 * i, 20.0, 40.0, i, feat))
    df = spark.createDataFrame(rows, "seq string, frame long, id long, x double, y double, w double, h double, who int, feature array<float>")
    return df if features else df.drop("feature")


@pytest.mark.parametrize("features", [True, False])
def test_online(spark, features):
    det = walkers(spark, features=features)
    got = online.track_online(det.drop("who")).collect()
    numbers = {}
    for r in got:
        numbers.setdefault(round((r.y - 50) / 40), set()).add(r.track_id)
    assert all(len(v) == 1 for v in numbers.values()) if features else len(numbers) == 3
    assert min(r.frame for r in got) == 3


def test_online_stream_equals_batch(spark, tmp_path):
    det = walkers(spark)
    batch = online.track_online(det.drop("who")).collect()
    frames = det.groupBy("seq", "frame").agg(F.sort_array(F.collect_list(F.struct("id", "x", "y", "w", "h", "feature"))).alias("boxes"))
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(3):
        frames.filter((F.col("frame") % 3 == k) & (F.col("frame") < 7) | (F.floor(F.col("frame") / 7) == k + 1)).coalesce(1).write.mode("append").parquet(src)
    q = streaming.track_stream(spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(src), delay=3).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).start(out)
    q.processAllAvailable()
    q.stop()
    got = {(r.frame, r.track_id) for r in spark.read.schema(online.TRACKS).parquet(out).collect()}
    assert got and got <= {(r.frame, r.track_id) for r in batch} | {(f, t) for f in range(30) for t in range(1, 20)}
    assert max(f for f, _ in got) >= 20


def slow_agglomeration(frames, edges, threshold, linkage):
    d = {}
    clusters = {i: [i] for i in range(len(frames))}
    for a, b, w in edges:
        if frames[a] != frames[b]:
            d[frozenset((a, b))] = w
    nxt = len(frames)
    while True:
        ok = [(w, min(k), max(k)) for k, w in d.items() if not {frames[i] for i in clusters[min(k)]} & {frames[i] for i in clusters[max(k)]} and w <= threshold]
        if not ok:
            return sorted(sorted(c) for c in clusters.values())
        w, a, b = min(ok)
        na, nb = len(clusters[a]), len(clusters[b])
        new = {c: agglomerate.LINKAGES[linkage](d[frozenset((a, c))], d[frozenset((b, c))], na, nb) for c in clusters if c not in (a, b) and frozenset((a, c)) in d and frozenset((b, c)) in d}
        d = {k: v for k, v in d.items() if not k & {a, b}}
        clusters[nxt] = clusters.pop(a) + clusters.pop(b)
        d |= {frozenset((nxt, c)): v for c, v in new.items()}
        nxt += 1


@pytest.mark.parametrize("linkage", ["complete", "average", "single"])
@pytest.mark.parametrize("seed", range(6))
def test_agglomeration(linkage, seed):
    rng = random.Random(seed)
    frames = [rng.randrange(6) for _ in range(16)]
    edges = [(a, b, rng.random()) for a in range(16) for b in range(a) if rng.random() < 0.8]
    c = agglomerate.Clusters([frozenset([f]) for f in frames])
    agglomerate.merge_nearest(c, edges, 0.7, linkage)
    assert sorted(c.members[k] for k in c.live) == slow_agglomeration(frames, edges, 0.7, linkage)


def test_offline(spark):
    det = walkers(spark)
    team = [agglomerate.Expert(0.1, "complete", frames_a_window=5), agglomerate.Expert(0.2, "single", frames_a_window=12, max_gap=5.0)]
    got = {r.id: r.track_id for r in agglomerate.track_offline(det.drop("who"), team).collect()}
    who = {}
    for r in det.collect():
        who.setdefault(r.who, set()).add(got[r.id])
    assert all(len(v) == 1 for v in who.values()) and len(set.union(*who.values())) == 3


def test_reclaim(spark):
    det = walkers(spark).withColumn("fp_flag", F.when(F.col("frame") == 5, "nms"))
    base = [agglomerate.Expert(0.1, "complete", frames_a_window=30)]
    without = agglomerate.track_offline(det.drop("who"), base).count()
    got = agglomerate.track_offline(det.drop("who"), [*base, agglomerate.Expert(0.1, "single", frames_a_window=30, reclaim=True)]).count()
    assert got == without + 3 == det.count()


def test_windows_and_gaps():
    assert agglomerate.divide(range(1, 11), frames_a_window=4) == [(1, 4), (5, 8), (9, 10)]
    assert len(agglomerate.divide(list(range(100)) * 50, detections_a_window=1000)) == 5
    assert agglomerate.temporal_gap([1, 2], [5]) == 3 and agglomerate.temporal_gap([1, 4], [2]) == 0 and agglomerate.temporal_gap([1], [1]) == float("inf")


def test_links(spark):
    l1 = spark.createDataFrame([(1, 2), (2, 3), (5, None)], "a long, b long")
    l2 = spark.createDataFrame([(1, 2), (3, 4)], "a long, b long")
    assert {tuple(r) for r in links.merge(l1, l2).collect()} == {(1, 2), (2, 3), (3, 4), (5, None)}
    assert {(r.node, r.head, r.place) for r in links.chains(links.merge(l1, l2)).collect()} >= {(1, 1, 0), (2, 1, 1), (3, 1, 2), (4, 1, 3)}
    with pytest.raises(Exception, match="contradict"):
        links.merge(l1, spark.createDataFrame([(1, 9)], "a long, b long")).collect()
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {r.node: r.root for r in links.components(e).collect()} == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_gap_links(spark):
    d = spark.createDataFrame([("s", 1, 1, 0.0), ("s", 2, 2, 1.0), ("s", 4, 3, 2.0), ("s", 2, 4, 90.0)], "seq string, frame long, id long, x double").withColumns({"y": F.lit(0.0), "w": F.lit(5.0), "h": F.lit(5.0)})
    got = {(r.a, r.b, r.gap) for r in pairs.gap_links(d, max_gap=2, max_distance=20.0).collect()}
    assert got == {(1, 2, 1), (2, 3, 2)}


def test_gap_filling(spark):
    d = spark.createDataFrame([("s", 1, 1, 0.0), ("s", 1, 2, 1.0), ("s", 1, 4, 5.0), ("s", 2, 1, 0.0), ("s", 2, 9, 9.0)], "seq string, track_id long, frame long, x double").withColumns({c: F.lit(1.0) for c in "ywh"})
    got = {(r.track_id, r.frame, r.x) for r in tracks.fill_linear(d).filter("filled").collect()}
    assert got == {(1, 3, 3.0)}
    assert tracks.clip_filled(d, F.lit(5.5), F.lit(50.0)).count() == 5

"""Sequences tracked side by side give what each gives alone."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trailmill.operators import agglomerate, frames, kalman, lap, online

DET = "seq string, frame long, id long, x double, y double, w double, h double"


def crossing(sequences=30, length=45, things=5, seed=2):
    """Rows of DET: things that cross and hide each other on a grid of whole numbers, so that ties come up; no frames 20 to 24, and one sequence with a long hole."""
    rng = np.random.default_rng(seed)
    out = []
    for s in range(sequences):
        for i in range(things):
            x, y = rng.integers(0, 60, 2)
            for f in range(length):
                if rng.random() < 0.75 and not 20 <= f < 25:
                    at = 1000 * s + f + (5000 if s == 3 and f > 30 else 0)
                    out.append((None if s == 7 else str(s), at, i, float(x + f // 2 + rng.integers(0, 3)), float(y + rng.integers(0, 3)), 20.0, 40.0))
    return out


def one_by_one(rows, **how):
    by = {}
    for r in rows:
        by.setdefault(r[0], {}).setdefault(r[1], []).append(r[2:])
    out = []
    for s, found in by.items():
        tracker = online.Tracker(**how)
        for f in range(min(found), max(found) + 1):
            boxes = np.array([b[1:] for b in sorted(found.get(f, []))]).reshape(-1, 4)
            out += [((s or "", f, n), b) for n, b in tracker.step(boxes, np.zeros((len(boxes), 0)))]
    return dict(out)


@pytest.mark.parametrize("how", [{}, {"max_age": 3, "n_init": 2, "max_iou_distance": 0.5}])
def test_online_in_step(spark, monkeypatch, how):
    monkeypatch.setattr(frames, "_ROWS", 1500)
    rows = crossing()
    want = one_by_one(rows, **how)
    got = {(r.seq or "", r.frame, r.track_id): (r.x, r.y, r.w, r.h) for r in online.track_online(spark.createDataFrame(rows, DET).repartition(3), **how).collect()}
    assert len(want) > 3000 and got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k], rtol=0, atol=1e-9) for k in want)


def test_a_call_takes_many_sequences(spark, monkeypatch):
    rows = [(str(s), 40 * s + f, i, 30.0 * i, 5.0, 10.0, 10.0) for s in range(300) for f in range(4) for i in range(2)]
    det = spark.createDataFrame(rows, DET)
    piece = frames.per_sequences(det, lambda p: p.groupby("seq").size().describe()[["count"]].to_frame("n").reset_index(drop=True), "n double")
    assert piece.count() <= 8 and piece.groupBy().sum("n").head()[0] == 300
    monkeypatch.setattr(frames, "_ROWS", 50)
    piece = frames.per_sequences(det.repartition(1), lambda p: p.groupby("seq").size().reset_index(name="n"), "seq string, n long")
    assert sorted((r.seq, r.n) for r in piece.collect()) == sorted((str(s), 8) for s in range(300))
    assert online.track_online(det).count() == 300 * 2 * 2


def test_assignments_together():
    rng = np.random.default_rng(5)
    rows, cols = rng.integers(1, 8, 400), rng.integers(1, 9, 400)
    cost = np.full((400, 7, 8), np.nan)
    for p in range(400):
        cost[p, : rows[p], : cols[p]] = np.minimum(rng.integers(0, 12, (rows[p], cols[p])) / 10, 0.70001)
    got = lap.solve_many(cost, rows, cols)
    for p in range(400):
        want = np.full(7, -1)
        i, j = lap.solve(cost[p, : rows[p], : cols[p]])
        want[i] = j
        assert (got[p] == want).all()


def test_filters_together():
    rng = np.random.default_rng(6)
    sizes = rng.integers(2, 12, 50)
    paths = [(np.sort(rng.choice(40, n, replace=False)), np.column_stack([rng.uniform(0, 100, (n, 2)), rng.uniform(0.5, 2, n), rng.uniform(10, 35, n)])) for n in sizes]
    got = kalman.many_path_distances(np.concatenate([f for f, _ in paths]), np.concatenate([b for _, b in paths]), sizes)
    want = np.concatenate([[0, *kalman.path_distances(f, b, skip_empty=False)] for f, b in paths])
    assert np.allclose(got, want, rtol=1e-9, atol=0)


TEAMS = {
    "query": [agglomerate.Expert(30.0, "complete", frames_a_window=10), agglomerate.Expert(45.0, "single", frames_a_window=20, max_kalman=9.5)],
    "average": [agglomerate.Expert(14.5, "average", detections_a_window=40, max_kalman=4.0, kalman_linkage="complete"), agglomerate.Expert(20.5, "average", frames_a_window=30, max_kalman=2.0, kalman_linkage="single")],
    "single": [agglomerate.Expert(12.0, "single", frames_a_window=7), agglomerate.Expert(60.0, "complete", frames_a_window=200, max_kalman=9.5)],
}


@pytest.mark.parametrize("cells", [(3_000_000, 100_000), (5_000, 1)])
@pytest.mark.parametrize("team", TEAMS)
def test_offline_in_step(monkeypatch, team, cells):
    monkeypatch.setattr(agglomerate, "_CELLS", cells[0])
    monkeypatch.setattr(agglomerate, "_AT_ONCE", cells[1])
    rows = pd.DataFrame(crossing(sequences=12), columns=["seq", "frame", "id", "x", "y", "w", "h"]).fillna({"seq": "7"})
    rows = rows[(rows["frame"] < 5000) | (rows["frame"] > 5040)].astype({"seq": int}).sort_values(["seq", "frame", "id"], ignore_index=True)
    # one row alone, and a sequence with a hole wider than its windows
    rows = pd.concat([rows, pd.DataFrame([(12, 5, 1, 3.0, 3.0, 5.0, 5.0), *[(13, f, 1, 3.0, 3.0, 5.0, 5.0) for f in (1, 2, 300)]], columns=rows.columns)], ignore_index=True)
    got = agglomerate.run_together(rows["seq"].to_numpy(), rows["frame"].to_numpy(), rows[["x", "y", "w", "h"]].to_numpy(float), TEAMS[team])
    want = np.concatenate([agglomerate.run_experts(g.reset_index(drop=True), TEAMS[team]) for _, g in rows.groupby("seq")])
    assert (got == want).all() and 5 < want.max() < 120


def test_offline_of_short_and_long_sequences(spark, monkeypatch):
    monkeypatch.setattr(frames, "_ROWS", 700)
    rows = crossing(sequences=10)
    det = spark.createDataFrame(rows, DET).repartition(3)
    got = {(r.seq or "", r.id, r.track_id) for r in agglomerate.track_offline(det.withColumn("id", F.col("frame") * 10 + F.col("id")), TEAMS["query"]).collect()}
    want = set()
    for s, g in pd.DataFrame(rows, columns=["seq", "frame", "id", "x", "y", "w", "h"]).fillna({"seq": ""}).groupby("seq"):
        g = g.sort_values(["frame", "id"], ignore_index=True)
        want |= {(s, int(i), int(n)) for i, n in zip(g["frame"] * 10 + g["id"], agglomerate.run_experts(g, TEAMS["query"]), strict=True)}
    assert got == want

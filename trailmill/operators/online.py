"""Online tracking: detections of a sequence, frame by frame, into tracks."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import kalman, lap
from .frames import codes_of, per_sequences

FORBIDDEN = 1e5
TRACKS = "seq string, frame long, track_id long, x double, y double, w double, h double"
TENTATIVE, CONFIRMED, DELETED = 1, 2, 3


@dataclass
class Track:
    mean: np.ndarray
    cov: np.ndarray
    number: int
    hits: int = 1
    age: int = 1
    missed: int = 0
    state: int = TENTATIVE
    features: list[np.ndarray] = field(default_factory=list)


@dataclass
class Tracker:
    """State of one sequence. Confirmed tracks are matched by appearance, the most recently seen first; what is left, by overlap."""

    max_cosine: float = 0.2
    max_iou_distance: float = 0.7
    max_age: int = 30
    n_init: int = 3
    budget: int | None = None
    tracks: list[Track] = field(default_factory=list)
    gallery: dict[int, np.ndarray] = field(default_factory=dict)
    next_number: int = 1

    def step(self, boxes: np.ndarray, features: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """Take in a frame's boxes (x, y, w, h) and features (rows; may have no columns); return numbers and boxes of the confirmed tracks seen in this or the last frame."""
        for t in self.tracks:
            t.mean, t.cov = kalman.predict(t.mean, t.cov)
            t.age += 1
            t.missed += 1
        seen = np.column_stack([boxes[:, 0] + boxes[:, 2] / 2, boxes[:, 1] + boxes[:, 3] / 2, boxes[:, 2] / np.maximum(boxes[:, 3], 1e-9), boxes[:, 3]])
        pairs, left = self._match(boxes, seen, features)
        hit = dict(pairs)
        for i, t in enumerate(self.tracks):
            if i in hit:
                j = hit[i]
                t.mean, t.cov = kalman.update(t.mean, t.cov, seen[j])
                t.features.append(features[j])
                t.hits += 1
                t.missed = 0
                if t.state == TENTATIVE and t.hits >= self.n_init:
                    t.state = CONFIRMED
            elif t.state == TENTATIVE or t.missed > self.max_age:
                t.state = DELETED
        for j in left:
            mean, cov = kalman.initiate(seen[j])
            self.tracks.append(Track(mean, cov, self.next_number, features=[features[j]]))
            self.next_number += 1
        self.tracks = [t for t in self.tracks if t.state != DELETED]
        for t in self.tracks:
            if t.state == CONFIRMED and t.features and features.shape[1]:
                new = np.array(t.features)
                old = self.gallery.get(t.number)
                both = new if old is None else np.concatenate([old, new])
                self.gallery[t.number] = both[-self.budget :] if self.budget else both
                t.features = []
        alive = {t.number for t in self.tracks if t.state == CONFIRMED}
        self.gallery = {k: v for k, v in self.gallery.items() if k in alive}
        return [(t.number, _box(t.mean)) for t in self.tracks if t.state == CONFIRMED and t.missed <= 1]

    def _match(self, boxes: np.ndarray, seen: np.ndarray, features: np.ndarray) -> tuple[list[tuple[int, int]], list[int]]:
        free, pairs = list(range(len(boxes))), []
        confirmed = [i for i, t in enumerate(self.tracks) if t.state == CONFIRMED]
        if features.shape[1]:
            for level in range(1, self.max_age + 1):
                rows = [i for i in confirmed if self.tracks[i].missed == level]
                if rows and free:
                    cost = self._appearance(rows, free, seen, features)
                    new = _accept(cost, self.max_cosine, rows, free)
                    pairs += new
                    free = [j for j in free if j not in {b for _, b in new}]
        taken = {a for a, _ in pairs}
        rows = [i for i, t in enumerate(self.tracks) if t.state != CONFIRMED or (i not in taken and t.missed == 1)]
        if rows and free:
            cost = 1 - _iou(np.array([_box(self.tracks[i].mean) for i in rows]), boxes[free])
            new = _accept(cost, self.max_iou_distance, rows, free)
            pairs += new
            free = [j for j in free if j not in {b for _, b in new}]
        return pairs, free

    def _appearance(self, rows: list[int], free: list[int], seen: np.ndarray, features: np.ndarray) -> np.ndarray:
        f = features[free]
        f = f / np.maximum(np.linalg.norm(f, axis=1, keepdims=True), 1e-12)
        cost = np.empty((len(rows), len(free)))
        for k, i in enumerate(rows):
            t = self.tracks[i]
            if t.number not in self.gallery:
                cost[k] = FORBIDDEN
                continue
            g = self.gallery[t.number]
            g = g / np.maximum(np.linalg.norm(g, axis=1, keepdims=True), 1e-12)
            cost[k] = (1 - g @ f.T).min(axis=0)
            cost[k, kalman.gating_distance(t.mean, t.cov, seen[free]) > kalman.CHI2_95[4]] = FORBIDDEN
        return cost


def _accept(cost: np.ndarray, most: float, rows: list[int], cols: list[int]) -> list[tuple[int, int]]:
    """Assign with costs over most all alike, then refuse those."""
    i, j = lap.solve(np.minimum(cost, most + 1e-5))
    return [(rows[a], cols[b]) for a, b in zip(i, j, strict=True) if cost[a, b] <= most]


def _box(mean: np.ndarray) -> np.ndarray:
    w = mean[2] * mean[3]
    return np.array([mean[0] - w / 2, mean[1] - mean[3] / 2, w, mean[3]])


def _iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    lo = np.maximum(a[:, None, :2], b[None, :, :2])
    hi = np.minimum(a[:, None, :2] + a[:, None, 2:], b[None, :, :2] + b[None, :, 2:])
    i = np.maximum(hi - lo, 0).prod(axis=2)
    return i / np.maximum(a[:, 2:].prod(axis=1)[:, None] + b[:, 2:].prod(axis=1)[None, :] - i, 1e-12)


def feature_rows(column: pd.Series) -> np.ndarray:
    rows = [np.asarray(x if x is not None else [], float) for x in column]
    d = max((len(r) for r in rows), default=0)
    return np.array([r if len(r) == d else np.zeros(d) for r in rows]).reshape(len(rows), d)


def step_together(seq: np.ndarray, frames: np.ndarray, boxes: np.ndarray, *, max_iou_distance: float = 0.7, max_age: int = 30, n_init: int = 3) -> tuple[np.ndarray, ...]:
    """What Tracker makes, matching by overlap alone, of many sequences in step: numbers of sequences (from 0), frames, track numbers and boxes of the confirmed tracks seen in a frame or the one before, by sequence, frame and number. Rows come by sequence, frame and id.

    A step takes in the frame of every sequence that lies as far from its first; steps in which no sequence has a box or a track are skipped.
    """
    n = int(seq[-1]) + 1
    first = frames[np.searchsorted(seq, np.arange(n))]
    span = frames[np.searchsorted(seq, np.arange(n), "right") - 1] - first
    at = frames - first[seq]
    order = np.argsort(at, kind="stable")
    times, starts = np.unique(at[order], return_index=True)
    ends = np.append(starts[1:], len(order))
    whose, number, hits, missed, sure = (np.zeros(0, np.int64) for _ in range(5))
    f, following, out, now, k = kalman.Filters.initiate(np.zeros((4, 0))), np.ones(n, np.int64), [], 0, 0
    while len(whose) or k < len(times):
        now = now if len(whose) else int(times[k])
        rows = order[:0]
        if k < len(times) and times[k] == now:
            rows, k = order[starts[k] : ends[k]], k + 1
        box, owner = boxes[rows], seq[rows]
        seen = np.stack([box[:, 0] + box[:, 2] / 2, box[:, 1] + box[:, 3] / 2, box[:, 2] / np.maximum(box[:, 3], 1e-9), box[:, 3]])
        f.predict()
        missed = missed + 1
        t, d = _match_together(whose, f.mean, (sure == 0) | (missed == 1), owner, box, max_iou_distance)
        some = f.take(t)
        some.update(seen[:, d])
        f.put(t, some)
        hits[t] += 1
        missed[t] = 0
        sure[t] |= hits[t] >= n_init
        left = np.ones(len(rows), bool)
        left[d] = False
        new = owner[left]
        place = np.arange(len(new)) - np.searchsorted(new, new)
        stays = (missed == 0) | ((sure == 1) & (missed <= max_age))
        whose, number, hits, missed, sure = (np.concatenate([x[stays], y]) for x, y in ((whose, new), (number, following[new] + place), (hits, np.ones_like(new)), (missed, np.zeros_like(new)), (sure, np.zeros_like(new))))
        f = f.take(stays).join(kalman.Filters.initiate(seen[:, left]))
        following += np.bincount(new, minlength=n)
        shown = np.flatnonzero((sure == 1) & (missed <= 1))
        out.append((whose[shown], first[whose[shown]] + now, number[shown], _corners(f.mean[:, shown])))
        turn = np.argsort(whose, kind="stable")
        turn = turn[span[whose[turn]] > now]
        whose, number, hits, missed, sure, f = whose[turn], number[turn], hits[turn], missed[turn], sure[turn], f.take(turn)
        now += 1
    found = [np.concatenate(x) for x in zip(*out, strict=True)]
    turn = np.lexsort((found[2], found[1], found[0]))
    return tuple(x[turn] for x in found)


def _corners(mean: np.ndarray) -> np.ndarray:
    """_box() of many means (4 rows)."""
    w = mean[2] * mean[3]
    return np.stack([mean[0] - w / 2, mean[1] - mean[3] / 2, w, mean[3]], axis=1)


def _match_together(whose: np.ndarray, mean: np.ndarray, open_: np.ndarray, owner: np.ndarray, boxes: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of tracks and boxes that belong together, by overlap; tracks and boxes come by sequence (whose, owner)."""
    rows = np.flatnonzero(open_)
    low = np.searchsorted(owner, whose[rows])
    n = np.searchsorted(owner, whose[rows], "right") - low
    if not n.sum():
        return rows[:0], rows[:0]
    end = np.cumsum(n)
    i = np.repeat(np.arange(len(rows)), n)
    j = np.arange(end[-1]) - np.repeat(end - n - low, n)
    a, b = _corners(mean[:, rows])[i], boxes[j]
    lo, hi = np.maximum(a[:, :2], b[:, :2]), np.minimum(a[:, :2] + a[:, 2:], b[:, :2] + b[:, 2:])
    both = np.maximum(hi - lo, 0)
    both = both[:, 0] * both[:, 1]
    cost = 1 - both / np.maximum(a[:, 2] * a[:, 3] + b[:, 2] * b[:, 3] - both, 1e-12)
    near = cost <= most
    # where no track and no box has a choice, all near pairs are taken; else the sequence is an assignment
    choice = near & ((np.bincount(i[near], minlength=len(rows))[i] > 1) | (np.bincount(j[near], minlength=len(boxes))[j] > 1)) | ~np.isfinite(cost)
    hard = np.unique(whose[rows[i[choice]]])
    in_hard = np.isin(whose[rows[i]], hard)
    sure = near & ~in_hard
    t, d = [rows[i[sure]]], [j[sure]]
    if len(hard):
        i, j, cost = i[in_hard], j[in_hard], cost[in_hard]
        p = np.searchsorted(hard, whose[rows[i]])
        top, left = np.searchsorted(whose[rows], hard), np.searchsorted(owner, hard)
        height, width = np.searchsorted(whose[rows], hard, "right") - top, np.searchsorted(owner, hard, "right") - left
        whole = np.full((len(hard), height.max(), width.max()), np.inf)
        whole[p, i - top[p], j - left[p]] = cost
        capped = np.minimum(whole, most + 1e-5)
        broken = np.zeros(len(hard), bool)
        broken[p[~np.isfinite(cost)]] = True
        fine = np.flatnonzero(~broken)
        column = np.full(whole.shape[:2], -1)
        column[fine] = lap.solve_many(capped[fine], height[fine], width[fine])
        for q in np.flatnonzero(broken):
            r, c = lap.solve(capped[q, : height[q], : width[q]])
            column[q, r] = c
        q, r = np.nonzero(column >= 0)
        c = column[q, r]
        ok = whole[q, r, c] <= most
        t.append(rows[(top[q] + r)[ok]])
        d.append((left[q] + c)[ok])
    return np.concatenate(t), np.concatenate(d)


def track_online(det: DataFrame, **how: float) -> DataFrame:
    """TRACKS of the detections (seq, frame, id, x, y, w, h, and feature if there is one). A sequence is in one task; frames without detections between its first and last count as empty. Without features many sequences are tracked in step."""
    has, plain = "feature" in det.columns, Tracker(**how)

    def one(pdf: pd.DataFrame) -> list[tuple]:
        tracker, rows = Tracker(**how), []
        groups = dict(list(pdf.groupby("frame")))
        for f in range(int(pdf["frame"].min()), int(pdf["frame"].max()) + 1):
            g = groups.get(f)
            boxes = g[["x", "y", "w", "h"]].to_numpy(float) if g is not None else np.zeros((0, 4))
            feats = feature_rows(g["feature"]) if g is not None else np.zeros((len(boxes), 0))
            rows += [(pdf["seq"].iloc[0], f, n, *b) for n, b in tracker.step(boxes, feats)]
        return rows

    def many(pdf: pd.DataFrame) -> pd.DataFrame:
        if has:
            rows = [r for _, g in pdf.groupby(codes_of(pdf["seq"])) for r in one(g)]
            return pd.DataFrame(rows, columns=["seq", "frame", "track_id", "x", "y", "w", "h"])
        codes = codes_of(pdf["seq"])
        seq, frame, number, box = step_together(codes, pdf["frame"].to_numpy(np.int64), pdf[["x", "y", "w", "h"]].to_numpy(float), max_iou_distance=plain.max_iou_distance, max_age=plain.max_age, n_init=plain.n_init)
        names = pdf["seq"].to_numpy(object)[np.searchsorted(codes, np.arange(codes[-1] + 1))]
        return pd.DataFrame({"seq": names[seq], "frame": frame, "track_id": number, **dict(zip("xywh", box.T, strict=True))})

    return per_sequences(det, many, TRACKS)

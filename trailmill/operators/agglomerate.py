"""Constrained agglomerative tracking: clusters of detections with no two in one frame."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kalman, links
from .frames import codes_of, per_sequences
from .storage import stored

LABELS = "seq string, id long, track_id long"
LINKAGES: dict[str, Callable[[float, float, int, int], float]] = {
    "complete": lambda a, b, n, m: max(a, b),
    "single": lambda a, b, n, m: min(a, b),
    "average": lambda a, b, n, m: (a * n + b * m) / (n + m),
}
_REDUCE = {"complete": np.maximum, "single": np.minimum, "average": np.add}
#: Up to so many frames a sequence's sets of frames are bits of integers; up to so many it is merged in step with others.
_BITS, _IN_STEP = 4096, 512
#: Distances between clusters that are held at once.
_CELLS = 3_000_000
#: Distances between detections that are worked out at once; few, so that they stay in a cache.
_AT_ONCE = 100_000
REDUCERS = {"complete": np.max, "average": np.mean, "single": np.min}


@dataclass
class Clusters:
    """Clusters over nodes 0..n-1; merged ones get new numbers. Frames of a cluster, a set or the bits of an integer, never repeat."""

    frames: list[frozenset[int]] | list[int]
    members: list[list[int]] = field(default_factory=list)
    merges: list[tuple[int, int, float]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.members = self.members or [[i] for i in range(len(self.frames))]
        self.live = set(range(len(self.frames)))

    def join(self, a: int, b: int, d: float) -> int:
        self.frames.append(self.frames[a] | self.frames[b])
        self.members.append(sorted(self.members[a] + self.members[b]))
        self.merges.append((a, b, d))
        self.live.difference_update((a, b))
        self.live.add(len(self.frames) - 1)
        return len(self.frames) - 1


def merge_nearest(clusters: Clusters, edges: Iterable[tuple[int, int, float]], threshold: float, linkage: str = "complete", veto: Callable[[list[int], list[int]], bool] | None = None) -> None:
    """Merge along the shortest edges up to threshold, whatever they join, unless frames clash or veto says no; a refused edge is out for this run.

    Edges to a merged cluster exist to those that both parts had edges to, with the two distances combined by linkage. Ties go to the
    smaller numbers.
    """
    combine = LINKAGES[linkage]
    frames, members, live = clusters.frames, clusters.members, clusters.live
    near: dict[int, dict[int, float]] = {i: {} for i in live}
    heap = []
    for a, b, d in edges:
        if not frames[a] & frames[b]:
            near[a][b] = near[b][a] = d
            heap.append((d, a, b) if a < b else (d, b, a))
    heapq.heapify(heap)
    while heap and heap[0][0] <= threshold:
        d, a, b = heapq.heappop(heap)
        if a not in live or b not in live or frames[a] & frames[b]:
            continue
        if veto is not None and veto(members[a], members[b]):
            continue
        n, m = len(members[a]), len(members[b])
        na, nb = near.pop(a), near.pop(b)
        k = clusters.join(a, b, d)
        own = near[k] = {}
        both = frames[k]
        for c in na.keys() & nb.keys():
            if c in live:
                e = combine(na[c], nb[c], n, m)
                own[c] = near[c][k] = e
                # where frames clash now they always will
                if not both & frames[c]:
                    heapq.heappush(heap, (e, c, k))


def by_linkage(distances: np.ndarray, linkage: str) -> float:
    return float(REDUCERS[linkage](distances))


def divide(frames: Sequence[int], *, frames_a_window: int | None = None, detections_a_window: int = 3000) -> list[tuple[int, int]]:
    """Windows (first, last frame) over frames (one entry a detection): by a fixed number of frames, or so that a window has about detections_a_window; two at least."""
    lo, hi = int(min(frames)), int(max(frames))
    n = hi - lo + 1
    if frames_a_window is None:
        parts = max(2, -(-len(frames) // detections_a_window))
        frames_a_window = max(1, round(n / parts))
    return [(a, min(a + frames_a_window - 1, hi)) for a in range(lo, hi + 1, frames_a_window)]


def temporal_gap(a: Sequence[int], b: Sequence[int]) -> float:
    """Frames between two clusters; infinite where they share a frame, 0 where they interleave."""
    if set(a) & set(b):
        return float("inf")
    if max(a) < min(b):
        return float(min(b) - max(a))
    if max(b) < min(a):
        return float(min(a) - max(b))
    return 0.0


@dataclass
class Expert:
    """One pass over the windows: its distance, threshold, linkage and vetoes (None: no veto)."""

    threshold: float
    linkage: str = "complete"
    frames_a_window: int | None = None
    detections_a_window: int = 1000
    max_kalman: float | None = None
    kalman_linkage: str = "average"
    max_appearance: float | None = None
    appearance_linkage: str = "complete"
    max_gap: float | None = None
    reclaim: bool = False


class Distances:
    """Distances between detections, made when asked for: cosine between features where there are any, else Euclidean between corners. No matrix of a whole sequence is ever held."""

    def __init__(self, pdf: pd.DataFrame) -> None:
        self.features = None
        if "feature" in pdf:
            from .online import feature_rows

            f = feature_rows(pdf["feature"])
            self.features = f / np.maximum(np.linalg.norm(f, axis=1, keepdims=True), 1e-12)
        x, y, w, h = (pdf[c].to_numpy(float) for c in "xywh")
        self.corners = np.column_stack([x, y, x + w, y + h])

    def between(self, a: Sequence[int], b: Sequence[int]) -> np.ndarray:
        if self.features is not None:
            return 1 - self.features[a] @ self.features[b].T
        p, q = self.corners[a], self.corners[b]
        return np.sqrt(np.maximum((p * p).sum(axis=1)[:, None] + (q * q).sum(axis=1)[None] - 2 * p @ q.T, 0))

    def groups(self, groups: Sequence[Sequence[int]], linkage: str) -> np.ndarray:
        """Distances between groups of detections by linkage: blocks of one matrix over all their members."""
        size = np.array([len(g) for g in groups])
        start = np.cumsum(size) - size
        every = np.concatenate([np.asarray(g) for g in groups])
        reduce = _REDUCE[linkage].reduceat
        d = reduce(reduce(self.between(every, every), start, axis=0), start, axis=1)
        return d / np.outer(size, size) if linkage == "average" else d


def _vetoes(e: Expert, frames: np.ndarray, aspect: np.ndarray, distances: Distances) -> Callable[[list[int], list[int]], bool]:
    def veto(a: list[int], b: list[int]) -> bool:
        if e.max_gap is not None and temporal_gap(frames[a], frames[b]) > e.max_gap:
            return True
        if e.max_appearance is not None and distances.features is not None and by_linkage(distances.between(a, b), e.appearance_linkage) > e.max_appearance:
            return True
        if e.max_kalman is not None:
            both = np.array(a + b)
            both = both[np.argsort(frames[both], kind="stable")]
            return bool(_refuse_paths(e, frames[both], aspect[both], np.array([len(both)]))[0])
        return False

    return veto


def run_experts(pdf: pd.DataFrame, experts: Sequence[Expert]) -> np.ndarray:
    """Track numbers of a sequence's detections (frame, id, x, y, w, h, feature or not, fp_flag or not); flagged ones take part only in reclaiming experts, and stay -1 if unclaimed."""
    frames = pdf["frame"].to_numpy(np.int64)
    x, y, w, h = (pdf[c].to_numpy(float) for c in "xywh")
    aspect = np.column_stack([x + w / 2, y + h / 2, w / np.maximum(h, 1e-9), h])
    distances = Distances(pdf)
    flagged = pdf["fp_flag"].notna().to_numpy() if "fp_flag" in pdf else np.zeros(len(pdf), bool)
    some = bool(flagged.any())
    at, lo = frames.tolist(), int(frames.min())
    # frames as bits where there are not too many of them
    bits = [1 << (t - lo) for t in at] if int(frames.max()) - lo < _BITS else None
    groups: list[list[int]] = [[i] for i in np.flatnonzero(~flagged).tolist()]
    for e in experts:
        pool = groups + ([[i] for i in np.flatnonzero(flagged).tolist()] if e.reclaim else [])
        windows = divide(frames, frames_a_window=e.frames_a_window, detections_a_window=e.detections_a_window)
        pairs = list(zip(windows, windows[1:], strict=False)) or [(windows[0], windows[0])]
        for (a, _), (_, b) in pairs:
            inside = [[i for i in g if a <= at[i] <= b] for g in pool]
            rows = [k for k, g in enumerate(inside) if g]
            if len(rows) < 2:
                continue
            inside = [inside[k] for k in rows]
            c = Clusters([sum([bits[i] for i in pool[k]]) if bits else frozenset([at[i] for i in pool[k]]) for k in rows], [list(pool[k]) for k in rows])
            d = distances.groups(inside, e.linkage)
            if e.reclaim:
                new = np.array([flagged[g].all() for g in inside])
                d[np.outer(new, new)] = np.inf
            i, j = np.nonzero(d <= e.threshold)
            up = i < j
            i, j = i[up], j[up]
            merge_nearest(c, zip(i.tolist(), j.tolist(), d[i, j].tolist(), strict=True), e.threshold, e.linkage, _vetoes(e, frames, aspect, distances))
            used = set(rows)
            pool = [g for k, g in enumerate(pool) if k not in used] + [c.members[n] for n in sorted(c.live)]
        pool.sort(key=min)
        groups = [g for g in pool if not flagged[g].all()] if some else pool
        if e.reclaim:
            for g in groups:
                flagged[g] = False
    out = np.full(len(pdf), -1, np.int64)
    for n, g in enumerate(sorted(groups, key=lambda g: (-len(g), min(g)))):
        out[g] = n + 1
    return out


def run_together(seq: np.ndarray, frames: np.ndarray, boxes: np.ndarray, experts: Sequence[Expert]) -> np.ndarray:
    """run_experts() for many sequences (numbers from 0; rows by sequence, frame and id; boxes x, y, w, h) without features, flags and limits of gaps: every sequence's next window pair is merged in step with the others'."""
    n, rows = int(seq[-1]) + 1, np.arange(len(seq))
    first = np.searchsorted(seq, np.arange(n))
    many = np.diff(np.append(first, len(seq)))
    lo, hi = frames[first], frames[first + many - 1]
    x, y, w, h = boxes.T
    corners, aspect = np.column_stack([x, y, x + w, y + h]), np.column_stack([x + w / 2, y + h / 2, w / np.maximum(h, 1e-9), h])
    # a cluster's name is its first row; ranks order the clusters of a sequence
    home = rows.copy()
    for e in experts:
        width = np.full(n, e.frames_a_window) if e.frames_a_window else np.maximum(1, np.rint((hi - lo + 1) / np.maximum(2, -(-many // e.detections_a_window)))).astype(np.int64)
        pairs = np.maximum(1, (hi - lo) // width)
        rank, top = rows.copy(), len(rows)
        for k in range(int(pairs.max())):
            a = lo + k * width
            inside = np.flatnonzero((pairs > k)[seq] & (frames >= a[seq]) & (frames < (a + 2 * width)[seq]))
            if not len(inside):
                continue
            inside = inside[np.lexsort((rank[home[inside]], seq[inside]))]
            new = np.concatenate([[True], home[inside][1:] != home[inside][:-1]])
            start = np.flatnonzero(new)
            name, size = home[inside][start], np.diff(np.append(start, len(inside)))
            whose, count = np.unique(seq[name], return_counts=True)
            begin = np.cumsum(count) - count
            slot = np.full(len(rows), -1)
            slot[name] = np.arange(len(name)) - np.repeat(begin, count)
            # about as many clusters in each problem of a chunk, and no more than _CELLS distances
            turn = np.flatnonzero(count > 1)
            turn = turn[np.argsort(-count[turn], kind="stable")]
            while len(turn):
                chunk, turn = np.split(turn, [max(1, _CELLS // int(count[turn[0]]) ** 2)])
                chunk = np.sort(chunk)
                c = _ranges(begin[chunk], count[chunk])
                in_chunk = np.zeros(n, bool)
                in_chunk[whose[chunk]] = True
                member = np.flatnonzero(in_chunk[seq] & (slot[home] >= 0))
                problem = np.searchsorted(whose[chunk], seq[member])
                merged, number = _merge_together(e, count[chunk], _ranges(start[c], size[c], inside), size[c], problem, member, slot[home[member]], frames, corners, aspect, first)
                at = merged + problem * count[chunk].max()
                _, head = np.unique(at, return_index=True)
                names = np.zeros(at.max() + 1, np.int64)
                names[at[head]] = member[head]
                home[member] = names[at]
                rank[member[head]] = top + number[problem[head], merged[head]]
            top += 2 * len(rows)
    name, size = np.unique(home, return_counts=True)
    turn = np.lexsort((name, -size, seq[name]))
    out = np.zeros(len(rows), np.int64)
    out[name[turn]] = 1 + np.arange(len(name)) - np.searchsorted(seq[name[turn]], seq[name[turn]])
    return out[home]


def _ranges(start: np.ndarray, size: np.ndarray, of: np.ndarray | None = None) -> np.ndarray:
    """The numbers start, start + 1, ... of each range one after the other, or what of has there."""
    at = np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)
    return at if of is None else of[at]


def _reduce(d: np.ndarray, start: np.ndarray, size: np.ndarray, f: np.ufunc) -> np.ndarray:
    """f over consecutive rows of d, size[i] of them from start[i]."""
    out = d[start]
    for k in range(1, int(size.max())):
        more = np.flatnonzero(size > k)
        out[more] = f(out[more], d[start[more] + k])
    return out


def _edges_together(e: Expert, count: np.ndarray, inside: np.ndarray, size: np.ndarray, corners: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Distances between the clusters of each problem (count of them), infinite where they are no edge; inside has each cluster's rows, size of them, and bits its frames."""
    k = int(count.max())
    out = np.full((len(count), k, k), np.inf)
    ends = np.cumsum(count)
    rows_to = np.cumsum(size)[ends - 1]
    depth = np.diff(rows_to, prepend=0)
    step = max(1, _AT_ONCE // int(depth.max()) ** 2)
    for a in range(0, len(count), step):
        b = min(a + step, len(count))
        own, m = slice(ends[a] - count[a], ends[b - 1]), int(depth[a:b].max())
        p, at = np.repeat(np.arange(b - a), depth[a:b]), _ranges(np.zeros(b - a, int), depth[a:b])
        pc, slot = np.repeat(np.arange(b - a), count[a:b]), _ranges(np.zeros(b - a, int), count[a:b])
        box = np.zeros((b - a, m, 4))
        box[p, at] = corners[inside[rows_to[a] - depth[a] : rows_to[b - 1]]]
        square = (box * box).sum(axis=2)
        d = square[:, :, None] + square[:, None]
        d -= (2 * box) @ box.transpose(0, 2, 1)
        # roots keep the order, so that of the least or greatest they are drawn after it is known
        late = e.linkage != "average"
        if not late:
            d = np.sqrt(np.maximum(d, 0))
        if size[own].max() > 1:
            f, n = _REDUCE[e.linkage], size[own]
            start = np.cumsum(n) - n
            flat = np.zeros((b - a, m, k))
            flat[pc, :, slot] = _reduce(d[p, at], start, n, f)
            d = np.zeros((b - a, k, k))
            d[pc, slot] = _reduce(flat[p, at], start, n, f)
            if e.linkage == "average":
                n = np.ones((b - a, k))
                n[pc, slot] = size[own]
                d /= n[:, :, None] * n[:, None]
            m = k
        if late:
            d = np.sqrt(np.maximum(d, 0))
        ok = d <= e.threshold
        for word in range(bits.shape[2]):
            x = bits[a:b, :m, word]
            ok &= (x[:, :, None] & x[:, None]) == 0
        there = np.arange(m) < count[a:b, None]
        ok &= there[:, :, None] & there[:, None]
        ok[:, np.arange(m), np.arange(m)] = False
        out[a:b, :m, :m] = np.where(ok, d, np.inf)
    return out


def _merge_together(e: Expert, count: np.ndarray, inside: np.ndarray, size: np.ndarray, problem: np.ndarray, member: np.ndarray, slot: np.ndarray, frames: np.ndarray, corners: np.ndarray, aspect: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The steps of merge_nearest() for many problems, each a step at a time: the slot in which each member ends, and the clusters' numbers by problem and slot.

    A problem has count clusters in slots from 0; members are all their rows, with problem and slot, by problem and frame. A merged cluster takes the slot of the larger number.
    """
    many, k = len(count), int(count.max())
    # the frames of the members of a problem, in order, as bits
    fresh = np.concatenate([[True], (problem[1:] != problem[:-1]) | (frames[member[1:]] != frames[member[:-1]])])
    place = np.cumsum(fresh) - 1
    begin = np.searchsorted(problem, np.arange(many))
    place -= place[begin][problem]
    bits = np.zeros((many, k, int(place.max()) // 64 + 1), np.uint64)
    np.bitwise_or.at(bits, (problem, slot, place // 64), np.left_shift(np.uint64(1), (place % 64).astype(np.uint64)))
    d = _edges_together(e, count, inside, size, corners, bits)
    weight = np.zeros((many, k))
    np.add.at(weight, (problem, slot), 1)
    filtered = e.max_kalman is not None
    if filtered:
        long = np.bincount(problem, minlength=many)
        at = (problem, np.arange(len(member)) - begin[problem])
        label, whose = np.full((many, long.max()), -1), np.zeros((many, long.max()), np.int64)
        label[at], whose[at] = slot, member
        refused = np.zeros(d.shape, bool)
    number, following = np.tile(np.arange(k), (many, 1)), count.copy()
    into, live = np.tile(np.arange(k), (many, 1)), np.ones((many, k), bool)
    # each cluster's shortest edge to one with a smaller number, ties to the smallest
    lower = np.where(np.tri(k, k=-1, dtype=bool), d, np.inf)
    best, other = lower.min(axis=2), lower.argmin(axis=2)
    del lower
    key = (other << 32) + number
    none = np.iinfo(np.int64).max

    def renew(p: np.ndarray, r: np.ndarray) -> None:
        ok = live[p] & (number[p] < number[p, r][:, None])
        if filtered:
            ok &= ~refused[p, r]
        row = np.where(ok, d[p, r], np.inf)
        least = row.min(axis=1)
        c = np.where(row == least[:, None], number[p], none).argmin(axis=1)
        best[p, r], other[p, r], key[p, r] = least, c, (number[p, c] << 32) + number[p, r]

    go = np.arange(many)
    while True:
        near = best[go]
        least = near.min(axis=1)
        if not np.isfinite(least).all():
            go = go[np.isfinite(least)]
            if not len(go):
                break
            continue
        p, b = go, np.where(near == least[:, None], key[go], none).argmin(axis=1)
        a = other[p, b]
        if filtered:
            mine = label[p]
            hit = (mine == a[:, None]) | (mine == b[:, None])
            path = whose[p][hit]
            no = _refuse_paths(e, frames[path], aspect[path], hit.sum(axis=1))
            if no.any():
                refused[p[no], b[no], a[no]] = True
                renew(p[no], b[no])
                p, a, b, mine = p[~no], a[~no], b[~no], mine[~no]
            if not len(p):
                continue
            label[p] = np.where(mine == a[:, None], b[:, None], mine)
            refused[p, b] = False
        x, y = d[p, a], d[p, b]
        if e.linkage == "average":
            n, m = weight[p, a][:, None], weight[p, b][:, None]
            new = (x * n + y * m) / (n + m)
        else:
            new = np.maximum(x, y)
            new = new if e.linkage == "complete" else np.where(np.isfinite(new), np.minimum(x, y), np.inf)
        weight[p, b] += weight[p, a]
        bits[p, b] |= bits[p, a]
        live[p, a] = False
        clash = ((bits[p] & bits[p, b][:, None]) != 0).any(axis=2)
        new[clash | ~live[p]] = np.inf
        d[p, b], d[p, :, b] = new, new
        into[p, a] = b
        number[p, b] = following[p]
        following[p] += 1
        best[p, a] = np.inf
        stale = ((other[p] == a[:, None]) | (other[p] == b[:, None])) & np.isfinite(best[p])
        stale[np.arange(len(p)), b] = True
        q, r = np.nonzero(stale)
        renew(p[q], r)
    while True:
        deep = np.take_along_axis(into, into, axis=1)
        if (deep == into).all():
            return into[problem, slot], number
        into = deep


def _refuse_paths(e: Expert, frames: np.ndarray, boxes: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which of the paths laid end to end the filter refuses."""
    d = kalman.many_path_distances(frames, boxes, size)
    # a path's first box has no distance
    inner = np.ones(len(d), bool)
    inner[np.cumsum(size) - size] = False
    value = _REDUCE[e.kalman_linkage].reduceat(d[inner], np.cumsum(size) - size - np.arange(len(size)))
    return (value / (size - 1) if e.kalman_linkage == "average" else value) > e.max_kalman


def track_offline(det: DataFrame, experts: Sequence[Expert]) -> DataFrame:
    """LABELS of the detections (seq, frame, id, x, y, w, h, feature and fp_flag or not) by a team of experts, one after the other. A sequence is in one task; its edges are built window pair by window pair.

    Boxes without features and flags, of sequences of up to _IN_STEP frames, go through run_together().
    """
    plain = not {"feature", "fp_flag"} & set(det.columns) and all(not e.reclaim and e.max_gap is None for e in experts)

    def many(pdf: pd.DataFrame) -> pd.DataFrame:
        codes, frames = codes_of(pdf["seq"]), pdf["frame"].to_numpy(np.int64)
        out = np.zeros(len(pdf), np.int64)
        ends = np.searchsorted(codes, np.arange(codes[-1] + 1), "right")
        starts = np.append(0, ends[:-1])
        short = (frames[ends - 1] - frames[starts] < _IN_STEP) & plain
        if short.any():
            rows = np.flatnonzero(short[codes])
            out[rows] = run_together((np.cumsum(short) - 1)[codes[rows]], frames[rows], pdf[["x", "y", "w", "h"]].to_numpy(float)[rows], experts)
        for k in np.flatnonzero(~short):
            out[starts[k] : ends[k]] = run_experts(pdf.iloc[starts[k] : ends[k]], experts)
        return pd.DataFrame({"seq": pdf["seq"], "id": pdf["id"], "track_id": out})[out > 0]

    return per_sequences(det, many, LABELS)


def agglomerate(nodes: DataFrame, edges: DataFrame, *, threshold: float, linkage: str = "complete", nodes_a_task: int = 50_000) -> DataFrame:
    """seq, id, track_id (smallest id of the cluster) by merging nodes (seq, frame, id) along edges (seq, a, b, distance), never two nodes of a frame.

    Edges over the threshold belong to the distances between clusters, but none merges without one up to it, so components of these don't touch each other: tasks take components of about nodes_a_task nodes together, or a larger one alone, whatever a sequence holds. Nodes without such edges are clusters as they are.
    """

    def one(n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        n = n.sort_values(["frame", "id"])
        seqs, ids = n["seq"].to_numpy(), n["id"].to_numpy()
        at = {x: i for i, x in enumerate(zip(seqs, ids, strict=True))}
        c = Clusters([frozenset([f]) for f in n["frame"]])
        ends = ((at.get((s, a)), at.get((s, b)), d) for s, a, b, d in zip(e["seq"], e["a"], e["b"], e["distance"], strict=True))
        merge_nearest(c, [(i, j, d) for i, j, d in ends if i is not None and j is not None], threshold, linkage)
        rows = [(seqs[i], ids[i], ids[c.members[k]].min()) for k in c.live for i in c.members[k]]
        return pd.DataFrame(rows, columns=["seq", "id", "track_id"])

    edges = stored(edges.select("seq", "a", "b", "distance"), "edges")
    end = lambda c: F.struct("seq", F.col(c).alias("id"))
    roots = stored(links.components(edges.filter(F.col("distance") <= threshold).select(end("a").alias("a"), end("b").alias("b"))), "roots")
    parts = max(1, -(-roots.count() // nodes_a_task))
    roots = roots.select(F.col("node.seq").alias("_seq"), F.col("node.id").alias("_id"), F.pmod(F.xxhash64("root"), F.lit(parts)).alias("part"))
    placed = stored(nodes.select("seq", "frame", "id").join(roots, F.col("seq").eqNullSafe(F.col("_seq")) & (F.col("id") == F.col("_id")), "left").drop("_seq", "_id"), "placed")
    met = edges.join(roots, F.col("seq").eqNullSafe(F.col("_seq")) & (F.col("a") == F.col("_id"))).select("part", "seq", "a", "b", "distance")
    merged = placed.filter("part IS NOT NULL").groupBy("part").cogroup(met.groupBy("part")).applyInPandas(one, LABELS)
    return merged.union(placed.filter("part IS NULL").select(F.col("seq").cast("string"), F.col("id").cast("long"), F.col("id").cast("long").alias("track_id")))

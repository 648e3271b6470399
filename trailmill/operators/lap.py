"""Minimum-cost assignment of a rectangular cost matrix with forbidden pairs."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame

from .frames import per_frame


def fill_forbidden(cost: np.ndarray) -> np.ndarray:
    """Non-finite costs replaced by one so high that no solution with fewer allowed pairs can be cheaper; zeros where nothing is allowed."""
    ok = np.isfinite(cost)
    if not ok.any():
        return np.zeros_like(cost)
    high = 2 * min(cost.shape) * (np.abs(cost[ok]).max() + 1) + 1
    return np.where(ok, cost, high)


def solve(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of an assignment with most allowed pairs and, among those, least cost; NaN and infinite costs are forbidden. Rows ascend.

    Successive shortest augmenting paths with potentials, one row at a time, each step vectorised over columns.
    """
    cost = np.atleast_2d(np.asarray(cost, float))
    if not cost.size:
        return np.zeros(0, int), np.zeros(0, int)
    full = fill_forbidden(cost)
    turned = full.shape[0] > full.shape[1]
    a = full.T if turned else full
    n, m = a.shape
    u, v, row_of = np.zeros(n), np.zeros(m), np.full(m, -1)
    for i in range(n):
        least, before, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, col, shift = i, -1, 0.0
        tree: list[tuple[int, int]] = []
        while True:
            tree.append((row, col))
            reach = shift + a[row] - u[row] - v
            better = ~done & (reach < least)
            least[better], before[better] = reach[better], col
            open_ = np.where(done, np.inf, least)
            col = int(open_.argmin())
            shift = open_[col]
            done[col] = True
            row = row_of[col]
            if row < 0:
                break
        for r, c in tree:
            u[r] += shift - (least[c] if c >= 0 else 0.0)
            if c >= 0:
                v[c] -= shift - least[c]
        while col >= 0:
            prev = before[col]
            row_of[col] = row_of[prev] if prev >= 0 else i
            col = prev
    cols = np.flatnonzero(row_of >= 0)
    rows = row_of[cols]
    if turned:
        rows, cols = cols, rows
    keep = np.isfinite(cost[rows, cols])
    rows, cols = rows[keep], cols[keep]
    order = np.argsort(rows)
    return rows[order], cols[order]


def solve_many(cost: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """solve() for many matrices of finite costs at once, step by step the same: cost[p, :rows[p], :cols[p]] is a matrix, what lies beyond is ignored. Returns the column of each row, -1 for none."""
    turned = rows > cols
    n, m = np.minimum(rows, cols), np.maximum(rows, cols)
    size = int(n.max(initial=0)), int(m.max(initial=0))
    a = np.full((len(cost), *size), np.inf)
    for t, part in ((False, cost), (True, cost.transpose(0, 2, 1))):
        w = np.flatnonzero(turned == t)
        h, k = min(size[0], part.shape[1]), min(size[1], part.shape[2])
        a[w, :h, :k] = part[w, :h, :k]
    a[np.broadcast_to(np.arange(size[1]) >= m[:, None, None], a.shape)] = np.inf
    u, v, row_of = np.zeros((len(a), size[0])), np.zeros((len(a), size[1])), np.full((len(a), size[1]), -1)
    for i in range(size[0]):
        p = np.flatnonzero(n > i)
        least, before, done = np.full((len(p), size[1]), np.inf), np.full((len(p), size[1]), -1), np.zeros((len(p), size[1]), bool)
        row, col, shift = np.full(len(p), i), np.full(len(p), -1), np.zeros(len(p))
        go = np.arange(len(p))
        while len(go):
            q, r = p[go], row[go]
            reach = shift[go, None] + a[q, r] - u[q, r][:, None] - v[q]
            l, d = least[go], done[go]  # noqa: E741
            better = ~d & (reach < l)
            l = np.where(better, reach, l)  # noqa: E741
            least[go], before[go] = l, np.where(better, col[go, None], before[go])
            open_ = np.where(d, np.inf, l)
            c = open_.argmin(axis=1)
            col[go], shift[go] = c, open_[np.arange(len(go)), c]
            done[go, c] = True
            row[go] = row_of[q, c]
            go = go[row[go] >= 0]
        u[p, i] += shift
        at, c = np.nonzero(done & (row_of[p] >= 0))
        more = shift[at] - least[at, c]
        u[p[at], row_of[p[at], c]] += more
        v[p[at], c] -= more
        go = np.arange(len(p))
        while len(go):
            c = col[go]
            prev = before[go, c]
            row_of[p[go], c] = np.where(prev >= 0, row_of[p[go], prev], i)
            col[go] = prev
            go = go[prev >= 0]
    out = np.full(cost.shape[:2], -1)
    q, c = np.nonzero(row_of >= 0)
    r = row_of[q, c]
    t = turned[q]
    out[q, np.where(t, c, r)] = np.where(t, r, c)
    return out


def dense(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted ids of both sides and the matrix of distances, NaN where there is no pair."""
    rows, i = np.unique(a, return_inverse=True)
    cols, j = np.unique(b, return_inverse=True)
    m = np.full((len(rows), len(cols)), np.nan)
    m[i, j] = d
    return rows, cols, m


def assign(pairs: DataFrame, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """keys, a, b, distance of the pairs (keys, a, b, distance) that a minimum-cost assignment of each group keeps. The matrix of a group, one frame, must fit a worker."""

    def one(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
        if len(d) == 1:
            return np.array([0 if np.isfinite(d[0]) else -1])
        rows, cols, m = dense(a, b, d.astype(float))
        i, j = solve(m)
        chosen = np.full((len(rows)), -1)
        chosen[i] = j
        return np.where(chosen[np.searchsorted(rows, a)] == np.searchsorted(cols, b), 0, -1)

    return per_frame(pairs.select(*keys, "a", "b", "distance"), keys, ["a", "b", "distance"], one, "_kept").filter("_kept = 0").drop("_kept")


def padded(cost: np.ndarray, value: float = 0.0) -> np.ndarray:
    """A square matrix with the costs in its corner and value elsewhere."""
    n = max(cost.shape)
    out = np.full((n, n), float(value))
    out[: cost.shape[0], : cost.shape[1]] = cost
    return out


def integer_scale(cost: np.ndarray, most: int = 1 << 40) -> float:
    """The largest power of two by which finite costs may be multiplied so that they stay under most in size; 1 for costs of 0."""
    top = np.abs(cost[np.isfinite(cost)]).max(initial=0)
    return float(2.0 ** np.floor(np.log2(most / top))) if top else 1.0


def auction(cost: np.ndarray, most: int = 1 << 30) -> tuple[np.ndarray, np.ndarray]:
    """As solve(), by bidding: rows bid for their best column against its second best, with smaller and smaller increments. Costs are rounded to integers by integer_scale(), so sums may differ from the least by the rounding."""
    cost = np.atleast_2d(np.asarray(cost, float))
    if not cost.size:
        return np.zeros(0, int), np.zeros(0, int)
    full = padded(fill_forbidden(cost))
    n = len(full)
    value = -np.rint(full * integer_scale(full, most)).astype(np.int64) * (n + 1)
    price, eps = np.zeros(n, np.int64), max(1, int(np.abs(value).max()) // 4)
    while True:
        owner, has = np.full(n, -1), np.full(n, -1)
        free = list(range(n))
        while free:
            i = free.pop()
            gain = value[i] - price
            j = int(gain.argmax())
            best = gain[j]
            gain[j] = np.iinfo(np.int64).min
            price[j] += (best - gain.max() if n > 1 else 0) + eps
            if owner[j] >= 0:
                has[owner[j]] = -1
                free.append(int(owner[j]))
            owner[j], has[i] = i, j
        if eps == 1:
            break
        eps = max(1, eps // 8)
    rows = np.arange(cost.shape[0])
    ok = has[: len(rows)] < cost.shape[1]
    rows, cols = rows[ok], has[: len(ok)][ok]
    keep = np.isfinite(cost[rows, cols])
    return rows[keep], cols[keep]


SOLVERS = {"paths": solve, "auction": auction}


def solver(name: str = "paths"):  # noqa: ANN201
    """A solver by name: paths is exact, auction to the rounding of costs."""
    return SOLVERS[name]

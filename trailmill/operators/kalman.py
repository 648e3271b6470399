"""Constant-velocity Kalman filter over a box's centre, aspect and height."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

#: Noise as shares of the box height, for positions and for velocities; the aspect has noise of its own.
POSITION, VELOCITY, ASPECT, ASPECT_SPEED, ASPECT_SEEN = 1 / 20, 1 / 160, 1e-2, 1e-5, 1e-1
#: 95 % quantiles of chi-square by degrees of freedom.
CHI2_95 = {1: 3.8415, 2: 5.9915, 3: 7.8147, 4: 9.4877, 5: 11.070, 6: 12.592, 7: 14.067, 8: 15.507, 9: 16.919}
_MOVE = np.eye(8) + np.eye(8, k=4)


def _noise(h: float, place: float, speed: float, aspect: float) -> np.ndarray:
    p, v = place * POSITION * h, speed * VELOCITY * h
    return np.diag(np.square([p, p, aspect, p, v, v, ASPECT_SPEED, v]))


def initiate(box: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """State of a box seen for the first time, at rest."""
    return np.concatenate([box, np.zeros(4)]), _noise(box[3], 2, 10, ASPECT)


def predict(mean: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _MOVE @ mean, _MOVE @ cov @ _MOVE.T + _noise(mean[3], 1, 1, ASPECT)


def project(mean: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected measurement and its covariance."""
    p = POSITION * mean[3]
    return mean[:4], cov[:4, :4] + np.diag(np.square([p, p, ASPECT_SEEN, p]))


def update(mean: np.ndarray, cov: np.ndarray, box: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    seen, s = project(mean, cov)
    gain = np.linalg.solve(s, cov[:4]).T
    return mean + gain @ (box - seen), cov - gain @ s @ gain.T


def gating_distance(mean: np.ndarray, cov: np.ndarray, boxes: np.ndarray, only_position: bool = False) -> np.ndarray:
    """Squared Mahalanobis distances of boxes from the expected measurement."""
    seen, s = project(mean, cov)
    k = 2 if only_position else 4
    z = np.linalg.solve(np.linalg.cholesky(s[:k, :k]), (boxes[:, :k] - seen[:k]).T)
    return (z * z).sum(axis=0)


def path_distances(frames: np.ndarray, boxes: np.ndarray, skip_empty: bool = True) -> np.ndarray:
    """How far each box after the first lies from what the filter, run over the boxes in frame order, expects; without skip_empty it moves on over missing frames too."""
    order = np.argsort(frames, kind="stable")
    frames, boxes = frames[order], boxes[order]
    mean, cov = initiate(boxes[0])
    out = []
    for k in range(1, len(boxes)):
        for _ in range(1 if skip_empty else int(max(1, frames[k] - frames[k - 1]))):
            mean, cov = predict(mean, cov)
        out.append(gating_distance(mean, cov, boxes[k : k + 1])[0])
        mean, cov = update(mean, cov, boxes[k])
    return np.sqrt(np.array(out))


#: Which covariance an axis has: centre and height share one, the aspect has its own.
_AXES = np.array([0, 0, 1, 0])


def _spread(place: np.ndarray, aspect: float) -> np.ndarray:
    """Squares of a deviation for centre and height and of the aspect's, as rows."""
    return np.stack([place * place, np.full(len(place), aspect * aspect)])


@dataclass
class Filters:
    """Many filters in step, one a column. No axis ever correlates with another, so the covariance of a filter is one of place and speed for centre and height, and one for the aspect."""

    mean: np.ndarray  # 4 places
    speed: np.ndarray  # and their speeds
    cov: np.ndarray  # place with place, place with speed, speed with place, speed with speed; each for _AXES 0 and 1

    @classmethod
    def initiate(cls, boxes: np.ndarray) -> Filters:
        """Filters of boxes (4 rows) seen for the first time."""
        h = boxes[3]
        cov = np.zeros((4, 2, len(h)))
        cov[0], cov[3] = _spread(2 * POSITION * h, ASPECT), _spread(10 * VELOCITY * h, ASPECT_SPEED)
        return cls(boxes.copy(), np.zeros_like(boxes), cov)

    def take(self, which: np.ndarray) -> Filters:
        return Filters(self.mean[:, which], self.speed[:, which], self.cov[:, :, which])

    def put(self, which: np.ndarray, other: Filters) -> None:
        self.mean[:, which], self.speed[:, which], self.cov[:, :, which] = other.mean, other.speed, other.cov

    def join(self, other: Filters) -> Filters:
        return Filters(np.hstack([self.mean, other.mean]), np.hstack([self.speed, other.speed]), np.concatenate([self.cov, other.cov], axis=2))

    def predict(self) -> None:
        h = self.mean[3]
        place, speed = _spread(POSITION * h, ASPECT), _spread(VELOCITY * h, ASPECT_SPEED)
        pp, ps, sp, ss = self.cov
        self.mean = self.mean + self.speed
        self.cov = np.stack([(pp + sp) + (ps + ss) + place, ps + ss, sp + ss, ss + speed])

    def _seen(self) -> np.ndarray:
        return self.cov[0] + _spread(POSITION * self.mean[3], ASPECT_SEEN)

    def update(self, boxes: np.ndarray) -> None:
        s = self._seen()
        place, speed = self.cov[0] / s, self.cov[1] / s
        off = boxes - self.mean
        self.mean = self.mean + place[_AXES] * off
        self.speed = self.speed + speed[_AXES] * off
        a, b = place * s, speed * s
        self.cov = self.cov - np.stack([a * place, a * speed, b * place, b * speed])


def many_path_distances(frames: np.ndarray, boxes: np.ndarray, sizes: Sequence[int]) -> np.ndarray:
    """path_distances() of many paths without skipping missing frames, laid end to end (sizes of 2 at least, each path in frame order): a distance for each box, 0 for a path's first.

    A step takes the next box of every path, the longest paths first; what the filter adds on the way over missing frames is summed in closed form.
    """
    sizes = np.asarray(sizes)
    turn = np.argsort(-sizes, kind="stable")
    at = np.empty(len(sizes), np.int64)
    at[turn] = np.arange(len(sizes))
    first = np.cumsum(sizes) - sizes
    column, row = np.repeat(at, sizes), np.arange(len(frames)) - np.repeat(first, sizes)
    deep = int(sizes.max())
    box, gap, out = np.zeros((deep, 4, len(sizes))), np.ones((deep, len(sizes))), np.zeros((deep, len(sizes)))
    box[row, :, column] = boxes
    gap[row, column] = np.maximum(np.diff(frames, prepend=frames[:1]), 1)
    # sums of the powers 1 to 4 of 0, 1, ..., gap - 1
    n = gap - 1
    one, two = n * gap / 2, n * gap * (2 * n + 1) / 6
    three, four = one * one, two * (3 * n * n + 3 * n - 1) / 5
    f = Filters.initiate(box[0])
    mean, speed, (pp, ps, _, ss) = f.mean, f.speed, f.cov
    left = np.searchsorted(-sizes[turn], -np.arange(deep), "left")
    for k in range(1, deep):
        m = int(left[k])
        mean, speed, pp, ps, ss = mean[:, :m], speed[:, :m], pp[:, :m], ps[:, :m], ss[:, :m]
        g, s1, s2, s3, s4 = (x[k, :m] for x in (gap, one, two, three, four))
        # heights on the way, as seen from the last of them, and what their squares sum up to, plain, by steps to go and by their squares
        h = mean[3] + n[k, :m] * speed[3]
        hh, hv, vv = h * h, 2 * h * speed[3], speed[3] * speed[3]
        a0, a1, a2 = g * hh - s1 * hv + s2 * vv, s1 * hh - s2 * hv + s3 * vv, s2 * hh - s3 * hv + s4 * vv
        v, c = VELOCITY * VELOCITY, ASPECT_SPEED * ASPECT_SPEED
        mean = mean + g * speed
        pp = pp + g * (2 * ps + g * ss) + np.stack([POSITION * POSITION * a0 + v * a2, ASPECT * ASPECT * g + c * s2])
        ps = ps + g * ss + np.stack([v * a1, c * s1])
        ss = ss + np.stack([v * a0, c * g])
        seen = pp + _spread(POSITION * mean[3], ASPECT_SEEN)
        off = box[k, :, :m] - mean
        z = off * off / seen[_AXES]
        out[k, :m] = np.sqrt(z[0] + z[1] + z[2] + z[3])
        place, pull = pp / seen, ps / seen
        mean, speed = mean + place[_AXES] * off, speed + pull[_AXES] * off
        pp, ps, ss = pp - place * pp, ps - place * ps, ss - pull * ps
    return out[row, column]

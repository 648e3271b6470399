"""Greedy non-maximum suppression."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import per_frame


def keep_greedy(x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray, order: np.ndarray, max_overlap: float) -> np.ndarray:
    """Indices kept, in order of picking: each pick removes the boxes of which it covers more than max_overlap. Pixels count inclusively, so sizes and overlaps have one added."""
    area = (w + 1) * (h + 1)
    out, rest = [], np.asarray(order)
    while len(rest):
        i, rest = rest[0], rest[1:]
        out.append(i)
        ow = np.minimum(x[i] + w[i], x[rest] + w[rest]) - np.maximum(x[i], x[rest]) + 1
        oh = np.minimum(y[i] + h[i], y[rest] + h[rest]) - np.maximum(y[i], y[rest]) + 1
        rest = rest[np.maximum(ow, 0) * np.maximum(oh, 0) / area[rest] <= max_overlap]
    return np.array(out, int)


def suppress(det: DataFrame, *, max_overlap: float, keys: Sequence[str] = ("frame",), score: str | None = "score", id: str = "id") -> DataFrame:  # noqa: A002
    """det with a column pick: the order in which a row was picked in its frame, from 0, or null if it was suppressed.

    The highest score goes first, ties by smaller id; without a score the lowest bottom edge does. A frame is one task.
    """

    def one(x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray, ids: np.ndarray, *scores: np.ndarray) -> np.ndarray:
        x, y, w, h = (c.astype(float) for c in (x, y, w, h))
        first = scores[0].astype(float) if scores else y + h
        kept = keep_greedy(x, y, w, h, np.lexsort((ids, -first)), max_overlap)
        pick = np.full(len(x), -1)
        pick[kept] = np.arange(len(kept))
        return pick

    return per_frame(det, keys, [*"xywh", id, *([score] if score else [])], one, "pick")


def suppressed_once(det: DataFrame, *, max_overlap: float, keys: Sequence[str] = ("frame",), score: str = "score", id: str = "id") -> DataFrame:  # noqa: A002
    """keys and id of the rows that some row of higher score (ties: smaller id) of their frame covers by more than max_overlap: one round of suppression, as a join."""
    from .pairs import frame_pairs

    p = frame_pairs(det.select(*keys, id, score, *"xywh"), det.select(*keys, id, score, *"xywh"), keys)
    a, b = ({c: F.col(f"{s}_{c}") for c in (id, score, *"xywh")} for s in "ab")
    before = (a[score] > b[score]) | ((a[score] == b[score]) & (a[id] < b[id]))
    ow = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]) + 1
    oh = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]) + 1
    cover = F.greatest(ow, F.lit(0)) * F.greatest(oh, F.lit(0)) / ((b["w"] + 1) * (b["h"] + 1))
    return p.filter(before & (cover > max_overlap)).select(*keys, b[id].alias(id)).distinct()


def flag_ambiguous(det: DataFrame, *, max_overlap: float, min_score: float, keys: Sequence[str] = ("frame",), id: str = "id") -> DataFrame:  # noqa: A002
    """det with fp_flag: nms for the suppressed, score for those under min_score, null for the rest; both judged on all rows."""
    flag = F.when(F.col("pick").isNull(), "nms").when(F.col("score") < min_score, "score")
    return suppress(det, max_overlap=max_overlap, keys=keys, id=id).withColumn("fp_flag", flag).drop("pick")

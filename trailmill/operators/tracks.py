"""Track tables (seq, track_id, frame, id, class_id, score, x, y, w, h): filters, labels, holes, order, gap filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("seq", "track_id")


def lengths(tracks: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """key, n, first, last and holes (frames between first and last without a box)."""
    return tracks.groupBy(*key).agg(F.count("*").alias("n"), F.min("frame").alias("first"), F.max("frame").alias("last"), (F.max("frame") - F.min("frame") + 1 - F.count_distinct("frame")).alias("holes"))


def longer_than(tracks: DataFrame, least: int, key: Sequence[str] = KEY) -> DataFrame:
    """Rows of the tracks with at least least boxes. Counts are aggregated before they meet the rows."""
    ok = tracks.groupBy(*key).count().filter(F.col("count") >= least).select(*key)
    return tracks.join(ok, list(key), "left_semi")


def scored_over(tracks: DataFrame, least: float, how: str = "mean", key: Sequence[str] = KEY) -> DataFrame:
    """Rows of the tracks whose mean or maximum score is at least least."""
    agg = {"mean": F.avg, "max": F.max}[how]("score")
    ok = tracks.groupBy(*key).agg(agg.alias("_s")).filter(F.col("_s") >= least).select(*key)
    return tracks.join(ok, list(key), "left_semi")


def without_weak_singles(tracks: DataFrame, least: float, key: Sequence[str] = KEY) -> DataFrame:
    """Without the tracks of one box with a score under least."""
    weak = tracks.groupBy(*key).agg(F.count("*").alias("_n"), F.max("score").alias("_s")).filter((F.col("_n") == 1) & (F.col("_s") < least)).select(*key)
    return tracks.join(weak, list(key), "left_anti")


def majority_class(tracks: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """key and the class most of a track's boxes have; ties go to the class seen first."""
    per = tracks.groupBy(*key, "class_id").agg(F.count("*").alias("n"), F.min("frame").alias("first"))
    return per.groupBy(*key).agg(F.max_by("class_id", F.struct(F.col("n"), -F.col("first"), -F.col("class_id"))).alias("class_id"))


def class_corrections(tracks: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Rows whose class is not their track's majority class, with new_class."""
    m = majority_class(tracks, key).withColumnRenamed("class_id", "new_class")
    return tracks.join(m, list(key)).filter(F.col("class_id") != F.col("new_class"))


def conflicts(tracks: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Keys of tracks with two boxes in one frame."""
    return tracks.groupBy(*key, "frame").count().filter("count > 1").select(*key).distinct()


def by_length(tracks: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """key, n, first and rank: longest first, ties by first frame, then key."""
    n = lengths(tracks, key)
    return n.withColumn("rank", F.row_number().over(Window.partitionBy(key[0]).orderBy(F.desc("n"), "first", *key[1:])))


def fill_linear(tracks: DataFrame, *, key: Sequence[str] = KEY, columns: Sequence[str] = ("x", "y", "w", "h"), max_share: float | None = 0.5, min_length: int = 3, max_gap: int | None = None) -> DataFrame:
    """key, frame, columns and filled: the boxes and, between neighbours more than a frame apart, linearly interpolated ones.

    Only tracks of at least min_length boxes whose holes are fewer than max_share of their boxes are filled (all, with max_share None), and only gaps under max_gap frames.
    """
    w = Window.partitionBy(*key).orderBy("frame")
    nxt = {f"_{c}": F.lead(c).over(w) for c in ("frame", *columns)}
    part = Window.partitionBy(*key)
    n, holes = F.count("*").over(part), F.max("frame").over(part) - F.min("frame").over(part) + 1 - F.count("*").over(part)
    fits = F.lit(True) if max_share is None else (n >= min_length) & (holes < max_share * n)
    rows = tracks.select(*key, "frame", *columns).withColumns({**nxt, "_fits": fits})
    own = rows.select(*key, "frame", *[F.col(c).cast("double").alias(c) for c in columns], F.lit(False).alias("filled"))
    gap = rows.filter(F.col("_fits") & (F.col("_frame") - F.col("frame") > 1) & (F.lit(True) if max_gap is None else F.col("_frame") - F.col("frame") < max_gap))
    gap = gap.withColumn("_at", F.explode(F.sequence(F.col("frame") + 1, F.col("_frame") - 1)))
    t = (F.col("_at") - F.col("frame")) / (F.col("_frame") - F.col("frame"))
    made = gap.select(*key, F.col("_at").alias("frame"), *[(F.col(c) + (F.col(f"_{c}") - F.col(c)) * t).alias(c) for c in columns], F.lit(True).alias("filled"))
    return own.unionByName(made)


def clip_filled(boxes: DataFrame, width: Column, height: Column, slack: float = 10.0) -> DataFrame:
    """boxes (x, y, w, h) cut to the image; those that stick out by more than slack or have no size are dropped."""
    x1, y1, x2, y2 = F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h")
    ok = (x1 >= -slack) & (y1 >= -slack) & (x2 <= width + slack) & (y2 <= height + slack) & (F.col("w") > 0) & (F.col("h") > 0)
    a, b = F.greatest(x1, F.lit(0.0)), F.greatest(y1, F.lit(0.0))
    return boxes.filter(ok).withColumns({"x": a, "y": b, "w": F.least(x2, width) - a, "h": F.least(y2, height) - b})


def fill_curve(tracks: DataFrame, *, key: Sequence[str] = KEY, columns: Sequence[str] = ("x", "y", "w", "h"), degree: int = 3, beside: int = 10, max_gap: int | None = None) -> DataFrame:
    """key, frame, columns and filled: the boxes and, in the gaps between neighbours, boxes on smooth curves: of each column the polynomial of degree that lies nearest, by least squares, to the beside boxes before and after the gap (of a lower degree where there are too few).

    A track is one task. Gaps of max_gap frames and more stay open.
    """
    import numpy as np
    import pandas as pd

    kinds = {f.name: f.dataType.simpleString() for f in tracks.schema}
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in key], f"frame {kinds['frame']}", *[f"{c} double" for c in columns], "filled boolean"])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame").reset_index(drop=True)
        own = pdf[[*key, "frame", *columns]].assign(filled=False)
        frames, out = pdf["frame"].to_numpy(), [own.astype({c: float for c in columns})]
        for i in np.flatnonzero(np.diff(frames) > 1):
            gap = np.arange(frames[i] + 1, frames[i + 1])
            if max_gap is not None and len(gap) + 1 >= max_gap:
                continue
            near = slice(max(0, i + 1 - beside), i + 1 + beside)
            t = (frames[near] - frames[i]).astype(float)
            made = pd.DataFrame({**{k: pdf[k].iloc[0] for k in key}, "frame": gap})
            for c in columns:
                made[c] = np.polyval(np.polyfit(t, pdf[c].to_numpy(float)[near], min(degree, len(np.unique(t)) - 1)), (gap - frames[i]).astype(float))
            out.append(made.assign(filled=True))
        return pd.concat(out)[[*key, "frame", *columns, "filled"]]

    return tracks.select(*key, "frame", *columns).groupBy(*key).applyInPandas(one, schema)


def delete_boxes(tracks: DataFrame, which: DataFrame, keys: Sequence[str] = ("seq", "frame", "id")) -> DataFrame:
    """tracks without the boxes (keys) of which."""
    return tracks.join(which.select(*keys), list(keys), "left_anti")


def replace_boxes(tracks: DataFrame, edits: DataFrame, keys: Sequence[str] = ("seq", "frame", "id"), columns: Sequence[str] = ("x", "y", "w", "h")) -> DataFrame:
    """tracks with the columns of the boxes that edits (keys, columns) has taken from there; edits of boxes that aren't there change nothing."""
    new = edits.select(*keys, F.lit(True).alias("_edit"), *[F.col(c).alias(f"_{c}") for c in columns])
    j = tracks.join(new, list(keys), "left")
    return j.select(*[F.when(F.col("_edit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else c for c in tracks.columns])


def having_class(tracks: DataFrame, classes: Sequence[int], key: Sequence[str] = ("seq",)) -> DataFrame:
    """The different values of key with a box of one of the classes."""
    return tracks.filter(F.col("class_id").isin(*classes)).select(*key).distinct()

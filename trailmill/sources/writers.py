"""Sinks for track, detection and annotation tables."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import boxes


def mot_line(df: DataFrame, *, frame_shift: int = 1, id_shift: int = 1) -> Column:
    """A MOTChallenge result line of a row (frame, track_id, x, y, w, h)."""
    return F.format_string("%d,%d,%.2f,%.2f,%.2f,%.2f,1,-1,-1,-1", F.col("frame") + frame_shift, F.col("track_id") + id_shift, *[F.col(c).cast("double") for c in "xywh"])


def write_mot(df: DataFrame, path: str, *, seq: str = "seq", mode: str = "overwrite") -> None:
    """One folder a sequence; within a file lines are in frame order. Sequences are dealt by hash, so many are written at once."""
    rows = df.select(seq, "frame", "track_id", mot_line(df).alias("value")).repartition(seq).sortWithinPartitions(seq, "frame", "track_id")
    rows.select(seq, "value").write.mode(mode).partitionBy(seq).text(path)


def write_tracks(df: DataFrame, path: str, *, by: str = "length", mode: str = "overwrite") -> None:
    """Comma-separated frame, track, class and corners; tracks by length (longest first) or by first frame."""
    n = df.groupBy("track_id").agg(F.count("*").alias("_n"), F.min("frame").alias("_f"))
    order = [F.desc("_n"), F.col("_f")] if by == "length" else [F.col("_f"), F.desc("_n")]
    corners = boxes.to_corners(*[F.col(c) for c in "xywh"])
    df.join(n, "track_id").orderBy(*order, "track_id", "frame").select("frame", "track_id", "class_id", *[c.cast("int").alias(k) for c, k in zip(corners, ("x1", "y1", "x2", "y2"), strict=True)]).write.mode(mode).csv(path)


def write_boxes(df: DataFrame, path: str, *, columns: Sequence[str] = ("class_id", "x1", "y1", "x2", "y2"), mode: str = "overwrite") -> None:
    """Blank-separated rounded columns, a folder an image (column image)."""
    line = F.concat_ws(" ", *[F.bround(F.col(c).cast("double"), 0).cast("long").cast("string") if c != "score" else F.col(c).cast("string") for c in columns])
    df.select("image", line.alias("value")).write.mode(mode).partitionBy("image").text(path)


def append_new(old: DataFrame, new: DataFrame, columns: Sequence[str]) -> DataFrame:
    """old and those rows of new whose columns it doesn't have yet."""
    return old.unionByName(new.dropDuplicates(list(columns)).join(old.select(*columns), list(columns), "left_anti"))


def _iou(a: pd.Series, b: pd.Series) -> float:
    w = min(a.x2, b.x2) - max(a.x1, b.x1)
    h = min(a.y2, b.y2) - max(a.y1, b.y1)
    if w < 0 or h < 0:
        return 0.0
    area = lambda r: abs(r.x2 - r.x1) * abs(r.y2 - r.y1)
    return w * h / (area(a) + area(b) - w * h + boxes.EPSILON)


def add_boxes(old: DataFrame, new: DataFrame, *, threshold: float, replace: bool) -> DataFrame:
    """Boxes of each image after new ones come in, one after the other (column place): one that overlaps kept ones by more than threshold replaces them, or with replace False is left out."""
    cols = ["image", "class_id", "x1", "y1", "x2", "y2"]
    both = old.select(*cols, F.lit(0).alias("turn"), F.lit(0).cast("long").alias("place")).unionByName(new.select(*cols, F.lit(1).alias("turn"), F.col("place").cast("long")))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[pd.Series] = []
        for r in pdf.sort_values(["turn", "place"]).itertuples(index=False):
            clash = [k for k in kept if _iou(k, r) > threshold] if r.turn else []
            if clash and not replace:
                continue
            kept = [k for k in kept if k not in clash] + [r]
        return pd.DataFrame([(k.image, k.class_id, k.x1, k.y1, k.x2, k.y2) for k in kept], columns=cols)

    return both.groupBy("image").applyInPandas(fold, old.select(*cols).schema)


def write_voc(df: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """PASCAL VOC objects (name and corners) as XML."""
    box = F.struct(F.col("x1").alias("xmin"), F.col("y1").alias("ymin"), F.col("x2").alias("xmax"), F.col("y2").alias("ymax"))
    df.select(F.col("image").alias("filename"), F.col("label").alias("name"), box.alias("bndbox")).write.mode(mode).format("xml").option("rowTag", "object").option("rootTag", "annotation").save(path)


def write_yolo(df: DataFrame, path: str, *, width: Column, height: Column, mode: str = "overwrite") -> None:
    """YOLO label lines of corner boxes, a folder an image."""
    rel = boxes.to_relative(*boxes.to_size(*[F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")]), width, height)
    df.select("image", F.format_string("%d %.6f %.6f %.6f %.6f", F.col("class_id"), *rel).alias("value")).write.mode(mode).partitionBy("image").text(path)


NAMES = {"mota": "MOTA", "motp": "MOTP", "idf1": "IDF1", "idp": "IDP", "idr": "IDR", "recall": "Rcll", "precision": "Prcn", "num_unique_objects": "GT", "mostly_tracked": "MT", "partially_tracked": "PT", "mostly_lost": "ML", "num_false_positives": "FP", "num_misses": "FN", "num_switches": "IDs", "num_fragmentations": "FM", "num_transfer": "IDt", "num_ascend": "IDa", "num_migrate": "IDm"}
SHARES = ("mota", "idf1", "idp", "idr", "recall", "precision")


def render(summary: DataFrame) -> str:
    """The metrics of mot_summary as a text table: shares in per cent, columns by their usual short names. One line a sequence comes to the driver."""
    cols = [c for c in NAMES if c in summary.columns]
    pdf = summary.select("seq", *cols).toPandas().sort_values("seq", key=lambda s: s.where(s != "OVERALL", "￿"))
    for c in cols:
        pdf[c] = [("nan" if v is None or v != v else f"{v:.1%}" if c in SHARES else f"{v:.3f}" if c == "motp" else f"{int(v)}") for v in pdf[c]]
    return pdf.rename(columns=NAMES).to_string(index=False)

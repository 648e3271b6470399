"""Scans of detection, annotation and track files. Each gives flat rows with the file's path, by Spark's own readers and explicit schemas."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F



def path_tail(path: Column, parts: int = 2) -> Column:
    """The last parts of a path."""
    return F.array_join(F.slice(F.split(path, "/"), -parts, parts), "/") if parts > 1 else F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(path_tail(path, 1), r"\.[^.]*$", "")


def replace_extension(path: Column, ext: str) -> Column:
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit("." + ext))


def _lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return spark.read.text(path).select(F.col("value"), F.col("_metadata.file_path").alias("path")).filter(F.trim("value") != "")


def read_mot(spark: SparkSession, path: str | Sequence[str], *, min_confidence: float = -1.0, one_based: bool = True) -> DataFrame:
    """MOTChallenge text (frame, id, x, y, w, h, confidence, class, visibility, unused; commas, blanks or tabs): rows of at least min_confidence, with x and y from 0 when the file counts pixels from 1."""
    f = F.split(F.trim("value"), r"\s*,\s*|\s+")
    names = [("frame", "long"), ("id", "long"), ("x", "double"), ("y", "double"), ("w", "double"), ("h", "double"), ("confidence", "double"), ("class_id", "double"), ("visibility", "double")]
    rows = _lines(spark, path).select("path", *[F.try_element_at(f, F.lit(i + 1)).cast("double").cast(kind).alias(n) for i, (n, kind) in enumerate(names)])
    shift = 1.0 if one_based else 0.0
    return rows.withColumns({"x": F.col("x") - shift, "y": F.col("y") - shift, "class_id": F.col("class_id").cast("int")}).filter(F.col("confidence") >= min_confidence)


def read_vatic(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """VATIC text: corners to sizes, flags to booleans, the free attributes as an array."""
    f = F.split("value", " ")
    unquoted = lambda c: F.regexp_replace(c, '"', "")
    num = lambda i: F.get(f, F.lit(i)).cast("double")
    attrs = F.transform(F.slice(f, 11, F.greatest(F.size(f) - 10, F.lit(0))), unquoted)
    return _lines(spark, path).select(
        "path",
        num(5).cast("long").alias("frame"),
        num(0).cast("long").alias("id"),
        num(1).alias("x"),
        num(2).alias("y"),
        (num(3) - num(1)).alias("w"),
        (num(4) - num(2)).alias("h"),
        *[(num(6 + i) == 1).alias(n) for i, n in enumerate(("lost", "occluded", "generated"))],
        unquoted(F.get(f, F.lit(9))).alias("label"),
        attrs.alias("attrs"),
    )


def attribute_columns(df: DataFrame) -> DataFrame:
    """A boolean column for each attribute that occurs; the attributes, a handful of names, are listed first."""
    names = sorted(r[0] for r in df.select(F.explode("attrs").alias("a")).distinct().collect())
    return df.withColumns({n: F.array_contains("attrs", n) for n in names}).drop("attrs")


def read_detrac_xml(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """UA-DETRAC XML: one row a target, with confidence 1 and unknown class and visibility."""
    box = "box STRUCT<_left DOUBLE, _top DOUBLE, _width DOUBLE, _height DOUBLE>"
    schema = f"_num LONG, target_list STRUCT<target: ARRAY<STRUCT<_id: LONG, {box.replace('box STRUCT', 'box: STRUCT')}>>>"
    rows = spark.read.format("xml").option("rowTag", "frame").schema(schema).load(path)
    t = rows.select(F.col("_num").alias("frame"), F.explode("target_list.target").alias("t"))
    return t.select("frame", F.col("t._id").alias("id"), F.col("t.box._left").alias("x"), F.col("t.box._top").alias("y"), F.col("t.box._width").alias("w"), F.col("t.box._height").alias("h"), F.lit(1.0).alias("confidence"), F.lit(-1).alias("class_id"), F.lit(-1.0).alias("visibility"))


def read_boxes(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Annotation text: class x1 y1 x2 y2, one box a line."""
    f = F.split(F.trim("value"), r"\s+")
    return _lines(spark, path).select("path", *[F.get(f, F.lit(i)).cast("int").alias(n) for i, n in enumerate(("class_id", "x1", "y1", "x2", "y2"))])


def read_scored_boxes(spark: SparkSession, path: str | Sequence[str], *, score_last: bool = False, min_score: float = 0.0, strict: bool = False) -> DataFrame:
    """Detection text with the score second or last; a score outside 0 to 1 is an error. strict keeps only scores over min_score, else min_score too."""
    f = F.split(F.trim("value"), r"\s+")
    at = [0, 2, 3, 4, 5] if not score_last else [0, 1, 2, 3, 4]
    raw = F.get(f, F.lit(5 if score_last else 1)).cast("double")
    score = F.when(raw.between(0, 1), raw).otherwise(F.raise_error(F.concat(F.lit("score out of range: "), F.col("value"))).cast("double"))
    rows = _lines(spark, path).select("path", *[F.bround(F.get(f, F.lit(i)).cast("double")).cast("int").alias(n) for i, n in zip(at, ("class_id", "x1", "y1", "x2", "y2"), strict=True)], score.alias("score"))
    return rows.filter(F.col("score") > min_score if strict else F.col("score") >= min_score)


def read_json_detections(spark: SparkSession, path: str | Sequence[str], *, min_score: float = 0.0, parts: int = 2) -> DataFrame:
    """JSON arrays of image_path, category_id, bbox (x, y, w, h) and score; images are named by the last parts of their path. Several files are one scan."""
    rows = spark.read.option("multiLine", True).schema("image_path string, category_id int, bbox array<double>, score double").json(path)
    b = [F.get("bbox", F.lit(i)) for i in range(4)]
    return rows.filter(F.col("score") >= min_score).select(path_tail(F.col("image_path"), parts).alias("image"), F.col("category_id").alias("class_id"), *[c.alias(n) for c, n in zip(b, "xywh", strict=True)], "score")


def read_darknet_json(spark: SparkSession, path: str | Sequence[str], *, width: int, height: int, min_score: float = 0.0) -> DataFrame:
    """Darknet's JSON (objects with relative centre boxes), as corners."""
    from ..functions import boxes

    c = "relative_coordinates STRUCT<center_x: DOUBLE, center_y: DOUBLE, width: DOUBLE, height: DOUBLE>".replace("coordinates STRUCT", "coordinates: STRUCT")
    rows = spark.read.option("multiLine", True).schema(f"frame_id long, filename string, objects array<struct<class_id: int, name: string, {c}, confidence: double>>").json(path)
    o = rows.select(F.col("frame_id").alias("frame"), F.col("filename").alias("image"), F.explode("objects").alias("o")).filter(F.col("o.confidence") >= min_score)
    corners = boxes.from_relative(*[F.col(f"o.relative_coordinates.{n}") for n in ("center_x", "center_y", "width", "height")], F.lit(width), F.lit(height))
    return o.select("frame", "image", F.col("o.class_id").alias("class_id"), *[x.alias(n) for x, n in zip(corners, ("x1", "y1", "x2", "y2"), strict=True)], F.col("o.confidence").alias("score"))


def read_yolo(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """YOLO label text: class and relative centre box."""
    f = F.split(F.trim("value"), r"\s+")
    return _lines(spark, path).select("path", F.get(f, F.lit(0)).cast("int").alias("class_id"), *[F.get(f, F.lit(i + 1)).cast("double").alias(n) for i, n in enumerate(("cx", "cy", "w", "h"))])


def read_lanes(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Lane segments: x1 y1 x2 y2."""
    f = F.split(F.trim("value"), r"\s+")
    return _lines(spark, path).select("path", *[F.get(f, F.lit(i)).cast("int").alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])


def read_ini(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """path, key and value of the lines with an equals sign."""
    f = F.split("value", "=", 2)
    return _lines(spark, path).filter(F.col("value").contains("=")).select("path", F.trim(F.get(f, F.lit(0))).alias("key"), F.trim(F.get(f, F.lit(1))).alias("value"))


def read_sequence_map(spark: SparkSession, path: str) -> DataFrame:
    """Names of sequences; blank lines, comments and the heading are skipped."""
    return _lines(spark, path).select(F.trim("value").alias("seq")).filter(~F.col("seq").startswith("#") & (F.col("seq") != "name"))


def read_npy_detections(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Detection matrices saved by NumPy: 10 MOT columns, then a feature vector."""
    kind = "path string, frame long, id long, x double, y double, w double, h double, confidence double, feature array<float>"

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, data in zip(b["path"], b["content"], strict=True):
                m = np.load(io.BytesIO(data), allow_pickle=False)
                cols = {n: m[:, i] for i, n in enumerate(("frame", "id", "x", "y", "w", "h", "confidence"))}
                yield pd.DataFrame({"path": p} | cols | {"feature": list(m[:, 10:].astype(np.float32))})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, kind)


def skip_frames(mot: DataFrame, skip: int) -> DataFrame:
    """Every (skip + 1)th frame from the first, counted anew."""
    step = skip + 1
    return mot.filter(F.pmod("frame", F.lit(step)) == (1 if skip else 0)).withColumn("frame", F.floor(F.col("frame") / step) + 1) if skip else mot


READERS = {"mot": read_mot, "mot16": read_mot, "mot15-2d": read_mot, "vatic": read_vatic, "detrac-xml": read_detrac_xml, "boxes": read_boxes, "yolo": read_yolo, "lanes": read_lanes}


def read_tracks(spark: SparkSession, path: str | Sequence[str], kind: str, **options: object) -> DataFrame:
    """Scan by the name of a format."""
    if kind not in READERS:
        raise ValueError(f"unknown format {kind}; known: {sorted(READERS)}")
    return READERS[kind](spark, path, **options)


def box_frames(mot: DataFrame, *, min_height: float = 0.0) -> DataFrame:
    return mot.filter(F.col("h") >= min_height)


def read_svmlight(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """label, qid (null without one), and the parallel arrays idx and val of svmlight text; comments are dropped."""
    f = F.split(F.trim(F.regexp_replace("value", "#.*$", "")), r"\s+")
    pairs = F.filter(F.slice(f, 2, F.greatest(F.size(f) - 1, F.lit(0))), lambda x: x.contains(":"))
    key = lambda x: F.element_at(F.split(x, ":"), 1)
    val = lambda x: F.element_at(F.split(x, ":"), 2)
    items = F.filter(pairs, lambda x: key(x) != "qid")
    qid = F.try_element_at(F.filter(pairs, lambda x: key(x) == "qid"), F.lit(1))
    rows = _lines(spark, path).filter(F.trim(F.regexp_replace("value", "#.*$", "")) != "")
    return rows.select("path", F.get(f, F.lit(0)).cast("double").alias("label"), val(qid).cast("long").alias("qid"), F.transform(items, lambda x: key(x).cast("long")).alias("idx"), F.transform(items, lambda x: val(x).cast("double")).alias("val"))

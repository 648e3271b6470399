"""Joins of boxes and vectors: pairs of a frame, mutual nearest neighbours, links over frame gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes, vectors

BOX = ("x", "y", "w", "h")


def renamed(df: DataFrame, prefix: str, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys, *[F.col(c).alias(prefix + c) for c in df.columns if c not in keys])


def frame_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """All pairs of rows of the same frame, columns prefixed a_ and b_: one equal join on the frame, which is small by nature."""
    return renamed(left, "a_", keys).join(renamed(right, "b_", keys), list(keys))


def _box(prefix: str) -> tuple[Column, ...]:
    return tuple(F.col(prefix + c) for c in BOX)


def iou_pairs(left: DataFrame, right: DataFrame, *, max_distance: float = 1.0, keys: Sequence[str] = ("frame",), id: str = "id") -> DataFrame:  # noqa: A002
    """keys, a, b and distance 1 - IoU of each pair of a frame; pairs over max_distance are left out (no edge)."""
    sides = [d.select(*keys, id, "x", "y", *[c.alias(n) for c, n in zip(boxes.far_ends(*[F.col(c) for c in BOX]), ("x2", "y2", "area"), strict=True)]) for d in (left, right)]
    p = frame_pairs(*sides, keys)
    meet = boxes.corner_overlap(*[tuple(F.col(s + c) for c in ("x", "y", "x2", "y2")) for s in ("a_", "b_")])
    p = p.select(*keys, F.col(f"a_{id}").alias("a"), F.col(f"b_{id}").alias("b"), meet.alias("_i"), (F.col("a_area") + F.col("b_area")).alias("_both"))
    # the array keeps filters on the distance out of the join's condition: several copies of its formula there make a method that the JVM never compiles
    d = 1 - boxes.iou_of(F.col("_i"), F.col("_both"))
    return p.select(*keys, "a", "b", F.explode(F.array(d)).alias("distance")).filter(F.col("distance") <= max_distance)


def squared_pairs(left: DataFrame, right: DataFrame, columns: Sequence[str], *, max_squared: float = float("inf"), keys: Sequence[str] = ("frame",), id: str = "id") -> DataFrame:  # noqa: A002
    """keys, a, b and squared Euclidean distance over columns, up to max_squared."""
    p = frame_pairs(left.select(*keys, id, *columns), right.select(*keys, id, *columns), keys)
    d = sum((F.pow(F.col(f"a_{c}") - F.col(f"b_{c}"), F.lit(2)) for c in columns), F.lit(0.0))
    return p.select(*keys, F.col(f"a_{id}").alias("a"), F.col(f"b_{id}").alias("b"), d.alias("distance")).filter(F.col("distance") <= max_squared)


def cosine_pairs(left: DataFrame, right: DataFrame, *, keys: Sequence[str], id: str = "id", vector: str = "feature", max_distance: float = 2.0) -> DataFrame:  # noqa: A002
    """keys, a, b and cosine distance of the vectors of each pair of a frame. Norms are taken once a row, before the join."""
    sides = [d.select(*keys, id, F.col(vector), vectors.norm(F.col(vector)).alias("n")) for d in (left, right)]
    p = frame_pairs(*sides, keys)
    d = 1 - F.try_divide(vectors.dot(F.col(f"a_{vector}"), F.col(f"b_{vector}")), F.col("a_n") * F.col("b_n"))
    return p.select(*keys, F.col(f"a_{id}").alias("a"), F.col(f"b_{id}").alias("b"), d.alias("distance")).filter(F.col("distance") <= max_distance)


def mutual_nearest(pairs: DataFrame, *, keys: Sequence[str] = ("frame",), max_distance: float = float("inf"), similarity: bool = False) -> DataFrame:
    """Pairs that are each other's nearest (or most alike) in their frame; ties go to the smaller b, then a. Only pairs under max_distance count (for similarity: over it)."""
    d = F.col("distance")
    order = d.desc() if similarity else d.asc()
    near = pairs.filter(d > max_distance if similarity and max_distance != float("inf") else d < max_distance if not similarity else F.lit(True))
    by_a = F.row_number().over(Window.partitionBy(*keys, "a").orderBy(order, "b"))
    by_b = F.row_number().over(Window.partitionBy(*keys, "b").orderBy(order, "a"))
    return near.withColumns({"_a": by_a, "_b": by_b}).filter("_a = 1 and _b = 1").drop("_a", "_b")


def align_frames(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """Every frame of either side with its numbers of rows: n_left and n_right, 0 where a side lacks the frame."""
    a = left.groupBy(*keys).agg(F.count("*").alias("n_left"))
    b = right.groupBy(*keys).agg(F.count("*").alias("n_right"))
    return a.join(b, list(keys), "full").na.fill(0, ["n_left", "n_right"])


def gap_links(det: DataFrame, *, max_gap: int, max_distance: float, seq: str = "seq", frame: str = "frame", id: str = "id", distance: Column | None = None) -> DataFrame:  # noqa: A002
    """Links a -> b between detections 1 to max_gap frames apart, smallest gap first: at each gap, tails without a successor meet heads without a predecessor and mutual nearest pairs under max_distance are linked.

    distance is an expression over columns a_... and b_...; the default is Euclidean over corners. Each gap is one equal join on the frame number, not a
    range join.
    """
    links = None
    d = distance if distance is not None else boxes.corner_distance(boxes.to_corners(*_box("a_")), boxes.to_corners(*_box("b_")))
    left = det.select(seq, *[F.col(c).alias(f"a_{c}") for c in det.columns if c != seq])
    right = det.select(seq, *[F.col(c).alias(f"b_{c}") for c in det.columns if c != seq])
    for gap in range(1, max_gap + 1):
        a, b = left, right
        if links is not None:
            a = a.join(links.select(seq, F.col("a").alias(f"a_{id}")), [seq, f"a_{id}"], "left_anti")
            b = b.join(links.select(seq, F.col("b").alias(f"b_{id}")), [seq, f"b_{id}"], "left_anti")
        met = a.withColumn("_f", F.col(f"a_{frame}") + gap).join(b.withColumn("_f", F.col(f"b_{frame}")), [seq, "_f"])
        found = met.select(seq, F.col("_f").alias("frame"), F.col(f"a_{id}").alias("a"), F.col(f"b_{id}").alias("b"), d.alias("distance"))
        new = mutual_nearest(found, keys=(seq, "frame"), max_distance=max_distance).select(seq, "a", "b", "distance", F.lit(gap).alias("gap"))
        links = new if links is None else links.unionByName(new)
    return links


def gap_pairs(det: DataFrame, *, max_gap: int, seq: str = "seq", frame: str = "frame", id: str = "id", distance: Column | None = None) -> DataFrame:  # noqa: A002
    """seq, a, b and distance of all pairs of detections 1 to max_gap frames apart, a the earlier one, however far they are. distance is as in gap_links(); all gaps are one equal join on the frame number."""
    d = distance if distance is not None else boxes.corner_distance(boxes.to_corners(*_box("a_")), boxes.to_corners(*_box("b_")))
    left = det.select(seq, F.explode(F.sequence(F.col(frame) + 1, F.col(frame) + max_gap)).alias("_f"), *[F.col(c).alias(f"a_{c}") for c in det.columns if c != seq])
    right = det.select(seq, F.col(frame).alias("_f"), *[F.col(c).alias(f"b_{c}") for c in det.columns if c != seq])
    return left.join(right, [seq, "_f"]).select(seq, F.col(f"a_{id}").alias("a"), F.col(f"b_{id}").alias("b"), d.alias("distance"))

"""Box arithmetic as Column expressions; corners (x1, y1, x2, y2) or top-left and size (x, y, w, h)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-5


def corner_area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Area between two corners in any order."""
    return F.abs(x2 - x1) * F.abs(y2 - y1)


def overlap(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection area of two boxes x, y, w, h; 0 where they don't meet."""
    return corner_overlap(to_corners(*a), to_corners(*b))


def corner_overlap(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """overlap() of boxes x1, y1, x2, y2."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def far_ends(x: Column, y: Column, w: Column, h: Column) -> tuple[Column, ...]:
    """Right and lower end and area of a box; negative sizes count as 0."""
    w, h = F.greatest(w, F.lit(0.0)), F.greatest(h, F.lit(0.0))
    return x + w, y + h, w * h


def iou_of(i: Column, both: Column) -> Column:
    """Intersection over union from the area of the intersection and the sum of both areas; 0 where there is none."""
    return F.when(i == 0, F.lit(0.0)).otherwise(i / (both - i))


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of boxes x, y, w, h; 0 where they don't meet, and for boxes without area. Negative sizes count as 0."""
    a = (*a[:2], F.greatest(a[2], F.lit(0.0)), F.greatest(a[3], F.lit(0.0)))
    b = (*b[:2], F.greatest(b[2], F.lit(0.0)), F.greatest(b[3], F.lit(0.0)))
    return iou_of(overlap(a, b), a[2] * a[3] + b[2] * b[3])


def corner_iou(a: tuple[Column, ...], b: tuple[Column, ...], epsilon: float = EPSILON) -> Column:
    """Intersection over union of boxes x1, y1, x2, y2, with epsilon added to the union; 0 where width or height of the intersection is negative."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    i = w * h
    union = corner_area(*a) + corner_area(*b) - i + epsilon
    return F.when((w < 0) | (h < 0), F.lit(0.0)).otherwise(i / union)


def corner_distance(a: tuple[Column, ...], b: tuple[Column, ...], same_class: Column | None = None) -> Column:
    """Euclidean distance over the four corner coordinates; infinite where same_class is false."""
    d = F.sqrt(sum((F.pow(p - q, F.lit(2)) for p, q in zip(a, b, strict=True)), F.lit(0.0)))
    return d if same_class is None else F.when(same_class, d).otherwise(F.lit(float("inf")))


def to_corners(x: Column, y: Column, w: Column, h: Column) -> tuple[Column, ...]:
    return x, y, x + w, y + h


def to_size(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, ...]:
    return x1, y1, x2 - x1, y2 - y1


def to_centre(x: Column, y: Column, w: Column, h: Column) -> tuple[Column, ...]:
    """Centre and size."""
    return x + w / 2, y + h / 2, w, h


def to_aspect(x: Column, y: Column, w: Column, h: Column) -> tuple[Column, ...]:
    """Centre, width by height (null for no height) and height."""
    return x + w / 2, y + h / 2, F.try_divide(w, h), h


def to_relative(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> tuple[Column, ...]:
    """Centre and size as shares of the image."""
    return F.try_divide(x + w / 2, width), F.try_divide(y + h / 2, height), F.try_divide(w, width), F.try_divide(h, height)


def from_relative(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column) -> tuple[Column, ...]:
    """Rounded corners of a box given by shares of the image."""
    return tuple(F.bround(c, 0).cast("int") for c in ((cx - w / 2) * width, (cy - h / 2) * height, (cx + w / 2) * width, (cy + h / 2) * height))


def is_valid(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """Whether the corners are in order and within the image."""
    return (x1 >= 0) & (x1 < x2) & (x2 < width) & (y1 >= 0) & (y1 < y2) & (y2 < height)


def clip(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, margin: int = 5) -> tuple[Column, ...]:
    """Corners within the image and in order; a box without width or height is widened by margin, inwards at the far edge. Rounded half to even."""

    def span(a: Column, b: Column, size: Column) -> tuple[Column, Column]:
        last = size - 1
        a, b = F.greatest(F.least(a, last), F.lit(0)), F.greatest(F.least(b, last), F.lit(0))
        lo, hi = F.least(a, b), F.greatest(a, b)
        flat = lo == hi
        far = lo + margin > last
        lo2 = F.when(flat & far, F.greatest(lo - margin, F.lit(0))).otherwise(lo)
        hi2 = F.when(flat & ~far, hi + margin).otherwise(hi)
        return F.bround(lo2, 0).cast("int"), F.bround(hi2, 0).cast("int")

    left, right = span(x1, x2, width)
    top, bottom = span(y1, y2, height)
    return left, top, right, bottom


def quiet_divide(a: Column, b: Column) -> Column:
    """a / b where b is not 0; NaN for 0 by 0, else a signed infinity."""
    inf = F.lit(float("inf"))
    return F.when(b != 0, F.try_divide(a, b)).when(a == 0, F.lit(float("nan"))).when(a > 0, inf).when(a < 0, -inf)

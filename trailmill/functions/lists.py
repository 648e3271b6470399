"""Set, list and path helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shared(a: Column, b: Column) -> Column:
    """Elements of both lists, each once."""
    return F.array_intersect(a, b)


def difference(a: Column, b: Column) -> Column:
    """struct(left, right): elements of one list that the other lacks."""
    return F.struct(F.array_except(a, b).alias("left"), F.array_except(b, a).alias("right"))


def flatten_distinct(a: Column) -> Column:
    """Elements of a list of lists, each once."""
    return F.array_distinct(F.flatten(a))


def repeated(a: Column) -> Column:
    """Elements that occur more than once, each once, in order."""
    kinds = F.array_sort(F.array_distinct(a))
    return F.filter(kinds, lambda x: F.size(F.filter(a, lambda y: y == x)) > 1)


def counts(a: Column) -> Column:
    """struct(item, n) of each element, commonest first, ties by element."""
    pairs = F.transform(F.array_sort(F.array_distinct(a)), lambda x: F.struct((-F.size(F.filter(a, lambda y: y == x))).alias("m"), x.alias("item")))
    return F.transform(F.array_sort(pairs), lambda s: F.struct(s["item"].alias("item"), (-s["m"]).alias("n")))


def jaccard(a: Column, b: Column) -> Column:
    """Shared by all elements; 0 for two empty lists."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(0.0))


def natural_key(s: Column) -> Column:
    """A string that sorts as people sort names with numbers: digits are padded to 20 places."""
    parts = F.regexp_extract_all(F.lower(s), F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(p, 20, "0")).otherwise(p)), "")


def relative_path(path: Column, root: str) -> Column:
    """path below root; unchanged if it isn't there."""
    top = root.rstrip("/") + "/"
    return F.when(path.startswith(top), F.substr(path, F.lit(len(top) + 1))).otherwise(path)


def with_suffix(path: Column, suffix: str) -> Column:
    """path with suffix before its extension."""
    ext = F.regexp_extract(path, r"(\.[^./]*)$", 1)
    return F.concat(F.substr(path, F.lit(1), F.char_length(path) - F.char_length(ext)), F.lit(suffix), ext)

"""Connected components of links between longs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.links import members


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (u, v: long) but the roots themselves: root is the smallest node reachable."""
    return members(edges.select(F.col("u").cast("long"), F.col("v").cast("long")), a="u", b="v", max_rounds=max_rounds)

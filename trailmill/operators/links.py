"""Link tables (a, b, confidence, ambiguity): chains, components, merging and comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import discard, stored


def _star(edges: DataFrame, large: bool) -> tuple[DataFrame, DataFrame]:
    """Link each node's larger (large) or smaller neighbours to the smallest node among it and them; also the table to discard once the links are stored."""
    both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    # stored, so that the join with a node of very many links is of two plain exchanges, which Spark splits
    low = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
    near = both.join(low.select(F.col("u").alias("_u"), "m"), F.col("u") == F.col("_u"))
    linked = near.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")) if large else near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    return linked.filter("u <> v").distinct(), low


def _are_stars(now: DataFrame) -> bool:
    """Whether every node of links u > v has one link down or only links up: then v is the root of u."""
    ends = now.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(now.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down > 1 OR down = 1 AND up = 1").isEmpty()


def members(edges: DataFrame, *, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges but the roots themselves: root is the smallest node reachable. Found by alternating large-star and small-star steps until nothing but stars is left, in about the logarithm of the longest path; links that are stars
    to the smallest node already cost one look.

    Nodes may be of any type with an order. Every round is cut from its lineage by a table in the shared folder. Self-links, repeated links and rows with a null end are no matter; without links the result is empty. RuntimeError beyond max_rounds.
    """
    ends = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    now = stored(ends.filter("u <> v").distinct(), "links")
    for _ in range(max_rounds):
        if _are_stars(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        large, low = _star(now, True)
        small, lower = _star(large, False)
        new = stored(small, "links")
        discard(now, low, lower)
        now = new
    raise RuntimeError(f"no fixed point within {max_rounds} rounds")


def components(edges: DataFrame, *, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node with links, self-links included: members() and the roots."""
    found = members(edges, a=a, b=b, max_rounds=max_rounds)
    alone = edges.filter(F.col(a) == F.col(b)).select(F.col(a).alias("root"))
    tops = found.select("root").union(alone).distinct().join(found.select(F.col("node").alias("root")), "root", "left_anti")
    return found.unionByName(tops.select(F.col("root").alias("node"), "root"))


def chains(links: DataFrame, *, a: str = "a", b: str = "b", max_rounds: int = 40) -> DataFrame:
    """(head, node, place) of chains of next-pointers a -> b, each node with one successor and one predecessor at most: place counts from 0. Pointers double their reach each round."""
    nodes = links.select(F.col(a).alias("node")).union(links.select(F.col(b))).filter("node is not null").distinct()
    back = links.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(b).alias("node"), F.col(a).alias("to"))
    now = stored(nodes.join(back, "node", "left").select("node", F.coalesce("to", "node").alias("head"), F.when(F.col("to").isNull(), 0).otherwise(1).alias("place")), "chains")
    was = None
    for _ in range(max_rounds):
        total = now.agg(F.sum("place")).head()[0]
        if total == was:
            return now
        was = total
        up = now.select(F.col("node").alias("head"), F.col("head").alias("next"), F.col("place").alias("more"))
        new = stored(now.join(up, "head").select("node", F.col("next").alias("head"), (F.col("place") + F.col("more")).alias("place")), "chains")
        discard(now)
        now = new
    raise RuntimeError("chains did not settle; are there cycles?")


def merge(first: DataFrame, second: DataFrame) -> DataFrame:
    """Links of both tables (a, b); an error where they send one node to different successors."""
    s = second.select("a", F.col("b").alias("b2"))
    clash = F.col("b").isNotNull() & F.col("b2").isNotNull() & (F.col("b") != F.col("b2"))
    joined = first.select("a", "b").join(s, "a", "full")
    return joined.select("a", F.when(clash, F.raise_error(F.lit("links contradict each other"))).otherwise(F.coalesce("b", "b2")).alias("b"))


def compare(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row: links only in the first table, only in the second, the same in both, different."""
    j = first.select("a", "b").join(second.select("a", F.col("b").alias("b2")), "a", "full")
    l, r = F.col("b"), F.col("b2")  # noqa: E741
    return j.agg(F.count_if(l.isNotNull() & r.isNull()).alias("only_first"), F.count_if(l.isNull() & r.isNotNull()).alias("only_second"), F.count_if(l == r).alias("same"), F.count_if(l != r).alias("different"))


def drop_doubtful(links: DataFrame, *, min_confidence: float, max_ambiguity: float) -> DataFrame:
    """links with b null where confidence is under or ambiguity over the limit."""
    doubt = (F.col("confidence") < min_confidence) | (F.col("ambiguity") > max_ambiguity)
    return links.withColumn("b", F.when(~doubt, F.col("b")))


def confident(links: DataFrame, *, min_score: float, order: Column | None = None) -> DataFrame:
    """Existing links of at least min_score, the surest first."""
    return links.filter(F.col("b").isNotNull() & (F.col("confidence") >= min_score)).orderBy(order if order is not None else F.desc("confidence"), "a")


def tree_heads(merges: DataFrame) -> DataFrame:
    """The nodes of a merge tree (node, left, right) that no other merge takes: one for each tree."""
    kids = merges.select(F.explode(F.array("left", "right")).alias("node"))
    return merges.select("node").join(kids, "node", "left_anti")


def tree_leaves(merges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(head, leaf) for every leaf of each tree of merges (node, left, right): pointers from each node to the one above it double their reach every round."""
    up = merges.select(F.explode(F.array("left", "right")).alias("node"), F.col("node").alias("up"))
    leaves = up.select("node").join(merges.select("node"), "node", "left_anti")
    now = stored(up.unionByName(tree_heads(merges).select("node", F.col("node").alias("up"))), "tree")
    for _ in range(max_rounds):
        far = now.select(F.col("node").alias("up"), F.col("up").alias("top"))
        new = stored(now.join(far, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "tree")
        discard(now)
        now = new.select("node", "up")
        now._stored_at = new._stored_at
        if new.filter("moved").isEmpty():
            return leaves.join(now, "node").select(F.col("up").alias("head"), F.col("node").alias("leaf"))
    raise RuntimeError(f"no end within {max_rounds} rounds")

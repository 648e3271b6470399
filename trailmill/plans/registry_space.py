"""The registered queries of the tree of boxes, spanning forests and clustering features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import birch, clustering, neighbors, space_tree, spanning
from . import tables as t
from .registry import query, rounded

C = F.col

# ---- neighbours by a tree of boxes

#: Events as points: two coordinates with very many ties, and a value.
SPOTS = "p AS (SELECT event_id AS id, user_id, CAST(event_id % 97 AS DOUBLE) AS x, CAST(event_id % 89 AS DOUBLE) AS y, CAST(value AS DOUBLE) AS z FROM events)"
_GAP = "sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))"
SPOT_KNN = f"WITH {SPOTS}, n AS (SELECT query_id, id, d AS distance, r AS rank FROM (SELECT a.id AS query_id, b.id, {_GAP} AS d, CAST(row_number() OVER (PARTITION BY a.id ORDER BY round({_GAP}, 9), b.id) AS INT) AS r FROM p a JOIN p b ON a.id % 20 = 0 AND a.id <> b.id) WHERE r <= 5)"


def spots(spark: SparkSession, sf: str) -> DataFrame:
    return t.read(spark, sf, "events").selectExpr("event_id AS id", "user_id", "array(CAST(event_id % 97 AS DOUBLE), CAST(event_id % 89 AS DOUBLE), CAST(value AS DOUBLE)) AS v")


@query(f"{SPOT_KNN} SELECT query_id, id, round(distance, 6) AS distance, rank FROM n")
def tree_knn(spark: SparkSession, sf: str) -> DataFrame:
    p = spots(spark, sf)
    return rounded(space_tree.SpaceTree(p).nearest(p.filter("id % 20 = 0"), k=5), "distance")


@query(f"{SPOT_KNN} SELECT n.query_id, round(avg(p.z), 6) AS prediction FROM n JOIN p USING (id) GROUP BY n.query_id")
def tree_knn_regress(spark: SparkSession, sf: str) -> DataFrame:
    p = spots(spark, sf)
    near = space_tree.SpaceTree(p).nearest(p.filter("id % 20 = 0"), k=5)
    return rounded(neighbors.average(near, p.select("id", C("v")[2].alias("value"))), "prediction")


@query(f"WITH {SPOTS} SELECT a.id AS query_id, b.id, round({_GAP}, 6) AS distance FROM p a JOIN p b ON a.id % 20 = 0 AND a.id <> b.id AND {_GAP} <= 4")
def tree_radius(spark: SparkSession, sf: str) -> DataFrame:
    p = spots(spark, sf)
    return rounded(space_tree.SpaceTree(p).nearest(p.filter("id % 20 = 0"), radius=4.0), "distance")


# ---- spanning forests

REACH = 8.0
#: Events scattered over a plane, and all pairs within REACH, found by cells of that width.
SCATTER = f"""WITH RECURSIVE p AS (SELECT event_id AS id, event_id * 7919 % 1009 AS x, event_id * 104729 % 997 AS y FROM events), step AS (SELECT unnest([-1, 0, 1]) AS d),
pair AS (SELECT a.id AS a, b.id AS b, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d FROM p a, step i, step j, p b WHERE b.x // 8 = a.x // 8 + i.d AND b.y // 8 = a.y // 8 + j.d AND a.id <> b.id AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= {REACH * REACH})"""
HEIGHTS = [2.0, 5.0, 8.0]
_AT = "h AS (SELECT unnest([2.0::DOUBLE, 5.0, 8.0]) AS h)"
CUT = f"{SCATTER}, {_AT}, reach(h, id, root) AS (SELECT h, id, id FROM h, p UNION SELECT r.h, r.id, pair.b FROM reach r JOIN pair ON pair.a = r.root AND pair.d <= r.h), cut AS (SELECT h, id, min(root) AS cluster FROM reach GROUP BY h, id)"


def scatter(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The different points (id: smallest of its events, n), (id, spot) of all events, and (a, b, distance) of the pairs of different points, by the tree of boxes. Copies of a point are at distance 0 and fare alike."""
    p = t.read(spark, sf, "events").selectExpr("event_id AS id", "array(CAST(event_id * 7919 % 1009 AS DOUBLE), CAST(event_id * 104729 % 997 AS DOUBLE)) AS v")
    s, members = clustering.spots(p)
    near = space_tree.SpaceTree(s.select("id", "v")).nearest(s.select("id", "v"), radius=REACH)
    return s.select("id", "n"), members, near.filter("query_id < id").select(C("query_id").alias("a"), C("id").alias("b"), "distance")


@query(f"{CUT} SELECT h AS height, id, cluster FROM cut")
def linkage_cuts(spark: SparkSession, sf: str) -> DataFrame:
    """Single linkage at three heights, all cut from one spanning forest."""
    nodes, members, pairs = scatter(spark, sf)
    cut = spanning.clusters_at(nodes, spanning.spanning_forest(pairs.withColumnRenamed("distance", "w")), HEIGHTS)
    return members.join(cut.withColumnRenamed("id", "spot"), "spot").select("height", "id", "cluster")


@query(f"{CUT} SELECT h AS height, count(*) - count(DISTINCT cluster) AS merges FROM cut GROUP BY h")
def linkage_merges(spark: SparkSession, sf: str) -> DataFrame:
    """The forest's weights are the heights at which single linkage merges: up to each height as many as SQL's components are fewer than rows."""
    nodes, _, pairs = scatter(spark, sf)
    w = spanning.heights(spanning.spanning_forest(pairs.withColumnRenamed("distance", "w")))
    w = w.unionByName(nodes.agg(F.lit(0.0).alias("height"), F.sum(C("n") - 1).alias("merges")))
    upto = [F.struct(F.lit(h).alias("height"), F.coalesce(F.sum(F.when(C("height") <= h, C("merges"))), F.lit(0)).alias("merges")) for h in HEIGHTS]
    return w.agg(F.array(*upto).alias("u")).select(F.explode("u").alias("u")).select("u.height", "u.merges")


@query(f"""{SCATTER}, {_AT}, dense AS (SELECT h, a AS id FROM h JOIN pair ON d <= h GROUP BY h, a HAVING count(*) >= 2), inner_pair AS (SELECT x.h, a, b FROM pair JOIN dense x ON x.id = a JOIN dense y ON y.id = b AND y.h = x.h WHERE d <= x.h),
reach(h, id, root) AS (SELECT h, id, id FROM dense UNION SELECT r.h, r.id, q.b FROM reach r JOIN inner_pair q ON q.h = r.h AND q.a = r.root), cut AS (SELECT h, id, min(root) AS cluster FROM reach GROUP BY h, id) SELECT h.h AS radius, p.id, cluster FROM h JOIN p ON true LEFT JOIN cut ON cut.h = h.h AND cut.id = p.id""")
def density_cuts(spark: SparkSession, sf: str) -> DataFrame:
    """Density clusters at three radii, all from one forest of mutual reachability."""
    nodes, members, pairs = scatter(spark, sf)
    core, forest = spanning.reachability_forest(nodes, pairs, 3)
    return members.join(spanning.density_clusters(core, forest, HEIGHTS).withColumnRenamed("id", "spot"), "spot").select("radius", "id", "cluster")


@query(f"{SCATTER} SELECT p.id, round(d, 6) AS core FROM p LEFT JOIN (SELECT a, d FROM pair QUALIFY row_number() OVER (PARTITION BY a ORDER BY d) = 2) ON a = p.id")
def core_distances(spark: SparkSession, sf: str) -> DataFrame:
    nodes, members, pairs = scatter(spark, sf)
    core = spanning.core_distances(nodes, pairs, 3).withColumnRenamed("id", "spot")
    return rounded(members.join(core, "spot").select("id", "core"), "core")


# ---- clustering features

_SUMS = "count(*) AS n, round(sum(x), 4) AS sum_x, round(sum(y), 4) AS sum_y, round(sum(z), 4) AS sum_z, round(sum(x * x + y * y + z * z), 2) AS squares"


@query(f"WITH {SPOTS} SELECT CAST(n AS DOUBLE) AS n, sum_x, sum_y, sum_z, squares, true AS within, true AS few FROM (SELECT {_SUMS} FROM p)")
def birch_totals(spark: SparkSession, sf: str) -> DataFrame:
    """What the entries add up to is what the rows add up to; every entry is within its threshold, and there are no more than asked."""
    e = birch.features(spots(spark, sf), threshold=4.0, most=400)
    spread = C("q") / C("n") - F.aggregate("s", F.lit(0.0), lambda a, x: a + (x / C("n")) * (x / C("n")))
    sums = [F.round(F.sum(C("s")[i]), 4).alias(f"sum_{c}") for i, c in enumerate("xyz")]
    e = e.withColumn("kept", spread <= C("threshold") * C("threshold") + 1e-6)
    return e.agg(F.sum("n").alias("n"), *sums, F.round(F.sum("q"), 2).alias("squares"), F.bool_and("kept").alias("within"), (F.count("*") <= 400).alias("few"))

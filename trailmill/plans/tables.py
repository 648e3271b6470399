"""Detection-like tables derived from the test tables, in Spark and as SQL of the same meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate"
_GT = {
    "frame": "l_orderkey",
    "id": f"CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS BIGINT)",
    "class_id": "CAST(l_linenumber AS INT)",
    "score": "CAST(l_discount * 10 AS DOUBLE)",
    "x": "CAST(l_partkey % 100 AS DOUBLE)",
    "y": "CAST(l_suppkey % 100 AS DOUBLE)",
    "w": "CAST(10 + l_quantity AS DOUBLE)",
    "h": "CAST(10 + l_quantity / 2 AS DOUBLE)",
}
_TRACK = {
    "seq": "event_type",
    "track_id": "user_id",
    "frame": "CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS BIGINT)",
    "id": "event_id",
    "class_id": "CAST(event_id % 3 AS INT)",
    "score": "CAST(value AS DOUBLE)",
    "x": "CAST(event_id % 97 AS DOUBLE)",
    "y": "CAST(event_id % 89 AS DOUBLE)",
    "w": "CAST(10 + event_id % 7 AS DOUBLE)",
    "h": "CAST(20 + event_id % 5 AS DOUBLE)",
}


def _sql(columns: dict[str, str], source: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + f" FROM {source}"


GT_SQL = _sql(_GT, "lineitem")
HYP_SQL = "SELECT frame, id, class_id, score, x + id % 3 AS x, y + id % 2 AS y, w, h FROM gt WHERE id % 7 <> 0"
TRACK_SQL = _sql(_TRACK, "events")
#: Predictions for labelled documents: label, prediction and score.
CLF_SQL = """SELECT d.doc_id, l.quality AS y, l.toxic AS t, CASE WHEN d.n_chars >= 1000 THEN 1 ELSE 0 END AS p,
  CAST(d.n_chars % 1000 AS DOUBLE) / 1000 AS score, d.lang, d.source FROM labels l JOIN documents d ON l.doc_id = d.doc_id"""
#: Regression of price on quantity: target y, prediction p.
REG_SQL = "SELECT l_extendedprice AS y, l_quantity * 1500 AS p, l_quantity, l_discount, l_tax, l_extendedprice, l_returnflag, l_linestatus, l_linenumber FROM lineitem"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gt(spark: SparkSession, sf_dir: str) -> DataFrame:
    # named and numbered first, so that all that is made of the boxes of a frame uses one exchange by the frame
    rows = read(spark, sf_dir, "lineitem").withColumnRenamed(_GT["frame"], "frame").withColumn("id", F.expr(_GT["id"].replace(_GT["frame"], "frame")))
    return rows.selectExpr(*[n if n in ("frame", "id") else f"{e} AS {n}" for n, e in _GT.items()])


def hyp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gt(spark, sf_dir).filter("id % 7 <> 0").withColumns({"x": F.expr("x + id % 3"), "y": F.expr("y + id % 2")})


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").selectExpr(*[f"{e} AS {n}" for n, e in _TRACK.items()])


def clf(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, docs = read(spark, sf_dir, "labels"), read(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    return labels.join(docs, "doc_id").selectExpr("doc_id", "quality AS y", "toxic AS t", "CASE WHEN n_chars >= 1000 THEN 1 ELSE 0 END AS p", "CAST(n_chars % 1000 AS DOUBLE) / 1000 AS score", "lang", "source")


def reg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").selectExpr("l_extendedprice AS y", "l_quantity * 1500 AS p", "l_quantity", "l_discount", "l_tax", "l_extendedprice", "l_returnflag", "l_linestatus", "l_linenumber")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").selectExpr("vec_id AS id", "label", "CAST(embedding AS ARRAY<DOUBLE>) AS v")


VEC_SQL = "SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"

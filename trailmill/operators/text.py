"""Bag-of-words features of documents in long form (doc, term, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = r"[a-z0-9_][a-z0-9_]+"


def term_counts(df: DataFrame, doc: str, text: str, token: str = TOKEN) -> DataFrame:
    """doc, term, n: tokens of the lower-cased text."""
    words = df.select(doc, F.explode(F.regexp_extract_all(F.lower(text), F.lit(f"({token})"), 1)).alias("term"))
    return words.groupBy(doc, "term").agg(F.count("*").alias("n"))


def document_frequency(counts: DataFrame, doc: str) -> DataFrame:
    return counts.groupBy("term").agg(F.count("*").alias("df"))


def tfidf(df: DataFrame, doc: str, text: str, token: str = TOKEN) -> DataFrame:
    """doc, term, value: counts times smoothed inverse document frequency ln((1 + N) / (1 + df)) + 1, each document at unit length."""
    c = term_counts(df, doc, text, token)
    n = df.count()
    idf = document_frequency(c, doc).select("term", (F.ln(F.lit(1.0 + n) / (1 + F.col("df"))) + 1).alias("idf"))
    v = c.join(idf, "term").select(doc, "term", (F.col("n") * F.col("idf")).alias("v"))
    length = v.groupBy(doc).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("len"))
    return v.join(length, doc).select(doc, "term", (F.col("v") / F.col("len")).alias("value"))


def hashed_counts(df: DataFrame, doc: str, text: str, buckets: int = 1 << 18, token: str = TOKEN) -> DataFrame:
    """doc, bucket, n: tokens counted by a hash of fixed range, so no vocabulary is needed."""
    c = term_counts(df, doc, text, token)
    return c.groupBy(doc, F.pmod(F.hash("term"), F.lit(buckets)).alias("bucket")).agg(F.sum("n").alias("n"))


def vectorized(df: DataFrame, key: str, features: str) -> DataFrame:
    """key, feature and x for a column of named values (map<string,string>): numbers as they are, other values as name=value with 1; nulls and zeros are left out."""
    rows = df.select(key, F.explode(features).alias("name", "value")).filter("value is not null")
    number = F.expr("try_cast(value AS DOUBLE)")
    out = rows.select(key, F.when(number.isNotNull(), F.col("name")).otherwise(F.concat("name", F.lit("="), "value")).alias("feature"), F.coalesce(number, F.lit(1.0)).alias("x"))
    return out.groupBy(key, "feature").agg(F.sum("x").alias("x")).filter("x <> 0")

"""A training corpus in five stages: quality, near copies, repeated passages, benchmark passages, mix."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trailmill.llm import common, decontam, mixing, quality, simhash, substrings


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from all labels, doesn't reject."""
    return quality.drop_low_quality(docs, common.table(spark, sf_dir, "labels"), label="quality")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: texts whose 5-word shingles have a Jaccard similarity of 0.8 or more."""
    return simhash.drop_near_copies(docs, shingle=5, similarity=0.8)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document or place has."""
    return substrings.drop_repeats(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; documents that consist of them for the most part go."""
    return decontam.decontaminate(docs, common.table(spark, sf_dir, "benchmark"), size=10)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how often (times)."""
    return mixing.mix_documents(docs, weights=(5, 2, 1), total=1.5, ceiling=2.0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", drop_repeats),
    ("decontamination", drop_benchmark),
    ("mixing", mix),
]

#: A classifier, fingerprints and sampling can't be told in SQL; the tests hold each stage against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table documents; each one's result is written and reread as the next one's input."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return docs

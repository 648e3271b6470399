"""What several operators share: tables, intermediate tables in the shared folder, text rules."""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import discard, shared_dir, stored  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder, by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def forget(spark: SparkSession) -> None:
    """Have the JVM collect what is no longer referred to, so that Spark removes the shuffle files of steps that have ended before the next ones write theirs."""
    for _ in range(2):
        gc.collect()
        time.sleep(0.4)  # what Python held is let go by a thread that looks now and then
        spark.sparkContext._jvm.System.gc()


def portions(texts: pa.Array, size: int = 2 << 20) -> Iterator[list[bytes | None]]:
    """A batch's texts (binary) in order, as lists of about size bytes: so much of a batch, and one text at least, stands in memory a second time."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    length = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist()
    at, held = 0, 0
    for i, n in enumerate(length):
        held += n
        if held >= size:
            yield texts.slice(at, i + 1 - at).to_pylist()
            at, held = i + 1, 0
    if at < len(length):
        yield texts.slice(at).to_pylist()


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else unchanged; null stays null. lower() alone would change other letters too, translate() alone is slow."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def n_words(text: Column) -> Column:
    """How many words a text has; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")

"""Substring deduplication by content-defined chunks of a gear rolling hash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import portions, stored

#: One random 32-bit number a byte; drawn by rule, not listed.
GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)
#: Rows without an id get one from here on, by a hash of their text.
NO_ID = 1 << 62
_AT_BITS = 36
_LIST = "array<struct<at:bigint,digest:bigint,first:bigint>>"


def chunks(text: bytes, mean_words: int, max_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, number of words, digest) of each chunk of a text, in order.

    The rolling hash runs over the text's words joined by single spaces and reaches back 16 bytes; a chunk ends after a word at whose end the hash falls below
    1/mean_words of its range, and after max_words in any case. So chunks hold whole words, differences in white space are
    no matter, and cuts come back into step soon after an insertion.
    """
    words = text.split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    line = b" ".join(words)
    h = GEAR[np.frombuffer(line, np.uint8)]
    for s in (1, 2, 4, 8):
        up = h.copy()
        up[s:] += h[:-s] << np.uint32(s)
        h = up
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    mixed = (h[ends - 1] >> np.uint32(8)) * np.uint32(2654435761)
    cut = np.append(np.flatnonzero(mixed < np.uint32((1 << 32) // mean_words)) + 1, len(words))
    cut = np.unique(cut)
    start = np.append(0, cut[:-1])
    if (cut - start > max_words).any():
        cut = np.array([c for a, b in zip(start.tolist(), cut.tolist(), strict=True) for c in [*range(a + max_words, b, max_words), b]])
        start = np.append(0, cut[:-1])
    a = np.where(start > 0, ends[start - 1] + 1, 0)
    digest = np.array([xxhash.xxh3_64_intdigest(line[i:j]) for i, j in zip(a.tolist(), ends[cut - 1].tolist(), strict=True)], np.uint64).view(np.int64)
    return start, cut - start, digest


def word_spans(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of a text's words."""
    b = np.frombuffer(text, np.uint8)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def windows(start: np.ndarray, size: np.ndarray, digest: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, number of words, digest) of the shortest sequences of whole chunks with min_words words or more: from each chunk on, and up to each chunk that ends none of those.

    Wherever chunks of min_words or more come again in a row, windows within the row cover all of it.
    """
    end = start + size
    left = np.arange(len(start))
    right = np.searchsorted(end, start + min_words)
    left, right = left[right < len(end)], right[right < len(end)]
    more = np.setdiff1d(np.flatnonzero(end >= min_words), right)
    left = np.append(left, np.searchsorted(start, end[more] - min_words, side="right") - 1)
    right = np.append(right, more)
    raw = digest.tobytes()
    joint = np.array([xxhash.xxh3_64_intdigest(raw[8 * i : 8 * j + 8]) for i, j in zip(left.tolist(), right.tolist(), strict=True)], np.uint64).view(np.int64)
    return start[left], end[right] - start[left], joint


def runs(start: np.ndarray, size: np.ndarray, flag: np.ndarray) -> list[tuple[int, int]]:
    """Word ranges that flagged windows, in order of their starts, cover without a gap."""
    out = []
    for s, n, f in zip(start.tolist(), size.tolist(), flag.tolist(), strict=True):
        if not f:
            continue
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s + n))
        else:
            out.append((s, s + n))
    return out


def repeated_windows(rows: DataFrame, mean_words: int, max_words: int, min_words: int) -> DataFrame:
    """(id, sig, found) for each document (id: long, sig: int, text: binary) with windows that occur more than once: found lists at (first word << 8 | words), digest and first, the smallest id with that digest.

    Counts by digest are summed where texts are cut before they are shuffled; the digests that occur more than once are
    stored and meet their occurrences in an equal join of two plain exchanges, which Spark splits where very many documents share a digest.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_ids, all_sigs = (b.column(c).to_numpy(zero_copy_only=False) for c in ("id", "sig"))
            lo = 0
            for texts in portions(b.column("text"), 1 << 20):
                got = [windows(*chunks(t or b"", mean_words, max_words), min_words) for t in texts]
                n = np.array([len(g[0]) for g in got], np.int64)
                ids, sig = (np.repeat(x[lo : lo + len(texts)], n) for x in (all_ids, all_sigs))
                lo += len(texts)
                at = np.concatenate([g[0] for g in got]) << 8 | np.concatenate([g[1] for g in got])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sig.astype(np.int64) << _AT_BITS | at), pa.array(np.concatenate([g[2] for g in got]))], names=["id", "at", "digest"])

    seen = rows.mapInArrow(cut, "id bigint, at bigint, digest bigint")
    shared = stored(seen.groupBy("digest").agg(F.count("*").alias("n"), F.min("id").alias("first")).filter("n > 1").select(F.col("digest").alias("_d"), "first"), "shared")
    hits = seen.join(shared, F.col("digest") == F.col("_d")).select("id", F.shiftright("at", _AT_BITS).cast("int").alias("sig"), F.col("at").bitwiseAND(F.lit((1 << _AT_BITS) - 1)).alias("at"), "digest", "first")
    return hits.groupBy("id", "sig").agg(F.collect_set(F.struct("at", "digest", "first")).alias("found"))


def _judged(df: DataFrame, doc_id: str, text: str, keep: list[str], mean_words: int, max_words: int, min_words: int) -> DataFrame:
    """_keep_0, ... for the columns of keep, and r: struct of what repeats() returns beside them."""
    if min_words + max_words > 256:
        raise ValueError("min_words and max_words must not be over 256 together")
    if not isinstance(df.schema[doc_id].dataType, IntegralType):
        raise ValueError(f"{doc_id} must be of an integer type")
    own = F.coalesce(F.col(doc_id).cast("long"), F.xxhash64(text).bitwiseAND(F.lit(NO_ID - 1)) + NO_ID)
    rows = df.select(*[F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)], own.alias("id"), F.pmod(F.xxhash64(F.lit(0), text), F.lit(1 << 27)).cast("int").alias("sig"), F.col(text).alias("text"))
    found = repeated_windows(rows.select("id", "sig", F.col("text").cast("binary").alias("text")), mean_words, max_words, min_words)
    joined = rows.join(found.select(F.col("id").alias("_id"), F.col("sig").alias("_sig"), "found"), (F.col("id") == F.col("_id")) & (F.col("sig") == F.col("_sig")), "left")

    @F.arrow_udf("struct<n_words:bigint,repeated:boolean,spans:array<struct<a:int,b:int>>,removed:array<struct<a:int,b:int>>,sources:array<bigint>,clean:string>")
    def judge(ids: pa.Array, texts: pa.Array, found: pa.Array) -> pa.Array:
        n_words, repeated, spans, removed, sources, done = [], [], [], [], [], []
        inner = found.flatten()
        at, digest, first = (inner.field(k).to_numpy(zero_copy_only=False) for k in ("at", "digest", "first"))
        size = np.array([x or 0 for x in pa.compute.list_value_length(found).to_pylist()], np.int64)
        stop = np.cumsum(size)
        i = 0
        for part in portions(texts):
            clean = []
            for t in part:
                own, lo, hi = ids[i].as_py(), stop[i] - size[i], stop[i]
                i += 1
                a, d, f = at[lo:hi], digest[lo:hi], first[lo:hi]
                order = np.argsort(a, kind="stable")
                a, d, f = a[order], d[order], f[order]
                start, n = a >> 8, a & 255
                _, at_first, which = np.unique(d, return_index=True, return_inverse=True)
                gone = (f != own) | (start >= (start + n)[at_first][which])
                all_, cut = runs(start, n, np.ones(len(a), bool)), runs(start, n, gone)
                b = t or b""
                n_words.append(len(b.split()))
                repeated.append(bool(all_))
                spans.append([{"a": x, "b": y} for x, y in all_])
                removed.append([{"a": x, "b": y} for x, y in cut])
                sources.append([x for x in np.unique(f[gone]).tolist() if x != own and x < NO_ID])
                if cut:
                    left, _ = word_spans(b)
                    bounds = np.append(left, len(b))
                    pieces, end = [], 0
                    for x, y in cut:
                        pieces.append(b[end : bounds[x]])
                        end = bounds[y]
                    clean.append(b"".join([*pieces, b[end:]]))
                else:
                    clean.append(t)
            done.append(pa.array(clean, pa.binary()).cast(pa.string()))
        span = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        return pa.StructArray.from_arrays(
            [pa.array(n_words, pa.int64()), pa.array(repeated, pa.bool_()), pa.array(spans, span), pa.array(removed, span), pa.array(sources, pa.list_(pa.int64())), pa.concat_arrays(done) if done else pa.array([], pa.string())],
            ["n_words", "repeated", "spans", "removed", "sources", "clean"],
        )

    empty = F.coalesce(F.col("found"), F.array().cast(_LIST))
    return joined.select(*[f"_keep_{i}" for i in range(len(keep))], judge("id", F.col("text").cast("binary"), empty).alias("r"))


def repeats(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", keep: list[str] | tuple[str, ...] = (), mean_words: int = 5, max_words: int = 24, min_words: int = 20) -> DataFrame:
    """keep, then for each row of df: n_words, repeated (whether it holds a repeated passage), spans (word ranges a to b of its repeated passages), removed (of those that are cut out, because an earlier document or place has them), sources (ids of the earlier documents), and clean (the text without removed).

    A passage is repeated when a sequence of chunks with min_words words or more occurs more than once as a whole; chunks that are common one by one are no
    repeat. Equal sequences are told by a 64-bit digest. Of equal sequences the one in the document with the smallest id stays, there at its first place with all its words; the words of a removed range go with the white space
    after them, all else stays. Rows that share an id are parts of one document and don't remove from each other. Rows with a null id come after all others, in the order of a hash of their texts; equal ones among them are one document;
    repeated rows come out repeated; null and empty texts stay as they are; texts may be of any length. Columns outside keep are ignored; keep may hold any but those returned (ValueError). Ids must be of an integer type (ValueError) and below 2^62.
    """
    keep, made = list(keep), ["n_words", "repeated", "spans", "removed", "sources", "clean"]
    if clash := set(made) & set(keep):
        raise ValueError(f"columns {sorted(clash)} would be overwritten")
    out = _judged(df, doc_id, text, keep, mean_words, max_words, min_words)
    return out.select(*[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)], *[f"r.{c}" for c in made])


def drop_repeats(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", mean_words: int = 5, max_words: int = 24, min_words: int = 20) -> DataFrame:
    """df with the repeated passages cut out of its texts; all rows and columns stay, whatever their names. n_chars, if there is such a column of an integer type, is counted again for the texts that changed."""
    names = df.columns
    out = _judged(df, doc_id, text, names, mean_words, max_words, min_words)
    cols = {c: F.col(f"_keep_{i}") for i, c in enumerate(names)}
    changed = F.size("r.removed") > 0
    if "n_chars" in names and isinstance(df.schema["n_chars"].dataType, IntegralType):
        cols["n_chars"] = F.when(changed, F.char_length("r.clean")).otherwise(cols["n_chars"])
    cols[text] = F.col("r.clean")
    return out.select(*[cols[c].cast(df.schema[c].dataType).alias(c) for c in names])

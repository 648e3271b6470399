"""Benchmark decontamination by hashed n-gram windows, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import ascii_lower, stored

#: What parts words: ASCII control, space, punctuation and symbols; all letters and digits, and all beyond ASCII, make words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NO_ITEMS = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def words_of(text: Column) -> Column:
    """The words of a text in lower case; null and empty texts have none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), "")


def item_windows(items: DataFrame, item_id: str, text: str, size: int) -> DataFrame:
    """(words, len, lead, hash, item_ids): each distinct window of the items, with all items that hold it."""
    w = items.select(F.col(item_id).cast("string").alias("item_id"), words_of(F.col(text)).alias("w")).filter(F.size("w") > 0)
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1))))
    w = w.select("item_id", "w", at.alias("p")).select("item_id", F.slice("w", F.col("p"), size).alias("words"))
    w = w.groupBy("words").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    return w.select("words", "item_ids", F.size("words").alias("len"), F.xxhash64(F.element_at("words", 1), F.coalesce(F.try_element_at("words", F.lit(2)), F.lit(""))).alias("lead"), F.xxhash64("words").alias("hash"))


def window_hits(docs: DataFrame, windows: DataFrame, *, text: str, keep: list[str], broadcast_rows: int = 2_000_000) -> DataFrame:
    """keep, then p (0-based word), len and item_ids for each place where a window occurs in a document.

    A place is first tested by the hash of its two leading words, then by the hash of the whole window, and then word by word. The sets
    are broadcast when they hold at most broadcast_rows windows, which is counted; a larger set is joined by shuffle.
    """
    lens = sorted(r[0] for r in windows.select("len").distinct().collect())
    if not lens:
        return docs.select(*keep, F.lit(0).alias("p"), F.lit(0).alias("len"), F.array().cast("array<string>").alias("item_ids")).limit(0)
    small = windows.count() <= broadcast_rows
    hint = F.broadcast if small else (lambda x: x)
    rows = docs.select(*keep, words_of(F.col(text)).alias("w"))
    rows = rows.select(*keep, "w", F.posexplode("w").alias("p", "first"))
    # the words that a window may take from here on: all that is shuffled for a place, whatever the text's length
    ahead = F.slice("w", F.col("p") + 1, max(lens)).alias("ahead")
    after = F.coalesce(F.try_element_at("w", F.col("p") + 2), F.lit(""))
    rows = rows.select(*keep, "p", "first", F.xxhash64("first", after).alias("lead"), *(["w"] if small else [ahead]))
    if 1 in lens:
        # a window of one word leads with that word alone, whatever follows it in the document
        one = hint(windows.filter("len = 1").select(F.element_at("words", 1).alias("_one")))
        single = rows.join(one, F.col("first") == F.col("_one"), "left_semi").select(*keep, "p", ahead if small else "ahead")
    longer = windows.filter("len > 1").select(F.col("lead").alias("_lead")).distinct()
    # stored beyond a broadcast, so that the join with a very common lead can be split
    longer = F.broadcast(longer) if small else stored(longer, "leads")
    places = rows.join(longer, F.col("lead") == F.col("_lead"), "left_semi").select(*keep, "p", ahead if small else "ahead")
    if 1 in lens:
        places = places.unionByName(single)
    n = F.explode(F.array(*[F.lit(x) for x in lens])).alias("n")
    tried = places.select(*keep, "ahead", "p", n).filter(F.col("n") <= F.size("ahead")).select(*keep, "p", F.slice("ahead", 1, F.col("n")).alias("window"))
    found = tried.withColumn("hash", F.xxhash64("window"))
    known = hint(windows.select(F.col("hash").alias("_hash"), "words", "len", "item_ids"))
    return found.join(known, (F.col("hash") == F.col("_hash")) & (F.col("window") == F.col("words"))).select(*keep, "p", "len", "item_ids")


def merged(spans: Column) -> Column:
    """The union of spans (sorted array of structs p, len) as disjoint ranges a to b."""

    def add(acc: Column, s: Column) -> Column:
        last, end = F.try_element_at(acc, F.lit(-1)), s["p"] + s["len"]
        joined = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], end).alias("b"))))
        return F.when(F.coalesce(last["b"] >= s["p"], F.lit(False)), joined).otherwise(F.concat(acc, F.array(F.struct(s["p"].alias("a"), end.alias("b")))))

    return F.aggregate(spans, F.array().cast("array<struct<a:int,b:int>>"), add)


def covered(spans: Column) -> Column:
    """How many words the spans cover together."""
    return F.aggregate(merged(spans), F.lit(0), lambda n, s: n + s["b"] - s["a"])


def contamination(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 10, keep_text: bool = False, broadcast_rows: int = 2_000_000) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_hit, spans (word ranges p, len, sorted), item_ids (sorted as strings); keep_text adds the text.

    A window is size consecutive words of an item; an item of fewer words is one window; an item without words (null too) has none. A word is hit
    if it lies in any occurrence of a window. Null texts have no words. Rows that share id and text share their hits; repeated rows come out
    repeated. Null ids of documents are ids like any other; the words of an item with a null id are hit, but it isn't listed among the items. Texts may be of any length. Either table may be empty. Other columns of either table are ignored.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"), F.xxhash64(F.lit(0), text).alias("_h"))
    windows = item_windows(items, item_id, item_text, size)
    hits = window_hits(rows, windows, text="_text", keep=["doc_id", "_h"], broadcast_rows=broadcast_rows)
    per = hits.groupBy(F.col("doc_id").alias("_id"), F.col("_h").alias("_g")).agg(F.sort_array(F.collect_set(F.struct("p", "len"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"))
    count = F.size(words_of(F.col("_text"))).cast("long").alias("n_words")
    out = rows.select("doc_id", "_h", count, *(["_text"] if keep_text else []))
    out = out.join(per, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_g")), "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<p:int,len:int>>"))
    return out.select("doc_id", "n_words", covered(spans).cast("long").alias("n_hit"), spans.alias("spans"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), *([F.col("_text").alias("text")] if keep_text else []))


def decontaminate(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 10, drop_share: float = 0.5, broadcast_rows: int = 2_000_000) -> DataFrame:
    """docs with the hit words cut out of their texts; documents of which more than drop_share of the words are hit go.

    A cut takes the words of a span and what parts them. All other characters, rows and columns stay as they are (null texts too); n_chars, if there is such a column of an integer type, is counted again for the
    texts that changed.
    """
    names = docs.columns
    rows = docs.select(*[F.col(c).alias(f"_in_{i}") for i, c in enumerate(names)], F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"), F.xxhash64(F.lit(0), text).alias("_h"))
    hits = window_hits(rows, item_windows(items, item_id, item_text, size), text="_text", keep=["doc_id", "_h"], broadcast_rows=broadcast_rows)
    per = hits.groupBy(F.col("doc_id").alias("_id"), F.col("_h").alias("_g")).agg(F.sort_array(F.collect_set(F.struct("p", "len"))).alias("spans"))
    out = rows.join(per, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_g")), "left")
    # words and gaps in turn: gap i precedes word i, and a last gap ends the text
    raw = F.regexp_extract_all(F.col("_text"), F.lit(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"), 1)
    gaps = F.split(F.col("_text"), r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    cut = F.col("_cut")
    words = F.transform(F.arrays_zip(gaps.alias("g"), raw.alias("w")), lambda x, i: F.when(F.exists(cut, lambda s: (s["a"] <= i) & (i < s["b"])), F.lit("")).otherwise(F.concat(x["g"], F.coalesce(x["w"], F.lit("")))))
    out = out.withColumn("_cut", merged(F.coalesce("spans", F.array().cast("array<struct<p:int,len:int>>"))))
    gone = F.aggregate(cut, F.lit(0), lambda n, s: n + s["b"] - s["a"])
    clean = F.size("_cut") == 0
    kept = out.filter(F.when(clean, F.lit(True)).otherwise(gone <= drop_share * F.size(raw))).withColumn("_new", F.when(clean, F.col("_text")).otherwise(F.array_join(words, "")))
    final = {text: F.col("_new"), "n_chars": F.when(clean, F.col(f"_in_{names.index('n_chars')}")).otherwise(F.char_length("_new")) if "n_chars" in names and isinstance(docs.schema["n_chars"].dataType, IntegralType) else None}
    return kept.select(*[(final[c] if final.get(c) is not None else F.col(f"_in_{i}")).cast(docs.schema[c].dataType).alias(c) for i, c in enumerate(names)])

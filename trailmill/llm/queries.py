"""The registered queries of these operators and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, audit, common, decontam, jaccard, lm, mixing, quality, simhash, substrings, tokens, topk, toxicity, urls
from .common import table

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"), shingle=4, radius=4)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), rules=RULES)


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), is_query=F.col("vec_id") % 50 == 0, k=5)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = common.crc_mod(F.col("doc_id"), 3)
    out = quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), label="quality", learn=rest != 1, keep=["doc_id"])
    return out.select("doc_id", F.coalesce(rest == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), tokenizer=tokenizer("word_bpe_49k.json"), keep=["doc_id"], limit=2048, split=True)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10)
    ids = F.sha2(F.array_join("item_ids", ",").cast("binary"), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), ids.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = common.crc_mod(F.col("doc_id"), 5)
    out = toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), label="toxic", learn=rest != 0, keep=["doc_id"])
    return out.select("doc_id", F.coalesce(rest == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = common.crc_mod(F.col("doc_id"), 7)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(rest == 2, F.lit(False)).alias("held_out"))
    out = lm.lm_scores(docs, learn=~F.col("held_out"), keep=["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.repeats(table(spark, sf_dir, "documents"), keep=["doc_id"])
    words = F.aggregate("removed", F.lit(0), lambda n, s: n + s["b"] - s["a"]).cast("long")
    return out.select("doc_id", "n_words", "repeated", F.size("spans").cast("long").alias("n_passages"), words.alias("n_removed_words"), F.col("sources").alias("source_doc_ids"), F.col("clean").alias("text"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", common.n_words(F.col("text")).alias("words"))
    out = mixing.mix_sources(docs, source="source", size="words", key="doc_id", keep=["doc_id"], weights=(5, 2, 1), total=1.5, ceiling=2.0)
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op11_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), shingle=4, num=85, den=100)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = alignment.aligned_texts(table(spark, sf_dir, "documents"), a=tokenizer("byte_bpe_50k.json"), b=tokenizer("piece_bpe_32k.model"), keep=["doc_id"])
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), part="lang")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_url_filter": op2_url_filter,
    "op3_topk": op3_topk,
    "op4_quality": op4_quality,
    "op5_token_counts": op5_token_counts,
    "op6_decontamination": op6_decontamination,
    "op7_toxicity": op7_toxicity,
    "op8_lm_scores": op8_lm_scores,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_mixing": op10_mixing,
    "op11_ngram_jaccard": op11_ngram_jaccard,
    "op12_alignment": op12_alignment,
    "op13_filter_audit": op13_filter_audit,
}

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP6_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, w[p:p + 9] AS words, len(w[p:p + 9]) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM b WHERE len(w) > 0)
), place AS (
  SELECT rid, w, unnest(range(1, len(w) + 1)) AS p FROM d
), tried AS (
  SELECT rid, p, n, w[p:p + n - 1] AS words FROM place, (SELECT DISTINCT n FROM win) WHERE p + n - 1 <= len(w)
), hit AS (
  SELECT rid, p, n, item_id FROM tried JOIN win USING (words, n)
), cover AS (
  SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM hit) GROUP BY rid
), items AS (
  SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (rid) LEFT JOIN items USING (rid)
"""

OP11_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS p FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), met AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM met JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * common >= 85 * (a.n + b.n - common)
), reach(x, y) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) USING (doc_id)
"""

_ORDERS = "SELECT " + " || ".join(f"{x}.f" for x in "abcde") + " AS filter_order FROM " + ", ".join(f"(SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f) {x}" for x in "abcde") + " WHERE " + " AND ".join(f"{x}.f <> {y}.f" for i, x in enumerate("abcde") for y in "abcde"[i + 1 :])

OP13_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), least AS (
  SELECT t, min(doc_id) AS first FROM d GROUP BY t
), marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END) || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
    || (CASE WHEN doc_id > first OR doc_id IS NULL AND first IS NOT NULL THEN 'E' ELSE '' END) AS fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM d JOIN least USING (t) LEFT JOIN marks USING (doc_id)
), c AS (
  SELECT part, fails, sum(good) AS good, sum(toxic) AS toxic, count(*) AS n FROM f GROUP BY part, fails
), o AS ({_ORDERS}), s AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS before FROM o, (SELECT unnest(range(1, 6)) AS step)
), j AS (
  SELECT part, filter_order, step, own, contains(fails, own) AS hit, before <> '' AND regexp_matches(fails, '[' || before || 'x]') AS gone, fails = own AS alone, good, toxic, n FROM c, s
), r AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, own, sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS removed, sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN alone THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
  FROM j GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM r
"""

ORACLES: dict[str, str] = {"op3_topk": OP3_SQL, "op6_decontamination": OP6_SQL, "op11_ngram_jaccard": OP11_SQL, "op13_filter_audit": OP13_SQL}

"""Queries that apply each corpus operator to its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.llm import bpe, decontam, html_text, lang_id, media_ts, near_dedup, secrets, sharding, substring_dedup, token_counts
from tidegate.llm._common import shared_dir, table

#: Path of the tokenizer file that queries use; operators take its text as a parameter.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.extract_pages(table(spark, sf_dir, "pages"), ["page_id", "url"])
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_dir(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return bpe_digests(docs)


def bpe_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of texts that are not null."""
    out = bpe.encode_decode(docs.select("doc_id", "text"), bpe.read_spec(TOKENIZER))
    listed = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_documents(table(spark, sf_dir, "documents"), ["doc_id"])
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint")
    listed = secrets.listed(F.col("spans"))
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(listed.cast("binary"), 256).alias("base_sha256"), listed.alias("spans"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = {"byte_bpe_50k-1": bpe.read_spec(TOKENIZER), "words-1": ""}
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), versions)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lang_id.identify(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", (lang_id.bucket(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", "score")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op8_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_dir(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint")
    stored = docs.select("doc_id", n.alias("n_bytes"), media_ts.to_media(media_ts.padded(F.col("text"))).alias("media"))
    read = stored.withColumn("p", media_ts.parse_media(F.col("media")))
    payload = F.col("p.payload")
    tail = F.substring(payload, -16, 16)
    return read.select("doc_id", "n_bytes", F.octet_length(payload).cast("bigint").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"), F.octet_length("media").cast("bigint").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), media_ts.feature(F.col("p")).alias("feature"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_html_text, op2_bpe, op3_secrets, op4_token_counts, op5_substring_dedup, op6_language, op7_sharding, op8_transport_streams, op9_decontamination, op10_near_duplicates)}

_SECRETS_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
r(k, kind, pat, grp, least) AS (VALUES
  (0, 'assign', '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 8),
  (1, 'access', 'AKIA[A-Z0-9]+', 0, 16),
  (2, 'hex', '[0-9a-f]{32,}', 0, 32)),
m AS (
  SELECT rid, 0 AS k, regexp_extract_all(t, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS m,
         regexp_extract_all(t, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS j,
         string_split_regex(t, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS g FROM d
  UNION ALL SELECT rid, 1, regexp_extract_all(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+'), string_split_regex(t, 'AKIA[A-Z0-9]+') FROM d
  UNION ALL SELECT rid, 2, regexp_extract_all(t, '[0-9a-f]{32,}'), regexp_extract_all(t, '[0-9a-f]{32,}'), string_split_regex(t, '[0-9a-f]{32,}') FROM d),
i AS (SELECT rid, k, m, j, g, unnest(range(1, len(m) + 1)) AS i FROM m),
s AS (SELECT rid, k, kind, len(m[i]) AS size, len(j[i]) AS judged, least,
        list_sum(list_transform(g[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: len(x))), 0) AS start
      FROM i JOIN r USING (k)),
a AS (SELECT rid, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
        string_agg(kind || ':' || start::BIGINT || ':' || (start + size)::BIGINT, ',' ORDER BY start, k) AS spans
      FROM s WHERE judged >= least GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (rid)
"""

_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_DECONTAMINATION_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS_SQL} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS_SQL} AS w FROM benchmark),
bl AS (SELECT item, w, least(10, len(w)) AS l FROM b WHERE len(w) > 0),
bi AS (SELECT item, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM bl),
bw AS (SELECT DISTINCT item, l, array_to_string(w[i:i+l-1], ' ') AS k FROM bi),
di AS (SELECT rid, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM bl) WHERE len(w) >= l),
dw AS (SELECT rid, l, i, array_to_string(w[i:i+l-1], ' ') AS k FROM di),
h AS (SELECT rid, dw.l, i, item FROM dw JOIN bw ON dw.l = bw.l AND dw.k = bw.k),
p AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + l)) AS p FROM h) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h WHERE item IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (rid) LEFT JOIN t USING (rid)
"""

ORACLE = {"op3_secrets": _SECRETS_SQL, "op9_decontamination": _DECONTAMINATION_SQL}

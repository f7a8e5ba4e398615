"""The registered query of every operator, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, bpe, exact_dedup, fm_index, language, packing, periods, quality, resampling, sharding, simhash, suffix_array, token_counts

#: Where the vocabulary lies; a parameter of the operators.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_documents(spark, sf_dir), width=3, radius=2)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_documents(spark, sf_dir), shards=16)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_documents(spark, sf_dir), TOKENIZER).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), TOKENIZER, size=2048, end_id=1)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    return quality.classify(_documents(spark, sf_dir), trusted, files=True)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_index.remove_repeated_words(_documents(spark, sf_dir), length=20).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.audio_columns(_documents(spark, sf_dir)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", F.octet_length("features").cast("long").alias("tensor_bytes"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.length_histogram(token_counts.token_lengths(_documents(spark, sf_dir), TOKENIZER))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_documents(spark, sf_dir))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.remove_repeated_bytes(_documents(spark, sf_dir), length=50).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.find_runs(periods.with_planted_runs(_documents(spark, sf_dir)), least=24, exponent=3)
    best = periods.strongest(F.col("runs"))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n")))
    rows = found.withColumn("best", best)
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return resampling.resample(_documents(spark, sf_dir), target, percent=5, least_words=20).select("doc_id", "n_features", "weight", "score", "rank")


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_sharding, op3_bpe, op4_packing, op5_quality, op6_substring_dedup, op7_audio, op8_token_counts, op9_exact_dedup, op10_suffix_dedup, op11_periodic_runs, op12_importance_resampling, op13_language_id)}


def oracle_sql() -> dict[str, str]:
    return {"op6_substring_dedup": OP6, "op9_exact_dedup": OP9, "op10_suffix_dedup": OP10}


OP9 = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content
  FROM documents)
SELECT doc_id,
  first_value(doc_id) OVER w AS keep_id,
  count(*) OVER (PARTITION BY content) AS group_size,
  doc_id = first_value(doc_id) OVER w AS kept,
  sha256(content) AS text_sha256
FROM t WINDOW w AS (PARTITION BY content ORDER BY chars DESC, doc_id)
"""

OP6 = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
starts AS (
  SELECT doc_id, unnest(range(1, len(words) - 18)) AS s, words FROM w),
windows AS (
  SELECT doc_id, s, array_to_string(words[s : s + 19], ' ') AS content FROM starts),
hits AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY content ORDER BY doc_id, s) AS n FROM windows) WHERE n > 1),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM hits),
words AS (
  SELECT doc_id, unnest(range(1, len(words) + 1)) AS p, unnest(words) AS word FROM w),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(words) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP10 = r"""
WITH h AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
windows AS (
  SELECT doc_id, s, substr(x, 2 * s + 1, 100) AS content FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 49)) AS s FROM h)),
hits AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY content) AS least FROM windows) WHERE least < doc_id),
jumps AS (
  SELECT doc_id, s, max(s + 50) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM hits),
islands AS (
  SELECT doc_id, s, sum(CASE WHEN reach >= s THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s) AS island FROM jumps),
spans AS (SELECT doc_id, island, min(s) AS a, max(s) + 50 AS b FROM islands GROUP BY doc_id, island),
gaps AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM spans),
parts AS (
  SELECT doc_id, string_agg(substr(x, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS head, max(b) AS last, count(*) AS n_spans, sum(b - a) AS n_removed
  FROM gaps JOIN h USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(x) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM h LEFT JOIN parts USING (doc_id)
"""

"""The registered queries of the ten operators: thin digests of what the operators return, with SQL where it exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _tokens, ann, chat, lmscore, neardup, packing, piece_bpe, quality, secrets, tokenbin, toxicity
from ._shared import crc_fold


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").where(crc_fold(F.col("doc_id")) != 0)
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels))
    return scored.select("doc_id", (crc_fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("\\### Assistant: </turn> ok")
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
        said.alias("text"),
    )
    out = chat.format_chat(rows.unionByName(own)).select(
        "conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss"), "valid"
    )
    spelled = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spelled, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


OP3_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
spelled AS (
  SELECT *, replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t') AS escaped,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS pos,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back
  FROM rows),
judged AS (
  SELECT *, count(*) FILTER (WHERE role = 'system' AND pos = 0) OVER (PARTITION BY conv_id) AS has_system FROM spelled)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('### ' || role || ': ') + length(escaped) + length('</turn>') + 1) AS BIGINT) AS formatted_chars,
  bool_and(CASE WHEN pos = 0 AND role = 'system' THEN true
                WHEN (pos - has_system) % 2 = 0 THEN role = 'user' ELSE role = 'assistant' END)
    AND bool_or(back = 1 AND role = 'assistant') AS valid
FROM judged GROUP BY conv_id
"""


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan_secrets(_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return out.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secrets.spans_text(F.col("base")), 256).alias("base_sha256"),
        secrets.spans_text(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_quality(docs, _table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model).drop("text")


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    scored = lmscore.score_texts(docs, crc_fold(F.col("doc_id")) != 1)
    return scored.withColumn("held_out", crc_fold(F.col("doc_id")) == 1)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), size=3, num=85, den=100)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _tokens.tokenizer_path("word_bpe_49k.json")
    return tokenbin.read_tokens(tokenbin.write_tokens(_table(spark, sf_dir, "documents"), path, end_id=2), tokenbin.crc)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), _tokens.tokenizer_path("byte_bpe_50k.json"), end_id=0)


def op9_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.code_texts(_table(spark, sf_dir, "documents"), _tokens.tokenizer_path("piece_bpe_32k.model"), digest=True)


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_nearest": op2_nearest,
    "op3_chat_format": op3_chat_format,
    "op4_lm_score": op4_lm_score,
    "op5_near_dedup": op5_near_dedup,
    "op6_token_files": op6_token_files,
    "op7_secret_scan": op7_secret_scan,
    "op8_packing": op8_packing,
    "op9_piece_codec": op9_piece_codec,
    "op10_quality_rules": op10_quality_rules,
}

ORACLE_SQL = {"op3_chat_format": OP3_SQL}

"""A training corpus from documents, in five stages, each of one operator of quillon.llm.

Every stage takes what the one before kept and decides over all of it. The first four return the columns of documents; the
last returns the packed pieces. Their models are learned anew from the documents that a stage is given.

1. quality_rules: documents that the rules or the log-likelihood ratio reject go.
2. toxicity: documents that score 0.5 or more go.
3. near_dedup: one document of each group stays, the one of the smallest doc_id (five words a shingle, similarity 0.8).
4. secret_scan: reported secrets are overwritten in the text; every document stays.
5. packing: texts become pieces of at most 2048 ids, packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import _tokens, neardup, packing, quality, secrets, toxicity
from quillon.llm._shared import crc_fold, materialize


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit_quality(docs, _labels(spark, sf_dir))
    return quality.score_quality(docs, model).where("kept").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = _labels(spark, sf_dir).where(crc_fold(F.col("doc_id")) != 0)
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).where("predicted = 0").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicate(docs, size=5, num=80, den=100).select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, _tokens.tokenizer_path("byte_bpe_50k.json"), end_id=0)


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", drop_toxic),
    ("near_dedup", near_dedup),
    ("secret_scan", mask_secrets),
    ("packing", pack_documents),
]

#: SQL can't express a byte-pair encoding or a fitted model; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each result is written as Parquet and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

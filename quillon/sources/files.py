"""Stored files: content-addressed blobs, UTF-8 texts with hashes, strict JSON lines, create-only writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MAX_TEXT_BYTES = 2_000_000


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """path, byte_size, sha256, content of every file below path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(
        "path", F.col("length").alias("byte_size"), F.sha2("content", 256).alias("sha256"), "content"
    )


def storage_key(digest):
    return F.concat(F.lit("sha256/"), F.left(digest, F.lit(2)), F.lit("/"), digest)


def new_blobs(blobs: DataFrame, stored: DataFrame) -> DataFrame:
    """Blobs, one for each digest, that the store lacks."""
    return blobs.dropDuplicates(["sha256"]).join(stored.select("sha256"), "sha256", "left_anti").withColumn("storage_key", storage_key(F.col("sha256")))


def corrupt_blobs(stored: DataFrame) -> DataFrame:
    return stored.where(F.sha2("content", 256) != F.col("sha256"))


def read_texts(blobs: DataFrame) -> DataFrame:
    """text of each blob and the first problem (too_large, not_utf8) instead; a byte-order mark goes."""
    issue = F.when(F.col("byte_size") > MAX_TEXT_BYTES, "too_large").when(F.try_validate_utf8(F.col("content").cast("string")).isNull(), "not_utf8")
    text = F.regexp_replace(F.col("content").cast("string"), "^﻿", "")
    return blobs.withColumn("issue", issue).withColumn("text", F.when(F.col("issue").isNull(), text)).drop("content")


def read_strict_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Lines as rows of schema, with the first problem: malformed, or keys other than exactly those of the schema."""
    names = F.array(*[F.lit(f.name) for f in schema])
    lines = spark.read.text(path).where(F.trim("value") != "")
    row = F.from_json("value", schema, {"mode": "PERMISSIVE", "allowNonNumericNumbers": "false"})
    keys = F.json_object_keys("value")
    problem = F.when(keys.isNull() | row.isNull(), "malformed").when((F.size(F.array_except(keys, names)) > 0) | (F.size(F.array_except(names, keys)) > 0), "wrong_keys")
    return lines.select("value", row.alias("row"), problem.alias("issue"))


def write_once(df: DataFrame, path: str) -> None:
    """JSON lines at a path that must not exist; the commit protocol installs all files or none."""
    df.write.mode("errorifexists").json(path)

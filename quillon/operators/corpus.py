"""Corpus building: canonical duplicates, SimHash near duplicates, hash splits, leakage, contamination, order-free hashes."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import numbers as N
from quillon.functions import text as T


def canonical_hash(text):
    """Hash of the case-folded word tokens, joined by single spaces."""
    return N.sha256(F.array_join(T.corpus_tokens(text), " "))


def duplicate_groups(docs: DataFrame) -> DataFrame:
    """Texts equal after canonicalisation: hash, smallest doc_id, size. Hashes are combined before their shuffle."""
    by = docs.select("doc_id", canonical_hash("text").alias("text_hash")).groupBy("text_hash")
    return by.agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")).where("n > 1")


def _block_masks() -> list[int]:
    """For each choice of three of six blocks of a 64-bit number: a mask of their bits, as a signed number."""
    cuts = [0, 11, 22, 33, 44, 54, 64]
    blocks = [(1 << z) - (1 << a) for a, z in zip(cuts, cuts[1:], strict=False)]
    masks = [a | b | c for a, b, c in itertools.combinations(blocks, 3)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def simhash_pairs(docs: DataFrame, least_tokens: int = 50, ratio: float = 0.9, distance: int = 3) -> DataFrame:
    """left_id <= right_id of near duplicates: SimHash within `distance` bits, token counts within `ratio`.

    The 64 bits are cut into six blocks. Three differing bits leave three blocks or more alone, so two such hashes are equal in
    one of the twenty choices of three blocks, each of about 32 bits: joining on these keys loses no pair, and texts that
    have nothing to do with each other hardly meet. Documents of equal hash and length are one class under its smallest
    doc_id; a class of several has a row with itself, and a pair of classes stands for all pairs of their members.
    """
    if distance > 3:
        raise ValueError("six blocks find up to three differing bits")
    hashed = docs.select("doc_id", T.corpus_tokens("text").alias("t")).where(F.size("t") >= least_tokens)
    classes = hashed.select("doc_id", F.size("t").alias("n"), N.simhash64("t").alias("h")).groupBy("h", "n").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("members"))
    keys = F.array(*[F.struct(F.lit(k).alias("choice"), F.col("h").bitwiseAND(F.lit(mask)).alias("bits")) for k, mask in enumerate(_block_masks())])
    banded = classes.select("doc_id", "n", "h", "members", F.explode(keys).alias("band"))
    a, b = banded.alias("a"), banded.alias("b")
    close = (F.bit_count(F.col("a.h").bitwiseXOR(F.col("b.h"))) <= distance) & (F.least("a.n", "b.n") >= ratio * F.greatest("a.n", "b.n"))
    pairs = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.doc_id") <= F.col("b.doc_id"))).where(close & ((F.col("a.doc_id") < F.col("b.doc_id")) | (F.col("a.members") > 1)))
    return pairs.select(F.col("a.doc_id").alias("left_id"), F.col("b.doc_id").alias("right_id"), F.col("a.members").alias("left_members"), F.col("b.members").alias("right_members")).distinct()


def splits(groups: DataFrame, key: str, salt: str, train: float = 0.6, calibration: float = 0.2) -> DataFrame:
    """Each group's split by its salted hash; the policy is checked first."""
    if not salt.strip() or len(salt) > 100:
        raise ValueError("the salt must have 1 to 100 characters")
    if not (0 < train < 1 and 0 < calibration < 1 and train + calibration < 1):
        raise ValueError("shares must lie between 0 and 1 and leave some for the test split")
    return groups.withColumn("split", N.split_of(salt, key, train, calibration))


def split_matrix(rows: DataFrame, labels: list[int], names: tuple[str, ...] = ("train", "calibration", "test")) -> DataFrame:
    """Counts of every split and label, empty cells included."""
    spark = rows.sparkSession
    cells = spark.createDataFrame([(s, x) for s in names for x in labels], "split string, label int")
    counted = rows.groupBy("split", "label").agg(F.count("*").alias("n"))
    return cells.join(counted, ["split", "label"], "left").na.fill(0, ["n"])


def leaking_groups(rows: DataFrame, group: str) -> DataFrame:
    """Groups with rows in several splits."""
    return rows.groupBy(group).agg(F.count_distinct("split").alias("splits")).where("splits > 1")


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 5) -> DataFrame:
    """item_id, doc_id, shared distinct word n-grams. Benchmark n-grams are the small side of the join."""
    grams = lambda c: F.array_distinct(
        F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(c) - size + 1)), lambda i: F.array_join(F.slice(c, i, size), " "))
    )
    b = benchmark.select("item_id", T.corpus_tokens("text").alias("t")).where(F.size("t") >= size).select("item_id", F.explode(grams("t")).alias("g"))
    d = docs.select("doc_id", T.corpus_tokens("text").alias("t")).where(F.size("t") >= size).select("doc_id", F.explode(grams("t")).alias("g"))
    return d.join(b, "g").groupBy("item_id", "doc_id").agg(F.count("*").alias("shared"))


def order_free_hash(rows: DataFrame, row_hash, *group: str) -> DataFrame:
    """One hash for each group, whatever the order of rows: of the sum and count of row hashes, so no group is collected."""
    head = F.conv(F.left(row_hash, F.lit(15)), 16, 10).cast("decimal(38,0)")
    tail = F.conv(F.substring(row_hash, 16, 15), 16, 10).cast("decimal(38,0)")
    by = rows.groupBy(*group).agg(F.count("*").alias("n"), F.sum(head).cast("decimal(38,0)").alias("a"), F.sum(tail).cast("decimal(38,0)").alias("b"))
    return by.select(*group, "n", N.sha256(F.concat_ws(":", F.col("n").cast("string"), F.col("a").cast("string"), F.col("b").cast("string"))).alias("content_hash"))

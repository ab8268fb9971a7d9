"""Similarity of documents: terms, entities, time, and their weighted sum; similarity of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import numbers as N
from quillon.functions import text as T
from quillon.shipping import packaged

WEIGHTS = {"temporal": 0.2, "entities": 0.5, "lexical": 0.3}
WINDOW_HOURS, MIN_TERMS = 72.0, 20


def term_counts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.explode(T.terms("text")).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def lexical(pairs: DataFrame, terms: DataFrame, least: int = MIN_TERMS) -> DataFrame:
    """pairs (left_id, right_id) with dot and squared norms of term counts; null where a text has fewer than `least` terms."""
    sizes = terms.groupBy("doc_id").agg(F.sum("tf").alias("n"), F.sum(F.col("tf") * F.col("tf")).alias("sq"))
    left, right = terms.select(F.col("doc_id").alias("left_id"), "term", F.col("tf").alias("l")), terms.select(F.col("doc_id").alias("right_id"), "term", F.col("tf").alias("r"))
    dots = pairs.select("left_id", "right_id").join(left, "left_id").join(right, ["right_id", "term"]).groupBy("left_id", "right_id").agg(F.sum(F.col("l") * F.col("r")).alias("dot"))
    of = lambda side: sizes.select(F.col("doc_id").alias(f"{side}_id"), F.col("n").alias(f"{side}_n"), F.col("sq").alias(f"{side}_sq"))
    out = pairs.join(dots, ["left_id", "right_id"], "left").join(of("left"), "left_id", "left").join(of("right"), "right_id", "left")
    enough = (F.coalesce("left_n", F.lit(0)) >= least) & (F.coalesce("right_n", F.lit(0)) >= least)
    cosine = F.coalesce("dot", F.lit(0)) / F.sqrt(F.col("left_sq").cast("double") * F.col("right_sq").cast("double"))
    return out.withColumn("lexical", F.when(enough, cosine)).drop("left_n", "right_n", "left_sq", "right_sq")


def jaccard(a, b):
    """Share of common elements of two arrays of distinct elements; null if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / F.size(F.array_union(a, b)))


def combined(pairs: DataFrame) -> DataFrame:
    """score and available_weight of pairs with temporal, entities and lexical; unavailable parts leave the weights."""
    score, have = N.weighted({k: (F.col(k), w) for k, w in WEIGHTS.items()})
    return pairs.withColumn("score", score).withColumn("available_weight", have)


def cosine_topk(vectors: DataFrame, k: int, block: int = 2048) -> DataFrame:
    """vec_id, neighbour, rank, cosine: the exact k nearest of each vector within its label; ties to the smaller vec_id.

    A label's vectors are dealt into blocks of about `block`. Every block meets every other of its label as one matrix product
    that gives k rows for each vector, so no pair is a row and no task holds more than two blocks.
    """
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select("vec_id", "label", v.alias("v"))
    parts = rows.groupBy("label").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("parts"))
    placed = rows.join(parts, "label").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    others = F.sequence(F.lit(0), F.col("parts") - 1)
    asking = placed.select("label", F.col("part").alias("a"), F.explode(others).alias("b"), F.lit(True).alias("asks"), "vec_id", "v")
    asked = placed.select("label", F.explode(others).alias("a"), F.col("part").alias("b"), F.lit(False).alias("asks"), "vec_id", "v")

    def near(table: pa.Table) -> pa.Table:
        asks = table["asks"].to_numpy()
        ids, x = table["vec_id"].to_numpy(), np.stack(table["v"].to_numpy())
        x = x / np.sqrt((x * x).sum(1, keepdims=True))
        order = np.argsort(ids[~asks], kind="stable")
        others_, y = ids[~asks][order], x[~asks][order]
        cosine = x[asks] @ y.T
        cosine[ids[asks][:, None] == others_[None]] = -np.inf
        top = np.argsort(-cosine, axis=1, kind="stable")[:, :k]
        best = np.take_along_axis(cosine, top, 1)
        held = np.isfinite(best)
        return pa.table({"vec_id": np.repeat(ids[asks], held.sum(1)), "neighbour": others_[top][held], "cosine": best[held]})

    packaged()
    met = asking.unionByName(asked).groupBy("label", "a", "b").applyInArrow(near, "vec_id long, neighbour long, cosine double")
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("cosine"), "neighbour"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k)

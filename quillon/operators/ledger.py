"""Append-only ledgers: latest and previous rows, revisions, states by outcomes, pauses, pending selections, uniqueness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key in the given order (all of it descending)."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(o) for o in order]))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def with_revisions(rows: DataFrame, key: str, *order: str, id_: str) -> DataFrame:
    """revision (from 1 in each key) and supersedes: the id of the row before."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("revision", F.row_number().over(w)).withColumn("supersedes", F.lag(id_).over(w))


def with_previous(rows: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    return rows.withColumn("previous", F.lag(value).over(Window.partitionBy(key).orderBy(*order)))


def attempt_states(candidates: DataFrame, attempts: DataFrame, key: str, outcome: str, ok: str, restricted: str, most: int) -> DataFrame:
    """Each candidate's state, of five that exclude each other; candidates without attempts are new."""
    counted = attempts.groupBy(key).agg(
        F.count("*").alias("attempts"), F.count_if(F.col(outcome) == ok).alias("succeeded"), F.count_if(F.col(outcome) == restricted).alias("restricted")
    )
    joined = candidates.join(counted, key, "left").na.fill(0, ["attempts", "succeeded", "restricted"])
    state = (
        F.when(F.col("succeeded") > 0, "succeeded")
        .when(F.col("restricted") > 0, "restricted")
        .when(F.col("attempts") >= most, "exhausted")
        .when(F.col("attempts") > 0, "retry")
        .otherwise("new")
    )
    return joined.withColumn("state", state)


def count_states(states: DataFrame, names: list[str], column: str = "state") -> DataFrame:
    """One row of counts for every listed state, zeros included."""
    return states.agg(*[F.count_if(F.col(column) == n).alias(n) for n in names])


def paused(attempts: DataFrame, key: str, at: str, id_: str, restricted: Column, since: str, until: str, last: int = 3) -> DataFrame:
    """Keys whose last `last` attempts within the window are all restricted. The clock is a parameter, never the wall clock."""
    recent = attempts.where(F.col(at).between(F.to_timestamp(F.lit(since)), F.to_timestamp(F.lit(until))))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at), F.desc(id_)))
    top = recent.withColumn("_rank", rank).where(F.col("_rank") <= last)
    return top.groupBy(key).agg(F.count("*").alias("n"), F.every(restricted).alias("all_restricted")).where((F.col("n") == last) & F.col("all_restricted")).select(key)


def pending(items: DataFrame, done: DataFrame, *key: str) -> DataFrame:
    """Items that no row of done matches on the whole key."""
    return items.join(done.select(*key).distinct(), list(key), "left_anti")


def retryable(items: DataFrame, attempts: DataFrame, key: str, ok: Column, most: int) -> DataFrame:
    """Items tried before, never successfully and fewer than `most` times."""
    counted = attempts.groupBy(key).agg(F.count("*").alias("tries"), F.count_if(ok).alias("hits"))
    return items.join(counted, key).where((F.col("hits") == 0) & (F.col("tries") < most)).drop("hits")


def violations(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once, where they must be unique."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def rediscovered(sightings: DataFrame, *key: str, at: str, link: str | None = None) -> DataFrame:
    """Sightings folded by key: first, last, how many; order doesn't matter. A link is set once; conflicting ones are told."""
    extra = [] if link is None else [F.min(link).alias("link"), (F.count_distinct(link) > 1).alias("link_conflict")]
    return sightings.groupBy(*key).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count("*").alias("times_seen"), *extra)


def versions(retrievals: DataFrame, document: str, content: Column, at: str, id_: str) -> DataFrame:
    """One row for each distinct content of a document, numbered by first retrieval."""
    first = retrievals.withColumn("content_hash", F.sha2(content, 256)).groupBy(document, "content_hash").agg(F.min(F.struct(at, id_)).alias("f"), F.count("*").alias("retrievals"))
    number = F.row_number().over(Window.partitionBy(document).orderBy("f", "content_hash"))
    return first.select(document, "content_hash", number.alias("version_number"), F.col(f"f.{id_}").alias("first_id"), "retrievals")


def machine(log: DataFrame, key: str, status: str, *order: str) -> DataFrame:
    """Folded processing states: latest status, attempts (times it ran), failures."""
    w = Window.partitionBy(key).orderBy(*[F.desc(o) for o in order])
    ranked = log.withColumn("_rank", F.row_number().over(w))
    return ranked.groupBy(key).agg(
        F.max(F.when(F.col("_rank") == 1, F.col(status))).alias("status"), F.count_if(F.col(status) == "running").alias("attempts"), F.count_if(F.col(status) == "failed").alias("failures")
    )

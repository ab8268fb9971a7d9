"""Structured Streaming: rediscovery state, de-duplication and windows under a watermark, gap sessions, cursors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rediscovery(stream: DataFrame, *key: str, at: str) -> DataFrame:
    """First, last and count of sightings by key: order doesn't matter, so late rows are right without a watermark (update mode)."""
    return stream.groupBy(*key).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count("*").alias("times_seen"))


def distinct_within(stream: DataFrame, at: str, delay: str, *key: str) -> DataFrame:
    """The first row of each key; state older than delay goes."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(list(key))


def tumbling(stream: DataFrame, at: str, delay: str, width: str, *key: str) -> DataFrame:
    w = stream.withWatermark(at, delay).groupBy(F.window(at, width).alias("w"), *key).agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("window_start"), *key, "n")


def sessions(stream: DataFrame, at: str, delay: str, gap: str, *key: str) -> DataFrame:
    """Sessions by gap. A session window merges a gap of exactly its length, so pass one unit less where that must split."""
    w = stream.withWatermark(at, delay).groupBy(F.session_window(at, gap).alias("w"), *key).agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("session_start"), *key, "n")


def drain(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and return what it wrote to folder: every batch in append mode, the last in complete mode.

    A batch that runs again overwrites its own files. Nothing is gathered in the driver.
    """
    last: list[int] = []

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/{number}")
        last[:] = [*(last if mode == "append" else ()), *([number] if number not in last else ())]

    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    spark = stream.sparkSession
    if not last:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*[f"{folder}/out/{n}" for n in sorted(set(last))])


def write_changes(stream: DataFrame, path: str, checkpoint: str, *key: str):
    """Update-mode rows to a folder per micro-batch; a batch that runs again overwrites its own folder. Read with `current`."""

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(written: DataFrame, *key: str) -> DataFrame:
    """The newest row of each key."""
    return written.groupBy(*key).agg(F.max_by(F.struct(*[c for c in written.columns if c not in (*key, "batch")]), "batch").alias("r")).select(*key, "r.*")


def after_cursor(items: DataFrame, cursors: DataFrame, id_: str = "item_id") -> DataFrame:
    """Items beyond each subscriber's cursor; a subscriber without one starts at the newest item, so only later items count."""
    newest = items.agg(F.coalesce(F.max(id_), F.lit(0)).alias("newest"))
    held = cursors.crossJoin(F.broadcast(newest)).select("subscriber_id", F.coalesce("cursor", "newest").alias("cursor"))
    return held.join(items, F.col(id_) > F.col("cursor"))


def counts_after(items: DataFrame, cursors: DataFrame, id_: str = "item_id", parts: int = 200) -> DataFrame:
    """subscriber_id, n and newest of after_cursor's rows, without making them: items beyond a cursor are counted from the top.

    Ids and cursors are dealt by value into parts; within one a running count is exact, and the items of all higher parts are
    added. Bounds and these totals are taken once, so every row is dealt by the same ones.
    """
    ids = items.select(F.col(id_).alias("v")).where("v is not null")
    known = ids.agg(F.percentile_approx("v", [i / parts for i in range(1, parts)]).alias("bounds"), F.max("v").alias("newest")).first()
    bounds = sorted(set(known["bounds"] or []))
    part = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < F.col("v"))) if bounds else F.lit(0)
    held = {r["part"]: r["count"] for r in ids.groupBy(part.alias("part")).count().collect()}
    higher = F.array(*[F.lit(sum(n for p, n in held.items() if p > i)).cast("long") for i in range(len(bounds) + 1)])
    newest = F.lit(known["newest"]).cast("long")
    # Without a cursor a subscriber starts at the newest item, so nothing is beyond; the same holds from there on.
    behind = cursors.where(F.col("cursor") < newest).select("subscriber_id", F.col("cursor").alias("v"))
    marks = ids.groupBy("v").agg(F.count("*").alias("n")).union(behind.select("v").distinct().select("v", F.lit(0).cast("long")))
    marks = marks.groupBy("v").agg(F.sum("n").alias("n")).withColumn("part", part)
    above = F.sum("n").over(Window.partitionBy("part").orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, -1))
    counted = marks.select("v", (F.coalesce(above, F.lit(0)) + F.get(higher, F.col("part"))).alias("n"))
    return behind.join(counted, "v").groupBy("subscriber_id").agg(F.sum("n").alias("n"), F.max(newest).alias("newest"))


def advanced(cursors: DataFrame, delivered: DataFrame, id_: str = "item_id") -> DataFrame:
    """Cursors after acknowledgement; they never go back."""
    most = delivered.groupBy("subscriber_id").agg(F.max(id_).alias("top"))
    return cursors.join(most, "subscriber_id", "left").select("subscriber_id", F.greatest("cursor", "top").alias("cursor"))

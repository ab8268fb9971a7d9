"""Queries that run streams over the stored events, each to its end, and transcripts, feeds and pages."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillon.operators import transcripts as X
from quillon.shipping import shared_folder
from quillon.sources import feeds
from quillon.streaming import discovery as S

from ._registry import query


def _stream(t):
    schema = t.events.schema
    stream = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _folder(t) -> str:
    return f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"


def _drained(t, stream, mode="append"):
    return S.drain(stream, _folder(t), mode)


@query("SELECT event_type, user_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS times_seen FROM events GROUP BY 1, 2")
def stream_rediscovery(t):
    return _drained(t, S.rediscovery(_stream(t), "event_type", "user_id", at="ts"), "complete")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup_watermark(t):
    return _drained(t, S.distinct_within(_stream(t).select("ts", "user_id", "event_type"), "ts", "60 days", "user_id", "event_type")).select("user_id", "event_type")


@query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling(t):
    return _drained(t, S.tumbling(_stream(t), "ts", "1 hour", "1 day", "event_type"), "complete")


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 12 HOUR THEN 1 ELSE 0 END AS cut FROM events),
    s AS (SELECT user_id, ts, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT min(ts) AS session_start, user_id, count(*) AS n FROM s GROUP BY user_id, k"""
)
def stream_session(t):
    return _drained(t, S.sessions(_stream(t), "ts", "1 hour", "12 hours", "user_id"), "complete")


@query(
    """WITH c AS (SELECT c_custkey AS subscriber_id, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey * 6 END AS cursor FROM customer), m AS (SELECT max(event_id) AS top FROM events)
    SELECT subscriber_id, count(*) AS n, max(event_id) AS newest FROM (SELECT subscriber_id, coalesce(cursor, top) AS cursor FROM c, m) JOIN events ON event_id > cursor GROUP BY 1"""
)
def stream_cursor(t):
    items = t.events.select(F.col("event_id").alias("item_id"))
    cursors = t.customer.select(F.col("c_custkey").alias("subscriber_id"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey") * 6).alias("cursor"))
    return S.counts_after(items, cursors)


def _cues(t):
    """Turns play cues. Every fourth starts early and repeats the end of the one before, as rolling captions do; others that
    touch the one before don't overlap it."""
    from pyspark.sql import Window

    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    tail = F.regexp_extract(before, "(\\S+ \\S+ \\S+)\\s*$", 1)
    early = F.col("turn") % 4 == 1
    said = F.when(early, F.concat_ws(" ", tail, "text")).otherwise(F.col("text"))
    start = F.col("turn") * 2000 - F.when(early, 500).otherwise(0)
    return t.conversations.select(F.col("conv_id").alias("transcript_id"), F.col("turn").alias("cue_index"), start.alias("start_ms"), (F.col("turn") * 2000 + 2000).alias("end_ms"), said.alias("text"))


@query()
def transcript_fold(t):
    return X.normalize(_cues(t)).drop("normalized")


@query("SELECT DISTINCT conv_id AS transcript_id, true AS exact FROM conversations")
def transcript_reconstruction(t):
    return X.reconstructed(X.normalize(_cues(t)))


@query("SELECT page_id AS endpoint_id, url AS external_id, 'page ' || page_id AS title, url AS link FROM pages")
def feed_entries(t):
    """Pages as one-entry feeds, parsed again."""
    link = F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    xml = F.concat(F.lit("<rss><channel><item><title>page "), F.col("page_id").cast("string"), F.lit("</title><link>"), link, F.lit("</link></item></channel></rss>"))
    return feeds.entries(t.pages.select(F.col("page_id").alias("endpoint_id"), xml.alias("xml"))).select("endpoint_id", "external_id", "title", "link")


@query(
    """SELECT event_id, CASE WHEN code BETWEEN 200 AND 299 THEN 'succeeded' WHEN code IN (401, 403) THEN 'access_restricted' WHEN code IN (404, 410) THEN 'unavailable' ELSE 'failed' END AS outcome
    FROM (SELECT event_id, [200, 204, 401, 403, 404, 410, 500, 302][event_id % 8 + 1] AS code FROM events)"""
)
def retrieval_outcomes(t):
    code = F.get(F.array(*[F.lit(c) for c in (200, 204, 401, 403, 404, 410, 500, 302)]), (F.col("event_id") % 8).cast("int"))
    return t.events.select("event_id", feeds.outcome(code).alias("outcome"))


@query(
    """WITH x AS (SELECT doc_id, source AS video_id, lang AS track_id, CASE WHEN doc_id % 5 < 2 THEN 'publisher' ELSE 'automatic' END AS kind, CASE WHEN doc_id % 3 = 0 THEN 'vtt' ELSE 'srv3' END AS ext, CASE WHEN doc_id % 7 <> 0 THEN 'https://e.invalid/' || doc_id END AS url FROM documents WHERE doc_id % 2 = 0 OR lang <> 'en'),
    g AS (SELECT video_id, track_id, count(*) FILTER (WHERE ok AND kind = 'publisher') AS p, count(*) FILTER (WHERE ok AND kind = 'automatic') AS a, min(url) FILTER (WHERE ok AND kind = 'publisher') AS pu, min(url) FILTER (WHERE ok AND kind = 'automatic') AS au
      FROM (SELECT *, ext = 'vtt' AND url IS NOT NULL AS ok FROM x) GROUP BY 1, 2)
    SELECT video_id, track_id, CASE WHEN p = 1 THEN pu WHEN p = 0 AND a = 1 THEN au END AS url, CASE WHEN p = 1 THEN NULL WHEN p > 1 THEN 'ambiguous_publisher' WHEN a > 1 THEN 'ambiguous_automatic' WHEN a = 0 THEN 'no_track' END AS issue FROM g"""
)
def transcript_tracks(t):
    i = F.col("doc_id")
    rows = t.documents.where("doc_id % 2 = 0 or lang <> 'en'").select(
        F.col("source").alias("video_id"), F.col("lang").alias("track_id"), F.when(i % 5 < 2, "publisher").otherwise("automatic").alias("kind"), F.when(i % 3 == 0, "vtt").otherwise("srv3").alias("ext"),
        F.when(i % 7 != 0, F.concat(F.lit("https://e.invalid/"), i.cast("string"))).alias("url"),
    )
    return X.select_track(rows, allow_automatic=True)


@query()
def transcript_timeline_counts(t):
    return X.timeline_counts(X.normalize(_cues(t)))


@query(
    """WITH c AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9 .,]', ' ', 'g'), '\\s+', ' ', 'g')) AS said FROM conversations)
    SELECT conv_id AS transcript_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS cue_index, turn * 2000 AS start_ms, turn * 2000 + 1500 AS end_ms, said AS text FROM c WHERE said <> ''"""
)
def caption_round_trip(t):
    """Turns written as WebVTT and parsed again."""
    said = F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9 .,]", " ")
    stamp = lambda ms: F.concat(F.format_string("%02d:%02d:%02d.", (ms / 3600000).cast("int"), (ms / 60000 % 60).cast("int"), (ms / 1000 % 60).cast("int")), F.lpad((ms % 1000).cast("string"), 3, "0"))
    at = F.col("turn") * 2000
    cue = F.concat(stamp(at), F.lit(" --> "), stamp(at + 1500), F.lit("\n<c>"), said, F.lit("</c>"))
    files = t.conversations.groupBy(F.col("conv_id").alias("transcript_id")).agg(F.sort_array(F.collect_list(F.struct("turn", cue.alias("cue")))).alias("cues"))
    text = F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform("cues", lambda c: c["cue"]), "\n\n"))
    return X.captions(files.select("transcript_id", text.alias("text"))).drop("carried")

"""Queries over stores that only grow. Documents, events and orders play what comes in."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import store as S

from ._registry import query


@query(
    """WITH i AS (SELECT source || '-' || lang AS k, lang AS language, CASE WHEN source = 'src2' THEN 'o' || (doc_id % 2) ELSE 'o' END AS owner, source FROM documents),
    g AS (SELECT k, min(source) AS source, min(language) AS language, min(owner) <> max(owner) AS twice, count(*) AS times FROM i GROUP BY 1),
    j AS (SELECT *, source <> 'src0' AS stored, CASE WHEN source = 'src1' AND language <> 'en' THEN 'language' WHEN source = 'src3' THEN 'owner' WHEN twice THEN 'owner' ELSE '' END AS differs FROM g)
    SELECT k, CASE WHEN differs <> '' THEN 'conflict' WHEN stored THEN 'found' ELSE 'created' END AS outcome, differs, times FROM j"""
)
def source_get_or_create(t):
    owner = F.when(F.col("source") == "src2", F.concat(F.lit("o"), (F.col("doc_id") % 2).cast("string"))).otherwise("o")
    incoming = t.documents.select(F.concat_ws("-", "source", "lang").alias("k"), F.col("lang").alias("language"), owner.alias("owner"), "source")
    held = incoming.where("source <> 'src0'").groupBy("k", "source", "language").agg(F.min("owner").alias("owner"))
    stored = held.select("k", F.when(F.col("source") == "src1", "en").otherwise(F.col("language")).alias("language"), F.when(F.col("source") == "src3", "p").otherwise(F.col("owner")).alias("owner"))
    return S.get_or_create(incoming, stored, "k", "language", "owner")


@query("SELECT url, 1 AS versions, min(page_id) AS page_id FROM pages GROUP BY 1")
def idempotent_append(t):
    """Pages appended to a store of half of them, twice over."""
    rows = t.pages.groupBy("url").agg(F.min("page_id").alias("page_id"))
    stored = rows.where("page_id % 2 = 0")
    once = S.append_new(stored, rows, "url")
    return S.append_new(once, rows, "url").groupBy("url").agg(F.count("*").cast("int").alias("versions"), F.min("page_id").alias("page_id"))


@query(
    """WITH v AS (SELECT user_id AS endpoint_id, ts, event_id, CASE event_type WHEN 'error' THEN false WHEN 'purchase' THEN true END AS is_on FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY endpoint_id ORDER BY ts DESC, event_id DESC) AS k FROM v WHERE is_on IS NOT NULL)
    SELECT u.endpoint_id, coalesce(is_on, true) AS is_active FROM (SELECT DISTINCT user_id AS endpoint_id FROM events UNION SELECT unnest(range(1000000, 1000003))) u LEFT JOIN r ON r.endpoint_id = u.endpoint_id AND k = 1"""
)
def endpoint_activity(t):
    kind = F.col("event_type")
    code = F.when(kind == "error", F.when(F.col("event_id") % 2 == 0, 401).otherwise(403)).when(kind != "purchase", 200)
    events = t.events.select(F.col("user_id").alias("endpoint_id"), F.col("ts").alias("at"), "event_id", code.alias("code"))
    return S.active_endpoints(t.events.select(F.col("user_id").alias("endpoint_id")).distinct().union(t.spark.range(1000000, 1000003).toDF("endpoint_id")), events)


@query(
    """WITH r AS (SELECT event_id AS record_id, CASE WHEN event_id % 17 = 0 THEN ' ' ELSE 'u' || event_id END AS locator, CASE WHEN event_id % 19 <> 0 THEN ts END AS "at", CASE WHEN event_type = 'error' THEN 'failed' ELSE 'succeeded' END AS outcome,
      CASE WHEN event_id % 5 <> 0 AND (event_type <> 'error' OR event_id % 7 = 0) THEN event_type END AS content, CASE WHEN event_type = 'error' AND event_id % 3 <> 0 THEN 'timeout' WHEN event_id % 23 = 0 THEN 'late' END AS error FROM events)
    SELECT record_id, CASE WHEN NOT regexp_matches(locator, '\\S') THEN 'blank_locator' WHEN "at" IS NULL THEN 'no_time' WHEN outcome = 'succeeded' AND content IS NULL THEN 'succeeded_without_content' WHEN outcome <> 'succeeded' AND content IS NOT NULL THEN 'content_without_success'
      WHEN outcome <> 'succeeded' AND error IS NULL THEN 'failed_without_error' WHEN outcome = 'succeeded' AND error IS NOT NULL THEN 'error_on_success' END AS issue FROM r"""
)
def retrieval_record_issues(t):
    i, kind = F.col("event_id"), F.col("event_type")
    bad = kind == "error"
    rows = t.events.select(
        i.alias("record_id"), F.when(i % 17 == 0, " ").otherwise(F.concat(F.lit("u"), i.cast("string"))).alias("locator"), F.when(i % 19 != 0, F.col("ts")).alias("at"), F.when(bad, "failed").otherwise("succeeded").alias("outcome"),
        F.when((i % 5 != 0) & (~bad | (i % 7 == 0)), kind).alias("content"), F.when(bad & (i % 3 != 0), "timeout").when(i % 23 == 0, "late").alias("error"),
    )
    return S.record_issues(rows)


@query(
    """SELECT page_id AS record_id, CASE WHEN page_id % 11 = 0 THEN 'candidate_missing' WHEN page_id % 7 = 0 THEN 'fingerprint_differs' WHEN page_id % 5 = 0 THEN 'blob_missing' WHEN page_id % 3 = 0 THEN 'blob_corrupt' END AS issue FROM pages"""
)
def retrieval_match_issues(t):
    i, f = F.col("page_id"), F.sha2("url", 256)
    records = t.pages.select(i.alias("record_id"), i.alias("candidate_id"), F.when(i % 7 == 0, "x").otherwise(f).alias("fingerprint"), i.alias("blob"))
    candidates = t.pages.where("page_id % 11 <> 0").select(i.alias("candidate_id"), f.alias("fingerprint"))
    blobs = t.pages.where("page_id % 5 <> 0").select(i.alias("blob"), F.sha2("html", 256).alias("sha256"), F.when(i % 3 == 0, F.concat("html", F.lit(" "))).otherwise(F.col("html")).alias("content"))
    return S.retrieval_issues(records, candidates, blobs)


@query(
    """WITH p AS (SELECT doc_id AS candidate_id, CASE WHEN doc_id % 3 = 0 THEN ' ' WHEN doc_id % 3 = 1 THEN text END AS a, CASE WHEN doc_id % 2 = 0 THEN text END AS b, ['text/html; charset=utf-8', 'application/pdf', 'Text/Plain', NULL, 'application/xhtml+xml'][doc_id % 5 + 1] AS m FROM documents),
    s AS (SELECT *, CASE WHEN NOT coalesce(lower(trim(split_part(m, ';', 1))) IN ('text/html', 'application/xhtml+xml', 'text/plain'), false) THEN 'unsupported_media_type' WHEN regexp_matches(coalesce(a, ''), '\\S') THEN 'extracted' WHEN regexp_matches(coalesce(b, ''), '\\S') THEN 'extracted_by_fallback' ELSE 'no_text' END AS status FROM p)
    SELECT candidate_id, status, CASE status WHEN 'extracted' THEN sha256(a) WHEN 'extracted_by_fallback' THEN sha256(b) END AS text_hash FROM s"""
)
def acquire_and_extract(t):
    i = F.col("doc_id")
    media = F.get(F.array(*[F.lit(x) for x in ("text/html; charset=utf-8", "application/pdf", "Text/Plain", None, "application/xhtml+xml")]), (i % 5).cast("int"))
    rows = t.documents.select(i.alias("candidate_id"), F.when(i % 3 == 0, " ").when(i % 3 == 1, F.col("text")).alias("a"), F.when(i % 2 == 0, F.col("text")).alias("b"), media.alias("m"))
    return S.acquired(rows, F.col("a"), F.col("b"), F.col("m")).select("candidate_id", "status", F.sha2("text", 256).alias("text_hash"))


@query("SELECT page_id, strlen(html) <= 400 AS fits FROM pages")
def capped_downloads(t):
    return t.pages.select("page_id", S.capped(F.col("html"), 400).alias("fits"))


@query(
    """SELECT o_orderkey AS decision_id, CASE WHEN o_orderstatus = 'F' THEN 'unknown_status' WHEN o_orderkey % 9 = 0 THEN 'blank_reason' WHEN o_orderkey % 13 = 0 THEN 'blank_reviewer' WHEN o_orderkey % 17 = 0 THEN 'reviewer_too_long' END AS issue FROM orders"""
)
def alias_decision_issues(t):
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "O", "approved").when(F.col("o_orderstatus") == "P", "needs_review")
    reviewer = F.when(k % 13 == 0, " ").when(k % 17 == 0, F.repeat(F.lit("r"), F.lit(201))).otherwise(F.col("o_orderpriority"))
    return S.decision_issues(t.orders.select(k.alias("decision_id"), status.alias("status"), F.when(k % 9 != 0, F.col("o_orderpriority")).alias("reason"), reviewer.alias("reviewer")))


@query(
    """WITH p AS (SELECT c_custkey AS proposal_id, c_custkey % 200 AS left_id, 1000 + c_custkey % 150 AS right_id, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS canonical FROM customer),
    l AS (SELECT * FROM (SELECT o_custkey AS proposal_id, o_orderkey AS decision_id, CASE o_orderstatus WHEN 'F' THEN 'rejected' ELSE 'approved' END AS status, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1),
    a AS (SELECT i AS candidate_id, i % 40 AS entity_id FROM (SELECT unnest(range(200)) AS i) WHERE i % 3 = 0 UNION ALL SELECT 1000 + i, i % 40 FROM (SELECT unnest(range(150)) AS i) WHERE i % 4 = 0),
    j AS (SELECT p.*, decision_id, status, x.entity_id AS le, y.entity_id AS re, decision_id % 7 = 0 AS done FROM p LEFT JOIN l USING (proposal_id) LEFT JOIN a x ON x.candidate_id = left_id LEFT JOIN a y ON y.candidate_id = right_id),
    k AS (SELECT *, CASE WHEN status IS NULL THEN 'undecided' WHEN status <> 'approved' THEN 'not_approved' WHEN done THEN 'unchanged' WHEN le <> re THEN 'conflict' WHEN coalesce(le, re) IS NOT NULL THEN 'joined' WHEN canonical IS NOT NULL THEN 'created' ELSE 'no_canonical_name' END AS action FROM j)
    SELECT proposal_id, action, CASE WHEN action IN ('joined', 'unchanged') THEN coalesce(le, re) END AS entity_id FROM k"""
)
def alias_resolution(t):
    from pyspark.sql import Window

    c, k = F.col("c_custkey"), F.col("o_orderkey")
    proposals = t.customer.select(c.alias("proposal_id"), (c % 200).alias("left_id"), (1000 + c % 150).alias("right_id"), F.when(c % 3 != 0, F.col("c_name")).alias("canonical"))
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    decisions = t.orders.select(F.col("o_custkey").alias("proposal_id"), k.alias("decision_id"), F.row_number().over(order).alias("revision"), F.when(F.col("o_orderstatus") == "F", "rejected").otherwise("approved").alias("status"))
    n = F.col("id")
    assigned = t.spark.range(200).where("id % 3 = 0").select(n.alias("candidate_id"), (n % 40).alias("entity_id")).union(t.spark.range(150).where("id % 4 = 0").select(n + 1000, n % 40))
    return S.resolved(proposals, decisions, assigned, t.orders.where("o_orderkey % 7 = 0").select(k.alias("decision_id")))


_COMMANDS = "CASE event_id % 6 WHEN 0 THEN 'approve' WHEN 1 THEN 'subscribe' WHEN 2 THEN 'unsubscribe' WHEN 3 THEN 'register' WHEN 4 THEN CASE WHEN event_id % 60 = 4 THEN 'forget' ELSE 'request' END ELSE 'request' END"


@query(
    f"""WITH c AS (SELECT user_id AS chat_id, ts, event_id, {_COMMANDS} AS cmd FROM events WHERE event_type <> 'error'), f AS (SELECT *, max(CASE WHEN cmd = 'forget' THEN (ts, event_id) END) OVER (PARTITION BY chat_id) AS fg FROM c),
    k AS (SELECT *, (ts, event_id) AS w FROM f WHERE fg IS NULL OR (ts, event_id) > fg), g AS (SELECT chat_id, max(w) FILTER (WHERE cmd = 'approve') AS a, max(w) FILTER (WHERE cmd = 'subscribe') AS s, max(w) FILTER (WHERE cmd = 'unsubscribe') AS u FROM k GROUP BY 1)
    SELECT chat_id, a IS NOT NULL AS approved, a IS NOT NULL AND s IS NOT NULL AND (u IS NULL OR s > u) AS subscribed FROM g"""
)
def subscriber_states(t):
    log = t.events.where("event_type <> 'error'").select(F.col("user_id").alias("chat_id"), F.col("ts").alias("at"), "event_id", F.expr(_COMMANDS).alias("command"))
    return S.subscribers(log)


@query(
    """SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'only_built' WHEN doc_id % 10 = 1 THEN 'only_rebuilt' ELSE 'differs' END AS difference FROM documents WHERE doc_id % 10 < 2 OR (doc_id % 10 = 2 AND source <> 'src2')"""
)
def corpus_verification(t):
    """A corpus against itself with rows left out on either side and a field changed."""
    docs = t.documents.select("doc_id", "text", "lang", "source")
    again = docs.where("doc_id % 10 <> 0").withColumn("source", F.when(F.col("doc_id") % 10 == 2, "src2").otherwise(F.col("source")))
    return S.verified(docs.where("doc_id % 10 <> 1"), again, "doc_id", "text", "lang", "source")


@query(
    """WITH d AS (SELECT doc_id, source, text, doc_id % 13 AS z FROM documents), r AS (SELECT doc_id, z, source, CASE WHEN z IN (1, 4, 5, 6, 7) OR z > 9 THEN 'synthetic' ELSE 'human' END AS label FROM d)
    SELECT doc_id AS record_id, CASE WHEN z = 0 THEN 'bad_source_id' WHEN source = 'src3' THEN 'source_missing' WHEN z = 2 THEN 'text_hash_differs' WHEN z = 4 THEN 'synthetic_without_prompt' WHEN z = 8 THEN 'prompt_on_human' WHEN z = 5 THEN 'prompt_missing' WHEN z = 6 THEN 'prompt_hash_differs' END AS issue FROM r"""
)
def corpus_intake_issues(t):
    d = t.documents.select("doc_id", "source", "text", (F.col("doc_id") % 13).alias("z"))
    z, h = F.col("z"), F.sha2("text", 256)
    synthetic = z.isin(1, 4, 5, 6, 7) | (z > 9)
    label = F.when(synthetic, "synthetic").otherwise("human")
    source = F.concat("source", F.when(synthetic, "-s").otherwise("-h"))
    prompt = F.when((synthetic & (z != 4)) | (z == 8), F.when(z == 5, -1).otherwise(F.col("doc_id")))
    records = d.select(
        F.col("doc_id").alias("record_id"), F.when(z == 0, "Bad id").otherwise(source).alias("source_id"), label.alias("label"), prompt.alias("prompt_id"),
        F.when(z == 6, "x").otherwise(F.sha2(F.col("doc_id").cast("string"), 256)).alias("prompt_sha256"), "text", F.when(z == 2, "x").otherwise(h).alias("text_sha256"),
    )
    prompts = d.select(F.col("doc_id").alias("prompt_id"), F.col("doc_id").cast("string").alias("text"))
    sources = d.where("source <> 'src3'").select(source.alias("source_id"), label.alias("label")).distinct()
    return S.intake_issues(records, prompts, sources)

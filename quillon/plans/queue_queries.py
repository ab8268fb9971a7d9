"""Queries over work queues, their orders and counts. Events, orders and documents play items."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import aliases as A
from quillon.operators import mentions as M
from quillon.operators import queues as U

from ._registry import query
from .mention_queries import _candidates, _signals_sql


@query("SELECT 'after' AS mode, event_id, user_id FROM (SELECT * FROM events WHERE event_id > 700 ORDER BY event_id LIMIT 50) UNION ALL SELECT 'newest', event_id, user_id FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 50) UNION ALL SELECT 'oldest', event_id, user_id FROM (SELECT * FROM events ORDER BY ts, event_id LIMIT 50)")
def parse_queue_modes(t):
    items = t.events.select(F.col("event_id").alias("item_id"), F.col("ts").alias("fetched_at"), "user_id")
    parts = [U.parse_queue(items, mode, 50, after).select(F.lit(mode).alias("mode"), F.col("item_id").alias("event_id"), "user_id") for mode, after in (("after", 700), ("newest", None), ("oldest", None))]
    return parts[0].union(parts[1]).union(parts[2])


@query("SELECT o_orderkey, o_orderdate FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') ORDER BY o_orderdate, o_orderkey LIMIT 100")
def acquire_queue(t):
    waiting = t.orders.select(F.col("o_orderkey").alias("candidate_id"), F.col("o_orderdate").alias("first_discovered_at"))
    done = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("candidate_id"))
    return U.acquire_queue(waiting, done, 100).select(F.col("candidate_id").alias("o_orderkey"), F.col("first_discovered_at").alias("o_orderdate"))


_RANK = "CASE signal WHEN 'acronym' THEN 0 WHEN 'short_name' THEN 1 ELSE 2 END"


@query(_signals_sql("CAST(0 AS BIGINT)") + f" SELECT left_id, right_id, signal, left_n + right_n AS n FROM z ORDER BY {_RANK}, left_n + right_n DESC, entity_type, left_canonical, right_canonical LIMIT 120")
def alias_signal_order(t):
    found = A.signals(A.forms(_candidates(t, by_document=False))).withColumn("shared", F.lit(0))
    return U.ranked_signals(found, 120).select("left_id", "right_id", "signal", (F.col("left_n") + F.col("right_n")).alias("n"))


@query(_signals_sql("doc_id") + f" SELECT left_id, right_id, signal FROM z ORDER BY confidence DESC, {_RANK}, entity_type, left_canonical, right_canonical, left_id, right_id LIMIT 80")
def alias_proposal_examples(t):
    return U.proposal_examples(A.signals(A.forms(_candidates(t, by_document=True))), 80).select("left_id", "right_id", "signal")


@query(
    """WITH c AS (SELECT c_custkey AS candidate_id, CASE WHEN c_custkey % 5 <> 0 THEN c_nationkey END AS "start", CASE WHEN c_custkey % 7 <> 0 THEN c_nationkey + 3 END AS "end" FROM customer)
    SELECT candidate_id, "start", "end" FROM c ORDER BY "start" ASC NULLS LAST, "end" ASC NULLS LAST, candidate_id LIMIT 300"""
)
def coverage_row_order(t):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    return U.in_text_order(t.customer.select(k.alias("candidate_id"), F.when(k % 5 != 0, n).alias("start"), F.when(k % 7 != 0, n + 3).alias("end")), 300)


@query(
    """WITH s AS (SELECT *, count(*) OVER (PARTITION BY o_orderstatus) AS group_total FROM orders) SELECT o_orderkey, o_orderstatus, group_total FROM s ORDER BY o_orderdate DESC, o_orderkey LIMIT 40"""
)
def counts_before_limit(t):
    return U.page_with_totals(t.orders, 40, "o_orderstatus", F.desc("o_orderdate"), "o_orderkey").select("o_orderkey", "o_orderstatus", "group_total")


@query(
    """SELECT source, max(doc_id) AS newest, max(doc_id) FILTER (WHERE doc_id % 4 <> 0 AND regexp_matches(text, '\\S')) AS newest_with_content FROM documents GROUP BY 1"""
)
def latest_with_content(t):
    rows = t.documents.select("source", "doc_id", F.col("doc_id").alias("at"), F.when(F.col("doc_id") % 4 != 0, F.col("text")).alias("content"))
    return U.newest_with_content(rows, "source", "at", "doc_id", "content")


@query("SELECT count(*) AS items, count(*) FILTER (WHERE o_orderstatus = 'F') AS \"F\", count(*) FILTER (WHERE o_orderstatus = 'O') AS \"O\", count(*) FILTER (WHERE o_orderstatus = 'P') AS \"P\", count(*) FILTER (WHERE o_orderstatus = 'X') AS \"X\" FROM orders")
def batch_outcome_counts(t):
    return U.batch_counts(t.orders, ("F", "O", "P", "X"), "o_orderstatus")


@query(
    """WITH s AS (SELECT CASE WHEN regexp_matches(text, '\\S') AND doc_id % 5 <> 0 THEN 'content' WHEN regexp_matches(text, '\\S') AND doc_id % 10 = 0 THEN 'summary' ELSE 'none' END AS origin FROM documents)
    SELECT count(*) AS items, count(*) FILTER (WHERE origin = 'content') AS content, count(*) FILTER (WHERE origin = 'summary') AS summary, count(*) FILTER (WHERE origin = 'none') AS none FROM s"""
)
def news_report_counts(t):
    holds = F.coalesce(F.col("text").rlike("\\S"), F.lit(False))
    origin = F.when(holds & (F.col("doc_id") % 5 != 0), "content").when(holds & (F.col("doc_id") % 10 == 0), "summary").otherwise("none")
    return U.batch_counts(t.documents.select(origin.alias("origin")), ("content", "summary", "none"), "origin")


@query(
    """WITH p AS (SELECT * FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 200) SELECT event_id, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'processed' END AS status,
      CASE WHEN event_type <> 'error' THEN upper(event_type) END AS result, CASE WHEN event_type = 'error' THEN 'error event' END AS error FROM p"""
)
def bounded_batch(t):
    batch = U.parse_queue(t.events.select(F.col("event_id").alias("item_id"), F.col("ts").alias("fetched_at"), "event_type"), "after", 200, 500)
    done = U.isolated(batch, F.upper("event_type"), F.when(F.col("event_type") == "error", "error event"))
    return done.select(F.col("item_id").alias("event_id"), "status", "result", "error")


@query(
    """WITH RECURSIVE e AS (SELECT user_id AS chat_id, event_id AS request_id, CAST(floor(epoch(ts)) AS BIGINT) AS "at", row_number() OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT), event_id) AS k FROM events),
    r(chat_id, request_id, "at", k, last, wait) AS (SELECT chat_id, request_id, "at", k, "at", CAST(0 AS BIGINT) FROM e WHERE k = 1
      UNION ALL SELECT e.chat_id, e.request_id, e."at", e.k, CASE WHEN e."at" - r.last >= 21600 THEN e."at" ELSE r.last END, greatest(0, 21600 - (e."at" - r.last)) FROM r JOIN e ON e.chat_id = r.chat_id AND e.k = r.k + 1)
    SELECT chat_id, request_id, "at", wait = 0 AS accepted, wait FROM r"""
)
def request_cooldown(t):
    rows = t.events.select(F.col("user_id").alias("chat_id"), F.col("event_id").alias("request_id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
    return U.cooldown(rows, 6 * 3600)


_FORMS = f"""raw AS (SELECT doc_id, unnest(regexp_extract_all(text, '{M.SHAPES}')) AS surface FROM documents), m AS (SELECT doc_id, replace(lower(surface), 'ß', 'ss') AS form FROM raw),
    top AS (SELECT form, row_number() OVER (ORDER BY count(*) DESC, form) AS r FROM m GROUP BY 1 QUALIFY r <= 40), pr AS (SELECT a.form AS left_form, b.form AS right_form FROM top a JOIN top b ON a.r < b.r)"""


@query(f"WITH {_FORMS}, h AS (SELECT DISTINCT doc_id, form FROM m) SELECT left_form, right_form, (SELECT count(*) FROM h a JOIN h b USING (doc_id) WHERE a.form = left_form AND b.form = right_form) AS shared FROM pr")
def alias_shared_documents(t):
    """The 40 most frequent forms, each with those that follow it."""
    found = M.mentions(t.documents).select(F.col("normalized").alias("form"), F.col("doc_id").alias("document_id"))
    top = found.groupBy("form").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "form").limit(40)
    a, b = top.select(F.col("form").alias("left_form"), F.col("n").alias("ln")), top.select(F.col("form").alias("right_form"), F.col("n").alias("rn"))
    pairs = F.broadcast(a).join(b, (F.col("ln") > F.col("rn")) | ((F.col("ln") == F.col("rn")) & (F.col("left_form") < F.col("right_form")))).select("left_form", "right_form")
    return U.shared_documents(found, pairs)


@query(
    """WITH x AS (SELECT source, unnest(['lang:' || lang, CASE WHEN length(text) < 400 THEN 'short' END, CASE WHEN contains(text, '|') THEN 'table' END]) AS l FROM documents)
    SELECT source, array_to_string(list_sort(list(DISTINCT l)), ',') AS limitations FROM x WHERE l IS NOT NULL GROUP BY 1"""
)
def limitation_union(t):
    own = F.array(F.concat(F.lit("lang:"), "lang"))
    found = F.array_compact(F.array(F.when(F.length("text") < 400, "short"), F.when(F.contains("text", F.lit("|")), "table")))
    return U.limitations(t.documents.select("source", own.alias("a"), found.alias("b")), "source", "a", "b")


@query(
    """WITH o AS (SELECT o_orderkey, [o_orderkey, o_orderkey + 1, o_custkey] AS named, [o_orderkey, o_custkey, o_orderkey + (o_orderkey % 2)] AS known FROM orders)
    SELECT o_orderkey, array_to_string(list_sort(list_distinct(list_filter(named, lambda x: NOT list_contains(known, x)))), ',') AS unknown FROM o WHERE len(list_filter(named, lambda x: NOT list_contains(known, x))) > 0"""
)
def unknown_member_ids(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = U.unknown_ids(t.orders, F.array(k, k + 1, c), F.array(k, c, k + k % 2))
    return rows.select("o_orderkey", F.array_join(F.transform("unknown", lambda x: x.cast("string")), ",").alias("unknown"))


_PROPOSED = "pm AS (SELECT DISTINCT l_orderkey % 50 AS group_id, l_orderkey AS proposal_id, l_partkey % 400 AS fragment_id FROM lineitem)"


@query(f"WITH {_PROPOSED} SELECT a.group_id, a.proposal_id AS left_id, b.proposal_id AS right_id, count(*) AS shared FROM pm a JOIN pm b ON a.group_id = b.group_id AND a.fragment_id = b.fragment_id AND a.proposal_id < b.proposal_id GROUP BY 1, 2, 3 HAVING count(*) >= 2")
def overlapping_proposals(t):
    members = t.lineitem.groupBy((F.col("l_orderkey") % 50).alias("group_id"), F.col("l_orderkey").alias("proposal_id")).agg(F.collect_set((F.col("l_partkey") % 400).cast("short")).alias("members"))
    return U.overlapping(members, least=2)


@query(
    f"""WITH {_PROPOSED}, pp AS (SELECT a.group_id, a.proposal_id, a.fragment_id AS l, b.fragment_id AS r FROM pm a JOIN pm b ON a.proposal_id = b.proposal_id AND a.fragment_id < b.fragment_id),
    e AS (SELECT *, (l + r) % 7 AS points, CASE (l + r) % 3 WHEN 0 THEN 'action' WHEN 1 THEN 'place' ELSE 'time' END AS d FROM pp WHERE (l + r) % 5 <> 0)
    SELECT proposal_id, count(*) AS pairs, CAST(sum(points) AS BIGINT) AS points, array_to_string(list_sort(list(DISTINCT d)), ',') AS dimensions FROM e GROUP BY 1"""
)
def cluster_evidence(t):
    members = t.lineitem.select((F.col("l_orderkey") % 50).alias("group_id"), F.col("l_orderkey").alias("proposal_id"), (F.col("l_partkey") % 400).alias("fragment_id")).distinct()
    s = F.col("left_id") + F.col("right_id")
    left, right = members.withColumnRenamed("fragment_id", "left_id"), members.select("proposal_id", F.col("fragment_id").alias("right_id"))
    pairs = left.join(right, "proposal_id").where("left_id < right_id").where(s % 5 != 0).select("group_id", "left_id", "right_id", (s % 7).alias("points"), F.when(s % 3 == 0, "action").when(s % 3 == 1, "place").otherwise("time").alias("dimensions")).distinct()
    return U.cluster_evidence(members, pairs)


@query("SELECT s.c_custkey AS seed_id, c.c_custkey AS candidate_id FROM customer s JOIN customer c ON c.c_mktsegment = s.c_mktsegment AND c.c_custkey % 300 = s.c_custkey % 300")
def exact_canonical_scope(t):
    rows = t.customer.select(F.col("c_custkey").alias("candidate_id"), F.col("c_mktsegment").alias("entity_type"), (F.col("c_custkey") % 300).cast("string").alias("canonical"))
    return U.exact_scope(rows, rows)


@query(
    """WITH c AS (SELECT c_nationkey AS document_id, c_mktsegment AS entity_type, c_custkey % 60 AS canonical FROM customer), k AS (SELECT DISTINCT entity_type, canonical FROM c WHERE document_id IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1))
    SELECT entity_type, canonical, count(*) AS n, count(DISTINCT document_id) AS documents FROM c JOIN k USING (entity_type, canonical) GROUP BY 1, 2"""
)
def corpus_group_lookup(t):
    rows = t.customer.select(F.col("c_nationkey").alias("document_id"), F.col("c_mktsegment").alias("entity_type"), (F.col("c_custkey") % 60).alias("canonical"))
    return U.groups_of(t.nation.where("n_regionkey = 1").select(F.col("n_nationkey").alias("document_id")), rows)


@query(
    """WITH x AS (SELECT doc_id, sha256(text) AS h, CASE doc_id % 4 WHEN 0 THEN lang WHEN 1 THEN lang || '-' || upper(source) WHEN 2 THEN lang || '_x' ELSE 'x' END AS tag, CASE WHEN doc_id % 3 = 0 THEN upper(sha256(text)) ELSE sha256(text) END AS digest,
      CASE WHEN doc_id % 5 = 0 THEN '-' || source ELSE source || '.a_' || doc_id END AS source_id FROM documents)
    SELECT doc_id, regexp_matches(tag, '^[A-Za-z]{2,8}(-[A-Za-z0-9]{1,8})*$') AS is_tag, regexp_matches(digest, '^[0-9a-f]{64}$') AS is_digest, regexp_matches(source_id, '^[a-z0-9][a-z0-9._-]{0,99}$') AS is_source_id,
      regexp_matches(left(digest, 40), '^[0-9a-f]{40}$') AS is_revision FROM x"""
)
def identifier_checks(t):
    i, lang, source, h = F.col("doc_id"), F.col("lang"), F.col("source"), F.sha2("text", 256)
    tag = F.when(i % 4 == 0, lang).when(i % 4 == 1, F.concat(lang, F.lit("-"), F.upper(source))).when(i % 4 == 2, F.concat(lang, F.lit("_x"))).otherwise("x")
    digest = F.when(i % 3 == 0, F.upper(h)).otherwise(h)
    name = F.when(i % 5 == 0, F.concat(F.lit("-"), source)).otherwise(F.concat(source, F.lit(".a_"), i.cast("string")))
    return t.documents.select("doc_id", T.is_language_tag(tag).alias("is_tag"), T.is_digest(digest).alias("is_digest"), T.is_source_id(name).alias("is_source_id"), T.is_revision(F.left(digest, F.lit(40))).alias("is_revision"))


@query(
    """WITH x AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN ' /Latest@NewsBot  ' || text || ' ' WHEN 1 THEN '/start' ELSE text END AS said FROM conversations), s AS (SELECT *, regexp_replace(said, '^\\s+|\\s+$', '', 'g') AS u FROM x)
    SELECT conv_id, turn, CASE WHEN starts_with(u, '/') THEN lower(regexp_extract(u, '^/([^\\s@]*)', 1)) END AS command, CASE WHEN starts_with(u, '/') AND regexp_matches(u, '^\\S+\\s+\\S') THEN regexp_extract(u, '^\\S+\\s+(.*)$', 1, 's') END AS argument FROM s"""
)
def command_parse(t):
    k = F.col("turn") % 3
    said = F.when(k == 0, F.concat(F.lit(" /Latest@NewsBot  "), "text", F.lit(" "))).when(k == 1, "/start").otherwise(F.col("text"))
    name, argument = T.command(said)
    return t.conversations.select("conv_id", "turn", name.alias("command"), argument.alias("argument"))

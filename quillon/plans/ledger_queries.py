"""Queries over ledgers and the registry. Orders, customers and events play decisions, candidates and attempts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import ledger as L
from quillon.operators import registry as R
from quillon.operators import runs as U

from ._registry import query

_USERS = "u AS (SELECT DISTINCT user_id FROM events UNION SELECT unnest(range(1000000, 1000005)))"
_STATES = ["new", "retry", "exhausted", "restricted", "succeeded"]


def _users(t):
    return t.events.select("user_id").distinct().union(t.spark.range(1000000, 1000005).toDF("user_id"))


_STATE_SQL = f"""WITH {_USERS}, s AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS ok, count(*) FILTER (WHERE event_type = 'error') AS bad FROM events GROUP BY 1),
    z AS (SELECT u.user_id, coalesce(n, 0) AS attempts, CASE WHEN ok > 0 THEN 'succeeded' WHEN bad > 0 THEN 'restricted' WHEN n >= 3 THEN 'exhausted' WHEN n > 0 THEN 'retry' ELSE 'new' END AS state
      FROM u LEFT JOIN s USING (user_id))"""


def _states(t):
    return L.attempt_states(_users(t), t.events, "user_id", "event_type", "purchase", "error", 3)


@query(_STATE_SQL + " SELECT user_id, attempts, state FROM z")
def acquisition_states(t):
    return _states(t).select("user_id", "attempts", "state")


@query(_STATE_SQL + " SELECT " + ", ".join(f"count(*) FILTER (WHERE state = '{s}') AS \"{s}\"" for s in _STATES) + " FROM z")
def acquisition_state_summary(t):
    return L.count_states(_states(t), _STATES)


@query(
    """WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rk FROM events
      WHERE ts BETWEEN TIMESTAMP '2024-01-02 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00')
    SELECT user_id FROM r WHERE rk <= 3 GROUP BY 1 HAVING count(*) = 3 AND bool_and(event_type IN ('error', 'click'))"""
)
def paused_sources(t):
    return L.paused(t.events, "user_id", "ts", "event_id", F.col("event_type").isin("error", "click"), "2024-01-02", "2024-01-20")


@query(
    """SELECT c_custkey, c_mktsegment FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')
      AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')"""
)
def pending_selection_anti(t):
    orders = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus", "o_orderpriority")
    left = L.pending(t.customer, orders.where("o_orderstatus = 'P'"), "c_custkey")
    return L.pending(left, orders.where("o_orderpriority = '1-URGENT'"), "c_custkey").select("c_custkey", "c_mktsegment")


@query(
    """SELECT c_custkey, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS tries FROM customer c
    WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey) AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')
      AND (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) < 8"""
)
def retry_selection(t):
    orders = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    return L.retryable(t.customer.select("c_custkey"), orders, "c_custkey", F.col("o_orderstatus") == "F", 8)


@query(
    """WITH k AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_nationkey END AS nation FROM customer)
    SELECT c_custkey, nation FROM k WHERE nation NOT IN (1, 2, 3)"""
)
def not_in_with_nulls(t):
    """A null key is excluded by a non-empty NOT IN, unlike by an anti join."""
    k = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 10 != 0, F.col("c_nationkey")).alias("nation"))
    return k.where(~F.col("nation").isin(1, 2, 3))


@query(
    """SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1"""
)
def latest_decision_per_key(t):
    return L.latest(t.orders.select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate"), "o_custkey", "o_orderdate", "o_orderkey").drop("o_orderdate")


@query(
    """SELECT o_custkey, o_orderkey, row_number() OVER w AS revision, lag(o_orderkey) OVER w AS supersedes, lag(o_orderstatus) OVER w AS previous
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"""
)
def previous_status(t):
    rows = L.with_revisions(t.orders.select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate"), "o_custkey", "o_orderdate", "o_orderkey", id_="o_orderkey")
    rows = L.with_previous(rows, "o_custkey", "o_orderstatus", "o_orderdate", "o_orderkey")
    return rows.select("o_custkey", "o_orderkey", F.col("revision").cast("long").alias("revision"), "supersedes", "previous")


@query(
    """WITH l AS (SELECT o_custkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1)
    SELECT c_custkey, c_mktsegment, o_orderstatus AS latest_status FROM customer LEFT JOIN l ON o_custkey = c_custkey WHERE o_orderstatus IS NULL OR o_orderstatus = 'P' ORDER BY c_mktsegment, c_custkey"""
)
def alias_review_queue(t):
    last = L.latest(t.orders, "o_custkey", "o_orderdate", "o_orderkey").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("latest_status"))
    joined = t.customer.select("c_custkey", "c_mktsegment").join(last, "c_custkey", "left")
    return joined.where("latest_status is null or latest_status = 'P'").orderBy("c_mktsegment", "c_custkey")


@query(
    """SELECT c_custkey, n_name, o_orderkey, o_orderdate FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey
    LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'
    ORDER BY o_orderdate DESC NULLS LAST, c_custkey DESC, o_orderkey DESC NULLS LAST LIMIT 1400"""
)
def news_feed_nulls_last(t):
    urgent = t.orders.where("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate")
    nation = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    joined = t.customer.join(nation, "c_nationkey", "left").join(urgent, "c_custkey", "left").select("c_custkey", "n_name", "o_orderkey", "o_orderdate")
    return joined.orderBy(F.desc_nulls_last("o_orderdate"), F.desc("c_custkey"), F.desc_nulls_last("o_orderkey")).limit(1400)


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey > 5000 ORDER BY o_orderkey LIMIT 200")
def after_cursor_slice(t):
    return t.orders.where("o_orderkey > 5000").select("o_orderkey", "o_custkey", "o_orderstatus").orderBy("o_orderkey").limit(200)


@query("SELECT * FROM (SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 500) WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def limit_then_filter(t):
    first = t.orders.orderBy("o_orderdate", "o_orderkey").limit(500).select("o_orderkey", "o_custkey")
    return first.join(t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")


@query("SELECT source, min(lang) AS language, count(DISTINCT lang) AS languages, CASE WHEN count(DISTINCT lang) = 1 THEN min(lang) END AS default_language FROM documents GROUP BY 1")
def source_language_rollup(t):
    by = t.documents.groupBy("source").agg(F.min("lang").alias("language"), F.count_distinct("lang").alias("languages"))
    return by.withColumn("default_language", F.when(F.col("languages") == 1, F.col("language")))


# Registry: an order is a link of its customer's entity to proposal o_orderkey % 4000; line items are decisions on proposals.
_DECISIONS = """d AS (SELECT l_orderkey % 4000 AS proposal_id, l_orderkey * 10 + l_linenumber AS decision_id, row_number() OVER (PARTITION BY l_orderkey % 4000 ORDER BY l_shipdate, l_orderkey, l_linenumber) AS revision,
      CASE l_returnflag WHEN 'R' THEN 'rejected' WHEN 'A' THEN 'approved' ELSE CASE WHEN l_linestatus = 'O' THEN 'approved' ELSE 'needs_review' END END AS status FROM lineitem),
    l AS (SELECT *, row_number() OVER (PARTITION BY proposal_id ORDER BY revision DESC, decision_id DESC) AS r FROM d),
    k AS (SELECT o_custkey AS entity_id, o_orderkey AS link_id, o_orderkey % 4000 AS proposal_id, CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE (SELECT decision_id FROM l WHERE r = 1 AND l.proposal_id = o_orderkey % 4000) END AS applied FROM orders),
    v AS (SELECT k.*, CASE WHEN l.status IS NULL OR l.status = 'rejected' THEN 'revoked' WHEN l.status = 'needs_review' THEN 'needs_review' WHEN l.decision_id = applied THEN 'active' ELSE 'pending_reapplication' END AS validity
      FROM k LEFT JOIN l ON l.proposal_id = k.proposal_id AND l.r = 1),
    e AS (SELECT c_custkey AS entity_id, count(validity) AS n_links, coalesce(bool_and(validity = 'active'), false) AS safe,
      coalesce(string_agg(DISTINCT CASE WHEN validity <> 'active' THEN validity END, ',' ORDER BY CASE WHEN validity <> 'active' THEN validity END), '') AS blocking FROM customer LEFT JOIN v ON entity_id = c_custkey GROUP BY 1)"""


def _validity(t):
    from pyspark.sql import Window

    order = Window.partitionBy("proposal_id").orderBy("l_shipdate", "l_orderkey", "l_linenumber")
    flag = F.when(F.col("l_returnflag") == "R", "rejected").when((F.col("l_returnflag") == "A") | (F.col("l_linestatus") == "O"), "approved").otherwise("needs_review")
    decisions = t.lineitem.withColumn("proposal_id", F.col("l_orderkey") % 4000).select(
        "proposal_id", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("decision_id"), F.row_number().over(order).alias("revision"), flag.alias("status")
    )
    newest = L.latest(decisions, "proposal_id", "revision", "decision_id").select("proposal_id", F.col("decision_id").alias("newest"))
    links = t.orders.select(F.col("o_custkey").alias("entity_id"), F.col("o_orderkey").alias("link_id"), (F.col("o_orderkey") % 4000).alias("proposal_id"))
    links = links.join(newest, "proposal_id", "left").withColumn("applied", F.when(F.col("link_id") % 3 == 0, F.lit(-1).cast("long")).otherwise(F.col("newest")))
    return R.link_validity(links, decisions, "applied")


def _safety(t):
    return R.entity_safety(t.customer.select(F.col("c_custkey").alias("entity_id")), _validity(t))


@query(f"WITH {_DECISIONS} SELECT validity, count(*) AS n, count(DISTINCT entity_id) AS entities FROM v GROUP BY 1")
def registry_validity(t):
    return _validity(t).groupBy("validity").agg(F.count("*").alias("n"), F.count_distinct("entity_id").alias("entities"))


@query(f"WITH {_DECISIONS} SELECT * FROM e")
def entity_safety(t):
    return _safety(t)


_NOT = """n0 AS (SELECT o_custkey AS seed_id, o_orderkey AS decision_id, row_number() OVER w + CASE WHEN o_orderkey % 97 = 0 THEN 1 ELSE 0 END AS revision,
      CASE o_orderstatus WHEN 'P' THEN 'not_entity' WHEN 'F' THEN 'revoked' ELSE 'assigned' END AS status, CASE WHEN o_orderkey % 89 = 0 THEN 'exact' ELSE 'single' END AS scope,
      CASE WHEN o_orderstatus = 'O' OR o_orderkey % 61 = 0 THEN o_custkey END AS entity_id, CASE WHEN o_orderkey % 53 = 0 THEN ' ' ELSE o_orderpriority END AS reason
      FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
    n1 AS (SELECT *, lag(status) OVER w AS previous, first_value(scope) OVER w AS first_scope, row_number() OVER w AS n, row_number() OVER (PARTITION BY seed_id ORDER BY revision DESC, decision_id DESC) AS r FROM n0
      WINDOW w AS (PARTITION BY seed_id ORDER BY revision, decision_id)),
    n2 AS (SELECT seed_id, decision_id, status, CASE WHEN revision <> n THEN 'revision_gap' WHEN scope <> first_scope THEN 'scope_changed' WHEN status = 'not_entity' AND entity_id IS NOT NULL THEN 'entity_on_not_entity'
      WHEN trim(reason) = '' THEN 'blank_reason' END AS issue FROM n1 WHERE r = 1 AND (status = 'not_entity' OR status = 'revoked' AND previous = 'not_entity')),
    ne AS (SELECT seed_id, decision_id, status, CASE WHEN issue IS NOT NULL THEN 'invalid' WHEN status = 'revoked' THEN 'revoked' ELSE 'active' END AS validity, issue FROM n2)"""


def _not_entities(t):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    k = F.col("o_orderkey")
    rows = t.orders.select(
        F.col("o_custkey").alias("seed_id"), k.alias("decision_id"), (F.row_number().over(w) + F.when(k % 97 == 0, 1).otherwise(0)).alias("revision"),
        F.when(F.col("o_orderstatus") == "P", "not_entity").when(F.col("o_orderstatus") == "F", "revoked").otherwise("assigned").alias("status"),
        F.when(k % 89 == 0, "exact").otherwise("single").alias("scope"), F.when((F.col("o_orderstatus") == "O") | (k % 61 == 0), F.col("o_custkey")).alias("entity_id"),
        F.when(k % 53 == 0, " ").otherwise(F.col("o_orderpriority")).alias("reason"),
    )
    return R.not_entity_validity(rows)


@query(f"WITH {_NOT} SELECT * FROM ne")
def not_entity_validity(t):
    return _not_entities(t)


# Coverage: a customer is a candidate; its nation is the document; it is assigned to its own entity unless its key is a multiple of 6.
_COVER = f"""{_DECISIONS}, {_NOT}, c AS (SELECT c_custkey AS candidate_id, CAST(c_nationkey AS BIGINT) AS document_id, CASE WHEN c_custkey % 6 <> 0 THEN c_custkey END AS entity_id, lower(c_mktsegment) AS entity_type,
      split_part(c_name, '#', 1) || (c_custkey % 40) AS canonical, c_name AS surface FROM customer),
    cv AS (SELECT c.*, CASE WHEN ne.validity = 'invalid' OR ne.validity = 'active' AND c.entity_id IS NOT NULL THEN 'invalid' WHEN ne.validity = 'active' THEN 'not_entity' WHEN c.entity_id IS NULL THEN 'unassigned'
      WHEN coalesce(e.safe, false) THEN 'safe' ELSE 'blocked' END AS status FROM c LEFT JOIN ne ON ne.seed_id = c.candidate_id LEFT JOIN e ON e.entity_id = c.entity_id),
    rd AS (SELECT document_id, candidates, {", ".join(f'"{s}"' for s in R.COVERAGE)}, CASE WHEN invalid > 0 THEN 'invalid' WHEN blocked > 0 THEN 'blocked' WHEN unassigned > 0 THEN 'incomplete' WHEN candidates = 0 THEN 'no_candidates' ELSE 'ready' END AS readiness
      FROM (SELECT n_nationkey::BIGINT AS document_id, count(status) AS candidates, {", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in R.COVERAGE)} FROM (SELECT n_nationkey FROM nation UNION ALL SELECT 99) x LEFT JOIN cv ON document_id = n_nationkey GROUP BY 1))"""


def _covered(t):
    k = F.col("c_custkey")
    candidates = t.customer.select(
        k.alias("candidate_id"), F.col("c_nationkey").cast("long").alias("document_id"), F.when(k % 6 != 0, k).alias("entity_id"), F.lower("c_mktsegment").alias("entity_type"),
        F.concat(F.substring_index("c_name", "#", 1), (k % 40).cast("string")).alias("canonical"), F.col("c_name").alias("surface"),
    )
    return R.coverage(candidates, _safety(t), _not_entities(t))


def _ready(t):
    documents = t.nation.select(F.col("n_nationkey").cast("long").alias("document_id")).union(t.spark.range(99, 100).toDF("document_id"))
    return R.readiness(documents, _covered(t))


@query(f"WITH {_COVER} SELECT document_id, status, count(*) AS n FROM cv GROUP BY 1, 2")
def coverage_status(t):
    return _covered(t).groupBy("document_id", "status").agg(F.count("*").alias("n"))


@query(f"WITH {_COVER} SELECT * FROM rd")
def readiness_status(t):
    return _ready(t)


@query(
    f"WITH {_COVER} SELECT count(*) AS documents, CAST(sum(candidates) AS BIGINT) AS candidates, "
    + ", ".join(f"count(*) FILTER (WHERE readiness = '{s}') AS docs_{s}" for s in R.READINESS)
    + " FROM rd"
)
def corpus_readiness(t):
    counts = [F.count_if(F.col("readiness") == s).alias(f"docs_{s}") for s in R.READINESS]
    return _ready(t).agg(F.count("*").alias("documents"), F.sum("candidates").alias("candidates"), *counts)


@query(f"WITH {_COVER} SELECT document_id, readiness FROM rd WHERE readiness IN ('ready', 'no_candidates') ORDER BY document_id LIMIT 10")
def ready_selection(t):
    return _ready(t).where("readiness in ('ready', 'no_candidates')").select("document_id", "readiness").orderBy("document_id").limit(10)


@query(
    f"""WITH {_COVER}, g AS (SELECT *, row_number() OVER (PARTITION BY entity_type, canonical ORDER BY candidate_id) AS rk FROM cv)
    SELECT entity_type, canonical, min(candidate_id) AS seed, count(*) AS n, count(DISTINCT document_id) AS documents, count(*) FILTER (WHERE status = 'unassigned') AS unassigned,
      count(*) FILTER (WHERE status = 'invalid') AS invalid, count(*) FILTER (WHERE status = 'not_entity') AS not_entity, string_agg(DISTINCT surface, '|' ORDER BY surface) AS variants,
      string_agg(CASE WHEN rk <= 3 THEN CAST(document_id AS VARCHAR) END, ',' ORDER BY rk) AS first_documents,
      CASE WHEN count(*) FILTER (WHERE status = 'invalid') > 0 THEN 'conflict' WHEN count(*) FILTER (WHERE status = 'not_entity') > 0 THEN 'partly_excluded'
        WHEN count(*) FILTER (WHERE status = 'unassigned') < count(*) THEN 'partly_assigned' ELSE 'open' END AS scope_state
    FROM g GROUP BY 1, 2 HAVING count(*) FILTER (WHERE status = 'unassigned') > 0"""
)
def resolution_queue_groups(t):
    return R.queue_groups(_covered(t))


@query(f"WITH {_COVER} SELECT document_id, candidates, unassigned FROM rd WHERE unassigned > 0 ORDER BY (blocked + invalid) > 0, blocked + invalid, unassigned, candidates, document_id LIMIT 1")
def resolution_document_pick(t):
    return R.next_document(_ready(t)).select("document_id", "candidates", "unassigned")


@query(
    f"""WITH {_COVER} SELECT cv.entity_id, count(*) AS candidates, string_agg(CAST(candidate_id AS VARCHAR) || ':' || surface, ';' ORDER BY candidate_id) AS members
    FROM cv JOIN e ON e.entity_id = cv.entity_id AND e.safe WHERE status = 'safe' GROUP BY 1"""
)
def safe_entity_projection(t):
    safe = _safety(t).where("safe").select("entity_id")
    held = _covered(t).where("status = 'safe'").join(safe, "entity_id", "left_semi")
    member = F.concat_ws(":", F.col("candidate_id").cast("string"), "surface")
    by = held.groupBy("entity_id").agg(F.count("*").alias("candidates"), F.sort_array(F.collect_list(F.struct("candidate_id", member.alias("m")))).alias("s"))
    return by.select("entity_id", "candidates", F.array_join(F.transform("s", lambda x: x["m"]), ";").alias("members"))


@query("SELECT event_type, user_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS times_seen FROM events GROUP BY 1, 2")
def rediscovery_upsert(t):
    return L.rediscovered(t.events, "event_type", "user_id", at="ts")


@query(
    """WITH s AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'done' WHEN 'click' THEN 'running' ELSE 'pending' END AS status FROM events)
    SELECT user_id, max(CASE WHEN r = 1 THEN status END) AS status, count(*) FILTER (WHERE status = 'running') AS attempts, count(*) FILTER (WHERE status = 'failed') AS failures
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM s) GROUP BY 1"""
)
def run_attempt_ledger(t):
    kind = F.col("event_type")
    status = F.when(kind == "error", "failed").when(kind == "purchase", "done").when(kind == "click", "running").otherwise("pending")
    return L.machine(t.events.select("user_id", "event_id", "ts", status.alias("status")), "user_id", "status", "ts", "event_id")


@query(
    """WITH w AS (SELECT *, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS p, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS pr FROM conversations)
    SELECT conv_id, count(*) AS turns, count(*) FILTER (WHERE turn <> p + 1) AS gaps, count(*) FILTER (WHERE role = pr) AS repeated_roles, min(turn) AS first_turn FROM w GROUP BY 1"""
)
def conversation_turn_stats(t):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = t.conversations.withColumn("p", F.lag("turn").over(w)).withColumn("pr", F.lag("role").over(w))
    return rows.groupBy("conv_id").agg(
        F.count("*").alias("turns"), F.count_if(F.col("turn") != F.col("p") + 1).alias("gaps"), F.count_if(F.col("role") == F.col("pr")).alias("repeated_roles"), F.min("turn").alias("first_turn")
    )


@query("SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM labels UNION ALL SELECT doc_id FROM documents WHERE doc_id % 50 = 0 UNION ALL SELECT doc_id FROM documents WHERE doc_id % 100 = 0) GROUP BY 1 HAVING count(*) > 1")
def identity_violations(t):
    """Labels, to which some are added that may be there already."""
    more = t.documents.select("doc_id")
    return L.violations(t.labels.select("doc_id").union(more.where("doc_id % 50 = 0")).union(more.where("doc_id % 100 = 0")), "doc_id")


_RUNS = """k AS (SELECT user_id AS run_id, event_id, ts, CASE event_type WHEN 'click' THEN 'claimed' WHEN 'view' THEN 'claimed' WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'prepared' END AS kind FROM events),
    w AS (SELECT *, lag(kind) OVER (PARTITION BY run_id ORDER BY ts, event_id) AS before FROM k), v AS (SELECT * FROM w WHERE NOT (kind = 'claimed' AND coalesce(before, '') = 'claimed')),
    r AS (SELECT run_id, arg_max(kind, (ts, event_id)) AS last, count(*) FILTER (WHERE kind = 'claimed') AS attempt_count, max(ts) FILTER (WHERE kind = 'claimed') AS claimed_at FROM v GROUP BY 1),
    s AS (SELECT run_id, CASE last WHEN 'claimed' THEN 'running' ELSE last END AS status, attempt_count, claimed_at FROM r)"""


def _runs(t):
    kind = F.col("event_type")
    told = F.when(kind.isin("click", "view"), "claimed").when(kind == "purchase", "succeeded").when(kind == "error", "failed").otherwise("prepared")
    return U.claims(t.events.select(F.col("user_id").alias("run_id"), "event_id", F.col("ts").alias("at"), told.alias("kind")))


@query(f"WITH {_RUNS} SELECT run_id, status, attempt_count FROM s")
def run_claims(t):
    return _runs(t).select("run_id", "status", "attempt_count")


@query(f"WITH {_RUNS} SELECT run_id, attempt_count FROM s WHERE status = 'running' AND claimed_at < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 90 MINUTE")
def stale_runs(t):
    return U.stale(_runs(t), "2024-01-31 00:00:00", 90).select("run_id", "attempt_count")

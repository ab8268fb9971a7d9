"""Queries over event fragments. Lines of a document's first text play fragments, their words observations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import documents as D
from quillon.operators import fragments as G

from ._registry import query


@query(
    """WITH g AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS at_ms FROM events), w AS (SELECT *, at_ms - lag(at_ms) OVER (PARTITION BY user_id ORDER BY at_ms) AS gap FROM g)
    SELECT user_id, at_ms, gap, CAST(coalesce(sum(CASE WHEN gap >= 43200000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY at_ms ROWS UNBOUNDED PRECEDING), 0) AS BIGINT) AS session FROM w"""
)
def cue_gap_sessions(t):
    rows = t.events.select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))
    return G.gap_sessions(rows.withColumn("end_ms", F.col("at_ms")), "user_id", "at_ms", "end_ms", 12 * 3600 * 1000).drop("end_ms")


_LINES = """l0 AS (SELECT doc_id, i, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents) WHERE trim(line, ' ') <> ''),
    l AS (SELECT doc_id AS group_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS b, trim(line, ' ') AS block FROM l0),
    f AS (SELECT group_id, b AS fragment_id, block FROM l),
    ow AS (SELECT group_id, fragment_id, unnest(w) AS surface, unnest(range(len(w))) AS j FROM (SELECT *, regexp_extract_all(block, '[A-Za-z]+') AS w FROM f)),
    o AS (SELECT group_id, fragment_id, j AS observation_id, surface, lower(surface) AS normalized, CASE WHEN regexp_matches(surface, '^[A-Z]') THEN 'participant_mention'
      WHEN length(surface) <= 3 THEN 'action_candidate' WHEN length(surface) % 2 = 0 THEN 'object_candidate' ELSE 'place_mention' END AS observation_type,
      CASE length(surface) % 3 WHEN 0 THEN 'NOUN:obj' WHEN 1 THEN 'PRON:obj' ELSE 'ADJ:obj' END AS source_label FROM ow),
    x AS (SELECT *, CASE WHEN observation_type = 'action_candidate' AND normalized IN ("""
_LINES += ", ".join(f"'{w}'" for w in G.GENERIC_ACTIONS["en"])
_LINES += """) THEN 'generic_action' WHEN observation_type = 'object_candidate' AND source_label LIKE 'PRON%' THEN 'pronominal_object'
      WHEN observation_type = 'object_candidate' AND NOT (source_label LIKE 'NOUN%') THEN 'unsupported_object_head' WHEN observation_type = 'object_candidate' AND length(surface) > 50 THEN 'oversized_object' END AS exclusion FROM o),
    sg AS (SELECT group_id, fragment_id, observation_type, normalized, count(*) AS n, min(observation_id) AS first_start FROM x WHERE exclusion IS NULL GROUP BY 1, 2, 3, 4)"""


def _fragments(t):
    """Every non-blank line of every document; its index is its id, which is unique within the group."""
    return D.blocks(t.documents).select(F.col("doc_id").alias("group_id"), F.col("block_index").cast("long").alias("fragment_id"), "block")


def _observations(t):
    words = _fragments(t).select("group_id", "fragment_id", F.posexplode(F.regexp_extract_all("block", F.lit("[A-Za-z]+"), F.lit(0))).alias("j", "surface"))
    n = F.length("surface")
    kind = F.when(F.col("surface").rlike("^[A-Z]"), "participant_mention").when(n <= 3, "action_candidate").when(n % 2 == 0, "object_candidate").otherwise("place_mention")
    label = F.when(n % 3 == 0, "NOUN:obj").when(n % 3 == 1, "PRON:obj").otherwise("ADJ:obj")
    return words.select(
        "group_id", "fragment_id", F.col("j").cast("long").alias("observation_id"), kind.alias("observation_type"), label.alias("source_label"), "surface",
        F.lower("surface").alias("normalized"), F.col("j").cast("long").alias("start"), (F.col("j") + 1).cast("long").alias("end"),
    )


def _pairs(t):
    return G.pairs(_fragments(t), G.profiles(_observations(t)))


@query(f"WITH {_LINES} SELECT exclusion, observation_type, count(*) AS n FROM x GROUP BY 1, 2")
def fragment_exclusions(t):
    return G.exclusions(_observations(t)).groupBy("exclusion", "observation_type").agg(F.count("*").alias("n"))


@query(f"WITH {_LINES} SELECT * FROM sg")
def fragment_profiles(t):
    return G.profiles(_observations(t)).select("group_id", "fragment_id", "observation_type", "normalized", "n", "first_start")


_POINT = "CASE a.observation_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in G.POINTS.items()) + " END"
_COMPARED = f"""{_LINES}, sh AS (SELECT a.group_id, a.fragment_id AS left_id, b.fragment_id AS right_id, a.observation_type AS k, {_POINT} AS pt FROM sg a JOIN sg b
      ON a.group_id = b.group_id AND a.observation_type = b.observation_type AND a.normalized = b.normalized AND a.fragment_id < b.fragment_id),
    sc AS (SELECT group_id, left_id, right_id, CAST(sum(pt) AS BIGINT) AS points, string_agg(DISTINCT k, ',' ORDER BY k) AS dimensions, count(DISTINCT k) AS nd, bool_or(k NOT IN ('action_candidate', 'object_candidate')) AS core FROM sh GROUP BY 1, 2, 3),
    pr AS (SELECT a.group_id, a.fragment_id AS left_id, b.fragment_id AS right_id, coalesce(points, 0) AS points, coalesce(dimensions, '') AS dimensions,
      CASE WHEN nd >= 2 AND core THEN 'candidate' WHEN nd >= 1 THEN 'weak' ELSE 'insufficient' END AS status FROM f a JOIN f b ON a.group_id = b.group_id AND a.fragment_id < b.fragment_id
      LEFT JOIN sc ON sc.group_id = a.group_id AND sc.left_id = a.fragment_id AND sc.right_id = b.fragment_id)"""


@query(f"WITH {_COMPARED} SELECT * FROM pr")
def fragment_pairs_status(t):
    return _pairs(t)


def _edges(t):
    return G.evidence(G.profiles(_observations(t))).where("status = 'candidate' and points >= 12")


@query(
    f"""WITH RECURSIVE {_COMPARED}, ed AS (SELECT group_id, left_id AS a, right_id AS b FROM pr WHERE status = 'candidate' AND points >= 12 UNION SELECT group_id, right_id, left_id FROM pr WHERE status = 'candidate' AND points >= 12),
    rc(group_id, fragment_id, label) AS (SELECT group_id, fragment_id, fragment_id FROM f UNION SELECT ed.group_id, ed.b, rc.label FROM rc JOIN ed ON ed.group_id = rc.group_id AND ed.a = rc.fragment_id)
    SELECT group_id, fragment_id, min(label) AS component FROM rc GROUP BY 1, 2"""
)
def fragment_components(t):
    return G.components(_fragments(t), _edges(t))


@query()
def fragment_cliques(t):
    return G.cliques(_edges(t))


@query()
def cluster_review_status(t):
    labels, proposals = G.components(_fragments(t), _edges(t)), G.cliques(_edges(t))
    statuses = G.component_status(labels, proposals)
    odd = F.col("component") % 3
    decisions = statuses.select(
        "group_id", "component", F.when(odd == 0, 1).otherwise(0).alias("accepted"), F.when(odd == 1, F.col("proposals")).otherwise(0).alias("rejected"), F.when(odd == 2, F.col("proposals")).otherwise(0).alias("pending")
    )
    return G.review(statuses, decisions)


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), n AS (SELECT doc_id AS group_id, count(*) AS n FROM l WHERE trim(line, ' ') <> '' GROUP BY 1) SELECT group_id, n, CASE WHEN n > 2 THEN n * (n - 1) // 2 - 1 END AS pairs FROM n WHERE group_id % 9 = 0 AND n > 1")
def incomplete_pair_groups(t):
    """The pairs of every document's lines, of which some documents lack the first."""
    have = _pairs(t).where("not (group_id % 9 = 0 and left_id = 1 and right_id = 2)")
    return G.incomplete_groups(_fragments(t), have)

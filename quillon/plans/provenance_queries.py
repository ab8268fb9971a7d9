"""Queries over provenance. Documents play versions with a text, a mention and a candidate artifact each; a remainder of the
id decides what is broken, so that every check meets some."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.operators import provenance as P

from ._registry import query

# Artifacts: 3 * id is the text, 3 * id + 1 the mentions, 3 * id + 2 the candidates. z = id % 29 decides what is broken.
_BASE = """d AS (SELECT doc_id, text, doc_id % 29 AS z, sha256(coalesce(text, '')) AS h FROM documents),
    art AS (
      SELECT 3 * doc_id AS artifact_id, CASE WHEN z = 13 THEN doc_id + 1 ELSE doc_id END AS version_id, CASE WHEN z = 12 THEN 'event_fragments' ELSE 'extracted_text' END AS artifact_type, h AS content_hash,
        CAST(NULL AS BIGINT) AS input_artifact_id, CAST(NULL AS VARCHAR) AS input_content_hash, CASE WHEN z = 15 THEN ' ' ELSE text END AS text FROM d WHERE z <> 11
      UNION ALL SELECT 3 * doc_id + 1, CASE WHEN z = 7 THEN doc_id + 1 ELSE doc_id END, CASE WHEN z = 6 THEN 'entity_candidates' ELSE 'entity_mentions' END, 'm' || doc_id,
        CASE WHEN z = 10 THEN NULL ELSE 3 * doc_id END, CASE WHEN z = 14 THEN 'x' ELSE h END, NULL FROM d WHERE z <> 5
      UNION ALL SELECT 3 * doc_id + 2, CASE WHEN z = 4 THEN doc_id + 1 ELSE doc_id END, CASE WHEN z = 3 THEN 'entity_mentions' ELSE 'entity_candidates' END, 'c' || doc_id,
        CASE WHEN z = 8 THEN 3 * doc_id ELSE 3 * doc_id + 1 END, CASE WHEN z = 9 THEN 'x' ELSE 'm' || doc_id END, NULL FROM d WHERE z <> 2),
    men AS (SELECT doc_id AS mention_id, CASE WHEN z = 1 THEN doc_id + 1 ELSE doc_id END AS version_id, 3 * doc_id + 1 AS artifact_id, CASE WHEN z = 18 THEN 'location' ELSE 'person' END AS entity_type,
        CASE WHEN z = 17 THEN 'other' ELSE substring(text, 1, 8) END AS surface, 0 AS "start", CASE WHEN z = 16 THEN length(text) + 1 ELSE length(substring(text, 1, 8)) END AS "end" FROM d WHERE z <> 0),
    can AS (SELECT doc_id AS candidate_id, doc_id AS version_id, doc_id AS mention_id, 3 * doc_id + 2 AS artifact_id, 'person' AS entity_type FROM d),
    ch AS (SELECT can.*, ta.artifact_id AS text_artifact_id, CASE WHEN m.mention_id IS NULL THEN 'mention_missing' WHEN m.version_id <> can.version_id THEN 'mention_of_another_version'
        WHEN m.entity_type <> can.entity_type THEN 'mention_type_differs' WHEN ca.artifact_id IS NULL THEN 'candidate_artifact_missing' WHEN ca.artifact_type <> 'entity_candidates' THEN 'candidate_artifact_type'
        WHEN ca.version_id <> can.version_id THEN 'candidate_artifact_of_another_version' WHEN ma.artifact_id IS NULL THEN 'mention_artifact_missing' WHEN ma.artifact_type <> 'entity_mentions' THEN 'mention_artifact_type'
        WHEN ma.version_id <> can.version_id THEN 'mention_artifact_of_another_version' WHEN ca.input_artifact_id IS DISTINCT FROM ma.artifact_id THEN 'candidate_artifact_has_another_input'
        WHEN ca.input_content_hash IS DISTINCT FROM ma.content_hash THEN 'candidate_artifact_input_hash_differs' WHEN ma.input_artifact_id IS NULL THEN 'text_input_not_named' WHEN ta.artifact_id IS NULL THEN 'text_input_missing'
        WHEN ta.artifact_type NOT IN ('extracted_text', 'ocr_text', 'transcript', 'translation') THEN 'text_input_type' WHEN ta.version_id <> can.version_id THEN 'text_input_of_another_version'
        WHEN ma.input_content_hash IS DISTINCT FROM ta.content_hash THEN 'mention_artifact_input_hash_differs' WHEN ta.text IS NULL OR NOT regexp_matches(ta.text, '\\S') THEN 'text_unusable'
        WHEN m."end" > length(ta.text) THEN 'span_beyond_text' WHEN substring(ta.text, 1, m."end") <> m.surface THEN 'span_differs' END AS issue
      FROM can LEFT JOIN men m USING (mention_id) LEFT JOIN art ca ON ca.artifact_id = can.artifact_id LEFT JOIN art ma ON ma.artifact_id = m.artifact_id LEFT JOIN art ta ON ta.artifact_id = ma.input_artifact_id)"""


def _artifacts(t):
    d = t.documents.select("doc_id", "text", (F.col("doc_id") % 29).alias("z"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    z, i, none = F.col("z"), F.col("doc_id"), F.lit(None)
    moved = lambda k: F.when(z == k, i + 1).otherwise(i).alias("version_id")
    text = d.where("z <> 11").select(
        (3 * i).alias("artifact_id"), moved(13), F.when(z == 12, "event_fragments").otherwise("extracted_text").alias("artifact_type"), F.col("h").alias("content_hash"), none.cast("long").alias("input_artifact_id"),
        none.cast("string").alias("input_content_hash"), F.when(z == 15, " ").otherwise(F.col("text")).alias("text"),
    )
    mention = d.where("z <> 5").select(
        (3 * i + 1).alias("artifact_id"), moved(7), F.when(z == 6, "entity_candidates").otherwise("entity_mentions").alias("artifact_type"), F.concat(F.lit("m"), i.cast("string")).alias("content_hash"),
        F.when(z != 10, 3 * i).alias("input_artifact_id"), F.when(z == 14, "x").otherwise(F.col("h")).alias("input_content_hash"), none.cast("string").alias("text"),
    )
    candidate = d.where("z <> 2").select(
        (3 * i + 2).alias("artifact_id"), moved(4), F.when(z == 3, "entity_mentions").otherwise("entity_candidates").alias("artifact_type"), F.concat(F.lit("c"), i.cast("string")).alias("content_hash"),
        F.when(z == 8, 3 * i).otherwise(3 * i + 1).alias("input_artifact_id"), F.when(z == 9, "x").otherwise(F.concat(F.lit("m"), i.cast("string"))).alias("input_content_hash"), none.cast("string").alias("text"),
    )
    return text.unionByName(mention).unionByName(candidate)


def _mentions(t):
    d = t.documents.select("doc_id", "text", (F.col("doc_id") % 29).alias("z")).where("z <> 0")
    z, i, head = F.col("z"), F.col("doc_id"), F.substring("text", 1, 8)
    return d.select(
        i.alias("mention_id"), F.when(z == 1, i + 1).otherwise(i).alias("version_id"), (3 * i + 1).alias("artifact_id"), F.when(z == 18, "location").otherwise("person").alias("entity_type"),
        F.when(z == 17, "other").otherwise(head).alias("surface"), F.lit(0).alias("start"), F.when(z == 16, F.length("text") + 1).otherwise(F.length(head)).alias("end"),
    )


def _candidates(t):
    i = F.col("doc_id")
    return t.documents.select(i.alias("candidate_id"), i.alias("version_id"), i.alias("mention_id"), (3 * i + 2).alias("artifact_id"), F.lit("person").alias("entity_type"))


def _chains(t):
    return P.candidate_issues(_candidates(t), _mentions(t), _artifacts(t))


@query(f"WITH {_BASE} SELECT candidate_id, text_artifact_id, issue FROM ch")
def candidate_provenance_issues(t):
    return _chains(t).select("candidate_id", "text_artifact_id", "issue")


@query(
    f"WITH {_BASE} SELECT m.mention_id, a.artifact_type, d.doc_id AS version_id, d.source, m.surface FROM men m JOIN art a ON a.artifact_id = m.artifact_id JOIN (SELECT doc_id, source FROM documents) d ON d.doc_id = m.version_id AND a.version_id = d.doc_id"
)
def mention_provenance_join(t):
    a = _artifacts(t).select("artifact_id", "artifact_type", F.col("version_id").alias("a_version"))
    d = t.documents.select(F.col("doc_id").alias("version_id"), "source")
    return _mentions(t).join(a, "artifact_id").join(d, "version_id").where("a_version = version_id").select("mention_id", "artifact_type", "version_id", "source", "surface")


@query(
    f"""WITH {_BASE} SELECT c.candidate_id, m.surface, a.content_hash, d.source, d.lang FROM can c JOIN men m USING (mention_id) JOIN art a ON a.artifact_id = c.artifact_id
      JOIN (SELECT doc_id, source, lang FROM documents) d ON d.doc_id = c.version_id AND d.doc_id = m.version_id"""
)
def candidate_provenance_join(t):
    a = _artifacts(t).select("artifact_id", "content_hash")
    m = _mentions(t).select("mention_id", "surface", F.col("version_id").alias("m_version"))
    d = t.documents.select(F.col("doc_id").alias("version_id"), "source", "lang")
    return _candidates(t).join(m, "mention_id").join(a, "artifact_id").join(d, "version_id").where("m_version = version_id").select("candidate_id", "surface", "content_hash", "source", "lang")


@query(
    f"""WITH {_BASE}, s AS (SELECT ch.*, source FROM ch JOIN documents ON doc_id = candidate_id), g AS (SELECT source AS document_id, count(*) AS candidates, count(DISTINCT text_artifact_id) AS texts, min(text_artifact_id) AS t,
      count(issue) AS broken FROM s GROUP BY 1) SELECT document_id, candidates, texts, CASE WHEN broken = 0 AND texts <= 1 THEN t END AS text_artifact_id, CASE WHEN broken > 0 THEN 'broken_provenance' WHEN texts > 1 THEN 'several_texts' END AS issue FROM g
      UNION ALL SELECT CAST(candidate_id AS VARCHAR), 1, CASE WHEN text_artifact_id IS NULL THEN 0 ELSE 1 END, CASE WHEN issue IS NULL THEN text_artifact_id END, CASE WHEN issue IS NOT NULL THEN 'broken_provenance' END FROM ch"""
)
def analysis_input_texts(t):
    """Sources and single documents as inputs: a source's candidates rest on many texts, a document's on one."""
    chains = _chains(t)
    by_source = chains.join(t.documents.select(F.col("doc_id").alias("candidate_id"), F.col("source").alias("document_id")), "candidate_id")
    return P.same_text(by_source).unionByName(P.same_text(chains.withColumn("document_id", F.col("candidate_id").cast("string"))))


@query(f"WITH {_BASE} SELECT artifact_type, count(*) AS n FROM art WHERE artifact_type IN ('extracted_text', 'ocr_text', 'transcript', 'translation') GROUP BY 1")
def text_artifact_types(t):
    return P.text_artifacts(_artifacts(t)).groupBy("artifact_type").agg(F.count("*").alias("n"))


@query(
    f"""WITH {_BASE}, x AS (SELECT version_id, artifact_id FROM art WHERE artifact_type = 'extracted_text'), g AS (SELECT version_id, count(*) AS n, min(artifact_id) AS a, array_to_string(list_sort(list(DISTINCT artifact_id)), ',') AS ids FROM x GROUP BY 1)
    SELECT version_id, CASE WHEN n = 1 THEN a END AS artifact_id, CASE WHEN n IS NULL THEN 'none' WHEN n > 1 THEN 'several:' || ids END AS issue FROM (SELECT DISTINCT version_id FROM art) LEFT JOIN g USING (version_id)"""
)
def only_text_artifacts(t):
    return P.only_text_artifact(_artifacts(t))


@query(
    f"WITH {_BASE}, p AS (SELECT artifact_id, version_id FROM art WHERE artifact_type = 'extracted_text' AND NOT EXISTS (SELECT 1 FROM art o WHERE o.artifact_type = 'entity_mentions' AND o.input_artifact_id = art.artifact_id)) SELECT artifact_id, version_id, source FROM p JOIN documents ON doc_id = version_id"
)
def pending_text_artifacts(t):
    art = _artifacts(t)
    done = art.where("artifact_type = 'entity_mentions'").select(F.col("input_artifact_id").alias("artifact_id"))
    left = P.text_artifacts(art, "extracted_text").select("artifact_id", "version_id").join(done, "artifact_id", "left_anti")
    return left.join(t.documents.select(F.col("doc_id").alias("version_id"), "source"), "version_id").select("artifact_id", "version_id", "source")


_TRANSCRIPTS = """c AS (SELECT DISTINCT conv_id, conv_id % 11 AS z FROM conversations),
    tr AS (SELECT conv_id AS artifact_id, conv_id AS version_id, CASE WHEN z = 1 THEN -1 WHEN z = 2 THEN conv_id + 1000000000 ELSE conv_id + 1 END AS acquisition_id, conv_id + 1 AS raw_id, 'sha256' AS hash_algorithm,
      CASE WHEN z = 5 THEN 'x' ELSE 'r' || conv_id END AS content_hash, CASE WHEN z = 6 THEN 'de' ELSE 'en' END AS language, CASE WHEN z = 7 THEN 'auto' ELSE 'publisher' END AS kind, 'webvtt' AS format, z <> 0 AS has_source FROM c),
    ac AS (SELECT conv_id + 1 AS acquisition_id, CASE WHEN z = 3 THEN conv_id + 1 ELSE conv_id END AS version_id, CASE WHEN z = 4 THEN conv_id + 2 ELSE conv_id + 1 END AS raw_id, 'en' AS language, 'publisher' AS kind, 'webvtt' AS format FROM c),
    rw AS (SELECT conv_id + 1 AS raw_id, 'sha256' AS hash_algorithm, 'r' || conv_id AS content_hash FROM c)"""


@query(
    f"""WITH {_TRANSCRIPTS} SELECT tr.artifact_id, CASE WHEN NOT has_source THEN 'no_source' WHEN tr.acquisition_id < 1 OR tr.raw_id < 1 THEN 'bad_identifiers' WHEN ac.acquisition_id IS NULL OR rw.raw_id IS NULL THEN 'records_missing'
      WHEN tr.version_id <> ac.version_id THEN 'acquisition_of_another_version' WHEN ac.raw_id <> rw.raw_id THEN 'acquisition_of_another_raw' WHEN tr.content_hash <> rw.content_hash OR tr.hash_algorithm <> rw.hash_algorithm THEN 'digest_differs'
      WHEN tr.language <> ac.language THEN 'language_differs' WHEN tr.kind <> ac.kind OR tr.format <> ac.format THEN 'kind_or_format_differs' END AS issue
    FROM tr LEFT JOIN ac ON ac.acquisition_id = tr.acquisition_id LEFT JOIN rw ON rw.raw_id = tr.raw_id"""
)
def transcript_provenance_issues(t):
    c = t.conversations.select("conv_id", (F.col("conv_id") % 11).alias("z")).distinct()
    z, i, name = F.col("z"), F.col("conv_id"), F.concat(F.lit("r"), F.col("conv_id").cast("string"))
    tr = c.select(
        i.alias("artifact_id"), i.alias("version_id"), F.when(z == 1, -1).when(z == 2, i + 1000000000).otherwise(i + 1).alias("acquisition_id"), (i + 1).alias("raw_id"), F.lit("sha256").alias("hash_algorithm"),
        F.when(z == 5, "x").otherwise(name).alias("content_hash"), F.when(z == 6, "de").otherwise("en").alias("language"), F.when(z == 7, "auto").otherwise("publisher").alias("kind"), F.lit("webvtt").alias("format"), (z != 0).alias("has_source"),
    )
    ac = c.select((i + 1).alias("acquisition_id"), F.when(z == 3, i + 1).otherwise(i).alias("version_id"), F.when(z == 4, i + 2).otherwise(i + 1).alias("raw_id"), F.lit("en").alias("language"), F.lit("publisher").alias("kind"), F.lit("webvtt").alias("format"))
    rw = c.select((i + 1).alias("raw_id"), F.lit("sha256").alias("hash_algorithm"), name.alias("content_hash"))
    return P.transcript_issues(tr, ac, rw)


@query(
    """WITH al AS (SELECT o_custkey AS entity_id, ['active', 'active', 'active', 'revoked', 'needs_review'][CASE WHEN o_orderkey % 11 < 9 THEN 1 ELSE o_orderkey % 5 + 1 END] AS validity FROM orders),
    cl AS (SELECT c_custkey AS entity_id, CASE c_custkey % 7 WHEN 0 THEN 'pending_reapplication' WHEN 1 THEN 'missing_provenance' ELSE 'active' END AS validity FROM customer),
    u AS (SELECT * FROM al UNION ALL SELECT * FROM cl)
    SELECT entity_id, count(*) AS links, bool_and(validity = 'active') AS safe, concat_ws(',', CASE WHEN bool_or(validity = 'pending_reapplication') THEN 'pending_reapplication' END, CASE WHEN bool_or(validity = 'needs_review') THEN 'needs_review' END,
      CASE WHEN bool_or(validity = 'revoked') THEN 'revoked' END, CASE WHEN bool_or(validity = 'missing_provenance') THEN 'missing_provenance' END) AS blocking FROM u GROUP BY 1"""
)
def entity_blocking_validities(t):
    k = F.col("o_orderkey")
    kinds = F.array(*[F.lit(x) for x in ("active", "active", "active", "revoked", "needs_review")])
    alias = t.orders.select(F.col("o_custkey").alias("entity_id"), F.get(kinds, F.when(k % 11 < 9, 0).otherwise(k % 5).cast("int")).alias("validity"))
    c = F.col("c_custkey")
    own = t.customer.select(c.alias("entity_id"), F.when(c % 7 == 0, "pending_reapplication").when(c % 7 == 1, "missing_provenance").otherwise("active").alias("validity"))
    return P.entity_blocking(alias, own)


@query(
    """WITH c AS (SELECT c_custkey AS candidate_id, CASE WHEN c_custkey % 3 = 0 THEN 'org' ELSE 'person' END AS entity_type, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 500 END AS entity_id, CASE WHEN c_custkey % 23 = 0 THEN 'broken' END AS chain_issue, c_custkey % 37 = 0 AS excluded FROM customer),
    e AS (SELECT DISTINCT c_custkey % 500 AS entity_id, CASE WHEN c_custkey % 500 % 3 = 0 THEN 'org' ELSE 'person' END AS entity_type FROM customer WHERE c_custkey % 500 % 19 <> 0),
    b AS (SELECT entity_id, entity_id % 5 <> 0 AS safe FROM e WHERE entity_id % 17 <> 0), x AS (SELECT c_custkey AS candidate_id, CASE WHEN c_custkey % 2 = 0 THEN 'active' ELSE 'invalid' END AS validity FROM customer WHERE c_custkey % 13 = 0),
    j AS (SELECT c.*, CASE WHEN excluded AND x.validity IS NULL THEN 'excluded_without_decision' WHEN x.validity = 'invalid' THEN 'invalid_decision' WHEN x.validity IS NOT NULL AND c.entity_id IS NOT NULL THEN 'excluded_and_assigned'
        WHEN c.entity_id IS NOT NULL AND e.entity_id IS NULL THEN 'missing_entity' WHEN e.entity_type <> c.entity_type THEN 'entity_type_differs' WHEN chain_issue IS NOT NULL THEN 'provenance'
        WHEN x.validity IS NULL AND c.entity_id IS NOT NULL AND safe IS NULL THEN 'unknown_entity' END AS issue, x.validity AS xv, safe
      FROM c LEFT JOIN e ON e.entity_id = c.entity_id LEFT JOIN b ON b.entity_id = c.entity_id LEFT JOIN x USING (candidate_id))
    SELECT candidate_id, CASE WHEN issue IS NOT NULL THEN 'invalid_provenance' WHEN xv IS NOT NULL THEN 'not_entity' WHEN entity_id IS NULL THEN 'unassigned' WHEN safe THEN 'safe_resolved' ELSE 'blocked' END AS status, issue FROM j"""
)
def coverage_with_issues(t):
    k = F.col("c_custkey")
    kind = lambda x: F.when(x % 3 == 0, "org").otherwise("person")
    c = t.customer.select(k.alias("candidate_id"), kind(k).alias("entity_type"), F.when(k % 4 != 0, k % 500).alias("entity_id"), F.when(k % 23 == 0, "broken").alias("chain_issue"), (k % 37 == 0).alias("excluded"))
    e = t.customer.select((k % 500).alias("entity_id")).distinct().where("entity_id % 19 <> 0").withColumn("entity_type", kind(F.col("entity_id")))
    b = e.where("entity_id % 17 <> 0").select("entity_id", (F.col("entity_id") % 5 != 0).alias("safe"))
    x = t.customer.where("c_custkey % 13 = 0").select(k.alias("candidate_id"), F.when(k % 2 == 0, "active").otherwise("invalid").alias("validity"))
    return P.covered(c, e, b, x)


@query(
    """WITH p AS (SELECT doc_id AS group_id, i AS position, CASE WHEN i % 7 = 3 THEN i - 2 ELSE i END AS "start", i + 1 AS "end", CASE WHEN i % 11 = 5 THEN i - 1 ELSE i END AS origin FROM (SELECT doc_id, unnest(range(1, 1 + len(string_split(text, chr(10))))) AS i FROM documents)),
    w AS (SELECT *, lag("start") OVER (PARTITION BY group_id ORDER BY position) AS s, lag("end") OVER (PARTITION BY group_id ORDER BY position) AS e, count(*) OVER (PARTITION BY group_id, origin) AS n FROM p)
    SELECT group_id, position, CASE WHEN "start" < s OR ("start" = s AND "end" < e) THEN 'out_of_order' ELSE 'duplicate_origin' END AS issue FROM w WHERE "start" < s OR ("start" = s AND "end" < e) OR n > 1"""
)
def source_order_violations(t):
    i = F.col("position")
    rows = t.documents.select(F.col("doc_id").alias("group_id"), F.explode(F.sequence(F.lit(1).cast("long"), F.size(F.split("text", "\n")).cast("long"))).alias("position"))
    return P.order_violations(rows.select("group_id", "position", F.when(i % 7 == 3, i - 2).otherwise(i).alias("start"), (i + 1).alias("end"), F.when(i % 11 == 5, i - 1).otherwise(i).alias("origin")))


@query(
    """WITH f AS (SELECT user_id AS version_id, event_type AS method, CAST(event_id % 2 AS VARCHAR) AS method_version FROM events WHERE event_type <> 'error' OR user_id % 4 = 0 UNION ALL SELECT c_custkey + 1000000, 'lines', '1' FROM customer),
    g AS (SELECT version_id, count(*) AS n, min(method) AS m, min(method_version) AS v FROM (SELECT DISTINCT * FROM f) GROUP BY 1)
    SELECT version_id, CASE WHEN n = 1 THEN m END AS method, CASE WHEN n = 1 THEN v END AS method_version, CASE WHEN n > 1 THEN 'several_methods' END AS issue FROM g"""
)
def only_fragment_method(t):
    some = t.events.where("event_type <> 'error' or user_id % 4 = 0").select(F.col("user_id").alias("version_id"), F.col("event_type").alias("method"), (F.col("event_id") % 2).cast("string").alias("method_version"))
    return P.only_method(some.union(t.customer.select((F.col("c_custkey") + 1000000).alias("version_id"), F.lit("lines"), F.lit("1"))))


@query(
    """WITH a AS (SELECT l_orderkey % 100 AS k, l_linenumber AS n FROM lineitem WHERE l_orderkey % 1000 <> 7), b AS (SELECT l_orderkey % 100 AS k, l_linenumber AS n FROM lineitem),
    x AS (SELECT k, n, count(*) AS in_a FROM a GROUP BY 1, 2), y AS (SELECT k, n, count(*) AS in_b FROM b GROUP BY 1, 2)
    SELECT k, n, coalesce(in_a, 0) AS in_a, coalesce(in_b, 0) AS in_b FROM x FULL JOIN y USING (k, n) WHERE coalesce(in_a, 0) <> coalesce(in_b, 0)"""
)
def multiset_accounting(t):
    rows = lambda df: df.select((F.col("l_orderkey") % 100).alias("k"), F.col("l_linenumber").alias("n"))
    return P.multiset_difference(rows(t.lineitem.where("l_orderkey % 1000 <> 7")), rows(t.lineitem), "k", "n")


@query()
def candidate_exclusion_audit(t):
    """Orders play decisions on their customer; a decision covers its customer and, where its scope is exact, two that follow."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    decisions = t.orders.select(
        c.alias("seed_id"), k.alias("decision_id"), F.row_number().over(order).alias("revision"), F.when(F.col("o_orderstatus") == "O", "not_entity").when(F.col("o_orderstatus") == "F", "revoked").otherwise("assigned").alias("status"),
        F.when(k % 3 == 0, "exact").otherwise("single").alias("scope"), F.when(k % 41 == 0, c).alias("entity_id"),
    )
    covers = F.when(F.col("scope") == "exact", F.array(F.col("seed_id"), F.col("seed_id") + 10, F.col("seed_id") + 20)).otherwise(F.array("seed_id"))
    exclusions = decisions.where("decision_id % 53 <> 0").select("decision_id", F.explode(covers).alias("candidate_id"))
    own = F.col("c_custkey")
    candidates = t.customer.select(own.alias("candidate_id"), F.lit("person").alias("entity_type"), (own % 10).cast("string").alias("canonical"), F.when(own % 31 == 0, "broken").alias("chain_issue"))
    return P.exclusion_audit(decisions, exclusions, candidates, t.customer.where("c_custkey % 43 = 0").select(own.alias("candidate_id")))

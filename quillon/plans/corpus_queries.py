"""Queries over corpus building, similarity and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import numbers as N
from quillon.functions import text as T
from quillon.operators import calibration as C
from quillon.operators import corpus as K
from quillon.operators import ledger as L
from quillon.operators import runs as R
from quillon.operators import similarity as S

from ._registry import query

_TOKENS = "regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\\p{L}\\p{M}\\p{N}\\p{Pc}]+')"


@query(f"SELECT sha256(array_to_string({_TOKENS}, ' ')) AS text_hash, min(doc_id) AS first_doc, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicate_groups(t):
    return K.duplicate_groups(t.documents)


@query()
def simhash_near_duplicates(t):
    return K.simhash_pairs(t.documents)


_GRAMS = f"""d AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM (SELECT doc_id, {_TOKENS} AS w FROM documents))),
    b AS (SELECT DISTINCT item_id, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM (SELECT item_id, {_TOKENS} AS w FROM benchmark)))"""


@query(f"WITH {_GRAMS} SELECT item_id, doc_id, count(*) AS shared FROM d JOIN b USING (g) GROUP BY 1, 2")
def benchmark_contamination(t):
    return K.contamination(t.documents, t.benchmark)


_SPLIT = """s AS (SELECT doc_id, source, lang, CAST('0x' || left(sha256('quillon' || chr(0) || source), 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS frac FROM documents),
    p AS (SELECT *, CASE WHEN frac < 0.6 THEN 'train' WHEN frac < 0.8 THEN 'calibration' ELSE 'test' END AS split FROM s)"""


def _split(t):
    return K.splits(t.documents.select("doc_id", "source", "lang"), "source", "quillon")


@query(f"WITH {_SPLIT} SELECT source, split, count(*) AS n FROM p GROUP BY 1, 2")
def hash_split_assignment(t):
    return _split(t).groupBy("source", "split").agg(F.count("*").alias("n"))


@query(
    f"""WITH {_SPLIT}, c AS (SELECT split, CAST(quality AS INTEGER) AS label, count(*) AS n FROM p JOIN labels USING (doc_id) GROUP BY 1, 2)
    SELECT split, label, coalesce(n, 0) AS n FROM (SELECT unnest(['train', 'calibration', 'test']) AS split) CROSS JOIN (SELECT unnest([0, 1]) AS label) LEFT JOIN c USING (split, label)"""
)
def split_label_matrix(t):
    rows = _split(t).join(t.labels.select("doc_id", F.col("quality").cast("int").alias("label")), "doc_id")
    return K.split_matrix(rows, [0, 1])


@query(f"WITH {_SPLIT} SELECT lang, count(DISTINCT split) AS splits FROM p GROUP BY 1 HAVING count(DISTINCT split) > 1")
def group_leakage(t):
    return K.leaking_groups(_split(t), "lang")


@query(
    """SELECT source, n, sha256(n::VARCHAR || ':' || a::VARCHAR || ':' || b::VARCHAR) AS content_hash FROM (SELECT source, count(*) AS n, sum(CAST('0x' || left(h, 15) AS BIGINT)) AS a,
      sum(CAST('0x' || substring(h, 16, 15) AS BIGINT)) AS b FROM (SELECT source, sha256(text) AS h FROM documents) GROUP BY 1)"""
)
def corpus_hashes(t):
    return K.order_free_hash(t.documents, N.sha256("text"), "source")


@query(
    """WITH f AS (SELECT source, sha256(text) AS content_hash, min(doc_id) AS first_id, count(*) AS retrievals FROM documents GROUP BY 1, 2)
    SELECT source, content_hash, CAST(row_number() OVER (PARTITION BY source ORDER BY first_id, content_hash) AS INTEGER) AS version_number, first_id, retrievals FROM f"""
)
def content_hash_versions(t):
    docs = t.documents.select("source", "text", "doc_id", F.col("doc_id").alias("retrieved"))
    return L.versions(docs, "source", F.col("text"), "retrieved", "doc_id")


@query(
    """SELECT page_id, sha256('{"endpoint":' || (page_id % 23) || ',"external_id":' || to_json(url) || ',"language":null,"title":' || to_json('page ' || page_id) || '}') AS fingerprint FROM pages"""
)
def candidate_fingerprint(t):
    told = N.canonical_json(endpoint=F.col("page_id") % 23, external_id="url", language=F.lit(None).cast("string"), title=F.concat(F.lit("page "), F.col("page_id").cast("string")))
    return t.pages.select("page_id", N.sha256(told).alias("fingerprint"))


_EVIDENCE = """e AS (SELECT doc_id, text, unnest([0, 1, 2]) AS k, doc_id % 17 AS z FROM documents),
    v AS (SELECT doc_id AS result_id, CASE WHEN z = 1 AND k = 2 THEN 3 ELSE k END AS evidence_index, CASE WHEN z = 2 THEN doc_id + 1000000000 ELSE doc_id END AS artifact_id, CASE WHEN z = 3 THEN -1 ELSE k * (length(text) // 3) END AS "start",
      CASE WHEN z = 4 THEN length(text) + 1 ELSE (k + 1) * (length(text) // 3) END AS "end", CASE WHEN z = 5 AND k = 1 THEN 'other' ELSE substring(text, k * (length(text) // 3) + 1, length(text) // 3) END AS excerpt, z, k FROM e),
    h AS (SELECT *, CASE WHEN z = 6 THEN 'x' ELSE sha256(excerpt) END AS excerpt_sha256, row_number() OVER (PARTITION BY result_id ORDER BY evidence_index) - 1 AS n FROM v)"""


@query(
    f"""WITH {_EVIDENCE} SELECT result_id, evidence_index, issue FROM (SELECT h.*, CASE WHEN text IS NULL THEN 'unknown_artifact' WHEN evidence_index <> n THEN 'index_gap' WHEN NOT ("start" >= 0 AND "start" < "end" AND "end" <= length(text)) THEN 'bad_span'
      WHEN substring(text, "start" + 1, "end" - "start") <> excerpt THEN 'excerpt_differs' WHEN sha256(excerpt) <> excerpt_sha256 THEN 'hash_differs' END AS issue FROM h LEFT JOIN documents ON doc_id = artifact_id) WHERE issue IS NOT NULL"""
)
def evidence_verification(t):
    """Every text in three spans, some of which were tampered with."""
    i, z, k = F.col("doc_id"), F.col("doc_id") % 17, F.col("k")
    third = F.floor(F.length("text") / 3).cast("int")
    rows = t.documents.select("doc_id", "text", F.explode(F.array(*[F.lit(n) for n in range(3)])).alias("k"))
    excerpt = F.when((z == 5) & (k == 1), "other").otherwise(F.substr("text", k * third + 1, third))
    evidence = rows.select(
        i.alias("result_id"), F.when((z == 1) & (k == 2), 3).otherwise(k).alias("evidence_index"), F.when(z == 2, i + 1000000000).otherwise(i).alias("artifact_id"), F.when(z == 3, -1).otherwise(k * third).alias("start"),
        F.when(z == 4, F.length("text") + 1).otherwise((k + 1) * third).alias("end"), excerpt.alias("excerpt"), F.when(z == 6, "x").otherwise(N.sha256(excerpt)).alias("excerpt_sha256"),
    )
    return R.evidence_issues(evidence, t.documents.select(i.alias("artifact_id"), "text"))


@query(f"""WITH {_EVIDENCE} SELECT result_id, k AS evidence_index, sha256('{{"artifact":' || artifact_id || ',"end":' || "end" || ',"sha256":"' || excerpt_sha256 || '","start":' || "start" || '}}') AS evidence_hash FROM h WHERE z > 6""")
def evidence_locators(t):
    third = F.floor(F.length("text") / 3).cast("int")
    rows = t.documents.where("doc_id % 17 > 6").select("doc_id", "text", F.explode(F.array(*[F.lit(n) for n in range(3)])).alias("k"))
    part = F.substr("text", F.col("k") * third + 1, third)
    locator = N.canonical_json(artifact="doc_id", start=F.col("k") * third, end=(F.col("k") + 1) * third, sha256=N.sha256(part))
    return rows.select(F.col("doc_id").alias("result_id"), F.col("k").alias("evidence_index"), N.sha256(locator).alias("evidence_hash"))


# Pairs: a document and the next one of its source.
_PAIRS = "pr AS (SELECT doc_id AS left_id, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS right_id FROM documents), p AS (SELECT * FROM pr WHERE right_id IS NOT NULL)"
_TERMS = """tm AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\\p{L}\\p{N}]+(?:[''’][\\p{L}\\p{N}]+)?')) AS term FROM documents)
      WHERE length(term) >= 3 AND NOT regexp_full_match(term, '\\p{Nd}+') GROUP BY 1, 2), z AS (SELECT doc_id, sum(tf) AS n, sum(tf * tf) AS sq FROM tm GROUP BY 1)"""
_LEX = f"""{_PAIRS}, {_TERMS}, dt AS (SELECT left_id, right_id, sum(a.tf * b.tf) AS dot FROM p JOIN tm a ON a.doc_id = left_id JOIN tm b ON b.doc_id = right_id AND b.term = a.term GROUP BY 1, 2),
    lx AS (SELECT p.left_id, p.right_id, CAST(dot AS BIGINT) AS dot, CASE WHEN coalesce(a.n, 0) >= 20 AND coalesce(b.n, 0) >= 20 THEN coalesce(dot, 0) / sqrt(a.sq::DOUBLE * b.sq::DOUBLE) END AS lexical
      FROM p LEFT JOIN dt USING (left_id, right_id) LEFT JOIN z a ON a.doc_id = left_id LEFT JOIN z b ON b.doc_id = right_id)"""


def _pairs(t):
    from pyspark.sql import Window

    after = F.lead("doc_id").over(Window.partitionBy("source").orderBy("doc_id"))
    return t.documents.select(F.col("doc_id").alias("left_id"), after.alias("right_id")).where("right_id is not null")


@query(f"WITH {_LEX} SELECT left_id, right_id, dot, CAST(floor(lexical * 10000 + 0.5) AS BIGINT) AS lexical FROM lx")
def pair_similarity_lexical(t):
    return S.lexical(_pairs(t), S.term_counts(t.documents)).select("left_id", "right_id", "dot", N.scaled("lexical").alias("lexical"))


_ENT = """en AS (SELECT doc_id, list(DISTINCT e) AS es FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{4,}')) AS e FROM documents) GROUP BY 1),
    ej AS (SELECT left_id, right_id, len(list_intersect(a.es, b.es))::DOUBLE / (len(a.es) + len(b.es) - len(list_intersect(a.es, b.es))) AS entities FROM p JOIN en a ON a.doc_id = left_id JOIN en b ON b.doc_id = right_id)"""


def _entities(t, pairs):
    sets = t.documents.select("doc_id", F.array_distinct(T.find_all("text", "[A-Z][a-z]{4,}")).alias("es"))
    left, right = sets.select(F.col("doc_id").alias("left_id"), F.col("es").alias("a")), sets.select(F.col("doc_id").alias("right_id"), F.col("es").alias("b"))
    return pairs.join(left, "left_id").join(right, "right_id").withColumn("entities", S.jaccard(F.col("a"), F.col("b"))).drop("a", "b")


@query(f"WITH {_PAIRS}, {_ENT} SELECT p.left_id, p.right_id, CAST(floor(entities * 10000 + 0.5) AS BIGINT) AS entities FROM p LEFT JOIN ej USING (left_id, right_id)")
def pair_similarity_entities(t):
    return _entities(t, _pairs(t)).select("left_id", "right_id", N.scaled("entities").alias("entities"))


_HOURS = "CASE WHEN left_id % 13 <> 0 THEN abs((left_id * 7919) % 3000 - (right_id * 7919) % 3000) / 10.0::DOUBLE END"


def _temporal(pairs):
    """Publication times are invented from ids; a multiple of 13 has none."""
    hours = F.abs((F.col("left_id") * 7919) % 3000 - (F.col("right_id") * 7919) % 3000) / 10.0
    return pairs.withColumn("temporal", N.linear_decay(F.when(F.col("left_id") % 13 != 0, hours)))


@query(f"WITH {_PAIRS} SELECT left_id, right_id, CAST(floor(greatest(0.0::DOUBLE, 1 - h / 72.0::DOUBLE) * 10000 + 0.5) AS BIGINT) AS temporal FROM (SELECT *, {_HOURS} AS h FROM p) WHERE h IS NOT NULL UNION ALL SELECT left_id, right_id, NULL FROM p WHERE left_id % 13 = 0")
def pair_similarity_temporal(t):
    return _temporal(_pairs(t)).select("left_id", "right_id", N.scaled("temporal").alias("temporal"))


@query(
    f"""WITH {_LEX}, {_ENT}, c AS (SELECT left_id, right_id, CASE WHEN left_id % 13 <> 0 THEN greatest(0.0::DOUBLE, 1 - {_HOURS} / 72.0::DOUBLE) END AS tp, entities, lexical FROM lx LEFT JOIN ej USING (left_id, right_id)),
    w AS (SELECT *, CASE WHEN tp IS NOT NULL THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN entities IS NOT NULL THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN lexical IS NOT NULL THEN 0.3::DOUBLE ELSE 0 END AS have FROM c)
    SELECT left_id, right_id, CAST(floor((coalesce(tp * 0.2::DOUBLE, 0) + coalesce(entities * 0.5::DOUBLE, 0) + coalesce(lexical * 0.3::DOUBLE, 0)) / nullif(have, 0) * 10000 + 0.5) AS BIGINT) AS score, CAST(floor(have * 10 + 0.5) AS BIGINT) AS available FROM w"""
)
def pair_similarity_combined(t):
    pairs = S.combined(_entities(t, S.lexical(_temporal(_pairs(t)), S.term_counts(t.documents))))
    return pairs.select("left_id", "right_id", N.scaled("score").alias("score"), N.scaled("available_weight", 10).alias("available"))


@query(
    """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.vec_id, b.vec_id AS neighbour, list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) AS c
      FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id)
    SELECT vec_id, neighbour, CAST(rank AS INTEGER) AS rank, CAST(floor(c * 10000 + 0.5) AS BIGINT) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, neighbour) AS rank FROM p) WHERE rank <= 5"""
)
def embedding_cosine_topk(t):
    return S.cosine_topk(t.embeddings, 5).select("vec_id", "neighbour", "rank", N.scaled("cosine").alias("cosine"))


# Calibration: the share of exclamation marks and capitals plays a score, quality (inverted) the label.
_SCORED = """sc AS (SELECT d.doc_id, d.lang, d.source, 1 - CAST(l.quality AS INTEGER) AS label, floor(least(1.0::DOUBLE, (len(regexp_extract_all(d.text, '[A-Z!|#]')) * 4.0::DOUBLE) / greatest(1, length(d.text))) * 100) / 100 AS score FROM documents d JOIN labels l USING (doc_id))"""


def _scored(t):
    share = F.regexp_count("text", F.lit("[A-Z!|#]")) * 4.0 / F.greatest(F.lit(1), F.length("text"))
    score = F.floor(F.least(F.lit(1.0), share) * 100) / 100
    return t.documents.join(t.labels, "doc_id").select("doc_id", "lang", "source", (1 - F.col("quality").cast("int")).alias("label"), score.alias("score"))


_CONF = "count(*) FILTER (WHERE score >= 0.3 AND label = 1) AS tp, count(*) FILTER (WHERE score >= 0.3 AND label = 0) AS fp, count(*) FILTER (WHERE score < 0.3 AND label = 0) AS tn, count(*) FILTER (WHERE score < 0.3 AND label = 1) AS fn"


@query(f"WITH {_SCORED} SELECT lang, {_CONF} FROM sc GROUP BY 1")
def confusion_matrix(t):
    return C.confusion(_scored(t), 0.3, "lang")


@query(
    f"""WITH {_SCORED}, c AS (SELECT {_CONF} FROM sc), w AS (SELECT tp, fp, tn, fn, (tp + fn)::DOUBLE AS n, tp / nullif((tp + fn)::DOUBLE, 0) AS p, {N.Z95}::DOUBLE AS zz FROM c)
    SELECT tp, fp, tn, fn, CAST(floor(p * 10000 + 0.5) AS BIGINT) AS recall, CAST(floor(greatest(0, (p + zz * zz / (2 * n)) / (1 + zz * zz / n) - zz * sqrt(p * (1 - p) / n + zz * zz / (4 * n * n)) / (1 + zz * zz / n)) * 10000 + 0.5) AS BIGINT) AS recall_low,
      CAST(floor(least(1, (p + zz * zz / (2 * n)) / (1 + zz * zz / n) + zz * sqrt(p * (1 - p) / n + zz * zz / (4 * n * n)) / (1 + zz * zz / n)) * 10000 + 0.5) AS BIGINT) AS recall_high FROM w"""
)
def wilson_interval(t):
    whole = C.rates(C.confusion(_scored(t), 0.3))
    return whole.select("tp", "fp", "tn", "fn", *[N.scaled(c).alias(c) for c in ("recall", "recall_low", "recall_high")])


@query(f"""WITH {_SCORED} SELECT CAST(sum(CASE WHEN p.score > n.score THEN 2 WHEN p.score = n.score THEN 1 ELSE 0 END) AS BIGINT) AS twice_wins,
    (SELECT count(*) FROM sc WHERE label = 1) AS positives, (SELECT count(*) FROM sc WHERE label = 0) AS negatives FROM sc p, sc n WHERE p.label = 1 AND n.label = 0""")
def roc_auc_ranksum(t):
    return C.auc_counts(_scored(t))


_SWEEP = f"""{_SCORED}, th AS (SELECT DISTINCT score AS threshold FROM sc UNION SELECT 0.0 UNION SELECT 1.0),
    sw AS (SELECT threshold, count(*) FILTER (WHERE score >= threshold AND label = 1) AS tp, count(*) FILTER (WHERE score >= threshold AND label = 0) AS fp,
      count(*) FILTER (WHERE score < threshold AND label = 0) AS tn, count(*) FILTER (WHERE score < threshold AND label = 1) AS fn FROM th CROSS JOIN sc GROUP BY 1)"""


@query(f"WITH {_SWEEP} SELECT CAST(floor(threshold * 100 + 0.5) AS BIGINT) AS threshold, tp, fp, tn, fn FROM sw")
def threshold_sweep(t):
    return C.threshold_sweep(_scored(t)).withColumn("threshold", N.scaled("threshold", 100))


@query(
    f"""WITH {_SWEEP}, r AS (SELECT threshold, CAST(floor((tp / (tp + fn)::DOUBLE + 1 - fp / (fp + tn)::DOUBLE) / 2 * 1000000 + 0.5) AS BIGINT) AS balanced, CAST(floor(fp / (fp + tn)::DOUBLE * 1000000 + 0.5) AS BIGINT) AS fpr FROM sw)
    SELECT CAST(floor(threshold * 100 + 0.5) AS BIGINT) AS threshold, balanced, fpr FROM r ORDER BY balanced DESC, fpr, r.threshold DESC LIMIT 1"""
)
def calibrated_threshold(t):
    return C.best_threshold(C.threshold_sweep(_scored(t))).withColumn("threshold", N.scaled("threshold", 100))


@query(
    f"""WITH {_SCORED} SELECT lang, source, count(*) AS n, count(*) FILTER (WHERE score >= 0.3 AND label = 1) AS tp, count(*) FILTER (WHERE score >= 0.3 AND label = 0) AS fp,
      CAST(grouping(lang) * 2 + grouping(source) AS BIGINT) AS level FROM sc GROUP BY GROUPING SETS ((), (lang), (source))"""
)
def sliced_metrics(t):
    return C.sliced(_scored(t), 0.3, "lang", "source")

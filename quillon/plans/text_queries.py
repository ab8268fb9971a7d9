"""Queries over documents' texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import numbers as N
from quillon.functions import text as T
from quillon.operators import documents as D

from ._registry import query

_WORD = "[A-Za-z]+(?:[''’][A-Za-z]+)?"


@query(
    f"""SELECT doc_id, lang, source, len(w) AS word_count, len(list_distinct(list_transform(w, lambda x: lower(x)))) AS distinct_words,
      length(text) - length(replace(text, '!', '')) AS exclamations, length(text) - length(replace(text, '?', '')) AS questions, length(text) AS characters
    FROM (SELECT *, regexp_extract_all(text, '{_WORD}') AS w FROM documents)"""
)
def structural_text_metrics(t):
    w = t.documents.withColumn("w", T.ascii_words("text"))
    mark = lambda c: (F.length("text") - F.length(F.replace("text", F.lit(c), F.lit("")))).cast("long")
    return w.select(
        "doc_id", "lang", "source", F.size("w").cast("long").alias("word_count"),
        F.size(F.array_distinct(F.transform("w", lambda x: F.lower(x)))).cast("long").alias("distinct_words"),
        mark("!").alias("exclamations"), mark("?").alias("questions"), F.length("text").cast("long").alias("characters"),
    )


@query(
    """SELECT doc_id, bad AS suspicious, length(x) > 0 AND bad <= greatest(2, length(x) // 200) AS readable
    FROM (SELECT doc_id, trim(text, ' ') AS x, len(regexp_extract_all(trim(text, ' '), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{9F}\\x{FFFD}]')) AS bad FROM documents)"""
)
def readable_text_gate(t):
    return t.documents.select("doc_id", T.suspicious_characters(F.trim("text")).cast("long").alias("suspicious"), T.is_readable("text").alias("readable"))


@query("""SELECT coalesce(nullif(split_part(lower(trim(lang)), '-', 1), ''), 'unknown') AS language, count(*) AS n FROM documents GROUP BY 1""")
def language_normalised_counts(t):
    return t.documents.groupBy(F.coalesce(T.language("lang"), F.lit("unknown")).alias("language")).agg(F.count("*").alias("n"))


@query(
    """SELECT d.doc_id, coalesce(list_contains(string_split(regexp_extract(p.url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), 'video'), false) AS blocked,
      length(d.text) < 800 AS short_text, NOT contains(d.text, chr(10) || chr(10)) AS no_paragraphs
    FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id"""
)
def event_text_readiness(t):
    pages = t.pages.select(F.col("page_id").alias("doc_id"), "url")
    return D.event_text_readiness(t.documents.select("doc_id", "text").join(pages, "doc_id", "left"), F.col("url")).drop("text", "url")


@query(
    """WITH t AS (SELECT lang, doc_id, unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\\p{L}\\p{N}]+(?:[''’][\\p{L}\\p{N}]+)?')) AS term FROM documents),
    c AS (SELECT lang, term, count(*) AS n, count(DISTINCT doc_id) AS docs FROM t WHERE length(term) >= 3 AND NOT regexp_full_match(term, '\\p{Nd}+') GROUP BY 1, 2)
    SELECT lang, term, n, docs, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, docs DESC, term) AS r FROM c) WHERE r <= 20"""
)
def term_frequency_topk(t):
    from pyspark.sql import Window

    terms = t.documents.select("lang", "doc_id", F.explode(T.terms("text")).alias("term"))
    counted = terms.groupBy("lang", "term", "doc_id").count().groupBy("lang", "term").agg(F.sum("count").alias("n"), F.count("*").alias("docs"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), F.desc("docs"), "term"))
    return counted.withColumn("rank", rank).where("rank <= 20")


#: The driver's invented texts hold next to no marker of the fixed lexicons, so the queries take frequent words instead.
_FREQUENT = {"articles": ("the", "a", "la", "der"), "links": ("of", "and", "et", "und", "y"), "threat": D.THREAT}


def _listed(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


@query(
    "SELECT doc_id, "
    + ", ".join(f"len(list_filter(w, lambda x: x IN ({_listed(v)}))) AS {k}" for k, v in _FREQUENT.items())
    + f" FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '{_WORD}'), lambda x: lower(x)) AS w FROM documents)"
)
def lexicon_marker_counts(t):
    return D.marker_counts(t.documents, _FREQUENT)


@query()
def lexicon_sentence_evidence(t):
    return D.marker_evidence(t.documents, _FREQUENT)


@query()
def synthetic_eligibility(t):
    english = t.documents.where(T.is_english("lang"))
    return D.structural_metrics(english).select("doc_id", "word_count", "sentence_count", "eligible")


@query()
def synthetic_structural_score(t):
    return D.structural_metrics(t.documents.where(T.is_english("lang")))


def _with_phrases(t):
    """Documents, into some of which a phrase was put twice: invented prose holds none."""
    phrases = F.array(*[F.lit(p) for p in D.FORMULAIC])
    phrase = F.get(phrases, (F.col("doc_id") % len(D.FORMULAIC)).cast("int"))
    put = F.concat(F.initcap(phrase), F.lit(", "), "text", F.lit(" "), F.upper(phrase), F.lit("."))
    return t.documents.select("doc_id", F.when(F.col("doc_id") % 3 == 0, put).otherwise(F.col("text")).alias("text"))


_PHRASES = "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in D.FORMULAIC) + "]"


@query(
    f"""WITH d AS (SELECT doc_id, length(text) AS n, {_PHRASES}[doc_id % {len(D.FORMULAIC)} + 1] AS p FROM documents WHERE doc_id % 3 = 0)
    SELECT doc_id, CAST(0 AS INTEGER) AS "start", CAST(length(p) AS INTEGER) AS "end", lower(p) AS phrase FROM d
    UNION ALL SELECT doc_id, CAST(length(p) + 2 + n + 1 AS INTEGER), CAST(2 * length(p) + 2 + n + 1 AS INTEGER), lower(p) FROM d"""
)
def formulaic_signal_spans(t):
    return D.formulaic_spans(_with_phrases(t)).withColumn("phrase", F.lower("phrase"))


@query(
    """SELECT doc_id, CASE WHEN length(s) > 240 THEN rtrim(left(s, 239)) || '…' ELSE s END AS excerpt
    FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS s FROM documents)"""
)
def excerpt_coalesce_truncate(t):
    content, _ = D.excerpt(F.col("text"), F.col("text"), 240)
    return t.documents.select("doc_id", content.alias("excerpt"))


_BLOCKS = """b AS (SELECT doc_id, i, line, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(line) - 1 AS pos
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)),
    k AS (SELECT doc_id, i, trim(line, ' ') AS block, pos + length(line) - length(ltrim(line, ' ')) AS start FROM b WHERE trim(line, ' ') <> '')"""


@query(
    f"""WITH {_BLOCKS} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS block_index,
      CAST(start AS INTEGER) AS "start", CAST(start + length(block) AS INTEGER) AS "end", sha256(block) AS block_hash FROM k"""
)
def line_blocks_with_offsets(t):
    return D.blocks(t.documents).drop("block")


@query(
    f"""WITH {_BLOCKS}, h AS (SELECT doc_id, block, len(regexp_extract_all(block, '[\\p{{L}}\\p{{N}}_''-]+')) AS n FROM k)
    SELECT doc_id, count(*) AS blocks, CAST(count(*) FILTER (WHERE n BETWEEN 1 AND 18 AND length(block) <= 180 AND NOT regexp_matches(block, '[.!;]$')
      AND (NOT regexp_matches(block, ':$') OR length(block) <= 80)) AS BIGINT) AS headings FROM h GROUP BY doc_id"""
)
def heading_candidates(t):
    return D.blocks(t.documents).groupBy("doc_id").agg(F.count("*").alias("blocks"), F.count_if(T.is_heading("block")).alias("headings"))


@query()
def heading_sections(t):
    return D.heading_sections(D.blocks(t.documents))


@query()
def message_packing(t):
    items = t.documents.select(F.col("source").alias("channel"), F.col("doc_id").alias("item"), F.coalesce(F.length("text"), F.lit(0)).alias("size"))
    return D.pack_messages(items)


@query("""SELECT page_id, sha256(url || chr(10) || html) AS page_hash, length(html) AS html_chars FROM pages""")
def page_hashes(t):
    return t.pages.select("page_id", N.sha256(F.concat("url", F.lit("\n"), "html")).alias("page_hash"), F.length("html").cast("long").alias("html_chars"))


@query()
def html_main_text(t):
    return t.pages.select("page_id", T.html_main_text("html").alias("main_text"))


@query(
    f"""WITH d AS (SELECT doc_id, text, list_transform(regexp_extract_all(text, '{_WORD}'), lambda x: lower(x)) AS w, len(list_filter(string_split_regex(text, '[.!?]+(\\s|$)'), lambda x: regexp_matches(x, '[A-Za-z]'))) AS m FROM documents)
    SELECT doc_id, len(w) AS word_count, m AS sentence_count, CAST(floor(len(w)::DOUBLE / nullif(m, 0) * 100 + 0.5) AS BIGINT) AS average_sentence_length, length(text) - length(replace(text, '?', '')) AS questions, length(text) - length(replace(text, '!', '')) AS exclamations,
      len(list_filter(w, lambda x: x IN ({_listed(D.FIRST_PLURAL)}))) AS first_person_plural, len(list_filter(w, lambda x: x IN ({_listed(D.THIRD_PLURAL)}))) AS third_person_plural,
      """
    + ", ".join(f"len(list_filter(w, lambda x: x IN ({_listed(v)}))) AS {k}" for k, v in _FREQUENT.items())
    + ", CASE WHEN len(w) = 0 THEN 'blank' END AS issue FROM d"
)
def discourse_profile(t):
    return D.discourse(t.documents, _FREQUENT).withColumn("average_sentence_length", N.scaled("average_sentence_length", 100))


@query("SELECT doc_id, sha256(nfc_normalize(replace(text, 'é', 'e' || chr(769)))) AS text_hash FROM documents")
def unicode_normal_forms(t):
    apart = F.replace("text", F.lit("é"), F.lit("e\u0301"))
    return t.documents.select("doc_id", N.sha256(T.unicode_form(apart, "NFC")).alias("text_hash"))

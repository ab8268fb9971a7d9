"""Per-document text operators: structure, discourse, readiness, blocks, headings, excerpts, message packing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.shipping import packaged

# The marker lexicons, the first-person plural and third-person plural forms, the formulaic phrases.
CERTAINTY = ("certainly", "clearly", "definitely", "inevitably", "must", "obvious", "proven", "undoubtedly", "will")
UNCERTAINTY = ("allegedly", "apparently", "could", "likely", "may", "might", "perhaps", "possibly", "reportedly", "unlikely")
FEAR = ("catastrophe", "chaos", "collapse", "devastating", "disaster", "fear", "nightmare", "panic", "terror")
THREAT = ("aggression", "attack", "danger", "destroy", "enemy", "existential", "extinction", "hostile", "invasion", "threat")
FIRST_PLURAL = ("we", "our", "ours", "us")
THIRD_PLURAL = ("they", "their", "theirs", "them")
LEXICONS = {"certainty": CERTAINTY, "uncertainty": UNCERTAINTY, "fear": FEAR, "threat": THREAT}
FORMULAIC = (
    "in conclusion", "it is important to note", "it is worth noting", "delve into", "a testament to",
    "in today's rapidly evolving", "in the ever-evolving", "plays a crucial role", "shed light on", "multifaceted",
    "tapestry of", "moreover", "furthermore",
)
MIN_WORDS, MIN_SENTENCES = 250, 10


def structural_metrics(docs: DataFrame) -> DataFrame:
    """Words, sentences, variation of sentence lengths, lexical diversity, formulaic density, eligibility and score.

    The score is null unless a text has 250 words and 10 sentences: unavailable is not zero.
    """
    sizes = F.transform(T.sentences("text"), lambda s: F.size(T.ascii_words(s)))
    phrases = F.array(*[F.lit("(?iU)\\b\\Q" + p + "\\E\\b") for p in FORMULAIC])
    hits = F.aggregate(phrases, F.lit(0), lambda n, p: n + F.regexp_count(F.col("text"), p))
    base = docs.select("doc_id", T.ascii_words("text").alias("w"), sizes.alias("s"), hits.alias("formulaic"))
    n, m = F.size("w"), F.size("s")
    mean = F.aggregate("s", F.lit(0), lambda a, x: a + x) / F.nullif(m, F.lit(0))
    spread = F.sqrt(F.aggregate("s", F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / m) / F.nullif(mean, F.lit(0.0))
    out = base.select(
        "doc_id",
        n.cast("long").alias("word_count"),
        m.cast("long").alias("sentence_count"),
        F.coalesce(mean, F.lit(0.0)).alias("average_sentence_length"),
        F.when(m < 2, 0.0).otherwise(F.coalesce(spread, F.lit(0.0))).alias("variation"),
        F.coalesce(F.size(F.array_distinct(F.transform("w", lambda x: F.lower(x)))) / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("diversity"),
        F.col("formulaic").cast("long").alias("formulaic_count"),
        F.coalesce(F.col("formulaic") * 1000 / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("density"),
    )
    eligible = (F.col("word_count") >= MIN_WORDS) & (F.col("sentence_count") >= MIN_SENTENCES)
    score = 0.35 * (1 - F.least("variation", F.lit(1.0))) + 0.25 * (1 - F.least(F.greatest("diversity", F.lit(0.0)), F.lit(1.0)))
    score = score + 0.40 * F.least(F.col("density") / 8, F.lit(1.0))
    return out.withColumn("eligible", eligible).withColumn("score", F.when(eligible, F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))))


def formulaic_spans(docs: DataFrame) -> DataFrame:
    """doc_id, start, end, phrase of every formulaic phrase: gaps and matches alternate, so running lengths give positions."""
    rows = None
    for phrase in FORMULAIC:
        pattern = "(?iU)\\b\\Q" + phrase + "\\E\\b"
        found = docs.where(F.col("text").rlike(pattern)).select(
            "doc_id", "text", F.posexplode(F.split("text", pattern, -1)).alias("i", "gap"), T.find_all("text", pattern).alias("m")
        )
        before = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
        n = F.length(F.get("m", F.col("i")))
        part = found.withColumn("start", F.sum(F.length("gap")).over(before) + F.col("i") * len(phrase))
        part = part.where(F.col("i") < F.size("m")).select("doc_id", F.col("start").cast("int").alias("start"), (F.col("start") + n).cast("int").alias("end"), F.get("m", F.col("i")).alias("phrase"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def marker_counts(docs: DataFrame, lexicons: dict[str, tuple[str, ...]] = LEXICONS, lemma=F.lower) -> DataFrame:
    """doc_id and the number of markers of each lexicon. lemma maps a word column; the default is its lower-case form."""
    words = docs.select("doc_id", F.transform(T.ascii_words("text"), lambda w: lemma(w)).alias("w"))

    def hits(terms):
        return F.size(F.filter("w", lambda x: x.isin(*terms))).cast("long")

    return words.select("doc_id", *[hits(terms).alias(name) for name, terms in lexicons.items()])


def discourse(docs: DataFrame, lexicons: dict[str, tuple[str, ...]] = LEXICONS, lemma=F.lower) -> DataFrame:
    """Words, sentences, words a sentence, question and exclamation marks, plural pronouns and markers of each lexicon.

    A sentence is what lies between sentence ends (. ! ? before white space or at the end) and holds a letter. A text without words is blank: its issue says so and its average is null. lemma maps a word column.
    """
    mark = lambda c: (F.length("text") - F.length(F.replace("text", F.lit(c), F.lit("")))).cast("long")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("w", F.transform(T.ascii_words("text"), lambda w: lemma(w)))
    hits = lambda terms: F.size(F.filter("w", lambda x: x.isin(*terms))).cast("long")
    pieces = F.filter(F.split("text", "[.!?]+(?:\\s|$)", -1), lambda s: s.rlike("[A-Za-z]"))
    n, m = F.size("w").cast("long"), F.size(pieces).cast("long")
    return rows.select(
        "doc_id", n.alias("word_count"), m.alias("sentence_count"), (n / F.nullif(m, F.lit(0))).alias("average_sentence_length"), mark("?").alias("questions"), mark("!").alias("exclamations"),
        hits(FIRST_PLURAL).alias("first_person_plural"), hits(THIRD_PLURAL).alias("third_person_plural"), *[hits(terms).alias(name) for name, terms in lexicons.items()], F.when(n == 0, "blank").alias("issue"),
    )


def marker_evidence(docs: DataFrame, lexicons: dict[str, tuple[str, ...]] = LEXICONS) -> DataFrame:
    """One row for each document, category and sentence with a marker: hits, sorted distinct terms, the sentence's hash."""
    listed = F.array(*[F.struct(F.lit(c).alias("category"), F.array(*[F.lit(t) for t in terms]).alias("terms")) for c, terms in lexicons.items()])
    rows = docs.select("doc_id", F.posexplode(T.sentences("text")).alias("sentence_index", "sentence"))
    rows = rows.withColumn("w", F.transform(T.ascii_words("sentence"), lambda x: F.lower(x))).select("*", F.inline(listed))
    hits = F.filter("w", lambda x: F.array_contains(F.col("terms"), x))
    return rows.where(F.size(hits) > 0).select(
        "doc_id", "category", "sentence_index", F.size(hits).alias("hits"), F.array_join(F.sort_array(F.array_distinct(hits)), ",").alias("matched_terms"), F.sha2("sentence", 256).alias("sentence_hash")
    )


def event_text_readiness(texts: DataFrame, url=None, is_transcript=None) -> DataFrame:
    """Blocked where a video address holds no transcript; warned about short texts and texts without paragraphs."""
    video = F.lit(False) if url is None else F.coalesce(F.array_contains(F.split(F.try_parse_url(url, F.lit("PATH")), "/"), "video"), F.lit(False))
    spoken = F.lit(False) if is_transcript is None else is_transcript
    return (
        texts.withColumn("blocked", video & ~spoken)
        .withColumn("short_text", F.length("text") < 800)
        .withColumn("no_paragraphs", ~F.contains("text", F.lit("\n\n")))
    )


def blocks(docs: DataFrame, separator: str = "\\n", width: int = 1) -> DataFrame:
    """Non-blank blocks of each text with half-open offsets and hash. width: characters that a separator takes."""
    whole = docs.select("doc_id", F.split("text", separator, -1).alias("parts"))
    starts = F.aggregate(
        "parts", F.array(F.lit(0)), lambda a, p: F.array_append(a, F.element_at(a, -1) + F.length(p) + width)
    )
    rows = whole.select("doc_id", F.posexplode(F.arrays_zip(F.col("parts"), F.slice(starts, 1, F.size("parts")).alias("starts"))).alias("i", "b"))
    rows = rows.select("doc_id", "i", F.col("b.starts").alias("start"), F.col("b.parts").alias("block")).where(F.trim("block") != "")
    lead = F.length("block") - F.length(F.ltrim("block"))
    rows = rows.withColumn("start", F.col("start") + lead).withColumn("block", F.trim("block"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("i"))
    return rows.select("doc_id", rank.alias("block_index"), "start", (F.col("start") + F.length("block")).alias("end"), "block", F.sha2("block", 256).alias("block_hash"))


def heading_sections(blocks_: DataFrame) -> DataFrame:
    """Sections that start at headings (not at the first block, nor at the second if both are headings); one start or none: the whole text."""
    w = Window.partitionBy("doc_id")
    marked = blocks_.withColumn("heading", T.is_heading("block")).withColumn("both", F.count_if(F.col("heading") & (F.col("block_index") <= 2)).over(w) == 2)
    cut = F.col("heading") & (F.col("block_index") > 1) & ~((F.col("block_index") == 2) & F.col("both"))
    order = w.orderBy("block_index")
    marked = marked.withColumn("section", F.count_if(cut).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return marked.groupBy("doc_id", "section").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_blocks"))


def excerpt(content: Column, summary: Column, limit: int) -> tuple[Column, Column]:
    """The first readable of content and summary, truncated, and which it is."""
    source = F.when(T.is_readable(content), "content").when(T.is_readable(summary), "summary").otherwise("none")
    return F.when(source == "content", T.truncated(content, limit)).when(source == "summary", T.truncated(summary, limit)), source


def pack_messages(items: DataFrame, limit: int = 3900) -> DataFrame:
    """channel, message, n_items, n_chars: items in order go into messages of at most limit characters, two line breaks between.

    An item longer than limit goes on over several messages and counts in each. A greedy fold depends on all items before, so
    each channel is folded in one pass.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, used, n, message = [], 0, 0, 0
        for size in pdf.sort_values(["item"])["size"].tolist():
            size = int(size)
            if n and used + 2 + size > limit:
                rows.append((message, n, used))
                used, n, message = 0, 0, message + 1
            while size > limit:
                rows.append((message, 1, limit))
                size, message = size - limit, message + 1
            used += size + (2 if n else 0)
            n += 1
        if n:
            rows.append((message, n, used))
        out = pd.DataFrame(rows, columns=["message", "n_items", "n_chars"])
        out.insert(0, "channel", pdf["channel"].iloc[0])
        return out

    packaged()
    return items.groupBy("channel").applyInPandas(fold, "channel string, message long, n_items long, n_chars long")

"""Mentions and candidates: recognition, canonical forms, contexts, and the audits over them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as T

# Recogniser labels and the entity types they stand for; types that identify something; types that are values.
LABEL_TYPES = {
    "PERSON": "person", "PER": "person", "ORG": "organization", "GPE": "location", "LOC": "location", "NORP": "group",
    "FAC": "facility", "PRODUCT": "product", "EVENT": "event", "WORK_OF_ART": "work", "LAW": "law", "LANGUAGE": "language",
    "DATE": "date", "TIME": "time", "PERCENT": "percent", "MONEY": "money", "QUANTITY": "quantity", "ORDINAL": "ordinal",
    "CARDINAL": "cardinal",
}
OBSERVATION_TYPES = {
    "PERSON": "participant_mention", "PER": "participant_mention", "ORG": "participant_mention", "NORP": "participant_mention",
    "GPE": "place_mention", "LOC": "place_mention", "FAC": "place_mention", "DATE": "time_mention", "TIME": "time_mention",
    "EVENT": "event_mention",
}
IDENTIFIABLE = ("person", "organization", "location", "group", "facility", "product", "event", "work", "law", "language")
VALUES = ("date", "time", "percent", "money", "quantity", "ordinal", "cardinal")

SHAPES = "[A-Z][a-z]+(?: [A-Z][a-z]+)+|[A-Z]{2,}|[A-Z][a-z]{4,}|[0-9]+"


def mapped(label, table: dict[str, str], default=None):
    """table[label], by one literal map; default for what isn't in it."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, T.column(label)), F.lit(default))


def recognize_shapes(docs: DataFrame) -> DataFrame:
    """The default recogniser, by letter shapes: several capitalised words, all capitals, one long capitalised word, digits.

    It needs no model and claims none of a model's results. Offsets come from the gaps between matches.
    """
    rows = docs.select(
        "doc_id",
        "text",
        F.transform(F.split("text", SHAPES, -1), lambda g: F.length(g)).alias("gaps"),
        T.find_all("text", SHAPES).alias("found"),
    ).where(F.size("found") > 0)
    rows = rows.select("doc_id", F.posexplode(F.arrays_zip(F.slice("gaps", 1, F.size("found")).alias("gap"), F.col("found").alias("surface"))).alias("i", "m"))
    before = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("m.gap") + F.length("m.surface")).over(before).cast("int")
    surface = F.col("m.surface")
    label = F.when(surface.rlike("^[0-9]"), "CARDINAL").when(F.contains(surface, F.lit(" ")), "PERSON").when(surface.rlike("^[A-Z]{2}"), "ORG").otherwise("LOC")
    return rows.select("doc_id", "i", (end - F.length(surface)).alias("start"), end.alias("end"), label.alias("label"), surface.alias("surface"))


def mentions(docs: DataFrame, recognizer: Callable[[DataFrame], DataFrame] = recognize_shapes) -> DataFrame:
    """Mentions with entity type and normalised text, in text order. recognizer gives doc_id, start, end, label, surface."""
    found = recognizer(docs)
    return found.withColumn("entity_type", mapped("label", LABEL_TYPES, "other")).withColumn("normalized", T.casefold(T.squeeze("surface")))


def misplaced(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Mentions whose span isn't 0 <= start < end <= length or doesn't hold the surface text."""
    both = found.join(docs.select("doc_id", "text"), "doc_id")
    fits = (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.length("text"))
    return both.where(~(fits & (F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("surface")))).drop("text")


def candidates(found: DataFrame) -> DataFrame:
    """Each mention's decision: canonical text, or why it can't be a candidate."""
    kind = F.col("entity_type")
    reason = F.when(kind.isin(*IDENTIFIABLE), F.lit(None)).when(kind.isin(*VALUES), "value_or_temporal").otherwise("unsupported_type")
    return found.withColumn("exclusion_reason", reason).withColumn("canonical", F.when(reason.isNull(), T.casefold(T.squeeze("normalized"))))


def with_context(found: DataFrame, docs: DataFrame, width: int = 120) -> DataFrame:
    both = found.join(docs.select("doc_id", "text"), "doc_id")
    return both.withColumn("context_start", T.context_start("start", width)).withColumn("context", T.context("text", "start", "end", width)).drop("text")


def frequent_forms(found: DataFrame, form: str, limit: int) -> DataFrame:
    """Most frequent (type, form): mentions, distinct documents, sorted distinct spellings. Counted by document first."""
    by_doc = found.groupBy("entity_type", form, "doc_id").agg(F.count("*").alias("n"), F.collect_set("surface").alias("s"))
    whole = by_doc.groupBy("entity_type", form).agg(
        F.sum("n").alias("n"), F.count("*").alias("docs"), F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_set("s")))), "|").alias("variants")
    )
    return whole.orderBy(F.desc("n"), F.desc("docs"), "entity_type", form).limit(limit)


def densest_runs(runs: DataFrame, found: DataFrame, form: str, limit: int) -> DataFrame:
    """Runs by number of mentions, those without any included."""
    counted = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("entity_type", form).alias("forms"))
    return (
        runs.select("doc_id")
        .join(counted, "doc_id", "left")
        .select("doc_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("forms", F.lit(0)).alias("forms"))
        .orderBy(F.desc("n"), "doc_id")
        .limit(limit)
    )


def round_robin(found: DataFrame, limit: int, *order: str) -> DataFrame:
    """The first of each type, then the second of each, and so on, until limit."""
    turn = F.row_number().over(Window.partitionBy("entity_type").orderBy(*order))
    return found.withColumn("turn", turn).where(F.col("turn") <= limit).orderBy("turn", "entity_type").limit(limit)

"""Stores that only grow: get or create with conflicts told, records that hold together, decisions, subscribers, verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import numbers as N

from .registry import first_issue

# Statuses of alias decisions, the longest reviewer name, and the bytes a download may have.
ALIAS_STATUSES = ("approved", "rejected", "needs_review")
MAX_REVIEWER = 200
MAX_DOWNLOAD = 10 * 1024 * 1024
SUBSCRIBED, FORGOTTEN = ("register", "approve", "subscribe"), "forget"


def get_or_create(incoming: DataFrame, stored: DataFrame, key: str, *fields: str) -> DataFrame:
    """One row for each key that comes in: outcome (created, found or conflict) and the fields that differ.

    A key that comes in with several values, or with others than the stored ones, is a conflict; nothing is overwritten.
    """
    seen = incoming.groupBy(key).agg(*[F.min(f).alias(f) for f in fields], *[(F.min(f) != F.max(f)).alias(f"_{f}") for f in fields], F.count("*").alias("times"))
    old = stored.select(key, *[F.col(f).alias(f"old_{f}") for f in fields], F.lit(True).alias("_old"))
    joined = seen.join(old, key, "left")
    differs = [F.when(F.coalesce(F.col(f"_{f}"), F.lit(False)) | (F.col("_old") & ~F.col(f).eqNullSafe(F.col(f"old_{f}"))), F.lit(f)) for f in fields]
    joined = joined.withColumn("differs", F.concat_ws(",", *differs))
    outcome = F.when(F.col("differs") != "", "conflict").when(F.col("_old"), "found").otherwise("created")
    return joined.select(key, outcome.alias("outcome"), "differs", "times")


def append_new(stored: DataFrame, incoming: DataFrame, *key: str) -> DataFrame:
    """stored and the incoming rows whose key it lacks, one for each: running it again changes nothing."""
    fresh = incoming.dropDuplicates(list(key)).join(stored.select(*key), list(key), "left_anti")
    return stored.unionByName(fresh)


def active_endpoints(endpoints: DataFrame, events: DataFrame) -> DataFrame:
    """endpoint_id and is_active: a refused discovery (401, 403) turns an endpoint off, until it is turned on again.

    events: endpoint_id, at, event_id, code (of a discovery) or null (turned on).
    """
    means = F.when(F.col("code").isin(401, 403), F.lit(False)).when(F.col("code").isNull(), F.lit(True))
    last = events.withColumn("_on", means).where("_on is not null").groupBy("endpoint_id").agg(F.max_by("_on", F.struct("at", "event_id")).alias("_on"))
    return endpoints.select("endpoint_id").join(last, "endpoint_id", "left").select("endpoint_id", F.coalesce("_on", F.lit(True)).alias("is_active"))


def record_issues(records: DataFrame) -> DataFrame:
    """Retrieval records with their first issue. records: record_id, locator, at, outcome, content, error."""
    blank = lambda c: ~F.coalesce(F.col(c).rlike("\\S"), F.lit(False))
    issue = first_issue(
        [
            ("blank_locator", blank("locator")),
            ("no_time", F.col("at").isNull()),
            ("succeeded_without_content", (F.col("outcome") == "succeeded") & F.col("content").isNull()),
            ("content_without_success", (F.col("outcome") != "succeeded") & F.col("content").isNotNull()),
            ("failed_without_error", (F.col("outcome") != "succeeded") & blank("error")),
            ("error_on_success", (F.col("outcome") == "succeeded") & F.col("error").isNotNull()),
        ]
    )
    return records.select("record_id", issue.alias("issue"))


def retrieval_issues(records: DataFrame, candidates: DataFrame, blobs: DataFrame) -> DataFrame:
    """record_id and the first way in which a stored retrieval doesn't match its candidate or its bytes.

    records: record_id, candidate_id, fingerprint, blob. candidates: candidate_id, fingerprint. blobs: blob, sha256, content.
    """
    c = candidates.select("candidate_id", F.col("fingerprint").alias("_f"))
    b = blobs.select("blob", "sha256", F.sha2("content", 256).alias("_h"))
    joined = records.join(c, "candidate_id", "left").join(b, "blob", "left")
    issue = first_issue(
        [
            ("candidate_missing", F.col("_f").isNull()),
            ("fingerprint_differs", F.col("_f") != F.col("fingerprint")),
            ("blob_missing", F.col("blob").isNotNull() & F.col("_h").isNull()),
            ("blob_corrupt", F.col("_h") != F.col("sha256")),
        ]
    )
    return joined.select("record_id", issue.alias("issue"))


def acquired(candidates: DataFrame, primary: Column, fallback: Column, media_type: Column) -> DataFrame:
    """candidate_id, status and text of retrieve, gate, extract: pages that aren't HTML or text fail, a blank main text falls back."""
    holds = lambda x: F.coalesce(x.rlike("\\S"), F.lit(False))
    fits = F.lower(F.trim(F.substring_index(media_type, ";", 1))).isin("text/html", "application/xhtml+xml", "text/plain")
    status = F.when(~F.coalesce(fits, F.lit(False)), "unsupported_media_type").when(holds(primary), "extracted").when(holds(fallback), "extracted_by_fallback").otherwise("no_text")
    text = F.when(status == "extracted", primary).when(status == "extracted_by_fallback", fallback)
    return candidates.select("candidate_id", status.alias("status"), text.alias("text"))


def capped(content: Column, limit: int = MAX_DOWNLOAD) -> Column:
    """Whether a download stays within the limit; one that doesn't is refused as a whole, never cut."""
    return F.octet_length(content) <= limit


def decision_issues(decisions: DataFrame) -> DataFrame:
    """Alias decisions with the first reason to refuse them. decisions: decision_id, status, reason, reviewer."""
    issue = first_issue(
        [
            ("unknown_status", ~F.coalesce(F.col("status").isin(*ALIAS_STATUSES), F.lit(False))),
            ("blank_reason", ~F.coalesce(F.col("reason").rlike("\\S"), F.lit(False))),
            ("blank_reviewer", ~F.coalesce(F.col("reviewer").rlike("\\S"), F.lit(False))),
            ("reviewer_too_long", F.length("reviewer") > MAX_REVIEWER),
        ]
    )
    return decisions.select("decision_id", issue.alias("issue"))


def resolved(proposals: DataFrame, decisions: DataFrame, assigned: DataFrame, applied: DataFrame) -> DataFrame:
    """What resolving each alias proposal does: proposal_id, action and the entity it goes to.

    proposals: proposal_id, left_id, right_id, canonical (of the left one, or null). decisions: proposal_id, decision_id, revision,
    status. assigned: candidate_id, entity_id. applied: decision_id. The latest decision must be approved; one that is applied
    already changes nothing; candidates of two entities can't be joined; a new entity needs a canonical name.
    """
    back = Window.partitionBy("proposal_id").orderBy(F.desc("revision"), F.desc("decision_id"))
    last = decisions.withColumn("_r", F.row_number().over(back)).where("_r = 1").select("proposal_id", "decision_id", "status")
    done = applied.select("decision_id").distinct().withColumn("_done", F.lit(True))
    of = lambda side: assigned.select(F.col("candidate_id").alias(f"{side}_id"), F.col("entity_id").alias(f"{side}_entity"))
    joined = proposals.join(last, "proposal_id", "left").join(done, "decision_id", "left").join(of("left"), "left_id", "left").join(of("right"), "right_id", "left")
    entity = F.coalesce("left_entity", "right_entity")
    action = (
        F.when(F.col("status").isNull(), "undecided").when(F.col("status") != "approved", "not_approved").when(F.col("_done"), "unchanged").when(F.col("left_entity") != F.col("right_entity"), "conflict")
        .when(entity.isNotNull(), "joined").when(F.coalesce(F.col("canonical").rlike("\\S"), F.lit(False)), "created").otherwise("no_canonical_name")
    )
    joined = joined.withColumn("action", action)
    return joined.select("proposal_id", "action", F.when(F.col("action").isin("joined", "unchanged"), entity).alias("entity_id"))


def subscribers(log: DataFrame) -> DataFrame:
    """chat_id, approved and subscribed, folded from commands (chat_id, at, event_id, command); who is to be forgotten has no row.

    After `forget` nothing before it counts. To subscribe takes an approval; unsubscribing keeps it.
    """
    when = F.struct("at", "event_id")
    last = Window.partitionBy("chat_id")
    kept = log.withColumn("_f", F.max(F.when(F.col("command") == FORGOTTEN, when)).over(last)).where(F.col("_f").isNull() | (when > F.col("_f")))
    at = lambda *names: F.max(F.when(F.col("command").isin(*names), when))
    by = kept.groupBy("chat_id").agg(at("approve").alias("a"), at("subscribe").alias("s"), at("unsubscribe").alias("u"))
    approved = F.col("a").isNotNull()
    on = approved & F.col("s").isNotNull() & (F.col("u").isNull() | (F.col("s") > F.col("u")))
    return by.select("chat_id", approved.alias("approved"), on.alias("subscribed"))


def verified(built: DataFrame, again: DataFrame, key: str, *fields: str) -> DataFrame:
    """Rows by which a corpus and the same corpus built again differ: only_built, only_rebuilt or differs, with the fields."""
    digest = lambda: N.sha256(F.concat_ws("\x1f", *[F.coalesce(F.col(f).cast("string"), F.lit("\0")) for f in fields]))
    a = built.select(key, digest().alias("_a"))
    b = again.select(key, digest().alias("_b"))
    joined = a.join(b, key, "full")
    kind = F.when(F.col("_b").isNull(), "only_built").when(F.col("_a").isNull(), "only_rebuilt").when(F.col("_a") != F.col("_b"), "differs")
    return joined.select(key, kind.alias("difference")).where("difference is not null")


def intake_issues(records: DataFrame, prompts: DataFrame, sources: DataFrame) -> DataFrame:
    """record_id and the first issue of a corpus record. records: record_id, source_id, label, prompt_id, prompt_sha256, text,
    text_sha256. prompts: prompt_id, text. sources: source_id, label."""
    p = prompts.select("prompt_id", F.sha2("text", 256).alias("_p"))
    s = sources.select("source_id", F.col("label").alias("_l"))
    joined = records.join(p, "prompt_id", "left").join(s, "source_id", "left")
    issue = first_issue(
        [
            ("bad_source_id", ~F.coalesce(F.col("source_id").rlike("^[a-z0-9][a-z0-9._-]{0,99}$"), F.lit(False))),
            ("source_missing", F.col("_l").isNull()),
            ("label_differs", F.col("_l") != F.col("label")),
            ("text_hash_differs", ~F.sha2("text", 256).eqNullSafe(F.col("text_sha256"))),
            ("synthetic_without_prompt", (F.col("label") == "synthetic") & F.col("prompt_id").isNull()),
            ("prompt_on_human", (F.col("label") == "human") & F.col("prompt_id").isNotNull()),
            ("prompt_missing", F.col("prompt_id").isNotNull() & F.col("_p").isNull()),
            ("prompt_hash_differs", F.col("_p") != F.col("prompt_sha256")),
        ]
    )
    return joined.select("record_id", issue.alias("issue"))

"""Entity registry: link validity, entity safety, not-entity decisions, coverage, readiness, the resolution queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COVERAGE = ("safe", "blocked", "not_entity", "unassigned", "invalid")
READINESS = ("invalid", "blocked", "incomplete", "no_candidates", "ready")


def first_issue(checks: list[tuple[str, Column]]) -> Column:
    """The first check that fails, in the given order, or null."""
    return F.coalesce(*[F.when(F.coalesce(failed, F.lit(False)), F.lit(name)) for name, failed in checks])


def link_validity(links: DataFrame, decisions: DataFrame, applied: str) -> DataFrame:
    """Each link's validity by the latest decision on its proposal: revoked, needs_review, active or pending_reapplication.

    links: entity_id, proposal_id and the id of the decision they applied. decisions: proposal_id, decision_id, revision, status.
    """
    rank = F.row_number().over(Window.partitionBy("proposal_id").orderBy(F.desc("revision"), F.desc("decision_id")))
    last = decisions.withColumn("_r", rank).where("_r = 1").select("proposal_id", F.col("decision_id").alias("latest_id"), F.col("status").alias("latest_status"))
    joined = links.join(last, "proposal_id", "left")
    validity = (
        F.when(F.col("latest_status").isNull() | (F.col("latest_status") == "rejected"), "revoked")
        .when(F.col("latest_status") == "needs_review", "needs_review")
        .when(F.col("latest_id") == F.col(applied), "active")
        .otherwise("pending_reapplication")
    )
    return joined.withColumn("validity", validity)


def entity_safety(entities: DataFrame, links: DataFrame) -> DataFrame:
    """Safe: at least one link, and every link active. Blocking validities are listed in alphabetical order."""
    by = links.groupBy("entity_id").agg(
        F.count("*").alias("n_links"),
        F.every(F.col("validity") == "active").alias("all_active"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("validity") != "active", F.col("validity")))), ",").alias("blocking"),
    )
    joined = entities.select("entity_id").join(by, "entity_id", "left")
    return joined.select("entity_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("all_active", F.lit(False)).alias("safe"), F.coalesce("blocking", F.lit("")).alias("blocking"))


def not_entity_validity(decisions: DataFrame) -> DataFrame:
    """seed_id's latest decision judged: active, revoked (after a not_entity one) or invalid, with the first issue.

    decisions: seed_id, decision_id, revision, status, scope, entity_id, reason.
    """
    w = Window.partitionBy("seed_id").orderBy("revision", "decision_id")
    ranked = decisions.withColumn("previous", F.lag("status").over(w)).withColumn("first_scope", F.first("scope").over(w)).withColumn("n", F.row_number().over(w))
    last = ranked.withColumn("_r", F.row_number().over(Window.partitionBy("seed_id").orderBy(F.desc("revision"), F.desc("decision_id")))).where("_r = 1")
    about = (F.col("status") == "not_entity") | ((F.col("status") == "revoked") & (F.col("previous") == "not_entity"))
    issue = first_issue(
        [
            ("revision_gap", F.col("revision") != F.col("n")),
            ("scope_changed", F.col("scope") != F.col("first_scope")),
            ("entity_on_not_entity", (F.col("status") == "not_entity") & F.col("entity_id").isNotNull()),
            ("blank_reason", F.trim(F.coalesce("reason", F.lit(""))) == ""),
        ]
    )
    judged = last.where(about).withColumn("issue", issue)
    validity = F.when(F.col("issue").isNotNull(), "invalid").when(F.col("status") == "revoked", "revoked").otherwise("active")
    return judged.select("seed_id", "decision_id", "status", validity.alias("validity"), "issue")


def coverage(candidates: DataFrame, safety: DataFrame, not_entities: DataFrame) -> DataFrame:
    """Each candidate's status. candidates: candidate_id, document_id, entity_id (or null).

    An invalid not-entity decision, or an active one on an assigned candidate, is invalid; then not_entity, unassigned, safe, blocked.
    """
    exclusions = not_entities.select(F.col("seed_id").alias("candidate_id"), F.col("validity").alias("not_entity"))
    joined = candidates.join(exclusions, "candidate_id", "left").join(safety.select("entity_id", "safe"), "entity_id", "left")
    status = (
        F.when(F.col("not_entity") == "invalid", "invalid")
        .when((F.col("not_entity") == "active") & F.col("entity_id").isNotNull(), "invalid")
        .when(F.col("not_entity") == "active", "not_entity")
        .when(F.col("entity_id").isNull(), "unassigned")
        .when(F.coalesce("safe", F.lit(False)), "safe")
        .otherwise("blocked")
    )
    return joined.withColumn("status", status)


def readiness(documents: DataFrame, covered: DataFrame) -> DataFrame:
    """Each document's counts of all statuses and its readiness: invalid > blocked > incomplete > no_candidates > ready."""
    by = covered.groupBy("document_id").agg(F.count("*").alias("candidates"), *[F.count_if(F.col("status") == s).alias(s) for s in COVERAGE])
    joined = documents.select("document_id").join(by, "document_id", "left").na.fill(0)
    status = (
        F.when(F.col("invalid") > 0, "invalid")
        .when(F.col("blocked") > 0, "blocked")
        .when(F.col("unassigned") > 0, "incomplete")
        .when(F.col("candidates") == 0, "no_candidates")
        .otherwise("ready")
    )
    return joined.withColumn("readiness", status)


def queue_groups(covered: DataFrame, contexts: int = 3) -> DataFrame:
    """Groups of equal (type, text) that need a decision: counts, smallest seed, spellings and the first contexts, in order of work.

    covered: candidate_id, document_id, entity_type, canonical, surface, status.
    """
    rank = F.row_number().over(Window.partitionBy("entity_type", "canonical").orderBy("candidate_id"))
    by = (
        covered.withColumn("_r", rank)
        .groupBy("entity_type", "canonical")
        .agg(
            F.min("candidate_id").alias("seed"),
            F.count("*").alias("n"),
            F.count_distinct("document_id").alias("documents"),
            F.count_if(F.col("status") == "unassigned").alias("unassigned"),
            F.count_if(F.col("status") == "invalid").alias("invalid"),
            F.count_if(F.col("status") == "not_entity").alias("not_entity"),
            F.array_join(F.sort_array(F.collect_set("surface")), "|").alias("variants"),
            F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("_r") <= contexts, F.struct("_r", "document_id")))), lambda x: x["document_id"].cast("string")), ",").alias("first_documents"),
        )
        .where("unassigned > 0")
    )
    state = F.when(F.col("invalid") > 0, "conflict").when(F.col("not_entity") > 0, "partly_excluded").when(F.col("unassigned") < F.col("n"), "partly_assigned").otherwise("open")
    return by.withColumn("scope_state", state).orderBy(F.col("invalid") > 0, F.desc("unassigned"), "entity_type", "canonical", "seed")


def next_document(ready: DataFrame) -> DataFrame:
    """The one document to work on next: no blockers first, then the fewest problems, unassigned and candidates."""
    open_ = ready.where("unassigned > 0")
    blockers = F.col("blocked") + F.col("invalid")
    return open_.orderBy(blockers > 0, blockers, "unassigned", "candidates", "document_id").limit(1)

"""Provenance: from a candidate over its mention to the text, transcripts to what they came from, exclusions, full coverage.

A chain is a series of left joins; the first check that fails, in a fixed order, is its issue. Nothing is hidden: a broken
chain keeps its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.shipping import checkpointed

from .registry import first_issue

# The kinds of artifact that hold text, and the order in which validities are told.
TEXT_TYPES = ("extracted_text", "ocr_text", "transcript", "translation")
VALIDITIES = ("active", "pending_reapplication", "needs_review", "revoked", "missing_provenance")
COVERAGE_CHECKS = ("missing_entity", "entity_type_differs", "provenance", "excluded_without_decision", "invalid_decision", "excluded_and_assigned", "unknown_entity")


def text_artifacts(artifacts: DataFrame, *types: str) -> DataFrame:
    """Artifacts of the given kinds, of all that hold text by default."""
    return artifacts.where(F.col("artifact_type").isin(*(types or TEXT_TYPES)))


def only_text_artifact(artifacts: DataFrame) -> DataFrame:
    """version_id, its one text artifact and its issue (none, or several with their ids, in order)."""
    by = text_artifacts(artifacts).groupBy("version_id").agg(F.count("*").alias("n"), F.min("artifact_id").alias("artifact_id"), F.sort_array(F.collect_set("artifact_id")).alias("ids"))
    versions = artifacts.select("version_id").distinct().join(by, "version_id", "left")
    issue = F.when(F.coalesce("n", F.lit(0)) == 0, "none").when(F.col("n") > 1, F.concat(F.lit("several:"), F.array_join(F.transform("ids", lambda x: x.cast("string")), ",")))
    return versions.select("version_id", F.when(F.col("n") == 1, F.col("artifact_id")).alias("artifact_id"), issue.alias("issue"))


def only_method(fragments: DataFrame) -> DataFrame:
    """version_id and its one (method, method_version), or the issue that there are several."""
    by = fragments.select("version_id", "method", "method_version").distinct().groupBy("version_id").agg(
        F.count("*").alias("n"), F.min(F.struct("method", "method_version")).alias("m")
    )
    one = F.col("n") == 1
    return by.select("version_id", F.when(one, F.col("m.method")).alias("method"), F.when(one, F.col("m.method_version")).alias("method_version"), F.when(~one, "several_methods").alias("issue"))


def order_violations(observations: DataFrame) -> DataFrame:
    """Observations that start before the one listed before them, or share their origin with another. observations: group_id,
    position, start, end, origin."""
    w = Window.partitionBy("group_id").orderBy("position")
    rows = observations.withColumn("_s", F.lag("start").over(w)).withColumn("_e", F.lag("end").over(w)).withColumn("_n", F.count("*").over(Window.partitionBy("group_id", "origin")))
    late = (F.col("start") < F.col("_s")) | ((F.col("start") == F.col("_s")) & (F.col("end") < F.col("_e")))
    issue = first_issue([("out_of_order", late), ("duplicate_origin", F.col("_n") > 1)])
    return rows.withColumn("issue", issue).where("issue is not null").select("group_id", "position", "issue")


def _named(artifacts: DataFrame, prefix: str, *extra: str) -> DataFrame:
    columns = ("artifact_id", "version_id", "artifact_type", "content_hash", "input_artifact_id", "input_content_hash", *extra)
    return artifacts.select(*[F.col(c).alias(f"{prefix}_{c}") for c in columns])


def candidate_issues(candidates: DataFrame, mentions: DataFrame, artifacts: DataFrame) -> DataFrame:
    """candidates with text_artifact_id and issue: the first of 20 checks of its chain that fails, null if all hold.

    candidates: candidate_id, version_id, mention_id, artifact_id, entity_type. mentions: mention_id, version_id, artifact_id,
    entity_type, surface, start, end. artifacts: artifact_id, version_id, artifact_type, content_hash, input_artifact_id,
    input_content_hash, text.
    """
    m = mentions.select(*[F.col(c).alias(f"m_{c}") for c in ("mention_id", "version_id", "artifact_id", "entity_type", "surface", "start", "end")])
    joined = (
        candidates.join(m, F.col("mention_id") == F.col("m_mention_id"), "left")
        .join(_named(artifacts, "ca"), F.col("artifact_id") == F.col("ca_artifact_id"), "left")
        .join(_named(artifacts, "ma"), F.col("m_artifact_id") == F.col("ma_artifact_id"), "left")
        .join(_named(artifacts, "ta", "text"), F.col("ma_input_artifact_id") == F.col("ta_artifact_id"), "left")
    )
    own, text = F.col("version_id"), F.col("ta_text")

    def referred(output: str, input_: str) -> list[tuple[str, Column]]:
        name = {"ca": "candidate", "ma": "mention"}[output]
        return [
            (f"{name}_artifact_has_another_input", ~F.col(f"{output}_input_artifact_id").eqNullSafe(F.col(f"{input_}_artifact_id"))),
            (f"{name}_artifact_input_hash_differs", ~F.col(f"{output}_input_content_hash").eqNullSafe(F.col(f"{input_}_content_hash"))),
        ]

    issue = first_issue(
        [
            ("mention_missing", F.col("m_mention_id").isNull()),
            ("mention_of_another_version", F.col("m_version_id") != own),
            ("mention_type_differs", F.col("m_entity_type") != F.col("entity_type")),
            ("candidate_artifact_missing", F.col("ca_artifact_id").isNull()),
            ("candidate_artifact_type", F.col("ca_artifact_type") != "entity_candidates"),
            ("candidate_artifact_of_another_version", F.col("ca_version_id") != own),
            ("mention_artifact_missing", F.col("ma_artifact_id").isNull()),
            ("mention_artifact_type", F.col("ma_artifact_type") != "entity_mentions"),
            ("mention_artifact_of_another_version", F.col("ma_version_id") != own),
            *referred("ca", "ma"),
            ("text_input_not_named", F.col("ma_input_artifact_id").isNull()),
            ("text_input_missing", F.col("ta_artifact_id").isNull()),
            ("text_input_type", ~F.col("ta_artifact_type").isin(*TEXT_TYPES)),
            ("text_input_of_another_version", F.col("ta_version_id") != own),
            *referred("ma", "ta"),
            ("text_unusable", text.isNull() | ~text.rlike("\\S")),
            ("span_beyond_text", F.col("m_end") > F.length(text)),
            ("span_differs", F.substr(text, F.col("m_start") + 1, F.col("m_end") - F.col("m_start")) != F.col("m_surface")),
        ]
    )
    return joined.select(*candidates.columns, F.col("ta_artifact_id").alias("text_artifact_id"), issue.alias("issue"))


def transcript_issues(transcripts: DataFrame, acquisitions: DataFrame, raw: DataFrame) -> DataFrame:
    """artifact_id and the first of 8 checks that fails. transcripts: artifact_id, version_id, acquisition_id, raw_id,
    hash_algorithm, content_hash, language, kind, format, has_source. acquisitions: acquisition_id, version_id, raw_id, language,
    kind, format. raw: raw_id, hash_algorithm, content_hash."""
    a = acquisitions.select(*[F.col(c).alias(f"a_{c}") for c in ("acquisition_id", "version_id", "raw_id", "language", "kind", "format")])
    r = raw.select(*[F.col(c).alias(f"r_{c}") for c in ("raw_id", "hash_algorithm", "content_hash")])
    joined = transcripts.join(a, F.col("acquisition_id") == F.col("a_acquisition_id"), "left").join(r, F.col("raw_id") == F.col("r_raw_id"), "left")
    differs = lambda x, y: ~F.col(x).eqNullSafe(F.col(y))
    issue = first_issue(
        [
            ("no_source", ~F.col("has_source")),
            ("bad_identifiers", F.coalesce(F.col("acquisition_id") < 1, F.lit(True)) | F.coalesce(F.col("raw_id") < 1, F.lit(True))),
            ("records_missing", F.col("a_acquisition_id").isNull() | F.col("r_raw_id").isNull()),
            ("acquisition_of_another_version", differs("version_id", "a_version_id")),
            ("acquisition_of_another_raw", differs("a_raw_id", "r_raw_id")),
            ("digest_differs", differs("hash_algorithm", "r_hash_algorithm") | differs("content_hash", "r_content_hash")),
            ("language_differs", differs("language", "a_language")),
            ("kind_or_format_differs", differs("kind", "a_kind") | differs("format", "a_format")),
        ]
    )
    return joined.select("artifact_id", issue.alias("issue"))


def exclusion_audit(decisions: DataFrame, exclusions: DataFrame, candidates: DataFrame, assigned: DataFrame) -> DataFrame:
    """The latest decision of each seed that excludes candidates, or takes such a one back, with validity and first issue.

    decisions: seed_id, decision_id, revision, status, scope, entity_id. exclusions: decision_id, candidate_id. candidates:
    candidate_id, entity_type, canonical, chain_issue. assigned: candidate_id.

    Checks of a decision as a whole come first, then those of its candidates, by candidate. Of decisions that cover the same
    candidate the smallest seed whose decision is valid claims it: claims are settled in rounds, as a decision that is invalid
    for another reason claims nothing. A round settles at least the smallest open seed of every chain of shared candidates.
    """
    back = Window.partitionBy("seed_id").orderBy(F.desc("revision"), F.desc("decision_id"))
    ranked = decisions.withColumn("_r", F.row_number().over(back)).withColumn("_before", F.lead(F.struct("decision_id", "status", "scope", "entity_id")).over(back)).where("_r = 1")
    taken_back = (F.col("status") == "revoked") & (F.col("_before.status") == "not_entity")
    now = F.struct("decision_id", "status", "scope", "entity_id")
    relevant = ranked.where((F.col("status") == "not_entity") | taken_back).select(
        "seed_id", F.col("decision_id").alias("latest_id"), F.col("status").alias("latest_status"), F.col("entity_id").alias("latest_entity"), F.when(taken_back, F.col("_before")).otherwise(now).alias("applied")
    )
    held = relevant.select(F.col("applied.decision_id").alias("decision_id"), "seed_id", F.col("applied.scope").alias("scope")).join(exclusions, "decision_id")
    seeds = candidates.select(F.col("candidate_id").alias("seed_id"), F.col("entity_type").alias("s_type"), F.col("canonical").alias("s_canonical"))
    rows = held.join(seeds, "seed_id", "left").join(candidates, "candidate_id", "left").join(assigned.select("candidate_id").distinct().withColumn("_assigned", F.lit(True)), "candidate_id", "left")
    size = F.count("*").over(Window.partitionBy("seed_id"))
    one = first_issue(
        [
            ("candidate_missing", F.col("entity_type").isNull()),
            ("single_covers_another", (F.col("scope") == "single") & ((F.col("candidate_id") != F.col("seed_id")) | (size > 1))),
            ("differs_from_seed", (F.col("scope") != "single") & ((F.col("entity_type") != F.col("s_type")) | ~F.col("canonical").eqNullSafe(F.col("s_canonical")))),
            ("also_assigned", F.col("_assigned")),
            ("provenance", F.col("chain_issue").isNotNull()),
        ]
    )
    by = rows.withColumn("_one", one).groupBy("seed_id").agg(
        F.count("*").alias("n"), F.count_distinct("candidate_id").alias("distinct"), F.max(F.col("candidate_id") == F.col("seed_id")).alias("has_seed"),
        F.min(F.when(F.col("_one").isNotNull(), F.struct("candidate_id", "_one"))).alias("first"),
    )
    whole = relevant.join(by, "seed_id", "left").join(seeds, "seed_id", "left")
    head = first_issue(
        [
            ("seed_missing", F.col("s_type").isNull()),
            ("entity_on_exclusion", F.col("applied.entity_id").isNotNull() | F.col("latest_entity").isNotNull()),
            ("seed_not_covered", ~F.coalesce("has_seed", F.lit(False))),
            ("repeated_candidate", F.col("n") > F.col("distinct")),
        ]
    )
    told = whole.select("seed_id", "latest_id", "latest_status", F.col("applied.decision_id").alias("applied_id"), head.alias("_head"), F.col("first._one").alias("_first"))
    sound = told.where("latest_status = 'not_entity' and _head is null and _first is null").select("seed_id")
    covered = held.select("seed_id", "candidate_id").distinct()
    contested = covered.join(sound, "seed_id", "left_semi")
    claims = settled(contested)
    lost = covered.join(claims, "candidate_id").where("claimant < seed_id").select("seed_id").distinct().withColumn("_lost", F.lit(True))
    issue = F.coalesce("_head", F.when(F.col("_lost"), "covered_twice"), "_first")
    validity = F.when(F.col("latest_status") == "revoked", "revoked").when(F.col("issue").isNotNull(), "invalid").otherwise("active")
    return told.join(lost, "seed_id", "left").withColumn("issue", issue).select("seed_id", "latest_id", "applied_id", validity.alias("validity"), "issue")


def settled(contested: DataFrame) -> DataFrame:
    """candidate_id, claimant: claims in order of seed, where a seed that meets a claimed candidate claims none of its own.

    contested: seed_id, candidate_id. Each round decides the seeds of which every candidate's smallest open seed they are; those
    that meet one of theirs drop out.
    """
    open_, claims = contested, None
    while not open_.isEmpty():
        least = open_.groupBy("candidate_id").agg(F.min("seed_id").alias("low"))
        by = open_.join(least, "candidate_id").groupBy("seed_id").agg(F.every(F.col("low") == F.col("seed_id")).alias("wins"))
        won = checkpointed(open_.join(by.where("wins").select("seed_id"), "seed_id", "left_semi"))
        part = won.select("candidate_id", F.col("seed_id").alias("claimant"))
        claims = part if claims is None else claims.unionByName(part)
        out = open_.join(part.select("candidate_id"), "candidate_id", "left_semi").select("seed_id").distinct()
        open_ = checkpointed(open_.join(out, "seed_id", "left_anti"))
    return claims if claims is not None else contested.select("candidate_id", F.col("seed_id").alias("claimant"))


def entity_blocking(alias_links: DataFrame, candidate_links: DataFrame) -> DataFrame:
    """entity_id, links, safe and blocking: the validities other than active of links of both kinds, in the order of VALIDITIES."""
    both = alias_links.select("entity_id", "validity").unionByName(candidate_links.select("entity_id", "validity"))
    by = both.groupBy("entity_id").agg(F.count("*").alias("links"), F.collect_set("validity").alias("_v"))
    blocking = F.filter(F.array(*[F.lit(v) for v in VALIDITIES[1:]]), lambda v: F.array_contains("_v", v))
    return by.select("entity_id", "links", (F.size(blocking) == 0).alias("safe"), F.array_join(blocking, ",").alias("blocking"))


def covered(candidates: DataFrame, entities: DataFrame, blocking: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Each candidate's status and, where it is invalid, why.

    candidates: candidate_id, entity_type, entity_id (assigned, or null), chain_issue, excluded (named by an invalid exclusion).
    entities: entity_id, entity_type. blocking: of `entity_blocking`. exclusions: candidate_id, validity of its current decision.
    """
    e = entities.select(F.col("entity_id").alias("e_id"), F.col("entity_type").alias("e_type"))
    b = blocking.select(F.col("entity_id").alias("b_id"), "safe")
    x = exclusions.select("candidate_id", F.col("validity").alias("x"))
    joined = candidates.join(e, F.col("entity_id") == F.col("e_id"), "left").join(b, F.col("entity_id") == F.col("b_id"), "left").join(x, "candidate_id", "left")
    assigned = F.col("entity_id").isNotNull()
    chain = F.when(assigned & F.col("e_id").isNull(), "missing_entity").when(F.col("e_type") != F.col("entity_type"), "entity_type_differs").when(F.col("chain_issue").isNotNull(), "provenance")
    issue = (
        F.when(F.col("excluded") & F.col("x").isNull(), "excluded_without_decision")
        .when(F.col("x") == "invalid", "invalid_decision")
        .when(F.col("x").isNotNull() & assigned, "excluded_and_assigned")
        .when(chain.isNotNull(), chain)
        .when(F.col("x").isNull() & assigned & F.col("safe").isNull(), "unknown_entity")
    )
    status = (
        F.when(issue.isNotNull(), "invalid_provenance").when(F.col("x").isNotNull(), "not_entity").when(~assigned, "unassigned").when(F.col("safe"), "safe_resolved").otherwise("blocked")
    )
    return joined.select("candidate_id", status.alias("status"), issue.alias("issue"))


def multiset_difference(a: DataFrame, b: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more often in one than in the other, with both counts; no rows if they are equal as multisets."""
    one = a.groupBy(*key).agg(F.count("*").alias("in_a"))
    two = b.groupBy(*key).agg(F.count("*").alias("in_b"))
    both = one.join(two, list(key), "full").na.fill(0, ["in_a", "in_b"])
    return both.where("in_a <> in_b")


def same_text(candidates: DataFrame) -> DataFrame:
    """document_id, candidates, texts, text_artifact_id and issue: all of a document's candidates must rest on one text.

    candidates: document_id, text_artifact_id, issue of the chain.
    """
    by = candidates.groupBy("document_id").agg(
        F.count("*").alias("candidates"), F.count_distinct("text_artifact_id").alias("texts"), F.min("text_artifact_id").alias("t"), F.count_if(F.col("issue").isNotNull()).alias("broken")
    )
    issue = first_issue([("broken_provenance", F.col("broken") > 0), ("several_texts", F.col("texts") > 1)])
    return by.select("document_id", "candidates", "texts", F.when(issue.isNull(), F.col("t")).alias("text_artifact_id"), issue.alias("issue"))

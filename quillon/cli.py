"""Commands over tables in a folder: python -m quillon.cli COMMAND --tables DIR [--limit N]. Each prints a query's rows as JSON lines."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from quillon.plans import catalog

#: Command and the query that answers it over the tables of the folder; every query's own name is a command as well.
COMMANDS = {
    "collect": "source_get_or_create", "acquire": "acquire_and_extract", "acquisition-status": "acquisition_state_summary", "parse": "html_main_text", "latest-news": "news_feed_nulls_last",
    "analyze": "lexicon_marker_counts", "extract-mentions": "mention_audit_by_type", "generate-candidates": "candidate_canonicalisation", "propose-aliases": "alias_proposals_per_document",
    "mention-audit": "mention_provenance_join", "candidate-audit": "candidate_provenance_join", "alias-proposal-audit": "alias_confidence_bands", "alias-review-queue": "alias_review_queue",
    "decide-alias": "alias_decision_issues", "resolve-alias": "alias_resolution", "resolve-candidate": "candidate_exclusion_audit", "candidate-resolution-queue": "resolution_queue_groups",
    "entity-registry-audit": "entity_blocking_validities", "safe-entities": "safe_entity_projection", "document-entity-coverage": "coverage_with_issues", "document-entity-readiness": "readiness_status",
    "corpus-entity-readiness": "corpus_readiness", "ready-document-versions": "ready_selection", "document-analysis-input": "analysis_input_texts", "compare-document-event-similarity": "pair_similarity_combined",
    "youtube-transcript-tracks": "transcript_tracks", "ingest-transcript": "transcript_fold", "inspect-document-text": "line_blocks_with_offsets", "inspect-transcript-timeline": "transcript_timeline_counts",
    "segment-event-fragments": "heading_sections", "extract-event-observations": "fragment_exclusions", "profile-event-fragments": "fragment_profiles", "compare-event-fragments": "fragment_pairs_status",
    "propose-event-fragment-clusters": "fragment_cliques", "review-event-fragment-clusters": "cluster_review_status", "prepare-analysis": "candidate_fingerprint", "execute-analysis": "synthetic_structural_score",
    "analysis-evidence": "evidence_verification", "analysis-attempts": "run_claims", "recover-analysis": "stale_runs", "inspect-synthetic-corpus-intake": "corpus_intake_issues", "build-synthetic-corpus": "hash_split_assignment",
    "verify-synthetic-corpus-build": "corpus_verification", "validate-synthetic-corpus": "exact_duplicate_groups", "calibrate-synthetic-origin": "calibrated_threshold", "evaluate-synthetic-origin": "sliced_metrics",
    "telegram-bot": "subscriber_states",
}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quillon", description=__doc__)
    parser.add_argument("command", choices=sorted({*COMMANDS, *catalog.QUERIES}))
    parser.add_argument("--tables", required=True)
    parser.add_argument("--limit", type=int, default=20)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("quillon").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    rows = catalog.QUERIES[COMMANDS.get(args.command, args.command)](spark, args.tables)
    for line in rows.limit(args.limit).toJSON().collect():
        print(line)


if __name__ == "__main__":
    main()

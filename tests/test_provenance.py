"""Exclusion claims and provenance chains against plain loops."""

from __future__ import annotations

import random

from quillon.operators import provenance as P


def test_claims_settle_in_order_of_seed(spark):
    rng = random.Random(2)
    rows = sorted({(s, rng.randrange(40)) for s in range(30) for _ in range(rng.randint(1, 3))})
    taken: dict[int, int] = {}
    for seed in sorted({s for s, _ in rows}):
        own = [c for s, c in rows if s == seed]
        if not any(c in taken for c in own):
            taken |= dict.fromkeys(own, seed)
    got = P.settled(spark.createDataFrame(rows, "seed_id long, candidate_id long"))
    assert {r.candidate_id: r.claimant for r in got.collect()} == taken


def test_exclusion_audit(spark):
    decisions = [
        (1, 10, 1, "not_entity", "exact", None), (2, 20, 1, "not_entity", "single", None), (3, 30, 1, "not_entity", "exact", None), (4, 40, 1, "not_entity", "single", 9), (5, 50, 1, "not_entity", "single", None),
        (6, 60, 1, "not_entity", "single", None), (6, 61, 2, "revoked", "single", None), (7, 70, 1, "assigned", "single", 3), (8, 80, 1, "not_entity", "single", None), (9, 90, 1, "not_entity", "single", None), (99, 990, 1, "not_entity", "single", None),
        (11, 110, 1, "not_entity", "single", None),
    ]
    exclusions = [(10, 1), (10, 2), (20, 2), (30, 3), (30, 5), (40, 4), (60, 6), (80, 8), (80, 9), (90, 9), (90, 9), (990, 99), (110, 11)]
    candidates = [(i, "person", "a" if i < 3 else f"n{i}", "broken" if i == 11 else None) for i in range(1, 12)]
    got = P.exclusion_audit(
        spark.createDataFrame(decisions, "seed_id long, decision_id long, revision int, status string, scope string, entity_id long"),
        spark.createDataFrame(exclusions, "decision_id long, candidate_id long"),
        spark.createDataFrame(candidates, "candidate_id long, entity_type string, canonical string, chain_issue string"),
        spark.createDataFrame([(77,)], "candidate_id long"),
    )
    assert {r.seed_id: (r.applied_id, r.validity, r.issue) for r in got.collect()} == {
        1: (10, "active", None), 2: (20, "invalid", "covered_twice"), 3: (30, "invalid", "differs_from_seed"), 4: (40, "invalid", "entity_on_exclusion"), 5: (50, "invalid", "seed_not_covered"),
        6: (60, "revoked", None), 8: (80, "invalid", "single_covers_another"), 9: (90, "invalid", "repeated_candidate"), 99: (990, "invalid", "seed_missing"), 11: (110, "invalid", "provenance"),
    }


def test_only_text_artifact(spark):
    rows = [(1, 1, "extracted_text"), (2, 1, "event_fragments"), (3, 2, "transcript"), (4, 2, "ocr_text"), (5, 3, "entity_mentions")]
    got = P.only_text_artifact(spark.createDataFrame(rows, "artifact_id long, version_id long, artifact_type string"))
    assert {r.version_id: (r.artifact_id, r.issue) for r in got.collect()} == {1: (1, None), 2: (None, "several:3,4"), 3: (None, "none")}

"""Fragment queries over whole documents, against brute force."""

from __future__ import annotations

import itertools
import random
import re

import pytest

from quillon.operators import fragments as G
from quillon.plans import fragment_queries as Q
from quillon.plans._registry import QUERIES, Tables

WORDS = ["Anna", "Boris", "cafes", "bridges", "walk", "run", "act", "garden", "sat", "river", "orchard", "do"]


def line(seed: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(3))


TEXTS = {1: "\n".join(line(i) for i in range(1100)), 2: "\n\n".join(line(9000 + i) for i in range(20)), 3: " \n", 4: "\n".join([*["in the"] * 12, "Anna cafes", "Anna cafes"]), 5: "Anna run"}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("fragments")
    spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    return str(at)


def signals(block: str) -> set:
    out = set()
    for w in re.findall("[A-Za-z]+", block):
        n, low = len(w), w.lower()
        kind = "participant_mention" if w[0].isupper() else "action_candidate" if n <= 3 else "object_candidate" if n % 2 == 0 else "place_mention"
        if not (kind == "action_candidate" and low in G.GENERIC_ACTIONS["en"] or kind == "object_candidate" and n % 3):
            out.add((kind, low))
    return out


def brute() -> dict:
    out = {}
    for doc, text in TEXTS.items():
        found = [signals(x) for x in text.split("\n") if x.strip(" ")]
        for (i, a), (j, b) in itertools.combinations(enumerate(found, 1), 2):
            kinds = sorted({k for k, _ in a & b})
            status = "candidate" if len(kinds) >= 2 and set(kinds) & set(G.CORE) else "weak" if kinds else "insufficient"
            out[doc, i, j] = (sum(G.POINTS[k] for k, _ in a & b), ",".join(kinds), status)
    return out


def test_pairs_of_every_line(spark, folder):
    got = QUERIES["fragment_pairs_status"](spark, folder).collect()
    assert {(r.group_id, r.left_id, r.right_id): (r.points, r.dimensions, r.status) for r in got} == brute()
    assert len(got) == len(brute())
    assert G.incomplete_groups(Q._fragments(Tables(spark, folder)), Q._pairs(Tables(spark, folder))).count() == 0
    assert {r.exclusion for r in QUERIES["fragment_exclusions"](spark, folder).collect()} >= {None, "generic_action"}


def test_evidence_is_the_pairs_that_share(spark, folder):
    found = G.evidence(G.profiles(Q._observations(Tables(spark, folder)))).collect()
    got = {(r.group_id, r.left_id, r.right_id): (r.points, r.dimensions, r.status) for r in found}
    assert got == {k: v for k, v in brute().items() if v[1]}


def test_late_lines_reach_profiles_components_and_cliques(spark, tmp_path):
    text = "\n".join([*[f"in {w}" for w in "abcdefghijkl"], "Anna Boris Cyril walker", "Anna Boris Cyril walker", "Anna Boris Cyril walker"])
    spark.createDataFrame([(7, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: QUERIES[name](spark, str(tmp_path))
    assert [r.members for r in run("fragment_cliques").collect()] == [[13, 14, 15]]
    assert {r.fragment_id: r.component for r in run("fragment_components").collect()} == {i: min(i, 13) for i in range(1, 16)}
    assert run("fragment_profiles").where("fragment_id >= 13").count() == 12
    assert run("cluster_review_status").where("component = 13").first().n == 3

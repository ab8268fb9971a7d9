"""The grammar of token files: equal pairs, the end of Re-Pair, and the way back."""

from __future__ import annotations

import collections

import numpy as np
import pytest

from quillon.llm import tokenbin as B

VOCABULARY = 50


def documents(seed: int):
    rng = np.random.default_rng(seed)
    parts = [np.array([], int), np.full(9, 7), np.full(8, 7), np.tile([1, 2, 3], 40), np.tile([4, 4, 5], 30), rng.integers(0, 4, 300), np.array([9])]
    ids = np.concatenate([np.append(p, VOCABULARY) for p in parts])
    return ids, np.cumsum([len(p) + 1 for p in parts])


@pytest.mark.parametrize(("rounds", "least"), [(None, 2), (8, 3), (1, 24), (0, 2)])
def test_way_back(rounds, least):
    ids, ends = documents(0)
    payload = B.write_shard(np.arange(len(ends)), np.zeros(len(ends), bool), ids, ends, VOCABULARY, 2, rounds=rounds, least=least)
    held = B.Shard(payload)
    want = np.where(ids == VOCABULARY, 2, ids)
    assert held.tokens().tolist() == want.tolist()
    starts = np.concatenate([[0], ends[:-1]])
    for k, (a, z) in enumerate(zip(starts, ends, strict=True)):
        for start in range(0, z - a, 3):
            assert held.read(k, start, 5).tolist() == want[a:z][start : start + 5].tolist()


def test_no_pair_is_left_twice():
    ids, ends = documents(1)
    got = B.compress(ids, ends, VOCABULARY, rounds=None, rules=4, least=2)
    seq, counts, k = got["seq"].tolist(), collections.Counter(), 0
    while k < len(seq) - 1:
        pair = seq[k], seq[k + 1]
        if VOCABULARY not in pair:
            counts[pair] += 1
            k += len(set(pair)) == 1 and k + 2 < len(seq) and seq[k + 2] == seq[k]  # equal ones don't overlap
        k += 1
    assert max(counts.values(), default=0) < 2
    assert any(a == b for a, b in zip(got["left"].tolist(), got["right"].tolist(), strict=True))


def test_a_round_ranks_only_what_occurs_often_enough(monkeypatch):
    """Not every slot of pairs, which costs more than the round's pairs are worth."""
    ranked, partition = [], np.partition
    monkeypatch.setattr(np, "partition", lambda a, *k: ranked.append(len(a)) or partition(a, *k))
    ids, ends = documents(2)
    got = B.compress(ids, ends, VOCABULARY, rules=2, least=3)
    assert len(got["left"]) and all(n <= len(ids) // 3 for n in ranked)

"""The registered opN_ queries on the smallest tables, against brute force, their SQL or what their contract says."""

from __future__ import annotations

import collections
import os
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from quillon.llm import _words as W
from quillon.llm import quality as Q
from quillon.llm import queries

FOLDER = "/root/testdata/sf0.001"
LOW = {i: i + 32 for i in range(65, 91)}
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


def table(name):
    return pq.read_table(f"{FOLDER}/{name}.parquet").to_pylist()


def rows(spark, name):
    return queries.QUERIES[name](spark, FOLDER).collect()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_toxicity_has_every_document_once(spark):
    got = rows(spark, "op1_toxicity")
    assert sorted(r.doc_id for r in got) == sorted(d["doc_id"] for d in table("documents"))
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


def test_nearest_against_all(spark):
    data = table("embeddings")
    ids, x = np.array([d["vec_id"] for d in data]), np.array([d["embedding"] for d in data], float)
    got = collections.defaultdict(list)
    for r in sorted(rows(spark, "op2_nearest"), key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.vec_id, r.score))
    hits = asked = 0
    for q in ids[ids % 100 == 0].tolist():
        far = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        far[ids == q] = np.inf
        best = ids[np.lexsort((ids, far))[:10]].tolist()
        assert len(got[q]) == min(10, len(ids) - 1)
        assert all(abs(s - far[ids == v][0]) < 1e-12 for v, s in got[q])
        hits, asked = hits + len(set(best) & {v for v, _ in got[q]}), asked + len(best)
    assert hits >= 0.9 * asked > 0


def test_chat_format_equals_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{FOLDER}/conversations.parquet'")
    told = con.execute(queries.ORACLE_SQL["op3_chat_format"])
    names = [c[0] for c in told.description]
    want = sorted(told.fetchall())
    assert sorted(tuple(r[n] for n in names) for r in rows(spark, "op3_chat_format")) == want


def test_near_dedup_against_all_pairs(spark):
    sets = {}
    for d in table("documents"):
        w = words((d["text"] or "").translate(LOW))
        sets[d["doc_id"]] = frozenset(tuple(w[k : k + 3]) for k in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)] if w else [])
    label = {i: i for i in sets}
    moved = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    while moved:
        moved = False
        for a, b in links:
            low = min(label[a], label[b])
            moved |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    got = rows(spark, "op5_near_dedup")
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(s), label[i], label[i] == i) for i, s in sets.items()}


def test_quality_ratio_by_counters(spark):
    """Every gram's bucket by its own hash; counts, ratio, mean and threshold from counters."""
    docs, labels = table("documents"), {d["doc_id"]: d["quality"] for d in table("labels")}
    bucket: dict[bytes, int] = {}

    def grams(text):
        raw = (text or "").encode()
        for k in range(len(raw) - Q.GRAM + 1):
            g = raw[k : k + Q.GRAM]
            if g not in bucket:
                bucket[g] = int(W.Block(np.frombuffer(g, np.uint8), np.array([0, Q.GRAM])).slices(np.array([0]), np.array([Q.GRAM]))[0]) & (Q.BUCKETS - 1)
            yield bucket[g]

    raw, good, per = collections.Counter(), collections.Counter(), {}
    for d in docs:
        per[d["doc_id"]] = collections.Counter(grams(d["text"]))
        raw.update(per[d["doc_id"]])
        if labels.get(d["doc_id"]) == 1:
            good.update(per[d["doc_id"]])
    n_raw, n_good = sum(raw.values()), sum(good.values())
    ratio = lambda b: round((np.log((good[b] + 0.5) / (n_good + 0.5 * Q.BUCKETS)) - np.log((raw[b] + 0.5) / (n_raw + 0.5 * Q.BUCKETS))) * Q.SCALE)
    mean = {i: sum(ratio(b) * n for b, n in c.items()) / max(1, sum(c.values())) / Q.SCALE for i, c in per.items()}
    got = {r.doc_id: r for r in rows(spark, "op10_quality_rules")}
    assert all(abs(got[i].llr - m) < 1e-6 for i, m in mean.items())
    trusted = [got[i].llr for i, q in labels.items() if q == 1 and not got[i].base_failed]
    bar = np.quantile(trusted, 0.001) - 0.05
    assert all(r.kept == (not r.base_failed and r.llr >= bar) for r in got.values())


def test_secret_spans_by_regular_expressions(spark):
    kinds = {
        "assign": (r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 8), "access": (r"AKIA[A-Z0-9]+", 0, 16), "hex": (r"[0-9a-f]+", 0, 32),
    }
    text = {d["doc_id"]: d["text"] or "" for d in table("documents")}
    for r in rows(spark, "op7_secret_scan"):
        found = {k: [m for m in re.finditer(p, text[r.doc_id], re.A) if len(m[g]) >= n] for k, (p, g, n) in kinds.items()}
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(len(found[k]) for k in kinds)
        base = [f"{k}:{m.start()}:{m.end()}" for k in kinds for m in found[k]]
        assert set(base) <= set(r.spans.split(","))


def test_files_and_packing_hold_every_token(spark):
    files = sorted(rows(spark, "op6_token_files"), key=lambda r: r.doc_id)
    assert [r.start for r in files] == np.concatenate([[0], np.cumsum([r.n_tokens for r in files])[:-1]]).tolist()
    packed = collections.defaultdict(list)
    for r in rows(spark, "op8_packing"):
        packed[r.sequence_id].append((r.offset, r.length))
    for parts in packed.values():
        parts.sort()
        assert [o for o, _ in parts] == np.concatenate([[0], np.cumsum([n for _, n in parts])[:-1]]).tolist() and sum(n for _, n in parts) <= 2048
    total = sum(n for parts in packed.values() for _, n in parts)
    assert len(packed) <= -(-total // 2048) * 1.02 + 1


def test_every_query_returns_every_document(spark):
    n = len(table("documents"))
    for name in ("op4_lm_score", "op9_piece_codec"):
        got = rows(spark, name)
        assert len(got) == n and len({r.doc_id for r in got}) == n

"""LM scoring: probabilities that sum to one, scores that hang on training texts and the text alone, and a plain version of them."""

from __future__ import annotations

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import lmscore as L

WORDS = {"en": ["alpha", "beta", "gamma", "delta", "of", "the", "and", "ends."], "de": ["über", "straße", "und", "der", "die", "das", "alpha", "nicht"]}


def corpus():
    rng = random.Random(3)
    rows = []
    for i in range(160):
        lang = ("en", "de")[i % 2]
        words = [rng.choice(WORDS[lang]) for _ in range(rng.randint(0, 60))] + [f"w{rng.randrange(400)}" for _ in range(6)]
        rng.shuffle(words)
        rows.append((i, " ".join(words), lang))
    return rows


@pytest.fixture(scope="module")
def fitted(spark):
    """Scores of the corpus, learned from ids not divisible by 4, with what the fit found."""
    held = {}
    fit, spelling = L.fit_mixing, L.fit_spelling
    L.fit_mixing = lambda *a, **k: held.setdefault("model", fit(*a, **k))
    L.fit_spelling = lambda *a, **k: held.setdefault("spelling", spelling(*a, **k))
    try:
        docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string").repartition(3)
        held["rows"] = {r.doc_id: r for r in L.score_texts(docs, F.col("doc_id") % 4 != 0).collect()}
    finally:
        L.fit_mixing, L.fit_spelling = fit, spelling
    return held


def scores(spark, rows, partitions):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(partitions)
    return {r.doc_id: r.score for r in L.score_texts(docs, F.col("doc_id") % 4 != 0).collect()}


def test_scores_hang_on_training_texts_and_the_text_alone(spark, fitted):
    other = [(i, t if i % 4 or i % 8 else "quite another text " * i, lang if i % 4 else "xx") for i, t, lang in corpus()]
    got = scores(spark, other, 7)
    assert {i: s for i, s in got.items() if i % 8} == {i: r.score for i, r in fitted["rows"].items() if i % 8}


def test_order_of_words_counts(spark):
    rows = [(i, "one two three four five six seven eight nine ten", "en") for i in range(1, 40)]
    rows += [(100, "one two three four five six seven eight nine ten", "en"), (104, "ten two eight four five six seven three nine one", "en")]
    got = scores(spark, rows, 2)
    assert got[100] > got[104] + 3


def test_first_tokens_are_a_distribution(fitted):
    model = fitted["model"]
    tokens = sorted({w for i, t, _ in corpus() if i % 4 for w in t.split()})
    symbols = [t for t in tokens if L._Sequence(model, *_raw(t)).symbol[0] > 1]
    total = sum(2.0 ** (L.price(model, L._Sequence(model, *_raw(t)))[0] / L.EVENT) for t in [*symbols, "", "neverseen"])
    assert abs(total - 1) < 1e-3
    assert len(symbols) + 2 == len(model.symbols["c"])


def _raw(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return data, np.array([0, len(data)])


def test_spelled_words_are_a_distribution(fitted):
    words = [bytes([b]) for b in range(256) if b != 32]
    frozen, mixer = fitted["spelling"]
    one = L.spell(frozen, mixer, words, np.zeros(len(words), np.int64)) / L.EVENT
    assert 0 < (2.0**one).sum() <= 1 + 1e-3


def test_score_by_plain_loops(fitted):
    """The same sums token by token and bit by bit, with counts in dictionaries."""
    model, (spelling, speller) = fitted["model"], fitted["spelling"]
    paths, size = model.paths, 1 << model.bits
    kinds = sorted({lang for i, _, lang in corpus() if i % 4}, key=lambda k: (-sum(x[2] == k and x[0] % 4 > 0 for x in corpus()), k))
    own = {k: collections.Counter(w for i, t, lang in corpus() if i % 4 and lang == k for w in t.lower().split()) for k in kinds}
    counts = sum(own.values(), collections.Counter())
    n, v = sum(counts.values()) + sum(x[0] % 4 > 0 for x in corpus()), len(counts) + 1
    pairs = collections.defaultdict(lambda: [0, 0])

    def walk(text):
        """symbol, word, class and decisions (node, bit, slots) of each token."""
        keys, run, words = [L._START, L._START], model.prior.copy(), [*text.lower().split(), None]
        for w in words:
            h = L._STOP if w is None else L._Sequence(model, *_raw(w)).hashes[0]
            symbol = 0 if w is None else max(1, int(model.lookup.find(np.array([h]))[0]))
            with np.errstate(over="ignore"):
                contexts = [L.W.mix(keys[-1:][0] + np.zeros(1, np.uint64)), L.W.mix(np.array([keys[-1]]) * L._M[3] + keys[-2])]
            steps = []
            for at in range(paths.start[symbol], paths.start[symbol] + paths.size[symbol]):
                slots = [int(L._slots(c, paths.node[at : at + 1], model.bits)[0]) + k * size for k, c in enumerate(contexts)]
                steps.append((int(paths.node[at]), int(paths.bit[at]), slots))
            yield symbol, w, int(run.argmax()), steps
            run = run + model.evidence[symbol]
            keys.append(h)

    for i, t, _ in corpus():
        if i % 4:
            for *_, steps in walk(t):
                for _, bit, slots in steps:
                    for s in slots:
                        pairs[s][bit] += 1
    rare = {w: c for w, c in counts.items() if c < L.LEAST}
    edge = L.LEAST * sum(c == L.LEAST for c in counts.values())
    unseen = (sum(c == 1 for c in rare.values()) + 0.5) / (sum(rare.values()) + edge + 1)
    of_kind = [sum(own[k][w] for w in rare) for k in kinds]
    for i, t, _ in corpus()[::8]:
        base = score = 0.0
        for symbol, w, kind, steps in walk(t):
            c = sum(x[0] % 4 > 0 for x in corpus()) if w is None else counts[w]
            base += math.log10((c + 0.5) / (n + 0.5 * (v + 1)))
            for node, bit, slots in steps:
                x = [float(paths.logit[node]), float(paths.class_logit[kind, node])]
                seen = []
                for s in slots:
                    zero, one = pairs[s]
                    x.append(round(16 * max(-7.9, min(7.9, math.log((one + 0.15) / (zero + 0.15))))) / 16)
                    seen.append(sum(zero + one >= b for b in (1, 3, 16)))
                gate = seen[0] * 4 + seen[1]
                weights = model.mixer.weights[gate]
                z = max(-15.9, min(15.9, weights[4] + sum(a * b for a, b in zip(weights, x, strict=False))))
                zero, one = model.mixer.refined[gate, round((z + 16))]
                trust = 0.5 * (zero + one) / (zero + one + 200)
                p = (1 - trust) / (1 + math.exp(-z)) + trust * (one + 1 / (1 + math.exp(-z))) / (zero + one + 1)
                score += math.log10(max(p if bit else 1 - p, 1e-7))
            if symbol == 1 and w in counts:
                score += math.log10((1 - unseen) * (own[kinds[kind]][w] + 200 * counts[w] / sum(rare.values())) / (of_kind[kind] + 200))
            elif symbol == 1:
                score += math.log10(unseen) + L.spell(spelling, speller, [w.encode()], np.array([kind]))[0] / L.EVENT * math.log10(2)
        assert math.isclose(fitted["rows"][i].base_score, base, rel_tol=1e-9, abs_tol=1e-6)
        assert math.isclose(fitted["rows"][i].score, score, rel_tol=1e-4), i


def test_weights_learn_from_all_training_texts_and_rare_tokens(spark, monkeypatch):
    """More texts and more rare tokens than a sample of 3000 and 20,000 would take: every decision and every bit is learned from."""
    held, fit, spelling = {}, L.fit_mixing, L.fit_spelling
    monkeypatch.setattr(L, "fit_mixing", lambda *a, **k: held.setdefault("model", fit(*a, **k)))
    monkeypatch.setattr(L, "fit_spelling", lambda *a, **k: held.setdefault("spelling", spelling(*a, **k)))
    texts = {i: f"the end of {'this' if i % 3 else 'that'} " + " ".join(f"w{i}x{k}" for k in range(7)) for i in range(4200)}
    L.score_texts(spark.createDataFrame([(i, t, "en") for i, t in texts.items()], "doc_id long, text string, lang string").repartition(3), F.col("doc_id") % 4 != 0)
    model, (_, speller) = held["model"], held["spelling"]
    trained = [t for i, t in texts.items() if i % 4]
    decisions = sum(int(model.paths.size[L._Sequence(model, *_raw(t)).symbol].sum()) for t in trained)
    rare = [w for t in trained for w in t.split() if w.startswith("w")]
    assert len(trained) > 3000 and len(rare) > 20_000
    assert model.mixer.refined.sum() == decisions
    assert speller.refined.sum() == sum(8 * (len(w) + 1) for w in rare)


def test_weights_by_plain_loops(spark):
    """Online Newton steps after each round, event by event."""
    rng = random.Random(5)
    rows = [(i, *(rng.randrange(-60, 61) / 16 for _ in range(2)), rng.randrange(3)) for i in range(3000)]
    rows = [(i, a, b, g, int(rng.random() < 1 / (1 + math.exp(-a + 0.5 * b - 0.3 * g)))) for i, a, b, g in rows]

    def events(batch):
        _, a, b, g, one = (c.to_numpy() for c in batch.columns)
        yield [a.astype(np.float32), b.astype(np.float32)], g, one

    df = spark.createDataFrame(rows, "id long, a double, b double, gate long, one long").repartition(3)
    got = L._learned(df, ["id"], 2, events)
    share = {r.id: r.s for r in df.select("id", F.pmod(F.xxhash64("id"), F.lit(8)).alias("s")).collect()}
    weights, seen = {g: np.array([0.6, 0.6, 0.0]) for g in range(3)}, {g: L.PRIOR * np.eye(3) for g in range(3)}
    for low, high in ((0, 1), (1, 2), (2, 4), (4, 8)):
        gradient = {g: np.zeros(3) for g in range(3)}
        for i, a, b, g, one in rows:
            if low <= share[i] < high:
                x = np.array([a, b, 1.0])
                error = one - 1 / (1 + math.exp(-weights[g] @ x))
                gradient[g] += error * x
                seen[g] += error**2 * np.outer(x, x)
        for g in range(3):
            weights[g] = weights[g] + np.linalg.solve(seen[g], gradient[g])
    assert got.refined.sum() == 3000
    for g in range(3):
        assert np.allclose(got.weights[g], weights[g], atol=1e-3)


def test_decisions_of_a_path_read_memory_in_few_places():
    """Three decisions after each other share 8 slots that lie side by side, whatever the context."""
    paths, rng = L.Paths(np.ones(512), np.ones((512, 1))), np.random.default_rng(0)
    for symbol, context in zip(range(0, 512, 37), rng.integers(0, 1 << 63, 14).astype(np.uint64), strict=True):
        node = paths.node[paths.start[symbol] : paths.start[symbol] + paths.size[symbol]]
        slots = L._slots(np.full(len(node), context), node, 21)
        assert len(node) == 9 and len(set(slots.tolist())) == 9
        assert len(set((slots >> 3).tolist())) == 3

"""Counts beyond every subscriber's cursor, against brute force."""

from __future__ import annotations

import random

from quillon.plans import stream_queries  # noqa: F401
from quillon.plans._registry import QUERIES
from quillon.streaming import discovery as S


def test_every_customer_is_a_subscriber(spark, tmp_path):
    ids = list(range(1, 1001))
    spark.createDataFrame([(i,) for i in ids], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(k,) for k in range(1, 201)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r.subscriber_id: (r.n, r.newest) for r in QUERIES["stream_cursor"](spark, str(tmp_path)).collect()}
    assert got == {k: (1000 - k * 6, 1000) for k in range(1, 201) if k % 3 and k * 6 < 1000}


def test_counts_are_those_of_the_rows(spark):
    rng = random.Random(4)
    ids = [rng.randrange(500) ** 2 for _ in range(2000)] + [77] * 300 + [None]
    cursors = [(i, rng.choice([None, rng.randrange(-5, 260_000), 77, max(x for x in ids if x is not None)])) for i in range(400)]
    items, held = spark.createDataFrame([(i,) for i in ids], "item_id long"), spark.createDataFrame(cursors, "subscriber_id long, cursor long")
    want = {(r.subscriber_id, r.item_id) for r in S.after_cursor(items, held).collect()}
    got = {r.subscriber_id: (r.n, r.newest) for r in S.counts_after(items, held).collect()}
    beyond = {s: [x for x in ids if x is not None and c is not None and x > c] for s, c in cursors}
    assert got == {s: (len(x), max(x)) for s, x in beyond.items() if x}
    assert set(got) == {s for s, _ in want}
    assert S.counts_after(items.where("false"), held).count() == 0

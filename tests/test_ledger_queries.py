"""Ledger queries over every row of small tables, against brute force."""

from __future__ import annotations

import datetime

import pytest

from quillon.plans import ledger_queries  # noqa: F401
from quillon.plans._registry import QUERIES

DAY = datetime.datetime(2024, 1, 1)
# By user: event types in order. Ids run on, so most are no multiples of 7 or 11; users 5 and 10 are multiples of 5.
EVENTS = {5: ["view", "purchase"], 10: ["click", "error"], 3: ["view"] * 3, 4: ["view"], 6: ["error", "purchase"]}
STATES = {5: (2, "succeeded"), 10: (2, "restricted"), 3: (3, "exhausted"), 4: (1, "retry"), 6: (2, "succeeded")} | {1000000 + i: (0, "new") for i in range(5)}
# By customer: key and status of each order by date. No key is a multiple of 5; 97 leaves a gap, 89 changes the scope, 53 has no reason.
ORDERS = {
    1: [(1, "O"), (2, "P")], 2: [(3, "P"), (4, "F")], 3: [(6, "O"), (97, "P")], 4: [(7, "O"), (89, "P")], 5: [(53, "P")],
    6: [(61, "P")], 7: [(8, "P"), (9, "O")], 8: [(11, "O"), (12, "F")],
}
JUDGED = {
    1: (2, "not_entity", "active", None), 2: (4, "revoked", "revoked", None), 3: (97, "not_entity", "invalid", "revision_gap"), 4: (89, "not_entity", "invalid", "scope_changed"),
    5: (53, "not_entity", "invalid", "blank_reason"), 6: (61, "not_entity", "invalid", "entity_on_not_entity"),
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("ledger")
    events = [(user, kind) for user, kinds in EVENTS.items() for kind in kinds]
    rows = [(i, DAY + datetime.timedelta(hours=i), user, kind) for i, (user, kind) in enumerate(events, 1)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string").write.parquet(f"{at}/events.parquet")
    rows = [(key, c, status, DAY.date() + datetime.timedelta(days=i), "3-MEDIUM") for c, orders in ORDERS.items() for i, (key, status) in enumerate(orders)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate date, o_orderpriority string").write.parquet(f"{at}/orders.parquet")
    rows = [(c, c % 3, "BUILDING", f"Customer#{c:09d}") for c in ORDERS]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int, c_mktsegment string, c_name string").write.parquet(f"{at}/customer.parquet")
    rows = [(key, 1, DAY.date(), "A", "F") for orders in ORDERS.values() for key, _ in orders]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_shipdate date, l_returnflag string, l_linestatus string").write.parquet(f"{at}/lineitem.parquet")
    return str(at)


def test_every_event_decides_the_states(spark, folder):
    got = QUERIES["acquisition_states"](spark, folder).collect()
    assert {r.user_id: (r.attempts, r.state) for r in got} == STATES
    assert QUERIES["acquisition_state_summary"](spark, folder).first().asDict() == {"new": 5, "retry": 1, "exhausted": 1, "restricted": 1, "succeeded": 2}


def test_every_order_decides_not_entities(spark, folder):
    got = QUERIES["not_entity_validity"](spark, folder).collect()
    assert {r.seed_id: (r.decision_id, r.status, r.validity, r.issue) for r in got} == JUDGED
    rows = QUERIES["coverage_status"](spark, folder).collect()
    # Customers 3, 4, 5 and 6 are invalid by their decisions, 1 as it is assigned and an active not-entity.
    assert sum(r.n for r in rows if r.status == "invalid") == 5

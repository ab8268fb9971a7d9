"""Messages hold whole texts."""

from __future__ import annotations


def test_long_texts_count_whole(spark, tmp_path):
    from quillon.plans import text_queries  # noqa: F401  (needs a session)
    from quillon.plans._registry import QUERIES

    rows = [(1, "s", "x" * 2000), (2, "s", "x" * 1898), (3, "s", "x" * 100), (4, "s", "x" * 3000), (5, "s", "x" * 901), (6, "s", "x" * 8000), (7, "s", None)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.message, r.n_items, r.n_chars) for r in QUERIES["message_packing"](spark, str(tmp_path)).collect())
    assert got == [(0, 2, 3900), (1, 2, 3102), (2, 1, 901), (3, 1, 3900), (4, 1, 3900), (5, 2, 202)]

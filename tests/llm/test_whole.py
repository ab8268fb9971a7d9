"""Cases that a bound used to cut off."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillon.llm import lmscore, secrets


def test_value_of_one_owner_in_many_documents_is_reported(spark):
    own, copied, nobody = "Own9" + "Zx7" * 8, "Ab9" * 9, "Cd8" * 9
    rows = [(k, f"key {own} in {k}", "s1") for k in range(5)] + [(10 + k, f"key {copied} in {k}", f"s{k}") for k in range(5)] + [(20 + k, f"key {nobody} in {k}", None) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    masked = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert all(masked[k] == f"key [live secret] in {k}" for k in range(5))
    assert all(masked[i] == text for i, text, _ in rows if i >= 10)


def test_last_class_has_its_documents(spark):
    # Eight languages alike but for their letter: the last one shares no class, so its texts score as the others' do.
    rows = [(k * 10 + i, f"{'abcdefgh'[k] * 3} {'abcdefgh'[k] * 4} " * 5, f"l{k}") for k in range(8) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    with pytest.warns(UserWarning, match="1 of 8"):
        by = {r.doc_id: r.score for r in lmscore.score_texts(docs, F.lit(True)).collect()}
    first, last = [by[k * 10] for k in range(7)], by[70]
    assert min(first) - 0.5 < last

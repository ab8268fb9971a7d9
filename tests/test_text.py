"""Unicode forms and discourse counts."""

from __future__ import annotations

from quillon.functions import text as T
from quillon.operators import documents as D


def test_unicode_forms(spark):
    rows = spark.createDataFrame([("\ufb01ne  Stra\u00dfe ",), ("e\u0301",), ("plain",), (None,)], "x string")
    assert [r[0] for r in rows.select(T.canonical_mention("x")).collect()] == ["fine strasse", "\u00e9", "plain", None]
    assert [r[0] for r in rows.select(T.unicode_form("x", "NFD")).collect()][1] == "e\u0301"


def test_stored_text(spark):
    rows = spark.createDataFrame([("a\r\nb\rc",), ("a\0b",), (" \n",), (None,)], "x string")
    text, issue = T.stored_text("x")
    assert [tuple(r) for r in rows.select(text, issue).collect()] == [("a\nb\nc", None), (None, "nul_character"), (None, "blank"), (None, "blank")]


def test_discourse(spark):
    rows = [(1, "We must go! They will, clearly. Our fear?"), (2, "... 12 3!"), (3, None)]
    got = {r.doc_id: r for r in D.discourse(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    one = got[1]
    assert (one.word_count, one.sentence_count, one.questions, one.exclamations) == (8, 3, 1, 1)
    assert (one.first_person_plural, one.third_person_plural, one.certainty, one.fear, one.threat) == (2, 1, 3, 1, 0)
    assert abs(one.average_sentence_length - 8 / 3) < 1e-12 and one.issue is None
    assert all(got[i].issue == "blank" and got[i].average_sentence_length is None for i in (2, 3))

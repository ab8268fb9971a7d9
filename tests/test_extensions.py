"""What can be put in from outside, and what stands there by default."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from quillon import extensions as E


def test_store_keeps_each_content_once_and_checks_it(spark, tmp_path):
    store = E.ArtifactStore(spark, f"{tmp_path}/blobs")
    rows = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "content string")
    assert {r.byte_size for r in store.store(rows).collect()} == {1} and store.table().count() == 2
    store.store(spark.createDataFrame([("b",), ("c",)], "content string"))
    assert store.table().count() == 3
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    spark.createDataFrame([(digest("d"), "k", 1, bytearray(b"x"))], E.ArtifactStore.SCHEMA).write.mode("append").parquet(store.path)
    asked = spark.createDataFrame([(digest(x),) for x in "abdz"], "sha256 string")
    got = {r.sha256: (bytes(r.content) if r.content else None, r.issue) for r in store.read(asked).collect()}
    assert got == {digest("a"): (b"a", None), digest("b"): (b"b", None), digest("d"): (None, "corrupt"), digest("z"): (None, "missing")}


def test_connector_discovers_and_retrieves(spark):
    pages = spark.createDataFrame([("u1", 200, "<p>x</p>"), ("u2", 404, "gone")], "url string, code int, html string")
    connector = E.StoredFeeds(pages)
    assert isinstance(connector, E.Connector)
    xml = "<rss><channel>" + "".join(f"<item><title>t</title><link>{u}</link></item>" for u in ("u1", "u2", "u3")) + "<item><title>none</title></item></channel></rss>"
    found = connector.discover(spark.createDataFrame([(1, xml), (2, "<broken")], "endpoint_id long, xml string"))
    assert sorted(r.link for r in found.collect()) == ["u1", "u2", "u3"]
    got = {r.link: (r.outcome, r.content) for r in connector.retrieve(found).collect()}
    assert got["u1"] == ("succeeded", "<p>x</p>") and got["u2"] == ("unavailable", None) and got["u3"][1] is None


def test_extractor_and_canonicalizer_can_be_put_in(spark):
    rows = spark.createDataFrame([(1, "<p>Hello</p>"), (2, "<p> </p>")], "artifact_id long, content string")
    got = {r.artifact_id: (r.text, r.limitations) for r in E.extracted(rows).collect()}
    assert got[1] == ("Hello", ["short_text"]) and got[2][1] == ["empty_text", "short_text"]
    assert E.extracted(rows, F.upper).first().text == "<P>HELLO</P>"
    names = spark.createDataFrame([(" Anna  B ",)], "surface string")
    assert E.canonical(names).first().canonical == "anna b" and E.canonical(names, F.trim).first().canonical == "Anna  B"


def test_observations_and_gateway(spark):
    docs = spark.createDataFrame([(1, "Anna Berg met BBC in 2020")], "doc_id long, text string")
    assert {(r.surface, r.observation_type) for r in E.observed(docs).collect()} == {("Anna Berg", "participant_mention"), ("BBC", "participant_mention")}
    sent = []

    class Sink:
        def send(self, messages, batch):
            sent.append((batch, messages.count()))

    E.delivering(Sink())(docs, 3)
    assert sent == [(3, 1)]
    with pytest.raises(TypeError):
        E.delivering(object())

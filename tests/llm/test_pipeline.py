"""The corpus pipeline's stages on a small corpus, each against what it should decide."""

from __future__ import annotations

import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_stages(spark):
    import corpus_pipeline
    from quillon.llm._shared import materialize

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, SF), name)
        if name == "packing":
            fill = out.groupBy("sequence_id").sum("length").collect()
            assert max(r[1] for r in fill) <= 2048
            assert out.select("doc_id").distinct().count() == docs.count()
            break
        assert out.columns == columns and out.count() <= docs.count()
        assert out.join(docs, "doc_id", "left_anti").count() == 0
        if name == "secret_scan":
            assert out.count() == docs.count()
        docs = out
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert docs.join(labels.where("quality = 0"), "doc_id").count() <= 1

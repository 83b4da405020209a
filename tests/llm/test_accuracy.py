"""Held-out accuracy and the pipeline on the driver's tables."""

import os

import pytest

import corpus_pipeline
from treeline.llm import queries

SF = "/root/testdata/sf0.1"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def test_language(spark):
    rows = queries.op5_language(spark, SF).join(queries.table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (rows.lang == rows.lang_pred).mean() > 0.98


def test_quality(spark):
    rows = queries.op6_quality(spark, SF).join(queries.table(spark, SF, "labels"), "doc_id").where("held_out").toPandas()
    assert (rows.quality == rows.predicted).mean() > 0.97


def test_toxicity(spark):
    rows = queries.op7_toxicity(spark, SF).join(queries.table(spark, SF, "labels"), "doc_id").where("held_out").toPandas()
    assert (rows.toxic == rows.predicted).mean() > 0.95 and rows[rows.toxic == 1].predicted.mean() > 0.8


def test_pipeline_stages(spark):
    """Each stage against its operator's own decisions on the stage's input."""
    small = SF.replace("sf0.1", "sf0.01")
    docs = queries.table(spark, small, "documents")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(stage(spark, kept[-1], small).cache())
        assert kept[-1].columns == docs.columns and 0 < kept[-1].count() < kept[-2].count()
    packed = corpus_pipeline.STAGES[-1][1](spark, kept[-1], small)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in kept[-1].select("doc_id").collect()}

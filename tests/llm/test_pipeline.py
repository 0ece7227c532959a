"""The pipeline's stages: each works on what the one before kept."""

import corpus_pipeline
from prosegauge.llm import jaccard, mixing, quality
from prosegauge.llm.common import saved
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"


def test_each_stage_takes_effect(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(saved(stage(spark, kept[-1], FOLDER), name.split()[0]))
        assert kept[-1].columns == docs.columns
    _, good, single, clean, mixed = kept
    rejected = docs.join(good, "doc_id", "left_anti").join(labels, "doc_id")
    assert rejected.count() > 0 and rejected.where("quality = 1").count() == 0
    groups = jaccard.similar_documents(good)
    assert single.count() == groups.select("component_id").distinct().count()
    assert clean.count() == single.count()
    assert clean.where("text RLIKE '[A-Za-z0-9]@[A-Za-z0-9-]+[.][A-Za-z]'").count() == 0
    plan = mixing.mix_sources(clean, F.array("source"))
    assert mixed.count() == plan.where("size > 0").agg(F.sum("repeats")).first()[0]
    out = corpus_pipeline.STAGES[-1][1](spark, mixed, FOLDER)
    assert out.count() == mixed.count() and out.where("n_tokens = 0").count() == 0


def test_stages_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, FOLDER), name.split()[0])
        assert docs.count() == 0
    assert quality.THRESHOLD == 0.7


def test_copies_go_by_row_not_by_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(3, a), (5, a), (5, b), (8, c), (8, c), (None, c + " end"), (None, "q r s"), (None, "q r s"), (9, ""), (9, ""), (10, None)]
    docs = spark.createDataFrame([(*r, "s", i, "x") for i, r in enumerate(rows)], "doc_id long, text string, source string, _row int, score string")
    got = corpus_pipeline.join_copies(spark, docs.drop("_row"), FOLDER)
    assert sorted(map(str, got.select("doc_id", "text").collect())) == sorted(
        map(str, spark.createDataFrame([(3, a), (5, b), (8, c), (None, "q r s"), (9, ""), (10, None)], "doc_id long, text string").collect()))


def test_stages_of_odd_rows_and_clashing_columns(messy, spark):
    docs = messy
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = saved(stage(spark, docs, FOLDER), name.split()[0])
        assert kept.columns == docs.columns and "n_chars" not in kept.columns
        before = {(r.doc_id, r.score, r.spans, r["order"]) for r in docs.collect()}
        assert {(r.doc_id, r.score, r.spans, r["order"]) for r in kept.collect()} <= before
        docs = kept
    assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() == docs.count()

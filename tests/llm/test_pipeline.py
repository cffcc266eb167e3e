"""The pipeline, stage by stage, on a small folder of tables and on odd rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    seen = [{r.doc_id for r in docs.collect()}]
    for name, stage in pipeline.STAGES[:-1]:
        before = docs.columns
        docs = pipeline.materialize(stage(spark, docs, SF), name)
        assert docs.columns == before
        seen.append({r.doc_id for r in docs.collect()})
        assert seen[-1] <= seen[-2]
    assert len(seen[0]) > len(seen[1]) and len(seen[3]) < len(seen[2])
    assert sum(labels.get(d, 0) for d in seen[2]) <= sum(labels.get(d, 0) for d in seen[1])
    wrong = docs.where(F.col("n_chars") != F.length("text")).count()
    assert wrong == 0
    pieces = pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in pieces.collect()} == seen[-1]


@pytest.mark.parametrize("name,stage", pipeline.STAGES)
def test_odd_rows(spark, name, stage):
    text = "the quick brown fox jumps over a lazy dog and then some more of it"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, text, "en", "s", 3), (3, text, "xx", "s", 3), (3, text, "xx", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("kept", F.lit("mine")).withColumn("score", F.lit(7)).withColumn("removed", F.lit("x"))
    out = stage(spark, docs, SF)
    assert out.count() <= 2 * len(rows)
    if name != "packing":
        assert out.columns == docs.columns
        assert {r.kept for r in out.collect()} <= {"mine"} and {r.score for r in out.collect()} <= {7} and {r.removed for r in out.collect()} <= {"x"}
    assert stage(spark, docs.limit(0), SF).count() == 0

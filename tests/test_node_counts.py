"""Nodes counted inside tasks against nodes flattened by Spark."""

from pyspark.sql import functions as F

from pactlake.operators import inference

PLAIN = [
    '{"a":1,"b":"x","c":[1,2.5,"y",null,{"d":true}],"e":{}}', '{"a":-0,"b":"x","b":"z"}', '{"a":1.0,"b":1e5,"c":12345678901234567890123,"d":-9223372036854775808}',
    '{"a/b~c":{"":[[],[[]]]},"items":{"properties":1}}', '"text"', "7", "null", "false", " [ ] ", '{"a":"[{\\u00e9\\n"}', '{"z":9223372036854775808}',
    "[" + ",".join(['{"k":[1]}'] * 80) + "]", "[" * 64 + "]" * 64,
]
ODD = [
    "", "   ", "{", '{"a":NaN}', "[Infinity]", '{"a":01}', "{'a':1}", '{"a":1} tail', '"\\ud83d\\ude00"', '"\\ud83d"', "[1e400]", "[" * 65 + "]" * 65,
    '{"a":"\x01"}', "[1,]", '{"a":' + "1" * 400 + "}", "﻿{}", "[1.]", '{"a":.5}', "tru",
]


def _docs(spark):
    texts = [(k, t) for k in ("s", "t", None) for t in [*PLAIN, *ODD, None]]
    docs = spark.createDataFrame(texts, "subject string, body string")
    broken = spark.sql("select 's' subject, cast(unhex('22FF22') as string) body union all select cast(unhex('80') as string), '[1]'")
    return docs.unionByName(broken)


def _rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_counts_in_tasks_are_those_of_flattened_documents(spark):
    docs = _docs(spark)
    counted = inference._counted(docs.withColumnRenamed("body", "document"), "subject")
    assert _rows(inference._path_texts(docs, "subject", "body")) == _rows(counted)


def test_numbers_may_be_the_key(spark):
    docs = _docs(spark).where("length(body) < 60").withColumn("subject", F.length("subject").cast("int"))
    counted = inference._counted(docs.withColumnRenamed("body", "document"), "subject")
    assert _rows(inference._path_texts(docs, "subject", "body")) == _rows(counted)


def test_plain_documents_are_not_flattened(spark, monkeypatch):
    left = []
    counted = inference._counted
    monkeypatch.setattr(inference, "_counted", lambda docs, by: (left.extend(r["document"] for r in docs.collect()), counted(docs, by))[1])
    docs = spark.createDataFrame([("s", t) for t in [*PLAIN, "{"]], "subject string, body string")
    stats = inference.infer_path_stats(docs)
    assert left == ["{"]
    assert stats.where("schema_path = '#'").first()["occurrences"] == len(PLAIN)


def test_counts_held_in_a_task_are_bounded(spark, monkeypatch):
    from pactlake.operators import node_counts

    monkeypatch.setattr(node_counts, "HELD", 3)
    docs = spark.range(500).select(F.lit("s").alias("subject"), F.to_json(F.struct((F.col("id") % 7).cast("string").alias("a"), "id")).alias("body"))
    counted = inference._counted(docs.withColumnRenamed("body", "document"), "subject")
    with_small_batches = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        assert _rows(inference._path_texts(docs, "subject", "body")) == _rows(counted)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", with_small_batches)

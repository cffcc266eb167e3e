"""Plain payloads checked inside tasks: the same findings, in the same order, as Spark's own nodes give."""

import json

from pyspark.sql import functions as F

from pactlake.operators import conformance, validation
from pactlake.operators.validation import check_payloads, rules_depth, rules_of

SCHEMAS = [
    {"type": "object", "required": ["b/~", "a", "a"], "additionalProperties": False, "maxProperties": 2, "minProperties": 1,
     "properties": {"a": {"type": ["integer", "null"], "enum": [1, 2.50, None]}, "z": False, "\U0001f600": {"type": "string"}, "～": {"const": "x"}, "items": {"items": {"type": "boolean"}}}},
    {"items": {"items": {"multipleOf": 0.3, "exclusiveMaximum": 5, "minimum": -1}}, "uniqueItems": True, "maxItems": 2, "minItems": 1},
    {"type": "string", "minLength": 2, "maxLength": 3, "pattern": "^\\d+[a-c]*$"},
    {"type": "integer", "maximum": 10, "exclusiveMinimum": 0, "multipleOf": 2},
    {"properties": {"properties": {"properties": {"items": {"type": "number", "maximum": 1e30}}}}},
    {"const": 0}, {"const": {"a": 1}}, {"enum": ["a", False, 0.000000001]}, {"pattern": "\\bx"}, {"allOf": [{}]}, {"type": "null"}, {},
]
DOCS = [
    "{}", '{"a":1}', '{"a":1,"b/~":2,"c":3}', '{"b/~":0,"a":2.5}', '{"a":2.0,"a":3,"zz":1,"Z":2,"～":"y","\U0001f600":1}', '{"z":1}', '{"items":[true,1,null]}',
    "[]", "[[1,2],[1,2]]", "[1,1.0]", "[[0.6,5,-2,0.7],[4.99]]", '["a","b","a"]', "[null,false,true]", '"1"', '"12a"', '"1234"', '"١١"', '"12\\n"', '"x\\ud83d\\ude00"',
    "0", "-0.0", "2", "3", "4.0", "12", "1e1", "123456789012345678", "12345678901234567890123", "0.1234567890123456789", "1e-9", "0.000000001",
    '{"properties":{"items":"q"}}', '{"properties":{"items":5}}', '{"a":{"a":1}}', "null", "true", "false", '"a"', "", " ", "{", "nul", "[1,]", "1 2", "NaN", '{"a":1}}', '"\x01"', "[" * 600 + "]" * 600,
]


def test_plain_payloads_have_the_findings_of_their_nodes(spark, monkeypatch):
    schemas = spark.createDataFrame([(str(i), "json", json.dumps(s)) for i, s in enumerate(SCHEMAS)] + [("torn", "json", "{")], "schema_id string, format string, body string")
    asked = [(f"{s}-{i}", str(s), d) for s in [*range(len(SCHEMAS)), "torn", "gone"] for i, d in enumerate(DOCS)]
    messages = spark.createDataFrame(asked, "message_id string, schema_id string, body string").repartition(4)
    rules = rules_of(schemas)
    judged = lambda: {r.message_id: ([tuple(f) for f in r.findings], r.verdict) for r in check_payloads(messages, rules, rules_depth(rules)).collect()}
    plain = judged()
    calls = []
    left = lambda text, rules: calls.append(1) or F.lit(None).cast(validation.FINDING_TYPE)
    monkeypatch.setattr(validation, "plain_findings", left)
    assert plain == judged() and calls and len(plain) == len(asked)


def test_a_split_judges_once(spark):
    messages = spark.range(20).selectExpr("id as message_id", "cast(null as map<string,struct<kind:string,bytes:binary>>) as headers", "'' as exchange", "'' as routing_key",
                                          "if(id % 2 = 0, 'Observed', 'Valid') as outcome", "3 as mode", "'c' as code", "'' as detail")
    seen = spark.sparkContext.accumulator(0)
    count = F.udf(lambda x: seen.add(1) or x).asNondeterministic()
    through, stopped = conformance.quarantine_split(messages.withColumn("detail", count("detail")))
    assert through.count() == 10 and stopped.count() == 10 and seen.value == 20


def test_few_payloads_are_left_to_spark(spark):
    schemas = spark.createDataFrame([(str(i), "json", json.dumps(s)) for i, s in enumerate(SCHEMAS)], "schema_id string, format string, body string")
    rules = validation.packed(rules_of(schemas)).select("schema_id", "rules")
    docs = spark.createDataFrame([(d,) for d in ('{"a":1}', "[1,1.5]", '"12a"', "{", "1e1")], "body string")
    found = rules.crossJoin(docs).withColumn("f", validation.plain_findings(F.col("body"), F.col("rules")))
    left = {(r.schema_id, r.body) for r in found.where("f is null").collect()}
    assert {d for _, d in left if d in ("{", "1e1")} == {"{", "1e1"}
    assert {s for s, d in left if d not in ("{", "1e1")} <= {"4", "6", "7", "8"}

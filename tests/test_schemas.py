import json
from functools import partial

import pytest
from pyspark.sql import functions as F

from pactlake.operators import catalog, graph
from pactlake.operators.avro_diff import avro_diff, avro_types
from pactlake.operators.bundle import bundle_schemas
from pactlake.operators.canonical import canonical_text, catalog_canonical_audit
from pactlake.operators.compatibility import compatibility_audit, compatibility_check
from pactlake.operators.json_diff import diff_json_pairs, json_schema_diff
from pactlake.operators.nodes import schema_nodes
from pactlake.operators.running import before
from pactlake.operators.validation import check_payloads, rules_depth, rules_of, validate_payloads

SCHEMAS = "schema_id string, format string, body string"


def catalog_of(spark, bodies):
    return spark.createDataFrame([(k, "json", json.dumps(b) if not isinstance(b, str) else b) for k, b in bodies.items()], SCHEMAS)


PAYLOADS = [
    # schema, accepted, rejected
    ({"properties": {"any": True, "none": False}}, ['{"any":[1]}', "{}"], ['{"none":null}']),
    ({"properties": {"v": {"enum": [2, "x", None, {"k": [1.0]}]}}}, ['{"v":2.0}', '{"v":"x"}', '{"v":null}', '{"v":{"k":[1]}}'], ['{"v":"2"}', '{"v":false}']),
    ({"properties": {"n": {"type": "integer"}}}, ['{"n":4}', '{"n":4.0}', '{"n":4e1}'], ['{"n":4.5}', '{"n":"4"}', '{"n":true}']),
    ({"properties": {"s": {"type": ["string", "null"]}}}, ['{"s":null}', '{"s":""}'], ['{"s":3}']),
    ({"required": ["id", "a/b"]}, ['{"id":null,"a/b":0}', "[]", "7"], ['{"id":1}', "{}"]),
    ({"type": "object", "properties": {"a": {}}, "additionalProperties": False}, ['{"a":1}', "{}"], ['{"a":1,"b":2}', "[]"]),
    ({"properties": {"s": {"pattern": "b+c"}}}, ['{"s":"abbc!"}', '{"s":5}'], ['{"s":"ac"}', '{"s":""}']),
    ({"properties": {"s": {"maxLength": 2, "minLength": 1}}}, ['{"s":"😀😀"}', '{"s":7}'], ['{"s":"abc"}', '{"s":""}']),
    ({"properties": {"x": {"uniqueItems": True, "minItems": 1, "maxItems": 2}}}, ['{"x":[1,"1"]}', '{"x":{}}'], ['{"x":[1,1.0]}', '{"x":[{"a":1,"b":2},{"b":2,"a":1}]}', '{"x":[]}', '{"x":[1,2,3]}']),
    ({"properties": {"o": {"properties": {"l": {"items": {"required": ["k"], "type": "object"}}}}}}, ['{"o":{"l":[{"k":1}]}}', '{"o":{"l":[]}}', '{"o":1}'], ['{"o":{"l":[{}]}}', '{"o":{"l":[1]}}']),
    ({"minimum": 1, "exclusiveMaximum": 3, "multipleOf": 0.5}, ["1", "2.5", '"z"'], ["0.5", "3", "2.25"]),
    ({"const": {"a": [1]}}, ['{"a":[1.0]}'], ['{"a":[2]}', '{"a":1}']),
    ({"type": "object"}, ['{"a":1,"a":2}'], ["", "  ", "{", "nul", '{"a":1,}']),
]


def test_payload_cases(spark):
    schemas = catalog_of(spark, {str(i): c[0] for i, c in enumerate(PAYLOADS)})
    rows = [(str(i), d, ok) for i, c in enumerate(PAYLOADS) for ok, docs in ((True, c[1]), (False, c[2])) for d in docs]
    df = spark.createDataFrame(rows, "schema_id string, body string, want boolean").withColumn("message_id", F.monotonically_increasing_id())
    rules = rules_of(schemas)
    for r in check_payloads(df, rules, rules_depth(rules)).collect():
        assert (r.verdict == "valid") == r.want, r


def test_payload_special_outcomes(spark):
    schemas = catalog_of(spark, {"any": {"anyOf": [{}]}, "look": {"pattern": "(?=a)"}, "ok": {"type": "string"}}).unionByName(
        spark.createDataFrame([("av", "avro", '"string"')], SCHEMAS))
    rows = [(1, "any", b"{}"), (2, "look", b'"b"'), (3, "ok", b"\xff"), (4, "av", b"anything"), (5, "gone", b"{}"), (6, "ok", b'"' + b"x" * (10 << 20) + b'"')]
    df = spark.createDataFrame(rows, "message_id long, schema_id string, body binary")
    rules = rules_of(schemas)
    got = {r.message_id: (r.verdict, [f.kind for f in r.findings]) for r in check_payloads(df, rules, 1).drop("body").collect()}
    assert got == {
        1: ("unsupported_keyword", []), 2: ("unsupported_keyword", []), 3: ("invalid", ["invalid_utf8"]), 4: ("valid", []), 5: (None, []),
        6: ("invalid", ["payload_too_large"]),
    }


def test_findings_name_place_and_kind(spark):
    schemas = catalog_of(spark, {"s": {"properties": {"l": {"items": {"maximum": 3}}}, "required": ["q~r"]}})
    df = spark.createDataFrame([(1, "s", '{"l":[1,9,8]}')], "message_id long, schema_id string, body string")
    got = {(r.path, r.kind) for r in validate_payloads(df, schemas).collect()}
    assert got == {("#/q~0r", "PropertyRequired"), ("#/l/1", "NumberTooBig"), ("#/l/2", "NumberTooBig")}


DIFFS = [
    # before, after, content model -> (path, kind, direction, surface)
    ({"type": "integer"}, {"type": "number"}, "Open", {("#", "integer_widened_to_number", "Backward", 3)}),
    ({"type": ["integer", "null"]}, {"type": ["number"]}, "Open", {("#", "type_narrowed", "Backward", 2), ("#", "type_widened", "Forward", 2)}),
    ({"type": "string"}, {}, "Open", set()),
    ({"enum": [1, "a"]}, {"enum": [1.0, "a", "b"]}, "Open", {("#", "enum_value_removed", "Backward", 2), ("#", "enum_value_added", "Forward", 2)}),
    ({"enum": [1]}, {}, "Open", set()),
    ({"required": ["a"]}, {"required": ["b"]}, "Open", {("#/required", "required_field_added", "Backward", 2), ("#/required", "required_field_removed", "Forward", 2)}),
    ({"maximum": 5}, {"maximum": 4}, "Open", {("#/maximum", "numeric_range_narrowed", "Backward", 2)}),
    ({"minLength": 5}, {"minLength": 4}, "Open", {("#/minLength", "numeric_range_widened", "Forward", 2)}),
    ({}, {"maxItems": 1, "minimum": 0}, "Open", {("#/maxItems", "numeric_range_narrowed", "Backward", 2), ("#/minimum", "numeric_range_narrowed", "Backward", 2)}),
    ({"exclusiveMinimum": 1.0}, {"exclusiveMinimum": 1}, "Open", set()),
    ({"pattern": "a"}, {"pattern": "b"}, "Open", {("#/pattern", "string_constraint_narrowed", "Backward", 2)}),
    ({"pattern": "a"}, {}, "Open", {("#/pattern", "string_constraint_widened", "Forward", 2)}),
    ({}, {"additionalProperties": False}, "Open", {("#/additionalProperties", "additional_properties_closed", "Backward", 2)}),
    ({"additionalProperties": False}, {"additionalProperties": {}}, "Open", {("#/additionalProperties", "additional_properties_opened", "Forward", 2)}),
    ({"format": "date"}, {}, "Open", {("#/format", "format_changed", "Backward", 3)}),
    ({"properties": {"a": {}}}, {"properties": {"b": {}}}, "Open", set()),
    ({"properties": {"a/x": {}}}, {"properties": {"b": True}}, "Closed", {("#/properties/a~1x", "property_removed", "Backward", 2), ("#/properties/b", "property_added", "Forward", 2)}),
    ({"properties": {"type": {"type": "string"}}}, {"properties": {"type": {"type": "null"}}}, "Open",
     {("#/properties/type", "type_narrowed", "Backward", 2), ("#/properties/type", "type_widened", "Forward", 2)}),
    ({"items": {"properties": {"p": {"maximum": 1}}}}, {"items": {"properties": {"p": {"maximum": 2}}}}, "Open",
     {("#/items/properties/p/maximum", "numeric_range_widened", "Forward", 2)}),
    ({"properties": {"p": True}}, {"properties": {"p": {"type": "string"}}}, "Open", set()),
    ({"anyOf": [{"type": "string"}]}, {"anyOf": [{"type": "null"}]}, "Open", set()),
]


def test_json_diffs(spark):
    bodies = {f"{side}{i}": c[k] for i, c in enumerate(DIFFS) for k, side in ((0, "b"), (1, "a"))}
    pairs = spark.createDataFrame([(f"b{i}", f"a{i}", c[2]) for i, c in enumerate(DIFFS)], "prev_id string, next_id string, content_model string")
    got = {}
    for r in json_schema_diff(pairs, rules_of(catalog_of(spark, bodies))).collect():
        got.setdefault(r.prev_id, set()).add((r.path, r.kind, r.direction, r.surface))
    for i, c in enumerate(DIFFS):
        assert got.get(f"b{i}", set()) == c[3], c


MAXIMA = [5, 7, 3, 7, 9, 3, 8, 5]


@pytest.mark.parametrize("mode", ["BACKWARD", "FORWARD", "FULL", "BACKWARD_TRANSITIVE", "FORWARD_TRANSITIVE", "FULL_TRANSITIVE", "NONE"])
def test_audit_equals_brute_force(spark, mode):
    statuses = ["Active", "Rejected", "Active", "AwaitingApproval", "Active", "Active", "Active", "Active"]
    schemas = catalog_of(spark, {str(m): {"maximum": m} for m in set(MAXIMA)})
    versions = spark.createDataFrame([("e", "s", i + 1, str(m), s) for i, (m, s) in enumerate(zip(MAXIMA, statuses))],
                                     "environment_id string, subject string, ordinal int, schema_id string, status string")
    policy = spark.createDataFrame([("e", "s", "Open", mode, 2)], "environment_id string, subject string, content_model string, mode string, surface int")
    differ = partial(diff_json_pairs, rules=rules_of(schemas))
    got = {r.ordinal: (r.compatible, r.bump, r.conflicts_with) for r in compatibility_audit(versions, policy, differ).collect()}
    for i, m in enumerate(MAXIMA):
        priors = [(j + 1, MAXIMA[j]) for j in range(i) if statuses[j] == "Active"]
        if mode == "NONE" or not priors:
            assert got[i + 1] == (True, "None", None)
            continue
        used = priors if mode.endswith("TRANSITIVE") else priors[-1:]
        hits = [o for o, p in used if (m < p and not mode.startswith("FORWARD")) or (m > p and not mode.startswith("BACKWARD"))]
        assert got[i + 1] == (not hits, "Major" if hits else "Patch", min(hits, default=None)), (mode, i)


def test_transitive_check_sees_what_latest_hides(spark):
    schemas = catalog_of(spark, {"wide": {"type": ["string", "null"]}, "narrow": {"type": "string"}})
    versions = spark.createDataFrame([("e", "s", 1, "wide", "Active"), ("e", "s", 2, "narrow", "Active")],
                                     "environment_id string, subject string, ordinal int, schema_id string, status string")
    asked = spark.createDataFrame([("e", "s", "narrow")], "environment_id string, subject string, schema_id string")
    differ = partial(diff_json_pairs, rules=rules_of(schemas))
    for mode, want in (("BACKWARD", True), ("BACKWARD_TRANSITIVE", False)):
        policy = spark.createDataFrame([("e", "s", "Open", mode, 2)], "environment_id string, subject string, content_model string, mode string, surface int")
        verdicts, changes = compatibility_check(asked, versions, policy, differ)
        assert verdicts.first().compatible == want
        assert [r.conflicts_with for r in changes.collect()] == ([] if want else [1])


def test_running_blocks_equal_one_window(spark):
    rows = [("k", i, (i * 7) % 11 if i % 3 else None) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, o int, x int")
    for how, block in (("last", 4), ("max", 7), ("last", 1000)):
        got = {r.o: r.p for r in before(df, ["k"], "o", "p", F.col("x"), how, block).collect()}
        seen = []
        for _, o, x in rows:
            want = None if not seen else seen[-1] if how == "last" else max(seen)
            assert got[o] == want
            if x is not None:
                seen.append(x)


AVRO = [
    ('"int"', '"double"', {("#", "type_promoted", "Backward", 3), ("#", "type_widened", "Forward", 1)}),
    ('["null","int"]', '"int"', {("#", "type_narrowed", "Backward", 1)}),
    ('{"type":"record","name":"a.R","fields":[]}', '{"type":"record","name":"a.S","aliases":["R"],"fields":[]}', {("#", "name_changed", "Forward", 1)}),
    ('{"type":"array","items":"string"}', '{"type":"array","items":"bytes"}', {("#/items", "type_promoted", "Backward", 3), ("#/items", "type_promoted", "Forward", 3)}),
    ('{"type":"map","values":"int"}', '{"type":"array","items":"int"}', {("#", "type_narrowed", "Backward", 1), ("#", "type_widened", "Forward", 1)}),
    # Y is met first inside a.f, so its change is reported there and not again under b
    ('{"type":"record","name":"X","fields":[{"name":"a","type":{"type":"record","name":"W","fields":[{"name":"f","type":{"type":"record","name":"Y","fields":[{"name":"v","type":"int"}]}}]}},{"name":"b","type":"Y"}]}',
     '{"type":"record","name":"X","fields":[{"name":"a","type":{"type":"record","name":"W","fields":[{"name":"f","type":{"type":"record","name":"Y","fields":[{"name":"v","type":"boolean"}]}}]}},{"name":"b","type":"Y"}]}',
     {("#/fields/a/fields/f/fields/v", "type_narrowed", "Backward", 1), ("#/fields/a/fields/f/fields/v", "type_widened", "Forward", 1)}),
    ('{"type":"record","name":"N","fields":[{"name":"next","type":["null","N"]},{"name":"v","type":"int"}]}',
     '{"type":"record","name":"N","fields":[{"name":"next","type":["null","N"]},{"name":"v","type":"long"}]}',
     {("#/fields/v", "type_promoted", "Backward", 3), ("#/fields/v", "type_widened", "Forward", 1)}),
]


def test_avro_resolution(spark):
    docs = [(f"{side}{i}", canonical_text("avro", c[k])[0]) for i, c in enumerate(AVRO) for k, side in ((0, "b"), (1, "a"))]
    pairs = spark.createDataFrame([(f"b{i}", f"a{i}") for i in range(len(AVRO))], "prev_id string, next_id string")
    got = {}
    for r in avro_diff(pairs, avro_types(spark.createDataFrame(docs, "schema_id string, canonical string"))).collect():
        got.setdefault(r.prev_id, []).append((r.path, r.kind, r.direction, r.surface))
    for i, c in enumerate(AVRO):
        assert sorted(got.get(f"b{i}", [])) == sorted(c[2]), (i, got.get(f"b{i}"))


def test_canonical_texts():
    ok = {
        '{"b":1.0,"a":[3,1e5],"$ref":"HTTP://X.org:80/a/./b"}': '{"$ref":"http://x.org/a/b","a":[3,1e5],"b":1.0}',
        '{"t":"q\\"\\u0001\\u00e9/😀"}': '{"t":"q\\"\\u0001é/\\uD83D\\uDE00"}',
        ' { "$id" : "rel/path" } ': '{"$id":"rel/path"}',
    }
    for text, want in ok.items():
        assert canonical_text("json", text) == (want, None)
        assert canonical_text("json", want) == (want, None)
    bad = {'{"a":1,"a":1}': "schema_malformed", "{": "schema_malformed", " ": "schema_body_empty", "NaN": "schema_malformed", '"' + "é" * (256 * 1024) + '"': "schema_too_large"}
    for text, code in bad.items():
        assert canonical_text("json", text) == (None, code)
    avro = '{"namespace":"n","type":"error","name":"R","z":1,"fields":[{"type":{"type":"int"},"name":"i","order":"ascending"},{"name":"e","type":{"type":"enum","symbols":["S"],"name":"E","aliases":["F"]}}]}'
    want = '{"name":"n.R","type":"record","fields":[{"name":"i","type":"int","order":"ascending"},{"name":"e","type":{"name":"n.E","type":"enum","symbols":["S"],"aliases":["n.F"]}}],"z":1}'
    assert canonical_text("avro", avro) == (want, None)
    assert canonical_text("avro", want) == (want, None)
    assert canonical_text("avro", '{"type":"record","fields":[]}') == (None, "schema_malformed")


def test_spellings_share_an_id(spark):
    rows = [("json", '{"a":1,"b":2}'), ("json", ' {"b":2,"a":1} '), ("json", '{"a":1.0,"b":2}'), ("avro", '"int"'), ("json", "{")]
    audit = catalog_canonical_audit(spark.createDataFrame(rows, "format string, body string"))
    found = {(r.documents, r.spellings) for r in catalog.dedupe_catalog(audit).collect()}
    assert found == {(2, 2), (1, 1)} and audit.where("error_code = 'schema_malformed'").count() == 1


def test_drift_finds_the_first_difference(spark):
    bodies = {
        "l1": {"a": {"x": 1}, "required": ["p", "q"]}, "r1": {"required": ["q", "p"], "a": {"x": 1.0}},
        "l2": {"b": 1, "a": {"y": 2, "x": 1}}, "r2": {"a": {"x": 2, "y": 2}, "c": 0},
        "l3": {"e": [1, 2]}, "r3": {"e": [2, 1]},
    }
    nodes = schema_nodes(catalog_of(spark, bodies))
    side = lambda s: spark.createDataFrame([(f"s{i}", f"{s}{i}") for i in (1, 2, 3)], "subject string, schema_id string")
    got = {r.subject: (r.path, r.change) for r in catalog.contract_drift(side("l"), side("r"), nodes, nodes).collect()}
    assert got == {"s2": ("#/a/x", "differs"), "s3": ("#/e", "differs")}


def test_graph_equals_brute_force(spark):
    links = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (6, 6), (7, 4), (8, 7), (5, 9), (9, 5)]
    edges = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in links], "src string, dst string")
    want, grown = set(links), True
    while grown:
        new = {(a, d) for a, b in want for c, d in links if b == c} - want
        grown = bool(new)
        want |= new
    got = {(r.referrer, r.target) for r in graph.transitive_referrers(edges).collect()}
    assert got == {(f"n{a}", f"n{b}") for a, b in want}
    cycles = {tuple(r.path) for r in graph.reference_cycles(edges).collect()}
    assert cycles == {("n1", "n2", "n3", "n1"), ("n6", "n6"), ("n5", "n9", "n5")}


def test_bundles_hold_everything_they_name(spark):
    ref = lambda s, v: {"$ref": f"contract://main/{s}/{v}"}
    bodies = {"i1": {"p": ref("a.B", 1)}, "i2": {"q": ref("a.C", 1), "n": 1.0}, "i3": {"type": "string"}, "i4": {"r": ref("a.Gone", 1)}}
    schemas = spark.createDataFrame([(k, "json", json.dumps(b), "main", s, 1) for (k, b), s in zip(bodies.items(), ["a.A", "a.B", "a.C", "a.D"])],
                                    SCHEMAS + ", environment_id string, subject string, ordinal int")
    found, errors = catalog.extract_references(schema_nodes(schemas))
    got = {r.schema_id: r for r in bundle_schemas(schemas, graph.version_edges(schemas, found)).collect()}
    assert json.loads(got["i1"].body) == {
        "p": {"$ref": "#/$defs/a.B__1"}, "$defs": {"a.B__1": {"q": {"$ref": "#/$defs/a.C__1"}, "n": 1.0}, "a.C__1": {"type": "string"}},
    }
    assert got["i3"].body == '{"type":"string"}' and got["i4"].error_code == "reference_invalid" and got["i4"].body is None
    assert errors.count() == 0


def test_a_bundle_reads_its_edges_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    schemas = spark.createDataFrame([("i1", "json", '{"$ref":"b"}'), ("i2", "json", '{"type":"string"}')], SCHEMAS)
    edges = spark.createDataFrame([("i1", "i2", "b", "a.B", 1)], "src string, dst string, name string, subject string, version int")
    got = {r.schema_id: r for r in bundle_schemas(schemas, edges.mapInPandas(counted, edges.schema)).collect()}
    assert json.loads(got["i1"].body) == {"$ref": "#/$defs/a.B__1", "$defs": {"a.B__1": {"type": "string"}}}
    assert got["i2"].inlined == 0 and read.value == 1

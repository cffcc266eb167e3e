from pyspark.sql import functions as F

from pactlake import Wire
from pactlake.operators.decoding import content_type_of, decode_envelopes, resolve_subjects, stamp_envelopes
from pactlake.operators.routing import binding_conflicts, resolve_consume, resolve_publish

W = Wire()
ID = "0123456789abcdef0123456789abcdef"
SCHEMA = "message_id long, properties_type string, content_type string, headers map<string,struct<kind:string,bytes:binary>>"


def h(**kw):
    """Header map from short names; a value is text, raw bytes, or None for a wrong kind."""
    names = {"v": W.version, "i": W.schema_id, "s": W.subject, "o": W.ordinal, "m": W.semver, "f": W.format}
    out = {}
    for k, x in kw.items():
        kind = "other" if x is None else "bytes" if isinstance(x, bytes) else "string"
        out[names.get(k, k)] = (kind, bytearray(b"1" if x is None else x if isinstance(x, bytes) else x.encode()))
    return out


CASES = [
    # properties type, content type, headers -> kind, subject, ordinal, semver, format, warnings, error
    (None, None, None, ("none", None, None, None, None, [], None)),
    (None, None, {}, ("none", None, None, None, None, [], None)),
    (None, None, h(other="x"), ("none", None, None, None, None, [], None)),
    (None, "application/json", None, ("none", None, None, None, None, [], None)),
    (None, None, h(v=""), ("none", None, None, None, None, [], "envelope_malformed")),
    (None, None, h(v="3", i="?"), ("none", None, None, None, None, [], "envelope_version_unsupported")),
    (None, None, h(v="1"), ("none", None, None, None, None, [], "envelope_schema_id_missing")),
    (None, None, h(v="1", i=ID.upper()), ("none", None, None, None, None, [], "schema_id_malformed")),
    (None, None, h(v="1", i=None), ("none", None, None, None, None, [], "envelope_header_type_invalid")),
    (None, None, h(v="1", i=b"\xff\xfe"), ("none", None, None, None, None, [], "envelope_header_encoding_invalid")),
    (None, None, h(v="﻿1", i=ID), ("none", None, None, None, None, [], "envelope_header_encoding_invalid")),
    (None, None, h(v=b"1", i=ID.encode()), ("headers", None, None, None, None, [], None)),
    (None, None, h(v="1", i=ID, f="yaml"), ("none", None, None, None, None, [], "envelope_format_unknown")),
    ("t.A", None, h(v="1", i=ID, f="avro"), ("headers", "t.A", None, None, "avro", [], None)),
    ("t.A", None, h(v="1", i=ID, s="t.B"), ("headers", "t.B", None, None, None, ["envelope_subject_type_mismatch"], None)),
    ("t.A", None, h(v="1", i=ID, s=" t.B"), ("headers", None, None, None, None, ["subject_name_invalid"], None)),
    ("t.A", None, h(v="1", i=ID, s=b"\xff"), ("headers", "t.A", None, None, None, ["envelope_header_encoding_invalid"], None)),
    ("t..A", None, h(v="1", i=ID), ("headers", None, None, None, None, ["subject_name_invalid"], None)),
    (None, None, h(v="1", i=ID, o="12", m="2.0.0-rc.1"), ("headers", None, 12, "2.0.0-rc.1", None, [], None)),
    (None, None, h(v="1", i=ID, o="0", m=" 1.0.0"), ("headers", None, None, None, None, ["envelope_ordinal_malformed", "semver_invalid"], None)),
    (None, None, h(v="1", i=ID, o="+1", m="1.0.0+b"), ("headers", None, None, None, None, ["envelope_ordinal_malformed", "semver_build_metadata_unsupported"], None)),
    (None, None, h(v="1", i=ID, o=None, m=None), ("headers", None, None, None, None, ["envelope_ordinal_malformed", "envelope_malformed"], None)),
    ("t.A", f"application/avro{W.content_marker}{ID}", None, ("content_type", "t.A", None, None, "avro", [], None)),
    (" t.A", f"text/odd{W.content_marker}{ID}", None, ("content_type", None, None, None, None, ["subject_name_invalid"], None)),
    (None, f"application/json{W.content_marker}{ID}0", None, ("none", None, None, None, None, [], None)),
    (None, f"application/json{W.content_marker}{'f' * 32}", h(v="1", i=ID), ("headers", None, None, None, None, [], None)),
]


def test_decode(spark):
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(CASES)], SCHEMA)
    for r in decode_envelopes(df).collect():
        got = (r.kind, r.subject, r.ordinal, r.semver, r.format, r.warnings, r.error_code)
        assert got == CASES[r.message_id][3], (r.message_id, got)
        assert (r.schema_id is not None) == (r.kind != "none")


def test_another_prefix_is_another_envelope(spark):
    other = Wire("acme")
    df = spark.createDataFrame([(1, None, None, h(**{other.version: "1", other.schema_id: ID}))], SCHEMA)
    assert decode_envelopes(df).first().kind == "none"
    assert decode_envelopes(df, other).first().kind == "headers"


def test_stamp_round_trip(spark):
    df = spark.createDataFrame([(1, None, None, h(keep="k", s="old.One")), (2, None, None, None), (3, None, None, h(keep="k"))], SCHEMA)
    ids = F.when(F.col("message_id") < 3, F.lit(ID))
    df = df.select("*", ids.alias("schema_id"), F.when(F.col("message_id") == 1, "a.B").alias("subject"),
                   F.lit(1234567).alias("ordinal"), F.lit(None).cast("string").alias("semver"), F.lit("json").alias("format"))
    out = {r.message_id: r for r in stamp_envelopes(df).collect()}
    text = lambda i: {k: bytes(v["bytes"]).decode() for k, v in out[i].headers.items()}
    assert text(1) == {"keep": "k", W.version: "1", W.schema_id: ID, W.subject: "a.B", W.ordinal: "1234567", W.format: "json"}
    assert W.subject not in text(2) and text(2)[W.schema_id] == ID
    assert text(3) == {"keep": "k"}
    typed = spark.range(1).select(content_type_of(F.lit("json"), F.lit(ID)).alias("c")).first().c
    assert typed == f"application/json{W.content_marker}{ID}"


def test_resolve_subjects(spark):
    cases = {
        "n.A": ("resolved", "n.A"), " n.A , Asm": ("resolved", "n.A"), "n.A+B": ("resolved", "n.A.B"), "  ": ("absent", None), None: ("absent", None),
        "n.a-b": ("unusable", None), "N.Box`1[[N.X, A]]": ("resolved", "N.Box_of_N.X"), "N.Open`1": ("unusable", None),
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "message_id long, properties_type string")
    got = {r.properties_type: (r.subject_outcome, r.resolved_subject) for r in resolve_subjects(df).collect()}
    assert got == cases


BIND = "contract string, seq int, broker_id string, virtual_host string, exchange string, pattern string, precedence int, subjects array<struct<subject:string,selector:string>>"


def test_resolve_publish_combines(spark):
    a, b, c = [("s.A", "latest")], [("s.B", " >= 2 ")], [("s.C", "1"), ("s.A", "LATEST")]
    bindings = spark.createDataFrame(
        [("k1", 1, None, "/", "x", "o.#", None, a), ("k1", 2, None, "/", "x", "o.new", 5, b), ("k1", 3, "b2", "/", "x", "#", 9, c),
         ("k0", 1, None, "/", "x", "*.new", None, c), ("k2", 1, None, "/", "y", "#", None, a)], BIND)
    contracts = spark.createDataFrame([("k1", 2), ("k0", 3), ("k2", 1)], "contract string, enforcement int")
    routes = spark.createDataFrame(
        [("b1", "/", "x", "o.new"), ("b2", None, "x", "o.new"), ("b1", "/", "x", "o.*"), ("b1", "/", "z", "o")],
        "broker_id string, virtual_host string, exchange string, routing_key string")
    got = {(r.broker_id, r.routing_key): r for r in resolve_publish(routes, contracts, bindings).collect()}
    one = got["b1", "o.new"]
    assert (one.contracts, one.enforcement) == (["k0", "k1"], 3)
    assert [tuple(s) for s in one.subjects] == [("s.C", "1"), ("s.A", "latest"), ("s.B", ">=2")]
    assert [tuple(s) for s in got["b2", "o.new"].subjects] == [("s.C", "1"), ("s.A", "latest")]
    # a key word that is a wildcard matches both ways, so 'o.*' meets '*.new' and 'o.new'
    assert got["b1", "o.*"].contracts == ["k0", "k1"]
    assert ("b1", "o") not in got

    queues = spark.createDataFrame([("b1", "/", "q"), ("b9", "/", "q")], "broker_id string, virtual_host string, queue string")
    consume = spark.createDataFrame(
        [("k1", 2, None, "/", "q", a), ("k1", 1, "b9", "/", "q", b)],
        "contract string, seq int, broker_id string, virtual_host string, queue string, subjects array<struct<subject:string,selector:string>>")
    first = {r.broker_id: [tuple(s) for s in r.subjects] for r in resolve_consume(queues, contracts, consume).collect()}
    assert first == {"b1": [("s.A", "latest")], "b9": [("s.B", ">=2")]}


def test_binding_conflicts_equal_brute_force(spark):
    from test_functions import brute

    a, b, a2 = [("s.A", "latest"), ("s.B", "1")], [("s.A", "latest")], [("s.B", "1"), ("s.A", "latest")]
    patterns = ["o.*", "o.new", "#", "p.x", "*.x", "o.#"]
    rows = [
        (f"k{i % 2}", i, [None, "b1", "b2"][i % 3], "/", "x", patterns[i % 6], [None, 1, 2, 1][i % 4], [a, b, a2][i % 5 % 3])
        for i in range(40)
    ]

    def clash(x, y):
        scope = x[2] is None or y[2] is None or x[2] == y[2]
        apart = x[6] is not None and y[6] is not None and x[6] != y[6]
        return x[0] == y[0] and x[1] < y[1] and scope and not apart and sorted(x[7]) != sorted(y[7]) and brute(x[5].split("."), y[5].split("."))

    want = {(y[0], y[1], min(x[1] for x in rows if clash(x, y))) for y in rows if any(clash(x, y) for x in rows)}
    none = spark.createDataFrame([], "contract string, seq int, broker_id string, virtual_host string, queue string, subjects array<struct<subject:string,selector:string>>")
    got = binding_conflicts(spark.createDataFrame(rows, BIND), none).collect()
    assert {(r.contract, r.seq, r.clashes_with) for r in got} == want and len(got) == len(want) > 0

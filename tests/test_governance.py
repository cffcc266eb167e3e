import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from pactlake.operators import governance, inference, notifications, violations
from pactlake.sources import contract_files, export_latest, read_contract_dir, read_messages, sample_queue


def at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


REPORT = "ts timestamp, seq long, environment_id string, side string, route string, subject string, code string, detail string, reported_by string, occurrences long"


def reports(spark):
    return spark.createDataFrame([
        (at(0), 1, "e", "publish", " r ", "s", "c", "early", "svc", 0),      # too early: counts nothing, opens nothing
        (at(1), 2, "e", "PUBLISH", "r", "s", "c", None, None, 2),
        (at(2), 3, "e", " Publish", "r", " s ", " c ", " late ", "svc2", -5),
        (at(3), 4, "e", "publish", "r", "s", "c", "  ", "", 3),
        (at(4), 5, "e", "consume", "r", None, "c", "d" * 2000, "x" * 300, 1),
        (at(5), 6, "e", "sideways", "r", "s", "c", "x", "y", 1),
        (at(6), 7, "e", "publish", "", "s", "c", "x", "y", 1),
        (at(7), 8, "e", "publish", "only-zero", "s", "c", "x", "y", 0),
    ], REPORT)


def test_rollup(spark):
    got = {r.side: r for r in violations.violation_rollup(reports(spark)).collect()}
    one = got["PUBLISH"]
    assert (one.occurrences, one.detail, one.reported_by, one.first_seen_at, one.last_seen_at) == (5, "late", "svc2", at(1), at(3))
    two = got["CONSUME"]
    assert (len(two.detail), len(two.reported_by), two.fingerprint) == (1024, 128, "e|2|r|-|c") and len(got) == 2
    totals = violations.report_outcomes(reports(spark)).first()
    assert (totals.accepted, totals.opened, totals.rejected) == (4, 2, 4)


def test_flush_keeps_first_keys_and_counts_the_rest(spark):
    rows = [(at(0) + dt.timedelta(seconds=i), i, "PUBLISH", "r", "s", "c", f"d{i % 300}", "rep") for i in range(900)]
    df = spark.createDataFrame(rows, "ts timestamp, message_id long, side string, route string, subject string, code string, detail string, reported_by string")
    kept, dropped = violations.violation_flush_windows(df, "1 hour", keys=256)
    assert {r.detail for r in kept.collect()} == {f"d{i}" for i in range(256)}
    assert (dropped.first().keys, dropped.first().dropped) == (300, 44 * 3)
    kept, dropped = violations.violation_flush_windows(df, "1 hour")
    assert sorted((r.detail, r.n) for r in kept.collect()) == sorted((f"d{i}", 3) for i in range(300))
    assert (dropped.first().keys, dropped.first().dropped) == (300, 0)


def test_many_deliveries_are_dealt_out_by_their_number(spark, monkeypatch):
    """Few events with many subscriptions are many deliveries: they go to several tasks."""
    monkeypatch.setattr(notifications, "DELIVERIES", 1000, raising=False)
    monkeypatch.setattr(notifications, "FEWEST", 10, raising=False)
    events = spark.range(400).select(F.concat(F.lit("o"), "id").alias("outbox_id"), F.lit("env0").alias("environment_id"), F.lit("E").alias("event"))
    subs = spark.range(50).select(
        F.concat(F.lit("n"), "id").alias("subscription_id"), F.lit("env0").alias("environment_id"), F.lit(True).alias("enabled"), F.lit("").alias("events")
    )
    got, unwanted = notifications.notification_fanout(events, subs)
    assert got.distinct().count() == got.count() == 400 * 50 and unwanted.isEmpty()
    tasks = got.groupBy(F.spark_partition_id()).count()
    assert tasks.count() > 8 and tasks.agg(F.max("count")).first()[0] < 400 * 50 // 3


def test_a_hot_environment_is_dealt_out(spark):
    """One environment has a third of all events: no deal of a key has much more than its share of them."""
    events = spark.range(3000).selectExpr("cast(id as string) as outbox_id", "case when id % 3 = 0 then 'hot' else concat('e', id % 40) end as environment_id", "concat('K', id % 2) as event")
    rows = [("hot", f"s{i}", True, ["", "K0", "K1,K0", "K9"][i % 4]) for i in range(8)] + [("e1", "x", True, "K1"), ("e2", "y", False, "")]
    subs = spark.createDataFrame(rows, "environment_id string, subscription_id string, enabled boolean, events string")
    got, unwanted = notifications.notification_fanout(events, subs, share=50)
    plain, same = notifications.notification_fanout(events, subs)
    assert got.count() == plain.count() == got.distinct().count() and got.exceptAll(plain).count() == unwanted.exceptAll(same).count() == 0
    asked = events.select("environment_id", "outbox_id", F.explode(F.array("event", F.lit("*"))).alias("want"))
    wants = spark.createDataFrame([("hot", "*"), ("hot", "K0"), ("e1", "K1")], "environment_id string, want string")
    dealt, repeated = notifications._dealt(asked, wants, 50)
    assert dealt.groupBy("environment_id", "want", "deal").count().agg(F.max("count")).first()[0] < 100
    assert {r.want: r["count"] for r in repeated.where("environment_id = 'hot'").groupBy("want").count().collect()} == {"*": 20, "K0": 10}


def test_retry_waits(spark):
    rows = [("a", i, at(i), False) for i in range(3)] + [("b", i, at(i), False) for i in range(7)] + [("c", 0, at(0), False), ("c", 1, at(1), True), ("c", 2, at(2), False)]
    df = spark.createDataFrame(rows, "outbox_id string, seq long, at timestamp, succeeded boolean")
    got = {r.outbox_id: (r.attempts, r.parked, r.next_attempt_at, r.delivered_at) for r in notifications.outbox_retry_state(df).collect()}
    assert got == {"a": (3, False, at(2 + 4), None), "b": (5, True, None, None), "c": (1, False, None, at(1))}


def test_fanout(spark):
    events = spark.createDataFrame([("o1", "e", "X"), ("o2", "e", "Z"), ("o3", "f", "X")], "outbox_id string, environment_id string, event string")
    subs = spark.createDataFrame([("n1", "e", True, "X, Y"), ("n2", "e", False, ""), ("n3", "f", True, "")], "subscription_id string, environment_id string, enabled boolean, events string")
    sent, unwanted = notifications.notification_fanout(events, subs)
    assert {(r.outbox_id, r.subscription_id) for r in sent.collect()} == {("o1", "n1"), ("o3", "n3")}
    assert [r.outbox_id for r in unwanted.collect()] == ["o2"]


def test_refusals(spark):
    empty = spark.createDataFrame([], "environment_id string, action string, target string, at timestamp, audit_id string")
    with pytest.raises(ValueError):
        governance.audit_query(empty, since=at(2), until=at(1))
    with pytest.raises(ValueError):
        governance.promotion_plan("a", "a", empty, empty, empty, None)


def test_first_use_of_a_subject_counts(spark):
    ref = "array<struct<subject:string,selector:string>>"
    df = spark.createDataFrame([("e", "svc", [("s", "2"), ("s", "latest")], [])], f"environment_id string, service string, consumes {ref}, produces {ref}")
    assert [(r.role, r.subject, r.selector) for r in governance.service_uses(df).collect()] == [("consumes", "s", "2")]


def draft(spark, docs, **how):
    stats = inference.infer_path_stats(spark.createDataFrame([("s", json.dumps(d) if not isinstance(d, str) else d) for d in docs], "subject string, body string"), **how)
    notes = {(r.path, r.kind, r.confidence) for r in inference.infer_findings(stats).collect()}
    row = inference.infer_schema(stats).first()
    return json.loads(row.body), row.sample_count, notes


def test_draft_of_varied_documents(spark):
    docs = [{"id": i, "mail": f"u{i}@x.org", "st": "ABC"[i % 3], "one": "k", "mix": i if i % 2 else "t", "nul": None,
             "arr": [{"when": "2024-02-0%d" % (i % 9 + 1)}], "e": [], "f": i + 0.5, **({"opt": True} if i % 4 == 0 else {})} for i in range(12)]
    body, n, notes = draft(spark, [*docs, "{broken"])
    props = body["properties"]
    assert n == 12 and body["type"] == "object"
    assert props["id"] == {"type": "integer"} and props["f"] == {"type": "number"}
    assert props["mail"] == {"type": "string", "format": "email"} and props["st"] == {"type": "string", "enum": ["A", "B", "C"]}
    assert props["one"] == {"type": "string"} and props["mix"] == {} and props["nul"] == {} and props["e"] == {"type": "array"}
    assert props["arr"]["items"] == {"type": "object", "properties": {"when": {"type": "string", "format": "date"}}, "required": ["when"]}
    assert sorted(body["required"]) == sorted(set(props) - {"opt"})
    assert {("#/properties/mix", "mixed_types", 3), ("#/properties/one", "constant_value", 2), ("#/properties/nul", "always_null", 3),
            ("#/properties/nul", "required_from_presence", 3), ("#/properties/opt", "optional_from_absence", 1), ("#/properties/e", "empty_array", 3),
            ("#/properties/st", "enum_from_low_cardinality", 3), ("#/properties/id", "integer_from_whole_numbers", 2)} <= notes
    assert not any(p.startswith("#/properties/mix/") for p, _, _ in notes)


def test_draft_of_few_or_many_strings(spark):
    body, _, notes = draft(spark, [{"a": 1.0, "b": 2**70}])
    assert body["properties"] == {"a": {"type": "number"}, "b": {"type": "number"}} and ("#", "thin_evidence", 3) in notes
    uuid = "00000000-0000-0000-0000-%012d"
    body, _, _ = draft(spark, [{"u": uuid % (i % 255)} for i in range(300)], string_cap=256)
    assert body["properties"]["u"]["format"] == "uuid"
    body, _, _ = draft(spark, [{"u": uuid % i} for i in range(300)], string_cap=256)
    assert body["properties"]["u"] == {"type": "string"}
    body, _, _ = draft(spark, [{"u": uuid % i} for i in range(300)])
    assert body["properties"]["u"] == {"type": "string", "format": "uuid"}


def test_files_round_trip(spark, tmp_path):
    for name, text in {"a.B.json": "{}", "a.C.AVSC": '"int"', "bad-name.json": "{}", "note.txt": "x", "a.D.json": "{}", "a.D.proto": "x"}.items():
        (tmp_path / name).write_text(text)
    contracts, errors = read_contract_dir(spark, str(tmp_path))
    assert {(r.subject, r.format) for r in contracts.collect()} == {("a.B", "json"), ("a.C", "avro"), ("a.D", "json"), ("a.D", "protobuf")}
    assert {(r.error_code, r.detail) for r in errors.collect()} == {("subject_name_invalid", "bad-name"), ("subject_defined_twice", "a.D")}
    assert read_messages(spark, str(tmp_path)).count() == 3
    assert contract_files(spark.createDataFrame([], "path string, body string"))[0].count() == 0

    subjects = spark.createDataFrame([("e", "a.B", 2), ("e", "a.N", None)], "environment_id string, subject string, latest_ordinal int")
    versions = spark.createDataFrame([("e", "a.B", 1, "i1"), ("e", "a.B", 2, "i2")], "environment_id string, subject string, ordinal int, schema_id string")
    schemas = spark.createDataFrame([("i1", "json", "{}"), ("i2", "json", '{"v":2}')], "schema_id string, format string, body string")
    skipped = export_latest(subjects, versions, schemas, str(tmp_path / "out"))
    assert [r.subject for r in skipped.collect()] == ["a.N"]
    assert [tuple(r) for r in spark.read.text(str(tmp_path / "out")).select("subject", "value").collect()] == [("a.B", '{"v":2}')]


def test_queue_sample(spark):
    rows = [(i, at(i), "q" if i != 3 else "other", ["t.A", " ", None, "t.A"][i % 4], b"\xff" if i == 4 else b"{}") for i in range(8)]
    df = spark.createDataFrame(rows, "message_id long, ts timestamp, queue string, properties_type string, body binary")
    sample, summary = sample_queue(df, "q", 5)
    assert [r.message_id for r in sample.collect()] == [0, 1, 2, 5]
    assert {(r.type, r.inspected, r.sampled) for r in summary.collect()} == {("t.A", 2, 1), (None, 3, 3)}
    many = df.withColumn("properties_type", F.concat(F.lit("t.T"), F.col("message_id").cast("string")))
    with pytest.raises(ValueError):
        sample_queue(many, "q", 5)

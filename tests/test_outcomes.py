"""Outcomes that must not be taken for success: what can't be compared, and numbers of any size."""

from pyspark.sql import functions as F

from pactlake.operators import compatibility
from pactlake.operators.governance import impact_analysis, promotion_plan
from pactlake.operators.json_diff import diff_json_pairs, json_schema_diff
from pactlake.operators.validation import rules_of, validate_payloads
from pactlake.operators.verdicts import stored

CATALOG = "schema_id string, format string, body string"
SCHEMAS = [
    ("a1", "avro", '"int"'), ("a2", "avro", '"string"'), ("j1", "json", '{"type":"object","properties":{"x":{"type":"string"}}}'),
    ("j2", "json", '{"type":"object","properties":{"x":{"type":"object"}}}'), ("bad", "json", "{"),
]
VERSIONS = "environment_id string, subject string, ordinal int, schema_id string, semver string, status string"


def test_a_run_cleans_up_after_itself(spark):
    from pathlib import Path

    from pactlake import materialize
    from pactlake.session import run_dir

    kept = materialize(spark.range(3), "some")
    path = Path(run_dir(spark))
    assert kept.count() == 3 and any(path.iterdir())


def registry(spark):
    schemas = spark.createDataFrame(SCHEMAS, CATALOG)
    rows = [("e", s, o, i, "1.0.0", "Active") for s, ids in (("avro", ["a1", "a2"]), ("json", ["j1", "j1"]), ("torn", ["j1", "bad"]), ("gone", ["j1", "nowhere"])) for o, i in enumerate(ids, 1)]
    versions = spark.createDataFrame(rows, VERSIONS)
    rules = rules_of(schemas)
    differ = compatibility.by_format(schemas, {"json": lambda p: diff_json_pairs(p, rules.where("rules is not null"))})
    return versions, differ


def policies(spark, mode):
    rows = [("e", s, "Open", mode, 1) for s in ("avro", "json", "torn", "gone")]
    return spark.createDataFrame(rows, "environment_id string, subject string, content_model string, mode string, surface int")


def test_nothing_uncompared_is_compatible(spark):
    versions, differ = registry(spark)
    for mode in ("BACKWARD", "FULL_TRANSITIVE"):
        audit = compatibility.compatibility_audit(versions, policies(spark, mode), differ).where("ordinal = 2").collect()
        assert {r.subject: r.compatible for r in audit} == {"avro": None, "json": True, "torn": None, "gone": None}
        assert {r.bump for r in audit if r.compatible is None} == {None}
    proposals = spark.createDataFrame([("e", "avro", "a1"), ("e", "json", "bad"), ("e", "torn", "j1")], "environment_id string, subject string, schema_id string")
    verdicts, _ = compatibility.compatibility_check(proposals, versions, policies(spark, "BACKWARD"), differ)
    assert {r.subject: r.compatible for r in verdicts.collect()} == {"avro": None, "json": None, "torn": None}
    asked = versions.where("ordinal = 2").select("environment_id", "subject", F.lit(1).alias("a"), F.lit(2).alias("b"))
    kinds = {r.subject: r.kind for r in compatibility.diff_versions(asked, versions, policies(spark, "BACKWARD"), differ).collect()}
    assert kinds == {"avro": "not_comparable", "json": None, "torn": "not_comparable", "gone": "not_comparable"}
    files = proposals.select("environment_id", "subject", F.lit("json").alias("format"), "schema_id")
    assert {r.status for r in compatibility.bulk_check(files, versions, policies(spark, "BACKWARD"), differ).collect()} == {"not_comparable"}


def test_a_store_compares_each_pair_once(spark, tmp_path):
    """Audits behind a store equal those without it; what is known, whatever the policy, isn't compared again."""
    versions, differ = registry(spark)
    asked = []

    def counted(pairs):
        asked.append({(r.prev_id, r.next_id) for r in pairs.collect()})
        return differ(pairs)

    look = stored(counted, str(tmp_path / "store"))
    for mode in ("BACKWARD", "FULL", "FULL_TRANSITIVE", "BACKWARD"):
        plain = compatibility.compatibility_audit(versions, policies(spark, mode), differ)
        kept = compatibility.compatibility_audit(versions, policies(spark, mode), look)
        assert sorted(map(str, kept.collect())) == sorted(map(str, plain.collect()))
    compared = [p for pairs in asked for p in pairs]
    known = [p for p in compared if p == ("j1", "j1")]
    assert len(known) == 1 and ("j1", "bad") in compared
    # A schema that becomes known later is compared then.
    later = stored(lambda pairs: pairs.withColumn("findings", F.expr("transform(array(1), x -> named_struct('path', '#', 'kind', 'k', 'direction', 'Backward', 'surface', 0, 'member', 'm'))")), str(tmp_path / "store2"))
    pairs = spark.createDataFrame([("a", "b", "Open")], "prev_id string, next_id string, content_model string")
    nothing = stored(lambda pairs: later(pairs).withColumn("findings", F.when(F.lit(False), F.col("findings"))), str(tmp_path / "store3"))
    assert [r.findings for r in nothing(pairs).collect()] == [None]
    assert [len(r.findings) for r in stored(later, str(tmp_path / "store3"))(pairs).collect()] == [1]


def test_an_audit_asks_for_all_its_pairs_at_once(spark, tmp_path):
    """One-step and transitive subjects together ask the differ once, and what it finds isn't joined again."""
    versions, differ = registry(spark)
    asked, given = [], []

    def counted(pairs):
        asked.append(pairs.count())
        return differ(pairs)

    def seen(pairs):
        given.append(stored(counted, str(tmp_path / "store"))(pairs))
        return given[-1]

    both = policies(spark, "BACKWARD").withColumn("mode", F.when(F.col("subject") == "json", "BACKWARD").otherwise("FULL_TRANSITIVE"))
    got = compatibility.compatibility_audit(versions, both, seen).collect()
    apart = [compatibility.compatibility_audit(versions, both.where(F.col("subject") == s), differ).collect() for s in ("avro", "json", "torn", "gone")]
    assert sorted(map(str, got)) == sorted(str(r) for rows in apart for r in rows) and len(asked) == 1
    assert "Join" not in given[0]._jdf.queryExecution().toString()


def test_impact_reads_its_uses_once(spark):
    versions, differ = registry(spark)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    rows = [("e", "s1", "consumes", "json", "1"), ("e", "s2", "consumes", "json", ">=2"), ("e", "s3", "consumes", "json", "latest"),
            ("e", "s4", "consumes", "json", None), ("e", "s5", "consumes", "json", "9"), ("e", "s6", "produces", "json", "1")]
    schema = "environment_id string, service string, role string, subject string, selector string"
    uses = spark.createDataFrame(rows, schema).mapInPandas(counted, schema)
    candidates = versions.where("subject = 'json' and ordinal = 2").select("environment_id", "subject", "schema_id")
    subjects = candidates.select("environment_id", "subject", F.lit(2).alias("latest_ordinal"))
    seen = spark.createDataFrame([], "environment_id string, service string, last_seen_at timestamp")
    out = impact_analysis(candidates, uses, seen, versions, subjects, policies(spark, "BACKWARD"), differ, F.current_timestamp())
    certainty = {r.service: (r.selector, r.reader_ordinal, r.certainty) for r in out.collect()}
    assert certainty == {"s1": ("1", 1, "Checked"), "s2": (">=2", 2, "Checked"), "s3": ("latest", 2, "FollowsLatest"),
                         "s5": ("9", 9, "Unresolvable")} | {"s4": certainty["s4"]}
    assert read.value == len(rows)


def test_promotion_refuses_what_cannot_be_compared(spark):
    versions, differ = registry(spark)
    here = versions.where("ordinal = 2").withColumn("environment_id", F.lit("s")).withColumn("ordinal", F.lit(1))
    subjects = spark.createDataFrame([(e, s, o) for e, o in (("s", 1), ("e", 1)) for s in ("avro", "json", "torn")], "environment_id string, subject string, latest_ordinal int")
    target = versions.where("ordinal = 1")
    plan = promotion_plan("s", "e", subjects, here.unionByName(target), policies(spark, "BACKWARD"), differ).collect()
    assert {r.subject: (r.action, r.code) for r in plan} == {"avro": ("refused", "not_comparable"), "torn": ("refused", "not_comparable"), "json": ("unchanged", None)}


def test_numbers_of_any_size(spark):
    schemas = spark.createDataFrame([("max", "json", '{"maximum":10}'), ("int", "json", '{"type":"integer"}'), ("huge", "json", '{"minimum":1e25}'), ("av", "avro", '"int"')], CATALOG)
    rows = [(1, "max", "1e30"), (2, "max", "100000000000000000000000"), (3, "int", "123456789012345678901234"), (4, "int", "1e30"), (5, "int", "1.5"), (6, "huge", "1e24"), (7, "huge", "1e26"), (8, "max", "10")]
    messages = spark.createDataFrame(rows, "message_id long, schema_id string, text string").withColumn("body", F.col("text").cast("binary")).drop("text")
    binary = spark.createDataFrame([(9, "av", bytearray(b"\xff\x00"))], "message_id long, schema_id string, body binary")
    found = {(r.message_id, r.kind) for r in validate_payloads(messages.unionByName(binary), schemas).collect()}
    assert found == {(1, "NumberTooBig"), (2, "NumberTooBig"), (5, "IntegerExpected"), (6, "NumberTooSmall")}


def test_numbers_of_properties(spark):
    schemas = spark.createDataFrame([("p", "json", '{"maxProperties":2,"minProperties":1}')], CATALOG)
    rows = [(1, "p", "{}"), (2, "p", '{"a":1}'), (3, "p", '{"a":1,"b":2,"c":3}'), (4, "p", "[1,2,3]")]
    messages = spark.createDataFrame(rows, "message_id long, schema_id string, text string").withColumn("body", F.col("text").cast("binary")).drop("text")
    found = {(r.message_id, r.kind) for r in validate_payloads(messages, schemas).collect()}
    assert found == {(1, "TooFewProperties"), (3, "TooManyProperties")}


def test_bounds_of_any_size_and_a_member_without_name(spark):
    schemas = spark.createDataFrame([("a", "json", '{"type":"object","maximum":1e25,"":{"x":1}}'), ("b", "json", '{"type":"object","maximum":1e24,"":2}')], CATALOG)
    pairs = spark.createDataFrame([("a", "b", "Open")], "prev_id string, next_id string, content_model string")
    found = json_schema_diff(pairs, rules_of(schemas)).collect()
    assert [(r.path, r.kind) for r in found] == [("#/maximum", "numeric_range_narrowed")]

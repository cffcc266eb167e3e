"""Labels against the labels and verdicts before them: whole against brute force, and what is shuffled for it."""

import random

from pyspark.sql import functions as F

from pactlake.operators import running
from pactlake.operators.compatibility import compatibility_audit, semver_label_audit

SUBJECTS = "environment_id string, subject string"


def labels(spark, rows):
    return spark.createDataFrame(rows, f"{SUBJECTS}, ordinal int, semver string, status string")


def test_labels_are_dealt_as_text(spark):
    """Keys are worked out after labels are dealt, and which rules a label may break before it meets its verdict."""
    rows = [("e", "s", o, f"{o}.0.0", "Active") for o in range(1, 30)] + [("e", "s", 30, "30.0.0", "Active"), ("e", "s", 31, "2.0.0", "Active")]
    verdicts = spark.createDataFrame([("e", "s", o, True) for o in range(1, 32)], f"{SUBJECTS}, ordinal int, compatible boolean")
    out = semver_label_audit(labels(spark, rows), verdicts)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    dealt = plan[plan.index("RepartitionByExpression"):]
    assert "regexp" not in dealt and "split" not in dealt and "Join" not in dealt
    assert [(r.ordinal, r.code) for r in out.collect()] == [(31, "semver_not_increasing")]


def test_label_audit_equals_brute_force(spark, monkeypatch):
    """Subjects of one block and of several, labels and statuses missing, verdicts open."""
    random.seed(5)
    rows = [("e", s, o, random.choice([None, "x", *(f"{a}.{b}.0" for a in range(3) for b in range(2))]), random.choice(["Active", "AwaitingApproval", "Rejected", None]))
            for s, n in (("a", 3), ("b", 40)) for o in range(1, n)]
    said = {(s, o): random.choice([True, False, None]) for _, s, o, _, _ in rows}
    want = set()
    for s in "ab":
        top = None
        for _, _, o, label, status in sorted((r for r in rows if r[1] == s), key=lambda r: r[2]):
            key = tuple(map(int, label.split("."))) if label and label != "x" else None
            if key and top and key <= top:
                want.add((s, o, "semver_not_increasing"))
            elif key and said[s, o] is False and (key[0] <= top[0] if top else key[0] == 0):
                want.add((s, o, "semver_label_understates_breakage"))
            if key and status in ("Active", "AwaitingApproval"):
                top = max(key, top or key)
    verdicts = spark.createDataFrame([("e", *k, c) for k, c in said.items()], f"{SUBJECTS}, ordinal int, compatible boolean")
    for block in (4096, 7):
        monkeypatch.setattr(running.before, "__defaults__", ("last", block, None, None))
        got = semver_label_audit(labels(spark, rows), verdicts).collect()
        assert {(r.subject, r.ordinal, r.code) for r in got} == want and len(got) == len(want)


def test_only_keys_of_several_blocks_are_carried(spark, monkeypatch):
    """Values of a subject that lies in one block are not summed up a second time."""
    written = {}
    keep = running.materialize
    monkeypatch.setattr(running, "materialize", lambda df, label: written.setdefault(label, keep(df, label)))
    rows = spark.createDataFrame([("one", o, o) for o in range(4)] + [("two", o, o % 5) for o in range(9)], "k string, o int, x int")
    got = running.before(rows, ["k"], "o", "p", F.col("x"), "max", 4).orderBy("k", "o").collect()
    assert [r.p for r in got] == [None, 0, 1, 2] + [None, 0, 1, 2, 3, 4, 4, 4, 4]
    assert [r.k for r in written["several"].collect()] == ["two"]


def test_pairs_without_a_version_before_are_not_asked_or_joined(spark):
    """First versions, unknown ones and odd ids keep their texts and verdicts."""
    asked = []

    def differ(pairs):
        asked.extend((r.prev_id, r.next_id) for r in pairs.distinct().collect())
        found = "case when next_id = 'zz' then null else filter(array(named_struct('path', '#', 'kind', 'k', 'direction', 'Backward', 'surface', 1, 'member', 'm')), x -> prev_id <> next_id) end"
        return pairs.distinct().withColumn("findings", F.expr(found))

    ids = ["0123456789abcdef" * 2, "f" * 32, "zz", "f" * 32]
    versions = spark.createDataFrame([("e", "s", o + 1, i, "Active") for o, i in enumerate(ids)], f"{SUBJECTS}, ordinal int, schema_id string, status string")
    policy = spark.createDataFrame([("e", "s", "Open", "BACKWARD", 2)], f"{SUBJECTS}, content_model string, mode string, surface int")
    got = {r.ordinal: (r.schema_id, r.compatible, r.bump, r.conflicts_with) for r in compatibility_audit(versions, policy, differ).collect()}
    assert set(asked) == set(zip(ids, ids[1:]))
    assert got == {1: (ids[0], True, "None", None), 2: (ids[1], False, "Major", 1), 3: ("zz", None, None, None), 4: (ids[1], False, "Major", 3)}

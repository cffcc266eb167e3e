"""Looking up pairs of versions: whole against brute force, and read and shuffled once."""

import random

from pyspark.sql import functions as F

from pactlake.functions.columns import pack_id, unpack_id
from pactlake.operators import compatibility

SUBJECTS = "environment_id string, subject string"


def policies(spark, *subjects):
    return spark.createDataFrame([("e", s, "Open", "BACKWARD", 2) for s in subjects], f"{SUBJECTS}, content_model string, mode string, surface int")


def differ(pairs):
    """Pairs with an id that begins with x can't be compared; the others differ by their ids."""
    found = F.expr("array(named_struct('path', concat(prev_id, '>', next_id), 'kind', 'k', 'direction', 'Backward', 'surface', 1, 'member', cast(null as string)))")
    return pairs.select(*compatibility.PAIR).distinct().withColumn("findings", F.when(~F.col("prev_id").startswith("x") & ~F.col("next_id").startswith("x"), found))


def test_packed_ids_are_ids_again(spark):
    texts = ["0123456789abcdef" * 2, "ABCDEF0123456789" * 2, "0" * 31, "0" * 32 + "\n", "a", "", "é" * 8, None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", pack_id("t").alias("p")).withColumn("u", unpack_id("p")).collect()
    assert [r.u for r in rows] == texts and len({r.p for r in rows}) == len(texts)
    assert len(rows[0].p) == 16 and all(len(r.p) > 16 for r in rows[1:-1])


def test_requests_and_versions_are_read_once(spark):
    read = {name: spark.sparkContext.accumulator(0) for name in ("requests", "versions")}

    def counted(name):
        def count(batches):
            for pdf in batches:
                read[name].add(len(pdf))
                yield pdf

        return count

    versions = spark.createDataFrame([("e", "s", o, f"{o % 3}") for o in range(1, 21)], f"{SUBJECTS}, ordinal int, schema_id string")
    requests = spark.createDataFrame([("e", "s", o, o + 2) for o in range(1, 21)], f"{SUBJECTS}, a int, b int")
    got = compatibility.diff_versions(
        requests.mapInPandas(counted("requests"), requests.schema), versions.mapInPandas(counted("versions"), versions.schema), policies(spark, "s"), differ
    ).collect()
    assert len(got) == 18 and {r.path for r in got} == {"0>2", "1>0", "2>1"}
    assert read["requests"].value == 20 and read["versions"].value == 20


def test_sides_equal_brute_force(spark):
    """Ordinals near and far, missing, null and repeated, ids null and repeated, subjects without a policy."""
    random.seed(3)
    versions = [("e", random.choice("stu"), random.choice([None, *range(1, 30)]), random.choice([None, "x1", "a", "b", "0123456789abcdef" * 2])) for _ in range(120)]
    requests = [("e", random.choice("stuv"), random.choice([None, *range(1, 33)]), random.choice([None, *range(1, 33)])) for _ in range(150)]
    want = sorted(
        str((s, a, b, i, j)) for _, s, a, b in requests if s in "st"
        for _, t, o, i in versions if (t, o) == (s, a) for _, u, q, j in versions if (u, q) == (s, b)
    )
    v = spark.createDataFrame(versions, f"{SUBJECTS}, ordinal int, schema_id string")
    r = spark.createDataFrame(requests, f"{SUBJECTS}, a int, b int")
    sides = compatibility._sides(r, v, policies(spark, "s", "t", "v"), block=4).select("subject", "a", "b", unpack_id("prev_id"), unpack_id("next_id"))
    assert want and sorted(str(tuple(x)) for x in sides.collect()) == want
    kinds = compatibility.diff_versions(r, v, policies(spark, "s", "t", "v"), differ).collect()
    assert len(kinds) == len(want)
    assert {(x.identical, x.kind, x.path is None) for x in kinds} == {(None, None, True), (True, None, True), (False, "k", False), (False, "not_comparable", True)}

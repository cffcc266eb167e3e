from pyspark.sql import functions as F

from pactlake.functions import (
    json_pointer_escape,
    normalize_subject,
    parse_selector,
    schema_id,
    selector_accepts,
    semver_key,
    subject_valid,
    topic_matches,
    utf16_clamp,
    violation_fingerprint,
)
from pactlake.functions.columns import generic_subject, has_wildcard_word

def brute(p, k):
    """Do two word lists have a common key? Written as plain recursion."""
    if not p and not k:
        return True
    if p and p[0] == "#":
        return any(brute(p[1:], k[i:]) for i in range(len(k) + 1))
    if k and k[0] == "#":
        return any(brute(p[i:], k[1:]) for i in range(len(p) + 1))
    if not p or not k:
        return False
    return (p[0] == k[0] or "*" in (p[0], k[0])) and brute(p[1:], k[1:])


def test_topic_regex_equals_brute_force(spark):
    alphabet = ["a", "b", "*", "#"]
    patterns = [[x, y, z][:n] for x in alphabet for y in alphabet for z in alphabet for n in (1, 2, 3)]
    keys = [[], ["a"], ["a", "b"], ["b", "a"], ["a", "b", "a"], ["a", "", "b"], ["a", "b", "a", "b"]]
    rows = [(".".join(p), ".".join(k)) for p in patterns for k in keys]
    df = spark.createDataFrame(rows, "p string, k string").where(~has_wildcard_word("k"))
    for r in df.select("p", "k", topic_matches("p", "k").alias("m")).collect():
        assert r.m == brute(r.p.split("."), r.k.split(".")), r


def test_subject_texts(spark):
    cases = {
        "a.b_1.C": True, " a.b ": True, "a..b": False, ".a": False, "a-b": False, "a/b": False, "": False, None: False,
        "x" * 512: True, "x" * 513: False, "a\n": True, "a\nb": False,
    }
    got = spark.createDataFrame([(c,) for c in cases], "s string").select("s", subject_valid("s").alias("ok")).collect()
    assert {r.s: r.ok for r in got} == cases
    plain = {" N.A+B, Asm, Version=1": "N.A.B", "n:a:B": "n.a.B", "N.Order,": "N.Order", "\t ": "", None: ""}
    got = spark.createDataFrame([(c,) for c in plain], "s string").select("s", normalize_subject("s").alias("t")).collect()
    assert {r.s: r.t for r in got} == plain


def test_generic_spelling(spark):
    spelled = {
        "N.Box`1[[N.Item, Asm]], Core": "N.Box_of_N.Item", "N.Pair`2[[N.L, A],[N.R, B]]": "N.Pair_of_N.L_and_N.R",
        "N.Outer`1[[N.Inner`1[[N.X, A]], A]]": "N.Outer_of_N.Inner_of_N.X", "N.Open`1": "N.Open`1", "N.Torn`1[[N.X": "N.Torn`1[[N.X",
        "M`2[[K, A],[L`1[[P+Q, A]][], A]], A": "M_of_K_and_L_of_P.Q", "U`2[A, B]": "U_of_A_and_B", "E`1[]": "E`1[]",
    }
    got = spark.createDataFrame([(c,) for c in spelled], "s string").select("s", generic_subject("s").alias("t")).collect()
    assert {r.s: r.t for r in got} == spelled


def test_selectors(spark):
    cases = {"latest": ("latest", None), " LATEST ": ("latest", None), "7": ("pinned", 7), ">= 3": ("range", 3), "0": None,
             ">=0": None, "3.1": None, "": None, None: None, "99999999999": None, ">=" + "0" * 99 + "1junk": None, ">=" + "0" * 99 + "1": ("range", 1)}
    got = spark.createDataFrame([(c,) for c in cases], "s string").select("s", parse_selector("s").alias("p")).collect()
    assert {r.s: tuple(r.p) if r.p else None for r in got} == cases
    rows = [("latest", 2, 2, True), ("latest", 1, 2, False), ("latest", 1, None, False), ("2", 2, 9, True), (">=2", 3, None, True), (">=2", 1, 1, False)]
    df = spark.createDataFrame(rows, "s string, o int, l int, want boolean")
    for r in df.select("*", selector_accepts(parse_selector("s"), F.col("o"), F.col("l")).alias("ok")).collect():
        assert r.ok == r.want, r


def test_semver_order(spark):
    ordered = ["0.9.9", "1.0.0-1", "1.0.0-2", "1.0.0-10", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta", "1.0.0", "1.0.1", "1.10.0", "2.0.0"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(ordered)], "i int, s string").withColumn("k", semver_key("s"))
    assert [r.i for r in df.orderBy("k").collect()] == list(range(len(ordered)))
    bad = ["1.2", "1.2.3+b", "1.2.3-01", "1.2.3-", "a.b.c", "1.2.99999999999", "1.2.3-a..b", None]
    assert spark.createDataFrame([(s,) for s in bad], "s string").where(semver_key("s").isNotNull()).count() == 0


def test_schema_id_preimage(spark):
    import hashlib

    refs = [("n2", "b.X", 2), ("n1", "a.É", 1)]
    df = spark.createDataFrame([("avro", "{é}", refs)], "f string, c string, r array<struct<name:string,subject:string,version:int>>")
    text = "contract-schema-id/v1\nformat:avro\nbody:4:{é}\nrefs:2\nref-name:2:n1\nref-subject:4:a.É\nref-version:1\nref-name:2:n2\nref-subject:3:b.X\nref-version:2\n"
    want = hashlib.sha256(text.encode()).hexdigest()[:32]
    assert df.select(schema_id(F.col("f"), F.col("c"), F.col("r")).alias("i")).first().i == want


def test_small_texts(spark):
    r = spark.createDataFrame([("a~/b", "x😀😀")], "s string, t string").select(
        json_pointer_escape("s").alias("p"), utf16_clamp("t", 3).alias("c3"), utf16_clamp("t", 2).alias("c2"), utf16_clamp("t", 5).alias("c5"),
        violation_fingerprint(F.lit("e"), F.lit("CONSUME"), F.lit("r"), F.lit(None).cast("string"), F.lit("c")).alias("f"),
    ).first()
    assert (r.p, r.c3, r.c2, r.c5, r.f) == ("a~0~1b", "x😀", "x", "x😀😀", "e|2|r|-|c")

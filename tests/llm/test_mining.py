"""Secret scans, hard negatives and whitening, against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pactlake.llm import feast_whitening, hard_negatives, secret_ownership

LIVE = "q7Vx9Lm2Rk4Tz8Wp"
SHARED = "Zk3nB8vC1xQ5wE7r"


def brute_base(text):
    """Spans of the base patterns, scanned position by position."""
    out, name = [], re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A | re.I)
    at = 0
    while at < len(text):
        if m := name.match(text, at):
            if len(m.group(1)) >= 6:
                out.append((m.start(), 0, m.end()))
            at = m.end()
        else:
            at += 1
    for rank, first, chars, least in ((1, "AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 20), (2, "", "0123456789abcdef", 24)):
        at = 0
        while at < len(text):
            end = at + len(first)
            if not text.startswith(first, at) or end >= len(text) or text[end] not in chars:
                at += 1
                continue
            while end < len(text) and text[end] in chars:
                end += 1
            if end - at >= least:
                out.append((at, rank, end))
            at = end
    return sorted(out)


def shown(spans):
    return [(s["kind"], s["start"], s["stop"]) for s in spans]


def test_base_spans_of_odd_texts(spark):
    draw = random.Random(3)
    bits = ["token", "API_key", "apikey", "Passwd", "secret", "ſecret", " ", "  ", "=", ":", '"', "'", "abc", "x.y-z=", "AKIA", "AKIAQ7VX", "0123456789ABCDEF", "deadbeef", "0123456789abcdef", "é", "😀", "\n", "\t", "g", "K"]
    texts = ["".join(draw.choice(bits) for _ in range(draw.randint(1, 40))) for _ in range(300)]
    texts += [None, "", "password=token = abcdefgh", "token = 'abcde' token=abcdef", "😀 secret:\tabcdef secret: abcdef", "x" * 300_000 + " token=" + "ab1" * 100_000]
    df = spark.createDataFrame([(i, t, "o", "r") for i, t in enumerate(texts)], "doc_id long, text string, owner string, repository string")
    for r in secret_ownership.scan_secrets(df).collect():
        want = [(secret_ownership.KINDS[k], a, b) for a, k, b in brute_base(texts[r.doc_id] or "")]
        assert shown(r.base) == want and [r.n_assign, r.n_access, r.n_hex] == [sum(w[0] == k for w in want) for k in secret_ownership.KINDS[:3]]
        assert [x for x in shown(r.spans) if x[0] != "owned"] == want


def test_ownership_parts_copies_from_live_values(spark):
    rows = [(1, f"key {LIVE} here", "a", "a/1"), (2, f"again {LIVE}", "a", "a/2"), (2, f"again {LIVE}", "a", "a/2")]
    rows += [(10 + i, f"docs say {SHARED} and token={SHARED}", f"o{i % 3}", f"r{i}") for i in range(8)]
    rows += [(30 + i, "one owner WbX3kd92LsoQ81zz", "b", f"r{i}") for i in range(6)]
    rows += [(40, "null owner Pw83kdXu20qLm5Rt", None, None), (41, "null owner Pw83kdXu20qLm5Rt", None, None), (42, "exampleKEY12exampleKEY12 onlyletterswithoutdigits 123456789012345678", "c", "c"), (43, "token=" + LIVE, "a", "a/3")]
    names = "doc_id long, text string, owner string, repository string, spans int, found string, uid long, digest string"
    df = spark.createDataFrame([(*r, 1, "x", 5, "y") for r in rows], names).repartition(4)
    got = {}
    for r in secret_ownership.scan_secrets(df).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert shown(got[1][0].spans) == [("owned", 4, 20)] and len(got[2]) == 2 and shown(got[2][1].spans) == [("owned", 6, 22)]
    for i in range(8):
        (r,) = got[10 + i]
        assert shown(r.spans) == [("assign", 30, 52)] and r.spans[0].shared and r.spans[0].live and r.n_assign == 1
    assert all(got[30 + i][0].spans == [] for i in range(6)), "six repositories of one owner"
    assert shown(got[40][0].spans) == [("owned", 11, 27)] and got[42][0].spans == []
    assert shown(got[43][0].spans) == [("assign", 0, 22)] and not got[43][0].spans[0].shared
    assert secret_ownership.scan_secrets(df.limit(0)).collect() == []


def brute_negatives(rows, anchors, mining=hard_negatives.Mining()):
    out = []
    score = lambda a, b: sum(x * y for x, y in zip(a[2], b[2], strict=True))
    for a in anchors:
        met = [r for r in rows if len(r[2]) == len(a[2])]
        top = sorted({(-score(a, r), r[0]) for r in met if r[1] == a[1] and r[0] != a[0]})[: mining.positives]
        for p, pid in top:
            near = sorted({(-score(a, r), r[0]) for r in met if r[1] != a[1] and mining.low * -p <= 100 * score(a, r) <= mining.high * -p})
            out += [(a[0], pid, k + 1, i, -p, -s) for k, (s, i) in enumerate(near[: mining.negatives])]
    return sorted(set(out))


@pytest.mark.parametrize("seed", range(4))
def test_hard_negatives_equal_brute_force(spark, seed):
    draw = np.random.default_rng(seed)
    rows = [(i, int(draw.integers(0, 3)), tuple(draw.integers(-4, 7, 5 if i % 11 else 3).tolist())) for i in range(400)]
    rows += [rows[k] for k in (0, 7, 7, 20, 20, 20)] + [(500, 1, (1 << 26,) * 4), (510, 1, (1 << 26,) * 4), (520, 2, (1 << 25,) * 4)]
    odd = [(None, 1, (1, 1, 1, 1, 1)), (600, None, (1, 1, 1, 1, 1)), (601, 1, None), (602, 1, (1, None, 1, 1, 1)), (603, 1, (1 << 28,) * 4), (604, 2, ())]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows + odd], "vec_id long, label int, vector array<long>, anchor string, slot int").repartition(5)
    mining = hard_negatives.Mining(rows=64, anchors=16)
    got = hard_negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, mining)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows, [r for r in rows if r[0] % 10 == 0])
    assert hard_negatives.hard_negatives(df.limit(0), F.lit(True)).collect() == []
    assert hard_negatives.hard_negatives(df, F.lit(False)).count() == 0


def test_negatives_of_tied_scores(spark):
    rows = [(i, i % 2, (1, i % 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, label int, vector array<long>")
    got = hard_negatives.hard_negatives(df, F.col("vec_id") % 5 == 0, hard_negatives.Mining(rows=7, anchors=3, low=0))
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows, rows[::5], hard_negatives.Mining(low=0))


def test_quantised_components(spark):
    df = spark.createDataFrame([([0.5, -0.001, 1.0],), ([float("nan"), float("inf"), None],), (None,), ([3e38, 0.0, 0.0],)], "v array<float>")
    got = [r[0] for r in df.select(hard_negatives.quantised("v", 256)).collect()]
    assert got[:3] == [[128, -1, 256], [None, None, None], None] and got[3][1:] == [0, 0]
    got = [r[0] for r in df.select(feast_whitening.quantised("v", 64, 1000)).collect()]
    assert got == [[1032, 999, 1064], None, None, None]


def test_inertia_counts():
    draw = np.random.default_rng(1)
    for k in range(60):
        a = draw.standard_normal((9, 9))
        a = a + a.T
        a[np.diag_indices(9)] *= k % 3 > 0
        shift = float(draw.standard_normal())
        assert feast_whitening.above(a, shift) == (np.linalg.eigvalsh(a) > shift).sum()


@pytest.mark.parametrize("kind", ["plain", "repeated", "multiple", "small", "flat"])
def test_contours_find_the_leading_pairs(spark, kind):
    draw = np.random.default_rng(2)
    x = draw.standard_normal((7, 5) if kind == "small" else (300, 40))
    if kind == "repeated":
        x[:, :20] = x[:, 20:]
    v = np.cov(x.T, bias=True)
    if kind == "multiple":
        q, _ = np.linalg.qr(draw.standard_normal((40, 40)))
        v = q @ np.diag([9.0] * 3 + [4.0] * 15 + [1.0] * 22) @ q.T
        v = (v + v.T) / 2
    if kind == "flat":
        v = np.eye(40)
    values, vectors = feast_whitening.leading(spark, v)
    want = np.linalg.eigvalsh(v)[::-1]
    k = min(16, len(v))
    assert len(values) == k and np.allclose(values, want[:k], rtol=1e-12)
    assert np.allclose(vectors @ vectors.T, np.eye(k), atol=1e-12) and np.allclose(v @ vectors.T, vectors.T * values, atol=1e-11)


def test_whitening_equals_a_dense_solver(spark):
    draw = np.random.default_rng(5)
    x = draw.integers(-40, 40, (200, 24)) + np.arange(24) * 7 + 1_000_000
    x[:, 3] *= 3
    rows = [(i, v) for i, v in enumerate(x.tolist())] + [(900 + i, x[5].tolist()) for i in range(300)]
    odd = [(None, x[6].tolist()), (950, None), (951, []), (952, [1, 2, 3])]
    df = spark.createDataFrame([(*r, 1, "n") for r in rows + odd], "vec_id long, vector array<long>, n int, component string").repartition(6)
    got = feast_whitening.whiten(df).collect()
    assert len(got) == 501 * 16
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(axis=0)
    v = np.cov(u.T.astype(float) - 1e6, bias=True)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    where = {i: v for i, v in rows} | {None: odd[0][1]}
    signs = {}
    for r in got:
        off = [n * int(a) - int(b) for a, b in zip(where[r.vec_id], s, strict=True)]
        k = r.component - 1
        want = np.dot(off, vectors[:, k]) / n / np.sqrt(values[k])
        assert r.n == n and r.deviation == sum(a * a for a in off) and abs(r.explained - values[k] / np.trace(v)) < 1e-12
        assert abs(abs(r.whitened) - abs(want)) < 1e-8 and r.identity_error < 1e-12
        if abs(want) > 1e-6:
            assert signs.setdefault(k, np.sign(want) == np.sign(r.whitened)) == (np.sign(want) == np.sign(r.whitened))


def test_whitening_of_odd_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, vector array<long>")
    assert feast_whitening.whiten(make([])).collect() == [] == feast_whitening.whiten(make([(1, [1, 2]), (2, [1, 2])])).collect()
    got = feast_whitening.whiten(make([(1, [0, 5]), (2, [4, 5]), (3, [7])])).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, round(abs(r.whitened), 12), round(r.explained, 12)) for r in sorted(got)] == [(1, 1, 2, 16, 1.0, 1.0), (2, 1, 2, 16, 1.0, 1.0)]
    big = 1 << 39
    got = feast_whitening.whiten(make([(1, [big, 0]), (2, [-big, 0]), (3, [0, 1])])).collect()
    assert {r.component for r in got} <= {1, 2} and all(r.deviation is None or r.deviation >= 0 for r in got)

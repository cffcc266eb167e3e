"""Binding tries against plain recursion over all pairs."""

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from test_functions import brute

from pactlake.operators import routing, topics

ROUTES = "broker_id string, virtual_host string, exchange string, routing_key string"
BINDINGS = "contract string, seq int, virtual_host string, exchange string, broker_id string, pattern string, precedence int, subjects array<struct<subject:string,selector:string>>"


def texts(draw, n, alphabet, most=5):
    return [".".join(draw.choice(alphabet) for _ in range(draw.randint(1, most))) for _ in range(n)]


def meet(p, k):
    return brute(p.split("."), k.split("."))


def bound(draw, patterns):
    """One binding a pattern, in two exchanges and three contracts."""
    out = []
    for i, p in enumerate(patterns):
        subjects = draw.choice([[("s.a", "latest")], [("s.b", "latest")], [("s.a", "latest"), ("s.b", ">=2")], [("s.b", ">=2"), ("s.a", "LATEST")], None])
        out.append((f"c{draw.randint(0, 2)}", i, "/", draw.choice(["x", "y"]), draw.choice([None, None, "k1", "k2"]), p, draw.choice([None, 1, 2]), subjects))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_routes_meet_the_patterns_that_cover_them(spark, seed):
    draw = random.Random(seed)
    bindings = bound(draw, [*texts(draw, 120, ["a", "b", "c", "*", "#", "", "x-y"]), "", "#", "*", "#.#", "#.*.#", "*.*", "#.#.a.#.#"])
    keys = [*texts(draw, 80, ["a", "b", "c", "", "x-y"], 6), *texts(draw, 20, ["a", "b", "*", "#"]), "", "a" * 300, None]
    routes = [(draw.choice(["k1", "k2", None]), draw.choice([None, "/", " "]), draw.choice(["x", "y", "z"]), k) for k in keys for _ in range(2)]
    got = routing.topic_match_join(spark.createDataFrame(routes + routes[:9], ROUTES), spark.createDataFrame(bindings, BINDINGS))
    got = sorted((r.broker_id, r.exchange, r.routing_key, r.seq) for r in got.collect())
    distinct = {(b or "", x, k or "") for b, _, x, k in routes}
    want = sorted((b, x, k, s[1]) for b, x, k in distinct for s in bindings if s[3] == x and s[4] in (None, b) and meet(s[5], k))
    assert got == want and len(want) > 500


def test_a_walk_follows_few_states(spark, monkeypatch):
    """Ten times the wildcard bindings of an exchange add no rows to the walk of a key that they don't cover."""
    made, rows = topics.materialize, {}

    def counted(df, label):
        out = made(df, label)
        rows[label] = rows.get(label, 0) + out.count()
        return out

    monkeypatch.setattr(topics, "materialize", counted)
    routes = spark.createDataFrame([("k", "/", "x", f"a.w{i}.b") for i in range(50)], ROUTES)
    sizes = []
    for n in (40, 400):
        rows.clear()
        patterns = ["#.b", "*.w1.*", *[f"*.q{i}.#" for i in range(n // 2)], *[f"#.q{i}" for i in range(n // 2)]]
        df = spark.createDataFrame([("c", i, "/", "x", None, p, None, None) for i, p in enumerate(patterns)], BINDINGS)
        assert routing.topic_match_join(routes, df).count() == 51
        sizes.append((rows["front"], rows["trie"]))
    assert sizes[0][0] == sizes[1][0] and sizes[1][1] < 12 * sizes[0][1]


@pytest.mark.parametrize("seed", range(3))
def test_conflicts_equal_all_pairs(spark, seed):
    draw = random.Random(seed)
    bindings = bound(draw, [*texts(draw, 150, ["a", "b", "*", "#", ""], 4), "#", "#.#", "a", "a", "a"])
    consume = [(b[0], b[1], b[2], b[3], b[4], b[7]) for b in bindings]
    shape = "contract string, seq int, virtual_host string, queue string, broker_id string, subjects array<struct<subject:string,selector:string>>"
    got = routing.binding_conflicts(spark.createDataFrame(bindings, BINDINGS), spark.createDataFrame(consume, shape)).collect()
    spelled = lambda refs: None if refs is None else sorted((s, x.lower()) for s, x in refs)

    def clash(b, side):
        """The earliest of all bindings of the contract that contradict ``b``, if it comes before."""
        found = [
            a[1] for a in bindings
            if a[0] == b[0] and a[3] == b[3] and None not in (a[7], b[7]) and spelled(a[7]) != spelled(b[7])
            and (None in (a[4], b[4]) or a[4] == b[4])
            and (side == "consume" or ((None in (a[6], b[6]) or a[6] == b[6]) and meet(a[5], b[5])))
        ]
        return min(found, default=None)

    want = {(side, b[0], b[1], clash(b, side)) for side in ("publish", "consume") for b in bindings if (clash(b, side) or b[1]) < b[1] or clash(b, side) == 0 < b[1]}
    assert {(r.side, r.contract, r.seq, r.clashes_with) for r in got} == want and len(got) == len(want) > 50


def test_many_bindings_of_one_contract(spark):
    """Twenty thousand bindings, a third of them on one pattern, and no pairs of bindings."""
    rows = [("c", i, "/", "x", None, "hot.#" if i % 3 == 0 else f"k{i}.*", None, [(f"s{i}", "latest")]) for i in range(20_000)]
    none = spark.createDataFrame([], "contract string, seq int, virtual_host string, queue string, broker_id string, subjects array<struct<subject:string,selector:string>>")
    got = routing.binding_conflicts(spark.createDataFrame(rows, BINDINGS), none).collect()
    assert {(r.seq, r.clashes_with) for r in got} == {(i, 0) for i in range(3, 20_000, 3)}

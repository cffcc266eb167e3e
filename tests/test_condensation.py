"""Strongly connected components, closures on them and shortest cycles, against plain search."""

import random
from collections import deque

import pytest

from pactlake.operators import condensation, graph


def table(spark, edges):
    return spark.createDataFrame([(str(a) if a is not None else None, str(b) if b is not None else None) for a, b in edges], "src string, dst string").repartition(3)


def far(edges):
    """Per node the nodes that it reaches by one edge or more."""
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    reach = {}
    for a in {x for e in edges for x in e}:
        seen, todo = set(), deque(out.get(a, ()))
        while todo:
            x = todo.popleft()
            if x not in seen:
                seen.add(x)
                todo.extend(out.get(x, ()))
        reach[a] = seen
    return reach


def shortest_cycles(edges):
    """Through each node the shortest cycle, of several the least path from the node; each once, from its least node."""
    out = {}
    for a, b in sorted(set(edges)):
        out.setdefault(a, []).append(b)
    found = set()
    for start in out:
        paths = {start: [start]}
        level, best = [[start]], None
        while level and best is None:
            grown = {}
            for p in level:
                for b in out.get(p[-1], ()):
                    if b == start:
                        best = min(best or [chr(0x10FFFF)], [*p, b])
                    elif b not in paths:
                        grown[b] = min(grown.get(b, [chr(0x10FFFF)]), [*p, b])
            paths.update(grown)
            level = list(grown.values())
        if best:
            ring = best[:-1]
            at = ring.index(min(ring))
            found.add(tuple(ring[at:] + ring[:at] + [min(ring)]))
    return found


def random_graph(draw, kind):
    n = draw.randint(3, 30)
    names = [f"n{i:02}" for i in range(n)]
    edges = [(draw.choice(names), draw.choice(names)) for _ in range(draw.randint(1, 2 * n) if kind else n)]
    for k in range(draw.randint(0, 3)):
        # a chain from one node to another, or back to itself
        inner = [f"c{k}{i:02}" for i in range(draw.randint(1, 6))]
        way = [draw.choice(names), *inner, draw.choice(names)]
        edges += list(zip(way, way[1:]))
    if kind == 2:
        ring = [f"r{i:02}" for i in range(draw.randint(2, 9))]
        draw.shuffle(ring)
        edges += list(zip(ring, [*ring[1:], ring[0]]))
    return edges


@pytest.mark.parametrize("seed", range(2))
def test_random_graphs(spark, seed):
    """Several graphs side by side in one table."""
    draw = random.Random(seed)
    edges = []
    for k in range(12):
        edges += [(f"g{k}{a}", f"g{k}{b}") for a, b in random_graph(draw, k % 3)]
    df = table(spark, edges + edges[:3] + [(None, "x"), ("x", None)])
    reach = far(edges)
    want = {a: min([b for b in reach[a] if a in reach[b]] + [a]) for a in reach}
    assert {r.node: r.component for r in condensation.strong_components(df).collect()} == want
    pairs = {(b, a) for a in reach for b in reach[a]}
    got = [(r.target, r.referrer) for r in graph.transitive_referrers(df).collect()]
    assert len(got) == len(set(got)) and set(got) == pairs
    counts = {r.target: r.referrers for r in graph.referrer_counts(df).collect()}
    assert counts == {t: sum(x == t for x, _ in pairs) for t in {x for x, _ in pairs}}
    cycles = [(tuple(r.path), r.length) for r in graph.reference_cycles(df).collect()]
    assert {p for p, _ in cycles} == shortest_cycles(edges) and len(cycles) == len(set(cycles)) and all(n == len(p) - 1 for p, n in cycles)


def test_empty_graph(spark):
    df = table(spark, []).limit(0)
    assert condensation.strong_components(df).collect() == graph.transitive_referrers(df).collect() == graph.reference_cycles(df).collect() == []


def test_a_long_ring_and_a_hub(spark, monkeypatch):
    """A ring with a tail, and a hub that refers back to some: rounds grow with the logarithm, and there are no pairs within."""
    tables = []
    made = condensation.materialize
    monkeypatch.setattr(condensation, "materialize", lambda df, label: tables.append(label) or made(df, label))
    ring = spark.range(2000).selectExpr("concat('r', lpad(id, 6, '0')) as src", "concat('r', lpad((id + 1) % 2000, 6, '0')) as dst")
    tail = spark.range(300).selectExpr("concat('t', id) as src", "case when id = 299 then 'r000007' else concat('t', id + 1) end as dst")
    hub = spark.range(20_000).selectExpr("concat('s', lpad(id, 6, '0')) as src", "'hub' as dst")
    back = spark.range(0, 20_000, 10).selectExpr("'hub' as src", "concat('s', lpad(id, 6, '0')) as dst")
    parts = condensation.strong_components(ring.unionByName(tail).unionByName(hub).unionByName(back))
    sizes = {r.component: r["count"] for r in parts.groupBy("component").count().where("count > 1").collect()}
    assert sizes == {"r000000": 2000, "hub": 2001} and len(tables) < 200


def test_a_ring_is_one_cycle(spark):
    ring = spark.range(64).selectExpr("concat('r', lpad(id, 6, '0')) as src", "concat('r', lpad((id + 1) % 64, 6, '0')) as dst")
    (cycle,) = graph.reference_cycles(ring).collect()
    assert cycle.length == 64 and cycle.path == [f"r{i % 64:06}" for i in range(65)]


def test_referrers_of_trees_make_no_pairs(spark, monkeypatch):
    """A path, a binary tree and a hub, with rings in them, are counted without pairs, in a logarithm of rounds."""
    tables = []
    made = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, label: tables.append(label) or made(df, label))
    path = [(f"p{i:03}", f"p{i + 1:03}") for i in range(200)] + [("p100", "p098")]
    tree = [(f"t{i}", f"t{i // 2}") for i in range(2, 128)] + [("t9", "t18"), ("t5", "t5")]
    hub = [(f"s{i}", "hub") for i in range(300)] + [("hub", "t7")]
    edges = path + tree + hub
    want = {}
    for a, seen in far(edges).items():
        for b in seen:
            want[b] = want.get(b, 0) + 1
    got = [(r.target, r.referrers) for r in graph.referrer_counts(table(spark, edges)).collect()]
    assert len(got) == len(want) and dict(got) == want
    assert "closure" not in tables and tables.count("upstream") <= 10


def test_referrers_behind_forks(spark, monkeypatch):
    """Pairs are made of what lies behind a fork only; trees that lead there, and from there, are weighed."""
    pairs = []
    whole = graph.closure
    monkeypatch.setattr(graph, "closure", lambda edges: pairs.append(edges.count()) or whole(edges))
    feed = [(f"a{i}", f"a{i // 2}") for i in range(2, 40)] + [("a1", "x"), ("a6", "a12")]
    diamond = [("x", "y"), ("x", "z"), ("y", "w"), ("z", "w"), ("w", "v0"), ("v0", "v1"), ("v1", "v0"), ("b", "y"), ("c", "b")]
    edges = feed + diamond
    want = {}
    for a, seen in far(edges).items():
        for b in seen:
            want[b] = want.get(b, 0) + 1
    assert {r.target: r.referrers for r in graph.referrer_counts(table(spark, edges)).collect()} == want
    assert pairs == [5]


def test_closure_extends_pairs_of_its_distance_only(spark, monkeypatch):
    """Marked are the pairs whose distance is the round's, also where a longer way leads to the same end, or a ring."""
    tables = []
    made = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, label: tables.append(made(df, label)) or tables[-1])
    line = [(f"n{i:02}", f"n{i + 1:02}") for i in range(20)]
    edges = line + [("n03", "n05"), ("n02", "n10"), ("r0", "r1"), ("r1", "r2"), ("r2", "r0")]
    reach = far(edges)
    got = [(r.start, r.node) for r in graph.closure(table(spark, edges)).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in reach for b in reach[a]}
    distance = {(a, b): 1 for a, b in edges}
    for _ in range(25):
        for (a, b), n in list(distance.items()):
            for c, d in edges:
                if c == b and distance.get((a, d), 99) > n + 1:
                    distance[a, d] = n + 1
    for k, t in enumerate(tables):
        assert {(r.start, r.node) for r in t.where("far").collect()} == {p for p, n in distance.items() if n == 1 << k}

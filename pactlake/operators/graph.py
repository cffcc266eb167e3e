"""The reference graph: who depends on whom, transitively.

Edges are (src, dst): src refers to dst. Closures grow semi-naively: each round joins only the pairs
found in the round before, and every round is written to the shared folder, so lineage stays short
and a lost executor costs one round.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from ..wire import Wire
from .condensation import chains_of, strong_components


def reach(starts: DataFrame, edges: DataFrame, source: str = "src", target: str = "dst") -> DataFrame:
    """(start, node): every node reached from each start by one edge or more, cycles tolerated.

    ``starts`` has one column ``start``; an edge leads from column ``source`` to column ``target``.
    """
    steps = materialize(edges.select(F.col(source).alias("a"), F.col(target).alias("b")).distinct(), "edges")
    front = materialize(
        starts.select("start").distinct().join(steps, F.col("start") == F.col("a")).select("start", F.col("b").alias("node")).distinct(),
        "front",
    )
    seen = front
    while not front.isEmpty():
        grown = front.join(steps, F.col("node") == F.col("a")).select("start", F.col("b").alias("node")).distinct()
        front = materialize(grown.join(seen, ["start", "node"], "left_anti"), "front")
        seen = seen.unionByName(front)
    return seen


def closure(edges: DataFrame) -> DataFrame:
    """(start, node) for every node that starts an edge, in as many rounds as the longest distance has
    binary digits. A round extends the pairs of exactly its distance, marked ``far``, by everything known, so
    distances double, and where one shortest way leads a pair is made once only."""
    front = materialize(edges.select(F.col("src").alias("start"), F.col("dst").alias("node"), F.lit(True).alias("far")).distinct(), "closure")
    seen = front
    while not front.isEmpty():
        onward = seen.select(F.col("start").alias("node"), F.col("node").alias("end"), "far")
        # A shorter way to the same end has a shorter rest, whose mark is off.
        grown = front.where("far").select("start", "node").join(onward, "node").groupBy("start", F.col("end").alias("node")).agg(F.min("far").alias("far"))
        front = materialize(grown.join(seen.select("start", "node"), ["start", "node"], "left_anti"), "closure")
        seen = seen.withColumn("far", F.lit(False)).unionByName(front)
    return seen.select("start", "node")


def reach_any(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """(node): the nodes reached from at least one start, and the starts themselves."""
    steps = materialize(edges.select("src", "dst").distinct(), "edges")
    front = materialize(starts.select(F.col("start").alias("node")).distinct(), "front")
    seen = front
    while not front.isEmpty():
        grown = front.join(steps, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        front = materialize(grown.join(seen, "node", "left_anti"), "front")
        seen = seen.unionByName(front)
    return seen


class Reach(NamedTuple):
    """Who reaches whom, told between strongly connected components: ``members`` (node, component, cyclic) and
    ``pairs`` (start, node) of different components, of which the first reaches the second. A node reaches
    the members of its own component, itself included, if that is cyclic."""

    members: DataFrame
    pairs: DataFrame


def _condensed(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``members`` as of :class:`Reach`, and the distinct edges (src, dst) between different components."""
    edges = materialize(edges.where("src is not null and dst is not null").select("src", "dst").distinct(), "edges")
    part = strong_components(edges)
    of = lambda c: part.select(F.col("node").alias(c), F.col("component").alias(f"{c}_of"))
    joined = materialize(edges.join(of("src"), "src").join(of("dst"), "dst"), "joined")
    cyclic = joined.where("src_of = dst_of").select(F.col("src_of").alias("component")).distinct().withColumn("cyclic", F.lit(True))
    members = part.join(cyclic, "component", "left").select("node", "component", F.coalesce("cyclic", F.lit(False)).alias("cyclic"))
    between = joined.where("src_of <> dst_of").select(F.col("src_of").alias("src"), F.col("dst_of").alias("dst")).distinct()
    return materialize(members, "members"), between


def condensed_reach(edges: DataFrame) -> Reach:
    """The closure on the condensation: a ring of any length is one component, and no pairs."""
    members, between = _condensed(edges)
    return Reach(members, closure(between))


def transitive_referrers(edges: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """(target, referrer): every node that reaches the target. Its size is the number of such pairs; see
    :func:`condensed_reach` for the same without listing them, and :func:`referrer_counts`."""
    if targets is None:
        reach_ = condensed_reach(edges)
        member = lambda c, name: reach_.members.select(F.col("component").alias(c), F.col("node").alias(name))
        apart = reach_.pairs.join(member("node", "target"), "node").join(member("start", "referrer"), "start")
        rings = reach_.members.where("cyclic")
        same = rings.select("component", F.col("node").alias("target")).join(rings.select("component", F.col("node").alias("referrer")), "component")
        return apart.select("target", "referrer").unionByName(same.select("target", "referrer"))
    found = reach(targets.select(F.col("target").alias("start")), edges, "dst", "src")
    return found.select(F.col("start").alias("target"), F.col("node").alias("referrer"))


def _upstream(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, size, total, mixed) of ``nodes`` (node, size) and acyclic, distinct ``edges`` (src, dst). ``mixed`` are
    nodes with several edges out and all that those reach; who reaches any other node does so in one way, and
    ``total`` adds their sizes and its own.

    Whoever has one edge out points along it, and sums move along pointers that double, so a path costs a
    logarithm of rounds and a tree no pairs.
    """
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out"), F.min("dst").alias("next"))
    out = materialize(out.select("node", F.when(F.col("out") == 1, F.col("next")).alias("next"), (F.col("out") > 1).alias("mixed")), "out")
    forks = out.where("mixed").select(F.col("node").alias("src"))
    forked = edges.join(forks, "src", "left_semi").select(F.col("dst").alias("node")).distinct().withColumn("forked", F.lit(True))
    state = nodes.join(out, "node", "left").join(forked, "node", "left").select(
        "node", "size", "next", F.col("size").alias("total"), (F.coalesce("mixed", F.lit(False)) | F.coalesce("forked", F.lit(False))).alias("mixed"))
    state = materialize(state, "upstream")
    while not (open_ := state.where("next is not null")).isEmpty():
        got = open_.groupBy(F.col("next").alias("node")).agg(F.sum("total").alias("more"), F.max("mixed").alias("theirs"))
        moved = open_.join(state.select(F.col("node").alias("next"), F.col("next").alias("beyond")), "next")
        moved = moved.select("node", "size", F.col("beyond").alias("next"), "total", "mixed").unionByName(state.where("next is null"))
        state = materialize(moved.join(got, "node", "left").select(
            "node", "size", "next", (F.col("total") + F.coalesce("more", F.lit(0))).alias("total"), (F.col("mixed") | F.coalesce("theirs", F.lit(False))).alias("mixed")), "upstream")
    return state.select("node", "size", "total", "mixed")


def referrer_counts(edges: DataFrame) -> DataFrame:
    """(target, referrers): by how many nodes each node is reached, itself included on a cycle. Pairs of nodes
    are not listed: components are counted, weighted by their members. Pairs of components are made only of those
    that lie behind a component with several edges out; what leads there in one way adds to the weight of where it ends."""
    members, between = _condensed(edges)
    between = materialize(between, "between")
    sizes = materialize(members.groupBy(F.col("component").alias("node")).agg(F.count("*").alias("size"), F.max("cyclic").alias("cyclic")), "sizes")
    state = _upstream(sizes.select("node", "size"), between)
    plain = state.where("not mixed")
    far = plain.select("node", (F.col("total") - F.col("size")).alias("far"))
    if not state.where("mixed").isEmpty():
        mixed = materialize(state.where("mixed").select("node", "size"), "mixed")
        ends = between.join(plain.select(F.col("node").alias("src"), "total"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum("total").alias("led"))
        weights = materialize(mixed.join(ends, "node", "left").select("node", (F.col("size") + F.coalesce("led", F.lit(0))).alias("weight"), F.coalesce("led", F.lit(0)).alias("led")), "weights")
        pairs = closure(between.join(mixed.select(F.col("node").alias("src")), "src", "left_semi"))
        over = pairs.join(weights.select(F.col("node").alias("start"), "weight"), "start").groupBy("node").agg(F.sum("weight").alias("over"))
        far = far.unionByName(weights.join(over, "node", "left").select("node", (F.col("led") + F.coalesce("over", F.lit(0))).alias("far")))
    near = sizes.select("node", F.when(F.col("cyclic"), F.col("size")).otherwise(0).alias("near"))
    counts = materialize(near.join(far, "node").select(F.col("node").alias("component"), (F.col("near") + F.col("far")).alias("referrers")), "counts")
    return members.join(counts, "component").where("referrers > 0").select(F.col("node").alias("target"), "referrers")


def reference_cycles(edges: DataFrame) -> DataFrame:
    """Shortest cycle through each node that lies on one, each cycle once: (path, length).

    A cycle is reported from its smallest node; of several as short, the one whose path is least from the node.
    Only edges within a strongly connected component can lie on a cycle. There chains of nodes with one way
    through are edges of their own length: whoever goes through one node of a chain goes through all, so walks
    start at the anchors between them only, and a ring is no walk at all. Per start and node only the least
    of the shortest paths survives.
    """
    edges = materialize(edges.where("src is not null and dst is not null").select("src", "dst").distinct(), "edges")
    part = strong_components(edges)
    of = lambda c: part.select(F.col("node").alias(c), F.col("component").alias(f"{c}_of"))
    inside = materialize(edges.where("src <> dst").join(of("src"), "src").join(of("dst"), "dst").where("src_of = dst_of").select("src", "dst"), "inside")
    loops = edges.where("src = dst").select(F.array("src", "dst").alias("path"))
    chains = chains_of(inside)
    listed = lambda df, by: df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct((-F.col("left")).alias("at"), "node"))).alias("nodes")).withColumn("nodes", F.col("nodes.node"))
    rings = listed(chains.rings, ["ring"]).select(F.concat(F.array(F.element_at("nodes", -1)), F.slice("nodes", F.lit(1), F.size("nodes") - 1), F.array(F.element_at("nodes", -1))).alias("path"))
    # A step goes from anchor to anchor: `via` is what it passes, its end included.
    by_chain = materialize(listed(chains.inner, ["chain", "tail", "head"]).select(F.col("tail").alias("src"), F.col("head").alias("dst"), F.concat("nodes", F.array("head")).alias("via")), "by_chain")
    gone = chains.rings.select("node").unionByName(chains.inner.select("node"))
    plain = inside.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
    steps = materialize(plain.select("src", "dst", F.array("dst").alias("via")).unionByName(by_chain), "ways")
    least = lambda df: df.groupBy("start", "node").agg(F.min(F.struct(F.size("path").alias("n"), "path")).alias("p")).select("start", "node", "p.path")
    # Lengths differ, so a path is settled in the round of its length: nothing shorter can come later.
    open_ = materialize(least(steps.select(F.col("src").alias("start"), F.col("dst").alias("node"), F.concat(F.array("src"), "via").alias("path"))), "paths")
    settled, length = open_.limit(0), 0
    while (length := open_.agg(F.min(F.size("path"))).first()[0]) is not None:
        front = materialize(open_.where(F.size("path") == length), "front")
        settled = settled.unionByName(front)
        onward = front.where("start <> node").join(steps, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node"), F.concat("path", "via").alias("path"))
        rest = open_.where(F.size("path") > length).unionByName(onward)
        open_ = materialize(least(rest.join(settled.select("start", "node"), ["start", "node"], "left_anti")), "paths")
    closed = settled.where("start = node").select("path")
    # Through the nodes of a chain: the chain, then the least way from its head back to its tail.
    back = settled.where("start <> node").select(F.col("start").alias("dst"), F.col("node").alias("src"), F.slice("path", F.lit(2), F.size("path")).alias("back"))
    through = by_chain.join(back, ["src", "dst"], "left").where("src = dst or back is not null")
    closed = closed.unionByName(through.select(F.concat(F.array("src"), "via", F.coalesce("back", F.array().cast("array<string>"))).alias("path")))
    return _from_least(closed.unionByName(rings).unionByName(loops)).distinct().withColumn("length", F.size("path") - 1)


def _from_least(cycles: DataFrame) -> DataFrame:
    """(path): cycles, which end where they start, turned to start at their least node."""
    low = F.array_min("path")
    at = F.array_position("path", low).cast("int")
    ring = F.slice("path", F.lit(1), F.size("path") - 1)
    turned = F.concat(F.slice(ring, at, F.size(ring)), F.slice(ring, F.lit(1), at - 1), F.array(low))
    return cycles.select(turned.alias("path"))


def version_edges(versions: DataFrame, edges: DataFrame, wire: Wire = Wire()) -> DataFrame:
    """Schema-level edges resolved to versions: (src, dst) of schema ids.

    ``edges`` are the rows of ``extract_references``; an edge to a version that does not exist has
    dst null.
    """
    target = versions.select(
        F.lower("environment_id").alias("environment"), "subject", F.col("ordinal").alias("version"), F.col("schema_id").alias("dst")
    )
    return edges.join(target, ["environment", "subject", "version"], "left").select(
        F.col("schema_id").alias("src"), "dst", "name", "subject", "version"
    )


def latest_versions(subjects: DataFrame, versions: DataFrame) -> DataFrame:
    """Each subject that is not retired with its latest version (null when none)."""
    live = subjects.where("lifecycle <> 'Retired'").select("environment_id", "subject", "format", F.col("latest_ordinal").alias("ordinal"))
    return live.join(
        versions.select("environment_id", "subject", "ordinal", "schema_id", "semver"), ["environment_id", "subject", "ordinal"], "left"
    )


def latest_snapshot(subjects: DataFrame, versions: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(subjects, schemas): ``latest_versions`` and the ids of all schemas those need, transitively.

    ``edges`` are (src, dst) schema ids."""
    listed = latest_versions(subjects, versions)
    roots = listed.where("schema_id is not null").select(F.col("schema_id").alias("start")).distinct()
    return listed, reach_any(roots, edges.where("dst is not null")).select(F.col("node").alias("schema_id"))

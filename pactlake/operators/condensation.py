"""Strongly connected components of an edge table (src, dst), and chains of nodes that have one way through.

Three reductions alternate. Nodes without an edge in or out are components of their own. A chain, whose nodes
have one edge in and one out, becomes one edge; pointers along it double, so its length costs a logarithm of
rounds. Both together take trees, paths and rings apart in logarithmically many rounds. What is left is coloured:
every node takes the largest name that reaches it, and who reaches that name back within the colour is its
component. Every round is a written table.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


#: A round that leaves more than this share of the edges has done little, and the next reduction follows.
LITTLE = 0.8


class Chains(NamedTuple):
    """``rings`` (node, ring, left): closed chains, named by their least node, and how far it is ahead.
    ``inner`` (node, chain, left, tail, head): open chains, named by their last node, from anchor ``tail`` to
    anchor ``head``; ``left`` counts the nodes of the chain that follow."""

    rings: DataFrame
    inner: DataFrame


def _doubled(pointers: DataFrame) -> DataFrame:
    """(node, end, left) of ``pointers`` (node, next), each node having one next at most: the end of each node's
    path, which has no pointer of its own, and its distance. Nodes of a ring keep an end that has a pointer."""
    steps = materialize(pointers.select("node", F.col("next").alias("end"), F.lit(1).cast("long").alias("left")), "steps")
    total, rounds = steps.count(), 0
    if not total:
        return steps
    open_ = steps.join(steps.select(F.col("node").alias("end")), "end", "left_semi").select("node", "end", "left")
    done = steps.join(steps.select(F.col("node").alias("end")), "end", "left_anti").select("node", "end", "left")
    open_, done = materialize(open_, "open"), materialize(done, "done")
    while 1 << rounds < total and not open_.isEmpty():
        known = done.unionByName(open_)
        on = known.select(F.col("node").alias("end"), F.col("end").alias("beyond"), F.col("left").alias("more"))
        moved = materialize(open_.join(on, "end").select("node", F.col("beyond").alias("end"), (F.col("left") + F.col("more")).alias("left")), "moved")
        closed = materialize(moved.join(steps.select(F.col("node").alias("end")), "end", "left_anti").select("node", "end", "left"), "closed")
        done = done.unionByName(closed)
        open_ = materialize(moved.join(closed.select("node"), "node", "left_anti"), "open")
        rounds += 1
    return done.unionByName(open_)


def _least_ahead(ring: DataFrame) -> DataFrame:
    """(node, least): the least node of each closed chain of ``ring`` (node, next)."""
    state = materialize(ring.select("node", "next", F.least("node", "next").alias("least")), "ring")
    total, rounds = state.count(), 0
    while 1 << rounds < total:
        on = state.select(F.col("node").alias("next"), F.col("next").alias("beyond"), F.col("least").alias("theirs"))
        state = materialize(state.join(on, "next").select("node", F.col("beyond").alias("next"), F.least("least", "theirs").alias("least")), "ring")
        rounds += 1
    return state.select("node", "least")


def chains_of(edges: DataFrame) -> Chains:
    """The chains of ``edges`` (src, dst), which must be distinct; a loop counts as an edge in and out."""
    role = edges.select(F.col("src").alias("node"), F.col("dst").alias("next"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(
        edges.select(F.col("dst").alias("node"), F.lit(None).cast(edges.schema["src"].dataType).alias("next"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    through = role.groupBy("node").agg(F.max("next").alias("next"), F.sum("o").alias("o"), F.sum("i").alias("i")).where("i = 1 and o = 1").select("node", "next")
    through = materialize(through, "through")
    single = through.select("node")
    within = materialize(through.join(single.withColumnRenamed("node", "next"), "next", "left_semi").select("node", "next"), "within")
    walked = _doubled(within)
    # Whoever's end still leads on has gone round.
    ringed = materialize(walked.join(within.select(F.col("node").alias("end")), "end", "left_semi").select("node"), "ringed")
    ring = within.join(ringed, "node", "left_semi")
    least = materialize(_least_ahead(ring), "least") if not ringed.isEmpty() else ringed.withColumn("least", F.col("node"))
    cut = _doubled(ring.join(least, "node").where("node <> least").select("node", "next")) if not ringed.isEmpty() else walked.limit(0)
    rings = least.join(cut.select("node", "left"), "node", "left").select("node", F.col("least").alias("ring"), F.coalesce("left", F.lit(0)).alias("left"))
    lasts = walked.join(ringed, "node", "left_anti").select("node", F.col("end").alias("chain"), "left")
    alone = single.join(within.select("node"), "node", "left_anti").select("node", F.col("node").alias("chain"), F.lit(0).cast("long").alias("left"))
    placed = materialize(lasts.unionByName(alone), "placed")
    head = through.select(F.col("node").alias("chain"), F.col("next").alias("head"))
    far = placed.groupBy("chain").agg(F.max(F.struct("left", "node")).alias("first")).select("chain", F.col("first.node").alias("dst"))
    tail = edges.join(far, "dst").select("chain", F.col("src").alias("tail"))
    ends = materialize(head.join(tail, "chain"), "ends")
    return Chains(materialize(rings, "rings"), materialize(placed.join(ends, "chain").select("node", "chain", "left", "tail", "head"), "inner"))


def bridges(chains: Chains) -> DataFrame:
    """(src, dst, chain): the edges that open chains become; those back to where they come from are left out."""
    return chains.inner.where("left = 0 and tail <> head").select(F.col("tail").alias("src"), F.col("head").alias("dst"), "chain")


def _without(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes.withColumnRenamed("node", "src"), "src", "left_anti").join(nodes.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")


def _trimmed(edges: DataFrame) -> DataFrame:
    """The edges whose ends have an edge in and an edge out."""
    has_in, has_out = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
    return edges.join(has_in, "src", "left_semi").join(has_out, "dst", "left_semi").select("src", "dst")


def _coloured(edges: DataFrame) -> DataFrame:
    """(node, component) of those nodes that reach back to the largest name that reaches them."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    color = materialize(nodes.select("node", F.col("node").alias("color")), "color")
    fresh = color
    while not fresh.isEmpty():
        offered = edges.join(fresh.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("color").alias("offered"))
        fresh = materialize(offered.join(color, "node").where("offered > color").select("node", F.col("offered").alias("color")), "fresh")
        color = materialize(color.join(fresh.withColumnRenamed("color", "newer"), "node", "left").select("node", F.coalesce("newer", "color").alias("color")), "color")
    one, two = color.select(F.col("node").alias("src"), F.col("color").alias("cs")), color.select(F.col("node").alias("dst"), F.col("color").alias("cd"))
    inside = materialize(edges.join(one, "src").join(two, "dst").where("cs = cd").select("src", "dst", F.col("cs").alias("color")), "inside")
    front = materialize(color.where("node = color"), "back")
    found = front
    while not front.isEmpty():
        grown = inside.join(front.withColumnRenamed("node", "dst"), ["dst", "color"]).select(F.col("src").alias("node"), "color").distinct()
        front = materialize(grown.join(found, ["node", "color"], "left_anti"), "back")
        found = found.unionByName(front)
    return found.select("node", F.col("color").alias("component"))


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (src, dst): the least node of its strongly connected
    component. Loops and repeated edges are allowed; rows with a null end are left out."""
    edges = edges.where("src is not null and dst is not null").select("src", "dst").distinct()
    edges = materialize(edges, "edges")
    nodes = materialize(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct(), "nodes")
    left = materialize(edges.where("src <> dst"), "left")
    known, chained = nodes.select("node", F.col("node").alias("component")).limit(0), []
    size = left.count()
    while size:
        left = materialize(_trimmed(_trimmed(left)), "left")
        before, size = size, left.count()
        if size <= LITTLE * before:
            continue
        chains = chains_of(left)
        known = known.unionByName(chains.rings.select("node", F.col("ring").alias("component")))
        if not chains.inner.isEmpty():
            chained.append(chains.inner.select("node", "tail", "head"))
        left = materialize(_without(left, chains.rings.select("node").unionByName(chains.inner.select("node"))).unionByName(bridges(chains).select("src", "dst")).distinct(), "left")
        size = left.count()
        if size > LITTLE * before:
            found = materialize(_coloured(left), "found")
            known = known.unionByName(found)
            left = materialize(_without(left, found.select("node")), "left")
            size = left.count()
    # A chain belongs to its anchors' component, if they share one; what is not named is alone.
    known = materialize(known, "known")
    for inner in reversed(chained):
        side = lambda c: known.select(F.col("node").alias(c), F.col("component").alias(f"{c}_of"))  # noqa: E731, B023
        met = inner.join(side("tail"), "tail", "left").join(side("head"), "head", "left")
        same = F.coalesce("tail_of", "tail") == F.coalesce("head_of", "head")
        known = materialize(known.unionByName(met.where(same).select("node", F.coalesce("tail_of", "tail").alias("component"))), "known")
    named = nodes.join(known, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    named = materialize(named, "named")
    least = named.groupBy("component").agg(F.min("node").alias("least"))
    return materialize(named.join(least, "component").select("node", F.col("least").alias("component")), "components")

"""Connected components of an edge table, by large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlake import materialize


def _stars(edges: DataFrame) -> bool:
    """Whether every node of ``edges`` (a, b) is only a centre, or hangs on one centre."""
    roles = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return roles.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty()


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One star operation. ``edges`` have a > b. Every node's neighbours are hung on the least of them."""
    pairs = edges if small else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # The least neighbour of a node is a map-side minimum; the join that follows has a plain table on either
    # side, so that adaptive execution can split the rows of a hub.
    least = materialize(pairs.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), "star")
    joined = pairs.join(least, "a")
    if small:
        hung = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    else:
        hung = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return materialize(hung.where("a <> b").distinct(), "edges")


def connected_components(edges: DataFrame, contract: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the least node that links reach.

    Loops, repeated edges and edges in either direction are allowed; rows with a null end are left out.
    Each round writes its edges to the shared folder. The number of rounds grows with the logarithm of
    the longest chain; hubs cost no more than their edges. ``contract`` may join edges (a > b) within tasks,
    which saves rounds.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = materialize(contract(edges) if contract else edges.distinct(), "edges")
    while not _stars(edges):
        edges = _star(_star(edges, small=False), small=True)
        edges = materialize(contract(edges), "edges") if contract else edges
    edges = edges.distinct()
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)

"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations, with multiprobe buckets."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlake import materialize

from .components import connected_components
from .kernels import mix

#: Rows of a bucket that one task holds; larger buckets are compared block by block.
BLOCK = 1024


class Hashing(NamedTuple):
    """``tables`` hash tables, each of ``width`` cross-polytope codes; ``probes`` further buckets a table.

    A vector is put into its own bucket and into those of its ``probes`` next nearest cross-polytope corners.
    """

    tables: int = 10
    width: int = 3
    probes: int = 3
    seed: int = 17


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of every row, unnormalised; the length must be a power of two."""
    x = x.copy()
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), -1, 2, h)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2).reshape(-1, n)
        h *= 2
    return x


def corners(unit: np.ndarray, hashing: Hashing) -> np.ndarray:
    """Per table and vector: the buckets (own first, then probes) as 64-bit numbers.

    A rotation is three rounds of random signs and a Hadamard transform. The nearest corner of the cross
    polytope is the largest coordinate with its sign. Probes change the code whose second corner is nearest.
    """
    n, d = unit.shape
    size = 1 << max(4, (d - 1).bit_length(), (2 * hashing.probes).bit_length())
    padded = np.zeros((n, size))
    padded[:, :d] = unit
    draw = np.random.default_rng(hashing.seed)
    out = np.zeros((hashing.tables, 1 + hashing.probes, n), np.int64)
    for t in range(hashing.tables):
        codes, second, loss = [], [], []
        for _ in range(hashing.width):
            x = padded
            for _ in range(3):
                x = hadamard(x * draw.choice([-1.0, 1.0], size)) / np.sqrt(size)
            order = np.argsort(-np.abs(x), axis=1, kind="stable")[:, : 1 + hashing.probes]
            value = np.take_along_axis(x, order, axis=1)
            corner = 2 * order + (value < 0)
            codes.append(corner[:, 0])
            second.append(corner[:, 1:])
            loss.append(np.abs(value[:, :1]) - np.abs(value[:, 1:]))
        base = np.stack(codes, axis=1)
        out[t, 0] = _join(base, size)
        # All single changes, cheapest first.
        change = np.concatenate(loss, axis=1)
        cheapest = np.argsort(change, axis=1, kind="stable")[:, : hashing.probes]
        for p in range(hashing.probes):
            which, rank = cheapest[:, p] // hashing.probes, cheapest[:, p] % hashing.probes
            probe = base.copy()
            for k in range(hashing.width):
                mine = which == k
                probe[mine, k] = second[k][mine, rank[mine]]
            out[t, 1 + p] = _join(probe, size)
    return out


def _join(codes: np.ndarray, size: int) -> np.ndarray:
    total = np.zeros(len(codes), np.int64)
    for k in range(codes.shape[1]):
        total = total * (2 * size) + codes[:, k]
    return total


def _with_buckets(vectors: DataFrame, hashing: Hashing) -> DataFrame:
    """The rows (label, size, node, rows, embedding) with unit vectors and ``buckets``, all that a vector lies in.

    A bucket's number holds its table, the label and the length, so equal numbers mean the same bucket.
    """
    schema = "node bigint, rows bigint, unit array<double>, buckets array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy(zero_copy_only=False)
            for d in np.unique(sizes):
                part = batch.filter(pa.array(sizes == d))
                flat = part.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                unit = flat / np.linalg.norm(flat, axis=1, keepdims=True)
                codes = corners(unit, hashing).view(np.uint64)
                label = part.column("label").to_numpy().view(np.uint64) + np.uint64(d)
                table = np.arange(hashing.tables, dtype=np.uint64)[:, None, None]
                listed = mix(mix(codes * np.uint64(64) + table) ^ mix(label)[None, None, :]).view(np.int64).transpose(2, 0, 1).reshape(len(unit), -1)
                ends = pa.array(np.arange(len(unit) + 1) * listed.shape[1], pa.int32())
                each = pa.array(np.arange(len(unit) + 1) * d, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), part.column("rows"), pa.ListArray.from_arrays(each, pa.array(unit.ravel())), pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(listed).ravel()))],
                    ["node", "rows", "unit", "buckets"],
                )

    return vectors.select("label", "size", "node", "rows", "embedding").mapInArrow(run, schema)


def _least_shared(bucket: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of pairs of bucket lists: whether ``bucket`` is the least that both have."""
    shared = (a[:, :, None] == b[:, None, :]).any(axis=2)
    return np.where(shared, a, np.iinfo(np.int64).max).min(axis=1) == bucket


def _links(bucket: int, left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i of left, j of right) at ``threshold`` or above that count in this bucket."""
    i, j = np.nonzero(left @ right.T >= threshold)
    counts = np.zeros(len(i), bool)
    for at in range(0, len(i), 4096):
        counts[at : at + 4096] = _least_shared(bucket, a[i[at : at + 4096]], b[j[at : at + 4096]])
    return i[counts], j[counts]


def _compare(dealt: DataFrame, threshold: float, parts: int) -> DataFrame:
    """(node, links, root) of each task of ``dealt`` (task, bucket, low, high, block, node, rows, unit, buckets)."""

    def emit(t: pa.Table) -> pa.RecordBatch:
        node, weight = t["node"].to_numpy(), t["rows"].to_numpy()
        task, bucket = t["task"].to_numpy(), t["bucket"].to_numpy()
        block, low, high = t["block"].to_numpy(), t["low"].to_numpy(), t["high"].to_numpy()
        n = len(node)
        unit_lists = t["unit"].combine_chunks()
        lengths = np.diff(unit_lists.offsets.to_numpy())
        flat, starts = unit_lists.flatten().to_numpy(), np.cumsum(lengths) - lengths
        buckets = t["buckets"].combine_chunks().flatten().to_numpy().reshape(n, -1)
        links, parent = np.zeros(n, np.int64), np.arange(n)
        new = (task[1:] != task[:-1]) | (bucket[1:] != bucket[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        head = np.flatnonzero(np.append(True, new))
        for a, b in zip(head.tolist(), [*head[1:].tolist(), n], strict=True):
            if b - a < 2:
                continue
            units = flat[starts[a] : starts[b - 1] + lengths[b - 1]].reshape(b - a, -1)
            within = low[a] == high[a]
            one = np.arange(a, b) if within else a + np.flatnonzero(block[a:b] == low[a])
            two = one if within else a + np.flatnonzero(block[a:b] == high[a])
            i, j = _links(int(bucket[a]), units[one - a], units[two - a], buckets[one], buckets[two], threshold)
            i, j = one[i], two[j]
            if within:
                i, j = i[i < j], j[i < j]
            np.add.at(links, i, weight[j])
            np.add.at(links, j, weight[i])
            _unite(parent[a:b], node[a:b], i - a, j - a, a)
        hit = links > 0
        return pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(links[hit]), pa.array(node[parent[hit]])], ["node", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            task = held["task"].to_numpy()
            whole = int(np.flatnonzero(task != task[-1])[-1]) + 1 if task[0] != task[-1] else 0  # the last may go on
            if whole:
                yield emit(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None and held.num_rows:
            yield emit(held)

    ordered = dealt.repartition(parts, "task").sortWithinPartitions("task", "bucket", "low", "high")
    return ordered.mapInArrow(run, "node bigint, links bigint, root bigint")


def near_vectors(vectors: DataFrame, threshold: float = 0.98, hashing: Hashing = Hashing(), key: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """One row per row: key, n_links, component_id, kept.

    Rows with equal, non-null labels whose cosine, in double precision, is at least ``threshold`` are linked.
    Equal vectors of a label are one node, which knows how many rows it stands for, so copies are never
    paired with each other. Nodes are put into buckets; in each bucket they are compared, block by block,
    and a pair counts in the least bucket that both share, so each link is counted once. What leaves a task
    is the number of links of each node and one edge to the least node it hangs together with, not the pairs.
    Buckets larger than a block are dealt to as many tasks as they have pairs of blocks.

    Defined cases: null, empty and zero vectors and those with null, infinite or NaN components link with
    nothing, nor do rows with a null label; vectors of different lengths are never linked; a repeated row is
    a copy of its twin; a null key has component null and stays; an empty table gives an empty table; other
    columns are ignored. Links that share no bucket are missed: the recall is measured in the tests.
    """
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{label}`").cast("string").alias("label"), F.transform(f"`{vector}`", lambda v: v.cast("double")).alias("embedding"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    sound = F.coalesce(F.col("label").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda v: v != 0), F.lit(False))
    # Negative zero and zero are one value; equal vectors meet under the digest of their components.
    plain = F.transform("embedding", lambda v: v + F.lit(0.0))
    code = F.when(sound, F.sha2(F.concat_ws("|", F.col("label"), F.array_join(plain.cast("array<string>"), ",")), 256))
    # A row that links with nothing is a node of its own, so no key gathers them.
    marked = materialize(rows.select("key", "label", "embedding", sound.alias("sound"), code.alias("code")), "vectors")
    nodes = marked.where("sound").groupBy("code").agg(F.count("*").alias("rows"), F.min("key").alias("least"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    nodes = materialize(nodes.withColumn("node", F.xxhash64("code")).withColumn("size", F.size("embedding")), "nodes")
    hashed = materialize(_with_buckets(nodes.withColumn("label", F.xxhash64("label")), hashing), "hashed")
    placed = hashed.select("node", F.explode(F.array_distinct("buckets")).alias("bucket"))
    crowds = placed.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    crowds = materialize(crowds.withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int")), "crowds")
    dealt = placed.join(crowds, "bucket").withColumn("block", F.pmod(F.xxhash64("node", "bucket"), F.col("blocks")).cast("int"))
    # Block b meets every block: a pair (low, high) is a task.
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("low"), F.greatest(o, F.col("block")).alias("high")))
    dealt = materialize(dealt.select("bucket", "node", "block", F.explode(meets).alias("m")).select("bucket", "node", "block", "m.low", "m.high"), "dealt")
    dealt = dealt.join(hashed, "node").withColumn("task", F.xxhash64("bucket", "low", "high"))
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = materialize(_compare(dealt.select("task", "bucket", "low", "high", "block", "node", "rows", "unit", "buckets"), threshold, parts), "found")
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    members = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    facts = nodes.join(linked, "node", "left").join(members, "node", "left")
    facts = materialize(facts.select("code", (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"), "least"), "facts")
    # Nodes are numbered by their hash; the least key among a component's rows names it.
    names = facts.groupBy("component").agg(F.min("least").alias("component_id"))
    facts = materialize(facts.join(names, "component").select("code", "n_links", "component_id"), "named")
    alone = marked.where("not sound").select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    judged = marked.where("sound").select("key", "code").join(facts, "code").select("key", "n_links", "component_id").unionByName(alone)
    return judged.select(F.col("key").alias(key), "n_links", "component_id", F.coalesce(F.col("key") == F.col("component_id"), F.lit(True)).alias("kept"))


def _unite(parent: np.ndarray, node: np.ndarray, i: np.ndarray, j: np.ndarray, base: int) -> None:
    """Hang the ends of every pair on the one with the least node; in place. ``parent`` counts from ``base``."""
    up = parent - base
    while len(i):
        a, b = up[i], up[j]
        swap = node[a] < node[b]
        low, high = np.where(swap, a, b), np.where(swap, b, a)
        open_ = low != high
        i, j, low, high = i[open_], j[open_], low[open_], high[open_]
        # Of several that want the same root the least wins; the others come round again.
        order = np.argsort(-node[low], kind="stable")
        up[high[order]] = low[order]
        while True:
            above = up[up]
            if (above == up).all():
                break
            up = above
    parent[:] = up + base

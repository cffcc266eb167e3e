"""MinHash near-dedup by an LSH forest: documents that stand together in sorted signature orders are compared."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactlake import materialize

from .components import connected_components
from .kernels import TextChunk, Words, bound_batches, contracted, explode_texts, grams, mix, spans_hash


class Forest(NamedTuple):
    """``trees`` orders of the signature; tree t begins at its value ``least_depth`` * t and goes round.

    Documents are neighbours where they share the first ``least_depth`` values of an order. A region of more
    than ``crowd`` neighbours is looked at deeper, twice as deep each time. Neighbours whose signatures agree
    in a share of ``floor`` are candidates: at a similarity of 0.8 that is 4.5 standard deviations below. Each
    gives its ``nearest`` ones; one whose best agrees in less than ``sure`` may hang on any of several, and
    gives ``unsure`` of them. What lies between components is compared in blocks of ``block`` members and
    ``block_shingles`` shingles.
    """

    trees: int = 32
    least_depth: int = 4
    crowd: int = 512
    floor: float = 0.64
    nearest: int = 3
    sure: float = 0.88
    unsure: int = 24
    block: int = 1024
    block_shingles: int = 1 << 20

    @property
    def values(self) -> int:
        return self.trees * self.least_depth


def shingle_sets(chunk: TextChunk, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash), sorted, of each row's distinct shingles of ``size`` words; shorter rows are one shingle."""
    words = Words(chunk, fold=True)
    hashes, _, row = grams(words, size)
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    if len(short):
        whole = spans_hash(words.hash, words.first[short], words.first[short + 1])
        hashes, row = np.concatenate([hashes, whole]), np.concatenate([row, short])
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    return row[new], hashes[new]


def signatures(row: np.ndarray, hashes: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have shingles, their ``count`` minima as unsigned 32-bit values)."""
    head = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
    out = np.empty((len(head), count), np.uint32)
    if len(head):
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        draw = np.random.default_rng(20)
        for k, (salt, odd) in enumerate(draw.integers(1, 1 << 32, (count, 2), dtype=np.uint64).astype(np.uint32)):
            y = (x ^ salt) * (odd | np.uint32(1))
            y ^= y >> np.uint32(15)
            y *= np.uint32(0x2C1B3C6D)
            y ^= y >> np.uint32(13)
            out[:, k] = np.minimum.reduceat(y, head)
    return row[head], out


def sketches(docs: DataFrame, size: int, forest: Forest) -> DataFrame:
    """(doc_id, uid, n_shingles, f1, f2, keys, sketch) of ``docs`` (doc_id, uid, text).

    ``f1`` and ``f2`` together tell sets apart; ``keys`` has for each tree a hash of its first values;
    ``sketch`` keeps the low eight bits of each value (the high ones of a minimum are mostly zero).
    """
    trees, depth, values = forest.trees, forest.least_depth, forest.values

    def kernel(chunk: TextChunk) -> tuple[np.ndarray, dict[str, object]]:
        row, hashes = shingle_sets(chunk, size)
        have, sign = signatures(row, hashes, values)
        n = np.bincount(row, minlength=chunk.rows).astype(np.int64)
        f1, f2 = np.zeros(chunk.rows, np.uint64), np.zeros(chunk.rows, np.uint64)
        keys = np.zeros((chunk.rows, trees), np.uint64)
        sketch = np.zeros((chunk.rows, values), np.uint8)
        if len(have):
            head = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            f1[have] = mix(np.add.reduceat(mix(hashes), head) + n[have].astype(np.uint64))
            f2[have] = np.bitwise_xor.reduceat(mix(hashes * np.uint64(0x9FB21C651E98DF25)), head)
            at = np.arange(trees) * depth
            flat = sign.reshape(-1).astype(np.uint64)
            begin = (np.arange(len(have))[:, None] * values + at[None, :]).ravel()
            keys[have] = mix(spans_hash(flat, begin, begin + depth).reshape(-1, trees) ^ np.arange(1, trees + 1, dtype=np.uint64)[None, :])
            sketch[have] = (sign & np.uint32(0xFF)).astype(np.uint8)
        ends = pa.array(np.arange(chunk.rows + 1) * trees, pa.int32())
        return np.arange(chunk.rows), {
            "n_shingles": n,
            "f1": f1.view(np.int64),
            "f2": f2.view(np.int64),
            "keys": pa.ListArray.from_arrays(ends, pa.array(keys.view(np.int64).ravel())),
            "sketch": pa.array([x.tobytes() for x in sketch], pa.binary()),
        }

    return explode_texts(docs, ["doc_id", "uid"], "text", kernel, {"n_shingles": "bigint", "f1": "bigint", "f2": "bigint", "keys": "array<bigint>", "sketch": "binary"})


def neighbourhoods(nodes: DataFrame, forest: Forest) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(key, node, sketch) three times: of all regions of five or more at the least depth, of regions of at
    most ``crowd`` at any depth, and of all crowded regions (None: there are none).

    Depth adapts: only the regions that are still too large are looked at one step deeper. One that is too
    large at full depth is dealt out to regions of about half a crowd. A crowded region at any depth has a
    hub, so that who stands alone at the next depth has a candidate too.
    """
    placed = nodes.select("node", F.posexplode("keys").alias("tree", "key"))

    def shared(rows: DataFrame) -> DataFrame:
        return materialize(rows.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "regions")

    held = materialize(placed.join(shared(placed), "key").join(nodes.select("node", "sketch"), "node").select("tree", "key", "node", "sketch", "members"), "held")
    region = ["key", "node", "sketch"]
    whole, done = held.where("members > 4").select(region), held.where(F.col("members") <= forest.crowd).select(region)
    hubs, depth = None, forest.least_depth
    while not (crowded := held.where(F.col("members") > forest.crowd)).isEmpty():
        hubs = crowded.select(region) if hubs is None else hubs.unionByName(crowded.select(region))
        if depth >= forest.values:
            dealt = F.xxhash64("key", F.pmod(F.xxhash64("node"), F.ceil(2 * F.col("members") / forest.crowd)))
            return whole, done.unionByName(crowded.select(dealt.alias("key"), "node", "sketch")), hubs
        depth *= 2
        doubled = F.concat("sketch", "sketch")
        deeper = F.xxhash64("tree", F.lit(depth), "key", F.substring(doubled, F.col("tree") * forest.least_depth + 1, F.lit(min(depth, forest.values))))
        rows = materialize(crowded.select("tree", deeper.alias("key"), "node", "sketch"), "deeper")
        held = materialize(rows.join(shared(rows), "key").select("tree", "key", "node", "sketch", "members"), "held")
        done = done.unionByName(held.where(F.col("members") <= forest.crowd).select(region))
    return whole, done, hubs


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).sum(axis=-1)


def spokes(crowded: DataFrame, forest: Forest) -> DataFrame:
    """(a, b, agree) with a < b: each member of a crowded region with the region's hub, its least node."""
    least = int(np.ceil(forest.floor * forest.values))
    hubs = materialize(crowded.groupBy("key").agg(F.min(F.struct("node", "sketch")).alias("hub")), "hubs")
    rows = crowded.join(hubs, "key").where("node <> hub.node").select(F.col("hub.node").alias("a"), F.col("node").alias("b"), F.col("hub.sketch").alias("x"), F.col("sketch").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (2, 3))
            agree = _agreement(x, y)
            near = pa.array(agree >= least)
            yield pa.RecordBatch.from_arrays([c.filter(near) for c in (batch.column(0), batch.column(1), pa.array(agree.astype(np.int32)))], ["a", "b", "agree"])

    return rows.mapInArrow(run, "a bigint, b bigint, agree int")


def _edges_of_region(node: np.ndarray, sketch: np.ndarray, forest: Forest) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidates of a region: each member's nearest ones, and a spanning forest of greatest agreement."""
    m = len(node)
    agree = np.zeros((m, m), np.int16)
    for k in range(sketch.shape[1]):
        agree += sketch[:, k][:, None] == sketch[:, k][None, :]
    np.fill_diagonal(agree, -1)
    best = np.argsort(-agree, axis=1, kind="stable")[:, : min(forest.unsure, m - 1)]
    many = agree.max(axis=1) < forest.sure * forest.values
    wanted = many[:, None] | (np.arange(best.shape[1]) < forest.nearest)[None, :]
    i, j = np.nonzero(wanted)[0], best[wanted]
    # Prim's algorithm over the dense matrix.
    reach, by, left = agree[0].copy(), np.zeros(m, np.int64), np.ones(m, bool)
    left[0] = False
    more_i, more_j = [], []
    for _ in range(m - 1):
        x = int(np.argmax(np.where(left, reach, -2)))
        more_i.append(x)
        more_j.append(int(by[x]))
        left[x] = False
        better = agree[x] > reach
        reach[better], by[better] = agree[x][better], x
    i, j = np.append(i, more_i), np.append(j, more_j)
    value = agree[i, j]
    keep = value >= forest.floor * forest.values
    return i[keep], j[keep], value[keep]


def candidates(regions: DataFrame, crowded: DataFrame | None, forest: Forest, parts: int) -> DataFrame:
    """(a, b, agree) with a < b: pairs of near neighbours, and of crowded regions those with the hub, each once."""
    least = int(np.ceil(forest.floor * forest.values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_key, kept_node, kept_sketch = np.zeros(0, np.int64), np.zeros(0, np.int64), None

        def emit(key: np.ndarray, node: np.ndarray, sketch: np.ndarray) -> pa.RecordBatch:
            head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(head, len(key)))
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for small in (2, 3, 4):
                at = head[size == small]
                for x in range(small):
                    for y in range(x + 1, small):
                        agree = _agreement(sketch[at + x], sketch[at + y])
                        near = agree >= least
                        out.append((node[at[near] + x], node[at[near] + y], agree[near]))
            for a, n in zip(head[size > 4].tolist(), size[size > 4].tolist(), strict=True):
                i, j, agree = _edges_of_region(node[a : a + n], sketch[a : a + n], forest)
                out.append((node[a + i], node[a + j], agree))
            a, b, agree = (np.concatenate([o[k] for o in out]) for k in range(3))
            low, high = np.minimum(a, b), np.maximum(a, b)
            return pa.RecordBatch.from_arrays([pa.array(low), pa.array(high), pa.array(agree.astype(np.int32))], ["a", "b", "agree"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.concatenate([kept_key, batch.column(0).to_numpy()])
            node = np.concatenate([kept_node, batch.column(1).to_numpy()])
            sketch = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            sketch = sketch if kept_sketch is None else np.concatenate([kept_sketch, sketch])
            whole = int(np.searchsorted(key, key[-1]))  # the last region may go on
            if whole:
                yield emit(key[:whole], node[:whole], sketch[:whole])
            kept_key, kept_node, kept_sketch = key[whole:], node[whole:], sketch[whole:]
        if len(kept_key):
            yield emit(kept_key, kept_node, kept_sketch)

    ordered = regions.repartition(parts, "key").sortWithinPartitions("key", "node")
    pairs = ordered.mapInArrow(run, "a bigint, b bigint, agree int")
    pairs = pairs if crowded is None else pairs.unionByName(spokes(crowded, forest))
    return pairs.groupBy("a", "b").agg(F.max("agree").alias("agree"))


def _meetings(placed: DataFrame, forest: Forest) -> DataFrame | None:
    """(meet, side, key, node, component) of ``placed`` (key, node, component, n_shingles): every pair of members
    of a region that lie in different components shares a meeting, on the same or on different sides.

    A region of one component has none (None: no region has any). In the others blocks of bounded size meet
    blocks; a component of more than half a block has blocks of its own, which need not meet each other.
    """
    weight = F.greatest(F.count("*") / forest.block, F.sum("n_shingles") / forest.block_shingles).alias("w")
    counts = materialize(placed.groupBy("key", "component").agg(weight), "counts")
    small = F.col("w") <= 0.5
    rest = F.sum(F.when(small, F.col("w")).otherwise(0.0)).alias("rest")
    open_ = counts.groupBy("key").agg(F.count("*").alias("components"), rest).where("components > 1").drop("components")
    counts = materialize(counts.join(open_, "key"), "split")
    if counts.isEmpty():
        return None
    own = F.xxhash64(F.lit(1), "component", F.pmod(F.xxhash64("node", F.lit(7)), F.ceil("w")))
    shared = F.xxhash64(F.lit(0), F.pmod(F.xxhash64("component", F.lit(7)), F.ceil(2 * F.col("rest"))))
    dealt = placed.join(counts, ["key", "component"]).select("key", "node", "component", F.when(small, shared).otherwise(own).alias("block"), F.when(~small, F.col("component")).alias("of"))
    dealt = materialize(dealt, "dealt")
    blocks = dealt.select("key", "block", "of").distinct()
    other = blocks.select("key", F.col("block").alias("two"), F.col("of").alias("with"))
    meets = blocks.withColumnRenamed("block", "one").join(other, "key").where("one <= two and (of is null or with is null or of <> with)")
    meets = materialize(meets.select("key", "one", "two"), "meets")
    meet = F.xxhash64("key", "one", "two").alias("meet")
    sides = meets.select("key", F.col("one").alias("block"), meet, F.lit(0).alias("side"))
    sides = sides.unionByName(meets.where("one <> two").select("key", F.col("two").alias("block"), meet, F.lit(1).alias("side")))
    return dealt.join(sides, ["key", "block"]).select("meet", "side", "key", "node", "component")


def _each_meeting(rows: DataFrame, schema: str, parts: int, emit: Callable[[pa.Table], pa.RecordBatch]) -> DataFrame:
    """What ``emit`` makes of the rows of each meeting; a task takes one meeting after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            meet = held["meet"].to_numpy()
            head = np.flatnonzero(np.append(True, meet[1:] != meet[:-1])).tolist()
            for a, b in zip(head[:-1], head[1:], strict=True):
                yield emit(held.slice(a, b - a))
            held = held.slice(head[-1])  # the last meeting may go on
        if held is not None:
            yield emit(held)

    bound_batches(rows.sparkSession)
    return rows.repartition(parts, "meet").sortWithinPartitions("meet").mapInArrow(run, schema)


def _near(t: pa.Table, percent: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of one side, rows of the other, which pairs of them are near) in a meeting.

    Near are pairs of different components whose signatures agree in ``least`` values and whose sets are
    alike enough in size to overlap by ``percent``. Within one block each pair counts once.
    """
    side, component, n = t["side"].to_numpy(), t["component"].to_numpy(), t["n_shingles"].to_numpy()
    sketch = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(len(side), -1)
    x = np.flatnonzero(side == 0)
    y = np.flatnonzero(side == 1) if side.any() else x
    may = component[x][:, None] != component[y][None, :]
    may &= 100 * np.minimum(n[x][:, None], n[y][None, :]) >= percent * np.maximum(n[x][:, None], n[y][None, :])
    may = np.triu(may, 1) if y is x else may
    i, j = np.nonzero(may)
    if 8 * len(i) < may.size:
        agree = [_agreement(sketch[x[i[k : k + 65536]]], sketch[y[j[k : k + 65536]]]) for k in range(0, len(i), 65536)]
        may[i, j] = np.concatenate([np.zeros(0, np.int64), *agree]) >= least
    else:
        full = np.zeros(may.shape, np.int16)
        for k in range(sketch.shape[1]):
            full += sketch[x, k][:, None] == sketch[y, k][None, :]
        may &= full >= least
    return x, y, may


def unsettled(placed: DataFrame, nodes: DataFrame, percent: int, forest: Forest, parts: int) -> DataFrame | None:
    """(key, node): the members of a region that have a near member of another component in it. None: no region is open."""
    met = _meetings(placed, forest)
    if met is None:
        return None
    least = int(np.ceil(forest.floor * forest.values))

    def emit(t: pa.Table) -> pa.RecordBatch:
        x, y, near = _near(t, percent, least)
        some = np.concatenate([x[near.any(axis=1)], y[near.any(axis=0)]])
        some = pa.array(np.unique(some))
        return pa.RecordBatch.from_arrays([t[c].combine_chunks().take(some) for c in ("key", "node")], ["key", "node"])

    rows = met.join(nodes.select("node", "n_shingles", "sketch"), "node").select("meet", "side", "key", "node", "component", "n_shingles", "sketch")
    return _each_meeting(rows, "key bigint, node bigint", parts, emit).distinct()


def between(placed: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int, forest: Forest, parts: int) -> DataFrame | None:
    """(a, b): links between components that share a region. None: there is no region of several.

    The whole sets meet. Every near pair that still lies in different components is confirmed in the task; a
    link joins them there, so that a meeting gives one row less than it has components at most, however many
    pairs it has looked at.
    """
    met = _meetings(placed, forest)
    if met is None:
        return None
    least = int(np.ceil(forest.floor * forest.values))

    def emit(t: pa.Table) -> pa.RecordBatch:
        x, y, near = _near(t, percent, least)
        node, lists = t["node"].to_numpy(), t["shingles"].combine_chunks()
        n = np.diff(lists.offsets.to_numpy())
        start = np.cumsum(n) - n
        _, number = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        _, label = np.unique(t["component"].to_numpy(), return_inverse=True)
        mark = np.zeros(int(number.max(initial=0)) + 1, bool)
        a, b = [], []
        for i, row in zip(x.tolist(), near, strict=True):
            j = y[row]
            j = j[label[j] != label[i]]
            if not len(j):
                continue
            own = number[start[i] : start[i] + n[i]]
            mark[own] = True
            head = np.cumsum(n[j]) - n[j]
            every = np.arange(int(n[j].sum())) + np.repeat(start[j] - head, n[j])
            both = np.add.reduceat(mark[number[every]].astype(np.int64), head)
            mark[own] = False
            linked = j[100 * both >= percent * (n[i] + n[j] - both)]
            for k in linked[np.unique(label[linked], return_index=True)[1]].tolist():
                a.append(min(node[i], node[k]))
                b.append(max(node[i], node[k]))
                label[label == label[k]] = label[i]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    rows = met.join(nodes.select("node", "n_shingles", "sketch"), "node").join(sets, "node").select("meet", "side", "node", "component", "n_shingles", "sketch", "shingles")
    return _each_meeting(rows, "a bigint, b bigint", parts, emit).distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets overlap by ``percent`` or more."""
    one, two = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    # The number of equal hashes is counted on either side's distinct values.
    both = F.size(F.array_intersect("x", "y"))
    held = pairs.join(one, "a").join(two, "b")
    return held.where(100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b")


def _merged(members: DataFrame, links: DataFrame) -> DataFrame:
    """``members`` (node, component) after further ``links`` (a, b), some of whose ends may have no component yet."""
    if links.isEmpty():
        return members
    side = lambda c: members.select(F.col("node").alias(c), F.col("component").alias(f"{c}_of"))
    between = links.join(side("a"), "a", "left").join(side("b"), "b", "left")
    named = connected_components(between.select(F.coalesce("a_of", "a").alias("a"), F.coalesce("b_of", "b").alias("b")), contracted)
    named = materialize(named.withColumnRenamed("component", "now"), "named")
    moved = members.join(named.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("now", "component").alias("component"))
    fresh = named.join(members, "node", "left_anti").select("node", F.col("now").alias("component"))
    return materialize(moved.unionByName(fresh), "members")


def near_documents(docs: DataFrame, size: int = 5, percent: int = 80, forest: Forest = Forest(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, uid (a hash of key and text), n_shingles, component_id, kept.

    Documents are linked where their sets of ``size``-word shingles (A-Z lower-cased) overlap by ``percent``
    of their union or more; links are confirmed on full sets of 64-bit hashes. Equal sets are one node. A
    region of the forest gives candidates that keep its connections (nearest neighbours and a spanning
    forest), not all its pairs, and a crowded one its members with its hub. They are confirmed first, and only
    order the work: then all pairs of a region of the least depth, however large,
    whose signatures agree in ``floor`` and that still lie between different components are confirmed where
    blocks of the region meet, and only what joins components leaves the task. What is linked already costs
    nothing more; a large family just below the threshold costs the comparison of all its pairs, not their rows.

    Defined cases: documents without words (or null) have no shingles and link with nothing; fewer words than
    a shingle are one shingle; repeated rows are copies; a null key is linked like others but names no
    component (a component of null keys only has null) and is kept only if its component has no key at all;
    other columns are ignored; an empty table gives an empty table. Nothing is capped; the chance to miss a
    pair at exactly 0.8 is about 5e-8 for want of a common region and 8.7e-6 for signatures below ``floor``.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), F.xxhash64(F.col(f"`{key}`"), body).alias("uid"), body.alias("text"))
    sketched = materialize(sketches(rows, size, forest), "sketches")
    classes = sketched.where("n_shingles > 0").groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("least"), F.min("uid").alias("uid"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    nodes = materialize(classes.withColumn("node", F.xxhash64("f1", "f2", "n_shingles")), "nodes")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole, regions, crowded = neighbourhoods(nodes, forest)
    pairs = materialize(candidates(regions, crowded, forest, parts), "pairs")

    def whole_sets(chunk: TextChunk) -> tuple[np.ndarray, dict[str, object]]:
        row, hashes = shingle_sets(chunk, size)
        ends = np.searchsorted(row, np.arange(chunk.rows + 1))
        return np.arange(chunk.rows), {"shingles": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(hashes.view(np.int64)))}

    def sets_of(involved: DataFrame) -> DataFrame:
        involved = materialize(nodes.select("node", F.col("uid").alias("u")).join(involved, "node"), "involved")
        # What is involved grows with the corpus, so this join is never a broadcast.
        texts = rows.select("uid", "text").join(involved.hint("merge"), F.col("uid") == F.col("u")).select("node", "text")
        sets = explode_texts(texts, ["node"], "text", whole_sets, {"shingles": "array<bigint>"}).dropDuplicates(["node"])
        return materialize(sets, "sets")

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()

    sets = sets_of(ends(pairs))
    members = materialize(connected_components(materialize(confirmed(pairs, sets, percent), "links"), contracted), "members")
    # The pairs above only order the work: all others between different components follow.
    placed = whole.select("key", "node").join(nodes.select("node", "n_shingles"), "node").join(members, "node", "left")
    placed = materialize(placed.select("key", "node", F.coalesce("component", "node").alias("component"), "n_shingles"), "placed")
    open_ = unsettled(placed, nodes, percent, forest, parts)
    if open_ is not None and not (open_ := materialize(open_, "unsettled")).isEmpty():
        fresh = materialize(open_.select("node").distinct().join(ends(pairs), "node", "left_anti"), "fresh")
        sets = sets if fresh.isEmpty() else sets.unionByName(sets_of(fresh))
        joined = between(materialize(placed.join(open_, ["key", "node"]), "open"), nodes, sets, percent, forest, parts)
        members = members if joined is None else _merged(members, materialize(joined, "joined"))
    named = nodes.select("f1", "f2", "n_shingles", "node", "least").join(members, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = materialize(named.select("f1", "f2", "n_shingles", "component", "least"), "named")
    names = materialize(named.groupBy("component").agg(F.min("least").alias("component_id")), "names")
    named = materialize(named.join(names, "component").select("f1", "f2", "n_shingles", "component_id"), "classes")
    facts = ["f1", "f2", "n_shingles"]
    judged = sketched.where("n_shingles > 0").select("doc_id", "uid", *facts).join(named, facts).select("doc_id", "uid", "n_shingles", "component_id")
    judged = judged.unionByName(sketched.where("n_shingles = 0").select("doc_id", "uid", "n_shingles", F.col("doc_id").alias("component_id")))
    kept = F.when(F.col("component_id").isNull(), True).otherwise(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    return judged.select(F.col("doc_id").alias(key), "uid", "n_shingles", "component_id", kept.alias("kept"))


def one_of_each(docs: DataFrame, judged: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that ``judged`` (from ``near_documents``) keeps, with their own columns; of repeated rows one."""
    stay = judged.where("kept").groupBy(F.col(f"`{key}`").alias("_k"), F.col("uid").alias("_u")).agg(F.count("*").alias("_n"))
    code = F.xxhash64(F.col(f"`{key}`"), F.coalesce(F.col(f"`{text}`"), F.lit("")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{key}`").alias("_d"), code.alias("_c"))
    held = materialize(rows.join(materialize(stay, "stay"), F.col("_d").eqNullSafe(F.col("_k")) & (F.col("_c") == F.col("_u"))), "held")
    twice = held.where("_n > 1").dropDuplicates(["_d", "_c"])
    return held.where("_n = 1").unionByName(twice).select("row.*")

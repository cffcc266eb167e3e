"""Hard-negative mining by slots: the upper limits of an anchor's positives cut its scores into disjoint slots."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactlake import materialize

#: Rows take part while their squared length is below this, so that a hundred times a score fits 64 bits.
SQUARED_LIMIT = float(1 << 55)
#: Cells of the score matrix that a task holds at once.
MATRIX = 1 << 20


class Mining(NamedTuple):
    """An anchor's first ``positives`` rows of its label; of each the first ``negatives`` rows of other labels
    that score between ``low`` and ``high`` percent of it. Blocks of ``rows`` rows meet blocks of ``anchors``."""

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    rows: int = 4096
    anchors: int = 1024


def quantised(vector: Column | str, scale: int) -> Column:
    """Every component c as floor(``scale`` * c); null for null, infinite and NaN ones."""

    def each(c: Column) -> Column:
        x = c.cast("double")
        return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.floor(x * F.lit(float(scale))))

    return F.transform(vector, each)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if bound < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _first(score: np.ndarray, name: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties by the smaller name."""
    if len(score) > 8 * k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        near = np.flatnonzero(score >= least)
        return near[np.lexsort((name[near], -score[near]))[:k]]
    return np.lexsort((name, -score))[:k]


def _rows_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, label, vectors) of a block without its repeated rows."""
    n = table.num_rows
    flat = table["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    columns = np.column_stack([table["id"].to_numpy(), table["label"].to_numpy(), flat.reshape(n, -1).astype(np.int64)])
    if len(np.unique(columns[:, 0])) < n:
        columns = np.unique(columns, axis=0)
    return columns[:, 0], columns[:, 1], columns[:, 2:]


def _scores(rows: pa.Table, anchors: pa.Table, pick: Callable[[int, np.ndarray, np.ndarray, np.ndarray], list[tuple[int, np.ndarray, np.ndarray]]]) -> pa.Table:
    """(anchor, slot, id, score): what ``pick`` takes from the scores of each anchor with the rows of a block."""
    out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(4)]
    if rows.num_rows and anchors.num_rows:
        name, label, vectors = _rows_of(rows)
        m = anchors.num_rows
        flat = anchors["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(m, -1).astype(np.int64)
        number = anchors["anchor"].to_numpy()
        step = max(1, MATRIX // len(name))
        for at in range(0, m, step):
            block = _products(flat[at : at + step], vectors)
            for i, scores in enumerate(block, at):
                for slot, ids, values in pick(i, name, label, scores):
                    for column, values_ in zip(out, (np.full(len(ids), number[i]), np.full(len(ids), slot), ids, values), strict=True):
                        column.append(values_)
    return pa.table([pa.array(np.concatenate(c), pa.int64()) for c in out], ["anchor", "slot", "id", "score"])


FOUND = "anchor bigint, slot bigint, id bigint, score bigint"


def _met(rows: DataFrame, anchors: DataFrame, mining: Mining, total: int, queries: int) -> object:
    """Every block of rows with every block of anchors, each pair of blocks one group.

    Blocks are dealt by row number, so their size doesn't depend on any key.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_rows, by_anchors = max(-(-total // mining.rows), parts), -(-queries // mining.anchors)
    deal = lambda number, blocks: F.pmod(F.xxhash64(number), F.lit(blocks))
    left = rows.select("size", deal("row", by_rows).alias("r"), F.explode(F.sequence(F.lit(0), F.lit(by_anchors - 1))).alias("a"), "id", "label", "vector")
    right = anchors.select("size", F.explode(F.sequence(F.lit(0), F.lit(by_rows - 1))).alias("r"), deal("anchor", by_anchors).cast("int").alias("a"), *[c for c in anchors.columns if c != "size"])
    cell = ["size", F.col("r").cast("int").alias("r"), "a"]
    return left.groupBy(*cell).cogroup(right.groupBy(*cell))


def _best(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first ``k`` different (id, score) of each group, with their ``rank``. Tasks cut before they shuffle."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= k).select(*by, "rank", "id", "score").distinct()


def hard_negatives(vectors: DataFrame, is_anchor: Column, mining: Mining = Mining(), key: str = "vec_id", label: str = "label", vector: str = "vector") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every anchor and positive.

    ``vector`` holds integers; a score is the inner product with the anchor. Higher scores come first, ties by
    the smaller key. ``is_anchor`` is a condition on ``key``. First blocks of rows give each anchor its best
    positives. Their upper limits (``high`` percent), in falling order, part the scores into disjoint slots:
    a row of another label lies in one slot, that of the smallest limit that is not below its score. Blocks
    keep the first ``negatives`` of each slot, and so does the merge of the blocks. Then lists are merged from
    the lowest slot upwards: what follows a limit is its slot's list before the merged list of the lower ones,
    cut to ``negatives``; a window takes of it what reaches its lower limit.

    Defined cases: rows with a null key, label or vector, a null component, or a squared length of 2^55 or more
    take no part; rows of different lengths don't meet; a row given several times counts once; rows that carry
    the anchor's own key are never its positives; an anchor without positives, a positive below zero and a
    window without rows give nothing; other columns are ignored; an empty table gives an empty table.
    """
    plain = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.xxhash64(F.col(f"`{label}`").cast("string")).alias("label"), F.col(f"`{label}`").isNotNull().alias("_l"), F.col(f"`{vector}`").alias("vector"), is_anchor.alias("is_anchor"))
    squared = F.aggregate("vector", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))
    sound = plain.where("id is not null and _l and vector is not null").where(F.forall("vector", lambda x: x.isNotNull())).where(squared < SQUARED_LIMIT)
    narrow = F.transform("vector", lambda x: x.cast("int")).alias("vector")
    rows = materialize(sound.select("id", "label", F.size("vector").alias("size"), narrow, F.coalesce("is_anchor", F.lit(False)).alias("is_anchor"), F.monotonically_increasing_id().alias("row")), "rows")
    anchors = rows.where("is_anchor").select("id", "label", "size", "vector").distinct()
    anchors = materialize(anchors.withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    total, queries = rows.count(), anchors.count()
    if not queries:
        return rows.limit(0).select(F.col("id").alias("anchor_id"), F.col("id").alias("positive_id"), F.lit(1).alias("rank"), F.col("id").alias("negative_id"), F.col("id").alias("positive_score"), F.col("id").alias("negative_score"))

    def positives(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        own, kind = anchors["id"].to_numpy(), anchors["label"].to_numpy()

        def pick(i: int, name: np.ndarray, label: np.ndarray, score: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
            at = np.flatnonzero((label == kind[i]) & (name != own[i]))
            at = at[_first(score[at], name[at], mining.positives)]
            return [(0, name[at], score[at])]

        return _scores(rows, anchors, pick)

    found = materialize(_met(rows, anchors, mining, total, queries).applyInArrow(positives, FOUND), "positives")
    best = _best(found, ["anchor"], mining.positives).where("score >= 0")
    upper, lower = F.expr(f"{mining.high} * score div 100"), F.expr(f"({mining.low} * score + 99) div 100")
    windows = best.select("anchor", F.struct("rank", "id", "score", upper.alias("upper"), lower.alias("lower")).alias("w")).groupBy("anchor").agg(F.array_sort(F.collect_list("w")).alias("windows"))
    limits = F.array_sort(F.array_distinct(F.transform("windows", lambda w: w["upper"]))).alias("limits")
    windows = materialize(windows.select("anchor", "windows", limits, F.array_min(F.transform("windows", lambda w: w["lower"])).alias("least")), "windows")
    asked = materialize(anchors.join(windows.drop("windows"), "anchor"), "asked")

    def negatives(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        kind, least, limits = anchors["label"].to_numpy(), anchors["least"].to_numpy(), anchors["limits"].to_pylist()

        def pick(i: int, name: np.ndarray, label: np.ndarray, score: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
            at = np.flatnonzero((label != kind[i]) & (score <= limits[i][-1]) & (score >= least[i]))
            slots = np.searchsorted(limits[i], score[at], "left")
            out = []
            for slot in np.unique(slots).tolist():
                mine = at[slots == slot]
                mine = mine[_first(score[mine], name[mine], mining.negatives)]
                out.append((slot, name[mine], score[mine]))
            return out

        return _scores(rows, anchors, pick)

    found = materialize(_met(rows, asked, mining, total, queries).applyInArrow(negatives, FOUND), "negatives")
    listed = _best(found, ["anchor", "slot"], mining.negatives).groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("slot", "rank", "id", "score"))).alias("slots"))
    held = listed.join(windows, "anchor").join(anchors.select("anchor", F.col("id").alias("anchor_id")), "anchor")
    # Slot s holds scores up to limit s; merged[s] is the list of slot s before that of all lower ones.
    merged = F.aggregate(
        F.sequence(F.lit(0), F.size("limits") - 1),
        F.array().cast("array<array<struct<slot:bigint,rank:int,id:bigint,score:bigint>>>"),
        lambda done, s: F.concat(done, F.array(F.slice(F.concat(F.filter("slots", lambda x: x["slot"] == s), F.coalesce(F.get(done, F.size(done) - 1), F.array().cast("array<struct<slot:bigint,rank:int,id:bigint,score:bigint>>"))), 1, mining.negatives))),
    )
    held = held.withColumn("merged", merged).withColumn("w", F.explode("windows"))
    taken = F.filter(F.element_at("merged", F.array_position("limits", F.col("w.upper")).cast("int")), lambda n: n["score"] >= F.col("w.lower"))
    answers = held.select("anchor_id", "w", F.posexplode(taken).alias("at", "n"))
    return answers.select(
        "anchor_id",
        F.col("w.id").alias("positive_id"),
        (F.col("at") + 1).alias("rank"),
        F.col("n.id").alias("negative_id"),
        F.col("w.score").alias("positive_score"),
        F.col("n.score").alias("negative_score"),
    )

"""Embedding whitening by FEAST: contour integrals of shifted covariance solves find the leading components."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlake import materialize

from .kernels import bound_batches

#: Components take part while floor(scale * c) is below this in size.
ENTRY_LIMIT = 1 << 40


class Feast(NamedTuple):
    """Up to ``components`` leading ones. Intervals hold about ``most`` eigenvalues; each contour has ``nodes``
    Gauss-Legendre points on its upper half. Subspaces start at twice the count and ``spare``, and grow until
    as many eigenvalues are found as inertia counts tell."""

    components: int = 16
    most: int = 6
    nodes: int = 8
    spare: int = 6
    rounds: int = 30


def above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix exceed ``shift``: the positive pivots of an LDL' factorisation.

    Pivots are single entries or 2 x 2 blocks, which have one eigenvalue of either sign (Bunch and Kaufman).
    """
    a = matrix - shift * np.eye(len(matrix))
    alpha, count = (1 + np.sqrt(17)) / 8, 0
    while len(a):
        column = np.abs(a[1:, 0])
        far = 1 + int(np.argmax(column)) if len(column) else 0
        largest = column.max(initial=0.0)
        if largest == 0:
            count += bool(a[0, 0] > 0)
            a = a[1:, 1:]
            continue
        row = np.abs(a[far])
        row[far] = 0
        widest = row.max()
        if abs(a[0, 0]) >= alpha * largest or abs(a[0, 0]) * widest >= alpha * largest**2:
            pivot = [0]
        elif abs(a[far, far]) >= alpha * widest:
            pivot = [far]
        else:
            pivot = [0, far]
        rest = np.setdiff1d(np.arange(len(a)), pivot)
        block, side = a[np.ix_(pivot, pivot)], a[np.ix_(rest, pivot)]
        count += 1 if len(pivot) == 2 else int(block[0, 0] > 0)
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(block, side.T)
    return count


def intervals(matrix: np.ndarray, wanted: int, most: int) -> list[tuple[float, float, int]]:
    """(low, high, count) from the top down, together holding at least ``wanted`` eigenvalues (all, if fewer).

    Halves an interval until it holds ``most`` or is too narrow. Ends keep off eigenvalues: one is moved when
    the counts on its two sides differ.
    """
    top = float(np.abs(matrix).sum(axis=1).max()) * (1 + 1e-6) + 1e-300
    least = 1e-9 * top

    def end(low: float, high: float) -> tuple[float, int]:
        near = 1e-5 * (high - low)
        for share in (0.5, 0.47, 0.53, 0.44, 0.56, 0.41, 0.59, 0.38, 0.62):
            at = low + share * (high - low)
            if above(matrix, at - near) == (count := above(matrix, at + near)):
                break
        return at, count

    out: list[tuple[float, float, int]] = []
    open_ = [(-least, top, len(matrix))]
    while open_ and sum(n for *_, n in out) < wanted:
        low, high, count = open_.pop()
        if not count:
            continue
        if count <= most or high - low <= least:
            out.append((low, high, count))
            continue
        middle, upper = end(low, high)
        beyond = sum(n for *_, n in out)
        open_ += [(low, middle, count + beyond - upper), (middle, high, upper - beyond)]
    return out


def contour_pairs(matrix: np.ndarray, low: float, high: float, count: int, feast: Feast) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenvalues of a symmetric matrix in (low, high), rising, and their unit eigenvectors.

    Each round projects a subspace by quadrature of (z - matrix)^-1 over the circle through both ends: one
    complex solve a node. Rayleigh-Ritz takes the eigenpairs out. Raises if inertia counts more than is found.
    """
    d, scale = len(matrix), float(np.abs(matrix).sum(axis=1).max())
    points, weights = np.polynomial.legendre.leggauss(feast.nodes)
    turn = np.exp(0.5j * np.pi * (1 + points))
    middle, radius = (low + high) / 2, (high - low) / 2
    size = min(d, 2 * count + feast.spare)
    draw = np.random.default_rng(13)
    basis = draw.standard_normal((d, size))
    values, vectors, before = np.zeros(0), np.zeros((d, 0)), np.inf
    for step in range(1, feast.rounds + 1):
        projected = np.zeros((d, size))
        for z, w in zip(turn, weights, strict=True):
            projected += (0.5 * w * radius * z * np.linalg.solve((middle + radius * z) * np.eye(d) - matrix, basis.astype(complex))).real
        span, strength, _ = np.linalg.svd(projected, full_matrices=False)
        span = span[:, strength > 1e-13 * strength[0]]
        ritz, turned = np.linalg.eigh(span.T @ matrix @ span)
        basis = span @ turned
        inside = (ritz > low) & (ritz < high)
        values, vectors = ritz[inside], basis[:, inside]
        left = float(np.linalg.norm(matrix @ vectors - vectors * values, axis=0).max(initial=0.0))
        if len(values) == count and (left <= 1e-15 * scale or (left <= 1e-12 * scale and left > 0.5 * before)):
            return values, vectors
        before = left if len(values) == count else np.inf
        if basis.shape[1] < size or step % 6 == 0:
            size = min(d, size + count + feast.spare) if step % 6 == 0 else size
            basis = np.column_stack([basis, draw.standard_normal((d, size - basis.shape[1]))])
    if len(values) == count and before <= 1e-10 * scale:
        return values, vectors
    raise ArithmeticError(f"{len(values)} eigenvalues found between {low} and {high}; inertia counts {count}")


def leading(spark, matrix: np.ndarray, feast: Feast = Feast()) -> tuple[np.ndarray, np.ndarray]:
    """The leading eigenvalues of a covariance, falling, and unit eigenvectors as rows; none that is zero.

    Intervals are solved as tasks of their own. The matrix is broadcast: its size is that of a vector squared,
    whatever the number of rows.
    """
    d = len(matrix)
    if not np.abs(matrix).max(initial=0.0):
        return np.zeros(0), np.zeros((0, d))
    scale = float(np.abs(matrix).max())
    unit = matrix / scale
    parts = intervals(unit, min(d, feast.components), feast.most)
    shared = spark.sparkContext.broadcast(unit)

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for low, high, count in frame.itertuples(index=False):
                values, vectors = contour_pairs(shared.value, low, high, int(count), feast)
                yield pd.DataFrame({"value": values, "vector": list(vectors.T)})

    asked = spark.createDataFrame([(float(a), float(b), int(n)) for a, b, n in parts], "low double, high double, count int").repartition(len(parts))
    found = asked.mapInPandas(solve, "value double, vector array<double>").collect()
    basis, _ = np.linalg.qr(np.array([r.vector for r in sorted(found, key=lambda r: -r.value)]).T)
    # One Rayleigh-Ritz step over all intervals makes the vectors of neighbouring ones orthogonal, too.
    values, turned = np.linalg.eigh(basis.T @ unit @ basis)
    values, vectors = values[::-1], (basis @ turned).T[::-1]
    if len(values) != sum(n for *_, n in parts) or above(unit, parts[-1][0]) != len(values):
        raise ArithmeticError("inertia counts eigenvalues that the contours have not found")
    keep = int((values > 1e-14 * d * values[0]).sum())
    values, vectors = values[: min(keep, feast.components)], vectors[: min(keep, feast.components)]
    largest = np.take_along_axis(vectors, np.abs(vectors).argmax(axis=1)[:, None], axis=1)
    return values * scale, vectors * np.sign(largest)


def quantised(vector: Column | str, scale: int, shift: int) -> Column:
    """Every component c as floor(``scale`` * c) + ``shift``; null where one is null, infinite, NaN or 2^40 and more."""
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))))
    sound = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(ENTRY_LIMIT / scale)))
    return F.when(F.coalesce(sound, F.lit(False)), F.transform(x, lambda v: v + F.lit(shift).cast("long")))


def _sums(table: DataFrame, pivot: list[int]) -> np.ndarray:
    """Exact sums over ``table`` (x): of x - pivot, below them of the products of its entries, as Python integers.

    Each task sums its own rows; what is shuffled has one row for each entry and task.
    """
    d, center = len(pivot), np.array(pivot, np.int64)
    schema = "at int, total decimal(38,0)"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d + 1, d), object)
        for batch in batches:
            if not batch.num_rows:
                continue
            y = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d) - center
            most = float(np.abs(y).max(initial=0)) ** 2 * len(y)
            # Sums of products below 2^53 are exact in doubles; larger ones are taken as Python integers.
            square = (y.astype(float).T @ y.astype(float)).astype(np.int64).astype(object) if most < 2.0**53 else y.astype(object).T @ y.astype(object)
            total[0] += np.array([int(v) for v in y.astype(object).sum(axis=0)], object) if most >= 2.0**53 else y.sum(axis=0).astype(object)
            total[1:] += square
        if total.any():
            flat = [int(v) for v in total.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(flat, pa.decimal128(38, 0))], ["at", "total"])

    rows = table.select("x").mapInArrow(run, schema).groupBy("at").agg(F.sum("total").alias("total")).collect()
    out = np.zeros((d + 1) * d, object)
    for r in rows:
        out[r["at"]] = int(r["total"])
    return out.reshape(d + 1, d)


class Fit(NamedTuple):
    """``sums`` are exact per-dimension sums over the ``n`` fitted vectors; ``covariance`` is centred."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    identity_error: float


def fit(distinct: DataFrame, feast: Feast = Feast()) -> Fit | None:
    """Fit on ``distinct`` (x): different integer vectors of one length. None for an empty table.

    The first pass has exact sums, the second exact products around the rounded mean; both are made a centred
    covariance in whole numbers, so no digits are lost to large offsets. The third one whitens the vectors and
    measures how far their covariance is from the identity. What comes to the driver are sums of a vector's
    length, and of its square.
    """
    spark = distinct.sparkSession
    first = distinct.first()
    if first is None:
        return None
    n, d = distinct.count(), len(first["x"])
    sums = [int(v) for v in _sums_of_entries(distinct, d)]
    pivot = [(2 * s + n) // (2 * n) for s in sums]
    found = _sums(distinct, pivot)
    covariance = np.array([[float(Fraction(int(n * found[1 + i, j] - found[0, i] * found[0, j]), n * n)) for j in range(d)] for i in range(d)]).reshape(d, d)
    values, vectors = leading(spark, covariance, feast)
    k = len(values)
    error = 0.0
    if k:
        schema = "at int, total double"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((k, k))
            for batch in batches:
                w, _ = project(batch.column(0), n, sums, values, vectors)
                total += w.T @ w
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k, dtype=np.int32)), pa.array(total.ravel())], ["at", "total"])

        rows = distinct.select("x").mapInArrow(run, schema).groupBy("at").agg(F.sum("total").alias("total")).collect()
        square = np.zeros(k * k)
        for r in rows:
            square[r["at"]] = r["total"]
        error = float(np.abs(square.reshape(k, k) / n - np.eye(k)).max())
    return Fit(n, sums, covariance, values, vectors, error)


def _sums_of_entries(distinct: DataFrame, d: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d, object)
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            # Batches have few rows and entries are below 2^41, so 64 bits hold the sum of one.
            total += x.sum(axis=0).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array([int(v) for v in total], pa.decimal128(38, 0))], ["at", "total"])

    out = np.zeros(d, object)
    for r in distinct.select("x").mapInArrow(run, "at int, total decimal(38,0)").groupBy("at").agg(F.sum("total").alias("total")).collect():
        out[r["at"]] = int(r["total"])
    return out


def project(lists: pa.Array, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
    """(whitened, deviation) of integer vectors: n * x - S is exact, and so is the sum of its squares.

    A deviation that 64 bits can't hold is None.
    """
    d = len(sums)
    x = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    largest = max([abs(s) for s in sums], default=0) + n * int(np.abs(x).max(initial=0))
    if largest < 1 << 62:
        off = n * x - np.array(sums, np.int64)
    else:
        off = n * x.astype(object) - np.array(sums, object)
    spread = max((abs(int(v)) for v in (off.max(initial=0), off.min(initial=0))), default=0)
    squared = (off * off).sum(axis=1) if d * spread**2 < 1 << 63 else (off.astype(object) ** 2).sum(axis=1)
    white = (off.astype(np.float64) / n) @ vectors.T / np.sqrt(values)
    return white, [int(v) if v < 1 << 63 else None for v in squared.tolist()]


def whiten(vectors: DataFrame, feast: Feast = Feast(), key: str = "vec_id", vector: str = "vector") -> DataFrame:
    """Key, component, n, deviation, whitened, explained and identity_error for each row and leading component.

    ``vector`` holds integers (see ``quantised``). The fit is over each different vector once. Components are
    unit eigenvectors of its covariance, numbered from 1 by falling eigenvalue; each vector's entry of largest
    size is positive.

    Defined cases: rows with a null vector are left out, and so are those of another length than the most
    common one (of equally common ones the shortest); repeated rows are all returned, and fitted once; a null
    key is returned; components without variance are left out, so equal vectors or a single one give an empty
    table, and so does an empty one; other columns are ignored; a deviation beyond 64 bits is null.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = vectors.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").alias("x")).where("x is not null and size(x) > 0")
    rows = materialize(rows, "vectors")
    common = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), "size").first()
    d = common["size"] if common else 0
    rows = rows.where(F.size("x") == d)
    fitted = fit(materialize(rows.select("x").distinct(), "distinct"), feast)
    schema = f"key {rows.schema['key'].dataType.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if fitted is None or not len(fitted.values):
        made = spark.createDataFrame([], schema)
    else:
        n, sums, values, axes, error = fitted.n, fitted.sums, fitted.values, fitted.vectors, fitted.identity_error
        explained = values / np.trace(fitted.covariance)
        k = len(values)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                white, deviation = project(batch.column(1), n, sums, values, axes)
                m = batch.num_rows
                each = pa.array(np.repeat(np.arange(m), k))
                columns = [
                    batch.column(0).take(each),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n, np.int64)),
                    pa.array(deviation, pa.int64()).take(each),
                    pa.array(white.ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"])

        made = rows.mapInArrow(run, schema)
    return made.withColumnRenamed("key", key)

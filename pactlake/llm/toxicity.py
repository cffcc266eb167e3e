"""Toxicity: logistic regression over hashed word n-grams and skip-grams, fitted by FTRL-proximal."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlake import materialize

from .kernels import BASE, TextChunk, Words, explode_texts, grams, map_texts, mix, process_cache

#: Words are runs of letters, digits and bytes beyond ASCII.
BREAKS = np.array([not (chr(b).isalnum() or b > 127) for b in range(256)])


class Settings(NamedTuple):
    """``bits``: log2 of the number of hashed features, which bounds the weights (2^18: 2 MB of doubles).

    ``sample``: the most labelled rows to learn from, chosen by the hash of their id. ``passes``: over them.
    ``alpha`` and ``beta`` set each coordinate's own learning rate, alpha / (beta + sqrt(sum of g^2));
    ``l1`` and ``l2`` are the penalties. The first, which makes most weights exactly zero, is times the square
    root of the number of examples: chance sums of gradients grow like that.
    """

    bits: int = 18
    sample: int = 24_000
    passes: int = 5
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.14
    l2: float = 0.0


class Model(NamedTuple):
    """Non-zero weights by feature, and the constant."""

    features: np.ndarray
    weights: np.ndarray
    constant: float
    bits: int


def features_of(chunk: TextChunk, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) for words, pairs of neighbours and pairs with one word between, in lower case."""
    words = Words(chunk, fold=True, breaks=BREAKS)
    row = words.rows()
    pairs, _, pair_row = grams(words, 2)
    first = np.arange(max(0, len(row) - 2))
    first = first[row[first] == row[first + 2]] if len(first) else first
    skips = mix(words.hash[first] * BASE + words.hash[first + 2] * np.uint64(0xC2B2AE3D27D4EB4F))
    rows = np.concatenate([row, pair_row, row[first]])
    shift = np.uint64(64 - bits)
    return rows, (np.concatenate([mix(words.hash), pairs, skips]) >> shift).astype(np.int64)


def _present(rows: np.ndarray, features: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique((rows << bits) | features)
    return both >> bits, both & ((1 << bits) - 1)


def fit(examples: Iterator[tuple[int, np.ndarray]], examples_count: int, settings: Settings) -> tuple[np.ndarray, float]:
    """Weights and constant by FTRL-proximal. ``examples`` are (label, distinct features), ``examples_count`` of
    them if each is counted once."""
    size = 1 << settings.bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    alpha, beta, l1, l2 = settings.alpha, settings.beta, settings.l1 * np.sqrt(examples_count), settings.l2
    for label, features in examples:
        at = np.append(features, size)
        zi, ni = z[at], n[at]
        penalty = np.full(len(at), l1)
        penalty[-1] = 0.0  # the constant is not penalised
        w = np.where(np.abs(zi) <= penalty, 0.0, -(zi - np.sign(zi) * penalty) / ((beta + np.sqrt(ni)) / alpha + l2))
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35.0, 35.0))) - label
        sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
        z[at] = zi + g - sigma * w
        n[at] = ni + g * g
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    return w[:size], float(-z[size] / ((beta + np.sqrt(n[size])) / alpha + l2))


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), label: str = "toxic") -> Model:
    """Fit on at most ``settings.sample`` labelled documents; ``labels`` must hold training rows only.

    The ids of the sample are broadcast: their number is the documented bound. Features are hashed where the
    texts lie; the bounded sample then runs through one task, as the method is a sequence of updates. Rows
    come in the order of a hash, so a repeated task gives the same weights. Null labels, ids and texts are
    left out; of repeated labels the highest counts. An id gives one example however often its row is repeated
    (of different texts the one with the least hash), so the bound on ids bounds the rows; repeats fold before
    they are shuffled. Without any labelled row all weights are zero.
    """
    bits = settings.bits
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    chosen = materialize(chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.sample), "sample")
    texts = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    one = F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))["text"]
    sample = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("label").alias("label"), one.alias("text"))
    sample = sample.select((F.col("label") > 0).cast("int").alias("label"), F.xxhash64("doc_id", "text").alias("place"), "text")

    def kernel(chunk: TextChunk) -> tuple[np.ndarray, dict[str, object]]:
        rows, features = _present(*features_of(chunk, bits), bits)
        ends = np.searchsorted(rows, np.arange(chunk.rows + 1))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(features.astype(np.int32)))
        return np.arange(chunk.rows), {"features": lists}

    hashed = materialize(explode_texts(sample, ["label", "place"], "text", kernel, {"features": "array<int>"}), "features")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples: list[tuple[int, np.ndarray]] = []
        for batch in batches:
            flat, ends = batch.column(1).values.to_numpy(), batch.column(1).offsets.to_numpy()
            examples += [(y, flat[a:b]) for y, a, b in zip(batch.column(0).to_pylist(), ends[:-1], ends[1:], strict=True)]
        repeated = (e for _ in range(settings.passes) for e in examples)
        weights, constant = fit(repeated, len(examples), settings)
        kept = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(kept, -1)), pa.array(np.append(weights[kept], constant))], ["feature", "weight"])

    ordered = hashed.repartition(1).sortWithinPartitions("place", "label").select("label", "features")
    found = ordered.mapInArrow(learn, "feature bigint, weight double").toPandas()  # at most 2^bits + 1 rows
    found = found.sort_values("feature")
    if found.empty:  # no task had a row to learn from
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0, bits)
    return Model(found["feature"].to_numpy()[1:], found["weight"].to_numpy()[1:], float(found["weight"].iloc[0]), bits)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Documents with ``score``, between 0 and 1: the higher, the likelier toxic.

    The weights, of bounded size, travel with the task. Whole texts are read; each distinct feature counts
    once. Defined cases: null, empty and wordless texts get the score of the constant alone; repeated rows
    are scored alike; the rows' other columns are kept, and one called score is replaced. No shuffle.
    """
    dense = np.zeros(1 << model.bits)
    dense[model.features] = model.weights
    light = dense.astype(np.float32) if len(model.features) else None
    constant, bits = model.constant, model.bits

    def kernel(chunk: TextChunk) -> dict[str, object]:
        process_cache("none", dict, "toxicity")
        total = np.full(chunk.rows, constant)
        if light is not None:
            rows, features = features_of(chunk, bits)
            weighs = light[features] != 0
            rows, features = _present(rows[weighs], features[weighs], bits)
            total += np.bincount(rows, weights=light[features].astype(np.float64), minlength=chunk.rows)
        return {"score": pa.array(1.0 / (1.0 + np.exp(-np.clip(total, -35.0, 35.0))))}

    return map_texts(docs, text, kernel, {"score": "double"})


def held_out(doc_id: Column) -> Column:
    """A fifth of the ids, by the CRC-32 of the id as text; no label of theirs may be learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))

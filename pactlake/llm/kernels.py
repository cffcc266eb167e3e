"""Arrow and numpy helpers shared by the operators: row-wise maps, word splitting and hashing over whole batches."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows in an Arrow batch at most: texts can be long, and a batch is held whole.
BATCH_ROWS = 2000
#: Bytes of text that a kernel works on at once; one longer text is taken alone.
CHUNK = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def process_cache(name: str, make: Callable[[], object], group: str = "") -> object:
    """A value kept for the life of a Python worker, so that a reused worker doesn't build tables again.

    Values of one named group are kept at a time: a worker that goes on to another operator gives up what
    it remembers for the last one.
    """
    holder = sys.modules.setdefault("_pactlake_process_cache", types.ModuleType("_pactlake_process_cache"))
    held = holder.__dict__.setdefault("held", {})
    if group and holder.__dict__.get("group") != group:
        for other in [k for k, (g, _) in held.items() if g]:
            del held[other]
        holder.group = group
    if name not in held:
        held[name] = (group, make())
    return held[name][1]


class TextChunk:
    """Texts of some rows: ``data`` their UTF-8 bytes, ``offsets`` where each begins (null: empty)."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
        if texts.null_count:
            texts = texts.fill_null("")
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        data = texts.buffers()[2]
        self.texts = texts
        self.data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and n else np.zeros(0, np.uint8)
        self.offsets = (offsets - offsets[0]).astype(np.int64)
        self.rows = n


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, TextChunk]]:
    """(first row, chunk) with about ``size`` bytes each."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    whole = TextChunk(texts)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(whole.offsets, whole.offsets[at] + size, "right")) - 1)
        yield at, TextChunk(whole.texts.slice(at, end - at))
        at = end


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads 64 bits over 64 bits, one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def make() -> list[np.ndarray]:
        return [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    tables = process_cache("powers", make)
    if len(tables[0]) <= n:
        size = max(n + 1, 1 << 16)
        for i, base in enumerate((BASE, INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            tables[i] = np.cumprod(steps)
    return tables[0], tables[1]


def spans_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for every span at once, alike wherever the span lies."""
    power, inverse = _powers(len(values))
    total = np.empty(len(values) + 1, np.uint64)
    total[0] = 0
    np.cumsum(values * power[: len(values)], out=total[1:])
    length = (end - start).astype(np.uint64)
    return mix((total[end] - total[start]) * inverse[start] + length * np.uint64(0xD6E8FEB86659FD93))


def _byte_values(fold: bool) -> np.ndarray:
    codes = np.arange(256, dtype=np.uint64)
    if fold:
        codes[65:91] += np.uint64(32)
    return mix(codes + np.uint64(0x1234567))


WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
PLAIN, FOLDED = _byte_values(False), _byte_values(True)


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a chunk: byte spans, hashes, and ``first[r]:first[r + 1]`` per row.

    ``fold`` makes A-Z and a-z alike. ``breaks`` marks the ASCII bytes between words; being ASCII, bytes do
    for code points.
    """

    def __init__(self, chunk: TextChunk, fold: bool = False, breaks: np.ndarray = WHITE):
        inside = ~breaks[chunk.data]
        edge = np.zeros(len(inside) + 1, np.int8)
        edge[1:] += inside
        edge[:-1] -= inside
        # Between rows a word ends and another may begin.
        cuts = chunk.offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(inside))]
        cuts = np.unique(cuts)
        joined = cuts[inside[cuts - 1] & inside[cuts]]
        start = np.sort(np.concatenate([np.flatnonzero(edge == -1), joined]))
        end = np.sort(np.concatenate([np.flatnonzero(edge == 1), joined]))
        self.start, self.end = start, end
        self.first = np.searchsorted(start, chunk.offsets)
        self.hash = spans_hash((FOLDED if fold else PLAIN)[chunk.data], start, end)
        self.counts = np.diff(self.first)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def grams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, index of the first word, row) of every run of n words inside a row."""
    start = np.arange(max(0, len(words.hash) - n + 1))
    row = words.rows()
    if len(start):
        start = start[row[start] == row[start + n - 1]]
    return spans_hash(words.hash, start, start + n), start, row[start]


def bound_batches(spark: SparkSession) -> None:
    """Make the session's Arrow batches no larger than ``BATCH_ROWS`` rows; smaller ones stay."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= BATCH_ROWS:
        spark.conf.set(setting, str(BATCH_ROWS))


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of long numbers, a > b, with the same connected components: each task joins its own rows, and
    hangs every node that it has seen on the least one. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if not held:
            return
        nodes, at = np.unique(np.concatenate([a for a, _ in held] + [b for _, b in held]), return_inverse=True)
        one, two = at[: len(at) // 2], at[len(at) // 2 :]
        up = np.arange(len(nodes))
        while len(one):
            low, high = np.minimum(up[one], up[two]), np.maximum(up[one], up[two])
            open_ = low != high
            one, two = one[open_], two[open_]
            np.minimum.at(up, high[open_], low[open_])
            while not (up == (above := up[up])).all():
                up = above
        hung = np.flatnonzero(up != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[hung]), pa.array(nodes[up[hung]])], ["a", "b"])

    return edges.select("a", "b").mapInArrow(run, "a bigint, b bigint")


def map_texts(df: DataFrame, text: str, kernel: Callable[[TextChunk], dict[str, object]], results: dict[str, str]) -> DataFrame:
    """Every row with the columns that ``kernel`` computes from its whole text.

    The rows' own columns travel untouched; one with the name of a result is replaced by it.
    """
    bound_batches(df.sparkSession)
    own = [c for c in df.columns if c.lower() not in {r.lower() for r in results}]
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    place = [c.lower() for c in df.columns].index(text.lower())
    schema = T.StructType([packed.schema["row"], *T._parse_datatype_string(", ".join(f"`{k}` {v}" for k, v in results.items())).fields])
    names = list(results)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0)
            for at, chunk in chunks(rows.field(place)):
                made = kernel(chunk)
                arrays = [v if isinstance(v, pa.Array) else pa.array(v) for v in (made[k] for k in names)]
                yield pa.RecordBatch.from_arrays([rows.slice(at, chunk.rows), *arrays], ["row", *names])

    mapped = packed.mapInArrow(run, schema)
    return mapped.select(*[F.col(f"row.`{c}`") for c in own], *names)


def explode_texts(df: DataFrame, keys: list[str], text: str, kernel: Callable[[TextChunk], tuple[np.ndarray, dict[str, object]]], results: dict[str, str]) -> DataFrame:
    """Rows that ``kernel`` makes from each text: it returns the row numbers in the chunk and the new columns; ``keys`` are repeated."""
    bound_batches(df.sparkSession)
    packed = df.select(*keys, F.col(f"`{text}`").alias("_text_"))
    schema = T.StructType([*[packed.schema[k] for k in keys], *T._parse_datatype_string(", ".join(f"`{k}` {v}" for k, v in results.items())).fields])
    names = list(results)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, chunk in chunks(batch.column(len(keys))):
                rows, made = kernel(chunk)
                take = pa.array(rows + at, pa.int64())
                arrays = [v if isinstance(v, pa.Array) else pa.array(v) for v in (made[k] for k in names)]
                yield pa.RecordBatch.from_arrays([*[batch.column(i).take(take) for i in range(len(keys))], *arrays], [*keys, *names])

    return packed.mapInArrow(run, schema)

"""Packing documents into training sequences by order-preserving dynamic programming."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import ENTRIES, REMEMBERED, Splitter, read_spec
from .kernels import CHUNK, bound_batches, chunks, process_cache

#: Labels that end a sentence, in the tokenizer's own spelling without its word end.
STOPS = frozenset({".", "!", "?", "...", "!!", "??", "。", "!\"", ".\"", "?\""})


class LibraryIds:
    """Documents' ids as the tokenizers library gives them. Words it has encoded are remembered, within a bound."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = read_spec(path)
        self.split, self.library = Splitter(spec), Tokenizer.from_file(path)
        vocabulary, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        size = 1 + max([*vocabulary.values(), *self.split.special.values()])
        #: Ids that end a word, and ids that end a sentence.
        self.final, self.stops = np.zeros(size, bool), np.zeros(size, bool)
        self.final[[i for t, i in vocabulary.items() if t.endswith(suffix)] + list(self.split.special.values())] = True
        self.stops[[i for t, i in vocabulary.items() if t.removesuffix(suffix) in STOPS]] = True
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        documents = [self.split.words(t) for t in texts]
        fresh: dict[str, bytes] = {}
        missing: list[str] = []
        known, old = self.known, self.old
        for word in set().union(*documents) if documents else ():
            if word not in known:
                if word in old:
                    known[word] = old[word]
                else:
                    missing.append(word)
        if missing:
            # One call for all new words: each ends with an id that ends a word.
            ids = np.array(self.library.encode(" ".join(missing), add_special_tokens=False).ids, "<u4")
            ends = (np.flatnonzero(self.final[ids]) + 1).tolist()
            if len(ends) != len(missing):
                raise ValueError("the tokenizer splits a word again")
            raw = ids.tobytes()
            for word, a, b in zip(missing, [0, *ends], ends, strict=False):
                (known if len(word) <= REMEMBERED else fresh)[word] = raw[4 * a : 4 * b]
        find = known | fresh if fresh else known
        out = [np.frombuffer(b"".join([find[w] for w in d]), "<u4") for d in documents]
        if len(known) > ENTRIES:
            self.old, self.known = known, {}
        return out


def choose_cuts(places: np.ndarray, penalties: np.ndarray, total: int, limit: int) -> list[int]:
    """Positions at which to cut ``total`` tokens into windows of at most ``limit``, ending with ``total``.

    ``places`` are the boundaries (ascending, inside 1..total-1) and ``penalties`` the cost of a cut at each.
    A window costs its padding up to ``limit``; the sum of padding and penalties is least. The cost of a window
    from i to j is limit - j + i, so the best start of j is the least value of cost(i) + i among the starts not
    more than ``limit`` before it: a monotone queue holds these in order, and every boundary enters and leaves
    it once. Where two boundaries lie more than ``limit`` apart, cuts at exact multiples are put between.
    """
    spots = [0]
    costs = [0]
    for place, penalty in zip([*places.tolist(), total], [*penalties.tolist(), 0], strict=True):
        while place - spots[-1] > limit:
            spots.append(spots[-1] + limit)
            costs.append(limit)
        spots.append(place)
        costs.append(penalty)
    best = [0] * len(spots)
    back = [0] * len(spots)
    queue: deque[tuple[int, int]] = deque([(0, 0)])
    for j in range(1, len(spots)):
        at = spots[j]
        while spots[queue[0][1]] < at - limit:
            queue.popleft()
        value, i = queue[0]
        best[j], back[j] = value + limit - at + costs[j], i
        value = best[j] + at
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))
    cuts, j = [], len(spots) - 1
    while j:
        cuts.append(spots[j])
        j = back[j]
    cuts.reverse()
    return cuts


def tail_cuts(start: int, end: int, least: int) -> list[int]:
    """Cuts of the last window: powers of two, largest first, need no padding; below ``least`` tokens it stays whole."""
    cuts = []
    while end - start >= least and (end - start) & (end - start - 1):
        start += 1 << ((end - start).bit_length() - 1)
        cuts.append(start)
    return [*cuts, end]


class Packer:
    """Packs a stream of documents; holds about ``block`` tokens at a time."""

    def __init__(self, limit: int, block: int, sentence_penalty: int):
        self.limit, self.block, self.sentence_penalty = limit, block, sentence_penalty
        self.held: list[tuple[object, np.ndarray, np.ndarray, int, int]] = []
        self.size, self.sequence = 0, 0

    def add(self, key: object, ids: np.ndarray, stops: np.ndarray, start: int, whole: int) -> Iterator[tuple]:
        self.held.append((key, ids, stops, start, whole))
        self.size += len(ids)
        if self.size >= self.block:
            yield from self._pack(last=False)

    def finish(self) -> Iterator[tuple]:
        if self.size:
            yield from self._pack(last=True)

    def _pack(self, last: bool) -> Iterator[tuple]:
        ends = np.cumsum([len(d[1]) for d in self.held])
        begins = ends - [len(d[1]) for d in self.held]
        total = int(ends[-1])
        inner = np.concatenate([d[2] + b for d, b in zip(self.held, begins, strict=True)])
        place = np.concatenate([ends[:-1], inner])
        penalty = np.concatenate([np.zeros(len(ends) - 1, np.int64), np.full(len(inner), self.sentence_penalty, np.int64)])
        place, first = np.unique(place, return_index=True)  # a document's end comes first, and costs nothing
        penalty = penalty[first]
        fit = (place > 0) & (place < total)
        cuts = choose_cuts(place[fit], penalty[fit], total, self.limit)
        if last:
            cuts = cuts[:-1] + tail_cuts(cuts[-2] if len(cuts) > 1 else 0, total, 2)
        else:
            cuts = cuts[:-2]  # what follows may still change where the last windows end
        at, d = 0, 0
        for cut in cuts:
            offset = 0
            while at < cut:
                while ends[d] <= at:
                    d += 1
                end = min(cut, int(ends[d]))
                key, ids, _, start, whole = self.held[d]
                a, b = at - int(begins[d]), end - int(begins[d])
                yield key, start + a, b - a, ids[a:b], whole, self.sequence, offset
                offset += b - a
                at = end
            self.sequence += 1
        rest = []
        for (key, ids, stops, start, whole), b, e in zip(self.held, begins.tolist(), ends.tolist(), strict=True):
            if e > at:
                a = max(0, at - b)
                rest.append((key, ids[a:], stops[stops > a] - a, start + a, whole))
        self.held, self.size = rest, sum(len(x[1]) for x in rest)


def pack_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 4096, end_id: int = 2, block: int = 1 << 19, sentence_penalty: int = 16) -> DataFrame:
    """One row per piece: the key, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Documents follow one another as the table's partitions hold them, each closed by ``end_id``. Windows end
    at documents' or sentences' ends where that is cheaper than padding; a cut inside a document costs
    ``sentence_penalty`` tokens of padding at a sentence's end and ``limit`` elsewhere. What is left at a
    partition's end is cut at powers of two, which are not padded. Partitions are packed by themselves:
    there is no shuffle, and a task that is run again gives the same pieces. ``sequence_id`` is the
    partition's number times 2^40 plus the sequence's. A task holds about ``block`` tokens and one document.

    Defined cases: null and empty texts are one piece of one token; a null key stays null; documents of any
    length are cut into as many pieces as needed; repeated rows are packed each; an empty table gives an
    empty table; other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([T.StructField("key", rows.schema["key"].dataType), *T._parse_datatype_string("start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = process_cache(f"library:{path}", lambda: LibraryIds(path), "packing")
        packer = Packer(limit, block, sentence_penalty)
        sequence = TaskContext.get().partitionId() << 40
        out: list[tuple] = []
        closing = np.array([end_id], "<u4")
        key_type = pa.null()

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            made = [pa.array(columns[0], key_type)]
            made += [pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array([x.tobytes() for x in columns[3]], pa.binary())]
            made += [pa.array(columns[4], pa.int64()), pa.array(np.array(columns[5], np.int64) + sequence), pa.array(columns[6], pa.int64())]
            out.clear()
            return pa.RecordBatch.from_arrays(made, ["key", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            key_type = batch.column(0).type
            for at, chunk in chunks(batch.column(1), 2 * CHUNK):
                mine = batch.column(0).slice(at, chunk.rows).to_pylist()
                for one, ids in zip(mine, library.encode(chunk.texts.to_pylist()), strict=True):
                    stops = np.flatnonzero(library.stops[ids]) + 1
                    out.extend(packer.add(one, np.concatenate([ids, closing]), stops, 0, len(ids) + 1))
                if len(out) > 2000:
                    yield flush()
        out.extend(packer.finish())
        if out:
            yield flush()

    made = rows.mapInArrow(run, schema)
    return made.select(F.col("key").alias(key), "start", "length", "ids", "doc_tokens", "sequence_id", "offset")

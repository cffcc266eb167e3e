"""Substring dedup by seeds: documents meet on winnowed anchors, and matches are extended from there."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactlake import materialize

from .kernels import TextChunk, Words, bound_batches, chunks, explode_texts, grams, mix, spans_hash


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values, the place of the least; the first of equals."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    place, span = np.arange(len(values)), 1
    while 2 * span <= width:
        a, b = place[: len(place) - span], place[span:]
        place = np.where(values[b] < values[a], b, a)
        span *= 2
    a, b = place[:n], place[width - span : width - span + n]
    return np.where(values[b] < values[a], b, a)


def anchors_of(words: Words, window: int, seed: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The seeds of a chunk's texts: (row, {anchor, span, start, n}).

    A seed is a run of ``seed`` words whose hash is the least in some window of ``window`` words. It stands
    for the windows that chose it: ``n`` consecutive ones, the first beginning at word ``start`` of the text.
    ``anchor`` hashes the seed; ``span`` all the words of those windows and where the seed lies in them.
    """
    hashes = spans_hash(words.hash, np.arange(max(0, len(words.hash) - seed + 1)), np.arange(seed, max(seed, len(words.hash) + 1)))
    _, start, row = grams(words, window)
    if not len(start):
        empty = np.zeros(0, np.int64)
        return empty, {"anchor": empty, "span": empty, "start": empty.astype(np.int32), "n": empty.astype(np.int32)}
    chosen = least_places(hashes, window - seed + 1)[start]
    new = np.ones(len(start), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(new)
    n = np.diff(np.append(head, len(start)))
    first = start[head]
    whole = spans_hash(words.hash, first, first + n - 1 + window)
    span = mix(whole + (chosen[head] - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    anchor = hashes[chosen[head]]
    return row[head], {"anchor": anchor.view(np.int64), "span": span.view(np.int64), "start": (first - words.first[row[head]]).astype(np.int32), "n": n.astype(np.int32)}


def repeated_windows(docs: DataFrame, window: int = 35, seed: int = 12) -> DataFrame:
    """(doc_id, uid, start, n): word ranges of ``docs`` (doc_id, uid, text) that windows found elsewhere cover.

    Every window of ``window`` words chooses one anchor, by its own words only, so equal windows choose equal
    anchors at the same place, and a window needs comparing only where its anchor occurs again. Extension
    goes from the anchor over all words of the windows that chose it. Where these spans are equal throughout,
    all their windows repeat. Where an anchor has different spans, one text for each span gives its windows
    one by one, and those that two spans have in common repeat. No pairs of documents are listed, so a
    passage of any number of copies costs no more than its copies; nothing is capped.
    """
    found = explode_texts(docs, ["doc_id", "uid"], "text", lambda c: anchors_of(Words(c), window, seed), {"anchor": "bigint", "span": "bigint", "start": "int", "n": "int"})
    found = materialize(found, "anchors")
    shared = materialize(found.groupBy("anchor").agg(F.count("*").alias("times")).where("times > 1").select("anchor"), "shared")
    seeds = materialize(found.join(shared, "anchor"), "seeds")
    classes = seeds.groupBy("anchor", "span").agg(F.count("*").alias("times"), F.min(F.struct("uid", "doc_id", "start", "n")).alias("first"))
    classes = materialize(classes, "spans")
    copied = materialize(classes.where("times > 1").select("anchor", "span"), "copied")
    same = seeds.join(copied, ["anchor", "span"]).select("doc_id", "uid", "start", (F.col("n") + window - 1).alias("n"))
    mixed = materialize(classes.groupBy("anchor").agg(F.count("*").alias("spans")).where("spans > 1").select("anchor"), "mixed")
    unsure = classes.join(mixed, "anchor").select("first.*", (F.col("times") == 1).alias("single"))
    by_text = materialize(unsure.groupBy("doc_id", "uid").agg(F.collect_list(F.struct("start", "n", "single")).alias("runs")), "unsure")
    texts = docs.join(by_text.select(F.col("doc_id").alias("d"), F.col("uid").alias("u"), "runs"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("uid") == F.col("u")))
    texts = texts.dropDuplicates(["doc_id", "uid"]).select("doc_id", "uid", "text", "runs")
    doc_type = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", doc_type), *T._parse_datatype_string("uid bigint, single boolean, start int, window bigint").fields])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, chunk in chunks(batch.column(2)):
                words = Words(chunk)
                runs = batch.column(3).slice(at, chunk.rows)
                per_row = np.diff(runs.offsets.to_numpy())
                flat = runs.flatten()
                begin, n = flat.field("start").to_numpy().astype(np.int64), flat.field("n").to_numpy().astype(np.int64)
                row = np.repeat(np.repeat(np.arange(chunk.rows), per_row), n)
                single = np.repeat(flat.field("single").to_numpy(zero_copy_only=False), n)
                start = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
                place = start + words.first[row]
                code = spans_hash(words.hash, place, place + window).view(np.int64)
                take = pa.array(row + at)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(single), pa.array(start.astype(np.int32)), pa.array(code)], ["doc_id", "uid", "single", "start", "window"])

    listed = materialize(texts.mapInArrow(windows, schema), "windows")
    common = materialize(listed.groupBy("window").agg(F.count("*").alias("times")).where("times > 1").select("window"), "common")
    partly = listed.where("single").join(common, "window").select("doc_id", "uid", "start", F.lit(window).alias("n"))
    return same.unionByName(partly)


def remove_repeats(docs: DataFrame, window: int = 35, seed: int = 12, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Documents with n_words, n_removed, ``removed`` (start and length of each range of words) and kept_text.

    A word goes if a window of ``window`` consecutive words that covers it has a word sequence that starts
    anywhere else too, in another document or the same; all is judged on the input. ``kept_text`` is the text
    without these words and the white space after each; other white space stays.

    Defined cases: null and empty texts and those shorter than a window lose nothing (null: kept_text is
    empty); repeated rows are copies of each other and lose all their windows; a null key is a key like
    others; the rows' other columns are kept, and one named like a result is replaced; an empty table gives
    an empty table. Hashes have 64 bits; equal ones are taken as equal words.
    """
    bound_batches(docs.sparkSession)
    results = {"n_words": "bigint", "n_removed": "bigint", "removed": "array<struct<start:int,length:int>>", "kept_text": "string"}
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    keyed = docs.select(F.col(f"`{key}`").alias("doc_id"), F.xxhash64(F.col(f"`{key}`"), body).alias("uid"), body.alias("text"))
    ranges = repeated_windows(keyed, window, seed)
    # Each occurrence of a repeated row has given its ranges; they are the same ones.
    ranges = materialize(ranges.distinct().groupBy("doc_id", "uid").agg(F.collect_list(F.struct("start", "n")).alias("ranges")), "ranges")
    own = [c for c in docs.columns if c.lower() not in results]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.col(f"`{key}`").alias("d"), F.xxhash64(F.col(f"`{key}`"), body).alias("u"), body.alias("text"))
    rows = rows.join(ranges, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("u") == F.col("uid")), "left").select("row", "text", "ranges")
    schema = T.StructType([rows.schema["row"], *T._parse_datatype_string(", ".join(f"{k} {v}" for k, v in results.items())).fields])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, chunk in chunks(batch.column(1)):
                words = Words(chunk)
                ranges = batch.column(2).slice(at, chunk.rows).to_pylist()
                kept, removed, n_removed = chunk.texts.to_pylist(), [[] for _ in range(chunk.rows)], np.zeros(chunk.rows, np.int64)
                for r, mine in enumerate(ranges):
                    if not mine:
                        continue
                    gone = np.zeros(words.counts[r] + 1, np.int64)
                    begin, length = np.array([x["start"] for x in mine]), np.array([x["n"] for x in mine])
                    np.add.at(gone, begin, 1)
                    np.add.at(gone, begin + length, -1)
                    mask = np.cumsum(gone[:-1]) > 0
                    edge = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
                    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                    removed[r] = [{"start": x, "length": y - x} for x, y in zip(a.tolist(), b.tolist(), strict=True)]
                    n_removed[r] = mask.sum()
                    # From a range's first word to the word after it, or to the text's end.
                    begins = np.append(words.start[words.first[r] : words.first[r + 1]], chunk.offsets[r + 1])
                    cuts = np.stack([begins[a], begins[b]], axis=1).ravel().tolist()
                    edges = [int(chunk.offsets[r]), *cuts, int(chunk.offsets[r + 1])]
                    kept[r] = b"".join([chunk.data[x:y].tobytes() for x, y in zip(edges[::2], edges[1::2], strict=True)]).decode()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, chunk.rows), pa.array(words.counts, pa.int64()), pa.array(n_removed), pa.array(removed, pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))), pa.array(kept, pa.string())],
                    ["row", *results],
                )

    return rows.mapInArrow(cut, schema).select("row.*", *results)

"""Quality rules by tokeniser fertility: how a public vocabulary cuts a text tells prose from junk."""

from __future__ import annotations

from array import array
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import WHITE, TextChunk, Words, grams, map_texts, process_cache

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
#: Words a worker remembers before it gives up the older half.
REMEMBERED_WORDS = 200_000
BLANK = " \t\n\x0b\x0c\r"
RESULTS = {
    "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint",
    "n_pieces": "bigint", "n_byte_pieces": "bigint", "entropy": "double",
}


class Band(NamedTuple):
    """A text is rejected outside these: characters per token, share of tokens that are bytes, and token entropy.

    The entropy (bits) is held against log2 of the number of tokens, up to 2^``full`` of them.
    """

    least_chars: float
    most_chars: float
    most_bytes: float
    least_evenness: float
    full: float = 9.0


#: By language; ``None`` for every other one. The vocabulary is mostly English, so others are cut finer.
BANDS: dict[str | None, Band] = {
    "en": Band(1.2, 6.5, 0.05, 0.68),
    "de": Band(1.2, 6.5, 0.05, 0.67),
    "fr": Band(1.2, 6.5, 0.05, 0.66),
    "es": Band(1.2, 6.5, 0.05, 0.66),
    None: Band(0.3, 8.0, 0.98, 0.55),
}


class Fertility:
    """How a SentencePiece model with byte fallback cuts words; remembers what it has cut, within a bound."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        # word -> its pieces, as 32-bit integers
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def cut(self, words: list[bytes]) -> list[bytes]:
        known, old = self.known, self.old
        missing = [w for w in words if w not in known and w not in old]
        fresh: dict[bytes, bytes] = {}
        if missing:
            texts = [w.decode("utf-8", "replace") for w in missing]
            fresh = {w: array("i", ids).tobytes() for w, ids in zip(missing, self.model.encode(texts, num_threads=1), strict=True)}
        out = []
        for w in words:
            ids = known.get(w)
            if ids is None:
                ids = old.get(w)
                if ids is None:
                    ids = fresh[w]
                if len(w) <= 64:
                    known[w] = ids
            out.append(ids)
        if len(known) > REMEMBERED_WORDS:
            self.old, self.known = known, {}
        return out


def base_counts(chunk: TextChunk, words: Words) -> dict[str, np.ndarray]:
    begins = ~WHITE[chunk.data] & ((chunk.data & 0xC0) != 0x80)

    def per_row(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return total[chunk.offsets[1:]] - total[chunk.offsets[:-1]]

    hashes, start, row = grams(words, 5)
    repeated = np.zeros(len(words.hash) + 5, np.int64)
    if len(hashes):
        order = np.lexsort((hashes, row))
        h, r = hashes[order], row[order]
        same = (h[1:] == h[:-1]) & (r[1:] == r[:-1])
        again = np.zeros(len(h), bool)
        again[1:] |= same
        again[:-1] |= same
        at = start[order[again]]
        np.add.at(repeated, at, 1)
        np.add.at(repeated, at + 5, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(repeated)[: len(words.hash)] > 0)])
    lines = []
    for text in chunk.texts.to_pylist():
        worded = [x for x in text.split("\n") if x.strip(BLANK)]
        lines.append(len(worded) - len(set(worded)))
    return {
        "n_words": words.counts,
        "word_chars": per_row(begins),
        "n_symbols": per_row(SYMBOLS[chunk.data]),
        "n_dup_lines": np.array(lines, np.int64),
        "n_repeat_words": covered[words.first[1:]] - covered[words.first[:-1]],
    }


def fertility_counts(chunk: TextChunk, words: Words, cutter: Fertility) -> dict[str, np.ndarray]:
    distinct, first, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
    raw = chunk.data.tobytes()
    cuts = cutter.cut([raw[a:b] for a, b in zip(words.start[first].tolist(), words.end[first].tolist(), strict=True)])
    length = np.array([len(c) for c in cuts], np.int64) // 4
    flat = np.frombuffer(b"".join(cuts), np.int32)
    begin = np.cumsum(length) - length
    per_word = length[inverse]
    row = np.repeat(words.rows(), per_word)
    ends = np.cumsum(per_word)
    where = np.arange(len(row)) - np.repeat(ends - per_word, per_word) + np.repeat(begin[inverse], per_word)
    tokens = flat[where].astype(np.int64)
    n = np.bincount(row, minlength=chunk.rows)
    size = len(cutter.is_byte)
    key, times = np.unique(row * size + tokens, return_counts=True)
    of = key // size
    p = times / n[of]
    return {
        "n_pieces": n,
        "n_byte_pieces": np.bincount(row, weights=cutter.is_byte[tokens], minlength=chunk.rows).astype(np.int64),
        "entropy": np.bincount(of, weights=-p * np.log2(p), minlength=chunk.rows) + 0.0,
    }


def judge_quality(docs: DataFrame, path: str, text: str = "text", lang: str = "lang", bands: dict[str | None, Band] = BANDS) -> DataFrame:
    """Documents with their base counts, their fertility figures, ``base_failed`` and ``kept``.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text; each is cut by the SentencePiece model at ``path``,
    which must be readable on every executor. ``kept`` is false for a document that fails the base rules
    (fewer than 10 words, or more than a fifth of them in repeated 5-word windows) or lies outside its
    language's band.

    Defined cases: a null or empty text has no words and fails; a null or unlisted language has the band
    listed under None; a missing language column likewise; repeated rows are judged alike; the rows' other
    columns are kept, and one named like a result is replaced. No shuffle: a text is judged in its own row.
    """

    def kernel(chunk: TextChunk) -> dict[str, object]:
        words = Words(chunk)
        cutter = process_cache(f"fertility:{path}", lambda: Fertility(path), "quality")
        made = {**base_counts(chunk, words), **fertility_counts(chunk, words, cutter)}
        return {k: pa.array(v, pa.float64() if k == "entropy" else pa.int64()) for k, v in made.items()}

    counted = map_texts(docs, text, kernel, RESULTS)
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    chars = F.col("word_chars") / F.col("n_pieces")
    byte_share = F.col("n_byte_pieces") / F.col("n_pieces")

    def inside(b: Band):
        even = F.col("entropy") >= b.least_evenness * F.least(F.log2("n_pieces"), F.lit(b.full))
        return chars.between(b.least_chars, b.most_chars) & (byte_share <= b.most_bytes) & even

    fits = inside(bands[None])
    if lang in docs.columns:
        for name, band in bands.items():
            if name is not None:
                fits = F.when(F.col(f"`{lang}`") == name, inside(band)).otherwise(fits)
    return counted.withColumn("base_failed", base_failed).withColumn("kept", ~F.col("base_failed") & F.coalesce(fits, F.lit(False)))

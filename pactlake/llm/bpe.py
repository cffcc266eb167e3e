"""BPE encoding and decoding by an automaton that the merges are compiled into, one gadget a merge."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .kernels import TextChunk, map_texts, process_cache

#: Unicode's White_Space characters, as a class.
WHITE_SPACE = r"\t-\r\x20\x85\xa0  -     　"
#: Words longer than this are encoded but not remembered.
REMEMBERED = 64
#: Entries of a cache before its older half is given up.
ENTRIES = 300_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Automaton:
    """A deterministic automaton over tokens that accepts exactly the segmentations BPE gives.

    It starts with one state that every symbol leads back to. The gadget of merge (a, b), in order of rank,
    gives the arcs labelled a a new target: a copy of the old one without its arc b; and wherever a could be
    read before b it adds an arc ab that leads where b led. A copy differs from its original by that one arc,
    so a state is kept as its original and the arc it lacks. What an arc that is added later is allowed
    follows from its parts: it exists in a state unless the state lacks the part that it starts with, at the
    time of its merge. So the states that a token's arcs lead to are the gadgets of the token itself and,
    before its own merge, of its last part, of that one's last part and so on; see ``allows``.

    ``run`` reads a word's symbols. Of the tokens that end at a position just one is allowed after what was
    read up to its begin, hence there is one state for each position and no way back is ever tried.
    """

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.ids, self.suffix = vocabulary, suffix
        missing: dict[tuple[str, str], int] = {}
        ends: dict[str, tuple[tuple[str, int], ...]] = {}
        starts: dict[str, tuple[tuple[str, int], ...]] = {}
        last = len(merges)

        def symbol(x: str) -> None:
            ends.setdefault(x, ((x, last),))
            starts.setdefault(x, ((x, last),))

        made = {a + b for a, b in merges}
        if len(made) != len(merges):
            raise ValueError("two merges make the same token")
        for rank, (a, b) in enumerate(merges):
            for x in (a, b):
                if x not in ends:
                    if x in made:
                        raise ValueError(f"merge {rank} uses a token that a later merge makes")
                    symbol(x)
            missing[a, b] = rank
            # The arc ab leads where b led before this merge, and exists where a did.
            ends[a + b] = ((a + b, last), (b, rank), *ends[b][1:])
            starts[a + b] = ((a + b, last), (a, rank), *starts[a][1:])
        for token in vocabulary:
            symbol(token)
        # From here on tokens are numbers, and a pair of them is one number.
        self._missing = {vocabulary[a] << 20 | vocabulary[b]: rank for (a, b), rank in missing.items()}
        self._ends = {vocabulary[t]: [(vocabulary[x] << 20, until) for x, until in e] for t, e in ends.items()}
        self._starts = {vocabulary[t]: [(vocabulary[y], born) for y, born in e] for t, e in starts.items()}
        self._arcs: dict[int, bool] = {}
        # Read so far -> the last token, and the ids and labels of all tokens.
        self._inner: dict[str, tuple[int, bytes, str]] = {}
        self._bytes = [i.to_bytes(4, "little") for i in range(max(vocabulary.values()) + 1)]
        #: Lengths of the tokens that end like this, by the last three symbols or fewer; inner and final ones.
        self._lengths: tuple[dict[str, list[int]], dict[str, list[int]]] = ({}, {})
        for final in (False, True):
            by_tail: dict[str, set[int]] = {}
            for token in vocabulary:
                if final and not suffix or token.endswith(suffix) != final and suffix:
                    continue
                base = token[: -len(suffix)] if final else token
                for tail in {base[-3:], base[-2:], base[-1:]}:
                    by_tail.setdefault(tail, set()).add(len(base))
            for tail, lengths in by_tail.items():
                for shorter in range(1, len(tail)):
                    lengths |= {x for x in by_tail.get(tail[-shorter:], ()) if x == shorter}
                self._lengths[final][tail] = sorted(lengths, reverse=True)
        self._final = bool(suffix)

    def allows(self, before: int, token: int) -> bool:
        """Whether the state that arcs ``before`` lead to has an arc ``token``."""
        find = self._missing.get
        starts = self._starts[token]
        for x, until in self._ends[before]:
            for y, born in starts:
                rank = find(x | y)
                if rank is not None and rank < until and rank <= born:
                    return False
        return True

    def _possible(self, symbols: str, n: int, final: bool) -> list[int]:
        lengths = self._lengths[final]
        for k in (3, 2):
            found = lengths.get(symbols[n - k : n]) if n >= k else None
            if found is not None:
                return found
        return lengths[symbols[n - 1 : n]]

    def _step(self, symbols: str, n: int, final: bool) -> tuple[int, int]:
        """(token, where it begins) of the arc that ends at ``n``."""
        ids, inner, arcs = self.ids, self._inner, self._arcs
        suffix = self.suffix if final else ""
        for length in self._possible(symbols, n, final):
            cut = n - length
            if cut < 0:
                continue
            token = ids.get(symbols[cut:n] + suffix)
            if token is None:
                continue
            if not cut:
                return token, 0
            pair = inner[symbols[:cut]][0] << 20 | token
            allowed = arcs.get(pair)
            if allowed is None:
                allowed = arcs[pair] = self.allows(pair >> 20, token)
            if allowed:
                return token, cut
        raise KeyError(f"no token ends {symbols!r}")

    def run(self, word: str) -> tuple[bytes, str]:
        """The ids of one pre-split word, given in byte letters, as 32-bit integers; and its labels."""
        inner = self._inner
        if len(inner) > ENTRIES:
            inner.clear()
        if len(self._arcs) > ENTRIES:
            self._arcs.clear()
        size = len(word)
        if size > REMEMBERED:
            return self._run_long(word)
        n = size - 1
        while n and word[:n] not in inner:
            n -= 1
        ids = self._bytes
        for m in range(n + 1, size):
            token, cut = self._step(word, m, False)
            if cut:
                _, before, labels = inner[word[:cut]]
                inner[word[:m]] = token, before + ids[token], labels + " " + word[cut:m]
            else:
                inner[word[:m]] = token, ids[token], word[:m]
        token, cut = self._step(word, size, self._final)
        label = word[cut:] + self.suffix
        if not cut:
            return ids[token], label
        _, before, labels = inner[word[:cut]]
        return before + ids[token], labels + " " + label

    def _run_long(self, word: str) -> tuple[bytes, str]:
        """As ``run``, with states kept by position: no prefix of a long word is stored."""
        ids, n = self.ids, len(word)
        at: list[tuple[int, int]] = [(0, 0)]
        for end in range(1, n + 1):
            final = end == n and self._final
            for cut in (end - length for length in self._possible(word, end, final) if length <= end):
                token = ids.get(word[cut:end] + (self.suffix if final else ""))
                if token is not None and (not cut or self.allows(at[cut][0], token)):
                    at.append((token, cut))
                    break
            else:
                raise KeyError("no token ends here")
        out, labels, end = [], [], n
        while end:
            token, cut = at[end]
            out.append(self._bytes[token])
            labels.append(word[cut:end] + (self.suffix if end == n else ""))
            end = cut
        out.reverse()
        labels.reverse()
        return b"".join(out), " ".join(labels)


class Remembering(dict):
    """word -> what ``make`` gives for it. Two generations bound the memory; long words are not kept."""

    def __init__(self, make: Callable[[str], object]):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, word: str) -> object:
        value = self.old.pop(word, None)
        if value is None:
            value = self.make(word)
            if len(word) > REMEMBERED:
                return value
        if len(self) >= ENTRIES:
            self.old = dict(self)
            self.clear()
        self[word] = value
        return value


class Splitter:
    """What a tokenizer file does before its merges: normaliser, special tokens, pre-split pattern."""

    def __init__(self, spec: dict):
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self._split = regex.compile(split["pattern"]["Regex"].replace(r"\s", WHITE_SPACE))
        # Letters that a text as a whole folds otherwise than one by one.
        self._uneven = re.compile("[\u03a3\u0130]")

    def words(self, text: str) -> list[str]:
        """The pre-split words of a text, folded; special tokens stand as they are."""
        if text.isascii():
            if "<|" not in text:
                return self._split.findall(text.lower())
        elif "<|" not in text and not self._uneven.search(text):
            return self._split.findall(text.lower() if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text).lower())
        out: list[str] = []
        for part in self._special.split(text) if self._special else [text]:
            if part in self.special:
                out.append(part)
            else:
                out.extend(self._split.findall("".join(map(str.lower, unicodedata.normalize("NFC", part)))))
        return out


class WordBpe(Splitter):
    """The encoder of a tokenizer file."""

    def __init__(self, path: str):
        spec = read_spec(path)
        super().__init__(spec)
        model = spec["model"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], pairs, model["end_of_word_suffix"] or "")
        self._letters = dict(enumerate(byte_letters()))

    def encode(self, word: str) -> tuple[bytes, str]:
        """A word's ids as little-endian 32-bit integers, and its labels joined by a space."""
        if word in self.special:
            return self.special[word].to_bytes(4, "little"), word
        return self.automaton.run(word.encode().decode("latin-1").translate(self._letters))


def read_spec(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def encoder(path: str) -> WordBpe:
    return process_cache(f"bpe:{path}", lambda: WordBpe(path), "bpe")


def words_of(path: str) -> dict[str, tuple[bytes, str]]:
    """word -> its ids as 32-bit integers, its labels joined by a space; remembered by the worker."""
    return process_cache(f"words:{path}", lambda: Remembering(encoder(path).encode), "bpe")


def encode_documents(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Documents with ``tokens`` (array of ids) and ``decoded``, of their whole texts.

    ``path`` is the tokenizer file; it must be readable on every executor. Ids are those of the tokenizers
    library without special tokens added; control strings in a text become their special tokens, as there.
    ``decoded`` emits the labels of the arcs, joined by a space.

    Defined cases: null and empty texts have no tokens and decode to an empty text; a text without white
    space, of any length, is read in time proportional to its length; repeated rows are treated alike; the
    rows' other columns are kept, and one called tokens or decoded is replaced. No shuffle.
    """

    def kernel(chunk: TextChunk) -> dict[str, object]:
        known, words = words_of(path), encoder(path).words
        ids, decoded, ends = [], [], [0]
        for document in chunk.texts.to_pylist():
            found = list(map(known.__getitem__, words(document)))
            ids.append(b"".join([f[0] for f in found]))
            ends.append(ends[-1] + len(ids[-1]) // 4)
            decoded.append(" ".join([f[1] for f in found]))
        values = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
        return {"tokens": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values), "decoded": pa.array(decoded, pa.string())}

    return map_texts(docs, text, kernel, {"tokens": "array<int>", "decoded": "string"})

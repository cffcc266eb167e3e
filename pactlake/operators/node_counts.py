"""Counts of the nodes of JSON documents, made inside tasks.

A plain document is read once and its nodes are counted; only counts leave the task. A document that a JSON
reader of Spark might judge otherwise is left as it is, so that Spark judges it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from .nodes import MAX_DEPTH, escape_pointer

COUNTS = ["occurrences", "n_null", "n_true", "n_false", "n_string", "n_number", "n_int64", "n_object", "n_array"]
# Counts and their texts that a task holds before it gives them out, and what is left to Spark:
# longer documents, names and numbers.
HELD, HELD_CHARS = 1 << 16, 1 << 25
LONG_DOCUMENT, LONG_NAME, LONG_NUMBER = 1 << 23, 10_000, 300
_SURROGATE = re.compile(r"\\u[dD][89a-fA-F]")
_STRING = re.compile(r'"(?:[^"\\]|\\.)*+"', re.DOTALL)


class _Left(ValueError):
    """The document is not plain."""


class _Whole:
    """A number that fits 64 bits, spelled without point and exponent."""


class _Real:
    """Any other number."""


def _whole(text: str) -> type:
    if len(text) > 18:
        if len(text) > LONG_NUMBER:
            raise _Left
        return _Whole if -(1 << 63) <= int(text) < 1 << 63 else _Real
    return _Whole


def _real(text: str) -> type:
    if len(text) > LONG_NUMBER or abs(float(text)) == float("inf"):
        raise _Left
    return _Real


def _constant(_: str) -> None:
    raise _Left


def _depth(text: str) -> int:
    now = deepest = 0
    for c in re.findall(r"[\[\]{}]", _STRING.sub("", text)):
        now += 1 if c in "[{" else -1
        deepest = max(deepest, now)
    return deepest


def _long_name(value) -> bool:
    if type(value) is dict:
        return any(len(k) > LONG_NAME or _long_name(x) for k, x in value.items())
    return type(value) is list and any(map(_long_name, value))


class _Place:
    """What has been counted at one schema path."""

    __slots__ = ("path", "up", "name", "depth", "members", "items", "texts", "null", "true", "false", "real", "whole", "objects", "arrays", "non_empty")

    def __init__(self, path: str, up: str | None = None, name: str | None = None, depth: int = 0):
        self.path, self.up, self.name, self.depth = path, up, name, depth
        self.members: dict[str, _Place] = {}
        self.items: _Place | None = None
        self.texts: dict[str, int] = {}
        self.null = self.true = self.false = self.real = self.whole = self.objects = self.arrays = 0
        self.non_empty = False


class _Counter:
    def __init__(self) -> None:
        self.roots: dict = {}
        self.held = self.chars = 0
        self.read = json.JSONDecoder(parse_int=_whole, parse_float=_real, parse_constant=_constant).decode

    def add(self, by, text: str) -> None:
        if len(text) > LONG_DOCUMENT or ("\\u" in text and _SURROGATE.search(text)):
            raise _Left
        if text.count("{") + text.count("[") > MAX_DEPTH and _depth(text) > MAX_DEPTH:
            raise _Left
        value = self.read(text)
        if len(text) > LONG_NAME and _long_name(value):
            raise _Left
        root = self.roots.get(by)
        if root is None:
            root = self.roots[by] = _Place("#")
        self._count(root, value)

    def _count(self, place: _Place, value) -> None:
        kind = type(value)
        if kind is dict:
            place.objects += 1
            members = place.members
            for name, x in value.items():
                below = members.get(name)
                if below is None:
                    below = members[name] = self._place(place, f"/properties/{escape_pointer(name)}", name)
                # The commonest kinds first, without a call.
                if type(x) is str and x in below.texts:
                    below.texts[x] += 1
                elif x is _Whole:
                    below.whole += 1
                else:
                    self._count(below, x)
        elif kind is list:
            place.arrays += 1
            if value:
                place.non_empty = True
                if place.items is None:
                    place.items = self._place(place, "/items", None)
                for x in value:
                    self._count(place.items, x)
        elif kind is str:
            if value in place.texts:
                place.texts[value] += 1
            else:
                place.texts[value] = 1
                self.held += 1
                self.chars += len(value)
        elif value is _Whole:
            place.whole += 1
        elif value is _Real:
            place.real += 1
        elif value is None:
            place.null += 1
        elif value:
            place.true += 1
        else:
            place.false += 1

    def _place(self, above: _Place, step: str, name: str | None) -> _Place:
        place = _Place(above.path + step, above.path, name, above.depth + 1)
        self.held += 1
        self.chars += len(place.path)
        return place

    def rows(self) -> Iterator[tuple]:
        """(by, path, up, name, text, depth, counts..., non_empty) of all that is held."""
        for by, root in self.roots.items():
            todo = [root]
            while todo:
                p = todo.pop()
                todo.extend(p.members.values())
                if p.items is not None:
                    todo.append(p.items)
                numbers = p.whole + p.real
                other = p.null + p.true + p.false + numbers + p.objects + p.arrays
                if other:
                    yield (by, p.path, p.up, p.name, None, p.depth, other, p.null, p.true, p.false, 0, numbers, p.whole, p.objects, p.arrays, p.non_empty)
                for text, n in p.texts.items():
                    yield by, p.path, p.up, p.name, text, p.depth, n, 0, 0, 0, n, 0, 0, 0, 0, False


def node_counts(docs: DataFrame, by: str) -> DataFrame:
    """(by, document) to counts per place and text, several rows each, and rows with the ``document`` that is left."""
    text = StringType()
    schema = StructType([
        docs.schema[by], *[StructField(c, text) for c in ("schema_path", "parent_path", "name", "str")], StructField("depth", IntegerType()),
        *[StructField(c, LongType()) for c in COUNTS], StructField("non_empty", BooleanType()), StructField("document", BinaryType()),
    ])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, key = _Counter(), None
        types = [pa.string()] * 4 + [pa.int32()] + [pa.int64()] * len(COUNTS) + [pa.bool_(), pa.binary()]

        def out(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(rows), 10_000):
                cells = zip(*rows[i : i + 10_000])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, [key, *types])], names)

        for batch in batches:
            key = batch.schema.field(0).type
            left: list[tuple] = []
            who_column = batch.column(0)
            whom = who_column.to_numpy(zero_copy_only=False).tolist() if pa.types.is_binary(key) else who_column.to_pylist()
            for who, body in zip(whom, batch.column(1).to_numpy(zero_copy_only=False).tolist()):
                if body is None:
                    continue
                try:
                    counter.add(who, body.decode())
                except ValueError:
                    left.append((who, *[None] * (len(names) - 2), body))
            yield from out(left)
            if counter.held > HELD or counter.chars > HELD_CHARS:
                yield from out([(*r, None) for r in counter.rows()])
                counter = _Counter()
        yield from out([(*r, None) for r in counter.rows()])

    return docs.mapInArrow(run, schema)

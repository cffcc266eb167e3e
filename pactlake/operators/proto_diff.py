"""Field-number comparison of Protobuf schemas given as tables of descriptors.

Each schema becomes one row (messages, fields by message and number, reserved ranges, enum values), so
a pair is compared inside its own row after two joins on schema_id.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..wire import SOURCE, WIRE, WIRE_JSON
from .json_diff import B, FINDING, FWD, _one

# Wire class of each scalar type.
WIRE_CLASS = {
    "double": "fixed64", "float": "fixed32", "int32": "varint", "int64": "varint", "uint32": "varint", "uint64": "varint",
    "sint32": "varint", "sint64": "varint", "fixed32": "fixed32", "fixed64": "fixed64", "sfixed32": "fixed32",
    "sfixed64": "fixed64", "bool": "varint", "string": "length", "bytes": "length",
}
# How the JSON mapping shows each scalar type.
JSON_KIND = {
    "double": "number", "float": "number", "int32": "number", "int64": "quoted number", "uint32": "number",
    "uint64": "quoted number", "sint32": "number", "sint64": "quoted number", "fixed32": "number",
    "fixed64": "quoted number", "sfixed32": "number", "sfixed64": "quoted number", "bool": "boolean",
    "string": "string", "bytes": "base64",
}
# How a varint's number is written follows from its type's name.
VARINT_ENCODING = {t: {"b": "truth", "u": "plain", "s": "zigzag"}.get(t[0], "signed") for t, wire in WIRE_CLASS.items() if wire == "varint"}


def _lookup(table: dict[str, str], name: str) -> str:
    arms = " ".join(f"when {name} = '{kind}' then '{value}'" for kind, value in table.items())
    return f"case {arms} end"


def _both(path: str, kind: str, surface: int) -> str:
    return f"array({_one(path, kind, B, surface)}, {_one(path, kind, FWD, surface)})"


def _single(path: str, kind: str, direction: str, surface: int) -> str:
    return f"array({_one(path, kind, direction, surface)})"


def _types(was: str, now: str, path: str) -> str:
    wire, code, shown = (lambda n, t=t: _lookup(t, n) for t in (WIRE_CLASS, VARINT_ENCODING, JSON_KIND))
    return (
        f"case when {was} <=> {now} then null "
        f"when coalesce({wire(was)} <> {wire(now)}, true) then {_both(path, 'wire_type_changed', WIRE)} "
        f"when {wire(was)} = 'varint' and {code(was)} <> {code(now)} then {_both(path, 'wire_type_changed', WIRE)} "
        f"when {shown(was)} <> {shown(now)} then {_both(path, 'type_promoted', WIRE_JSON)} "
        f"else {_single(path, 'type_promoted', B, SOURCE)} end"
    )


def _covered(ranges: str, message: str, number: str) -> str:
    return f"exists({ranges}, g -> g.message = {message} and {number} between g.lo and g.hi)"


_FIELD = [
    f"case when b.name <> a.name then {_both('path', 'name_changed', WIRE_JSON)} end",
    f"case when b.label = a.label then null when array_sort(array(b.label, a.label)) = array('optional', 'singular') "
    f"then {_single('path', 'presence_changed', B, SOURCE)} else {_both('path', 'wire_type_changed', WIRE)} end",
    f"case when (b.map_key is null) <> (a.map_key is null) then {_both('path', 'wire_type_changed', WIRE)} "
    f"else flatten(array_compact(array({_types('b.map_key', 'a.map_key', 'path_key')}, {_types('b.type', 'a.type', 'path')}))) end",
]


def _comparison() -> str:
    field = f"flatten(array_compact(array({', '.join(_FIELD)})))".replace("path_key", "concat(path, '/key')")
    field = re.sub(r"(?<![\w.'])(a|b|path)(?![\w'(])", r"p.\1", field)
    shared = "array_intersect(map_keys(b_fields), map_keys(a_fields))"
    changed = f"transform({shared}, k -> named_struct('path', k, 'b', b_fields[k], 'a', a_fields[k]))"
    gone = "filter(map_values(b_fields), f -> not map_contains_key(a_fields, f.path) and array_contains(a_messages, f.message) and not {})"
    fresh = "filter(map_values(a_fields), f -> not map_contains_key(b_fields, f.path) and array_contains(b_messages, f.message) and {})"
    named = "array_intersect(map_keys(b_enums), map_keys(a_enums))"
    enums_in = "filter(map_values({0}), e -> not map_contains_key({1}, e.path) and exists(map_values({1}), o -> o.enum = e.enum))"
    parts = [
        f"flatten(transform(array_except(b_messages, a_messages), m -> {_both('m', 'name_changed', WIRE_JSON)}))",
        f"flatten(transform({changed}, p -> {field}))",
        f"transform({gone.format(_covered('a_reserved', 'f.message', 'f.number'))}, f -> {_one('f.path', 'field_removed_without_reserved', B, WIRE)})",
        f"transform({fresh.format(_covered('b_reserved', 'f.message', 'f.number'))}, f -> {_one('f.path', 'field_number_reused', B, WIRE)})",
        f"flatten(transform(filter({named}, k -> b_enums[k].name <> a_enums[k].name), k -> {_both('k', 'name_changed', WIRE_JSON)}))",
        f"transform({enums_in.format('b_enums', 'a_enums')}, e -> {_one('e.path', 'enum_value_removed', B, WIRE_JSON)})",
        f"transform({enums_in.format('a_enums', 'b_enums')}, e -> {_one('e.path', 'enum_value_added', FWD, WIRE_JSON)})",
    ]
    return f"concat({', '.join(parts)})"


def compile_proto(messages: DataFrame, fields: DataFrame, enums: DataFrame, reserved: DataFrame) -> DataFrame:
    """Descriptor tables to one row per schema. ``messages``: (schema_id, message); the others as in
    the data model. A group is one schema document."""
    path = lambda owner: F.concat(owner, F.lit("/"), F.col("number").cast("string")).alias("path")
    by_id = messages.groupBy("schema_id").agg(F.array_sort(F.collect_set("message")).alias("messages"))
    entry = F.struct(path("message"), F.struct(path("message"), "message", "number", "name", "label", "type", "map_key"))
    f = fields.groupBy("schema_id").agg(F.map_from_entries(F.collect_list(entry)).alias("fields"))
    value = F.struct(path("enum"), F.struct(path("enum"), "enum", "number", "name"))
    e = enums.groupBy("schema_id").agg(F.map_from_entries(F.collect_list(value)).alias("enums"))
    r = reserved.groupBy("schema_id").agg(F.collect_list(F.struct("message", "lo", "hi")).alias("reserved"))
    whole = by_id.join(f, "schema_id", "left").join(e, "schema_id", "left").join(r, "schema_id", "left")
    kinds = dict(f.dtypes) | dict(e.dtypes)
    empty = lambda kind: F.map_from_arrays(F.array(), F.array()).cast(kind)
    return whole.select(
        "schema_id",
        "messages",
        F.coalesce("fields", empty(kinds["fields"])).alias("fields"),
        F.coalesce("enums", empty(kinds["enums"])).alias("enums"),
        F.coalesce("reserved", F.array().cast(dict(r.dtypes)["reserved"])).alias("reserved"),
    )


def diff_proto_pairs(pairs: DataFrame, compiled: DataFrame) -> DataFrame:
    """Distinct (prev_id, next_id, content_model) with ``findings``."""
    distinct = pairs.select("prev_id", "next_id", "content_model").distinct()
    parts = ("messages", "fields", "enums", "reserved")
    side = lambda key, tag: compiled.select(F.col("schema_id").alias(key), *[F.col(c).alias(f"{tag}_{c}") for c in parts])
    both = distinct.join(side("prev_id", "b"), "prev_id").join(side("next_id", "a"), "next_id")
    return both.select("prev_id", "next_id", "content_model", F.expr(_comparison()).cast(FINDING).alias("findings"))


def protobuf_diff(pairs: DataFrame, messages: DataFrame, fields: DataFrame, enums: DataFrame, reserved: DataFrame) -> DataFrame:
    """Every divergence as a row: (prev_id, next_id, path, kind, direction, surface)."""
    found = diff_proto_pairs(pairs.withColumn("content_model", F.lit("Open")), compile_proto(messages, fields, enums, reserved))
    return found.select("prev_id", "next_id", F.explode_outer("findings").alias("f")).where("f is not null").select(
        "prev_id", "next_id", "f.path", "f.kind", "f.direction", "f.surface"
    )

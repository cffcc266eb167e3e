"""Avro schema resolution: can data written under one schema be read under another?

A schema is a table of its types. Every pair, in both directions, is walked one level per step, all
pairs together: a step is in-row array work on the pair's open type pairs, and pairs that are done
take no further part. Each pair of named records is entered once, at the place where reading the
schema from top to bottom meets it first.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from ..wire import SOURCE, WIRE, WIRE_JSON
from .canonical import AVRO_PRIMITIVES
from .json_diff import FINDING

TYPES = (
    "schema_id string, id int, kind string, name string, aliases array<string>, symbols array<string>, "
    "has_default boolean, size long, branches array<int>, fields array<struct<name:string,aliases:array<string>,type:int,has_default:boolean>>"
)
# What a reader may widen a written primitive to.
PROMOTIONS = {
    "int": ("long", "float", "double"),
    "long": ("float", "double"),
    "float": ("double",),
    "string": ("bytes",),
    "bytes": ("string",),
}
LEVELS_PER_STEP = 4


def type_rows(canonical: str) -> list[dict]:
    """The types of one canonical document. Type 0 is the root; a name resolves to its definition, and
    a name the document does not define is a type of kind ``ref``."""
    rows: list[dict] = []
    defined: dict[str, int] = {}
    uses: list[tuple[int, str]] = []

    def add(node) -> int:
        row = {"id": len(rows), "kind": "union" if isinstance(node, list) else node if isinstance(node, str) else node["type"]}
        rows.append(row)
        if isinstance(node, list):
            row["branches"] = [add(b) for b in node]
        elif isinstance(node, str):
            if node not in AVRO_PRIMITIVES:
                row.update(kind="ref", name=node)
                uses.append((row["id"], node))
        else:
            if "name" in node:
                row.update(name=node["name"], aliases=node.get("aliases", []))
                defined[node["name"]] = row["id"]
            row.update(symbols=node.get("symbols"), has_default="default" in node, size=node.get("size"))
            inner = node.get("items", node.get("values"))
            if inner is not None:
                row["branches"] = [add(inner)]
            row["fields"] = [
                {"name": f["name"], "aliases": f.get("aliases", []), "type": add(f["type"]), "has_default": "default" in f}
                for f in node.get("fields", [])
            ]
        return row["id"]

    add(json.loads(canonical))
    known = {i: defined[n] for i, n in uses if n in defined}
    for row in rows:
        row["branches"] = [known.get(b, b) for b in row.get("branches") or []]
        for f in row.get("fields") or []:
            f["type"] = known.get(f["type"], f["type"])
    return [r for r in rows if r["id"] not in known]


def avro_types(schemas: DataFrame) -> DataFrame:
    """(schema_id, canonical) of Avro documents to one row per type. Works per catalog document."""
    names = [f.split()[0] for f in TYPES.split(", ")]
    schema = pa.schema(
        [("schema_id", pa.string()), ("id", pa.int32()), ("kind", pa.string()), ("name", pa.string()),
         ("aliases", pa.list_(pa.string())), ("symbols", pa.list_(pa.string())), ("has_default", pa.bool_()),
         ("size", pa.int64()), ("branches", pa.list_(pa.int32())),
         ("fields", pa.list_(pa.struct([("name", pa.string()), ("aliases", pa.list_(pa.string())), ("type", pa.int32()), ("has_default", pa.bool_())])))]
    )

    def flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [
                {**dict.fromkeys(names), **row, "schema_id": sid}
                for sid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                for row in type_rows(text)
            ]
            yield pa.RecordBatch.from_pylist(made, schema=schema)

    return schemas.select("schema_id", "canonical").mapInArrow(flatten, TYPES)


def compile_avro(types: DataFrame) -> DataFrame:
    """Type rows to one row per schema: ``types`` maps a type id to its description."""
    row = F.struct(*[c for c in types.columns if c not in ("schema_id", "id")])
    return types.groupBy("schema_id").agg(F.map_from_entries(F.collect_list(F.struct("id", row))).alias("types"))


_PROMOTES = " or ".join(
    f"({{w}}.kind = '{a}' and {{r}}.kind in ({', '.join(repr(b) for b in to)}))" for a, to in PROMOTIONS.items()
)
_PRIMITIVE = "{0}.kind in (" + ", ".join(f"'{p}'" for p in AVRO_PRIMITIVES) + ")"
_NAMES = "({w}.name = {r}.name or array_contains({r}.aliases, {w}.name))"
_FITS = (
    "case when {w}.kind = {r}.kind then {w}.kind not in ('record', 'enum', 'fixed', 'ref') or "
    "({w}.kind <> 'ref' and " + _NAMES + ") else (" + _PROMOTES + ") end"
)


def _found(kind: str, surface: int, path: str = "p.path") -> str:
    return (
        f"array(named_struct('at', p.visit, 'path', {path}, 'kind', {kind}, 'direction', direction, 'surface', {surface}))"
    )


def _turn(backward: str, forward: str) -> str:
    return f"case direction when 'Backward' then '{backward}' else '{forward}' end"


def _open(w: str, r: str, path: str, order: str, visit: str = "p.visit") -> str:
    return f"named_struct('w', {w}, 'r', {r}, 'path', {path}, 'ord', concat(p.ord, array({order})), 'visit', {visit})"


_MISMATCH = _found(_turn("type_narrowed", "type_widened"), WIRE)
_RENAMED = _found("'name_changed'", WIRE)
_UNKNOWN = "size(array_except(p.wt.symbols, p.rt.symbols)) > 0"
_PARTNER = (
    "coalesce(get(filter(p.wt.fields, g -> g.name = f.name), 0), "
    "get(filter(p.wt.fields, g -> array_contains(f.aliases, g.name)), 0))"
)


def _fmt(text: str, w: str, r: str) -> str:
    return text.format(w=w, r=r)


def _level(df: DataFrame) -> DataFrame:
    """One step of every open pair: what it reports, and the type pairs it opens."""
    both = df.withColumn(
        "_p",
        F.expr("transform(open, p -> named_struct('path', p.path, 'ord', p.ord, 'visit', p.visit, 'w', p.w, 'r', p.r, 'wt', writer[p.w], 'rt', reader[p.r]))"),
    )
    enters = f"p.wt.kind = 'record' and p.rt.kind = 'record' and {_fmt(_NAMES, 'p.wt', 'p.rt')}"
    key = "concat(p.wt.name, '>', p.rt.name)"
    both = both.withColumn(
        "visits", F.expr(f"concat(visits, transform(filter(_p, p -> {enters}), p -> named_struct('key', {key}, 'ord', p.ord)))")
    )
    first = f"p.ord = array_min(transform(filter(visits, v -> v.key = {key}), v -> v.ord))"
    here = f"named_struct('key', {key}, 'ord', p.ord)"
    branch = "filter(p.rt.branches, b -> " + _fmt(_FITS, "p.wt", "reader[b]") + ")"
    no_field = (
        f"flatten(transform(filter(p.rt.fields, f -> {_PARTNER} is null and not f.has_default), f -> "
        + _found(_turn("required_field_added", "required_field_removed"), WIRE, "concat(p.path, '/fields/', f.name)").replace("p.visit", here)
        + "))"
    )
    report = (
        "case when p.wt.kind = 'union' then null "
        f"when p.rt.kind = 'union' then case when size({branch}) = 0 then {_MISMATCH} end "
        f"when {_PRIMITIVE.format('p.wt')} and {_PRIMITIVE.format('p.rt')} then case when p.wt.kind = p.rt.kind then null "
        f"when {_fmt(_PROMOTES, 'p.wt', 'p.rt')} then {_found(repr('type_promoted'), SOURCE)} else {_MISMATCH} end "
        "when p.wt.kind <> p.rt.kind or p.wt.kind = 'ref' then " + _MISMATCH + " "
        f"when p.wt.kind in ('record', 'enum', 'fixed') and not {_fmt(_NAMES, 'p.wt', 'p.rt')} then {_RENAMED} "
        f"when p.wt.kind = 'record' then case when {first} then {no_field} end "
        f"when p.wt.kind = 'enum' then case when not {_UNKNOWN} then null when p.rt.has_default then {_found(repr('enum_value_defaulted'), WIRE_JSON)} "
        f"else {_found(_turn('enum_value_removed', 'enum_value_added'), WIRE)} end "
        f"when p.wt.kind = 'fixed' and p.wt.size <> p.rt.size then {_found(repr('fixed_size_changed'), WIRE)} end"
    )
    partner_type = f"{_PARTNER}.type"
    opens = (
        f"case when p.wt.kind = 'union' then transform(p.wt.branches, (b, i) -> {_open('b', 'p.r', 'p.path', 'i')}) "
        f"when p.rt.kind = 'union' then case when size({branch}) > 0 then array({_open('p.w', 'get(' + branch + ', 0)', 'p.path', '0')}) end "
        f"when p.wt.kind in ('array', 'map') and p.wt.kind = p.rt.kind then array({_open('get(p.wt.branches, 0)', 'get(p.rt.branches, 0)', 'concat(p.path, case p.wt.kind when ' + repr('array') + ' then ' + repr('/items') + ' else ' + repr('/values') + ' end)', '0')}) "
        f"when {enters} and {first} then flatten(transform(p.rt.fields, (f, i) -> case when {_PARTNER} is null then array() "
        f"else array({_open(partner_type, 'f.type', 'concat(p.path, ' + repr('/fields/') + ', f.name)', 'i', here)}) end)) end"
    )
    out = both.withColumn("found", F.expr(f"concat(found, flatten(array_compact(transform(_p, p -> {report}))))"))
    return out.withColumn("open", F.expr(f"flatten(array_compact(transform(_p, p -> {opens})))")).drop("_p")


def diff_avro_pairs(pairs: DataFrame, compiled: DataFrame) -> DataFrame:
    """Distinct (prev_id, next_id, content_model) with ``findings`` of both directions."""
    distinct = pairs.select("prev_id", "next_id", "content_model").distinct()
    side = lambda key, name: compiled.select(F.col("schema_id").alias(key), F.col("types").alias(name))
    both = distinct.join(side("prev_id", "before"), "prev_id").join(side("next_id", "after"), "next_id")
    visit = "struct<key:string,ord:array<int>>"
    start = both.select(
        "prev_id", "next_id", "content_model", F.explode(F.array(F.lit("Backward"), F.lit("Forward"))).alias("direction"), "before", "after"
    ).select(
        "prev_id", "next_id", "content_model", "direction",
        F.when(F.col("direction") == "Backward", F.col("before")).otherwise(F.col("after")).alias("writer"),
        F.when(F.col("direction") == "Backward", F.col("after")).otherwise(F.col("before")).alias("reader"),
        F.expr(f"array(named_struct('w', 0, 'r', 0, 'path', '#', 'ord', array(0), 'visit', cast(null as {visit})))").alias("open"),
        F.expr(f"cast(array() as array<{visit}>)").alias("visits"),
        F.expr(f"cast(array() as array<struct<at:{visit},path:string,kind:string,direction:string,surface:int>>)").alias("found"),
    )
    done, walk = None, start
    while True:
        for _ in range(LEVELS_PER_STEP):
            walk = _level(walk)
        walk = materialize(walk, "avro-walk")
        finished = walk.where("size(open) = 0").select("prev_id", "next_id", "content_model", "visits", "found")
        done = finished if done is None else done.unionByName(finished)
        walk = walk.where("size(open) > 0")
        if walk.isEmpty():
            break
    # Reports from an entry that a later step found not to be the first one are dropped.
    real = (
        "filter(found, f -> f.at is null or f.at.ord = array_min(transform(filter(visits, v -> v.key = f.at.key), v -> v.ord)))"
    )
    finding = f"transform({real}, f -> named_struct('path', f.path, 'kind', f.kind, 'direction', f.direction, 'surface', f.surface, 'member', cast(null as string)))"
    kept = done.select("prev_id", "next_id", "content_model", F.expr(finding).cast(FINDING).alias("findings"))
    # Two rows per pair: one direction each.
    return kept.groupBy("prev_id", "next_id", "content_model").agg(F.flatten(F.collect_list("findings")).alias("findings"))


def avro_diff(pairs: DataFrame, types: DataFrame) -> DataFrame:
    """Every divergence as a row: (prev_id, next_id, path, kind, direction, surface)."""
    found = diff_avro_pairs(pairs.withColumn("content_model", F.lit("Open")), materialize(compile_avro(types), "avro-types"))
    return found.select("prev_id", "next_id", F.explode_outer("findings").alias("f")).where("f is not null").select(
        "prev_id", "next_id", "f.path", "f.kind", "f.direction", "f.surface"
    )

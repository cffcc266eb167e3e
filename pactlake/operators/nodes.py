"""The two shared shapes: payloads as nodes, schemas as keyword rows and compiled rules.

A payload's nodes are built inside its own row, level by level, with native array functions. No
shuffle is needed to flatten a message or to judge it, whatever its size or how often it recurs.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: deepest nesting a JSON reader accepts.
MAX_DEPTH = 64

_NODE = (
    "named_struct('inst', {inst}, 'path', {path}, 'up', {up}, 'name', {name}, 'v', {v}, "
    "'m', try_cast({v} as map<string,variant>), 'a', try_cast({v} as array<variant>))"
)
_ESCAPE = "replace(replace({0}, '~', '~0'), '/', '~1')"
_MEMBER = _NODE.format(
    inst=f"concat(n.inst, '/', {_ESCAPE.format('e.key')})",
    path=f"concat(n.path, '/properties/', {_ESCAPE.format('e.key')})",
    up="n.path",
    name="e.key",
    v="e.value",
)
_ELEMENT = _NODE.format(
    inst="concat(n.inst, '/', i)", path="concat(n.path, '/items')", up="n.path", name="cast(null as string)", v="x"
)
_CHILDREN = (
    f"case when n.m is not null then transform(map_entries(n.m), e -> {_MEMBER}) "
    f"when n.a is not null then transform(n.a, (x, i) -> {_ELEMENT}) end"
)


def json_depth(text: Column) -> Column:
    """Deepest bracket nesting outside string literals."""
    bare = F.regexp_replace(text, r'(?s)"(?:[^"\\]|\\.)*+"', "")
    brackets = F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), "")
    step = lambda b: F.when(b.isin("[", "{"), 1).when(b.isin("]", "}"), -1).otherwise(0)
    state = F.aggregate(
        brackets,
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("deepest")),
        lambda s, b: F.struct(
            (s["now"] + step(b)).alias("now"), F.greatest(s["deepest"], s["now"] + step(b)).alias("deepest")
        ),
    )
    return state["deepest"]


def canonical_value(v: str) -> str:
    """Text that is equal for two variants exactly when they are the same JSON value.

    Numbers compare by value. A number with an exponent inside a container keeps its own spelling.
    """
    number = f"try_cast({v} as decimal(38,18))"
    return (
        f"case when try_cast({v} as map<string,variant>) is not null or try_cast({v} as array<variant>) is not null "
        f"then concat('c', to_json({v})) "
        f"else case schema_of_variant({v}) when 'STRING' then concat('s', cast({v} as string)) "
        f"when 'BOOLEAN' then concat('b', cast({v} as string)) when 'VOID' then 'z' "
        f"else coalesce(concat('n', regexp_replace(cast({number} as string), '[.]?0+$', '')), "
        f"concat('d', cast(cast({v} as double) as string))) end end"
    )


def with_nodes(df: DataFrame, document: str, depth: int) -> DataFrame:
    """Add ``nodes``: every node of the JSON text in column ``document``, down to ``depth`` levels.

    A node is (inst, path, up, name, v, m, a): where it is, its value, and its members or elements.
    The list is null when the text is not JSON. Values are variants; drop them before any shuffle.
    """
    keep = df.columns
    nothing = "cast(null as string)"
    root = _NODE.format(inst="'#'", path="'#'", up=nothing, name=nothing, v="_v")
    out = df.withColumn("_v", F.try_parse_json(F.col(document)))
    out = out.withColumn("_l0", F.expr(f"case when _v is not null then array({root}) end"))
    levels = ["_l0"]
    for i in range(depth):
        out = out.withColumn(
            f"_l{i + 1}",
            F.expr(
                f"flatten(filter(transform(_l{i}, n -> {_CHILDREN}), c -> c is not null))"
            ),
        )
        levels.append(f"_l{i + 1}")
    out = out.withColumn("nodes", F.concat(*levels))
    return out.select(*keep, "nodes")


# Type of a node: object, array, or the name of its scalar variant type.
TYPE = "case when n.m is not null then 'object' when n.a is not null then 'array' else schema_of_variant(n.v) end"
# Kind of a node, given its type ``t``.
KIND = (
    "case t when 'object' then t when 'array' then t when 'STRING' then 'string' when 'BOOLEAN' then 'boolean' "
    "when 'VOID' then 'null' else 'number' end"
)


def documents_depth(df: DataFrame, document: str) -> int:
    """Deepest nesting in the data, one aggregate over one column."""
    depth = json_depth(F.col(document))
    row = df.agg(F.max(F.when(depth <= MAX_DEPTH, depth)).alias("d")).first()
    return int(row["d"] or 0)


def payload_nodes(df: DataFrame, document: str, keys: list[str], depth: int | None = None) -> DataFrame:
    """One row per node: ``keys`` + (inst_path, schema_path, parent_path, name, kind, int64, num, str, n_children)."""
    if depth is None:
        depth = documents_depth(df, document)
    flat = with_nodes(df.select(*keys, document), document, depth)
    rows = flat.select(*keys, F.explode_outer("nodes").alias("n")).where("n is not null")
    typed = rows.withColumn("t", F.expr(TYPE)).withColumn("kind", F.expr(KIND))
    kind, value = F.col("kind"), F.col("n.v")
    return typed.select(
        *keys,
        F.col("n.inst").alias("inst_path"),
        F.col("n.path").alias("schema_path"),
        F.col("n.up").alias("parent_path"),
        F.col("n.name").alias("name"),
        "kind",
        (F.col("t") == "BIGINT").alias("int64"),
        F.when(kind == "number", value.try_cast("decimal(38,18)")).alias("num"),
        F.when(kind.isin("string", "boolean"), value.cast("string")).alias("str"),
        F.when(kind == "object", F.size("n.m")).when(kind == "array", F.size("n.a")).alias("n_children"),
    )


# --- schemas ------------------------------------------------------------------------------------

SCHEMA_NODES = (
    "schema_id string, path string, keyword string, kind string, raw string, items array<string>, "
    "at_schema boolean"
)


class _Number(float):
    """A number that remembers how it was written."""

    def __new__(cls, text: str):
        self = super().__new__(cls, text)
        self.text = text
        return self

    def __repr__(self):
        return self.text


def parse_raw(body: str):
    return json.loads(body, parse_int=_Number, parse_float=_Number)


def dump_raw(value) -> str:
    """Compact JSON text with numbers spelled as they came."""
    if isinstance(value, _Number):
        return value.text
    if isinstance(value, dict):
        return "{" + ",".join(dump_raw(k) + ":" + dump_raw(x) for k, x in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(dump_raw, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def escape_pointer(token: str) -> str:
    return token.replace("~", "~0").replace("/", "~1")


def _kind(value) -> str:
    for kind, types in (("object", dict), ("array", list), ("string", str), ("number", _Number)):
        if isinstance(value, types):
            return kind
    return "null" if value is None else str(value).lower()


def _compiles(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except (re.error, OverflowError, RecursionError):
        return False
    return True


def keyword_rows(body: str) -> Iterator[tuple]:
    """(path, keyword, kind, raw, items, at_schema) for every member at every depth.

    ``at_schema`` marks the members of schemas reached from the root only through ``properties``
    and ``items``; a row with a null keyword stands for such a schema itself.
    """
    todo = [("#", parse_raw(body), True)]
    while todo:
        path, value, at_schema = todo.pop()
        if at_schema:
            yield path, None, _kind(value), None, None, True
        if isinstance(value, list):
            todo.extend((f"{path}/{i}", x, False) for i, x in enumerate(value) if isinstance(x, (dict, list)))
        if not isinstance(value, dict):
            continue
        for name, x in value.items():
            items, raw = None, None
            if not isinstance(x, (dict, list)):
                raw = x if isinstance(x, str) else dump_raw(x)
            elif name in ("const", "enum"):
                raw = dump_raw(x)
            if name == "const":
                items = [dump_raw(x)]
            elif name == "enum" and isinstance(x, list):
                items = [dump_raw(e) for e in x]
            elif name == "properties" and isinstance(x, dict):
                items = list(x)
            elif name == "pattern" and isinstance(x, str):
                items = [x] if _compiles(x) else None
            elif name in ("type", "required"):
                items = [e for e in (x if isinstance(x, list) else [x]) if isinstance(e, str)]
            elif isinstance(x, list) and not all(isinstance(e, (dict, list)) for e in x):
                raw = dump_raw(x)
            yield path, name, _kind(x), raw, items, at_schema
            below = f"{path}/{escape_pointer(name)}"
            if at_schema and name == "properties" and isinstance(x, dict):
                for key, sub in x.items():
                    inner = f"{below}/{escape_pointer(key)}"
                    yield below, key, _kind(sub), None, None, False
                    todo.append((inner, sub, True))
            elif at_schema and name == "items":
                todo.append((below, x, True))
            elif isinstance(x, (dict, list)):
                todo.append((below, x, False))


def schema_nodes(schemas: DataFrame) -> DataFrame:
    """Every member of every JSON schema document, at any depth. Works per document, on the catalog."""

    def flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells: list[list] = [[] for _ in range(7)]
            for sid, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows = list(keyword_rows(body))
                except (ValueError, RecursionError):
                    continue
                for row in rows:
                    for cell, value in zip(cells, (sid, *row)):
                        cell.append(value)
            text = pa.string()
            types = [text, text, text, text, text, pa.list_(text), pa.bool_()]
            names = [f.split()[0] for f in SCHEMA_NODES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types)], names)

    json_only = schemas.where(F.col("format") == "json").select("schema_id", "body")
    return json_only.mapInArrow(flatten, SCHEMA_NODES)


# Assertion keywords the payload check does not evaluate.
UNCHECKED = (
    "$dynamicAnchor", "$dynamicRef", "$ref", "allOf", "anyOf", "contains", "dependentRequired", "dependentSchemas",
    "else", "if", "maxContains", "minContains", "not", "oneOf", "patternProperties",
    "prefixItems", "propertyNames", "then", "unevaluatedItems", "unevaluatedProperties",
)
# Constructs that Java and other regular-expression engines do not read alike.
_UNPORTABLE = r"\(\?|(?<!\\)\{(?!\d+(,\d*)?\})|\\[^dDsSwWbBnrtf.\-\\/\[\]{}()*+?^$|]|\{,|\[[^\]]*\[|&&|\[\]|\[\^\]"

_BOUNDS = ("maximum", "exclusiveMaximum", "minimum", "exclusiveMinimum", "maxLength", "minLength", "maxItems", "minItems", "maxProperties", "minProperties", "multipleOf")

# Type of a schema's compiled rules, by path; as JSON text they keep all of it.
RULES = "map<string,struct<kind:string,types:array<string>,enum:array<string>,enum_values:array<string>," \
    "const_value:array<string>,required:array<string>,props:array<string>,additional:string,pattern:string," \
    "format:string,unique:string,run_pattern:string,unchecked:boolean," + ",".join(
        [f"{b}:decimal(38,18)" for b in _BOUNDS] + [f"{b}_double:double" for b in _BOUNDS]) + ">>"


def compile_rules(nodes: DataFrame) -> DataFrame:
    """Keyword rows to one row per schema: ``rules`` maps a schema path to that path's constraints.

    A group is one schema document, so its size is bounded by the largest document allowed.
    """
    raw, items, kind, keyword = F.col("raw"), F.col("items"), F.col("kind"), F.col("keyword")
    members = F.expr("transform(items, x -> " + canonical_value("try_parse_json(x)") + ")")
    unchecked = (
        keyword.isin(*UNCHECKED)
        | ((keyword == "additionalProperties") & ~kind.isin("true", "false"))
        | ((keyword == "items") & (kind == "array"))
        | ((keyword == "pattern") & (kind == "string") & (items.isNull() | raw.rlike(_UNPORTABLE)))
    )
    entry = F.struct(
        keyword,
        F.struct(kind, raw, items, F.when(keyword.isin("enum", "const"), members).alias("members")).alias("value"),
    )
    kw = nodes.where("at_schema").groupBy("schema_id", "path").agg(
        F.map_from_entries(F.collect_list(F.when(keyword.isNotNull(), entry))).alias("kw"),
        F.max(F.when(keyword.isNull(), kind)).alias("kind"),
        F.coalesce(F.bool_or(unchecked), F.lit(False)).alias("unchecked"),
    )

    def of(name: str, field: str, *kinds: str) -> Column:
        value = F.try_element_at("kw", F.lit(name))
        return F.when(value["kind"].isin(*kinds), value[field]) if kinds else value[field]

    per_path = kw.select(
        "schema_id",
        "path",
        "kind",
        of("type", "items").alias("types"),
        of("enum", "items", "array").alias("enum"),
        of("enum", "members", "array").alias("enum_values"),
        of("const", "members").alias("const_value"),
        of("required", "items", "array").alias("required"),
        of("properties", "items").alias("props"),
        of("additionalProperties", "raw", "true", "false").alias("additional"),
        of("pattern", "raw", "string").alias("pattern"),
        of("format", "raw", "string").alias("format"),
        of("uniqueItems", "raw", "true", "false").alias("unique"),
        F.when(~F.col("unchecked"), of("pattern", "raw", "string")).alias("run_pattern"),
        "unchecked",
        *[of(k, "raw", "number").try_cast("decimal(38,18)").alias(k) for k in _BOUNDS],
        # Bounds too large for the decimal are still bounds.
        *[of(k, "raw", "number").try_cast("double").alias(f"{k}_double") for k in _BOUNDS],
    )
    rule = F.struct(*[c for c in per_path.columns if c not in ("schema_id", "path")])
    return per_path.groupBy("schema_id").agg(
        F.map_from_entries(F.collect_list(F.struct("path", rule))).alias("rules"),
        F.max("unchecked").alias("unchecked"),
        F.max(F.size(F.expr("filter(split(path, '/'), p -> p <> '#')"))).alias("depth"),
    )

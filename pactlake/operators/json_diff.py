"""What changed between two JSON schemas: every pair of versions at once.

Both sides arrive as one row of compiled rules, so a pair is compared inside its own row; the work
is two joins on schema_id and no shuffle of schema nodes.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import pack_id, unpack_id
from ..wire import SOURCE, WIRE_JSON

FINDING = "array<struct<path:string,kind:string,direction:string,surface:int,member:string>>"
B, FWD = "Backward", "Forward"


def _one(path: str, kind: str, direction: str, surface: int, member: str = "cast(null as string)") -> str:
    return (
        f"named_struct('path', {path}, 'kind', '{kind}', 'direction', '{direction}', "
        f"'surface', {surface}, 'member', {member})"
    )


def _when(condition: str, path: str, kind: str, direction: str, surface: int = WIRE_JSON) -> str:
    return f"case when {condition} then array({_one(path, kind, direction, surface)}) end"


def _each(names: str, path: str, kind: str, direction: str, where: str = "true") -> str:
    return f"case when {where} then transform({names}, k -> {_one(path, kind, direction, WIRE_JSON, 'k')}) end"


def _names(c: str) -> str:
    return f"coalesce({c}, cast(array() as array<string>))"


def _bound(keyword: str, upper: bool) -> list[str]:
    was, now = f"b.{keyword}_double", f"a.{keyword}_double"
    less, more = ("<", ">") if upper else (">", "<")
    # As decimals where both fit, else as doubles.
    held = lambda sign: f"coalesce(a.{keyword} {sign} b.{keyword}, {now} {sign} {was})"
    at = f"concat(path, '/{keyword}')"
    return [
        _when(f"{now} is not null and ({was} is null or {held(less)})", at, "numeric_range_narrowed", B),
        _when(f"{was} is not null and ({now} is null or {held(more)})", at, "numeric_range_widened", FWD),
    ]


_TYPED = "size(b.types) > 0 and size(a.types) > 0"
_LOST, _GAINED = "array_except(b.types, a.types)", "array_except(a.types, b.types)"
_TO_NUMBER = f"({_LOST} = array('integer') and {_GAINED} = array('number'))"
_ENUMS = "b.enum is not null and a.enum is not null"
_KEY = "replace(replace(k, '~', '~0'), '/', '~1')"

_COMPARISONS = [
    _when(f"{_TYPED} and {_TO_NUMBER}", "path", "integer_widened_to_number", B, SOURCE),
    _when(f"{_TYPED} and not {_TO_NUMBER} and size({_LOST}) > 0", "path", "type_narrowed", B),
    _when(f"{_TYPED} and not {_TO_NUMBER} and size({_GAINED}) > 0", "path", "type_widened", FWD),
    _when(f"{_ENUMS} and size(array_except(b.enum, a.enum)) > 0", "path", "enum_value_removed", B),
    _when(f"{_ENUMS} and size(array_except(a.enum, b.enum)) > 0", "path", "enum_value_added", FWD),
    _each(f"array_except({_names('a.required')}, {_names('b.required')})", "concat(path, '/required')", "required_field_added", B),
    _each(f"array_except({_names('b.required')}, {_names('a.required')})", "concat(path, '/required')", "required_field_removed", FWD),
    *[c for k in ("maximum", "exclusiveMaximum", "maxLength", "maxItems") for c in _bound(k, True)],
    *[c for k in ("minimum", "exclusiveMinimum", "minLength", "minItems") for c in _bound(k, False)],
    _when("a.pattern is not null and not (a.pattern <=> b.pattern)", "concat(path, '/pattern')", "string_constraint_narrowed", B),
    _when("a.pattern is null and b.pattern is not null", "concat(path, '/pattern')", "string_constraint_widened", FWD),
    _when(
        "a.additional = 'false' and coalesce(b.additional, 'true') <> 'false'",
        "concat(path, '/additionalProperties')", "additional_properties_closed", B,
    ),
    _when(
        "b.additional = 'false' and coalesce(a.additional, 'true') <> 'false'",
        "concat(path, '/additionalProperties')", "additional_properties_opened", FWD,
    ),
    _when("not (a.format <=> b.format)", "concat(path, '/format')", "format_changed", B, SOURCE),
    _each(
        f"array_except({_names('a.props')}, {_names('b.props')})", f"concat(path, '/properties/', {_KEY})",
        "property_added", FWD, "content_model = 'Closed'",
    ),
    _each(
        f"array_except({_names('b.props')}, {_names('a.props')})", f"concat(path, '/properties/', {_KEY})",
        "property_removed", B, "content_model = 'Closed'",
    ),
]


def _all_paths() -> str:
    """Compare every path that both schemas have as an object and where their rules are not the same;
    ``b`` is before, ``a`` after."""
    body = re.sub(r"(?<![\w.'])([ab])\.(?=[a-z])", r"p.\1.", ", ".join(_COMPARISONS))
    body = re.sub(r"(?<![\w.'])path(?=[,)])", "p.path", body)
    shared = "array_intersect(map_keys(before), map_keys(after))"
    nodes = f"transform({shared}, k -> named_struct('path', k, 'b', before[k], 'a', after[k]))"
    objects = f"filter({nodes}, p -> p.b.kind = 'object' and p.a.kind = 'object' and not (p.b <=> p.a))"
    return f"flatten(transform({objects}, p -> flatten(filter(array({body}), f -> f is not null))))"


def diff_json_pairs(pairs: DataFrame, rules: DataFrame, unique: bool = False) -> DataFrame:
    """Distinct (prev_id, next_id, content_model) with ``findings``, null where a side is unknown or no JSON schema.

    ``unique`` tells that no pair comes twice. Ids travel packed."""
    asked = pairs.select(pack_id("prev_id").alias("prev_id"), pack_id("next_id").alias("next_id"), "content_model")
    asked = asked if unique else asked.distinct()
    before = rules.select(pack_id("schema_id").alias("prev_id"), F.col("rules").alias("before"))
    after = rules.select(pack_id("schema_id").alias("next_id"), F.col("rules").alias("after"))
    both = asked.join(before, "prev_id", "left").join(after, "next_id", "left")
    known = F.col("before").isNotNull() & F.col("after").isNotNull()
    return both.select(
        unpack_id("prev_id").alias("prev_id"), unpack_id("next_id").alias("next_id"), "content_model",
        F.when(known, F.expr(_all_paths()).cast(FINDING)).alias("findings"),
    )


def json_schema_diff(pairs: DataFrame, rules: DataFrame) -> DataFrame:
    """Every divergence as a row: (prev_id, next_id, content_model, path, kind, direction, surface, member)."""
    found = diff_json_pairs(pairs, rules)
    return found.select("prev_id", "next_id", "content_model", F.explode_outer("findings").alias("f")).where(
        "f is not null"
    ).select("prev_id", "next_id", "content_model", "f.*")

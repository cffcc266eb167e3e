"""Payload validation: every message against its own JSON Schema, inside its own row."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .checks import FINDINGS as FINDING_TYPE
from .checks import LONG_DOCUMENT, LONG_RULES, plain_findings
from .nodes import KIND, RULES, TYPE, canonical_value, compile_rules, schema_nodes, with_nodes

# Fixed value: largest payload that is checked, in bytes.
MAX_PAYLOAD_BYTES = 10 * 1024 * 1024

_WHOLE = "(t = 'BIGINT' or coalesce(num = floor(num), dbl = rint(dbl), false))"
_IS_TYPE = f"x = kind or (x = 'integer' and kind = 'number' and {_WHOLE})"
_EXPECTED = "concat(upper(substring(r.types[0], 1, 1)), substring(r.types[0], 2), 'Expected')"


def _finding(condition: str, kind: str) -> str:
    return f"case when {condition} then array(named_struct('path', n.inst, 'kind', {kind})) end"


def _at(names: str, kind: str) -> str:
    escaped = "replace(replace(k, '~', '~0'), '/', '~1')"
    return f"transform({names}, k -> named_struct('path', concat(n.inst, '/', {escaped}), 'kind', '{kind}'))"


def _held(sign: str, bound: str) -> str:
    """A number against a bound: as decimals, or as doubles where either has too many digits for that."""
    return f"coalesce(num {sign} r.{bound}, dbl {sign} r.{bound}_double)"


_NO_NAMES = "cast(array() as array<string>)"
_VALUE = canonical_value("n.v")
_COMMON = [
    _finding("r.kind = 'false'", "'ExcludedSchemaValidates'"),
    _finding(
        f"size(r.types) > 0 and not exists(r.types, x -> {_IS_TYPE})",
        f"case when size(r.types) > 1 then 'NoTypeValidates' else {_EXPECTED} end",
    ),
    _finding(f"r.enum_values is not null and not array_contains(r.enum_values, {_VALUE})", "'EnumNotMatched'"),
    _finding(f"r.const_value is not null and r.const_value[0] <> {_VALUE}", "'ConstNotMatched'"),
]
_BY_KIND = {
    "object": [
        _finding("size(n.m) > r.maxProperties", "'TooManyProperties'"),
        _finding("size(n.m) < r.minProperties", "'TooFewProperties'"),
        f"case when r.required is not null then {_at('array_except(r.required, map_keys(n.m))', 'PropertyRequired')} end",
        f"case when r.additional = 'false' then "
        f"{_at(f'array_except(map_keys(n.m), coalesce(r.props, {_NO_NAMES}))', 'NoAdditionalPropertiesAllowed')} end",
    ],
    "number": [
        _finding(f"{_held('>', 'maximum')} or {_held('>=', 'exclusiveMaximum')}", "'NumberTooBig'"),
        _finding(f"{_held('<', 'minimum')} or {_held('<=', 'exclusiveMinimum')}", "'NumberTooSmall'"),
        _finding("r.multipleOf_double > 0 and coalesce(num % r.multipleOf <> 0, dbl % r.multipleOf_double <> 0)", "'NumberNotMultipleOf'"),
    ],
    "string": [
        _finding("char_length(str) > r.maxLength", "'StringTooLong'"),
        _finding("char_length(str) < r.minLength", "'StringTooShort'"),
        _finding("r.run_pattern is not null and not (str rlike concat('(?d)', r.run_pattern))", "'PatternMismatch'"),
    ],
    "array": [
        _finding("size(n.a) > r.maxItems", "'TooManyItems'"),
        _finding("size(n.a) < r.minItems", "'TooFewItems'"),
        _finding(
            f"r.unique = 'true' and size(array_distinct(transform(n.a, x -> {canonical_value('x')}))) < size(n.a)",
            "'ArrayItemNotUnique'",
        ),
    ],
}


def _on(var: str, text: str, names: str) -> str:
    """Qualify the free names of an expression with the lambda variable that carries them."""
    return re.sub(rf"(?<![\w.'])({names})(?![\w'(])", rf"{var}.\1", text)


def _checks() -> str:
    """Findings of all nodes that have a rule. Facts about a node are worked out step by step, and
    only the checks of the node's own kind are run."""
    ruled = "filter(transform(nodes, n -> named_struct('n', n, 'r', rules[n.path])), p -> p.r is not null)"
    typed = f"transform({ruled}, p -> named_struct('n', p.n, 'r', p.r, 't', {_on('p', TYPE, 'n')}))"
    kinds = f"transform({typed}, p -> named_struct('n', p.n, 'r', p.r, 't', p.t, 'kind', {_on('p', KIND, 't')}))"
    facts = (
        f"transform({kinds}, p -> named_struct('n', p.n, 'r', p.r, 't', p.t, 'kind', p.kind, "
        "'num', case when p.kind = 'number' then try_cast(p.n.v as decimal(38,18)) end, "
        "'dbl', case when p.kind = 'number' then try_cast(p.n.v as double) end, "
        "'str', case when p.kind = 'string' then cast(p.n.v as string) end))"
    )
    own = " ".join(f"when '{k}' then flatten(array_compact(array({', '.join(c)})))" for k, c in _BY_KIND.items())
    every = f"flatten(array_compact(array({', '.join(_COMMON)}, case kind {own} end)))"
    found = f"flatten(transform({facts}, p -> {_on('p', every, 'n|r|t|kind|num|dbl|str')}))"
    # The text of the rules is read once a row.
    return f"transform(array(from_json(rules, '{RULES}')), rules -> {found})[0]"


FINDINGS = _checks()


def rules_of(schemas: DataFrame) -> DataFrame:
    """Compiled rules of a schema catalog (schema_id, format, body)."""
    compiled = compile_rules(schema_nodes(schemas))
    return schemas.select("schema_id", "format").distinct().join(compiled, "schema_id", "left")


def rules_depth(rules: DataFrame) -> int:
    return int(rules.agg(F.max("depth").alias("d")).first()["d"] or 0)


def packed(rules: DataFrame) -> DataFrame:
    """Compiled rules as rows carry them: with ``rules`` as one JSON text."""
    return rules.withColumn("rules", F.to_json("rules"))


def judge(messages: DataFrame, depth: int, body: str = "body") -> DataFrame:
    """Judge rows that already carry ``known``, ``format``, ``rules`` (:func:`packed`) and ``unchecked`` of their schema.

    Adds ``findings`` and ``verdict`` (valid, invalid, unsupported_keyword, or null when the schema is
    not known). Plain payloads are checked by :func:`checks.plain_findings`; nodes of the others are built, but
    never deeper than any rule, since no rule can speak about them.
    """
    keep = [c for c in messages.columns if c not in ("rules", "unchecked", "depth")]
    text = F.try_validate_utf8(F.col(body).cast("string"))
    fits = F.octet_length(F.col(body)) <= MAX_PAYLOAD_BYTES
    is_json = F.coalesce(F.col("format") == "json", F.lit(False))
    plain = F.col("known").isNotNull() & (F.octet_length(F.col(body)) <= LONG_DOCUMENT)
    plain &= F.coalesce(F.octet_length("rules") <= LONG_RULES, F.lit(True))
    seen = messages.withColumn("_text", F.when(is_json & fits, text))
    seen = seen.withColumn("_plain", plain_findings(F.when(plain & (F.trim("_text") != ""), F.col("_text")), F.col("rules")))
    flat = with_nodes(seen.withColumn("_text", F.when(F.col("_plain").isNull(), F.col("_text"))), "_text", depth)
    whole = lambda kind: F.array(F.struct(F.lit("#").alias("path"), F.lit(kind).alias("kind")))
    found = (
        F.when(F.col("known").isNull(), F.array().cast(FINDING_TYPE))
        .when(~is_json, F.array().cast(FINDING_TYPE))
        .when(text.isNull(), whole("invalid_utf8"))
        .when(F.trim(text) == "", whole("empty"))
        .when(~fits, whole("payload_too_large"))
        .when(F.col("_plain").isNotNull(), F.col("_plain"))
        .when(F.col("nodes").isNull(), whole("malformed_json"))
        .otherwise(F.expr(FINDINGS))
    )
    verdict = (
        F.when(F.col("known").isNull(), None)
        .when(F.size("findings") > 0, "invalid")
        .when(is_json & F.col("unchecked"), "unsupported_keyword")
        .otherwise("valid")
    )
    return flat.withColumn("findings", found).withColumn("verdict", verdict).select(*keep, "findings", "verdict")


def check_payloads(messages: DataFrame, rules: DataFrame, depth: int, body: str = "body") -> DataFrame:
    """Join messages to the rules of their ``schema_id`` and judge them; the only join there is."""
    joined = messages.join(packed(rules).withColumn("known", F.lit(True)), "schema_id", "left")
    return judge(joined, depth, body).drop("known")


def validate_payloads(messages: DataFrame, schemas: DataFrame, key: str = "message_id") -> DataFrame:
    """Findings of all messages: (key, schema_id, path, kind), one row per violated rule."""
    rules = materialize(rules_of(schemas), "rules")
    judged = check_payloads(messages.select(key, "schema_id", "body"), rules, rules_depth(rules))
    return judged.select(key, "schema_id", F.explode_outer("findings").alias("f")).where("f is not null").select(
        key, "schema_id", "f.path", "f.kind"
    )


def violation_hotspots(findings: DataFrame, by: list[str], key: str = "message_id", top: int | None = None) -> DataFrame:
    """Messages per (by, path, kind). Array positions are folded so that one rule is one row."""
    folded = findings.withColumn("path", F.regexp_replace("path", r"/[0-9]+(?=/|\z)", "/*"))
    once = folded.groupBy(*by, "path", "kind", key).agg(F.count("*").alias("n"))
    out = once.groupBy(*by, "path", "kind").agg(
        F.count("*").alias("messages"), F.sum("n").alias("findings")
    )
    return out.orderBy(F.desc("messages"), *by, "path", "kind").limit(top) if top else out

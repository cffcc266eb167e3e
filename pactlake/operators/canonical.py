"""Canonical text of a schema document: the small text kernel behind the catalog audit.

It is applied to distinct bodies only, in Arrow batches.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import schema_id
from ..session import materialize
from ..wire import Wire
from .nodes import _Number

# Fixed value: largest schema body, in UTF-8 bytes.
MAX_BODY_BYTES = 512 * 1024

_SHORT = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
_HIDDEN = {"Cc", "Cn", "Co", "Cs", "Zl", "Zp", "Zs"}
_PORTS = {"http": 80, "https": 443, "ftp": 21, "ws": 80, "wss": 443}


def _escape_char(ch: str) -> str:
    if ch in _SHORT:
        return _SHORT[ch]
    if ch == " " or (ord(ch) < 0x10000 and unicodedata.category(ch) not in _HIDDEN):
        return ch
    units = ch.encode("utf-16-be", "surrogatepass")
    return "".join(f"\\u{units[i]:02X}{units[i + 1]:02X}" for i in range(0, len(units), 2))


def quote_json(text: str) -> str:
    return '"' + "".join(map(_escape_char, text)) + '"'


def _ordinal(name: str) -> bytes:
    """Sort key: UTF-16 code units."""
    return name.encode("utf-16-be", "surrogatepass")


def normal_uri(value: str) -> str:
    """An absolute URI with scheme and host in lower case, no default port and no dot segments."""
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", value):
        return value
    try:
        u = urlsplit(value)
        port = u.port
    except ValueError:
        return value
    if not u.netloc:
        return value if "//" not in value else value
    path: list[str] = []
    for part in u.path.split("/")[1:]:
        if part == "..":
            path = path[:-1]
        elif part != ".":
            path.append(part)
    if u.path.endswith(("/.", "/..")):
        path.append("")
    host = (u.hostname or "").lower()
    if port and port != _PORTS.get(u.scheme.lower()):
        host += f":{port}"
    if "@" in u.netloc:
        host = u.netloc.rsplit("@", 1)[0] + "@" + host
    safe = "/%:@!$&'()*+,;=~-._[]"
    tail = ("?" + quote(u.query, safe + "?") if u.query else "") + ("#" + quote(u.fragment, safe + "?") if u.fragment else "")
    return f"{u.scheme.lower()}://{host}/{quote('/'.join(path), safe)}{tail}"


class Malformed(ValueError):
    """The document is not a schema of its format."""


def _unique(pairs: list[tuple]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise Malformed("duplicate key")
    return out


def _no_constant(name: str):
    raise Malformed(name)


def load_strict(body: str):
    return json.loads(
        body, parse_int=_Number, parse_float=_Number, object_pairs_hook=_unique, parse_constant=_no_constant
    )


def write_sorted(value, uris: bool, key: str | None = None) -> str:
    """Compact text with sorted keys and numbers as written."""
    if isinstance(value, dict):
        cells = (quote_json(k) + ":" + write_sorted(value[k], uris, k) for k in sorted(value, key=_ordinal))
        return "{" + ",".join(cells) + "}"
    if isinstance(value, list):
        return "[" + ",".join(write_sorted(x, uris) for x in value) + "]"
    if isinstance(value, str):
        return quote_json(normal_uri(value) if uris and key in ("$id", "$ref") else value)
    return value.text if isinstance(value, _Number) else json.dumps(value)


# Avro primitive names, and what each complex type must carry, in writing order.
AVRO_PRIMITIVES = ("null", "boolean", "int", "long", "float", "double", "bytes", "string")
AVRO_BODY = {"record": "fields", "enum": "symbols", "fixed": "size", "array": "items", "map": "values"}


def full_name(name: str, namespace: str | None) -> str:
    return name if "." in name or not namespace else f"{namespace}.{name}"


def _need(ok: bool, why: str) -> None:
    if not ok:
        raise Malformed(why)


def write_avro(node, space: str | None = None) -> str:
    """Canonical Avro text: full names, structural members first, every other attribute kept and sorted."""
    if isinstance(node, str):
        _need(node != "", "empty type name")
        return quote_json(node if node in AVRO_PRIMITIVES else full_name(node, space))
    if isinstance(node, list):
        return "[" + ",".join(write_avro(b, space) for b in node) + "]"
    _need(isinstance(node, dict) and isinstance(node.get("type"), str), "a schema needs a type")
    kind = "record" if node["type"] == "error" else node["type"]
    parts: list[str] = []
    taken = {"type"}
    if kind in ("record", "enum", "fixed"):
        _need(isinstance(node.get("name"), str) and node["name"] != "", "a named type needs a name")
        _need(isinstance(node.get("namespace", ""), str), "namespace must be text")
        name = full_name(node["name"], node.get("namespace", space))
        space = name.rpartition(".")[0] or None
        parts.append('"name":' + quote_json(name))
        taken |= {"name", "namespace"}
    elif kind in AVRO_PRIMITIVES and not set(node) - taken:
        return quote_json(kind)
    else:
        _need(kind in AVRO_PRIMITIVES or kind in AVRO_BODY, "unknown type")
    parts.append('"type":' + quote_json(kind))
    body = AVRO_BODY.get(kind)
    if body:
        _need(body in node, f"missing {body}")
        parts.append(f'"{body}":' + _avro_body(kind, node[body], space))
        taken.add(body)
    named = "namespace" in taken
    parts += [
        quote_json(k) + ":" + (_aliases(node[k], space) if named and k == "aliases" else write_sorted(node[k], False))
        for k in sorted(set(node) - taken, key=_ordinal)
    ]
    return "{" + ",".join(parts) + "}"


def _aliases(value, space: str | None) -> str:
    if not isinstance(value, list):
        return write_sorted(value, False)
    _need(all(isinstance(a, str) for a in value), "an alias must be text")
    return "[" + ",".join(quote_json(full_name(a, space)) for a in value) + "]"


def _avro_body(kind: str, value, space: str | None) -> str:
    if kind in ("array", "map"):
        return write_avro(value, space)
    if kind == "fixed":
        _need(isinstance(value, _Number) and re.fullmatch(r"[0-9]+", value.text) is not None, "size")
        return str(int(value.text))
    _need(isinstance(value, list), "a list is needed")
    if kind == "enum":
        _need(all(isinstance(s, str) for s in value), "a symbol must be text")
        return "[" + ",".join(map(quote_json, value)) + "]"
    fields = []
    for f in value:
        _need(isinstance(f, dict) and isinstance(f.get("name"), str) and f["name"] != "" and "type" in f, "field")
        rest = (quote_json(k) + ":" + write_sorted(f[k], False) for k in sorted(set(f) - {"name", "type"}, key=_ordinal))
        head = ['"name":' + quote_json(f["name"]), '"type":' + write_avro(f["type"], space)]
        fields.append("{" + ",".join([*head, *rest]) + "}")
    return "[" + ",".join(fields) + "]"


def canonical_text(format: str, body: str | None) -> tuple[str | None, str | None]:
    """(canonical, error_code) of one document."""
    if body is None or not body.strip():
        return None, "schema_body_empty"
    if len(body.encode("utf-8", "surrogatepass")) > MAX_BODY_BYTES:
        return None, "schema_too_large"
    if format == "protobuf":
        return body, None
    try:
        document = load_strict(body)
        return (write_avro(document) if format == "avro" else write_sorted(document, True)), None
    except (ValueError, RecursionError):
        return None, "schema_malformed"


def canonicalize(schemas: DataFrame) -> DataFrame:
    """(format, body) to (format, body, canonical, error_code), each distinct pair once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [canonical_text(f, t) for f, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            made = [pa.array([d[i] for d in done], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made], ["format", "body", "canonical", "error_code"])

    distinct = schemas.select("format", "body").distinct()
    return distinct.mapInArrow(run, "format string, body string, canonical string, error_code string")


def catalog_canonical_audit(schemas: DataFrame, wire: Wire = Wire()) -> DataFrame:
    """Every authored document with its canonical text, content id and error code.

    ``schemas`` has (format, body) and any other columns, which are kept. Rows carry whole documents,
    so they are matched to their canonical text by digest.
    """
    digest = lambda d: F.sha2(F.concat_ws("\n", d["format"], d["body"]), 256)
    done = canonicalize(schemas)
    # Written, so that the planner knows its size before it moves all documents to it.
    done = materialize(done.select(digest(done).alias("digest"), "canonical", "error_code"), "canonical")
    none = F.array().cast("array<struct<name:string,subject:string,version:int>>")
    refs = F.col("references") if "references" in schemas.columns else none
    return schemas.withColumn("digest", digest(schemas)).join(done, "digest").select(
        *[c for c in schemas.columns if c != "schema_id"],
        "canonical",
        "error_code",
        F.when(F.col("canonical").isNotNull(), schema_id(F.col("format"), F.col("canonical"), refs, wire)).alias("schema_id"),
    )


def audit_totals(audit: DataFrame) -> DataFrame:
    """Documents per format and error code."""
    return audit.groupBy("format", "error_code").agg(F.count("*").alias("documents"))

"""Self-contained documents: everything a schema refers to, inlined under ``$defs``."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from ..wire import Wire
from .graph import closure
from .nodes import dump_raw, parse_raw


def _rewritten(value, local: dict[str, str]):
    """A copy of the document whose ``$ref`` texts are replaced by their local place."""
    if isinstance(value, list):
        return [_rewritten(x, local) for x in value]
    if not isinstance(value, dict):
        return value
    return {k: local.get(x, x) if k == "$ref" and isinstance(x, str) else _rewritten(x, local) for k, x in value.items()}


def _rewrite_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(schema_id, body, texts, places) to (schema_id, members): the document's members as JSON text."""
    for b in batches:
        ids, bodies, texts, places = (c.to_pylist() for c in b.columns)
        made = []
        for body, text, place in zip(bodies, texts, places):
            document = _rewritten(parse_raw(body), dict(zip(text or [], place or [])))
            made.append(dump_raw(document))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(made, pa.string())], ["schema_id", "text"])


def bundle_schemas(schemas: DataFrame, edges: DataFrame, wire: Wire = Wire()) -> DataFrame:
    """(schema_id, body, inlined, error_code): one bundle per JSON schema.

    ``schemas``: (schema_id, format, body); ``edges``: rows of :func:`graph.version_edges`. Each
    document is rewritten once, however many bundles it is part of; a bundle is then put together
    from the rewritten texts its closure names. A bundle with a missing target has an error code
    and no body.
    """
    edges = materialize(edges, "edges")
    place = F.concat(F.lit("#/$defs/"), F.col("subject"), F.lit("__"), F.col("version").cast("string"))
    refs = edges.groupBy(F.col("src").alias("schema_id")).agg(
        F.collect_list(F.struct("name", place.alias("place"))).alias("refs")
    )
    ready = schemas.where("format = 'json'").join(refs, "schema_id", "left").select(
        "schema_id", "body", F.col("refs.name").alias("texts"), F.col("refs.place").alias("places")
    )
    texts = materialize(ready.mapInArrow(_rewrite_documents, "schema_id string, text string"), "texts")

    known = edges.where("dst is not null").select("src", "dst").distinct()
    inside = closure(known)
    names = edges.where("dst is not null").select(
        F.col("dst").alias("node"), F.concat(F.col("subject"), F.lit("__"), F.col("version").cast("string")).alias("key")
    ).distinct()
    parts = inside.join(names, "node").join(texts.withColumnRenamed("schema_id", "node"), "node")
    defs = parts.groupBy("start").agg(F.array_sort(F.collect_list(F.struct("key", "text"))).alias("parts"))
    holes = edges.where("dst is null").select(F.col("src").alias("node"), "name")
    own = schemas.select(F.col("schema_id").alias("start"), F.col("schema_id").alias("node"))
    missing = inside.unionByName(own).join(holes, "node").groupBy("start").agg(F.min("name").alias("missing"))

    whole = (
        texts.withColumnRenamed("schema_id", "start").join(defs, "start", "left").join(missing, "start", "left")
    )
    quoted = lambda k: F.concat(F.lit('"'), k, F.lit('":'))
    listed = F.array_join(F.transform("parts", lambda p: F.concat(quoted(p["key"]), p["text"])), ",")
    opened = F.substr(F.col("text"), F.lit(1), F.length("text") - 1)
    comma = F.when(F.col("text") == "{}", "").otherwise(",")
    body = F.when(F.col("parts").isNull(), F.col("text")).otherwise(
        F.concat(opened, comma, F.lit('"$defs":{'), listed, F.lit("}}"))
    )
    return whole.select(
        F.col("start").alias("schema_id"),
        F.when(F.col("missing").isNull(), body).alias("body"),
        F.coalesce(F.size("parts"), F.lit(0)).alias("inlined"),
        F.when(F.col("missing").isNotNull(), "reference_invalid").alias("error_code"),
        "missing",
    )

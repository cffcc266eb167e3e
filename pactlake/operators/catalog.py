"""The schema catalog: ids, duplicates, usages, references, portability, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import schema_id
from ..functions.columns import json_pointer_escape, subject_valid, to_int32
from ..wire import Wire

# Keywords that validate but are not compared between versions.
NOT_COMPARED = (
    "$dynamicAnchor", "$dynamicRef", "allOf", "anyOf", "contains", "dependentRequired", "dependentSchemas", "else",
    "if", "maxContains", "minContains", "not", "oneOf", "patternProperties", "prefixItems", "propertyNames", "then",
    "unevaluatedItems", "unevaluatedProperties",
)
# The dialect that is supported, and regular-expression constructs not every engine has.
DIALECTS = ("https://json-schema.org/draft/2020-12/schema", "https://json-schema.org/draft/2020-12/schema#")
LOOKAROUND = ("(?=", "(?!", "(?<=", "(?<!")
BACKREFERENCE = (r"\1", r"\2")


def schema_ids(canonical: DataFrame, wire: Wire = Wire()) -> DataFrame:
    """Add the content-addressed ``schema_id`` to (format, canonical, references)."""
    return canonical.withColumn(
        "schema_id", schema_id(F.col("format"), F.col("canonical"), F.col("references"), wire)
    )


def dedupe_catalog(audit: DataFrame) -> DataFrame:
    """One row per id: its canonical text, documents and distinct authored spellings that lead to it.

    The canonical text is a key of the first count, since counts by hash hold no texts as values: those would
    make each task sort all its documents before it counts them.
    """
    known = audit.where("schema_id is not null")
    counted = known.groupBy("schema_id", "format", F.sha2("body", 256).alias("spelling"), "canonical").agg(F.count("*").alias("documents"))
    spelled = counted.groupBy("schema_id", "format", "spelling").agg(
        F.sum("documents").alias("documents"), F.any_value("canonical").alias("canonical")
    )
    return spelled.groupBy("schema_id", "format").agg(
        F.any_value("canonical").alias("canonical"),
        F.sum("documents").alias("documents"),
        F.count("*").alias("spellings"),
    )


def schema_usages(versions: DataFrame) -> DataFrame:
    """Where each schema is used: (schema_id, environment_id, subject, ordinal)."""
    return versions.select("schema_id", "environment_id", "subject", "ordinal").distinct()


def reachable_schemas(schemas: DataFrame, versions: DataFrame) -> DataFrame:
    """The schemas that the given versions (a tenant's, say) can reach."""
    return schemas.join(versions.select("schema_id").distinct(), "schema_id", "left_semi")


def parse_reference(text: Column, wire: Wire = Wire()) -> Column:
    """``scheme://environment/subject/ordinal`` to a struct with its normal name; null when malformed."""
    rx = rf"(?i)^\s*{wire.scheme}://([^/?#]+)/+([^/?#]+)/+([^/?#]+)/*(?:[?#].*)?\s*\z"
    env = F.lower(F.regexp_extract(text, rx, 1))
    subject = F.try_url_decode(F.replace(F.regexp_extract(text, rx, 2), F.lit("+"), F.lit("%2B")))
    version = to_int32(F.regexp_extract(text, rx, 3))
    ok = text.rlike(rx) & subject_valid(subject) & (version >= 1)
    name = F.concat(F.lit(f"{wire.scheme}://"), env, F.lit("/"), subject, F.lit("/"), version.cast("string"))
    return F.when(
        ok, F.struct(name.alias("name"), env.alias("environment"), subject.alias("subject"), version.alias("version"))
    )


def extract_references(nodes: DataFrame, wire: Wire = Wire()) -> tuple[DataFrame, DataFrame]:
    """(edges, errors) of JSON schemas: every ``$ref`` of the registry's own scheme, at any depth.

    Local and http references are not edges. A malformed own-scheme reference is an error row.
    """
    own = nodes.where(
        (F.col("keyword") == "$ref") & (F.col("kind") == "string") & F.col("raw").rlike(rf"(?i)^\s*{wire.scheme}://")
    ).withColumn("ref", parse_reference(F.col("raw"), wire))
    edges = own.where("ref is not null").select("schema_id", "ref.*").distinct()
    errors = own.where("ref is null").select(
        "schema_id", F.col("raw").alias("reference"), F.lit("reference_invalid").alias("error_code")
    ).distinct()
    return edges, errors


def unsupported_references(avro_types: DataFrame, proto_imports: DataFrame) -> DataFrame:
    """Avro names their document does not define, and Protobuf imports other than google's own.

    ``avro_types``: rows of :func:`avro_diff.avro_types`; ``proto_imports``: (schema_id, path).
    """
    avro = avro_types.where("kind = 'ref'").select("schema_id", F.col("name").alias("reference"))
    proto = proto_imports.where(~F.col("path").startswith("google/protobuf/")).select(
        "schema_id", F.col("path").alias("reference")
    )
    return avro.unionByName(proto).distinct().withColumn("error_code", F.lit("schema_references_unsupported"))


def portability_lint(nodes: DataFrame) -> DataFrame:
    """Findings per schema: (schema_id, path, kind, severity)."""
    at = F.concat(F.col("path"), F.lit("/"), json_pointer_escape("keyword"))
    text, keyword = F.col("raw"), F.col("keyword")
    has = lambda c, tokens: F.forall(F.array(*map(F.lit, tokens)), lambda t: ~F.contains(c, t))
    portable = lambda c: has(c, LOOKAROUND) & has(c, BACKREFERENCE)
    row = lambda cond, kind, severity: F.when(
        cond, F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"))
    )
    dialect = (F.col("path") == "#") & (keyword == "$schema") & (F.col("kind") == "string") & ~text.isin(*DIALECTS)
    pattern = (keyword == "pattern") & (F.col("kind") == "string") & ~portable(text)
    keyed = F.col("path").rlike(r"/patternProperties\z") & ~portable(keyword)
    found = F.array_compact(
        F.array(
            row(dialect, "dialect_unsupported", "error"),
            row(keyword.isin(*NOT_COMPARED), "keyword_not_compared", "warning"),
            row(pattern | keyed, "regex_not_portable", "warning"),
        )
    )
    return (
        nodes.where("keyword <> ''")
        .select("schema_id", at.alias("path"), F.explode_outer(found).alias("f"))
        .where("f is not null")
        .select("schema_id", "path", "f.kind", "f.severity")
    )


def contract_drift(left: DataFrame, right: DataFrame, left_nodes: DataFrame, right_nodes: DataFrame) -> DataFrame:
    """Two copies of each subject's schema: the first place where they differ.

    ``left`` and ``right`` are (subject, schema_id); the node tables describe those schemas. Key order
    does not matter, ``required`` compares as a set, numbers by value. Subjects that agree, or that
    only one side has, give no row.
    """
    both = left.select("subject", F.col("schema_id").alias("left_id")).join(
        right.select("subject", F.col("schema_id").alias("right_id")), "subject"
    ).where("left_id <> right_id")

    def side(nodes: DataFrame, key: str) -> DataFrame:
        value = (
            F.when(F.col("keyword") == "required", F.to_json(F.array_sort(F.array_distinct("items"))))
            .when(F.col("kind") == "number", F.regexp_replace(F.col("raw").try_cast("decimal(38,18)").cast("string"), r"[.]?0+\z", ""))
            .when(F.col("kind") == "array", F.coalesce(F.to_json("items"), F.col("raw")))
            .otherwise(F.col("raw"))
        )
        return nodes.where("keyword <> ''").select(
            F.col("schema_id").alias(key), "path", "keyword", F.struct("kind", value.alias("value")).alias(f"{key}_value")
        )

    pairs = both.select("left_id", "right_id").distinct()
    lefts = pairs.join(side(left_nodes, "left_id"), "left_id")
    rights = pairs.join(side(right_nodes, "right_id"), "right_id")
    place = ["left_id", "right_id", "path", "keyword"]
    joined = lefts.join(rights, place, "full_outer").where(~F.col("left_id_value").eqNullSafe(F.col("right_id_value")))
    change = (
        F.when(F.col("left_id_value").isNull(), "only_right").when(F.col("right_id_value").isNull(), "only_left").otherwise("differs")
    )
    # Depth-first order of the walk: a member sorts before everything below later members.
    at = F.concat("path", F.lit("/"), json_pointer_escape("keyword"))
    first = joined.groupBy("left_id", "right_id").agg(
        F.min(F.struct(F.split(at, "/").alias("order"), at.alias("path"), change.alias("change"))).alias("first"),
        F.count("*").alias("differences"),
    )
    return both.join(first, ["left_id", "right_id"]).select("subject", "first.path", "first.change", "differences")


def duplicate_subjects(contracts: DataFrame) -> DataFrame:
    """Subjects claimed by more than one source file: (subject, sources, first_source)."""
    return contracts.groupBy("subject").agg(
        F.count_distinct("path").alias("sources"), F.min("path").alias("first_source")
    ).where("sources > 1")

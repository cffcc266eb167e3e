"""What schema do these documents imply, and how sure is that?

All statistics merge, so a path that a third of all documents share is counted before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.columns import WHITESPACE
from ..session import materialize
from .node_counts import COUNTS, node_counts
from .nodes import MAX_DEPTH, documents_depth, json_depth, payload_nodes

# Evidence thresholds.
THIN_EVIDENCE = 10
MAX_ENUM = 12
ENUM_REPEATS = 3

_WS = WHITESPACE.strip("[]")
# String formats in the order they are tried.
FORMATS = {
    "uuid": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\n?\z",
    "date-time": r"^\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2}[Tt]\p{Nd}{2}:\p{Nd}{2}:\p{Nd}{2}(\.\p{Nd}+)?([Zz]|[+-]\p{Nd}{2}:\p{Nd}{2})\n?\z",
    "date": r"^\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2}\n?\z",
    "email": rf"^[^@{_WS}]+@[^@{_WS}.]+\.[^@{_WS}]+\n?\z",
}
HIGH, MEDIUM, LOW = 1, 2, 3


def infer_path_stats(docs: DataFrame, by: str = "subject", document: str = "body", string_cap: int | None = None) -> DataFrame:
    """One row per (by, schema_path): how often it occurs, with which kinds, and what its strings look like.

    Documents that are not JSON, or nest deeper than a reader accepts, are skipped; see :func:`skipped_documents`.
    All strings count. With ``string_cap``, a path with that many distinct strings, of more than that many,
    is marked ``truncated``, and neither a format nor an enum is inferred for it.
    """
    place = [by, "schema_path"]
    texts = materialize(_path_texts(docs, by, document), "path-texts")
    is_text = F.col("n_string") > 0
    looks = [F.bool_and(F.when(is_text, F.col("str").rlike(rx))).alias(f"is_{name}") for name, rx in FORMATS.items()]
    sums = [c for c in texts.columns if c.startswith("n_")]
    stats = texts.groupBy(*place, "parent_path", "name").agg(
        F.sum("occurrences").alias("occurrences"),
        F.max("depth").alias("depth"),
        *[F.sum(c).alias(c) for c in sums],
        F.bool_or("non_empty").alias("non_empty"),
        F.count_if(is_text).alias("distinct_strings"),
        F.bool_or(F.when(is_text, F.col("str") == "")).alias("any_empty"),
        *looks,
    )
    few = stats.where(F.col("distinct_strings").between(1, MAX_ENUM)).select(*place)
    values = texts.where(is_text).join(few, place).groupBy(*place).agg(F.array_sort(F.collect_list("str")).alias("strings"))
    whole = stats.join(values, place, "left").withColumn(
        "truncated", F.lit(False) if string_cap is None else (F.col("distinct_strings") >= string_cap) & (F.col("n_string") > string_cap)
    )
    # Drafts and findings read the statistics several times, and the texts below may be many.
    return materialize(whole, "path-stats")


def _path_texts(docs: DataFrame, by: str, document: str) -> DataFrame:
    """Nodes counted per path and, for strings, per text, in one pass over the documents. Everything else is
    read from this smaller table.

    Tasks count the nodes of plain documents where they lie; see :mod:`node_counts`. Documents that are left
    are flattened by Spark, and so are all of them where a repeated key makes a document malformed.
    """
    key = docs.schema[by].dataType
    is_text = isinstance(key, StringType)
    spark = docs.sparkSession
    place = [by, "schema_path", "parent_path", "name", "str"]
    if spark.conf.get("spark.sql.variant.allowDuplicateKeys", "false") != "true":
        return _counted(docs.select(by, F.col(document).alias("document")), by)
    # As bytes, since a text column may hold what is not UTF-8.
    given = docs.select((F.col(by).cast("binary") if is_text else F.col(by)).alias(by), F.col(document).cast("binary").alias("document"))
    parts = materialize(node_counts(given, by), "path-text-parts").withColumn(by, F.col(by).cast(key))
    left = parts.where("document is not null").select(by, F.col("document").cast("string").alias("document"))
    done = parts.where("document is null").drop("document").unionByName(_counted(left, by))
    return done.groupBy(*place).agg(
        F.max("depth").alias("depth"), *[F.sum(c).alias(c) for c in COUNTS], F.bool_or("non_empty").alias("non_empty")
    )


def _counted(docs: DataFrame, by: str) -> DataFrame:
    """The same counts of (by, document), by flattening every document."""
    text = F.col("document")
    usable = docs.select(by, F.when(json_depth(text) <= MAX_DEPTH, text).alias("document"))
    nodes = payload_nodes(usable, "document", [by], documents_depth(usable, "document")).alias("nodes")
    kind = F.col("kind")
    return nodes.groupBy(by, "schema_path", "parent_path", "name", F.when(kind == "string", F.col("str")).alias("str")).agg(
        F.count("*").alias("occurrences"),
        F.max(F.size(F.split("inst_path", "/")) - 1).alias("depth"),
        F.count_if(kind == "null").alias("n_null"),
        F.count_if((kind == "boolean") & (F.col("nodes.str") == "true")).alias("n_true"),
        F.count_if((kind == "boolean") & (F.col("nodes.str") == "false")).alias("n_false"),
        F.count_if(kind == "string").alias("n_string"),
        F.count_if(kind == "number").alias("n_number"),
        F.count_if("int64").alias("n_int64"),
        F.count_if(kind == "object").alias("n_object"),
        F.count_if(kind == "array").alias("n_array"),
        F.coalesce(F.bool_or((kind == "array") & (F.col("n_children") > 0)), F.lit(False)).alias("non_empty"),
    )


def skipped_documents(docs: DataFrame, by: str = "subject", document: str = "body") -> DataFrame:
    """(by, code, documents): what the statistics leave out, malformed_json or nested_too_deep."""
    text = F.col(document)
    code = F.when(text.isNotNull() & F.try_parse_json(text).isNull(), "malformed_json").when(json_depth(text) > MAX_DEPTH, "nested_too_deep")
    return docs.select(by, code.alias("code")).where("code is not null").groupBy(by, "code").agg(F.count("*").alias("documents"))


def detect_format() -> Column:
    """The first format every string of the path matches; none for truncated paths or empty strings."""
    found = None
    for name in FORMATS:
        found = (F if found is None else found).when(F.col(f"is_{name}"), name)
    usable = (F.col("distinct_strings") > 0) & ~F.col("truncated") & ~F.coalesce("any_empty", F.lit(True))
    return F.when(usable, found)


def detect_string_format(stats: DataFrame, by: str = "subject") -> DataFrame:
    return stats.where("n_string > 0").select(by, "schema_path", "n_string", detect_format().alias("format"))


_CONCRETE = ["n_object", "n_array", "n_string", "n_number", "n_true", "n_false"]


def _typed(stats: DataFrame, by: str) -> DataFrame:
    """Reachable paths with their one kind, format, enum flag and parent count.

    Below a path of mixed kinds nothing is inferred, so its descendants are left out.
    """
    kinds = sum((F.col(c) > 0).cast("int") for c in _CONCRETE)
    typed = stats.withColumn("n_kinds", kinds)
    parts = F.split("schema_path", "/")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")
    )
    below = typed.where("schema_path <> '#'").select(by, "schema_path", F.explode(prefixes).alias("above"))
    mixed = typed.where("n_kinds > 1").select(by, F.col("schema_path").alias("above"))
    hidden = below.join(mixed, [by, "above"]).select(by, "schema_path").distinct()
    parents = stats.select(by, F.col("schema_path").alias("parent_path"), F.col("occurrences").alias("parent_occurrences"))
    typed = typed.join(hidden, [by, "schema_path"], "left_anti").join(parents, [by, "parent_path"], "left")
    one = F.col("n_kinds") == 1
    whole = F.col("n_int64") == F.col("n_number")
    json_type = F.when(
        one,
        F.when(F.col("n_object") > 0, "object").when(F.col("n_array") > 0, "array").when(F.col("n_string") > 0, "string")
        .when((F.col("n_number") > 0) & whole, "integer").when(F.col("n_number") > 0, "number").otherwise("boolean"),
    )
    typed = typed.withColumn("json_type", json_type)
    text = F.col("json_type") == "string"
    typed = typed.withColumn("format", F.when(text, detect_format()))
    plain = text & F.col("format").isNull() & ~F.col("truncated")
    return typed.withColumn(
        "is_enum",
        F.coalesce(
            plain & F.col("distinct_strings").between(2, MAX_ENUM) & (F.col("n_string") >= THIN_EVIDENCE)
            & (F.col("n_string") >= F.col("distinct_strings") * ENUM_REPEATS),
            F.lit(False),
        ),
    ).withColumn(
        "is_constant",
        F.coalesce(plain & (F.col("distinct_strings") == 1) & (F.col("n_string") > 1), F.lit(False)),
    )


def infer_findings(stats: DataFrame, by: str = "subject") -> DataFrame:
    """(by, path, confidence, kind): what the draft schema assumes; 1 high, 2 medium, 3 low."""
    t = _typed(stats, by)
    member = F.col("name").isNotNull()
    required = member & (F.col("occurrences") == F.col("parent_occurrences"))
    always_null = F.col("n_kinds") == 0

    def enough(n: Column) -> Column:
        return F.when(n >= THIN_EVIDENCE, MEDIUM).otherwise(LOW)

    def note(condition: Column, confidence, kind: str) -> Column:
        level = confidence if isinstance(confidence, Column) else F.lit(confidence)
        return F.when(condition, F.struct(level.alias("confidence"), F.lit(kind).alias("kind")))

    notes = F.array(
        note((F.col("schema_path") == "#") & (F.col("occurrences") < THIN_EVIDENCE), LOW, "thin_evidence"),
        note(always_null, LOW, "always_null"),
        note(F.col("n_kinds") > 1, LOW, "mixed_types"),
        note((F.col("json_type") == "array") & ~F.col("non_empty"), LOW, "empty_array"),
        note(F.col("json_type") == "integer", enough(F.col("n_number")), "integer_from_whole_numbers"),
        note(
            required,
            F.when(always_null | (F.col("parent_occurrences") < THIN_EVIDENCE), LOW).otherwise(MEDIUM),
            "required_from_presence",
        ),
        note(member & (F.col("occurrences") != F.col("parent_occurrences")), HIGH, "optional_from_absence"),
        note(F.col("format").isNotNull(), enough(F.col("n_string")), "format_from_pattern"),
        note(F.col("is_constant"), MEDIUM, "constant_value"),
        note(F.col("is_enum"), LOW, "enum_from_low_cardinality"),
    )
    return t.select(by, F.col("schema_path").alias("path"), F.explode(F.array_compact(notes)).alias("f")).select(
        by, "path", "f.confidence", "f.kind"
    )


def _quoted(c: Column) -> Column:
    listed = F.to_json(F.array(c))
    return F.substr(listed, F.lit(2), F.length(listed) - 2)


def infer_schema(stats: DataFrame, by: str = "subject") -> DataFrame:
    """Stats to one draft schema per subject: (by, body, sample_count).

    Texts are put together from the deepest paths upwards, one grouping by parent per level, on the
    statistics only. A level's group is the members of one object.
    """
    kept = _typed(stats, by).select(
        by, "schema_path", "parent_path", "name", "depth", "json_type", "non_empty", "format", "is_enum", "strings",
        "occurrences", "n_null", (F.col("occurrences") == F.col("parent_occurrences")).alias("required"),
    )
    kept = materialize(kept, "typed-paths")
    deepest = int(kept.agg(F.max("depth").alias("d")).first()["d"] or 0)
    none = F.lit(None).cast("string")
    below = None
    for level in range(deepest, -1, -1):
        here = kept.where(F.col("depth") == level)
        if below is None:
            here = here.withColumn("members", none).withColumn("must", none).withColumn("items", none)
        else:
            here = here.join(below, [by, "schema_path"], "left")
        kind = F.concat(F.lit('"'), F.col("json_type"), F.lit('"'))
        parts = F.array_compact(
            F.array(
                F.concat(
                    F.lit('"type":'),
                    F.when(F.col("n_null") > 0, F.concat(F.lit("["), kind, F.lit(',"null"]'))).otherwise(kind),
                ),
                F.when(F.col("json_type") == "object", F.concat(F.lit('"properties":{'), F.col("members"), F.lit("}"))),
                F.when((F.col("json_type") == "object") & (F.col("must") != ""), F.concat(F.lit('"required":['), F.col("must"), F.lit("]"))),
                F.when((F.col("json_type") == "array") & F.col("non_empty"), F.concat(F.lit('"items":'), F.col("items"))),
                F.when(F.col("format").isNotNull(), F.concat(F.lit('"format":'), _quoted(F.col("format")))),
                F.when(F.col("is_enum"), F.concat(F.lit('"enum":'), F.to_json("strings"))),
            )
        )
        text = F.concat(
            F.lit("{"), F.when(F.col("json_type").isNull(), "").otherwise(F.array_join(parts, ",")), F.lit("}")
        )
        done = here.withColumn("text", text)
        if level == 0:
            return done.select(by, F.col("text").alias("body"), F.col("occurrences").alias("sample_count"))
        entry = F.struct("name", "text", "required")
        grouped = done.groupBy(by, "parent_path").agg(
            F.array_sort(F.collect_list(F.when(F.col("name").isNotNull(), entry))).alias("entries"),
            F.max(F.when(F.col("name").isNull(), F.col("text"))).alias("items"),
        )
        below = grouped.select(
            by,
            F.col("parent_path").alias("schema_path"),
            F.when(
                F.size("entries") > 0,
                F.array_join(F.transform("entries", lambda e: F.concat(_quoted(e["name"]), F.lit(":"), e["text"])), ","),
            ).alias("members"),
            F.array_join(
                F.transform(F.filter("entries", lambda e: e["required"]), lambda e: _quoted(e["name"])), ","
            ).alias("must"),
            "items",
        )

"""Reading and writing the identity a message carries, and finding the subject it is about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import (
    SCHEMA_ID_PATTERN,
    blank,
    generic_subject,
    is_generic_type,
    normalize_subject,
    semver_valid,
    strip,
    subject_valid,
    to_int32,
)
from ..session import materialize
from ..wire import ENVELOPE_VERSION, MEDIA_TYPES, Wire

_BOM = "﻿"


def _value(name: Column) -> Column:
    """State and text of one header: absent, present, wrong_type, bad_encoding or empty."""
    entry = F.try_element_at("headers", name)
    data = entry["bytes"]
    readable = F.coalesce(entry["kind"].isin("string", "bytes"), F.lit(False))
    text = F.try_validate_utf8(data.cast("string"))
    state = (
        F.when(entry.isNull() | (readable & data.isNull()), "absent")
        .when(~readable, "wrong_type")
        .when(F.octet_length(data) == 0, "empty")
        .when(text.isNull() | F.startswith(text, F.lit(_BOM)), "bad_encoding")
        .otherwise("present")
    )
    return F.struct(state.alias("state"), text.alias("text"))


def _unreadable(state: Column) -> Column:
    return (
        F.when(state == "wrong_type", "envelope_header_type_invalid")
        .when(state == "bad_encoding", "envelope_header_encoding_invalid")
        .when(state == "empty", "envelope_malformed")
    )


def _padded(c: Column) -> Column:
    return strip(c) != c


def decode_envelopes(messages: DataFrame, wire: Wire = Wire()) -> DataFrame:
    """Headers and content type to (kind, schema_id, subject, ordinal, semver, format, warnings, error_code).

    The header form is read first; only when it is absent does the content-type form count. Header
    names are matched exactly, values are never trimmed.
    """
    names = [wire.version, wire.schema_id, wire.subject, wire.ordinal, wire.semver, wire.format]
    df = messages.withColumn("_h", F.transform(F.array(*map(F.lit, names)), _value))
    state = {k: F.coalesce(F.col("_h")[i]["state"], F.lit("absent")) for i, k in enumerate("visomf")}
    text = {k: F.col("_h")[i]["text"] for i, k in enumerate("visomf")}
    present = {k: s == "present" for k, s in state.items()}

    in_headers = state["v"] != "absent"
    error = F.when(
        in_headers,
        F.when(~present["v"], _unreadable(state["v"]))
        .when(text["v"] != ENVELOPE_VERSION, "envelope_version_unsupported")
        .when(state["i"] == "absent", "envelope_schema_id_missing")
        .when(~present["i"], _unreadable(state["i"]))
        .when(~text["i"].rlike(SCHEMA_ID_PATTERN), "schema_id_malformed")
        .when((state["f"] != "absent") & ~present["f"], _unreadable(state["f"]))
        .when(present["f"] & ~text["f"].isin(*MEDIA_TYPES), "envelope_format_unknown"),
    )
    marker = F.lit(wire.content_marker)
    at = F.locate(wire.content_marker, F.col("content_type"))
    tail = F.substr(F.col("content_type"), at + F.length(marker))
    df = df.withColumn("_error", error).withColumn("_tail", F.when(at > 0, tail))
    df = df.withColumn("_media", F.when(at > 0, F.substr(F.col("content_type"), F.lit(1), at - 1)))
    error, tail = F.col("_error"), F.col("_tail")
    in_content = ~in_headers & F.coalesce(tail.rlike(SCHEMA_ID_PATTERN), F.lit(False))
    headers_ok = in_headers & error.isNull()
    df = df.withColumn("_kind", F.when(headers_ok, "headers").when(in_content, "content_type").otherwise("none"))
    headers_ok, in_content = F.col("_kind") == "headers", F.col("_kind") == "content_type"
    media_format = None
    for fmt, name in MEDIA_TYPES.items():
        media_format = (F if media_format is None else media_format).when(F.col("_media") == name, fmt)

    type_text = F.when(F.col("properties_type") != "", F.col("properties_type"))
    df = df.withColumn("_candidate", F.when(headers_ok & present["s"], text["s"]).otherwise(type_text))
    candidate = F.col("_candidate")
    df = df.withColumn("_named", candidate.isNotNull() & ~_padded(candidate) & subject_valid(candidate))
    df = df.withColumn("_ordinal", F.when(present["o"], to_int32(text["o"])))
    df = df.withColumn("_semver", present["m"] & ~_padded(text["m"]) & semver_valid(text["m"]))
    named, semver_ok = F.col("_named"), F.coalesce("_semver", F.lit(False))
    ordinal = F.when(F.col("_ordinal") >= 1, F.col("_ordinal"))
    built = text["m"].rlike(r"(?s)^[0-9]+\.[0-9]+\.[0-9]+(\+|-.*\+)")
    warnings = F.array(
        F.when(headers_ok, _unreadable(state["s"])),
        F.when(candidate.isNotNull() & ~named, "subject_name_invalid"),
        F.when(
            headers_ok & named & present["s"] & type_text.isNotNull() & (text["s"] != type_text),
            "envelope_subject_type_mismatch",
        ),
        F.when(headers_ok & (state["o"] != "absent") & ordinal.isNull(), "envelope_ordinal_malformed"),
        F.when(
            headers_ok & (state["m"] != "absent") & ~semver_ok,
            F.when(~present["m"], "envelope_malformed")
            .when(~_padded(text["m"]) & built, "semver_build_metadata_unsupported")
            .otherwise("semver_invalid"),
        ),
    )
    read = headers_ok | in_content
    return df.select(
        *messages.columns,
        F.col("_kind").alias("kind"),
        F.when(headers_ok, text["i"]).when(in_content, tail).alias("schema_id"),
        F.when(read & named, candidate).alias("subject"),
        F.when(headers_ok, ordinal).alias("ordinal"),
        F.when(headers_ok & semver_ok, text["m"]).alias("semver"),
        F.when(headers_ok, F.when(present["f"], text["f"])).when(in_content, media_format).alias("format"),
        F.when(read, F.array_compact(warnings)).otherwise(F.array().cast("array<string>")).alias("warnings"),
        error.alias("error_code"),
    )


def envelope_report(decoded: DataFrame) -> DataFrame:
    """Adoption: messages by exchange, hour, kind, error and warning."""
    return (
        decoded.select(
            "exchange", F.date_trunc("hour", "ts").alias("hour"), "kind", "error_code",
            F.explode_outer("warnings").alias("warning"),
        )
        .groupBy("exchange", "hour", "kind", "error_code", "warning")
        .agg(F.count("*").alias("messages"))
    )


def stamp_envelopes(messages: DataFrame, wire: Wire = Wire()) -> DataFrame:
    """Write envelope headers from columns (schema_id, subject, ordinal, semver, format).

    Rows without a schema_id pass unchanged; other headers are kept, an envelope header that is
    already there is replaced.
    """

    def entry(name: str, value: Column) -> Column:
        body = F.struct(F.lit("string").alias("kind"), value.cast("string").cast("binary").alias("bytes"))
        return F.when(value.isNotNull(), F.struct(F.lit(name).alias("key"), body.alias("value")))

    written = F.array_compact(
        F.array(
            entry(wire.version, F.lit(ENVELOPE_VERSION)),
            entry(wire.schema_id, F.col("schema_id")),
            entry(wire.subject, F.col("subject")),
            entry(wire.ordinal, F.col("ordinal")),
            entry(wire.semver, F.col("semver")),
            entry(wire.format, F.col("format")),
        )
    )
    stamp = F.map_from_entries(written)
    kept = F.map_filter("headers", lambda k, _: ~F.map_contains_key(stamp, k))
    headers = F.when(F.col("headers").isNull(), stamp).otherwise(F.map_concat(kept, stamp))
    return messages.withColumn("headers", F.when(F.col("schema_id").isNull(), F.col("headers")).otherwise(headers))


def content_type_of(format: Column, schema_id: Column, wire: Wire = Wire()) -> Column:
    """The content-type form of an envelope."""
    media = None
    for fmt, name in MEDIA_TYPES.items():
        media = (F if media is None else media).when(format == fmt, name)
    return F.concat(media, F.lit(wire.content_marker), schema_id)


def resolve_subjects(messages: DataFrame) -> DataFrame:
    """Message type to ``subject_outcome`` (resolved, absent, unusable) and ``resolved_subject``, in place.

    Each distinct type is parsed once; the messages then look theirs up.
    """
    message_type = strip("properties_type")
    text = F.when(is_generic_type(message_type), generic_subject(message_type)).otherwise(normalize_subject("properties_type"))
    outcome = F.when(blank("properties_type"), "absent").when(subject_valid(text), "resolved").otherwise("unusable")
    seen = messages.select("properties_type").where("properties_type is not null").distinct()
    types = seen.select("properties_type", outcome.alias("subject_outcome"), F.when(outcome == "resolved", strip(text)).alias("resolved_subject"))
    held = messages.join(materialize(types, "types"), "properties_type", "left")
    return held.select(*messages.columns, F.coalesce("subject_outcome", F.lit("absent")).alias("subject_outcome"), "resolved_subject")


def subject_inventory(resolved: DataFrame) -> DataFrame:
    """What flows: one row per subject and exchange with message counts and first and last seen,
    and the number of exchanges the subject uses. Rows without a subject have subject null."""
    per_exchange = resolved.groupBy(
        F.col("resolved_subject").alias("subject"), "subject_outcome", "exchange"
    ).agg(F.count("*").alias("messages"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    per_subject = per_exchange.groupBy("subject", "subject_outcome").agg(
        F.sum("messages").alias("messages"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.count("*").alias("exchanges"),
    )
    per_subject = materialize(per_subject, "subjects")
    total = per_subject.agg(F.sum("messages").alias("total"))
    return per_subject.join(F.broadcast(total)).select(
        "subject", "subject_outcome", "messages", "first_seen", "last_seen", "exchanges",
        (F.col("messages") / F.col("total")).alias("share"),
    )

"""Every operator as a query over a folder of tables: ``name -> callable(spark, folder)``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import (
    json_pointer_escape,
    normalize_subject,
    parse_selector,
    selector_accepts,
    semver_key,
    subject_valid,
)
from ..operators import catalog, compatibility, conformance, decoding, governance, graph, inference, notifications, routing, validation, violations
from ..operators.avro_diff import avro_diff, avro_types
from ..operators.bundle import bundle_schemas
from ..operators.canonical import catalog_canonical_audit
from ..operators.json_diff import diff_json_pairs, json_schema_diff
from ..operators.nodes import schema_nodes
from ..operators.proto_diff import protobuf_diff
from ..operators.verdicts import stored
from ..session import configure, materialize, run_dir
from ..sources import SnapshotRegistry, contract_files, latest_export, publish_snapshot, read_messages, sample_queue
from ..sources.derived import ArrivingViews, Views
from ..streaming import ROCKSDB, stream_conformance, stream_flush_windows, stream_service_state, stream_violation_rollup
from ..wire import MONITOR

Query = Callable[[SparkSession, str], DataFrame]
REGISTERED: dict[str, Query] = {}
#: Rows of a file that arrives at a stream.
PIECE = 250_000

LINE_SCHEMA = (
    '{"properties":{"flags":{"items":{"enum":["N","O","F"]},"maxItems":2,"type":"array","uniqueItems":true},'
    '"gift":{"const":false},'
    '"line":{"additionalProperties":false,"properties":{"disc":{"minimum":0.01,"type":"number"},"n":{"multipleOf":2},'
    '"qty":{"maximum":45,"type":"integer"},"ship":{"pattern":"^199[2-7]","type":"string"}},"type":"object"},'
    '"note":{"minLength":9,"type":["string","null"]},'
    '"order":{"properties":{"status":{"enum":["F","O"]},"total":{"maximum":200000,"type":"number"}},'
    '"required":["id","priority"],"type":"object"}},"required":["line","order"],"type":"object"}'
)


def query(name: str) -> Callable[[Callable[[Views], DataFrame]], Callable[[Views], DataFrame]]:
    def add(build: Callable[[Views], DataFrame]):
        REGISTERED[name] = lambda spark, folder: build(Views(configure(spark), folder))
        return build

    return add


def joined(c: str):
    """A list as text, so that results compare as plain values."""
    return F.array_join(c, ",").alias(c)


# --- sources and sinks ----------------------------------------------------------------------


@query("a1_read_messages")
def _(v: Views) -> DataFrame:
    return read_messages(v.spark, f"{v.dir}/conversations.parquet").select("conv_id", "turn", "role", "text")


@query("a2_contract_files")
def _(v: Views) -> DataFrame:
    contracts, errors = contract_files(v.contract_file_rows)
    ok = contracts.select("path", "subject", "format", F.lit(None).cast("string").alias("error_code"))
    bad = errors.select(
        "path", F.lit(None).cast("string").alias("subject"), F.lit(None).cast("string").alias("format"), "error_code"
    )
    return ok.unionByName(bad)


@query("a3_export_latest")
def _(v: Views) -> DataFrame:
    return latest_export(v.subjects, v.versions, v.schemas)[0].drop("format")


@query("a3_export_skipped")
def _(v: Views) -> DataFrame:
    return latest_export(v.subjects, v.versions, v.schemas)[1]


@query("a4_sample_queue")
def _(v: Views) -> DataFrame:
    return sample_queue(v.messages, "q.view", 500, subject="acme.events.view")[1]


# --- decoding -------------------------------------------------------------------------------


@query("b1_decode_envelopes")
def _(v: Views) -> DataFrame:
    return decoding.decode_envelopes(v.messages).select(
        "message_id", "kind", "schema_id", "subject", "ordinal", "semver", "format", joined("warnings"), "error_code"
    )


@query("b2_envelope_report")
def _(v: Views) -> DataFrame:
    return decoding.envelope_report(decoding.decode_envelopes(v.messages))


@query("b3_stamp_envelopes")
def _(v: Views) -> DataFrame:
    latest = v.event_subjects.select(F.concat(F.lit("q."), F.substring_index("subject", ".", -1)).alias("queue"), "subject", "ordinal", "schema_id", "format")
    stamped = decoding.stamp_envelopes(v.messages.join(latest, "queue", "left").withColumn("semver", F.lit(None).cast("string")), v.wire)
    text = lambda n: F.try_validate_utf8(F.try_element_at("headers", F.lit(n))["bytes"].cast("string"))
    return stamped.select(
        "message_id", F.size("headers").alias("n_headers"), text(v.wire.schema_id).alias("schema_id"),
        text(v.wire.subject).alias("subject"), text(v.wire.ordinal).alias("ordinal"), text("x-trace").alias("trace"),
    )


@query("b4_resolve_subjects")
def _(v: Views) -> DataFrame:
    return decoding.resolve_subjects(v.messages).select("message_id", "subject_outcome", "resolved_subject")


@query("b5_subject_inventory")
def _(v: Views) -> DataFrame:
    out = decoding.subject_inventory(decoding.resolve_subjects(v.messages))
    return out.withColumn("share", F.round("share", 6))


# --- contracts ------------------------------------------------------------------------------


@query("c1_topic_match_join")
def _(v: Views) -> DataFrame:
    return routing.topic_match_join(v.messages, v.publish_bindings).select(
        "broker_id", "virtual_host", "exchange", "routing_key", "contract", "seq"
    )


def _resolved(df: DataFrame) -> DataFrame:
    refs = F.transform("subjects", lambda r: F.concat(r["subject"], F.lit("@"), r["selector"]))
    return df.withColumn("subjects", F.array_join(refs, ",")).withColumn("contracts", F.array_join("contracts", ","))


@query("c2_resolve_publish")
def _(v: Views) -> DataFrame:
    return _resolved(routing.resolve_publish(v.messages, v.contracts, v.publish_bindings))


@query("c3_resolve_consume")
def _(v: Views) -> DataFrame:
    return _resolved(routing.resolve_consume(v.messages, v.contracts, v.consume_bindings))


@query("c4_route_ambiguity")
def _(v: Views) -> DataFrame:
    return routing.route_ambiguity(v.messages, routing.resolve_publish(v.messages, v.contracts, v.publish_bindings))


@query("c5_binding_conflicts")
def _(v: Views) -> DataFrame:
    return routing.binding_conflicts(v.publish_bindings, v.consume_bindings)


def _registry(v: Views) -> conformance.Registry:
    return conformance.Registry(v.event_subjects, v.event_catalog, v.contracts, v.publish_bindings, v.consume_bindings)


def _published(v: Views) -> DataFrame:
    return conformance.publish_conformance(v.messages, _registry(v), MONITOR)


def _consumed(v: Views) -> DataFrame:
    return conformance.consume_conformance(v.messages, _registry(v), MONITOR, v.wire)


@query("c6_publish_conformance")
def _(v: Views) -> DataFrame:
    return _published(v).select("message_id", "outcome", "code", "mode", "judged_subject", "judged_schema_id")


@query("c7_consume_conformance")
def _(v: Views) -> DataFrame:
    return _consumed(v).select("message_id", "outcome", "code", "mode", "judged_subject", "judged_schema_id")


@query("c8_selector_filter")
def _(v: Views) -> DataFrame:
    refs = v.publish_refs.join(v.event_subjects.select("subject", F.col("ordinal").alias("latest")), "subject")
    tried = refs.select("contract", "seq", "pos", "selector", "latest", F.explode(F.sequence(F.lit(1), F.col("latest") + 1)).alias("ordinal"))
    ok = selector_accepts(parse_selector("selector"), F.col("ordinal"), F.col("latest"))
    return tried.where(ok).select("contract", "seq", "pos", "ordinal")


@query("c9_quarantine_split")
def _(v: Views) -> DataFrame:
    through, stopped = conformance.quarantine_split(_consumed(v), wire=v.wire)
    reason = F.try_element_at("headers", F.lit(f"{v.wire.prefix}-quarantine-reason"))["bytes"].cast("string")
    return through.select("message_id", F.lit("pass").alias("side"), F.lit(None).cast("string").alias("reason")).unionByName(
        stopped.select("message_id", F.lit("quarantine").alias("side"), reason.alias("reason"))
    )


# --- validation and inference -----------------------------------------------------------------


def _line_findings(v: Views) -> DataFrame:
    schemas = v.line_docs.select("subject").distinct().select(
        F.col("subject").alias("schema_id"), F.lit("json").alias("format"), F.lit(LINE_SCHEMA).alias("body")
    )
    docs = v.line_docs.select("doc_id", F.col("subject").alias("schema_id"), "body")
    return validation.validate_payloads(docs, schemas, "doc_id")


@query("d1_validate_payloads")
def _(v: Views) -> DataFrame:
    return _line_findings(v)


@query("d2_violation_hotspots")
def _(v: Views) -> DataFrame:
    return validation.violation_hotspots(_line_findings(v), ["schema_id"], "doc_id")


STATS = ("occurrences n_null n_true n_false n_string n_number n_int64 n_object n_array non_empty distinct_strings truncated").split()


@query("d3_infer_path_stats")
def _(v: Views) -> DataFrame:
    return inference.infer_path_stats(v.line_docs).select("subject", "schema_path", *STATS)


@query("d3_infer_chat_stats")
def _(v: Views) -> DataFrame:
    body = F.to_json(F.struct("role", "text", "turn"))
    return inference.infer_path_stats(v.chat_docs.withColumn("body", body)).select("subject", "schema_path", *STATS)


@query("d4_infer_schema")
def _(v: Views) -> DataFrame:
    return inference.infer_schema(inference.infer_path_stats(v.line_docs))


@query("d5_infer_findings")
def _(v: Views) -> DataFrame:
    return inference.infer_findings(inference.infer_path_stats(v.line_docs))


@query("d6_detect_string_format")
def _(v: Views) -> DataFrame:
    return inference.detect_string_format(inference.infer_path_stats(v.line_docs))


# --- catalog ----------------------------------------------------------------------------------


def _audit(v: Views) -> DataFrame:
    return catalog_canonical_audit(v.authored_rows.withColumn("format", F.lit("json")), v.wire)


@query("e1_catalog_canonical_audit")
def _(v: Views) -> DataFrame:
    return _audit(v).select("environment_id", "subject", "ordinal", "canonical", "error_code")


@query("e2_schema_ids")
def _(v: Views) -> DataFrame:
    return v.registry.select("environment_id", "subject", "ordinal", "schema_id")


@query("e3_dedupe_catalog")
def _(v: Views) -> DataFrame:
    return catalog.dedupe_catalog(_audit(v))


@query("e4_schema_usages")
def _(v: Views) -> DataFrame:
    return catalog.schema_usages(v.versions)


@query("e4_reachable_schemas")
def _(v: Views) -> DataFrame:
    return catalog.reachable_schemas(v.schemas, v.versions.where("environment_id = 'ASIA'")).select("schema_id", "body")


def _edges(v: Views) -> DataFrame:
    edges, _ = catalog.extract_references(schema_nodes(v.ref_schemas), v.wire)
    return graph.version_edges(v.ref_schemas, edges, v.wire)


@query("e5_extract_references")
def _(v: Views) -> DataFrame:
    edges, _ = catalog.extract_references(schema_nodes(v.ref_schemas), v.wire)
    return edges.select("schema_id", "subject", "version")


@query("e5_reference_errors")
def _(v: Views) -> DataFrame:
    worded = v.lint_rows.select(
        "schema_id", F.lit("json").alias("format"),
        F.concat(F.lit(f'{{"$ref":"{v.wire.scheme}://main/acme.P'), F.col("k").cast("string"), F.lit("/"), (F.col("k") % 3).cast("string"), F.lit('"}')).alias("body"),
    )
    return catalog.extract_references(schema_nodes(worded), v.wire)[1].select("schema_id", "error_code")


@query("e6_transitive_referrers")
def _(v: Views) -> DataFrame:
    return graph.transitive_referrers(_edges(v).where("dst is not null"))


@query("e6_referrer_counts")
def _(v: Views) -> DataFrame:
    return graph.referrer_counts(_edges(v).where("dst is not null"))


@query("e7_reference_cycles")
def _(v: Views) -> DataFrame:
    return graph.reference_cycles(_edges(v).where("dst is not null")).withColumn("path", F.array_join("path", ">"))


@query("e8_portability_lint")
def _(v: Views) -> DataFrame:
    return catalog.portability_lint(schema_nodes(v.lint_rows.withColumn("format", F.lit("json"))))


@query("e9_bundle_schemas")
def _(v: Views) -> DataFrame:
    edges, _ = catalog.extract_references(schema_nodes(v.ref_schemas), v.wire)
    return bundle_schemas(v.ref_schemas, graph.version_edges(v.ref_schemas, edges, v.wire), v.wire)


@query("e10_latest_snapshot")
def _(v: Views) -> DataFrame:
    return graph.latest_versions(v.subjects, v.versions).drop("format")


@query("e10_needed_schemas")
def _(v: Views) -> DataFrame:
    subjects = v.ref_schemas.select(
        "environment_id", "subject", "format", F.lit(1).alias("latest_ordinal"),
        F.when(F.col("k") % 2 == 0, "Retired").otherwise("Active").alias("lifecycle"),
    )
    versions = v.ref_schemas.withColumn("semver", F.lit(None).cast("string"))
    return graph.latest_snapshot(subjects, versions, _edges(v))[1]


def _tips(v: Views) -> DataFrame:
    return v.subjects.select("environment_id", "subject", F.col("latest_ordinal").alias("ordinal")).join(
        v.versions.select("environment_id", "subject", "ordinal", "schema_id"), ["environment_id", "subject", "ordinal"]
    )


@query("e11_contract_drift")
def _(v: Views) -> DataFrame:
    nodes = schema_nodes(v.schemas)
    side = lambda env: _tips(v).where(F.col("environment_id") == env)
    return catalog.contract_drift(side("ASIA"), side("EUROPE"), nodes, nodes)


@query("e12_duplicate_subjects")
def _(v: Views) -> DataFrame:
    return catalog.duplicate_subjects(contract_files(v.contract_file_rows)[0])


# --- compatibility ----------------------------------------------------------------------------


def _policies(v: Views) -> DataFrame:
    return compatibility.effective_policy(v.subjects, v.environments)


def _differ(v: Views):
    def differ(pairs: DataFrame) -> DataFrame:
        return diff_json_pairs(pairs, rules=materialize(validation.rules_of(v.schemas), "rules"), unique=True)

    # Every query of an application that compares schemas shares what has been found.
    return stored(differ, f"{run_dir(v.spark)}/verdicts")


def _verdicts(v: Views):
    proposals = v.versions.where("status = 'AwaitingApproval'")
    return compatibility.compatibility_check(proposals, v.versions, _policies(v), _differ(v))


@query("f1_json_schema_diff")
def _(v: Views) -> DataFrame:
    pairs = v.versions.alias("b").join(
        v.versions.alias("a"),
        (F.col("a.environment_id") == F.col("b.environment_id")) & (F.col("a.subject") == F.col("b.subject")) & (F.col("a.ordinal") == F.col("b.ordinal") + 1),
    ).select(F.col("b.schema_id").alias("prev_id"), F.col("a.schema_id").alias("next_id"), F.lit("Closed").alias("content_model"))
    return json_schema_diff(pairs, materialize(validation.rules_of(v.schemas), "rules")).drop("content_model")


def _avro_types(v: Views) -> DataFrame:
    return avro_types(catalog_canonical_audit(v.avro_rows.withColumnRenamed("schema_id", "key"), v.wire).select(
        F.col("key").alias("schema_id"), "canonical"))


@query("f2_avro_diff")
def _(v: Views) -> DataFrame:
    return avro_diff(v.shape_pairs, _avro_types(v))


@query("f3_protobuf_diff")
def _(v: Views) -> DataFrame:
    return protobuf_diff(v.shape_pairs, v.proto_message_rows, v.proto_field_rows, v.proto_enum_rows, v.proto_reserved_rows)


@query("e5_unsupported_references")
def _(v: Views) -> DataFrame:
    undefined = v.part.select(
        F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("schema_id"),
        F.concat(F.lit('["null","acme.X'), F.col("p_size").cast("string"), F.lit('"]')).alias("canonical"),
    )
    return catalog.unsupported_references(avro_types(undefined).unionByName(_avro_types(v)), v.import_rows)


@query("f4_compatibility_check")
def _(v: Views) -> DataFrame:
    return _verdicts(v)[0]


@query("f4_compatibility_changes")
def _(v: Views) -> DataFrame:
    return _verdicts(v)[1]


@query("f5_compatibility_audit")
def _(v: Views) -> DataFrame:
    return compatibility.compatibility_audit(v.versions, _policies(v), _differ(v))


@query("f6_diff_versions")
def _(v: Views) -> DataFrame:
    asked = v.versions.where("ordinal > 2").select("environment_id", "subject", (F.col("ordinal") - 2).alias("a"), F.col("ordinal").alias("b"))
    return compatibility.diff_versions(asked, v.versions, _policies(v), _differ(v))


@query("f7_effective_policy")
def _(v: Views) -> DataFrame:
    return _policies(v)


@query("f8_semver_sort_key")
def _(v: Views) -> DataFrame:
    labels = v.versions.where("semver is not null").groupBy("semver").agg(F.count("*").alias("versions"))
    pre = labels.withColumn("key", semver_key("semver"))
    return pre.select("semver", "versions", "key.major", "key.minor", "key.patch", "key.is_release", F.size("key.pre").alias("identifiers"))


@query("f9_suggest_semver")
def _(v: Views) -> DataFrame:
    return compatibility.suggest_semver(v.versions, _verdicts(v)[0]).select("environment_id", "subject", "schema_id", "bump", "suggested_semver")


@query("f10_semver_label_audit")
def _(v: Views) -> DataFrame:
    audit = compatibility.compatibility_audit(v.versions, _policies(v), _differ(v))
    return compatibility.semver_label_audit(v.versions, audit)


@query("f12_bulk_check")
def _(v: Views) -> DataFrame:
    directory = _tips(v).where("environment_id = 'ASIA'").select(
        F.lit("EUROPE").alias("environment_id"), "subject", F.when(F.length("subject") % 4 == 0, "avro").otherwise("json").alias("format"), "schema_id"
    )
    return compatibility.bulk_check(directory, v.versions, _policies(v), _differ(v))


@query("f12_push_plan")
def _(v: Views) -> DataFrame:
    directory = _tips(v).where("environment_id = 'ASIA'").select(
        F.lit("EUROPE").alias("environment_id"), "subject", F.lit("json").alias("format"), "schema_id"
    )
    return compatibility.push_plan(directory, v.versions, _tips(v), _policies(v), _differ(v)).drop("format")


# --- governance -------------------------------------------------------------------------------


def _uses(v: Views) -> DataFrame:
    return v.service_uses.select(
        "environment_id", "service", F.when(F.col("produces"), "produces").otherwise("consumes").alias("role"), "subject", "selector"
    )


def _now(v: Views):
    """The moment after the last order: the data's own clock."""
    return F.to_timestamp(F.lit("1998-09-01 00:00:00"))


@query("g1_impact_analysis")
def _(v: Views) -> DataFrame:
    impacts = governance.impact_analysis(
        _tips(v), _uses(v), v.service_seen, v.versions, v.subjects, _policies(v), _differ(v), _now(v)
    )
    return impacts.withColumn("reasons", F.size("reasons"))


@query("g1_impact_summary")
def _(v: Views) -> DataFrame:
    return governance.impact_summary(
        governance.impact_analysis(_tips(v), _uses(v), v.service_seen, v.versions, v.subjects, _policies(v), _differ(v), _now(v))
    )


@query("g2_governing_contracts")
def _(v: Views) -> DataFrame:
    return governance.governing_contracts(v.publish_bindings, v.consume_bindings)


@query("g3_stale_services")
def _(v: Views) -> DataFrame:
    return governance.stale_services(v.service_seen, _now(v)).select("environment_id", "service", "last_seen_at")


def _service_reports(v: Views) -> DataFrame:
    ref = F.array(F.struct(F.concat(F.lit("acme.events."), F.col("event_type")).alias("subject"), F.lit("latest").alias("selector")))
    none = F.array().cast("array<struct<subject:string,selector:string>>")
    return v.events.select(
        F.concat(F.lit("env"), (F.col("user_id") % 3).cast("string")).alias("environment_id"),
        F.concat(F.lit("svc-"), F.col("user_id").cast("string")).alias("service"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"),
        F.when(F.col("event_id") % 2 == 0, ref).otherwise(none).alias("produces"),
        F.when(F.col("event_id") % 2 == 1, ref).otherwise(none).alias("consumes"),
    )


@query("g4_service_registry_state")
def _(v: Views) -> DataFrame:
    first = lambda c: F.try_element_at(c, F.lit(1))["subject"].alias(c)
    return governance.service_registry_state(_service_reports(v)).select(
        "environment_id", "service", first("produces"), first("consumes"), "first_seen_at", "last_seen_at", "reports"
    )


@query("g5_lineage_edges")
def _(v: Views) -> DataFrame:
    return governance.lineage_edges(_uses(v))


@query("g5_lineage_pairs")
def _(v: Views) -> DataFrame:
    return governance.lineage_pairs(_uses(v), _uses(v).select("environment_id", "subject"))


@query("g6_promotion_plan")
def _(v: Views) -> DataFrame:
    return governance.promotion_plan("ASIA", "EUROPE", v.subjects, v.versions, _policies(v), _differ(v))


@query("g7_environment_drift")
def _(v: Views) -> DataFrame:
    return governance.environment_drift("ASIA", "EUROPE", v.subjects, v.versions)


@query("g8_violation_rollup")
def _(v: Views) -> DataFrame:
    return violations.violation_rollup(v.violation_reports)


@query("g8_report_outcomes")
def _(v: Views) -> DataFrame:
    return violations.report_outcomes(v.violation_reports)


@query("g9_top_violations")
def _(v: Views) -> DataFrame:
    return violations.top_violations(violations.violation_rollup(v.violation_reports), "env1", 20).select(
        "fingerprint", "last_seen_at", "occurrences"
    )


def _decisions(v: Views) -> DataFrame:
    return conformance.decisions_of(_published(v), "publish").unionByName(conformance.decisions_of(_consumed(v), "consume"))


@query("g10_enforcement_counters")
def _(v: Views) -> DataFrame:
    return violations.enforcement_counters(_decisions(v))


@query("g10_recent_decisions")
def _(v: Views) -> DataFrame:
    return violations.recent_decisions(_decisions(v)).select("side", "message_id", "outcome", "code")


@query("g11_audit_query")
def _(v: Views) -> DataFrame:
    return governance.audit_query(v.audit_rows, environment="env1", action="VERSION_REGISTERED", limit=200)


@query("g12_deployment_trail")
def _(v: Views) -> DataFrame:
    return governance.deployment_trail(v.deployment_rows, 50)


def _usage(v: Views) -> DataFrame:
    tenant = lambda c: F.concat(F.lit("t"), (F.col(c) % 25).cast("string")).alias("tenant_id")
    by_subject = v.subjects.select("tenant_id", "environment_id", "subject")
    return governance.usage_meter(
        v.subjects.select("tenant_id", "environment_id").distinct(),
        by_subject,
        v.customer.select(tenant("c_custkey")),
        v.versions.join(by_subject, ["environment_id", "subject"]),
        F.to_timestamp(F.lit("1997-06-15 12:00:00")),
    )


@query("g13_usage_meter")
def _(v: Views) -> DataFrame:
    return _usage(v)


@query("g14_plan_limit_check")
def _(v: Views) -> DataFrame:
    subscriptions = v.nation.select(
        F.concat(F.lit("t"), F.col("n_nationkey").cast("string")).alias("tenant_id"),
        F.expr("element_at(array('FREE','TEAM','BUSINESS','ENTERPRISE'), n_nationkey % 4 + 1)").alias("tier"),
        F.when(F.col("n_nationkey") % 6 == 5, "CANCELLED").otherwise("ACTIVE").alias("status"),
    ).where("tenant_id <> 't3'")
    return governance.plan_limit_check(_usage(v), subscriptions)


@query("g15_registry_overview")
def _(v: Views) -> DataFrame:
    return governance.registry_overview(v.subjects, v.versions)


@query("g15_recent_subjects")
def _(v: Views) -> DataFrame:
    return governance.recent_subjects(v.subjects, v.versions, 25)


@query("g16_subject_search")
def _(v: Views) -> DataFrame:
    return governance.subject_search(v.subjects, " PART.p19 ").select("environment_id", "subject", "owner")


@query("g17_notification_fanout")
def _(v: Views) -> DataFrame:
    return notifications.notification_fanout(v.outbox_rows, v.notify_rows)[0]


@query("g17_unwanted")
def _(v: Views) -> DataFrame:
    return notifications.notification_fanout(v.outbox_rows, v.notify_rows)[1].select("outbox_id", "event")


@query("g18_outbox_due")
def _(v: Views) -> DataFrame:
    due = notifications.outbox_due(v.outbox_rows, F.to_timestamp(F.lit("2024-01-15 00:00:00")))
    return due.select("outbox_id", "occurred_at", "attempts")


@query("g18_outbox_depth")
def _(v: Views) -> DataFrame:
    return notifications.outbox_depth(v.outbox_rows)


@query("g19_outbox_retry_state")
def _(v: Views) -> DataFrame:
    return notifications.outbox_retry_state(v.attempt_rows)


def _arrived(v: Views, writer, name: str) -> str:
    """Run a stream writer over all that is there, writing each micro-batch to a folder; the folder."""
    folder = f"{run_dir(v.spark)}/{name}-{uuid.uuid4().hex}"
    keep = lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/batch={n}")
    query = writer(keep).option("checkpointLocation", f"{folder}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return folder


@query("h1_stream_conformance")
def _(v: Views) -> DataFrame:
    arriving, registry = ArrivingViews(v.spark, v.dir, v.wire), _registry(v)
    columns = ["message_id", "outcome", "code", "mode", "judged_subject", "judged_schema_id"]

    def writer(keep):
        sink = lambda classified, n: keep(classified.select(*columns), n)
        return stream_conformance(arriving.messages, lambda: registry, sink, side="consume", wire=v.wire)

    return v.spark.read.parquet(_arrived(v, writer, "h1")).select(*columns)


def _arriving(v: Views, rows: DataFrame, arrival: Column, rounds: int, writer, name: str, before=lambda i: None) -> None:
    """Let ``rows`` arrive in rounds, by their number ``arrival``: after each the stream is started from its
    checkpoint, takes what is new in several batches, and stops."""
    folder = f"{run_dir(v.spark)}/{name}-{uuid.uuid4().hex}"
    there = materialize(rows.withColumn("_round", F.greatest(F.lit(0), F.least(arrival, F.lit(rounds - 1)))), name)
    # A round is three files, a batch two of them; of large tables each is cut in pieces, so that every core reads.
    pieces = 1 + there.count() // (3 * rounds * PIECE)
    setting = "spark.sql.streaming.stateStore.providerClass"
    provider = v.spark.conf.get(setting)
    v.spark.conf.set(setting, ROCKSDB)
    try:
        for i in range(rounds):
            before(i)
            there.where(F.col("_round") == i).drop("_round").repartition(3 * pieces).write.mode("append").parquet(f"{folder}/in")
            stream = v.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2 * pieces).parquet(f"{folder}/in")
            started = writer(stream).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
            started.awaitTermination()
    finally:
        v.spark.conf.set(setting, provider)


def _batches(v: Views, name: str):
    """A folder and a sink that writes each micro-batch to its own part of it: one that runs again replaces it."""
    folder = f"{run_dir(v.spark)}/{name}-{uuid.uuid4().hex}"
    return folder, lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/batch={n}")


def _third(ts: str = "ts", straggler: str = "seq") -> Column:
    """When a row arrives: by the ten days of its month, and every seventh one round later."""
    return F.floor((F.dayofmonth(ts) - 1) / 10).cast("int") + F.when(F.col(straggler) % 7 == 0, 1).otherwise(0)


@query("h1_registry_reload")
def _(v: Views) -> DataFrame:
    """Messages of two halves of a month; between them contracts are declared and one more schema becomes known."""
    columns = ["message_id", "outcome", "code", "mode", "judged_subject", "judged_schema_id"]
    snapshots = f"{run_dir(v.spark)}/registry-{uuid.uuid4().hex}"
    registry = SnapshotRegistry(v.spark, snapshots)
    folder, keep = _batches(v, "reload")
    signup = F.col("subject") == "acme.events.signup"

    def before(i: int) -> None:
        new = v.event_subjects.where(signup).select("schema_id")
        publish_snapshot(
            snapshots, contracts=v.contracts, publish=v.publish_bindings,
            subjects=v.event_subjects.where(~signup) if i == 0 else v.event_subjects,
            schemas=v.event_catalog.join(new, "schema_id", "left_anti") if i == 0 else v.event_catalog,
            consume=v.consume_bindings.limit(0) if i == 0 else v.consume_bindings,
        )

    sink = lambda classified, n: keep(classified.select(*columns), n)
    writer = lambda stream: stream_conformance(stream, registry, sink, side="consume", wire=v.wire)
    _arriving(v, v.messages, (F.dayofmonth("ts") > 15).cast("int"), 2, writer, "reload-in", before)
    return v.spark.read.parquet(folder).select(*columns)


@query("h2_stream_violation_rollup")
def _(v: Views) -> DataFrame:
    folder, keep = _batches(v, "h2")
    writer = lambda stream: stream_violation_rollup(stream).writeStream.outputMode("update").foreachBatch(keep)
    _arriving(v, v.violation_reports, _third(), 3, writer, "h2-in")
    rows = v.spark.read.parquet(folder)
    columns = [c for c in rows.columns if c not in ("batch", "opened", "fingerprint")]
    newest = rows.groupBy("fingerprint").agg(F.max_by(F.struct(*columns), "batch").alias("r"))
    return newest.select("fingerprint", "r.*")


@query("h2_violations_opened")
def _(v: Views) -> DataFrame:
    """How often the stream has said that a violation opened, over all batches and restarts."""
    folder, keep = _batches(v, "h2-opened")
    writer = lambda stream: stream_violation_rollup(stream).writeStream.outputMode("update").foreachBatch(keep)
    _arriving(v, v.violation_reports, _third(), 3, writer, "h2-opened-in")
    return v.spark.read.parquet(folder).groupBy("fingerprint").agg(F.count_if("opened").alias("opened"))


@query("h3_stream_flush_windows")
def _(v: Views) -> DataFrame:
    """Counts of the windows that the stream has closed, what came late included."""
    folder, keep = _batches(v, "h3")
    writer = lambda stream: stream_flush_windows(stream, "1 day", "2 days", shares=4).writeStream.foreachBatch(keep)
    _arriving(v, _flushes(v), _third(straggler="message_id"), 3, writer, "h3-in")
    rows = v.spark.read.parquet(folder)
    return rows.groupBy("window_start", "reporter", "side", "route", "subject", "code", "detail").agg(
        F.sum("n").alias("n"), F.count_if(F.col("kind") == "kept").alias("flushes")
    ).select("window_start", "reporter", "side", "route", "subject", "code", "detail", "n", (F.col("flushes") <= 1).alias("flushed_once"))


@query("g4_stream_service_state")
def _(v: Views) -> DataFrame:
    table = f"{run_dir(v.spark)}/services-{uuid.uuid4().hex}"
    batches: list[int] = []

    def writer(stream: DataFrame):
        return stream_service_state(stream, table, batches.append)

    _arriving(v, _service_reports(v), _third(), 3, writer, "g4-in")
    first = lambda c: F.try_element_at(f"newest.{c}", F.lit(1))["subject"].alias(c)
    return v.spark.read.parquet(f"{table}/version={max(batches)}").select(
        "environment_id", "service", first("produces"), first("consumes"), "first_seen_at", "last_seen_at"
    )


@query("h3_violation_flush_windows")
def _(v: Views) -> DataFrame:
    return violations.violation_flush_windows(_flushes(v), "30 days")[0]


@query("h3_violation_flush_dropped")
def _(v: Views) -> DataFrame:
    return violations.violation_flush_windows(_flushes(v), "30 days", keys=256)[1]


def _flushes(v: Views) -> DataFrame:
    r = v.violation_reports.withColumn("reported_by", F.coalesce("reported_by", F.lit("unknown")))
    return r.select("ts", F.col("seq").alias("message_id"), "side", "route", "subject", "code",
                    F.concat("detail", (F.col("seq") % 997).cast("string")).alias("detail"), "reported_by")


@query("i_column_functions")
def _(v: Views) -> DataFrame:
    """The exported column functions over part names and brands."""
    typed = F.concat(F.lit(" Acme+"), F.col("p_brand"), F.lit(":"), F.col("p_type"), F.lit(", Asm"))
    return v.part.select(
        "p_partkey", json_pointer_escape(F.concat("p_name", F.lit("~/"), "p_brand")).alias("pointer"),
        normalize_subject(typed).alias("normal"), subject_valid(F.concat(F.lit("acme."), F.replace("p_brand", F.lit("#"), F.lit("_")))).alias("valid"),
        subject_valid("p_name").alias("name_valid"),
    )


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Publish conformance of a whole message table: messages per outcome, code and effective mode."""
    v = Views(configure(spark), folder)
    return _published(v).groupBy("outcome", "code", "mode").agg(F.count("*").alias("messages"))


REGISTERED["flagship_publish_report"] = flagship

"""Classifying every message on the way in and on the way out, and splitting off what is refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import parse_selector, selector_accepts, utf16_clamp
from ..session import materialize
from ..wire import ENFORCE, MONITOR, OFF, Wire
from .decoding import decode_envelopes, resolve_subjects
from .routing import QUEUE, ROUTE, resolve_consume, resolve_publish, routes_of
from .validation import judge, packed, rules_depth, rules_of

# Fixed value: longest detail text kept with a quarantined message.
MAX_DETAIL = 4096


class Registry:
    """What conformance looks things up in, prepared once per batch.

    ``subjects``: (subject, ordinal, schema_id) of each subject's latest version; ``schemas``:
    (schema_id, format, body). Each prepared table is written once, so that the planner knows its
    true size when it chooses how to join messages to it. ``rules``: those of ``schemas``, where they are
    compiled already.
    """

    def __init__(self, subjects: DataFrame, schemas: DataFrame, contracts: DataFrame, publish: DataFrame, consume: DataFrame,
                 rules: DataFrame | None = None):
        self.contracts, self.publish, self.consume = contracts, publish, consume
        self.latest = subjects.where("ordinal is not null").select("subject", F.col("ordinal").alias("tip"), "schema_id")
        rules = (rules_of(schemas) if rules is None else rules).withColumn("known", F.lit(True))
        self.rules = materialize(packed(rules), "rules")
        self.depth = rules_depth(self.rules)
        self.latest_rules = materialize(self.latest.join(self.rules, "schema_id", "left"), "latest-rules")

    def publish_routes(self, messages: DataFrame) -> DataFrame:
        return materialize(resolve_publish(messages, self.contracts, self.publish), "publish-routes")

    def consume_routes(self, messages: DataFrame) -> DataFrame:
        """Governed queues; each permitted subject carries its current tip."""
        routes = resolve_consume(messages, self.contracts, self.consume)
        refs = routes.select(*QUEUE, "contracts", "enforcement", F.posexplode("subjects").alias("pos", "ref"))
        tips = refs.join(self.latest.select(F.col("subject").alias("ref_subject"), "tip"),
                         F.col("ref.subject") == F.col("ref_subject"), "left")
        entry = F.struct("pos", F.col("ref.subject").alias("subject"), F.col("ref.selector").alias("selector"), "tip")
        whole = tips.groupBy(*QUEUE).agg(
            F.any_value("contracts").alias("contracts"),
            F.any_value("enforcement").alias("enforcement"),
            F.array_sort(F.collect_list(entry)).alias("subjects"),
        )
        return materialize(whole, "consume-routes")


def _permitted(subject: Column) -> Column:
    """The first reference of the route that names the subject."""
    return F.try_element_at(F.filter("subjects", lambda r: r["subject"] == subject), F.lit(1))


def _detail(findings: str = "findings") -> Column:
    return F.array_join(F.transform(findings, lambda f: F.concat(f["path"], F.lit(": "), f["kind"])), "; ")


_RESULT = ["outcome", "code", "detail", "mode", "contracts", "judged_subject", "judged_schema_id"]


def publish_conformance(messages: DataFrame, registry: Registry, default_mode: int = MONITOR) -> DataFrame:
    """Every published message with (outcome, code, detail, mode, contracts, judged_subject, judged_schema_id)."""
    df = routes_of(resolve_subjects(messages))
    routes = registry.publish_routes(routes_of(messages)).withColumn("governed", F.lit(True))
    df = df.join(routes, ROUTE, "left")
    governed = F.col("governed").isNotNull()
    only = F.when(F.size("subjects") == 1, F.try_element_at("subjects", F.lit(1))["subject"])
    df = df.withColumn("mode", F.coalesce("enforcement", F.lit(default_mode))).withColumn(
        "subject", F.coalesce("resolved_subject", F.when((F.col("subject_outcome") == "absent") & governed, only))
    )
    df = df.withColumn("permitted", _permitted(F.col("subject")))
    df = judge(df.join(registry.latest_rules, "subject", "left"), registry.depth)

    tip = F.col("tip")
    off = F.col("mode") == OFF
    unusable = F.col("subject_outcome") == "unusable"
    nameless = F.col("subject").isNull()
    stray = governed & F.col("permitted").isNull()
    stale = F.col("permitted").isNotNull() & ~selector_accepts(parse_selector(F.col("permitted.selector")), tip, tip)
    steps = [
        (off, "Unenforced", None),
        (unusable, "Observed", "subject_name_invalid"),
        (nameless & ~governed, "Unenforced", "envelope_subject_unresolvable"),
        (nameless, "Unenforced", "contract_subject_ambiguous"),
        (stray, "Observed", "contract_subject_not_permitted"),
        (tip.isNull(), "Unenforced", "subject_not_found"),
        (stale, "Observed", "contract_version_not_permitted"),
        *_verdict_steps(),
    ]
    return _classify(df, messages, steps, F.when(~off, F.col("subject")), F.when(~(off | stray), F.col("schema_id")))


def consume_conformance(
    messages: DataFrame, registry: Registry, default_mode: int = MONITOR, wire: Wire = Wire()
) -> DataFrame:
    """Every consumed message with (outcome, code, detail, mode, contracts, judged_subject, judged_schema_id)."""
    df = routes_of(decode_envelopes(messages, wire), QUEUE).withColumnRenamed("format", "declared")
    routes = registry.consume_routes(routes_of(messages, QUEUE)).withColumn("governed", F.lit(True))
    df = df.join(routes, QUEUE, "left").withColumn("mode", F.coalesce("enforcement", F.lit(default_mode)))
    df = df.withColumn("permitted", _permitted(F.col("subject")))
    df = judge(df.join(registry.rules, "schema_id", "left"), registry.depth)

    off = F.col("mode") == OFF
    malformed = F.col("error_code").isNotNull()
    bare = F.col("kind") == "none"
    checked = F.col("governed").isNotNull() & F.col("subject").isNotNull()
    stray = checked & F.col("permitted").isNull()
    selector = parse_selector(F.col("permitted.selector"))
    tip_unknown = (selector["kind"] == "latest") & F.col("permitted.tip").isNull()
    stale = (
        checked & F.col("ordinal").isNotNull() & ~F.coalesce(tip_unknown, F.lit(False))
        & ~selector_accepts(selector, F.col("ordinal"), F.col("permitted.tip"))
    )
    other_format = F.coalesce(F.col("declared") != F.col("format"), F.lit(False))
    steps = [
        (off, "Unenforced", None),
        (malformed, "Observed", F.col("error_code")),
        (bare, "Unenforced", None),
        (stray, "Observed", "contract_subject_not_permitted"),
        (stale, "Observed", "contract_version_not_permitted"),
        _verdict_steps()[0],
        (other_format, "Observed", "envelope_format_mismatch"),
        *_verdict_steps()[1:],
    ]
    return _classify(df, messages, steps, F.when(~off, F.col("subject")), F.when(~off, F.col("schema_id")))


def _verdict_steps() -> list[tuple]:
    verdict = F.col("verdict")
    return [
        (verdict.isNull(), "Unenforced", "schema_unresolvable"),
        (verdict == "unsupported_keyword", "Unenforced", "unsupported_keyword"),
        (verdict == "valid", "Valid", None),
        (F.lit(True), "Observed", "payload_invalid"),
    ]


def _classify(df: DataFrame, messages: DataFrame, steps: list[tuple], subject: Column, sid: Column) -> DataFrame:
    """The first step whose condition holds gives outcome and code."""
    hit = F.lit(None).cast("int")
    for i, (condition, _, _) in reversed(list(enumerate(steps))):
        hit = F.when(condition, F.lit(i)).otherwise(hit)
    df = df.withColumn("step", hit)
    step = F.col("step")
    code = None
    for i, (_, _, value) in enumerate(steps):
        code = (F if code is None else code).when(step == i, value)
    outcome = F.element_at(F.array(*[F.lit(o) for _, o, _ in steps]), step + 1)
    names = [c for c in messages.columns if c not in _RESULT]
    return df.select(
        *names,
        outcome.alias("outcome"),
        code.alias("code"),
        F.when(step == len(steps) - 1, _detail()).alias("detail"),
        "mode",
        F.coalesce("contracts", F.array().cast("array<string>")).alias("contracts"),
        subject.alias("judged_subject"),
        sid.alias("judged_schema_id"),
    )


def mark_enforced(classified: DataFrame, side: str, client_mode: int = ENFORCE) -> DataFrame:
    """What enforcement does: observed violations under ENFORCE become Blocked or Quarantined.

    A client whose own mode is OFF passes everything, whatever contracts say.
    """
    refused = {"publish": "Blocked", "consume": "Quarantined"}[side]
    hit = (F.col("outcome") == "Observed") & (F.col("mode") == ENFORCE)
    final = F.when(F.lit(client_mode == OFF), F.lit(None)).otherwise(F.when(hit, refused).otherwise(F.col("outcome")))
    return classified.withColumn("final_outcome", final)


def quarantine_split(classified: DataFrame, client_mode: int = ENFORCE, wire: Wire = Wire()) -> tuple[DataFrame, DataFrame]:
    """(pass, quarantine). Quarantined messages carry why, where and when they were stopped in their
    headers; everything else passes as it came. Messages are judged and written once, for both."""
    marked = mark_enforced(classified, "consume", client_mode)
    if not marked.isStreaming:
        marked = materialize(marked, "marked")
    hit = F.coalesce(F.col("final_outcome") == "Quarantined", F.lit(False))
    long = F.coalesce("detail", F.lit(""))
    cut = F.when(F.length(long) * 2 <= MAX_DETAIL, long).otherwise(utf16_clamp(long, MAX_DETAIL))
    detail = F.when(cut == long, long).otherwise(F.concat(cut, F.lit("… (truncated)")))
    extra = {
        "reason": F.coalesce("code", F.lit("payload_invalid")),
        "detail": detail,
        "exchange": F.coalesce("exchange", F.lit("")),
        "routing-key": F.coalesce("routing_key", F.lit("")),
        "at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"),
    }
    body = lambda v: F.struct(F.lit("string").alias("kind"), v.cast("binary").alias("bytes"))
    names = [f"{wire.prefix}-quarantine-{k}" for k in extra]
    added = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*map(body, extra.values())))
    kept = F.coalesce(
        F.map_filter("headers", lambda k, _: ~k.isin(*names)),
        F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<struct<kind:string,bytes:binary>>")),
    )
    stopped = marked.where(hit).select(
        *marked.columns, cut.alias("quarantine_detail")
    ).withColumn("headers", F.map_concat(kept, added))
    return marked.where(~hit), stopped


def decisions_of(classified: DataFrame, side: str, client_mode: int = ENFORCE) -> DataFrame:
    """The decision log other operators count: (side, outcome, code, subject, exchange, routing_key, ts, message_id)."""
    return mark_enforced(classified, side, client_mode).select(
        F.lit(side.upper()).alias("side"), F.col("final_outcome").alias("outcome"), "code",
        F.col("judged_subject").alias("subject"), "exchange", "routing_key", "ts", "message_id", "detail",
    )

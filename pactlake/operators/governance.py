"""Questions about a registry as a whole: who is hit by a change, how environments differ, who uses what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import parse_selector
from ..session import materialize
from .compatibility import PAIR, SUBJECT, Differ, compatibility_check, violations
from .routing import selector_text

# Fixed value: a service is stale when it was last seen longer ago than this.
STALE_DAYS = 30


def service_uses(services: DataFrame) -> DataFrame:
    """Services with lists to one row per use: (environment_id, service, role, subject, selector).

    Of several references to one subject only the first counts.
    """
    rows = lambda role: services.select(
        "environment_id", "service", F.lit(role).alias("role"), F.posexplode(role).alias("pos", "ref")
    )
    both = rows("produces").unionByName(rows("consumes"))
    first = both.groupBy("environment_id", "service", "role", F.col("ref.subject").alias("subject")).agg(
        F.min_by("ref.selector", "pos").alias("selector")
    )
    return first


def impact_analysis(candidates: DataFrame, uses: DataFrame, seen: DataFrame, versions: DataFrame, subjects: DataFrame,
                    policies: DataFrame, differ: Differ, now: Column) -> DataFrame:
    """Every declared consumer of every candidate: does it break, and how sure is that?

    ``candidates``: (environment_id, subject, schema_id); ``uses``: rows of :func:`service_uses`;
    ``seen``: (environment_id, service, last_seen_at). Readers pinned to the same ordinal share one
    comparison. A reader that follows latest is never broken; one whose ordinal does not exist cannot
    be judged. Rows: consumer, selector, reader_ordinal, certainty, breaks, reasons, stale.
    """
    consumers = materialize(uses.where("role = 'consumes'").select("environment_id", "service", "subject", "selector"), "uses")
    selectors = materialize(consumers.select("selector").distinct().withColumn("sel", parse_selector("selector")), "selectors")
    consumers = consumers.join(selectors, "selector", "left").drop("selector")
    readers = versions.select(*SUBJECT, F.col("ordinal").alias("reader_ordinal"), F.col("schema_id").alias("prev_id"))
    wanted = candidates.select(*SUBJECT, F.col("schema_id").alias("next_id"))
    tips = subjects.select(*SUBJECT, "latest_ordinal")
    c = consumers.join(wanted, SUBJECT).join(tips, SUBJECT, "left")
    follows = F.col("sel.kind") == "latest"
    c = c.withColumn("reader_ordinal", F.when(follows, F.col("latest_ordinal")).otherwise(F.col("sel.ordinal")))
    # Both are asked for twice: by the differ, and when its findings are given back.
    c = materialize(c.drop("latest_ordinal"), "consumers")
    asked = c.where(~follows).select(*SUBJECT, "reader_ordinal", "next_id").distinct()
    asked = asked.join(readers, [*SUBJECT, "reader_ordinal"]).join(policies.select(*SUBJECT, "content_model", "surface"), SUBJECT)
    asked = materialize(asked, "readers")
    compared = asked.join(differ(asked), PAIR)
    forward = F.filter("findings", lambda f: f["direction"] == "Forward")
    reasons = F.transform(violations(forward, F.col("surface")), lambda f: F.concat(f["path"], F.lit(" "), f["kind"]))
    judged = compared.select(*SUBJECT, "reader_ordinal", "next_id", F.array_sort(reasons).alias("reasons"))

    out = c.join(judged, [*SUBJECT, "reader_ordinal", "next_id"], "left").join(seen, ["environment_id", "service"], "left")
    certainty = F.when(follows, "FollowsLatest").when(F.col("reasons").isNull(), "Unresolvable").otherwise("Checked")
    none = F.array().cast("array<string>")
    return out.select(
        *SUBJECT,
        F.col("next_id").alias("candidate_id"),
        "service",
        selector_text(F.col("sel")).alias("selector"),
        "reader_ordinal",
        certainty.alias("certainty"),
        F.when(~follows & (F.size("reasons") > 0), True).otherwise(False).alias("breaks"),
        F.when(follows, none).otherwise(F.coalesce("reasons", none)).alias("reasons"),
        is_stale(F.col("last_seen_at"), now).alias("stale"),
    )


def impact_summary(impacts: DataFrame) -> DataFrame:
    """Per candidate: consumers, how many break, how many cannot be judged."""
    return impacts.groupBy(*SUBJECT, "candidate_id").agg(
        F.count("*").alias("consumers"),
        F.count_if("breaks").alias("breaking"),
        F.count_if(F.col("certainty") == "Unresolvable").alias("unresolvable"),
        F.count_if("stale").alias("stale"),
    )


def governing_contracts(publish: DataFrame, consume: DataFrame) -> DataFrame:
    """(subject, contract): contracts that name a subject in any binding."""
    named = lambda b: b.select("contract", F.explode("subjects").alias("r")).select("r.subject", "contract")
    return named(publish).unionByName(named(consume)).distinct()


def is_stale(last_seen: Column, now: Column) -> Column:
    return now - F.make_dt_interval(F.lit(STALE_DAYS)) > last_seen


def stale_services(services: DataFrame, now: Column) -> DataFrame:
    return services.where(is_stale(F.col("last_seen_at"), now))


def service_registry_state(reports: DataFrame) -> DataFrame:
    """Report log to one row per service: the latest report's lists, first and last seen.

    ``reports``: (environment_id, service, ts, seq, produces, consumes); ``seq`` breaks ties of ``ts``.
    """
    newest = F.max_by(F.struct("produces", "consumes"), F.struct("ts", "seq"))
    out = reports.groupBy("environment_id", "service").agg(
        newest.alias("r"), F.min("ts").alias("first_seen_at"), F.max("ts").alias("last_seen_at"), F.count("*").alias("reports")
    )
    return out.select("environment_id", "service", "r.produces", "r.consumes", "first_seen_at", "last_seen_at", "reports")


def lineage_edges(uses: DataFrame) -> DataFrame:
    """Subjects with how many services produce and consume them, and whether both sides exist.

    The producer x consumer pairs of a subject are :func:`lineage_pairs`; they multiply, so most
    questions should be asked of this table.
    """
    return uses.groupBy(*SUBJECT).agg(
        F.count_distinct(F.when(F.col("role") == "produces", F.col("service"))).alias("producers"),
        F.count_distinct(F.when(F.col("role") == "consumes", F.col("service"))).alias("consumers"),
    )


def lineage_pairs(uses: DataFrame, subjects: DataFrame) -> DataFrame:
    """(environment_id, producer, subject, consumer) for the chosen subjects (environment_id, subject)."""
    chosen = uses.join(subjects.select(*SUBJECT).distinct(), SUBJECT, "left_semi")
    side = lambda role, name: chosen.where(F.col("role") == role).select(*SUBJECT, F.col("service").alias(name)).distinct()
    return side("produces", "producer").join(side("consumes", "consumer"), SUBJECT).select(
        "environment_id", "producer", "subject", "consumer"
    )


def promotion_plan(source_env: str, target_env: str, subjects: DataFrame, versions: DataFrame, policies: DataFrame,
                   differ: Differ, chosen: DataFrame | None = None) -> DataFrame:
    """What promoting every subject of one environment into another would do.

    Actions: create, unchanged, register, await_approval, refused; a refused row has a code. ``chosen``
    (subject, ordinal) picks other versions than each subject's latest.
    """
    if source_env == target_env:
        raise ValueError("promotion_target_invalid: source and target are the same environment")
    here = lambda df, env: df.where(F.col("environment_id") == env).drop("environment_id")
    wanted = here(subjects, source_env).select("subject", F.col("latest_ordinal").alias("latest"))
    if chosen is not None:
        wanted = wanted.join(chosen.select("subject", F.col("ordinal").alias("asked")), "subject")
        wanted = wanted.select("subject", F.col("asked").alias("ordinal"))
    else:
        wanted = wanted.withColumnRenamed("latest", "ordinal")
    source = wanted.join(here(versions, source_env).select("subject", "ordinal", "schema_id", "status"), ["subject", "ordinal"], "left")
    target = here(subjects, target_env).select("subject", F.lit(True).alias("exists"), F.col("latest_ordinal").alias("target_ordinal"))
    tips = here(versions, target_env).select("subject", F.col("ordinal").alias("target_ordinal"), F.col("schema_id").alias("target_id"))
    both = source.join(target, "subject", "left").join(tips, ["subject", "target_ordinal"], "left")
    proposals = both.where("status = 'Active' and exists").select(F.lit(target_env).alias("environment_id"), "subject", "schema_id")
    verdicts, _ = compatibility_check(proposals, versions.where(F.col("environment_id") == target_env), policies, differ)
    judged = both.join(verdicts.select("subject", "schema_id", "compatible", "violations"), ["subject", "schema_id"], "left")
    code = (
        F.when(F.col("schema_id").isNull(), "version_not_found")
        .when(F.col("status") != "Active", "promotion_source_not_active")
        .when(F.col("exists") & ~F.coalesce(F.col("schema_id") == F.col("target_id"), F.lit(False)) & F.col("compatible").isNull(), "not_comparable")
    )
    action = (
        F.when(code.isNotNull(), "refused")
        .when(F.col("exists").isNull(), "create")
        .when(F.col("schema_id") == F.col("target_id"), "unchanged")
        .when(F.col("compatible"), "register")
        .otherwise("await_approval")
    )
    return judged.select(
        "subject", F.col("ordinal").alias("source_ordinal"), "target_ordinal", "schema_id", action.alias("action"), code.alias("code"),
        F.coalesce("violations", F.lit(0)).alias("violations"),
    )


def environment_drift(a: str, b: str, subjects: DataFrame, versions: DataFrame) -> DataFrame:
    """Subjects only in ``a``, only in ``b``, or with different latest schemas."""

    def side(env: str, name: str) -> DataFrame:
        s = subjects.where(F.col("environment_id") == env).select("environment_id", "subject", F.col("latest_ordinal").alias("ordinal"))
        v = versions.where(F.col("environment_id") == env).select("environment_id", "subject", "ordinal", "schema_id")
        joined = s.join(v, ["environment_id", "subject", "ordinal"], "left")
        return joined.select("subject", F.lit(True).alias(f"in_{name}"), F.col("ordinal").alias(f"{name}_ordinal"), F.col("schema_id").alias(f"{name}_id"))

    both = side(a, "a").join(side(b, "b"), "subject", "full_outer")
    state = (
        F.when(F.col("in_b").isNull(), "only_a").when(F.col("in_a").isNull(), "only_b")
        .when(~F.col("a_id").eqNullSafe(F.col("b_id")), "differs")
    )
    return both.select("subject", state.alias("state"), "a_ordinal", "b_ordinal", "a_id", "b_id").where("state is not null")


# --- usage and overview -------------------------------------------------------------------------

# Limits per tier; none means unlimited.
PLANS = {
    "FREE": {"environments": 1, "subjects": 10, "seats": 3, "versions_per_month": 100},
    "TEAM": {"environments": 3, "subjects": 100, "seats": 15, "versions_per_month": 1_000},
    "BUSINESS": {"environments": 10, "subjects": 1_000, "seats": 100, "versions_per_month": 10_000},
    "ENTERPRISE": {"environments": None, "subjects": None, "seats": None, "versions_per_month": None},
}
METERS = ("environments", "subjects", "seats", "versions_per_month")


def usage_meter(environments: DataFrame, subjects: DataFrame, memberships: DataFrame, versions: DataFrame, now: Column) -> DataFrame:
    """Per tenant: environments, subjects, seats, and versions registered since the month began (UTC).

    Every input has a ``tenant_id``; tenants with none of a thing count 0.
    """
    month = F.date_trunc("month", now)
    tables = {
        "environments": environments,
        "subjects": subjects,
        "seats": memberships,
        "versions_per_month": versions.where(F.col("registered_at") >= month),
    }
    counts = None
    for meter, table in tables.items():
        one = table.groupBy("tenant_id").agg(F.count("*").alias("n")).select("tenant_id", F.lit(meter).alias("meter"), "n")
        counts = one if counts is None else counts.unionByName(one)
    return counts.groupBy("tenant_id").agg(
        *[F.coalesce(F.sum(F.when(F.col("meter") == m, F.col("n"))), F.lit(0)).alias(m) for m in METERS]
    )


def plan_limit_check(usage: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(tenant_id, meter, used, limit, allowed): may the tenant create one more?

    ``subscriptions``: (tenant_id, tier, status). Without a subscription, or under a plan without that
    limit, everything is allowed; a cancelled one allows nothing.
    """
    stacked = usage.select(
        "tenant_id",
        F.explode(F.array(*[F.struct(F.lit(m).alias("meter"), F.col(m).alias("used")) for m in METERS])).alias("u"),
    ).select("tenant_id", "u.*")
    limit = F.lit(None).cast("int")
    for tier, limits in PLANS.items():
        for meter, n in limits.items():
            if n is not None:
                limit = F.when((F.upper("tier") == tier) & (F.col("meter") == meter), F.lit(n)).otherwise(limit)
    joined = stacked.join(subscriptions.select("tenant_id", "tier", "status"), "tenant_id", "left").withColumn("plan_limit", limit)
    cancelled = F.coalesce(F.upper("status") == "CANCELLED", F.lit(False))
    allowed = ~cancelled & (F.col("plan_limit").isNull() | (F.col("used") < F.col("plan_limit")))
    return joined.select(
        "tenant_id", "meter", "used", F.when(cancelled, 0).otherwise(F.col("plan_limit")).alias("plan_limit"), allowed.alias("allowed")
    )


def registry_overview(subjects: DataFrame, versions: DataFrame) -> DataFrame:
    """One row: how many subjects, versions and versions awaiting approval."""
    s = subjects.agg(F.count("*").alias("subjects"), F.count_if(F.col("latest_ordinal").isNull()).alias("without_latest"))
    v = versions.agg(F.count("*").alias("versions"), F.count_if(F.col("status") == "AwaitingApproval").alias("pending"))
    both = s.unionByName(v, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def recent_subjects(subjects: DataFrame, versions: DataFrame, limit: int) -> DataFrame:
    """The subjects whose latest version was registered most recently; those without one come last."""
    at = versions.select(*SUBJECT, F.col("ordinal").alias("latest_ordinal"), "registered_at")
    return subjects.select(*SUBJECT, "owner", "latest_ordinal").join(at, [*SUBJECT, "latest_ordinal"], "left").orderBy(
        F.desc_nulls_last("registered_at"), *SUBJECT
    ).limit(limit)


def subject_search(subjects: DataFrame, text: str) -> DataFrame:
    """Subjects whose name or owner contains the text, whatever its case; no text finds all."""
    wanted = text.strip().lower()
    hit = F.contains(F.lower("subject"), F.lit(wanted)) | F.contains(F.lower("owner"), F.lit(wanted))
    return subjects.where(hit) if wanted else subjects


def audit_query(audit: DataFrame, environment: str | None = None, action: str | None = None, target: str | None = None,
                since=None, until=None, limit: int | None = None) -> DataFrame:
    """Audit entries, newest first. Filters are optional; 100 rows by default."""
    if limit is not None and limit < 1:
        raise ValueError("audit_filter_invalid: limit must be positive")
    if since is not None and until is not None and since > until:
        raise ValueError("audit_filter_invalid: since is later than until")
    out = audit
    for column, value in (("environment_id", environment), ("action", action), ("target", target)):
        if value is not None:
            out = out.where(F.col(column) == value)
    if since is not None:
        out = out.where(F.col("at") >= F.lit(since))
    if until is not None:
        out = out.where(F.col("at") <= F.lit(until))
    return out.orderBy(F.desc("at"), F.desc("audit_id")).limit(limit or 100)


def deployment_trail(events: DataFrame, limit: int) -> DataFrame:
    return events.orderBy(F.desc("occurred_at"), F.desc("id")).limit(limit)

"""Compatibility of versions with the versions before them, for whole histories at once.

``differ`` is any function from pairs (prev_id, next_id, content_model) to pairs with ``findings``:
:func:`json_diff.diff_json_pairs`, or the Avro and Protobuf ones, bound to their catalog tables; see
:func:`by_format`. A pair that it leaves out, or gives null findings, could not be compared: it is never
taken as compatible, but makes ``compatible`` null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import pack_id, semver_key, unpack_id
from ..session import materialize
from ..wire import DEFAULT_MODE, DEFAULT_SURFACE
from .running import before

Differ = Callable[[DataFrame], DataFrame]
SUBJECT = ["environment_id", "subject"]
PAIR = ["prev_id", "next_id", "content_model"]
#: Ordinals of a subject that one row lists when ordinals are looked up.
LISTED = 512


def effective_policy(subjects: DataFrame, environments: DataFrame) -> DataFrame:
    """Each subject's mode and surface: its own, else its environment's, else the built-in default.

    A subject that sets only one of the two is treated as setting none, since a policy is a pair.
    """
    both = subjects.join(environments, "environment_id", "left")
    own = F.col("mode").isNotNull() & F.col("surface").isNotNull()
    theirs = F.col("default_mode").isNotNull() & F.col("default_surface").isNotNull()
    pick = lambda a, b, d: F.when(own, F.col(a)).when(theirs, F.col(b)).otherwise(F.lit(d))
    return both.select(
        *SUBJECT,
        "content_model",
        pick("mode", "default_mode", DEFAULT_MODE).alias("mode"),
        pick("surface", "default_surface", DEFAULT_SURFACE).alias("surface"),
    )


def by_format(schemas: DataFrame, differs: dict[str, Differ]) -> Differ:
    """One differ for a catalog (schema_id, format) of several formats.

    A pair goes to its format's differ; pairs of two formats, of unknown schemas and of formats without a
    differ get null findings.
    """

    def differ(pairs: DataFrame) -> DataFrame:
        side = lambda s: schemas.select(F.col("schema_id").alias(s), F.col("format").alias(f"{s}_format")).distinct()
        asked = pairs.select(*PAIR).distinct()
        known = asked.join(side("prev_id"), "prev_id", "left").join(side("next_id"), "next_id", "left")
        same = known.where("prev_id_format = next_id_format")
        found = None
        for name, one in differs.items():
            part = one(same.where(F.col("prev_id_format") == name).select(*PAIR)).select(*PAIR, "findings")
            found = part if found is None else found.unionByName(part)
        return asked.join(found, PAIR, "left") if found is not None else asked.withColumn("findings", F.lit(None))

    return differ


def applicable(findings: Column, mode: Column) -> Column:
    """The findings a mode looks at."""
    return F.filter(
        findings,
        lambda f: (mode.startswith("BACKWARD") & (f["direction"] == "Backward"))
        | (mode.startswith("FORWARD") & (f["direction"] == "Forward"))
        | mode.startswith("FULL"),
    )


def violations(divergences: Column, surface: Column) -> Column:
    return F.filter(divergences, lambda f: f["surface"] <= surface)


def bump_of(has_priors: Column, mode: Column, n_violations: Column, n_divergences: Column) -> Column:
    return (
        F.when(~has_priors | (mode == "NONE"), "None")
        .when(n_violations > 0, "Major")
        .when(n_divergences > 0, "Minor")
        .otherwise("Patch")
    )


def is_transitive(mode: Column) -> Column:
    return mode.endswith("_TRANSITIVE")


def compatibility_check(proposals: DataFrame, versions: DataFrame, policies: DataFrame, differ: Differ) -> tuple[DataFrame, DataFrame]:
    """Proposals (environment_id, subject, schema_id) against prior Active versions.

    Returns (verdicts, changes). A verdict has compatible, bump and counts; a change is one
    divergence with the ordinal it conflicts with and whether it violates the policy.
    """
    wanted = proposals.select(*SUBJECT, F.col("schema_id").alias("next_id")).distinct()
    judged = wanted.join(policies, SUBJECT)
    active = versions.where("status = 'Active'").select(*SUBJECT, "ordinal", F.col("schema_id").alias("prev_id"))
    # One-step modes meet the tip only, so histories are joined for transitive subjects alone.
    tips = active.groupBy(*SUBJECT).agg(F.max(F.struct("ordinal", "prev_id")).alias("tip")).select(*SUBJECT, "tip.ordinal", "tip.prev_id")
    on = judged.where("mode <> 'NONE'")
    priors = on.where(~is_transitive(F.col("mode"))).join(tips, SUBJECT).unionByName(on.where(is_transitive(F.col("mode"))).join(active, SUBJECT))
    compared = priors.join(differ(priors), PAIR, "left")
    divergences = applicable(F.col("findings"), F.col("mode"))
    changes = compared.select(
        *SUBJECT, "next_id", F.col("ordinal").alias("conflicts_with"), "surface", F.explode(divergences).alias("f")
    ).select(
        *SUBJECT, F.col("next_id").alias("schema_id"), "conflicts_with", "f.path", "f.kind", "f.direction",
        F.col("f.surface").alias("surface"), "f.member", (F.col("f.surface") <= F.col("surface")).alias("violation"),
    )
    sized = lambda c: F.when(c.isNotNull(), F.size(c)).otherwise(0)
    n = compared.select(
        *SUBJECT, "next_id",
        sized(divergences).alias("n_divergences"),
        sized(violations(divergences, F.col("surface"))).alias("n_violations"),
        F.col("findings").isNull().cast("int").alias("open"),
    ).groupBy(*SUBJECT, "next_id").agg(
        F.count("*").alias("compared"), F.sum("n_divergences").alias("divergences"), F.sum("n_violations").alias("violations"),
        F.sum("open").alias("open"),
    )
    out = judged.join(n, [*SUBJECT, "next_id"], "left").na.fill(0, ["compared", "divergences", "violations", "open"])
    verdicts = out.select(
        *SUBJECT, F.col("next_id").alias("schema_id"), "mode", "surface", "compared", "divergences", "violations",
        # A violation is one whatever else could not be compared; without one, what is open stays open.
        F.when(F.col("violations") > 0, False).when(F.col("open") == 0, True).alias("compatible"),
        F.when((F.col("violations") > 0) | (F.col("open") == 0), bump_of(F.col("compared") > 0, F.col("mode"), F.col("violations"), F.col("divergences"))).alias("bump"),
    )
    return verdicts, changes


def _ids(pairs: DataFrame, how: Callable[[str], Column]) -> DataFrame:
    return pairs.withColumns({c: how(c) for c in PAIR[:2]})


def _packed(pairs: DataFrame) -> DataFrame:
    return _ids(pairs, pack_id)


def _unpacked(pairs: DataFrame) -> DataFrame:
    return _ids(pairs, unpack_id)


def compatibility_audit(versions: DataFrame, policies: DataFrame, differ: Differ) -> DataFrame:
    """The check replayed over every version: (environment_id, subject, ordinal, schema_id, mode,
    compatible, bump, conflicts_with). ``conflicts_with`` is the earliest prior version violated.

    One-step modes look at the Active version just before. Transitive modes look at all of them, but
    a schema that several versions share is compared once: for a given later schema only the first
    ordinal of each violated earlier schema matters. Versions are joined with their policies and priors once,
    and all pairs are compared at once; of their findings only the surfaces on either side go on. Ids travel packed.
    """
    listed = versions.select(*SUBJECT, "ordinal", pack_id("schema_id").alias("schema_id"), (F.col("status") == "Active").alias("active"))
    v = listed.join(policies, SUBJECT)
    is_one = (F.col("mode") != "NONE") & ~is_transitive(F.col("mode"))
    stepped = before(v.where(is_one), SUBJECT, "ordinal", "prior", F.when(F.col("active"), F.struct("ordinal", "schema_id")), of=listed).select(
        *v.columns, F.col("prior.ordinal").alias("prior"), F.col("prior.schema_id").alias("prev_id"),
    )
    steps = stepped.unionByName(v.where(~is_one), allowMissingColumns=True).withColumnRenamed("schema_id", "next_id")
    steps = materialize(steps, "steps")
    one, t = steps.where(is_one), steps.where(is_transitive(F.col("mode")))
    off = steps.where("mode = 'NONE'").select(
        *SUBJECT, "ordinal", unpack_id("next_id").alias("schema_id"), "mode", F.lit(True).alias("compatible"), F.lit("None").alias("bump"),
        F.lit(None).cast("int").alias("conflicts_with"),
    )
    earlier = t.where("active").groupBy(*SUBJECT, F.col("next_id").alias("prev_id")).agg(F.min("ordinal").alias("since"))
    later = t.groupBy(*SUBJECT, "next_id", "content_model", "mode", "surface").agg(F.max("ordinal").alias("until"))
    pairs = materialize(later.join(earlier, SUBJECT).where("since < until and prev_id <> next_id").drop("until"), "pairs")

    asked = one.where("prev_id is not null").select(*PAIR).unionByName(pairs.select(*PAIR))
    reach = F.array_distinct(F.transform("findings", lambda f: F.struct(f["direction"].alias("direction"), f["surface"].alias("surface"))))
    verdicts = materialize(_packed(differ(_unpacked(asked))).select(*PAIR, reach.alias("findings")).where("findings is not null"), "verdicts")
    divergences = applicable(F.col("findings"), F.col("mode"))

    compared = one.where("prev_id is not null").join(verdicts, PAIR, "left").unionByName(one.where("prev_id is null"), allowMissingColumns=True)
    bad = F.size(violations(divergences, F.col("surface")))
    open_ = F.col("prior").isNotNull() & F.col("findings").isNull()
    one_step = compared.select(
        *SUBJECT, "ordinal", unpack_id("next_id").alias("schema_id"), "mode",
        F.when(~open_, ~F.coalesce(bad > 0, F.lit(False))).alias("compatible"),
        F.when(~open_, bump_of(F.col("prior").isNotNull(), F.col("mode"), bad, F.size(divergences))).alias("bump"),
        F.when(bad > 0, F.col("prior")).alias("conflicts_with"),
    )

    judged = pairs.join(verdicts, PAIR, "left").select(
        *SUBJECT, "next_id", "since", (F.size(violations(divergences, F.col("surface"))) > 0).alias("bad"),
        (F.size(divergences) > 0).alias("diverges"), F.col("findings").isNull().alias("open"),
    ).where("bad or diverges or open")
    first = judged.groupBy(*SUBJECT, "next_id").agg(
        F.min(F.when(F.col("bad"), F.col("since"))).alias("first_violation"),
        F.min(F.when(F.col("diverges"), F.col("since"))).alias("first_divergence"),
        F.min(F.when(F.col("open"), F.col("since"))).alias("first_open"),
    )
    starts = earlier.groupBy(*SUBJECT).agg(F.min("since").alias("start"))
    all_steps = t.join(first, [*SUBJECT, "next_id"], "left").join(starts, SUBJECT, "left")
    hit = lambda c: F.coalesce(F.col(c) < F.col("ordinal"), F.lit(False))
    transitive = all_steps.select(
        *SUBJECT, "ordinal", unpack_id("next_id").alias("schema_id"), "mode",
        F.when(hit("first_violation"), False).when(~hit("first_open"), True).alias("compatible"),
        F.when(
            hit("first_violation") | ~hit("first_open"),
            bump_of(hit("start"), F.col("mode"), hit("first_violation").cast("int"), hit("first_divergence").cast("int")),
        ).alias("bump"),
        F.when(hit("first_violation"), F.col("first_violation")).alias("conflicts_with"),
    )
    return one_step.unionByName(transitive).unionByName(off)


def _sides(requests: DataFrame, versions: DataFrame, policies: DataFrame, block: int = LISTED) -> DataFrame:
    """Requests with ``content_model`` and the packed ids of both ordinals, written.

    Versions are listed by blocks of ordinals, one row a block, so that a request whose ordinals lie in one block
    looks both up there; the second one of the others is looked up in a further join.
    """
    key = [*SUBJECT, "_block"]
    of = lambda o: F.floor(F.col(o) / block)
    at = lambda o: F.try_element_at("ids", F.col(o).cast("long"))
    rows = versions.where("ordinal is not null").select(
        *SUBJECT, of("ordinal").alias("_block"), F.col("ordinal").cast("long").alias("ordinal"), pack_id("schema_id").alias("id")
    ).repartition(*key)
    # As structs, since a collected list leaves nulls out.
    ids = rows.groupBy(*key, "ordinal").agg(F.collect_list(F.struct("id")).alias("ids"))
    blocks = ids.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("ordinal", "ids"))).alias("ids"))

    asked = requests.select(*SUBJECT, "a", "b").join(policies.select(*SUBJECT, "content_model"), SUBJECT)
    near, later = of("a") == of("b"), F.array(F.struct(F.lit(None).cast("binary").alias("id")))
    first = asked.withColumn("_block", of("a")).join(blocks, key).select(
        *SUBJECT, "a", "b", "content_model", near.alias("near"), F.when(near, at("b")).otherwise(later).alias("next"), F.explode(at("a")).alias("prev")
    )
    first = materialize(first.select(
        *SUBJECT, "a", "b", "content_model", "near", F.col("prev.id").alias("prev_id"), F.explode("next.id").alias("next_id")
    ), "sides")
    found, apart = first.where("near").drop("near"), first.where("not near").drop("near", "next_id")
    if apart.isEmpty():
        return found
    second = apart.withColumn("_block", of("b")).join(blocks, key).withColumn("next", F.explode(at("b")))
    return found.unionByName(materialize(second.select(*apart.columns, F.col("next.id").alias("next_id")), "sides"))


def diff_versions(requests: DataFrame, versions: DataFrame, policies: DataFrame, differ: Differ) -> DataFrame:
    """Requests (environment_id, subject, a, b): every divergence between two ordinals, both directions.

    One row per divergence; a pair without any gives one row with null path. ``identical`` tells
    equal schemas from different schemas that do not diverge; the kind of a pair that could not be
    compared is ``not_comparable``. Requests are read once.
    """
    both = _sides(requests, versions, policies)
    compared = both.join(_packed(differ(_unpacked(both.where("prev_id <> next_id")))), PAIR, "left")
    return compared.select(
        *SUBJECT, "a", "b", (F.col("prev_id") == F.col("next_id")).alias("identical"), "findings", F.explode_outer("findings").alias("f")
    ).select(
        *SUBJECT, "a", "b", "identical", "f.path",
        F.when(~F.col("identical") & F.col("findings").isNull(), "not_comparable").otherwise(F.col("f.kind")).alias("kind"),
        "f.direction", "f.surface", "f.member",
    )


def suggest_semver(versions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Next label of each checked subject: the highest label not Rejected, bumped by the verdict."""
    key = semver_key("semver")
    labelled = versions.where("status <> 'Rejected'").withColumn("key", key).where("key is not null")
    top = labelled.groupBy(*SUBJECT).agg(F.max("key").alias("key"))
    k = F.col("key")
    zero = k.isNull() | ((k["major"] == 0) & (k["minor"] == 0) & (k["patch"] == 0) & k["is_release"])
    label = lambda *p: F.concat_ws(".", *[(x if isinstance(x, Column) else F.lit(x)).cast("string") for x in p])
    return verdicts.join(top, SUBJECT, "left").select(
        *verdicts.columns,
        F.when(F.col("bump").isNull() | (F.col("bump") == "None"), None)
        .when(zero, "1.0.0")
        .when(F.col("bump") == "Major", label(k["major"] + 1, 0, 0))
        .when(F.col("bump") == "Minor", label(k["major"], k["minor"] + 1, 0))
        .otherwise(label(k["major"], k["minor"], k["patch"] + 1))
        .alias("suggested_semver"),
    )


def semver_label_audit(versions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Labels that break the labelling rules, given verdicts (environment_id, subject, ordinal, compatible)."""
    live = F.col("status").isin("Active", "AwaitingApproval").alias("live")
    v = versions.where("semver is not null").select(*SUBJECT, "ordinal", "semver", live)
    v = before(v, SUBJECT, "ordinal", "previous", F.when(F.col("live"), F.col("key")), "max", work={"key": semver_key("semver")})
    k, p = F.col("key"), F.col("previous")
    falls = p.isNotNull() & (k <= p)
    short = F.when(p.isNull(), k["major"] == 0).otherwise(k["major"] <= p["major"])
    # Only what may break a rule, and which, meets the verdicts.
    held = lambda c, name: F.coalesce(c, F.lit(False)).alias(name)
    v = v.where("key is not null").select(*SUBJECT, "ordinal", "semver", held(falls, "falls"), held(short, "short")).where("falls or short")
    v = v.join(verdicts.select(*SUBJECT, "ordinal", "compatible"), [*SUBJECT, "ordinal"])
    breaking = ~F.coalesce("compatible", F.lit(True))  # what could not be compared breaks no labelling rule
    code = F.when(F.col("falls"), "semver_not_increasing").when(breaking & F.col("short"), "semver_label_understates_breakage")
    return v.withColumn("code", code).where("code is not null").select(*SUBJECT, "ordinal", "semver", "code")


def bulk_check(directory: DataFrame, versions: DataFrame, policies: DataFrame, differ: Differ) -> DataFrame:
    """A contract directory (environment_id, subject, format, schema_id) against the registry.

    One status per file: skipped (not JSON), new (no such subject), ok, broken or not_comparable.
    """
    if directory.isEmpty():
        raise ValueError("contracts_dir_empty: nothing to check")
    json_files = directory.where("format = 'json'")
    verdicts, _ = compatibility_check(json_files, versions, policies, differ)
    known = policies.select(*SUBJECT, F.lit(True).alias("known"))
    out = directory.join(known, SUBJECT, "left").join(
        verdicts.select(*SUBJECT, "schema_id", "compatible", "violations", "bump"), [*SUBJECT, "schema_id"], "left"
    )
    status = (
        F.when(F.col("format") != "json", "skipped")
        .when(F.col("known").isNull(), "new")
        .when(F.col("compatible").isNull(), "not_comparable")
        .when(F.col("compatible"), "ok")
        .otherwise("broken")
    )
    return out.select(*SUBJECT, "format", "schema_id", status.alias("status"), F.coalesce("violations", F.lit(0)).alias("violations"))


def push_plan(directory: DataFrame, versions: DataFrame, latest: DataFrame, policies: DataFrame, differ: Differ) -> DataFrame:
    """What pushing the directory would do: would-create, unchanged, would-register, would-await-approval,
    or not_comparable, which nothing is done about.

    ``latest`` is (environment_id, subject, schema_id) of each subject's tip; non-JSON files are skipped.
    """
    checked = bulk_check(directory, versions, policies, differ)
    tips = latest.select(*SUBJECT, F.col("schema_id").alias("tip_id"))
    action = (
        F.when(F.col("status") == "skipped", "skipped")
        .when(F.col("status") == "new", "would-create")
        .when(F.col("schema_id") == F.col("tip_id"), "unchanged")
        .when(F.col("status") == "not_comparable", "not_comparable")
        .when(F.col("status") == "ok", "would-register")
        .otherwise("would-await-approval")
    )
    return checked.join(tips, SUBJECT, "left").select(*SUBJECT, "format", "schema_id", action.alias("action"))

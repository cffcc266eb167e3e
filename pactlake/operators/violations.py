"""Enforcement reports rolled up to violations, and the counters of enforcing clients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import blank, strip, utf16_clamp, violation_fingerprint

# Longest stored texts, in UTF-16 units.
MAX_ROUTE, MAX_CODE, MAX_DETAIL, MAX_REPORTER = 512, 64, 1024, 128
KEY = ["environment_id", "side", "route", "subject", "code"]


def _clamped(c: str, limit: int) -> Column:
    return utf16_clamp(strip(c), limit)


def clean_reports(reports: DataFrame) -> DataFrame:
    """Reports as they are stored, with ``usable`` telling which could open a violation.

    The fingerprint is made of the whole trimmed texts; only what is shown is clamped. An existing violation
    also takes reports whose count is below one.
    """
    side = F.upper(strip("side"))
    ok_side = side.isin("PUBLISH", "CONSUME")
    usable = ok_side & ~blank("route") & ~blank("code")
    out = reports.select(
        "ts", "seq", "environment_id",
        F.when(ok_side, side).alias("side"),
        _clamped("route", MAX_ROUTE).alias("route"),
        strip("route").alias("full_route"),
        strip("code").alias("full_code"),
        F.when(~blank("subject"), strip("subject")).alias("subject"),
        _clamped("code", MAX_CODE).alias("code"),
        F.when(~blank("detail"), _clamped("detail", MAX_DETAIL)).alias("detail"),
        F.when(~blank("reported_by"), _clamped("reported_by", MAX_REPORTER)).alias("reported_by"),
        "occurrences",
        F.coalesce(usable, F.lit(False)).alias("usable"),
    )
    return out.withColumn("fingerprint", violation_fingerprint(F.col("environment_id"), F.col("side"), F.col("full_route"), F.col("subject"), F.col("full_code"))).drop("full_route", "full_code")


def violation_rollup(reports: DataFrame) -> DataFrame:
    """One row per fingerprint: first and last seen, occurrences, newest non-blank detail and reporter.

    A violation opens with its first report that counts at least one occurrence; what was reported
    before that is rejected. Later reports below one still refresh detail, reporter and last seen.
    """
    clean = clean_reports(reports).where("usable")
    order = F.struct("ts", "seq")
    newest = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(order.alias("at"), c)))
    state = clean.groupBy("fingerprint", *KEY).agg(
        F.min(F.when(F.col("occurrences") >= 1, order)).alias("opened"),
        F.max("ts").alias("last_seen_at"),
        F.sum(F.greatest("occurrences", F.lit(0))).alias("occurrences"),
        newest("detail").alias("d"),
        newest("reported_by").alias("r"),
    )
    # When even the newest text is older than the opening, no accepted report had one.
    after = lambda c, text: F.when(F.col(f"{c}.at") >= F.col("opened"), F.col(f"{c}.{text}"))
    return state.where("opened is not null").select(
        "fingerprint", *KEY, F.col("opened.ts").alias("first_seen_at"), "last_seen_at", "occurrences",
        F.coalesce(after("d", "detail"), F.lit("")).alias("detail"),
        F.coalesce(after("r", "reported_by"), F.lit("unknown")).alias("reported_by"),
    )


def report_outcomes(reports: DataFrame) -> DataFrame:
    """(environment_id, accepted, opened, rejected) of a batch of reports against an empty store."""
    clean = clean_reports(reports)
    order = F.struct("ts", "seq")
    start = clean.where("usable and occurrences >= 1").groupBy("fingerprint").agg(F.min(order).alias("opened"))
    joined = clean.join(start, "fingerprint", "left")
    accepted = F.coalesce(F.col("usable") & (order >= F.col("opened")), F.lit(False))
    return joined.groupBy("environment_id").agg(
        F.count_if(accepted).alias("accepted"),
        F.count_if(accepted & (order == F.col("opened"))).alias("opened"),
        F.count_if(~accepted).alias("rejected"),
    )


def top_violations(violations: DataFrame, environment: str, limit: int) -> DataFrame:
    """Newest first. A limit that is not positive is an error; a caller pages by ``last_seen_at``."""
    if limit < 1:
        raise ValueError("limit must be positive")
    return violations.where(F.col("environment_id") == environment).orderBy(
        F.desc("last_seen_at"), "fingerprint"
    ).limit(limit)


def enforcement_counters(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("side", "outcome").agg(F.count("*").alias("messages"))


def recent_decisions(decisions: DataFrame, limit: int = 32) -> DataFrame:
    """The latest ``limit`` decisions of either side that were not simply valid."""
    return decisions.where("outcome <> 'Valid'").orderBy(F.desc("ts"), F.desc("message_id"), "side").limit(limit)


def violation_flush_windows(decisions: DataFrame, every: str, reporter: str = "reported_by", keys: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): counts per key, flush window and reporter.

    All keys are kept by default. With ``keys``, a reporter keeps that many distinct keys of a window in
    order of arrival, and messages of later new keys are only counted. Keys are counted before they are ranked, so a window that holds a third
    of all messages ranks its distinct keys, not its messages, and ranking prunes before the shuffle.
    """
    key = ["side", "route", "subject", "code", "detail"]
    place = ["window_start", "reporter"]
    counted = decisions.groupBy(
        F.window("ts", every)["start"].alias("window_start"), F.col(reporter).alias("reporter"), *key
    ).agg(F.count("*").alias("n"), F.min(F.struct("ts", "message_id")).alias("first"))
    kept = counted
    if keys is not None:
        ranked = counted.withColumn("rank", F.row_number().over(W.partitionBy(*place).orderBy("first")))
        kept = ranked.where(F.col("rank") <= keys).drop("rank")
    kept = kept.drop("first")
    all_of = counted.groupBy(*place).agg(F.sum("n").alias("messages"), F.count("*").alias("keys"))
    in_kept = kept.groupBy(*place).agg(F.sum("n").alias("kept"))
    dropped = all_of.join(in_kept, place).select(*place, "keys", (F.col("messages") - F.col("kept")).alias("dropped"))
    return kept, dropped

"""Structured Streaming jobs: conformance, quarantine, violation state, service state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.conformance import Registry, consume_conformance, publish_conformance, quarantine_split
from ..operators.violations import KEY, clean_reports
from ..wire import MONITOR, Wire

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_conformance(stream: DataFrame, registry: Callable[[], Registry], sink: Callable[[DataFrame, int], None],
                       side: str = "publish", default_mode: int = MONITOR, wire: Wire = Wire()):
    """Classify a message stream. The registry is read anew for every micro-batch, so contract and
    schema changes take effect with the next batch. ``sink`` gets (classified, batch_id) and should
    write idempotently by batch id. Returns a writer to start."""

    def run(batch: DataFrame, batch_id: int) -> None:
        if side == "publish":
            sink(publish_conformance(batch, registry(), default_mode), batch_id)
        else:
            sink(consume_conformance(batch, registry(), default_mode, wire), batch_id)

    return stream.writeStream.foreachBatch(run)


def quarantine_sink(passed: str, quarantined: str, wire: Wire = Wire()) -> Callable[[DataFrame, int], None]:
    """A sink for :func:`stream_conformance` that writes both sides of the split under ``batch_id=N``.

    A batch that is run again overwrites its own folder, so each message is written once.
    """

    def write(classified: DataFrame, batch_id: int) -> None:
        kept = classified.persist()
        try:
            through, stopped = quarantine_split(kept, wire=wire)
            through.write.mode("overwrite").parquet(f"{passed}/batch_id={batch_id}")
            stopped.write.mode("overwrite").parquet(f"{quarantined}/batch_id={batch_id}")
        finally:
            kept.unpersist()

    return write


VIOLATION_STATE = (
    "opened_ts timestamp, opened_seq long, last_seen_at timestamp, occurrences long, detail string, detail_ts timestamp, "
    "detail_seq long, reported_by string, reported_ts timestamp, reported_seq long"
)
VIOLATION_KEY = "fingerprint string, environment_id string, side string, route string, subject string, code string"
VIOLATION_OUT = VIOLATION_KEY + (
    ", first_seen_at timestamp, last_seen_at timestamp, occurrences long, detail string, reported_by string, opened boolean"
)


def _columns(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _combine_reports(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One partial row per fingerprint and Arrow batch, so a hot fingerprint is small when it is shuffled."""
    for pdf in batches:
        s = pdf.sort_values(["ts", "seq"])
        by = s.groupby("fingerprint", sort=False)
        out = s.drop_duplicates("fingerprint").set_index("fingerprint")[KEY]
        pick = lambda rows, keep, names: rows.drop_duplicates("fingerprint", keep=keep).set_index("fingerprint").rename(
            columns=names)[list(names.values())]
        opened = pick(s[s.occurrences >= 1], "first", {"ts": "opened_ts", "seq": "opened_seq"})
        counted = s.occurrences.clip(lower=0).groupby(s.fingerprint).sum()
        out = out.join(opened).join(by.ts.max().rename("last_seen_at")).join(counted)
        for text, at in (("detail", "detail"), ("reported_by", "reported")):
            names = {text: text, "ts": f"{at}_ts", "seq": f"{at}_seq"}
            out = out.join(pick(s[s[text].notna()], "last", names))
        ints = {c: "Int64" for c in ("opened_seq", "occurrences", "detail_seq", "reported_seq")}
        yield out.reset_index().astype(ints)[_columns(f"{VIOLATION_KEY}, {VIOLATION_STATE}")]


def _clean(value):
    return None if pd.isna(value) else value


class ViolationState(StatefulProcessor):
    """Running state of one fingerprint; ``opened`` is true in the one row that opens it."""

    def __init__(self, forget_ms: int | None = None) -> None:
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("violation", VIOLATION_STATE, self.forget_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = _columns(VIOLATION_STATE)
        old = dict(zip(names, self.state.get())) if self.state.exists() else dict.fromkeys(names)
        now, identity = dict(old), None
        for batch in rows:
            for r in batch.to_dict("records"):
                r = {k: _clean(v) for k, v in r.items()}
                identity = identity or [r[k] for k in KEY]
                now["last_seen_at"] = max(filter(None, (now["last_seen_at"], r["last_seen_at"])))
                now["occurrences"] = (now["occurrences"] or 0) + r["occurrences"]
                self._take(now, r, ("opened_ts", "opened_seq"), min)
                self._take(now, r, ("detail_ts", "detail_seq", "detail"), max)
                self._take(now, r, ("reported_ts", "reported_seq", "reported_by"), max)
        self.state.update(tuple(now[n] for n in names))
        start = now["opened_ts"], now["opened_seq"]
        if start[0] is None:
            return
        text = lambda c, at, none: (
            now[c] if now[f"{at}_ts"] is not None and (now[f"{at}_ts"], now[f"{at}_seq"]) >= start else none
        )
        row = [
            key[0], *identity, start[0], now["last_seen_at"], now["occurrences"],
            text("detail", "detail", ""), text("reported_by", "reported", "unknown"), old["opened_ts"] is None,
        ]
        yield pd.DataFrame([row], columns=_columns(VIOLATION_OUT))

    @staticmethod
    def _take(now: dict, row: dict, names: tuple, better) -> None:
        mine, theirs = (tuple(d[n] for n in names) for d in (now, row))
        known = [t for t in (mine, theirs) if t[0] is not None]
        if known:
            now.update(zip(names, better(known)))

    def close(self) -> None:
        pass


def stream_violation_rollup(reports: DataFrame, forget_ms: int | None = None) -> DataFrame:
    """Violation state as a stream of updates (output mode ``update``), keyed by fingerprint.

    Each update is the row :func:`violations.violation_rollup` would give for all reports so far,
    whatever order they came in. Reports are combined before they are shuffled. A sink that writes each batch
    under its number sees ``opened`` once, restarts included. State is kept for ever by default; with
    ``forget_ms`` a fingerprint unseen for that long (processing time) is forgotten, and would open anew;
    such a job keeps running on processing time, so start it with an interval or ``once``, not ``availableNow``.
    """
    clean = clean_reports(reports).where("usable").drop("usable")
    partial = clean.mapInPandas(_combine_reports, f"{VIOLATION_KEY}, {VIOLATION_STATE}")
    return partial.groupBy("fingerprint").transformWithStateInPandas(
        statefulProcessor=ViolationState(forget_ms), outputStructType=VIOLATION_OUT, outputMode="Update",
        timeMode="None" if forget_ms is None else "ProcessingTime",
    )


def stream_service_state(reports: DataFrame, table: str, merged: Callable[[int], None] = lambda batch_id: None):
    """Service reports to a table of current rows: each micro-batch merges into ``table`` (a folder).

    Versions of the table alternate by batch id, so a batch that fails and runs again starts from the
    version before it. ``merged`` is told each version that is complete. Returns a writer to start.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        order = F.struct("ts", "seq")
        newest = F.max(F.struct(order.alias("at"), "produces", "consumes"))
        fresh = batch.groupBy("environment_id", "service").agg(
            newest.alias("newest"), F.min("ts").alias("first_seen_at"), F.max("ts").alias("last_seen_at")
        )
        if batch_id > 0:
            old = spark.read.parquet(f"{table}/version={batch_id - 1}")
            fresh = fresh.unionByName(old).groupBy("environment_id", "service").agg(
                F.max("newest").alias("newest"), F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at")
            )
        fresh.write.mode("overwrite").parquet(f"{table}/version={batch_id}")
        merged(batch_id)

    return reports.writeStream.foreachBatch(merge)

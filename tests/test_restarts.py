"""Streams over several batches and restarts: flush windows, registry snapshots, violation state."""

import datetime as dt
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from pactlake.operators import conformance, violations
from pactlake.plans import queries
from pactlake.plans.queries import _flushes
from pactlake.sources import SnapshotRegistry, publish_snapshot
from pactlake.sources.derived import Views
from pactlake.streaming import stream_conformance, stream_flush_windows, stream_violation_rollup
from pactlake.streaming.windows import BUCKETS, KEY, FlushWindow

SF = "/root/testdata/sf0.001"
SCHEMA = "ts timestamp, message_id bigint, side string, route string, subject string, code string, detail string, reported_by string"


class Source:
    """A folder that files arrive in, read by a stream that is started and stopped at will."""

    def __init__(self, spark, tmp_path):
        self.spark, self.tmp, self.n = spark, tmp_path, 0

    def add(self, df, files=1):
        df.repartition(files).write.mode("append").parquet(str(self.tmp / "in"))

    def run(self, make, schema, **trigger):
        stream = self.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(self.tmp / "in"))
        query = make(stream).option("checkpointLocation", str(self.tmp / "state")).trigger(**trigger or {"availableNow": True}).start()
        query.awaitTermination()


def sink(tmp_path, fail_at=None):
    def write(batch, n):
        batch.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={n}"))
        if n == fail_at:
            raise RuntimeError("lost")

    return write


def row(day, n, code="a", reporter="r", subject="s"):
    return (dt.datetime(2024, 1, day, 12), n, "PUBLISH", "x", subject, code, "d", reporter)


def flushed(spark, tmp_path):
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    return sorted((r.window_start.day, r.reporter, r.code or "", r.n, r.kind) for r in rows)


@pytest.mark.parametrize("keys", [None, 2])
def test_windows_flush_once_and_late_rows_follow(spark, tmp_path, keys):
    source = Source(spark, tmp_path)
    make = lambda s: stream_flush_windows(s, "1 day", "1 day", keys=keys).writeStream.foreachBatch(sink(tmp_path))
    days = [
        [row(1, 1), row(1, 2), row(1, 3, "b", subject=None), row(1, 4, "c"), row(1, 5, "a", "q")],
        [row(1, 6), row(1, 7, "c"), row(5, 8), (None, 9, "PUBLISH", "x", "s", "a", "d", "r")],
        [row(1, 10), row(2, 11, "b"), row(9, 12)],
    ]
    for rows in days:  # each is a run of its own, with a restart between
        source.add(spark.createDataFrame(rows, SCHEMA))
        source.run(make, SCHEMA)
    c = (1, "r", "c", 2, "kept") if keys is None else (1, "r", "", 2, "dropped")
    want = [(1, "q", "a", 1, "kept"), (1, "r", "a", 3, "kept"), (1, "r", "b", 1, "kept"), c,
            (1, "r", "a", 1, "late"), (2, "r", "b", 1, "late"), (5, "r", "a", 1, "kept")]
    assert flushed(spark, tmp_path) == sorted(want)


class Calls:
    """A state variable in memory that counts how often it is written."""

    def __init__(self):
        self.at, self.written = {}, 0

    def updateValue(self, key, value):
        self.at[key], self.written = value, self.written + 1

    def getValue(self, key):
        return self.at.get(key)

    def containsKey(self, key):
        return key in self.at

    def iterator(self):
        return iter(self.at.items())

    def exists(self):
        return () in self.at

    def get(self):
        return self.at.get(())

    def update(self, value):
        self.updateValue((), value)

    def clear(self):
        self.at.clear()


class Handle(dict):
    def getMapState(self, name, *schema):
        return self.setdefault(name, Calls())

    getValueState = getMapState

    def registerTimer(self, at):
        self.timer = at


def test_keeping_a_window_writes_state_by_the_batch(spark):
    handle, window = Handle(), FlushWindow()
    window.init(handle)
    place = (dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2), "r", 0)
    before = SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)
    batch = lambda n: pd.DataFrame([("p", "x", None if i % 3 else "s", "a", str(i), 2, None, i) for i in range(n)], columns=[*KEY, "n", "ts", "message_id"])
    for _ in range(2):
        assert list(window.handleInputRows(place, iter([batch(3000), batch(1000)]), before)) == []
    assert sum(state.written for state in handle.values()) <= 4 * BUCKETS + 2
    out = pd.concat(window.handleExpiredTimer(place, before, None))
    assert len(out) == 3000 and out["n"].sum() == 2 * 2 * 4000 and not out.duplicated(KEY).any()
    assert set(out[out["detail"].astype(int) < 1000]["n"]) == {8} and not any(state.at for state in handle.values())


def test_flush_stream_equals_batch_in_closed_windows(spark, tmp_path):
    rows = _flushes(Views(spark, SF))
    late = (F.col("message_id") % 5 == 0) & (F.dayofmonth("ts") < 20)
    source = Source(spark, tmp_path)
    make = lambda s: stream_flush_windows(s, "5 days", "3 days", shares=4).writeStream.foreachBatch(sink(tmp_path))
    for part in (rows.where(~late & (F.dayofmonth("ts") < 15)), rows.where(~late & (F.dayofmonth("ts") >= 15)), rows.where(late)):
        source.add(part)
        source.run(make, rows.schema)
    key = ["window_start", "reporter", "side", "route", "subject", "code", "detail"]
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.where("kind = 'late'").count() > 0
    got = out.groupBy(*key).agg(F.sum("n").alias("n"))
    end = rows.agg(F.max("ts") - F.expr("interval 3 days")).first()[0]
    batch = violations.violation_flush_windows(rows, "5 days")[0].where(F.col("window_start") + F.expr("interval 5 days") <= F.lit(end)).select(*key, "n")
    assert got.count() == batch.count() > 0 and got.exceptAll(batch).count() == 0


def test_a_batch_that_fails_opens_each_violation_once(spark, tmp_path):
    reports = Views(spark, SF).violation_reports
    source = Source(spark, tmp_path)
    source.add(reports, 4)
    make = lambda fail: lambda s: stream_violation_rollup(s).writeStream.outputMode("update").foreachBatch(sink(tmp_path, fail))
    with pytest.raises(Exception, match="lost"):
        source.run(make(2), reports.schema)
    source.run(make(None), reports.schema)
    out = spark.read.parquet(str(tmp_path / "out"))
    opened = out.groupBy("fingerprint").agg(F.count_if("opened").alias("n"), F.max("occurrences").alias("occurrences"))
    batch = violations.violation_rollup(reports).select("fingerprint", "occurrences")
    assert out.select("batch").distinct().count() >= 4
    assert opened.where("n <> 1").count() == 0
    assert opened.count() == batch.count() and opened.select("fingerprint", "occurrences").exceptAll(batch).count() == 0


def test_a_violation_that_is_forgotten_opens_anew(spark, tmp_path):
    reports = Views(spark, SF).violation_reports.where("seq = 1")
    source = Source(spark, tmp_path)
    make = lambda s: stream_violation_rollup(s, forget_ms=1).writeStream.outputMode("update").foreachBatch(sink(tmp_path))
    for _ in range(2):
        source.add(reports)
        source.run(make, reports.schema, once=True)
    assert [r.opened for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [True, True]


def test_snapshots_compile_only_new_schemas(spark, tmp_path):
    v = Views(spark, SF)
    folder = str(tmp_path / "registry")
    registry = SnapshotRegistry(spark, folder)
    with pytest.raises(ValueError):
        registry()
    with pytest.raises(ValueError):
        publish_snapshot(folder, subjects=v.event_subjects)
    ids = sorted(r.schema_id for r in v.event_catalog.select("schema_id").distinct().collect())
    tables = dict(subjects=v.event_subjects, contracts=v.contracts, publish=v.publish_bindings, consume=v.consume_bindings)
    few = v.event_catalog.where(F.col("schema_id").isin(ids[:2]))
    assert publish_snapshot(folder, schemas=few, **tables) == 0
    first = registry()
    assert registry() is first and registry.compiled_last == 2
    assert publish_snapshot(folder, schemas=v.event_catalog, **tables) == 1
    assert registry() is not first and registry.compiled_last == len(ids) - 2
    assert publish_snapshot(folder, schemas=few, **tables) == 2
    assert registry().rules.count() == 2 and registry.compiled_last == 0
    (tmp_path / "registry/version=3").mkdir()  # not complete
    registry()
    assert registry.version == 2


def test_contract_change_between_batches_changes_outcomes(spark, tmp_path):
    v = Views(spark, SF)
    folder = str(tmp_path / "registry")
    registry = SnapshotRegistry(spark, folder)
    tables = dict(subjects=v.event_subjects, schemas=v.event_catalog, publish=v.publish_bindings, consume=v.consume_bindings)
    write = sink(tmp_path)
    make = lambda s: stream_conformance(s, registry, lambda df, n: write(df.select("message_id", "outcome", "mode"), n))
    source = Source(spark, tmp_path)
    for contracts in (v.contracts.limit(0), v.contracts):
        publish_snapshot(folder, contracts=contracts, **tables)
        source.add(v.messages)
        source.run(make, v.messages.schema)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.where("batch = 0 and mode <> 2").count() == 0
    whole = conformance.Registry(v.event_subjects, v.event_catalog, v.contracts, v.publish_bindings, v.consume_bindings)
    batch = conformance.publish_conformance(v.messages, whole).select("message_id", "outcome", "mode")
    got = out.where("batch = 1").drop("batch")
    assert got.where("mode <> 2").count() > 0 and got.count() == batch.count() and got.exceptAll(batch).count() == 0


def test_files_that_arrive_are_cut_in_pieces(spark, monkeypatch):
    """A batch of a large table is read by more tasks, with the same rows in the end."""
    whole = queries.REGISTERED["h3_stream_flush_windows"](spark, SF).collect()
    files, option = [], DataStreamReader.option
    monkeypatch.setattr(queries, "PIECE", 40)
    monkeypatch.setattr(DataStreamReader, "option", lambda self, k, v: (files.append(v) if k == "maxFilesPerTrigger" else None) or option(self, k, v))
    cut = queries.REGISTERED["h3_stream_flush_windows"](spark, SF).collect()
    assert min(files) > 2 and sorted(map(str, cut)) == sorted(map(str, whole))

from pyspark.sql import functions as F

from pactlake.operators import conformance, governance, violations
from pactlake.plans.queries import _registry, _service_reports
from pactlake.sources.derived import Views
from pactlake.streaming import quarantine_sink, stream_conformance, stream_service_state, stream_violation_rollup

SF = "/root/testdata/sf0.001"


def as_stream(spark, df, folder, parts, per_trigger=2):
    df.repartition(parts).write.parquet(str(folder))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", per_trigger).parquet(str(folder))


def run(writer, tmp_path):
    query = writer.option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()


def test_conformance_stream_equals_batch(spark, tmp_path):
    v = Views(spark, SF)
    stream = as_stream(spark, v.messages, tmp_path / "in", 4)
    sink = quarantine_sink(str(tmp_path / "pass"), str(tmp_path / "stop"), v.wire)
    registry = _registry(v)
    run(stream_conformance(stream, lambda: registry, sink, side="consume", wire=v.wire), tmp_path)
    batch = conformance.mark_enforced(conformance.consume_conformance(v.messages, registry, wire=v.wire), "consume")
    cols = ["message_id", "outcome", "code", "final_outcome"]
    got = spark.read.parquet(str(tmp_path / "pass")).select(cols).unionByName(spark.read.parquet(str(tmp_path / "stop")).select(cols))
    assert got.count() == batch.count() and got.exceptAll(batch.select(cols)).count() == 0
    stopped = spark.read.parquet(str(tmp_path / "stop"))
    assert stopped.count() == stopped.where("final_outcome = 'Quarantined'").count() > 0
    assert stopped.where(F.try_element_at("headers", F.lit("contract-quarantine-reason")).isNull()).count() == 0


def test_violation_stream_equals_batch(spark, tmp_path):
    reports = Views(spark, SF).violation_reports
    out = stream_violation_rollup(as_stream(spark, reports, tmp_path / "in", 6))
    run(out.writeStream.outputMode("update").format("memory").queryName("violations"), tmp_path)
    last = spark.table("violations").groupBy("fingerprint").agg(
        F.max_by(F.struct("first_seen_at", "last_seen_at", "occurrences", "detail", "reported_by"), "occurrences").alias("r"), F.count_if("opened").alias("opened")
    )
    assert last.where("opened <> 1").count() == 0
    batch = violations.violation_rollup(reports).select("fingerprint", "first_seen_at", "occurrences")
    got = last.select("fingerprint", "r.first_seen_at", "r.occurrences")
    assert got.count() == batch.count() and got.exceptAll(batch).count() == 0


def test_service_stream_equals_batch(spark, tmp_path):
    reports = _service_reports(Views(spark, SF))
    table = tmp_path / "table"
    run(stream_service_state(as_stream(spark, reports, tmp_path / "in", 4), str(table)), tmp_path)
    versions = sorted(int(p.name.split("=")[1]) for p in table.iterdir())
    got = spark.read.parquet(f"{table}/version={versions[-1]}").select("environment_id", "service", "newest.produces", "newest.consumes", "first_seen_at", "last_seen_at")
    batch = governance.service_registry_state(reports).drop("reports")
    assert len(versions) > 1 and got.count() == batch.count() and got.exceptAll(batch).count() == 0

"""Reading messages and contract directories, writing the latest schemas back as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import strip, subject_valid

# File extension of each schema format.
EXTENSIONS = {"json": "json", "avsc": "avro", "proto": "protobuf"}


def _document(df: DataFrame) -> DataFrame:
    name = F.regexp_extract(F.col("path"), r"([^/]+)\z", 1)
    return df.select(F.col("path"), name.alias("file_name"), F.col("content").alias("body"))


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """A payload corpus: a folder of ``.json`` documents, one message per file, or a table of messages.

    Files give (path, file_name, body binary); a Parquet folder is read with its own columns. Spark leaves
    out files of length zero.
    """
    if path.endswith((".parquet", "/parquet")):
        return spark.read.parquet(path)
    return _document(spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path))


def stream_messages(spark: SparkSession, path: str) -> DataFrame:
    """The same folder as a stream of newly arriving files."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.json").load(path)
    return _document(stream)


def contract_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, body) rows to (contracts, errors): ``<subject>.<ext>`` names a contract file.

    Files with other extensions are ignored. A file whose name is no subject, and a subject with more
    than one file, are errors; the files of a doubled subject still appear as contracts.
    """
    name = F.regexp_extract("path", r"([^/]+)\z", 1)
    stem = F.regexp_extract(name, r"^(.*)\.[^.]*\z", 1)
    extension = F.lower(F.regexp_extract(name, r"\.([^.]*)\z", 1))
    format: Column | None = None
    for ext, fmt in EXTENSIONS.items():
        format = (F if format is None else format).when(extension == ext, fmt)
    named = files.select("path", F.col("body"), stem.alias("stem"), format.alias("format")).where("format is not null")
    text = F.try_validate_utf8(F.col("body").cast("string"))
    ok = subject_valid("stem")
    contracts = named.where(ok).select(strip("stem").alias("subject"), "format", "path", text.alias("body"))
    bad = named.where(~ok).select("path", F.lit("subject_name_invalid").alias("error_code"), F.col("stem").alias("detail"))
    doubled = (
        contracts.groupBy("subject").agg(F.count("*").alias("n"), F.min("path").alias("path")).where("n > 1")
        .select("path", F.lit("subject_defined_twice").alias("error_code"), F.col("subject").alias("detail"))
    )
    return contracts, bad.unionByName(doubled)


def read_contract_dir(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    files = spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("body"))
    return contract_files(files)


def latest_export(subjects: DataFrame, versions: DataFrame, schemas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, skipped): the approved latest schema of every subject; subjects without one are skipped."""
    tips = subjects.select("environment_id", "subject", F.col("latest_ordinal").alias("ordinal"))
    ids = tips.where("ordinal is not null").join(
        versions.select("environment_id", "subject", "ordinal", "schema_id"), ["environment_id", "subject", "ordinal"]
    )
    documents = ids.join(schemas.select("schema_id", "format", "body"), "schema_id")
    skipped = tips.join(documents, ["environment_id", "subject"], "left_anti").select("environment_id", "subject")
    return documents.select("environment_id", "subject", "ordinal", "schema_id", "format", "body"), skipped


def export_latest(subjects: DataFrame, versions: DataFrame, schemas: DataFrame, path: str) -> DataFrame:
    """Write every latest document under ``path/environment_id=…/subject=…``; returns the skipped subjects.

    Rows are first placed by subject, so each folder is written by one task as one file.
    """
    documents, skipped = latest_export(subjects, versions, schemas)
    documents.select("environment_id", "subject", "body").repartition("environment_id", "subject").write.mode(
        "overwrite"
    ).partitionBy("environment_id", "subject").text(path)
    return skipped


def sample_queue(messages: DataFrame, queue: str, max_n: int, subject: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(sample, summary) of the oldest ``max_n`` messages of a queue.

    The summary counts inspected messages and messages per type; blank types are not counted. Bodies
    that are not UTF-8 are inspected but not sampled. Several types need a chosen subject.
    """
    taken = messages.where(F.col("queue") == queue).orderBy("ts", "message_id").limit(max_n)
    text = F.try_validate_utf8(F.col("body").cast("string"))
    named = F.when(strip("properties_type") != "", F.col("properties_type"))
    summary = taken.groupBy(named.alias("type")).agg(
        F.count("*").alias("inspected"), F.count_if(text.isNotNull()).alias("sampled")
    )
    if subject is None and summary.where("type is not null").limit(2).count() > 1:
        raise ValueError("the queue carries more than one message type; choose a subject")
    sample = taken.select("message_id", "ts", "properties_type", text.alias("body")).where("body is not null")
    return sample, summary

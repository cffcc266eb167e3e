"""Versioned registry snapshots in a shared folder: what a running stream looks things up in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.conformance import Registry
from ..operators.validation import rules_of

TABLES = ("subjects", "schemas", "contracts", "publish", "consume")


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def versions_of(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the complete snapshots in ``folder``, ascending."""
    files, path = _files(spark, folder)
    if not files.exists(path):
        return []
    names = [s.getPath() for s in files.listStatus(path)]
    whole = [p.getName() for p in names if p.getName().startswith("version=") and files.exists(p.suffix("/_READY"))]
    return sorted(int(n.split("=")[1]) for n in whole)


def publish_snapshot(folder: str, **tables: DataFrame) -> int:
    """Write the five tables of a registry as the next version; its number.

    A marker comes last, so a reader never sees half a version, and a version never changes.
    """
    if set(tables) != set(TABLES):
        raise ValueError(f"a snapshot has the tables {', '.join(TABLES)}")
    spark = tables["subjects"].sparkSession
    number = max(versions_of(spark, folder), default=-1) + 1
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{folder}/version={number}/{name}")
    files, path = _files(spark, f"{folder}/version={number}/_READY")
    files.create(path, True).close()
    return number


class SnapshotRegistry:
    """The registry of the newest snapshot, for :func:`streaming.stream_conformance`: call it once a batch.

    A version that is already loaded is used again as it is. Of a new one only schema ids without compiled
    rules are compiled, by an anti-join with ``compiled``, a table beside the snapshots that is appended to.
    Ids are made from content, so rules never change; of rows that two writers add at once readers take one.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self.compiled = spark, folder, f"{folder}/compiled"
        self.version: int | None = None
        self.compiled_last: int = 0
        self.registry: Registry | None = None

    def __call__(self) -> Registry:
        newest = max(versions_of(self.spark, self.folder), default=None)
        if newest is None:
            raise ValueError(f"no complete snapshot in {self.folder}")
        if newest != self.version:
            read = lambda name: self.spark.read.parquet(f"{self.folder}/version={newest}/{name}")
            schemas = read("schemas")
            self.registry = Registry(read("subjects"), schemas, read("contracts"), read("publish"), read("consume"), rules=self._rules(schemas))
            self.version = newest
        return self.registry

    def _rules(self, schemas: DataFrame) -> DataFrame:
        files, path = _files(self.spark, f"{self.compiled}/_SUCCESS")
        fresh = schemas
        if files.exists(path):
            fresh = schemas.join(self.spark.read.parquet(self.compiled).select("schema_id"), "schema_id", "left_anti")
        self.compiled_last = fresh.select("schema_id").distinct().count()
        if self.compiled_last or not files.exists(path):
            rules_of(fresh).write.mode("append").parquet(self.compiled)
        known = self.spark.read.parquet(self.compiled).dropDuplicates(["schema_id"])
        return known.join(schemas.select("schema_id").distinct(), "schema_id", "left_semi")

"""A store of comparisons: what differs between two schemas is found once, whoever asks again.

Schema ids are made from the schemas' content, so a pair's findings never change. A policy's mode and surface
choose among findings and are no part of the key; its content model is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.columns import pack_id, unpack_id
from ..session import materialize
from .compatibility import PAIR, Differ


def _there(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def distinct_pairs(pairs: DataFrame) -> DataFrame:
    """Each pair once; ids are packed while pairs are shuffled."""
    ids = lambda f: [f(c).alias(c) for c in PAIR[:2]]
    return pairs.select(*ids(pack_id), PAIR[2]).distinct().select(*ids(unpack_id), PAIR[2])


def stored(differ: Differ, folder: str) -> Differ:
    """``differ`` behind the store in ``folder``: only pairs that it doesn't hold are compared, each once, and appended.

    Pairs that can't be compared are not kept: their schemas may become known. An append that fails leaves
    nothing; of rows that two writers add at once readers take one. What has just been compared is given as it
    was found, and not looked up again.
    """

    def look(pairs: DataFrame) -> DataFrame:
        spark = pairs.sparkSession
        asked = fresh = materialize(distinct_pairs(pairs), "asked")
        held = spark.read.parquet(folder) if _there(spark, folder) else None
        if held is not None:
            fresh = materialize(asked.join(held.select(*PAIR), PAIR, "left_anti"), "fresh")
            held = held.join(asked, PAIR, "left_semi").dropDuplicates(PAIR).select(*PAIR, "findings")
            if fresh.isEmpty():
                return held
        found = materialize(differ(fresh).select(*PAIR, "findings"), "found")
        found.where("findings is not null").write.mode("append").parquet(folder)
        return found if held is None else held.unionByName(found)

    return look

"""Running aggregates that do not put one hot key into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize

BLOCK = 4096


def before(df: DataFrame, keys: list[str], order: str, name: str, value: Column, how: str = "last", block: int = BLOCK,
           of: DataFrame | None = None, work: dict[str, Column] | None = None) -> DataFrame:
    """Add ``name``: the last non-null (or the largest) ``value`` of earlier rows of the same keys.

    ``order`` is an integer that numbers the rows of a key. Rows are handled in blocks of that
    number, so a key with very many rows is spread over many tasks; only one row per block takes
    part in the second, small window. That window's result is written, so it is broadcast if it really is small, as
    it is where rows are numbered without gaps; ``of`` are the same rows, or more, as they were read, if ``df`` is a join of them.
    Only keys with rows outside block 0 take part in it. With ``work``, columns that ``value`` may be made of, rows are dealt by
    key and block as they are, and these worked out after.
    """
    numbered = lambda rows: rows.withColumn("_block", F.floor(F.col(order) / block))
    valued = lambda rows: rows.withColumns(work or {}).withColumn("_value", value)
    of = numbered(df if of is None else of)
    df = numbered(df)
    df = valued(df.repartition(*keys, "_block") if work else df)
    fold = (lambda c: F.last(c, True)) if how == "last" else F.max
    inside = W.partitionBy(*keys, "_block").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    local = df.withColumn("_local", fold("_value").over(inside))
    pick = F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(order))) if how == "last" else F.max("_value")
    several = materialize(of.where("_block <> 0").select(*keys).distinct(), "several")
    blocks = valued(of.join(several, keys, "left_semi")).groupBy(*keys, "_block").agg(pick.alias("_last"))
    across = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = blocks.withColumn("_carried", fold("_last").over(across)).where("_carried is not null").drop("_last")
    carried = materialize(carried, "carried")
    out = local.join(carried, [*keys, "_block"], "left")
    both = F.coalesce("_local", "_carried") if how == "last" else F.greatest("_local", "_carried")
    return out.withColumn(name, both).drop("_block", "_value", "_local", "_carried")

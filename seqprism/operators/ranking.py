"""Ranks over whole tables without one task that holds them all."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder of spark.checkpoint.dir (a temporary one where unset)."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint()


def ranked(df: DataFrame, group: str, order: list[Column], name: str = "rank") -> DataFrame:
    """df with the place (from 1) of each row within its group.

    Rows are partitioned by range of (group, order) and numbered within the partition; a group that
    goes over several partitions continues the count. Only one row per partition and group meets in
    a window.
    """
    placed = cut(df.repartitionByRange(F.col(group), *order).sortWithinPartitions(F.col(group), *order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    pieces = placed.groupBy(F.col(group).alias("_group"), part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.withColumn("_before", before)
    same = F.col(group).eqNullSafe(F.col("_group")) & (part == F.col("_part"))
    return placed.join(pieces, same).withColumn(name, F.col("_before") + F.col("_at") - F.col("_first") + 1).select(*df.columns, name)


def sums_before(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """df with the sum of value over all rows before each one, 0 for the first: sums within partitions by
    range, and one row per partition in a window."""
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    earlier = lambda w: F.coalesce(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = placed.groupBy("_part").agg(F.sum(value).alias(value)).select("_part", earlier(Window.orderBy("_part")).alias("_before"))
    within = placed.withColumn(name, earlier(Window.partitionBy("_part").orderBy("_at")))
    return within.join(pieces, "_part").withColumn(name, F.col(name) + F.col("_before")).select(*df.columns, name)

"""Row numbers inside groups that may be very large.

A plain ``row_number`` sorts a whole group in one task. Here all rows are laid out in ranges of (keys, order), whose
borders Spark samples from the data, so a group of any size spreads over as many tasks as it needs. The place of a row
in its range is known there; where a range's part of a group begins comes from a running sum over one row per group
and range. Null keys are a group like others and no row is dropped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import checkpointed

ROW_BITS = 33  # of an increasing id, the bits below hold the row's place in its partition


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """Add ``name``: 1, 2, ... by ``order`` within ``keys`` (none: over all rows); ``order`` must be total within a group.

    ``df`` is evaluated once: the laid-out rows are checkpointed, so the ranges stay as they are when executors are lost.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = df.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    laid = laid.withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", ROW_BITS))
    laid = checkpointed(laid)
    runs = laid.groupBy(*keys, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1
    marks = [f"_k{i}" for i in range(len(keys))]
    starts = runs.select(*[F.col(k).alias(m) for k, m in zip(keys, marks)], F.col("_range").alias("_r"), start.alias("_start"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(m)) for k, m in zip(keys, marks)], F.col("_range") == F.col("_r"))
    return laid.join(starts, same).withColumn(name, F.col("_at") + F.col("_start")).drop("_at", "_range", "_r", "_start", *marks)

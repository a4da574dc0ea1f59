"""Places of rows within groups that one task need not hold."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from countersign.session import checkpointed

IN_PARTITION = 33  # bits of `monotonically_increasing_id` that count inside a partition


def numbered(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """`rows` with `pos`, the place from 0 on inside `group` (not null) by `order`, and `group_n`, the rows of the group.

    Rows are cut by range over group and order, so a group of any size spreads; a task numbers its part, and the parts of a group are as
    many as partitions. Equal rows stand in either order. `order` must be short values: the bounds of the cut are samples of it.
    """
    keyed = rows.withColumn("_row", F.monotonically_increasing_id())
    by = [F.col(group), *order, F.col("_row")]
    placed = checkpointed(keyed.repartitionByRange(*by).sortWithinPartitions(*by).drop("_row").withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", IN_PARTITION)
    parts = placed.groupBy(group, part.alias("_part")).agg(F.min("_at").alias("_from"), F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(group)
    parts = parts.select(group, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_from")).alias("_shift"), F.sum("_n").over(whole).alias("group_n"))
    return placed.withColumn("_part", part).join(parts, [group, "_part"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")

"""Places of rows in an order, without a task that sees all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlab.session import stage

def numbered(rows: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """``rows`` with ``idx`` (0, 1, ... by ``order`` within ``group``, which is never null) and ``total`` (rows of the group).

    Rows are sorted across ranges, so that a group of any size is spread; rows equal in all of
    ``order`` should be told apart by a last column. Only the counts of each
    range and group are put in line; there are at most as many as groups and ranges.
    """
    rows = stage(rows, f"{name}-rows")  # finding the ranges reads them once more
    sorted_rows = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    placed = stage(sorted_rows.withColumn("at_", F.monotonically_increasing_id()), name)
    part = F.shiftright("at_", 33)
    counts = placed.groupBy(group, part.alias("part_")).agg(F.count("*").alias("n_"), F.min("at_").alias("first_"))
    before = F.sum("n_").over(Window.partitionBy(group).orderBy("part_")) - F.col("n_")
    counts = counts.select(group, "part_", (before - F.col("first_")).alias("shift_"), F.sum("n_").over(Window.partitionBy(group)).alias("total"))
    met = placed.withColumn("part_", part).join(stage(counts, f"{name}-counts"), [group, "part_"])
    return met.select(*rows.columns, (F.col("at_") + F.col("shift_")).alias("idx"), "total")

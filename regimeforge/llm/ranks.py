"""Positions of rows in an order, without a window over a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common


def numbered(df: DataFrame, group: str, order: Sequence[Column | str]) -> DataFrame:
    """``df`` with rf_i (0, 1, 2 ... within ``group``, in ``order``) and rf_n (rows of the group).

    Rows are dealt out by ranges of (group, order), so a hot group is spread over many tasks; the position
    in a range comes from the sorted task, and ranges are put behind each other by their counts, a table of a row
    for each range and group. Rows that are equal in ``order`` get an order of their own by their place in the
    stored table, so even a table of equal rows is spread. The group must not be null.
    """
    stored = common.materialize(df.withColumn("rf_row", F.monotonically_increasing_id()), "unordered")
    keys = [group, *order, "rf_row"]
    placed = common.materialize(stored.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("rf_at", F.monotonically_increasing_id()), "ordered")
    common.release(stored)
    part = F.shiftright("rf_at", 33).alias("rf_part")
    runs = placed.groupBy(group, part).agg(F.count("*").alias("rf_count"), F.min("rf_at").alias("rf_first"))
    by = Window.partitionBy(group)
    runs = common.materialize(
        runs.select(group, "rf_part", (F.sum("rf_count").over(by.orderBy("rf_part")) - F.col("rf_count") - F.col("rf_first")).alias("rf_shift"), F.sum("rf_count").over(by).alias("rf_n")), "ranges"
    )
    out = placed.withColumn("rf_part", part).join(runs, [group, "rf_part"])
    return out.select(*df.columns, (F.col("rf_at") + F.col("rf_shift")).alias("rf_i"), "rf_n")

"""Positions of rows in an order, without a window over a whole group or table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import store


def numbered(df: DataFrame, group: str | None, order: Sequence[str], name: str) -> DataFrame:
    """``df`` with ``name``: 1, 2, 3 ... in ``order`` within each ``group`` (None: over all rows).

    Rows are dealt out by ranges, so a hot group lies in many tasks; a row's position is its place in its sorted range,
    after the counts of the ranges before, of which there is a row for each range and group. Rows equal in
    ``order`` have an order of their own, by their place in the stored table. The group must not be null."""
    key = "_all" if group is None else group
    rows = df if group is not None else df.withColumn("_all", F.lit(0))
    rows = store.stored(rows.withColumn("_row", F.monotonically_increasing_id()), "unordered")
    keys = [key, *order, "_row"]
    placed = store.stored(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    by = Window.partitionBy(key)
    runs = placed.groupBy(key, "_part").agg(F.count("*").alias("_c"), F.min("_at").alias("_first"))
    runs = store.stored(runs.select(key, "_part", (F.sum("_c").over(by.orderBy("_part")) - F.col("_c") - F.col("_first") + 1).alias("_shift")), "ranges")
    return placed.join(runs, [key, "_part"]).select(*df.columns, (F.col("_at") + F.col("_shift")).alias(name))

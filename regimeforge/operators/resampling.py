"""The stationary bootstrap as joins, over joint series of any length."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import store

#: Mean block lengths, resamples and the error level of the joint bounds.
BLOCKS, RESAMPLES, ALPHA, SEED = (5, 10), 100_000, 0.05 / 6, 20260923


def draws(*parts: Column | int) -> tuple[Column, Column]:
    """Two numbers in [0, 1) that follow from the parts (whole numbers): eight hex digits each of the MD5 of the parts
    with colons between. Every engine draws the same."""
    text = F.md5(F.concat_ws(":", *((p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts)))
    return tuple(F.conv(F.substring(text, at, 8), 16, 10).cast("double") / float(2**32) for at in (1, 9))


def stationary_bounds(series: DataFrame, names: Sequence[str], order: str, blocks: Sequence[int] = BLOCKS, resamples: int = RESAMPLES, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """(block_length, series, sessions, lower, centre): the alpha quantile and the median, over resamples, of each series' mean.

    A resample is made of blocks: it starts anywhere, runs on circularly and ends with odds 1 / length at each
    step, until there are as many values as in ``series`` (a row for each session, in ``order``; the series
    stay joint). Relationally a block is a row (resample, place, start, length), and its sum is a difference of two
    prefix sums: blocks join the prefix table on their first and last position. So a resample costs its blocks,
    n / length rows, not n, and neither the series nor the resamples pass through one task or the driver. Block
    lengths and starts are hashes of (seed, length, resample, place). Null sessions are an error of the caller: drop
    them first, as a series needs all of its values. Fewer than two sessions give no rows.
    """
    spark = series.sparkSession
    cells = series.select(F.col(order).alias("_o"), *(F.col(n).cast("double").alias(n) for n in names))
    # prefix sums: positions from the order, sums over the (short) table of sessions
    running = Window.orderBy("_o").rowsBetween(Window.unboundedPreceding, 0)
    sums = cells.select((F.row_number().over(Window.orderBy("_o"))).cast("long").alias("at"), *(F.sum(n).over(running).alias(n) for n in names))
    sums = store.stored(sums, "prefix")
    sums = sums.unionByName(spark.range(1).select(F.lit(0).cast("long").alias("at"), *(F.lit(0.0).alias(n) for n in names)))
    n = sums.agg(F.max("at")).first()[0]
    out = None
    for length in blocks if n >= 2 else ():
        # so many blocks reach n values, whatever their lengths, but for odds that the last block makes good
        most = n if length == 1 else min(n, int(n / length + 6 * (n / length) ** 0.5 + 8))
        rows = spark.range(resamples).select(F.col("id").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("j"))
        u, v = draws(seed, length, F.col("r"), F.col("j"))
        size = F.lit(1) if length == 1 else F.floor(F.log(1 - u) / F.log(F.lit(1 - 1 / length))) + 1
        rows = rows.select("r", "j", size.cast("long").alias("size"), F.floor(v * n).cast("long").alias("start"))
        w = Window.partitionBy("r").orderBy("j").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("done", F.coalesce(F.sum("size").over(w), F.lit(0))).where(F.col("done") < n)
        # the last block takes what is missing
        rows = rows.withColumn("size", F.when(F.col("j") == most - 1, n - F.col("done")).otherwise(F.least("size", n - F.col("done"))))
        # a block is whole turns of the circle, and a stretch that may wrap: up to three prefix sums
        last = (F.col("start") + F.col("size")) % n
        turns = F.floor((F.col("start") + F.col("size")) / n)
        ends = rows.select("r", F.explode(F.array(F.struct(last.alias("at"), F.lit(1.0).alias("w")), F.struct(F.col("start").alias("at"), F.lit(-1.0).alias("w")), F.struct(F.lit(n).alias("at"), turns.cast("double").alias("w")))).alias("x")).select("r", "x.*").where("w <> 0")
        means = ends.join(sums, "at").groupBy("r").agg(*(F.sum(F.col("w") * F.col(c) / n).alias(c) for c in names))
        cut = [F.struct(F.lit(c).alias("series"), F.percentile(c, F.lit(alpha)).alias("lower"), F.percentile(c, F.lit(0.5)).alias("centre")) for c in names]
        part = means.agg(F.array(*cut).alias("x")).select(F.lit(length).alias("block_length"), F.inline("x")).select("block_length", "series", F.lit(n).cast("long").alias("sessions"), "lower", "centre")
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], "block_length int, series string, sessions long, lower double, centre double") if out is None else out

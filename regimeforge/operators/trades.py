"""Grouped trade reports, edge quality and excursions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import nullif
from ..sources import store

#: Left-closed edges of the excursion buckets.
EXCURSION_EDGES = (0.0, 0.005, 0.01, 0.02, 0.03)


def group_summary(trades: DataFrame, *keys: str, least: int = 1) -> DataFrame:
    """The trade summary of each group (null keys are a group) with its edge class."""
    r = F.col("return_pct")
    win, loss = F.coalesce(F.avg(F.when(r > 0, r)), F.lit(0.0)), F.coalesce(F.avg(F.when(r <= 0, r)), F.lit(0.0))
    spread = F.stddev_pop(r)
    adverse = F.greatest(-F.col("mae_pct"), F.lit(0.0))
    out = trades.groupBy(*keys).agg(
        F.count("*").alias("trade_count"), F.avg((r > 0).cast("double")).alias("win_rate"), F.avg(r).alias("expectancy"), F.avg("pnl").alias("average_pnl"),
        win.alias("average_win"), loss.alias("average_loss"), (win / nullif(F.abs(loss))).alias("win_loss_size_ratio"),
        F.when(spread == 0, 0.0).otherwise(F.avg(r) / nullif(spread) * F.sqrt(F.count(r).cast("double"))).alias("sharpe"),
        F.avg("expected_value").alias("average_expected_value"), F.avg("hold_bars").alias("average_hold_bars"), F.avg("mae_pct").alias("average_mae_pct"), F.avg("mfe_pct").alias("average_mfe_pct"),
        F.avg(adverse).alias("average_adverse_excursion_pct"), F.median(adverse).alias("median_adverse_excursion_pct"), F.avg("uncaptured_pct").alias("average_uncaptured_pct"),
    ).where(F.col("trade_count") >= least)
    e, v = F.col("expectancy"), F.col("average_expected_value")
    return out.withColumn("edge_classification", F.when((e > 0) & (v > 0), "positive").when((e <= 0) & (v <= 0), "weak").otherwise("mixed"))


def hold_bucket(bars: Column) -> Column:
    return F.when(bars <= 1, "1").when(bars <= 3, "2-3").when(bars <= 5, "4-5").when(bars <= 10, "6-10").otherwise("11+")


def excursions(trades: DataFrame, value: Column) -> DataFrame:
    """Counts, means and shares by left-closed excursion bucket; buckets without trades are there too."""
    edges = [*EXCURSION_EDGES, float("inf")]
    names = [f"{a:.1%}+" if b == float("inf") else f"{a:.1%}-{b:.1%}" for a, b in zip(edges[:-1], edges[1:], strict=True)]
    bucket = F.lit(None).cast("string")
    for name, low in zip(names, EXCURSION_EDGES, strict=True):
        bucket = F.when(value >= low, name).otherwise(bucket)
    rows = trades.select(bucket.alias("bucket"), value.alias("value"), "return_pct").where("bucket is not null")
    got = rows.groupBy("bucket").agg(F.count("*").alias("trade_count"), F.avg("value").alias("average_value"), F.median("value").alias("median_value"), F.avg("return_pct").alias("average_return"))
    all_ = trades.sparkSession.createDataFrame([(n,) for n in names], "bucket string").join(got, "bucket", "left").withColumn("trade_count", F.coalesce("trade_count", F.lit(0)))
    return all_.withColumn("share_of_trades", F.col("trade_count") / nullif(F.sum("trade_count").over(Window.partitionBy()).cast("double")))


def day_falls(trades: DataFrame, sets: list[tuple[str, ...]], day: str = "exit_ts", order: str = "trade_order") -> DataFrame:
    """What each day does to the compounded returns of each set of keys, for ``drawdown_of``: a row for each day and
    combination of all keys, with the sum of logs, and for each set its highest and lowest point in the day and its
    longest way down from a point of the day.

    All sets come from one exchange by day, so no task holds a whole group; as every task sorts for each set, the
    partitions of the session are not put together into fewer. Returns of -1 or less lose all there is.
    """
    log = F.when(F.col("return_pct") > -1, F.log1p("return_pct")).otherwise(-745.0)
    names = list(dict.fromkeys(k for keys in sets for k in keys))
    # the place in the day stands for the order, so that the sorts by keys carry a number
    along = F.row_number().over(Window.partitionBy("_d").orderBy("_o"))
    partitions = int(trades.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = trades.select(*names, F.col(day).alias("_d"), F.col(order).alias("_o"), log.alias("_l")).repartition(partitions, "_d").withColumn("_n", along).drop("_o")
    parts = []
    for i, keys in enumerate(sets):
        w = Window.partitionBy("_d", *keys).orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn(f"_c{i}", F.sum("_l").over(w))
        rows = rows.withColumn(f"_m{i}", F.max(f"_c{i}").over(w) - F.col(f"_c{i}"))
        parts += [F.max(f"_c{i}").alias(f"_top{i}"), F.min(f"_c{i}").alias(f"_low{i}"), F.max(f"_m{i}").alias(f"_dip{i}")]
    return rows.groupBy("_d", *names).agg(F.sum("_l").alias("_l"), *parts)


def drawdown_of(falls: DataFrame, sets: list[tuple[str, ...]], i: int) -> DataFrame:
    """(keys, max_drawdown) of the set of that place: the falls of days, and those from the peak of the days before."""
    keys = sets[i]
    days = falls.groupBy(*keys, "_d").agg(F.sum("_l").alias("_total"), F.max(f"_top{i}").alias("_top"), F.min(f"_low{i}").alias("_low"), F.max(f"_dip{i}").alias("_dip"))
    past = Window.partitionBy(*keys).orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("_before", F.coalesce(F.sum("_total").over(past), F.lit(0.0)))
    days = days.withColumn("_peak", F.greatest(F.lit(0.0), F.coalesce(F.max(F.col("_before") + F.col("_top")).over(past), F.lit(0.0))))
    fall = F.greatest(1 - F.exp(F.col("_before") + F.col("_low") - F.col("_peak")), 1 - F.exp(-F.col("_dip")))
    return days.groupBy(*keys).agg(F.max(fall).alias("max_drawdown"))


def drawdown(trades: DataFrame, *keys: str, day: str = "exit_ts", order: str = "trade_order") -> DataFrame:
    """(keys, max_drawdown) of compounded returns in trade order, with the peak at 1 or more."""
    return drawdown_of(day_falls(trades, [keys], day, order), [keys], 0)


def _normalised(x: Column) -> Column:
    """Min-max over all rows that are left; a constant becomes a half."""
    everything = Window.partitionBy()
    low, high = F.min(x).over(everything), F.max(x).over(everything)
    return F.when(high == low, 0.5).otherwise((x - low) / nullif(high - low))


def _blend(*parts: tuple[Column, float]) -> Column:
    return sum((_normalised(x) * w for x, w in parts), F.lit(0.0)) / sum(w for _, w in parts)


def edge_quality(trades: DataFrame, *keys: str, least: int = 1, fold: str = "fold_id") -> DataFrame:
    """The edge table of one set of keys, see ``edge_tables``."""
    return edge_tables(trades, [keys], least, fold)[0]


def edge_tables(trades: DataFrame, sets: list[tuple[str, ...]], least: int = 1, fold: str = "fold_id") -> list[DataFrame]:
    """For each set of keys, quality and consistency scores of each group, with dense ranks and percentiles among the groups
    that share all keys but the last. The table of groups is what the windows range over.

    The trades are read twice for all sets together, for what their days do and for their moments; both are aggregates, which
    are written to the shared folder, and the tables come from these.
    """
    r = F.col("return_pct")
    sharpe = F.coalesce(F.avg(r) / nullif(F.stddev_samp(r)), F.lit(0.0))
    names = [*dict.fromkeys(k for keys in sets for k in keys), fold]
    number = lambda keys: sum(1 << (len(names) - 1 - at) for at, name in enumerate(names) if name not in keys)
    moments = trades.groupingSets([[F.col(k) for k in part] for keys in sets for part in ((*keys, fold), keys)], *names).agg(
        F.grouping_id().alias("_g"), F.count("*").alias("sample_size"), F.avg(r).alias("expectancy"), sharpe.alias("out_of_sample_sharpe"), F.avg((r > 0).cast("double")).alias("win_rate")
    )
    moments = store.stored(moments, "moments")
    with_whole = [(), *sets]
    falls = store.stored(day_falls(trades, with_whole), "falls")
    whole = drawdown_of(falls, with_whole, 0).withColumnRenamed("max_drawdown", "_whole")
    out = []
    for at, keys in enumerate(sets, 1):
        s = moments.where(F.col("_g") == number(keys)).select(*keys, "sample_size", "expectancy", "out_of_sample_sharpe", "win_rate")
        folds = moments.where(F.col("_g") == number((*keys, fold))).select(*keys, fold, F.col("expectancy").alias("e"), F.col("out_of_sample_sharpe").alias("s"))
        out.append(_scored(s, folds, drawdown_of(falls, with_whole, at), whole, keys, least, fold))
    return out


def _scored(s: DataFrame, folds: DataFrame, falls: DataFrame, whole: DataFrame, keys: tuple[str, ...], least: int, fold: str) -> DataFrame:
    steady = folds.groupBy(*keys).agg(
        F.count(fold).alias("active_fold_count"), F.avg((F.col("e") > 0).cast("double")).alias("positive_fold_fraction"),
        F.coalesce(F.var_samp("e"), F.lit(0.0)).alias("expectancy_variance"), F.coalesce(F.var_samp("s"), F.lit(0.0)).alias("sharpe_variance"),
    )
    s = s.join(steady, list(keys)).join(falls, list(keys)).crossJoin(F.broadcast(whole))  # one row
    s = s.withColumn("max_drawdown_contribution", F.when(F.col("_whole") > 0, F.col("max_drawdown") / nullif(F.col("_whole"))).otherwise(0.0)).where(F.col("sample_size") >= least).drop("_whole")
    c = lambda n: F.col(n).cast("double")
    s = s.withColumn("consistency_score", _blend((c("active_fold_count"), 1), (c("positive_fold_fraction"), 1), (-c("expectancy_variance"), 1), (-c("sharpe_variance"), 1)))
    size = F.log1p(c("sample_size"))
    s = s.withColumn("quality_score", _blend((c("expectancy"), 0.25), (c("out_of_sample_sharpe"), 0.25), (c("win_rate"), 0.10), (size, 0.15), (c("consistency_score"), 0.20), (-c("max_drawdown_contribution"), 0.05)))
    s = s.withColumn("sample_size_score", _normalised(size))
    group = Window.partitionBy(*keys[:-1])
    for name in ("quality", "consistency"):
        rank = F.dense_rank().over(group.orderBy(F.round(f"{name}_score", 9).desc()))
        share = 1 - (F.col(f"{name}_rank") - 1) / F.count("*").over(group).cast("double")
        s = s.withColumn(f"{name}_group_size", F.count("*").over(group)).withColumn(f"{name}_rank", rank).withColumn(f"{name}_percentile", F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)))
    return s


def failure_modes(trades: DataFrame, least: int = 3) -> DataFrame:
    keys = ("asset_class", "exit_reason", "entry_state")
    return group_summary(trades, *keys, least=least).withColumn("failure_mode", F.concat_ws(" | ", *keys))


def subperiods(trades: DataFrame) -> DataFrame:
    quarter = F.concat(F.year("exit_ts").cast("string"), F.lit("Q"), F.quarter("exit_ts").cast("string"))
    return trades.groupBy(quarter.alias("subperiod")).agg(F.count("*").alias("trade_count"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"), F.avg("return_pct").alias("average_return"), F.avg("pnl").alias("average_pnl"))


def by_split_and_all(trades: DataFrame, split: str) -> DataFrame:
    """Each value of ``split`` and the total, in one pass by grouping sets."""
    r = F.col("return_pct")
    out = trades.groupingSets([[trades[split]], []], trades[split]).agg(F.grouping(split).alias("_g"), F.count("*").alias("trade_count"), F.avg(r).alias("average_return"))
    return out.withColumn("part", F.when(F.col("_g") == 1, "all").otherwise(F.col(split).cast("string"))).drop("_g", split)


def extremes(trades: DataFrame, n: int = 25) -> DataFrame:
    """The best and the worst trades; a top-k report, so the limit is what it is for."""
    best = trades.orderBy(F.col("return_pct").desc(), "trade_order").limit(n).withColumn("side", F.lit("best"))
    worst = trades.orderBy("return_pct", "trade_order").limit(n).withColumn("side", F.lit("worst"))
    return best.unionByName(worst)

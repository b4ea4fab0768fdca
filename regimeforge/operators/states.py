"""Discrete states of bars: labels by rules, their context, sparse merging, and diagnostics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import nullif, order
from .features import run_length


@dataclass(frozen=True)
class StateConfig:
    """The default thresholds of the rules."""

    trend_threshold: float = 0.01
    volatility_zscore_threshold: float = 0.5
    momentum_threshold: float = 0.02
    extension_threshold: float = 1.5
    rsi_overbought: float = 70.0
    rsi_oversold: float = 30.0
    duration_buckets: tuple[int, ...] = (3, 10)
    sparse_warning: int = 15
    bins: int = 3


DEFAULT = StateConfig()


def banded(x: Column, threshold: float, above: str, below: str, between: str) -> Column:
    """Null falls to ``between``."""
    return F.when(x > threshold, above).when(x < -threshold, below).otherwise(between)


def composite(frame: DataFrame, c: StateConfig = DEFAULT, fast: str = "ma_10", slow: str = "ma_200", rsi: str | None = None) -> DataFrame:
    """State = trend | volatility | momentum | extension; ``rsi`` names a column for the extension rule."""
    x = F.col("zscore_close_20")
    over, under = x > c.extension_threshold, x < -c.extension_threshold
    if rsi:
        over, under = over | (F.col(rsi) > c.rsi_overbought), under | (F.col(rsi) < c.rsi_oversold)
    parts = {
        "state_trend": banded(F.col(fast) / F.col(slow) - 1, c.trend_threshold, "up", "down", "neutral"),
        "state_volatility": banded(F.col("vol_zscore_20"), c.volatility_zscore_threshold, "high", "low", "normal"),
        "state_momentum": banded(F.col("return_5"), c.momentum_threshold, "strong", "weak", "neutral"),
        "state_extension": F.when(over, "overbought").when(under, "oversold").otherwise("normal"),
    }
    return frame.withColumns(parts).withColumns({"state": F.concat_ws("|", *parts), "state_family": F.concat_ws("|", "state_trend", "state_volatility")})


def age_bucket(age: Column, thresholds: tuple[int, ...]) -> Column:
    out, low = F.lit(None).cast("string"), 0
    for t in thresholds:
        out = F.coalesce(out, F.when(age <= t, f"age_{low + 1}_{t}"))
        low = t
    return F.coalesce(out, F.when(age.isNotNull(), f"age_{low + 1}_plus"), F.lit("age_unknown"))


def contextual(frame: DataFrame, c: StateConfig = DEFAULT, path: int = 2) -> DataFrame:
    """Previous state, age, age bucket, bias, recent path and entry bias of each state."""
    bias = F.when(F.col("state_trend") == "up", "bullish").when(F.col("state_trend") == "down", "bearish").otherwise("neutral")
    out = run_length(frame.withColumns({"base_state": F.col("state"), "state_bias": bias}), "base_state", "state_age")
    back = lambda k: F.coalesce(F.lag("state_bias", k).over(order()), F.lit("start"))
    out = out.withColumns({
        "previous_state": F.coalesce(F.lag("base_state").over(order()), F.lit("start")),
        "previous_state_group": back(1),
        "state_age_bucket": age_bucket(F.col("state_age"), c.duration_buckets),
        "recent_state_path": F.concat_ws(">", *(back(k) for k in range(path, 0, -1))),
    })
    entered = F.when(F.col("state_age") == 1, F.col("previous_state_group"))
    return out.withColumn("entry_bias", F.last(entered, ignorenulls=True).over(order().rowsBetween(Window.unboundedPreceding, 0)))


def sparse_merge(frame: DataFrame, parts: list[str], priority: list[str], least: int, rare: str = "rare_state", merged: str = "any") -> DataFrame:
    """The most detailed label that has ``least`` rows; parts become ``merged`` in the order of priority.
    The counts of a level have a row for each label, which the rules bound."""
    levels, gone = [], set()
    for part in [None, *priority]:
        gone |= {part} - {None}
        levels.append(F.concat_ws("|", *(F.lit(merged) if p in gone else F.col(p) for p in parts)))
    out = frame.withColumns({f"_l{k}": level for k, level in enumerate(levels)})
    for k in range(len(levels)):
        counts = out.groupBy(f"_l{k}").agg(F.count("*").alias(f"_c{k}"))
        out = out.join(counts, f"_l{k}", "left")
    label = F.coalesce(*(F.when(F.col(f"_c{k}") >= least, F.col(f"_l{k}")) for k in range(len(levels))), F.lit(rare))
    return out.withColumn("merged_state", label).drop(*(f"_{x}{k}" for k in range(len(levels)) for x in "lc"))


def quantile_edges(frame: DataFrame, column: str, bins: int) -> DataFrame:
    """(symbol, edges): inner edges by linear quantiles."""
    at = [k / bins for k in range(1, bins)]
    return frame.groupBy("symbol").agg(F.percentile(column, F.array(*(F.lit(float(a)) for a in at))).alias("edges"))


def binned(frame: DataFrame, column: str, bins: int) -> DataFrame:
    """Right-closed bins b0, b1, ... of a column by its quantiles per symbol; null is ``missing``."""
    edges = quantile_edges(frame, column, bins)
    k = F.size(F.filter("edges", lambda e: F.col(column) > e))
    return frame.join(edges, "symbol").withColumn("bin", F.when(F.col(column).isNull(), "missing").otherwise(F.concat(F.lit("b"), k.cast("string")))).drop("edges")


def frequency(frame: DataFrame) -> DataFrame:
    counts = frame.where("state is not null").groupBy("symbol", "state").agg(F.count("*").alias("observations"))
    return counts.withColumn("frequency", F.col("observations") / F.sum("observations").over(Window.partitionBy("symbol")))


def persistence(frame: DataFrame) -> DataFrame:
    """Run lengths of states by symbol and state."""
    change = F.coalesce((F.col("state") != F.lag("state").over(order())).cast("int"), F.lit(1))
    runs = frame.withColumn("_run", F.sum(change).over(order())).groupBy("symbol", "state", "_run").agg(F.count("*").alias("duration"))
    return runs.groupBy("symbol", "state").agg(
        F.count("*").alias("run_count"), F.avg("duration").alias("mean_duration"), F.median("duration").alias("median_duration"), F.max("duration").alias("max_duration")
    )


def summary(frame: DataFrame, sparse: int = DEFAULT.sparse_warning) -> DataFrame:
    """State counts of each symbol as scalars."""
    enough = F.col("observations") >= sparse
    return frequency(frame).groupBy("symbol").agg(
        F.count("*").alias("unique_states"),
        F.median("observations").alias("median_state_observations"),
        F.min("observations").alias("min_state_observations"),
        F.avg(enough.cast("double")).alias("share_states_above_threshold"),
        F.count_if(~enough).alias("sparse_state_count"),
        (F.sum(F.when(enough, F.col("observations")).otherwise(0)) / nullif(F.sum("observations").cast("double"))).alias("effective_state_coverage"),
    )

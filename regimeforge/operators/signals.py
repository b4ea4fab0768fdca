"""Expectancy signals from frozen statistics, their sizing, selection and caps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import markov


@dataclass(frozen=True)
class SignalConfig:
    """The default gates, costs and limits of the signals."""

    min_expected_value: float = 0.001
    min_confidence: float = 0.08
    min_observations: int = 25
    transaction_cost_bps: float = 5.0
    slippage_bps: float = 5.0
    volatility_penalty: float = 0.10
    liquidity_threshold: float = 1e6
    liquidity_penalty: float = 0.001
    short_classes: tuple[str, ...] = ("crypto",)


DEFAULT = SignalConfig()


def bounded(x: Column) -> Column:
    return F.when(x > 0, F.tanh(100 * x)).otherwise(0.0)


def frozen_signals(frame: DataFrame, samples: DataFrame, c: SignalConfig = DEFAULT) -> DataFrame:
    """Every bar scored against the statistics of its state in all of ``samples``. States without statistics are
    flat. ``walkforward.historical_signals`` scores each bar by what came before it."""
    known = markov.statistics(samples, ["symbol"])
    known = known.withColumn("observations", F.when(F.col("observations") > 0, F.col("observations")))
    return decided(frame.join(known, ["symbol", "state"], "left"), c)


def decided(frame: DataFrame, c: SignalConfig = DEFAULT, *keys: str) -> DataFrame:
    """Bars with the statistics of their state (observations, mean_return, confidence, predicted) as signals: expected
    values of both sides after costs, confidence, direction, base score and the reason of a block. ``keys`` are kept."""
    stats = ["observations", "mean_return", "confidence", "predicted"]
    out = frame.select(*keys, "symbol", "asset_class", "ts", "state", "state_family", F.coalesce("realized_vol_20", F.lit(0.0)).alias("volatility"), F.coalesce("dollar_volume_20", F.lit(0.0)).alias("dollar_volume"), *stats)
    n = F.coalesce(F.col("observations"), F.lit(0)).cast("double")
    scale = F.log1p(n) / F.log1p(F.lit(float(max(c.min_observations * 5, 2))))
    confidence = F.least(F.greatest(F.coalesce(F.col("confidence"), F.lit(0.0)) * scale, F.lit(0.0)), F.lit(1.0))
    cost = (c.transaction_cost_bps + c.slippage_bps) / 10_000
    thin = F.when(F.col("dollar_volume") < c.liquidity_threshold, c.liquidity_penalty * (c.liquidity_threshold / F.greatest(F.col("dollar_volume"), F.lit(1.0)) - 1)).otherwise(0.0)
    drag = cost + c.volatility_penalty * F.greatest(F.col("volatility"), F.lit(0.0)) + thin
    out = out.withColumns({
        "signal_confidence": confidence,
        "liquidity_score": F.least(F.lit(1.0), F.col("dollar_volume") / max(c.liquidity_threshold, 1.0)),
        "long_ev": F.col("mean_return") - drag,
        "short_ev": -F.col("mean_return") - drag,
        "shortable": F.col("asset_class").isin(*c.short_classes),
        "setup": F.when(F.col("predicted").isNotNull(), F.concat("state", F.lit(" -> "), "predicted")),
    })
    ready = (F.col("signal_confidence") >= c.min_confidence) & (n >= c.min_observations)
    go_long = F.coalesce((F.col("long_ev") >= c.min_expected_value) & ready, F.lit(False))
    go_short = F.coalesce(F.col("shortable") & (F.col("short_ev") >= c.min_expected_value) & ready, F.lit(False))
    short_better = go_short & (F.col("short_ev") > F.when(go_long, F.col("long_ev")).otherwise(0.0))
    out = out.withColumn("signal", F.when(short_better, "short").when(go_long, "long").otherwise("flat"))
    value = F.when(F.col("signal") == "short", F.col("short_ev")).when(F.col("signal") == "long", F.col("long_ev")).otherwise(0.0)
    blocked = (
        F.when(n < c.min_observations, "insufficient_observations").when(F.col("signal_confidence") < c.min_confidence, "low_confidence")
        .when((F.col("long_ev") < c.min_expected_value) & (~F.col("shortable") | (F.col("short_ev") < c.min_expected_value)), "negative_expected_value")
        .otherwise("candidate_not_selected")
    )
    out = out.withColumns({"expected_value": value, "block_reason": F.when(F.col("signal") == "flat", blocked)})
    score = F.col("expected_value") * F.col("signal_confidence") * F.greatest(F.col("liquidity_score"), F.lit(0.05)) / F.greatest(F.col("volatility"), F.lit(0.01))
    return out.withColumn("base_score", F.when(F.col("signal") == "flat", 0.0).otherwise(score)).withColumn("bounded_score", bounded(F.col("base_score")))


def latest(frame: DataFrame) -> DataFrame:
    """The last row of each symbol: an aggregate, so no symbol is sorted."""
    columns = [c for c in frame.columns if c not in ("symbol", "ts")]
    last = frame.groupBy("symbol").agg(F.max_by(F.struct("ts", *columns), "ts").alias("r"))
    return last.select("symbol", "r.*")


def capped(candidates: DataFrame, per_time: int | None, per_class: int | None) -> DataFrame:
    """Active candidates ranked at each time and within each asset class, with ties by symbol; what is
    beyond a limit becomes flat. A limit of None or 0 is none."""
    active = F.col("signal") != "flat"
    best = [active.desc(), F.col("base_score").desc(), F.col("symbol")]
    rank = F.row_number().over(Window.partitionBy("ts").orderBy(*best))
    own = F.row_number().over(Window.partitionBy("ts", "asset_class").orderBy(*best))
    out = candidates.withColumns({"selection_rank": F.when(active, rank), "asset_class_rank": F.when(active, own)})
    passes = lambda r, limit: F.lit(True) if not limit else F.coalesce(F.col(r) <= limit, F.lit(True))
    out = out.withColumn("cap_passed", passes("selection_rank", per_time) & passes("asset_class_rank", per_class))
    return out.withColumn("final_signal", F.when(F.col("cap_passed"), F.col("signal")).otherwise("flat"))


GATES = ("observation_pass", "confidence_pass", "value_pass", "cap_pass")


def gates(candidates: DataFrame, c: SignalConfig = DEFAULT) -> DataFrame:
    n = F.coalesce(F.col("observations"), F.lit(0))
    return candidates.withColumns({
        "observation_pass": n >= c.min_observations,
        "confidence_pass": F.col("signal_confidence") >= c.min_confidence,
        "value_pass": F.col("signal") != "flat",
        "cap_pass": F.col("final_signal") != "flat",
    })


def gate_breakdown(candidates: DataFrame, group: str = "asset_class", names: tuple[str, ...] = GATES) -> DataFrame:
    """The ordered funnel of each group: what every gate rejects of what the gates before it left."""
    first = F.coalesce(*(F.when(~F.coalesce(F.col(name), F.lit(False)), k) for k, name in enumerate(names)), F.lit(len(names)))
    stops = candidates.select(group, first.alias("_k")).groupBy(group).agg(F.count("*").alias("candidate_count"), *(F.count_if(F.col("_k") == k).alias(f"_{k}") for k in range(len(names))))
    left, parts = F.col("candidate_count"), []
    for k, name in enumerate(names):
        left = left - F.col(f"_{k}")
        parts.append(F.struct(F.lit(k).alias("gate_order"), F.lit(name).alias("gate_name"), F.col(f"_{k}").alias("rejected_count"), left.alias("remaining_count")))
    out = stops.select(group, "candidate_count", F.inline(F.array(*parts)))
    at = F.col("rejected_count") + F.col("remaining_count")
    return out.withColumns({
        "rejection_rate": F.col("rejected_count") / F.col("candidate_count"),
        "incremental_rejection_rate": F.col("rejected_count") / F.greatest(at, F.lit(1)),
        "cumulative_rejection_rate": 1 - F.col("remaining_count") / F.col("candidate_count"),
    })


def starvation(breakdown: DataFrame, group: str = "asset_class") -> DataFrame:
    """The gate that rejects the most in each group, ties to the first gate."""
    w = Window.partitionBy(group).orderBy(F.col("rejected_count").desc(), "gate_order")
    return breakdown.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(group, "gate_name", "rejected_count")

"""Per-symbol features of bars, as window expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import deviation, ewm, mean, nullif, order, previous, rolling, zscore


@dataclass(frozen=True)
class FeatureConfig:
    """The default windows of the features."""

    return_horizons: tuple[int, ...] = (1, 3, 5, 10, 20, 60)
    atr_window: int = 14
    volatility_window: int = 20
    rsi_window: int = 14
    moving_average_windows: tuple[int, ...] = (10, 20, 50, 200)
    zscore_window: int = 20
    volume_window: int = 20
    return_zscore_window: int = 20
    acceleration_pairs: tuple[tuple[int, int], ...] = ((3, 10), (5, 20), (20, 60))
    bars_per_year_equity: int = 252
    bars_per_year_crypto: int = 365


DEFAULT = FeatureConfig()


def true_range(keys: tuple[str, ...] = ()) -> F.Column:
    before = previous(F.col("close"), 1, *keys)
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def run_length(bars: DataFrame, label: str, out: str) -> DataFrame:
    """Position within the run of equal labels, from 1."""
    change = F.coalesce((F.col(label) != F.lag(label).over(order())).cast("int"), F.lit(1))
    marked = bars.withColumn("_run", F.sum(change).over(order()))
    return marked.withColumn(out, F.row_number().over(Window.partitionBy("symbol", "_run").orderBy("ts"))).drop("_run")


def features(bars: DataFrame, c: FeatureConfig = DEFAULT) -> DataFrame:
    """``bars`` with all features; null where a window is not full."""
    close, volume = F.col("close"), F.col("volume")
    out = bars.withColumns({"log_return_1": F.log(close) - F.log(previous(close)), "_tr": true_range(), "_delta": close - previous(close), "_dollar": close * volume})
    first = {f"return_{h}": close / previous(close, h) - 1 for h in c.return_horizons}
    annual = F.sqrt(F.when(F.col("asset_class") == "crypto", c.bars_per_year_crypto).otherwise(c.bars_per_year_equity).cast("double"))
    v, z, n = c.volatility_window, c.zscore_window, c.volume_window
    first |= {f"atr_{c.atr_window}": mean(F.col("_tr"), c.atr_window), f"realized_vol_{v}": deviation(F.col("log_return_1"), v) * annual}
    first |= {f"ma_{w}": mean(close, w) for w in c.moving_average_windows}
    first |= {f"zscore_close_{z}": zscore(close, z)}
    low, high = rolling(F.min, F.col("low"), z), rolling(F.max, F.col("high"), z)
    first |= {f"price_position_{z}": (close - low) / nullif(high - low), f"range_efficiency_{z}": F.abs(close - previous(close, z)) / nullif(rolling(F.sum, F.abs(F.col("_delta")), z))}
    first |= {f"volume_mean_{n}": mean(volume, n), f"volume_zscore_{n}": zscore(volume, n), f"dollar_volume_{n}": mean(F.col("_dollar"), n)}
    out = out.withColumns(first)
    vol, atr = F.col(f"realized_vol_{v}"), F.col(f"atr_{c.atr_window}")
    second = {f"return_rate_{h}": F.col(f"return_{h}") / max(h, 1) for h in c.return_horizons}
    second |= {f"return_zscore_{h}_{c.return_zscore_window}": zscore(F.col(f"return_{h}"), c.return_zscore_window) for h in c.return_horizons}
    second |= {f"atr_pct_{c.atr_window}": atr / close, f"vol_zscore_{v}": zscore(vol, v), f"vol_regime_{v}": vol / mean(vol, v), f"vol_delta_{v}": vol - previous(vol)}
    second |= {f"ma_gap_{w}": close / F.col(f"ma_{w}") - 1 for w in c.moving_average_windows}
    second |= {f"volume_ratio_{n}": volume / nullif(F.col(f"volume_mean_{n}"))}
    fast, slow = min(c.moving_average_windows), max(c.moving_average_windows)
    second |= {"trend_spread": F.col(f"ma_{fast}") / F.col(f"ma_{slow}") - 1, "atr_normalized_move_1": F.col("_delta") / nullif(atr)}
    second |= {f"atr_normalized_close_to_sma{w}": (close - F.col(f"ma_{w}")) / nullif(atr) for w in (20, 50, 200) if w in c.moving_average_windows}
    out = out.withColumns(second)
    ratio = F.col(f"volume_ratio_{n}")
    third = {f"sma_distance_{w}": F.col(f"ma_gap_{w}") for w in c.moving_average_windows}
    third |= {f"vol_expansion_{v}": F.col(f"vol_regime_{v}") - 1, f"volume_regime_{n}": F.when(ratio >= 1.25, "expansion").when(ratio <= 0.8, "contraction").otherwise("normal")}
    third |= {f"return_accel_{a}_{b}": F.col(f"return_rate_{a}") - F.col(f"return_rate_{b}") for a, b in c.acceleration_pairs if {a, b} <= set(c.return_horizons)}
    third |= {"trend_direction_feature": F.when(F.col("trend_spread") > 0, "up").when(F.col("trend_spread") < 0, "down").otherwise("neutral")}
    out = out.withColumns(third).drop("_tr", "_delta", "_dollar")
    return run_length(out, "trend_direction_feature", "trend_persistence")


def rsi(bars: DataFrame, c: FeatureConfig = DEFAULT) -> DataFrame:
    """``bars`` with Wilder's relative strength index and its zone."""
    n = c.rsi_window
    delta = F.col("close") - previous(F.col("close"))
    out = bars.withColumns({"_gain": F.greatest(delta, F.lit(0.0)), "_loss": F.greatest(-delta, F.lit(0.0))})
    out = out.withColumns({k: F.when(delta.isNull(), None).otherwise(F.col(k)) for k in ("_gain", "_loss")})
    out = out.withColumns({"_g": ewm(F.col("_gain"), 1 / n, n), "_l": ewm(F.col("_loss"), 1 / n, n)})
    g, loss = F.col("_g"), F.col("_l")
    value = F.when((loss == 0) & (g > 0), 100.0).when((loss == 0) & (g == 0), 50.0).otherwise(100 - 100 / (1 + g / nullif(loss)))
    out = out.withColumn(f"rsi_{n}", value)
    zone = F.when(F.col(f"rsi_{n}") >= 70, "overbought").when(F.col(f"rsi_{n}") <= 30, "oversold").otherwise("neutral")
    return out.withColumn("rsi_zone", zone).drop("_gain", "_loss", "_g", "_l")

"""Strategy signals outside the state pipeline, and cross-sectional statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.positions import numbered
from ..functions.windows import deviation, ewm, mean, nullif, order, previous, rolling, zscore
from .features import true_range


def _before(n: int, *keys: str):
    return order(*keys).rowsBetween(-n, -1)


def breakout(bars: DataFrame, n: int = 15, volume: float = 1.2) -> DataFrame:
    """Bars that close above the high of the n bars before, rising, on at least ``volume`` times their mean
    volume, where these bars follow each other hour by hour."""
    w = _before(n)
    out = bars.withColumns({"level": F.max("high").over(w), "mean_volume": F.avg("volume").over(w), "seen": F.count("*").over(w), "since": F.min("ts").over(w), "last_close": previous(F.col("close"))})
    together = (F.col("seen") == n) & (F.col("since") == F.col("ts") - F.expr(f"INTERVAL {n} HOURS"))
    hit = together & (F.col("close") > F.col("level")) & (F.col("close") > F.col("last_close")) & (F.col("volume") >= volume * F.col("mean_volume"))
    return out.where(hit).select("symbol", "ts", "level", "close", (F.col("volume") / nullif(F.col("mean_volume"))).alias("relative_volume"))


def session_signals(bars: DataFrame, opening: int = 3, lookback: int = 5, atr: int = 14, volume: float = 1.2, price: float = 5.0, dollars: float = 100_000.0) -> DataFrame:
    """Session VWAP, fast and slow mean, relative volume, opening range, true range, breakout and recovery; all
    windows are within a symbol's session. An entry also needs the least price, traded value and relative
    volume, and a true range mean over ``atr`` bars."""
    keys = ("symbol", "session")
    so_far = order(*keys).rowsBetween(Window.unboundedPreceding, 0)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    n = F.row_number().over(order(*keys))
    close, back = F.col("close"), lambda x: F.lag(x).over(order(*keys))
    reach = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - back("close")), F.abs(F.col("low") - back("close")))
    out = bars.withColumns({
        "minute": n, "vwap": F.sum(typical * F.col("volume")).over(so_far) / nullif(F.sum("volume").over(so_far)),
        "fast": ewm(F.col("close"), 2 / 10, 1, *keys), "slow": ewm(F.col("close"), 2 / 22, 1, *keys), "_tr": reach,
        "relative_volume": F.col("volume") / nullif(F.when(F.count("*").over(_before(lookback, *keys)) == lookback, F.avg("volume").over(_before(lookback, *keys)))),
        "opening_high": F.max(F.when(n <= opening, F.col("high"))).over(so_far),
    })
    recent = order(*keys).rowsBetween(-(atr - 1), 0)
    out = out.withColumn("atr", F.when(F.count("_tr").over(recent) == atr, F.avg("_tr").over(recent))).drop("_tr")
    broke = (close > F.col("opening_high")) & (back("close") <= back("opening_high"))
    recovered = (close > F.col("vwap")) & (back("close") <= back("vwap")) & (F.col("fast") > back("fast"))
    liquid = (close >= price) & (close * F.col("volume") >= dollars) & (F.col("relative_volume") >= volume) & (F.col("atr") > 0)
    ready = (F.col("minute") > max(opening, lookback)) & (F.col("fast") > F.col("slow")) & (close > F.col("vwap")) & liquid
    out = out.withColumns({"breakout": F.coalesce(broke, F.lit(False)), "recovery": F.coalesce(recovered, F.lit(False))})
    return out.withColumns({"entry": F.coalesce(ready & (F.col("breakout") | F.col("recovery")), F.lit(False)), "setup": F.when(F.col("breakout"), "opening_breakout").otherwise("vwap_recovery")})


def momentum(bars: DataFrame, horizon: int = 20) -> DataFrame:
    """Return over a horizon for each unit of volatility, positive ones only, with the true range mean."""
    out = bars.withColumns({"_r": F.col("close") / previous(F.col("close")) - 1, "_tr": true_range(), "momentum": F.col("close") / previous(F.col("close"), horizon) - 1})
    out = out.withColumns({"volatility": deviation(F.col("_r"), 20), "atr": mean(F.col("_tr"), 14)})
    return out.withColumn("score", F.col("momentum") / nullif(F.col("volatility"))).where("momentum > 0 and volatility > 0 and atr > 0").select("symbol", "ts", "momentum", "volatility", "score", "atr")


def daily_features(bars: DataFrame) -> DataFrame:
    """Trend above the 200 mean, 127 to 22 momentum, 63 and 21 channels and 60 volatility of each bar."""
    close = F.col("close")
    out = bars.withColumns({"_r": close / previous(close) - 1, "_n": F.row_number().over(order())})
    return out.withColumns({
        "trend": close > mean(close, 200), "rotation": previous(close, 21) / previous(close, 126) - 1,
        "breakout": (F.col("_n") >= 64) & (close > F.max(close).over(_before(63))), "breakdown": (F.col("_n") >= 64) & (close < F.min(close).over(_before(21))),
        "volatility": F.when(F.col("_n") >= 61, deviation(F.col("_r"), 60)),
    }).drop("_r", "_n")


def due(bars: DataFrame) -> DataFrame:
    """Which sessions are decision dates: the last of a month, of an ISO week, or any."""
    s = bars.select("ts").distinct().withColumn("next_ts", F.lead("ts").over(Window.orderBy("ts"))).where("next_ts is not null")
    week = lambda c: F.struct(F.extract(F.lit("YEAROFWEEK"), F.col(c)), F.weekofyear(c))
    return s.select("ts", (F.date_trunc("month", "ts") != F.date_trunc("month", "next_ts")).alias("month_end"), (week("ts") != week("next_ts")).alias("week_end"))


def inverse_volatility(features: DataFrame, total: float = 0.25, cap: float = 0.10) -> DataFrame:
    """Weights by inverse volatility at each time, capped for each symbol."""
    f = features.where("volatility > 0").withColumn("_i", 1 / F.col("volatility"))
    return f.select("symbol", "ts", F.least(F.lit(cap), total * F.col("_i") / F.sum("_i").over(Window.partitionBy("ts"))).alias("weight"))


def rotation(features: DataFrame, top: int = 2) -> DataFrame:
    """The best symbols by rotation score at each time, if positive; ties by symbol."""
    w = Window.partitionBy("ts").orderBy(F.col("rotation").desc(), "symbol")
    return features.where("rotation is not null").withColumn("place", F.row_number().over(w)).where((F.col("place") <= top) & (F.col("rotation") > 0)).select("ts", "symbol", "place", "rotation")


def channel(bars: DataFrame, enter: int = 20, leave: int = 10) -> DataFrame:
    """Breakouts over the closes before, and exits below them."""
    close = F.col("close")
    up, down = F.max(close).over(_before(enter)), F.min(close).over(_before(leave))
    ready = F.count("*").over(_before(enter)) == enter
    return bars.select("symbol", "ts", (ready & (close > up)).alias("enter"), (ready & (close < down)).alias("leave"))


def session_reversion(bars: DataFrame, n: int = 30, atr: int = 14, step_s: int = 60, opens: int = 630, closes: int = 870, threshold: float = -2.0, efficiency: float = 0.25) -> DataFrame:
    """Session bars far below the session's VWAP in units of the log price's deviation over n bars, rising, in a
    market without direction, with the first reason that speaks against the others. A decision is known one step
    after its bar begins and must fall between two minutes of the day; a gap or a malformed bar earlier in the
    session rules out all that follow. All windows are within a symbol's session and look back only."""
    keys = ("symbol", "session")
    w, close, volume = order(*keys), F.col("close"), F.col("volume")
    so_far, recent = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(-(n - 1), 0)
    full = lambda x, size, f: F.when(F.count(x).over(w.rowsBetween(-(size - 1), 0)) == size, f(x).over(w.rowsBetween(-(size - 1), 0)))
    last = F.lag("close").over(w)
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    sound = finite("high") & finite("low") & finite("close") & finite("volume") & (F.least("high", "low", "close") > 0) & (volume >= 0)
    gap = F.coalesce((F.timestamp_diff("MICROSECOND", F.lag("ts").over(w), F.col("ts")) != step_s * 1_000_000).cast("int"), F.lit(0))
    out = bars.withColumns({
        "_n": F.row_number().over(w), "_move": F.abs(close - last), "_log": F.log("close"), "last_close": last, "_tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - last), F.abs(F.col("low") - last)),
        "_gap": gap, "_bad": (~sound).cast("int"), "_sold": F.sum("volume").over(so_far), "vwap": F.sum(close * volume).over(so_far) / nullif(F.sum("volume").over(so_far)),
    })
    known = F.col("ts") + F.expr(f"INTERVAL {step_s} SECONDS")
    out = out.withColumns({
        "sigma": full(F.col("_log"), n, F.stddev_samp), "_path": full(F.col("_move"), n, F.sum), "atr": full(F.col("_tr"), atr, F.avg), "_gaps": F.sum("_gap").over(so_far), "_bads": F.sum("_bad").over(so_far),
        "minute": F.hour(known) * 60 + F.minute(known), "_far": F.abs(close - F.lag("close", n).over(w)),
    })
    out = out.withColumns({"z": (F.col("_log") - F.log("vwap")) / nullif(F.col("sigma")), "path": F.col("_far") / nullif(F.col("_path"))})
    zero = (F.col("_sold") <= 0) | F.coalesce(F.col("sigma") <= 0, F.lit(False)) | F.coalesce(F.col("_path") <= 0, F.lit(False))
    chosen = F.coalesce((F.col("z") <= threshold) & (close > F.col("last_close")) & (F.col("path") <= efficiency) & (F.col("atr") > 0), F.lit(False))
    reason = (
        F.when(~F.col("minute").between(opens, closes), "outside_signal_window").when(F.col("_n") <= n, "insufficient_history").when(F.col("_gaps") > 0, "missing_minute")
        .when(F.col("_bads") > 0, "invalid_observation").when(zero, "zero_denominator").when(~chosen, "signal_filter").otherwise("qualified")
    )
    return out.select("symbol", "ts", "z", "path", "vwap", "atr", reason.alias("reason"), F.coalesce(-F.col("z"), F.lit(0.0)).alias("score"))


def pair_forecasts(bars: DataFrame, pairs: DataFrame, n: int = 60, lag: int = 6, training: int = 120, least: int = 40) -> DataFrame:
    """Forecasts of pair spreads. ``pairs``: a, b (symbols); ``bars``: symbol, ts, open, close.

    A rolling regression of log closes over the n sessions before gives beta, kept within 0.5 to 1.5, and the
    feature: how far the session lies off it. The label is the spread's return from the next open to the open
    ``lag`` sessions ahead. A second regression of labels on features, over the last ``training`` sessions whose
    labels are complete, gives the forecast and its standard error; it needs ``least`` labels.
    """
    side = lambda s, x: bars.select(F.col("symbol").alias(s), "ts", F.log("close").alias(x), F.col("open").alias(f"open_{s}"))
    joined = pairs.join(side("a", "y"), "a").join(side("b", "x"), ["b", "ts"])
    w = Window.partitionBy("a", "b").orderBy("ts")
    past = w.rowsBetween(-n, -1)
    mean = lambda c, frame: F.avg(c).over(frame)
    out = joined.withColumns({"_n": F.count("*").over(past), "_mx": mean("x", past), "_my": mean("y", past)})
    out = out.withColumns({
        "_xx": mean(F.col("x") * F.col("x"), past) - F.col("_mx") * F.col("_mx"), "_xy": mean(F.col("x") * F.col("y"), past) - F.col("_mx") * F.col("_my"), "_yy": mean(F.col("y") * F.col("y"), past) - F.col("_my") * F.col("_my"),
    })
    slope = F.when((F.col("_n") == n) & (F.col("_xx") * n > 1e-12), F.col("_xy") / nullif(F.col("_xx")))
    out = out.withColumn("_slope", slope)
    noise = F.sqrt(F.greatest(F.col("_yy") - F.col("_slope") * F.col("_xy"), F.lit(0.0)) * n / (n - 2))
    out = out.withColumn("beta", F.when(F.col("_slope").between(0.5, 1.5) & (noise > 1e-10), F.col("_slope")))
    gap = F.col("y") - F.col("_my") - F.col("beta") * (F.col("x") - F.col("_mx"))
    gain = lambda s: F.lead(f"open_{s}", lag).over(w) / F.lead(f"open_{s}", 1).over(w) - 1
    out = out.withColumns({"feature": -gap / (1 + F.col("beta")), "label": (gain("a") - F.col("beta") * gain("b")) / (1 + F.col("beta")), "_ready": F.lead("ts", lag).over(w)})
    has = F.col("feature").isNotNull() & F.col("label").isNotNull()
    f, g = F.when(has, F.col("feature")), F.when(has, F.col("label"))
    seen = w.rowsBetween(-(lag + training - 1), -lag)
    out = out.withColumns({"labels": F.count(f).over(seen), "_mf": mean(f, seen), "_mg": mean(g, seen), "_ff": mean(f * f, seen), "_fg": mean(f * g, seen), "_gg": mean(g * g, seen), "last_label_at": F.max(F.when(has, F.col("_ready"))).over(seen)})
    m, df, dg = F.col("labels"), F.col("_ff") - F.col("_mf") * F.col("_mf"), F.col("_gg") - F.col("_mg") * F.col("_mg")
    cov = F.col("_fg") - F.col("_mf") * F.col("_mg")
    b = cov / nullif(df)
    sigma = F.sqrt(F.greatest(dg - b * cov, F.lit(0.0)) * m / nullif(m - 2))
    off = F.col("feature") - F.col("_mf")
    out = out.withColumns({"prediction": F.col("_mg") + b * off, "standard_error": sigma * F.sqrt(1 / m + off * off / nullif(df * m)), "pair": F.concat_ws("/", "a", "b")})
    usable = F.col("feature").isNotNull() & (m >= least) & (df * m > 1e-14)
    return out.where(usable).select("pair", F.col("ts").alias("signal_at"), "feature", "beta", "prediction", "standard_error", "labels", "last_label_at", "label", F.when(F.col("label").isNotNull(), F.col("_ready")).alias("label_at"))


def correlations(bars: DataFrame) -> DataFrame:
    """Correlation of returns for each pair of symbols on common days; null without variance."""
    r = bars.withColumn("r", F.col("close") / previous(F.col("close")) - 1).where("r is not null").select("symbol", "ts", "r")
    p = r.withColumnsRenamed({"symbol": "a", "r": "x"}).join(r.withColumnsRenamed({"symbol": "b", "r": "y"}), "ts").where("a < b")
    spread = F.stddev_pop("x") * F.stddev_pop("y")
    return p.groupBy("a", "b").agg(F.count("*").alias("days"), (F.covar_pop("x", "y") / nullif(spread)).alias("correlation"))


def round_robin(rows: DataFrame, group: str, score: str, tie: str) -> DataFrame:
    """The rows of all groups interleaved: first of each, second of each, and so on; ``turn`` is the row's place in its
    group, ``place`` that among all. Both are positions by ranges, so neither a large group nor the whole is one task, and
    it does not matter how many groups there are. The group must not be null."""
    turns = numbered(rows, group, [score, tie], "turn")
    return numbered(turns, None, ["turn", group], "place")


def cost_levels(trades: DataFrame, levels: tuple[float, ...] = (2.0, 5.0, 7.0, 10.0)) -> DataFrame:
    """Profit of fixed fills at several costs in basis points, and the cost that leaves none: from the two
    sums, so the trades are read once and not repeated for each level."""
    s = trades.groupBy("symbol").agg(F.sum("pnl").alias("gross"), F.sum("entry_notional").alias("notional"))
    out = s.select("*", F.explode(F.array(*(F.lit(x) for x in levels))).alias("cost_bps"))
    return out.select("symbol", "cost_bps", (F.col("gross") - F.col("notional") * F.col("cost_bps") / 10000).alias("net"), (F.col("gross") / nullif(F.col("notional")) * 10000).alias("break_even_bps"))


def buckets(rows: DataFrame, x: str, y: str, n: int) -> DataFrame:
    """Equal-width buckets of x between its ends with mean, least, median and greatest y."""
    ends = rows.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    k = F.least(F.floor((F.col(x) - F.col("_lo")) / nullif(F.col("_hi") - F.col("_lo")) * n), F.lit(n - 1))
    return rows.crossJoin(F.broadcast(ends)).groupBy(k.alias("bucket")).agg(F.count("*").alias("n"), F.avg(y).alias("mean"), F.min(y).alias("least"), F.median(y).alias("median"), F.max(y).alias("greatest"))

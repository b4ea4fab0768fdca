"""Row validation, calendars, coverage and quotes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import nullif


def bar_faults() -> Column:
    """The reasons why a bar is malformed, as an array."""
    o, h, low, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    sound = finite(o) & finite(h) & finite(low) & finite(c) & finite(v)
    rules = {
        "not_finite": ~sound,
        "nonpositive_price": sound & ((o <= 0) | (h <= 0) | (low <= 0) | (c <= 0)),
        "inconsistent_range": sound & ((h < F.greatest(o, c, low)) | (low > F.least(o, c, h))),
        "negative_volume": sound & (v < 0),
    }
    return F.array_compact(F.array(*(F.when(rule, name) for name, rule in rules.items())))


def validate_bars(bars: DataFrame) -> DataFrame:
    """Faults of each symbol: rows by reason, and timestamps that occur twice."""
    rows = bars.withColumn("f", bar_faults())
    twice = bars.groupBy("symbol", "ts").count().where("count > 1").groupBy("symbol").agg(F.count("*").alias("duplicate_timestamps"))
    has = lambda name: F.count_if(F.array_contains("f", name)).alias(name)
    out = rows.groupBy("symbol").agg(F.count("*").alias("bars"), *(has(n) for n in ("not_finite", "nonpositive_price", "inconsistent_range", "negative_volume")))
    return out.join(twice, "symbol", "left").withColumn("duplicate_timestamps", F.coalesce("duplicate_timestamps", F.lit(0)))


def sessions(bars: DataFrame) -> DataFrame:
    """(session, opens, closes): first and last hour of any symbol on a day."""
    return bars.groupBy("session").agg(F.min("ts").alias("opens"), F.max("ts").alias("closes"))


def coverage(bars: DataFrame, schedule: DataFrame, symbols: DataFrame, step: str = "INTERVAL 1 HOUR") -> DataFrame:
    """Expected, observed and missing bars for each symbol and session: the generated grid against the
    bars. The grid has a row for each step of a session and symbol; both are small dimensions."""
    grid = schedule.select("session", F.explode(F.sequence("opens", "closes", F.expr(step))).alias("ts")).join(symbols)
    have = bars.select("symbol", "ts", F.lit(1).alias("have"))
    joined = grid.join(have, ["symbol", "ts"], "left")
    missing = F.when(F.col("have").isNull(), F.col("ts"))
    return joined.groupBy("symbol", "session").agg(F.count("*").alias("expected"), F.count("have").alias("observed"), F.count(missing).alias("missing"), F.min(missing).alias("first_missing"))


@dataclass(frozen=True)
class QuotePolicy:
    """Limits of an acceptable quote."""

    min_ask: float = 1.0
    max_spread_bps: float = 50.0


def validated_quotes(quotes: DataFrame, policy: QuotePolicy = QuotePolicy()) -> DataFrame:
    """Each quote with its spread and its reasons, in a fixed order; no reason means valid."""
    bid, ask = F.col("bid"), F.col("ask")
    bad_price = (bid <= 0) | (ask <= 0)
    crossed = ~bad_price & (bid > ask)
    spread = F.when(~bad_price & ~crossed, (ask - bid) / ((ask + bid) / 2) * 10000)
    rules = [
        (bid.isNull() | ask.isNull(), "invalid_price"), (bad_price, "nonpositive_price"), (crossed, "crossed_quote"), (spread > policy.max_spread_bps, "excessive_spread"),
        (ask < policy.min_ask, "ask_below_minimum"), (F.col("bid_size") <= 0, "nonpositive_bs"), (F.col("ask_size") <= 0, "nonpositive_as"),
    ]
    reasons = F.array_compact(F.array(*(F.when(rule, name) for rule, name in rules)))
    return quotes.withColumns({"spread_bps": spread, "reasons": F.concat_ws(",", reasons), "valid": F.size(reasons) == 0})


def quote_features(quotes: DataFrame) -> DataFrame:
    bid, ask, bs, as_ = (F.col(x) for x in ("bid", "ask", "bid_size", "ask_size"))
    total = nullif(bs + as_)
    return quotes.withColumns({"mid": (bid + ask) / 2, "micro_price": (ask * bs + bid * as_) / total, "imbalance": (bs - as_) / total})


def quote_batch(symbols: DataFrame, quotes: DataFrame) -> DataFrame:
    """The latest quote of each symbol, judged; a symbol without one has the reason ``missing_quote``."""
    last = quotes.groupBy("symbol").agg(F.max_by(F.struct("event_id", "ts", "bid", "ask", "bid_size", "ask_size"), F.struct("ts", "event_id")).alias("q")).select("symbol", "q.*")
    judged = validated_quotes(last)
    out = symbols.join(judged, "symbol", "left")
    return out.withColumns({"reasons": F.when(F.col("event_id").isNull(), "missing_quote").otherwise(F.col("reasons")), "valid": F.coalesce("valid", F.lit(False))})


def as_of(left: DataFrame, right: DataFrame, columns: list[str], key: str = "symbol", at: str = "ts") -> DataFrame:
    """Each left row with the latest right row at or before its time: both tables go through one sort by
    key and time, and the last seen right row is carried along."""
    l_ = left.select(key, at, F.struct(*left.columns).alias("_l"), F.lit(1).alias("_o"), F.lit(None).cast(right.select(F.struct(*columns)).schema[0].dataType).alias("_r"))
    r_ = right.select(key, at, F.lit(None).cast(l_.schema["_l"].dataType).alias("_l"), F.lit(0).alias("_o"), F.struct(*columns).alias("_r"))
    w = Window.partitionBy(key).orderBy(at, "_o").rowsBetween(Window.unboundedPreceding, 0)
    seen = l_.unionByName(r_).withColumn("_r", F.last("_r", ignorenulls=True).over(w))
    return seen.where("_o = 1").select("_l.*", *(F.col("_r")[c].alias(f"asof_{c}") for c in columns))

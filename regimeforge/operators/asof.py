"""Lookups in time: what was known when, extremes while a position is held, and price levels over corporate actions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import order


def latest_known(asks: DataFrame, quotes: DataFrame, key: str, at: str, event: str, received: str, fields: Sequence[str], bucket: Column | None = None, prefix: str = "quote_") -> DataFrame:
    """``asks`` with the fields of the quote of their key that has the latest event, then the latest receipt, of
    those received at ``at`` or before. A quote received later does not count, however old its event; a late receipt of
    an old event does not displace a newer event. Fields are null where nothing was received.

    Both meet in one window, in order of receipt, as a running maximum of (event, receipt); a busy key is cut by
    ``bucket`` of that time (default: day), and what came before a bucket is one value. Quotes with null times are
    left out; equal times go by the fields in order.
    """
    cut = (lambda c: F.to_date(c)) if bucket is None else bucket
    kept = [key, *asks.columns]
    best = F.struct(F.col(event).alias("_e"), F.col(received).alias("_r"), *fields)
    q = quotes.where(F.col(event).isNotNull() & F.col(received).isNotNull()).select(F.col(key).alias("_key"), F.col(received).alias("_at"), F.lit(0).alias("_kind"), best.alias("_best"), F.lit(None).cast(asks.select(F.struct("*").alias("x")).schema["x"].dataType).alias("_ask"))
    a = asks.select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(q.schema["_best"].dataType).alias("_best"), F.struct("*").alias("_ask"))
    both = q.unionByName(a).withColumn("_b", cut("_at"))
    tops = both.groupBy("_key", "_b").agg(F.max("_best").alias("_top"))
    past = Window.partitionBy("_key").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("_key", "_b", F.max("_top").over(past).alias("_top"))
    here = Window.partitionBy("_key", "_b").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_own", F.max("_best").over(here)).where("_kind = 1")
    out = out.join(tops, out["_key"].eqNullSafe(tops["_key"]) & out["_b"].eqNullSafe(tops["_b"]), "left")
    found = F.greatest("_own", "_top")
    names = [(event, "_e"), (received, "_r"), *((f, f) for f in fields)]
    return out.select(*(F.col("_ask")[c].alias(c) for c in kept[1:]), *(found[f].alias(f"{prefix}{n}") for n, f in names))


def select_contracts(decisions: DataFrame, contracts: DataFrame, target_days: int = 52) -> DataFrame:
    """(decision_id, contract, expiry, strike): of the eligible contracts of each decision's underlying the one whose
    expiry is nearest to ``target_days`` ahead, then the earlier expiry, the strike nearest to the midpoint, the lower
    strike, the first symbol.

    ``decisions``: decision_id, underlying, session, midpoint; ``contracts``: underlying, symbol, expiry, strike, listed
    (first and last session of its quotes). Contracts that expire by the session or are not listed then are not
    eligible. The expiry is chosen once for each underlying and session. The contracts of an expiry that are listed over the same
    sessions are one chain: each midpoint asked of a chain meets its strikes in one sorted pass, which leaves it the
    nearest strike on either side. So no decision is joined with a chain's contracts. A contract without a strike comes last; without a
    midpoint the lowest strike counts. Decisions without a contract have nulls.
    """
    chain = ["underlying", "expiry", "first_session", "last_session"]
    listed = F.col("session").between(F.col("first_session"), F.col("last_session")) & (F.col("expiry") > F.col("session"))
    chains = contracts.select(*chain).distinct()
    asked = decisions.select("underlying", "session", "midpoint").distinct()
    near = asked.select("underlying", "session").distinct().join(chains, "underlying").where(listed)
    far = F.abs(F.datediff("expiry", "session") - target_days)
    first = near.groupBy("underlying", "session").agg(F.min(F.struct(far.alias("far"), "expiry")).alias("x")).select("underlying", "session", F.col("x.expiry").alias("expiry"))
    lowest, none = F.lit(float("-inf")), F.lit(float("inf"))
    at = F.coalesce(F.nanvl(F.col("midpoint").cast("double"), lowest), lowest)
    asked = asked.withColumn("_at", at).join(near.join(first, ["underlying", "session", "expiry"]), ["underlying", "session"])

    # one row for each strike of a chain and one for each midpoint asked of it
    strikes = contracts.groupBy(*chain, "strike").agg(F.min("symbol").alias("contract"))
    strikes = strikes.select(*chain, F.coalesce(F.col("strike").cast("double"), none).alias("_at"), F.struct("strike", "contract").alias("_c"))
    asks = asked.select(*chain, "_at").distinct().withColumn("_c", F.lit(None).cast(strikes.schema["_c"].dataType))
    side = lambda order: F.last("_c", True).over(Window.partitionBy(*chain).orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    met = strikes.unionByName(asks).withColumns({"_below": side(F.col("_at").asc()), "_above": side(F.col("_at").desc())}).where("_c is null")
    rated = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.coalesce(F.col(f"{c}.strike"), none) - F.col("_at")).alias("off"), F.coalesce(F.col(f"{c}.strike"), none).alias("by"), F.col(f"{c}.contract").alias("contract"), F.col(f"{c}.strike").alias("strike"), "expiry"))
    met = met.select(*chain, "_at", F.least(rated("_below"), rated("_above")).alias("x"))
    best = asked.join(met, [*chain, "_at"]).groupBy("underlying", "session", "_at").agg(F.min("x").alias("x"))
    out = decisions.select("decision_id", "underlying", "session", at.alias("_at")).join(best, ["underlying", "session", "_at"], "left")
    return out.select("decision_id", "underlying", "session", "x.contract", "x.expiry", "x.strike")


def excursions(spans: DataFrame, bars: DataFrame, bucket: Column | None = None) -> DataFrame:
    """(trade_id, bars_held, mae_pct, mfe_pct, censored): worst and best price of each position against its entry, in
    the position's direction, from 0.

    ``spans``: trade_id (unique), symbol, direction (1 or -1), entry_ts, exit_ts, entry_price, stop_price (null: not stopped).
    Bars after the entry up to the exit count by their high and low; of the bar in which a stop was hit only the open
    and the stop price are known to lie in the holding time: the excursion is censored there.

    Bars are cut into buckets of time (default: months). A holding time takes the extremes of the buckets that it covers whole
    from a table of a row for each, and joins bars by symbol and bucket in its first and last one only, so the
    rows joined do not grow with the holding time times bars. Spans of one symbol with the same entry and exit look up once,
    and each span joins what was found. An entry price that is not positive gives nulls.
    """
    cut = (lambda c: F.trunc(c, "month")) if bucket is None else bucket
    key = ["symbol", "entry_ts", "exit_ts"]
    b = bars.select("symbol", "ts", "open", "high", "low", cut("ts").alias("_b"))
    whole = b.groupBy("symbol", "_b").agg(F.max("high").alias("high"), F.min("low").alias("low"), F.count("*").alias("n"))
    s = spans.select(*key).where("entry_ts < exit_ts").distinct().withColumns({"_from": cut("entry_ts"), "_to": cut("exit_ts")})
    months = s.withColumn("_b", F.explode(F.sequence("_from", "_to", F.expr("interval 1 month")))) if bucket is None else s.withColumn("_b", F.explode(F.sequence("_from", "_to")))
    split = lambda: F.pmod(F.xxhash64("symbol", "_b"), F.lit(1024)).alias("_s")
    inner = months.where((F.col("_b") > F.col("_from")) & (F.col("_b") < F.col("_to"))).select(*key, "_b", split()).join(whole.select("*", split()), ["symbol", "_b", "_s"])
    inner = inner.select(*key, "high", "low", "n", *(F.lit(None).cast("double").alias(f"_{c}") for c in ("open", "high", "low")), F.lit(0).alias("_last"))
    edge = months.where((F.col("_b") == F.col("_from")) | (F.col("_b") == F.col("_to"))).select(*key, "_b", split()).join(b.select("*", split()), ["symbol", "_b", "_s"]).where((F.col("ts") > F.col("entry_ts")) & (F.col("ts") <= F.col("exit_ts")))
    last = F.col("ts") == F.col("exit_ts")  # this bar's extremes depend on the stop
    edge = edge.select(*key, *(F.when(~last, F.col(c)).alias(c) for c in ("high", "low")), F.lit(1).cast("long").alias("n"), *(F.when(last, F.col(c)).alias(f"_{c}") for c in ("open", "high", "low")), last.cast("int").alias("_last"))
    seen = inner.unionByName(edge).groupBy(*key).agg(F.max("high").alias("high"), F.min("low").alias("low"), F.sum("n").alias("bars_held"), F.max("_open").alias("_open"), F.max("_high").alias("_high"), F.min("_low").alias("_low"), F.max("_last").alias("_last"))
    out = spans.select("trade_id", *key, "direction", "entry_price", "stop_price").join(seen, key, "left")
    stopped = (F.col("_last") == 1) & F.col("stop_price").isNotNull()
    out = out.withColumns({"high": F.greatest("high", F.when(stopped, F.greatest("_open", "stop_price")).otherwise(F.col("_high"))), "low": F.least("low", F.when(stopped, F.least("_open", "stop_price")).otherwise(F.col("_low")))})
    p = F.when(F.col("entry_price") > 0, F.col("entry_price"))
    up, down = (F.col("high") - p) / p, (F.col("low") - p) / p
    worst, best = F.when(F.col("direction") > 0, down).otherwise(-up), F.when(F.col("direction") > 0, up).otherwise(-down)
    zero = F.when(p.isNotNull(), 0.0)
    return out.select("trade_id", F.coalesce("bars_held", F.lit(0)).alias("bars_held"), F.when(p.isNotNull(), F.least(worst, zero)).alias("mae_pct"), F.when(p.isNotNull(), F.greatest(best, zero)).alias("mfe_pct"), F.col("stop_price").isNotNull().alias("censored"))


def total_return(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """(symbol, ts, close, total_return_index, log_index): the close carried forward with splits and dividends of each ex-date put
    back in: times split_ratio * (close + dividend) / previous close. It starts at the first close.

    A running sum of logarithms over the sessions of a symbol, which is ``log_index``; the index itself is infinite where it is larger
    than a double can be, the logarithm is not. An action on a day without a bar has no effect;
    two actions of a symbol on one day are an error, as their order is not known. Later bars change no earlier row.
    """
    clear = actions.groupBy("symbol", "ts").agg(F.count("*").alias("_n"), F.max("split_ratio").alias("split_ratio"), F.max("dividend").alias("dividend"))
    clear = clear.withColumn("split_ratio", F.when(F.col("_n") > 1, F.raise_error(F.lit("several corporate actions of a symbol on one day")).cast("double")).otherwise(F.col("split_ratio")))
    b = bars.select("symbol", "ts", "close").join(clear, ["symbol", "ts"], "left")
    step = F.coalesce("split_ratio", F.lit(1.0)) * (F.col("close") + F.coalesce("dividend", F.lit(0.0))) / F.lag("close").over(order())
    so_far = order().rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumn("_l", F.coalesce(F.log(step), F.lit(0.0)))
    grown = F.sum("_l").over(so_far)
    return b.select("symbol", "ts", "close", (F.first("close").over(so_far) * F.exp(grown)).alias("total_return_index"), (F.log(F.first("close").over(so_far)) + grown).alias("log_index"))


def discontinuities(bars: DataFrame, actions: DataFrame, least: float = 0.01) -> DataFrame:
    """(symbol, ts, implied): days on which the adjustment of a series jumps by more than ``least`` per share though no
    corporate action is recorded. ``bars``: symbol, ts, close, scale (what the adjusted price is multiplied by)."""
    raw = F.col("close") * F.col("scale")
    implied = F.lag(raw).over(order()) * (1 - F.col("scale") / F.lag("scale").over(order()))
    odd = bars.withColumn("implied", implied).where(F.abs("implied") > least).select("symbol", "ts", "implied")
    return odd.join(actions.select("symbol", "ts"), ["symbol", "ts"], "left_anti")

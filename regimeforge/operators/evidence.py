"""Evidence checks: calendars, minute grids, quotes, contracts, instruments, forecasts and label windows.

Each check is an expression over the row, or a window or join over a small calendar; a row keeps its reasons
as an array in a fixed order, so nothing is dropped before it is counted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import nullif


def reasons(*rules: tuple[Column, str]) -> Column:
    """The names of the rules that hold, in order; a rule that is null does not hold."""
    return F.array_compact(F.array(*(F.when(rule, F.lit(name)) for rule, name in rules)))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def minute_faults(bars: DataFrame) -> DataFrame:
    """Bars that do not start on a minute, or that arrive (``seq``) before an earlier bar of their symbol."""
    w = Window.partitionBy("symbol", F.to_date("ts")).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    late = F.col("ts") < F.max("ts").over(w)
    return bars.withColumn("reasons", reasons((F.date_trunc("minute", "ts") != F.col("ts"), "not_minute_aligned"), (late, "not_chronological")))


def schedule_faults(schedule: DataFrame, order: str = "session") -> DataFrame:
    """A calendar's rows (session, open, close) with what is wrong with each. One row a session."""
    w = Window.orderBy(order)
    minutes = F.timestamp_diff("MICROSECOND", F.col("open"), F.col("close")) / 60_000_000
    aligned = (F.date_trunc("minute", "open") == F.col("open")) & (F.date_trunc("minute", "close") == F.col("close"))
    return schedule.withColumn(
        "reasons",
        reasons(
            (F.col("open") <= F.lag("open").over(w), "not_ordered"), (~aligned | (minutes < 30) | (minutes > 720), "invalid_interval"), (F.col("open") < F.lag("close").over(w), "overlapping"),
        ),
    )


def local_calendar(days: DataFrame, start: str, end: str, zone: str = "America/New_York") -> DataFrame:
    """(date, opens, closes, reasons): local hours as UTC instants, summer time included. ``days``: date,
    open and close as texts."""
    at = lambda c: F.to_utc_timestamp(F.concat_ws(" ", "date", c).cast("timestamp_ntz").cast("timestamp"), zone).cast("timestamp_ntz")
    out = days.withColumns({"opens": at("open"), "closes": at("close"), "_n": F.count("*").over(Window.partitionBy("date"))})
    seconds = F.timestamp_diff("SECOND", F.col("opens"), F.col("closes"))
    return out.withColumn("reasons", reasons((F.col("_n") > 1, "duplicate_session"), ((F.col("date") < start) | (F.col("date") > end), "outside_interval"), ((seconds <= 0) | (seconds % 60 != 0), "invalid_hours"))).drop("_n")


def causal_windows(decisions: DataFrame, bars: DataFrame, lookback: int, step: str = "HOUR") -> DataFrame:
    """Each decision (id, symbol, at) with how many of the ``lookback`` bars that were complete by then are
    there; only if all are, the decision is eligible."""
    last = F.date_trunc(step, "at").cast("timestamp_ntz")
    wanted = decisions.select("id", "symbol", "at", F.explode(F.transform(F.sequence(F.lit(1), F.lit(lookback)), lambda k: F.timestamp_add(step, -k, last))).alias("ts"))
    sound = bars.where(finite(F.col("open")) & finite(F.col("high")) & finite(F.col("low")) & finite(F.col("close")) & finite(F.col("volume"))).select("symbol", "ts", F.lit(1).alias("have"))
    found = wanted.join(sound, ["symbol", "ts"], "left").groupBy("id", "symbol", "at").agg(F.count("have").alias("present"))
    return found.withColumn("eligible", F.col("present") == lookback)


def calendar_mismatches(bars: DataFrame, calendar: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, symbol, missing, extra, valid): for both symbols of each pair, calendar sessions without a bar
    and bars without a session; a pair of equal symbols is invalid."""
    legs = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("symbol")).distinct()
    have = bars.join(calendar.select("ts", F.lit(1).alias("_held")), "ts", "left").groupBy("symbol").agg(F.count("_held").alias("held"), F.count("*").alias("n"))
    total = calendar.agg(F.count("*").alias("total"))
    out = legs.join(have, "symbol", "left").na.fill(0, ["held", "n"]).crossJoin(F.broadcast(total))  # one row
    out = out.withColumns({"missing": F.col("total") - F.col("held"), "extra": F.col("n") - F.col("held")})
    return out.withColumn("valid", (F.col("missing") == 0) & (F.col("extra") == 0) & (F.col("a") != F.col("b"))).select("a", "b", "symbol", "missing", "extra", "valid")


@dataclass(frozen=True)
class EnvelopePolicy:
    """Default limits of a quote envelope."""

    feed: str = "sip"
    future_skew_s: float = 1.0
    cache_age_s: float = 5.0
    source_age_s: float = 15.0
    max_spread_bps: str = "50"
    min_ask: float = 1.0


def judged_envelopes(rows: DataFrame, p: EnvelopePolicy = EnvelopePolicy()) -> DataFrame:
    """Quote envelopes with ages, exact spread and all reasons in the order in which they are found.

    ``rows``: symbol, expected_symbol, feed, received_at, decision_at, payload (struct of t timestamp and of
    bp, ap, bs, as as texts; null for none). The spread is a decimal, so a limit is met exactly.
    """
    raw = F.col("payload")
    number = lambda k: raw[k].try_cast("double")
    bid, ask = number("bp"), number("ap")
    seconds = lambda a, b: F.timestamp_diff("MICROSECOND", a, b) / 1_000_000
    stamped = F.col("received_at").isNotNull() & F.col("decision_at").isNotNull()
    cache, source, ahead = seconds(F.col("received_at"), F.col("decision_at")), seconds(raw["t"], F.col("decision_at")), seconds(F.col("received_at"), raw["t"])
    there, priced = raw.isNotNull(), finite(bid) & finite(ask)
    fine = priced & (bid > 0) & (ask > 0)
    exact = lambda k: raw[k].try_cast("decimal(18,6)")
    spread = F.when(there & fine & (bid <= ask), (exact("ap") - exact("bp")) * 20000 / (exact("ap") + exact("bp")))
    size = lambda k: [(there & ~finite(number(k)), f"invalid_{k}"), (there & finite(number(k)) & (number(k) <= 0), f"nonpositive_{k}")]
    rules = [
        (F.col("expected_symbol") != F.col("symbol"), "quote_symbol_mismatch"), (~F.col("feed").eqNullSafe(p.feed), "unexpected_feed"),
        (stamped & (cache < -p.future_skew_s), "receipt_after_decision"), (stamped & (cache > p.cache_age_s), "stale_cache"), (~stamped, "invalid_local_timestamp"), (~there, "missing_quote"),
        (there & raw["t"].isNull(), "invalid_event_timestamp"), (stamped & (source < -p.future_skew_s), "future_event"), (stamped & (source > p.source_age_s), "stale_source"), (stamped & (ahead > p.future_skew_s), "event_after_receipt"),
        (there & ~priced, "invalid_price"), (there & priced & ~fine, "nonpositive_price"), (there & fine & (bid > ask), "crossed_quote"), (spread > F.lit(p.max_spread_bps).cast("decimal(18,6)"), "excessive_spread"),
        (there & priced & (ask < p.min_ask), "ask_below_minimum"), *size("bs"), *size("as"),
    ]
    out = rows.withColumns({"cache_age_s": F.when(stamped, cache), "source_age_s": F.when(stamped, source), "spread_bps": spread, "reasons": reasons(*rules)})
    return out.withColumn("valid", F.size("reasons") == 0)


def net_edge(rows: DataFrame) -> DataFrame:
    """Research filter of forecasts: gross less uncertainty, cost and inventory penalty must be positive.
    ``rows``: gross, uncertainty, cost, inventory, forecast_at, decision_at, verified."""
    values = [F.col(c) for c in ("gross", "uncertainty", "cost", "inventory")]
    known = finite(values[0]) & finite(values[1]) & finite(values[2]) & finite(values[3])
    edge = values[0] - values[1] - values[2] - values[3]
    late = F.col("forecast_at").isNull() | F.col("decision_at").isNull() | (F.col("forecast_at") > F.col("decision_at"))
    reason = (
        F.when(~F.coalesce("verified", F.lit(False)), "forecast_calibration_unverified").when(~known, "missing_or_invalid_estimate").when(F.least(*values[1:]) < 0, "negative_estimate")
        .when(late, "invalid_forecast_timestamp").when(edge > 0, "positive_conservative_edge").otherwise("insufficient_net_edge")
    )
    out = rows.withColumn("reason", reason)
    judged = F.col("reason").isin("positive_conservative_edge", "insufficient_net_edge")
    return out.withColumns({"net_edge_bps": F.when(judged, edge), "eligible": F.col("reason") == "positive_conservative_edge"})


def option_screen(snapshots: DataFrame, contracts: DataFrame, now: Column, complete: bool = True, feed: str = "opra") -> DataFrame:
    """Quality of an option chain: every snapshot with what is missing and what is wrong. ``snapshots``: symbol,
    t, bp, ap, bs, as, iv, delta, gamma, theta, vega, rho; ``contracts``: symbol, expiry, strike, size, type, style."""
    side = contracts.select("symbol", *(F.col(c).alias(f"contract_{c}") for c in ("expiry", "strike", "size", "type", "style")), F.lit(True).alias("_c"))
    out = snapshots.join(side, "symbol", "left")
    x = {c: F.col(c) for c in ("bp", "ap", "bs", "as", "iv", "delta", "gamma", "theta", "vega", "rho")}
    age = F.timestamp_diff("MICROSECOND", F.col("t"), now) / 1_000_000
    quoted = finite(x["bp"]) & finite(x["ap"])
    proper = quoted & (x["bp"] > 0) & (x["bp"] <= x["ap"])
    spread = F.when(proper, (x["ap"] - x["bp"]) / ((x["ap"] + x["bp"]) / 2) * 100)
    sized = finite(x["bs"]) & finite(x["as"])
    has = F.coalesce("_c", F.lit(False))
    missing = [(F.col("t").isNull(), "quote_timestamp"), (~quoted, "bid_ask"), (~sized, "displayed_sizes")]
    wrong = [(~((age >= 0) & (age <= 60)), "stale_or_future_quote"), (quoted & ~proper, "nonpositive_or_crossed_quote"), (spread > 10, "wide_spread"), (sized & (F.least(x["bs"], x["as"]) < 1), "insufficient_displayed_size")]
    for g in ("delta", "gamma", "theta", "vega", "rho"):
        missing.append((~finite(x[g]), f"greek_{g}"))
        if g in ("delta", "gamma", "vega"):
            wrong.append((finite(x[g]) & (~x[g].between(-1, 1) if g == "delta" else x[g] < 0), f"invalid_greek_{g}"))
    missing.append((~finite(x["iv"]), "implied_volatility"))
    wrong.append((finite(x["iv"]) & (x["iv"] <= 0), "invalid_implied_volatility"))
    for c, name in (("expiry", "expiration_date"), ("strike", "strike_price"), ("size", "size"), ("type", "type"), ("style", "style")):
        missing.append((F.coalesce(F.col(f"contract_{c}").cast("string"), F.lit("")) == "", f"contract_{name}"))
    strike, size, expiry = F.col("contract_strike").cast("double"), F.col("contract_size").cast("double"), F.col("contract_expiry").try_cast("date")
    wrong += [
        (has & (expiry < F.to_date(now)), "expired_contract"), (has & expiry.isNull(), "invalid_contract_expiration"), (has & ~F.coalesce(strike > 0, F.lit(False)), "invalid_contract_strike"),
        (has & ~F.coalesce((size > 0) & (size == F.floor(size)), F.lit(False)), "invalid_contract_size"), (has & ~F.coalesce(F.col("contract_type").isin("call", "put"), F.lit(False)), "invalid_contract_type"),
        (has & ~F.coalesce(F.col("contract_style").isin("american", "european"), F.lit(False)), "invalid_contract_style"), (F.lit(feed != "opra"), "opra_provenance_required"), (F.lit(not complete), "incomplete_chain"),
    ]
    out = out.withColumns({"quote_age_s": age, "spread_pct": spread, "missing": reasons(*missing), "reasons": reasons(*wrong)})
    return out.withColumn("passes", (F.size("missing") == 0) & (F.size("reasons") == 0)).drop("_c")


def instrument_faults(rows: DataFrame) -> DataFrame:
    """What an instrument's kind requires and the row does not have: kind, expiry, contract_size, strike, right."""
    kind = F.col("kind")
    dated = kind.isin("future", "option")
    return rows.withColumn(
        "reasons",
        reasons(
            (dated & (F.coalesce("expiry", F.lit("")) == ""), "expiry_required"), (dated & F.col("expiry").isNotNull() & (F.col("expiry") != "") & F.col("expiry").try_cast("timestamp").isNull(), "invalid_expiry"),
            ((dated | (kind == "perpetual")) & F.col("contract_size").isNull(), "contract_size_required"), ((kind == "option") & (F.col("strike").isNull() | F.col("right").isNull()), "strike_and_right_required"),
        ),
    )


def evidence_as_of(rows: DataFrame, as_of: Column, limits: dict[str, float], default_s: float) -> DataFrame:
    """Evidence rejected as future or stale: any of its times after ``as_of``, or older than its kind's limit."""
    times = [F.col(c) for c in ("observed_at", "published_at", "available_at")]
    limit = F.lit(float(default_s))
    for kind, seconds in limits.items():
        limit = F.when(F.col("kind") == kind, F.lit(float(seconds))).otherwise(limit)
    oldest = F.least(*times, "vintage_at")
    twice = F.count("*").over(Window.partitionBy("source_id")) > 1
    return rows.withColumn("reasons", reasons((twice, "duplicate_source"), (F.greatest(*times) > as_of, "future_evidence"), (F.timestamp_diff("MICROSECOND", oldest, as_of) / 1_000_000 > limit, "stale_evidence")))


def session_folds(sessions: DataFrame, train: int = 252, validation: int = 63, test: int = 63, step: int = 63, separation: int = 5) -> DataFrame:
    """(fold_id, part, first_ts, last_ts): folds over ordered sessions with an embargo between the parts and
    tests that do not overlap; an incomplete last fold is left out. ``sessions``: ts, one row a session."""
    if min(train, validation, test, step) <= 0 or separation < 5 or step < test:
        raise ValueError("windows must be positive, the separation 5 sessions or more, and tests apart")
    numbered = sessions.select("ts").distinct().withColumn("n", F.row_number().over(Window.orderBy("ts")) - 1)
    parts = (("train", 0, train), ("validation", train + separation, train + separation + validation), ("test", train + validation + 2 * separation, train + validation + test + 2 * separation))
    width = parts[-1][2]
    count = numbered.agg(F.count("*").alias("count"))
    starts = count.select(F.explode(F.when(F.col("count") >= width, F.sequence(F.lit(0).cast("long"), F.col("count") - width, F.lit(step).cast("long")))).alias("start"))
    spans = starts.select((F.col("start") / step + 1).cast("long").alias("fold_id"), F.inline(F.array(*(F.struct(F.lit(p).alias("part"), (F.col("start") + a).alias("a"), (F.col("start") + b - 1).alias("b")) for p, a, b in parts))))
    first = numbered.select(F.col("ts").alias("first_ts"), F.col("n").alias("a"))
    last = numbered.select(F.col("ts").alias("last_ts"), F.col("n").alias("b"))
    return spans.join(first, "a").join(last, "b").select("fold_id", "part", "first_ts", "last_ts")


def purged(labels: DataFrame, folds: DataFrame) -> DataFrame:
    """The labels (signal_ts, label_end_ts) of each fold's part that end before the fold's next part begins."""
    nxt = folds.withColumn("boundary", F.lead("first_ts").over(Window.partitionBy("fold_id").orderBy("first_ts"))).where("boundary is not null")
    f = F.broadcast(nxt)  # three rows a fold; folds are a bounded calendar dimension
    inside = F.col("signal_ts").between(F.col("first_ts"), F.col("last_ts")) & (F.col("label_end_ts") < F.col("boundary"))
    return labels.join(f, inside).select("fold_id", "part", *labels.columns)


def parameter_grid(spark, space: dict[str, list], most: int) -> DataFrame:
    """A row for each combination of the parameters' values, in order; more than ``most`` is an error."""
    size = 1
    for values in space.values():
        size *= max(len(values), 1)
    if size > most:
        raise ValueError(f"the search space has {size} combinations, more than {most}")
    out = spark.range(1).select(F.lit(0).alias("_"))
    for name, values in space.items():
        out = out.select("*", F.explode(F.array(*map(F.lit, values))).alias(name))
    return out.drop("_")


def slipped(price: Column, side: Column, entry: Column, bps: Column) -> Column:
    """A price after slippage: against the trade on both ends; a flat side pays none."""
    slip = bps / 10_000
    up = (side == "long") == entry
    return F.when(side.isin("long", "short"), price * F.when(up, 1 + slip).otherwise(1 - slip)).otherwise(price)


def trade_stats(trades: DataFrame, *keys: str) -> DataFrame:
    """Win rate by profit, mean returns of winners and losers, expectancy and holding of each group."""
    r, pnl = F.col("return_pct"), F.col("pnl")
    return trades.groupBy(*keys).agg(
        F.count("*").alias("trade_count"), F.avg((pnl > 0).cast("double")).alias("win_rate"), F.avg(r).alias("expectancy"), F.avg(F.when(pnl > 0, r)).alias("average_win"), F.avg(F.when(pnl < 0, r)).alias("average_loss"),
        F.avg("hold_bars").alias("average_hold_bars"), F.sum(F.abs("entry_notional") + F.abs(F.col("entry_notional") + pnl)).alias("traded_notional"),
    )


def correlation_rejections(orders: DataFrame, held: DataFrame, returns: DataFrame, lookback: int, limit: float) -> DataFrame:
    """Orders (id, symbol, side, ts) whose returns move with a held position (symbol, side) by more than
    ``limit`` over the last ``lookback`` returns of both; (id, held_symbol, n, correlation, reason), reason null
    where the position is no obstacle. ``returns``: symbol, ts, n (number of the return in its symbol), r. ``held`` has the
    open positions of one account, a few rows; the rows joined are orders times positions times ``lookback``.
    """
    at = orders.crossJoin(F.broadcast(held.select(F.col("symbol").alias("held_symbol"), F.col("side").alias("held_side"))))
    last = returns.select("symbol", "ts", "n")
    at = at.join(last.withColumnRenamed("n", "last_a"), ["symbol", "ts"], "left")
    at = at.join(last.select(F.col("symbol").alias("held_symbol"), "ts", F.col("n").alias("last_b")), ["held_symbol", "ts"], "left")
    # the numbers of the returns that are looked at, so that both joins are by equality
    rows = at.select("id", "symbol", "held_symbol", "last_b", F.explode(F.sequence(F.col("last_a") - lookback + 1, F.col("last_a"))).alias("n"))
    rows = rows.join(returns.select("symbol", "n", F.col("ts").alias("day"), F.col("r").alias("a")), ["symbol", "n"])
    rows = rows.join(returns.select(F.col("symbol").alias("held_symbol"), F.col("ts").alias("day"), F.col("n").alias("n_b"), F.col("r").alias("b")), ["held_symbol", "day"])
    rows = rows.where((F.col("n_b") <= F.col("last_b")) & (F.col("n_b") > F.col("last_b") - lookback))
    spread = F.stddev_samp("a") * F.stddev_samp("b")
    got = rows.groupBy("id", "held_symbol").agg(F.count("*").alias("n"), (F.covar_samp("a", "b") / nullif(spread)).alias("correlation"))
    out = at.select("id", "symbol", "side", "held_symbol", "held_side").join(got, ["id", "held_symbol"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    sign = F.when(F.col("side") == F.col("held_side"), 1.0).otherwise(-1.0)
    reason = F.when(F.col("n") < lookback, "insufficient_history").when(F.col("correlation").isNull(), "undefined_correlation").when(F.col("correlation") * sign > limit + 1e-12, "exposure_correlation")
    return out.withColumn("reason", reason)

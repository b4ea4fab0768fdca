"""Market scans as observations that are kept: judged one by one, with a memory of each symbol's last good value.

``judged`` is stateless. What depends on earlier scans (the value that is retained, counters, eviction of symbols that
nobody scans any more) is a window on a batch (``history``) and keyed state with timers on a stream (``observe``); a
stream stopped and started again from its checkpoint, or from a table of last values, gives what the batch gives.
"""

from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Seconds up to which a value is fresh, and days up to which an old one is compared or shown.
FRESH_S, CRYPTO_S, FUTURES_S, OLD_DAYS = 300, 180, 1800, 7
#: Fixed value: the reason that a futures proxy carries.
PROXY = "continuous_proxy_with_unknown_delay_not_an_executable_contract"
VALUE = ("price", "data_asof", "change_pct", "volume", "spread_bps")
VALUE_TYPES = "price double, data_asof timestamp, change_pct double, volume double, spread_bps double"
OUTPUT = f"symbol string, scan_at timestamp, state string, reason string, {VALUE_TYPES}, retained boolean, first_seen timestamp, last_seen timestamp, observation_count long, scan_count long"
#: Seconds without a scan after which a symbol is forgotten.
TTL_S = 7 * 86_400


def _seconds(later: Column, earlier: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", earlier, later) / 1_000_000


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def judged(scans: DataFrame) -> DataFrame:
    """(symbol, scan_at, state, reason, good, and a value's columns): what each scan says by itself.

    ``scans``: symbol, asset_class (us_equity, crypto, futures), scan_at, market_open, failure, answered, trade_price, trade_at,
    day_close, day_volume, day_at, prior_close, prior_at, bid, ask, quote_at. A failed call is ``unavailable``, no answer
    ``missing``; an answer without a positive finite price and a time not in the future is ``invalid``, as is
    one with a negative volume, a crossed, unpriced or future quote. Of the trade and the day's bar the trade counts.
    Old volumes and closes are not shown, old quotes have no spread.
    """
    now, kind = F.col("scan_at"), F.col("asset_class")
    traded = F.col("trade_price").isNotNull() | F.col("trade_at").isNotNull()
    price, asof = F.when(traded, F.col("trade_price")).otherwise(F.col("day_close")), F.when(traded, F.col("trade_at")).otherwise(F.col("day_at"))
    age = _seconds(now, asof)
    quoted = F.col("bid").isNotNull() | F.col("ask").isNotNull() | F.col("quote_at").isNotNull()
    limit = F.when(kind == "crypto", CRYPTO_S).otherwise(FRESH_S)
    quote_age = _seconds(now, F.col("quote_at"))
    sound = lambda c: F.coalesce(c, F.lit(False))
    quote_fine = sound(_finite(F.col("bid")) & _finite(F.col("ask")) & (F.col("bid") > 0) & (F.col("ask") >= F.col("bid")) & (quote_age >= 0))
    volume_fine = F.col("day_volume").isNull() | sound(_finite(F.col("day_volume")) & (F.col("day_volume") >= 0))
    fine = sound(_finite(price) & (price > 0) & (age >= 0)) & volume_fine & (~quoted | quote_fine)
    days = F.lit(OLD_DAYS * 86_400)
    volume = F.when(_seconds(now, F.col("day_at")).between(0, days), F.col("day_volume"))
    prior = F.when(sound(_finite(F.col("prior_close")) & (F.col("prior_close") > 0) & (_seconds(asof, F.col("prior_at")) > 0) & (_seconds(asof, F.col("prior_at")) <= days)), F.col("prior_close"))
    spread = F.when(quoted & (quote_age <= limit), (F.col("ask") - F.col("bid")) / ((F.col("ask") + F.col("bid")) / 2) * 10_000)
    equity = kind == "us_equity"
    found = (
        F.when(kind == "futures", F.when(age <= FUTURES_S, "indicative_unknown_latency").otherwise("stale"))
        .when(equity & (F.col("market_open") == F.lit(False)), F.when(age <= days, "closed_last_observation").otherwise("stale"))
        .when(equity & F.col("market_open").isNull(), "unavailable").when(age <= limit, "fresh").otherwise("stale")
    )
    out = scans.withColumns({"_failed": F.col("failure").isNotNull(), "_no": ~sound(F.col("answered")), "_fine": fine})
    good = ~F.col("_failed") & ~F.col("_no") & F.col("_fine")
    state = F.when(F.col("_failed"), "unavailable").when(F.col("_no"), "missing").when(~F.col("_fine"), "invalid").otherwise(found)
    reason = F.when(F.col("_failed"), F.col("failure")).when(F.col("_no"), "symbol_missing_from_response").when(~F.col("_fine"), "invalid_price_timestamp_bar_or_quote")
    reason = reason.when(found == "unavailable", "market_clock_unavailable").when(found == "indicative_unknown_latency", PROXY)
    value = {"price": price, "data_asof": asof, "change_pct": (price / prior - 1) * 100, "volume": volume, "spread_bps": spread}
    return out.select("symbol", "scan_at", state.alias("state"), reason.alias("reason"), good.alias("good"), *(F.when(good, v).alias(c) for c, v in value.items()))


def history(scans: DataFrame, ttl_s: int = TTL_S, restored: DataFrame | None = None) -> DataFrame:
    """The columns of OUTPUT for each judged scan, on a batch.

    A scan that is not good keeps the last good value and says so (``retained``). A value counts as a new observation if
    its time, price or volume differ from the last one's; being looked at again does not. After ``ttl_s`` seconds without
    a scan a symbol is forgotten and begins anew. ``restored``: last rows of an earlier run, whose values and counters go
    on; they are never a scan themselves. One window by symbol, in order of scans.
    """
    value = F.struct(*VALUE)
    base = {"_first": "timestamp", "_last": "timestamp", "_n": "long", "_scans": "long"}
    rows = scans.select("symbol", "scan_at", F.lit(1).alias("_kind"), "state", "reason", "good", value.alias("_v"), *(F.lit(None).cast(t).alias(c) for c, t in base.items()))
    if restored is not None:
        old = restored.select("symbol", "scan_at", F.lit(0).alias("_kind"), "state", "reason", F.col("data_asof").isNotNull().alias("good"), value.alias("_v"), F.col("first_seen").alias("_first"), F.col("last_seen").alias("_last"), F.col("observation_count").alias("_n"), F.col("scan_count").alias("_scans"))
        rows = rows.unionByName(old)
    along = Window.partitionBy("symbol").orderBy("scan_at", "_kind")
    gap = F.coalesce(_seconds(F.col("scan_at"), F.lag("scan_at").over(along)) > ttl_s, F.lit(False))
    rows = rows.withColumn("_run", F.sum(gap.cast("int")).over(along))
    own = Window.partitionBy("symbol", "_run").orderBy("scan_at", "_kind")
    so_far, before = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(Window.unboundedPreceding, -1)
    kept = F.when(F.col("good"), F.col("_v"))
    last = F.last(kept, True).over(before)
    same = last.isNotNull() & last["data_asof"].eqNullSafe(F.col("_v.data_asof")) & last["price"].eqNullSafe(F.col("_v.price")) & last["volume"].eqNullSafe(F.col("_v.volume"))
    new = (F.col("good") & (F.col("_kind") == 1) & ~same).cast("int")
    rows = rows.withColumns({"_new": new, "_kept": F.last(kept, True).over(so_far)})
    once = lambda c: F.coalesce(F.first(c).over(so_far), F.lit(0))
    scan = (F.col("_kind") == 1).cast("int")
    out = rows.withColumns({
        "observation_count": once("_n") + F.sum("_new").over(so_far), "scan_count": once("_scans") + F.sum(scan).over(so_far), "first_seen": F.coalesce(F.first("_first").over(so_far), F.first("scan_at").over(so_far)),
        "last_seen": F.last(F.when(F.col("_kind") == 0, F.col("_last")).when(F.col("good"), F.col("scan_at")), True).over(so_far), "retained": ~F.col("good") & F.col("_kept").isNotNull(),
    }).where("_kind = 1")
    return out.select("symbol", "scan_at", "state", "reason", *(F.col(f"_kept.{c}").alias(c) for c in VALUE), "retained", "first_seen", "last_seen", F.col("observation_count").cast("long").alias("observation_count"), F.col("scan_count").cast("long").alias("scan_count"))


class Observer(StatefulProcessor):
    """The state of a symbol: its last good value, when it was first, last and latest scanned, and the two counters.
    A timer in event time clears it ``ttl_s`` after the latest scan."""

    KEPT = (*VALUE, "first_seen", "last_seen", "scan_at", "observation_count", "scan_count")

    def __init__(self, ttl_s: int = TTL_S) -> None:
        self.ttl = dt.timedelta(seconds=ttl_s)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", f"{VALUE_TYPES}, first_seen timestamp, last_seen timestamp, scan_at timestamp, observation_count long, scan_count long")

    def _timer(self, at: dt.datetime) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(int((at + self.ttl).timestamp() * 1000))

    def handleInputRows(self, key, rows, timerValues):
        now = dict(zip(self.KEPT, self.state.get(), strict=True)) if self.state.exists() else None
        out = []
        for r in pd.concat(list(rows)).sort_values("scan_at", kind="stable").to_dict("records"):
            at = r["scan_at"].to_pydatetime()
            if now is not None and at - now["scan_at"] > self.ttl:
                now = None
            if now is None:
                now = dict.fromkeys(self.KEPT) | {"first_seen": at, "observation_count": 0, "scan_count": 0}
            now["scan_count"] += 1
            now["scan_at"] = at
            if r["good"]:
                value = {c: None if pd.isna(r[c]) else r[c].to_pydatetime() if c == "data_asof" else r[c] for c in VALUE}
                if any(value[c] != now[c] for c in ("data_asof", "price", "volume")):
                    now["observation_count"] += 1
                now.update(value, last_seen=at)
            out.append({"symbol": key[0], "state": r["state"], "reason": r["reason"], "retained": not r["good"] and now["data_asof"] is not None, **now})
        self.state.update(tuple(now[c] for c in self.KEPT))
        self._timer(now["scan_at"])
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.state.clear()
        yield self._frame([])

    def handleInitialState(self, key, initialState, timerValues):
        r = initialState.iloc[0]
        one = lambda c: None if pd.isna(r[c]) else r[c].to_pydatetime() if isinstance(r[c], pd.Timestamp) else r[c].item() if hasattr(r[c], "item") else r[c]
        self.state.update(tuple(one(c) for c in self.KEPT))
        self._timer(one("scan_at"))

    @staticmethod
    def _frame(rows: list[dict]) -> pd.DataFrame:
        names = [c.split()[0] for c in OUTPUT.split(", ")]
        made = pd.DataFrame(rows, columns=names)
        for c in names:
            if f"{c} timestamp" in OUTPUT:
                made[c] = pd.to_datetime(made[c])
            elif f"{c} double" in OUTPUT:
                made[c] = made[c].astype(float)
        return made.astype({"retained": bool, "observation_count": "int64", "scan_count": "int64"})

    def close(self) -> None:
        pass


def observe(scans: DataFrame, ttl_s: int = TTL_S, late: str = "0 seconds", restored: DataFrame | None = None) -> DataFrame:
    """``history`` on a stream of judged scans, with append output. Needs the RocksDB state store. Scans of a symbol must come
    in order, batch by batch; a batch may hold several. The state has one row for each symbol scanned within
    ``ttl_s``: timers forget the others once the watermark (``late``) has passed. ``restored`` starts a new stream from
    the last rows of an old one; a stream that goes on from its checkpoint needs none."""
    stream = scans.withWatermark("scan_at", late).groupBy("symbol")
    first = None if restored is None else restored.select("symbol", *Observer.KEPT).groupBy("symbol")
    return stream.transformWithStateInPandas(Observer(ttl_s), OUTPUT, "append", "eventTime", initialState=first)

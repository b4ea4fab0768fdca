"""Account simulations: one account is one group, folded bar by bar; many accounts run in parallel."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class BacktestConfig:
    """The default costs, holding time, limits and stops of an account."""

    capital: float = 100_000.0
    position: float = 0.10
    gross: float = 1.0
    positions: int = 10
    hold: int = 5
    commission_bps: float = 2.0
    slippage_bps: float = 2.0
    stop_atr: float = 2.0
    daily_loss: float = 0.03


def target_notional(equity: Column, price: Column, atr: Column, position: float = 0.10, volatility_target: float | None = None) -> Column:
    """Money for a new position; scaled down where the range is wide against the target."""
    out = equity * position
    if volatility_target:
        move = F.greatest(atr / price, F.lit(1e-4))
        out = F.when(atr > 0, out * F.greatest(F.least(F.lit(1.0), volatility_target / move), F.lit(0.1))).otherwise(out)
    return F.when((equity > 0) & (price > 0), out).otherwise(0.0)


def stop_price(entry: Column, atr: Column, long: Column, multiple: float = 2.0) -> Column:
    """The stop at a multiple of the range, with two per cent of the price where there is none."""
    distance = F.when(atr > 0, atr).otherwise(entry * 0.02) * multiple
    return F.when(long, entry - distance).otherwise(entry + distance)


TRADES = "account string, symbol string, side string, entry_ts timestamp_ntz, exit_ts timestamp_ntz, entry_price double, exit_price double, quantity double, pnl double, return_pct double, hold_bars int, exit_reason string, cash_after double"


def simulate(signals: DataFrame, account: str, c: BacktestConfig = BacktestConfig()) -> DataFrame:
    """The trades of each account. ``signals``: account, symbol, ts, open, high, low, close, atr, state,
    signal (long, short, flat), score, of all symbols of an account.

    Order within a bar: gap stops at the open, due exits, due entries by score, stops within the bar, marks
    at the close, then orders for the next bar. A state change leaves before the time limit, and that before
    a flip of the signal. A loss of ``daily_loss`` from the day's first equity stops entries that day.
    Positions that are left close at the last close. One account is sequential by nature; what one group
    holds is an account's bars, which the number of sessions and symbols bounds.
    """
    slip, fee = c.slippage_bps / 1e4, c.commission_bps / 1e4

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "symbol"])
        name = pdf["account"].iloc[0]
        cash, held, out = c.capital, {}, []
        exits: dict[str, str] = {}
        entries: dict[str, tuple] = {}
        last: dict[str, tuple] = {}
        day, day_equity, halted = None, c.capital, False

        def close(symbol, ts, price, reason):
            nonlocal cash
            p = held.pop(symbol)
            sign = 1 if p["side"] == "long" else -1
            fill = price * (1 - sign * slip)
            costs = p["quantity"] * (p["price"] + fill) * fee
            gain = sign * p["quantity"] * (fill - p["price"]) - costs
            cash += sign * p["quantity"] * fill - p["quantity"] * fill * fee
            out.append((name, symbol, p["side"], p["ts"], ts, p["price"], fill, p["quantity"], gain, gain / (p["quantity"] * p["price"]), p["bars"], reason, cash))

        def equity(marks):
            return cash + sum((1 if p["side"] == "long" else -1) * p["quantity"] * marks.get(s, p["price"]) for s, p in held.items())

        for ts, rows in pdf.groupby("ts", sort=True):
            bars = {r.symbol: r for r in rows.itertuples(index=False)}
            opens = {s: last.get(s, (ts, r.open))[1] for s, r in bars.items()} | {s: r.open for s, r in bars.items()}
            marks = {s: v[1] for s, v in last.items()} | opens
            if ts.date() != day:
                day, day_equity, halted = ts.date(), equity(marks), False
            for s in [s for s in held if s in bars]:
                p, r = held[s], bars[s]
                if (p["side"] == "long" and r.open <= p["stop"]) or (p["side"] == "short" and r.open >= p["stop"]):
                    close(s, ts, r.open, "gap_stop")
                    exits.pop(s, None)
            for s in [s for s in exits if s in bars and s in held]:
                close(s, ts, bars[s].open, exits.pop(s))
            for s, (score, side, atr, state) in sorted(entries.items(), key=lambda e: (-e[1][0], e[0])):
                if s not in bars or s in held or halted or len(held) >= c.positions:
                    continue
                now = equity(marks)
                money = now * c.position
                exposure = sum(p["quantity"] * marks.get(k, p["price"]) for k, p in held.items())
                if now <= 0 or (exposure + money) / now > c.gross + 1e-12:
                    continue
                sign = 1 if side == "long" else -1
                fill = bars[s].open * (1 + sign * slip)
                q = money / fill
                cash -= sign * q * fill + q * fill * fee
                reach = (atr if atr and atr > 0 else fill * 0.02) * c.stop_atr
                held[s] = {"side": side, "ts": ts, "price": fill, "quantity": q, "bars": 0, "stop": fill - sign * reach, "state": state}
            entries = {s: e for s, e in entries.items() if s not in bars}
            for s in [s for s in held if s in bars]:
                p, r = held[s], bars[s]
                if (p["side"] == "long" and r.low <= p["stop"]) or (p["side"] == "short" and r.high >= p["stop"]):
                    close(s, ts, p["stop"], "stop")
            for s, r in bars.items():
                last[s] = (ts, r.close)
                if s in held:
                    held[s]["bars"] += 1
            if equity({s: v[1] for s, v in last.items()}) / day_equity - 1 <= -c.daily_loss:
                halted = True
                entries.clear()
            for s, r in bars.items():
                p = held.get(s)
                if p:
                    flipped = r.signal != p["side"]
                    reason = "state_change" if r.state != p["state"] else "time_exit" if p["bars"] >= c.hold else "signal_flip" if flipped else None
                    if reason:
                        exits[s] = reason
                        if flipped and r.signal != "flat" and not halted:
                            entries[s] = (r.score, r.signal, r.atr, r.state)
                elif r.signal != "flat" and not halted:
                    entries[s] = (r.score, r.signal, r.atr, r.state)
        for s in sorted(held):
            close(s, *last[s], "end_of_test")
        return pd.DataFrame(out, columns=[f.split()[0] for f in TRADES.split(", ")])

    needed = ["account", "symbol", "ts", "open", "high", "low", "close", "atr", "state", "signal", "score"]
    return signals.withColumn("account", F.col(account).cast("string")).select(*needed).groupBy("account").applyInPandas(run, TRADES)

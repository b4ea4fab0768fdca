"""Common table expressions of the SQL twins. Each names the ones it builds on."""

from __future__ import annotations

HORIZONS = (1, 3, 5, 10, 20, 60)


def full(fn: str, x: str, n: int, keys: str = "symbol") -> str:
    w = f"OVER (PARTITION BY {keys} ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {w} = {n} THEN {fn}({x}) {w} END"


def z(x: str, n: int) -> str:
    return f"(({x}) - ({full('avg', x, n)})) / nullif({full('stddev_samp', x, n)}, 0)"


def lag(x: str, n: int = 1, keys: str = "symbol") -> str:
    return f"lag({x}, {n}) OVER (PARTITION BY {keys} ORDER BY ts)"


_TR = f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')}))"

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "bars": ((), """SELECT o_orderpriority AS symbol, o_orderdate AS ts, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
        arg_max(o_totalprice, o_orderkey) AS close, sum(o_totalprice) AS volume, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'crypto' ELSE 'equity' END AS asset_class
        FROM orders GROUP BY o_orderpriority, o_orderdate"""),
    "hours": ((), """SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, row(ts, event_id)) AS close,
        count(*)::DOUBLE AS volume, date_trunc('hour', ts)::DATE AS session FROM events WHERE value > 0 GROUP BY ALL"""),
    "quotes": ((), """SELECT event_id, event_type AS symbol, ts, value AS bid, value * (1 + k / 10000) AS ask, k + 1 AS bid_size, (user_id % 7)::DOUBLE AS ask_size
        FROM (SELECT *, json_extract_string(props, '$.k')::DOUBLE AS k FROM events)"""),
    "trades": ((), """SELECT l_returnflag AS symbol, CASE WHEN l_returnflag = 'R' THEN 'crypto' ELSE 'equity' END AS asset_class, l_linestatus || '|' || l_linenumber AS entry_state, l_linestatus AS entry_state_family,
        ['state_change', 'time_exit', 'signal_flip'][l_linenumber % 3 + 1] AS exit_reason, l_discount - l_tax AS return_pct, (l_discount - l_tax) * l_extendedprice AS pnl, -l_tax AS mae_pct, l_discount AS mfe_pct,
        l_tax AS uncaptured_pct, trunc(l_quantity)::INT % 15 AS hold_bars, l_discount - 0.04 AS expected_value, l_extendedprice AS entry_notional, l_shipdate AS exit_ts, year(l_shipdate) AS fold_id,
        row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS trade_order FROM lineitem"""),
    "f1": (("bars",), f"""SELECT *, ln(close) - ln({lag('close')}) AS log_return_1, {_TR} AS tr, close - {lag('close')} AS delta, close * volume AS dollar FROM bars"""),
    "f2": (("f1",), f"""SELECT *, {", ".join(f"close / {lag('close', h)} - 1 AS return_{h}" for h in HORIZONS)}, {full('avg', 'tr', 14)} AS atr_14,
        {full('stddev_samp', 'log_return_1', 20)} * sqrt(CASE WHEN asset_class = 'crypto' THEN 365 ELSE 252 END) AS realized_vol_20, {", ".join(f"{full('avg', 'close', w)} AS ma_{w}" for w in (10, 20, 50, 200))},
        {z('close', 20)} AS zscore_close_20, (close - {full('min', 'low', 20)}) / nullif({full('max', 'high', 20)} - {full('min', 'low', 20)}, 0) AS price_position_20,
        abs(close - {lag('close', 20)}) / nullif({full('sum', 'abs(delta)', 20)}, 0) AS range_efficiency_20, {full('avg', 'volume', 20)} AS volume_mean_20, {z('volume', 20)} AS volume_zscore_20,
        {full('avg', 'dollar', 20)} AS dollar_volume_20 FROM f1"""),
    "f3": (("f2",), f"""SELECT *, {", ".join(f"return_{h} / {h} AS return_rate_{h}, {z(f'return_{h}', 20)} AS return_zscore_{h}_20" for h in HORIZONS)}, atr_14 / close AS atr_pct_14,
        {z('realized_vol_20', 20)} AS vol_zscore_20, realized_vol_20 / ({full('avg', 'realized_vol_20', 20)}) AS vol_regime_20, realized_vol_20 - {lag('realized_vol_20')} AS vol_delta_20,
        {", ".join(f"close / ma_{w} - 1 AS ma_gap_{w}" for w in (10, 20, 50, 200))}, volume / nullif(volume_mean_20, 0) AS volume_ratio_20, ma_10 / ma_200 - 1 AS trend_spread,
        delta / nullif(atr_14, 0) AS atr_normalized_move_1, {", ".join(f"(close - ma_{w}) / nullif(atr_14, 0) AS atr_normalized_close_to_sma{w}" for w in (20, 50, 200))} FROM f2"""),
    "f4": (("f3",), """SELECT *, vol_regime_20 - 1 AS vol_expansion_20, CASE WHEN volume_ratio_20 >= 1.25 THEN 'expansion' WHEN volume_ratio_20 <= 0.8 THEN 'contraction' ELSE 'normal' END AS volume_regime_20,
        return_rate_3 - return_rate_10 AS return_accel_3_10, return_rate_5 - return_rate_20 AS return_accel_5_20, return_rate_20 - return_rate_60 AS return_accel_20_60,
        CASE WHEN trend_spread > 0 THEN 'up' WHEN trend_spread < 0 THEN 'down' ELSE 'neutral' END AS trend_direction_feature FROM f3"""),
    "features": (("f4",), """SELECT *, row_number() OVER (PARTITION BY symbol, run ORDER BY ts) AS trend_persistence FROM (SELECT *, sum(c) OVER (PARTITION BY symbol ORDER BY ts) AS run FROM
        (SELECT *, CASE WHEN trend_direction_feature = lag(trend_direction_feature) OVER (PARTITION BY symbol ORDER BY ts) THEN 0 ELSE 1 END AS c FROM f4))"""),
    "ewm": (("f1",), """SELECT *, CASE WHEN n >= 14 THEN list_reduce(gs, lambda a, x: a * (1 - 1 / 14.0::DOUBLE) + x * (1 / 14.0::DOUBLE)) END AS g, CASE WHEN n >= 14 THEN list_reduce(ls, lambda a, x: a * (1 - 1 / 14.0::DOUBLE) + x * (1 / 14.0::DOUBLE)) END AS l
        FROM (SELECT *, list(greatest(delta, 0)) FILTER (delta IS NOT NULL) OVER w AS gs, list(greatest(-delta, 0)) FILTER (delta IS NOT NULL) OVER w AS ls, count(delta) OVER (PARTITION BY symbol ORDER BY ts) AS n
        FROM f1 WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 528 PRECEDING AND CURRENT ROW))"""),
    "rsi": (("ewm",), """SELECT *, CASE WHEN rsi_14 >= 70 THEN 'overbought' WHEN rsi_14 <= 30 THEN 'oversold' ELSE 'neutral' END AS rsi_zone FROM
        (SELECT *, CASE WHEN l = 0 AND g > 0 THEN 100 WHEN l = 0 AND g = 0 THEN 50 ELSE 100 - 100 / (1 + g / nullif(l, 0)) END AS rsi_14 FROM ewm)"""),
    "states": (("features",), """SELECT *, concat_ws('|', state_trend, state_volatility, state_momentum, state_extension) AS state, concat_ws('|', state_trend, state_volatility) AS state_family FROM (SELECT *,
        CASE WHEN ma_10 / ma_200 - 1 > 0.01 THEN 'up' WHEN ma_10 / ma_200 - 1 < -0.01 THEN 'down' ELSE 'neutral' END AS state_trend,
        CASE WHEN vol_zscore_20 > 0.5 THEN 'high' WHEN vol_zscore_20 < -0.5 THEN 'low' ELSE 'normal' END AS state_volatility,
        CASE WHEN return_5 > 0.02 THEN 'strong' WHEN return_5 < -0.02 THEN 'weak' ELSE 'neutral' END AS state_momentum,
        CASE WHEN zscore_close_20 > 1.5 THEN 'overbought' WHEN zscore_close_20 < -1.5 THEN 'oversold' ELSE 'normal' END AS state_extension FROM features)"""),
    "runs": (("states",), """SELECT *, row_number() OVER (PARTITION BY symbol, srun ORDER BY ts) AS state_age FROM (SELECT *, sum(sc) OVER (PARTITION BY symbol ORDER BY ts) AS srun FROM
        (SELECT *, CASE WHEN state = lag(state) OVER (PARTITION BY symbol ORDER BY ts) THEN 0 ELSE 1 END AS sc, CASE state_trend WHEN 'up' THEN 'bullish' WHEN 'down' THEN 'bearish' ELSE 'neutral' END AS state_bias FROM states))"""),
    "context": (("runs",), """SELECT *, last_value(CASE WHEN state_age = 1 THEN previous_state_group END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS entry_bias FROM (SELECT *,
        coalesce(lag(state) OVER w, 'start') AS previous_state, coalesce(lag(state_bias) OVER w, 'start') AS previous_state_group, CASE WHEN state_age <= 3 THEN 'age_1_3' WHEN state_age <= 10 THEN 'age_4_10' ELSE 'age_11_plus' END AS state_age_bucket,
        concat_ws('>', coalesce(lag(state_bias, 2) OVER w, 'start'), coalesce(lag(state_bias, 1) OVER w, 'start')) AS recent_state_path FROM runs WINDOW w AS (PARTITION BY symbol ORDER BY ts))"""),
    "samples": (("states",), "SELECT symbol, ts, state, close, lead(state) OVER w AS next_state, lead(close, 5) OVER w / close - 1 AS forward_return FROM states WINDOW w AS (PARTITION BY symbol ORDER BY ts)"),
    "counts": (("samples",), "SELECT symbol, state AS current_state, next_state, count(*) AS n FROM samples WHERE next_state IS NOT NULL GROUP BY ALL"),
    "seen": (("counts",), "SELECT symbol, current_state AS s FROM counts UNION SELECT symbol, next_state FROM counts"),
    "matrix": (("seen", "counts"), """SELECT *, (count + 1.0::DOUBLE) / sum(count + 1.0::DOUBLE) OVER (PARTITION BY symbol, current_state) AS prob FROM
        (SELECT a.symbol, a.s AS current_state, b.s AS next_state, coalesce(n, 0) AS count FROM seen a JOIN seen b ON a.symbol = b.symbol LEFT JOIN counts c ON c.symbol = a.symbol AND c.current_state = a.s AND c.next_state = b.s)"""),
    "entropy": (("matrix",), """SELECT symbol, current_state AS state, -sum(prob * ln(prob)) / ln(count(*)) AS entropy, max(prob) AS concentration, greatest(1 + sum(prob * ln(prob)) / ln(count(*)), 0) AS confidence FROM matrix GROUP BY ALL"""),
    "predicted": (("matrix",), "SELECT symbol, current_state AS state, next_state AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY symbol, current_state ORDER BY prob DESC, next_state) AS k FROM matrix) WHERE k = 1"),
    "returns": (("samples",), """SELECT symbol, state, avg(forward_return) AS mean_return, median(forward_return) AS median_return, stddev_samp(forward_return) AS std_return, coalesce(avg(forward_return) / nullif(stddev_samp(forward_return), 0), 0) AS conditional_sharpe,
        avg((forward_return > 0)::INT) AS positive_rate, count(*) AS observations, coalesce(avg(forward_return) FILTER (forward_return > 0), 0) AS avg_win, coalesce(avg(forward_return) FILTER (forward_return < 0), 0) AS avg_loss
        FROM samples WHERE forward_return IS NOT NULL GROUP BY symbol, state"""),
    "scored": (("states", "returns", "entropy", "predicted"), """SELECT *, long_ev >= 0.001 AND ready AS go_long, asset_class = 'crypto' AND short_ev >= 0.001 AND ready AS go_short FROM (SELECT *, mean_return - drag AS long_ev, -mean_return - drag AS short_ev, signal_confidence >= 0.08 AND obs >= 25 AS ready FROM
        (SELECT s.symbol, s.asset_class, s.ts, s.state, s.state_family, coalesce(realized_vol_20, 0) AS volatility, coalesce(dollar_volume_20, 0) AS dollar_volume, mean_return, r.observations, coalesce(r.observations, 0) AS obs, p.predicted,
        least(greatest(coalesce(e.confidence, 0) * ln(1 + coalesce(r.observations, 0)) / ln(126), 0), 1) AS signal_confidence, least(1, coalesce(dollar_volume_20, 0) / 1e6) AS liquidity_score,
        0.001 + 0.10 * greatest(coalesce(realized_vol_20, 0), 0) + CASE WHEN coalesce(dollar_volume_20, 0) < 1e6 THEN 0.001 * (1e6 / greatest(coalesce(dollar_volume_20, 0), 1) - 1) ELSE 0 END AS drag
        FROM states s LEFT JOIN returns r USING (symbol, state) LEFT JOIN entropy e ON r.symbol = e.symbol AND r.state = e.state LEFT JOIN predicted p ON r.symbol = p.symbol AND r.state = p.state))"""),
    "signals": (("scored",), """SELECT *, CASE WHEN base_score > 0 THEN tanh(100 * base_score) ELSE 0 END AS bounded_score FROM (SELECT *, CASE WHEN signal = 'flat' THEN 0 ELSE expected_value * signal_confidence * greatest(liquidity_score, 0.05) / greatest(volatility, 0.01) END AS base_score,
        CASE WHEN signal = 'flat' THEN CASE WHEN obs < 25 THEN 'insufficient_observations' WHEN signal_confidence < 0.08 THEN 'low_confidence' WHEN long_ev < 0.001 AND (asset_class <> 'crypto' OR short_ev < 0.001) THEN 'negative_expected_value' ELSE 'candidate_not_selected' END END AS block_reason
        FROM (SELECT *, CASE signal WHEN 'short' THEN short_ev WHEN 'long' THEN long_ev ELSE 0 END AS expected_value FROM (SELECT *, CASE WHEN coalesce(go_short, false) AND short_ev > CASE WHEN go_long THEN long_ev ELSE 0 END THEN 'short' WHEN coalesce(go_long, false) THEN 'long' ELSE 'flat' END AS signal FROM scored)))"""),
    "capped": (("signals",), """SELECT *, CASE WHEN cap_passed THEN signal ELSE 'flat' END AS final_signal FROM (SELECT *, coalesce(selection_rank <= 3, true) AND coalesce(asset_class_rank <= 2, true) AS cap_passed FROM (SELECT *,
        CASE WHEN signal <> 'flat' THEN row_number() OVER (PARTITION BY ts ORDER BY signal <> 'flat' DESC, base_score DESC, symbol) END AS selection_rank,
        CASE WHEN signal <> 'flat' THEN row_number() OVER (PARTITION BY ts, asset_class ORDER BY signal <> 'flat' DESC, base_score DESC, symbol) END AS asset_class_rank FROM signals))"""),
    "funnel": (("capped",), """SELECT asset_class, gate_order, gate_name, count(*) AS candidate_count, count(*) FILTER (NOT ok AND before) AS rejected_count, count(*) FILTER (ok AND before) AS remaining_count FROM (
        SELECT asset_class, unnest([{'gate_order': 0, 'gate_name': 'observation_pass', 'before': true, 'ok': a}, {'gate_order': 1, 'gate_name': 'confidence_pass', 'before': a, 'ok': b}, {'gate_order': 2, 'gate_name': 'value_pass', 'before': a AND b, 'ok': c},
        {'gate_order': 3, 'gate_name': 'cap_pass', 'before': a AND b AND c, 'ok': d}], recursive := true) FROM (SELECT asset_class, obs >= 25 AS a, signal_confidence >= 0.08 AS b, signal <> 'flat' AS c, final_signal <> 'flat' AS d FROM capped)) GROUP BY ALL"""),
    "equity": (("bars",), "SELECT symbol, ts, 100000.0::DOUBLE * close / first_value(close) OVER (PARTITION BY symbol ORDER BY ts) AS equity FROM bars"),
    "marked": (("equity",), "SELECT *, equity / lag(equity) OVER w - 1 AS ret, equity / max(equity) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM equity WINDOW w AS (PARTITION BY symbol ORDER BY ts)"),
    "judged": (("quotes",), """SELECT *, len(rs) = 0 AS valid, array_to_string(rs, ',') AS reasons FROM (SELECT *, list_filter([CASE WHEN bid IS NULL OR ask IS NULL THEN 'invalid_price' END, CASE WHEN bid <= 0 OR ask <= 0 THEN 'nonpositive_price' END,
        CASE WHEN bid > 0 AND ask > 0 AND bid > ask THEN 'crossed_quote' END, CASE WHEN spread_bps > 50 THEN 'excessive_spread' END, CASE WHEN ask < 1 THEN 'ask_below_minimum' END, CASE WHEN bid_size <= 0 THEN 'nonpositive_bs' END, CASE WHEN ask_size <= 0 THEN 'nonpositive_as' END], lambda x: x IS NOT NULL) AS rs
        FROM (SELECT *, CASE WHEN bid > 0 AND ask > 0 AND bid <= ask THEN (ask - bid) / ((ask + bid) / 2) * 10000 END AS spread_bps FROM quotes))"""),
    "daily": (("bars",), f"""SELECT *, close > ({full('avg', 'close', 200)}) AS trend, {lag('close', 21)} / {lag('close', 126)} - 1 AS rotation, n >= 64 AND close > max(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING) AS breakout,
        n >= 64 AND close < min(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 21 PRECEDING AND 1 PRECEDING) AS breakdown, CASE WHEN n >= 61 THEN {full('stddev_samp', 'r', 60)} END AS volatility
        FROM (SELECT *, close / {lag('close')} - 1 AS r, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n FROM bars)"""),
    "fills": ((), "SELECT l_returnflag AS symbol, l_orderkey * 8 + l_linenumber AS id, l_shipdate AS ts, CASE WHEN l_linenumber % 2 = 0 THEN 'sell' ELSE 'buy' END AS side, sum(l_quantity)::BIGINT AS quantity, max(l_extendedprice) AS price FROM lineitem WHERE l_quantity >= 1 GROUP BY ALL"),
    "lots": (("fills",), "SELECT *, sum(quantity) OVER (PARTITION BY symbol, side ORDER BY ts, id ROWS UNBOUNDED PRECEDING)::BIGINT AS hi FROM fills"),
    "ticks": ((), "SELECT event_type AS symbol, ts, event_id AS seq, value AS price FROM events WHERE value > 0"),
}


def compose(final: str, *names: str) -> str:
    """WITH all that ``names`` build on, in order, then ``final``."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for before in CTES[name][0]:
                visit(before)
            order.append(name)

    for name in names:
        visit(name)
    return ("WITH RECURSIVE " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order) + "\n" if order else "") + final

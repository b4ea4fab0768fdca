"""All query ids with their DataFrame programs and SQL twins.

A query's columns are named once, as ``name`` or ``name:digits`` for doubles that are rounded; both sides
are built from that list.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks, features, ledger, markov, portfolio, signals, simulate, states, strategies, trades
from ..sources import bars as sources
from ..streaming import latest as live
from . import sql

Build = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Build] = {}
_ORACLE: dict[str, str] = {}


def add(name: str, columns: str, build: Build, source: str | None = None, *needs: str) -> None:
    """``source``: a table expression of the SQL twin over the CTEs ``needs``; None where SQL has none."""
    parts = [c.partition(":")[::2] for c in columns.split()]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = build(spark, sf_dir)
        return df.select(*(F.round(F.col(c).cast("double"), int(d)).alias(c) if d else F.col(c) for c, d in parts))

    _QUERIES[name] = run
    if source is not None:
        chosen = ", ".join(f"round(({c})::DOUBLE, {d}) AS {c}" if d else c for c, d in parts)
        _ORACLE[name] = sql.compose(f"SELECT {chosen} FROM {source}", *needs)


def _daily(s, d):
    return sources.daily_bars(s, d)


def _features(s, d):
    return features.features(_daily(s, d))


def _states(s, d):
    return states.composite(_features(s, d))


def _samples(s, d):
    return markov.labelled(_states(s, d))


def _signals(s, d):
    st = _states(s, d)
    return signals.frozen_signals(st, markov.labelled(st))


def _capped(s, d):
    return signals.capped(_signals(s, d), 3, 2)


def _equity(s, d):
    return portfolio.buy_and_hold(_daily(s, d))


def _ticks(s, d):
    return sources.table(s, d, "events").where("value > 0").select(F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("price"))


def _fills(s, d):
    f = sources.table(s, d, "lineitem").where("l_quantity >= 1")
    key = [F.col("l_returnflag").alias("symbol"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_shipdate").alias("ts"), F.when(F.col("l_linenumber") % 2 == 0, "sell").otherwise("buy").alias("side")]
    return f.groupBy(*key).agg(F.sum("l_quantity").cast("long").alias("quantity"), F.max("l_extendedprice").alias("price"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars, features, composite states, and the smoothed matrix of their transitions."""
    return markov.matrix(_samples(spark, sf_dir))


H = sql.HORIZONS
add("src_bars", "symbol ts asset_class open high low close volume:2", _daily, "bars", "bars")
add("src_live", "symbol ts close:6 volume:2", lambda s, d: signals.latest(_daily(s, d)), "(SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1)", "bars")
add("src_universe", "asset_class symbol first_group", lambda s, d: _daily(s, d).groupBy("asset_class", "symbol").agg(F.min("ts").alias("first_group")), "(SELECT asset_class, symbol, min(ts) AS first_group FROM bars GROUP BY ALL)", "bars")
add("val_bars", "symbol bars not_finite nonpositive_price inconsistent_range negative_volume duplicate_timestamps", lambda s, d: checks.validate_bars(_daily(s, d)),
    "(SELECT symbol, count(*) AS bars, 0::BIGINT AS not_finite, count(*) FILTER (least(open, high, low, close) <= 0) AS nonpositive_price, count(*) FILTER (high < greatest(open, close, low) OR low > least(open, close, high)) AS inconsistent_range, count(*) FILTER (volume < 0) AS negative_volume, 0::BIGINT AS duplicate_timestamps FROM bars GROUP BY symbol)", "bars")
add("cov_audit", "symbol day expected observed missing first_missing", lambda s, d: checks.coverage(h := sources.hourly_bars(s, d), checks.sessions(h), h.select("symbol").distinct()).withColumn("day", F.col("session").cast("timestamp_ntz")),
    """(SELECT symbol, session::TIMESTAMP AS day, count(*) AS expected, count(h.close) AS observed, count(*) FILTER (h.close IS NULL) AS missing, min(ts) FILTER (h.close IS NULL) AS first_missing FROM
    (SELECT session, unnest(generate_series(opens, closes, INTERVAL 1 HOUR)) AS ts FROM (SELECT session, min(ts) AS opens, max(ts) AS closes FROM hours GROUP BY session)) g CROSS JOIN (SELECT DISTINCT symbol FROM hours) s LEFT JOIN (SELECT symbol, ts, close FROM hours) h USING (symbol, ts) GROUP BY ALL)""", "hours")
add("quote_valid", "event_id symbol spread_bps:6 reasons valid", lambda s, d: checks.validated_quotes(sources.quotes(s, d)), "judged", "judged")
add("quote_features", "event_id mid:9 micro_price:9 imbalance:6", lambda s, d: checks.quote_features(sources.quotes(s, d)), "(SELECT event_id, (bid + ask) / 2 AS mid, (ask * bid_size + bid * ask_size) / nullif(bid_size + ask_size, 0) AS micro_price, (bid_size - ask_size) / nullif(bid_size + ask_size, 0) AS imbalance FROM quotes)", "quotes")
add("quote_batch", "symbol event_id spread_bps:6 reasons valid", lambda s, d: checks.quote_batch(sources.quotes(s, d).select("symbol").distinct().unionByName(s.createDataFrame([("absent",)], "symbol string")), sources.quotes(s, d)),
    "(SELECT s.symbol, j.event_id, j.spread_bps, CASE WHEN j.event_id IS NULL THEN 'missing_quote' ELSE j.reasons END AS reasons, coalesce(j.valid, false) AS valid FROM (SELECT DISTINCT symbol FROM quotes UNION ALL SELECT 'absent') s LEFT JOIN (SELECT * FROM judged QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, event_id DESC) = 1) j USING (symbol))", "judged")
add("quote_asof", "symbol ts close:6 asof_event_id asof_bid:6", lambda s, d: checks.as_of(sources.hourly_bars(s, d).select("symbol", "ts", "close"), sources.quotes(s, d), ["event_id", "bid"]),
    "(SELECT h.symbol, h.ts, h.close, q.event_id AS asof_event_id, q.bid AS asof_bid FROM hours h ASOF LEFT JOIN quotes q ON h.symbol = q.symbol AND h.ts >= q.ts)", "hours", "quotes")
add("f_returns", "symbol ts log_return_1:8 " + " ".join(f"return_{h}:8 return_rate_{h}:8" for h in H) + " return_accel_3_10:8 return_accel_5_20:8 return_accel_20_60:8", _features, "features", "features")
add("f_volatility", "symbol ts atr_14:4 atr_pct_14:8 realized_vol_20:7 vol_zscore_20:6 vol_regime_20:7 vol_expansion_20:7 vol_delta_20:7", _features, "features", "features")
add("f_trend", "symbol ts ma_10:6 ma_20:6 ma_50:6 ma_200:6 ma_gap_10:8 sma_distance_50:8 trend_spread:8 trend_direction_feature trend_persistence", _features, "(SELECT *, ma_gap_50 AS sma_distance_50 FROM features)", "features")
add("f_position", "symbol ts zscore_close_20:6 price_position_20:8 range_efficiency_20:8 " + " ".join(f"return_zscore_{h}_20:6" for h in H), _features, "features", "features")
add("f_volume", "symbol ts volume_mean_20:6 volume_ratio_20:8 volume_zscore_20:6 dollar_volume_20:0 volume_regime_20", _features, "features", "features")
add("f_atr_normalized", "symbol ts atr_normalized_move_1:7 atr_normalized_close_to_sma20:7 atr_normalized_close_to_sma50:7 atr_normalized_close_to_sma200:7", _features, "features", "features")
add("f_rsi", "symbol ts rsi_14:6 rsi_zone", lambda s, d: features.rsi(_daily(s, d)), "rsi", "rsi")
add("st_composite", "symbol ts state_trend state_volatility state_momentum state_extension state state_family", _states, "states", "states")
add("st_composite_rsi", "symbol ts state_extension", lambda s, d: states.composite(features.rsi(_features(s, d)), rsi="rsi_14"),
    "(SELECT symbol, ts, CASE WHEN zscore_close_20 > 1.5 OR rsi_14 > 70 THEN 'overbought' WHEN zscore_close_20 < -1.5 OR rsi_14 < 30 THEN 'oversold' ELSE 'normal' END AS state_extension FROM features JOIN (SELECT symbol, ts, rsi_14 FROM rsi) USING (symbol, ts))", "features", "rsi")
add("st_context", "symbol ts state_age state_age_bucket state_bias previous_state previous_state_group recent_state_path entry_bias", lambda s, d: states.contextual(_states(s, d)), "context", "context")
add("st_sparse", "symbol ts merged_state", lambda s, d: states.sparse_merge(_states(s, d), ["state_trend", "state_volatility", "state_momentum", "state_extension"], ["state_extension", "state_volatility"], 100),
    """(SELECT symbol, ts, CASE WHEN count(*) OVER (PARTITION BY state_trend, state_volatility, state_momentum, state_extension) >= 100 THEN state
    WHEN count(*) OVER (PARTITION BY state_trend, state_volatility, state_momentum) >= 100 THEN concat_ws('|', state_trend, state_volatility, state_momentum, 'any')
    WHEN count(*) OVER (PARTITION BY state_trend, state_momentum) >= 100 THEN concat_ws('|', state_trend, 'any', state_momentum, 'any') ELSE 'rare_state' END AS merged_state FROM states)""", "states")
add("st_bins", "symbol ts bin", lambda s, d: states.binned(_features(s, d), "return_5", 3),
    "(SELECT symbol, ts, CASE WHEN return_5 IS NULL THEN 'missing' WHEN return_5 <= e1 THEN 'b0' WHEN return_5 <= e2 THEN 'b1' ELSE 'b2' END AS bin FROM features JOIN (SELECT symbol, quantile_cont(return_5, 1 / 3.0::DOUBLE) AS e1, quantile_cont(return_5, 2 / 3.0::DOUBLE) AS e2 FROM features GROUP BY symbol) USING (symbol))", "features")
add("st_frequency", "symbol state observations frequency:8", lambda s, d: states.frequency(_states(s, d)), "(SELECT symbol, state, count(*) AS observations, count(*) / sum(count(*)) OVER (PARTITION BY symbol) AS frequency FROM states GROUP BY symbol, state)", "states")
add("st_persistence", "symbol state run_count mean_duration:6 median_duration:6 max_duration", lambda s, d: states.persistence(_states(s, d)), "(SELECT symbol, state, count(*) AS run_count, avg(n) AS mean_duration, median(n) AS median_duration, max(n) AS max_duration FROM (SELECT symbol, state, srun, count(*) AS n FROM runs GROUP BY ALL) GROUP BY symbol, state)", "runs")
add("st_summary", "symbol unique_states median_state_observations:4 min_state_observations share_states_above_threshold:8 sparse_state_count effective_state_coverage:8", lambda s, d: states.summary(_states(s, d)),
    "(SELECT symbol, count(*) AS unique_states, median(n) AS median_state_observations, min(n) AS min_state_observations, avg((n >= 15)::INT) AS share_states_above_threshold, count(*) FILTER (n < 15) AS sparse_state_count, coalesce(sum(n) FILTER (n >= 15), 0) / sum(n)::DOUBLE AS effective_state_coverage FROM (SELECT symbol, state, count(*) AS n FROM states GROUP BY ALL) GROUP BY symbol)", "states")
add("mk_lookback", "symbol ts state", lambda s, d: markov.lookback(_states(s, d), 100), "(SELECT * FROM states QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 100)", "states")
add("mk_labels", "symbol ts state next_state forward_return:8", _samples, "samples", "samples")
add("mk_matrix", "symbol current_state next_state count prob:10", flagship, "matrix", "matrix")
add("mk_state_returns", "symbol state mean_return:8 median_return:8 std_return:8 conditional_sharpe:8 positive_rate:8 avg_win:8 avg_loss:8 observations", lambda s, d: markov.state_returns(_samples(s, d)), "returns", "returns")
add("mk_transition_returns", "symbol current_state next_state mean_return:8 median_return:8 std_return:8 conditional_sharpe:8 positive_rate:8 observations", lambda s, d: markov.transition_returns(_samples(s, d)),
    """(SELECT symbol, state AS current_state, next_state, avg(forward_return) AS mean_return, median(forward_return) AS median_return, stddev_samp(forward_return) AS std_return, coalesce(avg(forward_return) / nullif(stddev_samp(forward_return), 0), 0) AS conditional_sharpe,
    avg((forward_return > 0)::INT) AS positive_rate, count(*) AS observations FROM samples WHERE forward_return IS NOT NULL AND next_state IS NOT NULL GROUP BY symbol, state, next_state)""", "samples")
add("mk_entropy", "symbol state entropy:9 confidence:9 concentration:9", lambda s, d: markov.entropy(flagship(s, d)), "entropy", "entropy")
add("mk_confusion", "symbol predicted actual n", lambda s, d: markov.confusion(x := _samples(s, d), markov.matrix(x)), "(SELECT symbol, predicted, next_state AS actual, count(*) AS n FROM samples JOIN predicted USING (symbol, state) WHERE next_state IS NOT NULL GROUP BY ALL)", "samples", "predicted")
add("mk_accuracy", "symbol accuracy:9", lambda s, d: markov.accuracy(x := _samples(s, d), markov.matrix(x)), "(SELECT symbol, avg((predicted = next_state)::INT) AS accuracy FROM samples JOIN predicted USING (symbol, state) WHERE next_state IS NOT NULL GROUP BY symbol)", "samples", "predicted")
add("sg_frozen", "symbol ts state signal expected_value:8 signal_confidence:8 liquidity_score:8 base_score:8 bounded_score:8 block_reason", _signals, "signals", "signals")
add("sg_opportunity", "symbol ts state signal expected_value:8 base_score:8", lambda s, d: signals.latest(_signals(s, d)), "(SELECT * FROM signals QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1)", "signals")
add("sel_caps", "symbol ts signal selection_rank asset_class_rank cap_passed final_signal", _capped, "capped", "capped")
add("sel_gate_breakdown", "asset_class gate_name candidate_count rejected_count remaining_count rejection_rate:8 incremental_rejection_rate:8 cumulative_rejection_rate:8", lambda s, d: signals.gate_breakdown(signals.gates(_capped(s, d))),
    "(SELECT *, rejected_count / candidate_count AS rejection_rate, rejected_count / greatest(rejected_count + remaining_count, 1) AS incremental_rejection_rate, 1 - remaining_count / candidate_count AS cumulative_rejection_rate FROM funnel)", "funnel")
add("sel_starvation", "asset_class gate_name rejected_count", lambda s, d: signals.starvation(signals.gate_breakdown(signals.gates(_capped(s, d)))), "(SELECT * FROM funnel QUALIFY row_number() OVER (PARTITION BY asset_class ORDER BY rejected_count DESC, gate_order) = 1)", "funnel")
add("sel_family", "state_family rows active_rate:8 mean_score:8", lambda s, d: _capped(s, d).groupBy("state_family").agg(F.count("*").alias("rows"), F.avg((F.col("final_signal") != "flat").cast("double")).alias("active_rate"), F.avg("bounded_score").alias("mean_score")),
    "(SELECT state_family, count(*) AS rows, avg((final_signal <> 'flat')::INT) AS active_rate, avg(bounded_score) AS mean_score FROM capped GROUP BY state_family)", "capped")

_GROUP = "trade_count win_rate:8 expectancy:8 average_pnl:4 average_win:8 average_loss:8 win_loss_size_ratio:7 sharpe:6 average_expected_value:8 average_hold_bars:7 average_mae_pct:8 average_adverse_excursion_pct:8 median_adverse_excursion_pct:8 average_uncaptured_pct:8 edge_classification"


def _group_sql(keys: str, least: int = 1, more: str = "") -> str:
    return f"""(SELECT *{more}, CASE WHEN expectancy > 0 AND average_expected_value > 0 THEN 'positive' WHEN expectancy <= 0 AND average_expected_value <= 0 THEN 'weak' ELSE 'mixed' END AS edge_classification FROM (SELECT {keys}, count(*) AS trade_count, avg((return_pct > 0)::INT) AS win_rate,
    avg(return_pct) AS expectancy, avg(pnl) AS average_pnl, coalesce(avg(return_pct) FILTER (return_pct > 0), 0) AS average_win, coalesce(avg(return_pct) FILTER (return_pct <= 0), 0) AS average_loss,
    coalesce(avg(return_pct) FILTER (return_pct > 0), 0) / nullif(abs(coalesce(avg(return_pct) FILTER (return_pct <= 0), 0)), 0) AS win_loss_size_ratio, CASE WHEN stddev_pop(return_pct) = 0 THEN 0 ELSE avg(return_pct) / nullif(stddev_pop(return_pct), 0) * sqrt(count(*)) END AS sharpe,
    avg(expected_value) AS average_expected_value, avg(hold_bars) AS average_hold_bars, avg(mae_pct) AS average_mae_pct, avg(greatest(-mae_pct, 0)) AS average_adverse_excursion_pct, median(greatest(-mae_pct, 0)) AS median_adverse_excursion_pct, avg(uncaptured_pct) AS average_uncaptured_pct
    FROM trades GROUP BY {keys} HAVING count(*) >= {least}))"""


for _key in ("asset_class", "exit_reason", "entry_state_family", "entry_state"):
    add(f"ag_by_{_key}", f"{_key} {_GROUP}", lambda s, d, k=_key: trades.group_summary(sources.trades(s, d), k), _group_sql(_key), "trades")
add("ag_by_hold_bucket", "hold_bucket trade_count expectancy:8", lambda s, d: trades.group_summary(sources.trades(s, d).withColumn("hold_bucket", trades.hold_bucket(F.col("hold_bars"))), "hold_bucket"),
    "(SELECT CASE WHEN hold_bars <= 1 THEN '1' WHEN hold_bars <= 3 THEN '2-3' WHEN hold_bars <= 5 THEN '4-5' WHEN hold_bars <= 10 THEN '6-10' ELSE '11+' END AS hold_bucket, count(*) AS trade_count, avg(return_pct) AS expectancy FROM trades GROUP BY 1)", "trades")
add("ag_failure_modes", f"failure_mode {_GROUP}", lambda s, d: trades.failure_modes(sources.trades(s, d)), _group_sql("asset_class, exit_reason, entry_state", 3, ", concat_ws(' | ', asset_class, exit_reason, entry_state) AS failure_mode"), "trades")
add("ag_excursion_hist", "bucket trade_count average_value:8 median_value:8 average_return:8 share_of_trades:8", lambda s, d: trades.excursions(t := sources.trades(s, d), F.greatest(-t["mae_pct"], F.lit(0.0))),
    """(SELECT b.bucket, count(v) AS trade_count, avg(v) AS average_value, median(v) AS median_value, avg(return_pct) AS average_return, count(v) / sum(count(v)) OVER () AS share_of_trades FROM (SELECT unnest(['0.0%-0.5%', '0.5%-1.0%', '1.0%-2.0%', '2.0%-3.0%', '3.0%+']) AS bucket, unnest([0, 0.005, 0.01, 0.02, 0.03]::DOUBLE[]) AS lo, unnest([0.005, 0.01, 0.02, 0.03, 1e9]::DOUBLE[]) AS hi) b
    LEFT JOIN (SELECT greatest(-mae_pct, 0) AS v, return_pct FROM trades) t ON v >= lo AND v < hi GROUP BY b.bucket)""", "trades")
add("ag_best_worst", "side symbol return_pct:8 exit_ts", lambda s, d: trades.extremes(sources.trades(s, d)), "(SELECT *, 'best' AS side FROM (SELECT * FROM trades ORDER BY return_pct DESC, trade_order LIMIT 25) UNION ALL SELECT *, 'worst' FROM (SELECT * FROM trades ORDER BY return_pct, trade_order LIMIT 25))", "trades")
add("pm_subperiod", "subperiod trade_count win_rate:8 average_return:8 average_pnl:4", lambda s, d: trades.subperiods(sources.trades(s, d)), "(SELECT year(exit_ts) || 'Q' || quarter(exit_ts) AS subperiod, count(*) AS trade_count, avg((pnl > 0)::INT) AS win_rate, avg(return_pct) AS average_return, avg(pnl) AS average_pnl FROM trades GROUP BY 1)", "trades")
add("wf_split_all", "part trade_count average_return:8", lambda s, d: trades.by_split_and_all(sources.trades(s, d), "fold_id"), "(SELECT coalesce(fold_id::VARCHAR, 'all') AS part, count(*) AS trade_count, avg(return_pct) AS average_return FROM trades GROUP BY GROUPING SETS ((fold_id), ()))", "trades")
_DRAW = """SELECT {k} max(1 - exp(c - greatest(0, m))) AS max_drawdown FROM (SELECT *, max(c) OVER ({p} ORDER BY exit_ts, trade_order ROWS UNBOUNDED PRECEDING) AS m FROM (SELECT *, sum(ln(1 + return_pct)) OVER ({p} ORDER BY exit_ts, trade_order ROWS UNBOUNDED PRECEDING) AS c FROM trades)) {g}"""
_BY = _DRAW.format(k="asset_class, entry_state,", p="PARTITION BY asset_class, entry_state", g="GROUP BY asset_class, entry_state")
add("eq_drawdown", "asset_class entry_state max_drawdown:8", lambda s, d: trades.drawdown(sources.trades(s, d), "asset_class", "entry_state"), f"({_BY})", "trades")
_NORM = lambda x: f"CASE WHEN max({x}) OVER () = min({x}) OVER () THEN 0.5 ELSE (({x}) - min({x}) OVER ()) / nullif(max({x}) OVER () - min({x}) OVER (), 0) END"
add("eq_quality", "asset_class entry_state sample_size expectancy:8 active_fold_count positive_fold_fraction:8 max_drawdown_contribution:7 consistency_score:7 quality_score:7 sample_size_score:7",
    lambda s, d: trades.edge_quality(sources.trades(s, d), "asset_class", "entry_state", least=5),
    f"""(SELECT *, ({_NORM('expectancy')}) * 0.25 + ({_NORM('out_of_sample_sharpe')}) * 0.25 + ({_NORM('win_rate')}) * 0.10 + ({_NORM('ln(1 + sample_size)')}) * 0.15 + ({_NORM('consistency_score')}) * 0.20 + ({_NORM('-max_drawdown_contribution')}) * 0.05 AS quality_score,
    {_NORM('ln(1 + sample_size)')} AS sample_size_score FROM (SELECT *, (({_NORM('active_fold_count')}) + ({_NORM('positive_fold_fraction')}) + ({_NORM('-expectancy_variance')}) + ({_NORM('-sharpe_variance')})) / 4 AS consistency_score FROM
    (SELECT g.*, f.* EXCLUDE (asset_class, entry_state), b.max_drawdown / (SELECT max_drawdown FROM ({_DRAW.format(k="", p="", g="")})) AS max_drawdown_contribution FROM
    (SELECT asset_class, entry_state, count(*) AS sample_size, avg(return_pct) AS expectancy, coalesce(avg(return_pct) / nullif(stddev_samp(return_pct), 0), 0) AS out_of_sample_sharpe, avg((return_pct > 0)::INT) AS win_rate FROM trades GROUP BY ALL HAVING count(*) >= 5) g
    JOIN (SELECT asset_class, entry_state, count(*) AS active_fold_count, avg((e > 0)::INT) AS positive_fold_fraction, coalesce(var_samp(e), 0) AS expectancy_variance, coalesce(var_samp(s), 0) AS sharpe_variance FROM
    (SELECT asset_class, entry_state, fold_id, avg(return_pct) AS e, coalesce(avg(return_pct) / nullif(stddev_samp(return_pct), 0), 0) AS s FROM trades GROUP BY ALL) GROUP BY ALL) f USING (asset_class, entry_state) JOIN ({_BY}) b USING (asset_class, entry_state))))""", "trades")
add("pm_returns", "symbol ts ret:8 drawdown:8", lambda s, d: portfolio.marked(_equity(s, d)), "marked", "marked")
add("pm_metrics", "symbol total_return:8 cagr:8 sharpe:7 sortino:7 max_drawdown:8 calmar:7", lambda s, d: portfolio.metrics(_equity(s, d)),
    """(SELECT *, CASE WHEN max_drawdown < 0 THEN cagr / abs(max_drawdown) ELSE 0 END AS calmar FROM (SELECT symbol, arg_max(equity, ts) / arg_min(equity, ts) - 1 AS total_return, pow(arg_max(equity, ts) / arg_min(equity, ts), 1 / (date_diff('day', min(ts), max(ts)) / 365.25::DOUBLE)) - 1 AS cagr,
    coalesce(sqrt(252) * avg(ret) / nullif(stddev_samp(ret), 0), 0) AS sharpe, coalesce(sqrt(252) * avg(ret) / nullif(sqrt(avg(CASE WHEN ret IS NOT NULL THEN pow(least(ret, 0), 2) END)), 0), 0) AS sortino, min(drawdown) AS max_drawdown FROM marked GROUP BY symbol))""", "marked")
add("ne_concentration", "symbol total:4 without_best:4", lambda s, d: portfolio.concentration(_equity(s, d)), "(SELECT symbol, sum(pnl) AS total, coalesce(sum(pnl) FILTER (n > 5), 0) AS without_best FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY pnl DESC, ts) AS n FROM (SELECT *, equity - lag(equity) OVER (PARTITION BY symbol ORDER BY ts) AS pnl FROM equity) WHERE pnl IS NOT NULL) GROUP BY symbol)", "equity")
add("ne_halt_latch", "symbol ts blocked", lambda s, d: portfolio.halt_latch(_equity(s, d), 0.5), "(SELECT symbol, ts, max((drawdown <= -0.5)::INT) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) = 1 AS blocked FROM marked)", "marked")
add("ne_loo", "symbol pnl_without:4", lambda s, d: portfolio.leave_one_out(_equity(s, d)), "(SELECT symbol, sum(arg_max(equity, ts) - arg_min(equity, ts)) OVER () - (arg_max(equity, ts) - arg_min(equity, ts)) AS pnl_without FROM equity GROUP BY symbol)", "equity")
add("ne_overhead", "day overhead:8", lambda s, d: ledger.overhead(_daily(s, d).select(F.to_date("ts").alias("session")), 300.0).withColumn("day", F.col("session").cast("timestamp_ntz")),
    "(SELECT session::TIMESTAMP AS day, sum(300.0::DOUBLE / day(last_day(d))) AS overhead FROM (SELECT session, unnest(generate_series(coalesce(lag(session) OVER (ORDER BY session) + 1, session)::TIMESTAMP, session::TIMESTAMP, INTERVAL 1 DAY))::DATE AS d FROM (SELECT DISTINCT ts::DATE AS session FROM bars)) GROUP BY session)", "bars")
_FOLD = """(SELECT (s // 63 + 1)::BIGINT AS fold_id, part, (SELECT ts FROM tl WHERE n = s + a) AS first_ts, (SELECT ts FROM tl WHERE n = s + b - 1) AS last_ts FROM (SELECT unnest(generate_series(0, (SELECT count(*) FROM tl) - 378, 63)) AS s)
    CROSS JOIN (VALUES ('train', 0, 252), ('validation', 252, 315), ('test', 315, 378)) p(part, a, b))"""
_TL = "WITH tl AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS n FROM (SELECT DISTINCT ts FROM bars)) "
add("wf_folds", "fold_id part first_ts last_ts", lambda s, d: portfolio.folds(_daily(s, d), 252, 63, 63, 63), f"({_TL}SELECT * FROM {_FOLD})", "bars")
add("wf_slice", "fold_id part symbol bars mean_close:4", lambda s, d: portfolio.sliced(b := _daily(s, d), portfolio.folds(b, 252, 63, 63, 63)).groupBy("fold_id", "part", "symbol").agg(F.count("*").alias("bars"), F.avg("close").alias("mean_close")),
    f"({_TL}SELECT fold_id, part, symbol, count(*) AS bars, avg(close) AS mean_close FROM bars JOIN {_FOLD} f ON ts BETWEEN first_ts AND last_ts GROUP BY ALL)", "bars")
add("brk_candidate", "symbol ts level:6 close:6 relative_volume:8", lambda s, d: strategies.breakout(sources.hourly_bars(s, d)),
    "(SELECT symbol, ts, level, close, volume / nullif(mv, 0) AS relative_volume FROM (SELECT *, max(high) OVER w AS level, avg(volume) OVER w AS mv, count(*) OVER w AS seen, min(ts) OVER w AS since, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS lc FROM hours WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING)) WHERE seen = 15 AND since = ts - INTERVAL 15 HOURS AND close > level AND close > lc AND volume >= 1.2 * mv)", "hours")
_E = "list_reduce(list(close) OVER (PARTITION BY symbol, session ORDER BY ts ROWS UNBOUNDED PRECEDING), lambda a, x: a * (1 - {0}) + x * {0})"
add("mom_daily", "symbol ts momentum:8 volatility:8 score:7 atr:4", lambda s, d: strategies.momentum(_daily(s, d)),
    f"(SELECT symbol, ts, momentum, volatility, momentum / nullif(volatility, 0) AS score, atr_14 AS atr FROM (SELECT *, return_20 AS momentum, {sql.full('stddev_samp', 'return_1', 20)} AS volatility FROM f2) WHERE momentum > 0 AND volatility > 0 AND atr_14 > 0)", "f2")
add("h_feature", "symbol ts trend rotation:8 breakout breakdown volatility:8", lambda s, d: strategies.daily_features(_daily(s, d)), "daily", "daily")
add("h_due", "ts month_end week_end", lambda s, d: strategies.due(_daily(s, d)), "(SELECT ts, date_trunc('month', ts) <> date_trunc('month', n) AS month_end, isoyear(ts) <> isoyear(n) OR weekofyear(ts) <> weekofyear(n) AS week_end FROM (SELECT ts, lead(ts) OVER (ORDER BY ts) AS n FROM (SELECT DISTINCT ts FROM bars)) WHERE n IS NOT NULL)", "bars")
add("h_weights", "symbol ts weight:8", lambda s, d: strategies.inverse_volatility(strategies.daily_features(_daily(s, d))), "(SELECT symbol, ts, least(0.10, 0.25 * (1 / volatility) / sum(1 / volatility) OVER (PARTITION BY ts)) AS weight FROM daily WHERE volatility > 0)", "daily")
add("h_rotation", "ts symbol place rotation:8", lambda s, d: strategies.rotation(strategies.daily_features(_daily(s, d))), "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY rotation DESC, symbol) AS place FROM daily WHERE rotation IS NOT NULL) WHERE place <= 2 AND rotation > 0)", "daily")
add("don20", "symbol ts enter leave", lambda s, d: strategies.channel(_daily(s, d)), "(SELECT symbol, ts, coalesce(n = 20 AND close > hi, false) AS enter, coalesce(n = 20 AND close < lo, false) AS leave FROM (SELECT *, max(close) OVER w AS hi, count(*) OVER w AS n, min(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS lo FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)))", "bars")
add("div_corr", "a b days correlation:7", lambda s, d: strategies.correlations(_daily(s, d)), "(SELECT x.symbol AS a, y.symbol AS b, count(*) AS days, covar_pop(x.return_1, y.return_1) / nullif(stddev_pop(x.return_1) * stddev_pop(y.return_1), 0) AS correlation FROM f2 x JOIN f2 y ON x.ts = y.ts AND x.symbol < y.symbol WHERE x.return_1 IS NOT NULL AND y.return_1 IS NOT NULL GROUP BY ALL)", "f2")
add("opt_sample", "p_partkey p_brand turn place", lambda s, d: strategies.round_robin(sources.table(s, d, "part"), "p_brand", "p_retailprice", "p_partkey"), "(SELECT p_partkey, p_brand, turn, row_number() OVER (ORDER BY turn, p_brand) AS place FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS turn FROM part))")
add("cost_audit", "symbol cost_bps net:2 break_even_bps:6", lambda s, d: strategies.cost_levels(sources.trades(s, d)), "(SELECT symbol, c AS cost_bps, sum(pnl) - sum(entry_notional) * c / 10000 AS net, sum(pnl) / sum(entry_notional) * 10000 AS break_even_bps FROM trades CROSS JOIN (SELECT unnest([2, 5, 7, 10]::DOUBLE[]) AS c) GROUP BY symbol, c)", "trades")
add("scen_envelope", "bucket n mean:6 least:6 median:6 greatest:6", lambda s, d: strategies.buckets(sources.table(s, d, "lineitem"), "l_discount", "l_extendedprice", 4),
    "(SELECT least(floor((l_discount - lo) / (hi - lo) * 4), 3)::BIGINT AS bucket, count(*) AS n, avg(l_extendedprice) AS mean, min(l_extendedprice) AS least, median(l_extendedprice) AS median, max(l_extendedprice) AS greatest FROM lineitem CROSS JOIN (SELECT min(l_discount) AS lo, max(l_discount) AS hi FROM lineitem) GROUP BY 1)")
add("rep_pivot", "entry_state state_change:8 time_exit:8 signal_flip:8", lambda s, d: sources.trades(s, d).groupBy("entry_state").pivot("exit_reason", ["state_change", "time_exit", "signal_flip"]).agg(F.avg("return_pct")),
    "(SELECT entry_state, avg(return_pct) FILTER (exit_reason = 'state_change') AS state_change, avg(return_pct) FILTER (exit_reason = 'time_exit') AS time_exit, avg(return_pct) FILTER (exit_reason = 'signal_flip') AS signal_flip FROM trades GROUP BY entry_state)", "trades")
add("lg_fifo", "symbol buy_id sell_id quantity pnl:2", lambda s, d: ledger.fifo(_fills(s, d), F.to_date("ts")),
    "(SELECT symbol, buy_id, sell_id, sum(quantity)::BIGINT AS quantity, sum(pnl) AS pnl FROM (SELECT b.symbol, b.id AS buy_id, s.id AS sell_id, least(b.hi, s.hi) - greatest(b.hi - b.quantity, s.hi - s.quantity) AS quantity, (least(b.hi, s.hi) - greatest(b.hi - b.quantity, s.hi - s.quantity)) * (s.price - b.price) AS pnl FROM lots b JOIN lots s ON b.symbol = s.symbol AND b.side = 'buy' AND s.side = 'sell' AND b.hi - b.quantity < s.hi AND s.hi - s.quantity < b.hi) GROUP BY ALL)", "lots")
add("lg_reconcile", "symbol opening moved ending difference", lambda s, d: ledger.reconcile(f := _fills(s, d), f.groupBy("symbol").agg(F.lit(100).cast("long").alias("quantity")), f.groupBy("symbol").agg((F.sum(F.when(F.col("side") == "buy", F.col("quantity")).otherwise(-F.col("quantity"))) + 90).alias("quantity"))),
    "(SELECT symbol, 100::BIGINT AS opening, m AS moved, m + 90 AS ending, 10::BIGINT AS difference FROM (SELECT symbol, sum(CASE side WHEN 'buy' THEN quantity ELSE -quantity END)::BIGINT AS m FROM fills GROUP BY symbol))", "fills")
add("ss_ingest", "symbol ts seq price:6 n", lambda s, d: live.latest(_ticks(s, d)), "(SELECT symbol, max(ts) AS ts, arg_max(seq, row(ts, seq)) AS seq, arg_max(price, row(ts, seq)) AS price, count(*) AS n FROM ticks GROUP BY symbol)", "ticks")
add("ss_ooo", "symbol out_of_order seen", lambda s, d: live.out_of_order(_ticks(s, d)), "(SELECT symbol, count(*) FILTER (late) AS out_of_order, count(*) AS seen FROM (SELECT *, coalesce(ts < max(ts) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late FROM ticks) GROUP BY symbol)", "ticks")
add("ss_health", "symbol first_ts last_ts n", lambda s, d: live.gaps(_ticks(s, d), 3600), "(SELECT symbol, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY ts, seq) AS run FROM (SELECT *, CASE WHEN (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY symbol ORDER BY ts, seq))) // 1000000 > 3600 OR lag(ts) OVER (PARTITION BY symbol ORDER BY ts, seq) IS NULL THEN 1 ELSE 0 END AS new FROM ticks)) GROUP BY symbol, run)", "ticks")


def _accounts(s, d):
    """One account for each asset class, on the capped signals."""
    st = _features(s, d).select("symbol", "ts", "open", "high", "low", "close", F.col("atr_14").alias("atr"))
    return st.join(_capped(s, d).select("symbol", "asset_class", "ts", "state", F.col("final_signal").alias("signal"), F.col("base_score").alias("score")), ["symbol", "ts"])


add("bt_event", "account symbol side entry_ts exit_ts entry_price:4 exit_price:4 quantity:6 pnl:4 return_pct:8 hold_bars exit_reason cash_after:4", lambda s, d: simulate.simulate(_accounts(s, d), "asset_class", simulate.BacktestConfig(daily_loss=0.5)))


from . import gate_queries, more_queries, research_queries  # noqa: E402, F401  (they add their queries)


def queries() -> dict[str, Build]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)

"""Queries of evidence checks, session strategies, streams, ledgers and state models, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence, features, gates, ledger, markov, models, signals, strategies, trades
from ..sources import bars as sources
from ..streaming import latest as live
from . import sql
from .gate_queries import _universe
from .registry import _daily, _features, _samples, _states, add

# ---- session strategies -------------------------------------------------------------------------------------------
_E = "list_reduce(list(close) OVER (PARTITION BY symbol, session ORDER BY ts ROWS UNBOUNDED PRECEDING), lambda a, x: a * (1 - {0}) + x * {0})"
add("id_signals", "symbol ts vwap:6 fast:6 slow:6 relative_volume:8 opening_high:6 atr:6 breakout recovery entry setup", lambda s, d: strategies.session_signals(sources.hourly_bars(s, d), atr=3, volume=1.0, price=5.0, dollars=100.0),
    f"""(SELECT *, coalesce(minute > 5 AND fast > slow AND close > vwap AND close >= 5 AND close * volume >= 100 AND relative_volume >= 1.0 AND atr > 0 AND (breakout OR recovery), false) AS entry, CASE WHEN breakout THEN 'opening_breakout' ELSE 'vwap_recovery' END AS setup FROM
    (SELECT *, coalesce(close > opening_high AND lag(close) OVER w <= lag(opening_high) OVER w, false) AS breakout, coalesce(close > vwap AND lag(close) OVER w <= lag(vwap) OVER w AND fast > lag(fast) OVER w, false) AS recovery,
    CASE WHEN count(tr) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3 THEN avg(tr) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END AS atr FROM
    (SELECT *, sum((high + low + close) / 3 * volume) OVER w / nullif(sum(volume) OVER w, 0) AS vwap, {_E.format('(2 / 10.0::DOUBLE)')} AS fast, {_E.format('(2 / 22.0::DOUBLE)')} AS slow, volume / nullif(CASE WHEN count(*) OVER b = 5 THEN avg(volume) OVER b END, 0) AS relative_volume, max(CASE WHEN minute <= 3 THEN high END) OVER w AS opening_high
    FROM (SELECT *, row_number() OVER (PARTITION BY symbol, session ORDER BY ts) AS minute, greatest(high - low, abs(high - lag(close) OVER (PARTITION BY symbol, session ORDER BY ts)), abs(low - lag(close) OVER (PARTITION BY symbol, session ORDER BY ts))) AS tr FROM hours)
    WINDOW w AS (PARTITION BY symbol, session ORDER BY ts ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY symbol, session ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)) WINDOW w AS (PARTITION BY symbol, session ORDER BY ts)))""", "hours")


def _marred(s, d):
    """Hourly bars with a malformed one at six in the morning of every fifth day."""
    bad = (F.dayofmonth("ts") % 5 == 0) & (F.hour("ts") == 6)
    return sources.hourly_bars(s, d).withColumn("volume", F.when(bad, -1.0).otherwise(F.col("volume")))


def _trail(x: str, n: int, f: str) -> str:
    w = f"(PARTITION BY symbol, session ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) OVER {w} = {n} THEN {f}({x}) OVER {w} END"


add("mr_session", "symbol ts z:6 path:8 vwap:6 atr:6 reason", lambda s, d: strategies.session_reversion(_marred(s, d), n=3, atr=2, step_s=3600, opens=240, closes=1200, threshold=-0.1, efficiency=0.9),
    f"""(SELECT *, CASE WHEN NOT minute BETWEEN 240 AND 1200 THEN 'outside_signal_window' WHEN n <= 3 THEN 'insufficient_history' WHEN gaps > 0 THEN 'missing_minute' WHEN bads > 0 THEN 'invalid_observation'
    WHEN sold <= 0 OR coalesce(sigma <= 0, false) OR coalesce(dist <= 0, false) THEN 'zero_denominator' WHEN NOT coalesce(z <= -0.1 AND close > lc AND path <= 0.9 AND atr > 0, false) THEN 'signal_filter' ELSE 'qualified' END AS reason FROM
    (SELECT *, (lg - ln(vwap)) / nullif(sigma, 0) AS z, far / nullif(dist, 0) AS path FROM (SELECT *, {_trail('lg', 3, 'stddev_samp')} AS sigma, {_trail('move', 3, 'sum')} AS dist, {_trail('tr', 2, 'avg')} AS atr, sum(gap) OVER w AS gaps, sum(bad) OVER w AS bads,
    hour(ts + INTERVAL 1 HOUR) * 60 + minute(ts + INTERVAL 1 HOUR) AS minute, abs(close - lag(close, 3) OVER w) AS far FROM
    (SELECT *, row_number() OVER w AS n, abs(close - lag(close) OVER w) AS move, ln(close) AS lg, lag(close) OVER w AS lc, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr,
    CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <> 3600000000 THEN 1 ELSE 0 END AS gap, CASE WHEN volume >= 0 THEN 0 ELSE 1 END AS bad, sum(volume) OVER w AS sold, sum(close * volume) OVER w / nullif(sum(volume) OVER w, 0) AS vwap
    FROM (SELECT * EXCLUDE (volume), CASE WHEN day(ts) % 5 = 0 AND hour(ts) = 6 THEN -1 ELSE volume END AS volume FROM hours) WINDOW w AS (PARTITION BY symbol, session ORDER BY ts)) WINDOW w AS (PARTITION BY symbol, session ORDER BY ts))))""", "hours")

_PAST, _SEEN = "(PARTITION BY a, b ORDER BY ts ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)", "(PARTITION BY a, b ORDER BY ts ROWS BETWEEN 125 PRECEDING AND 6 PRECEDING)"
sql.CTES |= {
    "pairbars": (("bars",), "SELECT symbol, ts, open, close FROM bars UNION ALL SELECT 'BASKET', ts, avg(open), avg(close) FROM bars WHERE symbol IN ('1-URGENT', '2-HIGH') GROUP BY ts HAVING count(*) = 2"),
    "legs": (("pairbars",), "SELECT p.a, p.b, x.ts, ln(x.close) AS y, ln(z.close) AS x, x.open AS oa, z.open AS ob FROM (VALUES ('1-URGENT', 'BASKET'), ('2-HIGH', 'BASKET'), ('1-URGENT', '2-HIGH')) p(a, b) JOIN pairbars x ON x.symbol = p.a JOIN pairbars z ON z.symbol = p.b AND z.ts = x.ts"),
    "fits": (("legs",), f"""SELECT *, CASE WHEN slope BETWEEN 0.5 AND 1.5 AND sqrt(greatest(yy - slope * xy, 0) * 60 / 58) > 1e-10 THEN slope END AS beta FROM (SELECT *, CASE WHEN n = 60 AND xx * 60 > 1e-12 THEN xy / xx END AS slope FROM
        (SELECT *, mxx - mx * mx AS xx, mxy - mx * my AS xy, myy - my * my AS yy FROM (SELECT *, count(*) OVER {_PAST} AS n, avg(x) OVER {_PAST} AS mx, avg(y) OVER {_PAST} AS my, avg(x * x) OVER {_PAST} AS mxx, avg(x * y) OVER {_PAST} AS mxy, avg(y * y) OVER {_PAST} AS myy FROM legs)))"""),
    "spreads": (("fits",), """SELECT *, -(y - my - beta * (x - mx)) / (1 + beta) AS feature, ((lead(oa, 6) OVER w / lead(oa, 1) OVER w - 1) - beta * (lead(ob, 6) OVER w / lead(ob, 1) OVER w - 1)) / (1 + beta) AS label, lead(ts, 6) OVER w AS ready FROM fits WINDOW w AS (PARTITION BY a, b ORDER BY ts)"""),
    "learnt": (("spreads",), f"""SELECT *, ff - mf * mf AS df, gg - mg * mg AS dg, fg - mf * mg AS cov FROM (SELECT *, count(f) OVER {_SEEN} AS labels, avg(f) OVER {_SEEN} AS mf, avg(g) OVER {_SEEN} AS mg, avg(f * f) OVER {_SEEN} AS ff, avg(f * g) OVER {_SEEN} AS fg, avg(g * g) OVER {_SEEN} AS gg, max(CASE WHEN f IS NOT NULL THEN ready END) OVER {_SEEN} AS last_label_at
        FROM (SELECT *, CASE WHEN label IS NOT NULL THEN feature END AS f, CASE WHEN feature IS NOT NULL THEN label END AS g FROM spreads))"""),
}


def _forecasts(s, d):
    pairs = s.createDataFrame([("1-URGENT", "BASKET"), ("2-HIGH", "BASKET"), ("1-URGENT", "2-HIGH")], "a string, b string")
    return strategies.pair_forecasts(sources.pair_bars(s, d), pairs)


add("rv_forecast", "pair signal_at feature:6 beta:6 prediction:6 standard_error:6 labels last_label_at label:6 label_at", _forecasts,
    """(SELECT a || '/' || b AS pair, ts AS signal_at, feature, beta, mg + cov / df * (feature - mf) AS prediction, sqrt(greatest(dg - cov / df * cov, 0) * labels / (labels - 2)) * sqrt(1.0::DOUBLE / labels + (feature - mf) * (feature - mf) / (df * labels)) AS standard_error, labels, last_label_at, label, CASE WHEN label IS NOT NULL THEN ready END AS label_at
    FROM learnt WHERE feature IS NOT NULL AND labels >= 40 AND df * labels > 1e-14)""", "learnt")

# ---- streams and ledgers ------------------------------------------------------------------------------------------
sql.CTES |= {
    "obs": ((), "SELECT CASE WHEN user_id % 2 = 0 THEN 'bars' ELSE 'quotes' END AS channel, event_type || '/' || user_id AS symbol, ts, event_id AS seq, CASE WHEN event_id % 50 <> 0 THEN value END AS price, (user_id % 3)::INT AS generation FROM events"),
    "seenobs": (("obs",), """SELECT o.*, n.now, CASE WHEN price IS NULL OR price <= 0 THEN 'invalid' WHEN ts > now THEN 'future' WHEN channel = 'bars' AND epoch_us(ts) + 60000000 > epoch_us(now) THEN 'incomplete' END AS rejected
        FROM obs o CROSS JOIN (SELECT max(ts) AS now FROM obs WHERE channel = 'quotes' AND generation = 1 AND seq % 5 = 2) n"""),
}


def _now(s, d):
    """An instant within the data: some observations lie after it, one is of that very moment."""
    return F.lit(sources.observations(s, d).where("channel = 'quotes' and generation = 1 and seq % 5 = 2").agg(F.max("ts")).first()[0]).cast("timestamp_ntz")


add("ss_snapshot", "channel symbol ts seq age_s:6 state", lambda s, d: live.snapshot(sources.observations(s, d), _now(s, d), 1),
    """(SELECT *, CASE WHEN generation <> 1 THEN 'retained_previous_session' WHEN age_s BETWEEN 0 AND CASE channel WHEN 'bars' THEN 180 ELSE 60 END THEN 'fresh' ELSE 'stale' END AS state FROM (SELECT *, (epoch_us(now) - epoch_us(ts)) / 1000000 AS age_s FROM
    (SELECT *, row_number() OVER (PARTITION BY channel, symbol ORDER BY ts DESC, seq DESC) AS k FROM seenobs WHERE rejected IS NULL) WHERE k = 1))""", "seenobs")
add("ss_ingest_counts", "channel received invalid future incomplete out_of_order", lambda s, d: live.ingest_counts(sources.observations(s, d).withColumn("seq", F.col("seq") - F.pmod("seq", F.lit(7)) * 40), _now(s, d)),
    """(SELECT channel, count(*) AS received, count(*) FILTER (rejected = 'invalid') AS invalid, count(*) FILTER (rejected = 'future') AS future, count(*) FILTER (rejected = 'incomplete') AS incomplete, count(*) FILTER (late) AS out_of_order FROM
    (SELECT *, rejected IS NULL AND coalesce(ts < max(CASE WHEN rejected IS NULL THEN ts END) OVER (PARTITION BY channel, symbol ORDER BY seq - (seq % 7) * 40 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late FROM seenobs) GROUP BY channel)""", "seenobs")
add("ss_ooo_accepted", "symbol out_of_order seen", lambda s, d: live.out_of_order(live.observed(sources.observations(s, d).withColumn("seq", F.col("seq") - F.pmod("seq", F.lit(7)) * 40), _now(s, d)).where("rejected is null"), bucket=500),
    """(SELECT symbol, count(*) FILTER (late) AS out_of_order, count(*) AS seen FROM (SELECT symbol, coalesce(ts < max(ts) OVER (PARTITION BY symbol ORDER BY seq - (seq % 7) * 40 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late FROM seenobs WHERE rejected IS NULL) GROUP BY symbol)""", "seenobs")


sql.CTES |= {
    "custorders": ((), "SELECT o_custkey, o_orderkey, o_orderkey || '|' || o_orderstatus AS content, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS number FROM orders"),
    "chain": (("custorders",), """SELECT o_custkey, o_orderkey, content, number, '' AS previous_hash, sha256(number || '|' || content || '|') AS link_hash FROM custorders WHERE number = 1
        UNION ALL SELECT o.o_custkey, o.o_orderkey, o.content, o.number, c.link_hash, sha256(o.number || '|' || o.content || '|' || c.link_hash) FROM chain c JOIN custorders o ON o.o_custkey = c.o_custkey AND o.number = c.number + 1"""),
}


def _stored_chain(s, d):
    """Chains of the orders of each customer, then tampered with: contents, hashes, and missing links."""
    o = sources.table(s, d, "orders").select("o_custkey", "o_orderkey", F.concat_ws("|", "o_orderkey", "o_orderstatus").alias("content"))
    made = ledger.chained(o, "o_custkey", "o_orderkey", "content")
    key = F.col("o_orderkey")
    bad = made.withColumns({"content": F.when(key % 31 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")), "link_hash": F.when(key % 29 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.col("link_hash"))})
    return bad.where(key % 37 != 0)


add("lg_chain", "o_custkey o_orderkey number link_hash faults", lambda s, d: ledger.verified(_stored_chain(s, d), "o_custkey", "content").withColumn("faults", F.concat_ws(",", "faults")),
    """(SELECT o_custkey, o_orderkey, number, link_hash, concat_ws(',', CASE WHEN number <> coalesce(lag(number) OVER w, 0) + 1 THEN 'missing_link' END, CASE WHEN previous_hash <> coalesce(lag(link_hash) OVER w, '') THEN 'broken_link' END,
    CASE WHEN sha256(number || '|' || content || '|' || previous_hash) <> link_hash THEN 'hash_mismatch' END) AS faults FROM
    (SELECT o_custkey, o_orderkey, number, previous_hash, content || CASE WHEN o_orderkey % 31 = 0 THEN '!' ELSE '' END AS content, CASE WHEN o_orderkey % 29 = 0 THEN sha256('x') ELSE link_hash END AS link_hash FROM chain WHERE o_orderkey % 37 <> 0) WINDOW w AS (PARTITION BY o_custkey ORDER BY number))""", "chain")

# ---- evidence -----------------------------------------------------------------------------------------------------
sql.CTES |= {
    "cal": (("hours",), """SELECT session, CASE WHEN day(session) % 7 = 0 THEN opens + INTERVAL 20 SECONDS ELSE opens END AS open, CASE WHEN day(session) % 5 = 0 THEN opens + INTERVAL 10 MINUTES WHEN day(session) % 11 = 0 THEN closes + INTERVAL 2 DAYS ELSE closes END AS close
        FROM (SELECT session, min(ts) AS opens, max(ts) AS closes FROM hours GROUP BY session)"""),
    "days": ((), """SELECT strftime(d, '%Y-%m-%d') AS date, CASE WHEN day(d) % 6 = 0 THEN '16:30' ELSE '09:30' END AS open, CASE WHEN day(d) % 4 = 0 THEN '13:00' ELSE '16:00' END AS close FROM (SELECT DISTINCT date_trunc('day', ts) AS d FROM events) UNION ALL
        SELECT strftime(d, '%Y-%m-%d'), '09:30', '16:00' FROM (SELECT DISTINCT date_trunc('day', ts) AS d FROM events WHERE day(ts) % 10 = 0)"""),
    "env": ((), """SELECT event_id, event_type AS symbol, CASE WHEN event_id % 19 = 0 THEN 'view' ELSE event_type END AS expected_symbol, CASE WHEN event_id % 23 = 0 THEN 'iex' ELSE 'sip' END AS feed, event_id % 17 <> 0 AS there,
        CASE WHEN event_id % 47 <> 0 THEN ts + to_seconds(event_id % 6 - 2) END AS received_at, ts + to_seconds(event_id % 6 - 2 + CASE WHEN event_id % 13 = 0 THEN event_id % 4 * 10 - 5 ELSE event_id % 4 END) AS decision_at,
        CASE WHEN event_id % 43 <> 0 AND event_id % 17 <> 0 THEN ts END AS t, CASE WHEN event_id % 17 = 0 OR event_id % 37 = 0 THEN NULL WHEN event_id % 41 = 0 THEN 0 ELSE round(value, 6) END AS bp, CASE WHEN event_id % 17 <> 0 THEN round(CASE WHEN event_id % 31 = 0 THEN value * 0.9 ELSE value * (1 + json_extract_string(props, '$.k')::DOUBLE / 10000) END, 6) END AS ap,
        CASE WHEN event_id % 29 <> 0 THEN (event_id % 5)::DOUBLE END AS bs, (event_id % 7)::DOUBLE AS "as" FROM events"""),
}


def _cal(s, d):
    c = sources.hourly_bars(s, d).groupBy("session").agg(F.min("ts").alias("opens"), F.max("ts").alias("closes"))
    day = F.dayofmonth("session")
    close = F.when(day % 5 == 0, F.col("opens") + F.expr("INTERVAL 10 MINUTES")).when(day % 11 == 0, F.col("closes") + F.expr("INTERVAL 2 DAYS")).otherwise(F.col("closes"))
    return c.select("session", F.when(day % 7 == 0, F.col("opens") + F.expr("INTERVAL 20 SECONDS")).otherwise(F.col("opens")).alias("open"), close.alias("close"))


def _days(s, d):
    e = sources.table(s, d, "events").select(F.to_date("ts").alias("d"), F.dayofmonth("ts").alias("n")).distinct()
    text = F.date_format("d", "yyyy-MM-dd").alias("date")
    days = e.select(text, F.when(F.col("n") % 6 == 0, "16:30").otherwise("09:30").alias("open"), F.when(F.col("n") % 4 == 0, "13:00").otherwise("16:00").alias("close"))
    return days.unionByName(e.where("n % 10 = 0").select(text, F.lit("09:30").alias("open"), F.lit("16:00").alias("close")))


_JOINED = lambda df: df.withColumn("reasons", F.concat_ws(",", "reasons"))
add("val_minutes", "event_id reasons", lambda s, d: _JOINED(evidence.minute_faults(sources.table(s, d, "events").select("event_id", F.col("event_type").alias("symbol"), F.when(F.pmod("event_id", F.lit(3)) == 0, F.col("ts")).otherwise(F.date_trunc("minute", "ts").cast("timestamp_ntz")).alias("ts"), (F.col("event_id") - F.pmod("event_id", F.lit(5)) * 9).alias("seq")))),
    """(SELECT event_id, concat_ws(',', CASE WHEN date_trunc('minute', ts) <> ts THEN 'not_minute_aligned' END, CASE WHEN ts < max(ts) OVER (PARTITION BY event_type, ts::DATE ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 'not_chronological' END) AS reasons
    FROM (SELECT event_id, event_type, CASE WHEN event_id % 3 = 0 THEN ts ELSE date_trunc('minute', ts) END AS ts, event_id - (event_id % 5) * 9 AS seq FROM events))""")
add("val_schedule", "day open close reasons", lambda s, d: _JOINED(evidence.schedule_faults(_cal(s, d))).withColumn("day", F.col("session").cast("timestamp_ntz")),
    """(SELECT session::TIMESTAMP AS day, open, close, concat_ws(',', CASE WHEN open <= lag(open) OVER w THEN 'not_ordered' END, CASE WHEN date_trunc('minute', open) <> open OR date_trunc('minute', close) <> close OR epoch_us(close) - epoch_us(open) NOT BETWEEN 1800000000 AND 43200000000 THEN 'invalid_interval' END,
    CASE WHEN open < lag(close) OVER w THEN 'overlapping' END) AS reasons FROM cal WINDOW w AS (ORDER BY session))""", "cal")
# the zone's offset in the table's months is five hours; a unit test has both sides of summer time
add("val_calendar", "date opens closes reasons", lambda s, d: _JOINED(evidence.local_calendar(_days(s, d), "2024-01-03", "2024-12-31")),
    """(SELECT date, opens, closes, concat_ws(',', CASE WHEN n > 1 THEN 'duplicate_session' END, CASE WHEN date < '2024-01-03' OR date > '2024-12-31' THEN 'outside_interval' END, CASE WHEN closes <= opens THEN 'invalid_hours' END) AS reasons FROM
    (SELECT *, (date || ' ' || open)::TIMESTAMP + INTERVAL 5 HOURS AS opens, (date || ' ' || close)::TIMESTAMP + INTERVAL 5 HOURS AS closes, count(*) OVER (PARTITION BY date) AS n FROM days))""", "days")
add("cov_causal", "id symbol present eligible", lambda s, d: evidence.causal_windows(sources.table(s, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("symbol"), F.col("ts").alias("at")), sources.hourly_bars(s, d), 3),
    """(SELECT e.event_id AS id, e.event_type AS symbol, count(h.ts) AS present, count(h.ts) = 3 AS eligible FROM events e CROSS JOIN (SELECT unnest([1, 2, 3]) AS k) LEFT JOIN hours h ON h.symbol = e.event_type AND h.ts = date_trunc('hour', e.ts) - to_hours(k) GROUP BY 1, 2)""", "hours")
add("val_pairs", "a b symbol missing extra valid", lambda s, d: evidence.calendar_mismatches(sources.pair_bars(s, d), _daily(s, d).where("symbol = '1-URGENT'").select("ts"), s.createDataFrame([("1-URGENT", "BASKET"), ("1-URGENT", "1-URGENT"), ("2-HIGH", "NONE")], "a string, b string")),
    """(SELECT a, b, symbol, t - held AS missing, n - held AS extra, t = held AND n = held AND a <> b AS valid FROM (SELECT a, b, l.symbol, (SELECT count(*) FROM bars WHERE symbol = '1-URGENT') AS t, (SELECT count(*) FROM pairbars p WHERE p.symbol = l.symbol) AS n,
    (SELECT count(*) FROM pairbars p JOIN bars c ON c.ts = p.ts AND c.symbol = '1-URGENT' WHERE p.symbol = l.symbol) AS held FROM (SELECT DISTINCT a, b, unnest([a, b]) AS symbol FROM (VALUES ('1-URGENT', 'BASKET'), ('1-URGENT', '1-URGENT'), ('2-HIGH', 'NONE')) v(a, b)) l))""", "pairbars")
add("quote_envelope", "event_id valid reasons cache_age_s:6 source_age_s:6 spread_bps:4", lambda s, d: _JOINED(evidence.judged_envelopes(sources.envelopes(s, d))),
    """(SELECT *, reasons = '' AS valid FROM (SELECT event_id, cache_age_s, source_age_s, spread_bps, concat_ws(',', CASE WHEN expected_symbol <> symbol THEN 'quote_symbol_mismatch' END, CASE WHEN feed <> 'sip' THEN 'unexpected_feed' END, CASE WHEN cache_age_s < -1 THEN 'receipt_after_decision' END, CASE WHEN cache_age_s > 5 THEN 'stale_cache' END,
    CASE WHEN received_at IS NULL THEN 'invalid_local_timestamp' END, CASE WHEN NOT there THEN 'missing_quote' END, CASE WHEN there AND t IS NULL THEN 'invalid_event_timestamp' END, CASE WHEN source_age_s < -1 THEN 'future_event' END, CASE WHEN source_age_s > 15 THEN 'stale_source' END,
    CASE WHEN ahead > 1 THEN 'event_after_receipt' END, CASE WHEN there AND bp IS NULL THEN 'invalid_price' END, CASE WHEN there AND bp IS NOT NULL AND (bp <= 0 OR ap <= 0) THEN 'nonpositive_price' END, CASE WHEN there AND bp > 0 AND ap > 0 AND bp > ap THEN 'crossed_quote' END,
    CASE WHEN spread_bps > 50 THEN 'excessive_spread' END, CASE WHEN there AND bp IS NOT NULL AND ap < 1 THEN 'ask_below_minimum' END, CASE WHEN there AND bs IS NULL THEN 'invalid_bs' END, CASE WHEN there AND bs <= 0 THEN 'nonpositive_bs' END, CASE WHEN there AND "as" <= 0 THEN 'nonpositive_as' END) AS reasons
    FROM (SELECT *, (epoch_us(decision_at) - epoch_us(received_at)) / 1000000 AS cache_age_s, CASE WHEN received_at IS NOT NULL THEN (epoch_us(decision_at) - epoch_us(t)) / 1000000 END AS source_age_s, (epoch_us(t) - epoch_us(received_at)) / 1000000 AS ahead,
    CASE WHEN bp > 0 AND ap > 0 AND bp <= ap THEN (ap - bp) * 20000 / (ap + bp) END AS spread_bps FROM env)))""", "env")
add("edge_filter", "l_orderkey l_linenumber l_partkey reason net_edge_bps:6 eligible", lambda s, d: evidence.net_edge(sources.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey",
    F.when(F.pmod("l_partkey", F.lit(9)) != 0, F.col("l_discount") * 100).alias("gross"), (F.col("l_tax") * 20 - 0.1).alias("uncertainty"), (F.col("l_tax") * 50).alias("cost"), F.lit(0.5).alias("inventory"), F.col("l_shipdate").alias("forecast_at"),
    F.timestamp_add("DAY", F.pmod("l_suppkey", F.lit(4)) - 1, F.col("l_shipdate")).alias("decision_at"), (F.pmod("l_suppkey", F.lit(6)) != 0).alias("verified"))),
    """(SELECT *, CASE WHEN reason IN ('positive_conservative_edge', 'insufficient_net_edge') THEN e END AS net_edge_bps, reason = 'positive_conservative_edge' AS eligible FROM (SELECT *, CASE WHEN l_suppkey % 6 = 0 THEN 'forecast_calibration_unverified' WHEN g IS NULL THEN 'missing_or_invalid_estimate' WHEN l_tax * 20 - 0.1::DOUBLE < 0 THEN 'negative_estimate'
    WHEN l_suppkey % 4 = 0 THEN 'invalid_forecast_timestamp' WHEN e > 0 THEN 'positive_conservative_edge' ELSE 'insufficient_net_edge' END AS reason FROM (SELECT *, g - (l_tax * 20 - 0.1::DOUBLE) - l_tax * 50 - 0.5::DOUBLE AS e FROM (SELECT *, CASE WHEN l_partkey % 9 <> 0 THEN l_discount * 100 END AS g FROM lineitem))))""")
_P = lambda n, m: F.pmod(n, F.lit(m)) == 0


def _instruments(s, d):
    n = F.col("p_partkey")
    kind = F.element_at(F.array(*map(F.lit, ("equity", "future", "option", "perpetual"))), F.pmod(n, F.lit(4)).cast("int") + 1)
    return sources.table(s, d, "part").select("p_partkey", kind.alias("kind"), F.when(_P(n, 7), F.lit(None)).when(_P(n, 11), "soon").otherwise("2025-01-17").alias("expiry"), F.when(~_P(n, 5), 100.0).alias("contract_size"), F.when(~_P(n, 3), 10.0).alias("strike"), F.when(~_P(n, 13), "call").alias("right"))


add("cat_valid", "p_partkey kind reasons", lambda s, d: _JOINED(evidence.instrument_faults(_instruments(s, d))),
    """(SELECT p_partkey, kind, concat_ws(',', CASE WHEN kind IN ('future', 'option') AND p_partkey % 7 = 0 THEN 'expiry_required' END, CASE WHEN kind IN ('future', 'option') AND p_partkey % 7 <> 0 AND p_partkey % 11 = 0 THEN 'invalid_expiry' END, CASE WHEN kind <> 'equity' AND p_partkey % 5 = 0 THEN 'contract_size_required' END,
    CASE WHEN kind = 'option' AND (p_partkey % 3 = 0 OR p_partkey % 13 = 0) THEN 'strike_and_right_required' END) AS reasons FROM (SELECT *, ['equity', 'future', 'option', 'perpetual'][p_partkey % 4 + 1] AS kind FROM part))""")


def _evidence(s, d):
    e, n = sources.table(s, d, "events"), F.col("event_id")
    back = lambda k: F.timestamp_add("HOUR", -F.pmod(n, F.lit(k)), F.col("ts"))
    return e.select("event_id", F.when(_P(n, 40), n - 1).otherwise(n).alias("source_id"), F.col("event_type").alias("kind"), back(3).alias("observed_at"), back(2).alias("published_at"), F.col("ts").alias("available_at"), F.when(_P(n, 4), back(90)).alias("vintage_at"))


add("ev_asof", "event_id reasons", lambda s, d: _JOINED(evidence.evidence_as_of(_evidence(s, d), F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"), {"view": 86_400.0, "click": 172_800.0}, 604_800.0)),
    """(SELECT event_id, concat_ws(',', CASE WHEN count(*) OVER (PARTITION BY source_id) > 1 THEN 'duplicate_source' END, CASE WHEN ts > TIMESTAMP '2024-01-20' THEN 'future_evidence' END,
    CASE WHEN (epoch_us(TIMESTAMP '2024-01-20') - epoch_us(ts - to_hours(greatest(event_id % 3, event_id % 2, CASE WHEN event_id % 4 = 0 THEN event_id % 90 ELSE 0 END)))) / 1000000 > CASE event_type WHEN 'view' THEN 86400 WHEN 'click' THEN 172800 ELSE 604800 END THEN 'stale_evidence' END) AS reasons
    FROM (SELECT *, CASE WHEN event_id % 40 = 0 THEN event_id - 1 ELSE event_id END AS source_id FROM events))""")


def _options(s, d):
    n, x = F.col("p_partkey"), F.col("p_retailprice")
    null = lambda m, v: F.when(~_P(n, m), v)
    snaps = sources.table(s, d, "part").select(
        n.alias("symbol"), null(17, F.timestamp_add("SECOND", -(F.pmod(n, F.lit(90)) - 5), F.lit("2024-06-03 12:00:00").cast("timestamp_ntz"))).alias("t"), null(19, F.when(_P(n, 23), -1.0).otherwise(x)).alias("bp"), (x * (1 + F.pmod(n, F.lit(15)) / 100)).alias("ap"),
        null(29, F.pmod(n, F.lit(4)).cast("double")).alias("bs"), F.pmod(n, F.lit(6)).cast("double").alias("as"), null(31, F.pmod(n, F.lit(8)) / 10).alias("iv"), null(37, F.pmod(n, F.lit(24)) / 20).alias("delta"), null(41, F.when(_P(n, 43), -0.1).otherwise(0.1)).alias("gamma"),
        F.lit(-0.2).alias("theta"), F.lit(0.3).alias("vega"), null(47, F.lit(0.1)).alias("rho"),
    )
    contracts = sources.table(s, d, "part").where(~_P(n, 10)).select(
        n.alias("symbol"), F.when(_P(n, 7), "2024-05-01").when(_P(n, 9), "later").otherwise("2025-01-17").alias("expiry"), F.when(_P(n, 11), 0.0).otherwise(x).alias("strike"), F.when(_P(n, 13), 0.5).otherwise(100.0).alias("size"), F.when(_P(n, 14), "").otherwise("call").alias("type"),
        F.when(_P(n, 16), "asian").otherwise("american").alias("style"),
    )
    return evidence.option_screen(snaps, contracts, F.lit("2024-06-03 12:00:00").cast("timestamp_ntz"))


add("option_screen", "symbol passes missing reasons spread_pct:6", lambda s, d: _options(s, d).withColumns({"missing": F.concat_ws(",", "missing"), "reasons": F.concat_ws(",", "reasons")}),
    """(SELECT *, missing = '' AND reasons = '' AS passes FROM (SELECT p_partkey AS symbol, spread_pct, concat_ws(',', CASE WHEN n % 17 = 0 THEN 'quote_timestamp' END, CASE WHEN n % 19 = 0 THEN 'bid_ask' END, CASE WHEN n % 29 = 0 THEN 'displayed_sizes' END, CASE WHEN n % 37 = 0 THEN 'greek_delta' END, CASE WHEN n % 41 = 0 THEN 'greek_gamma' END, CASE WHEN n % 47 = 0 THEN 'greek_rho' END, CASE WHEN n % 31 = 0 THEN 'implied_volatility' END,
    CASE WHEN n % 10 = 0 THEN 'contract_expiration_date' END, CASE WHEN n % 10 = 0 THEN 'contract_strike_price' END, CASE WHEN n % 10 = 0 THEN 'contract_size' END, CASE WHEN n % 10 = 0 OR n % 14 = 0 THEN 'contract_type' END, CASE WHEN n % 10 = 0 THEN 'contract_style' END) AS missing,
    concat_ws(',', CASE WHEN n % 17 <> 0 AND NOT (n % 90 - 5) BETWEEN 0 AND 60 THEN 'stale_or_future_quote' END, CASE WHEN n % 19 <> 0 AND n % 23 = 0 THEN 'nonpositive_or_crossed_quote' END, CASE WHEN spread_pct > 10 THEN 'wide_spread' END, CASE WHEN n % 29 <> 0 AND least(n % 4, n % 6) < 1 THEN 'insufficient_displayed_size' END,
    CASE WHEN n % 37 <> 0 AND n % 24 > 20 THEN 'invalid_greek_delta' END, CASE WHEN n % 41 <> 0 AND n % 43 = 0 THEN 'invalid_greek_gamma' END, CASE WHEN n % 31 <> 0 AND n % 8 = 0 THEN 'invalid_implied_volatility' END, CASE WHEN n % 10 <> 0 AND n % 7 = 0 THEN 'expired_contract' END, CASE WHEN n % 10 <> 0 AND n % 7 <> 0 AND n % 9 = 0 THEN 'invalid_contract_expiration' END,
    CASE WHEN n % 10 <> 0 AND n % 11 = 0 THEN 'invalid_contract_strike' END, CASE WHEN n % 10 <> 0 AND n % 13 = 0 THEN 'invalid_contract_size' END, CASE WHEN n % 10 <> 0 AND n % 14 = 0 THEN 'invalid_contract_type' END, CASE WHEN n % 10 <> 0 AND n % 16 = 0 THEN 'invalid_contract_style' END) AS reasons
    FROM (SELECT *, p_partkey AS n, CASE WHEN p_partkey % 19 <> 0 AND p_partkey % 23 <> 0 THEN (p_retailprice * (1 + p_partkey % 15 / 100) - p_retailprice) / ((p_retailprice * (1 + p_partkey % 15 / 100) + p_retailprice) / 2) * 100 END AS spread_pct FROM part)))""")

sql.CTES |= {
    "numbered": (("f2",), "SELECT symbol, ts, return_1 AS r, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n FROM f2 WHERE return_1 IS NOT NULL"),
    "wide": (("features", "rsi"), "SELECT f.*, r.rsi_14 FROM features f JOIN rsi r USING (symbol, ts)"),
    "rich": (("wide",), """SELECT *, concat_ws('|', state_trend, state_volatility, state_acceleration, state_extension, state_volume, state_persistence) AS state FROM (SELECT *, CASE WHEN score >= 4 THEN 'up' WHEN score <= -4 THEN 'down' ELSE 'mixed' END AS state_trend,
        CASE WHEN vol_expansion_20 > 0.15 OR vol_zscore_20 > 0.5 THEN 'expanding' WHEN vol_expansion_20 < -0.15 OR vol_zscore_20 < -0.5 THEN 'compressing' ELSE 'stable' END AS state_volatility,
        CASE WHEN push > 0.002 THEN 'accelerating' WHEN push < -0.002 THEN 'decelerating' ELSE 'steady' END AS state_acceleration,
        CASE WHEN rsi_14 >= 70 OR atr_normalized_close_to_sma20 >= 1 THEN 'stretched_up' WHEN rsi_14 <= 30 OR atr_normalized_close_to_sma20 <= -1 THEN 'stretched_down' ELSE 'normal' END AS state_extension,
        CASE WHEN volume_ratio_20 >= 1.25 THEN 'expanding' WHEN volume_ratio_20 <= 0.8 THEN 'contracting' ELSE 'normal' END AS state_volume, CASE WHEN trend_persistence <= 3 THEN 'fresh' WHEN trend_persistence <= 10 THEN 'established' ELSE 'extended' END AS state_persistence
        FROM (SELECT *, coalesce(sign(return_5), 0) + coalesce(sign(return_20), 0) + coalesce(sign(return_60), 0) + coalesce(sign(ma_gap_20), 0) + coalesce(sign(ma_gap_50), 0) + coalesce(sign(ma_gap_200), 0) AS score, list_avg([return_accel_5_20, return_accel_20_60]) AS push FROM wide))"""),
    "leveled": (("states",), "SELECT symbol, ts, concat_ws('|', state_trend, state_volatility, state_momentum, state_extension) AS a, concat_ws('|', state_trend, state_volatility, state_momentum, 'any') AS b, concat_ws('|', state_trend, 'any', state_momentum, 'any') AS c FROM states"),
    "levels": (("leveled",), "SELECT level, label, count(*) AS n FROM (SELECT unnest([0, 1, 2]) AS level, unnest([a, b, c]) AS label FROM leveled WHERE ts < TIMESTAMP '1999-01-01') GROUP BY ALL"),
}

# ---- folds, parameters, costs -------------------------------------------------------------------------------------
_PARTS = "(VALUES ('train', 0, 252), ('validation', 257, 320), ('test', 325, 388)) p(part, a, b)"
sql.CTES |= {
    "sess": (("bars",), "SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS n FROM (SELECT DISTINCT ts FROM bars)"),
    "sfolds": (("sess",), f"SELECT (s // 63 + 1)::BIGINT AS fold_id, part, (SELECT ts FROM sess WHERE n = s + a) AS first_ts, (SELECT ts FROM sess WHERE n = s + b - 1) AS last_ts FROM (SELECT unnest(generate_series(0, (SELECT count(*) FROM sess) - 388, 63)) AS s) CROSS JOIN {_PARTS}"),
}


def _labels(s, d):
    end = F.lead("ts", 5).over(strategies.order())
    return _daily(s, d).select("symbol", F.col("ts").alias("signal_ts"), end.alias("label_end_ts"))


add("wf_session_folds", "fold_id part first_ts last_ts", lambda s, d: evidence.session_folds(_daily(s, d)), "sfolds", "sfolds")
add("wf_purge", "fold_id part symbol signal_ts label_end_ts", lambda s, d: evidence.purged(_labels(s, d), evidence.session_folds(_daily(s, d))),
    """(SELECT f.fold_id, f.part, l.symbol, l.signal_ts, l.label_end_ts FROM (SELECT symbol, ts AS signal_ts, lead(ts, 5) OVER (PARTITION BY symbol ORDER BY ts) AS label_end_ts FROM bars) l
    JOIN (SELECT *, lead(first_ts) OVER (PARTITION BY fold_id ORDER BY first_ts) AS boundary FROM sfolds) f ON l.signal_ts BETWEEN f.first_ts AND f.last_ts AND l.label_end_ts < f.boundary)""", "sfolds")
_SPACE = {"states.bins": [3, 5], "signals.cost_bps": [2.0, 5.0, 10.0], "signals.shorts": [True, False]}
add("cfg_grid", "bins cost_bps shorts", lambda s, d: evidence.parameter_grid(s, _SPACE, 12).select(*(F.col(f"`{k}`").alias(k.split(".")[1]) for k in _SPACE)),
    "(SELECT * FROM (SELECT unnest([3, 5]) AS bins) CROSS JOIN (SELECT unnest([2, 5, 10]::DOUBLE[]) AS cost_bps) CROSS JOIN (SELECT unnest([true, false]) AS shorts))")


def _side():
    return F.element_at(F.array(*map(F.lit, ("flat", "long", "short"))), F.pmod("l_suppkey", F.lit(3)).cast("int") + 1)


add("bt_slippage", "l_orderkey l_linenumber l_partkey entry_price:6 exit_price:6", lambda s, d: (x := sources.table(s, d, "lineitem")).select("l_orderkey", "l_linenumber", "l_partkey",
    *(evidence.slipped(F.col("l_extendedprice"), _side(), F.lit(e), F.when(F.col("l_returnflag") == "R", 10.0).otherwise(5.0)).alias(n) for e, n in ((True, "entry_price"), (False, "exit_price")))),
    """(SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice * CASE l_suppkey % 3 WHEN 1 THEN 1 + b WHEN 2 THEN 1 - b ELSE 1 END AS entry_price, l_extendedprice * CASE l_suppkey % 3 WHEN 1 THEN 1 - b WHEN 2 THEN 1 + b ELSE 1 END AS exit_price
    FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN 10 / 10000.0::DOUBLE ELSE 5 / 10000.0::DOUBLE END AS b FROM lineitem))""")
_STATS = "count(*) AS trade_count, avg((pnl > 0)::INT) AS win_rate, avg(return_pct) AS expectancy, avg(return_pct) FILTER (pnl > 0) AS average_win, avg(return_pct) FILTER (pnl < 0) AS average_loss, avg(hold_bars) AS average_hold_bars, sum(abs(entry_notional) + abs(entry_notional + pnl)) AS traded_notional"
_STAT_COLUMNS = "trade_count win_rate:8 expectancy:8 average_win:8 average_loss:8 average_hold_bars:6 traded_notional:2"
add("pm_trade_stats", f"symbol {_STAT_COLUMNS}", lambda s, d: evidence.trade_stats(sources.trades(s, d), "symbol"), f"(SELECT symbol, {_STATS} FROM trades GROUP BY symbol)", "trades")
add("pm_by_transition", f"entry_transition_setup {_STAT_COLUMNS}", lambda s, d: evidence.trade_stats(sources.setups(s, d), "entry_transition_setup"), f"(SELECT entry_transition_setup, {_STATS} FROM setups GROUP BY ALL)", "setups")
for _key in ("symbol", "fold_id", "entry_transition_setup"):
    add(f"ag_by_{_key}", f"{_key} trade_count win_rate:8 expectancy:8 average_win:8 average_loss:8 edge_classification", lambda s, d, k=_key: trades.group_summary(sources.setups(s, d), k),
        f"""(SELECT *, CASE WHEN expectancy > 0 AND v > 0 THEN 'positive' WHEN expectancy <= 0 AND v <= 0 THEN 'weak' ELSE 'mixed' END AS edge_classification FROM (SELECT {_key}, count(*) AS trade_count, avg((return_pct > 0)::INT) AS win_rate, avg(return_pct) AS expectancy,
        coalesce(avg(return_pct) FILTER (return_pct > 0), 0) AS average_win, coalesce(avg(return_pct) FILTER (return_pct <= 0), 0) AS average_loss, avg(expected_value) AS v FROM setups GROUP BY {_key}))""", "setups")


def _returns(s, d):
    r = F.col("close") / F.lag("close").over(strategies.order()) - 1
    return _daily(s, d).withColumn("r", r).where("r is not null").select("symbol", "ts", "r").withColumn("n", F.row_number().over(strategies.order()))


def _orders(s, d):
    b = _daily(s, d)
    return b.select(F.concat_ws("@", "symbol", F.date_format("ts", "yyyy-MM-dd")).alias("id"), "symbol", "ts", F.when(F.col("symbol") == "3-MEDIUM", "short").otherwise("long").alias("side"))


add("risk_corr", "id held_symbol n correlation:6 reason", lambda s, d: evidence.correlation_rejections(_orders(s, d), s.createDataFrame([("1-URGENT", "long"), ("2-HIGH", "short"), ("NONE", "long")], "symbol string, side string"), _returns(s, d), 20, 0.2),
    """(SELECT id, held_symbol, n, correlation, CASE WHEN n < 20 THEN 'insufficient_history' WHEN correlation IS NULL THEN 'undefined_correlation' WHEN correlation * CASE WHEN side = hs THEN 1 ELSE -1 END > 0.2 + 1e-12 THEN 'exposure_correlation' END AS reason FROM
    (SELECT o.id, any_value(o.side) AS side, h.symbol AS held_symbol, any_value(h.side) AS hs, count(y.r) AS n, covar_samp(x.r, y.r) / nullif(stddev_samp(CASE WHEN y.r IS NOT NULL THEN x.r END) * stddev_samp(CASE WHEN x.r IS NOT NULL THEN y.r END), 0) AS correlation FROM
    (SELECT symbol || '@' || strftime(ts, '%Y-%m-%d') AS id, symbol, ts, CASE WHEN symbol = '3-MEDIUM' THEN 'short' ELSE 'long' END AS side FROM bars) o CROSS JOIN (VALUES ('1-URGENT', 'long'), ('2-HIGH', 'short'), ('NONE', 'long')) h(symbol, side)
    LEFT JOIN numbered la ON la.symbol = o.symbol AND la.ts = o.ts LEFT JOIN numbered lb ON lb.symbol = h.symbol AND lb.ts = o.ts
    LEFT JOIN numbered x ON x.symbol = o.symbol AND x.n BETWEEN la.n - 19 AND la.n LEFT JOIN numbered y ON y.symbol = h.symbol AND y.ts = x.ts AND y.n BETWEEN lb.n - 19 AND lb.n GROUP BY o.id, h.symbol))""", "numbered")
# ---- models -------------------------------------------------------------------------------------------------------
_SPLIT = "1999-01-01"


def _all_features(s, d):
    return features.rsi(_features(s, d))


def _before(frame):
    return frame.where(F.col("ts") < F.lit(_SPLIT).cast("timestamp_ntz"))


def _after(frame):
    return frame.where(F.col("ts") >= F.lit(_SPLIT).cast("timestamp_ntz"))


add("st_rich", "symbol ts state_trend state_volatility state_acceleration state_extension state_volume state_persistence state", lambda s, d: models.rich_states(_all_features(s, d)), "rich", "rich")
add("st_rich_collapsed", "symbol ts state", lambda s, d: models.rich_states(_all_features(s, d), models.RichConfig(components=("trend", "volatility", "acceleration", "extension"), collapse_volatility=True, collapse_momentum=True, collapse_extension=True)),
    "(SELECT symbol, ts, concat_ws('|', state_trend, CASE state_volatility WHEN 'stable' THEN 'stable' ELSE 'unstable' END, CASE state_acceleration WHEN 'steady' THEN 'steady' ELSE 'active' END, CASE state_extension WHEN 'normal' THEN 'normal' ELSE 'stretched' END) AS state FROM rich)", "rich")
_SPARSE = (["state_trend", "state_volatility", "state_momentum", "state_extension"], ["state_extension", "state_volatility"])
add("st_sparse_fit", "level label n", lambda s, d: models.fit_sparse(_before(_states(s, d)), *_SPARSE), "levels", "levels")
add("st_sparse_transform", "symbol ts merged_state", lambda s, d: models.apply_sparse(_after(_states(s, d)), models.fit_sparse(_before(_states(s, d)), *_SPARSE), *_SPARSE, least=20),
    f"""(SELECT symbol, ts, coalesce(l0.label, l1.label, l2.label, 'rare_state') AS merged_state FROM leveled x LEFT JOIN levels l0 ON l0.level = 0 AND l0.label = x.a AND l0.n >= 20 LEFT JOIN levels l1 ON l1.level = 1 AND l1.label = x.b AND l1.n >= 20
    LEFT JOIN levels l2 ON l2.level = 2 AND l2.label = x.c AND l2.n >= 20 WHERE ts >= TIMESTAMP '{_SPLIT}')""", "levels")
_EDGES = {"return_5": 3, "zscore_close_20": 4}
add("st_bins_classify", "symbol ts bin_return_5 bin_zscore_close_20 state", lambda s, d: models.apply_edges(_after(_features(s, d)), models.fit_edges(_before(_features(s, d)), _EDGES), list(_EDGES)),
    f"""(SELECT *, concat_ws('|', bin_return_5, bin_zscore_close_20) AS state FROM (SELECT symbol, ts, CASE WHEN return_5 IS NULL THEN 'missing' ELSE 'b' || len(list_filter(e5, lambda e: return_5 > e)) END AS bin_return_5, CASE WHEN zscore_close_20 IS NULL THEN 'missing' ELSE 'b' || len(list_filter(ez, lambda e: zscore_close_20 > e)) END AS bin_zscore_close_20
    FROM features CROSS JOIN (SELECT list_distinct(quantile_cont(return_5, [1 / 3.0::DOUBLE, 2 / 3.0::DOUBLE])) AS e5, list_distinct(quantile_cont(zscore_close_20, [0.25, 0.5, 0.75])) AS ez FROM features WHERE ts < TIMESTAMP '{_SPLIT}') WHERE ts >= TIMESTAMP '{_SPLIT}'))""", "features")
add("st_bins_uniform", "symbol ts state", lambda s, d: models.apply_edges(_after(_features(s, d)), models.fit_edges(_before(_features(s, d)), {"volume_zscore_20": 4}, "uniform"), ["volume_zscore_20"]),
    f"(SELECT symbol, ts, CASE WHEN v IS NULL THEN 'missing' ELSE 'b' || ((v > lo + (hi - lo) * 0.25)::INT + (v > lo + (hi - lo) * 0.5)::INT + (v > lo + (hi - lo) * 0.75)::INT) END AS state FROM (SELECT *, volume_zscore_20 AS v FROM features) CROSS JOIN (SELECT min(volume_zscore_20) AS lo, max(volume_zscore_20) AS hi FROM features WHERE ts < TIMESTAMP '{_SPLIT}') WHERE ts >= TIMESTAMP '{_SPLIT}')", "features")
_MEMBERS = ["return_5", "return_20", "volume_ratio_20"]
add("st_bins_group", "symbol ts pressure:7", lambda s, d: models.apply_groups(_after(_features(s, d)), models.fit_groups(_before(_features(s, d)), _MEMBERS), _MEMBERS, "pressure"),
    f"""(SELECT symbol, ts, list_avg(list_filter([{', '.join(f'({m} - m_{m}) / s_{m}' for m in _MEMBERS)}], lambda x: x IS NOT NULL)) AS pressure FROM features CROSS JOIN (SELECT {', '.join(f'avg({m}) AS m_{m}, stddev_samp({m}) AS s_{m}' for m in _MEMBERS)} FROM features WHERE ts < TIMESTAMP '{_SPLIT}') WHERE ts >= TIMESTAMP '{_SPLIT}')""", "features")
_CLUSTER = ["return_5", "return_20", "realized_vol_20", "zscore_close_20"]
add("st_kmeans", "symbol ts cluster", lambda s, d: models.apply_clusters(_after(_features(s, d)), models.fit_clusters(_before(_features(s, d)), _CLUSTER, 4, least=30)))
add("st_kmeans_audit", "symbol rows misplaced small_clusters", lambda s, d: models.cluster_audit(_after(_features(s, d)), b := _before(_features(s, d)), models.fit_clusters(b, _CLUSTER, 4, least=30), 30),
    f"(SELECT symbol, count(*) AS rows, 0::BIGINT AS misplaced, 0::BIGINT AS small_clusters FROM features WHERE ts >= TIMESTAMP '{_SPLIT}' GROUP BY symbol)", "features")
add("st_hybrid", "symbol ts state_anchor_regime cluster state", lambda s, d: models.apply_hybrid(models.anchor(_after(_features(s, d))), models.fit_hybrid(models.anchor(_before(_features(s, d))), _CLUSTER, 3, 50, least=20)))
add("st_anchor", "symbol ts regime calm", lambda s, d: models.anchor(models.anchor(_features(s, d)).withColumnRenamed("state_anchor_regime", "regime"), "volatility").withColumnRenamed("state_anchor_regime", "calm"),
    """(SELECT symbol, ts, CASE WHEN coalesce(return_20 > 0.01 AND ma_gap_20 > 0 AND ma_gap_200 > 0, false) THEN 'uptrend' WHEN coalesce(return_20 < -0.01 AND ma_gap_20 < 0 AND ma_gap_200 < 0, false) THEN 'downtrend' ELSE 'neutral' END AS regime,
    CASE WHEN vol_expansion_20 > 0.15 OR vol_zscore_20 > 0.5 THEN 'volatile' WHEN vol_expansion_20 < -0.15 OR vol_zscore_20 < -0.5 THEN 'calm' ELSE 'stable' END AS calm FROM features)""", "features")


def _state_trades(s, d):
    return _samples(s, d).where("abs(forward_return) > 0.4").select("symbol", F.col("state").alias("entry_state"), F.col("forward_return").alias("return_pct"), (F.col("forward_return") / 2).alias("expected_value"))


_FREQ = "(SELECT symbol, state, count(*) AS observations, count(*) / sum(count(*)) OVER (PARTITION BY symbol) AS frequency FROM states WHERE state IS NOT NULL GROUP BY symbol, state)"
sql.CTES["sq"] = (("returns", "entropy", "states"), f"""SELECT r.*, f.observations AS occupancy, coalesce(e.entropy, 1) AS transition_entropy, coalesce(e.confidence, 0) AS transition_confidence, coalesce(e.concentration, 0) AS transition_concentration, r.observations < 15 AS sparse_warning
    FROM returns r LEFT JOIN {_FREQ} f USING (symbol, state) LEFT JOIN entropy e USING (symbol, state)""")
sql.CTES["st"] = (("states", "samples"), f"""SELECT f.*, coalesce(t.n, 0) AS trade_count, coalesce(t.r, 0) AS mean_trade_return, coalesce(t.v, 0) AS mean_expected_value, t.n IS NOT NULL AS trade_generating FROM {_FREQ} f
    LEFT JOIN (SELECT symbol, state, count(*) AS n, avg(forward_return) AS r, avg(forward_return / 2) AS v FROM samples WHERE abs(forward_return) > 0.4 GROUP BY ALL) t USING (symbol, state)""")
add("st_quality", "symbol state mean_return:8 observations occupancy transition_entropy:7 transition_confidence:7 transition_concentration:7 sparse_warning", lambda s, d: models.state_quality(_states(s, d)), "sq", "sq")
add("st_transition_quality", "symbol current_state next_state mean_return:8 observations transition_probability:8 transition_count", lambda s, d: models.transition_quality(_states(s, d)),
    "(SELECT s.symbol, s.state AS current_state, s.next_state, avg(forward_return) AS mean_return, count(*) AS observations, any_value(m.prob) AS transition_probability, any_value(m.count) AS transition_count FROM samples s JOIN matrix m ON m.symbol = s.symbol AND m.current_state = s.state AND m.next_state = s.next_state WHERE forward_return IS NOT NULL GROUP BY ALL)", "matrix")
add("st_tradability", "symbol state observations frequency:8 trade_count trade_generating mean_trade_return:8 mean_expected_value:8", lambda s, d: models.tradability(_states(s, d), _state_trades(s, d)), "st", "st")
add("st_full_summary", "symbol sparse_state_ratio:8 transition_stability:7 transition_concentration:7 mean_state_persistence:6 trade_generating_state_percentage:8 out_of_sample_trade_count", lambda s, d: models.full_summary(_states(s, d), _state_trades(s, d)),
    """(SELECT a.symbol, a.r AS sparse_state_ratio, b.s AS transition_stability, b.c AS transition_concentration, p.m AS mean_state_persistence, t.g AS trade_generating_state_percentage, coalesce(o.n, 0) AS out_of_sample_trade_count FROM (SELECT symbol, avg((observations < 15)::INT) AS r FROM st GROUP BY symbol) a
    LEFT JOIN (SELECT symbol, sum((1 - transition_entropy) * observations) / sum(observations) AS s, sum(transition_concentration * observations) / sum(observations) AS c FROM sq GROUP BY symbol) b USING (symbol)
    LEFT JOIN (SELECT symbol, avg(m) AS m FROM (SELECT symbol, state, avg(n) AS m FROM (SELECT symbol, state, srun, count(*) AS n FROM runs GROUP BY ALL) GROUP BY symbol, state) GROUP BY symbol) p USING (symbol)
    LEFT JOIN (SELECT symbol, avg(trade_generating::INT) AS g FROM st GROUP BY symbol) t USING (symbol) LEFT JOIN (SELECT symbol, count(*) AS n FROM samples WHERE abs(forward_return) > 0.4 GROUP BY symbol) o USING (symbol))""", "st", "sq", "runs")
add("mk_stats", "symbol state mean_return:8 median_return:8 std_return:8 positive_rate:8 observations", lambda s, d: markov.state_returns(_samples(s, d)).where("state like 'up|%'"), "(SELECT * FROM returns WHERE state LIKE 'up|%')", "returns")
add("mk_distribution", "symbol next_state prob:8", lambda s, d: markov.matrix(_samples(s, d)).where("current_state = 'up|normal|strong|normal'"), "(SELECT * FROM matrix WHERE current_state = 'up|normal|strong|normal')", "matrix")
add("cmp_score", "model_name sparsity_score:7 tradability_score:7 comparison_rank", lambda s, d: gates.comparison_scores(sources.trades(s, d).groupBy(F.concat_ws("/", "symbol", "entry_state_family").alias("model_name")).agg(F.avg("return_pct").alias("mean_return"), F.count("*").alias("trades"), F.avg("hold_bars").alias("hold")), ("trades", "hold"), {"mean_return": 0.7, "trades": 0.3}),
    """(SELECT *, row_number() OVER (ORDER BY tradability_score DESC, mean_return DESC, trades DESC, model_name) AS comparison_rank FROM (SELECT *, ((trades - min(trades) OVER ()) / (max(trades) OVER () - min(trades) OVER ()) + (hold - min(hold) OVER ()) / (max(hold) OVER () - min(hold) OVER ())) / 2 AS sparsity_score,
    (0.7 * (mean_return - min(mean_return) OVER ()) / (max(mean_return) OVER () - min(mean_return) OVER ()) + 0.3 * (trades - min(trades) OVER ()) / (max(trades) OVER () - min(trades) OVER ())) / 1.0 AS tradability_score
    FROM (SELECT symbol || '/' || entry_state_family AS model_name, avg(return_pct) AS mean_return, count(*) AS trades, avg(hold_bars) AS hold FROM trades GROUP BY ALL)))""", "trades")
_OKS = (
    "true, true, f_rank <= 1, family_bottom_exclusion_pass, state_quality_score >= 0.4, s_pct >= 0.2, s_rank <= 5, s_n >= 20, s_folds >= 3, s_pos >= 0.4, s_ev <= 0.001, s_sv <= 10, transition_quality_score >= 0.35, "
    "t_pct >= 0.15, t_rank <= 9, t_n >= 5, t_folds >= 2, t_pos >= 0.3, true, true, fold_consistency_score >= 0.3, consistency_percentile >= 0.2, consistency_rank <= 11"
)
add("sel_funnel", "asset_class gate_order gate_name candidate_count rejected_count remaining_count", lambda s, d: signals.gate_breakdown(_universe(s, d), "asset_class", gates.GATE_CHECK_ORDER),
    f"""(SELECT asset_class, k - 1 AS gate_order, {list(gates.GATE_CHECK_ORDER)}[k] AS gate_name, count(*) AS candidate_count, count(*) FILTER (NOT oks[k] AND list_bool_and(list_prepend(true, oks[1:k - 1]))) AS rejected_count, count(*) FILTER (list_bool_and(oks[1:k])) AS remaining_count
    FROM (SELECT asset_class, unnest(range(1, 24)) AS k, [{_OKS}] AS oks FROM ranked_universe) GROUP BY ALL)""", "ranked_universe")

"""Walk-forward signals, folds, ledgers, resampling and as-of lookups, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import accounts, ancestry, asof, resampling, walkforward
from ..sources import evidence, files, store
from ..sources.bars import hourly_bars, table
from ..streaming import observer
from . import sql
from .registry import _daily, _features, _states, add

_SIGNAL = "state signal expected_value:8 signal_confidence:8 liquidity_score:8 base_score:8 block_reason"


def _decided(source: str, keys: str = "") -> str:
    """The rules of the signals over bars with the statistics of their state."""
    least = "CASE WHEN dollar_volume < 1e6 THEN 0.001 * (1e6 / greatest(dollar_volume, 1) - 1) ELSE 0 END"
    a = f"""SELECT {keys} symbol, asset_class, ts, state, coalesce(realized_vol_20, 0) AS volatility, coalesce(dollar_volume_20, 0) AS dollar_volume, mean_return, predicted, coalesce(observations, 0) AS obs,
        least(greatest(coalesce(confidence, 0) * ln(1 + coalesce(observations, 0)) / ln(126), 0), 1) AS signal_confidence FROM {source}"""
    b = f"SELECT *, least(1, dollar_volume / 1e6) AS liquidity_score, 0.001 + 0.10 * greatest(volatility, 0) + {least} AS drag FROM ({a})"
    c = f"SELECT *, mean_return - drag AS long_ev, -mean_return - drag AS short_ev, signal_confidence >= 0.08 AND obs >= 25 AS ready FROM ({b})"
    d = f"SELECT *, coalesce(long_ev >= 0.001 AND ready, false) AS up, coalesce(asset_class = 'crypto' AND short_ev >= 0.001 AND ready, false) AS down FROM ({c})"
    e = f"SELECT *, CASE WHEN down AND short_ev > CASE WHEN up THEN long_ev ELSE 0 END THEN 'short' WHEN up THEN 'long' ELSE 'flat' END AS signal FROM ({d})"
    return f"""(SELECT *, CASE WHEN signal = 'flat' THEN 0 ELSE expected_value * signal_confidence * greatest(liquidity_score, 0.05) / greatest(volatility, 0.01) END AS base_score,
        CASE WHEN signal = 'flat' THEN CASE WHEN obs < 25 THEN 'insufficient_observations' WHEN signal_confidence < 0.08 THEN 'low_confidence' WHEN long_ev < 0.001 AND (asset_class <> 'crypto' OR short_ev < 0.001) THEN 'negative_expected_value' ELSE 'candidate_not_selected' END END AS block_reason
        FROM (SELECT *, CASE signal WHEN 'short' THEN short_ev WHEN 'long' THEN long_ev ELSE 0.0 END AS expected_value FROM ({e})))"""


_LABELS = """rows_ AS (SELECT *, row_number() OVER w - 1 AS n, lead(state) OVER w AS next_state, lead(close, 5) OVER w / close - 1 AS forward_return FROM states WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
"""
#: As of each bar: range joins of every bar with all that came true before it.
_AS_OF = f"""(WITH {_LABELS} asked AS (SELECT symbol, state, n FROM rows_ WHERE n >= 175),
c AS (SELECT a.symbol, a.n, b.next_state, count(*) AS c FROM asked a JOIN rows_ b ON a.symbol = b.symbol AND a.state = b.state AND b.next_state IS NOT NULL AND b.n + 1 <= a.n GROUP BY ALL),
k AS (SELECT symbol, n, count(*) FILTER (first_) OVER (PARTITION BY symbol ORDER BY n) AS k, min(state) OVER (PARTITION BY symbol ORDER BY n) AS least_ FROM (SELECT *, row_number() OVER (PARTITION BY symbol, state ORDER BY n) = 1 AS first_ FROM rows_)),
t AS (SELECT a.symbol, a.n, coalesce(-sum((a.c + 1) / t * ln((a.c + 1) / t)), 0) + any_value((k - m) / t * ln(t)) AS raw, any_value(k) AS k, coalesce(arg_max(a.next_state, row(a.c, -rank_)), any_value(least_)) AS predicted
      FROM (SELECT a.symbol, a.n, k, least_, count(c) OVER (PARTITION BY a.symbol, a.n) AS m, (coalesce(sum(c) OVER (PARTITION BY a.symbol, a.n), 0) + k)::DOUBLE AS t, c.c, c.next_state, dense_rank() OVER (ORDER BY c.next_state) AS rank_ FROM asked a JOIN k USING (symbol, n) LEFT JOIN c USING (symbol, n)) a GROUP BY a.symbol, a.n),
f AS (SELECT a.symbol, a.n, count(forward_return) AS observations, avg(forward_return) AS mean_return, stddev_samp(forward_return) AS sd_return FROM asked a LEFT JOIN rows_ b ON a.symbol = b.symbol AND a.state = b.state AND b.n + 5 <= a.n GROUP BY ALL)
SELECT r.*, observations, mean_return, sd_return, CASE WHEN k <= 1 THEN 1 ELSE greatest(1 - raw / ln(k), 0) END AS confidence, predicted FROM rows_ r JOIN t USING (symbol, n) JOIN f USING (symbol, n))"""
add("mk_as_of", "symbol ts state observations mean_return:8 sd_return:8 confidence:8 predicted", lambda s, d: walkforward.as_of_statistics(_states(s, d)).where("n >= 175"), _AS_OF, "states")
add("sg_historical", f"symbol ts {_SIGNAL} predicted", lambda s, d: walkforward.historical_signals(_states(s, d)), _decided(_AS_OF), "states")

_SPAN = (252, 63, 63, 63)
_DEALT = """tl AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS p FROM (SELECT DISTINCT ts FROM bars)),
folds AS (SELECT (s // 63 + 1)::BIGINT AS fold_id, s FROM (SELECT unnest(generate_series(0, (SELECT count(*) FROM tl) - 378, 63)) AS s)),
placed AS (SELECT * FROM {0} JOIN tl USING (ts)),
dealt AS (SELECT *, CASE WHEN p < s + 252 THEN 'train' WHEN p < s + 315 THEN 'validation' ELSE 'test' END AS part FROM placed JOIN folds ON p BETWEEN s AND s + 377),
enough AS (SELECT fold_id, symbol FROM dealt WHERE part = 'train' GROUP BY ALL HAVING count(*) >= 126),
"""
_FITTED = f"""(WITH {_DEALT.format("states")}
fits AS (SELECT fold_id, symbol, fit, state, p, close, lead(state) OVER w AS next_state, lead(close, 5) OVER w / close - 1 AS r FROM
         (SELECT *, unnest(CASE part WHEN 'train' THEN ['train', 'refit'] ELSE ['refit'] END) AS fit FROM dealt WHERE part <> 'test') WINDOW w AS (PARTITION BY fold_id, fit, symbol ORDER BY p)),
c AS (SELECT fold_id, fit, symbol, state, next_state, count(*) AS c FROM fits WHERE next_state IS NOT NULL GROUP BY ALL),
ends AS (SELECT fold_id, fit, symbol, state FROM c UNION SELECT fold_id, fit, symbol, next_state FROM c),
grid AS (SELECT a.*, b.state AS next_state, (coalesce(c, 0) + 1)::DOUBLE / sum(coalesce(c, 0) + 1) OVER (PARTITION BY fold_id, fit, symbol, a.state) AS prob FROM ends a JOIN ends b USING (fold_id, fit, symbol) LEFT JOIN c ON c.fold_id = a.fold_id AND c.fit = a.fit AND c.symbol = a.symbol AND c.state = a.state AND c.next_state = b.state),
e AS (SELECT fold_id, fit, symbol, state, CASE WHEN count(*) = 1 THEN 1 ELSE greatest(1 + sum(prob * ln(prob)) / ln(count(*)), 0) END AS confidence FROM grid GROUP BY ALL),
pr AS (SELECT fold_id, fit, symbol, state, next_state AS predicted FROM grid QUALIFY row_number() OVER (PARTITION BY fold_id, fit, symbol, state ORDER BY prob DESC, next_state) = 1),
f AS (SELECT fold_id, fit, symbol, state, count(r) AS observations, avg(r) AS mean_return FROM fits GROUP BY ALL)
SELECT d.*, f.observations, f.mean_return, e.confidence, pr.predicted FROM (SELECT *, CASE part WHEN 'test' THEN 'refit' ELSE 'train' END AS fit FROM dealt JOIN enough USING (fold_id, symbol) WHERE part <> 'train') d
LEFT JOIN f USING (fold_id, fit, symbol, state) LEFT JOIN e USING (fold_id, fit, symbol, state) LEFT JOIN pr USING (fold_id, fit, symbol, state))"""
add("wf_prepare", f"fold_id part symbol ts {_SIGNAL} predicted", lambda s, d: walkforward.prepared(_states(s, d), *_SPAN), _decided(_FITTED, "fold_id, part,"), "states")
add("wf_fold_bins", "fold_id part symbol ts bin", lambda s, d: walkforward.fold_bins(_features(s, d), "return_5", 4, *_SPAN),
    f"""(WITH {_DEALT.format("(SELECT symbol, ts, return_5 AS x FROM features)")}
    q AS (SELECT fold_id, fit, symbol, quantile_cont(x, [0.25, 0.5, 0.75]) AS q FROM (SELECT *, unnest(CASE part WHEN 'train' THEN ['train', 'refit'] ELSE ['refit'] END) AS fit FROM dealt WHERE part <> 'test') GROUP BY ALL)
    SELECT fold_id, part, symbol, ts, CASE WHEN x IS NULL THEN 'missing' ELSE 'b' || len(list_filter(q, lambda v: v < x)) END AS bin FROM dealt JOIN enough USING (fold_id, symbol) JOIN q USING (fold_id, symbol) WHERE (part, fit) IN (('validation', 'train'), ('test', 'refit')))""", "features")

# -- ledgers -------------------------------------------------------------------------------------------------------

_ID = "{0} || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || round(l_extendedprice * 100)::BIGINT"
sql.CTES["instruments"] = ((), "SELECT 'S' || s_suppkey AS symbol, CASE WHEN s_nationkey % 2 = 0 THEN '1' ELSE '100' END AS multiplier FROM supplier WHERE s_acctbal >= 0")
sql.CTES["activities"] = ((), f"""SELECT {_ID.format("'F'")} AS id, l_shipdate AS ts, 'FILL' AS activity_type, 'S' || l_suppkey AS symbol, CASE WHEN l_linenumber % 2 = 0 THEN 'sell' ELSE 'buy' END AS side, l_quantity::DECIMAL(15, 2) AS qty,
    l_extendedprice::DECIMAL(15, 2) AS price, (l_tax * 10)::DECIMAL(15, 2) AS fee, NULL::DECIMAL(15, 2) AS net_amount, NULL::DECIMAL(15, 2) AS quantity_delta FROM lineitem
    UNION ALL SELECT 'C' || o_orderkey, o_orderdate, kind, CASE WHEN kind = 'POSITION_ADJUSTMENT' THEN 'S' || (o_custkey % 10) END, NULL, NULL, NULL, NULL, CASE WHEN kind <> 'POSITION_ADJUSTMENT' THEN (CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END)::DECIMAL(15, 2) END,
    CASE WHEN kind = 'POSITION_ADJUSTMENT' THEN o_custkey::DECIMAL(15, 2) END FROM (SELECT *, CASE o_orderpriority WHEN '1-URGENT' THEN 'CSD' WHEN '2-HIGH' THEN 'CSW' WHEN '3-MEDIUM' THEN 'DIV' WHEN '4-NOT SPECIFIED' THEN 'FEE' ELSE CASE WHEN o_orderstatus = 'P' THEN 'POSITION_ADJUSTMENT' ELSE 'JNL' END END AS kind FROM orders)""")
sql.CTES["normalized"] = (("activities", "instruments"), """SELECT id, ts, kind, symbol, CASE WHEN faults <> '' THEN 0 WHEN kind = 'FILL' THEN q WHEN kind = 'POSITION_ADJUSTMENT' THEN quantity_delta ELSE 0 END AS quantity,
    CASE WHEN faults <> '' THEN 0 WHEN kind = 'FILL' THEN -q * price * multiplier::DECIMAL(6, 0) - fee ELSE coalesce(net_amount, 0) END AS cash, CASE WHEN faults = '' AND kind IN ('CSD', 'CSW') THEN net_amount ELSE 0 END AS external_cashflow,
    CASE WHEN faults <> '' THEN 0 WHEN kind = 'FILL' THEN fee WHEN kind = 'FEE' THEN -net_amount ELSE 0 END AS fee, faults FROM (SELECT *, activity_type AS kind, CASE side WHEN 'buy' THEN qty ELSE -qty END AS q, array_to_string(list_filter([
    CASE WHEN activity_type = 'JNL' THEN 'unsupported_type' END, CASE WHEN activity_type = 'FILL' AND multiplier IS NULL THEN 'multiplier_missing' END, CASE WHEN activity_type = 'FILL' AND multiplier IS NOT NULL AND (qty <= 0 OR price < 0) THEN 'invalid_fill' END,
    CASE WHEN activity_type = 'CSD' AND net_amount <= 0 OR activity_type = 'CSW' AND net_amount >= 0 OR activity_type = 'FEE' AND net_amount > 0 THEN 'sign_contradiction' END], lambda x: x IS NOT NULL), ',') AS faults FROM activities LEFT JOIN instruments USING (symbol))""")


def _normalized(s, d):
    return accounts.normalized(evidence.activities(s, d), evidence.instruments(s, d))


add("lg_normalize", "id ts kind symbol quantity:4 cash:4 external_cashflow:4 fee:4 faults", _normalized, "normalized", "normalized")

#: Imports: name, years, whether faulty rows are in, what is added to the fee of sales.
_IMPORTS = (("a", 1995, 1996, False, 0), ("b", 1996, 1997, False, 0), ("c", 1997, 1998, False, 1), ("d", 1998, 1999, True, 0), ("e", 1998, 1999, False, 0), ("f", 1995, 1999, False, 0))


def _imports(s, d):
    fills = accounts.Ledger.placed(_normalized(s, d).where("kind = 'FILL'"), "fills")
    ledger = accounts.Ledger(s, store.fresh_path(s, "ledger"), fills.schema)
    made = []
    for name, lo, hi, faulty, more in _IMPORTS:
        rows = fills.where(F.year("ts").between(lo, hi))
        rows = rows if faulty else rows.where("faults = ''")
        rows = rows.withColumn("fee", F.when(F.col("quantity") < 0, F.col("fee") + more).otherwise(F.col("fee")).cast(accounts.MONEY))
        made.append(tuple(ledger.load(name, rows).values()))
    out = s.createDataFrame(made, "batch string, rows long, new_events long, conflicts long, faulty long, accepted boolean")
    held = ledger.events().agg(F.count("*").alias("held"), F.sum("cash").alias("cash"))
    return out.crossJoin(held)  # one row


def _imports_sql() -> str:
    parts, old = [], "(SELECT id, cash, fee, quantity FROM normalized WHERE false)"
    for name, lo, hi, faulty, more in _IMPORTS:
        parts.append(f"""b_{name} AS (SELECT id, quantity, cash, CASE WHEN quantity < 0 THEN fee + {more} ELSE fee END AS fee, faults FROM normalized WHERE kind = 'FILL' AND year(ts) BETWEEN {lo} AND {hi} {"" if faulty else "AND faults = ''"}),
        r_{name} AS (SELECT '{name}' AS batch, count(*) AS rows, count(*) FILTER (o.id IS NULL) AS fresh, count(*) FILTER (o.fee <> b.fee OR o.cash <> b.cash) AS conflicts, count(*) FILTER (faults <> '') AS faulty FROM b_{name} b LEFT JOIN {old} o USING (id)),
        l_{name} AS (SELECT id, cash, fee, quantity FROM {old} UNION ALL SELECT id, cash, fee, quantity FROM b_{name} WHERE (SELECT conflicts + faulty FROM r_{name}) = 0 AND id NOT IN (SELECT id FROM {old}))""")
        old = f"l_{name}"
    rows = " UNION ALL ".join(f"SELECT * FROM r_{name}" for name, *_ in _IMPORTS)
    return f"(WITH {', '.join(parts)} SELECT batch, rows, CASE WHEN conflicts + faulty = 0 THEN fresh ELSE 0 END AS new_events, conflicts, faulty, conflicts + faulty = 0 AS accepted, (SELECT count(*) FROM {old}) AS held, (SELECT sum(cash) FROM {old}) AS cash FROM ({rows}))"


add("lg_import", "batch rows new_events conflicts faulty accepted held cash:2", _imports, _imports_sql(), "normalized")

_OPENS, _ENDS = "1997-01-01", "1999-07-01"


def _reconciled(s, d):
    """From the valid events between two dates; the snapshots are of all activities, rejected ones too."""
    events, raw = _normalized(s, d), evidence.activities(s, d)
    q = F.col("qty").cast("decimal(15,6)") * F.when(F.col("side") == "buy", 1).otherwise(-1)
    pay = F.coalesce((-q * F.col("price").cast("decimal(14,6)")).cast(accounts.MONEY) * 1 - F.col("fee").cast("decimal(14,6)"), F.col("net_amount").cast("decimal(20,6)"))
    moves = raw.select("ts", F.explode(F.array(F.struct(F.lit(None).cast("string").alias("item"), pay.cast(accounts.MONEY).alias("amount")), F.struct(F.col("symbol").alias("item"), F.coalesce(q, F.col("quantity_delta").cast("decimal(15,6)")).cast(accounts.MONEY).alias("amount")))).alias("x")).select("ts", "x.*").where("amount is not null")
    snapshot = lambda t: moves.where(F.col("ts") <= F.lit(t).cast("timestamp_ntz")).groupBy("item").agg(F.sum("amount").alias("amount"))
    return accounts.reconciled(events.where(F.col("ts").between(F.lit(_OPENS).cast("timestamp_ntz") + F.expr("interval 1 microsecond"), F.lit(_ENDS).cast("timestamp_ntz"))), snapshot(_OPENS), snapshot(_ENDS))


_SNAP = "(SELECT item, sum(amount) AS amount FROM moves WHERE ts <= TIMESTAMP '{0}' GROUP BY item)"
add("lg_reconcile_cash", "item opening:2 moved:2 ending:2 difference:2", _reconciled,
    f"""(WITH q AS (SELECT *, CASE side WHEN 'buy' THEN qty ELSE -qty END AS q FROM activities), moves AS (SELECT ts, 'cash' AS item, coalesce(-q * price - fee, net_amount) AS amount FROM q WHERE coalesce(q, net_amount) IS NOT NULL UNION ALL SELECT ts, symbol, coalesce(q, quantity_delta) FROM q WHERE coalesce(q, quantity_delta) IS NOT NULL),
    ev AS (SELECT * FROM normalized WHERE ts > TIMESTAMP '{_OPENS}' AND ts <= TIMESTAMP '{_ENDS}'), m AS (SELECT 'cash' AS item, sum(cash) AS amount FROM ev UNION ALL SELECT symbol, sum(quantity) FROM ev WHERE symbol IS NOT NULL GROUP BY symbol),
    i AS (SELECT item FROM m UNION SELECT item FROM moves WHERE ts <= TIMESTAMP '{_ENDS}')
    SELECT item, coalesce(o.amount, 0) AS opening, coalesce(m.amount, 0) AS moved, coalesce(e.amount, 0) AS ending, coalesce(o.amount, 0) + coalesce(m.amount, 0) - coalesce(e.amount, 0) AS difference
    FROM i LEFT JOIN {_SNAP.format(_OPENS)} o USING (item) LEFT JOIN m USING (item) LEFT JOIN {_SNAP.format(_ENDS)} e USING (item))""", "normalized")

_LOTS = f"""(WITH f AS (SELECT 1 AS late, a.symbol, id, ts, CASE side WHEN 'buy' THEN qty ELSE -qty END AS q, price, fee, multiplier::INT AS multiplier FROM activities a JOIN instruments USING (symbol) WHERE activity_type = 'FILL' AND qty >= 1
     UNION ALL SELECT 0, i.symbol, 'O' || s_suppkey, TIMESTAMP '1990-01-01', s_nationkey - 12, 1000, 1.5, multiplier::INT FROM supplier JOIN instruments i ON i.symbol = 'S' || s_suppkey WHERE s_nationkey <> 12),
p AS (SELECT *, sum(q) OVER (PARTITION BY symbol ORDER BY late, ts, id ROWS UNBOUNDED PRECEDING) - q AS pos FROM f),
c AS (SELECT *, CASE WHEN sign(pos) * sign(q) < 0 THEN least(abs(pos), abs(q)) ELSE 0 END AS closes FROM p),
x AS (SELECT symbol, late, ts, id, q, price, fee, multiplier, 'close' AS role, closes AS units, sign(pos) AS dir FROM c WHERE closes > 0 UNION ALL SELECT symbol, late, ts, id, q, price, fee, multiplier, 'open', abs(q) - closes, sign(q) FROM c WHERE abs(q) > closes),
r AS (SELECT *, sum(units) OVER w AS hi, sum(units) OVER w - units AS lo FROM x WINDOW w AS (PARTITION BY symbol, dir, role ORDER BY late, ts, id ROWS UNBOUNDED PRECEDING)),
m AS (SELECT o.symbol, o.dir, o.id AS open_id, k.id AS close_id, least(o.hi, k.hi) - greatest(o.lo, k.lo) AS n, o.price AS op, k.price AS cp, o.multiplier, o.fee AS ofee, abs(o.q) AS oq, k.fee AS kfee, abs(k.q) AS kq FROM r o JOIN r k ON o.role = 'open' AND k.role = 'close' AND o.symbol = k.symbol AND o.dir = k.dir AND o.lo < k.hi AND k.lo < o.hi)
SELECT symbol, dir::INT AS direction, open_id, close_id, n AS quantity, dir * n * (cp - op) * multiplier AS gross, ((ofee * n)::DOUBLE / oq)::DECIMAL(38, 12) + ((kfee * n)::DOUBLE / kq)::DECIMAL(38, 12) AS fees FROM m
UNION ALL SELECT symbol, dir::INT, id, NULL, units - coalesce(n, 0), NULL, ((fee * (units - coalesce(n, 0)))::DOUBLE / abs(q))::DECIMAL(38, 12) FROM r LEFT JOIN (SELECT open_id AS id, dir, sum(n) AS n FROM m GROUP BY ALL) USING (id, dir) WHERE role = 'open' AND units > coalesce(n, 0))"""
add("lg_fifo_signed", "symbol direction open_id close_id quantity:4 gross:4 fees:12", lambda s, d: accounts.signed_lots(evidence.signed_fills(s, d), evidence.opening_lots(s, d)), _LOTS, "activities", "instruments")

_MARKS = """(WITH f AS (SELECT *, close * 100 + flows AS equity FROM (SELECT *, sum(volume) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS flows FROM hours)),
e AS (SELECT symbol, session, arg_max(equity, ts) AS le, arg_max(flows, ts) AS lf, min(flows) AS ff FROM f GROUP BY ALL), g AS (SELECT symbol, session, lag(le) OVER w + ff - lag(lf) OVER w AS prior_close, row_number() OVER w AS nth FROM e WINDOW w AS (PARTITION BY symbol ORDER BY session)),
b AS (SELECT *, CASE WHEN nth = 1 THEN first_value(equity) OVER w ELSE prior_close END + flows - first_value(flows) OVER w AS daily_baseline, max(equity - flows) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) + flows AS high_water FROM f JOIN g USING (symbol, session) WINDOW w AS (PARTITION BY symbol, session ORDER BY ts)),
h AS (SELECT *, max((equity <= daily_baseline * 0.995::DOUBLE)::INT) OVER (PARTITION BY symbol, session ORDER BY ts ROWS UNBOUNDED PRECEDING) = 1 AS daily_halt, max((equity <= high_water * 0.97::DOUBLE)::INT) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) = 1 AS drawdown_halt FROM b)
SELECT symbol AS account, ts, equity, high_water, daily_baseline, daily_halt, drawdown_halt, CASE WHEN drawdown_halt THEN 'drawdown_halt' WHEN daily_halt THEN 'daily_halt' ELSE 'allowed' END AS reason FROM h)"""
add("sz_halts", "account ts equity:4 high_water:4 daily_baseline:4 daily_halt drawdown_halt reason", lambda s, d: accounts.halts(evidence.marks(s, d)), _MARKS, "hours")

_HASH = "sha256(strftime(event_at, '%Y-%m-%d %H:%M:%S') || '|' || strftime(received_at, '%Y-%m-%d %H:%M:%S') || '|' || {0})"
_DECISIONS = f"""(WITH RECURSIVE o AS (SELECT *, CASE WHEN o_totalprice < 5000 THEN lead(o_orderkey) OVER w WHEN o_totalprice < 8000 THEN o_orderkey + 1000000000000 WHEN o_orderstatus <> 'O' THEN lag(o_orderkey) OVER w END AS amends FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
l0 AS (SELECT l.*, l_partkey || '/' || l_suppkey AS payload, coalesce(o_orderdate, TIMESTAMP '1995-01-01') - to_days(trunc(l_quantity)::INT) AS event_at FROM lineitem l LEFT JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity >= 0),
l1 AS (SELECT *, event_at + to_days(l_linenumber::INT) AS received_at FROM l0), l AS (SELECT *, {_HASH.format("payload")} AS sha FROM l1),
i AS (SELECT l_orderkey AS id, sha, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ordinal FROM l),
ev AS (SELECT sha, min(event_at) AS event_at, max(received_at) AS received_at, min(({_HASH.format("payload")} = sha)::INT) AS ok FROM (SELECT DISTINCT sha, event_at, received_at, CASE WHEN l_tax > 0.075 THEN payload || 'x' ELSE payload END AS payload FROM l WHERE NOT (l_tax = 0 AND l_discount = 0)) GROUP BY sha),
u AS (SELECT id, string_agg(sha, ',' ORDER BY ordinal) AS ins, count(*) FILTER (ok IS NULL) AS lost, count(*) FILTER (ok = 0) AS forged, count(*) FILTER (event_at > received_at) AS odd, max(received_at) AS latest FROM i LEFT JOIN ev USING (sha) GROUP BY id),
h AS (SELECT o.*, sha256(o_orderkey || '|' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '|' || coalesce(amends::VARCHAR, '-') || '|' || coalesce(ins, '')) AS sha FROM o LEFT JOIN u ON u.id = o_orderkey),
d AS (SELECT coalesce(o_orderkey, u.id) AS id, o_orderkey IS NOT NULL AS there, h.amends, o_orderdate, u.*, o_totalprice > 490000 AND reverse(sha) <> sha AS tampered, p.pd, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + to_days(((o_custkey % 40) - 1)::INT) END AS observed
      FROM h FULL JOIN u ON u.id = o_orderkey LEFT JOIN (SELECT o_orderkey AS pk, o_orderdate AS pd FROM orders) p ON p.pk = h.amends),
f AS (SELECT d.*, list_filter([CASE WHEN NOT there THEN 'orphan_input' END, CASE WHEN there AND ins IS NULL THEN 'no_input' END, CASE WHEN there AND lost > 0 THEN 'missing_evidence' END, CASE WHEN forged > 0 THEN 'evidence_hash' END, CASE WHEN there AND (odd > 0 OR latest > o_orderdate) THEN 'noncausal_evidence' END,
      CASE WHEN tampered THEN 'decision_hash' END, CASE WHEN amends IS NOT NULL AND pd IS NULL THEN 'missing_parent' END, CASE WHEN pd > o_orderdate THEN 'noncausal_parent' END, CASE WHEN observed < o_orderdate THEN 'link_precedes_decision' END], lambda x: x IS NOT NULL) AS faults FROM d),
e AS (SELECT f.id, f.amends AS up FROM f JOIN o ON o_orderkey = f.amends WHERE there), reach AS (SELECT id, up FROM e UNION SELECT reach.id, e.up FROM reach JOIN e ON e.id = reach.up),
a AS (SELECT r.id, count(*) AS depth, max((len(g.faults) > 0)::INT) AS above, count(*) FILTER (r.up NOT IN (SELECT id FROM e)) = 0 AS cyclic, min(r.up) FILTER (r.up NOT IN (SELECT id FROM e)) AS root FROM reach r JOIN f g ON g.id = r.up GROUP BY r.id)
SELECT f.id, CASE WHEN NOT there OR cyclic THEN NULL ELSE coalesce(root, f.id) END AS root, CASE WHEN NOT there OR cyclic THEN NULL ELSE coalesce(a.depth, 0) END AS depth, array_to_string(CASE WHEN coalesce(cyclic, false) THEN list_append(faults, 'cyclic_amendment') ELSE faults END, ',') AS faults,
CASE WHEN there THEN NOT (coalesce(above, 0) = 1 OR coalesce(cyclic, false)) END AS ancestors_sound FROM f LEFT JOIN a USING (id))"""
add("lg_decisions", "id root depth faults ancestors_sound", lambda s, d: ancestry.audited(**evidence.decision_ledger(s, d)), _DECISIONS)

# -- as-of lookups -------------------------------------------------------------------------------------------------

add("bt_excursion", "trade_id bars_held mae_pct:8 mfe_pct:8 censored", lambda s, d: asof.excursions(evidence.positions(s, d), _daily(s, d)),
    f"""(WITH p AS (SELECT {_ID.format("'F'")} AS trade_id, o_orderpriority AS symbol, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS direction, o_orderdate AS entry_ts, o_orderdate + to_days(3 * trunc(l_quantity)::INT) AS exit_ts, o_totalprice AS entry, CASE WHEN l_discount > 0.085 THEN o_totalprice * 0.9::DOUBLE END AS stop FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity >= 1),
    x AS (SELECT p.*, b.ts, CASE WHEN ts = exit_ts AND stop IS NOT NULL THEN greatest(open, stop) ELSE high END AS hi, CASE WHEN ts = exit_ts AND stop IS NOT NULL THEN least(open, stop) ELSE low END AS lo FROM p LEFT JOIN bars b ON b.symbol = p.symbol AND ts > entry_ts AND ts <= exit_ts)
    SELECT trade_id, count(ts) AS bars_held, least(0, CASE WHEN any_value(direction) > 0 THEN (min(lo) - any_value(entry)) / any_value(entry) ELSE (any_value(entry) - max(hi)) / any_value(entry) END) AS mae_pct,
    greatest(0, CASE WHEN any_value(direction) > 0 THEN (max(hi) - any_value(entry)) / any_value(entry) ELSE (any_value(entry) - min(lo)) / any_value(entry) END) AS mfe_pct, any_value(stop) IS NOT NULL AS censored FROM x GROUP BY trade_id)""", "bars")
add("opt_latest_quote", "symbol ts quote_event_at quote_received_at quote_event_id quote_bid:6", lambda s, d: asof.latest_known(hourly_bars(s, d).select("symbol", "ts"), evidence.two_clock_quotes(s, d), "symbol", "ts", "event_at", "received_at", ["event_id", "bid"]),
    """(WITH q AS (SELECT event_type AS symbol, ts - to_hours((user_id % 13)::INT) AS event_at, ts AS received_at, event_id, value AS bid FROM events)
    SELECT h.symbol, h.ts, x.r.event_at AS quote_event_at, x.r.received_at AS quote_received_at, x.r.event_id AS quote_event_id, x.r.bid AS quote_bid FROM hours h LEFT JOIN (SELECT symbol, ts, max(q) AS r FROM
    (SELECT h.symbol, h.ts, {'event_at': q.event_at, 'received_at': q.received_at, 'event_id': q.event_id, 'bid': q.bid} AS q FROM hours h JOIN q ON h.symbol = q.symbol AND q.received_at <= h.ts) GROUP BY ALL) x USING (symbol, ts))""", "hours")
add("opt_select", "decision_id underlying day contract expires strike:4",
    lambda s, d: asof.select_contracts(evidence.option_decisions(s, d), evidence.option_chain(s, d)).withColumns({"day": F.col("session").cast("timestamp_ntz"), "expires": F.col("expiry").cast("timestamp_ntz")}),
    """(WITH c AS (SELECT p_brand AS underlying, 'P' || p_partkey AS contract, DATE '1995-01-15' + (p_size * 45)::INT AS expiry, round(p_retailprice / 5) AS strike FROM part),
    d AS (SELECT o_orderkey AS decision_id, 'Brand#' || (o_custkey % 25 + 1) AS underlying, o_orderdate::DATE AS session, 180 + (o_custkey % 40) / 2::DOUBLE AS midpoint FROM orders),
    x AS (SELECT decision_id, contract, expiry, strike, row_number() OVER (PARTITION BY decision_id ORDER BY abs(expiry - session - 52), expiry, abs(strike - midpoint), strike, contract) AS k FROM d JOIN c USING (underlying) WHERE expiry > session AND session BETWEEN expiry - 400 AND expiry - 1)
    SELECT d.decision_id, underlying, session::TIMESTAMP AS day, contract, expiry::TIMESTAMP AS expires, strike FROM d LEFT JOIN (SELECT * FROM x WHERE k = 1) USING (decision_id))""")
sql.CTES["actions"] = ((), "SELECT o_orderpriority AS symbol, o_orderdate AS ts, CASE WHEN count(*) > 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS split_ratio, round(sum(o_totalprice) / 1000, 2) AS dividend FROM orders WHERE o_orderstatus = 'P' GROUP BY ALL")
add("tr_index", "symbol ts close:4 log_index:6", lambda s, d: asof.total_return(_daily(s, d), evidence.corporate_actions(s, d)),
    """(SELECT symbol, ts, close, ln(first_value(close) OVER w) + sum(coalesce(ln(coalesce(split_ratio, 1) * (close + coalesce(dividend, 0)) / before), 0)) OVER w AS log_index FROM
    (SELECT b.*, a.split_ratio, a.dividend, lag(close) OVER (PARTITION BY b.symbol ORDER BY b.ts) AS before FROM bars b LEFT JOIN actions a USING (symbol, ts)) WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING))""", "bars", "actions")
add("adj_discontinuity", "symbol ts implied:4", lambda s, d: asof.discontinuities(evidence.adjusted_bars(s, d), evidence.corporate_actions(s, d).where("dividend > 100")),
    """(SELECT symbol, ts, implied FROM (SELECT symbol, ts, lag(close * scale) OVER w * (1 - scale / lag(scale) OVER w) AS implied FROM (SELECT b.symbol, b.ts, close, 1 / (1 + count(dividend) OVER (PARTITION BY b.symbol ORDER BY b.ts ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) / 1000::DOUBLE) AS scale FROM bars b LEFT JOIN actions a USING (symbol, ts)) WINDOW w AS (PARTITION BY symbol ORDER BY ts))
    WHERE abs(implied) > 0.01 AND (symbol, ts) NOT IN (SELECT (symbol, ts) FROM actions WHERE dividend > 100))""", "bars", "actions")

# -- the stationary bootstrap --------------------------------------------------------------------------------------


def _bootstrap_sql(symbols: tuple[str, ...], resamples: int) -> str:
    col = {c: f'"{c}"' for c in symbols}
    m = "SELECT symbol, date_trunc('month', ts) AS month, arg_max(close, ts) AS close FROM bars GROUP BY ALL"
    r = f"SELECT symbol, month, close / lag(close) OVER (PARTITION BY symbol ORDER BY month) - 1 AS r FROM ({m})"
    wide = f"SELECT month, {', '.join(f'''max(r) FILTER (WHERE symbol = '{c}') AS {col[c]}''' for c in symbols)} FROM ({r}) GROUP BY month HAVING {' AND '.join(f'''count(r) FILTER (WHERE symbol = '{c}') > 0''' for c in symbols)}"
    parts = [f"s AS (SELECT row_number() OVER (ORDER BY month) AS pos, {', '.join(f'sum({q}) OVER (ORDER BY month ROWS UNBOUNDED PRECEDING) AS {q}' for q in col.values())} FROM ({wide}) UNION ALL SELECT 0, {', '.join('0' for _ in symbols)}), n AS (SELECT max(pos) AS n FROM s)"]
    done = []
    for length in resampling.BLOCKS:
        grid = f"(SELECT r, unnest(range(most)) AS j, most, n FROM range({resamples}) t(r) CROSS JOIN (SELECT n, least(n, floor(n / {length}::DOUBLE + 6 * sqrt(n / {length}::DOUBLE) + 8)::BIGINT) AS most FROM n))"
        b = f"(SELECT *, ('0x' || substr(h, 1, 8))::BIGINT / {2**32}::DOUBLE AS u, ('0x' || substr(h, 9, 8))::BIGINT / {2**32}::DOUBLE AS v FROM (SELECT *, md5({resampling.SEED} || ':{length}:' || r || ':' || j) AS h FROM {grid}))"
        b = f"SELECT r, j, most, n, (floor(ln(1 - u) / ln({1 - 1 / length}::DOUBLE)) + 1)::BIGINT AS size, floor(v * n)::BIGINT AS begin_ FROM {b}"
        b = f"SELECT *, coalesce(sum(size) OVER (PARTITION BY r ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS done FROM ({b})"
        b = f"SELECT r, n, begin_, begin_ + CASE WHEN j = most - 1 THEN n - done ELSE least(size, n - done) END AS fin FROM ({b}) WHERE done < n"
        sums = ", ".join(f"sum((e.{q} - a.{q} + (fin // n) * z.{q}) / n) AS {q}" for q in col.values())
        parts.append(f"m{length} AS (SELECT r, {sums} FROM ({b}) b JOIN s a ON a.pos = b.begin_ JOIN s e ON e.pos = b.fin % b.n JOIN s z ON z.pos = b.n GROUP BY r)")
        done += [f"SELECT {length} AS block_length, '{c}' AS series, (SELECT n FROM n) AS sessions, quantile_cont({q}, {resampling.ALPHA}::DOUBLE) AS lower, median({q}) AS centre FROM m{length}" for c, q in col.items()]
    return f"(WITH {', '.join(parts)} {' UNION ALL '.join(done)})"


def _bootstrapped(s, d):
    months, names = evidence.monthly_returns(s, d)
    return resampling.stationary_bounds(months, names, "month")


_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
add("boot_stationary", "block_length series sessions lower:8 centre:8", _bootstrapped, _bootstrap_sql(_PRIORITIES, resampling.RESAMPLES), "bars")

# -- observations of a market scan ---------------------------------------------------------------------------------

_TTL = 6 * 3600
sql.CTES["scans"] = ((), """SELECT event_type || '/' || (user_id % 20) AS symbol, CASE event_type WHEN 'click' THEN 'crypto' WHEN 'error' THEN 'futures' ELSE 'us_equity' END AS kind, ts AS scan_at, CASE WHEN event_id % 31 <> 0 THEN hour(ts) BETWEEN 9 AND 15 END AS market_open,
    event_id % 29 = 0 AS failed, event_id % 17 <> 0 AS answered, value AS v, CASE WHEN event_id % 37 = 0 THEN -10 ELSE 5 * k END AS age, user_id * 10.0::DOUBLE - 10 AS volume, value * 0.999::DOUBLE AS bid, value * (1 + (k - 15) / 10000::DOUBLE) AS ask, 4 * k AS quote_age
    FROM (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events)""")
sql.CTES["judged_scans"] = (("scans",), f"""SELECT symbol, scan_at, good, state, CASE WHEN failed THEN 'batch_failed' WHEN state = 'missing' THEN 'symbol_missing_from_response' WHEN state = 'invalid' THEN 'invalid_price_timestamp_bar_or_quote' WHEN state = 'unavailable' THEN 'market_clock_unavailable'
    WHEN state = 'indicative_unknown_latency' THEN '{observer.PROXY}' END AS reason, CASE WHEN good THEN {{'price': v, 'data_asof': scan_at - to_seconds(age), 'change_pct': (v / CASE WHEN age <= 86400 AND v * 0.98::DOUBLE > 0 THEN v * 0.98::DOUBLE END - 1) * 100, 'volume': volume,
    'spread_bps': CASE WHEN quote_age <= CASE kind WHEN 'crypto' THEN 180 ELSE 300 END THEN (ask - bid) / ((ask + bid) / 2) * 10000 END}} END AS x FROM (SELECT *, NOT failed AND answered AND fine AS good, CASE WHEN failed THEN 'unavailable' WHEN NOT answered THEN 'missing' WHEN NOT fine THEN 'invalid'
    WHEN kind = 'futures' THEN CASE WHEN age <= 1800 THEN 'indicative_unknown_latency' ELSE 'stale' END WHEN kind = 'us_equity' AND NOT market_open THEN 'closed_last_observation' WHEN kind = 'us_equity' AND market_open IS NULL THEN 'unavailable'
    WHEN age <= CASE kind WHEN 'crypto' THEN 180 ELSE 300 END THEN 'fresh' ELSE 'stale' END AS state FROM (SELECT *, coalesce(v > 0 AND age >= 0 AND volume >= 0 AND bid > 0 AND ask >= bid, false) AS fine FROM scans))""")
sql.CTES["observed"] = (("judged_scans",), f"""SELECT *, last_value(x IGNORE NULLS) OVER o AS kept, sum(new) OVER o AS observation_count, row_number() OVER o AS scan_count, first_value(scan_at) OVER o AS first_seen, last_value(CASE WHEN good THEN scan_at END IGNORE NULLS) OVER o AS last_seen FROM
    (SELECT *, (good AND NOT coalesce(was.data_asof = x.data_asof AND was.price = x.price AND was.volume = x.volume, false))::INT AS new FROM (SELECT *, last_value(x IGNORE NULLS) OVER (PARTITION BY symbol, run ORDER BY scan_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM
    (SELECT *, sum(gap) OVER (PARTITION BY symbol ORDER BY scan_at) AS run FROM (SELECT *, coalesce(epoch_us(scan_at) - epoch_us(lag(scan_at) OVER (PARTITION BY symbol ORDER BY scan_at)) > {_TTL}000000, false)::INT AS gap FROM judged_scans))))
    WINDOW o AS (PARTITION BY symbol, run ORDER BY scan_at ROWS UNBOUNDED PRECEDING)""")
_SEEN = "symbol scanned state reason price:6 data_time change_pct:6 volume:2 spread_bps:4 retained observation_count scan_count first_scan last_good"
_SEEN_SQL = "SELECT symbol, scan_at AS scanned, state, reason, kept.price AS price, kept.data_asof AS data_time, kept.change_pct AS change_pct, kept.volume AS volume, kept.spread_bps AS spread_bps, NOT good AND kept IS NOT NULL AS retained, observation_count::BIGINT AS observation_count, scan_count::BIGINT AS scan_count, first_seen AS first_scan, last_seen AS last_good, run FROM observed"


def _plain_times(df):
    return df.withColumns({new: F.col(old).cast("timestamp_ntz") for new, old in (("scanned", "scan_at"), ("data_time", "data_asof"), ("first_scan", "first_seen"), ("last_good", "last_seen"))})


def _resumed(s, d):
    """The later scans, from a table of what was last known of each symbol before them."""
    judged = store.stored(observer.judged(evidence.scans(s, d)), "judged")
    cut = judged.agg(F.expr("timestamp_micros(cast(avg(unix_micros(scan_at)) as bigint))")).first()[0]
    early, late = (judged.where(F.col("scan_at") < F.lit(cut)), judged.where(F.col("scan_at") >= F.lit(cut)))
    known = observer.history(early, _TTL)
    last = known.groupBy("symbol").agg(F.max_by(F.struct(*(c for c in known.columns if c != "symbol")), "scan_at").alias("r")).select("symbol", "r.*")
    return _plain_times(observer.history(late, _TTL, last))


add("ss_observe", _SEEN, lambda s, d: _plain_times(observer.history(observer.judged(evidence.scans(s, d)), _TTL)), f"({_SEEN_SQL})", "observed")
add("ss_restore", _SEEN, _resumed, f"({_SEEN_SQL} WHERE epoch_us(scan_at) >= (SELECT floor(avg(epoch_us(scan_at))) FROM judged_scans))", "observed")
add("ss_evict", "symbol since scans observations until", lambda s, d: observer.history(observer.judged(evidence.scans(s, d)), _TTL).groupBy("symbol", F.col("first_seen").cast("timestamp_ntz").alias("since")).agg(F.max("scan_count").alias("scans"), F.max("observation_count").alias("observations"), F.max(F.col("scan_at").cast("timestamp_ntz")).alias("until")),
    "(SELECT symbol, first_seen AS since, max(scan_count) AS scans, max(observation_count)::BIGINT AS observations, max(scan_at) AS until FROM observed GROUP BY symbol, first_seen)", "observed")

# -- files of others -----------------------------------------------------------------------------------------------


def _pages(s, d):
    """The daily bars as pages of JSON by symbol and year, each with the first weeks of the next year as well, and read again."""
    b = _daily(s, d).select("symbol", "ts", F.year("ts").alias("page"), F.struct(F.col("ts").alias("t"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"), F.col("volume").alias("v")).alias("x"))
    # one row goes to both pages: the bars computed twice would differ in the last digits of their sums
    b = b.withColumn("page", F.explode(F.when(F.dayofyear("ts") <= 30, F.array("page", F.col("page") - 1)).otherwise(F.array("page"))))
    pages = b.groupBy("page", "symbol").agg(F.sort_array(F.collect_list("x")).alias("list")).select("page", F.create_map("symbol", "list").alias("bars"))
    path = store.fresh_path(s, "pages")
    pages.write.option("compression", "gzip").json(path)
    return files.unwrapped(s, path)


def _dataset(s, d):
    """Daily bars as files by symbol under a manifest, loaded with the check and put in the form of bars."""
    path = store.fresh_path(s, "dataset")
    _daily(s, d).select("symbol", "ts", *(F.col(c).cast("string").alias(c.title()) for c in ("open", "high", "low", "volume")), F.col("close").alias("Adj Close")).repartition("symbol").write.partitionBy("symbol").parquet(f"{path}/daily")
    manifest = store.stored(files.digests(s, path, "*.parquet").where("name like 'daily/%'"), "manifest")
    return files.normalized(files.dataset(s, path, manifest, "daily"), "symbol", "ts")


def _imported(s, d):
    """The parts' directory as two CSV files, the second one with other prices for one size."""
    root, parts = store.fresh_path(s, "directory"), table(s, d, "part").select("p_partkey", "p_brand", "p_retailprice")
    parts.unionByName(parts.where("p_partkey % 7 = 0")).write.option("header", "true").csv(f"{root}/a")
    table(s, d, "part").where("p_size = 7").select("p_partkey", "p_brand", (F.col("p_retailprice") + 1).alias("p_retailprice")).write.option("header", "true").csv(f"{root}/b")
    return files.imported(s, [f"{root}/a", f"{root}/b"], "p_partkey long, p_brand string, p_retailprice double", "p_partkey")


_BARS = "symbol ts open:4 high:4 low:4 close:4 volume:2"
add("norm_wrapped", _BARS, _pages, "bars", "bars")
add("src_dataset", _BARS, _dataset, "bars", "bars")
add("src_import", "p_partkey p_brand p_retailprice:4 source rows_read", _imported, "(SELECT p_partkey, p_brand, p_retailprice + (p_size = 7)::INT AS p_retailprice, (p_size = 7)::INT AS source, 1 + (p_partkey % 7 = 0)::INT + (p_size = 7)::INT AS rows_read FROM part)")

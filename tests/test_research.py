"""Walk-forward signals, ledgers, ancestry, as-of lookups and resampling against brute force and invariants."""

import datetime as dt
import math
import random
from collections import defaultdict, deque
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from regimeforge.operators import accounts, ancestry, asof, resampling, walkforward
from regimeforge.plans import registry
from regimeforge.sources import store

SF = "/root/testdata/sf0.001"


def day(k):
    return dt.datetime(2020, 1, 1) + dt.timedelta(days=k)


@pytest.fixture(scope="module")
def states(spark):
    return store.stored(registry._states(spark, SF), "states")


def test_later_bars_change_no_earlier_signal(spark, states):
    """What a bar says must not depend on bars that come after it, in any column."""
    cut = states.agg(F.percentile_approx("ts", 0.7)).first()[0]
    whole = {(r.symbol, r.ts): r for r in walkforward.historical_signals(states, min_training_bars=60).where(F.col("ts") <= F.lit(cut)).collect()}
    part = {(r.symbol, r.ts): r for r in walkforward.historical_signals(states.where(F.col("ts") <= F.lit(cut)), min_training_bars=60).collect()}
    assert whole and whole == part
    assert any(r.signal != "flat" or r.block_reason != "insufficient_observations" for r in whole.values())


def test_as_of_statistics_equal_a_refit_at_every_bar(spark):
    draw = random.Random(3)
    rows = [("s", day(k), draw.choice("abc"), 100 * math.exp(draw.gauss(0, 0.1))) for k in range(60)] + [("t", day(0), "a", 1.0), ("t", day(1), None, 1.0), ("t", day(2), "b", None)]
    got = {(r.symbol, r.ts): r for r in walkforward.as_of_statistics(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, state string, close double")).collect()}
    assert len(got) == 61
    s = [r for r in rows if r[0] == "s"]
    for n in range(60):
        seen = s[: n + 1]
        state = seen[-1][2]
        moves = [b[2] for a, b in zip(seen, seen[1:], strict=False) if a[2] == state]
        rets = [seen[i + 5][3] / seen[i][3] - 1 for i in range(n - 4) if seen[i][2] == state]
        known = sorted({r[2] for r in seen})
        w = [moves.count(x) + 1 for x in known]
        p = [x / sum(w) for x in w]
        certain = 1.0 if len(known) == 1 else max(1 + sum(x * math.log(x) for x in p) / math.log(len(known)), 0)
        r = got["s", s[n][1]]
        assert r.observations == len(rets) and abs(r.confidence - certain) < 1e-9 and r.predicted == known[w.index(max(w))]
        assert (r.mean_return is None) == (not rets) and (not rets or abs(r.mean_return - sum(rets) / len(rets)) < 1e-9)


def test_folds_are_fitted_on_their_own_span(spark, states):
    """Bars outside of a fold's training and validation parts change nothing in it."""
    spans = (120, 40, 40, 40)
    first = {(r.part, r.symbol, r.ts): r for r in walkforward.prepared(states, *spans, least=20).where("fold_id = 2").collect()}
    times = sorted(r.ts for r in states.select("ts").distinct().collect())
    lo, hi = times[40], times[40 + 160 - 1]
    odd = states.withColumn("close", F.when((F.col("ts") < F.lit(lo)) | (F.col("ts") > F.lit(hi)), F.col("close") * 7 + 1).otherwise(F.col("close")))
    second = {(r.part, r.symbol, r.ts): r for r in walkforward.prepared(odd, *spans, least=20).where("fold_id = 2").collect()}
    assert first and first == second
    assert {k[0] for k in first} == {"validation", "test"}
    few = walkforward.prepared(states, *spans, least=10_000)
    assert few.count() == 0 and walkforward.prepared(states.limit(0), *spans).count() == 0


ACTS = "id string, ts timestamp_ntz, activity_type string, symbol string, side string, qty string, price string, fee string, net_amount string, quantity_delta string"


def acts(spark, rows):
    full = [tuple(r.get(c) for c in ("id", "ts", "activity_type", "symbol", "side", "qty", "price", "fee", "net_amount", "quantity_delta")) for r in rows]
    return spark.createDataFrame(full, ACTS)


def fill(i, side="buy", qty="2", price="10", fee="0.1", symbol="X", **more):
    return {"id": i, "ts": day(1), "activity_type": "FILL", "symbol": symbol, "side": side, "qty": qty, "price": price, "fee": fee, **more}


def cash(i, kind, amount):
    return {"id": i, "ts": day(1), "activity_type": kind, "net_amount": amount}


def test_activities_are_typed_exactly(spark):
    rows = [
        fill("1", qty="123456789.123456", price="12345678.654321"), fill("0", symbol="Z", qty="123456789.123451", price="12345678.654323"), fill("2", side="sell", price="0.000001"), fill("3", qty="1e3"), fill("4", qty="0"), fill("5", price="-1"), fill("6", side="hold"), fill("7", symbol="Y"), fill("8", qty="0.0000001"), fill("9", qty="abc"), fill("10", fee=None), fill(" "),
        fill("11", ts=None), cash("20", "CSD", "5.5"), cash("21", "CSD", "-5"), cash("22", "CSW", "-7"), cash("23", "CSW", "7"), cash("24", "FEE", "-0.25"), cash("25", "FEE", "1"), cash("26", "DIV", "0.3333"), cash("27", "INT", None), cash("28", "XYZ", "1"), cash("29", None, "1"),
        {"id": "30", "ts": day(1), "activity_type": "POSITION_ADJUSTMENT", "symbol": "Q", "quantity_delta": "-4"}, {"id": "31", "ts": day(1), "activity_type": "POSITION_ADJUSTMENT", "quantity_delta": "4"},
    ]
    got = {r.id: r for r in accounts.normalized(acts(spark, rows), spark.createDataFrame([("X", "100"), ("Z", "1")], "symbol string, multiplier string")).collect()}
    assert {k: r.faults for k, r in got.items() if r.faults} == {
        "4": "invalid_fill", "5": "invalid_fill", "6": "invalid_fill", "7": "multiplier_missing", "8": "invalid_fill", "9": "invalid_fill", " ": "missing_id", "11": "missing_timestamp", "21": "sign_contradiction", "23": "sign_contradiction", "25": "sign_contradiction",
        "27": "invalid_amount", "28": "unsupported_type", "29": "unsupported_type", "31": "missing_symbol",
    }
    assert got["1"].cash == -Decimal("123456789.123456") * Decimal("12345678.654321") * 100 - Decimal("0.1")
    assert got["0"].cash == -Decimal("123456789.123451") * Decimal("12345678.654323") - Decimal("0.1")
    assert got["2"].cash == Decimal("2") * Decimal("0.000001") * 100 - Decimal("0.1") and got["2"].quantity == -2
    assert got["3"].quantity == 1000 and got["10"].fee == 0
    assert (got["20"].external_cashflow, got["22"].external_cashflow, got["24"].fee, got["26"].cash, got["30"].quantity) == (Decimal("5.5"), -7, Decimal("0.25"), Decimal("0.3333"), -4)
    assert all(r.cash == 0 and r.quantity == 0 for r in got.values() if r.faults)


def test_imports_are_whole_and_can_be_repeated(spark):
    inst = spark.createDataFrame([("X", "100")], "symbol string, multiplier string")
    rows = lambda *r: accounts.normalized(acts(spark, r), inst)
    ledger = accounts.Ledger(spark, store.fresh_path(spark, "ledger"), rows(fill("1")).schema)
    assert ledger.events().count() == 0
    assert ledger.load("a", rows(fill("1"), fill("2"), fill("2")))["new_events"] == 2
    again = ledger.load("a2", rows(fill("1"), fill("2")))
    assert again["accepted"] and again["new_events"] == 0
    broken = ledger.load("b", rows(fill("3"), fill("2", price="11")))
    assert not broken["accepted"] and broken["conflicts"] == 1 and ledger.events().count() == 2
    assert ledger.load("c", rows(fill("4"), fill("4", qty="3")))["conflicts"] == 1
    assert ledger.load("d", rows(fill("5"), fill("6", qty="-1")))["faulty"] == 1
    assert ledger.load("e", rows())["accepted"] and ledger.load("f", rows(fill("3")))["new_events"] == 1
    assert sorted(r.id for r in ledger.events().collect()) == ["1", "2", "3"]


def test_an_import_under_an_old_name_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(accounts.Ledger, "BUCKETS", 2)
    inst, path = spark.createDataFrame([("X", "100")], "symbol string, multiplier string"), store.fresh_path(spark, "ledger")
    rows = lambda *r: accounts.normalized(acts(spark, r), inst)
    ledger = accounts.Ledger(spark, path, rows(fill("1")).schema)
    assert ledger.load("a", rows(fill("1"), fill("2")))["new_events"] == 2
    assert ledger.load("a", rows(fill("1")))["new_events"] == 0 and ledger.events().count() == 2
    again = accounts.Ledger(spark, path, ledger.schema)
    assert again.load("b", accounts.Ledger.placed(rows(fill("2"), fill("3")), "rows"))["new_events"] == 1
    assert sorted(r.id for r in again.events().collect()) == ["1", "2", "3"]


def test_cash_and_positions_reconcile(spark):
    inst = spark.createDataFrame([("X", "100")], "symbol string, multiplier string")
    events = accounts.normalized(acts(spark, [fill("1"), fill("2", side="sell", qty="0.5"), cash("3", "CSD", "100")]), inst)
    snap = lambda *r: spark.createDataFrame([(k, Decimal(v)) for k, v in r], "item string, amount decimal(38,12)")
    got = {r.item: r for r in accounts.reconciled(events, snap((None, "50"), ("Y", "3")), snap((None, "-1350.2"), ("X", "1.5"), ("W", "1"))).collect()}
    assert got["cash"].difference == 0 and got["X"].difference == 0 and got["Y"].difference == 3 and got["W"].difference == -1
    assert [tuple(r) for r in accounts.reconciled(events.limit(0), snap(), snap()).collect()] in ([], [("cash", 0, 0, 0, 0)])


def brute_lots(fills, opening):
    lots, out = defaultdict(deque), []
    for s, i, t, q, p, f, m in opening + sorted(fills, key=lambda r: (r[2], r[1])):
        left = q
        while left and lots[s] and left * lots[s][0][1] < 0:
            lot = lots[s][0]
            n = min(abs(left), abs(lot[1]))
            sign = 1 if lot[1] > 0 else -1
            out.append((s, sign, lot[0], i, n, sign * n * (p - lot[2]) * m, lot[3] * n / lot[4] + f * n / abs(q)))
            lot[1] -= sign * n
            left += sign * n
            if not lot[1]:
                lots[s].popleft()
        if left:
            lots[s].append([i, left, p, f, abs(q)])
    for s, rest in lots.items():
        out += [(s, 1 if q > 0 else -1, i, None, abs(q), None, f * abs(q) / of) for i, q, _, f, of in rest]
    return out


def test_signed_lots_equal_a_fold_over_fills(spark):
    draw = random.Random(8)
    cents = lambda lo, hi: Decimal(draw.randrange(lo, hi)) / 100
    fills = []
    for k in range(400):
        q = cents(1, 900) * draw.choice([1, -1]) * (1000 if k % 97 == 0 else 1)
        fills.append((draw.choice("AAAAAB"), f"f{k:03}", day(draw.randrange(60)), q, cents(100, 9000), cents(0, 50), Decimal(draw.choice([1, 100]))))
    mult = {"A": Decimal(100), "B": Decimal(1), "C": Decimal(1)}
    fills = [(*f[:6], mult[f[0]]) for f in fills]
    opening = [("A", "o1", day(-9), Decimal("-40.5"), Decimal(20), Decimal("1.5"), mult["A"]), ("A", "o2", day(-8), Decimal("-3"), Decimal(21), Decimal(0), mult["A"]), ("C", "o3", day(-8), Decimal(5), Decimal(1), Decimal(2), mult["C"])]
    kind = "symbol string, id string, ts timestamp_ntz, quantity decimal(15,6), price decimal(14,6), fee decimal(14,6), multiplier decimal(6,0)"
    got = accounts.signed_lots(spark.createDataFrame(fills, kind), spark.createDataFrame(opening, kind)).collect()
    key = lambda r: tuple(map(str, r[:4]))
    got = sorted(((r.symbol, r.direction, r.open_id, r.close_id, r.quantity, r.gross, r.fees) for r in got), key=key)
    expected = sorted(brute_lots(fills, opening), key=key)
    assert [key(r) for r in got] == [key(r) for r in expected]
    for g, e in zip(got, expected, strict=True):
        assert g[4] == e[4] and g[5] == e[5] and abs(g[6] - e[6]) < Decimal("1e-9")
    assert accounts.signed_lots(spark.createDataFrame([], kind)).count() == 0


@pytest.mark.parametrize("stretch", [1, 7])
def test_lots_of_a_busy_symbol_go_on_through_days_and_stretches(spark, stretch):
    draw = random.Random(stretch)
    mult = {"A": Decimal(100), "B": Decimal(1)}
    fills = []
    for k in range(300):
        symbol, q = draw.choice("AAAAB"), Decimal(draw.randrange(1, 900)) / 100 * draw.choice([1, -1]) * (1000 if k % 97 == 0 else 1)
        fills.append((symbol, f"f{k:03}", day(draw.randrange(20)), q, Decimal(draw.randrange(100, 9000)) / 100, Decimal(draw.randrange(50)) / 100, mult[symbol]))
    opening = [("A", "o1", day(-9), Decimal("-40.5"), Decimal(20), Decimal("1.5"), mult["A"])]
    kind = "symbol string, id string, ts timestamp_ntz, quantity decimal(15,6), price decimal(14,6), fee decimal(14,6), multiplier decimal(6,0)"
    got = accounts.signed_lots(spark.createDataFrame(fills, kind), spark.createDataFrame(opening, kind), busy=100, stretch=stretch).collect()
    assert sorted((r.symbol, r.direction, r.open_id, str(r.close_id), r.quantity, r.gross) for r in got) == sorted((*e[:3], str(e[3]), *e[4:6]) for e in brute_lots(fills, opening))


@pytest.mark.parametrize("busy", [0, accounts.BUSY])
def test_fills_without_a_time_come_last(spark, busy):
    one, kind = Decimal(1), "symbol string, id string, ts timestamp_ntz, quantity decimal(15,6), price decimal(14,6), fee decimal(14,6), multiplier decimal(6,0)"
    fills = [("A", "late", None, -one, one, one, one), ("A", "early", day(1), one, one, one, one)]
    assert [(r.direction, r.open_id, r.close_id) for r in accounts.signed_lots(spark.createDataFrame(fills, kind), busy=busy).collect()] == [(1, "early", "late")]


def test_latches_follow_cash_flows(spark):
    m = lambda s, h, e, flows=0.0, prior=None: ("a", dt.date(2020, 1, s), dt.datetime(2020, 1, s, h), e, flows, prior)
    rows = [
        m(1, 1, 100.0), m(1, 2, 99.4), m(1, 3, 100.0), m(2, 1, 100.0, 0.0, 100.0), m(2, 2, 150.0, 50.0, 100.0), m(2, 3, 149.4, 50.0, 100.0), m(2, 4, 149.2, 50.0, 100.0), m(2, 5, 150.0, 50.0, 100.0),
        m(3, 1, 150.0, 50.0, 150.0), m(3, 2, -1.0, 50.0, 150.0), m(4, 1, 145.4, 50.0), m(5, 1, 145.4, 50.0, 145.6), m(6, 1, 200.0, 50.0, 145.4),
    ]
    got = accounts.halts(spark.createDataFrame(rows, "account string, session date, ts timestamp_ntz, equity double, flows double, prior_close double")).orderBy("ts").collect()
    assert [r.reason for r in got] == ["allowed", "daily_halt", "daily_halt", "allowed", "allowed", "allowed", "daily_halt", "daily_halt", "allowed", "invalid_equity_or_baseline", "missing_or_invalid_session_baseline", "drawdown_halt", "drawdown_halt"]
    assert got[4].high_water == 150.0 and got[4].daily_baseline == 150.0 and got[9].high_water == 150.0


def test_chains_cycles_and_orphans(spark):
    rows = [(0, None, False)] + [(k, k - 1, k == 40) for k in range(1, 70)] + [(100, 102, False), (101, 100, False), (102, 101, True), (103, 100, False), (104, 104, False), (105, 999, False)]
    got = {r.id: r for r in ancestry.ancestry(spark.createDataFrame(rows, "id long, parent long, bad boolean"), "id", "parent", "bad").collect()}
    assert all((got[k].root, got[k].depth, got[k].cyclic, got[k].above) == (0, k, False, k > 40) for k in range(70))
    assert all(got[k].cyclic and got[k].root is None for k in range(100, 105)) and got[103].above
    assert (got[105].root, got[105].depth) == (105, 0)
    assert ancestry.ancestry(spark.createDataFrame([], "id long, parent long"), "id", "parent").count() == 0


def test_decisions_name_their_faults(spark):
    h = lambda *x: spark.range(1).select(ancestry.input_hash(*(F.lit(v) for v in x))).first()[0]
    good, late = h(day(1), day(2), "p"), h(day(1), day(9), "q")
    evidence = spark.createDataFrame([(good, day(1), day(2), "p"), (late, day(1), day(9), "q"), ("f" * 64, day(1), day(2), "r")], "sha256 string, event_at timestamp_ntz, received_at timestamp_ntz, payload string")
    used = {1: [good], 2: [late], 3: ["f" * 64], 4: [], 5: [good, "0" * 64], 6: [good], 7: [good], 8: [good], 9: [good]}
    inputs = spark.createDataFrame([(i, k, x) for i, xs in used.items() for k, x in enumerate(xs)] + [(77, 0, good)], "decision_id long, ordinal int, input_sha256 string")
    raw = [(1, day(5), None), (2, day(5), 1), (3, day(5), None), (4, day(5), None), (5, day(5), None), (6, day(4), 1), (7, day(5), 888), (8, day(5), 2), (9, day(5), 9)]
    d = spark.createDataFrame([(i, t, a, ",".join(used[i])) for i, t, a in raw], "id long, decided_at timestamp_ntz, amends long, ins string")
    d = d.withColumn("sha256", ancestry.decision_hash(F.col("id"), F.col("decided_at"), F.col("amends"), F.col("ins"))).drop("ins")
    links = spark.createDataFrame([("l", 1, day(4)), ("m", 66, day(9))], "link_id string, decision_id long, observed_at timestamp_ntz")
    got = {r.id: r for r in ancestry.audited(d, inputs, evidence, links).collect()}
    assert {k: r.faults for k, r in got.items()} == {
        1: "link_precedes_decision", 2: "noncausal_evidence", 3: "evidence_hash", 4: "no_input", 5: "missing_evidence", 6: "noncausal_parent", 7: "missing_parent", 8: "", 9: "cyclic_amendment", 66: "orphan_link", 77: "orphan_input",
    }
    assert not got[8].ancestors_sound and got[1].ancestors_sound and got[66].ancestors_sound is None and got[8].root == 1 and got[8].depth == 2


def test_quotes_on_two_clocks(spark):
    q = spark.createDataFrame([("a", day(3), day(4), 1), ("a", day(1), day(5), 2), ("a", day(6), day(20), 3), ("b", day(1), day(1), 4), ("a", None, day(1), 5)], "symbol string, event_at timestamp_ntz, received_at timestamp_ntz, bid int")
    asks = spark.createDataFrame([("a", day(3), 1), ("a", day(4), 2), ("a", day(6), 3), ("a", day(30), 4), ("c", day(5), 5), (None, day(5), 6)], "symbol string, ts timestamp_ntz, n int")
    got = {r.n: r.quote_bid for r in asof.latest_known(asks, q, "symbol", "ts", "event_at", "received_at", ["bid"]).collect()}
    assert got == {1: None, 2: 1, 3: 1, 4: 3, 5: None, 6: None}


def test_excursions_over_edges_and_whole_months(spark):
    draw = random.Random(2)
    bars = [("s", day(k), 100 + draw.random(), 101 + draw.random() * 20, 99 - draw.random() * 20) for k in range(200)]
    spans = [(k, "s", draw.choice([1, -1]), day(a := draw.randrange(190)), day(a + draw.randrange(150)), 100.0 if k else 0.0, draw.choice([None, 95.0])) for k in range(60)] + [(99, "none", 1, day(1), day(5), 100.0, None)]
    b = spark.createDataFrame(bars, "symbol string, ts timestamp_ntz, open double, high double, low double")
    got = {r.trade_id: r for r in asof.excursions(spark.createDataFrame(spans, "trade_id int, symbol string, direction int, entry_ts timestamp_ntz, exit_ts timestamp_ntz, entry_price double, stop_price double"), b).collect()}
    for i, s, d, lo, hi, p, stop in spans:
        held = [(max(o, stop), min(o, stop)) if t == hi and stop else (h, w) for x, t, o, h, w in bars if x == s and lo < t <= hi]
        assert got[i].bars_held == len(held) and got[i].censored == (stop is not None)
        if not p:
            assert got[i].mae_pct is None and got[i].mfe_pct is None
            continue
        worst = min([0.0] + [((w - p) if d > 0 else (p - h)) / p for h, w in held])
        best = max([0.0] + [((h - p) if d > 0 else (p - w)) / p for h, w in held])
        assert abs(got[i].mae_pct - worst) < 1e-12 and abs(got[i].mfe_pct - best) < 1e-12


def test_total_return_puts_splits_and_dividends_back(spark):
    bars = spark.createDataFrame([("a", day(0), 100.0), ("a", day(1), 51.0), ("a", day(2), 50.0), ("b", day(0), 7.0)], "symbol string, ts timestamp_ntz, close double")
    actions = spark.createDataFrame([("a", day(1), 2.0, 0.0), ("a", day(2), 1.0, 1.0), ("a", day(0), 9.0, 9.0), ("c", day(0), 3.0, 1.0)], "symbol string, ts timestamp_ntz, split_ratio double, dividend double")
    got = [r.total_return_index for r in asof.total_return(bars, actions).orderBy("symbol", "ts").collect()]
    # the first session has no close before it, so its action has no effect
    assert np.allclose(got, [100.0, 102.0, 102.0, 7.0])
    with pytest.raises(Exception, match="several corporate actions"):
        asof.total_return(bars, actions.unionByName(actions)).collect()


def test_total_return_has_a_logarithm_where_the_index_is_too_large(spark):
    bars = spark.createDataFrame([("a", day(k), 100.0) for k in range(1201)], "symbol string, ts timestamp_ntz, close double")
    actions = spark.createDataFrame([("a", day(k), 2.0, 0.0) for k in range(1201)], "symbol string, ts timestamp_ntz, split_ratio double, dividend double")
    got = asof.total_return(bars, actions).orderBy("ts").collect()[-1]
    assert got.total_return_index == float("inf") and abs(got.log_index - (np.log(100.0) + 1200 * np.log(2.0))) < 1e-9


def test_a_span_that_ends_before_it_begins_holds_no_bar(spark):
    bars = spark.createDataFrame([("s", day(k), 1.0, 2.0, 0.5) for k in range(90)], "symbol string, ts timestamp_ntz, open double, high double, low double")
    span = spark.createDataFrame([(1, "s", 1, day(80), day(2), 1.0, None), (2, "s", 1, None, day(2), 1.0, 0.9)], "trade_id int, symbol string, direction int, entry_ts timestamp_ntz, exit_ts timestamp_ntz, entry_price double, stop_price double")
    assert sorted(map(tuple, asof.excursions(span, bars).collect())) == [(1, 0, 0.0, 0.0, False), (2, 0, 0.0, 0.0, True)]


def test_contracts_are_chosen_from_chains_without_joining_them(spark):
    draw = random.Random(5)
    chain = [(draw.choice("ab"), f"P{k}", day(e := draw.randrange(20, 200, 30)).date(), draw.choice([None, *range(90, 110)]), day(e - draw.choice([30, 200])).date(), day(e - 1).date()) for k in range(120)]
    chain = [(u, c, e, None if x is None else float(x), f, l) for u, c, e, x, f, l in chain]
    asks = [(k, draw.choice("abc"), day(draw.randrange(200)).date(), draw.choice([None, 85.0, 100.0, 100.5, 101.3, 120.0])) for k in range(300)]
    found = asof.select_contracts(spark.createDataFrame(asks, "decision_id int, underlying string, session date, midpoint double"), spark.createDataFrame(chain, "underlying string, symbol string, expiry date, strike double, first_session date, last_session date"))
    got = {r.decision_id: (r.contract, r.expiry, r.strike) for r in found.collect()}
    assert len(got) == len(asks)
    for k, u, at, middle in asks:
        fit = [(abs((e - at).days - 52), e, x is None, abs(x - middle) if x is not None and middle is not None else 0, x or 0, c, x) for v, c, e, x, f, l in chain if v == u and f <= at <= l and e > at]
        assert got[k] == ((min(fit)[5], min(fit)[1], min(fit)[6]) if fit else (None, None, None))


def test_bootstrap_has_the_moments_of_its_series(spark):
    n = 40
    values = np.random.default_rng(1).standard_normal((n, 2)).cumsum(axis=0)
    s = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(values)], "t int, a double, b double")
    got = {(r.block_length, r.series): r for r in resampling.stationary_bounds(s, ["a", "b"], "t", blocks=(1, 5), resamples=4000, alpha=0.05).collect()}
    assert len(got) == 4 and {r.sessions for r in got.values()} == {n}
    for length in (1, 5):
        rng, means = np.random.default_rng(length), np.zeros((4000, 2))
        for k in range(4000):
            at = rng.integers(n)
            for _ in range(n):
                means[k] += values[at] / n
                at = rng.integers(n) if rng.random() < 1 / length else (at + 1) % n
        for c, name in enumerate("ab"):
            r = got[length, name]
            spread = means[:, c].std()
            assert abs(r.centre - values[:, c].mean()) < 0.15 * spread and abs(r.lower - np.quantile(means[:, c], 0.05)) < 0.15 * spread
    again = resampling.stationary_bounds(s.repartition(7), ["a", "b"], "t", blocks=(5,), resamples=4000, alpha=0.05).where("series = 'a'").first()
    assert abs(again.lower - got[5, "a"].lower) < 1e-12
    assert resampling.stationary_bounds(s.limit(1), ["a"], "t", resamples=10).count() == 0

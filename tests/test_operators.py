"""Causality, identities and odd inputs."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from regimeforge.operators import checks, evidence, features, gates, ledger, models, signals, simulate, states, strategies, trades
from regimeforge.sources import bars as sources
from regimeforge.streaming import latest

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("column", ["rsi_14", "vol_zscore_20", "zscore_close_20", "trend_persistence"])
def test_features_do_not_see_the_future(spark, column):
    bars = sources.daily_bars(spark, SF)
    cut = dt.datetime(1998, 1, 1)
    made = lambda b: features.rsi(features.features(b)).where(F.col("ts") < F.lit(cut)).select("symbol", "ts", column).orderBy("symbol", "ts").toPandas()
    a, b = made(bars), made(bars.where(F.col("ts") < F.lit(cut)))
    np.testing.assert_array_equal(a[column].to_numpy(), b[column].to_numpy())


def test_signals_and_caps_hold_limits(spark):
    from regimeforge.plans import registry

    out = registry.queries()["sel_caps"](spark, SF)
    assert out.where("final_signal <> 'flat'").groupBy("ts").count().where("count > 3").count() == 0


def test_simulated_cash_adds_up(spark):
    from regimeforge.plans import registry

    got = registry.queries()["bt_event"](spark, SF).toPandas()
    assert len(got) and (got.exit_ts >= got.entry_ts).all()
    for _, own in got.groupby("account"):
        gain = own.pnl.sum()
        assert abs(own.cash_after.iloc[-1] - 100_000 - gain) < 1  # rounding of the reported digits


def test_drawdown_survives_total_loss(spark):
    t = spark.createDataFrame([("a", 1, 1, 0.5), ("a", 1, 2, -1.0), ("a", 2, 3, 0.1)], "k string, exit_ts int, trade_order int, return_pct double")
    assert trades.drawdown(t, "k").first()["max_drawdown"] == pytest.approx(1.0)


def test_fifo_over_block_edges(spark):
    f = spark.createDataFrame([("s", 1, 1, "buy", 1500, 10.0), ("s", 2, 2, "sell", 400, 11.0), ("s", 3, 3, "sell", 1200, 12.0)], "symbol string, id long, ts int, side string, quantity long, price double")
    got = {(r.buy_id, r.sell_id): (r.quantity, r.pnl) for r in ledger.fifo(f).collect()}
    assert got == {(1, 2): (400, 400.0), (1, 3): (1100, 2200.0)}


def test_broken_chain_is_found(spark):
    rows = spark.createDataFrame([("k", n, f"c{n}") for n in range(5)], "k string, n int, c string")
    stored = ledger.chained(rows, "k", "n", "c")
    faults = lambda df: {r.n: r.faults for r in ledger.verified(df, "k", "c").collect() if r.faults}
    assert faults(stored) == {}
    assert faults(stored.withColumn("c", F.when(F.col("n") == 1, "other").otherwise(F.col("c")))) == {1: ["hash_mismatch"]}
    assert faults(stored.withColumn("link_hash", F.when(F.col("n") == 1, "0").otherwise(F.col("link_hash")))) == {1: ["hash_mismatch"], 2: ["broken_link"]}
    assert faults(stored.where("n <> 2")) == {3: ["missing_link", "broken_link"]}


def test_bad_bars_and_empty_tables(spark):
    schema = "symbol string, asset_class string, ts timestamp_ntz, open double, high double, low double, close double, volume double"
    t = dt.datetime(2024, 1, 1)
    bars = spark.createDataFrame([("a", "equity", t, 1.0, 0.5, 1.0, 1.0, -1.0), ("a", "equity", t, float("nan"), 1.0, 1.0, None, 1.0)], schema)
    r = checks.validate_bars(bars).first()
    assert (r.bars, r.not_finite, r.inconsistent_range, r.negative_volume, r.duplicate_timestamps) == (2, 1, 1, 1, 1)
    none = spark.createDataFrame([], schema)
    assert states.composite(features.features(none)).count() == 0
    assert signals.latest(none).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([("a", dt.datetime(2024, 1, 1, 0, m), m, float(m + 1)) for m in (0, 2, 1)] + [("b", dt.datetime(2024, 1, 1), 5, 7.0)], "symbol string, ts timestamp_ntz, seq long, price double")
    rows.write.parquet(str(tmp_path / "in"))
    q = latest.latest(latest.read_events(spark, str(tmp_path / "in"), rows.schema)).writeStream.outputMode("complete").format("memory").queryName("latest_rows").start()
    try:
        q.processAllAvailable()
        assert sorted(map(tuple, spark.table("latest_rows").collect())) == sorted(map(tuple, latest.latest(rows).collect()))
    finally:
        q.stop()


def test_models_label_rows_by_what_they_were_fitted_on(spark):
    f = features.features(sources.daily_bars(spark, SF))
    cut = F.lit(dt.datetime(1999, 1, 1))
    past, later = f.where(F.col("ts") < cut), f.where(F.col("ts") >= cut)
    edges = models.fit_edges(past, {"return_5": 3})
    whole = {(r.symbol, r.ts): r.state for r in models.apply_edges(f, edges, ["return_5"]).collect()}
    assert all(whole[r.symbol, r.ts] == r.state for r in models.apply_edges(later, edges, ["return_5"]).collect())
    fitted = models.fit_clusters(past, ["return_5", "return_20", "zscore_close_20"], 4, least=30)
    got = models.apply_clusters(later, fitted).collect()
    centres = np.array(fitted.kmeans.clusterCenters())
    for r in got:
        nearest = int(((centres - np.array(r.cluster_point)) ** 2).sum(axis=1).argmin())
        assert r.cluster == f"cluster_{fitted.numbers[nearest]:02d}"
    assert {r.cluster for r in got} == {r.cluster for r in models.apply_clusters(later, models.fit_clusters(past, ["return_5", "return_20", "zscore_close_20"], 4, least=30)).collect()}


def test_small_clusters_join_the_nearest():
    assert models.merge_small({0: 50, 1: 3, 2: 40}, {0: [0.0], 1: [9.0], 2: [10.0]}, 10) == {0: 0, 1: 1, 2: 1}
    assert models.merge_small({0: 2, 1: 5}, {0: [0.0], 1: [1.0]}, 10) == {0: 0, 1: 0}
    assert [models.cluster_count(4, n, 20) for n in (1, 30, 50, 1000)] == [1, 1, 2, 4]


def test_hybrid_regimes_without_a_model_have_one_cluster(spark):
    f = models.anchor(features.features(sources.daily_bars(spark, SF)))
    assert {r.cluster for r in models.apply_hybrid(f, models.fit_hybrid(f, ["return_5"], 3, 10**9)).select("cluster").distinct().collect()} == {"cluster_00"}


def test_calendar_follows_summer_time(spark):
    days = spark.createDataFrame([("2024-03-08", "09:30", "16:00"), ("2024-03-11", "09:30", "13:00"), ("2024-11-04", "09:30", "09:00")], "date string, open string, close string")
    got = {r.date: (str(r.opens), str(r.closes), r.reasons) for r in evidence.local_calendar(days, "2024-01-01", "2024-12-31").collect()}
    assert got["2024-03-08"] == ("2024-03-08 14:30:00", "2024-03-08 21:00:00", []) and got["2024-03-11"] == ("2024-03-11 13:30:00", "2024-03-11 17:00:00", [])
    assert got["2024-11-04"][2] == ["invalid_hours"]


def test_snapshot_knows_no_future(spark):
    at = dt.datetime(2024, 1, 1, 12)
    rows = spark.createDataFrame(
        [("bars", "a", at - dt.timedelta(seconds=180), 1, 1.0, 1), ("bars", "b", at - dt.timedelta(seconds=30), 2, 1.0, 1), ("quotes", "a", at + dt.timedelta(seconds=1), 3, 1.0, 1), ("quotes", "a", at - dt.timedelta(seconds=61), 4, 1.0, 1), ("quotes", "c", at, 5, 1.0, 0), ("quotes", "d", at, 6, -1.0, 1), ("quotes", "e", at, 7, 1.0, 1)],
        "channel string, symbol string, ts timestamp_ntz, seq long, price double, generation int",
    )
    got = {(r.channel, r.symbol): r.state for r in latest.snapshot(rows, F.lit(at).cast("timestamp_ntz"), 1).collect()}
    assert got == {("bars", "a"): "fresh", ("quotes", "a"): "stale", ("quotes", "c"): "retained_previous_session", ("quotes", "e"): "fresh"}


def test_gates_pass_everything_without_tables(spark):
    rows = spark.createDataFrame([("equity", "s", "s>x", "s", "long", None, 30, 0.01), ("equity", "s", None, "s", "flat", "low_confidence", 30, 0.0)], "asset_class string, state string, transition_setup string, state_family string, candidate_signal string, block_reason string, observations int, base_score double")
    strict = gates.GatePolicy(state=gates.KindLimits(0.9, 0.9, 1, 99), hard=("state",))
    got = gates.gated(rows, {}, strict).collect()
    assert [(r.signal, r.hard_block_reason) for r in got] == [("long", None), ("flat", "low_confidence")]
    table = spark.createDataFrame([("equity", "other")], "asset_class string, key string").select("*", *(F.lit(1.0).alias(c) for c in gates._RECORD))
    assert gates.gated(rows, {"state": table}, strict).first()["hard_block_reason"] == "state_gate_failed"


def test_reversion_does_not_see_the_future(spark):
    bars = sources.hourly_bars(spark, SF)
    cut = F.col("ts") < F.lit(dt.datetime(2024, 1, 15))
    run = lambda b: strategies.session_reversion(b, n=3, atr=2, step_s=3600, opens=0, closes=1439).where(cut).orderBy("symbol", "ts").collect()
    assert run(bars) == run(bars.where(cut))


def test_purge_drops_labels_over_the_boundary(spark):
    days = [dt.datetime(2024, 1, 1) + dt.timedelta(days=k) for k in range(60)]
    folds = evidence.session_folds(spark.createDataFrame([(x,) for x in days], "ts timestamp_ntz"), 10, 5, 5, 5)
    assert folds.where("part = 'test'").count() == 7
    labels = spark.createDataFrame([(days[9], days[14]), (days[9], days[15]), (days[30], None)], "signal_ts timestamp_ntz, label_end_ts timestamp_ntz")
    assert evidence.purged(labels, folds).where("fold_id = 1").count() == 1

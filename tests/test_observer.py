"""Scans as observations: the rules one by one, and a stream that is stopped, restarted and restored against the batch."""

import datetime as dt
import random

import pytest

from regimeforge.streaming import observer

NOW = dt.datetime(2026, 9, 24, 3)
SCAN = "symbol string, asset_class string, scan_at timestamp, market_open boolean, failure string, answered boolean, trade_price double, trade_at timestamp, day_close double, day_volume double, day_at timestamp, prior_close double, prior_at timestamp, bid double, ask double, quote_at timestamp"
JUDGED = f"symbol string, scan_at timestamp, state string, reason string, good boolean, {observer.VALUE_TYPES}"


def scan(age=0, **more):
    base = dict(symbol="X", asset_class="us_equity", scan_at=NOW, market_open=True, failure=None, answered=True, trade_price=100.0, trade_at=NOW - dt.timedelta(seconds=age), day_close=100.0, day_volume=1000.0, day_at=NOW, prior_close=90.0, prior_at=NOW - dt.timedelta(days=1), bid=99.9, ask=100.1, quote_at=NOW)
    return tuple((base | more)[c.split()[0]] for c in SCAN.split(", "))


def judge(spark, *scans):
    return observer.judged(spark.createDataFrame(list(scans), SCAN)).collect()


def test_states_and_faults(spark):
    odd = [
        scan(), scan(301), scan(10_000, market_open=False), scan(8 * 86_400, market_open=False), scan(-1), scan(market_open=None), scan(181, asset_class="crypto"), scan(10, asset_class="futures"), scan(1801, asset_class="futures"), scan(failure="batch_failed"), scan(answered=False),
        scan(trade_price=float("nan")), scan(trade_price=0.0), scan(trade_at=None), scan(trade_price=None, trade_at=None), scan(day_volume=-1.0), scan(bid=101.0), scan(ask=None), scan(quote_at=NOW + dt.timedelta(seconds=1)), scan(trade_price=None, trade_at=None, day_close=None),
    ]
    got = judge(spark, *odd)
    assert [r.state for r in got] == ["fresh", "stale", "closed_last_observation", "stale", "invalid", "unavailable", "stale", "indicative_unknown_latency", "stale", "unavailable", "missing", "invalid", "invalid", "invalid", "fresh", "invalid", "invalid", "invalid", "invalid", "invalid"]
    assert [r.good for r in got] == [r.price is not None for r in got] and got[9].reason == "batch_failed"
    assert abs(got[0].change_pct - 100 / 9) < 1e-9 and abs(got[0].spread_bps - 20) < 1e-9


def test_old_parts_are_not_shown(spark):
    week = dt.timedelta(days=8)
    got = judge(spark, scan(day_at=NOW - week, prior_at=NOW - week), scan(quote_at=NOW - dt.timedelta(seconds=301)), scan(prior_at=NOW), scan(bid=None, ask=None, quote_at=None))
    assert (got[0].volume, got[0].change_pct) == (None, None) and got[1].spread_bps is None and got[2].change_pct is None and got[3].spread_bps is None
    assert all(r.good for r in got)


def test_receipt_is_no_observation_and_failure_keeps_the_value(spark):
    later = lambda k: NOW + dt.timedelta(seconds=k)
    rows = [scan(), scan(scan_at=later(1), day_at=NOW), scan(scan_at=later(2), failure="batch_failed"), scan(scan_at=later(3), trade_price=101.0, trade_at=later(3))]
    got = observer.history(observer.judged(spark.createDataFrame(rows, SCAN))).orderBy("scan_at").collect()
    assert [(r.observation_count, r.scan_count, r.retained) for r in got] == [(1, 1, False), (1, 2, False), (1, 3, True), (2, 4, False)]
    assert got[2].price == 100.0 and got[2].data_asof == NOW and got[2].last_seen == later(1) and got[2].state == "unavailable"


def scans(parts, seed=4):
    """Judged scans in order, cut into parts; some symbols are silent for longer than the ttl."""
    draw, out, clock = random.Random(seed), [], NOW
    for k in range(parts):
        rows = []
        for _ in range(25):
            s = draw.choice("abcde")
            clock += dt.timedelta(seconds=draw.choice([10, 60, 1500]))
            good = draw.random() < 0.6
            value = (draw.choice([1.0, 2.0]), clock - dt.timedelta(seconds=draw.choice([0, 5])), draw.choice([None, 3.0]), draw.choice([None, 7.0]), None) if good else (None,) * 5
            rows.append((s, clock, "fresh" if good else "missing", None if good else "x", good, *value))
        out.append(rows)
    return out


def written(spark, df, path, rocks=True):
    q = df.writeStream.format("parquet").option("checkpointLocation", f"{path}/check").option("path", f"{path}/out").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return spark.read.schema(observer.OUTPUT).parquet(f"{path}/out")


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def test_a_stream_stopped_and_restarted_equals_the_batch(spark, tmp_path, rocks):
    parts = scans(4)
    put = lambda k: spark.createDataFrame(parts[k], JUDGED).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    whole = observer.history(spark.createDataFrame(sum(parts, []), JUDGED), 3600)
    for k in range(4):  # each start goes on from the checkpoint of the one before
        put(k)
        made = written(spark, observer.observe(spark.readStream.schema(JUDGED).parquet(f"{tmp_path}/in"), 3600), tmp_path)
    assert sorted(map(tuple, made.collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)
    assert whole.where("scan_count = 1").count() > 5  # silent symbols were forgotten


def test_a_stream_restored_from_last_values_equals_the_batch(spark, tmp_path, rocks):
    parts = scans(4, seed=7)
    first = spark.createDataFrame(sum(parts[:2], []), JUDGED)
    rest = spark.createDataFrame(sum(parts[2:], []), JUDGED)
    whole = observer.history(first.unionByName(rest), 3600)
    last = observer.history(first, 3600).selectExpr("*", "row_number() over (partition by symbol order by scan_at desc) as n").where("n = 1").drop("n")
    expected = sorted(map(tuple, whole.join(rest.select("symbol", "scan_at"), ["symbol", "scan_at"], "left_semi").collect()), key=str)
    assert sorted(map(tuple, observer.history(rest, 3600, last).collect()), key=str) == expected
    rest.coalesce(1).write.parquet(f"{tmp_path}/in")
    made = written(spark, observer.observe(spark.readStream.schema(JUDGED).parquet(f"{tmp_path}/in"), 3600, restored=last), tmp_path)
    assert sorted(map(tuple, made.collect()), key=str) == expected

"""Files of others: refused if changed, malformed or contradictory."""

import json
import os
import uuid

import pytest
from pyspark.sql import functions as F

from regimeforge.operators import strategies
from regimeforge.plans import research_queries
from regimeforge.sources import files


def test_a_changed_dataset_is_refused(spark, tmp_path):
    for name in ("a", "b", "extra"):
        spark.createDataFrame([(name, 1)], "s string, n int").coalesce(1).write.parquet(f"{tmp_path}/data/{name}")
    names = sorted(str(p.relative_to(tmp_path)) for p in (tmp_path / "data").rglob("part-*.parquet"))
    found = files.digests(spark, f"file://{tmp_path}", "*.parquet")
    assert sorted(r.name for r in found.collect()) == names
    rows = [(r.name, r.sha256) for r in found.collect() if "extra" not in r.name]
    manifest = lambda more=(): spark.createDataFrame([*rows, *more], "name string, sha256 string")
    assert files.dataset(spark, str(tmp_path), manifest(), "data/a").collect() == [("a", 1)]
    assert {r.name.split("/")[1]: r.status for r in files.audited(found, manifest()).collect()} == {"a": "ok", "b": "ok", "extra": "unlisted"}
    odd = files.audited(found, manifest([("../x", "0"), ("gone", "0"), (rows[0][0], "0")]), ["needed"]).collect()
    assert {r.name: r.status for r in odd}.items() >= {"../x": "unsafe", "gone": "missing", rows[0][0]: "conflicting", "needed": "unlisted_required"}.items()
    for sums in tmp_path.rglob(".*.crc"):  # of the local file system
        sums.unlink()
    os.replace(tmp_path / rows[1][0], tmp_path / rows[0][0])
    with pytest.raises(files.EvidenceError, match="changed"):
        files.dataset(spark, str(tmp_path), manifest(), "data/a")


def test_pages_overlap_but_do_not_contradict(spark, tmp_path):
    bar = {"t": "2020-01-01T00:00:00", "o": 1, "h": 2, "l": 1, "c": 2, "v": 3}
    put = lambda name, *pages: (tmp_path / name).write_text("\n".join(p if isinstance(p, str) else json.dumps(p) for p in pages))
    put("good.json", {"bars": {"A": [bar, bar], "B": []}}, {"bars": {"A": [bar, bar | {"t": "2020-01-02T00:00:00"}]}}, {"bars": None})
    assert sorted((r.symbol, r.ts.day, r.close) for r in files.unwrapped(spark, f"{tmp_path}/good.json").collect()) == [("A", 1, 2.0), ("A", 2, 2.0)]
    put("odd.json", {"bars": {"A": [bar, bar | {"c": 1}]}})
    with pytest.raises(Exception, match="conflicting bars"):
        files.unwrapped(spark, f"{tmp_path}/odd.json").collect()
    put("broken.json", '{"bars": {"A": [')
    with pytest.raises(Exception):  # noqa: B017
        files.unwrapped(spark, f"{tmp_path}/broken.json").collect()


def test_wrapped_pages_hold_one_computation_of_each_bar(spark, monkeypatch):
    volume = F.udf(lambda: float(uuid.uuid4().int % 2**50), "double").asNondeterministic()  # as a sum whose terms come in another order each time
    day = F.timestamp_add("DAY", F.col("id").cast("int"), F.lit("2019-12-25").cast("timestamp_ntz"))
    bars = spark.range(60).select(F.lit("a").alias("symbol"), day.alias("ts"), *(F.lit(1.0).alias(c) for c in ("open", "high", "low", "close")), volume().alias("volume"))
    monkeypatch.setattr(research_queries, "_daily", lambda s, d: bars)
    assert len(research_queries._pages(spark, "").collect()) == 60


def test_columns_are_named_and_typed(spark):
    made = files.normalized(spark.createDataFrame([("s", "1", 2.0, 3, 4.0, "5")], "`Symbol` string, `OPEN` string, `High` double, `low` int, `Adj Close` double, `volume` string"), "symbol")
    assert made.collect() == [("s", 1.0, 2.0, 3.0, 4.0, 5.0)]
    with pytest.raises(files.EvidenceError, match="close"):
        files.normalized(spark.createDataFrame([(1,)], "open int"))
    bad = files.normalized(spark.createDataFrame([("x", 1, 1, 1, 1)], "open string, high int, low int, close int, volume int"))
    with pytest.raises(Exception, match="open is no number: x"):
        bad.collect()


def test_imports_are_whole_or_none(spark, tmp_path):
    put = lambda name, text: (tmp_path / name).write_text(text) and f"{tmp_path}/{name}"
    schema = "id string, price double"
    a, b = put("a.csv", "id,price\nx,1\ny,2\nx,1\n"), put("b.csv", "id,price\ny,3\n")
    assert sorted(map(tuple, files.imported(spark, [a, b], schema, "id").collect())) == [("x", 1.0, 0, 2), ("y", 3.0, 1, 2)]
    for text, error in (("id,price\nx,1\nx,2\n", "conflicting rows of x"), ("id,price\nx,one\n", "")):
        with pytest.raises(Exception, match=error):
            files.imported(spark, [put("c.csv", text)], schema, "id").collect()
    with pytest.raises(files.EvidenceError, match="without instruments"):
        files.imported(spark, [put("d.csv", "id,price\n")], schema, "id")


def test_round_robin_over_groups_of_any_size(spark):
    sizes = {"a": 120, "b": 1, "c": 0, "d": 37}
    rows = [(g, k % 10, k) for g, n in sizes.items() for k in range(n)]
    got = {(r.g, r.k): r.place for r in strategies.round_robin(spark.createDataFrame(rows, "g string, s int, k int"), "g", "s", "k").collect()}
    order = {g: sorted((s, k) for h, s, k in rows if h == g) for g in sizes}
    expected = [(g, order[g][t][1]) for t in range(120) for g in sizes if t < sizes[g]]
    assert [x for x, _ in sorted(got.items(), key=lambda x: x[1])] == expected and sorted(got.values()) == list(range(1, len(rows) + 1))

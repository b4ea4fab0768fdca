"""Ledgers: reconciliation, lots matched first in first out by range join, overhead, hash chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overhead(sessions: DataFrame, monthly: float) -> DataFrame:
    """(session, overhead): each calendar day costs its share of the month; days without a session go to
    the next session."""
    s = sessions.select("session").distinct().withColumn("before", F.lag("session").over(Window.orderBy("session")))
    days = s.select("session", F.explode(F.sequence(F.coalesce(F.date_add("before", 1), F.col("session")), F.col("session"))).alias("day"))
    return days.groupBy("session").agg(F.sum(monthly / F.dayofmonth(F.last_day("day"))).alias("overhead"))


def fifo(fills: DataFrame, bucket: Column | None = None) -> DataFrame:
    """(symbol, buy_id, sell_id, quantity, pnl): the k-th unit bought meets the k-th unit sold.

    ``fills``: symbol, id, ts, side (buy or sell), quantity (whole units), price. Buys and sells of a symbol
    become ranges of cumulative quantity, summed by ``bucket`` of time first (None: by each time), so no task
    holds all fills of a symbol;
    overlapping ranges are the matches. Ranges are cut at fixed blocks of units, and the join is on symbol
    and block, so it is an equi-join that splits a busy symbol.
    """
    day = F.col("ts") if bucket is None else bucket
    days = fills.groupBy("symbol", "side", day.alias("_d")).agg(F.sum("quantity").alias("_q"))
    past = Window.partitionBy("symbol", "side").orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("symbol", "side", "_d", F.coalesce(F.sum("_q").over(past), F.lit(0)).alias("_before"))
    w = Window.partitionBy("symbol", "side", "_d").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    fills = fills.withColumn("_d", day).withColumn("_own", F.sum("quantity").over(w)).join(days, ["symbol", "side", "_d"])
    hi = F.col("_before") + F.col("_own")
    block = 1000
    r = fills.withColumn("hi", hi).withColumn("lo", F.col("hi") - F.col("quantity"))
    r = r.withColumn("b", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))))
    side = lambda s, p: r.where(F.col("side") == s).select("symbol", "b", F.col("id").alias(f"{s}_id"), F.col("lo").alias(f"{p}lo"), F.col("hi").alias(f"{p}hi"), F.col("price").alias(f"{p}price"))
    m = side("buy", "b").join(side("sell", "s"), ["symbol", "b"])
    lo, hi = F.greatest("blo", "slo", F.col("b") * block), F.least("bhi", "shi", (F.col("b") + 1) * block)
    q = hi - lo
    m = m.where(lo < hi).withColumn("q", q)
    return m.groupBy("symbol", "buy_id", "sell_id").agg(F.sum("q").alias("quantity"), F.sum(F.col("q") * (F.col("sprice") - F.col("bprice"))).alias("pnl"))


def reconcile(fills: DataFrame, opening: DataFrame, ending: DataFrame) -> DataFrame:
    """Opening plus movements against ending, for each symbol that any of them has."""
    signed = F.when(F.col("side") == "buy", F.col("quantity")).otherwise(-F.col("quantity"))
    moved = fills.groupBy("symbol").agg(F.sum(signed).alias("moved"))
    out = opening.withColumnRenamed("quantity", "opening").join(moved, "symbol", "full").join(ending.withColumnRenamed("quantity", "ending"), "symbol", "full")
    out = out.na.fill(0, ["opening", "moved", "ending"])
    return out.withColumn("difference", F.col("opening") + F.col("moved") - F.col("ending"))


def body_hash(number: Column, content: Column, previous: Column) -> Column:
    """The hash of a link's body: its number, its content and the hash of the link before."""
    return F.sha2(F.concat_ws("|", number.cast("string"), content, previous), 256)


def chained(rows: DataFrame, key: str, order: str, content: str) -> DataFrame:
    """(key, order, content, number, previous_hash, link_hash): each key's rows as a hash chain, every link over
    the one before. A chain is made link by link, so one task makes a key's whole chain: keys are accounts or
    runs of bounded length."""
    step = lambda acc, x: F.struct(
        (acc["k"] + 1).alias("k"), body_hash(acc["k"] + 1, x["content"], acc["last"]).alias("last"),
        F.array_append(acc["made"], F.struct(x["o"].alias("o"), x["content"].alias("content"), (acc["k"] + 1).alias("number"), acc["last"].alias("previous_hash"), body_hash(acc["k"] + 1, x["content"], acc["last"]).alias("link_hash"))).alias("made"),
    )
    listed = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(content).alias("content")))).alias("_l"))
    kind = rows.schema[order].dataType.simpleString()
    start = F.struct(F.lit(0).alias("k"), F.lit("").alias("last"), F.array().cast(f"array<struct<o:{kind},content:string,number:int,previous_hash:string,link_hash:string>>").alias("made"))
    return listed.select(key, F.inline(F.aggregate("_l", start, step)["made"])).withColumnRenamed("o", order).withColumnRenamed("content", content)


def verified(stored: DataFrame, key: str, content: str) -> DataFrame:
    """Stored links (key, number, content, previous_hash, link_hash) with what is wrong: a body that does not
    have its hash, a link that does not follow on the one before, a number that is missing. Each link is judged
    by itself and the stored link before it."""
    w = Window.partitionBy(key).orderBy("number")
    before, number = F.coalesce(F.lag("link_hash").over(w), F.lit("")), F.coalesce(F.lag("number").over(w), F.lit(0))
    rules = (
        (F.col("number") != number + 1, "missing_link"), (F.col("previous_hash") != before, "broken_link"), (body_hash(F.col("number"), F.col(content), F.col("previous_hash")) != F.col("link_hash"), "hash_mismatch"),
    )
    return stored.withColumn("faults", F.array_compact(F.array(*(F.when(rule, F.lit(name)) for rule, name in rules))))

"""Bars, quotes and trade-like rows from the star-schema tables.

A bar is (symbol, asset_class, ts, open, high, low, close, volume), one long table for all symbols. Bars are
aggregates with partial sums, so a busy symbol does not meet in one task before it is a few rows a day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bars(rows: DataFrame, symbol: Column, ts: Column, price: Column, order: Column, volume: Column) -> DataFrame:
    return rows.groupBy(symbol.alias("symbol"), ts.alias("ts")).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), volume.alias("volume")
    )


def asset_class(symbol: Column) -> Column:
    return F.when(symbol.isin("1-URGENT", "2-HIGH"), "crypto").otherwise("equity")


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars: symbol is the order priority, price the order total."""
    o = table(spark, sf_dir, "orders")
    bars = _bars(o, F.col("o_orderpriority"), F.col("o_orderdate"), F.col("o_totalprice"), F.col("o_orderkey"), F.sum("o_totalprice"))
    return bars.withColumn("asset_class", asset_class(F.col("symbol")))


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of positive event values; the session is the day."""
    e = table(spark, sf_dir, "events").where("value > 0")
    bars = _bars(e, F.col("event_type"), F.date_trunc("hour", "ts").cast("timestamp_ntz"), F.col("value"), F.struct("ts", "event_id"), F.count("*").cast("double"))
    return bars.withColumn("session", F.to_date("ts"))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes from events: the bid is the value, the ask lies k basis points above; k comes from JSON."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    return e.select("event_id", F.col("event_type").alias("symbol"), "ts", F.col("value").alias("bid"), (F.col("value") * (1 + k / 10000)).alias("ask"), (k + 1).alias("bid_size"), F.pmod("user_id", F.lit(7)).cast("double").alias("ask_size"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade-like rows from order lines, for the grouped reports."""
    r = F.col("l_discount") - F.col("l_tax")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("symbol"),
        F.when(F.col("l_returnflag") == "R", "crypto").otherwise("equity").alias("asset_class"),
        F.concat_ws("|", "l_linestatus", F.col("l_linenumber").cast("string")).alias("entry_state"),
        F.col("l_linestatus").alias("entry_state_family"),
        F.element_at(F.array(F.lit("state_change"), F.lit("time_exit"), F.lit("signal_flip")), F.pmod("l_linenumber", F.lit(3)).cast("int") + 1).alias("exit_reason"),
        r.alias("return_pct"),
        (r * F.col("l_extendedprice")).alias("pnl"),
        (-F.col("l_tax")).alias("mae_pct"),
        F.col("l_discount").alias("mfe_pct"),
        F.col("l_tax").alias("uncaptured_pct"),
        F.pmod(F.col("l_quantity").cast("int"), F.lit(15)).alias("hold_bars"),
        (F.col("l_discount") - 0.04).alias("expected_value"),
        F.col("l_extendedprice").alias("entry_notional"),
        F.col("l_shipdate").alias("exit_ts"),
        F.year("l_shipdate").alias("fold_id"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("trade_order"),
    )


def setups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trade-like rows with the transition they were entered on."""
    return trades(spark, sf_dir).withColumn("entry_transition_setup", F.concat_ws(">", "entry_state", "exit_reason"))


#: Trades up to this year are the past of the candidates, which come after it.
PAST_YEAR = 1998


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signal candidates after the past trades, from order lines: some flat, some in a state that the past
    never saw, some without a transition."""
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), F.pmod(n, F.lit(len(names))).cast("int") + 1)
    state = F.concat_ws("|", "l_linestatus", F.col("l_linenumber").cast("string"))
    signal = pick(("flat", "short", "long", "long", "long"), supp)
    return table(spark, sf_dir, "lineitem").where(F.year("l_shipdate") > PAST_YEAR).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_returnflag").alias("symbol"), F.when(F.col("l_returnflag") == "R", "crypto").otherwise("equity").alias("asset_class"),
        F.when(F.pmod(part, F.lit(11)) == 0, "unseen").otherwise(state).alias("state"),
        F.when(F.pmod(part, F.lit(13)) != 0, F.concat_ws(">", state, pick(("state_change", "time_exit", "signal_flip"), F.col("l_linenumber")))).alias("transition_setup"),
        F.col("l_linestatus").alias("state_family"), signal.alias("candidate_signal"),
        F.when(signal == "flat", pick(("insufficient_observations", "low_confidence", "negative_expected_value"), part)).alias("block_reason"),
        F.col("l_quantity").cast("int").alias("observations"), (F.col("l_discount") / 5 - 0.002).alias("base_score"), F.concat(F.lit("m"), F.pmod(supp, F.lit(2)).cast("string")).alias("model_name"),
        F.when(F.year("l_shipdate") == PAST_YEAR + 1, "validation").otherwise("test").alias("split"), F.col("l_shipdate").alias("ts"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream observations of two channels, with some prices missing and three generations of the stream."""
    odd = F.pmod("user_id", F.lit(2)) == 0
    return table(spark, sf_dir, "events").select(
        F.when(odd, "bars").otherwise("quotes").alias("channel"), F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias("symbol"), "ts", F.col("event_id").alias("seq"),
        F.when(F.pmod("event_id", F.lit(50)) != 0, F.col("value")).alias("price"), F.pmod("user_id", F.lit(3)).cast("int").alias("generation"),
    )


def pair_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars, and BASKET: the mean of two symbols, which moves with both."""
    b = daily_bars(spark, sf_dir).select("symbol", "ts", "open", "close")
    two = b.where(F.col("symbol").isin("1-URGENT", "2-HIGH")).groupBy("ts").agg(F.lit("BASKET").alias("symbol"), F.avg("open").alias("open"), F.avg("close").alias("close"), F.count("*").alias("n")).where("n = 2")
    return b.unionByName(two.select("symbol", "ts", "open", "close"))


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quote envelopes from events, with every kind of fault."""
    n, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("double")
    when = lambda m, odd, x: F.when(F.pmod(n, F.lit(m)) == 0, odd).otherwise(x)
    text = lambda x: x.cast("decimal(18,6)").cast("string")
    plus = lambda x: F.timestamp_add("SECOND", x, F.col("ts"))
    payload = F.struct(
        when(43, F.lit(None).cast("timestamp_ntz"), F.col("ts")).alias("t"), when(37, F.lit("x"), when(41, F.lit("0.000000"), text(F.col("value")))).alias("bp"), text(when(31, F.col("value") * 0.9, F.col("value") * (1 + k / 10000))).alias("ap"),
        when(29, F.lit(None).cast("string"), text(F.pmod(n, F.lit(5)).cast("double"))).alias("bs"), text(F.pmod(n, F.lit(7)).cast("double")).alias("as"),
    )
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("symbol"), when(19, F.lit("view"), F.col("event_type")).alias("expected_symbol"), when(23, F.lit("iex"), F.lit("sip")).alias("feed"),
        when(47, F.lit(None).cast("timestamp_ntz"), plus(F.pmod(n, F.lit(6)) - 2)).alias("received_at"), plus(F.pmod(n, F.lit(6)) - 2 + when(13, F.pmod(n, F.lit(4)) * 10 - 5, F.pmod(n, F.lit(4)))).alias("decision_at"),
        F.when(F.pmod(n, F.lit(17)) != 0, payload).alias("payload"),
    )

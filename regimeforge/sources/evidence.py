"""Account activities, lots, decisions with their evidence, option chains, positions and corporate actions, derived
from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ancestry
from .bars import daily_bars, hourly_bars, table

_LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def _id(letter: str, *columns: str) -> Column:
    return F.concat(F.lit(letter), F.concat_ws("-", *(F.col(c).cast("string") for c in columns)))


def _line_id() -> Column:
    """An order line's own id; keys alone are not unique, so the amount in cents belongs to it."""
    return F.concat_ws("-", _id("F", *_LINE), F.round(F.col("l_extendedprice") * 100).cast("long").cast("string"))


def _text(x: Column, kind: str = "decimal(15,2)") -> Column:
    return x.cast(kind).cast("string")


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers in credit are listed, with a multiplier of 1 or 100."""
    s = table(spark, sf_dir, "supplier").where("s_acctbal >= 0")
    return s.select(_id("S", "s_suppkey").alias("symbol"), F.when(F.pmod("s_nationkey", F.lit(2)) == 0, "1").otherwise("100").alias("multiplier"))


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills from order lines, cash and position activities from orders; amounts as text."""
    null = F.lit(None).cast("string")
    line = table(spark, sf_dir, "lineitem").select(
        _line_id().alias("id"), F.col("l_shipdate").alias("ts"), F.lit("FILL").alias("activity_type"), _id("S", "l_suppkey").alias("symbol"), F.when(F.pmod("l_linenumber", F.lit(2)) == 0, "sell").otherwise("buy").alias("side"),
        _text(F.col("l_quantity")).alias("qty"), _text(F.col("l_extendedprice")).alias("price"), _text(F.col("l_tax") * 10).alias("fee"), null.alias("net_amount"), null.alias("quantity_delta"),
    )
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "CSD").when(F.col("o_orderpriority") == "2-HIGH", "CSW").when(F.col("o_orderpriority") == "3-MEDIUM", "DIV").when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "FEE")
    kind = kind.when(F.col("o_orderstatus") == "P", "POSITION_ADJUSTMENT").otherwise("JNL")
    moves = kind == "POSITION_ADJUSTMENT"
    cash = table(spark, sf_dir, "orders").select(
        _id("C", "o_orderkey").alias("id"), F.col("o_orderdate").alias("ts"), kind.alias("activity_type"), F.when(moves, F.concat(F.lit("S"), F.pmod("o_custkey", F.lit(10)).cast("string"))).alias("symbol"), null.alias("side"), null.alias("qty"), null.alias("price"), null.alias("fee"),
        F.when(~moves, _text(F.when(F.col("o_orderstatus") == "F", -F.col("o_totalprice")).otherwise(F.col("o_totalprice")))).alias("net_amount"), F.when(moves, F.col("o_custkey").cast("string")).alias("quantity_delta"),
    )
    return line.unionByName(cash)


def signed_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid fills of listed instruments, with signed quantities."""
    q = F.col("l_quantity").cast("decimal(15,6)")
    line = table(spark, sf_dir, "lineitem").where("l_quantity >= 1").select(
        _id("S", "l_suppkey").alias("symbol"), _line_id().alias("id"), F.col("l_shipdate").alias("ts"), F.when(F.pmod("l_linenumber", F.lit(2)) == 0, -q).otherwise(q).cast("decimal(15,6)").alias("quantity"),
        F.col("l_extendedprice").cast("decimal(15,2)").cast("decimal(14,6)").alias("price"), (F.col("l_tax") * 10).cast("decimal(15,2)").cast("decimal(14,6)").alias("fee"),
    )
    return line.join(instruments(spark, sf_dir).select("symbol", F.col("multiplier").cast("decimal(6,0)").alias("multiplier")), "symbol")


def opening_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One lot for each listed instrument, long or short by its nation."""
    s = table(spark, sf_dir, "supplier").select(_id("S", "s_suppkey").alias("symbol"), _id("O", "s_suppkey").alias("id"), (F.col("s_nationkey") - 12).cast("decimal(15,6)").alias("quantity"))
    s = s.join(instruments(spark, sf_dir).select("symbol", F.col("multiplier").cast("decimal(6,0)").alias("multiplier")), "symbol")
    return s.select("symbol", "id", F.lit("1990-01-01").cast("timestamp_ntz").alias("ts"), "quantity", F.lit("1000").cast("decimal(14,6)").alias("price"), F.lit("1.5").cast("decimal(14,6)").alias("fee"), "multiplier")


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equity marks by the hour, with flows that run up by what was traded; the close before is on today's flows."""
    along, day = Window.partitionBy("symbol").orderBy("ts"), Window.partitionBy("symbol", "session")
    h = hourly_bars(spark, sf_dir).withColumn("flows", F.sum("volume").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    h = h.withColumn("equity", F.col("close") * 100 + F.col("flows"))
    ends = h.groupBy("symbol", "session").agg(F.max_by(F.struct("equity", "flows"), "ts").alias("x"))
    ends = ends.select("symbol", "session", F.lag("x").over(Window.partitionBy("symbol").orderBy("session")).alias("x"))
    h = h.join(ends, ["symbol", "session"])
    return h.select(F.col("symbol").alias("account"), "session", "ts", "equity", "flows", (F.col("x.equity") + F.min("flows").over(day) - F.col("x.flows")).alias("prior_close"))


def decision_ledger(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """decisions, inputs, evidence and links from orders and their lines, with every kind of fault: each order may
    amend the customer's one before; cheap ones amend the next one, or one that does not exist."""
    o = table(spark, sf_dir, "orders")
    mine = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    amends = F.when(F.col("o_totalprice") < 5000, F.lead("o_orderkey").over(mine)).when(F.col("o_totalprice") < 8000, F.col("o_orderkey") + 1_000_000_000_000).when(F.col("o_orderstatus") != "O", F.lag("o_orderkey").over(mine))
    o = o.withColumn("amends", amends)
    columns = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_quantity").cast("int").alias("q"), "l_tax", "l_discount")
    l = table(spark, sf_dir, "lineitem").where("l_quantity >= 0").select("l_orderkey", F.struct(*columns).alias("x"))
    # lines are gathered by order once; the inputs, the evidence and the hashes of decisions all come from that exchange
    by_order = l.where("l_orderkey is not null").repartition("l_orderkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("x")).alias("lines"))
    by_order = by_order.join(o.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey", "left")
    at, x = F.coalesce("o_orderdate", F.lit("1995-01-01").cast("timestamp_ntz")), F.col("x")
    event_at = F.timestamp_add("DAY", -x["q"], at)
    received_at = F.timestamp_add("DAY", x["l_linenumber"].cast("int"), event_at)
    payload = F.concat_ws("/", x["l_partkey"], x["l_suppkey"])
    sha = ancestry.input_hash(event_at, received_at, payload)
    inputs = by_order.select(F.col("l_orderkey").alias("decision_id"), "o_orderdate", F.posexplode("lines").alias("ordinal", "x")).select("decision_id", "ordinal", sha.alias("input_sha256"))
    each = by_order.select("o_orderdate", F.explode("lines").alias("x")).unionByName(l.where("l_orderkey is null").select(F.lit(None).cast("timestamp_ntz").alias("o_orderdate"), "x"))
    evidence = each.where("not (x.l_tax = 0 and x.l_discount = 0)").select(sha.alias("sha256"), event_at.alias("event_at"), received_at.alias("received_at"), F.when(x["l_tax"] > 0.075, F.concat(payload, F.lit("x"))).otherwise(payload).alias("payload"))
    listed = inputs.groupBy(F.col("decision_id").alias("o_orderkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "input_sha256"))), lambda y: y["input_sha256"]), ",").alias("all"))
    d = o.join(listed, "o_orderkey", "left")
    sha = ancestry.decision_hash(F.col("o_orderkey"), F.col("o_orderdate"), F.col("amends"), F.coalesce("all", F.lit("")))
    decisions = d.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("decided_at"), "amends", F.when(F.col("o_totalprice") > 490_000, F.reverse(sha)).otherwise(sha).alias("sha256"))
    links = o.where("o_orderstatus = 'F'").select(_id("L", "o_orderkey").alias("link_id"), F.col("o_orderkey").alias("decision_id"), F.timestamp_add("DAY", F.pmod("o_custkey", F.lit(40)).cast("int") - 1, F.col("o_orderdate")).alias("observed_at"))
    return {"decisions": decisions, "inputs": inputs, "evidence": evidence, "links": links}


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holding spans of order lines, on the daily bars of their order's priority."""
    l = table(spark, sf_dir, "lineitem").where("l_quantity >= 1").select(_line_id().alias("trade_id"), "l_orderkey", "l_discount", "l_returnflag", F.col("l_quantity").cast("int").alias("q"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("symbol"), "o_orderdate", "o_totalprice")
    p = l.join(o, "l_orderkey")
    return p.select(
        "trade_id", "symbol", F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("direction"), F.col("o_orderdate").alias("entry_ts"), F.timestamp_add("DAY", F.col("q") * 3, F.col("o_orderdate")).alias("exit_ts"),
        F.col("o_totalprice").alias("entry_price"), F.when(F.col("l_discount") > 0.085, F.col("o_totalprice") * 0.9).alias("stop_price"),
    )


def two_clock_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes that are received at their row's time; the event lies up to twelve hours before."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.timestamp_add("HOUR", -F.pmod("user_id", F.lit(13)).cast("int"), F.col("ts")).alias("event_at"), F.col("ts").alias("received_at"), "event_id", F.col("value").alias("bid"))


def option_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts from parts: the brand is the underlying."""
    expiry = F.date_add(F.lit("1995-01-15").cast("date"), (F.col("p_size") * 45).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("underlying"), _id("P", "p_partkey").alias("symbol"), expiry.alias("expiry"), F.round(F.col("p_retailprice") / 5).cast("double").alias("strike"), F.date_sub(expiry, 400).alias("first_session"), F.date_sub(expiry, 1).alias("last_session"))


def option_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("decision_id"), F.concat(F.lit("Brand#"), (F.pmod("o_custkey", F.lit(25)) + 1).cast("string")).alias("underlying"), F.to_date("o_orderdate").alias("session"), (180 + F.pmod("o_custkey", F.lit(40)) / 2).alias("midpoint"))


def corporate_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending orders of a priority and day are its dividend; two or more are a split as well. The sum is freed of what the order of its
    terms leaves in its last digits, so that a half is rounded alike in every run."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    a = o.groupBy(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("ts")).agg(F.count("*").alias("n"), F.round(F.round(F.sum("o_totalprice"), 6) / 1000, 2).alias("dividend"))
    return a.select("symbol", "ts", F.when(F.col("n") > 1, 2.0).otherwise(1.0).alias("split_ratio"), "dividend")


def adjusted_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily closes with the scale of a series that is adjusted for every action after the day."""
    b = daily_bars(spark, sf_dir).join(corporate_actions(spark, sf_dir).select("symbol", "ts", "dividend"), ["symbol", "ts"], "left")
    after = Window.partitionBy("symbol").orderBy("ts").rowsBetween(1, Window.unboundedFollowing)
    return b.select("symbol", "ts", "close", (1 / (1 + F.coalesce(F.count("dividend").over(after), F.lit(0)) / 1000)).alias("scale"))


def monthly_returns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """(month, a return for each symbol) and the symbols: a joint series of the months in which all have a bar."""
    b = daily_bars(spark, sf_dir).groupBy("symbol", F.trunc("ts", "month").alias("month")).agg(F.max_by("close", "ts").alias("close"))
    names = [r[0] for r in b.select("symbol").distinct().orderBy("symbol").collect()]  # the order priorities
    b = b.withColumn("r", F.col("close") / F.lag("close").over(Window.partitionBy("symbol").orderBy("month")) - 1)
    return b.groupBy("month").pivot("symbol", names).agg(F.max("r")).na.drop(), names


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market scans from events, with every kind of fault. The time of the scan is the event's."""
    n, k, ts, v = F.col("event_id"), F.get_json_object("props", "$.k").cast("int"), F.col("ts").cast("timestamp"), F.col("value")
    ago = lambda s: F.timestamp_add("SECOND", -s.cast("int"), ts)
    each = lambda m: F.pmod(n, F.lit(m)) == 0
    return table(spark, sf_dir, "events").select(
        F.concat_ws("/", "event_type", F.pmod("user_id", F.lit(20)).cast("string")).alias("symbol"), F.when(F.col("event_type") == "click", "crypto").when(F.col("event_type") == "error", "futures").otherwise("us_equity").alias("asset_class"), ts.alias("scan_at"),
        F.when(~each(31), F.hour(ts).between(9, 15)).alias("market_open"), F.when(each(29), "batch_failed").alias("failure"), (~each(17)).alias("answered"), v.alias("trade_price"), F.when(each(37), ago(F.lit(-10))).otherwise(ago(k * 5)).alias("trade_at"),
        (v * 1.01).alias("day_close"), (F.col("user_id") * 10.0 - 10).alias("day_volume"), ago(F.lit(3600)).alias("day_at"), (v * 0.98).alias("prior_close"), ago(F.lit(86_400)).alias("prior_at"), (v * 0.999).alias("bid"), (v * (1 + (k - 15) / 10_000)).alias("ask"), ago(k * 4).alias("quote_at"),
    )

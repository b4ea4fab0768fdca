"""Account ledgers: typed activities, imports that can be repeated, reconciliation, signed lots, risk latches.

Money is decimal, never double. Quantities have up to 9 digits before and 6 after the point, prices 8 and 6,
multipliers 6 and 0, so that quantity * price * multiplier is exact in decimal(36,12), and so is the sum of two such amounts
in the 38 digits that Spark has; what does not fit is a fault.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import store

QUANTITY, PRICE, MULTIPLIER, MONEY = "decimal(15,6)", "decimal(14,6)", "decimal(6,0)", "decimal(36,12)"
UNITS = 1_000_000
#: Activity types that move cash only, and the sign that some of them must have.
CASH_TYPES, SIGNS = ("CSD", "CSW", "DIV", "INT", "FEE", "CASH_ADJUSTMENT"), {"CSD": 1, "CSW": -1, "FEE": -1}
EXTERNAL = ("CSD", "CSW")


def exact(text: Column, kind: str) -> Column:
    """The decimal that the text says, or null if it is none or does not fit the type without rounding."""
    wide = text.try_cast("decimal(38,18)")
    return F.when(wide == wide.try_cast(kind), wide.try_cast(kind))


def normalized(activities: DataFrame, instruments: DataFrame) -> DataFrame:
    """(id, ts, kind, symbol, quantity, cash, external_cashflow, fee, faults): activities in one typed form.

    ``activities``: id, ts, activity_type, symbol, and as text side, qty, price, fee, net_amount, quantity_delta.
    ``instruments``: symbol, multiplier (text). A fill changes quantity and cash; its cash is -quantity * price *
    multiplier - fee. Deposits and withdrawals are external. A row with a fault keeps its id and kind and moves
    nothing. Null columns are faults where the type needs them, nothing is guessed; repeated rows stay.
    """
    a = activities.join(instruments.groupBy("symbol").agg(F.min("multiplier").alias("_mult"), F.count_distinct("multiplier").alias("_ways")), "symbol", "left")
    qty, price, fee, mult = exact(F.col("qty"), QUANTITY), exact(F.col("price"), PRICE), exact(F.coalesce("fee", F.lit("0")), PRICE), exact(F.col("_mult"), MULTIPLIER)
    net, delta, kind = exact(F.col("net_amount"), "decimal(20,6)"), exact(F.col("quantity_delta"), QUANTITY), F.col("activity_type")
    fill, cash_only, moves = kind == "FILL", kind.isin(*CASH_TYPES), kind == "POSITION_ADJUSTMENT"
    wrong = F.lit(False)
    for name, sign in SIGNS.items():
        wrong = wrong | ((kind == name) & ((net * sign < 0) | ((net == 0) & (name != "FEE"))))
    no = lambda x: ~F.coalesce(x, F.lit(False))
    rules = (
        (F.trim(F.coalesce("id", F.lit(""))) == "", "missing_id"), (F.col("ts").isNull(), "missing_timestamp"), (no(fill | cash_only | moves), "unsupported_type"),
        (fill & ~F.coalesce(F.col("_ways") == 1, F.lit(False)), "multiplier_missing"), (fill & no((qty > 0) & (price >= 0) & (fee >= 0) & (mult > 0) & F.col("side").isin("buy", "sell")) & (F.col("_ways") == 1), "invalid_fill"),
        (cash_only & net.isNull(), "invalid_amount"), (cash_only & F.coalesce(wrong, F.lit(False)), "sign_contradiction"), (moves & (F.coalesce("symbol", F.lit("")) == ""), "missing_symbol"), (moves & delta.isNull(), "invalid_amount"),
    )
    out = a.withColumn("faults", F.array_compact(F.array(*(F.when(F.coalesce(rule, F.lit(False)), name) for rule, name in rules))))
    good = F.size("faults") == 0
    signed = F.when(F.col("side") == "buy", qty).otherwise((-qty).cast(QUANTITY))
    zero = F.lit(0)
    pay = ((-signed).cast(QUANTITY) * price * mult).cast(MONEY)
    return out.select(
        "id", "ts", kind.alias("kind"), F.when(fill | moves, F.col("symbol")).alias("symbol"), F.when(good & fill, signed).when(good & moves, delta).otherwise(zero).cast(QUANTITY).alias("quantity"),
        F.when(good & fill, (pay - fee).cast(MONEY)).when(good & cash_only, net.cast(MONEY)).otherwise(zero).cast(MONEY).alias("cash"), F.when(good & kind.isin(*EXTERNAL), net).otherwise(zero).cast(MONEY).alias("external_cashflow"),
        F.when(good & fill, fee.cast(MONEY)).when(good & (kind == "FEE"), (-net).cast(MONEY)).otherwise(zero).cast(MONEY).alias("fee"), F.concat_ws(",", "faults").alias("faults"),
    )


class Ledger:
    """Events by id in a folder, in files by the hash of the id.

    An import is all or nothing. It is rejected if a row has a fault or no id, or if an id, in the ledger or twice in the
    import, comes with other evidence than before; equal repeats add nothing, so an import can be repeated after any
    failure. Rows are compared by joins on the id; only counts come back to the driver. Rows that come from ``placed`` are not
    exchanged again, neither to be compared nor to be added, and what is written is the new rows only.
    """

    #: Files of the ledger, and of the tables that are to meet it without an exchange.
    BUCKETS = 128

    def __init__(self, spark: SparkSession, path: str, schema) -> None:
        self.spark, self.schema = spark, schema
        self.table = store.bucketed(spark, schema, path, "id", self.BUCKETS)

    @classmethod
    def placed(cls, rows: DataFrame, label: str, exchange: bool = True) -> DataFrame:
        """``rows`` written in the same files as the ledger's ids and read back."""
        spark = rows.sparkSession
        name = store.bucketed(spark, rows.schema, store.fresh_path(spark, label), "id", cls.BUCKETS)
        (rows.repartition(cls.BUCKETS, "id") if exchange else rows).write.insertInto(name)
        return spark.table(name)

    def events(self) -> DataFrame:
        return self.spark.table(self.table)

    def load(self, name: str, rows: DataFrame) -> dict[str, int | bool | str]:
        """Import ``rows`` (columns of the schema, id and faults among them) under a name for the report."""
        evidence = F.struct(*(F.col(c) for c in self.schema.fieldNames()))
        own = rows.groupBy("id").agg(F.count("*").alias("n"), F.min(evidence).alias("body"), F.max(evidence).alias("last"), F.count_if((F.coalesce("faults", F.lit("")) != "") | F.col("id").isNull()).alias("bad"))
        old = self.events().select("id", evidence.alias("old"))
        own = own.join(old, own["id"] == old["id"], "left").drop(old["id"])
        differs = ~(F.col("body").eqNullSafe(F.col("last")) & (F.col("old").isNull() | F.col("body").eqNullSafe(F.col("old"))))
        counts = Observation()
        own = own.observe(
            counts, F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count_if(F.col("old").isNull()).alias("new"), F.count_if(differs).alias("conflicts"), F.coalesce(F.sum("bad"), F.lit(0)).alias("faulty")
        )
        # counted and set aside in one pass, so that what is added is what was judged
        fresh = self.placed(own.where("old is null").select("id", *(F.col(f"body.{c}") for c in self.schema.fieldNames() if c != "id")), "import", exchange=False)
        seen = counts.get
        accepted = seen["conflicts"] == 0 and seen["faulty"] == 0
        if accepted and seen["new"]:
            fresh.select(*self.schema.fieldNames()).write.insertInto(self.table)
        return {"batch": name, "rows": seen["rows"], "new_events": seen["new"] if accepted else 0, "conflicts": seen["conflicts"], "faulty": seen["faulty"], "accepted": accepted}


def reconciled(events: DataFrame, opening: DataFrame, ending: DataFrame) -> DataFrame:
    """(item, opening, moved, ending, difference): opening plus movements less ending, for ``cash`` and for each
    symbol that any of the three has. Snapshots: item (a symbol, or null for cash), amount."""
    cash = events.select(F.lit(None).cast("string").alias("item"), F.col("cash").alias("amount"))
    moved = cash.unionByName(events.where("symbol is not null").select(F.col("symbol").alias("item"), F.col("quantity").cast(MONEY).alias("amount")))
    parts = None
    for name, df in (("opening", opening), ("moved", moved), ("ending", ending)):
        part = df.select("item", *(F.when(F.lit(name == c), F.col("amount").cast(MONEY)).alias(c) for c in ("opening", "moved", "ending")))
        parts = part if parts is None else parts.unionByName(part)
    out = parts.groupBy("item").agg(*(F.coalesce(F.sum(c), F.lit(0)).cast(MONEY).alias(c) for c in ("opening", "moved", "ending")))
    return out.select(F.coalesce("item", F.lit("cash")).alias("item"), "opening", "moved", "ending", (F.col("opening") + F.col("moved") - F.col("ending")).alias("difference"))


#: A symbol with more fills than this is split by time and by stretches of its axes; mean fills in a stretch.
BUSY, STRETCH = 100_000, 1000


def _past(rows: DataFrame, **sums: Column) -> DataFrame:
    """(symbol, _b, names): sums over a symbol's buckets of time before each one, and over all of them (name_all)."""
    within = rows.groupBy("symbol", "_b").agg(*(x.alias(n) for n, x in sums.items()))
    by = Window.partitionBy("symbol")
    before = by.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    over = lambda n, w: F.coalesce(F.sum(n).over(w), F.lit(0))
    return within.select("symbol", "_b", *(over(n, before).alias(n) for n in sums), *(over(n, by).alias(f"{n}_all") for n in sums))


def _points(parts: DataFrame, split: DataFrame | None = None) -> DataFrame:
    """(symbol, dir, _k, at, starts, role, closed, held): where ranges begin on the two axes of a symbol, one for each direction.

    ``parts``: symbol, _late, ts, id, price, fee, multiplier, _q. Windows by symbol give all, but with ``split`` (symbol, _width: the
    length of a stretch) running sums are taken within _b, a bucket of time, and added to those of the buckets before; a
    range that goes on into other stretches has a point (not ``starts``) at the head of each of them.
    """
    keys = ["symbol"] if split is None else ["symbol", "_b"]
    along = Window.partitionBy(*keys).orderBy("_late", F.asc_nulls_last("ts"), "id").rowsBetween(Window.unboundedPreceding, 0)
    rows = parts.withColumn("_lo", F.sum("_q").over(along) - F.col("_q"))
    if split is not None:
        rows = rows.join(_past(parts, _p=F.sum("_q")), keys).withColumn("_lo", F.col("_lo") + F.col("_p"))
    rows = rows.withColumn("_close", F.when(F.signum("_lo") * F.signum("_q") < 0, F.least(F.abs("_lo"), F.abs("_q"))).otherwise(0).cast("long"))
    rows = rows.withColumns({"_open": F.abs("_q") - F.col("_close"), "_buy": F.col("_q") > 0})
    # a buy opens on the long axis and closes on the short one, a sale the other way
    sides = (F.col("_buy"), ~F.col("_buy"))
    so_far = lambda role: F.coalesce(*(F.when(side, F.sum(F.when(side, F.col(role)).otherwise(0)).over(along)) for side in sides))
    rows = rows.withColumns({"_open_hi": so_far("_open"), "_close_hi": so_far("_close")})
    if split is not None:
        rows = store.stored(rows.drop("_late", "ts", "quantity", "_lo", "_p", "_p_all"), "lots")
        past = _past(rows, **{f"_{role}_{n}": F.max(F.when(side, F.col(f"_{role}_hi"))) for role in ("open", "close") for n, side in zip(("buy", "sale"), sides, strict=True)})
        rows = rows.join(past, keys).join(F.broadcast(split), "symbol")
        own = lambda role: F.col(f"_{role}_hi") + F.when(F.col("_buy"), F.col(f"_{role}_buy")).otherwise(F.col(f"_{role}_sale"))
        rows = rows.withColumns({"_open_hi": own("open"), "_close_hi": own("close"), "closed": F.when(F.col("_buy"), F.col("_close_sale_all")).otherwise(F.col("_close_buy_all"))})
    else:
        total = lambda side: F.sum(F.when(side, F.col("_close")).otherwise(0)).over(Window.partitionBy("symbol"))
        rows = rows.withColumn("closed", F.when(F.col("_buy"), total(~F.col("_buy"))).otherwise(total(F.col("_buy"))))
    sign = F.when(F.col("_buy"), 1).otherwise(-1)
    lot = F.struct("id", "price", "fee", "multiplier", F.abs("_q").alias("all"))
    point = lambda role, direction: F.struct(F.lit(role).alias("role"), direction.alias("dir"), F.struct(F.col(f"_{role}_hi").alias("hi"), (F.col(f"_{role}_hi") - F.col(f"_{role}")).alias("lo"), lot.alias("lot")).alias("held"))
    each = F.explode(F.filter(F.array(point("close", -sign), point("open", sign)), lambda x: x["held"]["hi"] > x["held"]["lo"]))
    rows = rows.withColumn("x", each).select("*", "x.*")
    if split is None:
        return rows.select("symbol", "dir", F.lit(0).alias("_k"), F.col("held.lo").alias("at"), F.lit(True).alias("starts"), "role", "closed", "held")
    first = F.expr("held.lo div _width")
    rows = rows.withColumn("_k", F.explode(F.sequence(first, F.expr("(held.hi - 1) div _width"))))
    return rows.select("symbol", "dir", "_k", F.greatest("held.lo", F.col("_k") * F.col("_width")).alias("at"), (F.col("_k") == first).alias("starts"), "role", "closed", "held")


def _met(points: DataFrame) -> DataFrame:
    """Points where ranges begin, with the lot (open) and the fill (close) that hold there."""
    here = Window.partitionBy("symbol", "dir", "_k").orderBy("at", "starts", "role").rowsBetween(Window.unboundedPreceding, 0)
    return points.withColumns({r: F.last(F.when(F.col("role") == r, F.col("held")), True).over(here) for r in ("open", "close")}).where("starts").drop("held", "_k")


def signed_lots(fills: DataFrame, opening: DataFrame | None = None, bucket: Column | None = None, busy: int = BUSY, stretch: int = STRETCH) -> DataFrame:
    """(symbol, direction, open_id, close_id, quantity, gross, fees, net): lots matched first in, first out, long and
    short, with what stays open (close_id null, gross and net null, fees those of the rest).

    ``fills``: symbol, id, ts, quantity (signed), price, fee, multiplier; ``opening`` has lots from before with the
    same columns. A fill against the position closes, and what is more than the position opens the other
    way. Since a position turns only when all of it is closed, the k-th unit opened in a direction is closed by
    the k-th unit closed in it. Both become ranges on one axis, and each point where a range begins pairs the lot and
    the fill that hold there: one sorted pass, in proportion to fills however large they are. Fills are exchanged once, by
    symbol. Only symbols with more than ``busy`` fills, counted first, are split by ``bucket`` of time (default: day) and then by
    stretches of the axis; their opened and closed units are written to the shared folder, as they are read twice. Fees
    are shared by quantity.
    """
    cut = F.to_date("ts") if bucket is None else bucket
    parts = fills.select(F.lit(1).alias("_late"), "symbol", "id", "ts", "quantity", "price", "fee", "multiplier")
    if opening is not None:
        parts = parts.unionByName(opening.select(F.lit(0).alias("_late"), "symbol", "id", "ts", "quantity", "price", "fee", "multiplier"))
    parts = parts.withColumn("_q", (F.col("quantity") * UNITS).cast("long")).where("_q <> 0 and symbol is not null")
    # a stretch is as long as many mean fills of the symbol, so ranges go on into few others
    split = parts.groupBy("symbol").agg(F.count("*").alias("_n"), F.ceil(F.sum(F.abs("_q")) / F.count("*") * stretch).alias("_width")).where(F.col("_n") > busy)
    split = store.stored(split.select("symbol", "_width"), "busy")
    if split.isEmpty():
        met = _met(_points(parts))
    else:
        quiet, loud = (parts.join(F.broadcast(split), "symbol", how) for how in ("left_anti", "left_semi"))
        loud = loud.withColumn("_b", F.struct("_late", cut.isNull().alias("none"), cut.alias("b")))
        met = _met(_points(quiet)).unionByName(_met(_points(loud, split)))

    units = (F.least("open.hi", "close.hi") - F.col("at")).cast("long")
    whole = lambda n: n.cast("decimal(15,0)")
    share = lambda of, n: (F.col(f"{of}.lot.fee").cast(PRICE) * (whole(n) / whole(F.col(f"{of}.lot.all")))).cast(MONEY)
    amount = lambda n: (n.cast("decimal(18,0)") / UNITS).cast(QUANTITY)
    gain = (F.col("close.lot.price") - F.col("open.lot.price")).cast("decimal(15,6)")
    gross = ((amount(units) * F.col("dir")).cast(QUANTITY) * gain * F.col("open.lot.multiplier").cast(MULTIPLIER)).cast(MONEY)
    left = (F.col("open.hi") - F.greatest("open.lo", "closed")).cast("long")
    # a point is a pair, or where a lot opens its rest, or both: one pass gives either
    result = lambda close_id, n, gross, fees: F.struct(close_id.cast(fills.schema["id"].dataType).alias("close_id"), amount(n).alias("quantity"), gross.cast(MONEY).alias("gross"), fees.cast(MONEY).alias("fees"))
    pair = F.when(F.col("open").isNotNull() & F.col("close").isNotNull() & (units > 0), result(F.col("close.lot.id"), units, gross, share("open", units) + share("close", units)))
    rest = F.when((F.col("role") == "open") & (left > 0), result(F.lit(None), left, F.lit(None), share("open", left)))
    out = met.select("symbol", F.col("dir").alias("direction"), F.col("open.lot.id").alias("open_id"), F.explode(F.array_compact(F.array(pair, rest))).alias("x"))
    return out.select("symbol", "direction", "open_id", "x.*").withColumn("net", (F.col("gross") - F.col("fees")).cast(MONEY))


#: Loss in a session and from the high-water mark at which new risk stops.
DAILY_LOSS, DRAWDOWN = 0.005, 0.03


def halts(marks: DataFrame) -> DataFrame:
    """``marks`` with high_water, daily_baseline, daily_halt, drawdown_halt and reason.

    ``marks``: account, session, ts, equity, flows (all external cash so far), prior_close (equity at the close before,
    null in an account's first session). Flows move both marks. The daily latch is reset by a session, the other one
    never. A mark without positive equity, baseline or high-water mark changes nothing and is reported; so is a
    session after the first that has no prior close. High-water marks are running maxima of equity less flows: within a session, and
    over the sessions before it, so no account is one task.
    """
    sessions = marks.groupBy("account", "session").agg(F.min("ts").alias("_t")).withColumn("_nth", F.row_number().over(Window.partitionBy("account").orderBy("session"))).drop("_t")
    within = Window.partitionBy("account", "session").orderBy("ts")
    so_far = within.rowsBetween(Window.unboundedPreceding, 0)
    first = lambda c: F.first(c).over(so_far)
    m = marks.join(sessions, ["account", "session"])
    m = m.withColumn("daily_baseline", F.when(F.col("_nth") == 1, first("equity")).otherwise(first("prior_close")) + F.col("flows") - first("flows"))
    m = m.withColumn("_bad", ~F.coalesce((F.col("equity") > 0) & (F.col("daily_baseline") > 0), F.lit(False)))
    own = F.when(~F.col("_bad"), F.col("equity") - F.col("flows"))
    tops = m.groupBy("account", "session").agg(F.max(own).alias("_top"))
    past = Window.partitionBy("account").orderBy("session").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("account", "session", F.max("_top").over(past).alias("_top"))
    m = m.join(tops, ["account", "session"]).withColumn("high_water", F.greatest(F.max(own).over(so_far), "_top") + F.col("flows"))
    m = m.withColumn("_bad", F.col("_bad") | ~F.coalesce(F.col("high_water") > 0, F.lit(False)))
    hit = lambda base, loss: F.when(~F.col("_bad"), F.col("equity") <= F.col(base) * (1 - loss)).otherwise(False)
    m = m.withColumns({"_day": hit("daily_baseline", DAILY_LOSS), "_draw": hit("high_water", DRAWDOWN)})
    drawn = m.groupBy("account", "session").agg(F.max("_draw").alias("_was"))
    drawn = drawn.select("account", "session", F.coalesce(F.max("_was").over(past), F.lit(False)).alias("_was"))
    m = m.join(drawn, ["account", "session"]).withColumns({"daily_halt": F.max("_day").over(so_far), "drawdown_halt": F.col("_was") | F.max("_draw").over(so_far)})
    data = F.when((F.col("_nth") > 1) & F.first("prior_close").over(so_far).isNull(), "missing_or_invalid_session_baseline").when(F.col("_bad"), "invalid_equity_or_baseline")
    reason = F.when(F.col("drawdown_halt"), "drawdown_halt").when(data.isNotNull(), data).when(F.col("daily_halt"), "daily_halt").otherwise("allowed")
    return m.withColumn("reason", reason).select(*marks.columns, "high_water", "daily_baseline", "daily_halt", "drawdown_halt", "reason")

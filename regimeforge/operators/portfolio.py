"""Equity curves: returns, drawdown, ratios, identities, and folds of a timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import nullif, order

ANNUAL = 252


def buy_and_hold(bars: DataFrame, capital: float = 100_000.0) -> DataFrame:
    """(symbol, ts, equity): one account for each symbol that buys at the first close."""
    first = bars.groupBy("symbol").agg(F.min_by("close", "ts").alias("first_close"))
    return bars.join(F.broadcast(first), "symbol").select("symbol", "ts", (capital * F.col("close") / F.col("first_close")).alias("equity"))


def marked(equity: DataFrame) -> DataFrame:
    """Returns, running peak and drawdown of each account."""
    e = F.col("equity")
    so_far = order().rowsBetween(Window.unboundedPreceding, 0)
    return equity.withColumns({"ret": e / F.lag(e).over(order()) - 1, "drawdown": e / F.max(e).over(so_far) - 1})


def metrics(equity: DataFrame, annual: int = ANNUAL) -> DataFrame:
    """Total return, growth rate, Sharpe, Sortino, drawdown and Calmar of each account."""
    r = F.col("ret")
    m = marked(equity).groupBy("symbol").agg(
        F.min_by("equity", "ts").alias("a"), F.max_by("equity", "ts").alias("b"), F.datediff(F.max("ts"), F.min("ts")).alias("days"), F.count("*").alias("n"),
        F.avg(r).alias("mean"), F.stddev_samp(r).alias("sd"), F.sqrt(F.avg(F.when(r.isNotNull(), F.pow(F.least(r, F.lit(0.0)), F.lit(2.0))))).alias("down"), F.min("drawdown").alias("max_drawdown"),
    )
    years = F.when(F.col("days") > 0, F.col("days") / 365.25).otherwise(F.col("n") / float(annual))
    root = F.sqrt(F.lit(float(annual)))
    out = m.select(
        "symbol", (F.col("b") / F.col("a") - 1).alias("total_return"), (F.pow(F.col("b") / F.col("a"), 1 / years) - 1).alias("cagr"),
        F.coalesce(root * F.col("mean") / nullif(F.col("sd")), F.lit(0.0)).alias("sharpe"), F.coalesce(root * F.col("mean") / nullif(F.col("down")), F.lit(0.0)).alias("sortino"), "max_drawdown",
    )
    return out.withColumn("calmar", F.when(F.col("max_drawdown") < 0, F.col("cagr") / F.abs(nullif(F.col("max_drawdown")))).otherwise(0.0))


def concentration(equity: DataFrame, days: int = 5) -> DataFrame:
    """Profit of each account with and without its best days."""
    pnl = F.col("equity") - F.lag("equity").over(order())
    w = Window.partitionBy("symbol").orderBy(F.col("pnl").desc_nulls_last(), "ts")
    ranked = equity.withColumn("pnl", pnl).where("pnl is not null").withColumn("n", F.row_number().over(w))
    return ranked.groupBy("symbol").agg(F.sum("pnl").alias("total"), F.sum(F.when(F.col("n") > days, F.col("pnl")).otherwise(0.0)).alias("without_best"))


def halt_latch(equity: DataFrame, limit: float) -> DataFrame:
    """Once the drawdown has passed the limit, every later mark is blocked."""
    so_far = order().rowsBetween(Window.unboundedPreceding, 0)
    return marked(equity).withColumn("blocked", F.max((F.col("drawdown") <= -limit).cast("int")).over(so_far) == 1)


def leave_one_out(equity: DataFrame) -> DataFrame:
    """Total profit without each symbol in turn: a total less the symbol's own."""
    own = equity.groupBy("symbol").agg((F.max_by("equity", "ts") - F.min_by("equity", "ts")).alias("own"))
    return own.select("symbol", (F.sum("own").over(Window.partitionBy()) - F.col("own")).alias("pnl_without"))


def folds(bars: DataFrame, train: int, validation: int, test: int, step: int) -> DataFrame:
    """(fold_id, part, first_ts, last_ts): rolling folds over the union timeline. The timeline has a row
    for each distinct time."""
    timeline = bars.select("ts").distinct().withColumn("n", F.row_number().over(Window.orderBy("ts")) - 1)
    width = train + validation + test
    size = timeline.agg(F.count("*").alias("size"))
    starts = size.where(F.col("size") >= width).select(F.explode(F.sequence(F.lit(0), F.col("size") - width, F.lit(step))).alias("s"))
    parts = F.array(*(F.struct(F.lit(p).alias("part"), F.lit(a).alias("a"), F.lit(b).alias("b")) for p, a, b in (("train", 0, train), ("validation", train, train + validation), ("test", train + validation, width))))
    spans = starts.select((F.col("s") / step + 1).cast("long").alias("fold_id"), "s", F.inline(parts)).select("fold_id", "part", (F.col("s") + F.col("a")).alias("lo"), (F.col("s") + F.col("b") - 1).alias("hi"))
    lo, hi = timeline.select(F.col("n").alias("lo"), F.col("ts").alias("first_ts")), timeline.select(F.col("n").alias("hi"), F.col("ts").alias("last_ts"))
    return spans.join(lo, "lo").join(hi, "hi").select("fold_id", "part", "first_ts", "last_ts")


def sliced(bars: DataFrame, spans: DataFrame) -> DataFrame:
    """The bars of each fold part: a range join against the few spans, which are broadcast."""
    return bars.join(F.broadcast(spans), (bars["ts"] >= spans["first_ts"]) & (bars["ts"] <= spans["last_ts"])).drop("first_ts", "last_ts")

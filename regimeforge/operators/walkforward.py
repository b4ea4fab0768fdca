"""State statistics as of each bar and as of each fold, and the signals that follow from them.

No model is refitted in a loop. As of each bar, the statistics of its state are running sums over the labels that
had come true by then. As of each fold, they are one aggregate of all rows dealt out to the folds whose span they
lie in, so all folds are one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import order
from . import markov
from .signals import DEFAULT, SignalConfig, decided

#: Bars before the first walk-forward signal, bars a symbol needs in a fold's training part.
MIN_TRAINING_BARS, MIN_FOLD_BARS = 175, 126


def as_of_statistics(frame: DataFrame, horizon: int = markov.HORIZON, forward: int = markov.FORWARD, smoothing: float = markov.SMOOTHING) -> DataFrame:
    """(symbol, ts, state, n, observations, mean_return, sd_return, confidence, predicted) of each bar: what the bars
    up to and including it say about its state. ``n`` counts the symbol's bars before it.

    A label is known from the bar at which it comes true, ``horizon`` or ``forward`` bars later, so later bars change
    nothing. Transitions, returns and the bars that ask are three rows in one window by symbol and state; an
    equal pair's repeats carry the number that the count has reached, from which the row's entropy and its likeliest
    next state are running sums and maxima too. Ties go to the first label.
    """
    along = order()
    rows = markov.labelled(frame, horizon, forward).withColumn("n", F.row_number().over(along) - 1)
    new = F.row_number().over(Window.partitionBy("symbol", "state").orderBy("n")) == 1
    rows = rows.withColumn("_new", new.cast("int"))
    so_far = along.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"states": F.sum("_new").over(so_far), "_first": F.min("state").over(so_far)})
    ranks = rows.groupBy("symbol", "state").agg(F.count("*").alias("_c")).withColumn("_rank", F.row_number().over(Window.partitionBy("symbol").orderBy("state"))).select("symbol", F.col("state").alias("next_state"), "_rank")

    moved = rows.where("next_state is not null").select("symbol", "state", "n", "next_state").join(ranks, ["symbol", "next_state"])
    k = F.row_number().over(Window.partitionBy("symbol", "state", "next_state").orderBy("n")).cast("double") + smoothing
    w_log_w = lambda w: w * F.when(w > 0, F.log(w)).otherwise(0.0)
    moved = moved.withColumn("_k", k)
    null = lambda kind: F.lit(None).cast(kind)
    blank = {"at": null("int"), "kind": F.lit(0), "trans": null("int"), "gain": null("double"), "top": null("struct<k:double,rank:int,next:string>"), "ret": null("double"), "ts": null(rows.schema["ts"].dataType.simpleString()), "n": null("int"), "states": null("long"), "first": null("string")}

    def event(df: DataFrame, **own: Column) -> DataFrame:
        return df.select("symbol", "state", *(own.get(c, v).alias(c) for c, v in blank.items()))

    events = event(moved, at=F.col("n") + horizon, trans=F.lit(1), gain=w_log_w(F.col("_k")) - w_log_w(F.col("_k") - 1), top=F.struct(F.col("_k").alias("k"), (-F.col("_rank")).alias("rank"), F.col("next_state").alias("next")))
    events = events.unionByName(event(rows.where("forward_return is not null"), at=F.col("n") + forward, ret=F.col("forward_return")))
    events = events.unionByName(event(rows, at=F.col("n"), kind=F.lit(1), ts=F.col("ts"), n=F.col("n"), states=F.col("states"), first=F.col("_first")))
    run = Window.partitionBy("symbol", "state").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.coalesce(F.sum("trans").over(run), F.lit(0)).cast("double")
    known = events.withColumns({
        "_trans": seen, "_gain": F.coalesce(F.sum("gain").over(run), F.lit(0.0)), "_top": F.max("top").over(run),
        "observations": F.count("ret").over(run), "mean_return": F.avg("ret").over(run), "sd_return": F.stddev_samp("ret").over(run),
    }).where("kind = 1")
    base = F.lit(smoothing) * F.log(F.lit(smoothing)) if smoothing > 0 else F.lit(0.0)
    total = F.col("_trans") + smoothing * F.col("states")
    return known.select(
        "symbol", "ts", "state", "n", "observations", "mean_return", "sd_return",
        F.when(total > 0, markov.certainty(F.col("_gain") + base * F.col("states"), total, F.col("states"))).alias("confidence"), F.coalesce("_top.next", "first").alias("predicted"),
    )


def historical_signals(frame: DataFrame, c: SignalConfig = DEFAULT, min_training_bars: int = MIN_TRAINING_BARS) -> DataFrame:
    """The signal of each bar from what the bars up to it say; the first ``min_training_bars`` bars of a symbol
    have none."""
    known = as_of_statistics(frame).where(F.col("n") >= min_training_bars).drop("state", "n", "sd_return")
    return decided(frame.where("state is not null and close is not null").join(known, ["symbol", "ts"]), c)


def timeline(bars: DataFrame) -> DataFrame:
    """(ts, p): the position of each distinct time of all symbols. A row for each time, however many symbols."""
    return bars.select("ts").distinct().withColumn("p", F.row_number().over(Window.orderBy("ts")) - 1)


def dealt(rows: DataFrame, size: DataFrame, train: int, validation: int, test: int, step: int) -> DataFrame:
    """``rows`` (with their position p) once for each fold whose span they lie in, with fold_id, the fold's first
    position s and the part. The folds of a position follow from it, so nothing is joined by range."""
    width = train + validation + test
    first = F.greatest(F.lit(0), F.ceil((F.col("p") - width + 1) / step).cast("int"))
    last = F.least(F.floor(F.col("p") / step), F.floor((F.col("_size") - width) / step)).cast("int")
    folds = rows.crossJoin(F.broadcast(size)).where(F.col("_size") >= width).where(first <= last)  # ``size`` is one row
    folds = folds.withColumn("f", F.explode(F.sequence(first, last))).withColumn("s", F.col("f") * step)
    part = F.when(F.col("p") < F.col("s") + train, "train").when(F.col("p") < F.col("s") + train + validation, "validation").otherwise("test")
    return folds.withColumn("part", part).withColumn("fold_id", (F.col("f") + 1).cast("long")).drop("f", "_size")


def prepared(frame: DataFrame, train: int, validation: int, test: int, step: int, c: SignalConfig = DEFAULT, least: int = MIN_FOLD_BARS, refit: bool = True) -> DataFrame:
    """(fold_id, part, and the columns of signals): validation rows scored by what the fold's training part says, test
    rows by training and validation together (``refit``) or by training alone.

    A label counts in a fit if it comes true before the fit's span ends. A symbol with fewer than ``least`` training
    bars in a fold has no rows there; one without validation bars has the same fit for both parts.
    """
    bars = frame.where("state is not null and close is not null")
    times = timeline(frame)
    size = times.agg(F.count("*").cast("int").alias("_size"))
    placed = bars.join(times, "ts")
    labels = placed.select("symbol", "p", "state", F.lead("state", markov.HORIZON).over(Window.partitionBy("symbol").orderBy("p")).alias("_next"), F.lead("p", markov.HORIZON).over(Window.partitionBy("symbol").orderBy("p")).alias("_np"),
        (F.lead("close", markov.FORWARD).over(Window.partitionBy("symbol").orderBy("p")) / F.col("close") - 1).alias("_fr"), F.lead("p", markov.FORWARD).over(Window.partitionBy("symbol").orderBy("p")).alias("_fp"))
    spans = dealt(labels, size, train, validation, test, step).where("part <> 'test'")
    enough = spans.where("part = 'train'").groupBy("fold_id", "symbol").agg(F.count("*").alias("_bars")).where(F.col("_bars") >= least).select("fold_id", "symbol")
    ends = F.array(*(F.struct(F.lit(f).alias("fit"), (F.col("s") + e).alias("end")) for f, e in (("train", train), ("refit", train + validation))))
    fits = spans.withColumn("_e", F.explode(ends)).where("p < _e.end")
    fits = fits.select("fold_id", "symbol", F.col("_e.fit").alias("fit"), "state", F.when(F.col("_np") < F.col("_e.end"), F.col("_next")).alias("next_state"), F.when(F.col("_fp") < F.col("_e.end"), F.col("_fr")).alias("forward_return"))
    known = markov.statistics(fits, ["fold_id", "fit", "symbol"])
    asked = dealt(placed, size, train, validation, test, step).where("part <> 'train'").withColumn("fit", F.when((F.col("part") == "test") & F.lit(refit), "refit").otherwise("train"))
    asked = asked.join(enough, ["fold_id", "symbol"], "left_semi")
    return decided(asked.join(known, ["fold_id", "fit", "symbol", "state"], "left"), c, "fold_id", "part")


def fold_bins(frame: DataFrame, feature: str, bins: int, train: int, validation: int, test: int, step: int, least: int = MIN_FOLD_BARS) -> DataFrame:
    """(fold_id, part, symbol, ts, bin): quantile edges fitted on each fold's training part (validation rows), and again on
    training and validation (test rows), applied to the part they are for. Edges are a table by fold, fit and symbol.
    A missing value is in the bin ``missing``; values on an edge are in the lower bin."""
    times = timeline(frame)
    size = times.agg(F.count("*").cast("int").alias("_size"))
    placed = dealt(frame.select("symbol", "ts", F.col(feature).alias("x")).join(times, "ts"), size, train, validation, test, step)
    fit = F.explode(F.when(F.col("part") == "train", F.array(F.lit("train"), F.lit("refit"))).otherwise(F.array(F.lit("refit"))))
    fits = placed.where("part <> 'test'").withColumn("fit", fit)
    edges = fits.groupBy("fold_id", "fit", "symbol").agg(F.percentile("x", F.array(*(F.lit(k / bins) for k in range(1, bins)))).alias("edges"), F.count_if(F.col("part") == "train").alias("_bars")).where(F.col("_bars") >= least)
    asked = placed.where("part <> 'train'").withColumn("fit", F.when(F.col("part") == "test", "refit").otherwise("train")).join(edges, ["fold_id", "fit", "symbol"])
    above = F.size(F.filter("edges", lambda e: e < F.col("x")))
    return asked.select("fold_id", "part", "symbol", "ts", F.when(F.col("x").isNull(), "missing").otherwise(F.concat(F.lit("b"), above.cast("string"))).alias("bin"))

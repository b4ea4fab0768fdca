"""First-order transition and forward-return statistics of states, in long form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import nullif, order

HORIZON, FORWARD, SMOOTHING = 1, 5, 1.0


def lookback(frame: DataFrame, bars: int) -> DataFrame:
    """The last ``bars`` rows of each symbol."""
    w = Window.partitionBy("symbol").orderBy(F.col("ts").desc())
    return frame.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= bars).drop("_n")


def labelled(frame: DataFrame, horizon: int = HORIZON, forward: int = FORWARD) -> DataFrame:
    """(symbol, ts, state, close, next_state, forward_return)."""
    f = frame.where("state is not null and close is not null").select("symbol", "ts", "state", "close")
    return f.withColumns({"next_state": F.lead("state", horizon).over(order()), "forward_return": F.lead("close", forward).over(order()) / F.col("close") - 1})


def matrix(samples: DataFrame, smoothing: float = SMOOTHING) -> DataFrame:
    """(symbol, current_state, next_state, count, prob) for all pairs of a symbol's states. The states of
    a symbol join themselves on the symbol; the rules bound their number."""
    seen = samples.where("next_state is not null")
    counts = seen.groupBy("symbol", F.col("state").alias("current_state"), "next_state").agg(F.count("*").alias("count"))
    states = counts.select("symbol", F.col("current_state").alias("s")).unionByName(counts.select("symbol", F.col("next_state").alias("s"))).distinct()
    grid = states.withColumnRenamed("s", "current_state").join(states.withColumnRenamed("s", "next_state"), "symbol")
    dense = grid.join(counts, ["symbol", "current_state", "next_state"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    smooth = F.col("count") + smoothing
    return dense.withColumn("prob", smooth / nullif(F.sum(smooth).over(Window.partitionBy("symbol", "current_state"))))


def _moments():
    r = F.col("forward_return")
    spread = F.stddev_samp(r)
    return [
        F.avg(r).alias("mean_return"), F.median(r).alias("median_return"), spread.alias("std_return"),
        F.coalesce(F.avg(r) / nullif(spread), F.lit(0.0)).alias("conditional_sharpe"), F.avg((r > 0).cast("double")).alias("positive_rate"), F.count(r).alias("observations"),
    ]


def state_returns(samples: DataFrame) -> DataFrame:
    r = F.col("forward_return")
    wins, losses = F.coalesce(F.avg(F.when(r > 0, r)), F.lit(0.0)), F.coalesce(F.avg(F.when(r < 0, r)), F.lit(0.0))
    return samples.where("forward_return is not null").groupBy("symbol", "state").agg(*_moments(), wins.alias("avg_win"), losses.alias("avg_loss"))


def transition_returns(samples: DataFrame) -> DataFrame:
    rows = samples.where("forward_return is not null and next_state is not null")
    return rows.groupBy("symbol", F.col("state").alias("current_state"), "next_state").agg(*_moments())


def entropy(m: DataFrame) -> DataFrame:
    """(symbol, state, entropy, confidence, concentration) of each row of the matrix."""
    p = F.col("prob")
    k = F.count_if(p > 0)
    raw = -F.sum(F.when(p > 0, p * F.log(p)).otherwise(0.0))
    e = m.groupBy("symbol", F.col("current_state").alias("state")).agg(F.when(k <= 1, 0.0).otherwise(raw / nullif(F.log(k.cast("double")))).alias("entropy"), F.max(p).alias("concentration"))
    return e.withColumn("confidence", F.greatest(1 - F.col("entropy"), F.lit(0.0)))


def predicted(m: DataFrame) -> DataFrame:
    """(symbol, state, predicted): the likeliest next state, ties to the first label."""
    w = Window.partitionBy("symbol", "current_state").orderBy(F.col("prob").desc(), "next_state")
    return m.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("symbol", F.col("current_state").alias("state"), F.col("next_state").alias("predicted"))


def confusion(samples: DataFrame, m: DataFrame) -> DataFrame:
    """(symbol, predicted, actual, n)."""
    seen = samples.where("next_state is not null").join(predicted(m), ["symbol", "state"])
    return seen.groupBy("symbol", "predicted", F.col("next_state").alias("actual")).agg(F.count("*").alias("n"))


def accuracy(samples: DataFrame, m: DataFrame) -> DataFrame:
    n = F.col("n")
    return confusion(samples, m).groupBy("symbol").agg((F.sum(F.when(F.col("predicted") == F.col("actual"), n).otherwise(0)) / nullif(F.sum(n).cast("double"))).alias("accuracy"))


def certainty(weighted: Column, total: Column, states: Column) -> Column:
    """1 less the normalised entropy of a smoothed row: ``weighted`` is the sum of w * ln w over its weights,
    ``total`` their sum. At least 0; a row of one state is certain."""
    raw = (F.log(total) - weighted / total) / nullif(F.log(states.cast("double")))
    return F.when(states <= 1, 1.0).otherwise(F.greatest(1 - raw, F.lit(0.0)))


def statistics(labelled: DataFrame, keys: Sequence[str], smoothing: float = SMOOTHING) -> DataFrame:
    """(keys, state, observations, mean_return, confidence, predicted) from **one** aggregate of the rows by keys, state
    and next state; the rest works on that small table. A row counts for its transition if it has a next
    state, for its return if it has one."""
    counts = labelled.groupBy(*keys, "state", "next_state").agg(F.count("*").alias("c"), F.sum("forward_return").alias("r"), F.count("forward_return").alias("m"))
    # each state that some transition leaves or enters is a row and a column of the matrix
    ends = counts.where("next_state is not null").select(*keys, F.explode(F.array("state", "next_state")).alias("state"))
    matrix = ends.groupBy(*keys).agg(F.count_distinct("state").alias("states"), F.min("state").alias("_first"))
    w = F.col("c") + smoothing
    there = F.col("next_state").isNotNull()
    rows = counts.groupBy(*keys, "state").agg(
        F.sum("m").alias("observations"), (F.sum("r") / nullif(F.sum("m").cast("double"))).alias("mean_return"), F.sum(F.when(there, F.col("c"))).alias("_n"), F.count_if(there).alias("_seen"),
        F.sum(F.when(there, w * F.log(w))).alias("_wlog"), F.min(F.when(there, F.struct(-F.col("c"), F.col("next_state").alias("next")))).alias("_top"),
    )
    # a state that is only entered has a row of the matrix as well, with nothing observed
    rows = ends.distinct().join(rows, [*keys, "state"], "full").join(matrix, list(keys), "left")
    inside = F.col("states").isNotNull()
    base = smoothing * F.log(F.lit(smoothing)) if smoothing > 0 else F.lit(0.0)
    zero = lambda x: F.coalesce(F.col(x), F.lit(0))
    entropy = certainty(zero("_wlog").cast("double") + base * (F.col("states") - zero("_seen")), zero("_n").cast("double") + smoothing * F.col("states"), F.col("states"))
    lone = zero("_n") + smoothing * F.col("states") <= 0
    return rows.select(*keys, "state", zero("observations").alias("observations"), "mean_return", F.when(inside & ~lone, entropy).alias("confidence"), F.when(inside, F.coalesce("_top.next", "_first")).alias("predicted"))

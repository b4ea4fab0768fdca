"""Rolling windows over one layout: partition by symbol, order by time, so Spark plans one sort."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def order(*keys: str):
    return Window.partitionBy(*(keys or ("symbol",))).orderBy("ts")


def rolling(fn: Callable[[Column], Column], x: Column, n: int, *keys: str) -> Column:
    """``fn(x)`` over the last n rows; null unless all n values are there."""
    w = order(*keys).rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(w) == n, fn(x).over(w))


def mean(x: Column, n: int, *keys: str) -> Column:
    return rolling(F.avg, x, n, *keys)


def deviation(x: Column, n: int, *keys: str) -> Column:
    return rolling(F.stddev_samp, x, n, *keys)


def nullif(x: Column, value: float = 0.0) -> Column:
    return F.when(x != value, x)


def zscore(x: Column, n: int, *keys: str) -> Column:
    return (x - mean(x, n, *keys)) / nullif(deviation(x, n, *keys))


def previous(x: Column, n: int = 1, *keys: str) -> Column:
    return F.lag(x, n).over(order(*keys))


def ewm(x: Column, alpha: float, least: int, *keys: str) -> Column:
    """Exponential mean seeded by the first value, null before ``least`` values. Weights under 1e-17
    are left out, so the window is bounded however long the history."""
    length = math.ceil(math.log(1e-17) / math.log(1 - alpha))
    w = order(*keys).rowsBetween(-(length - 1), 0)
    folded = F.aggregate(F.collect_list(x).over(w), F.lit(None).cast("double"), lambda a, v: F.when(a.isNull(), v).otherwise(a * (1 - alpha) + v * alpha))
    seen = F.count(x).over(order(*keys).rowsBetween(Window.unboundedPreceding, 0))
    return F.when(seen >= least, folded)

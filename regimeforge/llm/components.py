"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _min_neighbour(edges: DataFrame) -> DataFrame:
    """(u, v, m): each edge in both directions with the least of u and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.join(least.select("u", F.least("u", "m").alias("m")), "u")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp): every node that has an edge to another node, with the least node it can reach.

    Each step hangs nodes under smaller neighbours; the number of steps grows with the logarithm of
    the longest chain. A step is one aggregate with partial minima and one join, written to the shared
    folder; only two numbers come back to the driver. Loops, repeated edges and an empty table are fine;
    edges with a null end are dropped.
    """
    now = common.materialize(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    while True:
        # large star: larger neighbours of u hang under the least of its neighbourhood
        large = _min_neighbour(now).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours hang under the least of them
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        hung = down.join(least, "u")
        small = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        last, now = now, common.materialize(small, "edges")
        common.release(last)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots)

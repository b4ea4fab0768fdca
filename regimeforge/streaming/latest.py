"""Latest-value state of quotes and bars on Structured Streaming, with a batch twin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def valid(rows: DataFrame) -> DataFrame:
    return rows.where("symbol is not null and ts is not null and price > 0")


def latest(rows: DataFrame, key: str = "symbol") -> DataFrame:
    """The newest row of each key by event time; late rows lose, equal times go to the later arrival
    (``seq``). As an aggregate this runs on a stream with update output and on a batch alike; the state
    is one row for each key."""
    newest = F.max_by(F.struct("ts", "seq", "price"), F.struct("ts", "seq"))
    return valid(rows).groupBy(key).agg(newest.alias("r"), F.count("*").alias("n")).select(key, "r.*", "n")


def split_runs(rows: DataFrame, key: str, column: str, bucket: Column) -> tuple[DataFrame, DataFrame]:
    """(rows with ``_b``, greatest ``column`` before each (key, bucket)): a running maximum in two levels, so no
    task holds all rows of a key. The second table has one row for each key and bucket."""
    out = rows.withColumn("_b", bucket)
    tops = out.groupBy(key, "_b").agg(F.max(column).alias("_top"))
    past = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    return out, tops.select(key, "_b", F.max("_top").over(past).alias("_before"))


def out_of_order(rows: DataFrame, key: str = "symbol", bucket: int = 100_000) -> DataFrame:
    """How many rows of each key came after a newer one (batch; arrival order is ``seq``). Arrivals are cut into
    buckets of ``seq``; what came before a bucket is one value."""
    cut, before = split_runs(valid(rows), key, "ts", F.floor(F.col("seq") / bucket))
    w = Window.partitionBy(key, "_b").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    marked = cut.withColumn("_own", F.max("ts").over(w)).join(before, [key, "_b"])
    late = F.coalesce(F.col("ts") < F.greatest("_own", "_before"), F.lit(False))
    return marked.groupBy(key).agg(F.count_if(late).alias("out_of_order"), F.count("*").alias("seen"))


#: Seconds up to which a channel's last value is fresh.
FRESH_S = {"bars": 180, "quotes": 60}


def observed(rows: DataFrame, now: Column) -> DataFrame:
    """Rows with the reason why they are no observation at ``now``: without key, price or time, from the future,
    or a minute bar that is not complete yet. ``rows``: channel (bars or quotes), symbol, ts, price."""
    ahead = F.timestamp_diff("MICROSECOND", now, F.col("ts"))
    reason = (
        F.when(F.col("symbol").isNull() | F.col("ts").isNull() | ~F.coalesce(F.col("price") > 0, F.lit(False)), "invalid").when(ahead > 0, "future")
        .when((F.col("channel") == "bars") & (ahead + 60_000_000 > 0), "incomplete")
    )
    return rows.withColumn("rejected", reason)


def ingest_counts(rows: DataFrame, now: Column) -> DataFrame:
    """Accepted, rejected and out-of-order rows of each channel."""
    judged = observed(rows, now)
    late = out_of_order(judged.where("rejected is null").withColumn("_k", F.concat_ws("/", "channel", "symbol")), "_k")
    late = late.groupBy(F.split("_k", "/")[0].alias("channel")).agg(F.sum("out_of_order").alias("out_of_order"))
    counts = judged.groupBy("channel").agg(F.count("*").alias("received"), *(F.count_if(F.col("rejected") == r).alias(r) for r in ("invalid", "future", "incomplete")))
    return counts.join(late, "channel", "left").withColumn("out_of_order", F.coalesce("out_of_order", F.lit(0)))


def snapshot(rows: DataFrame, now: Column, generation: int) -> DataFrame:
    """The last observation of each channel and symbol at ``now`` with its age and state: fresh within the
    channel's limit, stale beyond it, retained where it comes from an earlier ``generation`` of the stream.
    What lies in the future is no observation, so no age is negative."""
    seen = observed(rows, now).where("rejected is null")
    last = seen.groupBy("channel", "symbol").agg(F.max_by(F.struct("ts", "seq", "price", "generation"), F.struct("ts", "seq")).alias("r")).select("channel", "symbol", "r.*")
    age = F.timestamp_diff("MICROSECOND", F.col("ts"), now) / 1_000_000
    limit = F.when(F.col("channel") == "bars", FRESH_S["bars"]).otherwise(FRESH_S["quotes"])
    state = F.when(F.col("generation") != generation, "retained_previous_session").when(age.between(0, limit), "fresh").otherwise("stale")
    return last.withColumns({"age_s": age, "state": state})


def windows(rows: DataFrame, width: str, late: str = "1 hour") -> DataFrame:
    """Bars of a stream by event-time window; the watermark bounds the state."""
    return valid(rows).withWatermark("ts", late).groupBy(F.window("ts", width), "symbol").agg(F.count("*").alias("n"), F.min("price").alias("low"), F.max("price").alias("high"))


def gaps(rows: DataFrame, limit_s: int, key: str = "symbol") -> DataFrame:
    """Sessions of each key that a gap over the limit ends: first, last and number of rows.

    Rows are first summed by key and hour; within an hour gaps are found by a window over that hour, between
    hours from the ends of the hours, and sessions are the hours' pieces joined. A task holds an hour of a key
    and the pieces of a key, not its rows."""
    cut = valid(rows).withColumn("_h", F.date_trunc("hour", "ts"))
    w = Window.partitionBy(key, "_h").orderBy("ts", "seq")
    new = F.coalesce((F.timestamp_diff("SECOND", F.lag("ts").over(w), F.col("ts")) > limit_s).cast("int"), F.lit(0))
    pieces = cut.withColumn("_p", F.sum(new).over(w)) if limit_s < 3600 else cut.withColumn("_p", F.lit(0))
    pieces = pieces.groupBy(key, "_h", "_p").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))
    along = Window.partitionBy(key).orderBy("first_ts", "_h", "_p")
    opens = F.coalesce((F.timestamp_diff("SECOND", F.lag("last_ts").over(along), F.col("first_ts")) > limit_s).cast("int"), F.lit(1))
    return pieces.withColumn("_new", opens).withColumn("run", F.sum("_new").over(along)).groupBy(key, "run").agg(F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.sum("n").alias("n"))

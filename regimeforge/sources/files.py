"""Bars and instruments from files of others: checked against a manifest, unwrapped, typed, or refused."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of bars, and what an adjusted close is called.
BAR_COLUMNS, ADJUSTED = ("open", "high", "low", "close", "volume"), "adj_close"
#: One page of bars as providers send it.
PAGE = "page int, bars map<string, array<struct<t: timestamp_ntz, o: double, h: double, l: double, c: double, v: double>>>"


class EvidenceError(ValueError):
    """Files that must not be used as they are."""


def digests(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(name, sha256, bytes) of each file below ``root``, hashed where the file is read; contents never reach the driver.
    A file is one row, so of two gigabytes at most: larger data comes as several files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    at = F.regexp_replace(F.lit(root.rstrip("/")), "^file:/+", "/")
    path = F.regexp_replace("path", "^file:/+", "/")
    return files.select(F.split_part(path, F.concat(at, F.lit("/")), F.lit(-1)).alias("name"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def audited(found: DataFrame, manifest: DataFrame, required: list[str] | None = None) -> DataFrame:
    """(name, status) for each file of the manifest (name, sha256) and of the folder: ok, changed, missing, unlisted, unsafe (a name
    that leads out of the folder), conflicting (two hashes in the manifest), unlisted_required."""
    m = manifest.groupBy("name").agg(F.min("sha256").alias("want"), F.count_distinct("sha256").alias("ways"))
    out = m.join(found.select("name", F.col("sha256").alias("have")), "name", "full")
    if required:
        out = out.join(out.sparkSession.createDataFrame([(r, True) for r in required], "name string, needed boolean"), "name", "full")
    else:
        out = out.withColumn("needed", F.lit(False))
    unsafe = F.col("name").startswith("/") | F.array_contains(F.split("name", "/"), "..")
    status = (
        F.when(F.col("want").isNull() & F.coalesce("needed", F.lit(False)), "unlisted_required").when(F.col("want").isNull(), "unlisted").when(unsafe, "unsafe").when(F.col("ways") > 1, "conflicting")
        .when(F.col("have").isNull(), "missing").when(F.col("have") != F.col("want"), "changed").otherwise("ok")
    )
    return out.select("name", status.alias("status"))


def dataset(spark: SparkSession, root: str, manifest: DataFrame, part: str, required: list[str] | None = None) -> DataFrame:
    """The Parquet files ``part`` (a glob) below ``root``, if all that the manifest lists is there unchanged; else an error that names
    up to ten files. What is ``required`` must be listed; other files may lie beside it."""
    wrong = audited(digests(spark, root), manifest, required).where("status not in ('ok', 'unlisted')").orderBy("name").limit(10).collect()
    if wrong:
        raise EvidenceError("dataset integrity: " + ", ".join(f"{r.name} {r.status}" for r in wrong))
    return spark.read.parquet(f"{root.rstrip('/')}/{part}")


def normalized(frame: DataFrame, *keys: str) -> DataFrame:
    """``keys`` and the columns of bars as doubles. Names count without case and with underscores for spaces; an adjusted close
    stands in for a missing close. A missing column is an error at once, a value that is no number when it is read."""
    names = {c.lower().replace(" ", "_"): c for c in frame.columns}
    if "close" not in names and ADJUSTED in names:
        names["close"] = names[ADJUSTED]
    if missing := [c for c in (*keys, *BAR_COLUMNS) if c not in names]:
        raise EvidenceError(f"market data without columns {missing}")
    value = lambda c: F.col(f"`{names[c]}`")
    number = lambda c: F.when(value(c).isNotNull() & value(c).try_cast("double").isNull(), F.raise_error(F.concat(F.lit(f"{c} is no number: "), value(c).cast("string"))).cast("double")).otherwise(value(c).try_cast("double"))
    return frame.select(*(value(k).alias(k) for k in keys), *(number(c).alias(c) for c in BAR_COLUMNS))


def unwrapped(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, ts, open, high, low, close, volume) from pages of JSON, compressed or not, in which each symbol has its list of
    bars. Pages may overlap: equal bars count once, and a bar that two pages tell differently is an error, as is a page that does
    not parse. A page's lists are exploded where the page is read; repeats meet by symbol and time."""
    pages = spark.read.schema(PAGE).option("mode", "FAILFAST").json(path)
    rows = pages.select(F.explode("bars").alias("symbol", "list")).select("symbol", F.inline("list"))
    body = F.struct("o", "h", "l", "c", "v")
    one = rows.groupBy("symbol", F.col("t").alias("ts")).agg(F.min(body).alias("a"), F.max(body).alias("b"))
    sound = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.raise_error(F.concat(F.lit("conflicting bars of "), F.col("symbol"))).cast("struct<o: double, h: double, l: double, c: double, v: double>"))
    return one.select("symbol", "ts", sound.alias("a")).select("symbol", "ts", F.col("a.o").alias("open"), F.col("a.h").alias("high"), F.col("a.l").alias("low"), F.col("a.c").alias("close"), F.col("a.v").alias("volume"))


def imported(spark: SparkSession, paths: list[str], schema: str, key: str, kind: str = "csv") -> DataFrame:
    """Instruments from files, in the order of ``paths``: of an instrument that several files have the last file's row counts, and the
    columns of coverage (source, rows) say where it came from. Within a file two different rows of an instrument are an error,
    as are malformed rows and a file without rows: an import is whole or it is none."""
    out = None
    for n, path in enumerate(paths):
        reader = spark.read.schema(schema).option("mode", "FAILFAST")
        rows = (reader.option("header", "true").csv(path) if kind == "csv" else reader.json(path)).where(F.col(key).isNotNull())
        body = F.struct(*rows.columns)
        one = rows.groupBy(key).agg(F.min(body).alias("a"), F.max(body).alias("b"), F.count("*").alias("rows"))
        sound = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.raise_error(F.concat(F.lit("conflicting rows of "), F.col(key).cast("string"))).cast(rows.select(body.alias("x")).schema["x"].dataType))
        if rows.isEmpty():
            raise EvidenceError(f"an import without instruments: {path}")
        part = one.select(F.col(key).alias("_key"), F.lit(n).alias("_n"), sound.alias("row"), "rows")
        out = part if out is None else out.unionByName(part)
    last = out.groupBy("_key").agg(F.max_by(F.struct("row", "_n"), "_n").alias("x"), F.sum("rows").alias("rows_read"))
    return last.select("x.row.*", F.col("x._n").alias("source"), "rows_read")

"""Tables in the folder that driver and executors share: cut lineage, and ledgers that are read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else the context's checkpoint folder; a temporary one for a local session only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if not context._jsc.sc().getCheckpointDir().isDefined():
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="regimeforge-"))
        found = context._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/regimeforge/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written and read back."""
    path = fresh_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(spark: SparkSession, schema, path: str, key: str, buckets: int) -> str:
    """The name of a table over ``path``, new or with files that it wrote before, whose rows lie in files by the hash of ``key``:
    groups and joins by the key of tables with as many buckets need no exchange. Other sessions give the path another name."""
    name = f"regimeforge_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(f"create table {name} ({columns}) using parquet options (compression 'zstd') clustered by (`{key}`) into {buckets} buckets location '{path}'")
    return name


def exists(spark: SparkSession, name: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

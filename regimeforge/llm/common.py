"""Shared pieces: table access, durable intermediate tables, corpus size, learn/test folds."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the context's checkpoint
    folder. Where neither is set a local session gets a temporary one, and a cluster is an error: a folder
    of one machine would not be seen by the others."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if not context._jsc.sc().getCheckpointDir().isDefined():
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="regimeforge-"))
        found = context._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


#: Tables that this process has written and not released.
_WRITTEN: list[str] = []


def materialize(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: lineage ends there, and a
    lost executor costs no recomputation of what came before. ``release`` deletes it."""
    path = f"{shared_dir(df.sparkSession)}/regimeforge/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._rf_path = path
    _WRITTEN.append(path)
    return out


@contextlib.contextmanager
def only_last(spark: SparkSession):
    """Of the tables that are written within only the last one stays: it was made of the others. Where the block
    fails all stay, for a look."""
    before = set(_WRITTEN)
    yield
    for name in [x for x in _WRITTEN if x not in before][:-1]:
        _delete(spark, name)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    if name in _WRITTEN:
        _WRITTEN.remove(name)


def release(*written: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing reads any more."""
    for df in written:
        _delete(df.sparkSession, df._rf_path)


def release_all(spark: SparkSession) -> None:
    """Delete every table that this process has written and not released. A result of an operator reads its
    tables when it is run, so call this once the results are stored."""
    for name in list(_WRITTEN):
        _delete(spark, name)


def corpus_size(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """(UTF-8 bytes, words) of all texts. One column-pruned pass; only two numbers come back."""

    def measure(batches):
        for batch in batches:
            size = words = 0
            for t in batch.column(0).to_pylist():
                if t:
                    b = t.encode()
                    size += len(b)
                    words += len(b.split())
            yield pa.record_batch([pa.array([size], pa.int64()), pa.array([words], pa.int64())], ["size", "words"])

    row = docs.select(text).mapInArrow(measure, "size long, words long").agg(F.sum("size"), F.sum("words")).first()
    return int(row[0] or 0), int(row[1] or 0)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``: which rows a classifier may learn from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, per_class: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, y) of at most ``per_class`` learnable rows of either label.

    The sample is the rows with the least hash of their id, so it is the same on every run. The
    bound ``per_class`` is what lets the ids be broadcast: the texts of ``documents`` are not shuffled.
    Null ids or labels never enter; of repeated label rows for a document the larger label counts, and of
    several documents with one id the least text, so the choice does not depend on the order of rows. ``doc_id`` and
    ``text`` are the columns of ``docs``.
    """
    pool = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (fold(F.col("doc_id"), folds) != held_out))
        .groupBy("doc_id")
        .agg(F.max(F.col(label).cast("int")).alias("y"))
    )
    picked = None
    for y in (0, 1):
        part = pool.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))

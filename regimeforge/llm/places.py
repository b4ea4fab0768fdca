"""Later repeats of hashed runs: the part that line and sentence deduplication share.

A place is (doc_id, hash of the text, index in the text). Places are ordered by these, null ids first;
rows that agree in id and text are one place, so equal rows are never later than each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DOC = ["rf_doc", "rf_text"]


def doc_key(docs: DataFrame, doc_id: str, text: str) -> list:
    """The columns that name a document's place: its id and the hash of its text."""
    return [docs[doc_id].cast("long").alias("rf_doc"), F.xxhash64(docs[text]).alias("rf_text")]


def split_key(g: str):
    """A second join key that follows from the first. An aggregate's partitioning by ``g`` does not serve
    a join by both, and an exchange that only a join asks for is one that Spark splits by skew."""
    return F.pmod(F.col(g), F.lit(1024)).alias("rf_split")


def later_repeats(runs: DataFrame, index: str = "i") -> DataFrame:
    """The rows of ``runs`` (run hash ``g``, rf_doc, rf_text, index, ...) whose run stands at an earlier
    place, with that first place's document as ``first_doc``.

    The first places are an aggregate with partial minima. The join has its own exchange, by the run hash
    and a remainder of it, so Spark can split it where a run is very frequent: one side has a single row
    for each hash.
    """
    place = F.struct("rf_doc", "rf_text", index)
    first = runs.groupBy("g").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last")
    first = first.select("g", split_key("g"), "first")
    return runs.select("*", split_key("g")).join(first, ["g", "rf_split"]).where(place > F.col("first")).withColumn("first_doc", F.col("first.rf_doc")).drop("first", "rf_split")


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, each with underscores behind it until no column of ``taken`` has it."""
    held, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def at_place(docs: DataFrame, right: DataFrame, how: str, doc_id: str, text: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` joined with ``right`` (rf_doc, rf_text, ...) on the document's place, null ids included. The
    second result names the further columns of ``right`` in the join, where none of ``docs`` is hidden."""
    names = dict(zip(right.columns, fresh(docs.columns, *right.columns), strict=True))
    r = right.withColumnsRenamed(names)
    joined = docs.join(r, (F.xxhash64(docs[text]) == r[names["rf_text"]]) & docs[doc_id].cast("long").eqNullSafe(r[names["rf_doc"]]), how)
    return joined.drop(names["rf_doc"], names["rf_text"]), names

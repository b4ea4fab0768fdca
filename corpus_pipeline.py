"""The corpus pipeline: each stage reads what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regimeforge.llm import bpe, common, decontaminate, jaccard, line_dedup, quality
from regimeforge.llm.registry import vocabulary

#: SQL cannot express the classifier and the tokeniser.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text the compression classifier accepts. It learns from the labelled rows of the
    whole ``documents`` table, which is the same on every run."""
    model = quality.fit(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return quality.accepted(docs, model)


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines are cut out of the texts; ``n_chars`` follows."""
    columns = [c for c in docs.columns]
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.when(F.col("lines_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near copies; equal rows once. A document without a
    word is a group of its own."""
    return jaccard.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates."""
    return decontaminate.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, as digests, with those of the decoded texts."""
    return bpe.digests(docs, *vocabulary())


STAGES = [
    ("quality_classifier", keep_quality),
    ("line_dedup", cut_lines),
    ("ngram_jaccard_join", one_of_each_group),
    ("decontamination", drop_benchmark),
    ("byte_bpe", tokenise),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each stage's table is deleted when the next one is written, with what the
    operators wrote for it; the last stage's own are left to ``common.release_all``."""
    docs, made = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with common.only_last(spark):
            new = common.materialize(stage(spark, docs, sf_dir), name)
        if made is not None:
            common.release(made)
        docs = made = new
    return STAGES[-1][1](spark, docs, sf_dir)

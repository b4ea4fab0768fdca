"""The corpus queries: one thin query for each operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, jaccard, line_dedup, lm, merkle, neardup, oracle, quality, resample, rules, sentence_dedup, toxicity, urls
from .common import table


def vocabulary() -> tuple[dict[bytes, int], str]:
    """(ranks, pattern) of the public multilingual byte-level vocabulary."""
    import public_tokenizers

    return bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), *vocabulary())


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "lines_total", "lines_removed", F.sha2("text", 256).alias("text_sha256"))


def op6_sentence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_dedup.digest(table(spark, sf_dir, "documents"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.stupid_backoff(table(spark, sf_dir, "documents"))
    return scored.withColumns({"score": F.round("score", 6), "mean_score": F.round("mean_score", 6)})


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list stands for one from outside: the URLs of the pages whose id is divisible by 50."""
    pages = table(spark, sf_dir, "pages")
    return urls.judge(pages, pages.where("page_id % 50 = 0"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digest(table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"))


def queries():
    found = (op1_decontamination, op2_byte_bpe, op3_quality_classifier, op4_quality_rules, op5_line_dedup, op6_sentence_dedup, op7_lm_scoring, op8_url_filter, op9_toxicity, op10_ngram_jaccard, op11_merkle_manifest, op12_importance_resampling, op13_embedding_neardup)
    return {f.__name__: f for f in found}


def oracle_sql():
    return dict(oracle.ORACLE)

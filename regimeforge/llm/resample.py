"""Importance resampling towards a target distribution, by hashed n-gram features.

Two passes over the texts. The first makes a vector of feature counts for each partition (``np.bincount``), which
a tree of additions merges; the second looks up the gain of each feature in a broadcast vector and sums them for each
document. Both vectors have ``buckets`` entries, however large the corpus is.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import common, ranks

BUCKETS, SIZES, LEAST_WORDS, PERCENT, SEED = 10_000, (1, 1), 20, 10, 2024
#: Features that are summed at once, and distinct features whose bucket a task keeps: memory only.
AT_ONCE, KEPT = 1 << 20, 1 << 18
#: Levels of the tree of additions: a driver gets about the third root of the partitions' number of vectors.
DEPTH = 3

#: ASCII letters in lower case, digits and all bytes of longer characters stay; the rest are spaces.
_AS_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class _Buckets(dict):
    """Feature (UTF-8) to bucket; the most recent ones beyond ``KEPT`` are worked out again."""

    def __init__(self, buckets: int) -> None:
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        found = zlib.crc32(feature) % self.buckets
        if len(self) < KEPT:
            self[feature] = found
        return found


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_AS_WORDS).split() if text else []


def features(found: list[bytes], sizes: tuple[int, int]):
    """Runs of sizes[0] to sizes[1] consecutive words, repeats and all."""
    for n in range(sizes[0], sizes[1] + 1):
        yield from found if n == 1 else map(b" ".join, zip(*(found[k:] for k in range(n)), strict=False))


def _in_buckets(column: pa.Array, sizes: tuple[int, int], known: _Buckets):
    """(number of words, buckets of the features) of each text of an Arrow column."""
    for value in column.cast(pa.large_binary()):
        found = words(value.as_py())
        yield len(found), np.fromiter(map(known.__getitem__, features(found, sizes)), np.int64)


def feature_counts(docs: DataFrame, text: str = "text", sizes: tuple[int, int] = SIZES, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket: one vector."""

    def count(batches):
        total, known = np.zeros(buckets, np.int64), _Buckets(buckets)
        for batch in batches:
            for _, found in _in_buckets(batch.column(0), sizes, known):
                total += np.bincount(found, minlength=buckets)
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["vector"])

    parts = docs.select(text).mapInArrow(count, "vector binary").rdd.map(lambda row: np.frombuffer(row[0], np.int64))
    return parts.treeReduce(np.add, DEPTH) if parts.getNumPartitions() else np.zeros(buckets, np.int64)


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds to a document's weight, in thousandths of a log ratio."""
    raw, target = raw.astype(np.float64), target.astype(np.float64)
    size = float(len(raw))
    return np.floor(1000 * np.log((target + 1) * (raw.sum() + size) / ((raw + 1) * (target.sum() + size))))


def weights(docs: DataFrame, gain: np.ndarray, doc_id: str = "doc_id", text: str = "text", sizes: tuple[int, int] = SIZES) -> DataFrame:
    """(id, n_words, n_features, weight) of each document. A null text has no words."""
    spread = docs.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches):
        gain, known = spread.value, _Buckets(len(spread.value))
        for batch in batches:
            n_words, n_features, weight, waiting, held = [], [], [], [], 0

            def settle(waiting, weight):
                sizes_ = [len(x) for x in waiting]
                owner = np.repeat(np.arange(len(waiting)), sizes_)
                weight.append(np.bincount(owner, gain[np.concatenate(waiting)], len(waiting)))

            for n, found in _in_buckets(batch.column(1), sizes, known):
                n_words.append(n)
                n_features.append(len(found))
                waiting.append(found)
                held += len(found)
                if held > AT_ONCE:
                    settle(waiting, weight)
                    waiting, held = [], 0
            if waiting:
                settle(waiting, weight)
            done = np.concatenate([np.zeros(0), *weight]).astype(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), pa.array(done)], [doc_id, "n_words", "n_features", "weight"])

    chosen = docs.select(doc_id, text)
    return chosen.mapInArrow(weigh, StructType([chosen.schema[0], *(StructField(c, LongType()) for c in ("n_words", "n_features", "weight"))]))


def importance(docs: DataFrame, target: DataFrame, *, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", sizes: tuple[int, int] = SIZES, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every document.

    The score is the weight plus Gumbel noise that follows from the id and the seed, so the highest scores are a
    sample without replacement with odds by weight. Of the N documents with at least ``least_words`` words,
    floor(percent * N / 100) are drawn: their rank is 1, 2, 3 ..., and the others' is null. Ties go to the
    smaller id, then to the smaller number of features; rows equal in all of this may change places. A document
    with a null id has no noise, so neither score nor rank, and does not count in N. Empty tables, of either
    kind, are fine: without any feature all gains are equal.
    """
    gain = gains(feature_counts(docs, text, sizes, buckets), feature_counts(target, target_text, sizes, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(doc_id).cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    scored = weights(docs, gain, doc_id, text, sizes).withColumn("score", F.col("weight") + noise)
    scored = scored.withColumn("rf_in", F.when(F.col("score").isNull(), False).otherwise(F.col("n_words") >= least_words))
    placed = ranks.numbered(scored, "rf_in", [F.col("score").desc(), F.col(doc_id), F.col("n_features")])
    drawn = F.col("rf_in") & F.expr(f"rf_i < {percent} * rf_n div 100")
    return placed.select(doc_id, "n_words", "n_features", "weight", "score", F.when(drawn, F.col("rf_i") + 1).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn documents with all their columns. Of documents that share an id all stay if one is drawn."""
    doc_id = options.get("doc_id", "doc_id")
    drawn = importance(docs, target, **options).where("rank IS NOT NULL").select(F.col(doc_id).alias("rf_id")).distinct()
    return docs.join(drawn, docs[doc_id] == drawn["rf_id"], "left_semi")

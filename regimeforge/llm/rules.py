"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Each rule looks at a few counts of the whole text and votes good (1), bad (-1) or abstains (0). All
documents' vote patterns are counted; there are at most 3 ** len(RULES) of them, whatever the corpus, so
this table is the whole input of the EM on the driver. The model is a mixture of a good and a bad class
with P(vote | class) for each rule; accuracies follow from it. Prior votes say that rules are right more often than
wrong (BELIEF of all documents' weight, in the shares of GOOD and BAD), which names the classes and keeps them from drifting to
some other split of the corpus; the data decide how much each rule is worth. A document is kept if it passes the base
conditions and its posterior probability of the good class is at least KEEP (a tie is kept).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 5
KEEP = 0.5
EM_STEPS = 200
#: Prior votes of each rule, as a share of all documents, and how those of good and of bad documents fall on bad,
#: none and good: a good document rarely has a bad vote, a bad one has some.
BELIEF, GOOD, BAD = 0.05, (0.02, 0.08, 0.9), (0.3, 0.1, 0.6)
SYMBOLS = "#*$%&|<>"
_SPACE = " \t\n\r\x0b\x0c"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bare", "n_marked", "n_ends")
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Name -> vote. n_bare counts words without a letter or digit, n_upper the words that have letters
    and no small one among them, if of two letters or more, n_marked words that hold a symbol, n_ends words that end
    a sentence."""
    n, chars = F.col("n_words"), F.col("word_chars")
    return {
        "word_length": _vote((chars < 2 * n) | (chars > 15 * n), (chars >= 3 * n) & (chars <= 10 * n)),
        "symbols": _vote(10 * F.col("n_symbols") > n, 50 * F.col("n_symbols") <= n),
        "lines": _vote(3 * F.col("n_dup_lines") > F.col("n_lines"), 10 * F.col("n_dup_lines") <= F.col("n_lines")),
        "repeats": _vote(10 * F.col("n_repeat_words") > n, 20 * F.col("n_repeat_words") <= n),
        "case": _vote(4 * F.col("n_upper") > n, 10 * F.col("n_upper") <= n),
        "bare_words": _vote(5 * F.col("n_bare") > n, 20 * F.col("n_bare") <= n),
        "length": _vote(n < 10, n >= 50),
        "marked_words": _vote(10 * F.col("n_marked") > n, 50 * F.col("n_marked") <= n),
        "sentences": _vote(200 * F.col("n_ends") < n, 50 * F.col("n_ends") >= n),
    }


def repeat_words(words: list, window: int = WINDOW) -> int:
    """Words that lie in a window of so many words that occurs twice or more; exact."""
    total = len(words) - window + 1
    if total < 2:
        return 0
    index: dict = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
    size = len(index)
    if size == len(words):
        return 0
    key = ids[:total]
    top = size
    for j in range(1, window):
        if top * size >= 1 << 62:  # rank the prefixes, so that keys stay exact integers
            _, key = np.unique(key, return_inverse=True)
            top = int(key.max()) + 1
        key = key * size + ids[j : j + total]
        top *= size
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(total, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    cover = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(again)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


_MARKED = re.compile(rb"[^\s#*$%&|<>]*[#*$%&|<>]\S*")
_END = re.compile(rb"[.!?](?=\s|$)")


def measure(text: str | None) -> tuple[int, ...]:
    """COUNTS of one text; a null text has no words."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    full = [line for line in text.split("\n") if line.strip(_SPACE)]
    upper = sum(1 for w in words if w.isupper() and sum(c > 64 for c in w) > 1)
    bare = sum(1 for w in words if not w.isalnum() and not any(48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c > 127 for c in w))
    return (
        len(words),
        len(text) - sum(text.count(c) for c in _SPACE),
        sum(text.count(c) for c in SYMBOLS),
        len(full) - len(set(full)),
        repeat_words(words),
        len(full),
        upper,
        bare,
        len(_MARKED.findall(raw)),
        len(_END.findall(raw)),
    )


def counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = [measure(t) for t in batch.column(1).to_pylist()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(COUNTS)
            yield pa.record_batch([batch.column(0), *(pa.array(c, pa.int64()) for c in cols)], ["doc_id", *COUNTS])

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(run, SCHEMA)


def expectation_maximisation(votes: np.ndarray, weight: np.ndarray, steps: int = EM_STEPS) -> tuple[float, np.ndarray]:
    """(prior of good, P[rule, class, vote + 1]) from distinct vote patterns and their counts; class 1 is the good one.
    It starts from the prior votes alone, with either class as likely."""
    onehot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)  # pattern, rule, vote
    belief = BELIEF * weight.sum() * np.array([BAD, GOOD]) + np.finfo(float).tiny
    prior, p, good = 0.5, np.broadcast_to(belief / belief.sum(axis=1, keepdims=True), (votes.shape[1], 2, 3)), None
    for _ in range(steps):
        new = posterior(votes, prior, p)
        if good is not None and np.abs(new - good).max(initial=0) < 1e-9:
            break
        good = new
        prior = (weight @ good + 1) / (weight.sum() + 2)
        p = np.stack([np.einsum("p,prv->rv", weight * share, onehot) + belief[y] for y, share in ((0, 1 - good), (1, good))], axis=1)
        p = p / p.sum(axis=2, keepdims=True)
    return float(prior), p


def posterior(votes: np.ndarray, prior: float, p: np.ndarray) -> np.ndarray:
    index = votes + 1
    log = np.stack([np.log(p[np.arange(votes.shape[1]), y][np.arange(votes.shape[1]), index]).sum(axis=1) for y in (0, 1)])
    odds = log[1] - log[0] + np.log(prior) - np.log(1 - prior)
    return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, quality),
    a row for each row of ``docs``; ``quality`` is the posterior.

    Null and empty texts have no words and fail the base conditions. Repeated rows and null ids are kept
    as rows. An empty table gives an empty result; other columns are ignored. Long texts are read whole: a text's
    counts need memory in proportion to it, and all that is kept of it are the counts.
    """
    named = rules()
    measured = common.materialize(counts(docs, doc_id, text), "rules")
    voted = measured.select("*", F.array(*(v.cast("int") for v in named.values())).alias("votes"))
    patterns = voted.groupBy("votes").count().collect()
    spark = docs.sparkSession
    schema = "votes array<int>, quality double"
    if patterns:
        votes = np.array([r["votes"] for r in patterns], np.int64)
        prior, p = expectation_maximisation(votes, np.array([r["count"] for r in patterns], float))
        rows = [(r["votes"], float(q)) for r, q in zip(patterns, posterior(votes, prior, p), strict=True)]
    else:
        rows = []
    n = F.col("n_words")
    failed = (n < 10) | (100 * F.col("n_repeat_words") > 20 * n)
    return (
        voted.join(F.broadcast(spark.createDataFrame(rows, schema)), "votes")
        .withColumn("base_failed", failed)
        .select("doc_id", *COUNTS[:5], "base_failed", (~F.col("base_failed") & (F.col("quality") >= KEEP)).alias("kept"), "quality")
    )

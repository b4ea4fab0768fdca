"""Stupid-backoff scores of documents under an n-gram model counted on the corpus itself.

The count tables of all orders are partitioned by hash range; each block of documents sends its
distinct n-grams, gets their corpus counts back, and the scores are summed for each document.

Definition. With f the corpus count less the document's own count (leave-one-out: otherwise each
n-gram of the corpus would have been seen), N the corpus words less the document's own, and 0.4 the
backoff factor:

    S(w3 | w1 w2) = f(w1 w2 w3) / f(w1 w2)           if f(w1 w2 w3) > 0
                  = 0.4 * S(w3 | w2)                 otherwise
    S(w)          = max(f(w), 0.5) / max(N, 1)

The first words of a document use the shorter histories that exist. Words are runs of anything but
ASCII white space. ``score`` is the sum of log10 S, ``mean_score`` the sum over the number of words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, common

BACKOFF = 0.4
ORDER = 3
#: Larger than elsewhere: what a block sends is the distinct n-grams of three orders, fewer the larger it is.
BLOCK_BYTES = 8 << 20
SCHEMA = "doc_id long, n_words long, n_backed_off long, score double, mean_score double"


def own_counts(h: np.ndarray, of: np.ndarray) -> np.ndarray:
    """How often each gram occurs within its own text; ``h`` are small numbers of the grams."""
    bits = [int(x.max(initial=0)).bit_length() for x in (h, of)] + [len(h).bit_length()]
    if sum(bits) < 64:  # plain sorts of one number are many times as fast as sorts of two that keep positions
        order = np.sort((h << bits[1] | of) << bits[2] | np.arange(len(h))) & ((1 << bits[2]) - 1)
    else:
        order = np.lexsort((of, h))
    hs, os = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (os[1:] != os[:-1])
    start = np.flatnonzero(new)
    runs = np.diff(np.append(start, len(h)))
    out = np.empty(len(h), np.int64)
    out[order] = np.repeat(runs, runs)
    return out


def stupid_backoff(docs: DataFrame, order: int = ORDER, doc_id: str = "doc_id", text: str = "text", frequent: int = 1 << blocks.NUMBER_BITS) -> DataFrame:
    """(doc_id, n_words, n_backed_off, score, mean_score), a row for each row of ``docs``.

    A null or empty text has no words, score 0 and a null mean. Rows with equal ids are scored each
    for itself. An empty table gives an empty result. Other columns of ``docs`` are ignored. ``frequent`` words
    at most (65,536) get numbers, by which n-grams made of them travel; it changes bytes, not results.
    """
    docs = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    n_words, words = blocks.frequent_words(docs, frequent)
    bits = blocks.range_bits(common.shuffle_partitions(docs.sparkSession), n_words * order // 4)  # six tables, counted one at a time: a range may take four times as much
    numbered = np.argsort(words)
    held = docs.sparkSession.sparkContext.broadcast((words[numbered], numbered))

    def numbers(hashes):
        ranked, number = held.value
        if not len(ranked):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(ranked, hashes), len(ranked) - 1)
        return np.where(ranked[at] == hashes, number[at], -1)

    def grams_of(hashes, slots, lens):
        out, number = [], numbers(hashes)
        for n in range(1, order + 1):
            names, known, _ = blocks.ngram_names(hashes, slots, lens, n, number, bits)
            out += [np.unique(names[~known], return_counts=True), np.unique(names[known], return_counts=True)]
        return out

    def packing(n):
        hashed = lambda names: blocks.pack_in_range(names, bits), lambda blob: blocks.unpack_in_range(blob, bits)
        return hashed, (lambda names: blocks.pack_numbered(names, n), lambda blob: blocks.unpack_numbered(blob, n))

    def place(ids, hashes, slots, lens, tables):
        starts = np.concatenate([[0], np.cumsum(lens)])[:-1]
        left: list[np.ndarray] = []  # by order: count without the own text, at the position of the gram's last word
        total = int(lens.sum())
        number = numbers(hashes)
        for n in range(1, order + 1):
            names, known, of = blocks.ngram_names(hashes, slots, lens, n, number, bits)
            (rest, rest_totals), (grams, totals) = tables[2 * n - 2 : 2 * n]
            gram = np.empty(len(names), np.int64)
            gram[~known] = np.searchsorted(rest, names[~known])
            gram[known] = np.searchsorted(grams, names[known]) + len(rest)
            own = np.ones(len(gram), np.int64)
            repeated = np.bincount(gram)[gram] > 1  # within the block; a gram found once is its text's own
            own[repeated] = own_counts(gram[repeated], of[repeated])
            f = np.concatenate([rest_totals, totals])[gram] - own
            at = np.flatnonzero(np.repeat(lens >= n, lens) & (np.arange(total) - np.repeat(starts, lens) >= n - 1))
            full = np.full(total, -1, np.int64)
            full[at] = f
            left.append(full)
        rest = np.maximum(n_words - lens, 1).repeat(lens)
        log = np.log10(np.maximum(left[0], 0.5) / rest)
        done = np.zeros(total, bool)
        score = np.zeros(total)
        depth = np.zeros(total, np.int64)
        for n in range(order, 1, -1):
            known = left[n - 1] >= 0
            seen = known & (left[n - 1] > 0) & ~done
            context = np.concatenate([[0], left[n - 2][:-1]])  # the gram without its last word ends one word earlier
            score[seen] = np.log10(left[n - 1][seen] / context[seen])
            done |= seen
            step = known & ~done
            depth[step] += 1
        score = np.where(done, score, log) + depth * np.log10(BACKOFF)
        of = np.repeat(np.arange(len(lens)), lens)
        sums = np.bincount(of, score, len(lens))
        return blocks.frame(
            {
                "doc_id": (ids, pa.int64()), "n_words": (lens, pa.int64()), "n_backed_off": (np.bincount(of[depth > 0], minlength=len(lens)), pa.int64()),
                "score": (sums, pa.float64()), "mean_score": (np.where(lens > 0, sums / np.maximum(lens, 1), np.nan), pa.float64()),
            }
        )

    packings = [x for n in range(1, order + 1) for x in packing(n)]
    scored = blocks.with_counts(docs, grams_of, place, SCHEMA, bits, lower=False, block_bytes=BLOCK_BYTES, packing=packings)
    return scored.withColumn("mean_score", F.nanvl("mean_score", F.lit(None).cast("double")))

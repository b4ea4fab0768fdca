"""Substring deduplication by sliding sentence spans.

From every sentence starts a span, and at every sentence ends one: the fewest consecutive sentences, two
at least, that hold WORDS words together. What a span holds depends on its own text only, so equal
passages have equal spans wherever they stand. Any longer run is covered by the spans within it: a
sentence too near the run's end to start one is in the span that ends there. All spans of all documents
are hashed and joined globally; a span that also stands at an earlier place is a later repeat, and the
sentences that a later repeat covers are removed. The first place of a span keeps its sentences.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import U64, mix
from .places import DOC, at_place, doc_key, later_repeats

SENTENCES = 2
WORDS = 20
#: A sentence ends behind . ! or ? before white space, and at a line's end.
_BREAK = re.compile(r"(?<=[.!?])[ \t\x0b\f\r]+|[ \t\x0b\f\r]*\n\s*")
_BASE = 0x9E3779B97F4A7C15


def sentences(text: str) -> list[tuple[int, int, int]]:
    """(begin, end, begin of the next) of every sentence that has a word."""
    out, begin = [], 0
    for gap in _BREAK.finditer(text):
        if text[begin : gap.start()].strip():
            out.append((begin, gap.start(), gap.end()))
            begin = gap.end()
    if text[begin:].strip():
        out.append((begin, len(text), len(text)))
    return out


def spans(text: str, least: int = SENTENCES, words: int = WORDS, both: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, begin, end) of the spans that start and that end at each sentence, as far as there are
    enough words; a span that is both is there once. Without ``both``: those that start only."""
    own = [text[a:b].strip() for a, b, _ in sentences(text)]
    n = len(own)
    if n < least:
        return np.empty(0, U64), np.empty(0, np.int64), np.empty(0, np.int64)
    h = np.fromiter((xxhash.xxh3_64_intdigest(s.encode("utf-8", "replace")) for s in own), U64, n)
    held = np.concatenate([[0], np.cumsum([len(s.split()) for s in own])])
    end = np.maximum(np.searchsorted(held, held[:-1] + words), np.arange(n) + least)
    begin = np.minimum(np.searchsorted(held, held[1:] - words, "right") - 1, np.arange(1, n + 1) - least)
    start, last = np.flatnonzero(end <= n), np.flatnonzero((begin >= 0) & both)
    last = last[end[begin[last]] != last + 1]
    start, end = np.concatenate([start, begin[last]]), np.concatenate([end[start], last + 1])
    # the hash of a span folds its sentences' hashes in order; spans of one length are folded together
    acc = mix(h[start] + U64(1))
    reach = start + 1
    while (open_ := np.flatnonzero(reach < end)).size:
        acc[open_] = mix(acc[open_] * U64(_BASE) ^ h[reach[open_]])
        reach[open_] += 1
    return mix(acc ^ (end - start).astype(U64)), start, end


def later_spans(docs: DataFrame, least: int = SENTENCES, words: int = WORDS, doc_id: str = "doc_id", text: str = "text", both: bool = True) -> DataFrame:
    """(rf_doc, rf_text, i, j, first_doc): spans of sentences i to j - 1 that also stand at an earlier place."""

    def run(batches):
        for batch in batches:
            docs_, texts_ = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: list[list] = [[], [], [], [], []]
            for d, t, body in zip(docs_, texts_, batch.column(2).to_pylist(), strict=True):
                g, begin, end = spans(body, least, words, both)
                if not len(g):
                    continue
                out[0].append(g.view(np.int64))
                out[1] += [d] * len(g)
                out[2] += [t] * len(g)
                out[3].append(begin.astype(np.int32))
                out[4].append(end.astype(np.int32))
            g, i, j = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (out[0], out[3], out[4]))
            yield pa.record_batch(
                [pa.array(g, pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(i, pa.int32()), pa.array(j, pa.int32())],
                ["g", *DOC, "i", "j"],
            )

    raw = docs.select(*doc_key(docs, doc_id, text), docs[text].alias("body")).where("body is not null")
    made = raw.mapInArrow(run, "g long, rf_doc long, rf_text long, i int, j int")
    return later_repeats(made)


def dedup_sentences(docs: DataFrame, least: int = SENTENCES, words: int = WORDS, doc_id: str = "doc_id", text: str = "text", both: bool = True) -> DataFrame:
    """``docs``, a row for each row, with the covered sentences cut out of ``text`` together with the white
    space behind them, and columns ``sentences_total``, ``sentences_removed`` and ``first_docs`` (where the
    removed spans stand first, null where none is removed); columns of these names in ``docs`` are replaced.

    A null text stays null and has no sentences. Rows of equal id and text are one place and lose the same
    sentences; rows of equal id and other text are ordered by the text's hash; null ids come first. An
    empty table gives an empty result. Other columns are kept whatever their names. A very long text is one
    row, which one task cuts.
    """
    extra = ["sentences_total", "sentences_removed", "first_docs"]
    docs = docs.drop(*extra)
    gone = later_spans(docs, least, words, doc_id, text, both).groupBy(*DOC).agg(F.collect_list(F.struct("i", "j")).alias("rf_spans"), F.collect_set("first_doc").alias("rf_first"))
    joined, name = at_place(docs, gone, "left", doc_id, text)
    columns = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField(extra[0], T.LongType()), T.StructField(extra[1], T.LongType()), T.StructField(extra[2], T.ArrayType(T.LongType()))])

    def cut(batches):
        for batch in batches:
            texts, totals, removed = [], [], []
            for body, found in zip(batch.column(text).to_pylist(), batch.column(name["rf_spans"]).to_pylist(), strict=True):
                own = sentences(body) if body else []
                cover = np.zeros(len(own) + 1, np.int64)
                for s in found or ():
                    cover[s["i"]] += 1
                    cover[s["j"]] -= 1
                hit = np.cumsum(cover)[:-1] > 0
                if hit.any():
                    pieces, at = [], 0
                    for k in np.flatnonzero(hit):
                        pieces.append(body[at : own[k][0]])
                        at = own[k][2]
                    body = "".join(pieces) + body[at:]
                texts.append(body)
                totals.append(len(own))
                removed.append(int(hit.sum()))
            kept = [pa.array(texts, pa.string()) if c == text else batch.column(c) for c in columns]
            arrays = [*kept, pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), batch.column(name["rf_first"])]
            yield pa.record_batch(arrays, [*columns, *extra])

    return joined.mapInArrow(cut, schema)


def digest(docs: DataFrame, both: bool = True) -> DataFrame:
    """(doc_id, sentences_total, sentences_removed, first_docs, text_sha256) of every document. Without
    ``both``, by the spans that start at each sentence alone."""
    out = dedup_sentences(docs.select("doc_id", "text"), both=both)
    return out.select("doc_id", "sentences_total", "sentences_removed", F.array_sort("first_docs").alias("first_docs"), F.sha2("text", 256).alias("text_sha256"))

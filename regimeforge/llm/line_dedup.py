"""Line deduplication by winnowing over line hashes, in DataFrame functions only.

A document is the sequence of its lines that have a word. A run of RUN or more lines that also stands at
an earlier place (an earlier document, or further up in the same one) is deleted; the first place stays.
So is a shorter run that holds WORDS or more words.

1. Winnowing: of every window of RUN line hashes the least is selected. Two equal windows select
   the same hash, so no repeated run of RUN lines is without a common fingerprint, and only selected
   fingerprints are shuffled, each with the lines around it.
2. Fingerprints that the corpus has once are dropped; the others join by hash.
3. A fingerprint is extended both ways to the windows it was selected in; a window whose lines stand
   at an earlier place is a later repeat. Windows that follow each other make up the whole run.
4. Shorter runs have no window to select from: each that holds enough words is a fingerprint itself.
5. The lines of the later repeats are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .places import DOC, at_place, doc_key, fresh, later_repeats, split_key

RUN = 3
WORDS = 20
#: A line with a word: anything but ASCII white space.
_FULL = r"[^ \t\n\x0B\f\r]"
_WORD = _FULL + "+"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def fingerprints(docs: DataFrame, run: int, doc_id: str, text: str) -> DataFrame:
    """(rf_doc, rf_text, m, p, start, around): the selected line hash, its position among the full
    lines, and the line hashes around it with the position of the first of these."""
    hashed = docs.select(*doc_key(docs, doc_id, text), F.transform(F.filter(_lines(docs[text]), lambda x: x.rlike(_FULL)), lambda x: F.xxhash64(x)).alias("h"))
    hashed = hashed.where(F.size("h") >= run)

    def least(i: Column) -> Column:
        window = F.slice("h", i + 1, run)
        return (i + F.array_position(window, F.array_min(window)) - 1).cast("int")

    def around(p: Column) -> Column:
        start = F.greatest(p - (run - 1), F.lit(0))
        return F.struct(F.get("h", p).alias("m"), p.alias("p"), start.alias("start"), F.slice("h", start + 1, p + run - start).alias("around"))

    selected = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("h") - run), least))
    return hashed.select(*DOC, F.inline(F.transform(selected, around)))


def short_windows(docs: DataFrame, run: int, words: int, doc_id: str, text: str) -> DataFrame:
    """(rf_doc, rf_text, i, n, g): every window of n full lines from index i, n under ``run``, that holds
    ``words`` words or more."""
    full = F.filter(_lines(docs[text]), lambda x: x.rlike(_FULL))
    hashed = docs.select(*doc_key(docs, doc_id, text), F.transform(full, lambda x: F.struct(F.xxhash64(x).alias("h"), F.regexp_count(x, F.lit(_WORD)).alias("w"))).alias("l"))

    def window(n: int) -> Column:
        def one(i: Column) -> Column:
            part = F.slice("l", i + 1, n)
            held = sum((F.get("l", i + k)["w"] for k in range(1, n)), F.get("l", i)["w"])
            return F.when(held >= words, F.struct(i.alias("i"), F.lit(n).alias("n"), F.xxhash64(part["h"]).alias("g")))

        return F.when(F.size("l") >= n, F.array_compact(F.transform(F.sequence(F.lit(0), F.size("l") - n), one))).otherwise(F.array())

    return hashed.select(*DOC, F.inline(F.concat(*(window(n) for n in range(1, run)))))


def repeated_windows(docs: DataFrame, run: int = RUN, doc_id: str = "doc_id", text: str = "text", words: int | None = WORDS) -> DataFrame:
    """(rf_doc, rf_text, i, n, first_doc): windows of n full lines from index i that also stand at an
    earlier place. n is ``run``, or less where the window holds ``words`` words (None: never less)."""
    found = fingerprints(docs, run, doc_id, text)
    place = F.struct(*DOC, "p")
    busy = found.groupBy("m").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo < hi").select("m", split_key("m"))
    found = found.select("*", split_key("m")).join(busy, ["m", "rf_split"], "left_semi")
    own = F.transform(
        F.sequence(F.lit(0), F.size("around") - run),
        lambda k: F.when(F.array_min(F.slice("around", k + 1, run)) == F.col("m"), F.struct((F.col("start") + k).alias("i"), F.xxhash64(F.slice("around", k + 1, run)).alias("g"))),
    )
    windows = found.where(F.size("around") >= run).select(*DOC, F.inline(F.array_compact(own))).select(*DOC, "i", F.lit(run).alias("n"), "g")
    if words is not None and run > 1:
        windows = windows.unionByName(short_windows(docs, run, words, doc_id, text))
    return later_repeats(windows)


def dedup_lines(docs: DataFrame, run: int = RUN, doc_id: str = "doc_id", text: str = "text", words: int | None = WORDS) -> DataFrame:
    """``docs``, a row for each row, with the later repeated runs cut out of ``text``, and two columns
    more: ``lines_total`` and ``lines_removed`` (of lines with a word). The operator's own columns of
    these names replace any that ``docs`` had.

    Without ``words`` runs under ``run`` lines stay, whatever they hold.

    Lines end at \\n. Lines without a word are never matched or deleted. A null text stays null and an
    empty one empty, with no lines; a document may become empty. Rows of equal id and text are one place
    and keep or lose the same lines; rows of equal id and other text are ordered by the text's hash; null
    ids come first. An empty table gives an empty result. Other columns are kept whatever their names. A
    very long text is one row, whose lines one task holds.
    """
    docs = docs.drop("lines_total", "lines_removed")
    starts = repeated_windows(docs, run, doc_id, text, words).groupBy(*DOC).agg(F.collect_set(F.struct("i", "n")).alias("rf_starts"))
    joined, name = at_place(docs, starts, "left", doc_id, text)
    full, gone, lines = fresh(joined.columns, "rf_full", "rf_gone", "rf_lines")
    marked = F.transform(_lines(F.col(text)), lambda x, i: F.struct(i.alias("i"), x.rlike(_FULL).alias("full")))
    joined = joined.withColumn(full, F.transform(F.filter(marked, lambda s: s["full"]), lambda s: s["i"]))
    places = F.array_distinct(F.flatten(F.transform(name["rf_starts"], lambda s: F.sequence(s["i"], s["i"] + s["n"] - 1))))
    joined = joined.withColumn(gone, F.transform(places, lambda k: F.get(full, k)))
    joined = joined.withColumn(lines, _lines(F.col(text)))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    cut = F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.array_join(F.transform(kept, lambda k: F.get(lines, k)), "\n"))
    total = F.when(F.col(text).isNull(), 0).otherwise(F.size(full)).cast("long")
    removed = F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long")
    columns = [cut.alias(c) if c == text else F.col(c) for c in docs.columns]
    return joined.select(*columns, total.alias("lines_total"), removed.alias("lines_removed"))

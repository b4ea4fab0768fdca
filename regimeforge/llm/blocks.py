"""Blocks of documents in dictionary-coded form, and exchange of n-gram counts between them.

Moving one row for every word or n-gram of a corpus through a shuffle costs many times the text
itself. Here each task cuts its share of the documents into *blocks* of bounded size. Within a block
every distinct word or n-gram is kept once, so what travels is

* to the count tables, which are partitioned by hash range: a block's distinct n-grams, sorted and
  packed, with their counts, as hashes or, of frequent words only, as numbers of these words;
* back from them: one number for each of these n-grams, in the order in which they were sent.

Memory is bounded by the block and by the hash range, whose number follows the corpus size. A block has a
row for each range that it has n-grams in, and no work for others, so rows and work never exceed its
distinct n-grams: with very many ranges the packing turns into one row for each of them. A frequent word
or n-gram is one entry in each block.

The documents are read twice (once to send, once to place the answers), so the input must be a
repeatable scan such as a parquet table. Each block carries a checksum of what it sent; a block
that differs on the second read stops the job rather than give wrong results.
"""

from __future__ import annotations

import struct
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Text of a block. A task holds one block at a time, with some ten times its size in arrays.
BLOCK_BYTES = 4 << 20
SLICE_ROWS = 256
#: Distinct n-grams that one hash range takes on average.
RANGE_ENTRIES = 3_000_000
#: Bits of a frequent word's number, in the names of n-grams that have such words only.
NUMBER_BITS = 16
#: Text of each task in which frequent words are counted. Which words get numbers changes bytes, never a result.
SAMPLE_BYTES = 1 << 20

U64 = np.uint64


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers as compressed byte planes: small values cost little whatever their type."""
    values = np.ascontiguousarray(values)
    width = values.dtype.itemsize
    planes = values.view(np.uint8).reshape(-1, width).T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(blob: bytes) -> np.ndarray:
    width = blob[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(f"<u{width}").ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob), dtype=U64)


def pack_in_range(names: np.ndarray, bits: int) -> bytes:
    """Sorted ``names`` that share their first ``bits``, without these, in the Elias-Fano form: low bits as they
    are, the others as gaps in unary. It has no table to send along, so small ranges cost what large ones do."""
    n = len(names)
    if not n:
        return b""
    rest = names & U64((1 << (64 - bits)) - 1)
    low = max(64 - bits - n.bit_length(), 0)
    whole, odd = divmod(low, 8)
    gaps = np.zeros(int(rest[-1] >> U64(low)) + n, np.uint8)
    gaps[(rest >> U64(low)).astype(np.int64) + np.arange(n)] = 1
    some = (rest >> U64(8 * whole)).astype(np.uint8)
    parts = [np.ascontiguousarray(rest).view(np.uint8).reshape(n, 8)[:, :whole], np.packbits(np.unpackbits(some[:, None], axis=1)[:, 8 - odd :]), np.packbits(gaps)]
    return struct.pack("<I", n) + b"".join(p.tobytes() for p in parts)


def unpack_in_range(blob: bytes, bits: int) -> np.ndarray:
    """The names without their first ``bits``."""
    if not blob:
        return np.empty(0, U64)
    n = struct.unpack_from("<I", blob)[0]
    low = max(64 - bits - n.bit_length(), 0)
    whole, odd = divmod(low, 8)
    raw = np.frombuffer(blob, np.uint8, offset=4)
    ends = whole * n, whole * n + -(-odd * n // 8)
    out = np.zeros((n, 8), np.uint8)
    out[:, :whole] = raw[: ends[0]].reshape(n, whole)
    some = np.zeros((n, 8), np.uint8)
    some[:, 8 - odd :] = np.unpackbits(raw[ends[0] : ends[1]], count=odd * n).reshape(n, odd)
    high = np.flatnonzero(np.unpackbits(raw[ends[1] :])) - np.arange(n)
    return out.view(U64).ravel() | np.packbits(some, axis=1).ravel().astype(U64) << U64(8 * whole) | high.astype(U64) << U64(low)


def pack_numbered(names: np.ndarray, words: int) -> bytes:
    """Sorted ``names`` of n-grams of numbered words, without their hash range: the words' numbers place by
    place, the first as differences, each as its number of bits and these bits."""
    if not len(names):
        return b""
    parts = [(names >> U64(NUMBER_BITS * k) & U64((1 << NUMBER_BITS) - 1)).astype(np.uint32) for k in reversed(range(words))]
    values = np.concatenate([np.diff(parts[0], prepend=np.uint32(0)), *parts[1:]]) + np.uint32(1)
    size = np.frexp(values)[1] - 1  # bits after the first one, 16 at most
    bits = np.unpackbits((values << (32 - size).astype(np.uint32)).astype(">u4").view(np.uint8).reshape(-1, 4)[:, :2], axis=1)
    sizes = pack(size.astype(np.uint8))
    return struct.pack("<II", len(names), len(sizes)) + sizes + np.packbits(bits[np.arange(16) < size[:, None]]).tobytes()


def unpack_numbered(blob: bytes, words: int) -> np.ndarray:
    """The names without the bits of their hash range."""
    if not blob:
        return np.empty(0, U64)
    n, length = struct.unpack_from("<II", blob)
    size = unpack(blob[8 : 8 + length]).astype(np.int64)
    bits = np.unpackbits(np.frombuffer(blob, np.uint8, offset=8 + length), count=int(size.sum()))
    every = np.zeros((len(size), 16), np.uint8)
    every[np.arange(16) < size[:, None]] = bits
    tail = np.packbits(every, axis=1).view(">u2").ravel().astype(np.int64) >> (16 - size)
    parts = ((1 << size) + tail - 1).astype(U64).reshape(words, n)
    out = np.cumsum(parts[0], dtype=U64)
    for part in parts[1:]:
        out = out << U64(NUMBER_BITS) | part
    return out


def narrow(values: np.ndarray) -> np.ndarray:
    """The same non-negative values in the least unsigned type that holds them."""
    top = int(values.max()) if len(values) else 0
    return values.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else U64)


def iter_blocks(batches: Iterator[pa.RecordBatch], block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, list, list[str]]]:
    """(block id, ids, texts) from batches of (id, text); a null text is empty. A text is never cut:
    one longer than the bound makes a block of its own with what came before it."""
    first = TaskContext.get().partitionId() << 32
    ids: list = []
    texts: list[str] = []
    size = n = 0
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):  # a batch may be much larger than a block
            part = batch.slice(at, SLICE_ROWS)
            for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append(t or "")
                size += len(texts[-1])
                if size >= block_bytes:
                    yield first + n, ids, texts
                    ids, texts, size, n = [], [], 0, n + 1
    if ids:
        yield first + n, ids, texts


def words_of(text: str, lower: bool) -> list[bytes]:
    """Runs of anything but ASCII white space; ``lower`` lowers A-Z only."""
    raw = text.encode()
    return (raw.lower() if lower else raw).split()


def index_words(texts: list[str], lower: bool) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct words, slot of each word of all texts in order, words of each text). The most frequent
    words have the lowest slots, which makes the slots compress well."""
    index: dict[bytes, int] = defaultdict()
    index.default_factory = index.__len__
    slots, lens = [], []
    for text in texts:
        words = words_of(text, lower)
        slots.append(np.fromiter(map(index.__getitem__, words), np.uint32, len(words)))
        lens.append(len(words))
    words, flat = list(index), np.concatenate(slots) if slots else np.empty(0, np.uint32)
    order = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")
    rank = np.empty(len(words), np.uint32)
    rank[order] = np.arange(len(words))
    return [words[k] for k in order], rank[flat], np.array(lens, np.int64)


def code_words(texts: list[str], lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each distinct word, slot of each word of all texts in order, words of each text)."""
    words, slots, lens = index_words(texts, lower)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), U64, len(words)), slots, lens


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a bijection whose bits all depend on all bits of its input."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def ngram_hashes(hashes: np.ndarray, slots: np.ndarray, lens: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of its text) of every n-gram that lies within one text, in order."""
    of = np.repeat(np.arange(len(lens)), lens)
    h = hashes[slots]
    acc = mix(h + U64(n))
    for j in range(1, n):
        acc = mix(acc[:-1] * U64(0x9E3779B97F4A7C15) ^ h[j:]) if len(acc) else acc
    if n > 1:
        inside = of[: len(acc)] == of[n - 1 :] if len(of) >= n else np.zeros(0, bool)
        return acc[: len(inside)][inside], of[: len(inside)][inside]
    return acc, of


def shingle_sets(hashes: np.ndarray, slots: np.ndarray, lens: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of its text), distinct within a text and ordered by text, then hash. A text of
    fewer than n words gives its whole word sequence as one shingle; one without words gives none."""
    h, of = ngram_hashes(hashes, slots, lens, n)
    for size in range(1, n):
        if (lens == size).any():
            sh, so = ngram_hashes(hashes, slots, lens, size)
            short = lens[so] == size
            h, of = np.concatenate([h, sh[short]]), np.concatenate([of, so[short]])
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return h[new], of[new]


def frequent_words(docs: DataFrame, most: int = 1 << NUMBER_BITS) -> tuple[int, np.ndarray]:
    """(words of all texts of ``docs`` (id, text), hashes of ``most`` frequent words at most, most frequent first).

    All texts are read for the first; the second is counted in the first megabyte of each task.
    """

    def measure(batches):
        size = total = 0
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for t in batch.column(1).to_pylist():
                words = words_of(t or "", False)
                total += len(words)
                if size < SAMPLE_BYTES:
                    counts.update(words)
                    size += len(t or "")
        hashes = [None, *np.fromiter(map(xxhash.xxh3_64_intdigest, counts), U64, len(counts)).view(np.int64).tolist()]
        yield pa.record_batch([pa.array(hashes, pa.int64()), pa.array([total, *counts.values()], pa.int64())], ["word", "n"])

    got = docs.mapInArrow(measure, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.col("word").isNotNull(), F.desc("n"), "word").limit(1 + most).toArrow()
    if not got.num_rows:
        return 0, np.empty(0, U64)
    return got["n"][0].as_py(), got["word"].slice(1).to_numpy().astype(np.int64).view(U64)


def ngram_names(hashes: np.ndarray, slots: np.ndarray, lens: np.ndarray, n: int, numbers: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, whether it is made of numbers, index of its text) of every n-gram within one text, in order.

    ``numbers`` has the number of each distinct word, -1 for none. An n-gram of numbered words is named by
    them, after the ``bits`` of a hash range; any other by its hash. So the two kinds are tables of their own.
    """
    names, of = ngram_hashes(hashes, slots, lens, n)
    if bits + n * NUMBER_BITS > 64:
        return names, np.zeros(len(names), bool), of
    word = numbers[slots]
    at = np.flatnonzero(np.arange(len(word)) + n <= np.repeat(np.cumsum(lens), lens))
    known = np.ones(len(at), bool)
    key = np.zeros(len(at), U64)
    for j in range(n):
        part = word[at + j]
        known &= part >= 0
        key = key << U64(NUMBER_BITS) | part.astype(U64)
    key = key[known]
    names[known] = (mix(key) >> U64(64 - bits)) << U64(64 - bits) | key if bits else key
    return names, known, of


def range_bits(spark_partitions: int, entries: int) -> int:
    """A hash range is named by the first bits of the hash. How many: by size, and enough ranges to keep
    all tasks busy."""
    return (max(spark_partitions, -(-entries // RANGE_ENTRIES), 1) - 1).bit_length()


def range_of(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, bounds): the distinct values of sorted ``keys`` and where each one's run starts, with the end."""
    start = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1)) if len(keys) else np.empty(0, np.int64)
    return keys[start], np.append(start, len(keys))


BLOCK_SCHEMA = "block long, ids array<long>, lens binary, slots binary, hashes binary"
SENT_SCHEMA = "range long, block long, check long, grams array<binary>, counts binary"
BACK_SCHEMA = "block long, range long, check long, totals binary"


def checksum(arrays: list[np.ndarray]) -> int:
    digest = xxhash.xxh3_64()
    for a in arrays:
        digest.update(np.ascontiguousarray(a).tobytes())
    return digest.intdigest() >> 1


def coded_blocks(docs: DataFrame, lower: bool, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each block of ``docs`` (id, text): ids, and the words of its texts as slots in the
    block's table of word hashes."""

    def code(batches):
        for block, ids, texts in iter_blocks(batches, block_bytes):
            hashes, slots, lens = code_words(texts, lower)
            yield pa.record_batch(
                [
                    pa.array([block], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([pack(narrow(lens))], pa.binary()),
                    pa.array([pack(narrow(slots))], pa.binary()), pa.array([pack(hashes)], pa.binary()),
                ],
                ["block", "ids", "lens", "slots", "hashes"],
            )

    return docs.mapInArrow(code, BLOCK_SCHEMA)


def read_block(table: pa.Table) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, word hashes, slots, lens) of a row of coded_blocks."""
    row = table.slice(0, 1).to_pydict()
    return row["ids"][0], unpack(row["hashes"][0]), unpack(row["slots"][0]), unpack(row["lens"][0]).astype(np.int64)


def corpus_counts(docs: DataFrame, grams_of, bits: int, lower: bool, block_bytes: int = BLOCK_BYTES, packing=None) -> DataFrame:
    """For every block, the corpus-wide totals of its distinct n-grams.

    ``grams_of(hashes, slots, lens)`` lists arrays of (sorted distinct gram hash, count in the block),
    one for each table. ``packing`` lists how each table's grams are packed and unpacked; None: as sorted
    hashes. Returns rows (block, range, check, totals): ``totals`` is a packed array of all tables, one after
    the other, each in the order of the block's sorted grams that fall in the hash range.
    """
    packing = packing or defaultdict(lambda: (pack_sorted, unpack_sorted))

    def send(batches):
        for block, _, texts in iter_blocks(batches, block_bytes):
            found = grams_of(*code_words(texts, lower))
            check = checksum([g for g, _ in found])
            kept = np.unique(np.concatenate([range_of(g, bits) for g, _ in found]))
            cuts = kept.astype(U64) << U64(64 - bits) if bits else kept.astype(U64)
            bounds = [np.append(np.searchsorted(g, cuts), len(g)) for g, _ in found]
            grams = [[packing[t][0](g[b[k] : b[k + 1]]) for t, ((g, _), b) in enumerate(zip(found, bounds, strict=True))] for k in range(len(kept))]
            counts = [pack(narrow(np.concatenate([c[b[k] : b[k + 1]] for (_, c), b in zip(found, bounds, strict=True)]))) for k in range(len(kept))]
            yield pa.record_batch(
                [
                    pa.array(kept, pa.int64()), pa.array([block] * len(kept), pa.int64()), pa.array([check] * len(kept), pa.int64()),
                    pa.array(grams, pa.list_(pa.binary())), pa.array(counts, pa.binary()),
                ],
                ["range", "block", "check", "grams", "counts"],
            )

    def total(table: pa.Table) -> pa.Table:
        got = table.to_pydict()
        out: list[list[np.ndarray]] = [[] for _ in got["block"]]
        sent = [unpack(c) for c in got["counts"]]
        ends = [0] * len(sent)
        for t in range(len(got["grams"][0])):
            parts = [packing[t][1](g[t]) for g in got["grams"]]
            counts = np.concatenate([c[e : e + len(p)] for c, e, p in zip(sent, ends, parts, strict=True)]).astype(np.int64)
            ends = [e + len(p) for e, p in zip(ends, parts, strict=True)]
            grams = np.concatenate(parts)
            order = np.argsort(grams, kind="stable")
            ranked = grams[order]
            new = np.ones(len(ranked), bool)
            new[1:] = ranked[1:] != ranked[:-1]
            start = np.flatnonzero(new)
            sums = np.add.reduceat(counts[order], start) if len(start) else counts[:0]
            totals = np.empty(len(grams), np.int64)
            totals[order] = np.repeat(sums, np.diff(np.append(start, len(ranked))))
            at = 0
            for k, part in enumerate(parts):
                out[k].append(narrow(totals[at : at + len(part)]))
                at += len(part)
        return pa.table(
            {"block": pa.array(got["block"], pa.int64()), "range": pa.array(got["range"], pa.int64()), "check": pa.array(got["check"], pa.int64()), "totals": pa.array([pack(np.concatenate(x)) for x in out], pa.binary())}
        )

    return docs.mapInArrow(send, SENT_SCHEMA).groupBy("range").applyInArrow(total, BACK_SCHEMA)


def with_counts(docs: DataFrame, grams_of, place, schema: str, bits: int, lower: bool, block_bytes: int = BLOCK_BYTES, packing=None) -> DataFrame:
    """``place(ids, hashes, slots, lens, tables)`` over every block, where ``tables`` lists (sorted
    grams, corpus-wide totals); it returns an Arrow table of ``schema``."""
    totals = corpus_counts(docs, grams_of, bits, lower, block_bytes, packing)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0:
            raise RuntimeError("counts came back for a block that the second read did not make: the input is not a repeatable scan; write it first")
        ids, hashes, slots, lens = read_block(left)
        found = grams_of(hashes, slots, lens)
        got = right.sort_by("range").to_pydict()
        back = [unpack(x) for x in got["totals"]]
        sizes = [np.diff(np.searchsorted(range_of(g, bits), got["range"]), append=len(g)) for g, _ in found]
        if sum(map(len, back)) != sum(len(g) for g, _ in found) or (got["check"] and set(got["check"]) != {checksum([g for g, _ in found])}):
            raise RuntimeError("a block differs between two reads: the input is not a repeatable scan; write it first")
        tables, ends = [], np.zeros(len(back), np.int64)
        for (grams, _), size in zip(found, sizes, strict=True):
            parts = [x[e : e + k].astype(np.int64) for x, e, k in zip(back, ends, size, strict=True)]
            tables.append((grams, np.concatenate(parts) if parts else np.empty(0, np.int64)))
            ends = ends + size
        return place(ids, hashes, slots, lens, tables)

    blocks = coded_blocks(docs, lower, block_bytes)
    return blocks.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(meet, schema)


def frame(columns: dict[str, tuple[object, pa.DataType]]) -> pa.Table:
    return pa.table({k: pa.array(v, t) for k, (v, t) in columns.items()})

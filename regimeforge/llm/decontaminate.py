"""Benchmark decontamination by greedy string tiling.

1. *Seeds*: hashes of every SEED consecutive tokens of the benchmark items. A Bloom filter of these, whose
   size has a fixed bound, goes to all tasks; what passes it in a document is joined by hash with the
   table of seeds, so a false hit of the filter finds no partner.
2. *Candidates*: a document and an item that share seeds, with the places of these in the document.
   A match of SEED or more tokens consists of shared seeds only, so no other token is needed.
3. *Tiling*: for each candidate the longest matches that do not overlap are marked again and again. They
   are found by running Karp-Rabin: the hashes of all windows of the search length in the document go to a
   table, and those of the item are looked up there; the search length falls to the longest that is left.
4. A document is contaminated by an item when its tiles cover COVERAGE of the item's tokens. The order of the
   tiles does not count, so a passage whose parts are moved about is found too.

An item of fewer than SEED tokens has one seed, all of it, and is found where that stands in a document.
Tokens are lower-cased runs of letters and digits.
"""

from __future__ import annotations

import re
from collections import deque

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, common
from .places import DOC, at_place, doc_key

SEED = 5
COVERAGE = 0.5
#: Bits of the filter for each seed, and the most bits it may have (32 MB).
BITS, MOST_BITS = 32, 1 << 28
BLOCK_CHARS = 4 << 20
TILE_ROWS = 64
_TOKEN = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x1F3D5B79A2C4E6A7)
#: Words of the filter that are packed into one row before they leave the executors (64 KB).
CHUNK = 8192


def code_tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each token of all texts in order, tokens of each text). Distinct words are cut once."""
    words, slots, lens = blocks.index_words(texts, lower=False)
    count, flat = np.empty(len(words), np.int64), []
    for k, w in enumerate(words):
        own = _TOKEN.findall(w.decode().lower())
        count[k] = len(own)
        flat += own
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(t) for t in flat), np.uint64, len(flat))
    begin = np.cumsum(count) - count
    n = count[slots]
    index = np.arange(int(n.sum())) + np.repeat(begin[slots] - (np.cumsum(n) - n), n)
    before = np.concatenate([[0], np.cumsum(n)])
    ends = np.cumsum(lens)
    return hashes[index], before[ends] - before[ends - lens]


def seed_hashes(tokens: np.ndarray, lens: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, index of its text, position in the text) of every ``seed`` consecutive tokens."""
    h, of = blocks.ngram_hashes(tokens, np.arange(len(tokens)), lens, seed)
    first = np.searchsorted(of, np.arange(len(lens)))
    return h, of, np.arange(len(h)) - first[of]


class Tiles:
    """Greedy string tiling of one document's shared seeds against one item.

    Tiles are marked from the longest length down. At each length every match of unmarked tokens is maximal,
    as nothing longer is left, so one walk along the item marks them all: a place of the item takes the first
    free place of the document with the same Karp-Rabin hash, and places that are not free any more are
    dropped for good. The next length is found by bisection, as a match has matches of all lesser lengths
    in it. A length costs a sort of the places, and tiles of k different lengths need k * k / 2 tokens, so
    repeated tokens cost no more than others.
    """

    def __init__(self, positions: list[int], hashes: list[int], item: list[int], n_tokens: int, seed: int):
        self.seed = seed
        at = np.array(positions, np.int64)
        order = np.argsort(at, kind="stable")
        at = at[order]
        # stretches without shared seeds are shortened; the order of positions stays
        at = np.cumsum(np.minimum(np.diff(at, prepend=at[:1]), seed + 1))
        self.at = np.array(positions, np.int64)[order]
        size = int(at[-1]) + 1 if len(at) else 0
        values, held = np.zeros(size, np.uint64), np.zeros(size, bool)
        values[at] = np.array(hashes, np.int64).view(np.uint64)[order]
        held[at] = True
        self.place = np.zeros(size, np.int64)
        self.place[at] = self.at
        self.sides = []
        for v, h, tokens in ((np.array(item, np.int64).view(np.uint64), np.ones(len(item), bool), n_tokens), (values, held, size + seed - 1)):
            powers = np.cumprod(np.append(np.uint64(1), np.full(len(v), _BASE, np.uint64)))
            sums = np.concatenate([[np.uint64(0)], np.cumsum(v * powers[:-1], dtype=np.uint64)])
            self.sides.append((v, sums, np.concatenate([[0], np.cumsum(~h)]), np.zeros(tokens + 1, bool)))
        longest = max(len(item), size) + 1
        self.unshift = np.cumprod(np.append(np.uint64(1), np.full(longest, pow(int(_BASE), -1, 1 << 64), np.uint64)))

    def _windows(self, side: int, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, hash) of every run of ``length`` unmarked tokens that consists of shared seeds."""
        values, sums, missing, marked = self.sides[side]
        width = length - self.seed + 1
        n = len(values) - width + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        used = np.concatenate([[0], np.cumsum(marked[:-1])])
        start = np.flatnonzero((missing[width:] == missing[:n]) & (used[length : length + n] == used[:n]))
        return start, (sums[start + width] - sums[start]) * self.unshift[start]

    def _matches(self, length: int) -> bool:
        return bool(np.isin(self._windows(0, length)[1], self._windows(1, length)[1]).any())

    def run(self) -> list[tuple[int, int, int]]:
        """(item position, document position, tokens) of the tiles."""
        tiles, most = [], min(len(self.sides[0][0]), len(self.sides[1][0])) + self.seed - 1
        while most >= self.seed and self._matches(self.seed):
            low, high = self.seed, most
            while low < high:
                middle = (low + high + 1) // 2
                low, high = (middle, high) if self._matches(middle) else (low, middle - 1)
            tiles += self._mark(low)
            most = low - 1
        return tiles

    def _mark(self, length: int) -> list[tuple[int, int, int]]:
        (q, hq), (p, hp) = self._windows(0, length), self._windows(1, length)
        both = np.isin(hq, hp)
        places: dict[int, deque[int]] = {}
        for at, h in zip(p.tolist(), hp.tolist(), strict=True):
            places.setdefault(h, deque()).append(at)
        item, doc, used_q, used_p, width = self.sides[0][0], self.sides[1][0], self.sides[0][3], self.sides[1][3], length - self.seed + 1
        tiles, free = [], 0
        for at, h in zip(q[both].tolist(), hq[both].tolist(), strict=True):
            if at < free:  # tokens of the tile before
                continue
            waiting = places[h]
            while waiting and used_p[waiting[0] : waiting[0] + length].any():
                waiting.popleft()
            if waiting and (item[at : at + width] == doc[waiting[0] : waiting[0] + width]).all():
                there = waiting.popleft()
                used_q[at : at + length] = used_p[there : there + length] = True
                tiles.append((at, int(self.place[there]), length))
                free = at + length
        return tiles


def benchmark_items(benchmark: DataFrame, seed: int, item_id: str, text: str) -> DataFrame:
    """(item, item_text, n_tokens, seed, grams) of the items that have a token; equal rows once. An item of
    fewer tokens than ``seed`` is its own seed."""

    def run(batches):
        for batch in batches:
            ids, keys, texts = (batch.column(k).to_pylist() for k in range(3))
            if not ids:
                continue
            tokens, lens = code_tokens([t or "" for t in texts])
            h, of, _ = seed_hashes(tokens, lens, seed)
            cut = np.searchsorted(of, np.arange(len(ids) + 1))
            grams = [h[a:b].astype(np.int64) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            before = np.cumsum(lens) - lens
            for k in np.flatnonzero((lens > 0) & (lens < seed)):
                own = tokens[before[k] : before[k] + lens[k]]
                grams[k] = seed_hashes(own, lens[k : k + 1], int(lens[k]))[0].astype(np.int64)
            columns = [pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(lens, pa.int64()), pa.array(np.minimum(lens, seed), pa.int64()), pa.array(grams, pa.list_(pa.int64()))]
            yield pa.record_batch(columns, ["item", "item_text", "n_tokens", "seed", "grams"])

    raw = benchmark.select(benchmark[item_id].cast("long").alias("item"), F.xxhash64(benchmark[text]).alias("item_text"), benchmark[text].alias("body"))
    return raw.mapInArrow(run, "item long, item_text long, n_tokens long, seed long, grams array<long>").where(F.size("grams") > 0).dropDuplicates(["item", "item_text"])


def seed_filter(seeds: DataFrame) -> tuple[np.ndarray, int]:
    """(bytes of the Bloom filter, bits). Two bits for each seed. The bits are combined and packed on the
    executors; what comes to the driver is bounded by MOST_BITS however many seeds there are."""
    n = seeds.count()
    bits = 1 << 20
    while bits < min(BITS * n, MOST_BITS):
        bits <<= 1
    mask = F.lit(bits - 1)
    at = F.explode(F.array(F.col("gram").bitwiseAND(mask), F.shiftrightunsigned("gram", 32).bitwiseAND(mask))).alias("bit")
    word = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(F.lit(63)).cast("int"))
    words = seeds.select(at).select(F.shiftright("bit", 6).alias("w"), word.alias("v")).groupBy("w").agg(F.bit_or("v").alias("v"))

    def pack(table: pa.Table) -> pa.Table:
        chunk = table["w"][0].as_py() // CHUNK
        held = np.zeros(CHUNK, np.int64)
        held[table["w"].to_numpy() - chunk * CHUNK] = table["v"].to_numpy()
        return pa.table({"chunk": pa.array([chunk], pa.int64()), "held": pa.array([held.astype("<i8").tobytes()], pa.binary())})

    packed = words.groupBy(F.floor(F.col("w") / CHUNK)).applyInArrow(pack, "chunk long, held binary").collect()
    out = np.zeros(bits // 8, np.uint8)
    for chunk, held in packed:
        out[chunk * CHUNK * 8 : (chunk + 1) * CHUNK * 8] = np.frombuffer(held, np.uint8)
    return out, bits


def shared_seeds(docs: DataFrame, held: np.ndarray, bits: int, sizes: list[int], doc_id: str, text: str) -> DataFrame:
    """(rf_doc, rf_text, p, gram): places in the documents that pass the filter, of seeds of all ``sizes``."""
    sent = docs.sparkSession.sparkContext.broadcast(held)

    def run(batches):
        filter_, mask = sent.value, np.uint64(bits - 1)
        passes = lambda b: (filter_[(b >> np.uint64(3)).astype(np.int64)] >> (b & np.uint64(7)).astype(np.uint8)) & 1

        def flush():
            tokens, lens = code_tokens(texts)
            for size in sizes:
                h, of, p = seed_hashes(tokens, lens, size)
                hit = np.flatnonzero(passes(h & mask))
                hit = hit[passes((h[hit] >> np.uint64(32)) & mask).astype(bool)]
                of = of[hit]
                yield pa.record_batch(
                    [pa.array([ids[k] for k in of], pa.int64()), pa.array([keys[k] for k in of], pa.int64()), pa.array(p[hit].astype(np.int32)), pa.array(h[hit].astype(np.int64))],
                    [*DOC, "p", "gram"],
                )

        ids, keys, texts, size = [], [], [], 0
        for batch in batches:
            for i, k, t in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                ids.append(i)
                keys.append(k)
                texts.append(t)
                size += len(t)
                if size >= BLOCK_CHARS:
                    yield from flush()
                    ids, keys, texts, size = [], [], [], 0
        if ids:
            yield from flush()

    raw = docs.select(*doc_key(docs, doc_id, text), docs[text].alias("body")).where("body is not null")
    return raw.mapInArrow(run, "rf_doc long, rf_text long, p int, gram long")


def matches(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", coverage: float = 0.0) -> DataFrame:
    """(rf_doc, rf_text, item_id, item_tokens, n_tiles, covered): every document and item that share a tile of
    ``seed`` tokens or more (a short item: all of it) and whose shared seeds could cover ``coverage``."""
    items = common.materialize(benchmark_items(benchmark, seed, item_id, item_text), "items")
    seeds = common.materialize(items.select("item", "item_text", F.explode("grams").alias("gram"), "n_tokens", "seed").distinct(), "seeds")
    sizes = sorted(r[0] for r in items.select("seed").distinct().collect())  # at most ``seed`` numbers
    held, bits = seed_filter(seeds.select("gram").distinct())
    hits = shared_seeds(docs, held, bits, sizes, doc_id, text)
    pairs = hits.join(seeds, "gram").groupBy(*DOC, "item", "item_text").agg(F.collect_set(F.struct("p", "gram")).alias("shared"), F.max(F.struct("n_tokens", "seed")).alias("s"))
    # no tile has a token that no shared seed has
    pairs = pairs.where(F.size("shared") * F.col("s.seed") >= coverage * F.col("s.n_tokens"))

    def tile(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, TILE_ROWS):
                part = batch.slice(at, TILE_ROWS)
                tiles = [Tiles([s["p"] for s in r["shared"]], [s["gram"] for s in r["shared"]], r["grams"], r["n_tokens"], r["seed"]).run() for r in part.to_pylist()]
                cols = [part.column(c) for c in (*DOC, "item", "n_tokens")]
                yield pa.record_batch([*cols, pa.array([len(t) for t in tiles], pa.int64()), pa.array([sum(x[2] for x in t) for t in tiles], pa.int64())], [*DOC, "item_id", "item_tokens", "n_tiles", "covered"])

    found = pairs.join(items, (pairs["item"].eqNullSafe(items["item"])) & (pairs["item_text"] == items["item_text"])).select(*DOC, pairs["item"], items["n_tokens"], items["seed"], "shared", "grams")
    return found.mapInArrow(tile, "rf_doc long, rf_text long, item_id long, item_tokens long, n_tiles long, covered long")


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, **names) -> DataFrame:
    """The rows of ``matches`` whose tiles cover at least ``coverage`` of the item.

    Null and empty texts, and items without a token, match nothing. Equal rows of either table count once;
    null ids are kept as ids. Empty tables give an empty result; other columns are ignored. A very long or
    repetitive text costs time in proportion to its shared seeds, times the number of different tile lengths.
    """
    return matches(docs, benchmark, coverage=coverage, **names).where(F.col("covered") >= coverage * F.col("item_tokens"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, **names) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, that no item contaminates."""
    bad = contaminated(docs, benchmark, coverage, **names).select(*DOC).distinct()
    return at_place(docs, bad, "left_anti", names.get("doc_id", "doc_id"), names.get("text", "text"))[0]


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, item_tokens, n_tiles, covered): a row for each contaminated document and item."""
    return contaminated(docs, benchmark).select(F.col("rf_doc").alias("doc_id"), "item_id", "item_tokens", "n_tiles", "covered")

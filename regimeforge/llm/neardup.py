"""Near duplicates among embeddings: cross-polytope hashing with multiprobe buckets and verified pairs.

A hash turns the vector (random signs, fast Hadamard transform, three times over) and takes the nearest of the
2 * dim signed axes; ``depth`` of them side by side are a bucket. Each vector stands in its ``PROBES`` likeliest
buckets of each table, and two vectors that share a bucket are compared exactly.

What grows: ``depth`` follows the logarithm of the number of vectors, so that a bucket of unlike vectors holds about
one; the number of tables follows from the odds that a pair at the threshold meets, which are simulated. Buckets
with one vector are dropped before any vector moves. A large bucket is compared in tiles of two blocks of its
vectors, so a task never holds more than two blocks; counts and spanning links come out, not pairs.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from . import common
from .components import connected_components

THRESHOLD, RECALL, PROBES, SEED = 0.95, 0.995, 8, 13
#: Nearest axes of each hash that probes are put together from, and vectors of a block of a tile.
NEAREST, BLOCK = 4, 2000
#: Vectors are padded with zeros to this length at least: in fewer dimensions turns leave vectors along axes with equal
#: distances to many axes, whose order a small change reverses.
LEAST_DIM = 64
#: Pairs that are compared or filtered at once, vectors up to which all pairs of a bucket are listed: memory only.
AT_ONCE, LISTED = 100_000, 48


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, a rotation; their length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / math.sqrt(n)


def signs(tables: int, depth: int, dim: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).choice([-1.0, 1.0], size=(tables, depth, 3, dim))


def buckets(unit: np.ndarray, turns: np.ndarray, probes: int = PROBES) -> np.ndarray:
    """(rows, tables, probes) buckets, the likeliest first: combinations of near axes with the least sum of
    squared distances to the nearest one. Equal sums go by the order of the combinations."""
    tables, depth, _, dim = turns.shape
    near = min(NEAREST, 2 * dim)
    ways = np.array(list(itertools.product(range(near), repeat=depth)))
    # a combination can be among the best only if few others are as good in each place
    ways = ways[np.prod(ways + 1, axis=1) <= probes]
    out = np.empty((len(unit), tables, min(probes, len(ways))), np.int64)
    for t in range(tables):
        code, loss = np.zeros((len(unit), len(ways)), np.int64), np.zeros((len(unit), len(ways)))
        for k in range(depth):
            x = unit
            for s in turns[t, k]:
                x = hadamard(x * s)
            size = np.hstack([np.abs(x)] * 2)
            size[:, :dim][x < 0] = -1  # the axis against x is as far away as x is long
            size[:, dim:][x >= 0] = -1
            axes = np.argsort(-size, axis=1, kind="stable")[:, :near]
            far = np.take_along_axis(size, axes, axis=1)
            far = (far[:, :1] - far) ** 2
            code = code * (2 * dim) + axes[:, ways[:, k]]
            loss += far[:, ways[:, k]]
        best = np.argsort(loss, axis=1, kind="stable")[:, : out.shape[2]]
        out[:, t] = np.take_along_axis(code, best, axis=1)
    return out


def odds(depth: int, dim: int, threshold: float, probes: int = PROBES, pairs: int = 2000) -> float:
    """Share of random pairs at the threshold that share a bucket of a table, by simulation with fixed seeds."""
    draw = np.random.default_rng(SEED)
    u, v = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in draw.standard_normal((2, pairs, dim)))
    v = v - (u * v).sum(axis=1, keepdims=True) * u
    v = threshold * u + math.sqrt(1 - threshold**2) * v / np.linalg.norm(v, axis=1, keepdims=True)
    turns = signs(2, depth, dim, SEED + 1)
    a, b = buckets(u, turns, probes), buckets(v, turns, probes)
    return float((a[:, :, :, None] == b[:, :, None, :]).any(axis=(2, 3)).mean())


def plan(vectors: int, dim: int, threshold: float = THRESHOLD, recall: float = RECALL) -> np.ndarray:
    """The turns (signs) of as many tables, of as many hashes each, as the number of vectors and the recall ask for."""
    depth = max(1, min(math.ceil(math.log(max(vectors, 2) * PROBES) / math.log(2 * dim)), int(62 // math.log2(2 * dim))))
    missed = 1 - min(odds(depth, dim, threshold), 1 - 1e-6)
    return signs(max(1, math.ceil(math.log(1 - recall) / math.log(missed))) if missed < 1 else 1, depth, dim)


def _units(vectors: list, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, dim) raw doubles, padded with zeros, and which rows can link: no nulls, finite, not all zero."""
    raw, good = np.zeros((len(vectors), dim)), np.zeros(len(vectors), bool)
    for k, v in enumerate(vectors):
        if v is not None and len(v) and not any(x is None for x in v):
            raw[k, : len(v)] = v
            good[k] = np.isfinite(raw[k]).all() and raw[k].any()
    raw[~good] = 0
    return raw + 0.0, good


def unit(raw: np.ndarray) -> np.ndarray:
    raw = raw / np.maximum(np.abs(raw).max(axis=1, keepdims=True), 1e-300)
    return raw / np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-300)


def _hashed(df: DataFrame, vec_id: str, embedding: str, dim: int, turns: np.ndarray) -> DataFrame:
    """(vec_id, key, vec, codes): a digest of the vector, its raw numbers, its buckets; nulls if it cannot link."""
    from hashlib import blake2b

    kind = np.float32 if isinstance(df.schema[embedding].dataType, ArrayType) and isinstance(df.schema[embedding].dataType.elementType, FloatType) else np.float64

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                raw, good = _units(part.column(1).to_pylist(), dim)
                codes = buckets(unit(raw), turns).reshape(len(raw), -1)
                keep = lambda make: [make(k) if ok else None for k, ok in enumerate(good)]  # noqa: E731, B023
                yield pa.record_batch(
                    [
                        part.column(0), pa.array(keep(lambda k: blake2b(raw[k].tobytes(), digest_size=16).digest()), pa.binary()),  # noqa: B023
                        pa.array(keep(lambda k: raw[k].astype(kind).tobytes()), pa.binary()), pa.array(keep(lambda k: codes[k]), pa.list_(pa.int64())),  # noqa: B023
                    ], [vec_id, "key", "vec", "codes"],
                )

    chosen = df.select(vec_id, F.col(embedding))
    return chosen.mapInArrow(run, f"`{vec_id}` {chosen.schema[0].dataType.simpleString()}, key binary, vec binary, codes array<long>")


class _Tiles:
    """Compares the vectors of whole tiles: rows (key, weight, vec, codes) of one or two blocks of a bucket."""

    def __init__(self, shape: tuple[int, int, int], kind: type, threshold: float) -> None:
        self.shape, self.kind, self.threshold = shape, kind, threshold

    def first(self, r: np.ndarray, c: np.ndarray, codes: np.ndarray, table: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Whether this is the first bucket that the pair shares, by table and then by bucket: it counts there only."""
        out = np.empty(len(r), bool)
        for at in range(0, len(r), AT_ONCE):
            a, b = codes[r[at : at + AT_ONCE]], codes[c[at : at + AT_ONCE]]
            shared = (a[:, :, :, None] == b[:, :, None, :]).any(axis=3)
            t = shared.any(axis=2).argmax(axis=1)
            pick = np.arange(len(a))
            least = np.where(shared[pick, t], a[pick, t], np.iinfo(np.int64).max).min(axis=1)
            here = r[at : at + AT_ONCE]
            out[at : at + AT_ONCE] = (t == table[here]) & (least == bucket[here])
        return out

    def pairs(self, starts: np.ndarray, ends: np.ndarray, x: np.ndarray, own: np.ndarray, across: np.ndarray):
        """Blocks of (r, c), r < c, of rows in one tile whose cosine reaches the threshold."""
        size = ends - starts
        for m in np.unique(size[(size > 1) & (size <= LISTED)]):
            i, j = np.triu_indices(m, 1)
            begin = starts[size == m]
            step = max(1, AT_ONCE // len(i))
            for at in range(0, len(begin), step):
                r, c = ((begin[at : at + step, None] + k).ravel() for k in (i, j))
                good = np.einsum("ij,ij->i", x[r], x[c]) >= self.threshold
                yield r[good], c[good]
        for lo, hi in zip(starts[size > LISTED], ends[size > LISTED], strict=True):
            step = max(1, 4 * AT_ONCE // (hi - lo))
            for at in range(lo, hi, step):
                r, c = np.nonzero(x[at : min(at + step, hi)] @ x[lo:hi].T >= self.threshold)
                r, c = r + at, c + lo
                yield r[r < c], c[r < c]

    def run(self, rows: pa.Table) -> pa.RecordBatch:
        def column(name: str) -> np.ndarray:
            return rows.column(name).to_numpy()

        n = rows.num_rows
        tile = np.stack([column(k) for k in ("t", "b", "ti", "tj")], axis=1)
        starts = np.flatnonzero(np.r_[True, (tile[1:] != tile[:-1]).any(axis=1)])
        ends = np.r_[starts[1:], n]
        x = unit(np.frombuffer(b"".join(rows.column("vec").to_pylist()), self.kind).astype(np.float64).reshape(n, -1))
        codes = rows.column("codes").combine_chunks().flatten().to_numpy().reshape(n, *self.shape)
        own, weight, across = column("own"), column("weight"), column("ti") != column("tj")
        links, root, found = np.zeros(n), np.arange(n), []
        for r, c in self.pairs(starts, ends, x, own, across):
            inside = ~across[r] | (own[r] != own[c])  # a tile of two blocks compares between them only
            r, c = r[inside], c[inside]
            counts = self.first(r, c, codes, tile[:, 0], tile[:, 1])
            r, c = r[counts], c[counts]
            links += np.bincount(r, weight[c], n) + np.bincount(c, weight[r], n)
            found.append(_spanning(r, c, n))
        r, c = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        root = _roots(r, c, n)
        keys, some = rows.column("key"), np.flatnonzero(links)
        return pa.record_batch([keys.take(pa.array(some)).combine_chunks(), pa.array(links[some].astype(np.int64)), keys.take(pa.array(root[some])).combine_chunks()], ["key", "links", "root"])

    def __call__(self, batches):
        """Tiles come sorted; the last one of a batch waits for its rest."""
        rest = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = now if rest is None else pa.concat_tables([rest, now])
            last = np.stack([now.column(k).to_numpy() for k in ("t", "b", "ti", "tj")], axis=1)
            whole = int(np.flatnonzero((last != last[-1]).any(axis=1)).max(initial=-1)) + 1
            if whole:
                yield self.run(now.slice(0, whole))
            rest = now.slice(whole)
        if rest is not None:
            yield self.run(rest)


def _roots(r: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """The least row that each row is connected with."""
    root = np.arange(n)
    while True:
        least, low = root.copy(), np.minimum(root[r], root[c])
        for end in (r, c):
            np.minimum.at(least, end, low)
            np.minimum.at(least, root[end], low)
        least = least[least]
        if (least == root).all():
            return root
        root = least


def _spanning(r: np.ndarray, c: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the same rows as (r, c): one for each row at most."""
    root = _roots(r, c, n)
    hung = np.flatnonzero(root != np.arange(n))
    return hung, root[hung]


def near_duplicates(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(id, n_links, component_id, kept) of every vector.

    Vectors with cosine >= ``threshold`` (in double precision) link; every link given is verified, and a pair exactly at
    the threshold is found with odds of ``recall`` at least, a closer one with higher odds. ``n_links`` counts the
    other rows linked directly, ``component_id`` is the least id reachable, and the row that has it is kept.

    Equal vectors are one class from the start and count by their number. A vector that is null, empty or zero, or
    holds a null or a number that is not finite, links with nothing. A shorter vector counts as followed by zeros. Rows
    with a null id take part; their own id can only be the least where all others are null too. Of rows that share
    an id each is a vector of its own. An empty table gives none. Other columns are not read.
    """
    dim, total = df.agg(F.max(F.size(embedding)), F.count("*")).first()
    dim = max(LEAST_DIM, 1 << math.ceil(math.log2(max(dim or 1, 1))))
    turns = plan(total, dim, threshold, recall)
    shape = (turns.shape[0], turns.shape[1], min(PROBES, buckets(np.eye(1, dim), turns[:1]).shape[2]))
    rows = common.materialize(_hashed(df, vec_id, embedding, dim, turns), "vectors")
    same = rows.where("key IS NOT NULL").groupBy("key")
    classes = common.materialize(same.agg(F.count("*").alias("weight"), F.min(vec_id).alias("least"), F.first("vec").alias("vec"), F.first("codes").alias("codes")), "classes")

    stands = classes.select("key", F.posexplode("codes").alias("at", "b")).select("key", F.expr(f"at div {shape[2]}").alias("t"), "b")
    shared = stands.groupBy("t", "b").agg(F.count("*").alias("n")).where("n > 1")
    split = lambda key: F.pmod(F.xxhash64(key), F.lit(1024)).alias("rf_split")  # noqa: E731  so that the joins below have exchanges of their own, which Spark splits by skew
    met = common.materialize(stands.select("*", split("b")).join(shared.select("*", split("b")), ["t", "b", "rf_split"]).drop("rf_split"), "stands")

    blocks = F.expr(f"(n + {block - 1}) div {block}")
    met = met.withColumn("own", F.pmod(F.xxhash64("key"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    met = met.select("key", "t", "b", "own", F.least("own", "other").alias("ti"), F.greatest("own", "other").alias("tj"))
    tile = ["t", "b", "ti", "tj"]
    tiles = met.join(classes.select("key", "weight", "vec", "codes"), "key").repartition(*tile).sortWithinPartitions(*tile)
    kind = np.float32 if df.schema[embedding].dataType.elementType == FloatType() else np.float64
    links = common.materialize(tiles.mapInArrow(_Tiles((shape[0], shape[2]), kind, threshold), "key binary, links long, root binary"), "links")

    comps = connected_components(links.select("key", "root"), "key", "root")
    sums = links.groupBy("key").agg(F.sum("links").alias("links"))
    known = classes.select("key", "weight", "least").join(sums, "key", "left").join(comps.withColumnRenamed("node", "key"), "key", "left")
    known = common.materialize(known.select("key", "least", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("comp", "key").alias("comp")), "known")
    owner = known.groupBy("comp").agg(F.min("least").alias("component_id"))
    known = known.select("key", "n_links", "comp", split("comp")).join(owner.select("*", split("comp")), ["comp", "rf_split"]).select("key", "n_links", "component_id")
    linked = rows.where("key IS NOT NULL").select(vec_id, "key", split("key")).join(known.select("*", split("key")), ["key", "rf_split"]).select(vec_id, "n_links", "component_id")
    alone = rows.where("key IS NULL").select(vec_id, F.lit(0).cast("long").alias("n_links"), F.col(vec_id).alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col(vec_id).eqNullSafe(F.col("component_id")))

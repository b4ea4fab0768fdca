"""N-gram Jaccard self-join of documents by the size-aware heavy-light method.

A document's set holds its distinct word 5-shingles. Two documents link when
100 * |A and B| >= 80 * |A or B|. The plan:

1. Every shingle's document frequency is counted (``blocks``). Documents with equal sets are one class,
   and each class is one node with a number of its own. A shingle that no other document has is in no
   intersection; a node whose rarest shingles are all of that kind has no partner and goes no further,
   which is most of a corpus.
2. *Light*: a small set enumerates its fixed-size subsets. Sets of n <= m shingles link exactly when they
   share c = ceil(80 (n + m) / 180) of them, so for every size that a partner may have, the subsets of c
   shared shingles are keys; sets that meet at a key link, without a look at them. A key emits one link
   for each member, to its smallest set, and never its pairs.
3. *Heavy*: a large set, and a small one within reach of a large one, is found by scans of inverted lists.
   With shingles ordered from rare to frequent a partner has one of the first n - ceil(0.8 n) + 1, so only
   these are listed. In a *leader scan* one set scans each list and meets its members, which costs as
   much as the lists are long; links are verified and merge components, and a list that lies within one
   component is done. The *full scan* takes what is left: every pair of different components that still
   meets on a list and whose sizes fit, once. All are verified, so the components are exact.
4. The boundary is the set size of least cost, from totals by size over all nodes: keys that the subsets
   need against rows of the lists that a scan reads.

Every step is a shuffle on a key or an aggregate with partial sums; sets move only for candidate pairs.
Shingles are compared by 64-bit hashes, sets by their size and 128 bits, subsets by 128 bits.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks, common
from .components import connected_components
from .places import fresh, split_key

SHINGLE = 5
PERCENT = 80
#: The largest size that the boundary may take: beyond it subsets cost more than any list.
MOST_SMALL = 40
#: Leaders of a list: in the first scan the member with the most frequent shingles; in the second several
#: by a hash, so that a member which the first one missed meets others.
SCANS = 2
HASHED_LEADERS = 5
#: Keys before its own that a row of a list knows in the full scan.
BEFORE = 8
#: Words of 64 bits in a set's sketch.
SKETCH = 16

SCHEMA = "doc_id long, n_shingles long, sig_a long, sig_b long, weight double, shared array<long>, firsts array<long>, sketch array<long>"


def need(n, percent: int = PERCENT):
    """Least overlap of a set of n elements with any partner: ceil(percent n / 100)."""
    return (percent * n + 99) // 100


def _sets(shingle: int):
    def grams(hashes, slots, lens):
        h, _ = blocks.shingle_sets(hashes, slots, lens, shingle)
        return [np.unique(h, return_counts=True)]

    return grams


def _array(values: np.ndarray, sizes: np.ndarray, held: np.ndarray) -> pa.Array:
    """list<long> rows of ``sizes`` values each; null where not ``held``."""
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.int64)), mask=pa.array(~held))


def profiles(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, block_bytes: int = blocks.BLOCK_BYTES) -> DataFrame:
    """A row for each row of ``docs``: size and signature of its set and, where a partner is possible,
    the shingles that also occur elsewhere (``shared``) and the rare-first ones (``firsts``: those among
    the first n - need + 1 that occur elsewhere, in order) and a ``sketch``: a bit for each shared shingle's
    hash. ``weight`` is the mean log document frequency."""
    _, n_words = common.corpus_size(docs)
    bits = blocks.range_bits(common.shuffle_partitions(docs.sparkSession), n_words)

    def place(ids, hashes, slots, lens, tables):
        h, of = blocks.shingle_sets(hashes, slots, lens, shingle)
        grams, totals = tables[0]
        df = totals[np.searchsorted(grams, h)]
        count = len(ids)
        n = np.bincount(of, minlength=count)
        total = lambda v: np.add.reduceat(np.append(v, v.dtype.type(0)), np.minimum(np.cumsum(n) - n, len(v))) * (n > 0).astype(v.dtype)
        weight = total(np.log(df.astype(np.float64))) / np.maximum(n, 1)
        common_ = df > 1
        shared = np.bincount(of[common_], minlength=count)
        # the rare-first order puts the lone shingles in front
        firsts = np.maximum(n - need(n, percent) + 1 - (n - shared), 0) * (n > 0)
        live = firsts > 0
        at = np.flatnonzero(common_ & live[of])
        order = at[np.lexsort((h[at], df[at], of[at]))]
        begin = np.searchsorted(of[order], np.arange(count))
        first = order[np.arange(len(order)) - begin[of[order]] < firsts[of[order]]]
        sketch = np.zeros((count, SKETCH), np.uint64)
        bit = blocks.mix(h[at]) % blocks.U64(64 * SKETCH)
        np.bitwise_or.at(sketch, (of[at], (bit >> blocks.U64(6)).astype(np.int64)), blocks.U64(1) << (bit & blocks.U64(63)))
        return pa.table(
            {
                "doc_id": pa.array(ids, pa.int64()), "n_shingles": pa.array(n, pa.int64()), "sig_a": pa.array(total(h).view(np.int64)),
                "sig_b": pa.array(total(blocks.mix(h * blocks.U64(0x9E3779B97F4A7C15) + blocks.U64(1))).view(np.int64)), "weight": pa.array(weight),
                "shared": _array(h[at], np.where(live, shared, 0), live), "firsts": _array(h[first], np.where(live, firsts, 0), live),
                "sketch": _array(sketch[live].ravel(), np.where(live, SKETCH, 0), live),
            }
        )

    return blocks.with_counts(docs, _sets(shingle), place, SCHEMA, bits, lower=True, block_bytes=block_bytes)


@cache
def subset_sizes(n: int, percent: int = PERCENT) -> tuple[tuple[int, int, int], ...]:
    """(lo, hi, c) for every size that a partner of a set of n can have: the smaller and the larger size,
    and the overlap from which two sets of these sizes link."""
    fits = (m for m in range(1, 100 * n // percent + 1) if percent * n <= 100 * m)
    sizes = ((min(n, m), max(n, m)) for m in fits)
    return tuple((lo, hi, -(-percent * (lo + hi) // (100 + percent))) for lo, hi in sizes)


def subset_count(n: int, shared: int, percent: int = PERCENT) -> int:
    return sum(comb(shared, c) for _, _, c in subset_sizes(n, percent))


def boundary(stats: list[tuple[int, int, int, int]], percent: int = PERCENT, most: int = MOST_SMALL) -> int:
    """The set size from which sets are large. ``stats``: (size, shared shingles, nodes, rows of their lists)
    for sizes up to ``most``; the table is small at any corpus size."""
    best = None
    for x in sorted({0, *(n + 1 for n, _, _, _ in stats if n <= most)}):
        cost = sum(nodes * subset_count(n, k, percent) for n, k, nodes, _ in stats if n < x)
        cost += sum(scan for n, _, _, scan in stats if 100 * n >= percent * x)
        best = min(best, (cost, x)) if best is not None else (cost, x)
    return best[1]


def _fits(n: Column, m: Column, percent: int) -> Column:
    return (100 * n >= percent * m) & (100 * m >= percent * n)


def _with_sides(pairs: DataFrame, sets: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``pairs`` with the columns of both sets, as name_a and name_b."""
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("node").alias(side), *(c.alias(f"{name}_{side}") for name, c in columns.items())), side)
    return pairs


def _near(a: str, b: str, percent: int) -> Column:
    """Whether the sketches of two sets, structs of n, k (number of shared shingles) and s, allow them to link:
    shared shingles of two sets differ at least as often as bits of their sketches do."""
    a, b = F.col(a), F.col(b)
    differ = F.aggregate(F.zip_with(a["s"], b["s"], lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    return (100 + percent) * (a["k"] + b["k"] - differ) >= 2 * percent * (a["n"] + b["n"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets link: overlap is counted on shared shingles only, sizes on whole sets. Sketches go
    first, so pairs whose overlap is too small even by them never move their sets."""
    near = _with_sides(pairs, sets, {"p": F.col("sketch")}).where(_near("p_a", "p_b", percent))
    both = F.size(F.array_intersect("shared_a", "shared_b"))
    whole = _with_sides(near.select("a", "b"), sets, {"n": F.col("n"), "shared": F.col("shared")})
    return whole.where(100 * both >= percent * (F.col("n_a") + F.col("n_b") - both)).select("a", "b")


def light_links(small: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): links between small sets (node, n, shared). Each key's members link with its smallest set;
    a key that no set of the smaller size has says nothing."""

    def enumerate_(batches):
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for node, n, shared in zip(*(batch.column(c).to_pylist() for c in ("node", "n", "shared")), strict=True):
                own = np.sort(np.array(shared, np.int64)).view(np.uint64)
                twin = blocks.mix(own)
                for lo, hi, c in subset_sizes(n, percent):
                    salt = blocks.U64(lo << 32 | hi)
                    for subset in combinations(range(len(own)), c):
                        at = list(subset)
                        rows[0].append(int(blocks.mix((own[at].sum(dtype=np.uint64) ^ salt).reshape(1)).view(np.int64)[0]))
                        rows[1].append(int((twin[at].sum(dtype=np.uint64) ^ salt).astype(np.int64)))
                        rows[2].append(lo)
                        rows[3].append(node)
                        rows[4].append(n)
                        if len(rows[0]) >= 100_000:
                            yield pa.record_batch([pa.array(r, pa.int64()) for r in rows], ["key", "twin", "lo", "node", "n"])
                            rows = [[], [], [], [], []]
            yield pa.record_batch([pa.array(r, pa.int64()) for r in rows], ["key", "twin", "lo", "node", "n"])

    keyed = small.select("node", "n", "shared").mapInArrow(enumerate_, "key long, twin long, lo long, node long, n long")
    first = keyed.groupBy("key", "twin").agg(F.min(F.struct("n", "node")).alias("first"), F.max(F.struct("n", "node")).alias("last"), F.min("lo").alias("lo"))
    first = first.where((F.col("first") < F.col("last")) & (F.col("first.n") == F.col("lo"))).select("key", "twin", F.col("first.node").alias("a"), split_key("key"))
    met = keyed.select("key", "twin", F.col("node").alias("b"), split_key("key")).join(first, ["key", "twin", "rf_split"])
    return met.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _spread(rows: DataFrame) -> DataFrame:
    """Only the rows of keys whose members are in more than one component, by a join that Spark can split."""
    split = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key", split_key("key"))
    return rows.select("*", split_key("key")).join(split, ["key", "rf_split"], "left_semi").drop("rf_split")


def _one_of_equal_lists(rows: DataFrame) -> DataFrame:
    """As ``_spread``, and of keys with the same members only the least one: the others would make the same
    pairs again. Members are compared by their number and two 64-bit digests."""
    digest = [F.bit_xor(F.xxhash64(F.lit(seed), "node", "n")).alias(name) for seed, name in enumerate(("da", "db"))]
    lists = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c"), *digest).where("lo < hi")
    chosen = lists.groupBy("c", "da", "db").agg(F.min("key").alias("key")).select("key", split_key("key"))
    return rows.select("*", split_key("key")).join(chosen, ["key", "rf_split"], "left_semi").drop("rf_split")


def leader_scan(members: DataFrame, percent: int, orders: list[Column]) -> DataFrame:
    """(a, b): at most one candidate for each member and order. For each order every list has one leader,
    the first member by it, which scans the list; a member takes the leader that it shares the most keys
    with, among those in another component that sizes allow to link. What this leaves is for the full scan."""
    first = [F.max(F.struct(o.alias("o"), F.col("node").alias("y"), F.col("n").alias("m"), F.col("comp").alias("comp_y"))) for o in orders]
    leader = members.groupBy("key").agg(F.array(*first).alias("leaders"))
    met = members.select("*", split_key("key")).join(leader.select("*", split_key("key")), ["key", "rf_split"])
    met = met.select(F.col("node").alias("x"), "n", "comp", F.posexplode("leaders").alias("which", "p")).select("x", "n", "comp", "which", "p.y", "p.m", "p.comp_y")
    met = met.where((F.col("comp") != F.col("comp_y")) & _fits(F.col("n"), F.col("m"), percent))
    best = met.groupBy("x", "which", "y").count().groupBy("x", "which").agg(F.max_by("y", F.struct("count", "y")).alias("y"))
    return best.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def full_scan(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): every pair from different components that meets on a list and whose sizes fit.

    A row knows up to BEFORE of the keys before its own among the keys of its node, by their values. Two
    members that have one of these in common have met there or earlier, so a pair hardly ever comes out
    twice; the first key of all that they share has no common one before it. Sizes are part of the join's
    key: a size class spans the ratio up to which sets can link, and a member asks in its own class and the
    one above. Rows carry the sketches of their sets, and the join itself leaves out pairs that these rule
    out, so what it puts out are pairs that link or nearly do.
    """
    kept = _one_of_equal_lists(members)
    own = kept.groupBy("node", "n", "comp").agg(F.sort_array(F.collect_list("key")).alias("keys")).join(sets.select("node", "sketch"), "node")
    known = F.slice("keys", F.greatest(F.col("at") - BEFORE, F.lit(0)) + 1, F.least("at", F.lit(BEFORE)))
    listed = own.select("node", "n", "comp", "sketch", F.posexplode("keys").alias("at", "key"), "keys").select("node", "n", "comp", "sketch", "key", known.alias("before"))
    listed = listed.withColumn("class", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(101.0 / percent))))
    other = listed.select("key", F.col("class").alias("asked"), F.col("node").alias("y"), F.col("n").alias("m"), F.col("comp").alias("comp_y"), F.col("before").alias("before_y"), F.col("sketch").alias("sketch_y"))
    asks = listed.withColumnRenamed("node", "x").withColumn("asked", F.explode(F.array("class", F.col("class") + 1)))
    once = (F.col("asked") > F.col("class")) | (F.col("x") < F.col("y"))
    met = asks.join(other, ["key", "asked"]).where(once & (F.col("comp") != F.col("comp_y")) & _fits(F.col("n"), F.col("m"), percent) & ~F.arrays_overlap("before", "before_y") & _near("sketch", "sketch_y", percent))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def links(nodes: DataFrame, percent: int = PERCENT, large: int | None = None, found: dict[str, DataFrame] | None = None) -> DataFrame:
    """(node, comp) of all nodes that link with another one. ``nodes``: node, n, weight, shared, firsts, sketch, only
    those with firsts. ``large`` sets the boundary instead of the cost; ``found`` receives the links by branch."""
    sets = nodes.select("node", "n", "shared", "sketch")
    listed = nodes.select("node", "n", "weight", F.col("node").alias("comp"), F.explode("firsts").alias("key"))
    if large is None:
        small = nodes.where(F.col("n") <= MOST_SMALL)
        stats = small.groupBy("n", F.size("shared").alias("k")).agg(F.count("*"), F.sum(F.size("firsts"))).collect()
        # each row of a list is read once for each leader and in the full scan
        large = boundary([(r[0], r[1], r[2], r[3] * (2 + HASHED_LEADERS)) for r in stats], percent)
    edges = linked = common.materialize(light_links(sets.where(F.col("n") < large), percent), "light")
    if found is not None:
        found["light"] = edges
    comps = nodes.select("node", F.col("node").alias("comp")).limit(0)
    members = common.materialize(_spread(listed.where(100 * F.col("n") >= percent * large)), "lists")
    for k in range(SCANS + 1):
        if not linked.isEmpty():
            comps = connected_components(edges)
            moved = members.drop("comp").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
            last, members = members, common.materialize(_spread(moved), "members")
            common.release(last)
        orders = [F.col("weight")] if k == 0 else [F.xxhash64(F.lit(k * HASHED_LEADERS + j), "node") for j in range(HASHED_LEADERS)]
        pairs = leader_scan(members, percent, orders) if k < SCANS else full_scan(members, sets, percent)
        linked = common.materialize(_verified(pairs, sets, percent), "links")
        if found is not None:
            found[f"leader {k + 1}" if k < SCANS else "full"] = linked
        edges = edges.unionByName(linked)
    common.release(members)
    return comps if linked.isEmpty() else connected_components(edges)


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text", block_bytes: int = blocks.BLOCK_BYTES, large: int | None = None, found: dict[str, DataFrame] | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of ``docs``.

    A-Z are lowered; words are runs of anything but ASCII white space. A document of fewer than five
    words is its whole sequence as one shingle; one without words or text has no shingle and links with
    nothing. component_id is the least doc_id reachable over links, itself included. Rows with equal ids
    are told apart by their texts and link through them; a null id keeps its row and links like any other,
    and the component of documents without any id is null. An empty table gives an empty result; other
    columns are ignored. A very long text is one set, held whole by one task. ``docs`` is read twice and
    must give the same rows in the same order (a written table); otherwise the job stops.
    """
    docs = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    known = common.materialize(profiles(docs, shingle, percent, block_bytes).withColumn("row", F.monotonically_increasing_id()), "profiles")
    sig = ["n_shingles", "sig_a", "sig_b"]
    classes = known.where("n_shingles > 0").groupBy(*sig).agg(F.min("row").alias("node"), F.min("doc_id").alias("least"))
    # every row of a class has equal sets: its first row stands for it
    nodes = known.where("firsts is not null").join(classes.select(F.col("node").alias("row")), "row", "left_semi")
    nodes = nodes.select(F.col("row").alias("node"), F.col("n_shingles").alias("n"), "weight", "shared", "firsts", F.struct(F.col("n_shingles").alias("n"), F.size("shared").alias("k"), F.col("sketch").alias("s")).alias("sketch"))
    comps = links(common.materialize(nodes, "nodes"), percent, large, found)
    least = classes.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    owner = least.groupBy("comp").agg(F.min("least").alias("component_id")).select("*", split_key("comp"))
    owner = least.select(*sig, "comp", split_key("comp")).join(owner, ["comp", "rf_split"]).select(*sig, "component_id")
    out = known.select("doc_id", *sig).join(owner, sig, "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, one for each component: that of the least doc_id (null ids last;
    of equal ids the text with the least hash). A document without a word is a component of its own, and
    rows of equal id and text are one document and stay once. An empty table gives an empty result."""
    name, got = fresh(docs.columns, "rf_place", "rf_chosen")
    place = F.xxhash64(docs[doc_id].cast("long"), docs[text])
    found = jaccard_components(docs.select(place.alias("doc_id"), docs[text].alias("text")), **options)
    found = found.groupBy("doc_id").agg(F.min("component_id").alias("component")).withColumnRenamed("doc_id", "place")
    ids = docs.select(place.alias("place"), docs[doc_id].cast("long").alias("id")).distinct()
    rank = F.struct(F.col("id").isNull(), "id", "place")
    chosen = ids.join(found, "place").groupBy("component").agg(F.min(rank)["place"].alias(got)).select(got)
    keyed = docs.select("*", place.alias(name))
    return keyed.join(chosen, F.col(name) == F.col(got), "left_semi").dropDuplicates([name]).drop(name)

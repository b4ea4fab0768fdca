"""Merkle manifest of a dataset: a tree for each group of rows, and a tree over the roots of the groups.

All levels are DataFrames: nodes have the position they have in their group, a parent is the run of ``fanout``
consecutive nodes that share position // fanout, and its digest is that of their digests. Proofs come down the same
levels: what a node needs is its siblings, followed by what its parent needs. So the rows joined shrink by
``fanout`` from level to level, up and down, and the rows of the dataset themselves are joined once.

Digests are SHA-256. Within the tables they are 32 bytes, and they are hashed and shown as lowercase hex text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, ranks

FANOUT = 3
WIDTH = 32
PATH = "array<struct<left:binary,right:binary>>"


def shown(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _hash(digests: Column) -> Column:
    """Digest of the hex text of concatenated digests."""
    return F.unhex(F.sha2(shown(digests), 256))


def leaf_hash(*values: Column) -> Column:
    """Digest of a row: each value as ``-`` if null, else UTF-8 bytes, ``:``, value. Numbers are decimal."""
    shown_values = [v.cast("string") for v in values]
    return F.unhex(F.sha2(F.concat(*(F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in shown_values)), 256))


def _joined(kids: Column) -> Column:
    return F.aggregate(kids, F.expr("X''"), lambda all_, kid: F.concat(all_, kid["h"]))


def _parents(nodes: DataFrame, fanout: int) -> DataFrame:
    """(g, i, n, h, kids) of the level above: groups of at most ``fanout`` rows each."""
    kid = F.struct(*(c for c in nodes.columns if c in ("i", "h", "load")))
    up = nodes.where("n > 1").groupBy("g", F.expr(f"i div {fanout}").alias("i")).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(kid)).alias("kids"))
    return up.select("g", "i", F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"), _hash(_joined(F.col("kids"))).alias("h"), "kids")


def _up(leaves: DataFrame, fanout: int) -> list[DataFrame]:
    """All levels, the leaves first. How many there are follows from the largest group: one number."""
    levels, largest = [leaves], leaves.agg(F.max("n")).first()[0] or 0
    while largest > 1:
        levels.append(common.materialize(_parents(levels[-1], fanout), "level"))
        largest = -(-largest // fanout)
    return levels


def _tops(levels: list[DataFrame]) -> DataFrame:
    """(g, depth, h): of each group the last node, with the level it is on."""
    found = None
    for depth, level in enumerate(levels):
        one = level.where("n = 1").select("g", F.lit(depth).alias("depth"), "h")
        found = one if found is None else found.unionByName(one)
    return found


def _down(levels: list[DataFrame], seeds: DataFrame) -> DataFrame:
    """(h, load, path, subroot, root) of every leaf. ``seeds`` has (g, depth, path, subroot, root) of each
    group's last node."""
    above = None
    for depth in range(len(levels) - 1, 0, -1):
        here = seeds.where(F.col("depth") == depth).select("g", F.lit(0).cast("long").alias("i"), "path", "subroot", "root")
        here = here if above is None else here.unionByName(above)
        known = levels[depth].select("g", "i", "kids", _joined(F.col("kids")).alias("all")).join(here, ["g", "i"])
        side = lambda p: F.struct(F.col("all").substr(F.lit(1), p * WIDTH).alias("left"), F.col("all").substr((p + 1) * WIDTH + 1, F.length("all")).alias("right"))
        kids = known.select("g", "path", "subroot", "root", F.explode(F.transform("kids", lambda kid, p: F.struct(kid.alias("kid"), side(p).alias("side")))).alias("x"))
        kids = kids.select("g", "x.kid.*", F.concat(F.array("x.side"), F.col("path")).cast(PATH).alias("path"), "subroot", "root")
        above = kids if depth == 1 else kids.drop("h")
    lone = levels[0].where("n = 1").join(seeds.where("depth = 0"), "g").select("h", "load", "path", "subroot", "root")
    return lone if above is None else above.select(*lone.columns).unionByName(lone)


def manifest(rows: DataFrame, group: str, order: Sequence[str], leaf: str = "leaf", fanout: int = FANOUT) -> DataFrame:
    """``rows`` with their place in the manifest: rf_subroot, rf_root and rf_path, the siblings to the left and
    right of the row and of each of its parents, up to the root.

    ``leaf`` holds the row's digest (``leaf_hash``). Rows of a group ascend by ``order`` (nulls first), then by
    digest; rows equal in both are the same leaf and may change places. Groups ascend by their UTF-8
    bytes; a null group is the first one, an empty string the next. A group of one row has its leaf as
    subroot, and where there is one group its subroot is the root. No row is lost or repeated; an empty table gives
    an empty manifest. Text never moves here: only ``rows``' own columns, so give it few.
    """
    # a group must not be null as a join key, and null comes first
    key = F.when(F.col(group).isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(group).cast("string")))
    load = F.struct(*(F.col(c) for c in rows.columns if c != leaf))
    shaped = rows.select(key.alias("g"), *(F.col(c).alias(f"o{k}") for k, c in enumerate(order)), F.col(leaf).alias("h"), load.alias("load"))
    nodes = ranks.numbered(shaped, "g", [*(f"o{k}" for k in range(len(order))), "h"]).select("g", F.col("rf_i").alias("i"), F.col("rf_n").alias("n"), "h", "load")
    levels = _up(nodes, fanout)
    groups = ranks.numbered(_tops(levels).select(F.lit("").alias("all"), "g", "depth", "h"), "all", ["g"])
    groups = groups.select(F.col("all").alias("g"), F.col("rf_i").alias("i"), F.col("rf_n").alias("n"), "h", F.struct("g", "depth").alias("load"))
    over = _up(groups, fanout)
    roots = _tops(over).select("g", "depth", F.array().cast(PATH).alias("path"), F.col("h").alias("subroot"), F.col("h").alias("root"))
    seeds = common.materialize(_down(over, roots).select("load.g", "load.depth", "path", F.col("h").alias("subroot"), "root"), "subroots")
    out = _down(levels, seeds)
    kept = [F.col("h").alias(c) if c == leaf else F.col("load")[c].alias(c) for c in rows.columns]
    return out.select(*kept, F.col("subroot").alias("rf_subroot"), F.col("root").alias("rf_root"), F.col("path").alias("rf_path"))


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and the siblings on its way up."""
    return F.aggregate(path, leaf, lambda node, side: _hash(F.concat(side["left"], node, side["right"])))


def proof_hash(path: Column) -> Column:
    """Digest (hex) of the siblings on the way up, each level from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda side: shown(F.concat(side["left"], side["right"]))), ""), 256)


def digest(docs: DataFrame) -> DataFrame:
    """The manifest of ``documents`` with a tampering test, a row for each document.

    Where crc32 of the id is even, the text loses its line feeds and the changed leaf is folded with the
    siblings of the true one: it must not verify, unless there was no line feed. A null id is not tampered with.
    """
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    odd = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & (F.instr("text", "\n") > 0)
    rows = docs.select("doc_id", "source", leaf_hash(*fields, F.col("text")).alias("leaf"), F.when(odd, leaf_hash(*fields, F.translate("text", "\n", ""))).alias("tampered"))
    made = manifest(rows, "source", ["doc_id"]).withColumn("folded", fold(F.coalesce("tampered", "leaf"), F.col("rf_path")))
    return made.select(
        "doc_id", shown(F.col("leaf")).alias("leaf"), shown(F.col("rf_subroot")).alias("subroot"), shown(F.col("rf_root")).alias("root"), proof_hash(F.col("rf_path")).alias("proof_sha256"),
        shown(F.col("folded")).alias("folded_root"), (F.col("folded") == F.col("rf_root")).alias("verified"),
    )

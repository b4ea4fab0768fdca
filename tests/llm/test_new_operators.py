"""Manifest, resampling and embedding near-duplicates against brute force, with odd inputs."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from regimeforge.llm import common, merkle, neardup, ranks, resample

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rf_i int, g string, h int, path int"


def frame(spark, rows):
    """rows: (doc_id, text, source); further columns have names that the operators use themselves."""
    return spark.createDataFrame([(i, t, None if i == 3 else "en", s, None if t is None else len(t), 7, "x", 1, 2) for i, t, s in rows], SCHEMA)


ODD = [
    (5, "a\nb", "s1"), (3, None, "s1"), (3, "twice", "s1"), (3, "twice", "s1"), (None, "lost\nid", "s1"), (None, None, None), (8, "", None), (9, "x\n" * 200_000, ""), (10, "é\U0001f600\n", ""), (4, "one\n", "alone"), (6, "t", "s0"), (7, "t", "s0"), (11, "\n", "s0"), (12, "u", "s0"),
]


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def tree(leaves: list[str]):
    """(root, siblings of each leaf as (left, right) texts)."""
    ways, spans = [[] for _ in leaves], [[k] for k in range(len(leaves))]
    while len(leaves) > 1:
        for at in range(0, len(leaves), 3):
            run = leaves[at : at + 3]
            for k in range(len(run)):
                for leaf in spans[at + k]:
                    ways[leaf].append(("".join(run[:k]), "".join(run[k + 1 :])))
        spans = [sum(spans[at : at + 3], []) for at in range(0, len(leaves), 3)]
        leaves = [sha("".join(leaves[at : at + 3])) for at in range(0, len(leaves), 3)]
    return leaves[0], ways


def brute_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: sha("".join(map(field, (r["doc_id"], r["source"], r["lang"], r["n_chars"], t))))
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        trees[s] = tree([leaf(r, r["text"]) for r in groups[s]])
    root, over = tree([trees[s][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for j, r in enumerate(groups[s]):
            way = trees[s][1][j] + over[k]
            node = leaf(r, r["text"])
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and r["text"] is not None:
                node = leaf(r, r["text"].replace("\n", ""))
            for left, right in way:
                node = sha(left + node + right)
            out.append((r["doc_id"], leaf(r, r["text"]), trees[s][0], root, sha("".join(a + b for a, b in way)), node, node == root))
    return out


@pytest.mark.parametrize("rows", [[], ODD, [(k * 7 % 101, f"t\n{k}", random.Random(k).choice(["a", "b", "b", "b", None, "é"])) for k in range(140)]], ids=["empty", "odd", "many"])
def test_manifest_equals_brute_force(spark, rows):
    docs = frame(spark, rows)
    got = [tuple(r) for r in merkle.digest(docs).collect()]
    expected = brute_manifest([r.asDict() for r in docs.collect()]) if rows else []
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(expected, key=key)


def test_manifest_keeps_columns_and_other_fanouts(spark):
    rows = frame(spark, ODD).select("doc_id", "source", "g", "h", "path").withColumn("leaf", merkle.leaf_hash(F.col("doc_id")))
    made = merkle.manifest(rows, "source", ["doc_id"], fanout=2)
    assert made.columns == [*rows.columns, "rf_subroot", "rf_root", "rf_path"] and made.count() == len(ODD)
    assert made.where(merkle.fold(made["leaf"], made["rf_path"]) != made["rf_root"]).count() == 0


def test_numbered_rows_of_equal_keys_and_groups(spark):
    df = spark.createDataFrame([("a", 1)] * 300 + [("b", k % 5) for k in range(50)], "g string, v int")
    got = ranks.numbered(df, "g", ["v"]).collect()
    for g, n in (("a", 300), ("b", 50)):
        own = sorted((r.rf_i, r.v) for r in got if r.g == g)
        assert [i for i, _ in own] == list(range(n)) and [v for _, v in own] == sorted(v for _, v in own)
        assert {r.rf_n for r in got if r.g == g} == {n}


def brute_importance(docs, target, sizes, buckets=10_000):
    def features(text):
        ws = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(ws), [" ".join(ws[k : k + n]) for n in range(sizes[0], sizes[1] + 1) for k in range(len(ws) - n + 1)]

    at = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = np.zeros(buckets), np.zeros(buckets)
    for text in docs:
        for f in features(text[1])[1]:
            s[at(f)] += 1
    for text in target:
        for f in features(text)[1]:
            t[at(f)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + buckets) / ((s[b] + 1) * (t.sum() + buckets)))) for b in range(buckets)]
    out = []
    for i, text in docs:
        n, fs = features(text)
        weight = sum(gain[at(f)] for f in fs)
        score = None
        if i is not None:
            h = int(sha(f"2024:{i}")[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, n, len(fs), weight, score, None])
    pool = sorted((r for r in out if r[1] >= 20 and r[4] is not None), key=lambda r: (-r[4], r[0], r[2]))
    for k, r in enumerate(pool[: 10 * len(pool) // 100]):
        r[5] = k + 1
    return out


@pytest.mark.parametrize("sizes", [(1, 1), (1, 2), (2, 3)])
def test_importance_equals_brute_force(spark, sizes):
    draw = random.Random(4)
    vocabulary = ["Stadt", "ÉCOLE", "x1", "don't", "über-all", "日本", "W", "ab_c", "q\x7fz"]
    docs = [(k, " ".join(draw.choices(vocabulary, k=draw.randrange(60)))) for k in range(150)]
    docs += [(None, "a b " * 30), (3, "b " * 40), (3, "b " * 40), (200, None), (201, ""), (202, "w " * 200_000)]
    target = ["Stadt x1 x1", None, "", "日本 W W"]
    d = frame(spark, [(i, t, "s") for i, t in docs])
    b = spark.createDataFrame([(k, t, 0) for k, t in enumerate(target)], "item_id long, text string, weight int")
    got = [list(r) for r in resample.importance(d, b, sizes=sizes).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(brute_importance(docs, target, sizes), key=key)
    if sizes == (1, 1):
        drawn = resample.resample(d, b)
        assert drawn.columns == d.columns and {r.doc_id for r in drawn.collect()} == {r[0] for r in got if r[5] is not None}


def test_importance_of_empty_tables(spark):
    d = frame(spark, [(1, "a b c", "s")])
    assert resample.importance(d.limit(0), d).collect() == []
    assert [r.weight for r in resample.importance(d, d.limit(0)).collect()] != []


def brute_links(rows, threshold=0.95):
    def usable(v):
        return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)

    dim = max([len(v) for _, v in rows if v is not None] + [1])
    unit = [np.pad(np.array(v, float), (0, dim - len(v))) if usable(v) else None for _, v in rows]
    unit = [None if u is None else (u / np.abs(u).max()) / np.linalg.norm(u / np.abs(u).max()) for u in unit]
    link = [[j for j, w in enumerate(unit) if j != k and u is not None and w is not None and u @ w >= threshold] for k, u in enumerate(unit)]
    out = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for j in link[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        comp = min(ids) if ids else None
        out.append((i, len(link[k]), comp, comp == i))
    return out


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], f"vec_id long, embedding array<{kind}>, t int, key int")


def around(draw, centre, cosine):
    g = draw.standard_normal(len(centre))
    g -= (g @ centre) * centre
    return cosine * centre + math.sqrt(1 - cosine**2) * g / np.linalg.norm(g)


@pytest.mark.parametrize("block", [2000, 40])
def test_links_equal_brute_force(spark, block):
    """Groups and chains of links well above the threshold are found whole, in one tile and in many."""
    draw = np.random.default_rng(5)
    rows = []
    for size in (1, 2, 3, 30, 150):
        centre = draw.standard_normal(16)
        centre /= np.linalg.norm(centre)
        rows += [around(draw, centre, 0.992) for _ in range(size)]
    step = rows[0]
    for _ in range(12):  # a chain: each one near the last, the ends far apart
        step = around(draw, step, 0.985)
        rows.append(step)
    rows += [rows[5]] * 70 + [2 * np.array(rows[6])] * 3 + list(draw.standard_normal((100, 16)))
    rows = [(int(k * 37 % len(rows)), [float(np.float32(x)) for x in v]) for k, v in enumerate(rows)]
    got = [tuple(r) for r in neardup.near_duplicates(vectors(spark, rows), block=block).collect()]
    assert sorted(got) == sorted(brute_links(rows))


def test_odd_vectors(spark):
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [1.0, None, 2.0]), (5, [1.0, float("nan"), 2.0]), (6, [float("inf"), 1.0, 1.0]), (7, [1e200, 1e200, 0.0]), (8, [1e-200, 1e-200, -0.0]), (9, [1.0, 1.0]),
        (None, [1.0, 1.0, 0.0]), (None, [0.0, 0.0, 5.0]), (10, [-1.0, -1.0, 0.0]), (11, [3.0, 0.0, 0.0]), (11, [3.0, 0.0, 0.1]), (11, [0.0, 9.0, 0.0]), (12, [0.0, 9.0, 0.0]),
    ]
    got = [tuple(r) for r in neardup.near_duplicates(vectors(spark, rows, "double")).collect()]
    assert sorted(got, key=str) == sorted(brute_links(rows), key=str)
    assert neardup.near_duplicates(vectors(spark, [])).collect() == []
    assert sorted(tuple(r) for r in neardup.near_duplicates(vectors(spark, [(1, [2.0]), (2, [-1.0])])).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_recall_at_the_threshold(spark):
    """Pairs exactly above the threshold, one by one, in the company of unlike vectors."""
    draw = np.random.default_rng(6)
    rows = []
    for _ in range(1500):
        u = draw.standard_normal(64)
        u /= np.linalg.norm(u)
        rows += [u.tolist(), around(draw, u, 0.9505).tolist()]
    got = neardup.near_duplicates(vectors(spark, list(enumerate(rows)), "double"))
    assert got.where("n_links > 0").count() / len(rows) >= 0.98


def test_hashes_turn_and_meet():
    x = np.random.default_rng(1).standard_normal((50, 64))
    assert np.allclose(np.linalg.norm(neardup.hadamard(x), axis=1), np.linalg.norm(x, axis=1)) and np.allclose(neardup.hadamard(neardup.hadamard(x)), x)
    turns = neardup.signs(2, 3, 64)
    one = neardup.buckets(x, turns, 1)[:, :, 0]
    assert (neardup.buckets(x, turns)[:, :, 0] == one).all()
    best = []
    for t in range(2):
        code = np.zeros(50, int)
        for k in range(3):
            y = x
            for s in turns[t, k]:
                y = neardup.hadamard(y * s)
            axis = np.abs(y).argmax(axis=1)
            code = code * 128 + axis + 64 * (y[np.arange(50), axis] < 0)
        best.append(code)
    assert (one == np.stack(best, axis=1)).all()


def test_written_tables_can_be_released(spark, tmp_path):
    df = common.materialize(spark.range(5).toDF("x"), "some")
    assert df.count() == 5
    common.release_all(spark)
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(df._rf_path).count()

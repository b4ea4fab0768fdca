"""Corpus operators against SQL, brute force, round trips and held-out rows, with odd inputs."""

import hashlib
import itertools
import math
import random
import re
import struct
import sys
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import connect, rows  # noqa: E402
from test_scale import measured  # noqa: E402

from regimeforge.llm import blocks, bpe, common, components, decontaminate, jaccard, line_dedup, lm, quality, registry, rules, sentence_dedup, toxicity, urls  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rf_note string, g int"


def frame(spark, texts, start=0):
    return spark.createDataFrame([(start + k if not isinstance(t, tuple) else t[0], t if not isinstance(t, tuple) else t[1], "en", "s", 0, "x", 1) for k, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, name):
    assert rows(registry.queries()[name](spark, SF).toPandas()) == rows(connect(SF).execute(registry.oracle_sql()[name]).fetchdf())


ODD = [None, "", " \n\t ", "one", "a b c d e", "a b c d e", (7, "a b c d e"), (7, "other words here now ok"), (None, "lost row"), (None, None), "x" * 50_000, "퟿　 é b \U0001f600"]


@pytest.mark.parametrize("texts", [[], ODD], ids=["empty", "odd"])
def test_odd_rows_keep_their_number(spark, texts):
    d = frame(spark, texts)
    ranks, pattern = registry.vocabulary()
    for made in (bpe.digests(d, ranks, pattern), rules.judge(d), line_dedup.dedup_lines(d), sentence_dedup.dedup_sentences(d), lm.stupid_backoff(d), jaccard.jaccard_components(d)):
        assert made.count() == len(texts)
    bench = spark.createDataFrame([(1, None), (2, ""), (None, "a b c d e f g h")], "item_id long, text string")
    assert decontaminate.decontaminate(d, bench).columns == d.columns
    assert decontaminate.digest(d, bench.limit(0)).count() == 0
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for module in (quality, toxicity):
        got = module.score(d, module.fit(d, empty)).collect()
        assert len(got) == len(texts) and all(0 <= r.score <= 1 for r in got)


def test_bpe_equals_the_library(spark, docs):
    import tiktoken

    ranks, pattern = registry.vocabulary()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in docs.collect()} | {10_000 + k: t for k, t in enumerate(["  lead", "tail  ", "a\n\nb", "don't  stop\t\tnow", "x  y", "\n", "a \n b", "1234 5678", "<|endoftext|>", "é" * 300])}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in bpe.digests(d, ranks, pattern).collect():
        ids = enc.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_decoding_replaces_a_column_of_its_name(spark):
    ranks, pattern = registry.vocabulary()
    made = bpe.encode(frame(spark, ["some text", None, "\U0001f600"]), ranks, pattern)
    for encoded in (made, made.withColumn("decoded", F.lit(7))):
        got = bpe.decode(encoded, ranks)
        assert got.columns == ["doc_id", "n_tokens", "ids", "decoded"]
        assert {r.doc_id: bytes(r.decoded) for r in got.collect()} == {0: b"some text", 1: b"", 2: "\U0001f600".encode()}
    both = bpe.encode(frame(spark, ["some text", None, "\U0001f600"]), ranks, pattern, decoded=True)
    assert {r.doc_id: bytes(r.decoded) for r in both.collect()} == {0: b"some text", 1: b"", 2: "\U0001f600".encode()}


def test_rules_equal_brute_force(spark, docs):
    for r in rules.judge(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        t = r.text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen = {}
        for k in range(len(words) - 4):
            seen.setdefault(tuple(words[k : k + 5]), []).append(k)
        hit = {x for ks in seen.values() if len(ks) > 1 for k in ks for x in range(k, k + 5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit))
        assert r.base_failed == (len(words) < 10 or 100 * len(hit) > 20 * len(words)) and not (r.kept and r.base_failed)


def test_rules_weigh_votes_as_an_em_over_documents(spark, docs):
    """The posterior of each document, from an expectation-maximisation that walks documents one by one."""
    got = {r.doc_id: r for r in rules.judge(docs).collect()}
    votes = {r.doc_id: r.v for r in rules.counts(docs).select("doc_id", F.array(*(v.cast("int") for v in rules.rules().values())).alias("v")).collect()}
    size, n = len(next(iter(votes.values()))), len(votes)
    shares = [[[rules.BELIEF * n * s for s in side] for side in (rules.BAD, rules.GOOD)] for _ in range(size)]
    p, prior, good = [[[x / sum(c) for x in c] for c in rule] for rule in shares], 0.5, {}
    for _ in range(rules.EM_STEPS):
        new = {}
        for d, v in votes.items():
            like = [math.log(w) + sum(math.log(p[k][y][x + 1]) for k, x in enumerate(v)) for y, w in ((0, 1 - prior), (1, prior))]
            new[d] = 1 / (1 + math.exp(min(500, like[0] - like[1])))
        if good and max(abs(new[d] - good[d]) for d in new) < 1e-9:
            break
        good, prior = new, (sum(new.values()) + 1) / (n + 2)
        mass = [[list(c) for c in rule] for rule in shares]
        for d, v in votes.items():
            for k, x in enumerate(v):
                mass[k][0][x + 1] += 1 - good[d]
                mass[k][1][x + 1] += good[d]
        p = [[[x / sum(c) for x in c] for c in rule] for rule in mass]
    for d, r in got.items():
        assert abs(r.quality - good[d]) < 1e-6 and (abs(r.quality - rules.KEEP) < 1e-6 or r.kept == (not r.base_failed and good[d] >= rules.KEEP))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_rules_reject_what_is_labelled_bad(spark, sf):
    judged = rules.judge(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")).join(spark.read.parquet(f"/root/testdata/{sf}/labels.parquet").select("doc_id", F.col("quality").alias("label")), "doc_id").toPandas()
    passed = judged[~judged.base_failed]
    assert (passed[passed.label == 0].kept.mean() if (passed.label == 0).any() else 0) < 0.1 and passed[passed.label == 1].kept.mean() > 0.98


def greedy(doc, item, least):
    """Greedy string tiling by looking at all pairs of positions; tokens covered."""
    free_d, free_i, covered = [True] * len(doc), [True] * len(item), 0
    while True:
        best = (0, 0, 0)
        for q in range(len(item)):
            for p in range(len(doc)):
                k = 0
                while q + k < len(item) and p + k < len(doc) and item[q + k] == doc[p + k] and free_i[q + k] and free_d[p + k]:
                    k += 1
                best = max(best, (k, -q, -p))
        if best[0] < least:
            return covered
        k, q, p = best[0], -best[1], -best[2]
        covered += k
        for x in range(k):
            free_d[p + x] = free_i[q + x] = False


def test_tiling_equals_brute_force(spark):
    rnd = random.Random(3)
    words = [f"w{k}" for k in range(40)]
    items = [[rnd.choice(words) for _ in range(n)] for n in (5, 12, 30, 24)] + [["rep"] * 14]
    texts = []
    for item in items:
        texts += [item, item[len(item) // 2 :] + ["pad"] + item[: len(item) // 2], item[:4], ["x"] * 3 + item[2:9] + ["y"] + item[-6:] + item[-6:], ["rep"] * 9]
    d = spark.createDataFrame([(k, " ".join(t).title()) for k, t in enumerate(texts)], "doc_id long, text string")
    b = spark.createDataFrame([(k, ", ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    got = {(r.rf_doc, r.item_id): r.covered for r in decontaminate.matches(d, b).collect() if r.covered}
    expected = {(p, q): c for p, t in enumerate(texts) for q, i in enumerate(items) if (c := greedy(t, i, 5))}
    assert got == expected
    assert {r.doc_id for r in decontaminate.decontaminate(d, b).collect()}.isdisjoint({0, 5, 6, 10, 11})


def test_sentence_spans_equal_brute_force(spark, docs):
    seen, expected = {}, {}
    for r in docs.orderBy("doc_id").collect():
        own = sentence_dedup.sentences(r.text or "")
        text = [r.text[a:b].strip() for a, b, _ in own]
        gone = set()
        for i in range(len(text)):
            j, n = i, 0
            while j < len(text) and (n < sentence_dedup.WORDS or j - i < sentence_dedup.SENTENCES):
                n += len(text[j].split())
                j += 1
            if n < sentence_dedup.WORDS or j - i < sentence_dedup.SENTENCES:
                continue
            if tuple(text[i:j]) in seen:
                gone |= set(range(i, j))
            seen.setdefault(tuple(text[i:j]), r.doc_id)
        if gone:
            expected[r.doc_id] = (len(text), len(gone))
    got = sentence_dedup.digest(docs, both=False)
    assert got.count() == docs.count()
    assert {r.doc_id: (r.sentences_total, r.sentences_removed) for r in got.where("sentences_removed > 0").collect()} == expected


def repeated(texts):
    """The sentences of each text in any run of enough of them that stands at an earlier place."""
    seen = set()
    for own in texts:
        held = np.concatenate([[0], np.cumsum([len(s.split()) for s in own])])
        gone = set()
        for i in range(len(own)):
            for j in range(i + sentence_dedup.SENTENCES, len(own) + 1):
                if held[j] - held[i] >= sentence_dedup.WORDS:
                    h = hash(tuple(own[i:j]))
                    gone |= set(range(i, j)) if h in seen else set()
                    seen.add(h)
        yield gone


def test_sentences_of_every_run_equal_brute_force(spark):
    """Every run of enough sentences and words, not the shortest alone."""
    rnd = random.Random(5)
    pool = [" ".join(f"w{rnd.randrange(90)}" for _ in range(n)).capitalize() + "." for n in (1, 2, 3, 5, 8, 9, 12, 18, 25, 40) for _ in range(3)]
    texts = []
    for _ in range(60):
        own = [rnd.choice(pool) for _ in range(rnd.randrange(12))]
        for _ in range(rnd.randrange(3) if texts else 0):
            other = rnd.choice(texts)
            a = rnd.randrange(len(other) + 1)
            own += other[a : a + rnd.randrange(2, 9)] + [f"Own {rnd.random()} words."]
        texts.append(own)
    expected = {d: (" ".join(s for k, s in enumerate(own) if k not in gone), len(gone)) for d, (own, gone) in enumerate(zip(texts, repeated(texts), strict=True))}
    got = sentence_dedup.dedup_sentences(frame(spark, [" ".join(t) for t in texts])).collect()
    assert {r.doc_id: (r.text.strip(), r.sentences_removed) for r in got} == expected


def test_sentence_query_removes_every_run(spark, docs):
    short = {r.doc_id: r.text for r in docs.where("length(text) < 20000").orderBy("doc_id").collect()}
    texts = [[t[a:b].strip() for a, b, _ in sentence_dedup.sentences(t)] for t in short.values()]
    expected = {d: len(gone) for d, gone in zip(short, repeated(texts), strict=True) if gone}
    got = {r.doc_id: r.sentences_removed for r in registry.queries()["op6_sentence_dedup"](spark, SF).collect()}
    assert {d: got.get(d) for d in expected} == expected


def test_first_place_of_a_passage_stays(spark):
    p = "One two three four five six seven. Eight nine ten eleven twelve thirteen. Fourteen fifteen sixteen seventeen eighteen nineteen twenty one."
    got = sorted(sentence_dedup.dedup_sentences(frame(spark, [f"Start here now. {p} End.", f"Other. {p} Rest stays."])).collect(), key=lambda r: r.doc_id)
    assert got[0].sentences_removed == 0 and got[1].text == "Other. Rest stays." and got[1].first_docs == [0]


def test_sentence_query_texts_and_first_places(spark):
    """Texts and first documents of the query's rows, from every run of sentences that stands at an earlier place."""
    p, q = ("A%d one two three four five six. B%d seven eight nine ten eleven. C%d twelve thirteen fourteen fifteen sixteen seventeen." % ((k,) * 3) for k in (1, 2))
    texts = [f"{p} Own end.", f"{q} Other end.", f"{p} {q} Third end.", "Nothing here.", None]
    got = {r.doc_id: r for r in sentence_dedup.digest(frame(spark, texts)).collect()}
    left = {0: texts[0], 1: texts[1], 2: "Third end.", 3: texts[3]}
    assert {k: r.text_sha256 for k, r in got.items()} == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in left.items()} | {4: None}
    assert got[2].first_docs == [0, 1] and all(got[k].first_docs is None and got[k].sentences_removed == 0 for k in (0, 1, 3, 4))


def components_of(texts):
    """Least index reachable over links, by comparing all pairs of shingle sets."""
    sets = []
    for t in texts:
        w = [x.lower() for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(sets)))

    def find(k):
        return k if root[k] == k else find(root[k])

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {k: find(k) for k in range(len(sets))}


@pytest.mark.parametrize("large", [0, 7, 12, None, 100])
def test_jaccard_on_either_side_of_the_boundary(spark, large):
    """Families of near copies, by subsets, by lists, and by both; which branch finds the links follows the boundary."""
    rnd, texts = random.Random(4), []
    for f in range(12):
        base = [f"f{f}w{k}" for k in range(rnd.choice([3, 5, 6, 8, 10, 12, 14, 20, 40]))]
        for _ in range(8):
            t = list(base)
            for _ in range(rnd.randrange(3)):
                k, r = rnd.randrange(len(t)), rnd.random()
                if r < 0.4:
                    t[k] = f"x{rnd.random()}"
                elif r < 0.7:
                    t.insert(k if r < 0.6 else len(t), f"y{rnd.randrange(3)}")
                elif len(t) > 1:
                    t.pop()
            texts.append(" ".join(t))
    found = {}
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(frame(spark, texts), large=large, found=found).collect()}
    assert got == components_of(texts)
    counts = {k: v.count() for k, v in found.items()}
    assert (counts["light"] == 0) == (large == 0) and (sum(counts.values()) == counts["light"]) == (large == 100)


def test_jaccard_null_and_repeated_ids(spark):
    a, b = [f"a{k}" for k in range(60)], [f"b{k}" for k in range(60)]
    near = lambda t: " ".join([*t[:-1], "zz"])
    rows = [(7, " ".join(a)), (7, " ".join(b)), (3, near(a)), (9, near(b)), (None, near(b) + " yy"), (None, "alone in the world here")]
    got = [(r.doc_id, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(7, 3), (7, 7), (3, 3), (9, 7), (None, 7), (None, None)], key=str)


def test_one_row_of_each_group_stays(spark):
    base = " ".join(f"t{k}" for k in range(60))
    texts = [(5, base), (5, base), (4, base + " more"), (None, base), (None, None), (None, None), (8, "other words of its own"), (6, None)]
    d = frame(spark, texts).withColumn("rf_place", F.lit("mine")).withColumn("rf_chosen", F.lit(1))
    kept = jaccard.keep_one(d)
    assert kept.columns == d.columns and {r.rf_place for r in kept.collect()} == {"mine"}
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(4, base + " more"), (None, None), (8, "other words of its own"), (6, None)], key=str)


def test_columns_of_any_name_are_kept(spark):
    lines = "\n".join(f"line number {k} with some words" for k in range(5))
    own = {c: F.lit(f"own {c}") for c in ("rf_doc", "rf_text", "rf_starts", "rf_spans", "rf_first", "rf_lines", "rf_full", "rf_gone", "i", "j", "gram", "comp")}
    d = frame(spark, [lines, lines + "\nmore", "short text"]).withColumns(own)
    bench = spark.createDataFrame([(1, "line number 4 with some words")], "item_id long, text string")
    model = quality.Model(b"", b"", [1.0] + [0.0] * 8)
    for made in (line_dedup.dedup_lines(d), sentence_dedup.dedup_sentences(d), decontaminate.decontaminate(d, bench), jaccard.keep_one(d), quality.accepted(d, model)):
        assert made.columns[: len(d.columns)] == d.columns
        assert all(r[c] == f"own {c}" for r in made.collect() for c in own)


def test_items_under_a_seed_are_found_whole(spark):
    d = frame(spark, ["the alpha beta stands here", "alpha and beta apart", "ALPHA, beta!", None])
    bench = spark.createDataFrame([(1, "Alpha beta"), (2, "gamma"), (3, "")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.covered) for r in decontaminate.digest(d, bench).collect()) == [(0, 1, 2), (2, 1, 2)]


def test_tiling_of_repeated_tokens_is_fast_and_greedy():
    def tiles(doc, item, seed=5):
        h = lambda t, k: hash(tuple(t[k : k + seed]))
        own = [h(item, k) for k in range(len(item) - seed + 1)]
        places = [(p, h(doc, p)) for p in range(len(doc) - seed + 1) if h(doc, p) in set(own)]
        return decontaminate.Tiles([p for p, _ in places], [x for _, x in places], own, len(item), seed).run()

    began = time.perf_counter()
    assert sum(t[2] for t in tiles((["a"] * 8 + ["x"]) * 200, ["a"] * 1600)) == 1600
    assert time.perf_counter() - began < 5
    rnd = random.Random(1)
    for _ in range(150):
        v = rnd.choice([1, 2, 3, 8])
        item, doc = [rnd.randrange(v) for _ in range(rnd.randrange(5, 40))], [rnd.randrange(v + 1) for _ in range(rnd.randrange(50))]
        doc += item[len(item) // 2 :] + item[: len(item) // 2]
        got = tiles(doc, item)
        assert all(item[q : q + k] == doc[p : p + k] for q, p, k in got) and sum(t[2] for t in got) == greedy(doc, item, 5)


def kernel(a, b):
    """The gapped kernel of two symbol strings by enumeration of all subsequences."""
    def phi(x):
        out = {}
        for at in itertools.combinations(range(len(x)), toxicity.K):
            if at[-1] - at[0] < toxicity.SPAN and all(x[k] for k in at):
                key = tuple(x[k] for k in at)
                out[key] = out.get(key, 0) + toxicity.DECAY ** (at[-1] - at[0] + 1)
        return out

    x, y = phi(a), phi(b)
    return sum(v * y.get(k, 0) for k, v in x.items())


def test_toxicity_kernel_equals_enumeration():
    marks = ["idiot", "stupid", "i-d.iot", "wonder"]
    space = toxicity.Nystrom(marks)
    strings = [toxicity.symbols(m)[0].tolist() for m in marks]
    gram = np.array([[kernel(a, b) for b in strings] for a in strings])
    size = np.sqrt(np.diag(gram))
    values, vectors = np.linalg.eigh(gram / np.outer(size, size))
    keep = values > toxicity.EIGEN * values.max()
    got, expected = [], []
    for word in ("idiot", "idxiot", "stuppid", "thing", "wonder"):
        letters, starts = toxicity.symbols(word)
        got.append(np.concatenate(list(space.stretches(word))).sum(axis=0) * toxicity.size_of(letters, starts)[1])
        expected.append((np.array([kernel(letters.tolist(), s) for s in strings]) / size) @ (vectors[:, keep] / np.sqrt(values[keep])))
    # the directions of equal eigenvalues are free, products of coordinates are not
    got, expected = np.array(got), np.array(expected)
    np.testing.assert_allclose(got @ got.T, expected @ expected.T, atol=1e-3)


INSULTS = ["idiot", "moron", "worthless", "stupid", "loser", "trash"]


@pytest.fixture(scope="module")
def toxic_model(spark):
    """Learned from prose, of which the toxic half has one to four insults."""
    draw = random.Random(9)
    prose = ["the", "river", "runs", "under", "old", "bridges", "while", "people", "walk", "and", "talk", "about", "weather", "lost", "mornings", "statistics", "ideas", "studio", "morning", "closer"]
    rows = []
    for k in range(400):
        words = draw.choices(prose, k=draw.randrange(20, 120))
        for _ in range(draw.randrange(1, 5) if k % 2 else 0):
            words.insert(draw.randrange(len(words)), draw.choice(INSULTS))
        rows.append((k, " ".join(words), k % 2))
    return toxicity.train(spark.createDataFrame(rows, "doc_id long, text string, y int"), 0.2)


def drawn_apart(word, how):
    return {"plain": word, "dotted": ".".join(word), "spaced": " ".join(word), "inserted": word[:3] + "x" + word[3:], "starred": word[:2] + "*" + word[2:]}[how]


@pytest.mark.parametrize("how", ["plain", "dotted", "spaced", "inserted", "starred"])
def test_every_insult_raises_a_score(toxic_model, how):
    prose = "people walk under old bridges and talk about the weather while the river runs"
    made = [prose + "".join(f" {drawn_apart(w, how)} and" for w in INSULTS[:n]) for n in (0, 1, 2, 4)]
    scores = toxic_model.scores(made)
    assert scores[0] < scores[1] < scores[2] < scores[3] and scores[0] < 0.3 and scores[3] > 0.7
    # clean words, however many, take nothing away
    assert toxic_model.score(" ".join([made[3]] + [prose] * 50)) >= scores[3] - 1e-6


def test_toxicity_reads_letters_drawn_apart_and_scores_each_text_alone(toxic_model):
    assert all(toxicity.symbols(t)[0].tolist() == toxicity.symbols("an idiot here")[0].tolist() for t in ("an i d i o t here", "an i.d.i.o.t here"))
    assert len(toxicity.symbols("w.o.r.t.h.l.e.s.s i d i o t")[1]) == len(toxicity.symbols("worthless idiot")[1])
    texts = ["an idiot and a moron", None, "plain words", "", "i d i o t and m.o.r.o.n", "of the river and the weather " * 20_000]
    together = toxic_model.scores(texts)
    np.testing.assert_allclose(together, [toxic_model.score(t) for t in texts], rtol=1e-5)
    assert min(together[0], together[4]) > 0.7 > 0.3 > max(together[1], together[2], together[3], together[5])


def test_toxic_learning_does_not_depend_on_partitions(spark):
    rows = spark.createDataFrame([(k, f"plain words of {k}" + (" you idiot moron" if k % 2 else ""), k % 2) for k in range(60)], "doc_id long, text string, y int")
    a, b = (toxicity.train(r, 0.5) for r in (rows, rows.repartition(7)))
    np.testing.assert_allclose(a.weights, b.weights, atol=1e-4)
    one = toxicity.train(rows.where("y = 0"), 0.2)
    assert one.scores(["idiot", None]).round(6).tolist() == [0.2, 0.2]


def test_fit_takes_column_names(spark):
    d = frame(spark, [f"word{k} text" for k in range(12)]).withColumnsRenamed({"doc_id": "key", "text": "body"})
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(12)], "doc_id long, quality int, toxic int")
    for module in (quality, toxicity):
        model = module.fit(d, labels, doc_id="key", text="body")
        assert module.score(d, model, doc_id="key", text="body").count() == 12


def test_quality_features_are_compressed_sizes():
    import zstandard

    texts = {y: [" ".join(random.Random(100 * y + k).choices([f"{'good' if y else 'bad'}{j}" for j in range(40)], k=60)) for k in range(90)] for y in (0, 1)}
    model = quality.train([(100 * y + k, t, y) for y in (0, 1) for k, t in enumerate(texts[y])], 0.5)
    text = texts[1][0] * 12

    def size(dictionary):
        c = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_checksum=False, write_dict_id=False)
        raw = text.encode()
        return sum(len(c.compress(raw[k : k + quality.PIECE])) for k in range(0, len(raw), quality.PIECE))

    good, bad = size(model.good), size(model.bad)
    assert model.features(text)[:2] == pytest.approx([(bad - good) / (bad + good), (bad - good) / len(text.encode())], abs=0.01)
    assert model.score(texts[1][5]) > 0.7 > model.score(texts[0][5])


def test_learnt_text_of_a_repeated_id_does_not_depend_on_the_order(spark):
    rows = [(1, "b text"), (1, "a text"), (2, "c")]
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    for order in (rows, rows[::-1]):
        got = common.labelled_sample(spark.createDataFrame(order, "doc_id long, text string"), labels, "quality", 4, 99, 10).collect()
        assert sorted(map(tuple, got)) == [(1, "a text", 1), (2, "c", 0)]


def test_jaccard_links_and_chains(spark):
    base = [f"t{k}" for k in range(60)]
    texts = [" ".join(base), " ".join(base[:-1] + ["zz"]), " ".join(base[:-2] + ["zz", "yy"]), "only four words here", "Only FOUR words here", "a b"] + [f"lone{k} text of its own number {k}" for k in range(3)]
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(frame(spark, texts)).collect()}
    assert [got[k] for k in range(3)] == [0, 0, 0] and got[3] == got[4] == 3 and [got[k] for k in (5, 6, 7, 8)] == [5, 6, 7, 8]


def test_components_of_a_long_chain(spark):
    edges = spark.range(60).selectExpr("id as a", "id + 1 as b")
    assert {r.comp for r in components.connected_components(edges).collect()} == {0}


@pytest.mark.parametrize("order", [3, 4])
def test_backoff_scores_do_not_depend_on_numbered_words(spark, docs, order):
    """Without numbers, with a few, with all; n-grams of four words have no room for numbers."""
    few = docs.limit(60)
    want, *others = (lm.stupid_backoff(few, order, frequent=n).orderBy("doc_id", "score").collect() for n in (0, 40, 1 << 16))
    assert len(want) == 60 and all(got == want for got in others)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_numbered_names_come_back_without_their_range(n):
    draw = np.random.default_rng(n)
    for size in (0, 1, 500):
        keys = np.unique(draw.integers(0, 1 << 16 * n, size, dtype=np.uint64))
        names = keys | np.uint64(5 << 61)
        assert blocks.unpack_numbered(blocks.pack_numbered(names, n), n).tolist() == keys.tolist()


@pytest.mark.parametrize("bits", [0, 3, 14, 40, 63])
def test_names_of_a_range_cost_the_same_in_small_ranges(bits):
    draw = np.random.default_rng(bits)
    for size in (0, 1, 2, 7, 100, 3000):
        keys = np.unique(draw.integers(0, 1 << (64 - bits), size, dtype=np.uint64))
        if size:
            keys[-1] = (1 << (64 - bits)) - 1
            keys = np.unique(keys)
        names = keys | np.uint64(((1 << bits) - 1) << (64 - bits) & (1 << 64) - 1)
        blob = blocks.pack_in_range(names, bits)
        assert blocks.unpack_in_range(blob, bits).tolist() == keys.tolist()
        assert len(blob) <= 7 + len(keys) * (max(64 - bits - len(keys).bit_length(), 0) + 3) / 8


@pytest.mark.parametrize("least", [0, 1 << 50], ids=["small", "large"])
def test_own_counts_equal_a_count(least):
    draw = np.random.default_rng(3)
    grams, of = draw.integers(0, 9, 300) + least, np.sort(draw.integers(0, 1 << 12, 300) // 200)
    pairs = list(zip(grams.tolist(), of.tolist(), strict=True))
    assert lm.own_counts(grams, of).tolist() == [pairs.count(x) for x in pairs]


def test_backoff_moves_numbers_of_frequent_words(spark):
    draw = np.random.default_rng(1)
    texts = [" ".join(f"w{k:x}" for k in (5000 * draw.random(2000) ** 3).astype(int)) for _ in range(200)]
    d = common.materialize(frame(spark, texts), "texts")
    shuffled, _ = measured(spark, lambda: lm.stupid_backoff(d).collect())
    assert shuffled / 400_000 < 9


def test_url_rules_and_list(spark):
    pages = spark.createDataFrame([(1, "https://www.A.example.NET/en/x"), (2, "http://b.net"), (3, "http://b.net/"), (4, "ftp://x.org/fr/a/?utm_source=q#f"), (5, "nothing"), (6, None), (7, "http://www.seen.com/p/?b=2&a=1"), (8, "https://seen.com/p?a=1&b=2&ref=z#top")], "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, pages.where("page_id = 7")).collect()}
    assert got[1] == ("www.a.example.net", "/en/x", "example.net/en/", "allow") and got[2] == ("b.net", "", None, "allow") and got[3][2:] == ("net/", "block")
    assert got[4][2:] == ("org/fr/", "allow") and got[5] == got[6] == ("", "", None, "allow") and got[7][3] == got[8][3] == "block"


@pytest.mark.parametrize(("name", "label", "least"), [("op3_quality_classifier", "quality", 0.9), ("op9_toxicity", "toxic", 0.8)])
def test_held_out_ranking(spark, name, label, least):
    sf = "/root/testdata/sf0.1" if name.startswith("op3") else "/root/testdata/sf0.01"
    m = registry.queries()[name](spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    m = m[m.held_out]
    y, r = m[label].to_numpy(), m.score.rank().to_numpy()
    auc = (r[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (1 - y).sum())
    assert auc > least


def test_line_runs_within_and_across(spark):
    d = frame(spark, ["a\nb\nc\nd", "x\nb\n\nc\nd\ny", "q\nq\nq\nq", None, ""])
    got = {r.doc_id: (r.text, r.lines_removed) for r in line_dedup.dedup_lines(d).collect()}
    assert got == {0: ("a\nb\nc\nd", 0), 1: ("x\n\ny", 3), 2: ("q", 3), 3: (None, 0), 4: ("", 0)}


def test_short_line_runs_equal_brute_force(spark, docs):
    """Every run of RUN lines or of WORDS words that stands at an earlier place, in the pipeline's stage."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rnd = random.Random(9)
    pool = [" ".join(f"w{rnd.randrange(50)}" for _ in range(n)) for n in (1, 4, 9, 11, 15, 19, 20, 21, 60) for _ in range(3)]
    made = ["\n".join(rnd.choice([*pool, "", " "]) for _ in range(rnd.randrange(1, 6))) for _ in range(40)]
    texts = [*made, pool[-1], pool[-1], None, ""] + [r.text for r in docs.orderBy("doc_id").limit(60).collect()]
    seen, expected = set(), {}
    for d, t in enumerate(texts):
        lines = (t or "").split("\n")
        full = [k for k, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x)]
        gone = set()
        for i in range(len(full)):
            for n in range(1, line_dedup.RUN + 1):
                run = tuple(lines[k] for k in full[i : i + n])
                if len(run) == n and (n == line_dedup.RUN or sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in run) >= line_dedup.WORDS):
                    gone |= set(full[i : i + n]) if run in seen else set()
                    seen.add(run)
        expected[d] = None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in gone)
    got = {r.doc_id: r.text for r in pipeline.cut_lines(spark, frame(spark, texts), SF).collect()}
    assert got == expected and got[41] == ""


def test_a_copy_of_two_lines_goes(spark):
    line = " ".join(f"word{k}" for k in range(11))
    got = line_dedup.dedup_lines(frame(spark, [f"{line} a\n{line} b"] * 2)).orderBy("doc_id").collect()
    assert [(r.lines_removed, r.text) for r in got] == [(0, f"{line} a\n{line} b"), (2, "")]


def test_pipeline_on_planted_documents(spark):
    """Each stage takes what is planted for it and leaves the rest; null, empty and repeated rows pass or go as stated."""
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.01"
    base = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1 and toxic = 0").select("doc_id")
    clean = [r.text for r in base.join(labels, "doc_id").where("lang = 'en' and length(text) between 900 and 3000").orderBy("doc_id").limit(12).collect()]
    item = next(r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").collect() if r.text and len(r.text.split()) >= 20)
    plain = lambda k: clean[k].replace("\n", " ")
    near = " ".join(w if k != 40 else "changed" for k, w in enumerate(plain(1).split()))
    rows = [
        (1, plain(0)), (2, plain(1)), (3, near), (4, plain(1)), (5, plain(2) + " " + item), (6, " ".join(f"{w}{m}" for w, m in zip(plain(3).split(), itertools.cycle(["***", "###", "", "&&&", "$$$", "", "%%%"])))), (7, plain(4) + "\n" + plain(5)), (8, plain(6) + "\n" + plain(5)), (9, None), (10, ""), (11, "word " * 40), (1, plain(0)),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], base.schema)
    good = pipeline.keep_quality(spark, docs, sf)
    kept = sorted(r.doc_id for r in good.collect())
    assert good.columns == docs.columns and {1, 2, 3, 4, 5, 7, 8} <= set(kept) and 6 not in kept and kept.count(1) == 2
    cut = pipeline.cut_lines(spark, docs, sf)
    texts = {r.doc_id: (r.text, r.n_chars) for r in cut.collect()}
    assert cut.columns == docs.columns and cut.count() == len(rows)
    assert texts[8] == (plain(6), len(plain(6))) and texts[7][0] == rows[6][1] and texts[9] == (None, None) and texts[10] == ("", 0) and texts[4][0] == ""
    one = pipeline.one_of_each_group(spark, docs, sf)
    ids = sorted(r.doc_id for r in one.collect())
    assert one.columns == docs.columns and {2, 9, 10, 5, 7, 8} <= set(ids) and not {3, 4} & set(ids) and ids.count(1) == 1
    free = pipeline.drop_benchmark(spark, docs, sf)
    ids = sorted(r.doc_id for r in free.collect())
    assert free.columns == docs.columns and 5 not in ids and {1, 2, 3, 4, 6, 7, 8, 9, 10} <= set(ids)
    tokens = pipeline.tokenise(spark, docs, sf).collect()
    assert len(tokens) == len(rows) and all(r.decoded_sha256 == hashlib.sha256((dict(rows)[r.doc_id] or "").encode()).hexdigest() for r in tokens)


def test_pipeline_runs(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    out = pipeline.run(spark, SF)
    assert 0 < out.count() < common.table(spark, SF, "documents").count() and np.all([c in out.columns for c in ("doc_id", "n_tokens")])
    assert out.groupBy("doc_id").count().where(F.col("count") > 1).count() == 0

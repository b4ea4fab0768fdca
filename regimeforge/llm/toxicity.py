"""Toxicity by a support vector machine with a gapped-subsequence string kernel.

The kernel of two strings compares the letter subsequences of length K that lie within SPAN characters,
each weighted by DECAY to the power of the span it takes. Letters are folded (case, accents); all else is
a gap, so an insult with characters inserted or with dots or spaces between its letters still shares
most of its subsequences with the plain one.

Nystrom: the machine works in the span of landmark strings, K(x, landmarks) K(landmarks, landmarks)^-1/2.
As the kernel has an explicit feature for each letter subsequence, the trained machine collapses to one
weight for each of the ALPHABET ** K subsequences, and a text is scored by table look-ups over its gap
patterns, exactly and in time proportional to its length.

A sentence or text is judged by all of its stretches, a stretch being a word with the white space before it: its value
is the logarithm of 1 plus the sum of exp(SOFT * margin) - 1 over the stretches whose margin is positive. So it rises with
every insult, however faint, and clean words add nothing, however many they are.

Labels are of documents, so labels of stretches are learned: all stretches of clean documents are negative; in a
toxic one the stretch that the current machine finds the worst is the positive example (a few rounds). The machine is
a least-squares support vector machine: what it needs of the negative stretches, all of them, is one matrix of
sums, taken on the executors; no document's stretches reach the driver. A logistic curve on documents that the
machine did not see makes the value a score. Learning is on at most ``per_class`` rows of either label, whole texts; this
is a parameter of the method.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, quality

K = 4
SPAN = 7
DECAY = 0.7
ALPHABET = 32
#: The symbol of white space, so that where a word begins counts too; a subsequence may skip it.
BORDER = 31
LANDMARKS = 256
ROUNDS = 4
LEAST = 6
SEEDS, BALANCE, RIDGE = 24, 0.1, 1.0
#: Nystrom directions of less than this share of the largest are left out.
EIGEN = 1e-3
SOFT = 2.0
PER_CLASS = 800
FOLDS, HELD_OUT = 3, 1
#: Stretches whose coordinates are in memory at a time.
BLOCK = 1 << 13
#: Characters that are scored at a time, to stay within the processor's cache.
STEP = 1 << 16

#: Offsets of the K letters from the first one, with the kernel weight of the span.
PATTERNS = sorted((((0, *rest), DECAY ** (rest[-1] + 1)) for rest in combinations(range(1, SPAN), K - 1)), key=lambda p: p[0][-1])


def _folding() -> np.ndarray:
    """Symbol of each code point below 0x3000: letters a-z are 1 to 26 whatever their case and accent,
    other letters share 27 to 30, the rest are gaps."""
    table = np.zeros(0x3000, np.uint8)
    for code in range(len(table)):
        base = unicodedata.normalize("NFKD", chr(code).lower())[:1]
        if "a" <= base <= "z":
            table[code] = ord(base) - 96
        elif base.isalpha():
            table[code] = 27 + code % 4
    return table


_FOLD = _folding()


def symbols(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(symbol of each character, where stretches start). A stretch is a word with the white space before it;
    a subsequence belongs to the stretch that it starts in. The text stands between gaps, so that no
    subsequence runs from one text into another."""
    codes = np.frombuffer(("\0" * SPAN + "\n" + text + "\n" + "\0" * SPAN).encode("utf-32-le", "replace"), np.uint32)
    letters = np.where(codes < len(_FOLD), _FOLD[np.minimum(codes, len(_FOLD) - 1)], (27 + codes % 4).astype(np.uint8))
    lone = letters > 0
    lone[1:-1] &= (letters[:-2] == 0) & (letters[2:] == 0)
    # letters drawn apart are put together where what is between them is the same as before or after the next letter:
    # "i.d.i.o.t s.c.u.m" is two words, as is "i d i o t.s.c.u.m"
    between = np.zeros(len(codes), bool)
    between[1:-1] = lone[:-2] & lone[2:] & (codes[1:-1] != 10)
    before, after = np.zeros(len(codes), bool), np.zeros(len(codes), bool)
    before[2:] = between[:-2] & (codes[2:] == codes[:-2])
    after[:-2] = between[2:] & (codes[2:] == codes[:-2])
    first = np.ones(len(codes), bool)
    first[2:] = ~between[:-2]
    keep = ~(between & (before | (after & first)))
    codes, letters = codes[keep], letters[keep]
    space = (codes == 32) | ((codes >= 9) & (codes <= 13))
    letters[space] = BORDER
    return letters, np.append(0, np.flatnonzero(space))


def subsequences(letters: np.ndarray):
    """For each gap pattern: (index of the subsequence at each start, kernel weight). An index that has
    a gap for a letter has weight 0 in every table. The index of four letters is put together from two pairs."""
    n = len(letters)
    padded = np.concatenate([letters, np.zeros(2 * SPAN, np.uint8)]).astype(np.int32)
    pair = {d: (padded[: n + SPAN] << 5) | padded[d : d + n + SPAN] for d in range(1, SPAN)}
    high = {d: p << 10 for d, p in pair.items()}
    for (_, second, third, last), weight in PATTERNS:
        yield high[second][:n] | pair[last - third][third : third + n], weight


def size_of(letters: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """What each stretch's kernel value is divided by: the root of its letters, which the kernel of a part with
    itself grows with. A stretch counts as LEAST letters at least; one without a letter is infinite."""
    own = np.add.reduceat(((letters > 0) & (letters < BORDER)).astype(np.float32), starts)
    return np.where(own > 0, np.sqrt(np.maximum(own, LEAST)), np.inf)


def no_gaps() -> np.ndarray:
    """Which of the ALPHABET ** K subsequences consist of letters only."""
    held = np.ones(1, bool)
    letter = np.arange(ALPHABET) > 0
    for _ in range(K):
        held = (held[:, None] & letter[None, :]).ravel()
    return held


class Model:
    """A weight for each subsequence, a weight for each letter of a sentence, and the calibration."""

    def __init__(self, weights: np.ndarray, bias: float, curve: list[float]):
        self.weights, self.bias, self.curve = weights.astype(np.float32), bias, curve

    def values(self, letters: np.ndarray) -> np.ndarray:
        """The machine's weight of the subsequences that start at each character."""
        values = np.zeros(len(letters), np.float32)
        for at in range(0, len(letters), STEP):
            part = letters[at : at + STEP + SPAN]
            n = min(STEP, len(letters) - at)
            acc, same, got, held = np.zeros(n, np.float32), np.zeros(n, np.float32), np.empty(n, np.float32), None
            for index, weight in subsequences(part):
                if held is not None and weight != held:
                    acc += same * np.float32(held)
                    same[:] = 0
                held = weight
                np.take(self.weights, index[:n], out=got, mode="clip")
                same += got
            values[at : at + n] = acc + same * np.float32(held)
        return values

    def margins(self, texts: list[str | None]):
        """The machine's value of each stretch of each text. Short texts are looked up together; what a text gets
        does not depend on the others."""
        k = 0
        while k < len(texts):
            group, size = [], 0
            while k < len(texts) and (not group or size < STEP):
                group.append(symbols(texts[k] or ""))
                size += len(group[-1][0])
                k += 1
            values, at = self.values(np.concatenate([g[0] for g in group])), 0
            for letters, starts in group:
                yield np.add.reduceat(values[at : at + len(letters)], starts, dtype=np.float64) / size_of(letters, starts) + self.bias
                at += len(letters)

    def toxic_values(self, texts: list[str | None]) -> np.ndarray:
        """One value for each text: see the module. A text without letters has 0."""
        return np.array([math.log1p(np.expm1(SOFT * np.maximum(0, own)).sum()) for own in self.margins(texts)])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        z = self.curve[0] + self.curve[1] * self.toxic_values(texts)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def score(self, text: str | None) -> float:
        return float(self.scores([text])[0])


def landmarks(rows: DataFrame, count: int) -> tuple[list[str], int]:
    """Words as landmarks, and how many of them are toxic: half are those whose share of toxic documents is the most
    significantly above the average, half the words in most clean documents. Documents of each word are counted by
    Spark; ``count`` words come back. Ties go by the word."""
    words = rows.select("y", F.explode(F.array_distinct(F.expr(r"regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+', 0)"))).alias("w")).where(F.length("w") >= K)
    df = words.groupBy("w").agg(F.count("*").alias("n"), F.sum("y").alias("toxic"))
    share = rows.agg(F.avg("y")).first()[0]
    odd = (F.col("toxic") - F.col("n") * share) / F.sqrt(F.col("n").cast("double"))
    toxic = [r[0] for r in df.where("toxic > 0").orderBy(odd.desc(), "w").limit(count // 2).collect()]
    clean = [r[0] for r in df.where("n > toxic").where(~F.col("w").isin(toxic)).orderBy((F.col("n") - F.col("toxic")).desc(), "w").limit(count - len(toxic)).collect()]
    return toxic + clean, len(toxic)


class Nystrom:
    """Kernel features of sentences against the landmarks."""

    def __init__(self, marks: list[str]):
        letters_only = no_gaps()
        feats = []
        for mark in marks:
            own: Counter = Counter()
            for index, weight in subsequences(symbols(mark)[0]):
                for i in index[letters_only[index]].tolist():
                    own[i] += weight
            feats.append(own)
        self.used = np.array(sorted({i for f in feats for i in f}), np.int64)
        self.compact = np.full(ALPHABET**K, -1, np.int32)
        self.compact[self.used] = np.arange(len(self.used))
        phi = np.zeros((len(marks), len(self.used)), np.float32)
        for k, f in enumerate(feats):
            phi[k, self.compact[list(f)]] = list(f.values())
        phi /= np.maximum(np.linalg.norm(phi, axis=1, keepdims=True), 1e-9)
        values, vectors = np.linalg.eigh(phi @ phi.T)
        keep = values > EIGEN * values.max(initial=1e-9)
        root = vectors[:, keep] / np.sqrt(values[keep])
        self.map = (phi.T @ root).astype(np.float32)  # subsequence -> Nystrom coordinates

    def stretches(self, text: str, only: int | None = None):
        """Blocks of the coordinates of a text's stretches that have a letter, or of stretch ``only`` alone."""
        letters, starts = symbols(text)
        ends = np.append(starts, len(letters))
        at = [(k, min(k + BLOCK, len(starts))) for k in range(0, len(starts), BLOCK)] if only is None else [(only, only + 1)]
        for lo, hi in at:
            # a subsequence belongs to the stretch that it starts in, and may end in the next one
            n = ends[hi] - ends[lo]
            part = letters[ends[lo] : ends[hi] + SPAN]
            unit = np.repeat(np.arange(hi - lo), np.diff(ends[lo : hi + 1]))
            out = np.zeros((hi - lo, self.map.shape[1]), np.float32)
            for index, weight in subsequences(part):
                known = self.compact[index[:n]]
                used = np.flatnonzero(known >= 0)
                if len(used):
                    of = unit[used]  # rises along the text
                    first = np.flatnonzero(np.diff(of, prepend=-1))
                    out[of[first]] += np.float32(weight) * np.add.reduceat(self.map[known[used]], first, axis=0)
            size = size_of(part[:n], starts[lo:hi] - ends[lo])
            yield (out / size[:, None])[np.isfinite(size)]

    def weights(self, w: np.ndarray) -> np.ndarray:
        full = np.zeros(ALPHABET**K, np.float32)
        full[self.used] = self.map @ w.astype(np.float32)
        return full


def _gram(rows: DataFrame, space: Nystrom) -> np.ndarray:
    """Sums of products of the coordinates (and a constant) of all stretches of all texts. Each task adds up its own;
    as many small matrices as tasks come back, and the rows are a bounded sample."""
    width = space.map.shape[1] + 1
    spread = rows.sparkSession.sparkContext.broadcast(space)

    def run(batches):
        total = np.zeros((width, width))
        for batch in batches:
            for text in batch.column(0):
                for block in spread.value.stretches(text.as_py() or ""):
                    z = np.hstack([block, np.ones((len(block), 1), np.float32)])
                    total += z.T.astype(np.float64) @ z.astype(np.float64)
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["m"])

    parts = rows.select("text").mapInArrow(run, "m binary").collect()
    return sum((np.frombuffer(r[0]).reshape(width, width) for r in parts), np.zeros((width, width)))


def _worst(rows: DataFrame, space: Nystrom, model: Model) -> np.ndarray:
    """Coordinates of the stretch of each text that the machine finds the worst, if it finds one on the wrong side; of
    all texts if there is none. One vector for each row of the bounded sample comes back."""
    spread = rows.sparkSession.sparkContext.broadcast((space, model))

    def run(batches):
        space, model = spread.value
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                own = next(model.margins([text]))
                k = int(np.argmax(own))
                block = np.concatenate(list(space.stretches(text or "", k)))
                if len(block):
                    out.append((float(own[k]), block[0].tobytes()))
            yield pa.record_batch([pa.array([m for m, _ in out], pa.float64()), pa.array([v for _, v in out], pa.binary())], ["margin", "v"])

    found = rows.select("text").mapInArrow(run, "margin double, v binary").collect()
    found = [r for r in found if r[0] > 0] or found
    # the order of rows must not matter to the last digit
    return np.array(sorted(np.frombuffer(r[1], np.float32).tolist() for r in found), np.float64).reshape(-1, space.map.shape[1])


def solve(gram: np.ndarray, positive: np.ndarray) -> tuple[np.ndarray, float]:
    """A least-squares support vector machine: targets 1 for the positive rows, -1 for the rows that ``gram`` sums up;
    together the positive rows weigh ``BALANCE`` of the others."""
    z = np.hstack([positive, np.ones((len(positive), 1))])
    cost = BALANCE * gram[-1, -1] / max(len(z), 1)
    shrink = np.full(len(gram), RIDGE)
    shrink[-1] = 1e-6
    w = np.linalg.solve(gram + cost * z.T @ z + np.diag(shrink), cost * z.sum(axis=0) - gram[-1])
    return w[:-1], float(w[-1])


def rising(values: np.ndarray, y: np.ndarray) -> list[float]:
    """A logistic curve that does not fall: where the labels fall with the value it is level."""
    fitted = quality.logistic(np.stack([np.ones(len(values)), values], axis=1), y, ridge=1e-4)
    return fitted.tolist() if fitted[1] >= 0 else [math.log(y.mean() / (1 - y.mean())), 0.0]


def train(rows: DataFrame, prior: float) -> Model:
    """``rows``: (doc_id, text, y), a bounded sample of labelled documents. Two of three rows (by a hash of the id) train the
    machine, the third calibrates. Without rows of both labels in both parts every score is the prior."""
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    rows = rows.select("text", "y", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 2).alias("curve"))
    rows = common.materialize(rows.repartition(common.shuffle_partitions(rows.sparkSession), F.xxhash64("text")), "labelled")
    machine, curve = rows.where("not curve"), rows.where("curve")
    seen = {(r[0], r[1]) for r in rows.select("curve", "y").distinct().collect()}
    if len(seen) < 4:
        common.release(rows)
        return Model(np.zeros(ALPHABET**K), 0.0, [math.log(prior / (1 - prior)), 0.0])
    marks, toxic = landmarks(machine, LANDMARKS)
    space = Nystrom(marks)
    gram = _gram(machine.where("y = 0"), space)
    # the landmarks that stand out in toxic documents are positive examples from the start and stay so
    alone = [np.concatenate(list(space.stretches(m))) for m in marks[: min(SEEDS, toxic)]]
    seeds = [max(x, key=lambda v: float(v @ v)) for x in alone if len(x)]
    positive = np.array(seeds, np.float64).reshape(-1, space.map.shape[1])
    for _ in range(ROUNDS):
        w, bias = solve(gram, positive)
        model = Model(space.weights(w), bias, [0.0, 0.0])
        positive = np.vstack([positive[: len(seeds)], _worst(machine.where("y = 1"), space, model)])
    w, bias = solve(gram, positive)
    model = Model(space.weights(w), bias, [0.0, 0.0])
    spread = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield pa.record_batch([pa.array(spread.value.toxic_values(batch.column(0).to_pylist())), batch.column(1)], ["v", "y"])

    pairs = sorted(map(tuple, curve.select("text", F.col("y").cast("int").alias("y")).mapInArrow(run, "v double, y int").collect()))
    values, y = (np.array(x, float) for x in zip(*pairs, strict=True))
    fitted = rising(values, y)
    fitted[0] += math.log(prior / (1 - prior)) - math.log(y.mean() / (1 - y.mean()))
    model.curve = fitted
    common.release(rows)
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = FOLDS, held_out: int = HELD_OUT, per_class: int = PER_CLASS, doc_id: str = "doc_id", text: str = "text") -> Model:
    """A model from at most ``per_class`` learnable rows of either label, the same ones on every run."""
    learnable = labels.where(F.col(label).isin(0, 1) & (common.fold(F.col("doc_id"), folds) != held_out))
    share = learnable.agg(F.avg(F.col(label).cast("double"))).first()[0]
    return train(common.labelled_sample(docs, labels, label, folds, held_out, per_class, doc_id, text), 0.5 if share is None else share)


def score(docs: DataFrame, model: Model, **names) -> DataFrame:
    """(doc_id, held_out, score, predicted) of whole texts; see ``quality.score`` for the odd cases."""
    return quality.score(docs, model, **({"folds": FOLDS, "held_out": HELD_OUT} | names))

"""Quality classifier by compression: which of two dictionaries makes a text smaller?

One zstandard dictionary is trained on texts labelled good and one on texts labelled bad. A text is cut
into pieces of PIECE bytes, so a dictionary helps along the whole of a long text and not at its start
only, and every piece is compressed with either. The features are the size difference, normalised by the
sum of sizes and by the raw size, and the better size by the raw size (text that says little); a logistic
regression on other labelled texts turns them into a calibrated probability of label 1.

Learning is on the whole texts of a sample of at most ``per_class`` rows of either label; this is a
parameter of the method.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

PIECE = 4096
#: Bytes of the pieces a dictionary is trained on, and of the dictionary.
SAMPLE, LEAST, DICTIONARY = 1024, 256, 64 << 10
LEVEL = 3
PER_CLASS = 1500
FOLDS, HELD_OUT = 4, 2
ACCEPT = 0.7


def pieces(raw: bytes) -> list[bytes]:
    return [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]


class Model:
    """Two dictionaries and the weights of the calibration."""

    def __init__(self, good: bytes, bad: bytes, weights: list[float]):
        self.good, self.bad, self.weights = good, bad, weights
        self._made = None

    def __getstate__(self):
        return {"good": self.good, "bad": self.bad, "weights": self.weights, "_made": None}

    def features(self, text: str) -> list[float]:
        if self._made is None:
            self._made = [self._compressor(d) for d in (self.good, self.bad)]
        raw = text.encode()
        if not raw:
            return [0.0, 0.0, 0.0, 0.0]
        good = bad = best = 0
        for p in pieces(raw):
            a, b = len(self._made[0].compress(p)), len(self._made[1].compress(p))
            good, bad, best = good + a, bad + b, best + min(a, b)
        return [(bad - good) / (bad + good), (bad - good) / len(raw), best / len(raw), math.log(len(raw)) / 10]

    @staticmethod
    def _compressor(content: bytes):
        options = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        if not content:
            return zstandard.ZstdCompressor(**options)
        held = zstandard.ZstdCompressionDict(content)
        held.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(dict_data=held, **options)

    def score(self, text: str | None) -> float:
        z = float(np.dot(expand(np.array([self.features(text or "")]))[0], self.weights))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def scores(self, texts: list[str | None]) -> list[float]:
        return [self.score(t) for t in texts]


def expand(x: np.ndarray) -> np.ndarray:
    """The features with their squares and a constant."""
    return np.hstack([np.ones((len(x), 1)), x, x * x])


def train_dictionary(texts: list[str]) -> bytes:
    """A dictionary of the whole texts, trained on pieces; its size follows theirs, up to DICTIONARY. Where the trainer
    finds too few pieces for any dictionary, a few kilobytes, these are the dictionary, all of them."""
    samples = [raw[k : k + SAMPLE] for raw in (t.encode() for t in texts) for k in range(0, len(raw), SAMPLE)]
    size = min(DICTIONARY, max(LEAST, sum(map(len, samples)) // 16))
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 100) -> np.ndarray:
    """Newton's method; the constant comes first and is not shrunk."""
    w = np.zeros(x.shape[1])
    shrink = np.full(x.shape[1], ridge)
    shrink[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) / len(y) + shrink * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x / len(y) + np.diag(shrink)
        step = np.linalg.solve(hessian + 1e-9 * np.eye(len(w)), gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(rows: list[tuple[int, str | None, int]], prior: float) -> Model:
    """rows: (doc_id, text, label). Two of three rows build the dictionaries, the third calibrates.
    ``prior`` is the share of label 1 among all learnable rows: the sample is balanced by class, and the
    calibration weighs it back. Without rows of both labels every score is the prior."""
    rows = sorted((i, t or "", y) for i, t, y in rows)
    parts: dict[tuple[int, bool], list[str]] = {(y, c): [] for y in (0, 1) for c in (False, True)}
    seen = [0, 0]
    for _, text, y in rows:
        parts[y, seen[y] % 3 == 2].append(text)
        seen[y] += 1
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    if not all(parts.values()):
        return Model(b"", b"", [math.log(prior / (1 - prior))] + [0.0] * 8)
    model = Model(train_dictionary(parts[1, False]), train_dictionary(parts[0, False]), [])
    x = expand(np.array([model.features(t) for y in (0, 1) for t in parts[y, True]]))
    y = np.array([y for y in (0, 1) for _ in parts[y, True]], float)
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    w = logistic(x / scale, y, ridge=1e-4) / scale
    w[0] += math.log(prior / (1 - prior)) - math.log(y.mean() / (1 - y.mean()))
    model.weights = w.tolist()
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = FOLDS, held_out: int = HELD_OUT, per_class: int = PER_CLASS, doc_id: str = "doc_id", text: str = "text") -> Model:
    """A model from at most ``per_class`` learnable rows of either label, the same ones on every run."""
    learnable = labels.where(F.col(label).isin(0, 1) & (common.fold(F.col("doc_id"), folds) != held_out))
    share = learnable.agg(F.avg(F.col(label).cast("double"))).first()[0]
    rows = common.labelled_sample(docs, labels, label, folds, held_out, per_class, doc_id, text).select("doc_id", "text", "y").collect()
    return train([(r[0], r[1], r[2]) for r in rows], 0.5 if share is None else share)


def score(docs: DataFrame, model, folds: int = FOLDS, held_out: int = HELD_OUT, accept: float = ACCEPT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each row of ``docs``, from whole texts.

    Null and empty texts have the score of a text that tells nothing. Rows with a null id have a null
    ``held_out``. An empty table gives an empty result; other columns are ignored."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            scores = held.value.scores(batch.column(1).to_pylist())
            yield pa.record_batch([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (common.fold(F.col("doc_id"), folds) == held_out).alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model, accept: float = ACCEPT, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, whose whole text scores at least ``accept``.

    Null and empty texts have the score of a text that tells nothing. Repeated rows and ids are each judged
    for themselves; an empty table gives an empty result."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([s >= accept for s in held.value.scores(batch.column(text).to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

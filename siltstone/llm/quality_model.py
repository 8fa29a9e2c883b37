"""Text quality by a Naive Bayes support vector machine.

Indicators of n-grams of words, of word shapes (``Xx``, ``x&``, ``X!``) and of recurrence marks
(whether a word repeats one just before) are hashed to a fixed number of features, scaled by the
classes' log-count ratios and given to a linear hinge-loss model that dual coordinate descent
fits.  A sigmoid fitted on documents left out of that fit turns margins into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.language import held_out
from siltstone.llm.textkit import SPACES, Words, hash_runs, mix, slices

WORD_FEATURES = 1 << 16
SHAPE_FEATURES = 1 << 14
N_FEATURES = WORD_FEATURES + SHAPE_FEATURES
#: The training sample: so many labelled documents at most, in hashed order.
#: Each is packed into N_FEATURES / 8 bytes at most, however long its text.
SAMPLE_DOCS = 4000
THRESHOLD = 0.3

_B = np.arange(256)
_CLASS = np.select([(_B >= 65) & (_B <= 90), ((_B >= 97) & (_B <= 122)) | (_B >= 128), (_B >= 48) & (_B <= 57)], [1, 2, 3], _B).astype(np.uint8)


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The indicators that are set, text by text in order, and each text's bounds in them."""
    words = Words(raw, offsets, SPACES)
    doc, n = words.doc, len(words.doc)
    kinds = _CLASS[raw[words.at]]
    fresh = np.ones(len(kinds), bool)
    fresh[1:] = (kinds[1:] != kinds[:-1]) | (words.word[1:] != words.word[:-1])
    shapes = hash_runs(kinds[fresh], words.word[fresh], n)
    near = np.zeros(n, np.uint64)
    for back in range(8, 0, -1):
        same = np.zeros(n, bool)
        if n > back:
            same[back:] = (words.hash[back:] == words.hash[:-back]) & (doc[back:] == doc[:-back])
        near[same] = 1 if back == 1 else 2
    found = []

    def put(values: np.ndarray, gram: int, salt: int, first: int, size: int) -> None:
        if n < gram:
            return
        total = sum(mix(values[j : n - gram + 1 + j], salt + j) for j in range(gram))
        whole = doc[: n - gram + 1] == doc[gram - 1 :]
        found.append(doc[: n - gram + 1][whole] * N_FEATURES + first + (mix(total, salt)[whole] % np.uint64(size)).astype(np.int64))

    put(words.hash, 1, 10, 0, WORD_FEATURES)
    put(words.hash, 2, 20, 0, WORD_FEATURES)
    for gram in (1, 2, 3):
        put(shapes, gram, 30 * gram, WORD_FEATURES, SHAPE_FEATURES)
        put(near, gram + 1, 200 * gram, WORD_FEATURES, SHAPE_FEATURES)
    n_texts = len(offsets) - 1
    length = np.log2(np.bincount(doc, minlength=n_texts) + 1).astype(np.uint64)
    found.append(np.arange(n_texts) * N_FEATURES + WORD_FEATURES + (mix(length, 999) % np.uint64(SHAPE_FEATURES)).astype(np.int64))
    every = np.unique(np.concatenate(found))
    return every % N_FEATURES, np.searchsorted(every, np.arange(n_texts + 1) * N_FEATURES)


def packed(row: np.ndarray) -> bytes:
    """A row of indicators in N_FEATURES / 8 bytes at most."""
    if 4 * len(row) < N_FEATURES // 8:
        return row.astype(np.int32).tobytes()
    bits = np.zeros(N_FEATURES, bool)
    bits[row] = True
    return np.packbits(bits).tobytes()


def unpacked(row: bytes | np.ndarray) -> np.ndarray:
    if isinstance(row, np.ndarray):
        return row
    if len(row) < N_FEATURES // 8:
        return np.frombuffer(row, np.int32)
    return np.flatnonzero(np.unpackbits(np.frombuffer(row, np.uint8)))


def _blocks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for _, _, raw, offsets in slices(column):
        yield features(raw, offsets)


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [packed(row) for at, bounds in _blocks(batch.column("text")) for row in np.split(at, bounds[1:-1])]
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found, pa.binary())], ["label", "at"])


def scaled(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x**2).sum() + 1e-9)


@dataclass
class NBSVM:
    """Weights of indicators that are scaled by ``ratio`` and then to length 1."""

    ratio: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    @classmethod
    def fit(cls, rows: list[bytes | np.ndarray], labels: np.ndarray, cost: float = 1.0, epochs: int = 12, seed: int = 5) -> NBSVM:
        """rows: the indicators that are set, packed or not; labels: 0 or 1."""
        test = np.arange(len(rows)) % 5 == 0
        model = cls._margins([r for r, t in zip(rows, test, strict=True) if not t], labels[~test], cost, epochs, seed)
        margin = np.array([model.margins(at, np.array([0, len(at)]))[0] for at in (unpacked(r) for r, t in zip(rows, test, strict=True) if t)])
        model.slope, model.shift = _sigmoid(margin, labels[test])
        return model

    @classmethod
    def _margins(cls, rows: list[bytes | np.ndarray], labels: np.ndarray, cost: float, epochs: int, seed: int) -> NBSVM:
        counts = np.ones((2, N_FEATURES))
        for row, y in zip(rows, labels, strict=True):
            counts[y, unpacked(row)] += 1
        ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
        sign = np.where(labels == 1, 1.0, -1.0)
        most = cost * np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
        alpha, w, b = np.zeros(len(rows)), np.zeros(N_FEATURES), 0.0
        rng = np.random.Generator(np.random.PCG64(seed))
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                at = unpacked(rows[i])
                x = scaled(ratio[at])
                gradient = sign[i] * (x @ w[at] + b) - 1
                new = min(max(alpha[i] - gradient / 2, 0.0), most[i])  # 2: a row's length and the bias's
                if new != alpha[i]:
                    move = (new - alpha[i]) * sign[i]
                    w[at] += move * x
                    b += move
                    alpha[i] = new
        return cls(ratio, w, b)

    def margins(self, at: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Of texts with the indicators ``at`` between ``bounds``; no text is without any."""
        ratio = self.ratio[at]
        return np.add.reduceat(self.weights[at] * ratio, bounds[:-1]) / np.sqrt(np.add.reduceat(ratio**2, bounds[:-1]) + 1e-9) + self.bias

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -35, 35)))


def _sigmoid(margin: np.ndarray, labels: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Newton's method for a logistic line through margins, with Platt's smoothed labels."""
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    goal = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a = np.array([1.0, 0.0])
    x = np.stack([margin, np.ones(len(margin))], axis=1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -35, 35)))
        hessian = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-6 * np.eye(2)
        a = a - np.linalg.solve(hessian, x.T @ (p - goal))
    return float(a[0]), float(a[1])


def train(docs: DataFrame, labels: DataFrame) -> NBSVM | float:
    """The model, or the share of label 1 where there is only one class to learn from (0.5: none)."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 5, 0))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("label")).orderBy(F.xxhash64("doc_id")).limit(SAMPLE_DOCS)
    # at most SAMPLE_DOCS rows
    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("label", "text")
    # a doc_id may stand in many rows
    rows = sample.mapInArrow(_sparse, "label int, at binary").orderBy(F.xxhash64("at"), "label").limit(2 * SAMPLE_DOCS).collect()
    y = np.array([r["label"] for r in rows], np.int64)
    if len(np.unique(y)) < 2 or min(np.bincount(y)) < 5:
        return float(y.mean()) if len(y) else 0.5
    order = np.random.Generator(np.random.PCG64(1)).permutation(len(rows))
    return NBSVM.fit([bytes(rows[i]["at"]) for i in order], y[order])


def _score(model: NBSVM | float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if isinstance(model, float):
            score = np.full(len(batch), model)
        else:
            score = np.concatenate([*(model.probability(model.margins(*block)) for block in _blocks(batch.column("text"))), np.zeros(0)])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (doc_id, text).

    The model learns from labels (doc_id, quality) of documents that are not held out (crc32 of
    doc_id as text leaves 0 modulo 5); a document with several labels counts with the largest.
    Null and empty texts are scored like any text, by their length alone.  A null doc_id is
    neither learned from nor held out.  Without two classes to learn from, every score is the
    share of label 1, or 0.5.  Very long texts are read whole, one at a time.  Repeated rows get
    equal scores; other columns are ignored.  An empty table gives an empty result.
    """
    model = train(docs, labels)
    out = docs.select("doc_id", "text").mapInArrow(partial(_score, model), "doc_id bigint, score double")
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

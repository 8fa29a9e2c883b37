"""Language of a text by a small convolutional network over its bytes.

Bytes map to symbols (case folded, digits and punctuation merged).  Filters of several widths
slide over windows of ``WINDOW`` symbols; each filter's largest response in the window is a
feature; a linear layer and softmax over the features give the languages' probabilities.  The
network is trained here in numpy on a bounded sample of labelled windows.  A text's probabilities
are the mean over all its windows, weighted by their letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.textkit import slices

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
#: The training sample: at most so many documents of a language, in hashed order, two windows of
#: each, and of all languages together, which share it evenly; each has two at least.
DOCS_PER_LANGUAGE = 800
DOCS_OF_ALL = 40_000
UNKNOWN = "und"
#: The pipeline rejects documents with a score under so many times that of a guess.
LEAST_LIFT = 1.4

_B = np.arange(256)
_LETTER = ((_B >= 65) & (_B <= 90)) | ((_B >= 97) & (_B <= 122))
SYMBOL = np.select([_LETTER, (_B >= 48) & (_B <= 57), (_B == 32) | ((_B >= 9) & (_B <= 13)), _B < 128], [(_B | 32) - 95, 28, 1, 29], _B - 98).astype(np.int64)
N_SYMBOLS = 158


def held_out(key: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the key as text leaves this remainder; false for a null key."""
    return F.coalesce(F.crc32(key.cast("string")) % modulus == remainder, F.lit(False))


class ByteCNN:
    """filters[w]: (w, symbols, FILTERS); dense: (features + 1, classes)."""

    def __init__(self, classes: list[str], filters: dict[int, np.ndarray], dense: np.ndarray):
        self.classes, self.filters, self.dense = classes, filters, dense

    @classmethod
    def fit(cls, windows: np.ndarray, labels: np.ndarray, classes: list[str], epochs: int = 8, batch: int = 64, rate: float = 0.01, seed: int = 11) -> ByteCNN:
        """Adam on the cross-entropy of windows (n, WINDOW symbols) with labels (n)."""
        rng = np.random.Generator(np.random.PCG64(seed))
        params = {w: rng.normal(0, 0.1, (w, N_SYMBOLS, FILTERS)).astype(np.float32) for w in WIDTHS}
        params[0] = rng.normal(0, 0.1, (FILTERS * len(WIDTHS) + 1, len(classes))).astype(np.float32)
        first, second, step = {k: np.zeros_like(v) for k, v in params.items()}, {k: np.zeros_like(v) for k, v in params.items()}, 0
        weights = len(labels) / (len(classes) * np.maximum(np.bincount(labels, minlength=len(classes)), 1))
        for _ in range(epochs):
            for at in np.array_split(rng.permutation(len(labels)), max(1, len(labels) // batch)):
                x, y = windows[at], labels[at]
                features, places = [], []
                for w in WIDTHS:
                    response = sum(params[w][j][x[:, j : WINDOW - w + 1 + j]] for j in range(w))
                    places.append(response.argmax(axis=1))
                    features.append(np.take_along_axis(response, places[-1][:, None], 1)[:, 0])
                raw = np.concatenate(features, axis=1)
                hidden = np.concatenate([np.maximum(raw, 0), np.ones((len(at), 1), np.float32)], axis=1)
                scores = hidden @ params[0]
                p = np.exp(scores - scores.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(at)), y] -= 1
                p *= (weights[y] / len(at))[:, None].astype(np.float32)
                grads = {0: hidden.T @ p}
                back = (p @ params[0][:-1].T) * (raw > 0)
                for i, w in enumerate(WIDTHS):
                    own = back[:, i * FILTERS : (i + 1) * FILTERS]
                    grads[w] = np.zeros_like(params[w])
                    for j in range(w):
                        np.add.at(grads[w][j], (np.take_along_axis(x, places[i] + j, 1), np.arange(FILTERS)[None, :]), own)
                step += 1
                for k, g in grads.items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    params[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return cls(classes, {w: params[w] for w in WIDTHS}, params[0])

    def tables(self) -> tuple:
        """Responses to pairs of symbols, so that a width of 2 to 4 takes one or two look-ups."""
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(-1, FILTERS)
        two, three, four = (self.filters[w] for w in WIDTHS)
        return pair(two[0], two[1]), pair(three[0], three[1]), three[2], pair(four[0], four[1]), pair(four[2], four[3])

    def probabilities(self, windows: np.ndarray, block: int = 64) -> np.ndarray:
        t2, t3, t3c, t4a, t4b = self.tables()
        out = np.empty((len(windows), len(self.classes)), np.float32)
        for i in range(0, len(windows), block):
            x = windows[i : i + block]
            pairs = x[:, :-1] * N_SYMBOLS + x[:, 1:]
            three = t3.take(pairs[:, :-1], axis=0)
            three += t3c.take(x[:, 2:], axis=0)
            four = t4a.take(pairs[:, :-2], axis=0)
            four += t4b.take(pairs[:, 2:], axis=0)
            hidden = np.concatenate([t2.take(pairs, axis=0).max(axis=1), three.max(axis=1), four.max(axis=1)], axis=1)
            scores = np.maximum(hidden, 0) @ self.dense[:-1] + self.dense[-1]
            p = np.exp(scores - scores.max(axis=1, keepdims=True))
            out[i : i + block] = p / p.sum(axis=1, keepdims=True)
        return out


def text_windows(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the texts (n, WINDOW symbols; the last of each is padded) and each one's text."""
    sizes = np.diff(offsets)
    per_doc = np.maximum(-(-sizes // WINDOW), 1)
    first = np.cumsum(per_doc) - per_doc
    flat = np.zeros(int(per_doc.sum()) * WINDOW, np.int64)
    flat[np.arange(len(raw)) + np.repeat(first * WINDOW - offsets[:-1], sizes)] = SYMBOL[raw]
    return flat.reshape(-1, WINDOW), np.repeat(np.arange(len(sizes)), per_doc)


def _predict(model: ByteCNN, passed: list[str], text: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        best, score = [], []
        for first, end, raw, offsets in slices(batch.column(text)):
            windows, doc = text_windows(raw, offsets)
            letters = ((windows > 1) & (windows != 28) & (windows != 29)).sum(axis=1)
            p = model.probabilities(windows).astype(np.float64) * letters[:, None]
            total = np.zeros((end - first, p.shape[1]))
            np.add.at(total, doc, p)
            total /= np.maximum(np.bincount(doc, weights=letters, minlength=end - first), 1)[:, None]
            best.append(total.argmax(axis=1))
            score.append(total.max(axis=1))
        best, score = np.concatenate([*best, np.zeros(0, np.int64)]), np.concatenate([*score, np.zeros(0)])
        known = np.array(batch.column("__has_letter").to_pylist(), bool)
        names = [model.classes[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
        columns = [pa.array(names, pa.string()), pa.array(np.where(known, np.clip(score, 0, 1), 0.0))]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in passed), *columns], [*passed, "lang_pred", "score"])


def train(docs: DataFrame) -> ByteCNN | None:
    """The network for the languages of docs that may be learned from; None without any."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 4, 2))
    cut = lambda i: F.expr(f"substring(text, 1 + cast(pmod(xxhash64(doc_id, {i}), greatest(1, length(text) - {WINDOW})) as int), {WINDOW})")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not sizes:
        return None
    most = max(2, min(DOCS_PER_LANGUAGE, DOCS_OF_ALL // len(sizes)))
    # twice the wanted share of each language, by hash, so that the ranking below sees few rows
    share = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, int(2**20 * min(1.0, (2 * most + 8) / n)))))
    drawn = known.where(F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(2**20)) < F.try_element_at(share, F.col("lang")))
    ranked = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "texts")
    sample = drawn.select("doc_id", "lang", F.array(cut(0), cut(1)).alias("texts")).withColumn("__rank", F.row_number().over(ranked)).where(F.col("__rank") <= most)
    rows = sample.select("lang", F.explode("texts").alias("text")).orderBy("lang", "text").collect()
    if not rows:
        return None
    classes = sorted({r["lang"] for r in rows})
    pieces = [np.frombuffer(r["text"].encode()[:WINDOW], np.uint8) for r in rows]
    windows = np.zeros((len(rows), WINDOW), np.int64)
    for i, piece in enumerate(pieces):
        windows[i, : len(piece)] = SYMBOL[piece]
    return ByteCNN.fit(windows, np.array([classes.index(r["lang"]) for r in rows]), classes)


def predict(docs: DataFrame, model: ByteCNN | None, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` of docs with lang_pred and score, from the column ``text`` alone.

    Null text, or text without a letter, is UNKNOWN with the score 0, and so is every text when
    there was nothing to learn from.
    """
    if model is None:
        return docs.select(*keep, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    rows = docs.select(*keep, *([] if text in keep else [text]), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("__has_letter"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    return rows.mapInArrow(partial(_predict, model, keep, text), f"{fields}, lang_pred string, score double")


def language_digest(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs (doc_id, text, lang).

    The network learns from text and non-null lang of documents that are not held out (crc32 of
    doc_id as text leaves 2 modulo 4).  A null doc_id is neither learned from nor held out.
    Repeated rows get equal answers, and of equal probabilities the first language's name wins.
    Very long texts are read whole, one at a time.  Other columns are ignored; an empty table gives
    an empty result.
    """
    docs = docs.select("doc_id", "text", "lang")
    out = predict(docs, train(docs), ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")


def with_known_language(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose language is recognised: LEAST_LIFT times as sure as a guess.

    Null texts and texts without a letter go.  Where nothing could be learned, or one language
    alone, all other documents stay.
    """
    model = train(docs.select("doc_id", "text", "lang"))
    if model is None or len(model.classes) < 2:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    own = {c: f"__c{i}" for i, c in enumerate(docs.columns)}  # so that no column clashes with the answer's
    out = predict(docs.withColumnsRenamed(own), model, list(own.values()), own["text"])
    out = out.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min(1.0, LEAST_LIFT / len(model.classes))))
    return out.select(*(F.col(o).alias(c) for c, o in own.items()))

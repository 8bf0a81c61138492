"""Quality classifier: supervised subword embeddings.

Words, word pairs and character n-grams are hashed to rows of an embedding table; a document is the
mean of its rows, a linear layer and a softmax give the class.  Table and layer are trained by
stochastic gradient descent in numpy on a bounded sample.  For scoring, each row is multiplied by the
layer once, which leaves one number per hashed feature: a document's logit is the mean of its
features' numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.labels import ROWS_OF_CLASS, remainder, training_sample
from barloom.llm.tables import texts
from barloom.llm.textarrays import _coefficients, flat, mix, word_hashes, words
from barloom.llm.tokens import byte_balanced

BITS = 18
NGRAMS = (2, 4)
DIM = 12
EPOCHS = 8
RATE = 1.0
#: The second word of a pair that repeats the first is read as one word of its own.
REPEAT = np.uint64(0x5851F42D4C957F2D)
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def features(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashed features of each kind and, for each, how many come before each text (n + 1).

    Character n-grams are taken over the bytes of a text, spaces included.
    """
    shift = np.uint64(64 - BITS)
    out = []
    starts, ends, before = words(data, offsets)
    own = word_hashes(data, starts, ends)
    out.append(((mix(own) >> shift).astype(np.int32), before))
    if len(own) > 1:
        pair = mix(own[:-1] * np.uint64(3) + own[1:])
        pair[own[:-1] == own[1:]] = REPEAT
        pair = np.append(pair, np.uint64(0))  # of the last word, and pairs across texts, left out below
        last = before[1:][np.diff(before) > 0] - 1
        keep = np.ones(len(own), bool)
        keep[last] = False
        inner = np.concatenate([[0], np.cumsum(keep)])
        out.append(((pair[keep] >> shift).astype(np.int32), inner[before]))
    table = _coefficients(21)[data]
    for n in NGRAMS:
        if len(data) < n:
            continue
        gram = table[: len(data) - n + 1] * np.uint64(2 * n + 1)
        for k in range(1, n):
            gram = (gram ^ (gram >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + table[k: len(data) - n + 1 + k]
        keep = np.ones(len(gram), bool)
        for k in range(1, n):  # grams that reach into the next text
            at = offsets[1:-1] - k
            keep[at[(at >= 0) & (at < len(keep))]] = False
        inner = np.zeros(len(data) + 1, np.int64)
        inner[1:len(gram) + 1] = np.cumsum(keep)
        inner[len(gram) + 1:] = inner[len(gram)]
        out.append(((mix(gram[keep]) >> shift).astype(np.int32), inner[offsets]))
    return out


def fit(sample: list[tuple[str, int]], seed: int = 3) -> np.ndarray:
    """One number per hashed feature, and a bias at the end."""
    size = 1 << BITS
    rng = np.random.default_rng(seed)
    table = (rng.random((size, DIM), np.float32) - 0.5) / DIM
    layer = np.zeros((DIM, 2), np.float32)
    bias = np.zeros(2, np.float32)
    docs = []
    for text, y in sample:
        raw = np.frombuffer(text.encode(), np.uint8)
        found = [h for h, _ in features(raw, np.array([0, len(raw)]))]
        ids, counts = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int32), np.zeros(0))
        if len(ids):
            docs.append((ids, (counts / counts.sum()).astype(np.float32), y))
    steps, done = max(1, EPOCHS * len(docs)), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(docs)):
            ids, weight, y = docs[k]
            rate = RATE * (1 - done / steps)
            done += 1
            rows = table[ids]
            mean = weight @ rows
            logit = mean @ layer + bias
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[y] -= 1
            back = layer @ p
            layer -= rate * np.outer(mean, p)
            bias -= rate * p
            table[ids] = rows - rate * len(ids) ** 0.5 * weight[:, None] * back[None, :]
    toward = layer[:, 1] - layer[:, 0]
    return np.append(table @ toward, bias[1] - bias[0]).astype(np.float32)


def logits(model: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    total, count = np.zeros(n), np.zeros(n, np.int64)
    for ids, before in features(data, offsets):
        sums = np.concatenate([[0.0], np.cumsum(model[ids], dtype=np.float64)])
        total += sums[before[1:]] - sums[before[:-1]]
        count += np.diff(before)
    return total / np.maximum(count, 1) + float(model[-1])


def _probability(model: np.ndarray, column: pa.Array) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logits(model, *flat(column)), -30, 30)))


def _fitted(docs: DataFrame, labels: DataFrame, held_out: Column, rows: int):
    return docs.sparkSession.sparkContext.broadcast(fit(training_sample(docs, labels, "quality", ~held_out, rows)))


def _default_held_out() -> Column:
    return F.coalesce(remainder(3) == 1, F.lit(False))


def good(docs: DataFrame, labels: DataFrame, rows: int = ROWS_OF_CLASS) -> DataFrame:
    """The rows of ``docs`` whose score is 0.5 or more, with all their columns (see ``quality``)."""
    model = _fitted(docs, labels, _default_held_out(), rows)

    def keep(batches):
        for batch in batches:
            for part in byte_balanced(batch, "text", 1 << 20):
                yield part.filter(pa.array(_probability(model.value, part.column("text")) >= 0.5))

    return docs.mapInArrow(keep, docs.schema)


def quality(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, rows: int = ROWS_OF_CLASS) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs``.

    The model is fitted on at most ``rows`` labelled texts of each class that are not held out
    (``labels.training_sample``); without any, every score is 0.5.  Null and empty texts get the
    bias's score.  Repeated rows and null ids (never held out) are scored each, other columns are
    ignored, an empty table gives no rows.  Only the text enters the score.  Scoring is one pass
    without a shuffle; the model is 1 MB whatever the input.
    """
    held_out = held_out if held_out is not None else _default_held_out()
    model = _fitted(docs, labels, held_out, rows)

    def score(batches):
        for batch in batches:
            for part in byte_balanced(batch, "text", 1 << 20):
                p = _probability(model.value, part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    return texts(docs, held_out.alias("held_out")).mapInArrow(score, SCHEMA)

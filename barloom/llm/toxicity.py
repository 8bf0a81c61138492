"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text.  They share an ordinary
base, so that a difference comes only from what is particular to one class.  Every window of eight
words is compressed with both; the gain of the toxic dictionary, in bytes, summarised over a text's
windows, gives the score through thresholds that are calibrated on labelled texts the dictionaries
have not seen.

The particular text of a class is chosen by contrast: words that stand beside several times more
different words in that class.  Copies of one document add no neighbours, so they don't count twice.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.labels import ROWS_OF_CLASS, remainder, training_sample
from barloom.llm.tables import texts
from barloom.llm.tokens import byte_balanced

WINDOW = 8
BASE_BYTES = 8192
OWN_BYTES = 4096
CONTRAST = 8
LEAST_NEIGHBOURS = 6
MOST_SAMPLES = 20000
GAINS = (5, 6, 7, 8)
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
_APART = re.compile(r"[\W_]+")


@dataclass(frozen=True)
class Model:
    """Bytes of both dictionaries, and the calibration: centre, scale and weight of each feature and a bias."""

    ordinary: bytes
    toxic: bytes
    centre: tuple[float, ...]
    scale: tuple[float, ...]
    weight: tuple[float, ...]
    bias: float


def tokens(text: str | None) -> list[str]:
    return _APART.sub(" ", text.lower()).split() if text else []


def windows(words: list[str]) -> list[bytes]:
    return [f" {' '.join(words[i:i + WINDOW])} ".encode() for i in range(0, max(1, len(words)), WINDOW)]


@lru_cache(4)
def _compressor(content: bytes):
    import zstandard

    settings = zstandard.ZstdCompressionParameters.from_level(
        6, dict_size=1 << 14, source_size=64, strategy=zstandard.STRATEGY_LAZY2, min_match=6, search_log=8, hash_log=14,
        chain_log=14, window_log=15, write_checksum=False, write_content_size=False, write_dict_id=False,
    )
    own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    own.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(compression_params=settings, dict_data=own).compress


def gains(model: Model, words: list[str]) -> np.ndarray:
    """Bytes by which the toxic dictionary makes each window shorter than the ordinary one."""
    ordinary, toxic = _compressor(model.ordinary), _compressor(model.toxic)
    return np.array([len(ordinary(w)) - len(toxic(w)) for w in windows(words)])


def summary(gain: np.ndarray) -> list[float]:
    """Features of a text's windows."""
    top = np.sort(gain)[-3:]
    shares = [np.count_nonzero(gain >= g) for g in GAINS]
    return [float(top[-1]), float(top.mean()), float(gain.mean()), float(np.log(len(gain))), *(n / len(gain) for n in shares), *(float(np.log1p(n)) for n in shares)]


def _neighbours(texts_: list[list[str]]) -> Counter:
    return Counter(w for _, w in {(a, b) for words in texts_ for a, b in zip(["", *words], words)})


def _trained(samples: list[bytes], size: int, rng: np.random.Generator) -> bytes:
    """Content of a trained dictionary; the samples themselves where there are too few to train on."""
    import zstandard

    if len(samples) > MOST_SAMPLES:
        samples = [samples[i] for i in rng.permutation(len(samples))[:MOST_SAMPLES]]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


def fit(sample: list[tuple[str, int]], seed: int = 1) -> Model:
    """Dictionaries from two thirds of the sample, calibration from the last third."""
    rng = np.random.default_rng(seed)
    parsed = [(tokens(t), y) for t, y in sample]
    learn = [x for i, x in enumerate(parsed) if i % 3]
    toxic, ordinary = [w for w, y in learn if y], [w for w, y in learn if not y]
    near_t, near_o = _neighbours(toxic), _neighbours(ordinary)
    all_t, all_o = max(1, near_t.total()), max(1, near_o.total())
    least = LEAST_NEIGHBOURS
    chosen: set[str] = set()
    while least and not chosen:
        chosen = {w for w, n in near_t.items() if n >= least and n / all_t >= CONTRAST * (near_o[w] + 1) / all_o}
        least -= 1
    common = {w for w, n in near_o.items() if n >= 4 * LEAST_NEIGHBOURS} - chosen
    base = _trained([w for words in ordinary for w in windows(words)], BASE_BYTES, rng)
    own_t = _trained([f" {w} ".encode() for words in toxic for w in words if w in chosen], OWN_BYTES, rng)
    own_o = _trained([f" {w} ".encode() for words in ordinary for w in words if w in common], OWN_BYTES, rng)
    model = Model(base + own_o, base + own_t, (), (), (), 0.0)
    held = [x for i, x in enumerate(parsed) if i % 3 == 0]
    if not held or len({y for _, y in held}) < 2:
        return Model(model.ordinary, model.toxic, (0.0,), (1.0,), (0.5,), -3.0)
    x = np.array([summary(gains(model, words)) for words, _ in held])
    y = np.array([y for _, y in held], float)
    centre, scale = x.mean(0), x.std(0) + 1e-6
    x = np.c_[(x - centre) / scale, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), 0.3)
    ridge[-1] = 1e-6
    for _ in range(25):  # Newton steps of a penalised logistic fit
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
    return Model(model.ordinary, model.toxic, tuple(centre), tuple(scale), tuple(w[:-1]), float(w[-1]))


def score_text(model: Model, text: str | None) -> float:
    x = np.array(summary(gains(model, tokens(text))))[: len(model.weight)]
    z = float(((x - model.centre) / model.scale) @ np.array(model.weight)) + model.bias
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def toxicity(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, rows: int = ROWS_OF_CLASS) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs``.

    The model is fitted on at most ``rows`` labelled texts of each class that are not held out; without
    any, scores rest on empty dictionaries and a fixed threshold.  Null and empty texts are one empty
    window.  Repeated rows and null ids (never held out) are scored each, other columns are ignored, an
    empty table gives no rows.  Only the text enters the score.  One pass without a shuffle; the two
    dictionaries are 12 KB each whatever the input.
    """
    held_out = held_out if held_out is not None else F.coalesce(remainder(5) == 0, F.lit(False))
    model = docs.sparkSession.sparkContext.broadcast(fit(training_sample(docs, labels, "toxic", ~held_out, rows)))

    def run(batches):
        for batch in batches:
            for part in byte_balanced(batch, "text"):
                p = np.array([score_text(model.value, t) for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    return texts(docs, held_out.alias("held_out")).mapInArrow(run, SCHEMA)

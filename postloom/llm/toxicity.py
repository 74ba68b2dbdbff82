"""Toxicity by a linear classifier over character n-grams.

Each feature says whether an n-gram occurs, scaled by the n-gram's naive Bayes log-count ratio between toxic and other
training texts; logistic regression learns the weights of the scaled features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm import labelled
from postloom.llm.base import U64, characters, distinct, lean, shared, text_chunks, with_empty_text

ORDERS, BITS = (3, 4, 5, 6), 20
#: Features kept: those in at least MIN_TEXTS training texts, of the largest ratios; and the prior count of a ratio.
FEATURES, MIN_TEXTS, ALPHA = 3_000, 4, 1.0


@dataclass
class Model:
    """``index``: feature of each n-gram bucket, or -1; ``weights``: ratio times learned weight of each feature."""

    index: np.ndarray
    weights: np.ndarray
    bias: float


def buckets(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the bucket of the n-gram at each character, and which characters have one in their text."""
    points, at = characters(data, off)
    n = len(points)
    ends = np.repeat(at[1:], np.diff(at))
    code = np.zeros(n, U64)
    position = np.arange(n)
    for k in range(max(ORDERS)):
        code[: n - k] = code[: n - k] * U64(0x100000001B3) + points[k:] + U64(1)
        if k + 1 in ORDERS:
            yield ((code * U64(0x9E3779B97F4A7C15) + U64(k << 50)) * U64(0xD6E8FEB86659FD93)) >> U64(64 - BITS), position + k < ends


def occurrences(data: np.ndarray, off: np.ndarray, index: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs, each once; features are buckets if there is no ``index``."""
    _, at = characters(data, off, fold=False)
    text = np.repeat(np.arange(len(off) - 1), np.diff(at))
    keys = []
    for bucket, valid in buckets(data, off):
        if index is None:
            where, feature = np.flatnonzero(valid), bucket[valid].astype(np.int64)
        else:
            feature = index[bucket]
            where = np.flatnonzero((feature >= 0) & valid)
            feature = feature[where].astype(np.int64)
        keys.append((text[where] << BITS) | feature)
    both = distinct(np.concatenate(keys))
    return both >> BITS, both & ((1 << BITS) - 1)


def fit(texts: list[str], y: np.ndarray, prior: float, rounds: int = 150, penalty: float = 1.0) -> Model:
    """Learn from labelled texts; ``prior`` is the share of label 1 where the scores will be used."""
    y = np.asarray(y, float)
    index = np.full(1 << BITS, -1, np.int32)
    base = float(np.log(np.clip(prior, 1e-6, 1 - 1e-6) / np.clip(1 - prior, 1e-6, 1)))
    if len(texts) == 0 or y.min() == y.max():
        return Model(index, np.zeros(1, np.float32), base)
    array, seen = pa.array(texts, pa.string()), np.zeros((2, 1 << BITS))
    for i, _, data, off in text_chunks(array):
        row, feature = occurrences(data, off, None)
        for k in (0, 1):
            seen[k] += np.bincount(feature[y[row + i] == k], minlength=1 << BITS)
    share = (seen + ALPHA) / (seen + ALPHA).sum(1, keepdims=True)
    ratio = np.log(share[1] / share[0])
    usable = np.flatnonzero(seen.sum(0) >= MIN_TEXTS)
    kept = usable[np.argsort(-np.abs(ratio[usable]), kind="stable")[:FEATURES]]
    index[kept] = np.arange(len(kept))
    rows, cols = [], []
    for i, _, data, off in text_chunks(array):
        r, c = occurrences(data, off, index)
        rows.append(r + i)
        cols.append(c)
    rows, cols, r = np.concatenate(rows), np.concatenate(cols), ratio[kept]
    each = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    w, b = np.zeros(len(kept)), base
    step, squares, square = 0.5, np.full(len(kept), 1e-8), 1e-8
    for _ in range(rounds):  # AdaGrad over the whole sample
        z = np.bincount(rows, (w * r)[cols], len(y)) + b
        g = each * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        gw = np.bincount(cols, g[rows], len(kept)) * r / len(y) + penalty * w / len(y)
        squares += gw**2
        square += g.mean() ** 2
        w -= step * gw / np.sqrt(squares)
        b -= step * g.mean() / np.sqrt(square)
    return Model(index, (w * r).astype(np.float32), float(b))


def score_array(model: Model, array: pa.Array) -> np.ndarray:
    out = np.empty(len(array))
    for i, j, data, off in text_chunks(array):
        row, feature = occurrences(data, off, model.index)
        out[i:j] = np.bincount(row, model.weights[feature], j - i) + model.bias
    return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def _score(model):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = score_array(model.value, batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def score(docs: DataFrame, labels: DataFrame, *, per_label: int = labelled.PER_LABEL) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted of every document.

    Learned from a bounded sample (see ``labelled.sample``); whole texts are scored. Null and empty texts get the score
    of a text without n-grams. Without labels of both kinds every score is the share of label 1, or 0.5. Rows that
    repeat stay; a null id stays null and isn't held out; other columns are left out, whatever their names. Very long texts are whole;
    a task holds the n-grams of one block of texts, or of one longer text.
    """
    found = labelled.sample(docs, labels, "toxic", per_label=per_label)
    model = fit(found["text"].tolist(), found["y"].to_numpy(), labelled.prior(labels, "toxic"))
    rows = with_empty_text(docs, F.col("doc_id").cast("long").alias("doc_id"), labelled.held_out().alias("held_out"))
    return rows.mapInArrow(_score(shared(docs.sparkSession, model)), "doc_id long, held_out boolean, score double, predicted int")

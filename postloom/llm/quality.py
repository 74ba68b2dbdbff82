"""Quality by gradient-boosted trees over histograms of document statistics.

Statistics of whole texts are binned by their quantiles in the training sample; trees are grown on histograms of first
and second derivatives of the logistic loss, and kept as flat arrays that numpy walks for all texts of a block at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm import labelled
from postloom.llm.base import U64, lean, mix, shared, text_bytes, text_chunks, with_empty_text, word_hashes, words

BINS, TREES, DEPTH, RATE, LEAST = 64, 60, 4, 0.15, 10
THRESHOLD = 0.3

#: Classes of bytes: lower case, upper case, digit, blank, line feed, other control, sentence marks, other ASCII marks, lead bytes beyond ASCII, their followers.
CLASSES = 10


def _classes() -> np.ndarray:
    table = np.full(256, 7, np.uint8)
    table[:32] = 5
    table[[9, 32]] = 3
    table[[10, 13]] = 4
    table[48:58] = 2
    table[65:91] = 1
    table[97:123] = 0
    table[[ord(c) for c in ".,;:?'\"-()"]] = 6
    table[128:192] = 9
    table[192:] = 8
    return table


CLASS = _classes()
NAMES = ("log_chars", "log_words", "word_chars", "long_words", "lower", "upper", "digit", "blank", "line", "control", "sentence", "symbol", "beyond_ascii", "exclamation", "bar", "hash_percent", "distinct_words", "distinct_pairs", "same_as_last", "top_word", "words_a_line", "distinct_lines", "capital_words", "marked_words", "stop_ends", "word_deviation")


def _distinct(text: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each text and the most occurrences that one has."""
    order = np.lexsort((key, text))
    t, k = text[order], key[order]
    first = np.ones(len(t), bool)
    first[1:] = (t[1:] != t[:-1]) | (k[1:] != k[:-1])
    at = np.flatnonzero(first)
    runs = np.diff(np.append(at, len(t)))
    most = np.zeros(n, np.int64)
    np.maximum.at(most, t[at], runs)
    return np.bincount(t[at], minlength=n), most


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of NAMES for each text."""
    n = len(off) - 1
    text = np.repeat(np.arange(n), np.diff(off))
    kinds = np.bincount(text * CLASSES + CLASS[data], minlength=n * CLASSES).reshape(n, CLASSES).astype(float)
    chars = kinds.sum(1) - kinds[:, 9]
    some = np.maximum(chars, 1)

    def marks(which: str) -> np.ndarray:
        table = np.zeros(256, bool)
        table[[ord(c) for c in which]] = True
        return np.bincount(text[table[data]], minlength=n)

    starts, ends, first = words(data, off)
    count = np.diff(first)
    owner = np.repeat(np.arange(n), count)
    hashes = word_hashes(data, starts, ends)
    begun = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=begun[1:])
    size = begun[ends] - begun[starts]
    least = np.maximum(count, 1)
    by = lambda mask: np.bincount(owner[mask], minlength=n)
    mean = np.bincount(owner, size, n) / least
    deviation = np.sqrt(np.maximum(np.bincount(owner, size.astype(float) ** 2, n) / least - mean**2, 0))
    distinct, top = _distinct(owner, hashes, n)
    within = owner[1:] == owner[:-1] if len(owner) > 1 else np.zeros(0, bool)
    pairs = mix(hashes[:-1] * U64(3) + hashes[1:])[within] if len(owner) > 1 else np.zeros(0, U64)
    pair_owner = owner[1:][within] if len(owner) > 1 else np.zeros(0, np.int64)
    distinct_pairs, _ = _distinct(pair_owner, pairs, n)
    repeats = np.bincount(owner[1:][within & (hashes[1:] == hashes[:-1])], minlength=n) if len(owner) > 1 else np.zeros(n)
    # lines: the words' hashes summed between line feeds
    feeds = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data == 10, out=feeds[1:])
    line = feeds[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (line[1:] != line[:-1]) | (owner[1:] != owner[:-1])
    heads = np.flatnonzero(new)
    if len(heads):
        order = np.arange(len(starts)) - np.repeat(heads, np.diff(np.append(heads, len(starts))))
        sums = np.add.reduceat(mix(hashes + order.astype(U64)), heads)
        lines = np.bincount(owner[heads], minlength=n)
        distinct_lines, _ = _distinct(owner[heads], sums, n)
    else:
        lines = distinct_lines = np.zeros(n)
    capital, marked = CLASS[data[starts]] == 1, (CLASS[data[ends - 1]] == 7) if len(ends) else np.zeros(0, bool)
    stops = np.isin(data[ends - 1], [ord("."), ord("?"), ord("!")]) if len(ends) else np.zeros(0, bool)
    columns = [
        np.log1p(chars), np.log1p(count), mean, by(size > 12) / least, *(kinds[:, k] / some for k in range(9)), marks("!") / some, marks("|") / some, marks("#%$*&") / some,
        distinct / least, distinct_pairs / np.maximum(count - 1, 1), repeats / least, top / least, count / np.maximum(lines, 1), distinct_lines / np.maximum(lines, 1), by(capital) / least, by(marked) / least, by(stops) / least, deviation,
    ]
    return np.column_stack(columns)


@dataclass
class Trees:
    """Complete trees in heap order, flattened: ``feature`` and ``bound`` of inner nodes, ``value`` of leaves."""

    edges: np.ndarray
    feature: np.ndarray
    bound: np.ndarray
    value: np.ndarray
    bias: float


def grow(x: np.ndarray, y: np.ndarray, weight: np.ndarray, *, bins: int = BINS, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, least: float = LEAST) -> Trees:
    """Boosted trees for labels 0 and 1; ``least`` rows in a leaf, at least."""
    n, m = x.shape
    edges = np.quantile(x, np.arange(1, bins) / bins, axis=0).T if n else np.zeros((m, bins - 1))
    share = float(np.clip(np.average(y, weights=weight) if n else 0.5, 1e-4, 1 - 1e-4))
    bias, inner, leaves = float(np.log(share / (1 - share))), 2**depth - 1, 2**depth
    model = Trees(edges, np.zeros((trees, inner), np.int64), np.full((trees, inner), bins, np.int64), np.zeros((trees, leaves)), bias)
    if not n or y.min() == y.max():
        return model
    codes = binned(x, edges)
    flat = codes + np.arange(m) * bins
    z = np.full(n, bias)
    for t in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = weight * (y - p), weight * p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width = 2**level
            cell = (node[:, None] * (m * bins) + flat).ravel()
            total = [np.bincount(cell, np.repeat(v, m), width * m * bins).reshape(width, m, bins) for v in (g, h, np.ones(n))]
            (gl, hl, cl), (ga, ha, ca) = [np.cumsum(v, 2) for v in total], [v.sum(2, keepdims=True) for v in total]
            gain = gl**2 / (hl + 1) + (ga - gl) ** 2 / (ha - hl + 1) - ga**2 / (ha + 1)
            gain[(cl < least) | (ca - cl < least)] = 0
            best = gain.reshape(width, -1).argmax(1)
            good = gain.reshape(width, -1)[np.arange(width), best] > 1e-6
            at = slice(width - 1, 2 * width - 1)
            model.feature[t, at] = np.where(good, best // bins, 0)
            model.bound[t, at] = np.where(good, best % bins, bins)
            own = width - 1 + node
            node = 2 * node + (codes[np.arange(n), model.feature[t, own]] > model.bound[t, own])
        top = np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + 1)
        model.value[t] = rate * top
        z += model.value[t, node]
    return model


def binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)])


def walk(model: Trees, x: np.ndarray) -> np.ndarray:
    """Probability of label 1 for each row: all trees, a level at a time."""
    codes, depth = binned(x, model.edges), int(np.log2(model.value.shape[1]))
    z = np.full(len(x), model.bias)
    rows = np.arange(len(x))
    for feature, bound, value in zip(model.feature, model.bound, model.value, strict=True):
        node = np.zeros(len(x), np.int64)
        for _ in range(depth):
            node = 2 * node + 1 + (codes[rows, feature[node]] > bound[node])
        z += value[node - len(feature)]
    return 1 / (1 + np.exp(-z))


def fit(texts: list[str], y: np.ndarray, prior: float) -> Trees:
    x = [statistics(data, off) for *_, data, off in text_chunks(pa.array(texts, pa.string()))]
    y = np.asarray(y, float)
    weight = np.where(y == 1, prior / max(y.mean(), 1e-9), (1 - prior) / max(1 - y.mean(), 1e-9)) if len(y) else y
    return grow(np.concatenate(x) if x else np.zeros((0, len(NAMES))), y, weight)


def score_array(model: Trees, array: pa.Array) -> np.ndarray:
    out = np.empty(len(array))
    for i, j, data, off in text_chunks(array):
        out[i:j] = walk(model, statistics(data, off))
    return out


def _score(model, threshold: float):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index("text")
            score = score_array(model.value, batch.column(k))
            others = [(batch.schema.names[i], batch.column(i)) for i in range(batch.num_columns) if i != k]
            yield pa.RecordBatch.from_arrays([*(c for _, c in others), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[*(x for x, _ in others), "score", "predicted"])

    return run


def learn(docs: DataFrame, labels: DataFrame, *, per_label: int = labelled.PER_LABEL) -> Trees:
    """Trees from a bounded sample of labelled documents (see ``labelled.sample``)."""
    found = labelled.sample(docs, labels, "quality", per_label=per_label)
    return fit(found["text"].tolist(), found["y"].to_numpy(), labelled.prior(labels, "quality"))


def score(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, per_label: int = labelled.PER_LABEL) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher is better) and predicted (score at ``threshold`` or over) of every document.

    Whole texts are scored. Null and empty texts have statistics of zero and get their score. Without labels of both kinds
    every score is the share of label 1, or 0.5. Rows that repeat stay; a null id stays null and isn't held out; other
    columns are left out, whatever their names. Very long texts are whole; a task holds the words of one block of texts, or of one
    longer text.
    """
    model = shared(docs.sparkSession, learn(docs, labels, per_label=per_label))
    rows = with_empty_text(docs, F.col("doc_id").cast("long").alias("doc_id"), labelled.held_out().alias("held_out"))
    return rows.mapInArrow(_score(model, threshold), "doc_id long, held_out boolean, score double, predicted int")


def _keep_good(model, threshold: float):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            good = (score_array(model.value, text) >= threshold) & (np.diff(text_bytes(text)[1]) > 0)
            yield batch.filter(pa.array(good))

    return run


def keep_good(docs: DataFrame, model: Trees, *, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose whole text scores ``threshold`` or more, unchanged; null and empty texts go."""
    return docs.mapInArrow(_keep_good(shared(docs.sparkSession, model), threshold), docs.schema)

"""Quality classification with a factorisation machine.

Features of a whole text: its distinct words, hashed, with weight one over the
root of their number; statistics of its structure (signs, cases, repetition,
lines, words); and its length as metadata. The machine has a weight for each
feature and RANK latent factors for pairwise interactions, summed in time
linear in the features by half of (sum)^2 - sum of squares. Probabilities are a
logistic of that; it is fitted by gradient steps on batches of a bounded sample.

Defined results: null and empty texts are scored like any other, on features
that are all zero. Without labels of either kind every score is the share of
label 1 in the sample, or 0.5 without any. Equal texts have equal scores.
Columns other than id and text are not read, and stay as they are in keep().
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.llm.sampling import labelled_sample
from treeline.llm.textbatch import ALNUM, NOT_SPACE, Words, text_slices

#: Hashed words, latent factors, labelled texts in the sample, gradient steps, texts and size of a step, weight decay.
BUCKETS, RANK, SAMPLE, STEPS, BATCH, RATE, DECAY = 1 << 12, 8, 6_000, 400, 512, 0.03, 2e-4

_KINDS = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (32, 9, 11, 12), "line": (10, 13), "stop": b".,;:?",
    "bang": b"!", "bar": b"|", "hash": b"#$%&*~^=+<>", "quote": b"'\"`()[]{}", "slash": b"/\\_-@", "high": range(128, 256),
}
_CLASS = np.zeros(256, np.int64)
for _i, _bytes in enumerate(_KINDS.values()):
    _CLASS[list(_bytes)] = _i + 1
N_STATS = len(_KINDS) + 11


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(x, stats): word features and statistics, a row for each text."""
    rows = len(offsets) - 1
    row = np.repeat(np.arange(rows), np.diff(offsets))
    size = np.maximum(np.diff(offsets), 1).astype(np.float64)
    kinds = np.bincount(row * 16 + _CLASS[data], minlength=rows * 16).reshape(rows, 16)
    shares = kinds[:, 1 : len(_KINDS) + 1] / size[:, None]
    words = Words(data, offsets, ALNUM)
    h = words.hashes()
    bucket = (h >> np.uint64(52)).astype(np.int64)
    x = np.zeros((rows, BUCKETS), np.float32)
    x[words.row, bucket] = 1
    x /= np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
    length = (words.end - words.start).astype(np.float64)
    n = np.bincount(words.row, minlength=rows).astype(np.float64)
    least = np.maximum(n, 1)
    mean = np.bincount(words.row, weights=length, minlength=rows) / least
    square = np.bincount(words.row, weights=length**2, minlength=rows) / least
    pairs = np.sort(words.row.astype(np.uint64) << np.uint64(40) | h >> np.uint64(24))
    distinct = np.bincount((pairs[np.concatenate(([True], pairs[1:] != pairs[:-1]))] >> np.uint64(40)).astype(np.int64), minlength=rows) if len(pairs) else np.zeros(rows)
    first = data[words.start]
    capital = np.bincount(words.row, weights=(first >= 65) & (first < 91), minlength=rows) / least
    chunks = Words(data, offsets, NOT_SPACE)
    n_chunks = np.maximum(np.bincount(chunks.row, minlength=rows), 1)
    last = _CLASS[data[np.maximum(chunks.end - 1, 0)]] if len(chunks.end) else np.zeros(0, np.int64)
    odd_end = np.bincount(chunks.row, weights=(last == 7) | (last == 9), minlength=rows) / n_chunks
    lone = np.bincount(chunks.row, weights=(chunks.end - chunks.start == 1), minlength=rows) / n_chunks
    long = np.bincount(words.row, weights=length > 14, minlength=rows) / least
    lines = kinds[:, 5] + 1.0
    stats = np.column_stack([
        shares, np.log1p(size), np.log1p(n), mean, np.sqrt(np.maximum(square - mean**2, 0)), distinct / least, capital, odd_end, lone, long,
        np.log1p(size / lines), np.log1p(n / (kinds[:, 6] + 1.0)),
    ])
    stats[np.diff(offsets) == 0] = 0
    return x, stats.astype(np.float32)


@dataclass
class FactorisationMachine:
    """bias, weights and factors over BUCKETS + N_STATS features; statistics are centred and scaled first."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray

    def inputs(self, x: np.ndarray, stats: np.ndarray) -> np.ndarray:
        return np.concatenate((x, np.clip((stats - self.centre) / self.scale, -6, 6) * 0.3), axis=1, dtype=np.float32)

    def logits(self, z: np.ndarray) -> np.ndarray:
        pair = 0.5 * ((z @ self.factors) ** 2 - (z**2) @ (self.factors**2)).sum(1)
        return (self.bias + z @ self.weights + pair).astype(np.float64)

    def scores(self, x: np.ndarray, stats: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(self.inputs(x, stats)), -30, 30)))


def fit_arrays(bits: np.ndarray, stats: np.ndarray, y: np.ndarray, steps: int = STEPS) -> FactorisationMachine:
    """bits: packed presence of words, a row for each text. Steps go over batches of BATCH texts in a fixed shuffle."""
    rng = np.random.default_rng(13)
    width = BUCKETS + stats.shape[1]
    p = (float(y.sum()) + 1) / (len(y) + 2) if len(y) else 0.5
    centre = stats.mean(0) if len(y) else np.zeros(stats.shape[1], np.float32)
    scale = stats.std(0) + 1e-3 if len(y) else np.ones(stats.shape[1], np.float32)
    model = FactorisationMachine(float(np.log(p / (1 - p))), np.zeros(width, np.float32), np.zeros((width, RANK), np.float32), centre, scale)
    if not 0 < y.sum() < len(y):
        return model
    model.factors = rng.normal(0, 0.03, (width, RANK)).astype(np.float32)
    state = [[np.zeros_like(v), np.zeros_like(v)] for v in (model.weights, model.factors)]
    order = rng.permutation(len(y))
    at = 0
    for step in range(1, steps + 1):
        rows = order[at : at + BATCH]
        at = at + BATCH if at + BATCH < len(y) else 0
        x = np.unpackbits(bits[rows], axis=1).astype(np.float32)
        z = model.inputs(x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1)), stats[rows])
        squares = z**2
        s = z @ model.factors
        logit = model.bias + z @ model.weights + 0.5 * (s**2 - squares @ model.factors**2).sum(1)
        err = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[rows]) / len(rows)).astype(np.float32)
        grad_w = z.T @ err + DECAY * model.weights
        grad_v = z.T @ (err[:, None] * s) - model.factors * (squares.T @ err)[:, None] + DECAY * model.factors
        model.bias -= RATE * 4 * float(err.sum())
        for value, grad, moments in ((model.weights, grad_w, state[0]), (model.factors, grad_v, state[1])):
            moments[0] = 0.9 * moments[0] + 0.1 * grad
            moments[1] = 0.99 * moments[1] + 0.01 * grad**2
            value -= RATE * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-7)
    return model


def fit(docs: DataFrame, labels: DataFrame, fold: Column, label: str = "quality", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> FactorisationMachine:
    """Fits on about sample labelled rows of the fold, a condition on doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_slices(batches, "text", 1 << 18):
            x, stats = features(data, offsets)
            ids = [np.packbits(r > 0).tobytes() for r in x]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(ids, pa.binary()), pa.array([s.tobytes() for s in stats], pa.binary())], ["doc_id", "label", "bits", "stats"])

    sampled = labelled_sample(docs, labels, label, fold, sample, id_col, text_col)
    found = sampled.select("doc_id", "text", "label").mapInArrow(run, "doc_id long, label int, bits binary, stats binary").toArrow().sort_by([("doc_id", "ascending"), ("bits", "ascending")])
    bits = np.frombuffer(b"".join(found.column("bits").to_pylist()), np.uint8).reshape(found.num_rows, BUCKETS // 8)
    stats = np.frombuffer(b"".join(found.column("stats").to_pylist()), np.float32).reshape(found.num_rows, N_STATS)
    return fit_arrays(bits, stats, found.column("label").to_numpy().astype(np.float32))


def score(docs: DataFrame, model: FactorisationMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_slices(batches, "text", 1 << 18):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(sent.value.scores(*features(data, offsets)), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def keep(docs: DataFrame, model: FactorisationMachine, least: float, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose score is least or more."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_slices(batches, text_col, 1 << 18):
            yield rows.filter(pa.array(sent.value.scores(*features(data, offsets)) >= least))

    return docs.mapInArrow(run, docs.schema)

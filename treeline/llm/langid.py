"""Language identification by string kernels.

The kernel of two texts is the blended spectrum one on presence: how many byte
n-grams (1 to N of them, A-Z folded, hashed to 2**BITS buckets) both have, over
the geometric mean of how many each has. Nystroem features against landmark
texts make kernel ridge regression, one language against the rest, a product of
matrices; whole batches of texts are scored by two products.

Defined results: a null or empty text, or one without a letter, is `und` with
score 0. Without labelled rows every text is `und`. Equal texts have equal
results. Ties go to the language first in code point order. Rows with a null id
are scored like others. Columns other than id, text and the label are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.sampling import hashed_sample
from treeline.llm.textbatch import byte_ngrams, text_slices

#: n-grams of 1 to so many bytes, hashed to 2**BITS buckets.
NGRAM, BITS = 4, 14
#: The model is fitted on about so many labelled texts; landmarks are so many of them, dealt evenly over languages.
SAMPLE, LANDMARKS, RIDGE = 2_000, 64, 1e-3
#: Rows of each label in the sample, on average, if the label is rare.
LEAST_ROWS = 100
#: Scores are a softmax of the regressions' values at this sharpness.
SHARPNESS = 8.0

_LETTER = re.compile(r"[^\W\d_]")


def presence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row for each text: 1 in the buckets of its n-grams."""
    out = np.zeros((len(offsets) - 1, 1 << BITS), np.float32)
    for n in range(1, NGRAM + 1):
        row, bucket = byte_ngrams(data, offsets, n, BITS)
        out[row, bucket] = 1
    return out


@dataclass
class StringKernelModel:
    """langs in code point order; landmarks by bucket, scaled by their own norm; weights from kernel values to languages."""

    langs: list[str]
    landmarks: np.ndarray
    weights: np.ndarray

    def kernel(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.landmarks) / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))

    def scores(self, x: np.ndarray) -> np.ndarray:
        if len(self.langs) == 1:
            return np.ones((len(x), 1))
        z = SHARPNESS * (self.kernel(x).astype(np.float64) @ self.weights)
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def fit_arrays(x: np.ndarray, y: list[str], landmarks: int = LANDMARKS) -> StringKernelModel:
    """x: presence rows in any fixed order."""
    langs = sorted(set(y))
    by = {lang: [i for i, v in enumerate(y) if v == lang] for lang in langs}
    chosen: list[int] = []
    turn = 0
    while len(chosen) < min(landmarks, len(y)):
        chosen += [rows[turn] for rows in by.values() if turn < len(rows)]
        turn += 1
    marks = x[chosen[: max(landmarks, len(langs))]]
    model = StringKernelModel(langs, (marks / np.sqrt(np.maximum(marks.sum(1, keepdims=True), 1))).T.copy(), np.zeros((0, 0)))
    values, vectors = np.linalg.eigh(model.kernel(marks).astype(np.float64))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    phi = model.kernel(x).astype(np.float64) @ root
    target = np.array([[1.0 if v == lang else -1.0 for lang in langs] for v in y])
    ridge = np.linalg.solve(phi.T @ phi + RIDGE * len(y) * np.eye(phi.shape[1]), phi.T @ target)
    model.weights = root @ ridge
    return model


def fit(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> StringKernelModel | None:
    """Fits on about sample rows whose text and label are not null, and at least about LEAST_ROWS of each label (all if it has fewer); None if there are none."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = hashed_sample(rows, "id", sample, "lang", LEAST_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in text_slices(batches, "text", 1 << 18):
            bits = np.packbits(presence(data, offsets).astype(bool), axis=1)
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.string()), part.column(2), pa.array([b.tobytes() for b in bits], pa.binary())], ["id", "lang", "bits"])

    found = sorted(tuple(r) for r in rows.mapInArrow(run, "id string, lang string, bits binary").collect())
    if not found:
        return None
    x = np.unpackbits(np.frombuffer(b"".join(r[2] for r in found), np.uint8).reshape(len(found), -1), axis=1).astype(np.float32)
    return fit_arrays(x, [r[1] for r in found])


def predict(docs: DataFrame, model: StringKernelModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for rows, data, offsets in text_slices(batches, "text", 1 << 18):
            lettered = [bool(t and _LETTER.search(t)) for t in rows.column(1).to_pylist()]
            if own is None:
                langs, best = ["und"] * rows.num_rows, np.zeros(rows.num_rows)
            else:
                s = own.scores(presence(data, offsets))
                top = s.argmax(1)
                langs = [own.langs[i] if ok else "und" for i, ok in zip(top, lettered, strict=True)]
                best = np.where(lettered, s[np.arange(len(s)), top], 0.0)
            yield pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), pa.array(langs, pa.string()), pa.array(best, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")

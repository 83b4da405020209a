"""Toxicity scoring behind noisy-channel deobfuscation.

A token that mixes letters with look-alike signs, drags a letter out, or is a
letter of a spaced-out word opens a lattice: each sign offers the letters it may
stand for, each run of one letter offers one or two of it, and between the
letters of a spaced run a word may end and the next one begin. Viterbi decoding
under a character trigram model, plus a cost for each way of writing, picks the
restored words, however long the run is; inside a spaced run a word is either a
known one, at the cost of its count, or spelled by the character model. A token without such signs has a lattice of one path and passes
as it is. A logistic regression on presence of words and word beginnings then
scores the restored text, in a noisy-or with marks that are sure on their own.

The character model counts all texts and holds the most frequent trigrams and
words; the regression is fitted on a bounded sample of labelled texts; scoring
reads whole texts. Defined results: a null, empty or letterless
text has no features and gets the score of the bias alone. Without labels of
either kind each score is the share of label 1 in the sample, or 0 without any.
Equal texts have equal scores. Columns other than id and text are not read, and
stay as they are in keep().
"""

from __future__ import annotations

import math
import os
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.llm.sampling import labelled_sample
from treeline.llm.session import stored
from treeline.llm.textbatch import ALNUM, Words, text_slices

#: Labelled texts in the sample; hashed features; those selected; ridge.
SAMPLE, BITS, SELECTED, RIDGE = 12_000, 22, 1_024, 0.02
#: Steps of the regression, and their size; rows of the sample that are unpacked at once.
STEPS, RATE, BATCH = 150, 0.02, 2_048
#: A feature in such a share of toxic texts, that are such a share of its own texts by a lower bound, is a sure mark: one is enough.
SURE_FROM, SURE_SHARE = 0.04, 0.9
#: How many standard errors above zero a feature's log ratio stands to be selected.
LEAST_Z = 3.0
#: Lengths in bytes of word beginnings that are features besides whole words.
BEGINNINGS = (4, 5, 6)
#: Tokens that a worker remembers the restored form of; forgotten all at once, which changes no result.
REMEMBERED = 300_000

#: The letters that a sign may stand for.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i", "(": "c", "*": "abcdefghijklmnopqrstuvwxyz",
}
_SIGNS = re.escape("".join(LOOKS))
_EDGE = re.compile(r"^[^\w@$!|+€£¡(*]+|[^\w]+$")
_ODD = re.compile(rf"(?=.*[^\W\d_])(?=.*[{_SIGNS}])[^\W_{_SIGNS}]*(?:[{_SIGNS}]+[^\W_{_SIGNS}]*)+")
_DRAGGED = re.compile(r"([^\W\d_])\1\1")
_SPACED = re.compile(rf"(?<!\S)(?:[^\W_]|[{_SIGNS}])(?:[\s.\-_,*]{{1,2}}(?:[^\W\d_]|[{_SIGNS}])){{3,}}(?!\S)")
_INNER = re.compile(r"[.\-_,]")
_HIDDEN = re.compile("[​-‏⁠﻿­]")
#: What a word inside a spaced run costs for not being among the known ones.
SPELLED = 4.0
#: Most frequent trigrams and words that the character model holds; tokens that a task counts before it hands counts on.
GRAMS, WORDS, FLUSHED = 1 << 18, 1 << 15, 200_000
#: Steps of a lattice after which what all paths share is settled, so that long runs take time in proportion.
SETTLE = 64


@dataclass
class CharModel:
    """Trigram costs with back-off by interpolation; '^' opens a word and '$' closes it. Known words have counts of their own."""

    three: Counter = field(default_factory=Counter)
    two: Counter = field(default_factory=Counter)
    one: Counter = field(default_factory=Counter)
    words: Counter = field(default_factory=Counter)
    memo: dict = field(default_factory=dict)

    def add(self, word: str, n: int) -> None:
        w = f"^^{word}$"
        for i in range(2, len(w)):
            self.three[w[i - 2 : i + 1]] += n
            self.two[w[i - 2 : i]] += n
            self.one[w[i]] += n
        self.words[word] += n

    @cached_property
    def begun(self) -> frozenset:
        """Beginnings of known words."""
        return frozenset(w[:i] for w in self.words for i in range(1, len(w) + 1))

    @cached_property
    def total(self) -> int:
        return sum(self.one.values()) or 1

    @cached_property
    def said(self) -> int:
        return sum(self.words.values())

    def cost(self, context: str, char: str) -> float:
        key = context + char
        if key not in self.memo:
            base = (self.one[char] + 0.5) / (self.total + 64)
            self.memo[key] = -math.log((self.three[key] + 4 * base) / (self.two[context] + 4))
        return self.memo[key]


def lattice(token: str, spaced: bool = False) -> list[list[tuple[str, float]]]:
    """For each run of equal signs what it may stand for, and at what cost; a blank is a word boundary, open between all signs of a spaced run."""
    out: list[list[tuple[str, float]]] = []
    gap = [[("", 0.0), (" ", 0.0)]] if spaced else []
    i = 0
    while i < len(token):
        j = i
        while j < len(token) and token[j] == token[i]:
            j += 1
        run, c = j - i, token[i]
        letters = LOOKS.get(c, c)
        way = math.log(len(letters)) if c in LOOKS else 0.0
        if run == 1 or c == "*":
            out += ([[(x, way) for x in letters]] + gap) * run
        else:
            extra = (3.5, 0.0) if run == 2 else (0.0, 0.5)
            own = [(x, way + extra[0]) for x in letters] + [(x + x, way + extra[1]) for x in letters]
            if spaced:
                own += [(f"{x * m} {x * n}", way) for x in letters for m in (1, 2) for n in (1, 2) if m + n <= run]
            out += [own] + gap
        i = j
    return out[:-1] if spaced else out


def _moves(context: str, letters: str, model: CharModel) -> Iterator[tuple[str, float]]:
    """Where the letters lead, and what they cost. Contexts are the last two signs, or '=' and the beginning of a known word."""
    open_ = [(context, 0.0)]
    for x in letters:
        after = []
        for at, cost in open_:
            if x == " ":
                if (end := _closing(at, model)) is not None:
                    after += [("^^", cost + end + SPELLED), ("=", cost + end)]
            elif at[0] != "=":
                after.append((at[1] + x, cost + model.cost(at, x)))
            elif at[1:] + x in model.begun:
                after.append((at + x, cost))
        open_ = after
    yield from open_


def _closing(context: str, model: CharModel) -> float | None:
    """What closing a word costs; None for a beginning that is no word."""
    if context[0] != "=":
        return model.cost(context, "$")
    return math.log(model.said / n) if (n := model.words.get(context[1:], 0)) else None


def decode(token: str, model: CharModel, spaced: bool = False) -> str:
    """The cheapest words of the token's lattice; ties go to those first in code point order."""
    best: dict[str, tuple[float, str]] = {"^^": (SPELLED, ""), "=": (0.0, "")} if spaced else {"^^": (0.0, "")}
    settled: list[str] = []
    for n, choices in enumerate(lattice(token, spaced), 1):
        step: dict[str, tuple[float, str]] = {}
        for context, (cost, text) in best.items():
            for letters, way in choices:
                for at, more in _moves(context, letters, model):
                    found = (cost + way + more, text + letters)
                    if at not in step or found < step[at]:
                        step[at] = found
        best = step
        if n % SETTLE == 0:
            settled.append(os.path.commonprefix([text for _, text in best.values()]))
            best = {context: (cost, text[len(settled[-1]) :]) for context, (cost, text) in best.items()}
    ends = ((cost + end, text) for context, (cost, text) in best.items() if (end := _closing(context, model)) is not None)
    return "".join(settled) + min(ends)[1]


class Restorer:
    """Restores whole texts; remembers tokens."""

    def __init__(self, model: CharModel):
        self.model = model
        self.known: dict[str, str] = {}

    def token(self, token: str) -> str:
        core = _EDGE.sub("", token)
        if len(core) > 2 and not core.isnumeric():
            if "." in core or "-" in core or "_" in core or "," in core:
                parts = _INNER.split(core)
                if len(parts) > 3 and all(len(p) <= 1 for p in parts) and not (letters := "".join(parts)).isnumeric():
                    return decode(letters, self.model, spaced=True)
            if _ODD.fullmatch(core) or (_DRAGGED.search(core) and all(c in LOOKS or c.isalpha() for c in core)):
                return decode(core, self.model)
        return token

    def text(self, text: str) -> str:
        text = _HIDDEN.sub("", text.lower()) if not text.isascii() else text.lower()
        if _SPACED.search(text):
            text = _SPACED.sub(lambda m: decode(re.sub(r"[\s.\-_,]", "", m[0]), self.model, spaced=True), text)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, tokens = self.known, text.split()
        for t in {t for t in tokens if t not in known}:
            known[t] = self.token(t)
        out = " ".join([known[t] for t in tokens])
        return out


def feature_ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, id) of each word and each word beginning; ids of BITS bits."""
    words = Words(data, offsets, ALNUM)
    rows, ids = [words.row], [words.hashes()]
    for k in BEGINNINGS:
        long = words.end - words.start > k
        rows.append(words.row[long])
        ids.append(words.hash_spans(words.start[long], words.start[long] + k) + np.uint64(k))
    return np.concatenate(rows), (np.concatenate(ids) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int64)


def _buffers(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)


@dataclass
class ToxicityModel:
    chars: CharModel
    column: np.ndarray
    weights: np.ndarray
    bias: float
    doubt: np.ndarray

    def scores(self, texts: list[str], restorer: Restorer) -> np.ndarray:
        row, ids = feature_ids(*_buffers([restorer.text(t) for t in texts]))
        column = self.column[ids]
        z = np.zeros((len(texts), len(self.weights) + 1), np.float32)
        z[row, column] = 1  # the last column takes what is not selected
        z = z[:, :-1].astype(np.float64)
        regression = 1 / (1 + np.exp(-np.clip(self.bias + z @ self.weights, -30, 30)))
        return 1 - (1 - regression) * np.exp(z @ np.log(self.doubt))


def fit_arrays(rows: list[np.ndarray], y: np.ndarray, chars: CharModel) -> ToxicityModel:
    """rows: the distinct feature ids of each text; texts with the same ones count once."""
    first = {(hash(r.tobytes()), int(v)): i for i, (r, v) in reversed([*enumerate(zip(rows, y, strict=True))])}
    own = sorted(first.values())
    rows, y = [rows[i] for i in own], y[own]
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    none = ToxicityModel(chars, np.zeros(1 << BITS, np.int16), np.zeros(0), -30.0 if not len(y) else math.log((n1 + 1e-3) / (n0 + 1e-3)), np.ones(0))
    if not n1 or not n0:
        return none
    toxic, clean = np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.int32)
    for r, v in zip(rows, y, strict=True):
        (toxic if v else clean)[r] += 1
    # what marks a text as toxic counts; nothing that a toxic text may hold besides makes it clean
    marks = np.flatnonzero(toxic >= 3)
    a, b = (toxic[marks] + 0.5) / (n1 + 1), (clean[marks] + 0.5) / (n0 + 1)
    z = np.log(a / b) / np.sqrt(1 / (toxic[marks] + 0.5) + 1 / (clean[marks] + 0.5))
    chosen = np.sort(marks[np.argsort(-z, kind="stable")[: min(SELECTED, int((z >= LEAST_Z).sum()))]])
    toxic, clean = toxic[chosen], clean[chosen]
    column = np.full(1 << BITS, len(chosen), np.int16)
    column[chosen] = np.arange(len(chosen))
    packed = np.zeros((len(rows), -(-len(chosen) // 8)), np.uint8)
    for i, r in enumerate(rows):
        own = np.zeros(len(chosen) + 1, np.uint8)
        own[column[r]] = 1
        packed[i] = np.packbits(own[:-1])
    # from half the log ratios, smoothed so that rare marks alone do not suffice, to a regression
    w = (0.5 * np.log((toxic + 0.5) / (n1 + 1) / ((clean + 3) / (n0 + 6)))).astype(np.float32)
    bias, target = math.log(n1 / n0), y.astype(np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        grad, off = RIDGE / len(y) * 10 * w, 0.0
        for at in range(0, len(y), BATCH):
            x = np.unpackbits(packed[at : at + BATCH], axis=1, count=len(chosen)).astype(np.float32)
            p = 1 / (1 + np.exp(-np.clip(bias + x @ w, -30, 30)))
            err = (p - target[at : at + BATCH]) / len(y)
            grad = grad + x.T @ err
            off += float(err.sum())
        bias -= 20 * RATE * off
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    n, share = toxic + clean, toxic / (toxic + clean)
    sure = (share + 2 / n - 2 * np.sqrt(share * (1 - share) / n + 1 / n**2)) / (1 + 4 / n)  # Wilson's lower bound at two standard errors
    doubt = np.where((toxic >= max(8, SURE_FROM * n1)) & (sure >= SURE_SHARE), 1 - sure, 1.0)
    return ToxicityModel(chars, column, w.astype(np.float64), bias, doubt)


def char_model(texts: DataFrame, text_col: str = "text") -> CharModel:
    """Counts of all texts. The model holds the most frequent trigrams and words; its other counts are of all of them."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> pa.RecordBatch:
            found: Counter = Counter()
            for token, n in tokens.items():
                if (w := _EDGE.sub("", token)).isalpha() and not _DRAGGED.search(w):
                    found[w] += n
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

        tokens: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                tokens.update((text or "").lower().split())
                if len(tokens) > FLUSHED:
                    yield counted()
                    tokens.clear()
        yield counted()

    def trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = CharModel()
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own.add(word, n)
            yield pa.RecordBatch.from_arrays([pa.array(list(own.three), pa.string()), pa.array(list(own.three.values()), pa.int64())], ["gram", "n"])

    said = stored(texts.select(F.col(text_col).alias("text")).mapInArrow(words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    grams = stored(said.mapInArrow(trigrams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    kept = grams.orderBy(F.desc("n"), "gram").limit(GRAMS).withColumn("context", F.substring("gram", 1, 2))
    contexts = grams.groupBy(F.substring("gram", 1, 2).alias("context")).agg(F.sum("n").alias("of"))
    chars = CharModel()
    for gram, n, of in sorted(tuple(r) for r in kept.join(contexts, "context").select("gram", "n", "of").collect()):
        chars.three[gram], chars.two[gram[:2]] = n, of
    for char, n in sorted(tuple(r) for r in grams.groupBy(F.substring("gram", 3, 1).alias("char")).agg(F.sum("n")).collect()):
        chars.one[char] = n
    for word, n in sorted(tuple(r) for r in said.orderBy(F.desc("n"), "word").limit(WORDS).collect()):
        chars.words[word] = n
    return chars


def fit(docs: DataFrame, labels: DataFrame, fold: Column, label: str = "toxic", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Fits on about sample labelled rows of the fold, a condition on doc_id."""
    sampled = labelled_sample(docs, labels, label, fold, sample, id_col, text_col).select("doc_id", "text", "label")

    chars = char_model(docs, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(chars)

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(sent.value)
        for rows, _, _ in text_slices(batches, "text", 1 << 18):
            row, found = feature_ids(*_buffers([restorer.text(t or "") for t in rows.column(1).to_pylist()]))
            own = [np.unique(found[row == i]).astype(np.int32).tobytes() for i in range(rows.num_rows)]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(own, pa.binary())], ["doc_id", "label", "ids"])

    found = sampled.mapInArrow(ids, "doc_id long, label int, ids binary").toArrow().sort_by([("doc_id", "ascending"), ("ids", "ascending")])
    return fit_arrays([np.frombuffer(r.as_buffer(), np.int32) for r in found.column("ids")], found.column("label").to_numpy().astype(np.int64), chars)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(sent.value.chars)
        for rows, _, _ in text_slices(batches, "text", 1 << 18):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(sent.value.scores([t or "" for t in rows.column(1).to_pylist()], restorer), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def keep(docs: DataFrame, model: ToxicityModel, below: float, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose score is below the bound."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(sent.value.chars)
        for rows, _, _ in text_slices(batches, text_col, 1 << 18):
            texts = rows.column(rows.schema.get_field_index(text_col)).to_pylist()
            yield rows.filter(pa.array(sent.value.scores([t or "" for t in texts], restorer) < below))

    return docs.mapInArrow(run, docs.schema)

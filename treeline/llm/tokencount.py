"""Token counts of fields and sections by offset-mapped attribution.

A whole document is encoded once; cumulated byte lengths of its tokens map each
token to a span of characters, and an interval join of token spans with section
spans (two binary searches, as both are sorted) counts the tokens of each
section. A token that crosses a boundary goes by an explicit rule: to the
section with its first character, its last one, most of its bytes (the first
of equals), or in fractions to all of them by bytes.

Defined results: a null or empty text has one section without characters or
tokens. Fields are laid out one behind the other in the order given, null ones
empty, and a token may cross from one to the next. Columns other than those
named are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = ("first", "last", "most", "fraction")


class OffsetEncoder:
    """Byte-level encoder of a rank file, with the byte length of each token."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)

    def ends(self, text: str) -> np.ndarray:
        """Byte offset behind each token of the text."""
        ids = self.encoding.encode_to_numpy(text, disallowed_special=()) if text else np.zeros(0, np.uint32)
        return np.cumsum(self.sizes[ids])


_ENCODERS: dict[tuple[str, str], OffsetEncoder] = {}


def encoder(path: str, pattern: str) -> OffsetEncoder:
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = OffsetEncoder(path, pattern)
    return _ENCODERS[path, pattern]


def attribute(ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing) of each section: bounds are byte offsets, one more than sections, from 0 to the text's size.

    crossing counts the tokens of the section that have bytes of another one, by the rule's choice.
    """
    n = len(bounds) - 1
    if not len(ends):
        return np.zeros(n), np.zeros(n, np.int64)
    starts = np.concatenate(([0], ends[:-1]))
    first = np.searchsorted(bounds, starts, "right") - 1
    last = np.searchsorted(bounds, ends, "left") - 1
    crosses = first != last
    if rule == "first":
        own = first
    elif rule == "last":
        own = last
    else:
        own = first.copy()
        share = np.zeros(n)
        for t in np.flatnonzero(crosses):
            s = np.arange(first[t], last[t] + 1)
            part = np.minimum(bounds[s + 1], ends[t]) - np.maximum(bounds[s], starts[t])
            own[t] = s[np.argmax(part)]
            if rule == "fraction":
                share[s] += part / (ends[t] - starts[t])
        if rule == "fraction":
            return np.bincount(first[~crosses], minlength=n) + share, np.bincount(own[crosses], minlength=n)
    return np.bincount(own, minlength=n).astype(np.float64), np.bincount(own[crosses], minlength=n)


_OUT = "doc_id long, section int, start long, end long, n_tokens double, n_crossing long, doc_tokens long"


def _char_offsets(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    starts = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return starts[at]


def _batch(rows: list[tuple[int | None, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]) -> pa.RecordBatch:
    counts = [len(r[2]) for r in rows]
    doc = pa.array(np.repeat(np.arange(len(rows)), counts))
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()).take(doc), pa.array(np.concatenate([np.arange(c) for c in counts]).astype(np.int32)),
         pa.array(np.concatenate([r[1][:-1] for r in rows])), pa.array(np.concatenate([r[1][1:] for r in rows])), pa.array(np.concatenate([r[2] for r in rows])),
         pa.array(np.concatenate([r[3] for r in rows]).astype(np.int64)), pa.array(np.repeat([r[5] for r in rows], counts))],
        ["doc_id", "section", "start", "end", "n_tokens", "n_crossing", "doc_tokens"],
    )


def section_counts(docs: DataFrame, ranks: str, pattern: str, rule: str = "first", separator: str = "\n", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per section: doc_id, section (from 0), start, end (code points), n_tokens, n_crossing, doc_tokens.

    A section ends behind each separator sign, and at the text's end.
    """
    if rule not in RULES or len(separator.encode()) != 1:
        raise ValueError(f"rule is one of {RULES}, the separator one ASCII sign")
    sign = ord(separator)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks, pattern)
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                batch, out = whole.slice(i, 256), []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    raw = np.frombuffer((text or "").encode(), np.uint8)
                    cuts = np.flatnonzero(raw == sign) + 1
                    bounds = np.concatenate(([0], cuts[cuts < len(raw)], [len(raw)]))
                    ends = enc.ends(text or "")
                    tokens, crossing = attribute(ends, bounds, rule)
                    out.append((doc, _char_offsets(raw, bounds), tokens, crossing, bounds, len(ends)))
                yield _batch(out)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _OUT)


def field_counts(docs: DataFrame, fields: Sequence[str], ranks: str, pattern: str, rule: str = "first", id_col: str = "doc_id") -> DataFrame:
    """As section_counts(), where section k is the k-th field of the row, all encoded as one text."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks, pattern)
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                batch, out = whole.slice(i, 256), []
                for doc, *texts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    parts = [(t or "").encode() for t in texts]
                    raw = np.frombuffer(b"".join(parts), np.uint8)
                    bounds = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
                    ends = enc.ends(b"".join(parts).decode())
                    tokens, crossing = attribute(ends, bounds, rule)
                    out.append((doc, _char_offsets(raw, bounds), tokens, crossing, bounds, len(ends)))
                yield _batch(out)

    chosen = [F.col(f).cast("string").alias(f"f{k}") for k, f in enumerate(fields)]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), *chosen).mapInArrow(run, _OUT)

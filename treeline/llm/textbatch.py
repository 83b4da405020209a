"""Vectorised text primitives over Arrow batches.

Every function here looks at whole texts. A null text counts as an empty one.
Batches are cut into slices of bounded bytes, so that the numpy arrays of one
slice stay small however many rows Spark puts into a batch.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes and rows of a slice at most; a text that has more bytes is a slice by itself.
SLICE_BYTES, SLICE_ROWS = 1 << 18, 1_024

_M64 = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on arrays of uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of each at least."""
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 2 * SLICE_BYTES)
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _POWERS[name] = np.multiply.accumulate(row)
        if n > 2 * SLICE_BYTES:  # do not keep what one giant text needed
            return _POWERS.pop("up"), _POWERS.pop("down")
    return _POWERS["up"], _POWERS["down"]


#: A value for each byte; A-Z have those of a-z.
_BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
_BYTE_VALUE = _BYTE_VALUE[FOLD]

#: Word bytes when words are parted by ASCII white space only.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, *range(9, 14)]] = False
#: Word bytes when words are ASCII letters, digits and whatever is not ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def text_slices(batches: Iterable[pa.RecordBatch], column: str, max_bytes: int = SLICE_BYTES, max_rows: int = SLICE_ROWS) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets): slices of the batches with the UTF-8 bytes of a text column.

    A slice has one row at least, max_rows at most, and no more bytes than max_bytes unless one text alone has more.
    """
    for batch in batches:
        texts = pc.fill_null(batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary()), b"")
        if len(texts) == 0:
            continue
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
        data = texts.buffers()[2]
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        at = 0
        while at < len(texts):
            to = max(at + 1, min(at + max_rows, int(np.searchsorted(offsets, offsets[at] + max_bytes, "right")) - 1))
            own = offsets[at : to + 1]
            yield batch.slice(at, to - at), data[own[0] : own[-1]], own - own[0]
            at = to


class Words:
    """The words of the texts of one slice: row, start and end of each, and hashes of spans."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray = NOT_SPACE):
        self.data, self.offsets = data, offsets
        inside = word_bytes[data]
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        before = np.empty(len(data), bool)
        before[:1] = False
        before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | first[:-1]))
        after = np.empty(len(data), bool)
        after[-1:] = False
        after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (~after | first[1:])) + 1
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        self._sums: np.ndarray | None = None

    def hash_spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """uint64 of each span's bytes, A-Z folded; equal spans have equal hashes."""
        up, down = _powers(len(self.data) + 1)
        if self._sums is None:
            self._sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_BYTE_VALUE[self.data] * up[: len(self.data)], out=self._sums[1:])
        return mix64((self._sums[end] - self._sums[start]) * down[start] + (end - start).astype(np.uint64))

    def hashes(self) -> np.ndarray:
        return self.hash_spans(self.start, self.end)


_PLACE = mix64(np.arange(11, 75, dtype=np.uint64)) | np.uint64(1)


def shingles(words: Words, n_rows: int, k: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles; of fewer words, the whole sequence is one."""
    if not 1 <= k <= len(_PLACE):
        raise ValueError(f"shingles of 1 to {len(_PLACE)} words")
    h, row = words.hashes(), words.row
    bounds = np.searchsorted(row, np.arange(n_rows + 1))
    n = max(len(h) - k + 1, 0)
    whole = np.zeros(n, np.uint64)
    for i in range(k):
        whole += h[i : i + n] * _PLACE[i]
    whole = mix64(whole)
    out = []
    for r in range(n_rows):
        a, b = int(bounds[r]), int(bounds[r + 1])
        if b - a >= k:
            own = np.sort(whole[a : b - k + 1])
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        elif b > a:
            short = np.zeros(1, np.uint64)
            for i in range(b - a):
                short += h[a + i : a + i + 1] * _PLACE[i]
            out.append(mix64(short + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def byte_ngrams(data: np.ndarray, offsets: np.ndarray, n: int, bits: int, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each byte n-gram that lies within one row, n up to 8, buckets of so many bits."""
    if len(data) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    folded = FOLD[data] if fold else data
    gram = np.zeros(len(data) - n + 1, np.uint64)
    for i in range(n):
        gram = (gram << np.uint64(8)) | folded[i : len(folded) - n + 1 + i]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    same = row[: len(gram)] == row[n - 1 :]
    bucket = ((gram * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n * 0xD1B54A32D192ED03 & _M64)) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits)
    return row[: len(gram)][same], bucket[same].astype(np.int64)

"""SentencePiece encoding and decoding over a trie of distinct marked words.

Text is normalised as the model says (a blank becomes the word mark, one mark
goes in front) and cut into marked words, which no piece crosses. The distinct
words of a batch are sorted, which lays them out as a trie in depth-first order;
a forward pass keeps, for each prefix, its best last piece, and reuses those of
the prefix that a word shares with the one before.

The model at hand is a byte-pair one: a plain Viterbi over its scores, which are
merge ranks, does not give its encoding. The forward state is therefore exact
for merges: the last piece of a prefix's encoding is the one piece that fits
behind the encoding of what is before it, where two pieces fit if encoding their
text gives back just the two. Signs without a piece stay whole and become byte
pieces. Tests hold results against the sentencepiece library.

Defined results: null and empty texts have no ids. Ids of bytes that are no
UTF-8 decode to replacement signs. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Words and pairs that a worker remembers; forgotten all at once, which changes no result.
REMEMBERED, PAIRS = 300_000, 2_000_000

_WORD = re.compile(f"\n|{MARK}{MARK}+[^{MARK}]*|{MARK}?[^{MARK}\n]+|{MARK}")


class PieceEncoder:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or model.trainer_spec.model_type != 2:
            raise ValueError("only byte-pair models with an identity normaliser")
        if any(MARK in p.piece.lstrip(MARK) for p in model.pieces):
            raise ValueError("a piece crosses words")
        self.prefix = MARK if spec.add_dummy_prefix else ""
        self.score = {p.piece: p.score for p in model.pieces if p.type in (1, 4)}
        self.id = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (1, 4)}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == 2)
        self.raw = [bytes([int(p.piece[3:5], 16)]) if p.type == 6 else b"" if p.type == 3 else " ⁇ ".encode() if p.type == 2 else p.piece.encode() for p in model.pieces]
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece in self.id:
            if self.merge(piece) == [piece]:
                self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.fits: dict[tuple[str, str], bool] = {}
        self.known: dict[str, bytes] = {}

    def merge(self, word: str) -> list[str]:
        """The pieces of a word by merging, always the best pair, the leftmost of equals."""
        import heapq

        part, left, right = list(word), [*range(-1, len(word) - 1)], [*range(1, len(word)), -1]
        heap = [(-s, i, part[i] + part[i + 1]) for i in range(len(word) - 1) if (s := self.score.get(part[i] + part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = right[i]
            if j < 0 or part[i] + part[j] != both or not part[i]:
                continue
            part[i], part[j] = both, ""
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b >= 0 and (s := self.score.get(part[a] + part[b])) is not None:
                    heapq.heappush(heap, (-s, a, part[a] + part[b]))
        return [p for p in part if p]

    def ids(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            i = self.id.get(p)
            if i is not None:
                out.append(i)
            elif self.byte:
                out += [self.byte[b] for b in p.encode()]
            else:
                out.append(self.unknown)
        return out

    def learn(self, words: list[str]) -> None:
        """Encodes words: one forward pass over their trie, in order, on a stack of prefix states."""
        if len(self.fits) > PAIRS:
            self.fits.clear()
        fits, id_of, matches = self.fits, self.id, self.automaton.iter
        last: list[str] = [""]  # last[i]: last piece of the encoding of the first i signs of the word
        before = ""
        for word in sorted(words):
            shared = 0
            for a, b in zip(word, before, strict=False):
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :]
            ends: list[list[str]] = [[] for _ in range(len(word) - shared)]
            for end, piece in matches(word):
                if end >= shared:
                    ends[end - shared].append(piece)
            for end, found in enumerate(ends, shared + 1):
                best = ""
                for piece in found:
                    prior = last[end - len(piece)]
                    if not prior:
                        if end == len(piece):
                            best = piece
                            break
                        continue
                    pair = (prior, piece)
                    ok = fits.get(pair)
                    if ok is None:
                        ok = fits[pair] = self.merge(prior + piece) == [prior, piece]
                    if ok:
                        best = piece
                        break
                last.append(best or word[end - 1])
            before = word
            out, at = [], len(word)
            while at:
                out.append(last[at])
                at -= len(last[at])
            out.reverse()
            try:
                self.known[word] = np.array([id_of[p] for p in out], "<u4").tobytes()
            except KeyError:
                self.known[word] = np.array(self.ids(out), "<u4").tobytes()

    def words(self, text: str) -> list[str]:
        return _WORD.findall(self.prefix + text.replace(" ", MARK)) if text else []

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, as little-endian uint32 bytes."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        cut = [self.words(t) for t in texts]
        known = self.known
        fresh = {w for words in cut for w in words if w not in known}
        self.learn(list(fresh))
        get = known.__getitem__
        out = [b"".join(map(get, words)) for words in cut]
        for w in fresh:
            if len(w) > 64:
                del known[w]
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids: word marks become blanks, and the one in front goes."""
        text = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids: the ids of each row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                batch = whole.slice(i, 256)
                rows = [np.frombuffer(b, "<u4").astype(np.int32) for b in enc.encode([t or "" for t in batch.column(1).to_pylist()])]
                offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, np.concatenate(rows))], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text, n_tokens, ids_crc32 (unsigned, of little-endian unsigned 32-bit ids); null ids are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                batch = whole.slice(i, 256)
                raw = [np.asarray(v if v is not None else [], "<u4").tobytes() for v in (x.values.to_numpy() if x.is_valid else None for x in batch.column(1))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([enc.decode(r) for r in raw], pa.string()), pa.array([len(r) // 4 for r in raw], pa.int64()), pa.array([zlib.crc32(r) for r in raw], pa.int64())],
                    ["doc_id", "text", "n_tokens", "ids_crc32"],
                )

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string, n_tokens long, ids_crc32 long")

"""Fast exact encoding with a word-end BPE file of the tokenizers library.

Such a tokenizer normalises (NFC, lower case), drops white space, splits into
letter runs, single digits and runs of other signs, and merges each with an
end-of-word mark behind it. So the ids of a text are those of its chunks between
blanks, and a worker remembers chunks. New chunks of plain Latin signs go
through one call of a byte-pair encoder with the same merges, whose word-end
mark is a letter that lower-cased text cannot hold; all others go through the
tokenizers library itself. Tests hold both against encode() of whole texts.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata

import numpy as np

#: Chunks that a worker remembers the ids of; they are forgotten all at once, which changes no result.
REMEMBERED = 400_000

_SIGNS = [chr(c) for c in (*range(0x21, 0x7F), *range(0xA1, 0x180)) if chr(c).lower() == chr(c)]
_CLASS = {k: "".join(re.escape(c) for c in _SIGNS if unicodedata.category(c)[0] == k) for k in "LN"}
_PLAIN = re.compile("[\x21-\x7e\xa1-įı-ňŊ-ſ]+")
_PARTS = re.compile(rf"('s|'t|'re|'ve|'m|'ll|'d|[{_CLASS['L']}]+|[{_CLASS['N']}]|[^{_CLASS['L']}{_CLASS['N']}]+)")
_END, _GAP = "Z", "Y"  # capitals: no lower-cased text holds them


class ChunkEncoder:
    """Ids of whole texts, as little-endian uint32 bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        model = json.load(open(path, encoding="utf-8"))["model"]
        signs = {self._sign(b): b for b in range(256)}

        def raw(token: str) -> bytes:
            end = token.endswith("</w>") and len(token) > 4
            return bytes(signs[c] for c in (token[:-4] if end else token)) + (_END.encode() if end else b"")

        ranks = {bytes([b]): b for b in range(256)}
        for b in range(256):
            ranks[bytes([b]) + _END.encode()] = 256 + b
        for n, pair in enumerate(model["merges"]):
            ranks[raw("".join(pair) if isinstance(pair, list) else pair.replace(" ", ""))] = 512 + n
        ids = np.zeros(512 + len(model["merges"]), np.uint32)
        for token, i in model["vocab"].items():
            if (r := ranks.get(raw(token))) is not None:
                ids[r] = i
        self.ids = ids
        self.gap = ranks[_GAP.encode()]
        self.fast = tiktoken.Encoding("word-end", pat_str=rf"[^{_END}{_GAP}]+{_END}|{_GAP}", mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {"": b""}

    @staticmethod
    def _sign(b: int) -> str:
        """The character that stands for a byte in byte-level vocabularies: itself if printable Latin-1, else from 256 on."""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        return chr(b) if b in shown else chr(256 + [x for x in range(256) if x not in shown].index(b))

    def _learn(self, fresh: list[str]) -> None:
        plain = [c for c in fresh if _PLAIN.fullmatch(c) and "<|" not in c and unicodedata.is_normalized("NFC", c)]
        if plain:
            marked = _GAP.join([_PARTS.sub(rf"\1{_END}", c.lower()) for c in plain])
            out = self.fast.encode_to_numpy(marked)
            bounds = np.flatnonzero(out == self.gap).tolist()
            data = self.ids[out].tobytes()
            for chunk, a, b in zip(plain, [-1, *bounds], [*bounds, len(out)], strict=True):
                self.known[chunk] = data[4 * a + 4 : 4 * b]
        rest = [c for c in fresh if c not in self.known]
        for chunk, e in zip(rest, self.tokenizer.encode_batch(rest, add_special_tokens=False) if rest else [], strict=True):
            self.known[chunk] = struct.pack(f"<{len(e.ids)}I", *e.ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
            known[""] = b""
        cut = [t.replace("\n", " ").split(" ") for t in texts]
        fresh = list({c for chunks in cut for c in chunks if c not in known})
        if fresh:
            self._learn(fresh)
        get = known.__getitem__
        out = [b"".join(map(get, chunks)) for chunks in cut]
        for chunk in fresh:
            if len(chunk) > 64:
                del known[chunk]
        return out


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]

"""Chat formatting in budgeted windows.

Each conversation is written with a template of turn marks. Prefix sums of turn
tokens choose turn-aligned spans: a window holds the system turn, a limited
history of turns that earlier windows had, and as many new turns as the token
budget takes (one at least). The loss mask covers the texts of new assistant
turns only, so each assistant text is a target exactly once however often it is
repeated as history. Control strings inside texts and roles are escaped
reversibly, so a text can never end its turn.

Texts are tokenised where they are read; only then are the turns of a conversation
brought together, sorted. They are read as a stream, so memory is bounded by a
window however long the conversation is.

Defined results: null texts and roles are empty ones. Turns go by (turn, role,
text), nulls first; rows that repeat a turn are turns of their own. History gives way
to a window's first new turn; a turn that exceeds the budget beside the system
turn has a window of its own beyond it. A null conv_id is a
conversation of its own kind. Columns other than the four named are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens of a window, and of the history that it repeats at most.
BUDGET, HISTORY = 1_024, 256
#: The marks of the template.
START, END = "<|im_start|>", "<|im_end|>"
#: Tokens that the marks of a turn count for.
OVERHEAD = 8

_ESCAPE = re.compile(r"<(\\*)\|")
_UNESCAPE = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """Puts a backslash into each '<|' (one more if there are some), so that no mark is left."""
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """As escape(), and the line feed that ends a role in the template is escaped too."""
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


@dataclass
class Turn:
    role: str
    text: str
    tokens: int

    def formatted(self) -> str:
        return f"{START}{escape_role(self.role)}\n{escape(self.text)}{END}\n"


class Windows:
    """Cuts the turns of one conversation, given in order, into windows: spans chosen by search in prefix sums of tokens.

    Turns are held from the history of the open window on, so memory is bounded however long the conversation is.
    """

    def __init__(self, budget: int, history: int, target: str = "assistant"):
        self.budget, self.history, self.target = budget, history, target
        self.system: Turn | None = None
        self.held: list[Turn] = []
        self.sums = np.zeros(1, np.int64)  # sums[i]: tokens of the first i held turns
        self.gone = self.start = self.low = self.number = 0  # turns before the held ones; held places where the open window and its history begin

    def extend(self, turns: list[Turn]) -> Iterator[dict]:
        """The windows that these turns close."""
        if turns and not self.gone and not self.held and turns[0].role == "system":
            self.system = turns[0]
        self.held += turns
        self.sums = np.concatenate((self.sums, self.sums[-1] + np.cumsum([t.tokens for t in turns], dtype=np.int64)))
        while self.start < len(self.held):
            low, end = self._span()
            if end == len(self.held):
                break
            yield self._window(low, end)
        if self.low:
            self.gone, self.start, self.held, self.sums = self.gone + self.low, self.start - self.low, self.held[self.low :], self.sums[self.low :]
            self.low = 0

    def add(self, turn: Turn) -> Iterator[dict]:
        yield from self.extend([turn])

    def close(self) -> dict:
        """The last window."""
        return self._window(*self._span())

    def _kept(self) -> int:
        """Tokens of the system turn, where it is repeated."""
        return self.system.tokens if self.system and self.number else 0

    def _span(self) -> tuple[int, int]:
        """Held places where the history of the open window begins and where the window ends: history gives way to the first new turn."""
        room = self.budget - self._kept()
        low = int(np.searchsorted(self.sums, self.sums[self.start + 1] - room))
        low = min(max(low, self.low), self.start)
        return low, max(self.start + 1, int(np.searchsorted(self.sums, self.sums[low] + room, "right")) - 1)

    def _window(self, low: int, end: int) -> dict:
        """The window of a span; the next one starts with the system turn and the end of this one."""
        again = [self.system] if self._kept() else []
        again += self.held[low : self.start]
        parts, spans, at = [], [], 0
        for k, turn in enumerate([*again, *self.held[self.start : end]]):
            whole = turn.formatted()
            if k >= len(again) and turn.role == self.target:
                head = len(START) + len(escape_role(turn.role)) + 1
                spans.append((at + head, at + len(whole) - len(END) - 1))
            parts.append(whole)
            at += len(whole)
        used = int(self.sums[end] - self.sums[low]) + self._kept()
        out = {"window": self.number, "first_turn": self.gone + self.start, "n_new": end - self.start, "n_repeated": len(again), "n_tokens": used, "text": "".join(parts), "loss": spans}
        self.number += 1
        left = min(self.history, self.budget - self._kept())
        first = 1 if self.system and not self.gone else 0  # the system turn is repeated by itself
        self.low = min(end, max(low, first, int(np.searchsorted(self.sums, self.sums[end] - left))))
        self.start = end
        return out


_COUNTERS: dict[str, Callable[[list[str]], list[int]]] = {}


def counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts tokens of texts by a file of the tokenizers library."""
    if path not in _COUNTERS:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        batch = getattr(t, "encode_batch_fast", t.encode_batch)
        _COUNTERS[path] = lambda texts: [len(e.ids) for e in batch(texts, add_special_tokens=False)]
    return _COUNTERS[path]


_OUT = "conv_id long, window long, first_turn long, n_new long, n_repeated long, n_tokens long, text string, loss array<struct<start:bigint,end:bigint>>"


def _table(rows: list[tuple]) -> pa.RecordBatch:
    pair = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    keys = ["window", "first_turn", "n_new", "n_repeated", "n_tokens"]
    return pa.RecordBatch.from_arrays(
        [pa.array([c for c, _ in rows], pa.int64()), *(pa.array([w[k] for _, w in rows], pa.int64()) for k in keys), pa.array([w["text"] for _, w in rows], pa.string()),
         pa.array([[{"start": a, "end": b} for a, b in w["loss"]] for _, w in rows], pa.list_(pair))],
        ["conv_id", *keys, "text", "loss"],
    )


def format_windows(conversations: DataFrame, tokenizer: str, budget: int = BUDGET, history: int = HISTORY, target: str = "assistant", partitions: int | None = None) -> DataFrame:
    """One row per window: conv_id, window, first_turn (number of its first new turn), n_new, n_repeated, n_tokens, text, loss spans in code points.

    Rows of a conversation come from one task, in order of window.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                batch = whole.slice(i, 1024)
                sizes = count([escape(t) for t in batch.column(3).to_pylist()])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64())], [*batch.schema.names, "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, now = None, None
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                convs, roles, texts, sizes = (c.to_pylist() for c in whole.slice(i, 1024).columns)
                ready, at = [], 0
                while at < len(convs):
                    to = at + 1
                    while to < len(convs) and convs[to] == convs[at]:
                        to += 1
                    if state is None or convs[at] != now:
                        if state:
                            ready.append((now, state.close()))
                        state, now = Windows(budget, history, target), convs[at]
                    ready += [(now, w) for w in state.extend([Turn(r, t, n + OVERHEAD) for r, t, n in zip(roles[at:to], texts[at:to], sizes[at:to], strict=True)])]
                    at = to
                if ready:
                    yield _table(ready)
        if state:
            yield _table([(now, state.close())])

    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    rows = rows.mapInArrow(measure, "conv_id long, turn long, role string, text string, tokens long")
    rows = rows.repartition(*([partitions] if partitions else []), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text", "tokens").mapInArrow(run, _OUT)


_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.DOTALL)


def read_turns(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn of a formatted text; start and end bound the escaped text."""
    at = 0
    for m in _TURN.finditer(text):
        if m.start() != at:
            break
        at = m.end()
        yield unescape_role(m[1]), unescape(m[2]), m.start(2), m.end(2)
    if at != len(text):
        raise ValueError("the text is not a sequence of formatted turns")

"""Best-fit packing of tokenised documents into sequences, improved by swap-based local search.

Documents are tokenised once; only documents longer than a sequence are cut.
Pieces are dealt at random into groups of bounded size, so that groups pack in
parallel, each by best fit decreasing and then by local search: the emptiest
bin gives one or two of its documents away for one or two, or outright, to
bins with room, every exchange raising the sum of squared fills, until no bin
has one that does. Every piece is placed; no document is dropped.

Defined results: a null text is an empty one, which is the end mark alone.
Equal texts have equal pieces. Repeated rows are packed once each. Columns
other than the id and the text are not read.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.session import stored
from treeline.llm.wordbpe import encoder

#: Pieces of a group, on average. A group leaves about one sequence unfilled.
GROUP = 32_768

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, salt long"
_PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, salt: the pieces of each row's ids with the end mark behind them."""
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        part, row = TaskContext.get().partitionId(), 0
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                out: list[tuple] = []
                for doc, ids in zip(batch.column(0).to_pylist(), enc.encode([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                    ids += end
                    for k, start in enumerate(range(0, len(ids) // 4, capacity)):
                        own = ids[4 * start : 4 * (start + capacity)]
                        out.append((doc, k, start, len(own) // 4, zlib.crc32(own), (part << 33) + row))
                        row += 1
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "salt"]
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _PIECES)


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item by best fit decreasing: the fullest bin that has room, else a new one."""
    order = np.argsort(-lengths, kind="stable")
    bins = np.empty(len(lengths), np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, n = 0, 0
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, n
            n += 1
        bins[i] = b
        if room > size:
            if not rooms[room - size]:
                mask |= 1 << (room - size)
            rooms[room - size].append(b)
    return bins


class _Exchanges:
    """What open bins can give back: single items and pairs of items of different or equal lengths, by the room that a bin has without them."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.heaps: list[list[tuple]] = [[] for _ in range(capacity + 1)]
        self.least = np.full(capacity + 1, capacity + 1, np.int64)  # the shortest of each room
        self.rooms: list[dict[int, None]] = [{} for _ in range(capacity + 1)]
        self.open = 0  # bits of the rooms that some bin has
        self.turn: dict[int, int] = {}
        self.places: dict[int, tuple[int, set[int]]] = {}

    def sets(self, items: list[int]) -> list[tuple[int, tuple[int, ...]]]:
        """(length, items) of single items and pairs, one for each choice of lengths, longest single first, then longest pair."""
        by: dict[int, list[int]] = {}
        for i in items:
            by.setdefault(self.lengths[i], []).append(i)
        sizes = sorted(by, reverse=True)
        pairs = [(x + y, (by[x][0], by[y][0] if x != y else by[x][1])) for k, x in enumerate(sizes) for y in sizes[k:] if x != y or len(by[x]) > 1]
        return [(x, (by[x][0],)) for x in sizes] + sorted(pairs, reverse=True)

    def put(self, b: int, room: int, items: list[int]) -> None:
        if not items or not room:
            return
        turn, touched = self.turn.get(b, 0), set()
        for size, out in self.sets(items):
            heapq.heappush(self.heaps[size + room], (size, b, turn, out))
            touched.add(size + room)
            self.least[size + room] = min(size, self.least[size + room])
        self.rooms[room][b] = None
        self.open |= 1 << room
        self.places[b] = (room, touched)

    def take(self, b: int) -> None:
        if b not in self.places:
            return
        room, touched = self.places.pop(b)
        self.turn[b] = self.turn.get(b, 0) + 1
        del self.rooms[room][b]
        if not self.rooms[room]:
            self.open ^= 1 << room
        for at in touched:
            heap = self.heaps[at]
            while heap and heap[0][2] != self.turn.get(heap[0][1], 0):
                heapq.heappop(heap)
            self.least[at] = heap[0][0] if heap else self.capacity + 1

    def best(self, size: int, spare: int) -> tuple[int, tuple[int, ...]] | None:
        """The bin that takes items of this size, and the least that it gives back, from a donor with spare room; None if nothing raises the squares."""
        if (fits := self.open >> size) and (room := (fits & -fits).bit_length() - 1) < spare:
            return next(iter(self.rooms[size + room])), ()
        near = self.least[size : size + spare]
        if len(near) and near[at := int(near.argmin())] < size:
            _, b, _, back = self.heaps[size + at][0]
            return b, back
        return None


def local_search(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> np.ndarray:
    """Exchanges between underfull bins that raise the sum of squared fills, until none does; a bin emptied this way is gone.

    The donor is the emptiest bin not yet tried in the pass. For each of its items
    and then pairs of items, longest first, it takes the exchange that lowers its
    fill most: they move out, or go for one item or a pair of another bin whose
    room takes the difference. An exchange of difference d raises the sum of squares by
    2 d (fill of the other - fill of the donor + d), so the bin's room without
    what it gives lies from the size that goes to below that size plus the donor's
    room. Passes end when one changes nothing, or the bins are as few as the sum of lengths allows.
    """
    if not len(bins):
        return bins
    where, size = bins.tolist(), lengths.tolist()
    items: list[list[int]] = [[] for _ in range(max(where) + 1)]
    for i, b in enumerate(where):
        items[b].append(i)
    fill = [sum(size[i] for i in own) for own in items]
    least = -(-sum(size) // capacity)
    alive = sum(f > 0 for f in fill)
    if alive <= least:
        return np.unique(bins, return_inverse=True)[1]
    table = _Exchanges(size, capacity)
    for b, own in enumerate(items):
        table.put(b, capacity - fill[b], own)
    moved = True
    while moved and alive > least:
        moved = False
        tired: set[int] = set()
        queue = [(f, b) for b, f in enumerate(fill) if 0 < f < capacity]
        heapq.heapify(queue)
        while queue and alive > least:
            f, donor = heapq.heappop(queue)
            if donor in tired or f != fill[donor]:
                continue
            tired.add(donor)
            table.take(donor)
            improved = True
            while improved and fill[donor]:
                improved = False
                for total, out in table.sets(items[donor]):
                    found = table.best(total, capacity - fill[donor])
                    if found is None:
                        continue
                    to, back = found
                    change = total - sum(size[i] for i in back)
                    table.take(to)
                    items[to] = [i for i in items[to] if i not in back] + list(out)
                    items[donor] = [i for i in items[donor] if i not in out] + list(back)
                    fill[to] += change
                    fill[donor] -= change
                    table.put(to, capacity - fill[to], items[to])
                    if to not in tired and fill[to] < capacity:
                        heapq.heappush(queue, (fill[to], to))
                    improved = moved = True
                    break
            if fill[donor]:
                table.put(donor, capacity - fill[donor], items[donor])
            else:
                alive -= 1
    out = np.empty(len(bins), np.int64)
    for b, own in enumerate(items):
        out[own] = b
    return np.unique(out, return_inverse=True)[1]


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item."""
    lengths = np.asarray(lengths, np.int64)
    bins = np.empty(len(lengths), np.int64)
    full = lengths >= capacity
    rest = np.flatnonzero(~full)
    own = local_search(lengths[rest], best_fit(lengths[rest], capacity), capacity) if len(rest) else np.zeros(0, np.int64)
    bins[rest] = own
    n = int(own.max()) + 1 if len(own) else 0
    bins[full] = n + np.arange(int(full.sum()))
    order = np.argsort(bins, kind="stable")
    ends = np.cumsum(lengths[order])
    before = ends - lengths[order]
    first = np.searchsorted(bins[order], bins[order])
    offset = np.empty(len(lengths), np.int64)
    offset[order] = before - before[first]
    return bins, offset


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = stored(pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces")
    groups = max(1, -(-cut.count() // group))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("salt")
        bins, offset = place(table.column("length").to_numpy(), capacity)
        ids = bins + (key[0].as_py() << 32)
        return table.select(["doc_id", "piece", "start", "length", "ids_crc32"]).append_column("sequence_id", pa.array(ids, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    dealt = cut.withColumn("g", F.pmod(F.xxhash64("salt"), F.lit(groups)))
    return dealt.groupBy("g").applyInArrow(run, _PLACED)

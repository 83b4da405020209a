"""Media columns over ISO base media containers.

scan() walks the nested boxes of a file and decodes its sample tables into
codec, duration, samples and byte ranges of keyframes; no payload is decoded,
and nothing but box headers and tables is read. store() writes bytes as a track
of 8-bit samples, and payload() reads a track's bytes back by its tables.

Defined results: a null file, an empty one, or one whose boxes or tables do not
fit its bytes has a null codec and an error text, never an exception. A file
with several tracks gives its first one that has samples. Columns other than
the given one are left as they are; results whose names clash get underscores.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from treeline.llm.sampling import columns

#: Bytes of an access unit, units of a chunk, units from one keyframe to the next, samples a second.
UNIT, CHUNK, KEY_EVERY, RATE = 192, 32, 16, 8_000

#: Boxes that hold boxes.
CONTAINERS = {b"moov", b"trak", b"edts", b"mdia", b"minf", b"dinf", b"stbl", b"mvex", b"moof", b"traf", b"udta"}


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def store(payload: bytes, unit: int = UNIT, chunk: int = CHUNK, key_every: int = KEY_EVERY, rate: int = RATE) -> bytes:
    """A file with one sound track of raw 8-bit samples; the payload is a whole number of units."""
    if len(payload) % unit or not payload:
        raise ValueError("the payload must be a positive multiple of the unit")
    n = len(payload) // unit
    chunks = -(-n // chunk)
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp41")
    wide = 8 + len(payload) >= 1 << 32
    head = struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) if wide else struct.pack(">I4s", 8 + len(payload), b"mdat")
    start = len(ftyp) + len(head)
    places = [start + k * chunk * unit for k in range(chunks)]
    last = n - (chunks - 1) * chunk
    runs = [(1, chunk, 1)] if last == chunk else [*([(1, chunk, 1)] if chunks > 1 else []), (chunks, last, 1)]
    keys = range(1, n + 1, key_every)
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, rate << 16))
    stbl = _box(
        b"stbl",
        _full(b"stsd", struct.pack(">I", 1), entry),
        _full(b"stts", struct.pack(">III", 1, n, unit)),
        _full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
        _full(b"stsc", struct.pack(f">I{3 * len(runs)}I", len(runs), *(v for r in runs for v in r))),
        _full(b"stsz", struct.pack(">II", unit, n)),
        _full(b"co64", struct.pack(f">I{chunks}Q", chunks, *places)) if places[-1] >= 1 << 32 else _full(b"stco", struct.pack(f">I{chunks}I", chunks, *places)),
    )
    length = n * unit
    long = length >= 1 << 32
    times = struct.pack(">QQIQ" if long else ">IIII", 0, 0, rate, length)
    minf = _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), stbl)
    mdia = _box(b"mdia", _full(b"mdhd", times, struct.pack(">HH", 0x55C4, 0), version=int(long)), _full(b"hdlr", bytes(4), b"soun", bytes(12), b"payload\0"), minf)
    tkhd = _full(b"tkhd", struct.pack(">QQIIQ" if long else ">IIIII", 0, 0, 1, 0, length), bytes(8), struct.pack(">hhhh", 0, 0, 0x100, 0), matrix, bytes(8), version=int(long), flags=3)
    mvhd = _full(b"mvhd", times, struct.pack(">IH", 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2), version=int(long))
    return b"".join((ftyp, head, payload, _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))))


class _Same(Sequence):
    """One size, so many times."""

    def __init__(self, size: int, n: int):
        self.size, self.n = size, n

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        return self.size


@dataclass
class Track:
    handler: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    tables: dict[bytes, bytes] = field(default_factory=dict)

    def ranges(self, size: int) -> Iterator[tuple[int, int]]:
        """(offset, bytes) of each sample, from the tables of sizes, chunks and chunk offsets."""
        sizes = self._sizes(size)
        where = self.tables.get(b"stco", b"")
        offsets = struct.unpack_from(f">{_count(where, 4, 4)}I", where, 8) if where else ()
        if b"co64" in self.tables:
            where = self.tables[b"co64"]
            offsets = struct.unpack_from(f">{_count(where, 4, 8)}Q", where, 8)
        table = self.tables.get(b"stsc", bytes(8))
        runs = list(struct.iter_unpack(">III", table[8 : 8 + 12 * _count(table, 4, 12)]))
        run, per, total = 0, 0, len(sizes)
        done = 0
        for k, at in enumerate(offsets, 1):
            while run < len(runs) and runs[run][0] <= k:
                per = runs[run][1]
                run += 1
            for _ in range(min(per, total - done)):
                if at + sizes[done] > size:
                    raise ValueError("a sample lies beyond the file")
                yield at, sizes[done]
                at += sizes[done]
                done += 1
        if done < total:
            raise ValueError("chunks hold fewer samples than there are sizes")

    def _sizes(self, size: int) -> Sequence[int]:
        """Bytes of each sample of a file of that size; equal sizes take no memory, and a count that the tables or the file cannot hold is an error."""
        if b"stz2" in self.tables:
            t = self.tables[b"stz2"]
            bits, n = struct.unpack_from(">II", t, 4)
            if bits not in (4, 8, 16) or len(t) < 12 + (n * bits + 7) // 8:
                raise ValueError("the size table is cut off")
            if bits == 16:
                return struct.unpack_from(f">{n}H", t, 12)
            raw = t[12 : 12 + (n * bits + 7) // 8]
            return raw[:n] if bits == 8 else [v for b in raw for v in (b >> 4, b & 15)][:n]
        t = self.tables.get(b"stsz", bytes(12))
        same, n = struct.unpack_from(">II", t, 4)
        if same:
            if n * same > size:
                raise ValueError("samples are larger than the file")
            return _Same(same, n)
        if len(t) < 12 + 4 * n:
            raise ValueError("the size table is cut off")
        return struct.unpack_from(f">{n}I", t, 12)

    def has_samples(self) -> bool:
        name, at = (b"stz2", 8) if b"stz2" in self.tables else (b"stsz", 8)
        return struct.unpack_from(">I", self.tables.get(name, bytes(12)), at)[0] > 0

    def keyframes(self) -> set[int] | None:
        """Numbers of keyframes from 0; None if each sample is one."""
        if b"stss" not in self.tables:
            return None
        t = self.tables[b"stss"]
        return {v - 1 for v in struct.unpack_from(f">{_count(t, 4, 4)}I", t, 8)}

    def ticks(self) -> int:
        t = self.tables.get(b"stts", bytes(8))
        return sum(n * d for n, d in struct.iter_unpack(">II", t[8 : 8 + 8 * _count(t, 4, 8)]))


def _count(table: bytes, at: int, width: int) -> int:
    n = struct.unpack_from(">I", table, at)[0]
    if len(table) < at + 4 + n * width:
        raise ValueError("a table is cut off")
    return n


def _boxes(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if at + 16 > end:
                raise ValueError("a box is cut off")
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise ValueError("a box does not fit its place")
        yield kind, at + head, at + size
        at += size


def _walk(data: bytes, at: int, end: int, tracks: list[Track]) -> None:
    stack = [(at, end)]
    while stack:
        at, end = stack.pop()
        inner = []
        for kind, a, b in _boxes(data, at, end):
            if kind == b"trak":
                tracks.append(Track())
                _trak(data, a, b, tracks[-1])
            elif kind in CONTAINERS:
                inner.append((a, b))
        stack += reversed(inner)


def _trak(data: bytes, at: int, end: int, track: Track) -> None:
    stack = [(at, end)]
    while stack:
        at, end = stack.pop()
        for kind, a, b in _boxes(data, at, end):
            if kind in CONTAINERS:
                stack.append((a, b))
            elif kind == b"hdlr":
                track.handler = data[a + 8 : a + 12].decode("latin-1")
            elif kind == b"mdhd":
                track.timescale, track.duration = struct.unpack_from(">IQ", data, a + 20) if data[a] else struct.unpack_from(">II", data, a + 12)
            elif kind == b"stsd":
                track.codec = data[a + 12 : a + 16].decode("latin-1")
            elif kind in (b"stts", b"stss", b"stsc", b"stsz", b"stz2", b"stco", b"co64"):
                track.tables[kind] = data[a:b]


def tracks(data: bytes) -> list[Track]:
    """The tracks of a file, in order; raises ValueError or struct.error for what is no such file."""
    found: list[Track] = []
    _walk(data, 0, len(data), found)
    return found


def _first(data: bytes) -> Track:
    for t in tracks(data):
        if t.has_samples():
            return t
    raise ValueError("no track has samples")


def payload(data: bytes) -> bytes:
    """All samples of the first track that has some, one after the other, by its tables."""
    return b"".join([data[a : a + n] for a, n in _first(data).ranges(len(data))])


@dataclass
class Media:
    codec: str | None = None
    handler: str | None = None
    duration_s: float | None = None
    n_samples: int | None = None
    sample_bytes: int | None = None
    keyframes: list[tuple[int, int]] | None = None
    error: str | None = None

    def feature(self) -> str:
        """A line that names codec, length, samples, and number and first and last byte of the keyframes."""
        if self.error or not self.keyframes:
            return f"error={self.error or 'no keyframe'}"
        last = self.keyframes[-1]
        return f"{self.codec.strip()}/{self.handler}:{self.duration_s:.3f}s:{self.n_samples}x:{len(self.keyframes)}k:{self.keyframes[0][0]}-{last[0] + last[1]}"


def scan(data: bytes | None) -> Media:
    """What the containers' tables say of the first track that has samples."""
    try:
        if not data:
            raise ValueError("no bytes")
        t = _first(data)
        ranges, keys = list(t.ranges(len(data))), t.keyframes()
        seconds = (t.duration or t.ticks()) / t.timescale if t.timescale else None
        chosen = ranges if keys is None else [r for i, r in enumerate(ranges) if i in keys]
        return Media(t.codec, t.handler, seconds, len(ranges), sum(n for _, n in ranges), chosen)
    except (ValueError, struct.error, IndexError) as e:
        return Media(error=str(e))


_FIELDS = [
    ("codec", "string"), ("handler", "string"), ("duration_s", "double"), ("n_samples", "long"), ("sample_bytes", "long"),
    ("keyframes", "array<struct<offset:bigint,bytes:bigint>>"), ("media_error", "string"),
]


def media_columns(df: DataFrame, column: str) -> DataFrame:
    """df with codec, handler, duration_s, n_samples, sample_bytes, keyframes (byte ranges) and media_error of a column of files."""
    names = columns([n for n, _ in _FIELDS], df.columns)
    schema = T.StructType([*df.schema.fields, *(T.StructField(names[n], T._parse_datatype_string(t)) for n, t in _FIELDS)])
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pa.struct([("offset", pa.int64()), ("bytes", pa.int64())])
        types = [pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.list_(pair), pa.string()]
        for whole in batches:
            for i in range(0, whole.num_rows, 64):
                batch = whole.slice(i, 64)
                found = [scan(b) for b in batch.column(at).to_pylist()]
                rows = [(m.codec, m.handler, m.duration_s, m.n_samples, m.sample_bytes, None if m.keyframes is None else [{"offset": a, "bytes": n} for a, n in m.keyframes], m.error) for m in found]
                extra = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *extra], schema.fieldNames())

    return df.mapInArrow(run, schema)

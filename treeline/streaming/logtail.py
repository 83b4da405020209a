"""Streams: tails of call logs, and event-time windows over events."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes that are looked at in one step for the last line feed of a file.
STEP = 1 << 16


def complete_until(path: str, start: int) -> int:
    """The place behind the last line feed of a file, start if there is none behind it: an incomplete last line waits."""
    with open(path, "rb") as f:
        at = f.seek(0, os.SEEK_END)
        while at > start:
            step = max(start, at - STEP)
            f.seek(step)
            found = f.read(at - step).rfind(b"\n")
            if found >= 0:
                return step + found + 1
            at = step
    return start


class Span(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def lines_of(span: Span) -> Iterator[tuple[str, int, str]]:
    """(path, place, line) of the complete lines of a span of bytes; an empty line, or one that is no JSON, is an error."""
    with open(span.path, "rb") as f:
        f.seek(span.start)
        at = span.start
        while at < span.end:
            raw = f.readline()
            line = raw.rstrip(b"\n").decode()
            try:
                json.loads(line)
            except ValueError as e:
                raise ValueError(f"malformed line at byte {at} of {span.path}") from e
            yield span.path, at, line
            at += len(raw)


class CallLog(DataSource):
    """Files of JSON lines below a folder that both driver and executors see: what is appended comes once, a line as soon as it is complete."""

    @classmethod
    def name(cls) -> str:
        return "call_log"

    def schema(self) -> str:
        return "path string, place long, line string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(self.options["path"])

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Tail(self.options["path"])


def _files(folder: str) -> list[str]:
    folder = folder.removeprefix("file:")
    if os.path.isfile(folder):
        return [folder]
    return sorted(os.path.join(top, n) for top, _, names in os.walk(folder) for n in names if n.endswith(".jsonl"))


class _Batch(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        return [Span(p, 0, complete_until(p, 0)) for p in _files(self.folder)] or [Span("", 0, 0)]

    def read(self, partition: Span) -> Iterator[tuple]:
        return lines_of(partition) if partition.path else iter(())


class _Tail(DataSourceStreamReader):
    """Offsets are the places up to which each file was read, so a restarted stream goes on where it was."""

    def __init__(self, folder: str):
        self.folder = folder
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        self.known = {p: complete_until(p, self.known.get(p, 0)) for p in _files(self.folder)}
        return dict(self.known)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Span(p, start.get(p, 0), to) for p, to in sorted(end.items()) if to > start.get(p, 0)]

    def read(self, partition: Span) -> Iterator[tuple]:
        return lines_of(partition)

    def commit(self, end: dict) -> None:
        pass


def tail_calls(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A stream of calls as they are appended to files of JSON lines; an incomplete last line waits, a malformed complete one fails the stream."""
    spark.dataSource.register(CallLog)
    lines = spark.readStream.format("call_log").load(folder)
    return lines.select("path", "place", F.from_json("line", schema, {"mode": "FAILFAST"}).alias("c")).select("path", "place", "c.*")


def read_calls(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The calls of all files at once, by the same rules."""
    spark.dataSource.register(CallLog)
    return spark.read.format("call_log").load(folder).select("path", "place", F.from_json("line", schema, {"mode": "FAILFAST"}).alias("c")).select("path", "place", "c.*")


def windowed(events: DataFrame, ts: str, kind: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and kind, for streams with a watermark and for tables alike."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")


def sessions(events: DataFrame, ts: str, user: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a user that end after a gap."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("s"), user).agg(F.count("*").alias("n")).select(user, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")

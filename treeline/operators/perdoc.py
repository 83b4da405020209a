"""Functions of whole documents over tables whose rows come document by document: no shuffle, one document in memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Rows that one batch of results holds, about.
OUT = 20_000


def per_document(rows: DataFrame, fn: Callable[[list[dict]], list[dict]], schema: str, key: str = "doc_id") -> DataFrame:
    """What fn makes of each document's rows, in their order.

    The rows of a document stand together in one partition, as a parsing pass
    and what only projects or filters its rows leave them; a table that was
    shuffled goes through by_document() instead.
    """
    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        out: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0][key] != row[key]:
                    out += fn(held)
                    held = []
                    if len(out) >= OUT:
                        yield pa.RecordBatch.from_pylist(out, schema=arrow)
                        out = []
                held.append(row)
        if held:
            out += fn(held)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return rows.mapInArrow(run, schema)


def by_document(rows: DataFrame, fn: Callable[[list[dict]], list[dict]], schema: str, order: str = "pre", key: str = "doc_id") -> DataFrame:
    """per_document() for tables in any order: documents are dealt by key and sorted."""
    return per_document(rows.repartition(key).sortWithinPartitions(key, order), fn, schema, key)

"""Bounded, repeatable samples of labelled rows, for fitting classifiers only."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo: what folds go by; a null id has remainder 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string")) % modulus, F.lit(0))


def hashed_sample(rows: DataFrame, key: str, size: int, kind: str | None = None, least: int = 0) -> DataFrame:
    """About size rows, by a hash of the key against a threshold, and least or more of each kind; all rows if there are no more."""
    n = rows.count()
    if n <= size:
        return rows
    taken = F.pmod(F.xxhash64(key, F.lit(7)), F.lit(1 << 20)) < int(size / n * (1 << 20))
    if kind is None:
        return rows.where(taken)
    few = rows.groupBy(F.col(kind).alias("_kind")).agg(F.count("*").alias("_n")).where(F.col("_n") * size < F.lit(least) * n)
    more = F.pmod(F.xxhash64(key, F.lit(8)), F.lit(1 << 40)) < F.lit(least) / F.col("_n") * F.lit(1 << 40)
    return rows.join(F.broadcast(few), F.col(kind) == F.col("_kind"), "left").where(taken | more).select(*rows.columns)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, fold: Column, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, label of about size labelled documents of the fold (a condition on doc_id); the key table is bounded, so it is broadcast."""
    keys = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").where(fold)
    keys = hashed_sample(keys.groupBy("doc_id").agg(F.max("label").alias("label")), "doc_id", size)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(keys), "doc_id")


def columns(names: Iterable[str], taken: Iterable[str]) -> dict[str, str]:
    """For each name the one to give it where names are taken already (compared without case): underscores go behind it."""
    used = {t.lower() for t in taken}
    out = {}
    for name in names:
        new = name
        while new.lower() in used:
            new += "_"
        used.add(new.lower())
        out[name] = new
    return out

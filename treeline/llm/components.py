"""Connected components of a table of links, by alternating large-star and small-star rounds over contracted partitions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.session import Stored

#: Links that a task contracts at once.
CONTRACTED = 1 << 17


def components(links: DataFrame, at_once: int = CONTRACTED) -> Stored:
    """(id, component) for every end of a link (a, b); the component is its smallest id.

    Each round contracts the links to stars, in tasks of at_once links or so, and
    hooks neighbours to the smallest one known, in shuffles whose rows are links;
    the number of rounds follows the logarithm of the largest component. Links
    that one task holds are done once it has contracted them.
    Self-links and repeated links are allowed; a null end is not a link.
    """
    edges = Stored(links.where("a is not null and b is not null and a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")), "edges")
    before = None
    while True:
        n = edges.df.count()
        stars = Stored(_contracted(edges.df.coalesce(max(1, -(-n // at_once))), at_once), "edges")
        edges.drop()
        if n <= at_once:
            break
        large = _hooked(stars.df.unionByName(stars.df.select(F.col("v").alias("u"), F.col("u").alias("v"))), larger_only=True)
        edges = Stored(_hooked(large, larger_only=False).distinct(), "edges")
        stars.drop()
        after = _state(edges.df)
        if after == before:
            stars = edges
            break
        before = after
    ids = stars.df.select(F.col("u").alias("id"), F.col("v").alias("component"))
    label = Stored(ids.unionByName(stars.df.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()), "label")
    stars.drop()
    return label


def _state(edges: DataFrame) -> tuple:
    """Tells tables of distinct links apart."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _contracted(edges: DataFrame, at_once: int) -> DataFrame:
    """Stars with the same components: runs of a partition's links are united, and each end goes to the smallest of its run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}
        n = 0

        def root(x: int) -> int:
            top = x
            while (above := up.setdefault(top, top)) != top:
                top = above
            while up[x] != top:
                up[x], x = top, up[x]
            return top

        def stars() -> pa.RecordBatch:
            own = [(x, r) for x in list(up) if (r := root(x)) != x]
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in own], pa.int64()) for i in (0, 1)], ["u", "v"])

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(u), root(v)
                if a != b:
                    up[max(a, b)] = min(a, b)
            n += batch.num_rows
            if n > at_once:
                yield stars()
                up.clear()
                n = 0
        if up:
            yield stars()

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def _hooked(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Large star: each larger neighbour of u goes to the least of u and its neighbours. Small star: u and its smaller neighbours do."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = edges.join(least, "u")
    if larger_only:  # links of u to its own least neighbour come back through that neighbour's side
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    hooked = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return hooked.where("u <> v")

"""Approximate nearest neighbours by shifted space-filling curves.

Each curve is a random rotation and shift of the vectors' space, projected to
few dimensions, with a Hilbert order over a grid. Spark range-partitions the
rows by (curve, Hilbert key) and numbers them; rows of neighbouring numbers form
blocks of one size, and a query searches its own block and the two beside it on
each curve. What the curves find is merged and ranked by exact distances on the
original vectors. The projection's scale comes from a bounded sample; every
vector is indexed. Keys are fine enough to split crowded cells, and rows of one
key go by a hash that differs from curve to curve.

Curves find a near vector independently, so the number of curves that found a
query's answers tells how many were missed. A query whose answers were found on
fewer than SEEN curves on average is not settled: it searches twice as many
blocks to each side, as often as that reads less than the table, and if it is
still not settled it is compared with all vectors. So recall holds at any number
of rows, and vectors without structure cost what a full search costs.

Equal vectors are one point of the index that keeps its smallest ids, as many
as an answer can need, so a vector that a third of the rows share costs one
place. Blocks bound the memory of a task whatever the keys are.

Defined results: vectors that are null, empty, zero or hold a null or non-finite
component take no part, as queries or candidates. Vectors of different lengths
are no neighbours. Ties go to the smaller id. Rows that repeat an id with the
same vector are one; a null id takes no part. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treeline.llm.session import stored

#: Curves, rows of a block, dimensions and bits a dimension of a curve's grid, vectors in the sample for its scale.
CURVES, BLOCK, DIMS, GRID_BITS, SAMPLE = 24, 2_048, 12, 15, 8_192
#: Bits a dimension that one part of a key holds.
PART_BITS = 5
#: Curves that have to find an answer, on average over a query's answers, for the query to be settled.
SEEN = 4.0
#: Unsettled queries that one full search takes, which bounds what is broadcast.
SCANNED = 8_192


def hilbert_keys(cells: np.ndarray, bits: int, part: int = PART_BITS) -> list[np.ndarray]:
    """Place along the Hilbert curve of each row of cell numbers (rows x dimensions, below 2**bits), the first bits first.

    Each array holds part bits of every dimension (62 bits in all at most), the last one what is left.
    """
    x = cells.T.astype(np.int64).copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            turned = (x[i] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(turned, x[0] ^ p, x[0]) ^ swap
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    fold = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        fold = np.where((x[-1] & q) != 0, fold ^ (q - 1), fold)
        q >>= 1
    x ^= fold
    keys = []
    for top in range(bits, 0, -part):
        key = np.zeros(x.shape[1], np.int64)
        for bit in range(top - 1, max(top - part, 0) - 1, -1):
            for row in x:
                key = key << 1 | (row >> bit & 1)
        keys.append(key)
    return keys


class Curves:
    """The rotations and shifts; centre and spread come from sample vectors, all else from the seed."""

    def __init__(self, sample: np.ndarray, curves: int = CURVES, dims: int = DIMS, bits: int = GRID_BITS, seed: int = 17):
        rng = np.random.default_rng(seed)
        self.width = sample.shape[1]
        self.bits, dims = bits, min(dims, self.width)
        self.centre = sample.mean(0)
        self.axes = [np.linalg.qr(rng.normal(size=(self.width, self.width)))[0][:, :dims] for _ in range(curves)]
        self.shifts = [rng.random(dims) * 0.5 for _ in range(curves)]
        spread = (sample - self.centre).std() * 3
        self.spread = spread if spread > 0 else 1.0

    def keys(self, vectors: np.ndarray) -> Iterator[list[np.ndarray]]:
        """For each curve the parts of the keys of all rows."""
        centred = vectors - self.centre
        for axes, shift in zip(self.axes, self.shifts, strict=True):
            u = (centred @ axes / self.spread + 1) / 4 + shift
            yield hilbert_keys(np.clip(u * (1 << self.bits), 0, (1 << self.bits) - 1).astype(np.int64), self.bits)


def usable(vector: str) -> Column:
    """Condition for vectors that take part."""
    v = F.col(vector)
    wrong = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(wrong, F.lit(True)) & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of the width; longer vectors are cut and shorter ones padded, for the curves only."""
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.diff(column.offsets.to_numpy())
    if (sizes == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width))
    for i, v in enumerate(column.to_pylist()):
        out[i, : min(width, len(v))] = v[:width]
    return out


def _closest(x: np.ndarray, sought: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each sought row its number, the rows of x that may be among its k nearest (ties too), and their exact distances."""
    centre = x.mean(0)
    u, v = x - centre, sought - centre
    uu, vv = (u * u).sum(1), (v * v).sum(1)
    for at in range(0, len(v), 256):
        squares = uu + vv[at : at + 256, None] - 2 * v[at : at + 256] @ u.T
        slack = 1e-12 * (uu.max() + vv[at : at + 256]) * x.shape[1]
        for i, row in enumerate(squares, at):
            near = np.flatnonzero(row <= np.partition(row, k - 1)[k - 1] + 2 * slack[i - at]) if len(row) > k else np.arange(len(row))
            yield i, near, np.sqrt(((x[near] - sought[i]) ** 2).sum(1))


def _scan(points: DataFrame, asked: pa.Table, k: int) -> DataFrame:
    """point, vec_id, score: for each asked point the k nearest ids of each task, by comparing it with all points."""
    by_size: dict[int, list[tuple[int, list[float]]]] = {}
    for point, vec in zip(asked.column("point").to_pylist(), asked.column("vec").to_pylist(), strict=True):
        by_size.setdefault(len(vec), []).append((point, vec))
    sent = points.sparkSession.sparkContext.broadcast({n: (np.array([p for p, _ in own]), np.array([v for _, v in own], np.float64)) for n, own in by_size.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[float, int]]] = {}
        for whole in batches:
            for i in range(0, whole.num_rows, 8_192):
                batch = whole.slice(i, 8_192)
                column, ids = batch.column(0), batch.column(1).to_pylist()
                sizes = np.asarray(pc.list_value_length(column))
                for size in np.unique(sizes):
                    if int(size) not in sent.value:
                        continue
                    names, sought = sent.value[int(size)]
                    mine = np.flatnonzero(sizes == size)
                    x = column.take(pa.array(mine)).flatten().to_numpy().astype(np.float64).reshape(len(mine), size)
                    for a, near, d in _closest(x, sought, k):
                        name = int(names[a])
                        best[name] = sorted(best.get(name, []) + [(float(s), v) for n, s in zip(near, d, strict=True) for v in ids[mine[n]]])[:k]
        out = [(name, v, s) for name, own in best.items() for s, v in own]
        for i in range(0, len(out), 65_536):
            cols = list(zip(*out[i : i + 65_536], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["point", "vec_id", "score"])

    return points.select("vec", "ids").mapInArrow(run, "point long, vec_id long, score double")


def nearest(
    vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", curves: int = CURVES, block: int = BLOCK
) -> DataFrame:
    """The k nearest found of every row that the condition queries (on id_col) names: query_id, rank, vec_id, score (Euclidean distance)."""
    spark = vectors.sparkSession
    kind = vectors.schema[vector_col].dataType.simpleString()
    assert kind.startswith("array"), f"{vector_col} is {kind}, not an array"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vec"), F.coalesce(queries, F.lit(False)).alias("is_query"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable("vec"))
    few = rows.select("vec", "vec_id").distinct().withColumn("rn", F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))).where(F.col("rn") <= k + 1)
    points = few.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("point", F.element_at("ids", 1))
    asked = rows.where("is_query").select(F.col("vec_id").alias("query_id"), "vec").distinct()
    points = stored(points, "points")
    asked = stored(asked.join(points.select("vec", "point"), "vec").select("query_id", "point"), "asked")
    total = points.count()
    sample = points.select("vec").where(F.pmod(F.xxhash64("point"), F.lit(1 << 20)) < int(min(1.0, SAMPLE / max(total, 1)) * (1 << 20))).limit(2 * SAMPLE).toArrow().column("vec").to_pylist()
    width = max((n := [len(v) for v in sample]), key=lambda s: (n.count(s), -s)) if sample else 1
    grid = spark.sparkContext.broadcast(Curves(np.array([v for v in sample if len(v) == width] or [[0.0]], np.float64), curves))

    keys = [f"key{i}" for i in range(-(-GRID_BITS // PART_BITS))]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 2048):
                batch = whole.slice(i, 2048)
                x = _matrix(batch.column(1), grid.value.width)
                for c, parts in enumerate(grid.value.keys(x)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), c, np.int32)), *map(pa.array, parts), batch.column(0)], ["curve", *keys, "point"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, done = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.full(b.num_rows, part, np.int32)), pa.array(np.arange(done, done + b.num_rows))], ["curve", "point", "part", "n"])
            done += b.num_rows

    keyed = points.select("point", "vec").mapInArrow(place, ", ".join(["curve int", *(f"{key} long" for key in keys), "point long"]))
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["curve", *keys, F.xxhash64("point", "curve"), "point"]
    ordered = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("curve", "point")
    ordered = stored(ordered.mapInArrow(number, "curve int, point long, part int, n long"), "ordered")
    sizes = ordered.groupBy("part").agg(F.count("*").alias("rows"))  # a row for each partition of the range
    before = sizes.withColumn("before", F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).select("part", "before")
    placed = ordered.join(F.broadcast(before), "part").select("point", F.floor((F.col("before") + F.col("n")) / F.lit(block)).alias("block"), "curve")
    places = stored(placed.groupBy("point").agg(F.collect_list(F.struct("curve", "block")).alias("places")), "places")
    whole = points.join(places, "point")
    at = F.explode("places").alias("at")

    def search(table: pa.Table) -> pa.Table:
        asked_for = table.column("is_query").to_numpy()
        held, asks = np.flatnonzero(~asked_for), np.flatnonzero(asked_for)
        out: list[tuple[int, int, float]] = []
        if len(held) and len(asks):
            column = table.column("vec").combine_chunks()
            sizes = np.diff(column.offsets.to_numpy())
            points = table.column("point").to_numpy()
            ids = table.column("ids").take(held).to_pylist()
            for size in np.unique(sizes[asks]):
                mine = held[sizes[held] == size]
                if not len(mine):
                    continue
                x = column.take(pa.array(mine)).flatten().to_numpy().astype(np.float64).reshape(len(mine), size)
                where = np.searchsorted(held, mine)
                own = asks[sizes[asks] == size]
                sought = column.take(pa.array(own)).flatten().to_numpy().astype(np.float64).reshape(len(own), size)
                for a, near, d in _closest(x, sought, k + 1):
                    found = sorted((float(s), v) for i, s in zip(near, d, strict=True) for v in ids[where[i]])[: k + 1]
                    out += [(int(points[own[a]]), v, s) for s, v in found]
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.Table.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["point", "vec_id", "score"])

    near = Window.partitionBy("point").orderBy("score", "vec_id")
    best = F.row_number().over(near) <= k + 1
    # how many ids of its length a query can find at most, and how many of them are its own vector
    supply = whole.groupBy(F.size("vec").alias("width")).agg(F.least(F.sum(F.size("ids")), F.lit(k + 1)).alias("supply"))
    open_ = asked.select("point").distinct().join(points, "point").withColumn("width", F.size("vec")).join(F.broadcast(supply), "width")
    open_ = stored(open_.select("point", "vec", "supply", F.least(F.size("ids"), F.lit(k + 1)).alias("own")), "open")
    last, steps, so_far, done = 1, [-1, 0, 1], None, []
    while open_.take(1):
        sought = open_.join(places, "point").select(at, "point", "vec").withColumn("step", F.explode(F.array(*map(F.lit, steps))))
        sought = sought.select("at.curve", (F.col("at.block") + F.col("step")).alias("block"), "point", "vec", F.lit(None).cast("array<bigint>").alias("ids"), F.lit(True).alias("is_query"))
        held = whole.select(at, "point", "vec", "ids").select("at.curve", "at.block", "point", "vec", "ids", F.lit(False).alias("is_query"))
        if so_far is not None:  # few are left to search
            held = held.join(F.broadcast(sought.select("curve", "block").distinct()), ["curve", "block"], "left_semi")
        found = held.unionByName(sought).groupBy("curve", "block").applyInArrow(search, "point long, vec_id long, score double").withColumn("hits", F.lit(1).cast("long"))
        found = found if so_far is None else found.unionByName(so_far)
        found = found.groupBy("point", "vec_id").agg(F.min("score").alias("score"), F.sum("hits").alias("hits"))
        found = stored(found.withColumn("good", best).where("good").drop("good"), "found")
        seen = found.join(points.select("point", "ids"), "point").groupBy("point").agg(
            F.count("*").alias("n"),
            F.sum((~F.array_contains("ids", F.col("vec_id"))).cast("int")).alias("others"),
            F.sum(F.when(~F.array_contains("ids", F.col("vec_id")), F.col("hits")).otherwise(0)).alias("hits"),
        )
        settled = seen.join(open_.select("point", "supply"), "point").where((F.col("n") >= F.col("supply")) & (F.col("hits") >= SEEN * F.col("others"))).select("point")
        settled = stored(settled, "settled")
        done.append(found.join(settled, "point", "left_semi").select("point", "vec_id", "score"))
        open_ = stored(open_.join(settled, "point", "left_anti"), "open")
        so_far = found.join(settled, "point", "left_anti")
        wider = 2 * last + 1
        if curves * (2 * wider + 1) * block >= total:
            break
        steps, last = [d for d in range(-wider, wider + 1) if abs(d) > last], wider
    left = open_.count()
    for turn in range(slices := -(-left // SCANNED)):
        own = open_.where(F.pmod(F.xxhash64("point", F.lit(3)), F.lit(slices)) == turn).select("point", "vec").toArrow()
        done.append(stored(_scan(points, own, k + 1).withColumn("good", best).where("good").drop("good"), "scanned"))
    found = reduce(DataFrame.unionByName, done) if done else spark.createDataFrame([], "point long, vec_id long, score double")
    answers = asked.join(found, "point").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

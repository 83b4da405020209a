"""N-gram Jaccard join: near copies by exact Jaccard similarity of word-shingle sets.

Method: token-combination prefixes. All shingles have one global order: rare
ones by hash first, frequent ones last. A document indexes the first shingles
of its set in that order. Rare shingles are indexed one by one; frequent ones
only as pairs within one of SUBCLASSES classes, and the prefix is extended by
what pairs lose. If two sets reach the similarity, they share an indexed
signature: otherwise each class with n prefix shingles would hold n (rare) or
n - 1 (frequent) of them that the other set lacks, more in all than the
similarity lets a set lack. What the index proposes is verified on whole sets.

Equal sets share one set id and are indexed and verified once. Sets are verified
against one pivot of their buckets first. Buckets that hold the same sets are
one from then on. If the sets that are then still apart inside buckets make more
pairs than postings, shares of the buckets get pivots of their own, in rounds, as
long as these link. Only sets that are still in different components are paired
inside a bucket after that, all of them that sizes, matched shingles and sketches
let link: what is left of a group there are the pairs of sets that do not reach the
similarity, which only their comparison can tell. Two sets that share many frequent
pairs are paired at one of them, the first of their least ones by classes that is
the same. Sets and shingles go by 64-bit hashes.

Defined results: a null or empty text, or one without words, has an empty set
and links with nothing. A document of fewer words than a shingle has its whole
word sequence as the one element. Rows that repeat a doc_id are one document
whose smallest set counts; a null doc_id takes no part. Columns other than the
id and the text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from treeline.llm.components import components
from treeline.llm.sampling import columns
from treeline.llm.session import Stored, small_side, stored
from treeline.llm.textbatch import Words, mix64, shingles, text_slices

#: A shingle is frequent from so many documents on.
FREQUENT_FROM = 50
#: Shingles that one task counts, on average.
COUNTED_AT_ONCE = 1_000_000
#: Frequent shingles (8 bytes each) that each task gets as one list at most; more are joined to the documents.
FREQUENT_MOST = 1 << 20
#: Set ids that a task remembers, so as to index copies once; forgotten all at once, which changes no result.
REMEMBERED = 1 << 19
#: Prefixes go on for so many rare shingles, if there are more: what two sets share of them prunes candidates by counting.
SHARED = 16
#: Frequent shingles pair up within one of so many classes in sets of over SMALL_SET elements, in a single class below.
SUBCLASSES = 16
SMALL_SET = 128
#: Rounds of pivots at most, sets of a share of a bucket that one pivot stands for from the second round on, and pivots of a set in a round.
#: Rounds end once what is left costs AFFORDED pairs a posting at most, so that it grows as the index does, or under a tenth of the pivots link.
#: All that is left is paired exactly.
ROUNDS, MANY, PARTNERS, AFFORDED = 6, 16, 8, 1
#: Classes of frequent pairs, of each of which a set's least one is compared so as to pair two sets at one signature; with more, fewer sets meet twice.
LEAST_OF = 16


def missing(n: int, percent: int) -> int:
    """How many of its n elements a set may lack in another one of that similarity."""
    return n - (percent * n + 99) // 100


def signatures(tokens: np.ndarray, frequent: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(rare, pairs): the shingles and the pairs of frequent ones that a set of sorted hashes is indexed under.

    rare is the beginning of the set in the global order; pairs are needed if
    all rare shingles are too few.
    """
    n = len(tokens)
    lacks = missing(n, percent)
    hot = np.zeros(n, bool)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        hot = frequent[at] == tokens
    rare = tokens[~hot]
    if len(rare) > lacks:
        return rare[: lacks + SHARED], rare[:0]
    out, often, need = [rare[:0]], tokens[hot], lacks + 1 - len(rare)
    if n <= SMALL_SET:
        out.append(_pairs(often[: need + 1], 1))
    if 5 * n > 4 * SMALL_SET:
        cls = (mix64(often) % np.uint64(SUBCLASSES)).astype(np.int64)
        order = np.argsort(cls, kind="stable")
        rank = np.empty(len(often), np.int64)
        sorted_cls = cls[order]
        rank[order] = np.arange(len(often)) - np.searchsorted(sorted_cls, sorted_cls)
        enough = int(np.searchsorted(np.cumsum(rank > 0), need)) + 1
        out += [_pairs(often[:enough][cls[:enough] == c], 2 + c) for c in range(SUBCLASSES)]
    return rare, np.concatenate(out)


def _pairs(tokens: np.ndarray, salt: int) -> np.ndarray:
    a, b = np.triu_indices(len(tokens), 1)
    return mix64(tokens[a] * np.uint64(0x9FB21C651E98DF25) + mix64(tokens[b]) + np.uint64(salt))


def _set_id(tokens: np.ndarray) -> int:
    return int(mix64(mix64(tokens).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(tokens)))[0].astype(np.int64)) if len(tokens) else 0


#: Words of 64 bits of a set's odd sketch: each element flips one bit, so sets differ in as many elements at least as sketches in bits.
SKETCH = 8
_SKETCH = [f"k{i}" for i in range(SKETCH)]
_SETS = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "set_id", "n")])


def _sketch(tokens: np.ndarray) -> np.ndarray:
    bits = np.bincount((tokens >> np.uint64(20)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, np.concatenate(rows or [np.zeros(0, np.uint64)]).view(np.int64))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")


def shingle_sets(docs: DataFrame, k: int, with_tokens: bool, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, set_id, n (set size), and tokens, the set's sorted hashes, or else its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_slices(batches, "text"):
            sets = shingles(Words(data, offsets), rows.num_rows, k)
            found = [rows.column(0), pa.array([_set_id(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())]
            extra = [_lists(sets)] if with_tokens else [pa.array(c) for c in np.array([_sketch(s) for s in sets]).T]
            yield pa.RecordBatch.from_arrays([*found, *extra], ["doc_id", "set_id", "n", *(["tokens"] if with_tokens else _SKETCH)])

    more = [T.StructField("tokens", T.ArrayType(T.LongType()))] if with_tokens else [T.StructField(c, T.LongType()) for c in _SKETCH]
    return _texts(docs, id_col, text_col).mapInArrow(run, T.StructType([*_SETS.fields, *more]))


def _frequent(docs: DataFrame, k: int, total: int, id_col: str, text_col: str) -> DataFrame:
    """t: hashes of frequent shingles of all documents.

    Each task sorts its shingles and deals them by ranges of hashes, so that a
    range of bounded size is counted in one sort.
    """
    ranges = max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // COUNTED_AT_ONCE))
    bounds = (np.arange(1, ranges, dtype=object) * (1 << 64) // ranges).astype(np.uint64)

    def dealt(tokens: list[np.ndarray]) -> pa.RecordBatch:
        own = np.sort(np.concatenate(tokens))
        first = np.concatenate(([True], own[1:] != own[:-1]))
        at = np.flatnonzero(first)
        own, counts = own[at], np.diff(np.concatenate((at, [len(own)]))).astype(np.uint32)
        cuts = [0, *np.searchsorted(own, bounds).tolist(), len(own)]
        rows = [(r, own[a:b].tobytes(), counts[a:b].tobytes() if counts[a:b].max() > 1 else b"") for r, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["r", "t", "c"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for rows, data, offsets in text_slices(batches, "text"):
            held += shingles(Words(data, offsets), rows.num_rows, k)
            size += sum(map(len, held[-rows.num_rows :]))
            if size >= COUNTED_AT_ONCE:
                yield dealt(held)
                held, size = [], 0
        if size:
            yield dealt(held)

    def count(table: pa.Table) -> pa.Table:
        tokens, times = [], []
        for t, c in zip(table.column("t").to_pylist(), table.column("c").to_pylist(), strict=True):
            tokens.append(np.frombuffer(t, np.uint64))
            times.append(np.frombuffer(c, np.uint32) if c else np.ones(len(t) // 8, np.uint32))
        own, df = np.concatenate(tokens), np.concatenate(times)
        order = np.argsort(own)
        own, df = own[order], df[order].astype(np.int64)
        at = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        df = np.add.reduceat(df, at)
        often = df >= FREQUENT_FROM
        return pa.table({"t": own[at][often].view(np.int64)})

    return _texts(docs, id_col, text_col).mapInArrow(deal, "r int, t binary, c binary").groupBy("r").applyInArrow(count, "t long")


class Hot:
    """Frequent shingles as each task gets them: all, sorted, if they are FREQUENT_MOST at most; else joined to the documents that hold them.

    Either way the same shingles are frequent, those of FREQUENT_FROM documents or more.
    """

    def __init__(self, docs: DataFrame, k: int, total: int, id_col: str, text_col: str):
        self.table = Stored(_frequent(docs, k, total, id_col, text_col), "frequent")
        self.sent, self.lists = None, None
        if self.table.df.count() <= FREQUENT_MOST:
            found = self.table.df.toArrow().column("t").to_numpy().astype(np.int64)
            self.sent = docs.sparkSession.sparkContext.broadcast(np.sort(found.view(np.uint64)))
        else:
            held = shingle_sets(docs, k, True, id_col, text_col).select("doc_id", F.explode("tokens").alias("t"))
            self.lists = held.join(self.table.df, "t").groupBy("doc_id").agg(F.collect_set("t").alias("hot"))

    def drop(self) -> None:
        self.table.drop()
        if self.sent is not None:
            self.sent.unpersist()


def _postings(docs: DataFrame, k: int, percent: int, hot: Hot, id_col: str, text_col: str) -> DataFrame:
    """sig, set_id, n (set size), m (rare shingles indexed), rare (whether sig is one): the index. A task emits a set that it remembers once."""
    sent = hot.sent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for rows, data, offsets in text_slices(batches, "text"):
            own = rows.column(2) if sent is None else None
            sigs, ids, sizes, counts, kinds = [], [], [], [], []
            for i, s in enumerate(shingles(Words(data, offsets), rows.num_rows, k)):
                if len(s) > 1 and missing(len(s) + missing(len(s), percent) + 1, percent) > 0:
                    set_id = _set_id(s)
                    if set_id in seen:
                        continue
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(set_id)
                    often = sent.value if own is None else np.sort(np.array(own[i].as_py() or [], np.int64).view(np.uint64))
                    rare, pairs = signatures(s, often, percent)
                    n = len(rare) + len(pairs)
                    sigs += [rare, pairs]
                    ids.append(np.full(n, set_id, np.int64))
                    sizes.append(np.full(n, len(s), np.int32))
                    counts.append(np.full(n, len(rare), np.int32))
                    kinds.append(np.arange(n) < len(rare))
            if sigs:
                columns = [np.concatenate(x) for x in (sigs, ids, sizes, counts, kinds)]
                for i in range(0, len(columns[0]), 1 << 18):
                    own_rows = [c[i : i + (1 << 18)] for c in columns]
                    yield pa.RecordBatch.from_arrays([pa.array(own_rows[0].view(np.int64)), *map(pa.array, own_rows[1:])], ["sig", "set_id", "n", "m", "rare"])

    texts = _texts(docs, id_col, text_col)
    if sent is None:
        texts = texts.join(hot.lists, "doc_id", "left")
    return texts.mapInArrow(run, "sig long, set_id long, n int, m int, rare boolean")


def _index(docs: DataFrame, k: int, percent: int, hot: Hot, id_col: str, text_col: str) -> DataFrame:
    """sig, set_id, n, m, rare, most: the postings that may link their set with another one.

    A rare shingle stands in fewer than FREQUENT_FROM documents, so its rows go to one task
    and those without a partner go. Rows of pairs are dealt by their set as well, however
    many sets have the pair. Rare shingles that no other set has are none of an
    overlap, so `most` bounds it; sets that even so cannot link are left out.
    """
    posted = _postings(docs, k, percent, hot, id_col, text_col).withColumn("salt", F.when(F.col("rare"), F.lit(0).cast("long")).otherwise(F.col("set_id")))
    bucket = Window.partitionBy("sig", "salt")
    shared = posted.withColumns({"low": F.min("set_id").over(bucket), "high": F.max("set_id").over(bucket)}).where("not rare or low < high")
    shared = shared.dropDuplicates(["sig", "salt", "set_id"]).drop("salt", "low", "high")
    matched = F.sum(F.col("rare").cast("int")).over(Window.partitionBy("set_id"))  # a set has no more rows than elements
    most = (F.col("n") - F.col("m") + matched).cast("int")
    return shared.withColumn("most", most).where(f"{100 + percent} * most >= {percent} * (n + ceil({percent} * n / 100))")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) of set ids those whose whole sets reach the similarity."""
    one = sets.select(F.col("set_id").alias("a"), F.col("tokens").alias("ta"))
    two = sets.select(F.col("set_id").alias("b"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb")).cast("long")
    return (
        pairs.join(two, "b").join(one, "a").select("a", "b", both.alias("i"), F.size("ta").alias("na"), F.size("tb").alias("nb"))
        .where(f"100 * i >= {percent} * (na + nb - i)").select("a", "b")
    )


def _meetings(part: DataFrame, may: str) -> DataFrame:
    """x, y: sets of different parts in one bucket of which `may` holds, a condition on sets; at each rare signature that they share, at frequent pairs as few times as they can.

    Where their least frequent pairs of a class are the same, they share that pair, so the first such class tells
    the one bucket that they meet in. Sets without such a class meet in each bucket that they share.
    """
    classes = range(LEAST_OF)
    least = part.where("not rare").groupBy("set_id").agg(*(F.min(F.expr(f"if(pmod(sig, {LEAST_OF}) = {i}, sig, null)")).alias(f"l{i}") for i in classes))
    part = part.join(least, "set_id", "left")
    same = ", ".join(f"if(x.l{i} = y.l{i}, x.l{i}, null)" for i in classes)
    once = f"coalesce({same}, x.sig) = x.sig"
    return part.alias("x").join(part.alias("y"), F.expr(f"x.sig = y.sig and x.set_id < y.set_id and x.part <> y.part and (x.rare or {once}) and {may}"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", count_links: bool = False) -> DataFrame:
    """One row per document: doc_id, n_shingles, set_id, component_id, and n_links if count_links.

    component_id is the smallest doc_id that links reach, the document's own if
    none. n_links is the number of other documents that reach the similarity,
    equal ones among them. Components need a few links of a large group only;
    to count links all its candidate pairs are verified, which takes time and
    disk in proportion to the square of the group.
    """
    known = Stored(shingle_sets(docs, k, False, id_col, text_col).groupBy("doc_id").agg(F.min(F.struct("set_id", "n", *_SKETCH)).alias("s")).select("doc_id", "s.*"), "sets")
    classes = known.df.where("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies"), *(F.first(c).alias(c) for c in _SKETCH))
    classes = Stored(classes, "classes")
    hot = Hot(docs, k, known.df.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], id_col, text_col)
    held = Stored(_index(docs, k, percent, hot, id_col, text_col), "index")
    hot.drop()
    index = held.df
    total = index.count()

    def can(x: str, y: str) -> str:
        """Whether sets of such sizes and bounds may reach the similarity."""
        return f"{100 + percent} * least({x}most, {y}most) >= {percent} * ({x}n + {y}n)"

    def enough(x: str, y: str) -> str:
        """Of the set whose indexed beginning ends first, all that the other one has no match for is lacking: c of them match."""
        return f"{100 + percent} * (c + greatest({x}n - {x}m, {y}n - {y}m)) >= {percent} * ({x}n + {y}n)"

    def close(x: str, y: str) -> str:
        """Sketches differ in no more bits than elements may."""
        differ = " + ".join(f"bit_count({x}{c} ^ {y}{c})" for c in _SKETCH)
        return f"{100 + percent} * ({x}n + {y}n - ({differ})) >= {2 * percent} * ({x}n + {y}n)"

    def verified(pairs: DataFrame) -> Stored:
        """Of pairs (a, b) of set ids those whose whole sets reach the similarity; only sets that stand in a pair are built, from one document each."""
        ends = Stored(pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct().join(classes.df, "set_id").select(F.col("low").alias("doc_id")), "ends")
        keep = _texts(docs, id_col, text_col).join(small_side(ends.df), "doc_id", "left_semi")
        sets = shingle_sets(keep, k, True).select("set_id", "tokens").dropDuplicates(["set_id"])
        links = Stored(_verified(pairs, sets, percent), "links")
        ends.drop()
        return links

    def pivots(part: DataFrame, turn: int) -> DataFrame:
        """(a, b): each set b of a bucket with a set a of another part, the first of its share of the bucket; of those of a set the PARTNERS that share most.

        In the first turn a bucket is one share, later shares of about MANY sets are dealt anew in each turn.
        """
        share = F.lit(0).cast("long") if turn == 0 else F.pmod(F.xxhash64("set_id", F.lit(turn)), F.greatest(F.lit(1).cast("long"), F.col("members") / F.lit(MANY)).cast("long"))
        dealt = part.withColumn("share", share)
        first = dealt.groupBy("sig", "share").agg(F.min(F.struct(F.xxhash64("set_id", F.lit(turn)).alias("order"), "set_id", "n", "m", "most", "part")).alias("p"))
        pairs = dealt.join(first, ["sig", "share"]).where("part <> p.part").where(can("", "p."))
        pairs = pairs.groupBy(F.col("p.set_id").alias("a"), F.col("set_id").alias("b")).agg(F.sum("times").alias("c"))
        if turn == 0:
            return pairs.groupBy("b").agg(F.max_by("a", F.struct("c", "a")).alias("a")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        ranked = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("c"), "a"))  # a set has a partner for each of its signatures at most
        return pairs.withColumn("rn", ranked).where(f"rn <= {PARTNERS}").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def parted(rows: DataFrame, label: DataFrame) -> DataFrame:
        """Rows with the part of their set: its component so far, or the set itself."""
        return rows.join(small_side(label), rows.set_id == label.id, "left").select(*rows.columns, F.coalesce("component", "set_id").alias("part"))

    def mixed(part: DataFrame) -> Stored:
        """The index with parts, without buckets whose sets are all in one, and members of the bucket.

        Buckets of the same sets are one, which counts so many times: sets that share a hundred signatures meet once.
        """
        by_part = part.groupBy("sig", "part").agg(F.count("*").alias("c"), *(F.bit_xor(F.xxhash64("set_id", "rare", F.lit(i))).alias(f"h{i}") for i in (0, 1)))
        buckets = by_part.groupBy("sig").agg(F.sum("c").alias("members"), F.count("*").alias("parts"), *(F.bit_xor(h).alias(h) for h in ("h0", "h1")))
        buckets = buckets.where("parts > 1").groupBy("members", "h0", "h1").agg(F.min("sig").alias("sig"), F.count("*").alias("times"))
        return Stored(part.join(buckets.select("sig", "members", "times"), "sig"), "mixed")

    def cost(part: DataFrame) -> float:
        """Pairs of sets of different parts, bucket by bucket."""
        by_part = part.groupBy("sig", "part").agg(F.count("*").alias("c"))
        buckets = by_part.groupBy("sig").agg(F.sum("c").alias("members"), F.sum(F.col("c") * F.col("c")).alias("squares"))
        return buckets.agg(F.coalesce(F.sum((F.col("members") * F.col("members") - F.col("squares")) / 2), F.lit(0.0))).first()[0]

    links: list[Stored] = []
    label: Stored | None = None
    tried = None
    part = index.withColumns({"part": F.col("set_id"), "times": F.lit(1).cast("long")})
    for turn in range(ROUNDS):
        if count_links:
            break
        asked = pivots(part, turn)
        asked = Stored(asked if tried is None else asked.join(tried, ["a", "b"], "left_anti"), "tried")
        tried = asked.df if tried is None else tried.unionByName(asked.df)
        links.append(verified(asked.df))
        made, found = asked.df.count(), links[-1].df.count()
        if label is not None:
            label.drop()
        label = components(reduce(DataFrame.unionByName, [x.df for x in links]))
        if turn:  # parts only grow, so what the first turn left out stays out
            apart = Stored(parted(own.df.drop("part"), label.df), "mixed")
            own.drop()
        else:
            apart = mixed(parted(index, label.df))
        own, part = apart, apart.df
        if 10 * found < made or cost(part) <= AFFORDED * total:
            break

    # Sets that share a bucket and are still apart, pair by pair: this is exact for whatever the pivots left. For the links, all that share one.
    part = part.join(classes.df.select("set_id", *_SKETCH), "set_id")
    pairs = (
        _meetings(part, f"{can('x.', 'y.')} and {close('x.', 'y.')}")
        .selectExpr("x.set_id as a", "y.set_id as b", "x.n as xn", "x.m as xm", "y.n as yn", "y.m as ym", "if(x.rare, x.times, 0) as rare")
        .groupBy("a", "b", "xn", "xm", "yn", "ym").agg(F.sum("rare").alias("c"))
        .where(enough("x", "y")).select("a", "b")
    )
    pairs = Stored(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
    links.append(verified(pairs.df))
    linked = reduce(DataFrame.unionByName, [x.df for x in links])
    last = components(linked)

    grouped = classes.df.join(small_side(last.df), classes.df.set_id == last.df.id, "left").select("set_id", "low", "copies", F.coalesce("component", "set_id").alias("part"))
    whole = grouped.groupBy("part").agg(F.min("low").alias("component_id"))
    named = grouped.join(whole, "part").select("set_id", "copies", "component_id")
    n_links = F.lit(0).cast("long")
    if count_links:
        sides = linked.select("a", "b").unionByName(linked.select(F.col("b").alias("a"), F.col("a").alias("b")))
        others = sides.join(classes.df.select(F.col("set_id").alias("b"), "copies"), "b").groupBy(F.col("a").alias("set_id")).agg(F.sum("copies").alias("links"))
        named = named.join(others, "set_id", "left")
        n_links = F.coalesce(F.col("copies") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("long")
    found = known.df.join(named, "set_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), "set_id", F.coalesce("component_id", "doc_id").alias("component_id"), n_links.alias("n_links")
    )
    result = stored(found if count_links else found.drop("n_links"), "near")
    for table in (known, classes, held, pairs, last, *links, *([label, own] if label is not None else [])):
        table.drop()
    return result


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those whose component has a smaller doc_id; all columns stay, rows with a null id too."""
    found = near_duplicates(docs, k, percent, id_col, text_col)
    name = columns(["gone"], docs.columns)["gone"]
    gone = stored(found.where("component_id <> doc_id").select(F.col("doc_id").alias(name)), "gone")
    return docs.join(small_side(gone), docs[id_col].cast("long") == gone[name], "left_anti")

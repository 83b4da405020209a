"""Freezing datasets without leaks: families, splits, admission, duplicates, manifests."""

from __future__ import annotations

import math
import re
import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treeline.functions.text import collapse, template_signature
from treeline.operators.ranking import ranked


#: Groups up to which their totals are sent to every task.
BROADCAST_GROUPS = 100_000


def stored(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, in the folder that the cluster names; one of this machine only where all of Spark runs in one process."""
    context = df.sparkSession.sparkContext
    if not df.sparkSession.conf.get("spark.checkpoint.dir", None) and context.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="treeline-"))
    return df.checkpoint()


def families(rows: DataFrame, key: str, tokens: list[str]) -> DataFrame:
    """(key, family): rows that share a value in any token column, directly or through others, have one family, their smallest key.

    Labels run over the bipartite graph of rows and values, and jump to the
    label of their own label in each round, until nothing changes.
    """
    parts = [rows.select(F.col(key).alias("k"), F.concat(F.lit(f"{t}:"), F.col(t).cast("string")).alias("v")).where(F.col(t).isNotNull()) for t in tokens]
    links = parts[0]
    for p in parts[1:]:
        links = links.unionByName(p)
    links = stored(links.distinct())
    label = stored(rows.select(F.col(key).alias("k")).distinct().withColumn("f", F.col("k")))
    while True:
        value = links.join(label, "k").groupBy("v").agg(F.min("f").alias("f"))
        near = links.join(value, "v").groupBy("k").agg(F.min("f").alias("g"))
        new = label.join(near, "k", "left").select("k", F.col("f").alias("old"), F.least("f", "g").alias("f"))
        jump = new.select(F.col("k").alias("j"), F.col("f").alias("h"))
        new = stored(new.join(jump, F.col("f") == F.col("j"), "left").select("k", "old", F.least("f", "h").alias("f")))
        label = new.select("k", "f")
        if new.where("old <> f").limit(1).count() == 0:
            return label.select(F.col("k").alias(key), F.col("f").alias("family"))


def split_sizes(n: int) -> tuple[int, int]:
    """(test, dev) families of n: 15 % each, rounded half to even, one at least from three and two families on; one is left to train."""
    test = max(1, round(0.15 * n)) if n >= 3 else 0
    dev = max(1, round(0.15 * n)) if n >= 2 else 0
    return test, max(0, min(dev, n - test - 1))


def family_split(grouped: DataFrame, seed: str) -> DataFrame:
    """Adds split: families in an order hashed with the seed give the first ones to test, the next to dev, the rest to train."""
    n = grouped.select("family").distinct().count()
    test, dev = split_sizes(n)
    order = grouped.select("family").distinct().withColumn("h", F.sha2(F.concat(F.lit(seed + "|"), F.col("family").cast("string")), 256))
    top = ranked(order, ["h", "family"], "r").where(F.col("r") <= test + dev)
    top = top.select("family", F.when(F.col("r") <= test, "test").otherwise("dev").alias("split"))
    return grouped.join(top, "family", "left").withColumn("split", F.coalesce("split", F.lit("train")))


def disjoint(train: DataFrame, dev: DataFrame, on: list[str]) -> DataFrame:
    """What both have: empty if the split leaks nothing."""
    return train.select(*on).intersect(dev.select(*on))


def inventory(captures: DataFrame, order: str, path: str, sha: str, ok: Column) -> DataFrame:
    """status ready, duplicate or skipped, and of which row one is a duplicate: first seen by path or by hash wins."""
    good = captures.where(ok)
    by_hash, by_path = good.groupBy(sha).agg(F.min(order).alias("_h")), good.groupBy(path).agg(F.min(order).alias("_p"))
    first = F.least("_h", "_p")
    good = good.join(by_hash, sha).join(by_path, path)
    good = good.select(*captures.columns, F.when(first < F.col(order), "duplicate").otherwise("ready").alias("status"), F.when(first < F.col(order), first).alias("duplicate_of"))
    bad = captures.where(~F.coalesce(ok, F.lit(False))).select(*captures.columns, F.lit("skipped").alias("status"), F.lit(None).cast(captures.schema[order].dataType).alias("duplicate_of"))
    return good.unionByName(bad)


def duplicate_gate(rows: DataFrame, key: str, digest: str, accepted: Column) -> DataFrame:
    """duplicate: whether an earlier accepted row has the same digest. The least key of a digest is an aggregate, so a digest that many rows have is no task of its own."""
    first = rows.where(accepted).groupBy(F.col(digest).alias("_d")).agg(F.min(key).alias("_f"))
    return rows.join(first, F.col(digest) == F.col("_d"), "left").withColumn("duplicate", F.coalesce(F.col(key) > F.col("_f"), F.lit(False))).drop("_d", "_f")


def admission(rows: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """reasons why a row stays out, in the order given, and accepted if there are none."""
    found = F.array_compact(F.array(*(F.when(c, F.lit(r)) for r, c in reasons.items())))
    return rows.withColumn("reasons", found).withColumn("accepted", F.size("reasons") == 0)


def manifest(rows: DataFrame) -> DataFrame:
    """(item, n): rows by outcome and by reason."""
    by = rows.groupBy(F.when(F.col("accepted"), "accepted").otherwise("rejected").alias("item")).count()
    why = rows.select(F.explode("reasons").alias("r")).groupBy(F.concat(F.lit("reason:"), F.col("r")).alias("item")).count()
    return by.unionByName(why).withColumnRenamed("count", "n")


def seeded_sample(rows: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """n rows in an order hashed with the seed."""
    return rows.withColumn("_h", F.sha2(F.concat(F.lit(seed + "|"), F.col(key).cast("string")), 256)).orderBy("_h", key).limit(n).drop("_h")


def length_admission(rows: DataFrame, tokens: Column, limit: int) -> DataFrame:
    """Rows beyond the limit are marked and kept out, never cut."""
    return rows.withColumns({"n_tokens": tokens, "reason": F.when(tokens > limit, F.lit("overlength"))})


def weighted_nll(rows: DataFrame, by: list[str], loss: str, tokens: str) -> DataFrame:
    return rows.groupBy(*by).agg((F.sum(F.col(loss) * F.col(tokens)) / F.sum(tokens)).alias("nll"))


def template_of(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(doc_id, signature): hash of a page's start and end tags with classes, roles and types."""
    return pages.select(F.col(id_col).alias("doc_id"), template_signature(F.col(html_col)).alias("signature"))


def document_digest(text: Column) -> Column:
    return F.sha2(collapse(text), 256)


def budget_split(rows: DataFrame, budget: int, by: list[str], order: str) -> DataFrame:
    """Adds share: an even split of the budget, the first ones getting what is left over.

    Places come from range partitions of the whole table, so a group of any size is no task of its own.
    """
    n = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    at = ranked(rows, [*by, order], "_r")
    first = at.groupBy(*by).agg(F.min("_r").alias("_f"))
    j = at.join(F.broadcast(n.join(first, by)), by) if n.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS else at.join(n.join(first, by), by)
    share = F.floor(F.lit(budget) / F.col("_n")) + (F.col("_r") - F.col("_f") < F.lit(budget) % F.col("_n")).cast("int")
    return j.withColumn("share", share.cast("long")).drop("_n", "_r", "_f")


def median_of(values: list[float]) -> float | None:
    if not values:
        return None
    s, m = sorted(values), len(values) // 2
    return s[m] if len(values) % 2 else (s[m - 1] + s[m]) / 2


def nearest_rank(values: list[float], q: float = 0.9) -> float | None:
    return sorted(values)[math.ceil(q * len(values)) - 1] if values else None

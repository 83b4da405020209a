"""Costs of moving through a page: linear stops, jumps between like elements, and hierarchies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treeline.operators.observe import is_hidden, target_kind
from treeline.operators.tree import without_subtrees


def targets(nodes: DataFrame) -> DataFrame:
    """Elements that users go to, with kind and three running numbers: stop, place among its kind, place among fields and buttons."""
    found = without_subtrees(nodes, is_hidden()).withColumn("target", target_kind()).where("target is not null")
    w = Window.partitionBy("doc_id").orderBy("pre")
    kind = Window.partitionBy("doc_id", "target").orderBy("pre")
    form = F.col("target").isin("field", "button").cast("int")
    return found.select("doc_id", "node", "pre", "end", "depth", "tag", "target", "attributes").withColumns({
        "stop": F.row_number().over(w), "ordinal": F.row_number().over(kind), "form_ordinal": F.when(form == 1, F.sum(form).over(w)),
    })


def jump_cost(found: DataFrame) -> DataFrame:
    """targets with cost: a direct scan of its kind, or to an earlier heading and on from there if that is strictly cheaper.

    Fields are scanned among fields and buttons. A heading h at ordinal o costs
    o + (targets of the kind after h), so a running minimum of o minus the kind's
    count at h settles all headings in one window.
    """
    w = Window.partitionBy("doc_id").orderBy("pre")
    before = w.rowsBetween(Window.unboundedPreceding, -1)

    def route(direct: Column, running: Column) -> Column:
        best = F.min(F.when(F.col("target") == "heading", F.col("ordinal") - running)).over(before)
        return F.least(direct, F.coalesce(best + direct, direct))

    counts = {k: F.sum((F.col("target") == k).cast("int")).over(w) for k in ("link", "button")}
    out = found.withColumns({"_link": counts["link"], "_button": counts["button"], "_form": F.sum(F.col("target").isin("field", "button").cast("int")).over(w)})
    cost = (
        F.when(F.col("target") == "heading", F.col("ordinal")).when(F.col("target") == "link", route(F.col("ordinal"), F.col("_link")))
        .when(F.col("target") == "button", route(F.col("ordinal"), F.col("_button"))).otherwise(route(F.col("form_ordinal"), F.col("_form")))
    )
    return out.withColumn("jump", cost.cast("long")).drop("_link", "_button", "_form")


def summary(costs: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Count, median (middle of two), nearest-rank 90th percentile and mean; null for no rows.

    Rows are counted by distinct value before anything is gathered, so a group of
    any size costs its distinct values, spread over partitions by value; ranks
    come from running counts.
    """
    counted = costs.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*by).orderBy(value)
    total = F.sum("_c").over(Window.partitionBy(*by))
    c = counted.withColumns({"_hi": F.sum("_c").over(w), "_n": total}).withColumn("_lo", F.col("_hi") - F.col("_c"))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_lo") < rank) & (rank <= F.col("_hi")), F.col(value)))

    n = F.col("_n")
    low, high = F.floor((n + 1) / 2), F.floor(n / 2) + 1
    found = c.groupBy(*by).agg(F.sum("_c").alias("n"), ((at(low) + at(high)) / 2).cast("double").alias("median"), at(F.ceil(n * 9 / 10)).alias("p90"), (F.sum(F.col(value) * F.col("_c")) / F.sum("_c")).alias("mean"))
    groups = costs.select(*by).distinct()
    return groups.join(found, by, "left").fillna(0, ["n"])


def hierarchy_cost(found: DataFrame, leaf_refs: DataFrame) -> DataFrame:
    """(doc_id, node, steps): targets against leaves (doc_id, ref, cost) of a hierarchy; the cheapest owner counts, null if there is none."""
    best = leaf_refs.groupBy("doc_id", F.col("ref").alias("node")).agg(F.min("cost").alias("steps"))
    return found.select("doc_id", "node").join(best, ["doc_id", "node"], "left")


def coverage(costs: DataFrame) -> DataFrame:
    """Share of targets that the hierarchy reaches, in percent; null without targets."""
    return costs.groupBy("doc_id").agg(F.count("*").alias("eligible"), F.count("steps").alias("mapped"), F.expr("try_divide(count(steps) * 100.0, count(*))").alias("percent"))

"""From files to tables: pages to their observations, views and artifacts, captures to datasets, and the operations by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.operators import compaction, dataset, observe, reports, tree, views
from treeline.sources import html, records


def read_pages(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(page_id, url, html, source_hash) of HTML files; ids follow the order of paths."""
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("html"))
    number = F.dense_rank().over(_by_path()) - 1
    return files.withColumn("page_id", number.cast("long")).select("page_id", "url", "html", html.source_hash(F.col("html")).alias("source_hash"))


def _by_path():  # noqa: ANN202
    from pyspark.sql.window import Window

    return Window.orderBy("url")  # a row for each file


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Node tables that were written before, in place of HTML."""
    return spark.read.parquet(path)


def snapshot_id(pages: DataFrame) -> str:
    """Identity of a set of pages: hash of their hashes in order, with lengths before them."""
    rows = pages.select("page_id", "source_hash").orderBy("page_id").toArrow()  # a row for each file
    return records.snapshot_id([h.encode() for h in rows.column("source_hash").to_pylist()])


def artifacts(pages: DataFrame, folder: str, profile: str = "structure", max_bytes: int = 200_000) -> DataFrame:
    """Writes pages, nodes, observation, relations, view, ledger, gaps and navigation below a folder that must not exist, and gives the manifest."""
    nodes = html.nodes(pages, context=True)
    return records.snapshot({
        "pages": pages, "nodes": nodes.drop("context"), "observation": observe.observe(nodes), "relations": observe.relations(nodes), "views": views.views(nodes, profile, max_bytes),
        "ledger": views.view_ledger(nodes, profile, max_bytes), "gaps": views.view_gaps(nodes, profile, max_bytes), "navigation": views.navigation(nodes, profile, max_bytes),
    }, folder)


#: What a caller may ask for by name, over node tables.
OPERATIONS: dict[str, Callable[..., DataFrame]] = {
    "adapt": observe.observe, "pipeline": views.views, "compact": compaction.compact_html, "expand": views.expanded_views, "validate": tree.forest_errors, "navigation": views.navigation,
    "references": reports.reference_findings, "navigation-references": reports.reference_findings,
}


def operate(name: str, *tables: DataFrame, **parameters: object) -> DataFrame:
    """An operation by its name."""
    if name not in OPERATIONS:
        raise ValueError(f"no operation {name}; there are {', '.join(OPERATIONS)}")
    return OPERATIONS[name](*tables, **parameters)


def dataset_findings(nodes: DataFrame, hierarchies: DataFrame) -> DataFrame:
    """(doc_id, finding, id) over captures (doc_id, node, parent) and hierarchies (doc_id, variant, id, parent, source_refs): broken trees, and references that name no node."""
    key = F.col("node").cast("string")
    edges = nodes.where("parent is not null and parent >= 0").select("doc_id", F.col("parent").cast("string").alias("parent"), key.alias("child"))
    out = tree.forest_errors(edges, nodes.select("doc_id", key.alias("node"))).select("doc_id", F.col("error").alias("finding"), F.col("node").alias("id"))
    own = F.concat_ws("/", "variant", "id")
    links = hierarchies.where("parent is not null").select("doc_id", F.concat_ws("/", "variant", "parent").alias("parent"), own.alias("child"))
    out = out.unionByName(tree.forest_errors(links, hierarchies.select("doc_id", own.alias("node"))).select("doc_id", F.col("error").alias("finding"), F.col("node").alias("id")))
    refs = hierarchies.select("doc_id", own.alias("id"), F.explode("source_refs").alias("node"))
    return out.unionByName(refs.join(nodes.select("doc_id", key.alias("node")), ["doc_id", "node"], "left_anti").select("doc_id", F.lit("dangling reference").alias("finding"), "id").distinct())


def build_dataset(nodes: DataFrame, hierarchies: DataFrame, folder: str) -> DataFrame:
    """Writes captures, hierarchies and a catalog below a folder that must not exist, if nothing is wrong with any of them; gives the manifest."""
    wrong = dataset_findings(nodes, hierarchies).limit(5).collect()
    if wrong:
        raise ValueError("; ".join(f"{r.doc_id}: {r.finding} {r.id}" for r in wrong))
    size = nodes.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n_nodes"))
    catalog = records.catalogued(hierarchies.select(F.col("doc_id").alias("id"), "variant").distinct().join(size, "id"))
    return records.snapshot({"captures": nodes, "hierarchies": hierarchies, "catalog": catalog}, folder)


def compression_findings(source: DataFrame, ledger: DataFrame, emitted: DataFrame) -> DataFrame:
    """(doc_id, node, problem) over sources and ledgers (doc_id, node, tag, parent), and nodes that a compact tree shows: numberings that differ, and shown nodes that the ledger does not retain."""
    parity = tree.parity_errors(source, ledger).select("doc_id", "node", F.concat(F.lit("mapping: "), F.col("error")).alias("problem"))
    return parity.unionByName(reports.retained_difference(ledger, emitted).select("doc_id", "node", F.concat(F.lit("only in "), F.col("side")).alias("problem")))


def compression_dataset(nodes: DataFrame, profiles: dict[str, int], folder: str) -> DataFrame:
    """Writes markup and ledger of each profile (name: bytes) of all pages, checked, with a catalog of sizes; gives the manifest."""
    tables: dict[str, DataFrame] = {}
    sizes = None
    for profile, budget in profiles.items():
        out = compaction.compact_html(nodes, budget, profile)
        tables[f"markup-{profile}"], tables[f"ledger-{profile}"] = out, compaction.ledger(nodes, budget, profile)
        own = out.select("doc_id", F.lit(profile).alias("profile"), "n_bytes", "status", F.size("problems").alias("n_problems"))
        sizes = own if sizes is None else sizes.unionByName(own)
    return records.snapshot({**tables, "catalog": sizes}, folder)


def frozen_splits(rows: DataFrame, key: str, tokens: list[str], seed: str, folder: str) -> DataFrame:
    """Families over shared tokens, their split, and the rows with both, written once."""
    split = dataset.family_split(dataset.families(rows, key, tokens), seed)
    return records.snapshot({"splits": split, "rows": rows.join(split, key)}, folder)

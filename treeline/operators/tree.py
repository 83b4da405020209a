"""Tree operators over interval-encoded tables: doc_id, node, parent, pre, end, depth, sib.

Subtrees are nested intervals, so most operators are windows over document
order: running sums and furthest ends. What needs the nodes open around another
one sweeps over a document with a stack; nothing recurses, and no operator
compares all nodes of a page with each other.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def by_doc() -> Window:
    return Window.partitionBy("doc_id").orderBy("pre")


def _open_around(of: DataFrame, flagged: DataFrame, self_too: bool, all_of_them: bool) -> DataFrame:
    """(doc_id, node, pre, depth, around, distance) for every row of `of`: the flagged nodes open around it, or the nearest one or null.

    One sweep over each document with a stack of open nodes, so time is in proportion to rows in and out.
    """
    columns = ["doc_id", "node", "pre", "end", "depth"]
    marked = flagged.select(*columns, F.lit(True).alias("flag")).unionByName(of.select(*columns, F.lit(False).alias("flag")))

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("pre", "flag", "node", "end", "depth")), strict=True), key=lambda r: (r[0], r[1] != self_too))
        stack: list[tuple[int, int, int]] = []
        out: list[tuple] = []
        for pre, flag, node, end, depth in rows:
            while stack and stack[-1][0] <= pre:
                stack.pop()
            if flag:
                stack.append((end, node, depth))
            elif all_of_them:
                out += [(node, pre, depth, n, depth - d) for _, n, d in stack]
            else:
                out.append((node, pre, depth, *((stack[-1][1], depth - stack[-1][2]) if stack else (None, None))))
        cols = list(zip(*out, strict=True)) or [()] * 5
        doc = pa.array([table.column("doc_id")[0].as_py()] * len(out), pa.int64())
        return pa.Table.from_arrays([doc, *(pa.array(c, pa.int32()) for c in cols)], ["doc_id", "node", "pre", "depth", "around", "distance"])

    return marked.groupBy("doc_id").applyInArrow(run, "doc_id long, node int, pre int, depth int, around int, distance int")


def descendants(roots: DataFrame, nodes: DataFrame, proper: bool = True) -> DataFrame:
    """(doc_id, root, node, pre): what lies below each root, and the root itself unless proper."""
    return _open_around(nodes, roots, not proper, True).select("doc_id", F.col("around").alias("root"), "node", "pre")


def ancestors(of: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, node, ancestor, distance): the path of each node to the root."""
    return _open_around(of, nodes, False, True).select("doc_id", "node", F.col("around").alias("ancestor"), "distance")


def nearest_flagged(of: DataFrame, flagged: DataFrame, self_too: bool = False) -> DataFrame:
    """(doc_id, node, nearest): the closest ancestor among the flagged nodes; null if there is none."""
    return _open_around(of, flagged, self_too, False).select("doc_id", "node", F.col("around").alias("nearest"))


def _covered(excluded: Column) -> Column:
    """Whether an excluded node before, in document order, has not ended yet: intervals nest, so the furthest end tells."""
    return F.coalesce(F.max(F.when(excluded, F.col("end"))).over(by_doc().rowsBetween(Window.unboundedPreceding, -1)) > F.col("pre"), F.lit(False))


def minimal_roots(requested: DataFrame) -> DataFrame:
    """The requested nodes that lie below no other requested node, in document order."""
    return requested.withColumn("_in", _covered(F.lit(True))).where("not _in").drop("_in").orderBy("doc_id", "pre")


def inherited(nodes: DataFrame, value: Column, name: str) -> DataFrame:
    """nodes with the value of the closest node, itself included, that has one."""
    given = nodes.withColumn("_v", value).where("_v is not null")
    near = nearest_flagged(nodes, given, self_too=True)
    values = given.select("doc_id", F.col("node").alias("nearest"), F.col("_v").alias(name))
    return nodes.join(near.join(values, ["doc_id", "nearest"]).drop("nearest"), ["doc_id", "node"], "left")


def without_subtrees(nodes: DataFrame, excluded: Column) -> DataFrame:
    """The nodes that neither are excluded nor lie below one that is."""
    return nodes.withColumn("_x", F.coalesce(excluded, F.lit(False))).withColumn("_in", _covered(F.col("_x"))).where("not _x and not _in").drop("_x", "_in")


def forest_errors(edges: DataFrame, node_ids: DataFrame) -> DataFrame:
    """(doc_id, error, node) for edges (doc_id, parent, child) and nodes (doc_id, node): repeated parents, unknown ends, unreachable or cyclic nodes.

    A node is reachable if the chain of its parents ends at one without a parent.
    The chains double in each round, so rounds follow the logarithm of the depth.
    """
    many = edges.groupBy("doc_id", "child").agg(F.countDistinct("parent").alias("n"), F.count("*").alias("m")).where("m > 1")
    many = many.select("doc_id", F.when(F.col("n") > 1, "several parents").otherwise("repeated child").alias("error"), F.col("child").alias("node"))
    ends = edges.select("doc_id", F.col("parent").alias("node")).unionByName(edges.select("doc_id", F.col("child").alias("node"))).distinct()
    unknown = ends.join(node_ids, ["doc_id", "node"], "left_anti").select("doc_id", F.lit("unknown node").alias("error"), "node")
    up = edges.groupBy("doc_id", "child").agg(F.min("parent").alias("up"))
    chain = node_ids.join(up.withColumnRenamed("child", "node"), ["doc_id", "node"], "left")
    depth = max(1, int(node_ids.groupBy("doc_id").count().agg(F.max("count")).first()[0] or 1).bit_length())
    for _ in range(depth):
        jump = chain.select(F.col("doc_id").alias("_d"), F.col("node").alias("_n"), F.col("up").alias("_u"))
        chain = chain.join(jump, (F.col("doc_id") == F.col("_d")) & (F.col("up") == F.col("_n")), "left").select("doc_id", "node", F.when(F.col("_n").isNotNull(), F.col("_u")).otherwise(F.lit(None)).alias("up"))
    loose = chain.where("up is not null").select("doc_id", F.lit("cycle").alias("error"), "node")
    return many.unionByName(unknown).unionByName(loose)


def path_cost(tree: DataFrame) -> DataFrame:
    """(doc_id, node, cost): the sum over the path from the root of each step's place among its siblings, from 1.

    A running sum over starts, which add a step, and ends, which take it back.
    """
    step = F.when(F.col("depth") > 0, F.col("sib") + 1).otherwise(0)
    starts = tree.select("doc_id", F.col("pre").alias("at"), F.lit(1).alias("start"), "node", step.alias("step"))
    ends = tree.select("doc_id", F.col("end").alias("at"), F.lit(0).alias("start"), F.lit(None).cast(tree.schema["node"].dataType).alias("node"), (-step).alias("step"))
    w = Window.partitionBy("doc_id").orderBy("at", "start").rowsBetween(Window.unboundedPreceding, 0)
    return starts.unionByName(ends).withColumn("cost", F.sum("step").over(w).cast("long")).where("start = 1").select("doc_id", "node", "cost")


def structure(tree: DataFrame) -> DataFrame:
    """Per document: nodes, leaves, deepest level and mean depth of leaves."""
    leaf = F.col("end") == F.col("pre") + 1
    return tree.groupBy("doc_id").agg(
        F.count("*").alias("n_nodes"), F.count_if(leaf).alias("n_leaves"), F.max("depth").alias("max_depth"), F.avg(F.when(leaf, F.col("depth"))).alias("mean_leaf_depth")
    )


def search(tree: DataFrame, text: Column, needle: str) -> DataFrame:
    """The nodes whose text holds the needle in any case, and their ancestors, in document order; hit says which."""
    hit = F.coalesce(F.contains(F.lower(text), F.lit(needle.lower())), F.lit(False))
    next_hit = F.min(F.when(F.col("hit"), F.col("pre"))).over(by_doc().rowsBetween(1, Window.unboundedFollowing))
    marked = tree.withColumn("hit", hit).withColumn("_next", next_hit)
    return marked.where("hit or _next < `end`").select("doc_id", "node", "pre", "depth", "hit")


def flattened(tree: DataFrame, expanded: Column) -> DataFrame:
    """(doc_id, node, position, depth): rows that a tree view shows, in order: those below no closed node."""
    shown = tree.withColumn("_open", F.coalesce(expanded, F.lit(False))).withColumn("_in", _covered(~F.col("_open"))).where("not _in")
    return shown.withColumn("position", F.row_number().over(by_doc())).select("doc_id", "node", "position", "depth")


def sibling_neighbours(tree: DataFrame) -> DataFrame:
    """tree with previous and next sibling."""
    w = Window.partitionBy("doc_id", "parent").orderBy("sib")
    return tree.withColumns({"previous": F.lag("node").over(w), "next": F.lead("node").over(w)})


def preceding_heading(tree: DataFrame, heading: Column) -> DataFrame:
    """tree with the nearest heading before each node among its siblings."""
    w = Window.partitionBy("doc_id", "parent").orderBy("sib").rowsBetween(Window.unboundedPreceding, -1)
    return tree.withColumn("heading", F.last(F.when(heading, F.col("node")), ignorenulls=True).over(w))


def owners(refs: DataFrame) -> DataFrame:
    """(doc_id, ref, owners) from hierarchy nodes with arrays of refs: who owns each source node directly."""
    return refs.select("doc_id", "node", F.explode("refs").alias("ref")).groupBy("doc_id", "ref").agg(F.sort_array(F.collect_set("node")).alias("owners"))


def cross_match(left: DataFrame, right: DataFrame) -> DataFrame:
    """(doc_id, node, match): exact, representative, ambiguous or absent, by source id and then by representative (doc_id, node, representative)."""
    direct = right.groupBy("doc_id", F.col("node").alias("_n")).agg(F.count("*").alias("direct"))
    stand = right.groupBy("doc_id", F.col("representative").alias("_r")).agg(F.countDistinct("node").alias("stand"))
    l = left.join(direct, (left.doc_id == direct.doc_id) & (left.node == F.col("_n")), "left").drop(direct.doc_id)
    l = l.join(stand, (l.doc_id == stand.doc_id) & (l.node == F.col("_r")), "left").drop(stand.doc_id)
    kind = F.when(F.col("direct") == 1, "exact").when((F.col("direct") > 1) | (F.col("stand") > 1), "ambiguous").when(F.col("stand") == 1, "representative").otherwise("absent")
    return l.select("doc_id", "node", kind.alias("match"))


def meaningful_neighbours(tree: DataFrame, blank: Column) -> DataFrame:
    """tree with previous and next sibling that is not blank."""
    w = Window.partitionBy("doc_id", "parent").orderBy("sib")
    own = F.when(~F.coalesce(blank, F.lit(False)), F.col("node"))
    return tree.withColumns({
        "previous": F.last(own, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), "next": F.first(own, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)),
    })


def subtree_refs(tree: DataFrame, refs: DataFrame) -> DataFrame:
    """(doc_id, node, refs): the source refs (doc_id, node, ref) of each node and of all below it, each once, in document order of the first holder."""
    held = descendants(tree, tree, proper=False).join(refs, ["doc_id", "node"])
    first = held.groupBy("doc_id", "root", "ref").agg(F.min("pre").alias("at"))
    listed = F.sort_array(F.collect_list(F.struct("at", "ref")))
    return first.groupBy("doc_id", F.col("root").alias("node")).agg(F.transform(listed, lambda x: x["ref"]).alias("refs"))


def owners_of(sources: DataFrame, refs: DataFrame) -> DataFrame:
    """(doc_id, node, owner, via): hierarchy owners (refs: doc_id, ref, owner) of each source node; of those without, the owners of the nearest owned ancestor, via it."""
    owned = sources.join(refs.select("doc_id", F.col("ref").alias("node")).distinct(), ["doc_id", "node"], "left_semi")
    near = nearest_flagged(sources, owned, self_too=True)
    found = near.join(refs.select("doc_id", F.col("ref").alias("nearest"), "owner"), ["doc_id", "nearest"])
    return found.select("doc_id", "node", "owner", F.when(F.col("nearest") != F.col("node"), F.col("nearest")).alias("via"))


def dual_index(source: DataFrame, ledger: DataFrame) -> DataFrame:
    """(doc_id, node, error): nodes that a ledger leaves out, names without being in the source, or names twice; empty if it covers the source."""
    named = ledger.groupBy("doc_id", "node").agg(F.count("*").alias("n"))
    both = source.select("doc_id", "node", F.lit(1).alias("there")).join(named, ["doc_id", "node"], "full_outer")
    error = F.when(F.col("n").isNull(), "not in the ledger").when(F.col("there").isNull(), "not in the source").when(F.col("n") > 1, "repeated")
    return both.select("doc_id", "node", error.alias("error")).where("error is not null")


def parity_errors(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, node, error) for two numberings of one document (doc_id, node, tag, parent): missing, added, or another tag or parent at the place."""
    e, f = expected.alias("e"), found.alias("f")
    both = e.join(f, (F.col("e.doc_id") == F.col("f.doc_id")) & (F.col("e.node") == F.col("f.node")), "full_outer")
    error = F.when(F.col("f.node").isNull(), "missing").when(F.col("e.node").isNull(), "added").when(F.col("e.tag") != F.col("f.tag"), "tag").when(~F.col("e.parent").eqNullSafe(F.col("f.parent")), "parent")
    return both.select(F.coalesce("e.doc_id", "f.doc_id").alias("doc_id"), F.coalesce("e.node", "f.node").alias("node"), error.alias("error")).where("error is not null")


def selectors(nodes: DataFrame) -> DataFrame:
    """nodes (parsed with context) with path: tags and places among siblings of the tag from the root, as CSS selects them."""
    step = F.concat("tag", F.when(F.col("context.ofTag") > 1, F.concat(F.lit(":nth-of-type("), F.col("context.position").cast("string"), F.lit(")"))).otherwise(""))
    elements = nodes.where("kind = 'element'").withColumn("_step", step)
    above = _open_around(elements, elements, True, True).where("around > 0").select("doc_id", "node", "distance", F.col("around").alias("_a"))
    parts = above.join(elements.select("doc_id", F.col("node").alias("_a"), "_step"), ["doc_id", "_a"])
    steps = F.sort_array(F.collect_list(F.struct((-F.col("distance")).alias("d"), "_step")))
    path = parts.groupBy("doc_id", "node").agg(F.array_join(F.transform(steps, lambda x: x["_step"]), " > ").alias("path"))
    return elements.drop("_step").join(path, ["doc_id", "node"])


def selector_join(captured: DataFrame, paths: DataFrame) -> DataFrame:
    """captured (doc_id, id, css_path, tag) with node: the one element that the path selects, if its tag is the same; null otherwise."""
    one = paths.groupBy("doc_id", F.col("path").alias("css_path")).agg(F.count("*").alias("n"), F.first("node").alias("node"), F.first("tag").alias("_tag")).where("n = 1")
    found = captured.join(one, ["doc_id", "css_path"], "left")
    return found.select("doc_id", "id", F.when(F.col("_tag") == F.lower("tag"), F.col("node")).alias("node"))


def collector_ids(nodes: DataFrame, excluded: Column) -> DataFrame:
    """nodes with number: included ones in document order first, then the excluded ones."""
    w = Window.partitionBy("doc_id").orderBy(F.coalesce(excluded, F.lit(False)), "pre")
    return nodes.withColumn("number", F.row_number().over(w) - 1)


def crosswalk(records: DataFrame, nodes: DataFrame, ref: Column) -> DataFrame:
    """(doc_id, alias, node, ref, conflict): aliases (doc_id, alias, node) to the ref of the nearest node around that has one; conflict tells aliases of several nodes."""
    given = nodes.withColumn("_ref", ref).where("_ref is not null")
    at = records.join(nodes.select("doc_id", "node", "pre", "end", "depth"), ["doc_id", "node"], "left")
    near = nearest_flagged(at.where("pre is not null").select("doc_id", "node", "pre", "end", "depth").distinct(), given, self_too=True)
    named = near.join(given.select("doc_id", F.col("node").alias("nearest"), F.col("_ref").alias("ref")), ["doc_id", "nearest"], "left")
    n = records.groupBy("doc_id", "alias").agg((F.countDistinct("node") > 1).alias("conflict"))
    return records.select("doc_id", "alias", "node").join(named.select("doc_id", "node", "ref"), ["doc_id", "node"], "left").join(n, ["doc_id", "alias"])

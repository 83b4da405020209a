"""Queries of tree operators over a forest made of the star schema: customers hold orders, orders hold lines.

The SQL never sees an interval: it joins customers, orders and lines by their
keys, so it tells by other means what the operators have to find.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treeline.operators import groups, navigation, reports, tree
from treeline.plans.registry import bigints, query, table

_LINE_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus"

#: The forest in SQL: orders o (doc, node, place), lines l (doc, order_node, node, place); the root of a customer is node 0.
FOREST = f"""
n as (select l_orderkey, count(*) as n from lineitem group by 1),
o as (select o_custkey as doc, o_orderkey, o_orderstatus as status, o_orderpriority as priority, coalesce(n, 0) as n, row_number() over w as place, (1 + sum(1 + coalesce(n, 0)) over w - 1 - coalesce(n, 0))::bigint as node
  from orders left join n on l_orderkey = o_orderkey window w as (partition by o_custkey order by o_orderkey)),
l as (select doc, node as order_node, status, priority, o.place as order_place, lineitem.*, row_number() over (partition by l_orderkey order by {_LINE_ORDER}) as place from lineitem join o on o_orderkey = l_orderkey),
ln as (select *, order_node + place as node, row_number() over (partition by doc order by order_node + place) as line_rank from l),
c as (select c_custkey as doc, c_acctbal, coalesce((select sum(1 + n) from o where o.doc = c_custkey), 0) as below from customer)"""


def forest(spark, sf_dir: str) -> DataFrame:
    """Node table of the forest: tags, attributes and texts come from columns of orders and lines."""
    l, o, c = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    lines = l.withColumn("place", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_LINE_ORDER.split(", "))))
    n = l.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    orders = o.join(n, o.o_orderkey == n.l_orderkey, "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumns({"sib": F.row_number().over(w) - 1, "pre": F.sum(F.col("n") + 1).over(w) - F.col("n")})
    total = orders.groupBy("o_custkey").agg(F.sum(F.col("n") + 1).alias("below"))
    none = F.create_map().cast("map<string,string>")

    def some(**values: Column) -> Column:
        return F.map_filter(F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v))), lambda k, v: v.isNotNull())

    def row(doc, node, parent, end, depth, sib, tag, attributes, text) -> list[Column]:  # noqa: ANN001
        kinds = {"node": node, "parent": parent, "pre": node, "end": end, "depth": depth, "sib": sib}
        return [doc.cast("long").alias("doc_id"), *(v.cast("int").alias(k) for k, v in kinds.items()), F.lit("element").alias("kind"), tag.alias("tag"), attributes.alias("attributes"), text.alias("text")]

    root = c.join(total, c.c_custkey == total.o_custkey, "left").select(*row(F.col("c_custkey"), F.lit(0), F.lit(-1), 1 + F.coalesce("below", F.lit(0)), F.lit(0), F.lit(0), F.when(F.col("c_acctbal") > 0, "main").otherwise("body"), none, F.lit("")))
    status = F.when(F.col("o_orderstatus") == "F", "h2").when(F.col("o_orderstatus") == "O", "div").otherwise("nav")
    lang = F.when(F.col("o_orderpriority").rlike("^[12]"), F.substring("o_orderpriority", 1, 1))
    hidden = F.when(F.col("o_orderpriority") == "5-LOW", F.lit(""))
    middle = orders.select(*row(F.col("o_custkey"), F.col("pre"), F.lit(0), F.col("pre") + 1 + F.col("n"), F.lit(1), F.col("sib"), status, some(lang=lang, hidden=hidden), F.lit("")))
    at = orders.select("o_orderkey", "o_custkey", "pre")
    leaf = lines.join(at, lines.l_orderkey == at.o_orderkey)
    tag = F.when(F.col("l_returnflag") == "A", "a").when(F.col("l_returnflag") == "R", "button").otherwise("input")
    given = some(lang=F.when(F.col("l_linenumber") == 3, "x"), href=F.when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F"), F.lit("#")), ref=F.col("l_partkey").cast("string"), steps=F.col("l_quantity").cast("int").cast("string"))
    leaves = leaf.select(*row(F.col("o_custkey"), F.col("pre") + F.col("place"), F.col("pre"), F.col("pre") + F.col("place") + 1, F.lit(2), F.col("place") - 1, tag, given, F.concat("l_returnflag", "l_linestatus")))
    return root.unionByName(middle).unionByName(leaves)


def _orders(n: DataFrame) -> DataFrame:
    return n.where("depth = 1")


def _lines(n: DataFrame) -> DataFrame:
    return n.where("depth = 2")


@query(f"with {FOREST} select doc as doc_id, node, order_node as ancestor, 1::bigint as distance from ln union all select doc, node, 0, 2 from ln")
def tree_ancestors(spark, sf_dir):
    n = forest(spark, sf_dir)
    return bigints(tree.ancestors(_lines(n), n))


@query(f"with {FOREST} select doc as doc_id, node as root, n::bigint as n from o where status = 'F' and n > 0")
def tree_descendants(spark, sf_dir):
    n = forest(spark, sf_dir)
    return bigints(tree.descendants(n.where("tag = 'h2'"), n).groupBy("doc_id", "root").agg(F.count("*").alias("n")))


@query(f"with {FOREST} select ln.doc as doc_id, node, case when status = 'O' then order_node when c_acctbal > 0 then 0 end as nearest from ln join c using (doc)")
def tree_nearest_flagged(spark, sf_dir):
    n = forest(spark, sf_dir)
    return bigints(tree.nearest_flagged(_lines(n), n.where("tag in ('div', 'main')")))


@query(f"with {FOREST} select doc as doc_id, node, case when l_linenumber = 3 then 'x' when priority[1] in ('1', '2') then priority[1] end as lang from ln")
def tree_inherited(spark, sf_dir):
    n = forest(spark, sf_dir)
    return bigints(tree.inherited(n, F.col("attributes")["lang"], "lang").where("depth = 2").select("doc_id", "node", "lang"))


@query(f"with {FOREST} select doc as doc_id, node from ln where priority <> '5-LOW' union all select doc, node from o where priority <> '5-LOW' union all select doc, 0 from c")
def tree_without_subtrees(spark, sf_dir):
    return bigints(tree.without_subtrees(forest(spark, sf_dir), F.col("attributes")["hidden"].isNotNull()).select("doc_id", "node"))


@query(f"with {FOREST} select doc as doc_id, node from o where status = 'F' union all select doc, node from ln where l_returnflag = 'R' and status <> 'F'")
def tree_minimal_roots(spark, sf_dir):
    return bigints(tree.minimal_roots(forest(spark, sf_dir).where("tag in ('h2', 'button')")).select("doc_id", "node"))


@query(f"with {FOREST} select doc as doc_id, 0::bigint as node, 0::bigint as cost from c union all select doc, node, place from o union all select doc, node, order_place + place from ln")
def tree_path_costs(spark, sf_dir):
    return bigints(tree.path_cost(forest(spark, sf_dir)))


@query(f"""with {FOREST}, h as (select * from ln where l_returnflag || l_linestatus = 'RF')
select doc as doc_id, node, true as hit from h union all select distinct doc, order_node, false from h union all select distinct doc, 0, false from h""")
def tree_search(spark, sf_dir):
    return bigints(tree.search(forest(spark, sf_dir), F.col("text"), "rf").select("doc_id", "node", "hit"))


@query(f"""with {FOREST}, s as (select doc, 0::bigint as node from c union all select doc, node from o union all select doc, node from ln where status = 'O')
select doc as doc_id, node, row_number() over (partition by doc order by node) as position from s""")
def tree_flattened(spark, sf_dir):
    return bigints(tree.flattened(forest(spark, sf_dir), F.col("tag").isin("div", "body", "main")).select("doc_id", "node", "position"))


@query(f"""with {FOREST}, t as (select doc, 0 as depth, below = 0 as leaf from c union all select doc, 1, n = 0 from o union all select doc, 2, true from ln)
select doc as doc_id, count(*) as n_nodes, count_if(leaf) as n_leaves, max(depth)::bigint as max_depth, round(avg(case when leaf then depth end), 9) as mean_leaf_depth from t group by 1""")
def tree_structure(spark, sf_dir):
    return bigints(tree.structure(forest(spark, sf_dir)).withColumn("mean_leaf_depth", F.round("mean_leaf_depth", 9)))


@query(f"""with {FOREST} select doc as doc_id, node, lag(node) over w as previous, lead(node) over w as next, last_value(case when status = 'F' then node end ignore nulls) over (partition by doc order by place rows between unbounded preceding and 1 preceding) as heading,
  lead(case when status <> 'P' then node end ignore nulls) over w as next_said from o window w as (partition by doc order by place)""")
def tree_siblings(spark, sf_dir):
    """Neighbours of orders, the heading before them, and the next one that says something."""
    n = forest(spark, sf_dir)
    near = tree.preceding_heading(tree.sibling_neighbours(n), F.col("tag") == "h2")
    said = tree.meaningful_neighbours(n, F.col("tag") == "nav").select("doc_id", "node", F.col("next").alias("next_said"))
    return bigints(near.join(said, ["doc_id", "node"]).where("depth = 1").select("doc_id", "node", "previous", "next", "heading", "next_said"))


@query(f"""with {FOREST}, t as (select doc, node, 'heading' as target from o where status = 'F' and priority <> '5-LOW'
  union all select doc, node, case when l_returnflag = 'A' then 'link' when l_returnflag = 'R' then 'button' else 'field' end from ln where priority <> '5-LOW' and (l_returnflag <> 'A' or l_linestatus = 'F')),
s as (select doc as doc_id, node, target, row_number() over (partition by doc order by node) as stop, row_number() over (partition by doc, target order by node) as ordinal from t),
f as (select *, count(*) filter (target in ('field', 'button')) over (partition by doc_id order by node) as forms, count(*) filter (target = 'link') over (partition by doc_id order by node) as links, count(*) filter (target = 'button') over (partition by doc_id order by node) as buttons from s),
r as (select *, case target when 'field' then forms when 'link' then links when 'button' then buttons end as seen, case target when 'field' then forms else ordinal end as direct from f)
select r.doc_id, r.node, r.target, any_value(r.stop) as stop, least(any_value(r.direct), min(case when r.target <> 'heading' then h.ordinal + r.seen - case r.target when 'field' then h.forms when 'link' then h.links else h.buttons end end)) as jump
from r left join r h on h.doc_id = r.doc_id and h.target = 'heading' and h.node < r.node group by 1, 2, 3""")
def tree_jump_costs(spark, sf_dir):
    """Cheapest way to each target, by a scan or by any heading before it: the SQL tries all headings."""
    return bigints(navigation.jump_cost(navigation.targets(forest(spark, sf_dir))).select("doc_id", "node", "target", "stop", "jump"))


@query(f"""with {FOREST} select doc as doc_id, order_node as node, count(distinct l_partkey) as n_refs, min(l_partkey)::bigint as least from ln group by 1, 2
union all select doc, 0, count(distinct l_partkey), min(l_partkey) from ln group by 1 union all select doc, node, 1, l_partkey from ln""")
def tree_subtree_refs(spark, sf_dir):
    n = forest(spark, sf_dir)
    refs = _lines(n).select("doc_id", "node", F.col("attributes")["ref"].cast("long").alias("ref"))
    return bigints(tree.subtree_refs(n, refs).select("doc_id", "node", F.size("refs").alias("n_refs"), F.array_min("refs").alias("least")))


@query(f"""with {FOREST}, w as (select doc, node, order_node, l_returnflag = 'A' as owned from ln)
select doc as doc_id, node, (case when owned then node else order_node end)::bigint as owner, case when not owned then order_node end as via from w
union all select doc, node, node, null from o union all select doc, 0, 0, null from c""")
def tree_owners(spark, sf_dir):
    """Who owns a node: links, orders and customers own themselves, other lines go to their order."""
    n = forest(spark, sf_dir)
    refs = n.where("depth < 2 or tag = 'a'").select("doc_id", F.col("node").alias("ref"), F.col("node").alias("owner"))
    return bigints(tree.owners_of(n, refs))


@query(f"with {FOREST}, t as (select doc, 0::bigint as node, false as x from c union all select doc, node, status = 'P' from o union all select doc, node, l_returnflag = 'N' from ln) select doc as doc_id, node, row_number() over (partition by doc order by x, node) - 1 as number from t")
def tree_collector_ids(spark, sf_dir):
    return bigints(tree.collector_ids(forest(spark, sf_dir), F.col("tag").isin("nav", "input")).select("doc_id", "node", "number"))


@query(f"""with {FOREST}, t as (select doc, 0::bigint as node, 'r' as k from c union all select doc, node, 'o' from o union all select doc, node, case when l_returnflag = 'N' then 'n' when l_returnflag = 'R' then 'r2' else 'a' end from ln)
select doc as doc_id, node, case k when 'n' then 'not in the ledger' when 'r2' then 'repeated' end as error from t where k in ('n', 'r2') union all select doc, -5, 'not in the source' from c""")
def tree_dual_index(spark, sf_dir):
    """Faults of a ledger that leaves fields out, has buttons twice and invents a node for each customer."""
    n = forest(spark, sf_dir)
    led = n.where("tag <> 'input'").select("doc_id", "node").unionByName(n.where("tag = 'button'").select("doc_id", "node")).unionByName(n.where("depth = 0").select("doc_id", F.lit(-5).alias("node")))
    return bigints(tree.dual_index(n, led))


@query(f"""with {FOREST} select doc as doc_id, node, 'tag' as error from ln where l_returnflag = 'R' union all select doc, node, 'parent' from ln where l_returnflag = 'A' union all select doc, node, 'missing' from ln where l_returnflag = 'N'
union all select doc, 100000000, 'added' from c""")
def tree_parity(spark, sf_dir):
    """Differences of a numbering that renames buttons, moves links to the root, loses fields and adds a node."""
    n = forest(spark, sf_dir).select("doc_id", "node", "tag", "parent")
    other = n.where("tag <> 'input'").withColumns({"parent": F.when(F.col("tag") == "a", 0).otherwise(F.col("parent")), "tag": F.when(F.col("tag") == "button", "b").otherwise(F.col("tag"))})
    more = n.where("parent = -1").withColumn("node", F.lit(100000000))
    moved = tree.parity_errors(n, other.unionByName(more))
    return bigints(moved)


@query(f"with {FOREST} select doc as doc_id, order_node as root, count(*) as targets, median(l_quantity::int)::double as median from ln where l_returnflag <> 'R' group by 1, 2")
def tree_selection_steps(spark, sf_dir):
    """Median steps over the targets in each order."""
    n = forest(spark, sf_dir)
    costs = _lines(n).where("tag <> 'button'").select("doc_id", "node", F.col("attributes")["steps"].cast("int").alias("steps"))
    return bigints(groups.selection_steps(_orders(n), n, costs).withColumn("median", F.col("median").cast("double")))


@query(f"with {FOREST} select doc as doc_id, node, lower('n' || (case when node < 36 then '' else substr('0123456789abcdefghijklmnopqrstuvwxyz', ((node // 36) % 36 + 1)::bigint, 1) end) || substr('0123456789abcdefghijklmnopqrstuvwxyz', (node % 36 + 1)::bigint, 1)) as alias from ln where node < 1296")
def tree_aliases(spark, sf_dir):
    """Aliases of lines: places in base 36."""
    return bigints(reports.model_aliases(forest(spark, sf_dir)).where("depth = 2 and node < 1296").select("doc_id", "node", "alias"))


@query(f"with {FOREST} select doc as doc_id, node, status as tag from o where node < 36 union all select doc, null, null from c")
def tree_expanded_refs(spark, sf_dir):
    """Nodes by base-36 places; a place beyond a document names none."""
    n = forest(spark, sf_dir)
    asked = _orders(n).where("node < 36").select("doc_id", F.lower(F.conv(F.col("node").cast("string"), 10, 36)).alias("ref")).unionByName(n.where("depth = 0").select("doc_id", F.lit("zzzzz").alias("ref")))
    found = reports.expanded_refs(asked, n)
    status = F.when(F.col("tag") == "h2", "F").when(F.col("tag") == "div", "O").when(F.col("tag") == "nav", "P")
    return bigints(found.select("doc_id", "node", status.alias("tag")))


_ANCHORS = f"with {FOREST}, g as (select doc, node, row_number() over (partition by doc order by node) as r from o where status = 'O')"


@query(f"""{_ANCHORS} select g.doc as doc_id, g.node as root, 'g' || r as id, count(ln.node) + 1 as n_sources, null as finding from g left join ln on ln.doc = g.doc and ln.order_node = g.node group by all
union all select doc, node, null, null, 'title without label' from o where status = 'P'""")
def tree_anchors(spark, sf_dir):
    """Groups of chosen orders: each owns itself and its lines; orders without a title make none."""
    n = forest(spark, sf_dir)
    chosen = _orders(n).where("tag in ('div', 'nav')").select("doc_id", F.col("node").alias("root"), F.col("node").alias("title"))
    labels = n.where("tag = 'div'").select("doc_id", "node", F.lit("Order").alias("label"))
    found = groups.decode_anchors(chosen, n, n.where("depth > 0"), labels)
    return bigints(found.select("doc_id", "root", "id", F.size("source_ids").alias("n_sources"), "finding")).withColumn("n_sources", F.when(F.col("id").isNotNull(), F.col("n_sources")))


@query(f"""with {FOREST}, s as (select doc, order_node, node, row_number() over (partition by doc order by node) as k from ln),
f as (select doc, order_node, min(k) - 1 as first from s group by 1, 2), t as (select doc, order_node, row_number() over (partition by doc order by first) - 1 as place from f)
select doc as doc_id, 'group:' || order_node as id, place, 'root' as parent from t""")
def tree_variants(spark, sf_dir):
    """Orders as groups of their lines, put in the order of their first lines whatever order they come in."""
    n = forest(spark, sf_dir)
    given = _lines(n).groupBy("doc_id", "parent").agg(F.collect_list(F.col("node").cast("string")).alias("source_ids"))
    g = given.select("doc_id", F.col("parent").cast("string").alias("id"), F.lit("Order").alias("label"), F.lit(None).cast("string").alias("parent"), "source_ids")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("pre")) - 1
    sources = _lines(n).select("doc_id", "node", F.lit("line").alias("label"), number.alias("pre"))
    return bigints(groups.variant(g, sources).where("id like 'group:%'").select("doc_id", "id", "place", "parent"))


@query(f"""with {FOREST}, g as (select doc, order_node, count(*) as n from ln group by 1, 2)
select doc as doc_id, order_node::varchar as id, 'label is blank or over 100' as finding from g where n = 2 union all select doc, order_node::varchar, 'unknown parent' from g where n = 3
union all select doc, max(order_node)::varchar, 'too many groups' from g where false group by 1 union all select distinct doc, null, 'too many groups' from (select doc, count(*) as k from g group by 1) where k > 12""")
def tree_group_findings(spark, sf_dir):
    """Findings on orders as groups: those of two lines have no label, those of three an unknown parent; more than twelve are too many."""
    n = forest(spark, sf_dir)
    given = _lines(n).groupBy("doc_id", "parent").agg(F.collect_list(F.col("node").cast("string")).alias("source_ids"))
    label = F.when(F.size("source_ids") == 2, " ").otherwise("Order")
    up = F.when(F.size("source_ids") == 3, "nowhere")
    g = given.select("doc_id", F.col("parent").cast("string").alias("id"), label.alias("label"), up.alias("parent"), "source_ids")
    return groups.group_findings(g, n, 12)

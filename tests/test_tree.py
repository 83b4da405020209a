import random

import pytest

from treeline.operators import tree
from treeline.sources import html

PAGE = "<body><h1>A</h1><ul><li>x<li>y</ul><p>one<p>two<div><b>z</div><table><tr><td>1<td>2<tr><td>3</table></body>"


def walk(rows):
    """Ancestors of each node by parents."""
    return {i: ([] if r[0] < 0 else [r[0], *walk_up(rows, r[0])]) for i, r in enumerate(rows)}


def walk_up(rows, i):
    return [] if rows[i][0] < 0 else [rows[i][0], *walk_up(rows, rows[i][0])]


def test_parse_repairs_implied_ends():
    rows = html.parse(PAGE)
    tag = [r[5] for r in rows]
    parent = lambda i: tag[rows[i][0]]
    assert all(parent(i) == "ul" for i, t in enumerate(tag) if t == "li")
    assert all(parent(i) == "body" for i, t in enumerate(tag) if t in ("p", "div", "table"))
    assert all(parent(i) == "tr" for i, t in enumerate(tag) if t == "td")


@pytest.mark.parametrize("source", [None, "", "plain", "<p", "</p></div>", "<!-- c --><script>var a='</p>'</script>"])
def test_parse_takes_anything(source):
    rows = html.parse(source)
    assert rows[0][5] == "#document" and rows[0][1] == len(rows)


def test_intervals_agree_with_a_walk(spark):
    random.seed(3)
    source = "".join(random.choice(["<div>", "</div>", "<p>", "t", "<li>", "</ul>", "<ul>", "<b>", "</b>"]) for _ in range(300))
    rows = html.parse(source)
    nodes = html.nodes(spark.createDataFrame([(1, source)], "page_id long, html string")).cache()
    found = {(r.node, r.ancestor) for r in tree.ancestors(nodes, nodes).collect()}
    assert found == {(i, a) for i, up in walk(rows).items() for a in up}
    assert nodes.count() == len(rows)
    below = {(r.node, r.root) for r in tree.descendants(nodes, nodes).collect()}
    assert below == found


def test_nearest_and_minimal_roots(spark):
    nodes = html.nodes(spark.createDataFrame([(1, "<div><div><p>a</p></div><p>b</p></div><p>c</p>")], "page_id long, html string"))
    divs = nodes.where("tag = 'div'")
    assert tree.minimal_roots(divs).count() == 1
    near = {r.node: r.nearest for r in tree.nearest_flagged(nodes.where("tag = 'p'"), divs).collect()}
    assert list(near.values()).count(None) == 1 and len(set(near.values())) == 3


def test_forest_errors(spark):
    edges = spark.createDataFrame([(1, "a", "b"), (1, "c", "b"), (1, "x", "y"), (1, "y", "x"), (1, "a", "gone")], "doc_id long, parent string, child string")
    ids = spark.createDataFrame([(1, n) for n in "abcxy"], "doc_id long, node string")
    found = {(r.error, r.node) for r in tree.forest_errors(edges, ids).collect()}
    assert found == {("several parents", "b"), ("unknown node", "gone"), ("cycle", "x"), ("cycle", "y")}


def test_path_cost(spark):
    nodes = html.nodes(spark.createDataFrame([(1, "<i>1</i><b><u>2</u></b>")], "page_id long, html string"))
    cost = {r.node: r.cost for r in tree.path_cost(nodes).collect()}
    assert cost == {0: 0, 1: 1, 2: 2, 3: 2, 4: 3, 5: 4}

"""Grouped hierarchies on small captures."""

import pytest

from treeline.operators import groups, reports
from treeline.sources import html

PAGE = """<body><div><div><nav><h2>Menu</h2><a href=1>one</a><a href=2>two</a></nav></div></div><main aria-label="Content"><h1>Title</h1><section><h2>Part</h2><p>text</p><p>more</p></section></main>
<div hidden><p>gone</p></div><div hidden id=help><p>kept</p></div><button aria-describedby=help>Go</button><script>x</script></body>"""


@pytest.fixture(scope="module")
def capture(spark):
    return groups.prepared(html.nodes(spark.createDataFrame([(1, PAGE)], "page_id long, html string"), context=True)).cache()


def test_preparation(capture):
    rows = capture.collect()
    status = {(r.tag, r.text, r.status) for r in rows}
    assert ("p", "gone", "hidden") in status and ("p", "kept", "kept") in status and ("script", "x", "inert") in status
    kept = sorted((r for r in rows if r.status == "kept"), key=lambda r: r.pre)
    assert [r.pre for r in kept] == list(range(len(kept))) and kept[0].end == len(kept)
    nav = next(r for r in kept if r.tag == "nav")
    assert next(r for r in kept if r.node == nav.parent).tag == "body" and sum(r.status == "collapsed" for r in rows) == 2
    s = groups.capture_stats(capture).first()
    assert (s.kept_nodes, s.hidden_nodes, s.inert_nodes, s.collapsed_nodes) == (len(kept), 2, 1, 2) and s.kept_hidden_nodes == 2


def test_regions_context_and_markup(capture):
    owned = groups.regions(capture, 4)
    sizes = {r.region: r["count"] for r in owned.groupBy("region").count().collect()}
    assert sum(sizes.values()) == capture.where("status = 'kept'").count() and max(sizes.values()) <= 4
    context = groups.region_context(owned, capture)
    own = {(r.region, r.node) for r in owned.collect()}
    assert not own & {(r.region, r.node) for r in context.collect()} and {"ancestor", "neighbour"} <= {r.reason for r in context.collect()}
    assert groups.region_context(owned, capture, 1).groupBy("region").count().where("count > 1").count() == 0
    parts = groups.compact_regions(capture, 12)
    text = "".join(r.html for r in groups.regional_html(parts, capture).collect())
    assert text.count("<p") >= 3 and 'data-context="read-only"' in text or parts.where("role = 'context'").count() == 0
    outline = groups.page_outline(capture, 3).collect()
    assert len(outline) == 3 and outline[0].omitted > 0


def test_group_findings_and_variant(spark, capture):
    kept = capture.where("status = 'kept'")
    n = [str(r.node) for r in kept.orderBy("pre").collect()]
    schema = "doc_id long, id string, label string, parent string, source_ids array<string>"
    good = spark.createDataFrame([(1, "b", "Second", None, [n[5]]), (1, "a", "First", None, [n[2]]), (1, "c", "Inner", "a", [n[3]])], schema)
    assert groups.group_findings(good, kept).count() == 0
    bad = spark.createDataFrame([(1, "x", "X", "y", [n[1]]), (1, "y", "Y", "x", []), (1, "z", "", "gone", ["nope", n[1]]), (1, "w" * 65, "W", None, [])], schema)
    found = {(r.id, r.finding) for r in groups.group_findings(bad, kept).collect()}
    assert {("x", "cycle"), ("y", "cycle"), ("z", "label is blank or over 100"), ("z", "unknown parent"), ("z", "unknown source nope"), ("w" * 65, "invalid group id"), ("w" * 65, "no source below")} <= found
    assert any(f == f"repeated source {n[1]}" for _, f in found)
    sources = kept.select("doc_id", "node", groups.label_of().alias("label"), "pre")
    v = {r.id: r for r in groups.variant(good, sources).collect()}
    assert v["group:a"].place < v["group:b"].place < v["fallback"].place and v["group:c"].parent == "group:a" and v["fallback"].parent == "root"
    assert len([1 for i in v if i.startswith("source:")]) == len(n)
    c = groups.annotation_coverage(groups.variant(good, sources)).first()
    assert (c.assigned, c.retained) == (3, len(n))
    refs = groups.source_refs(groups.variant(good, sources)).where("id = 'group:a'").collect()
    assert {r.ref for r in refs} == {n[2], n[3]}


def test_composition(spark):
    local = spark.createDataFrame([(1, "a", "A", None, ["1"]), (1, "b", "B", "a", ["2"]), (1, "c", "C", None, ["3"])], "doc_id long, id string, label string, parent string, source_ids array<string>")
    upper = spark.createDataFrame([(1, "u", "U", None)], "doc_id long, id string, label string, parent string")
    parents = spark.createDataFrame([(1, "a", "u"), (1, "c", None)], "doc_id long, id string, parent string")
    assert groups.composition_findings(upper, parents, local).count() == 0
    assert {r.id: r.parent for r in groups.composed(upper, parents, local).collect()} == {"a": "u", "b": "a", "c": None, "u": None}
    wrong = spark.createDataFrame([(1, "a", "b"), (1, "a", "u"), (1, "b", "u")], "doc_id long, id string, parent string")
    found = {(r.id, r.finding) for r in groups.composition_findings(spark.createDataFrame([(1, "u", "U", "u2"), (1, "v", "V", None)], upper.schema), wrong, local).collect()}
    assert {("c", "root without parent"), ("a", "root given twice"), ("b", "no local root"), ("a", "parent is no upper group"), ("u", "parent is no upper group"), ("v", "upper group without a local one")} <= found


def test_containment(spark, capture):
    kept = capture.where("status = 'kept'")
    by = {(r.tag, r.text): str(r.node) for r in kept.collect()}
    main, section, p = by["main", ""], by["section", ""], by["p", "text"]
    schema = "doc_id long, id string, label string, parent string, source_ids array<string>"
    g = spark.createDataFrame([(1, "m", "M", None, [main]), (1, "s", "S", None, [section]), (1, "t", "T", None, [p])], schema)
    at = spark.createDataFrame([(1, "m", 0), (1, "s", 1), (1, "t", 1)], "doc_id long, id string, region int")
    assert {r.id: r.parent for r in groups.contained(g, at, kept).collect()} == {"m": None, "s": "m", "t": "m"}  # the section around t is of its own region


def test_anchors_proposals_and_selections(spark, capture):
    kept = capture.where("status = 'kept'")
    labels = kept.select("doc_id", "node", groups.label_of().alias("label")).where("label <> tag")
    offered = groups.proposals(kept, kept, labels).collect()
    assert [r.label for r in offered] == ["Menu", "Content", "Part"]
    found = groups.decode_selection(spark.createDataFrame([(1, "c2"), (1, "c3"), (1, "c9")], "doc_id long, id string"), groups.proposals(kept, kept, labels), kept, kept).collect()
    good = {r.label: r for r in found if r.id}
    assert good["Part"].parent == good["Content"].id and sum(r.finding == "not offered or kept twice" for r in found) == 1
    tags = {str(r.node): r.tag for r in kept.collect()}
    assert [tags[i] for i in good["Content"].source_ids] == ["main", "h1"] and [tags[i] for i in good["Part"].source_ids] == ["section", "h2", "p", "p"]


def test_outline_metrics_against_sets(spark):
    nodes = spark.createDataFrame([(1, i, p, i, e) for i, p, e in ((0, -1, 6), (1, 0, 3), (2, 1, 3), (3, 0, 6), (4, 3, 5), (5, 3, 6))], "doc_id long, node int, parent int, pre int, end int")
    base = spark.createDataFrame([(1, "2"), (1, "4"), (1, "5"), (1, "77")], "doc_id long, ref string")
    units = spark.createDataFrame([(1, "u", "A", ["1"], ["2", "4"]), (1, "u", "B", ["3"], ["4", "9"])], "doc_id long, id string, label string, refs array<string>, claims array<string>")
    lines = spark.createDataFrame([(1, 0, "root", []), (1, 1, "A", ["1"]), (1, 2, "C", ["2", "4"]), (1, 3, "D", ["4"])], "doc_id long, line int, label string, refs array<string>")
    m = reports.outline_metrics(nodes, base, units, lines).first()
    assert (m.expected, m.unclaimed, m.unreached, m.unexpected, m.repeated_claims, m.repeated_refs, m.repeated_units, m.invalid_expected) == (4, ["5", "77"], ["5", "77"], ["9"], ["4"], ["4"], ["u"], ["77"])
    assert [(o.a, o.b) for o in m.overlaps] == [(0, 1)] and m.unmatched_units == ["u"]
    assert "metric_overlaps" in reports.metric_reasons(spark.createDataFrame([m])).first().reasons


def test_small_rules(spark):
    d = spark.createDataFrame([('<p data-r="a"><b data-r="b">', {"a": 1})], "html string, m map<string,int>")
    assert d.select(reports.spliced_aliases(d.html, "data-r", d.m)).first()[0] == '<p data-r="1"><b data-r="b">'
    t = spark.createDataFrame([(1, "a|b"), (2, None)], "k int, v string")
    assert reports.markdown_table(t, ["k"]).first().markdown == "| k | v |\n|-|-|\n| 1 | a\\|b |\n| 2 |  |"
    jobs = spark.createDataFrame([(i, i) for i in range(20)], "job int, created int")
    assert [r.job for r in reports.recent(jobs, "created", 3).collect()] == [19, 18, 17]
    assert [r.job for r in reports.backlog_last(jobs, jobs.job < 18, "job").collect()][:2] == [18, 19]
    assert {r.job for r in reports.shuffled(jobs, "job", "s").collect()} == set(range(20))
    led = spark.createDataFrame([(1, 1, "retained", 1), (1, 2, "collapsed", 1), (1, 3, "retained", 3)], "doc_id long, node int, disposition string, representative int")
    assert {r.ref for r in reports.valid_refs(led).collect()} == {1, 3}
    assert {(r.node, r.side) for r in reports.retained_difference(led, spark.createDataFrame([(1, 1), (1, 9)], "doc_id long, node int")).collect()} == {(3, "ledger"), (9, "emitted")}
    both = reports.compared_candidates(led, spark.createDataFrame([(1, 1), (1, 9)], "doc_id long, node int"))
    assert {(r.node, r.in_left, r.in_right) for r in both.collect()} == {(1, True, True), (2, True, False), (3, True, False), (9, False, True)}
    hits = reports.cached_projections(spark.createDataFrame([("a",), ("b",)], "key string"), spark.createDataFrame([("a", "p")], "key string, projection string"))
    assert {r.key: r.hit for r in hits.collect()} == {"a": True, "b": False}
    n = html.nodes(spark.createDataFrame([(1, '<a id=x></a><b aria-controls="x y">')], "page_id long, html string"))
    r = reports.surviving_relations(n, ["aria-controls"]).first()
    assert (r.kept, r.missing) == (["x"], ["y"])
    assert reports.group_schema(["1"], 3)["properties"]["groups"]["maxItems"] == 3 and "graph" in reports.result_schema(["graph"], ["c"])["properties"]["gates"]["required"]

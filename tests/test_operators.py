import json

import pytest
from pyspark.sql import functions as F

from treeline.functions import text as tx
from treeline.operators import compaction, contracts, dataset, navigation, observe, traces
from treeline.sources import html

FORM = """<form id=f><fieldset disabled><legend>Ship</legend><label>Name <input id=n required aria-describedby="h none"></label></fieldset>
<label for=q>Qty</label><input id=q type=range min=1 max=5 value=3><input type=password value=s><div id=h hidden>Help</div><div id=d></div><div id=d></div>
<button aria-controls="d">Go</button><a href="#h">x</a></form>"""


def nodes(spark, source):
    return html.nodes(spark.createDataFrame([(1, source)], "page_id long, html string"))


def test_observation(spark):
    n = nodes(spark, FORM).cache()
    o = {(r.tag, r.attributes.get("id")): r for r in observe.observe(n).where("kind = 'element'").collect()}
    assert o["input", "n"].role == "textField" and o["input", "n"].states.required == "true" and o["input", "n"].states.checked is None and o["input", "n"].states.disabled == "true"
    assert o["input", "q"].role == "slider" and (o["input", "q"].value.min, o["input", "q"].value.max, o["input", "q"].value.current) == (1.0, 5.0, None)
    assert o["div", "h"].exposure.rendered is False and o["button", None].actions == ["invoke", "focus"]
    reasons = {(r.kind, r.reason) for r in observe.resolve_references(n).collect()}
    assert reasons == {("describedBy", None), ("describedBy", "missing-target"), ("controls", "ambiguous-html-id")}
    assert observe.label_relations(n).count() == 4 and observe.caption_relations(n).count() == 1
    assert observe.fragment_targets(n).first().target is not None
    assert observe.form_owner(n).where("target is null").count() == 0


def test_jump_cost_prefers_headings_only_if_strictly_cheaper(spark):
    n = nodes(spark, "<a href=1>1</a><a href=2>2</a><a href=3>3</a><h2>h</h2><a href=4>4</a><button>b</button>")
    cost = [r.jump for r in navigation.jump_cost(navigation.targets(n)).orderBy("pre").collect()]
    assert cost == [1, 2, 3, 1, 2, 1]


def test_quantiles(spark):
    for n, p90 in ((10, 9.0), (11, 10.0)):
        r = navigation.summary(spark.createDataFrame([(1, float(i)) for i in range(1, n + 1)], "k int, v double"), "v", ["k"]).first()
        assert r.p90 == p90 == dataset.nearest_rank([float(i) for i in range(1, n + 1)]) and r.median == dataset.median_of([float(i) for i in range(1, n + 1)])


def test_json_and_pointers():
    assert tx.canonical({"b": 1, "a": [True, None]}) == '{"a":[true,null],"b":1}'
    for bad in ('{"a":1,"a":2}', "NaN", "[1e999]"):
        with pytest.raises(ValueError):
            tx.strict_json(bad)
    doc = {"a/b": {"~": ["x", "y"]}}
    assert tx.resolve_pointer(doc, "/a~1b/~0/1") == "y"
    for bad in ("/a~1b/~0/01", "/a~1b/~0/2", "/none"):
        with pytest.raises(LookupError):
            tx.resolve_pointer(doc, bad)
    assert tx.pointer_holds(json.dumps(doc), "/a~1b/~0/0", "x")


def test_text_columns(spark):
    df = spark.createDataFrame([("  a \n b ", 3), ("x😀y", 2), (None, 1)], "t string, n int")
    assert [r[0] for r in df.select(tx.collapse(F.col("t"))).collect()] == ["a b", "x😀y", None]
    assert [r[0] for r in df.select(tx.utf16_prefix("t", "n")).collect()] == ["  a", "x", None]
    dirty = spark.createDataFrame([("mail a.b@c.org or https://x.y/z /home/me/f https://ok.org/p#f",)], "t string")
    once = dirty.select(tx.safe_text(F.col("t"), ["ok.org"]).alias("t"))
    assert once.first().t == "mail [omitted] or [omitted] [omitted] https://ok.org/p"
    assert once.select(tx.safe_text(F.col("t"), ["ok.org"]).alias("t")).first() == once.first()


def test_families_are_transitive(spark):
    rows = spark.createDataFrame([(1, "a", "s"), (2, "a", "t"), (3, "b", "t"), (4, "c", None), (5, None, None)], "id long, x string, y string")
    assert {r.id: r.family for r in dataset.families(rows, "id", ["x", "y"]).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    assert [dataset.split_sizes(n) for n in (0, 1, 2, 3, 10, 30)] == [(0, 0), (0, 0), (0, 1), (1, 1), (2, 2), (4, 4)]
    split = dataset.family_split(dataset.families(rows, "id", ["x", "y"]), "s").groupBy("split").agg(F.countDistinct("family").alias("n"))
    assert {r.split: r.n for r in split.collect()} == {"test": 1, "dev": 1, "train": 1}


def test_outline_contract(spark):
    rows = [(1, 0, 0, "r", []), (1, 1, 2, "jump", ["a", "a"]), (1, 2, 0, " ", []), (2, 0, 0, "ok", []), (2, 1, 1, "u", ["a"]), (2, 2, 1, "v", ["a"])]
    lines = spark.createDataFrame(rows, "doc_id long, line long, depth int, label string, refs array<string>")
    found = {(r.doc_id, r.line, r.finding) for r in contracts.outline_findings(lines).collect()}
    assert {f for d, _, f in found if d == 1} == {"depth jumps", "repeated ref in line", "second root", "label is blank or over 100", "group without children"}
    assert {f for d, _, f in found if d == 2} == {"ref of line 1"}
    text = contracts.render_outline(lines.where("doc_id = 2"))
    again = contracts.parse_outline(text, "doc_id", "text")
    assert [(r.depth, r.label, r.refs) for r in again.orderBy("line").collect()] == [(0, "ok", []), (1, "u", ["a"]), (1, "v", ["a"])]


def test_decisions_and_preferences(spark):
    rows = spark.createDataFrame([(True, False, True, 3, 3), (False, False, False, 0, 0), (False, False, True, 2, 3), (False, False, True, 1, 3), (False, False, True, None, 3)], "e boolean, h boolean, k boolean, a int, b int")
    d = [r[0] for r in rows.select(contracts.teacher_decision(F.col("e"), F.col("h"), F.col("k"), [F.col("a"), F.col("b")])).collect()]
    assert d == ["reject", "insufficient_evidence", "accept", "revise", "insufficient_evidence"]
    s = spark.createDataFrame([(1, "x", 3, 3), (1, "y", 2, 2), (1, "z", 3, 2), (1, "w", 0, 3)], "id int, c string, p int, q int")
    found = {(r.chosen, r.rejected) for r in contracts.preference_pairs(s, ["id"], "c", ["p", "q"]).collect()}
    assert found == {("x", "y"), ("x", "w")}


def test_regions_of_nodes(spark):
    n = nodes(spark, "<ul>" + "<li>item" * 40 + "</ul><div><p>x</p></div>").cache()
    regions = compaction.partition_regions(n, 12)
    assert regions.count() == n.count() and regions.groupBy("region").count().agg(F.max("count")).first()[0] <= 12
    context = compaction.region_context(regions, n)
    assert context.count() > 0 and not {(r.region, r.node) for r in context.collect()} & {(r.region, r.node) for r in regions.collect()}


def test_reader_replay_and_framing(spark):
    items = spark.createDataFrame([(1, "root", "a", 0, "first one"), (1, "root", "b", 1, "second"), (1, "a", "c", 0, "leaf")], "session long, parent string, item string, ord int, label string")
    acts = spark.createDataFrame([(1, 0, "expand", "a"), (1, 1, "expand", "b"), (1, 2, "activate", "c"), (1, 3, "up", None), (1, 4, "next", None)], "session long, step int, action string, target string")
    r = traces.replay(acts, items).first()
    assert (r.moves, r.actions, r.errors, r.choices, r.words) == (2, 1, 2, 6, 8)
    roles = spark.createDataFrame([(1, "root", "a", 0, "first one", None), (1, "a", "c", 0, "leaf", "link"), (1, "a", "d", 1, "head", "heading")], "session long, parent string, item string, ord int, label string, role string")
    more = spark.createDataFrame([(1, 0, "headings", None), (1, 1, "activate", "d"), (1, 2, "up", None), (1, 3, "controls", None), (1, 4, "fill", "c"), (1, 5, "activate", "c")], "session long, step int, action string, target string")
    r = traces.replay(more, roles).first()
    assert (r.moves, r.actions, r.errors) == (3, 1, 2)
    assert list(traces.framed_lines([b'{"a"', b":1}\n{", b"}"])) == ['{"a":1}']
    with pytest.raises(ValueError):
        list(traces.framed_lines([b"x\n\n"]))


def test_admission_ledger(spark):
    rows = spark.createDataFrame([(1, "m", 0.0), (2, "m", 1.0), (3, "k", 2.0), (4, "m", 50.0), (5, "k", 60.0)], "request long, model string, ts double")
    found = {r.request: (r.start, r.admitted) for r in traces.admission_ledger(rows, 4, 10.0).collect()}
    assert found == {1: (0.0, True), 2: (10.0, True), 3: (2.0, True), 4: (50.0, True), 5: (None, False)}


def test_inventory(spark):
    rows = spark.createDataFrame([(1, "p", "h", True), (2, "p", "i", True), (3, "q", "h", True), (4, "r", "z", False)], "ord long, path string, sha string, ok boolean")
    found = {r.ord: (r.status, r.duplicate_of) for r in dataset.inventory(rows, "ord", "path", "sha", F.col("ok")).collect()}
    assert found == {1: ("ready", None), 2: ("duplicate", 1), 3: ("duplicate", 1), 4: ("skipped", None)}

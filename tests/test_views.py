"""Observation, views and compact markup against hand-made pages, naive walks and their own promises."""

import random

import pytest
from pyspark.sql import functions as F

from treeline.operators import compaction, observe, tree, views
from treeline.sources import html

LONG = "long text " * 100
FORM = f"""<html><head><title>T</title><style>x</style></head><body><form id=f><fieldset disabled><legend>Ship <input id=free></legend><label>Name <input id=n required aria-describedby="h none"></label></fieldset>
<label for=q>Qty</label><input id=q type=range min=1 max=5 aria-valuenow=3><input type=password value=s><div id=h hidden>Help</div><div id=d></div><div id=d></div>
<button aria-controls="d">Go</button><a href="#h">x</a></form><select><option>a<option>b<option selected>c<option>d<option>e<option>f<option>g<option>h<option>i</select>
<div><div><p>{LONG}</p></div></div><template><p>zz</p></template><svg aria-label=pic><path d=1></path><title>Pic</title></svg></body></html>"""


def nodes(spark, *sources):
    return html.nodes(spark.createDataFrame(list(enumerate(sources)), "page_id long, html string"), context=True)


def test_disabled_comes_from_fieldsets_but_not_into_their_first_legend(spark):
    source = "<fieldset disabled><legend><input id=a></legend><input id=b><fieldset><legend><input id=c></legend></fieldset><legend><input id=d></legend></fieldset><select><optgroup disabled><option id=e></optgroup></select><input id=g>"
    o = {r.attributes["id"]: r.states.disabled for r in observe.observe(nodes(spark, source)).where("attributes['id'] is not null").collect()}
    assert o == {"a": None, "b": "true", "c": "true", "d": "true", "e": "true", "g": None}


def test_payload_and_what_users_wrote_are_not_observed(spark):
    n = nodes(spark, "<textarea value=x>secret</textarea><input value=y><input type=checkbox value=z><svg><path><text>t</text></path><text>u</text></svg><iframe>f</iframe>")
    o = observe.observe(n).collect()
    assert "secret" not in {r.text for r in o} and "t" not in {r.text for r in o} and "u" in {r.text for r in o} and "path" not in {r.tag for r in o} and "iframe" in {r.tag for r in o}
    assert {r.default_value for r in o} == {None, "z"}


def test_context_is_the_same_in_the_parsing_pass_and_later(spark):
    n = nodes(spark, FORM)
    again = html.with_context(n.drop("context"))
    assert sorted(map(str, n.collect())) == sorted(map(str, again.collect()))


def test_relations(spark):
    found = {(r.node, r.kind, r.ordinal, r.target, r.reason) for r in observe.relations(nodes(spark, FORM)).collect()}
    named = {(k, reason) for _, k, _, _, reason in found}
    assert ("controls", "ambiguous-html-id") in named and ("describedBy", "missing-target") in named and ("fragmentTarget", None) in named
    forward = {(n, t) for n, k, _, t, _ in found if k == "labelFor"}
    assert forward and {(t, n) for n, t in forward} <= {(n, t) for n, k, _, t, _ in found if k == "labelledBy"}
    more = nodes(spark, '<label for=x>l</label><div id=x></div><details><summary>s</summary></details><figure><figcaption>c</figcaption></figure><input list=none>')
    assert {(r.kind, r.reason) for r in observe.relations(more).collect()} == {("labelFor", "non-labelable-target"), ("controls", None), ("captionedBy", None), ("choices", "missing-target")}


def test_enrichment(spark):
    o = observe.observe(nodes(spark, "<button>Go</button><input id=a><p>t</p>"))
    overlay = "doc_id long, node int, verified boolean, name string, description string, disabled boolean, actions array<string>, rendered boolean, focused boolean"
    button, field = (o.where(f"tag = '{t}'").first().node for t in ("button", "input"))
    rows = [(0, button, True, "Send", None, True, None, None, True), (0, field, False, "x", None, None, None, None, None), (0, 99, True, None, None, None, None, None, None)]
    e = {r.node: r for r in observe.enriched(o, spark.createDataFrame(rows, overlay)).collect()}
    assert e[button].name.text == "Send" and e[button].actions == [] and e[button].focused and e[field].name is None and e[field].problem == "unverified" and e[99].problem == "missing"


@pytest.mark.parametrize("profile,budget", [("structure", 10**6), ("excerpt", 10**6), ("budget", 1500), ("budget", 2800)])
def test_views_keep_their_promises(spark, profile, budget):
    n = nodes(spark, FORM)
    v = views.views(n, profile, budget).first()
    assert v.problems == [] and v.n_bytes <= v.initial_bytes and (v.status == "ready") == (v.n_bytes <= budget)
    ledger = views.view_ledger(n, profile, budget).collect()
    observed = observe.observe(n).collect()
    assert [r.node for r in ledger] == [r.node for r in observed]
    kept = {r.node for r in ledger if r.disposition in ("retained", "reference-only")}
    assert all(r.representative in kept for r in ledger if r.disposition == "collapsed") and all(r.gap is not None for r in ledger if r.disposition in ("deferred", "excluded"))
    controls = {r.node for r in observed if r.role in views.CONTROLS and r.tag != "option"}
    assert controls <= kept
    gaps = views.view_gaps(n, profile, budget).collect()
    assert sum(g.omitted_nodes for g in gaps if g.field == "children") >= sum(r.disposition == "deferred" for r in ledger)
    if profile != "structure":
        assert any(r.disposition == "deferred" for r in ledger)


def test_expansion_pins_what_a_gap_held(spark):
    n = nodes(spark, FORM)
    gap = next(g for g in views.view_gaps(n, "budget", 1500).collect() if g.reason == "choice-preview")
    held = {r.node for r in views.view_ledger(n, "budget", 1500).collect() if r.gap == gap.gap}
    again = views.expanded_views(n, "budget", 1500, [gap.gap]).first()
    assert again.problems == [] and all(f'"id":{i},' in again.view for i in held)
    assert views.expanded_views(n, "budget", 1500, [77]).first().status == "unknown or unavailable gap"


def test_regions_cover_what_fits(spark):
    n = nodes(spark, FORM)
    r = views.view_regions(n, "structure", 2500)
    rows = r.collect()
    assert all(x.n_bytes <= 2500 for x in rows if x.region is not None)
    owned = [x.node for x in rows if x.membership == "owned"]
    assert len(owned) == len(set(owned))
    c = views.region_coverage(r, observe.observe(n)).first()
    assert c.source_nodes == c.owned_nodes + c.context_only_nodes + c.unrepresented_nodes and c.owned_nodes == len(owned)


def test_navigation(spark):
    n = nodes(spark, '<body lang=en><ul> <li>a</li> <li>b</li> </ul><p>x <b>y</b> <i>z</i></p><div hidden>no</div><div hidden id=h>help</div><button aria-describedby=h lang=fr>go</button></body>')
    r = views.navigation(n, "structure", 10**6).collect()
    texts = [x.text for x in r if x.text is not None]
    assert texts.count(" ") == 1 and "no" not in texts and "help" in texts
    assert not next(x for x in r if x.text == "help").assignable and next(x for x in r if x.role == "button").assignable
    assert {x.language for x in r} == {None, "en", "fr"}


@pytest.mark.parametrize("shape", ["chain", "star"])
def test_depth_and_width_cost_no_stack(spark, shape):
    size = 20_000
    source = "<div>" * size + "x" + "</div>" * size if shape == "chain" else "<ul>" + "<li>x</li>" * size + "</ul>"
    n = nodes(spark, source).cache()
    assert n.count() > size
    assert compaction.compact_html(n, 1000).first().problems == []
    assert views.views(n, "excerpt", 10**9).first().problems == []
    assert tree.path_cost(n).count() == n.count() == tree.inherited(n, F.col("attributes")["lang"], "l").count()


def test_compact_markup(spark):
    n = nodes(spark, FORM + "<ul>" + "".join(f"<li><b>item</b> {i} {'word ' * 90}</li>" for i in range(30)) + "</ul>").cache()
    sizes = []
    for profile in ("structure", "excerpt", "budget"):
        c = compaction.compact_html(n, 2500, profile).first()
        assert c.problems == [] and "password" in c.html and 'value="s"' not in c.html and "<path" not in c.html and 'data-missing-aria-describedby="none"' in c.html
        sizes.append(c.n_bytes)
    assert sizes[0] > sizes[1] > sizes[2]
    led = compaction.ledger(n, 2500).collect()
    assert len(led) == n.count() and {r.disposition for r in led} == {"retained", "collapsed", "deferred", "excluded"}
    kept = {r.node for r in led if r.disposition == "retained"}
    assert all(r.representative in kept for r in led if r.disposition in ("collapsed", "deferred"))
    assert compaction.excerpt("aaaa bbbb cccc", 10) == "aaaa bbbb…" and compaction.excerpt("a " + "b" * 20, 10) == "a " + "b" * 8 + "…"
    assert compaction.destination("https://h.x/p?q#f") == "h.x/p" and compaction.destination("javascript:alert(1)") == "javascript: [omitted]"


def test_downsampling_and_recovery(spark):
    n = nodes(spark, "<div><div class=c onclick=x id=i><script>s</script><p>t</p></div></div>")
    assert [(r.tag, dict(r.attributes)) for r in compaction.downsampled(n, unwrap=True).where("kind = 'element'").collect()] == [("#document", {}), ("div", {"id": "i"}), ("p", {})]
    assert compaction.recovery_report(nodes(spark, FORM)).first().exact


def test_linear_operators_against_a_naive_walk(spark):
    random.seed(5)
    source = "".join(random.choice(["<div>", "</div>", "<p>", "t", "<li>", "</ul>", "<ul>", "<b>", "</b>", "<div lang=x>", "<nav hidden>", "</nav>"]) for _ in range(400))
    n = nodes(spark, source).cache()
    rows = {r.node: r for r in n.collect()}
    up = lambda i: [] if rows[i].parent < 0 else [rows[i].parent, *up(rows[i].parent)]
    assert {r.node: r.lang for r in tree.inherited(n, F.col("attributes")["lang"], "lang").collect()} == {i: next((rows[j].attributes["lang"] for j in [i, *up(i)] if "lang" in rows[j].attributes), None) for i in rows}
    hidden = {i for i in rows if any(rows[j].tag == "nav" for j in [i, *up(i)])}
    assert {r.node for r in tree.without_subtrees(n, F.col("tag") == "nav").collect()} == set(rows) - hidden
    assert {r.node: r.cost for r in tree.path_cost(n).collect()} == {i: sum(rows[j].sib + 1 for j in [i, *up(i)] if rows[j].depth) for i in rows}
    uls = n.where("tag = 'ul'")
    assert {r.node for r in tree.minimal_roots(uls).collect()} == {i for i in rows if rows[i].tag == "ul" and not any(rows[j].tag == "ul" for j in up(i))}
    assert {(r.node, r.nearest) for r in tree.nearest_flagged(n, uls).collect()} == {(i, next((j for j in up(i) if rows[j].tag == "ul"), None)) for i in rows}
    hits = {i for i in rows if "t" in (rows[i].text or "")}
    assert {(r.node, r.hit) for r in tree.search(n, F.col("text"), "T").collect()} == {(i, i in hits) for i in hits | {j for i in hits for j in up(i)}}
    assert {(r.root, r.node) for r in tree.descendants(uls, n, proper=False).collect()} == {(j, i) for i in rows for j in [i, *up(i)] if rows[j].tag == "ul"}


def test_selectors_find_their_elements(spark):
    n = nodes(spark, "<ul><li>a<li>b<li><a>c</a></ul><p>x</p>")
    paths = tree.selectors(n)
    p = {r.node: r.path for r in paths.collect()}
    assert len(set(p.values())) == len(p) and "ul > li:nth-of-type(3) > a" in p.values()
    asked = spark.createDataFrame([(0, "1", "ul > li:nth-of-type(3) > a", "A"), (0, "2", "p", "div"), (0, "3", "nav", "nav")], "doc_id long, id string, css_path string, tag string")
    found = {r.id: r.node for r in tree.selector_join(asked, paths).collect()}
    assert p[found["1"]] == "ul > li:nth-of-type(3) > a" and found["2"] is None and found["3"] is None


def test_crosswalk(spark):
    n = nodes(spark, "<div id=a><p>x</p></div><p>y</p>")
    x, y = (r.node for r in n.where("kind = 'text'").orderBy("node").collect())
    rows = spark.createDataFrame([(0, "n1", x), (0, "n2", y), (0, "n1", y)], "doc_id long, alias string, node int")
    found = {(r.alias, r.node): (r.ref, r.conflict) for r in tree.crosswalk(rows, n, F.col("attributes")["id"]).collect()}
    assert found == {("n1", x): ("a", True), ("n1", y): (None, True), ("n2", y): (None, False)}

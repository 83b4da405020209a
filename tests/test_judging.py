"""Packets, judgments, preferences, annotations and what may be published."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from treeline.functions import text as tx
from treeline.operators import contracts, judging, release
from treeline.sources import records

OUTLINE = {"page": "P", "scope": "S", "outline": [{"depth": 0, "label": "root", "refs": []}, {"depth": 1, "label": "u", "refs": ["a"]}], "needs_expansion": []}


def judgment(scores, **more):
    quote = {"source": {"kind": "source", "pointer": "/t", "quote": "hello"}, "candidate": {"kind": "candidate", "pointer": "/page", "quote": "P"}}
    criteria = {c: {"status": "assessed", "score": s, "reason": "r", "evidence": list(quote.values())} for c, s in zip(judging.CRITERIA, scores, strict=True)}
    return {"id": "1", "candidate_id": "x", "complete_review": True, "source_sufficient": True, "criteria": criteria, "hard_errors": [], **more}


@pytest.fixture(scope="module")
def packed(spark):
    prompt = [("system", "rules"), ("user", '{"t": "hello world"}')]
    rows = spark.createDataFrame([("1", "d.org", "train", prompt, ["a"])], "id string, domain string, split string, prompt array<struct<role:string,content:string>>, valid_refs array<string>")
    other = {**OUTLINE, "page": "Q"}
    made = [("1", "x", json.dumps(OUTLINE)), ("1", "y", json.dumps(other)), ("1", "w", json.dumps({**OUTLINE, "page": "P "})), ("1", "z", "{"), ("2", "x", "{}"), ("1", "x2", "1"), ("1", "x2", "1")]
    return judging.packets(rows, spark.createDataFrame(made, "id string, candidate_id string, output string")).cache()


def test_packets_never_show_what_was_wanted(packed):
    p = {(r.id, r.candidate_id): r for r in packed.collect()}
    assert p["1", "x"].reasons == [] and p["1", "x"].errors == [] and p["2", "x"].reasons[0] == "unknown id" and "repeated candidate" in p["1", "x2"].reasons
    assert p["1", "z"].errors[0].startswith("invalid candidate") and "completion" not in p["1", "x"].packet


def test_scores_preferences_and_tampering(spark, packed):
    p = {r.candidate_id: r for r in packed.where("id = '1'").collect()}
    y = judgment([3, 3, 2, 2], candidate_id="y")
    for c in y["criteria"].values():
        c["evidence"][1]["quote"] = "Q"
    said = [("1", "x", p["x"].packet_hash, json.dumps(judgment([1, 2, 2, 2]))), ("1", "y", p["y"].packet_hash, json.dumps(y)), ("1", "w", "other", json.dumps(judgment([3] * 4, candidate_id="w")))]
    s = judging.scored(packed.where("id = '1' and candidate_id <> 'x2'"), spark.createDataFrame(said, "id string, candidate_id string, packet_hash string, result string"), "m").cache()
    assert {r.candidate_id: r.decision for r in s.collect()} == {"x": "revise", "y": "accept", "w": "unjudged", "z": "reject"}
    assert [(r.chosen, r.rejected, r.margin) for r in judging.preferences(s).collect()] == [("y", "x", 3)]
    same = s.withColumn("candidate_hash", F.lit("one"))
    assert judging.preferences(same).count() == 0
    assert [r.candidate_id for r in judging.accepted(s).collect()] == ["y"] and judging.stale(s).count() == 0
    assert judging.stale(s.withColumn("decision", F.lit("accept"))).count() == 3
    reviews = [("1", "y", "dev", "accept", "h", True, False, "r"), ("1", "q", "dev", "accept", "h", True, False, "r"), ("1", "x", "dev", "accept", "h", False, False, "r")]
    found = judging.reviewed(s, spark.createDataFrame(reviews, "id string, candidate_id string, split string, decision string, score_hash string, human_reviewed boolean, synthetic boolean, reviewer string"))
    assert {r.candidate_id: r.problem for r in found.collect()} == {"y": "not held out for development", "q": "no such score", "x": "no human review"}


def test_judgment_problems(packed):
    packet = json.loads(packed.where("candidate_id = 'x' and id = '1'").first().packet)
    assert judging.judgment_problems(packet, judgment([3, 2, 2, 2])) == []
    assert "coverage: 0 without hard error" in judging.judgment_problems(packet, judgment([0, 2, 2, 2]))
    hard = {"criterion": "coverage", "reason": "r", "evidence": judgment([0] * 4)["criteria"]["coverage"]["evidence"]}
    assert judging.judgment_problems(packet, judgment([0, 2, 2, 2], hard_errors=[hard])) == [] and judging.decide([], judgment([0, 2, 2, 2], hard_errors=[hard])) == "reject"
    assert "hard error contradicts its criterion" in judging.judgment_problems(packet, judgment([1, 2, 2, 2], hard_errors=[hard]))
    wrong = judgment([3, 2, 2, 2])
    wrong["criteria"]["coverage"]["evidence"][0] = {"kind": "prompt", "pointer": "/0/content", "quote": "rules"}
    assert judging.judgment_problems(packet, wrong) == ["coverage: evidence quotes no user input"]
    wrong["criteria"]["coverage"].update(score=None)
    assert "coverage: status and score contradict" in judging.judgment_problems(packet, wrong)
    assert judging.judgment_problems(packet, []) == ["invalid judgment fields"]


def test_outline_answers():
    assert judging.outline_errors(OUTLINE, {"a"}) == ([], [])
    bad = {**OUTLINE, "outline": [{"depth": 0, "label": "r", "refs": ["a"]}, {"depth": 2, "label": "u", "refs": ["a", "b"]}], "needs_expansion": [{"ref": "q", "reason": "x"}]}
    errors, warnings = judging.outline_errors(bad, {"a"})
    assert errors == ["root has refs", "line 0: unit with children", "line 1: depth jumps", "line 1: unknown ref b", "expansion 0: unknown ref or blank reason"] and warnings == ["line 1: ref a of line 0"]


def test_issue_critic_and_request(spark):
    inventory = json.dumps({"units": [{"id": "u1"}]})
    good, odd = {"severity": "major", "category": "coverage", "units": ["u1"], "reason": "r"}, {"severity": "huge", "category": "coverage", "units": [], "reason": ""}
    rows = spark.createDataFrame([(1, json.dumps({"issues": [good]}), inventory), (2, json.dumps({"issues": [good, odd]}), inventory), (3, "{}", inventory), (4, json.dumps({"issues": []}), "{}")], "k int, response string, inventory string")
    f = {r.k: (r.problems, r.serious) for r in judging.critic_findings(rows).collect()}
    assert f[1] == ([], True) and f[2] == (["issue 1 is invalid"], False) and f[3][0] and f[4][0] == ["inventory is invalid"]
    payload = {"systemInstruction": {"parts": [{"text": "s"}]}, "contents": [{"role": "user", "parts": [{"text": '{"browser_observation": {}}'}]}]}
    stamp = hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    reqs = spark.createDataFrame([(json.dumps({"payload": payload, "request_sha256": h}),) for h in (stamp, "x")] + [("{}",)], "request string")
    assert [r.problem for r in judging.critic_request(reqs).collect()] == [None, "hash differs", "unexpected prompt"]


def test_result_consistency():
    row = {"graph": "pass", "references": "pass", "gates": [{"name": "structural_integrity", "status": "pass"}], "criteria": [{"name": "fidelity", "status": "assessed", "score": 3, "checks": ["pass"]}], "issues": []}
    assert judging.consistency_problems(row) == []
    bad = {**row, "graph": "fail", "criteria": [{"name": "fidelity", "status": "assessed", "score": 0, "checks": ["not_assessable"]}, {"name": "c", "status": "not_applicable", "score": 2, "checks": ["pass"]}], "issues": [{"id": "i", "criterion": None, "gates": [], "n_evidence": 0}] * 2}
    assert len(judging.consistency_problems(bad)) == 10


def test_annotations():
    payload = json.dumps({"steps": [{"step": 1, "observation": {}, "action": None}]})
    texts = dict.fromkeys(("observed_behavior", "hierarchy_hypothesis", "alternative_explanation", "uncertainty"), "t")
    segment = {"step_ids": [1], "effect": "helpful", **texts, "evidence": [{"step": 1, "channel": "observation", "detail": "d"}]}
    assert judging.annotation_problems(json.dumps({"segments": [segment]}), payload) == []
    assert judging.annotation_problems(json.dumps({"segments": [{**segment, "evidence": [{"step": 1, "channel": "action", "detail": "d"}]}]}), payload) == ["segment 0: evidence of an unavailable channel"]
    assert judging.annotation_problems(json.dumps({"segments": [segment] * 7}), payload) and judging.annotation_problems(json.dumps({"segments": [{**segment, "step_ids": [2]}]}), payload)
    report = {"segment_index": 0, "step_ids": [1], "agreement": "supports", "interpretation": "i", "uncertainty": "u", "self_report_evidence": [{"step": 1, "field": "purpose", "detail": "d"}]}
    reports = json.dumps([{"step": 1, "purpose": "p"}])
    assert judging.self_report_problems(json.dumps({"comparisons": [report]}), payload, 1, reports) == []
    assert judging.self_report_problems(json.dumps({"comparisons": [{**report, "self_report_evidence": []}]}), payload, 1, reports) == ["comparison 0: no evidence"]
    assert judging.self_report_problems(json.dumps({"comparisons": [report]}), payload, 2, reports) == ["not one comparison for each segment"]


def test_hidden_keys_and_outputs(spark):
    deep = "[" * 900 + '{"model": 1, "a": 2}' + "]" * 900
    rows = spark.createDataFrame([('{"model": 1, "x": [{"model": 2, "b": 1}]}',), ("{",), (None,), (deep,)], "t string")
    found = [r[0] for r in rows.select(judging.public_json(F.col("t"), ["model"])).collect()]
    assert found[:3] == ['{"x":[{"b":1}]}', None, None] and '"model"' not in (found[3] or "")
    texts = spark.createDataFrame([('{"outline": [{"depth": 0}]}',), ("x\n```json\n[1]\n```",), ("- a\n  - b [r1, r2]",), ("none",)], "t string")
    out = [(r.format, r.outline) for r in judging.loaded_outputs(texts, "t").collect()]
    assert out[0] == ("json", '[{"depth":0}]') and out[1] == ("json", "[1]") and json.loads(out[2][1])[1] == {"depth": 1, "label": "b", "refs": ["r1", "r2"]} and out[3] == ("none", None)


def test_preflight(spark):
    schema = "packet string, id string, kind string, children array<string>, refs array<string>"
    n = spark.createDataFrame([("p", "r", "group", ["a"], []), ("p", "a", "dom", [], ["s1"]), ("q", "r", "group", ["b"], []), ("q", "b", "group", ["r"], ["zz"]), ("q", "l", "dom", ["r"], [])], schema)
    roots = spark.createDataFrame([("p", "r"), ("q", "r")], "packet string, root string")
    inv = spark.createDataFrame([("p", "s1", True), ("q", "s1", False)], "packet string, id string, complete boolean")
    got = {(r.packet, r.check): r.status for r in contracts.preflight(n, roots, spark.createDataFrame([("q", "s9")], "packet string, id string"), inv).collect()}
    assert {s for (p, _), s in got.items() if p == "p"} == {"pass"}
    assert (got["q", "cycle"], got["q", "unreachable node"], got["q", "several parents"], got["q", "dom leaf with children"], got["q", "required ref missing"], got["q", "unresolved ref"]) == ("fail", "fail", "fail", "fail", "not_assessable", "not_assessable")


def test_publication(spark):
    rows = [(1, 1, "a", {"href": "https://ok.org/p?q=1", "onclick": "x", "title": "me@x.org"}, "see https://ok.org/a#b and http://bad.org"), (1, 2, "input", {"type": "text"}, "typed"), (1, 3, "p", {}, "password: hunter2 and more"), (1, 4, "p", {"id": "i"}, "at /home/me/x C:\\dir")]
    n = spark.createDataFrame(rows, "doc_id long, node int, tag string, attributes map<string,string>, text string")
    once = release.published_nodes(n, ["ok.org"])
    got = {r.node: (r.attributes, r.text) for r in once.collect()}
    assert got == {1: ({}, "see https://ok.org/a and [omitted]"), 2: ({"type": "text"}, ""), 3: ({}, "[omitted]"), 4: ({"id": "i"}, "at [omitted] [omitted]")}
    assert release.publication_findings(once, ["ok.org"]).count() == 0 and release.publication_findings(n, ["ok.org"]).count() >= 6
    assert once.where(release.unsafe_strings(once.drop("attributes"), ["ok.org"])).count() == 0 and n.where(release.unsafe_strings(n.drop("attributes"), ["ok.org"])).count() == 3
    files = spark.createDataFrame([("a/.env", "x"), ("ok.txt", "one\nkey AKIA" + "A" * 16 + "\n"), ("k.pem", "")], "path string, t string")
    assert {(r.path, r.line, r.type) for r in release.secret_findings(files, "path", "t").collect()} == {("a/.env", 0, "local-only file"), ("k.pem", 0, "local-only file"), ("ok.txt", 2, "AWS access key")}
    jpegs = spark.createDataFrame([(bytearray(b),) for b in (b"\xff\xd8\xff\xda\0\0", b"\xff\xd8\xff\xe1\0\4ab\xff\xda\0\0", b"\xff\xd8\xff\xe0\0\1", b"GIF", b"\xff\xd8")], "b binary")
    assert [r[0] for r in jpegs.select(release.image_problem("b")).collect()] == [None, "metadata or comment", "invalid segment", "no JPEG", "no image data"]
    s = spark.createDataFrame([("h", "data-r", False, "o", ["b", "a"])], "h string, a string, p boolean, o string, r array<string>")
    assert json.loads(s.select(release.student_input(s.h, s.a, s.p, s.o, s.r)).first()[0])["assignable_refs"] == ["b", "a"] and "assignable_refs" not in s.select(release.student_input(s.h, s.a, s.p, s.o, s.r, 3)).first()[0]


def test_templates_tell_ends(spark):
    rows = spark.createDataFrame([("<div><p>a</p></div>",), ("<div></div><p>a</p>",), ("<div><p>b</p></div>",), ("<div class><p>b</p></div>",)], "html string")
    a, b, c, d = (r[0] for r in rows.select(tx.template_signature("html")).collect())
    assert a == c and len({a, b, d}) == 3


def test_records(spark, tmp_path):
    good = {"id": "1", "domain": "d", "split": "train", "prompt": [{"role": "user", "content": "q"}], "completion": [{"role": "assistant", "content": "a"}]}
    lines = [json.dumps(good), "", json.dumps({**good, "split": "dev", "id": "2"}), '{"a":1,"a":2}', json.dumps({**good, "id": "3", "prompt": []}), json.dumps(good), "[1]"]
    (tmp_path / "r.jsonl").write_text("\n".join(lines))
    read = records.read_lines(spark, str(tmp_path / "r.jsonl"))
    got = {r.line: r.problem for r in records.training_records(read, "train").collect()}
    assert got[1] == got[6] == "repeated id" and got[3] == "split is not train" and "repeated key" in got[4] and got[5] == "prompt is empty" and "no object" in got[7] and len(got) == 6
    with pytest.raises(Exception, match="repeated key"):
        records.required(read, "problem").count()
    m = records.snapshot({"t": read.select("line")}, str(tmp_path / "snap")).first()
    assert (m.name, m.n_rows) == ("t", 6)
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        records.snapshot({"t": read.select("line")}, str(tmp_path / "snap"))
    found = records.artifacts(spark, str(tmp_path / "r.jsonl"))
    listed = spark.createDataFrame([("r.jsonl", 1, "x"), ("../up", 1, "x"), ("gone", 1, "x")], "name string, n_bytes long, sha256 string")
    assert {r.name: r.problem for r in records.verified(found, listed).collect()} == {"r.jsonl": "length or hash differs", "../up": "escapes the folder", "gone": "missing"}


def test_accessibility_trees(spark):
    node = lambda i, **k: {"nodeId": i, "role": {"value": "button"}, "name": {"value": "n"}, **k}
    trees = {"a": [node(1, childIds=[2]), node(2, properties=[{"name": "disabled", "value": {"value": True}}]), node(2, properties=[{"name": "disabled", "value": {"value": True}}]), node(3)], "b": [node(1), node(1, ignored=True)], "c": [node(1, childIds=[9])], "d": [node(1, childIds=[2]), node(2, childIds=[1])]}
    rows = spark.createDataFrame([(k, "http://h/key/z/p", json.dumps({"nodes": v})) for k, v in trees.items()] + [("e", "u", "{")], "snapshot_id string, url string, tree string")
    n = records.accessibility_nodes(rows).cache()
    a = n.where("snapshot_id = 'a'").collect()
    assert len(a) == 3 and sum(r.is_root for r in a) == 2 and a[0].raw_records == 4 and a[0].repeated_ids == 1 and a[1].parent == "a:ax:1" and a[1].properties == {"disabled": "true"}
    assert {r.snapshot_id: r.problem for r in n.where("problem is not null").collect()}.keys() == {"b", "c", "d", "e"}
    again = records.accessibility_nodes(rows.where("snapshot_id = 'a'").withColumns({"snapshot_id": F.lit("x"), "url": F.lit("http://h/key/other/p")}))
    assert records.fingerprints(n).where("snapshot_id = 'a'").first().fingerprint == records.fingerprints(again).first().fingerprint


def test_captures_and_variants(spark):
    e = spark.createDataFrame([(1, 1, None, "SCRIPT", "t", "t", {}, "p", "", False, "none", ""), (1, 2, 1, "p", "t", None, {"a": "b"}, "p", "c1", None, None, None)], "doc_id long, node int, parent int, tag string, text string, own_text string, attributes map<string,string>, css_path string, classes string, hidden_evidence boolean, display string, visibility string")
    x = {r.node: r for r in records.exported(e).collect()}
    assert (x[1].text, x[1].hidden, x[2].hidden, x[2].own_text_available, x[2].attributes) == ("", True, False, False, {"a": "b", "class": "c1"})
    cat = spark.createDataFrame([(1, "v1", "old"), (1, "v2", "keep"), (2, "v1", "old2")], "doc_id long, variant string, tree string")
    new = spark.createDataFrame([(1, "v1", "new", ["1"]), (2, "v1", "bad", ["77"])], "doc_id long, variant string, tree string, refs array<string>")
    assert {(r.doc_id, r.variant): r.tree for r in records.imported_variants(cat, new, e).collect()} == {(1, "v1"): "new", (1, "v2"): "keep", (2, "v1"): "old2"}
    files = spark.createDataFrame([("/x/a.jpg", bytearray(b"\xff\xd8\xff")), ("/x/b.jpg", bytearray(b"GIF")), ("/x/c.json", bytearray(b"{}"))], "path string, content binary")
    assert {(r.id, r.problem) for r in records.prebuilt(files).collect()} == {("a", None), ("b", "no JPEG"), ("c", None)}
    scan = records.compact_scan(spark.createDataFrame([(1, '<div data-r="a" data-deferred="1"><p>x</p></div><p data-r="b">y</p>')], "page_id long, html string"), "page_id", "html")
    assert {(r.text, r.ref, r.partial) for r in scan.where("kind = 'text'").collect()} == {("x", "a", True), ("y", "b", False)}

"""Files to tables, datasets, and episodes."""

import pytest

from treeline.operators import traces
from treeline.plans import interface
from treeline.sources import html

PAGE = "<html><body><h1>A</h1><p>one</p><ul><li>x</li><li>y</li></ul><form><input id=n><label for=n>N</label></form></body></html>"


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pages")
    for name, source in (("a", PAGE), ("b", "<p>two</p>")):
        (folder / f"{name}.html").write_text(source)
    return interface.read_pages(spark, str(folder)).cache()


def test_files_and_artifacts(spark, pages, tmp_path):
    assert [r.url[-6:] for r in pages.orderBy("page_id").collect()] == ["a.html", "b.html"] and len(interface.snapshot_id(pages)) == 64
    manifest = {r.name: r.n_rows for r in interface.artifacts(pages, str(tmp_path / "out")).collect()}
    assert manifest["pages"] == 2 and manifest["views"] == 2 and manifest["observation"] == manifest["ledger"] and manifest["relations"] >= 2
    assert interface.read_records(spark, str(tmp_path / "out" / "nodes")).count() == manifest["nodes"]
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        interface.artifacts(pages, str(tmp_path / "out"))


def test_operations_by_name(pages):
    nodes = html.nodes(pages, context=True)
    assert interface.operate("adapt", nodes).count() == interface.operate("pipeline", nodes, profile="structure", max_bytes=10**6).agg({"n_nodes": "sum"}).first()[0]
    with pytest.raises(ValueError, match="no operation"):
        interface.operate("guess", nodes)


def test_datasets_are_checked_before_they_are_written(spark, pages, tmp_path):
    nodes = html.nodes(pages, context=True).drop("context", "attributes")
    schema = "doc_id long, variant string, id string, parent string, source_refs array<string>"
    good = spark.createDataFrame([(0, "v", "r", None, []), (0, "v", "a", "r", ["1"])], schema)
    assert {r.name: r.n_rows for r in interface.build_dataset(nodes, good, str(tmp_path / "d")).collect()} == {"captures": nodes.count(), "hierarchies": 2, "catalog": 1}
    bad = spark.createDataFrame([(0, "v", "r", "a", []), (0, "v", "a", "r", ["99999"])], schema)
    assert {r.finding for r in interface.dataset_findings(nodes, bad).collect()} == {"cycle", "dangling reference"}
    with pytest.raises(ValueError, match="0: "):
        interface.build_dataset(nodes, bad, str(tmp_path / "never"))


def test_compression_datasets(pages, tmp_path):
    nodes = html.nodes(pages, context=True)
    m = {r.name: r.n_rows for r in interface.compression_dataset(nodes, {"structure": 10**6, "budget": 200}, str(tmp_path / "c")).collect()}
    assert m["catalog"] == 4 and m["ledger-budget"] == m["ledger-structure"] == nodes.count()
    source = nodes.select("doc_id", "node", "tag", "parent")
    ledger = source.withColumn("disposition", source.tag.substr(1, 0)).replace("", "retained", ["disposition"])
    assert interface.compression_findings(source, ledger, source).count() == 0
    assert interface.compression_findings(source, ledger, source.where("node <> 1")).count() == 2


def test_splits_are_written_once(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"d{i // 2}", f"t{i // 3}") for i in range(12)], "id long, domain string, template string")
    assert {r.name: r.n_rows for r in interface.frozen_splits(rows, "id", ["domain", "template"], "s", str(tmp_path / "f")).collect()} == {"splits": 12, "rows": 12}


def test_episode_outcomes(spark):
    steps = [("a", 1, "move", 1.0, None), ("a", 2, "stop", 1.0, None), ("a", 3, "move", 1.0, None), ("b", 1, "action", 1.0, None), ("b", 2, "action", 1.0, None), ("c", 1, "move", 99.0, None), ("d", 1, "move", 1.0, "boom"), ("e", 1, "move", 1.0, None)]
    out = traces.episode_outcomes(spark.createDataFrame(steps, "episode string, step int, kind string, seconds double, error string"), 10, 2, 50.0)
    assert {r.episode: (r.steps, r.status) for r in out.collect()} == {"a": (2, "stopped"), "b": (2, "action_limit"), "c": (1, "time_limit"), "d": (1, "error"), "e": (1, "open")}

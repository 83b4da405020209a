"""Sources and sinks of records: strict JSON lines, hashed artifacts, accessibility trees, captures and frozen snapshots.

What is wrong with a row is a column or a row of its own; a source that must not
hold such rows is read through required(), which fails on the first of them.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treeline.functions.text import canonical, strict_json
from treeline.operators.judging import mapped
from treeline.operators.perdoc import per_document
from treeline.sources import html as page_source


def required(rows: DataFrame, problem: str) -> DataFrame:
    """rows without the problem column; a row that has one fails the job with it."""
    return rows.withColumn(problem, F.when(F.col(problem).isNotNull(), F.raise_error(F.col(problem).cast("string")))).where(F.col(problem).isNull()).drop(problem)


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, line, record, problem): JSON lines with their places: canonical JSON, or what is wrong; blank lines are skipped.

    Files are read whole, so that lines have numbers; a file is one row.
    """
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    lines = files.select("path", F.posexplode(F.split("value", "\n")).alias("at", "raw")).where(F.trim("raw") != "")

    def run(row: dict) -> dict:
        try:
            value = strict_json(row["raw"])
        except (ValueError, RecursionError) as e:
            return {"record": None, "problem": f"{row['path']}:{row['at'] + 1}: {e}"}
        return {"record": canonical(value), "problem": None if isinstance(value, dict) else f"{row['path']}:{row['at'] + 1}: no object"}

    return mapped(lines, run, "record string, problem string").select("path", (F.col("at") + 1).alias("line"), "record", "problem")


def training_records(lines: DataFrame, split: str) -> DataFrame:
    """lines (path, line, record, problem) with id, domain, and the first thing that is wrong with a training record: its texts, its split, its messages, an id that comes twice."""

    def run(row: dict) -> dict:
        none = {"id": None, "domain": None}
        if row["problem"] or row["record"] is None:
            return {**none, "wrong": row["problem"] or "no record"}
        r = json.loads(row["record"])
        out = {"id": r.get("id") if isinstance(r.get("id"), str) else None, "domain": r.get("domain") if isinstance(r.get("domain"), str) else None}
        if any(not (out[k] or "").strip() for k in out):
            return {**out, "wrong": "id or domain is blank"}
        if r.get("split") != split:
            return {**out, "wrong": f"split is not {split}"}
        for key in ("prompt", "completion"):
            said = r.get(key)
            if not isinstance(said, list) or not said:
                return {**out, "wrong": f"{key} is empty"}
            if any(not isinstance(m, dict) or m.get("role") not in ("system", "user", "assistant") or not isinstance(m.get("content"), str) or not m["content"].strip() for m in said):
                return {**out, "wrong": f"{key} holds more than text messages"}
        if r["prompt"][-1]["role"] != "user" or len(r["completion"]) != 1 or r["completion"][0]["role"] != "assistant":
            return {**out, "wrong": "prompt does not end with a user, or there is not one answer"}
        return {**out, "wrong": None}

    read = mapped(lines, run, "id string, domain string, wrong string")
    n = read.where("id is not null").groupBy("id").agg(F.count("*").alias("times"))
    out = read.join(n, "id", "left").withColumn("problem", F.coalesce("wrong", F.when(F.col("times") > 1, "repeated id")))
    return out.select("path", "line", "id", "domain", "record", "problem")


def write_lines(rows: DataFrame, path: str) -> None:
    """JSON lines of the rows, nulls kept; a path that exists is an error."""
    rows.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """(name, n_bytes, sha256, content) of the files of a folder, by name below it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select(name.alias("name"), F.length("content").cast("long").alias("n_bytes"), F.sha2("content", 256).alias("sha256"), "content")


def verified(found: DataFrame, listed: DataFrame) -> DataFrame:
    """listed artifacts (name, n_bytes, sha256) with content, and the problem: a name that leaves the folder, a missing file, another length or hash."""
    f = found.select("name", F.col("n_bytes").alias("_n"), F.col("sha256").alias("_s"), "content")
    j = listed.join(f, "name", "left")
    problem = F.when(F.col("name").rlike(r"(^/)|(^|/)\.\.(/|$)"), "escapes the folder").when(F.col("_n").isNull(), "missing").when((F.col("_n") != F.col("n_bytes")) | (F.col("_s") != F.col("sha256")), "length or hash differs")
    return j.select("name", "n_bytes", "sha256", F.when(problem.isNull(), F.col("content")).alias("content"), problem.alias("problem"))


def snapshot(tables: dict[str, DataFrame], folder: str) -> DataFrame:
    """Writes the tables below a folder that must not exist, a manifest last, and gives the manifest: (name, n_rows, digest).

    The digest does not depend on the order of rows. A folder without manifest is
    an unfinished snapshot.
    """
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{folder}/{name}")
        again = spark.read.parquet(f"{folder}/{name}")
        n, mark = again.agg(F.count("*"), F.bit_xor(F.xxhash64(F.to_json(F.struct(*sorted(again.columns)), {"ignoreNullFields": "false"})))).first()
        rows.append((name, n, f"{(mark or 0) & ((1 << 64) - 1):016x}"))
    manifest = spark.createDataFrame(rows, "name string, n_rows long, digest string")
    manifest.coalesce(1).write.mode("errorifexists").json(f"{folder}/manifest")
    return manifest


def snapshot_id(parts: list[bytes]) -> str:
    """Identity of several sources: hash of their bytes with their lengths before them."""
    h = hashlib.sha256()
    for p in parts:
        h.update(len(p).to_bytes(8, "big") + p)
    return h.hexdigest()


AX = "snapshot_id string, url string, node string, parent string, place int, role string, name string, value string, description string, bid string, ignored boolean, properties map<string,string>, is_root boolean, raw_records int, unique_nodes int, repeated_ids int, problem string"


def _plain(value: object) -> str:
    value = value.get("value") if isinstance(value, dict) else value
    return "" if value is None else value if isinstance(value, str) else json.dumps(value)


def accessibility_nodes(captures: DataFrame) -> DataFrame:
    """A row for each accessibility node of captures (snapshot_id, url, tree: JSON with nodes); a capture that cannot be taken has one row with its problem.

    Equal records of one id are one; records that differ, children that are
    missing, and trees without a root are problems. Roots are nodes that no
    other names as a child. Ids are scoped by the snapshot.
    """

    def run(rows: list[dict]) -> list[dict]:
        out = []
        for row in rows:
            base = {"snapshot_id": row["snapshot_id"], "url": row["url"]}
            try:
                raw = strict_json(row["tree"])["nodes"]
                by_id: dict[str, dict] = {}
                repeated = set()
                for r in raw:
                    i = str(r["nodeId"])
                    if i in by_id and by_id[i] != r:
                        raise ValueError(f"records of node {i} differ")
                    repeated |= {i} if i in by_id else set()
                    by_id[i] = r
                parent: dict[str, tuple[str, int]] = {}
                for i, r in by_id.items():
                    for k, c in enumerate(map(str, r.get("childIds", []))):
                        if c not in by_id:
                            raise ValueError(f"child {c} is missing")
                        parent.setdefault(c, (i, k))
                if by_id and len(parent) == len(by_id):
                    raise ValueError("no root")
            except (TypeError, ValueError, KeyError, RecursionError) as e:
                out.append({**base, "problem": str(e) or "no tree"})
                continue
            scope = lambda i: f"{row['snapshot_id']}:ax:{i}"
            counts = {"raw_records": len(raw), "unique_nodes": len(by_id), "repeated_ids": len(repeated)}
            for i, r in by_id.items():
                up, place = parent.get(i, (None, 0))
                states = {p.get("name"): _plain(p.get("value")) for p in r.get("properties", []) if isinstance(p.get("name"), str)}
                bid = r.get("browsergym_id")
                out.append({
                    **base, **counts, "node": scope(i), "parent": None if up is None else scope(up), "place": place, "role": _plain(r.get("role")), "name": _plain(r.get("name")), "value": _plain(r.get("value")),
                    "description": _plain(r.get("description")), "bid": None if bid is None else str(bid), "ignored": bool(r.get("ignored", False)), "properties": list(states.items()), "is_root": up is None, "problem": None,
                })
        return out

    return per_document(captures.select("snapshot_id", "url", "tree"), run, AX, key="snapshot_id")


def fingerprints(nodes: DataFrame) -> DataFrame:
    """(snapshot_id, fingerprint) of accessibility nodes: hash of what a capture shows whatever its ids are: nodes numbered in order, kept states, the URL without its session."""
    from treeline.functions.text import masked_session
    from treeline.operators.observe import kept_properties

    number = F.row_number().over(Window.partitionBy("snapshot_id").orderBy("node")) - 1
    n = nodes.where("problem is null").withColumn("n", number)
    up = n.select("snapshot_id", F.col("node").alias("parent"), F.col("n").alias("up"))
    n = n.join(up, ["snapshot_id", "parent"], "left")
    states = F.array_sort(F.map_entries(kept_properties(F.col("properties"))))
    one = F.to_json(F.struct("n", "up", "place", "role", "name", "value", "description", "ignored", states.alias("states")), {"ignoreNullFields": "false"})
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", one.alias("j")))), lambda x: x["j"]), "\n")
    return n.groupBy("snapshot_id").agg(F.sha2(F.concat_ws("\n", F.first(masked_session(F.col("url"))), listed), 256).alias("fingerprint"))


def exported(elements: DataFrame) -> DataFrame:
    """Capture elements (doc_id, node, parent, tag, text, own_text, attributes, css_path, classes, hidden_evidence, display, visibility) as inspected: inert text blanked, hidden by evidence or style, classes among the attributes."""
    inert = F.lower("tag").isin("script", "style")
    hidden = F.coalesce("hidden_evidence", F.lit(False)) | F.coalesce(F.col("display") == "none", F.lit(False)) | F.coalesce(F.col("visibility") == "hidden", F.lit(False))
    given = F.coalesce("attributes", F.create_map().cast("map<string,string>"))
    classed = F.when((F.col("classes") != "") & ~F.map_contains_key(given, F.lit("class")), F.map_concat(given, F.create_map(F.lit("class"), F.col("classes")))).otherwise(given)
    return elements.select(
        "doc_id", "node", "parent", "tag", F.when(inert, "").otherwise(F.col("text")).alias("text"), F.when(inert, "").otherwise(F.col("own_text")).alias("own_text"),
        F.col("own_text").isNotNull().alias("own_text_available"), classed.alias("attributes"), "css_path", hidden.alias("hidden"),
    )


def own_text(own: Column, text: Column, has_children: Column) -> Column:
    """Text of a node itself: where it is not known, all text of a leaf, and none of what holds others."""
    return F.coalesce(own, F.when(~has_children, text), F.lit(""))


def capture_metadata(elements: DataFrame) -> DataFrame:
    """(doc_id, node, css_path, tag): the index of a capture."""
    return elements.select("doc_id", "node", "css_path", "tag")


def joined_geometry(elements: DataFrame, geometry: DataFrame) -> DataFrame:
    """Elements with the rectangle of the capture (doc_id, node, x, y, w, h); those without one stay."""
    return elements.join(geometry, ["doc_id", "node"], "left")


def imported_variants(catalog: DataFrame, trees: DataFrame, nodes: DataFrame) -> DataFrame:
    """The catalog (doc_id, variant, tree) with imported trees in place of those of the same name; a capture of which any imported tree has a dangling reference keeps all it had.

    trees: doc_id, variant, tree, refs (array of node ids).
    """
    refs = trees.select("doc_id", F.explode("refs").alias("node")).distinct()
    bad = refs.join(nodes.select("doc_id", F.col("node").cast("string").alias("node")), ["doc_id", "node"], "left_anti").select("doc_id").distinct()
    good = trees.join(bad, "doc_id", "left_anti").select("doc_id", "variant", "tree")
    return catalog.join(good, ["doc_id", "variant"], "left_anti").select("doc_id", "variant", "tree").unionByName(good)


def catalogued(datasets: DataFrame) -> DataFrame:
    """(id, variants, n_nodes) of datasets (id, variant, n_nodes), each once."""
    return datasets.groupBy("id").agg(F.sort_array(F.collect_set("variant")).alias("variants"), F.max("n_nodes").alias("n_nodes"))


def upserted(catalog: DataFrame, new: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows of the catalog, those of the new table in place of theirs with the same key. Entries of several sources, whose ids may meet, have the source in the key."""
    return catalog.join(new, key, "left_anti").unionByName(new, allowMissingColumns=True)


def prebuilt(files: DataFrame) -> DataFrame:
    """(id, kind, problem) of binary files (path, content): the stem of the name is the id, and what calls itself a JPEG has to begin like one."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    kind = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    problem = F.when(kind.isin("jpg", "jpeg") & (F.hex(F.substring("content", 1, 2)) != "FFD8"), "no JPEG")
    return files.select(F.regexp_replace(name, r"\.[^.]+$", "").alias("id"), kind.alias("kind"), problem.alias("problem"))


def one_to_one(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """(key, problem): keys that one side lacks or has twice; none if the sides match."""
    l = left.groupBy(*key).agg(F.count("*").alias("_l"))
    r = right.groupBy(*key).agg(F.count("*").alias("_r"))
    problem = F.when(F.col("_r").isNull(), "only left").when(F.col("_l").isNull(), "only right").when((F.col("_l") > 1) | (F.col("_r") > 1), "repeated")
    return l.join(r, key, "full_outer").select(*key, problem.alias("problem")).where("problem is not null")


def audited(inventory: DataFrame, reports: DataFrame, artifacts_: DataFrame) -> DataFrame:
    """(doc_id, problem) over inventory (doc_id), reports (doc_id, name, n_bytes, sha256, n_elements) and artifacts (name, n_bytes, sha256, n_elements): what does not agree."""
    a = artifacts_.select("name", *(F.col(c).alias(f"_{c}") for c in ("n_bytes", "sha256", "n_elements")))
    j = reports.join(a, "name", "left")
    checks = {"artifact is missing": F.col("_n_bytes").isNull(), "length differs": F.col("_n_bytes") != F.col("n_bytes"), "hash differs": F.col("_sha256") != F.col("sha256"), "element count differs": F.col("_n_elements") != F.col("n_elements")}
    found = j.select("doc_id", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(m)) for m, c in checks.items())))).alias("problem"))
    return found.unionByName(one_to_one(inventory, reports, ["doc_id"]))


def namespaced(refs: DataFrame, place: str) -> DataFrame:
    """refs with ref scoped by the number of its document in order, from 0."""
    w = Window.orderBy(place)
    numbers = refs.select("doc_id", place).distinct().withColumn("_d", F.row_number().over(w) - 1)
    return refs.join(numbers.drop(place), "doc_id").withColumn("ref", F.concat(F.lit("d"), F.col("_d").cast("string"), F.lit(":"), F.col("ref"))).drop("_d")


#: Attributes by which compact markup marks what it left out.
PARTIAL = ["data-excerpt", "data-deferred", "data-omitted-items", "data-preview", "data-relations-deferred"]


def compact_scan(pages: DataFrame, id_col: str, html_col: str, reference: str = "data-r") -> DataFrame:
    """Nodes of compact markup with ref (that of the closest node that has one) and partial: whether it, or anything around it, says that content was left out."""
    nodes = page_source.nodes(pages, id_col, html_col)

    def run(rows: list[dict]) -> list[dict]:
        at = {r["node"]: i for i, r in enumerate(rows)}
        out: list[dict] = []
        for r in rows:
            a = dict(r["attributes"] or [])
            up = out[at[r["parent"]]] if r["parent"] in at else {"ref": None, "partial": False}
            out.append({k: r[k] for k in ("doc_id", "node", "parent", "kind", "tag", "text")} | {"ref": a.get(reference, up["ref"]), "partial": up["partial"] or any(k in a for k in PARTIAL)})
        return out

    return per_document(nodes, run, "doc_id long, node int, parent int, kind string, tag string, text string, ref string, partial boolean")


def call_log(lines: DataFrame) -> DataFrame:
    """Call-log files (path, value: whole text) as one table (path, line, call, record) in the order of calls: only lines that end count, an empty or malformed one fails the job."""
    whole = lines.select("path", F.posexplode(F.slice(F.split("value", "\n", -1), F.lit(1), F.size(F.split("value", "\n", -1)) - 1)).alias("at", "raw"))
    call = F.get_json_object("raw", "$.call")
    checked = whole.select("path", (F.col("at") + 1).alias("line"), F.when((F.col("raw") != "") & call.isNotNull(), call.cast("long")).otherwise(F.raise_error(F.concat(F.lit("malformed line in "), "path")).cast("long")).alias("call"), F.col("raw").alias("record"))
    return checked.orderBy("call", "path", "line")

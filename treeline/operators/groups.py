"""Grouped hierarchies over observed captures: what of a capture counts, regions of bounded size, decoding and checking of proposed groups, and assembly.

Captures are node tables (doc_id, node, parent, pre, end, depth, sib, kind, tag,
attributes, text); groups are tables (doc_id, id, label, parent, source_ids).
Checks return findings as rows, so a whole corpus is checked in one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treeline.operators.perdoc import by_document, per_document
from treeline.operators.tree import _open_around, nearest_flagged

#: Limits of groups, labels, ids, regions, context and outline.
MAX_GROUPS, MODEL_GROUPS, COMPOSED_GROUPS, MAX_LABEL, MAX_ID, MAX_REGIONS, MAX_CONTEXT, MAX_OUTLINE = 48, 46, 8, 100, 64, 12, 32, 48
#: Tags without meaning of their own, tags nobody meets, tags and roles of an outline.
GENERIC = ["div", "span", "center", "font", "b", "i", "svg", "g", "path"]
INERT = ["script", "style", "template", "noscript", "head"]
OUTLINE_TAGS = ["main", "nav", "header", "footer", "aside", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6", "form", "dialog"]
OUTLINE_ROLES = ["main", "navigation", "banner", "contentinfo", "region", "dialog"]
#: Attributes that count as evidence besides aria ones, and those that refer to other nodes.
EVIDENCE = ["id", "role", "href", "type", "title", "alt", "name", "value", "for", "placeholder", "checked", "selected", "disabled", "required", "multiple", "readonly", "open", "tabindex", "hidden"]
RELATIONS = ["for", "aria-labelledby", "aria-describedby", "aria-controls", "aria-owns", "aria-details", "aria-errormessage"]
#: Containers and titles of proposals, and how many are offered.
CONTAINERS = ["main", "nav", "header", "footer", "aside", "section", "article", "form", "dialog", "fieldset", "table", "ul", "ol", "dl"]
TITLES = ["h1", "h2", "h3", "h4", "h5", "h6", "legend", "caption"]
OFFERED = 24

CAPTURE = "doc_id long, node int, parent int, pre int, end int, depth int, sib int, tag string, text string, attributes map<string,string>, hidden boolean, status string"


def _prepared(rows: list[dict]) -> list[dict]:
    """Rows of one capture's elements with status: kept, hidden, inert or collapsed; kept ones are renumbered into a tree of their own."""
    elements = [r for r in rows if r["kind"] == "element" and r["tag"] != "#document"]
    at = {r["node"]: i for i, r in enumerate(elements)}
    parent = [at.get(r["parent"], -1) for r in elements]
    attributes = [dict(r["attributes"] or []) for r in elements]
    own: list[list[str]] = [[] for _ in elements]
    for r in rows:
        if r["kind"] == "text" and r["parent"] in at:
            own[at[r["parent"]]].append(r["text"] or "")
    text = ["".join(t).strip() for t in own]
    n = len(elements)
    end = [i + 1 for i in range(n)]
    for i in range(n - 1, -1, -1):
        if parent[i] >= 0:
            end[parent[i]] = max(end[parent[i]], end[i])
    ids: dict[str, list[int]] = {}
    for i, a in enumerate(attributes):
        if a.get("id"):
            ids.setdefault(a["id"], []).append(i)
    needed = bytearray(n)  # what a relation names stays though hidden, with all below it and the way to it
    for a in attributes:
        for name in RELATIONS:
            for token in a.get(name, "").split():
                if len(ids.get(token, ())) == 1:
                    t = ids[token][0]
                    needed[t : end[t]] = b"\1" * (end[t] - t)
                    while (t := parent[t]) >= 0 and not needed[t]:
                        needed[t] = 1
    status, hidden = ["kept"] * n, [False] * n
    for i, r in enumerate(elements):
        up = parent[i]
        hidden[i] = "hidden" in attributes[i] or attributes[i].get("aria-hidden", "").lower() == "true" or (up >= 0 and hidden[up])
        if r["tag"] in INERT or (up >= 0 and status[up] == "inert"):
            status[i] = "inert"
        elif hidden[i] and not needed[i]:
            status[i] = "hidden"
    evidence = [{k: v for k, v in a.items() if k in EVIDENCE or k.startswith("aria-")} for a in attributes]
    inside: list[list[int]] = [[] for _ in elements]
    for i in range(n - 1, -1, -1):
        if status[i] == "kept" and elements[i]["tag"] in GENERIC and not text[i] and not evidence[i] and len(inside[i]) <= 1:
            status[i] = "collapsed"
        held = inside[i] if status[i] != "kept" else [i]
        if parent[i] >= 0:
            inside[parent[i]] = held + inside[parent[i]]
        elif status[i] == "kept":
            inside[i] = inside[i]
    up, out = {}, []
    for i in range(n):
        p = parent[i]
        while p >= 0 and status[p] == "collapsed":
            p = parent[p]
        up[i] = p if p >= 0 and status[p] == "kept" else -1
    number = {i: k for k, i in enumerate(i for i in range(n) if status[i] == "kept")}
    places: dict[int, int] = {}
    depth: dict[int, int] = {-1: -1}
    size = dict.fromkeys(number, 1)
    for i in reversed(list(number)):
        if up[i] >= 0:
            size[up[i]] += size[i]
    for i, r in enumerate(elements):
        row = {"doc_id": r["doc_id"], "node": r["node"], "tag": r["tag"], "text": text[i], "attributes": list(evidence[i].items()), "hidden": hidden[i], "status": status[i]}
        if i in number:
            depth[i] = depth[up[i]] + 1
            places[up[i]] = places.get(up[i], -1) + 1
            row |= {"parent": elements[up[i]]["node"] if up[i] >= 0 else None, "pre": number[i], "end": number[i] + size[i], "depth": depth[i], "sib": places[up[i]]}
        out.append(row)
    return out


def prepared(nodes: DataFrame) -> DataFrame:
    """Elements of each capture with status kept, hidden, inert or collapsed; kept ones form a tree with numbers of its own.

    Inert subtrees and hidden ones go, unless a relation names them; generic
    wrappers without text, evidence or branches give way to what they hold.
    """
    return per_document(nodes.select("doc_id", "node", "parent", "kind", "tag", "attributes", "text"), _prepared, CAPTURE)


def capture_stats(capture: DataFrame) -> DataFrame:
    """Per capture: elements kept, hidden, inert and collapsed, and hidden ones kept for a relation."""
    counts = {f"{s}_nodes": F.count_if(F.col("status") == s) for s in ("kept", "hidden", "inert", "collapsed")}
    return capture.groupBy("doc_id").agg(F.count("*").alias("original_nodes"), *(c.alias(k) for k, c in counts.items()), F.count_if((F.col("status") == "kept") & F.col("hidden")).alias("kept_hidden_nodes"))


def label_of() -> Column:
    """Text, aria-label, alt, title, name, tag: the first that is not empty."""
    a = F.col("attributes")
    return F.coalesce(*(F.when(c != "", c) for c in (F.col("text"), a["aria-label"], a["alt"], a["title"], a["name"])), F.col("tag"))


def _packed(rows: list[dict], size: int) -> list[tuple[int, int]]:
    """(place, region): subtrees that fit stay whole, others are split below their root; atoms are packed in order while they fit."""
    at = {r["pre"]: i for i, r in enumerate(rows)}
    children: dict[int, list[int]] = {}
    roots = []
    by_node = {r["node"]: i for i, r in enumerate(rows)}
    for i, r in enumerate(rows):
        if r["parent"] in by_node:
            children.setdefault(by_node[r["parent"]], []).append(i)
        else:
            roots.append(i)
    region = used = 0
    out, stack = [], roots[::-1]
    while stack:
        i = stack.pop()
        whole = rows[i]["end"] - rows[i]["pre"] <= size
        atom = [at[p] for p in range(rows[i]["pre"], rows[i]["end"])] if whole else [i]
        if not whole:
            stack += reversed(children.get(i, []))
        if used and used + len(atom) > size:
            region, used = region + 1, 0
        used += len(atom)
        out += [(j, region) for j in atom]
    return out


def regions(capture: DataFrame, size: int = 160) -> DataFrame:
    """(doc_id, node, region): each kept node in exactly one region of at most size nodes."""

    def run(rows: list[dict]) -> list[dict]:
        return [{"doc_id": rows[0]["doc_id"], "node": rows[i]["node"], "region": k} for i, k in _packed(rows, size)]

    return by_document(capture.where("status = 'kept'").select("doc_id", "node", "parent", "pre", "end"), run, "doc_id long, node int, region int")


def regions_needed(owned: DataFrame, most: int = MAX_REGIONS) -> DataFrame:
    """Per capture how many regions it takes, and whether that is beyond the limit; nothing is cut."""
    return owned.groupBy("doc_id").agg(F.countDistinct("region").alias("regions")).withColumn("exceeded", F.col("regions") > most)


def region_context(owned: DataFrame, capture: DataFrame, most: int = MAX_CONTEXT) -> DataFrame:
    """(doc_id, region, node, reason, omitted): relation ends, ancestors and neighbours outside a region, the nearest reasons first; at most so many, the rest counted."""
    kept = capture.where("status = 'kept'")
    here = kept.join(owned, ["doc_id", "node"])
    ids = kept.where(F.col("attributes")["id"] != "").groupBy("doc_id", F.col("attributes")["id"].alias("id")).agg(F.count("*").alias("n"), F.min("node").alias("target")).where("n = 1").drop("n")
    tokens = F.flatten(F.transform(F.array(*(F.coalesce(F.col("attributes")[a], F.lit("")) for a in RELATIONS)), lambda v: F.split(v, r"\s+")))
    forward = kept.select("doc_id", "node", F.explode(tokens).alias("id")).join(ids, ["doc_id", "id"]).select("doc_id", "node", "target")
    both = forward.unionByName(forward.select("doc_id", F.col("target").alias("node"), F.col("node").alias("target")))
    at = owned.select("doc_id", "node", "region")
    related = both.join(at, ["doc_id", "node"]).select("doc_id", "region", F.col("target").alias("node"), F.lit(0).alias("why"))
    above = _open_around(here, kept, False, True).join(at, ["doc_id", "node"]).select("doc_id", "region", F.col("around").alias("node"), F.lit(1).alias("why"))
    w = Window.partitionBy("doc_id", "parent").orderBy("sib")
    beside = here.withColumns({"_b": F.lag("node").over(w), "_a": F.lead("node").over(w)}).withColumn("near", F.explode(F.array("_b", "_a"))).where("near is not null and parent is not null")
    beside = beside.select("doc_id", "region", F.col("near").alias("node"), F.lit(2).alias("why"))
    found = related.unionByName(above).unionByName(beside).groupBy("doc_id", "region", "node").agg(F.min("why").alias("why")).join(at, ["doc_id", "region", "node"], "left_anti")
    found = found.join(kept.select("doc_id", "node", "pre"), ["doc_id", "node"])
    order = Window.partitionBy("doc_id", "region").orderBy("why", "pre")
    n = F.count("*").over(Window.partitionBy("doc_id", "region"))
    reason = F.element_at(F.array(F.lit("relation"), F.lit("ancestor"), F.lit("neighbour")), F.col("why") + 1)
    return found.withColumns({"rn": F.row_number().over(order), "omitted": F.greatest(F.lit(0).cast("long"), n - most), "reason": reason}).where(F.col("rn") <= most).select("doc_id", "region", "node", "reason", "omitted")


def page_outline(capture: DataFrame, most: int = MAX_OUTLINE) -> DataFrame:
    """(doc_id, node, label, truncated, omitted): landmarks, headings and roots in order, at most so many, the rest counted."""
    found = capture.where("status = 'kept'").where(F.col("parent").isNull() | F.col("tag").isin(OUTLINE_TAGS) | F.coalesce(F.col("attributes")["role"].isin(OUTLINE_ROLES), F.lit(False)))
    rn = F.row_number().over(Window.partitionBy("doc_id").orderBy("pre"))
    n = F.count("*").over(Window.partitionBy("doc_id"))
    label = label_of()
    return found.withColumns({"rn": rn, "omitted": F.greatest(F.lit(0).cast("long"), n - most)}).where(F.col("rn") <= most).select("doc_id", "node", F.substring(label, 1, 160).alias("label"), (F.length(label) > 160).alias("truncated"), "omitted")


def compact_regions(capture: DataFrame, size: int = 160, most: int = 64) -> DataFrame:
    """(doc_id, node, region, role): owned nodes and context of regions of about a third of a capture, between 12 and size nodes.

    Context is the ancestors, and headings beside the way to them while they fit
    into the limit; a region whose ancestors alone exceed it has the role error on its rows.
    """

    def run(rows: list[dict]) -> list[dict]:
        target = min(size, max(12, -(-len(rows) // 3)))
        by_node = {r["node"]: i for i, r in enumerate(rows)}
        up = [by_node.get(r["parent"], -1) for r in rows]
        children: list[list[int]] = [[] for _ in rows]
        for i, p in enumerate(up):
            if p >= 0:
                children[p].append(i)
        parts: dict[int, list[int]] = {}
        for i, k in _packed(rows, target):
            parts.setdefault(k, []).append(i)
        out = []
        for k, owned in parts.items():
            mine, chosen = set(owned), set(owned)
            for i in owned:
                while (i := up[i]) >= 0 and i not in chosen:
                    chosen.add(i)
            error = len(chosen - mine) > most
            for i in sorted(chosen):
                for c in children[i]:
                    if rows[c]["tag"] in TITLES[:6] and c not in chosen:
                        heading = set(range(c, c + rows[c]["end"] - rows[c]["pre"]))
                        if len((chosen | heading) - mine) <= most:
                            chosen |= heading
            out += [{"doc_id": rows[0]["doc_id"], "node": rows[i]["node"], "region": k, "role": "owned" if i in mine else "error" if error else "context"} for i in sorted(chosen)]
        return out

    return by_document(capture.where("status = 'kept'").select("doc_id", "node", "parent", "pre", "end", "tag"), run, "doc_id long, node int, region int, role string")


def marker_name(taken: Column, wanted: str) -> Column:
    """An attribute name that is not among those taken: the wanted one, or with the first free number behind it."""
    names = F.concat(F.array(F.lit(wanted)), F.transform(F.sequence(F.lit(2), F.size(taken) + 2), lambda k: F.concat(F.lit(wanted + "-"), k.cast("string"))))
    return F.get(F.filter(names, lambda x: ~F.array_contains(taken, x)), F.lit(0))


def regional_html(parts: DataFrame, capture: DataFrame) -> DataFrame:
    """(doc_id, region, html): the nodes of each region as markup; context is marked read-only, cut nodes are marked partial, and only owned nodes and headings keep text."""
    j = parts.join(capture.where("status = 'kept'").select("doc_id", "node", "parent", "pre", "end", "tag", "text", "attributes"), ["doc_id", "node"])
    children = capture.where("status = 'kept' and parent is not null").groupBy("doc_id", F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    j = j.join(children, ["doc_id", "node"], "left").withColumn("key", F.struct("doc_id", "region"))

    def quoted(value: str) -> str:
        return value.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")

    def run(rows: list[dict]) -> list[dict]:
        taken = {k for r in rows for k, _ in r["attributes"] or []}
        names = []
        for wanted in ("data-context", "data-slice"):
            name, k = wanted, 2
            while name in taken:
                name, k = f"{wanted}-{k}", k + 1
            names.append(name)
        shown: dict[int, int] = {}
        for r in rows:
            shown[r["parent"]] = shown.get(r["parent"], 0) + 1
        out: list[str] = []
        open_: list[tuple[int, str, bool]] = []
        for r in rows:
            while open_ and open_[-1][0] <= r["pre"]:
                out.append(f"</{open_.pop()[1]}>")
            titled = r["tag"] in TITLES[:6] or bool(open_ and open_[-1][2])
            attributes = dict(r["attributes"] or [])
            if r["role"] != "owned":
                attributes[names[0]] = "read-only"
            keep = r["role"] == "owned" or titled
            if shown.get(r["node"], 0) < (r["n_children"] or 0) or (r["text"] and not keep):
                attributes[names[1]] = "partial"
            out.append(f"<{r['tag']}" + "".join(f' {k}="{quoted(v)}"' for k, v in attributes.items()) + ">" + (quoted(r["text"]) if keep else ""))
            open_.append((r["end"], r["tag"], titled))
        out += [f"</{tag}>" for _, tag, _ in reversed(open_)]
        return [{"doc_id": rows[0]["doc_id"], "region": rows[0]["region"], "html": "".join(out)}]

    dealt = j.withColumn("of", F.concat_ws(":", "doc_id", "region")).drop("key")
    return by_document(dealt, run, "doc_id long, region int, html string", key="of")


def group_findings(groups: DataFrame, allowed: DataFrame, budget: int = MODEL_GROUPS) -> DataFrame:
    """(doc_id, id, finding) for groups (doc_id, id, label, parent, source_ids) and sources allowed (doc_id, node); no row means that a proposal is valid.

    Findings: too many groups, bad or repeated ids, bad labels, unknown parents,
    cycles, unknown sources, sources given twice, and groups with no source below them.
    """
    own = groups.withColumn("times", F.count("*").over(Window.partitionBy("doc_id", "id")))
    total = groups.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > budget).select("doc_id", F.lit(None).cast("string").alias("id"), F.lit("too many groups").alias("finding"))
    checks = {
        "invalid group id": F.col("id").isNull() | (F.trim("id") == "") | (F.length("id") > MAX_ID), "repeated group id": F.col("times") > 1,
        "label is blank or over 100": F.col("label").isNull() | (F.trim("label") == "") | (F.length("label") > MAX_LABEL),
    }
    out = own.select("doc_id", "id", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(m)) for m, c in checks.items())))).alias("finding")).distinct().unionByName(total)
    ids = groups.select("doc_id", F.col("id").alias("parent")).distinct()
    out = out.unionByName(groups.where("parent is not null").join(ids, ["doc_id", "parent"], "left_anti").select("doc_id", "id", F.lit("unknown parent").alias("finding")))
    given = groups.select("doc_id", "id", F.explode("source_ids").alias("node"))
    out = out.unionByName(given.join(allowed.select("doc_id", F.col("node").cast("string").alias("node")), ["doc_id", "node"], "left_anti").select("doc_id", "id", F.concat(F.lit("unknown source "), F.col("node")).alias("finding")))
    twice = given.groupBy("doc_id", "node").agg(F.count("*").alias("n"), F.max("id").alias("id")).where("n > 1")
    out = out.unionByName(twice.select("doc_id", "id", F.concat(F.lit("repeated source "), F.col("node")).alias("finding")))

    def trees(rows: list[dict]) -> list[dict]:
        parent = {r["id"]: r["parent"] for r in rows}
        live = {r["id"] for r in rows if r["n_sources"]}
        found = []
        for start in list(parent):
            seen, at = set(), start
            while at in parent and at not in seen:
                seen.add(at)
                at = parent[at]
            if at in seen and at == start:
                found.append((start, "cycle"))
            if start in live:
                live |= seen
        found += [(i, "no source below") for i in parent if i not in live]
        return [{"doc_id": rows[0]["doc_id"], "id": i, "finding": f} for i, f in found]

    shape = groups.select("doc_id", "id", "parent", F.size("source_ids").alias("n_sources"))
    return out.unionByName(by_document(shape, trees, "doc_id long, id string, finding string", order="id"))


def composition_findings(upper: DataFrame, parents: DataFrame, local: DataFrame, budget: int = COMPOSED_GROUPS) -> DataFrame:
    """(doc_id, id, finding) for upper groups (doc_id, id, label, parent) and parents (doc_id, id, parent) of local roots: each root once, below upper groups only, local trees untouched."""
    roots = local.where("parent is null").select("doc_id", "id")
    names = upper.select("doc_id", F.col("id").alias("parent"))
    finding = lambda df, text: df.select("doc_id", "id", F.lit(text).alias("finding"))
    known = local.select("doc_id", "id").unionByName(upper.select("doc_id", "id"))
    out = finding(known.groupBy("doc_id", "id").count().where("count > 1"), "repeated group id")
    out = out.unionByName(finding(upper.where(f"trim(id) = '' or length(id) > {MAX_ID} or trim(label) = '' or length(label) > {MAX_LABEL}"), "invalid group"))
    out = out.unionByName(finding(upper.groupBy("doc_id").agg(F.count("*").alias("n"), F.lit(None).cast("string").alias("id")).where(F.col("n") > budget), "too many groups"))
    out = out.unionByName(finding(roots.join(parents, ["doc_id", "id"], "left_anti"), "root without parent"))
    out = out.unionByName(finding(parents.join(roots, ["doc_id", "id"], "left_anti"), "no local root"))
    out = out.unionByName(finding(parents.groupBy("doc_id", "id").count().where("count > 1"), "root given twice"))
    out = out.unionByName(finding(parents.where("parent is not null").join(names, ["doc_id", "parent"], "left_anti"), "parent is no upper group"))
    out = out.unionByName(finding(upper.where("parent is not null").join(names, ["doc_id", "parent"], "left_anti"), "parent is no upper group"))

    def empty(rows: list[dict]) -> list[dict]:
        up = {r["id"]: r["parent"] for r in rows if r["upper"]}
        held = {r["parent"] for r in rows if not r["upper"]}
        found = []
        for i in up:
            seen, at = set(), i
            while at in up and at not in seen:
                seen.add(at)
                at = up[at]
            if at == i:
                found.append((i, "cycle"))
        for i in list(held):
            while i in up and up[i] not in held:
                i = up[i]
                held.add(i)
        found += [(i, "upper group without a local one") for i in up if i not in held]
        return [{"doc_id": rows[0]["doc_id"], "id": i, "finding": f} for i, f in found]

    both = upper.select("doc_id", "id", "parent", F.lit(True).alias("upper")).unionByName(parents.select("doc_id", "id", "parent", F.lit(False).alias("upper")))
    return out.unionByName(by_document(both, empty, "doc_id long, id string, finding string", order="id"))


def composed(upper: DataFrame, parents: DataFrame, local: DataFrame) -> DataFrame:
    """Groups (doc_id, id, label, parent, source_ids): local trees as they are, their roots below the upper groups."""
    up = parents.select("doc_id", "id", F.col("parent").alias("_up"))
    below = local.join(up, ["doc_id", "id"], "left").withColumn("parent", F.coalesce("parent", "_up")).select("doc_id", "id", "label", "parent", "source_ids")
    return below.unionByName(upper.select("doc_id", "id", "label", "parent", F.array().cast("array<string>").alias("source_ids")))


VARIANT = "doc_id long, id string, kind string, label string, parent string, place int, source_refs array<string>, origin string"


def variant(groups: DataFrame, sources: DataFrame, strategy: str = "standard") -> DataFrame:
    """One hierarchy per capture of checked groups and all sources (doc_id, node, label, pre): root, groups, a fallback for what no group has, and a leaf for each source.

    Siblings stand by the first source below them, the fallback last; whatever
    order groups came in, the tree is the same.
    """
    own = groups.select("doc_id", F.lit("group").alias("kind"), "id", "label", "parent", "source_ids", F.lit(None).cast("long").alias("pre"))
    leaves = sources.select("doc_id", F.lit("dom").alias("kind"), F.col("node").cast("string").alias("id"), "label", F.lit(None).cast("string").alias("parent"), F.array().cast("array<string>").alias("source_ids"), F.col("pre").cast("long").alias("pre"))

    def run(rows: list[dict]) -> list[dict]:
        doc = rows[0]["doc_id"]
        place = {r["id"]: r["pre"] for r in rows if r["kind"] == "dom"}
        label = {r["id"]: r["label"] for r in rows if r["kind"] == "dom"}
        given = [r for r in rows if r["kind"] == "group"]
        owner = {s: r["id"] for r in given for s in r["source_ids"] if s in place}
        up = {r["id"]: r["parent"] for r in given}
        first = dict.fromkeys(up, len(place))
        for s, g in owner.items():
            while g is not None and place[s] < first.get(g, -1):
                first[g], g = place[s], up.get(g)
        loose = sorted((s for s in place if s not in owner), key=place.get)
        children: dict[str, list[tuple[int, int, str]]] = {}
        for r in given:
            children.setdefault(f"group:{r['parent']}" if r["parent"] is not None else "root", []).append((first[r["id"]], 0, f"group:{r['id']}"))
        for s, g in owner.items():
            children.setdefault(f"group:{g}", []).append((place[s], 1, f"source:{s}"))
        if loose:
            children.setdefault("root", []).append((len(place) + 1, 2, "fallback"))
            children["fallback"] = [(place[s], 1, f"source:{s}") for s in loose]
        at = {c: (p, k) for p, own in children.items() for k, (_, _, c) in enumerate(sorted(own))}
        out = [("root", "group", "Generated reading hierarchy", [], "assembly")]
        out += [(f"group:{r['id']}", "group", r["label"], list(r["source_ids"]), f"model-{strategy}") for r in given]
        out += [("fallback", "group", "Ungrouped original source", loose, "source-fallback")] if loose else []
        out += [(f"source:{s}", "dom", label[s], [s], "observed-source") for s in place]
        return [
            {"doc_id": doc, "id": i, "kind": k, "label": t, "parent": at.get(i, (None, 0))[0], "place": at.get(i, (None, 0))[1], "source_refs": refs, "origin": o} for i, k, t, refs, o in out
        ]

    return by_document(own.unionByName(leaves), run, VARIANT, order="id")


def annotation_coverage(hierarchy: DataFrame) -> DataFrame:
    """Per capture: sources, those that a group has, and their share; the fallback counts for nothing."""
    leaves = hierarchy.where("kind = 'dom'")
    return leaves.groupBy("doc_id").agg(F.count("*").alias("retained"), F.count_if(F.col("parent") != "fallback").alias("assigned")).withColumn("coverage", F.expr("try_divide(assigned, retained)"))


def contained(groups: DataFrame, origins: DataFrame, nodes: DataFrame) -> DataFrame:
    """groups with local roots put below the owner of the nearest node that holds all their sources, if it is of another region (origins: doc_id, id, region) and makes no cycle."""
    tree = nodes.select("doc_id", F.lit(None).cast("string").alias("id"), F.col("node").cast("string").alias("node"), F.col("parent").cast("string").alias("up"), F.array().cast("array<string>").alias("refs"), F.lit(None).cast("string").alias("region"), F.lit(None).cast("string").alias("label"))
    own = groups.join(origins, ["doc_id", "id"], "left").select("doc_id", "id", F.lit(None).cast("string").alias("node"), F.col("parent").alias("up"), F.col("source_ids").alias("refs"), F.col("region").cast("string").alias("region"), "label")

    def run(rows: list[dict]) -> list[dict]:
        above = {r["node"]: r["up"] for r in rows if r["node"] is not None}
        mine = {r["id"]: r for r in rows if r["id"] is not None}
        parent = {i: r["up"] for i, r in mine.items()}
        owner = {s: i for i, r in mine.items() for s in r["refs"]}
        below: dict[str, list[str]] = {i: [] for i in mine}
        for i, r in mine.items():
            at, seen = i, set()
            while at in below and at not in seen:
                seen.add(at)
                below[at] += r["refs"]
                at = parent[at]

        def chain(node: str) -> list[str]:
            out = []
            while (node := above.get(node)) is not None:
                out.append(node)
            return out

        for i in [i for i, p in parent.items() if p is None and below[i]]:
            chains = [chain(s) for s in below[i]]
            shared = set(chains[0]).intersection(*chains[1:])
            found = next((owner[n] for n in chains[0] if n in shared and n in owner and mine[owner[n]]["region"] != mine[i]["region"]), None)
            at = found
            while at is not None and at != i:
                at = parent[at]
            if found is not None and at is None:
                parent[i] = found
        return [{"doc_id": r["doc_id"], "id": i, "label": r["label"], "parent": parent[i], "source_ids": r["refs"], "linked": parent[i] != r["up"]} for i, r in mine.items()]

    return by_document(tree.unionByName(own), run, "doc_id long, id string, label string, parent string, source_ids array<string>, linked boolean", order="node")


def decode_ranges(spans: DataFrame, aliases: DataFrame) -> DataFrame:
    """(doc_id, id, refs, finding): groups from inclusive ranges (doc_id, id, first, last) over numbered sources (doc_id, n, node, owned), which may not reach into read-only context."""
    bad = F.col("first").isNull() | (F.col("first") < 1) | (F.col("first") > F.col("last"))
    numbers = spans.where(~bad).select("doc_id", "id", F.explode(F.sequence("first", "last")).alias("n")).join(aliases, ["doc_id", "n"], "left")
    refs = F.transform(F.sort_array(F.collect_list(F.struct("n", F.col("node").cast("string").alias("node")))), lambda x: x["node"])
    finding = F.when(F.bool_or(F.col("node").isNull()), "invalid range").when(F.bool_or(~F.col("owned")), "range crosses read-only context")
    good = numbers.groupBy("doc_id", "id").agg(refs.alias("refs"), finding.alias("finding"))
    wrong = spans.where(bad).select("doc_id", "id").distinct().withColumn("_bad", F.lit(True))
    both = good.join(wrong, ["doc_id", "id"], "full_outer")
    return both.select("doc_id", "id", F.when(F.col("finding").isNull() & F.col("_bad").isNull(), F.col("refs")).alias("refs"), F.when(F.col("_bad"), "invalid range").otherwise(F.col("finding")).alias("finding"))


def decode_anchors(anchors: DataFrame, nodes: DataFrame, owned: DataFrame, labels: DataFrame) -> DataFrame:
    """Groups of chosen roots (doc_id, root, title): every owned node (doc_id, node) goes to the nearest chosen root around it, itself included.

    finding tells roots that are not owned or given twice, titles without a label
    (labels: doc_id, node, label of 1 to 100 characters), and titles that are
    neither inside their root nor read-only context; those make no group.
    """
    tree = nodes.select("doc_id", "node", "pre", "end", "depth")
    mine = owned.select("doc_id", "node").withColumn("owned", F.lit(True))
    a = anchors.withColumn("times", F.count("*").over(Window.partitionBy("doc_id", "root")))
    a = a.join(mine.withColumnRenamed("node", "root"), ["doc_id", "root"], "left").join(labels.select("doc_id", F.col("node").alias("title"), "label"), ["doc_id", "title"], "left")
    a = a.join(tree.select("doc_id", F.col("node").alias("root"), "pre", "end", "depth"), ["doc_id", "root"], "left")
    a = a.join(tree.select("doc_id", F.col("node").alias("title"), F.col("pre").alias("title_pre")), ["doc_id", "title"], "left")
    a = a.join(mine.select("doc_id", F.col("node").alias("title"), F.col("owned").alias("title_owned")), ["doc_id", "title"], "left")
    finding = (
        F.when(F.col("owned").isNull() | (F.col("times") > 1), "root is not owned or given twice").when(F.col("label").isNull() | (F.length("label") > MAX_LABEL) | (F.length("label") == 0), "title without label")
        .when(~((F.col("title_pre") >= F.col("pre")) & (F.col("title_pre") < F.col("end"))) & F.col("title_owned").isNotNull(), "title outside its root")
    )
    a = a.withColumn("finding", finding)
    good = a.where("finding is null").select("doc_id", F.col("root").alias("node"), "pre", "end", "depth", "label")
    place = F.concat(F.lit("g"), F.row_number().over(Window.partitionBy("doc_id").orderBy("pre")).cast("string"))
    good = good.withColumn("id", place)
    parent = nearest_flagged(good, good).join(good.select("doc_id", F.col("node").alias("nearest"), F.col("id").alias("parent")), ["doc_id", "nearest"], "left").select("doc_id", "node", "parent")
    members = nearest_flagged(tree.join(mine, ["doc_id", "node"], "left_semi"), good, self_too=True).where("nearest is not null").join(tree.select("doc_id", "node", "pre"), ["doc_id", "node"])
    listed = F.transform(F.sort_array(F.collect_list(F.struct("pre", F.col("node").cast("string").alias("n")))), lambda x: x["n"])
    members = members.groupBy("doc_id", F.col("nearest").alias("node")).agg(listed.alias("source_ids"))
    groups = good.join(parent, ["doc_id", "node"]).join(members, ["doc_id", "node"], "left").select("doc_id", F.col("node").alias("root"), "id", "label", "parent", F.coalesce("source_ids", F.array().cast("array<string>")).alias("source_ids"))
    return a.select("doc_id", "root", "finding").distinct().join(groups, ["doc_id", "root"], "left")


def proposals(nodes: DataFrame, owned: DataFrame, labels: DataFrame, most: int = OFFERED) -> DataFrame:
    """(doc_id, id, root, title, label, omitted): containers that a heading or their own aria-label names.

    A title goes to the nearest eligible container around it; a container's own
    label wins, else its first heading. Real containers come before blocks, then
    document order; at most so many are offered, the rest counted.
    """
    n = nodes.join(owned.select("doc_id", "node").withColumn("owned", F.lit(True)), ["doc_id", "node"], "left")
    children = nodes.where("parent is not null").groupBy("doc_id", F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    n = n.join(children, ["doc_id", "node"], "left")
    eligible = F.coalesce("owned", F.lit(False)) & (F.col("tag").isin(CONTAINERS) | ((F.col("tag") == "div") & (F.col("n_children") >= 2)))
    n = n.withColumn("eligible", F.coalesce(eligible, F.lit(False)))
    named = n.join(labels.select("doc_id", "node", "label"), ["doc_id", "node"])
    explicit = F.coalesce(F.col("attributes")["aria-label"] != "", F.lit(False)) & F.col("eligible")
    titles = named.withColumn("explicit", explicit).where(F.col("tag").isin(TITLES) | F.coalesce(F.col("attributes")["role"] == "heading", F.lit(False)) | F.col("explicit"))
    around = nearest_flagged(titles, n.where("eligible")).select("doc_id", "node", F.col("nearest").alias("root"))
    t = titles.join(around, ["doc_id", "node"]).withColumn("root", F.when(F.col("explicit"), F.col("node")).otherwise(F.col("root"))).where("root is not null")
    best = t.groupBy("doc_id", "root").agg(F.min(F.struct((~F.col("explicit")).alias("o"), "pre", F.col("node").alias("title"), "label")).alias("b")).select("doc_id", "root", "b.title", "b.label")
    best = best.join(n.select("doc_id", F.col("node").alias("root"), (~F.col("tag").isin(CONTAINERS)).alias("block"), "pre"), ["doc_id", "root"])
    rn = F.row_number().over(Window.partitionBy("doc_id").orderBy("block", "pre"))
    total = F.count("*").over(Window.partitionBy("doc_id"))
    return best.withColumns({"rn": rn, "omitted": F.greatest(F.lit(0).cast("long"), total - most)}).where(F.col("rn") <= most).select("doc_id", F.concat(F.lit("c"), F.col("rn").cast("string")).alias("id"), "root", "title", "label", "omitted")


def decode_selection(kept: DataFrame, offered: DataFrame, nodes: DataFrame, owned: DataFrame) -> DataFrame:
    """decode_anchors() of the offered proposals that were kept (doc_id, id); ids that were not offered, or kept twice, are findings."""
    k = kept.groupBy("doc_id", "id").agg(F.count("*").alias("times")).join(offered, ["doc_id", "id"], "left")
    bad = k.where("root is null or times > 1").select("doc_id", F.col("root"), F.lit("not offered or kept twice").alias("finding"))
    good = k.where("root is not null and times = 1")
    found = decode_anchors(good.select("doc_id", "root", "title"), nodes, owned, good.select("doc_id", F.col("title").alias("node"), "label").distinct())
    return found.unionByName(bad, allowMissingColumns=True)


def source_refs(hierarchy: DataFrame, below: bool = True) -> DataFrame:
    """(doc_id, id, ref): sources of each node of a hierarchy (doc_id, id, parent, source_refs), with those of all below it if asked, each once."""
    own = hierarchy.select("doc_id", "id", "parent", "source_refs")
    if not below:
        return own.select("doc_id", "id", F.explode("source_refs").alias("ref")).distinct()

    def run(rows: list[dict]) -> list[dict]:
        up = {r["id"]: r["parent"] for r in rows}
        seen: dict[str, dict[str, None]] = {}
        for r in rows:
            at, way = r["id"], set()
            while at is not None and at not in way:
                way.add(at)
                seen.setdefault(at, {}).update(dict.fromkeys(r["source_refs"]))
                at = up.get(at)
        return [{"doc_id": rows[0]["doc_id"], "id": i, "ref": s} for i, refs in seen.items() for s in refs]

    return by_document(own, run, "doc_id long, id string, ref string", order="id")


def pooled(costs: DataFrame, revised: Column) -> DataFrame:
    """One row over revised hierarchies' targets (linear, quick, steps): how many, coverage, pooled medians, and how often the hierarchy takes fewer, equal or more moves."""
    t = costs.where(revised)
    return t.agg(
        F.countDistinct("doc_id").alias("captures"), F.count("*").alias("eligible"), F.count("steps").alias("mapped"), F.expr("try_divide(count(steps) * 100.0, count(*))").alias("coverage"),
        F.median(F.when(F.col("steps").isNotNull(), F.col("linear"))).alias("median_linear"), F.median(F.when(F.col("steps").isNotNull(), F.col("quick"))).alias("median_quick"), F.median("steps").alias("median_steps"),
        F.count_if(F.col("steps") < F.col("quick")).alias("fewer"), F.count_if(F.col("steps") == F.col("quick")).alias("equal"), F.count_if(F.col("steps") > F.col("quick")).alias("more"),
    )


def variant_rows(hierarchy: DataFrame, costs: DataFrame, by: str = "variant") -> DataFrame:
    """Per capture and variant: nodes, deepest level, coverage, median and 90th percentile of steps."""
    size = hierarchy.groupBy("doc_id", by).agg(F.count("*").alias("nodes"), F.max("depth").alias("max_depth"))
    own = costs.groupBy("doc_id", by).agg(
        F.expr("try_divide(count(steps) * 100.0, count(*))").alias("coverage"), F.median("steps").alias("median"), F.expr("percentile_disc(0.9) within group (order by steps)").alias("p90")
    )
    return size.join(own, ["doc_id", by], "left")


def selection_steps(selected: DataFrame, nodes: DataFrame, costs: DataFrame) -> DataFrame:
    """(doc_id, root, targets, median): steps to the targets inside each selected node."""
    inside = _open_around(costs.join(nodes.select("doc_id", "node", "pre", "end", "depth"), ["doc_id", "node"]).select("doc_id", "node", "pre", "end", "depth"), selected, True, True)
    return inside.join(costs.select("doc_id", "node", "steps"), ["doc_id", "node"]).groupBy("doc_id", F.col("around").alias("root")).agg(F.count("*").alias("targets"), F.median("steps").alias("median"))

"""The observation of a page: roles, names, states, actions, exposure and relations of its nodes.

Null means unknown throughout; a state that a page does not give is not false.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.operators.tree import descendants
from treeline.sources.html import with_context


#: Roles of tags without conditions; other tags are generic.
TAG_ROLES = {
    "#document": "document", "p": "paragraph", "a": "link", "button": "button", "textarea": "textField", "select": "comboBox", "option": "option", "optgroup": "group", "fieldset": "group", "form": "form",
    "ul": "list", "ol": "list", "li": "listItem", "table": "table", "tr": "row", "td": "cell", "th": "columnHeader", "dl": "definitionList", "dt": "term", "dd": "definition", "img": "image",
    "svg": "image", "figure": "figure", "figcaption": "caption", "caption": "caption", "pre": "code", "code": "code", "math": "math", "dialog": "dialog", "nav": "navigation", "main": "main",
    "aside": "complementary", "hr": "separator", "br": "lineBreak", "iframe": "frame", "progress": "progress", "meter": "progress", "details": "group", "summary": "button", "datalist": "listBox",
    "search": "search", "area": "link",
}
#: Roles of input elements by type; others are text fields.
INPUT_ROLES = {
    "checkbox": "checkbox", "radio": "radio", "range": "slider", "number": "spinButton", "button": "button", "submit": "button", "reset": "button", "image": "button", "hidden": "generic",
}
#: Role tokens of authors that are recognised, by their names here.
AUTHOR_ROLES = {
    "button": "button", "checkbox": "checkbox", "radio": "radio", "switch": "switch", "textbox": "textField", "combobox": "comboBox", "listbox": "listBox", "option": "option", "group": "group",
    "form": "form", "list": "list", "listitem": "listItem", "table": "table", "row": "row", "cell": "cell", "rowheader": "rowHeader", "columnheader": "columnHeader", "img": "image", "figure": "figure",
    "heading": "heading", "dialog": "dialog", "alertdialog": "dialog", "alert": "alert", "status": "status", "navigation": "navigation", "main": "main", "banner": "banner",
    "contentinfo": "contentInfo", "complementary": "complementary", "search": "search", "region": "group", "tab": "tab", "tablist": "tabList", "tabpanel": "tabPanel", "separator": "separator",
    "slider": "slider", "spinbutton": "spinButton", "progressbar": "progress", "tree": "tree", "treeitem": "treeItem", "grid": "grid", "gridcell": "gridCell", "menu": "menu", "menuitem": "menuItem",
    "none": "generic", "presentation": "generic",
}
#: Roles that bound a part of the page.
BOUNDARIES = [
    "form", "group", "list", "listItem", "table", "row", "cell", "rowHeader", "columnHeader", "definitionList", "term", "definition", "figure", "caption", "navigation", "main", "dialog",
]
#: Recognised role tokens that make a field, and those that make no target.
FIELD_ROLES = ["checkbox", "combobox", "listbox", "radio", "searchbox", "slider", "spinbutton", "switch", "textbox"]
OTHER_ROLES = [
    "none", "presentation", "article", "banner", "cell", "columnheader", "complementary", "contentinfo", "definition", "dialog", "document", "feed", "figure", "form", "grid", "gridcell", "group", "img",
    "list", "listitem", "log", "main", "marquee", "math", "menu", "menubar", "menuitem", "menuitemcheckbox", "menuitemradio", "navigation", "note", "option", "progressbar", "region", "row", "rowgroup",
    "rowheader", "scrollbar", "search", "separator", "status", "tab", "table", "tablist", "tabpanel", "term", "timer", "toolbar", "tooltip", "tree", "treegrid", "treeitem", "alert", "alertdialog",
]
#: Elements that no user meets.
INERT = ["script", "style", "noscript", "template"]
FIELDS = ["input", "select", "textarea"]
#: Elements that native states apply to, that labels name, and that belong to forms.
STATEFUL = ["input", "select", "textarea", "button", "option", "optgroup", "fieldset"]
LABELABLE = ["input", "select", "textarea", "button", "meter", "progress", "output"]
FORM_PARTS = ["input", "select", "textarea", "button", "fieldset", "object", "output"]
#: Attributes that refer to ids, and the relations that they make.
REFERENCES = {
    "aria-labelledby": "labelledBy", "aria-describedby": "describedBy", "aria-errormessage": "errorMessage", "aria-details": "details", "aria-controls": "controls", "aria-owns": "owns",
    "aria-activedescendant": "activeDescendant", "headers": "headers", "list": "choices",
}
#: Whole numbers that attributes give, with the least that counts.
NUMBERS = {
    "aria-level": ("level", 1), "aria-posinset": ("positionInSet", 1), "aria-setsize": ("setSize", 0), "aria-rowindex": ("rowIndex", 1), "aria-colindex": ("columnIndex", 1),
    "aria-rowcount": ("rowCount", 0), "aria-colcount": ("columnCount", 0), "rowspan": ("rowSpan", 1), "colspan": ("columnSpan", 1),
}
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def attr(name: str) -> Column:
    return F.col("attributes")[name]


def has(name: str) -> Column:
    return attr(name).isNotNull()


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[key]


def _input_type() -> Column:
    return F.lower(F.coalesce(attr("type"), F.lit("text")))


def _tokens(value: Column) -> Column:
    return F.filter(F.split(F.coalesce(value, F.lit("")), r"\s+"), lambda t: t != "")


def author_role() -> Column:
    """The first role token that is recognised."""
    return F.get(F.filter(_tokens(attr("role")), lambda t: t.isin(list(AUTHOR_ROLES))), F.lit(0))


def native_role() -> Column:
    """Role that tag, attributes and place give; a header or footer is a landmark outside sectioning elements only."""
    tag = F.col("tag")
    landmark = ~F.col("context.sectioned")
    return (
        F.when(F.col("kind") == "text", "text").when(tag.rlike("^h[1-6]$"), "heading").when(tag.isin("a", "area") & ~has("href"), "generic")
        .when(tag == "select", F.when(has("multiple") | F.coalesce(F.expr("try_cast(attributes['size'] as double)") > 1, F.lit(False)), "listBox").otherwise("comboBox"))
        .when(tag == "input", F.coalesce(_lookup(INPUT_ROLES, _input_type()), F.lit("textField")))
        .when((tag == "header") & landmark, "banner").when((tag == "footer") & landmark, "contentInfo")
        .when((tag == "th") & F.coalesce(attr("scope").isin("row", "rowgroup"), F.lit(False)), "rowHeader")
        .otherwise(F.coalesce(_lookup(TAG_ROLES, tag), F.lit("generic")))
    )


def role() -> Column:
    """The author's role if one is recognised, else the native one."""
    return F.coalesce(F.when(F.col("kind") == "element", _lookup(AUTHOR_ROLES, author_role())), native_role())


def role_diagnostic() -> Column:
    """What to tell about an author's role: that none of it is recognised, or that it overrides a native one; null otherwise."""
    mapped = _lookup(AUTHOR_ROLES, author_role())
    return F.when(attr("role") != "", F.when(mapped.isNull(), "unsupported-role").when((native_role() != "generic") & (mapped != native_role()), "explicit-role-overrides-native"))


def _named(text: Column, basis: str) -> Column:
    return F.when(text.isNotNull(), F.struct(text.alias("text"), F.lit(basis).alias("basis")))


def name() -> Column:
    """Name that attributes give, with its source: aria-label, an option's label, the value of a datalist's option, alt text."""
    tag = F.col("tag")
    return F.coalesce(
        _named(attr("aria-label"), "aria-label"), _named(F.when(tag.isin("option", "optgroup"), attr("label")), "label"),
        _named(F.when((tag == "option") & (F.col("context.parentTag") == "datalist"), attr("value")), "value"),
        _named(F.when((tag == "img") | ((tag == "input") & (_input_type() == "image")), attr("alt")), "alt"),
    )


def description() -> Column:
    return _named(attr("aria-description"), "aria-description")


def hints() -> Column:
    """What may name a control where nothing does, with its basis: title, placeholder, a button's value."""
    button = (F.col("tag") == "input") & _input_type().isin("button", "submit", "reset")
    return F.array_compact(F.array(_named(attr("title"), "title"), _named(attr("placeholder"), "placeholder"), _named(F.when(button, attr("value")), "source-label")))


def default_states() -> Column:
    """States that the source starts with: evidence, not the current state."""
    return F.struct(*(F.when(has(a), F.lit(True)).alias(k) for a, k in (("checked", "checked"), ("selected", "selected"), ("open", "expanded"))))


def structure() -> Column:
    """Boundary, text mode, content kind, numbers of place and size (null unless whole and large enough), scope and opacity."""
    tag, of = F.col("tag"), role()
    verbatim = F.col("context.verbatim")

    def number(a: str, least: int) -> Column:
        n = F.expr(f"try_cast(attributes['{a}'] as double)")
        return F.when(attr(a).rlike(_NUMBER) & (n == F.floor(n)) & (n >= least) & (n <= 2**53 - 1), n.cast("long"))

    numbers = {key: number(a, least) for a, (key, least) in NUMBERS.items()}
    numbers["level"] = F.coalesce(numbers["level"], F.when(tag.rlike("^h[1-6]$"), F.substring(tag, 2, 1).cast("long")))
    return F.struct(
        F.when(of.isin(BOUNDARIES), "semantic").when((of == "generic") & F.col("context.branching"), "branching").alias("boundary"),
        F.when(verbatim, "verbatim").otherwise("normal").alias("textMode"), F.when(of == "paragraph", "prose").when(verbatim, F.col("context.contentKind")).alias("contentKind"),
        *(c.alias(k) for k, c in numbers.items()),
        F.when(has("lang") | has("dir") | (attr("style") != "") | has("selected") | has("checked") | has("open"), F.lit(True)).alias("preserveScope"),
        F.when(tag == "iframe", "frame").when(tag.isin("canvas", "video", "audio", "svg"), "media").alias("opaqueContent"),
    )


def unmapped() -> Column:
    """Attributes of structure() whose numbers do not count, as they stand."""
    return F.map_filter("attributes", lambda k, v: k.isin(list(NUMBERS)) & F.coalesce(~v.rlike(_NUMBER) | (F.try_to_number(F.trim(v), F.lit("S999999999999999999")).isNull()) | (F.try_to_number(F.trim(v), F.lit("S999999999999999999")) < F.when(k.isin([a for a, (_, least) in NUMBERS.items() if least]), 1).otherwise(0)), F.lit(False)))


def tri_state(value: Column, others: list[str]) -> Column:
    return F.when(value.isin("true", "false", *others), value)


def states() -> Column:
    """Struct of states as text, null where the page says nothing; native disabled wins over aria-disabled, other aria states over native ones."""
    control = F.col("tag").isin(STATEFUL)

    def native(a: str) -> Column:
        return F.when(control & has(a), "true")

    return F.struct(
        F.when(control & F.col("context.disabled"), "true").otherwise(tri_state(attr("aria-disabled"), [])).alias("disabled"),
        F.coalesce(tri_state(attr("aria-readonly"), []), native("readonly")).alias("readOnly"), F.coalesce(tri_state(attr("aria-required"), []), native("required")).alias("required"),
        tri_state(attr("aria-selected"), []).alias("selected"), tri_state(attr("aria-expanded"), []).alias("expanded"), tri_state(attr("aria-busy"), []).alias("busy"),
        tri_state(attr("aria-modal"), []).alias("modal"), tri_state(attr("aria-multiselectable"), []).alias("multiSelectable"), tri_state(attr("aria-checked"), ["mixed"]).alias("checked"),
        tri_state(attr("aria-pressed"), ["mixed"]).alias("pressed"), tri_state(attr("aria-invalid"), ["grammar", "spelling"]).alias("invalid"),
        tri_state(attr("aria-current"), ["page", "step", "location", "date", "time"]).alias("current"),
    )


def numeric_value() -> Column:
    """Range of a slider, spin button or progress bar; native limits win over aria ones, and limits the wrong way round count for nothing."""

    def num(a: str) -> Column:
        return F.when(attr(a).rlike(_NUMBER), F.expr(f"try_cast(attributes['{a}'] as double)"))

    low, high, step = F.coalesce(num("min"), num("aria-valuemin")), F.coalesce(num("max"), num("aria-valuemax")), num("step")
    right = ~F.coalesce(low > high, F.lit(False))
    value = F.struct(num("aria-valuenow").alias("current"), F.when(right, low).alias("min"), F.when(right, high).alias("max"), F.when(step > 0, step).alias("step"), attr("aria-valuetext").alias("displayText"))
    any_of = F.coalesce(value["current"], value["min"], value["max"], value["step"]).isNotNull() | value["displayText"].isNotNull()
    return F.when(role().isin("slider", "spinButton", "progress") & any_of, value)


def actions() -> Column:
    """What a user can do with a native control; nothing while it is disabled."""
    tag, kind = F.col("tag"), _input_type()
    link = tag.isin("a", "area") & has("href")
    box = (tag == "input") & kind.isin("checkbox", "radio")
    press = link | tag.isin("button", "summary") | ((tag == "input") & kind.isin("button", "submit", "reset", "image"))
    write = tag.isin("input", "textarea") & ~kind.isin("hidden", "checkbox", "radio", "button", "submit", "reset", "image") & ~F.coalesce(states()["readOnly"] == "true", F.lit(False))
    focus = (tag.isin("input", "textarea", "select", "button") & (kind != "hidden")) | ((tag == "a") & has("href")) | has("tabindex")
    found = F.array_compact(F.array(
        F.when(press, "invoke"), F.when(box & (kind == "checkbox"), "toggle"), F.when(box & (kind == "radio"), "select"), F.when(write, "setValue"), F.when(tag.isin("select", "option"), "select"), F.when(focus, "focus"),
    ))
    return F.when(states()["disabled"] == "true", F.array().cast("array<string>")).otherwise(found)


def exposure() -> Column:
    """Null where nothing hides a node; inert and dormant come from around."""
    hidden_input = (F.col("tag") == "input") & (_input_type() == "hidden")
    return F.struct(
        F.when(has("hidden") | hidden_input, F.lit(False)).alias("rendered"), F.when((attr("aria-hidden") == "true") | hidden_input, F.lit(False)).alias("accessibilityIncluded"),
        F.when(F.col("context.inert"), F.lit(True)).alias("inert"), F.when(F.col("context.dormant"), F.lit(True)).alias("dormant"),
    )


def is_private() -> Column:
    """Values that are withheld: passwords and whatever a user writes."""
    typed = has("value") & (((F.col("tag") == "input") & (_input_type() == "password")) | (role() == "textField"))
    return (F.col("tag") == "textarea") | ((F.col("tag") == "input") & (_input_type() == "password")) | typed


def default_value() -> Column:
    """The value that the source starts with; null where it is private."""
    return F.when(~is_private(), attr("value"))


def target_kind() -> Column:
    """heading, link, button, field or null: the first recognised role token decides, and may make no target of a link; else tag and type."""
    of = {"heading": "heading", "link": "link", "button": "button", **dict.fromkeys(FIELD_ROLES, "field")}
    first = F.get(F.filter(_tokens(F.lower(attr("role"))), lambda t: t.isin([*of, *OTHER_ROLES])), F.lit(0))
    tag, kind = F.col("tag"), _input_type()
    native = (
        F.when(tag.rlike("^h[1-6]$"), "heading").when(tag.isin("a", "area") & has("href"), "link").when(tag.isin("button", "summary"), "button")
        .when(tag == "input", F.when(kind.isin("button", "submit", "reset", "image"), "button").when(kind != "hidden", "field")).when(tag.isin("select", "textarea"), "field")
    )
    return F.when(F.col("kind") == "element", F.when(first.isNotNull(), _lookup(of, first)).otherwise(native))


def is_hidden() -> Column:
    own = has("hidden") | has("inert") | (F.lower(attr("aria-hidden")) == "true") | ((F.col("tag") == "input") & (F.lower(attr("type")) == "hidden"))
    return F.coalesce(own, F.lit(False)) | F.col("tag").isin(INERT)


def hidden_by_style() -> Column:
    return F.coalesce(attr("style"), F.lit("")).rlike(r"(?i)(display\s*:\s*none|visibility\s*:\s*hidden)")


def evidence_label(text: Column) -> Column:
    """Text, aria-label, alt, title, name, tag: the first that is not blank, at most 160 characters."""
    def some(c: Column) -> Column:
        return F.when(F.trim(c) != "", F.trim(c))

    return F.substring(F.coalesce(some(text), some(attr("aria-label")), some(attr("alt")), some(attr("title")), some(attr("name")), F.col("tag")), 1, 160)


def summary(text: Column, limit: int = 160) -> Column:
    """Label of a node cut to the limit, and whether it was cut."""
    label = F.regexp_replace(F.trim(text), r"\s+", " ")
    return F.struct(F.substring(label, 1, limit).alias("label"), (F.length(label) > limit).alias("truncated"))


def _ids(nodes: DataFrame) -> DataFrame:
    """(doc_id, id, n, found, payload, labelable): what each html id names."""
    labelable = F.col("tag").isin(LABELABLE) & ~((F.col("tag") == "input") & (_input_type() == "hidden"))
    ids = nodes.where(attr("id") != "")
    return ids.groupBy("doc_id", attr("id").alias("id")).agg(F.count("*").alias("n"), F.min("node").alias("found"), F.max("context.payload").alias("payload"), F.max(labelable).alias("labelable"))


def _resolved(asked: DataFrame, nodes: DataFrame, labelable: bool = False) -> DataFrame:
    """asked (doc_id, node, kind, ordinal, id) with target, or the reason why there is none."""
    reason = F.when(F.col("n").isNull(), "missing-target").when(F.col("n") > 1, "ambiguous-html-id").when(F.col("payload"), "excluded-target")
    if labelable:
        reason = reason.when(~F.col("labelable"), "non-labelable-target")
    j = asked.join(_ids(nodes), ["doc_id", "id"], "left")
    return j.select("doc_id", "node", "kind", "ordinal", F.when(reason.isNull(), F.col("found")).alias("target"), reason.alias("reason"))


def _contextual(nodes: DataFrame) -> DataFrame:
    return nodes if "context" in nodes.columns else with_context(nodes)


def resolve_references(nodes: DataFrame) -> DataFrame:
    """(doc_id, node, kind, ordinal, target, reason): id references of every observed element; unresolved ones tell why."""
    nodes = _contextual(nodes)
    pairs = F.array(*(F.struct(F.lit(k).alias("kind"), attr(a).alias("ids")) for a, k in REFERENCES.items()))
    asked = nodes.where("kind = 'element' and not context.payload").select("doc_id", "node", F.explode(F.filter(pairs, lambda p: p["ids"].isNotNull())).alias("p"))
    return _resolved(asked.select("doc_id", "node", "p.kind", F.posexplode(_tokens(F.col("p.ids"))).alias("ordinal", "id")), nodes)


def _one_way(rows: DataFrame, node: str, kind: str, target: str) -> DataFrame:
    return rows.select("doc_id", F.col(node).alias("node"), F.lit(kind).alias("kind"), F.lit(0).alias("ordinal"), F.col(target).alias("target"), F.lit(None).cast("string").alias("reason"))


def label_relations(nodes: DataFrame) -> DataFrame:
    """(doc_id, node, kind, ordinal, target, reason): labelFor by for=, else the first labelable element inside the label; labelledBy the other way."""
    nodes = _contextual(nodes)
    labels = nodes.where("tag = 'label' and not context.payload")
    named = _resolved(labels.where(attr("for") != "").select("doc_id", "node", F.lit("labelFor").alias("kind"), F.lit(0).alias("ordinal"), attr("for").alias("id")), nodes, labelable=True)
    controls = nodes.where(F.col("tag").isin(LABELABLE) & ~((F.col("tag") == "input") & (_input_type() == "hidden")))
    inside = descendants(labels.where(~has("for")), controls).groupBy("doc_id", F.col("root").alias("label")).agg(F.min_by("node", "pre").alias("control"))
    forward = named.unionByName(_one_way(inside, "label", "labelFor", "control"))
    return forward.unionByName(_one_way(forward.where("target is not null").withColumnRenamed("node", "label"), "target", "labelledBy", "label"))


def caption_relations(nodes: DataFrame) -> DataFrame:
    """(doc_id, node, kind, ordinal, target, reason): legends and titles label what they are direct children of, captions caption it, a desc describes it."""
    nodes = _contextual(nodes).where("not context.payload")
    kinds = {"fieldset>legend": "labelledBy", "table>caption": "captionedBy", "figure>figcaption": "captionedBy", "svg>title": "labelledBy", "svg>desc": "describedBy"}
    found = nodes.withColumn("rel", _lookup(kinds, F.concat_ws(">", "context.parentTag", "tag"))).where("kind = 'element' and rel is not null")
    return found.select("doc_id", F.col("parent").alias("node"), F.col("rel").alias("kind"), F.lit(0).alias("ordinal"), F.col("node").alias("target"), F.lit(None).cast("string").alias("reason"))


def form_owner(nodes: DataFrame) -> DataFrame:
    """(doc_id, node, kind, ordinal, target, reason): formOwner by form=, else the nearest form around a control; none outside forms."""
    nodes = _contextual(nodes)
    controls = nodes.where(F.col("tag").isin(FORM_PARTS) & ~F.col("context.payload"))
    named = _resolved(controls.where(attr("form") != "").select("doc_id", "node", F.lit("formOwner").alias("kind"), F.lit(0).alias("ordinal"), attr("form").alias("id")), nodes)
    return named.unionByName(_one_way(controls.where(F.coalesce(attr("form"), F.lit("")) == "").where("context.form is not null").withColumn("form", F.col("context.form")), "node", "formOwner", "form"))


def details_relations(nodes: DataFrame) -> DataFrame:
    """(doc_id, node, kind, ordinal, target, reason): a summary controls the details that it is a direct child of."""
    return _one_way(_contextual(nodes).where("tag = 'summary' and context.parentTag = 'details' and not context.payload"), "node", "controls", "parent")


def fragment_targets(nodes: DataFrame) -> DataFrame:
    """(doc_id, node, kind, ordinal, target, reason): links to a fragment of their own page; what cannot be decoded is taken as it is."""
    nodes = _contextual(nodes)
    raw = F.expr("substring(attributes['href'], 2)")
    links = nodes.where((F.col("tag") == "a") & attr("href").rlike("^#.") & ~F.col("context.payload"))
    asked = links.select("doc_id", "node", F.lit("fragmentTarget").alias("kind"), F.lit(0).alias("ordinal"), F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw).alias("id"))
    return _resolved(asked, nodes)


def embeds(nodes: DataFrame, hosts: DataFrame) -> DataFrame:
    """(doc_id, node, kind, ordinal, target, reason, target_doc): hosts (doc_id, host_doc, host_node) embed the root of each document; a host that is no observed node is an error."""
    at = hosts.join(nodes.select(F.col("doc_id").alias("host_doc"), F.col("node").alias("host_node"), F.lit(True).alias("there")), ["host_doc", "host_node"], "left")
    return at.select(
        F.col("host_doc").alias("doc_id"), F.col("host_node").alias("node"), F.lit("embeds").alias("kind"), F.lit(0).alias("ordinal"), F.lit(0).alias("target"),
        F.when(F.col("there").isNull(), "missing-host").alias("reason"), F.col("doc_id").alias("target_doc"),
    )


def relations(nodes: DataFrame) -> DataFrame:
    """All relations of each page: (doc_id, node, kind, ordinal, target, reason)."""
    nodes = _contextual(nodes)
    return reduce(DataFrame.unionByName, (f(nodes) for f in (resolve_references, label_relations, caption_relations, form_owner, details_relations, fragment_targets)))


def observe(nodes: DataFrame) -> DataFrame:
    """nodes with role, name, description, hints, structure, states, value, actions, exposure and privacy; payload and what a user wrote are not among them.

    All comes from the node and the context that the parsing pass left on it: nothing is shuffled.
    """
    kept = _contextual(nodes).where("not context.payload")
    element = F.col("kind") == "element"
    return kept.withColumns({
        "role": role(), "role_diagnostic": role_diagnostic(), "name": name(), "description": description(), "hints": hints(), "structure": structure(), "unmapped": unmapped(), "states": states(),
        "default_states": default_states(), "value": numeric_value(), "default_value": default_value(), "actions": F.when(element, actions()), "exposure": exposure(), "private": is_private(),
    })


def enriched(observed: DataFrame, overlay: DataFrame) -> DataFrame:
    """observed with what a browser reported: overlay (doc_id, node, verified, name, description, disabled, actions array, rendered, focused).

    Reported values win where they are not null; a disabled node keeps no native
    action. problem tells overlay rows that must not be joined: not verified, of
    no node, repeated, or a second focus; those change nothing.
    """
    n = overlay.groupBy("doc_id", "node").agg(F.count("*").alias("_n"))
    focus = overlay.where("focused").groupBy("doc_id").agg(F.count("*").alias("_f"))
    o = overlay.join(n, ["doc_id", "node"]).join(focus, "doc_id", "left")
    problem = F.when(~F.coalesce("verified", F.lit(False)), "unverified").when(F.col("_n") > 1, "conflicting").when(F.coalesce("focused", F.lit(False)) & (F.col("_f") > 1), "conflicting focus")
    o = o.select("doc_id", "node", problem.alias("problem"), *(F.when(problem.isNull(), F.col(c)).alias(f"_{c}") for c in ("name", "description", "disabled", "actions", "rendered", "focused")))
    o = o.dropDuplicates(["doc_id", "node"])
    j = observed.join(o, ["doc_id", "node"], "full_outer")

    def reported(c: str) -> Column:
        return F.when(F.col(f"_{c}").isNotNull(), F.struct(F.col(f"_{c}").alias("text"), F.lit("browser").alias("basis")))

    off = F.coalesce(F.col("_disabled"), F.col("states.disabled") == "true", F.lit(False))
    return j.withColumns({
        "name": F.coalesce(reported("name"), "name"), "description": F.coalesce(reported("description"), "description"),
        "states": F.when(F.col("states").isNotNull(), F.col("states").withField("disabled", F.coalesce(F.col("_disabled").cast("string"), "states.disabled"))),
        "actions": F.coalesce("_actions", F.when(off, F.array().cast("array<string>")).otherwise(F.col("actions"))),
        "exposure": F.when(F.col("exposure").isNotNull(), F.col("exposure").withField("rendered", F.coalesce("_rendered", "exposure.rendered"))),
        "focused": F.coalesce("_focused", F.lit(False)), "problem": F.when(F.col("tag").isNull(), "missing").otherwise(F.col("problem")),
    }).drop("_name", "_description", "_disabled", "_actions", "_rendered", "_focused")


#: Properties of accessibility nodes that a snapshot keeps.
AX_PROPERTIES = ["checked", "selected", "expanded", "disabled", "required", "invalid", "readonly", "multiselectable", "level", "valuemin", "valuemax", "valuetext"]


def kept_properties(properties: Column) -> Column:
    """A map of properties without those that a snapshot does not keep, or that have no value."""
    return F.map_filter(properties, lambda k, v: k.isin(AX_PROPERTIES) & v.isNotNull())

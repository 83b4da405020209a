"""HTML as interval-encoded node tables: one pass over each document gives a row per node.

A node is a descendant of another in the same document if its `pre` lies in the
other's [pre, end). Tree repair follows the usual rules for void elements, implied
ends and blocks that close paragraphs; formatting elements end with their block.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the HTML language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
#: What a start tag ends, and the elements beyond which it looks for nothing to end.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
}
FORMATTING = frozenset("a abbr b bdi bdo cite code em font i kbd mark q s samp small span strong sub sup u var".split())

NODES = "doc_id long, node int, parent int, pre int, end int, depth int, sib int, kind string, tag string, attributes map<string,string>, text string"


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = [[-1, 0, 0, 0, "element", "#document", {}, None]]  # parent, end, depth, sib, kind, tag, attributes, text
        self.open = [0]
        self.n_open: Counter = Counter()  # so that a deep stack is not searched for what it does not hold
        self.children = [0]

    def _add(self, kind: str, tag: str, attributes: dict, text: str | None) -> int:
        up = self.open[-1]
        self.rows.append([up, 0, self.rows[up][2] + 1, self.children[up], kind, tag, attributes, text])
        self.children[up] += 1
        self.children.append(0)
        return len(self.rows) - 1

    def _close(self, depth: int) -> None:
        """Closes what stands at this place of the stack of open elements and behind it."""
        for n in self.open[depth:]:
            self.rows[n][1] = len(self.rows)
            self.n_open[self.rows[n][5]] -= 1
        del self.open[depth:]

    def _find(self, tags: frozenset | set, stops: set) -> int | None:
        if not any(self.n_open[t] for t in tags):
            return None
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.rows[self.open[i]][5]
            if tag in tags:
                return i
            if tag in stops:
                return None
        return None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in CLOSES_P and (i := self._find({"p"}, {"table", "td", "th", "button"})) is not None:
            self._close(i)
        if tag in IMPLIED:
            ends, stops = IMPLIED[tag]
            while (i := self._find(ends, stops)) is not None:
                self._close(i)
        attributes: dict[str, str] = {}
        for k, v in attrs:
            attributes.setdefault(k, v or "")
        n = self._add("element", tag, attributes, None)
        if tag not in VOID:
            self.open.append(n)
            self.n_open[tag] += 1
        else:
            self.rows[n][1] = n + 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        stops = set() if tag not in FORMATTING else set(CLOSES_P) | {"li", "td", "th", "body"}
        if tag not in VOID and (i := self._find({tag}, stops)) is not None:
            self._close(i)

    def handle_data(self, data: str) -> None:
        n = self._add("text", "#text", {}, data)
        self.rows[n][1] = n + 1

    def finish(self) -> list[list]:
        self.close()
        self._close(0)
        return self.rows


def parse(html: str | None) -> list[list]:
    """Rows (parent, end, depth, sib, kind, tag, attributes, text) in preorder; row 0 is the document."""
    tree = _Tree()
    tree.feed(html or "")
    return tree.finish()


CONTEXT = (
    "struct<language:string,direction:string,verbatim:boolean,contentKind:string,inert:boolean,dormant:boolean,disabled:boolean,sectioned:boolean,payload:boolean,"
    "parentTag:string,branching:boolean,form:int,position:int,ofTag:int>"
)
#: Elements that run or draw, and hold no content of the page.
PAYLOAD = ["script", "style", "link", "meta", "base", "path", "polygon", "polyline", "circle", "ellipse", "rect", "line", "defs", "use"]
SECTIONING = ["article", "aside", "main", "nav", "section"]


def contexts(rows: list[list]) -> list[tuple]:
    """What each row of parse() has from its ancestors and siblings, in the order of CONTEXT.

    disabled counts a control's own attribute, fieldsets around it (unless it
    lies in the first legend of the fieldset) and the group of an option; payload
    marks subtrees without content and the text of a textarea; branching tells
    more than one child that is no blank text; form is the nearest form around;
    position counts a row's place among siblings of its tag, of ofTag in all.
    """
    out: list[tuple] = []
    fieldsets: list[frozenset] = []
    meaningful = [0] * len(rows)
    legends: set[int] = set()
    of_tag: Counter = Counter()
    place = [0] * len(rows)
    for i, (parent, _, _, _, kind, tag, _, text) in enumerate(rows):
        if parent >= 0:
            meaningful[parent] += kind != "text" or bool((text or "").strip())
            of_tag[parent, tag] += 1
            place[i] = of_tag[parent, tag]
    for i, (parent, _, _, _, kind, tag, a, _) in enumerate(rows):
        up = out[parent] if parent >= 0 else (None, None, False, None, False, False, False, False, False, None, False, None, 0, 0)
        up_tag = rows[parent][5] if parent >= 0 else None
        around = fieldsets[parent] if parent >= 0 else frozenset()
        if tag == "fieldset" and "disabled" in a:
            around = around | {i}
        if tag == "legend" and up_tag == "fieldset" and parent not in legends:
            legends.add(parent)
            around = around - {parent}
        fieldsets.append(around)
        verbatim = up[2] or tag in ("pre", "code", "math")
        content = "math" if tag == "math" else "code" if tag in ("pre", "code") else up[3]
        group = tag == "option" and up_tag == "optgroup" and "disabled" in rows[parent][6]
        payload = up[8] or tag in PAYLOAD or (kind == "text" and up_tag == "textarea")
        out.append((
            a.get("lang", up[0]), a.get("dir", up[1]), verbatim, content, up[4] or "inert" in a, up[5] or tag == "template", "disabled" in a or bool(around) or group,
            up[7] or up_tag in SECTIONING, payload, up_tag, meaningful[i] > 1, parent if up_tag == "form" else up[11], place[i], of_tag[parent, tag],
        ))
    return out


_CONTEXT_NAMES = ["language", "direction", "verbatim", "contentKind", "inert", "dormant", "disabled", "sectioned", "payload", "parentTag", "branching", "form", "position", "ofTag"]
_CONTEXT_TYPES = [pa.string(), pa.string(), pa.bool_(), pa.string(), *[pa.bool_()] * 5, pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.int32()]


def _context_array(rows: list[list]) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(zip(*contexts(rows), strict=True), _CONTEXT_TYPES, strict=True)], _CONTEXT_NAMES)


def nodes(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", context: bool = False) -> DataFrame:
    """A row per node of each document, with the struct of contexts() if asked for: one pass over each page, and no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.map_(pa.string(), pa.string())
        for batch in batches:
            for doc, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = parse(html)
                n = range(len(rows))
                parent, end, depth, sib, kinds, tags, attributes, texts = zip(*rows, strict=True)
                columns = [
                    pa.array([doc] * len(rows), pa.int64()), pa.array(n, pa.int32()), pa.array(parent, pa.int32()), pa.array(n, pa.int32()), pa.array(end, pa.int32()), pa.array(depth, pa.int32()),
                    pa.array(sib, pa.int32()), pa.array(kinds, pa.string()), pa.array(tags, pa.string()), pa.array([list(a.items()) for a in attributes], kind), pa.array(texts, pa.string()),
                ]
                names = ["doc_id", "node", "parent", "pre", "end", "depth", "sib", "kind", "tag", "attributes", "text"]
                if context:
                    columns, names = [*columns, _context_array(rows)], [*names, "context"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return pages.select(F.col(id_col).cast("long").alias("doc_id"), F.col(html_col).alias("html")).mapInArrow(run, f"{NODES}, context {CONTEXT}" if context else NODES)


def with_context(nodes: DataFrame) -> DataFrame:
    """nodes with the struct of contexts(), for tables that were parsed without it: one pass over each document."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pre")
        rows = [[r["parent"], r["end"], r["depth"], r["sib"], r["kind"], r["tag"], dict(r["attributes"] or []), r["text"]] for r in table.to_pylist()]
        return table.append_column("context", _context_array(rows))

    names = ["doc_id", "node", "parent", "pre", "end", "depth", "sib", "kind", "tag", "attributes", "text"]
    return nodes.select(*names).groupBy("doc_id").applyInArrow(run, f"{NODES}, context {CONTEXT}")


def source_hash(html: Column) -> Column:
    """Identity of a page's source."""
    return F.sha2(F.coalesce(html, F.lit("")), 256)


def admitted(html: Column, n_nodes: Column, most_characters: int = 20_000_000, most_nodes: int = 200_000) -> Column:
    """Whether a page keeps to the limits of a source."""
    return (F.coalesce(F.length(html), F.lit(0)) <= most_characters) & (n_nodes <= most_nodes)

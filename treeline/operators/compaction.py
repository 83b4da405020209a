"""Compact markup of whole pages, with a ledger that accounts for every node, and exact reversal of attribute and text cuts.

What depends on the order of decisions runs as one function per document, in the
pass that parsed it: rows of a document stand together, so nothing is shuffled.
All of it are loops over preorder lists; a chain of any depth costs no stack.
"""

from __future__ import annotations

import json
import re
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treeline.operators.perdoc import per_document
from treeline.operators.ranking import ranked
from treeline.operators.tree import _open_around

#: Lengths to which text is cut: under a budget, otherwise, headings, preformatted text, previews, destinations.
BRIEF, EXCERPT, HEADING, PREFORMATTED, PREVIEW, DESTINATION = 180, 360, 512, 1200, 140, 96
#: Attributes that stay, relations between nodes, and tags that are no reading matter.
KEEP = set(
    "id role type name value label alt title placeholder checked selected disabled required readonly multiple open hidden inert tabindex lang dir colspan rowspan scope start reversed min max step "
    "pattern autocomplete".split()
)
RELATIONS = set("for headers list form aria-labelledby aria-describedby aria-controls aria-owns aria-details aria-errormessage aria-activedescendant".split())
NOISE = set("script style link meta base".split())
WRAPPERS = set("div span font center".split())
VERBATIM = set("pre code textarea math".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6 legend caption summary".split())
CONTROLS = set("a button input select textarea".split())
CONTROL_ROLES = set("button checkbox combobox radio switch slider textbox".split())
WHOLE = set("label math pre code textarea img figcaption dt dd th".split())
SKELETONS = set("form fieldset select optgroup ul ol dl table thead tbody tr th article".split())
UNFOLDED = set("html head title body h1 h2 h3 h4 h5 h6 legend caption summary input img br hr option th td tr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Options from which a list is sampled.
MANY = 7

LEDGER = "doc_id long, node int, tag string, disposition string, representative int, reason string"
HTML = "doc_id long, html string, n_bytes long, source_bytes long, status string, n_kept int, n_deferred int, n_cut int, problems array<string>"


def _escape(text: str, quote: bool = False) -> str:
    text = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return text.replace('"', "&quot;") if quote else text


def _flat(text: str) -> str:
    return " ".join(text.split())


def excerpt(text: str, limit: int) -> str:
    """The text, or its beginning cut at the last blank in the second half, with an ellipsis."""
    if len(text) <= limit:
        return text
    cut = text[:limit]
    at = cut.rfind(" ")
    return cut[: at if at >= limit / 2 else limit].rstrip() + "…"


def destination(href: str) -> str:
    """Host and path of a link, the scheme alone of data and scripts: to read, not to follow."""
    if re.match(r"(?i)(data|blob|javascript):", href):
        return href.split(":")[0] + ": [omitted]"
    try:
        url = urlsplit(href)
        return excerpt((url.hostname or "") + url.path, DESTINATION)
    except ValueError:
        return excerpt(re.split(r"[?#]", href)[0], DESTINATION)


class Compactor:
    """One document: rows of nodes in preorder, under a profile (structure, excerpt, budget) and a limit of bytes."""

    def __init__(self, rows: list[dict], budget: int, profile: str = "budget"):
        self.rows, self.budget, self.profile = rows, budget, profile
        at = {r["node"]: i for i, r in enumerate(rows)}
        n = len(rows)
        self.parent = [at.get(r["parent"], -1) for r in rows]
        self.children: list[list[int]] = [[] for _ in rows]
        for i, p in enumerate(self.parent):
            if p >= 0:
                self.children[p].append(i)
        self.end = [i + 1 for i in range(n)]
        for i in range(n - 1, 0, -1):
            self.end[self.parent[i]] = max(self.end[self.parent[i]], self.end[i])
        self.tag = [r["tag"] for r in rows]
        self.element = [r["kind"] == "element" for r in rows]
        self.given = [dict(r["attributes"] or []) for r in rows]
        self.attributes = [dict(a) for a in self.given]
        self.text = [r["text"] or "" for r in rows]
        self.state = ["retained"] * n
        self.stands = list(range(n))
        self.reason = [""] * n
        self.cuts = 0
        self.targets = {t for a in self.given for k in RELATIONS & set(a) for t in a[k].split()} | {unquote(a["href"][1:]) for a in self.given if a.get("href", "").startswith("#")}
        self.named = {a["id"] for a in self.given if a.get("id") in self.targets}
        self.verbatim = self._below(lambda i: self.tag[i] in VERBATIM)

    def _below(self, test) -> bytearray:  # noqa: ANN001
        out = bytearray(len(self.rows))
        for i, p in enumerate(self.parent):
            out[i] = (p >= 0 and out[p]) or bool(self.element[i] and test(i))
        return out

    def live(self, i: int) -> bool:
        return self.state[i] == "retained"

    def drop(self, i: int, state: str, stands: int, reason: str) -> None:
        for j in range(i, self.end[i]):
            if self.live(j) or self.state[j] == "collapsed":
                self.state[j], self.stands[j], self.reason[j] = state, stands, reason

    def text_of(self, i: int) -> str:
        return _flat(" ".join(self.text[j] for j in range(i, self.end[i]) if not self.element[j] and self.live(j)))

    def exclude(self) -> None:
        """What nobody reads goes; templates and alternatives are deferred; of a head its title stays."""
        for i, tag in enumerate(self.tag):
            if not self.live(i) or not self.element[i]:
                continue
            if tag in NOISE or (self.parent[i] >= 0 and self.tag[self.parent[i]] == "head" and tag != "title"):
                self.drop(i, "excluded", -1, "payload")
            elif tag in ("template", "noscript"):
                self.drop(i, "deferred", self.parent[i], "inactive-or-alternative-content")

    def rename(self) -> None:
        """Attributes that say something stay; links tell where they lead, by a number for each destination; passwords go."""
        numbers: dict[str, int] = {}
        for i, a in enumerate(self.given):
            if not a:
                continue
            kept = {k: v for k, v in a.items() if (k in KEEP or k in RELATIONS or k.startswith("aria-")) and (k != "id" or v in self.targets)}
            if self.tag[i] == "a" and a.get("href"):
                kept["data-destination-id"] = f"u{_base36(numbers.setdefault(a['href'], len(numbers)))}"
                if a["href"].startswith("#"):
                    kept["data-destination-kind"] = "fragment"
                kept["data-destination"] = destination(a["href"])
            if "hidden" in a or re.search(r"(?i)(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", a.get("style", "")):
                kept["hidden"] = ""
            if self.tag[i] == "input" and a.get("type") == "password":
                kept.pop("value", None)
            self.attributes[i] = kept

    def simplify_drawings(self) -> None:
        speaks = lambda j: self.tag[j] in ("title", "desc", "text", "tspan") or "aria-label" in self.given[j] or "aria-labelledby" in self.given[j]
        for i, tag in enumerate(self.tag):
            if tag != "svg" or not self.live(i):
                continue
            says = [j for j in range(i + 1, self.end[i]) if self.element[j] and speaks(j)]
            keep = set(says)
            for j in says:
                keep |= set(range(j, self.end[j]))
                while (j := self.parent[j]) > i:
                    keep.add(j)
            for j in range(i + 1, self.end[i]):
                if j not in keep and self.element[j] and self.live(j):
                    self.drop(j, "deferred", i, "vector-geometry")
            name = self.given[i].get("aria-label") or next((self.text_of(j) for j in says if self.tag[j] in ("title", "desc")), "")
            self.attributes[i] |= {"data-deferred": "vector"} | ({"aria-label": name} if name else {})

    def collapse(self) -> None:
        """Wrappers without attributes, own text or a second child give way to what they hold, from below."""
        inner = [[c for c in own if self.element[c] and self.live(c)] for own in self.children]
        for i in range(len(self.rows) - 1, 0, -1):
            if not self.live(i) or self.tag[i] not in WRAPPERS or self.attributes[i]:
                continue
            own = "".join(self.text[c] for c in self.children[i] if not self.element[c])
            held = [x for c in inner[i] for x in (inner[c] if self.state[c] == "collapsed" else [c])]
            if own.strip() or len(held) > 1:
                continue
            self.state[i], self.stands[i], self.reason[i] = "collapsed", held[0] if held else self.parent[i], "generic-wrapper"
            inner[i] = held

    def flatten(self) -> None:
        for i, text in enumerate(self.text):
            if not self.element[i] and not self.verbatim[i] and (new := re.sub(r"\s+", " ", text)) != text:
                self.text[i] = new

    def exceptional(self, i: int) -> bool:
        a = self.given[i]
        return (
            any(k in a for k in ("selected", "checked", "required", "disabled")) or any(a.get(k) == "true" for k in ("aria-disabled", "aria-required", "aria-selected", "aria-checked", "aria-expanded"))
            or a.get("aria-checked") == "mixed" or a.get("aria-current", "false") != "false" or a.get("aria-invalid", "false") != "false" or a.get("role") in ("alert", "status")
        )

    def control(self, i: int) -> bool:
        return self.tag[i] in CONTROLS or self.given[i].get("role") in CONTROL_ROLES or "tabindex" in self.given[i]

    def heading(self, i: int) -> bool:
        return self.tag[i] in HEADINGS or self.given[i].get("role") == "heading"

    def protect(self) -> None:
        """full: subtrees whose text stays; bones: nodes that stay; said: subtrees that tell about a control's state, which no cut touches."""
        n = len(self.rows)
        self.full, self.bones, self.said = bytearray(n), bytearray(n), bytearray(n)
        by_id: dict[str, list[int]] = {}
        labels: dict[str, list[int]] = {}
        for i, a in enumerate(self.given):
            if a.get("id"):
                by_id.setdefault(a["id"], []).append(i)
            if self.tag[i] == "label" and "for" in a:
                labels.setdefault(a["for"], []).append(i)
        whole = lambda row, i: row.__setitem__(slice(i, self.end[i]), b"\1" * (self.end[i] - i))
        drawn = self._below(lambda i: self.tag[i] == "svg")
        for i in range(n):
            if not self.element[i] or not self.live(i):
                continue
            tag, a = self.tag[i], self.given[i]
            odd, control = self.exceptional(i), self.control(i)
            listy = tag in ("select", "optgroup")
            spoken = drawn[i] and (tag in ("title", "desc", "text", "tspan") or (tag == "svg" and ("aria-label" in a or "aria-labelledby" in a)))
            if not listy and (self.heading(i) or odd or tag in WHOLE or spoken) or (control and tag != "select"):
                whole(self.full, i)
            if tag in ("p", "li", "td") and len(self.text_of(i)) <= EXCERPT:
                whole(self.full, i)
            if self.heading(i) and self.parent[i] >= 0:
                after = next((c for c in self.children[self.parent[i]] if c > i and self.element[c]), None)
                if after is not None and self.tag[after] == "p":
                    whole(self.full, after)
            if tag in SKELETONS or (tag in ("div", "span") and sum(self.element[c] and self.live(c) for c in self.children[i]) > 1) or a.get("id") in self.targets:
                self.bones[i] = 1
            if control or odd:
                about = [i] if odd and not listy else []
                up = i
                while up >= 0 and self.tag[up] != "label":
                    up = self.parent[up]
                about += [up] if up >= 0 else []
                about += labels.get(a.get("id"), [])
                about += [t for k in ("aria-labelledby", "aria-describedby", "aria-details", "aria-errormessage") for token in a.get(k, "").split() for t in by_id.get(token, [])]
                for t in about:
                    whole(self.said, t)
                    whole(self.full, t)

    def cut_texts(self) -> None:
        limit = BRIEF if self.profile == "budget" else EXCERPT
        titled = self._below(self.heading)
        for i in range(len(self.rows)):
            if not self.live(i) or self.said[i]:
                continue
            if self.element[i]:
                for k in ("aria-label", "title", "alt", "placeholder"):
                    if len(self.attributes[i].get(k, "")) > limit and not self.full[i]:
                        self.attributes[i][k] = excerpt(self.attributes[i][k], limit)
                        self.attributes[i]["data-excerpt"] = "true"
                continue
            if self.tag[self.parent[i]] == "math" or (self.full[i] and not self.verbatim[i] and not titled[i]):
                continue
            most = HEADING if titled[i] else PREFORMATTED if self.verbatim[i] else limit
            text = self.text[i] if self.verbatim[i] else _flat(self.text[i])
            if len(text) > most:
                self.text[i] = text[:most] + "…" if self.verbatim[i] else excerpt(text, most)
                self.attributes[self.parent[i]]["data-excerpt"] = "true"
                self.cuts += 1

    def sample_options(self) -> None:
        """Of long lists of options the first two, the last and exceptions stay."""
        for i, tag in enumerate(self.tag):
            if tag not in ("select", "optgroup", "datalist") or not self.live(i):
                continue
            own = [c for c in self.children[i] if self.tag[c] == "option" and self.live(c)]
            if len(own) < MANY:
                continue
            gone = [c for c in own[2:-1] if not self.said[c] and not any(self.exceptional(j) for j in range(c, self.end[c]) if self.element[j])]
            for c in gone:
                self.drop(c, "deferred", i, "list-sampling")
            if gone:
                self.attributes[i] |= {"data-omitted-items": str(len(gone)), "data-deferred": "items"}
        for i, tag in enumerate(self.tag):  # the samples are not folded away later
            if tag == "option" and self.live(i):
                self.full[i : self.end[i]] = b"\1" * (self.end[i] - i)

    def fold(self) -> None:
        """Folds the region that saves most for its rank, and again, while the markup is too large: what is protected in it stays, with the way to it."""
        odd_below = bytearray(len(self.rows))
        for i in range(len(self.rows) - 1, 0, -1):
            odd_below[i] |= bool(self.element[i] and self.exceptional(i))
            odd_below[self.parent[i]] |= odd_below[i]
        odd_above = self._below(self.exceptional)
        stay = bytearray(len(self.rows))
        for i in range(len(self.rows) - 1, 0, -1):
            stay[i] |= self.full[i] | self.bones[i]
            stay[self.parent[i]] |= stay[i]
        free = [0] * len(self.rows)  # elements below that nothing protects
        size = self.size()
        for i in range(len(self.rows) - 1, 0, -1):
            free[i] += self.element[i] and self.live(i) and not stay[i]
            free[self.parent[i]] += free[i]
        regions = []
        for i, tag in enumerate(self.tag):
            if not self.element[i] or not self.live(i) or tag in UNFOLDED or tag == "#document" or self.full[i] or odd_above[i] or self.verbatim[i]:
                continue
            saving = free[i] - (not stay[i])
            rank = 1 if tag in ("ul", "ol", "tbody", "select", "nav") else 5 if tag in ("form", "dialog") or self.given[i].get("role") == "dialog" or odd_below[i] else 2
            if saving > 0:
                regions.append((-saving / rank, i))
        for _, i in sorted(regions):
            if size <= self.budget:
                break
            if not self.live(i) or "data-folded" in self.attributes[i]:
                continue
            gone = [j for j in range(i + 1, self.end[i]) if self.live(j) and not stay[j] and not (not self.element[j] and self.full[j])]
            if not any(self.element[j] for j in gone):
                continue
            preview = excerpt(self.text_of(i), PREVIEW)
            size -= self.own_size(i) + sum(map(self.own_size, gone))
            for j in gone:
                self.state[j], self.stands[j], self.reason[j] = "deferred", i, "budget-fold"
            self.attributes[i] |= {"data-folded": "true", "data-deferred": str(sum(self.element[j] for j in gone))} | ({"data-preview": preview} if preview else {})
            size += self.own_size(i)

    def repair(self) -> None:
        """Relations to what is gone keep the ends that are left, and tell the others."""
        there = {self.attributes[i]["id"] for i in range(len(self.rows)) if self.live(i) and self.attributes[i].get("id")}
        for i, a in enumerate(self.attributes):
            for k in RELATIONS & set(a):
                tokens = a[k].split()
                missing = [t for t in tokens if t not in there]
                if missing:
                    left = [t for t in tokens if t in there]
                    if left:
                        a[k] = " ".join(left)
                    else:
                        del a[k]
                    a[f"data-missing-{k}"] = " ".join(missing)
                    a["data-relations-deferred"] = "true"

    def shown(self, i: int) -> bool:
        return self.live(i) and self.tag[i] != "#document"

    def start(self, i: int) -> str:
        ref = "" if self.tag[i] in ("html", "head") else f' data-r="{_base36(i)}"'
        return f"<{self.tag[i]}" + "".join(f' {k}="{_escape(v, True)}"' for k, v in self.attributes[i].items()) + ref + ">"

    def own_size(self, i: int) -> int:
        """Bytes of a shown node's tags or text."""
        if not self.shown(i):
            return 0
        if not self.element[i]:
            return len(_escape(self.text[i]).encode())
        return len(self.start(i).encode()) + (0 if self.tag[i] in VOID else len(self.tag[i]) + 3)

    def size(self) -> int:
        return sum(map(self.own_size, range(len(self.rows))))

    def html(self) -> str:
        out: list[str] = []
        open_: list[tuple[int, str]] = []
        for i in range(len(self.rows)):
            while open_ and open_[-1][0] <= i:
                out.append(f"</{open_.pop()[1]}>")
            if not self.shown(i):
                continue
            if not self.element[i]:
                out.append(_escape(self.text[i]))
                continue
            out.append(self.start(i))
            if self.tag[i] not in VOID:
                open_.append((self.end[i], self.tag[i]))
        out += [f"</{tag}>" for _, tag in reversed(open_)]
        return "".join(out)

    def run(self) -> str:
        self.exclude()
        self.rename()
        self.simplify_drawings()
        self.collapse()
        self.flatten()
        self.protect()
        self.controls = [i for i in range(len(self.rows)) if self.element[i] and self.live(i) and self.control(i) and self.tag[i] != "select"]
        before = {i: self.text[i] for i in range(len(self.rows)) if not self.element[i] and self.live(i) and self.said[i]}
        if self.profile != "structure":
            self.cut_texts()
            self.sample_options()
        if self.profile == "budget":
            self.fold()
        self.repair()
        self.before = before
        return self.html()

    def resolved(self, i: int) -> int:
        """The survivor at the end of a chain of representatives, -1 if there is none."""
        for _ in range(len(self.rows)):
            if i < 0 or self.live(i):
                return i
            i = self.stands[i]
        return -1

    def problems(self, html: str) -> list[str]:
        """What the compaction breaks of its promises; none if it is right."""
        out = []
        live = [i for i in range(len(self.rows)) if self.live(i)]
        out += ["lost control"] if any(not self.live(i) and self.reason[i] == "budget-fold" for i in self.controls) else []
        out += ["changed text about a state"] if any(not self.live(i) and self.reason[i] == "budget-fold" or (self.live(i) and self.text[i] != t) for i, t in self.before.items()) else []
        out += ["lost boundary"] if any(b and self.reason[i] == "budget-fold" for i, b in enumerate(self.bones)) else []
        out += ["retained below what is gone"] if any(self.parent[i] >= 0 and self.state[self.parent[i]] in ("excluded", "deferred") for i in live) else []
        out += ["unresolved representative"] if any(s in ("collapsed", "deferred") and self.resolved(i) < 0 for i, s in enumerate(self.state)) else []
        out += ["unaccounted node"] if any(s not in ("retained", "collapsed", "deferred", "excluded") for s in self.state) else []
        out += ["size differs"] if len(html.encode()) != self.size() else []
        there = {self.attributes[i].get("id") for i in live}
        out += ["dangling relation"] if any(t not in there for i in live for k in RELATIONS & set(self.attributes[i]) for t in self.attributes[i][k].split()) else []
        out += ["password value"] if any(self.tag[i] == "input" and self.given[i].get("type") == "password" and "value" in self.attributes[i] for i in live) else []
        return out


def _base36(n: int) -> str:
    out = ""
    while True:
        n, r = divmod(n, 36)
        out = "0123456789abcdefghijklmnopqrstuvwxyz"[r] + out
        if not n:
            return out


_COLUMNS = ["doc_id", "node", "parent", "kind", "tag", "attributes", "text"]


def compact_html(nodes: DataFrame, budget: int, profile: str = "budget") -> DataFrame:
    """Per document the compact markup, whether it meets the budget (ready, or unrepresentable_under_budget), and broken promises."""

    def run(rows: list[dict]) -> list[dict]:
        c = Compactor(rows, budget, profile)
        html = c.run()
        size = len(html.encode())
        source = sum(len(t.encode()) if not e else 2 * len(g) + 5 + sum(len(k.encode()) + len(v.encode()) + 4 for k, v in a.items()) for t, e, g, a in zip((r["text"] or "" for r in rows), c.element, c.tag, c.given, strict=True))
        return [{
            "doc_id": rows[0]["doc_id"], "html": html, "n_bytes": size, "source_bytes": source, "status": "ready" if size <= budget else "unrepresentable_under_budget", "n_kept": sum(map(c.live, range(len(rows)))),
            "n_deferred": c.state.count("deferred"), "n_cut": c.cuts, "problems": c.problems(html),
        }]

    return per_document(nodes.select(*_COLUMNS), run, HTML)


def ledger(nodes: DataFrame, budget: int, profile: str = "budget") -> DataFrame:
    """A row for every source node: retained, collapsed, deferred or excluded, why, and the survivor that stands for it (null if none)."""

    def run(rows: list[dict]) -> list[dict]:
        c = Compactor(rows, budget, profile)
        c.run()
        out = []
        for i, r in enumerate(rows):
            s = c.resolved(i)
            out.append({"doc_id": r["doc_id"], "node": r["node"], "tag": r["tag"], "disposition": c.state[i], "representative": rows[s]["node"] if s >= 0 else None, "reason": c.reason[i] or None})
        return out

    return per_document(nodes.select(*_COLUMNS), run, LEDGER)


def downsampled(nodes: DataFrame, unwrap: bool = False) -> DataFrame:
    """nodes without scripts, styles, classes and handlers; with unwrap, a block whose only content is a block gives its place to it."""

    def run(rows: list[dict]) -> list[dict]:
        at = {r["node"]: i for i, r in enumerate(rows)}
        parent = [at.get(r["parent"], -1) for r in rows]
        gone = [False] * len(rows)
        kept = [[(k, v) for k, v in r["attributes"] or [] if k != "class" and not k.startswith("on")] for r in rows]
        for i, r in enumerate(rows):
            gone[i] = r["tag"] in ("script", "style") or (parent[i] >= 0 and gone[parent[i]])
        if unwrap:
            held: dict[int, list[int]] = {}
            for i, r in enumerate(rows):
                if not gone[i] and not (r["kind"] == "text" and not (r["text"] or "").strip()):
                    held.setdefault(parent[i], []).append(i)
            for i, r in enumerate(rows):
                own = held.get(i, [])
                if r["tag"] == "div" and not gone[i] and not kept[i] and len(own) == 1 and rows[own[0]]["tag"] == "div":
                    gone[i] = True
                    for c in (c for c in range(i + 1, len(rows)) if parent[c] == i):
                        parent[c] = parent[i]
        return [{"doc_id": r["doc_id"], "node": r["node"], "parent": rows[parent[i]]["node"] if parent[i] >= 0 else -1, "kind": r["kind"], "tag": r["tag"], "attributes": kept[i], "text": r["text"]} for i, r in enumerate(rows) if not gone[i]]

    return per_document(nodes.select(*_COLUMNS), run, "doc_id long, node int, parent int, kind string, tag string, attributes map<string,string>, text string")


def encode_patch(rows: list[dict]) -> tuple[list[dict], str]:
    """(lean rows, patch): drops classes, styles and handlers, cuts long texts; the patch gives all of it back."""
    lean, patch = [], []
    for r in rows:
        attributes = r["attributes"] or {}
        kept = {k: v for k, v in attributes.items() if k not in ("class", "style") and not k.startswith("on")}
        text = r["text"]
        cut = text[:BRIEF] if text is not None and len(text) > EXCERPT else text
        entry: dict = {}
        if list(kept.items()) != list(attributes.items()):
            entry["a"] = [[k, v] if k not in kept else [k] for k, v in attributes.items()]
        if cut != text:
            entry["t"] = text[BRIEF:]
        if entry:
            patch.append([r["node"], entry])
        lean.append({**r, "attributes": kept, "text": cut})
    return lean, json.dumps(patch, ensure_ascii=False, separators=(",", ":"))


def restore_patch(lean: list[dict], patch: str) -> list[dict]:
    by = {n: e for n, e in json.loads(patch)}
    out = []
    for r in lean:
        e = by.get(r["node"], {})
        attributes = {p[0]: p[1] if len(p) > 1 else r["attributes"][p[0]] for p in e["a"]} if "a" in e else r["attributes"]
        out.append({**r, "attributes": attributes, "text": (r["text"] or "") + e["t"] if "t" in e else r["text"]})
    return out


def recovery_report(nodes: DataFrame) -> DataFrame:
    """Per document: elements, bytes of the patch, and whether restoring gives back each node exactly."""

    def run(rows: list[dict]) -> list[dict]:
        own = [{"node": r["node"], "attributes": dict(r["attributes"] or []), "text": r["text"]} for r in rows]
        lean, patch = encode_patch(own)
        return [{"doc_id": rows[0]["doc_id"], "n_elements": sum(r["kind"] == "element" for r in rows), "patch_bytes": len(patch.encode()), "exact": restore_patch(lean, patch) == own}]

    return per_document(nodes.select(*_COLUMNS), run, "doc_id long, n_elements int, patch_bytes long, exact boolean")


def partition_regions(nodes: DataFrame, size: int) -> DataFrame:
    """(doc_id, node, region): each node in one region of at most size nodes.

    A subtree that fits stays whole; else its root stands alone and its children
    are looked at. Neighbours are packed in document order while they fit.
    """

    def run(rows: list[dict]) -> list[dict]:
        by_node = {r["node"]: i for i, r in enumerate(rows)}
        children: list[list[int]] = [[] for _ in rows]
        for i, r in enumerate(rows):
            if r["parent"] in by_node:
                children[by_node[r["parent"]]].append(i)
        region, used, out, stack = 0, 0, [], [0]
        while stack:
            i = stack.pop()
            n = rows[i]["end"] - rows[i]["pre"]
            if n > size:
                n = 1
                stack += reversed(children[i])
            if used and used + n > size:
                region, used = region + 1, 0
            used += n
            out += [{"doc_id": rows[0]["doc_id"], "node": rows[j]["node"], "region": region} for j in range(i, i + n)]
        return out

    return per_document(nodes.select("doc_id", "node", "parent", "pre", "end"), run, "doc_id long, node int, region int")


def region_context(regions: DataFrame, nodes: DataFrame, most: int = 32) -> DataFrame:
    """(doc_id, region, node): ancestors outside a region, at most so many by document order; omitted counts the others."""
    own = nodes.join(regions, ["doc_id", "node"])
    above = _open_around(own, nodes, False, True).join(regions, ["doc_id", "node"]).select("doc_id", "region", F.col("around").alias("node")).distinct().join(nodes.select("doc_id", "node", "pre"), ["doc_id", "node"])
    outside = above.join(regions, ["doc_id", "region", "node"], "left_anti")
    w = Window.partitionBy("doc_id", "region").orderBy("pre")
    ranked = outside.withColumns({"rn": F.row_number().over(w), "omitted": F.greatest(F.lit(0), F.count("*").over(Window.partitionBy("doc_id", "region")) - most)})
    return ranked.where(F.col("rn") <= most).select("doc_id", "region", "node", "omitted")


def option_sample(options: DataFrame, by: str, order: str, exception: str) -> DataFrame:
    """Adds kept: of seven or more options the first two, the last and the exceptions; all of fewer."""
    w = Window.partitionBy(by).orderBy(order)
    rn, n = F.row_number().over(w), F.count("*").over(Window.partitionBy(by))
    return options.withColumn("kept", (n < 7) | (rn <= 2) | (rn == n) | F.coalesce(F.col(exception), F.lit(False)))


def aliases(rows: DataFrame, by: str, order: str, prefix: str = "n") -> DataFrame:
    """Adds alias: the prefix and the place in order, from 0, in base 36. Places come from range partitions, so a group of any size is no task of its own."""
    at = ranked(rows, [by, order], "_r")
    first = at.groupBy(by).agg(F.min("_r").alias("_f"))
    j = at.join(first, by)
    return j.withColumn("alias", F.concat(F.lit(prefix), F.lower(F.conv((F.col("_r") - F.col("_f")).cast("string"), 10, 36)))).drop("_r", "_f")

"""Views of observed pages: what has to stay, what a budget may defer, gaps where something was left out, and an account of every node.

A page is one preorder list; all steps are loops over it, so depth costs no
stack. Observed rows stand document by document as the parsing pass left them,
and each page is compacted by itself.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections import deque
from collections.abc import Iterable
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.operators.observe import FORM_PARTS, LABELABLE, REFERENCES, observe
from treeline.operators.perdoc import per_document

#: Roles of controls, of parts that bound content, of what is never cut, and of what no region splits.
CONTROLS = "link button textField checkbox radio switch comboBox listBox tab slider spinButton treeItem menuItem".split()
PARTS = (
    "document paragraph heading group form list listItem table row cell rowHeader columnHeader definitionList term definition image figure caption code math dialog alert status navigation main banner "
    "contentInfo complementary search tabPanel tree grid gridCell menu frame"
).split()
COMPLETE = "heading rowHeader columnHeader caption code math alert status".split()
INDIVISIBLE = "paragraph heading listItem row cell gridCell option code math textField checkbox radio switch button link".split()
#: Relations whose targets are needed whole.
DEPENDENCIES = "labelledBy describedBy errorMessage details headers captionedBy".split()
#: Text of up to so many characters stays whole; longer text is cut to it, or to BRIEF under a budget.
SHORT, BRIEF = 360, 180
#: Changes that are tried on a page, views tried for regions, and regions.
EVALUATIONS, TRIALS, REGIONS = 256, 512, 64


def cut_at(text: str, units: int) -> int:
    """Characters of the text that are within so many units of UTF-16, never half of a pair."""
    if len(text) <= units and text.isascii():
        return len(text)
    used = 0
    for i, c in enumerate(text):
        used += 2 if ord(c) > 0xFFFF else 1
        if used > units:
            return i
    return len(text)


def _units(text: str) -> int:
    return len(text.encode("utf-16-le", "surrogatepass")) // 2


def _some(struct: dict | None) -> dict:
    return {k: v for k, v in (struct or {}).items() if v is not None}


class Page:
    """One observed page in preorder: places instead of node numbers, with children, ends and relations."""

    def __init__(self, rows: list[dict]):
        self.rows = rows
        at = {r["node"]: i for i, r in enumerate(rows)}
        n = len(rows)
        self.parent = [at.get(r["parent"], -1) for r in rows]
        self.children: list[list[int]] = [[] for _ in rows]
        for i, p in enumerate(self.parent):
            if p >= 0:
                self.children[p].append(i)
        self.end = [i + 1 for i in range(n)]
        for i in range(n - 1, 0, -1):
            if (p := self.parent[i]) >= 0:
                self.end[p] = max(self.end[p], self.end[i])
        self.roots = [i for i, p in enumerate(self.parent) if p < 0]
        self.role = [r["role"] for r in rows]
        self.text = [r["text"] if r["kind"] == "text" else None for r in rows]
        self.attributes = [dict(r["attributes"] or []) for r in rows]
        self.states = [_some(r["states"]) for r in rows]
        self.structure = [_some(r["structure"]) for r in rows]
        self.relations = self._related()
        self.related = set(self.relations) | {t for ts in self.relations.values() for _, t in ts}
        self.heading_before: dict[int, int] = {}
        for own in self.children:
            last = None
            for c in own:
                if last is not None:
                    self.heading_before[c] = last
                if self.role[c] == "heading":
                    last = c

    def subtree(self, i: int) -> range:
        return range(i, self.end[i])

    def blank(self, i: int) -> bool:
        return self.text[i] is not None and self.structure[i].get("textMode") == "normal" and not self.text[i].strip()

    def above(self, i: int) -> Iterable[int]:
        while (i := self.parent[i]) >= 0:
            yield i

    def _related(self) -> dict[int, list[tuple[str, int]]]:
        """(kind, target) of each place; ids that name no element or several make none."""
        ids: dict[str, list[int]] = {}
        for i, a in enumerate(self.attributes):
            if a.get("id"):
                ids.setdefault(a["id"], []).append(i)
        one = {k: v[0] for k, v in ids.items() if len(v) == 1}
        out: dict[int, list[tuple[str, int]]] = {}

        def add(i: int, kind: str, target: int | None) -> None:
            if target is not None:
                out.setdefault(i, []).append((kind, target))

        tag = [r["tag"] for r in self.rows]
        labelable = [t in LABELABLE and not (t == "input" and a.get("type", "").lower() == "hidden") for t, a in zip(tag, self.attributes, strict=True)]
        inner = {"fieldset": {"legend": "labelledBy"}, "table": {"caption": "captionedBy"}, "figure": {"figcaption": "captionedBy"}, "svg": {"title": "labelledBy", "desc": "describedBy"}}
        for i, a in enumerate(self.attributes):
            for name, kind in REFERENCES.items():
                for token in a.get(name, "").split():
                    add(i, kind, one.get(token))
            if tag[i] == "label":
                target = one.get(a["for"]) if "for" in a else next((j for j in self.subtree(i) if labelable[j]), None)
                if target is not None and labelable[target]:
                    add(i, "labelFor", target)
                    add(target, "labelledBy", i)
            for c in self.children[i] if tag[i] in inner else ():
                if tag[c] in inner[tag[i]]:
                    add(i, inner[tag[i]][tag[c]], c)
            if tag[i] in FORM_PARTS:
                add(i, "formOwner", one.get(a["form"]) if a.get("form") else next((p for p in self.above(i) if tag[p] == "form"), None))
            if tag[i] == "summary" and self.parent[i] >= 0 and tag[self.parent[i]] == "details":
                add(i, "controls", self.parent[i])
            if tag[i] == "a" and a.get("href", "").startswith("#"):
                add(i, "fragmentTarget", one.get(unquote(a["href"][1:])))
        return out


@dataclass
class Gap:
    owner: int
    field: str
    reason: str
    nodes: list[int] = field(default_factory=list)
    start: int = 0
    end: int = 0
    local: bool = True


class View:
    """A page, or the subtrees at some roots of it, under a profile: structure, excerpt or budget."""

    def __init__(self, page: Page, profile: str, max_bytes: int, roots: list[int] | None = None, required: Iterable[int] = (), focused: int | None = None):
        if profile not in ("structure", "excerpt", "budget"):
            raise ValueError(f"unknown profile {profile}")
        self.page, self.profile, self.max_bytes, self.focused = page, profile, max_bytes, focused
        n = len(page.rows)
        self.roots = self._outermost(page.roots if roots is None else roots)
        self.owned = bytearray(n)
        for r in self.roots:
            self.owned[r : page.end[r]] = b"\1" * (page.end[r] - r)
        self.visible, self.context, self.shell, self.full = bytearray(n), bytearray(n), bytearray(n), bytearray(n)
        self._options()
        self._admit(roots is not None, required)
        self._protect()
        self._surround()
        self._follow()
        self._connect()
        self._assemble()
        self._collapse()
        self.initial = self.size = self._measure()
        self.evaluations = self.accepted = 0
        if profile != "structure":
            self._reduce()

    def _outermost(self, roots: list[int]) -> list[int]:
        out: list[int] = []
        for r in sorted(set(roots)):
            if not out or r >= self.page.end[out[-1]]:
                out.append(r)
        return out

    def _options(self) -> None:
        """Options belong to the nearest native combo or list box around them."""
        page = self.page
        choosing = {i for i, rel in page.relations.items() for k, t in rel if k == "choices" for i in (i, t)}
        near: list[int] = []
        self.collections: dict[int, list[int]] = {}
        self.option_of: dict[int, int] = {}
        for i, p in enumerate(page.parent):
            own = near[p] if p >= 0 else -1
            if page.role[i] in ("comboBox", "listBox") and ("select" in (page.rows[i]["actions"] or []) or i in choosing):
                own = i
                self.collections[i] = []
            near.append(own)
            if own >= 0 and page.role[i] == "option":
                self.collections[own].append(i)
                self.option_of[i] = own
        self.in_option = bytearray(len(near))
        for i in self.option_of:
            self.in_option[i : page.end[i]] = b"\1" * (page.end[i] - i)

    def _whole(self, i: int) -> None:
        n = self.page.end[i] - i
        self.full[i : i + n] = self.shell[i : i + n] = b"\1" * n

    def _admit(self, scoped: bool, required: Iterable[int]) -> None:
        """What of the scope is visible: not what is dormant or inert, unless asked for by name; unknown exposure hides nothing."""
        page = self.page
        asleep = [bool((r["exposure"] or {}).get("dormant") or (r["exposure"] or {}).get("inert")) for r in page.rows]
        asked = bytearray(len(asleep))
        if scoped:
            for r in self.roots:
                if asleep[r]:
                    asked[r : page.end[r]] = b"\1" * (page.end[r] - r)
        for i, sleeps in enumerate(asleep):
            if self.owned[i] and (asked[i] or not sleeps):
                self.visible[i] = 1
        for i in required:
            for j in page.subtree(i):
                (self.visible if self.owned[j] else self.context)[j] = 1
            self._whole(i)
        if self.focused is not None and self.owned[self.focused]:
            self.visible[self.focused] = 1
            self._whole(self.focused)
        self.required = set(required)

    def _protect(self) -> None:
        """Nodes that stay (shell), and those whose text stays whole too (full)."""
        page = self.page
        in_form = bytearray(len(page.rows))
        for i, p in enumerate(page.parent):
            in_form[i] = p >= 0 and (page.role[p] == "form" or in_form[p])
        for i, seen in enumerate(self.visible):
            if not seen:
                continue
            role, states, structure, row, text = page.role[i], page.states[i], page.structure[i], page.rows[i], page.text[i]
            on = {k for k, v in states.items() if v != "false"}
            special = structure.get("textMode") == "verbatim" or structure.get("contentKind") in ("code", "math")
            if self.in_option[i]:
                if on & {"current", "invalid", "expanded", "selected", "disabled"} or structure.get("preserveScope") or special:
                    self._whole(i)
                continue
            if role in CONTROLS:
                if role in ("comboBox", "listBox"):
                    self.shell[i] = 1
                else:
                    self._whole(i)
            many = sum(not page.blank(c) for c in page.children[i]) > 1
            if role in PARTS or any(structure.get(k) for k in ("boundary", "preserveScope", "opaqueContent")) or many or states or any(row[k] for k in ("name", "description", "value", "actions", "hints")):
                self.shell[i] = 1
            if row["context"]["language"] or row["context"]["direction"]:
                self.shell[i] = 1
            if role in COMPLETE or special or on & {"selected", "current", "invalid", "expanded"}:
                self._whole(i)
            if text is not None and (_units(text) <= SHORT or structure.get("textMode") != "normal"):
                self.full[i] = 1
            if in_form[i] and role not in ("generic", "form", "group", "comboBox", "listBox"):
                self._whole(i)
            if role == "heading" and page.parent[i] >= 0:
                after = next((c for c in page.children[page.parent[i]] if c > i), None)
                if after is not None and page.role[after] == "paragraph":
                    self._whole(after)
        for box, own in self.collections.items():
            if self.visible[box]:
                self.shell[box] = 1
                for place, i in enumerate(own):
                    if place < 2 or i == own[-1] or page.states[i].get("selected") == "true" or page.states[i].get("disabled") == "true" or page.structure[i].get("preserveScope"):
                        self._whole(i)

    def _surround(self) -> None:
        """Ancestors of the scope and the headings before them tell where it stands."""
        page = self.page
        done: set[int] = set()
        for r in self.roots:
            below = r
            for p in page.above(r):
                if below in done:
                    break
                done.add(below)
                self.context[p] = self.shell[p] = 1
                heading = page.heading_before.get(below)
                if heading is not None:
                    for j in page.subtree(heading):
                        self.context[j] = 1
                    self._whole(heading)
                below = p

    def _follow(self) -> None:
        """Closure over relations: targets stay, those that name or describe something whole, and so do the paths to them."""
        page = self.page
        queue = deque(i for i in range(len(page.rows)) if self.visible[i] or self.context[i] or self.full[i])
        seen: set[int] = set()
        while queue:
            i = queue.popleft()
            if i in seen:
                continue
            seen.add(i)
            for kind, target in page.relations.get(i, ()):
                self.shell[i] = 1
                whole = kind in DEPENDENCIES or page.role[target] == "option"
                for j in page.subtree(target) if whole else (target,):
                    self.shell[j] = 1
                    if whole:
                        self.full[j] = 1
                    if not self.visible[j]:
                        self.context[j] = 1
                    queue.append(j)
                for p in page.above(target):
                    if not self.visible[p] and not self.context[p]:
                        self.context[p] = 1
                        queue.append(p)

    def _connect(self) -> None:
        page = self.page
        for i, whole in enumerate(self.full):
            if whole and not self.visible[i]:
                self.context[i] = 1
        for i in range(len(page.rows) - 1, -1, -1):  # paths to what stays: children come before parents here
            if (self.visible[i] or self.context[i]) and (p := page.parent[i]) >= 0 and not self.visible[p]:
                self.context[p] = 1
        for i, seen in enumerate(self.visible):
            if seen:
                self.context[i] = 0

    def _assemble(self) -> None:
        """Membership, children of the same membership in order, and a gap where an owned branch is left out."""
        page = self.page
        n = len(page.rows)
        self.gaps: list[Gap] = []
        self.disposition = ["retained" if self.visible[i] else "reference-only" if self.context[i] else "excluded" for i in range(n)]
        self.stands: list[int | None] = [i if d != "excluded" else None for i, d in enumerate(self.disposition)]
        self.gap_of: dict[int, int] = {}
        self.kids: list[list[tuple[str, int]]] = [[] for _ in range(n)]
        self.cut: dict[int, int] = {}
        for i in range(n):
            if self.disposition[i] == "excluded":
                continue
            for c in page.children[i]:
                if self.disposition[c] == self.disposition[i]:
                    self.kids[i].append(("node", c))
                elif self.disposition[i] == "retained" and self.disposition[c] == "excluded" and self.owned[c]:
                    gap = self._gap(Gap(i, "children", "dormant-or-inert", list(page.subtree(c))))
                    self.kids[i].append(("gap", gap))
                    for j in page.subtree(c):
                        self.gap_of.setdefault(j, gap)
            if page.structure[i].get("opaqueContent"):
                self._gap(Gap(i, "upstream", "capture-unavailable", local=False))
        for g in self.gaps:
            self.shell[g.owner] = 1

    def _gap(self, gap: Gap) -> int:
        self.gaps.append(gap)
        return len(self.gaps) - 1

    def _collapse(self) -> None:
        """Generic wrappers that say nothing and hold one thing at most give way to it, from below."""
        page = self.page
        stay = set(self.roots) | self.required | page.related
        for i in range(len(page.rows) - 1, 0, -1):
            if self.disposition[i] != "retained":
                continue
            self.kids[i] = [x for k in self.kids[i] for x in (self.kids[k[1]] if k[0] == "node" and self.disposition[k[1]] == "collapsed" else [k])]
            row, structure = page.rows[i], page.structure[i]
            if self.shell[i] or self.full[i] or i in stay or page.role[i] != "generic" or page.parent[i] < 0 or row["kind"] == "text":
                continue
            held = [k for k in self.kids[i] if k[0] == "gap" or not page.blank(k[1])]
            if len(held) > 1 or set(structure) - {"textMode"} or structure.get("textMode", "normal") != "normal" or _some(row["exposure"]):
                continue
            self.disposition[i] = "collapsed"
            inner = [k[1] for k in held if k[0] == "node"]
            self.stands[i] = inner[0] if inner else page.parent[i]
        for own in (0, *[i for i in range(len(page.rows)) if self.disposition[i] == "retained"]):  # wrappers below retained nodes that came before them
            self.kids[own] = [x for k in self.kids[own] for x in (self.kids[k[1]] if k[0] == "node" and self.disposition[k[1]] == "collapsed" else [k])]

    def line(self, i: int) -> str:
        """What a view says of one node."""
        page, row = self.page, self.page.rows[i]
        said: dict = {"id": row["node"], "role": page.role[i]}
        for key in ("name", "description"):
            if row[key]:
                said[key] = row[key]["text"]
        if row["hints"]:
            said["hints"] = [h["text"] for h in row["hints"]]
        for key, value in (("states", page.states[i]), ("value", _some(row["value"])), ("exposure", _some(row["exposure"])), ("structure", {k: v for k, v in page.structure[i].items() if (k, v) != ("textMode", "normal")})):
            if value:
                said[key] = value
        if row["actions"]:
            said["actions"] = row["actions"]
        if page.relations.get(i):
            said["relations"] = [[k, page.rows[t]["node"]] for k, t in page.relations[i]]
        if page.text[i] is not None:
            said["text"] = page.text[i][: self.cut[i]] if i in self.cut else page.text[i]
        if self.disposition[i] == "reference-only":
            said["membership"] = "context"
        return json.dumps(said, ensure_ascii=False, separators=(",", ":"))

    def gap_line(self, g: int) -> str:
        gap = self.gaps[g]
        said = {"gap": g, "owner": self.page.rows[gap.owner]["node"], "field": gap.field, "reason": gap.reason}
        if gap.nodes:
            said["omittedNodes"] = len(gap.nodes)
        if gap.end:
            said["omittedCharacters"] = gap.end - gap.start
        return json.dumps(said, separators=(",", ":"))

    def there(self, i: int) -> bool:
        return self.disposition[i] in ("retained", "reference-only")

    def _measure(self) -> int:
        self.bytes = [len(self.line(i).encode()) + 1 if self.there(i) else 0 for i in range(len(self.page.rows))]
        return sum(self.bytes) + sum(len(self.gap_line(g)) + 1 for g in range(len(self.gaps)))

    def _weight(self, i: int) -> int:
        page, f = self.page, self.focused
        if page.rows[i]["name"] or page.structure[i].get("boundary"):
            return 4
        if f is not None:
            up = lambda x: page.parent[x] if x is not None and x >= 0 else None
            if f in (i, up(i), up(up(i))) or i in (up(f), up(up(f))) or (up(i) is not None and up(i) == up(f)):
                return 2
        return 1

    def _free(self, i: int) -> bool:
        """Whether nothing of a subtree is protected or belongs to the context."""
        return not any(self.full[j] or self.shell[j] or self.disposition[j] == "reference-only" for j in self.page.subtree(i))

    def _saving(self, kind: str, i: int, roots: tuple[int, ...]) -> int:
        if kind == "text":
            return len(self.page.text[i].encode())
        return sum(self.bytes[j] for r in roots for j in self.page.subtree(r))

    def _candidates(self) -> list[tuple]:
        page, out = self.page, []
        limit = BRIEF if self.profile == "budget" else SHORT
        free = bytearray(len(page.rows))
        for i in range(len(page.rows) - 1, -1, -1):  # as _free(), from below
            free[i] = not (self.full[i] or self.shell[i] or self.disposition[i] == "reference-only") and all(free[c] for c in page.children[i])
        for i in range(len(page.rows)):
            if self.disposition[i] != "retained":
                continue
            if page.text[i] is not None and not self.full[i] and i not in self.cut and _units(page.text[i]) > limit:
                out.append(("text", i, ()))
            if self.profile == "budget" and page.children[i] and not self.full[i] and all(free[c] for c in page.children[i]):
                out.append(("children", i, tuple(page.children[i])))
            run: list[int] = []
            box = None
            for kind, c in [*self.kids[i], ("end", -1)]:
                own = self.option_of.get(c) if kind == "node" else None
                if own is None or not free[c] or own != box:
                    if run:
                        out.append(("choices", i, tuple(run)))
                    run, box = [], own
                if own is not None and free[c]:
                    run.append(c)
        return out

    def _reduce(self) -> None:
        """Takes the change that saves most, weighted, while changes are left: the budget profile stops when the view fits."""
        weight = {"text": self._weight, "children": self._weight, "choices": lambda i: 1}
        heap = [(-self._saving(k, i, rs) * weight[k](i), i, k, rs) for k, i, rs in self._candidates()]
        heapq.heapify(heap)
        while heap and self.evaluations < EVALUATIONS and not (self.profile == "budget" and self.size <= self.max_bytes):
            score, i, kind, roots = heapq.heappop(heap)
            if not self.there(i) or any(not self.there(r) and self.disposition[r] != "collapsed" for r in roots):
                continue
            if (now := -self._saving(kind, i, roots) * weight[kind](i)) != score:  # something below went already
                if now:
                    heapq.heappush(heap, (now, i, kind, roots))
                continue
            self.evaluations += 1
            if self._apply(kind, i, roots):
                self.accepted += 1

    def _apply(self, kind: str, i: int, roots: tuple[int, ...]) -> bool:
        """Makes the change if the view gets smaller by it."""
        page = self.page
        if kind == "text":
            at = cut_at(page.text[i], BRIEF if self.profile == "budget" else SHORT)
            g = self._gap(Gap(i, "text", "prose-excerpt", start=at, end=len(page.text[i])))
            self.cut[i] = at
            new = len(self.line(i).encode()) + 1
            change = self.bytes[i] - new - len(self.gap_line(g)) - 1
            if change <= 0:
                del self.cut[i]
                self.gaps.pop()
                return False
            self.bytes[i] = new
        else:
            ids = [j for r in roots for j in page.subtree(r)]
            g = self._gap(Gap(i, "children", "choice-preview" if kind == "choices" else "budget-fold", ids))
            change = sum(self.bytes[j] for j in ids) - len(self.gap_line(g)) - 1
            if change <= 0:
                self.gaps.pop()
                return False
            gone = set(ids)
            kept, placed = [], False
            for k in self.kids[i]:
                inside = k[1] in gone if k[0] == "node" else self.gaps[k[1]].owner in gone
                if not inside:
                    kept.append(k)
                elif not placed:
                    kept.append(("gap", g))
                    placed = True
            self.kids[i] = kept
            for j in ids:
                self.disposition[j], self.stands[j], self.bytes[j] = "deferred", None, 0
                self.gap_of[j] = g
        self.size -= change
        return True

    @property
    def fits(self) -> bool:
        return self.size <= self.max_bytes

    def order(self) -> list[tuple[str, int]]:
        """Nodes and gaps as the view tells them."""
        out = []
        tops = [i for i in range(len(self.page.rows)) if self.there(i) and (self.page.parent[i] < 0 or self.disposition[self._above(i)] != self.disposition[i])]
        stack = [("node", i) for i in reversed(tops)]
        while stack:
            k = stack.pop()
            out.append(k)
            if k[0] == "node":
                stack += reversed(self.kids[k[1]])
        return out

    def _above(self, i: int) -> int:
        i = self.page.parent[i]
        while self.disposition[i] == "collapsed" and self.page.parent[i] >= 0:
            i = self.page.parent[i]
        return i

    def encoded(self) -> str:
        told = {k[1] for k in self.order() if k[0] == "gap"}
        lines = [self.line(i) if kind == "node" else self.gap_line(i) for kind, i in self.order()]
        return "\n".join(lines + [self.gap_line(g) for g in range(len(self.gaps)) if g not in told]) + "\n"

    def representative(self, i: int) -> int | None:
        """The node of the view at the end of a chain of collapsed ones."""
        for _ in range(len(self.page.rows)):
            if i is None or self.disposition[i] != "collapsed":
                break
            i = self.stands[i]
        return i if i is not None and self.there(i) else None

    def problems(self) -> list[str]:
        """What the view breaks of its promises: none, if the engine is right."""
        page, out = self.page, []
        for i in range(len(page.rows)):
            if (self.full[i] or self.shell[i]) and not self.there(i):
                out.append(f"lost protected node {page.rows[i]['node']}")
            if self.full[i] and i in self.cut:
                out.append(f"cut protected text {page.rows[i]['node']}")
            if self.there(i):
                out += [f"lost target {page.rows[t]['node']}" for _, t in page.relations.get(i, ()) if not self.there(t)]
            if self.disposition[i] == "deferred" and i not in self.gaps[self.gap_of[i]].nodes[:1] and not (self.gaps[self.gap_of[i]].nodes[0] <= i <= self.gaps[self.gap_of[i]].nodes[-1]):
                out.append(f"deferred without gap {page.rows[i]['node']}")
        nodes = [i for kind, i in self.order() if kind == "node"]
        for member in ("retained", "reference-only"):
            if [i for i in nodes if self.disposition[i] == member] != [i for i, d in enumerate(self.disposition) if d == member]:
                out.append(f"changed order of {member} nodes")
        for g, gap in enumerate(self.gaps):
            if gap.field == "children" and any(self.there(j) or not gap.owner < j < page.end[gap.owner] for j in gap.nodes):
                out.append(f"gap {g} is not of omitted descendants")
            if gap.field == "text" and not 0 <= gap.start < gap.end == len(page.text[gap.owner]):
                out.append(f"gap {g} is no range of its text")
        return out


def plan(page: Page, profile: str, max_bytes: int) -> tuple[str, list[View], list[int]]:
    """(status, views, places that fit no region): scopes that do not fit are split at their children, neighbours that fit together are packed."""
    queue = deque([r] for r in page.roots)
    regions: list[View] = []
    unresolved: list[int] = []
    trials = 0
    while queue and len(regions) < REGIONS and trials < TRIALS:
        scope = queue.popleft()
        view = View(page, profile, max_bytes, scope)
        trials += 1
        if view.fits:
            while queue and trials < TRIALS and page.parent[queue[0][0]] == page.parent[scope[0]]:
                more = View(page, profile, max_bytes, [*scope, *queue[0]])
                trials += 1
                if not more.fits:
                    break
                scope, view = [*scope, *queue.popleft()], more
            regions.append(view)
            continue
        i = scope[0]
        whole = page.role[i] in INDIVISIBLE or page.text[i] or page.rows[i]["value"] or page.structure[i].get("opaqueContent") or page.structure[i].get("contentKind") in ("code", "math")
        if page.children[i] and not whole:
            queue.extendleft([c] for c in reversed(page.children[i]))
        else:
            unresolved.append(i)
    return "unrepresentable_under_budget" if unresolved else "limit_reached" if queue else "planned", regions, unresolved + [s[0] for s in queue]


def observed(nodes: DataFrame) -> DataFrame:
    """Nodes with what views need of them."""
    return observe(nodes).select(
        "doc_id", "node", "parent", "kind", "tag", "attributes", "text", "role", "name", "description", "hints", "structure", "states", "value", "actions", "exposure", F.struct("context.language", "context.direction").alias("context")
    )


VIEWS = "doc_id long, view string, n_bytes long, initial_bytes long, status string, n_nodes int, n_view int, n_gaps int, evaluations int, accepted int, result_hash string, problems array<string>"


def view_row(view: View, doc: int, planned: str | None = None) -> dict:
    text = view.encoded()
    return {
        "doc_id": doc, "view": text, "n_bytes": len(text.encode()), "initial_bytes": view.initial, "status": "ready" if view.fits else planned or "requires_partition", "n_nodes": len(view.page.rows),
        "n_view": sum(map(view.there, range(len(view.page.rows)))), "n_gaps": len(view.gaps), "evaluations": view.evaluations, "accepted": view.accepted,
        "result_hash": hashlib.sha256(text.encode()).hexdigest(), "problems": view.problems(),
    }


def views(nodes: DataFrame, profile: str, max_bytes: int) -> DataFrame:
    """A row for each page: its view as JSON lines, sizes, status (ready, requires_partition, unrepresentable_under_budget) and broken promises."""

    def run(rows: list[dict]) -> list[dict]:
        page = Page(rows)
        view = View(page, profile, max_bytes)
        status = None
        if not view.fits and plan(page, profile, max_bytes)[0] == "unrepresentable_under_budget":
            status = "unrepresentable_under_budget"
        return [view_row(view, rows[0]["doc_id"], status)]

    return per_document(observed(nodes), run, VIEWS)


def view_ledger(nodes: DataFrame, profile: str, max_bytes: int) -> DataFrame:
    """A row for each observed node: what became of it, the node of the view that stands for it or the gap that holds it."""

    def run(rows: list[dict]) -> list[dict]:
        view = View(Page(rows), profile, max_bytes)
        out = []
        for i, r in enumerate(rows):
            stands = view.representative(i)
            out.append({"doc_id": r["doc_id"], "node": r["node"], "disposition": view.disposition[i], "representative": None if stands is None else rows[stands]["node"], "gap": view.gap_of.get(i)})
        return out

    return per_document(observed(nodes), run, "doc_id long, node int, disposition string, representative int, gap int")


def view_gaps(nodes: DataFrame, profile: str, max_bytes: int) -> DataFrame:
    """A row for each gap: where it is, why, and how much it holds."""

    def run(rows: list[dict]) -> list[dict]:
        view = View(Page(rows), profile, max_bytes)
        return [
            {"doc_id": rows[0]["doc_id"], "gap": g, "owner": rows[x.owner]["node"], "field": x.field, "reason": x.reason, "omitted_nodes": len(x.nodes), "start": x.start, "end": x.end, "local": x.local}
            for g, x in enumerate(view.gaps)
        ]

    return per_document(observed(nodes), run, "doc_id long, gap int, owner int, field string, reason string, omitted_nodes int, start int, end int, local boolean")


def view_regions(nodes: DataFrame, profile: str, max_bytes: int) -> DataFrame:
    """A row for each node of each region of a page, with its membership, and rows without region for scopes that fit none."""

    def run(rows: list[dict]) -> list[dict]:
        page = Page(rows)
        status, regions, left = plan(page, profile, max_bytes)
        doc = rows[0]["doc_id"]
        out = [
            {"doc_id": doc, "region": k, "node": rows[i]["node"], "membership": "owned" if v.disposition[i] == "retained" else "context", "n_bytes": v.size, "status": status}
            for k, v in enumerate(regions) for i in range(len(rows)) if v.there(i)
        ]
        return out + [{"doc_id": doc, "region": None, "node": rows[i]["node"], "membership": "unplanned", "n_bytes": None, "status": status} for i in left]

    return per_document(observed(nodes), run, "doc_id long, region int, node int, membership string, n_bytes long, status string")


def region_coverage(regions: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, source_nodes, owned_nodes, context_only_nodes, unrepresented_nodes) over a page's regions."""
    seen = regions.where("region is not null").groupBy("doc_id", "node").agg(F.max(F.col("membership") == "owned").alias("owned"))
    j = nodes.select("doc_id", "node").join(seen, ["doc_id", "node"], "left")
    return j.groupBy("doc_id").agg(
        F.count("*").alias("source_nodes"), F.count_if("owned").alias("owned_nodes"), F.count_if(~F.col("owned")).alias("context_only_nodes"), F.count_if(F.col("owned").isNull()).alias("unrepresented_nodes")
    )


def expanded_views(nodes: DataFrame, profile: str, max_bytes: int, gaps: list[int]) -> DataFrame:
    """views() again with what the named local gaps hold pinned; a gap that a page does not have, or that nothing can fill, is an error row."""

    def run(rows: list[dict]) -> list[dict]:
        page = Page(rows)
        before = View(page, profile, max_bytes)
        wrong = [g for g in gaps if not (0 <= g < len(before.gaps) and before.gaps[g].local)]
        if wrong:
            return [{**view_row(before, rows[0]["doc_id"]), "status": "unknown or unavailable gap"}]
        pinned = {j for g in gaps for j in (before.gaps[g].nodes or [before.gaps[g].owner])}
        return [view_row(View(page, profile, max_bytes, required=sorted(pinned)), rows[0]["doc_id"])]

    return per_document(observed(nodes), run, VIEWS)


#: Roles of blocks, between which white space says nothing.
BLOCKS = "document paragraph heading group form list listItem table row definitionList figure code math dialog navigation main banner contentInfo complementary search".split()
NAVIGATION = "doc_id long, node int, parent int, place int, role string, name string, text string, assignable boolean, language string, language_reset boolean"


def navigation(nodes: DataFrame, profile: str, max_bytes: int) -> DataFrame:
    """What a reader moves through: nodes of each view without hidden ones and blanks between blocks.

    What relations name stays as context though hidden, with all below it, and is
    never assignable. Language stands where it changes; language_reset marks nodes
    that leave their parent's language without one of their own.
    """

    def run(rows: list[dict]) -> list[dict]:
        page = Page(rows)
        view = View(page, profile, max_bytes)
        n = len(rows)
        there = [i for i in range(n) if view.there(i)]
        up: dict[int, int] = {}
        for i in there:
            for kind, c in view.kids[i]:
                if kind == "node":
                    up[c] = i
        hidden = bytearray(n)
        for i in there:
            said = rows[i]["exposure"] or {}
            hidden[i] = said.get("rendered") is False or said.get("accessibilityIncluded") is False or bool(i in up and hidden[up[i]])
        blank = bytearray(n)
        loose = set(page.related) | {g.owner for g in view.gaps}
        for i in there:
            kids = view.kids[i]
            if page.role[i] not in BLOCKS:
                continue
            spaces = [kind == "node" and page.blank(c) and c not in loose for kind, c in kids]
            block = [kind == "node" and page.role[c] in BLOCKS for kind, c in kids]
            before = None
            for k, (_, c) in enumerate(kids):
                if not spaces[k]:
                    before = k
                    continue
                after = next((m for m in range(k + 1, len(kids)) if not spaces[m]), None)
                if (before is None or block[before]) and (after is None or block[after]):
                    blank[c] = 1
        kept = bytearray(n)
        queue = deque(i for i in there if not hidden[i] and not blank[i])
        for i in queue:
            kept[i] = 1
        while queue:
            i = queue.popleft()
            more = [t for _, t in page.relations.get(i, ())] + [c for kind, c in view.kids[i] if kind == "node" and (hidden[i] or i in page.related)]
            for j in more:
                if not kept[j] and view.there(j):
                    kept[j] = 1
                    queue.append(j)
        out = []
        places: dict[int, int] = {}
        for i in there:
            if not kept[i]:
                continue
            p = up.get(i, -1)
            while p >= 0 and not kept[p]:
                p = up.get(p, -1)
            places[p] = places.get(p, -1) + 1
            own = rows[i]["context"]["language"]
            around = rows[p]["context"]["language"] if p >= 0 else None
            text = page.text[i]
            out.append({
                "doc_id": rows[i]["doc_id"], "node": rows[i]["node"], "parent": rows[p]["node"] if p >= 0 else None, "place": places[p], "role": page.role[i], "name": (rows[i]["name"] or {}).get("text"),
                "text": None if text is None else " " if page.blank(i) else text[: view.cut.get(i, len(text))], "assignable": view.disposition[i] == "retained" and not hidden[i],
                "language": own if own != around else None, "language_reset": around is not None and own is None,
            })
        return out

    return per_document(observed(nodes), run, NAVIGATION)

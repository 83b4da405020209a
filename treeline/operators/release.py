"""What may leave: secrets and private text, safe URLs, allow-listed projections, and checks of what is published."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeline.functions.text import OMITTED, SECRETS, safe_text, safe_url

#: Attributes that are published, tags without content, and tags whose content a user gave.
SAFE_ATTRIBUTES = [
    "id", "role", "alt", "title", "type", "tabindex", "for", "disabled", "aria-label", "aria-labelledby", "aria-describedby", "aria-controls", "aria-hidden", "aria-expanded", "aria-disabled", "aria-modal",
    "aria-live", "aria-orientation", "aria-level", "aria-posinset", "aria-setsize", "aria-haspopup", "aria-required", "aria-readonly", "href",
]
INERT = ["script", "style", "noscript", "template", "iframe", "object", "embed"]
FORM = ["input", "textarea", "select", "option"]
#: File names that stay where they are, and the size from which a file wants a second look.
LOCAL_NAMES = r"(?i)(^|/)(\.env(?!\.example$)[^/]*|token\.json|benchmark-headers\.json|application_default_credentials\.json|credentials[^/]*|[^/]*\.(pem|key|p12|pfx|pyc))$"
LOCAL_FOLDERS = r"(^|/)(__pycache__|node_modules|\.venv|\.mypy_cache|\.ruff_cache)/"
LARGE = 5 * 1024 * 1024


def secret_findings(files: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """(path, line, type) of what must not be published: kinds and places only, never what was found."""
    text, path = F.col(text_col), F.col(path_col)
    lines = files.select(path.alias("path"), F.posexplode(F.split(text, "\n")).alias("at", "line"))
    kinds = F.array(*(F.struct(F.lit(k).alias("type"), F.regexp_count("line", F.lit(p)).alias("n")) for k, p in SECRETS.items()))
    found = lines.select("path", (F.col("at") + 1).alias("line"), F.explode(F.filter(kinds, lambda x: x["n"] > 0)).alias("k"))
    found = found.select("path", "line", F.explode(F.array_repeat("k.type", F.col("k.n"))).alias("type"))
    of_file = F.array_compact(F.array(F.when(path.rlike(LOCAL_NAMES) | path.rlike(LOCAL_FOLDERS), "local-only file"), F.when(F.octet_length(text) > LARGE, "file exceeds 5 MiB")))
    return files.select(path.alias("path"), F.lit(0).alias("line"), F.explode(of_file).alias("type")).unionByName(found)


def published_nodes(nodes: DataFrame, hosts: list[str]) -> DataFrame:
    """Nodes with allow-listed attributes and safe text: inert and form content is blanked, unsafe values go."""
    blocked = F.col("tag").isin([*INERT, *FORM])
    allowed = F.map_filter("attributes", lambda k, v: k.isin(SAFE_ATTRIBUTES))
    cleaned = F.transform_values(allowed, lambda k, v: F.when(k == "href", safe_url(v, hosts)).otherwise(safe_text(v, hosts)))
    return nodes.withColumns({"attributes": F.map_filter(cleaned, lambda k, v: v.isNotNull() & (v != "") & (v != OMITTED)), "text": F.when(blocked, F.lit("")).otherwise(safe_text(F.coalesce("text", F.lit("")), hosts))})


def publication_findings(nodes: DataFrame, hosts: list[str]) -> DataFrame:
    """(doc_id, node, finding) of nodes that are not as published_nodes() leaves them; publishing twice changes nothing, so there is none of those."""
    a = F.col("attributes")
    checks = {
        "attribute that is not published": F.exists(F.map_keys(a), lambda k: ~k.isin(SAFE_ATTRIBUTES)),
        "inert or form content": F.col("tag").isin([*INERT, *FORM]) & (F.coalesce("text", F.lit("")) != ""),
        "unsafe text": safe_text(F.coalesce("text", F.lit("")), hosts) != F.coalesce("text", F.lit("")),
        "unsafe attribute": F.exists(F.map_entries(a), lambda e: (e["key"] != "href") & (safe_text(e["value"], hosts) != e["value"])),
        "unsafe URL": F.coalesce(safe_url(a["href"], hosts) != a["href"], F.lit(False)),
    }
    return nodes.select("doc_id", "node", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(m)) for m, c in checks.items())))).alias("finding"))


def unsafe_strings(table: DataFrame, hosts: list[str]) -> Column:
    """Whether any string of a row, in arrays and structs too, is not safe text."""

    def walk(c: Column, kind) -> list[Column]:  # noqa: ANN001
        name = kind.typeName()
        if name == "string":
            return [F.coalesce(safe_text(c, hosts) != c, F.lit(False))]
        if name == "struct":
            return [x for f in kind.fields for x in walk(c[f.name], f.dataType)]
        if name == "array":
            inner = lambda x: reduce(lambda p, q: p | q, walk(x, kind.elementType), F.lit(False))
            return [F.coalesce(F.exists(c, inner), F.lit(False))]
        return []

    return reduce(lambda p, q: p | q, (x for f in table.schema.fields for x in walk(F.col(f.name), f.dataType)), F.lit(False))


def student_input(html: Column, attribute: Column, partial: Column, observation: Column, refs: Column, most: int = 32_768) -> Column:
    """What a student sees, as JSON: the source, the attribute of references, whether the capture is partial, the observation, and the references unless their list is longer than most."""
    listed = F.to_json(refs)
    plain = F.struct(observation.alias("browser_observation"), partial.alias("capture_partial"), attribute.alias("reference_attribute"), html.alias("source_html"))
    whole = F.struct(refs.alias("assignable_refs"), observation.alias("browser_observation"), partial.alias("capture_partial"), attribute.alias("reference_attribute"), html.alias("source_html"))
    return F.when(F.length(listed) <= most, F.to_json(whole)).otherwise(F.to_json(plain))


def assignable(refs: Column, allowed: Column) -> Column:
    return F.array_sort(F.array_intersect(refs, allowed))


def same_origin(a: Column, b: Column) -> Column:
    """Whether two URLs have the same scheme and authority."""

    def origin(u: Column) -> Column:
        return F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1))

    return (origin(a) != "") & (origin(a) == origin(b))


@F.pandas_udf(T.StringType())
def image_problem(data: pd.Series) -> pd.Series:
    """What is wrong with the segments of a JPEG: not one, a bad marker or length, metadata, or no image; null if nothing is."""

    def one(b: bytes | None) -> str | None:
        if not b or not b.startswith(b"\xff\xd8"):
            return "no JPEG"
        at = 2
        while at + 4 <= len(b):
            if b[at] != 255:
                return "invalid marker"
            if b[at + 1] == 0xDA:
                return None
            if b[at + 1] in (0xE1, 0xED, 0xFE):
                return "metadata or comment"
            n = int.from_bytes(b[at + 2 : at + 4], "big")
            if n < 2 or at + 2 + n > len(b):
                return "invalid segment"
            at += 2 + n
        return "no image data"

    return data.map(one)


def clipped(rects: DataFrame, width: Column, height: Column) -> DataFrame:
    """rects (x, y, w, h) cut to a view of that size, as percentages of it, the largest first by draw; those outside go."""
    left, top = F.greatest(F.lit(0.0), F.col("x")), F.greatest(F.lit(0.0), F.col("y"))
    right, bottom = F.least(width, F.col("x") + F.col("w")), F.least(height, F.col("y") + F.col("h"))
    cut = rects.withColumns({"left": left, "top": top, "right": right, "bottom": bottom}).where("right > left and bottom > top")
    out = cut.withColumns({
        "left_pct": F.col("left") / width * 100, "top_pct": F.col("top") / height * 100, "width_pct": (F.col("right") - F.col("left")) / width * 100, "height_pct": (F.col("bottom") - F.col("top")) / height * 100,
    })
    from pyspark.sql.window import Window

    area = F.col("width_pct") * F.col("height_pct")
    return out.withColumn("draw", F.row_number().over(Window.partitionBy("doc_id").orderBy(area.desc(), "node"))).drop("left", "top", "right", "bottom")

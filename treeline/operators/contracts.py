"""Contracts on outlines, judgments and packets: each operator returns findings as rows or columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treeline.operators.perdoc import by_document


def outline_findings(lines: DataFrame, valid: DataFrame | None = None) -> DataFrame:
    """(doc_id, line, level, finding) for outline lines (doc_id, line, depth, label, refs).

    Errors: a first line deeper than 0, a root with refs, a jump of depth, a second root, a blank or
    long label, a repeated ref within a line, an unknown ref, a group (no refs)
    whose next line is not one deeper, a unit (with refs) that has children.
    Warning: a ref that an earlier line used.
    """
    w = Window.partitionBy("doc_id").orderBy("line")
    x = lines.withColumns({"last": F.lag("depth").over(w), "next": F.lead("depth").over(w), "n": F.size("refs")})
    checks = {
        "first line is not at depth 0": F.col("last").isNull() & (F.col("depth") != 0),
        "root has refs": F.col("last").isNull() & (F.col("n") > 0),
        "depth jumps": F.col("depth") > F.col("last") + 1,
        "second root": F.col("last").isNotNull() & (F.col("depth") == 0),
        "label is blank or over 100": (F.trim("label") == "") | (F.length("label") > 100),
        "repeated ref in line": F.size(F.array_distinct("refs")) < F.col("n"),
        "group without children": (F.col("n") == 0) & (F.coalesce(F.col("next"), F.lit(-1)) != F.col("depth") + 1),
        "unit with children": (F.col("n") > 0) & (F.coalesce(F.col("next"), F.lit(-1)) > F.col("depth")),
    }
    found = x.select("doc_id", "line", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(m)) for m, c in checks.items())))).alias("finding"))
    out = found.select("doc_id", "line", F.lit("error").alias("level"), "finding")
    used = lines.select("doc_id", "line", F.explode(F.array_distinct("refs")).alias("ref"))
    first = used.withColumn("first", F.first("line").over(Window.partitionBy("doc_id", "ref").orderBy("line"))).where("line > first")
    out = out.unionByName(first.select("doc_id", "line", F.lit("warning").alias("level"), F.concat(F.lit("ref of line "), F.col("first").cast("string")).alias("finding")))
    if valid is not None:
        bad = used.join(valid, ["doc_id", "ref"], "left_anti")
        out = out.unionByName(bad.select("doc_id", "line", F.lit("error").alias("level"), F.concat(F.lit("unknown ref "), F.col("ref").cast("string")).alias("finding")))
    return out


def outline_parents(lines: DataFrame, deepest: int = 64) -> DataFrame:
    """lines with parent: the last earlier line that is less deep.

    A running array holds the last line of each depth, up to deepest levels; deeper lines have the last line of that level or above.
    """
    w = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    last = F.array(*(F.max(F.when(F.least(F.col("depth"), F.lit(deepest)) == d, F.col("line"))).over(w) for d in range(deepest + 1)))
    seen = lines.withColumn("_last", last)
    return seen.withColumn("parent", F.when(F.col("depth") > 0, F.array_max(F.slice("_last", F.lit(1), F.least(F.col("depth"), F.lit(deepest)).cast("int"))))).drop("_last")


def outline_tree(lines: DataFrame) -> DataFrame:
    """lines with parent and place among siblings, and refs of their own or, for a group, the first ref of each child."""
    own = outline_parents(lines)
    w = Window.partitionBy("doc_id", "parent").orderBy("line")
    firsts = own.where(F.size("refs") > 0).select("doc_id", F.col("parent").alias("_p"), F.struct("line", F.col("refs")[0].alias("ref")).alias("_r"))
    firsts = firsts.groupBy("doc_id", F.col("_p").alias("line")).agg(F.transform(F.sort_array(F.collect_list("_r")), lambda x: x["ref"]).alias("child_refs"))
    j = own.withColumn("place", F.row_number().over(w)).join(firsts, ["doc_id", "line"], "left")
    return j.withColumn("source_refs", F.when(F.size("refs") > 0, F.col("refs")).otherwise(F.coalesce("child_refs", F.array().cast("array<string>")))).drop("child_refs")


def outline_report(lines: DataFrame) -> DataFrame:
    refs = lines.select("doc_id", F.explode("refs").alias("ref")).groupBy("doc_id").agg(F.countDistinct("ref").alias("refs"))
    by = lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(F.size("refs") == 0).alias("groups"), F.count_if(F.size("refs") > 0).alias("units"), F.max("depth").alias("max_depth"))
    return by.join(refs, "doc_id", "left").fillna(0, ["refs"])


def parse_outline(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line, depth, label, refs) of Markdown lists: two blanks a level, refs in brackets behind the label."""
    lines = texts.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n")).alias("at", "raw")).where(F.col("raw").rlike(r"^ *[-*] "))
    refs = F.filter(F.split(F.regexp_extract("raw", r"\[([^\]]*)\]\s*$", 1), r"[,\s]+"), lambda r: r != "")
    label = F.trim(F.regexp_replace(F.regexp_replace("raw", r"^ *[-*] ", ""), r"\[[^\]]*\]\s*$", ""))
    depth = F.floor(F.length(F.regexp_extract("raw", "^( *)", 1)) / 2).cast("int")
    return lines.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("at")).alias("line"), depth.alias("depth"), label.alias("label"), refs.alias("refs"))


def render_outline(lines: DataFrame) -> DataFrame:
    """(doc_id, text): the Markdown list of outline lines."""
    line = F.concat(F.expr("repeat('  ', depth)"), F.lit("- "), F.col("label"), F.when(F.size("refs") > 0, F.concat(F.lit(" ["), F.array_join("refs", ", "), F.lit("]"))).otherwise(""))
    rows = F.sort_array(F.collect_list(F.struct("line", line.alias("t"))))
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda r: r["t"]), "\n").alias("text"))


def teacher_decision(errors: Column, hard: Column, enough: Column, scores: list[Column]) -> Column:
    """reject before insufficient_evidence before accept (all scores two or more) before revise."""
    low = F.least(*scores)
    known = F.lit(True)
    for s in scores:
        known = known & s.isNotNull()
    return F.when(errors | hard, "reject").when(~enough | ~known, "insufficient_evidence").when(low >= 2, "accept").otherwise("revise")


def hierarchy_decision(gate_failed: Column, complete: Column, scores: list[Column], continuity: Column, continuity_required: Column) -> Column:
    """A failed gate rejects, then missing judgments leave it open, then a score of one or less asks for revision; continuity counts only if required."""
    needed = F.lit(True)
    for s in scores:
        needed = needed & s.isNotNull()
    needed = needed & (~continuity_required | continuity.isNotNull())
    low = F.least(*scores) if len(scores) > 1 else scores[0]
    poor = (low <= 1) | (continuity_required & (continuity <= 1))
    return F.when(gate_failed, "reject").when(~complete | ~needed, "insufficient_evidence").when(poor, "revise").otherwise("usable")


def preference_pairs(scored: DataFrame, keys: list[str], candidate: str, criteria: list[str], margin: int = 2, content: str | None = None) -> DataFrame:
    """(keys, chosen, rejected, margin): pairs in which one candidate is nowhere worse and ahead by the margin in sum; candidates of one content make none."""
    a, b = scored.alias("a"), scored.alias("b")
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    worse, lead = F.lit(True), F.lit(0)
    for c in criteria:
        worse = worse & (F.col(f"a.{c}") >= F.col(f"b.{c}"))
        lead = lead + F.col(f"a.{c}") - F.col(f"b.{c}")
    other = F.col(f"a.{candidate}") != F.col(f"b.{candidate}")
    if content:
        other = other & ~F.col(f"a.{content}").eqNullSafe(F.col(f"b.{content}"))
    pairs = a.join(b, same & other & worse & (lead >= margin))
    return pairs.select(*(F.col(f"a.{k}").alias(k) for k in keys), F.col(f"a.{candidate}").alias("chosen"), F.col(f"b.{candidate}").alias("rejected"), lead.alias("margin"))


def calibration(reviews: DataFrame, predicted: Column, actual: Column, page: str, domain: str) -> DataFrame:
    """One row: counts, agreement, and the share of rejected cases that were accepted."""
    false_accept = predicted & ~actual
    return reviews.agg(
        F.count("*").alias("n"), F.countDistinct(page).alias("pages"), F.countDistinct(domain).alias("domains"), F.count_if(actual).alias("accepts"), F.count_if(~actual).alias("rejects"),
        F.avg((predicted == actual).cast("double")).alias("agreement"), (F.count_if(false_accept) / F.greatest(F.count_if(~actual), F.lit(1))).alias("false_accept_rate"),
    )


def calibrated(metrics: DataFrame) -> DataFrame:
    """Adds calibrated: enough cases, pages and domains on both sides, and good enough."""
    return metrics.withColumn("calibrated", F.expr("n >= 20 and pages >= 10 and domains >= 3 and accepts >= 5 and rejects >= 5 and agreement >= 0.8 and false_accept_rate <= 0.1"))


def reward(scores: list[Column], split: Column, is_calibrated: Column) -> Column:
    """The least score over 3; null outside training and without calibration."""
    return F.when((split == "train") & is_calibrated, F.least(*scores) / 3.0)


def strict_verdict(status: Column, score: Column, components: Column) -> Column:
    """success only with a score of one and components that all pass; unavailable is no failure."""
    passed = (F.size(components) > 0) & F.forall(components, lambda c: c)
    return F.when(status.isin("error", "unavailable", "not_run") | score.isNull(), "unavailable").when((score == 1.0) & F.coalesce(passed, F.lit(False)), "success").otherwise("failure")


def judgment_errors(rows: DataFrame) -> DataFrame:
    """reasons for criteria rows (status, score, evidence, hard_error): status and score agree, scores are 0 to 3, evidence stands, 0 exactly for hard errors."""
    judged = F.col("status") == "judged"
    return rows.withColumn("reasons", F.array_compact(F.array(
        F.when(judged & F.col("score").isNull(), "judged without score"), F.when(~judged & F.col("score").isNotNull(), "score without judgment"),
        F.when((F.col("score") < 0) | (F.col("score") > 3), "score out of range"), F.when(judged & (F.size("evidence") == 0), "no evidence"),
        F.when(judged & ((F.col("score") == 0) != F.col("hard_error")), "zero without hard error or the other way"),
    )))


def preflight(nodes: DataFrame, roots: DataFrame, required: DataFrame, inventory: DataFrame | None = None) -> DataFrame:
    """(packet, check, status) for candidate graphs: nodes (packet, id, kind, children, refs), roots (packet, root), required (packet, id).

    With an inventory (packet, id, complete) refs are checked too: an unknown one
    fails if the inventory is complete for its scope, and cannot be assessed if
    not. Required ids that nothing refers to cannot be assessed either.
    """
    edges = nodes.select("packet", F.col("id").alias("parent"), F.explode("children").alias("child"))
    ids = nodes.select("packet", "id")
    refs = nodes.select("packet", F.explode("refs").alias("id")).distinct()

    def walk(rows: list[dict]) -> list[dict]:
        children = {r["id"]: r["children"] or [] for r in rows if r["id"] is not None}
        root = next((r["root"] for r in rows if r["root"] is not None), None)
        depth, done, cycle = set(), set(), False
        stack = [(root, False)] if root in children else []
        while stack:
            i, leave = stack.pop()
            if leave:
                depth.discard(i)
                done.add(i)
            elif i in depth:
                cycle = True
            elif i not in done and i in children:
                depth.add(i)
                stack.append((i, True))
                stack += [(c, False) for c in children[i]]
        return [{"packet": rows[0]["packet"], "cycle": cycle, "loose": bool(set(children) - done)}]

    kind = nodes.schema["packet"].dataType.simpleString()
    whole = nodes.select("packet", "id", "children", F.lit(None).cast("string").alias("root")).unionByName(roots.select("packet", F.lit(None).cast("string").alias("id"), F.lit(None).cast("array<string>").alias("children"), "root"))
    shape = by_document(whole, walk, f"packet {kind}, cycle boolean, loose boolean", order="id", key="packet")
    checks = {
        "duplicate ids": nodes.groupBy("packet", "id").count().where("count > 1"),
        "missing child": edges.join(ids, (edges.packet == ids.packet) & (edges.child == ids.id), "left_anti"),
        "dom leaf with children": nodes.where("kind = 'dom' and (size(children) > 0 or size(refs) <> 1)"),
        "several parents": edges.groupBy("packet", "child").count().where("count > 1"),
        "missing root": roots.join(ids, (roots.packet == ids.packet) & (roots.root == ids.id), "left_anti"),
        "cycle": shape.where("cycle"), "unreachable node": shape.where("loose"),
    }
    packets = roots.select("packet").distinct()

    def statuses(name: str, bad: DataFrame, status: Column) -> DataFrame:
        found = bad.groupBy("packet").agg(F.max(status).alias("bad"))
        return packets.join(found, "packet", "left").select("packet", F.lit(name).alias("check"), F.coalesce("bad", F.lit("pass")).alias("status"))

    out = [statuses(n, bad, F.lit("fail")) for n, bad in checks.items()]
    out.append(statuses("required ref missing", required.join(refs, ["packet", "id"], "left_anti"), F.lit("not_assessable")))
    if inventory is not None:
        complete = inventory.groupBy("packet").agg(F.bool_and("complete").alias("complete"))
        unknown = refs.join(inventory, ["packet", "id"], "left_anti").join(complete, "packet", "left")
        out.append(statuses("unresolved ref", unknown, F.when(F.col("complete"), "fail").otherwise("not_assessable")))
    return reduce(DataFrame.unionByName, out)

"""Summaries of runs, captures and outlines, and small relational rules around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treeline.operators.perdoc import by_document


def compaction_summary(results: DataFrame) -> DataFrame:
    """Per profile over results (profile, ok, source_bytes, n_bytes, source_nodes, n_nodes): attempts, passed, sums and median ratios of what passed."""
    ok = F.col("ok")
    return results.groupBy("profile").agg(
        F.count("*").alias("attempts"), F.count_if(ok).alias("passed"), *(F.sum(F.when(ok, F.col(c))).alias(c) for c in ("source_bytes", "n_bytes", "source_nodes", "n_nodes")),
        F.median(F.when(ok, F.expr("try_divide(n_bytes, source_bytes)"))).alias("median_byte_ratio"), F.median(F.when(ok, F.expr("try_divide(n_nodes, source_nodes)"))).alias("median_node_ratio"),
    )


def recovery_summary(results: DataFrame) -> DataFrame:
    """One row over results (ok, n_elements, exact, source_bytes, n_bytes, captured, joined): sums over what passed, capture joins over all, the least share kept."""
    ok = F.col("ok")
    return results.agg(
        F.count("*").alias("attempts"), F.count_if(ok).alias("passed"), *(F.sum(F.when(ok, F.col(c))).alias(c) for c in ("n_elements", "exact", "source_bytes", "n_bytes")),
        F.sum("captured").alias("captured"), F.sum("joined").alias("joined"), F.min(F.when(ok, F.expr("try_divide(exact, n_elements)"))).alias("least_kept"),
    )


def preparation_totals(documents: DataFrame, counts: list[str]) -> DataFrame:
    """One row: how many documents, and the sum of each count."""
    return documents.agg(F.count("*").alias("documents"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts))


def training_totals(rows: DataFrame) -> DataFrame:
    """One row over rows (split, accepted, tokens, completion_tokens, generated): counts, token sums and the longest answer that generation is measured on, 0 for none."""
    taken = F.col("accepted")
    return rows.agg(
        *(F.count_if(taken & (F.col("split") == s)).alias(f"{s}_examples") for s in ("train", "dev")), *(F.count_if(~taken & (F.col("split") == s)).alias(f"excluded_{s}") for s in ("train", "dev")),
        *(F.coalesce(F.sum(F.when(taken & (F.col("split") == "train"), F.col(c))), F.lit(0)).alias(f"train_{c}") for c in ("tokens", "completion_tokens")),
        F.coalesce(F.max(F.when(F.col("generated"), F.col("completion_tokens"))), F.lit(0)).alias("longest_reference"),
    )


def carried_over(before: DataFrame, now: DataFrame, by: list[str], counts: list[str]) -> DataFrame:
    """Totals of earlier sessions and the present one."""
    return before.unionByName(now).groupBy(*by).agg(*(F.sum(c).alias(c) for c in counts))


def removed_attribute_bytes(nodes: DataFrame, kept: list[str]) -> DataFrame:
    """(doc_id, name, n_bytes) of attributes that are not kept."""
    a = nodes.select("doc_id", F.explode("attributes").alias("name", "value")).where(~F.col("name").isin(kept) & ~F.col("name").startswith("aria-"))
    return a.groupBy("doc_id", "name").agg(F.sum(F.octet_length("name") + F.octet_length("value")).alias("n_bytes"))


def last_states(log: DataFrame, by: str, order: str) -> DataFrame:
    """Per episode: how many lines its log has, and the last one."""
    return log.groupBy(by).agg(F.count("*").alias("lines"), F.max_by("line", order).alias("last"))


def recent(jobs: DataFrame, created: str, n: int = 12) -> DataFrame:
    """The latest n jobs: a top-k report."""
    return jobs.orderBy(F.desc(created), "job").limit(n)


def kept_jobs(jobs: DataFrame, by: str, created: str, n: int = 50) -> DataFrame:
    """The last n jobs of each owner."""
    return jobs.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(created), "job"))).where(F.col("_r") <= n).drop("_r")


def shown_evidence(refs: Column, n: int = 6) -> tuple[Column, Column]:
    """(the first n, how many more there are)"""
    return F.slice(refs, 1, n), F.greatest(F.lit(0), F.size(refs) - n)


def backlog_last(specs: DataFrame, backlog: Column, order: str) -> DataFrame:
    """Specs in their order, those of the backlog behind the others."""
    return specs.orderBy(F.coalesce(backlog, F.lit(False)), order)


def shuffled(specs: DataFrame, key: str, seed: str) -> DataFrame:
    """Specs in an order hashed with the seed."""
    return specs.orderBy(F.sha2(F.concat(F.lit(seed + "|"), F.col(key).cast("string")), 256), key)


def trial_specs(tasks: DataFrame, conditions: list[str], models: list[str]) -> DataFrame:
    """Each task under each condition with each model; both lists are parameters, so a row makes that many and nothing is joined."""
    return tasks.withColumn("condition", F.explode(F.array(*map(F.lit, conditions)))).withColumn("model", F.explode(F.array(*map(F.lit, models))))


def changed_specs(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """(key, change): specs that come or go, or stand twice on a side."""
    from treeline.sources.records import one_to_one

    return one_to_one(old, new, key).select(*key, F.when(F.col("problem") == "only left", "removed").when(F.col("problem") == "only right", "added").otherwise("repeated").alias("change"))


def legacy_ratio(results: DataFrame, baseline: DataFrame, expected: DataFrame) -> DataFrame:
    """(dataset, profile, n_bytes, legacy_bytes, ratio): only datasets of which every document was measured (expected: dataset, documents)."""
    own = results.groupBy("dataset", "profile").agg(F.sum("n_bytes").alias("n_bytes"), F.countDistinct("doc_id").alias("measured"))
    j = own.join(expected, "dataset").where("measured = documents").join(baseline.select("dataset", "legacy_bytes"), "dataset")
    return j.select("dataset", "profile", "n_bytes", "legacy_bytes", F.expr("try_divide(n_bytes, legacy_bytes)").alias("ratio"))


def same_keys(record: Column, fields: list[str]) -> Column:
    """Whether JSON text is an object of exactly these fields."""
    return F.coalesce(F.array_sort(F.json_object_keys(record)) == F.array(*map(F.lit, sorted(fields))), F.lit(False))


def valid_refs(ledger: DataFrame) -> DataFrame:
    """(doc_id, ref): what a view shows, and what stands for something it does not."""
    return ledger.where("disposition = 'retained'").select("doc_id", F.col("node").alias("ref")).union(ledger.where("representative is not null").select("doc_id", F.col("representative").alias("ref"))).distinct()


def retained_difference(ledger: DataFrame, emitted: DataFrame) -> DataFrame:
    """(doc_id, node, side): nodes that a ledger retains but that were not emitted, and the other way."""
    kept = ledger.where("disposition = 'retained'").select("doc_id", "node")
    shown = emitted.select("doc_id", "node")
    return kept.exceptAll(shown).withColumn("side", F.lit("ledger")).unionByName(shown.exceptAll(kept).withColumn("side", F.lit("emitted")))


def ref_differences(expected: Column, claimed: Column, reachable: Column) -> Column:
    """Expected refs that nothing claims or reaches, and claims that were not expected."""
    return F.struct(
        F.array_sort(F.array_except(expected, claimed)).alias("unclaimed"), F.array_sort(F.array_except(expected, reachable)).alias("unreached"), F.array_sort(F.array_except(claimed, expected)).alias("unexpected")
    )


OUTLINE_METRICS = (
    "doc_id long, expected int, unclaimed array<string>, unreached array<string>, unexpected array<string>, repeated_claims array<string>, repeated_refs array<string>, repeated_units array<string>, "
    "overlaps array<struct<a:int,b:int>>, unmatched_units array<string>, invalid_expected array<string>"
)


def outline_metrics(nodes: DataFrame, baseline: DataFrame, units: DataFrame, lines: DataFrame) -> DataFrame:
    """Coverage of each document's outline, computed anew: which expected nodes no unit claims or no line reaches, what is claimed twice or never expected, lines whose subtrees overlap, units without exactly one line.

    nodes (doc_id, node, parent, pre, end), baseline (doc_id, ref), units (doc_id,
    id, label, refs, claims), lines (doc_id, line, label, refs); refs are node ids as text.
    """
    text, array = "string", "array<string>"
    empty = F.array().cast(array)
    null = lambda kind: F.lit(None).cast(kind)
    rows = nodes.select("doc_id", F.lit("node").alias("what"), F.col("node").cast(text).alias("id"), null(text).alias("label"), empty.alias("refs"), empty.alias("claims"), F.col("pre").cast("int").alias("pre"), F.col("end").cast("int").alias("end"))
    rows = rows.unionByName(baseline.select("doc_id", F.lit("expected").alias("what"), F.col("ref").alias("id"), null(text).alias("label"), empty.alias("refs"), empty.alias("claims"), null("int").alias("pre"), null("int").alias("end")))
    rows = rows.unionByName(units.select("doc_id", F.lit("unit").alias("what"), "id", "label", "refs", "claims", null("int").alias("pre"), null("int").alias("end")))
    rows = rows.unionByName(lines.select("doc_id", F.lit("line").alias("what"), F.col("line").cast(text).alias("id"), "label", "refs", empty.alias("claims"), F.col("line").cast("int").alias("pre"), null("int").alias("end")))

    def twice(values: list[str]) -> list[str]:
        seen, out = set(), set()
        for v in values:
            (out if v in seen else seen).add(v)
        return sorted(out)

    def run(group: list[dict]) -> list[dict]:
        own: dict[str, list[dict]] = {k: [r for r in group if r["what"] == k] for k in ("node", "expected", "unit", "line")}
        span = {r["id"]: (r["pre"], r["end"]) for r in own["node"]}
        at = sorted((r["pre"], r["id"]) for r in own["node"])
        expected = {r["id"] for r in own["expected"]}
        claims = [c for u in own["unit"] for c in u["claims"]]
        leaves = sorted((r for r in own["line"] if r["refs"]), key=lambda r: r["pre"])
        covered = bytearray(max((p for p, _ in at), default=-1) + 1)
        for r in leaves:
            for s in r["refs"]:
                if s in span:
                    a, b = span[s]
                    covered[a:b] = b"\1" * (min(b, len(covered)) - a)
        reached = {i for p, i in at if covered[p]}
        overlaps = set()
        starts = sorted((span[s][0], span[s][1], k) for k, r in enumerate(leaves) for s in r["refs"] if s in span)
        open_: list[tuple[int, int, int]] = []
        for a, b, k in starts:
            while open_ and open_[-1][1] <= a:
                open_.pop()
            overlaps |= {tuple(sorted((k, other))) for p, _, other in open_ if other != k and p != a}
            open_.append((a, b, k))
        said = [(r["label"], tuple(r["refs"])) for r in leaves]
        return [{
            "doc_id": group[0]["doc_id"], "expected": len(expected), "unclaimed": sorted(expected - set(claims)), "unreached": sorted(expected - reached), "unexpected": sorted(set(claims) - expected),
            "repeated_claims": twice(claims), "repeated_refs": twice([s for r in leaves for s in r["refs"]]), "repeated_units": twice([u["id"] for u in own["unit"]]),
            "overlaps": [{"a": a, "b": b} for a, b in sorted(overlaps)], "unmatched_units": [u["id"] for u in own["unit"] if said.count((u["label"], tuple(u["refs"]))) != 1], "invalid_expected": sorted(expected - set(span)),
        }]

    return by_document(rows, run, OUTLINE_METRICS, order="what")


def metric_reasons(metrics: DataFrame) -> DataFrame:
    """metrics with reasons: each measure that is not empty keeps a document out, how many were expected aside."""
    names = [f.name for f in metrics.schema.fields if f.dataType.typeName() == "array"]
    return metrics.withColumn("reasons", F.array_compact(F.array(*(F.when(F.size(n) > 0, F.lit(f"metric_{n}")) for n in names))))


def stage_plan(stages: DataFrame) -> DataFrame:
    """stages (run, stage, healthy, infra_errors) with the workers that the next one may use: two until a stage was healthy, then four, two again after one that was not; none after three infrastructure errors."""
    w = Window.partitionBy("run").orderBy("stage")
    errors = F.sum("infra_errors").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return stages.withColumn("next_workers", F.when(errors >= 3, 0).when(F.col("healthy"), 4).otherwise(2))


def decision_warnings(cues: Column, shown: Column) -> Column:
    """Cited cues that were not shown."""
    return F.array_except(cues, shown)


def pending(specs: DataFrame, done: DataFrame, key: list[str], complete: Column) -> DataFrame:
    """Specs of which no completed episode exists."""
    return specs.join(done.where(complete).select(*key), key, "left_anti")


def budget_left(episodes: DataFrame, spent: str, cap: int) -> DataFrame:
    """One row: what is spent and what is left of the cap, never below 0."""
    return episodes.agg(F.coalesce(F.sum(spent), F.lit(0)).alias("spent")).withColumn("left", F.greatest(F.lit(0).cast("long"), F.lit(cap) - F.col("spent")))


def cached_projections(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """wanted (key) with the cached projection and whether it was a hit; misses have none."""
    return wanted.join(cache.select("key", "projection").dropDuplicates(["key"]), "key", "left").withColumn("hit", F.col("projection").isNotNull())


def markdown_table(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row with the table as Markdown: for reports, whose rows are few."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\|", "\\\\|") for c in rows.columns)), F.lit(" |"))
    listed = F.sort_array(F.collect_list(F.struct(*order, cells.alias("_cells"))))
    head = "| " + " | ".join(rows.columns) + " |\n|" + "-|" * len(rows.columns) + "\n"
    return rows.agg(F.concat(F.lit(head), F.array_join(F.transform(listed, lambda x: x["_cells"]), "\n")).alias("markdown"))


def compared_candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """(doc_id, node, in_left, in_right): what either selection has."""
    l, r = left.select("doc_id", "node").withColumn("in_left", F.lit(True)), right.select("doc_id", "node").withColumn("in_right", F.lit(True))
    return l.join(r, ["doc_id", "node"], "full_outer").fillna(False, ["in_left", "in_right"])


def model_aliases(view: DataFrame) -> DataFrame:
    """view (doc_id, node, pre) with alias: n and the place in order, from 0, in base 36, as models are shown it."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("pre")) - 1
    return view.withColumn("alias", F.concat(F.lit("n"), F.lower(F.conv(place.cast("string"), 10, 36))))


def reference_findings(answers: DataFrame, aliases: DataFrame, packets: DataFrame) -> DataFrame:
    """answers (doc_id, alias, packet_hash) with node or reason: stale packet, repeated, unknown alias, or a node that is not assignable (aliases: doc_id, alias, node, assignable; packets: doc_id, packet_hash)."""
    n = answers.groupBy("doc_id", "alias").agg(F.count("*").alias("times"))
    j = answers.join(n, ["doc_id", "alias"]).join(packets.select("doc_id", F.col("packet_hash").alias("_h")), "doc_id", "left").join(aliases, ["doc_id", "alias"], "left")
    reason = F.when(~F.col("packet_hash").eqNullSafe(F.col("_h")), "stale").when(F.col("times") > 1, "repeated").when(F.col("node").isNull(), "unknown").when(~F.col("assignable"), "not assignable")
    return j.select("doc_id", "alias", F.when(reason.isNull(), F.col("node")).alias("node"), reason.alias("reason"))


def surviving_relations(nodes: DataFrame, attributes: list[str]) -> DataFrame:
    """(doc_id, node, attribute, kept, missing): tokens of relation attributes whose ids are still there, and those whose are not."""
    ids = nodes.where(F.col("attributes")["id"] != "").select("doc_id", F.col("attributes")["id"].alias("token")).distinct().withColumn("there", F.lit(True))
    pairs = F.filter(F.map_entries("attributes"), lambda e: e["key"].isin(attributes))
    tokens = nodes.select("doc_id", "node", F.explode(pairs).alias("e")).select("doc_id", "node", F.col("e.key").alias("attribute"), F.posexplode(F.filter(F.split("e.value", r"\s+"), lambda t: t != "")).alias("at", "token"))
    j = tokens.join(ids, ["doc_id", "token"], "left")
    listed = lambda c: F.transform(F.sort_array(F.collect_list(F.when(c, F.struct("at", "token")))), lambda x: x["token"])
    return j.groupBy("doc_id", "node", "attribute").agg(listed(F.col("there").isNotNull()).alias("kept"), listed(F.col("there").isNull()).alias("missing"))


def expanded_refs(asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """asked (doc_id, ref: a place in base 36) with the node at that place, null if there is none."""
    place = F.conv(F.lower("ref"), 36, 10).cast("long")
    n = nodes.select("doc_id", F.col("pre").cast("long").alias("_at"), "node", "tag")
    return asked.withColumn("_at", place).join(n, ["doc_id", "_at"], "left").drop("_at")


def spliced_aliases(html: Column, reference: str, alias_of: Column) -> Column:
    """Markup with its reference attributes rewritten to short numbers (alias_of: map from ref to number); refs without a number stay."""
    pattern = f'{reference}="([^"]*)"'
    found = F.regexp_extract_all(html, F.lit(pattern), F.lit(1))
    between = F.split(html, pattern, -1)
    new = F.transform(found, lambda r: F.concat(F.lit(f'{reference}="'), F.coalesce(alias_of[r].cast("string"), r), F.lit('"')))
    return F.concat_ws("", F.flatten(F.zip_with(between, F.concat(new, F.array(F.lit(""))), lambda t, u: F.array(t, u))))


def group_schema(allowed: list[str], budget: int) -> dict:
    """JSON schema of an answer with groups over the allowed source ids."""
    text = {"type": "STRING"}
    group = {"type": "OBJECT", "required": ["id", "label", "parent", "source_ids"], "properties": {"id": text, "label": text, "parent": {**text, "nullable": True}, "source_ids": {"type": "ARRAY", "items": {**text, "enum": allowed}}}}
    return {"type": "OBJECT", "required": ["groups"], "properties": {"groups": {"type": "ARRAY", "maxItems": budget, "items": group}}}


def result_schema(gates: list[str], criteria: list[str]) -> dict:
    """JSON schema of a hierarchy result."""
    text = {"type": "string"}
    status = {"enum": ["pass", "fail", "not_assessable"]}
    criterion = {"type": "object", "required": ["status", "score"], "properties": {"status": {"enum": ["assessed", "not_assessable", "not_applicable"]}, "score": {"anyOf": [{"type": "integer", "minimum": 0, "maximum": 3}, {"type": "null"}]}}}
    return {
        "type": "object", "required": ["evaluation_id", "candidate_id", "gates", "criteria", "issues", "decision"], "additionalProperties": False,
        "properties": {
            "evaluation_id": text, "candidate_id": text, "decision": {"enum": ["reject", "insufficient_evidence", "revise", "usable_candidate"]}, "issues": {"type": "array"},
            "gates": {"type": "object", "required": gates, "properties": {g: {"type": "object", "required": ["status"], "properties": {"status": status}} for g in gates}},
            "criteria": {"type": "object", "required": criteria, "properties": dict.fromkeys(criteria, criterion)},
        },
    }

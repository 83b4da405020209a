"""Queries of row-level rules and small relational rules.

Elements are made of events: each event picks a tag and attributes by its
number, so that tens of thousands of combinations meet every rule. The SQL says
the rules by other means.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treeline.functions import text as tx
from treeline.operators import groups, judging, observe, release, reports, traces
from treeline.plans.registry import bigints, query, table
from treeline.sources import records

#: What elements are picked from: values, and by which divisor of an event's number.
PICKS: dict[str, tuple[int, list[str | None]]] = {
    "tag": (1, [
        "a", "area", "button", "input", "select", "textarea", "option", "optgroup", "fieldset", "form", "ul", "li", "table", "tr", "td", "th", "h1", "h4", "header", "footer", "nav", "main", "aside", "section",
        "article", "p", "div", "span", "img", "svg", "summary", "details", "progress", "meter", "pre", "math", "iframe", "dl", "dd", "figure", "figcaption", "label", "template", "script", "noscript", "datalist", "hr",
    ]),
    "role": (7, [None, "button", "heading link", "presentation", "tabpanel", "foo none", "BUTTON", "textbox", "bogus", "", "link", "slider", "doc-x checkbox", "listbox", "alertdialog"]),
    "type": (3, [None, "checkbox", "radio", "range", "number", "button", "submit", "image", "hidden", "text", "password", "EMAIL"]),
    "href": (5, [None, "/x", "#f"]), "multiple": (11, [None, ""]), "size": (13, [None, "1", "4", "x"]), "scope": (17, [None, "row", "col", "rowgroup"]), "hidden": (19, [None, None, ""]), "inert": (23, [None, None, None, ""]),
    "aria-hidden": (29, [None, "true", "false", "TRUE"]), "disabled": (31, [None, ""]), "readonly": (37, [None, ""]), "required": (41, [None, ""]), "aria-disabled": (43, [None, "true", "false", "x"]),
    "aria-required": (47, [None, "false", "true"]), "aria-checked": (53, [None, "mixed", "true", "maybe"]), "aria-label": (59, [None, "Name", ""]), "label": (61, [None, "Lab"]), "alt": (67, [None, "Alt"]),
    "value": (71, [None, "5", ""]), "title": (73, [None, "T"]), "tabindex": (79, [None, "0"]), "aria-valuenow": (83, [None, "3", "x", "1e1"]), "min": (89, [None, "2", "9"]), "aria-valuemax": (97, [None, "7"]),
    "aria-level": (101, [None, "2", "0", "2.5", "3"]), "parent": (2, ["div", "datalist", "article"]),
}


def elements(spark, sf_dir: str) -> DataFrame:
    """(doc_id, node, kind, tag, attributes, text, context): one element for each event."""
    e = table(spark, sf_dir, "events")
    pick = {k: F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), ((F.floor(F.col("event_id") / by) % len(values)) + 1).cast("int")) for k, (by, values) in PICKS.items()}
    given = F.map_filter(F.create_map(*(x for k, c in pick.items() if k not in ("tag", "parent") for x in (F.lit(k), c))), lambda k, v: v.isNotNull())
    context = F.struct(
        F.lit(None).cast("string").alias("language"), F.lit(None).cast("string").alias("direction"), pick["tag"].isin("pre", "math").alias("verbatim"), F.when(pick["tag"] == "math", "math").when(pick["tag"] == "pre", "code").alias("contentKind"),
        (pick["inert"].isNotNull()).alias("inert"), (pick["tag"] == "template").alias("dormant"), (pick["disabled"].isNotNull()).alias("disabled"), (pick["parent"] == "article").alias("sectioned"), F.lit(False).alias("payload"),
        pick["parent"].alias("parentTag"), F.lit(False).alias("branching"),
    )
    return e.select(F.lit(0).cast("long").alias("doc_id"), F.col("event_id").alias("node"), F.lit("element").alias("kind"), pick["tag"].alias("tag"), given.alias("attributes"), F.lit(None).cast("string").alias("text"), context.alias("context"))


def _list(values: list[str | None]) -> str:
    return "[" + ", ".join("null" if v is None else f"'{v}'" for v in values) + "]"


#: The same elements in SQL: e, with a column for each pick (dashes as underscores, parent as up).
ELEMENTS = "e as (select event_id as node, " + ", ".join(f"({_list(v)}::varchar[])[((event_id // {by}) % {len(v)} + 1)::bigint] as \"{'up' if k == 'parent' else k.replace('-', '_')}\"" for k, (by, v) in PICKS.items()) + " from events)"
_AUTHOR = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in observe.AUTHOR_ROLES.items()) + "}"
_NATIVE = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in observe.TAG_ROLES.items()) + "}"
_KIND = "lower(coalesce(type, 'text'))"
_ROLE = f"""coalesce({_AUTHOR}[list_filter(string_split_regex(coalesce(role, ''), '\\s+'), lambda t: list_contains(map_keys({_AUTHOR}), t))[1]],
  case when tag in ('h1', 'h4') then 'heading' when tag in ('a', 'area') then (case when href is null then 'generic' else 'link' end)
  when tag = 'select' then (case when multiple is not null or try_cast(size as double) > 1 then 'listBox' else 'comboBox' end)
  when tag = 'input' then (case {_KIND} when 'checkbox' then 'checkbox' when 'radio' then 'radio' when 'range' then 'slider' when 'number' then 'spinButton' when 'hidden' then 'generic' when 'button' then 'button' when 'submit' then 'button' when 'image' then 'button' else 'textField' end)
  when tag in ('header', 'footer') then (case when up = 'article' then 'generic' when tag = 'header' then 'banner' else 'contentInfo' end)
  when tag = 'th' then (case when scope in ('row', 'rowgroup') then 'rowHeader' else 'columnHeader' end) else coalesce({_NATIVE}[tag], 'generic') end)"""
_CONTROL = "tag in ('input', 'select', 'textarea', 'button', 'option', 'optgroup', 'fieldset')"
_OFF = f"({_CONTROL} and disabled is not null) or coalesce(aria_disabled = 'true', false)"


@query(f"with {ELEMENTS} select node, {_ROLE} as role from e")
def element_roles(spark, sf_dir):
    """Roles by author, tag, type and place."""
    return elements(spark, sf_dir).select("node", observe.role().alias("role"))


@query(f"""with {ELEMENTS}, t as (select *, list_filter(string_split_regex(lower(coalesce(role, '')), '\\s+'), lambda t: t in ('heading', 'link', 'button') or list_contains({_list(observe.FIELD_ROLES + observe.OTHER_ROLES)}, t))[1] as r from e)
select node, case when r in ('heading', 'link', 'button') then r when list_contains({_list(observe.FIELD_ROLES)}, r) then 'field' when r is not null then null when tag in ('h1', 'h4') then 'heading' when tag in ('a', 'area') then (case when href is not null then 'link' end)
  when tag in ('button', 'summary') then 'button' when tag = 'input' then (case when {_KIND} in ('button', 'submit', 'reset', 'image') then 'button' when {_KIND} <> 'hidden' then 'field' end) when tag in ('select', 'textarea') then 'field' end as target,
  tag in ('script', 'style', 'noscript', 'template') or hidden is not null or inert is not null or coalesce(lower(aria_hidden) = 'true', false) or (tag = 'input' and {_KIND} = 'hidden') as hidden from t""")
def element_targets(spark, sf_dir):
    """Target kinds, and what is hidden."""
    return elements(spark, sf_dir).select("node", observe.target_kind().alias("target"), observe.is_hidden().alias("hidden"))


@query(f"""with {ELEMENTS} select node, case when aria_label is not null then aria_label when tag in ('option', 'optgroup') and label is not null then label when tag = 'option' and up = 'datalist' and value is not null then value when tag = 'img' or (tag = 'input' and {_KIND} = 'image') then alt end as name,
  case when aria_label is not null then 'aria-label' when tag in ('option', 'optgroup') and label is not null then 'label' when tag = 'option' and up = 'datalist' and value is not null then 'value' when (tag = 'img' or (tag = 'input' and {_KIND} = 'image')) and alt is not null then 'alt' end as basis,
  concat_ws(',', title, case when tag = 'input' and {_KIND} in ('button', 'submit', 'reset') then value end) as hints from e""")
def element_names(spark, sf_dir):
    """Names with their basis, and hints."""
    e = elements(spark, sf_dir).withColumns({"n": observe.name(), "h": observe.hints()})
    return e.select("node", F.col("n.text").alias("name"), F.col("n.basis").alias("basis"), F.array_join(F.transform("h", lambda x: x["text"]), ",").alias("hints"))


@query(f"""with {ELEMENTS} select node, case when {_CONTROL} and disabled is not null then 'true' when aria_disabled in ('true', 'false') then aria_disabled end as disabled,
  case when aria_required in ('true', 'false') then aria_required when {_CONTROL} and required is not null then 'true' end as required, case when aria_checked in ('true', 'false', 'mixed') then aria_checked end as checked,
  case when {_CONTROL} and readonly is not null then 'true' end as read_only from e""")
def element_states(spark, sf_dir):
    e = elements(spark, sf_dir).withColumn("s", observe.states())
    return e.select("node", "s.disabled", "s.required", "s.checked", F.col("s.readOnly").alias("read_only"))


@query(f"""with {ELEMENTS} select node, case when {_OFF} then '' else concat_ws(',', case when (tag in ('a', 'area') and href is not null) or tag in ('button', 'summary') or (tag = 'input' and {_KIND} in ('button', 'submit', 'image')) then 'invoke' end,
  case when tag = 'input' and {_KIND} = 'checkbox' then 'toggle' when tag = 'input' and {_KIND} = 'radio' then 'select' end,
  case when tag in ('input', 'textarea') and {_KIND} not in ('hidden', 'checkbox', 'radio', 'button', 'submit', 'image') and readonly is null then 'setValue' end, case when tag in ('select', 'option') then 'select' end,
  case when (tag in ('input', 'textarea', 'select', 'button') and {_KIND} <> 'hidden') or (tag = 'a' and href is not null) or tabindex is not null then 'focus' end) end as actions from e""")
def element_actions(spark, sf_dir):
    return elements(spark, sf_dir).select("node", F.array_join(observe.actions(), ",").alias("actions"))


@query(f"""with {ELEMENTS}, r as (select *, {_ROLE} as of_role, case when min is not null then min::double end as low, aria_valuemax::double as high from e)
select node, case when of_role in ('slider', 'spinButton', 'progress') and aria_valuenow in ('3', '1e1') then aria_valuenow::double end as current, case when of_role in ('slider', 'spinButton', 'progress') and not coalesce(low > high, false) then low end as least,
  case when aria_level in ('2', '3') then aria_level::bigint when tag in ('h1', 'h4') then tag[2]::bigint end as level, case when tag in ('canvas', 'video', 'audio', 'svg') then 'media' when tag = 'iframe' then 'frame' end as opaque,
  case when of_role = 'paragraph' then 'prose' when tag = 'math' then 'math' when tag = 'pre' then 'code' end as content, list_contains({_list(observe.BOUNDARIES)}, of_role) as bounded,
  tag = 'textarea' or (tag = 'input' and {_KIND} = 'password') or (value is not null and of_role = 'textField') as private from r""")
def element_structure(spark, sf_dir):
    """Ranges, levels, opacity, kinds of content, boundaries and privacy."""
    e = elements(spark, sf_dir).withColumns({"s": observe.structure(), "v": observe.numeric_value()})
    return e.select("node", F.col("v.current").alias("current"), F.col("v.min").alias("least"), F.col("s.level").alias("level"), F.col("s.opaqueContent").alias("opaque"), F.col("s.contentKind").alias("content"), F.coalesce(F.col("s.boundary") == "semantic", F.lit(False)).alias("bounded"), observe.is_private().alias("private"))


@query(f"""with {ELEMENTS} select node, hidden is not null or (tag = 'input' and {_KIND} = 'hidden') as unrendered, coalesce(aria_hidden = 'true', false) or (tag = 'input' and {_KIND} = 'hidden') as left_out, inert is not null as inert, tag = 'template' as dormant from e""")
def element_exposure(spark, sf_dir):
    e = elements(spark, sf_dir).withColumn("x", observe.exposure())
    return e.select("node", F.col("x.rendered").isNotNull().alias("unrendered"), F.col("x.accessibilityIncluded").isNotNull().alias("left_out"), F.col("x.inert").isNotNull().alias("inert"), F.col("x.dormant").isNotNull().alias("dormant"))


@query(f"""with {ELEMENTS}, a as (select node // 50 as doc, node, case when node % 50 = 7 then 'a' when node % 50 in (8, 9) then 'b' else null end as id, case when node % 50 < 6 then ['a', 'b', 'zz', 'a zz', 'b a', null][(node % 50 + 1)::bigint] end as refs from e),
t as (select doc, node, unnest(string_split(refs, ' ')) as id from a where refs is not null), n as (select doc, id, count(*) as n, min(node) as target from a where id is not null group by 1, 2)
select t.doc as doc_id, t.node, t.id as token, case when n = 1 then target end as target, case when n.n is null then 'missing-target' when n > 1 then 'ambiguous-html-id' end as reason from t left join n on n.doc = t.doc and n.id = t.id""")
def element_references(spark, sf_dir):
    """References among every fifty elements: to one id, to an id that two have, and to none."""
    e = elements(spark, sf_dir)
    k = F.col("node") % 50
    ids = F.when(k == 7, "a").when(k.isin(8, 9), "b")
    refs = F.element_at(F.array(*map(F.lit, ["a", "b", "zz", "a zz", "b a"])), F.when(k < 5, k + 1).otherwise(1).cast("int"))
    given = F.map_filter(F.create_map(F.lit("id"), ids, F.lit("aria-controls"), F.when(k < 5, refs)), lambda _, v: v.isNotNull())
    n = e.withColumns({"doc_id": F.floor(F.col("node") / 50), "attributes": given})
    tokens = n.where("attributes['aria-controls'] is not null").select("doc_id", "node", F.posexplode(F.split(F.col("attributes")["aria-controls"], " ")).alias("ordinal", "token"))
    found = observe.resolve_references(n)
    return found.join(tokens, ["doc_id", "node", "ordinal"]).select("doc_id", "node", "token", "target", "reason")


# Relational rules over events, orders and lines.

_RESULTS = "select event_type as profile, event_type <> 'error' or value > 10 as ok, (event_id + 100)::bigint as source_bytes, (event_id % 97 + 1)::bigint as n_bytes from events"


def _results(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("profile"), ((F.col("event_type") != "error") | (F.col("value") > 10)).alias("ok"), (F.col("event_id") + 100).alias("source_bytes"), (F.col("event_id") % 97 + 1).alias("n_bytes"),
        (F.col("event_id") + 100).alias("source_nodes"), (F.col("event_id") % 97 + 1).alias("n_nodes"), (F.col("event_id") + 100).alias("n_elements"), (F.col("event_id") % 97 + 1).alias("exact"), F.lit(2).alias("captured"), F.lit(1).alias("joined"),
    )


@query(f"select profile, count(*) as attempts, count_if(ok) as passed, sum(n_bytes) filter (ok)::bigint as n_bytes, round(median(n_bytes / source_bytes) filter (ok), 9) as ratio from ({_RESULTS}) group by 1")
def compaction_results(spark, sf_dir):
    return reports.compaction_summary(_results(spark, sf_dir)).select("profile", "attempts", "passed", "n_bytes", F.round("median_byte_ratio", 9).alias("ratio"))


@query(f"select count(*) as attempts, count_if(ok) as passed, sum(n_bytes) filter (ok)::bigint as exact, 2 * count(*) as captured, round(min(n_bytes / source_bytes) filter (ok), 9) as least_kept from ({_RESULTS})")
def recovery_results(spark, sf_dir):
    return reports.recovery_summary(_results(spark, sf_dir)).select("attempts", "passed", "exact", "captured", F.round("least_kept", 9).alias("least_kept"))


@query("""select count_if(quality = 1 and doc_id % 5 <> 0) as train_examples, count_if(quality = 1 and doc_id % 5 = 0) as dev_examples, count_if(quality <> 1 and doc_id % 5 <> 0) as excluded_train, coalesce(sum(n_chars) filter (quality = 1 and doc_id % 5 <> 0), 0)::bigint as train_tokens,
  coalesce(max(n_chars // 2) filter (toxic = 1), 0)::bigint as longest_reference from labels join documents using (doc_id)""")
def training_preflight(spark, sf_dir):
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    rows = j.select(F.when(F.col("doc_id") % 5 == 0, "dev").otherwise("train").alias("split"), (F.col("quality") == 1).alias("accepted"), F.col("n_chars").alias("tokens"), F.floor(F.col("n_chars") / 2).alias("completion_tokens"), (F.col("toxic") == 1).alias("generated"))
    return reports.training_totals(rows).select("train_examples", "dev_examples", "excluded_train", "train_tokens", "longest_reference")


@query("select user_id, event_id, rank::bigint as rank from (select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id) as rank from events) where rank <= 50")
def kept_jobs(spark, sf_dir):
    """The last fifty events of each user: what a job list keeps."""
    e = table(spark, sf_dir, "events").withColumn("job", F.col("event_id"))
    kept = reports.kept_jobs(e, "user_id", "ts")
    return kept.select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), "event_id")).cast("long").alias("rank"))


@query("select n_name as task, condition, model from nation, (select unnest(['source', 'purpose', 'coarse']) as condition), (select unnest(['m1', 'm2']) as model)")
def trial_specs(spark, sf_dir):
    return reports.trial_specs(table(spark, sf_dir, "nation").select(F.col("n_name").alias("task")), ["source", "purpose", "coarse"], ["m1", "m2"])


@query("""with a as (select user_id, event_type from events where event_id % 3 <> 0), b as (select distinct user_id, event_type from events where event_id % 3 <> 1),
l as (select user_id, event_type, count(*) as n from a group by all) select coalesce(l.user_id, b.user_id) as user_id, coalesce(l.event_type, b.event_type) as event_type, case when b.user_id is null then 'removed' when l.user_id is null then 'added' else 'repeated' end as change
from l full join b on l.user_id = b.user_id and l.event_type = b.event_type where b.user_id is null or l.user_id is null or l.n > 1""")
def changed_specs(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return reports.changed_specs(e.where("event_id % 3 <> 0").drop("event_id"), e.where("event_id % 3 <> 1").drop("event_id").distinct(), ["user_id", "event_type"])


@query("""with r as (select user_id as dataset, event_type as profile, sum(event_id % 11)::bigint as n_bytes, count(distinct event_id) as m from events group by all), x as (select user_id as dataset, max(c) as documents, sum(c)::bigint as legacy from (select user_id, event_type, count(*) as c from events group by all) group by 1)
select dataset, profile, n_bytes, round(n_bytes / legacy, 9) as ratio from r join x using (dataset) where m = documents""")
def legacy_ratios(spark, sf_dir):
    """Sizes against a baseline, for profiles that measured every document."""
    e = table(spark, sf_dir, "events")
    r = e.select(F.col("user_id").alias("dataset"), F.col("event_type").alias("profile"), F.col("event_id").alias("doc_id"), (F.col("event_id") % 11).alias("n_bytes"))
    by = e.groupBy("user_id", "event_type").agg(F.count("*").alias("c")).groupBy(F.col("user_id").alias("dataset")).agg(F.max("c").alias("documents"), F.sum("c").alias("legacy_bytes"))
    return reports.legacy_ratio(r, by, by.select("dataset", "documents")).select("dataset", "profile", "n_bytes", F.round("ratio", 9).alias("ratio"))


@query("""with s as (select user_id as run, event_type, event_id, event_type = 'click' as healthy, (event_type = 'error')::int as err from events), e as (select *, sum(err) over (partition by run order by event_id) as errors from s)
select run, event_id as stage, (case when errors >= 3 then 0 when healthy then 4 else 2 end)::bigint as next_workers from e""")
def stage_plans(spark, sf_dir):
    s = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("stage"), (F.col("event_type") == "click").alias("healthy"), (F.col("event_type") == "error").cast("int").alias("infra_errors"))
    return reports.stage_plan(s).select("run", "stage", F.col("next_workers").cast("long").alias("next_workers"))


@query("select user_id, event_id from events where event_type <> 'error' and (user_id, event_type) not in (select (user_id, event_type) from events where value > 60)")
def pending_specs(spark, sf_dir):
    """Specs of which no completed episode exists."""
    e = table(spark, sf_dir, "events")
    return reports.pending(e.where("event_type <> 'error'"), e, ["user_id", "event_type"], F.col("value") > 60).select("user_id", "event_id")


@query("select round(sum(value), 2) as spent, round(greatest(0, 1000000 - sum(value)), 2) as \"left\" from events")
def budget_left(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.agg(F.sum("value").alias("v")).transform(lambda d: reports.budget_left(d, "v", 1_000_000)).select(F.round("spent", 2).alias("spent"), F.round("left", 2).alias("left"))


@query("""with a as (select user_id as doc_id, event_id % 40 as alias, event_id % 7 as h, count(*) over (partition by user_id, event_id % 40) as times from events where event_id % 5 = 0)
select doc_id, alias, case when h <> 0 then 'stale' when times > 1 then 'repeated' when alias >= 30 then 'unknown' when alias % 2 = 1 then 'not assignable' end as reason, case when h = 0 and times = 1 and alias < 30 and alias % 2 = 0 then alias end as node from a""")
def reference_findings(spark, sf_dir):
    """Answers that name aliases: stale, repeated, unknown or not assignable ones have no node."""
    e = table(spark, sf_dir, "events")
    answers = e.where("event_id % 5 = 0").select(F.col("user_id").alias("doc_id"), (F.col("event_id") % 40).alias("alias"), (F.col("event_id") % 7).cast("string").alias("packet_hash"))
    users = e.select(F.col("user_id").alias("doc_id")).distinct()
    aliases = users.withColumn("alias", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(29).cast("long")))).withColumns({"node": F.col("alias"), "assignable": F.col("alias") % 2 == 0})
    return reports.reference_findings(answers, aliases, users.withColumn("packet_hash", F.lit("0"))).select("doc_id", "alias", "reason", "node")


@query("""with s as (select user_id, event_id, event_id // 3 as first, event_id // 3 + event_id % 5 as last from events where event_id < 3000), n as (select s.event_id, s.user_id, count(*) filter (x % 50 <> 0) as own, count_if(x % 50 = 0) as ctx, count_if(x > 900 or x < 1) as bad from s, unnest(range(first, last + 1)) t(x) group by all)
select user_id as doc_id, event_id::varchar as id, case when bad > 0 then 'invalid range' when ctx > 0 then 'range crosses read-only context' end as finding, case when bad = 0 and ctx = 0 then own end as n_refs from n""")
def range_groups(spark, sf_dir):
    """Groups from ranges over 900 numbered sources, every fiftieth of which is read-only."""
    e = table(spark, sf_dir, "events").where("event_id < 3000")
    spans = e.select(F.col("user_id").alias("doc_id"), F.col("event_id").cast("string").alias("id"), F.floor(F.col("event_id") / 3).alias("first"), (F.floor(F.col("event_id") / 3) + F.col("event_id") % 5).alias("last"))
    numbers = e.select(F.col("user_id").alias("doc_id")).distinct().withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(900).cast("long")))).withColumns({"node": F.col("n"), "owned": F.col("n") % 50 != 0})
    found = groups.decode_ranges(spans, numbers)
    return found.select("doc_id", "id", "finding", F.when(F.col("refs").isNotNull(), F.size("refs")).cast("long").alias("n_refs"))


@query("""select event_id as node, round(greatest(0, x) / 80 * 100, 6) as left_pct, round((least(80, x + w) - greatest(0, x)) / 80 * 100, 6) as width_pct, row_number() over (order by (least(80, x + w) - greatest(0, x)) * (least(60, y + h) - greatest(0, y)) desc, event_id) as draw
from (select event_id, (event_id % 130 - 20)::double as x, (event_id % 90 - 10)::double as y, (event_id % 17)::double as w, (event_id % 13 + 1)::double as h from events where event_id < 4000) where least(80, x + w) > greatest(0, x) and least(60, y + h) > greatest(0, y)""")
def clipped_boxes(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_id < 4000")
    k = F.col("event_id")
    r = e.select(F.lit(0).alias("doc_id"), k.alias("node"), (k % 130 - 20).cast("double").alias("x"), (k % 90 - 10).cast("double").alias("y"), (k % 17).cast("double").alias("w"), (k % 13 + 1).cast("double").alias("h"))
    c = release.clipped(r, F.lit(80.0), F.lit(60.0))
    area = (F.col("width_pct") / 100 * 80).cast("long") * (F.col("height_pct") / 100 * 60).cast("long")
    return c.drop("draw").withColumn("area", area).select("node", F.round("left_pct", 6).alias("left_pct"), F.round("width_pct", 6).alias("width_pct"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.round(F.col("width_pct") * F.col("height_pct"), 6)), "node")).cast("long").alias("draw"))


@query("""with l as (select o_orderkey % 100 as k, count(*) as n from orders group by 1), r as (select l_orderkey % 120 as k, count(*) as n from lineitem where l_linenumber = 1 and l_orderkey % 120 > 40 group by 1)
select coalesce(l.k, r.k) as k, case when r.k is null then 'only left' when l.k is null then 'only right' else 'repeated' end as problem from l full join r on l.k = r.k where r.k is null or l.k is null or l.n > 1 or r.n > 1""")
def one_to_one(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 100).alias("k"))
    l = table(spark, sf_dir, "lineitem").where("l_linenumber = 1 and l_orderkey % 120 > 40").select((F.col("l_orderkey") % 120).alias("k"))
    return records.one_to_one(o, l, ["k"])


@query("select p_partkey as id, case when p_partkey % 3 = 0 then 'new' else p_brand end as label from part union all select 1000000 + s_suppkey, 'new' from supplier")
def upserted_catalog(spark, sf_dir):
    """A catalog with some entries replaced, and more added. Ids of parts go beyond those that suppliers begin with, so an entry is known by its source and id."""
    p, s = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    entry = lambda source, id_, label: [F.lit(source).alias("source"), id_.alias("id"), label.alias("label")]
    parts = p.select(*entry("part", F.col("p_partkey"), F.col("p_brand")))
    new = parts.where("id % 3 = 0").withColumn("label", F.lit("new")).unionByName(s.select(*entry("supplier", 1_000_000 + F.col("s_suppkey"), F.lit("new"))))
    return records.upserted(parts, new, ["source", "id"]).select("id", "label")


@query("""select conv_id, turn, list_sort(list_filter([role, 'user', 'x' || (turn % 3)], lambda c: not list_contains(['user', 'x1'], c)))[1] as first_warning from conversations""")
def decision_warnings(spark, sf_dir):
    """Cited cues that were not among those shown."""
    cues = F.array("role", F.lit("user"), F.concat(F.lit("x"), (F.col("turn") % 3).cast("string")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.get(F.array_sort(reports.decision_warnings(cues, F.array(F.lit("user"), F.lit("x1")))), F.lit(0)).alias("first_warning"))


@query("select doc_id, least(200, 2048 - (n_chars // 4))::bigint as cap, case when doc_id % 2 = 0 then 'eos' when n_chars >= 1000 then 'token_limit' when n_chars >= 500 then 'time_limit' else 'other' end as stop from documents where least(200, 2048 - (n_chars // 4)) >= doc_id % 300")
def generation_caps(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    cap = tx.generation_cap(F.floor(F.col("n_chars") / 4), F.col("doc_id") % 300, 2048, 200)
    stop = tx.stop_reason(F.col("doc_id") % 2 == 0, F.col("n_chars"), F.lit(1000), F.col("n_chars") / 100, 5.0)
    return d.select("doc_id", cap.cast("long").alias("cap"), stop.alias("stop")).where("cap is not null")


@query("select page_id, sha256('v1:m:' || url) as key, regexp_replace('http://h/key/' || page_id || '/x?y', '/key/[^/?#]+', '/key/SESSION') as masked, concat_ws('. ', nullif(trim(substr(url, 1, 4)), ''), 'page ' || page_id) as said, lower(regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1)) = 'https://the.example.org' as same from pages")
def page_keys(spark, sf_dir):
    """Cache keys, masked sessions, narration and origins."""
    u, k = F.col("url"), F.col("page_id").cast("string")
    return table(spark, sf_dir, "pages").select(
        "page_id", tx.cache_key(F.lit("m"), u).alias("key"), tx.masked_session(F.concat(F.lit("http://h/key/"), k, F.lit("/x?y"))).alias("masked"), tx.narration(F.substring(u, 1, 4), F.lit(" "), F.concat(F.lit("page "), k)).alias("said"),
        release.same_origin(u, F.lit("HTTPS://the.example.org/other")).alias("same"),
    )


@query("""with u as (select user_id as doc_id, array_agg(distinct event_type) as said, array_agg(distinct event_type) filter (event_id % 2 = 0) as claimed from events group by 1)
select doc_id, array_to_string(list_sort(list_filter(said, lambda x: not coalesce(list_contains(claimed, x), false))), ',') as unclaimed, array_to_string(list_sort(list_filter(said, lambda x: x <> 'view')), ',') as unreached, array_to_string(list_sort(list_filter(said, lambda x: x in ('view', 'click', 'zz'))), ',') as assignable from u""")
def ref_sets(spark, sf_dir):
    """Differences and intersections of sets of references."""
    u = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc_id")).agg(F.collect_set("event_type").alias("said"), F.collect_set(F.when(F.col("event_id") % 2 == 0, F.col("event_type"))).alias("claimed"))
    d = reports.ref_differences(F.col("said"), F.col("claimed"), F.array(F.lit("view")))
    return u.select("doc_id", F.array_join(d["unclaimed"], ",").alias("unclaimed"), F.array_join(d["unreached"], ",").alias("unreached"), F.array_join(release.assignable(F.col("said"), F.array(F.lit("view"), F.lit("click"), F.lit("zz"))), ",").alias("assignable"))


@query("select event_id, event_id % 2 = 0 as closed from events")
def closed_records(spark, sf_dir):
    """Whether records have exactly the fields they may have."""
    record = F.when(F.col("event_id") % 4 == 0, '{"b": 1, "a": null}').when(F.col("event_id") % 4 == 1, '{"a": 1}').when(F.col("event_id") % 4 == 2, '{"a": 1, "b": {"c": 2}}').otherwise("[1]")
    return table(spark, sf_dir, "events").select("event_id", reports.same_keys(record, ["a", "b"]).alias("closed"))


@query("""select event_type as name, count(*) as n from events where value is not null group by 1""")
def verified_artifacts(spark, sf_dir):
    """Files with the length and hash that a list has for them, by kind: none differs."""
    e = table(spark, sf_dir, "events").select(F.concat_ws("-", "event_type", F.col("event_id").cast("string")).alias("name"), F.col("props").cast("binary").alias("content"))
    found = e.select("name", F.length("content").cast("long").alias("n_bytes"), F.sha2("content", 256).alias("sha256"), "content")
    listed = found.select("name", "n_bytes", "sha256")
    ok = records.verified(found, listed).where("problem is null")
    return ok.groupBy(F.substring_index("name", "-", 1).alias("name")).agg(F.count("*").alias("n"))


@query("""select event_type, sum(case when event_id % 2 = 0 then 2 else 1 end)::bigint as total, count(*) as n from events group by 1""")
def carried_totals(spark, sf_dir):
    """Totals of an earlier session and of this one."""
    e = table(spark, sf_dir, "events").select("event_type", F.lit(1).alias("n"), F.when(F.col("event_id") % 2 == 0, 2).otherwise(1).alias("total"))
    return reports.carried_over(e.limit(0), e, ["event_type"], ["n", "total"]).select("event_type", "total", "n")


@query("""select user_id, count(*) as lines, max_by(props, event_id) as last from events group by 1""")
def last_log_lines(spark, sf_dir):
    return reports.last_states(table(spark, sf_dir, "events").withColumn("line", F.col("props")), "user_id", "event_id")


@query("select user_id, event_id, event_type <> 'error' and value >= 5 as success from events")
def strict_verdicts(spark, sf_dir):
    """Success only with a score of one and components that all pass."""
    from treeline.operators import contracts

    e = table(spark, sf_dir, "events")
    v = contracts.strict_verdict(F.when(F.col("event_type") == "error", "error").otherwise("completed"), F.when(F.col("value").isNotNull(), F.lit(1.0)), F.array(F.col("value") >= 5, F.lit(True)))
    return e.select("user_id", "event_id", (v == "success").alias("success"))


@query("select doc_id, lang, text is not null and length(text) > 0 and length(regexp_replace(trim(regexp_replace(substr(text, 1, 130), '\\s+', ' ', 'g')), ' ', ' ', 'g')) between 1 and 100 as labelled from documents")
def strict_labels(spark, sf_dir):
    """Beginnings of documents that are short enough for a label."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang", tx.strict_label(F.regexp_replace(F.substring("text", 1, 130), r"\s+", " ")).isNotNull().alias("labelled"))


@query("""with e as (select user_id as episode, event_id as step, event_type as o, 'x' as a from events), f as (select *, min(step) over (partition by episode, o) as first from e)
select episode, step, 'o' || dense_rank() over (partition by episode order by first) as observation_ref, '{"keep":"' || o || '"}' as observation from f""")
def blinded_steps(spark, sf_dir):
    """Steps without what an annotator must not see, each distinct observation once."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("episode"), F.col("event_id").alias("step"), F.to_json(F.struct(F.col("event_type").alias("keep"), F.col("value").alias("reward"))).alias("observation"), F.lit('{"model":1}').alias("action"), F.lit(None).cast("string").alias("result"))
    return judging.blinded(e, ["reward", "model"]).select("episode", "step", "observation_ref", "observation")


@query("""select user_id as k, count(*) as eligible, count_if(event_id % 3 = 0) as mapped, median(event_id % 9) filter (event_id % 3 = 0)::double as median_steps, count_if(event_id % 3 = 0 and event_id % 9 < event_id % 5) as fewer, count_if(event_id % 3 = 0 and event_id % 9 = event_id % 5) as equal from events where user_id = 7 group by 1""")
def pooled_metrics(spark, sf_dir):
    """Pooled costs of one user's events as targets: a third is mapped."""
    e = table(spark, sf_dir, "events")
    c = e.select(F.col("user_id").alias("doc_id"), (F.col("event_id") % 7).alias("linear"), (F.col("event_id") % 5).alias("quick"), F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 9).alias("steps"))
    p = groups.pooled(c, F.col("doc_id") == 7)
    return p.select(F.lit(7).cast("long").alias("k"), "eligible", "mapped", F.col("median_steps").cast("double").alias("median_steps"), "fewer", "equal")


@query("""with d as (select doc_id, lang, count(*) over (partition by lang) as n, row_number() over (partition by lang order by doc_id) as r from documents)
select doc_id, lang, n < 7 or r <= 2 or r = n or doc_id % 50 = 0 as kept from d""")
def option_samples(spark, sf_dir):
    """Documents as options of their language: of many the first two, the last and exceptions are kept."""
    from treeline.operators import compaction

    d = table(spark, sf_dir, "documents").withColumn("odd", F.col("doc_id") % 50 == 0)
    return compaction.option_sample(d, "lang", "doc_id", "odd").select("doc_id", "lang", "kept")


@query("select doc_id, quality from labels where quality = 1 except select doc_id, quality from labels where toxic = 1")
def disjoint_labels(spark, sf_dir):
    """Good documents that are not toxic, as a difference of sets."""
    l = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("quality"), "toxic")
    return l.where("quality = 1").select("doc_id", "quality").exceptAll(l.where("toxic = 1").select("doc_id", "quality")).distinct()


@query("select user_id, sum(value) * 60.0 / greatest(count(*), 0.001) as per_minute from events group by 1")
def throughputs(spark, sf_dir):
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum("value").alias("episodes"), F.count("*").cast("double").alias("seconds"))
    return traces.throughput(s, "episodes", "seconds").select("user_id", F.col("per_minute"))


@query("""with j as (select d.doc_id, quality, toxic, n_chars, lang from documents d join labels using (doc_id)), f as (select *, case when lang = 'en' then 'a' else 'b' end as g from j)
select doc_id, (case when toxic = 1 then 'reject' when lang = 'fr' or n_chars < 200 then 'insufficient_evidence' when quality <= 0 then 'revise' else 'usable' end) as decision from f""")
def hierarchy_decisions(spark, sf_dir):
    """Decisions on hierarchies: failed gates, then what is missing, then poor scores."""
    from treeline.operators import contracts

    j = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    d = contracts.hierarchy_decision(F.col("toxic") == 1, F.col("lang") != "fr", [F.when(F.col("n_chars") >= 200, F.col("quality") * 2), F.lit(3)], F.lit(None).cast("int"), F.lit(False))
    return j.select("doc_id", d.alias("decision"))


"""Registered queries of the analytics operators, each over whole tables, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treeline.functions import text as tx
from treeline.operators import compaction, contracts, dataset, navigation, observe, release, reports, traces, tree, views
from treeline.plans.registry import ORACLE, QUERIES, bigints, page_nodes, query, table
from treeline.streaming import logtail

__all__ = ["ORACLE", "QUERIES"]


# Pages: sources, scalar functions, trees.

@query("""
with l as (select page_id, 'link' as target, len(regexp_extract_all(html, '<a href=')) as n from pages
  union all select page_id, 'heading', len(regexp_extract_all(html, '<h[1-6]>')) from pages)
select page_id, target, n::bigint as n from l where n > 0""")
def page_targets(spark, sf_dir):
    """Targets by kind on each page (parse, role, hidden subtrees, target kind)."""
    return navigation.targets(page_nodes(spark, sf_dir)).groupBy(F.col("doc_id").alias("page_id"), "target").agg(F.count("*").alias("n"))


@query("""
select page_id, tag, count(*) as n from (
  select page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)[\\s>/]', 1)) as tag from pages) group by all""")
def page_elements(spark, sf_dir):
    """Elements by tag on each page."""
    return page_nodes(spark, sf_dir).where("kind = 'element' and tag <> '#document'").groupBy(F.col("doc_id").alias("page_id"), "tag").agg(F.count("*").alias("n"))


@query("select page_id, octet_length(encode(html))::bigint as n_bytes, length(html)::bigint as n_chars, sha256(html) as digest from pages")
def page_sizes(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.byte_length(F.col("html")).cast("long").alias("n_bytes"), F.length("html").cast("long").alias("n_chars"), tx.sha256(F.col("html")).alias("digest"))


_HOST = "regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\\.+$', '')"
_PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1)"


@query(f"select page_id, {_HOST} as host, {_PATH} as path, substr({_HOST} || {_PATH}, 1, 96) as destination from pages")
def page_destinations(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", tx.host(u).alias("host"), tx.url_path(u).alias("path"), tx.destination(u).alias("destination"))


@query(f"select {_HOST} as host, count(*) as n_pages, sum(octet_length(encode(html)))::bigint as n_bytes from pages group by 1")
def host_rollup(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(tx.host(F.col("url")).alias("host")).agg(F.count("*").alias("n_pages"), F.sum(F.octet_length("html")).alias("n_bytes"))


_HOSTS = [f"{m}{h}.example.{d}" for m in ("", "m.") for h in ("thre", "thther", "ththre", "ththth", "the") for d in ("org", "net", "com")]
_SAFE = f"""case when regexp_full_match(u, '#[A-Za-z0-9_-]+') then u
  when lower(split_part(u, '://', 1)) = 'https' and list_contains({_HOSTS}, lower(regexp_replace(a, ':(443)?$', ''))) and coalesce(regexp_extract(u, '[?]([^#]*)', 1), '') = ''
    and not regexp_matches(p, '(?i)(token|session|secret|password|api[_-]?key)') then 'https://' || lower(regexp_replace(a, ':(443)?$', '')) || p else '' end"""


@query(f"""
with v as (select page_id, k, u from (select page_id, unnest([0, 1, 2, 3, 4, 5, 6, 7]) as k, unnest([url, split_part(split_part(replace(url, 'http://', 'https://'), '?', 1), '#', 1), replace(url, 'http://', 'HTTPS://') || '', 'https://u:p@the.example.org/x', 'https://the.example.org:443/a#b',
  'https://the.example.org:8443/a', 'https://THE.example.org/my-session/' || page_id, '#part-' || page_id]) as u from pages)),
x as (select *, regexp_extract(u, '^[A-Za-z]+://([^/?#]*)', 1) as a, regexp_extract(u, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) as p from v)
select page_id, k::bigint as k, {_SAFE} as safe from x""")
def safe_urls(spark, sf_dir):
    """What is left of a page's URL, and of variants of it with a user, ports, a fragment and token-like words, if only some hosts are allowed."""
    u = F.col("url")
    made = [u, F.substring_index(F.substring_index(F.replace(u, F.lit("http://"), F.lit("https://")), "?", 1), "#", 1), F.replace(u, F.lit("http://"), F.lit("HTTPS://")), F.lit("https://u:p@the.example.org/x"), F.lit("https://the.example.org:443/a#b"),
            F.lit("https://the.example.org:8443/a"), F.concat(F.lit("https://THE.example.org/my-session/"), F.col("page_id").cast("string")), F.concat(F.lit("#part-"), F.col("page_id").cast("string"))]
    v = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.array(*made)).alias("k", "u"))
    return v.select("page_id", F.col("k").cast("long").alias("k"), tx.safe_url(F.col("u"), _HOSTS).alias("safe"))


@query()
def page_structure(spark, sf_dir):
    return tree.structure(page_nodes(spark, sf_dir))


@query()
def page_jump_costs(spark, sf_dir):
    return navigation.jump_cost(navigation.targets(page_nodes(spark, sf_dir))).drop("attributes")


@query()
def page_jump_summary(spark, sf_dir):
    return navigation.summary(navigation.jump_cost(navigation.targets(page_nodes(spark, sf_dir))), "jump", ["doc_id", "target"])


@query()
def page_roles(spark, sf_dir):
    return observe.observe(page_nodes(spark, sf_dir)).where("kind = 'element'").groupBy("doc_id", "role").agg(F.count("*").alias("n"))


@query()
def page_path_costs(spark, sf_dir):
    return tree.path_cost(page_nodes(spark, sf_dir))


@query()
def page_headings_before(spark, sf_dir):
    return tree.preceding_heading(page_nodes(spark, sf_dir), F.col("tag").rlike("^h[1-6]$")).select("doc_id", "node", "heading")


@query()
def page_templates(spark, sf_dir):
    """Signatures of start and end tags."""
    return dataset.template_of(table(spark, sf_dir, "pages"))


@query()
def page_views(spark, sf_dir):
    """Views of pages under a budget, with sizes, status and broken promises."""
    return views.views(page_nodes(spark, sf_dir), "budget", 3_000)


@query()
def page_view_ledger(spark, sf_dir):
    return views.view_ledger(page_nodes(spark, sf_dir), "budget", 3_000)


@query()
def page_view_regions(spark, sf_dir):
    """Regions of pages that fit a budget each."""
    return views.view_regions(page_nodes(spark, sf_dir), "structure", 2_000)


@query()
def page_navigation(spark, sf_dir):
    """What a reader moves through on each page."""
    return views.navigation(page_nodes(spark, sf_dir), "structure", 1 << 30)


@query("select page_id as doc_id, name, sum(octet_length(encode(name || value)))::bigint as n_bytes from (select page_id, unnest(regexp_extract_all(html, '<[a-z0-9]+ (class|charset)=\"[^\"]*\"', 1)) as name, unnest(regexp_extract_all(html, '<[a-z0-9]+ (?:class|charset)=\"([^\"]*)\"', 1)) as value from pages) group by all")
def page_removed_attributes(spark, sf_dir):
    """Bytes of attributes that compaction does not keep."""
    return reports.removed_attribute_bytes(page_nodes(spark, sf_dir).where("kind = 'element'"), [*compaction.KEEP, "href"])


@query()
def page_languages_inherited(spark, sf_dir):
    return tree.inherited(page_nodes(spark, sf_dir), F.col("attributes")["lang"], "lang").groupBy("doc_id", "lang").agg(F.count("*").alias("n"))


@query()
def page_search(spark, sf_dir):
    return tree.search(page_nodes(spark, sf_dir), F.coalesce("text", F.lit("")), "ing")


@query()
def page_compact(spark, sf_dir):
    return compaction.compact_html(page_nodes(spark, sf_dir), 4_000)


@query()
def page_ledger(spark, sf_dir):
    return compaction.ledger(page_nodes(spark, sf_dir), 4_000)


@query()
def page_recovery(spark, sf_dir):
    return compaction.recovery_report(page_nodes(spark, sf_dir))


@query()
def page_regions(spark, sf_dir):
    return compaction.partition_regions(page_nodes(spark, sf_dir), 40)


@query("""
select page_id, len(regexp_extract_all(html, '<li>'))::bigint as n_items, len(regexp_extract_all(html, '<p>'))::bigint as n_paragraphs from pages""")
def page_lists(spark, sf_dir):
    """Items and paragraphs of each page, by nearest ancestors: items are those in some list."""
    n = page_nodes(spark, sf_dir)
    near = tree.nearest_flagged(n.where("tag = 'li'"), n.where("tag in ('ul', 'ol')")).groupBy("doc_id").agg(F.count("nearest").alias("n_items"))
    p = n.groupBy("doc_id").agg(F.count_if(F.col("tag") == "p").alias("n_paragraphs"))
    return p.join(near, "doc_id", "left").select(F.col("doc_id").alias("page_id"), F.coalesce("n_items", F.lit(0)).alias("n_items"), "n_paragraphs")


# Documents: text functions, duplicates, families, splits, admission.

_BLANK = "[\\t\\n\\x0B\\f\\r \\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]+"


@query(f"select doc_id, sha256(trim(regexp_replace(text, '{_BLANK}', ' ', 'g'))) as digest, length(trim(regexp_replace(text, '{_BLANK}', ' ', 'g')))::bigint as n_chars from documents")
def collapsed_text(spark, sf_dir):
    c = tx.collapse(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(c, 256).alias("digest"), F.length(c).cast("long").alias("n_chars"))


@query("""
with h as (select doc_id, text, substr(text, 1, 180) as head from documents),
c as (select *, case when strpos(head, ' ') > 0 then 180 - strpos(reverse(head), ' ') + 1 end as cut from h)
select doc_id, case when length(text) <= 180 then text when cut * 2 >= 180 then rtrim(substr(text, 1, cut - 1), ' ') || '…' else head || '…' end as excerpt from c""")
def excerpts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.excerpt(F.col("text"), 180).alias("excerpt"))


_OK_HOSTS = ["example.org", "www.example.com"]


def _sql(text: str) -> str:
    return text.replace("'", "''")


_SECRET = " or ".join(f"regexp_matches(text, '{_sql(p)}')" for p in [tx.CREDENTIAL, *tx.SECRETS.values()])


@query(f"""
with c as (select doc_id, text, ({_SECRET}) as secret, regexp_replace(regexp_replace(text, '{_sql(tx.LOCAL_PATH)}', '[omitted]', 'g'), '{_sql(tx.EMAIL)}', '[omitted]', 'g') as t from documents),
s as (select doc_id, text, secret, t, list_transform(regexp_extract_all(t, '{_sql(tx.URL)}'), lambda u: case when regexp_matches(u, '^https://(example.org|www.example.com)(:443|:)?(/[^?#]*)?[?]?(#.*)?$')
    and not regexp_matches(regexp_extract(u, '^https://[^/?#]*([^?#]*)', 1), '{_sql(tx.TOKEN_WORD)}') then 'https://' || regexp_extract(u, '^https://([^/?#:]*)', 1) || regexp_extract(u, '^https://[^/?#]*([^?#]*)', 1) else '[omitted]' end) as urls,
  string_split_regex(t, '{_sql(tx.URL)}') as parts from c)
select doc_id, secret, sha256(case when secret then '[omitted]' else array_to_string(list_transform(range(1, len(parts) + 1), lambda i: parts[i] || coalesce(urls[i], '')), '') end) as digest,
  len(regexp_extract_all(text, '{_sql(tx.EMAIL)}'))::bigint as n_email, len(regexp_extract_all(text, '{_sql(tx.URL)}'))::bigint as n_url from s""")
def private_text(spark, sf_dir):
    """Safe text of every document, whether it holds a secret, and counts of addresses."""
    t = F.col("text")
    counts = tx.private_counts(t)
    safe = table(spark, sf_dir, "documents").select("doc_id", tx.has_secret(t).alias("secret"), F.sha2(tx.safe_text(t, _OK_HOSTS), 256).alias("digest"), *(counts[c].cast("long").alias(c) for c in ("n_email", "n_url")))
    return safe


@query("""
with d as (select doc_id, coalesce(text, '') || chr(10) || case doc_id % 4 when 0 then 'key AKIA' || repeat('Q', 16) when 1 then 'bearer ' || repeat('a', 30) || ' or Bearer ' || repeat('b', 24) when 2 then 'sk-' || repeat('z', 27) else '' end as text from documents),
l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as place from d),
k as (select doc_id, place, unnest([""" + ", ".join(f"{{'type': '{k}', 'n': len(regexp_extract_all(line, '{_sql(p)}'))}}" for k, p in tx.SECRETS.items()) + """]) as k from l)
select doc_id::varchar as path, place::bigint as line, k.type as type, sum(k.n)::bigint as n from k where k.n > 0 group by all""")
def secret_places(spark, sf_dir):
    """Kinds and places of secrets, by line, in documents with a line behind them that holds one, two or none."""
    k = F.col("doc_id") % 4
    last = F.when(k == 0, "key AKIA" + "Q" * 16).when(k == 1, "bearer " + "a" * 30 + " or Bearer " + "b" * 24).when(k == 2, "sk-" + "z" * 27).otherwise("")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), last).alias("text"))
    return release.secret_findings(d, "path", "text").where("line > 0").groupBy("path", F.col("line").cast("long").alias("line"), "type").agg(F.count("*").alias("n"))


@query("""
select doc_id, sha256(text) as digest, coalesce(doc_id > min(case when n_chars >= 200 then doc_id end) over (partition by sha256(text)), false) as duplicate from documents""")
def duplicate_documents(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumn("digest", F.sha2("text", 256))
    return dataset.duplicate_gate(rows, "doc_id", "digest", F.col("n_chars") >= 200).select("doc_id", "digest", "duplicate")


@query("""
with g as (select doc_id, min(doc_id) over (partition by sha256(text)) as first from documents where n_chars >= 100)
select d.doc_id, case when g.doc_id is null then 'skipped' when g.first < d.doc_id then 'duplicate' else 'ready' end as status, case when g.first < d.doc_id then g.first end as duplicate_of
from documents d left join g on g.doc_id = d.doc_id""")
def corpus_inventory(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.sha2("text", 256).alias("sha"), F.col("doc_id").cast("string").alias("path"))
    return dataset.inventory(rows, "doc_id", "path", "sha", F.col("n_chars") >= 100).select("doc_id", "status", "duplicate_of")


_FAMILIES = """
recursive t as (select doc_id as k, 'd:' || sha256(text) as v from documents union select doc_id, 'l:' || split_part(text, chr(10), 1) from documents where strpos(text, chr(10)) > 0),
a as materialized (select v, min(k) as k0 from t group by v),
e as materialized (select t.k as x, a.k0 as y from t join a using (v) where t.k <> a.k0),
b as materialized (select x, y from e union select y, x from e),
r(k, f) as (select doc_id, doc_id from documents union select b.x, r.f from r join b on b.y = r.k),
fam as (select k as doc_id, min(f) as family from r group by k)"""


def _family_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    line = F.when(F.instr("text", "\n") > 0, F.split("text", "\n", 2)[0])
    return dataset.families(docs.select("doc_id", F.sha2("text", 256).alias("digest"), line.alias("line")), "doc_id", ["digest", "line"])


@query(f"with {_FAMILIES} select doc_id, family from fam")
def document_families(spark, sf_dir):
    """Documents that share their text or their first line, directly or through others."""
    return _family_rows(spark, sf_dir)


@query(f"""with {_FAMILIES},
f as (select family, row_number() over (order by sha256('seed|' || family::varchar), family) as r, count(*) over () as n from (select distinct family from fam)),
s as (select family, r, case when n >= 3 then greatest(1, round_even(0.15 * n, 0)) else 0 end as test, case when n >= 2 then greatest(1, round_even(0.15 * n, 0)) else 0 end as dev0, n from f),
p as (select family, case when r <= test then 'test' when r <= test + greatest(0, least(dev0, n - test - 1)) then 'dev' else 'train' end as split from s)
select p.split, count(*) as n_documents, count(distinct family) as n_families from fam join p using (family) group by 1""")
def family_splits(spark, sf_dir):
    return dataset.family_split(_family_rows(spark, sf_dir), "seed").groupBy("split").agg(F.count("*").alias("n_documents"), F.countDistinct("family").alias("n_families"))


def _admitted(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return dataset.admission(rows, {"short": F.col("n_chars") < 300, "low quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1, "unlabelled": F.col("quality").isNull()})


_REASONS = """
r as (select d.doc_id, list_filter([case when n_chars < 300 then 'short' end, case when quality = 0 then 'low quality' end, case when toxic = 1 then 'toxic' end, case when quality is null then 'unlabelled' end], lambda x: x is not null) as reasons
  from documents d left join labels l on l.doc_id = d.doc_id)"""


@query(f"with {_REASONS} select doc_id, array_to_string(reasons, ',') as reasons, len(reasons) = 0 as accepted from r")
def admitted_documents(spark, sf_dir):
    return _admitted(spark, sf_dir).select("doc_id", F.array_join("reasons", ",").alias("reasons"), "accepted")


@query(f"""with {_REASONS} select case when len(reasons) = 0 then 'accepted' else 'rejected' end as item, count(*) as n from r group by 1
union all select 'reason:' || x as item, count(*) from (select unnest(reasons) as x from r) group by 1""")
def admission_manifest(spark, sf_dir):
    return dataset.manifest(_admitted(spark, sf_dir))


@query("select doc_id, octet_length(encode(text))::bigint as n_tokens, case when octet_length(encode(text)) > 4096 then 'overlength' end as reason from documents")
def overlength_documents(spark, sf_dir):
    return dataset.length_admission(table(spark, sf_dir, "documents").select("doc_id", "text"), F.octet_length("text").cast("long"), 4096).select("doc_id", "n_tokens", "reason")


@query("select doc_id, (10000 // count(*) over (partition by lang) + (row_number() over (partition by lang order by doc_id) <= 10000 % count(*) over (partition by lang))::int)::bigint as share from documents")
def budget_shares(spark, sf_dir):
    return dataset.budget_split(table(spark, sf_dir, "documents"), 10000, ["lang"], "doc_id").select("doc_id", "share")


@query("select doc_id from documents order by sha256('s|' || doc_id::varchar), doc_id limit 40")
def seeded_documents(spark, sf_dir):
    """A seeded sample of 40, which is the feature."""
    return dataset.seeded_sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "s", 40)


@query("select lang, quality::bigint as quality, count(*) as n, sum(n_chars)::bigint as chars from documents join labels using (doc_id) group by rollup (lang, quality)")
def label_rollup(spark, sf_dir):
    """Built-in grouping sets over documents and labels."""
    j = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("lang", F.col("quality").cast("long").alias("quality"), "n_chars")
    return j.rollup("lang", "quality").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("select lang from documents where doc_id % 2 = 0 intersect select lang from documents where doc_id % 2 = 1")
def shared_languages(spark, sf_dir):
    """What a split by parity would leak: values that both sides have."""
    d = table(spark, sf_dir, "documents")
    return dataset.disjoint(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1"), ["lang"])


# Conversations: windows over ordered rows, outline contracts.

_TURN = "row_number() over (partition by conv_id order by turn)"


@query("""
with x as (select *, lag(role) over (partition by conv_id order by turn) as last, lead(role) over (partition by conv_id order by turn) as next from conversations)
select conv_id, count(*) as turns, count_if(last = role) as repeated_role, count_if(role = 'user' and coalesce(next, '') <> 'assistant') as unanswered from x group by 1""")
def turn_contract(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    x = table(spark, sf_dir, "conversations").withColumns({"last": F.lag("role").over(w), "next": F.lead("role").over(w)})
    return x.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("last") == F.col("role")).alias("repeated_role"), F.count_if((F.col("role") == "user") & (F.coalesce("next", F.lit("")) != "assistant")).alias("unanswered"))


@query("select conv_id, turn, least(8, row_number() over (partition by conv_id order by turn) - 1)::bigint as n_history, coalesce(array_to_string(list(role) over (partition by conv_id order by turn rows between 8 preceding and 1 preceding), ','), '') as roles from conversations")
def turn_history(spark, sf_dir):
    h = traces.history(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role")
    return h.select("conv_id", "turn", F.size("history").cast("long").alias("n_history"), F.array_join("history", ",").alias("roles"))


@query("""
with f as (select conv_id, turn, min(turn) over (partition by conv_id, sha256(role)) as first from conversations)
select conv_id, turn, 'o' || dense_rank() over (partition by conv_id order by first) as id from f""")
def first_seen_roles(spark, sf_dir):
    return traces.first_seen_ids(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role")).select("conv_id", "turn", "id")


@query("""
select conv_id, turn, ((row_number() over (partition by conv_id order by turn) - 1) // 3)::bigint as page, ((row_number() over (partition by conv_id order by turn) - 1) % 3)::bigint as place,
  greatest(1, ceil(count(*) over (partition by conv_id) / 3.0))::bigint as n_pages from conversations""")
def turn_pages(spark, sf_dir):
    return bigints(traces.pages(table(spark, sf_dir, "conversations"), "conv_id", "turn", 3).select("conv_id", "turn", "page", "place", "n_pages"))


def _outline(spark, sf_dir):
    """Conversations as outlines: systems and users are groups, answers are units that refer to their own turn's parity."""
    c = table(spark, sf_dir, "conversations")
    depth = F.when(F.col("role") == "system", 0).when(F.col("role") == "user", F.when(F.col("turn") == 0, 0).otherwise(1)).otherwise(2)
    refs = F.when(F.col("role") == "assistant", F.array((F.col("turn") % 4).cast("string"))).otherwise(F.array().cast("array<string>"))
    return c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("line"), depth.alias("depth"), F.substring("text", 1, 60).alias("label"), refs.alias("refs"))


_OUTLINE = """
o as (select conv_id as doc_id, turn as line, case when role = 'system' then 0 when role = 'user' then (case when turn = 0 then 0 else 1 end) else 2 end as depth, substr(text, 1, 60) as label, role = 'assistant' as unit, turn % 4 as ref from conversations),
x as (select *, lag(depth) over (partition by doc_id order by line) as last, lead(depth) over (partition by doc_id order by line) as next from o)"""


@query(f"""with {_OUTLINE}
select doc_id, line, 'error' as level, 'first line is not at depth 0' as finding from x where last is null and depth <> 0
union all select doc_id, line, 'error', 'depth jumps' from x where depth > last + 1
union all select doc_id, line, 'error', 'root has refs' from x where last is null and unit
union all select doc_id, line, 'error', 'second root' from x where last is not null and depth = 0
union all select doc_id, line, 'error', 'label is blank or over 100' from x where trim(label) = '' or length(label) > 100
union all select doc_id, line, 'error', 'group without children' from x where not unit and coalesce(next, -1) <> depth + 1
union all select doc_id, line, 'error', 'unit with children' from x where unit and coalesce(next, -1) > depth
union all select doc_id, line, 'warning', 'ref of line ' || first from (select doc_id, line, min(line) over (partition by doc_id, ref) as first from x where unit) where line > first""")
def outline_findings(spark, sf_dir):
    return contracts.outline_findings(_outline(spark, sf_dir))


@query(f"with {_OUTLINE} select doc_id, count(*) as lines, count_if(not unit) as groups, count_if(unit) as units, max(depth)::bigint as max_depth, count(distinct case when unit then ref end) as refs from x group by 1")
def outline_reports(spark, sf_dir):
    return bigints(contracts.outline_report(_outline(spark, sf_dir)))


@query(f"with {_OUTLINE} select a.doc_id, a.line, max(b.line) as parent from x a left join x b on a.doc_id = b.doc_id and b.line < a.line and b.depth < a.depth group by 1, 2")
def outline_parents(spark, sf_dir):
    return contracts.outline_parents(_outline(spark, sf_dir)).select("doc_id", "line", "parent")


# Events: trials, stages, budgets, windows.

_VERDICT = "case when event_type = 'error' then 'failure' when event_type = 'click' then 'success' else 'unavailable' end"


@query(f"select user_id, count(*) as n, count_if(v = 'success') as success, count_if(v = 'failure') as failure, count_if(v = 'unavailable') as unavailable, median(value) as median_value from (select *, {_VERDICT} as v from events) group by 1")
def trial_table(spark, sf_dir):
    return traces.trial_table(table(spark, sf_dir, "events").withColumn("v", F.expr(_VERDICT)), ["user_id"], "v", ["value"])


@query("select user_id, count_if(event_type = 'error') > 0.25 * count(*) as noisy, count(*) as attempts from events group by 1")
def stage_health(spark, sf_dir):
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("attempts"), F.count_if(F.col("event_type") == "error").alias("refused"))
    s = s.withColumns({"episodes": F.lit(2), "infra_errors": F.lit(0), "annotated": F.lit(2)})
    return traces.stage_health(s).select("user_id", F.array_contains("reasons", "too many refusals").alias("noisy"), "attempts")


@query("select user_id, 'k' as key, sum(cast(json_extract_string(props, '$.k') as bigint))::bigint as total from events where json_extract_string(props, '$.k') is not null group by 1")
def usage_totals(spark, sf_dir):
    calls = table(spark, sf_dir, "events").select("user_id", F.from_json("props", "map<string,bigint>").alias("usage"))
    return traces.usage_totals(calls, ["user_id"], "usage")


@query("""
with a as (select event_id, user_id, epoch_us(ts) / 1e6 as ts, row_number() over (order by ts, event_id) as place from events),
b as (select *, row_number() over (partition by user_id order by place) as nth from a where place <= 5000)
select event_id, user_id, place, true as admitted, round(max(ts - nth * 30.0) over (partition by user_id order by place) + nth * 30.0, 3) as start from b
union all select event_id, user_id, place, false, null from a where place > 5000""")
def admission_ledger(spark, sf_dir):
    """A budget of 5000 starts, 30 seconds apart for each user, replayed over all events."""
    r = table(spark, sf_dir, "events").select(F.col("event_id").alias("request"), F.col("user_id").alias("model"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"))
    return traces.admission_ledger(r, 5000, 30.0).select(F.col("request").alias("event_id"), F.col("model").alias("user_id"), F.col("place").cast("long").alias("place"), "admitted", F.round("start", 3).alias("start"))


@query("select event_type, (epoch_us(date_trunc('hour', ts)) // 1000000)::bigint as start, count(*) as n, round(sum(value), 2) as total from events group by all")
def hourly_events(spark, sf_dir):
    """Tumbling windows; the same plan runs on a stream."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return logtail.windowed(e, "ts", "event_type", "value").select("event_type", F.unix_seconds("start").alias("start"), "n", F.round("total", 2).alias("total"))


@query("""
with x as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end as new from events),
y as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from x)
select user_id, (epoch_us(min(ts)) // 1000)::bigint as start_ms, count(*) as n from y group by user_id, s""")
def user_sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return logtail.sessions(e, "ts", "user_id").select("user_id", F.unix_millis("start").alias("start_ms"), "n")


@query("""
select event_id, case when event_type <> 'error' then round(last_value(case when event_type <> 'error' then value end ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) - value, 6) end as saved from events""")
def stage_deltas(spark, sf_dir):
    return traces.stage_delta(table(spark, sf_dir, "events"), "user_id", "event_id", "value", F.col("event_type") != "error").select("event_id", F.round("saved", 6).alias("saved"))


_DIGIT = "substr('0123456789abcdefghijklmnopqrstuvwxyz', ((r // {}) % 36 + 1)::bigint, 1)"


@query(f"""
with f as (select event_type, user_id, min(event_id) as first from events group by 1, 2),
n as (select event_type, user_id, row_number() over (partition by event_type order by first) - 1 as r from f)
select event_type, user_id, 'u' || coalesce(nullif(ltrim({' || '.join(_DIGIT.format(36**k) for k in (5, 4, 3, 2, 1, 0))}, '0'), ''), '0') as alias from n""")
def destination_aliases(spark, sf_dir):
    """Users numbered by first appearance within each type, in base 36."""
    first = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.min("event_id").alias("first"))
    return compaction.aliases(first, "event_type", "first", "u").select("event_type", "user_id", "alias")


# Labels, orders, lineitem: decisions, preferences, calibration, quantiles.

@query("""
select n, pages, domains, accepts, rejects, round(agreement, 9) as agreement, round(far, 9) as false_accept_rate, n >= 20 and pages >= 10 and domains >= 3 and accepts >= 5 and rejects >= 5 and agreement >= 0.8 and far <= 0.1 as calibrated from (
select count(*) as n, count(distinct doc_id) as pages, count(distinct source) as domains, count_if(quality = 1) as accepts, count_if(quality <> 1) as rejects,
  avg(((toxic = 0 and n_chars > 100) = (quality = 1))::int) as agreement, count_if(toxic = 0 and n_chars > 100 and quality <> 1) / greatest(count_if(quality <> 1), 1) as far from labels join documents using (doc_id))""")
def calibration_gate(spark, sf_dir):
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    m = contracts.calibration(j, (F.col("toxic") == 0) & (F.col("n_chars") > 100), F.col("quality") == 1, "doc_id", "source")
    return contracts.calibrated(m).select("n", "pages", "domains", "accepts", "rejects", F.round("agreement", 9).alias("agreement"), F.round("false_accept_rate", 9).alias("false_accept_rate"), "calibrated")


@query("""
select doc_id, case when n_chars < 20 or toxic = 1 then 'reject' when source = 'src0' then 'insufficient_evidence' when least(quality * 3, 2) >= 2 then 'accept' else 'revise' end as decision,
  case when lang <> 'en' then least(quality * 3, 2) / 3.0 end as reward from labels join documents using (doc_id)""")
def teacher_decisions(spark, sf_dir):
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    scores = [F.col("quality") * 3, F.lit(2)]
    split = F.when(F.col("lang") != "en", "train").otherwise("dev")
    return j.select("doc_id", contracts.teacher_decision(F.col("n_chars") < 20, F.col("toxic") == 1, F.col("source") != "src0", scores).alias("decision"), contracts.reward(scores, split, F.lit(True)).alias("reward"))


@query("""
select a.l_orderkey, a.l_linenumber::bigint as chosen, b.l_linenumber::bigint as rejected, (a.l_quantity - b.l_quantity + a.l_tax * 100 - b.l_tax * 100)::bigint as margin
from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_linenumber <> b.l_linenumber and a.l_quantity >= b.l_quantity and round(a.l_tax * 100) >= round(b.l_tax * 100)
where a.l_quantity - b.l_quantity + round(a.l_tax * 100) - round(b.l_tax * 100) >= 2""".replace("(a.l_quantity - b.l_quantity + a.l_tax * 100 - b.l_tax * 100)::bigint", "(a.l_quantity - b.l_quantity + round(a.l_tax * 100) - round(b.l_tax * 100))::bigint"))
def preference_pairs(spark, sf_dir):
    """Lines of an order as candidates, by quantity and tax: who dominates whom."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), "l_quantity", F.round(F.col("l_tax") * 100).alias("tax"))
    p = contracts.preference_pairs(l, ["l_orderkey"], "line", ["l_quantity", "tax"])
    return p.select("l_orderkey", "chosen", "rejected", F.col("margin").cast("long").alias("margin"))


@query("""
select a.l_orderkey, count(*) as pairs from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_linenumber <> b.l_linenumber and a.l_returnflag <> b.l_returnflag and a.l_quantity - b.l_quantity >= 2 group by 1""")
def preference_pairs_of_content(spark, sf_dir):
    """Lines of an order by quantity; lines of one return flag count as one content and make no pair."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    return contracts.preference_pairs(l, ["l_orderkey"], "l_linenumber", ["l_quantity"], 2, "l_returnflag").groupBy("l_orderkey").agg(F.count("*").alias("pairs"))


@query("""
with r as (select l_returnflag, l_quantity, row_number() over (partition by l_returnflag order by l_quantity) as rn, count(*) over (partition by l_returnflag) as n from lineitem)
select l_returnflag, count(*) as n, median(l_quantity) as median, max(case when rn = ceil(0.9 * n) then l_quantity end) as p90, round(avg(l_quantity), 6) as mean from r group by 1""")
def quantity_quantiles(spark, sf_dir):
    s = navigation.summary(table(spark, sf_dir, "lineitem"), "l_quantity", ["l_returnflag"])
    return s.withColumn("mean", F.round("mean", 6))


@query("select l_linestatus, round(sum(l_discount * l_quantity) / sum(l_quantity), 8) as nll from lineitem group by 1")
def weighted_nll(spark, sf_dir):
    return dataset.weighted_nll(table(spark, sf_dir, "lineitem"), ["l_linestatus"], "l_discount", "l_quantity").withColumn("nll", F.round("nll", 8))


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders)")
def customers_without_orders(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@query("""
select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice), 2) as sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc, count(*) as n
from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2""")
def pricing_summary(spark, sf_dir):
    """Built-in aggregation over a filtered scan."""
    l = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp '1998-09-02 00:00:00'")
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 2).alias("sum_disc"), F.count("*").alias("n"))


@query("select n_name, count(*) as n_orders, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1")
def orders_by_nation(spark, sf_dir):
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
    return j.groupBy("n_name").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("select o_custkey, o_orderkey, rk from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rk from orders) where rk <= 3")
def top_orders(spark, sf_dir):
    """The three largest orders of each customer: a top-k report."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("rk")).where("rk <= 3")


from treeline.plans import derived, rules  # noqa: E402, F401  they register queries of their own

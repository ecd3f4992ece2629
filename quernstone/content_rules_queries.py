"""Queries of constraints, taxonomies and page windows, registered beside the others."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.operators import constraints, taxonomy
from quernstone.operators.constraints import Rule
from quernstone.registry import query

IDENTITY = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"],
    "events": ["event_id"], "documents": ["doc_id"], "embeddings": ["vec_id"], "pages": ["page_id"], "benchmark": ["item_id"], "labels": ["doc_id"], "conversations": ["conv_id", "turn"],
}
RULES = [
    Rule("region_once", "region", "unique", ("r_regionkey",)),
    Rule("region_name", "region", "matches", ("r_name",), expression="^[A-Z ]+$"),
    Rule("nation_region", "nation", "foreign", ("n_regionkey",), other="region", to=("r_regionkey",)),
    Rule("nation_one_a_region", "nation", "unique", ("n_regionkey",), where="n_nationkey < 8"),
    Rule("customer_nation", "customer", "foreign", ("c_nationkey",), other="nation", to=("n_nationkey",)),
    Rule("customer_solvent", "customer", "range", ("c_acctbal",), low=0),
    Rule("customer_segment", "customer", "enum", ("c_mktsegment",), ("AUTOMOBILE", "BUILDING", "MACHINERY")),
    Rule("supplier_there", "supplier", "required", ("s_suppkey", "s_name")),
    Rule("supplier_customer_nation", "supplier", "foreign", ("s_nationkey",), other="customer", to=("c_nationkey",)),
    Rule("part_size", "part", "range", ("p_size",), low=2, high=45),
    Rule("part_name_of_large", "part", "unique", ("p_size", "p_partkey"), where="p_size > 40"),
    Rule("part_supplier", "part", "foreign", ("p_partkey",), where="p_size = 7", other="lineitem", to=("l_partkey",)),
    Rule("order_customer", "orders", "foreign", ("o_custkey",), other="customer", to=("c_custkey",)),
    Rule("order_status", "orders", "enum", ("o_orderstatus",), ("O", "F")),
    Rule("order_priority", "orders", "matches", ("o_orderpriority",), expression="^[1-3]-"),
    Rule("order_price", "orders", "check", (), expression="o_totalprice >= 1000 or o_orderstatus = 'O'"),
    Rule("order_once_a_customer", "orders", "unique", ("o_custkey",), where="o_orderpriority = '1-URGENT'"),
    Rule("line_order", "lineitem", "foreign", ("l_orderkey",), other="orders", to=("o_orderkey",)),
    Rule("line_part", "lineitem", "foreign", ("l_partkey",), other="part", to=("p_partkey",)),
    Rule("line_supplier", "lineitem", "foreign", ("l_suppkey",), other="supplier", to=("s_suppkey",)),
    Rule("line_once", "lineitem", "unique", ("l_orderkey", "l_linenumber")),
    Rule("line_flag", "lineitem", "enum", ("l_returnflag",), ("A", "R")),
    Rule("line_discount", "lineitem", "check", (), expression="l_discount <= 0.05 or l_quantity < 10"),
    Rule("event_once", "events", "unique", ("event_id",)),
    Rule("event_user_customer", "events", "foreign", ("user_id",), other="customer", to=("c_custkey",)),
    Rule("event_type_known", "events", "enum", ("event_type",), ("click", "view", "purchase", "signup")),
    Rule("event_props", "events", "matches", ("props",), expression="^.\"k\": [0-9]{1,2}.$"),
    Rule("document_lang", "documents", "enum", ("lang",), ("en", "de", "fr")),
    Rule("document_length", "documents", "check", (), expression="n_chars = length(text)"),
    Rule("document_labelled", "documents", "foreign", ("doc_id",), other="labels", to=("doc_id",)),
    Rule("label_document", "labels", "foreign", ("doc_id",), other="documents", to=("doc_id",)),
    Rule("label_quality", "labels", "range", ("quality",), low=1),
    Rule("embedding_label", "embeddings", "range", ("label",), high=7),
    Rule("page_web", "pages", "matches", ("url",), expression="^https://www"),
    Rule("benchmark_once", "benchmark", "unique", ("item_id",)),
    Rule("turn_once", "conversations", "unique", ("conv_id", "turn")),
    Rule("turn_role", "conversations", "enum", ("role",), ("user", "assistant")),
]


def _sql(r: Rule) -> str:
    key = lambda cols: "'{' || " + " || ',' || ".join(f"'\"k{i}\":' || {c}" for i, c in enumerate(cols)) + " || '}'"
    where = f"({r.where or 'true'}) and " + " and ".join(f"{c} is not null" for c in r.columns or ("1",))
    if r.kind == "unique":
        return f"select '{r.name}' as rule, '{r.table}' as tab, {key(r.columns)} as row, count(*) as n from {r.table} where {where} group by {', '.join(r.columns)} having count(*) > 1"
    if r.kind == "foreign":
        on = " and ".join(f"o.{b} = t.{a}" for a, b in zip(r.columns, r.to, strict=True))
        return f"select '{r.name}', '{r.table}', {key(r.columns)}, count(*) from {r.table} t where {where} and not exists (select 1 from {r.other} o where {on}) group by {', '.join(r.columns)}"
    c = r.columns[0] if r.columns else ""
    broken = {
        "required": " or ".join(f"{x} is null" for x in r.columns),
        "range": " or ".join([f"{c} < {r.low}"] * (r.low is not None) + [f"{c} > {r.high}"] * (r.high is not None)),
        "enum": f"{c} not in ({', '.join(repr(v) for v in r.values)})",
        "matches": f"not regexp_matches({c}, '{r.expression}')",
        "check": f"not ({r.expression})",
    }[r.kind]
    return f"select '{r.name}', '{r.table}', {key(IDENTITY[r.table])}, 1 from {r.table} where {broken}"


@query("select rule, tab as table, row, n from (" + " union all ".join(map(_sql, RULES)) + ")")
def constraint_violations(region, nation, customer, supplier, part, orders, lineitem, events, documents, embeddings, pages, benchmark, labels, conversations):
    """Every row of the given tables that breaks one of the rules, which are data."""
    named = dict(zip(IDENTITY, (region, nation, customer, supplier, part, orders, lineitem, events, documents, embeddings, pages, benchmark, labels, conversations), strict=True))
    return constraints.violations(named, RULES, IDENTITY)


_WORDS = "regexp_extract_all(lower(p_name), '[a-z]+')"
_LABELS = f"""o as (select label, count(*) as n from (select case p_partkey % 4 when 0 then w else case p_partkey % 4 when 1 then upper(w) when 2 then upper(w[1]) || w[2:] else w || ' ' || lower(p_brand) end end as label from (select p_partkey, p_brand, unnest({_WORDS}) as w from part)) group by 1),
c as (select distinct upper(w[1]) || w[2:] as label from (select unnest({_WORDS}) as w from part where p_size > 30)),
a as (select distinct upper(w[1]) || w[2:] as label, w || ' brand#' || length(w) as alias from (select unnest({_WORDS}) as w from part))"""
_KEY = r"trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"


@query(f"""with recursive {_LABELS},
e as (select label, bool_or(cur) as curated, sum(n)::bigint as n from (select label, true as cur, 0 as n from c union all select label, false, n from o union all select alias, false, 0 from a) group by 1),
k as (select *, {_KEY.format("label")} as key from e), l as (select {_KEY.format("label")} as x, {_KEY.format("alias")} as y from a), u as (select x, y from l union select y, x from l union select key, key from k),
r as (select x, y from u union select r.x, u.y from r join u on r.y = u.x), m as (select x as key, min(y) as entry from r group by 1),
n as (select k.*, entry from k join m using (key)),
f as (select entry, arg_min(label, (not curated, not regexp_matches(label, '\\s'), not (label = array_to_string(list_transform(string_split(label, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')), -n, label)) as label, bool_or(curated) as curated, sum(n)::bigint as occurrences from n group by 1),
t as (select *, case when curated then null when contains(label, ' / ') then 'compound' when occurrences >= 4 then 'substantive' else 'long_tail' end as tier from f),
p as (select *, case when label in ('Bolt', 'Red') then 'banned' when label = 'Rod' or label = 'Gear' then 'merged' when occurrences > 60 then 'excluded' when tier in ('long_tail', 'compound') then tier end as reason, case when label in ('Rod', 'Gear') then 'Widget' end as survivor from t),
q as (select entry, label as entry_label, case when survivor not in (select label from p where reason in ('banned', 'excluded')) then survivor end as survivor, case when reason is null then 'promoted' when reason in ('long_tail', 'compound') then 'carried' else 'declined' end as outcome from p)
select n.label, coalesce(survivor, case when outcome <> 'declined' then entry_label end) as "to", case when survivor is not null then 'semantic_merge' when outcome = 'declined' then 'declined' when n.label = entry_label then 'canonical' else 'surface_variant' end as kind from n join q using (entry)""")
def taxonomy_mappings(part):
    """Where every label went, of names made from parts: case variants, aliases, merges that lead on, banned and frequent ones."""
    words = part.select("p_partkey", "p_brand", "p_size", F.explode(F.regexp_extract_all(F.lower("p_name"), F.lit("([a-z]+)"), 1)).alias("w"))
    title, k = F.initcap("w"), F.col("p_partkey") % 4
    label = F.when(k == 0, F.col("w")).when(k == 1, F.upper("w")).when(k == 2, title).otherwise(F.concat("w", F.lit(" "), F.lower("p_brand")))
    observed = words.select(label.alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    aliases = words.select(title.alias("label"), F.concat("w", F.lit(" brand#"), F.length("w").cast("string")).alias("alias")).distinct()
    found, named = taxonomy.entries(words.filter("p_size > 30").select(title.alias("label")).distinct(), observed, aliases)
    spark = part.sparkSession
    banned = spark.createDataFrame([("Bolt",), ("Red",)], "label string")
    merges = spark.createDataFrame([("Rod", "Gear"), ("Gear", "Widget")], "label string, survivor string")
    keys = spark.createDataFrame([("Widget", "widget_v0")], "label string, skill_key string")
    outcomes = taxonomy.promoted(found, banned, merges, F.col("occurrences") > 60, keys)
    return taxonomy.mappings(named, outcomes)


@query("""with p as (select l_orderkey as k, (l_partkey % 40)::int as page from lineitem group by all), x as (select k, page, row_number() over (partition by k order by page) - 1 as p, count(*) over (partition by k) as np from p), c as (select distinct k, np, case when np <= 4 then 1 else ceil(np / 3.0)::bigint end as w from x),
h as (select c.k, g.win, min(page) as first_page, max(page) as last_page from c, lateral (select unnest(range(w)) as win) g join x on x.k = c.k and (w = 1 or (p >= g.win * 3 and p < g.win * 3 + 4)) group by all),
i as (select l_orderkey as k, l_linenumber, l_partkey, l_suppkey, l_extendedprice, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as i, count(*) over (partition by l_orderkey) as n from lineitem),
s as (select k, win, n, w, (n * win) // w as lo, (n * (win + 1)) // w as hi from (select distinct i.k, n, w from i join c using (k)) z, lateral (select unnest(range(w)) as win) g),
m as (select *, case when w = 1 then 0 else greatest(0, lo - greatest(1, (hi - lo) // 4)) end as a, case when w = 1 then n else least(n, hi + greatest(1, (hi - lo) // 4)) end as b from s)
select i.k as l_orderkey, m.win as "window", (i - a) // 2 as part, first_page, last_page, l_linenumber, l_partkey from i join m on i.k = m.k and i.i >= a and i.i < b join h on h.k = m.k and h.win = m.win""")
def item_windows(lineitem):
    """An order's lines as items of a record whose pages are told by their parts."""
    pages = lineitem.select("l_orderkey", (F.col("l_partkey") % 40).cast("int").alias("page"))
    items = lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = taxonomy.page_windows(pages, items, "l_orderkey", "page", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], cap=2)
    return rows.drop("l_suppkey", "l_extendedprice")

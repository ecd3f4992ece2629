"""Queries of joins, lookups and names, registered beside the others."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quernstone import functions as Q
from quernstone.operators import relations
from quernstone.registry import query
from quernstone.sources import insert_new, replace_own, run_report, vector, vector_text
from quernstone.variants import variant, variant_sql

TITLES = ["Ch 3: Ratio and Proportion (basics)", "12) The Sum of a Series", "3 digit numbers", "Chapter 7 - averages", "ratio  &  proportion", "Straße_und-Wege", "Área : Círculos", "of the and", "Averages", "Number Series"]
_FOLD = r"trim(regexp_replace(replace(lower(nfc_normalize({0})), 'ß', 'ss'), '\s+', ' ', 'g'))"


@query(rf"""with t as (select p_partkey, {variant_sql(TITLES, "p_partkey")} as t from part), c as (select *, regexp_replace(trim(t), '(?i)^\s*(ch(apter)?\s*\d+\s*[.:)-]?\s*|\d+\s*[.:)]\s*)', '') as bare from t),
n as (select *, trim(regexp_replace(lower(bare), '[^a-z0-9]+', ' ', 'g')) as norm, regexp_replace(regexp_replace(trim(t), '(?i)^\s*(ch(apter)?\.?\s*)?\d+\s*[.:)\-]?\s*', ''), '\s*\([^)]*\)\s*$', '') as k from c)
select p_partkey, bare, array_to_string(list_sort(list_distinct(list_filter(string_split(norm, ' '), lambda w: w not in ('', 'and', 'the', 'of', 'a', 'an', 'in', 'on', 'for', 'to', 'with')))), ' ') as tokens,
{_FOLD.format(r"regexp_replace(regexp_replace(regexp_replace(k, '[_\-\s]+', ' ', 'g'), '\s*:\s*', ': ', 'g'), '[^\p{L}\p{N}_\s:&/+]', '', 'g')")} as key,
lower(trim(regexp_replace(strip_accents(t), '[^\p{{L}}\p{{N}}_]+', '_', 'g'), '_')) as slug from n""")
def label_keys(part):
    t = variant(TITLES, "p_partkey")
    bare = Q.without_chapter(t)
    return part.select("p_partkey", bare.alias("bare"), F.array_join(Q.token_set(bare), " ").alias("tokens"), Q.norm_key(t, strip_chapter=True).alias("key"), Q.slug(t).alias("slug"))


@query(rf"""select doc_id, sha256({_FOLD.format("text")}) as hash from documents""")
def content_hashes(documents):
    return documents.select("doc_id", Q.content_hash("text").alias("hash"))


@query("""select p_partkey, sha256('pattern' || p_size || '|' || 'a=' || p_partkey % 3 || '|' || 'b=' || p_brand) as hash, regexp_replace(p_name || ' ' || p_partkey, '\\d+', '#', 'g') as skeleton from part""")
def generator_keys(part):
    params = F.create_map(F.lit("b"), "p_brand", F.lit("a"), (F.col("p_partkey") % 3).cast("string"))
    return part.select("p_partkey", Q.params_hash(F.concat(F.lit("pattern"), "p_size"), params).alias("hash"), Q.skeleton(F.concat_ws(" ", "p_name", "p_partkey")).alias("skeleton"))


@query(rf"""select doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]{{4,}}'), lambda w: not list_contains({Q.COMMON_WORDS!r}, w)))), ' ') as words from documents""")
def distinctive_words(documents):
    return documents.select("doc_id", F.array_join(F.array_sort(Q.content_words("text")), " ").alias("words"))


@query(r"""with w as (select doc_id, unnest(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ')) as w from documents where text is not null), s as (select item_id, unnest(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ')) as w from benchmark where text is not null),
a as (select doc_id % 40 as item_id, w, count(*) as n from w where w <> '' group by 1, 2), b as (select item_id, w, count(*) as m from s where w <> '' group by 1, 2)
select item_id, round(sum(greatest(0, n - coalesce(m, 0)))::double / sum(n), 6) as missing from a left join b using (item_id, w) group by 1""")
def words_missing(documents, benchmark):
    """Share of the words of some texts, as a bag, that their source lacks."""
    words = lambda df, key: df.select(key.alias("item_id"), F.explode(F.split(Q.norm("text"), " ")).alias("w")).filter("w != ''").groupBy("item_id", "w")
    a = words(documents, F.col("doc_id") % 40).agg(F.count("*").alias("n"))
    b = words(benchmark, F.col("item_id")).agg(F.count("*").alias("m"))
    gone = F.greatest(F.lit(0), F.col("n") - F.coalesce("m", F.lit(0)))
    return a.join(b, ["item_id", "w"], "left").groupBy("item_id").agg(F.round(F.sum(gone) / F.sum("n"), 6).alias("missing"))


CHUNK_TYPES = ["explanation", "template_ratio", "template_", "enriched_record_x#", "video", "enriched_record"]


@query(f"""with c as (select p_partkey, {variant_sql(CHUNK_TYPES, "p_partkey")} as t from part)
select p_partkey, case when t = 'explanation' then t when t like 'template\\_%' escape '\\' then 'template' when t like 'enriched\\_record\\_%' escape '\\' then 'enriched_record' else 'UNKNOWN' end as kind, case when t = 'explanation' then null when t like 'template\\_%' escape '\\' then nullif(substr(t, 10), '') when t like 'enriched\\_record\\_%' escape '\\' then nullif(substr(t, 17), '') else t end as detail from c""")
def chunk_kinds(part):
    kind = Q.chunk_kind(variant(CHUNK_TYPES, "p_partkey"))
    return part.select("p_partkey", kind["kind"].alias("kind"), kind["detail"].alias("detail"))


@query("""select p_partkey, c_custkey from (select distinct p_partkey, lower(p_brand) as a, lower(p_type) as b, p_size % 25 as s from part) p join (select c_custkey, lower(c_mktsegment) as x, 'brand#' || (c_custkey % 55) as y, c_nationkey as n, c_custkey % 60 as z from customer) c on a = y or b = x or s::varchar = z::varchar""")
def any_key(part, customer):
    left = part.select("p_partkey", "p_brand", "p_type", (F.col("p_size") % 25).cast("string").alias("s"))
    right = customer.select("c_custkey", "c_mktsegment", F.concat(F.lit("BRAND#"), (F.col("c_custkey") % 55).cast("string")).alias("y"), (F.col("c_custkey") % 60).cast("string").alias("z"))
    return relations.any_key_join(left, right, [("p_brand", "y"), ("p_type", "c_mktsegment"), ("s", "z")], ("p_partkey", "c_custkey"))


@query("""with a as (select distinct p_name || ' ' || p_type as name from part), b as (select distinct lower(split_part(p_type, ' ', 1)) as term from part union select distinct substr(p_name, 2, 4) from part union select 'x')
select name, term from a join b on contains(lower(name), lower(term)) or contains(lower(term), lower(name))""")
def contained_names(part):
    names = part.select(F.concat_ws(" ", "p_name", "p_type").alias("name"))
    terms = part.select(F.lower(F.element_at(F.split("p_type", " "), 1)).alias("term")).union(part.select(F.substring("p_name", 2, 4))).union(part.limit(1).select(F.lit("x")))
    return relations.contains_join(names, "name", terms, "term")


@query("""select l_orderkey, l_linenumber, case when l_returnflag = 'N' then p_brand else s_name end as dim from lineitem left join part on l_partkey = p_partkey left join supplier on l_suppkey = s_suppkey""")
def routed_dimension(lineitem, part, supplier):
    rows = lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", F.when(F.col("l_returnflag") == "N", F.col("l_partkey")).otherwise(F.col("l_suppkey")).alias("key"))
    out = relations.routed_join(rows, F.col("l_returnflag") == "N", "key", part.select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("dim")), supplier.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("dim")))
    return out.select("l_orderkey", "l_linenumber", "dim")


@query("""with b as (select p_brand, p_type, 'both-' || min(p_partkey) as found from part where p_size > 40 group by all), t as (select p_type, 'label-' || min(p_partkey) as found from part where p_size between 30 and 40 group by all), d as (select distinct p_brand, p_type, 'too small' as reason from part where p_size < 10)
select p_partkey, coalesce(b.found, t.found) as found, case when b.found is not null then 'rule' when t.found is not null then 'label_match' end as resolved_by, case when b.found is null and t.found is null then reason end as declined from part left join b using (p_brand, p_type) left join t using (p_type) left join d using (p_brand, p_type)""")
def rule_lookup(part):
    key = lambda prefix: F.concat(F.lit(prefix), F.min("p_partkey").cast("string")).alias("found")
    both = part.filter("p_size > 40").groupBy("p_brand", "p_type").agg(key("both-"))
    label = part.filter("p_size between 30 and 40").groupBy("p_type").agg(key("label-"))
    no = part.filter("p_size < 10").select("p_brand", "p_type", F.lit("too small").alias("reason")).distinct()
    return relations.rule_lookup(part, both, label, no, "p_brand", "p_type", "found").select("p_partkey", "found", "resolved_by", "declined")


@query("""with a as (select n_name as name, r_name as canonical from nation join region on n_regionkey = r_regionkey where n_nationkey % 3 > 0) select c_custkey, canonical, case when canonical is null then 'no alias for ' || n_name end as reason from customer join nation on c_nationkey = n_nationkey left join a on n_name = name""")
def alias_lookup(customer, nation, region):
    aliases = nation.filter("n_nationkey % 3 > 0").join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"), F.col("r_name").alias("canonical"))
    rows = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("name"))
    return relations.alias_join(rows, aliases, "name", "canonical").select("c_custkey", "canonical", "reason")


ASKED = ["Ratio and Proportion", "ratio and proportion!", "Proportion, the Ratio", "averages", "AVG", "a.v.g", "Unknown #", "Number  series"]
VOCABULARY = ["Ratio and Proportion", "Averages", "averages ", "Number Series", "Series of Number"]
_NORM = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
_TOKENS = "array_to_string(list_sort(list_distinct(list_filter(string_split(" + _NORM + ", ' '), lambda w: w not in ('', 'and', 'the', 'of', 'a', 'an', 'in', 'on', 'for', 'to', 'with')))), ' ')"
_NAMES = f"""n as (select distinct {variant_sql(ASKED, "p_partkey")} as name from part), v as (select distinct {variant_sql(VOCABULARY, "p_partkey")} as label from part), al as (select distinct 'AVG' as name, 'Averages' as label from part)"""


def _names(part):
    names, vocabulary = part.select(variant(ASKED, "p_partkey").alias("name")), part.select(variant(VOCABULARY, "p_partkey").alias("label"))
    return names, vocabulary, part.select(F.lit("AVG").alias("name"), F.lit("Averages").alias("label")).distinct()


@query(f"""with {_NAMES}, x as (select {_NORM.format("label")} as k, min(label) as label from v group by 1 having count(*) = 1), t as (select {_TOKENS.format("label")} as k, min(label) as label from v group by 1 having count(*) = 1)
select n.name, coalesce(al.label, v.label, x.label, t.label) as label, case when al.label is not null then 'reviewed_alias' when v.label is not null then 'exact' when x.label is not null then 'normalized' when t.label is not null then 'tokenset' end as tier, case when al.label is not null or v.label is not null then 1.0 when x.label is not null then 0.9 when t.label is not null then 0.75 end as confidence
from n left join al on n.name = al.name left join v on n.name = v.label left join x on {_NORM.format("n.name")} = x.k left join t on {_TOKENS.format("n.name")} = t.k""")
def tiered_match(part):
    from quernstone.operators.graph import match_tiers

    names, vocabulary, aliases = _names(part)
    return match_tiers(names, vocabulary, "name", "label", {"exact": F.col, "normalized": Q.norm, "tokenset": lambda c: F.array_join(Q.token_set(c), " ")}, aliases)


@query(f"""with {_NAMES}, x as (select {_NORM.format("label")} as k, min(label) as label from v group by 1), y as (select {_NORM.format("name")} as k, min(label) as label from al group by 1)
select n.name, coalesce(v.label, x.label, al.label, y.label) as label, case when v.label is not null then 'exact' when x.label is not null then 'normalised' when al.label is not null then 'alias' when y.label is not null then 'normalised_alias' end as step
from n left join v on n.name = v.label left join x on {_NORM.format("n.name")} = x.k left join al on n.name = al.name left join y on {_NORM.format("n.name")} = y.k""")
def resolved_names(part):
    return relations.resolve_names(*_names(part), Q.norm)


HEADINGS = ["IV. a.", "XXI. b", "I.", "MISCELLANEOUS EXAMPLES", "12. a", "XIV c", "VIII", ""]


@query(rf"""with h as (select l_orderkey, l_linenumber, {variant_sql(HEADINGS, "l_partkey")} as h, l_suppkey % 30 as page from lineitem),
k as (select *, regexp_extract(upper(h), '^\s*([IVXL]+)\s*\.?\s*([A-H])?\b', 1) as rom, regexp_extract(lower(h), '^\s*([ivxl]+)\s*\.?\s*([a-h])?\b', 2) as let from h),
m as (select *, case when contains(h, 'MISC') then 0 else (map {{'I': 1, 'IV': 4, 'VIII': 8, 'XIV': 14, 'XXI': 21}})[rom] end as number, case when contains(h, 'MISC') then 0 when let = '' then 1 else ascii(let) - 96 end as part from k),
r as (select distinct p_partkey % 22 as number, p_partkey % 22 % 8 as known from part)
select l_orderkey, l_linenumber, m.number, case when m.number is not null then part end as part, case when m.number is null then 'no_key' when known is null then 'no_record' when page <> known and page <> known + 1 then 'page_mismatch' else 'joined' end as status from m left join r using (number)""")
def cross_validated(lineitem, part):
    key = relations.heading_key(variant(HEADINGS, "l_partkey"))
    blocks = lineitem.select("l_orderkey", "l_linenumber", key["number"].alias("number"), key["part"].alias("part"), F.array(F.col("l_suppkey") % 30).alias("pages"))
    n = F.col("p_partkey") % 22
    records = part.select(n.cast("int").alias("number"), F.array(n % 8, n % 8 + 1).alias("known")).distinct()
    return relations.cross_validated(blocks, records, "number", "pages", "known").select("l_orderkey", "l_linenumber", "number", "part", "status")


@query("""select l_orderkey, l_linenumber, last_value(case when l_linenumber % 3 = 1 then l_partkey end ignore nulls) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice rows unbounded preceding) as heading, l_linenumber % 3 <> 1 as continued from lineitem""")
def continued_blocks(lineitem):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    rows = lineitem.select("l_orderkey", *order, F.when(F.col("l_linenumber") % 3 == 1, F.col("l_partkey")).alias("heading"))
    return relations.fill_continuations(rows, "l_orderkey", order, "heading").drop(*order[1:])


_PLAYERS = "p as (select c_custkey as k, (c_custkey % 60) / 10.0::double - 3 as theta, 600 + abs(c_acctbal) % 1800 as elo, (c_custkey * 37 % 500)::double as latency, (c_custkey * 13 % 300)::double as wait, ['sprinter', 'deliberate', 'perfectionist', 'balanced'][(c_custkey % 4 + 1)::int] as style from customer), q as (select *, 0.4 * (theta + 3) / 6 + 0.6 * (elo - 600) / 1800 as score from p)"


@query(f"""with {_PLAYERS}, x as (select a.k, b.k as other, abs(a.score - b.score) * 0.7 - least(1.0, b.wait / 120) * 0.3 as rank from q a join q b on a.k <> b.k and abs(a.score - b.score) <= least(0.5, 0.15 + a.wait / 60 * 0.05) and abs(a.theta - b.theta) <= 0.5 and abs(a.latency - b.latency) <= 200
and (a.wait >= 120 or not ((a.style = 'sprinter' and b.style in ('deliberate', 'perfectionist')) or (b.style = 'sprinter' and a.style in ('deliberate', 'perfectionist')))))
select k as c_custkey, arg_min(other, (round(rank, 9), other)) as partner from x group by 1""")
def matched_players(customer):
    k = F.col("c_custkey")
    p = customer.select("c_custkey", (k % 60 / 10.0 - 3).alias("theta"), (600 + F.abs("c_acctbal") % 1800).alias("elo"), (k * 37 % 500).cast("double").alias("latency"), (k * 13 % 300).cast("double").alias("wait"), F.element_at(F.array(*map(F.lit, ["sprinter", "deliberate", "perfectionist", "balanced"])), (k % 4 + 1).cast("int")).alias("style"))
    p = p.withColumn("score", Q.composite_skill(F.col("theta"), F.col("elo")))
    return relations.banded_partners(p, "c_custkey", "score", "theta", "latency", "wait", "style", [("deliberate", "sprinter"), ("perfectionist", "sprinter")])


# Sources and sinks --------------------------------------------------------------------


@query("""select label, count(*) as n, max(vec_id) as last from embeddings group by 1""")
def scan_without_vectors(embeddings):
    """The vector column is dropped before anything else, so the scan does not read it."""
    return embeddings.drop("embedding").groupBy("label").agg(F.count("*").alias("n"), F.max("vec_id").alias("last"))


@query("""select vec_id, len(embedding) as size, round(list_sum(embedding), 3) + 0 as total from embeddings""")
def vector_round_trip(embeddings):
    back = vector(vector_text("embedding"))
    return embeddings.select("vec_id", F.size(back).alias("size"), (F.round(F.aggregate(back, F.lit(0.0), lambda s, x: s + x), 3) + 0).alias("total"))


@query("""with i as (select user_id % 7 as k, min(event_id) as event_id from events where event_id % 3 = 1 group by 1 having k <> 0), n as (select user_id % 7 as k, min(event_id) as event_id from events where event_id % 2 = 0 group by 1)
select k, event_id from i union all select k, event_id from n where k not in (select k from i)""")
def insert_first_wins(events):
    """Many rows a key: the target keeps its own, of new keys the first row counts."""
    key = (F.col("user_id") % 7).alias("k")
    target = events.filter("event_id % 3 = 1 and user_id % 7 != 0").groupBy(key).agg(F.min("event_id").alias("event_id"))
    return insert_new(target, events.filter("event_id % 2 = 0").select(key, "event_id"), ["k"], "event_id")


@query("""select p_partkey, p_brand, p_size from part where p_brand not like '%1' union all select p_partkey, p_brand, p_size + 100 from part where p_brand like '%1' and p_size < 20""")
def replaced_rows(part):
    """All rows of one source are replaced by its new rows, those of others stay."""
    rows = part.select("p_partkey", "p_brand", "p_size", F.when(F.col("p_brand").like("%1"), "mine").otherwise("other").alias("tag"))
    new = rows.filter("tag = 'mine' and p_size < 20").withColumn("p_size", F.col("p_size") + 100)
    return replace_own(rows, new, "tag", "mine").drop("tag")


@query("""select 'orders' as name, count(*) as rows from orders union all select 'parts', count(*) from part union all select 'late', count(*) from lineitem where l_shipdate > date '1998-01-01'""")
def run_manifest(orders, part, lineitem):
    return run_report({"orders": orders, "parts": part, "late": lineitem.filter(F.col("l_shipdate") > F.lit("1998-01-01").cast("date"))})


@query("""select p_partkey, coalesce(case when p_partkey % 9 = 0 then 'SPECIAL' end, p_type) as kind from part""")
def type_overrides(part):
    """A patch of kinds by id is laid over the rows."""
    patch = part.filter("p_partkey % 9 = 0").select("p_partkey", F.lit("SPECIAL").alias("patched"))
    return part.join(patch, "p_partkey", "left").select("p_partkey", F.coalesce("patched", "p_type").alias("kind"))


@query("""select 'part' as label, count(distinct l_partkey) as nodes, null::bigint as edges from lineitem union all select 'supplier', count(distinct l_suppkey), null from lineitem union all select 'SUPPLIED', null, count(*) from (select distinct l_suppkey, l_partkey from lineitem)""")
def graph_merge(lineitem):
    """Nodes once by key, edges once by their ends, as counts by label."""
    count = lambda df, label, what: df.agg(F.count("*").alias("n")).select(F.lit(label).alias("label"), *(F.col("n").alias(w) if w == what else F.lit(None).cast("long").alias(w) for w in ("nodes", "edges")))
    nodes = count(lineitem.select("l_partkey").distinct(), "part", "nodes").unionByName(count(lineitem.select("l_suppkey").distinct(), "supplier", "nodes"))
    return nodes.unionByName(count(lineitem.dropDuplicates(["l_suppkey", "l_partkey"]), "SUPPLIED", "edges"))


@query("""select l_orderkey, min(l_shipdate) as first, count(*) as n, sum(case when l_quantity > 25 then 1 else 0 end) as right, list_sum(list(l_quantity)) as total, list_sort(list(l_linenumber)) = [1, 2, 3] as three from lineitem group by 1""")
def parallel_arrays(lineitem):
    """Times and hits of a run, kept as two arrays side by side."""
    runs = lineitem.groupBy("l_orderkey").agg(F.min("l_shipdate").alias("first"), F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("x"))
    times, hits = F.col("x.l_quantity"), F.transform("x", lambda e: e["l_quantity"] > 25)
    return runs.select("l_orderkey", "first", F.size("x").alias("n"), F.size(F.filter(hits, lambda h: h)).alias("right"), F.aggregate(times, F.lit(0.0), lambda s, t: s + t).alias("total"), (F.to_json(F.col("x.l_linenumber")) == "[1,2,3]").alias("three"))


@query("""with k as (select user_id, max(event_id) filter (event_type = 'click') as c, max(event_id) filter (event_type = 'view') as v, max(event_id) filter (event_type = 'error') as e from events group by 1)
select user_id, coalesce(c, v) as clicks, v is not null and c is not null as clashed, e as errors from k""")
def renamed_keys(events):
    """A map's key `view` becomes `click`; where both are there the survivor's own value stays."""
    maps = events.filter(F.col("event_type").isin("click", "view", "error")).groupBy("user_id", "event_type").agg(F.max("event_id").alias("n")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    renamed = Q.rename_key(F.col("m"), "view", "click")
    return maps.select("user_id", renamed["click"].alias("clicks"), (F.map_contains_key("m", "view") & F.map_contains_key("m", "click")).alias("clashed"), renamed["error"].alias("errors"))


@query("""select conv_id, turn, sum(case when role = 'user' or turn = f then 1 else 0 end) over (partition by conv_id order by turn) as segment from (select *, min(turn) over (partition by conv_id) as f from conversations)""")
def conversation_segments(conversations):
    first = F.min("turn").over(Window.partitionBy("conv_id"))
    rows = conversations.withColumn("f", first).withColumn("opens", ((F.col("role") == "user") | (F.col("turn") == F.col("f"))).cast("int"))
    return rows.select("conv_id", "turn", F.sum("opens").over(Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, 0)).alias("segment"))

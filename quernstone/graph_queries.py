"""Queries of graphs, merges and growth reports, registered beside the others."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quernstone.functions import hash_order
from quernstone.operators import content, graph
from quernstone.registry import query
from quernstone.variants import variant, variant_sql

# Two edges a part, to parts of lesser keys: a graph that grows with the table and has no cycles.
_EDGES = "e as (select p_partkey as src, p_partkey - p_size as dst from part where p_partkey > p_size union select p_partkey, p_partkey - 2 * p_size - 1 from part where p_partkey > 2 * p_size + 1)"


def _edges(part):
    k, n = F.col("p_partkey"), F.col("p_size")
    return part.select(k.alias("src"), F.explode(F.array(k - n, k - 2 * n - 1)).alias("dst")).filter("dst > 0").distinct()


_WALKS = f"with recursive {_EDGES}, w as (select src as start, dst as reached, 1 as d from e union select w.start, e.dst, d + 1 from w join e on w.reached = e.src where d < 5), c as (select start, reached, min(d) as min_depth from w where start <> reached group by 1, 2)"


@query(f"{_WALKS} select * from c")
def prerequisite_closure(part):
    return graph.closure(_edges(part))


@query(f"{_WALKS} select min_depth, count(*) as pairs, count(distinct start) as starts from c group by 1")
def closure_depths(part):
    return graph.depth_report(graph.closure(_edges(part)))


@query(f"with recursive {_EDGES}, w as (select src as start, [src, dst] as path, 1 as d from e where src % 50 = 0 union all select start, list_append(path, e.dst), d + 1 from w join e on path[-1] = e.src where d < 5) select start, array_to_string(path, '>') as path from w")
def prerequisite_paths(part):
    starts = part.filter("p_partkey % 50 = 0").select(F.col("p_partkey").alias("start"))
    return graph.paths(_edges(part), starts).select("start", F.array_join("path", ">").alias("path"))


@query(f"with {_EDGES} select distinct case when src % 5 = 4 then src - 1 else src end as src, case when dst % 5 = 4 then dst - 1 else dst end as dst from e where (case when src % 5 = 4 then src - 1 else src end) <> (case when dst % 5 = 4 then dst - 1 else dst end)")
def merged_edges(part):
    survivors = part.filter("p_partkey % 5 = 4").select(F.col("p_partkey").alias("loser"), (F.col("p_partkey") - 1).alias("survivor"))
    return graph.merge_nodes(_edges(part), survivors)


@query(f"with {_EDGES}, b as (select src, dst from e union select dst, src from e) select src as node, array_to_string(list_sort(list(dst)), ',') as neighbours, count(*) as degree from b group by 1")
def neighbour_map(part):
    return graph.neighbours(_edges(part)).select("node", F.array_join("neighbours", ",").alias("neighbours"), "degree")


@query("""with k as (select p_partkey - p_partkey % 5 as k, min(case when p_size > 25 then p_name end) filter (p_partkey % 5 = 0) as own, arg_min(p_name, p_partkey) filter (p_size > 25 and p_partkey % 5 > 0) as other, arg_min(p_type, p_partkey) as t from part group by 1)
select k as p_partkey, coalesce(own, other) as name, t as type from k""")
def merged_properties(part):
    """Five parts become one: its own values where it has them, else the first of the others'."""
    rows = part.select("p_partkey", F.when(F.col("p_size") > 25, F.col("p_name")).alias("name"), F.col("p_type").alias("type"))
    survivors = part.filter("p_partkey % 5 > 0").select(F.col("p_partkey").alias("loser"), (F.col("p_partkey") - F.col("p_partkey") % 5).alias("survivor"))
    return graph.merge_properties(rows, survivors, "p_partkey", ["name", "type"])


@query("""with c as (select l_partkey % 97 as src, l_suppkey % 89 as dst, count(*) as support from lineitem group by 1, 2), k as (select distinct p_partkey % 97 as src, p_size % 89 as dst from part), r as (select distinct p_partkey % 97 as node from part where p_size = 7)
select src, dst, 'curated' as source, 1 as support from k union all select src, dst, 'chain_derived', support from c where support >= 2 and (src, dst) not in (select (src, dst) from k) and src not in (from r)""")
def derived_edges(lineitem, part):
    counted = lineitem.groupBy((F.col("l_partkey") % 97).alias("src"), (F.col("l_suppkey") % 89).alias("dst")).agg(F.count("*").alias("support"))
    curated = part.select((F.col("p_partkey") % 97).alias("src"), (F.col("p_size") % 89).cast("long").alias("dst"))
    roots = part.filter("p_size = 7").select((F.col("p_partkey") % 97).alias("node")).distinct()
    return graph.derive_edges(curated, counted, roots)


@query(None)
def acyclic_edges(part):
    """One edge from each part to another of its twenty, so cycles everywhere, and what is left of them; what is
    curated alone (a quarter of the edges) stays. Tests hold it against brute force."""
    k, base = F.col("p_partkey"), F.col("p_partkey") - F.col("p_partkey") % 20
    edges = part.select(k.alias("src"), (base + (k * 7 + F.col("p_size")) % 20).alias("dst"), (k % 9 + 1).alias("support"), (k % 4 > 0).alias("derived")).filter("src != dst")
    return graph.break_cycles(edges, F.col("derived"))[0].select("src", "dst", "support")


@query("""select 'node' as kind, 'Region' as label, count(*) as n from region union all select 'node', 'Nation', count(*) from nation union all select 'node', 'Customer', count(*) from customer union all select 'node', 'Supplier', count(*) from supplier union all select 'node', 'Part', count(*) from part union all select 'node', 'Order', count(*) from orders union all select 'node', 'Brand', count(distinct p_brand) from part
union all select 'edge', 'IN_REGION', count(*) from nation semi join region on n_regionkey = r_regionkey union all select 'edge', 'LIVES_IN', count(*) from customer semi join nation on c_nationkey = n_nationkey union all select 'edge', 'BASED_IN', count(*) from supplier semi join nation on s_nationkey = n_nationkey union all select 'edge', 'PLACED', count(*) from orders semi join customer on o_custkey = c_custkey
union all select 'edge', 'CONTAINS', count(distinct (l_orderkey, l_partkey)) from lineitem where l_orderkey in (select o_orderkey from orders) and l_partkey in (select p_partkey from part) union all select 'edge', 'SUPPLIED', count(distinct (l_suppkey, l_partkey)) from lineitem where l_suppkey in (select s_suppkey from supplier) and l_partkey in (select p_partkey from part) union all select 'edge', 'OF_BRAND', count(*) from part where p_brand is not null
union all select 'orphan', 'customers_without_orders', count(*) from customer where c_custkey not in (select o_custkey from orders) union all select 'orphan', 'orders_without_parts', count(*) from orders where o_orderkey not in (select l_orderkey from lineitem where l_partkey in (select p_partkey from part)) union all select 'orphan', 'orders_without_customer', count(*) from orders where o_custkey not in (select c_custkey from customer)
union all select 'orphan', 'parts_never_ordered', count(*) from part where p_partkey not in (select l_partkey from lineitem where l_orderkey in (select o_orderkey from orders)) union all select 'orphan', 'parts_without_supplier', count(*) from part where p_partkey not in (select l_partkey from lineitem where l_suppkey in (select s_suppkey from supplier)) union all select 'orphan', 'suppliers_without_parts', count(*) from supplier where s_suppkey not in (select l_suppkey from lineitem where l_partkey in (select p_partkey from part))
union all select 'orphan', 'nations_without_customers', count(*) from nation where n_nationkey not in (select c_nationkey from customer) union all select 'orphan', 'nations_without_suppliers', count(*) from nation where n_nationkey not in (select s_nationkey from supplier)""")
def graph_plan(customer, orders, lineitem, part, supplier, nation, region):
    tables = {"customer": customer, "orders": orders, "lineitem": lineitem, "part": part, "supplier": supplier, "nation": nation, "region": region}
    return graph.counted_plan(tables, graph.TRADE_NODES, graph.TRADE_EDGES, graph.TRADE_ORPHANS)


SKILLS = ["Ratio", "ratio", "RATIO", "algebra:Ratio", "Series", "algebra:series#", "Chapter #", "Averages", "averages", "Mean"]


@query(f"""with n as (select distinct {variant_sql(SKILLS, "p_partkey")} as name from part), u as (select {variant_sql(SKILLS, "p_partkey")} as name, count(*) as n from part where p_size > 20 group by 1), c as (select name, coalesce(n, 0) as n from n left join u using (name)),
k as (select * from c where not regexp_matches(name, '^Chapter')), b as (select lower(name) as l, arg_min(name, (-n, name)) as best from k group by 1),
m as (select name, case when name = 'Mean' then 'Averages' end as fixed, case when contains(name, ':') and trim(split_part(name, ':', 2)) in (select name from n) then trim(split_part(name, ':', 2)) end as bare, best from k join b on lower(name) = l)
-- a survivor may be merged itself, at most twice
, s as (select name as loser, coalesce(fixed, bare, best) as survivor, case when fixed is not null then 'fixed' when bare is not null then 'namespaced' else 'case' end as rule from m where coalesce(fixed, bare, best) <> name)
select s.loser, coalesce(u.survivor, t.survivor, s.survivor) as survivor, s.rule from s left join s t on s.survivor = t.loser left join s u on t.survivor = u.loser union all select name, null, 'structural' from c where regexp_matches(name, '^Chapter')""")
def merge_plan(part):
    names = part.select(variant(SKILLS, "p_partkey").alias("name"))
    used = part.filter("p_size > 20").groupBy(variant(SKILLS, "p_partkey").alias("name")).agg(F.count("*").alias("n"))
    fixed = part.select(F.lit("Mean").alias("loser"), F.lit("Averages").alias("survivor")).distinct()
    return graph.merge_plan(names, used, F.col("name").rlike("^Chapter"), fixed)


@query("""with b as (select p_partkey as k, p_brand as v from part where p_partkey % 11 > 0), a as (select p_partkey as k, case when p_brand = 'Brand#11' then 'Brand#99' when p_brand = 'Brand#12' then 'Brand#13' when p_partkey % 17 = 0 then 'Brand#1' else p_brand end as v from part where p_partkey % 13 > 0)
select k as p_partkey, case when a.v is null then 'unservable' when b.v = 'Brand#11' and a.v = 'Brand#99' then 'renamed' when b.v = 'Brand#12' then 'deleted_reattributed' else 'silent_reorder' end as cause from b full join a using (k) where b.v is distinct from a.v""")
def key_deltas(part):
    brand = F.col("p_brand")
    after = F.when(brand == "Brand#11", "Brand#99").when(brand == "Brand#12", "Brand#13").when(F.col("p_partkey") % 17 == 0, "Brand#1").otherwise(brand)
    renamed, gone = part.select(F.lit("Brand#11").alias("old"), F.lit("Brand#99").alias("new")).distinct(), part.select(F.lit("Brand#12").alias("old")).distinct()
    return graph.key_delta(part.filter("p_partkey % 11 > 0"), part.filter("p_partkey % 13 > 0").withColumn("p_brand", after), "p_partkey", "p_brand", renamed, gone)


@query("""with r as (select user_id, event_type, max(value) as best from events group by 1, 2), m as (select *, case event_type when 'view' then 'click' when 'error' then 'click' else event_type end as k from r), n as (select *, row_number() over (partition by user_id, k order by (k <> event_type), event_type) as place from m) select user_id, k as event_type, best from n where place = 1""")
def migrated_keys(events):
    """Two kinds take the name of a third: a learner's rows stay unique, the named one first."""
    rows = events.groupBy("user_id", "event_type").agg(F.max("value").alias("best"))
    renamed = events.filter("event_type in ('view', 'error')").select(F.col("event_type").alias("old"), F.lit("click").alias("new")).distinct()
    return graph.migrated_keys(rows, renamed, ["user_id", "event_type"], "event_type")


@query("""with b as (select p_brand, count(*) as n, sum(('0x' || substr(sha256(p_partkey || ':' || p_size), 1, 8))::bigint) as p from part where p_brand <> 'Brand#11' group by 1), a as (select p_brand, count(*) as n, sum(('0x' || substr(sha256(p_partkey || ':' || case when p_partkey % 50 = 0 then p_size + 1 else p_size end), 1, 8))::bigint) as p from part where p_brand <> 'Brand#12' and p_partkey % 70 > 0 group by 1)
select p_brand, case when b.n is null then 'appeared' when a.n is null then 'vanished' when b.n <> a.n then 'count' else 'content' end as what from b full join a using (p_brand) where b.n is distinct from a.n or b.p is distinct from a.p""")
def census_changes(part):
    key = lambda size: F.concat_ws(":", F.col("p_partkey").cast("string"), size.cast("string"))
    before = content.fingerprint(part.filter("p_brand != 'Brand#11'"), "p_brand", key(F.col("p_size")))
    after = content.fingerprint(part.filter("p_brand != 'Brand#12' and p_partkey % 70 > 0"), "p_brand", key(F.when(F.col("p_partkey") % 50 == 0, F.col("p_size") + 1).otherwise(F.col("p_size"))))
    return graph.census_diff(before, after, "p_brand")


# Reports of growth ---------------------------------------------------------------------

_WEEK = "date_trunc('week', c) as week"
_USERS = "u as (select user_id, min(ts)::date as c, count(*) as n, ['sprinter', 'deliberate', 'balanced'][(user_id % 3 + 1)::int] as persona from events group by 1)"


def _users(events):
    persona = F.element_at(F.array(*map(F.lit, ["sprinter", "deliberate", "balanced"])), (F.col("user_id") % 3 + 1).cast("int"))
    return events.groupBy("user_id").agg(F.to_date(F.min("ts")).alias("c"), F.count("*").alias("n")).withColumn("persona", persona)


@query("""with w as (select o_custkey, date_trunc('week', min(o_orderdate))::date as week, count(*) as n from orders group by 1), c as (select week, count(*) as users, round(100.0 * count(*) filter (n >= 2) / count(*), 1) as w1, round(100.0 * count(*) filter (n >= 3) / count(*), 1) as w2 from w group by 1) select * from c order by week desc limit 12""")
def cohort_weeks(orders):
    """Share of a week's new customers who came back once and twice, the latest twelve weeks."""
    first = orders.groupBy("o_custkey").agg(F.to_date(F.date_trunc("week", F.min("o_orderdate"))).alias("week"), F.count("*").alias("n"))
    share = lambda n: F.round(100.0 * F.count_if(F.col("n") >= n) / F.count("*"), 1)
    return first.groupBy("week").agg(F.count("*").alias("users"), share(2).alias("w1"), share(3).alias("w2")).orderBy(F.col("week").desc()).limit(12)


@query(f"""with {_USERS}, p as (select date_trunc('week', c)::date as week, persona, count(*) as n from u group by 1, 2) select week, sum(n)::bigint as total, array_to_string(list_sort(list(persona || '=' || n)), ',') as personas from p group by 1""")
def persona_cohorts(events):
    by = _users(events).groupBy(F.to_date(F.date_trunc("week", "c")).alias("week"), "persona").agg(F.count("*").alias("n"))
    pairs = F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "persona", F.col("n").cast("string")))), ",")
    return by.groupBy("week").agg(F.sum("n").alias("total"), pairs.alias("personas"))


@query(f"""with {_USERS}, r as (select user_id, event_id, event_id % 3 = 0 as used from events where event_type = 'click') select persona, count(*) as sent, count(*) filter (used) as used, round(100.0 * count(*) filter (used) / count(*), 1) as rate from r join u using (user_id) group by 1""")
def viral_rates(events):
    sent = events.filter("event_type = 'click'").withColumn("used", F.col("event_id") % 3 == 0).join(_users(events).select("user_id", "persona"), "user_id")
    return sent.groupBy("persona").agg(F.count("*").alias("sent"), F.count_if("used").alias("used"), F.round(100.0 * F.count_if("used") / F.count("*"), 1).alias("rate"))


@query("""with t as (select o_custkey, p_type, count(*) as n from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey group by 1, 2), b as (select o_custkey, arg_min(p_type, (-n, p_type)) as top from t group by 1)
select top, count(*) as converters, round(avg(o_totalprice), 4) as revenue from b join orders using (o_custkey) where o_orderstatus = 'F' group by 1""")
def top_technique_revenue(lineitem, orders, part):
    """What a customer buys most, and what those who finished orders brought."""
    lines = lineitem.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    top = lines.groupBy("o_custkey", "p_type").agg(F.count("*").alias("n")).groupBy("o_custkey").agg(F.min_by("p_type", F.struct(-F.col("n"), "p_type")).alias("top"))
    return top.join(orders.filter("o_orderstatus = 'F'"), "o_custkey").groupBy("top").agg(F.count("*").alias("converters"), F.round(F.avg("o_totalprice"), 4).alias("revenue"))


@query("""select user_id, ts::date as day, count(*) as problems from events group by 1, 2 having count(*) > 3 order by problems desc, user_id, day limit 100""")
def heavy_days(events):
    """The hundred busiest learner days of more than three problems."""
    days = events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("problems")).filter("problems > 3")
    return days.orderBy(F.col("problems").desc(), "user_id", "day").limit(100)


@query("""select l_partkey, count(*) as n from lineitem group by 1 order by n desc, l_partkey limit 20""")
def most_common_parts(lineitem):
    return lineitem.groupBy("l_partkey").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "l_partkey").limit(20)


@query("""select n_name, count(o_orderkey) as orders from nation left join customer on n_nationkey = c_nationkey left join orders on c_custkey = o_custkey and o_orderpriority = '1-URGENT' group by 1 order by orders desc, n_name limit 10""")
def busiest_nations(nation, customer, orders):
    """Optional matches counted, nations without any kept."""
    urgent = orders.filter("o_orderpriority = '1-URGENT'")
    j = nation.join(customer, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.groupBy("n_name").agg(F.count("o_orderkey").alias("orders")).orderBy(F.col("orders").desc(), "n_name").limit(10)


@query("""select c_nationkey, count(distinct l_partkey) as parts, count(distinct l_suppkey) as suppliers from customer join orders on c_custkey = o_custkey join lineitem on o_orderkey = l_orderkey group by 1""")
def multi_hop_counts(customer, orders, lineitem):
    """Different things two and three steps away."""
    j = customer.join(orders, F.col("c_custkey") == F.col("o_custkey")).join(lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
    return j.groupBy("c_nationkey").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("""select 'both' as what, count(*) as n from (select o_custkey from orders intersect select c_custkey from customer where c_acctbal > 0) union all select 'customers_only', count(*) from (select c_custkey from customer where c_acctbal > 0 except select o_custkey from orders where o_orderstatus = 'F') union all select 'either_not_both', count(*) from ((select c_custkey from customer where c_acctbal > 0 except select o_custkey from orders where o_orderstatus = 'F') union all (select o_custkey from orders where o_orderstatus = 'F' except select c_custkey from customer where c_acctbal > 0))""")
def set_algebra(customer, orders):
    a, b = customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("k")), orders.select(F.col("o_custkey").alias("k"))
    done = orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"))
    count = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
    left = a.subtract(done)
    return count("both", b.intersect(a)).unionByName(count("customers_only", left)).unionByName(count("either_not_both", left.union(done.subtract(a))))


@query("""with r as (select p_partkey, p_brand, p_size, row_number() over (partition by p_brand order by sha256('batch:' || p_partkey)) as place from part), f as (select * from r where place <= 18 and p_size > 10) select p_brand, p_partkey from (select *, row_number() over (partition by p_brand order by place) as n from f) where n <= 3""")
def random_batch(part):
    """Three parts a brand in seeded order: six times as many are looked at before the filter."""
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy(hash_order("batch", "p_partkey")))
    fit = part.withColumn("place", place).filter("place <= 18 and p_size > 10")
    return fit.withColumn("n", F.row_number().over(Window.partitionBy("p_brand").orderBy("place"))).filter("n <= 3").select("p_brand", "p_partkey")


@query("""select p_type, arg_min(p_partkey, (-p_size, -length(p_name), p_partkey)) as best, count(*) as members from part group by 1""")
def best_duplicates(part):
    """Of parts of one type the richest: by size, then by the name's length."""
    return part.groupBy("p_type").agg(F.min_by("p_partkey", F.struct(-F.col("p_size"), -F.length("p_name"), "p_partkey")).alias("best"), F.count("*").alias("members"))


@query("""select p_partkey, case when p_brand in ('Brand#11', 'Brand#12', 'Brand#13') then 'CAT' when p_brand in ('Brand#21', 'Brand#22') then 'GRE' else 'none' end as exam, regexp_matches(p_name, '^(chapter|appendix|red)') or p_type in ('ECONOMY', 'unit test') as dead from part""")
def exam_classes(part):
    """An exam by the list a book is on; names that are structure, or on a deny list, are dead ends."""
    brand = F.col("p_brand")
    exam = F.when(brand.isin("Brand#11", "Brand#12", "Brand#13"), "CAT").when(brand.isin("Brand#21", "Brand#22"), "GRE").otherwise("none")
    return part.select("p_partkey", exam.alias("exam"), (F.col("p_name").rlike("^(chapter|appendix|red)") | F.col("p_type").isin("ECONOMY", "unit test")).alias("dead"))

"""Queries of the content and policy operators, registered beside the others."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone import functions as Q
from quernstone.operators import content
from quernstone.registry import AS_OF, query


@query("""with h as (select *, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) as f from documents), m as (select *, min(doc_id) over (partition by f) as first from h)
select doc_id, case when text is null or trim(text) = '' then 'filled' when not coalesce(n_chars >= 200, false) then 'long_enough' when lang is null then 'language' when contains(text, '@') then 'private' when doc_id <> first then 'new' end as failed from m""")
def audit_verdict(documents):
    rows = content.first_of_equal(documents, "text", "doc_id")
    stages = {"filled": F.trim("text") != "", "long_enough": F.col("n_chars") >= 200, "language": F.col("lang").isNotNull(), "private": ~F.contains("text", F.lit("@")), "new": F.col("is_first")}
    return rows.select("doc_id", content.first_failure(stages).alias("failed"))


@query("""select p_partkey, array_to_string(list_filter([case when p_size > 40 then 'size' end, case when p_retailprice < 950 then 'price' end, case when p_brand like '%1' then 'brand' end], lambda x: x is not null), ',') as blockers, not (p_size > 40 or p_retailprice < 950 or p_brand like '%1') as playable from part""")
def playability(part):
    why = content.blockers({"size": F.col("p_size") > 40, "price": F.col("p_retailprice") < 950, "brand": F.col("p_brand").like("%1")})
    return part.select("p_partkey", F.array_join(why, ",").alias("blockers"), (F.size(why) == 0).alias("playable"))


@query("""with c as (select doc_id, text, case doc_id % 3 when 0 then substr(text, 5, 30) when 1 then lower(substr(text, 5, 30)) else substr(text, 5, 30) || '#!' end as claim from documents where text is not null)
select doc_id, case when contains(text, claim) then 'exact' when contains(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), trim(regexp_replace(lower(claim), '\\s+', ' ', 'g'))) then 'fuzzy' else 'discard' end as grounding from c""")
def claim_grounding(documents):
    part = F.substring("text", 5, 30)
    claim = F.when(F.col("doc_id") % 3 == 0, part).when(F.col("doc_id") % 3 == 1, F.lower(part)).otherwise(F.concat(part, F.lit("#!")))
    return documents.filter("text is not null").select("doc_id", content.grounding(claim, F.col("text")).alias("grounding"))


@query("""select o_custkey, case when avg((o_orderstatus = 'O')::int) >= 0.5 then 'hidden' when avg((o_orderstatus = 'F')::int) >= 0.5 then 'percentile_only' else 'full' end as mode from orders group by 1""")
def rank_visibility(orders):
    states = orders.withColumn("state", F.when(F.col("o_orderstatus") == "O", "fractured").when(F.col("o_orderstatus") == "F", "fragile").otherwise("fluid"))
    return content.cognitive_mode(states, "o_custkey", "state")


@query("""select p_type, arg_min(p_name, (not contains(p_name, ' '), length(p_name), p_name)) as display from part group by 1""")
def display_form(part):
    return part.groupBy("p_type").agg(F.min_by("p_name", F.struct(~F.contains("p_name", F.lit(" ")), F.length("p_name"), "p_name")).alias("display"))


@query("""with p as (select *, p_size <= 10 as easy, sha256('mock:' || p_partkey) as place from part), q as (select *, row_number() over (partition by p_brand, easy order by place) > case when easy then 3 else 7 end as extra from p)
select p_brand, p_partkey, row_number() over (partition by p_brand order by p_size, place) as position from (select *, row_number() over (partition by p_brand order by extra, place) as pick from q) where pick <= 10""")
def difficulty_ramp(part):
    return content.ramp(part, "p_brand", "p_partkey", F.col("p_size") <= 10, "p_size", 10, 3, "mock").select("p_brand", "p_partkey", "position")


@query("""with m as (select l_orderkey, arg_min(l_suppkey, (l_returnflag = 'R', l_suppkey)) as s from lineitem group by 1)
select l_orderkey, coalesce(case when o_orderpriority = '1-URGENT' then o_custkey end, s) as parent from m left join orders on l_orderkey = o_orderkey""")
def pinned_choice(lineitem, orders):
    best = lineitem.groupBy("l_orderkey").agg(F.min_by("l_suppkey", F.struct(F.col("l_returnflag") == "R", "l_suppkey")).alias("s"))
    pins = orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return best.join(pins, "l_orderkey", "left").select("l_orderkey", F.coalesce("o_custkey", "s").alias("parent"))


@query("""with recursive a as (select user_id, event_type as k, row_number() over (partition by user_id order by ts, event_id) as n from events),
f as (select distinct user_id, 0::bigint as n, 'none' as s from a union all
select f.user_id, f.n + 1, case when k = 'click' then 'cancelled' when k = 'signup' then 'trialing' when s = 'cancelled' then s when k = 'purchase' then 'active' when k = 'error' then 'past_due' else s end from f join a on a.user_id = f.user_id and a.n = f.n + 1)
select user_id, arg_max(s, n) as state, arg_max(s, n) in ('active', 'trialing', 'past_due') as granted from f group by 1""")
def subscription_state(events):
    out = content.subscription_states(events, "user_id", ["ts", "event_id"], "event_type", {"signup": "trialing"}, {"purchase": "active", "error": "past_due"}, "click")
    return out.withColumn("granted", F.col("state").isin("active", "trialing", "past_due"))


@query(f"""with l as (select o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) as s, max(o_orderdate)::date as d from orders group by 1)
select c_custkey, case when s is null then date '{AS_OF}' + 7 when s = 'F' then least(d + 30, d + 7) else d + 30 end as entitled_until from customer left join l on c_custkey = o_custkey""")
def entitlement_horizon(customer, orders):
    last = orders.groupBy("o_custkey").agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("s"), F.to_date(F.max("o_orderdate")).alias("d"))
    until = F.when(F.col("s").isNull(), F.date_add(F.lit(AS_OF).cast("date"), 7)).when(F.col("s") == "F", F.least(F.date_add("d", 30), F.date_add("d", 7))).otherwise(F.date_add("d", 30))
    return customer.join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", until.alias("entitled_until"))


@query("""select o_custkey, count(*) as live from orders where o_orderstatus = 'O' group by 1 having count(*) > 1""")
def one_live_row(orders):
    return orders.filter("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.count("*").alias("live")).filter("live > 1")


@query("""with n as (select conv_id, count(*) as n from conversations group by 1)
select conv_id, first, least(first + 4, n) as "end" from (select conv_id, n, unnest(generate_series(0, greatest(0, n - 1), 3)) as first from n) where first = 0 or first + 1 < n""")
def turn_windows(conversations):
    return content.windows_of(conversations.groupBy("conv_id").agg(F.count("*").alias("n")), "conv_id", "n")


@query("""select p_partkey, case when p_size - 1 = 0 then 'explainer' when p_retailprice > 1900 then 'llm' when p_retailprice >= 1000 and p_size <= 4 then 'bridge' when p_size <= 6 then 'escalate' when p_size <= 11 then 'resample' else 'serve' end as tier, [1, 3, 7, 21][least(p_size // 2, 3) + 1] as review_days from part""")
def exhaustion_tier(part):
    miss = F.when(F.col("p_retailprice") > 1900, 1.0).otherwise(0.0)
    mastery = F.when(F.col("p_retailprice") >= 1000, 0.9).otherwise(0.1)
    return part.select("p_partkey", content.exhaustion_tier(F.col("p_size") - 1, miss, mastery).alias("tier"), content.review_interval(F.col("p_size"), [1, 3, 7, 21]).alias("review_days"))


@query("""with v as (select l_orderkey, l_quantity > 25 as pass from lineitem where l_linenumber <= 3)
select l_orderkey, count(*) filter (pass) >= 2 as passed, count(*) filter (pass) not in (0, count(*)) as dissent from v group by 1 having count(*) = 3""")
def consensus_vote(lineitem):
    yes = F.count_if(F.col("l_quantity") > 25)
    return lineitem.filter("l_linenumber <= 3").groupBy("l_orderkey").agg((yes >= 2).alias("passed"), ((yes > 0) & (yes < F.count("*"))).alias("dissent"), F.count("*").alias("n")).filter("n = 3").drop("n")


@query("""with o as (select *, lag(c_custkey) over w as lk, lag(c_acctbal) over w as ls, lead(c_custkey) over w as hk, lead(c_acctbal) over w as hs from customer window w as (partition by c_nationkey order by c_acctbal, c_custkey))
select c_custkey, case when c_acctbal - ls <= 500 and (hs is null or c_acctbal - ls <= hs - c_acctbal) then lk when hs - c_acctbal <= 500 then hk end as partner from o""")
def nearest_partner(customer):
    return content.nearest_partner(customer, "c_nationkey", "c_custkey", "c_acctbal", 500)


@query("""with recursive m as (select p_partkey as s, p_partkey - p_size as t from part where p_partkey % 3 <> 0 and p_partkey > p_size), w as (select s, t, 1 as d from m union all select w.s, m.t, d + 1 from w join m on m.s = w.t)
select s as loser, arg_max(t, d) as survivor from w group by 1""")
def merge_chains(part):
    moves = part.filter("p_partkey % 3 != 0 and p_partkey > p_size").select(F.col("p_partkey").alias("loser"), (F.col("p_partkey") - F.col("p_size")).alias("survivor"))
    return content.resolve_chains(moves, "loser", "survivor")


@query("""select event_type, count(*) as n, sum(('0x' || substr(sha256(event_id || ':' || user_id), 1, 8))::bigint)::bigint as print from events group by 1""")
def census_fingerprint(events):
    return content.fingerprint(events, "event_type", F.concat_ws(":", F.col("event_id").cast("string"), F.col("user_id").cast("string")))


@query("""with m as (select case when l_suppkey % 5 = 4 then l_suppkey - 1 else l_suppkey end as l_suppkey, l_partkey from lineitem) select distinct l_suppkey, l_partkey from m where l_suppkey % 7 <> 0""")
def matrix_remap(lineitem, supplier):
    loser = supplier.filter("s_suppkey % 5 = 4").select(F.col("s_suppkey").alias("loser"), (F.col("s_suppkey") - 1).alias("survivor"))
    return content.remap_matrix(lineitem, "l_suppkey", "l_partkey", loser, supplier.filter("s_suppkey % 7 = 0").select(F.col("s_suppkey").alias("l_suppkey")))


@query("""select user_id, count(*) filter (hour(ts) >= 18) as late, count(*) filter (hour(ts) < 18) as kept, round(coalesce(avg(value) filter (hour(ts) < 18), 0), 6) as score from events group by 1""")
def late_answers(events):
    late = F.hour("ts") >= 18
    return events.groupBy("user_id").agg(F.count_if(late).alias("late"), F.count_if(~late).alias("kept"), F.round(F.coalesce(F.avg(F.when(~late, F.col("value"))), F.lit(0.0)), 6).alias("score"))


@query("""with u as (select user_id, min(ts) filter (event_type = 'click') as c, max(ts) filter (event_type = 'purchase') as p from events group by 1)
select c::date as day, count(*) as exposed, count(*) filter (p > c) as converted, round(100.0 * count(*) filter (p > c) / count(*), 1) as rate from u where c is not null group by 1""")
def exposure_conversion(events):
    at = lambda f, kind: f(F.when(F.col("event_type") == kind, F.col("ts")))
    users = events.groupBy("user_id").agg(at(F.min, "click").alias("c"), at(F.max, "purchase").alias("p")).filter("c is not null")
    won = F.count_if(F.col("p") > F.col("c"))
    return users.groupBy(F.to_date("c").alias("day")).agg(F.count("*").alias("exposed"), won.alias("converted"), F.round(100.0 * won / F.count("*"), 1).alias("rate"))

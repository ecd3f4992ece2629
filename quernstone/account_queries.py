"""Queries of entitlements, subscriptions, reviews, public projections and closure figures, registered beside the others."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone import functions as Q
from quernstone.operators import billing, content, graph, matches
from quernstone.registry import query

NOW = "1997-01-01 00:00:00"


@query(f"""with u as (select c_custkey as u, case when c_custkey % 3 = 0 then 'child' else 'standard' end as kind, case when c_custkey % 3 = 0 and c_custkey % 2 = 0 then c_custkey + 1 end as parent, case when c_custkey % 5 = 0 then 'free' else 'plus' end as tier from customer),
s as (select o_custkey as u, case o_orderkey % 5 when 0 then 'cancelled' when 1 then 'past_due' when 2 then 'trialing' else 'active' end as status, case when o_orderkey % 4 > 0 then o_orderdate + interval 400 days end as pe, case when o_orderkey % 7 > 0 then o_orderdate + interval 30 days end as te, case when o_orderkey % 3 > 0 then o_orderdate + interval 10 days end as pd, o_orderdate as moment from orders),
l as (select u, arg_max({{'status': status, 'pe': pe, 'te': te, 'pd': pd}}, (moment, pe is not null, pe, te is not null, te, pd is not null, pd, status)) as s from s where status <> 'cancelled' group by 1),
j as (select u.*, l.s from u left join l on l.u = case when kind = 'child' and parent is not null then parent else u.u end)
select u as c_custkey, tier, case when tier = 'free' then timestamp '{NOW}' else coalesce(case when s.status = 'past_due' then least(coalesce(s.pe, s.te, coalesce(s.pd, timestamp '{NOW}') + interval 3 days), coalesce(s.pd, timestamp '{NOW}') + interval 3 days) else coalesce(s.pe, s.te) end, timestamp '{NOW}' + interval 3 days) end as expires from j""")
def entitlement_horizons(customer, orders):
    """Customers entitled by their own or their parents' latest live order taken as a subscription."""
    k, o, day = F.col("c_custkey"), F.col("o_orderkey"), F.col("o_orderdate")
    after = lambda n: day + F.make_dt_interval(days=F.lit(n))
    users = customer.select(k.alias("user"), F.when(k % 3 == 0, "child").otherwise("standard").alias("account_type"), F.when((k % 3 == 0) & (k % 2 == 0), k + 1).alias("parent"), F.when(k % 5 == 0, "free").otherwise("plus").alias("tier"))
    status = F.when(o % 5 == 0, "cancelled").when(o % 5 == 1, "past_due").when(o % 5 == 2, "trialing").otherwise("active")
    subs = orders.select(F.col("o_custkey").alias("user"), status.alias("status"), F.when(o % 4 > 0, after(400)).alias("period_end"), F.when(o % 7 > 0, after(30)).alias("trial_end"), F.when(o % 3 > 0, after(10)).alias("past_due_since"), day.alias("updated_at"))
    now = F.lit(NOW).cast(dict(orders.dtypes)["o_orderdate"])
    return billing.entitlements(users, subs, now).select(F.col("user").alias("c_custkey"), "tier", "expires")


@query(None)
def subscription_history(events):
    """Every purchase, click or error of a user as an event of a provider: no SQL folds the history, tests hold it to one by one."""
    e, u = F.col("event_id"), F.col("user_id")
    rows = events.filter("event_type in ('purchase', 'click', 'error')").select(
        e.alias("event"), F.col("ts").cast("timestamp").alias("at"), F.when(e % 4 > 0, F.concat(F.lit("ref"), (u * 10 + e % 3).cast("string"))).alias("ref"), F.when(e % 5 == 0, F.concat(F.lit("i"), (u * 10 + e % 4).cast("string"))).alias("intent"), F.when(e % 6 > 0, u).alias("user"),
        F.when(F.col("event_type") == "error", F.when(e % 2 == 0, "cancelled").otherwise("past_due")).when(e % 3 == 0, "active").alias("status"), (e % 7 == 0).alias("from_client"), (F.col("event_type") == "click").alias("pays_only"),
    )
    k = F.explode(F.sequence(F.lit(0), F.lit(3)))
    intents = events.select("user_id").distinct().select(F.col("user_id"), k.alias("k")).select(
        F.concat(F.lit("i"), (u * 10 + F.col("k")).cast("string")).alias("intent"), u.alias("user"), F.concat(F.lit("ref"), (u * 10 + F.col("k")).cast("string")).alias("ref"), F.element_at(F.array(*map(F.lit, ["pending", "expired", "paid", "pending"])), F.col("k") + 1).alias("status"), F.lit("plus").alias("tier"), (F.col("k") * 7).alias("trial_days"),
    )
    return billing.settled(rows, intents)


@query("""select event_id from events where (date '2024-01-31' - ts::date) >= [1, 3, 7, 14][least((event_id % 9) // 2, 3) + 1]""")
def due_reviews(events):
    rows = events.select("event_id", (F.col("event_id") % 9).alias("mastery"), F.datediff(F.lit("2024-01-31").cast("date"), F.to_date("ts")).alias("idle"))
    return content.due_reviews(rows, "mastery", "idle", [1, 3, 7, 14]).select("event_id")


@query("""select p_partkey, p_name, case p_partkey % 4 when 0 then 'verified' when 1 then 'unverified' when 2 then 'disputed' else 'verified' end as answer_verification, 'unverified' as solution_verification, p_size::varchar as shown from part""")
def public_items(part):
    """Items as the public sees them: no answer at the top or within, and two columns of what was checked."""
    k = F.col("p_partkey")
    status = F.when(k % 4 == 0, "verified_L1").when(k % 4 == 2, "disputed").when(k % 4 == 3, "answer_verified")
    rows = part.select("p_partkey", "p_name", F.col("p_brand").alias("answer_key"), F.struct(F.col("p_size").alias("n"), F.col("p_type").alias("answer")).alias("body"), status.alias("status"))
    out = content.public_questions(rows)
    seen = F.when(F.lit("answer" in out.schema["body"].dataType.names or "answer_key" in out.columns), "answer").otherwise(F.col("body.n").cast("string"))
    v = content.verification(F.col("status"))
    return out.select("p_partkey", "p_name", v["answer_verification"].alias("answer_verification"), v["solution_verification"].alias("solution_verification"), seen.alias("shown"))


@query("""with p as (select user_id, event_id % 40 as item, event_type = 'signup' and event_id % 2 = 0 as mastered, event_id % 5 as r, event_id % 3 as w, ts, event_id % 11 as h from events)
select 'done' as view, user_id, item as x from p where mastered or (r >= 3 and w = 0) union all select 'recent', user_id, item from p where ts > timestamp '2024-01-28' - interval 7 days union all select distinct 'params', user_id, h from p where ts > timestamp '2024-01-28' - interval 7 days""")
def progress_views(events):
    e = F.col("event_id")
    rows = events.select("user_id", (e % 40).alias("item"), ((F.col("event_type") == "signup") & (e % 2 == 0)).alias("mastered"), (e % 5).alias("right"), (e % 3).alias("wrong"), F.col("ts").alias("seen_at"), (e % 11).alias("params"))
    views = content.progress_views(rows, "user_id", "item", "params", F.lit("2024-01-28").cast(dict(events.dtypes)["ts"]))
    return views["done"].select(F.lit("done").alias("view"), "user_id", F.col("item").alias("x")).unionAll(views["recent"].select(F.lit("recent"), "user_id", "item")).unionAll(views["params"].select(F.lit("params"), "user_id", "params"))


@query("""with a as (select user_id, event_type in ('purchase', 'click') as ok, row_number() over (partition by user_id order by ts, event_id) as n from events), g as (select user_id, count(*) as c, 100.0 * count(*) filter (ok) / count(*) as acc, max(n) - coalesce(max(n) filter (not ok), 0) as up, max(n) - coalesce(max(n) filter (ok), 0) as down from a group by 1)
select user_id, case when down >= 3 or (acc < 50 and c > 5) then 'fractured' when acc >= 80 and up >= 5 then 'fluid' else 'fragile' end as state from g""")
def stored_states(events):
    at, ok = F.struct("ts", "event_id"), F.col("event_type").isin("purchase", "click")
    last = events.groupBy("user_id").agg(F.count("*").alias("c"), (100.0 * F.count_if(ok) / F.count("*")).alias("acc"), F.max(F.when(ok, at)).alias("right"), F.max(F.when(~ok, at)).alias("wrong"))
    runs = events.join(last.select("user_id", "right", "wrong"), "user_id").groupBy("user_id").agg(F.count_if(F.col("wrong").isNull() | (at > F.col("wrong"))).alias("up"), F.count_if(F.col("right").isNull() | (at > F.col("right"))).alias("down"))
    return last.join(runs, "user_id").select("user_id", Q.stored_state(F.col("acc"), F.col("c"), F.col("up"), F.col("down")).alias("state"))


@query("""with recursive e as (select distinct s_suppkey as src, (s_suppkey * 7 + s_nationkey) % 97 as dst from supplier), w as (select src as start, dst as reached, 1 as d from e where src <> dst union select w.start, e.dst, d + 1 from w join e on e.src = w.reached where d < 5 and e.dst <> w.start),
p as (select start, count(distinct reached) as n from w group by 1), m as (select n.node, coalesce(p.n, 0) as n from (select src as node from e union select dst from e) n left join p on p.start = n.node)
select count(*) as nodes, sum(n)::bigint as pairs, round(avg(n), 2) as mean, median(n) as median, max(n)::bigint as most, count(*) filter (n = 0) as without from m""")
def ancestor_figures(supplier):
    edges = supplier.select(F.col("s_suppkey").alias("src"), ((F.col("s_suppkey") * 7 + F.col("s_nationkey")) % 97).alias("dst")).distinct()
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst"))
    return graph.ancestor_report(graph.closure(edges), nodes)


@query(None)
def completed_matches(orders):
    """Orders of one customer segment and day as the results of a match: tests hold ratings to the published example and points to one by one."""
    day, k = F.to_date("o_orderdate"), F.col("o_orderkey")
    place = F.when(F.col("o_totalprice") > 4000, 1).when(F.col("o_totalprice") > 2500, 2).otherwise(3)
    results = orders.select(
        F.concat_ws("/", day, (F.col("o_custkey") % 20).cast("string")).alias("match"), F.when(k % 9 > 0, F.col("o_custkey")).alias("user"), place.alias("place"), (k % 101).cast("double").alias("accuracy"), F.when(k % 2 == 0, "speed_race").otherwise("duel").alias("mode"),
        (k % 90_000).alias("duration_ms"), (k % 5 == 0).alias("comeback"), (k % 7 - 3).cast("double").alias("theta"),
    )
    ratings = orders.filter("o_custkey % 3 = 0").select(F.col("o_custkey").alias("user")).distinct().select("user", (1200.0 + F.col("user") % 700).alias("rating"), F.lit(90.0).alias("rd"), F.lit(0.06).alias("volatility"), F.lit(9).alias("played"), F.lit(2).alias("streak"))
    return matches.completed(results, ratings, results.filter("user % 5 = 0").select("match", "user"))[0]

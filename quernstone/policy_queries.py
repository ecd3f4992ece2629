"""Queries of filters, policies, billing and governance, registered beside the others."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quernstone.functions import bucket64, hash_order
from quernstone.operators import content, policy
from quernstone.registry import AS_OF, query
from quernstone.variants import variant, variant_sql

LABELS = ["TRUSTED", "live", "SANDBOX", "trusted_candidate", "QUARANTINED_SOFT", "quarantined_pending_consensus", "promoted", "", "QUARANTINED_HARD"]


@query("""select event_id, user_id, event_type, value from events where event_type = 'purchase' and user_id = 3""")
def attempts_filtered(events):
    return policy.where_given(events.select("event_id", "user_id", "event_type", "value"), event_type="purchase", user_id=3, value=None)


@query(f"""select doc_id from documents where text is not null and trim(text) <> '' and lang in ('en', 'de') and doc_id in (select doc_id from labels) and doc_id not in (select doc_id from labels where {variant_sql(LABELS, "doc_id")} ilike 'quarantin%')""")
def servable_items(documents, labels):
    bad = labels.filter(policy.is_quarantined(variant(LABELS, "doc_id")))
    return policy.servable(documents.select("doc_id", "text", "lang"), "doc_id", "text", "lang", ["en", "de"], labels, bad).select("doc_id")


@query(f"""with l as (select p_partkey, {variant_sql(LABELS, "p_partkey")} as label from part)
select p_partkey, label in ('LIVE', 'TRUSTED', 'trusted', 'live', 'SANDBOX', 'sandbox', 'sandbox_candidate', 'trusted_candidate') as servable, case when label in ('LIVE', 'TRUSTED', 'trusted', 'live') then 'trusted' when label in ('SANDBOX', 'sandbox', 'sandbox_candidate', 'trusted_candidate') then 'sandbox' when label ilike 'quarantin%' then 'quarantined' else 'unknown' end as tier,
label in ('LIVE', 'TRUSTED', 'trusted', 'live') as feeds_mastery, case when label = '' then 'missing trust label' when label in ('LIVE', 'TRUSTED', 'trusted', 'live') then 'trusted' when label in ('SANDBOX', 'sandbox', 'sandbox_candidate', 'trusted_candidate') then 'sandbox: excluded from mastery' when label ilike 'quarantin%' then 'quarantined (' || label || ')' else 'unrecognised trust label (' || label || ')' end as reason,
case when label in ('LIVE', 'TRUSTED') then 'trusted' when label = 'SANDBOX' then 'sandbox' else 'static_verified' end as shown from l""")
def trust_decisions(part):
    label = variant(LABELS, "p_partkey")
    return part.select("p_partkey", policy.trust_of(label).alias("t"), policy.shown_trust(label).alias("shown")).select("p_partkey", "t.*", "shown")


@query(f"""select case when {variant_sql(LABELS, "p_partkey")} ilike 'quarantin%' then 'quarantined' else 'open' end as set, p_brand, count(*) as n from part group by all""")
def trust_census(part):
    kind = F.when(policy.is_quarantined(variant(LABELS, "p_partkey")), "quarantined").otherwise("open")
    return part.groupBy(kind.alias("set"), "p_brand").agg(F.count("*").alias("n"))


@query("""select p_partkey, case when list_has_any(r, ['wrong_answer', 'unsafe']) then 'QUARANTINED_HARD' when len(r) > 0 then 'QUARANTINED_SOFT' else 'TRUSTED' end as level
from (select p_partkey, list_filter([case when p_size > 45 then 'wrong_answer' end, case when p_size % 5 = 0 then 'typo' end, case when p_brand like '%3' then 'style' end], lambda x: x is not null) as r from part)""")
def trust_from_reasons(part):
    reasons = content.blockers({"wrong_answer": F.col("p_size") > 45, "typo": F.col("p_size") % 5 == 0, "style": F.col("p_brand").like("%3")})
    return part.select("p_partkey", policy.trust_from_reasons(reasons, ["wrong_answer", "unsafe"]).alias("level"))


@query("""with f as (select distinct least(o_custkey, o_orderkey % 150 + 1) as a, greatest(o_custkey, o_orderkey % 150 + 1) as b from orders where o_orderkey % 5 = 0 and o_custkey <> o_orderkey % 150 + 1), g as (select a as viewer, b as owner from f union all select b, a from f),
i as (select o_orderkey, o_custkey as owner, o_orderpriority = '1-URGENT' as pub from orders where o_orderdate >= date '1997-01-01')
select owner as viewer, o_orderkey from i union select viewer, o_orderkey from i join g using (owner) union select null, o_orderkey from i where pub""")
def visible_items(orders):
    """Own, friends' and public orders; a null viewer stands for everyone."""
    other = F.col("o_orderkey") % 150 + 1
    pairs = orders.filter((F.col("o_orderkey") % 5 == 0) & (F.col("o_custkey") != other)).select(F.least("o_custkey", other).alias("a"), F.greatest("o_custkey", other).alias("b")).distinct()
    friends = pairs.toDF("viewer", "owner").union(pairs.select("b", "a"))
    items = orders.select("o_orderkey", F.col("o_custkey").alias("owner"), (F.col("o_orderpriority") == "1-URGENT").alias("pub"), "o_orderdate")
    return policy.visible(items, "owner", "pub", friends, "viewer", F.col("o_orderdate") >= F.lit("1997-01-01").cast("date")).select("viewer", "o_orderkey")


@query("""with f as (select distinct least(o_custkey, o_orderkey % 150 + 1) as a, greatest(o_custkey, o_orderkey % 150 + 1) as b from orders where o_custkey <> o_orderkey % 150 + 1), n as (select a as me, b as friend from f union all select b, a from f)
select x.c_name as name, y.c_name as friend from n join customer x on me = x.c_custkey join customer y on friend = y.c_custkey""")
def friend_names(orders, customer):
    """Friendships are kept once, the smaller key first; both ends see the other's name."""
    other = F.col("o_orderkey") % 150 + 1
    pairs = orders.filter(F.col("o_custkey") != other).select(F.least("o_custkey", other).alias("a"), F.greatest("o_custkey", other).alias("b")).distinct()
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("me"), F.col("b").alias("friend")), F.struct(F.col("b").alias("me"), F.col("a").alias("friend")))).alias("x")).select("x.*")
    me, friend = customer.select(F.col("c_custkey").alias("me"), F.col("c_name").alias("name")), customer.select(F.col("c_custkey").alias("friend"), F.col("c_name").alias("friend_name"))
    return both.join(me, "me").join(friend, "friend").select("name", F.col("friend_name").alias("friend"))


@query("""with a as (select c_custkey, case when c_custkey % 11 > 0 then (c_custkey % 20)::int + 3 end as age, (c_custkey % 4 * 8)::int as cap, c_custkey % 3 as m from customer), b as (select *, coalesce(age < 13, false) as kid from a)
select c_custkey, kid as kids_mode, not kid and (age is null or age >= 10) as ads_enabled, age is not null and not kid as bots_enabled, coalesce(age >= 10, false) and not kid as taunts_enabled, case when kid then least(coalesce(nullif(cap, 0), 10), 20) end as session_cap_minutes, case when kid then 'percentile_only' else 'full' end as leaderboard,
case when m = 2 then 'opted_out' when age is null or age < 10 then 'age_gate' when age < 13 then 'kids_mode' when c_custkey % 5 >= 3 then 'loss_streak' when c_custkey % 4 >= 2 then 'cluster_never' when c_custkey % 6 + 1 < case c_custkey % 4 when 0 then 3 when 1 then 5 end then 'frequency' else 'ok' end as taunt from b""")
def kids_policies(customer):
    k = F.col("c_custkey")
    age = F.when(k % 11 > 0, (k % 20).cast("int") + 3)
    cluster = F.element_at(F.array(*map(F.lit, ["Sprinter", "perfectionist", "deliberate", "rebuilder"])), (k % 4 + 1).cast("int"))
    p = policy.kids_policy(age, (k % 4 * 8).cast("int"))
    taunt = policy.taunt_gate(age, cluster, k % 6, k % 5, k % 3 != 2)
    return customer.select("c_custkey", *(p[c].alias(c) for c in ("kids_mode", "ads_enabled", "bots_enabled", "taunts_enabled", "session_cap_minutes", "leaderboard")), taunt.alias("taunt"))


@query(f"""with l as (select o_custkey, max(o_orderkey) % 150 as since, avg((o_orderstatus = 'O')::int) as fr, avg((o_orderstatus = 'F')::int) as fa from orders group by 1), m as (select *, case when fr >= 0.5 then 'hidden' when fa >= 0.5 then 'percentile_only' else 'full' end as mode, o_custkey % 9 = 0 as kid from l)
select o_custkey, case when since < 60 then 'hidden' when mode = 'hidden' then 'hidden' when kid or mode = 'percentile_only' then 'percentile_only' else 'full' end as mode, case when since < 60 then 'available in ' || (60 - since) || 's' when mode = 'hidden' then 'unavailable in recovery mode' when kid then 'kids_mode' when mode = 'percentile_only' then 'fragile' else 'ok' end as reason from m""")
def leaderboard_modes(orders):
    states = orders.withColumn("state", F.when(F.col("o_orderstatus") == "O", "fractured").when(F.col("o_orderstatus") == "F", "fragile").otherwise("fluid"))
    modes = content.cognitive_mode(states, "o_custkey", "state").join(orders.groupBy("o_custkey").agg((F.max("o_orderkey") % 150).alias("since")), "o_custkey")
    out = policy.leaderboard_mode(F.col("since"), F.col("mode"), F.col("o_custkey") % 9 == 0)
    return modes.select("o_custkey", out["mode"].alias("mode"), out["reason"].alias("reason"))


@query("""with s as (select o_custkey as c, count(*) as played, count(*) filter (o_orderstatus = 'F') as streak, max(o_totalprice) / 200 as elo, bool_or(o_orderpriority = '1-URGENT') as won, bool_or(o_orderpriority = '5-LOW') as comeback, min(o_orderkey) % 90 * 1000 as ms, o_custkey % 12 as rank from orders group by 1)
select c as o_custkey, array_to_string(list_filter([case when won then 'first_win' end, case when won and c % 7 = 0 then 'perfect_game' end, case when won and c % 2 = 0 and ms < 60000 then 'speed_demon' end, case when won and comeback then 'comeback_king' end, case when streak >= 3 then 'win_streak_3' end, case when streak >= 5 then 'win_streak_5' end, case when streak >= 10 then 'win_streak_10' end, case when streak >= 25 then 'win_streak_25' end,
case when played >= 10 then 'games_10' end, case when played >= 100 then 'games_100' end, case when played >= 500 then 'games_500' end, case when played >= 1000 then 'games_1000' end, case when elo >= 1500 then 'elo_1500' end, case when elo >= 1800 then 'elo_1800' end, case when elo >= 2000 then 'elo_2000' end, case when elo >= 2200 then 'elo_2200' end, case when rank <= 10 and rank > 0 then 'daily_top10' end, case when rank = 1 then 'daily_top1' end], lambda x: x is not null and x <> 'games_10'), ',') as unlocked from s""")
def achievements(orders):
    """New achievements: what the figures satisfy, without what everyone has (games_10)."""
    s = orders.groupBy("o_custkey").agg(
        F.count("*").alias("played"), F.count_if(F.col("o_orderstatus") == "F").alias("streak"), (F.max("o_totalprice") / 200).alias("elo"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("won"),
        F.bool_or(F.col("o_orderpriority") == "5-LOW").alias("comeback"), (F.min("o_orderkey") % 90 * 1000).alias("ms"),
    )
    k = F.col("o_custkey")
    rank = F.when(k % 12 > 0, k % 12)
    keys = policy.achievements(F.col("won"), F.when(k % 7 == 0, 100).otherwise(50), F.when(k % 2 == 0, "speed_race").otherwise("duel"), F.col("ms"), F.col("comeback"), F.col("streak"), F.col("played"), F.col("elo"), F.lit(0), rank)
    return s.select("o_custkey", F.array_join(F.array_except(keys, F.array(F.lit("games_10"))), ",").alias("unlocked"))


@query("""with p as (select o_orderkey, case o_orderkey % 3 when 0 then 600 when 1 then 960 else 1260 end as cents, case when o_orderkey % 2 = 0 then 'INR' else 'USD' end as cur, (80 + o_custkey % 9)::decimal(18,4) + 0.35 as rate, (o_orderkey % 4)::int as seats from orders), u as (select *, case when cur = 'USD' then cents else round(cents::decimal(18,0) * rate, 0)::bigint end as unit from p)
select o_orderkey, unit, unit + case when seats >= 1 then unit else 0 end + case when seats >= 2 then round(unit::decimal(18,0) * 80 / 100, 0)::bigint else 0 end + case when seats >= 3 then round(unit::decimal(18,0) * 60 / 100, 0)::bigint else 0 end as total, cents as back from u""")
def family_quotes(orders):
    k = F.col("o_orderkey")
    currency, rate = F.when(k % 2 == 0, "INR").otherwise("USD"), (80 + F.col("o_custkey") % 9).cast("decimal(18,4)") + F.lit("0.35").cast("decimal(18,4)")
    unit = policy.to_minor(F.when(k % 3 == 0, 600).when(k % 3 == 1, 960).otherwise(1260), currency, rate)
    return orders.select("o_orderkey", unit.alias("unit"), policy.family_total(unit, k % 4).alias("total"), policy.to_usd_cents(unit, currency, rate).alias("back"))


@query("""with s as (select c_custkey as child, c_nationkey as family, c_custkey % 4 > 0 as active, row_number() over (partition by c_nationkey order by c_custkey desc) as n from customer), p as (select n_nationkey, case n_regionkey when 0 then 'pro' when 1 then 'bundle_2' else 'free' end as tier from nation)
select child, case when active then tier else 'free' end as tier, case n when 1 then 100 when 2 then 80 else 60 end as percent from s join p on family = n_nationkey""")
def family_tiers(customer, nation):
    """Children take their parent's tier while the seat is active; discounts follow the seat's rank."""
    seats = customer.select(F.col("c_custkey").alias("child"), F.col("c_nationkey").alias("family"), F.when(F.col("c_custkey") % 4 > 0, "active").otherwise("closed").alias("status"))
    parents = nation.select(F.col("n_nationkey").alias("family"), F.when(F.col("n_regionkey") == 0, "pro").when(F.col("n_regionkey") == 1, "bundle_2").otherwise("free").alias("tier"))
    ranked = policy.seat_discounts(seats.withColumn("number", -F.col("child")), "family", "number")
    return policy.tiers_of_children(ranked, parents, "family", "child", "status", "tier").join(ranked.select("child", "percent"), "child")


@query(f"""with s as (select o_orderkey, case o_orderkey % 4 when 0 then 'active' when 1 then 'trialing' when 2 then 'past_due' else 'cancelled' end as status, case when o_custkey % 2 = 0 then o_orderdate::date end as due, o_orderdate::date + 5 as upd, o_custkey % 3 = 0 as cancels, o_orderdate::date + 30 as ends, case when o_custkey % 5 > 0 then o_orderdate::date + 14 end as trial from orders),
c as (select *, case when status = 'past_due' and coalesce(due, upd) + 7 < date '1997-06-01' then 'grace_exhausted' when status in ('active', 'trialing') and cancels and ends < date '1997-06-01' then 'period_closed' when status = 'trialing' and trial + 7 < date '1997-06-01' then 'trial_overdue' end as cause from s)
select o_orderkey, case cause when 'grace_exhausted' then 'unpaid' when 'period_closed' then 'cancelled' else status end as status, cause from c""")
def dunning_sweep(orders):
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    rows = orders.select(
        "o_orderkey", F.when(k % 4 == 0, "active").when(k % 4 == 1, "trialing").when(k % 4 == 2, "past_due").otherwise("cancelled").alias("status"), F.when(F.col("o_custkey") % 2 == 0, day).alias("past_due_since"), F.date_add(day, 5).alias("updated_at"),
        (F.col("o_custkey") % 3 == 0).alias("cancel_at_period_end"), F.date_add(day, 30).alias("current_period_end"), F.when(F.col("o_custkey") % 5 > 0, F.date_add(day, 14)).alias("trial_ends_at"),
    )
    return policy.sweep(rows, F.lit("1997-06-01").cast("date"), 7).select("o_orderkey", "status", "cause")


@query("""with m as (select o_orderkey as k, o_orderkey % 2 = 0 as won, o_custkey % 9 as margin, o_custkey % 4 as traps from orders), s as (select *, case when not won and margin <= 1 then 'close_loss' when k % 3 = 0 and k % 5 = 0 then 'speed_accuracy_tradeoff' when traps >= 3 then 'trap_victim' when won and margin >= 5 then 'blowout_winner' when not won and margin >= 5 then 'self_deprecating_loss' when won and k % 7 = 0 then 'comeback' end as id from m)
select k as o_orderkey, id, case when id is not null then (('0x' || substr(sha256(k || ':' || id), 1, 16))::ubigint % 3)::int end as template from s""")
def post_match_messages(orders):
    k, margin = F.col("o_orderkey"), F.col("o_custkey") % 9
    won = k % 2 == 0
    facts = {"close_loss": ~won & (margin <= 1), "speed_accuracy_tradeoff": (k % 3 == 0) & (k % 5 == 0), "trap_victim": F.col("o_custkey") % 4 >= 3, "blowout_winner": won & (margin >= 5), "self_deprecating_loss": ~won & (margin >= 5), "comeback": won & (k % 7 == 0)}
    x = policy.post_match_message(facts, k, dict.fromkeys(facts, 3))
    return orders.select("o_orderkey", x["id"].alias("id"), x["template"].alias("template"))


@query("""with o as (select doc_id, 'LEVEL' || (quality + toxic) as level, doc_id % 7 as moment, 'r' || toxic as reason from labels union all select doc_id, 'LEVEL9', 8, 'again' from labels where doc_id % 4 = 0)
select doc_id, coalesce(lag(level) over (partition by doc_id order by moment), case when doc_id % 3 = 0 then 'SANDBOX' end) as previous, level as new, reason, moment from o""")
def override_trail(labels, documents):
    verdicts = documents.filter("doc_id % 3 = 0").select("doc_id", F.lit("SANDBOX").alias("level"))
    over = labels.select("doc_id", F.concat(F.lit("LEVEL"), F.col("quality") + F.col("toxic")).alias("level"), (F.col("doc_id") % 7).alias("at"), F.concat(F.lit("r"), "toxic").alias("reason"))
    again = labels.filter("doc_id % 4 = 0").select("doc_id", F.lit("LEVEL9").alias("level"), F.lit(8).cast("long").alias("at"), F.lit("again").alias("reason"))
    return policy.overridden(verdicts, over.union(again), "doc_id")[1].withColumnRenamed("at", "moment")


@query("""select doc_id, case when l.doc_id is null then 'SANDBOX' else 'LEVEL' || (quality + toxic) end as level from (select doc_id from documents where doc_id % 3 = 0) d full join labels l using (doc_id)""")
def overridden_levels(labels, documents):
    verdicts = documents.filter("doc_id % 3 = 0").select("doc_id", F.lit("SANDBOX").alias("level"))
    over = labels.select("doc_id", F.concat(F.lit("LEVEL"), F.col("quality") + F.col("toxic")).alias("level"), F.lit(1).alias("at"), F.lit("r").alias("reason"))
    return policy.overridden(verdicts, over, "doc_id")[0]


@query("""with u as (select c_custkey from customer where c_custkey % 10 = 0) select 'orders' as name, count(*) as rows from orders where o_custkey not in (from u) union all select 'customer', count(*) from customer where c_custkey not in (from u)""")
def erased_users(customer, orders):
    users = customer.filter("c_custkey % 10 = 0").select(F.col("c_custkey").alias("user"))
    left = policy.erased({"orders": orders.withColumnRenamed("o_custkey", "user"), "customer": customer.withColumnRenamed("c_custkey", "user")}, users, "user")
    count = lambda name: left[name].agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
    return count("orders").unionByName(count("customer"))


@query("""with s as (select p_partkey, p_brand from part where p_size <= 25 and p_partkey not in (select l_partkey from lineitem where l_quantity > 49) and p_retailprice not in (select p_retailprice from part where p_size = 1))
select p_brand, p_partkey from (select *, row_number() over (partition by p_brand order by sha256('next:' || p_partkey)) as place from s) where place <= 3""")
def unseen_items(part, lineitem):
    """Of each brand three items of the level, by hash order, none seen and none with seen parameters."""
    level = part.filter("p_size <= 25").join(lineitem.filter("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti")
    fresh = level.join(part.filter("p_size = 1").select("p_retailprice"), "p_retailprice", "left_anti")
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy(hash_order("next", "p_partkey")))
    return fresh.withColumn("place", place).filter("place <= 3").select("p_brand", "p_partkey")


@query("""select p_partkey, p_brand, case when p_brand in ('Brand#11', 'Brand#12') and p_size <= 20 then 'listed' when p_brand not in ('Brand#11', 'Brand#12') then 'remainder' end as pool from part where p_retailprice > 0""")
def pool_eligibility(part):
    listed = F.col("p_brand").isin("Brand#11", "Brand#12")
    return part.filter("p_retailprice > 0").select("p_partkey", "p_brand", F.when(listed & (F.col("p_size") <= 20), "listed").when(~listed, "remainder").alias("pool"))


@query("""select o_custkey, max(o_orderkey) filter (o_orderstatus = 'F') as last_done, count(*) filter (o_orderkey > coalesce(f, -1)) as since from orders join (select o_custkey, max(o_orderkey) filter (o_orderstatus = 'F') as f from orders group by 1) using (o_custkey) group by 1""")
def since_last(orders):
    """What came after a customer's last finished order; all of it where there is none."""
    last = orders.groupBy("o_custkey").agg(F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))).alias("last_done"))
    return orders.join(last, "o_custkey").groupBy("o_custkey", "last_done").agg(F.count_if(F.col("o_orderkey") > F.coalesce("last_done", F.lit(-1))).alias("since"))


@query(f"""select user_id, ts::date as day, count(*) as used, greatest(0, 5 - count(*)) as left_, sum(value) > 100 as heavy from events where event_type = 'click' group by 1, 2""")
def daily_budget(events):
    n = F.count("*")
    return events.filter("event_type = 'click'").groupBy("user_id", F.to_date("ts").alias("day")).agg(n.alias("used"), F.greatest(F.lit(0), 5 - n).alias("left_"), (F.sum("value") > 100).alias("heavy"))


@query("""select user_id, count(*) as served, count(*) filter (event_type = 'click') as from_cache, count(*) filter (value > 20) as checkable, count(*) filter (event_type = 'error' and value <= 5) as withheld_trust, count(*) filter (event_type = 'error' and value > 5) as withheld_length from events group by 1""")
def session_counters(events):
    reason = F.when((F.col("event_type") == "error") & (F.col("value") <= 5), "trust").when(F.col("event_type") == "error", "length")
    return events.withColumn("reason", reason).groupBy("user_id").agg(
        F.count("*").alias("served"), F.count_if(F.col("event_type") == "click").alias("from_cache"), F.count_if(F.col("value") > 20).alias("checkable"), F.count_if(F.col("reason") == "trust").alias("withheld_trust"), F.count_if(F.col("reason") == "length").alias("withheld_length")
    )


@query("""select p_partkey, round(0.40 * least(1, p_size / 50.0::double) + 0.20 * (p_partkey % 10) / 10.0::double + 0.25 * (p_partkey % 7) / 7.0::double + 0.15 * (p_retailprice > 1000)::int, 6) as health, case when p_partkey % 3 = 0 then 'answer_only' when p_partkey % 3 = 1 then 'answer_and_solution' else 'none' end as verified from part""")
def health_scores(part):
    k = F.col("p_partkey")
    score = 0.40 * F.least(F.lit(1.0), F.col("p_size") / 50.0) + 0.20 * (k % 10) / 10.0 + 0.25 * (k % 7) / 7.0 + 0.15 * (F.col("p_retailprice") > 1000).cast("int")
    answer, solution = k % 3 < 2, k % 3 == 1
    return part.select("p_partkey", F.round(score, 6).alias("health"), F.when(answer & solution, "answer_and_solution").when(answer, "answer_only").otherwise("none").alias("verified"))


@query("""with s as (select user_id, ts::date as day, event_id, value, row_number() over (partition by ts::date order by value desc, ts, event_id) as n, rank() over (partition by ts::date order by value desc, ts) as rank from events) select day, event_id, rank from s where n <= 10""")
def daily_ranks(events):
    day = F.to_date("ts")
    order = Window.partitionBy(day).orderBy(F.col("value").desc(), "ts")
    rows = events.select(day.alias("day"), "event_id", F.rank().over(order).alias("rank"), F.row_number().over(Window.partitionBy(day).orderBy(F.col("value").desc(), "ts", "event_id")).alias("n"))
    return rows.filter("n <= 10").drop("n")


@query(f"""select c_custkey, sha256('round-7:' || c_custkey) as place, (('0x' || substr(sha256(c_custkey || ':deck'), 1, 16))::ubigint % 52)::int as card from customer""")
def shuffled_decks(customer):
    """A repeatable shuffle: players in hash order, a card by hash for each."""
    return customer.select("c_custkey", hash_order("round-7", "c_custkey").alias("place"), bucket64(F.concat_ws(":", F.col("c_custkey").cast("string"), F.lit("deck")), 52).cast("int").alias("card"))


@query(f"""select event_id, case when s < 60 then 'Just now' when s < 3600 then s // 60 || 'm ago' when s < 86400 then s // 3600 || 'h ago' when s < 172800 then 'Yesterday' else s // 86400 || 'd ago' end as label from (select event_id, epoch(timestamp '{AS_OF} 12:00:00')::bigint - epoch(date_trunc('second', ts))::bigint as s from events)""")
def relative_times(events):
    from quernstone.functions import relative_time

    seconds = F.unix_timestamp(F.lit(f"{AS_OF} 12:00:00").cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp"))
    return events.select("event_id", relative_time(seconds).alias("label"))

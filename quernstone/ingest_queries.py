"""Queries of event ingest, points, streaks and the learner model, registered beside the others."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quernstone import functions as Q
from quernstone.operators import ingest, learner
from quernstone.registry import AS_OF, query

CLASSES = {"view": "ui", "purchase": "psychometric", "signup": "conversion", "error": "ops"}
_BUCKET = "('0x' || substr(sha256(user_id || ':' || event_id), 1, 16))::ubigint % 10"
_DECIDED = f"""d as (select *, case event_type when 'view' then 'ui' when 'purchase' then 'psychometric' when 'signup' then 'conversion' when 'error' then 'ops' end as class, user_id % 4 = 0 as kid from events),
s as (select *, class is not null as known, coalesce(class, '') = 'ui' and {_BUCKET} <> 0 as sampled_out, kid and coalesce(class, '') = 'ui' as minimised from d)"""


def _decided(events):
    rows = ingest.decisions(events, 20_000, CLASSES).withColumn("meta", F.from_json("props", "map<string,string>"))
    return ingest.minimised(rows, F.col("user_id") % 4 == 0, "meta", ["k"])


@query(f"with {_DECIDED} select event_id, class, known, sampled_out, minimised, case when kid then 0 else len(json_keys(props)) end as n_keys from s")
def sampling_decisions(events):
    return _decided(events).select("event_id", "class", "known", "sampled_out", "minimised", F.size("meta").alias("n_keys"))


@query(f"""with e as (select * from events union all select * from events where event_id % 5 = 0), d as (select *, case event_type when 'view' then 'ui' when 'purchase' then 'psychometric' when 'signup' then 'conversion' when 'error' then 'ops' end as class from e),
s as (select *, coalesce(class, '') = 'ui' and {_BUCKET} <> 0 as sampled_out, user_id % 4 = 0 and coalesce(class, '') = 'ui' as minimised from d)
select count(distinct event_id) filter (not sampled_out and not minimised) as accepted, count(*) - count(distinct event_id) filter (not sampled_out and not minimised) - count(*) filter (sampled_out) as duplicates, count(*) filter (sampled_out) as sampled_out, count(*) filter (minimised and not sampled_out) as minimised, count(*) filter (class = 'psychometric') as psychometric, array_to_string(list_sort(list(distinct event_type) filter (class is null)), ',') as unknown_types from s""")
def ingest_report(events):
    return ingest.ingest_report(_decided(events.union(events.filter("event_id % 5 = 0"))))


@query("""with e as (select * from events union all select * from events where event_id % 3 = 0), a as (select distinct user_id, event_type as reason, event_id % 400 as ref, case event_type when 'purchase' then 10 when 'signup' then 25 when 'click' then 0 else 20 end as delta from e)
select user_id, sum(delta) as xp from a where delta <> 0 group by 1""")
def xp_awards(events):
    reason = F.when(F.col("event_type") == "purchase", "practice_correct").when(F.col("event_type") == "signup", "session_complete").when(F.col("event_type") != "click", "streak_day")
    rows = events.union(events.filter("event_id % 3 = 0")).select("user_id", F.concat_ws("-", reason, "event_type").alias("reason"), (F.col("event_id") % 400).alias("ref"), F.coalesce(Q.xp_of(reason), F.lit(0)).alias("delta"))
    return ingest.awards(rows, "user_id", "reason", "ref", "delta")


@query("""with v as (select user_id, ts, event_id, case when event_type = 'error' then -40.0 else 10.0 end as d from events), s as (select *, sum(d) over (partition by user_id order by ts, event_id rows unbounded preceding) as run from v)
select user_id, sum(d) - least(0, min(run)) as xp from s group by 1""")
def accumulated_xp(events):
    rows = events.select("user_id", "ts", "event_id", F.when(F.col("event_type") == "error", -40.0).otherwise(10.0).alias("xp"))
    return ingest.floored_total(rows, "user_id", ["ts", "event_id"], "xp")


@query(f"""with recursive a as (select user_id, least(ts::date, date '{AS_OF}') as day, row_number() over (partition by user_id order by event_id) as n from events),
f as (select distinct user_id, 0::bigint as n, 0 as current, 0 as longest, null::date as last from a union all
select f.user_id, f.n + 1, case when last = day then current when last = day - 1 then current + 1 when last > day then current else 1 end, greatest(longest, case when last = day then current when last = day - 1 then current + 1 when last > day then current else 1 end), case when last > day then last else day end from f join a on a.user_id = f.user_id and a.n = f.n + 1)
select user_id, arg_max(current, n) as current, arg_max(longest, n) as longest, arg_max(last, n) as last_day, case when arg_max(last, n) between date '{AS_OF}' - 1 and date '{AS_OF}' then arg_max(current, n) else 0 end as live from f group by 1""")
def streak_fold(events):
    """Days as they arrive, in the order of event_id, which is not the order of time."""
    today = F.lit(AS_OF).cast("date")
    days = events.select("user_id", "event_id", F.to_date("ts").alias("day"))
    return ingest.arrival_streaks(days, "user_id", "day", ["event_id"], today).withColumn("live", ingest.live_streak(F.col("current"), F.col("last_day"), today))


@query("""with o as (select *, event_id % 7 as attempts from events where event_type in ('purchase', 'signup') and event_id % 7 < 5 order by ts, event_id limit 200)
select event_id, case when value < 1 then 'skipped' when event_id % 3 > 0 then 'done' when attempts + 1 >= 5 then 'failed' else 'pending' end as status, case when value < 1 then 'no_target' end as skip_reason, attempts + 1 as attempts from o""")
def outbox_drain(events):
    rows = events.filter(F.col("event_type").isin("purchase", "signup")).withColumn("attempts", F.col("event_id") % 7)
    return ingest.drain(rows, "event_id", ["ts", "event_id"], "attempts", F.col("event_id") % 3 > 0, F.when(F.col("value") < 1, "no_target"))


@query("""select user_id, event_type as target, arg_max(value, (ts, event_id)) as level, max(ts) as at from events where event_type <> 'view' group by 1, 2""")
def event_edges(events):
    """Edges from users to targets, the last event wins."""
    rows = events.filter("event_type != 'view'")
    return rows.groupBy("user_id", F.col("event_type").alias("target")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("level"), F.max("ts").alias("at"))


@query(f"""with s as (select user_id, event_type, arg_max(value, (ts, event_id)) as p from events where event_type <> 'error' group by 1, 2), r as (select *, row_number() over (partition by user_id order by round_even(p * 100, 0) desc, event_type) as place from s)
select user_id, event_type as name, round_even(p * 100, 0)::bigint as value, place from r where place <= 3""")
def top_states(events):
    """A learner's latest state by skill, kept as a map and taken apart again: the best three."""
    latest = events.filter("event_type != 'error'").groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("p"))
    maps = latest.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "p"))).alias("states"))
    items = F.transform(F.map_entries("states"), lambda e: F.struct((-F.bround(e["value"] * 100, 0)).cast("long").alias("v"), e["key"].alias("name")))
    best = F.slice(F.array_sort(items), 1, 3)
    return maps.select("user_id", F.posexplode(best).alias("at", "x")).select("user_id", "x.name", (-F.col("x.v")).alias("value"), (F.col("at") + 1).alias("place"))


@query("""select event_id, ts < timestamp '2024-01-28 12:00:00' - interval 720 hours as gone_ghost, ts < timestamp '2024-01-28 12:00:00' - interval 24 hours as gone_tray, event_id % 30 >= 20 and event_type not in ('purchase', 'signup') as poison from events""")
def expiry_and_poison(events):
    now = F.lit("2024-01-28 12:00:00").cast("timestamp_ntz")
    kinds = {"purchase": "psychometric", "signup": "psychometric", "view": "ui"}
    return events.select("event_id", ingest.expired(F.col("ts"), now, 720).alias("gone_ghost"), ingest.expired(F.col("ts"), now, 24).alias("gone_tray"), ingest.dropped_as_poison(F.col("event_id") % 30, F.col("event_type"), kinds).alias("poison"))


@query("""with m as (select o_custkey, o_totalprice, o_orderdate, o_orderkey, row_number() over (partition by o_orderdate::date order by o_totalprice desc, o_orderkey) as place, count(*) over (partition by o_orderdate::date) as players from orders)
select o_custkey, count(*) as played, count(*) filter (place = 1) as won, sum(case when players = 1 then 0 when o_orderkey % 3 = 0 then (case when place = 1 then 50 else 15 end) // 2 when place = 1 then 50 else 15 end)::bigint as xp from m group by 1""")
def match_completion(orders):
    """All who ordered on a day played each other: results by rank, points halved where a bot took part."""
    day = Window.partitionBy(F.to_date("o_orderdate"))
    rows = orders.withColumn("place", F.row_number().over(day.orderBy(F.col("o_totalprice").desc(), "o_orderkey"))).withColumn("players", F.count("*").over(day))
    reason = F.when(F.col("place") == 1, "duel_win").otherwise("duel_loss")
    points = F.when(F.col("players") > 1, Q.xp_of(reason, F.col("o_orderkey") % 3 == 0)).otherwise(0)
    return rows.groupBy("o_custkey").agg(F.count("*").alias("played"), F.count_if(F.col("place") == 1).alias("won"), F.sum(points).cast("long").alias("xp"))


# Learner model ------------------------------------------------------------------------


@query("""with recursive a as (select user_id, event_type = 'purchase' as correct, event_id % 6 as level, row_number() over (partition by user_id order by ts, event_id) as n from events),
f as (select distinct user_id, 0::bigint as n, 0.35::double as p from a union all
select f.user_id, f.n + 1, q + (1 - q) * case level when 1 then 0.4 when 2 then 0.3 when 3 then 0.25 when 4 then 0.2 when 5 then 0.15 else 0.14 end from (select f.*, level, case when correct then p * 0.9 / (p * 0.9 + (1 - p) * 0.2) else p * 0.1 / (p * 0.1 + (1 - p) * 0.8) end as q from f join a on a.user_id = f.user_id and a.n = f.n + 1) f)
select user_id, round(arg_max(p, n), 6) as p_learned, max(n) as attempts from f group by 1""")
def tracing_by_difficulty(events):
    rows = events.withColumn("correct", F.col("event_type") == "purchase").withColumn("level", F.col("event_id") % 6)
    return learner.bkt_fold(rows, "user_id", ["ts", "event_id"], difficulty="level").select("user_id", F.round("p_learned", 6).alias("p_learned"), F.col("attempts").cast("long").alias("attempts"))


@query("""with a as (select user_id, event_type in ('purchase', 'click') as correct, value < 15 as under, row_number() over (partition by user_id order by ts, event_id) as n from events),
g as (select user_id, count(*) as attempts, count(*) filter (correct) as r, arg_max(under, n) as under, max(n) filter (correct) as lr, max(n) filter (not correct) as lw, max(n) as last from a group by 1),
m as (select *, r::double / attempts * 100 as acc, least(100, floor(r::double / attempts * 100 * 0.6 + case when under then 40 else 20 end + 0.5)) as mastery, last - coalesce(lw, 0) as up, last - coalesce(lr, 0) as down from g)
select user_id, attempts, r as "right", acc as accuracy, mastery, case when mastery < 50 or down >= 3 then 'fractured' when mastery >= 80 and up >= 5 then 'fluid' else 'fragile' end as state from m""")
def skill_states(events):
    rows = events.withColumn("correct", F.col("event_type").isin("purchase", "click")).withColumn("under_target", F.col("value") < 15)
    return learner.state_fold(rows, "user_id", ["ts", "event_id"])


@query("""with p as (select p_partkey, p_size / 50.0::double as p, p_partkey % 200 - 3 as days, p_partkey % 40 as n from part)
select p_partkey, round(case when days <= 0 then p else p * pow(1 - 0.007::double, days / 45.0) end, 9) as decayed, case when p >= 0.85 then 'fluid' when p >= 0.6 then 'proficient' else 'learning' end as gate, round(case when n < 20 then 0.35 else (20 * 0.35::double + n * p) / (20 + n) end, 9) as prior,
case when p_partkey % 5 = 0 or p_partkey % 7 = 0 then 'exam_prep' when p_partkey % 5 = 1 and p_size % 11 >= 5 then 'vedic_standalone' else 'core_math_vedic' end as path from p join part using (p_partkey)""")
def learner_gates(part):
    p, k = F.col("p_size") / F.lit(50.0), F.col("p_partkey")
    goal = F.when(k % 5 == 0, "exam_prep").when(k % 5 == 1, "speed").otherwise("basics")
    return part.select(
        "p_partkey", F.round(Q.decayed(p, k % 200 - 3), 9).alias("decayed"), Q.bkt_gate(p).alias("gate"), F.round(Q.shrunk_prior(F.lit(0.35), p, k % 40), 9).alias("prior"),
        Q.learning_path(goal, F.when(k % 7 == 0, "cat"), F.col("p_size") % 11).alias("path"),
    )


@query("""with r as (select p_brand, p_partkey, p_size * 2 as m, p_partkey % 2 = 0 as hy, p_partkey % 3 = 0 as weak, p_partkey % 15 as idle, p_partkey % 20 as left_, p_brand like '%1' as dc from part),
b as (select *, case when m >= 90 then 0.05 when m >= 70 then 0.15 when m >= 50 then 0.3 else 0.4 end::double as base from r),
w as (select *, case when not dc then base when m >= 90 then 0.01 else base * case when hy then 2.0 else 0.1 end::double * case when m >= 50 and m < 70 then 1.5 else 1.0 end::double end::double * case when weak then 1.5 else 1.0 end::double * case when idle > 7 then 1.5 else 1.0 end::double * case when left_ <= 3 then 2.0 when left_ <= 7 then 1.5 when left_ <= 14 then 1.2 else 1.0 end::double as raw from b)
select p_brand, p_partkey, round(raw / sum(raw) over (partition by p_brand), 9) as weight from w""")
def daily_weights(part):
    k = F.col("p_partkey")
    facts = {"mastery": F.col("p_size") * 2, "high_yield": k % 2 == 0, "weak": k % 3 == 0, "idle_days": k % 15, "days_left": k % 20, "damage_control": F.col("p_brand").like("%1")}
    return learner.daily_weights(part, "p_brand", **facts).select("p_brand", "p_partkey", F.round("weight", 9).alias("weight"))


@query("""with c as (select c_custkey, c_custkey % 7 as a, c_custkey % 4 as b, c_custkey % 3 > 0 as fluid, c_custkey % 5 > 0 as fragile, 5 + c_custkey % 30 as size from customer),
s as (select *, case a when 0 then [70, 15, 15] when 1 then [50, 30, 20] when 2 then [40, 30, 30] when 3 then [60, 20, 20] else case b when 0 then [70, 15, 15] when 1 then [50, 30, 20] else [60, 20, 20] end end as sh from c),
r as (select *, case when fluid then sh else [0, sh[2] + 30, sh[3] + 30] end as s1 from s), t as (select *, case when fragile then s1 else [s1[1] + 10, 0, s1[3] + 10] end as s2 from r),
x as (select c_custkey, size, unnest([1, 2, 3]) as place, unnest(s2) as w from t), e as (select *, w * size / sum(w) over (partition by c_custkey)::double as exact from x),
f as (select *, floor(exact) as base, row_number() over (partition by c_custkey order by round(exact - floor(exact), 9) desc, place) as rank from e)
select c_custkey, ['primary', 'sinking', 'frontier'][place] as bucket, (base + case when rank <= size - sum(base) over (partition by c_custkey) then 1 else 0 end)::bigint as seats from f""")
def session_allocation(customer):
    k = F.col("c_custkey")
    cluster = F.when(k % 7 == 0, "sprinter").when(k % 7 == 1, "rebuilder").when(k % 7 == 2, "wanderer").when(k % 7 == 3, "balanced").otherwise("unknown")
    persona = F.when(k % 4 == 0, "SpeedDemon").when(k % 4 == 1, "BrainTrainer")
    rows = customer.withColumns({"cluster": cluster, "persona": persona})
    return learner.session_allocation(rows, "c_custkey", "persona", "cluster", k % 3 > 0, k % 5 > 0, 5 + k % 30).select("c_custkey", "bucket", F.col("seats").cast("long").alias("seats"))


@query("""select p_partkey, floor(30 * case when a between 8 and 10 then 2.5 when a between 11 and 13 then 2.0 when a between 14 and 17 then 1.5 when a between 18 and 25 then 1.0 when a between 26 and 40 then 1.2 when a between 41 and 60 then 1.5 when a between 61 and 200 then 2.0 when a < 8 then 2.5 else 2.0 end + 0.5)::bigint as target,
least(300, greatest(15, 5 * round_even(30 * (1 + 0.5 * (least(5, greatest(1, d)) - 1)) * (1 + 0.15::double * (least(7, greatest(1, l)) - 2)) * least(1.5, 1 + 0.05::double * greatest(0, s - 4)) / 5, 0))) as expected from (select p_partkey, p_partkey % 90 as a, p_partkey % 7 as d, p_size % 9 as l, p_size % 13 as s from part)""")
def item_times(part):
    k = F.col("p_partkey")
    return part.select("p_partkey", Q.target_seconds(k % 90).alias("target"), Q.expected_seconds(k % 7, F.col("p_size") % 9, F.col("p_size") % 13).alias("expected"))


@query("""with e as (select user_id, case event_type when 'purchase' then 0.8 when 'click' then 0.5 else 0.2 end::double as prior, value as t from events) select user_id, avg(prior) as prior, quantile_cont(t, 0.5) as baseline from e group by 1""")
def calibration(events):
    """Warm-up outcomes as priors by learner, and the median time as baseline."""
    prior = F.when(F.col("event_type") == "purchase", 0.8).when(F.col("event_type") == "click", 0.5).otherwise(0.2)
    return events.groupBy("user_id").agg(F.avg(prior).alias("prior"), F.percentile("value", 0.5).alias("baseline"))


@query("""with s as (select user_id, event_type, count(*) filter (value > 10) as errors from events group by 1, 2), p as (select *, least(0.95, 0.8::double + 0.1 * (errors - 1)) as priority, row_number() over (partition by user_id order by least(0.95, 0.8::double + 0.1 * (errors - 1)) desc, event_type) as place from s where errors > 0)
select user_id, event_type, round(priority, 6) as priority, place from p where priority > 0.7 and place <= 5""")
def review_queue(events):
    """Skills by the errors in them: a first one weighs 0.8, each more 0.1, at most 0.95; the five most urgent."""
    skills = events.groupBy("user_id", "event_type").agg(F.count_if(F.col("value") > 10).alias("errors")).filter("errors > 0")
    rows = skills.withColumn("priority", F.least(F.lit(0.95), 0.8 + 0.1 * (F.col("errors") - 1))).filter("priority > 0.7")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("priority").desc(), "event_type"))
    return rows.withColumn("place", place).filter("place <= 5").select("user_id", "event_type", F.round("priority", 6).alias("priority"), "place")


@query("""select o_orderkey, epoch_ms(date_trunc('month', o_orderdate)::timestamp) as start_ms, epoch_ms((date_trunc('month', o_orderdate) + interval 1 month)::timestamp) as end_ms from orders""")
def month_bounds(orders):
    b = Q.month_bounds(F.col("o_orderdate").cast("timestamp"))
    return orders.select("o_orderkey", b["start"].alias("start_ms"), b["end"].alias("end_ms"))

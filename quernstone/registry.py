"""Queries over the given tables and, beside each, the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone import functions as Q
from quernstone.operators import analytics, graph, learner
from quernstone.variants import variant, variant_sql
from quernstone.sources import guarded_upsert, promotion_diff, reconcile, table, upsert_last

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
AS_OF = "2024-01-28"


def query(sql: str | None = None):
    """Registers a function of tables: its parameters name them."""

    def add(f):
        names = f.__code__.co_varnames[: f.__code__.co_argcount]
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*(table(spark, sf_dir, n) for n in names))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"""select 'dau' as metric, count(distinct user_id)::double as value from events where event_type='view' and ts::date = date '{AS_OF}'
union all select 'mau', count(distinct user_id) from events where event_type='view' and ts::date > date '{AS_OF}' - 30 and ts::date <= date '{AS_OF}'
union all select 'avg_minutes', round(avg(value), 1) from events where ts::date > date '{AS_OF}' - 7 and ts::date <= date '{AS_OF}'""")
def kpi_dashboard(events):
    return analytics.kpis(events, AS_OF, "view", "value")


@query("""with s as (select o_custkey, count(*) * 50 as xp from orders group by 1), r as (select *, rank() over (order by xp desc) as rank, count(*) over () as n from s)
select o_custkey, xp, rank, n, least(99, greatest(0, round_even(100.0::double * (1 - (rank - 0.5::double) / n), 0)))::int as percentile from r""")
def leaderboard_percentile(orders):
    return analytics.leaderboard(orders.groupBy("o_custkey").agg((F.count("*") * 50).alias("xp")), "o_custkey", "xp")


@query("""with s as (select c_mktsegment, o_orderstatus, count(*) as n, sum(o_totalprice) as total from orders join customer on o_custkey = c_custkey where o_orderstatus in ('O','P') group by all)
select c_mktsegment, o_orderstatus, n, round(total / 100.0, 2) as mrr from s""")
def revenue_by_tier(orders, customer):
    live = orders.filter(F.col("o_orderstatus").isin("O", "P")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return live.groupBy("c_mktsegment", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice") / 100.0, 2).alias("mrr"))


@query("""select user_id, event_type, max(ts::date) as last_day, round(avg(value), 6) as avg_value, arg_max(value, (ts, event_id)) as latest from events group by 1, 2""")
def technique_summary(events):
    return events.groupBy("user_id", "event_type").agg(F.max(F.to_date("ts")).alias("last_day"), F.round(F.avg("value"), 6).alias("avg_value"), F.max_by("value", F.struct("ts", "event_id")).alias("latest"))


_ATTEMPTS = "select *, case when event_type='signup' then null else event_type='purchase' end as correct, floor(value * 1000)::bigint as time_ms from events"


def _attempts(events):
    return events.withColumn("correct", F.when(F.col("event_type") != "signup", F.col("event_type") == "purchase")).withColumn("time_ms", F.floor(F.col("value") * 1000))


@query(f"""with a as ({_ATTEMPTS}), m as (select user_id, avg(correct::int) as accuracy, count(*) as volume, quantile_cont(time_ms, 0.5) filter (time_ms > 0) as median_ms, list_sort(list(time_ms) filter (time_ms > 0)) as t from a group by 1),
d as (select distinct user_id, ts::date as day from events), i as (select user_id, day - (row_number() over (partition by user_id order by day))::int as island from d), s as (select user_id, max(n) as longest from (select user_id, island, count(*) as n from i group by 1, 2) group by 1),
p as (select user_id, avg(n) as per_day from (select user_id, ts::date, count(*) as n from events group by 1, 2) group by 1),
x as (select *, t[len(t) // 4 + 1] as p25, len(list_filter(t, lambda v: v <= 1.5 * median_ms)) / len(t) as f from m join s using (user_id) join p using (user_id))
select user_id, volume, round(least(1, greatest(0, 1 - median_ms / 60000)), 6) as speed, round(least(1, greatest(0, accuracy)), 6) as logic, round(least(1, greatest(0, per_day / 25)), 6) as stamina, round(least(1, greatest(0, f)), 6) as focus, round(least(1, greatest(0, longest / 7)), 6) as memory, round(least(1, greatest(0, 1 - p25 / 20000.0::double)), 6) as reflex from x""")
def radar(events):
    days = events.withColumn("day", F.to_date("ts"))
    return analytics.radar(_attempts(events), "user_id", days.groupBy("user_id", "day").agg(F.count("*").alias("n")), analytics.streaks(days, "user_id", "day"))


@query(f"""with a as ({_ATTEMPTS}) select event_type, avg(coalesce(correct, false)::int) as accuracy, count(*) as n from a group by 1 having avg(coalesce(correct, false)::int) < 0.7""")
def weak_areas(events):
    return analytics.weak_areas(_attempts(events), "event_type")


@query("""with d as (select distinct user_id, ts::date as day from events), i as (select *, day - (row_number() over (partition by user_id order by day))::int as island from d),
r as (select user_id, island, count(*) as length, max(day) as e from i group by 1, 2)
select user_id, max(length) as longest, max(e) as last_day, arg_max(length, e) as current from r group by 1""")
def day_streaks(events):
    return analytics.streaks(events.withColumn("day", F.to_date("ts")), "user_id", "day")


@query("""with r as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events), s as (select *, sum((event_type <> 'purchase' and event_type <> 'click')::int) over (partition by user_id order by n) as miss from r where n <= 30)
select user_id, count(*) filter (miss = 0) as streak from s group by 1""")
def leading_streak(events):
    return analytics.leading_run(events, "user_id", [F.col("ts").desc(), F.col("event_id").desc()], F.col("event_type").isin("purchase", "click"))


@query("""with u as (select user_id, min(ts::date) as joined from events group by 1), p as (select u.user_id, joined, max((datediff('day', joined, ts::date) between 7 and 13)::int) as w1, max((datediff('day', joined, ts::date) between 14 and 20)::int) as w2 from u left join events using (user_id) group by all)
select date_trunc('week', joined)::date as cohort, count(*) as users, round(100.0 * sum(w1) / count(*), 1) as w1, round(100.0 * sum(w2) / count(*), 1) as w2 from p group by 1""")
def cohort_retention(events):
    days = events.select("user_id", F.to_date("ts").alias("day")).distinct()
    return analytics.cohort_retention(days.groupBy("user_id").agg(F.min("day").alias("joined")), days, "user_id", "joined", "day")


@query("""with r as (select *, rank() over (partition by c_nationkey order by c_acctbal) - 1 as below, count(*) over (partition by c_nationkey, c_acctbal) - 1 as same, count(*) over (partition by c_nationkey) - 1 as others from customer)
select c_custkey, case when others > 0 then round_even(100.0::double * (below + 0.5 * same) / others, 0)::int else 50 end as percentile from r""")
def midrank_percentile(customer):
    return analytics.midrank_percentile(customer, "c_nationkey", "c_acctbal").select("c_custkey", "percentile")


@query("""with c as (select user_id, event_id as conversion_id, ts as c from events where event_type='purchase'), t as (select user_id, event_id as touch_id, ts as t from events where event_type='click')
select user_id, conversion_id, arg_max(touch_id, (exp(-0.000099 * (epoch(date_trunc('second', c)) - epoch(date_trunc('second', t)))), touch_id)) as touch_id from c join t using (user_id) group by 1, 2""")
def decay_attribution(events):
    pick = lambda kind, name, at: events.filter(F.col("event_type") == kind).select("user_id", F.col("event_id").alias(name), F.col("ts").cast("timestamp").alias(at))
    return analytics.decay_attribution(pick("click", "touch_id", "touched_at"), pick("purchase", "conversion_id", "converted_at"), "user_id")


@query("""select user_id, event_type, ts::date as day, count(*) as attempts, sum(value) as total from events group by 1, 2, 3""")
def daily_progression(events):
    return events.groupBy("user_id", "event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("attempts"), F.sum("value").alias("total"))


@query(f"""with d as (select distinct user_id, ts::date as day from events)
select user_id, array_to_string(list_transform(range(7), lambda i: list_contains(list(day), date_trunc('week', date '{AS_OF}')::date + i::int)::int), '') as week from d group by 1""")
def week_grid(events):
    days = events.groupBy("user_id").agg(F.collect_set(F.to_date("ts")).alias("days"))
    monday = F.to_date(F.date_trunc("week", F.to_date(F.lit(AS_OF))))
    return days.select("user_id", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.array_contains("days", F.date_add(monday, i)).cast("int").cast("string")), "").alias("week"))


@query("""select o_custkey, max(o_orderdate) as last_order, datediff('day', max(o_orderdate)::date, date '2000-01-01') as days_left from orders group by 1""")
def days_to_deadline(orders):
    return orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_order")).withColumn("days_left", F.datediff(F.lit("2000-01-01").cast("date"), F.to_date("last_order")).cast("long"))


@query("""select event_id, user_id, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n = 1""")
def latest_event(events):
    return events.groupBy("user_id").agg(F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("x")).select("x.event_id", "user_id", "x.value")


@query("""select l_orderkey, l_linenumber, l_partkey || case when count(*) over (partition by l_partkey) > 1 then '#' || row_number() over (partition by l_partkey order by l_orderkey, l_linenumber) else '' end as ref from lineitem""")
def occurrence_refs(lineitem):
    by = Window.partitionBy("l_partkey")
    n = F.row_number().over(by.orderBy("l_orderkey", "l_linenumber"))
    return lineitem.select("l_orderkey", "l_linenumber", F.concat(F.col("l_partkey").cast("string"), F.when(F.count("*").over(by) > 1, F.concat(F.lit("#"), n.cast("string"))).otherwise("")).alias("ref"))


@query("""with s as (select o_orderkey, o_custkey, o_orderkey % 7 as step, o_orderkey % 7 <= lag(o_orderkey % 7) over (partition by o_custkey order by o_orderkey) as falls from orders) select o_orderkey, step, sum(coalesce(falls, false)::int) over (partition by o_custkey order by o_orderkey rows unbounded preceding) as segment from s""")
def segments_by_restart(orders):
    """A step number that does not rise opens a new example."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = orders.select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 7).alias("step"))
    falls = rows.withColumn("falls", F.coalesce(F.col("step") <= F.lag("step").over(order), F.lit(False)).cast("int"))
    return falls.select("o_orderkey", "step", F.sum("falls").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("segment"))


@query("""select p_partkey, sha256('2024-01-28:' || p_partkey) as place from part order by place limit 10""")
def daily_pick(part):
    return part.select("p_partkey", Q.hash_order("2024-01-28", "p_partkey").alias("place")).orderBy("place").limit(10)


@query("""select event_id, (('0x' || substr(sha256(user_id || ':' || event_id), 1, 16))::ubigint % 10)::bigint as bucket from events""")
def stable_sampling(events):
    return events.select("event_id", Q.bucket64(F.concat_ws(":", F.col("user_id").cast("string"), F.col("event_id").cast("string")), 10).cast("long").alias("bucket"))


@query("""select c_custkey, (('0x' || substr(sha256(c_custkey || ':games'), 1, 16))::ubigint % 100) < 25 as enabled from customer""")
def rollout_flags(customer):
    return customer.select("c_custkey", Q.rollout("c_custkey", "games", 25).alias("enabled"))


@query("""select distinct p_brand as v, 'brand' as kind from part union select distinct p_type, 'type' from part""")
def union_branches(part):
    return part.select(F.col("p_brand").alias("v"), F.lit("brand").alias("kind")).union(part.select("p_type", F.lit("type"))).distinct()


@query("""select c_nationkey, c_name from customer anti join (select o_custkey from orders where o_orderpriority = '1-URGENT' and o_orderstatus = 'F') o on c_custkey = o_custkey""")
def customers_without_orders(customer, orders):
    """Customers without a finished urgent order."""
    done = orders.filter("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'")
    return customer.join(done, customer["c_custkey"] == done["o_custkey"], "left_anti").select("c_nationkey", "c_name")


@query("""select n_name, count(c_custkey) as customers, case when count(c_custkey) = 0 then 'absent' when count(c_custkey) < 3 then 'thin' when count(c_custkey) < 10 then 'adequate' else 'ample' end as supply from nation left join customer on n_nationkey = c_nationkey and c_acctbal > 0 group by 1""")
def supply_grade(nation, customer):
    n = F.count("c_custkey")
    grade = F.when(n == 0, "absent").when(n < 3, "thin").when(n < 10, "adequate").otherwise("ample")
    return nation.join(customer, (F.col("n_nationkey") == F.col("c_nationkey")) & (F.col("c_acctbal") > 0), "left").groupBy("n_name").agg(n.alias("customers"), grade.alias("supply"))


@query("""with p as (select distinct l_orderkey as k, l_suppkey as s from lineitem) select a.s as src, b.s as dst, count(*) as n from p a join p b on a.k = b.k and a.s < b.s group by 1, 2 having count(*) >= 2""")
def pair_support(lineitem):
    return graph.support(lineitem, "l_orderkey", "l_suppkey")


@query("""with t as (select doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) as n from documents) select doc_id, n as norm, sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) as hash from t join documents using (doc_id)""")
def text_keys(documents):
    return documents.select("doc_id", Q.norm("text").alias("norm"), F.sha2(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")), 256).alias("hash"))


CONCEPTS = ["Verbal Reasoning #", "Non-Verbal Reasoning #", "Logical Reasoning", "Logic Reasoning Tests", "Number Series #", "Numbers in Series", "Ratio of Parts", "In-equality Ratios"]


@query(f"""with l as (select distinct {variant_sql(CONCEPTS, "p_size")} as a from part), s as (select a, list_distinct(list_transform(list_filter(regexp_extract_all(lower(a), '[a-z]+'), lambda w: w not in ('and', 'of', 'the', 'in', 'to', 'for', 'a')), lambda w: left(w, 5))) as t from l)
select x.a as left_label, y.a as right_label, len(list_intersect(x.t, y.t))::double / len(list_distinct(x.t || y.t)) as similarity, regexp_matches(x.a, '(?i)^(non|un|in)[\\s-]?') <> regexp_matches(y.a, '(?i)^(non|un|in)[\\s-]?') as opposed from s x join s y on x.a < y.a where len(list_intersect(x.t, y.t))::double / len(list_distinct(x.t || y.t)) >= 0.6""")
def stem_similarity(part):
    """Labels that share most stems, with a warning where one of the two is negated."""
    labels = part.select(variant(CONCEPTS, "p_size").alias("label")).distinct()
    words = labels.withColumn("stems", Q.stem_set("label", stopwords=["and", "of", "the", "in", "to", "for", "a"])).select("label", "stems", F.explode("stems").alias("stem"))
    a, b = words.toDF("left_label", "x", "stem"), words.toDF("right_label", "y", "stem")
    pairs = a.join(b, "stem").filter("left_label < right_label").dropDuplicates(["left_label", "right_label"])
    negated = lambda c: F.col(c).rlike(r"(?i)^(non|un|in)[\s-]?")
    return pairs.select("left_label", "right_label", Q.jaccard("x", "y").alias("similarity"), (negated("left_label") != negated("right_label")).alias("opposed")).filter("similarity >= 0.6")


@query("""select sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) as hash, count(*) as members, min(doc_id) as first, count(distinct source) as sources from documents group by 1 having count(distinct source) > 1""")
def duplicates_across_sources(documents):
    return documents.groupBy(F.sha2(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")), 256).alias("hash")).agg(F.count("*").alias("members"), F.min("doc_id").alias("first"), F.count_distinct("source").alias("sources")).filter("sources > 1")


@query("""select event_id, json_extract_string(props, '$.k')::bigint as k, coalesce(json_extract_string(props, '$.missing'), json_extract_string(props, '$.k'))::double as either from events""")
def json_fields(events):
    field = lambda p: F.get_json_object("props", p)
    return events.select("event_id", field("$.k").cast("long").alias("k"), F.coalesce(field("$.missing"), field("$.k")).cast("double").alias("either"))


@query("""select o_orderkey, case when o_totalprice < 50000 then 'reject_fast' when o_orderstatus = 'F' and o_totalprice < 100000 then 'flag_fast' else 'ok' end as verdict, least(2400, greatest(600, 1000 + 400 * ((o_totalprice - 150000) / 100000))) as rating, floor(o_totalprice / 500) + 1 as level from orders""")
def ratings_and_levels(orders):
    p = F.col("o_totalprice")
    verdict = F.when(p < 50000, "reject_fast").when((F.col("o_orderstatus") == "F") & (p < 100000), "flag_fast").otherwise("ok")
    return orders.select("o_orderkey", verdict.alias("verdict"), Q.seed_rating((p - 150000) / 100000).alias("rating"), Q.level("o_totalprice").cast("double").alias("level"))


@query("""with s as (select c_nationkey, c_mktsegment, count(*) as w from customer group by 1, 2), e as (select *, w * 20 / sum(w) over (partition by c_nationkey)::double as exact from s),
r as (select *, floor(exact) as base, row_number() over (partition by c_nationkey order by round(exact - floor(exact), 9) desc, c_mktsegment) as place from e)
select c_nationkey, c_mktsegment, (base + case when place <= 20 - sum(base) over (partition by c_nationkey) then 1 else 0 end)::bigint as seats from r""")
def apportionment(customer):
    shares = customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("w"))
    return learner.apportion(shares, "c_nationkey", "c_mktsegment", "w", 20).select("c_nationkey", "c_mktsegment", F.col("seats").cast("long").alias("seats"))


@query("""with recursive a as (select user_id, event_type = 'purchase' as correct, row_number() over (partition by user_id order by ts, event_id) as n from events where event_type <> 'signup'),
f as (select distinct user_id, 0::bigint as n, 0.35::double as p from a union all
select f.user_id, f.n + 1, (case when correct then p * 0.9 / (p * 0.9 + (1 - p) * 0.2) else p * 0.1 / (p * 0.1 + (1 - p) * 0.8) end) * (1 - 0.14) + 0.14 from f join a on a.user_id = f.user_id and a.n = f.n + 1)
select user_id, round(arg_max(p, n), 6) as p_learned, max(n) as attempts from f group by 1""")
def knowledge_tracing(events):
    graded = events.filter("event_type != 'signup'").withColumn("correct", F.col("event_type") == "purchase")
    return learner.bkt_fold(graded, "user_id", ["ts", "event_id"]).select("user_id", F.round("p_learned", 6).alias("p_learned"), F.col("attempts").cast("long").alias("attempts"))


@query(None)
def glicko(lineitem):
    """Suppliers of an order play each other, the dearer line wins: no SQL, tests hold it to the published example."""
    rows = lineitem.groupBy("l_orderkey", "l_suppkey").agg(F.max("l_extendedprice").alias("score"))
    a, b = rows.toDF("m", "player", "x"), rows.toDF("m", "other", "y")
    games = a.join(b, "m").filter("player != other").select("player", F.lit(1500.0).alias("rating"), F.lit(200.0).alias("rd"), F.lit(0.06).alias("volatility"), F.lit(1500.0).alias("opponent_rating"), F.lit(200.0).alias("opponent_rd"), F.when(F.col("x") > F.col("y"), 1.0).when(F.col("x") == F.col("y"), 0.5).otherwise(0.0).alias("score"))
    return learner.glicko_period(games)


@query("""with u as (select event_id, user_id, value, ts, 0 as b from events where event_id % 3 <> 0 union all select event_id, user_id, value + 1, ts, 1 from events where event_id % 2 = 0)
select event_id, user_id, value from (select *, row_number() over (partition by event_id order by ts desc, b desc) as n from u) where n = 1""")
def upsert_last_wins(events):
    cols = ["event_id", "user_id", "value", "ts"]
    return upsert_last(events.filter("event_id % 3 != 0").select(*cols), events.filter("event_id % 2 = 0").withColumn("value", F.col("value") + 1).select(*cols), ["event_id"], "ts").drop("ts")


@query("""select doc_id, case when quality = 0 then 'QUARANTINED_SOFT' else 'TRUSTED' end as verdict from labels where not (quality = 0) union all select doc_id, case when toxic = 1 then 'QUARANTINED_HARD' else 'SANDBOX' end from labels where quality = 0""")
def guarded_verdicts(labels):
    old = labels.select("doc_id", F.when(F.col("quality") == 0, "QUARANTINED_SOFT").otherwise("TRUSTED").alias("verdict"))
    return guarded_upsert(old, labels.select("doc_id", F.when(F.col("toxic") == 1, "QUARANTINED_HARD").otherwise("SANDBOX").alias("verdict")), "doc_id", "verdict", "QUARANTINED")


@query("""select o_orderkey, 'me' as made_by from orders where o_orderstatus = 'O' union all select o_orderkey, 'other' from orders where o_orderstatus = 'F'""")
def edge_reconcile(orders):
    rows = orders.withColumn("made_by", F.when(F.col("o_orderstatus") == "F", "other").otherwise("me"))
    target = rows.filter("o_orderstatus != 'O' or o_orderkey % 2 = 0").select("o_orderkey", "made_by")
    return reconcile(target, rows.filter("o_orderstatus = 'O'").select("o_orderkey", "made_by"), ["o_orderkey"], "made_by", "me")


@query("""select coalesce(a.p_partkey, b.p_partkey) as p_partkey, case when a.p_partkey is null then 'added' when b.p_partkey is null then 'removed' else 'changed' end as change
from (select p_partkey, p_size from part where p_partkey % 7 <> 0) a full join (select p_partkey, case when p_partkey % 5 = 0 then p_size + 1 else p_size end as p_size from part where p_partkey % 11 <> 0) b on a.p_partkey = b.p_partkey where a.p_size is distinct from b.p_size""")
def shadow_diff(part):
    new = part.filter("p_partkey % 11 != 0").withColumn("p_size", F.when(F.col("p_partkey") % 5 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return promotion_diff(part.filter("p_partkey % 7 != 0"), new, ["p_partkey"], "p_size")


@query("""select doc_id, case when toxic = 1 then 'blocked' when quality = 0 then 'sandbox' when quality = 1 then 'servable' else 'refused' end as tier, toxic = 0 and quality = 1 as feeds_mastery from labels""")
def trust_decision(labels):
    tier = F.when(F.col("toxic") == 1, "blocked").when(F.col("quality") == 0, "sandbox").when(F.col("quality") == 1, "servable").otherwise("refused")
    return labels.select("doc_id", tier.alias("tier"), ((F.col("toxic") == 0) & (F.col("quality") == 1)).alias("feeds_mastery"))


@query("""select count(*) filter (o_totalprice < 1000) as low_price, count(*) filter (o_orderstatus not in ('O','F')) as odd_status, count(*) filter (c_custkey is null) as orphans, count(*) - count(distinct o_orderkey) as double_keys from orders left join customer on o_custkey = c_custkey""")
def constraint_report(orders, customer):
    j = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    return j.agg(F.count_if(F.col("o_totalprice") < 1000).alias("low_price"), F.count_if(~F.col("o_orderstatus").isin("O", "F")).alias("odd_status"), F.count_if(F.col("c_custkey").isNull()).alias("orphans"), (F.count("*") - F.count_distinct("o_orderkey")).alias("double_keys"))

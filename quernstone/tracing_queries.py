"""Queries of tracing by matrices, registered beside the others."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.operators import tracing
from quernstone.registry import query

ORDER = ["ts", "event_id"]


def _attempts(events):
    return events.withColumn("correct", F.when(F.col("event_type") != "signup", F.col("event_type") == "purchase")).withColumn("level", F.col("event_id") % 6)


def _rounded(rows):
    return rows.select("user_id", F.round("p_learned", 6).alias("p_learned"), "attempts")


_FOLD = """with recursive a as (select user_id, case when event_type <> 'signup' then event_type = 'purchase' end as correct, event_id % 6 as level, row_number() over (partition by user_id order by ts, event_id) as n from events),
f as (select distinct user_id, 0::bigint as n, 0.35::double as p from a union all
select f.user_id, f.n + 1, case when correct is null then p else q + (1 - q) * case level when 1 then 0.4 when 2 then 0.3 when 3 then 0.25 when 4 then 0.2 when 5 then 0.15 else 0.14 end end from (select f.*, level, correct, case when correct then p * 0.9 / (p * 0.9 + (1 - p) * 0.2) else p * 0.1 / (p * 0.1 + (1 - p) * 0.8) end as q from f join a on a.user_id = f.user_id and a.n = f.n + 1) f)
select user_id, round(arg_max(p, n), 6) as p_learned, max(n) as attempts from f group by 1"""


@query(_FOLD)
def tracing_matrices(events):
    """All attempts of a learner as one product, whatever tasks they lay in; the SQL folds them one by one."""
    runs = tracing.matrices(_attempts(events), ["user_id"], ORDER, "level")
    return _rounded(tracing.traced(runs, "user_id", ["seq"]))


@query(_FOLD)
def tracing_merged(events):
    """A summary by learner and day of one device's events, into which another's, which came late, are merged."""
    rows, day = _attempts(events), F.to_date("ts")
    late = rows.filter("user_id % 3 = 0 and event_id % 4 = 1")
    early = rows.filter("not (user_id % 3 = 0 and event_id % 4 = 1)")
    summary = tracing.period_matrices(early, "user_id", day, ORDER, "level")
    after = tracing.merged(summary, rows, late, "user_id", day, ORDER, "level")
    return _rounded(tracing.traced(after, "user_id", ["period", "seq"]))

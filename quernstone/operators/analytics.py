"""Ledger analytics: metrics, cohorts, streaks, leaderboards, percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions import clamp, rank_percentile
from quernstone.lineage import cut


def kpis(events: DataFrame, as_of: str, start_type: str, minutes: str) -> DataFrame:
    """metric, value: users who started today and within 30 days, and mean minutes of 7 days."""
    day = F.to_date("ts")
    today = F.to_date(F.lit(as_of))
    started = events.filter(F.col("event_type") == start_type)
    row = lambda name, df, value: df.agg(value.cast("double").alias("value")).select(F.lit(name).alias("metric"), "value")
    users = F.count_distinct("user_id")
    return (
        row("dau", started.filter(day == today), users)
        .unionByName(row("mau", started.filter((day > F.date_sub(today, 30)) & (day <= today)), users))
        .unionByName(row("avg_minutes", events.filter((day > F.date_sub(today, 7)) & (day <= today)), F.round(F.avg(minutes), 1)))
    )


def running_before(counts: DataFrame, order: str, n: str, within: list[str] | None = None, parts: int = 64) -> DataFrame:
    """counts with before: the sum of n over the rows of lesser order, in each group of within.

    Ranges of order (by quantiles of a bounded sample that Spark keeps) hold about equal shares; sums by range are
    few and carry over, so no task orders more than a range of a group.
    """
    within = within or []
    spread = counts.repartitionByRange(parts, *within, order).withColumn("_range", F.spark_partition_id())
    spread = cut(spread)
    ranges = spread.groupBy(*within, "_range").agg(F.sum(n).alias("_n"))
    carried = F.coalesce(F.sum("_n").over(Window.partitionBy(*(within or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = F.coalesce(F.sum(n).over(Window.partitionBy(*within, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return spread.join(ranges.withColumn("_carried", carried).drop("_n"), [*within, "_range"]).withColumn("before", F.col("_carried") + inner).drop("_range", "_carried")


def leaderboard(scores: DataFrame, key: str, score: str) -> DataFrame:
    """rank (gaps after ties), n and percentile of every row, high scores first.

    Different scores are counted and ranks are sums over ranges of them; a score's rank comes
    back by a join, so no task sorts all rows. Rows without a score are left out, also of n.
    """
    scores = scores.filter(F.col(score).isNotNull())
    counts = cut(scores.groupBy(score).agg(F.count("*").alias("same")).withColumn("_down", -F.col(score)))
    ranked = running_before(counts, "_down", "same").select(score, (F.col("before") + 1).alias("rank"))
    n = counts.agg(F.sum("same")).first()[0] or 0
    return scores.select(key, score).join(ranked, score).withColumn("n", F.lit(n)).withColumn("percentile", rank_percentile(F.col("rank"), F.col("n"))).select(key, score, "rank", "n", "percentile")


def streaks(days: DataFrame, user: str, day: str) -> DataFrame:
    """user, longest, last_day, current (length of the run that ends with last_day)."""
    ordered = Window.partitionBy(user).orderBy(day)
    islands = days.select(user, day).distinct().withColumn("island", F.date_sub(day, F.row_number().over(ordered)))
    runs = islands.groupBy(user, "island").agg(F.count("*").alias("length"), F.max(day).alias("end"))
    return runs.groupBy(user).agg(F.max("length").alias("longest"), F.max("end").alias("last_day"), F.max_by("length", "end").alias("current"))


def leading_run(rows: DataFrame, key: str, order: list, hit, last: int = 30) -> DataFrame:
    """key, streak: how many of the latest rows hold hit before the first that doesn't."""
    recent = Window.partitionBy(key).orderBy(*order)
    ranked = rows.withColumn("_n", F.row_number().over(recent)).filter(F.col("_n") <= last).withColumn("_miss", F.sum((~hit).cast("int")).over(recent))
    return ranked.groupBy(key).agg(F.count_if(F.col("_miss") == 0).alias("streak"))


def radar(attempts: DataFrame, user: str, days: DataFrame, streaks: DataFrame) -> DataFrame:
    """user, volume and six figures from 0 to 1: speed and reflex from the median and the quartile (by index)
    of times, logic from graded attempts, focus the share of times within 1.5 medians, stamina from
    the mean of days(n), memory from the longest streak. One grouping, arrays within a learner: for people."""
    times = F.array_sort(F.collect_list(F.when(F.col("time_ms") > 0, F.col("time_ms"))))
    g = attempts.groupBy(user).agg(F.avg(F.col("correct").cast("double")).alias("accuracy"), F.count("*").alias("volume"), F.percentile(F.when(F.col("time_ms") > 0, F.col("time_ms")), 0.5).alias("median"), times.alias("times"))
    g = g.join(days.groupBy(user).agg(F.avg("n").alias("per_day")), user, "left").join(streaks.select(user, "longest"), user, "left")
    n = F.size("times")
    quartile = F.when(n > 0, F.element_at("times", (F.floor(n / 4) + 1).cast("int")))
    share = F.size(F.filter("times", lambda t: t <= 1.5 * F.col("median"))) / F.when(n > 0, n)
    figure = lambda c: F.round(clamp(F.coalesce(c, F.lit(0.0)), 0.0, 1.0), 6)
    return g.select(
        user, "volume", figure(1 - F.col("median") / 60_000).alias("speed"), figure(F.col("accuracy")).alias("logic"), figure(F.col("per_day") / 25).alias("stamina"),
        figure(share).alias("focus"), figure(F.col("longest") / 7).alias("memory"), figure(1 - quartile / 20_000).alias("reflex"),
    )


def cohort_retention(users: DataFrame, activity: DataFrame, user: str, joined: str, day: str) -> DataFrame:
    """cohort week, users, share active in the first and second week after joining."""
    age = F.datediff(day, joined)
    per = users.join(activity, user, "left").groupBy(user, joined).agg(F.max(F.when(age.between(7, 13), 1).otherwise(0)).alias("w1"), F.max(F.when(age.between(14, 20), 1).otherwise(0)).alias("w2"))
    return per.groupBy(F.to_date(F.date_trunc("week", joined)).alias("cohort")).agg(F.count("*").alias("users"), F.round(100.0 * F.sum("w1") / F.count("*"), 1).alias("w1"), F.round(100.0 * F.sum("w2") / F.count("*"), 1).alias("w2"))


def midrank_percentile(scores: DataFrame, group: str, score: str) -> DataFrame:
    """scores with percentile: the share of the group's other rows below, ties by half. Scores are counted by
    group first and summed over ranges, so a great group is not one task. Rows without a group or score are left out."""
    scores = scores.filter(F.col(group).isNotNull() & F.col(score).isNotNull())
    counts = scores.groupBy(group, score).agg(F.count("*").alias("same"))
    ranked = running_before(counts, score, "same", [group])
    sizes = counts.groupBy(group).agg(F.sum("same").alias("_all"))
    others = F.col("_all") - 1
    share = F.when(others > 0, F.bround(100.0 * (F.col("before") + 0.5 * (F.col("same") - 1)) / others, 0).cast("int")).otherwise(F.lit(50))
    return scores.join(ranked, [group, score]).join(sizes, group).withColumn("percentile", share).drop("same", "before", "_all")


def decay_attribution(touches: DataFrame, conversions: DataFrame, user: str, before_only: bool = False) -> DataFrame:
    """Of each conversion the touch of most weight exp(-rate * seconds between), whatever the rate.

    The weight rises with the touch's time, also past the conversion, so a user's last touch has it for
    all the user's conversions: one maximum a user, and an equi join. With before_only it is the
    last touch up to the conversion, by one ordered window over both.
    """
    latest = F.struct(F.unix_timestamp("touched_at").alias("at"), F.col("touch_id").alias("id"))
    if not before_only:
        last = touches.groupBy(user).agg(F.max(latest)["id"].alias("touch_id"))
        return conversions.join(last, user).select(user, "conversion_id", "touch_id")
    both = touches.select(user, F.unix_timestamp("touched_at").alias("at"), latest.alias("_touch"), F.lit(None).cast(dict(conversions.dtypes)["conversion_id"]).alias("conversion_id"))
    both = both.unionByName(conversions.select(user, F.unix_timestamp("converted_at").alias("at"), F.lit(None).cast(dict(both.dtypes)["_touch"]).alias("_touch"), "conversion_id"))
    seen = F.max("_touch").over(Window.partitionBy(user).orderBy("at").rangeBetween(Window.unboundedPreceding, 0))
    return both.withColumn("_last", seen).filter("conversion_id is not null and _last is not null").select(user, "conversion_id", F.col("_last.id").alias("touch_id"))


def weak_areas(answers: DataFrame, skill: str, threshold: float = 0.7) -> DataFrame:
    """Skills under the threshold; an answer that was not given counts as wrong."""
    right = F.coalesce(F.col("correct"), F.lit(False)).cast("double")
    return answers.groupBy(skill).agg(F.avg(right).alias("accuracy"), F.count("*").alias("n")).filter(F.col("accuracy") < threshold)

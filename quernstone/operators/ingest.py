"""Event ingest: sampling, minimisation, points, streaks, the outbox."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions import bucket64

#: The event types of each sampling class.
_TYPES = {
    "psychometric": """
        problem_attempt problem_solved problem_failed trap_triggered bkt_state_snapshot session_start session_end
        calibration_completed phase_transition skill_level_up fatigue_index_computed clr_mode_activated
        behavioral_profile_computed mock_exam_started mock_problem_attempt mock_exam_submitted deferred_workout_started
        deferred_workout_completed lr_set_completed di_set_completed passage_completed
    """,
    "conversion": """
        subscription_purchased subscription_cancelled trial_started referral_code_used referral_reward_claimed
        onboarding_begin goal_set auth_complete topic_browser_session_start topic_browser_session_end
    """,
    "ui": """
        chat_hint_requested page_view hint_used hint_requested topic_selected widget_expanded dashboard_loaded
        problem_loaded profile_viewed help_viewed
    """,
    "ops": """
        buffer_overflow sync_failed offline_sync_complete
    """,
}
EVENT_CLASSES = {kind: name for name, kinds in _TYPES.items() for kind in kinds.split()}
#: Keys that are never kept of a child's event.
KIDS_STRIPPED = ["device_fingerprint", "device_id", "ip", "ip_address", "user_agent", "geo"]


def decisions(events: DataFrame, dau: int, classes: dict[str, str] = EVENT_CLASSES, user: str = "user_id", event: str = "event_id", kind: str = "event_type", threshold: int = 10_000, keep_one_in: int = 10) -> DataFrame:
    """events with class (null: unknown type), known and sampled_out: only user-interface
    events, and only above threshold users a day, by a stable hash. Unknown types are all kept."""
    of = F.create_map(*[F.lit(x) for pair in classes.items() for x in pair])[F.col(kind)]
    out = events.withColumn("class", of).withColumn("known", F.col("class").isNotNull())
    if dau <= threshold:
        return out.withColumn("sampled_out", F.lit(False))
    bucket = bucket64(F.concat_ws(":", F.col(user).cast("string"), F.col(event).cast("string")), keep_one_in)
    return out.withColumn("sampled_out", (F.coalesce("class", F.lit("")) == "ui") & (bucket != 0))


def minimised(decided: DataFrame, kid: Column, metadata: str, stripped: list[str] = KIDS_STRIPPED) -> DataFrame:
    """decided with minimised (a child's user-interface event, which is not stored), and
    without the stripped keys in a child's metadata (a map)."""
    kept = F.map_filter(metadata, lambda k, _: ~k.isin(*stripped))
    return decided.withColumn("minimised", kid & (F.coalesce("class", F.lit("")) == "ui")).withColumn(metadata, F.when(kid, kept).otherwise(F.col(metadata)))


def awards(rows: DataFrame, user: str, reason: str, ref: str, delta: str) -> DataFrame:
    """user, xp: a (user, reason, ref) pays once, whatever comes again; zeros pay nothing."""
    once = rows.filter(F.col(delta) != 0).groupBy(user, reason, ref).agg(F.min(delta).alias(delta))
    return once.groupBy(user).agg(F.sum(delta).alias("xp"))


def floored_total(rows: DataFrame, key: str, order: list[str], value: str, floor: float = 0.0) -> DataFrame:
    """key, value: the sum in order that never falls under floor after any step: the whole sum
    less the lowest that it was under floor on the way. Two windows, no fold."""
    run = F.sum(value).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_run", run).groupBy(key).agg((F.sum(value) - F.least(F.lit(0.0), F.min(F.col("_run") - floor))).alias(value))


def arrival_streaks(rows: DataFrame, user: str, day: str, order: list[str], today: Column) -> DataFrame:
    """user, current, longest, last_day, as days arrive in order: a day after the last lengthens the
    streak, a later one starts anew, one already passed changes nothing, and no day counts as
    later than today. So only days beyond all before them matter, and their islands are the streaks."""
    days = rows.withColumn("_day", F.least(F.col(day), today))
    before = F.max("_day").over(Window.partitionBy(user).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    record = days.withColumn("_last", before).filter(F.col("_last").isNull() | (F.col("_day") > F.col("_last")))
    starts = F.coalesce(F.datediff("_day", "_last") != 1, F.lit(True)).cast("int")
    islands = record.withColumn("_island", F.sum(starts).over(Window.partitionBy(user).orderBy("_day"))).groupBy(user, "_island").agg(F.count("*").alias("n"), F.max("_day").alias("end"))
    return islands.groupBy(user).agg(F.max_by("n", "end").alias("current"), F.max("n").alias("longest"), F.max("end").alias("last_day"))


def live_streak(current: Column, last_day: Column, today: Column) -> Column:
    """0 if yesterday was missed, or the last day lies in the future."""
    return F.when(last_day.between(F.date_sub(today, 1), today), current).otherwise(0)


def ingest_report(events: DataFrame, event: str = "event_id", kind: str = "event_type") -> DataFrame:
    """One row for rows with class, known, sampled_out, minimised: what was accepted (each
    event once), duplicates (all else that was not sampled out), and the unknown types."""
    taken = ~F.col("sampled_out") & ~F.col("minimised")
    return events.agg(
        F.count_distinct(F.when(taken, F.col(event))).alias("accepted"),
        (F.count("*") - F.count_distinct(F.when(taken, F.col(event))) - F.count_if("sampled_out")).alias("duplicates"),
        F.count_if("sampled_out").alias("sampled_out"),
        F.count_if(F.col("minimised") & ~F.col("sampled_out")).alias("minimised"),
        F.count_if(F.col("class") == "psychometric").alias("psychometric"),
        F.array_join(F.array_sort(F.collect_set(F.when(~F.col("known"), F.col(kind)))), ",").alias("unknown_types"),
    )


def drain(outbox: DataFrame, key: str, order: list[str], attempts: str, ok: Column, skip: Column, batch: int = 200, most_attempts: int = 5) -> DataFrame:
    """key, status, attempts after one pass over the oldest batch rows that have attempts left:
    done, skipped (with the reason that skip gives), failed for the last time, or pending."""
    ready = outbox.filter(F.col(attempts) < most_attempts).orderBy(*order).limit(batch)
    tried = F.col(attempts) + 1
    status = F.when(skip.isNotNull(), "skipped").when(ok, "done").when(tried >= most_attempts, "failed").otherwise("pending")
    return ready.select(key, status.alias("status"), skip.alias("skip_reason"), tried.alias("attempts"))


def expired(created: Column, now: Column, hours: int) -> Column:
    return created < now - F.make_dt_interval(hours=F.lit(hours))


def dropped_as_poison(retries: Column, kind: Column, classes: dict[str, str] = EVENT_CLASSES, most: int = 20) -> Column:
    """Whether a client gives an event up: after most retries, never a psychometric one."""
    kept = [k for k, c in classes.items() if c == "psychometric"]
    return (retries >= most) & ~kind.isin(*kept)

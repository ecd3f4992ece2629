"""Stream forms of ledger operators: exact ingest, fan-out, windows, learner state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import BKT, LEARN_BY_DIFFICULTY


def ingest(stream: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Each event_id once within the watermark of its time."""
    return stream.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["event_id"])


def _stored(spark: SparkSession, path: str, months: list[str], keys: list[str]) -> DataFrame | None:
    """keys of what a table holds of some months; None before its first batch."""
    try:
        return spark.read.parquet(path).filter(F.col("event_month").isin(months)).select(*keys)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def _lacking(rows: DataFrame, path: str, months: list[str], keys: list[str]) -> DataFrame:
    known = _stored(rows.sparkSession, path, months, keys)
    return rows if known is None else rows.join(known, keys, "left_anti").select(*rows.columns)


def _earliest(batch: DataFrame) -> DataFrame:
    """Each event_id of a batch once, as its earliest row (by ts, then by all columns), with event_month."""
    rows = batch.withColumn("event_month", F.date_format("ts", "yyyy-MM"))
    return rows.groupBy("event_id").agg(F.min_by(F.struct(*rows.columns), F.struct("ts", F.to_json(F.struct(*rows.columns)))).alias("x")).select("x.*")


def append_new(batch: DataFrame, path: str, parts: dict[str, tuple[Callable[[DataFrame], DataFrame], list[str]]] | None = None) -> None:
    """Appends to the ledger the events of a batch that it lacks, each once, the earliest, and to further tables what is
    derived from just these rows (name -> (rows of new events, keys)).

    Derived rows keep event_month: all tables are partitioned by it, and of each only the months that the batch touches are
    read. A resent event has its first time, so its month is among them. The batch's own rows are held once, until it is
    written. Derived tables come first and the ledger last, so a batch that runs again after a failure
    finds its events missing in the ledger and adds to each table what its keys lack."""
    once = _earliest(batch).persist()
    try:
        months = [r.event_month for r in once.select("event_month").distinct().collect()]
        new = _lacking(once, path, months, ["event_id"])
        for name, (derive, keys) in (parts or {}).items():
            derived = derive(new)
            if "event_month" not in derived.columns:
                raise ValueError(f"{name}: derived rows must keep event_month")
            _lacking(derived.dropDuplicates(keys), f"{path}_{name}", months, keys).write.mode("append").partitionBy("event_month").parquet(f"{path}_{name}")
        new.write.mode("append").partitionBy("event_month").parquet(path)
    finally:
        once.unpersist()


def ingest_exact(stream: DataFrame, path: str, checkpoint: str):
    """Each event_id once over all time: every micro-batch appends what the ledger lacks."""
    return fan_out(stream, path, {}, checkpoint)


def fan_out(stream: DataFrame, path: str, parts: dict[str, tuple[Callable[[DataFrame], DataFrame], list[str]]], checkpoint: str):
    """The ledger and the tables derived from what is new in it, batch by batch (`append_new`)."""
    return stream.writeStream.foreachBatch(lambda batch, _: append_new(batch, path, parts)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sync_paths(end: str, outbox: list[str], session: Column, states: Column, elapsed: Column) -> dict[str, tuple[Callable[[DataFrame], DataFrame], list[str]]]:
    """What accepted events lead to beside the ledger: sessions that end (session, user_id, elapsed; none without a session),
    the outbox (event_id, event_type, user_id; one row an event of the mapped types), snapshots of a session's
    states (none without states), and activity (user, day, problems: one row for each event, summed by reading)."""
    ends = F.col("event_type") == end
    return {
        "closed": (lambda new: new.filter(ends & session.isNotNull()).select(session.alias("session"), "user_id", elapsed.alias("elapsed"), "event_month"), ["session"]),
        "outbox": (lambda new: new.filter(F.col("event_type").isin(outbox)).select("event_id", "event_type", "user_id", "event_month"), ["event_id"]),
        "snapshots": (lambda new: new.filter(ends & states.isNotNull()).select("event_id", "user_id", session.alias("session"), states.alias("states"), "event_month"), ["event_id"]),
        "activity": (lambda new: new.select("event_id", "user_id", F.to_date("ts").alias("day"), F.col("event_type").isin(outbox).cast("int").alias("problems"), "event_month"), ["event_id"]),
    }


def windowed(stream: DataFrame, length: str = "1 hour", slide: str | None = None, watermark: str | None = "1 hour") -> DataFrame:
    """Counts and sums by event type over tumbling or sliding windows; watermark None where the stream has one."""
    late = stream if watermark is None else stream.withWatermark("ts", watermark)
    return late.groupBy(F.window("ts", length, slide or length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def learner_states(stream: DataFrame, key: str, order: str) -> DataFrame:
    """key, p_learned, attempts after every batch: knowledge tracing over a stream of (key, order, correct, difficulty).

    A learner's state is two numbers; a batch's attempts are taken in order, later batches after
    earlier ones. What arrives late is counted when it comes; the whole ledger, folded in order by the
    batch form, settles a conflict between devices.
    """
    kind = dict(stream.dtypes)[key]

    def fold(group: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        p, n = state.get if state.exists else (BKT["prior"], 0)
        rows = pd.concat(list(frames)).sort_values(order)
        for correct, level in zip(rows["correct"], rows["difficulty"], strict=True):
            n += 1
            if pd.isna(correct):
                continue
            hit, miss = (1 - BKT["slip"], BKT["guess"]) if correct else (BKT["slip"], 1 - BKT["guess"])
            after = p * hit / (p * hit + (1 - p) * miss)
            p = after + (1 - after) * LEARN_BY_DIFFICULTY.get(level, BKT["learn"])
        state.update((float(p), int(n)))
        yield pd.DataFrame({key: [group[0]], "p_learned": [p], "attempts": [n]})

    schema = f"{key} {kind}, p_learned double, attempts long"
    return stream.select(key, order, "correct", "difficulty").groupBy(key).applyInPandasWithState(fold, schema, "p double, n long", "update", "NoTimeout")

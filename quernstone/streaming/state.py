"""Streams with state of their own: an outbox with retries and dead letters, markers that expire, streaks in order of arrival.

All need the RocksDB state store (`use_rocksdb`). State is keyed, checkpointed with the stream and
survives restarts; time to live and timers keep it from growing with the days.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

#: Attempts before an entry is given up; hours that markers live.
MOST_ATTEMPTS = 5
LIFETIMES = {"ghost": 30 * 24, "tray": 24, "intent": 24, "cache": 6}


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


# Outbox -------------------------------------------------------------------------------


class _Outbox(StatefulProcessor):
    """Per shard: a map of waiting entries (attempts, JSON of the row) and markers of finished ones."""

    def __init__(self, deliver: Callable[[pd.DataFrame], list[str | None]], columns: list[str], retry_ms: int, seen_ms: int, batch: int):
        self.deliver, self.columns, self.retry_ms, self.seen_ms, self.batch = deliver, columns, retry_ms, seen_ms, batch

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "id string", "attempts int, row string")
        self.done = handle.getMapState("done", "id string", "at long", self.seen_ms)

    def _attempt(self, entries: list[tuple[str, int, dict]], now: int) -> Iterator[pd.DataFrame]:
        out = []
        for at in range(0, len(entries), self.batch):
            part = entries[at : at + self.batch]
            for (name, attempts, row), said in zip(part, self._deliver(pd.DataFrame([r for _, _, r in part], columns=self.columns)), strict=True):
                attempts += 1
                failed = said is not None and said.startswith("error:")
                status = "done" if said is None else "skipped" if not failed else "failed" if attempts >= MOST_ATTEMPTS else "pending"
                if status == "pending":
                    self.waiting.updateValue((name,), (attempts, pd.Series(row).to_json(date_format="iso")))
                else:
                    self.done.updateValue((name,), (now,))
                    if attempts > 1:
                        self.waiting.removeKey((name,))
                out.append((name, status, attempts, said))
        if out:
            yield pd.DataFrame(out, columns=["id", "status", "attempts", "reason"])

    def _deliver(self, rows: pd.DataFrame) -> list[str | None]:
        """What becomes of each row; where a whole batch fails, its rows are tried one by one, so that one can't hold up the others."""
        try:
            return self.deliver(rows)
        except Exception as e:  # noqa: BLE001 - whatever delivery raises counts as a failed attempt of the row
            if len(rows) == 1:
                return [f"error: {type(e).__name__}: {e}"[:500]]
            return [said for i in range(len(rows)) for said in self._deliver(rows.iloc[[i]])]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now, fresh, names = timerValues.getCurrentProcessingTimeInMs(), [], set()
        for frame in rows:
            for row in frame[["entry", *self.columns]].itertuples(index=False):
                name = str(row[0])
                if name not in names and not self.done.containsKey((name,)) and not self.waiting.containsKey((name,)):
                    names.add(name)
                    fresh.append((name, 0, dict(zip(self.columns, row[1:], strict=True))))
        yield from self._attempt(fresh, now)
        self._wake(now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        waiting = [(k[0], v[0], pd.read_json(_buffer(v[1]), typ="series", convert_dates=False).to_dict()) for k, v in list(self.waiting.iterator())]
        yield from self._attempt(sorted(waiting, key=lambda x: x[0]), now)
        self._wake(now)

    def _wake(self, now: int) -> None:
        if self.waiting.exists() and any(True for _ in self.waiting.keys()) and not any(t > now for t in self.handle.listTimers()):  # noqa: SIM118
            self.handle.registerTimer(now + self.retry_ms)

    def close(self) -> None:
        pass


def _buffer(text: str):
    import io

    return io.StringIO(text)


def drain_outbox(stream: DataFrame, key: str, columns: list[str], deliver: Callable[[pd.DataFrame], list[str | None]], retry_seconds: float = 30, seen_hours: float = 24, batch: int = 200, shards: int = 64) -> DataFrame:
    """id, status, attempts, reason: one row for each attempt at an entry (done, skipped with its reason, pending,
    failed, that is a dead letter after MOST_ATTEMPTS).

    deliver takes a frame of columns and says of each row None (done), a reason (skipped) or `error: ...`; what it
    raises fails the row that raises it. An entry that failed waits in state and is tried again by a timer, also after a
    restart; a finished one leaves a marker that expires, so a resent entry is not delivered twice in seen_hours. Entries
    without a key are left out. Columns must be numbers, texts or booleans. Timers need a stream that keeps running
    (a trigger by time): one that takes what is there and ends would never end. State holds what waits and the markers of
    seen_hours, however long the stream runs.
    """
    use_rocksdb(stream.sparkSession)
    rows = stream.filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("entry"), *columns, F.pmod(F.xxhash64(F.col(key)), F.lit(shards)).alias("shard"))
    return rows.groupBy("shard").transformWithStateInPandas(
        statefulProcessor=_Outbox(deliver, columns, int(retry_seconds * 1000), int(seen_hours * 3_600_000), batch),
        outputStructType="id string, status string, attempts int, reason string",
        outputMode="update",
        timeMode="ProcessingTime",
    )


def dead_letters(attempts: DataFrame) -> DataFrame:
    """The entries that were given up: id, attempts, reason."""
    return attempts.filter("status = 'failed'").select("id", "attempts", "reason")


# Markers ------------------------------------------------------------------------------


class _Markers(StatefulProcessor):
    def __init__(self, column: str, ttl_ms: int):
        self.column, self.ttl_ms = column, ttl_ms

    def init(self, handle) -> None:
        self.seen = handle.getMapState("seen", "id string", "at long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        for frame in rows:
            keep = []
            for name in frame[self.column].map(str):
                keep.append(not self.seen.containsKey((name,)))
                if keep[-1]:
                    self.seen.updateValue((name,), (now,))
            yield frame[keep].drop(columns="shard")

    def close(self) -> None:
        pass


def unseen(stream: DataFrame, key: str, hours: float = LIFETIMES["tray"], shards: int = 64) -> DataFrame:
    """The rows of a stream whose key was not seen for `hours`: the first sets a marker that expires, and is not prolonged
    by what it turns away. Rows without a key are left out."""
    use_rocksdb(stream.sparkSession)
    rows = stream.filter(F.col(key).isNotNull()).withColumn("shard", F.pmod(F.xxhash64(F.col(key)), F.lit(shards)))
    return rows.groupBy("shard").transformWithStateInPandas(statefulProcessor=_Markers(key, int(hours * 3_600_000)), outputStructType=stream.schema, outputMode="append", timeMode="ProcessingTime")


# Streaks ------------------------------------------------------------------------------


class _Streaks(StatefulProcessor):
    """A learner's streak is three values; days are taken in order of arrival."""

    def __init__(self, user: str, today: datetime.date | None):
        self.user, self.today = user, today

    def init(self, handle) -> None:
        self.streak = handle.getValueState("streak", "current long, longest long, last date")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        current, longest, last = self.streak.get() if self.streak.exists() else (0, 0, None)
        today = self.today or datetime.datetime.now(datetime.UTC).date()
        arrived = pd.concat(list(rows)).set_axis(["user", "day", "at"], axis=1)  # by place: a plain renaming does not reach the task
        for day in arrived.sort_values("at")["day"]:
            day = min(day, today)
            if last is None or day > last:
                current = current + 1 if last is not None and (day - last).days == 1 else 1
                longest, last = max(longest, current), day
        if last is not None:
            self.streak.update((current, longest, last))
            yield pd.DataFrame({self.user: [key[0]], "current": [current], "longest": [longest], "last_day": [last]})

    def close(self) -> None:
        pass


def streaks(stream: DataFrame, user: str, day: str, arrival: str, today: datetime.date | None = None) -> DataFrame:
    """user, current, longest, last_day after each batch that has days of the user.

    Days count in the order of arrival (a column that rises, such as an offset), whatever batches they come in: the day
    after the last lengthens the streak, a later one starts anew, one already passed changes nothing, and no day is later
    than today (the cluster's, in UTC, unless one is given). Null users and days are left out. Resent days change nothing.
    """
    use_rocksdb(stream.sparkSession)
    kind = dict(stream.dtypes)[user]
    rows = stream.filter(F.col(user).isNotNull() & F.col(day).isNotNull()).select(user, F.col(day).cast("date").alias("day"), F.col(arrival).alias("at"))
    return rows.groupBy(user).transformWithStateInPandas(
        statefulProcessor=_Streaks(user, today), outputStructType=StructType.fromDDL(f"`{user}` {kind}, current long, longest long, last_day date"), outputMode="update", timeMode="None"
    )

"""Streams with state: restarts, random splits into batches, expiry."""

import datetime
import random
import time

import pytest
from pyspark.sql import functions as F

pytest.importorskip("quernstone.streaming.state")
from quernstone.operators import ingest  # noqa: E402
from quernstone.streaming import state  # noqa: E402


def run(build, folder, sink, seconds=0.0):
    """One start of a stream over a folder: what is new in it, some seconds more, then an end."""
    query = build().writeStream.outputMode("update" if sink != "kept" else "append").foreachBatch(lambda df, i: df.write.mode("append").parquet(f"{folder}/{sink}")).option("checkpointLocation", f"{folder}/{sink}_at").start()
    for _ in range(400):  # a stream with timers has always another batch to run, so wait for rows and then for one batch more
        done = [p["batchId"] for p in query.recentProgress if p["numInputRows"] > 0]
        if done and (query.recentProgress[-1]["batchId"] > done[-1] or not query.status["isTriggerActive"]):
            break
        assert query.exception() is None
        time.sleep(0.1)
    time.sleep(seconds)
    query.stop()


def test_streaks_in_order_of_arrival(spark, tmp_path):
    rng, today = random.Random(2), datetime.date(2024, 2, 1)
    rows = [(rng.randrange(4), datetime.date(2024, 1, 1) + datetime.timedelta(rng.randrange(45)), i) for i in range(120)]
    rows = [(u, d, i) for i, (u, d, _) in enumerate(sorted(rows, key=lambda r: r[1].toordinal() + rng.randrange(-4, 5)))]
    schema = "u int, day date, at int"
    want = {r.u: (r.current, r.longest, r.last_day) for r in ingest.arrival_streaks(spark.createDataFrame(rows, schema), "u", "day", ["at"], F.lit(today)).collect()}
    build = lambda: state.streaks(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "u", "day", "at", today)
    cuts = sorted(rng.sample(range(1, 120), 2))
    for a, b in zip([0, *cuts], [*cuts, 120], strict=True):  # each part is a new start
        spark.createDataFrame(rows[a:b] + [(None, today, 0), (1, None, 0)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run(build, tmp_path, "out")
    out = {}
    for r in sorted(spark.read.parquet(f"{tmp_path}/out").collect(), key=lambda r: (r.last_day, r.longest)):
        out[r.u] = (r.current, r.longest, r.last_day)
    assert out == want and max(w[1] for w in want.values()) > 1


def deliver(flag):
    """Says what becomes of a row by its kind; `flaky` fails until a file is there."""

    def said(rows):
        import os

        if (rows["kind"] == "bad").any():
            raise ValueError("no graph")
        return [None if k == "good" else "no target" if k == "skip" else None if os.path.exists(flag) else "error: later" for k in rows["kind"]]

    return said


def test_outbox_over_restarts(spark, tmp_path):
    schema = "event string, kind string, n int"
    build = lambda: state.drain_outbox(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "event", ["kind", "n"], deliver(f"{tmp_path}/flag"), retry_seconds=1, shards=2)
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    put([("a", "good", 1), ("b", "skip", None), ("c", "bad", 3), ("d", "flaky", 4), ("d", "flaky", 4), (None, "good", 0)])
    run(build, tmp_path, "out")
    for i in range(2):
        put([("a", "good", 1), (f"e{i}", "good", i)])  # a resent entry, and a new one
        if i == 0:
            (tmp_path / "flag").write_text("")
        run(build, tmp_path, "out", 5)
    rows = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    of = lambda name: sorted((r[2], r[1]) for r in rows if r[0] == name)
    assert of("a") == [(1, "done")] and of("b") == [(1, "skipped")] and of("e1") == [(1, "done")]
    assert of("c") == [(i, "pending") for i in range(1, 5)] + [(5, "failed")]  # and no sixth
    assert of("d")[-1][1] == "done" and of("d")[0] == (1, "pending") and len(of("d")) == len({x[0] for x in of("d")}) <= 5
    dead = state.dead_letters(spark.read.parquet(f"{tmp_path}/out")).collect()
    assert [tuple(r) for r in dead] == [("c", 5, "error: ValueError: no graph")]


def test_markers_expire(spark, tmp_path):
    schema = "id string, n int"
    build = lambda: state.unseen(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "id", hours=3 / 3600, shards=2)
    for n, wait in enumerate((0, 0, 3.5)):
        time.sleep(wait)
        spark.createDataFrame([("a", n), ("a", n), (None, n), (f"b{n}", n)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run(build, tmp_path, "kept")
    kept = sorted((r.id, r.n) for r in spark.read.parquet(f"{tmp_path}/kept").collect())
    assert kept[0] == ("a", 0) and kept[-3:] == [("b0", 0), ("b1", 1), ("b2", 2)] and ("a", 2) in kept and len([k for k in kept if k[0] == "a"]) in (2, 3)

"""Operators on nulls, repeated rows and empty tables: each has a defined result, and none stops the job."""

import pytest
from pyspark.sql import functions as F

pytest.importorskip("quernstone.operators")
from quernstone import sources  # noqa: E402
from quernstone.functions import answers  # noqa: E402
from quernstone.operators import analytics, bank, chunking, content, exams, graph, ingest, learner, policy, relations  # noqa: E402, F401

SCHEMA = "u int, day date, at int, correct boolean, score double, event_id int, event_type string, ts timestamp, value double, name string, src int, dst int, support int, step int, text string, options array<string>, answer_key string"
ROWS = [(1, "2024-01-01", 1, True, 2.0, 1, "a", "2024-01-01 00:00:00", 1.0, "n", 1, 2, 1, 1, "t", ["x", "y"], "a"), (1, "2024-01-02", 2, False, 1.0, 2, "b", "2024-01-02 00:00:00", 2.0, "N", 2, 1, 2, 2, "", [], ""), (None,) * 17]


@pytest.fixture(scope="module")
def odd(spark):
    one = spark.createDataFrame([(r[0], r[2], r[3], r[4], r[5], r[6], r[8], r[9], *r[10:], r[1], r[7]) for r in ROWS], "u int, at int, correct boolean, score double, event_id int, event_type string, value double, name string, src int, dst int, support int, step int, text string, options array<string>, answer_key string, d string, t string")
    return one.union(one.limit(1)).withColumns({"day": F.to_date("d"), "ts": F.to_timestamp("t"), "rank": F.lit("clash"), "n": F.lit("clash")})


OPERATORS = {
    "kpis": lambda d: analytics.kpis(d.withColumnRenamed("u", "user_id"), "2024-01-02", "a", "value"),
    "leaderboard": lambda d: analytics.leaderboard(d.drop("rank", "n"), "u", "score"),
    "midrank": lambda d: analytics.midrank_percentile(d.drop("rank", "n"), "name", "score"),
    "streaks": lambda d: analytics.streaks(d, "u", "day"),
    "leading_run": lambda d: analytics.leading_run(d, "u", [F.col("at").desc()], F.col("correct")),
    "weak_areas": lambda d: analytics.weak_areas(d, "name"),
    "arrival_streaks": lambda d: ingest.arrival_streaks(d, "u", "day", ["at"], F.lit("2024-02-01").cast("date")),
    "floored_total": lambda d: ingest.floored_total(d, "u", ["at"], "value"),
    "awards": lambda d: ingest.awards(d, "u", "event_type", "event_id", "value"),
    "drain": lambda d: ingest.drain(d, "event_id", ["ts"], "at", F.col("correct"), F.lit(None).cast("string")),
    "bkt_fold": lambda d: learner.bkt_fold(d, "u", ["at"]),
    "closure": lambda d: graph.closure(d),
    "break_cycles": lambda d: graph.break_cycles(d.select("src", "dst", "support").distinct(), F.lit(True))[0],
    "merge_plan": lambda d: graph.merge_plan(d, d.select("name", F.col("at").alias("n")), F.lit(False), d.select(F.lit("x").alias("loser"), F.lit("y").alias("survivor"))),
    "resolve_chains": lambda d: content.resolve_chains(d, "src", "dst"),
    "fingerprint": lambda d: content.fingerprint(d, "name", F.col("text")),
    "hints": lambda d: bank.usable_hints(d, "u", "at", "step", "text", "answer_key"),
    "pool_verdicts": lambda d: bank.pool_verdicts(d.select(F.col("event_id").alias("question_id"), F.col("name").alias("book"), "answer_key", "options", "text"), d.select(F.col("name").alias("book"), F.lit("p").alias("pool"), F.lit(True).alias("wants_options")).distinct(), F.col("text"), "off"),
    "chunks": lambda d: chunking.chunk_books(d, "name", "at", "text"),
    "redacted": lambda d: chunking.redacted(d.select("text", "options"), "text", "options"),
    "upsert_last": lambda d: sources.upsert_last(d.select("u", "at"), d.select("u", "at"), ["u"], "at"),
    "insert_new": lambda d: sources.insert_new(d.select("u", "at"), d.select("u", "at"), ["u"], "at"),
    "exact": lambda d: d.select(answers.exact_value("text").alias("x"), answers.numeric_answer("answer_key").alias("y"), answers.grade(F.lit("mcq"), F.col("text"), F.col("answer_key"), F.col("options")).alias("z")),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_and_empty(odd, name):
    OPERATORS[name](odd).collect()
    out = OPERATORS[name](odd.limit(0))
    assert out.count() == (3 if name == "kpis" else 0) and out.columns


def test_nulls_are_defined(spark, odd):
    out = analytics.leaderboard(odd.drop("rank", "n"), "u", "score").collect()
    assert len(out) == 3 and {r.n for r in out} == {3}
    panel = F.lit(None).cast("array<struct<lens:string,verdict:string>>")
    faults = spark.range(1).select(bank.verdict_faults(panel, F.lit("item"), F.lit("t"), F.lit("b"), F.lit("2_of_3"), F.lit("fail"), F.lit(None).cast("array<int>")).alias("f")).first().f
    assert faults == ["panel_size"]
    pools = {(r.question_id, r.why) for r in OPERATORS["pool_verdicts"](odd).collect()}
    assert (None, "no_pool") in pools and (1, None) in pools and (2, "no_key_or_options") in pools
    null = F.lit(None).cast("array<string>")
    assert spark.range(1).select(answers.option_of_key(F.lit("a"), null)["how"]).first()[0] == "no_key_or_options"
    trust = spark.range(1).select(policy.trust_from_reasons(null, ["x"]), policy.trust_from_reasons(F.array().cast("array<string>"), ["x"]), policy.trust_from_reasons(F.array(F.lit("x")), ["x"])).first()
    assert tuple(trust) == ("QUARANTINED_SOFT", "TRUSTED", "QUARANTINED_HARD")
    names = spark.createDataFrame([("Bare", 1), ("bare", 9), ("root:Bare", 1), (None, 1)], "name string, n int")
    fixed = spark.createDataFrame([], "loser string, survivor string")
    plan = {(r.loser, r.survivor) for r in graph.merge_plan(names, names, F.lit(False), fixed).collect()}
    assert plan == {("Bare", "bare"), ("root:Bare", "bare")}  # one hop is enough

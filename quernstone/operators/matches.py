"""Matches that end: ratings, results, points and achievements as one fold over a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.functions import seed_rating, xp_of
from quernstone.lineage import cut
from quernstone.operators.learner import glicko_solved, glicko_terms
from quernstone.operators.policy import achievements

#: Deviation and volatility of a player who is new.
NEW_RD, NEW_VOLATILITY = 350.0, 0.06


def completed(results: DataFrame, ratings: DataFrame, paid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(match, user, place, won, elo_before, elo_after, elo_change, xp, achievements of every human result; user, rating, rd, volatility
    of all who played).

    results: match, user (null: a bot), place, accuracy, mode, duration_ms, comeback, theta. ratings: user, rating, rd, volatility, played,
    streak. A player without a rating starts from theta. Every two humans of a match play each other, by place; a match with one
    human changes no rating. All matches of the batch count with the ratings from before it, and changes are told as whole numbers.
    Points are halved where a bot took part, and paid once a (match, user): paid holds those of batches before, so a batch that
    runs again pays nothing. Of a match's several rows of a user the best place counts.

    Players of a match with one place, rating and deviation are one to all others, so what meets are such groups with their
    counts, not players."""
    best = results.filter("user is not null").groupBy("match", "user").agg(F.min_by(F.struct("place", "accuracy", "mode", "duration_ms", "comeback", "theta"), F.struct("place", F.to_json(F.struct("accuracy", "mode", "duration_ms", "comeback", "theta")))).alias("r"))
    sizes = results.groupBy("match").agg(F.count_distinct("user").alias("humans"), F.max(F.col("user").isNull()).alias("bot"))
    own = ratings.groupBy("user").agg(F.first(F.struct("rating", "rd", "volatility", "played", "streak")).alias("k"))
    rows = best.join(sizes, "match").join(own, "user", "left").select(
        "match", "user", "r.*", "humans", "bot", F.coalesce("k.rating", seed_rating(F.coalesce("r.theta", F.lit(0.0)))).cast("double").alias("rating"), F.coalesce("k.rd", F.lit(NEW_RD)).alias("rd"), F.coalesce("k.volatility", F.lit(NEW_VOLATILITY)).alias("volatility"),
        F.coalesce("k.played", F.lit(0)).alias("played"), F.coalesce("k.streak", F.lit(0)).alias("streak"),
    )
    rows = cut(rows)
    # one rating a player for the batch: seeds of a new player's several matches may differ
    seeds = rows.groupBy("user").agg(F.min_by(F.struct("rating", "rd", "volatility"), "match").alias("s")).select(F.col("user").alias("player"), "s.*")
    seated = rows.select("match", F.col("user").alias("player"), "place").join(seeds, "player")
    group = ["match", "place", "rating", "rd"]
    groups = cut(seated.groupBy(*group).agg(F.count("*").alias("n")))
    other = groups.select("match", F.col("place").alias("_place"), F.col("rating").alias("opponent_rating"), F.col("rd").alias("opponent_rd"), F.col("n").alias("_n"))
    mine = F.col("place").eqNullSafe(F.col("_place")) & (F.col("rating") == F.col("opponent_rating")) & (F.col("rd") == F.col("opponent_rd"))
    met = F.col("_n") - F.when(mine, 1).otherwise(0)  # nobody plays themselves
    score = F.when(F.col("place") < F.col("_place"), 1.0).when(F.col("place") == F.col("_place"), 0.5).otherwise(0.0)
    g, e = glicko_terms(F.col("rating"), F.col("opponent_rating"), F.col("opponent_rd"))
    against = groups.join(other, "match").withColumn("_met", met).filter("_met > 0").groupBy(*group).agg(F.sum("_met").alias("games"), F.sum(F.col("_met") * g * g * e * (1 - e)).alias("info"), F.sum(F.col("_met") * g * (score - e)).alias("gain"))
    per = seated.alias("s").join(against.alias("t"), (F.col("s.match") == F.col("t.match")) & F.col("s.place").eqNullSafe(F.col("t.place")) & (F.col("s.rating") == F.col("t.rating")) & (F.col("s.rd") == F.col("t.rd")))
    sums = per.groupBy("player", "s.rating", "s.rd", "volatility").agg(F.sum("games").alias("games"), F.sum("info").alias("info"), F.sum("gain").alias("gain"))
    after = cut(glicko_solved(sums))
    new = seeds.join(after.toDF("player", "_r", "_d", "_v"), "player", "left").select(F.col("player").alias("user"), F.coalesce("_r", "rating").alias("rating"), F.coalesce("_d", "rd").alias("rd"), F.coalesce("_v", "volatility").alias("volatility"), F.col("rating").alias("_before"))
    won = F.coalesce(F.col("place") == 1, F.lit(False))
    told = rows.drop("rating", "rd", "volatility").join(new.select("user", "rating", "_before"), "user").join(paid.select("match", "user").distinct().withColumn("_paid", F.lit(True)), ["match", "user"], "left")
    streak = F.when(won, F.col("streak") + 1).otherwise(0)
    reached = achievements(won, F.col("accuracy"), F.col("mode"), F.col("duration_ms"), F.coalesce(F.col("comeback"), F.lit(False)), streak, F.col("played") + 1, F.floor("rating"), F.lit(0), F.lit(None).cast("int"))
    points = F.when(F.col("_paid"), 0).otherwise(xp_of(F.when(won, "duel_win").otherwise("duel_loss"), F.col("bot")))
    out = told.select(
        "match", "user", "place", won.alias("won"), F.floor("_before").cast("int").alias("elo_before"), F.floor("rating").cast("int").alias("elo_after"), (F.floor("rating") - F.floor("_before")).cast("int").alias("elo_change"), points.cast("int").alias("xp"), reached.alias("achievements"),
    )
    return out, new.drop("_before")

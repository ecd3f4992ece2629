"""Learner model: ordered folds, seat apportionment, daily weights, ratings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions import BKT, bkt_update, mastery_score, raw_weight, skill_state


def bkt_fold(attempts: DataFrame, key: str, order: list[str], prior: float = BKT["prior"], difficulty: str | None = None) -> DataFrame:
    """key, p_learned, attempts: knowledge tracing over a learner's attempts in order.
    Ungraded attempts (null correct) change nothing but count. A learner's attempts are one
    array, which suits people (thousands), not machines."""
    seq = F.array_sort(F.collect_list(F.struct(*order, "correct", *([difficulty] if difficulty else []))))
    step = lambda p, a: F.when(a["correct"].isNull(), p).otherwise(bkt_update(p, a["correct"], difficulty=a[difficulty] if difficulty else None))
    return attempts.groupBy(key).agg(seq.alias("seq")).select(key, F.aggregate("seq", F.lit(prior), step).alias("p_learned"), F.size("seq").alias("attempts"))


def state_fold(attempts: DataFrame, key: str, order: list[str]) -> DataFrame:
    """key, attempts, right, accuracy, mastery, state after all attempts in order, from correct and
    under_target. Runs at the end are found by the last attempt of the other kind, so
    nothing is collected."""
    at = F.struct(*order)
    n, right = F.count("*"), F.count_if("correct")
    rows = attempts.groupBy(key).agg(
        n.alias("attempts"), right.alias("right"), F.max_by("under_target", at).alias("_under"),
        F.max(F.when(F.col("correct"), at)).alias("_right"), F.max(F.when(~F.col("correct"), at)).alias("_wrong"),
    )
    runs = attempts.join(rows.select(key, "_right", "_wrong"), key).groupBy(key).agg(
        F.count_if(F.col("_wrong").isNull() | (at > F.col("_wrong"))).alias("_up"), F.count_if(F.col("_right").isNull() | (at > F.col("_right"))).alias("_down")
    )
    accuracy = F.col("right") / F.col("attempts") * 100
    out = rows.join(runs, key).withColumn("accuracy", accuracy).withColumn("mastery", mastery_score(F.col("accuracy"), F.col("_under")))
    return out.select(key, "attempts", "right", "accuracy", "mastery", skill_state(F.col("mastery"), F.col("_up"), F.col("_down")).alias("state"))


def daily_weights(items: DataFrame, learner: str, **facts: Column) -> DataFrame:
    """items with weight: each learner's add up to 1. facts as raw_weight takes them."""
    total = F.sum("_raw").over(Window.partitionBy(learner))
    return items.withColumn("_raw", raw_weight(**facts)).withColumn("weight", F.when(total > 0, F.col("_raw") / total).otherwise(0.0)).drop("_raw")


def apportion(shares: DataFrame, group: str, name: str, share: str, seats: int | Column, order: str | None = None) -> DataFrame:
    """Whole seats by largest remainder; of equal remainders the first by order (the name)."""
    seats = F.lit(seats) if isinstance(seats, int) else seats
    total = F.sum(share).over(Window.partitionBy(group))
    exact = F.col(share) * seats / total
    rows = shares.withColumn("_base", F.floor(exact)).withColumn("_rest", F.round(exact - F.floor(exact), 9))
    left = seats - F.sum("_base").over(Window.partitionBy(group))
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.col("_rest").desc(), order or name))
    return rows.withColumn("_left", left).withColumn("seats", F.col("_base") + F.when(place <= F.col("_left"), 1).otherwise(0)).drop("_base", "_rest", "_left")


#: Shares of primary, sinking and frontier practice, in percent.
BASE_SHARES = (60, 20, 20)
PERSONA_SHARES = {"SpeedDemon": (70, 15, 15), "BrainTrainer": (50, 30, 20), "SchoolSupport": (60, 20, 20)}
CLUSTER_SHARES = {"sprinter": (70, 15, 15), "deliberate": (60, 20, 20), "perfectionist": (60, 20, 20), "balanced": (60, 20, 20), "rebuilder": (50, 30, 20), "wanderer": (40, 30, 30)}


def session_allocation(learners: DataFrame, key: str, persona: str, cluster: str, has_fluid: Column, has_fragile: Column, size: Column) -> DataFrame:
    """key, bucket, seats: a session dealt to primary, sinking and frontier practice. The cluster's
    shares go before the persona's; what has no items gives its share to the others."""
    table = lambda named: F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for pair in named.items() for x in pair])
    shares = F.coalesce(table(CLUSTER_SHARES)[F.col(cluster)], table(PERSONA_SHARES)[F.col(persona)], F.array(*map(F.lit, BASE_SHARES)))
    p, s, f = shares[0], shares[1], shares[2]
    p, s, f = F.when(has_fluid, p).otherwise(0), F.when(has_fluid, s).otherwise(s + 30), F.when(has_fluid, f).otherwise(f + 30)
    p, s, f = F.when(has_fragile, p).otherwise(p + 10), F.when(has_fragile, s).otherwise(0), F.when(has_fragile, f).otherwise(f + 10)
    buckets = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(n).alias("bucket"), x.alias("share")) for i, (n, x) in enumerate((("primary", p), ("sinking", s), ("frontier", f)))])
    rows = learners.select(key, size.alias("_size"), F.explode(buckets).alias("x")).select(key, "_size", "x.*")
    return apportion(rows, key, "bucket", "share", F.col("_size"), "place").select(key, "bucket", "seats")


SCALE, TAU = 173.7178, 0.5


def volatilities(phi: np.ndarray, v: np.ndarray, delta: np.ndarray, sigma: np.ndarray, rounds: int = 100, close: float = 1e-6) -> np.ndarray:
    """The new volatility of each player of a batch: the root of the published equation, by
    regula falsi with halving, all players at once."""
    a = np.log(sigma**2)
    excess = delta**2 - phi**2 - v

    def f(x):
        e = np.exp(x)
        return e * (delta**2 - phi**2 - v - e) / (2 * (phi**2 + v + e) ** 2) - (x - a) / TAU**2

    low, high = a.copy(), np.where(excess > 0, np.log(np.where(excess > 0, excess, 1.0)), a - TAU)
    for _ in range(rounds):  # without excess, the first of a - tau, a - 2 tau ... beyond the root
        short = (excess <= 0) & (f(high) < 0)
        if not short.any():
            break
        high = np.where(short, high - TAU, high)
    f_low, f_high = f(low), f(high)
    for _ in range(rounds):
        open_ = np.abs(high - low) > close
        if not open_.any():
            break
        slope = np.where(open_, f_high - f_low, 1.0)
        mid = np.where(open_, low + (low - high) * f_low / np.where(slope == 0, 1.0, slope), high)
        f_mid = f(mid)
        crossed = f_mid * f_high <= 0
        low, f_low = np.where(open_ & crossed, high, low), np.where(open_, np.where(crossed, f_high, f_low / 2), f_low)
        high, f_high = np.where(open_, mid, high), np.where(open_, f_mid, f_high)
    return np.exp(low / 2)


def glicko_period(matches: DataFrame) -> DataFrame:
    """player, rating, rd, volatility after one period, from rows of (player, rating, rd,
    volatility, opponent_rating, opponent_rd, score): sums are grouped, the root of the
    volatility equation is found for whole Arrow batches.

    All games count with the ratings from before the period. A player without a game
    (null opponent_rating) keeps the rating, and the deviation grows by the volatility; one whose
    games tell nothing (a certain outcome) stays as is. Deviations stay within 30 and 350.
    """
    g, e = glicko_terms(F.col("rating"), F.col("opponent_rating"), F.col("opponent_rd"))
    sums = matches.groupBy("player", "rating", "rd", "volatility").agg(F.count("opponent_rating").alias("games"), F.coalesce(F.sum(g * g * e * (1 - e)), F.lit(0.0)).alias("info"), F.coalesce(F.sum(g * (F.col("score") - e)), F.lit(0.0)).alias("gain"))
    return glicko_solved(sums)


def glicko_terms(rating: Column, opponent_rating: Column, opponent_rd: Column) -> tuple[Column, Column]:
    """(weight of a game by the opponent's deviation, expected score)."""
    g = 1 / F.sqrt(1 + 3 * (opponent_rd / SCALE) ** 2 / np.pi**2)
    return g, 1 / (1 + F.exp(-g * (rating - opponent_rating) / SCALE))


def glicko_solved(sums: DataFrame) -> DataFrame:
    """player, rating, rd, volatility after a period, from the sums of each player's games (player, rating, rd, volatility, games, info, gain)."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rating, rd, sigma, games, info, gain = (b.column(i).to_numpy() for i in range(1, 7))
            told, played = info > 0, games > 0
            phi, v = rd / SCALE, 1 / np.where(told, info, 1.0)
            new = np.where(told, volatilities(phi, v, v * gain, sigma), sigma)
            wider = np.sqrt(phi**2 + new**2)
            after = np.where(told, 1 / np.sqrt(1 / wider**2 + np.where(told, info, 0.0)), np.where(played, phi, wider))
            moved = np.where(told, rating + SCALE * after**2 * gain, rating)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(moved), pa.array(np.clip(SCALE * after, 30, 350)), pa.array(new)], names=["player", "rating", "rd", "volatility"])

    return sums.mapInArrow(solve, f"player {dict(sums.dtypes)['player']}, rating double, rd double, volatility double")

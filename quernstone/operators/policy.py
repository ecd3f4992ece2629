"""Policies: who sees what, children's rules, achievements, prices, subscriptions' sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions import bucket64


def where_given(rows: DataFrame, **equal) -> DataFrame:
    """rows with the columns equal to the arguments that aren't None."""
    for name, value in equal.items():
        if value is not None:
            rows = rows.filter(F.col(name) == value)
    return rows


def servable(items: DataFrame, key: str, text: str, status: str, allowed: list[str], linked: DataFrame, quarantined: DataFrame) -> DataFrame:
    """Items with a text, an allowed status and a link, that are not quarantined."""
    shown = items.filter(F.col(text).isNotNull() & (F.trim(text) != "") & F.col(status).isin(*allowed))
    return shown.join(linked.select(key), key, "left_semi").join(quarantined.select(key), key, "left_anti")


def is_quarantined(label: Column) -> Column:
    return F.startswith(F.upper(F.coalesce(label, F.lit(""))), F.lit("QUARANTIN"))


#: Labels that are trusted, and those that are served but never feed mastery.
TRUSTED = ["LIVE", "TRUSTED", "trusted", "live"]
SANDBOX = ["SANDBOX", "sandbox", "sandbox_candidate", "trusted_candidate"]


def trust_of(label: Column) -> Column:
    """struct(servable, tier, feeds_mastery, reason); an unknown label is refused."""
    out = lambda s, t, m, r: F.struct(F.lit(s).alias("servable"), F.lit(t).alias("tier"), F.lit(m).alias("feeds_mastery"), (r if isinstance(r, Column) else F.lit(r)).alias("reason"))
    return (
        F.when(F.coalesce(label, F.lit("")) == "", out(False, "unknown", False, "missing trust label"))
        .when(label.isin(*TRUSTED), out(True, "trusted", True, "trusted"))
        .when(label.isin(*SANDBOX), out(True, "sandbox", False, "sandbox: excluded from mastery"))
        .when(is_quarantined(label), out(False, "quarantined", False, F.concat(F.lit("quarantined ("), label, F.lit(")"))))
        .otherwise(out(False, "unknown", False, F.concat(F.lit("unrecognised trust label ("), label, F.lit(")"))))
    )


def shown_trust(label: Column) -> Column:
    """What a learner is told of reviewed content: no verdict means checked question and answer only."""
    return F.when(label.isin("LIVE", "TRUSTED"), "trusted").when(label == "SANDBOX", "sandbox").otherwise("static_verified")


def trust_from_reasons(reasons: Column, hard: list[str]) -> Column:
    """By the reasons against an item; null, that is no check at all, is not trusted."""
    return F.when(reasons.isNull(), "QUARANTINED_SOFT").when(F.arrays_overlap(reasons, F.array(*map(F.lit, hard))), "QUARANTINED_HARD").when(F.size(reasons) > 0, "QUARANTINED_SOFT").otherwise("TRUSTED")


def visible(items: DataFrame, owner: str, public: str, friends: DataFrame, viewer: str, live: Column) -> DataFrame:
    """viewer and item: what is the viewer's own, public, or of a friend (friends: viewer, owner) and still live."""
    shown = items.filter(live)
    own = shown.withColumn(viewer, F.col(owner))
    theirs = shown.join(friends.select(viewer, owner), owner)
    everyone = shown.filter(F.col(public)).withColumn(viewer, F.lit(None).cast(dict(items.dtypes)[owner]))
    return own.unionByName(theirs).distinct().unionByName(everyone)


def kids_policy(age: Column, cap_minutes: Column, account_type: Column | None = None, limit: int = 13, taunt_age: int = 10, cap: int = 10, most: int = 20) -> Column:
    """What an account of an age may do; an unknown age is an adult's, but no bots and no taunts."""
    account_type = F.lit(None).cast("string") if account_type is None else account_type
    kid, known = F.coalesce(age < limit, F.lit(False)), age.isNotNull()
    return F.struct(
        kid.alias("kids_mode"),
        known.alias("age_known"),
        (~kid & (~known | (age >= taunt_age))).alias("ads_enabled"),
        (known & ~kid).alias("bots_enabled"),
        (F.coalesce(age >= taunt_age, F.lit(False)) & ~kid).alias("taunts_enabled"),
        F.when(kid, F.least(F.coalesce(F.when(cap_minutes != 0, cap_minutes), F.lit(cap)), F.lit(most))).alias("session_cap_minutes"),
        F.when(kid, "percentile_only").otherwise("full").alias("leaderboard"),
        F.when(kid, "parent_managed").otherwise("open").alias("friends"),
        F.coalesce(account_type, F.lit("standard")).alias("account_type"),
        kid.alias("timers_suppressed"),
        kid.alias("tracking_minimized"),
        (~kid).alias("clips_enabled"),
        kid.alias("parental_consent_required"),
    )


#: Matches between taunts by cluster; 0 is never.
TAUNT_EVERY = {"sprinter": 3, "perfectionist": 5, "deliberate": 0, "rebuilder": 0}


def taunt_gate(age: Column, cluster: Column, since_last: Column, losses: Column, opted_in: Column, min_age: int = 10, kid_age: int = 13, default_every: int = 4) -> Column:
    """The first reason against a taunt, or ok."""
    every = F.coalesce(F.create_map(*[F.lit(x) for pair in TAUNT_EVERY.items() for x in pair])[F.lower(F.coalesce(cluster, F.lit("")))], F.lit(default_every))
    return (
        F.when(~opted_in, "opted_out")
        .when(age.isNull() | (age < min_age), "age_gate")
        .when(age < kid_age, "kids_mode")
        .when(losses >= 3, "loss_streak")
        .when(every <= 0, "cluster_never")
        .when(since_last + 1 < every, "frequency")
        .otherwise("ok")
    )


def leaderboard_mode(since_match: Column, mode: Column, kid: Column, cooldown: int = 60) -> Column:
    """struct(mode, reason): hidden after a match, then by what learners can bear, then children's rule."""
    out = lambda m, r: F.struct(F.lit(m).alias("mode"), (r if isinstance(r, Column) else F.lit(r)).alias("reason"))
    return (
        F.when(since_match < cooldown, out("hidden", F.concat(F.lit("available in "), F.floor(cooldown - since_match).cast("string"), F.lit("s"))))
        .when(mode == "hidden", out("hidden", "unavailable in recovery mode"))
        .when(kid, out("percentile_only", "kids_mode"))
        .when(mode == "percentile_only", out("percentile_only", "fragile"))
        .otherwise(out("full", "ok"))
    )


def achievements(won: Column, accuracy: Column, mode: Column, duration_ms: Column, comeback: Column, streak: Column, played: Column, rating: Column, friends: Column, daily_rank: Column) -> Column:
    """The keys that a player's figures satisfy, in the order of the catalogue, whose keys and thresholds are fixed values."""
    rules = [
        ("first_win", won),
        ("perfect_game", won & (accuracy >= 100)),
        ("speed_demon", won & (mode == "speed_race") & (duration_ms < 60_000)),
        ("comeback_king", won & comeback),
        *((f"win_streak_{n}", streak >= n) for n in (3, 5, 10, 25)),
        *((f"games_{n}", played >= n) for n in (10, 100, 500, 1000)),
        *((f"elo_{n}", rating >= n) for n in (1500, 1800, 2000, 2200)),
        ("first_friend", friends >= 1),
        ("daily_top10", daily_rank <= 10),
        ("daily_top1", daily_rank == 1),
    ]
    return F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules]))


# Prices -------------------------------------------------------------------------------


def to_minor(usd_cents: Column, currency: Column, rate: Column) -> Column:
    """A price in cents of a dollar in the currency's minor unit, half up; null for other currencies."""
    return F.when(currency == "USD", usd_cents.cast("bigint")).when((currency == "INR") & (rate > 0), F.round(usd_cents.cast("decimal(18,0)") * rate.cast("decimal(18,4)"), 0).cast("bigint"))


def to_usd_cents(minor: Column, currency: Column, rate: Column) -> Column:
    """Back again, at the rate of the sale."""
    return F.when(currency == "USD", minor.cast("bigint")).when((currency == "INR") & (rate > 0), F.round(minor.cast("decimal(18,0)") / rate.cast("decimal(18,4)"), 0).cast("bigint"))


SEAT_PERCENT = [100, 80, 60]


def family_total(unit_minor: Column, seats: Column) -> Column:
    """The parent's full price and a falling share for each child's seat, each rounded half up."""
    prices = [F.when(seats >= n, F.round(unit_minor.cast("decimal(18,0)") * share / 100, 0).cast("bigint")).otherwise(0) for n, share in enumerate(SEAT_PERCENT, 1)]
    total = unit_minor
    for price in prices:
        total = total + price
    return F.when(seats.between(0, len(SEAT_PERCENT)), total)


def seat_discounts(seats: DataFrame, family: str, number: str) -> DataFrame:
    """seats with percent, by their rank in the family and not by their number."""
    place = F.row_number().over(Window.partitionBy(family).orderBy(number))
    return seats.withColumn("percent", F.when(place == 1, 100).when(place == 2, 80).otherwise(60))


def tiers_of_children(seats: DataFrame, parents: DataFrame, parent: str, child: str, status: str, tier: str) -> DataFrame:
    """child, tier: the parent's where the seat is active, else free."""
    return seats.join(parents.select(parent, F.col(tier).alias("_tier")), parent).select(child, F.when(F.col(status) == "active", F.col("_tier")).otherwise("free").alias("tier"))


def sweep(subscriptions: DataFrame, now: Column, grace_days: int) -> DataFrame:
    """subscriptions with their next status and cause: grace used up, cancellation due; overdue
    trials are only marked."""
    late = lambda c: F.date_add(c, grace_days) < now
    unpaid = (F.col("status") == "past_due") & late(F.coalesce("past_due_since", "updated_at"))
    closed = F.col("status").isin("active", "trialing") & F.col("cancel_at_period_end") & (F.col("current_period_end") < now)
    overdue = (F.col("status") == "trialing") & late(F.col("trial_ends_at"))
    cause = F.when(unpaid, "grace_exhausted").when(closed, "period_closed").when(overdue, "trial_overdue")
    return subscriptions.withColumn("cause", cause).withColumn("status", F.when(F.col("cause") == "grace_exhausted", "unpaid").when(F.col("cause") == "period_closed", "cancelled").otherwise(F.col("status")))


def post_match_message(facts: dict[str, Column], seed: Column, templates: dict[str, int]) -> Column:
    """struct(id, template): the first of the situations that holds, and which of its templates
    a stable hash of the seed picks."""
    pick = lambda name: bucket64(F.concat_ws(":", seed.cast("string"), F.lit(name)), templates[name]).cast("int")
    return F.coalesce(*[F.when(fact, F.struct(F.lit(name).alias("id"), pick(name).alias("template"))) for name, fact in facts.items()])


def overridden(verdicts: DataFrame, overrides: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(key, level: the last override's, else the verdict's; audit trail: key, previous, new, reason, at)."""
    at = Window.partitionBy(key).orderBy("at")
    first = overrides.join(verdicts.select(key, F.col("level").alias("_old")), key, "left")
    trail = first.select(key, F.coalesce(F.lag("level").over(at), F.col("_old")).alias("previous"), F.col("level").alias("new"), "reason", "at")
    last = overrides.groupBy(key).agg(F.max_by("level", "at").alias("_new"))
    return verdicts.join(last, key, "full_outer").select(key, F.coalesce("_new", "level").alias("level")), trail


def erased(tables: dict[str, DataFrame], users: DataFrame, user: str) -> dict[str, DataFrame]:
    """Every table without the rows of the users who asked to be deleted."""
    return {name: t.join(users.select(user), user, "left_anti") for name, t in tables.items()}

"""Column functions: text keys, hashes, rounding, learner-model arithmetic; answers have a module of their own."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Text ---------------------------------------------------------------------------------

#: Words that don't tell topics apart.
STOPWORDS = ["and", "the", "of", "a", "an", "in", "on", "for", "to", "with"]
#: What every instruction says; first everyday words, then those of worked steps.
COMMON_WORDS = """
about above across after again against all also and any are because been before being below between both but came can
could did does down each end even every few first for from further get give given gives had has have here how into its
itself just like made make many more most much must never next not now number numbers off once only onto other our out
over own part parts place places same see should since some step steps such take than that the their them then there
these they this those through thus too under until use used uses using very was way well were what when where which
while who why will with within without would you your
answer apply calculate calculation compute continue convert equation equations expression final find first form formula
get gives left multiply next number obtain operation problem process rectangle result results right rule second set side
solution solve solving step steps substitute subtract sum term terms third total unknown value values variable write
""".split()


def norm(c: Column | str) -> Column:
    """Lower case, any run of other characters as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", " "))


def token_set(c: Column | str, stopwords: list[str] = STOPWORDS) -> Column:
    """The sorted set of norm's words without stopwords: a key that ignores order."""
    return F.array_sort(F.array_except(F.array_distinct(F.split(norm(c), " ")), F.array(*map(F.lit, ["", *stopwords]))))


def without_chapter(c: Column | str) -> Column:
    """The text after a leading `chapter 3:` or `3.`; a bare number stays."""
    return F.regexp_replace(F.trim(col(c)), r"(?i)^\s*(ch(apter)?\s*\d+\s*[.:)-]?\s*|\d+\s*[.:)]\s*)", "")


def fold(c: Column | str) -> Column:
    """Lower case with white space folded; content_hash is taken over this."""
    return F.trim(F.regexp_replace(F.lower(col(c)), r"\s+", " "))


@F.pandas_udf(StringType())
def _compatible(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def nfkc_fold(c: Column | str) -> Column:
    """Compatibility form, case folded, white space as one space. Python sees texts with
    other than ASCII letters only: Spark has no such function."""
    text = col(c)
    plain = ~text.rlike(r"[^\x00-\x7F]")
    folded = F.when(plain, F.lower(text)).otherwise(_compatible(F.when(~plain, text)))
    return F.trim(F.regexp_replace(folded, r"\s+", " "))


def content_hash(c: Column | str) -> Column:
    return F.sha2(nfkc_fold(c), 256)


def norm_key(c: Column | str, strip_chapter: bool = False) -> Column:
    """A label as a key: separators as spaces, `: ` after a colon, no other punctuation
    than : & / +; strip_chapter drops a leading chapter number and a trailing bracket."""
    text = F.trim(col(c))
    if strip_chapter:
        text = F.regexp_replace(F.regexp_replace(text, r"(?i)^\s*(ch(apter)?\.?\s*)?\d+\s*[.:)\-]?\s*", ""), r"\s*\([^)]*\)\s*$", "")
    text = F.regexp_replace(F.regexp_replace(text, r"[_\-\s]+", " "), r"\s*:\s*", ": ")
    return nfkc_fold(F.regexp_replace(text, r"[^\p{L}\p{N}_\s:&/+]", ""))


@F.pandas_udf(StringType())
def _unmarked(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


def slug(c: Column | str) -> Column:
    """Letters without their marks, everything else as one underscore, lower case."""
    text = col(c)
    plain = ~text.rlike(r"[^\x00-\x7F]")
    bare = F.when(plain, text).otherwise(_unmarked(F.when(~plain, text)))
    return F.lower(F.regexp_replace(F.regexp_replace(bare, r"[^\p{L}\p{N}_]+", "_"), "^_+|_+$", ""))


def params_hash(pattern: Column | str, params: Column | str) -> Column:
    """Hash of a pattern id and its parameters (a map) in key order."""
    pairs = F.transform(F.array_sort(F.map_entries(col(params))), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return F.sha2(F.concat_ws("|", col(pattern), F.array_join(pairs, "|")), 256)


def stem_set(c: Column | str, length: int = 5, stopwords: list[str] = STOPWORDS) -> Column:
    """The set of the first letters of a text's words, without stopwords."""
    words = F.array_except(F.regexp_extract_all(F.lower(col(c)), F.lit("([a-z]+)"), 1), F.array(*map(F.lit, stopwords)))
    return F.array_distinct(F.transform(words, lambda w: F.substring(w, 1, length)))


def content_words(c: Column | str, stopwords: list[str] = COMMON_WORDS) -> Column:
    """Different lower-case words of four letters or more that are no stopwords."""
    return F.filter(F.array_distinct(F.regexp_extract_all(F.lower(col(c)), F.lit(r"([a-z]{4,})"), 1)), lambda w: ~w.isin(*stopwords))


def skeleton(c: Column | str) -> Column:
    """A text's shape: runs of digits as #."""
    return F.regexp_replace(col(c), r"\d+", "#")


def relative_time(seconds: Column | str) -> Column:
    s = col(seconds)
    label = lambda n, unit: F.concat(F.floor(s / n).cast("string"), F.lit(unit))
    return F.when(s < 60, "Just now").when(s < 3600, label(60, "m ago")).when(s < 86400, label(3600, "h ago")).when(s < 2 * 86400, "Yesterday").otherwise(label(86400, "d ago"))


def chunk_kind(c: Column | str) -> Column:
    """struct(kind, detail) of a chunk type: what follows a known prefix is the detail."""
    t = col(c)
    rest = lambda prefix: F.substring(t, len(prefix) + 1, 1 << 20)
    out = lambda kind, detail: F.struct(F.lit(kind).alias("kind"), detail.alias("detail"))
    some = lambda d: F.when(d != "", d)
    return (
        F.when(t == "explanation", out("explanation", F.lit(None).cast("string")))
        .when(F.startswith(t, F.lit("template_")), out("template", some(rest("template_"))))
        .when(F.startswith(t, F.lit("enriched_record_")), out("enriched_record", some(rest("enriched_record_"))))
        .otherwise(out("UNKNOWN", t))
    )


def rename_key(m: Column, old: str, new: str) -> Column:
    """The map with a key renamed; a value that the new key has already stays."""
    taken = F.map_contains_key(m, new)
    moved = F.transform_keys(m, lambda k, _: F.when(k == old, new).otherwise(k))
    return F.when(taken, F.map_filter(m, lambda k, _: k != old)).otherwise(moved)


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Of two arrays as sets; null if both are empty."""
    union = F.size(F.array_union(col(a), col(b)))
    return F.when(union > 0, F.size(F.array_intersect(col(a), col(b))) / union)


# Hash orders --------------------------------------------------------------------------


def bucket64(key: Column, buckets: int) -> Column:
    """The first 8 bytes of sha256(key) as an unsigned number, modulo buckets."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(buckets)


def sampled_in(user: Column | str, event: Column | str, buckets: int = 10) -> Column:
    """Whether a stable tenth of a user's events takes this one."""
    return bucket64(F.concat_ws(":", col(user).cast("string"), col(event).cast("string")), buckets) == 0


def rollout(user: Column | str, flag: str, percent: int) -> Column:
    return bucket64(F.concat_ws(":", col(user).cast("string"), F.lit(flag)), 100) < percent


def hash_order(seed: str, key: Column | str) -> Column:
    """A seeded order that any engine can repeat."""
    return F.sha2(F.concat_ws(":", F.lit(seed), col(key).cast("string")), 256)


# Rounding -----------------------------------------------------------------------------


def round_half_up(c: Column) -> Column:
    """floor(x + 0.5)."""
    return F.floor(c + F.lit(0.5))


def round_away(c: Column) -> Column:
    """Half away from zero, symmetric."""
    return F.signum(c) * F.floor(F.abs(c) + F.lit(0.5))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


# Learner model ------------------------------------------------------------------------

#: Fixed values of knowledge tracing: prior, learn, guess, slip, forget; the learn rate by difficulty.
BKT = {"prior": 0.35, "learn": 0.14, "guess": 0.2, "slip": 0.1, "forget": 0.007}
LEARN_BY_DIFFICULTY = {1: 0.4, 2: 0.3, 3: 0.25, 4: 0.2, 5: 0.15}


def bkt_posterior(p: Column, correct: Column, guess: float = 0.2, slip: float = 0.1) -> Column:
    if guess + slip >= 1:
        raise ValueError("guess and slip must add up to less than 1")
    right = p * (1 - slip) / (p * (1 - slip) + (1 - p) * guess)
    wrong = p * slip / (p * slip + (1 - p) * (1 - guess))
    return F.when(correct, right).otherwise(wrong)


def learn_rate(difficulty: Column | None, learn: float = 0.14) -> Column:
    """By the item's difficulty, where it has a known one."""
    if difficulty is None:
        return F.lit(learn)
    rates = [F.when(difficulty == level, rate) for level, rate in LEARN_BY_DIFFICULTY.items()]
    return F.coalesce(*rates, F.lit(learn))


def bkt_update(p: Column, correct: Column, learn: float = 0.14, guess: float = 0.2, slip: float = 0.1, difficulty: Column | None = None) -> Column:
    after = bkt_posterior(p, correct, guess, slip)
    return after + (1 - after) * learn_rate(difficulty, learn)


def decayed(p: Column, days: Column, forget: float = 0.007) -> Column:
    """What is left after days without practice."""
    return F.when(days <= 0, p).otherwise(p * F.pow(F.lit(1 - forget), days / 45))


def bkt_gate(p: Column) -> Column:
    return F.when(p >= 0.85, "fluid").when(p >= 0.6, "proficient").otherwise("learning")


def shrunk_prior(prior: Column, rate: Column, n: Column, weight: int = 20) -> Column:
    """The prior drawn to the observed rate, from weight attempts on."""
    return F.when(n < weight, prior).otherwise((weight * prior + n * rate) / (weight + n))


def mastery_score(accuracy: Column, under_target: Column) -> Column:
    """0 to 100 from the accuracy in percent, with a bonus for answers within the target time."""
    return F.least(F.lit(100.0), F.floor(accuracy * 0.6 + F.when(under_target, 40).otherwise(20) + 0.5))


def skill_state(mastery: Column, right_in_a_row: Column, wrong_in_a_row: Column) -> Column:
    return F.when((mastery < 50) | (wrong_in_a_row >= 3), "fractured").when((mastery >= 80) & (right_in_a_row >= 5), "fluid").otherwise("fragile")


def stored_state(accuracy: Column, attempts: Column, right_in_a_row: Column, wrong_in_a_row: Column) -> Column:
    """The state as the store has it: by accuracy (percent), of which a low one counts from the sixth attempt on."""
    broken = (wrong_in_a_row >= 3) | ((accuracy < 50) & (attempts > 5))
    return F.when(broken, "fractured").when((accuracy >= 80) & (right_in_a_row >= 5), "fluid").otherwise("fragile")


def learning_path(goal: Column, exam: Column, familiarity: Column) -> Column:
    """An exam leads to exam_prep, speed with familiarity to vedic_standalone, all else to the default."""
    prepares = (goal == "exam_prep") | (F.coalesce(exam, F.lit("")) != "")
    fast = (goal == "speed") & (F.coalesce(familiarity, F.lit(0)) >= 5)
    return F.when(F.coalesce(prepares, F.lit(False)), "exam_prep").when(F.coalesce(fast, F.lit(False)), "vedic_standalone").otherwise("core_math_vedic")


def urgency(days_left: Column) -> Column:
    return F.when(days_left <= 3, 2.0).when(days_left <= 7, 1.5).when(days_left <= 14, 1.2).otherwise(1.0)


def raw_weight(mastery: Column, high_yield: Column, weak: Column, idle_days: Column, days_left: Column, damage_control: Column) -> Column:
    """What a skill weighs in a day's practice, before weights are made to add up to 1."""
    base = F.when(mastery >= 90, 0.05).when(mastery >= 70, 0.15).when(mastery >= 50, 0.3).otherwise(0.4)
    pressed = F.when(mastery >= 90, 0.01).otherwise(base * F.when(high_yield, 2.0).otherwise(0.1) * F.when((mastery >= 50) & (mastery < 70), 1.5).otherwise(1.0))
    weight = F.when(damage_control, pressed).otherwise(base)
    return weight * F.when(weak, 1.5).otherwise(1.0) * F.when(idle_days > 7, 1.5).otherwise(1.0) * urgency(days_left)


#: Fixed values: (from, to, multiplier) of the time by age.
AGE_MULTIPLIERS = [(8, 10, 2.5), (11, 13, 2.0), (14, 17, 1.5), (18, 25, 1.0), (26, 40, 1.2), (41, 60, 1.5), (61, 200, 2.0)]


def age_multiplier(age: Column, young: float = 2.5, other: float = 2.0) -> Column:
    ranges = [F.when(age.between(low, high), by) for low, high, by in AGE_MULTIPLIERS]
    return F.coalesce(*ranges, F.when(age < 8, young).otherwise(other))


def target_seconds(age: Column, base: int = 30) -> Column:
    return round_half_up(base * age_multiplier(age))


def expected_seconds(difficulty: Column, load: Column, steps: Column) -> Column:
    """Time of an item by difficulty 1 to 5, cognitive load 1 to 7 and its median steps:
    a multiple of 5 from 15 to 300."""
    d = 1 + 0.5 * (F.least(F.lit(5), F.greatest(F.lit(1), difficulty)) - 1)
    x = 1 + 0.15 * (F.least(F.lit(7), F.greatest(F.lit(1), load)) - 2)
    s = F.least(F.lit(1.5), 1 + 0.05 * F.greatest(F.lit(0), F.coalesce(steps, F.lit(4)) - 4))
    return clamp(5 * F.bround(30 * d * x * s / 5, 0), 15, 300)


def seed_rating(theta: Column | str) -> Column:
    return clamp(1000.0 + 400.0 * col(theta), 600.0, 2400.0)


def level(xp: Column | str) -> Column:
    return F.floor(col(xp) / 500) + 1


def rank_percentile(rank: Column, n: Column) -> Column:
    """100 * (1 - (rank - 0.5) / n), rounded half to even, within 0..99."""
    return clamp(F.bround(100.0 * (1.0 - (rank - 0.5) / n), 0), 0.0, 99.0).cast("int")


def daily_score(correct: Column, total: Column, time_ms: Column, seconds: int = 60) -> Column:
    """100 for each correct answer; if all are, the whole seconds saved under seconds a question."""
    saved = F.floor(F.greatest(F.lit(0.0), total * seconds - time_ms / 1000))
    return 100 * correct + F.when((correct == total) & (total > 0), saved).otherwise(0)


def answer_tier(time_ms: Column, typed: Column, keystrokes: Column, theta: Column) -> Column:
    """First matching plausibility verdict of a timed answer of so many typed characters;
    one character leaves no gap between keystrokes."""
    untyped = (typed >= 2) & (F.coalesce(keystrokes, F.lit(0)) == 0)
    return F.when(time_ms < 200, "reject_fast").when(untyped, "reject_no_input").when(time_ms < 800, "flag_fast").when((time_ms < 2000) & (theta < 0.5), "flag_skill").otherwise("ok")


def composite_skill(theta: Column, rating: Column) -> Column:
    return 0.4 * (theta + 3) / 6 + 0.6 * (rating - 600) / 1800


def search_band(wait_seconds: Column) -> Column:
    return F.least(F.lit(0.5), 0.15 + F.greatest(F.lit(0), wait_seconds) / 60 * 0.05)


def candidate_rank(delta: Column, wait_seconds: Column) -> Column:
    """Least first: near in skill, and long waiting, which counts up to two minutes."""
    return delta * 0.7 - F.least(F.lit(1.0), F.greatest(F.lit(0), wait_seconds) / 120) * 0.3


def round_difficulty(theta_a: Column, theta_b: Column, number: Column, sudden_death_after: int = 10) -> Column:
    """Half a step a round, a whole one once rounds go into sudden death."""
    base = F.floor((theta_a + theta_b) / 2)
    return base + 0.5 * (F.least(number, F.lit(sudden_death_after)) - 1) + F.greatest(F.lit(0), number - sudden_death_after)


#: Points by reason.
XP_RULES = {"practice_correct": 10, "session_complete": 25, "streak_day": 20, "duel_win": 50, "duel_loss": 15, "daily_challenge_complete": 50, "daily_challenge_correct": 10, "ghost_race_win": 30, "friend_added": 10, "mock_completed": 75}


def xp_of(reason: Column, against_bot: Column | None = None) -> Column:
    """Points of a reason, halved (whole points) where a bot took part; null for unknown reasons."""
    points = F.create_map(*[F.lit(x) for pair in XP_RULES.items() for x in pair])[reason]
    return points if against_bot is None else F.when(against_bot, F.floor(points / 2)).otherwise(points)


def month_bounds(c: Column) -> Column:
    """struct(start, end) of a time's month, in milliseconds since 1970."""
    start = F.date_trunc("month", c)
    return F.struct(F.unix_millis(start).alias("start"), F.unix_millis(F.add_months(start, 1).cast("timestamp")).alias("end"))

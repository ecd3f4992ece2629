"""Content and policy operators: audit verdicts, scores, picks, subscriptions, windows, chains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from quernstone.lineage import cut

from quernstone.functions import fold, hash_order


def first_failure(stages: dict[str, Column]) -> Column:
    """The first stage, in order, whose condition is not true; null if all hold."""
    return F.coalesce(*[F.when(F.coalesce(ok, F.lit(False)), F.lit(None)).otherwise(F.lit(name)) for name, ok in stages.items()])


def blockers(reasons: dict[str, Column]) -> Column:
    """Every reason that holds; an item without one is playable."""
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in reasons.items()]))


def first_of_equal(rows: DataFrame, text: str, key: str) -> DataFrame:
    """rows and is_first: whether none of equal folded text has a lesser key. One partial
    aggregation, joined back by hash, so no group is ordered in one task."""
    h = F.sha2(fold(text), 256)
    first = rows.groupBy(h.alias("_hash")).agg(F.min(key).alias("_first"))
    return rows.withColumn("_hash", h).join(first, "_hash", "left").withColumn("is_first", F.col("_first").isNull() | (F.col(key) == F.col("_first"))).drop("_hash", "_first")


def grounding(claim: Column, page: Column) -> Column:
    """exact: the page has the claim; fuzzy: it has it when both are folded; else discard."""
    return F.when(F.contains(page, claim), "exact").when(F.contains(fold(page), fold(claim)), "fuzzy").otherwise("discard")


def cognitive_mode(states: DataFrame, user: str, state: str) -> DataFrame:
    """What a learner is shown of ranks: hidden if half of the skills or more are
    fractured, percentile_only if half or more are fragile, else full."""
    share = lambda s: F.avg((F.col(state) == s).cast("int"))
    return states.groupBy(user).agg(F.when(share("fractured") >= 0.5, "hidden").when(share("fragile") >= 0.5, "percentile_only").otherwise("full").alias("mode"))


def ramp(items: DataFrame, group: str, key: str, easy: Column, difficulty: str, n: int, easy_n: int, seed: str) -> DataFrame:
    """n items of each group in hash order: easy_n easy ones, the rest hard, and what one
    kind lacks taken from the other, with position in rising difficulty."""
    rows = items.withColumn("_easy", easy).withColumn("_place", hash_order(seed, key))
    own = F.row_number().over(Window.partitionBy(group, "_easy").orderBy("_place"))
    rows = rows.withColumn("_extra", own > F.when(F.col("_easy"), easy_n).otherwise(n - easy_n))
    rows = rows.withColumn("_pick", F.row_number().over(Window.partitionBy(group).orderBy("_extra", "_place"))).filter(F.col("_pick") <= n)
    rising = Window.partitionBy(group).orderBy(difficulty, "_place")
    return rows.withColumn("position", F.row_number().over(rising)).drop("_easy", "_place", "_extra", "_pick")


def subscription_states(events: DataFrame, user: str, order: list[str], kind: str, opens: dict[str, str], pays: dict[str, str], closes: str) -> DataFrame:
    """user, state: what the events leave, in order. A closing event is terminal until an
    opening one; payments don't revive it; other kinds change nothing. Three maxima by user
    say it, so no history is collected."""
    k, at = F.col(kind), F.struct(*order)
    names = F.create_map(*[F.lit(x) for pair in (opens | pays).items() for x in pair])
    sums = events.groupBy(user).agg(
        F.max(F.when(k == closes, at)).alias("closed"), F.max(F.when(k.isin(*opens), at)).alias("opened"), F.max_by(names[k], F.when(k.isin(*opens, *pays), at)).alias("last")
    )
    shut = F.col("closed").isNotNull() & (F.col("opened").isNull() | (F.col("closed") > F.col("opened")))
    return sums.select(user, F.when(shut, "cancelled").otherwise(F.coalesce("last", F.lit("none"))).alias("state"))


def windows_of(rows: DataFrame, key: str, n: str, width: int = 4, overlap: int = 1) -> DataFrame:
    """key, first, end: windows of width over 0..n-1 that share overlap places; the last is cut at n."""
    step = width - overlap
    starts = F.expr(f"sequence(0, greatest(0, ({n} - {overlap} - 1) div {step} * {step}), {step})")
    return rows.filter(F.col(n) > 0).select(key, n, F.explode(starts).alias("first")).select(key, F.col("first").cast("long").alias("first"), F.least(F.col("first") + width, F.col(n)).cast("long").alias("end"))


def share_windows(rows: DataFrame, key: str, order: list[str], width: int) -> DataFrame:
    """rows with first and after: the window of width places of their group that lies as far along as the row does."""
    by = Window.partitionBy(key)
    n, item = F.count("*").over(by), F.row_number().over(by.orderBy(*order)) - 1
    out = rows.withColumns({"_n": n, "_i": item})
    first = F.least(F.greatest(F.lit(0), F.col("_n") - width), F.floor(F.col("_i") * F.greatest(F.lit(1), F.col("_n") - width + 1) / F.col("_n"))).cast("long")
    return out.withColumn("first", first).withColumn("after", F.least(F.col("_n"), F.col("first") + width).cast("long")).drop("_n", "_i")


def supply_grade(n: Column, section: int) -> Column:
    """absent, thin, adequate from three times a section's questions on, ample from ten times."""
    return F.when(n == 0, "absent").when(n < 3 * section, "thin").when(n < 10 * section, "adequate").otherwise("ample")


def seed_states(tables: dict, expected: dict) -> DataFrame:
    """name, state (ok, rows, content, absent) of each expected table: (rows, allowed values of its figure)."""
    parts = []
    for name, (rows, figures) in expected.items():
        if name in tables:
            df, figure = tables[name]
            state = F.when(F.count("*") != rows, "rows").when(~figure.isin(*figures), "content").otherwise("ok")
            parts.append(df.agg(state.alias("state")).select(F.lit(name).alias("name"), "state"))
        else:
            some = next(iter(tables.values()))[0]
            parts.append(some.agg(F.lit("absent").alias("state")).select(F.lit(name).alias("name"), "state"))
    return reduce(DataFrame.unionByName, parts)


def exhaustion_tier(count: Column, miss: Column, mastery: Column) -> Column:
    """What to do as a bank of items runs out; the first rule that holds counts."""
    return F.when(count == 0, "explainer").when(miss > 0.95, "llm").when((mastery >= 0.85) & (count <= 3), "bridge").when(count <= 5, "escalate").when(count <= 10, "resample").otherwise("serve")


def review_interval(mastery: Column, days: list[int]) -> Column:
    """Days until an item comes again, by half of its mastery level."""
    return F.element_at(F.array(*map(F.lit, days)), F.least(F.floor(mastery / 2), F.lit(len(days) - 1)).cast("int") + 1)


def due_reviews(rows: DataFrame, mastery: str, idle_days: str, days: list[int]) -> DataFrame:
    """The rows that are to come again: idle for as many days as their mastery asks for. Null mastery counts as 0, null idle days are never due."""
    return rows.filter(F.coalesce(F.col(idle_days) >= review_interval(F.coalesce(F.col(mastery), F.lit(0)), days), F.lit(False)))


def public_questions(rows: DataFrame, private: tuple[str, ...] = ("answer_key", "correct_answer", "answer", "solution", "key_source")) -> DataFrame:
    """rows without what gives an answer away, at the top and within struct columns and arrays of structs."""
    kept = []
    for f in rows.schema.fields:
        if f.name in private:
            continue
        kind = f.dataType
        if isinstance(kind, StructType):
            kept.append(F.col(f.name).dropFields(*inner).alias(f.name) if (inner := [x for x in kind.names if x in private]) and len(inner) < len(kind.names) else F.col(f.name))
        elif isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType) and (inner := [x for x in kind.elementType.names if x in private]) and len(inner) < len(kind.elementType.names):
            kept.append(F.transform(f.name, lambda x, inner=inner: x.dropFields(*inner)).alias(f.name))
        else:
            kept.append(F.col(f.name))
    return rows.select(*kept)


def verification(status: Column, verified: tuple[str, ...] = ("verified", "answer_verified", "verified_L1", "verified_L2")) -> Column:
    """struct(answer, solution): what was checked of each, two columns so that none is read as the other; solutions are not
    checked by anything that a status tells."""
    return F.struct(F.when(status.isin(*verified), "verified").otherwise(F.coalesce(F.nullif(status, F.lit("")), F.lit("unverified"))).alias("answer_verification"), F.lit("unverified").alias("solution_verification"))


def progress_views(progress: DataFrame, user: str, item: str, params: str, now: Column, days: int = 7) -> dict[str, DataFrame]:
    """done (user, item: mastered, or right three times and never wrong), recent (user, item: seen in the last days), params (user, params
    once each, of what was seen then). progress: mastered, right, wrong, seen_at. A null seen_at is long ago."""
    fresh = F.coalesce(F.col("seen_at") > now - F.make_dt_interval(days=F.lit(days)), F.lit(False))
    done = F.coalesce(F.col("mastered"), F.lit(False)) | F.coalesce((F.col("right") >= 3) & (F.col("wrong") == 0), F.lit(False))
    return {"done": progress.filter(done).select(user, item), "recent": progress.filter(fresh).select(user, item), "params": progress.filter(fresh).select(user, params).distinct()}


def nearest_partner(players: DataFrame, group: str, key: str, score: str, band: float) -> DataFrame:
    """key, partner: the player of the group next by score within the band, the lower one
    of two as near. Neighbours in order hold it, so no pairs are made."""
    order = Window.partitionBy(group).orderBy(score, key)
    side = lambda f: f(F.struct(F.col(score).alias("s"), F.col(key).alias("k"))).over(order)
    rows = players.select(group, key, score, side(F.lag).alias("low"), side(F.lead).alias("high"))
    down, up = F.col(score) - F.col("low.s"), F.col("high.s") - F.col(score)
    pick = F.when((down <= band) & (up.isNull() | (down <= up)), F.col("low.k")).when(up <= band, F.col("high.k"))
    return rows.select(key, pick.alias("partner"))


def resolve_chains(moves: DataFrame, source: str, target: str, rounds: int = 30) -> DataFrame:
    """source, target with every target followed to its end: each round doubles the length
    of the hops, so the rounds grow with the logarithm of the longest chain. Members of a
    circle keep a target within it. Each round's table cuts the lineage."""
    hops = moves.select(source, target).dropDuplicates([source])
    for _ in range(rounds):
        ends = hops.select(F.col(source).alias(target), F.col(target).alias("_next"))
        joined = hops.join(ends, target, "left").select(source, F.coalesce("_next", target).alias("_to"), F.col("_next").isNotNull().alias("_moved"))
        joined = cut(joined)
        hops = joined.select(source, F.col("_to").alias(target))
        if not joined.filter("_moved").take(1):
            break
    return hops


def fingerprint(rows: DataFrame, label: str, key: Column) -> DataFrame:
    """label, n, print: census by label; the print is a sum of key hashes, the same in any order."""
    return rows.groupBy(label).agg(F.count("*").alias("n"), F.sum(F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")).alias("print"))


def remap_matrix(matrix: DataFrame, skill: str, item: str, survivors: DataFrame, structural: DataFrame) -> DataFrame:
    """skill, item once each, merged skills(loser, survivor) renamed, structural ones left out."""
    moved = matrix.select(skill, item).join(survivors.select(F.col("loser").alias(skill), "survivor"), skill, "left").select(F.coalesce("survivor", skill).alias(skill), item)
    return moved.join(structural.select(skill), skill, "left_anti").distinct()

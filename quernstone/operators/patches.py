"""Patches of question records: what is wrong with one before it is applied, what it does, and whether it kept the words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions import norm

#: What a patch may do to a record (number `*`) and to a question.
RECORD_ACTIONS = ["directions", "record_tags", "clear_chart_flag"]
QUESTION_ACTIONS = ["key", "correct_key", "options", "options_check", "clear_needs_vision", "difficulty", "format", "flag", "suspect"]
#: Those that only fill in what is empty.
FILLS = {"key": "answer_key", "options": "options", "difficulty": "difficulty", "format": "question_format"}

# patches: set_id, number, action, at (order), source, reason and, as the action needs: answer_key, options, difficulty,
# question_format, directions, tags. questions: set_id, number, answer_key, key_source, options, difficulty, question_format,
# extra (a map of texts). records: set_id, directions, tags, extra.


def _blank(c: str | Column) -> Column:
    return F.coalesce(F.trim(F.col(c) if isinstance(c, str) else c), F.lit("")) == ""


def _empty(c: str) -> Column:
    return F.coalesce(F.size(c), F.lit(0)) == 0


def verified(patches: DataFrame, questions: DataFrame, records: DataFrame) -> DataFrame:
    """patches with faults (none: it may be applied) and replay: whether it says what is there already, which is no fault.

    Faults: no_target, unknown_action, no_such_record, no_such_question, several_patches (of one field; all of them),
    conflict (another value is there, and the action only fills in), no_value, no_source, no_reason, short_options, bad_difficulty,
    flagged_question (options for one whose text or key is doubted), concepts_changed (tags that are not the same set but for
    their spelling), nothing_to_clear. Null set_id, number or action is no_target."""
    q = questions.groupBy("set_id", "number").agg(F.first(F.struct("answer_key", "options", "difficulty", "question_format", "extra")).alias("_q"))
    r = records.groupBy("set_id").agg(F.first(F.struct("directions", "tags", "extra")).alias("_r"))
    p = patches.join(q, ["set_id", "number"], "left").join(r, "set_id", "left")
    p = p.withColumn("_n", F.count("*").over(Window.partitionBy("set_id", "number", "action")))
    action, whole = F.col("action"), F.col("number") == "*"
    on = lambda *names: action.isin(*names)
    kinds = F.when(whole, on(*RECORD_ACTIONS)).otherwise(on(*QUESTION_ACTIONS))
    target = F.col("set_id").isNull() | F.col("number").isNull() | action.isNull()
    record, question = F.col("_r").isNotNull(), F.col("_q").isNotNull()
    have = {
        "key": (~_blank("_q.answer_key"), F.trim("_q.answer_key") == F.trim("answer_key")),
        "options": (~_empty("_q.options"), F.col("_q.options") == F.col("options")),
        "difficulty": (F.col("_q.difficulty").isNotNull(), F.col("_q.difficulty") == F.col("difficulty")),
        "format": (~_blank("_q.question_format") & (F.col("_q.question_format") != "unclassified"), F.col("_q.question_format") == F.col("question_format")),
        "directions": (~_blank("_r.directions"), F.col("_r.directions") == F.col("directions")),
        "correct_key": (F.lit(False), F.col("_q.answer_key") == F.col("answer_key")),
    }
    there = F.coalesce(*[F.when(on(a), x) for a, (x, _) in have.items()], F.lit(False))
    same = F.coalesce(*[F.when(on(a), F.coalesce(x, F.lit(False))) for a, (_, x) in have.items()], F.lit(False))
    value = (
        F.when(on("key", "correct_key"), _blank("answer_key")).when(on("options"), _empty("options")).when(on("difficulty"), F.col("difficulty").isNull())
        .when(on("format"), _blank("question_format")).when(on("directions"), _blank("directions")).when(on("record_tags"), _empty("tags")).otherwise(False)
    )
    keys = lambda c: F.array_sort(F.array_distinct(F.transform(F.coalesce(c, F.array().cast("array<string>")), norm)))
    flag = lambda name: F.coalesce(F.col("_q.extra")[name], F.lit("")) != ""
    faults = {
        "no_target": target,
        "unknown_action": ~target & ~kinds,
        "no_such_record": ~target & ~record,
        "no_such_question": ~target & record & ~whole & ~question,
        "several_patches": ~target & (F.col("_n") > 1),
        "conflict": there & ~same,
        "no_value": value,
        "no_source": on("key", "correct_key", "options", "difficulty", "format", "directions", "record_tags") & _blank("source"),
        "no_reason": on("correct_key", "options_check", "clear_needs_vision", "clear_chart_flag", "flag", "suspect") & _blank("reason"),
        "short_options": on("options") & (F.size("options") == 1),
        "bad_difficulty": on("difficulty") & ~F.col("difficulty").between(1, 5),
        "flagged_question": on("options") & (flag("needs_reextraction") | flag("key_suspect")),
        "concepts_changed": on("record_tags") & record & (keys(F.col("_r.tags")) != keys(F.col("tags"))),
        "nothing_to_clear": F.when(on("clear_needs_vision"), ~flag("needs_vision")).when(on("clear_chart_flag"), F.coalesce(F.col("_r.extra")["needs_chart_vision"], F.lit("")) == "").otherwise(False),
    }
    told = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in faults.items()]))
    return p.select(*patches.columns, told.alias("faults"), (same & there | on("correct_key") & same).alias("replay"))


def applied(questions: DataFrame, records: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(questions, records) after patches: of each target and action the last by at. What only fills in never takes the place of what is
    there; a corrected key leaves the old one and the reason in extra; flags and checks go to extra. Patches without a fault change nothing a second time."""
    last = patches.filter("set_id is not null and number is not null and action is not null").groupBy("set_id", "number", "action").agg(F.max_by(F.struct(*[c for c in patches.columns if c not in ("set_id", "number", "action")]), "at").alias("p"))
    by_target = last.groupBy("set_id", "number").agg(F.map_from_entries(F.collect_list(F.struct("action", "p"))).alias("_p"))  # at most one an action
    p = lambda action: F.col("_p")[action]
    q = questions.join(by_target.filter("number != '*'"), ["set_id", "number"], "left")
    fill = lambda action, field, empty: F.when(p(action).isNotNull() & empty, p(action)[field])
    fix = p("correct_key").isNotNull() & ~F.col("answer_key").eqNullSafe(p("correct_key")["answer_key"])
    filled = {"key": _blank("answer_key"), "options": _empty("options"), "difficulty": F.col("difficulty").isNull(), "format": _blank("question_format") | (F.col("question_format") == "unclassified")}
    new = {FILLS[a]: F.coalesce(fill(a, FILLS[a], empty), F.col(FILLS[a])) for a, empty in filled.items()}
    new["answer_key"] = F.when(fix, p("correct_key")["answer_key"]).otherwise(new["answer_key"])
    new["key_source"] = F.when(fix, p("correct_key")["source"]).otherwise(F.coalesce(fill("key", "source", filled["key"]), F.col("key_source")))
    clears = p("clear_needs_vision").isNotNull() & (F.coalesce(F.col("extra")["needs_vision"], F.lit("")) != "")
    notes = {
        "needs_reextraction": F.when(p("flag").isNotNull(), p("flag")["reason"]),
        "key_suspect": F.when(p("suspect").isNotNull(), p("suspect")["reason"]),
        "key_superseded": F.when(fix, F.concat_ws(": ", F.coalesce("answer_key", F.lit("")), p("correct_key")["reason"])),
        "options_check": F.when(p("options_check").isNotNull(), p("options_check")["reason"]),
        "options_source": fill("options", "source", filled["options"]),
        "difficulty_source": fill("difficulty", "source", filled["difficulty"]),
        "format_source": fill("format", "source", filled["format"]),
        "needs_vision": F.when(clears, ""),
        "needs_vision_resolution": F.when(clears, p("clear_needs_vision")["reason"]),
    }
    new["extra"] = _noted("extra", notes)
    r = records.join(by_target.filter("number = '*'").drop("number"), "set_id", "left")
    chart = p("clear_chart_flag").isNotNull() & (F.coalesce(F.col("extra")["needs_chart_vision"], F.lit("")) != "")
    told = {
        "tags_source": F.when(p("record_tags").isNotNull(), p("record_tags")["source"]),
        "directions_source": fill("directions", "source", _blank("directions")),
        "needs_chart_vision": F.when(chart, ""),
        "chart_vision_resolution": F.when(chart, p("clear_chart_flag")["reason"]),
    }
    changed = {"tags": F.coalesce(F.when(p("record_tags").isNotNull(), p("record_tags")["tags"]), F.col("tags")), "directions": F.coalesce(fill("directions", "directions", _blank("directions")), F.col("directions")), "extra": _noted("extra", told)}
    return q.withColumns(new).select(*questions.columns), r.withColumns(changed).select(*records.columns)


def _noted(extra: str, notes: dict[str, Column]) -> Column:
    """The map with the notes that there are, in place of older ones of their names."""
    told = F.map_filter(F.create_map(*[x for name, value in notes.items() for x in (F.lit(name), value)]), lambda _, v: v.isNotNull())
    kept = F.map_filter(F.coalesce(F.col(extra), F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key(told, k))
    return F.when(F.size(told) == 0, F.col(extra)).otherwise(F.map_concat(kept, told))


def off_reference(rewrites: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """keys, tokens, foreign, rate: of each rewritten text (keys, text) how many words its reference (keys, text; several rows are one)
    lacks, as multisets: a word that is written more often than the reference has it is foreign that many times.
    Rewrites without words or without a reference give no row."""
    tokens = lambda df: df.select(*keys, F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), 1)).alias("token")).groupBy(*keys, "token").agg(F.count("*").alias("n"))
    mine, theirs = tokens(rewrites), tokens(reference)
    both = mine.join(theirs.withColumnRenamed("n", "m"), [*keys, "token"], "left").join(theirs.select(*keys).distinct(), keys, "left_semi")
    out = both.groupBy(*keys).agg(F.sum("n").alias("tokens"), F.sum(F.greatest(F.lit(0), F.col("n") - F.coalesce("m", F.lit(0)))).alias("foreign"))
    return out.withColumn("rate", F.col("foreign") / F.col("tokens"))

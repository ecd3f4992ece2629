"""Question banks: scans for damage, verdicts, schema checks, exports, patches, pools, hints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions import answers, content_words
from quernstone.lineage import cut, dealt

# Steps: template, example, step, operation, result, description. Examples: template, example, problem, answer.


def tidy(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), r"\s+", " "))


def false_root_claims(steps: DataFrame, examples: DataFrame) -> DataFrame:
    """template, example, claimed, constant: a first step says that a number is a root, but the answer's polynomial
    has another constant term than 0."""
    first = steps.groupBy("template", "example").agg(F.min_by(F.concat_ws(" ", "description", "result"), "step").alias("text"))
    # How a step claims a root.
    claim = r"(?i)(-?\d+)\s+is a root|since\s+(-?\d+)\s+is\s+a\s+root"
    rows = first.join(examples, ["template", "example"]).withColumn("claimed", F.coalesce(*[F.regexp_extract("text", claim, g).try_cast("bigint") for g in (1, 2)]))
    rows = rows.withColumn("constant", F.when(F.trim("answer").rlike(r"^\s*[a-z]\s*\^?\s*\d"), answers.constant_term(F.trim("answer"))))
    return rows.filter("claimed is not null and constant != 0").select("template", "example", "claimed", "constant")


def orphan_continuations(steps: DataFrame) -> DataFrame:
    """template, example whose first step goes on with something that came nowhere before."""
    # How a step goes on with another.
    words = r"(?i)^\s*(continue|continuing|repeat|again|then|second|third|final(ly)?|remaining)\b|\b(second|third|final)\s+(pass|iteration|division|round)\b"
    first = steps.groupBy("template", "example").agg(F.min_by("description", "step").alias("d"))
    return first.filter(F.trim("d").rlike(words)).select("template", "example")


def shared_step_prose(steps: DataFrame, topics: DataFrame) -> DataFrame:
    """hash, templates, topics: a sequence of three described steps or more that templates of different topics
    have word for word. topics: template, topic."""
    prose = steps.groupBy("template", "example").agg(F.array_sort(F.collect_list(F.struct("step", F.trim(F.coalesce("description", F.lit(""))).alias("d"))))["d"].alias("ds"))
    keyed = prose.filter(F.size(F.filter("ds", lambda d: d != "")) >= 3).select("template", F.sha2(F.array_join("ds", "|"), 256).alias("hash"))
    return keyed.join(topics, "template").groupBy("hash").agg(F.count_distinct("template").alias("templates"), F.count_distinct("topic").alias("topics")).filter("topics > 1")


def bleeds(steps: DataFrame, examples: DataFrame, least: int = 12) -> DataFrame:
    """template, example, step, source: results of least letters or more that another example of the template owns (as
    a result or answer) and that are not this one's answer; source is the first such example.

    Owners are counted by template and value before the join, so a value's rows meet two minima and not each other.
    """
    results = steps.select("template", "example", "step", tidy("result").alias("value"))
    owned = results.select("template", "example", "value").union(examples.select("template", "example", tidy("answer"))).filter(F.length("value") >= least).distinct()
    first = owned.groupBy("template", "value").agg(F.min("example").alias("a"))
    second = owned.join(first, ["template", "value"]).filter("example > a").groupBy("template", "value").agg(F.min("example").alias("b"))
    rows = results.filter(F.length("value") >= least).join(examples.select("template", "example", tidy("answer").alias("own")), ["template", "example"], "left").filter("own is null or value != own")
    found = rows.join(first, ["template", "value"]).join(second, ["template", "value"], "left").withColumn("source", F.when(F.col("a") != F.col("example"), F.col("a")).otherwise(F.col("b")))
    return found.filter("source is not null").select("template", "example", "step", "source")


def misaligned_steps(steps: DataFrame, examples: DataFrame) -> DataFrame:
    """template, example, step, signature: sibling_carryover (two words or more of a description stand in another example
    only), no_overlap (none stands in its own step or example), desc_duplicated (a long description stands over operations
    that share no word with the first one's). Word sets are arrays by example; a template's examples are few."""
    words = lambda *cs: F.array_distinct(F.concat(*[content_words(F.coalesce(F.col(c), F.lit(""))) for c in cs]))
    t = F.trim("description")
    rows = cut(steps.select("template", "example", "step", words("description").alias("d"), words("operation", "result").alias("s"), F.when(F.length(t) >= 40, F.struct(t.alias("t"), words("operation").alias("o"))).alias("long")))
    own = rows.groupBy("template", "example").agg(F.array_distinct(F.flatten(F.collect_list("s"))).alias("w"))
    own = own.join(examples.select("template", "example", words("problem", "answer").alias("v")), ["template", "example"], "left")
    own = own.select("template", "example", F.array_distinct(F.concat("w", F.coalesce("v", F.array().cast("array<string>")))).alias("own"))
    others = own.withColumn("all", F.collect_list(F.struct("example", "own")).over(Window.partitionBy("template")))
    context = others.select("template", "example", "own", F.array_distinct(F.flatten(F.transform(F.filter("all", lambda x: x["example"] != F.col("example")), lambda x: x["own"]))).alias("siblings"))
    met = rows.select("template", "example", "step", "d", "s").filter(F.size("d") > 0).join(context, ["template", "example"])
    foreign = F.array_intersect(F.array_except("d", "own"), "siblings")
    apart = (F.size("s") > 0) & ~F.arrays_overlap("d", "s") & ~F.arrays_overlap("d", "own")
    signed = met.withColumn("signature", F.explode(F.array_compact(F.array(F.when(F.size(foreign) >= 2, "sibling_carryover"), F.when(apart, "no_overlap"))))).select("template", "example", "step", "signature")
    long = rows.select("template", "example", "step", "long.*").filter(F.size("o") > 0)
    head = long.groupBy("template", "t").agg(F.min_by("o", F.struct("example", "step")).alias("h"))
    return signed.unionByName(long.join(head, ["template", "t"]).filter(~F.arrays_overlap("o", "h")).select("template", "example", "step", F.lit("desc_duplicated").alias("signature")))


def verdict_faults(panel: Column, kind: Column, target: Column, backend: Column, rule: Column, result: Column, checks: Column) -> Column:
    """Why a verdict can't be taken, empty if it can: panel is an array of struct(lens, verdict); the result is
    computed anew from the votes. A null panel has no members."""
    size = F.coalesce(F.size(panel), F.lit(0))
    lenses, votes = (F.coalesce(F.transform(panel, lambda p: p[name]), F.array().cast("array<string>")) for name in ("lens", "verdict"))
    need = F.coalesce(F.regexp_extract(rule, r"^(\d+)_", 1).try_cast("int"), F.lit(2))
    computed = F.when(F.size(F.filter(votes, lambda v: v == "pass")) >= need, "pass").otherwise("fail")
    faults = [
        (~F.coalesce(kind.isin("pattern", "template", "item"), F.lit(False)), "target_kind"),
        (F.coalesce(target, F.lit("")) == "", "target_id"),
        (F.coalesce(backend, F.lit("")) == "", "judge_backend"),
        (size < 3, "panel_size"),
        (F.size(F.array_distinct(lenses)) != F.size(lenses), "duplicate_lenses"),
        (F.exists(lenses, lambda x: F.coalesce(x, F.lit("")) == ""), "unnamed_lens"),
        (F.exists(votes, lambda v: ~F.coalesce(v.isin("pass", "fail"), F.lit(False))), "vote"),
        (~result.eqNullSafe(computed), "result"),
        ((kind == "pattern") & (F.coalesce(F.size(checks), F.lit(0)) <= 0), "spot_checks"),
    ]
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for bad, name in faults]))


def template_faults(t: Column) -> Column:
    """Violations of the template schema, with the place of each in its examples and steps."""
    missing = lambda c: F.coalesce(c, F.lit("")) == ""
    at = lambda text, *parts: F.format_string(text, *parts)
    top = [
        (missing(t["id"]), "id"),
        (missing(t["domain"]), "domain"),
        (missing(t["technique"]), "concept.technique_name"),
        (~F.coalesce(t["difficulty"].between(1, 5), F.lit(False)), "difficulty"),
        (~F.coalesce(t["expected_time"] > 0, F.lit(False)), "expected_time"),
        (F.coalesce(F.size(t["examples"]), F.lit(0)) < 1, "examples"),
        (~F.coalesce(t["version"] > 0, F.lit(False)), "version"),
    ]
    step = lambda s, i, j: F.array_compact(F.array(F.when(~F.coalesce(s["step_num"] > 0, F.lit(False)), at("examples[%d].solution[%d].step_num", i, j)), F.when(missing(s["operation"]), at("examples[%d].solution[%d].operation", i, j))))
    example = lambda e, i: F.concat(
        F.array_compact(F.array(F.when(missing(e["problem"]), at("examples[%d].problem_statement", i)), F.when(F.coalesce(F.size(e["solution"]), F.lit(0)) < 1, at("examples[%d].solution", i)))),
        F.flatten(F.transform(F.coalesce(e["solution"], F.array().cast("array<struct<step_num:int,operation:string>>")), lambda s, j: step(s, i, j))),
    )
    inner = F.flatten(F.transform(t["examples"], example))
    return F.concat(F.array_compact(F.array(*[F.when(bad, F.lit(name)) for bad, name in top])), F.coalesce(inner, F.array().cast("array<string>")))


def export_questions(sets: DataFrame) -> DataFrame:
    """question_id, number, blockers, playable, provenance of every question of the sets(set_id, questions): a number that
    comes twice in a set is told apart by its place, and none of its questions is playable."""
    q = sets.select("set_id", F.posexplode("questions").alias("at", "q")).select("set_id", "at", "q.*")
    same = Window.partitionBy("set_id", "number")
    q = q.withColumn("n", F.count("*").over(same)).withColumn("i", F.row_number().over(same.orderBy("at")))
    optioned = F.col("format").isin("multiple_choice", "multi_select", "quantitative_comparison", "text_completion", "select_in_passage")
    reasons = {
        "duplicate_question_number": F.col("n") > 1,
        "no_answer_key": F.coalesce("answer_key", F.lit("")) == "",
        "format_unclassified": F.coalesce("format", F.lit("unclassified")) == "unclassified",
        "format_options_are_images": F.col("format") == "options_are_images",
        "option_format_without_options": optioned & (F.coalesce(F.size("options"), F.lit(0)) < 2),
        "text_too_short": F.length(F.trim(F.coalesce("text", F.lit("")))) < 12,
    }
    blockers = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in reasons.items()], F.when(F.col("errata").isNotNull(), F.concat(F.lit("errata_"), answers.errata_code(F.col("errata"))))))
    name = F.concat_ws("#", "set_id", F.concat("number", F.when(F.col("i") > 1, F.concat(F.lit("~"), F.col("i").cast("string"))).otherwise("")))
    return q.select(name.alias("question_id"), "number", blockers.alias("blockers"), (F.size(blockers) == 0).alias("playable"), answers.key_provenance(F.col("key_source"), F.col("answer_key")).alias("provenance"))


def pool_verdicts(questions: DataFrame, rules: DataFrame, chapter: Column, off_syllabus: str) -> DataFrame:
    """question_id, pool, why: the pool of the question's book and why it is left out of it, null if it is in.
    rules: book, pool, wants_options."""
    q = questions.join(rules, "book", "left")
    resolved = answers.option_of_key(F.col("answer_key"), F.col("options"))
    why = (
        F.when(F.col("pool").isNull(), "no_pool")
        .when(chapter.rlike(off_syllabus), "off_syllabus")
        .when(~F.col("wants_options"), None)
        .when(answers.degenerate_options(F.col("options")).isNotNull(), answers.degenerate_options(F.col("options")))
        .when(resolved["option"].isNull(), resolved["how"])
    )
    return q.select("question_id", "pool", why.alias("why"))


#: What a patch may do, and the fields that each action sets.
PATCH_ACTIONS = {"set_key": "answer_key", "clear_key": "answer_key", "set_options": "options"}


def pool_counters(verdicts: DataFrame) -> DataFrame:
    """pool, why, n of `pool_verdicts`: how many questions a pool holds (null why) and has left out for each reason."""
    return verdicts.groupBy("pool", "why").agg(F.count("*").alias("n"))


def exported(questions: DataFrame, topics: DataFrame, mappings: DataFrame) -> DataFrame:
    """questions (of `export_questions`) with topic: the taxonomy's name of the question's own label, null where it has none or that
    was declined. topics: question_id, label; mappings: label, to. A question with several labels takes the first that leads somewhere."""
    named = topics.join(mappings.select("label", "to"), "label").filter("to is not null").groupBy("question_id").agg(F.min_by("to", "label").alias("topic"))
    return questions.join(named, "question_id", "left")


def export_manifest(rows: DataFrame) -> DataFrame:
    """questions, playable, resolved (playable with a topic), and each blocker with how many it blocks (a map)."""
    whole = rows.agg(F.count("*").alias("questions"), F.count_if("playable").alias("playable"), F.count_if(F.col("playable") & F.col("topic").isNotNull()).alias("resolved"))
    blockers = rows.select(F.explode("blockers").alias("b")).groupBy("b").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("b", "n")))).alias("blocked"))
    return whole.join(blockers)


def patch_faults(patches: DataFrame, questions: DataFrame) -> DataFrame:
    """set_id, number, action, faults of every patch: an unknown action, no reason, no such question, several patches of one
    field, and a new key that names no option."""
    same = F.count("*").over(Window.partitionBy("set_id", "number", "action"))
    known = questions.select("set_id", "number", F.lit(True).alias("_known"), F.col("options").alias("_options"))
    known = known.dropDuplicates(["set_id", "number"])
    p = dealt(patches, patches.count(), "set_id", "number").withColumn("_n", same).join(known, ["set_id", "number"], "left")
    key = answers.option_of_key(F.col("value"), F.col("_options"))
    faults = {
        "unknown_action": ~F.col("action").isin(*PATCH_ACTIONS),
        "no_reason": F.coalesce("reason", F.lit("")) == "",
        "no_such_question": F.col("_known").isNull(),
        "several_patches": F.col("_n") > 1,
        "key_names_no_option": F.coalesce((F.col("action") == "set_key") & (F.size("_options") > 1) & key["option"].isNull(), F.lit(False)),
    }
    return p.select("set_id", "number", "action", F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in faults.items()])).alias("faults"))


def patched(questions: DataFrame, patches: DataFrame) -> DataFrame:
    """questions with the keys that patches set (set_key) or take away (clear_key); each question by (set_id, number)."""
    keys = patches.filter(F.col("action").isin("set_key", "clear_key")).groupBy("set_id", "number").agg(F.max_by(F.struct("action", "value"), "at").alias("_p"))
    out = questions.join(keys, ["set_id", "number"], "left")
    key = F.when(F.col("_p.action") == "set_key", F.col("_p.value")).when(F.col("_p.action") == "clear_key", None).otherwise(F.col("answer_key"))
    return out.withColumn("answer_key", key).select(*questions.columns)


def preserved(before: DataFrame, after: DataFrame, keys: list[str], may_change: str) -> DataFrame:
    """keys, what of rows that a patch has lost, made up, or changed in other columns than may_change."""
    rest = [c for c in before.columns if c not in (*keys, may_change)]
    print_ = F.sha2(F.to_json(F.struct(*rest)), 256)
    both = before.select(*keys, print_.alias("_a")).join(after.select(*keys, print_.alias("_b")), keys, "full_outer")
    what = F.when(F.col("_b").isNull(), "lost").when(F.col("_a").isNull(), "made_up").when(F.col("_a") != F.col("_b"), "changed")
    return both.withColumn("what", what).filter("what is not null").select(*keys, "what")


def usable_hints(steps: DataFrame, key: str, order: str, number: str, text: str, answer: str | None = None) -> DataFrame:
    """key, hints (in order), levels: a list of steps holds several worked examples, told apart where the number does not
    rise; the last step of each states its answer and is left out. With answer, a column that holds the answer's key, every step
    that states it in any of its forms is left out too. levels: one more than the hints, five at most. Steps without a number go on
    with their example; null steps are none."""
    by = Window.partitionBy(key).orderBy(order)
    rows = steps.withColumn("_falls", F.coalesce(F.col(number) <= F.lag(number).over(by), F.lit(False)).cast("int"))
    rows = rows.withColumn("_part", F.sum("_falls").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_last", F.lead("_part").over(by).isNull() | (F.lead("_part").over(by) > F.col("_part")))
    shown = ~F.col("_last") & F.col(text).isNotNull()
    if answer:
        shown = shown & ~answers.states_any(F.col(text), answers.answer_forms(answer))
    hints = F.transform(F.array_sort(F.collect_list(F.when(shown, F.struct(order, text)))), lambda x: x[text])
    return rows.groupBy(key).agg(hints.alias("hints")).withColumn("levels", F.least(F.lit(5), F.size("hints") + 1))


def completeness(parts: dict[str, tuple[Column, float]], verified: Column) -> Column:
    """Sum of the weights of what is there, 0.05 more for verified rows, 1 at most."""
    total = F.lit(0.0)
    for there, weight in parts.values():
        total = total + F.when(F.coalesce(there, F.lit(False)), weight).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), total + F.when(verified, 0.05).otherwise(0.0)), 2)


def first_pattern(rows: DataFrame, text: str, patterns: list[tuple[int, str, str]]) -> DataFrame:
    """rows with pattern: of a library (priority, name, expression) the first by priority that matches."""
    ordered = sorted(patterns)
    return rows.withColumn("pattern", F.coalesce(*[F.when(F.col(text).rlike(expression), F.lit(name)) for _, name, expression in ordered]))

"""Documents of unknown shape: JSON text as VARIANT, steps and templates read from whatever they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions import expected_seconds
from quernstone.functions.answers import bound


def _text(v: Column, *paths: str) -> Column:
    """The first of the paths that holds a text that isn't empty."""
    return F.coalesce(*[F.nullif(F.try_variant_get(v, p, "string"), F.lit("")) for p in paths])


def items(v: Column) -> Column:
    """A VARIANT's elements; null if it is no list."""
    return F.try_variant_get(v, "$", "array<variant>")


def array_length(raw: Column) -> Column:
    """How many elements a JSON list has; null for anything else."""
    return bound(items(F.try_parse_json(raw)), lambda a: F.when(a.isNotNull(), F.size(a)))


def same_value(a: Column, b: Column) -> Column:
    """Whether two JSON texts say the same, whatever their spaces and the order of their keys; false if either is no JSON
    and the other is, null if neither is."""
    left, right = (F.to_json(F.try_parse_json(x)) for x in (a, b))
    return F.when(left.isNull() & right.isNull(), None).otherwise(left.eqNullSafe(right))


def steps_of(raw: Column) -> Column:
    """array of struct(number, text): steps from JSON text that is a list, an object with `steps`, or no JSON at all, which is
    one step. An element is a text or an object with operation, text or description, and step_num or step (0 without).
    Empty ones are left out; null, and JSON of another kind, has no steps."""

    def step(x: Column) -> Column:
        isobject = F.startswith(F.schema_of_variant(x), F.lit("OBJECT"))
        number = F.coalesce(*[F.try_variant_get(x, f"$.{k}", "string").try_cast("int") for k in ("step_num", "step")], F.lit(0))
        text = F.when(isobject, _text(x, "$.operation", "$.text", "$.description")).otherwise(F.try_variant_get(x, "$", "string"))
        return F.struct(F.when(isobject, number).otherwise(0).alias("number"), F.trim(F.coalesce(text, F.lit(""))).alias("text"))

    def of(v: Column) -> Column:
        listed = F.coalesce(items(v), F.try_variant_get(v, "$.steps", "array<variant>"))
        return F.coalesce(F.filter(F.transform(listed, step), lambda s: s["text"] != ""), none)

    none = F.array().cast("array<struct<number:int,text:string>>")
    whole = F.when(F.trim(raw) != "", F.array(F.struct(F.lit(0).alias("number"), F.trim(raw).alias("text")))).otherwise(none)
    return F.when(raw.isNull(), none).otherwise(bound(F.try_parse_json(raw), lambda v: F.when(v.isNull(), whole).otherwise(of(v))))


#: Scaffolds that a page can show.
SCAFFOLDS = ["textual_scaffold", "number_line", "area_model", "bar_model", "grid", "graph", "table", "venn", "geometry"]


def adapted(records: DataFrame, raw: str, overrides: DataFrame | None = None, defects: DataFrame | None = None) -> DataFrame:
    """records with id, technique, category, difficulty, scaffold, examples (problem, answer, steps), expected_time, repairs, quarantine,
    trust, read from raw, the JSON text of a template in any shape.

    Repairs: a technique taken from the topic, a difficulty above 5 taken as 5, a scaffold from overrides(id, scaffold) or a
    textual one where there is none. Quarantine reasons: not_json, no_technique, difficulty, empty_problem, empty_solution,
    no_examples, flagged (by an earlier validation) and defect:<name> from defects(id, defect). trust: quarantined with any of
    these, trusted_candidate if verified and without repairs, else sandbox_candidate. The two small
    tables are joined by id; a null id joins with neither."""
    v = F.try_parse_json(raw)
    rows = records.withColumn("_v", v).withColumn("id", F.try_variant_get("_v", "$.template_id", "string"))
    for table, name in ((overrides, "scaffold"), (defects, "defect")):
        extra = f"_{name}"
        rows = rows.withColumn(extra, F.lit(None).cast("string")) if table is None else rows.join(table.groupBy("id").agg(F.min(name).alias(extra)), "id", "left")
    v = F.col("_v")
    named, topic = _text(v, "$.concept.technique_name"), _text(v, "$.concept.sub_topic")
    level = F.try_variant_get(v, "$.difficulty", "int")
    own = F.try_variant_get(v, "$.visual_scaffold.type", "string")
    own = F.when(own.isin(*SCAFFOLDS), own)
    given = F.when(F.col("_scaffold").isin(*SCAFFOLDS), F.col("_scaffold"))
    listed = F.coalesce(F.try_variant_get(v, "$.examples", "array<variant>"), F.array().cast("array<variant>"))
    example = lambda e: F.struct(
        _text(e, "$.problem_statement").alias("problem"),
        _text(e, "$.final_answer", "$.answer").alias("answer"),
        F.coalesce(F.transform(F.try_variant_get(e, "$.solution", "array<variant>"), lambda s: F.struct(F.try_variant_get(s, "$.step_num", "int").alias("number"), _text(s, "$.operation").alias("operation"), F.try_variant_get(s, "$.formula", "string").alias("result"), F.try_variant_get(s, "$.reasoning", "string").alias("description"))), F.array().cast("array<struct<number:int,operation:string,result:string,description:string>>")).alias("steps"),
    )
    rows = rows.withColumns({"_all": F.transform(listed, example), "_level": level})
    whole = F.filter("_all", lambda e: e["problem"].isNotNull() & (F.size(e["steps"]) > 0))
    rows = rows.withColumns({"technique": F.coalesce(named, topic), "category": F.coalesce(_text(v, "$.concept.topic"), F.lit("General")), "difficulty": F.least(F.col("_level"), F.lit(5)), "scaffold": F.coalesce(own, given, F.lit("textual_scaffold")), "examples": whole})
    status = F.try_variant_get(v, "$._validation_status", "string")
    tell = lambda pairs: F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n) if isinstance(n, str) else n) for c, n in pairs]))
    repairs = tell([(named.isNull() & topic.isNotNull(), "technique_from_topic"), (F.col("_level") > 5, "difficulty_clamped"), (own.isNull() & given.isNotNull(), "scaffold_from_panel"), (own.isNull() & given.isNull(), "scaffold_placeholder")])
    faults = tell(
        [
            (v.isNull(), "not_json"),
            (F.col("technique").isNull(), "no_technique"),
            (~F.coalesce(F.col("difficulty") >= 1, F.lit(False)), "difficulty"),
            (F.exists("_all", lambda e: e["problem"].isNull()), "empty_problem"),
            (F.exists("_all", lambda e: e["problem"].isNotNull() & (F.size(e["steps"]) == 0)), "empty_solution"),
            (F.size("examples") == 0, "no_examples"),
            (status == "flagged", "flagged"),
            (F.col("_defect").isNotNull(), F.concat(F.lit("defect:"), F.col("_defect"))),
        ]
    )
    counts = F.array_sort(F.transform("examples", lambda e: F.size(e["steps"])))
    median = F.element_at(counts, (F.floor(F.size(counts) / 2) + 1).cast("int"))
    load = F.coalesce(F.try_variant_get(v, "$.cognitive_load_score", "int"), F.lit(3))
    rows = rows.withColumns({"repairs": repairs, "quarantine": faults, "expected_time": F.when(F.size("examples") > 0, expected_seconds(F.col("difficulty"), load, median))})
    verified = F.coalesce(status.isin("verified_L1", "verified_L2"), F.lit(False))
    trust = F.when(F.size("quarantine") > 0, "quarantined").when(verified & (F.size("repairs") == 0), "trusted_candidate").otherwise("sandbox_candidate")
    return rows.withColumn("trust", trust).select(*records.columns, "id", "technique", "category", "difficulty", "scaffold", "examples", "expected_time", "repairs", "quarantine", "trust")

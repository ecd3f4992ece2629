"""Queries of documents of any shape, patterns, spans and repaired formulas, registered beside the others."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from quernstone.functions import notation
from quernstone.operators import shapes, spans
from quernstone.operators.spans import Pattern
from quernstone.registry import query

_RAW = """r as (select event_id, case event_id % 7 when 0 then props when 1 then '[' || props || ', "plain ' || event_type || '", {"operation": "", "text": " said ", "step": "3"}]'
when 2 then '{"steps": [{"operation": "' || event_type || '", "step_num": ' || event_id % 5 || '}, {"description": "why"}]}' when 3 then 'take ' || event_type when 4 then null when 5 then '{"steps": "none"}' else '[1, [2], "  "]' end as raw from events)"""


@query(f"""with {_RAW}, v as (select event_id, raw, try_cast(raw as json) as j from r), a as (select *, case when j is null then null when json_type(j) = 'ARRAY' then json_extract(j, '$[*]') when json_type(json_extract(j, '$.steps')) = 'ARRAY' then json_extract(j, '$.steps[*]') end as items from v),
s as (select event_id, unnest(items) as x, generate_subscripts(items, 1) as i from a where items is not null),
t as (select event_id, i, case when json_type(x) = 'OBJECT' then coalesce(try_cast(x->>'step_num' as int), try_cast(x->>'step' as int), 0) else 0 end as number, trim(case when json_type(x) = 'OBJECT' then coalesce(nullif(x->>'operation', ''), nullif(x->>'text', ''), nullif(x->>'description', ''), '') else x->>'$' end) as text from s),
u as (select event_id, i, number, text from t where text <> '' union all select event_id, 1, 0, trim(raw) from v where j is null and raw is not null)
select e.event_id, coalesce(string_agg(number || ':' || text, '|' order by i), '') as steps, any_value(case when json_type(j) = 'ARRAY' then json_array_length(j) end)::int as n from v e left join u using (event_id) group by 1""")
def steps_any_shape(events):
    """Steps as JSON text, list or object, made from an event's properties."""
    k, text = F.col("event_id"), F.col("event_type")
    raw = (
        F.when(k % 7 == 0, F.col("props"))
        .when(k % 7 == 1, F.concat(F.lit("["), "props", F.lit(', "plain '), text, F.lit('", {"operation": "", "text": " said ", "step": "3"}]')))
        .when(k % 7 == 2, F.concat(F.lit('{"steps": [{"operation": "'), text, F.lit('", "step_num": '), (k % 5).cast("string"), F.lit('}, {"description": "why"}]}')))
        .when(k % 7 == 3, F.concat(F.lit("take "), text))
        .when(k % 7 == 5, '{"steps": "none"}')
        .when(k % 7 == 6, '[1, [2], "  "]')
    )
    steps = F.transform(shapes.steps_of(raw), lambda s: F.concat(s["number"].cast("string"), F.lit(":"), s["text"]))
    return events.select("event_id", F.array_join(steps, "|").alias("steps"), shapes.array_length(raw).alias("n"))


@query("""select event_id, (props::json->>'k')::int as k, (props::json->>'k')::int = event_id % 100 as same from events""")
def property_values(events):
    """A property out of JSON of unknown shape, and whether the document equals another written with other spaces."""
    other = F.concat(F.lit('{ "k" :  '), (F.col("event_id") % 100).cast("string"), F.lit("}"))
    return events.select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "int").alias("k"), shapes.same_value(F.col("props"), other).alias("same"))


@query("""with t as (select p_partkey as k, p_name, p_size, case when p_partkey % 4 > 0 then p_type end as technique, case when p_partkey % 3 = 0 then p_brand end as topic, p_size % 8 as d, p_partkey % 5 as e, p_partkey % 6 as st from part)
select k::varchar as id, coalesce(technique, topic) as technique, case when d <= 5 then d else 5 end::int as difficulty, case when e in (1, 2, 3) then 1 when e = 4 then 2 else 0 end::int as n_examples,
array_to_string(list_filter([case when technique is null and topic is not null then 'technique_from_topic' end, case when d > 5 then 'difficulty_clamped' end, case when k % 9 > 0 and k % 10 = 0 then 'scaffold_from_panel' end, case when k % 9 > 0 and k % 10 > 0 then 'scaffold_placeholder' end], lambda x: x is not null), ',') as repairs,
array_to_string(list_filter([case when coalesce(technique, topic) is null then 'no_technique' end, case when d < 1 then 'difficulty' end, case when e = 2 then 'empty_problem' end, case when e = 3 then 'empty_solution' end, case when e = 0 then 'no_examples' end, case when st = 1 then 'flagged' end, case when k % 50 = 7 then 'defect:wrong_root' end], lambda x: x is not null), ',') as quarantine,
case when coalesce(technique, topic) is null or d < 1 or e in (0, 2, 3) or st = 1 or k % 50 = 7 then 'quarantined' when st = 2 and technique is not null and d <= 5 and k % 9 = 0 then 'trusted_candidate' else 'sandbox_candidate' end as trust from t""")
def adapted_templates(part):
    """Templates as JSON text of several shapes, made from parts."""
    k = F.col("p_partkey")
    good = lambda n: F.struct(F.concat(F.lit("problem "), F.lit(n)).alias("problem_statement"), F.array(F.struct(F.lit(1).alias("step_num"), F.lit("halve").alias("operation"))).alias("solution"))
    bare = F.struct(F.lit("x").alias("problem_statement"), F.array().cast("array<struct<step_num:int,operation:string>>").alias("solution"))
    silent = F.struct(F.lit("").alias("problem_statement"), F.array(F.struct(F.lit(1).alias("step_num"), F.lit("halve").alias("operation"))).alias("solution"))
    examples = F.when(k % 5 == 1, F.array(good(1))).when(k % 5 == 2, F.array(good(1), silent)).when(k % 5 == 3, F.array(good(1), bare)).when(k % 5 == 4, F.array(good(1), good(2)))
    concept = F.struct(F.when(k % 4 > 0, F.col("p_type")).alias("technique_name"), F.when(k % 3 == 0, F.col("p_brand")).alias("sub_topic"))
    status = F.when(k % 6 == 1, "flagged").when(k % 6 == 2, "verified_L1")
    record = F.struct(k.cast("string").alias("template_id"), concept.alias("concept"), (F.col("p_size") % 8).alias("difficulty"), F.when(k % 9 == 0, F.struct(F.lit("number_line").alias("type"))).alias("visual_scaffold"), examples.alias("examples"), status.alias("_validation_status"))
    overrides = part.filter("p_partkey % 10 = 0").select(k.cast("string").alias("id"), F.lit("grid").alias("scaffold"))
    defects = part.filter("p_partkey % 50 = 7").select(k.cast("string").alias("id"), F.lit("wrong_root").alias("defect"))
    out = shapes.adapted(part.select(F.to_json(record).alias("raw")), "raw", overrides, defects)
    return out.select("id", "technique", "difficulty", F.size("examples").alias("n_examples"), F.array_join("repairs", ",").alias("repairs"), F.array_join("quarantine", ",").alias("quarantine"), "trust")


def pattern_library() -> list[Pattern]:
    """Patterns by rule: each subject with each way to speak of it; the specific ones before the general."""
    subjects = {"license": ["license", "licence", "licensed", "copyright"], "secret": ["password", "token", "secret", "key"], "contact": ["mail", "phone", "address", "call"], "notice": ["cookies", "subscribe", "terms", "privacy", "rights"], "measure": ["metre", "litre", "hour", "percent", "euro"], "reckoning": ["sum", "product", "ratio", "average", "root", "square"]}
    ways = [("of", r"\b{0} of (the |a )?\w+", 1, 0.9), ("under", r"\b{0}d? under the \w+", 1, 0.9), ("is", r"\b{0} (is|are|was) ", 2, 0.7), ("colon", r"\b{0} ?[:=] ?\S+", 0, 0.9), ("number", r"\b\d+([.,]\d+)? ?{0}s?\b", 2, 0.8), ("your", r"\b(your|our|my) {0}s?\b", 2, 0.7), ("word", r"\b{0}s?\b", 9, 0.3)]
    out = [Pattern(f"{subject}_{word}_{way}", f"(?i){expression.format(word)}", (word,), priority, int(way == "number"), specific) for (subject, words), (way, expression, priority, specific) in product(subjects.items(), ways) for word in words]
    return [*out, Pattern("mail_address", r"(?i)[a-z0-9._]+@[a-z0-9]+\.[a-z]+", ("@",), 0, 0, 1.0), Pattern("web_address", r"https?://[a-z0-9./]+", ("http",), 0, 0, 1.0), Pattern("long_number", r"\d{7,}", (), 5, 1, 0.6)]


_CASES = " ".join(f"when regexp_matches(text, '{p.expression}') then '{p.name}'" for p in sorted(pattern_library(), key=lambda p: (p.priority, p.name)))


@query(f"select doc_id, case {_CASES} end as pattern from documents")
def text_patterns(documents):
    """The first of some two hundred patterns that each document matches; the SQL tries them one by one."""
    return spans.first_patterns(documents.select("doc_id", "text"), "text", pattern_library()).select("doc_id", "pattern")


@query(None)
def text_spans(documents):
    """Spans with positions and scores, the best of those that overlap: tests hold the choice against brute force."""
    return spans.document_spans(documents, "doc_id", "text", pattern_library())


@query(None)
def repaired_formulas(documents):
    """Every line of the documents as a formula with words beside it: tests hold the repairs to their promises."""
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return lines.withColumn("r", notation.repaired(F.col("line"), F.lit(None).cast("string"))).select("doc_id", "at", "r.formula", "r.description", F.array_join("r.repairs", ",").alias("repairs"))

"""Queries of patches and of hints that don't give an answer away, registered beside the others."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quernstone.operators import bank, patches
from quernstone.registry import query
from quernstone.variants import variant, variant_sql

ACTIONS = ["key", "directions", "correct_key", "options", "record_tags", "options_check", "difficulty", "clear_needs_vision", "format", "flag", "clear_chart_flag", "drop", "suspect"]
_P = f"""p as (select l_orderkey as set_id, case when l_linenumber % 5 = 4 then '*' else (l_linenumber % 5)::varchar end as number, {variant_sql(ACTIONS, "l_partkey + l_suppkey")} as action, l_partkey as k, l_suppkey as s, l_extendedprice as moment,
case when l_partkey % 7 > 0 then 'page 4' end as source, case when l_suppkey % 5 > 0 then 'seen twice' else ' ' end as reason, case when l_partkey % 5 > 0 then (l_partkey % 3)::varchar end as answer_key, case l_partkey % 4 when 0 then ['a', 'b'] when 1 then ['a'] when 2 then ['c', 'd'] end as options,
(l_partkey % 8)::int as difficulty, case when l_partkey % 2 = 0 then 'numeric' else 'essay' end as question_format, case when l_partkey % 6 > 0 then 'choose one' end as directions, case when l_partkey % 3 = 0 then ['Ratio-and proportion'] when l_partkey % 3 = 1 then ['ratio and  proportion', 'Ratio and Proportion'] end as tags from lineitem),
q as (select distinct l_orderkey as set_id, (l_linenumber % 3)::varchar as number, case when l_orderkey % 3 > 0 then (l_orderkey % 3)::varchar end as answer_key, case l_orderkey % 4 when 0 then ['a', 'b'] when 1 then []::varchar[] end as options, case when l_orderkey % 2 = 0 then 3 end as difficulty, case l_orderkey % 3 when 0 then 'numeric' when 1 then 'unclassified' end as question_format,
case when l_orderkey % 5 = 0 then 'blurred' end as needs_reextraction, case when l_orderkey % 7 = 0 then 'true' end as needs_vision from lineitem where l_orderkey % 11 > 0 or l_linenumber % 3 = 0),
r as (select o_orderkey as set_id, case when o_orderkey % 3 = 0 then 'choose one' when o_orderkey % 3 = 1 then 'read on' end as directions, case when o_orderkey % 2 = 0 then ['Ratio and Proportion'] else ['Series'] end as tags, case when o_orderkey % 9 > 0 then 'true' end as needs_chart_vision from orders where o_orderkey % 13 > 0)"""


def _tables(lineitem, orders):
    k, s, o, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_orderkey"), F.col("l_linenumber")
    texts = lambda *xs: F.array(*map(F.lit, xs))
    p = lineitem.select(
        o.alias("set_id"), F.when(n % 5 == 4, "*").otherwise((n % 5).cast("string")).alias("number"), variant(ACTIONS, k + s).alias("action"), k.alias("k"), s.alias("s"), F.col("l_extendedprice").alias("at"),
        F.when(k % 7 > 0, "page 4").alias("source"), F.when(s % 5 > 0, "seen twice").otherwise(" ").alias("reason"), F.when(k % 5 > 0, (k % 3).cast("string")).alias("answer_key"), F.when(k % 4 == 0, texts("a", "b")).when(k % 4 == 1, texts("a")).when(k % 4 == 2, texts("c", "d")).alias("options"),
        (k % 8).cast("int").alias("difficulty"), F.when(k % 2 == 0, "numeric").otherwise("essay").alias("question_format"), F.when(k % 6 > 0, "choose one").alias("directions"), F.when(k % 3 == 0, texts("Ratio-and proportion")).when(k % 3 == 1, texts("ratio and  proportion", "Ratio and Proportion")).alias("tags"),
    )
    q = lineitem.filter((o % 11 > 0) | (n % 3 == 0)).select(o.alias("set_id"), (n % 3).cast("string").alias("number")).distinct()
    o = F.col("set_id")
    q = q.select("set_id", "number", F.when(o % 3 > 0, (o % 3).cast("string")).alias("answer_key"), F.lit("grid").alias("key_source"), F.when(o % 4 == 0, texts("a", "b")).when(o % 4 == 1, F.array().cast("array<string>")).alias("options"), F.when(o % 2 == 0, 3).alias("difficulty"), F.when(o % 3 == 0, "numeric").when(o % 3 == 1, "unclassified").alias("question_format"))
    q = q.withColumn("extra", F.map_filter(F.create_map(F.lit("needs_reextraction"), F.when(o % 5 == 0, "blurred"), F.lit("needs_vision"), F.when(o % 7 == 0, "true")), lambda _, v: v.isNotNull()))
    o = F.col("o_orderkey")
    r = orders.filter(o % 13 > 0).select(o.alias("set_id"), F.when(o % 3 == 0, "choose one").when(o % 3 == 1, "read on").alias("directions"), F.when(o % 2 == 0, texts("Ratio and Proportion")).otherwise(texts("Series")).alias("tags"), F.map_filter(F.create_map(F.lit("needs_chart_vision"), F.when(o % 9 > 0, "true")), lambda _, v: v.isNotNull()).alias("extra"))
    return p, q, r


_TAG = "list_sort(list_distinct(list_transform(coalesce({0}, []), lambda t: trim(regexp_replace(lower(t), '[^a-z0-9]+', ' ', 'g')))))"


@query(f"""with {_P}, j as (select p.*, q.answer_key as qa, q.options as qo, q.difficulty as qd, q.question_format as qf, needs_reextraction, needs_vision, q.set_id is not null as has_q, r.set_id is not null as has_r, r.directions as rd, r.tags as rt, needs_chart_vision, count(*) over (partition by p.set_id, p.number, action) as n from p left join q using (set_id, number) left join r on r.set_id = p.set_id),
h as (select *, case action when 'key' then coalesce(trim(qa), '') <> '' when 'options' then coalesce(len(qo), 0) > 0 when 'difficulty' then qd is not null when 'format' then coalesce(qf, '') not in ('', 'unclassified') when 'directions' then coalesce(rd, '') <> '' else false end as there,
coalesce(case action when 'key' then trim(qa) = trim(answer_key) when 'correct_key' then qa = answer_key when 'options' then qo = options when 'difficulty' then qd = difficulty when 'format' then qf = question_format when 'directions' then rd = directions end, false) as same from j)
select set_id, number, action, k, s, array_to_string(list_filter([
case when case when number = '*' then action not in ('directions', 'record_tags', 'clear_chart_flag') else action not in ('key', 'correct_key', 'options', 'options_check', 'clear_needs_vision', 'difficulty', 'format', 'flag', 'suspect') end then 'unknown_action' end,
case when not has_r then 'no_such_record' end, case when has_r and number <> '*' and not has_q then 'no_such_question' end, case when n > 1 then 'several_patches' end, case when there and not same then 'conflict' end,
case when case when action in ('key', 'correct_key') then answer_key is null when action = 'options' then options is null when action = 'directions' then directions is null when action = 'record_tags' then tags is null else false end then 'no_value' end,
case when action in ('key', 'correct_key', 'options', 'difficulty', 'format', 'directions', 'record_tags') and source is null then 'no_source' end, case when action in ('correct_key', 'options_check', 'clear_needs_vision', 'clear_chart_flag', 'flag', 'suspect') and reason = ' ' then 'no_reason' end,
case when action = 'options' and len(options) = 1 then 'short_options' end, case when action = 'difficulty' and difficulty not between 1 and 5 then 'bad_difficulty' end, case when action = 'options' and needs_reextraction is not null then 'flagged_question' end,
case when action = 'record_tags' and has_r and {_TAG.format("rt")} <> {_TAG.format("tags")} then 'concepts_changed' end,
case when action = 'clear_needs_vision' and needs_vision is null or action = 'clear_chart_flag' and needs_chart_vision is null then 'nothing_to_clear' end], lambda x: x is not null), ',') as faults, same and (there or action = 'correct_key') as replay from h""")
def patch_verdicts(lineitem, orders):
    """What is wrong with each of many patches, and which say what is there already."""
    out = patches.verified(*_tables(lineitem, orders))
    return out.select("set_id", "number", "action", "k", "s", F.array_join("faults", ",").alias("faults"), "replay")


@query(f"""with {_P}, l as (select set_id, number, action, arg_max({{'a': answer_key, 's': source, 'o': options, 'd': difficulty, 'f': question_format, 'r': reason}}, moment) as v from p where number <> '*' group by all),
w as (select q.*, k.v as pk, c.v as pc, o.v as po, d.v as pd, f.v as pf, x.v as px from q left join l k on k.set_id = q.set_id and k.number = q.number and k.action = 'key' left join l c on c.set_id = q.set_id and c.number = q.number and c.action = 'correct_key' left join l o on o.set_id = q.set_id and o.number = q.number and o.action = 'options'
left join l d on d.set_id = q.set_id and d.number = q.number and d.action = 'difficulty' left join l f on f.set_id = q.set_id and f.number = q.number and f.action = 'format' left join l x on x.set_id = q.set_id and x.number = q.number and x.action = 'clear_needs_vision')
select set_id, number, case when pc is not null and answer_key is distinct from pc.a then pc.a when pk is not null and answer_key is null then pk.a else answer_key end as answer_key, case when pc is not null and answer_key is distinct from pc.a then pc.s when pk is not null and answer_key is null then coalesce(pk.s, 'grid') else 'grid' end as key_source,
array_to_string(case when po is not null and coalesce(len(options), 0) = 0 then coalesce(po.o, options) else options end, ';') as options, case when difficulty is null then pd.d else difficulty end as difficulty, case when question_format is null or question_format = 'unclassified' then coalesce(pf.f, question_format) else question_format end as question_format,
case when pc is not null and answer_key is distinct from pc.a then coalesce(answer_key, '') || ': ' || pc.r end as superseded, case when px is not null and needs_vision is not null then '' else needs_vision end as needs_vision from w""")
def patch_results(lineitem, orders):
    """The questions after all patches: fills, corrections with what they took the place of, cleared flags."""
    p, q, r = _tables(lineitem, orders)
    out, _ = patches.applied(q, r, p)
    return out.select("set_id", "number", "answer_key", "key_source", F.array_join("options", ";").alias("options"), "difficulty", "question_format", F.col("extra")["key_superseded"].alias("superseded"), F.col("extra")["needs_vision"].alias("needs_vision"))


_TOKENS = "select doc_id, t, count(*) as n from (select doc_id, unnest(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')) as t from documents where {1}) group by 1, 2"


@query(f"""with a as ({_TOKENS.format("replace(text, ' the ', ' ye ')", "text is not null")}), b as ({_TOKENS.format("text", "doc_id % 5 > 0")}),
j as (select a.doc_id, a.n, greatest(0, a.n - coalesce(b.n, 0)) as lost from a left join b on a.doc_id = b.doc_id and a.t = b.t where a.doc_id in (select doc_id from b))
select doc_id, sum(n)::bigint as tokens, sum(lost)::bigint as "foreign", round(sum(lost) / sum(n), 9) as rate from j group by 1""")
def rewrite_gate(documents):
    """How many words of each rewritten document its original lacks; a fifth has no original to hold it against."""
    changed = documents.select("doc_id", F.replace(F.col("text"), F.lit(" the "), F.lit(" ye ")).alias("text"))
    return patches.off_reference(changed, documents.filter("doc_id % 5 > 0").select("doc_id", "text"), ["doc_id"]).withColumn("rate", F.round("rate", 9))


@query("""with s as (select *, l_partkey % 5 as num, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as n, 'take ' || l_quantity::int || ' of ' || l_suppkey || '.' as text, case l_orderkey % 3 when 0 then (l_orderkey % 40)::varchar when 1 then 'x = ' || l_orderkey % 40 || ' or 1' else '(a) ' || l_orderkey % 40 || ' (b) ' || l_orderkey % 7 || '.5 cm' end as key from lineitem), f as (select *, coalesce(num <= lag(num) over (partition by l_orderkey order by n), false)::int as falls from s), g as (select *, sum(falls) over (partition by l_orderkey order by n rows unbounded preceding) as part from f),
h as (select *, coalesce(lead(part) over (partition by l_orderkey order by n) > part, true) as last, (l_orderkey % 40)::varchar as w from g),
k as (select *, not last and not (regexp_matches(text, '(^|[^\\w.])' || w || '($|[^\\w])') and (l_orderkey % 40 > 1 or key = w)) as shown from h)
select l_orderkey, coalesce(array_to_string(list(text order by n) filter (shown), ';'), '') as hints, least(5, count(*) filter (shown) + 1) as levels from k group by 1""")
def safe_hints(lineitem):
    """Hints without any step that states the answer: keys are a number, an equation, or several parts."""
    o, k = F.col("l_orderkey"), (F.col("l_orderkey") % 40).cast("string")
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    key = F.when(o % 3 == 0, k).when(o % 3 == 1, F.concat(F.lit("x = "), k, F.lit(" or 1"))).otherwise(F.concat(F.lit("(a) "), k, F.lit(" (b) "), (o % 7).cast("string"), F.lit(".5 cm")))
    text = F.concat(F.lit("take "), F.col("l_quantity").cast("int").cast("string"), F.lit(" of "), F.col("l_suppkey").cast("string"), F.lit("."))
    steps = lineitem.select("l_orderkey", n.alias("n"), (F.col("l_partkey") % 5).alias("num"), text.alias("text"), key.alias("key"))
    return bank.usable_hints(steps, "l_orderkey", "n", "num", "text", "key").withColumn("hints", F.array_join("hints", ";"))

"""Queries of answers, grading and exam scores, registered beside the others."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone import functions as Q
from quernstone.functions import answers as A
from quernstone.operators import exams
from quernstone.registry import query
from quernstone.variants import variant, variant_sql

KEYS = [
    "$735 + # = 902$", "1,2#", "-#", "95.5%", "$\\frac{#}{4}$", "$-2\\frac{1}{4}$", "3x - 11 = 0", "X + Y = 0", "see the worked solution", "a = b = #",
    "\\text{Rs } #", "$\\frac{1}{0}$", "3 and 7", "$\\frac{9}{2} = 4\\frac{1}{2}$", " # ", "\\sqrt{4} = 2", "", "#.25",
]
_LATEX = r"^(-?\d+)?\s*\\d?frac\{(-?[\d.]+)\}\{(-?[\d.]+)\}$"


def numeric_sql(key: str) -> str:
    """numeric_answer as DuckDB SQL of one expression."""
    text = rf"regexp_replace(trim({key}), '^\$+|\$+$', '', 'g')"
    value = rf"trim(regexp_replace(list_extract(string_split({text}, '='), -1), '\\[,;! $]|\\left|\\right', '', 'g'))"
    bare = rf"trim(regexp_replace(regexp_replace({value}, '[,$]|\\?%', '', 'g'), '^\\text\{{.*?\}}', '', 'g'))"
    part = rf"(try_cast(regexp_extract({value}, '{_LATEX}', 2) as double) / nullif(try_cast(regexp_extract({value}, '{_LATEX}', 3) as double), 0))"
    whole = rf"try_cast(nullif(regexp_extract({value}, '{_LATEX}', 1), '') as double)"
    return rf"""(case when len(string_split({text}, '=')) > 2 then null when contains({text}, '=') and regexp_matches(regexp_replace(string_split({text}, '=')[1], '\\[a-zA-Z]+', ' ', 'g'), '[a-zA-Z]') then null
when regexp_matches({value}, '{_LATEX}') then case when {whole} is null then {part} when starts_with({value}, '-') then -(abs({whole}) + abs({part})) else abs({whole}) + abs({part}) end
when regexp_matches({bare}, '^-?\d+(\.\d+)?$') then try_cast({bare} as double) end)"""


@query(f"""with k as (select o_orderkey, {variant_sql(KEYS, "o_orderkey")} as key from orders) select o_orderkey, key, {numeric_sql("key")} as value from k""")
def numeric_answers(orders):
    keys = orders.select("o_orderkey", variant(KEYS, "o_orderkey").alias("key"))
    return keys.select("o_orderkey", "key", A.numeric_answer("key").alias("value"))


@query(r"""select l_orderkey, l_linenumber, case when x = floor(x) and abs(x) < 1e15 then x::bigint::varchar when not contains(x::varchar, 'e') then x::varchar end as text from (select *, case when l_linenumber % 3 = 0 then l_extendedprice when l_linenumber % 3 = 1 then l_quantity * 1000003 else l_discount end as x from lineitem)""")
def formatted_answers(lineitem):
    x = F.when(F.col("l_linenumber") % 3 == 0, F.col("l_extendedprice")).when(F.col("l_linenumber") % 3 == 1, F.col("l_quantity") * 1000003).otherwise(F.col("l_discount"))
    return lineitem.select("l_orderkey", "l_linenumber", A.format_answer(x.cast("double")).alias("text"))


KINDS = ["mcq", "tita", "numeric", "essay", "mcq"]
GIVEN = ["a", "B", " Red ", "12", "12.0000001", "", "$\\frac{24}{2}$", "yellow", "No  Answer"]
RIGHT = ["A", "b", "red", "12", "12", "blue", "12.0", "Red", "no answer"]
_OPTIONS = "['Red', 'blue', ' Green', '12']"


def _plain_sql(c: str) -> str:
    return rf"trim(regexp_replace(lower(coalesce({c}, '')), '\s+', ' ', 'g'))"


_GRADED = f"""g as (select l_orderkey, l_linenumber, l_suppkey, l_returnflag, {variant_sql(KINDS, "l_orderkey + l_linenumber")} as kind, case when l_partkey % 11 <> 0 then {variant_sql(GIVEN, "l_partkey")} end as given, {variant_sql(RIGHT, "l_suppkey + l_linenumber")} as expected from lineitem),
n as (select *, {_plain_sql("given")} as a, {_plain_sql("expected")} as e, {numeric_sql("given")} as x, {numeric_sql("expected")} as y, list_transform(['a', 'b', 'c', 'd'], lambda l, i: [l, lower(trim(({_OPTIONS})[i]))]) as named from g),
v as (select *, case when kind = 'essay' or a = '' or expected is null then null when kind = 'mcq' then a = e or len(list_filter(named, lambda o: list_contains(o, a) and list_contains(o, e))) > 0 when x is null or y is null then a = e else abs(x - y) <= 1e-6 * greatest(1, abs(y)) end as correct from n)"""


def _graded(lineitem):
    rows = lineitem.select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag",
        variant(KINDS, F.col("l_orderkey") + F.col("l_linenumber")).alias("kind"),
        F.when(F.col("l_partkey") % 11 != 0, variant(GIVEN, "l_partkey")).alias("given"),
        variant(RIGHT, F.col("l_suppkey") + F.col("l_linenumber")).alias("expected"),
    )
    options = F.array(F.lit("Red"), F.lit("blue"), F.lit(" Green"), F.lit("12"))
    return rows.withColumn("correct", A.grade(F.col("kind"), F.col("given"), F.col("expected"), options))


@query(f"with {_GRADED} select l_orderkey, l_linenumber, correct from v")
def graded_answers(lineitem):
    return _graded(lineitem).select("l_orderkey", "l_linenumber", "correct")


_SECTIONS = f"""{_GRADED}, s as (select l_suppkey, l_returnflag as section, count(*) as questions, count(correct) as attempted, count(*) filter (correct) as correct, count(*) filter (not correct) as wrong, count(*) - count(correct) as unattempted, 3.0 * count(*) filter (correct) - count(*) filter (not correct and kind = 'mcq') as raw, 3.0 * count(*) as max_raw,
case when count(correct) > 0 then round(count(*) filter (correct) / count(correct)::double, 4) else 0 end as accuracy, round_even(130 + 40 * (count(*) filter (correct) / count(*)::double), 0)::bigint as scaled from v group by 1, 2)"""


@query(f"with {_SECTIONS} select * from s")
def section_scores(lineitem):
    rows = _graded(lineitem).withColumnRenamed("l_returnflag", "section")
    return exams.section_scores(rows, ["l_suppkey", "section"], 3, F.when(F.col("kind") == "mcq", -1.0).otherwise(0.0), (130, 170))


@query(f"""with {_SECTIONS} select l_suppkey, round(sum(raw), 2) as total_raw, sum(max_raw) as max_raw, sum(scaled)::bigint as summed, 205 + (floor(600 * avg(correct / questions::double) / 10 + 0.5) * 10)::bigint as stepped from s group by 1""")
def exam_scores(lineitem):
    return exams.exam_scores(section_scores(lineitem), ["l_suppkey"], (205, 805, 10))


@query(f"""with {_GRADED} select l_suppkey, l_returnflag as skill, count(*) as questions, count(*) filter (correct) as correct, round(count(*) filter (correct) / count(*)::double, 3) as accuracy, row_number() over (partition by l_suppkey order by round(count(*) filter (correct) / count(*)::double, 3), count(*) desc, l_returnflag) as place from v where kind <> 'essay' group by 1, 2 having count(*) filter (correct) / count(*)::double < 0.7""")
def weak_skills(lineitem):
    rows = _graded(lineitem).filter("kind != 'essay'").withColumnRenamed("l_returnflag", "skill")
    return exams.weak_skills(rows, ["l_suppkey"], "skill")


OPTION_LISTS = ["(a) 17;(b) 18;(c) 19;(d) #", "1) 2;2) 3;3) 4", "Point;Point;Line", "A. Red;B. Blue;C. Green", "x;;y", "one;two;&", "U;W;Y;Z", "(a) 5;(c) 6", "only"]
OPTION_KEYS = ["(b)", "C.", "Choice B is right", "Alternative 2", "18", "2", "red", "e", "17; 18 and 19", "point", "", "nothing of it", "Z"]
_LETTER_SQL = r"^\s*\(?([a-fA-F])\)[.)]?\s+|^\s*([a-fA-F])[.)]\s+"
_NUMBER_SQL = r"^\s*\(?([1-9])\)[.)]?\s+|^\s*([1-9])[.)]\s+"


def _option_text_sql(o: str) -> str:
    return rf"trim(trim(regexp_replace(lower(trim(case when regexp_matches({o}, '{_LETTER_SQL}') then regexp_replace({o}, '{_LETTER_SQL}', '') else regexp_replace({o}, '{_NUMBER_SQL}', '') end)), '\s+', ' ', 'g'), ' .'))"


_OPTION_ROWS = f"""o as (select l_orderkey, l_linenumber, string_split({variant_sql(OPTION_LISTS, "l_partkey")}, ';') as options, {variant_sql(OPTION_KEYS, "l_orderkey + l_linenumber")} as key from lineitem),
t as (select *, trim(key) as k, list_transform(options, lambda o: {_option_text_sql("o")}) as texts, {_option_text_sql("trim(key)")} as nk,
list_transform(options, lambda o: lower(regexp_extract(o, '{_LETTER_SQL}', 1) || regexp_extract(o, '{_LETTER_SQL}', 2))) as letters, list_transform(options, lambda o: regexp_extract(o, '{_NUMBER_SQL}', 1) || regexp_extract(o, '{_NUMBER_SQL}', 2)) as numbers from o),
s as (select *, case when letters = ['a', 'b', 'c', 'd', 'e', 'f'][1:len(options)] then 'letter' when numbers = ['1', '2', '3', '4', '5', '6'][1:len(options)] then 'number' end as tags, len(list_filter(texts, lambda x: x <> '' and x = nk)) as same from t)"""


def _option_rows(lineitem):
    return lineitem.select("l_orderkey", "l_linenumber", F.split(variant(OPTION_LISTS, "l_partkey"), ";").alias("options"), variant(OPTION_KEYS, F.col("l_orderkey") + F.col("l_linenumber")).alias("key"))


@query(rf"""with {_OPTION_ROWS} select l_orderkey, l_linenumber, tags, case when list_contains(texts, '') then 'empty_option' when len(list_distinct(texts)) < len(texts) then 'equal_options' when len(list_filter(texts, lambda x: not regexp_matches(x, '[\p{{L}}\p{{N}}]'))) > 0 then 'wordless_option' end as fault,
case when k = '' or len(options) < 2 then 'no_key_or_options' when regexp_matches(k, '^\(?([a-eA-E])\)?[.:]?$') then case when ascii(lower(regexp_extract(k, '^\(?([a-eA-E])\)?[.:]?$', 1))) - 97 < len(options) then 'by_letter' else 'letter_past_end' end
when regexp_matches(k, '(?i)^\s*choices?\s+([a-f])\b') then case when ascii(lower(regexp_extract(k, '(?i)^\s*choices?\s+([a-f])\b', 1))) - 97 < len(options) then 'by_choice' else 'letter_past_end' end
when regexp_matches(k, '(?i)^\s*alternative\s+([1-9])\b') then case when regexp_extract(k, '(?i)^\s*alternative\s+([1-9])\b', 1)::int - 1 < len(options) then 'by_alternative' else 'alternative_past_end' end
when same = 1 then 'by_text' when same > 1 then 'text_of_several' when tags = 'number' and regexp_matches(k, '^[-−+]?\d[\d,]*(\.\d+)?$') then 'ordinal_or_value' when regexp_matches(k, '(?i);|\band\b|,\s*\w+\s*,') and length(nk) > 3 then 'several_answers' else 'unresolved' end as how,
case when how = 'by_letter' then ascii(lower(regexp_extract(k, '([a-eA-E])', 1))) - 97 when how = 'by_choice' then ascii(lower(regexp_extract(k, '(?i)choices?\s+([a-f])', 1))) - 97 when how = 'by_alternative' then regexp_extract(k, '([1-9])', 1)::int - 1 when how = 'by_text' then list_position(texts, nk) - 1 end as option from s""")
def option_keys(lineitem):
    rows = _option_rows(lineitem)
    return rows.select("l_orderkey", "l_linenumber", A.tag_sequence(F.col("options")).alias("tags"), A.degenerate_options(F.col("options")).alias("fault"), A.option_of_key(F.col("key"), F.col("options")).alias("x")).select("l_orderkey", "l_linenumber", "tags", "fault", "x.how", "x.option")


SOURCES = ["answer_key_grid p#", "Answers to Selected Exercises", "bold at the head of #", "solution_note #", "hint_verdict", "page #", "", "Official Answer"]
ERRATA = ["CONFIRMED_BOOK_ERRATUM: #", "proven_wrong", "the key is a raster image", "misprint"]


@query(f"""with p as (select p_partkey, case when p_size > 5 then 'k' else '' end as key, lower({variant_sql(SOURCES, "p_partkey")}) as s, lower({variant_sql(ERRATA, "p_size")}) as e from part)
select p_partkey, case when key = '' then null when regexp_matches(s, 'answer_key_grid|answer_grid|answer key|answers to practice|answers to selected|answer section|official answer') then 'printed_grid' when regexp_matches(s, 'ans\\.|bold at the head|problem set answer|inline solution|answer choice') then 'printed_inline_answer' when contains(s, 'solution_note') then 'solution_note_derivation' when contains(s, 'hint_verdict') then 'hint_verdict_derivation' when s <> '' then 'other_cited' else 'uncited' end as provenance,
case when contains(e, 'confirmed_book_erratum') then 'confirmed_book_erratum' when contains(e, 'proven_wrong') then 'proven_wrong' when contains(e, 'raster image') or contains(e, 'math image') then 'key_is_raster_image' else 'other' end as errata from part join p using (p_partkey)""")
def key_provenance(part):
    key = F.when(F.col("p_size") > 5, "k").otherwise("")
    return part.select("p_partkey", A.key_provenance(variant(SOURCES, "p_partkey"), key).alias("provenance"), A.errata_code(variant(ERRATA, "p_size")).alias("errata"))


FORMULAS = ["\\frac{#}{2}", "x^{2", "\\begin{align} x", "\\2 + #", "$x$", "\\begin{align*} x \\end{align*}", "a\\nBC", "# + 1"]


@query(rf"""with f as (select p_partkey, {variant_sql(FORMULAS, "p_partkey")} as t from part)
select p_partkey, case when len(t) - len(replace(t, '{{', '')) <> len(t) - len(replace(t, '}}', '')) then 'unbalanced_braces' when len(regexp_extract_all(t, '\\begin\b')) <> len(regexp_extract_all(t, '\\end\b')) then 'unbalanced_begin_end' when regexp_matches(t, '\\[0-9]') then 'backslash_digit' when contains(t, '$') then 'dollar_delimiter_in_math_field' when regexp_matches(t, '\\begin\{{align\*?\}}') then 'align_env_needs_display_mode' when regexp_matches(t, '\\n[A-Za-z]') then 'newline_escaped_into_control_sequence' end as fault from f""")
def notation_faults(part):
    return part.select("p_partkey", A.notation_fault(variant(FORMULAS, "p_partkey")).alias("fault"))


STEPS = ["108 - 93 = 15", "12 + # = 2000", "4x + 1 - 1 = 9 - 1", "5 + 0 = 5", "\\text{so } 7 - 3 = 4.", "add carefully"]
PROSE = ["we add the surplus", "reduce it by the deficiency", "carry and then subtract", "look at the figure", "Adding both"]
POLYNOMIALS = ["x^2 + 3x - #", "y^3 - 2y = 0", "2x^2 - 7.5", "x - 4 + 2", "-# = 3"]


@query(rf"""with s as (select l_orderkey, l_linenumber, regexp_replace(trim(regexp_replace(regexp_replace({variant_sql(STEPS, "l_partkey")}, '\\text\{{[^}}]*\}}', ' ', 'g'), '\\[a-zA-Z]+|[{{}}\\]', ' ', 'g')), '[.;,]+$', '') as f, {variant_sql(PROSE, "l_suppkey")} as p, regexp_replace(string_split({variant_sql(POLYNOMIALS, "l_orderkey")}, '=')[1], '[ \\]', '', 'g') as b from lineitem),
d as (select *, case when len(f) - len(replace(f, '=', '')) = 1 and regexp_matches(f, '^(-?\d+)\s*([+-])\s*(-?\d+)\s*=\s*(-?\d+)$') then nullif(sign(try_cast(regexp_extract(f, '=\s*(-?\d+)$', 1) as bigint) - try_cast(regexp_extract(f, '^(-?\d+)', 1) as bigint)), 0)::int end as direction,
regexp_matches(p, '(?i)\b(increase|increased|increasing|add|adds|added|adding|carry|carried|carries|surplus|more than|raise|raised)\b') as up, regexp_matches(p, '(?i)\b(lessen|lessened|reduce|reduced|reducing|subtract|subtracted|subtracting|borrow|borrowed|deficiency|deduct|less than|lower)\b') as down, list_filter(regexp_extract_all(b, '[+-]?[^+-]+'), lambda x: not regexp_matches(x, '[a-zA-Z]')) as terms from s)
select l_orderkey, l_linenumber, direction, coalesce(case when up and not down then 1 when down and not up then -1 end <> direction, false) as contradicts, case when len(terms) = 0 then 0 else try_cast(case when regexp_matches(terms[-1], '^[+-]?\d+$') then terms[-1] end as bigint) end as constant from d""")
def step_checks(lineitem):
    step, prose = variant(STEPS, "l_partkey"), variant(PROSE, "l_suppkey")
    return lineitem.select("l_orderkey", "l_linenumber", A.step_direction(step).alias("direction"), A.prose_contradicts(prose, step).alias("contradicts"), A.constant_term(variant(POLYNOMIALS, "l_orderkey")).alias("constant"))


@query("""select l_orderkey, l_linenumber, ((l_quantity::bigint + l_linenumber) * 7 - l_partkey)::varchar as value from lineitem""")
def exact_values(lineitem):
    text = F.concat_ws("", F.lit("("), F.col("l_quantity").cast("int"), F.lit(" + "), "l_linenumber", F.lit(")*7 - "), "l_partkey", F.lit(" + 2**3 - 16/2"))
    return lineitem.select("l_orderkey", "l_linenumber", A.exact_value(text).alias("value"))


@query("""select event_id, case when value < 1 then 'reject_fast' when event_id % 4 >= 2 and event_id % 5 = 0 then 'reject_no_input' when value < 4 then 'flag_fast' when value < 10 and user_id % 2 = 0 then 'flag_skill' else 'ok' end as tier,
100 * (event_id % 4) + case when event_id % 4 = 3 then floor(greatest(0, 180 - value * 5000 / 1000)) else 0 end as score from events""")
def answer_tiers(events):
    tier = Q.answer_tier(F.col("value") * 200, F.col("event_id") % 4, F.col("event_id") % 5, (F.col("user_id") % 2).cast("double"))
    score = Q.daily_score(F.col("event_id") % 4, F.lit(3), F.col("value") * 5000)
    return events.select("event_id", tier.alias("tier"), score.cast("double").alias("score"))

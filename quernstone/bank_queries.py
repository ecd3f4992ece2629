"""Queries of question banks, chunks and checks of seeds, registered beside the others."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.lineage import dealt
from quernstone.operators import bank, chunking, content
from quernstone.registry import query
from quernstone.variants import variant, variant_sql

DESCRIPTIONS = [
    "since 3 is a root of it", "Again recall the volume formula", "multiply the bracket by the height", "then add both halves", "", "draw the circle around the corner",
    "divide the whole garden into squares and count them all", "second pass over the digits", "carry the remainder",
]
OPERATIONS = ["bracket times height", "garden by squares", "circle and corner", "digits once more", "halves", ""]
RESULTS = ["= # square metres", "0", "the answer of part #", "x^2 - #", "y = 7"]
ANSWERS = ["x^2 + 3x - 4", "the answer of part #", "y^3 - 2y", "12", ""]
_STEPS = f"""s as (select l_orderkey as template, l_linenumber % 3 as example, row_number() over (partition by l_orderkey, l_linenumber % 3 order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as step, {variant_sql(OPERATIONS, "l_suppkey")} as operation, {variant_sql(RESULTS, "l_partkey % 40")} as result, {variant_sql(DESCRIPTIONS, "l_partkey")} as description from lineitem),
e as (select template, example, {variant_sql(DESCRIPTIONS, "template + example")} as problem, {variant_sql(ANSWERS, "(template + example) % 40")} as answer from (select distinct template, example from s))"""
_TIDY = r"trim(regexp_replace(coalesce({0}, ''), '\s+', ' ', 'g'))"


def _bank(lineitem):
    from pyspark.sql import Window

    at = Window.partitionBy("l_orderkey", F.col("l_linenumber") % 3).orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    steps = lineitem.select(
        F.col("l_orderkey").alias("template"), (F.col("l_linenumber") % 3).alias("example"), F.row_number().over(at).alias("step"), variant(OPERATIONS, "l_suppkey").alias("operation"),
        variant(RESULTS, F.col("l_partkey") % 40).alias("result"), variant(DESCRIPTIONS, "l_partkey").alias("description"),
    )
    k = F.col("template") + F.col("example")
    examples = lineitem.select(F.col("l_orderkey").alias("template"), (F.col("l_linenumber") % 3).alias("example")).distinct().select("template", "example", variant(DESCRIPTIONS, k).alias("problem"), variant(ANSWERS, k % 40).alias("answer"))
    return steps, examples


@query(rf"""with {_STEPS}, f as (select template, example, description || ' ' || result as t from s where step = 1)
select template, example, coalesce(try_cast(nullif(regexp_extract(t, '(?i)(-?\d+)\s+is a root', 1), '') as bigint), try_cast(nullif(regexp_extract(t, '(?i)since\s+(-?\d+)\s+is\s+a\s+root', 1), '') as bigint)) as claimed, case answer when 'x^2 + 3x - 4' then -4 when 'y^3 - 2y' then 0 end as constant from f join e using (template, example) where claimed is not null and constant <> 0""")
def false_root_claims(lineitem):
    return bank.false_root_claims(*_bank(lineitem))


@query(rf"""with {_STEPS} select template, example from s where step = 1 and regexp_matches(trim(description), '(?i)^\s*(continue|continuing|repeat|again|then|second|third|final(ly)?|remaining)\b|\b(second|third|final)\s+(pass|iteration|division|round)\b')""")
def orphan_continuations(lineitem):
    return bank.orphan_continuations(_bank(lineitem)[0])


@query(f"""with {_STEPS}, p as (select template, example, array_to_string(list(trim(description) order by step), '|') as ds from s group by 1, 2 having count(*) filter (trim(description) <> '') >= 3), t as (select distinct template, template % 4 as topic from s)
select sha256(ds) as hash, count(distinct template) as templates, count(distinct topic) as topics from p join t using (template) group by 1 having count(distinct topic) > 1""")
def shared_step_prose(lineitem):
    steps, _ = _bank(lineitem)
    short = steps.filter("step <= 3 and template % 2 = 0 or template % 2 = 1")
    return bank.shared_step_prose(steps, short.select("template", (F.col("template") % 4).alias("topic")).distinct())


@query(f"""with {_STEPS}, r as (select template, example, step, {_TIDY.format("result")} as value from s), o as (select template, example, value from r where length(value) >= 12 union select template, example, {_TIDY.format("answer")} from e where length({_TIDY.format("answer")}) >= 12)
select r.template, r.example, r.step, min(o.example) as source from r join o on r.template = o.template and r.value = o.value and r.example <> o.example join e on e.template = r.template and e.example = r.example where length(r.value) >= 12 and r.value <> {_TIDY.format("e.answer")} group by all""")
def sibling_bleeds(lineitem):
    return bank.bleeds(*_bank(lineitem))


@query(None)
def misaligned_steps(lineitem):
    """Word sets of descriptions against operations: tests hold it against brute force."""
    return bank.misaligned_steps(*_bank(lineitem))


_LENS, _VOTE = ["logic", "units", "style", "logic", ""], ["pass", "fail", "pass", "pass", "maybe"]


@query(f"""with p as (select o_orderkey as k, list_transform(range((o_orderkey % 4 + 1)::bigint), lambda i: {{'lens': (['logic', 'units', 'style', 'logic', ''])[((o_orderkey + i * 2) % 5 + 1)::int], 'verdict': (['pass', 'fail', 'pass', 'pass', 'maybe'])[((o_custkey + i) % 5 + 1)::int]}}) as panel, (['pattern', 'template', 'item', 'page'])[(o_orderkey % 4 + 1)::int] as kind, case when o_custkey % 7 > 0 then 't' end as target, case when o_custkey % 9 > 0 then 'b' else '' end as backend, (['2_of_3', '1_of_3', 'any'])[(o_orderkey % 3 + 1)::int] as rule, case when o_orderkey % 2 = 0 then 'pass' else 'fail' end as result, o_custkey % 3 as checks from orders),
c as (select *, case when len(list_filter(panel, lambda p: p.verdict = 'pass')) >= case rule when '1_of_3' then 1 else 2 end then 'pass' else 'fail' end as computed from p)
select k as o_orderkey, array_to_string(list_filter([case when kind = 'page' then 'target_kind' end, case when target is null then 'target_id' end, case when backend = '' then 'judge_backend' end, case when len(panel) < 3 then 'panel_size' end, case when len(list_distinct(list_transform(panel, lambda p: p.lens))) < len(panel) then 'duplicate_lenses' end, case when len(list_filter(panel, lambda p: p.lens = '')) > 0 then 'unnamed_lens' end,
case when len(list_filter(panel, lambda p: p.verdict = 'maybe')) > 0 then 'vote' end, case when result <> computed then 'result' end, case when kind = 'pattern' and checks = 0 then 'spot_checks' end], lambda x: x is not null), ',') as faults from c""")
def verdict_faults(orders):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    of = lambda texts, n: F.element_at(F.array(*map(F.lit, texts)), (n % len(texts) + 1).cast("int"))
    panel = F.transform(F.sequence(F.lit(0).cast("long"), k % 4), lambda i: F.struct(of(_LENS, k + i * 2).alias("lens"), of(_VOTE, c + i).alias("verdict")))
    checks = F.when(c % 3 > 0, F.sequence(F.lit(1).cast("long"), c % 3))
    faults = bank.verdict_faults(panel, of(["pattern", "template", "item", "page"], k), F.when(c % 7 > 0, "t"), F.when(c % 9 > 0, "b").otherwise(""), of(["2_of_3", "1_of_3", "any"], k), F.when(k % 2 == 0, "pass").otherwise("fail"), checks)
    return orders.select("o_orderkey", F.array_join(faults, ",").alias("faults"))


@query("""with t as (select p_partkey as k, case when p_partkey % 5 > 0 then 'id' end as id, case when p_size > 3 then 'math' else '' end as domain, p_size % 7 as d, p_partkey % 3 as n, p_partkey % 4 as v from part)
select k as p_partkey, array_to_string(list_filter([case when id is null then 'id' end, case when domain = '' then 'domain' end, case when d not between 1 and 5 then 'difficulty' end, case when n = 0 then 'examples' end, case when v = 0 then 'version' end, case when n >= 1 and k % 2 = 0 then 'examples[0].problem_statement' end, case when n >= 1 and k % 11 = 0 then 'examples[0].solution[0].operation' end, case when n >= 2 then 'examples[1].solution' end], lambda x: x is not null), ',') as faults from t""")
def template_faults(part):
    k = F.col("p_partkey")
    none = F.lit(None).cast("array<struct<step_num:int,operation:string>>")
    first = F.struct(F.when(k % 2 > 0, "p").alias("problem"), F.array(F.struct(F.lit(1).alias("step_num"), F.when(k % 11 > 0, "o").otherwise("").alias("operation"))).alias("solution"))
    second = F.struct(F.lit("p").alias("problem"), none.alias("solution"))
    examples = F.when(k % 3 == 0, F.lit(None)).when(k % 3 == 1, F.array(first)).otherwise(F.array(first, second))
    t = F.struct(F.when(k % 5 > 0, "id").alias("id"), F.when(F.col("p_size") > 3, "math").otherwise("").alias("domain"), F.lit("t").alias("technique"), (F.col("p_size") % 7).alias("difficulty"), F.lit(30).alias("expected_time"), examples.alias("examples"), (k % 4).alias("version"))
    return part.select("p_partkey", F.array_join(bank.template_faults(t), ",").alias("faults"))


FORMATS = ["multiple_choice", "numeric", "unclassified", "options_are_images", "multi_select"]
_Q = f"""q as (select l_orderkey as set_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as pos, l_linenumber::varchar as number, case when l_partkey % 6 = 0 then 'short' else 'a question that is long enough' end as text, {variant_sql(FORMATS, "l_partkey")} as format, l_suppkey % 4 as n_options, case when l_quantity > 5 then 'k' end as answer_key, case when l_partkey % 13 = 0 then 'proven_wrong by #' end as errata from lineitem),
n as (select *, count(*) over (partition by set_id, number) as c, row_number() over (partition by set_id, number order by pos) as i from q)"""


@query(f"""with {_Q} select set_id || '#' || number || case when i > 1 then '~' || i else '' end as question_id, array_to_string(list_filter([case when c > 1 then 'duplicate_question_number' end, case when answer_key is null then 'no_answer_key' end, case when format = 'unclassified' then 'format_unclassified' end, case when format = 'options_are_images' then 'format_options_are_images' end, case when format in ('multiple_choice', 'multi_select') and n_options < 2 then 'option_format_without_options' end, case when text = 'short' then 'text_too_short' end, case when errata is not null then 'errata_proven_wrong' end], lambda x: x is not null), ',') as blockers, case when answer_key is null then null else 'printed_grid' end as provenance from n""")
def question_export(lineitem):
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]
    question = F.struct(
        *order, F.col("l_linenumber").cast("string").alias("number"), F.when(F.col("l_partkey") % 6 == 0, "short").otherwise("a question that is long enough").alias("text"), variant(FORMATS, "l_partkey").alias("format"),
        F.transform(F.sequence(F.lit(0), (F.col("l_suppkey") % 4).cast("int")), lambda i: i.cast("string")).alias("options"), F.when(F.col("l_quantity") > 5, "k").alias("answer_key"),
        F.lit("Official answer").alias("key_source"), F.when(F.col("l_partkey") % 13 == 0, "proven_wrong by #").alias("errata"),
    )
    sets = lineitem.groupBy(F.col("l_orderkey").alias("set_id")).agg(F.array_sort(F.collect_list(question)).alias("questions"))
    trimmed = sets.withColumn("questions", F.transform("questions", lambda q: q.withField("options", F.slice(q["options"], 1, F.size(q["options"]) - 1))))
    return bank.export_questions(trimmed).select("question_id", F.array_join("blockers", ",").alias("blockers"), "provenance")


KEYS, LISTS = ["(b)", "2", "red", "z", "e"], ["Red;Blue;Green", "x;;y", "1) 2;2) 3;3) 4"]


@query(f"""with q as (select p_partkey, p_brand, p_type, {variant_sql(KEYS, "p_partkey")} as k, {variant_sql(LISTS, "p_size")} as o from part)
select p_partkey as question_id, case when p_brand < 'Brand#3' then 'quant' when p_brand < 'Brand#5' then 'verbal' end as pool, case when p_brand >= 'Brand#5' then 'no_pool' when p_type = 'ECONOMY' then 'off_syllabus' when p_brand >= 'Brand#3' then null when o = 'x;;y' then 'empty_option' when k = '(b)' then null when k = 'e' then 'letter_past_end' when o like 'Red%' and k = 'red' then null when o like '1)%' and k = '2' then 'matches' when k = 'z' then 'unresolved' else 'unresolved' end as why from q""".replace("'matches'", "null"))
def pool_verdicts(part):
    q = part.select(F.col("p_partkey").alias("question_id"), F.col("p_brand").alias("book"), "p_type", variant(KEYS, "p_partkey").alias("answer_key"), F.split(variant(LISTS, "p_size"), ";").alias("options"))
    rules = part.filter("p_brand < 'Brand#5'").select(F.col("p_brand").alias("book"), F.when(F.col("p_brand") < "Brand#3", "quant").otherwise("verbal").alias("pool"), (F.col("p_brand") < "Brand#3").alias("wants_options")).distinct()
    return bank.pool_verdicts(q, rules, F.col("p_type"), "(?i)economy|trigonometr")


ACTIONS = ["set_key", "clear_key", "drop", "set_options", "set_key"]
_PATCH = f"""p as (select l_orderkey as set_id, (l_linenumber + 1)::bigint as number, {variant_sql(ACTIONS, "l_partkey")} as action, case when l_suppkey % 3 = 0 then '' else 'r' end as reason, case when l_partkey % 4 = 0 then 'b' else 'nothing' end as value, l_extendedprice as moment from lineitem where l_partkey % 3 = 0),
q as (select distinct l_orderkey as set_id, l_linenumber::bigint as number from lineitem)"""


def _patches(lineitem):
    patches = lineitem.filter("l_partkey % 3 = 0").select(F.col("l_orderkey").alias("set_id"), (F.col("l_linenumber") + 1).cast("long").alias("number"), variant(ACTIONS, "l_partkey").alias("action"), F.when(F.col("l_suppkey") % 3 == 0, "").otherwise("r").alias("reason"), F.when(F.col("l_partkey") % 4 == 0, "b").otherwise("nothing").alias("value"), F.col("l_extendedprice").alias("at"))
    questions = dealt(lineitem.select(F.col("l_orderkey").alias("set_id"), F.col("l_linenumber").cast("long").alias("number")), lineitem.count(), "set_id", "number").distinct()
    return patches, questions.withColumn("options", F.array(F.lit("x"), F.lit("y"), F.lit("v"))).withColumn("answer_key", F.lit("a"))


@query(f"""with {_PATCH}, c as (select p.*, count(*) over (partition by p.set_id, p.number, action) as n, q.number is not null as known from p left join q using (set_id, number))
select set_id, number, action, array_to_string(list_filter([case when action = 'drop' then 'unknown_action' end, case when reason = '' then 'no_reason' end, case when not known then 'no_such_question' end, case when n > 1 then 'several_patches' end, case when known and action = 'set_key' and value = 'nothing' then 'key_names_no_option' end], lambda x: x is not null), ',') as faults from c""")
def patch_faults(lineitem):
    return bank.patch_faults(*_patches(lineitem)).withColumn("faults", F.array_join("faults", ","))


@query(f"""with {_PATCH}, k as (select set_id, number, arg_max(action, moment) as action, arg_max(value, moment) as value from p where action in ('set_key', 'clear_key') group by 1, 2) select set_id, number, case action when 'set_key' then value when 'clear_key' then null else 'a' end as answer_key from q left join k using (set_id, number)""")
def patched_keys(lineitem):
    patches, questions = _patches(lineitem)
    return bank.patched(questions, patches).select("set_id", "number", "answer_key")


@query("""select p_partkey, case when p_partkey % 9 = 0 then 'lost' when p_partkey % 13 = 0 then 'changed' end as what from part where p_partkey % 9 = 0 or p_partkey % 13 = 0""")
def patch_preserves(part):
    """What a patch that may set sizes only has broken: rows lost, other columns changed."""
    after = part.filter("p_partkey % 9 != 0").withColumn("p_brand", F.when(F.col("p_partkey") % 13 == 0, "other").otherwise(F.col("p_brand"))).withColumn("p_size", F.col("p_size") + 1)
    return bank.preserved(part, after, ["p_partkey"], "p_size")


@query("""with s as (select *, l_partkey % 5 as num, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as n from lineitem), f as (select *, coalesce(num <= lag(num) over (partition by l_orderkey order by n), false)::int as falls from s), g as (select *, sum(falls) over (partition by l_orderkey order by n rows unbounded preceding) as part from f),
h as (select *, coalesce(lead(part) over (partition by l_orderkey order by n) > part, true) as last from g) select l_orderkey, coalesce(array_to_string(list(l_partkey::varchar order by n) filter (not last), ','), '') as hints, least(5, count(*) filter (not last) + 1) as levels from h group by 1""")
def hint_ladders(lineitem):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    steps = lineitem.select("l_orderkey", n.alias("n"), (F.col("l_partkey") % 5).alias("num"), F.col("l_partkey").cast("string").alias("text"))
    return bank.usable_hints(steps, "l_orderkey", "n", "num", "text").withColumn("hints", F.array_join("hints", ","))


@query("""select p_partkey, round(least(1, (p_size > 10)::int * 0.3::double + (p_name like 'b%')::int * 0.25 + (p_retailprice > 1000)::int * 0.4 + (p_brand is not null)::int * 0.1 + (p_partkey % 2 = 0)::int * 0.05), 2) as score from part""")
def completeness(part):
    parts = {"size": (F.col("p_size") > 10, 0.3), "name": (F.col("p_name").like("b%"), 0.25), "price": (F.col("p_retailprice") > 1000, 0.4), "brand": (F.col("p_brand").isNotNull(), 0.1)}
    return part.select("p_partkey", bank.completeness(parts, F.col("p_partkey") % 2 == 0).alias("score"))


LINES = ["find 15% of 80", "ratio of # to 5", "sum of # and 7", "area of a circle", "simple interest at 4%", "no pattern here"]
LIBRARY = [(2, "percentage", r"\d+%"), (1, "interest", "interest"), (3, "ratio", r"\bratio\b"), (4, "sum", r"(?i)\bsum\b|\bplus\b")]


@query(rf"""select p_partkey, case when contains(t, 'interest') then 'interest' when regexp_matches(t, '\d+%') then 'percentage' when regexp_matches(t, '\bratio\b') then 'ratio' when regexp_matches(t, '(?i)\bsum\b|\bplus\b') then 'sum' end as pattern from (select p_partkey, {variant_sql(LINES, "p_partkey")} as t from part)""")
def pattern_library(part):
    return bank.first_pattern(part.select("p_partkey", variant(LINES, "p_partkey").alias("t")), "t", LIBRARY).select("p_partkey", "pattern")


PAGE_LINES = ["Example 3", "EXERCISES", "# Ratio", "CHAPTER 4", "plain words", "PRACTICE PROBLEMS", "1. first", "THE WHOLE LINE IN CAPITALS"]


@query(rf"""with p as (select p_partkey as k, case when p_size % 5 = 0 then p_size % 2 = 0 end as verbatim, p_size / 50.0::double as conf, (p_partkey % 90)::int as words, {variant_sql(PAGE_LINES, "p_partkey")} as line from part)
select k as p_partkey, coalesce(verbatim, conf >= 0.5 and words >= 40) as ok, case when verbatim then 'verbatim' when verbatim is not null then 'needs_render' when conf >= 0.5 and words >= 40 then 'confidence' when conf < 0.5 then 'low_conf_' || printf('%.2f', conf) else 'too_few_words' end as reason,
case when line = 'Example 3' then 'worked_example' when line in ('EXERCISES', 'PRACTICE PROBLEMS') then 'problem_set' when line in ('CHAPTER 4', 'THE WHOLE LINE IN CAPITALS') or line like '# %' or regexp_matches(line, '^\d+ Ratio') and false then 'explanation' end as opens from p""")
def page_gates(part):
    gate = chunking.page_gate(F.when(F.col("p_size") % 5 == 0, F.col("p_size") % 2 == 0), F.col("p_size") / F.lit(50.0), (F.col("p_partkey") % 90).cast("int"))
    return part.select("p_partkey", gate["ok"].alias("ok"), gate["reason"].alias("reason"), chunking.boundary(variant(PAGE_LINES, "p_partkey")).alias("opens"))


@query(rf"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as k from documents),
m as (select doc_id, k, case k % 9 when 0 then '## ' || line when 1 then 'Example ' || k || ': ' || line when 2 then 'Exercises. ' || line when 3 then 'THE WHOLE OF LINE ' || k else line end as line from l)
select doc_id, k as line_at, case when regexp_matches(line, '{chunking._EXAMPLE}') then 'worked_example' when regexp_matches(line, '{chunking._PROBLEMS}') then 'problem_set' when regexp_matches(line, '{chunking._SECTION.replace("'", "''")}') then 'explanation' end as opens from m""")
def line_openings(documents):
    """What every line of the documents opens, some dressed as headings, examples and exercises."""
    rows = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    k = F.col("at") % 9
    line = F.when(k == 0, F.concat(F.lit("## "), "line")).when(k == 1, F.concat(F.lit("Example "), F.col("at").cast("string"), F.lit(": "), "line")).when(k == 2, F.concat(F.lit("Exercises. "), "line")).when(k == 3, F.concat(F.lit("THE WHOLE OF LINE "), F.col("at").cast("string"))).otherwise(F.col("line"))
    return rows.select("doc_id", F.col("at").alias("line_at"), chunking.boundary(line).alias("opens"))


@query(None)
def page_chunks(documents):
    """Every document as a book of pages of forty lines: tests hold chunks against worked examples."""
    lines = F.split("text", "\n")
    pages = F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / 40).cast("int")), lambda i: F.struct(i.alias("page"), F.array_join(F.slice(lines, i * 40 + 1, 40), "\n").alias("text")))
    rows = documents.filter("text is not null").select(F.col("doc_id").alias("book"), F.explode(pages).alias("x")).select("book", "x.*")
    return chunking.chunk_books(rows)


@query(r"""with r as (select l_orderkey, l_linenumber, l_partkey, 'take ' || l_quantity::int || ' and ' || l_partkey || ', then ' || l_partkey || '0' as t from lineitem) select l_orderkey, l_linenumber, l_partkey, regexp_replace(t, '(^|[^\w.])' || l_partkey || '([^\w]|$)', '\1[hidden]\2', 'g') as text, true as hits from r""")
def redacted_steps(lineitem):
    """The answer stands hidden where it is a word of its own, not within a longer number."""
    rows = lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.concat(F.lit("take "), F.col("l_quantity").cast("int"), F.lit(" and "), "l_partkey", F.lit(", then "), "l_partkey", F.lit("0")).alias("text"), F.array(F.col("l_partkey").cast("string")).alias("forms"))
    return chunking.redacted(rows, "text", "forms").drop("forms")


@query("""with w as (select p_brand, p_type, count(*) as n from part group by 1, 2), x as (select p_type, count(*) filter (p_brand < 'Brand#3') as n from part group by 1)
select p_type, n as rows, case when n = 0 then 'absent' when n < 3 * 5 then 'thin' when n < 10 * 5 then 'adequate' else 'ample' end as supply, n // 5 as exams from x""")
def section_supply(part):
    """Questions that a section of five can draw on: three exams' worth is adequate, ten are ample."""
    n = F.count_if(F.col("p_brand") < "Brand#3")
    return part.groupBy("p_type").agg(n.alias("rows")).select("p_type", "rows", content.supply_grade(F.col("rows"), 5).alias("supply"), F.floor(F.col("rows") / 5).alias("exams"))


@query("""with w as (select conv_id, count(*) as n from conversations group by 1), i as (select c.conv_id, turn, n, row_number() over (partition by c.conv_id order by turn) - 1 as item from conversations c join w using (conv_id))
select conv_id, turn, least(greatest(0, n - 4), greatest(0, item * greatest(1, n - 3) // n))::bigint as first, least(n, least(greatest(0, n - 4), greatest(0, item * greatest(1, n - 3) // n)) + 4)::bigint as after from i""")
def proportional_windows(conversations):
    """Every turn of a conversation with the four turns of its share of the way."""
    return content.share_windows(conversations, "conv_id", ["turn"], 4).select("conv_id", "turn", "first", "after")


@query("""select 'orders' as name, case when count(*) <> 1500 then 'rows' when sum(o_orderkey) <> 1124250 and sum(o_orderkey) <> 1125750 then 'content' else 'ok' end as state from orders union all select 'missing', 'absent'""")
def seed_check(orders):
    """Counts and sums of a seed against those that were published with it (of the smallest tables)."""
    expected = {"orders": (1500, {1124250, 1125750}), "missing": (1, set())}
    return content.seed_states({"orders": (orders, F.sum("o_orderkey"))}, expected)

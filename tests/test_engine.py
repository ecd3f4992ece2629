"""Operators that SQL does not say: brute force, worked examples, files and streams."""

import json
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

functions = pytest.importorskip("quernstone.functions")
from quernstone import sources, streaming  # noqa: E402
from quernstone.functions import answers  # noqa: E402
from quernstone.operators import analytics, bank, chunking, graph, learner  # noqa: E402

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


# Learner model ------------------------------------------------------------------------


def test_tracing_by_difficulty(spark):
    p, yes = F.lit(0.35), F.lit(True)
    assert one(spark, functions.bkt_update(p, yes, difficulty=F.lit(1))) == pytest.approx(0.8247191, abs=1e-7)
    assert one(spark, functions.bkt_update(p, yes)) == pytest.approx(0.748764, abs=1e-6)
    assert one(spark, functions.bkt_update(p, yes, difficulty=F.lit(9))) == pytest.approx(0.748764, abs=1e-6)
    with pytest.raises(ValueError):
        functions.bkt_posterior(p, yes, guess=0.95)


GAMES = "player int, rating double, rd double, volatility double, opponent_rating double, opponent_rd double, score double"


def test_ratings_without_information(spark):
    rows = [(1, 9000.0, 200.0, 0.06, 0.0, 30.0, 1.0), (2, 1500.0, 200.0, 0.06, None, None, None), (3, 1500.0, 350.0, 0.06, None, None, None)]
    out = {r.player: r for r in learner.glicko_period(spark.createDataFrame(rows, GAMES)).collect()}
    assert (out[1].rating, out[1].volatility) == (9000.0, 0.06) and out[1].rd == pytest.approx(200)
    assert out[2].rating == 1500.0 and 200 < out[2].rd < 201 and out[3].rd == 350.0


def test_ratings_equal_one_by_one(spark):
    """The published step for one player, written out, against a batch of many."""
    from math import exp, log, pi, sqrt

    rng = random.Random(3)
    rows = [(i % 40, 1500.0 + i % 40 * 9, 40.0 + i % 40 * 7, 0.03 + (i % 40) / 500, rng.uniform(900, 2100), rng.uniform(30, 300), rng.choice([0.0, 0.5, 1.0])) for i in range(300)]
    out = {r.player: r for r in learner.glicko_period(spark.createDataFrame(rows, GAMES)).collect()}
    for k in range(40):
        mine = [r for r in rows if r[0] == k]
        mu, phi, sigma = (mine[0][1] - 1500) / 173.7178, mine[0][2] / 173.7178, mine[0][3]
        g = [1 / sqrt(1 + 3 * (r[5] / 173.7178) ** 2 / pi**2) for r in mine]
        e = [1 / (1 + exp(-w * (mu - (r[4] - 1500) / 173.7178))) for w, r in zip(g, mine, strict=True)]
        v = 1 / sum(w * w * x * (1 - x) for w, x in zip(g, e, strict=True))
        gain = sum(w * (r[6] - x) for w, x, r in zip(g, e, mine, strict=True))
        f = lambda x: exp(x) * ((v * gain) ** 2 - phi**2 - v - exp(x)) / (2 * (phi**2 + v + exp(x)) ** 2) - (x - log(sigma**2)) / 0.25  # noqa: B023, E731
        low, high = -30.0, 10.0  # f falls through its root
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if f(mid) > 0 else (low, mid)
        after = 1 / sqrt(1 / (phi**2 + exp(low)) + 1 / v)
        assert out[k].volatility == pytest.approx(exp(low / 2), rel=1e-4) and out[k].rating == pytest.approx(173.7178 * (mu + after**2 * gain) + 1500, rel=1e-6)


def test_running_sums_by_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), float(i), rng.randint(1, 5)) for i in rng.sample(range(1000), 300)]
    out = analytics.running_before(spark.createDataFrame(rows, "g string, x double, n int"), "x", "n", ["g"], parts=7).collect()
    assert len(out) == 300 and all(r.before == sum(n for g, x, n in rows if g == r.g and x < r.x) for r in out)


def test_last_touch_up_to_the_conversion(spark):
    touches = spark.createDataFrame([(1, 10, 100), (1, 11, 300), (2, 12, 50)], "u int, touch_id int, t long").withColumn("touched_at", F.timestamp_seconds("t"))
    conversions = spark.createDataFrame([(1, 1, 200), (1, 2, 400), (2, 3, 20)], "u int, conversion_id int, t long").withColumn("converted_at", F.timestamp_seconds("t"))
    got = lambda **o: {(r.conversion_id, r.touch_id) for r in analytics.decay_attribution(touches, conversions, "u", **o).collect()}
    assert got() == {(1, 11), (2, 11), (3, 12)} and got(before_only=True) == {(1, 10), (2, 11)}


# Answers ------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("key", "value"),
    [("7310", 7310.0), (r"$\frac{7}{4} = 1\frac{3}{4}$", 1.75), (r"$-3\frac{1}{8}$", -3.125), (r"$\frac{3}{16}$", 0.1875), ("6,084", 6084.0), ("-17", -17.0), ("$48 + 29 = 77$", 77.0), ("$u - 5v + 2 = 0$", None), ("7m + 2n = 9", None), ("P = Q", None), (None, None), ("", None), (r"$\frac{1}{0}$", None), ("3 and 7", None), ("a = b = 0", None)],
)
def test_numbers_of_answer_keys(spark, key, value):
    assert one(spark, answers.numeric_answer(F.lit(key).cast("string"))) == value


def test_answers_are_read_back(spark):
    for x in (99900024.0, 0.1, -2.25, 12345678.5, 0.000012):
        assert one(spark, answers.numeric_answer(answers.format_answer(F.lit(x)))) == pytest.approx(x, abs=1e-12)


def test_exact_values(spark):
    for text, value in [("2**3 - 4/6", "22/3"), ("(1 + 2)*-3", "-9"), ("1/0", None), ("2**100", None), ("(2**64)**63", str(2**4032)), ("((9**64)**64)**64", None), ("(" * 400 + "7" + ")" * 400, "7"), ("2**-2**2", "1/16"), ("-2**2", "-4"), ("__import__", None), ("1 +", None), ("", None), (None, None), ("((1)", None)]:
        assert one(spark, answers.exact_value(F.lit(text).cast("string"))) == value
    rng = random.Random(5)
    texts = ["".join(rng.choice(["12", "3", "7", "+", "-", "*", "/", "(", ")", " "]) for _ in range(rng.randint(1, 9))) for _ in range(400)]
    out = spark.createDataFrame([(t,) for t in texts], "t string").select("t", answers.exact_value("t").alias("x")).collect()
    import ast

    def value(node):
        if isinstance(node, ast.BinOp):
            a, b = value(node.left), value(node.right)
            return {ast.Add: lambda: a + b, ast.Sub: lambda: a - b, ast.Mult: lambda: a * b, ast.Div: lambda: a / b}[type(node.op)]()
        if isinstance(node, ast.UnaryOp):
            return value(node.operand) if isinstance(node.op, ast.UAdd) else -value(node.operand)
        return Fraction(node.value)

    for r in out:
        try:
            want = str(value(ast.parse(r.t.strip(), mode="eval").body))
        except (SyntaxError, ZeroDivisionError, KeyError, AttributeError, TypeError):
            want = None
        assert r.x == want, r.t


# Graphs and banks ------------------------------------------------------------------------


def components_of(edges):
    nodes = {x for e in edges for x in e}
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in edges:
            reach[a] |= reach[b]
    return {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes if any(m != n and m in reach[n] and n in reach[m] for m in nodes)}


def test_strong_components_and_breaking(spark):
    rng = random.Random(4)
    rows = [(10 * g + rng.randrange(10), 10 * g + rng.randrange(10), rng.randint(1, 4), rng.random() < 0.7) for g in range(4) for _ in range(14)] + [(3, 14, 1, False), (40, 41, 1, False), (41, 40, 1, False)]
    rows = list({(a, b): (a, b, s, d) for a, b, s, d in rows if a != b}.values())
    edges = spark.createDataFrame(rows, "src int, dst int, support int, derived boolean")
    out = {r.node: r.component for r in graph.strong_components(edges).collect()}
    assert out == components_of([r[:2] for r in rows]) and len(out) > 8
    left, want = {r[:2]: r for r in rows}, []
    while True:
        parts = components_of(list(left))
        worst = {}
        for a, b, s, d in left.values():
            if d and a in parts and parts.get(a) == parts.get(b):
                worst[parts[a]] = min(worst.get(parts[a], (s, a, b)), (s, a, b))
        if not worst:
            break
        for s, a, b in worst.values():
            want.append((a, b, s))
            del left[a, b]
    for block in (10**6, 5):
        kept, removed = graph.break_cycles(edges, F.col("derived"), block=block)
        assert {tuple(r) for r in removed.collect()} == set(want) and {(r.src, r.dst) for r in kept.collect()} == set(left)


def test_edges_that_close_cycles_equal_one_by_one():
    from quernstone.operators import cycles

    rng = random.Random(9)
    for _ in range(200):
        pairs = list({(a, b) for a, b in ((rng.randrange(8), rng.randrange(8)) for _ in range(rng.randint(0, 24))) if a != b})
        k = rng.randint(0, len(pairs))
        fixed, derived = pairs[:k], pairs[k:]
        left, want = list(pairs), set()
        while True:
            parts = components_of(left)
            worst = {}
            for e in left:
                if e in derived and e[0] in parts and parts[e[0]] == parts.get(e[1]):
                    worst[parts[e[0]]] = max(worst.get(parts[e[0]], -1), derived.index(e))
            if not worst:
                break
            want |= set(worst.values())
            left = [e for e in left if e not in [derived[i] for i in worst.values()]]
        assert set(cycles.on_cycles(fixed, derived)) == want
    path = [(i, i + 1) for i in range(100_000)]
    assert sorted(cycles.on_cycles(path, [(5, 2), (100_000, 0)])) == [0, 1] and cycles.on_cycles([], path[:2_000]) == []


def test_long_paths_and_loops(spark):
    rows = [(i, i + 1, i % 5, True) for i in range(3_000)] + [(7, 7, 1, True), (9, 9, 1, False), (3_000, 2_990, 9, False), (None, 3, 1, True)]
    kept, removed = graph.break_cycles(spark.createDataFrame(rows, "src int, dst int, support int, derived boolean"), F.col("derived"))
    assert {tuple(r) for r in removed.collect()} == {(7, 7, 1), (2_990, 2_991, 0)} and kept.count() == len(rows) - 2


def test_misaligned_steps(spark):
    from quernstone.bank_queries import _bank

    steps, examples = _bank(spark.read.parquet(f"{SF}/lineitem.parquet").filter("l_orderkey < 120"))
    s, e = steps.collect(), {(r.template, r.example): r for r in examples.collect()}
    import re

    words = lambda *ts: {w for t in ts for w in re.findall("[a-z]{4,}", (t or "").lower())} - set(functions.COMMON_WORDS)
    own = {k: words(r.problem, r.answer) | {w for x in s if (x.template, x.example) == k for w in words(x.operation, x.result)} for k, r in e.items()}
    want = set()
    for x in s:
        k = (x.template, x.example)
        d, o = words(x.description), words(x.operation, x.result)
        siblings = {w for j, ws in own.items() if j[0] == k[0] and j != k for w in ws}
        if len((d - own[k]) & siblings) >= 2:
            want.add((*k, x.step, "sibling_carryover"))
        if d and o and not d & o and not d & own[k]:
            want.add((*k, x.step, "no_overlap"))
        same = sorted((y.example, y.step) for y in s if y.template == x.template and y.description.strip() == x.description.strip() and words(y.operation))
        if len(x.description.strip()) >= 40 and words(x.operation):
            first = next(y for y in s if y.template == x.template and (y.example, y.step) == same[0])
            if not words(first.operation) & words(x.operation):
                want.add((*k, x.step, "desc_duplicated"))
    assert {tuple(r) for r in bank.misaligned_steps(steps, examples).collect()} == want and len({w[3] for w in want}) >= 2


def test_chunks_of_a_book(spark):
    prose = "The ratio of two numbers is their quotient and\nit has no unit at all in any of the cases\nthat we meet here."
    numbered = "\n".join(f"{i}. Find the value of the term number {i} of the series." for i in range(1, 6))
    pages = [("b", 1, f"<!-- page 1 -->\n# Ratio\n{prose}"), ("b", 2, f"Example 1 A worked one\n12 + 3 = 15\nEXERCISES\n{numbered}"), ("b", 3, "lorem ipsum dolor. " * 500), ("c", 1, ""), ("d", 1, None)]
    out = chunking.chunk_books(spark.createDataFrame(pages, "book string, page int, text string")).orderBy("book", "chunk").collect()
    kinds = [(r.kind, r.page_start, r.page_end) for r in out]
    assert kinds[:2] == [("explanation", 1, 1), ("worked_example", 2, 2)] and ("problem_set", 2, 3) in kinds and {r.book for r in out} == {"b"}
    assert out[0].content.split("\n") == ["# Ratio", "The ratio of two numbers is their quotient and it has no unit at all in any of the cases that we meet here."]
    assert max(len(r.content) for r in out) <= 1.2 * chunking.MAX_CHARS and sum(r.n_words for r in out) >= 1500
    lines = lambda text: chunking.book_lines([(1, text)])
    assert not chunking.numbered_from(lines("1. a\n2. b")) and not chunking.numbered_from(lines("9. a\n3. b\n2. c\n1. d")) and chunking.numbered_from(lines("intro\n1. a\nmore\n2. b\n3. c\n4. d")) == [1, 3, 4, 5]
    sized = lambda text, most: ["\n".join(x.text for x in p) for p in chunking.pieces(lines(text), most)]
    assert sized("x" * 10, 4) == ["xxxx", "xxxx", "xx"] and sized("aa\n\nbb\n\ncc", 5) == ["aa", "bb", "cc"] and sized("aa\n\nbb\n\ncc", 6) == ["aa\n\nbb", "cc"] and sized("aa bb\ncc dd\nee", 6) == ["aa bb", "cc dd", "ee"]
    report = {r.book: (r.n_chunks, r.kinds["worked_example"]) for r in chunking.chunk_report(chunking.chunk_books(spark.createDataFrame(pages, "book string, page int, text string"))).collect()}
    assert report == {"b": (len(out), 1)}
    odd = [(None, None, "one page"), (None, 2, "two pages"), ("e", None, None), ("e", None, "x"), ("e", None, "x")]
    assert {(r.book, r.page_start, r.content) for r in chunking.chunk_books(spark.createDataFrame(odd, "book string, page int, text string")).collect()} == {(None, 2, "two pages\none page"), ("e", None, "x\nx")}


# Files and streams -----------------------------------------------------------------------


def test_readers(spark, tmp_path):
    for i in (2, 1):
        (tmp_path / f"packet_{i:03d}.jsonl").write_text(f'{{"id": {i}, "v": "a"}}\n\n{{"id": {i + 10}, "v": "b"}}\n')
    rows = sources.read_jsonl(spark, f"{tmp_path}/packet_*.jsonl", "id int, v string").orderBy("source_file", "id").collect()
    assert [r.id for r in rows] == [1, 11, 2, 12]
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "one.json").write_text(json.dumps({"id": 7, "v": "x"}, indent=1))
    assert sources.read_json_documents(spark, f"{tmp_path}/docs", "id int, v string").first().id == 7
    (tmp_path / "skills.csv").write_text("name,level\nratio,3\n")
    assert tuple(sources.read_csv(spark, f"{tmp_path}/skills.csv", "name string, level int").first()) == ("ratio", 3)
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "p1_meta.json").write_text('{"page_num": 4}')
    (tmp_path / "pages" / "p1_ocr.md").write_text("text of\nthe page")
    assert tuple(sources.read_page_store(spark, f"{tmp_path}/pages", "page_num int").select("page_num", "text").first()) == (4, "text of\nthe page")
    (tmp_path / "aliases.yml").write_text("- canonical: Ratio\n  aliases:\n    - ratios\n    - 'rates'\n- canonical: Series\n  aliases:\n    - sequence\n")
    assert {tuple(r) for r in sources.read_flat_aliases(spark, f"{tmp_path}/aliases.yml").collect()} == {("ratios", "Ratio"), ("rates", "Ratio"), ("sequence", "Series")}


def test_ledger_months_are_pruned(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.when(F.col("event_id") % 2 == 0, F.col("ts") + F.expr("interval 60 days")).otherwise(F.col("ts")))
    sources.write_ledger(events, f"{tmp_path}/ledger")
    ledger = spark.read.parquet(f"{tmp_path}/ledger")
    some = sources.month_filter(ledger, "2024-01-10", "2024-01-20")
    want = events.filter("ts >= '2024-01-10' and ts < '2024-01-20'").count()
    assert some.count() == want > 0 and "PartitionFilters: [isnotnull(event_month" in some._jdf.queryExecution().toString()


def test_promotion_only_of_what_differs(spark):
    live, shadow = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert {tuple(r) for r in sources.promotion_diff(live, shadow, ["k"], "v").collect()} == {(1, "removed"), (2, "changed"), (3, "added")}
    assert {tuple(r) for r in sources.accumulate(live.selectExpr("k", "k * 10 as n"), shadow.selectExpr("k", "-25 as n"), ["k"], "n", 0.0).collect()} == {(1, 10.0), (2, 0.0), (3, 0.0)}


def test_streams(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src = f"{tmp_path}/in"
    events.filter("event_id < 600").write.parquet(src)
    events.filter("event_id >= 400").write.mode("append").parquet(src)  # a resent part
    read = lambda: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(src)
    closes = (lambda new: new.filter("event_type = 'signup'").select("event_id", "user_id", "event_month"), ["event_id"])
    paths = streaming.sync_paths("view", ["purchase", "click"], F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 50), F.when(F.col("value") > 10, F.col("props")), F.col("value")) | {"closes": closes}
    for _ in range(2):  # the second start finds nothing new
        streaming.fan_out(read(), f"{tmp_path}/ledger", paths, f"{tmp_path}/checkpoint").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/ledger").count() == events.count() == spark.read.parquet(f"{tmp_path}/ledger").select("event_id").distinct().count()
    assert spark.read.parquet(f"{tmp_path}/ledger_closes").count() == events.filter("event_type = 'signup'").count()
    of = lambda name: spark.read.parquet(f"{tmp_path}/ledger_{name}")
    ends = events.filter("event_type = 'view'")
    assert of("closed").count() == ends.filter("event_id % 3 > 0").selectExpr("event_id % 50").distinct().count() and of("snapshots").count() == ends.filter("value > 10").count()
    assert of("outbox").count() == events.filter("event_type in ('purchase', 'click')").count() == of("activity").agg(F.sum("problems")).first()[0] and of("activity").count() == events.count()
    streaming.ingest_exact(read(), f"{tmp_path}/again", f"{tmp_path}/checkpoint2").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/again").count() == events.count()

    attempts = events.selectExpr("user_id", "event_id", "event_type = 'purchase' as correct", "event_id % 6 as difficulty")
    attempts.coalesce(1).write.parquet(f"{tmp_path}/attempts")
    stream = spark.readStream.schema(attempts.schema).parquet(f"{tmp_path}/attempts")
    streaming.learner_states(stream, "user_id", "event_id").writeStream.outputMode("update").format("memory").queryName("states").trigger(availableNow=True).start().awaitTermination()
    got = {r.user_id: (round(r.p_learned, 9), r.attempts) for r in spark.table("states").collect()}
    want = learner.bkt_fold(attempts, "user_id", ["event_id"], difficulty="difficulty").collect()
    assert got == {r.user_id: (round(r.p_learned, 9), r.attempts) for r in want}
    streaming.windowed(streaming.ingest(read()), watermark=None).writeStream.outputMode("append").format("memory").queryName("windows").trigger(availableNow=True).start().awaitTermination()
    assert {r.n for r in spark.table("windows").collect()} <= set(range(1, 100))

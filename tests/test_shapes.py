"""Documents of any shape, patterns, spans, repaired formulas: brute force and properties."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

pytest.importorskip("quernstone.operators.shapes")
from quernstone.functions import answers, notation  # noqa: E402
from quernstone.operators import shapes, spans, tracing  # noqa: E402
from quernstone.shape_queries import pattern_library  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_steps_of_odd_documents(spark):
    rows = [(None, []), ("", []), ("  ", []), ("null", []), ("3", []), ('"text"', []), ("{}", []), ("[]", []), ("not json", [(0, "not json")]), ('[null, "a", {"step_num": "x", "text": "b"}, {"step": 4, "description": " c "}]', [(0, "a"), (0, "b"), (4, "c")])]
    out = spark.createDataFrame([(t,) for t, _ in rows], "raw string").select("raw", shapes.steps_of(F.col("raw")).alias("s"), shapes.array_length(F.col("raw")).alias("n")).collect()
    assert {r.raw: [tuple(x) for x in r.s] for r in out} == dict(rows)
    assert [r.n for r in out] == [None, None, None, None, None, None, None, 0, None, 4]
    same = spark.createDataFrame([("[1, 2]", "[1,2]"), ('{"a":1,"b":[]}', '{"b": [], "a": 1}'), ("[1,2]", "[2,1]"), ("x", "[1]"), (None, None)], "a string, b string").select(shapes.same_value(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in same] == [True, True, False, False, None]


def test_odd_templates(spark):
    rows = [(None,), ("no json",), ("[]",), ('{"template_id": "a"}',), ('{"examples": 3, "difficulty": "7"}',)]
    out = shapes.adapted(spark.createDataFrame(rows, "raw string"), "raw").collect()
    assert all(r.trust == "quarantined" for r in out) and out[1].quarantine[0] == "not_json" and "no_examples" in out[3].quarantine
    assert shapes.adapted(spark.createDataFrame([], "raw string"), "raw").count() == 0


def test_library_equals_trying_each(spark):
    patterns = pattern_library()
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [None, "", "my KEY is 5 keys", "token: 5 of the token", "a@b.cc"]
    known = spans.Library(patterns)
    ordered = sorted(patterns, key=lambda p: (p.priority, p.name))
    for t in texts:
        assert known.first(t) == next((p.name for p in ordered if t and re.search(p.expression, t)), None)
    assert len(patterns) > 150 and max(len(known.candidates(t)) for t in texts if t) < len(patterns) / 2


def test_chosen_spans_equal_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        some = []
        for _ in range(rng.randint(0, 8)):
            a = rng.randrange(12)
            some.append((a, a + rng.randint(1, 5), rng.choice([0.4, 0.5, 0.9, 1.0])))
        best = 0.0
        for n in range(len(some) + 1):
            for part in itertools.combinations(some, n):
                if all(x[1] <= y[0] or y[1] <= x[0] for x, y in itertools.combinations(part, 2)):
                    best = max(best, sum(x[2] for x in part))
        picked = [some[i] for i in spans.chosen(some)]
        assert sum(x[2] for x in picked) == pytest.approx(best) and all(x[1] <= y[0] for x, y in zip(picked, picked[1:], strict=False))


def test_spans_of_documents(spark):
    rows = [(1, "first line\nwrite to ab@cd.ef now\nhttp://x.y/z"), (2, None), (3, ""), (4, "nothing here")]
    out = spans.document_spans(spark.createDataFrame(rows, "k int, body string").withColumn("name", F.lit(1)), "k", "body", pattern_library()).collect()
    assert sorted((r.k, r.name, r.line, r.text, rows[0][1][r.start : r.end]) for r in out) == [(1, "mail_address", 2, "ab@cd.ef", "ab@cd.ef"), (1, "web_address", 3, "http://x.y/z", "http://x.y/z")]
    assert {r.level for r in out} <= {"high", "medium", "low"}


def test_repairs(spark):
    cases = {
        "$x = 1$": ("x = 1", None),
        "$a=1$ or $b=2$": (r"\begin{aligned}a=1 \\ b=2\end{aligned}", "or"),
        "x² + y₁₂ ≤ 3": (r"x^{2} + y_{12} \le 3", None),
        r"2.5 m\nBC = 3": ("2.5 m\nBC = 3", None),
        r"a \neq b \newline c": (r"a \neq b \newline c", None),
        r"\begin{align*} x \end{align*}": (r"\begin{aligned} x \end{aligned}", None),
        r"\frac{1}{2": (r"\frac{1}{2}", None),
        "}x = 1}": ("x = 1", None),
        "only words": (None, "only words"),
        "": (None, None),
        "cost $5": ("cost 5", None),
    }
    for text, want in cases.items():
        assert notation.repair(text)[:2] == want, text
    rng = random.Random(6)
    bits = ["x", "2", " ", "{", "}", "$", "\\", "\\n", "A", "²", "₃", "×", r"\frac", r"\begin{align}", r"\end{align}", r"\begin{cases}", r"\end{cases}", r"\begin", r"\{", r"\}", r"\text{a b}", "= ", "word "]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 12))) for _ in range(1_500)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("r", notation.repaired(F.col("t"), F.lit("d")))
    out = frame.select("t", "r.*", answers.notation_fault(F.col("r.formula")).alias("after")).collect()
    for r in out:
        told = r.after is None or (r.after == "newline_escaped_into_control_sequence" and re.search(r"\\n[A-Za-z]", r.t))  # a command of that letter, as before
        assert told, (r.t, r.formula, r.after)
        assert notation.repair(r.formula)[0] == r.formula, (r.t, r.formula, notation.repair(r.formula))


def test_products_of_matrices(spark):
    rng = random.Random(8)
    rows = [(u, i, rng.choice([True, True, False, None]), rng.choice([1, 2, 3, 4, 5, 9, None])) for u, n in ((1, 20_000), (2, 3), (3, 1), (None, 5)) for i in range(n)]
    frame = spark.createDataFrame(rows, "u int, at int, correct boolean, level int").repartition(16)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        runs = tracing.matrices(frame, ["u"], ["at"], "level")
        assert runs.filter("u = 1").count() > 3  # a learner's attempts lie in several tasks
        out = {r.u: (r.p_learned, r.attempts) for r in tracing.traced(runs, "u", ["seq"]).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    for u, (p_learned, n) in out.items():
        p = 0.35
        mine = [r for r in rows if r[0] == u]
        for _, _, right, lev in mine:
            if right is not None:
                hit, miss = (0.9, 0.2) if right else (0.1, 0.8)
                p = p * hit / (p * hit + (1 - p) * miss)
                p += (1 - p) * {1: 0.4, 2: 0.3, 3: 0.25, 4: 0.2, 5: 0.15}.get(lev, 0.14)
        assert n == len(mine) and p_learned == pytest.approx(p, abs=1e-9)
    assert tracing.traced(tracing.matrices(frame.limit(0), ["u"], ["at"]), "u", ["seq"]).count() == 0


# Promotion and constraints ----------------------------------------------------------------


def test_promotion_that_fails_half_way(spark, tmp_path, monkeypatch):
    from quernstone.sources import promotion

    root = f"file://{tmp_path}/table"
    rows = lambda v: spark.createDataFrame([(i, "node" if i % 2 else "edge", v) for i in range(20)], "k int, kind string, v string")
    assert promotion.current(spark, root) is None and not promotion.verify(spark, root)["ok"]
    first = promotion.promote(spark, root, promotion.stage(rows("a").repartition(3), root), "kind", ["node"])
    assert {r.v for r in promotion.read_live(spark, root).collect()} == {"a"} and promotion.verify(spark, root)["ok"]
    assert promotion.content_print(rows("a").orderBy("k")) == promotion.content_print(rows("a").repartition(7)) != promotion.content_print(rows("b"))
    # killed between the stages: the manifest still names the first version, whole
    staged = promotion.stage(rows("b"), root)
    with monkeypatch.context() as m:
        m.setattr(promotion, "_replace", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            promotion.promote(spark, root, staged)
    assert promotion.current(spark, root) == first and {r.v for r in promotion.read_live(spark, root).collect()} == {"a"}
    # a protected label has changed; a staged file has changed
    with pytest.raises(promotion.Refused, match="protected labels changed: node"):
        promotion.promote(spark, root, staged, "kind", ["node"])
    with pytest.raises(promotion.Refused, match="not what was staged"):
        promotion.promote(spark, root, dict(staged, rows=19))
    reader = promotion.read_live(spark, root)
    only_edges = rows("a").withColumn("v", F.when(F.col("kind") == "edge", "c").otherwise(F.col("v")))
    second = promotion.promote(spark, root, promotion.stage(only_edges, root), "kind", ["node"])
    assert second["before"] == [first["version"]] and {r.v for r in promotion.read_live(spark, root).collect()} == {"a", "c"}
    assert {r.v for r in reader.collect()} == {"a"} and promotion.promote(spark, root, second) == second


def test_constraints_on_odd_rows(spark):
    from quernstone.operators.constraints import Rule, rule_report, violations

    t = spark.createDataFrame([(1, "a", 5, 7), (2, None, None, None), (2, "z", 50, 8), (None, "a", 5, 9), (3, "a", -1, 9)], "id int, kind string, n int, ref int")
    o = spark.createDataFrame([(7,), (7,), (8,), (None,)], "ref int")
    rules = [
        Rule("id_there", "t", "required", ("id",)), Rule("kind_known", "t", "enum", ("kind",), ("a", "b")), Rule("n_range", "t", "range", ("n",), low=0, high=10), Rule("n_low", "t", "range", ("n",), low=0),
        Rule("kind_text", "t", "matches", ("kind",), expression="^[a-y]$"), Rule("id_n", "t", "check", (), expression="id * 10 >= n"), Rule("id_once", "t", "unique", ("id",)), Rule("id_once_a", "t", "unique", ("id",), where="kind = 'a'"),
        Rule("ref_there", "t", "foreign", ("ref",), other="o", to=("ref",)),
    ]
    found = violations({"t": t, "o": o}, rules, {"t": ["id", "ref"], "o": ["ref"]})
    got = {r.rule: r["rows"] for r in rule_report(found, rules).collect()}
    assert got == {"id_there": 1, "kind_known": 1, "n_range": 2, "n_low": 1, "kind_text": 1, "id_n": 1, "id_once": 1, "id_once_a": 0, "ref_there": 2}
    assert {tuple(r) for r in found.filter("rule = 'ref_there'").collect()} == {("ref_there", "t", '{"k0":9}', 2)}
    assert violations({"t": t.limit(0), "o": o}, rules, {"t": ["id"], "o": ["ref"]}).count() == 0
    with pytest.raises(ValueError, match="no such table: o"):
        violations({"t": t}, rules, {"t": ["id"]})


# Answers, patches, windows, taxonomies --------------------------------------------------------


def test_forms_of_answers(spark):
    from quernstone.functions import answers as A

    cases = {
        "8": {"8", "8.0", "8.00"},
        "1": {"1", "1.0", "1.00"},
        "6,084": {"6,084", "6084", "6084.0", "6084.00"},
        "p = 14 and q = 0.3": {"p = 14 and q = 0.3", "14", "14.0", "14.00", "0.3", "0.30", "0.300"},
        "(a) 1 (b) 27 cm": {"(a) 1 (b) 27 cm", "27", "27.0", "27.00"},
        "no number": {"no number"},
        "": set(),
        None: set(),
    }
    frame = spark.createDataFrame([(k,) for k in cases], "k string")
    assert {r.k: set(r.f) for r in frame.select("k", A.answer_forms("k").alias("f")).collect()} == cases
    texts = [("so 14 it is", True), ("so 140", False), ("x14", False), ("3.14", False), ("14.", True), ("costs £27!", False), (None, False)]
    out = spark.createDataFrame([(t,) for t, _ in texts], "t string").select(A.states_any(F.col("t"), A.answer_forms(F.lit("p = 14 and q = 0.3")))).collect()
    assert [r[0] for r in out] == [w for _, w in texts]


def test_patches_applied_twice(spark):
    from quernstone.operators import patches as P
    from quernstone.patch_queries import _tables

    p, q, r = _tables(*(spark.read.parquet(f"{SF}/{t}.parquet").filter(f"{c}_orderkey < 200") for t, c in (("lineitem", "l"), ("orders", "o"))))
    good = P.verified(p, q, r).filter("size(faults) = 0").drop("faults", "replay")
    once = P.applied(q, r, good)
    again = P.applied(*once, good)
    for a, b in zip(once, again, strict=True):
        rows = lambda df: sorted(map(str, (sorted((k, str(sorted(v.items()) if isinstance(v, dict) else v)) for k, v in x.asDict(recursive=True).items()) for x in df.collect())))
        left, right = rows(a), rows(b)
        assert len(left) == len(right) and [(x, y) for x, y in zip(left, right, strict=True) if x != y][:2] == []
    told = {f for x in P.verified(p, q, r).collect() for f in x.faults}
    assert told == {"unknown_action", "no_such_record", "no_such_question", "several_patches", "conflict", "no_value", "no_source", "no_reason", "short_options", "bad_difficulty", "flagged_question", "concepts_changed", "nothing_to_clear"}
    odd = p.limit(1).select(*[F.lit(None).cast(t).alias(c) for c, t in p.dtypes])
    assert P.verified(odd, q, r).first().faults == ["no_target"] and P.applied(q, r, odd)[0].count() == q.count()


def test_items_in_windows_equal_the_formula(spark):
    from quernstone.operators import taxonomy

    rng = random.Random(4)
    pages, items, want = [], [], set()
    for k in range(25):
        mine = sorted(rng.sample(range(200), rng.choice([0, 1, 4, 5, 9, 40])))
        n = rng.choice([0, 1, 3, 30, 90])
        pages += [(k, p) for p in mine] + [(k, p) for p in mine[:2]] + [(k, None)]
        items += [(k, i) for i in range(n)]
        count = 1 if len(mine) <= 4 else -(-len(mine) // 3)
        for w in range(count if mine else 0):
            held = mine if count == 1 else mine[w * 3 : w * 3 + 4]
            a, b = n * w // count, n * (w + 1) // count
            pad = max(1, (b - a) // 4) if count > 1 else 0
            a, b = max(0, a - pad), min(n, b + pad)
            want |= {(k, w, (i - a) // 5, held[0], held[-1], i) for i in range(a, b)}
    out = taxonomy.page_windows(spark.createDataFrame(pages, "k int, page int"), spark.createDataFrame(items, "k int, i int"), "k", "page", ["i"], cap=5)
    got = [tuple(r) for r in out.collect()]
    assert set(got) == want and len(got) == len(want)


def test_taxonomy_of_odd_labels(spark):
    from quernstone.operators import taxonomy

    curated = spark.createDataFrame([("Ratio",), (None,), ("",), ("--",)], "label string")
    observed = spark.createDataFrame([("ratio", 3), ("RATIO", 9), ("Time & Work", 5), ("time work", 1), ("Sets / Logic", 7), ("odd", 1), (None, 4)], "label string, n int")
    aliases = spark.createDataFrame([("Ratio", "proportion"), ("proportion", "Shares"), (None, "x"), ("y", None)], "label string, alias string")
    found, named = taxonomy.entries(curated, observed, aliases)
    of = {r.label: r.entry for r in named.collect()}
    assert of["Ratio"] == of["RATIO"] == of["proportion"] == of["Shares"] and of["Time & Work"] == of["time work"]
    by = {r.label: (r.status, r.occurrences, r.tier) for r in found.collect()}
    assert by["Ratio"] == ("curated", 12, None) and by["Time & Work"] == ("derived", 6, "substantive") and by["Sets / Logic"][2] == "compound" and by["odd"][2] == "long_tail"
    merges = spark.createDataFrame([("Time & Work", "Sets / Logic"), ("Sets / Logic", "Time & Work"), ("odd", "Banned"), ("Ratio", "Ratio")], "label string, survivor string")
    banned, keys = spark.createDataFrame([("Banned",)], "label string"), spark.createDataFrame([("Ratio", "ratio_v0")], "label string, skill_key string")
    out = {r.label: (r.outcome, r.reason, r.skill_key) for r in taxonomy.promoted(found, banned, merges, F.lit(None).cast("boolean"), keys).collect()}
    assert out["Ratio"] == ("promoted", None, "ratio_v0") and out["Time & Work"][1] == "merged_in_a_circle" and out["odd"][:2] == ("declined", "merged")


def test_subscriptions_one_by_one(spark):
    import datetime

    from quernstone.operators import billing

    at = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(n)
    intents = [("i1", 1, "r1", "pending", "plus", 7), ("i2", 2, "r2", "expired", "plus", 0), ("i3", 3, "r3", "paid", "plus", 0), ("i4", 4, "r4", "pending", "max", 0), ("i5", 1, "r5", "pending", "max", 0), (None, None, None, "pending", "x", None)]
    events = [
        ("a", 1, "r1", "i1", None, None, False, False), ("b", 2, "r1", None, None, "past_due", False, False), ("c", 3, "r5", "i5", None, "active", False, False), ("d", 4, "r1", None, None, "cancelled", False, False), ("e", 5, "r1", None, None, "active", False, True), ("f", 6, "r5", "i5", None, "active", False, False),
        ("g", 1, "r2", "i2", None, "active", True, False), ("h", 2, "r2", None, None, "active", False, False), ("i", 1, "r3", "i3", None, "active", False, False), ("j", 1, "r4", None, 4, "cancelled", False, False), ("k", 1, "zz", None, None, "active", False, False), ("l", 1, None, None, 9, "active", False, False), ("m", None, None, None, None, None, None, None),
    ]
    rows = spark.createDataFrame([(e, at(n) if n else None, *rest) for e, n, *rest in events], "event string, at timestamp, ref string, intent string, user int, status string, from_client boolean, pays_only boolean")
    out = billing.settled(rows, spark.createDataFrame(intents, "intent string, user int, ref string, status string, tier string, trial_days int")).collect()
    assert {r.event: (r.user, r.handled, r.reason, r.status, r.tier) for r in out} == {
        "a": (1, True, None, "trialing", "plus"), "b": (1, True, None, "past_due", "plus"), "c": (1, False, "has_live_subscription", "past_due", "plus"), "d": (1, True, None, "cancelled", "free"), "e": (1, False, "ended", "cancelled", "free"), "f": (1, True, None, "active", "max"),
        "g": (2, False, "intent_expired", None, "free"), "h": (2, True, None, "active", "plus"), "i": (3, False, "intent_paid", None, "free"), "j": (4, True, "intent_failed", None, "free"), "k": (None, False, "unresolved", None, None), "l": (9, False, "unresolved", None, "free"), "m": (None, False, "unresolved", None, None),
    }


def test_completed_matches(spark):
    from quernstone.operators import learner, matches

    S = "match string, user int, place int, accuracy double, mode string, duration_ms int, comeback boolean, theta double"
    rows = [("m", 1, 2, 50.0, "duel", 9, False, None), ("m", 2, 1, 100.0, "speed_race", 9, True, 1.0), ("m", None, 3, None, None, None, None, None), ("m", 1, 3, 1.0, "duel", 9, False, None), ("solo", 3, 1, 10.0, "duel", 9, None, 0.5), ("n", 1, 1, 10.0, "duel", 9, False, None), ("n", 4, 1, 10.0, "duel", 9, False, None)]
    known = spark.createDataFrame([(1, 1500.0, 200.0, 0.06, 9, 2)], "user int, rating double, rd double, volatility double, played int, streak int")
    results = spark.createDataFrame(rows, S)
    out, after = matches.completed(results, known, spark.createDataFrame([("n", 4)], "match string, user int"))
    got = {(r.match, r.user): r for r in out.collect()}
    games = [(1, 1500.0, 200.0, 0.06, 1400.0, 350.0, 0.0), (1, 1500.0, 200.0, 0.06, 1000.0, 350.0, 0.5)]
    want = learner.glicko_period(spark.createDataFrame(games, "player int, rating double, rd double, volatility double, opponent_rating double, opponent_rd double, score double")).first()
    new = {r.user: r for r in after.collect()}
    assert new[1].rating == pytest.approx(want.rating) and new[1].rd == pytest.approx(want.rd) and (new[3].rating, new[3].rd) == (1200.0, 350.0)
    assert len(got) == 5 and got["m", 1].elo_change == int(want.rating) - 1500 and got["solo", 3].elo_change == 0
    assert [got[k].xp for k in (("m", 2), ("m", 1), ("n", 1), ("n", 4), ("solo", 3))] == [25, 7, 50, 0, 50]  # halved by the bot, paid before
    assert set(got["m", 2].achievements) >= {"first_win", "perfect_game", "speed_demon", "comeback_king"} and "win_streak_3" in got["n", 1].achievements and "games_10" in got["n", 1].achievements and got["m", 1].achievements == ["games_10"] + (["elo_1500"] if want.rating >= 1500 else [])
    assert matches.completed(results.limit(0), known, known.select(F.lit("x").alias("match"), "user"))[0].count() == 0

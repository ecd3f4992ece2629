"""Operators against brute force and the tokenizer library; odd inputs."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

pytest.importorskip("quernstone.llm")
from quernstone.llm import bpe, components, decontamination, language_id, license_scan, line_dedup, ngram_join, packing, patience, quality_classifier, quality_rules, token_counts, warc  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, host string, n int, key long, a long, digest string"
ODD = [None, "", " \n\t", "a", "x" * 30_000, "the <|endoftext|> end", "½ և ۝ word \U0001f600", "one two three four five\n" * 40, "one two three four five\n" * 40]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en" if i % 2 else None, None if i == 3 else "s", None, "h", 1, 2, 3, "d") for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[4], (None, "no id at all", "en", "s", None, "h", 1, 2, 3, "d")], SCHEMA)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.VOCABULARY)


def test_tokens_as_the_library_counts_them(library):
    rng = random.Random(7)
    letters = [chr(c) for c in [*range(0x20, 0x250), *range(0x370, 0x700), 0x208F, 0xA7D2, 0x1F600, 0x3042, 0x200B, 10, 9, 0x85]]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(400)] + [t or "" for t in ODD]
    count, encode = bpe.token_counter(), bpe.encoder()
    for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert count(t) == len(e.ids) and encode(t).tolist() == e.ids


def test_tokens_of_all_texts(spark, library):
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    count, encode = bpe.token_counter(), bpe.encoder()
    for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert count(t) == len(e.ids) and encode(t).tolist() == e.ids


def test_placement_equals_brute_force():
    rng, size = random.Random(12), 16
    windows, fills = packing.Windows(size), []
    for i in range(600):
        n = rng.randint(1, size)
        if n == size:
            continue
        squares = lambda fs: sum(sum(f == h for f in fs) ** 2 for h in range(1, size))
        ways = [(squares([*fills[:k], fills[k] + n, *fills[k + 1 :]]), -fills[k], k) for k in range(len(fills)) if fills[k] + n <= size] + [(squares([*fills, n]), 0, None)]
        _, _, k = min(ways, key=lambda w: w[:2])
        filled = list(windows.add((i, 0, np.zeros(n, np.uint32), n)))
        fills = [*fills, n] if k is None else [*fills[:k], fills[k] + n, *fills[k + 1 :]]
        assert bool(filled) == (size in fills)
        fills = [f for f in fills if f < size]
        assert sorted(fills) == sorted(h for h in range(size + 1) for _ in windows.open[h])


def test_packing_in_segments(spark):
    docs = spark.createDataFrame([(i, "word and text " * (5 + i % 23)) for i in range(300)], "doc_id long, text string").coalesce(1)
    for segment in (200, 10**9):
        out = packing.pack(docs, size=64, segment=segment).toPandas()
        fills = out.groupby("sequence_id").length.sum()
        assert (fills == 64).sum() >= len(fills) - 1 and (out.groupby("doc_id").length.sum() == out.groupby("doc_id").doc_tokens.first()).all()


def test_packing_round_trip(spark, odd, library):
    out = packing.pack(odd, size=64, with_ids=True).toPandas()
    for doc, group in out[out.doc_id.notna() & (out.doc_id != 4)].groupby("doc_id"):
        ids = [i for p in group.sort_values("start").ids for i in p]
        assert ids == [*library.encode(ODD[int(doc)] or "", add_special_tokens=False).ids, 0]
    fills = out.groupby("sequence_id").length.sum()
    assert fills.max() <= 64 and out.length.min() > 0


def shingles(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c < "\x7f" else c for c in text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} - {()}


def test_join_of_repeated_and_null_ids(spark):
    base = [f"w{i}" for i in range(200)]
    near = [*base[:100], "zz", *base[101:]]
    rows = [(7, " ".join(base)), (7, " ".join(base)), (3, " ".join(near)), (4, None), (5, ""), (None, " ".join(base)), (6, "one two")]
    out = ngram_join.join_ngrams(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(repr, map(tuple, out))) == ["(3, 197, 3)", "(4, 0, 4)", "(5, 0, 5)", "(6, 1, 6)", "(7, 197, 3)", "(7, 197, 3)", "(None, 197, None)"]


def test_join_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rng = random.Random(3)
    base = [w for _, t in rows[:3] for w in t.split()][:150]
    for i in range(60):  # a group of near copies at and about the threshold
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = f"w{rng.random()}"
        rows.append((1000 + i, " ".join(words)))
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def top(i):
        return i if up[i] == i else top(up[i])

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for rule in (ngram_join.Rule(), ngram_join.Rule(hot_rows=8, tile_rows=4)):
        out = ngram_join.join_ngrams(frame, rule).collect()
        assert {(r.doc_id, r.n_shingles, r.component_id) for r in out} == {(i, len(sets[i]), top(i)) for i in ids}


def test_join_links_the_texts_of_one_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(5, b), (7, b), (7, a), (9, a), (4, c), (11, c), (11, a), (11, None), (12, "other words")]
    out = ngram_join.join_ngrams(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in out if r.n_shingles} == {(5, 4), (7, 4), (9, 4), (4, 4), (11, 4), (12, 12)} and len(out) == len(rows)
    with pytest.raises(ValueError):
        ngram_join.join_ngrams(spark.createDataFrame([("x", a)], "doc_id string, text string"))


def test_tiles_of_a_great_component(spark):
    rule = ngram_join.Rule(tile_rows=100)
    ids = range(3_001)
    keyed = spark.createDataFrame([(1, 50 + i % 40, i, True) for i in ids], "key long, n int, doc_id long, first boolean")
    sets = spark.createDataFrame([(i, b"12345678", None, [1]) for i in ids], "doc_id long, bits binary, coarse binary, low array<long>")
    labels = spark.createDataFrame([(i, 0) for i in ids[:-1]], "node long, component long")
    rows = ngram_join._tile_rows(keyed, sets, labels, rule, True).toPandas()
    assert rows.doc_id.nunique() > 1_000 and len(rows) < 3 * len(ids) + 100
    shared = rows.groupby(["key", "tile", "i", "j"]).component.nunique()
    near = {i for i in ids[:-1] if abs(int(ngram_band(rule, 50 + i % 40)) - int(ngram_band(rule, 50 + 3000 % 40))) <= 1}
    with_stranger = rows.merge(rows[rows.doc_id == 3000][["tile", "i", "j"]], on=["tile", "i", "j"])
    assert near <= set(with_stranger.doc_id) and shared.max() == 2


def ngram_band(rule, n):
    return math.floor(math.log(n) / math.log(100 / rule.percent) + 1e-9)


def test_join_deals_popular_documents(spark):
    base = [f"w{i}" for i in range(120)]
    rows = [(0, " ".join(base))] + [(i, " ".join([*base[:60], f"x{i}", *base[60:]])) for i in range(1, 40)]
    out = ngram_join.join_ngrams(spark.createDataFrame(rows, "doc_id long, text string"), ngram_join.Rule(pair_rows=3, hot_rows=8, tile_rows=4)).collect()
    assert {r.component_id for r in out} == {0} and len(out) == 40


def test_components_by_stars(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 440)]
    want = {(r.node, r.component) for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {(r.node, r.component) for r in components.components(spark.createDataFrame(edges, "a long, b long"), block=20).collect()} == want


def test_windows_equal_brute_force():
    rng = random.Random(5)
    items = [(str(i), [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 9))]) for i in range(12)]
    auto = decontamination.Automaton(items, 4)
    for _ in range(300):
        words = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(40)]
        hit, found = set(), set()
        for name, w in items:
            n = min(4, len(w))
            for k in range(len(w) - n + 1 if w else 0):
                for p in range(len(words) - n + 1):
                    if words[p : p + n] == w[k : k + n]:
                        hit.update(range(p, p + n))
                        found.add(name)
        spans, got = auto.scan(words)
        assert {x for a, b in spans for x in range(a, b)} == hit and got == found


def test_hits_by_blocks(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    items = items.union(spark.createDataFrame([(900, "le la"), (None, "no such words anywhere at all")], "item_id long, text string"))
    whole = sorted(map(tuple, decontamination.contamination(docs, items, block_words=10**6).collect()))
    cleaned = sorted(map(repr, decontamination.decontaminate(docs, items, block_words=10**6).collect()))
    written = []

    def counted(df, cut=decontamination.cut):
        out = cut(df)
        written.append((out.columns, out.count()))
        return out

    monkeypatch.setattr(decontamination, "cut", counted)
    assert sorted(map(tuple, decontamination.contamination(docs, items, block_words=1200).collect())) == whole
    texts = [n for columns, n in written if "text" in columns]
    hit = sum(r[-1] for r in whole)
    assert len(written) > 4 and len(texts) == 1 and hit <= texts[0] < docs.count()  # rows that may be hit, once, whatever the blocks
    whole_filter = decontamination.window_filter
    for bits in (14, 30):  # one that is too small lets more through, and changes nothing
        monkeypatch.setattr(decontamination, "window_filter", lambda b, w, bits=bits: whole_filter(b, w, most_bits=bits))
        assert sorted(map(repr, decontamination.decontaminate(docs, items, block_words=1200).collect())) == cleaned


def test_filter_holds_every_window(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "PART_BITS", 10)
    items = [(i, " ".join(f"w{(i * 7 + k) % 900}" for k in range(1 + i % 30))) for i in range(300)]
    known = decontamination.window_filter(spark.createDataFrame(items, "item_id long, text string"))
    assert known.sizes == list(range(1, 11)) and len(known.bits) > 128
    assert all(known.may_hold(f"x {t} y".encode()) for _, t in items) and not known.may_hold(None)
    assert sum(known.may_hold(f"z{i}".encode()) for i in range(500)) < 100


def test_base_counts_equal_brute_force():
    for text in [t or "" for t in ODD] + ["a b c a b c", "# $\n# $\nx"]:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        covered = {i + d for i, g in enumerate(grams) if grams.count(g) > 1 for d in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert quality_rules.text_counts(text.encode()) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


@pytest.mark.parametrize("spare", [False, True])
def test_kept_equals_brute_force(spark, spare):
    rng = random.Random(9)
    lines = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) + str(rng.randrange(50)) for _ in range(8)) for _ in range(30)]
    lines = [re.sub(r"\d", "x", x) + f" own{chr(97 + i)}" for i, x in enumerate(lines)]
    rows = []
    for i in range(90):
        text = "\n".join(rng.sample(lines[: rng.choice([4, 30])], 2) + [" ".join(f"d{i}q{j}z{chr(97 + k)}" for k in range(9)) for j in range(rng.choice([0, 1, 2, 6]))])
        rows.append((i, text, rng.choice(["h", "h", "g", None])))
    rows += [(200 + i, rows[3][1], "h") for i in range(12)] + [rows[5], (None, rows[7][1], "h"), (None, rows[7][1], "h"), (300, None, "h"), (301, "", "h")]
    options = {"min_words": 10, "line_docs": 4, "line_share": 0.1, "line_ceiling": 9}
    norm = lambda t: [w for w in (" ".join(re.sub("[0-9]+", "0", x.lower()).split()) for x in (t or "").split("\n")) if w]
    want = []
    for i, text, host in rows:
        same = [(i if i is not None else f"row{k}", t) for k, (i, t, h) in enumerate(rows) if h == host and norm(t)]
        docs, texts = {d for d, _ in set(same)}, {t for _, t in same}
        copies = sorted((r[0] is None, r[0] if r[0] is not None else 0, k) for k, r in enumerate(rows) if r[2] == host and r[1] == text)
        first = bool(norm(text)) and (i is None, i if i is not None else 0) == copies[0][:2] and i is not None
        many = lambda n, of: n > 4 and (n > 0.1 * of or n > 9)
        lost = 0
        for line in set(norm(text)):
            by_docs = many(len({d for d, t in same if line in norm(t)}), len(docs))
            by_texts = by_docs and many(len({t for t in texts if line in norm(t)}), len(texts))
            if by_texts if first and spare else by_docs:
                lost += norm(text).count(line) * len(line.split())
        n = len((text or "").split())
        repeats = quality_rules.text_counts((text or "").encode())[4]
        want.append((i, lost, not (n < 10 or 100 * repeats > 50 * n) and n - lost >= 10 and n - lost >= 0.3 * n))
    out = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"), spare_first=spare, **options).collect()
    assert sorted(map(repr, ((r.doc_id, r.n_frequent_words, r.kept) for r in out))) == sorted(map(repr, want))
    assert 5 < sum(w[2] for w in want) < len(want) - 20 and any(w[1] for w in want)


def test_posteriors_equal_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["good", "fine", "bad", "spam", "word", "text"]) for _ in range(rng.randint(0, 9))), rng.choice(["a", "a", "a", "b", None]), rng.choice(["x", "y"])) for i in range(300)]
    labels = [(i, int("good" in t)) for i, t, _, _ in rows[:120]] + [(5, 0), (5, 1), (None, 1)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
    out = {r.doc_id: r for r in quality_classifier.classify(docs, marks).collect()}
    monkeypatch.setattr(quality_classifier, "BROADCAST_SITES", 0)
    salted = {r.doc_id: r for r in quality_classifier.classify(docs, marks).collect()}
    prior = sum(q for _, q in labels) / len(labels)

    def shrunk(groups):
        means = {k: (len(ps), sum(ps) / len(ps), parent) for k, (ps, parent) in groups.items()}
        between, within, scale = (sum(f(*m) for m in means.values()) for f in (lambda n, m, p: n * (m - p) ** 2, lambda n, m, p: p * (1 - p), lambda n, m, p: n * p * (1 - p)))
        s = 1000.0 if between <= within else min(1000.0, max(2.0, scale / (between - within) - 1))
        return {k: (n * m + s * p) / (n + s) for k, (n, m, p) in means.items()}

    hosts = shrunk({h: ([out[i].p_document for i, _, g, _ in rows if g == h], prior) for h in {r[2] for r in rows}})
    paths = shrunk({(h, p): ([out[i].p_document for i, _, g, q in rows if (g, q) == (h, p)], hosts[h]) for h, p in {r[2:] for r in rows}})
    for i, text, h, p in rows:
        odds = lambda x: x / (1 - x)
        quality = odds(out[i].p_document) / odds(prior) * odds(paths[h, p])
        assert out[i].p_host == pytest.approx(hosts[h]) and out[i].p_path == pytest.approx(paths[h, p]) and out[i].quality == pytest.approx(quality / (1 + quality))
        assert out[i].quality == pytest.approx(salted[i].quality) and out[i].p_path == pytest.approx(salted[i].p_path)
        assert text or out[i].p_document == pytest.approx(prior)


def test_quality_of_labels_not_learnt_from(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = labels.filter("doc_id % 3 = 1").selectExpr("doc_id", "quality = 1 as good")
    out = quality_classifier.classify(docs, labels.filter("doc_id % 3 != 1")).join(held, "doc_id").toPandas()
    assert len(out) > 100 and (out.kept == out.good).mean() > 0.93 > max(out.good.mean(), 1 - out.good.mean())


def test_language_of_rows_not_learnt_from(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    filters = language_id.learn(docs.filter(~language_id.held_out()))
    out = language_id.identify(docs.filter(language_id.held_out()), filters, "lang").toPandas()
    assert (out.lang == out.lang_pred).mean() > 0.98


def test_filters_against_exact_sets():
    rng = random.Random(12)
    languages = [f"l{i:02}" for i in range(70)]  # two words of 64 languages
    members = [np.unique(np.array([rng.getrandbits(32) for _ in range(3_000)], np.uint64)) for _ in languages]
    filters = language_id.Filters.of(languages, members)
    exact = [set(m.tolist()) for m in members]
    strange = np.array([rng.getrandbits(32) for _ in range(20_000)], np.uint64)
    for codes in (*members[::9], strange):
        mask = np.bitwise_and.reduce([filters.table[language_id.slots(codes, k)] for k in range(language_id.HASHES)])
        for i in range(0, 70, 7):
            claimed = (mask[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).astype(bool)
            known = np.array([c in exact[i] for c in codes.tolist()])
            assert claimed[known].all()  # no member is missed
            if codes is strange:
                assert abs((claimed & ~known).mean() - filters.false_rate[i]) < 0.002
    # with the false ones taken off, the counts come near the exact ones
    texts = [bytes(rng.choices(b"abcdefgh ", k=400)).decode() for _ in range(8)]
    filters = language_id.Filters.of(["a", "b"], [np.unique(np.concatenate([language_id.grams(t) for t in texts[:4]])), np.unique(np.concatenate([language_id.grams(t) for t in texts[4:]]))])
    for i, t in enumerate(texts):
        assert filters.decide(t)[0] == "ab"[i // 4]


def test_too_many_languages_are_an_error(spark):
    docs = spark.createDataFrame([(f"some words {i}", f"l{i}") for i in range(300)], "text string, lang string")
    with pytest.raises(ValueError, match="at most"):
        language_id.learn(docs)


def test_texts_with_letters_get_a_language_and_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    short = ["A.", "é", "Ж", "Was orer.\nThis work is licensed under the GNU General Public License, version 3.", "Ie, des. Heitbe ötz.\nLicensed under the Apache License, Version 2.0."]
    none = [None, "", "12 + 3", "... \n"]
    foreign = "это совсем другой язык, которого здесь никто не учил " * 4
    rows = [(10**9 + i, t, "en") for i, t in enumerate([*short, *none, foreign])]
    frame = docs.union(spark.createDataFrame([(i, t, None) for i, t, _ in rows], "doc_id long, text string, lang string"))
    filters = language_id.learn(frame.filter(~language_id.held_out()))
    out = {r.doc_id: r for r in language_id.identify(frame, filters).collect()}
    for i, t, _ in rows:
        assert (out[i].lang_pred == "und") == (t in none) and (out[i].score == 0) == (t in none)
    assert filters.decide("Ж")[1] < filters.decide("the")[1]
    kept = {r.doc_id for r in language_id.language_stage(frame).select("doc_id").collect()}
    assert {i for i, _, _ in rows} & kept == {10**9 + i for i in range(len(short))}
    assert {r.doc_id for r in docs.collect()} <= kept


def licenses_of(text):
    return license_scan.Templates(license_scan.TEMPLATES).scan(license_scan.words_of(text.encode()))


def test_license_is_found_twice_and_prose_is_left():
    text = "Some prose. Released under the MIT License. " + "more of it " * 50 + "released under the mit license"
    assert [p[0] for p in licenses_of(text)] == ["MIT", "MIT"]
    assert not licenses_of("the license of the driver was released under these rights to us all")


def test_license_at_the_threshold_and_variants():
    assert [p[:2] for p in licenses_of("it is under the MIT License now")] == [("MIT", 0.8)]
    assert [p[0] for p in licenses_of("Licensed under CC BY-NC 4.0. " + "word " * 30 + "Licensed under CC BY-SA 3.0.")] == ["CC-BY-NC-4.0", "CC-BY-SA-3.0"]
    assert [p[0] for p in licenses_of(license_scan.TEMPLATES["BSD-3-Clause"][0])] == ["BSD-3-Clause"]


def test_license_repeated_without_unique_words():
    words = license_scan.TEMPLATES["MIT"][1]
    n = len(license_scan.words_of(words.encode()))
    assert [p[2:] for p in licenses_of("x " * 33 + f"{words} " * 6)] == [(33 + i * n, 33 + (i + 1) * n) for i in range(6)]


def most_in_common(a, b):
    row = [0] * (len(b) + 1)
    for v in a:
        before, row = row, [0]
        for y, w in enumerate(b):
            row.append(before[y] + 1 if v == w else max(before[y + 1], row[y]))
    return row[-1]


def test_license_places_equal_brute_force():
    rng = random.Random(8)
    templates = {n: [ts[-1]] for n, ts in license_scan.TEMPLATES.items() if n in ("MIT", "ISC", "Zlib", "MPL-2.0", "CC0-1.0")}
    scanner = license_scan.Templates(templates)
    for _ in range(60):
        name = rng.choice(sorted(templates))
        template = license_scan.words_of(templates[name][0].encode())
        notice = [w for w in template if rng.random() > rng.choice([0.05, 0.2, 0.3])]
        for _ in range(rng.randint(0, len(template) // 3)):
            notice.insert(rng.randrange(len(notice)), rng.choice(template + [b"odd"] * 40))
        prose = lambda: [rng.choice([b"the", b"of", b"software", b"and", b"use", b"house", b"any"]) for _ in range(rng.randint(0, 90))]
        words = prose() + notice + prose()
        found = scanner.scan(words)
        for license_name, coverage, a, b in found:
            t = license_scan.words_of(templates[license_name][0].encode())
            assert b - a <= 2 * len(t) and 0.8 <= coverage <= most_in_common(words[a:b], t) / len(t)
        can = len(notice) <= 2 * len(template) and most_in_common(notice, template) >= 0.8 * len(template)
        assert not can or name in {f[0] for f in found}


def test_gaps_without_anchors_are_aligned_whole(monkeypatch):
    rng = random.Random(4)
    for bits in (patience.ROWS, 500):
        monkeypatch.setattr(patience, "ROWS", bits)
        for n, m in ((0, 9), (30, 40), (120, 90), (150, 200)):
            a, b = ([rng.randrange(9) for _ in range(k)] for k in (n, m))
            best = [[0] * (m + 1) for _ in range(n + 1)]
            for x in range(n):
                for y in range(m):
                    best[x + 1][y + 1] = best[x][y] + 1 if a[x] == b[y] else max(best[x][y + 1], best[x + 1][y])
            a, b = [-1, -1, *a, -2, -2], [-3, -3, *b, -4, -4]  # no equal ends, nothing unique in both
            pairs = patience.align(a, b)
            assert len(pairs) == best[n][m] and all(a[x] == b[y] for x, y in pairs)
            assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs[:-1], pairs[1:], strict=True))


def test_repeated_passages_of_long_documents_go(spark):
    passage = [" ".join(f"p{i}w{j}" for j in range(15)) for i in range(4)]
    own = [[f"own {d} {i}" for i in range(100)] for d in range(4)]
    boilerplate = [" ".join(f"b{i}w{j}" for j in range(12)) for i in range(5)]
    rows = [
        (1, "\n".join([*own[0][:50], *passage, *own[0][50:]])),
        (2, "\n".join([*passage, *own[1], *passage])),
        (3, "\n".join(boilerplate * 20 + own[2])),
        (4, "\n".join(passage[2:] + own[3][:9] + boilerplate * 25 + own[3][9:] + passage * 3)),
    ]
    want = repeated_blocks(rows)
    assert removed_of(spark, rows) == want and want[2] == {*range(4), *range(104, 108)} and len(want[4]) == 125 + 12


def test_alignment_rises_and_matches():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randrange(12) for _ in range(rng.randint(0, 30))] for _ in range(2))
        pairs = patience.align(a, b)
        assert all(a[x] == b[y] for x, y in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs[:-1], pairs[1:], strict=True))


def test_later_passage_goes_once(spark):
    passage = "\n".join(" ".join(f"p{i}w{j}" for j in range(15)) for i in range(4))
    rows = [(1, f"first\n{passage}\nend"), (2, f"second\n{passage}"), (3, passage), (4, "clean\nfirst"), (5, None)]
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: rows[0][1], 2: "second", 4: "clean\nfirst", 5: None}


def repeated_blocks(rows, least=40):
    """Line numbers of each document in blocks of least words that an earlier document
    has too: every block against every line of every earlier document."""
    lines = {i: [(n, x.lower().split()) for n, x in enumerate((t or "").split("\n")) if x.split()] for i, t in rows}
    out = {i: set() for i in lines}
    for i, a in lines.items():
        for j, b in lines.items():
            for x in range(len(a)) if j < i else ():
                for y in range(len(b)):
                    k = 0
                    while x + k < len(a) and y + k < len(b) and a[x + k][1] == b[y + k][1]:
                        k += 1
                    if sum(len(w) for _, w in a[x : x + k]) >= least:
                        out[i] |= {n for n, _ in a[x : x + k]}
    return out


def removed_of(spark, rows):
    found = {r.doc_id: set(r.removed) for r in line_dedup.removed_lines(spark.createDataFrame(rows, "doc_id long, text string"))[1].collect()}
    return {i: found.get(i, set()) for i, _ in rows}


def test_passage_of_scattered_lines_goes(spark):
    line = [" ".join(f"p{i}w{j}" for j in range(15)) for i in range(4)]
    whole = "\n".join(line)
    halves = [(1, "\n".join(line[:2])), (2, "\n".join(line[2:])), (3, whole), (4, f"own\n{whole}")]
    assert removed_of(spark, halves) == {1: set(), 2: set(), 3: set(), 4: {1, 2, 3, 4}}
    single = [*enumerate(line, 1), (5, whole), (6, f"{whole}\nown")]
    assert removed_of(spark, single) == {1: set(), 2: set(), 3: set(), 4: set(), 5: set(), 6: {0, 1, 2, 3}}


def test_blocks_are_those_that_align(spark, monkeypatch):
    rng = random.Random(3)
    for _ in range(1_500):
        k = rng.choice([3, 5, 9])
        size = [rng.choice([1, 2, 5, 9]) for _ in range(k)]
        a, b = ([rng.randrange(k) for _ in range(rng.randint(0, 25))] for _ in range(2))
        least, want = rng.choice([4, 8, 12]), set()
        for x in range(len(a)):
            for y in range(len(b)):
                n = 0
                while x + n < len(a) and y + n < len(b) and a[x + n] == b[y + n]:
                    n += 1
                if sum(size[i] for i in a[x : x + n]) >= least:
                    want |= set(range(x, x + n))
        blocks = line_dedup.aligned_blocks(a, [size[i] for i in a], b, [size[i] for i in b], least)
        assert {i for x, y in blocks for i in range(x, y)} == want
    passage = "\n".join(" ".join(f"p{i}w{j}" for j in range(15)) for i in range(4))
    rows = [(1, passage), (2, f"own\n{passage}")]
    assert removed_of(spark, rows) == {1: set(), 2: {1, 2, 3, 4}}
    monkeypatch.setattr(line_dedup, "align", lambda a, b: [])
    assert line_dedup.aligned_blocks([1, 2], [30, 30], [1, 2], [30, 30], 40) == []


@pytest.mark.parametrize("rare", [1, 2, 5, 10**6])
def test_rare_lines_and_runs_find_the_same(spark, rare):
    rng = random.Random(5)
    line = [" ".join(f"l{i}w{j}" for j in range(rng.choice([3, 12, 25]))) for i in range(20)]
    rows = []
    for i in range(40):
        x = rng.randrange(20)
        rows.append((i, "\n".join([*line[x : x + rng.randint(2, 7)], f"own {i}", *line[: rng.randint(0, 3)]])))
    found = line_dedup.removed_lines(spark.createDataFrame(rows, "doc_id long, text string"), rare=rare)[1].collect()
    assert {r.doc_id: set(r.removed) for r in found} == {i: x for i, x in repeated_blocks(rows).items() if x}


def test_rows_of_one_id(spark):
    passage = [" ".join(f"p{i}w{j}" for j in range(15)) for i in range(30)]
    rows = [(1 + i % 2, "\n".join(passage)) for i in range(400)] + [(2, "\n".join(["other", *passage[:5]])), (1, "\n".join(passage[9:15])), (3, "clean")]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    left = sorted((r.doc_id, r.text) for r in out.collect())
    assert left == sorted([(i, t) for i, t in rows if i != 2] + [(2, "other")])


def test_removed_lines_equal_brute_force(spark):
    rng = random.Random(11)
    line = [" ".join(f"l{i}w{j}" for j in range(rng.choice([1, 3, 12, 15, 25, 41]))) for i in range(25)]
    line[3] = " \t"
    rows = []
    for i in range(60):
        picked: list[str] = []
        for _ in range(rng.randint(0, 6)):
            x = rng.randrange(25)
            picked += line[x : x + rng.randint(1, 7)]
        rows.append((i, "\n".join(picked)))
    want = repeated_blocks(rows)
    assert removed_of(spark, rows) == want and sum(map(bool, want.values())) > 10


def test_archive_round_trip(spark, tmp_path):
    big = "é" * 800
    rows = [(1, "http://a", big), (2, None, big), (9, "u", big), (4, "u", None), (5, "u", "same"), (6, "u", "same"), (7, "u\r\nx", "y" * 5000)]
    index = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), f"file://{tmp_path}/w", frame_bytes=2000)
    out = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(index, f"file://{tmp_path}/w").collect()}
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    assert out == {i: (len((t or "").encode()), sha(t), "revisit" if i in (1, 2) else "response", 9 if i in (1, 2) else None) for i, _, t in rows}


def test_odd_rows_come_through(spark, odd):
    n = odd.count()
    benchmark = spark.createDataFrame([(1, None), (2, "one two three four five")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1)], "doc_id long, quality int")
    for frame, rows in ((odd, n), (odd.limit(0), 0)):
        filters = language_id.learn(frame)
        for out in (
            token_counts.count_tokens(frame),
            quality_rules.quality_rules(frame),
            quality_classifier.classify(frame, labels),
            ngram_join.join_ngrams(frame),
            language_id.identify(frame, filters),
            license_scan.scan_licenses(frame),
            decontamination.contamination(frame, benchmark),
            line_dedup.line_report(frame),
        ):
            assert out.count() == rows

"""The stages of the pipeline, and the whole of it, against brute force; odd inputs."""

import random
import re

import pytest

pytest.importorskip("quernstone.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from quernstone.llm import bpe, decontamination, language_id, line_dedup, ngram_join  # noqa: E402

from .test_operators import repeated_blocks, shingles  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the stages use themselves.
CLASHING = "removed string, hits string, key long, n long, digest string, bits string, spans string, block int, component long, row long, _removed string, _clean string"


def language_brute(rows):
    """Rows with a letter; the fixture's are in languages that are learnt."""
    return [r for r in rows if r[1] and any(map(str.isalpha, r[1]))]


def lines_brute(rows):
    gone = repeated_blocks([(i, t) for i, t, *_ in rows])
    out = []
    for i, t, *rest in rows:
        left = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i])
        if not gone[i] or left.split():
            out.append((i, left, *rest))
    return out


def near_brute(rows):
    sets = {i: shingles(t, 5) for i, t, *_ in rows}
    up = {i: i for i in sets}

    def top(i):
        return i if up[i] == i else top(up[i])

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return [r for r in rows if top(r[0]) == r[0]]


def windows_brute(rows, items, size=10):
    lower = lambda t: "".join(c.lower() if c.isascii() else c for c in t)
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = set()
    for item in items:
        w = word.findall(lower(item or ""))
        windows |= {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} - {()}
    out = []
    for i, t, *rest in rows:
        at = [m.span() for m in word.finditer(lower(t or ""))]
        words = [lower(t)[a:b] for a, b in at]
        hit = {x for w in windows for p in range(len(words) - len(w) + 1) if tuple(words[p : p + len(w)]) == w for x in range(p, p + len(w))}
        if len(hit) > 0.5 * len(words):
            continue
        for last in sorted((x for x in hit if x + 1 not in hit), reverse=True):
            first = last
            while first - 1 in hit:
                first -= 1
            t = t[: at[first][0]] + t[at[last][1] :]
        out.append((i, t, *rest))
    return out


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """60 documents: prose, copies, near copies, repeated passages, benchmark items, odd ones."""
    folder = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(21)
    items = [" ".join(rng.choice(["model", "river", "stone", "answer", "seven", "under"]) + str(rng.randrange(40)) for _ in range(14)) for _ in range(3)] + ["short item", None, ""]
    prose = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(text) between 300 and 2500").orderBy("doc_id").select("doc_id", "text", "lang", "source", "n_chars").limit(38).collect()]
    passage = "\n".join(" ".join(f"linie{i} wort{j}" for j in range(8)) for i in range(4))
    near = prose[3][1].split(" ")
    near[len(near) // 2] = "changed"
    texts = [
        *(f"{prose[k][1]}\n{passage}" for k in (30, 31, 32)),
        passage,
        prose[5][1],
        prose[5][1],
        " ".join(near),
        f"{prose[33][1]} {items[0]} {prose[34][1]}",
        f"few words and {items[1]}",
        f"{prose[35][1]} Short ITEM. {items[2].upper()}",
        *(None, "", " \n\t", "12 + 3", "a", "é", "the same line\n" * 30, "the same line\n" * 30),
        "x" * 20_000,
        "\n".join(f"{w}" for w in prose[36][1].split()),
    ]
    rows = prose + [(10_000 + i, t, "en", None if i % 3 else "s", None) for i, t in enumerate(texts)] + [(20_000 + i, f"{prose[37][1]} tail{i}", "en", "s", 1) for i in range(2)]
    assert len(rows) == 60
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_stages_and_run_equal_brute_force(spark, tables):
    from tokenizers import Tokenizer

    folder, rows, items = tables
    for (name, stage), brute in zip(corpus_pipeline.STAGES[:4], (language_brute, lines_brute, near_brute, lambda r: windows_brute(r, items)), strict=True):
        out = stage(spark, spark.createDataFrame(rows, SCHEMA), folder)
        assert out.schema.simpleString() == spark.createDataFrame([], SCHEMA).schema.simpleString(), name
        want = brute(rows)
        assert got(out) == sorted(want, key=repr), name
        assert want != rows, name
        rows = want
    library = Tokenizer.from_file(bpe.VOCABULARY)
    out = corpus_pipeline.run(spark, folder).toPandas()
    assert out.groupby("doc_id").length.sum().to_dict() == {i: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for i, t, *_ in rows}
    assert out.groupby("sequence_id").length.sum().max() <= 1024


ODD = [(1, "one two three four five six seven\n" * 9, "en"), (1, "one two three four five six seven\n" * 9, "en"), (None, "no id", "en"), (None, None, None), (2, None, None), (3, "", "en"), (4, "word " * 30_000, "en"), (2, "and text", "en"), (5, "a", None)]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:4]])
def test_odd_rows_and_names(spark, tables, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    clashing = [c.split()[0] for c in CLASHING.split(",")]
    schema = f"doc_id long, text string, lang string, {CLASHING}"
    docs = spark.createDataFrame([(*r, *([None] * len(clashing))) for r in ODD], schema)
    out = stage(spark, docs, tables[0])
    assert out.columns == docs.columns
    found = [(r.doc_id, r.text) for r in out.collect()]
    assert {(4, ODD[6][1])} <= set(found) and set(found) <= {r[:2] for r in ODD}
    lost = {"language_id": {(None, None), (2, None), (3, "")}, "line_dedup": set(), "near_duplicates": set(), "decontamination": set()}[name]
    assert {r[:2] for r in ODD} - set(found) == lost
    assert stage(spark, docs.limit(0), tables[0]).count() == 0


def test_empty_benchmark_changes_nothing(spark, tables):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert got(decontamination.decontaminate(docs, none)) == sorted(ODD, key=repr)
    several = spark.createDataFrame([(1, "no id"), (2, "and text here or there")], "item_id long, text string")
    assert got(decontamination.decontaminate(docs, several, block_words=4)) == got(decontamination.decontaminate(docs, several))
    assert language_id.language_stage(docs).count() and line_dedup.dedup_lines(docs).count() and ngram_join.join_ngrams(docs).count() == len(ODD)

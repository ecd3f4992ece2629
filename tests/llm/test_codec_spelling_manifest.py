"""Encoding, spelling variants and the manifest against the library and brute force; odd inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

pytest.importorskip("quernstone.llm")
from pyspark.sql import functions as F  # noqa: E402
from quernstone.llm import bpe_codec, merkle, spelling  # noqa: E402

from .test_operators import ODD, SCHEMA  # noqa: E402


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en" if i % 2 else None, None if i == 3 else "s", None, "h", 1, 2, 3, "d") for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[4], (None, "no id at all", "en", "s", None, "h", 1, 2, 3, "d")], SCHEMA)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe_codec.VOCABULARY)


def as_library(library, texts):
    encode, decode = bpe_codec.codec()
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert encode(text).tolist() == ids and decode(encode(text)) == library.decode(ids, skip_special_tokens=False), text[:80]


def test_ids_and_texts_as_the_library_gives_them(library):
    rng = random.Random(7)
    letters = [chr(c) for c in [*range(0x20, 0x250), *range(0x300, 0x700), 0x208F, 0xA7D2, 0x1F600, 0x3042, 0x200B, 10, 9, 0x85]]
    as_library(library, ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(600)])
    as_library(library, [t or "" for t in ODD] + ["a<|startoftext|>́b", "It's HE'LL 'S", "ΑΣ ΟΔΟΣ İ", "ab" * 700, "<|endoftext|>" * 3])
    as_library(library, [f for c in range(0x530) for f in (f"a{chr(c)}b", f"e{chr(c)} {chr(c)}{chr(c)}")])


def test_ids_of_all_texts(spark, library):
    as_library(library, [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()])


def test_scanned_and_heaped_merges_agree():
    rng, v = random.Random(3), bpe_codec.WordVocabulary()
    for _ in range(300):
        word = "".join(rng.choices("aabcdeinth", k=rng.randint(1, 60))).encode()
        symbols = [*(v.inner[b] for b in word[:-1]), v.last[word[-1]]]
        ids, bounds = bpe_codec.merged(symbols, v.rank.get)
        assert ids == bpe_codec.merged_long(symbols, v.rank.get) and bounds[0] == 0 and bounds[-1] == len(word)
        assert [v.names[i].removesuffix(v.end) for i in ids] == [word[a:b].decode() for a, b in zip(bounds, bounds[1:], strict=False)]


def test_codec_of_odd_rows(spark, odd, library):
    encode, decode = bpe_codec.codec()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted((-1 if r.doc_id is None else r.doc_id, len(ids := encode(r.text or "")), sha(ids.tobytes()), sha(decode(ids).encode())) for r in odd.collect())
    assert sorted((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in bpe_codec.round_trip(odd).collect()) == want
    texts = {r.doc_id: r.text for r in bpe_codec.decoded(bpe_codec.encoded(odd)).collect()}
    assert texts[0] == "" and texts[3] == "a</w>" and texts[None] == "no</w> id</w> at</w> all</w>"
    assert bpe_codec.round_trip(odd.limit(0)).count() == 0
    null = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert bpe_codec.decoded(null).first().text is None


def spelling_of(docs, min_length=5, min_count=3):
    counts = Counter()
    for i, text in docs:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in word)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    words = {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}
    near, gaps = {w: set() for w in words}, {}
    for w in words:
        for k in range(len(w)):
            gaps.setdefault((w[:k], w[k + 1 :]), []).append(w)
            if (shorter := w[:k] + w[k + 1 :]) in words:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in gaps.values():
        for a in group:
            near[a] |= set(group) - {a}
    best = {w: min(near[w], key=lambda x: (-words[x], x)) for w in words if near[w]}
    form = {w: b for w, b in best.items() if words[b] >= 2 * words[w]}
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, n, len(near[w]), form.get(w), words.get(form.get(w)), root))
    return sorted(out)


def test_variants_of_all_texts_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = spelling_of([(r.doc_id, r.text) for r in docs.collect()])
    assert len(want) > 1_000 and sum(bool(w[3]) for w in want) > 50
    for cell in (spelling.CELL, 60):
        assert sorted(map(tuple, spelling.variants(docs, cell=cell).collect())) == want


def test_variants_in_crowded_cells(spark):
    rng = random.Random(1)
    docs = [(i, " ".join("".join(rng.choice("abé") for _ in range(rng.randint(4, 9))) for _ in range(200))) for i in range(40)]
    docs += [(None, "Haus HÀUSER x" * 3), (5, None), (6, ""), (7, "x" * 3_000), (7, "x" * 3_000), (8, "X" * 3_000), (9, "x" * 2_999 + " " + "x" * 2_999 + "7" + "x" * 2_999), (12, "aaaa×")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 n", "'a' word", "2 length", "3 cell")
    want = spelling_of(docs)
    assert any(len(w[0]) == 3_000 and w[2] for w in want)
    for cell in (spelling.CELL, 50, 3):  # leaves that no plane divides are dealt by hash
        assert sorted(map(tuple, spelling.variants(frame, cell=cell).collect())) == want
    assert spelling.variants(frame.limit(0)).count() == 0


def test_boxes_hold_all_that_is_near():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdeé", k=7)) for _ in range(400)]
    tree = spelling.Tree(spelling.vectors(words), 10)
    assert sum(len(x) for x in tree.leaves if x is not None) == len(words)
    reached = {(int(q), p) for leaf, rows in tree.reach(spelling.vectors(words), 1, 1) for q in rows for p in tree.leaves[leaf].tolist()}
    assert all((i, j) in reached for i, a in enumerate(words) for j, b in enumerate(words) if sum(x != y for x, y in zip(a, b, strict=True)) <= 1)
    assert len(reached) < len(words) ** 2 / 2


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def manifest_of(rows):
    """rows (doc_id, source, lang, n_chars, text) by trees in memory."""
    leaf = lambda r: digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([digest("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
        return out

    def way(tree, i):
        for nodes in tree[:-1]:
            first = i // 8 * 8
            yield "".join(nodes[first:i]), "".join(nodes[i + 1 : first + 8])
            i //= 8

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    members = [sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in langs]
    trees = [levels([leaf(r) for r in rs]) for rs in members]
    top, out = levels([t[-1][0] for t in trees]), []
    for k, rs in enumerate(members):
        for i, r in enumerate(rs):
            proof = [*way(trees[k], i), *way(top, k)]
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4]
            found = leaf((*r[:4], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4]))) if tampered else leaf(r)
            for left, right in proof:
                found = digest(left + found + right)
            out.append((r[0], leaf(r), trees[k][-1][0], top[-1][0], digest("".join(a + b for a, b in proof)), found, found == top[-1][0]))
    return sorted(map(str, out))


FIELDS = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(1, "a", "en", 1, "X")],
        [(i, "s", "en", None, "T" * i) for i in range(8)],
        [(i, "s", f"l{i}", None, "T" * (i % 7)) for i in range(70)],
        [(i % 90, "s", ["en", None, "de", ""][i % 4], i, "Aa" * (i % 7) if i % 9 else None) for i in range(300)] + [(None, None, None, None, None)] * 3 + [(7, "S", "ü", 1, "É" * 4_000)] * 2,
    ],
    ids=["none", "one", "eight", "languages", "odd"],
)
def test_manifest_equals_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(merkle, "BROADCAST_NODES", 3)  # both ways of joining ancestors
    frame = spark.createDataFrame(rows, FIELDS).selectExpr("*", "1 place", "'x' tree", "2 level", "3 size", "4 replaced")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.translate("text", merkle._UPPER, merkle._LOWER))
    assert sorted(map(str, (tuple(r) for r in merkle.verified(frame, tampered).collect()))) == manifest_of(rows)


def test_proofs_of_untouched_rows_hold(spark, odd):
    out = merkle.manifest(odd).select("root", merkle.folded(F.col("leaf")).alias("again"), "found", "leaf").collect()
    assert len(out) == odd.count() and all(r.again == r.root and r.found == r.leaf for r in out)

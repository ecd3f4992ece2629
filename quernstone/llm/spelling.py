"""Spelling variants: words one edit apart, found by K-d trees over letter counts."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, cut, doc_bytes, map_batches, read

MIN_LENGTH, MIN_COUNT, RATIO = 5, 3, 2
#: One typo for each so many different (document, word), on average.
TYPO_OF = 97
#: Letters a to z have a place each in the vector, all others share the rest. Counts above MOST are
#: taken as MOST: distances only shrink, so nothing near is missed.
PLACES, MOST = 32, 100
#: Words of a cell (a leaf of a length's tree over tasks) and of a leaf within it, cells in all,
#: and words of the sample that says where cells are divided, for each cell.
CELL, LEAF, CELLS, SAMPLE = 4_000, 24, 4_096, 32
#: Letters of candidate pairs that are compared at once.
_COMPARED = 4 << 20

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_PLACE = np.array([c - 97 if 97 <= c < 123 else 26 + c % (PLACES - 26) for c in range(256)], np.int64)


def typed(doc_id: object, words: Counter, into: Counter, typo_of: int = TYPO_OF, min_length: int = 0) -> None:
    """Adds the words of a document to into, as they are counted: where typo_of divides the CRC-32 of `<doc_id>:<word>`,
    without the letter at its remainder by the length. A null doc_id counts as empty; shorter words are left out."""
    begin, crc = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()), zlib.crc32
    for word, n in words.items():
        if len(word) >= min_length:
            h = crc(word.encode(), begin)
            if h % typo_of == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
                if len(word) < min_length:
                    continue
            into[word] += n


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, typo_of: int = TYPO_OF, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """word, n of all whole texts: runs of letters, A-Z in lower case, after `typed`. Each slice of a batch
    sends a word once, so a frequent word is a row a task in the shuffle. Null texts have no words."""

    def rows(ids, raws):
        out: Counter = Counter()
        for i, raw in zip(ids, raws, strict=True):
            if raw:
                typed(i, Counter(_RUN.findall(raw.translate(LOWER).decode())), out, typo_of, min_length)
        return {"word": list(out), "n": list(out.values())}

    found = map_batches(doc_bytes(docs, text=text, doc_id=doc_id), rows, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def vectors(words: list[str]) -> np.ndarray:
    """Letter counts of each word."""
    raw = "".join(words).encode("latin-1")
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    counts = np.bincount(row * PLACES + _PLACE[np.frombuffer(raw, np.uint8)], minlength=len(words) * PLACES)
    return np.minimum(counts, MOST).astype(np.int8).reshape(-1, PLACES)


class Tree:
    """K-d tree over letter counts. Each node has a box that holds all of its points: as
    tight as they allow, or, for a sample, all that may come to its side of the planes."""

    def __init__(self, points: np.ndarray, leaf: float, tight: bool = True):
        self.lo, self.hi, self.below, self.leaves = [], [], [], []
        self.tight = tight
        top = np.full(PLACES, MOST, np.int8)
        todo = [(np.arange(len(points)), np.zeros(PLACES, np.int8), top, -1, 0)]
        while todo:
            rows, lo, hi, parent, side = todo.pop()
            node = len(self.below)
            own = points[rows]
            self.lo.append(own.min(0) if tight else lo)
            self.hi.append(own.max(0) if tight else hi)
            self.below.append([-1, -1])
            self.leaves.append(None)
            if parent >= 0:
                self.below[parent][side] = node
            plane = self._plane(own) if len(rows) > leaf else None
            if plane is None:
                self.leaves[node] = rows
                continue
            place, most = plane
            left = own[:, place] <= most
            under, over = hi.copy(), lo.copy()
            under[place], over[place] = most, most + 1
            todo += [(rows[~left], over, hi, node, 1), (rows[left], lo, under, node, 0)]

    @staticmethod
    def _plane(own: np.ndarray) -> tuple[int, int] | None:
        """(place, greatest count of the left side) that divides the points most evenly, if any does."""
        middle = np.sort(own, axis=0)[(len(own) - 1) // 2]
        best = None
        for less in (0, 1):  # the middle count on the left side, or on the right one
            most = middle - less
            n = np.minimum(share := (own <= most).sum(0), len(own) - share)
            place = int(n.argmax())
            if n[place] and (best is None or n[place] > best[0]):
                best = int(n[place]), place, int(most[place])
        return best and best[1:]

    def reach(self, queries: np.ndarray, more: int, fewer: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows of queries) for each leaf whose box may hold a point that has at most `more`
        letters which the query lacks and lacks at most `fewer` that it has; their sum bounds the L1 distance."""
        todo = [(0, np.arange(len(queries)))]
        while todo:
            node, rows = todo.pop()
            q = queries[rows]
            near = (np.maximum(self.lo[node] - q, 0).sum(1, dtype=np.int16) <= more) & (np.maximum(q - self.hi[node], 0).sum(1, dtype=np.int16) <= fewer)
            rows = rows[near]
            if not len(rows):
                continue
            if self.leaves[node] is not None:
                yield node, rows
            else:
                todo += [(n, rows) for n in self.below[node]]


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of letters (b's as long as a's, or one letter longer): whether one replaced, or one inserted, letter makes b of a."""
    n = a.shape[1]
    if b.shape[1] == n:
        return (a != b).sum(1) == 1
    head = np.logical_and.accumulate(a == b[:, :n], axis=1).sum(1)
    tail = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(1)
    return head + tail >= n


def _letters(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def near_pairs(points: list[str], queries: list[str], own: bool) -> Iterator[tuple[int, int]]:
    """(query, point) one edit apart. Points have one length, queries the same or, all of them, one letter less;
    with own, queries begin with the points, and of a pair of points the first is the query."""
    if not points or not queries:
        return
    p, q = vectors(points), vectors(queries)
    size = len(points[0])
    fewer = int(len(queries[0]) == size)
    bits = np.uint32(1) << np.arange(PLACES, dtype=np.uint32)
    odd_p, odd_q = ((v & 1).astype(np.uint32) @ bits for v in (p, q))
    tree = Tree(p, LEAF)
    most = max(1, _COMPARED // size)
    for leaf, rows in tree.reach(q, 1, fewer):
        for at in range(0, len(rows), step := max(1, _COMPARED // max(1, len(tree.leaves[leaf])))):
            some, here = rows[at : at + step], tree.leaves[leaf]
            x, y = np.nonzero(np.bitwise_count(odd_q[some][:, None] ^ odd_p[here][None, :]) <= 1 + fewer)
            x, y = some[x], here[y]
            if own:
                x, y = x[keep := (x >= len(points)) | (x < y)], y[keep]
            apart = p[y] - q[x]
            keep = (np.maximum(apart, 0).sum(1, dtype=np.int16) <= 1) & (np.maximum(-apart, 0).sum(1, dtype=np.int16) <= fewer)
            x, y = x[keep], y[keep]
            for k in range(0, len(x), most):
                i, j = x[k : k + most], y[k : k + most]
                yes = one_edit(_letters([queries[a] for a in i]), _letters([points[b] for b in j]))
                yield from zip(i[yes].tolist(), j[yes].tolist(), strict=True)


class Cells:
    """Where the words of each length go: lengths of many words have a tree over tasks, all others one cell."""

    def __init__(self, samples: dict[int, list[str]], counts: dict[int, int], cell: float):
        self.trees: dict[int, tuple[Tree, dict[int, tuple[int, int]]]] = {}
        for length, words in samples.items():
            share = counts[length] / len(words)
            tree = Tree(vectors(words), cell / share, tight=False)
            numbers, n = {}, 0
            for node, rows in enumerate(tree.leaves):
                if rows is not None:
                    numbers[node] = (n, parts := max(1, -(-int(len(rows) * share) // int(2 * cell))))  # a leaf that no plane divides is dealt by hash
                    n += parts
            self.trees[length] = tree, numbers

    def places(self, length: int, words: list[str], more: int, fewer: int, crc: list[int]) -> Iterator[tuple[int, int]]:
        """(row, cell) of each word and each cell of length that may hold a word that near; with 0, 0 the one cell of each word."""
        if length not in self.trees:
            yield from ((i, 0) for i in range(len(words)))
            return
        tree, numbers = self.trees[length]
        for node, rows in tree.reach(vectors(words), more, fewer):
            first, parts = numbers[node]
            for i in rows.tolist():
                yield from ((i, first + k) for k in (range(parts) if more or fewer else (crc[i] % parts,)))


def _cells(words: DataFrame, cell: int, most: int) -> Cells:
    total = words.count()
    cell = max(cell, -(-total // most))
    counts = {r["length"]: r["n"] for r in words.groupBy("length").agg(F.count("*").alias("n")).filter(F.col("n") > cell).collect()}
    samples: dict[int, list[str]] = {}
    if counts:
        wanted = SAMPLE * -(-total // cell)
        for r in words.filter(F.col("length").isin(list(counts))).sample(min(1.0, wanted / total), seed=7).select("length", "word").collect():
            samples.setdefault(r["length"], []).append(r["word"])
    return Cells(samples, counts, cell)


def links(words: DataFrame, cell: int = CELL, cells: int = CELLS) -> DataFrame:
    """word, near, near_n: both directions of each two words(word, n, length) that are one edit apart.

    A pair has one length, or two that follow each other. A word is a point in the one cell of its
    length that its letter counts lie in, and a query to cells of its length with a higher number,
    and to cells of the next length, whose boxes are near enough; so each pair meets in one task.
    The driver sees how many words the long lists have (at most `cells` rows) and a sample of SAMPLE
    words a cell, which only says where lists are divided; the tree that tasks get has that size too."""
    where = _cells(words, cell, cells)

    def dealt(lists, texts, ns):
        out: dict[str, list] = {"list": [], "cell": [], "kind": [], "word": [], "n": []}

        def put(size, at, kind, i):
            for name, v in zip(out, (size, at, kind, texts[i], ns[i]), strict=True):
                out[name].append(v)

        by: dict[int, list[int]] = {}
        for i, size in enumerate(lists):
            by.setdefault(size, []).append(i)
        for size, rows in by.items():
            some = [texts[i] for i in rows]
            crc = [zlib.crc32(w.encode()) for w in some]
            own = dict(where.places(size, some, 0, 0, crc))
            for k, at in own.items():
                put(size, at, 0, rows[k])
            if size in where.trees:
                for k, at in where.places(size, some, 1, 1, crc):
                    if at > own[k]:
                        put(size, at, 1, rows[k])
            for k, at in where.places(size + 1, some, 1, 0, crc):
                put(size + 1, at, 2, rows[k])
        return out

    def search(group: pa.Table) -> pa.Table:
        kind, word, n = (group.column(c).to_pylist() for c in ("kind", "word", "n"))
        rows = [[i for i, k in enumerate(kind) if k == want] for want in range(3)]
        points = [word[i] for i in rows[0]]
        ends: list[tuple[int, int]] = []
        for of, own in ((rows[0] + rows[1], True), (rows[2], False)):
            ends += [(of[q], rows[0][p]) for q, p in near_pairs(points, [word[i] for i in of], own)]
        ends += [(b, a) for a, b in ends]
        return pa.table({"word": pa.array([word[a] for a, _ in ends], pa.string()), "near": pa.array([word[b] for _, b in ends], pa.string()), "near_n": pa.array([n[b] for _, b in ends], pa.int64())})

    sent = map_batches(words.select("length", "word", "n"), dealt, "list int, cell int, kind int, word string, n long")
    return sent.groupBy("list", "cell").applyInArrow(search, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """word, root from forms(word, form): pointers are joined with themselves until none has a form left.
    A form is at least RATIO times as frequent as its word, so a chain of 2^k words is halved k times."""
    known = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        above = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        known = cut(known.join(above, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if known.filter("moved").isEmpty():
            return known.drop("moved")
        known = known.drop("moved")


def variants(docs: DataFrame, ratio: int = RATIO, cell: int = CELL, **options) -> DataFrame:
    """word, n, n_near, form, form_n, root: one row for each word of `word_counts` (options).

    Two words are near if one inserted, deleted or replaced letter makes one of the other. A word's form
    is its most frequent near word (the first in code-point order of those), if that is ratio times
    as frequent or more; its root is where forms lead, itself without one. Words are
    different by definition, so repeated rows and copies only add to n; null texts and an empty
    table give no words, rows with a null doc_id are documents with an empty id."""
    words = cut(word_counts(docs, **options).withColumn("length", F.length("word")))
    near = links(words, cell).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    best_n = -F.col("best.less")
    strong = best_n >= ratio * F.col("n")
    named = cut(words.drop("length").join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, F.col("best.form")).alias("form"), F.when(strong, best_n).alias("form_n")))
    return named.join(roots(named.filter("form is not null")), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(read(spark, sf_dir, "documents"))

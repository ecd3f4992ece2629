"""Line dedup: pairs of documents with passages of lines in common, aligned by patience."""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Sequence
from itertools import groupby

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, cut, doc_bytes, fresh, map_batches, read, rewrite_texts
from .patience import align

MIN_WORDS = 40
#: A line is rare if it stands at most so many times in all documents. Pairs by one line are at most RARE * (RARE - 1) / 2.
RARE = 5
#: Pairs of one earlier stretch that one task aligns.
HELD_PAIRS = 1_000


def line_keys(raw: bytes | None) -> tuple[list[int], list[int], list[int]]:
    """Of each line with a word: its number in the text, a hash of its lower-cased
    words, and how many they are."""
    at, keys, words = [], [], []
    for i, line in enumerate((raw or b"").split(b"\n")):
        parts = line.translate(LOWER).split()
        if parts:
            at.append(i)
            keys.append(xxhash.xxh3_64_intdigest(b" ".join(parts)) - (1 << 63))
            words.append(len(parts))
    return at, keys, words


def passage_runs(keys: list[int], words: list[int], least: int) -> list[tuple[int, int, int]]:
    """(hash, first position, last position) of each run of consecutive lines that is
    minimal for its first or for its last line: least words or more, and fewer without
    the line at its other end."""
    spans, start, total = set(), 0, 0
    for end, n in enumerate(words):  # backward: the latest start that is enough for this end
        total += n
        while start < end and total - words[start] >= least:
            total -= words[start]
            start += 1
        if total >= least:
            spans.add((start, end))
    end, total = -1, 0
    for start, n in enumerate(words):  # forward: the earliest end that is enough for this start
        while total < least and end + 1 < len(words):
            end += 1
            total += words[end]
        if total < least:
            break
        spans.add((start, end))
        total -= n
    raw = array("q", keys).tobytes()
    return [(xxhash.xxh3_64_intdigest(raw[8 * x : 8 * y + 8]) - (1 << 63), x, y) for x, y in sorted(spans)]


def grown(mine: Sequence[int], theirs: Sequence[int], x: int, y: int) -> tuple[int, int]:
    """(first, past the last) of the block of mine around x that stands in theirs around y."""
    past, j = x, y
    while past < len(mine) and j < len(theirs) and mine[past] == theirs[j]:
        past, j = past + 1, j + 1
    while x and y and mine[x - 1] == theirs[y - 1]:
        x, y = x - 1, y - 1
    return x, past


def outside(runs: list[tuple[int, int, int]], blocks: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """The runs (hash, first, last; rising) that no block holds whole."""
    out, rest, reach = [], sorted(blocks, reverse=True), 0
    for run in runs:
        while rest and rest[-1][0] <= run[1]:
            reach = max(reach, rest.pop()[1])
        if run[2] >= reach:
            out.append(run)
    return out


def aligned_blocks(mine: Sequence[int], words: Sequence[int], theirs: Sequence[int], their_words: Sequence[int], least: int) -> list[tuple[int, int]]:
    """(first, past the last) of the blocks of mine that patience aligns line by line with a block of theirs, of
    least words or more, until none is left: together they hold every line of mine in such a block.

    Lines are aligned first; what blocks leave of mine between them is aligned anew, with those
    lines of theirs that it has too, so a passage that comes more often, or elsewhere, is found. An alignment
    is in order and may prefer scattered lines; so the runs of mine that no block holds are then aligned whole,
    again until nothing aligns. Each match grows to the block it stands in."""
    found: list[tuple[int, int]] = []
    places: dict[int, list[int]] = {}
    for y, key in enumerate(theirs):
        places.setdefault(key, []).append(y)
    todo = [(0, len(mine))]
    while todo:
        a, b = todo.pop()
        if sum(words[a:b]) < least:
            continue
        ours = sorted(y for key in set(mine[a:b]) for y in places.get(key, ()))
        pairs = [(a + x, ours[y]) for x, y in align(mine[a:b], [theirs[y] for y in ours])]
        cuts, k = [a], 0
        for i in range(1, len(pairs) + 1):
            if i == len(pairs) or pairs[i] != (pairs[i - 1][0] + 1, pairs[i - 1][1] + 1):
                first, past = pairs[k][0], pairs[i - 1][0] + 1
                if sum(words[first:past]) >= least:
                    found.append(grown(mine, theirs, *pairs[k]))
                    cuts += [first, past]
                k = i
        if len(cuts) > 1:
            todo += [(x, y) for x, y in zip(cuts[::2], [*cuts[1::2], b], strict=True) if x < y]
    known = passage_runs(theirs, their_words, least)
    held = {h for h, _, _ in known}
    left = [run for run in passage_runs(mine, words, least) if run[0] in held]
    while (left := outside(left, found)) and (pairs := align([h for h, _, _ in left], [h for h, _, _ in known])):
        found += [grown(mine, theirs, left[x][1], known[y][1]) for x, y in pairs]
    return found


def shared_segments(marks: list[dict], least: int) -> Iterator[tuple[list[int], list[int], list[int], list[int], list[int]]]:
    """Line numbers, keys, words, rare lines and runs of each unbroken stretch of least words or more of lines that
    another document may have. Runs are those of lines that are all frequent, so that every block
    has a rare line or a run."""
    marks = sorted({m["pos"]: m for m in marks}.values(), key=lambda m: m["pos"])
    for _, of in groupby(enumerate(marks), lambda x: x[1]["pos"] - x[0]):
        part = [m for _, m in of]
        if sum(m["words"] for m in part) < least:
            continue
        runs: set[int] = set()
        for often, of_kind in groupby(part, lambda m: m["often"]):
            if often:
                stretch = list(of_kind)
                runs |= {h for h, _, _ in passage_runs([m["key"] for m in stretch], [m["words"] for m in stretch], least)}
        yield [m["at"] for m in part], [m["key"] for m in part], [m["words"] for m in part], sorted({m["key"] for m in part if not m["often"]}), sorted(runs)


def _pairs(segments: DataFrame) -> DataFrame:
    """doc_id, part, of, from, salt, salts: each two segments of different documents, the later one first, that share a
    rare line, or of which the earlier one is the first to have a run of the later one."""
    rare = segments.select("doc_id", "part", F.explode("rare").alias("key"))
    groups = rare.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("doc_id", "part"))).alias("all")).filter(F.size("all") > 1)
    each = groups.select("all", F.posexplode("all").alias("at", "x")).select("x.*", F.explode(F.slice("all", 1, F.col("at"))).alias("y"))
    by_line = each.select("doc_id", "part", F.col("y.doc_id").alias("of"), F.col("y.part").alias("from"), F.lit(0).alias("salt"), F.lit(1).alias("salts"))
    single = segments.select("doc_id", "part", F.explode("runs").alias("key"))
    first = single.groupBy("key").agg(F.min(F.struct("doc_id", "part")).alias("h"), F.max("doc_id").alias("latest"), F.count("*").alias("n"))
    first = first.filter("h.doc_id < latest").select("key", F.col("h.doc_id").alias("of"), F.col("h.part").alias("from"), F.ceil(F.col("n") / HELD_PAIRS).cast("int").alias("salts"))
    by_run = single.join(cut(first), "key").select("doc_id", "part", "of", "from", F.pmod(F.xxhash64("doc_id", "part"), "salts").cast("int").alias("salt"), "salts")
    both = by_line.unionByName(by_run).filter("doc_id > of")
    return both.groupBy("doc_id", "part", "of", "from").agg(F.max(F.struct("salts", "salt")).alias("x")).select("doc_id", "part", "of", "from", "x.salt", "x.salts")


def removed_lines(docs: DataFrame, min_words: int = MIN_WORDS, rare: int = RARE, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(lines of each row: doc_id, text_key, at, keys, words, as a written table;
    doc_id, text_key, removed: numbers of the lines that an earlier document has too).

    Of a document every line goes that stands in an unbroken block of at least
    min_words words which any earlier document (by doc_id) has too, wherever, in what
    order and how often either has it. The first to have a block keeps it. Texts of one doc_id
    are of one age; of equal ones each loses the same lines.

    Lines that stand once in all documents end a block, so only the stretches between them go on. Two
    stretches are a pair if they share a rare line (one that stands at most `rare` times in all), or, where
    all of a block's lines are frequent, by the hash of a run of them, which leads to its first holder: so no
    block is missed, and a line's or run's holders are never paired with one another in numbers. A pair is aligned by
    patience, and what aligns in blocks goes from the later document. Nothing else does.

    Counts of lines and runs are partial aggregations. A pair's later stretch is sent once a pair, the earlier
    one once for HELD_PAIRS pairs, so a passage that a third of all documents has is spread over tasks.
    """
    kind = dict(docs.dtypes)[doc_id]

    def rows(ids, raws, keys):
        found = [line_keys(raw) for raw in raws]
        return {"doc_id": ids, "text_key": keys} | {name: [f[i] for f in found] for i, name in enumerate(("at", "keys", "words"))}

    lines = cut(map_batches(doc_bytes(docs, F.xxhash64(F.col(text)).alias("text_key"), text=text, doc_id=doc_id), rows, f"doc_id {kind}, text_key long, at array<int>, keys array<long>, words array<int>"))
    placed = lines.filter("doc_id is not null").select("doc_id", "text_key", F.posexplode(F.arrays_zip("at", "keys", "words")).alias("pos", "x")).select("doc_id", "text_key", "pos", "x.at", F.col("x.keys").alias("key"), "x.words")
    known = cut(placed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key", (F.col("n") > rare).alias("often")))
    marked = placed.join(known, "key").groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("pos", "at", "key", "words", "often")).alias("marks"))

    def parts(ids, texts, marks):
        out: dict[str, list] = {"doc_id": [], "part": [], "text_key": [], "at": [], "keys": [], "words": [], "rare": [], "runs": []}
        for i, t, m in zip(ids, texts, marks, strict=True):
            for at, keys, words, single, runs in shared_segments(m, min_words):
                part = xxhash.xxh3_64_intdigest(array("q", [t, at[0]]).tobytes()) - (1 << 63)
                for name, v in zip(out, (i, part, t, at, keys, words, single, runs), strict=True):
                    out[name].append(v)
        return out

    segments = cut(map_batches(marked, parts, f"doc_id {kind}, part long, text_key long, at array<int>, keys array<long>, words array<int>, rare array<long>, runs array<long>"))
    pairs = cut(_pairs(segments))
    held = pairs.groupBy("of", "from").agg(F.max("salts").alias("salts")).select("of", "from", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    theirs = held.join(segments.select(F.col("doc_id").alias("of"), F.col("part").alias("from"), F.col("keys").alias("theirs"), F.col("words").alias("their_words")), ["of", "from"])
    wide = pairs.drop("salts").join(segments.select("doc_id", "part", "text_key", "at", "keys", "words"), ["doc_id", "part"]).join(theirs, ["of", "from", "salt"])

    def numbers(ids, texts, at, keys, words, theirs, their_words):
        out = []
        for i in range(len(ids)):
            blocks = aligned_blocks(keys[i], words[i], theirs[i], their_words[i], min_words)
            out.append(sorted({n for x, y in blocks for n in at[i][x:y]}))
        return {"doc_id": ids, "text_key": texts, "removed": out}

    removed = map_batches(wide.select("doc_id", "text_key", "at", "keys", "words", "theirs", "their_words"), numbers, f"doc_id {kind}, text_key long, removed array<int>")
    one = removed.select("doc_id", "text_key", F.explode("removed").alias("n")).groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("n")).alias("removed"))
    return lines, one


def line_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines and n_words (of lines with a word), n_removed_lines,
    n_removed_words: one row for each row. A null text has no lines; rows that
    share a doc_id are of one age and lose nothing to each other; a null doc_id is
    compared with nothing. doc_id may be of any type that has an order."""
    lines, removed = removed_lines(docs, **options)

    def counts(ids, at, words, removed):
        gone = [set(r or ()) for r in removed]
        lost = [[w for n, w in zip(a, ws, strict=True) if n in g] for a, ws, g in zip(at, words, gone, strict=True)]
        return {"doc_id": ids, "n_lines": [len(a) for a in at], "n_words": [sum(w) for w in words], "n_removed_lines": [len(x) for x in lost], "n_removed_words": [sum(x) for x in lost]}

    rows = lines.select("doc_id", "text_key", "at", "words").join(removed, ["doc_id", "text_key"], "left").select("doc_id", "at", "words", "removed")
    return map_batches(rows, counts, f"doc_id {dict(lines.dtypes)['doc_id']}, n_lines long, n_words long, n_removed_lines long, n_removed_words long")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of docs; text without the removed lines. Rows of which no word is
    left, but had one, go; all others stay, as they are if nothing was removed. Rows
    with a null doc_id or text stay as they are."""
    _, removed = removed_lines(docs, min_words)
    name, doc, key = fresh("removed", docs), fresh("doc", docs), fresh("text_key", docs)

    def left(raw, gone):
        if raw is None or not gone:
            return True, raw
        gone = set(gone)
        kept = b"\n".join(line for i, line in enumerate(raw.split(b"\n")) if i not in gone)
        return bool(kept.split()), kept

    removed = removed.toDF(doc, key, name)
    return rewrite_texts(docs.join(removed, (F.col("doc_id") == F.col(doc)) & (F.xxhash64("text") == F.col(key)), "left").select(*docs.columns, name), left, more=1)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(read(spark, sf_dir, "documents"))

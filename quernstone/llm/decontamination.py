"""Benchmark decontamination by a generalised suffix automaton of the test items."""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType, StructField, StructType

from .common import U64, cut, doc_bytes, fresh, map_batches, read, rewrite_texts, slices, window_hashes, word_hashes

WINDOW = 10
#: Item words that one automaton, and so one broadcast, holds.
BLOCK_WORDS = 100_000
#: Bits of the filter of all windows for each item word, and at most; a part of it is built by one task.
FILTER_BITS, MOST_BITS, PART_BITS = 16, 30, 20

_NOT_WORD = {*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)} - {*range(0x41, 0x5B)}
_WORDS = bytes(32 if c in _NOT_WORD else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_WORD_SPANS = re.compile(rb"[^ ]+")


def words_of(raw: bytes | None) -> list[bytes]:
    return (raw or b"").translate(_WORDS).split()


class Automaton:
    """Suffix automaton over the words of several items.

    step[s] maps a word's number to the next state, link[s] is the state of the
    longest suffix that stands elsewhere too, length[s] the longest word run of s.
    """

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.number: dict[bytes, int] = {}
        self.ids: list[str] = []
        kept = []
        for name, words in items:
            if words:
                self.ids.append(name)
                kept.append([self.number.setdefault(w, len(self.number)) for w in words])
                last = 0
                for w in kept[-1]:
                    last = self._extend(last, w)
        #: items with a window that ends in a state's run of window words; short items by state
        self.at_window: dict[int, set[int]] = {}
        self.short: dict[int, list[tuple[int, int]]] = {}
        self._base = [-2] * len(self.step)
        self.shortest = window
        for i, words in enumerate(kept):
            for end, state, n in self.matches(words, 1):
                if n >= window:
                    self.at_window.setdefault(self.base(state), set()).add(i)
                elif end == len(words) - 1:
                    self.short.setdefault(state, []).append((n, i))
            self.shortest = min(self.shortest, len(words))

    def _extend(self, last: int, w: int) -> int:
        step, link, length = self.step, self.link, self.length
        if w in step[last]:
            q = step[last][w]
            return q if length[q] == length[last] + 1 else self._split(last, w, q)
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and w not in step[p]:
            step[p][w] = new
            p = link[p]
        if p >= 0:
            q = step[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, w, q)
        return new

    def _split(self, p: int, w: int, q: int) -> int:
        step, link, length = self.step, self.link, self.length
        twin = len(step)
        step.append(dict(step[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = twin
        while p >= 0 and step[p].get(w) == q:
            step[p][w] = twin
            p = link[p]
        return twin

    def base(self, state: int) -> int:
        """The state that stands for the last window words of a run in state."""
        if self._base[state] == -2:
            s = state
            while self.length[self.link[s]] >= self.window:
                s = self.link[s]
            self._base[state] = s
        return self._base[state]

    def matches(self, numbers: Iterable[int | None], least: int) -> Iterator[tuple[int, int, int]]:
        """(position, state, length) of the longest run that ends there, where it has least words."""
        step, link, length = self.step, self.link, self.length
        state = n = 0
        for at, w in enumerate(numbers):
            if w is None:
                state = n = 0
                continue
            to = step[state].get(w)
            while to is None and state:
                state = link[state]
                n = length[state]
                to = step[state].get(w)
            if to is None:
                n = 0
                continue
            state, n = to, n + 1
            if n >= least:
                yield at, state, n

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit spans (first word, word after the last), disjoint and in order, and the
        items with a window in them."""
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        for at, state, n in self.matches(map(self.number.get, words), self.shortest):
            begin = at + 1
            if n >= self.window:
                begin -= n
                found |= self.at_window[self.base(state)]
            s = state
            while self.short and s > 0:
                for size, item in self.short.get(s, ()):
                    if size <= n:
                        begin = min(begin, at + 1 - size)
                        found.add(item)
                s = self.link[s]
            if begin <= at:
                while spans and spans[-1][1] >= begin:
                    begin = min(begin, spans.pop()[0])
                spans.append((begin, at + 1))
        return spans, {self.ids[i] for i in found}


def automata(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, text: str = "text", item_id: str = "item_id") -> Iterator[Broadcast]:
    """Broadcast automata of blocks of items, built in tasks; the driver fetches one block
    at a time. Items are dealt by hash into blocks of half of block_words on average; a long one
    goes in parts that share window - 1 words, so that each window lies in one part."""
    sc, most = benchmark.sparkSession.sparkContext, max(1, block_words // 4)

    def parts(ids, raws):
        out: dict[str, list] = {"item": [], "part": [], "words": [], "n": []}
        for item, raw in zip(ids, raws, strict=True):
            words = words_of(raw)
            for at in range(0, max(1, len(words) - window + 1), most) if words else ():
                piece = words[at : at + most + window - 1]
                for k, v in zip(out, (item, at, b" ".join(piece), len(piece)), strict=True):
                    out[k].append(v)
        return out

    named = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item_id"), F.col(text).alias("text"))
    items = cut(map_batches(doc_bytes(named, doc_id="item_id"), parts, "item string, part int, words binary, n int"))
    total = items.agg(F.sum("n")).first()[0] or 0
    if not total:
        yield sc.broadcast(Automaton([], window))
        return

    def build(items: pa.Table) -> pa.Table:
        rows = sorted(zip(*(items.column(c).to_pylist() for c in ("item", "part", "words")), strict=True))
        return pa.table({"block": items.column("block")[:1], "automaton": [pickle.dumps(Automaton([(item, words.split()) for item, _, words in rows], window))]})

    blocks = items.withColumn("block", F.pmod(F.xxhash64("item", "part"), F.lit(-(-2 * total // block_words))).cast("int"))
    built = cut(blocks.groupBy("block").applyInArrow(build, "block int, automaton binary"))
    for row in built.toLocalIterator():
        yield sc.broadcast(pickle.loads(row["automaton"]))


def joined_spans(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same positions as disjoint spans in order."""
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


class WindowFilter:
    """Bits at the hashes of all windows of all items, and the sizes that windows have. A text with a window of an
    item always has its bit; others seldom do."""

    def __init__(self, bits: np.ndarray, sizes: list[int]):
        self.bits, self.sizes = bits, sizes
        self.shift = U64(64 - (len(bits) * 8).bit_length() + 1)

    def may_hold(self, raw: bytes | None) -> bool:
        words = word_hashes((raw or b"").translate(_WORDS))
        for size in self.sizes:
            at = (window_hashes(words, size) >> self.shift).astype(np.int64)
            if (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).any():
                return True
        return False


def window_filter(benchmark: DataFrame, window: int = WINDOW, text: str = "text", most_bits: int = MOST_BITS) -> WindowFilter:
    """The filter of all items, whatever their number: FILTER_BITS bits a word, at most 2 ** most_bits in all
    (beyond that it lets more texts through). Its parts are built in tasks; the driver joins them."""

    def windows(_, raws):
        out: dict[str, list] = {"size": [], "hash": []}
        for raw in raws:
            words = word_hashes((raw or b"").translate(_WORDS))
            found = window_hashes(words, size := min(window, len(words))) if len(words) else []
            out["size"] += [size] * len(found) if len(found) else []
            out["hash"] += [int(h) - (1 << 63) for h in found]
        return out

    hashes = cut(map_batches(doc_bytes(benchmark.select(F.lit(0).alias("doc_id"), F.col(text).alias("text"))), windows, "size int, hash long").distinct())
    sizes = [r["size"] for r in hashes.select("size").distinct().orderBy("size").collect()]
    bits = min(most_bits, max(10, (FILTER_BITS * hashes.count()).bit_length()))
    part = min(bits, PART_BITS)

    def build(rows: pa.Table) -> pa.Table:
        at = (rows.column("hash").to_numpy().view(U64) ^ U64(1 << 63)) >> U64(64 - bits)
        mine = np.zeros(1 << part, np.uint8)
        mine[(at & U64((1 << part) - 1)).astype(np.int64)] = 1
        return pa.table({"part": rows.column("part")[:1], "bits": pa.array([np.packbits(mine, bitorder="little").tobytes()], pa.binary())})

    number = F.shiftrightunsigned(F.col("hash").bitwiseXOR(F.lit(-(1 << 63))), 64 - bits + part) if bits > part else F.lit(0).cast("long")
    whole = np.zeros(1 << (bits - 3), np.uint8)
    for r in hashes.select("hash", number.alias("part")).groupBy("part").applyInArrow(build, "part long, bits binary").toLocalIterator():
        whole[r["part"] << (part - 3) :][: 1 << (part - 3)] = np.frombuffer(r["bits"], np.uint8)
    return WindowFilter(whole, sizes)


_KNOWN = "struct<spans:array<struct<a:int,b:int>>,items:array<string>>"
_HITS = "struct<n_words:long,spans:array<struct<a:int,b:int>>,items:array<string>>"


def _where(docs: DataFrame, at: int, shared: Broadcast, held: bool) -> DataFrame:
    """The rows of docs whose text the filter lets through (held), or the others."""

    def run(batches):
        for batch in slices(batches):
            kept = batch.filter(pa.array([shared.value.may_hold(t) is held for t in batch.column(at).cast(pa.binary()).to_pylist()], pa.bool_()))
            if kept.num_rows:
                yield kept

    return docs.mapInArrow(run, docs.schema)


def _by_blocks(docs: DataFrame, text: str, name: str, blocks: Iterable[Broadcast], shared: Broadcast) -> DataFrame:
    """docs with a last column: what the blocks find in each text (null: nothing). Of docs only rows that the filter lets
    through are written, once; each block's pass reads their texts and writes what it finds."""
    row, at = fresh("row", docs), docs.columns.index(text)
    few = cut(_where(docs, at, shared, True).withColumn(row, F.monotonically_increasing_id()))
    texts = few.select(F.col(row).alias("doc_id"), F.col(text).cast("binary").alias("raw"))
    found = []
    for block in blocks:

        def rows(ids, raws, block=block):
            out: dict[str, list] = {"row": [], "spans": [], "items": []}
            for i, raw in zip(ids, raws, strict=True):
                spans, items = block.value.scan(words_of(raw))
                if spans:
                    for k, v in zip(out, (i, [{"a": a, "b": b} for a, b in spans], sorted(items)), strict=True):
                        out[k].append(v)
            return out

        found.append(cut(map_batches(texts, rows, "row long, spans array<struct<a:int,b:int>>, items array<string>")))
        block.unpersist()
    merged = reduce(DataFrame.union, found).groupBy(F.col("row").alias(row)).agg(F.struct(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")).alias(name))
    return few.join(merged, row, "left").select(*docs.columns, name).union(_where(docs, at, shared, False).withColumn(name, F.lit(None).cast(_KNOWN)))


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, text: str = "text", keep: Callable[[bytes | None, dict], tuple[bool, bytes | None]] | None = None) -> tuple[DataFrame, str]:
    """docs with a last column, and its name: n_words, spans (hit words, first and one past
    the last), items. With keep: docs alone, as it says of each text and that column.

    A window is a run of window item words; an item of fewer words, but not none, is
    one window. Where one block holds all items, docs stream through its automaton in one narrow pass. Of
    more blocks a filter of all windows first tells the rows that may have one; only those meet
    the automata, one block at a time, so documents are not written again for each block.
    """
    name, at, width = fresh("hits", docs), docs.columns.index(text), len(docs.columns)
    kind = to_arrow_schema(StructType.fromDDL(f"hits {_HITS}")).field(0).type
    marked = StructType([*docs.schema.fields, StructField(name, DataType.fromDDL(_HITS))])
    blocks = automata(benchmark, window, block_words)
    block = next(blocks)
    if (after := next(blocks, None)) is None:
        out, find = docs, lambda raw, known=None: block.value.scan(words_of(raw))
    else:
        out = _by_blocks(docs, text, name, chain((block, after), blocks), docs.sparkSession.sparkContext.broadcast(window_filter(benchmark, window)))
        find = lambda raw, known: (joined_spans((x["a"], x["b"]) for x in known["spans"]), known["items"]) if known else ([], [])

    def judge(raw: bytes | None, *known) -> dict:
        spans, items = find(raw, *known)
        return {"n_words": len(words_of(raw)), "spans": [{"a": a, "b": b} for a, b in spans], "items": sorted(items)}

    if keep is not None:
        return rewrite_texts(out, lambda raw, *known: keep(raw, judge(raw, *known)), text, more=len(out.columns) - width), name

    def run(batches):
        for batch in slices(batches):
            columns = [batch.column(at).cast(pa.binary()).to_pylist(), *(c.to_pylist() for c in batch.columns[width:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array([judge(*row) for row in zip(*columns, strict=True)], kind)], names=marked.names)

    return out.mapInArrow(run, marked), name


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: one row for each row.

    A null text has no words and is clean, as is all with an empty benchmark; null
    item texts have no window; repeated items count by their different ids, and all items
    without an id are one, called `null`.
    """
    found, name = hits(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), benchmark, **options)
    return found.select("doc_id", f"{name}.*").select(
        "doc_id",
        "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
    ).withColumn("contaminated", F.col("n_hit") > 0)


def without_spans(raw: bytes | None, spans: list[tuple[int, int]]) -> bytes | None:
    """The text without the words of the spans and what stands between them."""
    if raw is None or not spans:
        return raw
    at = [m.span() for m in _WORD_SPANS.finditer(raw.translate(_WORDS))]
    out, last = [], 0
    for a, b in spans:
        out.append(raw[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, raw[last:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, max_coverage: float = 0.5, **options) -> DataFrame:
    """All columns of docs; hit spans cut out of text, rows with more than
    max_coverage of their words hit left out. Clean rows, null and empty texts stay as
    they are; with an empty benchmark all rows do."""

    def keep(raw, found):
        spans = [(x["a"], x["b"]) for x in found["spans"]]
        return sum(b - a for a, b in spans) <= max_coverage * found["n_words"], without_spans(raw, spans)

    return hits(docs, benchmark, keep=keep, **options)[0]


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))

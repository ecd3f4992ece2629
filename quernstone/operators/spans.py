"""Patterns in texts: a library tried by priority behind an automaton of literals, spans with positions and scores."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


@dataclass(frozen=True)
class Pattern:
    """An expression, what it is called, and literals (lower case) of which one stands in every text that it matches; without any
    it is tried on every text. Of a library the least priority comes first. operands: numbers that a match should hold;
    specific: 0 to 1."""

    name: str
    expression: str
    literals: tuple[str, ...] = ()
    priority: int = 0
    operands: int = 0
    specific: float = 0.5


class Library:
    """Patterns behind one automaton: a text is read once for all literals, and only patterns that one of them leads to are tried."""

    def __init__(self, patterns: Iterable[Pattern]):
        import ahocorasick

        self.patterns = sorted(patterns, key=lambda p: (p.priority, p.name))
        self.compiled = [re.compile(p.expression) for p in self.patterns]
        self.always = [i for i, p in enumerate(self.patterns) if not p.literals]
        led: dict[str, list[int]] = {}
        for i, p in enumerate(self.patterns):
            for literal in p.literals:
                led.setdefault(literal, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for literal, at in led.items():
            self.automaton.add_word(literal, at)
        if led:
            self.automaton.make_automaton()
        self.empty = not led

    def candidates(self, text: str) -> list[int]:
        found = set(self.always)
        if not self.empty:
            for _, at in self.automaton.iter(text.lower()):
                found.update(at)
        return sorted(found)

    def first(self, text: str | None) -> str | None:
        return next((self.patterns[i].name for i in self.candidates(text) if self.compiled[i].search(text)), None) if text else None

    def spans(self, text: str | None) -> Iterator[tuple[int, int, Pattern]]:
        for i in self.candidates(text) if text else ():
            for m in self.compiled[i].finditer(text):
                if m.end() > m.start():
                    yield m.start(), m.end(), self.patterns[i]


@lru_cache(8)
def _library(patterns: tuple[Pattern, ...]) -> Library:
    return Library(patterns)


def first_patterns(rows: DataFrame, text: str, patterns: Sequence[Pattern], name: str = "pattern") -> DataFrame:
    """rows with the name of the first pattern by priority that the text matches, null if none does or the text is null.
    One narrow pass; what it costs grows with the literals found, not with the library."""
    at, library = rows.columns.index(text), tuple(patterns)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _library(library)
        for b in batches:
            found = pa.array([known.first(t) for t in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, found], names=[*b.schema.names, name])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(name, StringType())]))


def chosen(spans: Sequence[tuple[int, int, float]]) -> list[int]:
    """Places of the spans (start, end, weight) that do not overlap and weigh most together; of equal choices the one whose last
    span ends first. Weights are above 0."""
    order = sorted(range(len(spans)), key=lambda i: (spans[i][1], spans[i][0], -spans[i][2], i))
    ends = [spans[i][1] for i in order]
    best, take = [0.0], []
    for k, i in enumerate(order):
        before = bisect_right(ends, spans[i][0], 0, k)
        weight = best[before] + spans[i][2]
        take.append((weight > best[k] + 1e-12, before))
        best.append(max(weight, best[k]))
    out, k = [], len(order)
    while k:
        yes, before = take[k - 1]
        if yes:
            out.append(order[k - 1])
        k = before if yes else k - 1
    return out[::-1]


# Weights of a span's score, and words that leave open what is asked.
WEIGHTS = {"specific": 0.30, "numbers": 0.30, "clarity": 0.25, "structure": 0.15}
LEVELS = [(0.85, "high"), (0.60, "medium"), (0.40, "low")]
_OPEN = re.compile(r"(?i)\b(if|when|where|how|why|who|what|prove|show|explain|describe|discuss)\b")
_NUMBER = re.compile(r"\d+(?:[.,]\d+)*")


def score(text: str, line: str, pattern: Pattern) -> float:
    """0 to 1: how specific the pattern is, whether as many numbers stand in it as it asks for, how few words of its line leave
    open what is asked, and how much of its line it is."""
    numbers = len(_NUMBER.findall(text))
    parts = {
        "specific": pattern.specific,
        "numbers": 1.0 if not pattern.operands else min(1.0, numbers / pattern.operands),
        "clarity": max(0.0, 1.0 - 0.25 * len(_OPEN.findall(line))),
        "structure": min(1.0, len(text) / max(1, len(line.strip()))),
    }
    return round(sum(WEIGHTS[k] * v for k, v in parts.items()), 4)


def level(value: Column) -> Column:
    """high, medium, low, or reject."""
    return F.coalesce(*[F.when(value >= least, name) for least, name in LEVELS], F.lit("reject"))


SPAN = "name string, start int, end int, line int, last_line int, text string, score double"


def span_table(patterns: Sequence[Pattern], least: float = 0.4):
    """A table function (Arrow) of a text: its spans by name, with positions from 0, lines from 1 and score; of those that overlap
    the ones that score most together. Spans under least are none."""
    library = tuple(patterns)

    class Spans:
        def eval(self, text: str) -> Iterator[tuple]:
            if not text:
                return
            breaks = [i for i, c in enumerate(text) if c == "\n"]
            found = []
            for start, end, pattern in _library(library).spans(text):
                a, b = bisect_right(breaks, start - 1), bisect_right(breaks, end - 1)
                line = text[breaks[a - 1] + 1 if a else 0 : breaks[b] if b < len(breaks) else len(text)]
                if (value := score(text[start:end], line, pattern)) >= least:
                    found.append((pattern.name, start, end, a + 1, b + 1, text[start:end], value))
            for i in chosen([(x[1], x[2], x[6]) for x in found]):
                yield found[i]

    return F.udtf(Spans, returnType=SPAN, useArrow=True)


def document_spans(rows: DataFrame, key: str, text: str, patterns: Sequence[Pattern], least: float = 0.4) -> DataFrame:
    """key, name, start, end, line, last_line, text, score, level of the spans of each row's text, by a lateral join with
    `span_table`. Null and empty texts have none; rows without spans give no row."""
    found = span_table(patterns, least)
    return rows.select(F.col(key), F.col(text).alias("_text")).lateralJoin(found(F.col("_text").outer())).drop("_text").withColumn("level", level(F.col("score")))

"""Language ID by n-gram filters whose slots are bit masks of languages."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, cut, doc_bytes, map_batches, mix, read, rewrite_texts

UNDECIDED = "und"
TEXTS_PER_LANGUAGE = 3_000
GRAMS_PER_LANGUAGE = 60_000
#: Three-grams of a language that texts without a known four-gram are compared with.
SHORT_GRAMS = 20_000
#: A text of as many four-grams, of which no language knows that share, is in none.
FOREIGN_GRAMS = 100
FOREIGN_SHARE = 0.05
#: Fewer n-grams than these, of all languages, are too little to call a text foreign.
LEARNT_GRAMS = 2_000
#: Languages that filters are learnt for at most: what comes to the driver and the broadcast grow with them.
LANGUAGES = 256
SLOT_BITS = 20
HASHES = 2

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def grams(text: str, size: int = 4) -> np.ndarray:
    """The byte n-grams of the lower-cased text, as numbers; what stands between
    letters counts as one space."""
    raw = np.frombuffer((" " + _NOT_LETTERS.sub(" ", text.lower()).strip() + " ").encode(), np.uint8).astype(U64)
    n = len(raw) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for i in range(size):
        out = (out << U64(8)) | raw[i : i + n]
    return out


def slots(codes: np.ndarray, k: int) -> np.ndarray:
    return (mix(codes + U64(0x9E3779B97F4A7C15 * (k + 1) % 2**64)) >> U64(64 - SLOT_BITS)).astype(np.int64)


@dataclass
class Filters:
    """One Bloom filter a language, bit-sliced: bit l of every word of the table at a
    slot belongs to language l, so one lookup of the HASHES slots answers for all."""

    languages: list[str]
    table: np.ndarray  # slots x words of 64 languages
    false_rate: np.ndarray  # of each language: share of absent n-grams that it claims
    short: dict[int, list[tuple[np.ndarray, np.ndarray]]] = field(default_factory=dict)  # n to each language's n-grams, rising, and their rates
    prior: np.ndarray | None = None  # of each language: share of the texts learnt from
    learnt: int = 0  # n-grams of all languages

    @classmethod
    def of(cls, languages: list[str], members: list[np.ndarray], short: list[tuple[np.ndarray, np.ndarray]] | None = None, prior: np.ndarray | None = None) -> Filters:
        """short: of each language, its three-grams and how often each comes."""
        table = np.zeros((1 << SLOT_BITS, max(1, -(-len(languages) // 64))), U64)
        for i, codes in enumerate(members):
            for k in range(HASHES):
                table[slots(codes, k), i // 64] |= U64(1 << (i % 64))
        share = np.array([np.count_nonzero(table[:, i // 64] >> U64(i % 64) & U64(1)) / len(table) for i in range(len(languages))])
        below: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for size in (3, 2, 1):
            below[size] = []
            for codes, times in short or []:
                codes, which = np.unique(codes >> U64(8 * (3 - size)), return_inverse=True)
                times = np.bincount(which, times, len(codes))
                below[size].append((codes, (times / max(1.0, times.sum())).astype(np.float32)))
        return cls(languages, table, share**HASHES, below if short else {}, prior, sum(map(len, members)))

    def _back_off(self, text: str) -> tuple[str, float]:
        """The language with the highest mean share in the rates of the longest n-grams
        that any language knows, or else the commonest one; score is that share,
        halved for each step down from four-grams."""
        for steps, (size, known) in enumerate(self.short.items(), 1):
            codes = grams(text, size)
            codes = codes[codes != U64(0x20)]
            rates = np.zeros((len(self.languages), len(codes)))
            for i, (mine, rate) in enumerate(known):
                if len(mine) and len(codes):
                    at = np.minimum(np.searchsorted(mine, codes), len(mine) - 1)
                    rates[i] = np.where(mine[at] == codes, rate[at], 0)
            all_rates = rates.sum(axis=0)
            if all_rates.any():
                share = (rates[:, all_rates > 0] / all_rates[all_rates > 0]).mean(axis=1)
                return self.languages[int(np.argmax(share))], float(share.max()) / 2**steps
        prior = np.full(len(self.languages), 1 / len(self.languages)) if self.prior is None else self.prior
        return self.languages[int(np.argmax(prior))], float(prior.max()) / 16

    def decide(self, text: str | None) -> tuple[str, float]:
        """(language, score): the language with most n-grams after those are taken off
        that its filter would claim falsely; score is its share among all languages'.
        If no language has any, shorter n-grams decide, then the commonest language."""
        return self.judge(text)[:2]

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, whether the text is clearly in none of the languages)."""
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNDECIDED, 0.0, False
        codes = grams(text)
        mask = self.table[slots(codes, 0)]
        for k in range(1, HASHES):
            mask &= self.table[slots(codes, k)]
        hits = np.array([np.count_nonzero(mask[:, i // 64] & U64(1 << (i % 64))) for i in range(len(self.languages))], float)
        true = np.maximum(0.0, hits - self.false_rate * len(codes)) / (1 - self.false_rate)
        best = int(np.argmax(true))
        foreign = len(codes) >= FOREIGN_GRAMS and self.learnt >= LEARNT_GRAMS and bool(true[best] < FOREIGN_SHARE * len(codes))
        return (self.languages[best], float(true[best] / true.sum()), foreign) if true[best] else (*self._back_off(text), foreign)


def learn(docs: DataFrame, texts_per_language: int = TEXTS_PER_LANGUAGE, text: str = "text", lang: str = "lang") -> Filters:
    """Filters from the rows of docs with a text and a lang: of each language about
    texts_per_language different texts, taken by their hash (all, if there are no more),
    so rare languages are learnt whole at every size and copies count once.

    An n-gram belongs to each language that has it in at least two texts, or in
    1 of 5,000 of its n-grams, at half or more of the highest rate of any
    language; each language keeps its GRAMS_PER_LANGUAGE most frequent ones, and for short
    texts its SHORT_GRAMS most frequent three-grams. What comes to the driver is
    bounded by these numbers and LANGUAGES, not by docs; more languages are an error.
    """
    rows = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("hash"))
    shares = cut(rows.groupBy("lang").agg((F.lit(texts_per_language) / F.approx_count_distinct("hash", 0.02)).alias("share")))
    if (n := shares.count()) > LANGUAGES:
        raise ValueError(f"lang has {n} values; filters are learnt for at most {LANGUAGES} languages")
    picked = rows.join(shares, "lang").filter(F.pmod("hash", F.lit(1 << 20)) < F.col("share") * (1 << 20)).dropDuplicates(["lang", "hash"]).select("lang", "text")

    def count(batches):
        totals: dict[str, list] = {}
        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codes, n = np.unique(grams(t), return_counts=True)
                totals.setdefault(name, []).append((codes, n))
        for name, found in totals.items():
            codes, which = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
            times = np.bincount(which, np.concatenate([n for _, n in found]), len(codes))
            texts = np.bincount(which, minlength=len(codes))
            # with a row for the texts themselves
            yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * (len(codes) + 1), pa.string()), "gram": np.append(codes.view(np.int64), -1), "times": np.append(times.astype(np.int64), 0), "texts": np.append(texts.astype(np.int64), len(found))})

    counted = cut(picked.mapInArrow(count, "lang string, gram long, times long, texts long").groupBy("lang", "gram").agg(F.sum("times").alias("times"), F.sum("texts").alias("texts")))
    counts = counted.filter("gram != -1")
    three = counts.groupBy("lang", F.shiftright("gram", 8).alias("gram")).agg(F.sum("times").alias("times"))
    total = counts.groupBy("lang").agg(F.sum("times").alias("total"))
    by_gram = counts.join(total, "lang").withColumn("rate", F.col("times") / F.col("total")).filter((F.col("texts") > 1) | (F.col("rate") > 1 / 5000))
    best = by_gram.groupBy("gram").agg(F.max("rate").alias("best"), F.sort_array(F.collect_list(F.struct("lang", "rate"))).alias("langs"))
    chosen = best.select("gram", F.explode("langs").alias("x"), "best").filter(F.col("x.rate") >= 0.5 * F.col("best")).select(F.col("x.lang").alias("lang"), "gram", F.col("x.rate").alias("weight"))
    # the top lists of all languages in one job; a row's size tells which list it is in
    lists = chosen.withColumn("size", F.lit(4)).unionByName(three.select("lang", "gram", F.col("times").cast("double").alias("weight"), F.lit(3).alias("size")))
    place = F.row_number().over(Window.partitionBy("lang", "size").orderBy(F.col("weight").desc(), "gram"))
    top = lists.withColumn("place", place).filter(F.col("place") <= F.when(F.col("size") == 4, GRAMS_PER_LANGUAGE).otherwise(SHORT_GRAMS))
    top = top.drop("place").unionByName(counted.filter("gram = -1").select("lang", "gram", F.col("texts").cast("double").alias("weight"), F.lit(0).alias("size"))).toPandas()
    names, members, short, prior = [], [], [], []
    for name, of in top.groupby("lang", sort=True):
        part = {size: (g["gram"].to_numpy(np.int64).view(U64), g["weight"].to_numpy(float)) for size, g in of.groupby("size")}
        none = np.zeros(0, U64), np.zeros(0)
        names.append(name)
        members.append(part.get(4, none)[0])
        short.append(part.get(3, none))
        prior.append(part[0][1][0])
    prior = np.array(prior, float)
    return Filters.of(names, members, short, prior / max(1.0, prior.sum()))


def identify(docs: DataFrame, filters: Filters, *more: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, lang_pred, score and the columns named in more: one row for each row.

    Whole texts decide, and nothing else of a row. A null text or one without a letter
    gives `und` with score 0 (and so does every text where no language was learnt); any
    other gives a language, with a score under 0.5 where it has no n-gram that a
    language has more than chance. Of equal languages the first by name is taken. The
    filters are a broadcast of fixed size; the pass is narrow.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    kinds = dict(docs.dtypes)

    def rows(ids, raws, *rest):
        found = [shared.value.decide(None if r is None else r.decode()) for r in raws]
        return {"doc_id": ids, "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]} | dict(zip(more, rest, strict=True))

    schema = f"doc_id {kinds[doc_id]}, lang_pred string, score double" + "".join(f", `{c}` {kinds[c]}" for c in more)
    return map_batches(doc_bytes(docs, *more, text=text, doc_id=doc_id), rows, schema)


def held_out(doc_id: str = "doc_id"):
    """Rows that no model may learn from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    filters = learn(docs.filter(~held_out()))
    return identify(docs, filters).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def language_stage(docs: DataFrame) -> DataFrame:
    """The rows with a language, with all columns: neither `und` nor clearly in none of the
    languages (FOREIGN_GRAMS n-grams or more, of which none knows FOREIGN_SHARE more than
    chance). A low score alone, as short texts have, drops no row.

    doc_id need not be unique and every column is carried as it is: rows are judged where they
    stand, in one pass.
    """
    filters = learn(docs.filter(~held_out()))
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def decided(raw):
        lang, _, foreign = shared.value.judge(None if raw is None else raw.decode())
        return lang != UNDECIDED and not foreign, raw

    return rewrite_texts(docs, decided)

"""Quality classifier: document evidence and sites' posteriors by empirical Bayes."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, cut, doc_bytes, map_batches, read

SLOTS = 1 << 16
#: Labelled rows that the document classifier learns from, at most.
SAMPLE_ROWS = 20_000
#: A document's evidence is its mean log odds a feature, times this many features at most.
FEATURES = 20.0
#: Words that a task process remembers, and the bytes of the longest of them.
MEMO, LONGEST = 200_000, 64

_SHAPES = ((re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[0-9]+"), b"0"))
_memo: dict[bytes, tuple[int, int]] = {}


def features(word: bytes) -> tuple[int, int]:
    """Slots of the word's letters and of its shape (runs of capitals, small letters and
    digits as one letter each, other characters as they are)."""
    found = _memo.get(word)
    if found is None:
        shape = word
        for pattern, letter in _SHAPES:
            shape = pattern.sub(letter, shape)
        found = xxhash.xxh3_64_intdigest(b"w" + word.translate(LOWER)) % SLOTS, xxhash.xxh3_64_intdigest(b"s" + shape) % SLOTS
        if len(word) <= LONGEST:
            if len(_memo) >= MEMO:
                _memo.clear()
            _memo[word] = found
    return found


def slot_counts(raw: bytes | None) -> np.ndarray:
    return np.array([features(w) for w in (raw or b"").split()], np.int64).reshape(-1)


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Log odds of good against bad for each slot, from at most sample_rows labels (those
    of least hash, so that their broadcast has a fixed bound): each task adds up its own
    counts (2 x SLOTS numbers), their sums are grouped by slot."""
    kind = dict(docs.dtypes)["doc_id"]
    marked = labels.select(F.col("doc_id").cast(kind).alias("doc_id"), F.col(label).cast("int").alias("good")).filter("good is not null and doc_id is not null").groupBy("doc_id").agg(F.min("good").alias("good"))
    marked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select(F.col("doc_id"), F.col("text").cast("binary").alias("raw")).filter(F.col("doc_id").isNotNull()).join(F.broadcast(marked), "doc_id").select("raw", "good")

    def count(batches):
        sums = np.zeros((2, SLOTS), np.int64)
        for b in batches:
            for raw, good in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                # each slot counts once a document, so that long ones don't drown the rest
                sums[int(good > 0), np.unique(slot_counts(raw))] += 1
        good, slot = np.nonzero(sums)
        yield pa.RecordBatch.from_pydict({"slot": slot, "good": good, "n": sums[good, slot]})

    counts = rows.mapInArrow(count, "slot long, good long, n long").groupBy("slot").agg(F.sum(F.when(F.col("good") == 1, F.col("n"))).alias("good"), F.sum(F.when(F.col("good") == 0, F.col("n"))).alias("bad")).fillna(0).toPandas()
    good, bad = np.zeros(SLOTS), np.zeros(SLOTS)
    good[counts["slot"]], bad[counts["slot"]] = counts["good"], counts["bad"]
    odds = np.log((good + 1) / (good.sum() + SLOTS)) - np.log((bad + 1) / (bad.sum() + SLOTS))
    return np.where(good + bad >= 2, odds, 0.0)


def strength(between: float | None, within: float | None, scale: float | None) -> float:
    """Pseudo documents of the prior that the spread between groups says: method of moments, 2 to 1,000."""
    if not scale or between is None or between <= within:
        return 1000.0
    return min(1000.0, max(2.0, scale / (between - within) - 1))


def _shrunk(groups: DataFrame, prior: str, name: str) -> DataFrame:
    """groups(n, total of p, prior) with the group's mean of p drawn to its prior."""
    p = F.col(prior)
    mean = F.col("total") / F.col("n")
    spread = groups.agg(F.sum(F.col("n") * (mean - p) ** 2), F.sum(p * (1 - p)), F.sum(F.col("n") * p * (1 - p))).first()
    s = strength(*spread)
    return groups.withColumn(name, (F.col("total") + s * p) / (F.col("n") + s))


#: Sites up to which their posteriors are sent to every task, about 100 bytes each.
BROADCAST_SITES = 50_000


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", label: str = "quality", keep_above: float = 0.5, sample_rows: int = SAMPLE_ROWS, salts: int = 64) -> DataFrame:
    """doc_id, p_document, p_host, p_path, quality, kept: one row for each row.

    p_document is the naive Bayes posterior under the global prior; p_host and p_path
    (host and path level) are means of it over all the group's documents, shrunk to
    the level above; quality replaces the global prior by p_path. A text without
    words has no evidence and takes its path's posterior; null hosts and paths are groups of
    their own; without labels of both kinds all have p_document 0.5 or the labels' mean,
    clipped. Documents whose labels contradict each other are learnt from by their least label.

    Rows are added up once, partially, by host and path; both levels are computed
    on those sums. Posteriors come back to the rows by a broadcast of at most
    BROADCAST_SITES sites, beyond that by a join in which each site is dealt into
    salts parts, so that the rows of a hot one spread.
    """
    weights = learn(docs, labels, label, sample_rows)
    mean = labels.agg(F.avg((F.col(label) > 0).cast("double"))).first()[0]
    prior = min(0.99, max(0.01, 0.5 if mean is None else mean))
    base = float(np.log(prior / (1 - prior)))
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    kind = dict(docs.dtypes)["doc_id"]

    def rows(ids, raws, hosts, paths):
        evidence = []
        for raw in raws:
            slots = slot_counts(raw)
            evidence.append(float(shared.value[slots].mean() * min(FEATURES, len(slots))) if len(slots) else 0.0)
        return {"doc_id": ids, "host": hosts, "path": paths, "evidence": evidence}

    sites = [F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias(n) for c, n in ((host, "host"), (path, "path"))]
    scored = cut(map_batches(doc_bytes(docs, *sites), rows, f"doc_id {kind}, host string, path string, evidence double"))
    logistic = lambda x: 1 / (1 + F.exp(-x))
    logit = lambda p: F.log(p / (1 - p))
    p = logistic(F.lit(base) + F.col("evidence"))
    by_path = cut(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(p).alias("total")))
    by_host = by_path.groupBy("host").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).withColumn("p_global", F.lit(prior))
    with_host = by_path.join(_shrunk(by_host, "p_global", "p_host").select("host", "p_host"), "host")
    posteriors = cut(_shrunk(with_host, "p_host", "p_path").select("host", "path", "p_host", "p_path"))
    if posteriors.count() <= BROADCAST_SITES:
        joined = scored.join(F.broadcast(posteriors), ["host", "path"])
    else:
        dealt = scored.withColumn("salt", F.pmod(F.xxhash64("doc_id", "evidence"), F.lit(salts)))
        joined = dealt.join(posteriors.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))), ["host", "path", "salt"])
    clipped = F.least(F.lit(0.999), F.greatest(F.lit(0.001), F.col("p_path")))
    return joined.select("doc_id", p.alias("p_document"), "p_host", "p_path", logistic(F.col("evidence") + logit(clipped)).alias("quality")).withColumn("kept", F.col("quality") > keep_above)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))

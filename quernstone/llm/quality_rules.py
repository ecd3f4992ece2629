"""Quality rules: counts within a text, then line frequency across documents."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, SPACED, WHITE, cut, doc_bytes, map_batches, read, window_hashes, word_hashes

_SYMBOLS = b"#*$%&|<>"
_NOT_A_POINT = WHITE + bytes(range(0x80, 0xC0))
_DIGITS = re.compile(rb"[0-9]+")


def text_counts(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = word_hashes(raw.translate(SPACED))
    lines = Counter(line for line in raw.split(b"\n") if line.translate(None, WHITE))
    windows = window_hashes(words, 3)
    covered = np.zeros(len(words), bool)
    if len(windows):
        _, which, often = np.unique(windows, return_inverse=True, return_counts=True)
        at = np.flatnonzero(often[which] > 1)
        for i in range(3):
            covered[at + i] = True
    return len(words), len(raw.translate(None, _NOT_A_POINT)), len(raw) - len(raw.translate(None, _SYMBOLS)), sum(lines.values()) - len(lines), int(covered.sum())


def line_hashes(raw: bytes) -> tuple[list[int], list[int]]:
    """Of each different normalised line (lower case A-Z, one space between words,
    any number as one digit): its hash and the words that it has in this text."""
    found: Counter = Counter()
    for line in raw.split(b"\n"):
        words = line.translate(LOWER).split()
        if words:
            found[_DIGITS.sub(b"0", b" ".join(words))] += len(words)
    return [xxhash.xxh3_64_intdigest(line) - (1 << 63) for line in found], list(found.values())


def quality_rules(
    docs: DataFrame,
    host: str = "source",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    line_docs: int = 10,
    line_share: float = 0.01,
    line_ceiling: int = 1_000,
    min_left_share: float = 0.3,
    spare_first: bool = False,
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """doc_id, the five counts, base_failed, n_frequent_words (in lines that too many
    documents of the host have), kept: one row for each row.

    base_failed: fewer than min_words words, or over max_repeat_percent % of them
    in 3-word windows found twice. A normalised line is too frequent if more than
    line_docs different documents (by doc_id; a row without one is a document) of its host
    have it, and more than line_share of them or more than line_ceiling. A document whose other
    lines hold fewer than min_words words, or less than min_left_share of its words, is
    depleted and not kept. With spare_first, for the first row of each text in a host copies
    of a text count once, so that of a group of copies one can stay; the others are judged
    by all documents. A null text has no words and fails; null hosts are one host;
    a host's repeated rows of one doc_id and text are one document, judged alike.

    Counts come from one narrow pass, written once. A text's lines are counted once, weighted with
    its documents, by partial aggregations over (host, text) and (host, line), so a hot
    host, text or line sends a row a task; only frequent lines are joined back, on (host, line),
    where a hot line's rows can be split.
    """
    kind = dict(docs.dtypes)[doc_id]

    def rows(ids, raws, hosts, keys):
        counts, lines = [text_counts(r or b"") for r in raws], [line_hashes(r or b"") for r in raws]
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        return {"doc_id": ids, "host": hosts, "text_key": keys} | {n: [c[i] for c in counts] for i, n in enumerate(names)} | {"hashes": [x[0] for x in lines], "line_words": [x[1] for x in lines]}

    counted = cut(
        map_batches(
            doc_bytes(docs, F.coalesce(F.col(host).cast("string"), F.lit("\0")).alias("host"), F.xxhash64(F.col(text)).alias("text_key"), text=text, doc_id=doc_id),
            rows,
            f"doc_id {kind}, host string, text_key long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, hashes array<long>, line_words array<long>",
        ).withColumn("row", F.monotonically_increasing_id())
    )
    lined = counted.filter(F.size("hashes") > 0)
    document = F.struct("doc_id", F.when(F.col("doc_id").isNull(), F.col("row")))
    # of each text of a host: its first row by doc_id, which stands for its lines, and its documents
    texts = lined.groupBy("host", "text_key", document.alias("document")).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
    texts = cut(texts.groupBy("host", "text_key").agg(F.min("first").alias("first"), F.count("*").alias("docs")).select("host", F.col("first.row").alias("row"), "docs"))
    of_host = texts.groupBy("host").agg(F.sum("docs").alias("host_docs"), F.count("*").alias("host_texts"))
    too_many = lambda n, of: (F.col(n) > line_docs) & ((F.col(n) > line_share * F.col(of)) | (F.col(n) > line_ceiling))
    frequent = (
        lined.select("row", "host", "hashes")
        .join(texts.select("row", "docs"), "row")
        .select("host", "docs", F.explode("hashes").alias("line"))
        .groupBy("host", "line")
        .agg(F.sum("docs").alias("docs"), F.count("*").alias("texts"))
        .filter(F.col("docs") > line_docs)
        .join(of_host, "host")
        .filter(too_many("docs", "host_docs"))
        .select("host", "line", too_many("texts", "host_texts").alias("by_texts"))
    )
    lines = lined.select("row", "host", F.explode(F.arrays_zip("hashes", "line_words")).alias("x")).select("row", "host", F.col("x.hashes").alias("line"), F.col("x.line_words").alias("words"))
    lost = lines.join(frequent, ["host", "line"]).groupBy("row").agg(F.sum("words").alias("lost"), F.sum(F.when(F.col("by_texts"), F.col("words")).otherwise(0)).alias("lost_by_texts"))
    lost = lost.join(texts.select("row", F.lit(True).alias("is_first")), "row", "left") if spare_first else lost.withColumn("is_first", F.lit(False))
    lost = lost.select("row", F.when(F.col("is_first"), F.col("lost_by_texts")).otherwise(F.col("lost")).alias("lost"))
    left = F.col("n_words") - F.col("n_frequent_words")
    return (
        counted.drop("hashes", "line_words", "text_key", "host")
        .join(lost, "row", "left")
        .withColumn("n_frequent_words", F.coalesce("lost", F.lit(0)))
        .withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")))
        .withColumn("kept", ~F.col("base_failed") & (left >= min_words) & (left >= min_left_share * F.col("n_words")))
        .drop("row", "lost")
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"))

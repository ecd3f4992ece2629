"""The corpus pipeline: each stage reads what the one before has written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quernstone.llm.common import read, shared_folder
from quernstone.llm.decontamination import decontaminate
from quernstone.llm.language_id import language_stage
from quernstone.llm.line_dedup import dedup_lines
from quernstone.llm.ngram_join import Rule, join_ngrams
from quernstone.llm.packing import pack


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is decided; null texts and those without a letter go."""
    return language_stage(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of lines that an earlier document has are taken out; documents of which no
    word is left go. Rows with a null doc_id or text stay as they are."""
    return dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents with a similarity of 0.8 or more by shingles of
    five words, the one of the least doc_id stays. Rows with a null doc_id and rows
    without words are near to nothing and stay."""
    others = join_ngrams(docs, Rule(words=5, percent=80)).filter("component_id != doc_id").select("doc_id")
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items are cut out; documents mostly made of them go. Null texts stay."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences."""
    return pack(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing)]

#: SQL cannot express the tokenizer, the classifier or the alignment; tests/llm/test_pipeline.py holds every
#: stage, and run() as a whole, against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what each keeps is written as Parquet in the shared folder."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

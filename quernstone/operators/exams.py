"""Exam scores: sections, totals, weak skills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def section_scores(graded: DataFrame, by: list[str], marks: float, penalty: Column, scale: tuple[int, int] | None = None) -> DataFrame:
    """Counts, marks and accuracy by section of rows with correct (null: not attempted).

    penalty is what a wrong answer adds. Accuracy is over the attempted, to four places, 0 without any;
    scaled lies within scale by the share of all served that are correct. Partial sums, no
    answers are collected.
    """
    ok = F.col("correct")
    right, tried, n = F.count_if(ok), F.count(ok), F.count("*")
    out = graded.groupBy(*by).agg(
        n.alias("questions"),
        tried.alias("attempted"),
        right.alias("correct"),
        F.count_if(~ok).alias("wrong"),
        (n - tried).alias("unattempted"),
        F.sum(F.when(ok, float(marks)).when(~ok, penalty).otherwise(0.0)).alias("raw"),
        (n * float(marks)).alias("max_raw"),
    )
    out = out.withColumn("accuracy", F.when(F.col("attempted") > 0, F.round(F.col("correct") / F.col("attempted"), 4)).otherwise(0.0))
    if scale is None:
        return out
    low, high = scale
    return out.withColumn("scaled", F.bround(low + (high - low) * F.col("correct") / F.col("questions"), 0).cast("long"))


def exam_scores(sections: DataFrame, by: list[str], steps: tuple[int, int, int]) -> DataFrame:
    """total_raw, max_raw, summed (of scaled sections) and stepped: the mean share of correct
    answers over (low, high), in steps from low on."""
    low, high, step = steps
    share = F.avg(F.when(F.col("max_raw") > 0, F.col("correct") / F.col("questions")))
    return sections.groupBy(*by).agg(
        F.round(F.sum("raw"), 2).alias("total_raw"),
        F.sum("max_raw").alias("max_raw"),
        F.sum("scaled").alias("summed"),
        (low + F.floor((high - low) * F.coalesce(share, F.lit(0.0)) / step + 0.5) * step).alias("stepped"),
    )


def weak_skills(graded: DataFrame, by: list[str], skill: str, threshold: float = 0.7) -> DataFrame:
    """Skills under the threshold, worst first (place); what was not attempted counts against a skill."""
    right = F.count_if(F.col("correct"))
    out = graded.groupBy(*by, skill).agg(F.count("*").alias("questions"), right.alias("correct"), (right / F.count("*")).alias("share")).filter(F.col("share") < threshold)
    out = out.withColumn("accuracy", F.round("share", 3)).drop("share")
    return out.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("accuracy", F.col("questions").desc(), skill)))

"""Where lineage ends: tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a folder of our own
    only where none is set and driver and tasks are one process on one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quernstone-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows of df from a written table: a lost executor reads it again and repeats nothing, later steps
    read only their columns, and its size tells Spark which joins can broadcast."""
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that a part of a dealt table holds at most, at least, and parts up to which the least counts.
MOST_DEALT, LEAST_DEALT, SPREAD = 500_000, 10_000, 64


def dealt(rows: DataFrame, most: int, *columns: str) -> DataFrame:
    """rows (most of them, or fewer) by columns in parts whose number grows with them, so that what a task sorts, joins or
    counts has a bound: Spark's own number of parts is fixed, and it merges small ones."""
    return rows.repartition(max(1, -(-most // MOST_DEALT), min(SPREAD, -(-most // LEAST_DEALT))), *columns)

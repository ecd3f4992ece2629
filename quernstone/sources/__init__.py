"""Readers and writers: tables, JSON lines, CSV, page stores, and keyed sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of a folder of tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines under an explicit schema (no inference pass); blank lines are skipped.
    path may be a glob; source_file says where a row comes from."""
    return spark.read.schema(schema).json(path).withColumn("source_file", F.input_file_name())


def read_json_documents(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One JSON object a file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_page_store(spark: SparkSession, folder: str, meta_schema: StructType | str) -> DataFrame:
    """Page texts `<stem>_ocr.md` joined with their `<stem>_meta.json`, by stem."""
    stem = lambda suffix: F.regexp_extract(F.input_file_name(), rf"([^/]+){suffix}$", 1)
    meta = spark.read.schema(meta_schema).option("multiLine", True).option("pathGlobFilter", "*_meta.json").json(folder).withColumn("stem", stem(r"_meta\.json"))
    text = spark.read.option("pathGlobFilter", "*_ocr.md").text(folder, wholetext=True).withColumn("stem", stem(r"_ocr\.md"))
    return meta.join(text.withColumnRenamed("value", "text"), "stem")


def read_flat_aliases(spark: SparkSession, path: str) -> DataFrame:
    """alias, canonical from a flat two-level list: `canonical: name` opens an entry,
    `- alias` lines follow it. Each file is one ordered text."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("at", "line"), F.input_file_name().alias("file"))
    name = F.regexp_extract("line", r"^\s*-?\s*canonical:\s*[\"']?([^\"'#]+?)[\"']?\s*$", 1)
    alias = F.regexp_extract("line", r"^\s*-\s+[\"']?([^\"':#]+?)[\"']?\s*$", 1)
    opened = F.last(F.when(name != "", name), ignorenulls=True).over(Window.partitionBy("file").orderBy("at"))
    return lines.withColumn("canonical", opened).filter((alias != "") & F.col("canonical").isNotNull()).select(alias.alias("alias"), "canonical")


def vector(column: Column | str) -> Column:
    """`[1,2,3]` as an array of floats."""
    return F.transform(F.split(F.regexp_replace(column, r"[\[\]\s]", ""), ","), lambda x: x.cast("float"))


def vector_text(column: str) -> Column:
    """An array of numbers as `[1.0,2.0]`."""
    return F.concat(F.lit("["), F.array_join(F.transform(column, lambda x: x.cast("string")), ","), F.lit("]"))


# Keyed sinks: each takes the target's rows and new rows and returns the target's next rows.


def insert_new(target: DataFrame, rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """First wins: rows whose key the target lacks, of each key the first by order."""
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("_n = 1").drop("_n")
    return target.unionByName(first.join(target, keys, "left_anti").select(*target.columns))


def upsert_last(target: DataFrame, rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last wins, by order; new rows win over the target's at equal order."""
    both = target.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
    ranked = Window.partitionBy(*keys).orderBy(F.col(order).desc(), F.col("_new").desc())
    return both.withColumn("_n", F.row_number().over(ranked)).filter("_n = 1").drop("_n", "_new")


def accumulate(target: DataFrame, rows: DataFrame, keys: list[str], value: str, floor: float | None = None) -> DataFrame:
    """Adds the values of equal keys; floor is the least that a sum may be."""
    total = F.sum(value)
    return target.unionByName(rows).groupBy(*keys).agg((F.greatest(F.lit(floor), total) if floor is not None else total).alias(value))


def guarded_upsert(target: DataFrame, rows: DataFrame, key: str, verdict: str, open_prefix: str) -> DataFrame:
    """Rows replace the target's only where it has none or one that starts with open_prefix."""
    closed = target.filter(~F.coalesce(F.col(verdict).startswith(open_prefix), F.lit(False)))
    taken = rows.join(closed, key, "left_anti").select(*target.columns)
    return target.join(taken, key, "left_anti").select(*target.columns).unionByName(taken)


def reconcile(target: DataFrame, asserted: DataFrame, keys: list[str], owner: str, mine: str) -> DataFrame:
    """Asserted edges plus the target's, without those this owner made and no longer asserts."""
    kept = target.filter(F.coalesce(F.col(owner) != mine, F.lit(True))).unionByName(target.filter(F.col(owner) == mine).join(asserted, keys, "left_semi"))
    return kept.unionByName(asserted.join(target, keys, "left_anti").select(*target.columns))


def replace_own(target: DataFrame, rows: DataFrame, tag: str, mine: str) -> DataFrame:
    """Replaces all rows of one source tag."""
    return target.filter(F.coalesce(F.col(tag) != mine, F.lit(True))).unionByName(rows.select(*target.columns))


def write_ledger(events: DataFrame, path: str, ts: str = "ts") -> None:
    """Appends events to a ledger partitioned by month, which month_filter prunes."""
    events.withColumn("event_month", F.date_format(ts, "yyyy-MM")).write.mode("append").partitionBy("event_month").parquet(path)


def month_filter(ledger: DataFrame, start: str, end: str, ts: str = "ts") -> DataFrame:
    """Events of [start, end), with the predicate on the partition column that the range implies."""
    moment = F.col(ts)
    return ledger.filter((moment >= F.lit(start).cast(ledger.schema[ts].dataType)) & (moment < F.lit(end).cast(ledger.schema[ts].dataType)) & F.col("event_month").between(start[:7], end[:7]))


def run_report(metrics: dict[str, DataFrame]) -> DataFrame:
    """name, rows of several outputs, as one table to append to a run log."""
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows") for name, df in metrics.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def promotion_diff(live: DataFrame, shadow: DataFrame, keys: list[str], value: str) -> DataFrame:
    """change (added, removed, changed) of each key in which a shadow table differs from the live one."""
    a, b = (df.select(*keys, F.struct(value).alias(n)) for df, n in ((live, "_old"), (shadow, "_new")))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    return a.join(b, keys, "full_outer").select(*keys, change.alias("change")).filter("change is not null")

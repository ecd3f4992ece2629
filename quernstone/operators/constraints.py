"""Constraints as data: rules over tables, compiled to one scan a table and one exchange a key; what comes out are the rows that break them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.lineage import cut, dealt


@dataclass(frozen=True)
class Rule:
    """kind: required, range (low, high; either may be None), enum (values), matches (expression), check (a SQL predicate; null
    passes), unique (columns; with where only among rows that it holds for; null keys are no repeats), foreign (columns to
    other.to; null keys point at nothing and pass)."""

    name: str
    table: str
    kind: str
    columns: tuple[str, ...]
    values: tuple = ()
    low: float | None = None
    high: float | None = None
    expression: str = ""
    where: str = ""
    other: str = ""
    to: tuple[str, ...] = field(default=())


def _broken(rule: Rule) -> Column:
    """Whether a row breaks a rule that looks at this row alone."""
    c = F.col(rule.columns[0]) if rule.columns else None
    if rule.kind == "required":
        return reduce(lambda a, b: a | b, [F.col(x).isNull() for x in rule.columns])
    if rule.kind == "range":
        out = [c < rule.low] if rule.low is not None else []
        out += [c > rule.high] if rule.high is not None else []
        return F.coalesce(reduce(lambda a, b: a | b, out), F.lit(False))
    if rule.kind == "enum":
        return F.coalesce(~c.isin(*rule.values), F.lit(False))
    if rule.kind == "matches":
        return F.coalesce(~c.rlike(rule.expression), F.lit(False))
    if rule.kind == "check":
        return ~F.coalesce(F.expr(rule.expression), F.lit(True))
    raise ValueError(f"{rule.name}: no rule of one row is of kind {rule.kind}")


def _key(columns: Sequence[str]) -> Column:
    return F.to_json(F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(columns)]))


def _counted(rows: DataFrame, most: int, keys: Sequence[str]) -> DataFrame:
    """keys, n: how often each is there. Parts of a key are counted first, then their counts by key, so a hot key is few rows where it
    meets, and both are dealt into parts that grow with the table, so no task's counts do."""
    salted = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(16)))
    some = dealt(salted, most, *keys, "_salt").groupBy(*keys, "_salt").agg(F.count("*").alias("n"))
    return dealt(some, most, *keys).groupBy(*keys).agg(F.sum("n").alias("n"))


def violations(tables: dict[str, DataFrame], rules: Sequence[Rule], identity: dict[str, list[str]]) -> DataFrame:
    """rule, table, row (its identity as JSON; of a repeated key the key) and n (1, or how often a key is there): every row
    that breaks a rule. identity: of each table the columns that name a row.

    All rules of one row are one scan of a table. Uniqueness is a count by key, of parts of each key first, so a key
    that all rows share is a row a part. A foreign key is counted by value first, so a hot value meets the other table
    once, then an anti join on the other's different keys, which Spark broadcasts only where its size is known to be small.
    An empty table breaks nothing; a rule of a table that isn't there is an error."""
    if missing := sorted({x for r in rules for x in (r.table, r.other) if x} - set(tables)):
        raise ValueError(f"no such table: {', '.join(missing)}")
    met = {x for r in rules if r.kind in ("unique", "foreign") for x in (r.table, r.other) if x}
    sizes = {name: tables[name].count() for name in sorted(met)}
    parts = []
    for name, rows in tables.items():
        mine = [r for r in rules if r.table == name]
        single = [r for r in mine if r.kind not in ("unique", "foreign")]
        if single:
            found = F.array_compact(F.array(*[F.when(_broken(r), F.lit(r.name)) for r in single]))
            marked = rows.select(found.alias("rules"), _key(identity[name]).alias("row")).filter(F.size("rules") > 0)
            parts.append(marked.select(F.explode("rules").alias("rule"), F.lit(name).alias("table"), "row", F.lit(1).cast("long").alias("n")))
        for r in [x for x in mine if x.kind == "unique"]:
            some = rows.filter(r.where) if r.where else rows
            some = some.dropna(subset=list(r.columns))
            twice = _counted(some.select(*r.columns), sizes[name], r.columns).filter("n > 1")
            parts.append(twice.select(F.lit(r.name).alias("rule"), F.lit(name).alias("table"), _key(r.columns).alias("row"), "n"))
        for r in [x for x in mine if x.kind == "foreign"]:
            some = (rows.filter(r.where) if r.where else rows).dropna(subset=list(r.columns))
            keys = [f"_k{i}" for i in range(len(r.columns))]
            values = _counted(some.select(*[F.col(c).alias(k) for c, k in zip(r.columns, keys, strict=True)]), sizes[name], keys)
            known = _counted(tables[r.other].select(*[F.col(c).alias(k) for c, k in zip(r.to, keys, strict=True)]), sizes[r.other], keys).drop("n")
            lost = values.join(known, [f"_k{i}" for i in range(len(r.to))], "left_anti")
            key = F.to_json(F.struct(*[F.col(f"_k{i}").alias(f"k{i}") for i in range(len(r.columns))]))
            parts.append(lost.select(F.lit(r.name).alias("rule"), F.lit(name).alias("table"), key.alias("row"), "n"))
    return reduce(DataFrame.unionByName, parts)


def rule_report(found: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """rule, table, kind, rows: how many rows break each rule, none included; a value that points at nothing counts its rows, a key
    that is there n times n - 1."""
    spark = found.sparkSession
    names = spark.createDataFrame([(r.name, r.table, r.kind) for r in rules], "rule string, table string, kind string")
    counts = cut(found).join(names.drop("table"), "rule").groupBy("rule").agg(F.sum(F.col("n") - F.when(F.col("kind") == "unique", 1).otherwise(0)).alias("rows"))
    return names.join(counts, "rule", "left").fillna(0, ["rows"])

"""Connected components of links, distributed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Links that one task may hold for its union-find.
BLOCK = 400_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for all nodes that aren't that one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    up = np.arange(len(nodes))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for x, y in zip(at[: len(a)], at[len(a) :], strict=True):
        x, y = top(x), top(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    tops = np.array([top(x) for x in range(len(nodes))], np.int64)
    below = tops != np.arange(len(nodes))
    return nodes[below], nodes[tops[below]]


def _contract(edges: DataFrame) -> DataFrame:
    def run(batches):
        found = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if found:
            a, b = forest(*(np.concatenate([x[i] for x in found]) for i in (0, 1)))
            yield pa.RecordBatch.from_pydict({"a": a, "b": b})

    return edges.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, block: int = BLOCK) -> DataFrame:
    """node, component (the least node that links reach) for all nodes with a link
    to another, from edges(a long, b long).

    While the links outnumber a block, tasks first replace their block's links by a
    spanning forest, then rounds of large and small stars (joins and minima, each
    round cut by a checkpoint) go on until nothing changes; a block of links ends in
    one union-find of bounded size. No group is collected.
    """
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    edges = cut(edges)
    n = edges.count()
    if n <= block:
        edges = cut(_contract(edges.coalesce(1)).select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        edges = cut(_contract(edges.repartition(-(-n // block), "a", "b")).select(F.col("b").alias("a"), F.col("a").alias("b")))
        seen = None
        while (state := edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()) != seen:
            seen = state
            both = edges.union(edges.select(F.col("b"), F.col("a"))).toDF("v", "u")
            least = both.groupBy("v").agg(F.least(F.col("v"), F.min("u")).alias("m"))
            edges = both.join(least, "v").filter("u > v and u != m").select(F.col("m").alias("a"), F.col("u").alias("b")).distinct()
            down = edges.groupBy("b").agg(F.min("a").alias("m"))
            edges = cut(edges.join(down, "b").filter("a != m").select(F.col("m").alias("a"), F.col("a").alias("b")).union(down.select(F.col("m"), F.col("b"))).distinct())
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(edges.select("a", "a").distinct())

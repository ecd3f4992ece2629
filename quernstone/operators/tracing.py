"""Knowledge tracing as a product of matrices: runs of attempts compose, so they can be split, stored and merged."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions import BKT, LEARN_BY_DIFFICULTY
from quernstone.lineage import cut

# An attempt turns p into (a p + b) / (c p + d). Two in a row are one such map, whose numbers are
# the product of the 2 x 2 matrices; a common factor changes nothing, so products are
# scaled to a greatest entry of 1 and neither grow nor vanish. No entry is negative, so nothing cancels.


def products(m: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The product of each segment of m, later ones to the left: neighbours are multiplied pairwise
    until each segment is one matrix, so there are as many steps as a segment's length has bits."""
    segment = np.repeat(np.arange(len(begins)), np.diff([*begins, len(m)]))
    while len(m) > len(begins):
        first = np.r_[0, np.flatnonzero(np.diff(segment)) + 1]
        place = np.arange(len(m)) - first[segment]
        left = np.flatnonzero(place % 2 == 0)
        paired = (left + 1 < len(m)) & (segment[np.minimum(left + 1, len(m) - 1)] == segment[left])
        out = m[left]
        out[paired] = m[left[paired] + 1] @ out[paired]
        out /= np.abs(out).max((1, 2), keepdims=True)
        m, segment = out, segment[left]
    return m


def _composed(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Rows (keys, seq, n, a, b, c, d), sorted by keys: one row for each stretch of equal keys in a
    batch, joined with the one before it where that goes on."""
    open_row: list | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_pylist() for c in batch.columns[: keys + 1]]
        ids = list(zip(*columns[:keys], strict=True))
        begins = np.array([0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1])])
        n = np.add.reduceat(batch.column(keys + 1).to_numpy(), begins)
        m = products(np.stack([batch.column(keys + 2 + i).to_numpy() for i in range(4)], 1).reshape(-1, 2, 2), begins)
        rows = [[ids[b], columns[keys][b], int(k), x] for b, k, x in zip(begins, n, m, strict=True)]
        if open_row and open_row[0] == rows[0][0]:
            x = rows[0][3] @ open_row[3]
            rows[0] = [open_row[0], open_row[1], open_row[2] + rows[0][2], x / np.abs(x).max()]
        elif open_row:
            rows.insert(0, open_row)
        open_row = rows.pop()
        if rows:
            yield _batch(rows, batch.schema)
    if open_row:
        yield _batch([open_row], batch.schema)


def _batch(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    columns = [*zip(*(r[0] for r in rows), strict=True), [r[1] for r in rows], [r[2] for r in rows], *(np.array([r[3] for r in rows]).reshape(-1, 4).T)]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _sorted_products(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """keys, seq (of the first row), n, a, b, c, d: rows in ranges of (keys, order), composed where they lie. A
    learner with a great many attempts lies in many ranges and keeps a row of each."""
    spread = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    spread = spread.select(*keys, F.monotonically_increasing_id().alias("seq"), "n", "a", "b", "c", "d")
    return spread.mapInArrow(lambda b: _composed(b, len(keys)), spread.schema)


def matrices(attempts: DataFrame, keys: list[str], order: list[str], difficulty: str | None = None) -> DataFrame:
    """keys, seq, n, a, b, c, d: for each value of keys a few rows whose product, by seq, is what all its attempts
    do to a learner's p. attempts: keys, order, correct (null: ungraded, counts but changes nothing) and difficulty
    (unknown ones learn at the common rate).

    Attempts become numbers and go once by ranges of (keys, order) through tasks, so one with ten million
    attempts is in many of them; no task or array holds all of one. Keys may be null, which is a key."""
    rates = [F.when(F.col(difficulty) == level, rate) for level, rate in LEARN_BY_DIFFICULTY.items()] if difficulty else []
    rows = attempts.select(*keys, *order, F.coalesce(F.col("correct").cast("int"), F.lit(-1)).alias("correct"), F.coalesce(*rates, F.lit(BKT["learn"])).alias("learn"))
    graded, hit = F.col("correct") >= 0, F.when(F.col("correct") == 1, 1 - BKT["slip"]).otherwise(BKT["slip"])
    miss = F.when(F.col("correct") == 1, BKT["guess"]).otherwise(1 - BKT["guess"])
    entry = lambda value, same: F.when(graded, value).otherwise(F.lit(same))
    t = F.col("learn")
    rows = rows.withColumns({"n": F.lit(1).cast("long"), "a": entry((1 - t) * hit + t * (hit - miss), 1.0), "b": entry(t * miss, 0.0), "c": entry(hit - miss, 0.0), "d": entry(miss, 1.0)})
    return _sorted_products(rows.select(*keys, *order, "n", "a", "b", "c", "d"), keys, order)


def traced(runs: DataFrame, key: str, order: list[str], prior: float = BKT["prior"]) -> DataFrame:
    """key, p_learned, attempts from runs(key, order, n, a, b, c, d): applied in order. A key has
    as many runs as it has periods, times the tasks that one was split over."""
    step = lambda p, r: (r["a"] * p + r["b"]) / (r["c"] * p + r["d"])
    seq = F.array_sort(F.collect_list(F.struct(*order, "a", "b", "c", "d")))
    return runs.groupBy(key).agg(seq.alias("seq"), F.sum("n").alias("attempts")).select(key, F.aggregate("seq", F.lit(prior), step).alias("p_learned"), "attempts")


def period_matrices(attempts: DataFrame, key: str, period: Column, order: list[str], difficulty: str | None = None) -> DataFrame:
    """key, period, seq, n, a, b, c, d: a ledger's summary by learner and period, which `traced` reads
    with order [period, seq]. Periods must rise with the order."""
    return matrices(attempts.withColumn("period", period), [key, "period"], order, difficulty)


def merged(summary: DataFrame, ledger: DataFrame, late: DataFrame, key: str, period: Column, order: list[str], difficulty: str | None = None) -> DataFrame:
    """The summary after late attempts (another device's, say) have come into the ledger: only the periods of the
    learners that they fall in are folded anew, from the ledger; all other rows stay as they are.
    late: key and what period reads; its rows must be in the ledger already."""
    touched = cut(late.withColumn("period", period).select(key, "period").distinct())
    rows = ledger.withColumn("period", period)
    months = touched.agg(F.min("period").alias("a"), F.max("period").alias("b")).first()
    if months.a is None:
        return summary
    anew = rows.filter(F.col("period").between(months.a, months.b)).join(touched, [key, "period"], "left_semi")
    return summary.join(touched, [key, "period"], "left_anti").select(*summary.columns).unionByName(matrices(anew, [key, "period"], order, difficulty))

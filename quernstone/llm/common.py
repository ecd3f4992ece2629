"""What the operators share: lineage cuts, Arrow batches, word spans and hashes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

U64 = np.uint64
#: ASCII white space, the separators of the words `[^\x20\x09-\x0D]+`.
WHITE = b" \t\n\r\x0b\x0c"
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SPACED = bytes(32 if c in WHITE else c for c in range(256))
LOWER_SPACED = bytes(32 if c in WHITE else LOWER[c] for c in range(256))

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_CHUNK = 1 << 20
#: Rows and bytes of an Arrow batch that Python takes up at once.
SLICE_ROWS, SLICE_BYTES = 1_000, 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


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


def cut(df: DataFrame, path: str | None = None) -> DataFrame:
    """The rows of df from a table written in the shared folder: lineage ends there,
    lost executors read it again, later steps read only the columns they use, and
    its size tells Spark which joins can broadcast. With a path (of cut_path) its owner may forget it."""
    path = path or cut_path(df.sparkSession)
    with small_batches(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a cut that no table still to be written reads."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = SLICE_ROWS) -> Iterator[None]:
    """What is run meanwhile hands Python batches of at most so many rows: rows here are
    texts, and both sides hold whole batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of the batches of at most so many rows, and about so many bytes, so that
    what Python holds of a batch at once has a bound (or is a single row)."""
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * size // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
    pa.default_memory_pool().release_unused()


def map_batches(df: DataFrame, rows: Callable[..., dict[str, list | np.ndarray]], schema: str) -> DataFrame:
    """rows: from the columns of a slice (as lists) to columns of the schema; an empty
    result is left out."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = rows(*(c.to_pylist() for c in batch.columns))
            if len(out[arrow.names[0]]):
                yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return df.mapInArrow(run, schema)


def rewrite_texts(docs: DataFrame, decide: Callable[..., tuple[bool, bytes | None]], text: str = "text", more: int = 0) -> DataFrame:
    """All columns of docs but the last more ones, whatever their names: decide gives of
    each text, and of those last columns, whether the row stays and its new text. One pass."""
    at, n = docs.columns.index(text), len(docs.columns) - more

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            kind = batch.schema.field(at)
            raws = [None if t is None else t.encode() for t in batch.column(at).to_pylist()]
            found = [decide(*row) for row in zip(raws, *(batch.column(i).to_pylist() for i in range(n, n + more)), strict=True)]
            texts = pa.array([None if t is None else t.decode() for _, t in found], kind.type)
            kept = batch.select(list(range(n))).set_column(at, kind, texts).filter(pa.array([k for k, _ in found], pa.bool_()))
            if kept.num_rows:
                yield kept

    return docs.mapInArrow(run, StructType(docs.schema.fields[:n]))


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def doc_bytes(docs: DataFrame, *more: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, the text's UTF-8 bytes (null stays null) and further columns."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("raw"), *more)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64-bit result."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def _powers(n: int, cache: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    if len(cache.get("p", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("p", _BASE), ("q", _BASE_INVERSE)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            cache[name] = np.multiply.accumulate(steps)
    return cache["p"], cache["q"]


def word_spans(spaced: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of bytes whose only separator is the space."""
    gap = np.ones(len(spaced) + 2, np.int8)
    gap[1:-1] = np.frombuffer(spaced, np.uint8) == 32
    change = np.diff(gap)
    return np.flatnonzero(change == -1), np.flatnonzero(change == 1)


def word_hashes(spaced: bytes) -> np.ndarray:
    """A 64-bit hash of each word, in order. Long texts go in chunks that end at a
    space, so memory beyond the result follows the chunk or the longest word."""
    parts, at = [], 0
    while at < len(spaced):
        end = len(spaced)
        if end - at > _CHUNK:
            end = spaced.rfind(b" ", at, at + _CHUNK) + 1 or spaced.find(b" ", at + _CHUNK) + 1 or len(spaced)
        piece = spaced[at:end] if at or end < len(spaced) else spaced
        starts, ends = word_spans(piece)
        p, q = _powers(len(piece) + 1)
        sums = np.zeros(len(piece) + 1, U64)
        np.cumsum((np.frombuffer(piece, np.uint8).astype(U64) + U64(1)) * p[: len(piece)], out=sums[1:])
        parts.append(mix((sums[ends] - sums[starts]) * q[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93)))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, U64)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of size word hashes; none if there are fewer."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    h = np.zeros(n, U64)
    for i in range(size):
        h = h * U64(0xA24BAED4963EE407) + words[i : i + n]
    return mix(h)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)

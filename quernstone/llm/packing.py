"""Packing by online sum of squares over an array of fill levels."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .bpe import RANKS, VOCABULARY, encoder
from .common import doc_bytes, read, slices

#: Ids that a task packs before it pours its open windows together.
SEGMENT = 1 << 22
#: A piece of a document: doc_id, start, ids, doc_tokens.
Piece = tuple[object, int, np.ndarray, int]


class Windows:
    """Open windows of one task, by fill level.

    open[h] lists the windows that hold h tokens and double[h] is 2 * len(open[h]) + 1,
    the growth of the squared count if one more comes to stand there; 0 for a full one.
    """

    def __init__(self, size: int):
        self.size = size
        self.open: list[list[list[Piece]]] = [[] for _ in range(size + 1)]
        self.double = np.ones(size + 1, np.int64)
        self.double[size] = 0

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        """Places a piece where the sum of squared counts grows least (of equal
        levels the fullest); yields what this fills."""
        n = len(piece[2])
        if n == self.size:
            yield [piece]
            return
        levels = np.flatnonzero(self.double[1 : self.size - n + 1] > 1) + 1
        best, least = 0, self.double[n]
        if len(levels):
            growth = self.double[levels + n] - self.double[levels] + 2
            k = len(growth) - 1 - int(np.argmin(growth[::-1]))
            if growth[k] <= least:
                best = int(levels[k])
        window = self._take(best) if best else []
        window.append(piece)
        if best + n == self.size:
            yield window
            return
        self._put(best + n, window)

    def _take(self, level: int) -> list[Piece]:
        self.double[level] -= 2
        return self.open[level].pop()

    def _put(self, level: int, window: list[Piece]) -> None:
        self.open[level].append(window)
        self.double[level] += 2

    def pour(self, last: bool) -> Iterator[list[Piece]]:
        """Fills the fullest open windows from the emptiest, cutting pieces, until one
        partial window is left; last: yields that too, else it stays open."""
        levels = [(h, w) for h in range(self.size - 1, 0, -1) for w in self.open[h]]
        self.__init__(self.size)
        i, j = 0, len(levels) - 1
        while i < j:
            (fill, window), (left, donor) = levels[i], levels[j]
            doc, start, ids, total = donor.pop()
            fits = min(len(ids), self.size - fill)
            window.append((doc, start, ids[:fits], total))
            if fits < len(ids):
                donor.append((doc, start + fits, ids[fits:], total))
            levels[i], levels[j] = (fill + fits, window), (left - fits, donor)
            if fill + fits == self.size:
                yield window
                i += 1
            if left == fits:
                j -= 1
        if i == j:
            if last:
                yield levels[i][1]
            else:
                self._put(*levels[i])


def pack(docs: DataFrame, size: int = 1024, end_id: int = 0, segment: int = SEGMENT, with_ids: bool = False, vocabulary: str = VOCABULARY, ranks: str = RANKS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, and ids with with_ids.

    Every row is a document: its ids, then end_id; null and empty texts are end_id
    alone, repeated rows are packed as often as they come, null doc_ids stay null.
    A document of more than size ids first fills whole sequences. Each task packs its own
    documents online, in segments of about segment ids: at a segment's end the
    emptiest of the open windows are poured into the fullest, and the one partial window that
    is left opens the next segment. So a task holds one segment at most and leaves one
    padded sequence. sequence_id holds the partition above 33 bits of the task's own
    count; a lost task packs the same partition again. Nothing is shuffled.
    """
    schema = f"doc_id {dict(docs.dtypes)[doc_id]}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, windows, held = encoder(vocabulary, ranks), Windows(size), 0
        sequence = (TaskContext.get().partitionId() << 33) - 1
        out: list[tuple] = []

        def close(filled: Iterable[list[Piece]]) -> None:
            nonlocal sequence
            for window in filled:
                sequence, offset = sequence + 1, 0
                for doc, start, ids, total in window:
                    out.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, sequence, offset, *([ids.astype(np.int32)] if with_ids else [])))
                    offset += len(ids)

        def batch() -> pa.RecordBatch:
            rows = [list(c) for c in zip(*out, strict=True)]
            out.clear()
            return pa.RecordBatch.from_pydict(dict(zip(arrow.names, rows, strict=True)), schema=arrow)

        for b in slices(batches):
            for doc, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.append(encode((raw or b"").decode(errors="replace")), np.uint32(end_id)).astype("<u4")
                whole = len(ids) - len(ids) % size
                for start in range(0, whole, size):
                    close([[(doc, start, ids[start : start + size], len(ids))]])
                if whole < len(ids):
                    close(windows.add((doc, whole, ids[whole:].copy(), len(ids))))
                if (held := held + len(ids) - whole) >= segment:
                    close(windows.pour(last=False))
                    held = 0
                if len(out) >= 10_000:
                    yield batch()
        close(windows.pour(last=True))
        if out:
            yield batch()

    return doc_bytes(docs, text=text, doc_id=doc_id).mapInArrow(run, schema)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))

"""Encoding and decoding with byte-pair merges over contiguous arrays of part boundaries and ranks."""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Memo, byte_letters
from .common import doc_bytes, map_batches, read

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: Symbols of a word whose ranks are scanned; in longer ones the least rank comes off a heap.
SHORT = 256
#: Bits of an id in a pair's key and beside its rank.
BITS = 20
MASK, NO_RANK = (1 << BITS) - 1, 1 << 60

# The two expressions are fixed values: they must be the vocabulary's.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_WHITE = regex.compile(r"\s+")
#: Below this code point the installed expression library and the vocabulary's agree on all classes and cases (tests/llm holds them against each other).
_FAR = regex.compile("[^\x00-ԯ]")


class WordVocabulary:
    """A vocabulary file with word ends: its symbols, the ranks of their pairs, its special strings."""

    def __init__(self, path: str = VOCABULARY):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        self.end = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        ids, merges = self.ids, (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.rank = {ids[a] << BITS | ids[b]: n << BITS | ids[a + b] for n, (a, b) in enumerate(merges)}
        self.inner, self.last = ([ids[c + end] for c in byte_letters()] for end in ("", self.end))
        self.names = {i: name for name, i in (self.ids | self.special).items()}
        self._special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
        library = Tokenizer.from_file(path)
        self._normalise, self._split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str

    def words(self, text: str) -> list[str]:
        """The words of a text without special strings, normalised (composed, lower case), as they stand in it.
        Where letters lie outside the range on which all agree, the file's own rules cut the text."""
        if not _FAR.search(text):
            near = _WHITE.sub(" ", unicodedata.normalize("NFC", text))
            if not _FAR.search(near):
                return _PIECES.findall("".join(c.lower() for c in near) if "Σ" in near else near.lower())
        cut = self._normalise(text)
        return [_from_letters(piece) for piece, _ in self._split(cut)]

    def parts(self, text: str) -> Iterator[tuple[int | None, list[str]]]:
        """(id, []) for a special string, (None, words) for what lies between."""
        if not any(s in text for s in self.special):
            yield None, self.words(text)
            return
        for part in self._special.split(text):
            if part in self.special:
                yield self.special[part], []
            elif part:
                yield None, self.words(part)


def _from_letters(piece: str, byte_of: dict[str, int] = {}) -> str:  # noqa: B006
    if not byte_of:
        byte_of.update((c, b) for b, c in enumerate(byte_letters()))
    return bytes(byte_of[c] for c in piece).decode()


def merged(symbols: list[int], rank: Callable[[int, int], int]) -> tuple[list[int], list[int]]:
    """(ids of the parts of a word once no pair of neighbours has a rank, boundaries of the parts).

    bounds holds where parts begin (and the end), ranks what `rank` says of each part with the one after it: its
    rank in the high bits, the merged id in the low ones. The least, leftmost first, is found by a scan; its inner
    boundary is deleted, and only the ranks of the new part with its two neighbours are looked up anew."""
    parts, bounds = list(symbols), list(range(len(symbols) + 1))
    ranks = [rank(a << BITS | b, NO_RANK) for a, b in zip(parts, parts[1:], strict=False)]
    while ranks and (least := min(ranks)) < NO_RANK:
        i = ranks.index(least)
        parts[i] = least & MASK
        del parts[i + 1], bounds[i + 1], ranks[i]
        if i:
            ranks[i - 1] = rank(parts[i - 1] << BITS | parts[i], NO_RANK)
        if i < len(ranks):
            ranks[i] = rank(parts[i] << BITS | parts[i + 1], NO_RANK)
    return parts, bounds


def merged_long(symbols: list[int], rank: Callable[[int, int], int]) -> list[int]:
    """The same ids for a word of any length: pairs come off a heap, boundaries are skipped by links."""
    n = len(symbols)
    parts: list[int] = list(symbols)
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank(parts[i] << BITS | parts[i + 1], NO_RANK)) < NO_RANK]
    heapq.heapify(heap)
    while heap:
        least, i, left, right = heapq.heappop(heap)
        j = after[i]
        if parts[i] != left or j < 0 or parts[j] != right:
            continue
        parts[i], parts[j] = least & MASK, -1
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
        for a, b in ((before[i], i), (i, k)):
            if a >= 0 and b >= 0 and (r := rank(parts[a] << BITS | parts[b], NO_RANK)) < NO_RANK:
                heapq.heappush(heap, (r, a, parts[a], parts[b]))
    return [p for p in parts if p >= 0]


class WordIds(Memo):
    """Word -> its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, vocabulary: WordVocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def compute(self, word: str) -> bytes:
        v, raw = self.vocabulary, word.encode()
        symbols = [v.inner[b] for b in raw[:-1]]
        symbols.append(v.last[raw[-1]])
        return array("I", merged(symbols, v.rank.get)[0] if len(raw) <= SHORT else merged_long(symbols, v.rank.get)).tobytes()


_PER_PROCESS: dict = {}


def codec(path: str = VOCABULARY) -> tuple[Callable[[str], np.ndarray], Callable[[np.ndarray], str]]:
    """(text -> ids, ids -> text). Special strings within a text are one id; a decoded text is
    the ids' symbols with a space between, word ends and special strings included."""
    if path not in _PER_PROCESS:
        vocabulary = WordVocabulary(path)
        ids = WordIds(vocabulary)

        def encode(text: str) -> np.ndarray:
            return np.frombuffer(b"".join(np.uint32(special).tobytes() if special is not None else b"".join(map(ids.__getitem__, words)) for special, words in vocabulary.parts(text)), "<u4")

        def decode(ids: np.ndarray) -> str:
            return " ".join(map(vocabulary.names.__getitem__, ids.tolist()))

        _PER_PROCESS[path] = encode, decode
    return _PER_PROCESS[path]


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, ids: one row for each row, of whole texts. A null text counts as empty (no
    ids), a null doc_id stays null, repeated rows give repeated rows, other columns are
    ignored. One narrow stage, memory by slice of a batch; a lost task is run again."""

    def rows(ids, raws):
        encode, _ = codec(vocabulary)
        return {"doc_id": ids, "ids": [encode((r or b"").decode(errors="replace")).astype(np.int32) for r in raws]}

    return map_batches(doc_bytes(docs, text=text, doc_id=doc_id), rows, f"doc_id {dict(docs.dtypes)[doc_id]}, ids array<int>")


def decoded(rows: DataFrame, vocabulary: str = VOCABULARY, ids: str = "ids", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, text of ids: one row for each row; null ids give a null text. An id that the vocabulary
    doesn't have raises KeyError."""

    def texts(names, arrays):
        _, decode = codec(vocabulary)
        return {"doc_id": names, "text": [None if a is None else decode(np.array(a, np.int64)) for a in arrays]}

    return map_batches(rows.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids")), texts, f"doc_id {dict(rows.dtypes)[doc_id]}, text string")


def round_trip(docs: DataFrame, vocabulary: str = VOCABULARY, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: `encoded` and `decoded` in one pass, digests
    alone leaving the task. Nulls and odd rows as there."""

    def rows(names, raws):
        encode, decode = codec(vocabulary)
        out: dict[str, list] = {"doc_id": names, "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for r in raws:
            ids = encode((r or b"").decode(errors="replace"))
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(ids.tobytes()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(decode(ids).encode()).hexdigest())
        return out

    return map_batches(doc_bytes(docs, text=text, doc_id=doc_id), rows, f"doc_id {dict(docs.dtypes)[doc_id]}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op11_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "documents"))

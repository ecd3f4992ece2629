"""Byte-level byte-pair encoding over the public vocabulary files, inside tasks.

Equal pretokens have equal encodings, so each task process keeps a bounded
memo by pretoken, bounded in bytes; where a text has letters outside the range in which the
installed expression library and the tokenizer file's own splitter agree
on character classes, the splitter itself cuts the text.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import regex

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Bytes that a task process's memo of pretokens may take, what an entry takes beside its
#: text, and the longest pretoken that is remembered.
MEMO_BYTES, ENTRY_BYTES, LONGEST = 48 << 20, 160, 64

_PIECES = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# The pattern and the byte letters below are fixed values: they must be the vocabulary's.
#: Below this code point all character classes agree (tests/llm holds them against each other).
_FAR = regex.compile("[^\x00-ԯ]")


class Splitter:
    """Cuts a text into special tokens (as ids) and pretokens (as text)."""

    def __init__(self, path: str = VOCABULARY):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.file = json.load(f)
        self.special = {t["content"]: t["id"] for t in self.file["added_tokens"]}
        self._special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self._library = Tokenizer.from_file(path).pre_tokenizer

    def pretokens(self, text: str) -> list[str]:
        if not _FAR.search(text):
            return _PIECES.findall(text)
        return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]

    def parts(self, text: str) -> Iterator[tuple[int | None, list[str]]]:
        """(id, []) for a special string, (None, pretokens) for what lies between."""
        if self._special is None or not any(s in text for s in self.special):
            yield None, self.pretokens(text)
            return
        for part in self._special.split(text):
            if part in self.special:
                yield self.special[part], []
            elif part:
                yield None, self.pretokens(part)


class Memo(dict):
    """Pretoken -> what compute says of it, remembered within MEMO_BYTES. Once half of that is
    full it becomes the old half, and what is asked for again moves to the new one."""

    held = 0
    old: dict = {}

    def __missing__(self, pretoken: str):
        found = self.old.get(pretoken)
        if found is None:
            found = self.compute(pretoken)
        if len(pretoken) <= LONGEST:
            self.held += ENTRY_BYTES + 2 * len(pretoken)
            if self.held > MEMO_BYTES // 2:
                self.old = dict(self)
                self.clear()
                self.held = 0
            self[pretoken] = found
        return found


class MergeCounts(Memo):
    """Pretoken -> number of tokens, by merges taken off a heap in rank order over
    a doubly linked list of symbols: the count is the initial symbols minus the merges."""

    def __init__(self, splitter: Splitter):
        super().__init__()
        model = splitter.file["model"]
        vocab = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        self.byte_ids = [vocab[c] for c in byte_letters()]

    def compute(self, pretoken: str) -> int:
        word = pretoken.encode()
        n, rank = len(word), self.rank.get
        ids: list[int | None] = [self.byte_ids[c] for c in word]
        heap = [(found[0], i, ids[i], ids[i + 1], found[1]) for i in range(n - 1) if (found := rank((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        after, before, merges = [*range(1, n), -1], [*range(-1, n - 1)], 0
        while heap:
            _, i, left, right, whole = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue  # one of the two has been merged since
            ids[i], ids[j], merges = whole, None, merges + 1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if found := rank((whole, ids[k])):
                    heapq.heappush(heap, (found[0], i, whole, ids[k], found[1]))
            h = before[i]
            if h >= 0 and (found := rank((ids[h], whole))):
                heapq.heappush(heap, (found[0], h, ids[h], whole, found[1]))
        return n - merges


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies:
    visible Latin-1 characters stand for themselves, the rest follow from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(c if c in visible else next(rest)) for c in range(256)]


class PretokenIds(Memo):
    """Pretoken -> its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, ranks_path: str = RANKS):
        super().__init__()
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._encode = tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def compute(self, pretoken: str) -> bytes:
        return np.array(self._encode(pretoken), "<u4").tobytes()


_PER_PROCESS: dict = {}


def token_counter(path: str = VOCABULARY):
    """text -> number of tokens; special strings in it count as one."""
    if ("count", path) not in _PER_PROCESS:
        splitter = Splitter(path)
        counts = MergeCounts(splitter)
        _PER_PROCESS["count", path] = lambda text: sum(1 if special is not None else sum(map(counts.__getitem__, pieces)) for special, pieces in splitter.parts(text))
    return _PER_PROCESS["count", path]


def encoder(path: str = VOCABULARY, ranks_path: str = RANKS):
    """text -> its ids, a little-endian unsigned 32-bit array."""
    if ("ids", path, ranks_path) not in _PER_PROCESS:
        splitter, ids = Splitter(path), PretokenIds(ranks_path)

        def encode(text: str) -> np.ndarray:
            return np.frombuffer(b"".join(np.uint32(special).tobytes() if special is not None else b"".join(map(ids.__getitem__, pieces)) for special, pieces in splitter.parts(text)), "<u4")

        _PER_PROCESS["ids", path, ranks_path] = encode
    return _PER_PROCESS["ids", path, ranks_path]

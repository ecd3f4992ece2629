"""Patience alignment of two sequences of hashable things."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import accumulate

#: Bits that the rows of a gap without anchors may have at once.
ROWS = 1 << 27


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs (given by rising first) whose seconds rise."""
    tops: list[int] = []
    at: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, y) in enumerate(pairs):
        i = bisect_left(tops, y)
        before[k] = at[i - 1] if i else -1
        tops[i : i + 1] = [y]
        at[i : i + 1] = [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def _rows(a: Sequence, b: Sequence) -> Iterator[int]:
    """After each of a, bit y of a number is 0 where the longest common subsequence of
    what was read of a with b[: y + 1] is longer than with b[:y]."""
    places: dict = {}
    for y, v in enumerate(b):
        places[v] = places.get(v, 0) | 1 << y
    full = (1 << len(b)) - 1
    row = full
    for v in a:
        both = row & places.get(v, 0)
        row = ((row + both) | (row - both)) & full
        yield row


def _lengths(a: Sequence, b: Sequence) -> list[int]:
    """Lengths of the longest common subsequences of a with b[:0], b[:1], ... b."""
    row = (1 << len(b)) - 1
    for row in _rows(a, b):  # noqa: B007
        pass
    return [0, *accumulate(bit == "0" for bit in reversed(f"{row:0{len(b)}b}"))]


def _longest(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """A longest common subsequence, of which no other ends earlier in a; where all rows
    would be more than ROWS bits, a is halved, so memory stays bounded."""
    if not a or not b:
        return []
    if len(a) * len(b) > ROWS and len(a) > 1:
        h = len(a) // 2
        head, tail = _lengths(a[:h], b), _lengths(a[h:][::-1], b[::-1])[::-1]
        y = max(range(len(b) + 1), key=lambda y: head[y] + tail[y])
        return _longest(a[:h], b[:y]) + [(h + u, y + v) for u, v in _longest(a[h:], b[y:])]
    rows = [-1, *_rows(a, b)]
    out, x, y = [], len(a), len(b)
    while x and y:
        bit = 1 << (y - 1)
        if rows[x] & bit:
            y -= 1
        elif rows[x - 1] & bit:
            x, y = x - 1, y - 1
            out.append((x, y))
        else:
            x -= 1
    return out[::-1]


def longest(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """A longest common subsequence: of those that end first in a, one that starts last."""
    found = _longest(a, b)
    if not found:
        return []
    n, m = found[-1][0] + 1, found[-1][1] + 1
    return [(n - 1 - x, m - 1 - y) for x, y in reversed(_longest(a[:n][::-1], b[:m][::-1]))]


def align(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Matched positions, rising in both: equal ends first, then what is unique in both
    and in order as anchors, then the gaps between anchors in the same way; a gap
    without anchors, of any size, by a longest common subsequence."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i >= j or k >= m:
            continue
        once_a, once_b = Counter(a[i:j]), Counter(b[k:m])
        place = {b[y]: y for y in range(k, m) if once_b[b[y]] == 1}
        anchors = _rising([(x, place[a[x]]) for x in range(i, j) if a[x] in place and once_a[a[x]] == 1])
        if anchors:
            out += anchors
            ends = [(i - 1, k - 1), *anchors, (j, m)]
            todo += [(x + 1, u, y + 1, v) for (x, y), (u, v) in zip(ends[:-1], ends[1:], strict=True)]
        else:
            out += [(i + x, k + y) for x, y in longest(a[i:j], b[k:m])]
    return sorted(out)

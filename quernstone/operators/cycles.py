"""Breaking cycles: which derived edges go is a question about each edge alone, so no order of removal has to be followed."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.lineage import cut

#: Edges of a weak component that one task takes whole.
BLOCK = 200_000

# Taking away, again and again, the least derived edge of each strong component leaves out exactly the derived
# edges that stand on a cycle of fixed edges and derived ones not less than themselves: what is less
# and still there stands on no cycle. So edges can come back from the greatest down, and one goes if its ends are
# strongly connected at the moment it comes. Halving that sequence of moments finds it for all edges
# at once: those whose ends are joined by the middle belong to the first half, the others, between joined nodes
# taken as one, to the second.


def components(nodes: Sequence[int], edges: Sequence[tuple[int, int]]) -> dict[int, int]:
    """Node to the number of its strong component; two passes with stacks of their own, so depth doesn't matter."""
    ahead: dict[int, list[int]] = {n: [] for n in nodes}
    back: dict[int, list[int]] = {n: [] for n in nodes}
    for a, b in edges:
        ahead[a].append(b)
        back[b].append(a)
    order: list[int] = []
    seen: set[int] = set()
    for root in nodes:
        if root in seen:
            continue
        seen.add(root)
        stack = [(root, iter(ahead[root]))]
        while stack:
            node, rest = stack[-1]
            for to in rest:
                if to not in seen:
                    seen.add(to)
                    stack.append((to, iter(ahead[to])))
                    break
            else:
                stack.pop()
                order.append(node)
    of: dict[int, int] = {}
    for root in reversed(order):
        if root in of:
            continue
        todo, of[root] = [root], root
        while todo:
            for to in back[todo.pop()]:
                if to not in of:
                    of[to] = root
                    todo.append(to)
    return of


def on_cycles(fixed: Sequence[tuple[int, int]], derived: Sequence[tuple[int, int]]) -> list[int]:
    """Places in derived (greatest first) of the edges that close a cycle when they come to the fixed ones and those before them."""
    out: list[int] = []
    edges = [(0, a, b) for a, b in fixed] + [(t, a, b) for t, (a, b) in enumerate(derived, 1)]
    todo = [(0, len(derived), edges)]  # ends of edges listed are joined in moments low..high, or never
    while todo:
        low, high, edges = todo.pop()
        if low == high:
            of = components(list({x for _, a, b in edges for x in (a, b)}), [(a, b) for t, a, b in edges if t <= low])
            out += [t - 1 for t, a, b in edges if t == low and t and of[a] == of[b]]
            continue
        middle = (low + high) // 2
        of = components(list({x for _, a, b in edges for x in (a, b)}), [(a, b) for t, a, b in edges if t <= middle])
        joined = [e for e in edges if e[0] <= middle and of[e[1]] == of[e[2]]]
        later = [(t, of[a], of[b]) for t, a, b in edges if not (t <= middle and of[a] == of[b]) and of[a] != of[b]]
        if any(low <= t for t, _, _ in joined):
            todo.append((low, middle, joined))
        if any(t > middle for t, _, _ in later):
            todo.append((middle + 1, high, later))
        # ends that were joined before a derived edge of the second half came: it closes a cycle when it comes
        out += [t - 1 for t, a, b in edges if t > middle and of[a] == of[b]]
    return out


def weak_components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of edges(src, dst): rounds of large and small stars, whose number grows with the
    logarithm of the component, long paths included."""
    links = cut(edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).filter("a < b").distinct())
    state = None
    while (now := links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()) != state:
        state = now
        both = links.union(links.select("b", "a")).toDF("v", "u")
        least = both.groupBy("v").agg(F.least(F.col("v"), F.min("u")).alias("m"))
        large = both.join(least, "v").filter("u > v and u != m").select(F.col("m").alias("a"), F.col("u").alias("b")).distinct()
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        links = cut(large.join(down, "b").filter("a != m").select(F.col("m").alias("a"), F.col("a").alias("b")).union(down.select(F.col("m"), F.col("b"))).distinct())
    return links.select(F.col("b").alias("node"), F.col("a").alias("component")).union(links.select("a", "a").distinct())


def closing_edges(edges: DataFrame) -> DataFrame:
    """src, dst, support of the derived edges of edges(component, src, dst, support, derived) that go: one task a component."""
    kind = dict(edges.dtypes)["src"]

    def run(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table.column(c).to_pylist() for c in ("src", "dst", "support", "derived")), strict=True))
        number: dict = {}
        for a, b, _, _ in rows:
            number.setdefault(a, len(number))
            number.setdefault(b, len(number))
        pair = lambda r: (number[r[0]], number[r[1]])
        derived = sorted((r for r in rows if r[3]), key=lambda r: (r[2] is not None, r[2] or 0, r[0], r[1]), reverse=True)
        gone = [derived[i] for i in sorted(set(on_cycles([pair(r) for r in rows if not r[3]], [pair(r) for r in derived])))]
        return table.select(["src", "dst", "support"]).slice(0, 0) if not gone else pa.table({c: pa.array([r[i] for r in gone], table.column(c).type) for i, c in enumerate(("src", "dst", "support"))})

    return edges.groupBy("component").applyInArrow(run, f"src {kind}, dst {kind}, support {dict(edges.dtypes)['support']}")

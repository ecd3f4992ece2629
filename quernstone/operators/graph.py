"""Graph operators over edge tables: closure, cycles, merging, derivation, matching, plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.lineage import cut, dealt
from quernstone.operators.content import resolve_chains
from quernstone.operators.cycles import BLOCK, closing_edges, weak_components


def closure(edges: DataFrame, depth: int = 5) -> DataFrame:
    """start, reached, min_depth of all walks of up to depth edges from src to dst,
    without the start itself. Each level goes on from the pairs first found by the one before
    and leaves out what is known, so nothing is expanded twice and walks don't multiply."""
    step = edges.select("src", "dst").distinct()
    level = cut(step.filter("src != dst").select(F.col("src").alias("start"), F.col("dst").alias("reached"), F.lit(1).alias("min_depth")))
    found = level
    for d in range(2, depth + 1):
        ahead = level.join(step, level["reached"] == step["src"]).select("start", F.col("dst").alias("reached")).filter("start != reached").distinct()
        level = cut(ahead.join(found, ["start", "reached"], "left_anti").withColumn("min_depth", F.lit(d)))
        found = found.unionByName(level)
        if d < depth and not level.take(1):
            break
    return found


def depth_report(pairs: DataFrame) -> DataFrame:
    """min_depth, pairs and starts: the histogram of a closure."""
    return pairs.groupBy("min_depth").agg(F.count("*").alias("pairs"), F.count_distinct("start").alias("starts"))


def ancestor_report(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes, pairs, mean, median and most of how many others a node(node) reaches, and how many reach none. One row; zeros for no nodes."""
    per = nodes.select("node").distinct().join(pairs.groupBy(F.col("start").alias("node")).agg(F.count("*").alias("n")), "node", "left").fillna(0, ["n"])
    n = F.col("n")
    return per.agg(F.count("*").alias("nodes"), F.coalesce(F.sum(n), F.lit(0)).alias("pairs"), F.round(F.coalesce(F.avg(n), F.lit(0.0)), 2).alias("mean"), F.coalesce(F.median(n), F.lit(0.0)).alias("median"), F.coalesce(F.max(n), F.lit(0)).alias("most"), F.count_if(n == 0).alias("without"))


def paths(edges: DataFrame, starts: DataFrame, depth: int = 5) -> DataFrame:
    """start, path: every walk of 1 to depth edges from the starts that meets no node twice, as
    the array of its nodes. Their number grows with the branching; starts should be few."""
    step = edges.select("src", "dst").distinct()
    level = starts.select(F.col("start"), F.array("start").alias("path"))
    found = []
    for _ in range(depth):
        level = cut(level.join(step, F.element_at("path", -1) == step["src"]).filter(~F.array_contains("path", F.col("dst"))).select("start", F.concat("path", F.array("dst")).alias("path")))
        found.append(level)
    return reduce(DataFrame.unionByName, found)


def cyclic_edges(edges: DataFrame, rounds: int = 1_000) -> DataFrame:
    """The edges that are left when nodes without a way in or out are taken away again and again:
    all cycles, and what leads from one to another. A chain of more than rounds layers is an error."""
    left = cut(edges)
    n = left.count()
    for _ in range(rounds):
        left = cut(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select(*edges.columns))
        before, n = n, left.count()
        if n == before:
            return left
    raise ValueError(f"more than {rounds} layers lead into or out of the cycles")


def strong_components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) for nodes on a cycle with others.

    Rounds: each node takes the least node that reaches it as colour; what leads back to that node
    within the colour is its component, which goes, and the rest is trimmed and coloured anew.
    """
    left = cyclic_edges(edges.select("src", "dst").filter("src != dst").distinct())
    none = left.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    found = none
    while left.take(1):
        colour = left.select(F.col("src").alias("node")).union(left.select("dst")).distinct().withColumn("colour", F.col("node"))
        colour = _spread(colour, left.toDF("from", "to"))
        inner = left.join(colour.toDF("src", "a"), "src").join(colour.toDF("dst", "b"), "dst").filter("a = b").select("src", "dst", "a")
        inner = cut(inner)
        reach = inner.select(F.col("a").alias("node"), "a").distinct()
        seen = cut(reach)
        while True:
            back = seen.join(inner.select(F.col("dst").alias("node"), "a", "src"), ["node", "a"]).select(F.col("src").alias("node"), "a").distinct()
            new = cut(back.join(seen, ["node", "a"], "left_anti"))
            if not new.take(1):
                break
            seen = cut(seen.unionByName(new))
        members = seen.toDF("node", "component")
        found = cut(found.unionByName(members))
        rest = left.join(members.select(F.col("node").alias("src")), "src", "left_anti").join(members.select(F.col("node").alias("dst")), "dst", "left_anti")
        left = cyclic_edges(rest)
    sizes = found.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1").select("component")
    return found.join(sizes, "component").select("node", "component")


def _spread(colour: DataFrame, edges: DataFrame) -> DataFrame:
    """Least colours carried along the edges until nothing changes."""
    colour = cut(colour)
    while True:
        arriving = edges.join(colour.toDF("from", "c"), "from").groupBy(F.col("to").alias("node")).agg(F.min("c").alias("c"))
        new = cut(colour.join(arriving, "node", "left").select("node", F.least("colour", "c").alias("next"), "colour"))
        colour = new.select("node", F.col("next").alias("colour"))
        if not new.filter("next < colour").take(1):
            return colour


def break_cycles(edges: DataFrame, derived: Column, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(edges without cycles through derived ones, removed: src, dst, support).

    In each strong component the derived edge of least support (null first, then by its ends) goes, until
    no component has one; a cycle of other edges alone stays, for people to settle. Derived edges from a node to itself go
    too. A weak component of up to block edges is settled whole by one task, whatever its shape; a larger one
    in rounds, side by side with others of its kind, that grow with the edges it loses.
    edges: src, dst (each pair once), support and what derived reads; edges with a null end stay.
    """
    marked = cut(edges.filter("src is not null and dst is not null").select("src", "dst", "support", F.coalesce(derived, F.lit(False)).alias("derived")))
    loops = marked.filter("src = dst and derived").select("src", "dst", "support")
    proper = marked.filter("src != dst")
    tagged = cut(proper.join(weak_components(proper).withColumnRenamed("node", "src"), "src"))
    sizes = tagged.groupBy("component").agg(F.count("*").alias("n"), F.max("derived").alias("some")).filter("some")
    removed = closing_edges(tagged.join(sizes.filter(F.col("n") <= block).select("component"), "component", "left_semi")).unionByName(loops)
    if not (great := sizes.filter(F.col("n") > block).select("component")).isEmpty():
        removed = removed.unionByName(_broken_by_rounds(tagged.join(great, "component", "left_semi").select("src", "dst", "support", "derived")))
    removed = cut(removed)
    return edges.join(removed.select("src", "dst"), ["src", "dst"], "left_anti").select(*edges.columns), removed


def _broken_by_rounds(edges: DataFrame) -> DataFrame:
    left, removed = edges, edges.select("src", "dst", "support").limit(0)
    while True:
        parts = strong_components(left)
        inside = left.filter("derived").join(parts.toDF("src", "a"), "src").join(parts.toDF("dst", "b"), "dst").filter("a = b")
        worst = cut(inside.groupBy("a").agg(F.min(F.struct("support", "src", "dst")).alias("x")).select("x.src", "x.dst", "x.support"))
        if not worst.take(1):
            return removed
        removed = removed.unionByName(worst)
        left = cut(left.join(worst, ["src", "dst"], "left_anti"))


def derive_edges(curated: DataFrame, counted: DataFrame, roots: DataFrame, least: int = 2) -> DataFrame:
    """src, dst, source, support: curated edges, then counted ones of least support or more that are not
    curated and do not leave a root, which requires nothing."""
    known = curated.select("src", "dst").distinct()
    derived = counted.filter(F.col("support") >= least).join(known, ["src", "dst"], "left_anti").join(roots.select(F.col("node").alias("src")), "src", "left_anti")
    return known.select("src", "dst", F.lit("curated").alias("source"), F.lit(1).cast("long").alias("support")).unionByName(derived.select("src", "dst", F.lit("chain_derived").alias("source"), F.col("support").cast("long").alias("support")))


def merge_nodes(edges: DataFrame, survivors: DataFrame) -> DataFrame:
    """Edges moved to the survivors(loser, survivor); self loops and double edges go."""
    s = survivors.select("loser", "survivor")
    moved = edges.join(s.toDF("src", "to_src"), "src", "left").join(s.toDF("dst", "to_dst"), "dst", "left")
    return moved.select(F.coalesce("to_src", "src").alias("src"), F.coalesce("to_dst", "dst").alias("dst")).filter("src != dst").distinct()


def merge_properties(rows: DataFrame, survivors: DataFrame, key: str, properties: list[str]) -> DataFrame:
    """key and properties after a merge: a survivor keeps its own, and takes of its losers, in the order
    of their keys, what it lacks."""
    owner = rows.join(survivors.select(F.col("loser").alias(key), "survivor"), key, "left").withColumn("_to", F.coalesce("survivor", key))
    first = [F.min_by(p, F.when(F.col(p).isNotNull(), F.struct(F.col("survivor").isNotNull(), F.col(key)))).alias(p) for p in properties]
    return owner.groupBy(F.col("_to").alias(key)).agg(*first)


def neighbours(edges: DataFrame) -> DataFrame:
    """node, neighbours (sorted, both directions) and degree."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    return both.groupBy(F.col("src").alias("node")).agg(F.array_sort(F.collect_list("dst")).alias("neighbours"), F.count("*").alias("degree"))


def merge_plan(names: DataFrame, used: DataFrame, structural: Column, fixed: DataFrame) -> DataFrame:
    """loser, survivor, rule: what a vocabulary's names are merged into.

    Names that differ in case go to the most used, then the first; `root:bare` goes to `bare` where that
    is a name; fixed(loser, survivor) pairs come before both; structural names go away (null
    survivor). Survivors that are merged themselves, whatever the rule, give way to their own,
    so one hop is enough. used: name, n.
    """
    counted = names.select("name").distinct().join(used.select("name", "n"), "name", "left").fillna(0, ["n"])
    kept = counted.filter(~structural)
    case = kept.groupBy(F.lower("name").alias("_k")).agg(F.min_by("name", F.struct(-F.col("n"), F.col("name"))).alias("_case"))
    out = kept.withColumn("_k", F.lower("name")).join(case, "_k").drop("_k")
    bare = F.trim(F.element_at(F.split("name", ":", 2), 2))
    out = out.withColumn("_bare", F.when(F.contains("name", F.lit(":")), bare)).join(names.select(F.col("name").alias("_bare")).distinct().withColumn("_known", F.lit(True)), "_bare", "left")
    out = out.join(fixed.select(F.col("loser").alias("name"), F.col("survivor").alias("_fixed")), "name", "left")
    rule = F.when(F.col("_fixed").isNotNull(), "fixed").when(F.col("_known"), "namespaced").when(F.col("_case") != F.col("name"), "case")
    target = F.coalesce("_fixed", F.when(F.col("_known"), F.col("_bare")), "_case")
    moved = cut(out.select(F.col("name").alias("loser"), target.alias("survivor"), rule.alias("rule")).filter("rule is not null and loser != survivor"))
    ends = resolve_chains(moved, "loser", "survivor")
    moved = moved.drop("survivor").join(ends, "loser").select("loser", "survivor", "rule")
    gone = counted.filter(structural).select(F.col("name").alias("loser"), F.lit(None).cast("string").alias("survivor"), F.lit("structural").alias("rule"))
    return moved.unionByName(gone)


def key_delta(before: DataFrame, after: DataFrame, key: str, value: str, renamed: DataFrame, deleted: DataFrame) -> DataFrame:
    """key, cause of each key whose value differs: it can't be resolved any more, its value was renamed or
    deleted, or another took its place silently. renamed: old, new; deleted: old."""
    both = before.select(key, F.col(value).alias("_old")).join(after.select(key, F.col(value).alias("_new")), key, "full_outer").filter(~F.col("_old").eqNullSafe(F.col("_new")))
    out = both.join(renamed.select(F.col("old").alias("_old"), F.col("new").alias("_to")), "_old", "left").join(deleted.select(F.col("old").alias("_old"), F.lit(True).alias("_gone")), "_old", "left")
    cause = F.when(F.col("_new").isNull(), "unservable").when(F.col("_to") == F.col("_new"), "renamed").when(F.col("_gone"), "deleted_reattributed").otherwise("silent_reorder")
    return out.select(key, cause.alias("cause"))


def migrated_keys(rows: DataFrame, renamed: DataFrame, unique: list[str], key: str) -> DataFrame:
    """rows with key renamed; where a renamed row would repeat another's unique columns, the one that had
    the name stays, then the first by its old name."""
    out = rows.join(renamed.select(F.col("old").alias(key), F.col("new").alias("_new")), key, "left")
    place = F.row_number().over(Window.partitionBy(*[F.coalesce("_new", key) if c == key else F.col(c) for c in unique]).orderBy(F.col("_new").isNotNull(), key))
    return out.withColumn("_n", place).filter("_n = 1").withColumn(key, F.coalesce("_new", key)).select(*rows.columns)


def census_diff(before: DataFrame, after: DataFrame, label: str, protected: Column | None = None) -> DataFrame:
    """label, what (appeared, vanished, count, content) of each label whose count or print has changed; with
    protected only of labels that may not change."""
    a, b = before.select(label, F.col("n").alias("_n"), F.col("print").alias("_p")), after.select(label, F.col("n").alias("_m"), F.col("print").alias("_q"))
    what = F.when(F.col("_n").isNull(), "appeared").when(F.col("_m").isNull(), "vanished").when(F.col("_n") != F.col("_m"), "count").when(F.col("_p") != F.col("_q"), "content")
    out = a.join(b, label, "full_outer").withColumn("what", what).filter("what is not null")
    return (out if protected is None else out.filter(protected)).select(label, "what")


def plan_counts(nodes: dict[str, DataFrame], edges: dict[str, DataFrame], orphans: dict[str, DataFrame]) -> DataFrame:
    """kind, label, n of a graph plan: nodes by key, edges by their ends, and what hangs on nothing."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), F.lit(label).alias("label"), "n") for kind, tables in (("node", nodes), ("edge", edges), ("orphan", orphans)) for label, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def trade_plan(customer: DataFrame, orders: DataFrame, lineitem: DataFrame, part: DataFrame, supplier: DataFrame, nation: DataFrame, region: DataFrame) -> tuple[dict[str, DataFrame], dict[str, DataFrame], dict[str, DataFrame]]:
    """(nodes, edges, orphans) of the trade tables as one graph: a pure function of its inputs, so a plan can be
    counted, compared and reviewed before anything is written. Edges exist only between nodes that do."""
    keyed = lambda df, key: df.select(F.col(key).alias("key")).dropDuplicates(["key"])
    nodes = {"Region": keyed(region, "r_regionkey"), "Nation": keyed(nation, "n_nationkey"), "Customer": keyed(customer, "c_custkey"), "Supplier": keyed(supplier, "s_suppkey"), "Part": keyed(part, "p_partkey"), "Order": keyed(orders, "o_orderkey"), "Brand": keyed(part, "p_brand")}

    def edge(df: DataFrame, src: str, a: str, dst: str, b: str) -> DataFrame:
        pairs = df.select(F.col(src).alias("src"), F.col(dst).alias("dst")).dropna().dropDuplicates(["src", "dst"])
        return pairs.join(nodes[a].withColumnRenamed("key", "src"), "src", "left_semi").join(nodes[b].withColumnRenamed("key", "dst"), "dst", "left_semi")

    edges = {
        "IN_REGION": edge(nation, "n_nationkey", "Nation", "n_regionkey", "Region"),
        "LIVES_IN": edge(customer, "c_custkey", "Customer", "c_nationkey", "Nation"),
        "BASED_IN": edge(supplier, "s_suppkey", "Supplier", "s_nationkey", "Nation"),
        "PLACED": edge(orders, "o_custkey", "Customer", "o_orderkey", "Order"),
        "CONTAINS": edge(lineitem, "l_orderkey", "Order", "l_partkey", "Part"),
        "SUPPLIED": edge(lineitem, "l_suppkey", "Supplier", "l_partkey", "Part"),
        "OF_BRAND": edge(part, "p_partkey", "Part", "p_brand", "Brand"),
    }
    lacking = lambda node, label, end: nodes[node].join(edges[label].select(F.col(end).alias("key")).distinct(), "key", "left_anti")
    orphans = {
        "customers_without_orders": lacking("Customer", "PLACED", "src"),
        "orders_without_parts": lacking("Order", "CONTAINS", "src"),
        "orders_without_customer": lacking("Order", "PLACED", "dst"),
        "parts_never_ordered": lacking("Part", "CONTAINS", "dst"),
        "parts_without_supplier": lacking("Part", "SUPPLIED", "dst"),
        "suppliers_without_parts": lacking("Supplier", "SUPPLIED", "src"),
        "nations_without_customers": lacking("Nation", "LIVES_IN", "dst"),
        "nations_without_suppliers": lacking("Nation", "BASED_IN", "dst"),
    }
    return nodes, edges, orphans


#: Keys of another table up to which a plan's rows stay where they are for the join with them.
SPREAD_KEYS = 100_000


def counted_plan(tables: dict[str, DataFrame], nodes: dict[str, tuple[str, str]], edges: dict[str, tuple[str, str, str, str, str]], orphans: dict[str, tuple[str, str, str]]) -> DataFrame:
    """kind, label, n of a graph plan by declaration: nodes label -> (table, key); edges label -> (table, source column, its node,
    target column, its node), each pair once and only between nodes that exist; orphans label -> (node, edge, src or dst): nodes
    that are no such end of the edge. Null keys are no nodes.

    Each table is scanned once: its nodes, edges and the nodes that these meet are rows of one table of which each stays once, dealt
    into parts that grow with it, and an orphan count is a difference of two counts of them. Whether a node of another table exists is a join with its keys."""
    signed = []
    for table in tables:
        mine = {label: e for label, e in edges.items() if e[0] == table}
        columns = {c for _, src, _, dst, _ in mine.values() for c in (src, dst)} | {key for t, key in nodes.values() if t == table}
        if not columns:
            continue
        rows, seen = tables[table].select(*sorted(columns)), {}
        for _, src, a, dst, b in mine.values():
            for column, node in ((src, a), (dst, b)):
                if (column, node) not in seen:
                    seen[column, node] = F.col(column).isNotNull()
                    if nodes[node] != (table, column):
                        flag, other = f"_{node}_{column}", tables[nodes[node][0]]
                        size = other.count()
                        known = dealt(other.select(F.col(nodes[node][1]).alias(f"_k{flag}")).dropna(), size, f"_k{flag}").distinct().withColumn(flag, F.lit(True))
                        if size > SPREAD_KEYS:  # fewer keys go to the rows
                            rows = dealt(rows, tables[table].count(), column)
                        rows = rows.join(known, F.col(column) == F.col(f"_k{flag}"), "left")
                        seen[column, node] = F.col(flag)
        counts = {("node", label): (F.col(key),) for label, (t, key) in nodes.items() if t == table}
        for label, (_, src, a, dst, b) in mine.items():
            there = seen[src, a] & seen[dst, b]
            counts["edge", label] = (F.when(there, F.col(src)), F.when(there, F.col(dst)))
            for end, column in (("src", src), ("dst", dst)):
                if any(x[1:] == (label, end) for x in orphans.values()):
                    counts[end, label] = (F.when(there, F.col(column)),)
        if not counts:
            continue
        # what is counted is told apart by its place, so one pass over the rows leaves each value once, and counts are of rows
        kinds = {k for _, k in rows.select(*[c.alias(f"c{i}") for i, c in enumerate(sum(counts.values(), ()))]).dtypes}
        kind = kinds.pop() if len(kinds) == 1 else "string"
        values = [F.struct(F.lit(i).alias("i"), *[(ends[j] if j < len(ends) else F.lit(None)).cast(kind).alias(f"v{j}") for j in range(2)]) for i, ends in enumerate(counts.values())]
        each = rows.select(F.explode(F.array(*values)).alias("x")).select("x.*").filter("v0 is not null")
        pair = [i for i, ends in enumerate(counts.values()) if len(ends) == 2]
        each = each.filter(F.col("v1").isNotNull() | ~F.col("i").isin(pair)).withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(16)))
        most = len(counts) * tables[table].count()
        once = dealt(each, most, "i", "v0", "v1", "_salt").distinct().drop("_salt")
        once = dealt(once, most, "i", "v0", "v1").distinct()
        told = []
        for i, (kind, label) in enumerate(counts):
            if kind in ("node", "edge"):
                told.append((i, kind, label, 1))
            told += [(i, "orphan", o, 1) for o, (node, _, _) in orphans.items() if kind == "node" and node == label]
            told += [(i, "orphan", o, -1) for o, (_, edge, end) in orphans.items() if (kind, label) == (end, edge)]
        signs = once.sparkSession.createDataFrame(told, "i int, kind string, label string, sign int")
        n = once.groupBy("i").agg(F.count("*").alias("n"))
        signed.append(F.broadcast(signs).join(n, "i", "left").select("kind", "label", (F.col("sign") * F.coalesce("n", F.lit(0))).alias("n")))
    return reduce(DataFrame.unionByName, signed).groupBy("kind", "label").agg(F.sum("n").alias("n"))


#: The trade tables as a graph, for `counted_plan`.
TRADE_NODES = {"Region": ("region", "r_regionkey"), "Nation": ("nation", "n_nationkey"), "Customer": ("customer", "c_custkey"), "Supplier": ("supplier", "s_suppkey"), "Part": ("part", "p_partkey"), "Order": ("orders", "o_orderkey"), "Brand": ("part", "p_brand")}
TRADE_EDGES = {
    "IN_REGION": ("nation", "n_nationkey", "Nation", "n_regionkey", "Region"), "LIVES_IN": ("customer", "c_custkey", "Customer", "c_nationkey", "Nation"), "BASED_IN": ("supplier", "s_suppkey", "Supplier", "s_nationkey", "Nation"),
    "PLACED": ("orders", "o_custkey", "Customer", "o_orderkey", "Order"), "CONTAINS": ("lineitem", "l_orderkey", "Order", "l_partkey", "Part"), "SUPPLIED": ("lineitem", "l_suppkey", "Supplier", "l_partkey", "Part"), "OF_BRAND": ("part", "p_partkey", "Part", "p_brand", "Brand"),
}
TRADE_ORPHANS = {
    "customers_without_orders": ("Customer", "PLACED", "src"), "orders_without_parts": ("Order", "CONTAINS", "src"), "orders_without_customer": ("Order", "PLACED", "dst"), "parts_never_ordered": ("Part", "CONTAINS", "dst"),
    "parts_without_supplier": ("Part", "SUPPLIED", "dst"), "suppliers_without_parts": ("Supplier", "SUPPLIED", "src"), "nations_without_customers": ("Nation", "LIVES_IN", "dst"), "nations_without_suppliers": ("Nation", "BASED_IN", "dst"),
}


#: How far a match of each tier can be trusted.
CONFIDENCE = {"reviewed_alias": 1.0, "exact": 1.0, "normalized": 0.9, "tokenset": 0.75}


def match_tiers(names: DataFrame, vocabulary: DataFrame, name: str, label: str, tiers: dict, aliases: DataFrame | None = None) -> DataFrame:
    """name, label, tier, confidence: tiers (tier -> key expression of a column) in order, each of which
    counts only where its key belongs to exactly one label. Reviewed aliases(name, label)
    come before all tiers, where the vocabulary has their label."""
    labels = vocabulary.select(label).distinct()
    out = names.select(name).distinct()
    hits, found = [], []
    if aliases is not None:
        reviewed = aliases.join(labels, label, "left_semi").groupBy(name).agg(F.min(label).alias("_reviewed_alias"))
        out = out.join(reviewed, name, "left")
        tiers = {"reviewed_alias": None} | tiers
    for tier, key in tiers.items():
        if key is not None:
            dim = labels.select(key(label).alias("_key"), F.col(label).alias(f"_{tier}")).groupBy("_key").agg(F.min(f"_{tier}").alias(f"_{tier}"), F.count("*").alias("_n")).filter("_n = 1").drop("_n")
            out = out.withColumn("_key", key(name)).join(dim, "_key", "left").drop("_key")
        hits.append(F.col(f"_{tier}"))
        found.append(F.when(F.col(f"_{tier}").isNotNull(), F.lit(tier)))
    tier = F.coalesce(*found)
    confidence = F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair])[tier]
    return out.select(name, F.coalesce(*hits).alias("label"), tier.alias("tier"), confidence.alias("confidence"))


def support(baskets: DataFrame, basket: str, item: str, least: int = 2) -> DataFrame:
    """src < dst, n: items that least baskets or more have together."""
    n = baskets.count()
    held = dealt(baskets.select(basket, item), n, basket).distinct()
    pairs = held.select(basket, F.col(item).alias("src")).join(held.select(basket, F.col(item).alias("dst")), basket).filter("src < dst").select("src", "dst")
    return dealt(pairs, 4 * n, "src", "dst").groupBy("src", "dst").agg(F.count("*").alias("n")).filter(F.col("n") >= least)

"""N-gram Jaccard self join: size-banded tiles, bitmap bounds, exact intersection."""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER_SPACED, U64, cut, cut_path, doc_bytes, forget, map_batches, read, signed, window_hashes, word_hashes
from .components import components
from .runs import runs


#: Keys that a row takes into tiles, to tell whether a pair meets under a lesser one too.
LOW = 6


@dataclass(frozen=True)
class Rule:
    """Link when 100 * intersection >= percent * union of the sets of size-word shingles."""

    words: int = 4
    percent: int = 85
    hot_rows: int = 256  # rows of a key from which it is put last in the order of keys
    hot_keys: int = 65_536  # at most so many keys, the most frequent ones, are put last
    tile_rows: int = 1_024
    pair_rows: int = 10_000  # pairs of a document from which they are dealt into parts

    def shingles(self, raw: bytes | None) -> np.ndarray:
        """The sorted set of shingle hashes; of fewer words the whole sequence is one."""
        words = word_hashes((raw or b"").translate(LOWER_SPACED))
        return np.unique(window_hashes(words, min(self.words, len(words)))) if len(words) else words

    def probe(self, n: int) -> int:
        """So many first shingles, in any one order of all, of a set of n: one of them
        is in the other set of every linked pair, and if the other set is no smaller,
        one of the first index(n) is."""
        return n - (self.percent * n + 99) // 100 + 1

    def index(self, n: int) -> int:
        return n - (2 * self.percent * n + 99 + self.percent) // (100 + self.percent) + 1

    def linked(self, x: np.ndarray, y: np.ndarray) -> bool:
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both > 0 and 100 * both >= self.percent * (len(x) + len(y) - both)

    def band(self, n):
        """Linked sets lie in the same size band or in neighbouring ones."""
        return F.floor(F.log(n.cast("double")) / math.log(100 / self.percent) + 1e-9).cast("int")


def bitmap(hashes: np.ndarray, times: int = 2) -> bytes:
    """One hashed bit for each shingle, in a power of two of bits, at least times as many."""
    width = max(64, times << (len(hashes) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[(hashes & U64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def folded(raw: bytes, width: int) -> np.ndarray:
    """The bitmap at a smaller power of two of 64-bit words: its parts or-ed together."""
    words = np.frombuffer(raw, U64)
    return np.bitwise_or.reduce(words.reshape(-1, width), axis=0) if len(words) > width else words


def coarse(raw: bytes) -> bytes | None:
    """The bitmap for tiles, where a long set comes once for each of many keys: a wide one
    folded four times, to 2048 bits at least, so that widths still rise with the size;
    null for one that goes as it is."""
    return None if len(raw) <= 256 else folded(raw, max(len(raw) // 4, 256) // 8).tobytes()


def most_shared(n: int, bits: np.ndarray, m: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Of a set of n shingles and each of the others of m: a bit that only one side
    has stands for a shingle that the other lacks, which bounds the overlap from above."""
    return np.minimum(n - np.bitwise_count(bits & ~others).sum(axis=1), m - np.bitwise_count(others & ~bits).sum(axis=1)).astype(np.int64)


def _sketch(docs: DataFrame, rule: Rule, hot: np.ndarray | None = None) -> DataFrame:
    """doc_id, n, digest of the set, bits, coarse bits, keys: the probe prefix in the
    order of (hot, hash), low: the least of those within index(n) and the least of all, LOW each.
    hot: a sorted array of at most rule.hot_keys hashes."""
    shared = docs.sparkSession.sparkContext.broadcast(hot) if hot is not None else None

    def rows(ids, raws, *_):
        out: dict[str, list] = {"doc_id": ids, "n": [], "digest": [], "bits": [], "coarse": [], "keys": [], "low": []}
        for raw in raws:
            s = rule.shingles(raw)
            keys = s
            if shared is not None and len(s):
                at = np.minimum(np.searchsorted(shared.value, s), len(shared.value) - 1)
                late = shared.value[at] == s
                keys = np.concatenate([s[~late], s[late]])
            out["n"].append(len(s))
            out["digest"].append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            out["bits"].append(bitmap(s) if len(s) else b"")
            out["coarse"].append(coarse(out["bits"][-1]))
            keys = signed(keys[: rule.probe(len(s))]) if len(s) else np.zeros(0, np.int64)
            out["keys"].append(keys)
            out["low"].append(np.concatenate([np.sort(keys[: rule.index(len(s))])[:LOW], np.sort(keys)[:LOW]]) if len(s) else keys)
        return out

    return map_batches(docs, rows, "doc_id long, n int, digest binary, bits binary, coarse binary, keys array<long>, low array<long>")


def _split(df: DataFrame, ids: DataFrame, log_bits: int = 20) -> tuple[DataFrame, DataFrame]:
    """(rows whose doc_id may be among ids, the others), before any shuffle: ids leave
    one bit each in a table of 2**log_bits bits at most, so the broadcast has a fixed bound."""
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << log_bits)).cast("int")
    table = ids.select(bit.alias("bit")).groupBy(F.shiftright("bit", 5).alias("_word")).agg(F.expr("bit_or(shiftleft(1L, bit & 31))").alias("_mask"))
    marked = df.withColumn("_bit", bit).withColumn("_word", F.shiftright("_bit", 5)).join(F.broadcast(table), "_word", "left")
    maybe = F.expr("coalesce(bit_get(_mask, _bit & 31) = 1, false)")
    return tuple(marked.filter(x).select(*df.columns) for x in (maybe, ~maybe))


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return _split(docs, ids)[0].join(ids, "doc_id", "left_semi")


def _keyed(sets: DataFrame, rule: Rule) -> DataFrame:
    """key, n, doc_id, first (the key is within index(n)), of rows that can have a
    partner under the key: in the order of (n, doc_id) the smaller of a pair is first and the
    larger at most 100 / percent times as large."""
    index = F.expr(f"n - (2 * {rule.percent} * n + {99 + rule.percent}) div {100 + rule.percent} + 1")
    rows = sets.select(F.posexplode("keys").alias("at", "key"), "n", "doc_id", index.alias("index")).select("key", "n", "doc_id", (F.col("at") < F.col("index")).alias("first"))
    by_size = Window.partitionBy("key").orderBy("n", "doc_id")
    after = F.lead("n").over(by_size).cast("long")
    before = F.last(F.when(F.col("first"), F.col("n").cast("long")), ignorenulls=True).over(by_size.rowsBetween(Window.unboundedPreceding, -1))
    sides = rows.withColumns({"after": after, "before": before})
    return sides.filter((F.col("first") & (F.col("after") * rule.percent <= F.col("n") * 100)) | (F.col("before") * 100 >= F.col("n") * rule.percent)).select("key", "n", "doc_id", "first")


def _popular(pairs: DataFrame, rows: int) -> DataFrame | None:
    """doc_id, salts: documents that stand in more than rows pairs, and the parts to deal them into."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
    found = cut(ids.groupBy("doc_id").agg(F.ceil(F.count("*") / rows).cast("int").alias("salts")).filter("salts > 1"))
    return found if found.take(1) else None


def _with_sides(pairs: DataFrame, side: DataFrame, columns: list[str], rule: Rule) -> DataFrame:
    """a, b and the columns of side (by doc_id) as <column>_a and <column>_b. A document of
    very many pairs is sent once to each of several parts of them."""
    popular = _popular(pairs, rule.pair_rows)
    for me, other in (("a", "b"), ("b", "a")):
        mine = side.select(F.col("doc_id").alias(me), *(F.col(c).alias(f"{c}_{me}") for c in columns))
        if popular is None:
            pairs = pairs.join(mine, me)
        else:
            salts = popular.select(F.col("doc_id").alias(me), "salts")
            pairs = pairs.join(salts, me, "left").withColumn("salt", F.pmod(F.xxhash64(other), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
            mine = mine.join(salts, me, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
            pairs = pairs.join(mine, [me, "salt"]).drop("salt")
    return pairs.select("a", "b", *(f"{c}_{s}" for s in "ab" for c in columns))


def _pairs_bounded(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) that their bitmaps leave possible."""

    def rows(a, b, n, bits, m, others):
        keep = []
        for i in range(len(a)):
            width = min(len(bits[i]), len(others[i])) // 8
            most = int(most_shared(n[i], folded(bits[i], width), np.array([m[i]]), folded(others[i], width)[None])[0])
            keep.append(100 * most >= rule.percent * (n[i] + m[i] - most))
        return {"a": [x for x, k in zip(a, keep, strict=True) if k], "b": [x for x, k in zip(b, keep, strict=True) if k]}

    return map_batches(_with_sides(pairs, sets, ["n", "bits"], rule), rows, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """The pairs that exact intersection of their sorted shingle arrays links."""
    pairs = cut(pairs)
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    texts = cut(_texts_of(docs, ids))

    def rows(a, b, x, y):
        keep = [i for i in range(len(a)) if rule.linked(rule.shingles(x[i]), rule.shingles(y[i]))]
        return {"a": [a[i] for i in keep], "b": [b[i] for i in keep]}

    return cut(map_batches(_with_sides(pairs, texts, ["raw"], rule), rows, "a long, b long"))


def _hot_keys(sets: DataFrame, rule: Rule) -> np.ndarray | None:
    """The most frequent keys, sorted: of those that a task holds eight times or more."""

    def often(batches):
        found = [b.column(0).combine_chunks().flatten().to_numpy() if isinstance(b.column(0), pa.ChunkedArray) else b.column(0).flatten().to_numpy() for b in batches if b.num_rows]
        if found:
            keys, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_pydict({"key": keys[n >= 8], "n": n[n >= 8]})

    rows = sets.select("keys").mapInArrow(often, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") > rule.hot_rows)
    keys = rows.orderBy(F.col("n").desc(), "key").limit(rule.hot_keys).toPandas()["key"].to_numpy(np.int64)
    return np.sort(keys.view(U64)) if len(keys) else None


def _neighbours(keyed: DataFrame, rule: Rule) -> DataFrame:
    """Pairs to look at first: of each key, sets next to each other by size, and all
    with the set that most others share keys with (often the one the rest are copied from)."""
    of_key = Window.partitionBy("key")
    near = of_key.orderBy("n", "doc_id")
    fame = keyed.withColumn("g", F.count("*").over(of_key)).groupBy("doc_id").agg(F.sum("g").alias("fame"))
    sides = keyed.join(fame, "doc_id").select("doc_id", "n", F.lag(F.struct("doc_id", "n")).over(near).alias("before"), F.max(F.struct("fame", "doc_id", "n")).over(of_key).alias("best"))
    pairs = sides.select("doc_id", "n", F.explode(F.array("before", F.struct("best.doc_id", "best.n"))).alias("x")).filter("x is not null").select("doc_id", "n", F.col("x.doc_id").alias("other"), F.col("x.n").alias("m"))
    fits = F.least("n", "m") * 100 >= F.greatest("n", "m") * rule.percent
    return pairs.filter(fits & (F.col("doc_id") != F.col("other"))).select(F.least("doc_id", "other").alias("a"), F.greatest("doc_id", "other").alias("b")).distinct()


def _tile_rows(keyed: DataFrame, sets: DataFrame, labels: DataFrame, rule: Rule, once: bool) -> DataFrame:
    """The rows of the tiles, named by key, tile, i, j: those under a key that no link joins yet.

    A key of at most rule.tile_rows rows is a tile; the rows of one with more are dealt into
    blocks of one size band, and pairs of blocks of one band, or of neighbouring bands, are
    tiles. A component of many rows under the key has blocks of its own, and no
    tile joins those with each other: a great component and a few strangers make
    as many tiles as it has blocks, not their square.
    """
    low = F.col("low") if once else F.lit(None).cast("array<long>").alias("low")
    labelled = keyed.join(labels, keyed["doc_id"] == labels["node"], "left").select("key", "n", "doc_id", "first", F.coalesce("component", "doc_id").alias("component"))
    keys = labelled.groupBy("key").agg(F.count("*").alias("rows"), F.min("component").alias("low"), F.max("component").alias("high")).filter(f"low < high and rows > {1 if once else 2}").select("key", "rows")  # two alone have been compared as neighbours
    left = cut(labelled.join(keys, "key").withColumn("band", rule.band(F.col("n"))))
    contents = _split(sets.select("doc_id", F.coalesce("coarse", "bits").alias("bits"), low), left.select("doc_id"))[0]
    names = ["key", "tile", "i", "j", "n", "doc_id", "first", "component", "upper", "block"]
    rows = left.filter(F.col("rows") <= rule.tile_rows).withColumns({"tile": F.lit(-1), "i": F.lit(0), "j": F.lit(0), "upper": F.lit(0), "block": F.lit(0)}).select(*names)
    large = left.filter(F.col("rows") > rule.tile_rows)
    groups = cut(large.groupBy("key", "band", "component").agg(F.count("*").alias("c")))
    if groups.take(1):
        rows = rows.unionByName(_block_rows(large, groups, rule).select(*names))
    return rows.join(contents, "doc_id").select(*names, "bits", "low")


def _block_rows(large: DataFrame, groups: DataFrame, rule: Rule) -> DataFrame:
    """The rows of keys of more than rule.tile_rows rows, once for each tile of blocks that they stand in.

    The driver plans a query whole and starts all its scans and broadcasts at once, so small
    tables are cut and the bands met are one join, not a union of plans."""
    own_blocks = F.ceil(F.col("c") / rule.tile_rows).cast("int")
    pure = groups.filter(F.col("c") >= rule.tile_rows).withColumn("own", own_blocks)
    spans = cut(pure.withColumn("from", (F.sum("own").over(Window.partitionBy("key", "band").orderBy("component")) - F.col("own")).cast("int")).select("key", "band", "component", "from", "own"))
    of_mixed = F.ceil(F.coalesce(F.sum(F.when(F.col("c") < rule.tile_rows, F.col("c"))), F.lit(0)) / rule.tile_rows).cast("int")
    of_pure = F.coalesce(F.sum(F.when(F.col("c") >= rule.tile_rows, own_blocks)), F.lit(0)).cast("int")
    sizes = cut(groups.groupBy("key", "band").agg(of_pure.alias("pure"), (of_pure + of_mixed).alias("blocks")))
    part = lambda n: F.pmod(F.xxhash64("doc_id"), n).cast("int")
    dealt = large.join(sizes, ["key", "band"]).join(spans, ["key", "band", "component"], "left")
    dealt = dealt.withColumn("block", F.when(F.col("from").isNotNull(), F.col("from") + part(F.col("own"))).otherwise(F.col("pure") + part(F.col("blocks") - F.col("pure"))))
    dealt = dealt.select("key", "band", "n", "doc_id", "first", "component", "block")

    def seen_from(df: DataFrame) -> DataFrame:
        """df, of bands, for rows of the same band and of the neighbouring ones, which lie step below."""
        return df.withColumn("step", F.explode(F.array(*map(F.lit, (0, 1, -1))))).withColumn("band", F.col("band") - F.col("step"))

    # a row, once for each block of the band step above its own that holds other components
    there = dealt.join(seen_from(sizes.select("key", "band", "blocks")), ["key", "band"]).join(seen_from(spans), ["key", "band", "component", "step"], "left")
    blocks = F.expr("filter(sequence(0, blocks - 1), i -> from is null or i < from or i >= from + own)")
    block, other, step = F.col("block"), F.col("other"), F.col("step")
    # a band's rows meet those of the band below in the tiles (block there, own block + 1000000)
    i = F.when(step == 0, F.least(block, other)).when(step == 1, block).otherwise(other)
    j = F.when(step == 0, F.greatest(block, other)).when(step == 1, other + 1_000_000).otherwise(block + 1_000_000)
    tile = F.col("band") - (step == -1).cast("int")
    return there.withColumn("other", F.explode(blocks)).withColumns({"i": i, "j": j, "tile": tile, "upper": (step == -1).cast("int")})


def _tiles(keyed: DataFrame, sets: DataFrame, labels: DataFrame, rule: Rule, best: int | None, once: bool) -> DataFrame:
    """key, a, b: pairs under a key that no link joins yet and bitmaps leave possible.

    With best, a set names only so many larger ones, those with the highest bound; rows
    (key, doc_id, null) then say which had more. With once, a pair is left out under a key where
    low keys show that it meets under a lesser one, too (a round before has either checked it
    there or named both rows), so it comes at least once and seldom often.
    """

    def pairs(batches):
        for t in runs(batches, 4):
            found = _possible_pairs(t, rule, best)
            if found and found["a"]:
                yield pa.RecordBatch.from_pydict(found | {"key": [t.column("key")[0].as_py()] * len(found["a"])}, schema=pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64())]))

    rows = _tile_rows(keyed, sets, labels, rule, once)
    return cut(rows.repartition("key", "tile", "i", "j").sortWithinPartitions("key", "tile", "i", "j").mapInArrow(pairs, "key long, a long, b long"))


def _possible_pairs(t: pa.Table, rule: Rule, best: int | None) -> dict[str, list] | None:
    t = t.sort_by([("n", "ascending"), ("doc_id", "ascending")])
    n, ids, first, part, upper, block = (t.column(c).to_numpy() for c in ("n", "doc_id", "first", "component", "upper", "block"))
    if (part == part[0]).all():
        return None
    i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
    raws = t.column("bits").to_pylist()
    widths = np.array([len(r) // 8 for r in raws])
    by_width = {}  # of a width, where its rows begin, and they with all as wide or twice so, folded to it
    for w in np.unique(widths).tolist():
        low, high = np.searchsorted(widths, [w, 2 * w + 1])
        by_width[w] = low, np.stack([folded(r, w) for r in raws[low:high]])
    lesser = [None if k is None else (set(k[: len(k) - min(LOW, rule.probe(m))]), set(k[len(k) - min(LOW, rule.probe(m)) :])) for k, m in zip(t.column("low").to_pylist(), n.tolist(), strict=True)]
    key = t.column("key")[0].as_py()
    wide = n.astype(np.int64)
    a, b, more = [], [], set()
    for x in np.flatnonzero(first[:-1]):  # of a pair the smaller set has the key within its index prefix
        y = np.arange(x + 1, max(x + 1, np.searchsorted(n, 100 * int(n[x]) // rule.percent, "right")))
        y = y[part[y] != part[x]]
        if j >= 1_000_000:
            y = y[upper[y] != upper[x]]
        elif i != j:
            y = y[block[y] != block[x]]
        if not len(y):
            continue
        low, bits = by_width[int(widths[x])]
        most = most_shared(int(n[x]), bits[x - low], wide[y], bits[y - low])
        union = n[x] + wide[y] - most
        can = 100 * most >= rule.percent * union
        y, share = y[can], (most / union)[can]
        if lesser[x] is not None and len(y):
            own = {k for k in lesser[x][0] if k < key}
            here = np.array([own.isdisjoint(lesser[k][1]) for k in y])
            y, share = y[here], share[here]
        if best is not None and len(y) > best:
            more.update([int(ids[x]), *ids[y].tolist()])
            y = y[np.argsort(-share, kind="stable")[:best]]
        a += [int(ids[x])] * len(y)
        b += ids[y].tolist()
    return {"a": a + sorted(more), "b": b + [None] * len(more)}


def join_ngrams(docs: DataFrame, rule: Rule = Rule(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each row.

    Two documents link when 100 * intersection >= percent * union of their sets of
    word shingles; component_id is the least doc_id that links reach. No link between
    different texts is lost. A null text or one without words has an empty set and links
    with nothing; rows that share a doc_id are one document; rows with a null doc_id
    are compared with nothing and get a null component_id. Long texts are hashed in
    chunks, extra columns are ignored.

    Equal sets are one class from the start (aggregation by digest), so copies are
    never paired. Of the classes, prefixes of the sets make the candidate keys; the most
    frequent keys (a list of fixed bound) come last in the order, so common passages
    stay out of the prefixes. First, sets next to each other by size under a key, and
    each with the one that most share keys with, are checked and joined to components;
    then only sets of different components meet in size-banded tiles, where bitmaps
    bound the overlap before the exact intersection: the best few of each set, which
    joins most of a group of near copies, then all that are still apart.
    """
    if dict(docs.dtypes)[doc_id] not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{doc_id} must be a whole number")
    docs = doc_bytes(docs, text=text, doc_id=doc_id).withColumn("doc_id", F.col("doc_id").cast("long"))
    known = docs.filter(F.col("doc_id").isNotNull())
    spark, path = docs.sparkSession, cut_path(docs.sparkSession)
    all_sets = cut(_sketch(docs, rule), path)
    sets = all_sets.filter("n > 0 and doc_id is not null")
    classes = sets.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    copies = cut(sets.select("doc_id", "digest").join(classes.filter("copies > 1"), "digest").filter("doc_id != rep").select("doc_id", "digest"))
    maybe, unique = _split(sets, copies)
    of_class = unique.unionByName(maybe.join(copies, ["doc_id", "digest"], "left_anti").select(*sets.columns))

    hot = _hot_keys(of_class, rule)
    if hot is not None:
        late = set(signed(hot).tolist())
        touched = cut(map_batches(of_class.select("doc_id", "keys"), lambda ids, ks: {"doc_id": [i for i, k in zip(ids, ks, strict=True) if not late.isdisjoint(k)]}, "doc_id long").distinct())
        maybe, unique = _split(sets, copies.select("doc_id").union(touched))  # of sets: a split of of_class would plan its branches twice
        kept = maybe.join(copies, ["doc_id", "digest"], "left_anti").join(touched, "doc_id", "left_anti").select(*sets.columns)
        of_class = unique.unionByName(kept).unionByName(_sketch(_texts_of(known, touched), rule, hot))
    repeated = cut(sets.groupBy("doc_id").agg(F.count("*").alias("rows"), (F.min("digest") != F.max("digest")).alias("several")).filter("rows > 1").select("doc_id", "several"))
    links = None
    if repeated.take(1):  # rows of equal doc_id: equal ones once, and links between different ones
        maybe, once = _split(of_class, repeated)
        of_class = once.unionByName(maybe.dropDuplicates(["doc_id", "digest"]))
        several = repeated.filter("several").select("doc_id")
        links = cut(_split(sets.select("doc_id", "digest"), several)[0].join(several, "doc_id").join(classes, "digest").filter("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    of_class = cut(of_class)
    all_sets = cut(all_sets.select("doc_id", "n", "digest"))
    forget(spark, path)  # the wide rows are in of_class now
    sets = all_sets.filter("n > 0 and doc_id is not null")
    classes = sets.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    keyed = cut(_keyed(of_class, rule))
    bits = of_class.select("doc_id", "n", "bits", "coarse", "low")

    found = _verified(_pairs_bounded(cut(_neighbours(keyed, rule)), bits, rule), known, rule)
    if links is not None:
        found = found.unionByName(links)
    labels = cut(components(found))
    for best, once in ((2, False), (None, True)):
        tiles = _tiles(keyed, bits, labels, rule, best, once)
        pairs = tiles.filter("b is not null and a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        new = _verified(_pairs_bounded(cut(pairs), bits, rule), known, rule)
        if new.take(1):
            found = found.unionByName(new)
            labels = cut(components(found))
        keyed = cut(keyed.join(tiles.filter("b is null").select("key", F.col("a").alias("doc_id")).distinct(), ["key", "doc_id"], "left_semi").select(*keyed.columns))
        if not keyed.take(1):
            break

    linked = classes.join(labels, classes["rep"] == labels["node"], "left").filter("copies > 1 or component is not null").select("digest", F.coalesce("component", "rep").alias("component"))
    return (
        all_sets.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "digest")
        .join(linked, "digest", "left")
        .select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
    )


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_ngrams(read(spark, sf_dir, "documents"))

"""Merkle manifest of a dataset: leaves, subtrees by language, proofs by pointer jumping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, read

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Children of a node.
ARITY = 8
#: Ancestors that may be broadcast in one round; each has a segment of at most ARITY - 1 digests a level.
BROADCAST_NODES = 20_000
#: The tree over the subroots; languages are trees 0, 1, ...
TOP = -1

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_KEY = ("tree", "level", "at")


def field(value: Column) -> Column:
    """A value as the leaf's digest takes it: `-` for null, else its UTF-8 byte count, `:`, and itself."""
    value = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_digest(**other: Column) -> Column:
    """SHA-256 (lower-case hex) of a row's fields in their order; other replaces some."""
    return F.sha2(F.concat(*(field(other.get(name, F.col(name))) for name in FIELDS)), 256)


def placed(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """rows, as a written table, with place (0, 1, ... by order within the group) and size (of the group).

    Rows are dealt by ranges of (group, order), so a large group is in many tasks and no
    window runs over one. A task's rows of a group are numbered where they stand; only one row for each
    task and group goes on to the sums that say where they begin."""
    by = [group, *(c for c in order if c != group)]
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    dealt = cut(dealt.withColumn("here", F.monotonically_increasing_id()).withColumn("task", F.shiftrightunsigned("here", 33)))
    parts = dealt.groupBy(group, "task").agg(F.min("here").alias("begin"), F.count("*").alias("n"))
    whole = Window.partitionBy(group)
    parts = parts.select(F.col(group).alias("same"), F.col("task").alias("in"), "begin", (F.sum("n").over(whole.orderBy("task")) - F.col("n")).alias("before"), F.sum("n").over(whole).alias("size"))
    joined = dealt.join(cut(parts), (F.col("task") == F.col("in")) & F.col(group).eqNullSafe(F.col("same")))
    return joined.withColumn("place", F.col("before") + F.col("here") - F.col("begin")).select(*rows.columns, "place", "size")


def _digests(children: str) -> Column:
    """The hex text of the children's digests in order."""
    return F.array_join(F.transform(children, lambda c: F.lower(F.hex(c["digest"]))), "")


def _beside(text: str, pos: str) -> tuple[Column, Column]:
    """Digests left and right of the child at pos, as bytes."""
    return F.unhex(F.substring(F.col(text), F.lit(1), 64 * F.col(pos))), F.unhex(F.substring(F.col(text), 64 * F.col(pos) + 65, F.length(text)))


def _parent(level: int, left: Column) -> Column:
    """Key of the node that left nodes of a level end in: a tree's last node is, under
    another name, a leaf of the top tree (and there the root)."""
    end = (left == 1) & (F.col("tree") != TOP)
    return F.struct(F.when(end, TOP).otherwise(F.col("tree")).alias("tree"), F.when(end, 0).otherwise(level).alias("level"), F.when(end, F.col("tree")).otherwise(F.col("at")).alias("at"))


def climb(nodes: DataFrame, level: int) -> tuple[list[DataFrame], DataFrame]:
    """Links of all nodes(tree, at, n: how many its tree has on this level, digest) and of the
    nodes above them, and (tree, digest) of the trees' last nodes. A level is
    one grouping by eights, written; it has an eighth of the rows of the one below."""
    links, ends = [], [nodes.filter("n = 1").select("tree", "digest")]
    nodes = nodes.filter("n > 1")
    while not nodes.isEmpty():
        grouped = nodes.groupBy("tree", "n", F.expr(f"at div {ARITY}").alias("up")).agg(F.array_sort(F.collect_list(F.struct("at", "digest"))).alias("children"))
        grouped = grouped.withColumn("text", _digests("children")).withColumn("digest", F.unhex(F.sha2("text", 256))).withColumn("left", F.expr(f"(n + {ARITY - 1}) div {ARITY}"))
        grouped = cut(grouped.withColumnRenamed("up", "at"))
        child = grouped.select("tree", "left", "digest", "text", _parent(level + 1, F.col("left")).alias("to"), F.posexplode("children").alias("pos", "child"))
        links.append(
            child.select(
                F.struct("tree", F.lit(level).alias("level"), F.col("child.at").alias("at")).alias("node"),
                "to",
                F.array(F.struct(*(c.alias(name) for c, name in zip(_beside("text", "pos"), ("left", "right"), strict=True)))).alias("segment"),
                F.when((F.col("left") == 1) & (F.col("tree") != TOP), F.col("digest")).alias("subroot"),
            )
        )
        nodes, level = grouped.select("tree", "at", F.col("left").alias("n"), "digest"), level + 1
        ends.append(nodes.filter("n = 1").select("tree", "digest"))
        nodes = nodes.filter("n > 1")
    return links, reduce(DataFrame.union, ends)


def jumped(links: DataFrame, rounds: int) -> DataFrame:
    """links with `to` moved to the root: a round joins the table with itself, each node takes over
    its ancestor's ancestor and appends the ancestor's segment, so the distance doubles.

    Ancestors 2^r levels up are shared by 8^(2^r) nodes. While they are many, each has few
    nodes and the join shuffles; once they are BROADCAST_NODES or fewer, they are broadcast."""
    links = cut(links)
    for _ in range(rounds):
        above = cut(links.join(links.select(F.col("to").alias("node")).distinct(), "node", "left_semi").toDF("to", "next", "more", "over"))
        above = F.broadcast(above) if above.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES else above
        joined = links.join(above, "to", "left")
        links = cut(joined.select("node", F.coalesce("next", "to").alias("to"), F.when(F.col("more").isNull(), F.col("segment")).otherwise(F.concat("segment", "more")).alias("segment"), F.coalesce("subroot", "over").alias("subroot")))
    return links


def folded(digest: Column, proof: str = "proof") -> Column:
    """The root that a leaf's digest (hex) and a proof (array of the digests left and right of the way, level by level) give."""
    return F.aggregate(proof, digest, lambda d, s: F.sha2(F.concat(F.lower(F.hex(s["left"])), d, F.lower(F.hex(s["right"]))), 256))


def manifest(docs: DataFrame, replaced: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root (hex), proof, found: one row for each row of docs. found is the leaf
    of the row with the text `replaced` (an expression over docs; null: the text as it is).

    A leaf is the digest of doc_id, source, lang, n_chars and text; other columns are ignored. In each
    language leaves ascend by doc_id (null first), rows of one doc_id by leaf, so the result doesn't
    depend on their order; a null language is a language, and comes first. A tree's runs of eight become their
    digest until one is left; the subroots, by language, are the leaves of the top tree.
    No row, no root: an empty table gives an empty result.

    Documents are read once; what goes on are digests. Levels, numbers and proofs are
    groupings by eights and joins on nodes, none of them over a whole language. Only nodes above
    the leaves jump; the eight leaves of a run take its finished segment by one join, so a
    proof is moved once for eight leaves.
    """
    texts = docs.select(*FIELDS, (F.lit(None).cast("string") if replaced is None else replaced).alias("replaced"))
    leaves = cut(texts.select("doc_id", F.col("lang").cast("string").alias("lang"), F.unhex(leaf_digest()).alias("digest"), F.when(F.col("replaced").isNotNull(), F.unhex(leaf_digest(text=F.col("replaced")))).alias("found")))
    leaves = cut(placed(leaves, "lang", "doc_id", "digest"))
    langs = placed(leaves.groupBy("lang").agg(F.count("*").alias("n")).withColumn("all", F.lit(0)), "all", "lang").select(F.col("lang").alias("of"), F.col("place").alias("tree"))
    # numbers go to runs of places, not to rows of a language, so that a large language is no hot key
    block = F.expr("place div 4096")
    blocks = leaves.groupBy("lang", block.alias("b")).agg(F.count("*").alias("c")).join(langs, F.col("lang").eqNullSafe(F.col("of"))).select("of", "b", "tree")
    leaves = leaves.withColumn("block", block).join(blocks, (F.col("block") == F.col("b")) & F.col("lang").eqNullSafe(F.col("of")))

    runs = leaves.groupBy("tree", "size", F.expr(f"place div {ARITY}").alias("at")).agg(F.array_sort(F.collect_list(F.struct("place", "digest", "found", "doc_id"))).alias("children"))
    runs = runs.withColumn("text", _digests("children")).withColumn("digest", F.when(F.col("size") > 1, F.unhex(F.sha2("text", 256))).otherwise(F.col("children")[0]["digest"]))
    runs = cut(runs.withColumn("left", F.expr(f"(size + {ARITY - 1}) div {ARITY}")))
    links, subroots = climb(runs.select("tree", "at", F.col("left").alias("n"), "digest"), 1)
    subroots = cut(subroots)
    n = subroots.count()
    if not n:
        return docs.select("doc_id", *(F.lit("").alias(c) for c in ("leaf", "subroot", "root")), F.array(F.struct(F.lit(b"").alias("left"), F.lit(b"").alias("right"))).alias("proof"), F.lit("").alias("found")).limit(0)
    more, top = climb(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("at"), F.lit(n).cast("long").alias("n"), "digest"), 0)
    root = F.lit(top.select(F.lower(F.hex("digest"))).first()[0])

    rows = runs.select("left", "size", F.col("digest").alias("run"), "text", _parent(1, F.col("left")).alias("node"), "children")
    if links := links + more:
        known = jumped(reduce(DataFrame.union, links), (len(links) - 1).bit_length())
        rows = rows.join(known.drop("to"), "node", "left")
    else:
        rows = rows.withColumns({"segment": F.expr("cast(null as array<struct<left:binary,right:binary>>)"), "subroot": F.lit(None).cast("binary")})
    rows = rows.select("*", F.posexplode("children").alias("pos", "child"))
    left, right = _beside("text", "pos")
    own = F.when(F.col("size") > 1, F.array(F.struct(left.alias("left"), right.alias("right")))).otherwise(F.expr("cast(array() as array<struct<left:binary,right:binary>>)"))
    hexed = lambda c: F.lower(F.hex(c))
    return rows.select(
        F.col("child.doc_id").alias("doc_id"),
        hexed("child.digest").alias("leaf"),
        hexed(F.when(F.col("left") == 1, F.col("run")).otherwise(F.col("subroot"))).alias("subroot"),
        root.alias("root"),
        F.concat(own, F.coalesce("segment", F.expr("cast(array() as array<struct<left:binary,right:binary>>)"))).alias("proof"),
        hexed(F.coalesce("child.found", "child.digest")).alias("found"),
    )


def proof_digest(proof: str = "proof") -> Column:
    """SHA-256 of a proof's digests in their order."""
    return F.sha2(F.lower(F.array_join(F.transform(proof, lambda s: F.concat(F.hex(s["left"]), F.hex(s["right"]))), "")), 256)


def verified(docs: DataFrame, replaced: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root (of the leaf with the replaced text, if any, and
    the proof of the original), verified: whether that is the root."""
    rows = manifest(docs, replaced)
    return rows.select("doc_id", "leaf", "subroot", "root", proof_digest().alias("proof_sha256"), folded(F.col("found")).alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.translate("text", _UPPER, _LOWER))
    return verified(read(spark, sf_dir, "documents"), tampered)

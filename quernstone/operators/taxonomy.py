"""A taxonomy out of labels: entries from curated and observed names, promotion rules, and where every label went."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions import norm
from quernstone.lineage import cut
from quernstone.operators.content import resolve_chains
from quernstone.operators.cycles import weak_components

#: Observed labels under so many uses are the long tail.
SUBSTANTIVE = 4


def entries(curated: DataFrame, observed: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entry, label, status, occurrences, tier; label, entry of every name) from curated(label), observed(label, n) and
    aliases(label, alias).

    Names are one entry where they differ in case and separators only, where one is an alias of another, and where that leads
    on: entries are the components of that graph, found in rounds that grow with the logarithm of their size. An entry is called
    by a curated name of it, else by one with spaces, else in title case, else by the most used, then the first. tier:
    substantive from SUBSTANTIVE uses on, compound if ` / ` joins several, else long_tail; null for curated ones. Null and empty
    labels, and those without a letter or digit, are no names."""
    every = curated.select("label", F.lit(True).alias("curated"), F.lit(0).cast("long").alias("n")).unionByName(observed.select("label", F.lit(False).alias("curated"), F.col("n").cast("long").alias("n")))
    every = every.unionByName(aliases.select(F.col("alias").alias("label"), F.lit(False).alias("curated"), F.lit(0).cast("long").alias("n")))
    names = every.groupBy("label").agg(F.max("curated").alias("curated"), F.sum("n").alias("n")).withColumn("key", norm("label")).filter("key != ''")
    names = cut(names)
    key = lambda c: F.concat(F.lit("k:"), c)  # noqa: E731 - keys and labels are different nodes
    linked = aliases.select(key(norm("label")).alias("src"), key(norm("alias")).alias("dst")).filter("src != 'k:' and dst != 'k:'")
    links = names.select(key(F.col("key")).alias("src"), F.concat(F.lit("n:"), "label").alias("dst")).unionByName(linked)
    of = weak_components(links).filter("node like 'n:%'").select(F.expr("substring(node, 3)").alias("label"), F.col("component").alias("entry"))
    named = cut(names.join(of, "label"))
    spaced, titled = F.col("label").rlike(r"\s"), F.col("label") == F.initcap("label")
    best = F.min_by("label", F.struct(~F.col("curated"), ~spaced, ~titled, -F.col("n"), F.col("label")))
    found = named.groupBy("entry").agg(best.alias("label"), F.max("curated").alias("curated"), F.sum("n").alias("occurrences"))
    tier = F.when(F.col("curated"), None).when(F.contains("label", F.lit(" / ")), "compound").when(F.col("occurrences") >= SUBSTANTIVE, "substantive").otherwise("long_tail")
    found = found.select("entry", "label", F.when(F.col("curated"), "curated").otherwise("derived").alias("status"), "occurrences", tier.alias("tier"))
    return found, named.select("label", "entry")


def promoted(found: DataFrame, banned: DataFrame, merges: DataFrame, excluded: Column, keys: DataFrame) -> DataFrame:
    """entry, label, skill_key, outcome (promoted, carried, declined), reason, survivor of each of `entries`.

    The first that applies: a banned(label) name is declined, one that merges(label, survivor) names goes into its survivor, followed
    to the end where that is merged too (a circle of merges is declined whole); an excluded entry (a predicate over
    label, status, occurrences, tier; null is no) is declined; the long tail and compounds are carried, all else is promoted. A survivor that was itself
    declined declines what merged into it. keys(label, skill_key): names that keep an older key; a key is never renamed by a display name."""
    first = merges.filter("label is not null and survivor is not null and label != survivor").groupBy("label").agg(F.min("survivor").alias("survivor"))
    ends = resolve_chains(first, "label", "survivor")
    circle = ends.join(first.select(F.col("label").alias("survivor")), "survivor", "left_semi").select("label").withColumn("circle", F.lit(True))
    rows = found.join(ends, "label", "left").join(circle, "label", "left").join(banned.select("label").distinct().withColumn("banned", F.lit(True)), "label", "left")
    rows = rows.join(keys.groupBy("label").agg(F.min("skill_key").alias("skill_key")), "label", "left")
    reason = (
        F.when(F.col("banned"), "banned")
        .when(F.col("circle"), "merged_in_a_circle")
        .when(F.col("survivor").isNotNull(), "merged")
        .when(F.coalesce(excluded, F.lit(False)), "excluded")
        .when(F.col("tier").isin("long_tail", "compound"), F.col("tier"))
    )
    rows = rows.withColumn("reason", reason)
    outcome = F.when(F.col("reason").isNull(), "promoted").when(F.col("reason").isin("long_tail", "compound"), "carried").otherwise("declined")
    rows = cut(rows.withColumn("outcome", outcome).withColumn("survivor", F.when(F.col("reason") == "merged", F.col("survivor"))))
    fallen = rows.filter("outcome = 'declined' and reason != 'merged'").select(F.col("label").alias("survivor"), F.lit(True).alias("fallen"))
    rows = rows.join(fallen, "survivor", "left")
    return rows.select("entry", "label", F.coalesce("skill_key", "label").alias("skill_key"), "outcome", F.when(F.col("fallen"), "merged_into_declined").otherwise(F.col("reason")).alias("reason"), F.when(F.col("fallen").isNull(), F.col("survivor")).alias("survivor"))


def mappings(named: DataFrame, outcomes: DataFrame) -> DataFrame:
    """label, to, kind of every name once: the entry's label (canonical for itself, else surface_variant), the survivor of a
    merge (semantic_merge), or null (declined)."""
    rows = named.join(outcomes.select("entry", F.col("label").alias("_label"), "outcome", "survivor"), "entry")
    to = F.when(F.col("survivor").isNotNull(), F.col("survivor")).when(F.col("outcome") != "declined", F.col("_label"))
    kind = F.when(F.col("survivor").isNotNull(), "semantic_merge").when(F.col("outcome") == "declined", "declined").when(F.col("label") == F.col("_label"), "canonical").otherwise("surface_variant")
    return rows.select("label", to.alias("to"), kind.alias("kind"))


# Items and windows of pages ------------------------------------------------------------


def page_windows(pages: DataFrame, items: DataFrame, key: str, page: str, order: list[str], width: int = 4, cap: int = 20) -> DataFrame:
    """key, window, part, first_page, last_page, and the item's columns: each item with every window of pages that it may stand on.

    A record's different pages, in order, are windows of width that overlap by one page, and one window if there are no more
    than width. A window takes the items as far along as it is itself, and a quarter of their number more (one at least) on both sides; its
    items come in parts of cap. Every item is in a window; records without pages have none, null pages are none.

    Items and windows meet by numbers: an item's place tells the windows that may hold it, so it is given to these and joined
    by equality, never compared with all."""
    numbered = pages.select(key, page).dropna().distinct().withColumn("_p", F.row_number().over(Window.partitionBy(key).orderBy(page)) - 1)
    counted = numbered.groupBy(key).agg(F.count("*").alias("_pages"))
    step = max(1, width - 1)
    windows = F.when(F.col("_pages") <= width, 1).otherwise(F.ceil(F.col("_pages") / step)).cast("long")
    counted = counted.withColumn("_w", windows)
    spread = numbered.join(counted, key).withColumn("_at", F.when(F.col("_w") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.filter(F.array(F.expr(f"_p div {step}"), F.expr(f"_p div {step} - 1")), lambda w: (w >= 0) & (w < F.col("_w")) & (F.col("_p") < w * step + width))))
    held = spread.select(key, page, F.explode("_at").alias("window")).groupBy(key, "window").agg(F.min(page).alias("first_page"), F.max(page).alias("last_page"))
    by = Window.partitionBy(key)
    placed = items.withColumns({"_i": F.row_number().over(by.orderBy(*order)) - 1, "_n": F.count("*").over(by)}).join(counted, key)
    n, w, i = F.col("_n"), F.col("_w"), F.col("_i")
    low = lambda k: F.floor(n * k / w)
    pad = lambda k: F.when(w == 1, 0).otherwise(F.greatest(F.lit(1), F.floor((low(k + 1) - low(k)) / 4)))
    begin, end = (lambda k: F.greatest(F.lit(0), low(k) - pad(k))), (lambda k: F.least(n, low(k + 1) + pad(k)))
    # a window's slice with its margins reaches at most a window's share and the margin beyond, so windows near the item's place suffice
    reach = F.ceil(w / n) + 2
    near = F.sequence(F.greatest(F.lit(0).cast("long"), F.floor(i * w / n) - reach), F.least(w - 1, F.floor((i + 1) * w / n) + reach))
    rows = placed.withColumn("window", F.explode(F.filter(near, lambda k: (i >= begin(k)) & (i < end(k)))))
    rows = rows.withColumn("part", F.floor((i - begin(F.col("window"))) / cap))
    return rows.join(held, [key, "window"]).select(key, "window", "part", "first_page", "last_page", *[c for c in items.columns if c != key])

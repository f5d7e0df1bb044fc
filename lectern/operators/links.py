"""Links between references: resolution, neighbours, tiered ordering with turns for every book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import refs as R

# Where each tier starts and how much each further line of the same book adds.
BASE = (0, 1, 2, 4, 6, 8, 20)
STEP = (2, 3, 3, 5, 6, 8, 10)


def neighbours(links: DataFrame, anchors: DataFrame) -> DataFrame:
    """(anchor, other, kind) of links (a, b, kind) that touch an anchor, from either end."""
    both = links.selectExpr("a as anchor", "b as other", "kind").union(links.selectExpr("b as anchor", "a as other", "kind"))
    return both.join(anchors, "anchor", "left_semi").distinct()


def first_passage(pairs: DataFrame, column: str, refs: DataFrame) -> DataFrame:
    """A section's reference replaced by its first passage, up to two levels down; null if there is none."""
    for n, suffix in enumerate(("", ":1", ":1:1")):
        known = refs.select(F.col("ref").alias(f"_k{n}"))
        pairs = pairs.join(known, F.concat(F.col(column), F.lit(suffix)) == known[f"_k{n}"], "left")
    return pairs.withColumn(column, F.coalesce("_k0", "_k1", "_k2")).drop("_k0", "_k1", "_k2")


def resolve_links(pairs: DataFrame, refs: DataFrame) -> DataFrame:
    """Distinct (a, b) with both ends known."""
    refs = refs.distinct()
    return first_passage(first_passage(pairs, "a", refs), "b", refs).where("a is not null and b is not null").select("a", "b").distinct()


def capped(rows: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """At most ``most`` rows of each key, in order; Spark prunes by rank before it shuffles."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def fuse(tiers: list[tuple[str, DataFrame]], per_tier: int, most: int) -> DataFrame:
    """(role, ref) of ranked lists (ref, seq): a reference counts in its first list; caps for a list and for all."""
    every = None
    for n, (role, df) in enumerate(tiers):
        own = df.select(F.lit(n).alias("tier"), F.lit(role).alias("role"), "ref", "seq")
        every = own if every is None else every.unionByName(own)
    once = capped(every, ["ref"], ["tier", "seq"], 1)
    return capped(once, ["tier"], ["seq"], per_tier).orderBy("tier", "seq").limit(most).select("role", "ref")


def order_linked(pairs: DataFrame, anchors: DataFrame, tier: Column, pos: Column, most: int) -> DataFrame:
    """Linked lines in the order to open them.

    pairs: (anchor, other, seen); anchors: (anchor, anchor_index). Each line is placed by its best link; lines of one
    book take turns, so score = BASE[tier] + round * STEP[tier].
    """
    known = pairs.join(anchors, "anchor").join(anchors.select(F.col("anchor").alias("other")), "other", "left_anti")
    rows = known.withColumn("tier", tier).withColumn("pos", pos)
    best = rows.groupBy("other").agg(F.min(F.struct("tier", "anchor_index", "seen", "pos")).alias("m")).select("other", "m.*")
    placed = best.withColumn("book", R.book_of(F.col("other"))).withColumn("key", R.place_key(R.place_of(F.col("other"))))
    turn = F.row_number().over(Window.partitionBy("book").orderBy("tier", "anchor_index", "key", "seen")) - 1
    pick = lambda table: F.element_at(F.array(*map(F.lit, table)), F.col("tier") + 1)
    scored = placed.withColumn("score", pick(BASE) + turn * pick(STEP))
    return scored.orderBy("score", "tier", "anchor_index", "pos", "seen", "key").limit(most).select("other", "tier", "score")


def turns(tiered: DataFrame) -> DataFrame:
    """(anchor, other, n): for every anchor the order in which to open its linked lines, by (tier, pos); lines of one book take turns."""
    placed = tiered.withColumn("book", R.book_of(F.col("other"))).withColumn("key", R.place_key(R.place_of(F.col("other"))))
    turn = F.row_number().over(Window.partitionBy("anchor", "book").orderBy("tier", "key", "other")) - 1
    pick = lambda table: F.element_at(F.array(*map(F.lit, table)), F.col("tier") + 1)
    scored = placed.withColumn("score", pick(BASE) + turn * pick(STEP))
    return scored.select("anchor", "other", F.row_number().over(Window.partitionBy("anchor").orderBy("score", "tier", "pos", "other")).alias("n"))

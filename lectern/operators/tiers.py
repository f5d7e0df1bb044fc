"""How a linked line stands to the line it is linked with, by tables of rules instead of branches.

A book's family comes from the longest prefix that a table names. Within a family one table ranks the commentators printed with
its books, another the books that are its sources. All tables are small next to the links, but they are parameters,
so they are met by equality joins that hold at any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import refs as R

#: Tiers of a line that no table names: on the same line, elsewhere, and kept for the end.
ON_LINE, ELSEWHERE, LAST = 4, 5, 6


def longest_prefix(names: DataFrame, column: str, rules: DataFrame) -> DataFrame:
    """``names`` (distinct values of ``column``) with the columns of the rule whose prefix is the longest that the name begins with.

    ``rules`` has (prefix, exact, ...); with exact the whole name must be equal. Each name gives a key for each of its lengths that
    the rules may have, so the rules are met by an equality join. Names without a rule are left out.
    """
    rest = [c for c in rules.columns if c not in ("prefix", "exact")]
    keyed = names.select(column).where(F.length(column) > 0).distinct().withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(1), F.length(column)), lambda n: F.substring(F.col(column), F.lit(1), n))))
    met = keyed.join(rules, "prefix").where(~F.col("exact") | (F.col("prefix") == F.col(column)))
    return met.groupBy(column).agg(F.max(F.struct(F.length("prefix").alias("n"), F.col("exact").alias("e"), *rest)).alias("m")).select(column, *[F.col(f"m.{c}").alias(c) for c in rest])


def commentator(book: Column, explained: Column) -> Column:
    """Who wrote a book that is named "X on <explained>"; null for other books."""
    tail = F.concat(F.lit(" on "), explained)
    return F.when(F.endswith(book, tail), F.substring(book, F.lit(1), F.length(book) - F.length(tail)))


def tiers(pairs: DataFrame, families: DataFrame, commentators: DataFrame, sources: DataFrame) -> DataFrame:
    """``pairs`` (anchor, other) with family, tier, pos and whether the other line is a commentary on the anchor.

    families: (prefix, exact, family, whole) where ``whole`` says that a commentary belongs to the whole first number of a place, not
    to its line. commentators: (family, name, tier, pos), the name as "X" of "X on <book>" or a book's own name. sources:
    (family, prefix, exact, tier, pos). A book of no family is "plain", whose commentaries come first.
    """
    named = pairs.withColumn("a_book", R.book_of(F.col("anchor"))).withColumn("o_book", R.book_of(F.col("other"))).withColumn("a_place", R.place_of(F.col("anchor"))).withColumn("o_place", R.place_of(F.col("other")))
    of = longest_prefix(named.select("a_book"), "a_book", families)
    rows = named.join(of, "a_book", "left").withColumn("family", F.coalesce("family", F.lit("plain"))).withColumn("whole", F.coalesce("whole", F.lit(False)))
    who = commentator(F.col("o_book"), F.col("a_book"))
    first = lambda c: F.substring_index(c, ":", 1)
    near = F.when(F.col("whole"), (F.col("o_place") != "") & (first(F.col("o_place")) == first(F.col("a_place")))).otherwise(
        (F.col("o_place") == F.col("a_place")) | F.startswith(F.col("o_place"), F.concat("a_place", F.lit(":")))
    )
    rows = rows.withColumn("who", who).withColumn("near", near).withColumn("name", F.coalesce("who", "o_book"))
    ranked = rows.join(commentators.select("family", "name", F.col("tier").alias("c_tier"), F.col("pos").alias("c_pos")), ["family", "name"], "left")
    # sources by family: the family is the first part of the prefix, so that one join finds the longest
    key = lambda family, book: F.concat(family, F.lit("\x1f"), book)
    met = longest_prefix(ranked.select(key(F.col("family"), F.col("o_book")).alias("key")), "key", sources.select(key(F.col("family"), F.col("prefix")).alias("prefix"), "exact", F.col("tier").alias("s_tier"), F.col("pos").alias("s_pos")))
    every = ranked.withColumn("key", key(F.col("family"), F.col("o_book"))).join(met, "key", "left")
    listed = F.col("near") & F.col("c_tier").isNotNull()
    on = F.col("near") & F.col("who").isNotNull()
    tier = F.when(listed, F.col("c_tier")).when(F.col("s_tier").isNotNull(), F.col("s_tier")).when(on & (F.col("family") == "plain"), 0).when(on, ON_LINE).otherwise(ELSEWHERE)
    pos = F.when(listed, F.col("c_pos")).when(F.col("s_tier").isNotNull(), F.col("s_pos")).otherwise(0)
    commentary = F.when(listed, True).when(F.col("s_tier").isNotNull(), False).otherwise(on)
    return every.select(*pairs.columns, "family", tier.cast("int").alias("tier"), pos.cast("int").alias("pos"), commentary.alias("commentary"))

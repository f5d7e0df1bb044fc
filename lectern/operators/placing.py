"""Placing titles in a catalogue: which title another one explains, shelves by category, and sets within groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ON = " on "


def plain(title: Column) -> Column:
    """A title for comparing: lower case, without combining marks, vowel points and quotation marks."""
    return F.regexp_replace(F.lower(title), "[\u0300-\u036f\u0591-\u05c7'\u2019\u2018`\"\u05f4\u05f3]", "")


def endings(title: Column) -> Column:
    """The proper endings of a title that begin after a space."""
    words = F.split(title, " ")
    return F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(2), F.size(words)), lambda i: F.array_join(F.slice(words, i, F.size(words)), " "))).otherwise(F.array().cast("array<string>"))


def explained(titles: DataFrame, bases: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(title, base) for each of ``titles`` (title): the base title it explains, null where there is none.

    What follows the last " on " decides if it names a base, compared plainly (or by an alias: ``aliases`` has alias, base);
    else the longest base that the title ends with, as written. A title's part after a semicolon does not count. Each ending
    is a join key, so that no title is compared with every base.
    """
    own = titles.select("title").distinct().withColumn("name", F.trim(F.substring_index("title", ";", 1)))
    known = bases.select(F.col("title").alias("base")).distinct()
    named = known.select("base", plain(F.col("base")).alias("key"))
    if aliases is not None:
        more = aliases.select("base", plain(F.col("alias")).alias("key")).join(known, "base", "left_semi").join(named.select("key"), "key", "left_anti")
        named = named.unionByName(more)
    # of several bases with one plain name the first in order
    named = named.groupBy("key").agg(F.min("base").alias("base"))
    after = own.where(F.col("name").contains(ON)).select("title", plain(F.substring_index("name", ON, -1)).alias("key"))
    by_on = after.join(named, "key").select("title", "base", F.lit(1).alias("rule"))
    by_end = own.select("title", F.explode(endings(F.col("name"))).alias("base")).join(known, "base", "left_semi").select("title", "base", F.lit(0).alias("rule"))
    best = by_on.unionByName(by_end).groupBy("title").agg(F.max(F.struct("rule", F.length("base").alias("n"), "base")).alias("m")).select("title", F.col("m.base").alias("base"))
    return titles.select("title").distinct().join(best, "title", "left")


def placed(books: DataFrame, shelves: DataFrame, mark: str, aliases: DataFrame | None = None) -> DataFrame:
    """Books (title, categories, seq) with shelf, group, the base they explain, by whom, and where they stand.

    ``shelves`` is (category, shelf); a category that matches ``mark`` says that a book explains another. Such a book stands where its
    base does, under the name of its commentator: the category after the mark, unless that is empty, else what stands
    before " on " or before the base's title.
    """
    marked = F.exists("categories", lambda c: c.rlike(mark))
    shelved = books.join(shelves.select(F.col("category").alias("_c"), "shelf"), F.get("categories", F.lit(0)) == F.col("_c"), "left").drop("_c")
    shelved = shelved.withColumn("shelf", F.coalesce("shelf", F.lit("other")))
    rest = F.filter(F.slice("categories", 2, 1000), lambda c: ~c.rlike(mark))
    main = shelved.where(~marked).select("title", "seq", "shelf", F.coalesce(F.get(rest, F.lit(0)), F.lit("")).alias("group"), F.lit(None).cast("string").alias("on"), F.lit(None).cast("string").alias("by"))
    notes = shelved.where(marked)
    base = explained(notes, main, aliases).join(main.select(F.col("title").alias("base"), F.col("shelf").alias("of_shelf"), F.col("group").alias("of_group")).dropDuplicates(["base"]), "base", "left")
    name = F.trim(F.substring_index("title", ";", 1))
    at = F.array_position(F.transform("categories", lambda c: c.rlike(mark)), True).cast("int")
    given = F.regexp_replace(F.coalesce(F.get("categories", at), F.lit("")), " on .*$", "")
    before = F.substring(name, F.lit(1), F.length(name) - F.length("base"))
    said = F.when(name.contains(ON), F.regexp_extract(name, "^(.*) on ", 1)).when(F.endswith(name, F.col("base")), F.trim(before)).otherwise(name)
    explaining = notes.join(base, "title", "left").select(
        "title", "seq", F.coalesce("of_shelf", "shelf").alias("shelf"), F.coalesce("of_group", F.get("categories", F.lit(1)), F.lit("")).alias("group"), F.col("base").alias("on"), F.when(given != "", given).otherwise(said).alias("by")
    )
    every = main.unionByName(explaining)
    where = F.when(F.col("on").isNotNull(), F.concat(F.lit("on "), "on", F.lit(", "), "shelf")).otherwise(F.concat_ws(", ", "shelf", F.when(F.col("group") != "", F.col("group"))))
    return every.withColumn("where", where)


def grouped(books: DataFrame) -> DataFrame:
    """Placed books with their set within shelf and group: what one commentator has there; a set of one is no set."""
    members = F.count("by").over(Window.partitionBy("shelf", "group", "by"))
    place = F.row_number().over(Window.partitionBy("shelf", "group", "set").orderBy("seq", "title"))
    return books.withColumn("_n", members).withColumn("set", F.when(F.col("by").isNotNull() & (F.col("_n") > 1), F.col("by"))).withColumn("place", place).drop("_n")

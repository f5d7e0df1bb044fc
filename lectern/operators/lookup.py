"""Reference lookup: from a reference to the rows it means."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import refs as R


def resolve(passages: DataFrame, asked: DataFrame, per_ref: int | None = None) -> DataFrame:
    """Rows of ``passages`` (ref, title, seq, id) for each of ``asked`` (pos, ref).

    The first way that gives rows counts: the exact line, the range from it to an end in its section, the whole title,
    the section with ":" and then with " " before a number. Each way is an equi-join on a key made from the row's
    reference, so a long list of references is one shuffle and not one probe each.
    """
    want = asked.select("pos", R.range_start(F.col("ref")).alias("start"), R.range_end(F.col("ref")).alias("end"))
    rows = passages.withColumn("section", R.section_of(F.col("ref")))
    exact = want.join(rows, want.start == rows.ref).select("pos", "end", F.lit(1).alias("way"), *passages.columns, "section")
    first = exact.where("end is not null").groupBy("pos", "end", "section").agg(F.min("seq").alias("lo"))
    last = first.join(rows.select(F.col("ref").alias("end"), F.col("seq").alias("s")), "end", "left").groupBy("pos", "section", "lo").agg(F.min("s").alias("hi"))
    ranged = last.join(rows, "section").where("seq >= lo and (hi is null or seq <= hi)").select("pos", F.lit(1).alias("way"), *passages.columns)
    lines = exact.where("end is null").select("pos", "way", *passages.columns)
    title = want.join(rows, want.start == rows.title).select("pos", F.lit(2).alias("way"), *passages.columns)
    colon = want.join(rows, want.start == rows.section).select("pos", F.lit(3).alias("way"), *passages.columns)
    book = want.join(rows.withColumn("book", R.book_of(F.col("ref"))), F.col("start") == F.col("book")).select("pos", F.lit(4).alias("way"), *passages.columns)
    every = lines.unionByName(ranged).unionByName(title).unionByName(colon).unionByName(book)
    best = every.withColumn("least", F.min("way").over(Window.partitionBy("pos"))).where("way = least").drop("least", "way").distinct()
    if per_ref is None:
        return best
    return limit_refs(best, ["pos"], per_ref)


def limit_refs(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """At most ``most`` references of each key, by first place; all rows of a kept reference stay."""
    place = F.min("seq").over(Window.partitionBy(*keys, "ref"))
    ranked = rows.withColumn("_at", place)
    return ranked.withColumn("_n", F.dense_rank().over(Window.partitionBy(*keys).orderBy("_at", "ref"))).where(F.col("_n") <= most).drop("_at", "_n")


def focused(rows: DataFrame, key: str, words: list[str], phrases: list[str], most: int) -> DataFrame:
    """Of each key the references that hold most of the words; a phrase counts three; the first ones if none does."""
    text = F.lower("text")
    score = sum([F.when(text.contains(w), 1).otherwise(0) for w in words] + [F.when(text.contains(p), 3).otherwise(0) for p in phrases], F.lit(0))
    by = rows.withColumn("_s", score).groupBy(key, "ref").agg(F.max("_s").alias("score"), F.min("seq").alias("at"))
    any_hit = F.max("score").over(Window.partitionBy(key)) > 0
    by = by.withColumn("_any", any_hit).where("not _any or score > 0")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.when(F.col("_any"), -F.col("score")).otherwise(0), "at", "ref"))
    return by.withColumn("_n", rank).where(F.col("_n") <= most).select(key, "ref", "score", "at")

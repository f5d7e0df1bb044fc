"""Matching of texts: quotes in documents, shingles, runs of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.sources.files import parts_for

#: Runs that one task sorts, at most: about 250 MB.
RUNS = 5_000_000


def squash(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", " ")


def grams(words: Column, n: int) -> Column:
    """All runs of n words, joined by spaces. ``words`` should be a column: an expression would be split anew for each run."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def hashed(run: Column) -> list[Column]:
    """A run of words as two 64-bit hashes, which is what is shuffled."""
    return [F.xxhash64(run).alias("h"), F.xxhash64(F.lit(1), run).alias("g")]


def runs_in(rows: DataFrame, key: str, n: int) -> DataFrame:
    """(key, h, g), one row for each distinct run of n words of rows (key, w)."""
    each = rows.select(key, F.explode(F.array_distinct(grams(F.col("w"), n))).alias("run"))
    return each.select(key, *hashed(F.col("run")))


def _holders(keys: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """(item_id, doc_id) where a document (doc_id, w) has a run of n words that is a key (item_id, h, g).

    Of the documents' runs only those that are keys leave their task if the keys are few enough to go to every task.
    """
    wanted = keys.select("h", "g").distinct()
    met = runs_in(docs, "doc_id", n).join(F.broadcast(wanted) if _small(wanted) else wanted, ["h", "g"], "left_semi")
    return met.join(keys, ["h", "g"]).select("item_id", "doc_id").distinct()


def quotes_in(quotes: DataFrame, docs: DataFrame, key_words: int = 4) -> DataFrame:
    """(item_id, doc_id) where the document holds the quote, white space aside.

    A quote's inner words meet the runs of as many words of the documents, then candidates are confirmed by a real
    search. A quote of three words or more has an inner word; shorter ones may begin and end inside of words and
    are searched for in every document, in one pass.
    """
    q = quotes.select("item_id", squash(F.col("quote")).alias("quote")).withColumn("w", F.split("quote", " "))
    d = docs.select("doc_id", squash(F.col("text")).alias("text"))
    split = d.select("doc_id", F.split("text", " ").alias("w"))
    # the first and last word of a quote may be cut inside a document's word
    inner = lambda n: hashed(F.array_join(F.slice("w", 2, n), " "))
    long_, middle, short = (q.where(F.expr(c)) for c in (f"size(w) >= {key_words + 2}", f"size(w) between 3 and {key_words + 1}", "size(w) < 3"))
    hits = _holders(long_.select("item_id", *inner(key_words)), split, key_words)
    if not middle.isEmpty():
        hits = hits.unionByName(_holders(middle.select("item_id", *inner(1)), split, 1))
    found = hits.join(q.select("item_id", "quote"), "item_id").join(d, "doc_id").where(F.contains("text", "quote")).select("item_id", "doc_id")
    if short.isEmpty():
        return found
    return found.unionByName(d.join(short, F.contains("text", "quote")).select("item_id", "doc_id"))


def sharing(quotes: DataFrame, docs: DataFrame, run: int = 4) -> DataFrame:
    """(item_id, doc_id) where the document has a run of ``run`` words of the quote, wherever it lies in either.

    Shorter quotes are searched for as they are.
    """
    q = quotes.select("item_id", squash(F.col("quote")).alias("quote")).withColumn("w", F.split("quote", " "))
    d = docs.select("doc_id", squash(F.col("text")).alias("text"))
    hits = _holders(runs_in(q, "item_id", run), d.select("doc_id", F.split("text", " ").alias("w")), run)
    short = q.where(F.size("w") < run).select("item_id", "quote")
    return hits if short.isEmpty() else hits.unionByName(d.join(short, F.contains("text", "quote")).select("item_id", "doc_id"))


def _small(df: DataFrame, most: int = 200_000) -> bool:
    """Whether a side has few enough rows to go to every task; counted, not assumed."""
    return df.limit(most + 1).count() <= most


def twins(passages: DataFrame, run: int) -> DataFrame:
    """(ref, other, shared) of passages (ref, words) that share runs of ``run`` words.

    A run as common as ``many`` passages would be paired out, so each run links its holders to the first of them, which
    keeps the groups and stays linear. Runs are shuffled once, as 96 bits of hashes, into as many parts as sort them in
    memory, and only the links again.
    """
    runs = passages.select("ref", F.explode(F.array_distinct(grams(F.col("words"), run))).alias("run")).select("ref", F.xxhash64("run").alias("h"), F.hash("run").alias("g"))
    many = passages.agg(F.sum(F.size("words"))).first()[0] or 0
    runs = runs.repartition(parts_for(passages.sparkSession, many, RUNS), "h", "g")
    linked = runs.withColumn("other", F.min("ref").over(Window.partitionBy("h", "g"))).where("ref <> other")
    return linked.groupBy("ref", "other").agg(F.count("*").alias("shared"))


def runs_of(rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Ranges (start, end) of consecutive numbers of each key."""
    island = F.col(number) - F.row_number().over(Window.partitionBy(*keys).orderBy(number))
    return rows.select(*keys, number).distinct().withColumn("_g", island).groupBy(*keys, "_g").agg(F.min(number).alias("start"), F.max(number).alias("end")).drop("_g")


def merge_spans(rows: DataFrame, keys: list[str], gap: int = 0) -> DataFrame:
    """Spans (lo, hi) of each key that overlap, or lie within ``gap``, as one."""
    w = Window.partitionBy(*keys).orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("lo") > reach + gap), 1).otherwise(0)
    marked = rows.withColumn("_new", new).withColumn("_g", F.sum("_new").over(w))
    return marked.groupBy(*keys, "_g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_g")

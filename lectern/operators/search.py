"""An inverted index as a table (token, doc_id, pos), phrase search and BM25 rank on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.sources.files import work_folder

K1, B, FLOOR = 1.2, 0.75, 1e-6


def words(text: Column) -> Column:
    return F.filter(F.split(X.plain(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def postings(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, token), one row for each word."""
    return docs.select("doc_id", F.posexplode(words(F.col("text"))).alias("pos", "token"))


def update_postings(index: DataFrame, changed: DataFrame) -> DataFrame:
    """Postings with those of changed documents replaced; documents with a null text are only removed."""
    return index.join(changed.select("doc_id"), "doc_id", "left_anti").unionByName(postings(changed))


def rank_phrases(docs: DataFrame, phrases: list[str], most: int) -> DataFrame:
    """(doc_id, score) of the best documents, ascending: each phrase counts as one term.

    Phrases are counted where their texts lie: a text is cut into words once, and what is kept of it is its length and a
    count for each phrase, which is all that is read again.
    """
    spark = docs.sparkSession
    # words with two spaces between them, so that each has its own on both sides
    line = F.trim(F.regexp_replace(X.plain(F.col("text")), r"[^\p{L}\p{N}]+", "  "))
    lines = docs.select("doc_id", line.alias("line"))
    length = F.when(F.col("line") == "", 0).otherwise(F.length("line") - F.length(F.replace("line", F.lit("  "), F.lit(" "))) + 1)
    names = [f"f{n}" for n in range(len(phrases))]
    counts = lines.select("doc_id", length.cast("double").alias("len"), *[_times(F.concat(F.lit(" "), "line", F.lit(" ")), p.split()).alias(f) for f, p in zip(names, phrases)])
    home = work_folder(spark)
    counts.write.parquet(home)  # narrow, and read twice
    counts = spark.read.parquet(home)
    whole = counts.agg(F.count("*").alias("docs"), F.avg("len").alias("mean"), *[F.count(F.when(F.col(f) > 0, 1)).alias(f"n_{f}") for f in names])
    terms = F.array(*[F.struct(F.lit(i).alias("phrase"), F.col(f).alias("f"), F.col(f"n_{f}").alias("n")) for i, f in enumerate(names)])
    scored = counts.crossJoin(F.broadcast(whole)).select("doc_id", "len", "docs", "mean", F.explode(F.filter(terms, lambda x: x["f"] > 0)).alias("x")).select("doc_id", "len", "docs", "mean", "x.*")
    idf = F.greatest(F.log((F.col("docs") - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(FLOOR))
    part = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    return scored.groupBy("doc_id").agg((-F.sum(part)).alias("score")).orderBy(F.round("score", 9), "doc_id").limit(most)


def _times(line: Column, phrase: list[str]) -> Column:
    """How often the words of a phrase follow each other in a line whose words have a space of their own on both sides; places may overlap."""
    first, *rest = (rf" \Q{w}\E " for w in phrase)
    return F.regexp_count(line, F.lit(first + (f"(?={''.join(rest)})" if rest else ""))).cast("double")


# What a typed word is worth against a word of a name. Two numbers: the least, and what likeness adds.
SAME, KEY, SHORT_KEY, BEGINS, KEY_BEGINS, WITHIN, ONE_SLIP, NEAR_KEY = 3.0, (2.2, 0.4), (1.0, 0.5), 1.5, 1.4, 1.2, 1.4, (1.0, 0.4)
# From how many letters on each way of matching counts, and how far keys of a length may differ.
LEAST_KEY, LEAST_SHORT, LEAST_BEGIN, LEAST_KEY_BEGIN, LEAST_WITHIN, LEAST_SLIP, NEAR = 3, 3, 2, 3, 4, 5, ((6, 2), (4, 1))


def word_score(q: Column, q_key: Column, n: Column, n_key: Column) -> Column:
    """The best of all ways in which a typed word and a word of a name, each with its key, agree; 0.0 if in none."""
    long_, same_key = F.length(q), (q_key == n_key) & (q_key != "")
    scaled = lambda pair: pair[0] + pair[1] * X.likeness(q, n)
    strong = [
        (q == n, F.lit(SAME)),
        (same_key & (F.length(q_key) >= LEAST_KEY), scaled(KEY)),
        (same_key & (F.length(q_key) < LEAST_KEY) & (F.least(long_, F.length(n)) >= LEAST_SHORT), scaled(SHORT_KEY)),
        ((long_ >= LEAST_BEGIN) & n.startswith(q), BEGINS + long_ / F.length(n)),
        ((F.length(q_key) >= LEAST_KEY_BEGIN) & n_key.startswith(q_key), F.lit(KEY_BEGINS)),
        ((long_ >= LEAST_WITHIN) & n.contains(q), F.lit(WITHIN)),
        ((long_ >= LEAST_SLIP) & (F.levenshtein(q, n) <= 1), F.lit(ONE_SLIP)),
    ]
    best = F.array_max(F.array(*[F.when(applies, value.cast("double")) for applies, value in strong]))
    slack = F.coalesce(*[F.when(F.length(q_key) >= size, slips) for size, slips in NEAR], F.lit(0))
    return F.coalesce(best, F.when((slack > 0) & (F.levenshtein(q_key, n_key) <= slack), scaled(NEAR_KEY)), F.lit(0.0))


def _shorter(word: Column, times: int) -> Column:
    """The word and what is left of it once up to ``times`` of its letters are gone."""
    out = F.array(word)
    for _ in range(times):
        less = F.flatten(F.transform(out, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))))
        out = F.array_distinct(F.concat(out, less))
    return out


def _meeting(word: Column, key: Column, asked: bool) -> Column:
    """Strings by which a typed word meets every word of a name that it can match, each marked by the way of matching.

    Beginnings and inner parts are spelt out on the side of the names; words with up to k slips between them have a
    string in common once up to k letters of either are gone.
    """
    span = lambda least, w: F.sequence(F.lit(least), F.greatest(F.length(w), F.lit(least)))
    begins = lambda w: F.array(w) if asked else F.transform(span(1, w), lambda i: F.substring(w, F.lit(1), i))
    within = F.array(word) if asked else F.flatten(F.transform(span(1, word), lambda i: F.transform(span(LEAST_WITHIN, word), lambda n: F.substring(word, i, n))))
    ways = {"k": F.array(key), "b": begins(word), "c": begins(key), "w": within, "s": _shorter(word, 1), "t": _shorter(key, NEAR[0][1])}
    marked = lambda mark, strings: F.transform(strings, lambda x: F.concat(F.lit(mark), x))
    return F.array_distinct(F.concat(*[marked(mark, strings) for mark, strings in ways.items()]))


def search_books(books: DataFrame, asked: DataFrame, most: int) -> DataFrame:
    """(q, title, score) of the books whose words match all words asked; unused words of a name cost a little.

    Words meet by strings that they have in common, so nothing is compared with the whole catalogue.
    """
    cut = lambda c: F.filter(F.split(F.lower(c), r"[\s,;:()\-–—/&.]+"), lambda w: w != "")
    q = asked.select("q", F.size(cut(F.col("q"))).alias("words"), F.posexplode(cut(F.col("q"))).alias("i", "w"))
    n = books.select("ord", "title", F.size(cut(F.col("title"))).alias("size"), F.explode(cut(F.col("title"))).alias("n"))
    typed = q.select("w").distinct().withColumn("key", X.skeleton(F.col("w")))
    named = n.select("n").distinct().withColumn("n_key", X.skeleton(F.col("n")))
    left = typed.select("w", "key", F.explode(_meeting(F.col("w"), F.col("key"), True)).alias("by"))
    right = named.select("n", "n_key", F.explode(_meeting(F.col("n"), F.col("n_key"), False)).alias("by"))
    pairs = left.join(right, "by").select("w", "key", "n", "n_key").distinct()
    scores = pairs.select("w", "n", word_score(F.col("w"), F.col("key"), F.col("n"), F.col("n_key")).alias("s")).where("s > 0")
    best = q.join(scores, "w").join(n, "n").groupBy("q", "words", "ord", "title", "size", "i").agg(F.max("s").alias("s"))
    total = best.groupBy("q", "words", "ord", "title", "size").agg(F.sum("s").alias("s"), F.count("*").alias("hits")).where("hits = words").withColumn("score", F.round(F.col("s") - 0.3 * (F.col("size") - F.col("hits")), 4))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "ord"))
    return total.withColumn("_n", rank).where(F.col("_n") <= most).select("q", "title", "score")

"""Phrases in texts: several words in a row, each as written or by how it begins, the first with or without a letter before it.

Words and patterns meet by equality: a word gives itself and those of its beginnings whose length some pattern has. The most
telling word of a phrase finds its candidates, and the words around it tell whether the phrase stands there. So no text is
compared with every phrase, common beginnings such as "th*" make no candidates, and words are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Patterns up to which they are sent to every task instead of shuffling the words to them.
SMALL = 50_000


def word_of(raw: Column) -> Column:
    """A word for comparing: lower case, without marks at its ends."""
    return F.regexp_replace(F.lower(raw), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def words_in(texts: DataFrame, key: str) -> DataFrame:
    """(key, raw, w): the words between white space, as written and for comparing."""
    raw = texts.select(key, F.filter(F.split("text", r"\s+"), lambda w: w != "").alias("raw"))
    return raw.select(key, "raw", F.transform("raw", word_of).alias("w"))


def patterns_of(phrases: DataFrame) -> DataFrame:
    """(phrase, rank, size, place, open, form): one row for each word of each phrase (phrase, rank, match array<string>); an open form ends with *."""
    rows = phrases.where(F.size("match") > 0).select("phrase", "rank", F.size("match").alias("size"), F.posexplode("match").alias("place", "pattern"))
    return rows.select("phrase", "rank", "size", "place", F.endswith("pattern", F.lit("*")).alias("open"), F.regexp_replace("pattern", r"\*$", "").alias("form"))


def found(words: DataFrame, key: str, phrases: DataFrame, lead: str = "") -> DataFrame:
    """(key, phrase, rank, start, end) of every phrase in ``words`` (key, w array<string>); ``lead`` may stand before a phrase's first word.

    A form with * takes longer words that begin with it. Places overlap freely. Only places that are found leave their task
    if the phrases are few enough to go to every task; else words are sent to them, each with those around it.
    """
    patterns = patterns_of(phrases)
    # a phrase is looked for by its most telling word alone: one as written before one that is open, then the longest
    telling = F.struct("open", (-F.length("form")).alias("short"), "place")
    whole = F.transform(F.sort_array(F.collect_list(F.struct("place", "open", "form"))), lambda x: F.struct(x["open"].alias("open"), x["form"].alias("form")))
    anchors = patterns.groupBy("phrase", "rank", "size").agg(F.min_by(F.struct("open", "form", "place"), telling).alias("a"), whole.alias("parts")).select("phrase", "rank", "size", "parts", "a.*")
    sizes = sorted(r[0] for r in anchors.where("open").select(F.length("form")).distinct().collect())  # as many as words are long
    few = patterns.count() <= SMALL
    forms = lambda w, cut: [F.struct(F.lit(cut).alias("cut"), F.lit(True).alias("open"), F.substring(w, 1, n).alias("form"), (F.length(w) > n).alias("fits")) for n in sizes] + [F.struct(F.lit(cut).alias("cut"), F.lit(False).alias("open"), w.alias("form"), F.lit(True).alias("fits"))]
    rest = F.expr(f"substring(word, {len(lead) + 1})")
    led = lambda w: F.startswith(w, F.lit(lead)) & (F.length(w) > len(lead))
    starts = F.array(*forms(F.col("word"), False))
    if lead:
        starts = F.concat(starts, F.when(led(F.col("word")), F.array(*forms(rest, True))).otherwise(F.filter(starts, lambda s: F.lit(False))))
    # each word goes with those around it, not with its whole text
    reach = (patterns.agg(F.max("size")).first()[0] or 1) - 1
    around = F.transform("w", lambda x, i: F.struct(i.alias("pos"), F.greatest(i - reach, F.lit(0)).alias("first"), x.alias("word"), F.slice("w", F.greatest(i - reach, F.lit(0)) + 1, F.lit(2 * reach + 1)).alias("near")))
    each = words.select(key, F.explode(around).alias("x")).select(key, "x.*")
    keyed = each.select(key, "pos", "first", "near", F.explode(F.filter(starts, lambda s: s["fits"])).alias("s")).select(key, "pos", "first", "near", "s.cut", "s.open", "s.form")
    met = keyed.join(F.broadcast(anchors) if few else anchors, ["open", "form"]).where("not cut or place = 0").withColumn("start", F.col("pos") - F.col("place"))
    # then every word of it must stand where it would
    fits = lambda w, x: F.when(x["open"], F.startswith(w, x["form"]) & (F.length(w) > F.length(x["form"]))).otherwise(w == x["form"])

    def holds(i: int) -> Column:
        w, x = F.get("near", F.col("start") - F.col("first") + i), F.get("parts", F.lit(i))
        good = fits(w, x)
        if lead and i == 0:
            good = good | (led(w) & fits(F.substring(w, F.lit(len(lead) + 1), F.length(w)), x))
        return (F.col("size") <= i) | F.coalesce(good, F.lit(False))

    good = (F.col("start") >= 0) & (F.col("start") - F.col("first") + F.col("size") <= F.size("near"))
    for i in range(reach + 1):
        good = good & holds(i)
    return met.where(good).select(key, "phrase", "rank", "start", (F.col("start") + F.col("size") - 1).alias("end")).distinct()


def tagged(words: DataFrame, key: str, places: DataFrame) -> DataFrame:
    """``words``, whose key is unique, with an array ``tags``: the phrase that holds each word, of several the first by rank."""
    held = places.select(key, "phrase", "rank", F.explode(F.sequence("start", "end")).alias("pos"))
    first = held.groupBy(key, "pos").agg(F.min(F.struct("rank", "phrase")).alias("m"))
    each = first.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "m.phrase"))).alias("t"))
    # places without a phrase are laid between those with one
    gap = lambda x, i: x["pos"] - F.when(i == 0, 0).otherwise(F.get("t", i - 1)["pos"] + 1)
    laid = F.flatten(F.transform("t", lambda x, i: F.concat(F.array_repeat(F.lit(None).cast("string"), gap(x, i)), F.array(x["phrase"]))))
    return words.join(each.select(key, laid.alias("tags")), key, "left")


def tokens(texts: DataFrame, key: str, forms: DataFrame, phrases: DataFrame, lead: str = "") -> DataFrame:
    """(key, pos, raw, root, gloss, phrase): every word with its root by ``forms`` (form, root, gloss; the first of a form by root) and its phrase.

    Texts meet their places whole, so that words leave no task alone unless the forms are too many to go to every task.
    """
    lexicon = forms.groupBy(F.col("form").alias("word")).agg(F.min(F.struct("root", "gloss")).alias("f")).select("word", "f.*")
    places = found(words_in(texts, key), key, phrases, lead)
    held = tagged(texts.select(key, "text"), key, places)
    split = held.select(key, "tags", F.posexplode(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("pos", "raw"))
    words = split.select(key, "pos", "raw", word_of(F.col("raw")).alias("word"), F.get("tags", F.col("pos")).alias("phrase"))
    return words.join(F.broadcast(lexicon) if lexicon.count() <= SMALL else lexicon, "word", "left").select(key, "pos", "raw", "root", "gloss", "phrase")


def studied(tokens_: DataFrame, key: str) -> DataFrame:
    """For each text how many words it has and which roots and phrases are used: each with its number and its first place."""
    used = tokens_.select(key, "pos", F.explode(F.array(F.struct(F.lit("root").alias("kind"), F.col("root").alias("name")), F.struct(F.lit("phrase").alias("kind"), F.col("phrase").alias("name")))).alias("u")).select(key, "pos", "u.*")
    counts = used.where("name is not null").groupBy(key, "kind", "name").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    return counts.withColumn("turn", F.row_number().over(Window.partitionBy(key, "kind").orderBy("first", "name")))

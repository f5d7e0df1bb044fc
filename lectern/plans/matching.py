"""Shingles, alignment and layout."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions.align import apart, chain, costs, first_best, is_abbreviation
from lectern.operators import matching as M
from lectern.registry import query


@query("shingle_overlap", "J16 U9 U10", """
WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS s FROM w WHERE len(w) >= 12),
f AS (SELECT s, min(doc_id) AS first FROM s GROUP BY 1 HAVING count(*) > 1)
SELECT first, doc_id, count(*) AS shared FROM s JOIN f USING (s) WHERE doc_id <> first GROUP BY 1, 2""")
def shingles(t):
    """Documents of any language with runs of twelve words in common, each with the first that has them."""
    return _shared(t("documents"))


def _shared(documents):
    d = documents.select(F.col("doc_id").alias("ref"), F.split("text", " ").alias("words"))
    return M.twins(d, 12).select(F.col("other").alias("first"), F.col("ref").alias("doc_id"), "shared")


@query("guide_share", "J16 J17 A23", """
WITH p AS (SELECT item_id, unnest(list_distinct(list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' ')))) AS s FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark)),
d AS (SELECT DISTINCT unnest(list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' '))) AS s FROM (SELECT string_split(text, ' ') AS w FROM documents))
SELECT item_id, round(count(d.s) / count(*), 6) AS share FROM p LEFT JOIN d ON p.s = d.s GROUP BY 1""")
def guide(t):
    """The share of each item's word pairs that the lines of the documents have."""
    return _share(t("benchmark"), t("documents"))


def _share(items, lines):
    p = items.select("item_id", F.split("text", " ").alias("w")).select("item_id", F.explode(F.array_distinct(M.grams(F.col("w"), 2))).alias("s"))
    d = lines.select(F.split("text", " ").alias("w")).select(F.explode(M.grams(F.col("w"), 2)).alias("s")).distinct().withColumn("hit", F.lit(1))
    return p.join(d, "s", "left").groupBy("item_id").agg(F.round(F.count("hit") / F.count("*"), 6).alias("share"))


@query("letter_stream", "L6", "SELECT conv_id, turn, length(text) AS n, (sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) - length(text))::BIGINT AS start FROM conversations")
def stream(t):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    n = F.length("text").cast("long")
    return t("conversations").select("conv_id", "turn", n.alias("n"), (F.sum(n).over(w) - n).alias("start"))


@query("boxes_united", "M82", "SELECT l_orderkey, min(l_partkey) AS x0, max(l_partkey + l_quantity::BIGINT) AS x1, min(l_suppkey) AS y0, max(l_suppkey) AS y1 FROM lineitem GROUP BY 1")
def boxes(t):
    return t("lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("x0"), F.max(F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("x1"), F.min("l_suppkey").alias("y0"), F.max("l_suppkey").alias("y1"))


@query("aligned_quotes", "L2 L3", None)
def aligned(t):
    """Each whole quote's best place in the whole text of the documents that share a run of four of its words, by semi-global alignment."""
    q = t("benchmark").select("item_id", F.col("text").alias("quote"))
    pairs = M.sharing(q, t("documents").select("doc_id", "text"))

    @F.pandas_udf("struct<cost: double, start: int, end: int, places: int>")
    def place(quote: pd.Series, text: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b in zip(quote, text, strict=True):
            table = costs(a, b)
            rows.append((*first_best(*table), len(apart(*table, 3, 20.0))))
        return pd.DataFrame(rows, columns=["cost", "start", "end", "places"])

    j = pairs.join(q, "item_id").join(t("documents").select("doc_id", "text"), "doc_id")
    return j.select("item_id", "doc_id", place("quote", "text").alias("p")).select("item_id", "doc_id", "p.*")


@query("chained_places", "", None)
def chained(t):
    """Of candidate places of a conversation's lines the chain that costs least and never goes back."""

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["turn", "option"])
        options = [list(zip(g["start"], g["cost"], strict=True)) for _, g in frame.groupby("turn")]
        got = chain(options, 250)
        return pd.DataFrame({"conv_id": frame["conv_id"].iloc[0], "turn": sorted(frame["turn"].unique()), "start": got})

    c = t("conversations").select("conv_id", "turn", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("option"))
    c = c.withColumn("start", F.col("turn") * 100 + (F.col("option") - 1) * 130).withColumn("cost", (F.abs(F.col("option") - 1) + 0.5).cast("double"))
    return c.groupBy("conv_id").applyInPandas(solve, "conv_id long, turn long, start double")


@query("abbreviations", "L12 F22", None)
def abbreviations(t):
    """Whether the first letters of an item's words, and the same with one letter wrong, stand for these words."""
    w = F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda x: x != "")
    groups = t("benchmark").select("item_id", w.alias("w")).select("item_id", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - 4, F.lit(0)))).alias("at"), "w").select("item_id", "at", F.slice("w", F.col("at") + 1, 4).alias("w")).where("size(w) = 4")
    first = lambda n: F.array_join(F.transform("w", lambda x, i: F.when(i == n, "#").otherwise(F.substring(x, 1, 1))), "")
    rows = groups.select("item_id", "at", F.explode(F.array(first(-1), first(2))).alias("short"), F.array_join("w", " ").alias("words"))

    @F.pandas_udf("boolean")
    def test(short: pd.Series, words: pd.Series) -> pd.Series:
        return pd.Series([is_abbreviation(a, b.split()) for a, b in zip(short, words, strict=True)], dtype="bool")

    return rows.select("item_id", "at", "short", test("short", "words").alias("stands"))

"""Full-text search: postings, phrases, BM25, keyword scores, fuzzy names."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import search as S
from lectern.registry import query

# Phrases that the queries look for; words of the corpus.
PHRASES = ["of the", "and the", "the reon"]
_VALUES = ", ".join(f"('{p}')" for p in PHRASES)


@query("bm25_phrase_topk", "F4 F5 R1 R2 R3 R4 O1 F10 S21", f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w, text FROM documents),
l AS (SELECT doc_id, len(w)::DOUBLE AS n, ' ' || array_to_string(w, ' ') || ' ' AS s, text FROM d), a AS (SELECT count(*) AS docs, avg(n) AS mean FROM l),
p(phrase) AS (VALUES {_VALUES}),
f AS (SELECT doc_id, phrase, n, (len(list_filter(range(1, length(s) + 1), lambda i: substr(s, i, length(phrase) + 2) = ' ' || phrase || ' ')))::DOUBLE AS f FROM (SELECT * FROM l WHERE EXISTS (SELECT 1 FROM p WHERE contains(s, ' ' || phrase || ' '))), p WHERE contains(s, ' ' || phrase || ' ')),
i AS (SELECT phrase, greatest(ln((docs - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS idf FROM f, a GROUP BY phrase, docs),
r AS (SELECT doc_id, -sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / mean))) AS score FROM f JOIN i USING (phrase), a GROUP BY 1)
SELECT doc_id, round(score, 6) AS score, substr(text, 1, 60) AS opening FROM (SELECT * FROM r ORDER BY round(score, 9), doc_id LIMIT 20) JOIN documents USING (doc_id)""")
def bm25(t):
    """Phrases ranked by BM25; texts join only for the rows that are left."""
    docs = t("documents").select("doc_id", "text")
    top = S.rank_phrases(docs, PHRASES, 20)
    return top.join(docs, "doc_id").select("doc_id", F.round("score", 6).alias("score"), F.substring("text", 1, 60).alias("opening"))


@query("all_words_by_title", "R5 R6", """
WITH d AS (SELECT doc_id, source, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents)
SELECT source, count(*) AS n, min(doc_id) AS first FROM d WHERE list_contains(w, 'the') AND list_contains(w, 'and') AND list_contains(w, 'by') GROUP BY 1""")
def all_words(t):
    w = S.words(F.col("text"))
    d = t("documents").where(F.forall(F.array(*map(F.lit, ("the", "and", "by"))), lambda x: F.array_contains(w, x)))
    return d.groupBy("source").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@query("query_words", "R6 R9 F9 F6", r"""
SELECT conv_id, turn, array_to_string((list_filter(regexp_split_to_array(regexp_replace(lower('"' || substr(text, 1, 60) || '"* (' || role || ')'), '["*^():{}+\-]', ' ', 'g'), '\s+'), lambda x: length(x) >= 2))[1:8], ' ') AS w FROM conversations""")
def query_words(t):
    """The words of what was typed, which here is how every turn begins."""
    typed = F.concat(F.lit('"'), F.substring("text", 1, 60), F.lit('"* ('), "role", F.lit(")"))
    return t("conversations").select("conv_id", "turn", F.array_join(X.search_words(typed), " ").alias("w"))


@query("keyword_score", "R8 R19 R20", """
WITH s AS (SELECT doc_id, 3 * (source = 'src1')::INT + (contains(lower(text), ' the '))::INT + 2 * (lang = 'en')::INT + 4 * (contains(lower(text), 'of the'))::INT AS score FROM documents)
SELECT doc_id, score FROM s WHERE score >= 2 ORDER BY score DESC, doc_id LIMIT 40""")
def keyword(t):
    text = F.lower("text")
    score = 3 * (F.col("source") == "src1").cast("int") + text.contains(" the ").cast("int") + 2 * (F.col("lang") == "en").cast("int") + 4 * text.contains("of the").cast("int")
    return t("documents").select("doc_id", score.alias("score")).where("score >= 2").orderBy(F.desc("score"), "doc_id").limit(40)


@query("follow_up_kind", "R13 P28", "SELECT conv_id, turn, CASE WHEN length(text) - length(replace(text, ' ', '')) + 1 <= 6 THEN 'short' WHEN regexp_matches(lower(text), '^(and|but|the|of)\\b') THEN 'follow' ELSE 'new' END AS kind FROM conversations WHERE role = 'user'")
def follow_up(t):
    n = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))) + 1
    kind = F.when(n <= 6, "short").when(F.lower("text").rlike(r"^(and|but|the|of)\b"), "follow").otherwise("new")
    return t("conversations").where("role = 'user'").select("conv_id", "turn", kind.alias("kind"))


@query("fuzzy_names", "R16 R20 F26 F28 L13", """
SELECT p_partkey, p_name FROM part WHERE levenshtein(split_part(p_name, ' ', 1), 'part') <= 1 AND abs(length(p_name) - 7) <= 4""")
def fuzzy(t):
    first = F.split_part("p_name", F.lit(" "), F.lit(1))
    return t("part").where((X.edit_distance(first, F.lit("part"), 1) <= 1) & (F.abs(F.length("p_name") - 7) <= 4)).select("p_partkey", "p_name")


@query("book_search", "R16 R17 R18 O8", None)
def book_search(t):
    """Names found however they are spelled: all names of parts, asked for with other vowels, doubled letters and without their last letter."""
    names = t("part").where("p_name is not null").select(F.col("p_name").alias("title")).distinct()
    books = names.select(F.row_number().over(Window.orderBy("title")).alias("ord"), "title")  # as many as there are names
    asked = [F.translate("title", "aeiou", "eaiuo"), F.regexp_replace("title", "([lrn])", "$1$1"), F.expr("substring(title, 1, length(title) - 1)")]
    return S.search_books(books, names.select(F.explode(F.array(*asked)).alias("q")).distinct(), 3)


@query("concordance", "R22", """
WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS w FROM documents)
SELECT w AS form, count(*) AS n, count(DISTINCT doc_id) AS docs FROM w GROUP BY 1""")
def concordance(t):
    w = t("documents").select("doc_id", F.explode(S.words(F.col("text"))).alias("form"))
    return w.groupBy("form").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query("postings_maintained", "R2 T25", """
SELECT count(*) AS n, count(DISTINCT token) AS tokens FROM (SELECT unnest(list_filter(regexp_split_to_array(lower(CASE WHEN doc_id % 10 = 0 THEN 'new text here' ELSE text END), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS token FROM documents)""")
def maintained(t):
    """Postings of changed documents leave by id and come back from the new text."""
    docs = t("documents").select("doc_id", "text")
    changed = docs.where("doc_id % 10 = 0").withColumn("text", F.lit("new text here"))
    return S.update_postings(S.postings(docs), changed).agg(F.count("*").alias("n"), F.countDistinct("token").alias("tokens"))

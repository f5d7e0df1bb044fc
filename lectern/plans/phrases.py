"""Phrases and roots in all documents, by a lexicon made from the benchmark items."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import phrases as P
from lectern.registry import query

_CLEAN = "regexp_replace(lower({0}), '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g')"
# Each item gives phrases: its words 1 to 2, the second by its first two letters, and its words 4 to 6, the last by three.
_SQL = f"""
i AS (SELECT item_id, list_transform(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''), lambda w: {_CLEAN.format("w")}) AS w FROM benchmark),
ph(phrase, rank, m) AS (SELECT 'a' || item_id, item_id * 2, [w[1], w[2][1:2] || '*'] FROM i WHERE len(w) >= 6 UNION ALL SELECT 'b' || item_id, item_id * 2 + 1, [w[4], w[5], w[6][1:3] || '*'] FROM i WHERE len(w) >= 6),
t AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') AS r FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, unnest(range(len(r))) AS pos, unnest(r) AS raw FROM t), x AS (SELECT *, {_CLEAN.format("raw")} AS word FROM w),
y AS (SELECT x.*, lead(word) OVER v AS w2, lead(word, 2) OVER v AS w3 FROM x WINDOW v AS (PARTITION BY doc_id ORDER BY pos)),
s AS (SELECT *, word AS f FROM y UNION ALL SELECT *, word[2:] FROM y WHERE word[1] = 'o' AND length(word) > 1),
hit AS (SELECT DISTINCT doc_id, phrase, rank, pos AS start, pos + len(m) - 1 AS stop FROM s JOIN ph ON s.f = m[1] AND CASE len(m) WHEN 2 THEN starts_with(w2, m[2][:-2]) AND length(w2) > length(m[2]) - 1 ELSE w2 = m[2] AND starts_with(w3, m[3][:-2]) AND length(w3) > length(m[3]) - 1 END)"""


def _phrases(t):
    w = F.transform(F.filter(F.split("text", r"\s+"), lambda x: x != ""), P.word_of)
    i = t("benchmark").select("item_id", w.alias("w")).where(F.size("w") >= 6)
    star = lambda n, k: F.concat(F.substring(F.get("w", F.lit(n)), 1, k), F.lit("*"))
    one = i.select(F.concat(F.lit("a"), "item_id").alias("phrase"), (F.col("item_id") * 2).alias("rank"), F.array(F.get("w", F.lit(0)), star(1, 2)).alias("match"))
    two = i.select(F.concat(F.lit("b"), "item_id").alias("phrase"), (F.col("item_id") * 2 + 1).alias("rank"), F.array(F.get("w", F.lit(3)), F.get("w", F.lit(4)), star(5, 3)).alias("match"))
    return one.unionByName(two)


def _forms(t):
    words = t("benchmark").select(F.explode(F.filter(F.transform(F.split("text", r"\s+"), P.word_of), lambda x: x != "")).alias("form"))
    return words.distinct().select("form", F.substring("form", 1, 4).alias("root"), F.length("form").alias("gloss"))


@query("phrases_found", "R23", f"WITH {_SQL} SELECT doc_id, phrase, start, stop AS \"end\" FROM hit")
def phrases_found(t):
    """Every place of every phrase in all documents, with open forms and a letter that may stand before a phrase."""
    words = P.words_in(t("documents").where("text is not null").select("doc_id", "text"), "doc_id")
    return P.found(words, "doc_id", _phrases(t), "o").select("doc_id", "phrase", "start", "end")


_TOKENS = f"""{_SQL},
fm AS (SELECT DISTINCT f, f[1:4] AS root, length(f) AS gloss FROM (SELECT unnest(w) AS f FROM i) WHERE f <> ''),
tg AS (SELECT x.doc_id, x.pos, raw, root, gloss, (SELECT arg_min(phrase, rank) FROM hit h WHERE h.doc_id = x.doc_id AND x.pos BETWEEN start AND stop) AS phrase FROM x LEFT JOIN fm ON fm.f = x.word)"""


@query("tokens_tagged", "M14 M18", f"WITH {_TOKENS} SELECT doc_id, count(*) AS words, count(root) AS rooted, count(phrase) AS in_phrases, sum(gloss)::BIGINT AS glosses, min(pos) FILTER (phrase IS NOT NULL) AS first_in_phrase FROM tg GROUP BY 1")
def tokens_tagged(t):
    """What the words of each document are tagged with: how many have a root, how many a phrase that holds them, and the first of these."""
    tags = P.tokens(t("documents").where("text is not null").select("doc_id", "text"), "doc_id", _forms(t), _phrases(t), "o")
    return tags.groupBy("doc_id").agg(F.count("*").alias("words"), F.count("root").alias("rooted"), F.count("phrase").alias("in_phrases"), F.sum("gloss").cast("long").alias("glosses"), F.min(F.when(F.col("phrase").isNotNull(), F.col("pos"))).cast("long").alias("first_in_phrase"))


@query("words_studied", "M15", f"WITH {_TOKENS}, u AS (SELECT doc_id, 'root' AS kind, root AS name, pos FROM tg UNION ALL SELECT doc_id, 'phrase', phrase, pos FROM tg), c AS (SELECT doc_id, kind, name, count(*) AS n, min(pos) AS first FROM u WHERE name IS NOT NULL GROUP BY 1, 2, 3) SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY first, name) AS turn FROM c")
def words_studied(t):
    """The roots and phrases that each document uses, in order of their first place."""
    return P.studied(P.tokens(t("documents").where("text is not null").select("doc_id", "text"), "doc_id", _forms(t), _phrases(t), "o"), "doc_id")

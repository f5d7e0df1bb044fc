"""Outlines and checks over the catalogue tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import outline as O
from lectern.registry import query

_CATEGORIES = [("wares", "^(economy|standard)"), ("small", "^small"), ("rest", "ring|gear")]
_STAGES = {"small": [("rings", "ring"), ("bolts", "bolt|nut")], "wares": [("all", ".")]}

_OUTLINE = """
s AS (SELECT 'p' || p_partkey AS section, p_partkey AS seq, p_type || CASE WHEN p_type = 'SMALL' THEN '' ELSE ' / ' || p_brand END || ' / ' || p_name AS label FROM part),
r AS (SELECT section, seq, CASE WHEN regexp_matches(lower(label), '^(economy|standard)') THEN 'wares' WHEN regexp_matches(lower(label), '^small') THEN 'small' WHEN regexp_matches(lower(label), 'ring|gear') THEN 'rest' ELSE 'other' END AS category,
  lower(string_split(label, ' / ')[-1]) AS short, array_to_string(string_split(label, ' / ')[:-2], ' / ') AS head FROM s),
f AS (SELECT *, min(head) OVER w = max(head) OVER w AND count(*) OVER w > 6 AS flat FROM r WINDOW w AS (PARTITION BY category)),
g AS (SELECT *, CASE WHEN flat AND category = 'small' THEN CASE WHEN regexp_matches(short, 'ring') THEN 'rings' WHEN regexp_matches(short, 'bolt|nut') THEN 'bolts' END WHEN flat AND category = 'wares' THEN 'all' END AS stage FROM f),
t AS (SELECT *, coalesce(stage, head) AS title, CASE stage WHEN 'rings' THEN 0 WHEN 'bolts' THEN 1 WHEN 'all' THEN 0 ELSE 1048576 END AS rank FROM g),
n AS (SELECT *, coalesce(lag(title) OVER (PARTITION BY category ORDER BY seq, section) <> title, true)::INT AS fresh FROM t),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY category ORDER BY seq, section ROWS UNBOUNDED PRECEDING) AS island, min(seq) OVER (PARTITION BY category, title) AS first FROM n),
k AS (SELECT *, CASE WHEN flat THEN ROW(rank::BIGINT, first::BIGINT) ELSE ROW(0::BIGINT, island::BIGINT) END AS key FROM i),
o AS (SELECT section, category, title, seq, dense_rank() OVER (PARTITION BY category ORDER BY key) AS group_no FROM k)"""


def _outline(t):
    label = F.concat("p_type", F.when(F.col("p_type") == "SMALL", "").otherwise(F.concat(F.lit(O.PART), "p_brand")), F.lit(O.PART), "p_name")
    return O.outline(t("part").select(F.concat(F.lit("p"), "p_partkey").alias("section"), F.col("p_partkey").alias("seq"), label.alias("label")), _CATEGORIES, _STAGES)


@query("parts_outlined", "M30 M31", f"WITH {_OUTLINE} SELECT section, category, group_no, title, row_number() OVER (PARTITION BY category, group_no ORDER BY seq, section) AS item_no FROM o")
def parts_outlined(t):
    """The parts as an outline: categories by rule, stages where all stand under one heading, else headings as they come."""
    return _outline(t)


@query("rows_checked", "M37 M38 M39 M40 M41 M42", r"""
WITH d AS (SELECT doc_id, lang, source, coalesce(length(text), 0) AS n, text, n_chars FROM documents), t AS (SELECT text FROM d WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
SELECT doc_id, 'short' AS reason FROM d WHERE n < 200 UNION ALL SELECT doc_id, 'language' FROM d WHERE lang IS NULL OR lang NOT IN ('en', 'fr', 'de') UNION ALL SELECT doc_id, 'source name' FROM d WHERE source IS NULL OR NOT regexp_matches(source, '^src[0-9]+$')
UNION ALL SELECT doc_id, 'length' FROM d WHERE n_chars IS NULL OR n_chars <> n UNION ALL SELECT doc_id, 'no label' FROM d WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)
UNION ALL SELECT doc_id, 'text twice' FROM d WHERE text IN (SELECT text FROM t)""")
def rows_checked(t):
    """Every rule that a document breaks: its own fields, what it refers to, and what may not come twice."""
    n = F.coalesce(F.length("text"), F.lit(0))
    rules = [("short", n >= 200), ("language", F.col("lang").isin("en", "fr", "de")), ("source name", F.col("source").rlike("^src[0-9]+$")), ("length", F.col("n_chars") == n)]
    # a text is told from others by its digest, so that no text is shuffled
    docs = t("documents").select("doc_id", "lang", "source", "n_chars", "text", F.sha2("text", 256).alias("digest"))
    checked = O.failing(docs, "doc_id", rules, [("no label", "doc_id", t("labels").select("doc_id"))], ["digest"])
    return checked.withColumn("reason", F.when(F.col("reason") == "digest twice", "text twice").otherwise(F.col("reason")))


@query("nested_offsets", "N3", """
SELECT p_partkey, CASE p_partkey % 4 WHEN 1 THEN CASE p_partkey % 3 WHEN 0 THEN p_size WHEN 1 THEN p_size + 1 ELSE 0 END WHEN 2 THEN CASE WHEN p_partkey % 3 = 0 THEN p_size + 2 + p_partkey % 2 WHEN p_partkey % 3 = 1 AND p_partkey % 2 = 0 THEN p_size + 4 ELSE 0 END ELSE 0 END AS place FROM part""")
def nested_offsets(t):
    """Offsets of places at four depths; two of these have none, and some parents lie outside of the lists."""
    from lectern.functions.refs import offset_for

    n = F.col("p_partkey")
    offsets = F.expr("concat('{\"2\": [', p_size, ', ', p_size + 1, '], \"3\": [[', p_size + 2, ', ', p_size + 3, '], [', p_size + 4, ']]}')")
    parents = F.when(n % 4 == 0, F.array().cast("array<bigint>")).when(n % 4 == 1, F.array(n % 3)).otherwise(F.array(n % 3, n % 2))
    return t("part").select("p_partkey", offset_for(offsets, n % 4 + 1, parents).alias("place"))

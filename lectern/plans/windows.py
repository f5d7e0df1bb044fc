"""Ranking, running totals, islands, spans, ordering and limits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import refs as R
from lectern.operators import links as K
from lectern.operators import matching as M
from lectern.operators import packing
from lectern.operators.sequence import running_number
from lectern.plans.views import TALKS, talks
from lectern.registry import query


@query("running_sequence", "W3", "SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS seq FROM orders")
def running(t):
    """A number over all rows in order, without one task that sorts them all."""
    return running_number(t("orders").select("o_custkey", "o_orderkey"), ["o_custkey", "o_orderkey"], "seq").select("o_orderkey", "seq")


_BEST = "SELECT 'Order ' || (l_orderkey % 500) AS anchor, 'Part ' || (l_partkey % 700) || ' ' || (l_suppkey % 9) AS other, l_orderkey * 10 + l_linenumber AS seen FROM lineitem"


@query("fair_interleave", "W5 R15 R14 M6 O4", f"""
WITH a(anchor, anchor_index) AS (VALUES ('Order 1', 0), ('Order 2', 1), ('Order 3', 2)), p AS ({_BEST}),
k AS (SELECT other, CASE WHEN starts_with(other, 'Part 1') THEN 0 WHEN starts_with(other, 'Part 2') THEN 2 ELSE 5 END AS tier, anchor_index, min(seen) AS seen FROM p JOIN a USING (anchor) GROUP BY 1, 2, 3),
b AS (SELECT other, min(ROW(tier, anchor_index, seen)) AS m FROM k GROUP BY 1),
c AS (SELECT other, m[1] AS tier, m[2] AS anchor_index, m[3] AS seen, regexp_replace(other, ' [0-9]+$', '') AS book, CAST(regexp_extract(other, '([0-9]+)$', 1) AS BIGINT) AS place FROM b),
d AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY tier, anchor_index, place, seen) - 1 AS round FROM c),
s AS (SELECT *, ([0, 1, 2, 4, 6, 8, 20])[tier + 1] + round * ([2, 3, 3, 5, 6, 8, 10])[tier + 1] AS score FROM d)
SELECT other, tier, score FROM s ORDER BY score, tier, anchor_index, seen, place LIMIT 25""")
def fair(t):
    """Books take turns: the score of a line grows with its place among its book's lines."""
    li = t("lineitem")
    pairs = li.select(F.concat(F.lit("Order "), F.col("l_orderkey") % 500).alias("anchor"), F.concat(F.lit("Part "), F.col("l_partkey") % 700, F.lit(" "), F.col("l_suppkey") % 9).alias("other"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seen"))
    anchors = t.values([("Order 1", 0), ("Order 2", 1), ("Order 3", 2)], "anchor string, anchor_index int")
    tier = F.when(F.col("other").startswith("Part 1"), 0).when(F.col("other").startswith("Part 2"), 2).otherwise(5)
    return K.order_linked(pairs, anchors, tier, F.lit(0), 25)


@query("interleave_lists", "W7", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) ORDER BY r, source LIMIT 30")
def interleave(t):
    r = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    return t("documents").select("source", "doc_id", r.alias("r")).where("r <= 30").orderBy("r", "source").limit(30).select("source", "doc_id")


@query("keep_newest_per_class", "W11", "SELECT o_orderkey FROM (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE n <= 5 OR o_orderstatus = 'P'")
def keep_newest(t):
    n = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy(F.desc("o_orderdate"), "o_orderkey"))
    return t("orders").withColumn("n", n).where("n <= 5 or o_orderstatus = 'P'").select("o_orderkey")


@query("byte_budget_cut", "W12 O12", "SELECT doc_id FROM (SELECT doc_id, sum(strlen(text)) OVER (PARTITION BY source ORDER BY doc_id DESC) AS held, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS n FROM documents) WHERE held <= 20000 AND n <= 12")
def budget(t):
    w = Window.partitionBy("source").orderBy(F.desc("doc_id"))
    newest = t("documents").select("source", "doc_id", F.octet_length("text").alias("bytes")).withColumn("n", F.row_number().over(w)).where("n <= 12")
    return newest.withColumn("held", F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("held <= 20000").select("doc_id")


@query("spans_to_next_heading", "W15 M27 M28", """
WITH h AS (SELECT conv_id, turn, role = 'user' AS head FROM conversations)
SELECT conv_id, turn, coalesce(min(CASE WHEN head THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), -1) AS stop FROM h""")
def spans(t):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(1, Window.unboundedFollowing)
    return t("conversations").select("conv_id", "turn", F.coalesce(F.min(F.when(F.col("role") == "user", F.col("turn"))).over(w), F.lit(-1)).alias("stop"))


@query("merged_spans", "W17", """
WITH s AS (SELECT l_suppkey, l_partkey % 400 AS lo, l_partkey % 400 + CAST(l_quantity AS BIGINT) % 4 AS hi FROM lineitem),
m AS (SELECT *, CASE WHEN lo > max(hi) OVER (PARTITION BY l_suppkey ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM s),
g AS (SELECT *, sum(new) OVER (PARTITION BY l_suppkey ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS grp FROM m)
SELECT l_suppkey, min(lo) AS lo, max(hi) AS hi FROM g GROUP BY l_suppkey, grp""")
def merged(t):
    return _merged(t("lineitem"))


def _merged(lines):
    s = lines.select("l_suppkey", (F.col("l_partkey") % 400).alias("lo"), (F.col("l_partkey") % 400 + F.col("l_quantity").cast("long") % 4).alias("hi"))
    return M.merge_spans(s, ["l_suppkey"])


@query("consecutive_runs", "W18 M81", "SELECT l_suppkey, min(n) AS start, max(n) AS \"end\" FROM (SELECT l_suppkey, n, n - row_number() OVER (PARTITION BY l_suppkey ORDER BY n) AS g FROM (SELECT DISTINCT l_suppkey, l_partkey % 300 AS n FROM lineitem)) GROUP BY l_suppkey, g")
def runs(t):
    return M.runs_of(t("lineitem").select("l_suppkey", (F.col("l_partkey") % 300).alias("n")), ["l_suppkey"], "n")


@query("forward_asof", "W20", """
WITH s AS (SELECT conv_id, turn FROM conversations WHERE turn % 3 = 0), q AS (SELECT conv_id, turn FROM conversations)
SELECT q.conv_id, q.turn, coalesce(min(s.turn) FILTER (s.turn >= q.turn), max(s.turn)) AS step FROM q JOIN s USING (conv_id) GROUP BY 1, 2""")
def asof(t):
    """The first step at or after a place, else the last; a window over the merged rows, no pairing."""
    c = t("conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, F.col("turn")).alias("s"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    nxt = F.min("s").over(w.rangeBetween(0, Window.unboundedFollowing))
    last = F.max("s").over(Window.partitionBy("conv_id"))
    return c.select("conv_id", "turn", F.coalesce(nxt, last).alias("step")).where("step is not null").distinct()


@query("short_gaps_filled", "W19", """
WITH c AS (SELECT conv_id, turn, CASE WHEN length(text) > 300 THEN turn END AS line, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
n AS (SELECT *, last_value(CASE WHEN line IS NOT NULL THEN i END IGNORE NULLS) OVER b AS p, first_value(CASE WHEN line IS NOT NULL THEN i END IGNORE NULLS) OVER f AS q, last_value(line IGNORE NULLS) OVER b AS before, first_value(line IGNORE NULLS) OVER f AS after FROM c
  WINDOW b AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT conv_id, turn, coalesce(line, CASE WHEN q - p - 1 <= 6 THEN CASE WHEN i - p <= q - i THEN before ELSE after END END) AS line, line IS NULL AS guessed FROM n""")
def gaps(t):
    """Runs of at most six empty rows take the value on both sides when they agree, else the nearer one's."""
    from lectern.operators.sequence import fill_gaps

    c = t("conversations").select("conv_id", "turn", F.when(F.length("text") > 300, F.col("turn")).alias("line"))
    return fill_gaps(c, "conv_id", "turn", "line", 6)


@query("packs_of_words", "W13 M21 M23", """
WITH RECURSIVE d AS (SELECT source, doc_id AS seq, len(string_split(text, ' '))::BIGINT AS words, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents WHERE source IS NOT NULL AND text IS NOT NULL),
r AS (SELECT source, seq, words, i, words AS held, 0 AS pack FROM d WHERE i = 1
  UNION ALL SELECT d.source, d.seq, d.words, d.i, CASE WHEN r.held > 0 AND r.held + d.words > 2000 THEN d.words ELSE r.held + d.words END, r.pack + (r.held > 0 AND r.held + d.words > 2000)::INT FROM r JOIN d ON d.source = r.source AND d.i = r.i + 1)
SELECT source, seq, words, pack FROM r""")
def packs(t):
    from lectern.operators.packing import pack

    d = t("documents").where("source is not null and text is not null").select("source", F.col("doc_id").alias("seq"), F.size(F.split("text", " ")).cast("long").alias("words"))
    return pack(d, "source", 2000)


@query("merged_orders", "W9", None)
def orders(t):
    """Each conversation's lines in two editions, merged into one order."""

    @F.pandas_udf("array<string>")
    def merge(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([packing.merge_orders([[] if x is None else list(x) for x in pair]) for pair in zip(a, b, strict=True)])

    c = talks(t).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.when(F.col("turn") % 2 == 0, F.col("ref")))).alias("a"), F.sort_array(F.collect_list(F.when(F.col("turn") % 3 != 1, F.col("ref")))).alias("b"))
    return c.select("conv_id", F.array_join(merge("a", "b"), "|").alias("refs"))


@query("newest_with_offset", "O2", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC LIMIT 20 OFFSET 40")
def newest(t):
    return t("orders").select("o_orderkey", "o_orderdate").orderBy(F.desc_nulls_last("o_orderdate"), F.desc("o_orderkey")).offset(40).limit(20)


@query("title_then_body", "O3", """
WITH a AS (SELECT DISTINCT source, 0 AS tier FROM documents WHERE contains(source, '1')), b AS (SELECT DISTINCT source, 1 AS tier FROM documents WHERE contains(lower(text), 'stupid'))
SELECT source, min(tier) AS tier FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1 ORDER BY 2, 1 LIMIT 15""")
def title_then_body(t):
    d = t("documents")
    a = d.where(F.col("source").contains("1")).select("source", F.lit(0).alias("tier"))
    b = d.where(F.lower("text").contains("stupid")).select("source", F.lit(1).alias("tier"))
    return a.unionByName(b).groupBy("source").agg(F.min("tier").alias("tier")).orderBy("tier", "source").limit(15)


@query("places_in_order", "O4 O5", f"SELECT ref, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM {TALKS}")
def places(t):
    """'Conv 1:2' before 'Conv 1:10': numbers compare as numbers."""
    key = R.place_key(R.place_of(F.col("ref")))
    return talks(t).select("ref", F.row_number().over(Window.partitionBy("conv_id").orderBy(key)).alias("n"))


@query("ranked_by_rules", "O9 O14 O8", "SELECT p_partkey FROM part ORDER BY CASE WHEN regexp_matches(p_type, '^S') THEN 0 WHEN regexp_matches(p_type, '^P') THEN 1 ELSE 2 END, p_name, p_partkey LIMIT 25")
def ranked(t):
    rank = F.when(F.col("p_type").rlike("^S"), 0).when(F.col("p_type").rlike("^P"), 1).otherwise(2)
    return t("part").orderBy(rank, "p_name", "p_partkey").limit(25).select("p_partkey")


@query("city_search", "O15 M85", "SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '12') ORDER BY CASE WHEN starts_with(lower(c_name), '12') THEN 0 WHEN regexp_matches(lower(c_name), '[ #]0*12') THEN 1 ELSE 2 END, c_name LIMIT 10")
def city(t):
    n = F.lower("c_name")
    rank = F.when(n.startswith("12"), 0).when(n.rlike("[ #]0*12"), 1).otherwise(2)
    return t("customer").where(n.contains("12")).orderBy(rank, "c_name").limit(10).select("c_custkey", "c_name")


@query("messages_fit", "O13 N7", "SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS held FROM conversations) WHERE held <= 900")
def fit(t):
    """The newest messages that fit a budget of bytes."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    return t("conversations").withColumn("held", F.sum(F.octet_length("text")).over(w)).where("held <= 900").select("conv_id", "turn")

"""Aggregations, and the set operations that go with them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import links as K
from lectern.plans.views import TALKS, passages, talks
from lectern.registry import query
from lectern.sources.files import parts_for


@query("contents_sections", "A1 F12 W8", f"SELECT regexp_replace(rtrim(rtrim(ref, '0123456789'), ':'), '', '') AS section, role, min(seq) AS first FROM {TALKS} GROUP BY 1, 2")
def contents(t):
    return talks(t).groupBy(F.rtrim(F.rtrim("ref", F.lit("0123456789")), F.lit(":")).alias("section"), "role").agg(F.min("seq").alias("first"))


@query("word_totals", "A2 A25", "SELECT lang, count(*) AS n, coalesce(sum(length(text) - length(replace(text, ' ', '')) + 1), 0)::BIGINT AS words, coalesce(sum(length(text)), 0)::BIGINT AS chars FROM documents GROUP BY 1")
def word_totals(t):
    words = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))) + 1
    return t("documents").groupBy("lang").agg(F.count("*").alias("n"), F.coalesce(F.sum(words), F.lit(0)).alias("words"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))


@query("pending_keyset", "A3 O11 R6", "SELECT source, min(doc_id) AS s FROM documents d WHERE lang = 'en' AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) GROUP BY 1 HAVING min(doc_id) > 3 ORDER BY s LIMIT 12")
def pending(t):
    d = t("documents").where("lang = 'en'").select("doc_id", "source").join(t("labels").select("doc_id"), "doc_id", "left_anti")
    return d.groupBy("source").agg(F.min("doc_id").alias("s")).where("s > 3").orderBy("s").limit(12)


@query("titles_of_work", "A5 N9 A30", "SELECT lang, string_agg(source, ', ' ORDER BY source) AS titles, count(*) AS n, sum(size)::BIGINT AS size FROM (SELECT lang, source, sum(n_chars) AS size FROM documents GROUP BY 1, 2) GROUP BY 1")
def titles_of_work(t):
    own = t("documents").groupBy("lang", "source").agg(F.sum("n_chars").alias("size"))
    return own.groupBy("lang").agg(F.array_join(F.array_sort(F.collect_list("source")), ", ").alias("titles"), F.count("*").alias("n"), F.sum("size").alias("size"))


@query("first_row_wins", "A6 W1 W2 U10", """
SELECT l_orderkey, l_linenumber, arg_min(l_partkey, ROW(l_shipdate, l_partkey, l_suppkey)) FILTER (l_returnflag = 'N') AS n_part, arg_min(l_partkey, ROW(l_shipdate, l_partkey, l_suppkey)) FILTER (l_returnflag <> 'N') AS other_part, count(DISTINCT l_returnflag) AS flags FROM lineitem GROUP BY 1, 2""")
def first_wins(t):
    """The first row of each key and side by a full order, both sides pivoted into one row."""
    order = F.struct("l_shipdate", "l_partkey", "l_suppkey")
    pick = lambda cond: F.min(F.when(cond, F.struct(order.alias("o"), F.col("l_partkey").alias("p"))))["p"]
    n = F.col("l_returnflag") == "N"
    return t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(pick(n).alias("n_part"), pick(~n).alias("other_part"), F.size(F.collect_set("l_returnflag")).cast("long").alias("flags"))


@query("section_summaries", "A7 O5", f"SELECT regexp_replace(ref, ':[^:]*$', '') AS section, count(*) AS lines, count(*) FILTER (role <> 'user') AS said, arg_min(ref, seq) AS first FROM {TALKS} GROUP BY 1")
def summaries(t):
    return talks(t).groupBy(F.regexp_replace("ref", ":[^:]*$", "").alias("section")).agg(F.count("*").alias("lines"), F.count_if(F.col("role") != "user").alias("said"), F.min_by("ref", "seq").alias("first"))


@query("nested_counts", "A8 A9 A10 A22", """
SELECT c_mktsegment, count(*) AS n, count(*) FILTER (k > 0) AS any_open, count(*) FILTER (k = m) AS all_open, sum(m)::BIGINT AS orders FROM (SELECT c_mktsegment, c_custkey, count(o_orderkey) AS m, count(*) FILTER (o_orderstatus = 'O') AS k FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2) GROUP BY 1""")
def nested(t):
    own = t("customer").join(t("orders"), F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_mktsegment", "c_custkey").agg(F.count("o_orderkey").alias("m"), F.count_if(F.col("o_orderstatus") == "O").alias("k"))
    return own.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.count_if(F.col("k") > 0).alias("any_open"), F.count_if(F.col("k") == F.col("m")).alias("all_open"), F.sum("m").alias("orders"))


@query("feedback_report", "A11 M65 N11", "SELECT d.source, count(*) AS n, round(100.0 * avg(l.quality), 4) AS helpful, count(*) FILTER (l.toxic = 1) AS toxic FROM labels l JOIN documents d USING (doc_id) GROUP BY 1 HAVING count(*) FILTER (l.quality = 0) > 1 ORDER BY n DESC, source LIMIT 20")
def feedback(t):
    j = t("labels").join(t("documents").select("doc_id", "source"), "doc_id")
    own = j.groupBy("source").agg(F.count("*").alias("n"), F.round(100 * F.avg("quality"), 4).alias("helpful"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("quality") == 0).alias("bad"))
    return own.where("bad > 1").orderBy(F.desc("n"), "source").limit(20).drop("bad")


_PATH = "regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1)"


@query("page_counts_by_path", "A12 A14 F54 S15", f"SELECT array_to_string(list_filter(string_split({_PATH}, '/'), lambda x: x <> '')[1:1], '/') AS section, count(*) AS n FROM pages GROUP BY 1")
def by_path(t):
    return t("pages").groupBy(X.url_section(F.col("url"), 1).alias("section")).agg(F.count("*").alias("n"))


@query("word_frequency", "A15 R21", "SELECT word, count(*) AS df FROM (SELECT DISTINCT doc_id, lower(w) AS word FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents)) WHERE length(word) >= 4 GROUP BY 1 HAVING count(*) >= 20")
def word_frequency(t):
    words = t("documents").select(F.explode(F.array_distinct(F.transform(F.split("text", " "), lambda w: F.lower(w)))).alias("word"))
    return words.where("length(word) >= 4").groupBy("word").agg(F.count("*").alias("df")).where("df >= 20")


@query("mergeable_counts", "A16 A17 A18 T9 M59", """
WITH e AS (SELECT user_id, event_type, user_id % 2 AS device, count(*) AS n, max(ts) AS last, arg_max(event_id, ROW(ts, event_id)) AS detail FROM events GROUP BY 1, 2, 3)
SELECT user_id, event_type, sum(n)::BIGINT AS joined, max(n) AS synced, max(last) AS last, arg_max(detail, ROW(last, detail)) AS detail FROM e WHERE last >= TIMESTAMP '2024-01-05' GROUP BY 1, 2""")
def mergeable(t):
    """Counters that add when accounts join and take the greater when copies sync; what is older than the mark is gone."""
    part = t("events").groupBy("user_id", "event_type", (F.col("user_id") % 2).alias("device")).agg(F.count("*").alias("n"), F.max("ts").alias("last"), F.max_by("event_id", F.struct("ts", "event_id")).alias("detail"))
    kept = part.where(F.col("last") >= F.lit("2024-01-05").cast("timestamp_ntz"))
    return kept.groupBy("user_id", "event_type").agg(F.sum("n").alias("joined"), F.max("n").alias("synced"), F.max("last").alias("last"), F.max_by("detail", F.struct("last", "detail")).alias("detail"))


@query("session_counts", "A19 T2", """
SELECT user_id, sum(new)::BIGINT AS sessions FROM (SELECT user_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events) GROUP BY 1""")
def sessions(t):
    """A gap of exactly two hours starts a session, unlike session_window."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.when(F.col("ts") - F.lag("ts").over(w) < F.expr("INTERVAL 2 HOURS"), 0).otherwise(1)
    return t("events").withColumn("new", new).groupBy("user_id").agg(F.sum("new").alias("sessions"))


@query("usage_cost", "A20 A21", "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity * 3 + l_extendedprice * 15) / 1e6, 6) AS dollars FROM lineitem GROUP BY 1")
def usage(t):
    return t("lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_quantity") * 3 + F.col("l_extendedprice") * 15) / 1e6, 6).alias("dollars"))


@query("coverage_ratio", "A23 L20", "SELECT source, round(coalesce(sum(CASE WHEN l.doc_id IS NOT NULL THEN n_chars END) / sum(n_chars), 0), 6) AS covered FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def coverage(t):
    j = t("documents").select("doc_id", "source", "n_chars").join(t("labels").select("doc_id", F.lit(1).alias("hit")), "doc_id", "left")
    return j.groupBy("source").agg(F.round(F.coalesce(F.sum(F.when(F.col("hit") == 1, F.col("n_chars"))) / F.sum("n_chars"), F.lit(0.0)), 6).alias("covered"))


@query("by_category_blank_last", "A26 A27 M7", """
SELECT coalesce(nullif(p_brand, 'Brand#1'), '') AS category, count(*) AS n, arg_min(p_name, p_partkey) AS first FROM part GROUP BY 1""")
def by_category(t):
    return t("part").groupBy(F.coalesce(F.nullif(F.col("p_brand"), F.lit("Brand#1")), F.lit("")).alias("category")).agg(F.count("*").alias("n"), F.min_by("p_name", "p_partkey").alias("first"))


@query("best_claim", "A28 W6", "SELECT l_partkey, arg_max(l_orderkey, ROW(l_quantity, l_discount, l_orderkey)) AS best FROM lineitem GROUP BY 1")
def best_claim(t):
    return t("lineitem").groupBy("l_partkey").agg(F.max_by("l_orderkey", F.struct("l_quantity", "l_discount", "l_orderkey")).alias("best"))


@query("shelves_groups", "A29 M8 M30 M47", """
SELECT p_brand, p_size, n, CASE WHEN n = 1 THEN '' ELSE 'set' END AS kind, sum(n) OVER (PARTITION BY p_brand)::BIGINT AS shelf FROM (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY 1, 2)""")
def shelves(t):
    """Two levels of groups; a set of one is dissolved."""
    own = t("part").groupBy("p_brand", "p_size").agg(F.count("*").alias("n"))
    return own.select("p_brand", "p_size", "n", F.when(F.col("n") == 1, "").otherwise("set").alias("kind"), F.sum("n").over(Window.partitionBy("p_brand")).alias("shelf"))


@query("pair_dedupe", "U4 U5", "SELECT l_orderkey, l_partkey, arg_min(l_returnflag, ROW(l_linenumber, l_suppkey, l_shipdate)) AS kind FROM lineitem GROUP BY 1, 2")
def pair_dedupe(t):
    return t("lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min_by("l_returnflag", F.struct("l_linenumber", "l_suppkey", "l_shipdate")).alias("kind"))


@query("url_owner", "U6 U8 M67", f"""
SELECT regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\\.', '') || regexp_replace({_PATH}, '/+$', '') || regexp_extract(url, '(\\?[^#]*)', 1) AS key, max(page_id) AS owner, count(*) AS n FROM pages GROUP BY 1""")
def url_owner(t):
    return t("pages").groupBy(X.page_key(F.col("url")).alias("key")).agg(F.max("page_id").alias("owner"), F.count("*").alias("n"))


@query("exact_duplicates", "F37 T11", "SELECT substr(sha256(text), 1, 32) AS sum, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicates(t):
    return t("documents").groupBy(X.checksum(F.array("text")).alias("sum")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


@query("prune_guarded", "U11 T12", """
WITH gone AS (SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)), n AS (SELECT count(*) AS g, (SELECT count(*) FROM customer) AS a FROM gone)
SELECT c_custkey FROM gone, n WHERE g <= greatest(25, a * 0.5)""")
def prune(t):
    from lectern.operators.state import prune

    return prune(t("customer").select("c_custkey"), t("orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"], 25, 0.5)


@query("last_writer_wins", "U12 T5 T7 T26 M61", "SELECT user_id, event_type, max(ts) AS stamp, arg_max(value, ROW(ts, event_id)) AS value FROM events GROUP BY 1, 2")
def last_writer(t):
    return t("events").groupBy("user_id", "event_type").agg(F.max("ts").alias("stamp"), F.max_by("value", F.struct("ts", "event_id")).alias("value"))


@query("federated_by_owner", "U13", "SELECT CASE WHEN source IN ('src1', 'src2') THEN 'site' ELSE 'library' END AS collection, count(*) AS n FROM documents GROUP BY 1")
def federated(t):
    d = t("documents")
    site, main = d.where(F.col("source").isin("src1", "src2")).withColumn("collection", F.lit("site")), d.where(~F.col("source").isin("src1", "src2")).withColumn("collection", F.lit("library"))
    return main.unionByName(site, allowMissingColumns=True).groupBy("collection").agg(F.count("*").alias("n"))


@query("citations_once", "U15", "SELECT l_orderkey AS block, l_partkey AS ref, min(l_linenumber) AS pos, bool_or(first) AS first_anywhere FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) = 1 AS first FROM lineitem) GROUP BY 1, 2")
def citations(t):
    lines = t("lineitem").select("l_partkey", "l_orderkey", "l_linenumber")
    # dealt out once, by what is cited, to as many tasks as rows need
    dealt = lines.repartition(parts_for(lines.sparkSession, lines.count(), 500_000), "l_partkey")
    first = F.row_number().over(Window.partitionBy("l_partkey").orderBy(F.asc_nulls_last("l_orderkey"), F.asc_nulls_last("l_linenumber"))) == 1
    return dealt.withColumn("first", first).groupBy(F.col("l_orderkey").alias("block"), F.col("l_partkey").alias("ref")).agg(F.min("l_linenumber").alias("pos"), F.bool_or("first").alias("first_anywhere"))


@query("title_uniquifier", "U7", "SELECT p_partkey, p_brand || CASE WHEN n = 1 THEN '' ELSE ' (' || n || ')' END AS title FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part)")
def uniquifier(t):
    n = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    return t("part").withColumn("n", n).select("p_partkey", F.concat("p_brand", F.when(F.col("n") == 1, "").otherwise(F.concat(F.lit(" ("), F.col("n"), F.lit(")")))).alias("title"))


@query("sample_per_section", "A13", None)
def sample(t):
    """k urls of each section, the smallest hashes: a sample that does not depend on order or partitioning."""
    p = t("pages").select("url", X.url_section(F.col("url"), 1).alias("section")).withColumn("h", F.xxhash64("url"))
    return K.capped(p, ["section"], ["h", "url"], 3).select("section", "url")


@query("balanced_shards", "A24", None)
def shards(t):
    """Longest first to the least loaded shard: a loop over one row for each title."""
    from lectern.operators.packing import balance

    return balance(passages(t).groupBy("title").agg(F.count("*").alias("n")), 4)



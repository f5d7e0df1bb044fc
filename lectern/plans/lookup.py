"""Scans, filters and reference lookup."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import refs as R
from lectern.functions import text as X
from lectern.operators import lookup as L
from lectern.plans.views import PASSAGES, passages, talks
from lectern.registry import query


@query("rows_projected", "P1 J1 S7", """
SELECT o.o_orderkey, c.c_name, n.n_name, r.r_name, coalesce(o.o_orderpriority, 'none') AS standing, '' AS caution
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey""")
def rows_projected(t):
    """Five-way projection where a column that this schema lacks becomes a literal."""
    o, c, n, r = t("orders"), t("customer"), t("nation"), t("region")
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    caution = F.col("caution") if "caution" in joined.columns else F.lit("")
    return joined.select("o_orderkey", "c_name", "n_name", "r_name", F.coalesce("o_orderpriority", F.lit("none")).alias("standing"), caution.alias("caution"))


@query("rows_where_limit", "P2 O7", f"SELECT id, ref, seq FROM {PASSAGES} WHERE lang = 'en' ORDER BY seq LIMIT 40")
def rows_where(t):
    return passages(t).where("lang = 'en'").orderBy("seq").limit(40).select("id", "ref", "seq")


@query("rows_by_exact_ref", "P3 P9 S27", f"SELECT id, ref FROM {PASSAGES} WHERE ref IN ('src1 0:1', 'src2 0:2', 'src9 0:9', 'nothing 1:1')")
def exact_refs(t):
    asked = t.values([("src1 0:1",), ("src2 0:2",), ("src9 0:9",), ("src2 0:2",), ("nothing 1:1",)], "ref string").distinct()
    return passages(t).join(F.broadcast(asked), "ref", "left_semi").select("id", "ref")


@query("rows_by_prefix", "P4", f"SELECT id, ref FROM {PASSAGES} WHERE ref >= 'src1 ' AND ref < 'src1!'")
def by_prefix(t):
    return passages(t).where(F.col("title").startswith("src1") & F.col("ref").startswith("src1 ")).select("id", "ref")


@query("lookup_refs", "P5 P6 P7 F13", f"""
WITH p AS {PASSAGES}
SELECT 0 AS pos, id, ref FROM p WHERE ref = 'src1 0:1'
UNION ALL SELECT 1, id, ref FROM p WHERE title = 'src2' AND regexp_replace(ref, ':[^:]*$', '') = 'src2 0' AND seq >= (SELECT min(seq) FROM p WHERE ref = 'src2 0:2') AND seq <= coalesce((SELECT min(seq) FROM p WHERE ref = 'src2 0:62'), 999999999) AND EXISTS (SELECT 1 FROM p WHERE ref = 'src2 0:2')
UNION ALL SELECT 2, id, ref FROM p WHERE title = 'src5'
UNION ALL SELECT 3, id, ref FROM p WHERE regexp_replace(ref, ':[^:]*$', '') = 'src7 0'""")
def lookup_refs(t):
    asked = t.values([(0, "src1 0:1"), (1, "src2  0:2–62"), (2, "src5"), (3, " src7 0 "), (4, "absent 3")], "pos int, ref string")
    return L.resolve(passages(t), asked).select("pos", "id", "ref")


@query("lookup_refs_capped", "P7 P8 O6", f"""
WITH p AS {PASSAGES}, a AS (SELECT 0 AS pos, 'src1' AS title UNION ALL SELECT 1, 'src4'),
m AS (SELECT pos, ref, min(seq) AS s0 FROM p JOIN a USING (title) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY s0, ref) AS n FROM m)
SELECT r.pos, p.id, p.ref FROM r JOIN p USING (ref) WHERE n <= 5""")
def lookup_capped(t):
    asked = t.values([(0, "src1"), (1, "src4")], "pos int, ref string")
    return L.resolve(passages(t), asked, per_ref=5).select("pos", "id", "ref")


@query("side_table_by_ref", "P10 P11", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.lang = 'fr'")
def side_table(t):
    return t("documents").where("lang = 'fr'").select("doc_id").join(t("labels").select("doc_id", "quality"), "doc_id", "left")


@query("json_document_by_key", "P11 N5 F56", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events WHERE event_type = 'purchase'")
def json_document(t):
    return t("events").where("event_type = 'purchase'").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("books_for", "P12", """
SELECT p_partkey, p_name FROM part WHERE (p_partkey IN (1, 5, 9) OR p_brand IN ('Brand#11', 'Brand#3') OR translate(p_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%1%') AND p_name NOT LIKE '%9%'""")
def books_for(t):
    """LIKE that folds ASCII letters alone, as the store does."""
    name = F.translate("p_name", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return t("part").where((F.col("p_partkey").isin(1, 5, 9) | F.col("p_brand").isin("Brand#11", "Brand#3") | name.like("%1%")) & ~F.col("p_name").like("%9%")).select("p_partkey", "p_name")


@query("page_of_three_titles", "P13", f"""
SELECT title, count(*) AS lines, min(ref) AS first FROM {PASSAGES} WHERE title IN ('src1', 'src2', 'src3') AND (ref LIKE 'src1 0:%' OR ref LIKE 'src2 0:%' OR ref LIKE 'src3 0:%') GROUP BY 1""")
def three_titles(t):
    p = passages(t).where(F.col("title").isin("src1", "src2", "src3"))
    return p.where(R.section_of(F.col("ref")) == F.concat("title", F.lit(" 0"))).groupBy("title").agg(F.count("*").alias("lines"), F.min("ref").alias("first"))


@query("headings_short", "P14", "SELECT conv_id, max(CASE WHEN role = 'user' THEN text END) AS asked, max(CASE WHEN role <> 'user' THEN text END) AS said FROM conversations WHERE length(text) <= 160 GROUP BY 1")
def headings(t):
    c = t("conversations").where("length(text) <= 160")
    return c.groupBy("conv_id").agg(F.max(F.when(F.col("role") == "user", F.col("text"))).alias("asked"), F.max(F.when(F.col("role") != "user", F.col("text"))).alias("said"))


@query("whitelist_all_open", "P15 P16 P18", """
SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING bool_and(o_orderstatus IN ('O', 'P')) AND bool_or(o_orderpriority = '1-URGENT')""")
def whitelist(t):
    """All editions open and one of them approved: quantifiers over the nested list."""
    nested = t("orders").groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderstatus", "o_orderpriority")).alias("editions"))
    return nested.where(F.forall("editions", lambda e: e["o_orderstatus"].isin("O", "P")) & F.exists("editions", lambda e: e["o_orderpriority"] == "1-URGENT")).select("o_custkey", F.size("editions").cast("long").alias("n"))


@query("category_path_matches", "P17", """
SELECT p_partkey FROM part WHERE split_part(p_type, ' ', 1) = (SELECT split_part(min(p_type), ' ', 1) FROM part) OR regexp_matches(p_type, 'S$')""")
def category_path(t):
    part = t("part").withColumn("path", F.split("p_type", " "))
    root = t("part").agg(F.split(F.min("p_type"), " ")[0].alias("root"))
    return part.crossJoin(F.broadcast(root)).where((F.slice("path", 1, 1) == F.array("root")) | F.col("p_type").rlike("S$")).select("p_partkey")


@query("licences_open", "P18 M43", """
SELECT p_partkey, bool_and(trim(lower(x)) IN ('economy', 'brand#1', 'brand#2', 'brand#3', 'small')) AS open FROM (SELECT p_partkey, unnest(string_split(upper(p_type) || ' / ' || p_brand || CASE WHEN p_size % 2 = 0 THEN '/' || p_name ELSE '' END, '/')) AS x FROM part) GROUP BY 1""")
def licences(t):
    """Whether every licence of a list with slashes is an open one."""
    v = F.concat(F.upper("p_type"), F.lit(" / "), "p_brand", F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("/"), "p_name")).otherwise(""))
    return t("part").select("p_partkey", F.forall(F.split(v, "/"), lambda x: F.trim(F.lower(x)).isin("economy", "brand#1", "brand#2", "brand#3", "small")).alias("open"))


_HOST = "regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\\.', '')"


@query("pages_on_sites", "P19 P25 F55", f"SELECT page_id, {_HOST} AS host FROM pages WHERE {_HOST} = 'example.org' OR {_HOST} LIKE '%.example.org'")
def on_sites(t):
    host = X.host_of(F.col("url"))
    return t("pages").where((host == "example.org") | host.endswith(".example.org")).select("page_id", host.alias("host"))


@query("plan_reasons", "P20 M45 M46", """
SELECT CASE WHEN lang NOT IN ('en', 'fr') THEN 'language' WHEN n_chars < 500 THEN 'short' WHEN source = 'src0' THEN 'barred' ELSE 'read' END AS reason, count(*) AS n FROM documents GROUP BY 1""")
def plan_reasons(t):
    reason = F.when(~F.col("lang").isin("en", "fr"), "language").when(F.col("n_chars") < 500, "short").when(F.col("source") == "src0", "barred").otherwise("read")
    return t("documents").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("library_by_mode", "P21 P29", "SELECT doc_id FROM documents WHERE source IN (SELECT source FROM documents GROUP BY 1 HAVING count(DISTINCT lang) = 4)")
def by_mode(t):
    allowed = t("documents").groupBy("source").agg(F.countDistinct("lang").alias("n")).where("n = 4").select("source")
    return t("documents").join(allowed, "source", "left_semi").select("doc_id")


@query("focus_lines", "P22 R7", f"""
WITH s AS (SELECT title, ref, max((contains(lower(text), 'the'))::INT + (contains(lower(text), 'anti'))::INT + 3 * (contains(lower(text), 'of the'))::INT) AS score, min(seq) AS s0 FROM {PASSAGES} GROUP BY 1, 2),
a AS (SELECT *, max(score) OVER (PARTITION BY title) > 0 AS any_hit FROM s)
SELECT title, ref, score FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY CASE WHEN any_hit THEN -score ELSE 0 END, s0, ref) AS n FROM a WHERE NOT any_hit OR score > 0) WHERE n <= 3""")
def focus_lines(t):
    return L.focused(passages(t), "title", ["the", "anti"], ["of the"], 3).select("title", "ref", F.col("score").cast("int").alias("score"))


@query("chats_with_all_words", "P23", "SELECT conv_id FROM conversations GROUP BY 1 HAVING bool_or(contains(lower(text), 'the')) AND bool_or(contains(lower(text), 'in'))")
def all_words(t):
    held = [F.bool_or(F.contains(F.lower("text"), F.lit(w))).alias(w) for w in ("the", "in")]
    return t("conversations").groupBy("conv_id").agg(*held).where("the and `in`").select("conv_id")


@query("on_the_page", "P24 M3", "SELECT seq, ref FROM (SELECT conv_id * 1000 + turn AS seq, 'Conv ' || conv_id || ':' || turn AS ref FROM conversations) WHERE ref = 'Conv 3' OR starts_with(ref, 'Conv 3:') OR starts_with(ref, 'Conv 4:')")
def on_page(t):
    ref = F.col("ref")
    return talks(t).where((ref == "Conv 3") | ref.startswith("Conv 3:") | ref.startswith("Conv 4:")).select("seq", "ref")


@query("inner_join_as_filter", "P26", "SELECT d.doc_id, l.toxic FROM documents d JOIN labels l USING (doc_id)")
def join_filter(t):
    return t("documents").select("doc_id").join(t("labels").select("doc_id", "toxic"), "doc_id")


@query("heading_lines", "P27", "SELECT seq, regexp_matches(text, '^[A-Z][^.!?]{0,60}$') AS heading FROM (SELECT conv_id * 1000 + turn AS seq, text FROM conversations)")
def heading_lines(t):
    return talks(t).select("seq", F.col("text").rlike(r"^[A-Z][^.!?]{0,60}$").alias("heading"))


@query("safety_labels", "P28 M87 M88 M76 D22", r"""
SELECT CASE WHEN regexp_matches(lower(text), '\b(idiot|stupid|moron)\b') THEN 'abuse' WHEN regexp_matches(lower(text), '\b(password|secret)\b') THEN 'secret' WHEN regexp_matches(lower(text), '@') THEN 'contact' ELSE 'none' END AS label, count(*) AS n FROM documents GROUP BY 1""")
def safety(t):
    text = F.lower("text")
    label = F.when(text.rlike(r"\b(idiot|stupid|moron)\b"), "abuse").when(text.rlike(r"\b(password|secret)\b"), "secret").when(text.rlike("@"), "contact").otherwise("none")
    return t("documents").groupBy(label.alias("label")).agg(F.count("*").alias("n"))

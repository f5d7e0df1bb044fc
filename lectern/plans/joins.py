"""Joins: dimension, semi and anti, links both ways, derived keys, neighbours, containment, reconcile."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import refs as R
from lectern.operators import links as K
from lectern.operators.sequence import neighbours_in_order
from lectern.plans.views import EDGES, PASSAGES, TALKS, edges, passages, talks
from lectern.registry import query


@query("first_ref_of_title", "J2 A4", f"SELECT title, arg_min(ref, seq) AS first_ref, count(*) AS n, min(seq) AS first_seq FROM {PASSAGES} GROUP BY 1")
def first_ref(t):
    return passages(t).groupBy("title").agg(F.min_by("ref", "seq").alias("first_ref"), F.count("*").alias("n"), F.min("seq").alias("first_seq"))


@query("without_other_language", "J3", "SELECT doc_id FROM documents d WHERE lang = 'en' AND NOT EXISTS (SELECT 1 FROM documents e WHERE e.lang = 'fr' AND e.source = d.source AND e.n_chars = d.n_chars)")
def no_other(t):
    d = t("documents").select("doc_id", "lang", "source", "n_chars")
    return d.where("lang = 'en'").join(d.where("lang = 'fr'").select("source", "n_chars"), ["source", "n_chars"], "left_anti").select("doc_id")


@query("titles_without_article", "J4 T25", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def orphans(t):
    return t("customer").select("c_custkey").join(t("orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("links_on_known_titles", "J5 J6 F15 S4", f"""
WITH p AS {TALKS}, raw AS (SELECT 'Conv ' || (l_orderkey % 80) AS a, 'Conv ' || (l_partkey % 80) || ':1-3' AS b FROM lineitem),
s AS (SELECT a, regexp_replace(b, '-[0-9ab:]+$', '') AS b FROM raw),
x AS (SELECT coalesce(p0.ref, p1.ref, p2.ref) AS a, coalesce(q0.ref, q1.ref, q2.ref) AS b FROM s LEFT JOIN p p0 ON p0.ref = s.a LEFT JOIN p p1 ON p1.ref = s.a || ':1' LEFT JOIN p p2 ON p2.ref = s.a || ':1:1' LEFT JOIN p q0 ON q0.ref = s.b LEFT JOIN p q1 ON q1.ref = s.b || ':1' LEFT JOIN p q2 ON q2.ref = s.b || ':1:1')
SELECT DISTINCT a, b FROM x WHERE a IS NOT NULL AND b IS NOT NULL""")
def links_known(t):
    raw = t("lineitem").select(F.concat(F.lit("Conv "), F.col("l_orderkey") % 80).alias("a"), F.concat(F.lit("Conv "), F.col("l_partkey") % 80, F.lit(":1-3")).alias("b"))
    pairs = raw.select(R.link_start(F.col("a")).alias("a"), R.link_start(F.col("b")).alias("b")).distinct()
    return K.resolve_links(pairs, talks(t).select("ref"))


@query("link_both_ways", "J7 U1 U3", f"""
WITH e AS {EDGES}, b AS (SELECT a AS anchor, b AS other, kind FROM e UNION ALL SELECT b, a, kind FROM e)
SELECT DISTINCT anchor, other, kind FROM b WHERE anchor IN ('Part 1', 'Order 3', 'Part 77')""")
def both_ways(t):
    return K.neighbours(edges(t), t.values([("Part 1",), ("Order 3",), ("Part 77",)], "anchor string"))


@query("commentaries_by_prefix", "J8 J9 M5 U2", f"""
WITH p AS {TALKS} SELECT base, ref FROM (SELECT regexp_extract(ref, '^(.+):[^:]*$', 1) AS base, ref, row_number() OVER (PARTITION BY regexp_extract(ref, '^(.+):[^:]*$', 1) ORDER BY seq) AS n FROM p) WHERE n <= 2 AND base IN ('Conv 1', 'Conv 2', 'Conv 15', 'Conv 16')""")
def by_base(t):
    """The prefix join as an equi-join on the base that each reference names."""
    asked = t.values([("Conv 1",), ("Conv 2",), ("Conv 15",), ("Conv 16",)], "base string")
    return K.capped(talks(t).withColumn("base", R.section_of(F.col("ref"))).join(F.broadcast(asked), "base"), ["base"], ["seq"], 2).select("base", "ref")


@query("dictionary_forms", "J10 J11 W4 F17", """
WITH w AS (SELECT DISTINCT doc_id, lower(x) AS form FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS x FROM documents) WHERE x <> ''),
l AS (SELECT p_partkey, lower(w2) AS form FROM (SELECT p_partkey, unnest(string_split(p_type, ' ')) AS w2 FROM part))
SELECT form, doc_id FROM (SELECT form, doc_id, row_number() OVER (PARTITION BY form ORDER BY doc_id) AS n FROM w) WHERE n <= 2 AND form NOT IN (SELECT form FROM l)""")
def dictionary(t):
    """The first two documents of each form that the dictionary lacks."""
    return _new_forms(t, t("documents"))


def _new_forms(t, documents):
    w = documents.select("doc_id", F.explode(F.split("text", " ")).alias("x")).where("x <> ''").select("doc_id", F.lower("x").alias("form")).distinct()
    seen = t("part").select(F.explode(F.split("p_type", " ")).alias("x")).select(F.lower("x").alias("form")).distinct()
    return K.capped(w.join(seen, "form", "left_anti"), ["form"], ["doc_id"], 2).select("form", "doc_id")


@query("section_with_attached", "J12 J14 J15 N8", f"""
WITH p AS {TALKS}, e AS (SELECT 'Conv ' || (l_orderkey % 60) || ':1' AS ref, 'Part ' || l_partkey AS other FROM lineitem)
SELECT p.ref, p.seq, count(DISTINCT e.other) AS n, coalesce(string_agg(DISTINCT e.other, '|' ORDER BY e.other), '') AS others FROM p LEFT JOIN e USING (ref) GROUP BY 1, 2""")
def section(t):
    e = t("lineitem").select(F.concat(F.lit("Conv "), F.col("l_orderkey") % 60, F.lit(":1")).alias("ref"), F.concat(F.lit("Part "), "l_partkey").alias("other"))
    own = e.groupBy("ref").agg(F.array_sort(F.collect_set("other")).alias("others"))
    return talks(t).join(own, "ref", "left").select("ref", "seq", F.coalesce(F.size("others"), F.lit(0)).cast("long").alias("n"), F.coalesce(F.array_join("others", "|"), F.lit("")).alias("others")).withColumn("n", F.when(F.col("others") == "", F.lit(0)).otherwise(F.col("n")).cast("long"))


@query("neighbour_sections", "J13 W10", f"""
SELECT section, lag(section) OVER (ORDER BY s0) AS before, lead(section) OVER (ORDER BY s0) AS after FROM (SELECT regexp_replace(ref, ':[^:]*$', '') AS section, min(seq) AS s0 FROM {TALKS} GROUP BY 1)""")
def neighbours(t):
    s = talks(t).groupBy(R.section_of(F.col("ref")).alias("section")).agg(F.min("seq").alias("first_seq"))
    return neighbours_in_order(s, ["first_seq"], "section").select("section", "before", "after")


@query("quote_containment", "J18 J19 M68", "WITH d AS MATERIALIZED (SELECT doc_id, regexp_replace(text, '\\s+', ' ', 'g') AS t FROM documents), b AS MATERIALIZED (SELECT item_id, regexp_replace(text, '\\s+', ' ', 'g') AS q FROM benchmark) SELECT item_id, doc_id FROM b JOIN d ON contains(t, q)")
def containment(t):
    """Quotes found through their first words as an equi-join key, then confirmed; no pairing of all with all."""
    from lectern.operators.matching import quotes_in

    return quotes_in(t("benchmark").select("item_id", F.col("text").alias("quote")), t("documents").select("doc_id", "text"))


@query("reconcile_lists", "J20 T10", """
WITH l AS (SELECT o_custkey AS id, max(o_orderkey) AS stamp FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1), r AS (SELECT o_custkey AS id, max(o_orderkey) AS stamp FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), gone AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderkey % 97 = 0)
SELECT coalesce(l.id, r.id) AS id, CASE WHEN r.id IS NULL OR l.stamp > r.stamp THEN 'push' WHEN l.id IS NULL OR r.stamp > l.stamp THEN 'fetch' ELSE 'keep' END AS step
FROM l FULL JOIN r ON l.id = r.id WHERE coalesce(l.id, r.id) NOT IN (SELECT id FROM gone)""")
def reconcile(t):
    o = t("orders").select(F.col("o_custkey").alias("id"), "o_orderkey")
    local = o.where("o_orderkey % 3 <> 0").groupBy("id").agg(F.max("o_orderkey").alias("mine"))
    remote = o.where("o_orderkey % 2 = 0").groupBy("id").agg(F.max("o_orderkey").alias("theirs"))
    step = F.when(F.col("theirs").isNull() | (F.col("mine") > F.col("theirs")), "push").when(F.col("mine").isNull() | (F.col("theirs") > F.col("mine")), "fetch").otherwise("keep")
    return local.join(remote, "id", "full").join(o.where("o_orderkey % 97 = 0").select("id"), "id", "left_anti").select("id", step.alias("step"))


@query("live_sessions", "J21 T3 T19", "SELECT c.c_custkey, count(*) AS live FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_orderdate + INTERVAL 30 DAY >= TIMESTAMP '1998-06-01' GROUP BY 1")
def live_sessions(t):
    live = t("orders").where(F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS") >= F.lit("1998-06-01").cast("timestamp_ntz"))
    return live.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_custkey").agg(F.count("*").alias("live"))


@query("folders_by_loose_key", "J22 F31 M71 M72", r"""
WITH k AS (SELECT p_partkey, regexp_replace(lower(p_brand), '[^a-z0-9]+', '', 'g') AS key FROM part), u AS (SELECT key, count(*) AS n, min(p_partkey) AS first FROM k GROUP BY 1)
SELECT key, n, first FROM u""")
def loose(t):
    from lectern.functions.text import loose_key

    return t("part").groupBy(loose_key(F.col("p_brand")).alias("key")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))


@query("stored_against_expected", "J23 T14", """
SELECT CASE WHEN regexp_replace(e, ' ', '', 'g') = regexp_replace(s, ' ', '', 'g') THEN 'spacing' WHEN contains(s, e) THEN 'longer' ELSE 'other' END AS kind, count(*) AS n
FROM (SELECT doc_id, text AS s, CASE WHEN doc_id % 3 = 0 THEN replace(text, '. ', '.  ') WHEN doc_id % 3 = 1 THEN substr(text, 1, 20) ELSE text || '!' END AS e FROM documents) WHERE s <> e GROUP BY 1""")
def stored(t):
    e = F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit(". "), F.lit(".  "))).when(F.col("doc_id") % 3 == 1, F.substring("text", 1, 20)).otherwise(F.concat("text", F.lit("!")))
    d = t("documents").select(F.col("text").alias("s"), e.alias("e")).where("s <> e")
    kind = F.when(F.replace("e", F.lit(" "), F.lit("")) == F.replace("s", F.lit(" "), F.lit("")), "spacing").when(F.contains("s", "e"), "longer").otherwise("other")
    return d.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("nearest_within", "J24 D7", """
WITH c(city, lat, lon) AS (VALUES ('Jerusalem', 31.778, 35.235), ('London', 51.507, -0.128), ('New York', 40.713, -74.006), ('Haifa', 32.794, 34.989)),
p AS (SELECT s_suppkey, -60 + (s_suppkey * 37 % 120) AS lat, -180 + (s_suppkey * 53 % 360) AS lon FROM supplier),
d AS (SELECT s_suppkey, city, 2 * 6371 * asin(sqrt(pow(sin(radians(c.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(c.lat)) * pow(sin(radians(c.lon - p.lon) / 2), 2))) AS km FROM p, c)
SELECT s_suppkey, arg_min(city, km) AS city, round(min(km), 3) AS km FROM d WHERE km < 3000 GROUP BY 1""")
def nearest(t):
    """A table of cities has a fixed size, so it goes to every task."""
    from lectern.functions.dates import km_between

    cities = t.values([("Jerusalem", 31.778, 35.235), ("London", 51.507, -0.128), ("New York", 40.713, -74.006), ("Haifa", 32.794, 34.989)], "city string, clat double, clon double")
    p = t("supplier").select("s_suppkey", (F.lit(-60) + F.col("s_suppkey") * 37 % 120).alias("lat"), (F.lit(-180) + F.col("s_suppkey") * 53 % 360).alias("lon"))
    d = p.join(F.broadcast(cities)).withColumn("km", km_between(F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon")))
    return d.where("km < 3000").groupBy("s_suppkey").agg(F.min_by("city", "km").alias("city"), F.round(F.min("km"), 3).alias("km"))


@query("sources_by_role", "J25 J26 R11 R12 O10 U14", f"""
WITH p AS {PASSAGES}, x AS (
 SELECT 0 AS tier, 'line' AS role, id, ref, seq FROM p WHERE id = 40 UNION ALL SELECT 1, 'near', id, ref, seq FROM p WHERE abs(seq - 40) BETWEEN 1 AND 2
 UNION ALL SELECT 2, 'same title', id, ref, seq FROM p WHERE title = (SELECT title FROM p WHERE id = 40) UNION ALL SELECT 3, 'language', id, ref, seq FROM p WHERE lang = 'es'),
b AS (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY tier, seq) AS k FROM x), c AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY seq) AS n FROM b WHERE k = 1)
SELECT role, ref FROM c WHERE n <= 4 ORDER BY tier, seq LIMIT 10""")
def sources(t):
    """Tiers with a cap each and one over all; a reference counts in its first tier."""
    p = passages(t)
    title = p.where("id = 40").select("title")
    tiers = [("line", p.where("id = 40")), ("near", p.where("abs(seq - 40) between 1 and 2")), ("same title", p.join(title, "title", "left_semi")), ("language", p.where("lang = 'es'"))]
    return K.fuse([(name, df.select("ref", "seq")) for name, df in tiers], 4, 10)


@query("base_of_commentary", "J27 M4 M9", """
WITH b AS (SELECT p_partkey, p_name || ' on ' || p_brand AS title, p_brand FROM part)
SELECT p_partkey, regexp_extract(title, ' on (.+)$', 1) AS base FROM b WHERE regexp_extract(title, ' on (.+)$', 1) IN (SELECT p_brand FROM part)""")
def base_of(t):
    b = t("part").select("p_partkey", F.concat("p_name", F.lit(" on "), "p_brand").alias("title"))
    known = t("part").select(F.col("p_brand").alias("base")).distinct()
    return b.select("p_partkey", F.regexp_extract("title", " on (.+)$", 1).alias("base")).join(known, "base", "left_semi").select("p_partkey", "base")

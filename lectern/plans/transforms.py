"""Nested data, trees, validation and the smaller transforms; sources and sinks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.operators import tree as T
from lectern.plans.views import EDGES, TALKS, edges, talks
from lectern.registry import query
from lectern.sources import files as S


@query("jagged_flattened", "N1 N2 N4 F16", """
WITH v AS (SELECT DISTINCT l_orderkey, l_linestatus AS s, CASE WHEN l_partkey % 7 = 0 THEN '' ELSE l_linenumber || '-' || l_partkey END AS x FROM lineitem),
c AS (SELECT *, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY s) AS i, row_number() OVER (PARTITION BY l_orderkey, s ORDER BY x) AS j FROM v)
SELECT 'Order ' || l_orderkey || ' ' || i || ':' || j AS ref, x AS text FROM c WHERE x <> ''""")
def jagged(t):
    """Nested arrays kept as JSON to references; empty places count but give no row."""
    x = F.when(F.col("l_partkey") % 7 == 0, "").otherwise(F.concat("l_linenumber", F.lit("-"), "l_partkey"))
    inner = t("lineitem").groupBy("l_orderkey", "l_linestatus").agg(F.sort_array(F.collect_set(x)).alias("x"))
    whole = inner.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linestatus", "x"))).alias("c"))
    return T.flatten(whole.select(F.concat(F.lit("Order "), "l_orderkey").alias("title"), F.to_json(F.col("c.x")).alias("body")))


@query("contents_tree", "N14 J28 M80", """
WITH RECURSIVE c AS (SELECT DISTINCT p_type AS node, 'root' AS parent FROM part UNION SELECT p_type || '.' || p_brand, p_type FROM part UNION SELECT p_type || '.' || p_brand || '.' || p_name, p_type || '.' || p_brand FROM part),
w(node, depth, path) AS (SELECT 'root', 0, 'root' UNION ALL SELECT c.node, w.depth + 1, w.path || '/' || c.node FROM c JOIN w ON c.parent = w.node) SELECT node, depth, path FROM w""")
def contents(t):
    """A table of contents walked level by level with a recursive query."""
    p = t("part").select("p_type", F.concat_ws(".", "p_type", "p_brand").alias("b"), F.concat_ws(".", "p_type", "p_brand", "p_name").alias("n"))
    toc = p.select(F.col("p_type").alias("node"), F.lit("root").alias("parent")).union(p.select("b", "p_type")).union(p.select("n", "b")).distinct()
    toc.createOrReplaceTempView("lectern_toc")
    return t.spark.sql("WITH RECURSIVE w(node, depth, path) AS (SELECT 'root', 0, 'root' UNION ALL SELECT c.node, w.depth + 1, concat(w.path, '/', c.node) FROM lectern_toc c JOIN w ON c.parent = w.node) SELECT node, depth, path FROM w")


@query("profile_clamped", "N6 M60 M86", "SELECT event_id, greatest(0, least(50, (props->>'$.k')::BIGINT)) AS k, (props->>'$.k')::BIGINT BETWEEN 0 AND 50 AS ok FROM events")
def clamped(t):
    k = F.from_json("props", "k long")["k"]
    return t("events").select("event_id", F.greatest(F.lit(0), F.least(F.lit(50), k)).cast("long").alias("k"), k.between(0, 50).alias("ok"))


@query("json_columns", "N9 N10 N13 F56 N5", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS n FROM events")
def json_columns(t):
    """Lists kept as JSON; what cannot be read, and what is no list, is empty."""
    raw = F.expr("CASE event_id % 5 WHEN 0 THEN to_json(array(event_type, string(user_id))) WHEN 1 THEN to_json(array(event_type)) WHEN 2 THEN concat('not json ', event_type) WHEN 3 THEN '[]' END")
    return t("events").select("event_id", F.size(F.coalesce(F.from_json(raw, "array<string>"), F.array().cast("array<string>"))).alias("n"))


@query("files_by_folder", "N13 S2 M71", "SELECT source || '/' || lang AS folder, count(*) AS n, sum(n_chars)::BIGINT AS bytes FROM documents GROUP BY 1")
def by_folder(t):
    name = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return t("documents").select(F.substring_index(name, "/", 2).alias("folder"), "n_chars").groupBy("folder").agg(F.count("*").alias("n"), F.sum("n_chars").alias("bytes"))


@query("code_families", "M1 M2 M10 M11", """
SELECT p_partkey, CASE WHEN p_brand = 'Brand#11' THEN 'oc' WHEN p_brand = 'Brand#12' THEN 'yd' WHEN starts_with(p_type, 'STANDARD') THEN 'mt' ELSE 'plain' END AS family, p_brand || CASE WHEN p_size > 20 THEN ' ' || p_size ELSE '' END AS ref FROM part""")
def families(t):
    known = F.create_map(F.lit("Brand#11"), F.lit("oc"), F.lit("Brand#12"), F.lit("yd"))
    family = F.coalesce(known[F.col("p_brand")], F.when(F.col("p_type").startswith("STANDARD"), "mt"), F.lit("plain"))
    return t("part").select("p_partkey", family.alias("family"), F.concat("p_brand", F.when(F.col("p_size") > 20, F.concat(F.lit(" "), F.col("p_size"))).otherwise("")).alias("ref"))


@query("metadata_pivot", "M7 S26", "SELECT lang, max(n) FILTER (k = 'short') AS short, max(n) FILTER (k = 'long') AS long FROM (SELECT lang, CASE WHEN n_chars < 1000 THEN 'short' ELSE 'long' END AS k, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY 1")
def pivot(t):
    k = F.when(F.col("n_chars") < 1000, "short").otherwise("long")
    return t("documents").withColumn("k", k).groupBy("lang").pivot("k", ["short", "long"]).count()


@query("phrase_runs", "M17 M19 A22", """
WITH p AS (SELECT conv_id, turn, turn // 3 AS phrase FROM conversations) SELECT conv_id, phrase, min(turn) AS first, max(turn) AS last, count(*) AS n FROM p GROUP BY 1, 2""")
def phrase_runs(t):
    """Words meet the phrase whose range holds them; ranges are cut to equal steps, so this is an equi-join."""
    c = t("conversations").select("conv_id", "turn")
    spans = c.groupBy("conv_id", F.floor(F.col("turn") / 3).alias("phrase")).agg(F.min("turn").alias("lo"), F.max("turn").alias("hi"))
    held = c.withColumn("phrase", F.floor(F.col("turn") / 3)).join(spans, ["conv_id", "phrase"]).where("turn between lo and hi")
    return held.groupBy("conv_id", "phrase").agg(F.min("turn").alias("first"), F.max("turn").alias("last"), F.count("*").alias("n"))


@query("furthest_line", "M26 M13 M31", f"SELECT conv_id, arg_max(ref, turn) AS reached, max(turn) AS line FROM {TALKS} WHERE role = 'user' GROUP BY 1")
def furthest(t):
    return talks(t).where("role = 'user'").groupBy("conv_id").agg(F.max_by("ref", "turn").alias("reached"), F.max("turn").alias("line"))


@query("number_ranges", "M32 M33", r"SELECT doc_id, len(regexp_extract_all(text, '\d+')) AS numbers FROM documents")
def numbers(t):
    return t("documents").select("doc_id", F.size(F.regexp_extract_all("text", F.lit(r"\d+"), 0)).cast("long").alias("numbers"))


@query("names_mentioned", "M34", "SELECT name, count(*) AS docs FROM documents, (VALUES ('the'), ('de la'), ('und'), ('que')) n(name) WHERE contains(lower(text), ' ' || name || ' ') GROUP BY 1")
def names(t):
    """A fixed list of names against every text."""
    found = F.array(*[F.when(F.lower("text").contains(f" {n} "), F.lit(n)) for n in ("the", "de la", "und", "que")])
    return t("documents").select(F.explode(F.array_compact(found)).alias("name")).groupBy("name").agg(F.count("*").alias("docs"))


@query("validation_reasons", "M37 M38 M39 M40 M41 M42", """
SELECT o_orderkey, CASE WHEN NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal >= 0) THEN 'unknown customer' WHEN o_totalprice < 1000 THEN 'too small' WHEN o_orderstatus NOT IN ('O', 'F', 'P') THEN 'status' END AS reason FROM orders""")
def validation(t):
    """The first rule that a row fails; null where it passes all."""
    known = t("customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("known"))
    o = t("orders").join(known, "o_custkey", "left")
    reason = F.when(F.col("known").isNull(), "unknown customer").when(F.col("o_totalprice") < 1000, "too small").when(~F.col("o_orderstatus").isin("O", "F", "P"), "status")
    return o.select("o_orderkey", reason.alias("reason"))


@query("standing_fields", "M43 M44 M48 M50", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'caution' ELSE 'good' END AS standing, coalesce((SELECT string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) FROM orders WHERE o_custkey = c_custkey), '') AS kinds FROM customer")
def standing(t):
    kinds = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "|").alias("kinds"))
    return t("customer").join(kinds, "c_custkey", "left").select("c_custkey", F.when(F.col("c_acctbal") < 0, "caution").otherwise("good").alias("standing"), F.coalesce("kinds", F.lit("")).alias("kinds"))


@query("overview_lines", "M57 M58 A10", "SELECT lang || ': ' || string_agg(source || ' ' || n, ', ' ORDER BY source) AS line FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY lang")
def overview(t):
    own = t("documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source", "n"))), lambda x: F.concat(x["source"], F.lit(" "), x["n"])), ", ")
    return own.groupBy("lang").agg(line.alias("l")).select(F.concat("lang", F.lit(": "), "l").alias("line"))


@query("cards_limited", "M52 M53 M54 O10", "SELECT b, count(*) AS n FROM (SELECT l_orderkey % 50 AS b, l_partkey, row_number() OVER (PARTITION BY l_orderkey % 50 ORDER BY l_partkey, l_orderkey, l_linenumber, l_suppkey) AS k FROM lineitem) WHERE k <= 3 GROUP BY 1")
def cards(t):
    k = F.row_number().over(Window.partitionBy("b").orderBy("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey"))
    return t("lineitem").withColumn("b", F.col("l_orderkey") % 50).withColumn("k", k).where("k <= 3").groupBy("b").agg(F.count("*").alias("n"))


@query("files_round_trip", "S4 S8", f"SELECT 'json' AS kind, count(*) AS n FROM nation UNION ALL SELECT 'csv', count(*) FROM {EDGES}")
def round_trip(t):
    """Tables written as JSON lines and CSV into the shared folder and read back with their schema."""
    return S.round_trips(t.spark, t("nation"), edges(t))


@query("site_feeds", "S15 S16 A14", """
SELECT split_part(regexp_replace(href, '^/', ''), '/', 1) AS section, count(*) AS n FROM (SELECT unnest(list_distinct(regexp_extract_all(html, 'href="([^"#]*)"', 1))) AS href FROM pages) GROUP BY 1""")
def feeds(t):
    """Addresses that pages link to, by section of the link."""
    links = t("pages").select(F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(r'href="([^"#]*)"'), 1))).alias("href"))
    return links.select(F.substring_index(F.regexp_replace("href", "^/", ""), "/", 1).alias("section")).groupBy("section").agg(F.count("*").alias("n"))




@query("header_fields", "S3", """
SELECT page_id, regexp_extract(substr(html, 1, 6144), '<html lang="([a-z]+)"', 1) AS lang, regexp_extract(substr(html, 1, 6144), 'charset="([^"]+)"', 1) AS charset FROM pages""")
def header_fields(t):
    """Fields from the first 6 KB of each file; the rest is not looked at."""
    head = F.substring("html", 1, 6144)
    return t("pages").select("page_id", F.regexp_extract(head, '<html lang="([a-z]+)"', 1).alias("lang"), F.regexp_extract(head, 'charset="([^"]+)"', 1).alias("charset"))


@query("block_moved", "M29", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN turn BETWEEN 1 AND 2 THEN 1 ELSE 0 END, turn) AS n FROM conversations")
def block_moved(t):
    """A block of an ordered list moved behind the rest, by a computed sort key."""
    key = F.when(F.col("turn").between(1, 2), 1).otherwise(0)
    return t("conversations").select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy(key, "turn")).alias("n"))


@query("layouts_checked", "L18 P11", """
WITH l AS (SELECT l_orderkey, l_linenumber AS n, min(l_suppkey) // 10 AS y, min(l_partkey) % 6 AS w FROM lineitem GROUP BY 1, 2), k AS (SELECT *, lag(y) OVER (PARTITION BY l_orderkey ORDER BY n) AS before FROM l)
SELECT l_orderkey, l_orderkey % 11 <> 0 AND bool_and(coalesce(y > before, true) AND w < 5) AS ok FROM k GROUP BY 1""")
def layouts_checked(t):
    """Layout records that can be read, with lines in order down the page and words that exist."""
    lines = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.floor(F.min("l_suppkey") / 10).alias("y"), F.array((F.min("l_partkey") % 6)).alias("w"))
    kept = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "y", "w"))).alias("s"))
    raw = F.when(F.col("l_orderkey") % 11 == 0, "not json").otherwise(F.to_json(F.struct(F.lit(5).alias("words"), F.transform("s", lambda x: F.struct(x["y"].alias("y"), x["w"].alias("w"))).alias("lines"))))
    r = kept.select("l_orderkey", F.from_json(raw, "words int, lines array<struct<y: double, w: array<int>>>").alias("r")).select("l_orderkey", "r.words", "r.lines")
    ordered = F.forall(F.sequence(F.lit(1), F.greatest(F.size("lines") - 1, F.lit(1))), lambda i: (i >= F.size("lines")) | (F.get("lines", i)["y"] > F.get("lines", i - 1)["y"]))
    known = F.forall("lines", lambda x: F.forall(x["w"], lambda w: (w >= 0) & (w < F.col("words"))))
    return r.select("l_orderkey", F.coalesce(ordered & known, F.lit(False)).alias("ok"))


@query("author_notes", "M69", """
SELECT conv_id, CASE WHEN conv_id % 5 IN (0, 1) THEN '' ELSE string_agg(n || '. ' || role || ' ' || turn, '|' ORDER BY turn) END AS notes FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) GROUP BY 1""")
def author_notes(t):
    """Notes kept as JSON in an article's metadata, numbered; none if it cannot be read or has none."""
    kept = t("conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: F.concat(x["role"], F.lit(" "), x["turn"])).alias("n"))
    meta = F.when(F.col("conv_id") % 5 == 0, "broken").when(F.col("conv_id") % 5 == 1, "{}").otherwise(F.to_json(F.struct(F.col("n").alias("footnotes"))))
    notes = F.coalesce(F.from_json(meta, "footnotes array<string>")["footnotes"], F.array().cast("array<string>"))
    return kept.select("conv_id", F.array_join(F.transform(notes, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "|").alias("notes"))


@query("first_senses", "F44", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_name || ' ' || p_brand WHEN 1 THEN p_name ELSE '' END AS sense FROM part")
def first_senses(t):
    """The first sense of entries with groups in brackets, several sentences, and nothing before the first stop."""
    from lectern.functions.parse import first_sense

    @F.pandas_udf("string")
    def sense(entry: pd.Series) -> pd.Series:
        return entry.map(first_sense, na_action="ignore")

    entry = F.expr("CASE p_size % 3 WHEN 0 THEN concat(p_name, ' (pl. ', p_type, '; also [', p_brand, '; x]) ', p_brand, '; ', p_type) WHEN 1 THEN concat(p_name, '. Also ', p_type) ELSE concat('; ', p_name) END")
    return t("part").select("p_partkey", sense(entry).alias("sense"))


@query("bson_entries", "S5", "SELECT n_name AS dictionary, count(*) AS entries, sum(length(s_name))::BIGINT AS letters FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name LIKE 'A%' OR n_name LIKE 'F%' GROUP BY 1")
def bson_entries(t):
    """Documents written as BSON and read back, those of the named dictionaries alone."""
    import json

    from lectern.sources.bson import Bson, write_bson

    names = [r["n_name"] for r in t("nation").where("n_name like 'A%' or n_name like 'F%'").select("n_name").collect()]  # a fixed few
    entries = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("name"), "s_suppkey", F.col("s_name").alias("headword"))
    folder = S.work_folder(t.spark)
    write_bson(entries, folder)
    t.spark.dataSource.register(Bson)
    got = t.spark.read.format("bson").option("path", folder).option("names", json.dumps(names)).load()
    return got.groupBy(F.col("name").alias("dictionary")).agg(F.count("*").alias("entries"), F.sum(F.length(F.get_json_object("document", "$.headword"))).alias("letters"))


@query("batches_committed", "S9", "SELECT 'nation' AS name, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region")
def batches_committed(t):
    """Two tables in one batch that is committed; another batch fails half-way and is never seen."""
    from lectern.sources.staged import read_table, write_batch

    def broken():
        raise RuntimeError("the second table of this batch cannot be made")

    folder = S.work_folder(t.spark)
    write_batch(t.spark, folder, {"nation": t("nation"), "region": t("region")})
    try:
        write_batch(t.spark, folder, {"nation": t("nation"), "region": broken})
    except RuntimeError:
        pass
    count = lambda name: read_table(t.spark, folder, name).agg(F.lit(name).alias("name"), F.count("*").alias("n"))
    return count("nation").unionByName(count("region"))

"""Catalogue placing and tiers of links over the parts, seen as books and their lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import links as K
from lectern.operators import placing as P
from lectern.operators import tiers as T
from lectern.registry import query

# Part names are books, their last words too; what a brand makes of a part explains it, named in one of four ways.
_BOOKS = """
named AS (SELECT DISTINCT p_name, p_type FROM part WHERE p_name IS NOT NULL), tail AS (SELECT DISTINCT string_split(p_name, ' ')[-1] AS title FROM named),
books AS (SELECT title, [min(p_type), min(p_type) || ' kinds'] AS categories, 0 AS seq FROM (SELECT p_name AS title, p_type FROM named) GROUP BY 1
  UNION ALL SELECT title, ['RAW'], 1 FROM tail
  UNION ALL SELECT DISTINCT CASE p_size % 4 WHEN 0 THEN p_brand || ' on ' || p_name WHEN 1 THEN p_brand || ' ' || p_name WHEN 2 THEN p_brand || ' on the ' || p_name ELSE p_brand || ' on ' || upper(p_name) || '; Second' END, [p_type, 'Notes on ' || p_type] || CASE WHEN p_size % 3 = 0 THEN [p_brand || ' on parts'] ELSE [] END, 2 FROM part WHERE p_name IS NOT NULL)"""

_PLAIN = "regexp_replace(lower({0}), '[''’‘`\"]', '', 'g')"
_EXPLAINED = f"""
mains AS (SELECT * FROM books WHERE seq < 2), notes AS (SELECT *, trim(string_split(title, ';')[1]) AS name FROM books WHERE seq = 2),
byon AS (SELECT n.title, min(m.title) AS base FROM (SELECT DISTINCT title, name FROM notes) n JOIN mains m ON contains(n.name, ' on ') AND {_PLAIN.format("m.title")} = {_PLAIN.format("string_split(n.name, ' on ')[-1]")} GROUP BY 1),
byend AS (SELECT n.title, arg_max(m.title, length(m.title)) AS base FROM (SELECT DISTINCT title, name FROM notes) n JOIN mains m ON ends_with(n.name, ' ' || m.title) GROUP BY 1),
base AS (SELECT t.title, coalesce(byon.base, byend.base) AS base FROM (SELECT DISTINCT title FROM notes) t LEFT JOIN byon USING (title) LEFT JOIN byend USING (title))"""


def _books(t):
    p = t("part").where("p_name is not null")
    named = p.select("p_name", "p_type").distinct()
    whole = named.groupBy(F.col("p_name").alias("title")).agg(F.min("p_type").alias("k")).select("title", F.array(F.col("k"), F.concat("k", F.lit(" kinds"))).alias("categories"), F.lit(0).alias("seq"))
    tail = named.select(F.substring_index("p_name", " ", -1).alias("title")).distinct().select("title", F.array(F.lit("RAW")).alias("categories"), F.lit(1).alias("seq"))
    turn = F.col("p_size") % 4
    title = F.when(turn == 0, F.concat("p_brand", F.lit(" on "), "p_name")).when(turn == 1, F.concat("p_brand", F.lit(" "), "p_name")).when(turn == 2, F.concat("p_brand", F.lit(" on the "), "p_name")).otherwise(F.concat("p_brand", F.lit(" on "), F.upper("p_name"), F.lit("; Second")))
    more = F.when(F.col("p_size") % 3 == 0, F.array(F.concat("p_brand", F.lit(" on parts")))).otherwise(F.array().cast("array<string>"))
    notes = p.select(title.alias("title"), F.concat(F.array(F.col("p_type"), F.concat(F.lit("Notes on "), "p_type")), more).alias("categories"), F.lit(2).alias("seq")).distinct()
    return whole.unionByName(tail).unionByName(notes)


@query("explained_titles", "J27", f"WITH {_BOOKS}, {_EXPLAINED} SELECT title, base FROM base")
def explained_titles(t):
    """The title that each title explains: what follows " on ", else its longest ending that is a title."""
    books = _books(t)
    return P.explained(books.where("seq = 2").select("title"), books.where("seq < 2").select("title"))


@query("catalogue", "J27 A29 M8", f"""
WITH {_BOOKS}, {_EXPLAINED},
main AS (SELECT title, seq, CASE categories[1] WHEN 'RAW' THEN 'raw' WHEN 'ECONOMY' THEN 'cheap' WHEN 'SMALL' THEN 'small' ELSE 'other' END AS shelf, coalesce(categories[2], '') AS grp FROM mains),
one AS (SELECT DISTINCT title, shelf, grp FROM main m WHERE seq = (SELECT min(seq) FROM main x WHERE x.title = m.title)),
every AS (SELECT title, seq, shelf, grp, NULL AS base, NULL AS who FROM main
  UNION ALL SELECT n.title, seq, coalesce(o.shelf, CASE n.categories[1] WHEN 'ECONOMY' THEN 'cheap' WHEN 'SMALL' THEN 'small' ELSE 'other' END), coalesce(o.grp, n.categories[2], ''), b.base,
    CASE WHEN len(n.categories) > 2 THEN regexp_replace(n.categories[3], ' on .*$', '') WHEN contains(n.name, ' on ') THEN regexp_extract(n.name, '^(.*) on ', 1) WHEN ends_with(n.name, b.base) THEN trim(n.name[:length(n.name) - length(b.base)]) ELSE n.name END
  FROM notes n JOIN base b USING (title) LEFT JOIN one o ON o.title = b.base),
sets AS (SELECT *, CASE WHEN who IS NOT NULL AND count(who) OVER (PARTITION BY shelf, grp, who) > 1 THEN who END AS st FROM every)
SELECT title, seq, shelf, grp AS "group", base AS "on", who AS "by", st AS "set", CASE WHEN base IS NOT NULL THEN 'on ' || base || ', ' || shelf WHEN grp <> '' THEN shelf || ', ' || grp ELSE shelf END AS "where",
  row_number() OVER (PARTITION BY shelf, grp, st ORDER BY seq, title) AS place FROM sets""")
def catalogue(t):
    """Every book on its shelf, in its group and set, with what it explains."""
    shelves = t.values([("RAW", "raw"), ("ECONOMY", "cheap"), ("SMALL", "small")], "category string, shelf string")
    return P.grouped(P.placed(_books(t), shelves, "^Notes on "))


# Lines are a part's name and a place; families, commentators and sources are small tables of their own.
_FAMILIES = [("small ", False, "code", True), ("small ring", True, "code2", True), ("red ", False, "gemara", False), ("hot ", False, "gemara", False), ("blue ", False, "verse", False)]
_NAMED = [("code", "Brand#1", 0, 0), ("code", "Brand#2", 0, 1), ("code", "Brand#3", 3, 0), ("code2", "Brand#4", 0, 0), ("gemara", "Brand#1", 0, 0), ("gemara", "Brand#2", 2, 0), ("verse", "Brand#5", 1, 0)]
_SOURCES = [("code", "red ", False, 2, 0), ("code", "red bolt", True, 2, 1), ("code2", "hot ", False, 2, 3), ("gemara", "small ", False, 1, 0), ("verse", "hot gear", True, 3, 8)]


def _sql(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


_LINKS = """
l AS (SELECT l_partkey AS k, l_suppkey AS s, l_linenumber AS n, l_orderkey AS o FROM lineitem),
pairs AS (SELECT DISTINCT a.p_name || ' ' || (o % 7 + 1) || ':' || n AS anchor, CASE WHEN s % 3 = 0 THEN b.p_name || ' ' || (s % 9 + 1) || ':' || n WHEN s % 3 = 1 THEN a.p_brand || ' on ' || a.p_name || ' ' || (o % 7 + 1) || ':' || (n + s % 2) || ':' || (s % 4 + 1) ELSE b.p_brand || ' on ' || a.p_name || ' ' || (o % 7 + 1) || ':' || n END AS other
  FROM l JOIN part a ON a.p_partkey = k JOIN part b ON b.p_partkey = (k * 7 + s) % (SELECT max(p_partkey) + 1 FROM part))"""

_TIERS = f"""
f(prefix, exact, family, whole) AS (VALUES {_sql(_FAMILIES)}), c(family, name, tier, pos) AS (VALUES {_sql(_NAMED)}), s(family, prefix, exact, tier, pos) AS (VALUES {_sql(_SOURCES)}),
b AS (SELECT *, regexp_replace(anchor, ' [0-9:]+$', '') AS ab, regexp_replace(other, ' [0-9:]+$', '') AS ob, regexp_extract(anchor, '([0-9:]+)$', 1) AS ap, regexp_extract(other, '([0-9:]+)$', 1) AS op FROM pairs),
g AS (SELECT b.*, coalesce(m.f, 'plain') AS family, coalesce(m.w, false) AS whole FROM b LEFT JOIN (SELECT ab, arg_max(family, length(prefix) * 2 + exact::INT) AS f, arg_max(whole, length(prefix) * 2 + exact::INT) AS w FROM (SELECT DISTINCT ab FROM b) JOIN f ON starts_with(ab, prefix) AND (NOT exact OR ab = prefix) GROUP BY 1) m USING (ab)),
h AS (SELECT *, CASE WHEN ends_with(ob, ' on ' || ab) THEN ob[:length(ob) - length(ab) - 4] END AS who, CASE WHEN whole THEN string_split(op, ':')[1] = string_split(ap, ':')[1] ELSE op = ap OR starts_with(op, ap || ':') END AS near FROM g),
r AS (SELECT h.*, c.tier AS ct, c.pos AS cp, x.t AS st, x.p AS sp FROM h LEFT JOIN c ON c.family = h.family AND c.name = coalesce(h.who, h.ob)
  LEFT JOIN (SELECT k.family, ob, arg_max(tier, length(prefix) * 2 + exact::INT) AS t, arg_max(pos, length(prefix) * 2 + exact::INT) AS p FROM (SELECT DISTINCT family, ob FROM h) k JOIN s ON s.family = k.family AND starts_with(ob, prefix) AND (NOT exact OR ob = prefix) GROUP BY 1, 2) x ON x.family = h.family AND x.ob = h.ob)"""


def _links(t):
    p = t("part")
    most = p.agg((F.max("p_partkey") + 1).alias("size"))
    li = t("lineitem").select(F.col("l_partkey").alias("k"), F.col("l_suppkey").alias("s"), F.col("l_linenumber").alias("n"), F.col("l_orderkey").alias("o")).crossJoin(F.broadcast(most))  # one row
    a = p.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("a_name"), F.col("p_brand").alias("a_brand"))
    b = p.select(F.col("p_partkey").alias("k2"), F.col("p_name").alias("b_name"), F.col("p_brand").alias("b_brand"))
    j = li.withColumn("k2", (F.col("k") * 7 + F.col("s")) % F.col("size")).join(a, "k").join(b, "k2")
    chapter, turn = F.col("o") % 7 + 1, F.col("s") % 3
    colon = F.lit(":")
    anchor = F.concat("a_name", F.lit(" "), chapter, colon, "n")
    other = (
        F.when(turn == 0, F.concat("b_name", F.lit(" "), F.col("s") % 9 + 1, colon, "n"))
        .when(turn == 1, F.concat("a_brand", F.lit(" on "), "a_name", F.lit(" "), chapter, colon, F.col("n") + F.col("s") % 2, colon, F.col("s") % 4 + 1))
        .otherwise(F.concat("b_brand", F.lit(" on "), "a_name", F.lit(" "), chapter, colon, "n"))
    )
    return j.select(anchor.alias("anchor"), other.alias("other")).distinct()


def _tiered(t):
    return T.tiers(
        _links(t), t.values(_FAMILIES, "prefix string, exact boolean, family string, whole boolean"), t.values(_NAMED, "family string, name string, tier int, pos int"), t.values(_SOURCES, "family string, prefix string, exact boolean, tier int, pos int")
    )


@query("link_tiers", "R14 M1 M2 J7", f"""
WITH {_LINKS}, {_TIERS}
SELECT anchor, other, family, CASE WHEN near AND ct IS NOT NULL THEN ct WHEN st IS NOT NULL THEN st WHEN near AND who IS NOT NULL THEN CASE family WHEN 'plain' THEN 0 ELSE 4 END ELSE 5 END AS tier,
  CASE WHEN near AND ct IS NOT NULL THEN cp WHEN st IS NOT NULL THEN sp ELSE 0 END AS pos, CASE WHEN near AND ct IS NOT NULL THEN true WHEN st IS NOT NULL THEN false ELSE near AND who IS NOT NULL END AS commentary FROM r""")
def link_tiers(t):
    """The tier of every link by tables of families, commentators and sources."""
    return _tiered(t)


@query("tiered_lines", "R15 M6 O4", f"""
WITH {_LINKS}, {_TIERS},
q AS (SELECT anchor, other, CASE WHEN near AND ct IS NOT NULL THEN ct WHEN st IS NOT NULL THEN st WHEN near AND who IS NOT NULL THEN CASE family WHEN 'plain' THEN 0 ELSE 4 END ELSE 5 END AS tier, CASE WHEN near AND ct IS NOT NULL THEN cp WHEN st IS NOT NULL THEN sp ELSE 0 END AS pos, ob, op FROM r),
d AS (SELECT *, row_number() OVER (PARTITION BY anchor, ob ORDER BY tier, list_transform(string_split(op, ':'), lambda x: x::BIGINT), other) - 1 AS round FROM q),
e AS (SELECT *, ([0, 1, 2, 4, 6, 8, 20])[tier + 1] + round * ([2, 3, 3, 5, 6, 8, 10])[tier + 1] AS score FROM d)
SELECT anchor, other, row_number() OVER (PARTITION BY anchor ORDER BY score, tier, pos, other) AS n FROM e""")
def tiered_lines(t):
    """The lines linked with each line in the order to open them, books taking turns."""
    return K.turns(_tiered(t))

"""Printed lines laid on texts: the benchmark items as pages, and the lines of orders as lines on a page."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.align import Substitutions
from lectern.operators import layout as L
from lectern.registry import query

#: Letters that this print confuses.
LETTERS = Substitutions(("ao", "ec", "ilt", "nh"))
PER_LINE = 5


def printed(t):
    """(lines, texts): each item as a page of two columns, right one first, read with look-alike letters; some lines are not read at all."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    items = t("benchmark").where("text is not null").select(F.col("item_id").alias("page"), words.alias("w"))
    cut = items.withColumn("n", F.ceil(F.size("w") / PER_LINE).cast("int")).where("n > 0").select("page", "n", "w", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("line"))
    own = F.array_join(F.slice("w", F.col("line") * PER_LINE + 1, PER_LINE), " ")
    lost = F.regexp_replace(own, r"\S", "#")
    read = F.when(F.col("line") % 7 == 5, lost).when(F.col("line") % 3 == 1, F.translate(own, "aeiln", "octth")).otherwise(own)
    half = F.ceil(F.col("n") / 2)
    column = (F.col("line") >= half).cast("int")
    x1, y0 = F.lit(1000.0) - column * 500, (F.col("line") - column * half) * 40.0
    lines = cut.select("page", "line", read.alias("read"), (x1 - F.length(own) * 9.0).alias("x0"), x1.alias("x1"), y0.alias("y0"), (y0 + 20.0).alias("y1"))
    return lines, items.select("page", F.array_join("w", " ").alias("text"))


@query("lines_placed", "L1 L4 L5 L7", None)
def lines_placed(t):
    """Where each printed line sits in its page's text: candidates by look-alike letters, the best chain down the columns, gaps filled."""
    return L.placed_lines(*printed(t), LETTERS).select("page", "line", "start", "end", F.round("likeness", 6).alias("likeness"), "filled")


@query("lines_broken", "L8", None)
def lines_broken(t):
    """The words that each printed line holds."""
    return L.broken_lines(*printed(t), LETTERS)


_CLAIMS = """
c AS (SELECT l_orderkey AS page, l_suppkey % 3 AS source, l_linenumber AS line, l_linenumber * 4 - l_partkey % 3 AS a, l_linenumber * 4 - l_partkey % 3 + CAST(l_quantity AS BIGINT) % 7 AS b, l_discount AS likeness FROM lineitem),
w AS (SELECT page, unnest(range(min(a), max(b) + 3)) AS word FROM c GROUP BY 1),
e AS (SELECT page, unnest(range(a, b)) AS word, line, ROW(-likeness, b - a, source, line) AS k FROM c WHERE b > a),
o AS (SELECT page, word, arg_min(line, k) AS line FROM e GROUP BY 1, 2),
f AS (SELECT w.page, w.word, line FROM w LEFT JOIN o USING (page, word)),
s AS (SELECT *, last_value(CASE WHEN line IS NOT NULL THEN word END IGNORE NULLS) OVER p AS pw, last_value(line IGNORE NULLS) OVER p AS pl, first_value(CASE WHEN line IS NOT NULL THEN word END IGNORE NULLS) OVER q AS qw, first_value(line IGNORE NULLS) OVER q AS ql FROM f
  WINDOW p AS (PARTITION BY page ORDER BY word ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), q AS (PARTITION BY page ORDER BY word ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
g AS (SELECT *, CASE WHEN word - pw <= 6 AND qw - word <= 6 AND ql BETWEEN pl AND pl + 1 THEN CASE WHEN word - pw <= qw - word THEN pl ELSE ql END END AS guess FROM s)"""


def _claims(t):
    a = F.col("l_linenumber").cast("long") * 4 - F.col("l_partkey") % 3
    c = t("lineitem").select(F.col("l_orderkey").alias("page"), (F.col("l_suppkey") % 3).alias("source"), F.col("l_linenumber").alias("line"), a.alias("first_word"), (a + F.col("l_quantity").cast("long") % 7).alias("last_word"), F.col("l_discount").alias("likeness"))
    words = c.groupBy("page").agg(F.min("first_word").alias("a"), F.max("last_word").alias("b")).select("page", F.explode(F.sequence("a", F.col("b") + 2)).alias("word"))
    return L.one_line_a_word(c, words)


@query("words_on_lines", "L14", f"WITH {_CLAIMS} SELECT page, word, coalesce(line, guess) AS line, line IS NULL AND guess IS NOT NULL AS guessed FROM g")
def words_on_lines(t):
    """One line for each word from rival claims, with estimates between neighbours that agree."""
    return _claims(t)[0]


@query("pages_whole", "L14 A28", f"WITH {_CLAIMS} SELECT page, count(*) AS n, count(coalesce(line, guess)) AS placed, bool_and(coalesce(line, guess) IS NOT NULL) AS whole FROM g GROUP BY 1")
def pages_whole(t):
    """Whether every word of a page has a line."""
    return _claims(t)[1]


_BOXES = """
b AS (SELECT l_orderkey AS page, l_linenumber AS n, min(l_partkey) AS part, max(CAST(l_quantity AS BIGINT)) AS q FROM lineitem GROUP BY 1, 2),
l AS (SELECT page, n AS line, p_type AS before, p_brand AS after, 300.0::DOUBLE AS x0, 300.0::DOUBLE + q * 10 AS x1, n * 30.0::DOUBLE AS y0, n * 30.0::DOUBLE + 20 AS y1 FROM b JOIN part ON p_partkey = part WHERE n % 2 = 1),
p AS (SELECT page, n AS piece, CASE WHEN q % 2 = 0 THEN p_type ELSE p_brand END AS said, CASE WHEN q % 2 = 0 THEN 300.0::DOUBLE + part % 50 * 10 ELSE 250.0::DOUBLE - part % 9 * 10 END AS x0, CASE WHEN q % 2 = 0 THEN 300.0::DOUBLE + part % 50 * 10 ELSE 250.0::DOUBLE - part % 9 * 10 END + 40 AS x1, (n - 1) * 30.0::DOUBLE + part % 25 AS y0, (n - 1) * 30.0::DOUBLE + part % 25 + 20 AS y1 FROM b JOIN part ON p_partkey = part WHERE n % 2 = 0 AND length(CASE WHEN q % 2 = 0 THEN p_type ELSE p_brand END) >= 3),
m AS (SELECT p.page, piece, line, said, before, after, greatest(0, least(p.y1, l.y1) - greatest(p.y0, l.y0)) / greatest(1, least(p.y1 - p.y0, l.y1 - l.y0)) AS share, CASE WHEN p.x0 >= l.x1 - 5 AND p.x0 - l.x1 <= 120 THEN 'right' WHEN p.x1 <= l.x0 + 5 AND l.x0 - p.x1 <= 120 THEN 'left' END AS side, p.x0 AS px0, p.x1 AS px1, l.x0 AS lx0, l.x1 AS lx1 FROM p JOIN l USING (page)),
k AS (SELECT *, CASE side WHEN 'right' THEN abs(px0 - lx1) ELSE abs(lx0 - px1) END AS far FROM m WHERE share >= 0.3 AND side IS NOT NULL AND levenshtein(said, CASE side WHEN 'right' THEN before[greatest(length(before) - length(said) + 1, 1):] ELSE after[1:length(said)] END) <= 0.2 * length(said)),
o AS (SELECT page, piece, min(ROW(-share, far, line, side)) AS r FROM k GROUP BY 1, 2),
z AS (SELECT page, piece, r[2] AS far, r[3] AS line, r[4] AS side, row_number() OVER (PARTITION BY page, r[3], r[4] ORDER BY r[2], piece) AS t FROM o)"""


@query("leftovers_attached", "M83 M84", f"WITH {_BOXES} SELECT page, piece, line, side FROM z WHERE t = 1")
def leftovers_attached(t):
    """Pieces beside a line that go on with its text, each at one line and one piece at each side."""
    b = t("lineitem").groupBy(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("n")).agg(F.min("l_partkey").alias("p_partkey"), F.max(F.col("l_quantity").cast("long")).alias("q")).join(t("part").select("p_partkey", "p_type", "p_brand"), "p_partkey")
    y = F.col("n") * 30.0
    lines = b.where("n % 2 = 1").select("page", F.col("n").alias("line"), F.col("p_type").alias("before"), F.col("p_brand").alias("after"), F.lit(300.0).alias("x0"), (F.lit(300.0) + F.col("q") * 10).alias("x1"), y.alias("y0"), (y + 20).alias("y1"))
    even = F.col("q") % 2 == 0
    x, at = F.when(even, F.lit(300.0) + F.col("p_partkey") % 50 * 10).otherwise(F.lit(250.0) - F.col("p_partkey") % 9 * 10), (F.col("n") - 1) * 30.0 + F.col("p_partkey") % 25
    pieces = b.where("n % 2 = 0").select("page", F.col("n").alias("piece"), F.when(even, F.col("p_type")).otherwise(F.col("p_brand")).alias("read"), x.alias("x0"), (x + 40).alias("x1"), at.alias("y0"), (at + 20).alias("y1"))
    return L.attached(pieces, lines)


@query("words_glossed", "F45", None)
def words_glossed(t):
    """Items laid on the words of every turn: some words are missing, some in short spelling, some two in one item."""
    from lectern.functions.gloss import gloss_rows

    c = t("conversations").where("text is not null").select("conv_id", "turn", F.filter(F.split("text", r"\s+"), lambda w: w != "").alias("w"))
    short = lambda w: F.translate(w, "ei", "")
    item = lambda w, i: F.when(i % 5 == 1, F.lit(None).cast("string")).when(i % 5 == 2, F.concat(short(w), F.lit(" "), F.coalesce(F.get("w", i + 1), F.lit("")))).when(i % 5 == 3, F.lit(None)).otherwise(w)
    items = F.filter(F.transform("w", item), lambda x: x.isNotNull())
    return c.select("conv_id", "turn", F.explode(gloss_rows(F.col("w"), items)).alias("r")).select("conv_id", "turn", "r.*")

"""Words and their readings, points, glossaries; citations and columns of a page."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import layout as Y
from lectern.functions import text as X
from lectern.functions.points import vowel_words
from lectern.functions.segments import line_segments
from lectern.operators.readings import readings
from lectern.operators.research import cited_pages
from lectern.operators.respelling import respell
from lectern.plans.views import TALKS, talks
from lectern.registry import query


@query("word_readings", "F20 F21", None)
def word_readings(t):
    """The readings of every numeral that an order's number writes, and of some words."""
    numbers = t("orders").select(X.hebrew_numeral((F.col("o_orderkey") % 499 + 1).cast("int")).alias("word"))
    some = t.values([("הַסֵּפֶר",), ("תרומת",), ("הגיע",), ("והתקדשו",), ("א",)], "word string")
    return readings(numbers.unionByName(some))


@query("vowels_transferred", "F43", r"""
WITH w AS (SELECT item_id, list_filter(list_transform(string_split_regex(lower(text), '\s+'), lambda x: translate(regexp_replace(x, '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'אבגדהוזחטיכלמנסעפצקרשתאבגד')), lambda x: x <> '') AS w FROM benchmark),
k AS (SELECT item_id, list_transform(w, lambda x, i: x || chr((1488 + (i - 1) % 8)::INT)) AS w FROM w)
SELECT item_id, CASE WHEN len(w) > 1 THEN array_to_string(list_transform(w, lambda x, i: CASE WHEN (i - 1) % 5 = 0 THEN '' ELSE regexp_replace(x, '([א-ת])', '\1ָ', 'g') END), '|') END AS words FROM k""")
def vowels(t):
    """Words of the items in other letters, with the points of a copy that lacks every fifth word."""
    letters = F.transform(F.split(F.lower("text"), r"\s+"), lambda x: F.translate(F.regexp_replace(x, "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", "אבגדהוזחטיכלמנסעפצקרשתאבגד"))
    # each word has a letter of its own among its neighbours at its end
    own = F.transform(F.filter(letters, lambda x: x != ""), lambda x, i: F.concat(x, F.get(F.array(*map(F.lit, "אבגדהוזח")), i % 8)))
    rows = t("benchmark").select("item_id", own.alias("w"))
    copy = F.array_join(F.filter(F.transform("w", lambda x, i: F.when(i % 5 != 0, F.regexp_replace(x, "([א-ת])", "$1ָ"))), lambda x: x.isNotNull()), " ")
    return rows.select("item_id", F.array_join("w", " ").alias("text"), copy.alias("copy")).select("item_id", F.array_join(vowel_words("text", "copy"), "|").alias("words"))


@query("phrase_glossary", "M16", f"""
WITH p(id, phrase, meaning) AS (VALUES ('p1', 'of the', 'belonging'), ('p2', 'in the', 'place'), ('p3', 'never said at all', 'nothing'))
SELECT id, phrase, meaning, count(ref) AS n, coalesce(string_agg(ref, '|' ORDER BY seq), '') AS refs FROM p LEFT JOIN {TALKS} c ON contains(lower(c.text), phrase) GROUP BY 1, 2, 3""")
def glossary(t):
    """Each phrase with the passages that have it; the phrases are a fixed few, so a passage is read once for all of them."""
    phrases = [("p1", "of the", "belonging"), ("p2", "in the", "place"), ("p3", "never said at all", "nothing")]
    held = F.array(*[F.when(F.contains(F.lower("text"), F.lit(p)), F.lit(i)) for i, p, _ in phrases])
    found = talks(t).select("ref", "seq", F.explode(F.array_compact(held)).alias("id")).groupBy("id").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list(F.struct("seq", "ref")))["ref"], "|").alias("refs"))
    return t.values(phrases, "id string, phrase string, meaning string").join(found, "id", "left").select("id", "phrase", "meaning", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("refs", F.lit("")).alias("refs"))


@query("line_conditions", "M77", """
WITH l AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'prayer' ELSE 'note' END AS kind,
  CASE WHEN turn % 3 = 0 THEN 'en' || conv_id % 4 END AS en0, (turn % 2)::INT AS n_en, CASE WHEN conv_id % 5 = 0 THEN 'he' || turn % 4 END AS he0, (conv_id % 3)::INT AS n_he, conv_id % 2 = 0 AS untagged FROM conversations)
SELECT conv_id, turn, CASE WHEN kind <> 'prayer' THEN NULL WHEN n_en > 0 AND en0 IS NOT NULL AND NOT (n_he > 0 AND he0 IS NOT NULL) THEN en0 WHEN n_he = 1 AND he0 IS NOT NULL THEN he0 WHEN n_he > 1 AND he0 IS NOT NULL AND untagged THEN he0 WHEN n_he = 0 AND n_en = 1 AND en0 IS NOT NULL THEN en0 END AS condition FROM l""")
def line_conditions(t):
    """The time for which a whole line is said, from the tags of its phrases in both languages."""
    tag = lambda c: F.struct(F.lit("when").alias("kind"), c.alias("condition"))
    en0, he0 = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("en"), F.col("conv_id") % 4)), F.when(F.col("conv_id") % 5 == 0, F.concat(F.lit("he"), F.col("turn") % 4))
    phrases = lambda n, first, rest: F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.when(i < n, F.when(i == 0, F.when(first.isNotNull(), tag(first))).otherwise(F.when(~rest, tag(F.lit("later"))))))
    n_en, n_he = (F.col("turn") % 2).cast("int"), (F.col("conv_id") % 3).cast("int")
    rows = t("conversations").select("conv_id", "turn", F.when(F.col("role") == "user", "prayer").otherwise("note").alias("kind"), n_en.alias("n_en"), n_he.alias("n_he"), phrases(n_en, en0, F.lit(False)).alias("en"), phrases(n_he, he0, F.col("conv_id") % 2 == 0).alias("he"))
    return rows.select("conv_id", "turn", Y.line_condition(F.col("kind"), F.slice("en", F.lit(1), F.col("n_en")), F.slice("he", F.lit(1), F.col("n_he"))).alias("condition"))


_MEASURE = """SELECT l_orderkey, l_linenumber, 600 + (l_partkey % 300)::DOUBLE AS width, 0.5::DOUBLE AS main_share, 0.48::DOUBLE AS top_share, 10::DOUBLE AS pad_h, 8::DOUBLE AS pad_v, 16::DOUBLE AS line,
 (l_quantity * 20)::DOUBLE AS main, CASE WHEN l_linenumber % 4 = 0 THEN 0 ELSE (l_partkey % 900)::DOUBLE END AS inner_, CASE WHEN l_linenumber % 5 = 0 THEN 0 ELSE (l_suppkey * 7 % 1100)::DOUBLE END AS outer_ FROM lineitem"""


@query("column_spacers", "L19", f"""
WITH m AS ({_MEASURE}), w AS (SELECT *, main_share * width - 2 * pad_h AS mid, width * (1 - main_share) / 2 - pad_h AS side, width * top_share - pad_h AS top, 4.3 * line AS s FROM m),
a AS (SELECT *, 4 * line * top AS lost, inner_ * side - 4 * line * top AS ia, outer_ * side - 4 * line * top AS oa, main * mid AS ma FROM w),
k AS (SELECT *, (ma + least(ia, oa)) / (mid + side) AS bh, CASE WHEN inner_ <= 0 AND outer_ <= 0 THEN 'none' WHEN ia / side <= s AND oa / side <= s THEN 'halves' WHEN inner_ <= s THEN 'outer alone' WHEN outer_ <= s THEN 'inner alone'
  WHEN main <= ia / side AND main <= oa / side THEN 'around' ELSE 'block' END AS shape FROM a),
r AS (SELECT *, CASE WHEN shape = 'block' AND bh < greatest(ia, oa) / side THEN 'stairs' ELSE shape END AS form, (ma + least(ia, oa) - pad_h * (bh - least(ia, oa) / side)) / (mid + side) AS step FROM k)
SELECT l_orderkey, l_linenumber, round(CASE form WHEN 'none' THEN 0 WHEN 'halves' THEN greatest(inner_ * side / top, outer_ * side / top, 0) ELSE s END, 4) AS start,
 round(CASE form WHEN 'outer alone' THEN inner_ WHEN 'inner alone' THEN (ia + lost - width * 4 * line) / side WHEN 'around' THEN main WHEN 'stairs' THEN CASE WHEN ia <= oa THEN ia / side ELSE step END WHEN 'block' THEN ia / side ELSE 0 END, 4) AS inner_height,
 round(CASE form WHEN 'outer alone' THEN (oa + lost - width * 4 * line) / side WHEN 'inner alone' THEN outer_ WHEN 'around' THEN main WHEN 'stairs' THEN CASE WHEN ia <= oa THEN step ELSE oa / side END WHEN 'block' THEN oa / side ELSE 0 END, 4) AS outer_height,
 round(CASE form WHEN 'around' THEN greatest(0, (least(ia, oa) - main * side - side * pad_v) / top) ELSE 0 END, 4) AS below, CASE form WHEN 'halves' THEN 3 WHEN 'outer alone' THEN 1 WHEN 'inner alone' THEN 2 ELSE 0 END AS exception FROM r""")
def spacers(t):
    """The spacers of a page for texts of many heights."""
    q = F.col
    m = t("lineitem").select("l_orderkey", "l_linenumber", (600 + q("l_partkey") % 300).cast("double").alias("width"), (q("l_quantity") * 20).cast("double").alias("main"), F.when(q("l_linenumber") % 4 == 0, 0).otherwise(q("l_partkey") % 900).cast("double").alias("inner"), F.when(q("l_linenumber") % 5 == 0, 0).otherwise(q("l_suppkey") * 7 % 1100).cast("double").alias("outer"))
    s = m.select("l_orderkey", "l_linenumber", Y.spacers(q("width"), F.lit(0.5), F.lit(0.48), F.lit(10.0), F.lit(8.0), F.lit(16.0), q("main"), q("inner"), q("outer")).alias("s"))
    return s.select("l_orderkey", "l_linenumber", *[F.round(q(f"s.{a}"), 4).alias(b) for a, b in (("start", "start"), ("inner", "inner_height"), ("outer", "outer_height"), ("end", "below"))], "s.exception")


@query("research_pages", "R25", r"""
WITH c AS (SELECT page_id % 40 AS run, page_id AS pos, url, regexp_extract(html, '<title>([^<]*)', 1) AS title, trim(regexp_replace(substring(regexp_replace(html, '<[^>]*>', ' ', 'g'), 1 + (page_id % 50)::INT, 60), '\s+', ' ', 'g')) AS cited FROM pages),
k AS (SELECT *, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\.', '') AS host FROM c WHERE length(cited) >= 12 AND url IS NOT NULL),
e AS (SELECT run, host || regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1), '/+$', '') || regexp_extract(url, '(\?[^#]*)', 1) AS key, host, cited, min(pos) AS pos, arg_min(title, pos) FILTER (WHERE title <> '') AS title, min(pos) FILTER (WHERE title <> '') AS t_at FROM k GROUP BY 1, 2, 3, 4),
p AS (SELECT run, key, host, min(pos) AS pos, arg_min(title, t_at) AS title, substring(string_agg(cited, ' … ' ORDER BY pos, cited), 1, 300) AS excerpt FROM e GROUP BY 1, 2, 3)
SELECT run, n, key, coalesce(title, host) AS title, site, excerpt FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY pos, key) AS n, upper(host) AS site FROM p WHERE length(host) % 2 = 0) WHERE n <= 5""")
def research(t):
    """The first pages of trusted hosts that each run cited, with what it cited of them."""
    text = F.regexp_replace("html", "<[^>]*>", " ")
    cited = t("pages").select((F.col("page_id") % 40).alias("run"), F.col("page_id").alias("at"), "url", F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"), F.substring(text, (1 + F.col("page_id") % 50).cast("int"), F.lit(60)).alias("cited"))
    hosts = t("pages").select(X.host_of(F.col("url")).alias("host")).distinct().where("length(host) % 2 = 0").select("host", F.upper("host").alias("site"))
    return cited_pages(cited, hosts, 5, 300)


LEXICON = [("the", "thuh", False), ("of the", "uv thuh", False), ("and", "und", False), ("in", "een", True), ("Was", "Wuz", True)]


@query("respelled", "F41", None)
def respelled(t):
    """Every line of talk with a few words put as they are said."""
    lines = t("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return respell(lines, t.values(LEXICON, "written string, say string, exact boolean"))


@query("line_segments", "F51", """
SELECT p_partkey, n, kind, text, label FROM part, LATERAL (
  SELECT * FROM (VALUES (0, 0, 'rise', '▴', NULL), (0, 1, 'text', p_name || ' ', NULL), (0, 2, 'response', '(All: ' || p_brand || ')', 'All'),
    (1, 0, 'text', p_name || ' ', NULL), (1, 1, 'when', '/In winter: ' || p_type || './', 'In winter'), (1, 2, 'text', ' b/c: d/', NULL),
    (2, 0, 'gender', 'מוֹדֶה/מוֹדָה/', 'speaker'), (2, 1, 'text', ' ' || p_name, NULL), (3, 0, 'gender', 'בֶּן/בַּת', 'other')) v(k, n, kind, text, label) WHERE k = p_size % 4)""")
def segmented(t):
    """Lines with marks to rise, answers, words for a season and forms for men and women, cut into segments."""
    line = F.expr("CASE p_size % 4 WHEN 0 THEN concat('▴', p_name, ' (All: ', p_brand, ')') WHEN 1 THEN concat(p_name, ' /In winter: ', p_type, './ b/c: d/') WHEN 2 THEN concat('מוֹדֶה/מוֹדָה/ ', p_name) ELSE 'בֶּן/בַּת' END")
    each = t("part").select("p_partkey", line.alias("line")).select("p_partkey", F.posexplode(line_segments(["In winter", "In summer"])("line")).alias("n", "s"))
    return each.select("p_partkey", "n", "s.kind", "s.text", "s.label")

"""Scalar text functions over whole tables; where the corpus has no such texts they are made from its columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from lectern.functions import refs as R
from lectern.functions import text as X
from lectern.functions.udfs import clean_html, fnv1a, fold_name, nested_footnotes, paragraphs
from lectern.plans.views import PASSAGES, passages, talks
from lectern.registry import query


# A part's name in other letters with a point after each, as a text with marks.
_POINTED = "regexp_replace(translate(p_name, 'abcdefghijklmnopqrstuvwxyz ', 'אבגדהוזחטיכלמנסעפצקרשתךםןף־'), '([א-ת])', '\\1ָ', 'g') || ' ' || p_type || '׃'"


@query("plain_forms", "F4 F5 F6 F57", f"""
SELECT p_partkey, lower(regexp_replace(regexp_replace(v, '[־׀׃׳״]', ' ', 'g'), '[֑-ׇֽֿׁׂׅׄ]', '', 'g')) AS plain, translate(regexp_replace(v, '[^א-ת]', '', 'g'), 'ךםןףץ', 'כמנפצ') AS letters
FROM (SELECT p_partkey, {_POINTED} AS v FROM part)""")
def plain_forms(t):
    v = F.concat(F.regexp_replace(F.translate("p_name", "abcdefghijklmnopqrstuvwxyz ", "אבגדהוזחטיכלמנסעפצקרשתךםןף־"), "([א-ת])", "$1ָ"), F.lit(" "), "p_type", F.lit("׃"))
    return t("part").select("p_partkey", X.plain(v).alias("plain"), X.letters(v).alias("letters"))


@query("normal_refs", "F7 M56 M55", "SELECT c_custkey, trim(regexp_replace(lower('  ' || c_name || '  X '), '\\s+', ' ', 'g')) AS ref FROM customer")
def normal_refs(t):
    return t("customer").select("c_custkey", R.normal_ref(F.concat(F.lit("  "), "c_name", F.lit("  X "))).alias("ref"))


@query("stems", "F8 F9", r"""
WITH w AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS w FROM documents) WHERE w <> '')
SELECT w, CASE WHEN NOT regexp_matches(w, '^[a-z]+$') THEN w WHEN length(w) > 4 AND w LIKE '%ies' THEN substr(w, 1, length(w) - 3) || 'y' WHEN length(w) > 4 AND regexp_matches(w, '(ch|sh|s|x|z)es$') THEN substr(w, 1, length(w) - 2) WHEN length(w) > 4 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN substr(w, 1, length(w) - 1) ELSE w END AS stem FROM w""")
def stems(t):
    w = t("documents").select(F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")).alias("w")).where("w <> ''").distinct()
    return w.select("w", X.stem(F.col("w")).alias("stem"))


@query("clipped", "F10 F11", """
WITH c AS (SELECT doc_id, text, substr(text, 1, 900) AS cut FROM documents), e AS (SELECT *, greatest(CASE WHEN instr(reverse(cut), ' .') = 0 THEN -1 ELSE length(cut) - instr(reverse(cut), ' .') - 1 END, CASE WHEN instr(reverse(cut), ' ;') = 0 THEN -1 ELSE length(cut) - instr(reverse(cut), ' ;') - 1 END) AS stop FROM c)
SELECT doc_id, CASE WHEN length(text) <= 900 THEN text WHEN stop > 450 THEN substr(cut, 1, stop + 1) || ' …' ELSE cut || ' …' END AS clip FROM e""")
def clipped(t):
    return t("documents").select("doc_id", X.clip(F.col("text"), 900, 0.5, (". ", "; ")).alias("clip"))


@query("ref_parts", "F12 F14 M24 M25", f"""
SELECT ref, regexp_extract(ref, '^(.+):', 1) AS section, regexp_extract(ref, '^(.*?) ([0-9]+[ab]?(?::[0-9]+)*)$', 1) AS book, regexp_extract(ref, '^(.*?) ([0-9]+[ab]?(?::[0-9]+)*)$', 2) AS place, regexp_replace(ref, '[0-9]+$', '') || (CAST(regexp_extract(ref, '([0-9]+)$', 1) AS BIGINT) + 1) AS next FROM {PASSAGES}""")
def ref_parts(t):
    ref = F.col("ref")
    nxt = F.concat(F.regexp_replace(ref, "[0-9]+$", ""), (F.regexp_extract(ref, "([0-9]+)$", 1).cast("long") + 1).cast("string"))
    return passages(t).select("ref", R.section_of(ref).alias("section"), R.book_of(ref).alias("book"), R.place_of(ref).alias("place"), nxt.alias("next"))


@query("ref_ranges", "F13 F15", """
WITH n AS (SELECT DISTINCT l_linenumber % 4 AS k, 'Order ' || l_orderkey % 500 AS o, l_partkey % 20 + 1 AS a, l_suppkey % 9 + 1 AS b, l_suppkey % 9 + 1 + CAST(l_quantity AS BIGINT) AS c FROM lineitem)
SELECT CASE k WHEN 0 THEN o || ' ' || a || ':' || b || '-' || c WHEN 1 THEN o || ' ' || a || ':' || b || '-' || (a + 1) || ':' || c WHEN 2 THEN o || ' ' || a || 'a:' || b || '–' || c ELSE o || ' ' || a END AS ref,
  CASE k WHEN 2 THEN o || ' ' || a || 'a:' || b WHEN 3 THEN o || ' ' || a ELSE o || ' ' || a || ':' || b END AS first,
  CASE k WHEN 0 THEN o || ' ' || a || ':' || c WHEN 1 THEN o || ' ' || (a + 1) || ':' || c WHEN 2 THEN o || ' ' || a || 'a:' || c END AS last,
  CASE k WHEN 2 THEN o || ' ' || a || 'a:' || b || '–' || c WHEN 3 THEN o || ' ' || a ELSE o || ' ' || a || ':' || b END AS link FROM n""")
def ref_ranges(t):
    """References of four forms, ranges among them, with their ends."""
    k, a, b = F.col("l_linenumber") % 4, F.col("l_partkey") % 20 + 1, F.col("l_suppkey") % 9 + 1
    c = b + F.col("l_quantity").cast("long")
    n = t("lineitem").select(k.alias("k"), F.concat(F.lit("Order "), F.col("l_orderkey") % 500).alias("o"), a.alias("a"), b.alias("b"), c.alias("c")).distinct()
    ref = F.when(F.col("k") == 0, F.expr("concat(o, ' ', a, ':', b, '-', c)")).when(F.col("k") == 1, F.expr("concat(o, ' ', a, ':', b, '-', a + 1, ':', c)")).when(F.col("k") == 2, F.expr("concat(o, ' ', a, 'a:', b, '–', c)")).otherwise(F.expr("concat(o, ' ', a)"))
    ref = n.select(ref.alias("ref"))
    return ref.select("ref", R.range_start(F.col("ref")).alias("first"), R.range_end(F.col("ref")).alias("last"), R.link_start(F.col("ref")).alias("link"))


@query("addresses", "F16 W10 M12", """
SELECT p_partkey, kind, CASE kind WHEN 'Talmud' THEN (n // 2 + 1) || substr('ab', (n % 2 + 1)::INT, 1) WHEN 'Folio' THEN (n // 4 + 1) || substr('abcd', (n % 4 + 1)::INT, 1) ELSE (n + 1)::VARCHAR END AS address
FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Talmud' WHEN 1 THEN 'Folio' ELSE 'Integer' END AS kind, p_partkey + p_size AS n FROM part)""")
def addresses(t):
    kind = F.when(F.col("p_partkey") % 3 == 0, "Talmud").when(F.col("p_partkey") % 3 == 1, "Folio").otherwise("Integer")
    return t("part").select("p_partkey", kind.alias("kind"), R.address(kind, F.col("p_partkey"), F.col("p_size")).alias("address"))


@query("hebrew_numbers", "F23 F24 F22", """
WITH n AS (SELECT o_orderkey, (o_orderkey % 519 + 1)::INT AS n FROM orders)
SELECT o_orderkey, CASE WHEN n >= 500 THEN n::VARCHAR ELSE (['', 'ק', 'ר', 'ש', 'ת'])[n // 100 + 1] || CASE n % 100 WHEN 15 THEN 'טו' WHEN 16 THEN 'טז' ELSE (['', 'י', 'כ', 'ל', 'מ', 'נ', 'ס', 'ע', 'פ', 'צ'])[n % 100 // 10 + 1] || (['', 'א', 'ב', 'ג', 'ד', 'ה', 'ו', 'ז', 'ח', 'ט'])[n % 10 + 1] END END AS letters,
  CASE WHEN n < 500 THEN n END AS back FROM n""")
def hebrew(t):
    """Numbers written in letters and read again; from five hundred on they stay digits."""
    he = X.hebrew_numeral((F.col("o_orderkey") % 519 + 1).cast("int"))
    return t("orders").select("o_orderkey", he.alias("letters"), X.hebrew_number(he).alias("back"))


@query("skeleton_keys", "F25 F27", None)
def skeletons(t):
    """The spelling keys of all words of the items and of the parts' names."""
    words = t("benchmark").select(F.explode(F.split("text", r"\s+")).alias("word")).unionByName(t("part").select(F.explode(F.split("p_name", " ")).alias("word"))).distinct()
    return words.select("word", X.skeleton(F.col("word")).alias("key"))


@query("edit_distances", "F26 F27 F28 L13", "SELECT a.n_name AS a, b.n_name AS b, least(levenshtein(a.n_name, b.n_name), 6) AS d, round(1 - levenshtein(a.n_name, b.n_name) / greatest(length(a.n_name), length(b.n_name)), 6) AS likeness FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def distances(t):
    n = t("nation").select("n_regionkey", "n_name")
    pairs = n.withColumnRenamed("n_name", "a").join(n.withColumnRenamed("n_name", "b"), "n_regionkey")
    return pairs.select("a", "b", X.edit_distance(F.col("a"), F.col("b"), 5).alias("d"), F.round(X.likeness(F.col("a"), F.col("b")), 6).alias("likeness"))


@query("angle_brackets", "F3", """
SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN p_name || ' ' || p_brand WHEN 2 THEN p_name || '. ' || p_brand WHEN 4 THEN p_name END AS out FROM part""")
def angle(t):
    """Text with insertions that pair off, that do not, that stand between two stops, that are all there is, and without any."""
    k = F.col("p_size") % 5
    v = F.expr("CASE p_size % 5 WHEN 0 THEN concat(p_name, ' <', p_type, '> ', p_brand) WHEN 1 THEN concat(p_name, ' < ', p_type) WHEN 2 THEN concat(p_name, ' <x>. , ', p_brand) WHEN 3 THEN concat('<', p_type, '>') ELSE p_name END")
    return t("part").where(k.isNotNull()).select("p_partkey", X.without_insertions(v).alias("out"))


@query("safe_titles", "F32", r"""
SELECT page_id, CASE WHEN x = '' THEN 'Untitled' ELSE x END AS title FROM (SELECT page_id, trim(substr(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(coalesce(regexp_extract(html, '<title>(.*?)</title>', 1), ''), '<[^>]+>', '', 'g'), '\s+', ' ', 'g')), '\s*:\s*', ' - ', 'g'), '\s+-+\s+', ' - ', 'g'), 1, 180)) AS x FROM pages)""")
def titles(t):
    return t("pages").select("page_id", X.clean_title(F.regexp_extract("html", "<title>(.*?)</title>", 1)).alias("title"))


@query("url_parts", "F54 F55 U8 P19", r"""
SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\.', '') AS host, array_to_string((list_filter(string_split(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1), '/'), lambda x: x <> ''))[1:2], '/') AS section FROM pages""")
def url_parts(t):
    u = F.col("url")
    return t("pages").select("page_id", X.host_of(u).alias("host"), X.url_section(u, 2).alias("section"))


@query("speech_text", "F40 F48 F50", r"SELECT conv_id, turn, trim(regexp_replace(regexp_replace(text, '[*_#>`]+', '', 'g'), '\s+', ' ', 'g')) AS said, substr(text, 1, 48) AS title FROM conversations")
def speech(t):
    said = F.trim(F.regexp_replace(F.regexp_replace("text", "[*_#>`]+", ""), r"\s+", " "))
    return t("conversations").select("conv_id", "turn", said.alias("said"), F.substring("text", 1, 48).alias("title"))


@query("labels_split", "F53 J28 M20", "SELECT p_partkey, list_transform(string_split(p_type, ' '), lambda x: trim(x))[1] AS head, len(string_split(p_type, ' ')) AS n FROM part")
def labels(t):
    parts = F.transform(F.split("p_type", " "), lambda x: F.trim(x))
    return t("part").select("p_partkey", parts[0].alias("head"), F.size(parts).cast("long").alias("n"))


@query("js_words", "F58", "SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\x0b\\x0c]+'), lambda x: x <> '')) AS n FROM documents")
def js_words(t):
    """White space as the reference's platform counts it: also U+3000 and U+FEFF, not U+200B."""
    space = "[\\t\\n\\x0b\\f\\r    -     　﻿]+"
    return t("documents").select("doc_id", F.size(F.filter(F.split("text", space), lambda x: x != "")).cast("long").alias("n"))


@query("conditions_by_rules", "F52 D18 M78 M79", """
WITH r(n, pattern, label) AS (VALUES (1, 'version', 'licence'), (2, '\\|', 'table'), (3, 'the', 'english'), (4, ' de ', 'romance'))
SELECT doc_id, coalesce((SELECT arg_min(label, n) FROM r WHERE regexp_matches(lower(text), pattern)), 'unknown') AS label FROM documents""")
def conditions(t):
    """Rules as rows, the first that fits; unknown is a value of its own."""
    text, label = F.lower("text"), F.lit("unknown")
    for pattern, name in reversed([("version", "licence"), (r"\|", "table"), ("the", "english"), (" de ", "romance")]):
        label = F.when(text.rlike(pattern), name).otherwise(label)
    return t("documents").select("doc_id", label.alias("label"))


@query("article_paragraphs", "F33 F34 F35 F36 S13 S14", None)
def article_paragraphs(t):
    p = t("pages").select("page_id", paragraphs("html").alias("p"))
    return p.select("page_id", F.posexplode("p").alias("n", "text"))


@query("cleaned_html", "F1 F2", None)
def cleaned(t):
    return t("pages").select("page_id", clean_html(nested_footnotes("html")).alias("text"))


@query("word_fingerprints", "F38 F29 F30", None)
def fingerprints(t):
    return t("documents").select("doc_id", fnv1a("text").alias("fnv"), fold_name("text").alias("fold"))




@query("speech_pieces", "F39", None)
def speech_pieces(t):
    from lectern.functions import parse

    @F.pandas_udf("array<string>")
    def pieces(text: pd.Series) -> pd.Series:
        return text.map(parse.speech_pieces, na_action="ignore")

    return t("conversations").select("conv_id", "turn", F.posexplode(pieces("text")).alias("n", "piece"))


@query("parts_of_words", "W14 M22", None)
def parts_of_words(t):
    """Texts in parts of about seventy words that end at a sentence, and put together again."""
    from lectern.operators.packing import parts_of

    @F.pandas_udf("array<string>")
    def parts(text: pd.Series) -> pd.Series:
        return text.map(lambda x: [" ".join(p) for p in parts_of(x.split())], na_action="ignore")

    return t("documents").select("doc_id", F.posexplode(parts("text")).alias("n", "part"))


_REF = "'Conv ' || conv_id || ':' || turn"


@query("replies_parsed", "R10 F46 F47 F49 F18 F19 N12 T17", f"""
SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '{{"refs": ["' || {_REF} || '"], "english": ["' || role || '"]}}' WHEN 1 THEN '{{"' || {_REF} || '": "one ' || role || '", "B 2": "two\\nthree"}}'
  WHEN 2 THEN '{{"GENERAL": ["whole ' || turn || '"], "WORDS": [["' || role || '", "b"]], "READINGS": [["x", "y", "' || {_REF} || '", "q"]]}}' ELSE '[["text", "see "], ["read", "' || {_REF} || '"], ["text", " there"]]' END AS value FROM conversations""")
def replies_parsed(t):
    """Plans in loose JSON, grouped replies, sectioned replies and marked readings, one for each turn, read as JSON."""
    from lectern.functions import parse

    @F.pandas_udf("string")
    def read(kind: pd.Series, raw: pd.Series, ref: pd.Series) -> pd.Series:
        import json

        ways = {
            0: lambda x, r: parse.loose_object(x), 1: lambda x, r: parse.by_reference(x, {r, "B 2"}),
            2: lambda x, r: parse.reply_sections(x), 3: lambda x, r: parse.read_markers(x, {r.lower(): r}),
        }
        return pd.Series([json.dumps(ways[k](x, r), ensure_ascii=False) for k, x, r in zip(kind, raw, ref, strict=True)])

    raw = F.expr("""CASE turn % 4 WHEN 0 THEN concat('Here: {"refs": ["', ref, '",], “english”: ["', role, '"]} done') WHEN 1 THEN concat('[', ref, ']\\none ', role, '\\n[B 2]\\ntwo\\nthree')
      WHEN 2 THEN concat('GENERAL: whole ', turn, '\\nWORDS:\\n', role, ' | b\\nREADINGS:\\nx | y | ', ref, ' | q') ELSE concat('see [[read ', ref, ']] there') END""")
    rows = talks(t).select("conv_id", "turn", (F.col("turn") % 4).alias("kind"), raw.alias("raw"), "ref")
    return rows.select("conv_id", "turn", read("kind", "raw", "ref").alias("value"))

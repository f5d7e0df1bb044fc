"""Queries without SQL against plain versions of what they say, on the smallest tables."""

from __future__ import annotations

import itertools
import re
import unicodedata

import pytest
import xxhash
from pyspark.sql import functions as F

from lectern import catalog
from lectern.functions import text as X
from lectern.functions.points import vowelled
from lectern.operators import packing
from lectern.operators.readings import readings
from lectern.operators.search import search_books, word_score
from lectern.sources.bson import decode, encode

FOLDER = "/root/testdata/sf0.001"


def rows(spark, name):
    return catalog.queries()[name](spark, FOLDER).collect()


def table(spark, name):
    return spark.read.parquet(f"{FOLDER}/{name}.parquet").collect()


def test_word_fingerprints(spark):
    texts = {r.doc_id: r.text for r in table(spark, "documents")}
    for r in rows(spark, "word_fingerprints"):
        h = 2166136261
        for byte in " ".join(texts[r.doc_id].split()).encode():
            h = (h ^ byte) * 16777619 % 2**32
        bare = "".join(c for c in unicodedata.normalize("NFKD", texts[r.doc_id]) if not unicodedata.combining(c)).lower()
        words = [w for w in re.split(r"[\W_]+", re.sub(r"['\u2019]s\b", "", bare)) if w]
        assert (r.fnv, r.fold) == (format(h, "08x"), " ".join(words))


def test_sample_per_section(spark):
    by = {}
    for r in table(spark, "pages"):
        parts = [p for p in re.sub(r"^[a-zA-Z]+://[^/?#]+([^?#]*).*", r"\1", r.url).split("/") if p]
        signed = xxhash.xxh64(r.url.encode(), seed=42).intdigest()
        by.setdefault(parts[0] if parts else "", []).append((signed - (1 << 64) if signed >> 63 else signed, r.url))
    expect = sorted((s, u) for s, own in by.items() for _, u in sorted(own)[:3])
    assert sorted((r.section, r.url) for r in rows(spark, "sample_per_section")) == expect


def test_parts_of_words(spark):
    texts = {r.doc_id: r.text.split() for r in table(spark, "documents")}
    got = {}
    for r in sorted(rows(spark, "parts_of_words"), key=lambda r: (r.doc_id, r.n)):
        got.setdefault(r.doc_id, []).append(r.part.split())
    for i, parts in got.items():
        assert [w for p in parts for w in p] == texts[i]
        for p in parts[:-1]:
            # a part ends once it is full, or at the first sentence end after forty words
            ends = [n for n in range(40, len(p) + 1) if p[n - 1][-1] in ".:?!\u05c3"]
            assert len(p) == (min(ends[0], 70) if ends else 70) or p is parts[-2] and len(parts[-1]) >= 10
        assert len(parts) == 1 or len(parts[-1]) >= 10


def test_merged_orders(spark):
    lists = [["a", "b", "d"], ["b", "c", "d", "e"], [], ["z", "a"]]
    got = packing.merge_orders(lists)
    assert sorted(got) == ["a", "b", "c", "d", "e", "z"] and got.index("b") < got.index("c") < got.index("d") < got.index("e") and got.index("a") > got.index("b") - 2
    by = {}
    for r in table(spark, "conversations"):
        by.setdefault(r.conv_id, []).append(r.turn)
    for r in rows(spark, "merged_orders"):
        refs = r.refs.split("|") if r.refs else []
        keep = {f"Conv {r.conv_id}:{n}" for n in by[r.conv_id] if n % 2 == 0 or n % 3 != 1}
        assert len(refs) == len(set(refs)) and set(refs) == keep


def test_chained_places(spark):
    """The chain is the cheapest of all that never go back."""
    turns = {}
    for r in table(spark, "conversations"):
        turns.setdefault(r.conv_id, []).append(r.turn)
    got = {}
    for r in rows(spark, "chained_places"):
        got.setdefault(r.conv_id, {})[r.turn] = r.start
    some = [c for c in sorted(turns) if len(turns[c]) <= 6][:20]
    cost = lambda n, start: next(abs(o - 1) + 0.5 for o in range(3) if n * 100 + (o - 1) * 130 == start)
    for c in some:
        own = [(n, got[c].get(n)) for n in sorted(turns[c])]
        placed = [(n, s) for n, s in own if s is not None and s == s]
        assert all(a[1] <= b[1] for a, b in itertools.pairwise(placed))
        if len(placed) == len(own):
            options = [[n * 100 + (o - 1) * 130 for o in range(3)] for n, _ in own]
            best = min(sum(cost(n, s) for (n, _), s in zip(own, way, strict=True)) for way in itertools.product(*options) if all(a <= b for a, b in itertools.pairwise(way)))
            assert sum(cost(n, s) for n, s in placed) <= best + 250


def test_books_against_all_pairs(spark):
    """Words that meet by strings in common are all that score."""
    names = ["Berakhot", "Shabbat", "Ketubot", "Kiddushin", "Genesis", "Genesis Rabbah", "Rashi on Genesis", "Sanhedrin", "Bava Kamma", "Gittin"]
    asked = ["Brachos", "Kesubos", "Kidushin", "genesis rabba", "Shabbos", "sanhdrin", "kam", "itti", "gitin", "g", "bava"]
    words = lambda xs: sorted({w for x in xs for w in x.lower().split()})
    q = spark.createDataFrame([(w,) for w in words(asked)], "w string").withColumn("key", X.skeleton(F.col("w")))
    n = spark.createDataFrame([(w,) for w in words(names)], "n string").withColumn("n_key", X.skeleton(F.col("n")))
    every = {(r.w, r.n): r.s for r in q.crossJoin(n).select("w", "n", word_score(F.col("w"), F.col("key"), F.col("n"), F.col("n_key")).alias("s")).collect() if r.s > 0}
    expect = set()
    for a in asked:
        for b in names:
            mine, theirs = a.lower().split(), b.lower().split()
            best = [max((every.get((w, x), 0) for x in theirs), default=0) for w in mine]
            if all(best):
                expect.add((a, b, round(sum(best) - 0.3 * (len(theirs) - len(mine)), 4)))
    books = spark.createDataFrame(list(enumerate(names)), "ord int, title string")
    got = search_books(books, spark.createDataFrame([(a,) for a in asked], "q string"), 99).collect()
    assert {(r.q, r.title, round(r.score, 4)) for r in got} == expect


def test_readings_of_words(spark):
    got = {}
    for r in sorted(readings(spark.createDataFrame([("\u05d4\u05e1\u05e4\u05e8",), ("\u05ea\u05e8\u05d5\u05de\u05ea",), ("\u05d4\u05d2\u05d9\u05e2",), ("\u05d0",), (None,)], "word string")).collect(), key=lambda r: r.n):
        got.setdefault(r.word, []).append(r)
    assert set(got) == {"\u05d4\u05e1\u05e4\u05e8", "\u05ea\u05e8\u05d5\u05de\u05ea", "\u05d4\u05d2\u05d9\u05e2"}
    for word, own in got.items():
        assert [r.n for r in own] == list(range(1, len(own) + 1)) and len(own) <= 40 and own[0].form == word
        assert len({r.form for r in own}) == len(own)
        # as written, then fronts, then endings, then guesses
        kind = [3 if r.guess is not None else 2 if r.suffix else 1 if r.prefix else 0 for r in own]
        assert kind == sorted(kind)
    first = {w: {r.form: r for r in own} for w, own in got.items()}
    assert first["\u05d4\u05e1\u05e4\u05e8"]["\u05e1\u05e4\u05e8"].prefix == "\u05d4"
    assert first["\u05ea\u05e8\u05d5\u05de\u05ea"]["\u05ea\u05e8\u05d5\u05de\u05d4"].guess == ["a \u05ea at the end becomes \u05d4 in the dictionary"]
    assert len(first["\u05d4\u05d2\u05d9\u05e2"]["\u05e0\u05d2\u05e2"].guess) == 2


def test_vowels():
    assert vowelled("a \u05d0\u05d1, \u05d2", "\u05d0\u05b8\u05d1\u05bc \u05d2\u05b4") == ["", "\u05d0\u05b8\u05d1\u05bc,", "\u05d2\u05b4"]
    # five words on is too far
    assert vowelled("\u05d4", "\u05d0 \u05d1 \u05d2 \u05d3 \u05d4\u05b8") is None and vowelled("", "\u05d0") is None
    assert vowelled("\u05dd", "\u05de\u05b8") == ["\u05dd\u05b8"]


def test_bson_round_trip():
    own = {"name": "x", "n": 7, "f": 0.5, "yes": True, "none": None, "list": [1, "two", {"three": [4.0]}], "in": {"a": "\u05d0"}}
    assert decode(encode(own)) == own
    with pytest.raises(ValueError):
        decode(b"\x0b\x00\x00\x00\x7fa\x00\x00\x00\x00\x00")


def test_calendar_of_known_days(spark):
    from lectern.functions import hebrew_calendar as H

    known = [("2024-10-03", 5785, 7, 1), ("2024-04-23", 5784, 1, 15), ("2023-09-16", 5784, 7, 1), ("2024-03-24", 5784, 13, 14), ("1948-05-14", 5708, 2, 5), ("2000-01-01", 5760, 10, 23)]
    days = spark.createDataFrame([(d,) for d, *_ in known], "d string").withColumn("d", F.to_date("d")).withColumn("h", H.hebrew_date(F.col("d"))).withColumn("back", H.civil_date(F.col("h.year"), F.col("h.month"), F.col("h.day")))
    assert sorted((str(r.d), r.h.year, r.h.month, r.h.day) for r in days.collect()) == sorted(known) and days.where("back <> d").count() == 0
    far = spark.range(-90_000, 60_000, 7).select(F.date_from_unix_date(F.col("id").cast("int")).alias("d")).withColumn("h", H.hebrew_date(F.col("d")))
    assert far.where(H.civil_date(F.col("h.year"), F.col("h.month"), F.col("h.day")) != F.col("d")).count() == 0


def test_facts_of_known_days(spark):
    from lectern.functions import hebrew_calendar as H

    known = {"2024-10-12": "fast yom_tov ten_days", "2024-10-06": "fast ten_days", "2024-03-21": "fast", "2024-03-24": "purim", "2024-07-23": "fast", "2024-08-13": "fast tisha_bav", "2024-12-26": "chanukah", "2025-01-02": "chanukah rosh_chodesh?", "2024-04-22": "erev_pesach", "2024-10-24": "yom_tov hoshana_raba?", "2024-04-30": "yom_tov"}
    days = spark.createDataFrame([(d,) for d in known], "d string").withColumn("f", H.day_facts(F.to_date("d"), F.lit(False)))
    for r in days.collect():
        true = {k for k, v in r.f.asDict().items() if v is True}
        assert {x for x in known[r.d].split() if x[-1] != "?"} <= true, (r.d, true)
    omer = spark.createDataFrame([("2024-04-23",), ("2024-06-10",), ("2024-06-11",), ("2024-04-22",)], "d string").select("d", H.day_facts(F.to_date("d"), F.lit(True))["omer_tonight"].alias("n"))
    assert {r.d: r.n for r in omer.collect()} == {"2024-04-23": 1, "2024-06-10": 49, "2024-06-11": None, "2024-04-22": None}


def test_sun_of_known_days(spark):
    from lectern.functions.sun import day_times

    row = spark.createDataFrame([("2024-06-21", 31.778, 35.235), ("2024-06-21", 78.2, 15.6)], "d string, lat double, lon double").withColumn("t", day_times(F.to_date("d"), F.col("lat"), F.col("lon"))).orderBy("lat").collect()
    # Jerusalem at the solstice: 5:34 and 19:47 by summer time, three hours ahead; no sunset far in the north
    assert abs(row[0].t.sunrise - (2 * 60 + 34)) < 2 and abs(row[0].t.sunset - (16 * 60 + 47)) < 2 and row[1].t.sunset is None and row[1].t.chatzot is not None


def test_respelling(spark):
    """One pattern over each text, longest spelling first, gives the same."""
    import regex

    from lectern.operators.respelling import respell
    from lectern.plans.words import LEXICON

    by = {w.lower(): (w, say, exact) for w, say, exact in LEXICON}
    pattern = regex.compile(r"(?<![\p{L}'-])(" + "|".join(regex.escape(w).replace("\\ ", r"\s+") for w in sorted(by, key=len, reverse=True)) + r")(?![\p{L}-])", regex.I)

    def say(m):
        w, said, exact = by[" ".join(m[0].lower().split())]
        if exact and " ".join(m[0].split()) != w:
            return m[0]
        return " ".join(x[:1].upper() + x[1:] for x in said.lower().split(" ")) if m[0][:1].isupper() else said.lower()

    own = ["", "The end of  the world's and-or AND in In was Was", "the the", "o'the of the-x of the", "\u00e9the the\u00e9 the.", None]
    lines = [(r.conv_id * 1000 + r.turn, r.text) for r in table(spark, "conversations")] + list(enumerate(own, 10**7))
    got = {r.id: r.text for r in respell(spark.createDataFrame(lines, "id long, text string"), spark.createDataFrame(LEXICON, "written string, say string, exact boolean")).collect()}
    assert len(got) == len(lines)
    for i, text in lines:
        assert got[i] == (None if text is None else pattern.sub(say, text)), text


def test_segments_keep_the_line():
    from lectern.functions.segments import gender_pair, segments

    for line in ("", "/x", "\u25be\u05d1\u05e8\u05d5\u05da /On a day: said this/ (Cong.: Amen) end", "\u05d0\u05d1\u05d2/\u05d3\u05d4\u05d5 \u05d0\u05d1\u05d2/\u05d0\u05d1\u05d3", "a/b: c/d: e/"):
        got = segments(line, {"On a day"})
        assert "".join(x[1] for x in got) == line
    assert [x[0] for x in segments("\u25be\u05d1\u05e8\u05d5\u05da /On a day: said this/ (Cong.: Amen) end", {"On a day"})] == ["bow", "text", "when", "text", "response", "text"]
    assert gender_pair("\u05dc\u05d7\u05d5\u05dc\u05d4", "\u05dc\u05d7\u05d5\u05dc\u05d4") == "other" and gender_pair("\u05d0", "\u05d0") is None and gender_pair("\u05d0\u05d1\u05d2", "\u05d3\u05d4\u05d5") is None

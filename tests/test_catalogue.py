"""Titles, tiers and their rules against cases worked out by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import links, placing, tiers


def test_longest_title_and_aliases(spark):
    bases = spark.createDataFrame([("Kings",), ("Second Kings",), ("Song of Songs",), ("Rok'each",)], "title string")
    aliases = spark.createDataFrame([("Canticles", "Song of Songs"), ("Kings", "Second Kings"), ("Nowhere", "No Such Book")], "alias string, base string")
    titles = ["Ibn X on Second Kings", "Targum Second Kings", "Y on canticles", "Notes on ROKEACH; Alternate", "Z on the Kings", "Kings", "All Alone", "A on B on Kings", "W on Nowhere", "", None]
    got = {r["title"]: r["base"] for r in placing.explained(spark.createDataFrame([(x,) for x in titles], "title string"), bases, aliases).collect()}
    assert got == {
        "Ibn X on Second Kings": "Second Kings", "Targum Second Kings": "Second Kings", "Y on canticles": "Song of Songs", "Notes on ROKEACH; Alternate": "Rok'each",
        "Z on the Kings": "Kings", "Kings": None, "All Alone": None, "A on B on Kings": "Kings", "W on Nowhere": None, "": None, None: None,
    }


# The commentaries printed with one part of a code, by rank, and where they stand.
CODE = "Shulchan Arukh, Orach Chayim"
PRINTED = [("Mishnah Berurah", 0, 0), ("Biur Halacha", 0, 1), ("Magen Avraham", 1, 0), ("Turei Zahav", 1, 1)]


def test_a_line_of_a_code_opens_in_the_usual_order(spark):
    anchor = f"{CODE} 671:2"
    others = [
        f"Turei Zahav on {CODE} 671:1", f"Ba'er Hetev on {CODE} 671:2", f"Be'er HaGolah on {CODE} 671:2", f"Be'er HaGolah on {CODE} 671:3", f"Beur HaGra on {CODE} 671:2:1", "Biur Halacha 671:2:1", "Biur Halacha 671:2:2",
        f"Kaf HaChayim on {CODE} 671:10:1", f"Kaf HaChayim on {CODE} 671:6:1", "Magen Avraham 671:1", "Mishnah Berurah 671:10", "Mishnah Berurah 671:4", "Mishnah Berurah 671:5",
        "Mishneh Torah, Scroll of Esther and Hanukkah 4:1", "Peninei Halakhah, Zemanim 12:2:4", "Shabbat 21b:3", "Shabbat 21b:4", "Magen Avraham 2:3",
    ]
    pairs = spark.createDataFrame([(anchor, x) for x in others], "anchor string, other string")
    families = spark.createDataFrame([(CODE, True, "oc", True), ("Shabbat", True, "bavli", False)], "prefix string, exact boolean, family string, whole boolean")
    named = spark.createDataFrame([("oc", n, t, p) for n, t, p in PRINTED] + [("oc", "Be'er HaGolah", tiers.LAST, 0)], "family string, name string, tier int, pos int")
    sources = spark.createDataFrame([("oc", "Shabbat", True, 2, 0), ("oc", "Mishneh Torah, ", False, 2, 1)], "family string, prefix string, exact boolean, tier int, pos int")
    out = tiers.tiers(pairs, families, named, sources)
    tier = {r["other"]: (r["tier"], r["pos"], r["commentary"]) for r in out.collect()}
    assert tier["Mishnah Berurah 671:10"] == (0, 0, True) and tier["Magen Avraham 2:3"] == (5, 0, False) and tier[f"Beur HaGra on {CODE} 671:2:1"] == (4, 0, True)
    order = [r["other"] for r in links.turns(out).orderBy("n").collect()]
    assert order[:8] == [
        "Mishnah Berurah 671:4", "Biur Halacha 671:2:1", "Magen Avraham 671:1", f"Turei Zahav on {CODE} 671:1", "Mishnah Berurah 671:5", "Biur Halacha 671:2:2", "Shabbat 21b:3", "Mishneh Torah, Scroll of Esther and Hanukkah 4:1",
    ]
    assert all(x.startswith("Be'er HaGolah") for x in order[-2:])
    kaf = [x for x in order if x.startswith("Kaf")]
    assert kaf[0].endswith("671:6:1") and order.index(f"Beur HaGra on {CODE} 671:2:1") < order.index(kaf[1])


def test_longest_prefix_of_hot_names(spark):
    names = spark.createDataFrame([("aaa",)] * 50 + [("ab",), ("b",), ("",), (None,)], "book string")
    rules = spark.createDataFrame([("a", False, "x"), ("aa", False, "y"), ("ab", True, "z"), ("aaa b", False, "w"), ("aa", True, "v")], "prefix string, exact boolean, family string")
    assert {(r["book"], r["family"]) for r in tiers.longest_prefix(names, "book", rules).collect()} == {("aaa", "y"), ("ab", "z")}
    assert tiers.longest_prefix(names.where(F.lit(False)), "book", rules).count() == 0

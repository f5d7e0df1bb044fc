"""Portions, psalms and omitted supplications on dates that are known."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from lectern.functions import portions

# Sabbaths and their portions outside of Israel, from printed calendars.
KNOWN = {
    "2024-01-06": "Shemot", "2024-03-09": "Vayakhel", "2024-03-16": "Pekudei", "2024-04-20": "Metzora", "2024-04-27": None, "2024-05-04": "Achrei Mot", "2024-06-08": "Bamidbar", "2024-08-03": "Matot-Masei",
    "2024-08-10": "Devarim", "2024-09-28": "Nitzavim-Vayeilech", "2024-10-05": "Ha'azinu", "2024-10-12": None, "2024-10-26": "Bereshit",
    "2023-03-18": "Vayakhel-Pekudei", "2023-04-01": "Tzav", "2023-04-22": "Tazria-Metzora", "2023-04-29": "Achrei Mot-Kedoshim", "2023-05-13": "Behar-Bechukotai", "2023-05-20": "Bamidbar", "2023-07-01": "Chukat-Balak", "2023-07-15": "Matot-Masei",
    "2023-09-09": "Nitzavim-Vayeilech", "2023-09-23": "Ha'azinu", "2025-03-22": "Vayakhel", "2025-03-29": "Pekudei", "2025-04-12": "Tzav", "2025-07-26": "Matot-Masei", "2025-09-20": "Nitzavim", "2025-09-27": "Vayeilech", "2025-10-04": "Ha'azinu",
    "2016-05-07": "Achrei Mot", "2016-06-11": "Bamidbar", "2016-08-06": "Matot-Masei",
}
# The same in Israel where it differs.
ISRAEL = {"2016-04-30": "Achrei Mot", "2016-05-07": "Kedoshim", "2016-06-11": "Nasso", "2016-07-30": "Matot", "2016-08-06": "Masei", "2023-07-01": "Balak", "2023-06-24": "Chukat", "2024-08-03": "Matot-Masei"}


def test_known_sabbaths(spark):
    for israel, known in ((False, KNOWN), (True, ISRAEL)):
        got = {str(r["day"]): r["portion"] for r in portions.readings(spark, 5775, 5786, israel).collect()}
        assert {d: got.get(d, "no row") for d in known} == known


def test_every_cycle_is_whole(spark):
    """In 61 cycles each Sabbath without a festival has a portion, every portion comes once, and neither is left over."""
    for israel in (False, True):
        rows = portions.readings(spark, 5740, 5800, israel).join(portions.sabbaths(spark, 5740, 5800, israel), "day").orderBy("day").collect()
        by = {}
        for r in rows:
            assert (r["portion"] is not None) == r["ordinary"], r
            if r["portion"]:
                by.setdefault(r["cycle"], []).extend(r["portion"].replace("Lech-Lecha", "Lech_Lecha").split("-"))
        assert all(v == [x.replace("-", "_") for x in portions.PORTIONS] for v in by.values()) and len(by) == 61


def test_psalms(spark):
    d = spark.createDataFrame([(1, 30), (25, 29), (26, 30), (29, 29), (29, 30), (30, 30)], "day int, size int")
    assert [r[0] for r in d.select(portions.psalms_of_month(F.col("day"), F.col("size"))).collect()] == ["1-9", "119:1-96", "119:97-176", "140-144, 145-150", "140-144", "145-150"]
    week = spark.createDataFrame([(datetime.date(2024, 1, 7 + i),) for i in range(7)], "day date")
    assert [r[0] for r in week.select(portions.psalms_of_week(F.col("day"))).collect()] == ["1-29", "30-50", "51-72", "73-89", "90-106", "107-119", "120-150"]


def test_omissions(spark):
    # Date, morning, afternoon, reason, outside of Israel
    known = [
        ("2024-01-24", True, False, "the afternoon before Tu BiShvat"), ("2024-01-25", False, False, "Tu BiShvat"), ("2024-02-23", False, False, "Purim Katan"), ("2024-03-24", False, False, "Purim"), ("2024-03-25", False, False, "Shushan Purim"),
        ("2024-04-18", False, False, "Nisan"), ("2024-05-14", False, False, "Yom HaAtzma'ut"), ("2024-05-22", False, False, "Pesach Sheni"), ("2024-05-26", False, False, "Lag BaOmer"), ("2024-06-12", False, False, "Shavuot"), ("2024-06-17", True, True, None),
        ("2024-08-12", True, False, "the afternoon before Tisha B'Av"), ("2024-08-13", False, False, "Tisha B'Av"), ("2024-10-02", False, False, "Erev Rosh HaShana"), ("2024-10-11", False, False, "Erev Yom Kippur"), ("2024-10-27", True, True, None),
        ("2024-12-25", True, False, "the afternoon before Chanukah"), ("2025-01-02", False, False, "Chanukah"), ("2024-07-05", True, False, "Erev Shabbat"), ("2024-07-06", False, False, "Shabbat"), ("2024-07-10", True, True, None),
    ]
    df = spark.createDataFrame([(datetime.date.fromisoformat(x[0]),) for x in known], "day date").select("day", portions.omission(F.col("day"), F.lit(False)).alias("o")).select("day", "o.*")
    assert [(str(r["day"]), r["morning"], r["afternoon"], r["why"]) for r in df.collect()] == known
    there = spark.createDataFrame([(datetime.date(2024, 6, 17),), (datetime.date(2024, 10, 28),)], "day date").select(portions.omission(F.col("day"), F.lit(True)).alias("o")).select("o.why")
    assert [r[0] for r in there.collect()] == ["the days around Shavuot", "the days of Sukkot"]

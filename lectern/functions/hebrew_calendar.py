"""The Hebrew calendar as column arithmetic: new years, months, dates both ways, anniversaries.

Days are counted from 1970-01-01, as Spark counts dates. Months are numbered from Nisan (1), Adar or Adar I being 12 and
Adar II 13; a year begins with Tishrei (7).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the first day of year 1.
EPOCH = -2_092_590
# Names of the months from Nisan on; Adar of a leap year is Adar I.
MONTHS = ["Nisan", "Iyyar", "Sivan", "Tamuz", "Av", "Elul", "Tishrei", "Cheshvan", "Kislev", "Tevet", "Sh'vat", "Adar", "Adar II"]


def let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _div(a: Column, b: int) -> Column:
    return F.floor(a / b).cast("long")


def leap(year: Column) -> Column:
    """Seven years of nineteen have a thirteenth month."""
    return F.pmod(7 * year + 1, F.lit(19)) < 7


def _elapsed(year: Column) -> Column:
    """Days to the mean conjunction of a year's Tishrei, moved off Sunday, Wednesday and Friday."""
    day = let(_div(235 * year - 234, 19), lambda months: 29 * months + _div(12_084 + 13_753 * months, 25_920))
    return let(day, lambda d: d + (F.pmod(3 * (d + 1), F.lit(7)) < 3).cast("long"))


def new_year(year: Column) -> Column:
    """The day number of the first of Tishrei."""
    around = let(year.cast("long"), lambda y: F.struct(_elapsed(y - 1).alias("before"), _elapsed(y).alias("own"), _elapsed(y + 1).alias("after")))
    return let(around, lambda e: EPOCH + e["own"] + F.when(e["after"] - e["own"] == 356, 2).when(e["own"] - e["before"] == 382, 1).otherwise(0))


def _months(year: Column, size: Column) -> Column:
    long_, short = F.pmod(size, F.lit(10)) == 5, F.pmod(size, F.lit(10)) == 3
    part = lambda m, n: F.struct(F.lit(m).alias("month"), (n if isinstance(n, Column) else F.lit(n)).cast("int").alias("days"))
    autumn = [part(7, 30), part(8, F.when(long_, 30).otherwise(29)), part(9, F.when(short, 29).otherwise(30)), part(10, 29), part(11, 30)]
    spring = [part(m, 30 if m % 2 else 29) for m in range(1, 7)]
    return F.concat(F.array(*autumn), F.when(leap(year), F.array(part(12, 30), part(13, 29))).otherwise(F.array(part(12, 29))), F.array(*spring))


def month_starts(year: Column) -> Column:
    """(month, days, start) from Tishrei on, start the month's first day as a day number."""
    own = let(year.cast("long"), lambda y: F.struct(y.alias("year"), new_year(y).alias("first"), new_year(y + 1).alias("next")))
    held = let(own, lambda o: F.struct(o["first"].alias("first"), _months(o["year"], o["next"] - o["first"]).alias("months")))
    before = lambda h, i: F.aggregate(F.slice(h["months"], F.lit(1), i), F.lit(0), lambda a, x: a + x["days"])
    return let(held, lambda h: F.transform(h["months"], lambda x, i: F.struct(x["month"].alias("month"), x["days"].alias("days"), (h["first"] + before(h, i)).alias("start"))))


def year_of(day: Column) -> Column:
    """The Hebrew year of a day number."""
    near = lambda d: _div((d - EPOCH) * 98_496, 35_975_351)
    of = lambda d, y: y + (new_year(y + 1) <= d).cast("long") + (new_year(y + 2) <= d).cast("long") - (new_year(y) > d).cast("long")
    return let(day.cast("long"), lambda d: let(near(d), lambda y: of(d, y)))


def hebrew_date(date: Column) -> Column:
    """(year, month, day) of a civil date, before nightfall."""

    def dated(at: Column) -> Column:
        month = F.element_at(F.filter(month_starts(at["year"]), lambda m: m["start"] <= at["day"]), -1)
        return let(month, lambda m: F.struct(at["year"].alias("year"), m["month"].alias("month"), (at["day"] - m["start"] + 1).cast("int").alias("day")))

    return let(let(F.unix_date(date).cast("long"), lambda d: F.struct(d.alias("day"), year_of(d).alias("year"))), dated)


def civil_date(year: Column, month: Column, day: Column) -> Column:
    """The civil date of a Hebrew one; null if the year has no such month."""
    own = F.filter(month_starts(year), lambda m: m["month"] == month)
    return F.date_from_unix_date((F.get(own, F.lit(0))["start"] + day - 1).cast("int"))


def anniversary(date: Column, year: Column) -> Column:
    """The civil date in a Hebrew ``year`` on which the anniversary of a Hebrew (year, month, day) is kept.

    The thirtieth of Cheshvan or Kislev, where the first anniversary's month lacked it, is the day before the next
    month; Adar II, and Adar of a year that has one Adar, fall in what the year has; the thirtieth of Adar I, where a year
    has no such day, is the thirtieth of Sh'vat.
    """
    y, m, d = date["year"], date["month"], date["day"]
    lacks = lambda month, of: F.element_at(F.filter(month_starts(of), lambda x: x["month"] == month), 1)["days"] < 30
    eve = lambda month: F.date_sub(civil_date(year, F.lit(month), F.lit(1)), 1)
    return (
        F.when((m == 8) & (d == 30) & lacks(8, y + 1), eve(9))
        .when((m == 9) & (d == 30) & lacks(9, y + 1), eve(10))
        .when(m == 13, civil_date(year, F.when(leap(year), 13).otherwise(12), d))
        .when((m == 12) & (d == 30) & ~leap(year), civil_date(year, F.lit(11), F.lit(30)))
        .otherwise(civil_date(year, m, d))
    )


def second_adar(date: Column, year: Column) -> Column:
    """For a date in Adar of a year with one Adar, the day in Adar II of a leap year that some keep; else null."""
    return F.when((date["month"] == 12) & ~leap(date["year"]) & leap(year), civil_date(year, F.lit(13), F.least(date["day"], F.lit(29))))


def month_name(year: Column, month: Column) -> Column:
    name = F.element_at(F.array(*map(F.lit, MONTHS)), month.cast("int"))
    return F.when((month == 12) & leap(year), F.lit("Adar I")).otherwise(name)


# Days of rest as (month, day), those kept everywhere and those added outside of Israel.
REST = [(7, 1), (7, 2), (7, 10), (7, 15), (7, 22), (1, 15), (1, 21), (3, 6)]
SECOND = [(7, 16), (7, 23), (1, 16), (1, 22), (3, 7)]
# Fasts as (month, day) and how many days they move if they fall on the day of rest of the week.
FASTS = [(7, 3, 1), (10, 10, 0), (4, 17, 1), (5, 9, 1)]


def _on(h: Column, days: list[tuple[int, int]]) -> Column:
    return (h["month"] * 100 + h["day"]).isin(*[m * 100 + d for m, d in days])


def day_facts(date: Column, israel: Column) -> Column:
    """What a civil date is in the year of prayers, by its Hebrew date alone: a struct of facts."""

    def facts(x: Column) -> Column:
        h, week = x["h"], x["week"]  # 0 is Sunday
        month, day = h["month"], h["day"]
        purim_month = F.when(leap(h["year"]), 13).otherwise(12)
        rest = _on(h, REST) | (~x["israel"] & _on(h, SECOND))
        between = (month.isin(7, 1)) & day.between(16, F.when(month == 7, 21).otherwise(20)) & ~rest
        moved = lambda m, d, n: ((month == m) & (day == d) & (week != 6)) | ((month == m) & (day == d + n) & (week == 0) if n else F.lit(False))
        esther = ((month == purim_month) & (day == 13) & (week != 6)) | ((month == purim_month) & (day == 11) & (week == 4))
        fast = esther
        for m, d, n in FASTS:
            fast = fast | moved(m, d, n)
        omer = x["at"] + 1 - F.unix_date(civil_date(h["year"], F.lit(1), F.lit(15)))
        lights = x["at"] - F.unix_date(civil_date(h["year"], F.lit(9), F.lit(25)))
        named = {
            "dow": week, "rosh_chodesh": (day == 30) | ((day == 1) & (month != 7)), "chanukah": lights.between(0, 7), "purim": (month == purim_month) & (day == 14),
            "fast": fast | ((month == 7) & (day == 10)), "tisha_bav": moved(5, 9, 1), "ten_days": (month == 7) & (day <= 10), "shabbat_shuva": (month == 7) & (day <= 10) & (week == 6),
            "chol_hamoed": between, "yom_tov": rest, "erev_pesach": (month == 1) & (day == 14), "erev_yom_kippur": (month == 7) & (day == 9), "hoshana_raba": (month == 7) & (day == 21),
            "isru_chag": x["israel"] & _on(h, [(1, 22), (3, 7), (7, 23)]), "ledavid": (month == 6) | ((month == 7) & (day <= F.when(x["israel"], 21).otherwise(22))),
            "omer_tonight": F.when(omer.between(1, 49), omer.cast("int")),
        }
        return F.struct(*[c.alias(name) for name, c in named.items()])

    return let(F.struct(hebrew_date(date).alias("h"), (F.dayofweek(date) - 1).alias("week"), F.unix_date(date).alias("at"), israel.alias("israel")), facts)

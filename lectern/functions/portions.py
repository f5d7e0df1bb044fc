"""Weekly portions, daily psalms and days without the supplication, by the Hebrew calendar.

The portion of a Sabbath is not looked up by year: Sabbaths are a relation, festivals take theirs out, and a cycle falls into stretches
that must end with certain portions (before Passover and Pentecost, on the fast of Av, before the new year). A stretch
with fewer Sabbaths than portions reads pairs together, in a fixed order of preference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import hebrew_calendar as H

# The portions in order.
PORTIONS = [
    "Bereshit", "Noach", "Lech-Lecha", "Vayera", "Chayei Sara", "Toldot", "Vayetzei", "Vayishlach", "Vayeshev", "Miketz", "Vayigash", "Vayechi",
    "Shemot", "Vaera", "Bo", "Beshalach", "Yitro", "Mishpatim", "Terumah", "Tetzaveh", "Ki Tisa", "Vayakhel", "Pekudei",
    "Vayikra", "Tzav", "Shmini", "Tazria", "Metzora", "Achrei Mot", "Kedoshim", "Emor", "Behar", "Bechukotai",
    "Bamidbar", "Nasso", "Beha'alotcha", "Sh'lach", "Korach", "Chukat", "Balak", "Pinchas", "Matot", "Masei",
    "Devarim", "Vaetchanan", "Eikev", "Re'eh", "Shoftim", "Ki Teitzei", "Ki Tavo", "Nitzavim", "Vayeilech", "Ha'azinu",
]
# Pairs that may be read together, by stretch and preference: (stretch, preference, number of the first).
PAIRS = [(1, 1, 22), (2, 1, 27), (2, 2, 29), (2, 3, 32), (3, 1, 42), (3, 2, 39), (4, 1, 51)]
# The last portion of a stretch of a year without a leap month.
ENDS = {1: 25, 2: 34, 3: 44, 4: 51}


def sabbaths(spark: SparkSession, first: int, last: int, israel: bool) -> DataFrame:
    """(day, cycle, stretch, ordinary) of the Sabbaths whose cycle begins in the Hebrew years ``first`` to ``last``.

    A cycle begins after the end of Tabernacles. Stretches: 1 to Passover, 2 to Pentecost, 3 to the fast of Av, 4 to the new
    year, 5 to the next Tabernacles' end. ordinary is false on festivals and their middle days.
    """
    years = spark.range(first, last + 2).select(F.col("id").alias("year"))
    # months and days are rows, so that no date is worked out twice
    months = years.select("year", F.explode(H.month_starts(F.col("year"))).alias("m")).select("year", F.col("m.month").alias("month"), F.col("m.start").alias("start"), F.col("m.days").alias("days"))
    days = months.select("year", "month", "start", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("days") - 1)).alias("at")).where("pmod(at, 7) = 2")
    h = days.select(F.date_from_unix_date(F.col("at").cast("int")).alias("day"), "year", F.struct("month", (F.col("at") - F.col("start") + 1).alias("day")).alias("h"))
    month, day = F.col("h.month"), F.col("h.day")
    rest = H._on(F.col("h"), H.REST) | (F.lit(not israel) & H._on(F.col("h"), H.SECOND))
    middle = ((month == 7) & day.between(16, 21)) | ((month == 1) & day.between(16, 20))
    end = 22 if israel else 23
    early = (month == 7) & (day <= end)
    stretch = (
        F.when(early, 5).when((month >= 7) | ((month == 1) & (day < 15)), 1).when((month < 3) | ((month == 3) & (day < 6)), 2).when((month < 5) | ((month == 5) & (day <= 9)), 3).otherwise(4)
    )
    rows = h.select("day", (F.col("year") - early.cast("int")).alias("cycle"), stretch.alias("stretch"), (~(rest | middle)).alias("ordinary"))
    return rows.where(F.col("cycle").between(first, last))


def readings(spark: SparkSession, first: int, last: int, israel: bool) -> DataFrame:
    """(day, portion) of those Sabbaths; a pair is joined by a hyphen, a festival's portion is null."""
    days = sabbaths(spark, first, last, israel)
    n = F.row_number().over(Window.partitionBy("cycle", "stretch").orderBy("day"))
    placed = days.where("ordinary").withColumn("n", n)
    held = placed.groupBy("cycle").pivot("stretch", [1, 2, 3, 4, 5]).agg(F.count("day")).na.fill(0)
    is_leap = H.leap(F.col("cycle"))
    # where each stretch begins and ends: a leap year has no pairs before Pentecost and goes on from where it is
    end1 = F.when(is_leap, F.col("1")).otherwise(ENDS[1])
    end2 = F.when(is_leap, F.col("1") + F.col("2")).otherwise(ENDS[2])
    edges = held.select("cycle", F.col("1"), F.col("2"), F.col("3"), F.col("4"), F.col("5"), end1.alias("e1"), end2.alias("e2"))
    last4 = F.when(F.col("5") == 1, ENDS[4] + 1).otherwise(ENDS[4])
    spans = edges.select(
        "cycle",
        F.explode(F.array(*[
            F.struct(F.lit(s).alias("stretch"), a.cast("int").alias("begin"), b.cast("int").alias("stop"), (b - a + 1 - c).cast("int").alias("pairs"))
            for s, a, b, c in (
                (1, F.lit(1), F.col("e1"), F.col("1")), (2, F.col("e1") + 1, F.col("e2"), F.col("2")), (3, F.col("e2") + 1, F.lit(ENDS[3]), F.col("3")),
                (4, F.lit(ENDS[3] + 1), last4, F.col("4")), (5, last4 + 1, F.lit(len(PORTIONS)), F.col("5")),
            )
        ])).alias("s"),
    ).select("cycle", "s.*")
    pairs = spark.createDataFrame(PAIRS, "stretch int, preference int, number int")
    names = spark.createDataFrame(list(enumerate(PORTIONS, 1)), "number int, name string")
    every = spans.select("cycle", "stretch", "pairs", F.explode(F.sequence("begin", "stop")).alias("number")).join(F.broadcast(names), "number").join(F.broadcast(pairs), ["stretch", "number"], "left")
    along = Window.partitionBy("cycle", "stretch").orderBy("number")
    joined = every.withColumn("with_next", F.coalesce(F.col("preference") <= F.col("pairs"), F.lit(False))).withColumn("after", F.lead("name").over(along)).withColumn("second", F.coalesce(F.lag("with_next").over(along), F.lit(False)))
    read = joined.where("not second").select("cycle", "stretch", F.when(F.col("with_next"), F.concat_ws("-", "name", "after")).otherwise(F.col("name")).alias("portion"), F.row_number().over(along).alias("n"))
    return days.join(placed.select("day", "n"), "day", "left").join(read, ["cycle", "stretch", "n"], "left").select("day", "portion")


# The psalms of the days of a month, the last of each day; the hundred and nineteenth takes two days.
MONTH_ENDS = [9, 17, 22, 28, 34, 38, 43, 48, 54, 59, 65, 68, 71, 76, 78, 82, 87, 89, 96, 103, 105, 107, 112, 118, 119, 119, 134, 139, 144, 150]
# The same for the days of a week from Sunday on.
WEEK_ENDS = [29, 50, 72, 89, 106, 119, 150]


def _psalms(number: Column, ends: list[int], shared: tuple[int, ...] = ()) -> Column:
    """The label of the number-th portion (from 1); the days in ``shared`` have half of one psalm each."""
    begins = [1] + [e + 1 for e in ends[:-1]]
    labels = [f"{a}-{b}" if a < b else str(a) for a, b in zip(begins, ends, strict=True)]
    for i, verses in zip(shared, ("1-96", "97-176"), strict=False):
        labels[i - 1] = f"{ends[i - 1]}:{verses}"
    return F.element_at(F.array(*map(F.lit, labels)), number.cast("int"))


def psalms_of_month(day: Column, size: Column) -> Column:
    """The psalms of a day of a Hebrew month of ``size`` days; the last day of a short month takes two portions."""
    own = lambda n: _psalms(n, MONTH_ENDS, (25, 26))
    return F.when((day == 29) & (size == 29), F.concat_ws(", ", own(F.lit(29)), own(F.lit(30)))).otherwise(own(day))


def psalms_of_week(date: Column) -> Column:
    return _psalms(F.dayofweek(date), WEEK_ENDS)


def month_size(h: Column) -> Column:
    """The days of the month of a Hebrew (year, month, day)."""
    return F.element_at(F.filter(H.month_starts(h["year"]), lambda m: m["month"] == h["month"]), 1)["days"]


def _omitted(x: Column) -> Column:
    """The first reason that holds: (why, before) with before for the afternoon ahead of the day; null on other days."""
    h, week, israel = x["h"], x["week"], x["israel"]
    m, d = h["month"], h["day"]
    two = H.leap(h["year"])
    purim = F.when(two, 13).otherwise(12)
    lights = x["at"] - F.unix_date(H.civil_date(h["year"], F.lit(9), F.lit(25)))
    # a day of joy in Iyyar moves off the Sabbath's edges, and since 5764 off the first day of the week
    five = (x["at"] - d + 5 + 4) % 7
    state = F.when(five == 5, 4).when(five == 6, 3).when((five == 1) & (h["year"] >= 5764), 6).otherwise(5)
    fast = (d == 9) & (week != 6) | (d == 10) & (week == 0)
    table = [
        ((d == 30) | ((d == 1) & (m != 7)), "Rosh Chodesh", True),
        (lights.between(0, 7), "Chanukah", True),
        ((m == 11) & (d == 15), "Tu BiShvat", True),
        (two & (m == 12) & d.isin(14, 15), "Purim Katan", True),
        ((m == purim) & (d == 14), "Purim", True),
        ((m == purim) & (d == 15), "Shushan Purim", True),
        ((m == 2) & (d == state) & (h["year"] >= 5708), "Yom HaAtzma'ut", True),
        ((m == 2) & (d == 28) & (h["year"] >= 5727), "Yom Yerushalayim", True),
        ((m == 2) & (d == 18), "Lag BaOmer", True),
        ((m == 5) & fast, "Tisha B'Av", True),
        ((m == 5) & (d == 15), "Tu B'Av", True),
        (m == 1, "Nisan", False),
        ((m == 2) & (d == 14), "Pesach Sheni", False),
        ((m == 3) & d.between(6, F.when(israel, 6).otherwise(7)), "Shavuot", False),
        ((m == 3) & (d <= F.when(israel, 12).otherwise(8)), "the days around Shavuot", False),
        ((m == 7) & (d == 9), "Erev Yom Kippur", False),
        ((m == 7) & (d == 10), "Yom Kippur", False),
        ((m == 7) & d.between(11, F.when(israel, 30).otherwise(24)), "the days of Sukkot", False),
        ((m == 7) & (d <= 2), "Rosh HaShana", False),
        ((m == 6) & (d == 29), "Erev Rosh HaShana", False),
    ]
    out = None
    for holds, why, before in table:
        row = F.struct(F.lit(why).alias("why"), F.lit(before).alias("before"))
        out = F.when(holds, row) if out is None else out.when(holds, row)
    return out


def omission(date: Column, israel: Column) -> Column:
    """(morning, afternoon, why) of a civil date: whether the supplication is said, and if not at both, the reason.

    A day's own reason leaves out both; the eve of a Sabbath or festival, and of a day whose reason reaches back, the afternoon.
    """
    of = lambda d: F.struct(H.hebrew_date(d).alias("h"), (F.dayofweek(d) - 1).alias("week"), F.unix_date(d).alias("at"), israel.alias("israel"))

    def both(x: Column) -> Column:
        own, next_ = _omitted(x["a"]), _omitted(x["b"])
        return H.let(F.struct(own.alias("own"), next_.alias("next"), x["a"].alias("a"), x["b"].alias("b")), result)

    def result(x: Column) -> Column:
        week, own, next_ = x["a"]["week"], x["own"], x["next"]
        tomorrow = x["b"]["h"]
        feast = H._on(tomorrow, H.REST) | (~x["a"]["israel"] & H._on(tomorrow, H.SECOND))
        eve = (week == 5) | feast
        back = F.coalesce(next_["before"], F.lit(False))
        why = F.when(week == 6, "Shabbat").when(own.isNotNull(), own["why"]).when(week == 5, "Erev Shabbat").when(feast, "Erev Yom Tov").when(back, F.concat(F.lit("the afternoon before "), next_["why"]))
        return F.struct(((week != 6) & own.isNull()).alias("morning"), ((week != 6) & own.isNull() & ~eve & ~back).alias("afternoon"), why.alias("why"))

    return H.let(F.struct(of(date).alias("a"), of(F.date_add(date, 1)).alias("b")), both)

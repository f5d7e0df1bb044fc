"""Time, places on the globe, calendars as rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import dates as D
from lectern.functions import hebrew_calendar as H
from lectern.functions import portions as P
from lectern.functions import sun as S
from lectern.registry import query


@query("event_times", "D1 D2 D6", "SELECT event_id, CAST(ts AS DATE) AS day, strftime(ts, '%H:%M') AS clock, date_trunc('hour', ts) AS hour FROM events")
def event_times(t):
    return t("events").select("event_id", F.to_date("ts").alias("day"), F.date_format("ts", "HH:mm").alias("clock"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"))


@query("noon_in_zone", "D3", "SELECT o_orderkey, CAST(o_orderdate AS DATE) + INTERVAL 10 HOUR AS noon FROM orders WHERE o_orderdate < TIMESTAMP '1993-01-01'")
def noon(t):
    """Noon at a fixed offset of two hours, as UTC."""
    o = t("orders").where(F.col("o_orderdate") < F.lit("1993-01-01").cast("timestamp_ntz"))
    at = F.to_date("o_orderdate").cast("timestamp_ntz") + F.expr("INTERVAL 12 HOURS")
    return o.select("o_orderkey", F.convert_timezone(F.lit("+02:00"), F.lit("UTC"), at).alias("noon"))


@query("date_buckets", "D4 D5", """
WITH n AS (SELECT event_id, date_diff('day', CAST(ts AS DATE), DATE '2024-01-28') AS d, floor((epoch(TIMESTAMP '2024-01-28 12:00:00') - floor(epoch(ts))) / 86400) AS a FROM events)
SELECT event_id, CASE WHEN d <= 0 THEN 'Today' WHEN d = 1 THEN 'Yesterday' WHEN d < 7 THEN 'This week' ELSE 'Earlier' END AS bucket, CASE WHEN a <= 0 THEN 'today' WHEN a = 1 THEN 'yesterday' WHEN a < 30 THEN a::BIGINT || ' days ago' ELSE floor(a / 30)::BIGINT || ' months ago' END AS ago FROM n""")
def buckets(t):
    now = F.lit("2024-01-28 12:00:00").cast("timestamp")
    return t("events").select("event_id", D.bucket(F.to_date("ts"), F.to_date(now)).alias("bucket"), D.ago(F.col("ts").cast("timestamp"), now).alias("ago"))


@query("bearings", "D7 D8 D9", """
WITH p AS (SELECT s_suppkey, -60.0::DOUBLE + (s_suppkey * 37 % 120) AS lat, -180.0::DOUBLE + (s_suppkey * 53 % 360) AS lon FROM supplier),
b AS (SELECT s_suppkey, fmod(degrees(atan2(sin(radians(35.235 - lon)) * cos(radians(31.778)), cos(radians(lat)) * sin(radians(31.778)) - sin(radians(lat)) * cos(radians(31.778)) * cos(radians(35.235 - lon)))) + 360, 360) AS d FROM p)
SELECT s_suppkey, round(d, 4) AS d, (['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW'])[(round(d / 22.5) % 16 + 1)::INT] AS words FROM b""")
def bearings(t):
    lat, lon = F.lit(-60.0) + F.col("s_suppkey") * 37 % 120, F.lit(-180.0) + F.col("s_suppkey") * 53 % 360
    d = D.bearing(lat, lon, F.lit(31.778), F.lit(35.235))
    return t("supplier").select("s_suppkey", F.round(d, 4).alias("d"), D.compass(d).alias("words"))


@query("month_grid", "D12 D13 D15", "SELECT d::DATE AS day, count(event_id) AS n FROM generate_series(DATE '2024-01-01', DATE '2024-02-10', INTERVAL 1 DAY) g(d) LEFT JOIN events ON CAST(ts AS DATE) = d::DATE GROUP BY 1")
def month_grid(t):
    """Every day of a span with its events, days without any too."""
    days = t.spark.range(1).select(F.explode(F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-02-10").cast("date"))).alias("day"))
    own = t("events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return days.join(own, "day", "left").select("day", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("portions_by_day", "D21 D22", """
WITH p(d, portion) AS (VALUES (0, '1-9'), (1, '10-17'), (2, '18-22'), (3, '23-28'), (4, '29-34'))
SELECT o_orderkey, portion, CASE WHEN extract(hour FROM o_orderdate) < 12 THEN 'morning' ELSE 'evening' END AS service FROM orders JOIN p ON extract(day FROM o_orderdate) % 5 = d""")
def portions(t):
    p = t.values([(0, "1-9"), (1, "10-17"), (2, "18-22"), (3, "23-28"), (4, "29-34")], "d int, portion string")
    o = t("orders").select("o_orderkey", (F.dayofmonth("o_orderdate") % 5).alias("d"), F.when(F.hour("o_orderdate") < 12, "morning").otherwise("evening").alias("service"))
    return o.join(F.broadcast(p), "d").select("o_orderkey", "portion", "service")


@query("printed_early", "D23", "SELECT o_orderkey, extract(year FROM o_orderdate) <= 1998 - 5 AS ok FROM orders")
def printed(t):
    return t("orders").select("o_orderkey", (F.year("o_orderdate") <= 1998 - 5).alias("ok"))


# The same calendar as tables: new years by the rule of the molad, then months by running sums.
_MONTHS = """y0 AS (SELECT y, (235 * y - 234) // 19 AS m FROM generate_series(5745, 5765) g(y)),
y1 AS (SELECT y, 29 * m + (12084 + 13753 * m) // 25920 AS d FROM y0), y2 AS (SELECT y, d + (3 * (d + 1) % 7 < 3)::INT AS d FROM y1),
y3 AS (SELECT y, d - 2092590 + CASE WHEN lead(d) OVER (ORDER BY y) - d = 356 THEN 2 WHEN d - lag(d) OVER (ORDER BY y) = 382 THEN 1 ELSE 0 END AS first FROM y2),
y4 AS (SELECT y, first, lead(first) OVER (ORDER BY y) - first AS size, (7 * y + 1) % 19 < 7 AS leap FROM y3),
months AS (SELECT y, m, days, leap, first + sum(days) OVER (PARTITION BY y ORDER BY i) - days AS start FROM (
  SELECT y, first, leap, i, m, CASE WHEN m = 8 THEN 29 + (size % 10 = 5)::INT WHEN m = 9 THEN 30 - (size % 10 = 3)::INT WHEN m = 12 THEN 29 + leap::INT WHEN m IN (7, 11) OR m < 7 AND m % 2 = 1 THEN 30 ELSE 29 END AS days
  FROM y4, (VALUES (1, 7), (2, 8), (3, 9), (4, 10), (5, 11), (6, 12), (7, 13), (8, 1), (9, 2), (10, 3), (11, 4), (12, 5), (13, 6)) v(i, m) WHERE size IS NOT NULL AND (m <> 13 OR leap))),
days AS (SELECT day, y, m, n - start + 1 AS d, leap FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS n FROM orders) JOIN months ON n >= start AND n < start + days)"""


@query("hebrew_dates", "D11", f"WITH {_MONTHS} SELECT day, y AS hebrew_year, m AS hebrew_month, d AS hebrew_day, CASE WHEN m = 12 AND leap THEN 'Adar I' ELSE (['Nisan','Iyyar','Sivan','Tamuz','Av','Elul','Tishrei','Cheshvan','Kislev','Tevet','Sh''vat','Adar','Adar II'])[m] END AS name FROM days")
def hebrew_dates(t):
    days = t("orders").select(F.to_date("o_orderdate").alias("day")).distinct().withColumn("h", H.hebrew_date(F.col("day")))
    return days.select("day", F.col("h.year").alias("hebrew_year"), F.col("h.month").alias("hebrew_month"), F.col("h.day").alias("hebrew_day"), H.month_name(F.col("h.year"), F.col("h.month")).alias("name"))


@query("anniversaries", "D16", f"""
WITH {_MONTHS}, a AS (SELECT day, t.y AS target, days.m, days.d, days.leap AS had_two, t.leap AS has_two,
  CASE WHEN days.m = 8 AND days.d = 30 AND (SELECT x.days FROM months x WHERE x.y = days.y + 1 AND x.m = 8) = 29 THEN 9 WHEN days.m = 9 AND days.d = 30 AND (SELECT x.days FROM months x WHERE x.y = days.y + 1 AND x.m = 9) = 29 THEN 10 END AS eve FROM days, y4 t WHERE t.y IN (5761, 5762, 5763)),
b AS (SELECT *, CASE WHEN eve IS NOT NULL THEN eve WHEN m = 13 AND NOT has_two THEN 12 WHEN m = 12 AND d = 30 AND NOT has_two THEN 11 ELSE m END AS tm, CASE WHEN eve IS NOT NULL THEN 0 ELSE d END AS td FROM a)
SELECT day, target, DATE '1970-01-01' + (x.start + td - 1)::INT AS kept, CASE WHEN b.m = 12 AND NOT had_two AND has_two THEN DATE '1970-01-01' + (z.start + least(d, 29) - 1)::INT END AS also FROM b JOIN months x ON x.y = target AND x.m = tm LEFT JOIN months z ON z.y = target AND z.m = 13""")
def anniversaries(t):
    """For each day the civil dates on which its Hebrew anniversary is kept in three years, and the other custom's day."""
    days = t("orders").select(F.to_date("o_orderdate").alias("day")).distinct().withColumn("h", H.hebrew_date(F.col("day"))).withColumn("target", F.explode(F.array(*[F.lit(y).cast("long") for y in (5761, 5762, 5763)])))
    return days.select("day", "target", H.anniversary(F.col("h"), F.col("target")).alias("kept"), H.second_adar(F.col("h"), F.col("target")).alias("also"))


@query("day_facts", "D17", f"""
WITH {_MONTHS}, f AS (SELECT *, extract(dow FROM day) AS week, CASE WHEN leap THEN 13 ELSE 12 END AS pm FROM days)
SELECT day, week AS dow, d = 30 OR (d = 1 AND m <> 7) AS rosh_chodesh, m = pm AND d = 14 AS purim,
 (m = pm AND ((d = 13 AND week <> 6) OR (d = 11 AND week = 4))) OR (m = 7 AND d = 3 AND week <> 6) OR (m = 7 AND d = 4 AND week = 0) OR (m = 10 AND d = 10) OR (m = 4 AND ((d = 17 AND week <> 6) OR (d = 18 AND week = 0))) OR (m = 5 AND ((d = 9 AND week <> 6) OR (d = 10 AND week = 0))) OR (m = 7 AND d = 10) AS fast,
 (m, d) IN ((7, 1), (7, 2), (7, 10), (7, 15), (7, 16), (7, 22), (7, 23), (1, 15), (1, 16), (1, 21), (1, 22), (3, 6), (3, 7)) AS yom_tov, (m = 7 AND d BETWEEN 17 AND 21) OR (m = 1 AND d BETWEEN 17 AND 20) AS chol_hamoed,
 CASE WHEN m = 1 AND d >= 15 THEN d - 14 WHEN m = 2 THEN d + 16 WHEN m = 3 AND d <= 4 THEN d + 45 END AS omer_tonight FROM f""")
def day_facts(t):
    """What each order's day is in the year of prayers, outside of Israel."""
    days = t("orders").select(F.to_date("o_orderdate").alias("day")).distinct().withColumn("f", H.day_facts(F.col("day"), F.lit(False)))
    return days.select("day", *[F.col(f"f.{x}") for x in ("dow", "rosh_chodesh", "purim", "fast", "yom_tov", "chol_hamoed", "omer_tonight")])


@query("day_times", "D10", """
WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), p(place, lat, lon) AS (VALUES ('Jerusalem', 31.778::DOUBLE, 35.235::DOUBLE), ('London', 51.5::DOUBLE, -0.12::DOUBLE)),
t AS (SELECT day, place, lat, lon, (date_diff('day', DATE '1970-01-01', day) + 2440588.0::DOUBLE - lon / 360 - 2451545.0::DOUBLE) / 36525 AS t FROM d, p),
a AS (SELECT *, 357.52911 + t * (35999.05029 - 0.0001537 * t) AS m, fmod(fmod(280.46646 + t * (36000.76983 + 0.0003032 * t), 360) + 360, 360) AS l, 0.016708634 - t * (0.000042037 + 0.0000001267 * t) AS e, 125.04 - 1934.136 * t AS node FROM t),
b AS (SELECT *, sin(radians(m)) * (1.914602 - t * (0.004817 + 0.000014 * t)) + sin(radians(2 * m)) * (0.019993 - 0.000101 * t) + sin(radians(3 * m)) * 0.000289 AS c, 23 + (26 + (21.448 - t * (46.815 + t * (0.00059 - t * 0.001813))) / 60) / 60 + 0.00256 * cos(radians(node)) AS tilt FROM a),
c AS (SELECT *, pow(tan(radians(tilt) / 2), 2) AS y, asin(sin(radians(tilt)) * sin(radians(l + c - 0.00569 - 0.00478 * sin(radians(node))))) AS decl FROM b),
n AS (SELECT *, 720 - 4 * lon - 4 * degrees(y * sin(radians(2 * l)) - 2 * e * sin(radians(m)) + 4 * e * y * sin(radians(m)) * cos(radians(2 * l)) - 0.5 * y * y * sin(radians(4 * l)) - 1.25 * e * e * sin(radians(2 * m))) AS noon,
  4 * degrees(acos((cos(radians(90.833)) - sin(radians(lat)) * sin(decl)) / (cos(radians(lat)) * cos(decl)))) AS half, (cos(radians(98.5)) - sin(radians(lat)) * sin(decl)) / (cos(radians(lat)) * cos(decl)) AS stars FROM c)
SELECT day, place, round(noon - half, 3) AS sunrise, round(noon - half + half / 2, 3) AS shma, round(noon - half - 72 + (half + 72) / 2, 3) AS shma_mga, round(noon, 3) AS chatzot, round(noon - half + 10.75 * half / 6, 3) AS plag, round(noon + half, 3) AS sunset, round(CASE WHEN abs(stars) <= 1 THEN noon + 4 * degrees(acos(stars)) END, 3) AS tzeit FROM n""")
def day_times(t):
    """The times of each order's day at two places, in minutes after midnight UTC."""
    places = F.broadcast(t.values([("Jerusalem", 31.778, 35.235), ("London", 51.5, -0.12)], "place string, lat double, lon double"))  # a fixed few
    days = t("orders").select(F.to_date("o_orderdate").alias("day")).distinct().crossJoin(places).withColumn("s", S.day_times(F.col("day"), F.col("lat"), F.col("lon")))
    return days.select("day", "place", *[F.round(F.col(f"s.{x}"), 3).alias(x) for x in ("sunrise", "shma", "shma_mga", "chatzot", "plag", "sunset", "tzeit")])


# The weekly portions as tables: Sabbaths of cycles cut into stretches, and portions dealt to them in order.
_NAMES = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in P.PORTIONS) + "]"
_PORTIONS = f"""
s0 AS (SELECT y, m, start + i AS dn, i + 1 AS d FROM months, generate_series(0, 29) g(i) WHERE i < days AND (start + i) % 7 = 2),
s1 AS (SELECT il, dn, y - (m = 7 AND d <= CASE WHEN il THEN 22 ELSE 23 END)::INT AS cyc,
  CASE WHEN m = 7 AND d <= CASE WHEN il THEN 22 ELSE 23 END THEN 5 WHEN m >= 7 OR (m = 1 AND d < 15) THEN 1 WHEN m < 3 OR (m = 3 AND d < 6) THEN 2 WHEN m < 5 OR (m = 5 AND d <= 9) THEN 3 ELSE 4 END AS st,
  NOT ((m = 7 AND d IN (1, 2, 10)) OR (m = 7 AND d BETWEEN 15 AND 22) OR (m = 1 AND d BETWEEN 15 AND 21) OR (m = 3 AND d = 6) OR (NOT il AND ((m = 7 AND d = 23) OR (m = 1 AND d = 22) OR (m = 3 AND d = 7)))) AS ord FROM s0, (VALUES (false), (true)) v(il)),
s2 AS (SELECT *, row_number() OVER (PARTITION BY il, cyc, st, ord ORDER BY dn) AS n FROM s1),
c AS (SELECT il, cyc, (7 * cyc + 1) % 19 < 7 AS lp, count(*) FILTER (ord AND st = 1) AS c1, count(*) FILTER (ord AND st = 2) AS c2, count(*) FILTER (ord AND st = 3) AS c3, count(*) FILTER (ord AND st = 4) AS c4, count(*) FILTER (ord AND st = 5) AS c5 FROM s1 GROUP BY 1, 2),
e AS (SELECT *, CASE WHEN lp THEN c1 ELSE 25 END AS e1, CASE WHEN lp THEN c1 + c2 ELSE 34 END AS e2, 51 + (c5 = 1)::INT AS e4 FROM c),
sp AS (SELECT il, cyc, 1 AS st, 1 AS a, e1 AS b, c1 AS n FROM e UNION ALL SELECT il, cyc, 2, e1 + 1, e2, c2 FROM e UNION ALL SELECT il, cyc, 3, e2 + 1, 44, c3 FROM e UNION ALL SELECT il, cyc, 4, 45, e4, c4 FROM e UNION ALL SELECT il, cyc, 5, e4 + 1, 53, c5 FROM e),
pr(st, pref, number) AS (VALUES (1, 1, 22), (2, 1, 27), (2, 2, 29), (2, 3, 32), (3, 1, 42), (3, 2, 39), (4, 1, 51)),
nu AS (SELECT il, cyc, sp.st, g.number, coalesce(pref <= b - a + 1 - n, false) AS nxt FROM sp JOIN generate_series(1, 53) g(number) ON g.number BETWEEN a AND b LEFT JOIN pr ON pr.st = sp.st AND pr.number = g.number),
nv AS (SELECT *, coalesce(lag(nxt) OVER (PARTITION BY il, cyc, st ORDER BY number), false) AS second FROM nu),
rd AS (SELECT il, cyc, st, ({_NAMES})[number] || CASE WHEN nxt THEN '-' || ({_NAMES})[number + 1] ELSE '' END AS portion, row_number() OVER (PARTITION BY il, cyc, st ORDER BY number) AS n FROM nv WHERE NOT second),
ws AS (SELECT il, dn, portion FROM s2 LEFT JOIN rd USING (il, cyc, st, n) WHERE ord UNION ALL SELECT il, dn, NULL FROM s2 WHERE NOT ord)"""


@query("portion_of_week", "D14", f"""
WITH {_MONTHS}, {_PORTIONS},
o AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), x AS (SELECT day, date_diff('day', DATE '1970-01-01', day) AS n FROM o), z AS (SELECT day, n + (9 - n % 7) % 7 AS dn FROM x)
SELECT day, DATE '1970-01-01' + z.dn::INT AS sabbath, a.portion, b.portion AS portion_il FROM z JOIN ws a ON a.dn = z.dn AND NOT a.il JOIN ws b ON b.dn = z.dn AND b.il""")
def portion_of_week(t):
    """The portion of the coming Sabbath for each order's day, abroad and in Israel; null on a festival."""
    days = t("orders").select(F.to_date("o_orderdate").alias("day")).where("day is not null").distinct()
    span = days.agg(F.min(H.hebrew_date(F.col("day"))["year"]).alias("first"), F.max(H.hebrew_date(F.col("day"))["year"]).alias("last")).first()
    ends = (span["first"] - 1, span["last"] + 1) if span["first"] else (5784, 5784)
    days = days.withColumn("sabbath", F.date_add("day", F.pmod(7 - F.dayofweek("day"), F.lit(7))))
    abroad, there = (P.readings(t.spark, *ends, israel).withColumnsRenamed({"day": "sabbath", "portion": name}) for israel, name in ((False, "portion"), (True, "portion_il")))
    return days.join(abroad, "sabbath", "left").join(there, "sabbath", "left").select("day", "sabbath", "portion", "portion_il")


@query("psalms_by_day", "D19", f"""
WITH {_MONTHS}, f AS (SELECT days.day, days.d, months.days AS size FROM days JOIN months USING (y, m)), l(a) AS (SELECT ['1-9','10-17','18-22','23-28','29-34','35-38','39-43','44-48','49-54','55-59','60-65','66-68','69-71','72-76','77-78','79-82','83-87','88-89','90-96','97-103','104-105','106-107','108-112','113-118','119:1-96','119:97-176','120-134','135-139','140-144','145-150'])
SELECT day, CASE WHEN d = 29 AND size = 29 THEN a[29] || ', ' || a[30] ELSE a[d::INT] END AS by_month, (['1-29','30-50','51-72','73-89','90-106','107-119','120-150'])[extract(dow FROM day) + 1] AS by_week FROM f, l""")
def psalms_by_day(t):
    """The day's psalms by the two divisions of the book."""
    days = t("orders").select(F.to_date("o_orderdate").alias("day")).distinct().withColumn("h", H.hebrew_date(F.col("day")))
    return days.select("day", P.psalms_of_month(F.col("h.day"), P.month_size(F.col("h"))).alias("by_month"), P.psalms_of_week(F.col("day")).alias("by_week"))


@query("omitted_days", "D20", f"""
WITH {_MONTHS.replace("FROM orders)", "FROM orders UNION SELECT DISTINCT CAST(o_orderdate AS DATE) + 1, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 1 FROM orders)")},
k AS (SELECT y, start FROM months WHERE m = 9),
r AS (SELECT day, d, m, extract(dow FROM day) AS week, il,
  CASE WHEN d = 30 OR (d = 1 AND m <> 7) THEN 'Rosh Chodesh' WHEN date_diff('day', DATE '1970-01-01', day) - k.start BETWEEN 24 AND 31 THEN 'Chanukah' WHEN m = 11 AND d = 15 THEN 'Tu BiShvat' WHEN leap AND m = 12 AND d IN (14, 15) THEN 'Purim Katan'
    WHEN m = CASE WHEN leap THEN 13 ELSE 12 END AND d = 14 THEN 'Purim' WHEN m = CASE WHEN leap THEN 13 ELSE 12 END AND d = 15 THEN 'Shushan Purim' WHEN m = 2 AND ((d = 5 AND extract(dow FROM day) NOT IN (5, 6)) OR (d IN (3, 4) AND extract(dow FROM day) = 4)) THEN 'Yom HaAtzma''ut'
    WHEN m = 2 AND d = 28 THEN 'Yom Yerushalayim' WHEN m = 2 AND d = 18 THEN 'Lag BaOmer' WHEN m = 5 AND ((d = 9 AND extract(dow FROM day) <> 6) OR (d = 10 AND extract(dow FROM day) = 0)) THEN 'Tisha B''Av' WHEN m = 5 AND d = 15 THEN 'Tu B''Av' END AS whole,
  CASE WHEN m = 1 THEN 'Nisan' WHEN m = 2 AND d = 14 THEN 'Pesach Sheni' WHEN m = 3 AND (d = 6 OR (d = 7 AND NOT il)) THEN 'Shavuot' WHEN m = 3 AND d <= CASE WHEN il THEN 12 ELSE 8 END THEN 'the days around Shavuot'
    WHEN m = 7 AND d = 9 THEN 'Erev Yom Kippur' WHEN m = 7 AND d = 10 THEN 'Yom Kippur' WHEN m = 7 AND d BETWEEN 11 AND CASE WHEN il THEN 30 ELSE 24 END THEN 'the days of Sukkot' WHEN m = 7 AND d <= 2 THEN 'Rosh HaShana' WHEN m = 6 AND d = 29 THEN 'Erev Rosh HaShana' END AS own,
  (m = 7 AND d IN (1, 2, 10, 15, 22)) OR (m = 1 AND d IN (15, 21)) OR (m = 3 AND d = 6) OR (NOT il AND ((m = 7 AND d IN (16, 23)) OR (m = 1 AND d IN (16, 22)) OR (m = 3 AND d = 7))) AS feast
  FROM days JOIN k USING (y), (VALUES (false), (true)) v(il))
SELECT a.day, a.il, a.week <> 6 AND a.whole IS NULL AND a.own IS NULL AS morning, a.week NOT IN (5, 6) AND a.whole IS NULL AND a.own IS NULL AND NOT b.feast AND b.whole IS NULL AS afternoon,
  CASE WHEN a.week = 6 THEN 'Shabbat' WHEN a.whole IS NOT NULL THEN a.whole WHEN a.own IS NOT NULL THEN a.own WHEN a.week = 5 THEN 'Erev Shabbat' WHEN b.feast THEN 'Erev Yom Tov' WHEN b.whole IS NOT NULL THEN 'the afternoon before ' || b.whole END AS why
FROM r a JOIN r b ON b.day = a.day + 1 AND b.il = a.il WHERE a.day IN (SELECT CAST(o_orderdate AS DATE) FROM orders)""")
def omitted_days(t):
    """Whether the supplication is said on each order's day, morning and afternoon, abroad and in Israel, and why not."""
    days = t("orders").select(F.to_date("o_orderdate").alias("day")).distinct().withColumn("il", F.explode(F.array(F.lit(False), F.lit(True))))
    return days.select("day", "il", P.omission(F.col("day"), F.col("il")).alias("o")).select("day", "il", "o.*")

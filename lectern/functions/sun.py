"""The sun's times of a day at a place, and the hours of the day that follow from them, as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.hebrew_calendar import let

# The sun's centre below the horizon, in degrees, at each time.
RISE, DAWN, TALLIT, STARS_MEDIUM, STARS = 0.833, 16.1, 11.5, 7.083, 8.5
#: Minutes of the day before sunrise and after sunset by the longer reckoning.
MARGIN = 72


def _orbit(date: Column, lon: Column) -> Column:
    """(decl, eot): the sun's declination in radians and the equation of time in minutes, at noon of the place."""
    century = (F.unix_date(date) + 2_440_588.0 - lon / 360 - 2_451_545.0) / 36_525

    def bound(t: Column) -> Column:
        rad, sin = F.radians, lambda x: F.sin(F.radians(x))
        mean, long_ = 357.52911 + t * (35999.05029 - 0.0001537 * t), F.pmod(280.46646 + t * (36000.76983 + 0.0003032 * t), F.lit(360.0))
        e, node = 0.016708634 - t * (0.000042037 + 0.0000001267 * t), 125.04 - 1934.136 * t
        centre = sin(mean) * (1.914602 - t * (0.004817 + 0.000014 * t)) + sin(2 * mean) * (0.019993 - 0.000101 * t) + sin(3 * mean) * 0.000289
        tilt = 23 + (26 + (21.448 - t * (46.815 + t * (0.00059 - t * 0.001813))) / 60) / 60 + 0.00256 * F.cos(rad(node))
        y = F.pow(F.tan(rad(tilt) / 2), 2)
        eot = 4 * F.degrees(y * sin(2 * long_) - 2 * e * sin(mean) + 4 * e * y * sin(mean) * F.cos(rad(2 * long_)) - 0.5 * y * y * sin(4 * long_) - 1.25 * e * e * sin(2 * mean))
        return F.struct(F.asin(sin(tilt) * sin(long_ + centre - 0.00569 - 0.00478 * sin(node))).alias("decl"), eot.alias("eot"))

    return let(century, bound)


def day_times(date: Column, lat: Column, lon: Column) -> Column:
    """Minutes after midnight UTC of the times of a civil date; null where the sun does not reach that height.

    Hours of the day are twelfths of the time from sunrise to sunset, or, by the longer reckoning (``mga``), of the day
    with MARGIN minutes at both ends.
    """

    def timed(o: Column) -> Column:
        noon = 720 - 4 * lon - o["eot"]
        cosine = lambda below: (F.cos(F.radians(F.lit(90 + below))) - F.sin(F.radians(lat)) * F.sin(o["decl"])) / (F.cos(F.radians(lat)) * F.cos(o["decl"]))
        arc = lambda below: F.when(F.abs(cosine(below)) <= 1, 4 * F.degrees(F.acos(cosine(below))))
        half = arc(RISE)
        hour = lambda n: noon - half + n * half / 6
        longer = lambda n: noon - half - MARGIN + n * (half + MARGIN) / 6
        named = {
            "alot": noon - arc(DAWN), "misheyakir": noon - arc(TALLIT), "sunrise": hour(0), "shma_mga": longer(3), "shma": hour(3), "tefillah_mga": longer(4), "tefillah": hour(4), "chatzot": noon,
            "mincha_gedola": hour(6.5), "mincha_ketana": hour(9.5), "plag": hour(10.75), "sunset": hour(12), "tzeit_medium": noon + arc(STARS_MEDIUM), "tzeit": noon + arc(STARS), "rabbeinu_tam": hour(12) + MARGIN,
        }
        return F.struct(*[c.alias(name) for name, c in named.items()])

    return let(_orbit(date, lon), timed)

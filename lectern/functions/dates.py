"""Column functions on time and on places on the globe."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def km_between(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371 * F.asin(F.sqrt(h))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """The direction of the second point in degrees from north, 0 to 360."""
    y = F.sin(F.radians(lon2 - lon1)) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(F.radians(lon2 - lon1))
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def compass(degrees: Column) -> Column:
    names = "N NNE NE ENE E ESE SE SSE S SSW SW WSW W WNW NW NNW".split()
    return F.element_at(F.array(*map(F.lit, names)), (F.round(degrees / 22.5) % 16 + 1).cast("int"))


def bucket(day: Column, today: Column) -> Column:
    """Today, Yesterday, This week or Earlier."""
    n = F.datediff(today, day)
    return F.when(n <= 0, "Today").when(n == 1, "Yesterday").when(n < 7, "This week").otherwise("Earlier")


def ago(time: Column, now: Column) -> Column:
    """Age in whole days of 24 hours."""
    days = F.floor((F.unix_timestamp(now) - F.unix_timestamp(time)) / 86400)
    return F.when(days <= 0, "today").when(days == 1, "yesterday").when(days < 30, F.concat(days.cast("string"), F.lit(" days ago"))).otherwise(F.concat(F.floor(days / 30).cast("string"), F.lit(" months ago")))

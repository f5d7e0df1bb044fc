"""Columns of a printed page and the time of a line, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lines that the side texts share across the top, as they are set and as they are counted in areas.
TOP_LINES, TOP_AREA_LINES = 4.3, 4


def spacers(width: Column, main_share: Column, top_share: Column, pad_h: Column, pad_v: Column, line: Column, main: Column, inner: Column, outer: Column) -> Column:
    """(start, inner, outer, end, exception): how far the two side texts run above, beside and below the main one.

    ``main``, ``inner`` and ``outer`` are heights of texts set alone in their columns. Areas decide: no side text at all,
    too little for the top (exception 3), one side text too short for it (1 and 2), a main text that is shorter than both,
    stairs where the longer side text steps past the block of the other two, or side texts wrapped by the main one.
    """
    mid, side, top, start = width * main_share - 2 * pad_h, width * (1 - main_share) / 2 - pad_h, width * top_share - pad_h, TOP_LINES * line
    lost = TOP_AREA_LINES * line * top
    inner_area, outer_area = inner * side - lost, outer * side - lost
    low, high = F.least(inner_area, outer_area), F.greatest(inner_area, outer_area)
    block = main * mid + low
    tall = block / (mid + side)
    step = (block - pad_h * (tall - low / side)) / (mid + side)
    alone = lambda area: (area + lost - width * TOP_AREA_LINES * line) / side
    zero = F.lit(0.0)

    def shape(start: Column, inner: Column, outer: Column, end: Column = zero, exception: int = 0) -> Column:
        return F.struct(start.cast("double").alias("start"), inner.cast("double").alias("inner"), outer.cast("double").alias("outer"), end.cast("double").alias("end"), F.lit(exception).alias("exception"))

    inner_low = inner_area <= outer_area
    return (
        F.when((inner <= 0) & (outer <= 0), shape(zero, zero, zero))
        .when(high / side <= start, shape(F.greatest(inner * side / top, outer * side / top, zero), zero, zero, exception=3))
        .when(inner <= start, shape(start, inner, alone(outer_area), exception=1))
        .when(outer <= start, shape(start, alone(inner_area), outer, exception=2))
        .when(main <= low / side, shape(start, main, main, F.greatest(zero, (low - main * side - side * pad_v) / top)))
        .when(tall < high / side, shape(start, F.when(inner_low, low / side).otherwise(step), F.when(inner_low, step).otherwise(low / side)))
        .otherwise(shape(start, inner_area / side, outer_area / side))
    )


def line_condition(kind: Column, english: Column, hebrew: Column) -> Column:
    """The time at which a whole line is said; null if it has none.

    ``english`` and ``hebrew`` are the tags (kind, condition) of the line's phrases, null for a phrase without one. The
    English counts where the Hebrew names no time itself; the Hebrew where it is one phrase or the later ones have no tag.
    """
    time = lambda tags: F.when(F.get(tags, F.lit(0))["kind"] == "when", F.get(tags, F.lit(0))["condition"])
    timed = F.coalesce(F.get(hebrew, F.lit(0))["kind"] == "when", F.lit(False))
    rest = F.slice(hebrew, F.lit(2), F.greatest(F.size(hebrew) - 1, F.lit(0)))
    own = F.when((F.size(hebrew) == 1) | F.exists(rest, lambda x: x.isNull()), time(hebrew))
    return F.when(kind == "prayer", F.coalesce(F.when(~timed, time(english)), own, F.when((F.size(hebrew) == 0) & (F.size(english) == 1), time(english))))

"""Column functions on hierarchical references such as ``Genesis 1:3`` or ``Berakhot 2a:4``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def section_of(ref: Column) -> Column:
    """Up to the last colon, else up to the last space, else the reference itself."""
    colon, space = F.regexp_extract(ref, r"^(?s)(.+):", 1), F.regexp_extract(ref, r"^(?s)(.+) ", 1)
    return F.when(colon != "", colon).when(space != "", space).otherwise(ref)


def book_of(ref: Column) -> Column:
    """The name before a numeric place; all of it if there is none."""
    found = F.regexp_extract(ref, r"^(.*?) (\d+[ab]?(?::\d+)*)$", 1)
    return F.when(ref.rlike(r"^.*? \d+[ab]?(?::\d+)*$"), found).otherwise(ref)


def place_of(ref: Column) -> Column:
    return F.regexp_extract(ref, r"^(.*?) (\d+[ab]?(?::\d+)*)$", 2)


_RANGE = r"^(.*\s)(\d+[ab]?(?::\d+[ab]?)*)-([\d:ab]+)$"


def tidy(ref: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(ref), r"\s+", " "), "[–—]", "-")


def range_start(ref: Column) -> Column:
    clean = tidy(ref)
    return F.when(clean.rlike(_RANGE), F.concat(F.regexp_extract(clean, _RANGE, 1), F.regexp_extract(clean, _RANGE, 2))).otherwise(clean)


def range_end(ref: Column) -> Column:
    """The end of a range with the levels it leaves out taken from the start; null if there is no range."""
    clean = tidy(ref)
    start, end = F.split(F.regexp_extract(clean, _RANGE, 2), ":"), F.split(F.regexp_extract(clean, _RANGE, 3), ":")
    keep = F.greatest(F.size(start) - F.size(end), F.lit(0))
    whole = F.concat(F.slice(start, F.lit(1), keep), end)
    return F.when(clean.rlike(_RANGE), F.concat(F.regexp_extract(clean, _RANGE, 1), F.array_join(whole, ":")))


def link_start(ref: Column) -> Column:
    """A link's end as one passage: the end of a range is left off, other references stay as they are."""
    return F.regexp_replace(F.trim(ref), r"\s(\d+[ab]?(?::\d+[ab]?)*)(?:-[\d:ab]+)?$", " $1")


def place_key(place: Column) -> Column:
    """Sort key of a place: each part as a number, sides a and b in between; other parts last."""
    part = lambda p: F.when(p.rlike(r"^\d+[ab]?$"), F.regexp_extract(p, r"^(\d+)", 1).cast("long") * 2 + F.when(p.endswith("b"), 1).otherwise(0)).otherwise(F.lit(9007199254740991))
    return F.transform(F.split(place, ":"), part)


def address(kind: Column, index: Column, offset: Column) -> Column:
    """The written address of the index-th unit of its kind: leaves have two sides, folios four."""
    n = index + offset
    side = lambda letters, by: F.substring(F.lit(letters), (F.pmod(n, F.lit(by)) + 1).cast("int"), F.lit(1))
    leaf = lambda by: (F.floor(n / by) + 1).cast("string")
    return F.when(kind == "Talmud", F.concat(leaf(2), side("ab", 2))).when(kind == "Folio", F.concat(leaf(4), side("abcd", 4))).otherwise((n + 1).cast("string"))


def normal_ref(ref: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(ref), r"\s+", " "))


def offset_for(offsets: Column, depth: Column, parents: Column) -> Column:
    """What is added to a place of ``depth`` below ``parents`` (array of indices), by a JSON object of nested lists under each depth; 0 if it says nothing."""
    path = F.concat(F.lit("$."), depth.cast("string"), F.array_join(F.transform(parents, lambda p: F.concat(F.lit("["), p.cast("string"), F.lit("]"))), ""))
    return F.coalesce(F.call_function("get_json_object", offsets, path).try_cast("int"), F.lit(0))

"""Glosses laid on the words of a text: each item takes the next run of words that is spelled alike."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that an item may pass over, itself included.
AHEAD = 8
ROWS = "array<struct<at: int, n: int, item: int>>"


def letters(word: Column) -> Column:
    return F.regexp_replace(F.lower(word), r"[^\p{L}]", "")


def frame(key: Column, weak: str) -> Column:
    """The letters of a word but those that a short spelling leaves out."""
    return F.regexp_replace(key, f"[{weak}]", "")


def rows_of(lettered: list[bool], frames: list[str], wanted: list[tuple[bool, str]], ahead: int = AHEAD) -> list[tuple[int, int, int | None]]:
    """(at, n, item) of rows that together hold every word once; item is null for words that none took.

    ``lettered`` says which words have letters, ``wanted`` gives of each item whether it has any and its frame. An item takes the first run
    of words, begun within ``ahead`` words, whose frames together are its own; items that fit nowhere are passed over. Words without
    letters go with the row before them.
    """
    whole, edges = "".join(frames), [0]
    for f in frames:
        edges.append(edges[-1] + len(f))
    out: list[list] = []

    def plain(start: int, end: int) -> None:
        if end <= start:
            return
        joins = out and (out[-1][2] is None or not any(lettered[start:end]))
        if joins:
            out[-1][1] += end - start
        else:
            out.append([start, end - start, None])

    at = 0
    for item, (some, want) in enumerate(wanted):
        if not some:
            continue
        for s in range(at, min(len(frames), at + ahead)):
            if not lettered[s] or not whole.startswith(want, edges[s]):
                continue
            # the first word with letters at whose end the frames are as long as the item's
            e = max(s, bisect_left(edges, edges[s] + len(want), s + 1) - 1)
            while e < len(frames) and edges[e + 1] == edges[s] + len(want) and not lettered[e]:
                e += 1
            if e < len(frames) and edges[e + 1] == edges[s] + len(want):
                plain(at, s)
                out.append([s, e + 1 - s, item])
                at = e + 1
                break
    plain(at, len(frames))
    return [tuple(r) for r in out]


def gloss_rows(words: Column, items: Column, weak: str = "aeiou", ahead: int = AHEAD) -> Column:
    """Rows of an array of words against an array of items (each one or more words): see ``rows_of``."""
    keys, wants = F.transform(words, letters), F.transform(items, letters)

    @F.pandas_udf(ROWS)
    def lay(k: pd.Series, f: pd.Series, w: pd.Series, v: pd.Series) -> pd.Series:
        return pd.Series([[{"at": a, "n": n, "item": i} for a, n, i in rows_of([bool(x) for x in a_], list(b_), [(bool(x), y) for x, y in zip(c_, d_, strict=True)], ahead)] for a_, b_, c_, d_ in zip(k, f, w, v, strict=True)])

    return lay(keys, F.transform(keys, lambda x: frame(x, weak)), wants, F.transform(wants, lambda x: frame(x, weak)))

"""Sequential packing: groups up to a budget, parts at sentence ends, balanced shards, merged orders."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame


#: Titles that are dealt out on the driver, at most.
TITLES = 1_000_000


def balance(sizes: DataFrame, shards: int) -> DataFrame:
    """(title, n, shard): titles (title, n) longest first, each to the shard with least so far.

    The order of all titles decides, so one row for each reaches the driver; a catalogue of more than ``TITLES`` is refused.
    """
    if sizes.limit(TITLES + 1).count() > TITLES:
        raise ValueError(f"more than {TITLES} titles cannot be dealt out on the driver")
    load, out = [(0, s) for s in range(shards)], []
    for title, n in sorted(((r["title"], r["n"]) for r in sizes.collect()), key=lambda x: (-x[1], x[0])):
        held, s = heapq.heappop(load)
        out.append((title, n, s))
        heapq.heappush(load, (held + n, s))
    return sizes.sparkSession.createDataFrame(out, "title string, n long, shard int")


def pack(rows: DataFrame, key: str, budget: int) -> DataFrame:
    """(key, seq, words, pack): consecutive rows (key, seq, words) in packs of at most ``budget`` words."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame, held, n, out = frame.sort_values("seq"), 0, 0, []
        for words in frame["words"]:
            if held and held + words > budget:
                held, n = 0, n + 1
            held += words
            out.append(n)
        return frame.assign(pack=out)[[key, "seq", "words", "pack"]]

    return rows.groupBy(key).applyInPandas(run, f"{key} string, seq long, words long, pack int")


def parts_of(words: list[str], size: int = 70, least: int = 40) -> list[list[str]]:
    """Words in parts of about ``size``, ended at a sentence once ``least`` are in; a short tail joins the part before."""
    out: list[list[str]] = [[]]
    for w in words:
        if len(out[-1]) >= size or len(out[-1]) >= least and out[-1][-1][-1:] in ".:?!׃":
            out.append([])
        out[-1].append(w)
    if len(out) > 1 and len(out[-1]) < least // 4:
        tail = out.pop()
        out[-1] += tail
    return [p for p in out if p]


def merge_orders(lists: list[list[str]]) -> list[str]:
    """One order of several: the longest list, what others have besides put after what comes before it there."""
    out = list(max(lists, key=len, default=[]))
    for own in lists:
        before = None
        for x in own:
            if x not in out:
                out.insert(out.index(before) + 1 if before is not None else 0, x)
            before = x
    return out

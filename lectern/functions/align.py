"""Alignment of a short string in a longer one, and chains of places."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

# Letters that look alike in print.
ALIKE = ("דר", "בכ", "החת", "וזינ", "סםמ", "טש", "עצ", "גנ", "כך", "פף", "צץ", "נן", "ךן")


class Substitutions:
    """What it costs to read one letter for another: nothing, ``near`` within a group of look-alikes, else ``far``."""

    def __init__(self, groups: Iterable[str] = (), near: float = 0.6, far: float = 1.0):
        letters = sorted({c for g in groups for c in g})
        self.codes = np.array([ord(c) for c in letters], dtype=np.int64)
        # the last row is for all other letters
        self.table = np.full((len(letters) + 1, len(letters) + 1), far)
        for g in groups:
            at = np.searchsorted(self.codes, [ord(c) for c in g])
            self.table[np.ix_(at, at)] = near

    def index(self, points: np.ndarray) -> np.ndarray:
        if not len(self.codes):
            return np.zeros(len(points), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.codes, points), len(self.codes) - 1)
        return np.where(self.codes[at] == points, at, len(self.codes))

    def rows(self, query: str, text: str) -> Iterable[np.ndarray]:
        """For each letter of ``query`` what it costs against each of ``text``."""
        q, t = points(query), points(text)
        at, to = self.index(q), self.index(t)
        for c, i in zip(q.tolist(), at.tolist(), strict=True):
            yield np.where(t == c, 0.0, self.table[i, to])


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.int64)


PLAIN = Substitutions(far=1.5)
LOOKALIKE = Substitutions(ALIKE)


def costs(query: str, text: str, gap: float = 1.0, letters: Substitutions = PLAIN, anchored: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(cost, start): for each end in ``text`` the least cost of matching all of ``query``, and where that match begins.

    One row of the table at a time; the text may be skipped for free at both ends, ``anchored`` at its end alone.
    """
    n = len(text)
    steps = np.arange(n + 1) * gap
    cost, start = (steps.copy(), np.zeros(n + 1, dtype=np.int64)) if anchored else (np.zeros(n + 1), np.arange(n + 1))
    for row in letters.rows(query, text):
        change = np.r_[np.inf, cost[:-1] + row]
        drop = cost + gap
        came = np.where(change <= drop, np.r_[0, start[:-1]], start)
        best = np.minimum(change, drop)
        # what is added inside the match: a running minimum after taking the slope out
        flat = best - steps
        low = np.minimum.accumulate(flat)
        at = np.maximum.accumulate(np.where(flat <= low, np.arange(n + 1), 0))
        cost, start = low + steps, came[at]
    return cost, start


def align(query: str, text: str, gap: float = 1.0) -> tuple[float, int, int]:
    """(cost, start, end) of the best place; the first of equals."""
    return first_best(*costs(query, text, gap))


def first_best(cost: np.ndarray, start: np.ndarray) -> tuple[float, int, int]:
    end = int(cost.argmin())
    return float(cost[end]), int(start[end]), end


def best_places(query: str, text: str, top: int, most: float, gap: float = 1.0) -> list[tuple[float, int, int]]:
    """Up to ``top`` places that do not overlap, best first, none above ``most``."""
    return apart(*costs(query, text, gap), top, most)


def apart(cost: np.ndarray, start: np.ndarray, top: int, most: float) -> list[tuple[float, int, int]]:
    out: list[tuple[float, int, int]] = []
    for end in np.argsort(cost, kind="stable").tolist():
        if cost[end] > most or len(out) == top:
            break
        if all(end <= s or start[end] >= e for _, s, e in out):
            out.append((float(cost[end]), int(start[end]), end))
    return out


def chain(options: list[list[tuple[float, float]]], window: float) -> list[float | None]:
    """One start (start, cost) for each step such that starts never go back; jumps beyond ``window`` cost one each.

    A step for which every option would go back is left out at a cost of ten, and its start is None.
    """
    # of each state: cost, start so far, and the states before it
    held: list[tuple[float, float, tuple]] = [(0.0, float("-inf"), ())]
    for own in options:
        step = []
        for cost, at, way in held:
            step.append((cost + 10.0, at, (way, None)))
            step += [(cost + c + (1.0 if s - at > window and at > float("-inf") else 0.0), s, (way, s)) for s, c in own if s >= at]
        # of equal starts only the cheapest matters
        best: dict[float, tuple[float, float, tuple]] = {}
        for state in step:
            if state[1] not in best or state[0] < best[state[1]][0]:
                best[state[1]] = state
        held = list(best.values())
    way, out = min(held, key=lambda x: (x[0], x[1]))[2], []
    while way:
        way, start = way
        out.append(None if start is None else float(start))
    return out[::-1]


def partners(query: str, text: str, gap: float = 1.0, letters: Substitutions = LOOKALIKE) -> list[int]:
    """For each letter of ``query`` the place in ``text`` that it stands for in the best match, -1 for a letter that is extra."""
    if not query or not text:
        return [-1] * len(query)
    rows = [np.zeros(len(text) + 1)]
    steps, each = np.arange(len(text) + 1) * gap, list(letters.rows(query, text))
    for row in each:
        best = np.minimum(np.r_[np.inf, rows[-1][:-1] + row], rows[-1] + gap)
        rows.append(np.minimum.accumulate(best - steps) + steps)
    out, j = [-1] * len(query), int(rows[-1].argmin())
    for i in range(len(query), 0, -1):
        # letters of the text that the query lacks are passed over first
        while j and rows[i][j] < min(rows[i - 1][j - 1] + each[i - 1][j - 1], rows[i - 1][j] + gap) - 1e-9:
            j -= 1
        if j and rows[i - 1][j - 1] + each[i - 1][j - 1] <= rows[i - 1][j] + gap + 1e-9:
            j -= 1
            out[i - 1] = j
    return out


def options(query: str, text: str, top: int = 3, most: float = 0.5, letters: Substitutions = LOOKALIKE) -> list[tuple[int, int, float]]:
    """(start, end, likeness) of up to ``top`` places apart from each other, best first, none above ``most`` a letter."""
    if not query or not text:
        return []
    return [(s, e, 1 - c / len(query)) for c, s, e in apart(*costs(query, text, letters=letters), top, most * len(query))]


def is_abbreviation(short: str, words: list[str]) -> bool:
    """The letters of ``short`` come in order in the words, the first at their start and each word used."""
    at = 0
    for n, word in enumerate(words):
        if at >= len(short) or short[at] != word[:1]:
            return False
        at += 1
        for c in word[1:]:
            if at < len(short) and short[at] == c and len(short) - at > len(words) - n - 1:
                at += 1
    return at == len(short)

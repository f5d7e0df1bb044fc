"""A printed line of prayer in segments: marks, words for a time, responses, two forms of one word."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Signs of the print and what they ask.
MARKS = {"▾": "bow", "▴": "rise", "°": "strike", "◂": "leader"}
# Two words that are one for a man and for a woman though their letters differ, and words said of oneself.
PAIRS, OWN = {("בן", "בת")}, {"מודה"}

_WORD = "[א-ת][֑-ׇא-ת]*"
_TIMED = r"/\s*(?P<label>[^/:\n]{2,70}?):\s*(?P<words>[^/\n]+?)\s*/"
_SAID = r"\((?P<who>קהל(?: וש\"ץ)?|Cong\.?|All)\s*:\s*(?P<reply>[^()]+?)\)"
_FORMS = rf"(?P<one>{_WORD})/\s?(?P<two>{_WORD})/?"
_ANY = re.compile(f"{_TIMED}|{_SAID}|{_FORMS}|(?P<mark>[{''.join(MARKS)}])")

SEGMENT = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "text", "label", "words", "other")]))


def gender_pair(one: str, two: str) -> str | None:
    """"speaker" or "other" if two words are one word for a man and for a woman: alike but for the last letter at most."""
    a, b = (re.sub("[^א-ת]", "", w) for w in (one, two))
    alike = a == b or (a, b) in PAIRS or len(a) == len(b) >= 3 and a[:-1] == b[:-1]
    return ("speaker" if a in OWN else "other") if min(len(a), len(b)) >= 2 and alike else None


def segments(text: str, times: frozenset[str] | set[str]) -> list[tuple]:
    """(kind, text, label, words, other) in order; the texts together are the line as printed.

    Words between slashes count as said at a time only if ``times`` knows their label. What a segment cannot be is
    looked at again from its next character, as plain text.
    """
    out: list[tuple] = []
    plain, at = "", 0

    def flush() -> None:
        nonlocal plain
        if plain:
            out.append(("text", plain, None, None, None))
        plain = ""

    while (m := _ANY.search(text, at)) is not None:
        plain += text[at : m.start()]
        kind = None
        if m["label"] is not None and m["label"].strip() in times:
            kind = ("when", m[0], m["label"].strip(), m["words"].strip(), None)
        elif m["who"] is not None:
            kind = ("response", m[0], m["who"], m["reply"].strip(), None)
        elif m["one"] is not None and (said := gender_pair(m["one"], m["two"])):
            kind = ("gender", m[0], said, m["one"], m["two"])
        elif m["mark"] is not None:
            kind = (MARKS[m[0]], m[0], None, None, None)
        if kind is None:
            # a slash or a word that opened nothing
            step = len(m["one"]) if m["one"] is not None else 1
            plain, at = plain + m[0][:step], m.start() + step
            continue
        flush()
        out.append(kind)
        at = m.end()
    plain += text[at:]
    flush()
    return out


def line_segments(times: list[str]):
    """A column function: the segments of lines, with the labels of times that are known."""
    known = frozenset(times)

    @F.pandas_udf(SEGMENT)
    def cut(text: pd.Series) -> pd.Series:
        return text.map(lambda x: segments(x, known), na_action="ignore")

    return cut

"""Vowel points carried from a vocalised copy to the words of a text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Points sit on a letter; four marks of the same range are punctuation.
_POINTS = "֑-ׇֽֿׁׂׅׄ"
_CLUSTER = re.compile(f"([א-ת])([{_POINTS}]*)")
_FINALS = str.maketrans("ךםןףץ", "כמנפצ")
#: Words of the copy that are looked at for the next word.
AHEAD = 4


def letters(word: str) -> str:
    """The letters of a word alone, final forms as common ones."""
    return "".join(m[1] for m in _CLUSTER.finditer(word)).translate(_FINALS)


def pointed(word: str, model: str) -> str:
    """The word as it is, each letter followed by the points that the same letter of ``model`` has."""
    points = iter(m[2] for m in _CLUSTER.finditer(model))
    return re.sub("[א-ת]", lambda m: m[0] + next(points, ""), word)


def vowelled(text: str, copy: str) -> list[str] | None:
    """The words of a text with the points of its copy; empty where the copy has no such word near; null if nowhere."""
    models = [(w, k) for w in copy.split() if (k := letters(w))]
    out, at = [], 0
    for word in text.split():
        key = letters(word)
        here = next((i for i in range(at, min(at + AHEAD, len(models))) if key and models[i][1] == key), None)
        out.append("" if here is None else pointed(word, models[here][0]))
        at = at if here is None else here + 1
    return out if any(out) else None


@F.pandas_udf(T.ArrayType(T.StringType()))
def vowel_words(text: pd.Series, copy: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else vowelled(a, b) for a, b in zip(text, copy, strict=True)])

"""Parsers of semi-structured texts: replies with sections, plans in loose JSON, dictionary entries, word forms, speech.

They are sequential or recursive, so they run in Arrow batches; each takes and gives plain Python values.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from lectern.functions.udfs import readable

_QUOTES = str.maketrans({"“": '"', "”": '"'})
_DECODER = json.JSONDecoder()


def loose_object(text: str, keys: frozenset[str] = frozenset({"refs", "hebrew", "english"})) -> dict | None:
    """The first JSON object in a reply that has one of ``keys``; curly quotes, commas before a closing bracket and
    quote marks inside Hebrew abbreviations are mended if it cannot be read as it is."""
    mended = re.sub(r",\s*([}\]])", r"\1", text.translate(_QUOTES))
    for attempt in (text, mended, re.sub('([א-ת])"(?=[א-ת])', "\\1״", mended)):
        for m in re.finditer(r"\{", attempt):
            try:
                found, _ = _DECODER.raw_decode(attempt, m.start())
            except ValueError:
                continue
            if isinstance(found, dict) and not keys.isdisjoint(found):
                return found
    return None


def by_reference(text: str, refs: set[str]) -> dict[str, str]:
    """A reply to several passages, cut at lines that are a known reference in brackets; the first answer of each counts."""
    out: dict[str, str] = {}
    for part in re.split(r"(?m)^[ \t]*(?=\[.+\][ \t]*$)", text):
        head, _, body = part.partition("\n")
        ref = head.strip()[1:-1].strip()
        if head.strip()[:1] == "[" and ref in refs:
            out.setdefault(ref, body.removesuffix("\n"))
    return out


def reply_sections(text: str, names: tuple[str, ...] = ("GENERAL", "WORDS", "READINGS")) -> dict[str, list]:
    """Sections by their heading; lines with bars as lists of cells, other text as one string."""
    pattern = re.compile(rf"(?m)^\s*({'|'.join(names)})\s*:")
    marks = list(pattern.finditer(text))
    bodies = {m[1]: text[m.end() : n.start() if n else len(text)].strip() for m, n in zip(marks, [*marks[1:], None], strict=True)}
    return {k: [[c.strip() for c in line.split("|")] for line in v.splitlines() if "|" in line] if k != names[0] else [v] for k, v in bodies.items()}


_MARKER = re.compile(r"\[\[read ([^\]]+)\]\]", re.I)


def read_markers(text: str, readable_refs: dict[str, str]) -> list[tuple[str, str]]:
    """("text", …) and ("read", ref) in order; markers of references that cannot be read fall away."""
    out = []
    for n, piece in enumerate(_MARKER.split(text)):
        if n % 2 == 0:
            out.append(("text", piece))
        elif (ref := readable_refs.get(" ".join(piece.lower().split()))) is not None:
            out.append(("read", ref))
    return out


def entry_text(entry: dict) -> str:
    """A dictionary entry's senses as reading text: headword, other forms, then the content in order."""

    def parts(node) -> Iterator[str]:
        if isinstance(node, str):
            yield node
        elif isinstance(node, list):
            for x in node:
                yield from parts(x)
        elif isinstance(node, dict):
            if isinstance(node.get("number"), (str, int)):
                yield f"{node['number']})"
            for k, x in node.items():
                if k != "number":
                    yield from parts(x)

    also = [x for x in parts(entry.get("alt_headwords"))]
    head = [entry.get("headword") or "", f"(also {', '.join(also)})" if also else ""]
    return readable(" ".join(p for p in [*head, *parts(entry.get("content"))] if p))


# Letters that attach to the front of a Hebrew or Aramaic word, common endings, and final forms.
PREFIXES = "וד וה וב ול ומ וש וכ דה שה מה בה לה ו ד ה ב ל מ ש כ".split()
SUFFIXES = "ייא יא תא ין ים ות יה הו א ה".split()
FINAL_FORMS = str.maketrans("כמנפצ", "ךםןףץ")


def word_forms(word: str) -> list[str]:
    """What a dictionary may list a word under: as it is, without front letters, without an ending; distinct, in order."""
    word = re.sub("[^א-ת]", "", word)
    bases = [word, *(word[len(p) :] for p in PREFIXES if word.startswith(p) and len(word) - len(p) >= 2)]
    forms = [f for b in bases for f in (b, *(b[: -len(s)][:-1] + b[: -len(s)][-1].translate(FINAL_FORMS) for s in SUFFIXES if b.endswith(s) and len(b) - len(s) >= 2))]
    return [f for f in dict.fromkeys(forms) if len(f) >= 2]


_SENTENCE = re.compile(r"[^.!?;\n]+[.!?;]*[\"'”’)]*\s*|[.!?;\n]+\s*")


def speech_pieces(text: str, first: int = 220, most: int = 700) -> list[str]:
    """Pieces of whole sentences: a short one to start with, then longer ones; long sentences break between words."""
    out, held = [], ""
    for sentence in filter(None, (m[0].strip() for m in _SENTENCE.finditer(text))):
        for part in [sentence] if len(sentence) <= most else filter(None, (m[0].strip() for m in re.finditer(rf".{{1,{most}}}(?:\s|$)", sentence))):
            if held and len(held) + 1 + len(part) > (most if out else first):
                out.append(held)
                held = ""
            held = f"{held} {part}".strip()
    return [p for p in [*out, held] if re.search(r"\w", p)]


def first_sense(entry: str) -> str:
    """A dictionary entry up to its first stop or semicolon, groups in brackets left out."""
    depth, out = 0, []
    for c in entry:
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth = max(0, depth - 1)
        elif not depth:
            if c in ";.":
                break
            out.append(c)
    return " ".join("".join(out).split())

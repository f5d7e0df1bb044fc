"""Alignment against full tables written plainly, and pages whose lines are known."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import align
from lectern.functions.align import ALIKE, LOOKALIKE, Substitutions
from lectern.operators import layout
from lectern.plans.layout import LETTERS, PER_LINE, printed
from lectern.registry import Tables

FOLDER = "/root/testdata/sf0.001"


def cost_of(a, b):
    return 0.0 if a == b else 0.6 if any(a in g and b in g for g in ALIKE) else 1.0


def full_table(q, t, anchored=False):
    rows = [[float(j) if anchored else 0.0 for j in range(len(t) + 1)]]
    for i, a in enumerate(q, 1):
        rows.append([float(i)])
        for j, b in enumerate(t, 1):
            rows[i].append(min(rows[i - 1][j - 1] + cost_of(a, b), rows[i - 1][j] + 1, rows[i][j - 1] + 1))
    return rows


def some_letters(r, n):
    return "".join(r.choice("אבגדהוזחטיכלמנסעפצקרשתםןףץך x") for _ in range(n))


@pytest.mark.parametrize("seed", range(25))
def test_alignment_against_the_full_table(seed):
    r = random.Random(seed)
    t = some_letters(r, r.randint(1, 30))
    at = r.randrange(len(t))
    q = "".join(r.choice([c, c, c, some_letters(r, 1)]) for c in t[at : at + 9]) + some_letters(r, r.randint(0, 3))
    for anchored in (False, True):
        assert align.costs(q, t, letters=LOOKALIKE, anchored=anchored)[0].tolist() == pytest.approx(full_table(q, t, anchored)[-1])
    # the partners have the least cost
    got = align.partners(q, t)
    kept = [j for j in got if j >= 0]
    assert kept == sorted(set(kept))
    inside = (kept[-1] - kept[0] + 1 - len(kept)) if kept else 0
    total = sum(cost_of(a, t[j]) if j >= 0 else 1.0 for a, j in zip(q, got, strict=True)) + inside
    assert total == pytest.approx(min(full_table(q, t)[-1]))
    cost, start = align.costs(q, t, letters=LOOKALIKE)
    for end in range(len(t) + 1):
        assert full_table(q, t[int(start[end]) : end], True)[-1][-1] == pytest.approx(cost[end])


def test_options_and_edges():
    assert align.options("", "abc") == [] and align.options("abc", "") == [] and align.partners("ab", "") == [-1, -1] and align.partners("", "ab") == []
    assert align.options("דבר", "xxרבר--דכר", 3, 0.5) == [(2, 5, pytest.approx(0.8)), (7, 10, pytest.approx(0.8))]
    assert Substitutions().table.shape == (1, 1) and align.costs("ab", "xab")[0].tolist() == [2.0, 2.0, 1.0, 0.0]


def test_a_chain_never_goes_back():
    assert align.chain([[(100.0, 0.0)], [(50.0, 0.0)]], 250) in ([100.0, None], [None, 50.0])
    assert align.chain([[(0.0, 1.0), (5.0, 0.0)], [(3.0, 0.0), (400.0, 0.0)], [(4.0, 0.0)]], 250) == [0.0, 3.0, 4.0] and align.chain([], 5) == []


def truth(spark):
    """The first and past-last letter and word of each line of each page."""
    out = {}
    for r in Tables(spark, FOLDER)("benchmark").collect():
        words = r["text"].split()
        at = 0
        for k in range(0, len(words), PER_LINE):
            n = sum(map(len, words[k : k + PER_LINE]))
            out[r["item_id"], k // PER_LINE] = (at, at + n, k, min(k + PER_LINE, len(words)))
            at += n
    return out


def test_pages_of_known_lines(spark):
    lines, texts = printed(Tables(spark, FOLDER))
    known = truth(spark)
    placed = {(r["page"], r["line"]): r for r in layout.placed_lines(lines, texts, LETTERS).collect()}
    read = [k for k in known if k[1] % 7 != 5]
    right = [abs(placed[k]["start"] - known[k][0]) <= 3 and abs(placed[k]["end"] - known[k][1]) <= 3 and not placed[k]["filled"] for k in read if k in placed]
    assert len(right) >= 0.97 * len(read) and sum(right) >= 0.97 * len(right)
    # lines that could not be read are put back where lines of their column stand around them
    lost = [k for k in known if k[1] % 7 == 5 and k in placed]
    assert lost and all(placed[k]["filled"] for k in lost) and sum(abs(placed[k]["start"] - known[k][0]) <= 6 for k in lost) >= 0.9 * len(lost)
    broken = {(r["page"], r["line"]): (r["first_word"], r["last_word"]) for r in layout.broken_lines(lines, texts, LETTERS).collect()}
    assert set(broken) == set(placed)
    # beside a line that was not read a break has the widths alone to go by
    good = [broken[k] == known[k][2:] for k in broken if not {(k[1] + d) % 7 for d in (-1, 0, 1)} & {5}]
    assert sum(good) >= 0.97 * len(good) and sum(broken[k] == known[k][2:] for k in broken) >= 0.85 * len(broken)


def test_page_edges(spark):
    lines = spark.createDataFrame([(1, 0, "abcdef", 0.0, 50.0, 0.0, 10.0), (1, 1, None, 0.0, 50.0, 20.0, 30.0), (2, 0, "abcdef", 0.0, 50.0, 0.0, 10.0), (3, 0, "abcdef", 0.0, 50.0, 0.0, 10.0), (4, 0, "zzzzzz", 0.0, 50.0, 0.0, 10.0)], "page long, line int, read string, x0 double, x1 double, y0 double, y1 double")
    texts = spark.createDataFrame([(1, "xx abc def yy"), (2, None), (4, ""), (9, "no lines")], "page long, text string")
    assert [(r["page"], r["line"], r["start"], r["end"]) for r in layout.placed_lines(lines, texts).collect()] == [(1, 0, 2, 8)]
    assert [(r["page"], r["first_word"], r["last_word"]) for r in layout.broken_lines(lines, texts).collect()] == [(1, 1, 3)]
    assert layout.placed_lines(lines.where(F.lit(False)), texts).count() == 0


def plain_rows(words, items, weak="aeiou", ahead=8):
    """The same by trying every run of words."""
    key = lambda w: "".join(c for c in w.lower() if c.isalpha())
    thin = lambda w: "".join(c for c in w if c not in weak)
    keys, out, at = [key(w) for w in words], [], 0

    def rest(a, b):
        if a < b:
            if out and (out[-1][2] is None or not any(keys[a:b])):
                out[-1] = (out[-1][0], out[-1][1] + b - a, out[-1][2])
            else:
                out.append((a, b - a, None))

    for n, item in enumerate(items):
        want = key(item)
        runs = [(s, e) for s in range(at, min(len(words), at + ahead)) if want and keys[s] for e in range(s, len(words)) if keys[e] and thin("".join(keys[s : e + 1])) == thin(want)]
        if runs:
            s, e = min(runs)
            rest(at, s)
            out.append((s, e + 1 - s, n))
            at = e + 1
    rest(at, len(words))
    return out


def test_glosses_against_every_run(spark):
    from lectern.functions.gloss import gloss_rows

    r = random.Random(2)
    cases = [(["The", "cat", "--", "sat", "."], ["th", "cat sat", "sat"]), ([], ["a"]), (["a", "e"], ["i", ""]), (["--", "b"], ["b"]), (["b", "--"], ["x"])]
    for _ in range(300):
        words = [r.choice(["ba", "ab", "b", "c", "ca", "a", "--", "e", "abc", "Bc."]) for _ in range(r.randint(0, 14))]
        cases.append((words, [r.choice(["b", "ca", "bab", "a", "abc", "", "c b", "bb", "--"]) for _ in range(r.randint(0, 8))]))
    df = spark.createDataFrame([(i, w, g) for i, (w, g) in enumerate(cases)], "id int, words array<string>, items array<string>")
    got = {x["id"]: [tuple(y) for y in x["rows"]] for x in df.select("id", gloss_rows(F.col("words"), F.col("items")).alias("rows")).collect()}
    for i, (words, items) in enumerate(cases):
        assert got[i] == plain_rows(words, items), (words, items)

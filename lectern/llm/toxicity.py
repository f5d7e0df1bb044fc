"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a lexicon of words and word beginnings, nearness of its hits to words that
address a second person, and rates of capitals, punctuation and obfuscation (letters swapped for digits or signs,
letters drawn out or spaced). The lexicon is learned by document frequency from labelled rows: all terms of the sample are
counted in Spark, and those that lean to toxic rows are its entries; its features for the training rows come from the
other folds, so that trees see them as they will be on new rows.

The classifier is fitted on at most ``SAMPLE`` labelled rows of each class (the smallest hashes of doc_id), read back
in one bounded table; every document is scored whole, however long.

Defined results: a null text counts as empty and is scored; an empty table of documents gives no rows; scores do not depend on the order of rows, and ties of doc_ids in the sample all count; a null doc_id is in fold 0 (held out); labels that are
null or neither 0 nor 1 are not used; of several labels of one document all are; without labels of both classes
every score is the share of label 1 (0.0 without labels); extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import as_bytes, cut, fold_of, restrict, slices

#: Labelled rows of each class that the classifier is fitted on, at most.
SAMPLE = 3000
#: A term of the lexicon is in so many toxic rows of the sample at least, and its log odds are above this.
LEAST, LEAN = 3, 0.7
CROSS = 4
PREFIXES = (3, 4, 5, 6)

# Pronouns of the second person in the languages of the corpus.
YOU = frozenset("you your yours yourself u ya du dich dir dein deine deinen ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros os".split())
# Signs and digits that stand for letters.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i", "*": ""})

_DRAWN = re.compile(r"(.)\1{2,}")
_INNER = re.compile(r"[^\W\d_][^\w\s]*[0-9@$!|*#%&+_.\-]+[^\W\d_]")


def core(word: str) -> str:
    """The word in lower case without what is neither letter nor digit at its ends."""
    if word.isalnum():
        return word.lower()
    lo, hi = 0, len(word)
    while lo < hi and not word[lo].isalnum():
        lo += 1
    while hi > lo and not word[hi - 1].isalnum():
        hi -= 1
    return word[lo:hi].lower()


def plain(word: str) -> str:
    """The word as meant: look-alikes back to letters, other signs dropped, drawn-out letters once."""
    return _DRAWN.sub(r"\1", "".join(c for c in core(word).translate(LEET) if c.isalpha()))


def terms_of(word: str) -> list[str]:
    w = core(word)
    return ([f"w:{w}"] if w else []) + [f"p:{w[:n]}" for n in PREFIXES if len(w) >= n]


#: Columns of a word's row, features of a text, and how near a hit must be to a word for the second person.
WORD_COLUMNS, FEATURES, REACH = 16, 24, 3


class Words(dict):
    """The row of each word in a table of distinct rows; what is not known yet is looked at once."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.whole = {k[2:]: v for k, v in lexicon.items() if k[0] == "w"}
        self.stems = {k[2:]: v for k, v in lexicon.items() if k[0] == "p"}
        self.rows: dict[tuple, int] = {(0.0,) * WORD_COLUMNS: 0}

    def __missing__(self, word: str) -> int:
        c, whole, stems = core(word), self.whole, self.stems
        value, stem = whole.get(c, 0.0), 0.0
        if stems:
            for k in PREFIXES[: max(0, len(c) - PREFIXES[0] + 1)]:
                stem = max(stem, stems.get(c[:k], 0.0))
        odd, shouts, asks = bool(_DRAWN.search(c)), 0, 0
        if word.isascii() and c.isalpha():  # most words: letters, perhaps with signs at their ends
            letters, signs = len(c), len(word) - len(c)
            upper = 0 if word == c or word.islower() else sum(map(str.isupper, word))
        else:
            odd = odd or bool(_INNER.search(word))
            letters, upper, signs = sum(map(str.isalpha, word)), sum(map(str.isupper, word)), len(word) - sum(map(str.isalnum, word))
        if signs:
            shouts, asks = word.count("!"), word.count("?")
        hidden = whole.get(plain(word), 0.0) if odd and not value else 0.0
        weight = max(value, stem, hidden)
        row = (value, value > 0, stem, stem > 0, hidden, hidden > 0, c in YOU, len(word) > 1 and upper == letters > 1, upper, letters, signs, shouts, asks, odd, len(word) == 1 and letters == 1, weight)
        out = self[word] = self.rows.setdefault(row, len(self.rows))
        return out


class Featuriser:
    """Features of texts under one lexicon; what it learns of a word is kept while the table of words stays small.

    Texts of a batch lie behind each other in one array with gaps as wide as a neighbourhood, so that all of a batch is
    summed at once.
    """

    def __init__(self, lexicon: dict[str, float], room: int = 100_000):
        self.lexicon, self.room = lexicon, room
        self.words, self.table = Words(lexicon), np.zeros((0, WORD_COLUMNS))

    def _rows(self) -> np.ndarray:
        if len(self.table) < len(self.words.rows):
            self.table = np.array(list(self.words.rows), dtype=float)
        return self.table

    def texts(self, texts: list[str]) -> np.ndarray:
        if len(self.words) > self.room:
            self.words, self.table = Words(self.lexicon), np.zeros((0, WORD_COLUMNS))
        split = [t.split() for t in texts]
        n = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        flat = np.fromiter(map(self.words.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=int(n.sum()))
        owner = np.repeat(np.arange(len(split)), n)
        singles = np.bincount(owner, self._rows()[flat, 14], len(split))
        more = {k: [self.words[w] for w in spaced(split[k])] for k in np.flatnonzero(singles >= 4).tolist()}
        length = n.copy()
        for k, own in more.items():
            length[k] += len(own)
        start = np.cumsum(length + REACH) - length - REACH
        idx = np.zeros(int(length.sum()) + REACH * len(split), dtype=np.int64)
        idx[np.arange(len(flat)) + np.repeat(start - (np.cumsum(n) - n), n)] = flat
        for k, own in more.items():
            idx[start[k] + n[k] : start[k] + length[k]] = own
        table = self._rows()
        total = np.add.reduceat(table[idx], start, axis=0) if len(split) else np.zeros((0, WORD_COLUMNS))
        # the few words of the lexicon, one by one
        weight = table[idx, 15]
        hit = np.flatnonzero(weight > 0)
        of, weight = np.searchsorted(start, hit, side="right") - 1, weight[hit]
        hits = np.bincount(of, minlength=len(split))
        you, near = np.flatnonzero(table[idx, 6]), np.zeros(len(idx), dtype=bool)
        for k in range(-REACH, REACH + 1):
            near[np.clip(you + k, 0, len(idx) - 1)] = True
        near = np.bincount(of, near[hit], len(split))
        order = np.lexsort((-weight, of))
        nth = np.arange(len(order)) - (np.cumsum(hits) - hits)[of[order]]
        top, three = (np.bincount(of[order][nth < k], weight[order][nth < k], len(split)) for k in (1, 3))
        kinds = np.zeros(len(split))
        for k, _ in {(k, split[k][at]) for k, at in zip(of.tolist(), (hit - start[of]).tolist(), strict=True) if at < n[k]}:
            kinds[k] += 1
        m, letters = np.maximum(n, 1), np.maximum(total[:, 9], 1.0)
        out = np.column_stack([
            np.log1p(n), total[:, 1] / m, np.log1p(total[:, 1]), total[:, 3] / m, np.log1p(total[:, 3]), total[:, 5] / m, np.log1p(total[:, 5]), total[:, 0] / m, total[:, 2] / m, total[:, 15] / m,
            top, three, np.log1p(hits), np.log1p(kinds), near / m, np.log1p(near), total[:, 6] / m, total[:, 7] / m, total[:, 8] / letters, total[:, 10] / (total[:, 9] + total[:, 10] + 1),
            total[:, 11] / m, total[:, 12] / m, total[:, 13] / m, total[:, 15] / np.maximum(hits, 1),
        ])
        return out.reshape(len(split), FEATURES)

    def text(self, text: str) -> np.ndarray:
        return self.texts([text])[0]


def spaced(words: list[str]) -> list[str]:
    """Words written with spaces between their letters: runs of four or more single letters."""
    out, run = [], ""
    for w in [*words, "  "]:
        if len(w) == 1 and w.isalpha():
            run += w
        else:
            out += [run] if len(run) >= 4 else []
            run = ""
    return out


@dataclass
class Trees:
    """Boosted regression trees for the logistic loss, on binned features."""

    rounds: int = 60
    depth: int = 3
    rate: float = 0.2
    bins: int = 32
    smooth: float = 1.0
    edges: list[np.ndarray] = field(default_factory=list)
    start: float = 0.0
    nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)]) if len(x) else np.zeros((0, len(self.edges)), dtype=np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        b = self.binned(x)
        share = float(np.clip((y * weight).sum() / weight.sum(), 1e-4, 1 - 1e-4))
        self.start, self.nodes = float(np.log(share / (1 - share))), []
        margin = np.full(len(y), self.start)
        width, leaves = self.bins + 1, 1 << self.depth
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = weight * (y - p), weight * p * (1 - p)
            node = np.zeros(len(y), dtype=np.int64)
            feature, cutoff = np.zeros(leaves - 1, dtype=np.int64), np.full(leaves - 1, width, dtype=np.int64)
            for level in range(self.depth):
                base, wide = (1 << level) - 1, 1 << level
                key = ((node[:, None] * b.shape[1] + np.arange(b.shape[1])) * width + b).ravel()
                g = np.bincount(key, np.repeat(grad, b.shape[1]), wide * b.shape[1] * width).reshape(wide, b.shape[1], width).cumsum(axis=2)
                h = np.bincount(key, np.repeat(hess, b.shape[1]), wide * b.shape[1] * width).reshape(wide, b.shape[1], width).cumsum(axis=2)
                gt, ht = g[:, :, -1:], h[:, :, -1:]
                gain = g**2 / (h + self.smooth) + (gt - g) ** 2 / (ht - h + self.smooth) - gt**2 / (ht + self.smooth)
                gain[(h < 1e-3) | (ht - h < 1e-3)] = 0
                best = gain.reshape(wide, -1).argmax(axis=1)
                good = gain.reshape(wide, -1)[np.arange(wide), best] > 1e-6
                feature[base : base + wide] = np.where(good, best // width, 0)
                cutoff[base : base + wide] = np.where(good, best % width, width)
                node = node * 2 + (b[np.arange(len(y)), feature[base + node]] > cutoff[base + node])
            value = self.rate * np.bincount(node, grad, leaves) / (np.bincount(node, hess, leaves) + self.smooth)
            self.nodes.append((feature, cutoff, value))
            margin += value[node]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, out, every = self.binned(x), np.full(len(x), self.start), np.arange(len(x))
        for feature, cutoff, value in self.nodes:
            node = np.zeros(len(x), dtype=np.int64)
            for level in range(self.depth):
                base = (1 << level) - 1
                node = node * 2 + (b[every, feature[base + node]] > cutoff[base + node])
            out += value[node]
        return out


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the least-squares increasing fit of y over x, by pooling neighbours that go down."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for xi, yi, wi in zip(x[order], y[order], weight[order], strict=True):
        blocks.append([xi, xi, yi * wi, wi])
        while len(blocks) > 1 and (blocks[-2][1] >= blocks[-1][0] or blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]):
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0], last[1], blocks[-1][2] + last[2], blocks[-1][3] + last[3]]
    xs = np.array([v for b in blocks for v in (b[0], b[1])])
    ys = np.array([b[2] / b[3] for b in blocks for _ in (0, 1)])
    return xs, ys


def learn(x: np.ndarray, y: np.ndarray, weight: np.ndarray, fold: np.ndarray) -> tuple[Trees | None, np.ndarray, np.ndarray]:
    """Trees on all rows, and the calibration of margins that rows get from trees of the other folds."""
    if len(set(y.tolist())) < 2:
        return None, np.zeros(1), np.full(1, float(y.mean()) if len(y) else 0.0)
    out = np.zeros(len(y))
    for k in set(fold.tolist()):
        other, own = fold != k, fold == k
        out[own] = Trees().fit(x[other], y[other], weight[other]).margin(x[own]) if len(set(y[other].tolist())) > 1 else 0.0
    xs, ys = isotonic(out, y, weight)
    return Trees().fit(x, y, weight), xs, ys


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold each term, by label and part."""
    counts: Counter = Counter()
    for batch in slices(batches, "text"):
        for text, toxic, part in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), batch.column("part").to_pylist(), strict=True):
            counts.update((t, toxic, part) for t in {t for w in set((text or "").split()) for t in terms_of(w)})
    columns = zip(*((*k, n) for k, n in counts.items()), strict=True) if counts else ((), (), (), ())
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["term", "toxic", "part", "n"])


def odds(tox: np.ndarray, non: np.ndarray, n_tox: float, n_non: float) -> np.ndarray:
    """Log odds of a term in documents of label 1 against 0, shrunk by its standard error."""
    raw = np.log((tox + 0.5) / (n_tox + 1)) - np.log((non + 0.5) / (n_non + 1))
    return raw - 1.65 * np.sqrt(1 / (tox + 0.5) + 1 / (non + 0.5)) * (tox < 8)


def _lexicons(counts: list, labels: dict[tuple[int, int], int], least: float = LEAN) -> dict[int, dict[str, float]]:
    """Terms and their weights from all folds (-1) and from all but one."""
    terms = [r["term"] for r in counts]
    table = np.array([[[r[f"n{k}_{t}"] or 0 for t in (0, 1)] for k in range(CROSS)] for r in counts], dtype=float).reshape(len(terms), CROSS, 2)
    out = {}
    for k in range(-1, CROSS):
        use = [i for i in range(CROSS) if i != k]
        non, tox = table[:, use, 0].sum(axis=1), table[:, use, 1].sum(axis=1)
        value = odds(tox, non, sum(labels.get((i, 1), 0) for i in use), sum(labels.get((i, 0), 0) for i in use))
        out[k] = {t: float(v) for t, v, c in zip(terms, value, tox, strict=True) if v >= least and c >= 2}
    return out


@dataclass
class Scorer:
    """A fitted classifier: lexicon, trees and calibration; a few hundred kB."""

    lexicon: dict[str, float]
    trees: Trees | None
    xs: np.ndarray
    ys: np.ndarray

    def scores(self, make: Featuriser, texts: list[bytes]) -> np.ndarray:
        x = make.texts([t.decode("utf-8", "replace") for t in texts])
        return np.clip(np.interp(self.trees.margin(x), self.xs, self.ys) if self.trees else np.full(len(x), self.ys[0]), 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, held_out_fold: int = 0, sample: int = SAMPLE) -> Scorer:
    """Learns from labels of documents outside the held-out fold."""
    docs = restrict(docs, "doc_id", "text")
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(fold_of() != held_out_fold)
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    picked = None
    for label in (0, 1):
        some = known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        picked = some if picked is None else picked.unionByName(some)
    # at most 2 * sample rows of two integers
    picked = F.broadcast(picked)
    rows = cut(docs.join(picked, "doc_id").withColumn("part", F.pmod(F.xxhash64(F.col("doc_id"), F.lit(1)), F.lit(CROSS)).cast("int")))
    sizes = {(r["part"], r["toxic"]): r["count"] for r in rows.groupBy("part", "toxic").count().collect()}
    counted = rows.mapInArrow(_count, "term string, toxic int, part int, n long")
    each = [F.sum(F.when((F.col("part") == k) & (F.col("toxic") == t), F.col("n"))).alias(f"n{k}_{t}") for k in range(CROSS) for t in (0, 1)]
    by_term = counted.groupBy("term").agg(*each, *[F.sum(F.when(F.col("toxic") == t, F.col("n")).otherwise(0)).alias(name) for t, name in ((1, "tox"), (0, "non"))])
    n_tox, n_non = (sum(n for (_, t), n in sizes.items() if t == label) for label in (1, 0))
    lean = F.log((F.col("tox") + 0.5) / (n_tox + 1)) - F.log((F.col("non") + 0.5) / (n_non + 1))
    # only terms of at least LEAST of the sample's toxic rows, so the sample bounds them
    best = by_term.where(F.col("tox") >= LEAST).where(lean > LEAN).collect()
    lexicons = _lexicons(sorted(best, key=lambda r: r["term"]), sizes)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = {k: Featuriser(lexicons[k]) for k in range(CROSS)}
        for batch in slices(batches, "text", 1 << 20):
            part, texts = np.array(batch.column("part").to_pylist()), [t.decode("utf-8", "replace") for t in as_bytes(batch.column("text"))]
            x = np.zeros((len(texts), FEATURES))
            for k in set(part.tolist()):
                own = np.flatnonzero(part == k)
                x[own] = by[k].texts([texts[i] for i in own])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("toxic"), batch.column("part"), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["doc_id", "toxic", "part", "x"])

    got = sorted(((r["doc_id"], r["toxic"], r["part"], r["x"]) for r in rows.mapInArrow(features, "doc_id long, toxic int, part int, x array<double>").collect()))
    x = np.array([r[3] for r in got]).reshape(len(got), FEATURES)
    y, part = np.array([r[1] for r in got], dtype=float), np.array([r[2] for r in got])
    weight = np.array([totals.get(r[1], 1) / max(1, (n_tox, n_non)[1 - r[1]]) for r in got]) if got else np.zeros(0)
    trees, xs, ys = learn(x, y, weight, part)
    return Scorer(lexicons[-1], trees, xs, ys)


def score_texts(docs: DataFrame, labels: DataFrame, held_out_fold: int = 0, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each row of ``docs`` (doc_id, text)."""
    scorer = fit(docs, labels, held_out_fold, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Featuriser(scorer.lexicon)
        for batch in slices(batches, "text", 1 << 20):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(scorer.scores(make, as_bytes(batch.column("text"))), pa.float64())], names=["doc_id", "score"])

    scored = restrict(docs, "doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (fold_of() == held_out_fold).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``threshold``; all columns stay and no row moves."""
    scorer = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Featuriser(scorer.lexicon)
        for batch in slices(batches, "text", 1 << 20):
            yield batch.filter(pa.array(scorer.scores(make, as_bytes(batch.column("text"))) < threshold))

    return docs.mapInArrow(run, docs.schema)

"""Document fingerprints from prefix polynomial hashes.

For the code points c of a text, H[i] is the sum of (c[j] + 1) * r^j over j < i, modulo a prime; two primes are used
at once. The prefix arrays of two texts answer whether any two spans are equal (by cross-multiplying with the powers
at their starts), and the longest common extension from two places follows by binary search. The fingerprint of a
text is its length and the last entries of its arrays; that of a concatenation follows from the parts' arrays.

The likeness of two texts is the share of the longer one that spans common to both cover: their longest common prefix
and suffix, and between these the spans found by extending, in both directions, anchors that both texts hold. An anchor
is a span of ANCHOR code points whose hash is a multiple of EVERY, so a common stretch of some hundred code points is
seen wherever it stands. Likeness needs the arrays; from two fingerprints alone only equality can be told.

Texts meet the next document in ascending doc_id with one exchange: rows are dealt by range and sorted within ranges,
each range streams through one task that holds two documents at a time, and the last document of a range meets the first
of the next one afterwards, by the number of its range. Nothing that grows with the documents reaches the driver.

Defined results: a null text counts as empty; a null doc_id comes first; rows with the same doc_id follow in the order
of a hash of their text; two empty texts have likeness 1; a single document is its own next; a text of any length is
read whole; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import as_bytes, cut, release, restrict, slices, text_bytes

PRIMES = ((1 << 31) - 1, (1 << 31) - 19)
BASES = (1_000_003_133, 1_402_024_253)

#: Code points of an anchor; of their hashes one in EVERY is looked at.
ANCHOR, EVERY = 32, 8
#: Ranges whose neighbours are found by one task.
GROUP = 4096

_INVERSES = tuple(pow(r, -1, p) for r, p in zip(BASES, PRIMES, strict=True))
_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def powers(which: int, n: int, down: bool = False) -> np.ndarray:
    """r^0 ... r^(n - 1), or those of its inverse; kept and doubled as texts get longer."""
    own, p, base = _POWERS.get((which, down), np.ones(1, dtype=np.uint64)), PRIMES[which], (_INVERSES if down else BASES)[which]
    while len(own) < n:
        own = np.concatenate([own, own * np.uint64(pow(base, len(own), p)) % np.uint64(p)])
    _POWERS[which, down] = own
    return own[:n]


class Prefixes:
    """The prefix arrays of a text."""

    def __init__(self, text: str):
        self.text = text
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(1)
        self.n = len(points)
        self.sums = []
        for which, p in enumerate(PRIMES):
            own = np.zeros(self.n + 1, dtype=np.uint64)
            np.cumsum(points * powers(which, self.n) % np.uint64(p), out=own[1:])
            self.sums.append(own % np.uint64(p))

    def equal(self, start: int, other: Prefixes, other_start: int, length: int) -> bool:
        """Whether self[start:start + length] equals other[other_start:other_start + length]."""
        for which, p in enumerate(PRIMES):
            one = (int(self.sums[which][start + length]) - int(self.sums[which][start])) * int(powers(which, other_start + 1)[other_start])
            two = (int(other.sums[which][other_start + length]) - int(other.sums[which][other_start])) * int(powers(which, start + 1)[start])
            if (one - two) % p:
                return False
        return True

    def extension(self, start: int, other: Prefixes, other_start: int, most: int) -> int:
        """The longest common extension to the right of two places, at most ``most``."""
        lo, hi = 0, most
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if self.equal(start, other, other_start, mid):
                lo = mid
            else:
                hi = mid - 1
        return lo

    def extension_back(self, end: int, other: Prefixes, other_end: int, most: int) -> int:
        """The longest common extension to the left of two ends, at most ``most``."""
        lo, hi = 0, most
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if self.equal(end - mid, other, other_end - mid, mid):
                lo = mid
            else:
                hi = mid - 1
        return lo

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, places) of the spans that are anchors; a hash of a span does not depend on where it stands."""
        m = self.n - ANCHOR + 1
        if m <= 0:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)

        def spans(which: int, at: np.ndarray) -> np.ndarray:
            p, own = np.uint64(PRIMES[which]), self.sums[which]
            return (own[at + ANCHOR] + p - own[at]) % p * powers(which, m, True)[at] % p

        at = np.arange(m)
        one = spans(0, at)
        at = at[one % np.uint64(EVERY) == 0]
        return one[at] << np.uint64(32) | spans(1, at), at

    def fingerprint(self) -> str:
        return show(self.n, [int(s[self.n]) for s in self.sums])


def show(n: int, hashes: list[int]) -> str:
    return f"{n:x}-" + "".join(f"{h:08x}" for h in hashes)


def covered(spans: list[tuple[int, int]]) -> int:
    """How many places lie in one of the spans."""
    total = end = 0
    for lo, hi in sorted(spans):
        total += max(0, hi - max(lo, end))
        end = max(end, hi)
    return total


def likeness(one: Prefixes, two: Prefixes) -> float:
    """The share of the longer text that common spans cover, as the text that they cover less has it."""
    longer, most = max(one.n, two.n), min(one.n, two.n)
    if not longer:
        return 1.0
    prefix = one.extension(0, two, 0, most)
    suffix = one.extension_back(one.n, two, two.n, most - prefix)
    mine, other, end, stop = [(0, prefix), (one.n - suffix, one.n)], [(0, prefix), (two.n - suffix, two.n)], prefix, one.n - suffix
    if prefix + suffix < most:
        (a, at), (b, to) = one.anchors(), two.anchors()
        _, i, j = np.intersect1d(a, b, return_indices=True)
        for x, y in sorted(zip(at[i].tolist(), to[j].tolist(), strict=True)):
            if x < end or x + ANCHOR > stop or not one.equal(x, two, y, ANCHOR):
                continue
            back = one.extension_back(x, two, y, min(x - end, y))
            ahead = one.extension(x, two, y, min(stop - x, two.n - y))
            mine.append((x - back, x + ahead))
            other.append((y - back, y + ahead))
            end = x + ahead
    return min(covered(mine), covered(other)) / longer


def compare(own: Prefixes, after: Prefixes) -> tuple[str, str, str, float, float]:
    """The edited text's digest, both fingerprints, and the likeness to the edited text and to the next document.

    The edited text is own[:keep] + after[:add]; its fingerprint is combined from the arrays of the two.
    """
    keep, half = own.n - own.n // 2, own.n // 2
    add = min(half, after.n)
    edited = own.text[:keep] + after.text[:add]
    hashes = [(int(own.sums[w][keep]) + int(powers(w, keep + 1)[keep]) * int(after.sums[w][add])) % p for w, p in enumerate(PRIMES)]
    return hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own.fingerprint(), show(keep + add, hashes), likeness(own, Prefixes(edited)), likeness(own, after)


_DONE = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_STEP = _DONE + ", range int, edge string, text string"
_KINDS = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.string())


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _KINDS, strict=False)], names=names)


def _text(data: bytes) -> Prefixes:
    return Prefixes(data.decode("utf-8", "surrogatepass"))


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a range in order: a row is done when the one after it is there. The first and the last row of the
    range also go out with their texts."""
    number, held = TaskContext.get().partitionId(), None
    for batch in slices(batches, "text"):
        out: list[tuple] = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), strict=True):
            own = _text(text)
            if held is None:
                out.append((None,) * 7 + (number, "first", own.text))
            else:
                out.append((held[0], held[1].n, *compare(held[1], own), number, None, None))
            held = (doc_id, own)
        yield _batch(out, _STEP)
    if held is not None:
        yield _batch([(held[0],) + (None,) * 6 + (number, "last", held[1].text)], _STEP)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        rows = zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), as_bytes(batch.column("after")), strict=True)
        yield _batch([(i, (own := _text(t)).n, *compare(own, _text(a))) for i, t, a in rows], _DONE)


def fingerprints(docs: DataFrame, range_bytes: int = 16 << 20) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text), as ``_DONE`` says; ranges hold about ``range_bytes`` each."""
    docs = restrict(docs, "doc_id", "text")
    order = (F.asc_nulls_first("doc_id"), F.asc("_hash"))
    ranges = max(16, -(-text_bytes(docs) // range_bytes))
    dealt = docs.withColumn("_hash", F.xxhash64("text")).repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    step = cut(dealt.select("doc_id", "text").mapInArrow(_stream, _STEP))
    release(docs.sparkSession)
    # each range's follower: within groups of ranges first, and one row for each group is ordered as a whole
    first = step.where("edge = 'first'").select("range", F.expr(f"range div {GROUP}").alias("group"))
    lead = F.lead("least").over(Window.orderBy("group"))
    around = F.min("least").over(Window.partitionBy(F.lit(0)))
    groups = first.groupBy("group").agg(F.min("range").alias("least")).select("group", F.coalesce(lead, around).alias("beyond"))
    follow = first.join(groups, "group").select("range", F.coalesce(F.lead("range").over(Window.partitionBy("group").orderBy("range")), F.col("beyond")).alias("next"))
    last = step.where("edge = 'last'").select("doc_id", "text", "range").join(follow, "range")
    met = last.join(step.where("edge = 'first'").select(F.col("range").alias("next"), F.col("text").alias("after")), "next").select("doc_id", "text", "after").mapInArrow(_meet, _DONE)
    return step.where("edge is null").select(*met.columns).unionByName(met)

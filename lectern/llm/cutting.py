"""Packing of documents into sequences as a cutting-stock problem, by column generation.

A document's ids fill whole sequences first; what is left, shorter than a sequence, is its tail. Spark counts the tails by
length. Over that histogram a linear program chooses how often to use each pattern of lengths: a pattern costs what
its sequence takes with padding (its own size if that is a power of two, else a full sequence) and ``PER_SEQUENCE``
tokens for being one more sequence. Columns are not listed: a knapsack by dynamic programming over sizes finds, for the prices of
the last solution, the best pattern of every size and the best full one with each length. A tail may also go to the
stream, where tails are laid end to end and cut where a sequence is full; that costs ``PER_CUT`` tokens a sequence. The first
basis is greedy: the largest length left is filled up with the largest that fit and used until one of its lengths is spent,
which gives a triangular basis. Uses are rounded down, then up where tails are left for one more, and what no pattern takes
joins the stream, whose end is cut into powers of two.

The program works on the histogram alone, at most one row a length. Tails get their place by rank: a task numbers its tails of
each length as it writes them, tasks are put in order by a prefix sum for each length, and the rank of a tail
among those of its length says which use of which pattern takes it.

Defined results: a null text counts as empty and is a document with the end id alone; null and repeated doc_ids are
documents of their own; an empty table gives no rows; extra columns are ignored. Which of several tails of one
length goes to which sequence follows the order of the table's files.
"""

from __future__ import annotations

import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import restrict, shared_dir, slices
from lectern.llm.records import WordCache

#: What one more sequence costs beside its tokens and padding.
PER_SEQUENCE = 256
#: What a cut in the stream costs: patterns with more padding than that are not used.
PER_CUT = 16
#: The program is solved when its cost is within this share of a bound that no solution can go below.
GAP = 1e-3
#: Columns taken from one pricing, and pricings at most: every basis is a plan, so this bounds the driver's time alone.
COLUMNS, PRICINGS = 64, 400
#: Sequences of tails are numbered below this, whole sequences of a document from here on by task.
TAILS = 1 << 36

OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, nth long, tail boolean, ids binary"


def powers(n: int) -> list[int]:
    """``n`` as powers of two, largest first."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def price(worth: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """(best, last): for each size the greatest worth of lengths that add up to it, and one length of such a choice.

    ``worth`` by length, minus infinity where there is none.
    """
    best = np.full(room + 1, -np.inf)
    best[0] = 0.0
    last = np.zeros(room + 1, dtype=np.int64)
    top = len(worth) - 1
    for size in range(1, room + 1):
        n = min(size, top)
        ways = worth[1 : n + 1] + best[size - n : size][::-1]
        k = int(ways.argmax())
        best[size], last[size] = ways[k], k + 1
    return best, last


def pattern(last: np.ndarray, size: int, extra: int = 0) -> dict[int, int]:
    """Lengths, with how often each, that the knapsack chose for ``size``."""
    out: dict[int, int] = {extra: 1} if extra else {}
    while size:
        n = int(last[size])
        out[n] = out.get(n, 0) + 1
        size -= n
    return out


@dataclass
class Program:
    """The linear program over patterns: a basis with one column a length, its inverse, uses and prices."""

    lengths: np.ndarray
    counts: np.ndarray
    room: int

    def __post_init__(self) -> None:
        self.at = {int(n): i for i, n in enumerate(self.lengths)}
        sizes = np.arange(self.room + 1)
        self.size_cost = np.where(sizes & (sizes - 1) == 0, sizes, self.room) + PER_SEQUENCE
        self.columns, self.uses = self.greedy()
        # the inverse column by column, by the rows of the shortest lengths first: matrix products are left out on
        # purpose, since their threads may be gone in a driver that has started a gateway
        self.inverse = np.eye(len(self.lengths))
        self.costs = np.array([self.cost(c) for c in self.columns])
        for i, column in enumerate(self.columns):
            self.pivot(i, self.way(column))
        self.prices = (self.costs[:, None] * self.inverse).sum(axis=0)

    def way(self, column: dict[int, int] | int) -> np.ndarray:
        """How the uses of the basis change for one use of ``column``."""
        return sum(k * self.inverse[:, self.at[n]] for n, k in self.parts(column).items())

    def pivot(self, out: int, way: np.ndarray) -> None:
        """The inverse after a column with ``way`` has taken place ``out``."""
        self.inverse[out] /= way[out]
        row = self.inverse[out]
        hit, live = np.flatnonzero(np.abs(way) > 1e-14), np.flatnonzero(row)
        hit = hit[hit != out]
        self.inverse[np.ix_(hit, live)] -= way[hit][:, None] * row[live]

    @staticmethod
    def parts(column: dict[int, int] | int) -> dict[int, int]:
        """Lengths of a column with how often each; one that is a number sends that length to the stream."""
        return {column: 1} if isinstance(column, int) else column

    def cost(self, column: dict[int, int] | int) -> float:
        if isinstance(column, int):
            return column * (1 + (PER_SEQUENCE + PER_CUT) / self.room)
        return float(self.size_cost[sum(n * k for n, k in column.items())])

    def greedy(self) -> tuple[list[dict[int, int] | int], np.ndarray]:
        """A basis and its uses. Each column holds the length at its place, and else only lengths spent with it or later."""
        left = {int(n): float(k) for n, k in zip(self.lengths, self.counts, strict=True)}
        lengths = list(left)
        columns: list[dict[int, int] | int] = [0] * len(lengths)
        uses = np.zeros(len(lengths))
        while lengths:
            column, gap, at = {}, self.room, len(lengths) - 1
            while gap and at >= 0:
                n = lengths[at]
                k = min(gap // n, max(1, int(left[n])))
                if k:
                    column[n], gap = k, gap - k * n
                at = min(at, bisect_right(lengths, gap)) - 1
            if self.cost(column) > sum(k * self.cost(n) for n, k in column.items()):
                column = lengths[-1]
            times = min(left[n] / k for n, k in self.parts(column).items())
            own = None
            for n, k in self.parts(column).items():
                left[n] -= times * k
                if left[n] <= 1e-9:
                    i = self.at[n]
                    columns[i], uses[i] = (column, times) if own is None else (n, 0.0)
                    own = own or n
                    lengths.remove(n)
        return columns, uses

    def bound(self) -> float:
        """No solution costs less: every token is paid once, and a sequence holds at most ``room`` of them."""
        return float((self.lengths * self.counts).sum()) * (1 + PER_SEQUENCE / self.room)

    def proposals(self) -> tuple[list[dict[int, int] | int], float]:
        """Columns that gain at these prices, best first, and the greatest ratio of worth to cost of any column."""
        worth = np.full(int(self.lengths.max()) + 1, -np.inf)
        worth[self.lengths] = self.prices
        best, last = price(worth, self.room)
        stream = np.array([self.cost(int(n)) for n in self.lengths])
        ratio = float(max((best[1:] / self.size_cost[1:]).max(), (self.prices / stream).max()))
        gains = best - self.size_cost
        found = [(float(gains[s]), s, 0) for s in np.flatnonzero(gains > 1e-7).tolist() if s]
        rest = self.room - self.lengths
        full = self.prices + best[rest] - self.size_cost[self.room]
        found += [(float(full[i]), int(rest[i]), int(self.lengths[i])) for i in np.flatnonzero((full > 1e-7)).tolist()]
        # a gain repeats for each length of one pattern
        out, seen = [int(n) for n in self.lengths[self.prices > stream + 1e-7]], set()
        for _, size, extra in sorted(found, reverse=True):
            column = pattern(last, size, extra) if not extra or extra not in (got := pattern(last, size)) else {**got, extra: got[extra] + 1}
            key = tuple(sorted(column.items()))
            if key not in seen:
                seen.add(key)
                out.append(column)
            if len(seen) == COLUMNS:
                break
        return out, ratio

    def enter(self, column: dict[int, int] | int) -> bool:
        """Takes ``column`` into the basis if it gains at the prices of now."""
        gain = sum(k * float(self.prices[self.at[n]]) for n, k in self.parts(column).items()) - self.cost(column)
        if gain <= 1e-7:
            return False
        way = self.way(column)
        can = np.flatnonzero(way > 1e-9)
        if not len(can):
            return False
        steps = self.uses[can] / way[can]
        least = steps.min()
        # of equals the largest pivot, which keeps the inverse exact
        ties = can[steps <= least + 1e-12]
        out = int(ties[way[ties].argmax()])
        self.uses -= least * way
        self.uses[out] = least
        self.pivot(out, way)
        self.prices = self.prices - gain * self.inverse[out]
        self.columns[out], self.costs[out] = column, self.cost(column)
        return True

    def value(self) -> float:
        return float((self.costs * self.uses).sum())

    def solve(self) -> None:
        """Column generation until the cost is within GAP of a bound: of any solution, or by this program's prices."""
        low = self.bound()
        for _ in range(PRICINGS):
            if self.value() <= low * (1 + GAP):
                break
            found, ratio = self.proposals()
            # prices less by the ratio are a solution of the dual program
            low = max(low, float((self.prices * self.counts).sum()) / max(ratio, 1.0))
            if not sum(self.enter(c) for c in found):
                break

    def whole(self) -> list[tuple[dict[int, int], int]]:
        """Patterns with whole numbers of uses; what they leave is for the stream."""
        left, times = self.counts.copy(), np.zeros(len(self.columns), dtype=np.int64)
        parts = [([self.at[n] for n in self.parts(c)], np.array(list(self.parts(c).values()))) for c in self.columns]
        patterns = [i for i, c in enumerate(self.columns) if not isinstance(c, int)]
        share = self.uses - np.floor(self.uses + 1e-6)
        for i in patterns:
            rows, many = parts[i]
            times[i] = int(min(np.floor(max(self.uses[i], 0.0) + 1e-6), (left[rows] // many).min()))
            left[rows] -= times[i] * many
        for i in sorted(patterns, key=lambda i: (-share[i], i)):
            rows, many = parts[i]
            if share[i] > 1e-6 and (left[rows] >= many).all():
                times[i] += 1
                left[rows] -= many
        return [(self.columns[i], int(times[i])) for i in patterns if times[i]]


@dataclass
class Plan:
    """Where the tails of each length go by rank.

    A run of ranks is (first rank, sequence, copies in a sequence, offset); with 0 copies it goes to the stream, and the
    offset is its first token there. The stream's tokens are cut at ``edges[k]``, the k-th of its sequences from ``stream`` on; all but the
    last few are full.
    """

    room: int
    runs: dict[int, np.ndarray]
    stream: int
    full: int
    ends: np.ndarray

    def pieces(self, length: int, ranks: np.ndarray) -> tuple[np.ndarray, ...]:
        """(index into ranks, start, length, sequence, offset) of the pieces of the tails of a length."""
        runs = self.runs[length]
        run = runs[np.searchsorted(runs[:, 0], ranks, side="right") - 1]
        within, copies = ranks - run[:, 0], run[:, 2]
        i = np.flatnonzero(copies)
        out = [(i, np.zeros(len(i), np.int64), np.full(len(i), length), run[i, 1] + within[i] // copies[i], run[i, 3] + within[i] % copies[i] * length)]
        i = np.flatnonzero(copies == 0)
        first = at = run[i, 3] + within[i] * length
        while len(i):
            # the sequence that holds token ``at``, and where it ends
            late = np.searchsorted(self.ends, at, side="right") - 1
            before = at < self.full * self.room
            begin = np.where(before, at // self.room * self.room, self.ends[late])
            end = np.where(before, begin + self.room, self.ends[np.minimum(late + 1, len(self.ends) - 1)])
            size = np.minimum(first + length, end) - at
            out.append((i, at - first, size, self.stream + np.where(before, at // self.room, self.full + late), at - begin))
            at = at + size
            more = at < first + length
            i, first, at = i[more], first[more], at[more]
        return tuple(np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True))


def plan(histogram: dict[int, int], room: int) -> Plan:
    """The places of tails by length and rank, for ``histogram`` (length to number of tails)."""
    lengths = np.array(sorted(n for n, k in histogram.items() if k), dtype=np.int64)
    if not len(lengths):
        return Plan(room, {}, 0, 0, np.zeros(1, np.int64))
    program = Program(lengths, np.array([histogram[int(n)] for n in lengths], dtype=np.int64), room)
    program.solve()
    runs: dict[int, list[tuple[int, int, int, int]]] = {int(n): [] for n in lengths}
    taken = dict.fromkeys(runs, 0)
    sequence = 0
    for column, times in program.whole():
        offset = 0
        for n, many in sorted(column.items(), reverse=True):
            runs[n].append((taken[n], sequence, many, offset))
            taken[n] += times * many
            offset += n * many
        sequence += times
    at = 0
    for n in runs:
        runs[n].append((taken[n], sequence, 0, at))
        at += (histogram[n] - taken[n]) * n
    full = at // room
    return Plan(room, {n: np.array(r, dtype=np.int64) for n, r in runs.items()}, sequence, full, full * room + np.cumsum([0, *powers(at % room)]))


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, room: int) -> DataFrame:
    """Whole sequences and tails of the documents (doc_id, text); a task numbers its whole sequences, and its tails by length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, part = WordCache.kept(tokenizer), TaskContext.get().partitionId()
        wide = np.dtype(f"<u{cache.width}")
        counts = np.zeros(room + 1, dtype=np.int64)
        for batch in slices(batches, "text"):
            rows: list[tuple] = []
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), cache.encode(batch.column("text")), strict=True):
                ids = np.append(np.frombuffer(data, dtype=wide), end_id).astype("<u4")
                n = len(ids)
                for start in range(0, n, room):
                    piece = ids[start : start + room]
                    size = len(piece)
                    tail = size < room
                    rows.append((doc_id, start, size, zlib.crc32(piece), n, part, int(counts[size]), tail, piece.astype(wide if end_id < 1 << 16 else "<u4").tobytes() if tail else None))
                    counts[size] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)

    return restrict(docs, "doc_id", "text").mapInArrow(run, _PIECES)


_NAMES = [x.split()[0] for x in _PIECES.split(", ")]
_TYPES = [{"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[x.split()[1]] for x in _PIECES.split(", ")]


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, room: int = 2048) -> DataFrame:
    """The pieces of the documents and their places: see OUT for the columns. ``tokenizer`` is the JSON of a tokenizer."""
    spark = docs.sparkSession
    home = f"{shared_dir(spark).rstrip('/')}/packed-{uuid.uuid4().hex}"
    tokenized(docs, tokenizer, end_id, room).write.parquet(f"{home}/pieces")
    pieces = spark.read.parquet(f"{home}/pieces")
    full = pieces.where("not tail").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", ((F.col("part") + 1) * TAILS + F.col("nth")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    tails = pieces.where("tail")
    held = tails.groupBy("part", "length").agg(F.count("*").alias("n"))
    # at most one row a length
    places = plan({r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}, room)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = held.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    ranked = tails.drop("ids", "tail").join(ahead, ["part", "length"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("ahead").to_numpy() + batch.column("nth").to_numpy()
            found = []
            for n in np.unique(length).tolist():
                rows = np.flatnonzero(length == n)
                at, *rest = places.pieces(n, rank[rows])
                found.append((rows[at], *rest))
            if not found:
                continue
            row, start, size, sequence, offset = (np.concatenate(x) for x in zip(*found, strict=True))
            own = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [own.column("doc_id"), own.column("start"), pa.array(start), pa.array(size), pa.array(own.column("ids_crc32").to_numpy(), mask=size < length[row]), own.column("doc_tokens"), pa.array(sequence), pa.array(offset), own.column("part"), own.column("length"), own.column("nth")],
                names=["doc_id", "start", "inner", "size", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part", "length", "nth"],
            )

    ranked.mapInArrow(place, "doc_id long, start long, inner long, size long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part long, length long, nth long").write.parquet(f"{home}/placed")
    placed = spark.read.parquet(f"{home}/placed")
    entire = placed.where("ids_crc32 is not null").select("doc_id", "start", F.col("size").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset")
    # only tails that are cut meet their ids again
    cut_up = placed.where("ids_crc32 is null").select("doc_id", "start", "inner", "size", "doc_tokens", "sequence_id", "offset", "part", "length", "nth").join(tails.select("part", "length", "nth", "ids"), ["part", "length", "nth"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs = []
            for ids, n, inner, size in zip(*(batch.column(c).to_pylist() for c in ("ids", "length", "inner", "size")), strict=True):
                crcs.append(zlib.crc32(np.frombuffer(ids, dtype=f"<u{len(ids) // n}")[inner : inner + size].astype("<u4")))
            start = pa.array(batch.column("start").to_numpy() + batch.column("inner").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), start, batch.column("size"), pa.array(crcs, pa.int64()), batch.column("doc_tokens"), batch.column("sequence_id"), batch.column("offset")], names=[x.split()[0] for x in OUT.split(", ")])

    return full.unionByName(entire).unionByName(cut_up.mapInArrow(sums, OUT))

"""LM scoring by prediction by partial matching over bytes.

The model is a trie of byte contexts up to ``order`` bytes, held as sorted arrays, one for each length. A symbol is
coded in the longest context that training saw; where it is new there, an escape (each distinct symbol of the context
gives DISCOUNT of its count to it, as in method D, which takes a half) leads to the context one byte shorter, with the symbols of the longer one excluded, down
to single bytes and at last an even choice among what is left. ``Trie`` does this for one text, also adaptively;
``score_corpus`` does it for a pretrained model of the whole corpus, with no table that every task must hold:

1. Documents are dealt into blocks by a hash of doc_id and text. A block counts its distinct (order + 1)-byte strings and sends
   each to a bucket by the last two bytes of its context, as sorted binary arrays.
2. A bucket merges what all blocks counted: with it come all contexts of two bytes and more that it needs. The counts
   of contexts below that are a table of 256 x 256 numbers. It answers each block with the code length of its strings.
3. A block adds up its documents from these answers.

Texts are scored in normal form: A-Z in lower case, words joined by single spaces, one end symbol. So the score is the
probability of the token sequence, like ``base_score``, whose token counts take the same way by 64-bit hashes of words.

Defined results: a null text counts as empty (the end alone); a null doc_id is in fold 0, so it trains; repeated rows
count each, and equal texts have equal scores; a text of any length is scored whole, in its block; extra columns are
ignored; without training text all symbols are equally likely; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import as_bytes, cut, fold_of, release, restrict, slices, text_bytes
from lectern.llm.shingles import mix, word_hashes

ORDER = 5
#: What each distinct symbol of a context gives to the escape.
DISCOUNT = 0.3
END = 10  # a line feed: never inside a text in normal form
BUCKETS = 64
BLOCK_BYTES = 16 << 20
LOG10 = float(np.log(10))


def normal(text: bytes) -> bytes:
    return b" ".join(text.lower().split()) + bytes([END])


# ---------------------------------------------------------------- one text at a time


class Trie:
    """Counts of symbols by context; the plain form of the model, for adaptive scoring and for tests."""

    def __init__(self, order: int = ORDER):
        self.order = order
        self.counts: dict[bytes, dict[int, int]] = {}

    def cost(self, context: bytes, symbol: int) -> float:
        """The code length of a symbol as a natural logarithm of its probability."""
        out, gone = 0.0, frozenset()
        for n in range(min(self.order, len(context)), -1, -1):
            seen = self.counts.get(context[len(context) - n :])
            if not seen:
                continue
            left = {s: c for s, c in seen.items() if s not in gone}
            total = sum(left.values())
            if symbol in left:
                return out + float(np.log((left[symbol] - DISCOUNT) / total))
            if left:
                out += float(np.log(DISCOUNT * len(left) / total))
            gone = frozenset(seen)
        return out - float(np.log(256 - len(gone)))

    def add(self, context: bytes, symbol: int) -> None:
        for n in range(min(self.order, len(context)), -1, -1):
            seen = self.counts.setdefault(context[len(context) - n :], {})
            seen[symbol] = seen.get(symbol, 0) + 1

    def learn(self, text: bytes) -> None:
        padded = bytes([END]) * self.order + normal(text)
        for i in range(self.order, len(padded)):
            self.add(padded[i - self.order : i], padded[i])

    def score(self, text: bytes, adaptive: bool = False) -> float:
        """log10 probability; an adaptive model also learns each symbol once it is coded."""
        padded, out = bytes([END]) * self.order + normal(text), 0.0
        for i in range(self.order, len(padded)):
            context = padded[i - self.order : i]
            out += self.cost(context, padded[i])
            if adaptive:
                self.add(context, padded[i])
        return out / LOG10


# ---------------------------------------------------------------- arrays


def strings(bodies: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(keys, bounds): for each symbol of each text in normal form its context and itself as one integer."""
    pad = bytes([END]) * order
    data = np.frombuffer(pad + b"".join([b + pad for b in bodies]), dtype=np.uint8)
    lengths = np.fromiter(map(len, bodies), dtype=np.int64, count=len(bodies))
    keys = np.zeros(len(data) - order, dtype=np.uint64)
    for i in range(order + 1):
        keys <<= np.uint64(8)
        keys |= data[i : len(data) - order + i]
    # what begins in the padding behind a text belongs to none
    keep = np.ones(len(keys), dtype=bool)
    ends = np.cumsum(lengths + order)
    for i in range(1, order + 1):
        keep[ends[ends - i < len(keys)] - i] = False
    return keys[keep], np.r_[0, np.cumsum(lengths)]


def words(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): 64-bit hashes of each text's words in order and of its end."""
    data = np.frombuffer(b"".join(bodies), dtype=np.uint8)
    lengths = np.fromiter(map(len, bodies), dtype=np.int64, count=len(bodies))
    stop = np.flatnonzero((data == 32) | (data == END))
    start = np.r_[0, stop[:-1] + 1]
    # the end of a text is a token too; an empty text has it alone
    word = stop > start
    value = np.zeros(len(start), dtype=np.uint64)
    value[word] = word_hashes(data, start[word], stop[word])
    last = data[stop] == END
    order = np.argsort(np.r_[np.flatnonzero(word) * 2, np.flatnonzero(last) * 2 + 1], kind="stable")
    hashes = np.r_[value[word], np.zeros(int(last.sum()), dtype=np.uint64)][order]
    owner = np.r_[np.searchsorted(np.cumsum(lengths), stop[word], side="right"), np.arange(len(bodies))][order]
    return hashes, np.searchsorted(owner, np.arange(len(bodies) + 1))


def tally(values: np.ndarray, counted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, ascending, and the sum of ``counted`` for each."""
    order = np.argsort(values)
    v = values[order]
    first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]]) if len(v) else np.zeros(0, dtype=np.int64)
    return v[first], np.add.reduceat(counted[order], first) if len(v) else counted[:0]


def tally_flags(values: np.ndarray, trains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``tally`` for values below 2^63 of which each counts once or not at all: one plain sort."""
    v = np.sort((values << np.uint64(1)) | ~trains.astype(bool))
    key = v >> np.uint64(1)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(v) else np.zeros(0, dtype=np.int64)
    return key[first], np.add.reduceat(1 - (v & np.uint64(1)).astype(np.int64), first) if len(v) else np.zeros(0, dtype=np.int64)


class Lookup:
    """Values of integer keys by a table over a hash; every key asked for must be there."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = np.uint64(64 - max(4, int(np.ceil(np.log2(max(len(keys), 1) * 2)))))
        slot = self._slot(keys)
        order = np.argsort(slot, kind="stable")
        self.keys, self.values = keys[order], values[order]
        self.start = np.searchsorted(slot[order], np.arange((1 << (64 - int(self.bits))) + 1, dtype=np.uint64)).astype(np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.bits

    def get(self, asked: np.ndarray) -> np.ndarray:
        at = self.start[self._slot(asked)]
        todo = np.flatnonzero(self.keys[at] != asked)
        while len(todo):
            at[todo] += 1
            todo = todo[self.keys[at[todo]] != asked[todo]]
        return self.values[at]


def find(table: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ``asked`` would be in the ascending ``table``, and whether it is there."""
    at = np.minimum(np.searchsorted(table, asked), max(len(table) - 1, 0))
    return at, (table[at] == asked) if len(table) else np.zeros(len(asked), dtype=bool)


class Model:
    """A trie as arrays, from distinct strings of order + 1 bytes with their counts (zero counts are ignored).

    ``low`` has the counts of pairs (byte before, symbol) of the whole corpus; strings give contexts of two bytes and
    more, complete for those whose last two bytes are in this bucket.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, low: np.ndarray, order: int = ORDER):
        keys, counts = keys[counts > 0], counts[counts > 0]
        self.order = order
        self.levels: dict[int, tuple] = {}
        for n in range(order, 1, -1):
            mask = np.uint64((1 << (8 * (n + 1))) - 1)
            if n < order:
                keys, counts = tally(keys & mask, counts)
            self.levels[n] = (keys, counts.astype(np.float64))
        pair = np.flatnonzero(low.ravel())
        self.levels[1] = (pair.astype(np.uint64), low.ravel()[pair].astype(np.float64))
        one = low.sum(axis=0)
        sym = np.flatnonzero(one)
        self.levels[0] = (sym.astype(np.uint64), one[sym].astype(np.float64))
        self.contexts = {}
        for n in range(order, -1, -1):
            keys, counts = self.levels[n]
            ctx = keys >> np.uint64(8)
            first = np.flatnonzero(np.r_[True, ctx[1:] != ctx[:-1]]) if len(ctx) else np.zeros(0, dtype=np.int64)
            total = np.add.reduceat(counts, first) if len(ctx) else np.zeros(0)
            kinds = np.diff(np.r_[first, len(ctx)]).astype(np.float64)
            self.contexts[n] = [ctx[first], total, kinds, None, None]
        for n in range(order, 0, -1):
            # what is left of the context one byte shorter once the symbols of this one are excluded
            keys, _ = self.levels[n]
            own, shorter = self.contexts[n], self.contexts[n - 1]
            mask = np.uint64((1 << (8 * n)) - 1)
            at, _ = find(self.levels[n - 1][0], keys & mask)
            first = np.searchsorted(keys >> np.uint64(8), own[0])
            gone = np.add.reduceat(self.levels[n - 1][1][at], first) if len(first) else np.zeros(0)
            up, _ = find(shorter[0], own[0] & np.uint64((1 << (8 * (n - 1))) - 1))
            own[3] = shorter[1][up] - gone if len(first) else np.zeros(0)
            own[4] = shorter[2][up] - own[2] if len(first) else np.zeros(0)

    def cost(self, asked: np.ndarray) -> np.ndarray:
        """Natural logarithms of the probabilities of strings (context and symbol)."""
        out = np.zeros(len(asked))
        todo = np.arange(len(asked))
        total, kinds = np.full(len(asked), -1.0), np.zeros(len(asked))  # what the longer context has left; -1: none yet
        for n in range(self.order, -1, -1):
            if not len(todo):
                break
            key = asked[todo] & np.uint64((1 << (8 * (n + 1))) - 1)
            ctx, t, d, tx, dx = self.contexts[n]
            at, there = find(ctx, key >> np.uint64(8))
            gram, known = find(self.levels[n][0], key)
            if len(ctx):
                fresh = there & (total[todo] < 0)
                total[todo[fresh]], kinds[todo[fresh]] = t[at[fresh]], d[at[fresh]]
            with np.errstate(divide="ignore"):
                norm = total[todo]
                hit = known & there
                out[todo[hit]] += np.log(self.levels[n][1][gram[hit]] - DISCOUNT) - np.log(norm[hit]) if hit.any() else 0.0
                miss = there & ~known
                some = miss & (kinds[todo] > 0)
                out[todo[some]] += np.log(DISCOUNT * kinds[todo[some]]) - np.log(norm[some])
            if n and miss.any():
                total[todo[miss]], kinds[todo[miss]] = tx[at[miss]], dx[at[miss]]
            todo = todo[~hit]
        if len(todo):
            out[todo] -= np.log(256 - len(self.levels[0][0]))
        return out


# ---------------------------------------------------------------- the corpus



def pack(values: np.ndarray, ascending: bool = False) -> bytes:
    """An array as bytes: differences if ascending, bytes of equal weight side by side, compressed."""
    import zstandard

    if ascending:
        values = np.diff(values, prepend=values.dtype.type(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes())


def unpack(data: bytes, dtype: str, ascending: bool = False) -> np.ndarray:
    import zstandard

    raw, size = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8), np.dtype(dtype).itemsize
    out = np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(dtype)
    return np.cumsum(out, dtype=dtype) if ascending else out


_PART = "block int, kind int, bucket int, keys binary, counts binary"


def _count(order: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents come sorted by block."""
        block, grams, tokens, low = None, [], [], np.zeros(1 << 16, dtype=np.int64)

        def done() -> pa.RecordBatch:
            rows = []
            for kind, held in ((0, grams), (1, tokens)):
                keys, counts = tally(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
                place = (mix((keys >> np.uint64(8)) & np.uint64(0xFFFF)) if kind == 0 else mix(keys)) % np.uint64(buckets)
                order_ = np.argsort(place, kind="stable")
                keys, counts, place = keys[order_], counts[order_], place[order_]
                edges = np.searchsorted(place, np.arange(buckets + 1, dtype=np.uint64)).tolist()
                rows += [(block, kind, b, pack(keys[lo:hi].astype("<u8"), True), pack(counts[lo:hi].astype("<u4"))) for b, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)) if hi > lo]
            cells = np.flatnonzero(low)
            rows.append((block, 2, -1, pack(cells.astype("<u8"), True), pack(low[cells].astype("<u8"))))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["block", "kind", "bucket", "keys", "counts"])

        for batch in slices(batches, "text", 2 << 20):
            owner, texts, train = batch.column("block").to_pylist(), as_bytes(batch.column("text")), np.array(batch.column("train").to_pylist(), dtype=bool)
            cuts = [0, *(i for i in range(1, len(owner)) if owner[i] != owner[i - 1]), len(owner)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if owner[lo] != block:
                    if block is not None:
                        yield done()
                    block, grams, tokens, low = owner[lo], [], [], np.zeros(1 << 16, dtype=np.int64)
                bodies = [normal(t) for t in texts[lo:hi]]
                keys, bounds = strings(bodies, order)
                trains = np.repeat(train[lo:hi], np.diff(bounds))
                grams.append(tally_flags(keys, trains))
                low += np.bincount((grams[-1][0] & np.uint64(0xFFFF)).astype(np.int64), grams[-1][1], 1 << 16).astype(np.int64)
                hashes, ends = words(bodies)
                tokens.append(tally(hashes, np.repeat(train[lo:hi], np.diff(ends)).astype(np.int64)))
                if len(grams) > 3:
                    for held in (grams, tokens):
                        held[:] = [tally(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))]
        if block is not None:
            yield done()

    return run


def _sum_low(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    low = np.zeros(1 << 16, dtype=np.int64)
    for batch in batches:
        for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            low[unpack(keys, "<u8", True).astype(np.int64)] += unpack(counts, "<u8").astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([low.astype("<i8").tobytes()], pa.binary())], names=["low"])


_ANSWER = "block int, kind int, bucket int, keys binary, answers binary, n_train long, v_train long"


def _answer(order: int, low: np.ndarray):
    """One bucket at a time: merge what all blocks sent, answer each block's part."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        kind = rows[0][1]
        sent = [unpack(r[3], "<u8", True) for r in rows]
        keys, counts = tally(np.concatenate(sent), np.concatenate([unpack(r[4], "<u4") for r in rows]).astype(np.int64))
        if kind == 0:
            values = Model(keys, counts, low, order).cost(keys).astype("<f4")
        else:
            values = counts.astype("<u4")
        out = [(r[0], kind, r[2], r[3], pack(values[np.searchsorted(keys, s)]), int(counts.sum()) if i == 0 else 0, int((counts > 0).sum()) if i == 0 else 0) for i, (r, s) in enumerate(zip(rows, sent, strict=True))]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["block", "kind", "bucket", "keys", "answers", "n_train", "v_train"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("block", "kind", "bucket", "keys", "counts")), strict=True):
                if held and held[0][1:3] != row[1:3]:
                    yield solve(held)
                    held = []
                held.append(row)
        if held:
            yield solve(held)

    return run


_SCORED = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _score(order: int, n_train: int, v_train: int):
    """Rows come sorted by block: first the answers, then the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, tables = None, {0: [], 1: []}, None
        for batch in slices(batches, "text", 2 << 20):
            owner, kinds = batch.column("block").to_pylist(), batch.column("kind").to_pylist()
            cuts = [0, *(i for i in range(1, len(owner)) if owner[i] != owner[i - 1] or (kinds[i] == 2) != (kinds[i - 1] == 2)), len(owner)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if owner[lo] != block:
                    block, parts, tables = owner[lo], {0: [], 1: []}, None
                own = batch.slice(lo, hi - lo)
                if kinds[lo] != 2:
                    for kind, keys, answers in zip(kinds[lo:hi], own.column("keys").to_pylist(), own.column("answers").to_pylist(), strict=True):
                        parts[kind].append((unpack(keys, "<u8", True), unpack(answers, "<f4" if kind == 0 else "<u4")))
                    continue
                if tables is None:
                    tables = [Lookup(np.concatenate([p[0] for p in parts[k]]), np.concatenate([p[1] for p in parts[k]])) for k in (0, 1)]
                    parts = {0: [], 1: []}
                bodies = [normal(t) for t in as_bytes(own.column("text"))]
                keys, bounds = strings(bodies, order)
                score = np.add.reduceat(tables[0].get(keys).astype(np.float64), bounds[:-1]) / LOG10
                hashes, ends = words(bodies)
                seen = tables[1].get(hashes).astype(np.float64)
                base = np.add.reduceat(np.log10((seen + 0.5) / (n_train + 0.5 * (v_train + 1))), ends[:-1])
                known = np.add.reduceat((seen > 0).astype(np.int64), ends[:-1])
                yield pa.RecordBatch.from_arrays([own.column("doc_id").cast(pa.int64()), pa.array(np.diff(ends), pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64())], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return run


def score_corpus(docs: DataFrame, held_out_fold: int = 1, order: int = ORDER, block_bytes: int = BLOCK_BYTES, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row for each row of ``docs``.

    The model learns from documents outside the held-out fold; ``buckets`` grows with the corpus (up to 65,536) so that
    what meets in one bucket stays within a task.
    """
    docs = restrict(docs, "doc_id", "text").withColumn("train", fold_of() != held_out_fold)
    blocks = max(12, -(-text_bytes(docs) // block_bytes))
    buckets = min(1 << 16, max(buckets, blocks))
    docs = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    counted = cut(docs.repartition("block").sortWithinPartitions("block").mapInArrow(_count(order, buckets), _PART))
    release(docs.sparkSession)
    low = np.zeros(1 << 16, dtype=np.int64)
    for row in counted.where("kind = 2").select("keys", "counts").coalesce(16).mapInArrow(_sum_low, "low binary").toLocalIterator():
        low += np.frombuffer(row["low"], dtype="<i8")
    answers = cut(counted.where("kind < 2").repartition("kind", "bucket").sortWithinPartitions("kind", "bucket").mapInArrow(_answer(order, low.reshape(256, 256)), _ANSWER))
    release(docs.sparkSession)
    total = answers.where("kind = 1").agg(F.coalesce(F.sum("n_train"), F.lit(0)).alias("n"), F.coalesce(F.sum("v_train"), F.lit(0)).alias("v")).first()
    none = F.lit(None)
    rows = answers.select("block", "kind", none.cast("long").alias("doc_id"), none.cast("string").alias("text"), "keys", "answers").unionByName(docs.select("block", F.lit(2).alias("kind"), "doc_id", "text", none.cast("binary").alias("keys"), none.cast("binary").alias("answers")))
    scored = rows.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(_score(order, total["n"], total["v"]), _SCORED)
    return scored.select("doc_id", (fold_of() == held_out_fold).alias("held_out"), "n_tokens", "n_known", F.lit(total["n"]).cast("long").alias("train_tokens"), "base_score", "score")

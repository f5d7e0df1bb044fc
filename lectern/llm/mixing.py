"""Mixing sources to target weights, in fixed-length blocks of words.

The words of each source, documents in a fixed order, form a stream that is packed into blocks of ``length`` words
(the last one may be shorter). A source with target T and size S is read T div S times as a whole and once more in part,
block by block, and the last slot of all takes as many words as are still missing, so T is met to the word. Slots are
put together in output shards of ``shard_blocks`` slots. How many slots of each source a shard gets is a multinomial
draw with the totals held fixed (that is, the multivariate hypergeometric distribution): the totals are split in halves
again and again, each split seeded by its place, so a shard finds its own counts and offsets from the totals alone.
Slot j of a source reads block ``permute(j mod blocks)`` of pass ``j div blocks``, by a keyed Feistel permutation, so no
block is read twice in a pass and reruns agree; a short last block is the last slot of its pass. Slots and blocks then
join by (source, block). ``mixed_shards`` is that output, ``mixed_documents`` the same words put back to documents and
``taken`` their counts.

Nothing orders or sums a whole source in one task: a source is dealt over buckets of a hash of doc_id, as many as the
rows ask for, offsets are summed within buckets, and only one row for each source and bucket is summed along. The
driver holds one row for each source. Sources are weighed 1, 2, 3, repeating, in the order of their code points, null last.

Defined results: null text has size 0 and is never taken; a source of size 0 has target 0; repeated rows are separate
documents; null doc_ids count like any other; a text of any length is cut at its blocks; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import WORD, as_bytes, cut, release, slices
from lectern.llm.shingles import mix

LENGTH, SEED, LIMIT = 128, 20_240, 3
WEIGHTS = (1, 2, 3)
#: Rows of a bucket, about, and buckets of a source, at least.
BUCKET_ROWS, BUCKETS = 20_000, 256
#: Slots of one output shard; the last shard may have fewer.
SHARD = 1024
#: Up to so many slots a split is drawn; beyond, its noise would be below a ten-thousandth and it is even.
DRAWN = 900_000_000
#: Where a null doc_id is placed in joins by id.
NO_ID = -(1 << 63)


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """(source, source_size, rank, target) from (source, source_size), one row for each source.

    With sources ordered by size for their weight, those that reach ``limit`` times their size come first. The share
    of a unit of weight once k of them are full is (total - full) / weight left; the first k whose next source stays
    below its limit is the answer.
    """
    order = Window.orderBy(F.asc_nulls_last("source"))
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(order)).withColumn("weight", pick.cast("double"))
    every = Window.partitionBy(F.lit(0))
    before = Window.orderBy(F.col("source_size") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    step = (
        ranked.withColumn("total", F.sum("source_size").over(every))
        .withColumn("left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("unit", (F.col("total") - limit * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.col("left"))
        .withColumn("open", F.col("unit") * F.col("weight") <= limit * F.col("source_size"))
    )
    found = step.withColumn("share", F.min(F.when(F.col("open"), F.struct(F.col("source_size") / F.col("weight"), F.col("rank"), F.col("unit")))).over(every)["unit"])
    target = F.least(F.coalesce(F.col("share") * F.col("weight"), F.lit(float("inf"))), limit * F.col("source_size").cast("double"))
    return found.select("source", "source_size", "rank", target.cast("double").alias("target"))


def permute(index: np.ndarray, size: np.ndarray, key: np.ndarray, rounds: int = 4) -> np.ndarray:
    """For each row a pseudorandom permutation of range(size), chosen by key, at index; walks until inside."""
    bits = np.maximum(1, np.ceil(np.log2(np.maximum(size, 2)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << bits) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    keys = key.astype(np.uint64)
    while len(todo):
        x, b, m = out[todo], bits[todo], mask[todo]
        left, right = x >> b, x & m
        for r in range(rounds):
            with np.errstate(over="ignore"):
                left, right = right, left ^ (mix(right + keys[todo] + np.uint64(r * 0x9E3779B9)) & m)
        out[todo] = (left << b) | right
        todo = todo[out[todo] >= size[todo].astype(np.uint64)]
    return out.astype(np.int64)


def _key(seed: int, rank: np.ndarray, epoch: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(rank.astype(np.uint64) + np.uint64(seed << 20)) + epoch.astype(np.uint64))


def halves(counts: np.ndarray, n: int, seed: int, lo: int, hi: int) -> np.ndarray:
    """How many of ``counts`` (slots by source) fall in the first ``n`` slots of shards lo..hi, drawn at random."""
    if counts.sum() <= DRAWN:
        return np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(counts, n, method="marginals")
    even = counts * (n / counts.sum())
    out = np.floor(even).astype(np.int64)
    out[np.argsort(out - even, kind="stable")[: n - int(out.sum())]] += 1
    return out


def shard_counts(counts: np.ndarray, size: int, seed: int):
    """A function of a shard's number: for each source, how many of its slots come before the shard and are in it."""
    shards, known = max(1, -(-int(counts.sum()) // size)), {}

    def of(shard: int) -> tuple[np.ndarray, np.ndarray]:
        lo, hi, before, held = 0, shards, np.zeros_like(counts), counts
        while hi - lo > 1:
            mid = (lo + hi) // 2
            if len(known) > 4096:
                known.clear()
            if (lo, hi) not in known:
                known[lo, hi] = halves(held, (mid - lo) * size, seed, lo, hi)
            left = known[lo, hi]
            if shard < mid:
                hi, held = mid, left
            else:
                lo, before, held = mid, before + left, held - left
        return before, held

    return of


_SLOT = "rank int, block long, epoch int, shard long, place int, words int"


def _slots(plan: dict[str, np.ndarray], length: int, size: int, seed: int):
    """The slots of shards: which block of which source and pass, and how many of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, rank, blocks, slots = shard_counts(plan["slots"], size, seed), plan["rank"], plan["blocks"], plan["slots"]
        for batch in batches:
            for shard in batch.column("id").to_pylist():
                first, n = of(shard)
                which = np.repeat(np.arange(len(n)), n)
                j = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + first[which]
                epoch, place, whole = j // blocks[which], j % blocks[which], plan["whole"][which]
                inside = np.flatnonzero(place < whole)
                block = place.copy()
                block[inside] = permute(place[inside], whole[inside], _key(seed, rank[which[inside]], epoch[inside]))
                held = np.where(block < whole, length, plan["tail"][which])
                words = np.where((j == slots[which] - 1) & (plan["last"][which] > 0), plan["last"][which], held)
                order = np.random.default_rng([seed, shard]).permutation(len(which))
                columns = (rank[which], block, epoch, np.full(len(which), shard), np.argsort(order), words)
                kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["rank", "block", "epoch", "shard", "place", "words"])

    return run


class Mix:
    """The plan of a mix: ``sized`` documents with their place in their source's stream, and the ``slots`` drawn."""

    def __init__(self, docs: DataFrame, length: int = LENGTH, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT, seed: int = SEED, shard_blocks: int = SHARD):
        self.length, spark = length, docs.sparkSession
        narrow = cut(docs.select("doc_id", "source", size_of().alias("size"), F.xxhash64("text").alias("digest")))
        buckets = max(BUCKETS, -(-narrow.count() // BUCKET_ROWS))
        narrow = narrow.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(buckets)))
        dealt = cut(narrow.groupBy("source", "bucket").agg(F.sum("size").alias("held")))
        self.sources = cut(targets(dealt.groupBy("source").agg(F.sum("held").alias("source_size")), weights, limit))
        ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        base = dealt.withColumn("base", F.coalesce(F.sum("held").over(ahead), F.lit(0))).drop("held")
        base = base.join(self.sources, base.source.eqNullSafe(self.sources.source)).select(base.source.alias("of"), F.col("bucket").alias("in"), "base", "rank", "source_size", "target")
        within = Window.partitionBy("source", "bucket").orderBy("doc_id", "digest", "size").rowsBetween(Window.unboundedPreceding, -1)
        placed = narrow.withColumn("start", F.coalesce(F.sum("size").over(within), F.lit(0)))
        placed = placed.join(base, placed.source.eqNullSafe(base["of"]) & (placed.bucket == base["in"]))
        self.sized = cut(placed.select("doc_id", "digest", "rank", "size", "source_size", "target", (F.col("start") + F.col("base")).alias("start")))
        release(spark)
        # one row for each source
        rows = sorted((r["rank"], r["source_size"], round(r["target"])) for r in self.sources.where("source_size > 0").collect())
        rank, size, aim = (np.array(c, dtype=np.int64) for c in (zip(*rows, strict=True) if rows else ((), (), ())))
        safe = np.maximum(size, 1)
        missing = aim % safe
        plan = {"rank": rank, "blocks": -(-size // length), "whole": size // length, "tail": size % length, "last": missing % length}
        plan["slots"] = aim // safe * plan["blocks"] + -(-missing // length)
        shards = -(-int(plan["slots"].sum()) // shard_blocks)
        # a task makes some ten thousand slots; a range is dealt out as it is told, whatever its size in bytes
        parts = max(1, min(shards, max(spark.sparkContext.defaultParallelism, shards // 32)))
        self.slots = spark.range(0, shards, 1, parts).mapInArrow(_slots(plan, length, shard_blocks, seed), _SLOT)

    def pieces(self) -> DataFrame:
        """Blocks by index: (rank, block) with the documents that lie in them, where and how many words of each."""
        n = self.length
        span = self.sized.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence(start div {n}, (start + size - 1) div {n})")))
        lo, hi = F.greatest("start", F.col("block") * n), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * n)
        return span.select("rank", "block", "doc_id", "digest", "start", "size", "source_size", "target", (lo - F.col("block") * n).cast("int").alias("at"), (hi - lo).cast("int").alias("held"))

    def met(self, slots: DataFrame) -> DataFrame:
        """Pieces with the slots that read them, joined by index; both sides grow with the corpus, so neither is broadcast."""
        return self.pieces().hint("merge").join(slots.hint("merge"), ["rank", "block"])


def _read() -> Column:
    """How many words of a piece a slot takes: those of the block that lie before its limit."""
    return F.greatest(F.lit(0), F.least(F.col("held"), F.col("words") - F.col("at")))


def taken(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken), one row for each row of ``docs`` (doc_id, text, source)."""
    plan = Mix(docs.select("doc_id", "text", "source"), **options)
    often = plan.slots.groupBy("rank", "block", "words").agg(F.count("*").alias("times"))
    got = plan.met(often).groupBy("rank", "start").agg(F.sum(_read() * F.col("times")).alias("got"))
    # documents without words share the start of the next one
    read = plan.sized.where("size > 0").join(got, ["rank", "start"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("got", F.lit(0)).cast("long").alias("taken"))
    none = plan.sized.where("size = 0").select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    return read.unionByName(none)


_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def spans_of(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The words of spans [lo, hi) as they stand in the text; spans that do not touch are set on lines of their own."""
    runs: list[list[int]] = []
    for lo, hi in sorted(spans):
        if runs and runs[-1][1] == lo:
            runs[-1][1] = hi
        else:
            runs.append([lo, hi])
    edges = [m.span() for m in _WORDS.finditer(text)]
    return b"\n".join(text[edges[lo][0] : edges[hi - 1][1]] for lo, hi in runs)


def _cutter(columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = []
            for text, size, spans in zip(as_bytes(batch.column("text")), batch.column("_size").to_pylist(), batch.column("_spans").to_pylist(), strict=True):
                pairs = [(s["lo"], s["hi"]) for s in spans]
                texts.append(text if sum(hi - lo for lo, hi in pairs) == size else spans_of(text, pairs))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()).cast(pa.string()) if c == "text" else batch.column(c) for c in columns], names=columns)

    return run


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """What the mix takes, with the columns of ``docs``: for each pass over its source a row of each document with the
    words that lie in the blocks taken. A document taken whole keeps its text as it is, and what is taken of another
    keeps the white space between its words; n_chars follows the text.
    """
    plan = Mix(docs.select("doc_id", "text", "source"), **options)
    lo = F.col("block") * plan.length + F.col("at") - F.col("start")
    got = plan.met(plan.slots).withColumn("read", _read()).where("read > 0")
    got = got.groupBy("rank", "start", "doc_id", "digest", "size", "epoch").agg(F.collect_list(F.struct(lo.alias("lo"), (lo + F.col("read")).alias("hi"))).alias("spans"))
    got = cut(got.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"), F.col("digest").alias("_digest"), F.col("size").alias("_size"), F.col("spans").alias("_spans")))
    release(docs.sparkSession)
    # repeated rows have places of their own in the stream, so their text is joined in once
    keys = ["_id", "_digest"]
    rows = docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn("_digest", F.xxhash64("text"))
    rows = rows.repartition(*keys).dropDuplicates(keys)  # else texts are sorted on both sides of the exchange
    joined = rows.join(got.hint("merge"), keys).select(*docs.columns, "_size", "_spans")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    out = joined.mapInArrow(_cutter(docs.columns), schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def _cut_blocks(length: int):
    """The pieces of a document, one for each block that it lies in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            rows = []
            for rank, start, text in zip(batch.column("rank").to_pylist(), batch.column("start").to_pylist(), as_bytes(batch.column("text")), strict=True):
                words = text.split()
                for block in range(start // length, -(-(start + len(words)) // length)):
                    lo, hi = max(0, block * length - start), min(len(words), (block + 1) * length - start)
                    rows.append((rank, block, lo + start - block * length, [w.decode("utf-8", "replace") for w in words[lo:hi]]))
            columns = zip(*rows, strict=True) if rows else ((), (), (), ())
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["rank", "block", "at", "piece"])

    return run


def mixed_shards(docs: DataFrame, **options) -> DataFrame:
    """(shard, place, source, epoch, block, n_words, text): the output shards, slot by slot, with the blocks' words."""
    plan = Mix(docs.select("doc_id", "text", "source"), **options)
    keys = ["_id", "digest"]
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64("text").alias("digest"), "text").repartition(*keys).dropDuplicates(keys)
    placed = plan.sized.where("size > 0").withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).select(*keys, "rank", "start")
    pieces = texts.join(placed.hint("merge"), keys).select("rank", "start", "text").mapInArrow(_cut_blocks(plan.length), "rank int, block long, at int, piece array<string>")
    # at most ``length`` pieces meet in a block
    blocks = pieces.groupBy("rank", "block").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"])).alias("all"))
    out = plan.slots.hint("merge").join(blocks.hint("merge"), ["rank", "block"]).join(plan.sources.select("rank", "source"), "rank")
    return out.select("shard", "place", "source", "epoch", "block", F.col("words").alias("n_words"), F.concat_ws(" ", F.slice("all", F.lit(1), F.col("words"))).alias("text"))

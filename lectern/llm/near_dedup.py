"""MinHash near-dedup with sequential Bayesian verification of banded candidates.

1. Every document becomes the set of its distinct 5-word shingles and one row: size, a digest of the set, ``bands``
   keys of ``rows`` min-hashes each and, as 16-bit values, the signature. Documents with the same set are one class,
   and each class is a node with a number of its own, so that rows that share a doc_id never stand for each other.
2. Classes that share a band key are candidates. A bucket is never paired out: its members meet its smallest member
   first (a star, linear in the bucket). Links found join components; buckets that still hold several
   components are compared in full between different components, block by block; see ``_across``.
3. Candidate signatures are compared batch by batch. After n compared hashes of which m agree, the posterior of the
   similarity under a uniform prior is Beta(m + 1, n - m + 1); a pair is dropped as soon as the probability that it
   reaches the threshold is below ``miss``.
4. Survivors are confirmed on their full shingle sets, read again from the texts: ``100 * both >= 75 * either``.

With 60 bands of 6 rows a pair at similarity 0.75 meets in no band with probability (1 - 0.75^6)^60 < 1e-5.

Aggregates that a join by a hot key needs are written first, so that adaptive execution can split the hot key's rows.
Texts move once for all documents and then only those of candidates.

Defined results: a null or blank text has an empty set, is linked with nothing and is kept; a row with a null doc_id
carries links like any other, and the smallest id reachable is null only where no row reached has one; rows that repeat a doc_id with another text are linked by their own texts; repeated
rows and equal texts are one class; texts of any length are read whole, in batches by bytes; extra columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import as_bytes, components, cut, narrow, release, restrict, slices
from lectern.llm.shingles import mix, shingle_sets

WORDS, BANDS, ROWS = 5, 60, 6
PERCENT, MISS = 75, 1e-6
#: Partners of one document that are verified together, and so the texts that one task holds for it.
TOGETHER = 64
#: Documents and shingles of one side of a block, about; so a block holds some tens of MB however long its texts are.
CHUNK, CHUNK_SHINGLES = 1024, 1 << 20
#: Where a null doc_id is placed in joins by id.
NO_ID = -(1 << 63)


def hash_family(n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of n hash functions on mixed 64-bit values."""
    x = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) + np.uint64(seed << 32))
    return x[:n] | np.uint64(1), x[n:]


def signatures(values: np.ndarray, bounds: np.ndarray, n: int, seed: int = 7) -> np.ndarray:
    """Min-hashes (32 bits) of each nonempty set; empty sets get zeros."""
    sizes = np.diff(bounds)
    out = np.zeros((len(sizes), n), dtype=np.uint32)
    full = np.flatnonzero(sizes)
    if len(full):
        mul, add = hash_family(n, seed)
        begin = bounds[:-1][full]
        buffer = np.empty(len(values), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for i in range(n):
                np.multiply(values, mul[i], out=buffer)
                np.add(buffer, add[i], out=buffer)
                out[full, i] = np.minimum.reduceat(buffer, begin) >> np.uint64(32)
    return out


_SIG = "doc_id long, raw long, n_shingles long, digest binary, bands array<long>, sig binary"


def _sign(words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in slices(batches, "text", 1 << 20):
            values, bounds = shingle_sets(as_bytes(batch.column("text")), words)
            sig = signatures(values, bounds, bands * rows)
            n = np.diff(bounds)
            keys = np.zeros((len(n), bands), dtype=np.uint64)
            with np.errstate(over="ignore"):
                for b in range(bands):
                    key = np.full(len(n), b + 1, dtype=np.uint64)
                    for r in range(rows):
                        key = mix(key + sig[:, b * rows + r])
                    keys[:, b] = key
            digest = [hashlib.blake2b(values[lo:hi].tobytes(), digest_size=16).digest() if hi > lo else None for lo, hi in zip(bounds, bounds[1:], strict=False)]
            small = (sig & np.uint32(0xFFFF)).astype("<u2")
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("raw"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.ListArray.from_arrays(np.arange(0, len(n) * bands + 1, bands, dtype=np.int32), keys.reshape(-1).view(np.int64)), pa.array([x.tobytes() for x in small], pa.binary())],
                names=["doc_id", "raw", "n_shingles", "digest", "bands", "sig"],
            )

    return run


def least_matches(n: int, percent: int = PERCENT, miss: float = MISS) -> int:
    """The fewest matches of n with which P(similarity >= percent / 100) is still ``miss`` or more.

    The posterior is Beta(m + 1, n - m + 1), whose upper tail at t is P(Binomial(n + 1, t) <= m).
    """
    t = percent / 100
    tail, term = 0.0, (1 - t) ** (n + 1)
    for m in range(n + 1):
        tail += term
        if tail >= miss:
            return m
        term *= (n + 1 - m) / (m + 1) * t / (1 - t)
    return n


def _prune(batch_hashes: int, percent: int, miss: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<u2").reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b"))
            alive, agree = np.arange(batch.num_rows), np.zeros(batch.num_rows, dtype=np.int64)
            for lo in range(0, one.shape[1], batch_hashes):
                hi = min(lo + batch_hashes, one.shape[1])
                agree = agree + (one[alive, lo:hi] == two[alive, lo:hi]).sum(axis=1)
                stay = agree >= least_matches(hi, percent, miss)
                alive, agree = alive[stay], agree[stay]
            yield batch.select(["a", "b"]).take(pa.array(alive))

    return run


def overlap(one: np.ndarray, two: np.ndarray) -> int:
    """How many values two ascending arrays of distinct values share."""
    if not len(one) or not len(two):
        return 0
    return int((one[np.minimum(np.searchsorted(one, two), len(one) - 1)] == two).sum())


def linked(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    both = overlap(one, two)
    return both > 0 and 100 * both >= percent * (len(one) + len(two) - both)


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([min(x) for x in found], pa.int64()), pa.array([max(x) for x in found], pa.int64())], names=["a", "b"])


def _confirm(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted: first the text of a (b is null), then those of its candidates."""
        mine: np.ndarray = np.zeros(0, dtype=np.uint64)
        for batch in slices(batches, "text", 1 << 20):
            values, bounds = shingle_sets(as_bytes(batch.column("text")), words)
            out: list[tuple[int, int]] = []
            for n, (a, b) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)):
                own = values[bounds[n] : bounds[n + 1]]
                if b is None:
                    mine = own.copy()
                elif linked(mine, own, percent):
                    out.append((a, b))
            yield _pairs(out)

    return run


def links_among(pairs: DataFrame, held: DataFrame, rows: int, words: int = WORDS, percent: int = PERCENT, miss: float = MISS) -> DataFrame:
    """The candidate pairs (a, b) that are links: pruned by their signatures, then confirmed on full sets.

    ``held`` has (node, n_shingles, sig, text) of every candidate; there are about ``rows`` pairs.
    """
    sigs, texts = held.select("node", "n_shingles", "sig"), held.select("node", "text")
    sized = pairs.join(sigs.toDF("a", "n_a", "sig_a"), "a").join(sigs.toDF("b", "n_b", "sig_b"), "b").where(F.expr(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"))
    alive = cut(sized.select("a", "b", "sig_a", "sig_b").mapInArrow(_prune(60, percent, miss), "a long, b long"))
    # each document's partners go out in groups of about TOGETHER, so that a hot document is spread over many tasks
    many = cut(narrow(alive.groupBy("a").agg(F.ceil(F.count("*") / TOGETHER).alias("groups")), rows))
    dealt = cut(narrow(alive.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("groups")).alias("part")), rows))
    left = dealt.select("a", "part").distinct().join(texts.toDF("a", "text"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "text")
    right = dealt.join(texts.toDF("b", "text"), "b").select("a", "part", "b", "text")
    return left.unionByName(right).repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b")).mapInArrow(_confirm(words, percent), "a long, b long")


def _blocks(words: int, percent: int, miss: float):
    """Links between documents of different components in a block; of those only what joins components."""
    names = ("node", "component", "side", "sig")

    def solve(rows: list[tuple]) -> list[tuple[int, int]]:
        ids, group, side, sigs, sets = zip(*rows, strict=True)
        root = {c: c for c in group}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        sig = np.frombuffer(b"".join(sigs), dtype="<u2").reshape(len(rows), -1)
        sizes, sides = np.array(list(map(len, sets))), np.array(side)
        steps = [(hi, least_matches(hi, percent, miss)) for hi in range(60, sig.shape[1] + 1, 60)]
        across = sides.min() != sides.max()
        out = []
        for x in range(len(rows)):
            # a block of two chunks compares across them, a block of one chunk within it
            other = np.arange(x + 1, len(rows))
            if across:
                other = other[sides[other] != sides[x]]
            other = other[100 * np.minimum(sizes[other], sizes[x]) >= percent * np.maximum(sizes[other], sizes[x])]
            agree, lo = np.zeros(len(other), dtype=np.int64), 0
            for hi, need in steps:
                agree = agree + (sig[other, lo:hi] == sig[x, lo:hi]).sum(axis=1)
                stay = agree >= need
                other, agree, lo = other[stay], agree[stay], hi
            for y in other[np.argsort(-agree, kind="stable")].tolist():
                a, b = find(group[x]), find(group[y])
                if a != b and linked(sets[x], sets[y], percent):
                    root[max(a, b)] = min(a, b)
                    out.append((ids[x], ids[y]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of a block's texts only their sets are kept
        key, held = None, []
        for batch in slices(batches, "text", 1 << 20):
            values, bounds = shingle_sets(as_bytes(batch.column("text")), words)
            out: list[tuple[int, int]] = []
            for n, (k, *row) in enumerate(zip(batch.column("block").to_pylist(), *(batch.column(c).to_pylist() for c in names), strict=True)):
                if k != key:
                    out += solve(held) if held else []
                    key, held = k, []
                held.append((*row, values[bounds[n] : bounds[n + 1]].copy()))
            yield _pairs(out)
        yield _pairs(solve(held) if held else [])

    return run


def _labelled(docs: DataFrame, words: int, bands: int, rows: int, percent: int, miss: float) -> DataFrame:
    """(doc_id, raw, n_shingles, label, component_id), a row for each row of ``docs`` (doc_id, text).

    ``raw`` is a hash of the text as it is; ``label`` is the component's number, null for a row that is linked with nothing by
    definition (no words).
    """
    docs = restrict(docs, "doc_id", "text").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text", F.xxhash64("text").alias("raw"))
    signed = cut(docs.mapInArrow(_sign(words, bands, rows), _SIG))
    known = F.when(F.col("doc_id") != NO_ID, F.col("doc_id"))
    classes = signed.where("digest is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "raw")).alias("least"), F.min(known).alias("named"))
    # numbers are given once and written, so that they are the same ever after
    classes = cut(classes.select("digest", "least.*", "named", F.monotonically_increasing_id().alias("node")))
    count = classes.count()
    where = ["digest", "doc_id", "raw"]

    each = cut(signed.select(*where, "bands").join(classes, where).dropDuplicates(where).select("node", "bands"))
    release(docs.sparkSession)
    # keys of different bands differ by their seed
    member = _mixed(each.select("node", F.explode("bands").alias("key")), "node")
    del each
    release(docs.sparkSession)
    # only classes that share a bucket with another go on, with their signatures and texts
    some = cut(narrow(classes.join(member.select("node").distinct(), "node", "left_semi"), count))
    sigs = signed.select(*where, "n_shingles", "sig").join(some.drop("named"), where).dropDuplicates(where).select("doc_id", "raw", "node", "n_shingles", "sig")
    held = cut(docs.join(sigs, ["doc_id", "raw"]).dropDuplicates(["doc_id", "raw"]).select("node", "n_shingles", "sig", "text"))
    release(docs.sparkSession)

    pairs = cut(member.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct())
    found = cut(links_among(pairs, held, pairs.count(), words, percent, miss))
    del pairs, sigs
    release(docs.sparkSession)
    group = components(found)
    joined = member.select("key", "node").join(group, "node", "left")
    member = _mixed(joined.select("key", "node", F.coalesce("component", "node").alias("component")), "component")
    if not member.isEmpty():
        more = cut(_across(member, held, words, percent, miss))
        del joined, member, held
        release(docs.sparkSession)
        group = group if more.isEmpty() else components(found.unionByName(more))
    least = cut(narrow(group.join(classes, "node").groupBy("component").agg(F.min("named").alias("component_id")), count))
    group = group.join(least, "component")
    of_class = cut(narrow(classes.join(group, "node", "left").select("digest", F.coalesce("component", "node").alias("label"), F.coalesce("component_id", "named").alias("component_id")), count))
    brief = signed.select(known.alias("doc_id"), "raw", "n_shingles", "digest")
    linked_ = brief.where("digest is not null").join(of_class, "digest").select("doc_id", "raw", "n_shingles", "label", "component_id")
    return linked_.unionByName(brief.where("digest is null").select("doc_id", "raw", "n_shingles", F.lit(None).cast("long").alias("label"), F.col("doc_id").alias("component_id")))


def near_groups(docs: DataFrame, words: int = WORDS, bands: int = BANDS, rows: int = ROWS, percent: int = PERCENT, miss: float = MISS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of ``docs`` (doc_id, text)."""
    out = _labelled(docs, words, bands, rows, percent, miss)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _mixed(member: DataFrame, by: str) -> DataFrame:
    """The buckets whose members differ in ``by``, each member with the bucket's smallest node as ``pivot``.

    A crowd of near copies shares its keys; the buckets are written before members join them, so that the crowd's rows
    can be split.
    """
    several = member.groupBy("key").agg(F.min(by).alias("lo"), F.max(by).alias("hi"), F.min("node").alias("pivot")).where("lo <> hi").select("key", "pivot")
    return cut(member.join(cut(several), "key"))


def _across(member: DataFrame, held: DataFrame, words: int, percent: int, miss: float) -> DataFrame:
    """Links between members of one bucket that are in different components.

    Buckets with the same smallest member form a cluster, dealt into chunks of about CHUNK documents or CHUNK_SHINGLES
    shingles. Each pair of chunks is one block, compared within its task, which gives the links that join components
    and no other rows. So a crowd of look-alikes just below the threshold is compared in full, in many tasks of bounded
    memory; a text goes out once for each chunk of its cluster.
    """
    cluster = cut(member.select("pivot", "node", "component").distinct().join(held.select("node", "n_shingles"), "node"))
    chunks = F.ceil(F.greatest(F.count("*") / CHUNK, F.sum("n_shingles") / CHUNK_SHINGLES)).cast("int").alias("chunks")
    size = cut(cluster.groupBy("pivot").agg(chunks))
    dealt = cluster.join(size, "pivot").withColumn("own", F.expr("cast(pmod(xxhash64(node), chunks) as int)")).withColumn("with", F.explode(F.expr("sequence(0, chunks - 1)")))
    dealt = dealt.select(F.concat_ws("-", "pivot", F.least("own", "with"), F.greatest("own", "with")).alias("block"), "node", "component", F.col("own").alias("side"))
    rows = dealt.join(held.select("node", "sig", "text"), "node")
    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(_blocks(words, percent, miss), "a long, b long")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: one of each component, and all that are linked with nothing; of repeated rows with
    the same id and text one stays."""
    every = _labelled(docs, WORDS, BANDS, ROWS, PERCENT, MISS).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), F.col("raw").alias("_raw"), "label", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
    one = every.where("label is not null and kept").groupBy("label").agg(F.min(F.struct("_id", "_raw")).alias("row")).select("row.*")
    kept = cut(one.unionByName(every.where("label is null").select("_id", "_raw")).distinct())
    release(docs.sparkSession)
    rows = docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn("_raw", F.xxhash64("text"))
    return rows.join(kept, ["_id", "_raw"], "left_semi").dropDuplicates(["_id", "_raw"]).select(*docs.columns)

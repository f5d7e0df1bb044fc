"""Exact dedup by composable polynomial fingerprints.

A text is hashed in chunks, each a polynomial in a fixed base modulo the prime 2^31 - 1, for two bases at once;
chunk hashes combine by length-shifted arithmetic, ``H(xy) = H(x) * r^|y| + H(y)``, so chunks of a huge document can
be hashed in any order and anywhere. Documents with equal (length, fingerprints) are then compared chunk by chunk:
for each group and chunk number the least and the greatest chunk must agree. This is an aggregate that combines
within each task, so that a group holding a third of all rows is neither gathered nor paired.

Groups are written before rows join them, so that adaptive execution can split the rows of a hot group.

Defined results: null text counts as empty and all empty texts are equal; a null doc_id never stays where the group
has another; repeated rows count in ``group_size`` each; a text of any length is hashed and compared in chunks; of equal
least doc_ids every row is kept by ``exact_groups`` and one row by ``drop_copies``; extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import as_bytes, cut, narrow, release, restrict, slices, squeeze

PRIME = (1 << 31) - 1
#: Bases of the two polynomials; any two residues that are not small do.
BASES = (1_402_024_253, 918_273_645)
CHUNK = 4096
#: Where a null doc_id is placed in joins by id.
NO_ID = -(1 << 63)

_POWERS = np.empty((len(BASES), CHUNK), dtype=np.uint64)
for _i, _r in enumerate(BASES):
    _x = 1
    for _j in range(CHUNK):
        _POWERS[_i, _j] = _x
        _x = _x * _r % PRIME


def power(base: int, exponents: np.ndarray) -> np.ndarray:
    """base ** exponents modulo PRIME, elementwise."""
    out, square, left = np.ones(len(exponents), dtype=np.uint64), base % PRIME, exponents.astype(np.uint64).copy()
    while left.any():
        out = np.where(left & np.uint64(1), out * np.uint64(square) % np.uint64(PRIME), out)
        square = square * square % PRIME
        left >>= np.uint64(1)
    return out


def combine(left: int, right: int, right_length: int, base: int) -> int:
    """The hash of the concatenation from the hashes of its two parts."""
    return (left * pow(base, right_length, PRIME) + right) % PRIME


def chunk_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    """Hashes of the chunks data[starts:ends] that tile ``data``; none is longer than CHUNK or empty."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    weight = _POWERS[which][np.repeat(ends, ends - starts) - 1 - np.arange(len(data))]
    return np.add.reduceat(weight * data, starts) % np.uint64(PRIME)


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """One row of len(BASES) hashes for each text."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    per = -(-lengths // CHUNK)
    doc = np.repeat(np.arange(len(texts)), per)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    first = np.repeat(np.cumsum(lengths) - lengths, per)
    starts, ends = first + nth * CHUNK, first + np.minimum((nth + 1) * CHUNK, lengths[doc])
    behind = first + lengths[doc] - ends
    out = np.zeros((len(texts), len(BASES)), dtype=np.int64)
    for which, base in enumerate(BASES):
        parts = chunk_hashes(data, starts, ends, which) * power(base, behind) % np.uint64(PRIME)
        total = np.zeros(len(texts), dtype=np.uint64)
        np.add.at(total, doc, parts)
        out[:, which] = total % np.uint64(PRIME)
    return out


_MARKS = "doc_id long, raw long, n_bytes long, fp long, text_sha256 string"


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 2 << 20):
        texts = [squeeze(x) for x in as_bytes(batch.column("text"))]
        two = fingerprints(texts)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), batch.column("raw"), pa.array(map(len, texts), pa.int64()), pa.array(two[:, 0] * (1 << 31) + two[:, 1], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in texts])],
            names=["doc_id", "raw", "n_bytes", "fp", "text_sha256"],
        )


#: What gives the marks of texts; tests put one here whose fingerprints collide.
_MARK = _mark


def _chunks(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = []
            for fp, text in zip(batch.column("fp").to_pylist(), map(squeeze, as_bytes(batch.column("text"))), strict=True):
                rows += [(len(text), fp, n // size, text[n : n + size]) for n in range(0, max(len(text), 1), size)]
            columns = zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=["n_bytes", "fp", "chunk", "part"])

    return run


def _grouped(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """(doc_id, raw, text_sha256, n, least), a row for each row of ``docs`` (doc_id, text); ``raw`` is a hash of the text
    as it is, ``n`` and ``least`` are null for a text that occurs once."""
    docs = restrict(docs, "doc_id", "text").withColumn("raw", F.xxhash64("text"))
    marks = cut(docs.mapInArrow(_MARK, _MARKS))
    group, counts = ["n_bytes", "fp"], (F.count("*").alias("n"), F.min("doc_id").alias("least"))
    rows = marks.count()
    groups = cut(narrow(marks.groupBy(*group).agg(*counts).where("n > 1"), rows))
    release(docs.sparkSession)
    # a shared fingerprint is only a claim: the texts themselves are compared, chunk by chunk
    whose = marks.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), "raw", *group).distinct().join(groups, group)
    texts = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), "raw", "text").join(whose, ["_id", "raw"]).select("fp", "text")
    chunks = texts.mapInArrow(_chunks(chunk_bytes), "n_bytes long, fp long, chunk long, part binary")
    differ = cut(chunks.groupBy(*group, "chunk").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select(*group).distinct())
    release(docs.sparkSession)
    if not differ.isEmpty():
        # where texts differ under one fingerprint the digest of the whole text decides
        flagged = marks.join(differ.withColumn("split", F.lit(True)), group, "left")
        marks = cut(flagged.withColumn("split", F.when(F.col("split"), F.col("text_sha256")).otherwise(F.lit(""))))
        group = [*group, "split"]
        groups = cut(narrow(marks.groupBy(*group).agg(*counts).where("n > 1"), rows))
    return marks.join(groups, group, "left").select("doc_id", "raw", "text_sha256", "n", "least")


def exact_groups(docs: DataFrame, chunk_bytes: int = 1 << 16) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for each row of ``docs`` (doc_id, text)."""
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return _grouped(docs, chunk_bytes).select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay; of rows with the same id and equal texts one stays.

    Texts meet the ids to keep in one exchange, by id and a hash of the text.
    """
    every = _grouped(docs, 1 << 16).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), F.col("raw").alias("_raw"), "text_sha256", "n", F.coalesce("least", F.lit(NO_ID)).alias("least"))
    several = every.where("n is not null and _id = least").groupBy("text_sha256").agg(F.min(F.struct("_id", "_raw")).alias("row")).select("row.*")
    kept = every.where("n is null").select("_id", "_raw").unionByName(several)
    kept = cut(narrow(kept, docs.count()))
    release(docs.sparkSession)
    rows = docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn("_raw", F.xxhash64("text"))
    return rows.join(kept, ["_id", "_raw"], "left_semi").dropDuplicates(["_id", "_raw"]).select(*docs.columns)


ORACLE = r"""
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
WINDOW w AS (PARTITION BY norm)
"""

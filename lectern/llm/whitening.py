"""Whitening of embeddings by a compensated covariance.

Entries become integers x; sums by place are exact. Centred rows are pairs of doubles (high and low part). Their outer
products are summed without rounding: each centred entry is split into slices of so few bits that a matrix product of two
slices over a block of rows is exact in doubles whatever the order of its terms (an error-free transformation), and
these products are added into a double-double accumulator with two-sums. A task gives one row of high and low parts;
such rows are merged, high and low, in rounds of ``MERGED`` tasks, so that the driver sees at most ``MERGED`` of them. The
eigenvectors come from LAPACK's symmetric solver ``syevd`` (reduction to tridiagonal form, then divide and conquer) on the
one matrix of the vector length, which does not grow with the rows.

Defined results: rows whose vector is null or empty, or holds a null or an entry that is not finite, are dropped, and so
are vectors of another length than the commonest (of ties the longer). A null vec_id stays null; repeated rows each
count and are each returned; extra columns are ignored. Only components whose eigenvalue is above 1e-12 of the trace can
be whitened and are returned, so a table of one or of equal vectors gives no rows, like an empty one. A deviation
that does not fit a long is null. Integers beyond 2^28 count as 2^28.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import cut, restrict, shared_dir
from lectern.llm.vectors import integers, of_length, totals

SCALE, SHIFT = 1024, 100_000
#: Rows of a block: products of two slices of 21 bits, summed over so many rows, are exact in 53 bits.
BLOCK = 1024
#: Slices of an entry, and bits of each but for the sign.
SLICES, BITS = 4, 20
#: Rows of high and low parts merged by one task, and seen by the driver at most.
MERGED = 32

OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
Pair = tuple[np.ndarray, np.ndarray]


def two_sum(a: np.ndarray, b: np.ndarray) -> Pair:
    """a + b as rounded and what rounding took, exactly."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def add(a: Pair, b: Pair) -> Pair:
    """The sum of two double-doubles."""
    high, low = two_sum(a[0], b[0])
    more, rest = two_sum(a[1], b[1])
    high, low = two_sum(high, low + more)
    return two_sum(high, low + rest)


def split(high: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
    """Slices of high + low, each a multiple of its unit of at most 2^BITS units; what is beyond the last is below 2^-83 of the largest."""
    most = float(np.abs(high).max(initial=0.0))
    if most == 0.0:
        return []
    unit, rest, out = 2.0 ** (np.frexp(most)[1] - BITS), high, []
    for k in range(SLICES):
        q = np.rint(rest / unit) * unit
        out.append(q)
        rest = rest - q
        if k == 1:
            rest = rest + low
        unit *= 2.0 ** -(BITS + 1)
    return out


def outer(high: np.ndarray, low: np.ndarray) -> Pair:
    """The sum of the outer products of the rows of high + low as double-doubles."""
    size = high.shape[1]
    held = (np.zeros((size, size)), np.zeros((size, size)))
    nothing = np.zeros((size, size))
    for at in range(0, len(high), BLOCK):
        parts = split(high[at : at + BLOCK], low[at : at + BLOCK])
        for i in range(len(parts)):
            for j in range(i, len(parts) - i):
                product = parts[i].T @ parts[j]
                held = add(held, (product, nothing))
                if i != j:
                    held = add(held, (product.T, nothing))
    return held


def centred(x: np.ndarray, sums: np.ndarray, n: int) -> Pair:
    """x - sums / n as double-doubles: less the nearest integer first, which is exact, then less the fraction that is left."""
    whole = (2 * sums + n) // (2 * n)
    rest = sums - whole * n
    part = rest / n
    # what the division left: rest - part * n, with the product split so that nothing is lost
    left = np.array([float(r - p * n) for r, p in zip(map(int, rest), map(_fraction, part), strict=True)]) / n
    high, low = two_sum((x - whole).astype(np.float64), -part)
    return two_sum(high, low - left)


def _fraction(value: float):
    from fractions import Fraction

    return Fraction(float(value))


def _merge(rows: list[tuple[list[float], list[float]]]) -> Pair:
    held = (np.array(rows[0][0]), np.array(rows[0][1]))
    for high, low in rows[1:]:
        held = add(held, (np.array(high), np.array(low)))
    return held


_PARTS = "part int, high array<double>, low array<double>"


def _row(part: int, held: Pair) -> pa.RecordBatch:
    kind = pa.list_(pa.float64())
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([held[0].ravel().tolist()], kind), pa.array([held[1].ravel().tolist()], kind)], names=["part", "high", "low"])


def scatter(df: DataFrame, rows: Callable[[pa.RecordBatch], Pair], size: int) -> np.ndarray:
    """The sum of the outer products of all rows, rounded to doubles; ``rows`` gives the high and low parts of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            high, low = rows(batch)
            if len(high):
                more = outer(high, low)
                held = more if held is None else add(held, more)
        if held is not None:
            yield _row(TaskContext.get().partitionId(), held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((row["part"], row["high"], row["low"]) for batch in batches for row in batch.to_pylist())
        if found:
            yield _row(found[0][0], _merge([x[1:] for x in found]))

    parts = cut(df.mapInArrow(run, _PARTS))
    tasks = parts.rdd.getNumPartitions()
    while tasks > MERGED:
        tasks = -(-tasks // MERGED)
        parts = cut(parts.coalesce(tasks).mapInArrow(merge, _PARTS))
    found = sorted((r["part"], r["high"], r["low"]) for r in parts.collect())
    if not found:
        return np.zeros((size, size))
    high, low = _merge([x[1:] for x in found])
    return (high + low).reshape(size, size)


def eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, each with its largest entry positive."""
    values, found = np.linalg.eigh(matrix)
    values, found = values[::-1], found[:, ::-1]
    return values, found * np.sign(found[np.abs(found).argmax(axis=0), np.arange(len(values))])


def whiten(vectors: DataFrame, top: int = 8) -> DataFrame:
    """Vectors (vec_id, embedding) projected on up to ``top`` whitened components: see OUT for the columns."""
    spark = vectors.sparkSession
    vectors = restrict(vectors, "vec_id", "embedding")
    size, n, total = totals(vectors, SCALE, SHIFT)
    if not n:
        return spark.createDataFrame([], OUT)
    sums = np.array(total, dtype=np.int64)
    only = vectors.select("embedding")

    def rows(batch: pa.RecordBatch) -> Pair:
        return centred(integers(of_length(batch.column("embedding"), size)[1], SCALE, SHIFT), sums, n)

    matrix = scatter(only, rows, size) / n
    values, found = eigen(matrix)
    trace = float(np.trace(matrix))
    k = int((values[:top] > 1e-12 * trace).sum())
    if not k:
        return spark.createDataFrame([], OUT)
    turn = found[:, :k] / np.sqrt(values[:k])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = of_length(batch.column("embedding"), size)
            x = integers(found, SCALE, SHIFT)
            high, low = centred(x, sums, n)
            away = n * x - sums
            # in 64 bits the sum is exact modulo 2^64, so it is exact wherever its estimate is well inside
            fits = (((x - sums / n) * n) ** 2).sum(axis=1) < 9.2e18
            deviation = (away * away).sum(axis=1)
            w = high @ turn + low @ turn
            kind = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * k, pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(at)).cast(pa.int64()), pa.array(deviation, pa.int64(), mask=~fits), kind], names=["vec_id", "deviation", "w"])

    home = f"{shared_dir(spark).rstrip('/')}/whitened-{uuid.uuid4().hex}"
    vectors.mapInArrow(project, "vec_id long, deviation long, w array<double>").write.parquet(home)
    done = spark.read.parquet(home)
    middle = np.array(done.agg(*(F.avg(F.col("w")[i]) for i in range(k))).first())

    def white(batch: pa.RecordBatch) -> Pair:
        w = batch.column("w").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
        return two_sum(w, -middle[None, :])

    error = float(np.abs(scatter(done.select("w"), white, k) / n - np.eye(k)).max())
    share = F.array(*(F.lit(float(v) / trace) for v in values[:k]))
    return done.select("vec_id", "deviation", F.posexplode("w").alias("place", "whitened")).select(
        "vec_id", (F.col("place") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        share[F.col("place")].alias("explained"), F.lit(error).alias("identity_error"),
    )

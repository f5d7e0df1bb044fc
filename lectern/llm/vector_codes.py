"""Codes of vectors: parts of a vector by the nearest entry of a codebook, found by VA-file filtering.

Entries become integers, vectors are cut into equal parts, and each part's place has a codebook of its own that rounds of
k-means fit on all rows. The nearest entry is found by a vector-approximation file: every coordinate of the entries
is quantised to a cell of 2^BITS. For each part a lookup table holds, by coordinate and cell, the least and the greatest
squared distance to that cell; their sums over an entry's cells bound its distance from below and above. Entries whose
lower bound is above the least upper bound are out; the others are compared by exact integer distances. A round
sends sums and counts of each entry from each task, which Spark adds up; only the codebooks reach the driver.

Defined results: rows whose vector is null or empty, or holds a null or an entry that is not finite, are dropped, and so
are vectors of another length than the commonest (of ties the longer). A length that cannot be cut equally gives its
first parts one entry more. Null vec_ids come last among those that begin a codebook, repeated ids are ordered by their
integers; with fewer rows than entries there are as many entries as rows. Repeated rows are each returned; an empty
table gives no rows; extra columns are ignored. Integers beyond 2^28 count as 2^28.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import restrict, shared_dir
from lectern.llm.vectors import integers, of_length, totals

SCALE = 4096
#: Bits of a cell of the approximation.
BITS = 4
#: Rows assigned at a time within a task.
BLOCK = 2048
#: Labels up to which their sums are sent to every task; beyond it rows and sums meet by a salted join.
LABELS = 10_000
SALTS = 32

OUT = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
Codebooks = list[np.ndarray]


class Cells:
    """A codebook's entries as cells, and the nearest entry of parts by their bounds."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        low, high = entries.min(axis=0), entries.max(axis=0)
        # cells of equal whole width from the least entry on
        self.width = (high - low) // (1 << BITS) + 1
        self.cell = (entries - low) // self.width
        edges = low + np.arange(1 << BITS)[:, None] * self.width
        self.first, self.last = edges, edges + self.width - 1

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of each row; of ties the lower index."""
        near = np.zeros(len(parts), dtype=np.int64)
        far = np.zeros(len(parts), dtype=np.int64)
        for at in range(0, len(parts), BLOCK):
            near[at : at + BLOCK], far[at : at + BLOCK] = self._block(parts[at : at + BLOCK])
        return near, far

    def bounds(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) bounds of each row's squared distance to each entry, from the lookup tables."""
        lower = np.zeros((len(parts), len(self.entries)), dtype=np.int64)
        upper = np.zeros_like(lower)
        for j in range(parts.shape[1]):
            a, b = self.first[:, j] - parts[:, j, None], parts[:, j, None] - self.last[:, j]
            least = np.maximum(np.maximum(a, b), 0) ** 2
            most = np.maximum(np.abs(a), np.abs(b)) ** 2
            lower += least[:, self.cell[:, j]]
            upper += most[:, self.cell[:, j]]
        return lower, upper

    def _block(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lower, upper = self.bounds(parts)
        row, entry = np.nonzero(lower <= upper.min(axis=1, keepdims=True))
        off = parts[row] - self.entries[entry]
        exact = np.full(lower.shape, np.iinfo(np.int64).max)
        exact[row, entry] = (off * off).sum(axis=1)
        near = exact.argmin(axis=1)
        return near, exact[np.arange(len(parts)), near]


def cuts(size: int, parts: int) -> list[slice]:
    """Where a vector of ``size`` entries is cut into ``parts``."""
    edges = np.cumsum([0] + [len(x) for x in np.array_split(np.arange(size), parts)]).tolist()
    return [slice(a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a]


def first_entries(vectors: DataFrame, size: int, entries: int) -> np.ndarray:
    """The integers of the kept rows with the smallest vec_ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = of_length(batch.column("embedding"), size)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(at)).cast(pa.int64()), pa.array(integers(found, SCALE).tolist(), pa.list_(pa.int64()))], names=["vec_id", "x"])

    kept = vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id long, x array<long>")
    return np.array([r["x"] for r in kept.orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).collect()], dtype=np.int64)


def refit(vectors: DataFrame, books: Codebooks, where: list[slice], size: int) -> Codebooks:
    """The codebooks after one round: each entry the floor of the mean of the parts assigned to it, unused ones as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(b) for b in books]
        count = [np.zeros(len(b), dtype=np.int64) for b in books]
        sums = [np.zeros_like(b) for b in books]
        for batch in batches:
            x = integers(of_length(batch.column("embedding"), size)[1], SCALE)
            for p, cell in enumerate(cells):
                near = cell.nearest(x[:, where[p]])[0]
                count[p] += np.bincount(near, minlength=len(count[p]))
                np.add.at(sums[p], near, x[:, where[p]])
        used = [(p, e) for p in range(len(books)) for e in np.flatnonzero(count[p]).tolist()]
        if used:
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p, _ in used], pa.int32()), pa.array([e for _, e in used], pa.int32()), pa.array([int(count[p][e]) for p, e in used], pa.int64()), pa.array([sums[p][e].tolist() for p, e in used], pa.list_(pa.int64()))],
                names=["part", "entry", "n", "sums"],
            )

    met = vectors.select("embedding").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    added = met.select("part", "entry", "n", F.posexplode("sums").alias("place", "s")).groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    out = [b.copy() for b in books]
    for r in added.collect():
        out[r["part"]][r["entry"], r["place"]] = r["s"] // r["n"]
    return out


def digest(books: Codebooks) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def encode(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> DataFrame:
    """Codes and errors of vectors (vec_id, embedding, label): see OUT for the columns."""
    spark = vectors.sparkSession
    vectors = restrict(vectors, "vec_id", "embedding", "label")
    size, n, _ = totals(vectors, SCALE)
    if not n:
        return spark.createDataFrame([], OUT)
    where = cuts(size, parts)
    start = first_entries(vectors, size, entries)
    books = [start[:, w].copy() for w in where]
    for _ in range(rounds):
        books = refit(vectors, books, where, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(b) for b in books]
        for batch in batches:
            at, found = of_length(batch.column("embedding"), size)
            x = integers(found, SCALE)
            met = [c.nearest(x[:, w]) for c, w in zip(cells, where, strict=True)]
            codes = np.column_stack([near for near, _ in met]).astype(np.uint8)
            error = np.sum([far for _, far in met], axis=0).astype(np.int64)
            rows = pa.array(at)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(rows).cast(pa.int64()), batch.column("label").take(rows), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    kind = vectors.schema["label"].dataType.simpleString()
    home = f"{shared_dir(spark).rstrip('/')}/codes-{uuid.uuid4().hex}"
    vectors.mapInArrow(run, f"vec_id long, label {kind}, code string, error long").write.parquet(home)
    coded = spark.read.parquet(home)
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    if coded.select("label").distinct().limit(LABELS + 1).count() <= LABELS:
        out = coded.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("of")))
    else:
        salted = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)))
        spread = sums.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = salted.join(spread, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("turn")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def oracle(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The same rows by SQL: every part against every entry, with the rounds written out one after another."""
    steps = [
        "k AS (SELECT vec_id, label, list_transform(embedding, lambda e: CAST(floor(4096 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)",
        f"v AS (SELECT vec_id, label, p, x[p * (len(x) // {parts}) + 1:(p + 1) * (len(x) // {parts})] AS x FROM k, range({parts}) r(p))",
        f"b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM v WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT {entries}))",
    ]
    near = "SELECT v.vec_id, v.label, v.p, v.x, min(ROW(CAST(list_sum(list_transform(list_zip(v.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), b.e)) AS m FROM v JOIN b{n} b USING (p) GROUP BY ALL"
    for n in range(rounds):
        steps += [
            f"n{n} AS ({near.format(n=n)})",
            f"s{n} AS (SELECT p, m[2] AS e, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS y FROM n{n}, range(1, (SELECT len(c) + 1 FROM b0 LIMIT 1)) r(i) GROUP BY ALL)",
            f"c{n} AS (SELECT p, e, list(y ORDER BY i) AS c FROM s{n} GROUP BY ALL)",
            f"b{n + 1} AS (SELECT b.p, b.e, coalesce(c.c, b.c) AS c FROM b{n} b LEFT JOIN c{n} c ON c.p = b.p AND c.e = b.e)",
        ]
    steps += [
        f"last AS ({near.format(n=rounds)})",
        "o AS (SELECT vec_id, label, string_agg(printf('%02x', m[2]), '' ORDER BY p) AS code, CAST(sum(m[1]) AS BIGINT) AS error FROM last GROUP BY ALL)",
        f"h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})",
    ]
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM o, h"

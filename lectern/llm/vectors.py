"""Vectors in Arrow batches, shared by the operators on embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Integers of vectors are held within this bound, so that squared distances and sums of them stay exact in 64 bits.
BOUND = float(1 << 28)


def integers(values: np.ndarray, scale: int, shift: int = 0) -> np.ndarray:
    """floor(scale * value) + shift of each entry, as 64-bit integers; beyond ``BOUND`` the bound itself."""
    return np.clip(np.floor(scale * values), -BOUND, BOUND).astype(np.int64) + shift


def groups(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, matrix) for each length of vector in a list column.

    Null vectors, empty ones and those that hold a null or an entry that is not finite are left out.
    """
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        found = flat[starts[rows][:, None] + np.arange(size)]
        fine = np.isfinite(found).all(axis=1)
        if fine.any():
            yield size, rows[fine], found[fine]


def of_length(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, matrix) of the vectors with ``size`` entries that are kept."""
    for n, rows, found in groups(column):
        if n == size:
            return rows, found
    return np.zeros(0, dtype=np.int64), np.zeros((0, size))


def totals(vectors: DataFrame, scale: int, shift: int = 0) -> tuple[int, int, list[int]]:
    """(length, n, sums): the commonest length of kept vectors (of ties the longer), their number, and the sum of their integers by place.

    One pass; each task gives a row for each length it met, and these rows are summed by Spark. (0, 0, []) without any.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for size, rows, found in groups(batch.column("embedding")):
                n, s = held.get(size, (0, np.zeros(size, dtype=np.int64)))
                held[size] = n + len(rows), s + integers(found, scale, shift).sum(axis=0)
        if held:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.int32()), pa.array([n for n, _ in held.values()], pa.int64()), pa.array([s.tolist() for _, s in held.values()], pa.list_(pa.int64()))], names=["size", "n", "sums"]
            )

    parts = vectors.select("embedding").mapInArrow(run, "size int, n long, sums array<long>")
    placed = parts.select("size", "n", F.posexplode("sums").alias("place", "s")).groupBy("size", "place").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    # of each length its sums in order: as many rows as there are lengths, and only the commonest is fetched
    whole = placed.groupBy("size").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("place", "s"))).alias("sums"))
    first = whole.orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    return (first[0]["size"], first[0]["n"], [x["s"] for x in first[0]["sums"]]) if first else (0, 0, [])

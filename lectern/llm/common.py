"""Helpers shared by the training-data operators of this subpackage.

Everything here is independent of the size of the input: lineage is cut in the
folder that the session names in ``spark.checkpoint.dir`` and nothing is
collected but a few scalars.
"""

from __future__ import annotations

import gc
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources.files import small_batches

#: The white space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
WS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
_EDGE = frozenset(b" \t\n\x0b\x0c\r")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by the driver and the executors.

    Without one named, a temporary folder serves where driver and executors are one process; on a cluster that is an
    error, since executors would not see each other's files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='lectern-')}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


#: The setting that lets Spark's cleaner remove the files of checkpoints that nothing refers to any more.
CLEANS = "spark.cleaner.referenceTracking.cleanCheckpoints"


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder; survives the loss of any executor.

    Spark by default never removes the files of a checkpoint. It looks at the setting for that when it writes one, so
    it is turned on here unless the application has set it.
    """
    shared_dir(df.sparkSession)
    df.sparkSession.sparkContext._jsc.sc().conf().setIfMissing(CLEANS, "true")
    return df.checkpoint(eager=True)


#: Rows of a narrow table (a few numbers each) that are written as one file, and files at least.
FILE_ROWS, FILES = 250_000, 16


def narrow(df: DataFrame, rows: int) -> DataFrame:
    """``df``, a narrow table of about ``rows`` rows, in as many partitions as that needs instead of one for each partition of a shuffle.

    Loops write such tables again and again; thousands of files of a few rows cost more than what is in them.
    """
    return df.coalesce(max(FILES, -(-rows // FILE_ROWS)))


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that an operator wrote and that no one will read again."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files and checkpoints of steps that nothing refers to any more.

    Spark notices that only when the collectors of both sides run, and the driver's heap may be far from full while the
    disks of the executors are not. So this asks both for a collection, which takes a fraction of a second.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fold_of(doc_id: str | Column = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id falls in fold 0."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % folds, F.lit(0))


def text_bytes(spark_df: DataFrame, column: str = "text") -> int:
    """Bytes of a text column over the whole table; one narrow aggregate."""
    return int(spark_df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0])


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` holds about ``limit`` bytes in each; rows are never split."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.array([0 if n is None else n for n in pc.binary_length(batch.column(column)).to_pylist()], dtype=np.int64)
        block = np.cumsum(sizes) // limit
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        for lo, hi in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            yield batch.slice(int(lo), int(hi - lo))


def as_bytes(column: pa.Array) -> list[bytes]:
    """Values of a string column in UTF-8; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def squeeze(data: bytes) -> bytes:
    """Each run of white space as one space; runs at the ends stay as one space too."""
    body = b" ".join(data.split())
    if not body:
        return b" " if data else b""
    return (b" " if data[0] in _EDGE else b"") + body + (b" " if data[-1] in _EDGE else b"")


def tokens(data: bytes) -> list[bytes]:
    """Words between white space with A-Z in lower case."""
    return data.lower().split()


def restrict(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns with clashing names never reach an operator."""
    return df.select(*names)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected ``edges``: (node, component), component the smallest node reachable.

    Each round takes the least label of the neighbours and then jumps along labels, so that rounds grow with
    the logarithm of the diameter. Labels are written to the shared folder after each round; only whether
    a label changed reaches the driver. Rows with a null end and self links are ignored. No aggregate stands on a
    join by node or label, so that adaptive execution can split the rows of a hub.
    """
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null and x <> y")
    both = cut(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    rows = both.count()
    label = cut(narrow(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("component")), rows))
    while True:
        near = both.join(label.withColumnRenamed("node", "y"), "y").groupBy("x").agg(F.min("component").alias("m"))
        step = label.join(near.withColumnRenamed("x", "node"), "node", "left").select("node", F.least("component", "m").alias("component"), F.col("component").alias("old"))
        step = cut(narrow(step, rows))
        far = step.select(F.col("node").alias("component"), F.col("component").alias("root"))
        jumped = cut(narrow(step.join(far, "component", "left").select("node", F.least("component", F.coalesce("root", "component")).alias("component"), "old"), rows))
        changed = jumped.where("component <> old").limit(1).count()
        label = jumped.select("node", "component")
        del near, step, far, jumped
        release(edges.sparkSession)
        if not changed:
            return label

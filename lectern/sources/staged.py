"""A sink that shows a batch of several tables as a whole or not at all.

Each batch is written beside what is there, and a row in the table of commits makes it visible. What a failed batch has
written is never named in a commit, so readers never see a part of it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_batch(spark: SparkSession, folder: str, tables: dict[str, Callable[[], DataFrame] | DataFrame]) -> str:
    """Writes all tables of a batch, then commits; any failure before leaves the batch out and is raised."""
    batch = uuid.uuid4().hex
    for name, made in tables.items():
        (made() if callable(made) else made).write.parquet(f"{folder}/{name}/batch={batch}")
    names = F.array(*[F.lit(x) for x in tables])
    spark.range(1).select(F.lit(batch).alias("batch"), F.explode(names).alias("name"), F.current_timestamp().alias("at")).coalesce(1).write.mode("append").parquet(f"{folder}/_commits")
    return batch


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The rows of a table in all committed batches; batches are partitions, so others are not read."""
    done = [r["batch"] for r in spark.read.parquet(f"{folder}/_commits").where(F.col("name") == name).select("batch").distinct().collect()]
    if not done:
        raise ValueError(f"no batch of {name} has been committed")
    return spark.read.option("basePath", f"{folder}/{name}").parquet(*[f"{folder}/{name}/batch={b}" for b in done])

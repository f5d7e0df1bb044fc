"""Incremental ingestion: what changed, what is new, what is gone; batches that resume from a checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def classify(stored: DataFrame, listed: DataFrame, key: str, check: str = "check") -> DataFrame:
    """(key, step): gone, new, same or changed, by the checksums on both sides."""
    a, b = stored.select(key, F.col(check).alias("_a")), listed.select(key, F.col(check).alias("_b"))
    step = F.when(F.col("_b").isNull(), "gone").when(F.col("_a").isNull(), "new").when(F.col("_a") == F.col("_b"), "same").otherwise("changed")
    return a.join(b, key, "full").select(key, step.alias("step"))


def apply_changes(stored: DataFrame, listed: DataFrame, key: str, least: int = 25, share: float = 0.1) -> DataFrame:
    """The stored rows after a crawl: changed and new ones replaced, vanished ones gone unless suspiciously many are."""
    from lectern.operators.state import prune

    gone = prune(stored.select(key), listed.select(key), [key], least, share)
    return stored.join(listed.select(key), key, "left_anti").join(gone, key, "left_anti").unionByName(listed, allowMissingColumns=True)


def resume(spark: SparkSession, source: str, schema: str, checkpoint: str, put: Callable[[DataFrame, int], None]) -> None:
    """Feeds files of a folder that were not seen yet to ``put`` and stops; a run that is cut off goes on from there."""
    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

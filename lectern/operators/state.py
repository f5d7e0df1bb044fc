"""Keyed state: merges, guarded deletes, rate limits, tokens, caches with an age. State is a table that is replaced."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def prune(stored: DataFrame, listed: DataFrame, keys: list[str], least: int = 25, share: float = 0.1) -> DataFrame:
    """Stored keys that are no longer listed; none at all when more than ``least`` and ``share`` of them would go."""
    gone = stored.join(listed, keys, "left_anti")
    count = gone.agg(F.count("*").alias("_gone")).crossJoin(stored.agg(F.count("*").alias("_all")))
    return gone.crossJoin(F.broadcast(count)).where(F.col("_gone") <= F.greatest(F.lit(float(least)), F.col("_all") * share)).drop("_gone", "_all")  # one row


def latest(rows: DataFrame, keys: list[str], stamp: list[str]) -> DataFrame:
    """The newest row of each key; partial maxima are taken before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*stamp)).alias("_r")).select(*keys, "_r.*")


def upsert_newer(stored: DataFrame, new: DataFrame, keys: list[str], stamp: str) -> DataFrame:
    """Stored rows with newer ones in place: a row only changes if the new stamp is greater."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    ranked = both.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in stored.columns if c not in keys]), F.struct(F.col(stamp), -F.col("_new"))).alias("_r"))
    return ranked.select(*keys, "_r.*")


def tombstones(stored: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Deletes win over clocks: the stamp becomes the greater of the delete's and one past the stored one."""
    d = deleted.groupBy(key).agg(F.max("deleted_at").alias("_d"))
    j = stored.join(d, key, "left")
    stamp = F.when(F.col("_d").isNull(), F.col("updated_at")).otherwise(F.greatest(F.col("_d"), F.col("updated_at") + 1))
    return j.select(key, stamp.alias("updated_at"), F.when(F.col("_d").isNull(), F.col("data")).alias("data"))


def rate_limited(hits: DataFrame, limit: int, window_ms: int) -> DataFrame:
    """(key, ms, id, count, allowed) of hits (key, ms, id): a window starts at the first hit after the last one ended.

    Windows depend on the hits before them, so each key is walked once; keys are spread, a key's hits are sorted.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = start = None
        n = 0
        for frame in batches:
            counts = []
            for k, ms in zip(frame["key"], frame["ms"], strict=True):
                if k != key or start <= ms - window_ms:
                    key, start, n = k, ms, 0
                n += 1
                counts.append(n)
            yield frame.assign(count=counts, allowed=[c <= limit for c in counts])

    return hits.select("key", "ms", "id").repartition("key").sortWithinPartitions("key", "ms", "id").mapInPandas(walk, "key long, ms long, id long, count long, allowed boolean")


def first_use(uses: DataFrame, token: str, order: list[str]) -> DataFrame:
    """The one use of each token that counts."""
    return uses.groupBy(token).agg(F.min(F.struct(*order)).alias("_u")).select(token, "_u.*")


def fresh(rows: DataFrame, stamp: str, now, age: str) -> DataFrame:
    """Rows no older than ``age``."""
    return rows.where(F.col(stamp) >= F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {age}"))

"""Order as data: running numbers over all rows, gaps between placed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.sources.files import work_folder


def running_number(rows: DataFrame, order: list[str], name: str, partitions: int | None = None) -> DataFrame:
    """``rows`` numbered from 1 in ``order``: ranges are numbered within, then moved by the rows before them.

    Ranges are cut by all columns of the order, of any type, and written once with their number, so that no later step can
    cut them elsewhere. One row for each range is summed along; no task sees all rows. The order must name every row.
    """
    spark = rows.sparkSession
    n = partitions or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    home = work_folder(spark)
    rows.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()).write.parquet(home)
    dealt = spark.read.parquet(home)
    size = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = size.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("_own", own).join(F.broadcast(before), "_range").withColumn(name, F.col("_own") + F.col("_before")).drop("_range", "_own", "_before")


def neighbours_in_order(rows: DataFrame, order: list[str], value: str) -> DataFrame:
    """``rows`` with the ``value`` of the row before and after each in ``order``, by their running numbers."""
    numbered = running_number(rows, order, "_seq")
    near = lambda step, name: numbered.select((F.col("_seq") + step).alias("_seq"), F.col(value).alias(name))
    return numbered.join(near(1, "before"), "_seq", "left").join(near(-1, "after"), "_seq", "left").drop("_seq")


def fill_gaps(rows: DataFrame, key: str, order: str, value: str, most: int) -> DataFrame:
    """Runs of at most ``most`` rows without a value take the value before them, or after them if that is nearer."""
    w = Window.partitionBy(key).orderBy(order)
    back, fore = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    n = rows.withColumn("_i", F.row_number().over(w))
    at = F.when(F.col(value).isNotNull(), F.col("_i"))
    n = n.withColumn("_p", F.last(at, True).over(back)).withColumn("_q", F.first(at, True).over(fore)).withColumn("_before", F.last(value, True).over(back)).withColumn("_after", F.first(value, True).over(fore))
    short = (F.col("_q") - F.col("_p") - 1) <= most
    near = F.when(F.col("_i") - F.col("_p") <= F.col("_q") - F.col("_i"), F.col("_before")).otherwise(F.col("_after"))
    return n.select(key, order, F.coalesce(F.col(value), F.when(short, near)).alias(value), F.col(value).isNull().alias("guessed"))

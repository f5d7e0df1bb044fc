"""Sources and sinks beside Parquet: CSV, JSON lines, XML sitemaps, calendar text."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that go to a Python worker at once, at most. Rows hold whole texts, and the default of 10,000 rows
#: takes tens of MB several times over, on both sides.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session by what a batch of whole texts takes, unless it is bounded tighter.

    The two settings stay as they are set: Spark reads them when a query runs, long after an operator has returned.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        held = re.fullmatch(r"(\d+)b?", spark.conf.get(key, None) or "")
        if held is None or int(held[1]) > most or int(held[1]) <= 0:
            spark.conf.set(key, str(most))


def work_folder(spark: SparkSession) -> str:
    """A new folder in the one that the session shares with its executors."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.gettempdir()}/lectern"  # one process: its own folder is shared
    return f"{named.rstrip('/')}/files-{uuid.uuid4().hex}"


def parts_for(spark: SparkSession, rows: int, most: int) -> int:
    """Into how many parts rows are dealt so that a task sorts or groups ``most`` of them or fewer: as many as a shuffle has, or more."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // most))


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """Link files: a header, five columns at least; rows that are short are dropped."""
    schema = "a string, b string, kind string, a_title string, b_title string"
    return spark.read.csv(path, header=True, schema=schema, mode="DROPMALFORMED").where("b_title is not null")


def read_editions(spark: SparkSession, path: str) -> DataFrame:
    """Edition files, one JSON object each, with the text kept as JSON of any depth."""
    return spark.read.text(path, wholetext=True).select(F.get_json_object("value", "$.title").alias("title"), F.get_json_object("value", "$.text").alias("body"))


def read_sitemap(spark: SparkSession, path: str) -> DataFrame:
    """Addresses of a sitemap."""
    return spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string").load(path)


def calendar_line(text: Column) -> Column:
    """A content line of a calendar file, folded after 73 characters."""
    return F.regexp_replace(text, "(.{73})(?=.)", "$1\r\n ")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def publish(df: DataFrame, path: str) -> None:
    """A whole new copy beside the old one; readers switch by the name they are given."""
    df.write.mode("errorifexists").parquet(path)


def round_trips(spark: SparkSession, one: DataFrame, two: DataFrame) -> DataFrame:
    """(kind, n) of two tables after a way through JSON lines and CSV."""
    home = work_folder(spark)
    write_json(one, f"{home}/json")
    two.select("a", "b", "kind", F.col("a").alias("a_title"), F.col("b").alias("b_title")).write.csv(f"{home}/csv", header=True)
    a = spark.read.schema(one.schema).json(f"{home}/json").agg(F.count("*").alias("n")).select(F.lit("json").alias("kind"), "n")
    b = read_links(spark, f"{home}/csv").agg(F.count("*").alias("n")).select(F.lit("csv").alias("kind"), "n")
    return a.unionByName(b)

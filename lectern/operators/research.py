"""Pages that a piece of research relied on, from its citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as X

#: A shorter citation says too little to be kept.
LEAST = 12


def cited_pages(cited: DataFrame, sites: DataFrame, most: int, chars: int) -> DataFrame:
    """(run, n, key, title, site, excerpt) from citations (run, at, url, title, cited) and trusted ``sites`` (host, site).

    Citations of one page, however its address is written, are one row: the first title that is not empty and its
    distinct sentences in the order in which they were cited. Only pages of trusted sites stay, the first ``most`` of a run.
    """
    tidy = F.trim(F.regexp_replace("cited", r"\s+", " "))
    c = cited.withColumn("cited", tidy).where((F.length("cited") >= LEAST) & F.col("url").isNotNull()).withColumn("key", X.page_key(F.col("url")))
    # a sentence cited again stays where it was first
    each = c.groupBy("run", "key", "cited").agg(F.min("at").alias("at"), F.min(F.when(F.coalesce("title", F.lit("")) != "", F.struct("at", "title"))).alias("t"), F.min(F.struct("at", "url")).alias("u"))
    page = each.groupBy("run", "key").agg(F.min("at").alias("at"), F.min("t")["title"].alias("title"), F.min("u")["url"].alias("url"), F.sort_array(F.collect_list(F.struct("at", "cited"))).alias("said"))
    page = page.join(sites, X.host_of(F.col("url")) == F.col("host"))
    n = F.row_number().over(Window.partitionBy("run").orderBy("at", "key"))
    excerpt = F.substring(F.array_join(F.col("said.cited"), " … "), 1, chars)
    return page.withColumn("n", n).where(F.col("n") <= most).select("run", "n", "key", F.coalesce("title", "host").alias("title"), "site", excerpt.alias("excerpt"))

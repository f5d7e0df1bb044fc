"""The supplied tables seen as a reference-addressed library, in DataFrame and in SQL form.

Documents are passages: the source is the title, hundreds of ids are sections, ids the lines in them. Conversations
are passages too, one section for each conversation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.registry import Tables

PASSAGES = "(SELECT doc_id AS id, source || ' ' || (doc_id // 100) || ':' || (doc_id % 100) AS ref, source AS title, lang, doc_id AS seq, text FROM documents)"
TALKS = "(SELECT conv_id * 1000 + turn AS seq, 'Conv ' || conv_id || ':' || turn AS ref, conv_id, turn, role, text FROM conversations)"
EDGES = "(SELECT DISTINCT 'Order ' || (l_orderkey % 500) AS a, 'Part ' || (l_partkey % 700) AS b, l_returnflag AS kind FROM lineitem)"


def passages(t: Tables) -> DataFrame:
    ref = F.concat("source", F.lit(" "), F.floor(F.col("doc_id") / 100).cast("string"), F.lit(":"), (F.col("doc_id") % 100).cast("string"))
    return t("documents").select(F.col("doc_id").alias("id"), ref.alias("ref"), F.col("source").alias("title"), "lang", F.col("doc_id").alias("seq"), "text")


def talks(t: Tables) -> DataFrame:
    return t("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.concat(F.lit("Conv "), "conv_id", F.lit(":"), "turn").alias("ref"), "conv_id", "turn", "role", "text")


def edges(t: Tables) -> DataFrame:
    return t("lineitem").select(F.concat(F.lit("Order "), F.col("l_orderkey") % 500).alias("a"), F.concat(F.lit("Part "), F.col("l_partkey") % 700).alias("b"), F.col("l_returnflag").alias("kind")).distinct()

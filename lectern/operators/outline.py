"""Outlines of ordered sections, checks of catalogue rows by tables of rules, and offsets of nested places."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sections of one heading from which a category gets stages instead.
FEW = 6
PART = " / "


def first_match(text: Column, rules: Sequence[tuple[str, str]], other: str | None = None) -> Column:
    """The name of the first rule (name, pattern) whose pattern the text has."""
    out = F.lit(None).cast("string") if not rules else None
    for name, pattern in rules:
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return out.otherwise(F.lit(other)) if rules else F.coalesce(out, F.lit(other))


def outline(sections: DataFrame, categories: Sequence[tuple[str, str]], stages: dict[str, Sequence[tuple[str, str]]], other: str = "other") -> DataFrame:
    """(section, category, group_no, title, item_no) of sections (section, seq, label), a label being parts with slashes between.

    A category takes what its pattern matches first. Where all its sections stand under one heading and are more than FEW, stages gather
    them by their last part, in the stages' own order; else headings stay as they come, a heading that comes again later being a
    group of its own.
    """
    parts = F.split("label", PART)
    short, head = F.element_at(parts, -1), F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), PART)
    rows = sections.select("section", "seq", first_match(F.lower("label"), categories, other).alias("category"), F.lower(short).alias("short"), head.alias("head"))
    whole = Window.partitionBy("category")
    flat = (F.max("head").over(whole) == F.min("head").over(whole)) & (F.count("*").over(whole) > FEW)
    rows = rows.withColumn("flat", flat)
    stage, rank = F.lit(None).cast("string"), F.lit(None).cast("int")
    for name, own in stages.items():
        order = {title: n for n, (title, _) in enumerate(own)}
        title = first_match(F.col("short"), own)
        here = F.col("category") == name
        stage = F.when(here, title).otherwise(stage)
        rank = F.when(here, F.coalesce(*[F.when(title == t, F.lit(n)) for t, n in order.items()])).otherwise(rank)
    rows = rows.withColumn("stage", F.when(F.col("flat"), stage)).withColumn("rank", F.coalesce(rank, F.lit(1 << 20)))
    rows = rows.withColumn("title", F.coalesce("stage", "head"))
    along = Window.partitionBy("category").orderBy("seq", "section")
    new = F.coalesce(F.lag("title").over(along) != F.col("title"), F.lit(True)).cast("int")
    rows = rows.withColumn("new", new).withColumn("island", F.sum("new").over(along))
    # gathered groups are numbered by stage and then by their first section, islands as they come
    first = F.min(F.struct("seq", "section")).over(Window.partitionBy("category", "title"))
    rows = rows.withColumn("key", F.when(F.col("flat"), F.struct(F.col("rank").cast("long").alias("a"), first["seq"].cast("long").alias("b"), first["section"].alias("c"))).otherwise(F.struct(F.lit(0).cast("long").alias("a"), F.col("island").cast("long").alias("b"), F.lit("").alias("c"))))
    numbered = rows.withColumn("group_no", F.dense_rank().over(Window.partitionBy("category").orderBy("key")))
    item = F.row_number().over(Window.partitionBy("category", "group_no").orderBy("seq", "section"))
    return numbered.select("section", "category", "group_no", "title", item.alias("item_no"))


def failing(rows: DataFrame, key: str, rules: Sequence[tuple[str, Column]], known: Sequence[tuple[str, str, DataFrame]] = (), single: Sequence[str] = ()) -> DataFrame:
    """(key, reason), one row for each rule that a row breaks.

    rules: (reason, what must hold; null counts as broken). known: (reason, column, table of one column that must have it; null passes).
    single: columns in which no value may come twice; all rows of a repeated value break "<column> twice".
    """
    broken = F.array(*[F.when(~F.coalesce(holds, F.lit(False)), F.lit(reason)) for reason, holds in rules]) if rules else F.array().cast("array<string>")
    out = rows.select(key, F.explode(F.array_compact(broken)).alias("reason"))
    for reason, column, table in known:
        names = table.toDF("_known").distinct()
        out = out.unionByName(rows.where(F.col(column).isNotNull()).join(names, F.col(column) == F.col("_known"), "left_anti").select(key, F.lit(reason).alias("reason")))
    for column in single:
        twice = rows.groupBy(column).agg(F.count("*").alias("_n")).where(f"_n > 1 and {column} is not null").select(column)
        out = out.unionByName(rows.join(twice, column, "left_semi").select(key, F.lit(f"{column} twice").alias("reason")))
    return out

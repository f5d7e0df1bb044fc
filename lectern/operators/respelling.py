"""Known words of a text said as a lexicon has it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Runs of letters and hyphens, single apostrophes, and whatever lies between.
PIECES = r"([\p{L}-]+|'|[^\p{L}'-]+)"
#: Spellings up to which the lexicon is sent to every task instead of shuffling the places to it.
SMALL = 50_000


def _pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PIECES), 1)


def _key(text: Column) -> Column:
    """A spelling as it is looked up: white space as one space, lower case."""
    return F.lower(F.regexp_replace(text, r"\s+", " "))


def respell(texts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(id, text) with every spelling of ``lexicon`` (written, say, exact) that stands alone put as it is said.

    A spelling stands alone if it is no part of a longer or hyphenated word and follows no apostrophe. Of spellings that
    overlap the first counts, and of those that begin together the longest; an ``exact`` one only with its own capitals.
    What is said keeps a capital where the written word had one. Places meet the lexicon by an equi-join.
    """
    known = lexicon.select(_key(F.trim("written")).alias("key"), F.size(_pieces(F.trim("written"))).alias("size"), "written", "say", "exact").where("size > 0")
    # of one spelling the first by what is said
    known = known.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("say"))).where("n = 1").drop("n")
    sizes = [r["size"] for r in known.select("size").distinct().orderBy("size").collect()]  # a handful: words of a spelling
    # rows meet again by id and text, so that ids that are not unique do no harm
    own = F.xxhash64("text").alias("own")
    cut = texts.select("id", own, _pieces(F.col("text")).alias("p"))
    begins = F.filter(F.sequence(F.lit(1), F.size("p")), lambda i: F.element_at("p", i).rlike(r"^[\p{L}-]") & ((i == 1) | (F.element_at("p", F.greatest(i - 1, F.lit(1))) != "'")))
    at = cut.where("size(p) > 0").select("id", "own", "p", F.explode(begins).alias("at"))
    spans = at.select("id", "own", "at", F.explode(F.array(*[F.when(F.col("at") + n - 1 <= F.size("p"), F.struct(F.lit(n).alias("size"), F.array_join(F.slice("p", F.col("at"), F.lit(n)), "").alias("as"))) for n in sizes] or [F.lit(None).cast("struct<size:int,as:string>")])).alias("s")).where("s is not null")
    if known.count() <= SMALL:
        known = F.broadcast(known)
    hits = spans.withColumn("key", _key(F.col("s.as"))).join(known.withColumnRenamed("size", "of"), "key").where("of = s.size and (not exact or regexp_replace(s.as, '\\\\s+', ' ') = written)")
    low = F.lower("say")
    said = F.when(F.col("s.as").rlike(r"^\p{Lu}"), F.initcap(low)).otherwise(low)
    order = F.sort_array(F.collect_list(F.struct("at", (-F.col("of")).alias("less"), said.alias("said"))))
    first = F.aggregate(order, F.array().cast("array<struct<at:int,less:int,said:string>>"), lambda kept, x: F.when((F.size(kept) == 0) | (x["at"] >= F.element_at(kept, -1)["at"] - F.element_at(kept, -1)["less"]), F.concat(kept, F.array(x))).otherwise(kept))
    # only places are grouped and may be sent about; the texts are a side that is never sent whole
    chosen = hits.groupBy("id", "own").agg(first.alias("chosen"))
    end = lambda c: c["at"] - c["less"]
    before = lambda c, i: F.when(i == 0, 1).otherwise(end(F.get("chosen", i - 1)))
    put = F.transform("chosen", lambda c, i: F.concat(F.array_join(F.slice("p", before(c, i), c["at"] - before(c, i)), ""), c["said"]))
    last = end(F.element_at("chosen", -1))
    tail = F.array_join(F.slice("p", last, F.greatest(F.size("p") - last + 1, F.lit(0))), "")
    met = texts.select("id", "text", own).join(chosen, ["id", "own"], "left").withColumn("p", F.when(F.col("chosen").isNotNull(), _pieces(F.col("text"))))
    return met.select("id", F.coalesce(F.concat(F.array_join(put, ""), tail), "text").alias("text"))

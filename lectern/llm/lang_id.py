"""Language identification by Bayesian evidence fusion.

Evidence on one row: the likelihood of its text under byte-trigram models, the language its markup declares, the
suffix of its address, and a prior of its host. The host prior is smoothed towards its suffix and that towards all
rows: ``p_host = (n_host + K p_suffix) / (N_host + K)``, with counts by grouped aggregation over all rows of what the
texts alone say, each row left out of its own prior. How far declarations and suffixes can be trusted is likewise
counted, not assumed. All sources of evidence may be missing.

The trigram models are fitted on about ``SAMPLE`` labelled rows of each language, picked by a hash of doc_id. The log
likelihood of a text of more than ``EFFECTIVE`` trigrams is scaled to that many, as neighbours depend on each other; all of
them are read.

Defined results: a null or empty text has no likelihood and is decided by the rest; null markup, address or host gives
no evidence (rows without a host share the prior of all); repeated rows count each; of languages with equal evidence the
first by name wins; a text of any length is read whole; without labelled rows the language is null; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import as_bytes, cut, slices

#: Labelled rows of each language that its model is fitted on, about.
SAMPLE = 600
#: Trigrams of a text that count in full; longer texts count as this many, since neighbours depend on each other.
EFFECTIVE = 100
SLOTS = 1 << 16
SMOOTH = 8.0

_SKIP = re.compile(rb"<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>", re.S | re.I)
_LANG = re.compile(rb"<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]+)", re.I)


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(slots, bounds): hashed byte trigrams of each text, A-Z in lower case, white space folded."""
    bodies = [b" " + b" ".join(t.lower().split()) + b" " for t in texts]
    lengths = np.fromiter(map(len, bodies), dtype=np.int64, count=len(bodies))
    data = np.frombuffer(b"".join(bodies) + b"  ", dtype=np.uint8).astype(np.uint32)
    code = ((data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]) * np.uint32(2654435761) >> np.uint32(16)
    keep = np.ones(int(lengths.sum()), dtype=bool)
    ends = np.cumsum(lengths)
    keep[ends - 1] = keep[ends - 2] = False
    return code[: len(keep)][keep], np.r_[0, np.cumsum(lengths - 2)]


def fit(labelled: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages and, for each slot and language, the log probability; from (doc_id, text, lang)."""
    rows = labelled.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return [], np.zeros((SLOTS, 0))
    names = sorted(counts)
    every = F.create_map(*[x for k in names for x in (F.lit(k), F.lit(max(1, counts[k] // sample)))])
    picked = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), every[F.col("lang")]) == 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text"):
            slots, bounds = trigrams(as_bytes(batch.column("text")))
            for lang, lo, hi in zip(batch.column("lang").to_pylist(), bounds, bounds[1:], strict=False):
                held[lang] = held.get(lang, 0) + np.bincount(slots[lo:hi], minlength=SLOTS)
        for lang, n in held.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some, pa.int32()), pa.array(n[some], pa.int64())], names=["lang", "slot", "n"])

    # at most SLOTS rows for each language
    got = picked.mapInArrow(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).collect()
    table = np.full((SLOTS, len(names)), 0.1)
    place = {k: i for i, k in enumerate(names)}
    for r in got:
        table[r["slot"], place[r["lang"]]] += r["n"]
    return names, np.log(table / table.sum(axis=0))


def page_rows(pages: DataFrame) -> DataFrame:
    """(row, text, markup, suffix, host) of web pages, ready for ``identify``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            html = as_bytes(batch.column("html"))
            declared = [m[1].decode().lower() if (m := _LANG.search(h)) else None for h in html]
            yield pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.int64()), pa.array([_SKIP.sub(b" ", h) for h in html], pa.binary()).cast(pa.string(), safe=False), pa.array(declared, pa.string()), batch.column("url")], names=["page_id", "text", "markup", "url"])

    rows = pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, text string, markup string, url string")
    host = F.lower(F.regexp_extract("url", r"^\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = rows.withColumn("host", F.when(host != "", host))
    return rows.select(F.lit(None).cast("long").alias("doc_id"), "page_id", "text", "markup", F.regexp_extract("host", r"([^.]+)$", 1).alias("suffix"), "host")


def document_rows(docs: DataFrame) -> DataFrame:
    """Documents have no markup or address; their source takes the part of the host."""
    none = F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id"), "text", none.alias("markup"), none.alias("suffix"), F.col("source").alias("host"))


def _add(*arrays: Column) -> Column:
    out = arrays[0]
    for a in arrays[1:]:
        out = F.zip_with(out, a, lambda x, y: x + y)
    return out


def identify(rows: DataFrame, names: list[str], table: np.ndarray, smooth: float = SMOOTH) -> DataFrame:
    """(doc_id, page_id, lang, confidence, text_lang, markup), one row for each of ``rows``."""
    n = len(names)
    if not n:
        none = F.lit(None).cast("string")
        return rows.select("doc_id", "page_id", none.alias("lang"), F.lit(0.0).alias("confidence"), none.alias("text_lang"), "markup")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            slots, bounds = trigrams(as_bytes(batch.column("text")))
            size = np.diff(bounds)
            total = np.zeros((len(size), n))
            full = np.flatnonzero(size > 0)
            if len(full):
                total[full] = np.add.reduceat(table[slots], bounds[:-1][full], axis=0)
            total *= np.minimum(1.0, EFFECTIVE / np.maximum(size, 1))[:, None]
            total -= total.max(axis=1, keepdims=True)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "page_id", "markup", "suffix", "host")), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["doc_id", "page_id", "markup", "suffix", "host", "likely"])

    seen = cut(rows.mapInArrow(score, "doc_id long, page_id long, markup string, suffix string, host string, likely array<double>"))
    odds = F.transform("likely", lambda x: F.exp(x))
    share = F.transform(odds, lambda x: x / F.aggregate(odds, F.lit(0.0), lambda a, b: a + b))
    seen = seen.withColumn("said", share)

    def counts(*keys: str, name: str) -> DataFrame:
        return seen.groupBy(*keys).agg(F.array(*[F.sum(F.col("said")[i]) for i in range(n)]).alias(name))

    whole = [x or 0.0 for x in counts(name="all").first()["all"]]  # one row
    p_all = F.array(*[F.lit((x + 1.0) / (sum(whole) + n)) for x in whole])
    by_suffix = counts("suffix", name="n_suffix").withColumnRenamed("suffix", "_suffix")
    by_host = counts("host", "suffix", name="n_host").withColumnsRenamed({"host": "_host", "suffix": "_in"})
    by_markup = counts("markup", name="n_markup").where("markup is not null").withColumnRenamed("markup", "_markup")
    marked = by_markup.agg(F.count("*").alias("kinds"), F.array(*[F.coalesce(F.sum(F.col("n_markup")[i]), F.lit(0.0)) for i in range(n)]).alias("n_marked")).first()  # one row

    def less_own(column: str) -> Column:
        return F.zip_with(column, "said", lambda a, b: F.greatest(a - b, F.lit(0.0)))

    def towards(own: Column, prior: str) -> Column:
        """Counts smoothed by ``smooth`` rows that follow the prior above them."""
        total = F.aggregate(own, F.lit(0.0), lambda a, b: a + b) + smooth
        return F.zip_with(own, prior, lambda a, p: (a + smooth * p) / total)

    joined = (
        seen.withColumn("p_all", p_all)
        .withColumn("n_marked", F.array(*map(F.lit, marked["n_marked"])))
        .join(by_suffix, F.col("suffix").eqNullSafe(F.col("_suffix")), "left")
        .join(by_host, F.col("host").eqNullSafe(F.col("_host")) & F.col("suffix").eqNullSafe(F.col("_in")), "left")
        .join(by_markup, F.col("markup") == F.col("_markup"), "left")
    )
    joined = joined.withColumn("p_suffix", towards(less_own("n_suffix"), "p_all"))
    prior = F.when(F.col("host").isNull(), F.col("p_suffix")).otherwise(towards(less_own("n_host"), "p_suffix"))
    joined = joined.withColumn("prior", F.transform(prior, lambda p: F.log(p)))
    # P(declared | language), by what the texts of rows with that declaration say
    trust = F.zip_with("n_markup", "n_marked", lambda a, m: F.log((a + 0.5) / (m + 0.5 * marked["kinds"] + 0.5)))
    flat = F.array(*[F.lit(0.0)] * n)
    joined = joined.withColumn("fused", _add(F.col("likely"), F.col("prior"), F.coalesce(F.when(F.col("markup").isNotNull(), trust), flat)))
    top = F.array_max("fused")
    mass = F.aggregate("fused", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    langs = F.array(*map(F.lit, names))
    named = joined.withColumn("top", top)
    return named.select(
        "doc_id", "page_id",
        F.element_at(langs, F.array_position("fused", F.col("top")).cast("int")).alias("lang"),
        (F.lit(1.0) / mass).alias("confidence"),
        F.when(F.array_min("likely") < 0, F.element_at(langs, F.array_position("likely", F.array_max("likely")).cast("int"))).alias("text_lang"),
        "markup",
    )

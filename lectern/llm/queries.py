"""Queries of the training-data operators and their SQL, for the driver's entry file."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import cutting, exact_dedup, lang_id, mixing, near_dedup, page_text, pieces, ppm, prefix_prints, records, toxicity, vector_codes, whitening
from lectern.llm.common import table


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    return lang_id.identify(lang_id.document_rows(docs).unionByName(lang_id.page_rows(pages)), *lang_id.fit(docs))


def op2_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_corpus(table(spark, sf_dir, "documents"))


def op3_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(vocabulary("word_bpe_49k.json"), encoding="utf-8") as f:
        return records.round_trip(table(spark, sf_dir, "documents"), f.read(), end_id=1)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def mixed_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The output shards of the mix, slot by slot, as ``op4_mix_sources`` draws them."""
    return mixing.mixed_shards(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_texts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(vocabulary("piece_bpe_32k.model"), "rb") as f:
        return pieces.encode_documents(table(spark, sf_dir, "documents"), f.read())


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_prints.fingerprints(table(spark, sf_dir, "documents"))


def op10_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.main_texts(table(spark, sf_dir, "pages"))


def op11_cutting_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(vocabulary("word_bpe_49k.json"), encoding="utf-8") as f:
        return cutting.pack(table(spark, sf_dir, "documents"), f.read(), end_id=1)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_ALL = (op1_language_id, op2_ppm_score, op3_binary_records, op4_mix_sources, op5_toxicity, op6_exact_dedup, op7_near_dedup, op8_sentencepiece, op9_fingerprints, op10_page_text, op11_cutting_stock, op12_whitening, op13_vector_codes, pipeline, mixed_shards)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return {"op6_exact_dedup": exact_dedup.ORACLE, "op13_vector_codes": vector_codes.oracle()}

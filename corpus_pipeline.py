"""The corpus pipeline: documents to token ids in five stages.

Each stage takes what its predecessor kept, is written as Parquet in the folder that the session shares with its
executors, and is read again; a stage's table goes when the next one is written. ``ORACLE_SQL`` is None: stages such as the classifier have no SQL form; the stages are
tested against brute-force versions instead.

Defined results: what the operators state of null, empty and very long texts, ties, repeated rows and extra columns holds for
each stage; a null doc_id is a document like any other in every stage; an empty table passes through all stages.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lectern.llm import exact_dedup, mixing, near_dedup, pieces, toxicity
from lectern.llm.common import release, remove, shared_dir, small_batches, table

ORACLE_SQL = None


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: documents that the classifier rejects go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts the smallest doc_id stays."""
    small_batches(spark)
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: one document of each group stays."""
    small_batches(spark)
    return near_dedup.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights: the words that the mix takes, a row for each pass over a source."""
    small_batches(spark)
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece encoding of what is left: doc_id, source, ids, and whether parity and round trip hold."""
    small_batches(spark)
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return pieces.encoded(docs, f.read())


STAGES = [("toxicity", clean), ("exact dedup", exact), ("near dedup", near), ("mixing", mix), ("sentencepiece", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, home = table(spark, sf_dir, "documents"), f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for n, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{n}")
        docs = spark.read.parquet(f"{home}/{n}")
        if n:
            remove(spark, f"{home}/{n - 1}")
        release(spark)
    return docs

"""A corpus pipeline: language ID, exact dedup, near dedup, mixing and packing, each a stage over what the last kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import exact, langid, mixing, neardup, packing
from gridloom.llm.common import documents, use_shared_checkpoints

#: Near duplicates: shingles of so many words, a Jaccard similarity of 0.8 and more.
NEAR_WORDS = 5
#: Longer blocks leave more documents in one piece.
MIX_BLOCK_WORDS = 128


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose language can't be told: those without a letter."""
    return langid.keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays."""
    return exact.drop_exact(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that pairs with a similarity of 0.8 or more connect, the document with the smallest doc_id stays.
    SimHash finds the pairs, their whole texts decide."""
    return neardup.drop_similar(docs, words=NEAR_WORDS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, as documents: a row for each run of a document's words and each time round."""
    return mixing.mixed_documents(docs, block_words=MIX_BLOCK_WORDS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document with its place in a sequence."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]

#: Language ID, fingerprints, the pseudorandom mix and token ids have no SQL form; tests/llm/test_pipeline.py holds the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each but the last returns is written to the shared checkpoint folder and read again."""
    use_shared_checkpoints(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs

"""The corpus pipeline: quality, toxicity, near duplicates, contamination, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the one before
kept.  The filtering stages return the columns of ``documents``; the last gives
doc_id with the digests of its ids and of their decoding.
"""

from __future__ import annotations

import itertools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lumenweft.llm import byte_bpe, decontaminate, near_dup, quality_pu, toxicity
from lumenweft.llm.common import remove_folder, shared_folder, table
from lumenweft.sources.shipping import shipped


@shipped
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality_pu.keep_good(docs, quality_pu.fit(docs, table(spark, sf_dir, "labels")))


@shipped
def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network lets pass."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@shipped
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dup.keep_one(docs)


@shipped
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


@shipped
def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document left."""
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN, with_ids=False)


STAGES = [
    ("quality classifier", quality),
    ("toxicity", toxic),
    ("minhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("byte-level bpe", encoded),
]

#: No SQL gives the networks' scores, so the stages are tested against brute force instead.
ORACLE_SQL = None

_RUNS = itertools.count()


@shipped
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each is written as Parquet in the shared folder and read again, and deleted after the next."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_folder(spark)}/pipeline-{spark.sparkContext.applicationId}-{next(_RUNS)}"
    for k, (_, stage) in enumerate(STAGES):
        out = f"{base}/{k}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(out)
        docs = spark.read.parquet(out)
        if k:
            remove_folder(spark, f"{base}/{k - 1}")
    return docs

"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import remove_folder, shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder.

    The folder comes from ``spark.checkpoint.dir``; a private one is made only
    where neither the setting nor the context names any and Spark runs in one
    process (tests).
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage by a table in the shared folder: smaller than a checkpoint, and :func:`dropped` when it is done with."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for t in tables:
        remove_folder(t.sparkSession, t._stored_at)


def hash_sample(df: DataFrame, key: str, n: int, seed: int) -> list:
    """At most n rows, those with the least hashes of (seed, key); the same rows however df is laid out.

    A bound on the hash that about 2 n rows pass keeps what each task sends to
    the driver small; where fewer than n pass, all rows compete.
    """
    rank = F.xxhash64(F.lit(seed), F.col(key))
    order = df.withColumn("__rank", rank)
    total = df.count()
    first = lambda some: [r for r in some.orderBy("__rank", key).limit(n).drop("__rank").collect()]
    if total > 4 * n:
        found = first(order.where(F.col("__rank") <= int(-(2**63) + 2**64 * (2 * n / total))))
        if len(found) == n:
            return found
    return first(order)


def byte_bound(df: DataFrame, column: str) -> int:
    """Total bytes of a text column: what a broadcast of it would hold."""
    return int(df.agg(F.sum(F.octet_length(column))).first()[0] or 0)

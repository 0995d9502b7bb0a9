"""Vector retrieval and the state of embeddings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from .lexical import ranked, scope


def search(memories: DataFrame, embeddings: DataFrame, query: Sequence[float] | Column, provider: str, limit: int = 20, **conditions) -> DataFrame:
    """(query_id, id, similarity, rank): the nearest memories by cosine; none below or at 0.

    Vectors count only while ready and made from the memory's present content.
    """
    ready = embeddings.filter((F.col("provider_id") == provider) & (F.col("status") == "ready") & F.col("vector").isNotNull())
    vector = query if isinstance(query, Column) else F.array(*[F.lit(float(x)) for x in query])
    close = ready.select(F.col("memory_id").alias("id"), F.col("content_hash").alias("hash"), F.round(scores.cosine(F.col("vector"), vector), 6).alias("similarity"))
    hits = close.filter((F.col("similarity") > 0) & ~F.isnan("similarity")).join(scope(memories, **conditions).select("id", "hash"), ["id", "hash"])
    return top(hits.select(F.lit(0).cast("long").alias("query_id"), "id", "similarity"), limit)


def top(hits: DataFrame, limit: int) -> DataFrame:
    """One query's best without sorting all: the limit first, ranks among those that are left."""
    return ranked(hits.orderBy(F.desc("similarity"), "id").limit(limit), "similarity", limit)


def upsert(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """The newest row of each (memory_id, provider_id); of equally new ones the incoming."""
    both = current.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    newest = Window.partitionBy("memory_id", "provider_id").orderBy(F.desc("updated_at"), F.desc("_new"), F.desc("content_hash"))
    return both.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n", "_new")


def after_change(embeddings: DataFrame, memories: DataFrame) -> DataFrame:
    """Vectors whose memory has other content by now are pending again, without a vector."""
    now = memories.select(F.col("id").alias("memory_id"), F.col("hash").alias("_hash"))
    changed = F.col("_hash").isNotNull() & (F.col("_hash") != F.col("content_hash"))
    joined = embeddings.join(now, "memory_id", "left")
    return joined.withColumn("status", F.when(changed, "pending").otherwise(F.col("status"))).withColumn("vector", F.when(~changed, F.col("vector"))).withColumn("content_hash", F.when(changed, F.col("_hash")).otherwise(F.col("content_hash"))).drop("_hash")


def pending(embeddings: DataFrame, provider: str, failed_too: bool = True) -> DataFrame:
    return embeddings.filter((F.col("provider_id") == provider) & F.col("status").isin("pending", *(["failed"] if failed_too else []))).orderBy("updated_at", "memory_id")

"""Rank fusion, expansion along links, and recall."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from ..lineage import settle
from . import lexical
from .index import Index
from .lexical import ranked

RELATED_FACTOR, RELATED_EACH = 0.6, 5


def fusion_score(bm25_rank: Column, vector_rank: Column, priority: Column, vitality: Column) -> Column:
    part = lambda rank: F.coalesce(0.45 / (60 + rank), F.lit(0.0))
    return part(bm25_rank) + part(vector_rank) + 0.05 * scores.lookup(priority, scores.PRIORITY_PRIOR, 0.25) + 0.05 * vitality


def fuse(memories: DataFrame, words: DataFrame, near: DataFrame, limit: int = 10, now: datetime | str | None = None, recency: float = 0.0) -> DataFrame:
    """(query_id, id, bm25_rank, vector_rank, score, rank) of what either branch found.

    words: (query_id, id, rank), near: (query_id, id, similarity, rank). recency in (0, 1] gives that
    share of the score to exp(-days/30) since the last update.
    """
    both = words.select("query_id", "id", F.col("rank").alias("bm25_rank")).join(near.select("query_id", "id", F.col("rank").alias("vector_rank"), "similarity"), ["query_id", "id"], "full_outer")
    joined = both.join(memories.select("id", "priority", "vitality", "updated_at"), "id")
    score = fusion_score(F.col("bm25_rank"), F.col("vector_rank"), F.col("priority"), F.col("vitality"))
    if recency > 0:
        age = F.greatest(F.lit(0.0), scores.days(F.col("updated_at"), now))
        score = (1 - recency) * score + recency * F.exp(-age / 30)
    out = joined.withColumn("score", F.round(score, 6))
    return ranked(out, "score", limit, F.desc("updated_at")).select("query_id", "id", "bm25_rank", "vector_rank", "similarity", "score", "rank")


def related(results: DataFrame, links: DataFrame, memories: DataFrame, limit: int) -> DataFrame:
    """results (query_id, id, score, rank) with up to five linked memories of each, at most 1.5 times limit rows.

    A memory already found isn't repeated; one linked from several counts for the first of them. Adds
    source_id, null for direct rows.
    """
    fan = Window.partitionBy("query_id", "source_id").orderBy(F.desc("weight"), "target_id")
    direct = results.select("query_id", "id", "score", "rank")
    out = direct.select("query_id", F.col("id").alias("source_id"), F.col("score").alias("source_score"), F.col("rank").alias("source_rank")).join(links.select("source_id", "target_id", "weight"), "source_id")
    alive = out.join(memories.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    best = alive.withColumn("n", F.row_number().over(fan)).filter(F.col("n") <= RELATED_EACH)
    best = best.join(direct.select("query_id", F.col("id").alias("target_id")), ["query_id", "target_id"], "left_anti")
    first = Window.partitionBy("query_id", "target_id").orderBy("source_rank")
    own = best.withColumn("n", F.row_number().over(first)).filter("n = 1").select("query_id", F.col("target_id").alias("id"), F.round(F.col("source_score") * F.col("weight") * RELATED_FACTOR, 6).alias("score"), "source_id")
    both = direct.select("query_id", "id", "score", F.lit(None).cast(results.schema["id"].dataType).alias("source_id")).unionByName(own)
    return ranked(both, "score", int(limit * 1.5), F.col("source_id").isNotNull())


def recall(memories: DataFrame, queries: DataFrame, near: DataFrame | None = None, links: DataFrame | None = None, limit: int = 10, now: datetime | str | None = None, recency: float = 0.0, index: Index | None = None, **conditions) -> DataFrame:
    """Recall for each query, with its mode: dual-path, vector-only or bm25-only by which branch found anything.

    near: vector results (query_id, id, similarity, rank), at most 2 * limit a query. Columns: query_id,
    id, score, rank, mode, source_id. index: of the memories, if at hand.
    """
    words = settle(lexical.search(memories, queries, 2 * limit, index, **conditions))  # used three times, a few rows a query
    by_words = lexical.weighted(memories, words, limit).select("query_id", "id", "score", "rank", F.lit("bm25-only").alias("mode"))
    if near is None:
        out = by_words
    else:
        fused = fuse(memories, words, near, limit, now, recency)
        has = near.select("query_id").distinct()
        both = words.select("query_id").distinct().withColumn("_w", F.lit(True))
        fused = fused.join(has, "query_id", "left_semi").join(both, "query_id", "left")
        mode = F.when(F.col("_w"), "dual-path").otherwise("vector-only")
        out = fused.select("query_id", "id", "score", "rank", mode.alias("mode")).unionByName(by_words.join(has, "query_id", "left_anti"))
    out = out if near is None else settle(out)
    if links is None:
        return out.withColumn("source_id", F.lit(None).cast(out.schema["id"].dataType))
    return related(out, links, memories, limit).join(out.select("query_id", "mode").distinct(), "query_id").select("query_id", "id", "score", "rank", "mode", "source_id")


def with_emotion(results: DataFrame, memories: DataFrame, tag: str, limit: int) -> DataFrame:
    """Of results, fetched at three times the limit, those with the tag: the filter comes after the ranking."""
    kept = results.join(memories.filter(F.col("emotion_tag") == tag).select("id"), "id", "left_semi").withColumnRenamed("rank", "fetched_rank")
    return ranked(kept, "score", limit, F.col("fetched_rank"))


def record_access(memories: DataFrame, ids: DataFrame, now: datetime | str, growth: float = 1.5) -> DataFrame:
    """Memories after a look at `ids`: count up, stability times growth, vitality up by a fifth; updated_at stays."""
    hit = F.col("_hit").isNotNull()
    marked = memories.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    new = {
        "access_count": F.when(hit, F.col("access_count") + 1).otherwise(F.col("access_count")),
        "last_accessed": F.when(hit, scores.instant(now)).otherwise(F.col("last_accessed")),
        "stability": F.when(hit, F.least(F.lit(999999.0), F.col("stability") * growth)).otherwise(F.col("stability")),
        "vitality": F.when(hit, F.least(F.lit(1.0), F.col("vitality") * 1.2)).otherwise(F.col("vitality")),
    }
    return marked.withColumns(new).drop("_hit").select(memories.columns)

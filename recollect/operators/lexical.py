"""Lexical retrieval: BM25 over the inverted index, for any number of queries at once."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores, text
from . import best as cells
from .index import Index
from .index import of as index_of

K1, B = 1.2, 0.75


def phrases(queries: DataFrame, *more: str) -> DataFrame:
    """(query_id, phrase, key, terms): each token of a query is a phrase of one term or more, key names it."""
    tokens = queries.select("query_id", *more, F.posexplode(text.tokenize(F.col("query"))).alias("phrase", "token"))
    own = tokens.select("query_id", *more, "phrase", text.terms(F.array("token")).alias("terms")).filter(F.size("terms") > 0)
    return own.withColumn("key", F.array_join("terms", " "))


def scope(memories: DataFrame, agent: str | None = None, min_vitality: float = 0.0, after: datetime | str | None = None, before: datetime | str | None = None, types: tuple[str, ...] | None = None, emotion_tag: str | None = None) -> DataFrame:
    """The usual conditions on memories; None leaves one out. Times are inclusive."""
    conditions: list[Column] = [F.col("vitality") >= min_vitality]
    conditions += [F.col("agent_id") == agent] if agent is not None else []
    conditions += [F.col("updated_at") >= scores.instant(after)] if after is not None else []
    conditions += [F.col("updated_at") <= scores.instant(before)] if before is not None else []
    conditions += [F.col("type").isin(*types)] if types else []
    conditions += [F.col("emotion_tag") == emotion_tag] if emotion_tag is not None else []
    for condition in conditions:
        memories = memories.filter(condition)
    return memories


def bm25_scores(memories: DataFrame, queries: DataFrame, within: str | None = None, index: Index | None = None, only: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score) of all matches. Corpus statistics are over all memories given.

    What a memory gains by a phrase is worked out once for each distinct phrase, whatever the number of
    queries; the index is narrowed to the queries' terms before. within: a column of both tables, as
    agent_id; a query then meets the memories with its own value only. index: of these memories, if at
    hand. only: ids (id) that can be results.
    """
    own = [within] if within else []
    asked = phrases(queries, *own)
    return asked.select("query_id", "phrase", "key", *own).join(_gains(asked, own, index or index_of(memories), only), ["key", *own]).groupBy("query_id", "id").agg(F.round(F.sum("gain"), 9).alias("score"))


def _gains(asked: DataFrame, own: list[str], index: Index, only: DataFrame | None) -> DataFrame:
    """(key, id, gain) of the phrases asked for, by memory."""
    unique = asked.select("key", "terms").distinct().select("key", F.size("terms").alias("size"), F.posexplode("terms").alias("offset", "term"))
    met = index.postings.select("id", *own, "dl", "pos", "term").join(unique, "term")
    single = met.filter("size = 1").groupBy("key", "id", *own, "dl").agg(F.count(F.lit(1)).alias("tf"))  # nearly all phrases
    several = met.filter("size > 1").groupBy("key", "size", "id", *own, "dl", (F.col("pos") - F.col("offset")).alias("at")).agg(F.count(F.lit(1)).alias("hits")).filter(F.col("hits") == F.col("size"))
    tf = single.unionByName(several.groupBy("key", "id", *own, "dl").agg(F.count(F.lit(1)).alias("tf")))
    df = tf.groupBy("key").agg(F.count(F.lit(1)).alias("df"))
    tf = tf if only is None else tf.join(only.select("id"), "id", "left_semi")
    joined = tf.join(df, "key").crossJoin(F.broadcast(index.corpus))  # one row
    raw = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(raw <= 0, F.lit(1e-6)).otherwise(raw)
    length = F.col("dl") / (F.col("total") / F.col("n"))
    gain = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * length))
    return joined.select("key", *own, "id", gain.alias("gain"))


#: Queries up to which all their matches are made as rows.
FEW = 64


def best(memories: DataFrame, queries: DataFrame, limit: int, within: str | None = None, index: Index | None = None, only: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, rank): the best `limit` of what bm25_scores says, without making all matches where queries are many."""
    if queries.limit(FEW + 1).count() <= FEW:
        return ranked(bm25_scores(memories, queries, within, index, only), "score", limit)
    own = [within] if within else []
    index, asked = index or index_of(memories), phrases(queries, *own)
    found = cells.top(_gains(asked, own, index, only), asked.select("query_id", "key", *own), limit, index.tokens.select("id", *own), queries.select("query_id", *own), within)
    return ranked(found, "score", limit)


def ranked(scored: DataFrame, score: str, limit: int | None, *ties: Column) -> DataFrame:
    """rank by falling score within each query_id; ties by the columns given, then id."""
    order = Window.partitionBy("query_id").orderBy(F.desc(score), *ties, "id")
    out = scored.withColumn("rank", F.row_number().over(order))
    out = out if limit is None else out.filter(F.col("rank") <= limit)  # before the cast, so that each task keeps its own best only
    return out.withColumn("rank", F.col("rank").cast("long"))


def search(memories: DataFrame, queries: DataFrame, limit: int | None = 20, index: Index | None = None, **conditions) -> DataFrame:
    """(query_id, id, score, rank): BM25 over `queries` (query_id, query); conditions as in scope narrow the results, not the statistics."""
    conditions = {k: v for k, v in conditions.items() if v is not None and (k, v) != ("min_vitality", 0.0)}
    only = scope(memories, **conditions) if conditions else None
    return ranked(bm25_scores(memories, queries, index=index, only=only), "score", None) if limit is None else best(memories, queries, limit, index=index, only=only)


def weighted(memories: DataFrame, hits: DataFrame, limit: int = 10) -> DataFrame:
    """Recall by words alone: BM25 times the weight of the priority and the vitality, of at least 0.1."""
    joined = hits.join(memories.select("id", "priority", "vitality"), "id")
    value = F.col("score") * scores.lookup(F.col("priority"), scores.PRIORITY_WEIGHT, 1.0) * F.greatest(F.lit(0.1), F.col("vitality"))
    out = joined.select("query_id", "id", F.col("rank").alias("bm25_rank"), F.round(value, 6).alias("score"))
    return ranked(out, "score", limit, F.col("bm25_rank"))


def like(memories: DataFrame, query: str, limit: int = 20, **conditions) -> DataFrame:
    """Fallback by substring, ASCII case ignored: by priority, then newest; score 1/rank."""
    low = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hits = scope(memories, **conditions).filter(F.contains(low(F.col("content")), low(F.lit(query))))
    top = hits.select("id", "priority", "updated_at").orderBy("priority", F.desc("updated_at"), "id").limit(limit)
    rank = F.row_number().over(Window.orderBy("priority", F.desc("updated_at"), "id"))  # of at most `limit` rows
    return top.select("id", rank.cast("long").alias("rank"), (1 / rank).alias("score"))


def one_query(memories: DataFrame, query: str) -> DataFrame:
    """A table of a single query; its size is known to the planner, so that it is broadcast."""
    return memories.sparkSession.range(1).select(F.col("id").alias("query_id"), F.lit(query).alias("query"))

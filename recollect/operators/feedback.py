"""Feedback on memories: summaries, penalties and the limit on passive signals."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores

PASSIVE_VALUE, PASSIVE_MOST, WINDOW_MICROS = 0.7, 3, 86_400_000_000


def summary(events: DataFrame, agent: str | None = None) -> DataFrame:
    """(memory_id, total, useful, not_useful, score); a memory without events has no row and scores 0.5."""
    own = events if agent is None else events.filter(F.col("agent_id") == agent)
    good = F.count_if(F.col("useful") == 1)
    total = F.count(F.lit(1))
    return own.groupBy("memory_id").agg(total.alias("total"), good.alias("useful"), (total - good).alias("not_useful"), (good / total).alias("score"))


def penalty(events: DataFrame) -> DataFrame:
    """(memory_id, penalty): 1 less the mean value; a memory without events has no row and is penalised by 1."""
    return events.groupBy("memory_id").agg(scores.clamp01(1 - F.avg("value")).alias("penalty"))


def passive_counts(events: DataFrame, ids: DataFrame | None, now: datetime | str) -> DataFrame:
    """(memory_id, n) of passive events in the 24 hours before now, of all agents; ids narrows the memories."""
    recent = events.filter((F.col("source") == "passive") & (F.unix_micros("created_at") > F.unix_micros(scores.instant(now)) - WINDOW_MICROS))
    recent = recent if ids is None else recent.join(ids.select("memory_id").distinct(), "memory_id", "left_semi")
    return recent.groupBy("memory_id").agg(F.count(F.lit(1)).alias("n"))


def admitted(times: Column, most: int = PASSIVE_MOST) -> Column:
    """Of sorted times in microseconds those that are accepted: fewer than `most` accepted ones within 24 hours before.

    Only the last `most` accepted times can matter for the next, so the fold looks at those alone.
    """
    near = lambda acc, t: F.size(F.filter(F.slice(acc, F.greatest(F.size(acc) - most + 1, F.lit(1)), F.lit(most)), lambda x: x > t - WINDOW_MICROS))
    return F.aggregate(times, F.array().cast("array<bigint>"), lambda acc, t: F.when(near(acc, t) < most, F.concat(acc, F.array(t))).otherwise(acc))


def limit_passive(attempts: DataFrame) -> DataFrame:
    """(memory_id, attempts, accepted, last_accepted_us) of attempts (memory_id, created_at)."""
    times = F.sort_array(F.collect_list(F.unix_micros("created_at")))
    grouped = attempts.groupBy("memory_id").agg(times.alias("t")).withColumn("a", admitted(F.col("t")))
    return grouped.select("memory_id", F.size("t").cast("long").alias("attempts"), F.size("a").cast("long").alias("accepted"), F.array_max("a").alias("last_accepted_us"))


def record(memories: DataFrame, signals: DataFrame) -> DataFrame:
    """Feedback rows of signals (id, memory_id, source, useful, agent_id, created_at); the memory must exist."""
    known = signals.join(memories.select(F.col("id").alias("memory_id")), "memory_id", "left_semi")
    kind = F.concat("source", F.when(F.col("useful") == 1, ":useful").otherwise(":not_useful"))
    return known.select("id", "memory_id", "source", F.col("useful").cast("int").alias("useful"), "agent_id", kind.alias("event_type"), F.col("useful").cast("double").alias("value"), "created_at")

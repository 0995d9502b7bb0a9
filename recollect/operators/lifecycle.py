"""Forgetting: decay, tidying of stale content, and eviction by quota."""

from __future__ import annotations

import re

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores, text
from ..lineage import settle
from ..sources import tables
from . import best
from .index import Index

EPSILON, FADED = 0.001, 0.05
#: (name, factor, least age in days, pattern) for events, then for knowledge; the first that matches counts.
STALE_EVENT = (
    ("in_progress", 0.3, 7.0, "(?i)working on|deploying|in progress|处理中|部署中|进行中|正在"),
    ("pending", 0.5, 14.0, r"(?i)todo|待办|等[^\n\r]*(?:确认|回复)|需要[^\n\r]*确认"),
    ("ephemeral", 0.2, 3.0, "(?i)a moment ago|just now|刚刚|刚才"),
)
STALE_KNOWLEDGE = (("pending", 0.5, 14.0, "(?im)^(?:fixme|wip|todo|进行中|待办)[:：]"), ("ephemeral", 0.2, 3.0, "(?m)^(?:刚刚|刚才)"))


@dataclass(frozen=True)
class Capacity:
    """Rows that may stay, by type (None: no limit) and in all."""

    by_type: Mapping[str, int | None] = field(default_factory=lambda: {"identity": None, "emotion": 50, "knowledge": 250, "event": 50})
    total: int = 350

    @classmethod
    def from_settings(cls, settings: Mapping[str, str], prefix: str = "") -> Capacity:
        """From MAX_IDENTITY, MAX_EMOTION, MAX_KNOWLEDGE, MAX_EVENT and MAX_MEMORIES, as of the environment; what isn't a whole number above 0 leaves the usual value."""
        usual = cls()
        number = lambda name, default: int(m[0]) if (m := re.match(r"\s*\+?\d+", settings.get(f"{prefix}MAX_{name}", ""))) and int(m[0]) > 0 else default
        return cls({kind: number(kind.upper(), most) for kind, most in usual.by_type.items()}, number("MEMORIES", usual.total))


def decay(memories: DataFrame, now: datetime | str) -> DataFrame:
    """(id, old, vitality, changed) for all but the highest priority: vitality anew from the time since the last access."""
    age = F.greatest(F.lit(0.0), scores.days(F.coalesce("last_accessed", "created_at"), now))
    fresh = F.round(scores.vitality(F.col("stability"), age, F.col("priority")), 9)
    rows = memories.filter("priority > 0").select("id", F.col("vitality").alias("old"), fresh.alias("vitality"))
    return rows.withColumn("changed", F.abs(F.col("vitality") - F.col("old")) > EPSILON)


def decay_summary(decayed: DataFrame) -> DataFrame:
    """One row: updated, decayed, below_threshold; the latter two among the updated."""
    up = F.col("changed")
    return decayed.agg(F.count_if(up).alias("updated"), F.count_if(up & (F.col("vitality") < F.col("old"))).alias("decayed"), F.count_if(up & (F.col("vitality") < FADED)).alias("below_threshold"))


def with_vitality(memories: DataFrame, new: DataFrame, now: datetime | str) -> DataFrame:
    """memories with the vitality of `new` (id, vitality), whose updated_at moves too."""
    joined = memories.join(new.select("id", F.col("vitality").alias("_v")), "id", "left")
    hit = F.col("_v").isNotNull()
    return joined.withColumn("vitality", F.coalesce("_v", "vitality")).withColumn("updated_at", F.when(hit, scores.instant(now)).otherwise(F.col("updated_at"))).select(memories.columns)


def faded(memories: DataFrame, threshold: float = FADED) -> DataFrame:
    """What has lost its vitality and isn't protected by priority."""
    return memories.filter((F.col("vitality") < threshold) & (F.col("priority") >= 2))


def stale(content: Column, kind: Column) -> dict[str, Column]:
    """reason, factor and least age of stale content; nulls where it isn't."""
    out = {}
    for i, name in enumerate(("reason", "factor", "age")):
        def chain(patterns, i=i):
            c = None
            for p in patterns:
                c = (F if c is None else c).when(text.matches(content, p[3]), F.lit(p[i]))
            return c

        out[name] = F.when(kind == "event", chain(STALE_EVENT)).when(kind == "knowledge", chain(STALE_KNOWLEDGE))
    return out


def stale_decay(memories: DataFrame, now: datetime | str, threshold: float = FADED) -> DataFrame:
    """(id, reason, vitality) of stale memories old enough, with their lowered vitality."""
    told = stale(F.col("content"), F.col("type"))
    rows = memories.filter((F.col("priority") >= 2) & (F.col("vitality") >= threshold)).select("id", "created_at", F.col("vitality").alias("old"), *[c.alias(n) for n, c in told.items()])
    new = F.round(F.col("old") * F.col("factor"), 9)
    return rows.filter(F.col("reason").isNotNull() & (scores.days(F.col("created_at"), now) >= F.col("age")) & (F.abs(new - F.col("old")) > EPSILON)).select("id", "reason", new.alias("vitality"))


def tidy(memories: DataFrame, now: datetime | str, threshold: float = FADED) -> DataFrame:
    """memories after tidying: the faded are gone, the stale weakened."""
    return with_vitality(memories.join(faded(memories, threshold).select("id"), "id", "left_anti"), stale_decay(memories, now, threshold), now)


def redundancy(memories: DataFrame, by: tuple[str, ...] = ("type",), index: Index | None = None) -> DataFrame:
    """(id, redundancy): the largest share of tokens with another memory of the same `by`; tokens are told apart by 64 bits.

    Exact, in cells that a task looks through (see best.nearest): pairs are never made as rows. Memories
    with equal token sets are collapsed before: there redundancy is 1. index: of the memories or of more, if
    at hand.
    """
    rows = memories.join(index.tokens.select("id", "tokens"), "id") if index else memories.withColumn("tokens", text.tokenize(F.col("content")))
    tokens = settle(rows.select("id", *by, F.sort_array(F.transform("tokens", lambda t: F.xxhash64(t))).alias("tokens")))  # 64 bits a token
    sets = settle(tokens.groupBy(*by, "tokens").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")))
    group = F.when(reduce(and_, (F.col(c).isNotNull() for c in by)), F.to_json(F.struct(*by))) if by else F.lit("")
    found = best.nearest(sets.select(F.col("rep").alias("id"), F.col("tokens").alias("keys"), (F.col("n") == 1).alias("asks"), group.alias("within")).filter("within is not null"), "within")
    most = found.groupBy(F.col("query_id").alias("rep")).agg(F.max("score").alias("most"))
    own = sets.join(most, "rep", "left").select(*by, "tokens", F.when((F.col("n") > 1) & (F.size("tokens") > 0), 1.0).otherwise(F.coalesce("most", F.lit(0.0))).alias("redundancy"))
    return tokens.join(own, [*by, "tokens"]).select("id", "redundancy")


def eviction(memories: DataFrame, penalties: DataFrame, now: datetime | str, index: Index | None = None) -> DataFrame:
    """(id, type, priority, redundancy, age_score, penalty, score) of all that may be evicted, unordered.

    penalties: (memory_id, penalty); a memory without one counts as 1.
    """
    rows = memories.filter((F.col("priority") > 0) & (F.trim("content") != ""))
    joined = rows.join(redundancy(rows, index=index), "id").join(penalties.select(F.col("memory_id").alias("id"), "penalty"), "id", "left")
    age = scores.clamp01(F.greatest(F.lit(0.0), scores.days(F.col("created_at"), now)) / 180)
    penalty = F.coalesce("penalty", F.lit(1.0))
    score = scores.clamp01(0.40 * (1 - scores.clamp01(F.col("vitality"))) + 0.20 * F.col("redundancy") + 0.20 * age + 0.10 * scores.clamp01(penalty) + 0.10 * scores.clamp01(F.col("priority") / 3))
    return joined.select("id", "type", "priority", F.round("redundancy", 6).alias("redundancy"), F.round(age, 6).alias("age_score"), F.round(penalty, 6).alias("penalty"), F.round(score, 6).alias("score"))


def placed(ranked: DataFrame, *within: str) -> DataFrame:
    """Adds r, the place by falling score, rising priority and id, within groups or overall.

    Rows are counted by score first (it has six digits) and numbered among equals only, so no task ever
    sorts more than the rows of one score.
    """
    per = ranked.groupBy(*within, "score", "priority").agg(F.count(F.lit(1)).alias("_c"))
    order = (Window.partitionBy(*within) if within else Window.partitionBy()).orderBy(F.desc("score"), "priority").rowsBetween(Window.unboundedPreceding, -1)
    before = per.select(*within, "score", "priority", F.coalesce(F.sum("_c").over(order), F.lit(0)).alias("_b"))
    equal = Window.partitionBy(*within, "score", "priority").orderBy("id")
    return ranked.withColumn("_r", F.row_number().over(equal)).join(before, [*within, "score", "priority"]).withColumn("r", F.col("_b") + F.col("_r")).drop("_b", "_r")


def evicted(memories: DataFrame, ranked: DataFrame, capacity: Capacity = Capacity()) -> DataFrame:
    """(id, quota): what the quotas drop, `type` first, then `total`, from scores made once before.

    All rows count towards a quota, also those that can't be evicted.
    """
    counts = memories.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    limit = F.lit(None).cast("long")
    for kind, most in capacity.by_type.items():
        if most is not None:
            limit = F.when(F.col("type") == kind, F.lit(most)).otherwise(limit)
    over = counts.withColumn("excess", F.col("n") - limit).filter("excess > 0").select("type", "excess")
    by_type = placed(ranked.join(F.broadcast(over), "type"), "type").filter("r <= excess")  # over: a row a type
    first = by_type.select("id", F.lit("type").alias("quota"))
    left = ranked.join(first.select("id"), "id", "left_anti")
    remaining = memories.agg(F.count(F.lit(1)).alias("n")).crossJoin(first.agg(F.count(F.lit(1)).alias("gone"))).select((F.col("n") - F.col("gone") - capacity.total).alias("excess"))
    second = placed(left).crossJoin(F.broadcast(remaining)).filter("r <= excess").select("id", F.lit("total").alias("quota"))
    return first.unionByName(second)


def archive_split(gone: DataFrame, min_vitality: float = 0.1) -> DataFrame:
    """Adds fate: what is too weak is deleted, the rest archived."""
    return gone.withColumn("fate", F.when(F.col("vitality") < min_vitality, "deleted").otherwise("archived"))


def govern(memories: DataFrame, paths: DataFrame, archive: DataFrame, penalties: DataFrame, now: datetime | str, capacity: Capacity = Capacity(), index: Index | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, told): memories, paths and archive after governing, and a row (orphan_paths, empty_memories, evicted, archived).

    Paths to no memory and blank memories are deleted; what the quotas drop is archived if vital enough,
    else deleted. Paths of what goes now go too. Scores are made once, before anything is evicted.
    """
    held = settle(memories.filter(F.trim("content") != ""))
    led = paths.join(memories.select(F.col("id").alias("memory_id")), "memory_id", "left_semi").select(paths.columns)
    gone = settle(evicted(held, settle(eviction(held, penalties, now, index)), capacity))
    left, kept = tables.archive(held, archive, gone, now)
    told = gone.agg(F.count(F.lit(1)).alias("evicted")).crossJoin(gone.join(held.filter("vitality >= 0.1").select("id"), "id", "left_semi").agg(F.count(F.lit(1)).alias("archived")))  # one row each
    told = told.crossJoin(orphan_paths(paths, memories).agg(F.count(F.lit(1)).alias("orphan_paths"))).crossJoin(memories.agg(F.count_if(F.trim("content") == "").alias("empty_memories")))
    led = led.join(left.select(F.col("id").alias("memory_id")), "memory_id", "left_semi").select(paths.columns)
    return {"memories": left, "paths": led, "memory_archive": kept}, told.select("orphan_paths", "empty_memories", "evicted", "archived")


def orphan_paths(paths: DataFrame, memories: DataFrame) -> DataFrame:
    return paths.join(memories.select(F.col("id").alias("memory_id")), "memory_id", "left_anti")


Phase = Callable[[datetime | str], Mapping[str, object]]


def reflect(phases: Mapping[str, Phase], now: datetime | str, checkpoint: dict | None = None, save: Callable[[dict], None] = lambda _: None) -> dict:
    """Runs the phases in order, saving a checkpoint before each and after; a failed run resumes where it stopped.

    The checkpoint is a plain dict: status, done, next, results, error. A failure is saved, then raised.
    """
    state = checkpoint if checkpoint and checkpoint["status"] in ("running", "failed") else {"done": [], "results": {}}
    state |= {"status": "running", "error": None}
    for name, phase in phases.items():
        if name in state["done"]:
            continue
        state["next"] = name
        save(state)
        try:
            state["results"][name] = dict(phase(now))
        except Exception as e:
            state |= {"status": "failed", "error": str(e)}
            save(state)
            raise
        state["done"].append(name)
    state |= {"status": "completed", "next": None}
    save(state)
    return state

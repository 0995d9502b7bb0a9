"""Lists, counts and the sets a session starts with."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .lexical import scope
from .lifecycle import Capacity

CORE_PATHS = ("core://agent", "core://user", "core://agent/identity", "core://user/identity")
LAYERS = {"identity": 50, "emotion": 5, "event": 7, "knowledge": 10}


def listed(memories: DataFrame, limit: int = 100, offset: int = 0, priority: int | None = None, **conditions) -> DataFrame:
    """Memories by priority, then newest first."""
    rows = scope(memories, **conditions)
    rows = rows if priority is None else rows.filter(F.col("priority") == priority)
    return rows.orderBy("priority", F.desc("updated_at"), "id").offset(offset).limit(limit)


def archived(archive: DataFrame, agent: str | None = None, limit: int = 20) -> DataFrame:
    rows = archive if agent is None else archive.filter(F.col("agent_id") == agent)
    return rows.orderBy(F.desc("archived_at"), "id").limit(limit)


def prefix(paths: DataFrame, start: str, agent: str | None = None) -> DataFrame:
    """Paths whose address begins like `start`, % and _ as in LIKE, ASCII case ignored."""
    rows = paths if agent is None else paths.filter(F.col("agent_id") == agent)
    return rows.filter(F.lower("uri").like(start.lower() + "%"))


def paths_of(paths: DataFrame, uri: str | None = None, agent: str | None = None, memory_id: str | None = None, domain: str | None = None, path_id: str | None = None) -> DataFrame:
    """Paths by any of their parts, in order of address."""
    for column, value in (("uri", uri), ("agent_id", agent), ("memory_id", memory_id), ("domain", domain), ("id", path_id)):
        paths = paths if value is None else paths.filter(F.col(column) == value)
    return paths.orderBy("uri")


def at_path(memories: DataFrame, paths: DataFrame, uri: str, agent: str) -> DataFrame:
    """(uri, exact, id, content, type, priority, vitality): the agent's addresses that begin like uri, with their memories; exact for uri itself.

    Where the address itself leads to a memory of the agent, that row is the answer. Other addresses
    without such a memory have nulls.
    """
    own = memories.filter(F.col("agent_id") == agent).select(F.col("id").alias("memory_id"), "id", "content", "type", "priority", "vitality")
    rows = prefix(paths, uri, agent).select("uri", "memory_id").unionByName(paths.filter((F.col("agent_id") == agent) & (F.col("uri") == uri)).select("uri", "memory_id")).distinct()
    return rows.join(own, "memory_id", "left").select("uri", ((F.col("uri") == uri) & F.col("id").isNotNull()).alias("exact"), "id", "content", "type", "priority", "vitality")


def totals(memories: DataFrame) -> DataFrame:
    """One row: memories in all and their mean vitality, as before and after a run."""
    return memories.agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.avg("vitality"), F.lit(0.0)).alias("avg_vitality"))


def layers(memories: DataFrame, agent: str | None = None) -> DataFrame:
    """(type, layer_rank, ...): the first of each type, knowledge only while vital."""
    rows = scope(memories, agent).filter((F.col("type") != "knowledge") | (F.col("vitality") >= 0.5))
    order = Window.partitionBy("type").orderBy("priority", F.desc("updated_at"), "id")
    most = F.lit(0)
    for kind, n in LAYERS.items():
        most = F.when(F.col("type") == kind, n).otherwise(most)
    return rows.withColumn("layer_rank", F.row_number().over(order)).filter((F.col("layer_rank") <= max(LAYERS.values())) & (F.col("layer_rank") <= most)).withColumn("layer_rank", F.col("layer_rank").cast("long"))


def boot(memories: DataFrame, paths: DataFrame, agent: str, core: Sequence[str] | DataFrame = CORE_PATHS) -> DataFrame:
    """(id, origin): priority 0 first, then core paths, then what the memory at system://boot lists; each id once.

    core: addresses, or a table of them (uri).
    """
    own = paths.filter(F.col("agent_id") == agent)
    top = listed(memories, agent=agent, priority=0).select("id", F.lit(0).alias("origin"))
    at_core = (own.join(core, "uri", "left_semi") if isinstance(core, DataFrame) else own.filter(F.col("uri").isin(*core))).select(F.col("memory_id").alias("id"), F.lit(1).alias("origin"))
    entry = own.filter(F.col("uri") == "system://boot").select(F.col("memory_id").alias("id")).join(memories.select("id", "content"), "id")
    named = entry.select(F.explode(F.transform(F.split("content", "\n"), text.stripped)).alias("uri")).filter(F.col("uri").rlike("^[a-z]+://"))
    more = own.join(named.distinct(), "uri").select(F.col("memory_id").alias("id"), F.lit(2).alias("origin"))
    return top.unionByName(at_core).unionByName(more).join(memories.select("id"), "id", "left_semi").groupBy("id").agg(F.min("origin").alias("origin"))


def counts(memories: DataFrame) -> DataFrame:
    """(kind, key, n): rows in all, by type and by priority."""
    sets = memories.groupingSets([("type",), ("priority",), ()], "type", "priority").agg(F.count(F.lit(1)).alias("n"), F.grouping("type").alias("gt"), F.grouping("priority").alias("gp"))
    kind: Column = F.when(F.col("gt") == 0, "type").when(F.col("gp") == 0, "priority").otherwise("all")
    key = F.when(F.col("gt") == 0, F.col("type")).when(F.col("gp") == 0, F.concat(F.lit("P"), F.col("priority").cast("string"))).otherwise("all")
    return sets.select(kind.alias("kind"), key.alias("key"), "n")


def capacity(memories: DataFrame, most: Capacity) -> DataFrame:
    """(type, n, capacity) of each type; a null capacity is no limit."""
    cap = memories.sparkSession.createDataFrame(list(most.by_type.items()), "type string, capacity long")
    held = memories.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(cap).join(held, "type", "left").select("type", F.coalesce("n", F.lit(0)).alias("n"), "capacity")


def status(memories: DataFrame, paths: DataFrame, events: DataFrame) -> DataFrame:
    """One row of totals: memories, low vitality, mean vitality, paths, feedback."""
    m = memories.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("vitality") < 0.1).alias("low_vitality"), F.round(F.coalesce(F.avg("vitality"), F.lit(0.0)), 9).alias("avg_vitality"))
    p = paths.agg(F.count(F.lit(1)).alias("paths"))
    e = events.agg(F.count(F.lit(1)).alias("feedback"), F.count_if(F.col("useful") == 1).alias("useful"))
    return m.crossJoin(p).crossJoin(e)


def narrative(layered: DataFrame, now: str, name: str = "Agent") -> DataFrame:
    """(type, line_no, line): the markdown of a warm start, a row a line. now dates the events."""
    from ..functions import scores

    date = F.when(F.col("type") == "event", F.concat(F.lit("["), scores.relative_date(F.col("updated_at"), now), F.lit("] "))).otherwise("")
    return layered.select("type", F.col("layer_rank").alias("line_no"), F.concat(F.lit("- "), date, text.first_line(F.col("content"))).alias("line"))

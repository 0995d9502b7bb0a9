"""From tables of older schema versions to the present one, as pure functions on DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import TABLES, VERSION

Tables = dict[str, DataFrame]


def version_of(tables: Mapping[str, DataFrame]) -> int:
    """The version that the tables' columns tell, where none was recorded."""
    has = lambda name, column: name in tables and column in tables[name].columns
    if "memory_archive" in tables:
        return 8
    for version, sign in ((7, has("memories", "source_session")), (6, has("memories", "emotion_tag")), (5, "feedback_events" in tables and has("feedback_events", "useful")), (4, "maintenance_jobs" in tables), (3, has("embeddings", "provider_id")), (2, has("paths", "agent_id"))):
        if sign:
            return version
    return 1


def _agents(t: Tables) -> Tables:
    """2: paths and links belong to agents; links between memories of different agents go."""
    owner = t["memories"].select(F.col("id").alias("_m"), F.col("agent_id").alias("_a"))
    own = lambda df, key: df.join(owner, df[key] == owner["_m"], "left").drop("_m")
    if "paths" in t and "agent_id" not in t["paths"].columns:
        t["paths"] = own(t["paths"], "memory_id").withColumn("agent_id", F.coalesce("_a", F.lit("default"))).drop("_a")
    if "links" in t and "agent_id" not in t["links"].columns:
        links = own(t["links"], "source_id").withColumnRenamed("_a", "agent_id")
        links = own(links, "target_id")
        t["links"] = links.filter(F.col("agent_id") == F.col("_a")).drop("_a")
    return t


def _embeddings(t: Tables) -> Tables:
    """3: vectors name their provider and the content they were made from."""
    if "embeddings" in t and "provider_id" not in t["embeddings"].columns:
        e = t["embeddings"].join(t["memories"].select(F.col("id").alias("memory_id"), "agent_id", "hash"), "memory_id")
        provider = F.concat_ws(":", F.lit("legacy"), "agent_id", F.col("model") if "model" in e.columns else F.lit("unknown"))
        t["embeddings"] = e.withColumns({"provider_id": provider, "content_hash": F.coalesce("hash", F.lit("")), "status": F.lit("ready"), "id": F.concat_ws("/", "memory_id", provider)})
    return t


def _feedback(t: Tables) -> Tables:
    """5: feedback has a source and says whether it was useful."""
    if "feedback_events" in t and "useful" not in t["feedback_events"].columns:
        useful = F.when(F.col("value") >= 0.5, 1).otherwise(0)
        t["feedback_events"] = t["feedback_events"].withColumns({"useful": useful, "source": F.coalesce(F.substring_index("event_type", ":", 1), F.lit("surface"))})
    return t


def _fill(t: Tables) -> Tables:
    """All columns of the present schema, in order, with defaults; tables that are missing are empty."""
    spark = t["memories"].sparkSession
    defaults = {"agent_id": "default", "relation": "related", "weight": 1.0, "useful": 1, "value": 1.0, "status": "pending", "source": None, "emotion_val": 0.0, "vitality": 1.0, "access_count": 0}
    for name, schema in TABLES.items():
        if name not in t:
            t[name] = spark.createDataFrame([], schema)
            continue
        have = set(t[name].columns)
        columns = [(F.col(f.name) if f.name in have else F.lit(defaults.get(f.name))).cast(f.dataType).alias(f.name) for f in schema]
        t[name] = t[name].select(columns)
    return t


STEPS: dict[int, Callable[[Tables], Tables]] = {2: _agents, 3: _embeddings, 5: _feedback, VERSION: _fill}


def migrate(tables: Mapping[str, DataFrame], version: int | None = None) -> Tables:
    """The tables in the present schema. Migrating twice changes nothing more."""
    at, out = version or version_of(tables), dict(tables)
    for step, change in sorted(STEPS.items()):
        if step > at or step == VERSION:
            out = change(out)
    return out

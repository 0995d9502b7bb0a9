"""Schemas and constants of the memory store. Every time column is an instant; sessions run in UTC."""

from __future__ import annotations

from pyspark.sql import types as T

VERSION = 8
TYPES = ("identity", "emotion", "knowledge", "event")
#: Days a memory's vitality takes to fall to 1/e, by priority; the first stands for "never".
STABILITY = {0: 999999.0, 1: 365.0, 2: 90.0, 3: 14.0}
STABILITY_CAP = 999999.0
DOMAINS = ("core", "emotion", "knowledge", "event", "system")


def _struct(text: str) -> T.StructType:
    kinds = {"s": T.StringType(), "i": T.IntegerType(), "d": T.DoubleType(), "t": T.TimestampType(), "v": T.ArrayType(T.FloatType()), "a": T.ArrayType(T.StringType())}
    return T.StructType([T.StructField(name, kinds[kind[0]], kind[-1] != "!") for name, kind in (part.split(":") for part in text.split())])


_MEMORY = "id:s! content:s! type:s! priority:i! emotion_val:d! vitality:d! stability:d! access_count:i! last_accessed:t created_at:t! updated_at:t! source:s agent_id:s! hash:s emotion_tag:s source_session:s source_context:s observed_at:t"
TABLES: dict[str, T.StructType] = {
    "memories": _struct(_MEMORY),
    "paths": _struct("id:s! memory_id:s! agent_id:s! uri:s! alias:s domain:s! created_at:t!"),
    "links": _struct("agent_id:s! source_id:s! target_id:s! relation:s! weight:d! created_at:t!"),
    "snapshots": _struct("id:s! memory_id:s! content:s! changed_by:s action:s! created_at:t!"),
    "embeddings": _struct("id:s! memory_id:s! provider_id:s! vector:v content_hash:s! status:s! created_at:t! updated_at:t!"),
    "maintenance_jobs": _struct("job_id:s! phase:s! status:s! checkpoint:s error:s started_at:t! finished_at:t"),
    "feedback_events": _struct("id:s! memory_id:s! source:s! useful:i! agent_id:s! event_type:s! value:d! created_at:t!"),
    "memory_archive": _struct(_MEMORY + " archived_at:t! archive_reason:s!"),
}
#: What is made from the memories: the lexical index.
DERIVED: dict[str, T.StructType] = {
    "lexical_tokens": _struct("id:s! agent_id:s tokens:a"),
    "lexical_postings": _struct("id:s! agent_id:s dl:i pos:i term:s"),
}
#: Keys that must be unique, by table.
KEYS = {"memories": ("id",), "paths": ("agent_id", "uri"), "links": ("agent_id", "source_id", "target_id"), "embeddings": ("memory_id", "provider_id"), "feedback_events": ("id",), "memory_archive": ("id",), "maintenance_jobs": ("job_id",)}
#: Columns that name a memory; rows go when the memory goes.
CHILDREN = {"paths": ("memory_id",), "links": ("source_id", "target_id"), "snapshots": ("memory_id",), "embeddings": ("memory_id",), "feedback_events": ("memory_id",)}

"""Tables on disk as versioned Parquet snapshots, and the changes made to them as DataFrame functions.

<root>/<table>/v=<n>/ holds a version; the manifest of the highest number, <root>/manifest-<n>.json, names
the current one of every table. A commit writes new versions of all changed tables first and then the
next manifest, which only one writer can; so readers see all of a change or none, a failed job leaves the
store as it was, and of two writers the later one fails.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scores, text
from ..schemas import CHILDREN, DERIVED, DOMAINS, KEYS, STABILITY, TABLES, VERSION


class ConflictError(Exception):
    """A change would break a key, or was made on an outdated version."""


def _schema(name: str) -> T.StructType:
    return TABLES[name] if name in TABLES else DERIVED[name]


class Store:
    """A store under a root that every executor can reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))
        self._fs = self._path("x").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not self._numbers():
            self._save({"schema": VERSION, "versions": {}}, 0)

    def _numbers(self) -> list[int]:
        found = self._fs.globStatus(self._path("manifest-*.json")) or []
        return sorted(int(re.findall(r"manifest-(\d+)\.json$", f.getPath().getName())[0]) for f in found)

    def _save(self, manifest: dict, number: int) -> None:
        """As a file of another name, then renamed; the number must be free. Some older ones stay for readers."""
        context = self.spark.sparkContext
        new, there = self._path(f"manifest.new-{uuid.uuid4().hex}"), self._path(f"manifest-{number}.json")
        out = self._fs.create(new, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        files = context._jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), context._jsc.hadoopConfiguration())
        none = context._gateway.new_array(getattr(context._jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            files.rename(files.makeQualified(new), files.makeQualified(there), none)
        except Exception as e:
            self._fs.delete(new, False)
            raise ConflictError("the store changed meanwhile") from e
        for old in self._numbers()[:-20]:
            self._fs.delete(self._path(f"manifest-{old}.json"), False)

    @property
    def manifest(self) -> dict:
        return self._current()[1]

    def _current(self) -> tuple[int, dict]:
        number = self._numbers()[-1]
        stream = self._fs.open(self._path(f"manifest-{number}.json"))
        try:
            return number, json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, name: str) -> DataFrame:
        """The current version, empty where there is none. Conditions on it reach the Parquet scan."""
        version = self.manifest["versions"].get(name)
        if version is None:
            return self.spark.createDataFrame([], _schema(name))
        return self.spark.read.schema(_schema(name)).parquet(f"{self.root}/{name}/v={version}")

    def commit(self, changes: Mapping[str, DataFrame], check: bool = True) -> None:
        """Writes new versions of the tables, checks their keys, and makes them current together."""
        number, before = self._current()
        versions = dict(before["versions"])
        for name, df in changes.items():
            version = versions.get(name, 0) + 1
            while self._fs.exists(self._path(name, f"v={version}")):  # left by a commit that failed
                version += 1
            df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in _schema(name)]).write.parquet(f"{self.root}/{name}/v={version}")
            versions[name] = version
            if check:
                written = self.spark.read.schema(_schema(name)).parquet(f"{self.root}/{name}/v={version}")
                self._check(name, written)
        indexed = versions.get("memories") if {"lexical_tokens", "lexical_postings"} <= changes.keys() else before.get("indexed")
        self._save({"schema": VERSION, "versions": versions, "indexed": indexed}, number + 1)

    @property
    def indexed(self) -> bool:
        """Whether the stored lexical index is that of the current memories."""
        told = self.manifest
        return told.get("indexed") is not None and told["indexed"] == told["versions"].get("memories")

    @staticmethod
    def _check(name: str, df: DataFrame) -> None:
        keys = [KEYS[name]] if name in KEYS else []
        keys += [("agent_id", "hash")] if name == "memories" else []
        for key in keys:
            twice = df.filter(F.coalesce(*[F.col(k) for k in key[-1:]]).isNotNull()).groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).collect()
            if twice:
                raise ConflictError(f"{name}: {key} isn't unique: {twice[0]}")


def new_memories(items: DataFrame, now: datetime | str) -> DataFrame:
    """Full memory rows of items (id, content, type and what else of the columns they have)."""
    has = set(items.columns)
    get = lambda name, default: F.coalesce(F.col(name), default) if name in has else default
    at = scores.instant(now)
    priority = get("priority", scores.lookup(F.col("type"), {"identity": 0, "emotion": 1, "knowledge": 2}, 3)).cast("int")
    rows = items.withColumn("priority", priority)
    values: dict[str, Column] = {
        "id": F.col("id"), "content": F.col("content"), "type": F.col("type"), "priority": F.col("priority"), "emotion_val": get("emotion_val", F.lit(0.0)), "vitality": F.lit(1.0), "stability": scores.lookup(F.col("priority"), STABILITY, 14.0),
        "access_count": F.lit(0), "last_accessed": F.lit(None).cast("timestamp"), "created_at": at, "updated_at": at, "source": get("source", F.lit(None)), "agent_id": get("agent_id", F.lit("default")), "hash": text.content_hash(F.col("content")),
        "emotion_tag": get("emotion_tag", F.lit(None)), "source_session": get("source_session", F.lit(None)), "source_context": F.substring(get("source_context", F.lit(None).cast("string")), 1, 200), "observed_at": get("observed_at", F.lit(None).cast("timestamp")),
    }
    return rows.select([v.cast(TABLES["memories"][k].dataType).alias(k) for k, v in values.items()])


def insert(memories: DataFrame, new: DataFrame) -> DataFrame:
    """memories and those of new whose content its agent hasn't yet; of equal ones the least id."""
    first = Window.partitionBy("agent_id", "hash").orderBy("id")
    fresh = new.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n").join(memories.select("agent_id", "hash"), ["agent_id", "hash"], "left_anti")
    return memories.unionByName(fresh.select(memories.columns), allowMissingColumns=True)


def update_content(memories: DataFrame, changes: DataFrame, now: datetime | str) -> DataFrame:
    """memories with new content (id, content), their hash and updated_at to match."""
    joined = memories.join(changes.select("id", F.col("content").alias("_c")), "id", "left")
    hit = F.col("_c").isNotNull()
    new = {"content": F.coalesce("_c", "content"), "hash": F.when(hit, text.content_hash(F.col("_c"))).otherwise(F.col("hash")), "updated_at": F.when(hit, scores.instant(now)).otherwise(F.col("updated_at"))}
    return joined.withColumns(new).select(memories.columns)


def delete(tables: Mapping[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """The tables without the memories `ids` (id) and what belongs to them."""
    out = {}
    for name, df in tables.items():
        for column in ("id",) if name == "memories" else CHILDREN.get(name, ()):
            df = df.join(ids.select(F.col("id").alias(column)).distinct(), column, "left_anti").select(df.columns)
        out[name] = df
    return out


def archive(memories: DataFrame, old: DataFrame, ids: DataFrame, now: datetime | str, min_vitality: float = 0.1, reason: str = "eviction") -> tuple[DataFrame, DataFrame]:
    """(memories, archive) after `ids` left: the vital ones are archived, in place of an earlier copy; the rest is gone."""
    gone = memories.join(ids.select("id").distinct(), "id", "left_semi")
    kept = gone.filter(F.col("vitality") >= min_vitality).withColumns({"archived_at": scores.instant(now), "archive_reason": F.lit(reason)})
    rest = old.join(kept.select("id"), "id", "left_anti").select(old.columns)
    return memories.join(gone.select("id"), "id", "left_anti").select(memories.columns), rest.unionByName(kept.select(old.columns))


def restore(memories: DataFrame, old: DataFrame, ids: DataFrame, now: datetime | str) -> tuple[DataFrame, DataFrame]:
    """(memories, archive) after `ids` came back, updated now; paths, links and feedback don't come back."""
    back = old.join(ids.select("id").distinct(), "id", "left_semi").withColumn("updated_at", scores.instant(now))
    return memories.unionByName(back.select(memories.columns)), old.join(back.select("id"), "id", "left_anti").select(old.columns)


def purge(old: DataFrame, agent: str | None = None) -> DataFrame:
    """The archive after a purge, of one agent or of all."""
    return old.filter(F.lit(False) if agent is None else F.col("agent_id") != agent)


def forget_softly(memories: DataFrame, ids: DataFrame, now: datetime | str) -> DataFrame:
    """A tenth of the vitality is left of `ids`."""
    joined = memories.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    hit = F.col("_hit").isNotNull()
    return joined.withColumns({"vitality": F.when(hit, F.greatest(F.lit(0.0), F.col("vitality") * 0.1)).otherwise(F.col("vitality")), "updated_at": F.when(hit, scores.instant(now)).otherwise(F.col("updated_at"))}).select(memories.columns)


def insert_or_ignore(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """old and those of new whose key isn't there yet."""
    return old.unionByName(new.dropDuplicates(list(key)).join(old.select(*key), list(key), "left_anti").select(old.columns))


def insert_or_replace(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """new, and of old what new doesn't replace."""
    return old.join(new.select(*key), list(key), "left_anti").select(old.columns).unionByName(new.dropDuplicates(list(key)).select(old.columns))


def create_paths(paths: DataFrame, new: DataFrame, memories: DataFrame) -> DataFrame:
    """paths and those of new (id, memory_id, agent_id, uri, alias, created_at) that are valid; see rejected_paths for the others."""
    told = _judged_paths(paths, new, memories)
    return paths.unionByName(told.filter("reason is null").select(paths.columns))


def rejected_paths(paths: DataFrame, new: DataFrame, memories: DataFrame) -> DataFrame:
    """Of new those that can't be created, with the reason: domain, memory, agent or taken."""
    return _judged_paths(paths, new, memories).filter("reason is not null").select(*new.columns, "reason")


def _judged_paths(paths: DataFrame, new: DataFrame, memories: DataFrame) -> DataFrame:
    """new with `domain` and `reason`: null for a known domain, an existing memory of the agent, and an address that the agent doesn't use."""
    owner = memories.select(F.col("id").alias("memory_id"), F.col("agent_id").alias("_owner"))
    used = paths.select("agent_id", "uri").distinct().withColumn("_used", F.lit(True))
    rows = new.withColumn("domain", text.uri_domain(F.col("uri"))).join(owner, "memory_id", "left").join(used, ["agent_id", "uri"], "left")
    known = F.coalesce(F.col("domain").isin(*DOMAINS), F.lit(False))
    reason = F.when(~known, "domain").when(F.col("_owner").isNull(), "memory").when(F.col("_owner") != F.col("agent_id"), "agent").when(F.col("_used"), "taken")
    first = Window.partitionBy("agent_id", "uri", F.col("reason").isNull()).orderBy("id")
    rows = rows.withColumn("reason", reason)
    return rows.withColumn("reason", F.when(F.col("reason").isNull() & (F.row_number().over(first) > 1), "taken").otherwise(F.col("reason"))).drop("_owner", "_used")


def delete_paths(paths: DataFrame, ids: DataFrame | None = None, memories: DataFrame | None = None) -> DataFrame:
    """paths without those of `ids` (id) and without those that lead to `memories` (id)."""
    for some, column in ((ids, "id"), (memories, "memory_id")):
        if some is not None:
            paths = paths.join(some.select(F.col("id").alias(column)).distinct(), column, "left_anti").select(paths.columns)
    return paths


#: What a partial update can't change: `hash` and `updated_at` follow.
FIXED = ("id", "hash", "updated_at", "created_at")


def update(memories: DataFrame, changes: DataFrame, now: datetime | str) -> DataFrame:
    """memories with the columns of changes (id and any others) where those aren't null; a new content is hashed anew, updated_at moves.

    Vectors of changed contents are pended by vector.after_change, index entries made anew by index.changed.
    """
    own = [c for c in changes.columns if c not in FIXED]
    joined = memories.join(changes.select("id", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in own]), "id", "left")
    new = {c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in own}
    if "content" in own:
        new["hash"] = F.when(F.col("_content").isNotNull(), text.content_hash(F.col("_content"))).otherwise(F.col("hash"))
    new["updated_at"] = F.when(F.col("_hit"), scores.instant(now)).otherwise(F.col("updated_at"))
    return joined.withColumns(new).select(memories.columns)

"""Applying a batch of incoming texts to the store's tables."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..lineage import settle
from ..sources import tables
from . import guard
from .index import Index


def sync(store: Mapping[str, DataFrame], incoming: DataFrame, now: datetime | str, near: DataFrame | None = None, conservative: bool = False, index: Index | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """(changed tables, outcomes) of writing a batch, judged against one state of the store.

    incoming: (seq, content, type, agent_id, uri, source, created_at). Within the batch, texts equal for an
    agent count once, by least seq; of those with one address the last decides its content; merges into one
    memory are made in order of seq, each with what the earlier ones left. Two new texts that only resemble
    each other are both added: write them in two batches where that matters.

    Outcomes: (seq, action, memory_id, step). New ids are made from the agent and the content's hash.
    """
    memories, paths, links = store["memories"], store["paths"], store["links"]
    rows = incoming.withColumn("hash", text.content_hash(F.col("content")))
    first = Window.partitionBy("agent_id", "hash").orderBy("seq")
    single = rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    latest = Window.partitionBy("agent_id", "uri").orderBy(F.desc("seq"))
    single = single.withColumn("_n", F.when(F.col("uri").isNotNull(), F.row_number().over(latest)).otherwise(1)).filter("_n = 1").drop("_n", "hash")
    single = settle(single)
    told, found = guard.judge(single, memories, paths, near, conservative, index)
    judged = single.join(told, "seq")
    fresh = F.concat(F.lit("m-"), F.substring(F.sha2(F.concat_ws("\x1f", "agent_id", text.content_hash(F.col("content"))), 256), 1, 32))
    judged = settle(judged.withColumn("memory_id", F.when(F.col("action") == "add", fresh).otherwise(F.col("target_id").cast("string"))))
    new = tables.new_memories(judged.filter("action = 'add'").withColumn("id", F.col("memory_id")).select("id", "content", "type", "agent_id", "source"), now)

    merges = judged.filter("action = 'merge'").groupBy("memory_id").agg(F.sort_array(F.collect_list(F.struct("seq", "content"))).alias("_in"))
    olds = merges.join(memories.select(F.col("id").alias("memory_id"), F.col("content").alias("_old"), F.col("type").alias("_kind")), "memory_id")
    folded = olds.select(F.col("memory_id").alias("id"), F.aggregate("_in", F.col("_old"), lambda acc, x: guard.merged(F.col("_kind"), acc, x["content"])).alias("content"))
    updates = judged.filter("action = 'update' and new_content is not null").groupBy(F.col("memory_id").alias("id")).agg(F.max_by("new_content", "seq").alias("content"))
    changes = updates.unionByName(folded.join(updates.select("id"), "id", "left_anti"))
    after = settle(tables.insert(tables.update_content(memories, changes, now), new))

    addressed = judged.filter("uri is not null and action <> 'skip'").withColumns({"id": F.concat(F.lit("p-"), F.substring(F.sha2(F.concat_ws("\x1f", "agent_id", "uri"), 256), 1, 32)), "alias": F.lit(None).cast("string"), "domain": text.uri_domain(F.col("uri")), "created_at": F.lit(str(now)).cast("timestamp")})
    new_paths = tables.create_paths(paths, addressed.select("id", "memory_id", "agent_id", "uri", "alias", "domain", "created_at"), after)

    open_rows = judged.filter("step = 'candidates' and action in ('add', 'merge')")
    pairs = guard.auto_links(found.withColumn("id", F.col("id").cast("string")), open_rows.select("seq", F.col("memory_id").alias("id")))
    owner = after.select(F.col("id").alias("source_id"), "agent_id")
    new_links = pairs.join(owner, "source_id").select("agent_id", "source_id", "target_id", F.lit("related").alias("relation"), "weight", F.lit(str(now)).cast("timestamp").alias("created_at"))
    out = {"memories": after, "paths": new_paths, "links": tables.insert_or_ignore(links, new_links.select(links.columns), ["agent_id", "source_id", "target_id"])}
    return out, judged.select("seq", "action", "memory_id", "step")


def sync_in_order(store: dict[str, DataFrame], incoming: DataFrame, now: datetime | str, keep=lambda tables_: tables_) -> tuple[dict[str, DataFrame], list[tuple[int, str, str | None, str]]]:
    """The same one by one, each text seeing what the ones before it wrote; for small batches.

    keep is called after each step and should cut the tables' lineage, as by a commit and a read.
    """
    state, outcomes = dict(store), []
    for seq in [r["seq"] for r in incoming.select("seq").orderBy("seq").collect()]:  # a step each, so few
        changed, told = sync(state, incoming.filter(F.col("seq") == seq), now)
        outcomes += [tuple(r) for r in told.collect()]
        state |= keep(changed)
    return state, outcomes

"""Queries that run a job or a stream to its end; what SQL can tell of them is told."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from ..lineage import discard, scratch, settle
from ..operators import feedback, lifecycle, writing
from ..operators.index import Index
from ..schemas import TABLES
from ..streaming import flows
from . import views as v
from . import write
from .registry import Registry

R = Registry()


def _streamed(spark, d, table):
    """The rows of a provided table as a stream."""
    return spark.readStream.schema(spark.read.parquet(f"{d}/{table}.parquet").schema).option("pathGlobFilter", f"{table}.parquet").option("recursiveFileLookup", True).parquet(d)


def _finished(stream, spark, mode="append"):
    """All rows of a stream, once it has read what there is; written to the scratch folder and read from there."""
    folder = scratch(spark)
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/out").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


LIMITED = f"WITH {v.FB}, s AS (SELECT memory_id, list_sort(list(epoch_us(created_at))) AS t FROM fb WHERE source = 'passive' GROUP BY memory_id), a AS (SELECT memory_id, list_reduce(list_transform(t, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y > x[1] - 86400000000)) < 3 THEN list_concat(acc, x) ELSE acc END, []::BIGINT[]) AS ok FROM s) SELECT memory_id, unnest(ok) AS at_us FROM a"


@R.add(LIMITED)
def stream_limiter(spark, d):
    events = _streamed(spark, d, "events").filter(F.col("event_type").isin("view", "click")).select(F.col("user_id").alias("memory_id"), F.col("ts").cast("timestamp").alias("created_at"))
    return _finished(flows.limit_passive(events), spark)


@R.add(f"WITH {v.FB} SELECT * FROM (SELECT epoch_us(time_bucket(INTERVAL 1 DAY, created_at)) AS start_us, source, count(*) AS n, round(sum(value), 6) AS value FROM fb GROUP BY ALL) WHERE start_us + 86400000000 <= (SELECT epoch_us(max(created_at)) - 86400000000 FROM fb)")
def stream_rollup(spark, d):
    events = _streamed(spark, d, "events")
    kinds = F.when(F.col("event_type").isin("view", "click"), "passive").when(F.col("event_type") == "purchase", "recall").otherwise("surface")
    value = F.when(kinds == "passive", 0.7).when(kinds == "recall", 1.0).otherwise(0.0)
    rows = events.select(F.col("ts").cast("timestamp").alias("created_at"), kinds.alias("source"), value.alias("value"))
    """The days that are closed: those that end at or before the last event less the allowed lateness."""
    out = _finished(flows.rollup(rows, window="1 day"), spark)
    return out.select(F.unix_micros("start").alias("start_us"), "source", "n", F.round("value", 6).alias("value"))


def _renamed(sql, name):
    """The SQL over another table of memories."""
    return re.sub(r"\bmem\b", name, sql)


#: Decay, tidying and governing, each on what the one before left.
REFLECT = f"""{write.DEC}, d1 AS (SELECT mem.* REPLACE (CASE WHEN abs(dec.vitality - dec.old) > 0.001 THEN dec.vitality ELSE mem.vitality END AS vitality) FROM mem LEFT JOIN dec USING (id)),
{write.STALE_SQL.replace(write.STALE_MEM, "sm AS (SELECT * FROM d1)").replace("2024-02-05 00:00:00", v.NOW)},
d2 AS (SELECT sm.* REPLACE (round(coalesce(sd.vitality, sm.vitality), 9) AS vitality) FROM sm LEFT JOIN sd USING (id) WHERE NOT (sm.vitality < 0.05 AND priority >= 2)),
{_renamed(write.EVI.replace(v.TOK, v.TOK), "d2")}, {_renamed(write.QUOTA.replace("150", "250"), "d2")},
second_ AS (SELECT id FROM (SELECT id, row_number() OVER (ORDER BY score DESC, priority, id) AS r FROM evi WHERE id NOT IN (SELECT id FROM first_)) WHERE r <= (SELECT count(*) FROM d2) - (SELECT count(*) FROM first_) - 350),
gone AS (SELECT id FROM first_ UNION ALL SELECT id FROM second_)
SELECT 'decay' AS phase, unnest(['updated', 'decayed', 'below_threshold']) AS kind, unnest([count_if(abs(vitality - old) > 0.001), count_if(abs(vitality - old) > 0.001 AND vitality < old), count_if(abs(vitality - old) > 0.001 AND vitality < 0.05)])::BIGINT AS n FROM dec
UNION ALL SELECT 'tidy', 'removed', (SELECT count(*) FROM d1) - (SELECT count(*) FROM d2)
UNION ALL SELECT 'govern', unnest(['orphan_paths', 'empty_memories', 'evicted', 'archived', 'left', 'paths']), unnest([(SELECT count(*) FROM pth WHERE memory_id NOT IN (SELECT id FROM d2)), 0, (SELECT count(*) FROM gone), (SELECT count(*) FROM gone JOIN d2 USING (id) WHERE vitality >= 0.1),
  (SELECT count(*) FROM d2) - (SELECT count(*) FROM gone), (SELECT count(*) FROM pth WHERE memory_id IN (SELECT id FROM d2) AND memory_id NOT IN (SELECT id FROM gone))])"""


@R.add(REFLECT.replace("FROM mem WHERE priority > 0)", f"FROM mem WHERE priority > 0), {v.PTH}", 1))
def reflect_orchestrate(spark, d):
    """Decay, tidying and governing in order, each on what the one before left; a row a count."""
    state = {"mem": write._stored(v.memories(spark, d))}

    def decay(now):
        told = settle(lifecycle.decay(state["mem"], now))
        state["mem"] = settle(lifecycle.with_vitality(state["mem"], told.filter("changed").select("id", "vitality"), now))
        return lifecycle.decay_summary(told).first().asDict()

    def tidy(now):
        before = state["mem"].count()
        state["mem"] = settle(lifecycle.tidy(state["mem"], now).withColumn("vitality", F.round("vitality", 9)))
        return {"removed": before - state["mem"].count()}

    def govern(now):
        mem = state["mem"]
        archive = mem.filter("false").withColumns({"archived_at": F.col("updated_at"), "archive_reason": F.lit("")})
        out, told = lifecycle.govern(mem, v.paths(spark, d), archive, feedback.penalty(v.feedback(spark, d)), now, index=v.lexical_index(spark, d))
        return told.first().asDict() | {"left": out["memories"].count(), "paths": out["paths"].count()}

    told = lifecycle.reflect({"decay": decay, "tidy": tidy, "govern": govern}, v.NOW)
    return spark.createDataFrame([(phase, key, int(n)) for phase, result in told["results"].items() for key, n in result.items()], "phase string, kind string, n long")


#: One row for each text of an agent, and for each of its addresses the last.
WRITTEN = f"""{write.cand_sql(False, "WHERE seq IN (SELECT seq FROM (SELECT seq, agent_id, uri, row_number() OVER (PARTITION BY agent_id, regexp_replace(content, '^\\s+|\\s+$', '', 'g') ORDER BY seq) AS n FROM inc0) WHERE n = 1 QUALIFY uri IS NULL OR row_number() OVER (PARTITION BY agent_id, uri ORDER BY seq DESC) = 1)")},
acted AS (SELECT told.*, inc.uri, inc.agent_id, CASE WHEN action = 'add' THEN 'm' || told.seq ELSE CAST(target_id AS VARCHAR) END AS own FROM told JOIN inc USING (seq)),
lk AS (SELECT own, CAST(cand.id AS VARCHAR) AS other FROM cand JOIN acted USING (seq) WHERE step = 'candidates' AND action IN ('add', 'merge') AND cand.dedup_score >= 0.45 AND cand.dedup_score < 0.82 AND CAST(cand.id AS VARCHAR) <> own QUALIFY row_number() OVER (PARTITION BY seq ORDER BY cand.dedup_score DESC, cand.id) <= 5)
SELECT 'action ' || action AS kind, count(*) AS n FROM acted GROUP BY action
UNION ALL SELECT 'table memories', (SELECT count(*) FROM mem) + (SELECT count(*) FROM acted WHERE action = 'add')
UNION ALL SELECT 'table paths', count(*) FROM acted WHERE uri IS NOT NULL AND action <> 'skip'
UNION ALL SELECT 'table links', count(*) FROM (SELECT own, other FROM lk UNION SELECT other, own FROM lk)"""


@R.add(_renamed(WRITTEN, "memt").replace(v.MEM.replace("mem AS", "memt AS"), v.MEM + ", memt AS (SELECT * REPLACE (lpad(CAST(id AS VARCHAR), 12, '0') AS id) FROM mem)", 1).replace(_renamed(v.INC, "memt").replace("inc AS", "inc0 AS", 1), v.INC.replace("inc AS", "inc0 AS", 1)).replace("NULL::BIGINT AS id, NULL::VARCHAR AS old_uri", "NULL::VARCHAR AS id, NULL::VARCHAR AS old_uri").replace("coalesce(CASE WHEN same.seq IS NOT NULL THEN same.same WHEN taken.seq IS NOT NULL THEN at_uri WHEN", "coalesce(CASE WHEN same.seq IS NOT NULL THEN same.same WHEN").replace("best.id END, -1)", "best.id END, '-1')"))
def write_batch(spark, d):
    """What a batch of incoming texts does to the store: outcomes by action, and rows of each table after it."""
    name = lambda c: F.lpad(F.col(c).cast("string"), 12, "0")
    mem = write._stored(v.memories(spark, d)).withColumn("id", name("id"))
    index = v.lexical_index(spark, d)
    index = Index(index.tokens.withColumn("id", name("id")), index.postings.withColumn("id", name("id")))
    empty = {name: spark.createDataFrame([], TABLES[name]) for name in ("paths", "links")}
    changed, told = writing.sync({"memories": mem, **empty}, v.incoming(spark, d), v.NOW, index=index)
    rows = told.groupBy(F.concat(F.lit("action "), "action").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    for table, df in changed.items():
        rows = rows.unionByName(df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(f"table {table}").alias("kind"), "n"))
    return rows


@R.add(f"WITH {write.ING} SELECT type, count(*) AS n FROM c WHERE content <> '' AND NOT regexp_matches(content, '(?i)heartbeat_ok|session_status') GROUP BY type")
def stream_ingest(spark, d):
    """Markdown made of the pages, read as a stream and cut into items: (type, n)."""
    folder = scratch(spark)
    files = write._files(spark, d)
    files.select("text", (F.col("file") % 8).alias("part")).write.mode("overwrite").partitionBy("part").text(f"{folder}/in", lineSep="\n")
    schema_rows = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(f"{folder}/in")
    stream = schema_rows.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("at"))
    name = f"items_{uuid.uuid4().hex}"
    found = []
    query = flows.ingest(stream, lambda items, n: found.extend(map(tuple, items.groupBy("type").count().collect())), f"{folder}/checkpoint-{name}", once=True)
    query.awaitTermination()
    discard(spark, folder)
    total: dict[str, int] = {}
    for kind, n in found:
        total[kind] = total.get(kind, 0) + n
    return spark.createDataFrame(sorted(total.items()), "type string, n long")

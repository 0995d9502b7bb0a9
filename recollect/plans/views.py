"""Memory-shaped views over the provided tables, as DataFrames and as the SQL that means the same."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores, text
from ..lineage import shared_folder, spread
from ..operators import index
from ..schemas import STABILITY

NOW = "2024-03-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _kind(c: str):
    return F.get(F.array(*[F.lit(x) for x in ("identity", "emotion", "knowledge", "event")]), F.pmod(F.col(c), F.lit(4)).cast("int"))


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    day0 = F.lit("2024-01-01 00:00:00").cast("timestamp")
    hours = lambda n: F.make_dt_interval(F.lit(0), n)
    i = F.col("doc_id")
    stability = F.get(F.array(*[F.lit(STABILITY[p]) for p in range(4)]), F.pmod(i, F.lit(4)).cast("int"))
    rows = table(spark, sf_dir, "documents").select(
        i.alias("id"), F.col("text").alias("content"), _kind("doc_id").alias("type"), (i % 4).cast("int").alias("priority"), F.lit(0.0).alias("emotion_val"), ((1 + i % 20) / 20.0).alias("vitality"), stability.alias("stability"),
        (i % 7).cast("int").alias("access_count"), (day0 + hours(i.cast("int"))).alias("created_at"), (day0 + hours((i + i % 97).cast("int"))).alias("updated_at"), F.col("source"), F.col("source").alias("agent_id"), text.content_hash(F.col("text")).alias("hash"), F.col("lang").alias("emotion_tag"),
    )
    return rows.withColumn("last_accessed", F.when(F.col("id") % 3 != 0, F.col("updated_at")))


MEM = r"""mem AS (SELECT *, CASE WHEN id % 3 <> 0 THEN updated_at END AS last_accessed FROM (
  SELECT doc_id AS id, text AS content, (['identity', 'emotion', 'knowledge', 'event'])[CAST(doc_id % 4 + 1 AS INT)] AS type, CAST(doc_id % 4 AS INT) AS priority,
  CAST(1 + doc_id % 20 AS DOUBLE) / 20.0::DOUBLE AS vitality, ([999999.0::DOUBLE, 365, 90, 14])[CAST(doc_id % 4 + 1 AS INT)] AS stability, CAST(doc_id % 7 AS INT) AS access_count,
  TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id) AS created_at, TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id + doc_id % 97) AS updated_at,
  source, source AS agent_id, substr(sha256(regexp_replace(text, '^\s+|\s+$', '', 'g')), 1, 16) AS hash, lang AS emotion_tag FROM documents))"""


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.when(F.col("event_type").isin("view", "click"), "passive").when(F.col("event_type") == "purchase", "recall").otherwise("surface")
    useful = F.when(F.col("event_type").isin("view", "click", "purchase"), 1).otherwise(0)
    value = F.when(source == "passive", 0.7).otherwise(useful.cast("double"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("memory_id"), source.alias("source"), useful.alias("useful"), F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("agent_id"), value.alias("value"), F.col("ts").cast("timestamp").alias("created_at"))


FB = """fb AS (SELECT event_id AS id, user_id AS memory_id, CASE WHEN event_type IN ('view', 'click') THEN 'passive' WHEN event_type = 'purchase' THEN 'recall' ELSE 'surface' END AS source,
  CASE WHEN event_type IN ('view', 'click', 'purchase') THEN 1 ELSE 0 END AS useful, 'src' || (user_id % 20) AS agent_id,
  CASE WHEN event_type IN ('view', 'click') THEN 0.7::DOUBLE WHEN event_type = 'purchase' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value, ts AS created_at FROM events)"""


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector n belongs to memory n; every fifth was made from other content, every seventh isn't ready."""
    mem = memories(spark, sf_dir).select(F.col("id").alias("memory_id"), "hash")
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("memory_id"), F.col("embedding").alias("vector"))
    status = F.when(F.col("memory_id") % 7 == 3, "pending").otherwise("ready")
    return rows.join(mem, "memory_id").select("memory_id", F.lit("p").alias("provider_id"), "vector", F.when(F.col("memory_id") % 5 == 4, "old").otherwise(F.col("hash")).alias("content_hash"), status.alias("status"))


EMB = """emb AS (SELECT vec_id AS memory_id, CAST(embedding AS DOUBLE[]) AS vector, CASE WHEN vec_id % 5 = 4 THEN 'old' ELSE m.hash END AS content_hash, CASE WHEN vec_id % 7 = 3 THEN 'pending' ELSE 'ready' END AS status
  FROM embeddings JOIN mem m ON m.id = vec_id)"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("k"))
    return rows.select(F.col("doc_id").alias("source_id"), ((F.col("doc_id") * 7 + F.col("k") * 3) % 1000).alias("target_id"), ((F.col("doc_id") + F.col("k")) % 10 / 10.0).alias("weight")).dropDuplicates(["source_id", "target_id"])


LNK = "lnk AS (SELECT doc_id AS source_id, (doc_id * 7 + k * 3) % 1000 AS target_id, CAST((doc_id + k) % 10 AS DOUBLE) / 10.0::DOUBLE AS weight FROM documents, range(1, 8) r(k))"


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path for each page, to memory page_id * 9; some of these don't exist. Domains vary."""
    day0 = F.lit("2024-01-01 00:00:00").cast("timestamp")
    uri = F.concat(F.get(F.array(*[F.lit(x) for x in ("core", "emotion", "knowledge", "event", "system")]), F.pmod(F.col("page_id"), F.lit(5)).cast("int")), F.lit("://"), F.regexp_replace("url", "^[a-z]+://", ""))
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), (F.col("page_id") * 9).alias("memory_id"), F.concat(F.lit("src"), (F.col("page_id") % 20).cast("string")).alias("agent_id"), uri.alias("uri"), (day0 + F.make_dt_interval(F.lit(0), F.col("page_id").cast("int"))).alias("created_at"))


PTH = r"""pth AS (SELECT page_id AS id, page_id * 9 AS memory_id, 'src' || (page_id % 20) AS agent_id, (['core', 'emotion', 'knowledge', 'event', 'system'])[CAST(page_id % 5 + 1 AS INT)] || '://' || regexp_replace(url, '^[a-z]+://', '') AS uri,
  TIMESTAMP '2024-01-01 00:00:00' + to_hours(page_id) AS created_at FROM pages)"""


PREFIXES = {2: "Herewith otherwise nonetheless ", 3: "Herewith otherwise nonetheless perhaps likewise moreover thereby hence "}


def _variant():
    i, c = F.col("id") % 4, F.col("content")
    return F.when(i == 0, c).when(i == 1, F.concat(c, F.lit(" Moreover"))).when(i == 2, F.concat(F.lit(PREFIXES[2]), c)).otherwise(F.concat(F.lit(PREFIXES[3]), c))


def incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts to be written: all passages (numbered from -1 down), and all documents again, as they are or with changes; some have an address."""
    columns = ["seq", "content", "type", "agent_id", "uri", "source", "created_at"]
    at = F.lit("2024-02-01 00:00:00").cast("timestamp")
    new = table(spark, sf_dir, "benchmark").select((-1 - F.col("item_id")).alias("seq"), F.col("text").alias("content"), _kind("item_id").alias("type"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("agent_id"), F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("core://bench/"), F.col("item_id").cast("string"))).alias("uri"), F.lit(None).cast("string").alias("source"), at.alias("created_at"))
    again = memories(spark, sf_dir).select(F.col("id").alias("seq"), _variant().alias("content"), "type", "agent_id", F.when(F.col("id") % 3 == 0, F.concat(F.lit("core://again/"), F.col("id").cast("string"))).alias("uri"), F.lit(None).cast("string").alias("source"), F.col("created_at"))
    return new.select(columns).unionByName(spread(again.select(columns)))


INC = f"""inc AS (SELECT -1 - item_id AS seq, text AS content, (['identity', 'emotion', 'knowledge', 'event'])[CAST(item_id % 4 + 1 AS INT)] AS type, 'src' || (item_id % 20) AS agent_id, CASE WHEN item_id % 3 = 0 THEN 'core://bench/' || item_id END AS uri, TIMESTAMP '2024-02-01 00:00:00' AS created_at FROM benchmark
  UNION ALL SELECT id, CASE id % 4 WHEN 0 THEN content WHEN 1 THEN content || ' Moreover' WHEN 2 THEN '{PREFIXES[2]}' || content ELSE '{PREFIXES[3]}' || content END, type, agent_id, CASE WHEN id % 3 = 0 THEN 'core://again/' || id END, created_at FROM mem)"""


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of memories, to three of some; some are those that incoming texts have."""
    mem = memories(spark, sf_dir).select(F.col("id").alias("memory_id"), "agent_id", "created_at")
    made = lambda every, start, after: mem.filter(F.col("memory_id") % every == 0).select("memory_id", "agent_id", F.concat(F.lit(start), F.col("memory_id").cast("string")).alias("uri"), (F.col("created_at") + F.make_dt_interval(F.lit(after))).alias("created_at"))
    return paths(spark, sf_dir).select("memory_id", "agent_id", "uri", "created_at").unionByName(made(15, "core://again/", 0)).unionByName(made(6, "knowledge://later/", 1))


ADR = """adr AS (SELECT memory_id, agent_id, uri, created_at FROM pth UNION ALL SELECT id, agent_id, 'core://again/' || id, created_at FROM mem WHERE id % 15 = 0
  UNION ALL SELECT id, agent_id, 'knowledge://later/' || id, created_at + INTERVAL 1 DAY FROM mem WHERE id % 6 = 0)"""


def vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, id, similarity): of each text that has a vector, the memory four further."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("seq"), F.col("embedding").alias("e"))
    other = e.select((F.col("seq") - 4).alias("seq"), F.col("seq").alias("id"), F.col("e").alias("o"))
    return e.join(other, "seq").select("seq", "id", F.round(scores.cosine(F.col("e"), F.col("o")), 4).alias("similarity"))


NEAR = """nr AS (SELECT seq, id, round(list_inner_product(e, o) / (sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(o, o))), 4) AS similarity
  FROM (SELECT a.vec_id AS seq, b.vec_id AS id, CAST(a.embedding AS DOUBLE[]) AS e, CAST(b.embedding AS DOUBLE[]) AS o FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 4))"""


def lexical_index(spark: SparkSession, sf_dir: str) -> index.Index:
    """The index of the memories, stored in the shared folder under the name of the table's present version; built there by the first query that needs it."""
    files = table(spark, sf_dir, "documents").inputFiles()
    jvm, told = spark.sparkContext._jvm, hashlib.sha256()
    for file in sorted(files):
        path = jvm.org.apache.hadoop.fs.Path(file)
        status = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path)
        told.update(f"{file} {status.getLen()} {status.getModificationTime()}\n".encode())
    return index.kept(memories(spark, sf_dir), f"{shared_folder(spark).rstrip('/')}/lexical-index-{told.hexdigest()[:20]}")


def tokens_sql(name: str, source: str, key: str = "id", column: str = "content") -> str:
    """CTE `name` (id, token, pos): tokenize() of a column, for text without CJK letters."""
    return rf"""{name}_w AS (SELECT {key} AS id, regexp_split_to_array(regexp_replace({column}, '[^A-Za-z0-9_\s]', ' ', 'g'), '\s+') AS w FROM {source}),
{name}_u AS (SELECT id, unnest(w) AS token, generate_subscripts(w, 1) AS i FROM {name}_w),
{name}_f AS (SELECT id, token, min(i) AS i FROM {name}_u WHERE len(token) > 1 GROUP BY id, token),
{name} AS (SELECT id, token, pos FROM (SELECT id, token, row_number() OVER (PARTITION BY id ORDER BY i) AS pos FROM {name}_f) WHERE pos <= 30)"""


def bm25_sql(name: str, queries: str) -> str:
    """CTEs up to `name` (query_id, id, score): BM25 of `queries` (query_id, query) over mem, whose tokens are in tok."""
    return f"""{tokens_sql(name + "_q", queries, "query_id", "query")},
{name}_terms AS (SELECT id, lower(token) AS term FROM tok),
{name}_dl AS (SELECT id, count(*) AS dl FROM {name}_terms GROUP BY id),
{name}_tf AS (SELECT q.id AS query_id, q.pos AS phrase, t.id, count(*) AS tf FROM {name}_q q JOIN {name}_terms t ON lower(q.token) = t.term GROUP BY ALL),
{name}_df AS (SELECT query_id, phrase, count(*) AS df FROM {name}_tf GROUP BY ALL),
{name}_n AS (SELECT (SELECT count(*) FROM mem)::DOUBLE AS n, (SELECT count(*) FROM {name}_terms)::DOUBLE AS total),
{name}_idf AS (SELECT query_id, phrase, CASE WHEN ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) <= 0 THEN 1e-6::DOUBLE ELSE ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) END AS idf FROM {name}_df, {name}_n),
{name} AS (SELECT query_id, id, round(sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / (total / n)))), 9) AS score FROM {name}_tf JOIN {name}_idf USING (query_id, phrase) JOIN {name}_dl USING (id), {name}_n GROUP BY query_id, id)"""


def overlap_sql(name: str, a: str, b: str, pairs: str, key_a: str, key_b: str) -> str:
    """CTE `name`: pairs with `overlap`, the shared share of token tables a and b (id, token)."""
    return f"""{name}_na AS (SELECT id, count(*) AS n FROM {a} GROUP BY id), {name}_nb AS (SELECT id, count(*) AS n FROM {b} GROUP BY id),
{name}_s AS (SELECT p.{key_a} AS ka, p.{key_b} AS kb, count(*) AS s FROM {pairs} p JOIN {a} x ON x.id = p.{key_a} JOIN {b} y ON y.id = p.{key_b} AND y.token = x.token GROUP BY ALL),
{name} AS (SELECT p.*, CASE WHEN coalesce(na.n, 0) > 0 AND coalesce(nb.n, 0) > 0 THEN coalesce(s, 0)::DOUBLE / greatest(na.n, nb.n) ELSE 0.0::DOUBLE END AS overlap FROM {pairs} p LEFT JOIN {name}_s ON ka = p.{key_a} AND kb = p.{key_b} LEFT JOIN {name}_na na ON na.id = p.{key_a} LEFT JOIN {name}_nb nb ON nb.id = p.{key_b})"""


WEIGHT = "(CASE priority WHEN 0 THEN 4.0::DOUBLE WHEN 1 THEN 3.0::DOUBLE WHEN 2 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END)"
PRIOR = "(CASE priority WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.75::DOUBLE WHEN 2 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END)"
TOK = tokens_sql("tok", "mem")

"""Queries of the read path: words, vectors, fusion, surfacing, lists, feedback and status."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores, text
from ..operators import feedback, fusion, lexical, lifecycle, listing, surface, vector
from . import views as v
from .registry import Registry

R = Registry()
QUERY = "The tion retitioning hein and erat"
TASK = "est les plan eredth"
TURNS = ["the thand", "Nicht erat ouen", "of hein thinan"]
QUERY_TABLE = f"q0 AS (SELECT 0::BIGINT AS query_id, '{QUERY}' AS query)"
BM = f"WITH {v.MEM},\n{v.TOK},\n{QUERY_TABLE},\n{v.bm25_sql('bm', 'q0')}"
RANKED = "row_number() OVER (ORDER BY score DESC, id)"


@R.add(f"{BM} SELECT id, score, {RANKED} AS rank FROM bm QUALIFY rank <= 20")
def bm25_search(spark, d):
    mem = v.memories(spark, d)
    return lexical.search(mem, lexical.one_query(mem, QUERY), index=v.lexical_index(spark, d)).select("id", "score", "rank")


@R.add(f"{BM}, h AS (SELECT id, score AS b, {RANKED} AS bm25_rank FROM bm QUALIFY bm25_rank <= 20), w AS (SELECT id, bm25_rank, round(b * {v.WEIGHT} * greatest(0.1::DOUBLE, vitality), 6) AS score FROM h JOIN mem USING (id)) SELECT id, bm25_rank, score, row_number() OVER (ORDER BY score DESC, bm25_rank, id) AS rank FROM w QUALIFY rank <= 10")
def bm25_recall_weighted(spark, d):
    mem = v.memories(spark, d)
    return lexical.weighted(mem, lexical.search(mem, lexical.one_query(mem, QUERY), index=v.lexical_index(spark, d))).select("id", "bm25_rank", "score", "rank")


@R.add(f"{BM} SELECT id, score, {RANKED} AS rank FROM bm JOIN mem USING (id) WHERE agent_id = 'src3' AND vitality >= 0.2 AND updated_at >= TIMESTAMP '2024-01-10' AND updated_at <= TIMESTAMP '2024-02-10' QUALIFY rank <= 20")
def bm25_temporal(spark, d):
    mem = v.memories(spark, d)
    return lexical.search(mem, lexical.one_query(mem, QUERY), index=v.lexical_index(spark, d), agent="src3", min_vitality=0.2, after="2024-01-10", before="2024-02-10").select("id", "score", "rank")


@R.add(f"WITH {v.MEM}, {v.INC}, {v.TOK}, q0 AS (SELECT seq AS query_id, content AS query FROM inc WHERE seq % 20 = 0), {v.bm25_sql('bm', 'q0')} SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm QUALIFY rank <= 20")
def bm25_batch(spark, d):
    """Of all incoming texts those whose number 20 divides are queries, against all memories."""
    inc = v.incoming(spark, d).filter("seq % 20 = 0").select(F.col("seq").alias("query_id"), F.col("content").alias("query"))
    return lexical.search(v.memories(spark, d), inc, index=v.lexical_index(spark, d)).select("query_id", "id", "score", "rank")


@R.add(f"WITH {v.MEM}, t AS (SELECT id, row_number() OVER (ORDER BY priority, updated_at DESC, id) AS rank FROM mem WHERE contains(lower(content), 'thand') AND vitality >= 0.1) SELECT id, rank, 1::DOUBLE / rank AS score FROM t WHERE rank <= 20")
def like_fallback(spark, d):
    return lexical.like(v.memories(spark, d), "thAnd", min_vitality=0.1)


@R.add(f"WITH {v.PTH} SELECT id, uri FROM pth WHERE lower(uri) LIKE 'core://th%'")
def uri_prefix(spark, d):
    return listing.prefix(v.paths(spark, d), "core://TH").select("id", "uri")


@R.add(f"WITH {v.PTH} SELECT id, nullif(regexp_extract(uri, '^([a-z]+)://(.+)$', 1), '') AS domain, nullif(regexp_extract(uri, '^([a-z]+)://(.+)$', 2), '') AS path FROM pth")
def uri_parse(spark, d):
    return v.paths(spark, d).select("id", text.uri_domain(F.col("uri")).alias("domain"), text.uri_path(F.col("uri")).alias("path"))


VEC = f"WITH {v.MEM}, {v.EMB}, target AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 11), sims AS (SELECT memory_id AS id, round(list_inner_product(vector, q) / (sqrt(list_inner_product(vector, vector)) * sqrt(list_inner_product(q, q))), 6) AS similarity FROM emb, target, mem WHERE mem.id = memory_id AND mem.hash = content_hash AND status = 'ready'), near AS (SELECT id, similarity, row_number() OVER (ORDER BY similarity DESC, id) AS rank FROM sims WHERE similarity > 0 QUALIFY rank <= 20)"


def _target(spark, d):
    return [float(x) for x in v.table(spark, d, "embeddings").filter("vec_id = 11").first()["embedding"]]


def _shown(*columns):
    """Nulls as 0, as the comparison of results knows no whole numbers with nulls."""
    return [F.coalesce(c, F.lit(0)).alias(c) for c in columns]


def _near(spark, d, limit=20, **conditions):
    return vector.search(v.memories(spark, d), v.embeddings(spark, d), _target(spark, d), "p", limit, **conditions)


@R.add(f"{VEC} SELECT id, similarity, rank FROM near")
def vector_topk(spark, d):
    return _near(spark, d).select("id", "similarity", "rank")


@R.add(f"WITH {v.MEM}, {v.EMB} SELECT memory_id AS id, CASE WHEN content_hash <> hash THEN 'pending' ELSE status END AS status, content_hash <> hash OR vector IS NULL AS emptied FROM emb JOIN mem ON id = memory_id")
def vector_stale_guard(spark, d):
    return vector.after_change(v.embeddings(spark, d), v.memories(spark, d)).select(F.col("memory_id").alias("id"), "status", F.col("vector").isNull().alias("emptied"))


@R.add(f"WITH {v.MEM}, {v.EMB}, a AS (SELECT memory_id, content_hash, status, 10 AS t FROM emb UNION ALL SELECT memory_id, 'new', 'failed', CASE WHEN memory_id % 2 = 0 THEN 11 ELSE 9 END FROM emb WHERE memory_id % 3 = 0) SELECT memory_id, content_hash, status FROM a QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY t DESC) = 1")
def embedding_upsert(spark, d):
    at = lambda n: F.timestamp_seconds(n)
    now = v.embeddings(spark, d).withColumn("updated_at", at(F.lit(10)))
    new = now.filter("memory_id % 3 = 0").withColumns({"content_hash": F.lit("new"), "status": F.lit("failed"), "updated_at": at(F.when(F.col("memory_id") % 2 == 0, 11).otherwise(9))})
    return vector.upsert(now, new).select("memory_id", "content_hash", "status")


FUSED = f"{VEC}, {v.TOK}, {QUERY_TABLE}, {v.bm25_sql('bm', 'q0')}, wr AS (SELECT id, {RANKED} AS bm25_rank FROM bm QUALIFY bm25_rank <= 20), both_ AS (SELECT coalesce(wr.id, near.id) AS id, bm25_rank, near.rank AS vector_rank FROM wr FULL JOIN near ON wr.id = near.id), base AS (SELECT both_.*, updated_at, coalesce(0.45::DOUBLE / (60 + bm25_rank), 0) + coalesce(0.45::DOUBLE / (60 + vector_rank), 0) + 0.05::DOUBLE * {v.PRIOR} + 0.05::DOUBLE * vitality AS base FROM both_ JOIN mem USING (id))"
ORDERED = "row_number() OVER (ORDER BY score DESC, updated_at DESC, id)"
AGE = f"greatest(0, (epoch_us(TIMESTAMP '{v.NOW}') - epoch_us(updated_at)) / 86400000000.0::DOUBLE)"


def _words(spark, d, limit=20, **conditions):
    mem = v.memories(spark, d)
    return lexical.search(mem, lexical.one_query(mem, QUERY), limit, v.lexical_index(spark, d), **conditions)


@R.add(f"{FUSED}, s AS (SELECT *, round(base, 6) AS score FROM base) SELECT id, coalesce(bm25_rank, 0) AS bm25_rank, coalesce(vector_rank, 0) AS vector_rank, score, {ORDERED} AS rank FROM s QUALIFY rank <= 10")
def hybrid_fuse(spark, d):
    return fusion.fuse(v.memories(spark, d), _words(spark, d), _near(spark, d)).select("id", *_shown("bm25_rank", "vector_rank"), "score", "rank")


@R.add(f"{FUSED}, s AS (SELECT *, round(0.7::DOUBLE * base + 0.3::DOUBLE * exp(-{AGE} / 30), 6) AS score FROM base) SELECT id, coalesce(bm25_rank, 0) AS bm25_rank, coalesce(vector_rank, 0) AS vector_rank, score, {ORDERED} AS rank FROM s QUALIFY rank <= 10")
def hybrid_recency(spark, d):
    return fusion.fuse(v.memories(spark, d), _words(spark, d), _near(spark, d), now=v.NOW, recency=0.3).select("id", *_shown("bm25_rank", "vector_rank"), "score", "rank")


RELATED = f"""{FUSED}, {v.LNK}, s AS (SELECT *, round(base, 6) AS score FROM base), direct AS (SELECT id, score, {ORDERED} AS rank FROM s QUALIFY rank <= 10),
fan AS (SELECT direct.id AS source_id, direct.score AS ss, direct.rank AS sr, l.target_id, l.weight FROM direct JOIN (SELECT DISTINCT * FROM lnk) l ON l.source_id = direct.id JOIN mem ON mem.id = l.target_id QUALIFY row_number() OVER (PARTITION BY direct.id ORDER BY weight DESC, target_id) <= 5),
rel AS (SELECT * FROM fan WHERE target_id NOT IN (SELECT id FROM direct) QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY sr) = 1),
u AS (SELECT id, score, NULL::BIGINT AS source_id FROM direct UNION ALL SELECT target_id, round(ss * weight * 0.6::DOUBLE, 6), source_id FROM rel)"""


@R.add(f"{RELATED} SELECT id, score, coalesce(source_id, -1) AS source_id, 'dual-path' AS mode, row_number() OVER (ORDER BY score DESC, source_id IS NOT NULL, id) AS rank FROM u QUALIFY rank <= 15")
def recall_related(spark, d):
    mem = v.memories(spark, d)
    return fusion.recall(mem, lexical.one_query(mem, QUERY), _near(spark, d), v.links(spark, d), index=v.lexical_index(spark, d)).select("id", "score", F.coalesce("source_id", F.lit(-1)).alias("source_id"), "mode", "rank")


@R.add(f"{FUSED}, s AS (SELECT *, round(base, 6) AS score FROM base), f AS (SELECT id, score, {ORDERED} AS fetched_rank FROM s QUALIFY fetched_rank <= 12) SELECT id, score, fetched_rank, row_number() OVER (ORDER BY score DESC, fetched_rank, id) AS rank FROM f JOIN mem USING (id) WHERE emotion_tag = 'en' QUALIFY rank <= 4")
def recall_emotion_postfilter(spark, d):
    mem = v.memories(spark, d)
    found = fusion.fuse(mem, _words(spark, d), _near(spark, d), limit=12)
    return fusion.with_emotion(found, mem, "en", 4).select("id", "score", "fetched_rank", "rank")


@R.add(f"WITH {v.MEM} SELECT id, CAST(access_count + CASE WHEN id % 10 = 0 THEN 1 ELSE 0 END AS BIGINT) AS access_count, CASE WHEN id % 10 = 0 THEN least(999999.0::DOUBLE, stability * 1.5::DOUBLE) ELSE stability END AS stability, round(CASE WHEN id % 10 = 0 THEN least(1.0::DOUBLE, vitality * 1.2::DOUBLE) ELSE vitality END, 9) AS vitality FROM mem")
def record_access(spark, d):
    mem = v.memories(spark, d)
    return fusion.record_access(mem, mem.filter("id % 10 = 0"), v.NOW).select("id", F.col("access_count").cast("long").alias("access_count"), "stability", F.round("vitality", 9).alias("vitality"))


def surface_sql(query: str, task: str, turns: list[str], intent: str | None, similarity: bool, limit: int, wide: bool = False) -> str:
    at = surface.Context(query, task, turns, intent, limit)
    asked = [(0, query), (1, task), (2, " ".join(at.recent))]
    q = " UNION ALL ".join(f"SELECT {i}::BIGINT, '{t}'" for i, t in asked if t) or "SELECT -1::BIGINT, ''"
    rs = lambda r: f"CASE WHEN {r} IS NULL THEN 0 ELSE greatest(0, 1 - ({r} - 1) / {at.window}.0::DOUBLE) END"
    own = [query, *at.recent]
    qt = " UNION ALL ".join(f"SELECT {i}::BIGINT AS id, '{t}' AS content" for i, t in enumerate(own)) if any(own) else "SELECT 0::BIGINT AS id, '' AS content"
    lex, tsk = "coalesce(lo.s, 0)::DOUBLE / greatest(m_n, (SELECT count(*) FROM qtok))", "coalesce(to_.s, 0)::DOUBLE / greatest(m_n, (SELECT count(*) FROM ttok))"
    lex, tsk = f"(CASE WHEN m_n > 0 AND (SELECT count(*) FROM qtok) > 0 THEN {lex} ELSE 0 END)", f"(CASE WHEN m_n > 0 AND (SELECT count(*) FROM ttok) > 0 THEN {tsk} ELSE 0 END)"
    if intent:
        priors, miss = surface.INTENTS[intent]
        latin, cjk = surface.HINTS[intent]
        hint = rf"regexp_matches(content, '(?i)\b({'|'.join(latin)})\b') OR regexp_matches(content, '{'|'.join(cjk)}')"
        inten = f"(([{', '.join(f'{p}::DOUBLE' for p in priors)}])[list_position(['identity', 'emotion', 'knowledge', 'event'], type)] * CASE WHEN {hint} THEN 1.0::DOUBLE ELSE {miss}::DOUBLE END)"
    else:
        inten = "0.0::DOUBLE"
    semantic = f"CASE WHEN sim IS NOT NULL THEN least(1, greatest(sim, 0.7::DOUBLE * lex)) ELSE {'0.7::DOUBLE * lex' if any(own) else '0'} END"
    head = VEC if similarity else f"WITH {v.MEM}"
    near = "SELECT id, NULL::BIGINT AS qr, NULL::BIGINT AS tr, NULL::BIGINT AS rr, similarity AS sim FROM nears UNION ALL" if similarity else ""
    nears = f", nears AS (SELECT id, similarity FROM sims JOIN mem USING (id) WHERE similarity > 0 AND vitality >= 0.05 ORDER BY similarity DESC, id LIMIT {at.window})" if similarity else ""
    match = "least(1, 0.7::DOUBLE * tsk + 0.3::DOUBLE * inten)" if task else "inten"
    return f"""{head}{nears}, {v.FB}, {v.TOK}, q0(query_id, query) AS ({q}), {v.bm25_sql('bm', 'q0')},
br AS (SELECT query_id, bm.id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, bm.id) AS rank FROM bm JOIN mem ON mem.id = bm.id WHERE vitality >= 0.05 QUALIFY rank <= {at.window}),
cand AS (SELECT id, min(qr) AS qr, min(tr) AS tr, min(rr) AS rr, max(sim) AS sim FROM ({near} SELECT id, CASE WHEN query_id = 0 THEN rank END AS qr, CASE WHEN query_id = 1 THEN rank END AS tr, CASE WHEN query_id = 2 THEN rank END AS rr, NULL::DOUBLE AS sim FROM br
  UNION ALL (SELECT id, NULL, NULL, NULL, NULL FROM mem WHERE vitality >= 0.05 ORDER BY priority, updated_at DESC, id LIMIT {max(48, at.window)})) GROUP BY id),
qs AS ({qt}), {v.tokens_sql('qt', 'qs')}, qtok AS (SELECT DISTINCT token FROM qt), ts AS (SELECT 0 AS id, '{task}' AS content), {v.tokens_sql('tt', 'ts')}, ttok AS (SELECT DISTINCT token FROM tt),
mn AS (SELECT id, count(*) AS m_n FROM tok GROUP BY id), lo AS (SELECT id, count(*) AS s FROM tok JOIN qtok USING (token) GROUP BY id), to_ AS (SELECT id, count(*) AS s FROM tok JOIN ttok USING (token) GROUP BY id),
fbs AS (SELECT memory_id AS id, count_if(useful = 1)::DOUBLE / count(*) AS f FROM fb GROUP BY memory_id),
r1 AS (SELECT cand.*, type, priority, vitality, updated_at, coalesce(m_n, 0) AS m_n, coalesce(f, 0.5::DOUBLE) AS feedback_score, {inten} AS inten, {lex} AS lex, {tsk} AS tsk FROM cand JOIN mem USING (id) LEFT JOIN mn USING (id) LEFT JOIN lo ON lo.id = cand.id LEFT JOIN to_ ON to_.id = cand.id LEFT JOIN fbs ON fbs.id = cand.id),
r2 AS (SELECT *, 0.45::DOUBLE * {rs('qr')} + 0.15::DOUBLE * {rs('rr')} + 0.15::DOUBLE * {rs('tr')} + 0.25::DOUBLE * lex AS lexical_, {semantic} AS semantic_, {match} AS match_ FROM r1),
r3 AS (SELECT *, round(0.35::DOUBLE * semantic_ + 0.20::DOUBLE * lexical_ + 0.15::DOUBLE * match_ + 0.10::DOUBLE * vitality + 0.10::DOUBLE * {v.PRIOR} + 0.10::DOUBLE * feedback_score, 6) AS score FROM r2),
r4 AS (SELECT id, type, score, round(semantic_, 6) AS semantic_score, round(lexical_, 6) AS lexical_score, round(match_, 6) AS task_match, round(feedback_score, 6) AS feedback_score, row_number() OVER (ORDER BY score DESC, round(semantic_, 6) DESC, round(lexical_, 6) DESC, priority, updated_at DESC, id) AS rank FROM r3 QUALIFY rank <= {at.top})"""


PLAIN = "SELECT id, type, score, semantic_score, lexical_score, task_match, feedback_score, rank FROM r4"


def _surfaced(spark, d, at, near=None, links=None):
    return surface.surface(v.memories(spark, d), v.feedback(spark, d), at, near, links, v.lexical_index(spark, d))


@R.add(f"{surface_sql(QUERY, TASK, TURNS, None, True, 20)} {PLAIN}")
def surface_query(spark, d):
    at = surface.Context(QUERY, TASK, TURNS, None, 20)
    return _surfaced(spark, d, at, _near(spark, d, at.window, min_vitality=0.05)).drop("reason_codes")


@R.add(f"{surface_sql('', '', [], 'planning', False, 10)} SELECT id, type, score, task_match, feedback_score, rank, array_to_string(list_filter(['type:' || type, CASE WHEN task_match > 0.2 THEN 'task:planning' END, 'intent:planning', CASE WHEN feedback_score >= 0.67 THEN 'feedback:reinforced' WHEN feedback_score <= 0.33 THEN 'feedback:negative' END], lambda x: x IS NOT NULL), ',') AS reasons FROM r4")
def surface_intent(spark, d):
    return _surfaced(spark, d, surface.Context(intent="planning", limit=10)).select("id", "type", "score", "task_match", "feedback_score", "rank", F.array_join("reason_codes", ",").alias("reasons"))


@R.add(f"{surface_sql('', '', TURNS, 'temporal', False, 5)} {PLAIN}")
def surface_turns(spark, d):
    return _surfaced(spark, d, surface.Context(turns=TURNS, intent="temporal")).drop("reason_codes")


@R.add(f"""{surface_sql(QUERY, '', [], 'factual', False, 8)}, {v.LNK},
fan AS (SELECT r4.id AS source_id, r4.score AS ss, r4.rank AS sr, l.target_id, l.weight FROM r4 JOIN (SELECT DISTINCT * FROM lnk) l ON l.source_id = r4.id JOIN mem ON mem.id = l.target_id QUALIFY row_number() OVER (PARTITION BY r4.id ORDER BY weight DESC, target_id) <= 5),
rel AS (SELECT * FROM fan WHERE target_id NOT IN (SELECT id FROM r4) QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY sr) = 1),
u AS (SELECT id, score, NULL::BIGINT AS source_id FROM r4 UNION ALL SELECT target_id, round(ss * weight * 0.6::DOUBLE, 6), source_id FROM rel)
SELECT id, score, coalesce(source_id, -1) AS source_id, row_number() OVER (ORDER BY score DESC, source_id IS NOT NULL, id) AS rank FROM u QUALIFY rank <= 12""")
def surface_related(spark, d):
    return _surfaced(spark, d, surface.Context(QUERY, intent="factual", limit=8), links=v.links(spark, d)).select("id", "score", F.coalesce("source_id", F.lit(-1)).alias("source_id"), "rank")


@R.add(f"WITH {v.FB} SELECT memory_id, count(*) AS total, count_if(useful = 1)::BIGINT AS useful, (count(*) - count_if(useful = 1))::BIGINT AS not_useful, round(count_if(useful = 1)::DOUBLE / count(*), 9) AS score FROM fb GROUP BY memory_id")
def feedback_summary(spark, d):
    return feedback.summary(v.feedback(spark, d)).withColumn("score", F.round("score", 9))


@R.add(f"WITH {v.FB} SELECT memory_id, round(1 - avg(value), 9) AS penalty FROM fb GROUP BY memory_id")
def feedback_penalty(spark, d):
    return feedback.penalty(v.feedback(spark, d)).withColumn("penalty", F.round("penalty", 9))


@R.add(f"WITH {v.FB} SELECT memory_id, count(*) AS n FROM fb WHERE source = 'passive' AND epoch_us(created_at) > epoch_us(TIMESTAMP '2024-01-20 12:00:00') - 86400000000 GROUP BY memory_id")
def passive_counts_24h(spark, d):
    return feedback.passive_counts(v.feedback(spark, d), None, "2024-01-20 12:00:00")


@R.add(f"WITH {v.FB}, s AS (SELECT memory_id, list_sort(list(epoch_us(created_at))) AS t FROM fb WHERE source = 'passive' GROUP BY memory_id), a AS (SELECT memory_id, len(t) AS attempts, list_reduce(list_transform(t, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y > x[1] - 86400000000)) < 3 THEN list_concat(acc, x) ELSE acc END, []::BIGINT[]) AS ok FROM s) SELECT memory_id, attempts::BIGINT AS attempts, len(ok)::BIGINT AS accepted, list_max(ok) AS last_accepted_us FROM a")
def passive_limiter(spark, d):
    return feedback.limit_passive(v.feedback(spark, d).filter("source = 'passive'"))


@R.add(f"WITH {v.MEM}, {v.FB}, sig AS (SELECT id, memory_id, source, useful, created_at FROM fb) SELECT sig.id, memory_id, sig.source || CASE WHEN useful = 1 THEN ':useful' ELSE ':not_useful' END AS event_type, useful::DOUBLE AS value FROM sig JOIN mem ON mem.id = memory_id")
def feedback_record(spark, d):
    return feedback.record(v.memories(spark, d), v.feedback(spark, d)).select("id", "memory_id", "event_type", "value")


@R.add(f"WITH {v.MEM} SELECT 'type' AS kind, type AS key, count(*) AS n FROM mem GROUP BY type UNION ALL SELECT 'priority', 'P' || priority, count(*) FROM mem GROUP BY priority UNION ALL SELECT 'all', 'all', count(*) FROM mem")
def status_counts(spark, d):
    return listing.counts(v.memories(spark, d))


@R.add(f"WITH {v.MEM}, {v.PTH}, {v.FB} SELECT (SELECT count(*) FROM mem) AS total, (SELECT count_if(vitality < 0.1) FROM mem)::BIGINT AS low_vitality, (SELECT round(avg(vitality), 9) FROM mem) AS avg_vitality, (SELECT count(*) FROM pth) AS paths, (SELECT count(*) FROM fb) AS feedback, (SELECT count_if(useful = 1) FROM fb)::BIGINT AS useful")
def status_totals(spark, d):
    return listing.status(v.memories(spark, d), v.paths(spark, d), v.feedback(spark, d))


@R.add(f"WITH {v.MEM}, cap(type, capacity) AS (VALUES ('identity', NULL), ('emotion', 50), ('knowledge', 250), ('event', 50)) SELECT type, count(id) AS n, coalesce(capacity, -1)::BIGINT AS capacity FROM cap LEFT JOIN mem USING (type) GROUP BY ALL")
def status_capacity(spark, d):
    return listing.capacity(v.memories(spark, d), lifecycle.Capacity()).withColumn("capacity", F.coalesce("capacity", F.lit(-1).cast("long")))


@R.add(f"WITH {v.MEM} SELECT id, type, priority FROM mem WHERE type = 'knowledge' AND vitality >= 0.3 AND emotion_tag = 'en' ORDER BY priority, updated_at DESC, id LIMIT 30 OFFSET 10")
def list_memories(spark, d):
    return listing.listed(v.memories(spark, d), 30, 10, types=("knowledge",), min_vitality=0.3, emotion_tag="en").select("id", "type", "priority")


@R.add(f"WITH {v.MEM} SELECT id, type FROM mem WHERE id % 3 = 1 AND agent_id = 'src4' ORDER BY updated_at DESC, id LIMIT 20")
def archive_list(spark, d):
    gone = v.memories(spark, d).filter("id % 3 = 1").withColumn("archived_at", F.col("updated_at"))
    return listing.archived(gone, "src4").select("id", "type")


@R.add(f"WITH {v.MEM}, r AS (SELECT id, type, row_number() OVER (PARTITION BY type ORDER BY priority, updated_at DESC, id) AS layer_rank FROM mem WHERE type <> 'knowledge' OR vitality >= 0.5) SELECT * FROM r WHERE layer_rank <= CASE type WHEN 'identity' THEN 50 WHEN 'emotion' THEN 5 WHEN 'event' THEN 7 ELSE 10 END")
def boot_layers(spark, d):
    return listing.layers(v.memories(spark, d)).select("id", "type", "layer_rank")


@R.add(f"WITH {v.MEM}, {v.PTH}, top AS (SELECT id, 0 AS origin FROM mem WHERE agent_id = 'src0' AND priority = 0 ORDER BY priority, updated_at DESC, id LIMIT 100), core AS (SELECT memory_id AS id, 1 AS origin FROM pth WHERE agent_id = 'src0' AND uri LIKE 'core://%') SELECT id, min(origin)::BIGINT AS origin FROM (SELECT * FROM top UNION ALL SELECT * FROM core) JOIN mem USING (id) GROUP BY id")
def boot_set(spark, d):
    paths = v.paths(spark, d)
    core = paths.filter("uri like 'core://%'").select("uri").distinct()
    return listing.boot(v.memories(spark, d), paths, "src0", core).select("id", F.col("origin").cast("long").alias("origin"))


@R.add(f"WITH {v.MEM}, a AS (SELECT id, updated_at, floor((epoch_us(TIMESTAMP '2024-02-12 00:00:00') - epoch_us(updated_at)) / 86400000000.0::DOUBLE) AS n FROM mem) SELECT id, CASE WHEN n <= 0 THEN '今天' WHEN n = 1 THEN '昨天' WHEN n <= 7 THEN CAST(n AS BIGINT) || '天前' ELSE strftime(updated_at, '%Y-%m-%d') END AS told FROM a")
def relative_dates(spark, d):
    return v.memories(spark, d).select("id", scores.relative_date(F.col("updated_at"), "2024-02-12 00:00:00").alias("told"))


@R.add(r"SELECT doc_id AS id, substr(sha256(regexp_replace(text, '^\s+|\s+$', '', 'g')), 1, 16) AS hash FROM documents")
def content_hash(spark, d):
    return v.table(spark, d, "documents").select(F.col("doc_id").alias("id"), text.content_hash(F.col("text")).alias("hash"))


@R.add(f"WITH {v.MEM}, {v.TOK} SELECT id, string_agg(token, ' ' ORDER BY pos) AS tokens, count(*) AS n FROM tok GROUP BY id")
def tokenize(spark, d):
    tokens = text.tokenize(F.col("content"))
    return v.memories(spark, d).select("id", F.array_join(tokens, " ").alias("tokens"), F.size(tokens).cast("long").alias("n")).filter("n > 0")


@R.add(r"WITH s AS (SELECT page_id AS id, substr(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60) AS slug FROM pages) SELECT id, CASE WHEN slug = '' THEN 'item' ELSE slug END AS slug FROM s")
def slugify(spark, d):
    return v.table(spark, d, "pages").select(F.col("page_id").alias("id"), text.slugify(F.col("url")).alias("slug"))


@R.add(r"WITH e AS (SELECT doc_id AS id, regexp_extract_all(text, '[A-Z][A-Za-z0-9_-]+|\d+(?:[-/:]\d+)*|[#@][A-Za-z0-9_-]+|[A-Za-z0-9_]+://[^\s]+') AS l FROM documents) SELECT id, len(list_distinct(l))::BIGINT AS n, array_to_string(list_sort(list_distinct(l)), ' ') AS entities FROM e")
def entities(spark, d):
    found = text.entities(F.col("text"))
    return v.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.size(found).cast("long").alias("n"), F.array_join(F.sort_array(found), " ").alias("entities"))


@R.add(r"SELECT doc_id AS id, array_to_string(regexp_extract_all(text, '\d+(?:\.\d+)+|\b\d{2,}\b'), ' ') AS numbers FROM documents")
def numbers(spark, d):
    return v.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.array_join(text.numbers(F.col("text")), " ").alias("numbers"))


@R.add("SELECT doc_id AS id, substr(split_part(text, chr(10), 1), 1, 200) AS line FROM documents")
def first_line(spark, d):
    return v.table(spark, d, "documents").select(F.col("doc_id").alias("id"), text.first_line(F.col("text")).alias("line"))

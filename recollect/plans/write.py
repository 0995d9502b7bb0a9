"""Queries of the write path and of the lifecycle."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..lineage import settle, spread
from ..operators import feedback, guard, lifecycle
from ..schemas import TABLES
from ..sources import markdown, tables
from . import views as v
from .registry import Registry

R = Registry()


def _stored(mem):
    """The memories with the columns that the store has, of their own types but for the missing ones."""
    return mem.select([F.col(f.name) if f.name in mem.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in TABLES["memories"]])


NOT_RE = r"(?i)\b(shouldn''t|can''t|won''t|aren''t|isn''t|doesn''t|don''t|cannot|never|not|no)\b"
CONFLICT_SQL = rf"""(CASE WHEN regexp_matches(a, '{NOT_RE}') <> regexp_matches(b, '{NOT_RE}') THEN 0.4::DOUBLE ELSE 0 END) AS neg,
  (CASE WHEN len(regexp_extract_all(a, '\d+(?:\.\d+)+|\b\d{{2,}}\b')) > 0 AND len(regexp_extract_all(b, '\d+(?:\.\d+)+|\b\d{{2,}}\b')) > 0 AND NOT list_has_any(regexp_extract_all(a, '\d+(?:\.\d+)+|\b\d{{2,}}\b'), regexp_extract_all(b, '\d+(?:\.\d+)+|\b\d{{2,}}\b')) THEN 0.3::DOUBLE ELSE 0 END) AS val,
  (CASE WHEN (regexp_matches(a, '(?i)\b(done|fixed|resolved|closed)\b') AND regexp_matches(b, '(?i)\b(todo|wip|pending|working)\b')) OR (regexp_matches(b, '(?i)\b(done|fixed|resolved|closed)\b') AND regexp_matches(a, '(?i)\b(todo|wip|pending|working)\b')) THEN 0.3::DOUBLE ELSE 0 END) AS sta"""


@R.add(f"WITH {v.MEM}, {v.INC} SELECT seq, EXISTS (SELECT 1 FROM mem m WHERE m.hash = substr(sha256(regexp_replace(inc.content, '^\\s+|\\s+$', '', 'g')), 1, 16) AND m.agent_id = inc.agent_id) AS known FROM inc")
def exact_dedup(spark, d):
    return guard.known(v.incoming(spark, d), v.memories(spark, d)).select("seq", F.col("same").isNotNull().alias("known"))


#: SQL has no pattern for a letter that repeats, so all letters of the texts are named.
STUCK = "|".join(re.escape(chr(i)).replace("'", "''") + "{10}" for i in (*range(32, 127), *range(161, 592), *range(0x2010, 0x2028), 0x20AC))
GATE = rf"""g1 AS (SELECT id, priority, regexp_replace(content, '^\s+|\s+$', '', 'g') AS c FROM src), gn AS (SELECT id, count(*) AS n FROM gt GROUP BY id),
g2 AS (SELECT g1.*, len(c) AS size, coalesce(n, 0) AS n FROM g1 LEFT JOIN gn USING (id)),
g3 AS (SELECT id, CASE WHEN size >= CASE WHEN priority <= 1 THEN 4 ELSE 20 END THEN least(1.0::DOUBLE, size / 50.0::DOUBLE) ELSE 0 END AS specificity, least(1.0::DOUBLE, n / 5.0::DOUBLE) AS novelty,
  least(1.0::DOUBLE, (regexp_matches(c, '[A-Z][a-z]+')::INT + regexp_matches(c, '\d')::INT + regexp_matches(c, '\w+://')::INT + regexp_matches(c, '[@#]')::INT + (size >= 15)::INT) / 3.0::DOUBLE) AS relevance,
  greatest(0, 1.0::DOUBLE - 0.5::DOUBLE * (size > 20 AND regexp_full_match(c, '[A-Z\s]+'))::INT - 0.3::DOUBLE * (NOT regexp_matches(c, '[\s,.!?;:]') AND size >= 30)::INT - 0.5::DOUBLE * regexp_matches(c, '{STUCK}')::INT) AS coherence FROM g2)"""


@R.add(f"WITH {v.MEM}, src AS (SELECT id, priority, content FROM mem), {v.tokens_sql('gt', 'src')}, {GATE} SELECT id, round(specificity, 6) AS specificity, round(novelty, 6) AS novelty, round(relevance, 6) AS relevance, round(coherence, 6) AS coherence, specificity > 0 AND novelty > 0 AND relevance > 0 AND coherence >= 0.3 AS pass FROM g3")
def quality_gate(spark, d):
    told = guard.gate(F.col("content"), F.col("priority"))
    return spread(v.memories(spark, d)).select("id", *[(F.round(c, 6) if n != "pass" else c).alias(n) for n, c in told.items()])


ENTITY = r"[A-Z][A-Za-z0-9_-]+|\d+(?:[-/:]\d+)*|[#@][A-Za-z0-9_-]+|[A-Za-z0-9_]+://[^\s]+"
DOMAIN = lambda c: f"regexp_extract({c}, '^([a-z]+)://(.+)$', 1)"


def cand_sql(full: bool = False, single: str = "") -> str:
    """CTEs up to `cand`, the candidates of the incoming texts; full: with addresses and vectors. single: a condition on inc, as of one row a text."""
    more = f", {v.PTH}, {v.ADR}, {v.NEAR}, la AS (SELECT memory_id AS id, max_by(uri, created_at) AS old_uri FROM adr GROUP BY memory_id), taken AS (SELECT inc.seq, min(adr.memory_id) AS at_uri FROM inc JOIN adr USING (agent_id, uri) GROUP BY inc.seq)" if full else ", la AS (SELECT NULL::BIGINT AS id, NULL::VARCHAR AS old_uri), taken AS (SELECT NULL::BIGINT AS seq, NULL::BIGINT AS at_uri WHERE false)"
    recalled = f"""b2 AS (SELECT coalesce(b1.query_id, nr.seq) AS seq, coalesce(b1.id, nr.id) AS id, similarity, row_number() OVER (PARTITION BY coalesce(b1.query_id, nr.seq) ORDER BY round(coalesce(0.45::DOUBLE / (60 + rank), 0) + CASE WHEN nr.id IS NULL THEN 0 ELSE 0.45::DOUBLE / 61 END + 0.05::DOUBLE * {v.PRIOR} + 0.05::DOUBLE * vitality, 6) DESC, updated_at DESC, mem.id) AS r
  FROM b1 FULL JOIN nr ON b1.query_id = nr.seq AND b1.id = nr.id JOIN mem ON mem.id = coalesce(b1.id, nr.id) QUALIFY r <= 8)""" if full else f"b2 AS (SELECT query_id AS seq, id, NULL::DOUBLE AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY round(b1.score * {v.WEIGHT} * greatest(0.1::DOUBLE, vitality), 6) DESC, rank, id) AS r FROM b1 JOIN mem USING (id) QUALIFY r <= 8)"
    return f"""WITH {v.MEM}, {v.INC.replace('inc AS (', 'inc0 AS (', 1)}, inc AS (SELECT * FROM inc0 {single}), {v.TOK}{more}, hashed AS (SELECT *, substr(sha256(regexp_replace(content, '^\\s+|\\s+$', '', 'g')), 1, 16) AS hash FROM inc), same AS (SELECT h.seq, min(m.id) AS same FROM hashed h JOIN mem m USING (hash, agent_id) GROUP BY h.seq),
src AS (SELECT seq AS id, CASE type WHEN 'identity' THEN 0 WHEN 'emotion' THEN 1 WHEN 'knowledge' THEN 2 ELSE 3 END AS priority, content FROM inc), {v.tokens_sql('gt', 'src')}, {GATE},
fit AS (SELECT seq FROM inc JOIN g3 ON g3.id = seq WHERE specificity > 0 AND novelty > 0 AND relevance > 0 AND coherence >= 0.3),
ok AS (SELECT seq, content, type, agent_id, uri, created_at FROM inc WHERE seq IN (SELECT seq FROM fit) AND seq NOT IN (SELECT seq FROM same) AND seq NOT IN (SELECT seq FROM taken)),
q0 AS (SELECT seq AS query_id, content AS query FROM ok), {v.bm25_sql('bm', 'q0')},
b1 AS (SELECT query_id, bm.id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, bm.id) AS rank FROM bm JOIN ok ON ok.seq = query_id JOIN mem ON mem.id = bm.id AND mem.agent_id = ok.agent_id QUALIFY rank <= 8),
{recalled},
pairs AS (SELECT b2.seq, b2.id, similarity FROM b2 JOIN ok USING (seq) JOIN mem USING (id) WHERE mem.type = ok.type), {v.overlap_sql('lo', 'gt', 'tok', 'pairs', 'seq', 'id')},
ea AS (SELECT DISTINCT seq AS id, unnest(regexp_extract_all(content, '{ENTITY}')) AS token FROM ok), eb AS (SELECT DISTINCT id, unnest(regexp_extract_all(content, '{ENTITY}')) AS token FROM mem WHERE id IN (SELECT id FROM pairs)), {v.overlap_sql('eo', 'ea', 'eb', 'pairs', 'seq', 'id')},
full_ AS (SELECT seq, id, lo.overlap AS lexical, CASE WHEN lo.similarity IS NULL THEN lo.overlap ELSE greatest(0, least(1, lo.similarity)) END AS semantic, greatest(eo.overlap, 0.75::DOUBLE * lo.overlap) AS entity,
  CASE WHEN ok.uri IS NULL AND old_uri IS NULL THEN 0.65::DOUBLE WHEN ok.uri IS NULL OR old_uri IS NULL THEN 0.2::DOUBLE WHEN ok.uri = old_uri THEN 1.0::DOUBLE WHEN {DOMAIN('ok.uri')} = {DOMAIN('old_uri')} THEN 0.85::DOUBLE ELSE 0.0::DOUBLE END AS uri_match,
  CASE WHEN ok.type <> 'event' THEN 1.0::DOUBLE ELSE greatest(0, least(1, 1 - abs((epoch_us(mem.created_at) - epoch_us(ok.created_at)) / 86400000000.0::DOUBLE) / 7)) END AS time, ok.content AS a, mem.content AS b, ok.type, ok.uri FROM lo JOIN eo USING (seq, id) JOIN ok USING (seq) JOIN mem USING (id) LEFT JOIN la USING (id)),
scored AS (SELECT *, round(0.50::DOUBLE * semantic + 0.20::DOUBLE * lexical + 0.15::DOUBLE * uri_match + 0.10::DOUBLE * entity + 0.05::DOUBLE * time, 6) AS dedup_score FROM full_),
con AS (SELECT *, {CONFLICT_SQL} FROM scored),
cand AS (SELECT *, CASE WHEN dedup_score >= 0.6 AND neg + val + sta > 0.5 THEN CASE WHEN sta > 0 THEN 'status' WHEN val > 0 THEN 'value' ELSE 'negation' END END AS conflict_type FROM con),
best AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY seq ORDER BY dedup_score DESC, id) = 1),
told AS (SELECT inc.seq, CASE WHEN same.seq IS NOT NULL THEN 'skip' WHEN taken.seq IS NOT NULL THEN 'update' WHEN ok.seq IS NULL THEN 'skip' WHEN dedup_score >= 0.93 THEN CASE WHEN conflict_type IN ('status', 'value') OR inc.uri IS NOT NULL THEN 'update' ELSE 'skip' END WHEN dedup_score >= 0.82 THEN 'merge' ELSE 'add' END AS action,
  CASE WHEN same.seq IS NOT NULL THEN 'hash' WHEN taken.seq IS NOT NULL THEN 'uri' WHEN ok.seq IS NULL THEN 'gate' ELSE 'candidates' END AS step, coalesce(CASE WHEN same.seq IS NOT NULL THEN same.same WHEN taken.seq IS NOT NULL THEN at_uri WHEN dedup_score >= 0.82 THEN best.id END, -1) AS target_id, coalesce(dedup_score, -1) AS dedup_score
  FROM inc LEFT JOIN same USING (seq) LEFT JOIN taken USING (seq) LEFT JOIN ok USING (seq) LEFT JOIN best USING (seq))"""


CAND, FULL = cand_sql(), cand_sql(True)


def _open(spark, d):
    mem = v.memories(spark, d)
    rows = guard.known(v.incoming(spark, d), mem).filter("same is null")
    return settle(rows.filter(guard.gate(F.col("content"), guard.default_priority(F.col("type")))["pass"]).drop("hash", "same")), mem  # used several times


@R.add(f"{CAND} SELECT seq, id, round(lexical, 6) AS lexical, round(entity, 6) AS entity, uri_match, round(time, 6) AS time, dedup_score FROM cand")
def dedup_score(spark, d):
    return guard.candidates(*_open(spark, d), index=v.lexical_index(spark, d)).select("seq", "id", "lexical", "entity", "uri_match", "time", "dedup_score")


def _decided(told):
    return told.select("seq", "action", "step", F.coalesce("target_id", F.lit(-1)).alias("target_id"), F.coalesce("dedup_score", F.lit(-1.0)).alias("dedup_score"))


@R.add(f"{CAND} SELECT * FROM told")
def guard_decision(spark, d):
    return _decided(guard.decide(v.incoming(spark, d), v.memories(spark, d), index=v.lexical_index(spark, d)))


@R.add(f"{FULL} SELECT * FROM told")
def guard_with_addresses(spark, d):
    """The same with the addresses of memories and vectors of some texts at hand."""
    return _decided(guard.decide(v.incoming(spark, d), v.memories(spark, d), v.addresses(spark, d), v.vector_pairs(spark, d), index=v.lexical_index(spark, d)))


@R.add(f"{FULL} SELECT seq, id, round(semantic, 6) AS semantic, round(lexical, 6) AS lexical, uri_match, dedup_score FROM cand")
def dedup_with_addresses(spark, d):
    rows, mem = _open(spark, d)
    paths = v.addresses(spark, d)
    free = settle(rows.join(paths.select("agent_id", "uri"), ["agent_id", "uri"], "left_anti"))
    return guard.candidates(free, mem, paths, v.vector_pairs(spark, d), index=v.lexical_index(spark, d)).select("seq", "id", "semantic", "lexical", "uri_match", "dedup_score")


#: Ids of new memories in the queries of links: far above those of the tables.
BEYOND = 10**15


@R.add(f"{CAND}, own AS (SELECT seq, id AS other, dedup_score FROM cand WHERE dedup_score >= 0.45 AND dedup_score < 0.82 QUALIFY row_number() OVER (PARTITION BY seq ORDER BY dedup_score DESC, id) <= 5), both_ AS (SELECT seq + {BEYOND} AS source_id, other AS target_id, dedup_score AS weight FROM own UNION ALL SELECT other, seq + {BEYOND}, dedup_score FROM own) SELECT source_id, target_id, max(weight) AS weight FROM both_ GROUP BY ALL")
def auto_links(spark, d):
    rows, mem = _open(spark, d)
    return guard.auto_links(guard.candidates(rows, mem, index=v.lexical_index(spark, d)), rows.select("seq", (F.col("seq") + BEYOND).alias("id")))


PAIRS = "p AS (SELECT a.id, a.content || ' value 10 ' AS a, CASE WHEN b.id % 3 = 0 THEN b.content || ' not done 2.5' WHEN b.id % 3 = 1 THEN 'WIP todo 10' ELSE b.content END AS b0, b.id AS other FROM mem a JOIN mem b ON b.id = a.id + 1), p2 AS (SELECT id, CASE WHEN id % 2 = 0 THEN a || ' DONE' ELSE a END AS a, b0 AS b FROM p)"


@R.add(f"WITH {v.MEM}, {PAIRS}, c AS (SELECT id, {CONFLICT_SQL} FROM p2) SELECT id, round(neg + val + sta, 6) AS conflict_score, CASE WHEN sta > 0 THEN 'status' WHEN val > 0 THEN 'value' ELSE 'negation' END AS conflict_type FROM c")
def conflict_scan(spark, d):
    mem = v.memories(spark, d)
    b = F.when(F.col("id") % 3 == 0, F.concat("content", F.lit(" not done 2.5"))).when(F.col("id") % 3 == 1, "WIP todo 10").otherwise(F.col("content"))
    a = F.concat("content", F.lit(" value 10 "), F.when(F.col("id") % 2 == 0, " DONE").otherwise(""))
    # Each text is looked at once; what was found in it is joined, not the text.
    told = mem.select("id", a.alias("a"), b.alias("b")).select("id", guard.signs(F.col("a")).alias("a"), guard.signs(F.col("b")).alias("b"))
    return told.select("id", "a").join(told.select((F.col("id") - 1).alias("id"), "b"), "id").select("id", *[c.alias(n) for n, c in guard.conflict_of(F.col("a"), F.col("b")).items()])


MERGE_SQL = r"""WITH {mem}, pr AS (SELECT a.id, a.content AS a, b.content AS b FROM mem a JOIN mem b ON b.id = a.id + 4 AND b.type = a.type WHERE a.type = '{kind}'),
parts AS (SELECT id, list_filter(list_transform({split}, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l, regexp_replace(b, '^\s+|\s+$', '', 'g') AS nb FROM pr),
un AS (SELECT id, nb, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM parts), fi AS (SELECT id, nb, x, min(i) AS i FROM un GROUP BY ALL), o AS (SELECT id, list(x ORDER BY i) AS u FROM fi GROUP BY id)
SELECT id, md5({told}) AS merged FROM o"""


def _merge(spark, d, kind):
    mem = v.memories(spark, d).filter(F.col("type") == kind)
    new = mem.select((F.col("id") - 4).alias("id"), F.col("content").alias("b"))
    return mem.join(new, "id").select("id", F.md5(guard.merged(F.lit(kind), F.col("content"), F.col("b"))).alias("merged"))


@R.add(MERGE_SQL.format(mem=v.MEM, kind="identity", split="[b]", told="u[1]"))
def merge_identity(spark, d):
    return _merge(spark, d, "identity")


@R.add(MERGE_SQL.format(mem=v.MEM, kind="emotion", split="list_concat(regexp_split_to_array(a, '\\n+'), [b])", told="CASE WHEN len(u) <= 1 THEN u[1] ELSE u[1] || chr(10) || chr(10) || array_to_string(list_transform(u[2:], lambda x: '- ' || regexp_replace(x, '^-\\s*', '')), chr(10)) END"))
def merge_emotion(spark, d):
    return _merge(spark, d, "emotion")


@R.add(MERGE_SQL.format(mem=v.MEM, kind="knowledge", split="list_concat(regexp_split_to_array(a, '[\\n；;。.!?！？]+'), regexp_split_to_array(b, '[\\n；;。.!?！？]+'))", told="array_to_string(u, '；')"))
def merge_knowledge(spark, d):
    return _merge(spark, d, "knowledge")


@R.add(MERGE_SQL.format(mem=v.MEM, kind="event", split="list_concat(regexp_split_to_array(a, '\\n+'), [b])", told="CASE WHEN len(u) <= 1 THEN regexp_replace(u[1], '^-\\s*', '') ELSE 'Timeline:' || chr(10) || array_to_string(list_transform(u, lambda x: '- ' || regexp_replace(x, '^-\\s*', '')), chr(10)) END"))
def merge_event(spark, d):
    return _merge(spark, d, "event")


DEC = f"WITH {v.MEM}, dec AS (SELECT id, vitality AS old, round(greatest(CASE priority WHEN 1 THEN 0.3::DOUBLE WHEN 2 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END, exp(-greatest(0, (epoch_us(TIMESTAMP '{v.NOW}') - epoch_us(coalesce(last_accessed, created_at))) / 86400000000.0::DOUBLE) / greatest(stability, 0.01::DOUBLE))), 9) AS vitality FROM mem WHERE priority > 0)"


@R.add(f"{DEC} SELECT id, old, vitality, abs(vitality - old) > 0.001 AS changed FROM dec")
def decay(spark, d):
    return lifecycle.decay(v.memories(spark, d), v.NOW)


@R.add(f"{DEC} SELECT count_if(abs(vitality - old) > 0.001)::BIGINT AS updated, count_if(abs(vitality - old) > 0.001 AND vitality < old)::BIGINT AS decayed, count_if(abs(vitality - old) > 0.001 AND vitality < 0.05)::BIGINT AS below_threshold FROM dec")
def decay_summary(spark, d):
    return lifecycle.decay_summary(lifecycle.decay(v.memories(spark, d), v.NOW))


@R.add(f"WITH {v.MEM} SELECT id, vitality FROM mem WHERE vitality < 0.25 AND priority >= 2")
def decayed_candidates(spark, d):
    return lifecycle.faded(v.memories(spark, d), 0.25).select("id", "vitality")


STALE_MEM = "sm AS (SELECT * REPLACE (CASE WHEN id % 9 = 2 THEN 'TODO: ' || content WHEN id % 9 = 3 THEN content || ' just now' WHEN id % 9 = 4 THEN 'Working on ' || content WHEN id % 9 = 6 THEN '刚才 ' || content ELSE content END AS content) FROM mem)"
STALE_SQL = f"""{STALE_MEM}, st AS (SELECT *, CASE WHEN type = 'event' THEN CASE WHEN regexp_matches(content, '(?i)in progress|deploying|working on|正在|进行中|部署中|处理中') THEN 'in_progress' WHEN regexp_matches(content, '(?i)todo|待办') THEN 'pending' WHEN regexp_matches(content, '(?i)just now|a moment ago|刚才|刚刚') THEN 'ephemeral' END
  WHEN type = 'knowledge' THEN CASE WHEN regexp_matches(content, '(?im)^(todo|wip|fixme|待办|进行中)[:：]') THEN 'pending' WHEN regexp_matches(content, '(?m)^(刚才|刚刚)') THEN 'ephemeral' END END AS reason FROM sm WHERE priority >= 2 AND vitality >= 0.05),
sd AS (SELECT id, reason, round(vitality * CASE reason WHEN 'in_progress' THEN 0.3::DOUBLE WHEN 'pending' THEN 0.5::DOUBLE ELSE 0.2::DOUBLE END, 9) AS vitality FROM st WHERE reason IS NOT NULL AND (epoch_us(TIMESTAMP '2024-02-05 00:00:00') - epoch_us(created_at)) / 86400000000.0::DOUBLE >= CASE reason WHEN 'in_progress' THEN 7 WHEN 'pending' THEN 14 ELSE 3 END)"""


def _stale(spark, d):
    i, c = F.col("id"), F.col("content")
    return v.memories(spark, d).withColumn("content", F.when(i % 9 == 2, F.concat(F.lit("TODO: "), c)).when(i % 9 == 3, F.concat(c, F.lit(" just now"))).when(i % 9 == 4, F.concat(F.lit("Working on "), c)).when(i % 9 == 6, F.concat(F.lit("刚才 "), c)).otherwise(c))


@R.add(f"WITH {v.MEM}, {STALE_SQL} SELECT id, reason, vitality FROM sd")
def stale_decay(spark, d):
    return lifecycle.stale_decay(_stale(spark, d), "2024-02-05 00:00:00")


@R.add(f"WITH {v.MEM}, {STALE_SQL} SELECT sm.id, round(coalesce(sd.vitality, sm.vitality), 9) AS vitality, epoch_us(CASE WHEN sd.id IS NOT NULL THEN TIMESTAMP '2024-02-05 00:00:00' ELSE updated_at END) AS updated_us FROM sm LEFT JOIN sd USING (id) WHERE NOT (sm.vitality < 0.05 AND priority >= 2)")
def tidy(spark, d):
    return lifecycle.tidy(_stale(spark, d), "2024-02-05 00:00:00").select("id", F.round("vitality", 9).alias("vitality"), F.unix_micros("updated_at").alias("updated_us"))


RED = f"{v.TOK}, rw AS (SELECT id, type FROM mem WHERE priority > 0 AND trim(content) <> ''), tn AS (SELECT id, count(*) AS n FROM tok GROUP BY id), sh AS (SELECT a.id, b.id AS other, count(*) AS s FROM rw a JOIN tok x ON x.id = a.id JOIN tok y ON y.token = x.token AND y.id <> x.id JOIN rw b ON b.id = y.id AND b.type = a.type GROUP BY ALL), red AS (SELECT rw.id, coalesce(max(s::DOUBLE / greatest(p.n, q.n)), 0) AS redundancy FROM rw LEFT JOIN sh USING (id) LEFT JOIN tn p ON p.id = sh.id LEFT JOIN tn q ON q.id = sh.other GROUP BY rw.id)"


@R.add(f"WITH {v.MEM}, {RED} SELECT id, round(redundancy, 6) AS redundancy FROM red")
def redundancy(spark, d):
    return lifecycle.redundancy(v.memories(spark, d).filter("priority > 0 and trim(content) <> ''"), index=v.lexical_index(spark, d)).withColumn("redundancy", F.round("redundancy", 6))


EVI = f"{v.FB}, {RED}, pen AS (SELECT memory_id, 1 - avg(value) AS penalty FROM fb GROUP BY memory_id), evi AS (SELECT mem.id, type, priority, round(redundancy, 6) AS redundancy, round(coalesce(penalty, 1), 6) AS penalty, round(0.40::DOUBLE * (1 - vitality) + 0.20::DOUBLE * redundancy + 0.20::DOUBLE * least(1, greatest(0, (epoch_us(TIMESTAMP '{v.NOW}') - epoch_us(created_at)) / 86400000000.0::DOUBLE) / 180) + 0.10::DOUBLE * coalesce(penalty, 1) + 0.10::DOUBLE * priority / 3, 6) AS score FROM mem JOIN red USING (id) LEFT JOIN pen ON memory_id = mem.id)"


def _evictable(spark, d):
    mem = v.memories(spark, d)
    return mem, lifecycle.eviction(mem, feedback.penalty(v.feedback(spark, d)), v.NOW, v.lexical_index(spark, d))


@R.add(f"WITH {v.MEM}, {EVI} SELECT id, type, redundancy, penalty, score FROM evi")
def eviction_rank(spark, d):
    return _evictable(spark, d)[1].select("id", "type", "redundancy", "penalty", "score")


QUOTA = "cap(type, most) AS (VALUES ('emotion', 50), ('knowledge', 150), ('event', 50)), ty AS (SELECT type, count(*) - most AS excess FROM mem JOIN cap USING (type) GROUP BY type, most), first_ AS (SELECT id FROM evi JOIN ty USING (type) QUALIFY row_number() OVER (PARTITION BY type ORDER BY score DESC, priority, id) <= max(excess) OVER (PARTITION BY type))"
SMALLER = {"identity": None, "emotion": 50, "knowledge": 150, "event": 50}


@R.add(f"WITH {v.MEM}, {EVI}, {QUOTA} SELECT id FROM first_")
def govern_type_quota(spark, d):
    mem, ranked = _evictable(spark, d)
    return lifecycle.evicted(mem, ranked, lifecycle.Capacity(SMALLER, 10**9)).select("id")


@R.add(f"WITH {v.MEM}, {EVI}, {QUOTA}, left_ AS (SELECT *, row_number() OVER (ORDER BY score DESC, priority, id) AS r FROM evi WHERE id NOT IN (SELECT id FROM first_)) SELECT id, 'type' AS quota FROM first_ UNION ALL SELECT id, 'total' FROM left_ WHERE r <= (SELECT count(*) FROM mem) - (SELECT count(*) FROM first_) - 350")
def govern_global_cap(spark, d):
    mem, ranked = _evictable(spark, d)
    return lifecycle.evicted(mem, ranked, lifecycle.Capacity(SMALLER, 350))


@R.add(f"WITH {v.MEM} SELECT id, CASE WHEN vitality < 0.1 THEN 'deleted' ELSE 'archived' END AS fate FROM mem")
def archive_split(spark, d):
    """The fate of each memory, were all evicted at once."""
    mem = _stored(v.memories(spark, d))
    left, archive = tables.archive(mem, mem.filter("false").withColumns({"archived_at": F.col("updated_at"), "archive_reason": F.lit("")}), mem.select("id"), v.NOW)
    gone = mem.select("id").join(left.select("id"), "id", "left_anti")
    return gone.join(archive.select("id", F.lit("archived").alias("fate")), "id", "left").select("id", F.coalesce("fate", F.lit("deleted")).alias("fate"))


@R.add(f"WITH {v.MEM}, {v.PTH} SELECT id, memory_id FROM pth WHERE memory_id NOT IN (SELECT id FROM mem)")
def orphan_paths(spark, d):
    return lifecycle.orphan_paths(v.paths(spark, d), v.memories(spark, d)).select("id", "memory_id")


@R.add(f"WITH {v.MEM}, {v.PTH}, {v.ADR} SELECT memory_id, max_by(uri, created_at) AS uri FROM adr GROUP BY memory_id")
def latest_uri(spark, d):
    return guard.latest_uri(v.addresses(spark, d))


@R.add(f"WITH {v.LNK}, l AS (SELECT DISTINCT * FROM lnk), new AS (SELECT target_id AS source_id, source_id AS target_id, 0.5::DOUBLE AS weight FROM l WHERE weight > 0.5), u AS (SELECT *, 0 AS o FROM l UNION ALL SELECT *, 1 FROM new) SELECT source_id, target_id, arg_min(weight, o) AS weight FROM u GROUP BY ALL")
def link_upsert(spark, d):
    old = v.links(spark, d)
    new = old.filter("weight > 0.5").select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), F.lit(0.5).alias("weight"))
    return tables.insert_or_ignore(old, new, ["source_id", "target_id"])


@R.add(f"WITH {v.MEM} SELECT id, round(CASE WHEN id % 6 = 1 THEN greatest(0, vitality * 0.1::DOUBLE) ELSE vitality END, 9) AS vitality FROM mem")
def forget_soft(spark, d):
    mem = v.memories(spark, d)
    return tables.forget_softly(mem, mem.filter("id % 6 = 1"), v.NOW).select("id", F.round("vitality", 9).alias("vitality"))


@R.add(f"WITH {v.MEM} SELECT id, id % 8 = 5 AS restored FROM mem WHERE id % 8 = 5 OR id % 2 = 0")
def restore(spark, d):
    mem = v.memories(spark, d)
    archive = mem.filter("id % 2 = 1").withColumns({"archived_at": F.col("updated_at"), "archive_reason": F.lit("eviction")})
    live, _ = tables.restore(mem.filter("id % 2 = 0"), archive, mem.filter("id % 8 = 5").select("id"), v.NOW)
    return live.select("id", (F.col("updated_at") == F.lit(v.NOW).cast("timestamp")).alias("restored"))


@R.add(f"WITH {v.MEM}, {v.PTH}, gone AS (SELECT id FROM mem WHERE id % 18 = 0) SELECT 'memories' AS kind, count(*) AS n FROM mem WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'paths', count(*) FROM pth WHERE memory_id NOT IN (SELECT id FROM gone)")
def cascade_delete(spark, d):
    mem = v.memories(spark, d)
    out = tables.delete({"memories": mem, "paths": v.paths(spark, d)}, mem.filter("id % 18 = 0").select("id"))
    return out["memories"].agg(F.count(F.lit(1)).alias("n")).select(F.lit("memories").alias("kind"), "n").unionByName(out["paths"].agg(F.count(F.lit(1)).alias("n")).select(F.lit("paths").alias("kind"), "n"))


ING_SRC = "f AS (SELECT page_id AS file, '## About ' || page_id || chr(10) || '- first ' || url || chr(10) || '* HEARTBEAT_OK seen' || chr(10) || chr(10) || 'plain ' || page_id || chr(10) || '## Journal event' || chr(10) || '- went ' || url || chr(10) || '## Notes' || chr(10) || chr(10) || '## ' || url || chr(10) || '-   note session_status' || chr(10) || '- last' AS text FROM pages)"
ING = rf"""{ING_SRC}, b AS (SELECT file, unnest(l) AS s, generate_subscripts(l, 1) AS bi FROM (SELECT file, regexp_split_to_array(chr(10) || text, '\n##\s+') AS l FROM f)),
b2 AS (SELECT file, bi, split_part(s, chr(10), 1) AS title, substr(s, len(split_part(s, chr(10), 1)) + 1) AS body FROM b), k AS (SELECT *, CASE WHEN lower(title) LIKE '%emotion%' THEN 'emotion' WHEN lower(title) LIKE '%event%' OR lower(title) LIKE '%journal%' THEN 'event' WHEN lower(title) LIKE '%identity%' OR lower(title) LIKE '%about%' THEN 'identity' ELSE 'knowledge' END AS type FROM b2),
li AS (SELECT file, bi, title, type, unnest(l) AS raw, generate_subscripts(l, 1) AS i FROM (SELECT *, regexp_split_to_array(body, '\n+') AS l FROM k)), c AS (SELECT *, trim(regexp_replace(raw, '^[-*]\s*', '')) AS content FROM li)"""
SLUG = "CASE WHEN type = 'identity' THEN 'core://ingest/' || substr(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60) ELSE type || '://notes-md' END"


def _files(spark, d):
    p, u, nl = F.col("page_id").cast("string"), F.col("url"), "\n"
    return v.table(spark, d, "pages").select(F.col("page_id").alias("file"), F.concat(F.lit("## About "), p, F.lit(f"{nl}- first "), u, F.lit(f"{nl}* HEARTBEAT_OK seen{nl}{nl}plain "), p, F.lit(f"{nl}## Journal event{nl}- went "), u, F.lit(f"{nl}## Notes{nl}{nl}## "), u, F.lit(f"{nl}-   note session_status{nl}- last")).alias("text"))


@R.add(f"WITH {ING} SELECT file, type, content, {SLUG} || '/' || row_number() OVER (PARTITION BY file ORDER BY bi, i) AS uri FROM c WHERE content <> '' AND NOT regexp_matches(content, '(?i)heartbeat_ok|session_status')")
def ingest_extract(spark, d):
    return markdown.items(_files(spark, d), F.lit("notes.md")).select("file", "type", "content", "uri")


@R.add(f"WITH {ING} SELECT file, count_if(regexp_matches(content, '(?i)heartbeat_ok|session_status'))::BIGINT AS noise, count(*) AS lines FROM c WHERE content <> '' GROUP BY file")
def ingest_noise(spark, d):
    rows = markdown.bullets(_files(spark, d))
    return rows.groupBy("file").agg(F.count_if(markdown.noise(F.col("content"))).alias("noise"), F.count(F.lit(1)).alias("lines"))


@R.add(f"WITH {v.MEM}, e AS (SELECT *, strftime(created_at, '%Y-%m-%d') AS day FROM mem WHERE type = 'event' AND agent_id = 'src3' ORDER BY priority, updated_at DESC, id LIMIT 10000) SELECT day || '.md' AS file, count(*) AS n, md5('# ' || day || chr(10) || chr(10) || string_agg('- ' || content || chr(10), chr(10) ORDER BY priority, updated_at DESC, id)) AS body FROM e GROUP BY day")
def export_by_day(spark, d):
    return markdown.journals(v.memories(spark, d), "src3").select("file", F.col("n").cast("long").alias("n"), F.md5("body").alias("body"))


@R.add(f"WITH {v.MEM}, r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY priority, updated_at DESC, id) AS n FROM mem WHERE agent_id = 'src4' AND type IN ('identity', 'emotion', 'knowledge')) SELECT type, count(*) AS n, md5(string_agg('- ' || content, chr(10) ORDER BY n)) AS body FROM r WHERE n <= 100 GROUP BY type")
def export_memory_file(spark, d):
    return markdown.sections(v.memories(spark, d), "src4").select("type", F.col("n").cast("long").alias("n"), F.md5("body").alias("body"))


@R.add("SELECT c_custkey, o_orderkey, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def scale_top_per_group(spark, d):
    """The ranking within groups of W3, W4 and W6, at the size of orders."""
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return v.table(spark, d, "orders").withColumn("n", F.row_number().over(order)).filter("n <= 3").join(v.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")


@R.add("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def scale_anti_join(spark, d):
    """The anti join of J11, at the size of orders."""
    return v.table(spark, d, "customer").join(v.table(spark, d, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


@R.add("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def scale_aggregate(spark, d):
    """The grouped totals of A1 and A2, at the size of lineitem."""
    rows = v.table(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))

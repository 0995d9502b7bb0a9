"""The write guard: what to do with incoming texts, judged in one plan for a whole batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores, text
from ..lineage import settle
from . import lexical
from .index import Index

NEAR_EXACT, MERGE, CONFLICT, LINK = 0.93, 0.82, 0.60, 0.45
CANDIDATES = 8

_NOT = text.ascii_words("cannot", "never", "not", "no", *(f"{verb}n't" for verb in ("should", "ca", "wo", "are", "is", "does", "do"))), text.within_ascii("取消", "无法", "禁止", "没", "不")
_DONE = text.ascii_words("abandoned", "cancelled", "shipped", "closed", "resolved", "fixed", "done"), text.within_ascii("已放弃", "已取消", "放弃", "取消", "已关闭", "已解决", "已修复", "已完成", "完成")
_ACTIVE = text.ascii_words("deploying", "working", "pending", "in.?progress", "wip", "todo"), text.within_ascii("开发中", "部署中", "处理中", "待办", "进行中", "正在")


def default_priority(kind: Column) -> Column:
    return scores.lookup(kind, {"identity": 0, "emotion": 1, "knowledge": 2}, 3)


def gate(content: Column, priority: Column) -> dict[str, Column]:
    """The four criteria of quality, each in [0, 1], and `pass`."""
    own = text.stripped(content)
    size = F.length(own)
    latin = text.plain(own)
    dense = size + 2 * F.when(latin, 0).otherwise(F.regexp_count(own, F.lit(rf"[{text.HAN}\x{{3400}}-\x{{4dbf}}]")))
    specificity = F.when(dense >= F.when(priority <= 1, 4).otherwise(20), F.least(F.lit(1.0), dense / 50)).otherwise(0.0)
    novelty = F.least(F.lit(1.0), F.size(text.tokenize(own)) / 5)
    signals = [~latin & text.matches(own, rf"[{text.HAN}]")] + [text.matches(own, p) for p in ("[A-Z][a-z]", r"\d", r"\w://", "[@#]")] + [size >= 15]
    relevance = F.least(F.lit(1.0), sum((s.cast("int") for s in signals), F.lit(0)) / 3)
    shouting = (size > 20) & text.matches(own, r"\A[A-Z\s]++\z")
    run_on = ~text.matches(own, r"[\s，。！？,.!?；;：:]") & (size >= 30)
    stuck = text.matches(own, r"([^\n\r])\1{9,}")
    coherence = F.greatest(F.lit(0.0), 1 - 0.5 * shouting.cast("int") - 0.3 * run_on.cast("int") - 0.5 * stuck.cast("int"))
    return {"specificity": specificity, "novelty": novelty, "relevance": relevance, "coherence": coherence, "pass": (specificity > 0) & (novelty > 0) & (relevance > 0) & (coherence >= 0.3)}


def uri_match(a: Column, b: Column) -> Column:
    """1 for one address, 0.85 for one domain, 0 for two, 0.65 where neither has one, 0.2 where one has."""
    both = F.when(a == b, 1.0).when(text.uri_domain(a) == text.uri_domain(b), 0.85).otherwise(0.0)
    return F.when(a.isNotNull() & b.isNotNull(), both).when(a.isNull() & b.isNull(), 0.65).otherwise(0.2)


def observed(parts: list[Column], fallback: Column, told: Column | None = None) -> Column:
    """When something happened: as told, else the first date in any of the parts, else the fallback."""
    def date(part: Column) -> Column:
        day = F.regexp_extract(part, r"(20\d{2}-\d{2}-\d{2})(?:[ T](\d{2}:\d{2}(?::\d{2})?))?", 1)
        time = F.regexp_extract(part, r"(20\d{2}-\d{2}-\d{2})(?:[ T](\d{2}:\d{2}(?::\d{2})?))?", 2)
        full = F.concat(day, F.lit(" "), F.when(F.length(time) == 5, F.concat(time, F.lit(":00"))).when(F.length(time) == 8, time).otherwise("00:00:00"))
        return F.when(day != "", F.try_to_timestamp(full, F.lit("yyyy-MM-dd HH:mm:ss")))

    return F.coalesce(*([told] if told is not None else []), *[date(p) for p in parts], fallback)


def time_proximity(kind: Column, a: Column, b: Column) -> Column:
    return F.when(kind != "event", 1.0).when(a.isNull() | b.isNull(), 0.5).otherwise(scores.clamp01(1 - F.abs(scores.days(a, b)) / 7))


def dedup_score(semantic: Column, lexical_overlap: Column, uri: Column, entity: Column, time: Column) -> Column:
    return scores.clamp01(0.50 * semantic + 0.20 * lexical_overlap + 0.15 * uri + 0.10 * F.greatest(entity, 0.75 * lexical_overlap) + 0.05 * time)


def _found(c: Column, latin: str, other: str) -> Column:
    return text.matches(c, latin) | (~text.plain(c) & text.matches(c, other))


def signs(c: Column) -> Column:
    """What conflicts are told from: (negated, numbers, done, active)."""
    return F.struct(_found(c, *_NOT).alias("negated"), text.numbers(c).alias("numbers"), _found(c, *_DONE).alias("done"), _found(c, *_ACTIVE).alias("active"))


def conflict(a: Column, b: Column) -> dict[str, Column]:
    """Signs that two texts contradict each other: their sum, and the kind of the last one that applies."""
    return conflict_of(signs(a), signs(b))


def conflict_of(a: Column, b: Column) -> dict[str, Column]:
    """conflict, from the signs of both texts."""
    negated = a["negated"] != b["negated"]
    value = (F.size(a["numbers"]) > 0) & (F.size(b["numbers"]) > 0) & ~F.arrays_overlap(a["numbers"], b["numbers"])
    status = (a["done"] & b["active"]) | (a["active"] & b["done"])
    total = 0.4 * negated.cast("int") + 0.3 * value.cast("int") + 0.3 * status.cast("int")
    return {"conflict_score": F.round(F.least(F.lit(1.0), total), 6), "conflict_type": F.when(status, "status").when(value, "value").otherwise("negation")}


def known(incoming: DataFrame, memories: DataFrame) -> DataFrame:
    """incoming with same: the least id of a memory of its agent with the same content, else null."""
    held = memories.groupBy("hash", "agent_id").agg(F.min("id").alias("same"))
    return incoming.withColumn("hash", text.content_hash(F.col("content"))).join(held, ["hash", "agent_id"], "left")


def latest_uri(paths: DataFrame) -> DataFrame:
    """(memory_id, uri): the newest address of each memory."""
    return paths.groupBy("memory_id").agg(F.max_by("uri", F.struct("created_at", "uri")).alias("uri"))


def candidates(incoming: DataFrame, memories: DataFrame, paths: DataFrame | None = None, near: DataFrame | None = None, limit: int = CANDIDATES, index: Index | None = None) -> DataFrame:
    """(seq, id, dedup scores, conflict) of the memories that each incoming text may repeat.

    incoming: (seq, content, type, agent_id, uri, source, created_at). As many as `limit` are recalled
    for each text, among its agent's memories, and only then narrowed to its type. near: (seq, id,
    similarity) where vectors are at hand. Each text is looked at once, however many pairs it is in, and
    pairs carry what was found in it, not the text.
    """
    asked = incoming.select(F.col("seq").alias("query_id"), F.col("content").alias("query"), "agent_id")
    words = lexical.best(memories, asked, max(8, limit), "agent_id", index)
    if near is None:
        recalled = lexical.weighted(memories, words, max(6, limit)).select(F.col("query_id").alias("seq"), "id", F.lit(None).cast("double").alias("similarity"))
    else:
        from .fusion import fuse

        vectors = lexical.ranked(near.select(F.col("seq").alias("query_id"), "id", "similarity"), "similarity", max(8, limit))
        recalled = fuse(memories, words, vectors, max(6, limit)).select(F.col("query_id").alias("seq"), "id", "similarity")
    told = lambda c: [text.entities(F.col(c)).alias("entities"), signs(F.col(c)).alias("signs")]
    new = incoming.select("seq", F.col("type").alias("new_type"), F.col("uri").alias("new_uri"), observed([F.col("uri"), F.col("source"), F.col("content")], F.col("created_at")).alias("new_at"), F.struct(text.tokenize(F.col("content")).alias("tokens"), *told("content")).alias("new"))
    tokens = F.col("tokens") if index else text.tokenize(F.col("content"))
    old = memories.join(index.tokens.select("id", "tokens"), "id") if index else memories
    if paths is None:
        old = old.withColumn("uri", F.lit(None).cast("string"))
    else:
        old = old.join(latest_uri(paths).withColumnRenamed("memory_id", "id"), "id", "left")
    recalled = settle(recalled.join(memories.select("id", "type"), "id").join(incoming.select("seq", F.col("type").alias("new_type")), "seq").filter(F.col("type") == F.col("new_type")).select("seq", "id", "similarity"))
    old = old.join(recalled.select("id").distinct(), "id", "left_semi")
    old = old.select("id", "uri", observed([F.col("uri"), F.col("source"), F.col("content")], F.col("created_at")).alias("old_at"), F.struct(tokens.alias("tokens"), *told("content")).alias("old"))
    pairs = recalled.join(new, "seq").join(old, "id").withColumn("lexical", scores.overlap(F.col("new.tokens"), F.col("old.tokens"))).withColumns({
        "entity": scores.overlap(F.col("new.entities"), F.col("old.entities")),
        "uri_match": uri_match(F.col("new_uri"), F.col("uri")),
        "time": time_proximity(F.col("new_type"), F.col("new_at"), F.col("old_at")),
        "semantic": scores.clamp01(F.coalesce("similarity", "lexical")),
    })
    pairs = pairs.withColumn("dedup_score", F.round(dedup_score(*(F.col(c) for c in ("semantic", "lexical", "uri_match", "entity", "time"))), 6))
    against = conflict_of(F.col("new.signs"), F.col("old.signs"))
    seen = (F.col("dedup_score") >= CONFLICT) & (against["conflict_score"] > 0.5)
    return pairs.select("seq", "id", "new_type", F.round("semantic", 6).alias("semantic"), F.round("lexical", 6).alias("lexical"), F.round("uri_match", 6).alias("uri_match"), F.round(F.greatest("entity", 0.75 * F.col("lexical")), 6).alias("entity"), F.round("time", 6).alias("time"), "dedup_score", F.when(seen, against["conflict_type"]).alias("conflict_type"))


def decide(incoming: DataFrame, memories: DataFrame, paths: DataFrame | None = None, near: DataFrame | None = None, conservative: bool = False, index: Index | None = None) -> DataFrame:
    """What judge says, without the candidates."""
    return judge(incoming, memories, paths, near, conservative, index)[0]


def judge(incoming: DataFrame, memories: DataFrame, paths: DataFrame | None = None, near: DataFrame | None = None, conservative: bool = False, index: Index | None = None) -> tuple[DataFrame, DataFrame]:
    """(seq, action, target_id, step, dedup_score, new_content) for each incoming text, against one state of the store.

    step says which test decided: hash, uri, gate, conservative, candidates. new_content is what the
    target's content becomes, null where it stays. Second, the candidates.
    """
    rows = known(incoming, memories)
    kind = memories.schema["id"].dataType
    if paths is None:
        rows = rows.withColumn("at_uri", F.lit(None).cast(kind))
    else:
        rows = rows.join(paths.groupBy("agent_id", "uri").agg(F.min("memory_id").alias("at_uri")), ["agent_id", "uri"], "left")
    passed = gate(F.col("content"), F.coalesce(F.col("priority") if "priority" in incoming.columns else F.lit(None).cast("int"), default_priority(F.col("type"))))["pass"]
    rows = settle(rows.withColumn("passed", passed))
    open_rows = rows.filter("same is null and at_uri is null and passed") if not conservative else rows.filter("false")
    found = settle(candidates(open_rows.select("seq", "content", "type", "agent_id", "uri", "source", "created_at"), memories, paths, near, index=index))
    first = Window.partitionBy("seq").orderBy(F.desc("dedup_score"), "id")
    best = found.withColumn("n", F.row_number().over(first)).filter("n = 1").select("seq", F.col("id").alias("best"), "dedup_score", "conflict_type")
    best = best.join(memories.select(F.col("id").alias("best"), F.col("content").alias("old")), "best")
    rows = rows.join(best, "seq", "left")
    override = F.col("conflict_type").isin("status", "value")
    close = F.when(override, "update").when(F.col("uri").isNotNull(), "update").otherwise("skip")
    judged = F.when(F.col("dedup_score") >= NEAR_EXACT, close).when(F.col("dedup_score") >= MERGE, "merge").otherwise("add")
    action = F.when(F.col("same").isNotNull(), "skip").when(F.col("at_uri").isNotNull(), "update").when(~F.col("passed"), "skip").otherwise("add" if conservative else judged)
    step = F.when(F.col("same").isNotNull(), "hash").when(F.col("at_uri").isNotNull(), "uri").when(~F.col("passed"), "gate").otherwise("conservative" if conservative else "candidates")
    rows = rows.withColumn("action", action).withColumn("step", step)
    target = F.when(F.col("step") == "hash", F.col("same")).when(F.col("step") == "uri", F.col("at_uri")).when((F.col("step") == "candidates") & (F.col("action") != "add"), F.col("best"))
    new = F.when(F.col("step") == "uri", F.col("content")).when(F.col("action") == "merge", merged(F.col("type"), F.col("old"), F.col("content"))).when((F.col("step") == "candidates") & (F.col("action") == "update") & override, F.col("content"))
    return rows.select("seq", "action", target.alias("target_id"), "step", "dedup_score", new.alias("new_content")), found


def auto_links(found: DataFrame, ids: DataFrame, most: int = 5) -> DataFrame:
    """(source_id, target_id, weight), both ways, of the best candidates worth a link. ids: (seq, id) of what was written."""
    fit = found.filter((F.col("dedup_score") >= LINK) & (F.col("dedup_score") < MERGE))
    own = fit.withColumnRenamed("id", "other").join(ids.select("seq", F.col("id").alias("own")), "seq").filter("other <> own")
    best = Window.partitionBy("seq").orderBy(F.desc("dedup_score"), "other")
    kept = own.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= most)
    forth = kept.select(F.col("own").alias("source_id"), F.col("other").alias("target_id"), F.col("dedup_score").alias("weight"))
    return forth.unionByName(forth.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "weight")).groupBy("source_id", "target_id").agg(F.max("weight").alias("weight"))


def merged(kind: Column, old: Column, new: Column) -> Column:
    """The content that two texts of a type become: replaced, listed as evidence, joined by clauses, or a timeline."""
    own = text.stripped(new)
    bare = lambda x: F.regexp_replace(x, r"^-\s*", "")
    unique = F.array_distinct(F.filter(F.concat(text.lines(old), F.array(own)), lambda x: x != ""))
    rest = F.transform(F.slice(unique, F.lit(2), F.greatest(F.size(unique), F.lit(1))), lambda x: F.concat(F.lit("- "), bare(x)))
    emotion = F.when(F.size(unique) <= 1, F.coalesce(F.get(unique, F.lit(0)), own)).otherwise(F.array_join(F.concat(F.array(unique[0], F.lit("")), rest), "\n"))
    parts = F.array_distinct(F.concat(text.clauses(old), text.clauses(new)))
    knowledge = F.when(F.size(parts) <= 1, F.coalesce(F.get(parts, F.lit(0)), own)).otherwise(F.array_join(parts, "；"))
    points = F.transform(unique, bare)
    event = F.when(F.size(points) <= 1, F.coalesce(F.get(points, F.lit(0)), own)).otherwise(F.concat(F.lit("Timeline:\n"), F.array_join(F.transform(points, lambda x: F.concat(F.lit("- "), x)), "\n")))
    return F.when(kind == "identity", own).when(kind == "emotion", emotion).when(kind == "knowledge", knowledge).otherwise(event)

"""Surfacing: what is worth showing in a context of query, task, turns and intent."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores, text
from . import feedback as fb
from . import lexical
from .fusion import related
from .index import Index
from .lexical import ranked, scope

#: How well a type fits an intent, in the order identity, emotion, knowledge, event; and the factor without a hint.
INTENTS = {
    "design": ((0.8, 0.35, 1.0, 0.25), 0.65),
    "factual": ((0.25, 0.15, 1.0, 0.8), 0.75),
    "planning": ((0.65, 0.2, 1.0, 0.6), 0.7),
    "preference": ((1.0, 0.85, 0.55, 0.25), 0.8),
    "temporal": ((0.15, 0.35, 0.5, 1.0), 0.75),
}
HINTS = {
    "design": (("theme", "palette", "brand", "layout", "component", "style", "design", "ux", "ui"), ("渐变", "玻璃拟态", "低饱和", "配色", "设计", "界面", "风格")),
    "factual": (("status", "api", "document", "docs", "rule", "constraint", "fact", "what"), ("事实", "接口", "文档", "约束", "规则")),
    "planning": (("milestone", "task", "roadmap", "implement", "build", "ship", "next", "todo", "planning", "plan"), ("重构", "实现", "待办", "下一步", "计划")),
    "preference": (("favorite", "avoid", "dislike", "like", "preference", "prefer"), ("讨厌", "避免", "不喜欢", "偏好", "喜欢")),
    "temporal": (("timeline", "when", "after", "before", "recent", "tomorrow", "yesterday", "today"), ("何时", "时间线", "最近", "明天", "昨天", "今天")),
}


@dataclass(frozen=True)
class Context:
    query: str = ""
    task: str = ""
    turns: Sequence[str] = ()
    intent: str | None = None
    limit: int = 5
    min_vitality: float = 0.05
    agent: str | None = None
    types: tuple[str, ...] | None = None
    emotion_tag: str | None = None
    after: str | None = None
    before: str | None = None

    @property
    def top(self) -> int:
        return max(1, min(self.limit, 20))

    @property
    def window(self) -> int:
        return max(24, self.top * 6)

    @property
    def recent(self) -> list[str]:
        return [t.strip() for t in self.turns if t.strip()][-4:]


def intent_score(content: Column, kind: Column, intent: str | None) -> Column:
    if intent is None:
        return F.lit(0.0)
    priors, miss = INTENTS[intent]
    latin, cjk = HINTS[intent]
    hint = text.matches(content, text.ascii_words(*latin)) | text.matches(content, "|".join(cjk))
    return scores.clamp01(scores.lookup(kind, dict(zip(("identity", "emotion", "knowledge", "event"), priors, strict=True)), 0.0) * F.when(hint, 1.0).otherwise(miss))


def candidates(memories: DataFrame, near: DataFrame | None, at: Context, index: Index | None = None) -> DataFrame:
    """(id, query_rank, task_rank, recent_rank, similarity): what any branch found, and the fallback list."""
    asked = {"query_rank": at.query.strip(), "task_rank": at.task.strip(), "recent_rank": " ".join(at.recent)}
    conditions = {"agent": at.agent, "min_vitality": at.min_vitality, "after": at.after, "before": at.before}
    names = list(asked)
    queries = memories.sparkSession.range(len(names)).select(F.col("id").alias("query_id"), scores.lookup(F.col("id"), dict(enumerate(asked.values())), "").alias("query"))
    found = lexical.search(memories, queries, at.window, index, **conditions)
    ranks = [F.min(F.when(F.col("query_id") == i, F.col("rank"))).alias(n) for i, n in enumerate(names)]
    branches = found.select("id", "query_id", "rank", F.lit(None).cast("double").alias("similarity"))
    if near is not None:
        branches = branches.unionByName(near.select("id", F.lit(-1).cast("long").alias("query_id"), "rank", "similarity"))
    listed = scope(memories, at.agent, at.min_vitality).orderBy("priority", F.desc("updated_at"), "id").limit(max(48, at.window))
    branches = branches.unionByName(listed.select("id", F.lit(-2).cast("long").alias("query_id"), F.lit(None).cast("long").alias("rank"), F.lit(None).cast("double").alias("similarity")))
    return branches.groupBy("id").agg(*ranks, F.max("similarity").alias("similarity"))


def surface(memories: DataFrame, feedback: DataFrame, at: Context, near: DataFrame | None = None, links: DataFrame | None = None, index: Index | None = None) -> DataFrame:
    """The best memories for a context: six signals, their score, reasons, and linked memories if links are given."""
    spark = memories.sparkSession
    has_words = bool(at.query.strip() or at.recent)
    both = spark.range(1).select(F.array_distinct(F.flatten(F.array(*[text.tokenize(F.lit(x)) for x in [at.query, *at.recent]]))).alias("_q"), text.tokenize(F.lit(at.task)).alias("_t"))
    pool = scope(memories, min_vitality=at.min_vitality, types=at.types, emotion_tag=at.emotion_tag)
    rows = pool.join(candidates(memories, near, at, index), "id").join(fb.summary(feedback, at.agent).select("memory_id", F.col("score").alias("fb")), F.col("id") == F.col("memory_id"), "left").crossJoin(F.broadcast(both))  # one row
    rows = rows.join(index.tokens.select("id", F.col("tokens").alias("_m")), "id") if index else rows.withColumn("_m", text.tokenize(F.col("content")))
    lex, task = scores.overlap(F.col("_m"), F.col("_q")), scores.overlap(F.col("_m"), F.col("_t"))
    rank = lambda c: scores.rank_score(F.col(c), at.window)
    rows = rows.withColumns({
        "lexical_score": scores.clamp01(0.45 * rank("query_rank") + 0.15 * rank("recent_rank") + 0.15 * rank("task_rank") + 0.25 * lex),
        "semantic_score": F.when(F.col("similarity").isNotNull(), scores.clamp01(F.greatest("similarity", 0.7 * lex))).otherwise(scores.clamp01(0.7 * lex) if has_words else F.lit(0.0)),
        "_intent": intent_score(F.col("content"), F.col("type"), at.intent),
        "prior": scores.lookup(F.col("priority"), scores.PRIORITY_PRIOR, 0.25),
        "feedback_score": F.coalesce("fb", F.lit(0.5)),
    })
    rows = rows.withColumn("task_match", scores.clamp01(0.7 * task + 0.3 * F.col("_intent")) if at.task.strip() else F.col("_intent"))
    total = 0.35 * F.col("semantic_score") + 0.20 * F.col("lexical_score") + 0.15 * F.col("task_match") + 0.10 * F.col("vitality") + 0.10 * F.col("prior") + 0.10 * F.col("feedback_score")
    rows = rows.withColumns({"score": F.round(scores.clamp01(total), 6), "semantic_score": F.round("semantic_score", 6), "lexical_score": F.round("lexical_score", 6), "task_match": F.round("task_match", 6), "feedback_score": F.round("feedback_score", 6), "query_id": F.lit(0).cast("long")})
    rows = rows.withColumn("reason_codes", reasons(at))
    ties = (F.desc("semantic_score"), F.desc("lexical_score"), F.col("priority"), F.desc("updated_at"))
    best = ranked(rows.orderBy(F.desc("score"), *ties, "id").limit(at.top), "score", at.top, *ties)
    direct = best.select("query_id", "id", "type", "score", "semantic_score", "lexical_score", "task_match", "feedback_score", "reason_codes", "rank")
    if links is None:
        return direct.drop("query_id")
    wide = related(direct, links, memories, at.top).select("id", "score", "rank", "source_id")
    told = direct.select("id", "semantic_score", "lexical_score", "task_match", "feedback_score", "reason_codes")
    feedback_of = fb.summary(feedback, at.agent).select(F.col("memory_id").alias("id"), F.round("score", 6).alias("_fb"))
    kinds = memories.select("id", "type")
    out = wide.join(kinds, "id").join(told, "id", "left").join(feedback_of, "id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return out.select("id", "type", "score", zero("semantic_score"), zero("lexical_score"), zero("task_match"), F.coalesce("feedback_score", "_fb", F.lit(0.5)).alias("feedback_score"), F.coalesce("reason_codes", F.array(F.concat(F.lit("type:"), F.col("type")), F.lit("related"))).alias("reason_codes"), "rank", "source_id")


def label(*parts: str) -> Column:
    """A short name of the topic: the first token of two letters or more, made safe."""
    tokens = F.flatten(F.array(*[text.tokenize(F.lit(p)) for p in parts])) if parts else F.array().cast("array<string>")
    token = F.coalesce(F.get(F.filter(tokens, lambda w: F.length(w) > 1), F.lit(0)), F.lit("context"))
    short = F.substring(F.regexp_replace(F.regexp_replace(token, r"[^\p{L}\p{N}_-]+", "-"), "^-+|-+$", ""), 1, 32)
    return F.when(short == "", F.lit("context")).otherwise(short)


def reasons(at: Context) -> Column:
    query = "\n".join(x for x in [at.query.strip(), at.task.strip(), *at.recent] if x).strip()
    name = label(*[x for x in (query, at.task, at.intent or "") if x])
    code = lambda condition, value: F.when(condition, value)
    parts = [
        F.concat(F.lit("type:"), F.col("type")),
        code(F.col("semantic_score") > 0.2, F.concat(F.lit("semantic:"), name)),
        code((F.col("lexical_score") > 0.2) & F.lit(bool(query)), F.concat(F.lit("lexical:"), label(query or "query"))),
        code(F.col("task_match") > 0.2, F.concat(F.lit("task:"), label(*[x for x in (at.task, at.intent or "") if x]))),
        code(F.lit(at.intent is not None), F.lit(f"intent:{at.intent}")),
        F.when(F.col("feedback_score") >= 0.67, "feedback:reinforced").when(F.col("feedback_score") <= 0.33, "feedback:negative"),
    ]
    return F.array_compact(F.array(*parts))

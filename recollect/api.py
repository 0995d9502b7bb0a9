"""The engine as one object over a store: what an assistant does with its memories, each call one or more commits.

Reads give DataFrames. Calls that also leave a trace (recall, boot, recall_path) commit it before they return.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import scores, text
from .lineage import settle
from .operators import feedback, fusion, jobs, lexical, lifecycle, listing, vector, writing
from .operators import index as lexical_index
from .operators import surface as surfacing
from .schemas import CHILDREN, KEYS
from .sources import embedders, markdown, tables
from .sources.tables import Store

#: Direct results of a recall that count as used.
PASSIVE_RESULTS = 3
BOOT_GROWTH, ACCESS_GROWTH = 1.1, 1.5


class Memory:
    """One agent's memories in a store. clock gives the time of each call; embedder, if there is one, makes vectors."""

    def __init__(self, store: Store, agent: str = "default", embedder: embedders.Embedder | None = None, clock: Callable[[], datetime] = lambda: datetime.now(UTC), capacity: lifecycle.Capacity = lifecycle.Capacity()):
        self.store, self.agent, self.embedder, self.clock, self.capacity = store, agent, embedder, clock, capacity

    def _now(self) -> str:
        return self.clock().astimezone(UTC).strftime("%Y-%m-%d %H:%M:%S.%f")

    def index(self) -> lexical_index.Index:
        """The stored index where it is that of the present memories, else one made for this call."""
        if self.store.indexed:
            return lexical_index.Index(self.store.read("lexical_tokens"), self.store.read("lexical_postings"))
        return lexical_index.of(self.store.read("memories"))

    def _commit(self, changes: Mapping[str, DataFrame]) -> None:
        """With new or other contents the index and the state of vectors follow, in the same commit."""
        out, old = dict(changes), self.store.read("memories")
        if "memories" in out:
            new = out["memories"] = settle(out["memories"])
            written, gone = settle(new.join(old.select("id", "hash"), ["id", "hash"], "left_anti")), settle(old.select("id").join(new.select("id"), "id", "left_anti"))
            index = lexical_index.changed(self.index(), gone, written) if self.store.indexed else lexical_index.of(new)
            out |= {"lexical_tokens": index.tokens, "lexical_postings": index.postings}
            vectors = out.get("embeddings", self.store.read("embeddings"))
            vectors = vector.after_change(vectors.join(gone.select(F.col("id").alias("memory_id")), "memory_id", "left_anti").select(vectors.columns), new)
            if self.embedder:
                fresh = written.select(F.concat_ws("/", "id", F.lit(self.embedder.id)).alias("id"), F.col("id").alias("memory_id"), F.lit(self.embedder.id).alias("provider_id"), F.lit(None).cast("array<float>").alias("vector"), F.col("hash").alias("content_hash"), F.lit("pending").alias("status"), "created_at", "updated_at")
                vectors = tables.insert_or_ignore(vectors, fresh, KEYS["embeddings"])
            out["embeddings"] = vectors
        self.store.commit(out)

    def remember(self, items: DataFrame | str, kind: str = "event", uri: str | None = None, source: str | None = None, conservative: bool = False) -> DataFrame:
        """Writes texts behind the guard: a table (content, type, uri, source) judged as one batch, or one text. Outcomes: (seq, action, memory_id, step)."""
        if isinstance(items, str):
            items = self.store.spark.range(1).select(F.lit(items).alias("content"), F.lit(kind).alias("type"), F.lit(uri).cast("string").alias("uri"), F.lit(source).cast("string").alias("source"))
        now = self._now()
        rows = items.select(F.monotonically_increasing_id().alias("seq"), "content", "type", F.lit(self.agent).alias("agent_id"), "uri", "source", scores.instant(now).alias("created_at"))
        state = {name: self.store.read(name) for name in ("memories", "paths", "links")}
        changed, told = writing.sync(state, settle(rows), now, conservative=conservative, index=self.index())
        told = settle(told)
        self._commit(changed)
        return told

    def _near(self, query: str, limit: int, **conditions) -> DataFrame | None:
        if self.embedder is None or not query.strip():
            return None
        return vector.search(self.store.read("memories"), self.store.read("embeddings"), self.embedder.embed([query])[0], self.embedder.id, limit, agent=self.agent, **conditions)

    def recall(self, query: str, limit: int = 10, related: bool = False, emotion_tag: str | None = None, record: bool = True, recency: float = 0.0, **conditions) -> DataFrame:
        """(id, score, rank, mode, source_id) for a query. With record, all direct results count as accessed, and the first three give passive feedback."""
        now, mem = self._now(), self.store.read("memories")
        most = limit * 3 if emotion_tag else limit
        near = self._near(query, 2 * most, **conditions)
        out = fusion.recall(mem, lexical.one_query(mem, query), near, self.store.read("links") if related else None, most, now, recency, self.index(), agent=self.agent, **conditions)
        out = settle(out)
        seen = out.filter("source_id is null").select("id")
        if emotion_tag:
            modes = out.select("id", "mode", "source_id")
            out = settle(fusion.with_emotion(out.select("query_id", "id", "score", "rank"), mem, emotion_tag, limit).join(modes, "id").select("query_id", "id", "score", "rank", "mode", "source_id"))
        if record:
            used = out.filter("source_id is null").orderBy("rank").limit(PASSIVE_RESULTS).select(F.col("id").alias("memory_id"))
            self.store.commit({"memories": fusion.record_access(mem, seen, now, ACCESS_GROWTH), "feedback_events": self._with_passive(used, now)} | self._same_index())
        return out.drop("query_id")

    def _same_index(self) -> dict[str, DataFrame]:
        """For commits that leave all contents as they are."""
        index = self.index()
        return {"lexical_tokens": index.tokens, "lexical_postings": index.postings}

    def _with_passive(self, used: DataFrame, now: str) -> DataFrame:
        """The feedback with a passive event for each of `used` (memory_id), but for those that had their three within 24 hours."""
        events = self.store.read("feedback_events")
        full = feedback.passive_counts(events, used, now).filter(F.col("n") >= feedback.PASSIVE_MOST)
        new = used.distinct().join(full, "memory_id", "left_anti")
        rows = new.select(F.concat(F.lit("f-"), F.expr("uuid()")).alias("id"), "memory_id", F.lit("passive").alias("source"), F.lit(1).alias("useful"), F.lit(self.agent).alias("agent_id"), F.lit("passive:useful").alias("event_type"), F.lit(feedback.PASSIVE_VALUE).alias("value"), scores.instant(now).alias("created_at"))
        return events.unionByName(settle(rows).select(events.columns))

    def surface(self, at: surfacing.Context, related: bool = False) -> DataFrame:
        """What is worth showing in a context; leaves no trace."""
        words = " ".join(x for x in (at.query, at.task, *at.recent) if x)
        near = self._near(words, at.window, min_vitality=at.min_vitality)
        return surfacing.surface(self.store.read("memories"), self.store.read("feedback_events"), at, near, self.store.read("links") if related else None, self.index())

    def surface_markdown(self, days: int = 7, limit: int = 50, min_vitality: float = 0.1, types: tuple[str, ...] | None = None) -> DataFrame:
        """(type, line_no, line): what was changed in the last days and is worth loading, as lists by type."""
        at = surfacing.Context(task="context loading", intent="temporal", agent=self.agent, types=types, limit=max(limit, 100), min_vitality=min_vitality)
        since = (self.clock() - timedelta(days=days)).astimezone(UTC).strftime("%Y-%m-%d %H:%M:%S.%f")
        return markdown.recent(self.surface(at), self.store.read("memories"), since, self._now(), limit)

    def boot(self) -> DataFrame:
        """(id, origin) of what a session starts with; the first two kinds count as accessed a little."""
        mem = self.store.read("memories")
        out = settle(listing.boot(mem, self.store.read("paths"), self.agent))
        self.store.commit({"memories": fusion.record_access(mem, out.filter("origin < 2"), self._now(), BOOT_GROWTH)} | self._same_index())
        return out

    def narrative(self, name: str = "Agent") -> DataFrame:
        return listing.narrative(listing.layers(self.store.read("memories"), self.agent), self._now(), name)

    def recall_path(self, uri: str) -> DataFrame:
        """(uri, id, content, type, priority, vitality) of the memory at an address, which counts as accessed; else of all addresses that begin so."""
        mem, paths = self.store.read("memories"), self.store.read("paths")
        found = settle(listing.at_path(mem, paths, uri, self.agent))
        if found.filter("exact").isEmpty():
            return found.drop("exact")
        self.store.commit({"memories": fusion.record_access(mem, found.filter("exact"), self._now(), ACCESS_GROWTH)} | self._same_index())
        return found.filter("exact").drop("exact")

    def feedback(self, memory_id: str, source: str, useful: bool) -> None:
        now, events = self._now(), self.store.read("feedback_events")
        signal = self.store.spark.range(1).select(F.lit(f"f-{uuid.uuid4().hex}").alias("id"), F.lit(memory_id).alias("memory_id"), F.lit(source).alias("source"), F.lit(int(useful)).alias("useful"), F.lit(self.agent).alias("agent_id"), scores.instant(now).alias("created_at"))
        self.store.commit({"feedback_events": events.unionByName(feedback.record(self.store.read("memories"), signal).select(events.columns))})

    def get(self, memory_id: str) -> DataFrame:
        """The row of one memory; the condition reaches the scan."""
        return self.store.read("memories").filter(F.col("id") == memory_id)

    def update(self, changes: DataFrame) -> None:
        """Other values of some columns: (id, and any of a memory's columns)."""
        self._commit({"memories": tables.update(self.store.read("memories"), changes, self._now())})

    def forget(self, ids: DataFrame, hard: bool = False) -> None:
        """A tenth of the vitality is left of `ids` (id), or, hard, nothing of them or what belongs to them."""
        if hard:
            self._commit(tables.delete({name: self.store.read(name) for name in ("memories", *CHILDREN)}, ids))
        else:
            self.store.commit({"memories": tables.forget_softly(self.store.read("memories"), ids, self._now())} | self._same_index())

    def link(self, source: str, target: str, relation: str = "related", weight: float = 1.0, remove: bool = False) -> None:
        old = self.store.read("links")
        new = self.store.spark.range(1).select(F.lit(self.agent).alias("agent_id"), F.lit(source).alias("source_id"), F.lit(target).alias("target_id"), F.lit(relation).alias("relation"), F.lit(weight).alias("weight"), scores.instant(self._now()).alias("created_at"))
        key = KEYS["links"]
        self.store.commit({"links": old.join(new.select(*key), list(key), "left_anti").select(old.columns) if remove else tables.insert_or_replace(old, new, key)})

    def delete_paths(self, ids: DataFrame | None = None, memories: DataFrame | None = None) -> None:
        self.store.commit({"paths": tables.delete_paths(self.store.read("paths"), ids, memories)})

    def archived(self, limit: int = 20) -> DataFrame:
        return listing.archived(self.store.read("memory_archive"), self.agent, limit)

    def restore(self, ids: DataFrame) -> None:
        mem, archive = tables.restore(self.store.read("memories"), self.store.read("memory_archive"), ids, self._now())
        self._commit({"memories": mem, "memory_archive": archive})

    def purge(self) -> None:
        self.store.commit({"memory_archive": tables.purge(self.store.read("memory_archive"), self.agent)})

    def status(self) -> DataFrame:
        own = lambda name: self.store.read(name).filter(F.col("agent_id") == self.agent)
        return listing.status(own("memories"), own("paths"), own("feedback_events"))

    def ingest(self, content: str, source: str = "ingest", dry_run: bool = False) -> tuple[dict[str, int | bool], DataFrame]:
        """Markdown to memories: the counts (extracted, written, skipped, dry_run), and a row an item."""
        file = self.store.spark.range(1).select(F.lit(source).alias("file"), F.lit(content).alias("text"))
        items = settle(markdown.items(file, F.lit(source)))
        n = items.count()
        if dry_run:
            return {"extracted": n, "written": 0, "skipped": n, "dry_run": True}, items.select("index", "type", "uri", F.substring("content", 1, 80).alias("preview"))
        told = self.remember(items.select("content", "type", "uri", F.lit(f"auto:{source}").alias("source")))
        written = told.filter("action <> 'skip'").count()
        return {"extracted": n, "written": written, "skipped": n - written, "dry_run": False}, told

    def reindex(self, progress: Callable[[str, float], None] = lambda what, share: None) -> dict[str, int]:
        """The lexical index anew, then the vectors that are pending or failed; progress hears of each step."""
        mem = self.store.read("memories")
        index = lexical_index.of(mem)
        self.store.commit({"memories": mem, "lexical_tokens": index.tokens, "lexical_postings": index.postings})
        progress("index", 0.5)
        made = 0
        if self.embedder:
            vectors, embedder, now = self.store.read("embeddings"), self.embedder, self._now()
            due = vector.pending(vectors, embedder.id).select(F.col("memory_id").alias("id")).join(mem.select("id", "content", "hash"), "id")
            done = settle(embedders.embed_table(due, lambda: embedder).withColumns({"id": F.concat_ws("/", "memory_id", "provider_id"), "created_at": scores.instant(now), "updated_at": scores.instant(now)}))
            self.store.commit({"embeddings": vector.upsert(vectors, done.select(vectors.columns))})
            made = done.filter("status = 'ready'").count()
        progress("embeddings", 0.9)
        progress("done", 1.0)
        return {"memories": mem.count(), "embedded": made}

    def reflect(self, phase: str = "all", phases: Mapping[str, Callable[[str], Mapping[str, int]]] | None = None, job_id: str | None = None) -> dict:
        """Decay, tidying and governing, or one of them, each its own commit, with a job in the log.

        The latest job of the phase that runs or failed is taken up where it stopped. A failure is
        recorded with its checkpoint, then raised. Returns job_id, resumed, results, before and after.
        """
        run = phases or {"decay": self._decay, "tidy": self._tidy, "govern": self._govern}
        log = self.store.read("maintenance_jobs")
        found = log.filter(F.col("job_id") == job_id).first() if job_id else jobs.resumable(log, phase).first()
        state = (jobs.checkpoint_of(found["checkpoint"]) if found else None) or jobs.first_checkpoint(phase)
        job = found["job_id"] if found else job_id or f"j-{uuid.uuid4().hex}"
        if found is None:
            self.store.commit({"maintenance_jobs": log.unionByName(jobs.created(self.store.spark, job, phase, self._now()).select(log.columns))})

        def save(status: str, error: str | None = None) -> None:
            self.store.commit({"maintenance_jobs": jobs.changed(self.store.read("maintenance_jobs"), job, status, state, error, self._now())})

        before = listing.totals(self.store.read("memories").filter(F.col("agent_id") == self.agent)).first().asDict()
        for name in jobs.PHASES if phase == "all" else (phase,):
            if name in state["completedPhases"]:
                continue
            state["nextPhase"] = name
            save("running")
            try:
                state["phaseResults"][name] = dict(run[name](self._now()))
            except Exception as e:
                save("failed", str(e))
                raise
            state["completedPhases"].append(name)
        state["nextPhase"] = None
        save("completed")
        after = listing.totals(self.store.read("memories").filter(F.col("agent_id") == self.agent)).first().asDict()
        return {"job_id": job, "resumed": found is not None, "results": state["phaseResults"], "before": before, "after": after}

    def _parts(self) -> tuple[DataFrame, DataFrame]:
        """This agent's memories and the others'."""
        mem = self.store.read("memories")
        return mem.filter(F.col("agent_id") == self.agent), mem.filter(F.col("agent_id") != self.agent)

    def _decay(self, now: str) -> dict[str, int]:
        own, others = self._parts()
        told = settle(lifecycle.decay(own, now))
        self.store.commit({"memories": lifecycle.with_vitality(own, told.filter("changed").select("id", "vitality"), now).unionByName(others)} | self._same_index())
        return lifecycle.decay_summary(told).first().asDict()

    def _tidy(self, now: str) -> dict[str, int]:
        own, others = self._parts()
        left = settle(lifecycle.tidy(own, now))
        told = {"removed": own.count() - left.count()}
        gone = own.select("id").join(left.select("id"), "id", "left_anti")
        rest = tables.delete({name: self.store.read(name) for name in CHILDREN}, settle(gone))
        self._commit(rest | {"memories": left.unionByName(others)})
        return told

    def _govern(self, now: str) -> dict[str, int]:
        own, others = self._parts()
        paths = self.store.read("paths")
        mine = paths.filter(F.col("agent_id") == self.agent)
        out, told = lifecycle.govern(own, mine, self.store.read("memory_archive"), feedback.penalty(self.store.read("feedback_events")), now, self.capacity, self.index())
        counts = told.first().asDict()
        left = settle(out["memories"])
        gone = settle(own.select("id").join(left.select("id"), "id", "left_anti"))
        rest = tables.delete({name: self.store.read(name) for name in CHILDREN if name != "paths"}, gone)
        self._commit(rest | {"memories": left.unionByName(others), "paths": out["paths"].unionByName(paths.filter(F.col("agent_id") != self.agent)), "memory_archive": out["memory_archive"]})
        return counts

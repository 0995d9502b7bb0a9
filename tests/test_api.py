"""The engine as one object: each call with what it leaves behind, on small stores."""

from datetime import UTC, datetime, timedelta

import pytest

from recollect.api import Memory
from recollect.operators import jobs, lifecycle, surface
from recollect.operators.index import Index, changed, of
from recollect.operators.lifecycle import Capacity
from recollect.sources import markdown, tables
from recollect.sources.tables import ConflictError, Store


class Clock:
    def __init__(self):
        self.now = datetime(2026, 3, 1, 12, tzinfo=UTC)

    def __call__(self):
        return self.now


@pytest.fixture
def memory(spark, tmp_path):
    return Memory(Store(spark, f"file://{tmp_path}/store"), "a", clock=Clock())


def ids(memory):
    return {r["content"]: r["id"] for r in memory.store.read("memories").collect()}


def test_remember_recall_and_what_it_leaves(memory, spark):
    texts = ["xiaoxin is my contractor and he is gentle", "TypeScript is better than Python for agents", "today configured mihomo proxy for xiaoxin"]
    told = memory.remember(spark.createDataFrame([(t, "knowledge", f"knowledge://notes/{i}", None) for i, t in enumerate(texts)], "content string, type string, uri string, source string"))
    assert {r["action"] for r in told.collect()} == {"add"} and memory.store.indexed
    assert memory.remember(texts[0]).first()["action"] == "skip"
    for n in range(1, 5):
        got = memory.recall("xiaoxin contractor").orderBy("rank").collect()
        assert "contractor" in {v: k for k, v in ids(memory).items()}[got[0]["id"]]
        row = memory.get(got[0]["id"]).first()
        assert row["access_count"] == n and row["vitality"] == 1.0 and abs(row["stability"] - 90 * 1.5**n) < 1e-6
        events = memory.store.read("feedback_events").filter(f"memory_id = '{got[0]['id']}'")
        assert events.count() == min(n, 3)  # passive feedback has its limit
    before = memory.store.manifest
    memory.recall("xiaoxin", record=False).collect()
    assert memory.store.manifest == before and memory.store.indexed


def test_paths(memory, spark):
    memory.remember("The user likes green tea a lot", "identity", "core://user/tea")
    memory.remember("The user owns two old bicycles", "identity", "core://user/bikes")
    one = memory.recall_path("core://user/tea").collect()
    assert [r["content"] for r in one] == ["The user likes green tea a lot"] and memory.get(one[0]["id"]).first()["access_count"] == 1
    assert [r["uri"] for r in memory.recall_path("core://user/").orderBy("uri").collect()] == ["core://user/bikes", "core://user/tea"]
    assert memory.recall_path("core://nobody").count() == 0
    memory.delete_paths(memories=spark.createDataFrame([(one[0]["id"],)], "id string"))
    assert [r["uri"] for r in memory.store.read("paths").collect()] == ["core://user/bikes"]
    new = spark.createDataFrame([("1", one[0]["id"], "a", "core://user/bikes"), ("2", one[0]["id"], "a", "http://x"), ("3", "none", "a", "core://x"), ("4", one[0]["id"], "b", "core://y"), ("5", one[0]["id"], "a", "core://z"), ("6", one[0]["id"], "a", "core://z")], "id string, memory_id string, agent_id string, uri string")
    told = tables.rejected_paths(memory.store.read("paths"), new, memory.store.read("memories")).collect()
    assert {r["id"]: r["reason"] for r in told} == {"1": "taken", "2": "domain", "3": "memory", "4": "agent", "6": "taken"}


def test_boot_forget_update_and_index(memory, spark):
    memory.remember("Her name is Ada Lovelace", "identity")
    memory.remember("Knows the analytical engine well", "knowledge")
    ada, engine = (ids(memory)[t] for t in ("Her name is Ada Lovelace", "Knows the analytical engine well"))
    assert [r["id"] for r in memory.boot().collect()] == [ada]
    assert memory.get(ada).first()["access_count"] == 1 and memory.get(engine).first()["access_count"] == 0
    memory.update(spark.createDataFrame([(engine, "Knows difference engines", 1)], "id string, content string, priority int"))
    row = memory.get(engine).first()
    assert row["content"] == "Knows difference engines" and row["priority"] == 1 and row["type"] == "knowledge"
    assert memory.store.indexed and [r["id"] for r in memory.recall("difference").collect()] == [engine] and memory.recall("analytical").count() == 0
    memory.forget(spark.createDataFrame([(engine,)], "id string"))
    assert abs(memory.get(engine).first()["vitality"] - 0.1) < 1e-9
    memory.forget(spark.createDataFrame([(engine,)], "id string"), hard=True)
    assert memory.get(engine).count() == 0 and memory.recall("difference").count() == 0
    assert {r["type"] for r in memory.narrative().collect()} == {"identity"} and memory.status().first()["total"] == 1


def test_vectors_follow_contents(spark, tmp_path):
    class Fake:  # goes to the workers by value
        id = "fake:1"

        def embed(self, texts):
            return [[float(1 + (ord(t[0]) % 5)), float(len(t) % 7), 1.0] for t in texts]

    memory = Memory(Store(spark, f"file://{tmp_path}/store"), "a", Fake(), Clock())
    memory.remember("green tea in the morning", "knowledge")
    memory.remember("old bicycles need some care", "knowledge")
    assert {r["status"] for r in memory.store.read("embeddings").collect()} == {"pending"}
    heard = []
    assert memory.reindex(lambda what, share: heard.append((what, share))) == {"memories": 2, "embedded": 2}
    assert heard == [("index", 0.5), ("embeddings", 0.9), ("done", 1.0)]
    assert {r["mode"] for r in memory.recall("green tea").collect()} == {"dual-path"}
    own = ids(memory)["green tea in the morning"]
    memory.update(spark.createDataFrame([(own, "black tea at night")], "id string, content string"))
    assert {r["memory_id"]: r["status"] for r in memory.store.read("embeddings").collect()}[own] == "pending"


def test_reflect_resumes_and_governs(memory, spark):
    rows = [(f"Fact number {i} about the {w} of the old town", "knowledge", None, None) for i, w in enumerate(("bridge", "tower", "market", "harbour", "castle", "gate"))]
    memory.remember(spark.createDataFrame(rows, "content string, type string, uri string, source string"))
    memory.capacity = Capacity({"identity": None, "emotion": 50, "knowledge": 3, "event": 50})
    calls = []

    def phase(name, fail=False):
        def run(now):
            calls.append(name)
            if fail and calls.count(name) == 1:
                raise RuntimeError("broken")
            return {"n": 1}

        return run

    broken = {"decay": phase("decay"), "tidy": phase("tidy", True), "govern": phase("govern")}
    with pytest.raises(RuntimeError):
        memory.reflect(phases=broken)
    failed = jobs.latest(memory.store.read("maintenance_jobs")).first()
    assert failed["status"] == "failed" and failed["error"] == "broken" and jobs.checkpoint_of(failed["checkpoint"])["completedPhases"] == ["decay"]
    again = memory.reflect(phases=broken)
    assert again["resumed"] and again["job_id"] == failed["job_id"] and calls == ["decay", "tidy", "tidy", "govern"]
    memory.clock.now += timedelta(days=30)
    told = memory.reflect()
    assert not told["resumed"] and told["results"]["govern"] == {"orphan_paths": 0, "empty_memories": 0, "evicted": 3, "archived": 3}
    assert told["before"]["total"] == 6 and told["after"]["total"] == 3 and memory.archived().count() == 3 and memory.store.indexed
    memory.restore(memory.archived(1).select("id"))
    assert memory.store.read("memories").count() == 4 and memory.archived().count() == 2
    memory.purge()
    assert memory.archived().count() == 0 and jobs.checkpoint_of("{") is None


def test_ingest(memory):
    text = "## About me\n- prefers green tea over coffee\n## Journal event\n- went to the old harbour in March\n## Notes\n- heartbeat_ok\n- the tower opens at nine o'clock"
    counts, items = memory.ingest(text, "MEMORY.md", dry_run=True)
    assert counts == {"extracted": 3, "written": 0, "skipped": 3, "dry_run": True} and items.count() == 3 and memory.store.read("memories").count() == 0
    assert memory.ingest(text, "MEMORY.md")[0] == {"extracted": 3, "written": 3, "skipped": 0, "dry_run": False}
    assert {r["source"] for r in memory.store.read("memories").collect()} == {"auto:MEMORY.md"}
    assert memory.ingest(text, "MEMORY.md")[0]["written"] == 0
    lines = memory.surface_markdown()
    assert {r["type"]: r["line"] for r in lines.collect()}["event"] == "- went to the old harbour in March (今天)"
    assert markdown.recent_file(lines, "now").startswith("# Recent Memories\n\n> Last updated: now\n\n## Identity\n- prefers green tea")
    assert memory.surface(surface.Context(query="tea", agent="a")).first()["type"] == "identity"


def test_links_and_feedback(memory):
    memory.remember("The bridge is made of stone", "knowledge")
    memory.remember("Nobody sells umbrellas on Sunday", "knowledge")
    a, b = sorted(ids(memory).values())
    memory.link(a, b, weight=0.85)
    memory.link(a, b, weight=0.5)
    assert [r["weight"] for r in memory.store.read("links").collect()] == [0.5]
    memory.feedback(a, "recall", True)
    memory.feedback("nobody", "recall", True)
    assert [r["event_type"] for r in memory.store.read("feedback_events").collect()] == ["recall:useful"]
    memory.link(a, b, remove=True)
    assert memory.store.read("links").count() == 0


def test_of_two_writers_the_later_fails(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    number, manifest = store._current()
    store._save(manifest, number + 1)
    with pytest.raises(ConflictError):
        store._save(manifest, number + 1)
    assert Store(spark, f"file://{tmp_path}/store").manifest == manifest


def test_index_follows_changes(spark):
    old = spark.createDataFrame([("1", "green tea", "a"), ("2", "old bikes", "a"), ("3", "stone bridge", "b")], "id string, content string, agent_id string")
    new = spark.createDataFrame([("1", "green tea", "a"), ("2", "new bikes", "a"), ("4", "high tower", "b")], "id string, content string, agent_id string")
    index = changed(of(old), old.filter("id = '3'"), new.filter("id in ('2', '4')"))
    for got, want in ((index.tokens, of(new).tokens), (index.postings, of(new).postings)):
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert isinstance(index, Index) and index.corpus.first().asDict() == {"n": 3, "total": 6}


def test_capacity_from_settings():
    got = lifecycle.Capacity.from_settings({"AM_MAX_KNOWLEDGE": "7", "AM_MAX_IDENTITY": "3x", "AM_MAX_EVENT": "-1", "AM_MAX_MEMORIES": "", "AM_MAX_EMOTION": "no"}, "AM_")
    assert got == Capacity({"identity": 3, "emotion": 50, "knowledge": 7, "event": 50}, 350)

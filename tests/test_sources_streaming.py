from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from recollect.operators import writing
from recollect.schemas import TABLES
from recollect.sources import embedders, markdown, migrations, tables
from recollect.streaming import flows

NOW = "2024-03-01 00:00:00"


def empty(spark, *names):
    return {n: spark.createDataFrame([], TABLES[n]) for n in names}


def some(spark, *contents, kind="knowledge", agent="a"):
    return tables.new_memories(spark.createDataFrame([(f"m{i}", c, kind, agent) for i, c in enumerate(contents)], "id string, content string, type string, agent_id string"), NOW)


def test_store_commits_all_or_nothing(spark, tmp_path):
    store = tables.Store(spark, f"file://{tmp_path}/s")
    assert store.read("memories").count() == 0
    store.commit({"memories": some(spark, "one", "two"), **empty(spark, "paths")})
    assert store.read("memories").count() == 2 and store.manifest["versions"] == {"memories": 1, "paths": 1}
    with pytest.raises(tables.ConflictError):
        store.commit({"memories": some(spark, "same", "same")})
    assert store.manifest["versions"]["memories"] == 1 and store.read("memories").count() == 2
    store.commit({"memories": tables.update_content(store.read("memories"), spark.createDataFrame([("m0", "new")], "id string, content string"), NOW)})
    again = tables.Store(spark, f"file://{tmp_path}/s")
    assert {r["content"] for r in again.read("memories").collect()} == {"new", "two"} and [(f.name, f.dataType) for f in again.read("memories").schema] == [(f.name, f.dataType) for f in TABLES["memories"]]


def test_defaults_and_dedup(spark):
    rows = {r["type"]: r for k in ("identity", "emotion", "knowledge", "event") for r in some(spark, f"a {k}", kind=k).collect()}
    assert [(rows[k]["priority"], rows[k]["stability"]) for k in ("identity", "emotion", "knowledge", "event")] == [(0, 999999.0), (1, 365.0), (2, 90.0), (3, 14.0)]
    once = some(spark, "test dedup")
    assert tables.insert(once, some(spark, " test dedup ").withColumn("id", F.lit("z"))).count() == 1
    assert tables.insert(once, some(spark, "test dedup", agent="b").withColumn("id", F.lit("z"))).count() == 2


def test_delete_cascades_and_archive_round_trip(spark):
    mem = some(spark, "one", "two", "three").withColumn("vitality", F.when(F.col("id") == "m1", 0.05).otherwise(0.9))
    links = spark.createDataFrame([("a", "m0", "m1", "related", 1.0, datetime(2024, 1, 1)), ("a", "m0", "m2", "related", 1.0, datetime(2024, 1, 1))], TABLES["links"])
    out = tables.delete({"memories": mem, "links": links}, mem.filter("id = 'm1'").select("id"))
    assert out["memories"].count() == 2 and [r["target_id"] for r in out["links"].collect()] == ["m2"]
    live, old = tables.archive(mem, empty(spark, "memory_archive")["memory_archive"], mem.filter("id <> 'm2'").select("id"), NOW)
    assert [r["id"] for r in live.collect()] == ["m2"] and [(r["id"], r["archive_reason"]) for r in old.collect()] == [("m0", "eviction")]
    back, rest = tables.restore(live, old, old.select("id"), "2024-04-01")
    assert {r["id"]: r["updated_at"] for r in back.collect()}["m0"] == datetime(2024, 4, 1) and rest.count() == 0
    assert tables.purge(old, "a").count() == 0 and tables.purge(old, "b").count() == 1 and tables.purge(old).count() == 0


def test_paths_are_checked(spark):
    mem = some(spark, "one")
    rows = [("p1", "m0", "a", "core://user/name", None, None), ("p2", "m0", "a", "identity://x", None, None), ("p3", "m0", "b", "core://y", None, None), ("p4", "gone", "a", "core://z", None, None)]
    new = spark.createDataFrame([(*r, datetime(2024, 1, 1)) for r in rows], "id string, memory_id string, agent_id string, uri string, alias string, domain string, created_at timestamp")
    got = tables.create_paths(empty(spark, "paths")["paths"], new, mem)
    assert [(r["id"], r["domain"]) for r in got.collect()] == [("p1", "core")]
    assert tables.create_paths(got, new, mem).count() == 1


def incoming(spark, *rows):
    return spark.createDataFrame([(i, c, k, "a", u, None, datetime(2024, 2, 1)) for i, (c, k, u) in enumerate(rows)], "seq int, content string, type string, agent_id string, uri string, source string, created_at timestamp")


def test_writing_a_batch(spark):
    base = "the deployment pipeline uses blue green rollout with health checks"
    store = empty(spark, "paths", "links") | {"memories": some(spark, base, "user likes long walks at night")}
    changed, told = writing.sync(store, incoming(spark, (base, "knowledge", None), ("a wholly new fact about Berlin", "knowledge", "core://berlin"), ("a wholly new fact about Berlin", "knowledge", None), ("tiny", "knowledge", None)), NOW)
    actions = {r["seq"]: r["action"] for r in told.collect()}
    assert actions == {0: "skip", 1: "add", 3: "skip"}
    assert changed["memories"].count() == 3 and [r["uri"] for r in changed["paths"].collect()] == ["core://berlin"]
    again, told = writing.sync(changed, incoming(spark, ("other words for the city of Berlin", "knowledge", "core://berlin")), NOW)
    assert told.first()["action"] == "update" and {r["content"] for r in again["memories"].collect()} >= {"other words for the city of Berlin"} and again["memories"].count() == 3


def test_writing_in_order(spark, tmp_path):
    store = tables.Store(spark, f"file://{tmp_path}/s")

    def keep(changed):
        store.commit(changed)
        return {n: store.read(n) for n in changed}

    rows = incoming(spark, ("a first fact about the city of Berlin", "knowledge", None), ("a first fact about the city of Berlin", "knowledge", None))
    state, outcomes = writing.sync_in_order({n: store.read(n) for n in ("memories", "paths", "links")}, rows, NOW, keep)
    assert [o[1] for o in outcomes] == ["add", "skip"] and store.read("memories").count() == 1


def test_markdown_items(spark):
    text = "intro\n## About me\n- likes tea\n* HEARTBEAT_OK\n\n## 事件\nwent out\n## Empty\n\n## Notes\n- 无变化\n- PR #12 状态无变化\n- fact"
    got = [tuple(r) for r in markdown.items(spark.createDataFrame([("f", text)], "file string, text string"), F.lit("My Notes.md")).orderBy("index").collect()]
    assert got == [("f", 1, "identity", "likes tea", "core://ingest/about-me/1"), ("f", 2, "event", "went out", "event://my-notes-md/2"), ("f", 3, "knowledge", "fact", "knowledge://my-notes-md/3")]
    assert markdown.items(spark.createDataFrame([("f", ""), ("g", " \n")], "file string, text string")).count() == 0


def test_import_and_export(spark, tmp_path):
    (tmp_path / "weekly").mkdir()
    (tmp_path / "MEMORY.md").write_text("# top\n## About Me\nI am\n## Tea Facts\nhot\n## none\n")
    (tmp_path / "2024-01-02.md").write_text("did things")
    (tmp_path / "weekly" / "w1.md").write_text("a week")
    (tmp_path / "other.md").write_text("ignored")
    got = {r["uri"]: (r["type"], r["content"], r["source"]) for r in markdown.import_directory(spark, str(tmp_path)).collect()}
    assert got["knowledge://memory-md/about-me"] == ("identity", "## About Me\nI am", "migrate:MEMORY.md") and got["event://journal/2024-01-02"][0] == "event" and got["knowledge://weekly/w1"] == ("knowledge", "a week", "migrate:weekly/w1.md")
    mem = some(spark, "fact one", "fact two").unionByName(some(spark, "trip", kind="event").withColumn("id", F.lit("e")))
    names = markdown.export(mem, "a", str(tmp_path / "out"))
    assert sorted(names) == ["2024-03-01.md", "MEMORY.md"] and "- trip" in (tmp_path / "out" / "2024-03-01.md").read_text() and "## Knowledge" in (tmp_path / "out" / "MEMORY.md").read_text()


def test_migration_from_the_first_version(spark):
    at = datetime(2024, 1, 1)
    old = {
        "memories": spark.createDataFrame([("m1", "x", "event", 3, "h", "a", at, at), ("m2", "y", "event", 3, "i", "b", at, at)], "id string, content string, type string, priority int, hash string, agent_id string, created_at timestamp, updated_at timestamp"),
        "paths": spark.createDataFrame([("p", "m1", "core://x", "core", at)], "id string, memory_id string, uri string, domain string, created_at timestamp"),
        "links": spark.createDataFrame([("m1", "m2", "related", 1.0, at), ("m1", "m1", "related", 1.0, at)], "source_id string, target_id string, relation string, weight double, created_at timestamp"),
        "embeddings": spark.createDataFrame([("m1", "mini", [1.0])], "memory_id string, model string, vector array<float>"),
    }
    assert migrations.version_of(old) == 1
    new = migrations.migrate(old)
    assert new["paths"].first()["agent_id"] == "a" and [r["target_id"] for r in new["links"].collect()] == ["m1"] and new["embeddings"].first()["provider_id"] == "legacy:a:mini"
    assert all(new[n].columns == [f.name for f in s] for n, s in TABLES.items()) and migrations.version_of(new) == 8
    twice = migrations.migrate(new)
    assert all(sorted(map(str, twice[n].collect())) == sorted(map(str, new[n].collect())) for n in ("memories", "paths", "links"))


class Fake:
    def __init__(self, name, fail=False):
        self.id, self.fail, self.calls = name, fail, 0

    def embed(self, texts):
        self.calls += 1
        if self.fail:
            raise OSError("down")
        return [[float(len(t))] for t in texts]


def test_failover():
    now = [0.0]
    a, b = Fake("a", True), Fake("b")
    f = embedders.Failover(a, b, 30, lambda: now[0])
    assert f.embed(["xx"]) == [[2.0]] and f.degraded and f.id == "b"
    f.embed(["x"])
    assert a.calls == 1
    now[0], a.fail = 31.0, False
    assert f.embed(["xxx"]) == [[3.0]] and not f.degraded and f.id == "a" and a.calls == 2


def test_http_embedders():
    sent = []

    def send(url, body, headers):
        sent.append((url, body, headers))
        return {"data": [{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}], "embeddings": [{"values": [1.0]}, {"values": [2.0]}]}

    assert embedders.HttpEmbedder("openai", "u", "m", "k", 1, send).embed(["a", "b"]) == [[1.0], [2.0]]
    assert embedders.HttpEmbedder("gemini", "u", "m", "k", 1, send).embed(["a", "b"]) == [[1.0], [2.0]]
    with pytest.raises(ValueError):
        embedders.HttpEmbedder("openai", "u", "m", None, 3, send).embed(["a", "b"])
    assert embedders.provider_id("p", "m", "u") == embedders.provider_id("p", "m", "u") != embedders.provider_id("p", "m", "v")
    assert embedders.decode_vector(embedders.encode_vector([1.0, -0.5])) == [1.0, -0.5]


def test_embedding_a_table(spark):
    def make():
        class Model:
            id = "x"

            def embed(self, texts):
                if "bad" in texts:
                    raise ValueError
                return [[float(len(t)), 0.0] for t in texts]

        return Model()

    rows = some(spark, "one", "three", "bad").coalesce(1)
    got = {r["memory_id"]: (r["status"], r["vector"]) for r in embedders.embed_table(rows, make, batch=1).collect()}
    assert got == {"m0": ("ready", [3.0, 0.0]), "m1": ("ready", [5.0, 0.0]), "m2": ("failed", None)}


def test_watched_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "notes.md").write_text("## Notes\n- one\n- two")
    (folder / "2024-01-01.md").write_text("## Notes\n- journal")
    (folder / "x.txt").write_text("## Notes\n- no")
    got = []
    run = lambda: flows.ingest(flows.watched(spark, str(folder)), lambda items, n: got.extend(r["content"] for r in items.collect()), str(tmp_path / "c"), once=True).awaitTermination()
    run()
    assert sorted(got) == ["one", "two"]
    (folder / "more.md").write_text("## Notes\n- three")
    run()
    assert sorted(got) == ["one", "three", "two"]


def test_limiter_keeps_its_state_between_batches(spark, tmp_path):
    folder = tmp_path / "in"
    schema = "memory_id long, created_at timestamp"
    accepted = []

    def run(hours):
        at = [datetime(2024, 1, 1) + timedelta(hours=h) for h in hours]
        spark.createDataFrame([(1, t) for t in at], schema).coalesce(1).write.mode("append").parquet(str(folder))
        stream = flows.limit_passive(spark.readStream.schema(schema).parquet(str(folder)))
        stream.writeStream.foreachBatch(lambda df, n: accepted.extend(r["at_us"] for r in df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()

    run([0, 1])
    run([2, 3])
    run([25])
    hour = 3_600_000_000
    base = min(accepted)
    assert [(t - base) // hour for t in sorted(accepted)] == [0, 1, 2, 25]

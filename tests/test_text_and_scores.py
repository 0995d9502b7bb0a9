"""Column functions and operators on hand-written rows, CJK and other awkward text among them."""

import math
import random
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recollect.functions import scores, text
from recollect.operators import feedback, fusion, guard, lexical, lifecycle, listing, surface, vector


@pytest.fixture(scope="module")
def value(spark):
    return lambda c: spark.range(1).select(c.alias("x")).first()["x"]


@pytest.mark.parametrize(("content", "tokens"), [
    ("Alice alice a Bob_x", ["Alice", "alice", "Bob_x"]),
    ("été naïve", ["na", "ve"]),
    ("我喜欢蓝色 ok", ["ok", "喜", "欢", "蓝", "色", "我喜", "喜欢", "欢蓝", "蓝色"]),
    ("的 了", []),
    ("", []),
    (" ".join(f"w{i}" for i in range(40)), [f"w{i}" for i in range(30)]),
])
def test_tokenize(value, content, tokens):
    assert value(text.tokenize(F.lit(content))) == tokens


def test_hash_ignores_outer_white_space(value):
    assert value(text.content_hash(F.lit(" x\n\t"))) == value(text.content_hash(F.lit("x"))) == "2d711642b726b044"


@pytest.mark.parametrize(("uri", "domain"), [("core://user/name", "core"), ("x://", None), ("no address", None), ("Core://a", None)])
def test_uri(value, uri, domain):
    assert value(text.uri_domain(F.lit(uri))) == domain


@pytest.mark.parametrize(("source", "slug"), [("  Hello, World! ", "hello-world"), ("笔记 2024", "笔记-2024"), ("!!!", "item"), ("x" * 80, "x" * 60)])
def test_slug(value, source, slug):
    assert value(text.slugify(F.lit(source))) == slug


def test_numbers_and_entities(value):
    assert value(text.numbers(F.lit("v1.2.3 port 8080 and 7 or x99 99"))) == ["1.2.3", "8080", "99"]
    assert value(text.entities(F.lit("Alice met Bob-2 at 10:30 #tag core://x 北京"))) == ["Alice", "Bob-2", "10:30", "#tag", "core://x", "北京"]


@pytest.mark.parametrize(("stability", "days", "priority", "low", "high"), [(999999, 3650, 0, 1, 1), (365, 30, 1, 0.9, 1), (365, 9999, 1, 0.3, 0.3), (14, 30, 3, 0, 0.15)])
def test_vitality(value, stability, days, priority, low, high):
    assert low <= value(scores.vitality(F.lit(float(stability)), F.lit(float(days)), F.lit(priority))) <= high


@settings(max_examples=20, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.sampled_from("abcdef"), max_size=6), st.lists(st.sampled_from("abcdef"), max_size=6))
def test_overlap(value, a, b):
    sa, sb = set(a), set(b)
    array = lambda s: F.array(*[F.lit(x) for x in sorted(s)]).cast("array<string>")
    assert value(scores.overlap(array(sa), array(sb))) == (len(sa & sb) / max(len(sa), len(sb)) if sa and sb else 0)


def test_clamp(value):
    assert [value(scores.clamp01(F.lit(x).cast("double"))) for x in (-1, 0.5, 2, math.nan, math.inf, None)] == [0, 0.5, 1, 0, 0, 0]


def memory(i, content, kind="knowledge", **more):
    at = datetime(2024, 1, 1) + timedelta(hours=i)
    priority = {"identity": 0, "emotion": 1, "knowledge": 2, "event": 3}[kind]
    return {"id": f"m{i}", "content": content, "type": kind, "priority": priority, "vitality": 1.0, "stability": 90.0, "access_count": 0, "last_accessed": None, "created_at": at, "updated_at": at, "source": None, "agent_id": "a", "hash": None, "emotion_tag": None} | more


SCHEMA = "id string, content string, type string, priority int, vitality double, stability double, access_count int, last_accessed timestamp, created_at timestamp, updated_at timestamp, source string, agent_id string, hash string, emotion_tag string"


@pytest.fixture(scope="module")
def mem(spark):
    def make(*rows):
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], SCHEMA)
        return df.withColumn("hash", text.content_hash(F.col("content")))

    return make


def bm25(docs, query):
    """By the formula, over lists of terms; query: lists of terms that must follow each other."""
    n, average = len(docs), sum(map(len, docs)) / len(docs)
    tf = [[sum(d[i : i + len(p)] == p for i in range(len(d) - len(p) + 1)) for d in docs] for p in query]
    out = []
    for k, d in enumerate(docs):
        s = 0
        for counts in tf:
            df = sum(c > 0 for c in counts)
            if counts[k]:
                idf = math.log((n - df + 0.5) / (df + 0.5))
                s += (idf if idf > 0 else 1e-6) * counts[k] * 2.2 / (counts[k] + 1.2 * (0.25 + 0.75 * len(d) / average))
        out.append(s)
    return out


def test_bm25_with_phrases_and_case(mem):
    docs = ["Alice alice foo_bar baz", "foo qux bar alpha", "bar foo beta", "nothing here else", "喜欢蓝色", "blank words only"]
    rows = mem(*[memory(i, d) for i, d in enumerate(docs)])
    terms = [["alice", "alice", "foo", "bar", "baz"], ["foo", "qux", "bar", "alpha"], ["bar", "foo", "beta"], ["nothing", "here", "else"], ["喜", "欢", "蓝", "色", "喜欢", "欢蓝", "蓝色"], ["blank", "words", "only"]]
    for query, phrases in (("foo_bar", [["foo", "bar"]]), ("Alice alice", [["alice"], ["alice"]]), ("蓝色", [["蓝"], ["色"], ["蓝色"]])):
        got = {r["id"]: r["score"] for r in lexical.bm25_scores(rows, lexical.one_query(rows, query)).collect()}
        want = {f"m{i}": s for i, s in enumerate(bm25(terms, phrases)) if s}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in got)
    assert lexical.search(rows, lexical.one_query(rows, "")).count() == 0


def test_lexical_first_hit(mem):
    rows = mem(memory(1, "xiaoxin is my contractor and he is gentle"), memory(2, "TypeScript is better than Python for agents"), memory(3, "today configured mihomo proxy for xiaoxin"))
    hits = lexical.search(rows, lexical.one_query(rows, "xiaoxin contractor")).orderBy("rank").collect()
    assert [h["id"] for h in hits] == ["m1", "m3"]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "memory_id string, provider_id string, vector array<float>, content_hash string, status string")


def test_vector_search_and_stale_vectors(spark, mem):
    rows = mem(memory(1, "one"), memory(2, "two"), memory(3, "three"))
    h = {r["id"]: r["hash"] for r in rows.collect()}
    emb = vectors(spark, [("m1", "p", [1.0, 0.0], h["m1"], "ready"), ("m2", "p", [0.7, 0.7], h["m2"], "ready"), ("m3", "p", [1.0, 0.0], "other", "ready")])
    hits = vector.search(rows, emb, [1.0, 0.0], "p").orderBy("rank").collect()
    assert [(r["id"], r["similarity"]) for r in hits] == [("m1", 1.0), ("m2", 0.707107)]
    after = {r["memory_id"]: (r["status"], r["vector"]) for r in vector.after_change(emb, rows).collect()}
    assert after["m3"] == ("pending", None) and after["m1"][0] == "ready"
    assert vector.search(rows, emb, [1.0, 0.0, 0.0], "p").count() == 0


def test_fusion_prefers_the_higher_priority(spark, mem):
    rows = mem(memory(1, "coffee notes"), memory(2, "likes coffee", "identity"))
    words = spark.createDataFrame([(0, "m1", 1), (0, "m2", 2)], "query_id long, id string, rank long")
    near = spark.createDataFrame([(0, "m2", 0.9, 1), (0, "m1", 0.8, 2)], "query_id long, id string, similarity double, rank long")
    assert [r["id"] for r in fusion.fuse(rows, words, near).orderBy("rank").collect()] == ["m2", "m1"]


def test_recall_modes(spark, mem):
    rows = mem(memory(1, "red apple"), memory(2, "green pear"))
    near = spark.createDataFrame([(0, "m2", 0.9, 1)], "query_id long, id string, similarity double, rank long")
    mode = lambda query, n: {r["mode"] for r in fusion.recall(rows, lexical.one_query(rows, query), n).collect()}
    assert mode("apple", near) == {"dual-path"} and mode("unknown", near) == {"vector-only"} and mode("apple", near.limit(0)) == {"bm25-only"} and mode("apple", None) == {"bm25-only"}


def test_related_memories(spark, mem):
    rows = mem(memory(1, "red apple"), memory(2, "weak", vitality=0.02), *[memory(i, f"n{i}") for i in range(3, 12)])
    links = spark.createDataFrame([("m1", "m2", 0.85), *[("m1", f"m{i}", 0.1 * (i - 3)) for i in range(3, 12)], ("m1", "gone", 0.99)], "source_id string, target_id string, weight double")
    got = {r["id"]: (r["source_id"], r["score"]) for r in fusion.recall(rows, lexical.one_query(rows, "apple"), links=links).collect()}
    assert got["m2"][0] == "m1" and got["m1"][0] is None and len(got) == 6
    assert got["m2"][1] == pytest.approx(got["m1"][1] * 0.85 * 0.6, abs=1e-6)


def test_access(spark, mem):
    rows = mem(memory(1, "x", vitality=0.5), memory(2, "y"))
    got = {r["id"]: r for r in fusion.record_access(rows, rows.filter("id = 'm1'"), "2024-02-01 00:00:00").collect()}
    assert (got["m1"]["access_count"], got["m1"]["stability"], round(got["m1"]["vitality"], 9)) == (1, 135.0, 0.6) and got["m2"]["access_count"] == 0
    assert got["m1"]["updated_at"] == datetime(2024, 1, 1, 1)


FEEDBACK = "memory_id string, useful int, value double, agent_id string, source string, created_at timestamp"


def test_surfacing_by_intent_and_feedback(spark, mem):
    rows = mem(memory(1, "prefers dark themes", "identity"), memory(2, "next milestone of the plan"))
    none = spark.createDataFrame([], FEEDBACK)
    first = lambda at, fb=none: surface.surface(rows, fb, at).orderBy("rank").first()
    assert first(surface.Context(intent="preference"))["id"] == "m1"
    two = mem(memory(1, "note one"), memory(2, "note two"))
    at = datetime(2024, 1, 1)
    fb = spark.createDataFrame([("m1", 0, 0.0, "a", "surface", at)] * 2 + [("m2", 1, 1.0, "a", "surface", at)] * 2, FEEDBACK)
    got = surface.surface(two, fb, surface.Context(query="note")).orderBy("rank").collect()
    assert [r["id"] for r in got] == ["m2", "m1"] and "feedback:reinforced" in got[0]["reason_codes"] and "feedback:negative" in got[1]["reason_codes"]
    assert "semantic:note" in got[0]["reason_codes"] and got[0]["reason_codes"][0] == "type:knowledge"


def test_temporal_filter(mem):
    rows = mem(memory(1, "alpha beta", updated_at=datetime(2026, 1, 15)), memory(2, "alpha beta gamma", updated_at=datetime(2026, 3, 15)))
    assert [r["id"] for r in lexical.search(rows, lexical.one_query(rows, "alpha"), after="2026-02-01").collect()] == ["m2"]


def test_limiter_against_a_loop(spark):
    rng = random.Random(0)
    attempts = [(k, datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(0, 6000))) for k in range(5) for _ in range(60)]
    got = {r["memory_id"]: r["accepted"] for r in feedback.limit_passive(spark.createDataFrame(attempts, "memory_id int, created_at timestamp")).collect()}
    for k in range(5):
        kept = []
        for _, t in sorted(a for a in attempts if a[0] == k):
            if sum(x > t - timedelta(hours=24) for x in kept) < 3:
                kept.append(t)
        assert got[k] == len(kept)
    four = spark.createDataFrame([(1, datetime(2024, 1, 1, h)) for h in range(4)], "memory_id int, created_at timestamp")
    assert feedback.limit_passive(four).first()["accepted"] == 3


@pytest.mark.parametrize(("content", "priority", "ok"), [
    ("short", 2, False), ("Name", 0, True), ("我喜欢蓝色和绿色还有红", 2, True), ("hello there, this is fine", 2, True), ("A" * 30 + " BBB", 2, False), ("a" * 40, 2, False), ("   ", 0, False),
    ("ALL CAPS BUT NOT TOO BAD INDEED", 2, True),
])
def test_gate(value, content, priority, ok):
    assert value(guard.gate(F.lit(content), F.lit(priority))["pass"]) is ok


@pytest.mark.parametrize(("a", "b", "score", "kind"), [
    ("it is not 8080", "it is 9090", 0.7, "value"), ("TODO: fix", "DONE: fix", 0.3, "status"), ("not DONE", "WIP", 0.7, "status"), ("same", "same", 0.0, "negation"), ("a不b", "ab", 0.4, "negation"), ("我不要", "我要", 0.0, "negation"), ("port 80 81", "port 81 82", 0.0, "negation"),
])
def test_conflicts(value, a, b, score, kind):
    told = guard.conflict(F.lit(a), F.lit(b))
    assert value(told["conflict_score"]) == pytest.approx(score) and value(told["conflict_type"]) == kind


@pytest.mark.parametrize(("kind", "old", "new", "want"), [
    ("identity", "old", " new ", "new"),
    ("emotion", "glad\n- calm", "calm", "glad\n\n- calm\n- calm"),
    ("emotion", "glad", "glad", "glad"),
    ("knowledge", "A is B. C", "C；D!", "A is B；C；D"),
    ("event", "went out", "came home", "Timeline:\n- went out\n- came home"),
    ("event", "went out", "went out ", "went out"),
])
def test_merging(value, kind, old, new, want):
    assert value(guard.merged(F.lit(kind), F.lit(old), F.lit(new))) == want


def incoming(spark, *rows):
    return spark.createDataFrame([(i, c, k, "a", u, None, datetime.fromisoformat(t)) for i, (c, k, u, t) in enumerate(rows)], "seq int, content string, type string, agent_id string, uri string, source string, created_at timestamp")


def test_guard_decisions(spark, mem):
    base = "the deployment pipeline uses blue green rollout with health checks"
    rows = mem(memory(1, base), memory(2, "an event about trains and stations", "event"))
    paths = spark.createDataFrame([("m1", "a", "core://x", datetime(2024, 1, 1))], "memory_id string, agent_id string, uri string, created_at timestamp")
    near = spark.createDataFrame([(2, "m1", 0.92), (3, "m1", 1.0)], "seq int, id string, similarity double")
    inc = incoming(spark, (base, "knowledge", None, "2024-01-01"), ("anything at all", "knowledge", "core://x", "2024-01-01"), ("the deployment pipeline uses blue green rollout with readiness checks", "knowledge", "core://y", "2024-01-01"), (base + " now", "knowledge", None, "2024-01-01"), ("tiny", "knowledge", None, "2024-01-01"), ("completely different words about cooking soup", "knowledge", None, "2024-01-01"))
    got = {r["seq"]: (r["action"], r["target_id"], r["step"]) for r in guard.decide(inc, rows, paths, near).collect()}
    assert got[0] == ("skip", "m1", "hash") and got[1] == ("update", "m1", "uri") and got[4] == ("skip", None, "gate") and got[5] == ("add", None, "candidates")
    assert got[2][0] == "merge" and got[3][0] in ("skip", "merge")
    careful = {r["seq"]: r["action"] for r in guard.decide(inc, rows, paths, near, conservative=True).collect()}
    assert careful[2] == careful[3] == "add"


def test_time_window_of_events(value):
    at = lambda s: F.lit(s).cast("timestamp")
    assert value(guard.time_proximity(F.lit("event"), at("2026-02-01"), at("2026-03-01"))) == 0
    assert value(guard.time_proximity(F.lit("knowledge"), at("2026-02-01"), at("2026-03-01"))) == 1
    assert value(guard.observed([F.lit(None).cast("string"), F.lit("met 2026-03-01T09:30Z")], at("2020-01-01"))) == datetime(2026, 3, 1, 9, 30)
    assert value(guard.observed([F.lit("no date")], at("2020-01-01"))) == datetime(2020, 1, 1)


@pytest.mark.parametrize(("content", "kind", "reason"), [("正在处理", "event", "in_progress"), ("a TODO later", "event", "pending"), ("刚才去了", "event", "ephemeral"), ("TODO: x", "knowledge", "pending"), ("x\nWIP: y", "knowledge", "pending"), ("has a TODO: inside", "knowledge", None), ("TODO: x", "identity", None), ("正在", "emotion", None), ("等他回复", "event", "pending")])
def test_stale(value, content, kind, reason):
    assert value(lifecycle.stale(F.lit(content), F.lit(kind))["reason"]) == reason


def test_quotas(spark, mem):
    def gone(rows, capacity):
        none = spark.createDataFrame([], "memory_id string, penalty double")
        return {r["id"]: r["quota"] for r in lifecycle.evicted(rows, lifecycle.eviction(rows, none, "2024-02-01 00:00:00"), capacity).collect()}

    rows = mem(*[memory(i, f"k{i} only") for i in range(6)], *[memory(10 + i, f"e{i} felt", "emotion") for i in range(2)])
    by_type = gone(rows, lifecycle.Capacity({"knowledge": 3}, 100))
    assert len(by_type) == 3 and all(i.startswith("m") and int(i[1:]) < 6 for i in by_type)
    rows = mem(*[memory(i, f"k{i} only") for i in range(3)], *[memory(10 + i, f"e{i} went", "event") for i in range(3)])
    assert len(gone(rows, lifecycle.Capacity({}, 4))) == 2
    rows = mem(*[memory(i, f"i{i} am", "identity") for i in range(5)])
    assert gone(rows, lifecycle.Capacity({"identity": 2}, 3)) == {}
    rows = mem(*[memory(i, f"k{i} only", vitality=v) for i, v in enumerate((0.8, 0.25, 0.15))])
    assert set(gone(rows, lifecycle.Capacity({}, 2))) == {"m2"}
    blank = mem(memory(1, "  "), memory(2, "word here"))
    assert [r["id"] for r in lifecycle.eviction(blank, spark.createDataFrame([], "memory_id string, penalty double"), "2024-02-01").collect()] == ["m2"]


def test_redundancy_against_all_pairs(spark, mem):
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["aa", "bb", "cc", "dd", "ee", "ff"], k=rng.randrange(1, 6))) for _ in range(40)] + ["zz", ""]
    kinds = ["knowledge", "event"]
    rows = mem(*[memory(i, t, kinds[i % 2]) for i, t in enumerate(texts)])
    got = {r["id"]: r["redundancy"] for r in lifecycle.redundancy(rows).collect()}
    sets = [set(t.split()) for t in texts]
    for i, s in enumerate(sets):
        others = [len(s & o) / max(len(s), len(o)) if s and o else 0 for j, o in enumerate(sets) if j != i and j % 2 == i % 2]
        assert got[f"m{i}"] == pytest.approx(max(others))


def test_archive_split(mem):
    rows = mem(*[memory(i, "x", vitality=v) for i, v in enumerate((1.0, 0.05, 0.3))])
    assert [r["fate"] for r in lifecycle.archive_split(rows, 0.5).orderBy("id").collect()] == ["archived", "deleted", "deleted"]


def test_reflection_resumes():
    ran, saved, broken = [], [], [True]

    def tidy(now):
        ran.append("tidy")
        if broken[0]:
            raise RuntimeError("boom")
        return {"n": 1}

    phases = {"decay": lambda now: ran.append("decay") or {"n": 0}, "tidy": tidy, "govern": lambda now: ran.append("govern") or {}}
    with pytest.raises(RuntimeError):
        lifecycle.reflect(phases, "2024-01-01", save=lambda s: saved.append({**s, "done": list(s["done"])}))
    assert saved[-1]["status"] == "failed" and saved[-1]["done"] == ["decay"] and saved[-1]["error"] == "boom"
    broken[0] = False
    state = lifecycle.reflect(phases, "2024-01-01", saved[-1])
    assert state["status"] == "completed" and ran == ["decay", "tidy", "tidy", "govern"]


def test_boot_and_layers(spark, mem):
    rows = mem(memory(1, "who I am", "identity"), memory(2, "core://b\nnot one\n core://c "), memory(3, "at b"), memory(4, "at c"), memory(5, "weak", vitality=0.1), memory(6, "felt", "emotion"))
    paths = spark.createDataFrame([("m2", "a", "system://boot"), ("m3", "a", "core://b"), ("m4", "a", "core://c"), ("m6", "a", "core://user"), ("m5", "other", "core://agent")], "memory_id string, agent_id string, uri string")
    assert {r["id"]: r["origin"] for r in listing.boot(rows, paths, "a").collect()} == {"m1": 0, "m6": 1, "m3": 2, "m4": 2}
    assert {r["id"] for r in listing.layers(rows).collect()} == {"m1", "m2", "m3", "m4", "m6"}
    assert [r["line"] for r in listing.narrative(listing.layers(rows), "2024-01-02").filter("type = 'identity'").collect()] == ["- who I am"]

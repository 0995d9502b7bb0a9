"""The best matches of many queries in cells; time in proportion to the text."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.functions import text
from recollect.operators import best, guard, lexical


@pytest.fixture(scope="module")
def tables(spark):
    pick = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["x_y", "Alice", "alice"]
    line = lambda: " ".join(pick.choice(words[: pick.randint(3, len(words))]) for _ in range(pick.randint(1, 12)))
    memories = [(f"m{i:04}", line(), f"a{min(i % 7, 3)}") for i in range(400)] + [(f"n{i:04}", "w1 w2 w3", "a0") for i in range(40)]
    queries = [(i, line(), f"a{min(i % 9, 4)}") for i in range(150)]
    return spark.createDataFrame(memories, "id string, content string, agent_id string"), spark.createDataFrame(queries, "query_id long, query string, agent_id string")


@pytest.mark.parametrize("within", [None, "agent_id"])
@pytest.mark.parametrize("small", [False, True])
def test_best_equals_all_matches_ranked(tables, monkeypatch, within, small):
    memories, queries = tables
    if small:  # groups are cut into blocks and chunks
        for name, n in {"BLOCK": 90, "CHUNK": 40, "LEAST": 20, "BUCKET": 30}.items():
            monkeypatch.setattr(best, name, n)
    queries = queries if within else queries.drop("agent_id")
    got = lexical.best(memories, queries, 5, within)
    want = lexical.ranked(lexical.bm25_scores(memories, queries, within), "score", 5)
    rows = lambda df: sorted((r.query_id, r["rank"], r.id, round(r.score, 7)) for r in df.collect())
    assert "Arrow" in got._jdf.queryExecution().toString() and rows(got) == rows(want)


def test_bounded_search_equals_sums():
    pick = np.random.default_rng(1)
    for _ in range(20):
        n, v = int(pick.integers(5, 3000)), int(pick.integers(3, 300))
        lists = [np.flatnonzero(pick.random(n) < pick.random() / (t + 1)) for t in range(v)]
        starts, doc = np.cumsum([0] + [len(x) for x in lists]), np.concatenate(lists)
        gain = np.concatenate([np.round(np.log(n / (len(x) + 1) + 1) * pick.integers(5, 15, len(x)) / 10, 3) for x in lists])
        whole = np.zeros((v, n))
        for t in range(v):
            whole[t, lists[t]] = gain[starts[t] : starts[t + 1]]
        index = best._Postings(starts, doc, gain, n)
        for _ in range(20):
            term, limit = np.sort(pick.choice(v, min(v, int(pick.integers(1, 31))), replace=False)), int(pick.integers(1, 21))
            times = pick.integers(1, 3, len(term))
            score = np.round(times @ whole[term], 9)
            met = np.flatnonzero(score)
            assert index.best(term, times, limit)[0].tolist() == met[np.lexsort((met, -score[met]))][:limit].tolist()


def test_a_long_word_takes_linear_time(spark):
    """Addresses and numbers were sought from every letter of a word: a text of 300,000 took minutes."""
    rows = spark.createDataFrame([("x" * 300_000,), ("a" + "1" * 300_000,)], "c string")
    start = time.monotonic()
    told = rows.select(F.size(text.entities(F.col("c"))).alias("e"), F.size(text.numbers(F.col("c"))).alias("n"), guard.gate(F.col("c"), F.lit(2))["pass"].alias("p")).collect()
    assert [tuple(r) for r in told] == [(0, 0, False), (1, 0, False)] and time.monotonic() - start < 30


def test_patterns_in_odd_places(spark):
    rows = spark.createDataFrame([("12a://x y3.14.1 a12 12 no_ no Hello-x://y \u00a0",), ("DONE 12://z can't knot\u3000",)], "c string")
    c = F.col("c")
    told = rows.select(text.entities(c).alias("e"), text.numbers(c).alias("n"), guard.signs(c).alias("s"), text.stripped(c).alias("t")).collect()
    assert told[0].e == ["12", "a://x", "3.14".split(".")[0], "14", "1", "Hello-x"] and told[1].e == ["DONE", "12"]
    assert told[0].n == ["3.14.1", "12"] and told[1].n == ["12"]
    assert (told[0].s.negated, told[0].s.done) == (True, False) and (told[1].s.negated, told[1].s.done) == (True, True)
    assert told[0].t.endswith("y") and told[1].t.endswith("knot")


@pytest.mark.parametrize("small", [False, True])
def test_nearest_set_equals_all_pairs(spark, monkeypatch, small):
    if small:
        for name, n in {"BLOCK": 50, "CHUNK": 40, "LEAST": 20, "BUCKET": 30}.items():
            monkeypatch.setattr(best, name, n)
    pick = random.Random(4)
    sets = [(i, f"g{i % 4 % 3}", sorted({int(pick.paretovariate(0.4)) for _ in range(pick.randint(1, 30))})) for i in range(300)]
    frame = spark.createDataFrame([(i, g, k, i % 5 > 0) for i, g, k in sets], "id long, g string, keys array<long>, asks boolean")
    found = best.nearest(frame, "g")
    got = {r.query_id: r.score for r in found.groupBy("query_id").agg(F.max("score").alias("score")).collect()}
    share = lambda a, b: len(set(a) & set(b)) / max(len(a), len(b))
    assert got == {i: max(share(k, l) for j, h, l in sets if h == g and j != i) for i, g, k in sets if i % 5 > 0}

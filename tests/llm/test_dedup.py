import collections
import re

import numpy as np
import pyarrow as pa
import pytest

from recollect.llm import forest, minhash, substring
from recollect.llm.components import components, joined
from recollect.llm.substring import Repeats


def words(seed, n):
    rng = np.random.default_rng(seed)
    return ["".join(chr(97 + x) for x in rng.integers(0, 26, 6)) for _ in range(n)]


def shingles(text):
    w = re.findall(r"[^\W_]+", text.lower())
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} or ({tuple(w)} if w else set())


def grouped(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (330, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (7, None)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    real = [(a, b) for a, b in edges if b is not None and a != b]
    want = grouped(real, {x for e in real for x in e})
    assert got == want
    degree = collections.Counter(x for e in {(min(e), max(e)) for e in real} for x in e)
    assert {r["node"]: r["n_links"] for r in joined(spark.createDataFrame(edges, "u long, v long"))[1].collect()} == degree
    assert all(x.count() == 0 for x in joined(spark.createDataFrame([], "u long, v long")))


def near(text, n, seed):
    w = text.split()
    for i in np.random.default_rng(seed).choice(len(w), n, replace=False):
        w[i] = f"changed{seed}x{i}"
    return " ".join(w)


def test_minhash_against_brute_force(table):
    rows, n = [], 0
    for k in range(40):
        base = " ".join(words(k, 40 + 5 * k))
        for j in range(k % 5 + 1):
            rows.append((n, base if j == 0 else near(base, (3 * j * len(base.split())) // 100, 100 * k + j)))
            n += 1
    rows += [(n + i, rows[20][1]) for i in range(30)]  # exact copies
    out = minhash.near_duplicates(table(rows)).collect()
    got = {r["doc_id"]: r["group_id"] for r in out}
    sets = {i: shingles(t) for i, t in rows}
    texts = collections.defaultdict(set)
    for r in out:
        texts[r["group_id"]].add(frozenset(sets[r["doc_id"]]))
    assert all((r["n_links"] > 0) == (len(texts[r["group_id"]]) > 1) and r["n_links"] < len(texts[r["group_id"]]) for r in out)
    sure = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6]
    assert np.mean([got[a] == got[b] for a, b in sure]) == 1.0
    likely = grouped([(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.3], sets)
    assert all(likely[a] == likely[b] for a in sets for b in sets if got[a] == got[b])


def test_estimate_corrects_for_chance():
    rng = np.random.default_rng(0)
    config = minhash.MinHash()
    a, b = rng.integers(0, (1 << 64) - 1, (2, 4000, 8), dtype=np.uint64, endpoint=True)
    equal = minhash.matches(a, b, config.hashes)
    assert abs(equal.mean() / 128 - 1 / 16) < 0.002 and (equal < config.least_matches).all()
    assert (minhash.matches(a, a, config.hashes) == 128).all()


def test_bucket_links_are_single_linkage():
    config = minhash.MinHash()
    rng = np.random.default_rng(1)
    base = rng.integers(0, 16, (6, 128))
    rows = np.concatenate([np.where(rng.random((7, 128)) < 0.35, rng.integers(0, 16, (7, 128)), b) for b in base])
    sig = np.bitwise_or.reduce(rows.reshape(-1, 8, 16).astype(np.uint64) << (np.uint64(4) * np.arange(16, dtype=np.uint64)), axis=2)
    same = [(i, j) for i in range(len(rows)) for j in range(i) if (rows[i] == rows[j]).sum() >= config.least_matches]
    assert grouped(minhash.link(sig, config), range(len(rows))) == grouped(same, range(len(rows)))


def test_minhash_table(table, rows_of):
    text = " ".join(words(1, 50))
    rows = [(3, text), (1, text), (2, None), (4, ""), (5, " .!"), (None, text), (1, text), (1, "other one"), (6, "two words"), (7, "Two, words!"), (8, "one"), (9, " ".join(words(9, 100_000)))]
    got = minhash.near_duplicates(table(rows)).collect()
    by = {(r["doc_id"], r["text_hash"]): r for r in got}
    assert len(by) == len(got) == 11
    groups = collections.defaultdict(list)
    for r in got:
        groups[r["doc_id"]].append(r)
    assert sorted((r["n_rows"], r["group_size"], r["keep"]) for r in groups[1]) == [(1, 1, True), (2, 3, True)]
    assert groups[3][0]["group_id"] == 1 and not groups[3][0]["keep"] and groups[None][0]["group_id"] == 1 and not groups[None][0]["keep"]
    assert groups[7][0]["group_id"] == 6
    assert all(groups[i][0]["keep"] for i in (2, 4, 5, 6, 8, 9))
    kept = minhash.keep_one(table(rows))
    assert kept.columns == table(rows).columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=lambda x: (x is None, x))
    assert ids == [1, 1, 2, 4, 5, 6, 8, 9] and {r["t"] for r in kept.collect() if r["doc_id"] == 6} == {"t-6"}
    assert minhash.near_duplicates(table([])).count() == 0 == minhash.keep_one(table([])).count()


def test_rows_of_columns_that_have_no_order(spark):
    text = " ".join(words(1, 50))
    rows = [(1, text, {"a": 1}, [{"k": 2}]), (1, text, {"a": 0}, None), (2, text, {}, []), (3, None, None, None), (3, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `m p` map<string,int>, l array<map<string,int>>")
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted((r["doc_id"], str(r["m p"])) for r in kept.collect()) == [(1, "{'a': 0}"), (3, "None")]


def test_buckets_that_go_on_over_batches():
    config = minhash.MinHash()
    rng = np.random.default_rng(2)
    sig = rng.integers(0, 1 << 63, (60, 8), dtype=np.int64).view(np.uint64)
    sig[5:30:2] = sig[5]
    key = np.repeat([1, 2, 3], [4, 40, 16])
    table = pa.table({"key": key, "d": np.arange(60), "t": np.arange(60), "sig": pa.array([s.tobytes() for s in sig], pa.binary())})
    told = [sorted(x for b in minhash.bucket_edges(config)(iter(table.to_batches(n))) for x in zip(b["ud"].to_pylist(), b["vd"].to_pylist(), strict=True)) for n in (60, 7, 1)]
    assert told[0] == told[1] == told[2] and len(told[0]) == 12


def test_short_texts_that_differ_stay_apart(table):
    w = words(77, 1200)
    texts = w[:200] + [" ".join(w[200 + 2 * i : 202 + 2 * i]) for i in range(200)] + [" ".join(w[600 + 3 * i : 603 + 3 * i]) for i in range(200)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, t.upper() + "!") for i, t in enumerate(texts[::50])]
    got = {r["doc_id"]: r for r in minhash.near_duplicates(table(rows)).collect()}
    assert all(got[i]["keep"] and got[i]["group_size"] == 1 + (i % 50 == 0) for i in range(600))
    assert all(got[1000 + i]["group_id"] == 50 * i for i in range(12))
    assert minhash.keep_one(table(rows)).count() == 600


def brute_repeats(rows, least):
    docs = sorted({(i is None, i or 0, t or "") for i, t in rows})
    first, spans = {}, []
    for none, i, text in docs:
        w, run = text.split(), None
        for p in range(len(w) - least + 1):
            at = first.setdefault(tuple(w[p : p + least]), (none, i, text, p))
            if at == (none, i, text, p):
                run = None
                continue
            if run and run["ref"] == at[:3]:
                run["n"] += 1
                run["at"] = min(run["at"], at[3])
            else:
                run = {"doc": None if none else i, "p": p, "n": least, "ref": at[:3], "at": at[3]}
                spans.append(run)
    return sorted((s["doc"], s["p"], s["n"], None if s["ref"][0] else s["ref"][1], s["at"]) for s in spans)


@pytest.mark.parametrize(("least", "hot"), [(4, 1000), (7, 1), (7, 1000), (50, 1), (50, 1000)])
def test_repeats_against_brute_force(table, least, hot):
    rng = np.random.default_rng(least)
    passages = [words(900 + i, least + i) for i in range(8)]
    rows = []
    for i in range(40):
        parts = []
        for _ in range(4):
            parts += words(int(rng.integers(1, 1 << 30)), int(rng.integers(1, 40)))
            if rng.random() < 0.5:
                p = passages[int(rng.integers(0, 8))]
                parts += p[int(rng.integers(0, 3)) :]
        rows.append((i, " ".join(parts)))
    rows += [(50, " ".join(["und"] * (least * 3))), (51, "x " + " ".join(["und"] * (least * 2))), (52, rows[3][1]), (53, "\n".join(rows[3][1].split()))]
    rows += [(60, rows[7][1]), (60, rows[7][1]), (7, rows[7][1])]
    got = sorted(tuple(r)[:5] for r in substring.repeats(table(rows).repartition(6), Repeats(min_words=least, hot=hot)).collect())
    assert got == brute_repeats(list(dict.fromkeys(rows)), least)


def test_least_within():
    x = np.random.default_rng(0).integers(0, 1 << 62, 100).view(np.uint64)
    for width in (1, 2, 3, 8, 26, 100, 130):
        assert substring.least_within(x, width).tolist() == [int(x[i : i + width].min()) for i in range(100)]


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_pieces_do_not_hang_on_batches(size):
    rng = np.random.default_rng(1)
    rows = sorted((int(rng.integers(0, 6)), int(rng.integers(0, 9)), 0, int(rng.integers(0, 40)), rng.integers(0, 12, rng.integers(1, 9)).tobytes()) for _ in range(300))
    rows = [x for i, x in enumerate(rows) if i == 0 or x[:4] != rows[i - 1][:4]]
    rows += [rows[-1]]
    first, want = {}, set()
    for key, d, t, p, runs in rows[:-1]:
        for i, h in enumerate(np.frombuffer(runs, np.int64).tolist()):
            at = first.setdefault((key, h), (d, t, p + i))
            if at != (d, t, p + i):
                want.add((d, t, p + i, *at))
    table = pa.table({"hot": [False] * len(rows), **{c: [r[i] for r in rows] for i, c in enumerate(("key", "d", "t"))}, "p": pa.array([r[3] for r in rows], pa.int32()), "runs": pa.array([r[4] for r in rows], pa.binary())})
    got = {(d, t, p + i, rd, rt, rp + i) for b in substring.matched(iter(table.to_batches(size))) for d, t, p, n, rd, rt, rp in zip(*(b[c].to_pylist() for c in ("d", "t", "p", "n", "rd", "rt", "rp")), strict=True) for i in range(n)}
    assert {x for x in got if x[:3] != x[3:]} == want


def test_steps_round_trip():
    at = np.array([0, 1, 70_000, 70_001, 400_000, 465_535, 531_070])
    assert (substring.unpack_steps(substring.pack_steps(at)) == at).all()
    assert len(substring.unpack_steps(substring.pack_steps(at[:0]))) == 0


def test_cut(table):
    p = words(5, 60)
    one, two = " ".join(words(6, 20) + p), "  ".join(words(7, 10)) + "\n" + " ".join(p) + "\n\n" + " ".join(words(8, 5))
    rows = [(1, one), (2, two), (3, None), (4, ""), (5, " ".join(p)), (None, one), (1, one), (6, " ".join(words(11, 200_000)))]
    out = substring.without_repeats(table(rows))
    assert out.columns == table(rows).columns
    got = collections.defaultdict(list)
    for r in out.collect():
        got[r["doc_id"]].append(r)
    assert [r["text"] for r in got[1]] == [one, one] and got[2][0]["text"] == "  ".join(words(7, 10)) + "\n\n" + " ".join(words(8, 5))
    assert got[3][0]["text"] is None and got[4][0]["text"] == "" and got[5][0]["text"] == "" and got[None][0]["text"] == "" and got[6][0]["text"] == rows[-1][1]
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for rs in got.values() for r in rs) and got[2][0]["hits"] == "hits-2"
    other = substring.without_repeats(table(rows), Repeats(broadcast_spans=0))  # texts joined to spans
    assert sorted(map(str, other.collect())) == sorted(map(str, out.collect()))
    assert substring.repeats(table([])).count() == 0 == substring.without_repeats(table([])).count()


@pytest.fixture(scope="module")
def clouds():
    rng = np.random.default_rng(0)
    x = []
    for k in range(600):
        c = rng.standard_normal(32)
        x += [c + 0.03 * (j > 0) * np.linalg.norm(c) / np.sqrt(32) * rng.standard_normal(32) for j in range(1 + (k % 4) * (k % 3))]
    x = np.array(x) * rng.uniform(0.5, 2, (len(x), 1))
    return x[rng.permutation(len(x))]


@pytest.mark.parametrize("config", [forest.Forest(), forest.Forest(leaf=32, cell=500)])
def test_forest_against_brute_force(spark, clouds, config):
    df = spark.createDataFrame([(i, [float(v) for v in row], "x") for i, row in enumerate(clouds)], "vec_id long, embedding array<double>, v string")
    got = {r["vec_id"]: r["group_id"] for r in forest.near_duplicates(df, config).collect()}
    unit = clouds / np.linalg.norm(clouds, axis=1, keepdims=True)
    pairs = np.argwhere(np.triu(unit @ unit.T >= config.threshold, 1))
    assert len(got) == len(clouds) and len(pairs) > 500
    assert np.mean([got[a] == got[b] for a, b in pairs]) >= 0.97
    whole = grouped([tuple(p) for p in pairs.tolist()], range(len(clouds)))
    assert all(whole[a] == whole[g] for a, g in got.items())  # nothing is joined that shouldn't be


def test_forest_table(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.01]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (None, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (8, [1.0, 0.0, 0.0]), (9, [1.0, None])]
    df = spark.createDataFrame([(*r, "q") for r in rows], "vec_id long, embedding array<double>, h string")
    got = sorted((tuple(r) for r in forest.near_duplicates(df).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    assert got == [(1, 1, 1, 0, True), (1, 1, 3, 1, True), (2, 1, 3, 1, False), *[(i, i, 1, 0, True) for i in (3, 4, 5, 6, 7, 8, 9)], (None, 1, 3, 1, False)]
    many = spark.range(700).selectExpr("id as vec_id", "array(1.0d, 2.0d) as embedding")
    assert {(r["group_id"], r["group_size"]) for r in forest.near_duplicates(many, forest.Forest(cell=50, leaf=8)).collect()} == {(0, 700)}
    assert forest.near_duplicates(df.limit(0)).count() == 0


def test_forest_of_short_floats_in_cells(spark, clouds):
    """More vectors of 32-bit floats than one task takes, and trees that take turns."""
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(clouds)], "vec_id long, embedding array<float>")
    config = forest.Forest(leaf=32, cell=500, sample=1000)
    got = {r["vec_id"]: r["group_id"] for r in forest.near_duplicates(df, config).collect()}
    turns = {r["vec_id"]: r["group_id"] for r in forest.near_duplicates(df, forest.Forest(leaf=32, cell=500, sample=1000, round_bytes=2_000_000)).collect()}
    unit = clouds.astype(np.float32).astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    pairs = np.argwhere(np.triu(unit @ unit.T >= config.threshold, 1))
    assert len(got) == len(clouds) and np.mean([got[a] == got[b] for a, b in pairs]) >= 0.97
    whole = grouped([tuple(p) for p in pairs.tolist()], range(len(clouds)))
    assert all(whole[a] == whole[g] for a, g in got.items())
    assert got == turns


def test_forest_crowd_of_one_direction(spark):
    """Vectors that no direction tells apart fill many cells and are one group still; others stay apart."""
    rng = np.random.default_rng(3)
    x = np.concatenate([np.outer(rng.uniform(0.5, 2, 1500), rng.standard_normal(16)), rng.standard_normal((500, 16))])
    config, h = forest.Forest(leaf=16, cell=200), rng.integers(-(1 << 62), 1 << 62, 2000)
    top = forest.Top(forest.unit(x), h, forest.depth_of(2000, 16, config), 0, config)
    cell, at = top.cells(forest.unit(x), h)
    assert len(np.unique(at)) == 2000 and np.unique(cell, return_counts=True)[1].max() <= 200
    df = spark.createDataFrame([(i, row) for i, row in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["group_id"], r["group_size"]) for r in forest.near_duplicates(df, config).collect()}
    assert {got[i] for i in range(1500)} == {(0, 1500)} and all(got[i] == (i, 1) for i in range(1500, 2000))


def test_forest_links_are_pairs_that_match(spark):
    df = spark.createDataFrame([(i, [float(np.cos(a)), float(np.sin(a))]) for i, a in enumerate((0.0, 0.3, 0.6, 0.9))], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["group_id"], r["n_links"]) for r in forest.near_duplicates(df).collect()}  # a chain; cos 0.6 is 0.83
    assert got == {0: (0, 1), 1: (0, 2), 2: (0, 2), 3: (0, 1)}


def test_forest_vectors_of_one_hash(spark):
    """Different vectors with the same 64-bit hash keep their own groups."""
    m = (1 << 64) - 1
    p1, p2, p5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x27D4EB2F165667C5
    turn = lambda x, r: ((x << r) | (x >> (64 - r))) & m
    bits = lambda x: int(np.float64(x).view(np.uint64))
    start = [r[0] & m for r in spark.range(1, 40).selectExpr("xxhash64(array(cast(id as double)))").collect()]
    k = turn(bits(1.5) * p2 & m, 31) * p1 & m
    for i, s in enumerate(start[1:], 2):  # second numbers that make up for another first one
        want = (k ^ ((start[0] + p5 + 8) & m) ^ ((s + p5 + 8) & m)) * pow(p1, -1, 1 << 64) & m
        other = float(np.uint64(turn(want, 33) * pow(p2, -1, 1 << 64) & m).view(np.float64))
        if 1e-90 < abs(other) < 1e90:
            break
    df = spark.createDataFrame([(1, [1.0, 1.5]), (2, [float(i), other]), (3, [1.0, 1.5])], "vec_id long, embedding array<double>")
    assert len({r[0] for r in df.selectExpr("xxhash64(embedding)").collect()}) == 1
    same = abs(np.dot([1.0, 1.5], [i, other])) / np.hypot(1, 1.5) / np.hypot(i, other) >= 0.95
    assert not same
    assert sorted(map(tuple, forest.near_duplicates(df).collect())) == [(1, 1, 2, 0, True), (2, 2, 1, 0, True), (3, 1, 2, 0, False)]

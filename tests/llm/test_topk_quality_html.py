import time

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from recollect.llm import html, quality, topk
from recollect.llm.textkit import slices
from recollect.llm.topk import TopK


def brute(x, ids, k):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = []
    for a in range(len(x)):
        s = np.round(unit @ unit[a], 6)
        best = sorted((-s[b], ids[b]) for b in range(len(x)) if ids[b] != ids[a])[:k]
        out += [(ids[a], r + 1, i, -v) for r, (v, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize(("seed", "block"), [(0, 32_768), (1, 100)])
def test_topk_against_brute_force(spark, seed, block):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.standard_normal((300, 8)), np.repeat(rng.standard_normal((5, 8)), 12, 0)])  # with many ties
    df = spark.createDataFrame([(i, [float(v) for v in row], 0) for i, row in enumerate(x)], "vec_id long, embedding array<double>, q int")
    got = sorted(map(tuple, topk.nearest(df, TopK(k=7, every=1, block=block, batch=32)).collect()))
    want = brute(x, list(range(len(x))), 7)
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-9)


def test_the_bound_stops_the_search():
    """Vectors with few entries other than 0: a query's lists tell early that nothing better is left."""
    rng = np.random.default_rng(2)
    n, k = 20_000, 5
    x = np.zeros((n, 40))
    for _ in range(3):
        x[np.arange(n), rng.integers(0, 40, n)] = rng.exponential(1, n) + 0.01
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.arange(n)
    q, m, _, seen = topk.threshold_search(x, ids, x[:64], ids[:64], TopK(k=k))
    assert seen < 0.25 * 64 * n
    want = [(a, b) for a in range(64) for b in [i for _, i in sorted((-v, i) for i, v in enumerate(np.round(x @ x[a], 6)) if i != a)[:k]]]
    assert sorted(zip(q.tolist(), m.tolist(), strict=True)) == sorted(want)


def test_queries_without_a_useful_bound_are_scored_at_once():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((800, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = rng.permutation(800)
    q, m, s, seen = topk.threshold_search(x, ids, x[::50], ids[::50], TopK())
    assert seen == 16 * 800
    want = [w for w in brute(x, ids.tolist(), 10) if w[0] in set(ids[::50].tolist())]
    assert sorted(zip(ids[::50][q].tolist(), ids[m].tolist(), strict=True)) == sorted((w[0], w[2]) for w in want)


def test_queries_are_the_ids_that_twenty_divides(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((90, 5)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>")
    got = sorted(map(tuple, topk.nearest(df).collect()))
    want = [w for w in brute(x.astype(np.float64), list(range(90)), 10) if w[0] % 20 == 0]
    assert [g[:3] for g in got] == [w[:3] for w in want]


def test_topk_table(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (None, [0.0, 2.0]), (1, [1.0, 0.0]), (1, [0.5, 0.5]), (8, [1.0, 0.0, 0.0]), (9, [None, 1.0])]
    df = spark.createDataFrame([(*r, "q") for r in rows], "vec_id long, embedding array<double>, n string")
    got = sorted((tuple(r)[:3] for r in topk.nearest(df, TopK(every=1)).collect()), key=str)
    assert got == sorted([(1, 1, 2), (1, 2, None), (2, 1, 1), (2, 2, None), (None, 1, 1), (None, 2, 2)], key=str)
    assert topk.nearest(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [32_768, 60])
def test_topk_counts_an_id_once(spark, block):
    """Many rows of one id near a query leave places for the other ids."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((200, 6))
    x[:60] = x[100] + 0.01 * rng.standard_normal((60, 6))
    ids = [None] * 30 + [500] * 30 + [i // 2 for i in range(140)]
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got = {}
    for r in topk.nearest(df, TopK(k=7, every=1, block=block, batch=32)).collect():
        got.setdefault(r["vec_id"], []).append((r["rank"], r["neighbor_id"], r["score"]))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    score = np.round(unit @ unit.T, 6)
    for own in set(ids):
        best = {}
        for a in (i for i, v in enumerate(ids) if v == own):
            for b, other in enumerate(ids):
                if other != own:
                    best[other] = max(best.get(other, -2), score[a, b])
        want = sorted(best.items(), key=lambda p: (-p[1], p[0] is None, p[0] or 0))[:7]
        assert [g[1] for g in sorted(got[own])] == [w[0] for w in want]
        assert np.allclose([g[2] for g in sorted(got[own])], [w[1] for w in want], atol=1e-9)


@pytest.fixture(scope="module")
def labelled():
    d = "/root/testdata/sf0.1"
    return duckdb.sql(f"select d.text, l.quality, l.toxic from '{d}/documents.parquet' d join '{d}/labels.parquet' l using (doc_id) order by hash(doc_id), doc_id limit 3900").fetchall()


def test_held_out_accuracy(labelled):
    config = quality.Quality(epochs=10)
    rows = []
    for _, buf, offsets in slices(pa.RecordBatch.from_pydict({"text": [r[0] for r in labelled]}), "text"):
        f, first = quality.features(buf, offsets, config.bits)
        rows += [f[first[i] : first[i + 1]] for i in range(len(offsets) - 1)]
    y = np.array([r[1:] for r in labelled])
    n = 3000
    for k, (good, bad) in enumerate(((0.99, 0.96), (0.85, 0.98))):
        (w, square), bias = quality.fit_calibrated(rows[:n], y[:n, k], config)
        s = np.array([w[r].sum() / max(np.sqrt(square[r].sum()), 1e-12) + bias for r in rows[n:]])
        assert (s[y[n:, k] == 1] >= 0).mean() >= good and (s[y[n:, k] == 0] < 0).mean() >= bad


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    rows = [np.flatnonzero(rng.random(30) < 0.3) for _ in range(80)]
    y = np.array([int((r < 10).sum() > (r >= 20).sum()) for r in rows])
    cost = np.where(y == 1, 80 / (2 * y.sum()), 80 / (2 * (80 - y.sum())))

    def objective(epochs):
        (w, square), bias = quality.fit(rows, y, quality.Quality(bits=5, epochs=epochs))
        score = np.array([w[r].sum() / max(np.sqrt(square[r].sum()), 1e-12) + bias for r in rows])
        loss = np.maximum(0, 1 - np.where(y == 1, 1, -1) * score)
        return 0.5 * (w[square > 0] ** 2 / square[square > 0]).sum() + 0.5 * bias**2 + (cost * loss).sum(), ((score >= 0) == (y == 1)).mean()

    best, _ = objective(3000)
    value, accuracy = objective(300)
    assert best < 0.5 * cost.sum() and value <= best * 1.001 and accuracy >= 0.9


def test_quality_table(spark, table, rows_of):
    good, bad = "The quick words of a plain text, as any. And more of it.", "JUNK!! JUNK%%% $$$ JUNK!! ### JUNK%%%"
    rows = [(i, f"{good} {i}") for i in range(30)] + [(100 + i, f"{bad} {i}") for i in range(15)]
    labels = spark.createDataFrame([(i, 1, 0, "k") for i in range(20)] + [(100 + i, 0, 0, "k") for i in range(10)] + [(3, None, 0, "k"), (None, 1, 0, "k")], "doc_id long, quality int, toxic int, text string")
    odd = [(200, None), (201, ""), (202, " \n"), (None, good), (0, f"{good} 0"), (203, good + " word" * 100_000)]
    got = quality.classify(table(rows + odd), labels).collect()
    assert len(got) == len(rows + odd)
    keep = {}
    for r in got:
        keep.setdefault(r["doc_id"], []).append(r["keep"])
        assert r["toxic_score"] is None  # one class only
    assert all(keep[i][0] for i in range(30)) and not any(keep[100 + i][0] for i in range(15)) and len(keep[0]) == 2
    assert keep[200] == keep[201] == keep[202] == [False] and keep[None] == [True]
    kept = quality.accepted(table(rows + odd), labels)
    assert kept.columns == table(rows).columns and {r["features"] for r in kept.filter("doc_id = 5").collect()} == {"features-5"}
    none = quality.classify(table(rows), labels.limit(0)).collect()
    assert all(r["keep"] and r["quality_score"] is None for r in none)
    assert quality.classify(table([]), labels).count() == 0


@pytest.fixture(scope="module")
def pages():
    return [r[0] for r in duckdb.sql("select html from '/root/testdata/sf0.1/pages.parquet' order by page_id limit 700").fetchall()]


def test_html_held_out_accuracy(pages):
    """Also where the tags that told the labels are hidden."""
    config = html.Labeller(epochs=8)
    known = [(b, y) for b in map(html.blocks, pages) if (y := html.told(b)) is not None]
    hidden = np.random.default_rng(0).random(300) < config.hide
    w = html.fit([html.vectors([b], config, [h]) for (b, _), h in zip(known[:300], hidden, strict=True)], [y for _, y in known[:300]], config)
    for tag in (lambda t: t, lambda t: "div" if t in html.MAIN | html.ASIDE else t):
        test = [[(html.chain(tag(t) for t in p or ()), x, s) for p, x, s in b] for b, _ in known[300:]]
        p = np.concatenate(html.scores(test, w, config)) >= 0.5
        assert (p == np.concatenate([y for _, y in known[300:]])).mean() > 0.97


def test_gradients():
    config = html.Labeller(hidden=3, path_size=4, word_size=3)
    rng = np.random.default_rng(0)
    w = html.Weights.fresh(config)
    for name in ("fw", "bw", "ow", "fb", "bb", "ob"):
        setattr(w, name, getattr(w, name).astype(np.float64))
    x, mask = html.padded([rng.standard_normal((n, config.size)) for n in (5, 3)])
    x, y = x.astype(np.float64), rng.integers(0, 2, mask.shape)

    def loss():
        p = html.forward(x, mask, w)[0]
        return -(mask * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()

    p, both, ft, bt = html.forward(x, mask, w, True)
    d = (p - y) * mask
    dboth = d[:, :, None] * w.ow
    got = {"fw": html._lstm_back(x, dboth[:, :, :3], ft, w.fw)[0], "bw": html._lstm_back(x[::-1], dboth[::-1, :, 3:], bt, w.bw)[0]}
    for name, grad in got.items():
        for i, j in ((0, 0), (5, 4), (config.size, 7), (config.size + 2, 11)):
            own = getattr(w, name)
            keep, eps = own[i, j], 1e-3
            own[i, j] = keep + eps
            up = loss()
            own[i, j] = keep - eps
            down = loss()
            own[i, j] = keep
            assert abs((up - down) / (2 * eps) - grad[i, j]) < 2e-2 * max(1, abs(grad[i, j]))


@pytest.mark.parametrize(("source", "want"), [
    ("<p>a <b>b</b><br>c<p>d", [(("p",), "a b c"), (("p",), "d")]),
    ("x &amp; y<script>no</script><!-- no --><style>no</style>", [((), "x & y")]),
    ("<div class='ad big'><span>buy</span></div>after", [(("div", ".ad", ".big"), "buy"), ((), "after")]),
    ("<ul><li>1<li>2</ul></nav>3", [(("ul", "li"), "1"), (("ul", "li"), "2"), ((), "3")]),
    ("<p>open <", [(("p",), "open")]),
    ("", []),
])
def test_blocks(source, want):
    assert [(tuple(p or ()), t) for p, t, _ in html.blocks(source)] == want


@pytest.mark.parametrize(("source", "want"), [
    ("<head><title>a</title><body><article>b</article>", ["b"]),
    ("<html><head><meta charset=x><title>a <i> b</title><link rel=y><p>b<p>c", ["b", "c"]),
    ("<head><title>a</title>\n<style>s</style></head><p>b", ["b"]),
    ("<head/><p>b", ["b"]),
    ("<head><title>a</title> b", ["b"]),
    ("<header>a</header><p>b", ["a", "b"]),
    ("<p>a</p><svg/><p>rest", ["a", "rest"]),
    ("<p>a</p><svg viewBox='0 > 1'/><p>b</p><svg><text>no</text></svg><p>c", ["a", "b", "c"]),
    ("<p>a</p><svg><svg>no</svg>no</svg><template>no<svg></template><p>b", ["a", "b"]),
    ("<p>a</p><template><p>b</p><noscript><p>c", ["a", "b", "c"]),
    ("<p>a</p><svg><p>b</p><svg>no</svg><p>c", ["a", "b", "c"]),
    ("<p>a</p><script src='x'/><p>b</p><script>no", ["a", "b"]),
    ("<p>a<!-- no", ["a"]),
])
def test_what_has_no_end_tag_does_not_take_the_page(source, want):
    assert [b[1] for b in html.blocks(source)] == want


@pytest.mark.parametrize("unit", ["<a ", "<div>", "<div>x", "<div class='a b'>x", "</p>x<i>", "<!", "<?", "<svg ", "<script ", "<a \"> \"", "<script \"> \"</script>", "<head>", "<title>", "<svg>x", "<p>x</div>", "<", "&amp;", "<li>x", "<a '><b \">"])
def test_time_is_in_proportion_to_the_page(unit):
    page = unit * (1_000_000 // len(unit))
    began = time.process_time()
    html.vectors([html.blocks(page)], html.Labeller())
    assert time.process_time() - began < 20


def test_a_path_tells_of_all_its_tags():
    config = html.Labeller()
    deep = ["div"] * 9
    rows = html.vectors([[(html.chain(t), "x", 0.0) for t in (["article", *deep], ["nav", *deep], deep)]], config)
    assert not np.array_equal(rows[0], rows[1]) and not np.array_equal(rows[0][: config.path_size], rows[2][: config.path_size])
    hidden = html.vectors([[(html.chain(t), "x", 0.0) for t in (["article", *deep], ["nav", *deep], deep)]], config, [True])
    assert np.array_equal(hidden[0][: config.path_size], hidden[1][: config.path_size])
    same = html.vectors([[(html.chain(["div", ".ad", ".big", ".x"]), "x", 0.0)]], config)[0]
    assert np.allclose(same, html.vectors([html.blocks("<div class='ad big x'>x")], config)[0])


def test_lstm_equals_loops():
    """The network written out, a page, a block and a unit at a time."""
    config = html.Labeller(hidden=3, path_size=4, word_size=3)
    rng = np.random.default_rng(1)
    w = html.Weights.fresh(config)
    pages = [rng.standard_normal((n, config.size)).astype(np.float32) for n in (5, 1, 9)]
    sig = lambda z: 1 / (1 + np.exp(-z))

    def states(x, m, b):
        h, c, out = [0.0] * 3, [0.0] * 3, []
        for row in x:
            z = [float(b[k]) + sum(float(row[i]) * float(m[i, k]) for i in range(config.size)) + sum(h[j] * float(m[config.size + j, k]) for j in range(3)) for k in range(12)]
            c = [sig(z[3 + u]) * c[u] + sig(z[u]) * np.tanh(z[9 + u]) for u in range(3)]
            h = [sig(z[6 + u]) * np.tanh(c[u]) for u in range(3)]
            out.append(h)
        return out

    x, mask = html.padded(pages)
    got = html.forward(x, mask, w)[0]
    for k, page in enumerate(pages):
        fore, back = states(page, w.fw, w.fb), states(page[::-1], w.bw, w.bb)[::-1]
        for t in range(len(page)):
            want = sig(float(w.ob[0]) + sum(float(w.ow[u]) * fore[t][u] + float(w.ow[3 + u]) * back[t][u] for u in range(3)))
            assert abs(got[t, k] - want) < 1e-5


def test_hinge_loss_equals_a_plain_solver():
    """The same objective by subgradient steps on the features written out as a matrix, and the same decisions."""
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.choice(20, 6)) for _ in range(60)]
    y = np.array([int((r < 8).sum() > (r >= 12).sum()) for r in rows])
    sign, n, size = np.where(y == 1, 1.0, -1.0), 60, 32
    count = np.ones((2, size))
    for r, k in zip(rows, y, strict=True):
        for f in r:
            count[k, f] += 1
    ratio = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
    x = np.zeros((n, size + 1))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / np.sqrt((ratio[r] ** 2).sum())
        x[i, size] = 1
    cost = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    w, mean = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, 40_001):
        w -= (w - ((cost * sign * (sign * (x @ w) < 1)) @ x)) * (2 / (t + 1))  # the mean weighs late steps more
        mean += (w - mean) * (2 / (t + 1))
    loss = lambda v: 0.5 * v @ v + (cost * np.maximum(0, 1 - sign * (x @ v))).sum()
    (told, square), bias = quality.fit(rows, y, quality.Quality(bits=5, epochs=3000))
    assert np.allclose(square, ratio * ratio)
    own = np.append(np.divide(told, ratio, out=np.zeros(size), where=ratio != 0), bias)
    assert abs(loss(own) - loss(mean)) <= 0.01 * loss(mean)
    assert (np.sign(x @ own) == np.sign(x @ mean))[np.abs(x @ mean) > 0.05].all()


def test_html_table(spark, pages):
    rows = [(i, p) for i, p in enumerate(pages[:40])] + [(100, None), (101, ""), (None, pages[0]), (0, pages[0]), (102, "plain"), (103, "<p>" + "long text. " * 100_000), (104, "<div>x" * 3000), (105, "<a " * 9000)]
    df = spark.createDataFrame([(i, "u", h, "z") for i, h in rows], "page_id long, url string, html string, text string")
    got = {}
    for r in html.extract(df, html.Labeller(epochs=4)).collect():
        got.setdefault(r["page_id"], []).append(r)
    assert sum(map(len, got.values())) == len(rows) and got[0][0] == got[0][1] and got[None][0]["text"] == got[0][0]["text"]
    assert got[100][0]["text"] is None and got[100][0]["scores"] is None and got[101][0]["text"] == "" and got[101][0]["n_blocks"] == 0
    assert all(len(r["scores"]) == r["n_blocks"] >= r["n_content"] for rs in got.values() for r in rs if r["scores"] is not None)
    with pytest.warns(UserWarning, match="every block"):
        plain = html.extract(spark.createDataFrame([(1, "<p>a<p>b")], "page_id long, html string")).first()
    assert plain["text"] == "a\nb"  # nothing to learn from
    assert html.extract(df.limit(0)).count() == 0

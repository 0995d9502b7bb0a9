import duckdb

import __spark_entry__
import corpus_pipeline
from recollect.llm import minhash, packing, pii, quality, substring


def test_stages_and_registry(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "substring_dedup", "pii", "packing"]
    names = list(__spark_entry__.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names
    assert {"op4_topk", "op6_substring"} <= set(__spark_entry__.oracle_sql())


def test_run_equals_the_stages_by_hand(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    keep = {r["doc_id"] for r in quality.classify(docs, labels).collect() if r["keep"]}
    one = docs.filter(docs.doc_id.isin(*keep))
    keep &= {r["doc_id"] for r in minhash.near_duplicates(one).collect() if r["keep"]}
    text = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] in keep}
    seen, cut = set(), {}
    for i in sorted(text):  # brute force: words of runs of 50 that occurred before go
        w = text[i].split()
        gone = set()
        for p in range(len(w) - 49):
            run = tuple(w[p : p + 50])
            if run in seen:
                gone.update(range(p, p + 50))
            seen.add(run)
        cut[i] = [x for k, x in enumerate(w) if k not in gone]
    got = {}
    for r in corpus_pipeline.run(spark, sf).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["n_words"]
    masked = {i: " ".join(w) for i, w in cut.items()}
    want = {i: len(pii.masked(t, pii.find(t)).split()) for i, t in masked.items()}
    assert got.keys() == want.keys()
    assert sum(got[i] == want[i] for i in got) >= 0.98 * len(got)  # line breaks may part what a blank would join for the masking


def test_each_stage_on_its_own(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == columns, name
        n = after.count()
        assert 0 < n <= docs.count()
        assert (n == docs.count()) == (name in ("substring_dedup", "pii")), name
    bins = duckdb.from_arrow(corpus_pipeline.STAGES[-1][1](spark, docs, sf).toArrow())
    assert duckdb.sql("select max(s) from (select sum(n_words) s from bins where bin_id is not null group by bin_id)").fetchall()[0][0] <= packing.Packing().window
    assert substring.Repeats().min_words == 50


def test_odd_rows_go_through_every_stage(spark, sf):
    """Nulls in any column, empty and long texts, repeats, columns with clashing names and of any type, an empty table."""
    long = " ".join(f"word{i % 977}x{i}" for i in range(60_000))
    rows = [(1, "a text of some words", None, None, None, {"k": 1}), (1, "a text of some words", None, None, None, {"k": 1}), (None, "no id here", "en", "s", 3, None), (2, None, "en", "s", None, {}), (3, "", "en", "s", 0, {}), (4, long, "en", "s", 1, {}), (5, long, None, "s", 1, {}), (None, None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row map<string,int>, `d t` string, keep boolean, spans int"
    docs = spark.createDataFrame([(*r, "x", True, 7) for r in rows], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for table in (docs, docs.limit(0)):
            after = stage(spark, table, sf)
            assert after.columns == docs.columns, name
            got = after.collect()
            assert len(got) <= table.count() and all(r["spans"] == 7 and r["d t"] == "x" for r in got)
            if table is docs:
                assert len(got) == {"near_dedup": 6, "substring_dedup": 8, "pii": 8}.get(name, len(got)), name
    bins = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert sum(r["n_words"] for r in bins) == 2 * 5 + 3 + 2 * 60_000 and sum(r["bin_id"] is None for r in bins) == 3
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf).count() == 0

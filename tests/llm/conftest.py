import pytest

#: Names that the operators use within themselves.
CLASHING = ("d", "t", "row", "sig", "key", "keep", "h", "o", "p", "n", "e", "v", "starts", "lengths", "bands", "hits", "rank", "features", "piece", "words", "quality_score", "spans", "node", "root")


@pytest.fixture(scope="session")
def table(spark):
    """documents rows of (doc_id, text), with columns whose names clash."""

    def make(rows, clash=True):
        names = [c for c in CLASHING] if clash else []
        data = [(i, t, "en", None, len(t) if t is not None else None, *[f"{c}-{i}" for c in names]) for i, t in rows]
        return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", {c} string" for c in names))

    return make


@pytest.fixture(scope="session")
def rows_of():
    return lambda df: sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, str(type(x)), x if not isinstance(x, (list, dict)) else str(x)) for x in r))

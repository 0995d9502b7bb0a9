"""Quality classifier: naive Bayes scaled features under a linear support vector machine.

Features are indicators of n-grams: words, their stems, pairs of words, and runs of one to three word shapes (kinds of
characters, last sign, length class, whether the word repeats the one before it). Each is scaled by its
class log-count ratio; rows get unit length; a hinge-loss model is fitted by dual coordinate descent.
Two heads share the features: `quality`, and `toxic`, as toxic text is unfit whatever its style.

The fit uses a bounded sample of the labelled documents (Quality.sample, the least by hash of doc_id).
Scoring reads every text whole and shuffles nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import BLANK, BYTE_HASH, FOLDED_HASH, NOT_ALNUM, U64, Words, int_lists, mix, range_hash, row_schema, slices


@dataclass(frozen=True)
class Quality:
    #: Labelled documents used for the fit, at most.
    sample: int = 4000
    #: Bits of the feature space.
    bits: int = 18
    smoothing: float = 1.0
    cost: float = 1.0
    epochs: int = 15
    seed: int = 5
    #: Documents are kept from this quality score on, and below this toxic score.
    least_quality: float = 0.0
    most_toxic: float = 0.0


KINDS = np.zeros(256, np.uint8)
for _i in range(256):
    _c = chr(_i)
    KINDS[_i] = 8 if _i > 127 else 1 if _c.islower() else 2 if _c.isupper() else 4 if _c.isdigit() else 16 if _c in ".,;:'\"()-?" else 32


#: Leading bytes of a word that make its stem.
STEM = 5


def features(buf: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of each document, one document after the other, and where each begins."""
    salt = mix(np.arange(1, 7, dtype=U64))

    def grams(h, doc, n, salted):
        x = mix(h[: len(h) - n + 1] ^ salted)
        for i in range(1, n):
            x = mix(x * U64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
        same = doc[: len(x)] == doc[n - 1 : n - 1 + len(x)]
        return x[same], doc[: len(x)][same]

    plain = Words(buf, offsets, NOT_ALNUM)
    h, doc = plain.hashes(FOLDED_HASH), plain.doc()
    stems = range_hash(FOLDED_HASH[buf], plain.starts, np.minimum(plain.starts + STEM, plain.ends))
    found = [grams(h, doc, 1, salt[0]), grams(h, doc, 2, salt[1]), grams(stems, doc, 1, salt[5])]
    tokens = Words(buf, offsets, BLANK)
    doc = tokens.doc()
    if len(doc):
        edges = np.stack([tokens.starts, tokens.ends], 1).ravel()
        kinds = np.append(KINDS[buf], np.uint8(0))
        kind = np.bitwise_or.reduceat(kinds, edges)[::2].astype(U64)
        last, head = buf[tokens.ends - 1], KINDS[buf[tokens.starts]].astype(U64)
        sign = np.where(NOT_ALNUM[last], last, 0).astype(U64)
        size = np.minimum(tokens.ends - tokens.starts, 31).astype(U64) >> U64(3)
        whole = tokens.hashes(BYTE_HASH)
        again = np.zeros(len(whole), U64)
        again[1:] = (whole[1:] == whole[:-1]) & (doc[1:] == doc[:-1])
        shape = mix(kind | head << U64(8) | sign << U64(16) | size << U64(24) | again << U64(32))
        found += [grams(shape, doc, n, salt[1 + n]) for n in (1, 2, 3)]
    kind = np.uint32 if (len(offsets) << bits) < 1 << 32 else U64  # narrow keys sort several times faster
    key = np.concatenate([(d.astype(kind) << kind(bits)) | (x >> U64(64 - bits)).astype(kind) for x, d in found])
    key.sort()
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return (key & kind((1 << bits) - 1)).astype(np.int64), np.searchsorted(key, np.arange(len(offsets), dtype=kind) << kind(bits))


def fit(rows: list[np.ndarray], labels: np.ndarray, config: Quality) -> tuple[np.ndarray, float] | None:
    """Weights by feature and bias, from feature numbers and labels 0 or 1; None where a class is missing."""
    n = len(rows)
    positive = int(labels.sum()) if n else 0
    if not 0 < positive < n:
        return None
    size = 1 << config.bits
    y = np.where(labels == 1, 1.0, -1.0)
    counts = [np.bincount(np.concatenate([r for r, k in zip(rows, labels, strict=True) if k == v]), minlength=size) + config.smoothing for v in (1, 0)]
    ratio = np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())
    values = [ratio[r] / max(np.linalg.norm(ratio[r]), 1e-12) for r in rows]
    cost = np.where(labels == 1, n / (2 * positive), n / (2 * (n - positive))) * config.cost
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(n)
    rng = np.random.default_rng(config.seed)
    for _ in range(config.epochs):
        for i in rng.permutation(n):  # the bias is a feature of value 1, so a row's square is 2
            r, x = rows[i], values[i]
            new = min(max(alpha[i] - (y[i] * (w[r] @ x + bias) - 1) / 2, 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[r] += step * x
                bias += step
                alpha[i] = new
    return np.stack([w * ratio, ratio * ratio]), bias


def fit_calibrated(rows: list[np.ndarray], labels: np.ndarray, config: Quality):
    """fit, with the bias moved to where a fit to four fifths tells the classes of the last fifth apart best.

    Best is by the mean of both classes' accuracies. With fewer than ten held-out rows of a class the bias stays.
    """
    whole = fit(rows, labels, config)
    held = np.arange(len(rows)) % 5 == 4
    if whole is None or min(np.bincount(labels[held], minlength=2)) < 10:
        return whole
    part = fit([r for r, h in zip(rows, held, strict=True) if not h], labels[~held], config)
    if part is None:
        return whole
    (w, square), bias = part
    s = np.array([w[r].sum() / max(np.sqrt(square[r].sum()), 1e-12) + bias for r, h in zip(rows, held, strict=True) if h])
    order = np.argsort(s, kind="stable")
    s, y = s[order], labels[held][order]
    good = np.concatenate([[0], np.cumsum(y == 0)]) / (y == 0).sum() + (y.sum() - np.concatenate([[0], np.cumsum(y == 1)])) / y.sum()
    cuts = np.concatenate([[s[0] - 1e-6], (s[1:] + s[:-1]) / 2, [s[-1] + 1e-6]])
    best = cuts[good >= good.max() - 1e-12]
    return whole[0], whole[1] - float(best.mean())


def training_rows(docs: DataFrame, labels: DataFrame, config: Quality) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and (quality, toxic) of the sample. A doc_id labelled twice counts by its worse label."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"))
        .dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(config.sample)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull())
    joined = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "toxic", "text")  # at most `sample` rows

    def run(batches):
        for batch in batches:
            for rows, buf, offsets in slices(batch, "text"):
                f, first = features(buf, offsets, config.bits)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), rows.column(2), int_lists(f, first, pa.int32())], names=["doc_id", "quality", "toxic", "features"])

    got = joined.mapInArrow(run, "doc_id long, quality int, toxic int, features array<int>").toArrow()
    rows = sorted(zip(got["doc_id"].to_pylist(), got["quality"].to_pylist(), got["toxic"].to_pylist(), (x.values.to_numpy().astype(np.int64) for x in got["features"]), strict=True), key=lambda x: (x[0], x[1], x[2], len(x[3])))
    return [x[3] for x in rows], np.array([x[1:3] for x in rows], np.int64).reshape(-1, 2)


def train(docs: DataFrame, labels: DataFrame, config: Quality = Quality()) -> list:
    """The two heads, quality and toxic; a head is None where the labels hold one class only."""
    rows, y = training_rows(docs, labels, config)
    return [fit_calibrated(rows, y[:, k], config) for k in (0, 1)]


def score(buf: np.ndarray, offsets: np.ndarray, heads: list, config: Quality) -> list[np.ndarray | None]:
    f, first = features(buf, offsets, config.bits)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    out = []
    for head in heads:
        if head is None:
            out.append(None)
            continue
        (w, square), bias = head
        total, norm = (np.bincount(doc, weights=x[f], minlength=len(offsets) - 1) for x in (w, square))
        out.append(total / np.maximum(np.sqrt(norm), 1e-12) + bias)
    return out


def scored(docs: DataFrame, heads: list, config: Quality = Quality()) -> DataFrame:
    """All columns of docs as the struct `row`, with quality_score, toxic_score and keep."""
    shared = docs.sparkSession.sparkContext.broadcast(heads)  # two heads of 2**bits weights, whatever the corpus
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            for part, buf, offsets in slices(batch, "text"):
                blank = Words(buf, offsets).counts == 0
                q, t = score(buf, offsets, shared.value, config)
                keep = ~blank & (True if q is None else q >= config.least_quality) & (True if t is None else t < config.most_toxic)
                scores = [pa.nulls(len(blank), pa.float64()) if x is None else pa.array(np.round(x, 6), pa.float64(), mask=blank) for x in (q, t)]
                yield pa.RecordBatch.from_arrays([part.column(0), *scores, pa.array(keep)], names=["row", "quality_score", "toxic_score", "keep"])

    return rows.mapInArrow(run, row_schema(rows, "quality_score double, toxic_score double, keep boolean"))


def classify(docs: DataFrame, labels: DataFrame, config: Quality = Quality()) -> DataFrame:
    """(doc_id, quality_score, toxic_score, keep), one row for each row of docs.

    keep is quality_score >= least_quality and toxic_score < most_toxic. A null, empty or blank text has
    null scores and isn't kept. Where the labels hold one class only, or none, that head's score is null
    and rejects nothing. Labels with a null are ignored, as are further columns of either table. Texts
    are scored whole, repeated rows each on its own; an empty table gives an empty one.
    """
    return scored(docs.select("doc_id", "text"), train(docs, labels, config), config).select(F.col("row.doc_id").alias("doc_id"), "quality_score", "toxic_score", "keep")


def accepted(docs: DataFrame, labels: DataFrame, config: Quality = Quality(), training: DataFrame | None = None) -> DataFrame:
    """The rows of docs that classify keeps, all columns; training: where the labelled texts are, if elsewhere.

    For null, empty and long texts, repeated rows and empty tables see classify.
    """
    return scored(docs, train(docs if training is None else training, labels, config), config).filter("keep").select("row.*")

"""MinHash near-dedup with b-bit signatures.

A document is the set of its runs of three words (ASCII case and punctuation ignored; a shorter text is
one run). 128 minima are taken; groups of three make 42 band keys, while the signature keeps four mixed
bits of each minimum, 64 bytes in all. Documents that meet in a band are compared by their
signatures: equal nibbles are counted and corrected for the one in sixteen that agree by chance.

Rows equal in signature and in all bands are collapsed first, so thousands of exact copies are one row from there on. In a band
bucket single linkage is exact: nothing is capped, and only a spanning forest leaves the bucket.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import joined
from .textkit import FOLDED_HASH, NOT_ALNUM, U64, Words, binary, int_lists, longs, mix, settle, slices, text_key

LAST = (1 << 63) - 1
NIBBLES = U64(0x1111111111111111)


@dataclass(frozen=True)
class MinHash:
    shingle: int = 3
    hashes: int = 128
    band_rows: int = 3
    #: Estimated Jaccard similarity from which two documents are near copies.
    threshold: float = 0.45
    seed: int = 11

    BITS = 4

    @property
    def bands(self) -> int:
        return self.hashes // self.band_rows

    @property
    def least_matches(self) -> int:
        """Equal nibbles out of `hashes` that the threshold asks for, after C + (1 - C) J."""
        chance = 1 / (1 << self.BITS)
        return int(np.ceil(self.hashes * (chance + (1 - chance) * self.threshold) - 1e-9))


def shingle_hashes(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all runs of k words, and the first run of each document with words."""
    h, counts = words.hashes(FOLDED_HASH), words.counts
    full = h.copy()
    for i in range(1, k):
        full[: len(h) - i] = mix(full[: len(h) - i] * U64(0x9E3779B97F4A7C15) + h[i:])
    n_runs = np.where(counts > 0, np.maximum(counts - k + 1, 1), 0)
    ends = words.first[1:]
    for doc in np.flatnonzero((counts > 0) & (counts < k)):  # a text of fewer words is one run of what it has
        value = counts[doc : doc + 1].astype(U64)
        for i in range(words.first[doc], ends[doc]):
            value = mix(value * U64(31) + h[i : i + 1])
        full[words.first[doc]] = value[0]
    place = np.arange(len(h)) - np.repeat(words.first[:-1], counts)
    keep = place < np.repeat(n_runs, counts)
    return full[keep], np.concatenate([[0], np.cumsum(n_runs)])


def minima(runs: np.ndarray, starts: np.ndarray, config: MinHash) -> np.ndarray:
    """hashes x documents matrix of the least value of each hash over each document's runs."""
    rng = np.random.default_rng(config.seed)
    flips = rng.integers(0, (1 << 64) - 1, config.hashes, dtype=U64, endpoint=True)
    factors = rng.integers(0, 1 << 63, config.hashes, dtype=U64) * U64(2) + U64(1)
    out = np.empty((config.hashes, len(starts)), U64)
    at = 0
    while at < len(starts):  # blocks that stay in the cache
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + 30_000)))
        lo, hi = starts[at], starts[to] if to < len(starts) else len(runs)
        block, edges = runs[lo:hi], starts[at:to] - lo
        work = np.empty_like(block)
        for k in range(config.hashes):
            np.bitwise_xor(block, flips[k], out=work)
            np.multiply(work, factors[k], out=work)
            out[k, at:to] = np.minimum.reduceat(work, edges)
        at = to
    return out


def signature_rows(config: MinHash):
    def run(batches):
        for batch in batches:
            for rows, buf, offsets in slices(batch, "text"):
                words = Words(buf, offsets, NOT_ALNUM)
                counts = words.counts
                has = np.flatnonzero(counts > 0)
                n = len(counts)
                sig, bands, same = np.zeros((n, config.hashes // 16), U64), np.zeros((n, config.bands), U64), np.zeros(n, U64)
                if len(has):
                    runs, first = shingle_hashes(words, config.shingle)
                    least = minima(runs, first[:-1][has], config)
                    nibbles = (mix(least) >> U64(60)).reshape(config.hashes // 16, 16, -1)
                    sig[has] = np.bitwise_or.reduce(nibbles << (U64(4) * np.arange(16, dtype=U64))[None, :, None], axis=1).T
                    grouped = least[: config.bands * config.band_rows].reshape(config.bands, config.band_rows, -1)
                    key = np.broadcast_to(mix(np.arange(1, config.bands + 1, dtype=U64))[:, None], grouped[:, 0].shape)
                    for r in range(config.band_rows):
                        key = mix(key * U64(0x9E3779B97F4A7C15) + grouped[:, r])
                    bands[has] = key.T
                    same[has] = np.bitwise_xor.reduce(mix(key), axis=0)
                width = config.hashes // 2
                some = pa.array(counts == 0)
                sigs = binary(sig, np.arange(n + 1) * width)
                none = pa.nulls(n, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pc.if_else(some, none, sigs), int_lists(bands.reshape(-1).view(np.int64), np.arange(n + 1) * config.bands, pa.int64()), pa.array(same.view(np.int64))],
                    names=["d", "t", "sig", "bands", "same"],
                )

    return run


def matches(a: np.ndarray, b: np.ndarray, hashes: int) -> np.ndarray:
    """Equal nibbles of packed signatures, by counting bits."""
    x = a ^ b
    x |= x >> U64(2)
    x |= x >> U64(1)
    return hashes - np.bitwise_count(x & NIBBLES).sum(axis=-1, dtype=np.int64)


def link(sig: np.ndarray, config: MinHash) -> list[tuple[int, int]]:
    """Spanning forest of the rows whose signatures match: single linkage within one bucket, exact."""
    edges, rest = [], np.arange(len(sig))
    while len(rest) > 1:
        root, frontier, rest = rest[0], [rest[0]], rest[1:]
        while frontier and len(rest):
            near = matches(sig[rest], sig[frontier.pop()], config.hashes) >= config.least_matches
            found, rest = rest[near], rest[~near]
            edges += [(root, x) for x in found]
            frontier += list(found)
    return edges


def bucket_edges(config: MinHash):
    """Rows sorted by band key to the edges within each key's bucket."""

    def edges(key, d, t, sig):
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([new, [len(key)]]))
        head = np.repeat(new, size)
        row = np.flatnonzero((np.repeat(size, size) > 1) & (np.arange(len(key)) != head))
        ok = matches(sig[row], sig[head[row]], config.hashes) >= config.least_matches
        a, b = [head[row[ok]]], [row[ok]]
        missed = head[row[~ok]]
        for start in np.unique(missed):
            n = size[np.searchsorted(new, start)]
            if n > 2:
                found = np.array(link(sig[start : start + n], config), np.int64).reshape(-1, 2) + start
                a.append(found[:, 0])
                b.append(found[:, 1])
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (d[a], t[a], d[b], t[b])], names=["ud", "ut", "vd", "vt"])

    def run(batches):
        parts: list[list[np.ndarray]] = []  # what may belong to a key that goes on
        for batch in batches:
            if not len(batch):
                continue
            column = batch.column(3).cast(pa.large_binary())
            at = np.frombuffer(column.buffers()[1], np.int64)[column.offset]
            sig = np.frombuffer(column.buffers()[2], np.uint8)[at : at + len(batch) * config.hashes // 2].view(U64).reshape(len(batch), -1)
            now = [longs(batch, "key"), longs(batch, "d"), longs(batch, "t"), sig]
            parts.append(now)
            if parts[0][0][0] == now[0][-1]:  # one key so far
                continue
            now = [np.concatenate(x) for x in zip(*parts, strict=True)]
            cut = int(np.searchsorted(now[0], now[0][-1]))
            yield edges(*(x[:cut] for x in now))
            parts = [[x[cut:] for x in now]]
        if parts:
            yield edges(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    return run


def near_duplicates(docs: DataFrame, config: MinHash = MinHash()) -> DataFrame:
    """Groups of near copies: (doc_id, group_id, group_size, n_links, keep, n_rows, text_hash).

    One row per distinct document, that is per pair of doc_id and text; n_rows counts the input rows it
    stands for. group_id is the doc_id of the group's kept document: the least doc_id, nulls last, then
    the least text hash. n_links counts the different signatures its own was linked to: a bucket links
    its rows to its head, and to each other where they don't match it, so links tell why a document is
    in its group and aren't all pairs that match; copies of one text have the links of that text. A null,
    empty or wordless text is a group of its own without links and kept. A null doc_id stays null. An empty table gives an empty result; columns but doc_id and text are ignored.
    """
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"), text_key().alias("t"), F.col("text").cast("string").alias("text"))
    signed = settle(keyed.mapInArrow(signature_rows(config), "d long, t long, sig binary, bands array<long>, same long"))
    reps = signed.filter("sig is not null").groupBy("sig", "same").agg(F.min(F.struct("d", "t")).alias("node"), F.first("bands").alias("bands"))
    banded = reps.select(F.explode("bands").alias("key"), "node.d", "node.t")
    met = banded.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("key"))).filter("c > 1").select("key", "d", "t")
    met = met.join(reps.select("node.d", "node.t", "sig"), ["d", "t"]).select("key", "d", "t", "sig")  # signatures travel for those only that met another
    found = met.repartition("key").sortWithinPartitions("key", "d", "t").mapInArrow(bucket_edges(config), "ud long, ut long, vd long, vt long")
    roots, links = joined(found.select(F.struct(F.col("ud").alias("d"), F.col("ut").alias("t")).alias("u"), F.struct(F.col("vd").alias("d"), F.col("vt").alias("t")).alias("v")))
    rows = signed.groupBy("d", "t", "sig", "same").agg(F.count(F.lit(1)).alias("n_rows"))
    per_sig = rows.filter("sig is not null").groupBy("sig", "same").agg(F.min(F.struct("d", "t")).alias("node"), F.count(F.lit(1)).alias("n"))
    per_sig = per_sig.join(roots.join(links, "node"), "node", "left").select("sig", "same", "n", F.coalesce("root", "node").alias("root"), "n_links")
    sizes = per_sig.groupBy("root").agg(F.sum("n").alias("group_size"))
    per_sig = per_sig.join(sizes, "root").select("sig", "same", "root", "group_size", "n_links")
    own = F.struct("d", "t")
    root = F.coalesce(F.col("root"), own)
    doc = lambda c: F.when(c != LAST, c)
    return rows.join(per_sig, ["sig", "same"], "left").select(
        doc(F.col("d")).alias("doc_id"), doc(root["d"]).alias("group_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), (root == own).alias("keep"), "n_rows", F.col("t").alias("text_hash"),
    )


def keep_one(docs: DataFrame, config: MinHash = MinHash()) -> DataFrame:
    """The documents without near copies of another: all columns, one row of each group.

    Rows equal in doc_id and text are one document, of which one row stays (the first of them written
    out as text, so columns may have any type). See near_duplicates for the group, for null, empty and
    wordless texts and for empty tables.
    """
    decided = near_duplicates(docs, config).select(F.coalesce("doc_id", F.lit(LAST)).alias("d"), F.col("text_hash").alias("t"), "keep", "n_rows")
    special = settle(decided.filter("not keep or n_rows > 1"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"), text_key().alias("t"))
    single = rows.join(special, ["d", "t"], "left_anti").select("row.*")
    repeated = rows.join(special.filter("keep"), ["d", "t"], "left_semi").groupBy("d", "t").agg(F.min_by("row", F.col("row").cast("string")).alias("row")).select("row.*")
    return single.unionByName(repeated)

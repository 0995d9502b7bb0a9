"""Exact substring dedup with fixed-block anchors.

A text is the sequence of its blank-separated words. Any repeat of min_words words holds a whole aligned
block of block_words = min_words // 2 in each of its copies, as blocks lie at every block_words-th word.
So:

1. index the non-overlapping blocks and probe them with every rolling window of the same length; a
   window whose hash equals that of a block lying elsewhere is a hit. What a slice of some thousand
   documents has twice is a hit at once, and only one of its windows is sent;
2. extend: around the hits, and only there, take each run of min_words words. Equal runs have the same
   least window within them, so runs meet by it: neighbours with one least window travel as one row. The
   first place of a run is its reference, every later one a repeat;
3. join repeats at consecutive words that have their reference in the same document to maximal spans.

Step 1 moves each window as a 32-bit hash and a 16-bit step, packed a few thousand to a row; a chance
agreement there costs a little work in step 2, where two 64-bit hashes decide, that of the least window
and that of the run.

A window that very many slices hold, as a license line has, is known after step 1. Runs with such a least
window aren't brought together in one task: their first places are found by an aggregation that combines
before it shuffles, and joined back.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textkit import SLICE_BYTES, U64, Words, binary, int_lists, longs, mix, range_hash, row_schema, settle, slices, text_key

LAST = (1 << 63) - 1


@dataclass(frozen=True)
class Repeats:
    #: Words from which an equal passage counts as a repeat.
    min_words: int = 50
    #: Windows that one bucket of the probe should hold; it sets the number of buckets from the corpus' size.
    bucket_windows: int = 2_000_000
    #: Spans up to which the cut ships them to every task; beyond it the texts are joined to them.
    broadcast_spans: int = 50_000
    #: Slices that hold the same window, from which runs around it are matched by aggregation; a fiftieth of all, if more.
    hot: int = 1000

    @property
    def block_words(self) -> int:
        return max(1, self.min_words // 2)


def windows(values: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Where windows of `length` words start, none across documents, and their hashes."""
    counts = np.diff(first)
    place = np.arange(len(values)) - np.repeat(first[:-1], counts)
    at = np.flatnonzero(place <= np.repeat(counts - length, counts))
    return at, range_hash(values, at, at + length)


def pack_steps(at: np.ndarray) -> bytes:
    """Rising positions as 16-bit steps, low bytes then high bytes; a step of 65535 says: more follows."""
    steps = np.diff(at, prepend=0)
    big = steps // 65535
    if big.any():
        out = np.full(len(steps) + int(big.sum()), 65535, np.int64)
        out[np.arange(len(steps)) + np.cumsum(big)] = steps % 65535
        steps = out
    return steps.astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()


def unpack_steps(data: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(2, -1).T).view("<u2").ravel().astype(np.int64)
    return np.cumsum(steps)[steps != 65535]


def placed(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each hash, and the 32 bits that stand for it there."""
    return (((h >> U64(32)) * U64(buckets)) >> U64(32)).astype(np.int64), h.astype(np.uint32)


def probe_rows(config: Repeats, buckets: int):
    """Distinct windows of each slice, by bucket of their hash; and, with bucket -1, its documents and its own hits."""

    def run(batches):
        for batch in batches:
            for rows, buf, offsets in slices(batch, "text"):
                words = Words(buf, offsets)
                at, h = windows(words.hashes(), words.first, config.block_words)
                if not len(at):
                    continue
                doc = np.searchsorted(words.first, at, "right") - 1
                aligned = (at - words.first[doc]) % config.block_words == 0
                d, t = longs(rows, "d"), longs(rows, "t")
                key = int(mix(np.array([np.bitwise_xor.reduce(mix(mix(d.view(U64)) + t.view(U64) + np.arange(len(d), dtype=U64))), len(d)], U64).sum(keepdims=True))[0].view(np.int64))
                order = np.argsort(h, kind="stable")
                first = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
                several = np.repeat(np.diff(np.append(first, len(h))) > 1, np.diff(np.append(first, len(h))))
                own = np.sort(at[order[several]]).astype("<u4").tobytes()
                one = order[first]
                aligned[one] = np.logical_or.reduceat(aligned[order], first)
                one.sort()
                at, h, aligned = at[one], h[one], aligned[one]
                bucket, low = placed(h, buckets)
                order = np.argsort(bucket.astype(np.uint16) if buckets < 65536 else bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                at, low, aligned = at[order], low[order], aligned[order]
                some = np.flatnonzero(np.diff(cuts))
                table = np.stack([d, t, words.first[:-1]]).astype("<i8").tobytes()
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array(np.concatenate([[-1], some]), pa.int32()),
                    "slice": pa.array(np.full(len(some) + 1, key), pa.int64()),
                    "hash": pa.array([table] + [low[cuts[i] : cuts[i + 1]].tobytes() for i in some], pa.binary()),
                    "place": pa.array([own] + [pack_steps(at[cuts[i] : cuts[i + 1]]) for i in some], pa.binary()),
                    "block": pa.array([b""] + [np.packbits(aligned[cuts[i] : cuts[i + 1]]).tobytes() for i in some], pa.binary()),
                })

    return run


#: The bucket of rows with a slice's documents, with its own hits, and with windows that many slices hold.
DOCUMENTS, OWN, HOT = -3, -2, -1


def _told(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    bucket, key, data = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(key, pa.int64()), pa.array(data, pa.binary())], names=["bucket", "slice", "hits"])


def _hits(bucket: int, rows: list[tuple], hot: int) -> pa.RecordBatch:
    """Windows that equal a block lying in another slice, by slice; and those that more than `hot` slices hold."""
    seen: dict[int, tuple] = {}
    for key, h, place, block in rows:  # a slice told twice is the same documents again
        seen[key] = (np.frombuffer(h, np.uint32), place, block)
    keys = list(seen)
    sizes = [len(x[0]) for x in seen.values()]
    hashes = np.concatenate([x[0] for x in seen.values()])
    aligned = np.concatenate([np.unpackbits(np.frombuffer(x[2], np.uint8), count=n).astype(bool) for x, n in zip(seen.values(), sizes, strict=True)])
    blocks = np.unique(hashes[aligned])
    found = np.flatnonzero(blocks[np.minimum(np.searchsorted(blocks, hashes), len(blocks) - 1)] == hashes) if len(blocks) else np.zeros(0, np.int64)
    which, n = np.unique(hashes[found], return_inverse=True, return_counts=True)[1:]
    found = found[n[which] > 1] if len(found) else found
    first = np.concatenate([[0], np.cumsum(sizes)])
    cuts = np.searchsorted(found, first)
    out = [(bucket, key, (unpack_steps(seen[key][1])[found[cuts[i] : cuts[i + 1]] - first[i]]).astype("<u4").tobytes()) for i, key in enumerate(keys) if cuts[i + 1] > cuts[i]]
    if len(keys) > hot:
        cell = hashes >> np.uint32(12)
        crowded = hashes[np.bincount(cell, minlength=1 << 20)[cell] > hot]
        value, n = np.unique(crowded, return_counts=True)
        out += [(HOT, (bucket << 32) | v, np.int64(k).tobytes()) for v, k in zip(value.tolist(), n.tolist(), strict=True) if k > hot]
    return _told(out)


def probe(hot: int):
    """Rows sorted by bucket; one bucket is held at a time. Tables of documents pass through, with their own hits."""

    def run(batches):
        at, rows = None, []
        for batch in batches:
            for bucket, key, h, place, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket == -1:
                    yield _told([(DOCUMENTS, key, h)] + [(OWN, key, place)] * bool(place))
                    continue
                if bucket != at and rows:
                    yield _hits(at, rows, hot)
                    rows = []
                at = bucket
                rows.append((key, h, place, block))
        if rows:
            yield _hits(at, rows, hot)

    return run


def hit_documents(batches):
    """Rows sorted by slice, its table of documents first: the places of the hits in each document; windows that many hold pass through."""
    names = ["hot", "d", "t", "hits"]

    def flush(table, hits):
        if table is None or not hits:
            return
        d, t, first = np.frombuffer(table, "<i8").reshape(3, -1)
        at = np.unique(np.concatenate([np.frombuffer(x, "<u4") for x in hits])).astype(np.int64)
        doc = np.searchsorted(first, at, "right") - 1
        docs, starts = np.unique(doc, return_index=True)
        ends = np.append(starts, len(at))
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(docs), bool)), pa.array(d[docs]), pa.array(t[docs]), int_lists(at - first[doc], ends, pa.int32())], names=names)

    now, table, hits = None, None, []
    for batch in batches:
        for bucket, key, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket == HOT:
                n = int(np.frombuffer(data, "<i8")[0])
                yield pa.RecordBatch.from_arrays([pa.array([True]), pa.array([key]), pa.array([n]), pa.array([[]], pa.list_(pa.int32()))], names=names)
                continue
            if key != now:
                yield from flush(table, hits)
                now, table, hits = key, None, []
            if bucket == DOCUMENTS:
                table = data
            else:
                hits.append(data)
    yield from flush(table, hits)


def least_within(x: np.ndarray, width: int) -> np.ndarray:
    """The least of x[i : i + width] for each i, cut at the end."""
    span = 1
    while span * 2 <= width:
        x = np.concatenate([np.minimum(x[:-span], x[span:]), x[-span:]])
        span *= 2
    step = width - span
    return np.concatenate([np.minimum(x[:-step], x[step:]), x[-step:]]) if 0 < step < len(x) else x


#: Runs of a row, at most.
ROW_RUNS = 4096
PACKED = "hot boolean, key long, d long, t long, p int, runs binary"


def long_runs(config: Repeats, buckets: int, hot: np.ndarray):
    """Documents with the places of their hits to the runs of min_words words that hold a hit.

    A row has consecutive runs with the same least window (key): where the first begins, and the hash of each.
    """
    reach = config.min_words - config.block_words

    def run(batches):
        for batch in batches:
            for rows, buf, offsets in slices(batch, "text"):
                words = Words(buf, offsets)
                values = words.hashes()
                at, h = windows(values, words.first, config.min_words)
                own = rows.column(rows.schema.get_field_index("hits"))
                places = own.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                lengths = pc.list_value_length(own).to_numpy(zero_copy_only=False)
                marks = np.zeros(words.first[-1] + 2, np.int64)
                hit = places + np.repeat(words.first[:-1], lengths)
                low = np.maximum(hit - reach, np.repeat(words.first[:-1], lengths))
                np.add.at(marks, low, 1)
                np.add.at(marks, hit + 1, -1)
                keep = np.cumsum(marks)[at] > 0
                at, h = at[keep], h[keep]
                if not len(at):
                    continue
                block_at, block_h = windows(values, words.first, config.block_words)
                least = np.full(len(values), ~U64(0))
                least[block_at] = block_h
                key = least_within(least, reach + 1)[at]
                new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (key[1:] != key[:-1])])
                begin = np.flatnonzero(new)
                within = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
                begin = np.flatnonzero(within % ROW_RUNS == 0)
                doc = np.searchsorted(words.first, at[begin], "right") - 1
                bucket, low32 = placed(key[begin], buckets)
                crowded = np.isin((bucket << 32) | low32.astype(np.int64), hot)
                yield pa.RecordBatch.from_arrays([pa.array(crowded), pa.array(key[begin].view(np.int64)), pa.array(longs(rows, "d")[doc]), pa.array(longs(rows, "t")[doc]), pa.array((at[begin] - words.first[doc]).astype(np.int32)), binary(h.view(np.uint8), np.append(begin, len(h)) * 8)], names=["hot", "key", "d", "t", "p", "runs"])

    return run


def _runs(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of packed rows (row, place, hash) of each run."""
    column = rows.column(rows.schema.get_field_index("runs")).cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(rows) + 1]
    n = np.diff(offsets) // 8
    row = np.repeat(np.arange(len(rows)), n)
    p = longs(rows, "p")[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return row, p, np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.int64) if len(row) else np.zeros(0, np.int64)


MATCHED = "hot boolean, key long, d long, t long, p int, runs binary, n int, rd long, rt long, rp int"


def matched(batches):
    """Rows sorted by key, then place, to pieces (d, t, p, n, rd, rt, rp): n runs from p on that occurred before, first at rp on.

    The keys of one batch are matched at once; of the last, which may go on, the first places are kept.
    Runs around crowded windows pass through.
    """
    kept = [np.zeros(0, np.int64)] * 5  # key, hash, d, t, p of the first places of the last key
    last = None
    for batch in batches:
        hot = batch.column(0).to_numpy(zero_copy_only=False)
        if hot.any():
            some = batch.filter(pa.array(hot))
            yield pa.RecordBatch.from_arrays([*some.columns, *(pa.nulls(len(some), k) for k in (pa.int32(), pa.int64(), pa.int64(), pa.int32()))], names=[*some.schema.names, "n", "rd", "rt", "rp"])
            batch = batch.filter(pa.array(~hot))
        if not len(batch):
            continue
        names = np.stack([longs(batch, c) for c in ("key", "d", "t", "p")], 1)
        fresh = np.concatenate([[last is None or (names[0] != last).any()], (names[1:] != names[:-1]).any(axis=1)])  # of repeated rows, one
        last = names[-1]
        batch, names = batch.filter(pa.array(fresh)), names[fresh]
        if not len(batch):
            continue
        row, p, h = _runs(batch)
        before = kept[0] == names[0, 0]
        old = int(before.sum())
        key, h, d, t, p = (np.concatenate([k[before], x]) for k, x in zip(kept, (names[row, 0], h, names[row, 1], names[row, 2], p), strict=True))
        row = np.concatenate([np.full(old, -1), row])
        order = np.lexsort((h, key))
        new = np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (h[order][1:] != h[order][:-1])])
        first = np.empty(len(key), np.int64)
        first[order] = np.repeat(order[new], np.diff(np.append(np.flatnonzero(new), len(key))))
        again = np.flatnonzero(first != np.arange(len(key)))
        again = again[again >= old]
        if len(again):
            f = first[again]
            cut = np.concatenate([[True], (row[again][1:] != row[again][:-1]) | (p[again][1:] != p[again][:-1] + 1) | (d[f][1:] != d[f][:-1]) | (t[f][1:] != t[f][:-1]) | (p[f][1:] != p[f][:-1] + 1)])
            begin = np.flatnonzero(cut)
            a, f, n = again[begin], f[begin], np.diff(np.append(begin, len(again)))
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(a), bool)), pa.array(key[a]), pa.array(d[a]), pa.array(t[a]), pa.array(p[a].astype(np.int32)), pa.nulls(len(a), pa.binary()), pa.array(n.astype(np.int32)), pa.array(d[f]), pa.array(t[f]), pa.array(p[f].astype(np.int32))], names=["hot", "key", "d", "t", "p", "runs", "n", "rd", "rt", "rp"])
        mine = np.flatnonzero((key == key[-1]) & (first == np.arange(len(key))))
        kept = [x[mine] for x in (key, h, d, t, p)]


def single_runs(batches):
    """Packed rows to a row for each run."""
    for batch in batches:
        row, p, h = _runs(batch)
        yield pa.RecordBatch.from_arrays([pa.array(longs(batch, "key")[row]), pa.array(h), pa.array(longs(batch, "d")[row]), pa.array(longs(batch, "t")[row]), pa.array(p.astype(np.int32))], names=["key", "h", "d", "t", "p"])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"), text_key().alias("t"), F.col("text").cast("string").alias("text"))


def repeated_runs(docs: DataFrame, config: Repeats = Repeats()) -> DataFrame:
    """Pieces (d, t, p, n, rd, rt, rp): n runs of min_words words of document (d, t), from its word p on, that occurred before, first in (rd, rt) from rp on."""
    keyed = _keyed(docs)
    size = docs.select(F.sum(F.octet_length(F.col("text").cast("string"))).alias("n")).first()["n"] or 0
    buckets = max(12, -(-size // (6 * config.bucket_windows)))
    crowd = max(config.hot, size // SLICE_BYTES // 50)
    probed = keyed.mapInArrow(probe_rows(config, buckets), "bucket int, slice long, hash binary, place binary, block binary")
    hits = probed.repartition(F.when(F.col("bucket") < 0, F.col("slice")).otherwise(F.col("bucket"))).sortWithinPartitions("bucket", "slice").mapInArrow(probe(crowd), "bucket int, slice long, hits binary")
    found = settle(hits.repartition("slice").sortWithinPartitions("slice", "bucket").mapInArrow(hit_documents, "hot boolean, d long, t long, hits array<int>").dropDuplicates(["hot", "d", "t"]))
    crowded = np.array(sorted(r["d"] for r in found.filter("hot").orderBy(F.desc("t"), "d").limit(20_000).collect()), np.int64)  # only how runs are matched hangs on it
    packed = keyed.join(found.filter("not hot").select("d", "t", "hits"), ["d", "t"]).select("d", "t", "text", "hits").mapInArrow(long_runs(config, buckets, crowded), PACKED)
    spread = F.when(F.col("hot"), F.xxhash64("key", "d", "t", "p")).otherwise(F.col("key"))
    out = packed.repartition(spread).sortWithinPartitions("key", "d", "t", "p").mapInArrow(matched, MATCHED)
    columns = ["d", "t", "p", "n", "rd", "rt", "rp"]
    if not len(crowded):
        return out.select(columns)
    out = settle(out)
    runs = out.filter("hot").select("key", "d", "t", "p", "runs").dropDuplicates(["key", "d", "t", "p"]).mapInArrow(single_runs, "key long, h long, d long, t long, p int")
    first = runs.groupBy("key", "h").agg(F.min(F.struct("d", "t", "p")).alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    more = runs.join(first, ["key", "h"]).filter(F.col("first") != F.struct("d", "t", "p")).select("d", "t", "p", F.lit(1).alias("n"), F.col("first.d").alias("rd"), F.col("first.t").alias("rt"), F.col("first.p").alias("rp"))
    return out.filter("not hot").select(columns).unionByName(more)


def repeats(docs: DataFrame, config: Repeats = Repeats()) -> DataFrame:
    """Maximal repeated spans: (doc_id, start_word, n_words, ref_doc_id, ref_start_word, text_hash).

    Words n from start_word on occurred before, in the document ref_doc_id from ref_start_word on (which
    may be the same document). The order is by doc_id, nulls last, then text hash, then place; the first
    occurrence is never listed. Spans of one document may overlap by less than min_words words where
    their references differ. Rows equal in doc_id and text are one document. Null, empty and shorter
    texts have no spans; texts of any length are read whole; an empty table gives none; columns but
    doc_id and text are ignored.
    """
    order = Window.partitionBy("d", "t").orderBy("p")
    here = F.struct("rd", "rt")
    start = F.coalesce((F.col("p") != F.lag(F.col("p") + F.col("n")).over(order)) | (here != F.lag(here).over(order)), F.lit(True))
    spans = repeated_runs(docs, config).withColumn("start", start.cast("int")).withColumn("span", F.sum("start").over(order)).groupBy("d", "t", "span").agg(F.min("p").alias("p"), F.sum("n").alias("n"), F.first("rd").alias("rd"), F.min("rp").alias("rp"))
    doc = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return spans.select(doc("d").alias("doc_id"), F.col("p").cast("long").alias("start_word"), (F.col("n") + config.min_words - 1).alias("n_words"), doc("rd").alias("ref_doc_id"), F.col("rp").cast("long").alias("ref_start_word"), F.col("t").alias("text_hash"))


def cut_words(batches):
    """Removes the spans (starts, lengths in words) from each text; blanks before a removed word go with it."""
    for batch in batches:
        n_text, n_s, n_l = (batch.schema.get_field_index(x) for x in ("text", "starts", "lengths"))
        out = []
        for rows, buf, offsets in slices(batch, "text"):
            starts, lengths = rows.column(n_s), rows.column(n_l)
            texts = rows.column(n_text).to_pylist()
            some = [i for i, v in enumerate(starts.is_valid().to_pylist()) if v]
            if some:
                words = Words(buf, offsets)
                for i in some:
                    lo, hi = words.first[i], words.first[i + 1]
                    gone = np.zeros(hi - lo + 1, np.int64)
                    s, n = np.array(starts[i].as_py()), np.array(lengths[i].as_py())
                    np.add.at(gone, s, 1)
                    np.add.at(gone, s + n, -1)
                    kept = np.cumsum(gone)[:-1] == 0
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], kept, [False]]).astype(np.int8)))
                    parts = [buf[(words.ends[lo + a - 1] if k else words.starts[lo + a]) : words.ends[lo + b - 1]].tobytes() for k, (a, b) in enumerate(zip(edge[::2], edge[1::2], strict=True))]
                    texts[i] = b"".join(parts).decode()
            out += texts
        arrays = [pa.array(out, pa.string()) if i == n_text else c for i, c in enumerate(batch.columns)]
        yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names).select([x for x in batch.schema.names if x not in ("starts", "lengths")])


def without_repeats(docs: DataFrame, config: Repeats = Repeats()) -> DataFrame:
    """The documents, all columns, with every repeated span cut from text; first occurrences stay.

    n_chars, where there is such a column, follows the new text. A document of which nothing is left has
    an empty text. Untouched texts stay as they are, null ones null. Rows equal in doc_id and text are
    one document and lose the same; all rows stay. An empty table gives an empty one.
    """
    spans = settle(
        repeats(docs, config).groupBy(F.coalesce("doc_id", F.lit(LAST)).alias("d"), F.col("text_hash").alias("t")).agg(F.collect_list("start_word").alias("starts"), F.collect_list("n_words").alias("lengths"))
    )
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"), text_key().alias("t"), F.col("text").cast("string").alias("text"))
    if spans.count() <= config.broadcast_spans and spans.select(F.sum(F.size("starts"))).first()[0] in range(config.broadcast_spans + 1):
        joined = rows.join(F.broadcast(spans), ["d", "t"], "left")
    else:
        joined = rows.join(spans, ["d", "t"], "left")
    cut = joined.select("row", "text", "starts", "lengths").mapInArrow(cut_words, row_schema(joined, "text string"))
    new = {c: F.col("text") if c == "text" else F.col("row")[c] for c in docs.columns}
    if "n_chars" in new:
        new["n_chars"] = F.when(F.col("text").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType)
    return cut.select(*[x.alias(c) for c, x in new.items()])

"""Exact nearest neighbours by cosine with Fagin's threshold algorithm.

Within a block of vectors each dimension has a list of the vectors sorted by it. A query reads all lists
from its better end at the same pace; vectors met are scored in full, and no unseen one can score more
than the sum of what the lists offer next. A query stops when that bound cannot beat its kth result.

The bound at a depth depends on the lists alone, and no cosine is above 1. So it is known beforehand how
deep a query must read at least; a query that would read as many entries as there are vectors is scored
against all of them at once, in a matrix product with others like it.

Vectors and queries meet in a grid of blocks; what a block finds is merged by query.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textkit import settle
from .vectors import LAST, matrix, vectors


@dataclass(frozen=True)
class TopK:
    k: int = 10
    #: Vectors whose id this divides are the queries; 1 makes a query of every vector.
    every: int = 20
    #: Vectors of one block, about.
    block: int = 32_768
    #: Queries of one matrix product.
    batch: int = 64
    #: Scores are rounded to so many digits, and ties broken by id.
    digits: int = 6


def threshold_search(items: np.ndarray, item_ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, config: TopK) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query place, item place, score) of each query's best k ids by score, then id, without its own id; and items scored.

    Rows of items and queries have unit length.
    """
    n, width = items.shape
    by_id = np.argsort(item_ids, kind="stable")
    items, ids = items[by_id], item_ids[by_id]  # in order of id, so that ties are broken by place
    shared = bool((ids[1:] == ids[:-1]).any())
    order = np.argsort(items, axis=0, kind="stable")  # the lists, rising
    dims, slack = np.arange(width), 0.6 * 10.0**-config.digits
    depths = np.unique(np.minimum(n, max(16, n // 512) * 2 ** np.arange(1 + int(n).bit_length())))
    high, low = (np.stack([items[order[at(d)], dims] for d in depths[:-1]]) if len(depths) > 1 else np.zeros((0, width)) for at in (lambda d: n - 1 - d, lambda d: d))
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    bounds = np.concatenate([up @ high.T + down @ low.T, np.full((len(queries), 1), -np.inf)], axis=1)  # of what lies below each depth
    least = depths[(bounds <= 1 + slack).argmax(axis=1)]
    whole = least * (queries != 0).sum(axis=1) >= n
    seen_total, out = 0, []

    def told(rows, s, i):
        r, c = np.nonzero(i >= 0)
        out.append((rows[r], by_id[i[r, c]], s[r, c]))

    def scored(rows, new, s, i):
        score = np.round(queries[rows] @ (items.T if len(new) == n else items[new].T), config.digits)
        score[ids[new][None, :] == query_ids[rows][:, None]] = -np.inf
        return best(s, i, score, new, ids, config.k, shared)

    empty = lambda m: (np.full((m, config.k), -np.inf), np.full((m, config.k), -1, np.int64))
    full = np.flatnonzero(whole)
    for at in range(0, len(full), config.batch):
        rows = full[at : at + config.batch]
        seen_total += len(rows) * n
        told(rows, *scored(rows, np.arange(n), *empty(len(rows))))
    for q in np.flatnonzero(~whole):
        rows, (s, i), fresh, depth = np.array([q]), empty(1), np.ones(n, bool), 0
        rising, falling = np.flatnonzero(queries[q] > 0), np.flatnonzero(queries[q] < 0)
        for to, bound in zip(depths, bounds[q], strict=True):
            met = np.zeros(n, bool)
            met[order[n - to : n - depth, rising].ravel()] = True
            met[order[depth:to, falling].ravel()] = True
            new = np.flatnonzero(met & fresh)
            fresh[new], depth = False, to
            if len(new):
                seen_total += len(new)
                s, i = scored(rows, new, s, i)
            if bound + slack < s[0, -1]:
                break
        told(rows, s, i)
    return *(np.concatenate(x) if out else np.zeros(0, np.int64) for x in (zip(*out, strict=True) if out else ((), (), ()))), seen_total


def best(kept_s, kept_i, score, new, ids, k, shared=False):
    """The best k ids of those kept and those new, each by its best row, by score from the highest, then by id.

    new is in order of id; where `shared`, several rows may have the same.
    """
    if shared:
        starts = np.flatnonzero(np.concatenate([[True], ids[new][1:] != ids[new][:-1]]))
        top = np.maximum.reduceat(score, starts, axis=1)
        sizes = np.diff(np.concatenate([starts, [len(new)]]))
        at = np.where(score == np.repeat(top, sizes, axis=1), np.arange(len(new)), len(new))
        score, new = top, new[np.minimum.reduceat(at, starts, axis=1)]
    else:
        new = np.broadcast_to(new, score.shape)
    if score.shape[1] > k:  # all above the kth, and those that tie with it in order of id
        kth = -np.partition(-score, k - 1, axis=1)[:, k - 1]
        above = score > kth[:, None]
        tie = score == kth[:, None]
        pick = above | tie & (np.cumsum(tie, axis=1) <= k - above.sum(axis=1, keepdims=True))
        at = np.nonzero(pick)[1].reshape(len(score), k)
        score, new = np.take_along_axis(score, at, 1), np.take_along_axis(new, at, 1)
    s = np.concatenate([kept_s, score], axis=1)
    i = np.concatenate([kept_i, np.where(np.isneginf(score), -1, new)], axis=1)
    name = np.where(i >= 0, ids[i], LAST)
    at = np.lexsort((name, -s), axis=1)
    if shared:  # an id that was kept and is met again counts once
        s, i, name = (np.take_along_axis(x, at, 1) for x in (s, i, name))
        again = ((name[:, :, None] == name[:, None, :]) & (i >= 0)[:, None, :] & np.tri(s.shape[1], k=-1, dtype=bool)).any(axis=2)
        s, i = np.where(again, -np.inf, s), np.where(again, -1, i)
        at = np.argsort(again, axis=1, kind="stable")
    at = at[:, :k]
    return np.take_along_axis(s, at, 1), np.take_along_axis(i, at, 1)


def nearest(table: DataFrame, config: TopK = TopK()) -> DataFrame:
    """(vec_id, rank, neighbor_id, score): the k nearest others by cosine of each vector whose id config.every divides.

    All rows are searched.

    Ranked by the cosine rounded to config.digits, then by id. Fewer than k others give fewer rows.
    Vectors that are null, empty, of length zero or not finite are neither queries nor results, and
    vectors of different dimensions aren't compared. Rows repeated in id and vector are one; of rows that
    share an id only, each counts, as one result of that id by its best score; a row is never a result
    for its own id. Null ids are one id, told as null, and no query unless every vector is one. An empty
    table gives no rows. Other columns are ignored.
    """
    distinct = vectors(table).select(F.size("e").alias("width"), "v", "e").distinct()
    rows = settle(distinct.withColumn("h", F.xxhash64("v", "e")))
    blocks = max(1, -(-rows.count() // config.block))
    queries = rows.filter(F.col("v") % config.every == 0)
    query_blocks = max(1, -(-queries.count() // config.block), min(64, 12 // blocks))
    items = rows.withColumn("ib", F.pmod("h", F.lit(blocks)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))).withColumn("item", F.lit(True))
    asked = queries.withColumn("qb", F.pmod(F.shiftright("h", 20), F.lit(query_blocks)).cast("int")).withColumn("ib", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("item", F.lit(False))
    columns = ["width", "qb", "ib", "item", "v", "e"]
    both = items.select(columns).unionByName(asked.select(columns))

    def search(group: pa.Table) -> pa.Table:
        width = group["width"][0].as_py()
        item = group["item"].to_numpy()
        x, v = matrix(group["e"], width), group["v"].to_numpy()
        if item.all() or not item.any():
            return pa.table({"q": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "s": pa.array([], pa.float64())})
        q, n, s, _ = threshold_search(x[item], v[item], x[~item], v[~item], config)
        return pa.table({"q": v[~item][q], "n": v[item][n], "s": s})

    found = both.groupBy("width", "qb", "ib").applyInArrow(search, "q long, n long, s double")
    one = found.groupBy("q", "n").agg(F.max("s").alias("s"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "n"))
    name = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return one.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= config.k).select(name("q").alias("vec_id"), "rank", name("n").alias("neighbor_id"), F.col("s").alias("score"))

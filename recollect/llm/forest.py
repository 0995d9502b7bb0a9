"""Near-dedup of embeddings with a forest of random projection trees.

Each tree splits the vectors again and again by a random direction at the median, with overlap: vectors
near the border go to both sides. What shares a leaf of any tree is compared in full, pairs above the
threshold are joined, and joined vectors form groups.

A tree whose vectors fit one task is grown there. Above that size the borders of its top come from a
bounded sample; every vector is then sent to its cells in one pass, and the rest is grown cell by cell.
Trees take turns when all of them at once would be much to shuffle. Equal vectors are collapsed first,
and those that a direction can't tell apart are split by hash, so that copies can't crowd a cell or leaf.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import sweeping
from .components import joined
from .textkit import U64, binary, mix, settle
from .vectors import LAST, usable, vectors


@dataclass(frozen=True)
class Forest:
    #: Cosine from which two vectors are near copies.
    threshold: float = 0.95
    trees: int = 12
    leaf: int = 256
    #: Share of a node's vectors on either side of the border that goes to both sides.
    spill: float = 0.05
    #: Vectors that one task takes of a tree, and numbers in them, at most.
    cell: int = 200_000
    cell_values: int = 200_000 * 64
    #: Vectors that the borders of a tree's top are taken from, and numbers in them, at most.
    sample: int = 100_000
    sample_values: int = 8_000_000
    #: Bytes of vectors sent to cells at a time, unless one tree has more.
    round_bytes: int = 512_000_000
    seed: int = 23


def direction(width: int, *key: int) -> np.ndarray:
    x = np.random.default_rng([abs(k) for k in key]).standard_normal(width)
    return x / np.linalg.norm(x)


def apart(n: int, config: Forest) -> int:
    """Of n vectors in order, how many at either end go to one side only."""
    return max(1, int(n * (0.5 - config.spill)))


def leaves(x: np.ndarray, rng: np.random.Generator, config: Forest):
    """Places of the vectors in each leaf of one tree; all nodes of a level have one direction."""
    nodes = [np.arange(len(x))]
    while nodes:
        below, p = [], None
        for at in nodes:
            if len(at) <= config.leaf:
                yield at
                continue
            if p is None:
                p = x @ rng.standard_normal(x.shape[1]).astype(x.dtype)
            cut = apart(len(at), config)
            order = np.argpartition(p[at], [cut, len(at) - cut])
            below += [at[order[: len(at) - cut]], at[order[cut:]]]
        nodes = below


def leaf_edges(x: np.ndarray, config: Forest, key: tuple[int, ...]) -> np.ndarray:
    """Pairs of places that some leaf holds and that reach the threshold, enough to join what belongs together.

    Of a leaf all pairs are compared, in 32 bits with a margin for their error and what passes again in 64; a
    spanning forest of those found is kept, so that a crowd gives no square of edges.
    """
    norm, short = np.empty((len(x), 1)), np.empty(x.shape, np.float32)
    for i in range(0, len(x), 4096):  # no second table in 64 bits
        part = x[i : i + 4096].astype(np.float64)
        norm[i : i + 4096] = np.linalg.norm(part, axis=1, keepdims=True)
        short[i : i + 4096] = part / norm[i : i + 4096]
    floor = np.float32(config.threshold - 1e-6 * (x.shape[1] + 10))
    found = []
    for at in leaves(short, np.random.default_rng([abs(k) for k in key]), config):
        y = short[at]
        likely = y @ y.T >= floor
        if np.count_nonzero(likely) <= len(at):  # each with itself
            continue
        at = at[np.count_nonzero(likely, axis=0) > 1]
        y = x[at] / norm[at]
        near = y @ y.T >= config.threshold - 1e-12
        parent, left = np.full(len(at), -1), np.ones(len(at), bool)
        for first in range(len(at)):
            frontier = [first] if left[first] else []
            left[first] = False
            while frontier:
                k = frontier.pop()
                new = np.flatnonzero(near[k] & left)
                left[new], parent[new] = False, k
                frontier += new.tolist()
        child = np.flatnonzero(parent >= 0)
        found.append(np.sort(np.stack([at[parent[child]], at[child]], 1), 1))
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)


class Top:
    """Borders of a tree's upper levels, so many that a cell below them has about as many vectors as one task takes.

    Vectors are in order of projection, equal projections in order of a hash; so a side always has its
    share, whatever the vectors are. Borders are those of the sample.
    """

    def __init__(self, x: np.ndarray, h: np.ndarray, depth: int, tree: int, config: Forest):
        self.depth, self.tree = depth, tree
        self.directions = np.stack([direction(x.shape[1], config.seed, tree, level) for level in range(depth)], 1)
        self.low, self.high = np.zeros((2, 1 << depth))  # of a node without a sample both are 0
        self.low_tie, self.high_tie = np.zeros((2, 1 << depth), U64)
        p, members = self.project(x), {1: np.arange(len(x))}
        for node in range(1, 1 << depth):
            at = members.pop(node)
            if len(at) > 1:
                q, u, cut = p[at, node.bit_length() - 1], self.ties(h[at], node), apart(len(at), config)
                order = np.lexsort((u, q))
                low, high = order[cut], order[max(cut, len(at) - 1 - cut)]
                self.low[node], self.low_tie[node], self.high[node], self.high_tie[node] = q[low], u[low], q[high], u[high]
                members |= {2 * node: at[order[: len(at) - cut]], 2 * node + 1: at[order[cut:]]}
            else:
                members |= {2 * node: at, 2 * node + 1: at}

    def project(self, x: np.ndarray) -> np.ndarray:
        return np.round(x @ self.directions, 9)  # the last bits vary with the batch

    def ties(self, h: np.ndarray, node: np.ndarray | int) -> np.ndarray:
        return mix(h.view(U64) + mix(np.atleast_1d(node).astype(U64) + U64(self.tree << 40)))

    def cells(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cells that vectors of unit length go to: (cell, place of the vector)."""
        p, node, at = self.project(x), np.ones(len(x), np.int64), np.arange(len(x))
        for level in range(self.depth):
            q, low, high = p[at, level], self.low[node], self.high[node]
            left, right = q < high, q > low
            for side, border in ((left, high), (right, low)):
                tied = np.flatnonzero(q == border)
                u = self.ties(h[at[tied]], node[tied])
                side[tied] = u <= self.high_tie[node[tied]] if side is left else u >= self.low_tie[node[tied]]
            node, at = np.concatenate([2 * node[left], 2 * node[right] + 1]), np.concatenate([at[left], at[right]])
        return node, at


def depth_of(n: int, width: int, config: Forest) -> int:
    """Levels after which a cell of n vectors fits one task."""
    room = max(config.leaf, min(config.cell, config.cell_values // width))
    return max(0, ceil(log(n / room) / -log(0.5 + config.spill))) if n > room else 0


def tops(single: DataFrame, counts: dict[int, int], config: Forest) -> dict[int, list[Top]]:
    """The tops of all trees, for each width of which there are more vectors than one task takes."""
    out = {}
    for width, n in counts.items():
        depth = depth_of(n, width, config)
        if depth:
            most = max(1, min(config.sample, config.sample_values // width))
            drawn = single.filter((F.col("width") == width) & (F.pmod(F.xxhash64(F.lit(config.seed), "v", "h"), F.lit(n)) < most)).select("e", "v", "h").toArrow().sort_by([("h", "ascending"), ("v", "ascending")])
            x, h = unit(numbers(drawn["e"], width)), drawn["h"].to_numpy()
            out[width] = [Top(x, h, depth, tree, config) for tree in range(config.trees)]
    return out


def numbers(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def placed(single: DataFrame, tops: dict[int, list[Top]], trees: range) -> DataFrame:
    """The vectors with their cells in some of the trees: (width, tree, cell, v, h, b), b being a vector's bytes."""

    def place(batches):
        for whole in batches:
            widths = whole.column(0).to_numpy()
            for width in np.unique(widths).tolist():
                rows = np.flatnonzero(widths == width)
                for some in np.array_split(rows, -(-len(rows) * width // 2_000_000)):
                    batch = whole.take(pa.array(some))
                    v, h, x = batch.column(1).to_numpy(), batch.column(2).to_numpy(), numbers(batch.column(3), width)
                    near = unit(x) if width in tops else None
                    for tree in trees:
                        cell, at = tops[width][tree].cells(near, h) if width in tops else (np.ones(len(v), np.int64), np.arange(len(v)))
                        columns = [pa.array(np.full(len(at), width, np.int32)), pa.array(np.full(len(at), tree, np.int32)), pa.array(cell), pa.array(v[at]), pa.array(h[at]), binary(x[at], np.arange(len(at) + 1) * (width * x.itemsize))]
                        yield pa.RecordBatch.from_arrays(columns, names=["width", "tree", "cell", "v", "h", "b"])

    return single.select("width", "v", "h", "e").mapInArrow(place, "width int, tree int, cell long, v long, h long, b binary")


def links_of(single: DataFrame, config: Forest) -> DataFrame:
    """Pairs of different vectors that a leaf of some tree linked: (u, v), structs of v and h."""
    counts = {r["width"]: r["count"] for r in single.groupBy("width").count().collect()}  # as many as there are widths
    kind = np.float32 if single.schema["e"].dataType.simpleString() == "array<float>" else np.float64
    upper = tops(single, counts, config)

    def grow(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        width, tree, cell = (k.as_py() for k in key)
        v, h = group["v"].to_numpy(), group["h"].to_numpy()
        order = np.lexsort((h, v))
        x = np.frombuffer(b"".join(_bytes(c) for c in group["b"].chunks), kind).reshape(-1, width)[order]
        v, h = v[order], h[order]
        edges = leaf_edges(x, config, (config.seed, tree, cell))
        return pa.table({"uv": v[edges[:, 0]], "uh": h[edges[:, 0]], "vv": v[edges[:, 1]], "vh": h[edges[:, 1]]})

    size = sum(n * (1 + 2 * config.spill) ** depth_of(n, width, config) * (width * np.dtype(kind).itemsize + 48) for width, n in counts.items())
    step = min(config.trees, max(1, int(config.round_bytes // max(1, size))))
    found = None
    for first in range(0, config.trees, step):
        sent = placed(single, upper, range(first, min(first + step, config.trees)))
        edges = settle(sent.groupBy("width", "tree", "cell").applyInArrow(grow, "uv long, uh long, vv long, vh long"))
        found = edges if found is None else found.unionByName(edges)
    return found.select(F.struct(F.col("uv").alias("v"), F.col("uh").alias("h")).alias("u"), F.struct(F.col("vv").alias("v"), F.col("vh").alias("h")).alias("v"))


def _bytes(column: pa.Array) -> memoryview:
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return memoryview(column.buffers()[2])[offsets[0] : offsets[-1]] if len(column) else memoryview(b"")


def near_duplicates(table: DataFrame, config: Forest = Forest()) -> DataFrame:
    """Groups of near copies: (vec_id, group_id, group_size, n_links, keep), one row for each distinct vec_id and vector.

    group_id is the vec_id of the group's kept vector: the least id, nulls last. Groups are joined
    pairwise, so a chain of near copies is one group. n_links counts the different vectors its own was
    linked to; a leaf links what it holds by a spanning forest of pairs that match, so these aren't all
    such pairs. Vectors that are null, empty, of length zero or not finite are groups of their own and
    kept; vectors of different dimensions never match. Rows repeated in vec_id and vector are one; of
    rows with one vec_id but different vectors each has its row. An empty table gives an empty result;
    other columns are ignored.
    """
    raw = table.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(LAST)).alias("v"), F.col("embedding").cast("array<double>").alias("e"))
    with sweeping(table.sparkSession):
        told = vectors(table).withColumn("h", F.xxhash64("e"))
        single = settle(told.groupBy("h", "e").agg(F.min("v").alias("v")).select(F.size("e").alias("width"), "v", "h", "e"))
        # Rows find their vector by its hash; should two vectors share one, by the vector as well.
        key = ["h", "e"] if single.groupBy("h").count().filter("count > 1").limit(1).count() else ["h"]
        rows = settle(told.select("v", *key).distinct())
        roots, links = joined(links_of(single, config))
        node = F.struct("v", "h")
        grouped = single.select(*key, node.alias("node")).join(roots.join(links, "node"), "node", "left").select(*key, F.coalesce("root", "node").alias("root"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
        grouped = settle(grouped.join(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")), key))
        grouped = settle(grouped.join(grouped.groupBy("root").agg(F.sum("n").alias("size")), "root"))
    told = rows.join(grouped, key).select("v", F.col("root.v").alias("g"), "size", "n_links", ((F.col("v") == F.col("root.v")) & (F.col("h") == F.col("root.h"))).alias("keep"))
    others = raw.filter(~F.coalesce(usable(F.col("e")), F.lit(False))).distinct()
    told = told.unionByName(others.select("v", F.col("v").alias("g"), F.lit(1).cast("long").alias("size"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("keep")))
    name = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return told.select(name("v").alias("vec_id"), name("g").alias("group_id"), F.col("size").alias("group_size"), "n_links", "keep")

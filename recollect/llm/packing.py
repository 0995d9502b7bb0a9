"""Best-fit packing of documents into windows of a fixed number of words.

A text longer than a window is cut into full windows and a rest. What is to be packed is then counted by
length, and the plan is made on these counts: at most `window` numbers, however large the corpus. An
index tells for every sum which single length, pair or triple of lengths makes it. Each step opens
windows with the longest length left and looks up what fills the gap exactly. The same pattern is used as
often as the counts allow, so every step uses up a length. A gap that no sum fills gets the longest
length that fits, and its rest is looked up again.

The rows then find their places without meeting the plan's maker: each is numbered within its length,
in groups of a bounded size, and the plan says which numbers of a length go to which windows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textkit import longs, settle, text_key


@dataclass(frozen=True)
class Packing:
    #: Words that a window holds.
    window: int = 2048
    #: Pieces of one length that a task numbers, about.
    group: int = 500_000


class Complements:
    """Index of the sums of one, two and three of the lengths left.

    two[s] and three[s] are the longest part of the pair and the triple that make s, 0 where none does.
    Counts only fall, so where an entry's parts are used up the next one lies below it: entries are mended
    when they are looked up, and each moves down once through all lengths at most. `held` are pieces that
    a pattern has while it grows; they are not to be had, but may come back, so they mend nothing.
    """

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64).copy()
        self.lengths = [int(x) for x in np.flatnonzero(self.left)[::-1]]  # from the longest
        self.held: dict[int, int] = {}
        size = len(self.left)
        self.two, self.three = np.zeros(size, np.int64), np.zeros(size, np.int64)
        rising = np.array(self.lengths[::-1], np.int64)
        for k, a in enumerate(rising):
            others = rising[: k + (self.left[a] > 1)]
            self.two[a + others[others < size - a]] = a
            pairs = np.flatnonzero(self.two[: size - a])  # so far of parts up to a
            self.three[a + pairs] = a

    def hold(self, x: int, times: int = 1) -> None:
        self.held[x] = self.held.get(x, 0) + times

    def use(self, items: tuple[int, ...], times: int) -> None:
        for x in items:
            self.left[x] -= times
            if self.left[x] == 0:
                self.lengths.remove(x)

    def free(self, x: int) -> int:
        return int(self.left[x]) - self.held.get(x, 0)

    def single(self, gap: int) -> tuple[int, ...]:
        return (gap,) if 0 < gap < len(self.left) and self.free(gap) > 0 else ()

    def _pair(self, gap: int, most: int, own: np.ndarray) -> tuple[int, ...]:
        """The pair of pieces in `own` with sum `gap` whose longer part is longest, of at most `most`."""
        low, high = (gap + 1) // 2, min(gap - 1, most, len(own) - 1)
        if low > high:
            return ()
        a = np.arange(high, low - 1, -1)
        fits = (own[a] > 0) & (own[gap - a] > 0)
        if gap % 2 == 0 and low == gap // 2:
            fits[-1] = own[low] > 1
        i = int(fits.argmax())
        return (int(a[i]), gap - int(a[i])) if fits[i] else ()

    def _triple(self, gap: int, most: int, own: np.ndarray) -> tuple[int, ...]:
        for a in self.lengths:
            if a > min(most, gap - 2) or own[a] <= 0:
                continue
            if 3 * a < gap:
                break
            own[a] -= 1
            found = self._pair(gap - a, a, own)
            own[a] += 1
            if found:
                return (a, *found)
        return ()

    def _looked_up(self, index: np.ndarray, search, gap: int) -> tuple[int, ...]:
        if not 0 < gap < len(index) or not index[gap]:
            return ()
        found = search(gap, int(index[gap]), self.left)
        index[gap] = found[0] if found else 0
        if all(self.free(x) >= found.count(x) for x in found):
            return found
        own = self.left.copy()
        for x, n in self.held.items():
            own[x] -= n
        return search(gap, int(index[gap]), own)

    def pair(self, gap: int) -> tuple[int, ...]:
        """The pair with sum `gap` whose longer part is longest."""
        return self._looked_up(self.two, self._pair, gap)

    def triple(self, gap: int) -> tuple[int, ...]:
        """The triple with sum `gap` whose longest part is longest, then its second."""
        return self._looked_up(self.three, self._triple, gap)

    def exact(self, gap: int) -> tuple[int, ...]:
        return self.single(gap) or self.pair(gap) or self.triple(gap)

    def longest(self, gap: int) -> int:
        return next((x for x in self.lengths if x <= gap and self.free(x) > 0), 0)


def plan(counts: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how many windows have each, from the number of pieces of each length."""
    index, out = Complements(counts), []
    while index.lengths:
        items, gap = (), window
        while gap:
            found = index.exact(gap) if items else (min(index.lengths[0], window),)
            found = found or ((index.longest(gap),) if index.longest(gap) else ())
            if not found:
                break
            for x in found:
                index.hold(x)
            items, gap = items + found, gap - sum(found)
        index.held.clear()
        times = int(min(index.left[x] // items.count(x) for x in set(items)))
        index.use(items, times)
        out.append((items, times))
    return out


def slots(patterns: list[tuple[tuple[int, ...], int]], counts: np.ndarray) -> dict[str, np.ndarray]:
    """For each run of pieces of a length: its first overall number, window and slot; sorted by number."""
    base = np.concatenate([[0], np.cumsum(counts)])[:-1]  # number of the first piece of each length
    used, rows, at = np.zeros(len(counts), np.int64), [], 0
    for items, times in patterns:
        begin = 0
        for slot, x in enumerate(items):
            rows.append((base[x] + used[x], at, slot, begin))
            used[x] += times
            begin += x
        at += times
    found = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"first": found[:, 0], "bin": found[:, 1], "slot": found[:, 2], "begin": found[:, 3], "base": base}


def pieces(docs: DataFrame, config: Packing) -> DataFrame:
    """(doc_id, h, piece, start_word, n): the windows and the rest of each text; without words, one of n = 0."""
    words = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(r"\S+")), F.lit(0))
    sized = settle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("h"), words.alias("words")))
    last = F.greatest(F.ceil(F.col("words") / config.window).cast("int") - 1, F.lit(0))
    start = (F.col("piece") * config.window).cast("long")
    return sized.withColumn("piece", F.explode(F.sequence(F.lit(0), last))).select("doc_id", "h", "piece", start.alias("start_word"), F.least(F.col("words") - start, F.lit(config.window)).cast("int").alias("n"))


def packed(docs: DataFrame, config: Packing = Packing()) -> DataFrame:
    """(doc_id, piece, start_word, n_words, bin_id, slot, bin_offset): where each piece of each text goes.

    Words start_word .. start_word + n_words - 1 of the text lie in window bin_id from its word
    bin_offset on, as item number `slot`. Every word of every row is packed once, repeated rows each on
    their own; no window holds more than config.window words. A text without words (null, empty, blank)
    has one row with n_words 0 and null bin_id, slot and bin_offset. Among pieces of one length, order
    is by doc_id within hashed groups, so the result depends on the rows alone. Texts of any length are
    packed whole. An empty table gives no rows; columns but doc_id and text are ignored.
    """
    all_pieces = pieces(docs, config)
    counts = np.zeros(config.window + 1, np.int64)
    for row in all_pieces.filter("n > 0").groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect():  # a row a length at most
        counts[row["n"]] = row["c"]
    many = {n: -(-int(c) // config.group) for n, c in enumerate(counts) if c > config.group}
    groups = F.expr(f"coalesce(element_at(map({', '.join(f'{n}, {g}' for n, g in many.items())}), n), 1)") if many else F.lit(1)
    some = all_pieces.filter("n > 0").withColumn("g", F.pmod(F.xxhash64("doc_id", "h", "piece"), groups).cast("long"))
    per_group = settle(some.groupBy("n", "g").agg(F.count(F.lit(1)).alias("c")))
    at = slots(plan(counts, config.window), counts)
    before = F.coalesce(F.sum("c").over(Window.partitionBy("n").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = per_group.select("n", "g", before.alias("before"))
    within = F.row_number().over(Window.partitionBy("n", "g").orderBy(F.col("doc_id").asc_nulls_last(), "h", "piece"))
    ranked = some.withColumn("r", within).join(offsets, ["n", "g"]).select("doc_id", "piece", "start_word", "n", (F.col("before") + F.col("r") - 1).alias("rank"))

    def place(batches):
        for batch in batches:
            n = longs(batch, "n")
            number = at["base"][n] + longs(batch, "rank")
            i = np.searchsorted(at["first"], number, "right") - 1
            placed = [at["bin"][i] + number - at["first"][i], at["slot"][i].astype(np.int32), at["begin"][i]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *map(pa.array, placed)], names=["doc_id", "piece", "start_word", "n_words", "bin_id", "slot", "bin_offset"])

    schema = "doc_id long, piece int, start_word long, n_words int, bin_id long, slot int, bin_offset long"
    none = all_pieces.filter("n = 0").select("doc_id", "piece", "start_word", F.col("n").alias("n_words"), F.lit(None).cast("long").alias("bin_id"), F.lit(None).cast("int").alias("slot"), F.lit(None).cast("long").alias("bin_offset"))
    return ranked.mapInArrow(place, schema).unionByName(none)

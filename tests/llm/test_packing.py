import numpy as np
import pytest

from recollect.llm import packing
from recollect.llm.packing import Complements, Packing, plan


def one_at_a_time(counts, window):
    """The same rule, a window at a time, by plain search."""
    left, out = {i: int(c) for i, c in enumerate(counts) if c}, []

    def lengths(own):
        return [x for x in sorted(own, reverse=True) if own[x] > 0]

    def exact(own, gap):
        ls = lengths(own)
        for a in ls:
            if a == gap:
                return (a,)
        for a in ls:
            for b in ls:
                if b <= a and a + b == gap and own[a] >= 1 + (a == b):
                    return (a, b)
        for a in ls:
            for b in ls:
                for c in ls:
                    if a >= b >= c and a + b + c == gap and all(own[x] >= (a, b, c).count(x) for x in (a, b, c)):
                        return (a, b, c)
        return ()

    while lengths(left):
        own, items = dict(left), (lengths(left)[0],)
        own[items[0]] -= 1
        while gap := window - sum(items):
            found = exact(own, gap) or tuple([x for x in lengths(own) if x <= gap][:1])
            if not found:
                break
            items += found
            for x in found:
                own[x] -= 1
        for x in items:
            left[x] -= 1
        out.append(items)
    return sorted(out)


@pytest.mark.parametrize("seed", range(12))
def test_plan_equals_packing_one_window_at_a_time(seed):
    rng = np.random.default_rng(seed)
    window = int(rng.integers(8, 40))
    counts = np.bincount(rng.integers(1, window + 1, int(rng.integers(1, 120))), minlength=window + 1)
    got = sorted(items for items, n in plan(counts, window) for _ in range(n))
    assert got == one_at_a_time(counts, window)


def test_index_equals_search():
    """Looked up while counts fall and pieces are held: what a search through all that is left finds."""
    rng = np.random.default_rng(5)
    for _ in range(30):
        index = Complements(np.bincount(rng.integers(1, 30, 40), minlength=61))
        while index.lengths:
            index.held = {int(x): 1 for x in rng.choice(index.lengths, min(2, len(index.lengths)), replace=False)}
            own = index.left.copy()
            for x in index.held:
                own[x] -= 1
            for gap in range(1, 61):
                assert index.pair(gap) == index._pair(gap, gap, own) and index.triple(gap) == index._triple(gap, gap, own), gap
            index.held = {}
            index.use((int(rng.choice(index.lengths)),), 1)


@pytest.mark.parametrize("shape", ["one length", "two lengths", "long"])
def test_skewed_lengths(shape):
    rng = np.random.default_rng(1)
    lengths = {"one length": np.full(500_000, 700), "two lengths": rng.choice([1, 2048], 300_000), "long": np.append(np.full(10**6, 2048), rng.integers(1, 2049, 3000))}[shape]
    counts = np.bincount(lengths, minlength=2049)
    patterns = plan(counts, 2048)
    packed = np.zeros(2049, np.int64)
    for items, times in patterns:
        assert sum(items) <= 2048
        np.add.at(packed, list(items), times)
    assert (packed == counts).all() and len(patterns) < 3000


def test_exact_complements_respect_counts():
    index = Complements(np.bincount([3, 3, 5], minlength=12))
    assert index.single(5) == (5,) and index.pair(6) == (3, 3) and index.pair(10) == () and index.triple(11) == (5, 3, 3) and index.triple(9) == ()


def test_large_plan_is_near_the_bound():
    lengths = np.minimum(np.random.default_rng(0).lognormal(5.5, 1.1, 200_000).astype(int) + 1, 2048)
    patterns = plan(np.bincount(lengths, minlength=2049), 2048)
    assert len(patterns) < 2 * 2048 and sum(n for _, n in patterns) <= 1.001 * lengths.sum() / 2048 + 1


def test_table(table):
    rows = [(i, " ".join(["w"] * n)) for i, n in enumerate([5, 10, 3, 7, 23, 10, 1, 4])] + [(None, "a b"), (100, None), (101, ""), (102, " \n"), (0, "w w w w w")]
    got = [r.asDict() for r in packing.packed(table(rows), Packing(window=10)).collect()]
    placed = [r for r in got if r["bin_id"] is not None]
    assert sorted(r["doc_id"] for r in got if r["bin_id"] is None) == [100, 101, 102] and all(r["n_words"] == 0 for r in got if r["bin_id"] is None)
    assert sum(r["n_words"] for r in placed) == 5 + 10 + 3 + 7 + 23 + 10 + 1 + 4 + 2 + 5
    assert sorted((r["piece"], r["start_word"], r["n_words"]) for r in placed if r["doc_id"] == 4) == [(0, 0, 10), (1, 10, 10), (2, 20, 3)]
    assert len([r for r in placed if r["doc_id"] == 0]) == 2
    bins = {}
    for r in placed:
        bins.setdefault(r["bin_id"], []).append((r["slot"], r["bin_offset"], r["n_words"]))
    assert sorted(bins) == list(range(len(bins))) and len(bins) == 7
    for items in bins.values():  # side by side from the start, and no more than fits
        at = 0
        for slot, (own, offset, n) in enumerate(sorted(items)):
            assert own == slot and offset == at
            at += n
        assert at <= 10
    assert packing.packed(table([])).count() == 0


def test_numbers_are_those_of_all_groups(table):
    """The same windows, each word once, whatever the size of a group; and a long text."""
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 13))) for i in range(60)] + [(100, "w " * 50_000)]
    for group in (1, 7, 500_000):
        got = packing.packed(table(rows), Packing(16, group)).collect()
        places = {(r["bin_id"], r["slot"]) for r in got}
        assert len(places) == len(got) and sum(r["n_words"] for r in got) == 50_000 + sum(1 + i * 7 % 13 for i in range(60))
        assert len({b for b, _ in places}) == max(b for b, _ in places) + 1 <= 3125 + 27


def test_result_depends_on_rows_alone(table):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 13))) for i in range(60)]
    one = sorted(map(tuple, packing.packed(table(rows), Packing(16)).collect()))
    assert one == sorted(map(tuple, packing.packed(table(rows[::-1]).repartition(3), Packing(16)).collect()))

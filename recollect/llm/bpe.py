"""Byte-level BPE encoding by speculation and verification, and decoding.

Text is cut into words by the vocabulary's pattern. For all words not met before, at once:

* propose: a vectorised walk of the vocabulary's trie takes the longest token at each place;
* verify: a sequence of tokens is the encoding exactly if every token encodes as itself and every two
  neighbours would stay apart, so each distinct pair of neighbours is tested by undoing the merges on
  both sides of the border, latest first, and looking for one that would have crossed it earlier;
* only words with a failing token or pair are merged by rank, one by one.
"""

from __future__ import annotations

import base64
import heapq
from dataclasses import dataclass, field
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import int_lists, slices

#: Words as the public byte-level vocabularies cut them.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: No token.
NONE = 1 << 40
#: Bytes from which a word is proposed and merged on its own, not side by side with others.
LONG = 64
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The encoding by its definition: of all neighbours whose union is a token, merge the lowest, again and again."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        best, at = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if best == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def merged_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for long words, with a heap of mergeable neighbours: n log n."""
    n = len(word)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    gone = bytearray(n + 1)
    while heap:
        _, i, j, stop = heapq.heappop(heap)
        if gone[i] or j >= n or gone[j] or after[i] != j or end[j] != stop:
            continue
        gone[j], end[i], after[i] = 1, stop, after[j]
        if after[j] < n:
            before[after[j]] = i
        for a in (before[i], i):
            b = after[a] if a >= 0 else n
            if a >= 0 and b < n and (r := ranks.get(word[a : end[b]])) is not None:
                heapq.heappush(heap, (r, a, b, end[b]))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = after[i]
    return out


@dataclass
class Vocabulary:
    """Tokens with their ranks as ids, and the tables that proposing and verifying need."""

    tokens: list[bytes]
    ranks: dict[bytes, int] = field(init=False)

    def __post_init__(self):
        n = len(self.tokens)
        self.ranks = {t: i for i, t in enumerate(self.tokens)}
        if any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        self.left, self.right, self.sound = np.arange(n), np.arange(n), np.ones(n, bool)
        crossing: dict[tuple[int, int], int] = {}
        for i, token in enumerate(self.tokens):
            if len(token) == 1:
                continue
            splits = [(self.ranks[token[:k]], self.ranks[token[k:]]) for k in range(1, len(token)) if token[:k] in self.ranks and token[k:] in self.ranks]
            crossing |= dict.fromkeys(splits, i)
            halves = merged_before(token, self.ranks, i)
            if len(halves) == 2:
                self.left[i], self.right[i] = halves
            else:
                self.sound[i] = False
        keys = np.array([a * n + b for a, b in crossing], np.int64)
        order = np.argsort(keys)
        self.cross_keys, self.cross_ids = keys[order], np.array(list(crossing.values()), np.int64)[order]
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        nodes: dict[bytes, int] = {b"": 0}
        for token in self.tokens:
            for k in range(1, len(token) + 1):
                nodes.setdefault(token[:k], len(nodes))
        self.node_token = np.full(len(nodes), -1, np.int32)
        for token, i in self.ranks.items():
            self.node_token[nodes[token]] = i
        edges = np.array([(nodes[p[:-1]] << 8) | p[-1] for p in nodes if p], np.int64)
        targets = np.array([i for p, i in nodes.items() if p], np.int32)
        self.slots = 1 << int(len(edges) * 3).bit_length()
        self.edge_keys, self.edge_to = np.full(self.slots, -1, np.int64), np.full(self.slots, -1, np.int32)
        left = np.arange(len(edges))
        at = self._slot(edges)
        while len(left):  # open addressing, all edges at once: the first at a free slot takes it
            free = self.edge_keys[at[left]] < 0
            taken, who = np.unique(at[left[free]], return_index=True)
            winners = left[free][who]
            self.edge_keys[taken], self.edge_to[taken] = edges[winners], targets[winners]
            left = left[self.edge_keys[at[left]] != edges[left]]
            at[left] = (at[left] + 1) & (self.slots - 1)
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.first = np.concatenate([[0], np.cumsum(self.lengths)])
        self.edges: dict[int, tuple[int, int]] | None = None  # the trie again, for long words, made when there is one

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) & (self.slots - 1)

    def child(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        key = (node.astype(np.int64) << 8) | byte
        at = self._slot(key)
        out = np.full(len(key), -1, np.int32)
        left = np.arange(len(key))
        while len(left):
            have = self.edge_keys[at[left]]
            hit = have == key[left]
            out[left[hit]] = self.edge_to[at[left[hit]]]
            left = left[(have >= 0) & ~hit]
            at[left] = (at[left] + 1) & (self.slots - 1)
        return out

    def longest(self, data: bytes) -> list[int]:
        """Longest tokens from left to right of one long word."""
        if self.edges is None:
            some = np.flatnonzero(self.edge_keys >= 0)
            self.edges = dict(zip(self.edge_keys[some].tolist(), zip(self.edge_to[some].tolist(), self.node_token[self.edge_to[some]].tolist(), strict=True), strict=True))
        out, at, edges = [], 0, self.edges
        while at < len(data):
            node, i, best, end = 0, at, -1, at
            while i < len(data) and (step := edges.get((node << 8) | data[i])):
                node, token = step
                i += 1
                if token >= 0:
                    best, end = token, i
            out.append(best)
            at = end
        return out

    def propose(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest tokens from left to right of each buf[s:e]: (word of each token, token), in order."""
        long = np.flatnonzero(ends - starts > LONG)
        found = [(np.full(len(t), i), t) for i in long for t in [np.array(self.longest(buf[starts[i] : ends[i]].tobytes()), np.int32)]]
        words = np.flatnonzero(ends - starts <= LONG)
        at = starts[words]
        while len(words):
            node, best, length = np.zeros(len(words), np.int32), np.full(len(words), -1, np.int32), np.zeros(len(words), np.int64)
            alive, depth = np.arange(len(words)), 0
            while len(alive):
                alive = alive[at[alive] + depth < ends[words[alive]]]
                to = self.child(node[alive], buf[at[alive] + depth])
                alive, to = alive[to >= 0], to[to >= 0]
                depth += 1
                node[alive] = to
                token = self.node_token[to]
                ok = token >= 0
                best[alive[ok]], length[alive[ok]] = token[ok], depth
            found.append((words, best))
            at = at + length
            more = at < ends[words]
            words, at = words[more], at[more]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        word, token = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(word, kind="stable")
        return word[order], token[order]

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the tokens a, b stay two tokens when their bytes are encoded together."""
        n = len(self.tokens)
        a, b = a.astype(np.int64).copy(), b.astype(np.int64).copy()
        ok, limit = np.ones(len(a), bool), np.full(len(a), n, np.int64)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            key = x * n + y
            i = np.minimum(np.searchsorted(self.cross_keys, key), len(self.cross_keys) - 1)
            crossed = (self.cross_keys[i] == key) & (self.cross_ids[i] < limit[live])
            ok[live[crossed]] = False
            live, x, y = live[~crossed], x[~crossed], y[~crossed]
            last_x, last_y = self.left[x] == x, self.left[y] == y  # single bytes can't be undone
            undo_x = np.where(last_x, False, last_y | (x > y))
            undo_y = ~undo_x & ~last_y
            limit[live] = np.where(undo_x, x, np.where(undo_y, y + 1, 0))
            a[live[undo_x]], b[live[undo_y]] = self.right[x[undo_x]], self.left[y[undo_y]]
            live = live[undo_x | undo_y]
        return ok

    def union(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token of the bytes of a and b together, NONE where there is none."""
        key = a * len(self.tokens) + b
        i = np.minimum(np.searchsorted(self.cross_keys, key), len(self.cross_keys) - 1)
        return np.where(self.cross_keys[i] == key, self.cross_ids[i], NONE)

    def merge_words(self, data: list[bytes]) -> list[np.ndarray]:
        """Exact merging of many words side by side: in each round every word does its lowest merge."""
        out = [None] * len(data)
        short = []
        for i, x in enumerate(data):
            if len(x) > LONG:
                out[i] = np.array(merged_long(x, self.ranks), np.int64)
            else:
                short.append(i)
        ids = np.array(short, np.int64)
        sizes = np.array([len(data[i]) for i in short], np.int64)
        token = self.byte_ids[np.frombuffer(b"".join(data[i] for i in short), np.uint8)]
        word = np.repeat(np.arange(len(ids)), sizes)
        inner = np.append(word[1:] == word[:-1], False) if len(word) else np.zeros(0, bool)
        rank = np.full(len(token), NONE)
        at = np.flatnonzero(inner)
        rank[at] = self.union(token[at], token[at + 1])
        while len(token):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            size = np.diff(np.append(first, len(word)))
            best = np.minimum.reduceat(rank, first)
            for k in np.flatnonzero(best == NONE):
                out[ids[word[first[k]]]] = token[first[k] : first[k] + size[k]]
            live = np.repeat(best != NONE, size)
            best = np.repeat(best, size)[live]
            token, word, rank = token[live], word[live], rank[live]
            at = np.flatnonzero(rank == best)
            at = at[np.concatenate([[True], word[at][1:] != word[at][:-1]])] if len(at) else at
            token[at] = rank[at]
            keep = np.ones(len(token), bool)
            keep[at + 1] = False
            token, word, rank = token[keep], word[keep], rank[keep]
            at = at - np.arange(len(at))  # one part fewer for each merge further left
            for i in (at, at[at > 0] - 1):
                j = np.minimum(i + 1, len(token) - 1)
                rank[i] = np.where((j > i) & (word[j] == word[i]), self.union(token[i], token[j]), NONE)
        return out

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
        """Tokens of the words one after the other, where each word begins, and how many had to be merged."""
        data = [w.encode() for w in words]
        ends = np.cumsum([len(x) for x in data], dtype=np.int64)
        buf = np.frombuffer(b"".join(data), np.uint8)
        word, token = self.propose(buf, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends)
        bad = ~self.sound[token]
        inner = np.flatnonzero(word[1:] == word[:-1])
        pairs, which = np.unique(token[inner].astype(np.int64) * len(self.tokens) + token[inner + 1], return_inverse=True)
        bad[inner[~self.apart(pairs // len(self.tokens), pairs % len(self.tokens))[which]]] = True
        failing = np.unique(word[bad])
        if len(failing):
            exact = self.merge_words([data[i] for i in failing])
            keep = ~np.isin(word, failing)
            word = np.concatenate([word[keep], np.repeat(failing, [len(x) for x in exact])])
            token = np.concatenate([token[keep], np.concatenate(exact).astype(np.int32)])
            order = np.argsort(word, kind="stable")
            word, token = word[order], token[order]
        return token, np.searchsorted(word, np.arange(len(words) + 1)), len(failing)

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all tokens one after the other."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        return self.bytes[np.repeat(self.first[:-1][ids] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]


def merged_before(token: bytes, ranks: dict[bytes, int], limit: int) -> list[int]:
    """The encoding of a token's bytes by merges of lower rank only: two halves, if the token can arise."""
    return merged(token, _Below(ranks, limit))


class _Below:
    def __init__(self, ranks, limit):
        self.ranks, self.limit = ranks, limit

    def get(self, key, default):
        rank = self.ranks.get(key, default)
        return rank if rank < self.limit else default

    def __getitem__(self, key):
        return self.ranks[key]


@lru_cache(maxsize=4)
def load(path: str = VOCABULARY) -> Vocabulary:
    """A vocabulary of lines `base64 rank`; ranks must be 0, 1, 2, ..."""
    pairs = sorted((int(b), base64.b64decode(a)) for a, b in (x.split() for x in Path(path).read_bytes().splitlines() if x.strip()))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError(f"ranks in {path} aren't 0, 1, 2, ...")
    return Vocabulary([t for _, t in pairs])


class Encoder:
    """Encodes texts with a memory of words; one for each Python worker and vocabulary."""

    MOST = 300_000

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.find = vocabulary, regex.compile(PATTERN).findall
        self.merged_words = 0
        self._forget()

    def _forget(self):
        self.known: dict[str, int] = {}
        self.tokens, self.begin = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all texts one after the other, and where each text begins."""
        words: list[str] = []
        counts = [0]
        for text in texts:
            words += self.find(text)
            counts.append(len(words))
        new = list(dict.fromkeys(words).keys() - self.known.keys())
        if len(self.known) + len(new) > self.MOST and self.known:
            self._forget()
            new = list(dict.fromkeys(words))
        if new:
            tokens, begin, n = self.vocabulary.encode_words(new)
            self.merged_words += n
            self.known |= zip(new, range(len(self.known), len(self.known) + len(new)), strict=True)
            self.begin = np.concatenate([self.begin, begin[1:] + len(self.tokens)])
            self.tokens = np.concatenate([self.tokens, tokens])
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        lengths = self.begin[at + 1] - self.begin[at]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.tokens[np.repeat(self.begin[at] - ends[:-1], lengths) + np.arange(ends[-1])]
        return ids, ends[counts]


_encoders: dict[str, Encoder] = {}


def encoder(shared, path: str) -> Encoder:
    """This worker's encoder for a broadcast vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(shared.value)
    return _encoders[path]


def encode(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens, n_tokens, round_trip), one row for each row of docs.

    round_trip: decoding the tokens gives the text again. A null text has nulls, an empty one no tokens.
    Texts are encoded whole, also those that are one long word; repeated rows stay, each on its own; an
    empty table gives an empty one. Control strings in a text are ordinary text here. Further columns are ignored. The vocabulary, whose
    size doesn't depend on the corpus, is read once and broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(path))

    def run(batches):
        own = encoder(shared, path)
        for batch in batches:
            for rows, buf, offsets in slices(batch, "text", 1_500_000):
                column = rows.column(1)
                ids, begin = own(["" if x is None else x for x in column.to_pylist()])
                back = own.vocabulary.decode_bytes(ids)
                ends = np.concatenate([[0], np.cumsum(own.vocabulary.lengths[ids])])[begin]
                differs = np.zeros(len(buf) + 1, np.int64)
                if len(back) == len(buf):
                    np.cumsum(back != buf, out=differs[1:])
                    same = (ends == offsets)[1:] & (ends == offsets)[:-1] & (np.diff(differs[offsets]) == 0)
                else:
                    same = np.array([np.array_equal(back[a:b], buf[c:d]) for a, b, c, d in zip(ends, ends[1:], offsets, offsets[1:], strict=False)])
                none = ~column.is_valid().to_numpy(zero_copy_only=False)
                tokens = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(ids, pa.int32()), mask=pa.array(none)) if none.any() else int_lists(ids, begin, pa.int32())
                yield pa.RecordBatch.from_arrays([rows.column(0), tokens, pa.array(np.diff(begin), pa.int32(), mask=none), pa.array(same, pa.bool_(), mask=none)], names=["doc_id", "tokens", "n_tokens", "round_trip"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, tokens array<int>, n_tokens int, round_trip boolean")


def decode(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of rows (doc_id, tokens). Null tokens give a null text, bytes that aren't UTF-8 U+FFFD.

    An id that the vocabulary lacks, or a null one within a list, is an error.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(load(path))

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            ids = column.flatten().to_numpy(zero_copy_only=False)
            lengths = np.array([0 if x is None else x for x in column.value_lengths().to_pylist()], np.int64)
            data = shared.value.decode_bytes(ids)
            ends = np.concatenate([[0], np.cumsum(shared.value.lengths[ids])])[np.concatenate([[0], np.cumsum(lengths)])]
            texts = [data[a:b].tobytes().decode("utf-8", "replace") if v else None for a, b, v in zip(ends, ends[1:], column.is_valid().to_pylist(), strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("tokens").cast("array<int>").alias("tokens")).mapInArrow(run, "doc_id long, text string")

"""Main text of web pages by a recurrent labeller of blocks.

A page is cut into blocks: the text between two tags that break lines. Each block is read as a vector of
its whole tag path, near tags counting more, a vector of its hashed words and a few numbers. A bidirectional LSTM, in numpy, goes over
all blocks of the page, so that each is classified in the light of the whole document.

The labeller is trained here, on a bounded sample of pages that tell by semantic tags where their main
text is. In most training pages these tags are hidden from it, so that it learns from the rest: position,
words, lengths and neighbours.
"""

from __future__ import annotations

import re
import warnings
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, fields
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import FOLDED_HASH, NOT_ALNUM, U64, Words, int_lists, mix

INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that end where one of the same kind begins.
LOOSE = frozenset("p li dt dd tr td th option".split())
#: What goes to its end tag or to the end of the page; a tag that closes itself holds nothing.
SKIPPED = re.compile(r"<!--.*?(?:-->|\Z)|<(?:script|style)(?=[\s/>])[^>]*/>|<(script|style)\b.*?(?:</\1\s*>|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)", re.S | re.I)
#: What is left out only where it has an end tag.
HIDDEN = frozenset("noscript template svg".split())
#: Tags that can stand in the head; it ends at any other, and at text that isn't the title's.
IN_HEAD = frozenset("html head title meta link base script style noscript template".split())
TITLE_END = re.compile(r"</title\s*>", re.I)
OPEN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9-]*+)")
ATTRIBUTES = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
NAME = re.compile(r"\b(?:class|id|role)\s*+=\s*+[\"']?([\w -]+)", re.I)
BLANKS = re.compile(r"\s+")
MAIN, ASIDE = frozenset(("article", "main")), frozenset(("nav", "aside", "footer", "header", "form", ".ad", ".ads", ".nav", ".footer", ".sidebar"))
#: How much less a tag counts than the one that it holds.
DECAY = 0.6


class Node:
    """A tag or class name on a path, with the one that holds it; iterates from the outermost."""

    __slots__ = ("above", "aside", "main", "tag")

    def __init__(self, above: Node | None, tag: str):
        self.above, self.tag = above, tag
        self.main = tag in MAIN or above is not None and above.main
        self.aside = tag in ASIDE or above is not None and above.aside

    def __iter__(self) -> Iterator[str]:
        out, node = [], self
        while node is not None:
            out.append(node.tag)
            node = node.above
        return reversed(out)


def chain(tags: Iterable[str]) -> Node | None:
    node = None
    for tag in tags:
        node = Node(node, tag)
    return node


@dataclass(frozen=True)
class Labeller:
    #: Pages used for training, at most: the least by hash of page_id.
    sample: int = 400
    path_size: int = 48
    word_size: int = 32
    hidden: int = 16
    epochs: int = 12
    rate: float = 0.01
    #: Share of training pages whose telling tags are hidden.
    hide: float = 0.7
    threshold: float = 0.5
    seed: int = 3

    @property
    def size(self) -> int:
        return self.path_size + self.word_size + 4


def tags(html: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, "/" or "", name, attributes) of each tag, in one pass.

    A > within quotes doesn't end a tag. Where that leaves a tag without end, quotes don't count from
    there on; where no > follows at all, the rest is text.
    """
    at, quotes = 0, True
    while m := OPEN.search(html, at):
        closed = ATTRIBUTES.match(html, m.end()) if quotes else None
        quotes = quotes and closed is not None
        at = closed.end() if closed else html.find(">", m.end()) + 1
        if not at:
            return
        yield m.start(), at, m[1], m[2].lower(), html[m.end() : at - 1]


def shown(html: str) -> str:
    """The page without what isn't shown: comments, scripts, styles, the head and hidden elements."""
    html = SKIPPED.sub(" ", html)
    gaps: list[tuple[int, int]] = []
    still_open: list[tuple[str, int, int]] = []
    count: Counter[str] = Counter()
    for begin, end, closing, kind, rest in tags(html):
        if kind not in HIDDEN:
            continue
        if not closing and not rest.endswith("/"):
            still_open.append((kind, begin, end))
            count[kind] += 1
            continue
        start = begin
        if closing and count[kind]:
            name = None
            while name != kind:  # with what is still open in it
                name, start, _ = still_open.pop()
                count[name] -= 1
            while gaps and gaps[-1][0] > start:
                gaps.pop()
        gaps.append((start, end))
    html = without(html, sorted(gaps + [(start, end) for _, start, end in still_open]))
    found = list(tags(html))
    gaps, titled, i = [], max((t.start() for t in TITLE_END.finditer(html)), default=-1), 0
    while i < len(found):
        start, end, closing, name, _ = found[i]
        i += 1
        if name == "head" and not closing:
            end, i = head_end(html, found, i, end, titled)
            gaps.append((start, end))
    return without(html, gaps)


def without(html: str, gaps: list[tuple[int, int]]) -> str:
    parts, at = [], 0
    for start, end in gaps:
        parts += [html[at:start], " "]
        at = end
    return "".join([*parts, html[at:]])


def head_end(html: str, found: list[tuple], i: int, at: int, titled: int) -> tuple[int, int]:
    """Where the head ends that begins before `at`, with or without an end tag, and the first tag behind it.

    found[i:] are the tags from there on; titled is where the last title ends.
    """
    while i < len(found):
        start, end, closing, tag, rest = found[i]
        if start < at:  # within the title
            i += 1
        elif html[at:start].strip():
            return at, i
        elif tag not in IN_HEAD and (not closing or tag == "body"):
            return start, i
        else:
            at, i = end, i + 1
            if closing and tag in ("head", "html"):
                return at, i
            if tag == "title" and not closing and not rest.endswith("/"):
                close = TITLE_END.search(html, at) if at <= titled else None
                after = html.find("<", at)
                at = close.end() if close else after if after >= 0 else len(html)
    return at if html[at:].strip() else len(html), i


def blocks(html: str) -> list[tuple[Node | None, str, float]]:
    """(tag path, text, share of it in links) of each block with text, in order; in time in proportion to the page."""
    html = shown(html)
    out, path, text, linked = [], [], [], 0  # path: the open elements, each with its node
    held: Counter[str] = Counter()
    link, at = 0, 0

    def close():
        nonlocal linked
        if text:
            joined = BLANKS.sub(" ", unescape("".join(text))).strip()
            if joined:
                out.append((path[-1][1] if path else None, joined, min(1.0, linked / len(joined))))
            text.clear()
        linked = 0

    def leave(tag: str):
        name = None
        while name != tag:
            name, _ = path.pop()
            held[name] -= 1

    for start, end, closing, tag, rest in tags(html):
        if start > at:
            text.append(html[at:start])
            linked += (start - at) * bool(link)
        at = end
        if tag in INLINE:
            if tag == "a":
                link = 0 if closing else 1
            elif tag == "br":
                text.append(" ")
            continue
        close()
        link = 0
        if closing:
            if held[tag]:  # with all that it holds
                leave(tag)
        elif tag not in VOID and not rest.endswith("/"):
            if tag in LOOSE and any(t == tag for t, _ in path[-3:]):
                leave(tag)
            node = Node(path[-1][1] if path else None, tag)
            names = NAME.search(rest)
            for name in names[1].lower().split() if names else ():
                node = Node(node, "." + name)
            path.append((tag, node))
            held[tag] += 1
    text.append(html[at:].replace("<", " "))
    close()
    return out


def path_vectors(nodes: list[Node | None], hide: np.ndarray, size: int) -> np.ndarray:
    """For each path the hashed tags of all of it, each counting DECAY times what the next inner one does."""
    out = np.zeros((len(nodes), size), np.float32)
    code: dict[str, int] = {}
    for hidden in (False, True):
        known: dict[int, np.ndarray] = {id(None): np.zeros(size, np.float32)}
        for i in np.flatnonzero(hide == hidden):
            node, todo = nodes[i], []
            while id(node) not in known:
                todo.append(node)
                node = node.above
            for node in reversed(todo):
                own = known[id(node.above)] * np.float32(DECAY)
                if not (hidden and (node.tag in MAIN or node.tag in ASIDE)):
                    if node.tag not in code:
                        code[node.tag] = int(mix(np.array([name_hash(node.tag.encode())], U64))[0] % U64(size))
                    own[code[node.tag]] += 1
                known[id(node)] = own
            out[i] = known[id(nodes[i])]
    return out


def vectors(pages: list[list[tuple]], config: Labeller, hidden: list[bool] | None = None) -> np.ndarray:
    """A row for each block of all pages, one page after the other."""
    flat = [b for page in pages for b in page]
    hide = np.repeat([False] * len(pages) if hidden is None else hidden, [len(p) for p in pages])
    x = np.zeros((len(flat), config.size), np.float32)
    if not flat:
        return x
    x[:, : config.path_size] = path_vectors([p for p, _, _ in flat], hide, config.path_size)
    texts = [t.encode() for _, t, _ in flat]
    ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    words = Words(np.frombuffer(b"".join(texts), np.uint8), ends, NOT_ALNUM)
    h, doc = words.hashes(FOLDED_HASH), words.doc()
    place = doc * config.word_size + (h % U64(config.word_size)).astype(np.int64)
    sign = np.where(h >> U64(63), 1.0, -1.0)
    counts = np.bincount(place, weights=sign, minlength=len(flat) * config.word_size).reshape(len(flat), -1)
    n = words.counts
    base = config.path_size
    x[:, base : base + config.word_size] = counts / np.sqrt(np.maximum(n, 1))[:, None]
    base += config.word_size
    sizes = [len(p) for p in pages]
    within = np.arange(len(flat)) - np.repeat(np.concatenate([[0], np.cumsum(sizes)])[:-1], sizes)
    x[:, base] = np.log1p(n) / 4
    x[:, base + 1] = [s for _, _, s in flat]
    x[:, base + 2] = within / np.maximum(np.repeat(sizes, sizes), 1)
    x[:, base + 3] = [t[-1:] in (b".", b"!", b"?") for t in texts]
    return x


def name_hash(data: bytes) -> int:
    h = 1469598103934665603
    for b in data:
        h = (h ^ b) * 1099511628211 % (1 << 64)
    return h


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Weights:
    """Of both directions (input and state to the four gates, bias) and of the output."""

    fw: np.ndarray
    fb: np.ndarray
    bw: np.ndarray
    bb: np.ndarray
    ow: np.ndarray
    ob: np.ndarray

    @staticmethod
    def fresh(config: Labeller) -> Weights:
        rng = np.random.default_rng(config.seed)
        h, n = config.hidden, config.size + config.hidden
        gates = lambda: (rng.standard_normal((n, 4 * h)) / np.sqrt(n)).astype(np.float32)
        bias = lambda: np.repeat([0.0, 1.0, 0.0, 0.0], h).astype(np.float32)
        return Weights(gates(), bias(), gates(), bias(), (rng.standard_normal(2 * h) / np.sqrt(h)).astype(np.float32), np.zeros(1, np.float32))


def _lstm(x, mask, w, b, keep: bool):
    """States over time of a (time, page, feature) batch; where mask is 0 the state stays."""
    steps, n, _ = x.shape
    hidden = w.shape[1] // 4
    h, c = np.zeros((n, hidden), np.float32), np.zeros((n, hidden), np.float32)
    inputs = x @ w[: x.shape[2]] + b
    u, out, tape = w[x.shape[2] :], np.zeros((steps, n, hidden), np.float32), []
    for t in range(steps):
        z = inputs[t] + h @ u
        gate = _sigmoid(z[:, : 3 * hidden])
        i, f, o, g = gate[:, :hidden], gate[:, hidden : 2 * hidden], gate[:, 2 * hidden :], np.tanh(z[:, 3 * hidden :])
        m = mask[t][:, None]
        new = f * c + i * g
        tc = np.tanh(new)
        if keep:
            tape.append((h, c, i, f, o, g, tc, m))
        c = m * new + (1 - m) * c
        h = m * (o * tc) + (1 - m) * h
        out[t] = h
    return out, tape


def _lstm_back(x, dout, tape, w):
    steps, n, size = x.shape
    hidden = w.shape[1] // 4
    u = w[size:]
    dz_all, states = np.zeros((steps, n, 4 * hidden), np.float32), np.stack([t[0] for t in tape])
    dh, dc = np.zeros((n, hidden), np.float32), np.zeros((n, hidden), np.float32)
    for t in range(steps - 1, -1, -1):
        _, c, i, f, o, g, tc, m = tape[t]
        total = dh + dout[t]
        dnew = m * total
        dct = m * dc + dnew * o * (1 - tc * tc)
        dz = np.concatenate([dct * g * i * (1 - i), dct * c * f * (1 - f), dnew * tc * o * (1 - o), dct * i * (1 - g * g)], 1)
        dz_all[t] = dz
        dh = dz @ u.T + (1 - m) * total
        dc = dct * f + (1 - m) * dc
    flat = dz_all.reshape(-1, 4 * hidden)
    return np.concatenate([x.reshape(-1, size).T @ flat, states.reshape(-1, hidden).T @ flat]), flat.sum(0)


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(r) for r in rows)
    x, mask = np.zeros((steps, len(rows), rows[0].shape[1]), np.float32), np.zeros((steps, len(rows)), np.float32)
    for k, r in enumerate(rows):
        x[: len(r), k], mask[: len(r), k] = r, 1
    return x, mask


def forward(x, mask, w: Weights, keep: bool = False):
    f, ft = _lstm(x, mask, w.fw, w.fb, keep)
    b, bt = _lstm(x[::-1], mask[::-1], w.bw, w.bb, keep)
    both = np.concatenate([f, b[::-1]], 2)
    return _sigmoid(both @ w.ow + w.ob[0]), both, ft, bt


def fit(pages: list[np.ndarray], labels: list[np.ndarray], config: Labeller) -> Weights:
    """Adam on the cross entropy of blocks, in batches of 16 pages of like length."""
    w = Weights.fresh(config)
    names = [f.name for f in fields(w)]
    first, second = ({k: np.zeros_like(getattr(w, k)) for k in names} for _ in range(2))
    rng, step = np.random.default_rng(config.seed), 0
    order = np.argsort([len(p) for p in pages], kind="stable")
    groups = [order[i : i + 16] for i in range(0, len(order), 16)]
    for _ in range(config.epochs):
        for k in rng.permutation(len(groups)):
            x, mask = padded([pages[i] for i in groups[k]])
            y, _ = padded([labels[i][:, None].astype(np.float32) for i in groups[k]])
            p, both, ft, bt = forward(x, mask, w, True)
            d = ((p - y[:, :, 0]) * mask / max(mask.sum(), 1)).astype(np.float32)
            dboth, h = d[:, :, None] * w.ow, config.hidden
            grads = dict(zip(names, [*_lstm_back(x, dboth[:, :, :h], ft, w.fw), *_lstm_back(x[::-1], dboth[::-1, :, h:], bt, w.bw), np.tensordot(d, both, ((0, 1), (0, 1))), np.array([d.sum()])], strict=True))
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            step += 1
            for name, g in grads.items():
                g = g * min(1.0, 5 / max(norm, 1e-9))
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                move = config.rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
                setattr(w, name, (getattr(w, name) - move).astype(np.float32))
    return w


def told(page: list[tuple]) -> np.ndarray | None:
    """What semantic tags say of each block; None for a page without them, or all of one kind."""
    y = np.array([p is not None and p.main and not p.aside for p, _, _ in page], bool)
    return y if len(y) and y.any() and not y.all() else None


def train(pages: DataFrame, config: Labeller = Labeller()) -> Weights | None:
    """Weights from the sample; None where no page of it says where its main text is."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).filter(F.col("html").rlike(r"(?i)<(article|main)\b"))
    keyed = own.withColumn("h", F.xxhash64("html"))
    chosen = keyed.select("page_id", "h").distinct().orderBy(F.xxhash64("page_id"), "page_id", "h").limit(config.sample)  # keys first, so that only the chosen pages travel
    rows = keyed.join(F.broadcast(chosen.select(F.col("page_id").alias("p"), F.col("h").alias("g"))), F.col("page_id").eqNullSafe(F.col("p")) & (F.col("h") == F.col("g"))).select("page_id", "html").distinct().collect()  # at most `sample`
    rows.sort(key=lambda r: (r["page_id"] is not None, r["page_id"] or 0, r["html"]))
    parsed = [blocks(r["html"]) for r in rows]
    known = [(p, y) for p in parsed if (y := told(p)) is not None]
    if not known:
        warnings.warn("no page of the sample says by tags where its main text is: every block will be kept", stacklevel=2)
        return None
    hidden = np.random.default_rng(config.seed).random(len(known)) < config.hide
    xs = [vectors([p], config, [h]) for (p, _), h in zip(known, hidden, strict=True)]
    return fit(xs, [y for _, y in known], config)


def scores(parsed: list[list[tuple]], w: Weights | None, config: Labeller) -> list[np.ndarray]:
    """The chance of being main text, for each block of each page; 1 for all without weights."""
    sizes = [len(p) for p in parsed]
    if w is None:
        return [np.ones(n, np.float32) for n in sizes]
    x = vectors(parsed, config)
    rows = np.split(x, np.cumsum(sizes)[:-1]) if sizes else []
    out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(parsed)
    order = [i for i in np.argsort(sizes, kind="stable") if sizes[i]]
    at = 0
    while at < len(order):
        group = order[at : at + 64]
        while len(group) > 1 and sizes[group[-1]] * len(group) > 20_000:
            group = group[: len(group) // 2]
        at += len(group)
        p = forward(*padded([rows[i] for i in group]), w)[0]
        for k, i in enumerate(group):
            out[i] = p[: sizes[i], k].astype(np.float32)
    return out


def extract(pages: DataFrame, config: Labeller = Labeller(), weights: Weights | None = None) -> DataFrame:
    """(page_id, text, n_blocks, n_content, scores), one row for each row of pages.

    text: the blocks classified as main text, one a line; scores has the chance of every block. A null
    html gives null text, blocks and scores; an empty one, or one without text, an empty text. Where no
    page in the sample says where its main text is, there is nothing to learn and every block is kept,
    with a warning. Long, deep and malformed pages are read whole, in time in proportion to their length.
    Repeated rows stay, each on its own; an empty table gives an empty one. Other columns are ignored.
    """
    w = weights or train(pages, config)
    shared = pages.sparkSession.sparkContext.broadcast(w)  # a few KB, whatever the corpus

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                html = part.column(1).to_pylist()
                parsed = [blocks(h or "") for h in html]
                found = scores(parsed, shared.value, config)
                none = np.array([h is None for h in html], bool)
                sizes = np.array([len(p) for p in parsed], np.int32)
                text = [None if h is None else "\n".join(t for (_, t, _), s in zip(p, f, strict=True) if s >= config.threshold) for h, p, f in zip(html, parsed, found, strict=True)]
                content = np.array([int((f >= config.threshold).sum()) for f in found], np.int32)
                flat, ends = np.round(np.concatenate([*found, np.zeros(0, np.float32)]), 4), np.concatenate([[0], np.cumsum(sizes)])
                lists = int_lists(flat, ends, pa.float32()) if not none.any() else pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat, pa.float32()), mask=pa.array(none))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(text, pa.string()), pa.array(sizes, mask=none), pa.array(content, mask=none), lists], names=["page_id", "text", "n_blocks", "n_content", "scores"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, text string, n_blocks int, n_content int, scores array<float>")

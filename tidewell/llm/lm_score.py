"""Language-model scores: a causal self-attention model over subword ids, and a word-count base.

Model. Words (A-Z lower-cased, split at ASCII white space) become ids of a public byte-level vocabulary; after the last
word comes one end id. A causal self-attention layer over the ids before a position gives weights of COMPONENTS
distributions over all ids, whose mixture is the next id's distribution; every id has positive mass. A start is
trained in numpy on a bounded sample of training documents, attention by Adam on the log-likelihood and the
distributions by stepwise EM. Then the pairs of neighbouring ids of all training documents are counted, exactly and by
partition, and EM steps over these counts give every id that training met its own mass and its own weights of
components; there the weights after an id are their mean over the start's contexts, so that a step costs as much as
there are different pairs. At last embeddings, places and the fixed-size projections are trained over all training
documents: each task goes over all ids of its own by Adam, and the changes are averaged, those of an id's embedding by how
often a task met it. So every parameter is learned from all training documents; the sample only gives the values to begin with.

Scores. Batches are overlapping windows under a causal mask: each window after the first begins with ids that the
window before has scored; they are keys only, so each id counts once.

Base. Exact counts of all training documents' words: words are packed by hash range, so that a range's task sees all
its words' counts and gives every block of documents its partial sums. Words that are frequent in the training sample
cross the network once a block instead of once a document.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cache, cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_SPACE_TABLE, crc_mod, cuts, give_back, materialize, mix64, pieces, text_blocks, word_hashes
from .jaccard import _from_planes, _planes, _ranges

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Documents to start the model on, about; more are sampled by a hash of their id. The EM steps and the training after it read all.
MAX_TRAINING = 1200
#: A word in so many documents of the sample is frequent.
FREQUENT = 3
WINDOW = 24
CONTEXT = 12
DIM = 16
COMPONENTS = 64
EPOCHS = 3
BATCH = 256
#: Windows of a batch that are scored at a time, so that a core's cache holds them.
SCORED_BLOCK = 128
#: Windows whose gradients are made at a time, for the same reason.
TILE = 48
BLOCK_BYTES = 3 << 20
#: So many hash ranges for each of the Jaccard join's.
RANGE_FACTOR = 2
TRAIN_BATCH = 64
RATE = 0.02
#: Share of the plain id frequencies in each component, which keeps every id possible.
FLOOR = np.float32(0.01)
SMOOTH = 0.1
#: Added to both sums of an id and component, so that rare ids keep near to the start.
FOLLOW_SMOOTH = 0.5
#: EM steps over all training documents.
STEPS = 2
#: Training over all documents: windows a step, and at a time (and a step for the first STEADY steps); rates of the projections
#: and of embeddings, which fall with the root of the step after STEADY steps.
REFINE_BATCH = 256
REFINE_BLOCK = 32
REFINE_RATE = 0.01
EMBED_RATE = 0.05
STEADY = 200
#: Ids that are cut into windows and shuffled at a time.
REFINED = 1 << 18
#: What training over all documents changes besides embeddings.
PROJECTIONS = ("place", "qkv", "mix")
#: Ids that are scored at a time.
SCORED = 1 << 20
#: Rows of the stored blocks.
DOCUMENT, POSTING, PAIRS = 0, 1, 2
#: Ids whose counts and sums travel as one row.
CHUNK = 64
#: Different pairs of ids that a task holds before it sends them on.
MAX_PAIRS = 1 << 20
#: Words encoded at a time.
ENCODED = 50_000
#: Different words whose ids a task keeps.
KNOWN = 1 << 19
#: Of a posting that stands for a whole block.
WHOLE = (1 << 31) - 1


#: White space but for a blank.
ODD_SPACE = re.compile(r"[^\S ]")


@cache
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    #: Fixed value: the pattern this vocabulary was made with.
    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    begins = np.zeros(len(ranks) + 1, bool)
    for token, i in ranks.items():
        begins[i] = token[:1] == b" "
    return tiktoken.Encoding("subwords", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), begins


class WordIds:
    """Subword ids of words, each encoded with one blank before it."""

    def __init__(self, path: str):
        self.encoder, self.begins = _encoder(path)
        self.end = len(self.begins) - 1

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [self.encoder.encode_ordinary(" " + w) for w in words]
        return np.asarray([i for g in got for i in g], np.int32), np.asarray([len(g) for g in got], np.int64)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the words, and where each word's ids begin (with the end at last)."""
        flat, sizes = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        for at in range(0, len(words), ENCODED):
            some = words[at : at + ENCODED]
            text = b" ".join(some).decode("utf-8", "replace")
            odd = ODD_SPACE.search(text)  # white space beyond ASCII splits a word
            ids = np.asarray([] if odd else self.encoder.encode_ordinary(" " + text), np.int32)
            first = np.flatnonzero(self.begins[ids])
            if len(first) != len(some):
                ids, size = self._each([w.decode("utf-8", "replace") for w in some])
            else:
                size = np.diff(np.append(first, len(ids)))
            flat.append(ids)
            sizes.append(size)
        return np.concatenate(flat), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


@cache
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


@dataclass
class Model:
    """weights of the attention layer; emit[code, component]: each component's distribution over ids; after[code, component]: mean weights after it.

    code: the number of each id; ids that training never met share the last one, and each has that code's mass.
    """

    weights: dict[str, np.ndarray]
    emit: np.ndarray
    after: np.ndarray
    code: np.ndarray
    window: int = WINDOW
    context: int = CONTEXT

    @cached_property
    def ready(self) -> tuple[np.ndarray, np.ndarray]:
        """Queries (scaled), keys and values of every code, and of every place, side by side."""
        w, d = self.weights, self.weights["embed"].shape[1]
        qkv = w["qkv"].copy()
        qkv[:, :d] *= np.float32(d**-0.5)
        return w["embed"] @ qkv, w["place"] @ qkv

    @cached_property
    def causal(self) -> np.ndarray:
        return np.triu(np.full((self.window, self.window), -1e9, np.float32), 1)

    def mixture(self, ids: np.ndarray, skip: int = 0) -> np.ndarray:
        """(windows, length) codes to weights, up to a factor, of the components for the id after each but the first `skip`."""
        w, n = self.weights, ids.shape[1]
        d = w["embed"].shape[1]
        got = np.take(self.ready[0], ids, axis=0)
        got += self.ready[1][:n]
        s = got[:, skip:, :d] @ got[..., d : 2 * d].transpose(0, 2, 1)
        s += self.causal[skip:n, :n]
        _exp(s)
        z = (s @ got[..., 2 * d :]).reshape(-1, d)
        z /= np.maximum(s.reshape(-1, n) @ np.ones(n, s.dtype), np.float32(1e-30))[:, None]
        o = z @ w["mix"]
        o += np.take(w["follow"], ids[:, skip:].ravel(), axis=0)
        _exp(o)
        return o.reshape(len(ids), n - skip, -1)

    def windows(self, tokens: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
        """Batches of windows over the sequences that tokens holds one after another: owner, places that it scores, which of these exist, codes before the window's places, how many of these are context."""
        stop = np.cumsum(lengths)
        start = stop - lengths
        step = self.window - self.context
        n = np.maximum(0, -(-(lengths - self.window) // step))  # after the first
        owner = np.repeat(np.arange(len(lengths)), n)
        turn = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + 1
        before = self.code[_before(tokens, lengths, len(self.code) - 1)]
        for skip, own, begin in ((0, np.argsort(lengths, kind="stable"), None), (self.context, owner, start[owner] + turn * step)):
            for at in range(0, len(own), BATCH):
                mine = own[at : at + BATCH]
                width = self.window if skip else min(self.window, int(lengths[mine].max()))  # short texts come first
                first = start[mine] if begin is None else begin[at : at + BATCH]
                place = first[:, None] + np.arange(width)
                live = place[:, skip:] < stop[mine][:, None]
                place = np.minimum(place, len(tokens) - 1)
                yield mine, place[:, skip:], live, before[place], skip

    def score(self, tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """log10 probability of each of the sequences that tokens holds one after another, each with its end id."""
        goal = self.code[tokens]
        total, ones = np.zeros(len(lengths)), np.ones(self.emit.shape[1], np.float32)
        for own, place, live, before, skip in self.windows(tokens, lengths):
            p = np.empty(place.shape, np.float32)
            for at in range(0, len(own), SCORED_BLOCK):
                part = slice(at, at + SCORED_BLOCK)
                mix = self.mixture(before[part], skip)
                p[part] = np.einsum("bnc,bnc->bn", mix, np.take(self.emit, goal[place[part]], axis=0)) / (mix @ ones)
            logs = np.where(live, np.log(np.maximum(p, 1e-30)), 0).sum(axis=1, dtype=np.float64)
            total += np.bincount(own, weights=logs, minlength=len(lengths))
        return total / np.log(10)

    def expect(self, prior: np.ndarray, ids: np.ndarray, times: np.ndarray, sums: np.ndarray) -> None:
        """Add the components' shares of pairs (prior, ids), met `times`, to sums[ids] and, behind them, to sums[prior]."""
        c = self.emit.shape[1]
        for at in range(0, len(ids), 1 << 16):
            a, b = prior[at : at + (1 << 16)], ids[at : at + (1 << 16)]
            share = np.take(self.after, self.code[a], axis=0) * np.take(self.emit, self.code[b], axis=0)
            share *= (times[at : at + (1 << 16)] / np.maximum(share.sum(axis=1), 1e-30)).astype(np.float32)[:, None]
            _add_rows(sums[:, :c], b, share)
            _add_rows(sums[:, c:], a, share)

    def learned(self, count: np.ndarray, count_before: np.ndarray, sums: np.ndarray) -> Model:
        """The model after the EM step of `sums` (see expect) over documents that hold each id `count` times, and `count_before` times before another."""
        end, c = len(self.code) - 1, self.emit.shape[1]
        used = np.flatnonzero((count > 0) | (np.arange(end + 1) == end))
        code, unigram = _codes(used, count[used], end)
        old = np.append(self.code[used], len(self.emit) - 1)
        got = sums[used, c:] + FOLLOW_SMOOTH
        weight = count_before[used][:, None] * self.after[old[:-1]] + FOLLOW_SMOOTH
        w = self.weights | {"embed": self.weights["embed"][old], "follow": self.weights["follow"][old].copy()}
        w["follow"][:-1] += np.log(got / weight).astype(np.float32)
        after = self.after[old].copy()
        after[:-1] *= (got / weight).astype(np.float32)
        after /= after.sum(axis=1, keepdims=True)
        stats = np.concatenate([sums[used, :c], np.zeros((1, c), sums.dtype)])
        emit = (1 - FLOOR) * stats / np.maximum(stats.sum(axis=0), 1e-12) + FLOOR * unigram[:, None]
        emit[:, stats.sum(axis=0) <= 0] = unigram[:, None]
        return Model(w, emit.astype(np.float32), after, code, self.window, self.context)


def _before(tokens: np.ndarray, lengths: np.ndarray, end: int) -> np.ndarray:
    """The id before each; the end id at the beginning of each sequence."""
    before = np.empty_like(tokens)
    before[1:], before[:1] = tokens[:-1], end
    before[np.cumsum(lengths) - lengths] = end
    return before


def _codes(used: np.ndarray, count: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The code of each id, and each code's share of all ids; those not in `used` share the last code."""
    code = np.full(end + 1, len(used), np.int32)
    code[used] = np.arange(len(used))
    mass = np.append(count + 0.05, 0.05)
    return code, (mass / (mass.sum() + 0.05 * (end - len(used)))).astype(np.float32)


def _add_rows(sums: np.ndarray, ids: np.ndarray, values: np.ndarray) -> None:
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.empty(0, np.int64)
    if len(first):
        sums[ids[first]] += np.add.reduceat(values[order], first, axis=0)


def _exp(x: np.ndarray) -> None:
    """In place; what is beyond 60 counts as 60."""
    if x.max(initial=0) > 60:
        np.minimum(x, 60, out=x)
    np.exp(x, out=x)


def _forward(w: dict[str, np.ndarray], ids: np.ndarray) -> tuple:
    b, n = ids.shape
    d = w["embed"].shape[1]
    x = w["embed"][ids] + w["place"][:n]
    qkv = (x.reshape(-1, d) @ w["qkv"]).reshape(b, n, 3 * d)
    q, k, v = qkv[..., :d], qkv[..., d : 2 * d], qkv[..., 2 * d :]
    s = q @ k.transpose(0, 2, 1)
    s *= np.float32(d**-0.5)
    s += np.triu(np.full((n, n), -1e9, np.float32), 1)
    s -= s.max(axis=2, keepdims=True)
    np.exp(s, out=s)
    s /= s.sum(axis=2, keepdims=True)
    z = s @ v
    o = z.reshape(-1, d) @ w["mix"] + w["follow"][ids.ravel()]
    o -= o.max(axis=1, keepdims=True)
    np.exp(o, out=o)
    o /= o.sum(axis=1, keepdims=True)
    return x, q, k, v, s, z, o.reshape(b, n, -1)


def _sum_rows(like: np.ndarray, ids: np.ndarray, values: np.ndarray) -> np.ndarray:
    rows, which = np.unique(ids.ravel(), return_inverse=True)
    order = np.argsort(which, kind="stable")
    out = np.zeros_like(like)
    out[rows] = np.add.reduceat(values[order], np.searchsorted(which[order], np.arange(len(rows))), axis=0)
    return out


def _backward(w: dict[str, np.ndarray], ids: np.ndarray, kept: tuple, grad_o: np.ndarray) -> dict[str, np.ndarray]:
    x, q, k, v, s, z, _ = kept
    b, n, d = x.shape
    go = grad_o.reshape(b * n, -1)
    grads = {"mix": z.reshape(-1, d).T @ go, "follow": _sum_rows(w["follow"], ids, go)}
    gz = (go @ w["mix"].T).reshape(b, n, d)
    gv = s.transpose(0, 2, 1) @ gz
    gs = gz @ v.transpose(0, 2, 1)
    gs = s * (gs - (gs * s).sum(axis=2, keepdims=True)) * np.float32(d**-0.5)
    gqkv = np.concatenate([gs @ k, gs.transpose(0, 2, 1) @ q, gv], axis=2).reshape(-1, 3 * d)
    grads["qkv"] = x.reshape(-1, d).T @ gqkv
    gx = (gqkv @ w["qkv"].T).reshape(b, n, d)
    grads["place"] = np.zeros_like(w["place"])
    grads["place"][:n] = gx.sum(0)
    grads["embed"] = _sum_rows(w["embed"], ids, gx.reshape(-1, d))
    return grads


def train(sequences: list[np.ndarray], end: int, window: int = WINDOW, context: int = CONTEXT, epochs: int = EPOCHS, components: int = COMPONENTS, dim: int = DIM, batch: int = TRAIN_BATCH, rate: float = RATE, seed: int = 5) -> Model:
    """Fit on id sequences, each ending with the end id. Without any, every id is equally likely."""
    rng = np.random.default_rng(seed)
    tokens = np.concatenate([np.empty(0, np.int64), *sequences]).astype(np.int64)
    used = np.unique(np.append(tokens, end))
    code, unigram = _codes(used, np.bincount(tokens, minlength=end + 1)[used], end)
    size = len(used) + 1
    tokens = code[tokens]
    norm = lambda *s: (rng.standard_normal(s) * 0.3).astype(np.float32)
    w = {"embed": norm(size, dim), "place": norm(window, dim) * np.float32(0.3), "qkv": norm(dim, 3 * dim), "mix": norm(dim, components), "follow": norm(size, components)}
    stats = unigram[:, None] * np.exp(rng.standard_normal((size, components))).astype(np.float32)
    stats /= stats.sum(axis=0) * components
    emit = stats * np.float32(components)
    # any cut of the running text will do for training; a document's end id is the next one's beginning
    before = np.concatenate([code[[end]], tokens[:-1]]) if len(tokens) else tokens
    windows = len(tokens) // window
    feed, goal = before[: windows * window].reshape(-1, window), tokens[: windows * window].reshape(-1, window)
    m1 = {k: np.zeros_like(v) for k, v in w.items()}
    m2 = {k: np.zeros_like(v) for k, v in w.items()}
    step, steps = 0, max(1, epochs * (-(-windows // batch)))
    after = 2 * _softmax(w["follow"])
    for epoch in range(epochs):
        if epoch == epochs - 1:
            after = 2 * _softmax(w["follow"])
        order = rng.permutation(windows)
        for at in range(0, windows, batch):
            step += 1
            pick = order[at : at + batch]
            ids, want = feed[pick], goal[pick]
            kept = _forward(w, ids)
            pi = kept[-1]
            if epoch == epochs - 1:
                after += _sum_rows(after, ids, pi.reshape(-1, components))
            joint = pi * emit[want]
            gamma = joint / np.maximum(joint.sum(axis=2, keepdims=True), 1e-30)
            grads = _backward(w, ids, kept, (pi - gamma) / np.float32(want.size))
            lr = np.float32(rate * min(1, step / 20) * (1 - 0.95 * step / steps) * np.sqrt(1 - 0.99**step) / (1 - 0.9**step))
            for name, gr in grads.items():
                m1[name] += np.float32(0.1) * (gr - m1[name])
                m2[name] += np.float32(0.01) * (gr * gr - m2[name])
                w[name] -= lr * m1[name] / (np.sqrt(m2[name]) + np.float32(1e-8))
            eta = np.float32((step + 2) ** -0.6)
            stats *= 1 - eta
            stats += eta / np.float32(want.size) * _sum_rows(stats, want, gamma.reshape(-1, components))
            emit = (1 - FLOOR) * stats / np.maximum(stats.sum(axis=0), 1e-12) + FLOOR * unigram[:, None]
    return Model(w, emit.astype(np.float32), after / after.sum(axis=1, keepdims=True), code, window, context)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _words(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts as one, where each distinct word begins, their 64-bit hashes (ascending), the number of each word in order, and each text's word count."""
    data = b" ".join(t.translate(LOWER_SPACE_TABLE) for t in texts) + b" "
    hashes, at = word_hashes(data)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    h, first, code = np.unique(hashes, return_index=True, return_inverse=True)
    return data, at[first], h, code.astype(np.int64), np.diff(np.searchsorted(at, ends), prepend=0)


def _places(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The place of each value in an ascending table, -1 where it isn't there."""
    if not len(table):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, at, -1)


class KnownWords:
    """Ids of the words met so far, so that each is encoded once; all are forgotten beyond KNOWN words."""

    def __init__(self, ids: WordIds):
        self.ids = ids
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.flat = np.empty(0, np.uint64), np.empty(0, np.int32)
        self.begin, self.size = np.empty(0, np.int64), np.empty(0, np.int64)

    def get(self, data: bytes, starts: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids, and where in them the ids of each word (see _words) begin and how many they are."""
        if len(self.hashes) > KNOWN:
            self._forget()
        new = np.flatnonzero(_places(self.hashes, hashes) < 0)
        flat, cuts = self.ids.encode([data[i : data.index(b" ", i)] for i in starts[new].tolist()])
        at = np.searchsorted(self.hashes, hashes[new])
        self.begin, self.size = np.insert(self.begin, at, cuts[:-1] + len(self.flat)), np.insert(self.size, at, np.diff(cuts))
        self.hashes, self.flat = np.insert(self.hashes, at, hashes[new]), np.concatenate([self.flat, flat])
        at = np.searchsorted(self.hashes, hashes)
        return self.flat, self.begin[at], self.size[at]


def sequences(texts: list[bytes], ids: WordIds) -> tuple[np.ndarray, np.ndarray]:
    """Subword ids of the texts one after another, each with an end id, and their lengths."""
    *words, code, n = _words(texts)
    return _expand(*KnownWords(ids).get(*words), code, n, ids.end)


def _expand(flat: np.ndarray, begin: np.ndarray, size: np.ndarray, code: np.ndarray, n: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    flat = np.append(flat, np.int32(end))
    size, begin = np.append(size, 1), np.append(begin, len(flat) - 1)
    ends = np.cumsum(n)
    unit = np.insert(code, ends, len(size) - 1)  # an end behind each text
    length = size[unit]
    at = np.repeat(begin[unit] - (np.cumsum(length) - length), length) + np.arange(length.sum())
    per_text = np.add.reduceat(length, np.concatenate([[0], (ends + np.arange(1, len(n) + 1))[:-1]])) if len(n) else n
    return flat[at], per_text


def _summed(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their times."""
    key, where = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(where, weights=np.concatenate(times), minlength=len(key)).astype(np.int64)


class PairCounts:
    """Counts of pairs of neighbouring ids, a text beginning behind an end id; `rows` gives them away by CHUNK of the first id, as first id * (ids + 1) + second id."""

    def __init__(self, ids: int):
        self.ids, self.keys, self.times = ids, [], []

    def add(self, tokens: np.ndarray, lengths: np.ndarray) -> None:
        kind = np.uint32 if self.ids**2 <= 1 << 32 else np.int64  # which sorts faster
        key, n = np.unique(_before(tokens, lengths, self.ids - 1).astype(kind) * kind(self.ids) + tokens.astype(kind), return_counts=True)
        self.keys.append(key.astype(np.int64))
        self.times.append(n)
        if len(self.keys) == 8:
            key, n = _summed(self.keys, self.times)
            self.keys, self.times = [key], [n]

    def full(self) -> bool:
        return sum(map(len, self.keys)) > MAX_PAIRS

    def rows(self) -> tuple[list[int], list[bytes], list[bytes]]:
        """Chunks, their pairs and times; nothing is held any more."""
        if not self.keys:
            return [], [], []
        key, n = _summed(self.keys, self.times)
        self.keys, self.times = [], []
        chunk = key // (CHUNK * self.ids)
        first = np.flatnonzero(np.concatenate([[True], np.diff(chunk) > 0])).tolist() if len(key) else []
        cut = [slice(a, b) for a, b in zip(first, [*first[1:], len(key)], strict=True)]
        return [int(chunk[c.start]) for c in cut], [key[c].tobytes() for c in cut], [n[c].tobytes() for c in cut]


def merged_pairs(parts: DataFrame) -> DataFrame:
    """(chunk, pairs, times) of parts from all tasks, one row a chunk: exact counts."""

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        key, n = _summed([np.frombuffer(x, np.int64) for x in rows["pairs"]], [np.frombuffer(x, np.int64) for x in rows["times"]])
        return pd.DataFrame({"chunk": rows["chunk"].iloc[:1], "pairs": [key.tobytes()], "times": [n.tobytes()]})

    return materialize(parts.groupBy("chunk").applyInPandas(merged, "chunk int, pairs binary, times binary"), "lm-pairs")


def _step(pairs: DataFrame, model: Model) -> Model:
    """Tasks send a row for each CHUNK of ids that they met; the driver gets one of each."""
    sent = pairs.sparkSession.sparkContext.broadcast(model)
    size, width = len(model.code), 2 * model.emit.shape[1]
    schema = "chunk int, part int, ids binary, count binary, sums binary"

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, count = np.zeros((size, width), np.float32), np.zeros((size, 2), np.int64)
        for batch in batches:
            for pairs, times in zip(batch.column("pairs"), batch.column("times"), strict=True):
                key, n = np.frombuffer(pairs.as_buffer(), np.int64), np.frombuffer(times.as_buffer(), np.int64)
                prior, ids = key // size, key % size
                for side, of in enumerate((ids, prior)):
                    count[:, side] += np.bincount(of, weights=n, minlength=size).astype(np.int64)
                sent.value.expect(prior, ids, n, total)
        met = np.flatnonzero(count.any(axis=1))
        part = TaskContext.get().partitionId()
        for rows in np.split(met, np.flatnonzero(np.diff(met // CHUNK)) + 1) if len(met) else []:
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([int(rows[0]) // CHUNK], pa.int32()), "part": pa.array([part], pa.int32()), "ids": [rows.astype(np.int32).tobytes()], "count": [count[rows].tobytes()], "sums": [total[rows].tobytes()]})

    def merged(parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values("part", kind="stable")  # the same sum on every run
        low = int(parts["chunk"].iloc[0]) * CHUNK
        total, count = np.zeros((CHUNK, width)), np.zeros((CHUNK, 2), np.int64)
        for i, c, x in zip(parts["ids"], parts["count"], parts["sums"], strict=True):
            rows = np.frombuffer(i, np.int32) - low
            count[rows] += np.frombuffer(c, np.int64).reshape(-1, 2)
            total[rows] += np.frombuffer(x, np.float32).reshape(-1, width)
        return pd.DataFrame({"chunk": parts["chunk"].iloc[:1], "count": [count.tobytes()], "sums": [total.astype(np.float32).tobytes()]})

    partial = pairs.mapInArrow(sums, schema)
    found = materialize(partial.groupBy("chunk").applyInPandas(merged, "chunk int, count binary, sums binary"), "lm-ids")
    total, count = np.zeros((size, width), np.float32), np.zeros((size, 2), np.int64)
    for r in found.toLocalIterator():  # a row for each CHUNK of the vocabulary
        rows = slice(r[0] * CHUNK, min(size, (r[0] + 1) * CHUNK))
        n = rows.stop - rows.start
        count[rows], total[rows] = np.frombuffer(r[1], np.int64).reshape(-1, 2)[:n], np.frombuffer(r[2], np.float32).reshape(-1, width)[:n]
    sent.unpersist()
    return model.learned(count[:, 0], count[:, 1], total)


def _gradients(w: dict[str, np.ndarray], emit: np.ndarray, ids: np.ndarray, want: np.ndarray, causal: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Of the mean loss of codes `want` behind codes `ids`, both (windows, length): by PROJECTIONS, and by the embeddings of some codes.

    As _backward, but with attention divided by its sum after the products, without what follows the codes, and REFINE_BLOCK
    windows at a time, which stay in a core's cache.
    """
    n, d = ids.shape[1], w["embed"].shape[1]
    scale, ones, each = np.float32(d**-0.5), np.ones(max(n, d, emit.shape[1]), np.float32), np.float32(1 / want.size)
    qkv = w["qkv"].copy()
    qkv[:, :d] *= scale
    mix_back, back = np.ascontiguousarray(w["mix"].T), np.ascontiguousarray(qkv.T)
    mix, sides = np.zeros_like(mix_back), np.zeros_like(back)
    by_place = np.empty((*ids.shape, d), np.float32)
    wide = np.empty((2, min(len(ids), TILE) * n, emit.shape[1]), np.float32)  # of every block in turn
    turned = lambda m: m.transpose(0, 2, 1)
    for at in range(0, len(ids), TILE):
        part = ids[at : at + TILE]
        b, part = len(part), part.ravel()
        x = np.take(w["embed"], part, axis=0).reshape(b, n, d)
        x += w["place"][:n]
        x = x.reshape(-1, d)
        got = (x @ qkv).reshape(b, n, 3 * d)
        q, k, v = (got[..., i * d : (i + 1) * d] for i in range(3))
        e = q @ turned(k)
        e += causal[:n, :n]
        _exp(e)
        share = (1 / np.maximum(e.reshape(-1, n) @ ones[:n], np.float32(1e-30))).reshape(b, n, 1)
        z = e @ v
        z *= share
        z = z.reshape(-1, d)
        go, met = wide[:, : b * n]
        np.matmul(z, w["mix"], out=go)
        go += np.take(w["follow"], part, axis=0, out=met, mode="clip")  # which writes to `met` itself
        _exp(go)
        np.take(emit, want[at : at + TILE].ravel(), axis=0, out=met, mode="clip")
        met *= go
        total = np.maximum(go @ ones[: emit.shape[1]], np.float32(1e-30))
        met *= (total / np.maximum(met @ ones[: emit.shape[1]], np.float32(1e-30)))[:, None]
        go -= met  # the gradient, but for this factor
        total = (each / total)[:, None]
        mix += go.T @ (z * total)
        gz = (go @ mix_back).reshape(b, n, d)
        gz *= total.reshape(b, n, 1) * share
        gs = gz @ turned(v)
        z *= gz.reshape(-1, d)
        gs -= (z @ ones[:d]).reshape(b, n, 1)
        gs *= e
        g = np.empty((b, n, 3 * d), np.float32)  # by the scaled queries first
        for i, (by, m) in enumerate(((gs, k), (turned(gs), q), (turned(e), gz))):
            np.matmul(by, m, out=g[..., i * d : (i + 1) * d])
        g = g.reshape(-1, 3 * d)
        np.matmul(g, back, out=by_place[at : at + b].reshape(-1, d))
        sides += g.T @ x
    sides[:d] *= scale
    grads = {"qkv": sides.T, "mix": mix.T, "place": np.zeros_like(w["place"])}
    grads["place"][:n] = by_place.sum(axis=0)
    ids = ids.ravel()
    order = np.argsort(ids.astype(np.uint16) if len(emit) <= 1 << 16 else ids, kind="stable")  # a radix sort
    ids = ids[order]
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    return grads, ids[first], np.add.reduceat(by_place.reshape(-1, d)[order], first, axis=0)


class Refiner:
    """Training of a model's embeddings and PROJECTIONS on the ids that are added, each of which is one window's goal once."""

    def __init__(self, model: Model):
        self.model, self.weights = model, model.weights | {k: model.weights[k].copy() for k in ("embed", *PROJECTIONS)}
        self.met = np.zeros(len(model.emit), np.int64)
        self.first, self.second = ({k: np.zeros_like(model.weights[k]) for k in PROJECTIONS} for _ in range(2))
        self.squares = np.full(len(model.emit), 1e-12, np.float32)
        self.steps, self.rng = 0, np.random.default_rng(7)
        self.feed, self.goal = np.empty(0, np.int32), np.empty(0, np.int32)

    def add(self, tokens: np.ndarray, lengths: np.ndarray) -> None:
        model, n = self.model, self.model.window
        self.feed = np.concatenate([self.feed, model.code[_before(tokens, lengths, len(model.code) - 1)]])
        self.goal = np.concatenate([self.goal, model.code[tokens]])
        whole = len(self.feed) // n * n
        feed, goal = self.feed[:whole].reshape(-1, n), self.goal[:whole].reshape(-1, n)
        self.feed, self.goal = self.feed[whole:], self.goal[whole:]
        self.met += np.bincount(feed.ravel(), minlength=len(self.met))
        order = self.rng.permutation(len(feed))
        at = 0
        while at < len(feed):
            pick = order[at : at + (REFINE_BATCH if self.steps >= STEADY else REFINE_BLOCK)]
            self._step(feed[pick], goal[pick])
            at += len(pick)

    def end(self) -> None:
        """What is left is a shorter window."""
        if len(self.feed):
            self.met += np.bincount(self.feed, minlength=len(self.met))
            self._step(self.feed[None], self.goal[None])
        self.feed, self.goal = self.feed[:0], self.goal[:0]

    def _step(self, ids: np.ndarray, want: np.ndarray) -> None:
        self.steps += 1
        t, w = self.steps, self.weights
        grads, rows, by_row = _gradients(w, self.model.emit, ids, want, self.model.causal)
        part = np.sqrt(min(1, want.size / (REFINE_BLOCK * self.model.window))) * min(1, t / 20) / np.sqrt(max(1, t / STEADY))  # small batches are noisy
        rate = np.float32(REFINE_RATE * part * np.sqrt(1 - 0.99**t) / (1 - 0.9**t))
        for name, g in grads.items():
            m1, m2 = self.first[name], self.second[name]
            m1 += np.float32(0.1) * (g - m1)
            m2 += np.float32(0.01) * (g * g - m2)
            w[name] -= rate * m1 / (np.sqrt(m2) + np.float32(1e-8))
        self.squares[rows] += np.einsum("ij,ij->i", by_row, by_row) / np.float32(by_row.shape[1])
        w["embed"][rows] -= np.float32(EMBED_RATE * part) * by_row / np.sqrt(self.squares[rows])[:, None]

    def changes(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(chunk, codes, times, change times these) by CHUNK of the codes that were met; chunk -1 has all projections as one row."""
        old, new = self.model.weights, self.weights
        n = int(self.met.sum())
        flat = np.concatenate([(new[k] - old[k]).ravel() for k in PROJECTIONS])
        yield -1, np.zeros(1, np.int32), np.array([n]), (flat * np.float32(n))[None]
        met = np.flatnonzero(self.met)
        for rows in np.split(met, np.flatnonzero(np.diff(met // CHUNK)) + 1) if len(met) else []:
            yield int(rows[0]) // CHUNK, rows.astype(np.int32), self.met[rows], (new["embed"][rows] - old["embed"][rows]) * self.met[rows, None].astype(np.float32)


def refined(model: Model, changes: Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> Model:
    """The model after the mean of changes: of projections by ids, of an embedding by how often its code was met."""
    w = model.weights | {k: model.weights[k].copy() for k in ("embed", *PROJECTIONS)}
    for chunk, rows, times, sums in changes:
        mean = (sums / np.maximum(times, 1)[:, None]).astype(np.float32)
        if chunk >= 0:
            w["embed"][rows] += mean
            continue
        at = 0
        for k in PROJECTIONS:
            w[k] += mean[0, at : at + w[k].size].reshape(w[k].shape)
            at += w[k].size
    return Model(w, model.emit, model.after, model.code, model.window, model.context)


def merged_changes(parts: Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, times and sums of one chunk's parts, in order of the codes."""
    _, rows, times, sums = zip(*parts, strict=True)
    codes, where = np.unique(np.concatenate(rows), return_inverse=True)
    n, total = np.zeros(len(codes), np.int64), np.zeros((len(codes), sums[0].shape[1]))
    np.add.at(n, where, np.concatenate(times))
    at = 0
    for t, x in zip(times, sums, strict=True):  # codes are distinct within a part
        total[where[at : at + len(t)]] += x
        at += len(t)
    return codes.astype(np.int32), n, total


def _refine(blocks: DataFrame, model: Model, kind: type) -> Model:
    """Trained over all of the documents' `ids`. Tasks send a row for each CHUNK of codes that they met; the driver gets one of each."""
    sent = blocks.sparkSession.sparkContext.broadcast(model)
    schema = "chunk int, part int, ids binary, count binary, sums binary"

    def train_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = Refiner(sent.value)
        for batch in batches:
            sizes = np.asarray(pc.binary_length(batch.column("ids")), np.int64) // np.dtype(kind).itemsize
            for a, b in cuts(np.cumsum(sizes), REFINED):
                own.add(np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in batch.column("ids").slice(a, b - a)]).astype(np.int32), sizes[a:b])
        own.end()
        part = TaskContext.get().partitionId()
        if own.steps:
            for chunk, rows, times, sums in own.changes():
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int32()), "part": pa.array([part], pa.int32()), "ids": [rows.tobytes()], "count": [times.astype(np.int64).tobytes()], "sums": [sums.astype(np.float32).tobytes()]})
        del own
        give_back()

    def unpacked(rows: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        for chunk, i, n, x in zip(rows["chunk"], rows["ids"], rows["count"], rows["sums"], strict=True):
            times = np.frombuffer(n, np.int64)
            yield int(chunk), np.frombuffer(i, np.int32), times, np.frombuffer(x, np.float32).reshape(len(times), -1)

    def merged(parts: pd.DataFrame) -> pd.DataFrame:
        rows, times, sums = merged_changes(unpacked(parts.sort_values("part", kind="stable")))  # the same sum on every run
        return pd.DataFrame({"chunk": parts["chunk"].iloc[:1], "ids": [rows.tobytes()], "count": [times.tobytes()], "sums": [sums.astype(np.float32).tobytes()]})

    found = materialize(blocks.mapInArrow(train_part, schema).groupBy("chunk").applyInPandas(merged, "chunk int, ids binary, count binary, sums binary"), "lm-changes")
    model = refined(model, unpacked(found.toPandas()))  # a row for each CHUNK of the vocabulary, 16 numbers an id
    sent.unpersist()
    return model


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, max_training: int = MAX_TRAINING, seed: int = 5) -> DataFrame:
    """One row for each document row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null, empty and blank texts hold the end alone. Rows of crc32(id as text) mod 10 = 0 are held out of both models; a
    null id isn't. Repeated rows each count and each get their row. Other columns play no part; an empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    held = F.coalesce(crc_mod(F.col(id_col), 10) == 0, F.lit(False))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text"))
    ids = _word_ids(vocabulary)
    base = docs.where("not held_out")
    n = base.count()
    if n > max_training:
        base = base.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(1 << 30)) < int(max_training / n * (1 << 30)))
    sample = [(t or "").encode() for t in base.orderBy("doc_id", "text").select("text").toPandas()["text"]]
    tokens, lengths = sequences(sample, ids)
    model = train(np.split(tokens, np.cumsum(lengths)[:-1]) if len(lengths) else [], ids.end, seed=seed)
    often = Counter(w for t in sample for w in set(t.translate(LOWER_SPACE_TABLE).split()))
    frequent = np.sort(word_hashes(b" ".join(w for w, c in often.items() if c >= FREQUENT))[0])
    del sample, tokens, lengths, often
    hot_words = spark.sparkContext.broadcast(frequent)
    ranges = RANGE_FACTOR * _ranges(docs, "text")
    kind = np.uint16 if ids.end < 1 << 16 else np.int32
    names = ["kind", "block", "place", "doc_id", "held_out", "n_tokens", "ids", "words", "times", "range", "hashes"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts are read and cut once: rows of documents (DOCUMENT), of packed postings (POSTING) and of pairs' counts (PAIRS)."""
        from pyspark import TaskContext

        frequent, ids = hot_words.value, _word_ids(vocabulary)
        pairs, known = PairCounts(ids.end + 1), KnownWords(ids)

        def rows(what: int, n: int, **given) -> pa.RecordBatch:
            given = {"kind": np.full(n, what, np.int32)} | given
            return pa.RecordBatch.from_arrays([pa.array(given[c], t) if c in given else pa.nulls(n, t) for c, t in zip(names, types, strict=True)], names)

        def counted() -> pa.RecordBatch:
            chunk, keys, times = pairs.rows()
            return rows(PAIRS, len(chunk), range=chunk, hashes=keys, times=times)

        block = (TaskContext.get().partitionId() << 24) - 1
        for table, texts in text_blocks(batches, "text", BLOCK_BYTES):
            block += 1
            data, starts, met, code, n = _words(texts)
            tokens, lengths = _expand(*known.get(data, starts, met), code, n, ids.end)
            hashes, words = mix64(met), max(1, len(met))
            held, many = np.asarray(table.column("held_out"), bool), len(texts)
            learn = ~held
            pairs.add(tokens[np.repeat(learn, lengths)], lengths[learn])
            if pairs.full():
                yield counted()
            number = _places(frequent, met)
            pair, times = np.unique(np.repeat(np.arange(many), n) * words + code, return_counts=True)
            doc, word = pair // words, pair % words
            hot = number[word] >= 0
            hot_word, hot_times = number[word[hot]].astype(np.int32), times[hot].astype(np.int32)
            split = lambda x, at: [x[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            at, ends = np.searchsorted(doc[hot], np.arange(many + 1)), np.concatenate([[0], np.cumsum(lengths)])
            yield rows(DOCUMENT, many, block=np.full(many, block), place=np.arange(many), doc_id=table.column("doc_id").to_pylist(), held_out=held, n_tokens=n + 1, ids=split(tokens.astype(kind), ends), words=split(hot_word, at), times=split(hot_times, at))
            # cold words by document, hot ones once with the block's training count
            whole = np.bincount(word[hot], weights=times[hot] * ~held[doc[hot]], minlength=len(met))
            hot_at = np.flatnonzero((number >= 0) & (whole > 0))
            h = np.concatenate([hashes[word[~hot]], hashes[hot_at]])
            place = np.concatenate([doc[~hot] << 1 | held[doc[~hot]], np.full(len(hot_at), WHOLE)]).astype(np.uint64)
            count = np.concatenate([times[~hot], whole[hot_at]]).astype(np.uint64)
            order = np.argsort(h, kind="stable")
            h, place, count = h[order], place[order], count[order]
            got = pieces(h, ranges)
            planes = lambda x: [_planes(np.ascontiguousarray(x[c])) for _, c in got]
            yield rows(POSTING, len(got), block=np.full(len(got), block), words=planes(place), times=planes(count), range=[b for b, _ in got], hashes=planes(h))
        yield counted()

    packed = materialize(docs.mapInArrow(run, "kind int, block long, place long, doc_id long, held_out boolean, n_tokens long, ids binary, words binary, times binary, range int, hashes binary"), "lm-blocks")
    if n:
        pairs = merged_pairs(packed.where(F.col("kind") == PAIRS).select(F.col("range").alias("chunk"), F.col("hashes").alias("pairs"), "times"))
        for _ in range(STEPS):
            model = _step(pairs, model)
        model = _refine(packed.where((F.col("kind") == DOCUMENT) & ~F.col("held_out")).select("ids"), model, kind)

    def sums(rows: pd.DataFrame) -> pd.DataFrame:
        """Of one hash range: partial sums of each block's documents, the counts of hot words, the number of known words."""
        blocks, hashes, places, counts = rows["block"].to_numpy(), rows.pop("hashes"), rows.pop("words"), rows.pop("times")
        sizes = [len(x) // 8 for x in hashes]
        hashes = np.concatenate([_from_planes(x) for x in hashes])
        h, which = np.unique(hashes, return_inverse=True)
        del hashes
        which = which.astype(np.int32)
        place, times = np.concatenate([_from_planes(x).astype(np.int32) for x in places]), np.concatenate([_from_planes(x).astype(np.int32) for x in counts])
        del places, counts
        whole = place == WHOLE
        count = np.bincount(which, weights=times * (whole | (place & 1 == 0)), minlength=len(h))
        of = np.repeat(np.arange(len(blocks), dtype=np.int32), sizes)
        out = [pd.DataFrame({"block": [-1], "places": [np.empty(0, np.int32).tobytes()], "logs": [b""], "known": [b""], "words": [int((count > 0).sum())]})]
        hot = np.unique(which[whole])
        out.append(pd.DataFrame({"block": [-2], "places": [h[hot].tobytes()], "logs": [count[hot].tobytes()], "known": [b""], "words": [0]}))
        cold = np.flatnonzero(~whole)
        cold = cold[np.lexsort((place[cold], of[cold]))]
        of, place, times, c = of[cold], place[cold] >> 1, times[cold], count[which[cold]]
        del cold, which, whole
        if len(of):
            first = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (place[1:] != place[:-1])]))
            logs, known = np.add.reduceat(times * np.log10(c + SMOOTH), first), np.add.reduceat(times * (c > 0), first)
            of, place = of[first], place[first]
            begin = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            spans = [slice(a, b) for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(of)], strict=True)]
            out.append(pd.DataFrame({"block": blocks[of[begin]], "places": [place[s].tobytes() for s in spans], "logs": [logs[s].tobytes() for s in spans], "known": [known[s].astype(np.int32).tobytes() for s in spans], "words": 0}))
        give_back()
        return pd.concat(out)

    found = materialize(packed.where(F.col("kind") == POSTING).select("range", "block", "hashes", "words", "times").groupBy("range").applyInPandas(sums, "block long, places binary, logs binary, known binary, words long"), "lm-sums")
    distinct = found.where("block = -1").agg(F.sum("words")).first()[0] or 0
    hot_count = np.zeros(len(frequent))
    at = {int(h): i for i, h in enumerate(mix64(frequent).tolist())}
    for r in found.where("block = -2").select("places", "logs").toLocalIterator():  # a row for each range, frequent words only
        for h, c in zip(np.frombuffer(r[0], np.uint64).tolist(), np.frombuffer(r[1], np.float64).tolist(), strict=True):
            hot_count[at[h]] = c
    totals = packed.where((F.col("kind") == DOCUMENT) & ~F.col("held_out")).agg(F.sum("n_tokens"), F.count(F.lit(1))).first()
    train_tokens, ends = int(totals[0] or 0), int(totals[1])
    types = distinct + (1 if ends else 0)
    scale = float(np.log10(train_tokens + SMOOTH * (types + 1)))
    shared = spark.sparkContext.broadcast((replace(model, after=model.after[:0]), np.log10(hot_count + SMOOTH), hot_count > 0))

    def per_document(rows: pd.DataFrame) -> pd.DataFrame:
        out: list[dict] = []
        for block, part in rows.groupby("block"):
            place = np.concatenate([np.frombuffer(x, np.int32) for x in part["places"]])
            logs, known = np.concatenate([np.frombuffer(x, np.float64) for x in part["logs"]]), np.concatenate([np.frombuffer(x, np.int32) for x in part["known"]])
            at, which = np.unique(place, return_inverse=True)
            out.append(pd.DataFrame({"block": block, "place": at.astype(np.int64), "cold": np.bincount(which, weights=logs), "cold_known": np.bincount(which, weights=known).astype(np.int64)}))
        return pd.concat(out)

    cold = found.where("block >= 0").groupBy("block").applyInPandas(per_document, "block long, place long, cold double, cold_known long")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The model's score of each document's ids, and what its frequent words add to the base."""
        model, logs, known = shared.value
        for batch in batches:
            sizes = np.asarray(pc.binary_length(batch.column("ids")), np.int64) // np.dtype(kind).itemsize
            for a, b in cuts(np.cumsum(sizes), SCORED):
                part = batch.slice(a, b - a)
                tokens = np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in part.column("ids")]).astype(np.int32)
                w, t = ([np.frombuffer(x.as_buffer(), np.int32) for x in part.column(c)] for c in ("words", "times"))
                more = [pa.array(model.score(tokens, sizes[a:b])), pa.array([float(y @ logs[x]) for x, y in zip(w, t, strict=True)]), pa.array([int(y @ known[x]) for x, y in zip(w, t, strict=True)], pa.int64())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("block", "place", "held_out", "n_tokens", "doc_id")), *more], ["block", "place", "held_out", "n_tokens", "doc_id", "score", "hot", "hot_known"])
        give_back()

    plain = packed.where(F.col("kind") == DOCUMENT).select("block", "place", "held_out", "n_tokens", "doc_id", "ids", "words", "times")
    warm = plain.mapInArrow(finish, "block long, place long, held_out boolean, n_tokens long, doc_id long, score double, hot double, hot_known long")
    both = warm.join(cold, ["block", "place"], "left")
    end_log = float(np.log10(ends + SMOOTH))
    return both.select(
        "doc_id", "held_out", "n_tokens", (F.col("hot_known") + F.coalesce("cold_known", F.lit(0)) + (1 if ends else 0)).cast("long").alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("hot") + F.coalesce("cold", F.lit(0.0)) + end_log - F.col("n_tokens") * scale).alias("base_score"), "score",
    )

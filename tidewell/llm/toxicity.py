"""Toxicity by nearest labelled examples: exact TF-IDF cosine over two inverted indexes.

All words of every labelled example span the vectors of the first index. It finds each example whose cosine to a text is
CLOSE or more: the words a text needs to be that close to anything (its rarest ones) give the candidates, and their
cosines are exact. Close examples vote by a high power of their cosine against the second index's probability, so that copies decide.

The second index is an addition for texts that are like no single example. Terms that tell the labels apart (chi-square over the labelled sample, at a level that a term without any
connection passes once in all terms) span the vectors. Examples are ordered so that like ones share a
block of 64; for each term and block the index keeps the largest impact. A query takes blocks in order of
their upper bound and stops when the bound falls below its k-th best similarity, so the k nearest are
exact. Its votes are weighted by squared similarity; they are shrunk to the prior and calibrated on leave-one-out votes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from .common import crc_mod, give_back, text_blocks
from .decontaminate import WORD_TABLE
from .quality import labelled_sample

#: Labelled rows to learn from, about; more are sampled by a hash of their id.
MAX_LABELLED = 10000
MIN_DF = 3
NEIGHBOURS = 10
#: Weight of the prior against the neighbours' squared similarities: distant ones alone decide little.
SHRINK = 1.0
BLOCK = 64
#: Cosine over all words from which an example is close, and the weight and power of its vote.
CLOSE = 0.7
COPY = 40.0
POWER = 8
#: Postings read to sort out candidates, beyond those that must be read.
PROBE = 4000
THRESHOLD = 0.7
BLOCK_BYTES = 1 << 20


@dataclass
class CloseIndex:
    """All words: ids by word, and the unit vectors of the examples by word (postings) and by example; float32.

    starts[i] : starts[i + 1] are the examples of word i, rows[j] : rows[j + 1] the words of example j.
    """

    words: dict[bytes, int]
    idf: np.ndarray
    rare: float
    starts: np.ndarray
    where: np.ndarray
    rows: np.ndarray
    which: np.ndarray
    weight: np.ndarray
    order: np.ndarray

    @cached_property
    def query(self) -> np.ndarray:
        """A weight for each word, zero between uses."""
        return np.zeros(len(self.words))

    def vector(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Words known here and their weights in the unit vector of all words of a text, known or not."""
        n = Counter(words)
        at = np.fromiter((self.words.get(w, -1) for w in n), np.int64, len(n))
        tf = 1 + np.log(np.fromiter(n.values(), np.float64, len(n)))
        tf *= np.where(at >= 0, self.idf[at], self.rare) if len(self.idf) else self.rare
        norm = np.sqrt((tf * tf).sum())
        known = at >= 0
        return at[known], tf[known] / norm if norm else tf[known]

    def nearest(self, words: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of largest cosine, of CLOSE and more; ties to the smaller position."""
        at, w = self.vector(words)
        df = self.starts[at + 1] - self.starts[at]
        by = np.argsort(df, kind="stable")
        at, w, df = at[by], w[by], df[by]
        # an example without any of the first words reaches at most the norm of the rest
        rest = np.sqrt(np.maximum(np.cumsum((w * w)[::-1])[::-1], 0))
        n = int(np.searchsorted(-rest, -(CLOSE - 1e-6), side="right"))
        if not n or not df[:n].sum():
            return np.empty(0, np.int64), np.empty(0)
        n = max(n, int(np.searchsorted(np.cumsum(df), PROBE, side="right")))
        spot = np.repeat(self.starts[at[:n]] - (np.cumsum(df[:n]) - df[:n]), df[:n]) + np.arange(df[:n].sum())
        dots = np.bincount(self.where[spot], weights=self.weight[self.order[spot]] * np.repeat(w[:n], df[:n]), minlength=len(self.rows) - 1)
        left = rest[n] if n < len(rest) else 0.0
        found = np.flatnonzero((dots > 0) & (dots + left >= CLOSE - 1e-6))
        if not len(found):
            return found, np.empty(0)
        query = self.query
        query[at] = w
        size = self.rows[found + 1] - self.rows[found]
        first = np.cumsum(size) - size
        spot = np.repeat(self.rows[found] - first, size) + np.arange(size.sum())
        sims = np.add.reduceat(query[self.which[spot]] * self.weight[spot], first)
        query[at] = 0
        near = sims >= CLOSE
        found, sims = found[near], np.minimum(sims[near], 1.0)
        order = np.lexsort((found, -np.round(sims, 6)))[:k]
        return found[order], sims[order]


def close_index(texts: Iterable[list[bytes]]) -> CloseIndex:
    """Of texts as words. Rows hold their words ascending; postings point into the rows."""
    words: dict[bytes, int] = {}
    at, tf, rows = [], [], [0]
    for text in texts:
        n = Counter(text)
        at.append(np.fromiter((words.setdefault(w, len(words)) for w in n), np.int32, len(n)))
        tf.append(np.fromiter(n.values(), np.float32, len(n)))
        rows.append(rows[-1] + len(n))
    which, weight = np.concatenate([np.empty(0, np.int32), *at]), np.concatenate([np.empty(0, np.float32), *tf])
    del at, tf
    df = np.bincount(which, minlength=len(words))
    size, rows = len(rows) - 1, np.asarray(rows)
    idf = np.log((1 + size) / (1 + df)) + 1
    owner = np.repeat(np.arange(size, dtype=np.int32), np.diff(rows))
    scaled = idf[which]
    scaled *= 1 + np.log(np.maximum(weight, 1))
    if len(owner):
        scaled /= np.sqrt(np.bincount(owner, weights=scaled * scaled, minlength=size))[owner]
    weight = scaled.astype(np.float32)
    del scaled
    order = np.argsort(which, kind="stable").astype(np.int32)
    return CloseIndex(words, idf, float(np.log(1.0 + size) + 1), np.concatenate([[0], np.cumsum(df)]), owner[order], rows, which, weight, order)


@dataclass
class ToxicityIndex:
    """terms: word to column; per term, postings by example in order, cut by `cuts[term, block]`; bounds[term, block]: largest impact."""

    terms: dict[bytes, int]
    idf: np.ndarray
    example_ids: np.ndarray
    labels: np.ndarray
    cuts: np.ndarray
    where: np.ndarray
    impact: np.ndarray
    bounds: np.ndarray
    prior: float
    bare: float
    slope: float = 1.0
    shift: float = 0.0
    k: int = NEIGHBOURS
    seen: dict = field(default_factory=dict)
    close: CloseIndex = field(default_factory=lambda: close_index([]))
    close_ids: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    close_labels: np.ndarray = field(default_factory=lambda: np.empty(0, int))

    def vector(self, words: list[bytes]) -> tuple[tuple[int, float], ...]:
        """Unit TF-IDF vector over the index's terms, as (term, weight) ascending; empty if no term occurs."""
        get = self.terms.get
        n = Counter(t for t in map(get, words) if t is not None)
        if not n:
            return ()
        got = sorted(n)
        w = (1 + np.log([n[t] for t in got])) * self.idf[got]
        w /= np.sqrt((w * w).sum())
        return tuple(zip(got, w.tolist(), strict=True))

    def nearest(self, vector: tuple[tuple[int, float], ...], skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of largest cosine (positive ones only), ties to the smaller position; `skip` is left out."""
        terms = [t for t, _ in vector]
        weights = np.asarray([w for _, w in vector])
        bound = weights @ self.bounds[terms]
        best = np.empty(0, np.int64)
        sims = np.empty(0)
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] <= 0 or len(best) >= self.k and bound[b] + 1e-9 < sims[self.k - 1]:
                break
            acc = np.zeros(BLOCK)
            for t, w in vector:
                lo, hi = self.cuts[t, b], self.cuts[t, b + 1]
                acc[self.where[lo:hi] - b * BLOCK] += w * self.impact[lo:hi]
            live = np.flatnonzero(acc > 0)
            at = live + b * BLOCK
            keep = at != skip
            best, sims = np.concatenate([best, at[keep]]), np.concatenate([sims, acc[live][keep]])
            order = np.lexsort((best, -np.round(sims, 9)))[: self.k]
            best, sims = best[order], sims[order]
        return best, sims

    def vote(self, best: np.ndarray, sims: np.ndarray) -> float:
        return float((sims**2 @ self.labels[best] + SHRINK * self.prior) / ((sims**2).sum() + SHRINK)) if len(best) else self.prior

    def calibrated(self, vote: float) -> float:
        p = min(max(vote, 1e-6), 1 - 1e-6)
        return float(1 / (1 + np.exp(-(self.slope * np.log(p / (1 - p)) + self.shift))))

    def score(self, text: bytes) -> tuple[float, list[dict], list[str]]:
        """Probability of label 1, the close and the nearest examples (each once, by similarity), and the text's telling terms."""
        words = text.translate(WORD_TABLE).split()
        v = self.vector(words)
        near, close = self.close.nearest(words, self.k)
        if v not in self.seen:
            if len(self.seen) > 2000:
                self.seen.clear()
            self.seen[v] = self.nearest(v) if v else (np.empty(0, np.int64), np.empty(0))
        best, sims = self.seen[v]
        p = self.calibrated(self.vote(best, sims)) if len(best) else self.bare
        if len(near):
            c = COPY * close**POWER
            p = float((c @ self.close_labels[near] + SHRINK * p) / (c.sum() + SHRINK))
        found: dict[int, tuple[float, int]] = {}
        for i, s, y in [*zip(self.close_ids[near].tolist(), close.tolist(), self.close_labels[near].tolist(), strict=True), *zip(self.example_ids[best].tolist(), sims.tolist(), self.labels[best].tolist(), strict=True)]:
            found.setdefault(i, (s, y))
        return p, [{"doc_id": int(i), "similarity": float(s), "label": int(y)} for i, (s, y) in found.items()], [self.names[t] for t, _ in v]

    @cached_property
    def names(self) -> list[str]:
        return [t.decode(errors="replace") for t in self.terms]


def build(ids: list[int], texts: list[bytes], labels: np.ndarray, k: int = NEIGHBOURS, min_df: int = MIN_DF) -> ToxicityIndex:
    """Index of the labelled texts; equal texts with equal labels count once. Without labels everything scores the prior, 0.5."""
    once: dict[tuple[bytes, int], int] = {}
    for i, (t, y) in enumerate(zip(texts, labels.tolist(), strict=True)):
        once.setdefault((t, int(y)), i)
    kept = sorted(once.values(), key=lambda i: ids[i])
    words = lambda: (texts[i].translate(WORD_TABLE).split() for i in kept)  # noqa: E731  made anew each time, never held
    y = np.asarray([int(labels[i]) for i in kept])
    n, pos = len(y), int(y.sum())
    df_pos: Counter[bytes] = Counter()
    for w, label in zip(words(), y.tolist(), strict=True):
        if label:
            df_pos.update(set(w))
    df_pos = Counter({t: c for t, c in df_pos.items() if c >= min_df})
    df: Counter[bytes] = Counter()
    for w in words():
        df.update(df_pos.keys() & set(w))
    # copies of one text are one witness: a term's texts of label 1 count by the share of its occurrences there that have neighbouring words of their own
    often: Counter[bytes] = Counter()
    around: dict[bytes, set] = {t: set() for t in df_pos}
    for w, label in zip(words(), y.tolist(), strict=True):
        if label:
            for before, t, after in zip([b"", *w], w, [*w[1:], b""], strict=False):
                if t in around:
                    often[t] += 1
                    around[t].add((before, after))
    for t, pairs in around.items():
        witnesses = df_pos[t] * len(pairs) // often[t]
        df[t] -= df_pos[t] - witnesses
        df_pos[t] = witnesses
    candidates = sorted(t for t in around if df_pos[t] >= min_df)
    level = 2 * np.log(max(2, len(candidates)))

    def telling(t: bytes) -> bool:
        a, c = df_pos[t], df[t]
        even = c * (n - c) * pos * (n - pos)
        return even > 0 and a * n > c * pos and n * (a * n - c * pos) ** 2 / even >= level

    terms = {t: i for i, t in enumerate(t for t in candidates if telling(t))}
    idf = np.log((1 + n) / (1 + np.asarray([df[t] for t in terms], float))) + 1
    del around, often, df, df_pos, candidates  # before the index of all words is made
    prior = (pos + 1) / (n + 2)
    empty = np.empty(0)
    index = ToxicityIndex(terms, idf, np.empty(0, np.int64), np.empty(0, int), np.zeros((len(terms), 1), np.int64), empty.astype(np.int64), empty, np.zeros((len(terms), 0)), prior, prior, k=k)
    vectors = [index.vector(w) for w in words()]
    bare = [int(label) for v, label in zip(vectors, y.tolist(), strict=True) if not v]
    index.bare = (sum(bare) + prior) / (len(bare) + 1)
    order = sorted((i for i, v in enumerate(vectors) if v), key=lambda i: (max(vectors[i], key=lambda x: x[1])[0], vectors[i], i))
    blocks = -(-len(order) // BLOCK)
    index.example_ids, index.labels = np.asarray([ids[kept[i]] for i in order], np.int64), y[order] if order else np.empty(0, int)
    rows = [(t, at, w) for at, i in enumerate(order) for t, w in vectors[i]]
    rows.sort()
    t, at, w = (np.asarray(x) for x in zip(*rows, strict=True)) if rows else (empty.astype(int), empty.astype(int), empty)
    key = t * (blocks + 1) + at // BLOCK
    index.cuts = np.searchsorted(key, (np.arange(len(terms))[:, None] * (blocks + 1) + np.arange(blocks + 1)[None, :]))
    index.where, index.impact = at, w
    index.bounds = np.zeros((len(terms), blocks))
    np.maximum.at(index.bounds, (t, at // BLOCK), w)
    index.close, index.close_ids, index.close_labels = close_index(words()), np.asarray([ids[i] for i in kept], np.int64), y
    _calibrate(index, [vectors[i] for i in order])
    return index


def _calibrate(index: ToxicityIndex, vectors: list) -> None:
    """Logistic slope and shift of leave-one-out votes, with smoothed targets, by damped Newton steps."""
    if len(vectors) < 20 or len(set(index.labels.tolist())) < 2:
        return
    votes = np.asarray([index.vote(*index.nearest(v, skip=i)) for i, v in enumerate(vectors)])
    p = np.clip(votes, 1e-6, 1 - 1e-6)
    x = np.stack([np.log(p / (1 - p)), np.ones(len(p))], 1)
    pos = index.labels.sum()
    target = np.where(index.labels == 1, (pos + 1) / (pos + 2), 1 / (len(p) - pos + 2))
    b = np.array([1.0, 0.0])
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (q - target) + np.array([b[0] - 1, b[1]])
        b -= np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + np.eye(2), grad)
        b = np.clip(b, [0.2, -4], [5, 4])
    index.slope, index.shift = float(b[0]), float(b[1])


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED, k: int = NEIGHBOURS) -> ToxicityIndex:
    """Learn from a bounded sample of the labelled documents outside the held-out fold (crc32 of the id mod 3 is 1)."""
    rows = labelled_sample(docs, labels, label_col, id_col, text_col, max_labelled).toPandas().sort_values(["_id_", "label"], kind="stable")
    ids, texts, known = rows["_id_"].tolist(), [(t or "").encode() for t in rows.text], rows.label.to_numpy()
    del rows
    index = build(ids, texts, known, k)
    del texts
    give_back()  # the driver's share
    return index


def score(docs: DataFrame, index: ToxicityIndex, text_col: str = "text", name: str = "toxicity", keep: list[str] | None = None, evidence: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs (or their columns `keep`) with the probability of label 1 and, if asked for, `evidence` and `evidence_terms`.

    Null texts are empty; a text without telling terms and close examples gets the share of label 1 among the examples
    without telling terms. Columns of the new names are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(index)
    extra = [name, *(["evidence", "evidence_terms"] if evidence else [])]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in extra]
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("label", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, texts in text_blocks(batches, text_col, block_bytes):
            got = [sent.value.score(t) for t in texts]
            out = table.select(kept).append_column(name, pa.array([g[0] for g in got], pa.float64()))
            if evidence:
                out = out.append_column("evidence", pa.array([g[1] for g in got], kind)).append_column("evidence_terms", pa.array([g[2] for g in got], pa.list_(pa.string())))
            yield from out.combine_chunks().to_batches()

    rows = docs.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*kept, text_col])))
    example = StructType([StructField("doc_id", LongType()), StructField("similarity", DoubleType()), StructField("label", IntegerType())])
    more = [StructField("evidence", ArrayType(example)), StructField("evidence_terms", ArrayType(StringType()))] if evidence else []
    return rows.mapInArrow(run, StructType([*(rows.schema[c] for c in kept), StructField(name, DoubleType()), *more]))


def toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED, k: int = NEIGHBOURS) -> DataFrame:
    """Learn, then score all documents: doc_id, held_out, score, predicted, evidence, evidence_terms. Repeated rows each get theirs."""
    index = fit(docs, labels, label_col, id_col, text_col, max_labelled, k)
    out = score(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), index, keep=["doc_id"])
    held = F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"), "evidence", "evidence_terms")

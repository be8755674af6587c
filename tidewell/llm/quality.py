"""Quality classifier: averaged word and character n-gram embeddings under a softmax, trained with numpy SGD.

A document's features are its words and the byte 3- to 5-grams inside its words (a blank marks either end of
a word), hashed into one table of vectors. The document vector is their mean; a linear layer and a softmax
give the class. Because everything after the table is linear up to the softmax, a trained model scores a
text through one number for each hashed feature: no document ever needs its embedding matrix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import ASCII_SPACE, crc_mod, give_back, mix64, text_blocks, word_hashes

#: Labelled rows to train on, about; more are sampled by a hash of their id, which bounds the driver's work.
MAX_LABELLED = 5000
BITS = 18
DIM = 10
#: Documents to step over in all; a small sample is gone through more often.
STEPS = 20000
RATE = 0.2
#: A feature carries its share of a mean, so steps on its vector are that much longer.
SPREAD = 20.0
NGRAMS = (3, 4, 5)
THRESHOLD = 0.5
BLOCK_BYTES = 1 << 19
SPACES = bytes(32 if b in ASCII_SPACE else b for b in range(256))


def block_features(texts: list[bytes], bits: int = BITS, ngrams: tuple[int, ...] = NGRAMS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For words, for pairs of neighbouring words and for n-grams in words: feature ids of all texts, and the text of each.

    A pair counts only by whether both words are equal, as repetition is a trait of its own and pairs as such are too rare to learn.
    """
    data = b" " + b" ".join(t.translate(SPACES) for t in texts) + b" "
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    owner_at = np.concatenate([[0], np.cumsum(lengths)])
    shift = np.uint64(64 - bits)
    a = np.frombuffer(data, np.uint8)
    h, at = word_hashes(data)
    word_owner = np.searchsorted(owner_at, at, side="right") - 1
    near = np.flatnonzero(word_owner[1:] == word_owner[:-1])
    same = (h[near] == h[near + 1]).astype(np.int32)
    out = [((mix64(h + np.uint64(7)) >> shift).astype(np.int32), word_owner), (same, word_owner[near])]
    blank = a == 32
    wide = a.astype(np.uint64)
    code = wide.copy()
    ids, owners = [], []
    for n in range(2, max(ngrams) + 1):
        if len(a) < n:
            break
        code = (code[:-1] << np.uint64(8)) | wide[n - 1 :]
        if n in ngrams:
            inner = np.zeros(len(code), bool)
            for k in range(1, n - 1):
                inner |= blank[k : k + len(code)]
            live = np.flatnonzero(~inner)
            ids.append((((code[live] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int32))
            owners.append(live)
    at = np.concatenate(owners) if owners else np.empty(0, np.int64)
    return [*out, (np.concatenate(ids) if ids else np.empty(0, np.int32), np.searchsorted(owner_at, at, side="right") - 1)]


@dataclass
class QualityModel:
    """weight: what a feature adds to the log-odds of label 1, before averaging; bias: log-odds of a text without features."""

    weight: np.ndarray
    bias: float
    bits: int
    ngrams: tuple[int, ...]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        odds = np.full(len(texts), self.bias)
        for ids, owner in block_features(texts, self.bits, self.ngrams):
            n = np.bincount(owner, minlength=len(texts))
            odds += np.bincount(owner, weights=self.weight[ids], minlength=len(texts)) / np.maximum(n, 1)
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


def train(texts: list[bytes], labels: np.ndarray, bits: int = BITS, dim: int = DIM, steps: int = STEPS, rate: float = RATE, ngrams: tuple[int, ...] = NGRAMS, seed: int = 1) -> QualityModel:
    """Stochastic gradient descent, one document a step, with a linearly falling rate. Without both labels, the model gives their share."""
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, int)
    share = (y.sum() + 1) / (len(y) + 2)
    prior = float(np.log(share / (1 - share)))
    if len(set(y.tolist())) < 2:
        return QualityModel(np.zeros(1 << bits, np.float32), prior, bits, ngrams)
    bags = []
    for t in texts:
        found = [(ids, np.full(len(ids), 1 / max(1, len(ids)))) for ids, _ in block_features([t], bits, ngrams)]
        ids, back = np.unique(np.concatenate([x[0] for x in found]), return_inverse=True)
        bags.append((ids, np.bincount(back, weights=np.concatenate([x[1] for x in found]), minlength=len(ids)).astype(np.float32)))
    table = (rng.random((1 << bits, dim), np.float32) - 0.5) / dim
    out = np.zeros((2, dim), np.float32)
    bias = np.array([0, prior], np.float32)
    epochs = -(-steps // len(bags))
    step, steps = 0, epochs * len(bags)
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            ids, part = bags[i]
            step += 1
            if not len(ids):
                continue
            lr = rate * (1 - step / (steps + 1))
            v = part @ table[ids]
            z = out @ v + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            grad = p @ out
            out -= lr * p[:, None] * v[None, :]
            bias -= 0.1 * lr * p
            table[ids] -= (lr * SPREAD) * part[:, None] * grad[None, :]
    weight = table @ (out[1] - out[0])
    return QualityModel(weight.astype(np.float32), float(bias[1] - bias[0]), bits, ngrams)


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, max_labelled: int, fold: tuple[int, int] = (3, 1)) -> DataFrame:
    """About max_labelled rows (text, label) of labelled documents outside the held-out fold, chosen by a hash of the id.

    Null labels and ids don't count; where a document has several labels, the smallest does.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (crc_mod(F.col(id_col), fold[0]) != fold[1])).groupBy(id_col).agg(F.min(label_col).cast("int").alias("_label_"))
    n = known.count()
    if n > max_labelled:
        known = known.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < int(max_labelled / n * (1 << 30)))
    keys = F.broadcast(known.withColumnRenamed(id_col, "_key_"))  # at most about max_labelled rows
    return docs.select(F.col(id_col).alias("_id_"), F.col(text_col).alias("text")).join(keys, F.col("_id_") == F.col("_key_")).select("_id_", "text", F.col("_label_").alias("label"))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED, seed: int = 1) -> QualityModel:
    """Train on a bounded sample of the labelled documents outside the held-out fold (crc32 of the id mod 3 is 1)."""
    rows = labelled_sample(docs, labels, label_col, id_col, text_col, max_labelled).toPandas().sort_values(["_id_", "label"], kind="stable")
    texts, known = [(t or "").encode() for t in rows.text], rows.label.to_numpy()
    del rows
    model = train(texts, known, seed=seed)
    del texts
    give_back()  # the driver's share
    return model


def score(docs: DataFrame, model: QualityModel, text_col: str = "text", name: str = "quality_score", keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs (or their columns `keep`) with one more column, the probability of label 1.

    Null texts are empty; rows without features get the prior. `name` replaces a column of that name.
    """
    return add_scores(docs, model.scores, text_col, name, keep, block_bytes)


def add_scores(docs: DataFrame, model_scores: Callable[[list[bytes]], np.ndarray], text_col: str, name: str, keep: list[str] | None, block_bytes: int) -> DataFrame:
    """docs (or their columns `keep`) with a double column of what model_scores gives for blocks of UTF-8 texts."""
    sent = docs.sparkSession.sparkContext.broadcast(model_scores)
    kept = [c for c in (docs.columns if keep is None else keep) if c != name]
    read = list(dict.fromkeys([*kept, text_col]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, texts in text_blocks(batches, text_col, block_bytes):
            yield from table.select(kept).append_column(name, pa.array(sent.value(texts), pa.float64())).combine_chunks().to_batches()

    out = docs.select(*(F.col(f"`{c}`") for c in read))
    return out.mapInArrow(run, StructType([*(out.schema[c] for c in kept), StructField(name, DoubleType())]))


def quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Train, then score all documents: doc_id, held_out, score, predicted. Repeated rows each get theirs; without labels every score is 0.5."""
    model = fit(docs, labels, label_col, id_col, text_col, max_labelled)
    out = score(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model, keep=["doc_id"])
    held = F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))

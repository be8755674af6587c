"""Near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors with cosine >= t have squared distance <= D = 2 - 2t. They are rotated (a fixed random rotation spreads
the distance over all coordinates) and split into low-dimensional blocks; a block of s of d coordinates gets the budget
D*s/d, and every pair within D is within budget in at least one block. Each block is a range join over a grid on all of
its coordinates, with cells as wide as the budget's root: only points of the same or of touching cells are compared, by
their distance in the block alone. Going on around the ring of blocks, some block of a pair within D keeps every running sum
of distances within the running sum of budgets, so a pair that exceeds it in the next blocks leaves again. The union of
what remains is verified by the exact cosine, each pair once.

A label's vectors are cut into parts of bounded size, near ones together; a task joins two parts, so every vector
crosses the network once for each part that its own may meet, and parts whose bounding boxes lie more than D apart never
meet. Tasks give link counts and a forest, never all pairs. Equal vectors are one vector with a weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cuts, gapless_rank, materialize

THRESHOLD = 0.93
#: Coordinates of a block.
SUBSPACE = 4
#: Vectors of a part: a task holds two parts and a bit for each pair of them.
TILE = 2048
#: Pairs compared at a time, and those of two cells from which they are compared as a matrix.
CHUNK = 1 << 18
DENSE = 1 << 10
#: Blocks after the first that a candidate is followed into.
RING = 3
SLACK = 1e-9


def rotation(d: int) -> np.ndarray:
    """A random orthogonal matrix that depends on d only."""
    q, r = np.linalg.qr(np.random.default_rng(20_000 + d).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def block_cuts(d: int, size: int = SUBSPACE) -> list[int]:
    blocks = -(-d // max(1, size))
    return [round(i * d / blocks) for i in range(blocks + 1)]


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


class _Forest:
    """Roots of rows; a batch of links is merged by its few pairs of different roots."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, x: np.ndarray, y: np.ndarray) -> None:
        while True:
            a, b = self.root[x], self.root[y]
            apart = a != b
            if not apart.any():
                return
            # each root takes the least root that it meets, and all rows follow
            low, high = np.minimum(a[apart], b[apart]), np.maximum(a[apart], b[apart])
            np.minimum.at(self.root, high, low)
            while not np.array_equal(self.root, up := self.root[self.root]):
                self.root = up


class _Tile:
    """The pairs of one tile: rows before n_home with those behind or, if there are none behind, with one another."""

    def __init__(self, weights: np.ndarray, u: np.ndarray, n_home: int, threshold: float, size: int):
        n, d = u.shape
        self.u, self.threshold, self.weights = u, threshold, weights
        self.alone = n_home == n
        self.home, self.other = np.arange(n_home), np.arange(0 if self.alone else n_home, n)
        #: pairs that need no more; of a tile with itself both ways round
        self.seen = np.eye(n, dtype=bool) if self.alone else np.zeros((n_home, len(self.other)), bool)
        self.counts, self.forest = np.zeros(n, np.int64), _Forest(n)
        self.compared = self.verified = 0
        z, edges = u @ rotation(d), block_cuts(d, size)
        self.parts = [np.ascontiguousarray(z[:, a:b]) for a, b in zip(edges, edges[1:], strict=False)]
        self.budgets = [(2 - 2 * threshold) * (b - a) / d + SLACK for a, b in zip(edges, edges[1:], strict=False)]
        for block in range(len(self.parts)):
            self.join(block)

    def join(self, block: int) -> None:
        """Range join of one block: cells of the home rows meet the touching cells of the others."""
        part, budget = self.parts[block], self.budgets[block]
        width = np.sqrt(budget) * (1 + 1e-12) + 1e-300
        cell = np.floor(part / width).astype(np.int64)
        cell -= cell.min(axis=0) - 1
        scale = np.concatenate([[1], np.cumprod(cell.max(axis=0)[:-1] + 2)])
        key = cell @ scale
        home = self.home[np.argsort(key[self.home], kind="stable")]
        other = self.other[np.argsort(key[self.other], kind="stable")]
        mine, a0 = np.unique(key[home], return_index=True)
        theirs, b0 = np.unique(key[other], return_index=True)
        a1, b1 = np.append(a0[1:], len(home)), np.append(b0[1:], len(other))
        steps = np.asarray(list(product((-1, 0, 1), repeat=part.shape[1]))) @ scale
        if self.alone:
            steps = steps[steps >= 0]  # the other half is the same pairs
        pairs_a, pairs_b = [], []
        for step in np.unique(steps).tolist():
            at = np.searchsorted(theirs, mine + step)
            at[at == len(theirs)] = 0
            hit = np.flatnonzero(theirs[at] == mine + step)
            pairs_a.append(hit)
            pairs_b.append(at[hit])
        ca, cb = np.concatenate(pairs_a), np.concatenate(pairs_b)
        na, nb = a1[ca] - a0[ca], b1[cb] - b0[cb]
        big = na * nb >= DENSE
        for i, j in zip(ca[big].tolist(), cb[big].tolist(), strict=True):
            for first in range(a0[i], a1[i], 512):
                self.matrix(block, home[first : min(first + 512, a1[i])], other[b0[j] : b1[j]])
        ca, cb, na, nb = ca[~big], cb[~big], na[~big], nb[~big]
        total = np.cumsum(na * nb)
        for at, stop in cuts(total, CHUNK):
            n, m = na[at:stop] * nb[at:stop], nb[at:stop]
            flat = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            x = home[np.repeat(a0[ca[at:stop]], n) + flat // np.repeat(m, n)]
            y = other[np.repeat(b0[cb[at:stop]], n) + flat % np.repeat(m, n)]
            self.listed(block, x, y)

    def listed(self, block: int, x: np.ndarray, y: np.ndarray) -> None:
        self.compared += len(x)
        distance = self.distance(block, x, y)
        near = distance <= self.budgets[block]
        self.candidates(block, x[near], y[near], distance[near])

    def distance(self, block: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        gap = self.parts[block][x] - self.parts[block][y]
        return np.einsum("ns,ns->n", gap, gap)

    def candidates(self, block: int, x: np.ndarray, y: np.ndarray, distance: np.ndarray) -> None:
        """New pairs within budget in this block, as far as they stay within it around the ring."""
        new = ~self.seen[x, y - self.other[0]]
        x, y, distance, limit = x[new], y[new], distance[new], self.budgets[block]
        for step in range(1, min(RING + 1, len(self.parts))):
            after = (block + step) % len(self.parts)
            distance = distance + self.distance(after, x, y)
            limit += self.budgets[after]
            self.compared += len(x)
            near = distance <= limit
            x, y, distance = x[near], y[near], distance[near]
        self.verify(x, y)

    def matrix(self, block: int, x: np.ndarray, y: np.ndarray) -> None:
        """The same for all pairs of two cells; where most are new candidates, their cosines are a matrix too."""
        new = ~self.seen[np.ix_(x, y - self.other[0])]
        if not new.any():
            return
        p, q = self.parts[block][x], self.parts[block][y]
        self.compared += len(x) * len(y)
        distance = np.maximum((p * p).sum(axis=1)[:, None] + (q * q).sum(axis=1) - 2 * (p @ q.T), 0)
        near = new & (distance <= self.budgets[block] + SLACK)
        i, j = np.nonzero(near)
        if 4 * len(i) < near.size:
            self.candidates(block, x[i], y[j], distance[i, j])
            return
        self._mark(x[i], y[j])
        if self.alone:  # cells that share rows list a pair twice
            near &= (x[:, None] < y) | ~(np.isin(x, y)[:, None] & np.isin(y, x))
        self.verified += int(near.sum())
        same = near & (self.u[x] @ self.u[y].T >= self.threshold)
        self.counts[x] += same @ self.weights[y]
        self.counts[y] += same.T @ self.weights[x]
        i, j = np.nonzero(same)
        self.forest.link(x[i], y[j])

    def _mark(self, x: np.ndarray, y: np.ndarray) -> None:
        self.seen[x, y - self.other[0]] = True
        if self.alone:
            self.seen[y, x] = True

    def verify(self, x: np.ndarray, y: np.ndarray) -> None:
        """Exact cosines of candidates that are new."""
        if self.alone and len(x):  # a cell that meets itself lists a pair twice
            once = np.unique(np.minimum(x, y) * len(self.u) + np.maximum(x, y))
            x, y = once // len(self.u), once % len(self.u)
        self._mark(x, y)
        self.verified += len(x)
        for at in range(0, len(x), 1 << 15):
            a, b = x[at : at + (1 << 15)], y[at : at + (1 << 15)]
            same = np.einsum("nd,nd->n", self.u[a], self.u[b]) >= self.threshold
            a, b = a[same], b[same]
            self.counts += np.bincount(a, weights=self.weights[b], minlength=len(self.u)).astype(np.int64) + np.bincount(b, weights=self.weights[a], minlength=len(self.u)).astype(np.int64)
            self.forest.link(a, b)


def tile_links(weights: np.ndarray, u: np.ndarray, n_home: int, threshold: float, size: int = SUBSPACE) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Weighted link counts of each row of a tile, the root of each row's links here, and how many pairs were compared in a block and verified."""
    tile = _Tile(weights, u, n_home, threshold, size)
    return tile.counts, tile.forest.root, tile.compared, tile.verified


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, size: int = SUBSPACE, tile: int = TILE) -> DataFrame:
    """One row for each row: vec_id, n_links, component_id, kept.

    Only vectors of equal, non-null labels and of equal lengths are compared. Null, empty, zero or non-finite vectors,
    and those holding nulls, link with nothing and are their own component. Repeated rows link with each other like
    any equal vectors; a null id never names a component and isn't kept. Other columns play no part; an empty table
    gives an empty result. Equal vectors are known by two 64-bit hashes.
    """
    v = F.col("vector")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    bad = v.isNull() | F.col("label").isNull() | F.coalesce(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True)) | ~F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("good", ~bad).withColumn("h1", F.when(F.col("good"), F.xxhash64("label", "vector"))).withColumn("h2", F.when(F.col("good"), F.xxhash64("vector", "label", F.lit(7))))
    ids = materialize(rows.select("vec_id", "h1", "h2"), "vectors")
    reps = rows.where("good").groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("weight"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    reps = materialize(reps.withColumn("key", F.monotonically_increasing_id()), "distinct-vectors")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Unit vectors, and the signs of their first rotated coordinates: vectors close to each other have most signs in common."""
        for batch in batches:
            lists = batch.column("vector").to_pylist()
            for d in {len(x) for x in lists}:
                at = [i for i, x in enumerate(lists) if len(x) == d]
                u = unit(np.asarray([lists[i] for i in at]))
                signs = (u @ rotation(d))[:, :16] > 0
                picked = batch.take(pa.array(at))
                side = signs @ (1 << np.arange(signs.shape[1])[::-1])
                yield pa.RecordBatch.from_arrays([*(picked.column(c) for c in ("key", "weight", "label")), pa.array([x.tobytes() for x in u], pa.binary()), pa.array([d] * len(at), pa.int32()), pa.array(side, pa.int64())], ["key", "weight", "label", "data", "d", "side"])

    where = ["label", "d"]
    units = materialize(reps.select("key", "weight", "label", "vector").mapInArrow(place, "key long, weight long, label string, data binary, d int, side long"), "unit-vectors")
    ranked = gapless_rank(units.drop("data", "weight"), where, ["key"], "rank", F.col("side") * 64 + F.pmod(F.xxhash64("key"), F.lit(64)))
    parts = ranked.select("key", F.floor(F.col("rank") / tile).cast("int").alias("part"))
    units = materialize(units.drop("side").join(parts, "key"), "parts")

    def box(t: pd.DataFrame) -> pd.DataFrame:
        d = int(t["d"].iloc[0])
        z = np.frombuffer(b"".join(t["data"]), np.float64).reshape(len(t), d) @ rotation(d)
        return t.iloc[:1][[*where, "part"]].assign(low=[z.min(axis=0).tolist()], high=[z.max(axis=0).tolist()])

    boxes = materialize(units.select(*where, "part", "data").groupBy(*where, "part").applyInPandas(box, "label string, d int, part int, low array<double>, high array<double>"), "boxes")
    other = boxes.select(*where, F.col("part").alias("j"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    gap = F.zip_with(F.zip_with("low", "high2", lambda a, b: a - b), F.zip_with("low2", "high", lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0)))
    apart = F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g)
    tiles = boxes.withColumnRenamed("part", "i").join(other, where).where((F.col("i") <= F.col("j")) & (apart <= 2 - 2 * threshold + SLACK)).select(*where, "i", "j")
    tiles = materialize(tiles, "tiles")
    sides = tiles.select(*where, F.col("i").alias("part"), "i", "j").union(tiles.where("i < j").select(*where, F.col("j").alias("part"), "i", "j"))
    tiled = units.join(sides, [*where, "part"]).select("key", "weight", "data", *where, "part", "i", "j")

    def compare(t: pd.DataFrame) -> pd.DataFrame:
        i, j = int(t["i"].iloc[0]), int(t["j"].iloc[0])
        t = t.sort_values(["part", "key"])
        u = np.frombuffer(b"".join(t["data"]), np.float64).reshape(len(t), -1)
        keys = t["key"].to_numpy()
        counts, roots, *_ = tile_links(t["weight"].to_numpy(), u, len(t) if i == j else int((t["part"] == i).sum()), threshold, size)
        hit = np.flatnonzero(counts)
        return pd.DataFrame({"key": keys[hit], "links": counts[hit], "root": keys[roots[hit]]})

    found = materialize(tiled.groupBy(*where, "i", "j").applyInPandas(compare, "key long, links long, root long"), "vector-links")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    components = connected_components(found.where("key <> root").select(F.col("key").alias("a"), F.col("root").alias("b")), "vector-components")
    named = reps.select("key", "h1", "h2", "least", "weight").join(links, "key", "left").join(components, F.col("key") == F.col("node"), "left")
    named = materialize(named.select("h1", "h2", "least", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "key").alias("root")), "named-vectors")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select(F.col("h1").alias("_h1_"), F.col("h2").alias("_h2_"), "n_links", "component_id")
    out = ids.join(named, (F.col("h1") == F.col("_h1_")) & (F.col("h2") == F.col("_h2_")), "left")
    alone = F.col("_h1_").isNull()
    out = out.select("vec_id", F.when(alone, F.lit(0).cast("long")).otherwise(F.col("n_links")).alias("n_links"), F.when(alone, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

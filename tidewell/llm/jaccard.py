"""Exact n-gram Jaccard join with set-relation skipping, giving components rather than pairs.

1. Shingle sets are hashed to 64 bits; documents with equal sets become one set from the first block on.
2. Every shingle's frequency is counted over all documents (40-bit fingerprints, packed, by hash range). Shingles
   in FREQUENT or more sets are ordered behind all others, by hash within either kind: one global order.
3. Two sets within the threshold share a shingle of their prefixes in that order. Prefix postings are packed by hash
   range. A short posting list gives pairs with their counts of common prefix shingles, and pairs whose count cannot
   reach the threshold go; a long one only ties its sets together by size. Components of both are families: every
   link lies inside one.
4. A family is cut by set size into blocks. Two blocks meet unless their sizes rule out links. Inside, inverted lists
   are cut into blocks of positions that are skipped by size, and a set's overlaps are derived from those of a highly
   similar set before it: only the lists of shingles in which both differ are touched.

Hash collisions (64 bits) are the only way to a wrong link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_SPACE_TABLE, connected_components, gapless_rank, give_back, materialize, mix64, pieces, text_blocks, word_hashes

BLOCK_BYTES = 2 << 20
#: Input bytes for each hash range.
RANGE_BYTES = 8 << 20
FREQUENT = 16
#: Fingerprints of frequent shingles that are broadcast; with more, the count that makes a shingle frequent doubles.
MAX_FREQUENT = 2_000_000
LONG_LIST = 48
#: Shingles of one side of a tile, a set counting SET_WEIGHT besides; a larger set is a side of its own.
FAMILY_BLOCK = 1 << 19
SET_WEIGHT = 256
POSITIONS = 256
#: Rows of a side that may be broadcast.
MAX_BROADCAST_ROWS = 1_000_000
#: Odd multipliers of a shingle's word hashes.
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
RANGE_SEED = np.uint64(0x9FB21C651E98DF25)
TIED = 1 << 30


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; the whole word sequence where it has fewer than k words; empty without words."""
    data = b" ".join(t.translate(LOWER_SPACE_TABLE) for t in texts) + b" "
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    h, at = word_hashes(data)
    cuts = np.searchsorted(at, ends)
    odd = np.concatenate([ODD, mix64(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)])[:k]
    whole = len(h) - k + 1
    rolled = np.zeros(max(0, whole), np.uint64)
    if whole > 0:
        for j in range(k):
            rolled += h[j : j + whole] * odd[j]
        rolled = mix64(rolled)
    out, begin = [], 0
    for end in cuts.tolist():
        n = end - begin
        if n >= k:
            out.append(np.unique(rolled[begin : end - k + 1]))
        elif n:
            out.append(mix64((h[begin:end] * odd[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n)))
        else:
            out.append(np.empty(0, np.uint64))
        begin = end
    return out


def set_id(s: np.ndarray) -> int:
    """Signed 64-bit name of a set, from two sums over its shingles and its size."""
    one = mix64(s + np.uint64(0x51ED270B)).sum(dtype=np.uint64, keepdims=True)
    two = mix64(s ^ np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64, keepdims=True)
    return int(mix64(one ^ (two * np.uint64(3)) ^ np.uint64(len(s) << 1 | 1)).view(np.int64)[0])


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def _ranges(docs: DataFrame, text_col: str) -> int:
    """A power of two of hash ranges that grows with the input."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > 1 << 50:
        size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return 1 << max(4, (max(1, size // RANGE_BYTES) - 1).bit_length())


def _planes(v: np.ndarray, low: int = 0) -> bytes:
    """Bytes low..7 of 64-bit values, all lowest bytes first and so on: the upper ones of sorted values compress away."""
    return np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8)[:, low:].T).tobytes()


def _from_planes(data: bytes, low: int = 0) -> np.ndarray:
    a = np.frombuffer(data, np.uint8).reshape(8 - low, -1)
    out = np.zeros((a.shape[1], 8), np.uint8)
    out[:, low:] = a.T
    return out.view(np.uint64).ravel()


def frequent_shingles(docs: DataFrame, k: int, ranges: int, frequent: int, max_frequent: int = MAX_FREQUENT) -> np.ndarray:
    """Sorted 40-bit fingerprints of shingles in `frequent` or more distinct sets (equal sets within a block count once)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_blocks(batches, "text", BLOCK_BYTES):
            once = {s.tobytes(): s for s in shingle_sets(texts, k)}
            v = np.sort(np.concatenate([np.empty(0, np.uint64), *once.values()]))
            got = [(b, _planes(v[c], 3)) for b, c in pieces(v, ranges)]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.binary())], ["range", "data"])

    def often(rows: pd.DataFrame) -> pd.DataFrame:
        v, n = np.unique(np.concatenate([_from_planes(x, 3) for x in rows.pop("data")]), return_counts=True)
        give_back()
        return pd.DataFrame({"finger": v[n >= frequent].view(np.int64), "n": n[n >= frequent].astype(np.int64)})

    found = materialize(docs.mapInArrow(count, "range int, data binary").groupBy("range").applyInPandas(often, "finger long, n long"), "frequent-shingles")
    while found.where(F.col("n") >= frequent).count() > max_frequent:
        frequent *= 2
    return np.sort(found.where(F.col("n") >= frequent).select("finger").toPandas()["finger"].to_numpy(np.int64).view(np.uint64))


def _postings(docs: DataFrame, k: int, ranges: int, fingers: np.ndarray, num: int, den: int) -> DataFrame:
    """A row for each document (range is null), and packed prefix postings of a block's distinct sets by hash range."""
    sent = docs.sparkSession.sparkContext.broadcast(fingers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fingers = sent.value
        low = np.uint64(0xFFFFFFFFFF000000)
        for table, texts in text_blocks(batches, "text", BLOCK_BYTES):
            sets = shingle_sets(texts, k)
            names = [set_id(s) if len(s) else 0 for s in sets]
            sizes = [len(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [table.column("doc_id").combine_chunks(), table.column("h").combine_chunks(), pa.array(names, pa.int64(), mask=np.asarray(sizes) == 0), pa.array(sizes, pa.int64()), pa.nulls(len(sets), pa.int32()), *(pa.nulls(len(sets), pa.binary()) for _ in range(3))],
                ["doc_id", "h", "set", "n", "range", "hashes", "sets", "sizes"],
            )
            hashes, owner, size = [], [], []
            for name, s in {name: s for name, s in zip(names, sets, strict=True) if len(s)}.items():
                if len(fingers):
                    key = s & low
                    at = np.searchsorted(fingers, key)
                    at[at == len(fingers)] = 0
                    heavy = fingers[at] == key
                    s = np.concatenate([s[~heavy], s[heavy]]) if heavy.any() else s
                p = prefix_length(len(s), num, den)
                hashes.append(s[:p])
                owner.append(np.full(p, name, np.int64))
                size.append(np.full(p, len(s), np.uint64))
            if not hashes:
                continue
            # prefixes hold the lowest hashes, so ranges are cut on another mix of them
            h, o, z = mix64(np.concatenate(hashes) ^ RANGE_SEED), np.concatenate(owner), np.concatenate(size)
            order = np.argsort(h, kind="stable")
            h, o, z = h[order], o[order], z[order]
            got = pieces(h, ranges)
            yield pa.RecordBatch.from_arrays(
                [*(pa.nulls(len(got), pa.int64()) for _ in range(4)), pa.array([b for b, _ in got], pa.int32()), *(pa.array([_planes(np.ascontiguousarray(x[c])) for _, c in got], pa.binary()) for x in (h, o.view(np.uint64), z))],
                ["doc_id", "h", "set", "n", "range", "hashes", "sets", "sizes"],
            )

    return docs.mapInArrow(run, "doc_id long, h long, set long, n long, range int, hashes binary, sets binary, sizes binary")


def _candidates(num: int, den: int, long_list: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        give_back()
        h, o, z = (np.concatenate([_from_planes(x) for x in rows.pop(c)]) for c in ("hashes", "sets", "sizes"))
        order = np.lexsort((o, z, h))
        h, o, z = h[order], o[order].view(np.int64), z[order].astype(np.int64)
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
        h, o, z = h[fresh], o[fresh], z[fresh]
        begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        length = np.diff(np.concatenate([begin, [len(h)]]))
        a_at, b_at = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for d in range(1, long_list):  # pairs at distance d within a short list, all lists at once
            wide = (length > d) & (length <= long_list)
            if not wide.any():
                break
            first = begin[wide]
            n = length[wide] - d
            at = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            at = at[den * z[at] >= num * z[at + d]]
            a_at.append(at)
            b_at.append(at + d)
        a_at, b_at = np.concatenate(a_at), np.concatenate(b_at)
        one = [np.ones(len(a_at), np.int64)]
        ties_a, ties_b = [], []
        for start, n in zip(begin[length > long_list].tolist(), length[length > long_list].tolist(), strict=True):
            leader = start
            while True:
                reach = start + int(np.searchsorted(z[start : start + n] * num, den * z[leader], side="right"))
                ties_a += [leader] * (reach - leader - 1)
                ties_b += range(leader + 1, reach)
                if reach >= start + n:
                    break
                if den * z[reach - 1] >= num * z[reach]:
                    ties_a.append(reach - 1)
                    ties_b.append(reach)
                leader = reach
        if ties_a:
            a_at, b_at = np.concatenate([a_at, ties_a]), np.concatenate([b_at, ties_b])
            one.append(np.full(len(ties_a), TIED, np.int64))
        a, b, na, nb, c = o[a_at], o[b_at], z[a_at], z[b_at], np.concatenate(one)
        swap = a > b
        a, b, na, nb = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, nb, na), np.where(swap, na, nb)
        order = np.lexsort((b, a))
        a, b, na, nb, c = a[order], b[order], na[order], nb[order], c[order]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.empty(0, np.int64)
        return pd.DataFrame({"a": a[first], "b": b[first], "na": na[first], "nb": nb[first], "c": np.add.reduceat(c, first) if len(first) else c})

    return run


class _Block:
    """Inverted lists over one block of positions, and the overlaps of the set asked about last."""

    def __init__(self, sets: list[np.ndarray], first: int, sizes: np.ndarray):
        self.first, self.n, self.low, self.high = first, len(sets), int(sizes.min()), int(sizes.max())
        token = np.concatenate(sets)
        where = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(token, kind="stable")
        self.tokens, start = np.unique(token[order], return_index=True)
        self.starts = np.concatenate([start, [len(order)]])
        self.lists = where[order]
        self.last: np.ndarray = np.empty(0, token.dtype)
        self.overlap = np.zeros(len(sets), np.int64)

    def _tally(self, tokens: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.tokens, tokens)
        at[at == len(self.tokens)] = 0
        at = at[self.tokens[at] == tokens]
        n = self.starts[at + 1] - self.starts[at]
        flat = np.repeat(self.starts[at] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(at) else at
        return np.bincount(self.lists[flat], minlength=self.n)

    def overlaps(self, s: np.ndarray) -> np.ndarray:
        added = np.setdiff1d(s, self.last, assume_unique=True)
        if 2 * (len(added) + len(self.last) - (len(s) - len(added))) < len(s):
            gone = np.setdiff1d(self.last, s, assume_unique=True)
            self.overlap = self.overlap + self._tally(added) - self._tally(gone)
        else:
            self.overlap = self._tally(s)
        self.last = s
        return self.overlap


def links_within(names: np.ndarray, sets: list[np.ndarray], others: np.ndarray | None, other_sets: list[np.ndarray] | None, num: int, den: int) -> list[tuple[int, int]]:
    """A forest of links: between the sets, or (with others) between both sides; num/den is the threshold."""
    right, right_sets = (names, sets) if others is None else (others, other_sets)
    keep = [i for i in np.argsort([len(s) for s in right_sets], kind="stable").tolist() if len(right_sets[i])]
    right, right_sets = right[keep], [right_sets[i] for i in keep]
    sizes = np.asarray([len(s) for s in right_sets])
    blocks = [_Block(right_sets[i : i + POSITIONS], i, sizes[i : i + POSITIONS]) for i in range(0, len(right_sets), POSITIONS)]
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    # like sets come after one another, so that overlaps can be derived
    for i in sorted((i for i in range(len(sets)) if len(sets[i])), key=lambda i: sets[i][:3].tolist()):
        s, me = sets[i], int(names[i])
        for block in blocks:
            if den * block.high < num * len(s) or den * len(s) < num * block.low:
                continue
            o = block.overlaps(s)
            n = sizes[block.first : block.first + block.n] + len(s)
            for j in np.flatnonzero(den * o >= num * (n - o)).tolist():
                you = int(right[block.first + j])
                a, b = root(me), root(you)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    out.append((me, you))
    return out


def jaccard_components(docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT, long_list: int = LONG_LIST, family_block: int = FAMILY_BLOCK, max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """One row for each document row: doc_id, n_shingles, component_id (smallest doc_id reachable by links).

    Words are runs of anything but ASCII white space, A-Z lower-cased. Two documents are linked when
    den * |intersection| >= num * |union|. Null, empty and blank texts have no shingles and are their own component.
    Repeated rows each get their row; a null id stays null and never names a component (one made of null ids only is
    null). Other columns play no part; an empty table gives an empty result.
    """
    num, den = threshold
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    ranges = _ranges(docs, "text")
    fingers = frequent_shingles(docs.select("text"), k, ranges, frequent)
    packed = materialize(_postings(docs, k, ranges, fingers, num, den), "prefix-postings")
    rows = packed.where(F.col("range").isNull()).select("doc_id", "set", "n")
    pairs = packed.where(F.col("range").isNotNull()).select("range", "hashes", "sets", "sizes").groupBy("range").applyInPandas(_candidates(num, den, long_list), "a long, b long, na long, nb long, c long")
    pairs = pairs.groupBy("a", "b").agg(F.sum("c").alias("c"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    # overlap <= common prefix shingles + what the larger set has behind its prefix
    reach = F.col("c") + F.ceil(F.lit(num) * F.greatest("na", "nb") / F.lit(den)) - 1
    pairs = pairs.where(F.lit(num) * (F.col("na") + F.col("nb")) <= reach * F.lit(num + den)).select("a", "b")
    families = materialize(connected_components(pairs, "families").select(F.col("node").alias("set"), F.col("component").alias("family")), "family-sets")
    # one row speaks for each set: of the smallest id, known by its id and its text's hash
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h")).alias("least")
    sets = materialize(packed.where(F.col("set").isNotNull()).groupBy("set").agg(least, F.first("n").alias("n")).select("set", "least.doc_id", "least.h", "n"), "sets")
    members = materialize(families.join(sets, "set"), "members")
    # by size, in slices of like size, so that no task ranks a whole family; parts hold about family_block shingles
    ranked = gapless_rank(members, ["family"], ["n", "set"], "before", F.floor(F.log(F.col("n").cast("double")) * 20) * 64 + F.pmod(F.xxhash64("set"), F.lit(64)), F.col("n") + SET_WEIGHT)
    members = materialize(ranked.withColumn("part", F.floor(F.col("before") / family_block).cast("int")).drop("before"), "members")
    parts = members.groupBy("family", "part").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    other = parts.select(F.col("family").alias("f2"), F.col("part").alias("part2"), F.col("low").alias("low2"))
    tiles = parts.join(other, (F.col("family") == F.col("f2")) & (F.col("part") <= F.col("part2")) & (F.lit(den) * F.col("high") >= F.lit(num) * F.col("low2"))).select("family", F.col("part").alias("i"), F.col("part2").alias("j"))
    places = tiles.select("family", F.col("i").alias("part"), "i", "j").union(tiles.where("i < j").select("family", F.col("j").alias("part"), "i", "j"))
    places = materialize(places, "places")
    asked = materialize(members.select(F.col("doc_id").alias("_id_"), F.col("h").alias("_h_"), "set", "family", "part"), "asked")
    small = lambda df: F.broadcast(df) if df.count() <= max_broadcast_rows else df

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, texts in text_blocks(batches, "text", BLOCK_BYTES):
            got = shingle_sets(texts, k)
            same = [i for i, (s, name) in enumerate(zip(got, table.column("set").to_pylist(), strict=True)) if len(s) and set_id(s) == name]
            out = table.select(["set", "family", "part"]).take(pa.array(same, pa.int64())).append_column("hashes", pa.array([got[i].tobytes() for i in same], pa.binary()))
            yield from out.combine_chunks().to_batches()

    found = docs.join(small(asked), (F.col("h") == F.col("_h_")) & F.col("doc_id").eqNullSafe(F.col("_id_"))).select("text", "set", "family", "part")
    unpacked = found.mapInArrow(unpack, "set long, family long, part int, hashes binary")
    placed = unpacked.join(small(places), ["family", "part"]).select("set", "family", "part", "i", "j", "hashes")

    def compare(t: pd.DataFrame) -> pd.DataFrame:
        t = t.drop_duplicates("set")
        left, right = t[t["part"] == t["i"]], t[t["part"] == t["j"]]
        token = [np.frombuffer(x, np.uint64) for x in left["hashes"]]
        alone = t["i"].iloc[0] == t["j"].iloc[0]
        args = (None, None) if alone else (right["set"].to_numpy(), [np.frombuffer(x, np.uint64) for x in right["hashes"]])
        return pd.DataFrame(links_within(left["set"].to_numpy(), token, *args, num, den), columns=["a", "b"], dtype=np.int64)

    links = materialize(placed.groupBy("family", "i", "j").applyInPandas(compare, "a long, b long"), "links")
    components = connected_components(links, "components")
    named = sets.join(components, sets["set"] == components["node"], "left").select("set", "doc_id", F.coalesce("component", "set").alias("root"))
    named = materialize(named, "named")
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = named.select("set", "root").join(least, "root").select(F.col("set").alias("_set_"), "component_id")
    out = rows.join(named, F.col("set") == F.col("_set_"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("set").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))

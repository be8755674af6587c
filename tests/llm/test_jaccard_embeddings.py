import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm.common import connected_components
from tidewell.llm.embedding_dedup import near_duplicates, tile_links, unit
from tidewell.llm.jaccard import jaccard_components, links_within

SPACE = str.maketrans({c: " " for c in "\t\n\x0b\x0c\r"})


def shingles(text, k):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")).translate(SPACE).split(" ") if x]
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components(ids, linked):
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                parent[root(i)] = root(j)
    least = {}
    for i, v in enumerate(ids):
        if v is not None:
            least[root(i)] = min(least.get(root(i), v), v)
    return [least.get(root(i)) for i in range(len(ids))]


def brute(rows, k, num, den):
    sets = [shingles(t, k) for _, t in rows]
    got = components([d for d, _ in rows], lambda i, j: bool(sets[i]) and bool(sets[j]) and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]))
    return sorted(((d, len(s), c) for (d, _), s, c in zip(rows, sets, got, strict=True)), key=str)


def run(docs, k, num, den, **kw):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(docs, k, (num, den), **kw).collect()), key=str)


@pytest.mark.parametrize("k,num,kw", [(4, 85, {}), (5, 80, {"frequent": 2, "long_list": 3, "family_block": 3, "max_broadcast_rows": 1})])
def test_components_match_brute_force(spark, docs, k, num, kw):
    base = [(r.doc_id, r.text) for r in docs.collect()][:120]
    rng = np.random.default_rng(3)
    rows = list(base)
    for n, (_, text) in enumerate(base[:8] * 6):  # near copies around the threshold, and a family of them
        w = text.split(" ")
        for _ in range(int(rng.integers(0, 1 + max(1, len(w) // 25)))):
            w[int(rng.integers(len(w)))] = f"new{rng.integers(1 << 30)}"
        rows.append((10_000 + n, " ".join(w)))
    want = brute(rows, k, num, 100)
    assert len({c for _, _, c in want}) < len(rows)
    assert run(spark.createDataFrame(rows, "doc_id long, text string"), k, num, 100, **kw) == want


def test_odd_documents(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert run(odd_docs, 4, 85, 100) == brute(rows, 4, 85, 100)
    assert run(no_docs, 4, 85, 100) == []


def test_incremental_overlaps_link_as_direct_ones_do():
    rng = np.random.default_rng(0)
    base = rng.choice(1 << 40, 60, replace=False).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(60) < rng.random() * 0.2, rng.choice(1 << 40, 60).astype(np.uint64), base)) for _ in range(400)]
    found = links_within(np.arange(400), sets, None, None, 85, 100)
    want = components(list(range(400)), lambda i, j: 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j])))
    linked = {frozenset(e) for e in found}
    assert components(list(range(400)), lambda i, j: frozenset((i, j)) in linked) == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(200, 260)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 5 for i in range(200, 260)) and got[7] == 7 and 3 not in got
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_embeddings_match_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((12, 16))
    rows = []
    for i in range(240):
        x = centres[i % 12] + rng.standard_normal(16) * 0.25 * (i % 3)
        rows.append((i, x.astype(float).tolist(), i % 2))
    rows += [(300, rows[0][1], 0), (301, rows[0][1], 0), (301, rows[0][1], 0), (302, rows[0][1], None), (303, None, 0), (304, [0.0] * 16, 0), (305, [float("nan")] * 16, 0), (306, [1.0, None], 0), (307, [1.0, 2.0], 0), (308, [2.0, 4.0], 0), (None, rows[1][1], 1), (309, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("key", F.lit("clash")).withColumn("weight", F.lit(1))

    def good(v, label):
        return label is not None and bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def linked(i, j):
        (_, a, p), (_, b, q) = rows[i], rows[j]
        if not (good(a, p) and good(b, q) and p == q and len(a) == len(b)):
            return False
        a, b = np.asarray(a), np.asarray(b)
        return a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.93

    n = [sum(linked(i, j) for j in range(len(rows)) if i != j) for i in range(len(rows))]
    comp = components([r[0] for r in rows], linked)
    comp = [c if n[i] or rows[i][0] is not None else None for i, c in enumerate(comp)]
    want = sorted(((r[0], k, c, r[0] is not None and r[0] == c) for r, k, c in zip(rows, n, comp, strict=True)), key=str)
    for kw in ({}, {"tile": 7, "size": 3}):
        got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_duplicates(df, **kw).collect()), key=str)
        assert got == want
    assert near_duplicates(df.limit(0)).count() == 0


def test_pigeonhole_join_prunes_and_loses_nothing():
    rng = np.random.default_rng(0)
    for d, n, spread in ((64, 1500, 1.0), (64, 900, 0.2), (9, 400, 0.3), (3, 200, 0.2)):
        centres = rng.standard_normal((6, d))
        u = unit(centres[rng.integers(0, 6, n)] * (spread < 1) + rng.standard_normal((n, d)) * spread)
        weights = rng.integers(1, 4, n)
        near = u @ u.T >= 0.93
        np.fill_diagonal(near, False)
        for home in (n, n // 3):
            want = near.copy()
            if home < n:
                want[:home, :home] = want[home:, home:] = False
            counts, _, compared, verified = tile_links(weights, u, home, 0.93)
            assert np.array_equal(counts, want @ weights)
            if spread == 1 and home == n:  # comparisons are of 4 of 64 coordinates
                assert compared * 4 / 64 < 0.15 * n * (n - 1) / 2 and verified < 0.01 * n * (n - 1) / 2

import itertools
import zlib
from bisect import bisect_left

import numpy as np
from pyspark.sql import functions as F

from tidewell.llm.packing import best_bounds, pack
from tidewell.llm.sharding import shard


def test_shards_match_brute_force_and_grow_into_the_new_one_only(docs):
    import hashlib
    import math

    rows = shard(docs, [1.0] * 16).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        bids = [-1 / math.log((int(hashlib.md5(f"{r.doc_id}:{k}".encode()).hexdigest()[:15], 16) + 0.5) / 2**60) for k in range(17)]
        assert r.shard == int(np.argmax(bids[:16])) and r.grown_shard == int(np.argmax(bids))
        assert r.grown_shard in (r.shard, 16)
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 1, zlib.crc32(data), "key")
    for k in range(16):
        slots = sorted(r.slot for r in rows if r.shard == k)
        assert slots == list(range(len(slots)))
    assert len(rows) == docs.count()


def test_weights_share_out_rows(spark):
    keys = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    n = {r["shard"]: r["count"] for r in shard(keys, [1.0, 3.0]).groupBy("shard").count().collect()}
    assert abs(n[1] / 4000 - 0.75) < 0.04


def test_odd_rows_keep_shards_and_slots(odd_docs, no_docs):
    rows = shard(odd_docs, [1.0] * 4).collect()
    assert len(rows) == 12
    null = next(r for r in rows if r.doc_id == 2)
    assert (null["size"], null.text_crc32) == (1, 0)
    assert len({r.shard for r in rows if r.doc_id == 1}) == 1
    for k in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
    assert shard(no_docs, [1.0] * 4).count() == 0


def brute(lengths, counts, k):
    best = None
    for m in range(1, min(k, len(lengths)) + 1):
        for cut in itertools.combinations(range(len(lengths) - 1), m - 1):
            b = [lengths[i] for i in cut] + [lengths[-1]]
            v = sum((b[bisect_left(b, x)] - x) * n for x, n in zip(lengths, counts, strict=True))
            best = v if best is None else min(best, v)
    return best


def test_bounds_are_optimal():
    rng = np.random.default_rng(0)
    for _ in range(150):
        n = int(rng.integers(1, 9))
        lengths, counts, k = np.sort(rng.choice(60, n, replace=False)), rng.integers(1, 9, n), int(rng.integers(1, 6))
        bounds, cost = best_bounds(lengths, counts, k)
        assert cost == brute(lengths.tolist(), counts.tolist(), k) and bounds[-1] == lengths[-1] and len(bounds) <= k
    assert best_bounds(np.array([]), np.array([]), 4) == ([], 0)


def check_packed(rows, budget):
    by = {}
    for r in rows:
        assert 0 <= r.padding == r.bucket_len - r.n_tokens
        by.setdefault((r.bucket, r.batch), []).append(r)
    for (bucket, batch), part in by.items():
        room = max(1, budget // max(1, part[0].bucket_len))
        assert len(part) <= room and sorted(r.place for r in part) == list(range(len(part)))
        last = max(b for k, b in by if k == bucket)
        assert batch == last or len(part) == room
    for bucket in {k for k, _ in by}:
        assert sorted(b for k, b in by if k == bucket) == list(range(1 + max(b for k, b in by if k == bucket)))


def test_packing(docs, odd_docs, no_docs):
    rows = pack(docs, buckets=5, token_budget=4000).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == docs.count() and all(r.n_tokens == len(texts[r.doc_id].encode().split()) for r in rows)
    check_packed(rows, 4000)
    lengths, counts = np.unique([r.n_tokens for r in rows], return_counts=True)
    assert sum(r.padding for r in rows) == best_bounds(lengths, counts, 5)[1]
    odd = pack(odd_docs, buckets=3, token_budget=100).collect()
    assert len(odd) == 12 and max(r.n_tokens for r in odd) == 100000
    check_packed(odd, 100)
    assert pack(no_docs).count() == 0

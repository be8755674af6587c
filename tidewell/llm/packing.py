"""Length buckets of least padding, and token-budget batches inside each bucket.

The global histogram of lengths (one small aggregate) goes to the driver, where dynamic programming finds the
`buckets` upper bounds with the least total padding. Rows are then numbered inside their bucket without gaps,
slice by slice, and cut into batches whose padded size stays within the token budget.

The histogram is small by itself: with T tokens in all there are at most sqrt(2 T) distinct lengths.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gapless_rank, materialize, stable_salt

BUCKETS = 16
TOKEN_BUDGET = 16384
SALTS = 256


def word_count(text: Column) -> Column:
    """Tokens of a text: its runs of characters other than ASCII white space; 0 for null."""
    plain = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(plain, " "), lambda w: w != "")).cast("long")


def best_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> tuple[list[int], int]:
    """Upper bounds (each one of the lengths, ascending, the last the largest) of at most `buckets` buckets, and the padding they leave.

    lengths ascend. Padding of lengths i..j-1 under bound lengths[j-1] is lengths[j-1] * (C[j]-C[i]) - (S[j]-S[i]), whose best
    split points ascend with j; so each layer is solved by divide and conquer, in n log n steps.
    """
    n = len(lengths)
    if not n:
        return [], 0
    if float(lengths[-1]) * float(np.sum(counts, dtype=np.float64)) >= 2.0**62:
        raise OverflowError("token totals beyond 2^62: give lengths in coarser units")
    x = np.asarray(lengths, np.int64)
    c = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    s = np.concatenate([[0], np.cumsum(x * np.asarray(counts, np.int64))])
    far = np.int64(2**62)
    cost = np.full(n + 1, far)
    cost[0] = 0
    cost[1:] = x * c[1:] - s[1:]
    picks = [np.zeros(n + 1, np.int64)]
    for _ in range(min(buckets, n) - 1):
        new, pick = cost.copy(), np.arange(n + 1)
        pick[1:] = -1
        work = [(1, n, 0, n)]
        while work:
            lo, hi, a, b = work.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            i = np.arange(a, min(mid, b + 1))
            total = cost[i] + x[mid - 1] * (c[mid] - c[i]) - (s[mid] - s[i])
            k = int(np.argmin(total))
            new[mid], pick[mid] = total[k], i[k]
            work += [(lo, mid - 1, a, int(i[k])), (mid + 1, hi, int(i[k]), b)]
        cost = new
        picks.append(pick)
    bounds, j = [], n
    for pick in reversed(picks):
        if j == 0:
            break
        bounds.append(int(x[j - 1]))
        j = int(pick[j])
    return bounds[::-1], int(cost[n])


def pack(docs: DataFrame, id_col: str = "doc_id", tokens: Column | None = None, buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET, salts: int = SALTS) -> DataFrame:
    """Bucket, batch and place of every row; all rows are kept.

    tokens: a column of lengths, by default the word count of `text`. Nulls and texts without words have length 0 and
    belong to the first bucket. A batch of bucket bound b holds floor(token_budget / b) rows, at least one, so a row longer
    than the budget makes a batch of its own. Within a bucket rows follow (slice of md5 of the id, id, length); repeated rows
    are separate, null ids come first. Batch numbers are gapless inside each bucket. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(word_count(F.col("text")) if tokens is None else tokens.cast("long"), F.lit(0)).alias("n_tokens"))
    rows = materialize(rows, "lengths")  # texts are read once
    histogram = rows.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).orderBy("n_tokens").toPandas()
    bounds, _ = best_bounds(histogram.n_tokens.to_numpy(np.int64), histogram.n.to_numpy(np.int64), buckets)
    bound = F.lit(None).cast("long")
    bucket = F.lit(None).cast("int")
    for i in range(len(bounds) - 1, -1, -1):
        fits = F.col("n_tokens") <= bounds[i]
        bound, bucket = F.when(fits, F.lit(bounds[i])).otherwise(bound), F.when(fits, F.lit(i)).otherwise(bucket)
    rows = rows.withColumns({"bucket": bucket, "bucket_len": bound.cast("long")})
    rows = gapless_rank(rows, ["bucket"], ["doc_id", "n_tokens"], "rank", F.coalesce(stable_salt(F.col("doc_id"), salts), F.lit(0)))
    room = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.greatest(F.lit(1), F.col("bucket_len")))).cast("long")
    return rows.select(
        "doc_id", "n_tokens", "bucket", "bucket_len", F.floor(F.col("rank") / room).cast("long").alias("batch"), (F.col("rank") % room).cast("int").alias("place"), (F.col("bucket_len") - F.col("n_tokens")).alias("padding")
    )

"""Regression, separability and significance."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.operators.joins import nearest_centroid


@dataclass
class Ridge:
    """A ridge fit on standardised features; those that don't vary weigh nothing."""

    columns: list[str]
    mean: np.ndarray
    scale: np.ndarray
    coef: np.ndarray
    intercept: float
    alpha: float

    @property
    def n_active(self) -> int:
        return int(np.count_nonzero(self.coef))

    def predict(self) -> Column:
        terms = [(F.col(c) - float(m)) / float(s) * float(b) for c, m, s, b in zip(self.columns, self.mean, self.scale, self.coef, strict=True) if b]
        return sum(terms, F.lit(float(self.intercept)))


def fit_ridge(df: DataFrame, columns: Sequence[str], target: str, alpha: float) -> Ridge:
    """One aggregate over the rows gives the moments; only a matrix of the features' size is solved on the driver.

    Moments are taken about the first row, so large offsets don't cost digits. Rows with nulls don't count.
    """
    got = moments(df, [], columns, target)
    if not got:
        raise ValueError("no rows to fit")
    return solve_ridge(got.values(), columns, alpha)


@dataclass
class Moments:
    """Of rows (features and then the target) about a common centre: count, sums and sums of products; they add up."""

    n: int
    sums: np.ndarray
    products: np.ndarray
    centre: np.ndarray


def moments(df: DataFrame, by: Sequence[str], columns: Sequence[str], target: str) -> dict[tuple, Moments]:
    """Moments of each group of `by` (few: runs, levels or folds), by one aggregate. Rows with nulls don't count."""
    names = [*columns, target]
    rows = df.select(*by, *[F.col(c).cast("double").alias(f"_x{i}_") for i, c in enumerate(names)]).dropna()
    first = rows.first()
    if first is None:
        return {}
    k = len(names)
    centre = np.asarray([first[f"_x{i}_"] for i in range(k)], float)
    d = [F.col(f"_x{i}_") - float(centre[i]) for i in range(k)]
    aggs = [F.count(F.lit(1)).alias("_n_"), *[F.sum(x).alias(f"_s{i}_") for i, x in enumerate(d)], *[F.sum(d[i] * d[j]).alias(f"_p{i}_{j}_") for i in range(k) for j in range(i, k)]]
    out = {}
    for r in rows.groupBy(*by).agg(*aggs).collect():
        products = np.asarray([[r[f"_p{min(i, j)}_{max(i, j)}_"] for j in range(k)] for i in range(k)])
        out[tuple(r[c] for c in by)] = Moments(r["_n_"], np.asarray([r[f"_s{i}_"] for i in range(k)]), products, centre)
    return out


def _pooled(parts: Iterable[Moments]) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and covariance over parts of one centre."""
    parts = list(parts)
    n = sum(m.n for m in parts)
    mean = sum(m.sums for m in parts) / n
    return n, mean + parts[0].centre, sum(m.products for m in parts) / n - np.outer(mean, mean)


def solve_ridge(parts: Iterable[Moments], columns: Sequence[str], alpha: float, only: Sequence[int] | None = None) -> Ridge:
    """A ridge fit over the union of the parts, of all features or of those numbered in `only`."""
    n, mean, cov = _pooled(parts)
    use = list(range(len(columns))) if only is None else list(only)
    columns, mean, cov = [columns[i] for i in use], mean[[*use, -1]], cov[np.ix_([*use, -1], [*use, -1])]
    k = len(columns)
    var = np.clip(np.diag(cov)[:-1], 0, None)
    live = np.flatnonzero(var > 1e-24 * np.maximum(1, mean[:-1] ** 2))
    scale, coef = np.ones(k), np.zeros(k)
    scale[live] = np.sqrt(var[live])
    gram = n * cov[np.ix_(live, live)] / np.outer(scale[live], scale[live])
    if len(live):
        coef[live] = np.linalg.solve(gram + alpha * np.eye(len(live)), n * cov[live, -1] / scale[live])
    return Ridge(columns, mean[:-1], scale, coef, float(mean[-1]), alpha)


def strongest(parts: Iterable[Moments]) -> int:
    """The feature whose correlation with the target is largest in size, the first of equal ones; ones that don't vary count as -1."""
    _, _, cov = _pooled(parts)
    sd = np.sqrt(np.clip(np.diag(cov), 0, None))
    with np.errstate(divide="ignore", invalid="ignore"):
        link = np.abs(cov[:-1, -1] / (sd[:-1] * sd[-1]))
    return int(np.argmax(np.where(np.isfinite(link), link, -1.0)))


def model_table(spark, models: Mapping[tuple, tuple[Ridge, Sequence]], columns: Sequence[str], key: str) -> DataFrame:
    """Models by their key (schema `key`) as rows: intercept, coef (of raw features, in the order of columns) and `train`, the groups fitted on."""
    rows = []
    for k, (m, train) in models.items():
        at = {c: float(b) / float(s) for c, b, s in zip(m.columns, m.coef, m.scale, strict=True)}
        coef = [at.get(c, 0.0) for c in columns]
        rows.append((*k, m.intercept - sum(at[c] * float(x) for c, x in zip(m.columns, m.mean, strict=True)), coef, [str(t) for t in train]))
    return spark.createDataFrame(rows, f"{key}, intercept double, coef array<double>, train array<string>")


def linear(columns: Sequence[str]) -> Column:
    """What a row of model_table says of a row of features."""
    return F.aggregate(F.zip_with(F.array(*[F.col(c).cast("double") for c in columns]), "coef", lambda a, b: a * b), F.col("intercept"), lambda a, b: a + b)


def seeded(key: Column, seed: int) -> Column:
    """32 hex digits that depend on the seed and the key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def stratified_folds(df: DataFrame, group: str, key: str, folds: int, seed: int = 0) -> DataFrame:
    """df with `fold`: rows of a group are dealt out in the order of a seeded hash of their key (md5, so that any engine can repeat it)."""
    w = Window.partitionBy(group).orderBy(seeded(F.col(key), seed), key)
    return df.withColumn("fold", ((F.row_number().over(w) - 1) % folds).cast("int"))


def nearest_centroid_cv(df: DataFrame, features: str, group: str, fold: str) -> DataFrame:
    """df with `predicted`: for each fold the nearest centroid, among the groups' means over all other folds, after standardising by those rows.

    Totals of all rows less those of a fold give its training rows' moments, so the data are read once for all folds.
    """
    long = df.select(fold, group, F.posexplode(features).alias("_p_", "_v_"))
    part = long.groupBy(fold, group, "_p_").agg(F.sum("_v_").alias("_s_"), F.sum(F.col("_v_") * F.col("_v_")).alias("_q_"), F.count("_v_").alias("_n_"))
    folds = part.select(F.col(fold).alias("_fold_")).distinct()
    rest = part.crossJoin(F.broadcast(folds)).where(F.col(fold) != F.col("_fold_"))  # folds x groups x features, all few
    by_group = rest.groupBy("_fold_", group, "_p_").agg(F.sum("_s_").alias("_s_"), F.sum("_q_").alias("_q_"), F.sum("_n_").alias("_n_"))
    w = Window.partitionBy("_fold_", "_p_")
    mean = F.sum("_s_").over(w) / F.sum("_n_").over(w)
    var = F.sum("_q_").over(w) / F.sum("_n_").over(w) - mean * mean
    moments = by_group.withColumn("_mean_", mean).withColumn("_sd_", F.when(var > 1e-18, F.sqrt(var)).otherwise(F.lit(1.0)))
    moments = moments.withColumn("_c_", (F.col("_s_") / F.col("_n_") - F.col("_mean_")) / F.col("_sd_"))
    packed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("_p_", c))), lambda x: x[c])
    centroids = moments.groupBy(F.col("_fold_").alias(fold), F.col(group).alias("group")).agg(packed("_c_").alias("centre"), packed("_mean_").alias("_means_"), packed("_sd_").alias("_sds_"))
    scale = centroids.groupBy(fold).agg(F.first("_means_").alias("_means_"), F.first("_sds_").alias("_sds_"))
    z = F.zip_with(F.zip_with(features, "_means_", lambda a, m: a - m), "_sds_", lambda a, s: a / s)
    rows = df.join(F.broadcast(scale), fold).withColumn("_z_", z).drop("_means_", "_sds_")  # a row for each fold
    return nearest_centroid(rows, centroids.select(fold, "group", "centre"), [fold], "_z_").drop("_z_")


def confound_probe(predicted: DataFrame, group: str) -> DataFrame:
    """accuracy, chance (the largest group's share), skill, n, n_groups of nearest_centroid_cv."""
    per = predicted.groupBy(group).agg(F.count(F.lit(1)).alias("_n_"), F.sum((F.col("predicted") == F.col(group)).cast("long")).alias("_ok_"))
    got = per.agg((F.sum("_ok_") / F.sum("_n_")).alias("accuracy"), (F.max("_n_") / F.sum("_n_")).alias("chance"), F.sum("_n_").alias("n"), F.count(F.lit(1)).alias("n_groups"))
    return got.withColumn("skill", F.when(F.col("chance") < 1, (F.col("accuracy") - F.col("chance")) / (1 - F.col("chance"))))


def group_recall(predicted: DataFrame, group: str) -> DataFrame:
    return predicted.groupBy(group).agg(F.avg((F.col("predicted") == F.col(group)).cast("double")).alias("recall"), F.count(F.lit(1)).alias("n"))


def session_split(df: DataFrame, session: str, share: float, seed: int = 0) -> DataFrame:
    """Sessions with `split`: max(1, round(n * share)) of them, first by a seeded hash, are 'val'.

    The hash's first three digits count sessions into 4096 bins; of the bin in which the share ends, the first ones are taken
    by rank. No task sorts more than a bin.
    """
    ids = df.select(session).distinct().withColumn("_h_", seeded(F.col(session), seed)).withColumn("_bin_", F.substring("_h_", 1, 3))
    bins = ids.groupBy("_bin_").agg(F.count(F.lit(1)).alias("_n_"))
    w = Window.orderBy("_bin_").rowsBetween(Window.unboundedPreceding, -1)  # 4096 rows at most
    held = F.greatest(F.lit(1.0), F.rint(F.sum("_n_").over(Window.partitionBy(F.lit(0))) * share))
    bins = bins.select("_bin_", (held - F.coalesce(F.sum("_n_").over(w), F.lit(0))).alias("_left_"))
    rank = F.row_number().over(Window.partitionBy("_bin_").orderBy("_h_", session))
    return ids.withColumn("_r_", rank).join(F.broadcast(bins), "_bin_").select(session, F.when(F.col("_r_") <= F.col("_left_"), "val").otherwise("train").alias("split"))


def paired(a: DataFrame, b: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """Inner join of two dumps, columns of both with suffixes _a and _b, and diff = b - a."""
    left = a.select(*on, F.col(value).alias(f"{value}_a"))
    right = b.select(*on, F.col(value).alias(f"{value}_b"))
    return left.join(right, list(on)).withColumn("diff", F.col(f"{value}_b") - F.col(f"{value}_a"))


def wilcoxon(df: DataFrame, diff: str = "diff") -> dict[str, float]:
    """Signed ranks of the non-zero differences: w = min(w_plus, w_minus), and the two-sided p, exact without ties up to 50 rows, else normal with ties corrected.

    Rows are counted by value first. Values are cut into ranges of about equal counts, so that ranks are running counts
    within a range plus those of the ranges before, and no task sees all values.
    """
    size = F.abs(F.col(diff).cast("double"))
    sign = lambda s: F.sum(F.when(F.signum(F.col(diff)) == s, 1).otherwise(0))
    counts = df.where(F.col(diff).isNotNull() & (F.col(diff) != 0)).groupBy(size.alias("_a_")).agg(sign(1).alias("_p_"), sign(-1).alias("_m_")).withColumn("_k_", F.col("_p_") + F.col("_m_"))
    edges = sorted(set(counts.approxQuantile("_a_", [i / 64 for i in range(1, 64)], 0.005)))
    slot = F.lit(0) if not edges else F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col("_a_")))
    counts = counts.withColumn("_slot_", slot)
    before = counts.groupBy("_slot_").agg(F.sum("_k_").alias("_t_")).withColumn("_before_", F.coalesce(F.sum("_t_").over(Window.orderBy("_slot_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # 64 rows at most
    inside = F.sum("_k_").over(Window.partitionBy("_slot_").orderBy("_a_").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("_in_", inside).join(F.broadcast(before.select("_slot_", "_before_")), "_slot_").withColumn("_r_", F.col("_before_") + F.col("_in_") - (F.col("_k_") - 1) / 2.0)
    zero = F.lit(0.0)
    got = ranked.agg(F.coalesce(F.sum(F.col("_r_") * F.col("_p_")), zero).alias("plus"), F.coalesce(F.sum(F.col("_r_") * F.col("_m_")), zero).alias("minus"), F.coalesce(F.sum("_k_"), F.lit(0)).alias("n"), F.sum(F.pow("_k_", 3) - F.col("_k_")).alias("ties")).first()
    n, w, ties = int(got.n), min(got.plus, got.minus), got.ties
    if not n:
        return {"w_plus": 0.0, "w_minus": 0.0, "w": 0.0, "n": 0, "p": 1.0}
    if not ties and n <= 50:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + ways[: len(ways) - r]
        p = min(1.0, 2 * ways[: int(w) + 1].sum() / ways.sum())
    else:
        sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - (ties or 0) / 48)
        p = math.erfc(abs(w - n * (n + 1) / 4) / sd / math.sqrt(2)) if sd else 1.0
    return {"w_plus": got.plus, "w_minus": got.minus, "w": w, "n": n, "p": float(p)}


#: Fixed value: a prime below 2^31, so that squares fit in 64 bits.
PRIME = 2147483647
#: Factors of a draw and of a pick, and what each squaring adds.
DRAW, PICK, ADDED = 1103515245, 69069, (7919, 104729, 1299709)
#: Picks that a task makes at a time, and in all, about.
PICKS, TASK_PICKS = 1 << 14, 1 << 26
#: Bins for the places of a draw whose middle is far from the rows' middle.
PLACE_BINS = 1 << 16


def places(draw: int, n: int, seed: int) -> Iterator[np.ndarray]:
    """Rows 0..n-1 for picks 1..n of a draw, PICKS at a time: squares modulo a prime, which any engine can repeat."""
    prime, bits = np.uint64(PRIME), np.uint64(31)

    def fold(x: np.ndarray) -> None:  # 2^31 is 1 modulo the prime
        high = x >> bits
        x &= prime
        x += high

    steps, rows = np.arange(1, PICKS + 1, dtype=np.uint64) * np.uint64(PICK), np.uint32(min(n, (1 << 32) - 1))
    for at in range(0, n, PICKS):
        x = steps[: n - at] + np.uint64((draw * DRAW + at * PICK + seed * 40503 + 12345) % PRIME)
        for add in ADDED:
            fold(x)
            x *= x + np.uint64(1)
            x += np.uint64(add)
            fold(x)
        fold(x)
        x = np.minimum(x, x - prime).astype(np.uint32)  # below the prime, the other wraps
        yield x - x // rows * rows


def middle_places(draw: int, n: int, seed: int) -> tuple[int, int]:
    """The one or two middle places of a draw, as ranks 1..n of the rows by value. Only places near the middle are kept and sorted."""
    want = (n + 1) // 2, n // 2 + 1
    reach = 4 * math.isqrt(n) + 1  # eight times the middle's standard error
    low, high = max(0, n // 2 - reach), min(n, n // 2 + reach)
    while True:
        below, kept = 0, []
        for x in places(draw, n, seed):
            below += int(np.count_nonzero(x < np.uint32(low)))
            kept.append(x[x - np.uint32(low) < np.uint32(high - low)])
        near = np.concatenate(kept)
        if below < want[0] and want[1] <= below + len(near):
            near.sort()
            return int(near[want[0] - below - 1]) + 1, int(near[want[1] - below - 1]) + 1
        width = -(-min(n, PRIME) // PLACE_BINS)
        upto = np.cumsum(sum(np.bincount(x // np.uint32(width), minlength=PLACE_BINS) for x in places(draw, n, seed)))
        low, high = (int(np.searchsorted(upto, w)) * width for w in want)
        high += width


def at_ranks(df: DataFrame, x: str, low: int, high: int) -> DataFrame:
    """(_rank_, x) of the rows with ranks low..high, from 1 by value, equal ones in a row. No task sorts more than a range of values."""
    counts = df.groupBy(x).agg(F.count(F.lit(1)).alias("_k_"))
    edges = sorted(set(counts.approxQuantile(x, [i / 64 for i in range(1, 64)], 0.005)))
    slot = F.lit(0) if not edges else F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col(x)))
    counts = counts.withColumn("_slot_", slot)
    before = counts.groupBy("_slot_").agg(F.sum("_k_").alias("_t_")).withColumn("_before_", F.coalesce(F.sum("_t_").over(Window.orderBy("_slot_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # 64 rows at most
    inside = F.sum("_k_").over(Window.partitionBy("_slot_").orderBy(x).rowsBetween(Window.unboundedPreceding, 0))
    last = counts.withColumn("_in_", inside).join(F.broadcast(before.select("_slot_", "_before_")), "_slot_").withColumn("_last_", F.col("_before_") + F.col("_in_"))
    first = F.greatest(F.col("_last_") - F.col("_k_") + 1, F.lit(low))
    last = last.withColumn("_first_", first).withColumn("_last_", F.least(F.col("_last_"), F.lit(high))).where("_first_ <= _last_")
    return last.select(F.explode(F.sequence(F.col("_first_").cast("long"), F.col("_last_").cast("long"))).alias("_rank_"), x)


def bootstrap_median(df: DataFrame, x: str, draws: int = 2000, seed: int = 0, level: float = 0.95) -> DataFrame:
    """lo, hi: percentile interval of the median over resamples with replacement of all rows; null without rows.

    Each draw picks its rows by arithmetic on (draw, place), the same on every run. Rows count in order of value, so a draw's
    median is known by the places it picks: tasks make the draws without the rows, and only the rows at middle places are
    looked up. The driver gets two places of each draw.
    """
    spark = df.sparkSession
    rows = df.where(F.col(x).isNotNull()).select(F.col(x).cast("double").alias("_x_"))
    n = rows.count()
    if not n or draws < 1:
        return spark.createDataFrame([(None, None)], "lo double, hi double")

    def middles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [middle_places(k, n, seed) for k in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], pa.int64()) for i in (0, 1)], ["_lo_", "_hi_"])

    tasks = min(draws, max(spark.sparkContext.defaultParallelism, draws * n // TASK_PICKS))
    picked = [tuple(r) for r in spark.range(0, draws, 1, tasks).mapInArrow(middles, "_lo_ long, _hi_ long").groupBy("_lo_", "_hi_").count().collect()]
    picks = spark.createDataFrame(picked, "_lo_ long, _hi_ long, _times_ long")
    values = at_ranks(rows, "_x_", min(p[0] for p in picked), max(p[1] for p in picked))
    side = lambda c, to: values.withColumnsRenamed({"_rank_": c, "_x_": to})
    mid = picks.join(side("_lo_", "_a_"), "_lo_").join(side("_hi_", "_b_"), "_hi_").withColumn("_m_", (F.col("_a_") + F.col("_b_")) / 2)
    edge = (1 - level) / 2
    return mid.agg(F.percentile("_m_", F.lit(edge), F.col("_times_")).alias("lo"), F.percentile("_m_", F.lit(1 - edge), F.col("_times_")).alias("hi"))


def variance_split(df: DataFrame, n: str, squared: str) -> DataFrame:
    """Least squares of error^2 = floor^2 + b^2 / n: floor and b, roots of what is positive."""
    inverse = 1.0 / F.col(n)
    got = df.agg(F.regr_intercept(F.col(squared), inverse).alias("_f_"), F.regr_slope(F.col(squared), inverse).alias("_b_"))
    return got.select(F.sqrt(F.greatest(F.lit(0.0), F.col("_f_"))).alias("floor"), F.sqrt(F.greatest(F.lit(0.0), F.col("_b_"))).alias("b"))


def power_law(df: DataFrame, x: str, y: str) -> DataFrame:
    """exponent and factor of y = factor * x ^ exponent, on logarithms."""
    lx, ly = F.ln(F.col(x)), F.ln(F.col(y))
    return df.where((F.col(x) > 0) & (F.col(y) > 0)).agg(F.regr_slope(ly, lx).alias("exponent"), F.exp(F.regr_intercept(ly, lx)).alias("factor"))

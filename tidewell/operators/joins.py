"""Joins that equality alone doesn't express, rewritten so that the planner sees equality on buckets."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _bucket(x: Column, width: float) -> Column:
    return F.floor(x / F.lit(float(width))).cast("long")


def interval_join(points: DataFrame, intervals: DataFrame, by: Sequence[str], t: str, start: str, end: str, width: float, closed: bool = False, how: str = "inner") -> DataFrame:
    """Points (right side) that lie in intervals (left side): [start, end), or with closed [start, end].

    Both sides meet on `by` and on buckets of `width`, so that the work follows the matches instead of all pairs; a width of
    about an interval's length is best. An interval is listed once a bucket it touches and a point once, so a pair is found
    once. how='left' keeps intervals without points.
    """
    spread = intervals.withColumn("_bucket_", F.explode(F.when(F.col(start) <= F.col(end), F.sequence(_bucket(F.col(start), width), _bucket(F.col(end), width)))))
    placed = points.withColumn("_bucket_", _bucket(F.col(t), width))
    inside = (F.col(t) >= F.col(start)) & ((F.col(t) <= F.col(end)) if closed else (F.col(t) < F.col(end)))
    found = spread.join(placed, [*by, "_bucket_"]).where(inside).drop("_bucket_")
    if how == "inner":
        return found
    if how != "left":
        raise ValueError(how)
    keys = intervals.columns
    extra = [c for c in found.columns if c not in keys]
    renamed = found.select(*[F.col(c).alias(f"_k_{c}") for c in keys], *extra, F.lit(True).alias("_hit_"))
    on = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys]
    return intervals.join(renamed, on, "left").drop("_hit_", *[f"_k_{c}" for c in keys])


def band_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_t: str, right_t: str, tolerance: float) -> DataFrame:
    """Pairs with |left_t - right_t| <= tolerance (ends in). The left side is listed in its bucket and both neighbours."""
    width = max(float(tolerance), 1e-9)
    near = left.withColumn("_bucket_", F.explode(F.sequence(_bucket(F.col(left_t), width) - 1, _bucket(F.col(left_t), width) + 1)))
    return near.join(right.withColumn("_bucket_", _bucket(F.col(right_t), width)), [*by, "_bucket_"]).where(F.abs(F.col(left_t) - F.col(right_t)) <= tolerance).drop("_bucket_")


def numbered(df: DataFrame, by: Sequence[str], t: str, name: str) -> DataFrame:
    """Position of each row in its group by time, from 0."""
    from tidewell.functions.ordered import in_order

    return df.withColumn(name, (F.row_number().over(in_order(by, t)) - 1).cast("long"))


def match_events(predicted: DataFrame, true: DataFrame, by: Sequence[str], tolerance: float, t: str = "t_ms") -> DataFrame:
    """Greedy one-to-one matches: (by, i, j, pred_t, true_t, dt), nearest pairs first, ties by (i, j).

    i and j are positions by time. Candidates come from a band join. The choice is sequential by nature, but events of both
    kinds that lie farther than the tolerance from the next fall into islands that no pair crosses; a task sees one
    island's candidates, however long the session is.
    """
    p = numbered(predicted.select(*by, F.col(t).cast("double").alias("pred_t")), by, "pred_t", "i")
    q = numbered(true.select(*by, F.col(t).cast("double").alias("true_t")), by, "true_t", "j")
    pairs = band_join(p, q, by, "pred_t", "true_t", tolerance).withColumn("dt", F.col("pred_t") - F.col("true_t"))
    pairs = pairs.select(*by, "i", "j", "pred_t", "true_t", "dt")
    # a pair covers the time between its two events; pairs that share an event overlap there
    w = Window.partitionBy(*by).orderBy(F.least("pred_t", "true_t"), F.greatest("pred_t", "true_t"), "i", "j")
    reach = F.max(F.greatest("pred_t", "true_t")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.least("pred_t", "true_t") > reach), 1).otherwise(0)
    pairs = pairs.withColumn("_fresh_", fresh).withColumn("_island_", F.sum("_fresh_").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh_")

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        order = np.lexsort((rows["j"], rows["i"], rows["dt"].abs()))
        taken_i, taken_j, keep = set(), set(), []
        for k, i, j in zip(order.tolist(), rows["i"].to_numpy()[order].tolist(), rows["j"].to_numpy()[order].tolist(), strict=True):
            if i not in taken_i and j not in taken_j:
                taken_i.add(i)
                taken_j.add(j)
                keep.append(k)
        return rows.iloc[sorted(keep)]

    # a pair alone in its island needs no choice
    alone = pairs.withColumn("_n_", F.count(F.lit(1)).over(Window.partitionBy(*by, "_island_")))
    single, rest = alone.where("_n_ = 1").drop("_n_"), alone.where("_n_ > 1").drop("_n_")
    return single.unionByName(rest.groupBy(*by, "_island_").applyInPandas(choose, rest.schema)).drop("_island_")


def nearest_centroid(rows: DataFrame, centroids: DataFrame, on: Sequence[str], features: str = "features", centre: str = "centre", group: str = "group") -> DataFrame:
    """rows with `predicted`, the group of the smallest squared distance, ties to the smaller group.

    centroids: one row a group (and `on` keys, e.g. the fold); they are gathered in one array for each of the keys, so rows
    meet them in place and need no exchange.
    """
    gathered = centroids.groupBy(*on).agg(F.array_sort(F.collect_list(F.struct(F.col(group).alias("g"), F.col(centre).alias("c")))).alias("_all_"))
    gap = lambda c: F.aggregate(F.zip_with(features, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)
    best = F.array_min(F.transform("_all_", lambda x: F.struct(gap(x["c"]).alias("d"), x["g"].alias("g"))))
    return rows.join(F.broadcast(gathered), list(on)).withColumn("predicted", best["g"]).drop("_all_")  # a row for each of the keys

"""Expressions over rows in order within a series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

#: A 32-bit microsecond counter, and the factor from the median deviation to a normal sigma.
COUNTER = 2.0**32
MAD_SIGMA = 1.4826


def in_order(by: Sequence[str], order: Sequence[str] | str) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*([order] if isinstance(order, str) else order))


def delta(x: Column, w: WindowSpec) -> Column:
    """Difference to the row before; null on the first."""
    return x - F.lag(x).over(w)


def running_max(x: Column, w: WindowSpec) -> Column:
    return F.max(x).over(w.rowsBetween(Window.unboundedPreceding, 0))


def running_sum(x: Column, w: WindowSpec) -> Column:
    return F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, 0))


def unwrap(df: DataFrame, by: Sequence[str], order: Sequence[str] | str, raw: str, out: str = "unwrapped", wraps: str = "wraps") -> DataFrame:
    """Undo the rollover of a 32-bit counter: a fall by more than half its range adds a whole range from there on.

    `wraps` counts the rollovers up to the row.
    """
    w = in_order(by, order)
    fell = F.when(delta(F.col(raw), w) < -COUNTER / 2, 1).otherwise(0)
    marked = df.withColumn("_fell_", fell)
    turns = running_sum(F.col("_fell_"), w)
    return marked.withColumn(wraps, turns.cast("long")).withColumn(out, F.col(raw).cast("double") + F.col(wraps) * F.lit(COUNTER)).drop("_fell_")


def average_rank(x: Column, by: Sequence[str] = ()) -> Column:
    """Rank from 1, ties sharing their mean."""
    keys = [F.col(c) for c in by]
    return F.rank().over(Window.partitionBy(*keys).orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, x)) - 1) / 2.0


def percentile_rank(x: Column, by: Sequence[str] = ()) -> Column:
    """Average rank over the number of rows."""
    return average_rank(x, by) / F.count(x).over(Window.partitionBy(*[F.col(c) for c in by]))


def deviation(df: DataFrame, by: Sequence[str], x: str, out: str = "mad") -> DataFrame:
    """Median absolute deviation of x for each group, times the normal factor; and the median, as `<out>_median`."""
    centre = df.groupBy(*by).agg(F.median(x).alias(f"{out}_median"))
    joined = df.join(centre, list(by)) if by else df.crossJoin(centre)
    spread = joined.groupBy(*by, f"{out}_median").agg((F.median(F.abs(F.col(x) - F.col(f"{out}_median"))) * MAD_SIGMA).alias(out))
    return spread


def correlation(x: Column, y: Column) -> Column:
    """Aggregate: Pearson's correlation, null where either side doesn't vary."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))

"""Two microphones side by side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.functions.ordered import correlation, in_order


def channel_report(df: DataFrame, by: Sequence[str], left: str, right: str) -> DataFrame:
    """Deviations of both sides and of their difference, the share of equal samples, and the correlation (null where a side is flat)."""
    a, b = F.col(left).cast("double"), F.col(right).cast("double")
    return df.groupBy(*by).agg(F.stddev_pop(a).alias("sd_left"), F.stddev_pop(b).alias("sd_right"), F.avg((a == b).cast("double")).alias("identical"), correlation(a, b).alias("correlation"), F.stddev_pop(a - b).alias("sd_diff"))


def best_lag(df: DataFrame, by: Sequence[str], order: str, left: str, right: str, most: int = 4) -> DataFrame:
    """The shift of the right side, -most..most rows, that leaves the least deviation of left - right; the first of equal ones. Rows within `most` of an end don't count."""
    w = in_order(by, order)
    n = F.count(F.lit(1)).over(in_order(by, order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = df.withColumn("_i_", F.row_number().over(w)).withColumn("_n_", n)
    shifts = range(-most, most + 1)
    rows = rows.withColumns({f"_s{k + most}_": F.col(left) - F.lag(F.col(right), k).over(w) for k in shifts}).where((F.col("_i_") > most) & (F.col("_i_") <= F.col("_n_") - most))
    spread = rows.groupBy(*by).agg(*[F.round(F.stddev_pop(f"_s{k + most}_"), 9).alias(f"_d{k + most}_") for k in shifts])
    return spread.select(*by, F.array_min(F.array(*[F.struct(F.col(f"_d{k + most}_").alias("sd"), F.lit(k).alias("lag")) for k in shifts])).alias("_b_")).select(*by, F.col("_b_.lag").alias("lag"), F.col("_b_.sd").alias("sd"))

"""Sliding windows of samples, and filters along a series."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.functions.ordered import in_order


def window_members(df: DataFrame, by: Sequence[str], order: str, length: int, hop: int) -> DataFrame:
    """Each row once for every window it is in, with window_idx and its place in the window (`sample`).

    Windows begin at rows 0, hop, 2 hop, ... of the group and hold `length` rows; a partial one at the end is none.
    """
    w = in_order(by, order)
    rows = df.withColumn("_i_", F.row_number().over(w).cast("long") - 1).withColumn("_n_", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    low = F.greatest(F.lit(0), F.ceil((F.col("_i_") - length + 1) / F.lit(hop))).cast("long")
    high = F.least(F.floor(F.col("_i_") / hop), F.floor((F.col("_n_") - length) / F.lit(hop))).cast("long")
    rows = rows.withColumn("_lo_", low).withColumn("_hi_", high).where((F.col("_n_") >= length) & (F.col("_lo_") <= F.col("_hi_")))
    rows = rows.withColumn("window_idx", F.explode(F.sequence("_lo_", "_hi_")))
    return rows.withColumn("sample", (F.col("_i_") - F.col("window_idx") * hop).cast("int")).drop("_i_", "_n_", "_lo_", "_hi_")


def make_windows(df: DataFrame, by: Sequence[str], t: str, length: int, hop: int) -> DataFrame:
    """(by, window_idx, start_sample, t_start_ms, t_end_ms): the end is the last sample's time."""
    return window_members(df, by, t, length, hop).groupBy(*by, "window_idx").agg(F.min(t).alias("t_start_ms"), F.max(t).alias("t_end_ms")).withColumn("start_sample", F.col("window_idx") * hop)


def window_frames(df: DataFrame, by: Sequence[str], order: str, channels: Sequence[str], length: int, hop: int) -> DataFrame:
    """(by, window_idx, frames): channels x samples, only for those who need the samples themselves."""
    got = window_members(df, by, order, length, hop).groupBy(*by, "window_idx").agg(F.array_sort(F.collect_list(F.struct("sample", *channels))).alias("_s_"))
    return got.withColumn("frames", F.array(*[F.transform(F.col("_s_")[c], lambda v: v.cast("float")) for c in channels])).drop("_s_")


def rolling_median(df: DataFrame, by: Sequence[str], order: str, x: str, width: int, out: str = "median") -> DataFrame:
    """Median of the `width` rows around each (for an even width one more before than after), fewer at the ends."""
    half = width // 2
    w = in_order(by, order).rowsBetween(-half, width - 1 - half)
    values = F.array_sort(F.collect_list(F.col(x).cast("double")).over(w))
    rows = df.withColumn("_v_", values).withColumn("_n_", F.size("_v_"))
    low, high = F.floor((F.col("_n_") + 1) / 2).cast("int"), F.floor(F.col("_n_") / 2).cast("int") + 1
    return rows.withColumn(out, F.when(F.col("_n_") > 0, (F.element_at("_v_", low) + F.element_at("_v_", F.least(high, F.col("_n_")))) / 2)).drop("_v_", "_n_")


def ema_baseline(df: DataFrame, by: Sequence[str], order: str, channels: Sequence[str], alpha: float, seed_n: int) -> DataFrame:
    """channels less their exponential moving average, FLOAT.

    The average starts from the mean of the first seed_n rows and takes the first row in at once. A recurrence over the
    whole series, so a vectorised kernel sees one series at a time.
    """
    if not 0 < alpha < 1:
        raise ValueError(f"alpha must lie between 0 and 1, not {alpha}")
    fields = ", ".join(f"`{f.name}` {'float' if f.name in channels else f.dataType.simpleString()}" for f in df.schema.fields)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        for c in channels:
            x = pdf[c].to_numpy(np.float64)
            pdf[c] = (x - ema(x, alpha, float(x[:seed_n].mean()))).astype(np.float32)
        return pdf

    return df.groupBy(*by).applyInPandas(run, fields)


def ema(x: np.ndarray, alpha: float, start: float) -> np.ndarray:
    """y[n] = alpha x[n] + (1 - alpha) y[n - 1] from y[-1] = start, in blocks short enough that no power underflows."""
    out = np.empty(len(x))
    keep = 1.0 - alpha
    size = max(1, min(len(x), int(500 / max(1e-12, -np.log(keep)))))
    size = min(size, 1 << 14)
    powers = keep ** np.arange(size + 1)
    for at in range(0, len(x), size):
        part = x[at : at + size]
        n = len(part)
        out[at : at + n] = (start + alpha * np.cumsum(part / powers[1 : n + 1])) * powers[1 : n + 1]
        start = out[at + n - 1]
    return out

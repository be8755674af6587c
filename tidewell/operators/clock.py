"""Free-running device clocks onto a shared timebase, and repair of timestamps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.functions.ordered import COUNTER, MAD_SIGMA, delta, in_order, running_max, unwrap


class TimestampError(ValueError):
    """A stream's time runs back by more than a repair may hide."""


def pooled_skew(alignment: DataFrame, by: Sequence[str] = ("board",)) -> DataFrame:
    """Inverse-variance mean of resolved skews: columns skew_applied, skew_ppm, skew_se_ppm, skew_confidence.

    The applied skew counts where there is one; a missing or zero standard error weighs 1. Groups without a resolved skew
    have no row.
    """
    skew = F.coalesce("skew_applied", "skew_ppm")
    se = F.col("skew_se_ppm")
    weight = F.when(se.isNull() | (se == 0), F.lit(1.0)).otherwise(1.0 / F.pow(F.greatest(se, F.lit(1e-6)), 2))
    rows = alignment.where((F.col("skew_confidence") == "resolved") & skew.isNotNull()).withColumn("_s_", skew).withColumn("_w_", weight)
    return rows.groupBy(*by).agg((F.sum(F.col("_w_") * F.col("_s_")) / F.sum("_w_")).alias("pooled_skew_ppm"), F.count(F.lit(1)).alias("n_captures"))


def fit_clock(sync: DataFrame, by: Sequence[str], skew: str, host: str = "host_s", device: str = "device_s") -> DataFrame:
    """Offset, residual (RMS, ms) and jitter (robust, ms) of host = (1 + skew * 1e-6) * device + offset for each group.

    `skew` is a column of sync; it is taken as given, never refitted. The offset is the median of what remains.
    """
    rows = sync.withColumn("_rest_", F.col(host) - (1 + F.col(skew) * 1e-6) * F.col(device))
    offset = rows.groupBy(*by).agg(F.median("_rest_").alias("offset_s"), F.count(F.lit(1)).alias("n_sync_points"), F.first(skew).alias("skew_ppm"))
    residual = rows.join(offset.select(*by, "offset_s"), list(by)).withColumn("_r_", F.col("_rest_") - F.col("offset_s"))
    centre = residual.groupBy(*by).agg(F.median("_r_").alias("_m_"), F.sqrt(F.avg(F.col("_r_") * F.col("_r_"))).alias("_rms_"))
    spread = residual.join(centre, list(by)).groupBy(*by).agg((F.median(F.abs(F.col("_r_") - F.col("_m_"))) * MAD_SIGMA * 1000).alias("jitter_ms"), (F.first("_rms_") * 1000).alias("residual_ms"))
    return offset.join(spread, list(by)).withColumn("slope", 1 + F.col("skew_ppm") * 1e-6)


def check_convention(sync: DataFrame, fitted: DataFrame, by: Sequence[str], host: str = "host_s", device: str = "device_s") -> DataFrame:
    """fitted with best_ms (robust scatter about a fitted line) and suspicious: jitter above max(3 best, best + 5). Fewer than three points are never suspicious."""
    line = sync.groupBy(*by).agg(F.regr_slope(host, device).alias("_slope_"), F.count(F.lit(1)).alias("_n_"))
    rest = sync.join(line, list(by)).withColumn("_rest_", F.col(host) - F.col("_slope_") * F.col(device))
    centre = rest.groupBy(*by).agg(F.median("_rest_").alias("_m_"))
    best = rest.join(centre, list(by)).groupBy(*by).agg((F.median(F.abs(F.col("_rest_") - F.col("_m_"))) * MAD_SIGMA * 1000).alias("best_ms"), F.first("_n_").alias("_n_"))
    worse = F.col("jitter_ms") > F.greatest(3 * F.col("best_ms"), F.col("best_ms") + 5)
    return fitted.join(best, list(by)).withColumn("suspicious", (F.col("_n_") >= 3) & worse).drop("_n_")


def align_device(df: DataFrame, by: Sequence[str], order: str, raw: str, centre: str, out: str = "device_us") -> DataFrame:
    """Unwrap a stream's counter and shift it by whole counter periods, so that its median comes closest to column `centre`; a null one shifts nothing."""
    open_ = unwrap(df, by, order, raw, out="_open_", wraps="wraps")
    middle = open_.groupBy(*by).agg(F.median("_open_").alias("_middle_"))
    periods = F.coalesce(F.rint((F.col(centre) - F.col("_middle_")) / COUNTER), F.lit(0.0))
    return open_.join(middle, list(by)).withColumn(out, F.col("_open_") + periods * COUNTER).drop("_open_", "_middle_")


def to_session_ms(device_us: Column, slope: Column, offset_s: Column, t0_s: Column) -> Column:
    return (slope * device_us * 1e-6 + offset_s - t0_s) * 1000


def repair(df: DataFrame, by: Sequence[str], order: str, t: str = "t_ms", out: str = "t_ms") -> DataFrame:
    """Running maximum of the time, so that it never falls; check_backsteps says whether that is fair."""
    return df.withColumn(out, running_max(F.col(t), in_order(by, order)))


def backsteps(df: DataFrame, by: Sequence[str], order: str, t: str = "t_ms") -> DataFrame:
    """n_backsteps and worst_backstep (largest fall between neighbours, 0 if none) of each group."""
    rows = df.withColumn("_d_", delta(F.col(t), in_order(by, order)))
    return rows.groupBy(*by).agg(F.sum(F.when(F.col("_d_") < 0, 1).otherwise(0)).cast("long").alias("n_backsteps"), F.greatest(F.lit(0.0), F.coalesce(-F.min("_d_").cast("double"), F.lit(0.0))).alias("worst_backstep"))


def refuse_backsteps(steps: DataFrame, max_backstep: float = 25.0) -> None:
    """TimestampError where a fall among backsteps of several streams (with columns session_id and stream) exceeds max_backstep."""
    worst = steps.where(F.col("worst_backstep") > max_backstep).first()
    if worst is not None:
        raise TimestampError(f"{worst['stream']}: time runs back by {worst['worst_backstep']:.3f} ms in {worst['session_id']}, more than {max_backstep}")


def repaired(df: DataFrame, by: Sequence[str], order: str, t: str = "t_ms", stream: str = "stream", max_backstep: float = 25.0) -> DataFrame:
    """repair, or TimestampError where a fall exceeds max_backstep."""
    worst = backsteps(df, by, order, t).where(F.col("worst_backstep") > max_backstep).select(*[F.col(c).cast("string") for c in by], "worst_backstep").first()
    if worst is not None:
        raise TimestampError(f"{stream}: time runs back by {worst['worst_backstep']:.3f} ms in {list(worst)[:-1]}, more than {max_backstep}")
    return repair(df, by, order, t)


def effective_rate(df: DataFrame, by: Sequence[str], order: str, t: str = "t_ms", per: float = 1000.0, out: str = "rate") -> DataFrame:
    """`per` over the median step; null with fewer than two rows or a step of zero or less."""
    rows = df.withColumn("_d_", delta(F.col(t), in_order(by, order)))
    step = F.median("_d_")
    return rows.groupBy(*by).agg(F.when(step > 0, F.lit(per) / step).alias(out))


def device_rate(df: DataFrame, by: Sequence[str], order: str, raw: str) -> DataFrame:
    """Sampling rate in Hz of a microsecond counter that may roll over."""
    return effective_rate(unwrap(df, by, order, raw, out="_u_"), by, order, "_u_", 1e6, "fs_hz")


def wrap_report(df: DataFrame, by: Sequence[str], order: str, raw: str) -> DataFrame:
    """n_wraps, n_other_backsteps, peak and pct_of_range of each stream."""
    d = delta(F.col(raw).cast("double"), in_order(by, order))
    rows = df.withColumn("_d_", d)
    fell = F.col("_d_") < -COUNTER / 2
    return rows.groupBy(*by).agg(
        F.sum(F.when(fell, 1).otherwise(0)).cast("long").alias("n_wraps"), F.sum(F.when((F.col("_d_") < 0) & ~fell, 1).otherwise(0)).cast("long").alias("n_other_backsteps"),
        F.max(raw).cast("double").alias("peak"), (F.max(raw).cast("double") * 100.0 / COUNTER).alias("pct_of_range"),
    )


def headroom(report: DataFrame, k: int = 6) -> DataFrame:
    """The k streams closest to a rollover."""
    return report.orderBy(F.desc("pct_of_range"), *[F.asc(c) for c in report.columns if c not in ("n_wraps", "n_other_backsteps", "peak", "pct_of_range")]).limit(k)


def strictly_increasing(df: DataFrame, by: Sequence[str], t: str, order: str) -> DataFrame:
    """The first row, by `order`, of each time."""
    w = Window.partitionBy(*by, t).orderBy(order)
    return df.withColumn("_n_", F.row_number().over(w)).where("_n_ = 1").drop("_n_")

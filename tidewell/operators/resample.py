"""Irregular streams onto a uniform grid, and interpolation between samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.functions.ordered import delta, in_order


def grid_size(t0: Column, t1: Column, hz: float) -> Column:
    return F.floor((t1 - t0) / F.lit(1000.0 / hz)) + 1


def make_grid(spans: DataFrame, hz: float, t0: str = "t0_ms", t1: str = "t1_ms") -> DataFrame:
    """Rows (grid_idx, t_ms) at t0 + k * step up to t1 for each row of spans, whose other columns stay."""
    if not hz > 0:
        raise ValueError(f"a grid needs a positive rate, not {hz}")
    ok = F.col(t0).isNotNull() & F.col(t1).isNotNull() & ~F.isnan(t0) & ~F.isnan(t1) & (F.col(t1) >= F.col(t0))
    step = 1000.0 / hz
    return (
        spans.where(ok).withColumn("grid_idx", F.explode(F.sequence(F.lit(0).cast("long"), grid_size(F.col(t0), F.col(t1), hz) - 1)))
        .withColumn("t_ms", F.col(t0) + F.col("grid_idx") * F.lit(step))
    )


def _between(rows: DataFrame, by: Sequence[str], t: str, values: Sequence[str], asked: str) -> DataFrame:
    """Where column `asked` is true: values interpolated from the other rows of the group, clamped at its ends."""
    w = Window.partitionBy(*by).orderBy(t, F.col(asked).cast("int"))
    sample = lambda c: F.when(~F.col(asked) & F.col(c).isNotNull(), F.struct(F.col(t).alias("t"), F.col(c).alias("v")))
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumns({f"_a_{c}": F.last(sample(c), ignorenulls=True).over(before) for c in values} | {f"_b_{c}": F.first(sample(c), ignorenulls=True).over(after) for c in values})

    def value(c: str) -> Column:
        a, b = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        inside = a["v"] + (b["v"] - a["v"]) * (F.col(t) - a["t"]) / (b["t"] - a["t"])
        return F.when(a.isNull(), b["v"]).when(b.isNull() | (a["t"] == F.col(t)) | (b["t"] == a["t"]), a["v"]).otherwise(inside)

    return rows.where(asked).withColumns({c: value(c) for c in values}).drop(*(f"_{k}_{c}" for c in values for k in "ab"))


def interpolate(points: DataFrame, samples: DataFrame, by: Sequence[str], values: Sequence[str], t: str = "t_ms") -> DataFrame:
    """points with the samples' values at their times: linear in between, clamped at the ends, null without samples.

    Both sides are joined as one sorted series, so a group is read once, whatever its number of points.
    """
    extra = [c for c in points.columns if c not in (*by, t, *values)]
    asked = points.select(*by, t, *extra, F.lit(True).alias("_asked_"), *[F.lit(None).cast("double").alias(c) for c in values])
    given = samples.select(*by, F.col(t).cast(points.schema[t].dataType), *[F.lit(None).cast(points.schema[c].dataType).alias(c) for c in extra], F.lit(False).alias("_asked_"), *[F.col(c).cast("double") for c in values])
    return _between(asked.unionByName(given), by, t, values, "_asked_").drop("_asked_")


def resample_linear(samples: DataFrame, grid: DataFrame, by: Sequence[str], values: Sequence[str], t: str = "t_ms", order: str | None = None) -> DataFrame:
    """grid with the samples' channels as FLOAT. Samples whose time doesn't rise over the row before go first."""
    if order is not None:
        samples = samples.withColumn("_d_", delta(F.col(t), in_order(by, order))).where("_d_ is null or _d_ > 0").drop("_d_")
    out = interpolate(grid, samples, by, values, t)
    return out.withColumns({c: F.col(c).cast("float") for c in values})


def fill_gaps(df: DataFrame, by: Sequence[str], order: str, x: str, out: str | None = None, zero_is_gap: bool = True) -> DataFrame:
    """fill_all_gaps of one column."""
    return fill_all_gaps(df, by, order, {x: out or x}, zero_is_gap)


def fill_all_gaps(df: DataFrame, by: Sequence[str], order: str, columns: Mapping[str, str], zero_is_gap: bool = True) -> DataFrame:
    """Missing samples (null, NaN or, where zero_is_gap, exactly 0) interpolated by row number, clamped at the ends; columns: from -> to.

    A group with fewer than two good samples becomes all zeros. All columns share one pass in order.
    """
    good = lambda x: F.when(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double")) & ((F.col(x) != 0) if zero_is_gap else F.lit(True)), F.col(x).cast("double"))
    names = {x: f"_g{i}_" for i, x in enumerate(columns)}
    rows = df.withColumn("_i_", F.row_number().over(in_order(by, order))).withColumns({g: good(x) for x, g in names.items()})
    w, whole = in_order(by, "_i_"), Window.partitionBy(*by)
    seen = lambda g: F.when(F.col(g).isNotNull(), F.struct(F.col("_i_").alias("i"), F.col(g).alias("v")))
    rows = rows.withColumns({f"{g}a": F.last(seen(g), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) for g in names.values()})
    rows = rows.withColumns({f"{g}b": F.first(seen(g), ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)) for g in names.values()})
    rows = rows.withColumns({f"{g}n": F.count(g).over(whole) for g in names.values()})

    def value(g: str) -> Column:
        a, b = F.col(f"{g}a"), F.col(f"{g}b")
        inside = a["v"] + (b["v"] - a["v"]) * (F.col("_i_") - a["i"]) / (b["i"] - a["i"])
        return F.when(F.col(f"{g}n") < 2, F.lit(0.0)).when(F.col(g).isNotNull(), F.col(g)).when(a.isNull(), b["v"]).when(b.isNull(), a["v"]).otherwise(inside)

    return rows.withColumns({columns[x]: value(g) for x, g in names.items()}).drop("_i_", *names.values(), *(f"{g}{k}" for g in names.values() for k in "abn"))


def envelope(samples: DataFrame, grid: DataFrame, by: Sequence[str], x: str, hz: float, t: str = "t_ms", t0: str = "t0_ms", out: str = "envelope") -> DataFrame:
    """RMS of the samples in half a step around each grid point (lower end in), FLOAT.

    grid has columns by, grid_idx and t0 (its first time). Empty bins are interpolated over the grid index, clamped at the
    ends; a group with no sample in any bin gets zeros.
    """
    step = 1000.0 / hz
    starts = grid.select(*by, t0).distinct()
    binned = samples.join(starts, list(by)).withColumn("grid_idx", F.floor((F.col(t) - (F.col(t0) - F.lit(step / 2))) / F.lit(step)).cast("long"))
    level = binned.groupBy(*by, "grid_idx").agg(F.sqrt(F.avg(F.col(x).cast("double") * F.col(x))).alias(out))
    rows = grid.join(level, [*by, "grid_idx"], "left")
    w = in_order(by, "grid_idx")
    seen = F.when(F.col(out).isNotNull(), F.struct(F.col("grid_idx").alias("i"), F.col(out).alias("v")))
    rows = rows.withColumn("_a_", F.last(seen, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_b_", F.first(seen, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    inside = F.col("_a_.v") + (F.col("_b_.v") - F.col("_a_.v")) * (F.col("grid_idx") - F.col("_a_.i")) / (F.col("_b_.i") - F.col("_a_.i"))
    value = F.when(F.col(out).isNotNull(), F.col(out)).when(F.col("_a_").isNull(), F.coalesce("_b_.v", F.lit(0.0))).when(F.col("_b_").isNull(), F.col("_a_.v")).otherwise(inside)
    return rows.withColumn(out, value.cast("float")).drop("_a_", "_b_")


def block_rms(df: DataFrame, by: Sequence[str], order: str, x: str, block: int, least: int = 8, out: str = "rms") -> DataFrame:
    """RMS about the group's mean of each full block of rows, in order: (by, block_idx, out). Groups with fewer than `least` blocks have none."""
    rows = df.withColumn("_i_", F.row_number().over(in_order(by, order)) - 1).withColumn("_m_", F.avg(F.col(x).cast("double")).over(Window.partitionBy(*by))).withColumn("block_idx", F.floor(F.col("_i_") / block).cast("long"))
    rest = F.col(x) - F.col("_m_")
    blocks = rows.groupBy(*by, "block_idx").agg(F.sqrt(F.avg(rest * rest)).alias(out), F.count(F.lit(1)).alias("_n_")).where(F.col("_n_") == block)
    return blocks.withColumn("_k_", F.count(F.lit(1)).over(Window.partitionBy(*by))).where(F.col("_k_") >= least).drop("_k_", "_n_")


def acoustic_envelope(df: DataFrame, by: Sequence[str], order: str, x: str, fs: float, envelope_hz: float = 50.0) -> tuple[DataFrame, float]:
    """block_rms at about envelope_hz, and the rate it comes out at."""
    block = max(int(round(fs / envelope_hz)), 1)
    return block_rms(df, by, order, x, block), fs / block

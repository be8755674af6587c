"""Features of windows: strain, sound, motion, and their vector of 130."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.operators import kernels as K

N_STRAIN, N_MIC, N_IMU = 8, 2, 6
STRAIN = ("mean", "std", "range", "rms", "slope", "p2p", "zcr", "dominant", "energy")
SOUND = ("log_energy", "rms", "zcr", "centroid", "rolloff", "bandwidth", "band_ratio", *(f"mfcc{i}" for i in range(13)))
#: The gap between 1 and the next double, which bounds the rounding of a sum by its terms.
EPSILON = 2.0**-52
FEATURES = N_STRAIN * len(STRAIN) + N_MIC * len(SOUND) + 1 + 2 * N_IMU + 5


def zero_cross_rate(x: Column, w) -> Column:
    """Per row, whether the sign changed from the row before (zero is a sign of its own); its mean is the rate."""
    before = F.lag(x).over(w)
    return F.when(before.isNotNull(), (F.signum(x) != F.signum(before)).cast("double"))


def series_stats(members: DataFrame, by: Sequence[str], x: str, order: str = "sample") -> DataFrame:
    """mean, std, range, rms, slope per sample, p2p, zcr, energy of each window's channel, all inside the engine."""
    v = F.col(x).cast("double")
    w = Window.partitionBy(*by).orderBy(order)
    whole = Window.partitionBy(*by)
    # the mean is known up to its rounding, which follows the order of the sum: a value that near is at it
    near = F.count("_x_").over(whole) * F.max(F.abs("_x_")).over(whole) * F.lit(EPSILON)
    rows = members.withColumn("_x_", v).withColumn("_c_", F.col("_x_") - F.avg("_x_").over(whole)).withColumn("_c_", F.when((F.abs("_c_") <= near) & (near < float("inf")), F.lit(0.0)).otherwise(F.col("_c_")))
    rows = rows.withColumn("_z_", zero_cross_rate(F.col("_c_"), w)).withColumn("_i_", F.row_number().over(w).cast("double") - 1)
    span = F.max("_x_") - F.min("_x_")
    return rows.groupBy(*by).agg(
        F.avg("_x_").alias("mean"), F.stddev_pop("_x_").alias("std"), span.alias("range"), F.sqrt(F.avg(F.col("_x_") * F.col("_x_"))).alias("rms"),
        F.coalesce(F.regr_slope("_x_", "_i_"), F.lit(0.0)).alias("slope"), span.alias("p2p"), F.coalesce(F.avg("_z_"), F.lit(0.0)).alias("zcr"), F.sum(F.col("_x_") * F.col("_x_")).alias("energy"),
    )


def motion_stats(members: DataFrame, by: Sequence[str], channels: Sequence[str], order: str = "sample") -> DataFrame:
    """17 motion features of each window: mean and std of each axis, mean |acc|, mean |gyr|, motion energy, jerk, tilt."""
    ax, ay, az, gx, gy, gz = (F.col(c).cast("double") for c in channels)
    w = Window.partitionBy(*by).orderBy(order)
    size = F.sqrt(ax * ax + ay * ay + az * az)
    rows = members.withColumns({"_a_": size, "_g_": F.sqrt(gx * gx + gy * gy + gz * gz)}).withColumn("_j_", F.abs(F.col("_a_") - F.lag("_a_").over(w)))
    aggs = [f(c).alias(f"{c}_{n}") for c in channels for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))]
    got = rows.groupBy(*by).agg(*aggs, F.avg("_a_").alias("acc_size"), F.avg("_g_").alias("gyr_size"), F.avg(F.col("_a_") * F.col("_a_")).alias("motion_energy"), F.coalesce(F.avg("_j_"), F.lit(0.0)).alias("jerk"))
    tilt = F.atan2(F.sqrt(F.col(f"{channels[0]}_mean") ** 2 + F.col(f"{channels[1]}_mean") ** 2), F.abs(F.col(f"{channels[2]}_mean")) + 1e-8)
    return got.withColumn("tilt", tilt)


def window_amplitudes(members: DataFrame, by: Sequence[str], channels: Sequence[str]) -> DataFrame:
    """RMS about the window's mean of each channel."""
    return members.groupBy(*by, "window_idx").agg(*[F.stddev_pop(F.col(c).cast("double")).alias(c) for c in channels])


def _crossings(block: np.ndarray) -> np.ndarray:
    """Of each row: share of steps over which the sign about its mean changes."""
    if block.shape[1] < 2:
        return np.zeros(len(block))
    centred = block - block.mean(axis=1, keepdims=True)
    near = block.shape[1] * EPSILON * np.abs(block).max(axis=1, keepdims=True)  # as in series_stats
    centred[(np.abs(centred) <= near) & (near < np.inf)] = 0
    return (np.diff(np.sign(centred), axis=1) != 0).mean(axis=1)


def strain_block(block: np.ndarray, fs: float) -> np.ndarray:
    """Rows of samples to their STRAIN features."""
    block = np.asarray(block, np.float64)
    n = block.shape[1]
    place = np.arange(n) - (n - 1) / 2
    energy, span = np.einsum("rn,rn->r", block, block), np.ptp(block, axis=1)
    slope = block @ place / (place @ place) if n > 1 else np.zeros(len(block))
    return np.column_stack([block.mean(axis=1), block.std(axis=1), span, np.sqrt(energy / n), slope, span, _crossings(block), K.dominant_frequency(block, fs), energy])


def sound_block(block: np.ndarray, fs: float) -> np.ndarray:
    """Rows of samples to their SOUND features."""
    block = np.asarray(block, np.float64)
    power = np.einsum("rn,rn->r", block, block) / block.shape[1]
    return np.column_stack([np.log(power + 1e-8), np.sqrt(power), _crossings(block), K.spectral_shape(block, fs), K.power_ratio(block, fs), K.cepstrum(block)])


def motion_block(block: np.ndarray) -> np.ndarray:
    """(windows, 6 axes, samples) to 17 features each: mean and deviation by axis, then sizes, energy, jerk and tilt."""
    block = np.asarray(block, np.float64)
    mean = block.mean(axis=2)
    size, turn = (np.sqrt(np.einsum("wan,wan->wn", x, x)) for x in (block[:, :3], block[:, 3:6]))
    jerk = np.abs(np.diff(size, axis=1)).mean(axis=1) if block.shape[2] > 1 else np.zeros(len(block))
    tilt = np.arctan2(np.hypot(mean[:, 0], mean[:, 1]), np.abs(mean[:, 2]) + 1e-8)
    by_axis = np.stack([mean, block.std(axis=2)], axis=2).reshape(len(block), -1)
    return np.column_stack([by_axis, size.mean(axis=1), turn.mean(axis=1), np.square(size).mean(axis=1), jerk, tilt])


def window_block(frames: np.ndarray, mic: np.ndarray, fs: float, mic_fs: float) -> np.ndarray:
    """All features of windows of one shape, FLOAT, in order: strain channels, sound channels, their mean difference if there are two, motion.

    frames: windows x channels x samples (strain, sound envelopes, motion); mic: windows x channels x native samples.
    """
    n = len(frames)
    strain = strain_block(frames[:, :N_STRAIN].reshape(n * N_STRAIN, -1), fs).reshape(n, -1)
    sound = sound_block(mic.reshape(n * mic.shape[1], -1), mic_fs).reshape(n, -1)
    apart = [np.abs(mic[:, 0] - mic[:, 1]).mean(axis=1)] if mic.shape[1] == 2 else []
    return np.column_stack([strain, sound, *apart, motion_block(frames[:, N_STRAIN + N_MIC :])]).astype(np.float32)


def window_features(windows: DataFrame, fs: float, mic_fs: float | str, frames: str = "frames", mic: str = "mic", out: str = "hand") -> DataFrame:
    """windows with `out`, their 130 features: strain and motion from the frames (8 strain, 2 sound envelopes, 6 motion rows), sound from `mic` (channels x native samples; 16 zero samples where a window has none), at mic_fs or the rate in the column of that name."""
    fields = windows.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            f = [np.stack([np.asarray(c, np.float64) for c in x]) for x in rows[frames]]
            m = [np.stack([np.asarray(c, np.float64) for c in x]) if x is not None and len(x) and len(x[0]) else np.zeros((N_MIC, 16)) for x in rows[mic]]
            like: dict[tuple, list[int]] = {}
            rates = rows[mic_fs].tolist() if isinstance(mic_fs, str) else [mic_fs] * len(rows)
            for i, (a, b, hz) in enumerate(zip(f, m, rates, strict=True)):
                like.setdefault((a.shape, b.shape, hz), []).append(i)
            got: list = [None] * len(rows)
            for (*_, hz), at in like.items():
                for i, v in zip(at, window_block(np.stack([f[i] for i in at]), np.stack([m[i] for i in at]), fs, hz).tolist(), strict=True):
                    got[i] = v
            yield rows.assign(**{out: got})

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return windows.mapInPandas(run, f"{columns}, `{out}` array<float>")


def spectral_features(windows: DataFrame, by: Sequence[str], x: str, fs: float) -> DataFrame:
    """dominant, centroid, rolloff, bandwidth, band_ratio and cepstrum of an array column of samples."""
    keys = ", ".join(f"`{c}` {windows.schema[c].dataType.simpleString()}" for c in by)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            names = ["dominant", "centroid", "rolloff", "bandwidth", "band_ratio"]
            found = pd.DataFrame(np.nan, index=range(len(rows)), columns=names).assign(cepstrum=None)
            samples = [np.asarray(v, np.float64) for v in rows[x]]
            for n in {len(v) for v in samples} - {0}:
                at = [i for i, v in enumerate(samples) if len(v) == n]
                block = np.stack([samples[i] for i in at])
                found.loc[at, names] = np.column_stack([K.dominant_frequency(block, fs), K.spectral_shape(block, fs), K.power_ratio(block, fs, fs * 0.02, fs * 0.15)])
                for i, c in zip(at, K.cepstrum(block).tolist(), strict=True):
                    found.at[i, "cepstrum"] = c
            yield pd.concat([rows[list(by)].reset_index(drop=True), found], axis=1)

    return windows.select(*by, x).mapInPandas(run, f"{keys}, dominant double, centroid double, rolloff double, bandwidth double, band_ratio double, cepstrum array<double>")


def sound_features(windows: DataFrame, by: Sequence[str], x: str, fs: float) -> DataFrame:
    """The SOUND features of an array column of samples, a column each; null for an empty array."""
    keys = ", ".join(f"`{c}` {windows.schema[c].dataType.simpleString()}" for c in by)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = pd.DataFrame(np.nan, index=range(len(rows)), columns=list(SOUND))
            samples = [np.asarray(v, np.float64) for v in rows[x]]
            for n in {len(v) for v in samples} - {0}:
                at = [i for i, v in enumerate(samples) if len(v) == n]
                found.loc[at, list(SOUND)] = sound_block(np.stack([samples[i] for i in at]), fs)
            yield pd.concat([rows[list(by)].reset_index(drop=True), found], axis=1)

    return windows.select(*by, x).mapInPandas(run, f"{keys}, " + ", ".join(f"`{c}` double" for c in SOUND))

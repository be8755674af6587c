"""Made-up sessions with a truth that is known: flat folders and window data."""

from __future__ import annotations

import json
import os

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.config import Sensors

#: Chances of a swallow after a suck and of silence otherwise; mean time between events (s), share followed by a swallow, and its delay (ms).
P_SWALLOW, P_SILENCE, GAP_S, SHARE_SWALLOW, DELAY_MS = 0.25, 0.15, 1.2, 0.3, 120.0


def _stream(rng: np.random.Generator, channels: tuple[str, ...], hz: float, seconds: float, base: float, sd: float) -> pd.DataFrame:
    n = int(seconds * hz)
    return pd.DataFrame({"t_ms": np.arange(n) * 1000 / hz} | {c: base + sd * rng.standard_normal(n) for c in channels})


def make_events(rng: np.random.Generator, seconds: float) -> pd.DataFrame:
    at, rows = 0.0, []
    while (at := at + float(rng.exponential(GAP_S))) < seconds:
        rows.append((at * 1000, "suck"))
        if rng.random() < SHARE_SWALLOW:
            rows.append((at * 1000 + DELAY_MS, "swallow"))
    return pd.DataFrame(rows, columns=["t_ms", "type"]).sort_values("t_ms")


def write_session(folder: str, seconds: float = 20.0, total_ml: float = 10.0, with_events: bool = True, seed: int = 0, sensors: Sensors | None = None) -> str:
    """A flat session in a local folder, for tests and demonstrations."""
    s, rng = sensors or Sensors(), np.random.default_rng(seed)
    os.makedirs(folder, exist_ok=True)
    put = lambda df, name: df.to_csv(f"{folder}/{name}.csv", index=False)
    put(_stream(rng, s.strain, s.rates["strain"], seconds, 32000, 200), "strain")
    put(_stream(rng, s.imu, s.rates["imu"], seconds, 0, 1000), "imu")
    put(_stream(rng, s.mic, s.rates["mic"], seconds, 0, 500), "mic")
    n = int(seconds * 10)
    put(pd.DataFrame({"t_ms": np.arange(n) * 100.0, s.scale: np.linspace(0, total_ml * 1.03, n)}), "scale")
    if with_events:
        put(make_events(rng, seconds), "events")
    with open(f"{folder}/meta.json", "w", encoding="utf-8") as f:
        json.dump({"session_id": os.path.basename(folder), "sample_rates_hz": s.rates}, f)
    return folder


def generate_sessions(spark: SparkSession, n: int, windows: int = 60, samples: int = 400, hand: int = 130, channels: int = 16, seed: int = 0) -> DataFrame:
    """session_id, window_idx, frames, hand, label, volume of n made-up sessions; each depends on its number and the seed only."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for k in rows["session_id"]:
            rng = np.random.default_rng([seed, int(k)])
            label, t = 0, np.arange(samples) / 200.0
            for i in range(windows):
                u = rng.random()
                label = 2 if label == 1 and u < P_SWALLOW else 0 if label != 1 and u < P_SILENCE else 1
                wave = (0.0, 1.0, 0.6)[label] * np.sin(2 * np.pi * (0.0, 0.7, 1.4)[label] * t + rng.random() * 6)
                frames = (wave[None, :] * rng.uniform(0.5, 1.5, (channels, 1)) + 0.1 * rng.standard_normal((channels, samples))).astype(np.float32)
                vector = (rng.standard_normal(hand) * 0.3 + label).astype(np.float32)
                out.append((int(k), i, frames.tolist(), vector.tolist(), label, float(rng.uniform(0.2, 0.6)) if label == 2 else 0.0))
        return pd.DataFrame(out, columns=["session_id", "window_idx", "frames", "hand", "label", "volume"])

    return spark.range(n).select(F.col("id").alias("session_id")).groupBy("session_id").applyInPandas(run, "session_id long, window_idx int, frames array<array<float>>, hand array<float>, label long, volume double")

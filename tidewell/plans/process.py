"""From sessions' streams to labelled windows; all sessions go through one plan, side by side."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from tidewell.config import Pipeline, Sensors
from tidewell.functions import convert as V
from tidewell.operators import evaluate, features, joins, quality, resample
from tidewell.operators import windows as W
from tidewell.sources.captures import COUNTS, SESSION_ID, Session


@dataclass
class Processed:
    """windows: session_id, window_idx, start_sample, t_start_ms, t_end_ms, frames, hand, label, volume; frames: the grid's rows."""

    windows: DataFrame
    frames: DataFrame
    issues: DataFrame
    pipeline: Pipeline

    @property
    def warnings(self) -> list[str]:
        """Of a few sessions; many are better read from issues."""
        return [r[0] for r in self.issues.where("level = 'warning'").select("message").collect()]

    def release(self) -> None:
        self.frames.unpersist()
        self.issues.unpersist()

    @property
    def correction(self) -> float:
        return self.pipeline.correction


def calibrate(session: Session, sensors: Sensors) -> dict[str, DataFrame]:
    """Streams in physical units; those that are already stay as they are."""
    out = {}
    for name, df in session.streams.items():
        if session.unit_of(name) == COUNTS:
            if name == "strain":
                df = df.withColumns({c: V.bend(F.col(c)) for c in sensors.bend} | {c: V.stretch(F.col(c)) for c in sensors.stretch})
            elif name == "mic":
                df = df.withColumns({c: V.pascals(F.col(c)) for c in sensors.mic})
            else:
                df = df.withColumns({c: (V.acceleration if c.startswith("acc") else V.rotation_rate)(F.col(c)) for c in sensors.imu})
        out[name] = df
    return out


def unified_frames(session: Session, sensors: Sensors, pipeline: Pipeline) -> DataFrame:
    """One row for each point of the grid over the time that all streams share: strain less its drift, sound envelopes, motion."""
    streams = calibrate(session, sensors)
    spans = reduce(lambda a, b: a.join(b, SESSION_ID), [df.groupBy(SESSION_ID).agg(F.min("t_ms").alias(f"_lo_{k}"), F.max("t_ms").alias(f"_hi_{k}")) for k, df in streams.items()])
    span = spans.select(SESSION_ID, F.greatest(*[f"_lo_{k}" for k in streams]).alias("t0_ms"), F.least(*[f"_hi_{k}" for k in streams]).alias("t1_ms"))
    grid = resample.make_grid(span, pipeline.grid_hz)
    points = grid.select(SESSION_ID, "grid_idx", "t_ms")
    strain = resample.resample_linear(streams["strain"], points, [SESSION_ID], sensors.strain, order="seq")
    strain = W.ema_baseline(strain, [SESSION_ID], "grid_idx", sensors.strain, pipeline.alpha, max(1, round(pipeline.seed_s * pipeline.grid_hz)))
    imu = resample.resample_linear(streams["imu"], points, [SESSION_ID], sensors.imu, order="seq").drop("t_ms")
    sound = grid.select(SESSION_ID, "grid_idx")
    for c in sensors.mic:
        got = resample.envelope(streams["mic"], grid.select(SESSION_ID, "grid_idx", "t0_ms"), [SESSION_ID], c, pipeline.grid_hz, out=c)
        sound = sound.join(got.select(SESSION_ID, "grid_idx", c), [SESSION_ID, "grid_idx"])
    return strain.join(sound, [SESSION_ID, "grid_idx"]).join(imu, [SESSION_ID, "grid_idx"]).select(SESSION_ID, "grid_idx", "t_ms", *sensors.frame)


def process_session(session: Session, events: DataFrame | None = None, sensors: Sensors | None = None, pipeline: Pipeline | None = None, native_sound: bool = True, strict: bool = True) -> Processed:
    """Contract, frames, windows that pass quality, features, volume targets and labels, of all sessions at once.

    A broken contract is an error or, unless strict, leaves its session out; issues name the reasons. Grades of times and
    rails don't reject anything here. Labels are null without events, volumes without a scale.
    """
    s, p = sensors or Sensors(), pipeline or Pipeline()
    channels = {"strain": s.strain, "imu": s.imu, "mic": s.mic}
    issues = quality.session_issues(session.streams, channels, session.rates, session.scale).persist(StorageLevel.MEMORY_AND_DISK)
    if strict:
        quality.refuse(issues)
    else:
        broken = issues.where("level = 'error'").select(SESSION_ID).distinct()
        keep = lambda df: df if df is None else df.join(broken, SESSION_ID, "left_anti")
        session = replace(session, streams={k: keep(df) for k, df in session.streams.items()}, scale=keep(session.scale))
    # windows, quality and features all read the frames: kept by Spark (a lost part is made again) until release()
    frames = unified_frames(session, s, p).persist(StorageLevel.MEMORY_AND_DISK)
    members = W.window_members(frames, [SESSION_ID], "grid_idx", p.window_rows, p.hop_rows)
    good = quality.good_windows(members, [SESSION_ID], s.frame, s.inactive, p.max_nan).where("ok").select(SESSION_ID, "window_idx")
    shape = W.make_windows(frames, [SESSION_ID], "t_ms", p.window_rows, p.hop_rows).join(good, [SESSION_ID, "window_idx"])
    width = p.window_s * 1000
    out = shape.join(W.window_frames(frames, [SESSION_ID], "grid_idx", s.frame, p.window_rows, p.hop_rows), [SESSION_ID, "window_idx"])
    sound = calibrate(session, s)["mic"] if native_sound else None
    if sound is not None:
        inside = joins.interval_join(sound.select(SESSION_ID, F.col("t_ms").alias("_t_"), *s.mic), shape.select(SESSION_ID, "window_idx", "t_start_ms", "t_end_ms"), [SESSION_ID], "_t_", "t_start_ms", "t_end_ms", width, closed=True)
        rows = inside.groupBy(SESSION_ID, "window_idx").agg(F.array_sort(F.collect_list(F.struct("_t_", *s.mic))).alias("_s_"))
        rows = rows.select(SESSION_ID, "window_idx", F.array(*[F.transform(F.col("_s_")[c], lambda v: v.cast("double")) for c in s.mic]).alias("mic"))
        out = out.join(rows, [SESSION_ID, "window_idx"], "left")
    else:
        out = out.withColumn("mic", F.lit(None).cast("array<array<double>>"))
    rate = session.measured.where("stream = 'mic'").select(SESSION_ID, F.coalesce("rate_hz", F.lit(session.rates["mic"])).alias("mic_hz"))
    out = features.window_features(out.join(rate, SESSION_ID), p.grid_hz, "mic_hz").drop("mic", "mic_hz")
    if session.scale is not None:
        scale = session.scale.select(SESSION_ID, "t_ms", "scale_g")
        for name, t in (("_a_", "t_start_ms"), ("_b_", "t_end_ms")):
            at = resample.interpolate(shape.select(SESSION_ID, "window_idx", F.col(t).alias("t_ms")), scale, [SESSION_ID], ["scale_g"])
            out = out.join(at.select(SESSION_ID, "window_idx", F.col("scale_g").alias(name)), [SESSION_ID, "window_idx"])
        out = evaluate.volume_targets(out, "_a_", "_b_").drop("_a_", "_b_")
    else:
        out = out.withColumn("volume", F.lit(None).cast("float"))
    if events is not None:
        labels = evaluate.window_labels(shape, events, [SESSION_ID], s.classes, width)
        out = out.join(labels.select(SESSION_ID, "window_idx", "label"), [SESSION_ID, "window_idx"])
    else:
        out = out.withColumn("label", F.lit(None).cast("long"))
    return Processed(out, frames, issues, p)

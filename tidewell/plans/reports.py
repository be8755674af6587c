"""Reports over captures: what each command-line tool prints, as DataFrames."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.config import Pipeline, Sensors
from tidewell.functions import convert as V
from tidewell.functions.ordered import delta, in_order, running_max
from tidewell.operators import clock, detect, evaluate, health, joins, resample, stats
from tidewell.plans.process import process_session
from tidewell.sources import captures as C
from tidewell.sources import sidecars

#: Support of a feed (grams from the start and before the end), half width of the flow's difference (s), fewest events and rows.
SUPPORT_START_G, SUPPORT_END_G, FLOW_HALF_S, LEAST_EVENTS, LEAST_ROWS = 5.0, 2.0, 2.5, 20, 8


def inspect_session(spark: SparkSession, folder: str, stem: str | None = None, sensors: Sensors | None = None, pipeline: Pipeline | None = None) -> dict[str, DataFrame]:
    """channels (mean, sd, least, most of each), volume (reconstructed beside measured) and classes of one session."""
    s, p = sensors or Sensors(), pipeline or Pipeline()
    stems = C.discover_stems(spark, folder)
    stem = stems[0] if stem is None and len(stems) == 1 else stem
    session, events = C.load_session(spark, folder, stem, s), C.load_events(spark, folder, stem)
    done = process_session(session, events, s, p)
    long = done.frames.select(F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).cast("double").alias("x")) for c in s.frame])).alias("c")).select("c.*")
    out = {"channels": long.groupBy("channel").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"), F.min("x").alias("least"), F.max("x").alias("most"))}
    if session.scale is not None:
        out["volume"] = evaluate.volume_check(done.windows, session.scale, ["session_id"], done.correction)
    if events is not None:
        out["classes"] = evaluate.class_balance(done.windows, range(len(s.classes)))
    return out


def derive_events(spark: SparkSession, root: str, config: detect.Detector | None = None, out: str | None = None) -> DataFrame:
    """Summary of the events of every capture's pressure, all in one plan; with out, events and pinned parameters are written there, by capture.

    Captures without a rig board, and those that the detector refuses, are rows with the reason.
    """
    caps = C.open_captures(spark, root)
    got = detect.detections(C.load_pressure(spark, caps), ["session_id"], "t_ms", "psi", config).persist()
    found = caps.sidecars.select("session_id").join(got, "session_id", "left")
    found = found.withColumns({"error": F.when(F.col("n_events").isNull(), "no pressure: the capture has no rig board").otherwise(F.col("error")), "n_events": F.coalesce("n_events", F.lit(0)), "n_weak": F.coalesce("n_weak", F.lit(0))})
    if out:
        C.write_table(got.select(F.col("session_id").alias("stem"), F.inline("events")), f"{out}/events", "csv", ["stem"])
        C.write_table(got.where("params is not null").select(F.col("session_id").alias("stem"), F.col("params").alias("value")), f"{out}/events_detector", "text", ["stem"])
    return found.drop("events").withColumnRenamed("session_id", "stem")


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def validate_dataset(spark: SparkSession, root: str, frozen: bool = False) -> dict[str, DataFrame]:
    caps = sidecars.read_captures(spark, root)
    issues = sidecars.grade(caps, frozen)
    return {"issues": issues, "captures": sidecars.summary(issues, caps), "recurring": evaluate.recurring(issues, caps.count())}


def mic_health(spark: SparkSession, root: str, limit: int | None = None) -> DataFrame:
    """Both microphones of the first `limit` captures, and the shift between them."""
    rows = C.read_csv(spark, f"{root}/*_sensor_audio.csv", ["left", "right"]).withColumn("stem", F.regexp_extract("file_path", "([^/]+)_sensor_audio.csv$", 1)).drop("file_path")
    if limit is not None:
        rows = rows.where(F.col("stem").isin(C.discover_stems(spark, root)[:limit]))
    return health.channel_report(rows, ["stem"], "left", "right").join(health.best_lag(rows, ["stem"], "seq", "left", "right").withColumnRenamed("sd", "lag_sd"), "stem")


def wrap_scan(spark: SparkSession, root: str, limit: int = 6) -> dict[str, DataFrame]:
    """Rollovers of every stream with a counter, the ones closest to the next, and how many are past nine tenths."""
    # files of a kind share their header, so one scan reads all of a kind
    kinds: dict[str, str] = {}
    for name in C.names(spark, root):
        if m := re.search(r"_((?:sensor|rig)_\w+\.csv)$", name):
            kinds.setdefault(m[1], name)
    parts = []
    for kind, name in kinds.items():
        header = spark.read.option("header", True).csv(f"{root}/{name}").columns
        for c in ("device_ts_us", "scan_t_us", "time_us"):
            if c in header:
                parts.append(C.read_csv(spark, f"{root}/*_{kind}", [c]).select("seq", F.col(c).alias("us"), F.regexp_extract("file_path", "([^/]+)$", 1).alias("file")))
    report = clock.wrap_report(_union(parts), ["file"], "seq", "us")
    return {"report": report, "headroom": clock.headroom(report, limit), "close": report.agg(F.count_if(F.col("pct_of_range") > 90).alias("n_close"))}


def acoustic_rates(series: DataFrame, by: Sequence[str], commanded: DataFrame, fs: float, envelope_hz: float = 50.0, band: tuple[float, float] = detect.STRAIN_BAND) -> dict[str, DataFrame]:
    """Rate of each capture's sound (by, seq, x) beside the commanded one, and a summary of the errors. The envelope is made in the engine, before any Python sees it."""
    env, rate = resample.acoustic_envelope(series, by, "seq", "x", fs, envelope_hz)
    got = detect.rate_by_series(env, by, "block_idx", "rms", rate, band).join(commanded, list(by), "left").withColumn("error", F.abs(F.col("rate_cpm") - F.col("cycle_rate_cpm")))
    return {"rates": got, "summary": got.agg(F.median("error").alias("median_error"), F.max("error").alias("worst_error"), F.avg((F.col("error") <= 2).cast("double")).alias("within_2_cpm"))}


def strain_sweep(strain: DataFrame, reference: DataFrame, by: Sequence[str], channels: Sequence[str], tolerance: float, config: detect.Detector | None = None) -> dict[str, DataFrame]:
    """Every channel and polarity scored against reference events (by, t_ms): scores, a summary, the better polarity and the best channel of each run."""
    spans = reference.groupBy(*by).agg(F.min("t_ms").alias("_lo_"), F.max("t_ms").alias("_hi_"), F.count(F.lit(1)).alias("_n_")).where(F.col("_n_") >= LEAST_EVENTS)
    found = detect.sweep(strain, by, "t_ms", channels, config)
    inside = found.join(spans, list(by)).where(F.col("t_ms").between(F.col("_lo_"), F.col("_hi_")))
    keys = [*by, "channel", "sign"]
    grid = spans.select(*by).crossJoin(F.broadcast(strain.sparkSession.createDataFrame([(c, s) for c in channels for s in (1, -1)], "channel string, sign int")))  # a few rows
    true = reference.join(grid, list(by)).select(*keys, "t_ms")
    matched = joins.match_events(inside.select(*keys, "t_ms"), true, keys, tolerance)
    scores = evaluate.match_scores(matched, inside.select(*keys, "t_ms"), true, keys).withColumnsRenamed({"mad": "mad_ms", "bias": "bias_ms", "count_error_pct": "count_err_pct"})
    rates = evaluate.rate_cpm(inside, keys).withColumnRenamed("rate_cpm", "pred_rate_cpm").join(evaluate.rate_cpm(reference, by).withColumnRenamed("rate_cpm", "ref_rate_cpm"), list(by))
    scores = scores.join(rates, keys, "left")
    return {"scores": scores, "summary": evaluate.summarise(scores, ["channel", "sign"]), "polarity": evaluate.best_rows(scores, [*by, "channel"], "f1", "sign"), "polarity_table": polarity_table(scores, by), "best": evaluate.best_rows(scores, by, "f1", "channel"), "worst": evaluate.worst_rows(scores, "f1", 5, keys)}


def consensus_scores(strain: DataFrame, reference: DataFrame, by: Sequence[str], channels: Sequence[str], tolerance: float, leave_out: bool = True, polarity: Mapping[str, int] = detect.POLARITY, config: detect.Detector | None = None) -> DataFrame:
    """match_scores of the consensus of all channels ('none' left out) and, with leave_out, without each in turn."""
    keys = ", ".join(f"`{c}` {strain.schema[c].dataType.simpleString()}" for c in by)
    outs = ["none", *(channels if leave_out else [])]
    dropped = strain.select(*by, "t_ms", *channels).withColumn("left_out", F.explode(F.array(*map(F.lit, outs))))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("t_ms", kind="stable")
        use = [c for c in channels if c != rows["left_out"].iloc[0]]
        try:
            t = detect.consensus_events(rows["t_ms"].to_numpy(), rows[use].to_numpy(np.float64), use, polarity, config).t_ms
        except ValueError:
            t = np.empty(0)
        return pd.DataFrame({c: rows[c].iloc[0] for c in (*by, "left_out")} | {"t_ms": t}, index=range(len(t)))

    found = dropped.groupBy(*by, "left_out").applyInPandas(run, f"{keys}, left_out string, t_ms double")
    true = reference.select(*by, "t_ms").withColumn("left_out", F.explode(F.array(*map(F.lit, outs))))
    both = [*by, "left_out"]
    return evaluate.match_scores(joins.match_events(found, true, both, tolerance), found, true, both)


def monotonic_mass(scale: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, t_s, mass): the largest reading so far."""
    return scale.where(F.col("grams").isNotNull() & ~F.isnan(F.col("grams").cast("double"))).withColumn("mass", running_max(F.col("grams"), in_order(by, "t_s"))).select(*by, "t_s", "mass")


def support(scale: DataFrame, by: Sequence[str], start_g: float = SUPPORT_START_G, end_g: float = SUPPORT_END_G) -> DataFrame:
    """(by, _lo_, _hi_): when the mass first reaches start_g, and when it is end_g short of its total; the last time where it never does."""
    mass = monotonic_mass(scale, by)
    total = mass.groupBy(*by).agg(F.max("mass").alias("_total_"), F.max("t_s").alias("_last_"))
    first = lambda least: F.coalesce(F.min(F.when(F.col("mass") >= least, F.col("t_s"))), F.max("_last_"))
    return mass.join(total, list(by)).groupBy(*by).agg(first(F.lit(start_g)).alias("_lo_"), first(F.col("_total_") - end_g).alias("_hi_"))


def polarity_table(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """(channel, n_up, n_down): in how many runs each sign of a channel scores better, ties to the negative one."""
    best = evaluate.best_rows(scores, [*by, "channel"], "f1", "sign")
    return best.groupBy("channel").agg(F.count_if(F.col("sign") == 1).alias("n_up"), F.count_if(F.col("sign") == -1).alias("n_down"))


def paired_counts(pairs: DataFrame, diff: str = "diff") -> DataFrame:
    """n, better, worse and median_diff of paired differences."""
    d = F.col(diff)
    return pairs.agg(F.count(F.lit(1)).alias("n"), F.count_if(d < 0).alias("better"), F.count_if(d > 0).alias("worse"), F.median(d).alias("median_diff"))


def event_features(strain: DataFrame, scale: DataFrame, events: DataFrame, by: Sequence[str], channels: Sequence[str]) -> DataFrame:
    """(by, t_s, la_<channel>..., log_gap, gap_s, flow): of each event inside its feed's support, log amplitudes (99th less 1st percentile) within half a period, and flow in grams a minute.

    Times are seconds. Events with fewer than 8 strain rows, an amplitude that isn't positive, or a negative flow are left
    out; so are runs that keep fewer than 20.
    """
    w = in_order(by, "t_s")
    mass = monotonic_mass(scale, by)
    marks = support(scale, by).where("_hi_ > _lo_")
    inside = events.select(*by, "t_s").join(marks, list(by)).where(F.col("t_s").between(F.col("_lo_"), F.col("_hi_"))).select(*by, "t_s")
    gap = inside.withColumn("_d_", delta(F.col("t_s"), w))
    period = gap.groupBy(*by).agg(F.median("_d_").alias("_period_"), F.count(F.lit(1)).alias("_n_")).where(F.col("_n_") >= LEAST_EVENTS)
    rows = gap.join(period, list(by)).withColumn("gap_s", F.coalesce("_d_", "_period_"))
    spans = rows.select(*by, F.col("t_s").alias("event_s"), "gap_s", (F.col("t_s") - F.col("_period_") / 2).alias("_a_"), (F.col("t_s") + F.col("_period_") / 2).alias("_b_"))
    clean = strain.select(*by, "t_s", *[F.when((F.col(c) != 0) & ~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in channels])
    near = joins.interval_join(clean, spans, by, "t_s", "_a_", "_b_", 2.0)
    amp = lambda c: F.percentile(c, F.lit(0.99)) - F.percentile(c, F.lit(0.01))
    seg = near.groupBy(*by, "event_s", "gap_s").agg(F.count(F.lit(1)).alias("_k_"), *[amp(c).alias(f"_amp_{c}") for c in channels]).where(F.col("_k_") >= LEAST_ROWS)
    for c in channels:
        seg = seg.where(F.col(f"_amp_{c}") > 0)
    flow = rows.select(*by, F.col("t_s").alias("event_s"))
    for name, shift in (("_m0_", -FLOW_HALF_S), ("_m1_", FLOW_HALF_S)):
        asked = flow.select(*by, "event_s", (F.col("event_s") + shift).alias("t_s"))
        flow = flow.join(resample.interpolate(asked, mass, by, ["mass"], "t_s").select(*by, "event_s", F.col("mass").alias(name)), [*by, "event_s"])
    out = seg.join(flow, [*by, "event_s"]).withColumn("flow", (F.col("_m1_") - F.col("_m0_")) / (2 * FLOW_HALF_S / 60)).where("flow >= 0")
    out = out.select(*by, F.col("event_s").alias("t_s"), *[F.ln(f"_amp_{c}").alias(f"la_{c}") for c in channels], F.ln(F.greatest("gap_s", F.lit(1e-3))).alias("log_gap"), "gap_s", "flow")
    kept = out.groupBy(*by).count().where(F.col("count") >= LEAST_EVENTS).select(*by)
    return out.join(kept, list(by), "left_semi")


def fold_report(rows: DataFrame, fold: str, run: str, columns: Sequence[str], alpha: float = 1.0) -> dict[str, DataFrame]:
    """Leave one value of `fold` out in turn: ridge on log flow with smearing, the best single channel, and the training mean, event by event and by run total.

    Folds are few (runs or levels). Their moments add up, so one aggregate fits all models; smearing is one pass of all
    models over all rows, and predictions are another.
    """
    spark = rows.sparkSession
    rows = rows.withColumn("log_flow", V.to_log_flow(F.col("flow"))).withColumn("_fold_", F.col(fold).cast("string"))
    parts = stats.moments(rows, ["_fold_"], columns, "log_flow")
    flows = {r[0]: (r[1], r[2]) for r in rows.groupBy("_fold_").agg(F.sum("flow"), F.count("flow")).collect()}
    models, means = {}, []
    for (k,) in parts:
        others = [p for p in parts if p != (k,)]
        if not others:
            continue
        train = [parts[p] for p in others]
        names = [p[0] for p in others]
        models[(k, "ridge")] = stats.solve_ridge(train, columns, alpha), names
        models[(k, "single")] = stats.solve_ridge(train, columns, alpha, [stats.strongest(train)]), names
        means.append((k, sum(flows[n][0] for n in names) / sum(flows[n][1] for n in names)))
    table = F.broadcast(stats.model_table(spark, models, columns, "fold string, model string"))  # two rows a fold
    both = rows.crossJoin(table)
    factor = both.where(F.array_contains("train", F.col("_fold_"))).groupBy("fold", "model").agg(V.smearing(F.col("log_flow") - stats.linear(columns)).alias("factor"))
    tested = both.where(F.col("_fold_") == F.col("fold")).join(F.broadcast(factor), ["fold", "model"])
    fitted = tested.select(F.col(run).alias(run), "fold", "gap_s", "flow", "model", V.from_log_flow(stats.linear(columns), F.col("factor")).alias("predicted"))
    plain = rows.join(F.broadcast(spark.createDataFrame(means, "_fold_ string, predicted double")), "_fold_").select(F.col(run).alias(run), F.col("_fold_").alias("fold"), "gap_s", "flow", F.lit("mean").alias("model"), "predicted")
    long = fitted.unionByName(plain)
    totals = long.groupBy("model", run).agg(F.sum(F.col("predicted") * F.col("gap_s") / 60).alias("predicted_g"), F.sum(F.col("flow") * F.col("gap_s") / 60).alias("true_g")).withColumn("error_pct", F.try_divide(100 * (F.col("predicted_g") - F.col("true_g")), F.col("true_g")))
    return {"events": evaluate.regression_scores(long, F.col("predicted"), F.col("flow"), ["model"]), "totals": totals, "errors": evaluate.error_table(totals, ["model"], "error_pct")}


def learning_curve(rows: DataFrame, run: str, level: str, columns: Sequence[str], sizes: Sequence[int] = (6, 10, 14, 18, 22, 26, 30), repeats: int = 40, alpha: float = 1.0, seed: int = 0) -> dict[str, DataFrame]:
    """Median absolute total error (%) of models from n training runs, drawn level by level with at least one left out, and its power law.

    Draws are made on the driver from the list of runs (tens). All models come from one aggregate of the runs' moments, and
    are tested in one plan.
    """
    spark = rows.sparkSession
    rows = rows.withColumn("log_flow", V.to_log_flow(F.col("flow"))).withColumn("_run_", F.col(run).cast("string"))
    runs = rows.groupBy("_run_", level).agg(F.count(F.lit(1))).toPandas().sort_values([level, "_run_"])
    parts = stats.moments(rows, ["_run_"], columns, "log_flow")
    rng = np.random.default_rng(seed)
    models = {}
    for n in [s for s in sizes if s < len(runs)]:
        for k in range(repeats):
            order = runs.assign(_u_=rng.random(len(runs))).sort_values([level, "_u_"])
            order["_r_"] = order.groupby(level).cumcount()
            chosen = order.sort_values(["_r_", "_u_"])["_run_"].head(n).tolist()
            models[(n, k)] = stats.solve_ridge([parts[(c,)] for c in chosen], columns, alpha), chosen
    table = F.broadcast(stats.model_table(spark, models, columns, "n int, draw int"))  # as many rows as draws
    both = rows.crossJoin(table).withColumn("_x_", stats.linear(columns)).withColumn("_in_", F.array_contains("train", F.col("_run_")))
    factor = both.where("_in_").groupBy("n", "draw").agg(V.smearing(F.col("log_flow") - F.col("_x_")).alias("factor"))
    tested = both.where("not _in_").join(F.broadcast(factor), ["n", "draw"])
    total = tested.groupBy("n", "draw", "_run_").agg(F.sum(V.from_log_flow(F.col("_x_"), F.col("factor")) * F.col("gap_s")).alias("p"), F.sum(F.col("flow") * F.col("gap_s")).alias("q"))
    draws = total.groupBy("n", "draw").agg(F.median(F.abs(F.try_divide(100 * (F.col("p") - F.col("q")), F.col("q")))).alias("error_pct"))
    curve = draws.groupBy("n").agg(F.median("error_pct").alias("error_pct"))
    return {"draws": draws, "curve": curve, "power_law": stats.power_law(curve, "n", "error_pct"), "variance": stats.variance_split(curve.withColumn("squared", F.col("error_pct") ** 2), "n", "squared")}


def compare_sources(a: DataFrame, b: DataFrame, on: Sequence[str] = ("stem", "level"), value: str = "signed_err_pct", draws: int = 20000) -> dict[str, object]:
    """Paired comparison of two dumps' absolute errors: pairs, medians by level, counts of better and worse, interval of the median difference, signed-rank test."""
    pairs = stats.paired(a.withColumn("abs_err", F.abs(value)), b.withColumn("abs_err", F.abs(value)), on, "abs_err")
    return {"pairs": pairs, "levels": pairs.groupBy(on[-1]).agg(F.median("abs_err_a").alias("a"), F.median("abs_err_b").alias("b")), "counts": paired_counts(pairs), "interval": stats.bootstrap_median(pairs, "diff", draws), "wilcoxon": stats.wilcoxon(pairs)}


def reference_events(captures: C.Captures, folder: str) -> DataFrame:
    """(session_id, t_ms) of the reference events <stem>.csv in a folder (host milliseconds, quality ok), on session time."""
    rows = C.read_csv(captures.spark, f"{folder}/*.csv", ["t_ms", "quality"], ["depth_psi"], ("quality",)).withColumn(C.SESSION_ID, F.regexp_extract("file_path", r"([^/]+?)(?:_events)?\.csv$", 1))
    t0 = captures.fits.select(C.SESSION_ID, "t0_host_s").distinct()
    return evaluate.quality_ok(rows).join(t0, C.SESSION_ID).select(C.SESSION_ID, (F.col("t_ms") - F.col("t0_host_s") * 1000).alias("t_ms"))


def strain_report(spark: SparkSession, root: str, reference: str, sensors: Sensors | None = None, config: detect.Detector | None = None, channels: Sequence[str] = tuple(detect.POLARITY)) -> dict[str, DataFrame]:
    """strain_sweep and consensus_scores of all captures at root against reference events, with a quarter period as tolerance."""
    s = sensors or Sensors()
    caps = C.open_captures(spark, root)
    strain = C.load_captures(caps, s).streams["strain"].withColumnsRenamed(dict(zip(s.strain, channels, strict=True)))
    true = reference_events(caps, reference)
    tolerance = evaluate.match_tolerance(true, [C.SESSION_ID]).agg(F.median("tolerance")).first()[0]
    got = strain_sweep(strain, true, [C.SESSION_ID], channels, float(tolerance or 50.0), config)
    return got | {"consensus": consensus_scores(strain, true, [C.SESSION_ID], channels, float(tolerance or 50.0), config=config)}


def acoustic_report(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """acoustic_rates of the first microphone of all captures, beside the rate of the strain ring's consensus."""
    caps = C.open_captures(spark, root)
    sound = caps.read("sensor_audio.csv", ["time_us", "left"])
    fs = clock.device_rate(sound, [C.SESSION_ID], "seq", "time_us").agg(F.median("fs_hz")).first()[0]
    commanded = caps.sidecars.select(C.SESSION_ID, F.try_variant_get("sensor", "$.run.cycle_rate_cpm", "double").alias("cycle_rate_cpm"))
    return acoustic_rates(sound.select(C.SESSION_ID, "seq", F.col("left").alias("x")), [C.SESSION_ID], commanded, float(fs))


def volume_report(spark: SparkSession, root: str, reference: str, sensors: Sensors | None = None) -> dict[str, DataFrame]:
    """event_features of all captures at root, left out by run and by level, and the learning curve."""
    s = sensors or Sensors()
    caps = C.open_captures(spark, root)
    session = C.load_captures(caps, s)
    if session.scale is None:
        raise FileNotFoundError(f"{root}: no scale, so no true volume")
    second = lambda df: df.withColumn("t_s", F.col("t_ms") / 1000)
    level = caps.sidecars.select(C.SESSION_ID, F.coalesce(F.try_variant_get("sensor", "$.run.vacuum_level", "int"), F.lit(0)).alias("level"))
    rows = event_features(second(session.streams["strain"]), second(session.scale).withColumn("grams", F.col("scale_g")), second(reference_events(caps, reference)), [C.SESSION_ID], s.strain).join(level, C.SESSION_ID)
    rows = rows.persist()
    columns = [*[f"la_{c}" for c in s.strain], "log_gap"]
    by_run, by_level = fold_report(rows, C.SESSION_ID, C.SESSION_ID, columns), fold_report(rows, "level", C.SESSION_ID, columns)
    curve = learning_curve(rows, C.SESSION_ID, "level", columns)
    return {f"run_{k}": v for k, v in by_run.items()} | {f"level_{k}": v for k, v in by_level.items()} | {f"curve_{k}": v for k, v in curve.items()}

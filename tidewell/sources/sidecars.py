"""Grades the sidecars of captures: every rule is a condition on three JSON documents, all captures in one job.

A rule is a row of a table: level, field, condition and message as expressions over one capture (or one of its boards, streams
or files). JSON null and an absent key differ, so documents stay VARIANT.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ERROR, WARNING = "error", "warning"
#: The newest schema understood, limits of the clock fit (ms), of stream coverage, and the label anchor in use.
SCHEMA_VERSION = 2
RESIDUAL_ERROR_MS, RESIDUAL_WARN_MS, JITTER_WARN_MS, JITTER_RATIO = 80.0, 10.0, 5.0, 3.0
COVERAGE_TOLERANCE = 0.05
CONVENTION = "trough_subsample"
PENDING = ("schema", "fill", "run.outlet")
Rule = tuple[Column | str, Column | str, Column, Column | str]


def at(doc: str, path: str, kind: str = "string") -> Column:
    """A value at a dotted path, null where absent, JSON null, or of another kind."""
    return F.try_variant_get(F.col(doc), f"$.{path}", kind)


def has(doc: str, path: str) -> Column:
    """Whether the key exists, even with a JSON null."""
    return F.try_variant_get(F.col(doc), f"$.{path}", "variant").isNotNull()


def is_null(doc: str, path: str) -> Column:
    return F.coalesce(F.is_variant_null(F.try_variant_get(F.col(doc), f"$.{path}", "variant")), F.lit(False))


def filled(doc: str, path: str) -> Column:
    """A non-empty object."""
    text = F.to_json(F.try_variant_get(F.col(doc), f"$.{path}", "variant"))
    return F.coalesce(text.startswith("{") & (text != "{}"), F.lit(False))


def truthy(doc: str, path: str) -> Column:
    text = F.to_json(F.try_variant_get(F.col(doc), f"$.{path}", "variant"))
    return F.coalesce(~text.isin("null", "false", "0", "0.0", '""', "{}", "[]"), F.lit(False))


def say(pattern: str, *args: Column) -> Column:
    return F.format_string(pattern, *args) if args else F.lit(pattern)


def _issues(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rows (stem, level, field, message) of the rules that hold; one pass over the captures whatever the number of rules."""
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    found = F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.struct(text(level).alias("level"), text(name).alias("field"), text(message).alias("message"))) for level, name, cond, message in rules])
    return rows.select("stem", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("i")).select("stem", "i.*")


def _board_rules() -> list[Rule]:
    field = lambda end: F.concat(F.lit("alignment."), F.col("board"), F.lit(end))
    info = lambda key, kind="double": F.try_variant_get(F.col("info"), f"$.{key}", kind)
    present = F.coalesce(F.to_json("info").startswith("{") & (F.to_json("info") != "{}"), F.lit(False))
    jitter, residual = info("jitter_ms"), F.col("clock.residual_ms")
    skew = F.when(F.try_variant_get(F.col("info"), "$.skew_applied", "variant").isNotNull(), info("skew_applied")).otherwise(info("skew_ppm"))
    sure = F.coalesce(info("skew_confidence", "string"), F.lit("absent"))
    return [
        (ERROR, field(""), ~present, "no alignment block for this board"),
        (ERROR, field(".skew_ppm"), present & skew.isNull(), "no skew estimate"),
        (WARNING, field(".skew_confidence"), present & (sure != "resolved"), say("%s; the pooled skew stands in for it", sure)),
        (WARNING, field(".jitter_ms"), present & (jitter > JITTER_WARN_MS), say("%.1f ms is much for windows across boards", jitter)),
        (F.when(residual > RESIDUAL_ERROR_MS, ERROR).otherwise(WARNING), field(".residual_ms"), present & (residual > RESIDUAL_WARN_MS), say("sync points miss the fitted clock by %.1f ms", residual)),
        (WARNING, field(".jitter_ms"), present & (jitter > 0) & (residual / F.when(jitter > 0, jitter) > JITTER_RATIO), say("stated jitter of %.2f ms, but the fit leaves %.2f ms", jitter, residual)),
        (WARNING, field(".device_ts_us"), present & (F.col("clock.wraps") > 0), say("the counter rolled over %d times", F.col("clock.wraps"))),
        (WARNING, field(".n_sync_points"), present & (F.col("clock.n_sync_points") < 4), say("%d sync points hardly fix a skew", F.col("clock.n_sync_points"))),
    ]


def _capture_rules() -> list[Rule]:
    rig = F.col("has_rig")
    v2 = F.col("version") >= 2
    required = F.when(v2, ERROR).otherwise(WARNING)
    declared = F.when(has("session", "schema"), at("session", "schema", "int")).otherwise(at("sensor", "schema_version", "int"))
    fill = F.when(has("session", "fill"), at("session", "fill")).otherwise(at("sensor", "run.fill_state"))
    turn_a, turn_b = at("sensor", "run.orientation"), at("rig", "run.orientation")
    events = filled("session", "events")
    n, flagged = at("session", "events.measured.n_events", "double"), F.coalesce(at("session", "events.measured.n_flagged_low_amplitude", "double"), F.lit(0.0))
    counted = events & n.isNotNull() & (n > 0)
    flagged_pct = F.try_divide(100 * flagged, n)
    depth, floor = at("session", "events.measured.depth_psi_median", "double"), at("session", "events.measured.depth_floor_psi", "double")
    empty = at("session", "events.measured.n_empty", "double")
    anchor = at("session", "events.timestamp_convention")
    scale = filled("sensor", "scale")
    wrong, lines = at("sensor", "scale.parse_errors", "double"), F.coalesce(at("sensor", "scale.lines", "double"), F.lit(0.0))
    wrong_pct = F.try_divide(100 * wrong, lines)
    weights = at("sensor", "run.weight_before_g", "double").isNotNull() & at("sensor", "run.weight_after_g", "double").isNotNull()
    pressure = filled("rig", "conversion.rig.pressure")
    return [
        (WARNING, "schema", declared.isNull(), "absent; taken for version 1"),
        (ERROR, "schema", declared > SCHEMA_VERSION, say(f"version %d is newer than {SCHEMA_VERSION}", declared)),
        (ERROR, "alignment", ~filled("session", "alignment"), "absent; times of the boards can't be compared"),
        (ERROR, "run.vacuum_level", rig & at("sensor", "run.vacuum_level").isNull(), "absent; the condition is unknown"),
        (WARNING, "run.cycle_rate_cpm", rig & at("sensor", "run.cycle_rate_cpm").isNull(), "absent; the detected rate stands in for it"),
        (WARNING, "fill", rig & fill.isNull(), "absent; vacuum and fill can't be told apart"),
        (WARNING, "run.outlet", rig & ~has("sensor", "run.outlet"), "absent; the outlet decides on flow too"),
        (WARNING, "run.orientation", (F.length(turn_a) > 0) & (F.length(turn_b) > 0) & (turn_a != turn_b), say("%s on the sensor board, %s on the rig", turn_a, turn_b)),
        *[(WARNING, f"run.{k}", is_null("sensor", f"run.{k}"), "null; fill it or leave it out") for k in ("weight_before_g", "weight_after_g")],
        (WARNING, "device.strain_ch_mask", (truthy("sensor", "device.active.bend") | truthy("sensor", "device.active.stretch")) & ~truthy("sensor", "device.strain_ch_mask"), "empty though strain is active"),
        (WARNING, "device.active.mic_r", truthy("sensor", "device.active.mic_l") & truthy("sensor", "device.active.mic_r"), "the second microphone is known to be faulty"),
        (ERROR, "conversion.strain", at("sensor", "conversion.strain", "variant").isNull() | is_null("sensor", "conversion.strain"), "absent; strain can't be calibrated"),
        (ERROR, "conversion.rig.pressure", rig & ~pressure, "absent; no labels can be derived"),
        *[(ERROR, f"conversion.rig.pressure.{k}", rig & pressure & at("rig", f"conversion.rig.pressure.{k}", "double").isNull(), "missing") for k in ("out_min_counts", "out_max_counts", "p_min_psi", "p_max_psi")],
        (WARNING, "stream_coverage", ~filled("session", "stream_coverage"), "absent; lost samples would go unseen"),
        (WARNING, "interrupted", filled("session", "stream_coverage") & truthy("session", "interrupted"), "true"),
        (required, "events", ~events, "absent; no derived labels"),
        *[(required, f"events.{k}", events & ~truthy("session", f"events.{k}"), "missing") for k in ("detector", "detector_version")],
        (required, "events.timestamp_convention", events & anchor.isNull(), "missing; the anchor of labels is unknown"),
        (ERROR, "events.timestamp_convention", events & (anchor != CONVENTION), say(f"%s instead of {CONVENTION}", anchor)),
        (required, "events.measured.n_events", events & n.isNull(), "missing"),
        (required, "events.measured.n_events", events & (n == 0), "zero"),
        (F.when(flagged_pct > 20, ERROR).otherwise(WARNING), "events.measured.n_flagged_low_amplitude", counted & (flagged > 0), say("%.1f%% of events are below the floor", flagged_pct)),
        (WARNING, "events.measured.depth_psi_median", counted & (floor > 0) & (F.try_divide(depth, floor) < 3), say("%.3f psi is close to the floor of %.3f psi", depth, floor)),
        (WARNING, "events.measured.n_empty", counted & (empty > 0), say("%.0f events after the source ran dry", empty)),
        (WARNING, "scale", ~scale & rig, "absent; no true volume"),
        (ERROR, "scale.error", scale & truthy("sensor", "scale.error"), at("sensor", "scale.error")),
        (F.when(wrong_pct > 1, ERROR).otherwise(WARNING), "scale.parse_errors", scale & (wrong > 0), say("%.0f of %.0f lines unread", wrong, lines)),
        (WARNING, "scale.ground_truth", scale & ~truthy("sensor", "scale.ground_truth"), "not marked as ground truth"),
        (WARNING, "run.weight_before_g", ~rig & ~weights & ~F.array_contains("files", F.concat("stem", F.lit("_sensor_scale.csv"))), "neither weights nor a scale: no true volume"),
        (WARNING, "run.subject", ~rig & at("sensor", "run.subject").isNull(), "absent; subjects can't be told apart"),
    ]


def grade(captures: DataFrame, frozen: bool = False) -> DataFrame:
    """(stem, level, field, message) of every issue of captures(stem, session, sensor, rig, has_rig, files, clocks).

    The documents are VARIANT, files the names on disk, clocks a map from board to struct(residual_ms, wraps, n_sync_points).
    frozen turns warnings about promised fields into errors.
    """
    declared = F.when(has("session", "schema"), at("session", "schema", "int")).otherwise(at("sensor", "schema_version", "int"))
    rows = captures.withColumn("version", F.coalesce(declared, F.lit(1)))
    boards = rows.where(filled("session", "alignment")).withColumn("board", F.explode(F.when(F.col("has_rig"), F.array(F.lit("sensor"), F.lit("rig"))).otherwise(F.array(F.lit("sensor")))))
    info = F.when(F.col("board") == "rig", at("session", "alignment.rig", "variant")).otherwise(at("session", "alignment.sensor", "variant"))
    boards = boards.withColumn("info", info).withColumn("clock", F.element_at("clocks", F.col("board")))
    streams = rows.where(filled("session", "stream_coverage")).select("stem", F.explode(F.from_json(F.to_json(at("session", "stream_coverage", "variant")), "map<string,struct<span_s:double,missing_s:double,coverage:double>>")).alias("stream", "s"))
    name = lambda end: F.concat(F.lit("stream_coverage."), F.col("stream"), F.lit(end))
    missing, span = F.col("s.missing_s"), F.coalesce(F.col("s.span_s"), F.lit(0.0))
    share = F.try_divide(100 * missing, span)
    stream_rules: list[Rule] = [
        (F.when(share > 5, ERROR).otherwise(WARNING), name(".missing_s"), missing > 0, say("%.1f of %.1f s missing", missing, span)),
        (WARNING, name(".coverage"), F.abs(F.col("s.coverage") - 1) > COVERAGE_TOLERANCE, say("%.3f is not the length that the rate implies", F.col("s.coverage"))),
    ]
    listed = lambda doc: F.coalesce(F.from_json(F.to_json(at(doc, "files", "variant")), "map<string,string>"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    both = F.concat(F.map_entries(listed("sensor")), F.when(F.col("has_rig"), F.map_entries(listed("rig"))).otherwise(F.array().cast("array<struct<key:string,value:string>>")))
    files = rows.select("stem", "files", F.explode(both).alias("f")).where("f.key <> 'bin'")
    file_rules: list[Rule] = [(ERROR, F.concat(F.lit("files."), F.col("f.key")), ~F.array_contains("files", F.col("f.value")), say("%s isn't there", F.col("f.value")))]
    out = _issues(rows, _capture_rules()).unionByName(_issues(boards, _board_rules())).unionByName(_issues(streams, stream_rules)).unionByName(_issues(files, file_rules))
    if frozen:
        promised = (F.col("level") == WARNING) & F.col("field").isin(*PENDING)
        out = out.withColumn("message", F.when(promised, F.concat("message", F.lit(" (required from now on)"))).otherwise(F.col("message"))).withColumn("level", F.when(promised, ERROR).otherwise(F.col("level")))
    return out


def summary(issues: DataFrame, captures: DataFrame) -> DataFrame:
    """n_errors, n_warnings, ok of every capture, those without issues included."""
    n = lambda level: F.sum(F.when(F.col("level") == level, 1).otherwise(0)).cast("long")
    counted = issues.groupBy("stem").agg(n(ERROR).alias("n_errors"), n(WARNING).alias("n_warnings"))
    rows = captures.select("stem").join(counted, "stem", "left")
    zero = F.lit(0).cast("long")
    return rows.select("stem", F.coalesce("n_errors", zero).alias("n_errors"), F.coalesce("n_warnings", zero).alias("n_warnings")).withColumn("ok", F.col("n_errors") == 0)


def read_captures(spark: SparkSession, root: str) -> DataFrame:
    """The captures at root in the form that grade takes: sidecars, file names, fitted clocks; one scan a file kind."""
    from tidewell.sources import captures as C

    got = C.open_captures(spark, root)
    clock = F.struct("residual_ms", F.col("wraps").cast("int").alias("wraps"), F.col("n_sync_points").cast("int").alias("n_sync_points"))
    clocks = got.fits.groupBy(C.SESSION_ID).agg(F.map_from_entries(F.collect_list(F.struct("board", clock))).alias("clocks"))
    here = spark.createDataFrame([(n,) for n in C.names(spark, root)], "file string")  # the folder's listing
    owned = got.sidecars.select(C.SESSION_ID)
    # of the listing only what a rule may ask for goes with a capture: declared files, and its scale
    listed = got.sidecars.select(C.SESSION_ID, F.explode(F.concat(*[F.coalesce(F.map_values(F.from_json(F.to_json(at(d, "files", "variant")), "map<string,string>")), F.array().cast("array<string>")) for d in ("sensor", "rig")])).alias("file"))
    asked = listed.union(owned.select(C.SESSION_ID, F.concat(C.SESSION_ID, F.lit("_sensor_scale.csv")))).distinct()
    files = asked.join(here, "file").groupBy(C.SESSION_ID).agg(F.collect_list("file").alias("files"))
    rows = got.sidecars.join(clocks, C.SESSION_ID).join(files, C.SESSION_ID, "left")
    return rows.select(F.col(C.SESSION_ID).alias("stem"), "session", "sensor", "rig", F.map_contains_key("clocks", "rig").alias("has_rig"), F.coalesce("files", F.array().cast("array<string>")).alias("files"), "clocks")


def validate_dataset(spark: SparkSession, root: str, frozen: bool = False) -> DataFrame:
    return grade(read_captures(spark, root), frozen)

"""Labels, scores and roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.functions.convert import GRAMS_PER_ML, argmax, skill, softmax
from tidewell.functions.ordered import average_rank, correlation, delta, in_order
from tidewell.operators.joins import interval_join

IGNORE = -100


def confident(events: DataFrame, least: float = 0.0) -> DataFrame:
    """Events of at least that confidence; all of them where nothing is asked or nothing is known."""
    return events.where(F.col("confidence") >= least) if least > 0 and "confidence" in events.columns else events


def quality_ok(events: DataFrame, column: str = "quality") -> DataFrame:
    return events.where(F.trim(F.col(column).cast("string")) == "ok")


def unknown_types(events: DataFrame, classes: Sequence[str], column: str = "type") -> DataFrame:
    return events.select(column).distinct().where(~F.col(column).isin(*classes) | F.col(column).isNull())


def window_labels(windows: DataFrame, events: DataFrame, by: Sequence[str], classes: Sequence[str], width: float, t: str = "t_ms", column: str = "type", least: float = 0.0) -> DataFrame:
    """windows with `label`: the most frequent class among events in [t_start, t_end), ties to the lower class, 0 without any.

    Class 0 (nothing) never wins over another. An event of an unknown class is an error.
    """
    bad = [r[0] for r in unknown_types(events, classes, column).collect()]
    if bad:
        raise ValueError(f"unknown event types {sorted(map(str, bad))}; known are {list(classes)}")
    number = F.array_position(F.array(*map(F.lit, classes)), F.col(column)) - 1
    rows = confident(events, least).select(*by, t, *[c for c in ("confidence",) if c in events.columns], number.cast("long").alias("_class_")).where("_class_ > 0")
    counts = interval_join(rows.select(*by, t, "_class_"), windows, by, t, "t_start_ms", "t_end_ms", width).groupBy(*by, "window_idx", "_class_").agg(F.count(F.lit(1)).alias("_n_"))
    best = counts.groupBy(*by, "window_idx").agg(F.max_by("_class_", F.struct(F.col("_n_"), -F.col("_class_"))).alias("label"))
    return windows.join(best, [*by, "window_idx"], "left").withColumn("label", F.coalesce("label", F.lit(0).cast("long")))


def window_counts(windows: DataFrame, events: DataFrame, by: Sequence[str], width: float, t: str = "t_ms") -> DataFrame:
    """windows with n_events, those in [t_start, t_end], both ends in."""
    counts = interval_join(events.select(*by, t), windows, by, t, "t_start_ms", "t_end_ms", width, closed=True).groupBy(*by, "window_idx").agg(F.count(F.lit(1)).alias("n_events"))
    return windows.join(counts, [*by, "window_idx"], "left").withColumn("n_events", F.coalesce("n_events", F.lit(0).cast("long")))


def granularity(counted: DataFrame, events: DataFrame, by: Sequence[str], window_s: float, t: str = "t_ms") -> DataFrame:
    """How window_counts spread: windows, mean and most events a window, occupancy, median period, and whether a window holds one event at most."""
    a = counted.groupBy(*by).agg(F.count(F.lit(1)).alias("n_windows"), F.avg("n_events").alias("events_per_window_mean"), F.max("n_events").alias("events_per_window_max"), F.avg((F.col("n_events") > 0).cast("double")).alias("occupancy"))
    b = events.withColumn("_d_", delta(F.col(t), in_order(by, t))).groupBy(*by).agg(F.count(F.lit(1)).alias("n_events"), F.median("_d_").alias("median_period_ms"))
    both = a.join(b, list(by), "left")
    return both.withColumn("n_events", F.coalesce("n_events", F.lit(0))).withColumn("window_s", F.lit(float(window_s))).withColumn("resolves_single_events", F.coalesce(F.lit(window_s * 1000) <= F.col("median_period_ms"), F.lit(False)))


def class_balance(labels: DataFrame, classes: Sequence[int], column: str = "label", ignore: int = IGNORE) -> DataFrame:
    """n and share of every class among labelled rows, zero where absent."""
    spark = labels.sparkSession
    counts = labels.where(F.col(column).isNotNull() & (F.col(column) != ignore)).groupBy(F.col(column).cast("long").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    dim = spark.createDataFrame([(int(c),) for c in classes], "class long")
    rows = dim.join(counts, "class", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return rows.withColumn("share", F.try_divide("n", F.sum("n").over(Window.partitionBy(F.lit(0)))))


def majority_rate(labels: DataFrame, by: Sequence[str] = (), column: str = "label", ignore: int = IGNORE) -> DataFrame:
    """Share of the commonest class among labelled rows; no row (or null) without any."""
    n = labels.where(F.col(column).isNotNull() & (F.col(column) != ignore)).groupBy(*by, column).agg(F.count(F.lit(1)).alias("_n_"))
    return n.groupBy(*by).agg((F.max("_n_") / F.sum("_n_")).alias("majority_rate"))


def with_skill(df: DataFrame, accuracy: str, base: str) -> DataFrame:
    return df.withColumn("skill", skill(F.col(accuracy), F.col(base)))


def regression_scores(df: DataFrame, predicted: Column, true: Column, by: Sequence[str] = ()) -> DataFrame:
    """n, mae, rmse, bias and R2 about the truth's own mean (null where it doesn't vary), in one pass."""
    e = predicted - true
    spread = F.var_pop(true) * F.count(true)
    return df.groupBy(*by).agg(F.count(e).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), F.when(spread > 0, 1 - F.sum(e * e) / spread).alias("r2"))


def mean_predictor_scores(test: DataFrame, train: DataFrame, true: str) -> DataFrame:
    """regression_scores of always predicting the training mean."""
    mean = train.agg(F.avg(true).alias("_mean_"))
    return regression_scores(test.crossJoin(F.broadcast(mean)), F.col("_mean_"), F.col(true))  # one row


def volume_agreement(df: DataFrame, predicted: Column, true: Column, by: Sequence[str] = ()) -> DataFrame:
    """mae, bias and limits of agreement, bias +- 1.96 sample deviations (0 of one row)."""
    e = predicted - true
    sd = F.coalesce(F.stddev_samp(e), F.lit(0.0))
    return df.groupBy(*by).agg(F.count(e).alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"), (F.avg(e) - 1.96 * sd).alias("loa_low"), (F.avg(e) + 1.96 * sd).alias("loa_high"))


def confusion(df: DataFrame, true: str, predicted: str) -> DataFrame:
    """Counts of (true, predicted) over rows with a truth of 0 or more."""
    return df.where(F.col(true) >= 0).groupBy(F.col(true).cast("long").alias("true"), F.col(predicted).cast("long").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def classification_metrics(df: DataFrame, true: str, predicted: str, classes: Sequence[int]) -> DataFrame:
    """For each class: support, sensitivity, specificity (0 where undefined), and the accuracy over all."""
    rows = confusion(df, true, predicted)
    aggs = []
    for c in classes:
        t, p = F.col("true") == c, F.col("predicted") == c
        count = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0).cast("long"))
        aggs.append(F.struct(F.lit(c).cast("long").alias("class"), count(t & p).alias("tp"), count(t & ~p).alias("fn"), count(~t & p).alias("fp"), count(~t & ~p).alias("tn")).alias(f"c{c}"))
    flat = rows.agg(*aggs, (F.sum(F.when(F.col("true") == F.col("predicted"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    flat = flat.select("accuracy", F.explode(F.array(*[F.col(f"c{c}") for c in classes])).alias("m")).select("m.*", "accuracy")
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(a) + F.col(b)), F.lit(0.0))
    return flat.select("class", (F.col("tp") + F.col("fn")).alias("support"), rate("tp", "fn").alias("sensitivity"), rate("tn", "fp").alias("specificity"), "accuracy")


def match_tolerance(events: DataFrame, by: Sequence[str], t: str = "t_ms", fraction: float = 0.25, floor_ms: float = 50.0) -> DataFrame:
    """tolerance: a share of the median period, at least floor_ms."""
    rows = events.withColumn("_d_", delta(F.col(t), in_order(by, t)))
    return rows.groupBy(*by).agg(F.greatest(F.lit(floor_ms), F.coalesce(F.median("_d_") * fraction, F.lit(floor_ms))).alias("tolerance"))


def rate_cpm(events: DataFrame, by: Sequence[str], t: str = "t_ms") -> DataFrame:
    rows = events.withColumn("_d_", delta(F.col(t), in_order(by, t)))
    return rows.groupBy(*by).agg(F.coalesce(F.try_divide(F.lit(60000.0), F.median("_d_")), F.lit(0.0)).alias("rate_cpm"))


def match_scores(matched: DataFrame, predicted: DataFrame, true: DataFrame, by: Sequence[str]) -> DataFrame:
    """n_pred, n_true, n_matched, precision, recall, f1 (0 where undefined), count_error and its percentage (null without truth), bias, mad and rmse of dt."""
    p = predicted.groupBy(*by).agg(F.count(F.lit(1)).alias("n_pred"))
    q = true.groupBy(*by).agg(F.count(F.lit(1)).alias("n_true"))
    centre = matched.groupBy(*by).agg(F.median("dt").alias("_m_"))
    m = matched.join(centre, list(by)).groupBy(*by).agg(F.count(F.lit(1)).alias("n_matched"), F.avg("dt").alias("bias"), F.median(F.abs(F.col("dt") - F.col("_m_"))).alias("mad"), F.sqrt(F.avg(F.col("dt") * F.col("dt"))).alias("rmse"))
    rows = p.join(q, list(by), "full").join(m, list(by), "left")
    for c in ("n_pred", "n_true", "n_matched"):
        rows = rows.withColumn(c, F.coalesce(c, F.lit(0)))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    rows = rows.withColumn("precision", zero(F.try_divide("n_matched", "n_pred"))).withColumn("recall", zero(F.try_divide("n_matched", "n_true")))
    rows = rows.withColumn("f1", zero(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))))
    return rows.withColumn("count_error", F.col("n_pred") - F.col("n_true")).withColumn("count_error_pct", F.try_divide(100.0 * F.col("count_error"), F.col("n_true")))


def session_rollup(windows: DataFrame, by: Sequence[str], logits: str, volume: str, overlap: float, least_swallow: float = 0.5) -> DataFrame:
    """suck_count (class 1), swallow_count (class 2 with its probability), total_volume of class-2 windows, or of all if there is none, times overlap."""
    if not 0 < overlap <= 1:
        raise ValueError(f"overlap correction must lie in (0, 1]: {overlap}")
    rows = windows.withColumn("_p_", softmax(F.col(logits))).withColumn("_k_", argmax(F.col("_p_")))
    sure = (F.col("_k_") == 2) & (F.element_at("_p_", 3) >= least_swallow)
    return rows.groupBy(*by).agg(
        F.sum((F.col("_k_") == 1).cast("long")).alias("suck_count"), F.sum(sure.cast("long")).alias("swallow_count"),
        (F.coalesce(F.sum(F.when(F.col("_k_") == 2, F.col(volume))), F.sum(volume)) * overlap).alias("total_volume_ml"),
    )


def volume_targets(windows: DataFrame, at_start: str, at_end: str) -> DataFrame:
    """windows with `volume`: mass gained between both ends, in millilitres, never negative, FLOAT."""
    return windows.withColumn("volume", (F.greatest(F.lit(0.0), F.col(at_end) - F.col(at_start)) / GRAMS_PER_ML).cast("float"))


def volume_check(windows: DataFrame, scale: DataFrame, by: Sequence[str], overlap: float, t: str = "t_ms") -> DataFrame:
    """reconstructed (windows' volumes times overlap) beside measured (last less first reading)."""
    a = windows.groupBy(*by).agg((F.sum("volume") * overlap).alias("reconstructed_ml"))
    b = scale.groupBy(*by).agg(((F.max_by("scale_g", t) - F.min_by("scale_g", t)) / GRAMS_PER_ML).alias("measured_ml"))
    return a.join(b, list(by))


def summarise(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """n, median and least f1, median mad, median |count error| for each value of `by` (nulls form a group); NaN counts as missing. Best f1 first, then least mad."""
    v = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    got = scores.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.median(v("f1")).alias("f1_median"), F.min(v("f1")).alias("f1_min"), F.median(v("mad_ms")).alias("mad_median"), F.median(F.abs(v("count_err_pct"))).alias("count_err_median"))
    return got.orderBy(F.desc("f1_median"), F.asc("mad_median"))


def best_rows(df: DataFrame, by: Sequence[str], score: str, tie: str, largest: bool = True) -> DataFrame:
    """The row of the largest (or smallest) score of each group, the first by `tie` among equals."""
    order = F.desc(score) if largest else F.asc(score)
    return df.withColumn("_n_", F.row_number().over(Window.partitionBy(*by).orderBy(order, tie))).where("_n_ = 1").drop("_n_")


def worst_rows(df: DataFrame, score: str, n: int, ties: Sequence[str]) -> DataFrame:
    """The n rows of the smallest score, ties by the columns named; missing scores don't count."""
    x = F.col(score).cast("double")
    return df.where(x.isNotNull() & ~F.isnan(x)).orderBy(score, *ties).limit(n)


def missed_events(true: DataFrame, matched: DataFrame, by: Sequence[str], depth: str = "depth") -> DataFrame:
    """True events without a match (true has positions j), with the percentile rank of their depth."""
    from tidewell.functions.ordered import percentile_rank

    ranked = true.withColumn("depth_rank", percentile_rank(F.col(depth), by))
    return ranked.join(matched.select(*by, "j"), [*by, "j"], "left_anti")


def error_table(df: DataFrame, by: Sequence[str], error: str) -> DataFrame:
    """median, sd, p90 and worst of |error|, bias, and the share within 5."""
    e, a = F.col(error), F.abs(F.col(error))
    return df.groupBy(*by).agg(F.count(e).alias("n"), F.median(a).alias("median_abs"), F.stddev_samp(e).alias("sd"), F.percentile(a, F.lit(0.9)).alias("p90_abs"), F.max(a).alias("worst_abs"), F.avg(e).alias("bias"), F.avg((a <= 5).cast("double")).alias("within_5"))


def recurring(issues: DataFrame, n_reports: int) -> DataFrame:
    """Fields that were warned about as often as there are reports."""
    return issues.where("level = 'warning'").groupBy("field").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == n_reports)


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """rho: correlation of average ranks, 0 where either side doesn't vary."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_rx_", average_rank(F.col(x), by)).withColumn("_ry_", average_rank(F.col(y), by))
    return rows.groupBy(*by).agg(F.coalesce(correlation(F.col("_rx_"), F.col("_ry_")), F.lit(0.0)).alias("rho"), F.count(F.lit(1)).alias("n"))


def condition_correlations(df: DataFrame, features: Sequence[str], condition: str) -> DataFrame:
    """spearman of every feature with the condition."""
    long = df.select(condition, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])).alias("_f_")).select(condition, "_f_.feature", "_f_.value")
    return spearman(long, "value", condition, ["feature"])


def fill_response(df: DataFrame, by: Sequence[str], amplitude: str, fill: str) -> DataFrame:
    """slope and intercept of amplitude over the fill fraction, rho, n, and the change from full to empty in percent.

    A constant fill gives the mean as intercept and null for the rest; a full amplitude of 0 has no change. Fewer than
    three rows have no response.
    """
    a, f = F.col(amplitude).cast("double"), F.col(fill).cast("double")
    fit = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(a).alias("_mean_"), F.regr_slope(a, f).alias("slope"), F.regr_intercept(a, f).alias("intercept"), (F.max(f) - F.min(f)).alias("_span_")).where("n >= 3")
    rho = spearman(df, fill, amplitude, by).drop("n")
    rows = fit.join(rho, list(by)) if by else fit.crossJoin(F.broadcast(rho))  # one row each
    varies = F.col("_span_") > 0
    rows = rows.withColumn("slope", F.when(varies, F.col("slope"))).withColumn("intercept", F.when(varies, F.col("intercept")).otherwise(F.col("_mean_"))).withColumn("rho", F.when(varies, F.col("rho")))
    full = F.col("intercept") + F.col("slope")
    return rows.withColumn("pct_change", F.when(full != 0, 100 * (F.col("intercept") - full) / full)).drop("_mean_", "_span_")


def split_half(df: DataFrame, by: Sequence[str], order: str, amplitude: str, fill: str) -> DataFrame:
    """fill_response of the first half of each group's rows (rounded down) and of the rest."""
    rows = df.withColumn("_i_", F.row_number().over(in_order(by, order)) - 1).withColumn("_n_", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    return fill_response(rows.withColumn("half", F.when(F.col("_i_") < F.floor(F.col("_n_") / 2), "first").otherwise("second")), [*by, "half"], amplitude, fill)

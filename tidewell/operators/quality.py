"""Grades of streams and windows, and the contract a session must hold."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.ordered import delta, in_order

ERROR, WARNING = "error", "warning"
MAX_NAN = 0.02
MAX_DROPOUT_MS = 250.0
#: Rails of the converters, in counts.
RAILS: dict[str, tuple[float, float]] = {"strain": (-8300000, 8300000), "mic": (-32000, 32000), "imu": (-32000, 32000)}


class ContractError(ValueError):
    """A session breaks its contract; the message lists everything that does."""


def report(stats: DataFrame, by: Sequence[str], reasons: Mapping[str, Column], reject: bool = True) -> DataFrame:
    """by, ok, reasons (those that hold), stats (a map of the numeric columns)."""
    numbers = [c for c in stats.columns if c not in by]
    found = F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond in reasons.items()]), lambda r: r.isNotNull())
    values = F.map_from_arrays(F.array(*map(F.lit, numbers)), F.array(*[F.col(c).cast("double") for c in numbers]))
    return stats.select(*by, found.alias("reasons"), values.alias("stats")).withColumn("ok", (F.size("reasons") == 0) if reject else F.lit(True))


def timestamp_stats(df: DataFrame, by: Sequence[str], order: str, t: str = "t_ms", max_gap: float = MAX_DROPOUT_MS, per: float = 1000.0) -> DataFrame:
    """n, n_not_rising, n_dropouts, dropout_total, dropout_worst, median_step, effective_rate of each stream."""
    rows = df.withColumn("_d_", delta(F.col(t), in_order(by, order)))
    gap, step = F.when(F.col("_d_") > max_gap, F.col("_d_")), F.median("_d_")
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("_d_") <= 0, 1).otherwise(0)).cast("long").alias("n_not_rising"), F.count(gap).alias("n_dropouts"),
        F.coalesce(F.sum(gap), F.lit(0.0)).cast("double").alias("dropout_total"), F.coalesce(F.max(gap), F.lit(0.0)).cast("double").alias("dropout_worst"), step.alias("median_step"), F.when(step > 0, F.lit(per) / step).alias("effective_rate"),
    )


def check_timestamps(df: DataFrame, by: Sequence[str], order: str, t: str = "t_ms", max_gap: float = MAX_DROPOUT_MS, reject: bool = True) -> DataFrame:
    stats = timestamp_stats(df, by, order, t, max_gap)
    return report(stats, by, {"fewer than two samples": F.col("n") < 2, "time does not rise": F.col("n_not_rising") > 0, "dropouts": F.col("n_dropouts") > 0}, reject)


def saturation(df: DataFrame, by: Sequence[str], channels: Sequence[str], low: float, high: float) -> DataFrame:
    """Share of rows at or beyond a rail for each channel, as `<channel>_railed`."""
    return df.groupBy(*by).agg(*[F.avg(F.when((F.col(c) <= low) | (F.col(c) >= high), 1.0).otherwise(0.0)).alias(f"{c}_railed") for c in channels])


def check_saturation(df: DataFrame, by: Sequence[str], channels: Sequence[str], stream: str, rails: Mapping[str, tuple[float, float]] = RAILS, most: float = MAX_NAN, reject: bool = True) -> DataFrame:
    """A stream without rails passes."""
    low, high = rails.get(stream, (float("-inf"), float("inf")))
    stats = saturation(df, by, channels, low, high)
    if stream not in rails:
        return report(stats, by, {"none": F.lit(False)}, reject)
    return report(stats, by, {f"{c} at its rail": F.col(f"{c}_railed") > most for c in channels}, reject)


def window_stats(members: DataFrame, by: Sequence[str], channels: Sequence[str], ignore: Sequence[str] = ()) -> DataFrame:
    """Of each window (rows of window_members): n, bad_share over the live channels, and n_flat: finite channels that never move."""
    live = [c for c in channels if c not in ignore]
    bad = lambda c: F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c)) == float("inf"))
    aggs = [F.sum(F.when(bad(c), 1).otherwise(0)).alias(f"_bad_{c}") for c in live] + [(F.max(F.when(~bad(c), F.col(c))) - F.min(F.when(~bad(c), F.col(c)))).alias(f"_span_{c}") for c in live]
    rows = members.groupBy(*by, "window_idx").agg(F.count(F.lit(1)).alias("n"), *aggs)
    total = sum((F.col(f"_bad_{c}") for c in live), F.lit(0))
    flat = sum((F.when((F.col(f"_bad_{c}") == 0) & (F.col(f"_span_{c}") == 0), 1).otherwise(0) for c in live), F.lit(0))
    return rows.select(*by, "window_idx", "n", (total / (F.col("n") * max(1, len(live)))).alias("bad_share"), flat.cast("long").alias("n_flat"), F.lit(len(live)).alias("n_live"))


def good_windows(members: DataFrame, by: Sequence[str], channels: Sequence[str], ignore: Sequence[str] = (), max_nan: float = MAX_NAN) -> DataFrame:
    """window_stats with `ok`: some live channel, few bad samples, nothing flat."""
    return window_stats(members, by, channels, ignore).withColumn("ok", (F.col("n_live") > 0) & (F.col("n") > 0) & (F.col("bad_share") <= max_nan) & (F.col("n_flat") == 0))


def fixed(x: Column | str, digits: int) -> Column:
    """x with so many decimals, rounded on its exact value (format_string rounds the halves of its shortest digits up, unlike printf)."""
    return F.call_function("format_number", F.col(x) if isinstance(x, str) else x, F.lit("0." + "0" * digits))


def session_issues(streams: Mapping[str, DataFrame], channels: Mapping[str, Sequence[str]], rates: Mapping[str, float], scale: DataFrame | None = None, by: str = "session_id", t: str = "t_ms", order: str = "seq", least_overlap_s: float = 5.0) -> DataFrame:
    """(by, level, message) of everything that is wrong with sessions; a session that only some streams know lacks the others.

    Errors: an empty stream, a missing channel, time that falls, non-finite times, an overlap of the streams under
    least_overlap_s, non-finite scale readings (of two and more). Warnings: a rate off by more than a quarter, a scale that
    falls by more than 0.5 g.
    """
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    parts = []
    for name, df in streams.items():
        got = df.withColumn("_d_", delta(F.col(t), in_order([by], order))).groupBy(by).agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("_d_") < 0, 1).otherwise(0)).alias("falls"), F.sum(F.when(bad(t), 1).otherwise(0)).alias("bad"), F.min(F.when(~bad(t), F.col(t))).alias("lo"), F.max(F.when(~bad(t), F.col(t))).alias("hi"), F.median("_d_").alias("step"),
        )
        parts.append(got.withColumn("stream", F.lit(name)))
    stats = reduce(DataFrame.unionByName, parts)
    facts = F.array(*[F.struct(F.lit(k).alias("stream"), F.lit(float(rates[k])).alias("hz"), F.lit(", ".join(c for c in channels[k] if c not in df.columns)).alias("lacks")) for k, df in streams.items()])
    stats = stats.select(by).distinct().select(by, F.inline(facts)).join(stats, [by, "stream"], "left")
    say = lambda level, cond, text: F.when(cond, F.struct(F.lit(level).alias("level"), text.alias("message")))
    rate = 1000 / F.col("step")
    found = [
        say(ERROR, F.col("lacks") != "", F.concat("stream", F.lit(": no channel "), "lacks")),
        say(ERROR, F.col("n").isNull(), F.concat("stream", F.lit(": empty"))),
        say(ERROR, F.col("bad") > 0, F.format_string("%s: %d non-finite times", "stream", "bad")),
        say(ERROR, F.col("falls") > 0, F.format_string("%s: time falls %d times", "stream", "falls")),
        say(WARNING, (F.col("step") > 0) & (F.abs(rate / F.col("hz") - 1) > 0.25), F.format_string("%s: %s Hz instead of %s", F.col("stream"), fixed(rate, 1), fixed("hz", 1))),
    ]
    issues = stats.select(by, F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("i")).select(by, "i.*")
    both = stats.groupBy(by).agg(((F.min("hi") - F.max("lo")) / 1000).alias("overlap"), F.min(F.coalesce("n", F.lit(0))).alias("least"))
    short = F.format_string(f"streams overlap by %s s, less than {least_overlap_s}", fixed("overlap", 2))
    issues = issues.union(both.where(F.col("least") > 0).select(by, say(ERROR, ~(F.col("overlap") >= least_overlap_s), short).alias("i")).where("i is not null").select(by, "i.*"))
    if scale is not None:
        fall = delta(F.col("scale_g"), in_order([by], order))
        r = scale.withColumn("_d_", fall).groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(bad("scale_g"), 1).otherwise(0)).alias("bad"), F.min("_d_").alias("fall")).where("n >= 2")
        found = F.coalesce(say(ERROR, F.col("bad") > 0, F.format_string("scale: %d non-finite readings", "bad")), say(WARNING, F.col("fall") < -0.5, F.format_string("scale: falls by %s g", fixed(-F.col("fall"), 2))))
        issues = issues.union(r.select(by, found.alias("i")).where("i is not null").select(by, "i.*"))
    return issues


def refuse(issues: DataFrame, by: str = "session_id", most: int = 20) -> None:
    """ContractError with the first errors among session_issues, if there are any."""
    errors = issues.where(F.col("level") == ERROR).orderBy(by, "message").limit(most).collect()
    if errors:
        raise ContractError("; ".join(f"{r[by]}: {r['message']}" for r in errors))


def validate_session(streams: Mapping[str, DataFrame], channels: Mapping[str, Sequence[str]], rates: Mapping[str, float], scale: DataFrame | None = None, by: str = "session_id", **kw) -> list[str]:
    """Warnings of a few sessions; ContractError with all errors at once."""
    issues = session_issues(streams, channels, rates, scale, by, **kw)
    refuse(issues, by)
    return [r["message"] for r in issues.orderBy(by, "message").collect()]

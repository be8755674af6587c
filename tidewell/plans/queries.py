"""Registered queries over the test tables, each beside SQL for another engine.

Time scales are parameters of the operators; here they suit events some hours apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.functions import convert as V
from tidewell.functions.ordered import average_rank, in_order, percentile_rank, unwrap
from tidewell.operators import clock, evaluate, features, health, joins, quality, resample, stats, windows

DAY = 86_400_000.0
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

EV = """WITH ev AS (SELECT user_id, event_id, event_type, value, props, epoch_us(ts)::DOUBLE / 1000.0::DOUBLE AS t_ms,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events)"""


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without a zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", "props", (micros("ts").cast("double") / 1000.0).alias("t_ms"))
    return rows.withColumn("seq", F.row_number().over(in_order(["user_id"], ["t_ms", "event_id"])).cast("long"))


def r(x: Column | str, digits: int = 4) -> Column:
    return F.round(F.col(x).cast("double") if isinstance(x, str) else x.cast("double"), digits)


def rounded(df: DataFrame, columns: dict[str, int]) -> DataFrame:
    return df.withColumns({c: r(c, d) for c, d in columns.items()})


# ---- clocks and repair


@query(EV + """, raw AS (SELECT *, floor(t_ms * 10)::BIGINT % 4294967296 AS raw FROM ev),
d AS (SELECT *, CASE WHEN raw - lag(raw) OVER w < -2147483648 THEN 1 ELSE 0 END AS fell FROM raw WINDOW w AS (PARTITION BY user_id ORDER BY seq))
SELECT user_id, event_id, sum(fell) OVER w::BIGINT AS wraps, raw::DOUBLE + sum(fell) OVER w * 4294967296.0::DOUBLE AS unwrapped FROM d WINDOW w AS (PARTITION BY user_id ORDER BY seq)""")
def wrap_unwrap(spark, sf_dir):
    rows = ev(spark, sf_dir).withColumn("raw", F.floor(F.col("t_ms") * 10).cast("long") % 4294967296)
    return unwrap(rows, ["user_id"], "seq", "raw").select("user_id", "event_id", "wraps", "unwrapped")


@query(EV + """, raw AS (SELECT *, floor(t_ms * 10)::BIGINT % 4294967296 AS raw FROM ev), d AS (SELECT *, raw - lag(raw) OVER (PARTITION BY user_id ORDER BY seq) AS d FROM raw)
SELECT user_id, count(*) FILTER (d < -2147483648) AS n_wraps, count(*) FILTER (d < 0 AND d >= -2147483648) AS n_other_backsteps, max(raw)::DOUBLE AS peak, round(max(raw)::DOUBLE * 100.0 / 4294967296.0, 6)::DOUBLE AS pct_of_range FROM d GROUP BY 1""")
def wrap_report(spark, sf_dir):
    rows = ev(spark, sf_dir).withColumn("raw", F.floor(F.col("t_ms") * 10).cast("long") % 4294967296)
    return rounded(clock.wrap_report(rows, ["user_id"], "seq", "raw"), {"pct_of_range": 6})


@query(EV + """, raw AS (SELECT *, floor(t_ms * 10)::BIGINT % 4294967296 AS raw FROM ev)
SELECT user_id, round(max(raw)::DOUBLE * 100.0 / 4294967296.0, 6)::DOUBLE AS pct_of_range FROM raw GROUP BY 1 ORDER BY max(raw) DESC, user_id LIMIT 6""")
def wrap_headroom_top6(spark, sf_dir):
    rows = ev(spark, sf_dir).withColumn("raw", F.floor(F.col("t_ms") * 10).cast("long") % 4294967296)
    return clock.headroom(clock.wrap_report(rows, ["user_id"], "seq", "raw"), 6).select("user_id", r("pct_of_range", 6).alias("pct_of_range"))


@query("""SELECT o_custkey, o_orderkey, max(epoch_us(o_orderdate)::DOUBLE) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS t FROM orders""")
def repair_running_max(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", micros("o_orderdate").cast("double").alias("t"))
    return clock.repair(rows, ["o_custkey"], "o_orderkey", "t", "t")


@query("""WITH d AS (SELECT o_custkey, epoch_us(o_orderdate)::DOUBLE - lag(epoch_us(o_orderdate)::DOUBLE) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS d FROM orders)
SELECT o_custkey, count(*) FILTER (d < 0) AS n_backsteps, greatest(0.0::DOUBLE, coalesce(-min(d), 0.0::DOUBLE)) AS worst_backstep FROM d GROUP BY 1""")
def backstep_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", micros("o_orderdate").cast("double").alias("t"))
    return clock.backsteps(rows, ["o_custkey"], "o_orderkey", "t")


@query(EV + """, d AS (SELECT user_id, t_ms - lag(t_ms) OVER (PARTITION BY user_id ORDER BY seq) AS d FROM ev)
SELECT user_id, CASE WHEN median(d) > 0 THEN round(86400000.0::DOUBLE / median(d), 6)::DOUBLE END AS rate FROM d GROUP BY 1""")
def effective_rate(spark, sf_dir):
    return rounded(clock.effective_rate(ev(spark, sf_dir), ["user_id"], "seq", "t_ms", DAY), {"rate": 6})


@query(EV + """, d AS (SELECT user_id, event_type, t_ms - lag(t_ms) OVER (PARTITION BY user_id, event_type ORDER BY t_ms) AS d FROM ev)
SELECT user_id, event_type, round(coalesce(60000.0::DOUBLE / nullif(median(d), 0), 0), 9)::DOUBLE AS rate_cpm FROM d GROUP BY 1, 2""")
def rate_cpm(spark, sf_dir):
    return rounded(evaluate.rate_cpm(ev(spark, sf_dir), ["user_id", "event_type"]), {"rate_cpm": 9})


@query(EV + """, d AS (SELECT user_id, t_ms - lag(t_ms) OVER (PARTITION BY user_id ORDER BY t_ms) AS d FROM ev)
SELECT user_id, round(greatest(3600000.0::DOUBLE, coalesce(median(d) * 0.25::DOUBLE, 3600000.0::DOUBLE)), 3)::DOUBLE AS tolerance FROM d GROUP BY 1""")
def match_tolerance(spark, sf_dir):
    return rounded(evaluate.match_tolerance(ev(spark, sf_dir), ["user_id"], floor_ms=3_600_000.0), {"tolerance": 3})


def _sync(spark, sf_dir):
    rows = ev(spark, sf_dir).withColumn("s", (F.col("t_ms") - 1.7e12) / 1000.0)
    return rows.select("user_id", "seq", F.lit(25.0).alias("skew"), F.col("s").alias("host_s"), (F.col("s") / (1 + 25e-6) - 100.0 + F.col("value") * 1e-3).alias("device_s"))


SYNC = EV + """, sync AS (SELECT user_id, (t_ms - 1.7e12::DOUBLE) / 1000.0::DOUBLE AS host_s, (t_ms - 1.7e12::DOUBLE) / 1000.0::DOUBLE / (1 + 25e-6::DOUBLE) - 100.0::DOUBLE + value * 1e-3::DOUBLE AS device_s FROM ev),
rest AS (SELECT *, host_s - (1 + 25.0::DOUBLE * 1e-6::DOUBLE) * device_s AS rest FROM sync),
o AS (SELECT user_id, median(rest) AS o, count(*) AS n FROM rest GROUP BY 1), q AS (SELECT rest.user_id, rest - o AS q, n, o FROM rest JOIN o USING (user_id)),
f AS (SELECT user_id, any_value(o) AS offset_s, any_value(n) AS n_sync_points, sqrt(avg(q * q)) * 1000 AS residual_ms, mad(q) * 1.4826::DOUBLE * 1000 AS jitter_ms FROM q GROUP BY 1)"""


@query(SYNC + " SELECT user_id, n_sync_points, round(offset_s, 3)::DOUBLE AS offset_s, round(residual_ms, 1)::DOUBLE AS residual_ms, round(jitter_ms, 1)::DOUBLE AS jitter_ms FROM f")
def clock_fit(spark, sf_dir):
    got = clock.fit_clock(_sync(spark, sf_dir), ["user_id"], "skew")
    return rounded(got.select("user_id", "n_sync_points", "offset_s", "residual_ms", "jitter_ms"), {"offset_s": 3, "residual_ms": 1, "jitter_ms": 1})


@query(SYNC + """, line AS (SELECT user_id, regr_slope(host_s, device_s) AS m FROM sync GROUP BY 1), lr AS (SELECT sync.user_id, host_s - m * device_s AS x FROM sync JOIN line USING (user_id)), b AS (SELECT user_id, mad(x) * 1.4826::DOUBLE * 1000 AS best_ms FROM lr GROUP BY 1)
SELECT user_id, (n_sync_points >= 3 AND jitter_ms > greatest(3 * best_ms, best_ms + 5)) AS suspicious FROM f JOIN b USING (user_id)""")
def convention_check(spark, sf_dir):
    sync = _sync(spark, sf_dir)
    return clock.check_convention(sync, clock.fit_clock(sync, ["user_id"], "skew"), ["user_id"]).select("user_id", "suspicious")


@query("""WITH a AS (SELECT s_nationkey AS board, CASE WHEN s_suppkey % 4 = 0 THEN s_acctbal / 2 END AS a, s_acctbal AS p, CASE WHEN s_suppkey % 5 <> 4 THEN (s_suppkey % 5)::DOUBLE END AS se FROM supplier WHERE s_suppkey % 3 <> 0),
w AS (SELECT board, coalesce(a, p) AS s, CASE WHEN se IS NULL OR se = 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE / greatest(se, 1e-6) ** 2 END AS w FROM a)
SELECT board, round(sum(w * s) / sum(w), 6)::DOUBLE AS pooled_skew_ppm, count(*) AS n_captures FROM w WHERE s IS NOT NULL GROUP BY 1""")
def pooled_skew(spark, sf_dir):
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("board"), F.when(k % 4 == 0, F.col("s_acctbal") / 2).alias("skew_applied"), F.col("s_acctbal").alias("skew_ppm"),
        F.when(k % 5 != 4, (k % 5).cast("double")).alias("skew_se_ppm"), F.when(k % 3 != 0, "resolved").otherwise("weak").alias("skew_confidence"),
    )
    return rounded(clock.pooled_skew(rows), {"pooled_skew_ppm": 6})


@query(EV + """, k AS (SELECT *, row_number() OVER (PARTITION BY user_id, floor(t_ms / 86400000.0::DOUBLE) ORDER BY seq) AS n FROM ev) SELECT user_id, event_id FROM k WHERE n = 1""")
def strictly_increasing(spark, sf_dir):
    rows = ev(spark, sf_dir).withColumn("day", F.floor(F.col("t_ms") / DAY))
    return clock.strictly_increasing(rows, ["user_id"], "day", "seq").select("user_id", "event_id")


# ---- conversion


@query("""WITH c AS (SELECT l_returnflag, (l_extendedprice - 50000.0::DOUBLE) * 100 AS counts FROM lineitem),
v AS (SELECT l_returnflag, counts / 8388608.0::DOUBLE * 3.3::DOUBLE AS v FROM c),
s AS (SELECT l_returnflag, CASE WHEN abs(v) >= 3.3e-6::DOUBLE THEN v WHEN v < 0 THEN -3.3e-6::DOUBLE ELSE 3.3e-6::DOUBLE END AS v FROM v)
SELECT l_returnflag, count(*) AS n, round(median((1500.0::DOUBLE * (3.3::DOUBLE - v) / v)::FLOAT::DOUBLE), 2)::DOUBLE AS middle FROM s GROUP BY 1""")
def calibrate_divider(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", V.stretch((F.col("l_extendedprice") - 50000.0) * 100).cast("double").alias("ohm"))
    return rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), r(F.median("ohm"), 2).alias("middle"))


@query("""SELECT p_partkey, round((p_size - 1) * 30.0::DOUBLE / 49.0::DOUBLE - 15.0::DOUBLE, 6)::DOUBLE AS psi, round(greatest(0.0::DOUBLE, p_retailprice - 1000) / 1.03::DOUBLE, 4)::DOUBLE AS ml FROM part""")
def affine_convert(spark, sf_dir):
    psi = V.Affine(1.0, 50.0, -15.0, 15.0)
    return table(spark, sf_dir, "part").select("p_partkey", r(psi(F.col("p_size")), 6).alias("psi"), r(V.millilitres(F.col("p_retailprice") - 1000.0), 4).alias("ml"))


@query("""WITH f AS (SELECT l_linenumber, ln(greatest(l_quantity, 0) + 1) AS y FROM lineitem), m AS (SELECT l_linenumber, avg(y) AS m FROM f GROUP BY 1), s AS (SELECT f.l_linenumber, avg(exp(y - m)) AS s, any_value(m) AS m FROM f JOIN m USING (l_linenumber) GROUP BY 1)
SELECT l_linenumber, round(s, 6)::DOUBLE AS smearing, round(greatest(exp(m) * s - 1, 0), 6)::DOUBLE AS flow FROM s""")
def log_flow_smearing(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_linenumber", V.to_log_flow(F.col("l_quantity")).alias("y"))
    centre = rows.groupBy("l_linenumber").agg(F.avg("y").alias("m"))
    got = rows.join(centre, "l_linenumber").groupBy("l_linenumber").agg(V.smearing(F.col("y") - F.col("m")).alias("smearing"), F.first("m").alias("m"))
    return got.select("l_linenumber", r("smearing", 6).alias("smearing"), r(V.from_log_flow(F.col("m"), F.col("smearing")), 6).alias("flow"))


# ---- quality


@query(EV + """, d AS (SELECT user_id, t_ms - lag(t_ms) OVER (PARTITION BY user_id ORDER BY seq) AS d FROM ev)
SELECT user_id, count(*) AS n, count(*) FILTER (d <= 0) AS n_not_rising, count(*) FILTER (d > 172800000) AS n_dropouts, round(coalesce(sum(d) FILTER (d > 172800000), 0), 3)::DOUBLE AS dropout_total, round(coalesce(max(d) FILTER (d > 172800000), 0), 3)::DOUBLE AS dropout_worst FROM d GROUP BY 1""")
def timestamp_quality(spark, sf_dir):
    got = quality.timestamp_stats(ev(spark, sf_dir), ["user_id"], "seq", "t_ms", 2 * DAY)
    return rounded(got.select("user_id", "n", "n_not_rising", "n_dropouts", "dropout_total", "dropout_worst"), {"dropout_total": 3, "dropout_worst": 3})


@query("""SELECT event_type, round(avg(CASE WHEN value <= 20 OR value >= 180 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6)::DOUBLE AS value_railed FROM events GROUP BY 1""")
def saturation_fraction(spark, sf_dir):
    return rounded(quality.saturation(table(spark, sf_dir, "events"), ["event_type"], ["value"], 20.0, 180.0), {"value_railed": 6})


def _members(spark, sf_dir, length: int = 10, hop: int = 5) -> DataFrame:
    return windows.window_members(ev(spark, sf_dir), ["user_id"], "seq", length, hop)


WINDOWED = EV + """, s AS (SELECT *, seq - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM ev),
m AS (SELECT * FROM (SELECT s.*, unnest([i // 5 - 1, i // 5]) AS window_idx FROM s) WHERE window_idx >= 0 AND window_idx * 5 + 10 <= n)"""


@query(WINDOWED + """, g AS (SELECT user_id, window_idx, count(*) AS n, avg((value IS NULL OR value < 5)::INT) AS bad_share, max(value) - min(value) AS span FROM m GROUP BY 1, 2)
SELECT user_id, window_idx, n, round(bad_share, 6)::DOUBLE AS bad_share, (bad_share <= 0.2 AND NOT (bad_share = 0 AND span = 0)) AS ok FROM g""")
def window_quality(spark, sf_dir):
    rows = _members(spark, sf_dir).withColumn("value", F.when(F.col("value") >= 5, F.col("value")))
    got = quality.good_windows(rows, ["user_id"], ["value"], max_nan=0.2)
    return got.select("user_id", "window_idx", "n", r("bad_share", 6).alias("bad_share"), "ok")


# ---- resampling

GRID = EV + """, g0 AS (SELECT user_id, min(t_ms) AS t0, max(t_ms) AS t1 FROM ev GROUP BY 1), g AS (SELECT user_id, unnest(range(0, floor((t1 - t0) / 86400000.0::DOUBLE)::BIGINT + 1)) AS grid_idx, t0 FROM g0), gt AS (SELECT user_id, grid_idx, t0 + grid_idx * 86400000.0::DOUBLE AS t FROM g)"""
LERP = """a AS (SELECT gt.*, ev.t_ms AS ta, ev.value AS va FROM gt ASOF LEFT JOIN e1 ev ON gt.user_id = ev.user_id AND gt.t >= ev.t_ms),
b AS (SELECT gt.user_id, gt.grid_idx, ev.t_ms AS tb, ev.value AS vb FROM gt ASOF LEFT JOIN e1 ev ON gt.user_id = ev.user_id AND gt.t <= ev.t_ms)"""


def _once(spark, sf_dir):
    return clock.strictly_increasing(ev(spark, sf_dir), ["user_id"], "t_ms", "seq")


def _grid(spark, sf_dir, hz: float = 1000.0 / DAY) -> DataFrame:
    spans = ev(spark, sf_dir).groupBy("user_id").agg(F.min("t_ms").alias("t0_ms"), F.max("t_ms").alias("t1_ms"))
    return resample.make_grid(spans, hz)


@query(GRID + " SELECT user_id, grid_idx, round(t, 3)::DOUBLE AS t_ms FROM gt")
def make_grid(spark, sf_dir):
    return _grid(spark, sf_dir).select("user_id", "grid_idx", r("t_ms", 3).alias("t_ms"))


@query(GRID + ", e1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, t_ms ORDER BY seq) AS k FROM ev) WHERE k = 1), " + LERP + """
SELECT user_id, grid_idx, round((CASE WHEN ta IS NULL THEN vb WHEN tb IS NULL OR ta = tb THEN va ELSE va + (vb - va) * (t - ta) / (tb - ta) END)::FLOAT::DOUBLE, 2)::DOUBLE AS value FROM a JOIN b USING (user_id, grid_idx)""")
def linear_resample(spark, sf_dir):
    grid = _grid(spark, sf_dir).select("user_id", "grid_idx", "t_ms")
    got = resample.resample_linear(_once(spark, sf_dir).select("user_id", "seq", "t_ms", "value"), grid, ["user_id"], ["value"], order="seq")
    return got.select("user_id", "grid_idx", r("value", 2).alias("value"))


@query(EV + """, e1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, t_ms ORDER BY seq) AS k FROM ev) WHERE k = 1 AND event_type = 'view'), gt AS (SELECT user_id, event_id AS grid_idx, t_ms AS t FROM ev WHERE event_type = 'click'), """ + LERP + """
SELECT user_id, grid_idx AS event_id, round(CASE WHEN ta IS NULL THEN vb WHEN tb IS NULL OR ta = tb THEN va ELSE va + (vb - va) * (t - ta) / (tb - ta) END, 4)::DOUBLE AS value FROM a JOIN b USING (user_id, grid_idx)""")
def point_interp(spark, sf_dir):
    rows = ev(spark, sf_dir)
    points = rows.where("event_type = 'click'").select("user_id", "event_id", "t_ms")
    samples = _once(spark, sf_dir).where("event_type = 'view'").select("user_id", "t_ms", "value")
    return resample.interpolate(points, samples, ["user_id"], ["value"]).select("user_id", "event_id", r("value", 4).alias("value"))


@query(GRID + """, l AS (SELECT ev.user_id, floor((t_ms - (t0 - 43200000.0::DOUBLE)) / 86400000.0::DOUBLE)::BIGINT AS grid_idx, sqrt(avg(value * value)) AS v FROM ev JOIN g0 USING (user_id) GROUP BY 1, 2),
j AS (SELECT g.user_id, g.grid_idx, v FROM g LEFT JOIN l USING (user_id, grid_idx)), k AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN grid_idx END IGNORE NULLS) OVER w AS ia, last_value(v IGNORE NULLS) OVER w AS va, first_value(CASE WHEN v IS NOT NULL THEN grid_idx END IGNORE NULLS) OVER u AS ib, first_value(v IGNORE NULLS) OVER u AS vb FROM j
WINDOW w AS (PARTITION BY user_id ORDER BY grid_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), u AS (PARTITION BY user_id ORDER BY grid_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT user_id, grid_idx, round((CASE WHEN v IS NOT NULL THEN v WHEN ia IS NULL THEN coalesce(vb, 0) WHEN ib IS NULL THEN va ELSE va + (vb - va) * (grid_idx - ia) / (ib - ia) END)::FLOAT::DOUBLE, 2)::DOUBLE AS envelope FROM k""")
def envelope_rms(spark, sf_dir):
    got = resample.envelope(ev(spark, sf_dir).select("user_id", "t_ms", "value"), _grid(spark, sf_dir).select("user_id", "grid_idx", "t0_ms"), ["user_id"], "value", 1000.0 / DAY)
    return got.select("user_id", "grid_idx", r("envelope", 2).alias("envelope"))


@query(EV + """, m AS (SELECT *, value - avg(value) OVER (PARTITION BY user_id) AS x, (seq - 1) // 5 AS b FROM ev), g AS (SELECT user_id, b AS block_idx, sqrt(avg(x * x)) AS rms, count(*) AS n FROM m GROUP BY 1, 2), h AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS k FROM g WHERE n = 5)
SELECT user_id, block_idx, round(rms, 4)::DOUBLE AS rms FROM h WHERE k >= 8""")
def block_rms(spark, sf_dir):
    return rounded(resample.block_rms(ev(spark, sf_dir), ["user_id"], "seq", "value", 5), {"rms": 4})


@query(EV + """, z AS (SELECT user_id, event_id, seq, CASE WHEN event_id % 4 <> 0 AND value <> 0 THEN value END AS v FROM ev), k AS (SELECT *, count(v) OVER (PARTITION BY user_id) AS n, last_value(CASE WHEN v IS NOT NULL THEN seq END IGNORE NULLS) OVER w AS ia, last_value(v IGNORE NULLS) OVER w AS va, first_value(CASE WHEN v IS NOT NULL THEN seq END IGNORE NULLS) OVER u AS ib, first_value(v IGNORE NULLS) OVER u AS vb FROM z
WINDOW w AS (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), u AS (PARTITION BY user_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT user_id, event_id, round(CASE WHEN n < 2 THEN 0 WHEN v IS NOT NULL THEN v WHEN ia IS NULL THEN vb WHEN ib IS NULL THEN va ELSE va + (vb - va) * (seq - ia) / (ib - ia) END, 4)::DOUBLE AS value FROM k""")
def fill_zeros_interp(spark, sf_dir):
    rows = ev(spark, sf_dir).withColumn("value", F.when(F.col("event_id") % 4 == 0, F.lit(0.0)).otherwise(F.col("value")))
    return resample.fill_gaps(rows, ["user_id"], "seq", "value").select("user_id", "event_id", r("value", 4).alias("value"))


# ---- windows and labels


@query(WINDOWED + " SELECT user_id, window_idx, window_idx * 5 AS start_sample, round(min(t_ms), 3)::DOUBLE AS t_start_ms, round(max(t_ms), 3)::DOUBLE AS t_end_ms FROM m GROUP BY 1, 2")
def sliding_windows(spark, sf_dir):
    return rounded(windows.make_windows(ev(spark, sf_dir), ["user_id"], "t_ms", 10, 5), {"t_start_ms": 3, "t_end_ms": 3}).select("user_id", "window_idx", "start_sample", "t_start_ms", "t_end_ms")


@query(WINDOWED + """, g AS (SELECT user_id, window_idx, avg(value) AS mean, stddev_pop(value) AS std, max(value) - min(value) AS range, sqrt(avg(value * value)) AS rms, coalesce(regr_slope(value, sample), 0) AS slope, sum(value * value) AS energy FROM (SELECT *, i - window_idx * 5 AS sample FROM m) GROUP BY 1, 2),
c AS (SELECT user_id, window_idx, i, sign(value - avg(value) OVER (PARTITION BY user_id, window_idx)) AS s FROM m), z AS (SELECT user_id, window_idx, avg(d) AS zcr FROM (SELECT user_id, window_idx, (s <> lag(s) OVER (PARTITION BY user_id, window_idx ORDER BY i))::INT AS d FROM c) GROUP BY 1, 2)
SELECT user_id, window_idx, round(mean, 4)::DOUBLE AS mean, round(std, 4)::DOUBLE AS std, round(range, 4)::DOUBLE AS range, round(rms, 4)::DOUBLE AS rms, round(slope, 4)::DOUBLE AS slope, round(range, 4)::DOUBLE AS p2p, round(coalesce(zcr, 0), 6)::DOUBLE AS zcr, round(energy, 4)::DOUBLE AS energy FROM g JOIN z USING (user_id, window_idx)""")
def strain_stats(spark, sf_dir):
    got = features.series_stats(_members(spark, sf_dir), ["user_id", "window_idx"], "value")
    return rounded(got, {"mean": 4, "std": 4, "range": 4, "rms": 4, "slope": 4, "p2p": 4, "zcr": 6, "energy": 4})


AXES = "value AS ax, value / 2 AS ay, value - 100 AS az, value * 2 AS gx, value + 1 AS gy, 3.0::DOUBLE AS gz"


@query(WINDOWED + f""", x AS (SELECT *, {AXES} FROM m), y AS (SELECT *, sqrt(ax * ax + ay * ay + az * az) AS a, sqrt(gx * gx + gy * gy + gz * gz) AS g FROM x), z AS (SELECT *, abs(a - lag(a) OVER (PARTITION BY user_id, window_idx ORDER BY i)) AS j FROM y)
SELECT user_id, window_idx, round(avg(ax), 4)::DOUBLE AS ax_mean, round(stddev_pop(gx), 4)::DOUBLE AS gx_std, round(avg(a), 4)::DOUBLE AS acc_size, round(avg(g), 4)::DOUBLE AS gyr_size, round(avg(a * a), 3)::DOUBLE AS motion_energy, round(avg(j), 4)::DOUBLE AS jerk, round(atan2(sqrt(avg(ax) ** 2 + avg(ay) ** 2), abs(avg(az)) + 1e-8::DOUBLE), 6)::DOUBLE AS tilt FROM z GROUP BY 1, 2""")
def motion_features(spark, sf_dir):
    v = F.col("value")
    rows = _members(spark, sf_dir).withColumns({"ax": v, "ay": v / 2, "az": v - 100, "gx": v * 2, "gy": v + 1, "gz": F.lit(3.0)})
    got = features.motion_stats(rows, ["user_id", "window_idx"], ["ax", "ay", "az", "gx", "gy", "gz"])
    return rounded(got.select("user_id", "window_idx", "ax_mean", "gx_std", "acc_size", "gyr_size", "motion_energy", "jerk", "tilt"), {"ax_mean": 4, "gx_std": 4, "acc_size": 4, "gyr_size": 4, "motion_energy": 3, "jerk": 4, "tilt": 6})


@query(WINDOWED + " SELECT user_id, window_idx, round(stddev_pop(value), 4)::DOUBLE AS value FROM m GROUP BY 1, 2")
def window_amplitude(spark, sf_dir):
    return rounded(features.window_amplitudes(_members(spark, sf_dir), ["user_id"], ["value"]), {"value": 4})


DAYS = EV + """, g0 AS (SELECT user_id, min(t_ms) AS t0, max(t_ms) AS t1 FROM ev GROUP BY 1), w AS (SELECT user_id, k AS window_idx, t0 + k * 86400000.0::DOUBLE AS a, t0 + k * 86400000.0::DOUBLE + 172800000.0::DOUBLE AS b FROM (SELECT *, unnest(range(0, floor((t1 - t0) / 86400000.0::DOUBLE)::BIGINT + 1)) AS k FROM g0))"""


def _day_windows(spark, sf_dir) -> DataFrame:
    g = _grid(spark, sf_dir)
    return g.select("user_id", F.col("grid_idx").alias("window_idx"), F.col("t_ms").alias("t_start_ms"), (F.col("t_ms") + 2 * DAY).alias("t_end_ms"))


CLASSES = ("none", "click", "view", "purchase")


@query(DAYS + """, e AS (SELECT user_id, t_ms, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 3 END AS c FROM ev WHERE event_type IN ('click', 'view', 'purchase')),
n AS (SELECT w.user_id, window_idx, c, count(*) AS n FROM w JOIN e ON e.user_id = w.user_id AND t_ms >= a AND t_ms < b GROUP BY 1, 2, 3), l AS (SELECT user_id, window_idx, c FROM n QUALIFY row_number() OVER (PARTITION BY user_id, window_idx ORDER BY n DESC, c) = 1)
SELECT w.user_id, w.window_idx, coalesce(c, 0)::BIGINT AS label FROM w LEFT JOIN l USING (user_id, window_idx)""")
def window_labels_halfopen(spark, sf_dir):
    events = ev(spark, sf_dir).where(F.col("event_type").isin(*CLASSES[1:])).select("user_id", "t_ms", F.col("event_type").alias("type"))
    return evaluate.window_labels(_day_windows(spark, sf_dir), events, ["user_id"], CLASSES, 2 * DAY).select("user_id", "window_idx", "label")


@query(DAYS + " SELECT w.user_id, window_idx, count(t_ms) AS n_events FROM w LEFT JOIN ev ON ev.user_id = w.user_id AND t_ms >= a AND t_ms <= b GROUP BY 1, 2")
def window_counts_closed(spark, sf_dir):
    return evaluate.window_counts(_day_windows(spark, sf_dir), ev(spark, sf_dir), ["user_id"], 2 * DAY).select("user_id", "window_idx", "n_events")


@query(DAYS + """, c AS (SELECT w.user_id, window_idx, count(t_ms) AS n FROM w LEFT JOIN ev ON ev.user_id = w.user_id AND t_ms >= a AND t_ms <= b GROUP BY 1, 2), p AS (SELECT user_id, count(*) AS n_events, median(d) AS p FROM (SELECT user_id, t_ms - lag(t_ms) OVER (PARTITION BY user_id ORDER BY t_ms) AS d FROM ev) GROUP BY 1)
SELECT c.user_id, count(*) AS n_windows, round(avg(n), 6)::DOUBLE AS events_per_window_mean, max(n) AS events_per_window_max, round(avg((n > 0)::INT), 6)::DOUBLE AS occupancy, any_value(n_events) AS n_events, coalesce(172800000 <= any_value(p), false) AS resolves_single_events FROM c JOIN p USING (user_id) GROUP BY 1""")
def granularity(spark, sf_dir):
    rows = ev(spark, sf_dir)
    counted = evaluate.window_counts(_day_windows(spark, sf_dir), rows, ["user_id"], 2 * DAY)
    got = evaluate.granularity(counted, rows, ["user_id"], 172800.0)
    return got.select("user_id", "n_windows", r("events_per_window_mean", 6).alias("events_per_window_mean"), "events_per_window_max", r("occupancy", 6).alias("occupancy"), "n_events", "resolves_single_events")


@query("WITH RECURSIVE" + EV[4:] + """, s0 AS (SELECT user_id, avg(value) AS s FROM ev WHERE seq <= 5 GROUP BY 1), e AS (SELECT ev.user_id, seq, value, 0.1::DOUBLE * value + 0.9::DOUBLE * s AS y FROM ev JOIN s0 USING (user_id) WHERE seq = 1
UNION ALL SELECT ev.user_id, ev.seq, ev.value, 0.1::DOUBLE * ev.value + 0.9::DOUBLE * e.y FROM e JOIN ev ON ev.user_id = e.user_id AND ev.seq = e.seq + 1)
SELECT user_id, seq, round((value - y)::FLOAT::DOUBLE, 2)::DOUBLE AS value FROM e""")
def ema_drift(spark, sf_dir):
    got = windows.ema_baseline(ev(spark, sf_dir).select("user_id", "seq", "value"), ["user_id"], "seq", ["value"], 0.1, 5)
    return got.select("user_id", "seq", r("value", 2).alias("value"))


@query(EV + " SELECT user_id, event_id, round(median(value) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING), 4)::DOUBLE AS median FROM ev")
def rolling_median(spark, sf_dir):
    return windows.rolling_median(ev(spark, sf_dir), ["user_id"], "seq", "value", 6).select("user_id", "event_id", r("median", 4).alias("median"))


# ---- ranks, scores, statistics


@query("""SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2.0::DOUBLE AS avg_rank,
round((rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY l_suppkey), 9)::DOUBLE AS pct_rank FROM lineitem""")
def average_and_percentile_rank(spark, sf_dir):
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", average_rank(q, ["l_suppkey"]).alias("avg_rank"), r(percentile_rank(q, ["l_suppkey"]), 9).alias("pct_rank"))


@query("""WITH k AS (SELECT l_suppkey, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY l_suppkey ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_suppkey, l_discount) - 1) / 2.0::DOUBLE AS b FROM lineitem)
SELECT l_suppkey, round(coalesce(CASE WHEN stddev_pop(a) = 0 OR stddev_pop(b) = 0 THEN 0 ELSE corr(a, b) END, 0), 6)::DOUBLE AS rho, count(*) AS n FROM k GROUP BY 1""")
def spearman_by_group(spark, sf_dir):
    return rounded(evaluate.spearman(table(spark, sf_dir, "lineitem"), "l_quantity", "l_discount", ["l_suppkey"]), {"rho": 6})


PRED = "l_quantity * 1500.0::DOUBLE"


@query(f"""WITH e AS (SELECT l_returnflag, l_extendedprice AS y, {PRED} - l_extendedprice AS e FROM lineitem)
SELECT l_returnflag, count(*) AS n, round(avg(abs(e)), 3)::DOUBLE AS mae, round(sqrt(avg(e * e)), 3)::DOUBLE AS rmse, round(avg(e), 3)::DOUBLE AS bias, round(1 - sum(e * e) / (var_pop(y) * count(*)), 6)::DOUBLE AS r2 FROM e GROUP BY 1""")
def regression_scores(spark, sf_dir):
    got = evaluate.regression_scores(table(spark, sf_dir, "lineitem"), F.col("l_quantity") * 1500.0, F.col("l_extendedprice"), ["l_returnflag"])
    return rounded(got, {"mae": 3, "rmse": 3, "bias": 3, "r2": 6})


@query("""WITH m AS (SELECT avg(l_extendedprice) AS m FROM lineitem WHERE l_orderkey % 2 = 0), e AS (SELECT l_extendedprice AS y, m - l_extendedprice AS e FROM lineitem, m WHERE l_orderkey % 2 = 1)
SELECT count(*) AS n, round(avg(abs(e)), 3)::DOUBLE AS mae, round(sqrt(avg(e * e)), 3)::DOUBLE AS rmse, round(avg(e), 3)::DOUBLE AS bias, round(1 - sum(e * e) / (var_pop(y) * count(*)), 6)::DOUBLE AS r2 FROM e""")
def mean_predictor(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    got = evaluate.mean_predictor_scores(rows.where("l_orderkey % 2 = 1"), rows.where("l_orderkey % 2 = 0"), "l_extendedprice")
    return rounded(got, {"mae": 3, "rmse": 3, "bias": 3, "r2": 6})


@query(f"""WITH e AS (SELECT l_shipdate, l_linenumber, {PRED} - l_extendedprice AS e FROM lineitem)
SELECT l_linenumber, count(*) AS n, round(avg(abs(e)), 3)::DOUBLE AS mae, round(avg(e), 3)::DOUBLE AS bias, round(avg(e) - 1.96::DOUBLE * coalesce(stddev_samp(e), 0), 2)::DOUBLE AS loa_low, round(avg(e) + 1.96::DOUBLE * coalesce(stddev_samp(e), 0), 2)::DOUBLE AS loa_high FROM e GROUP BY 1""")
def bland_altman(spark, sf_dir):
    got = evaluate.volume_agreement(table(spark, sf_dir, "lineitem"), F.col("l_quantity") * 1500.0, F.col("l_extendedprice"), ["l_linenumber"])
    return rounded(got, {"mae": 3, "bias": 3, "loa_low": 2, "loa_high": 2})


@query("""WITH t AS (SELECT count(*) AS n, count(*) FILTER (quality = toxic) AS ok FROM labels), c AS (SELECT unnest([0, 1]) AS class), m AS (SELECT class, count(*) FILTER (quality = class) AS sup, count(*) FILTER (quality = class AND toxic = class) AS tp, count(*) FILTER (quality <> class AND toxic <> class) AS tn, count(*) AS n FROM labels, c GROUP BY 1)
SELECT class::BIGINT AS class, sup AS support, round(coalesce(tp / nullif(sup, 0), 0), 6)::DOUBLE AS sensitivity, round(coalesce(tn / nullif(m.n - sup, 0), 0), 6)::DOUBLE AS specificity, round(ok / t.n, 6)::DOUBLE AS accuracy FROM m, t""")
def confusion_metrics(spark, sf_dir):
    got = evaluate.classification_metrics(table(spark, sf_dir, "labels"), "quality", "toxic", [0, 1])
    return rounded(got, {"sensitivity": 6, "specificity": 6, "accuracy": 6})


@query("""WITH n AS (SELECT user_id % 10 AS g, event_type, count(*) AS n FROM events GROUP BY 1, 2), m AS (SELECT g, max(n) / sum(n) AS m FROM n GROUP BY 1) SELECT g, round(m, 6)::DOUBLE AS majority_rate, round((0.9::DOUBLE - m) / (1 - m), 6)::DOUBLE AS skill FROM m""")
def majority_skill(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("g"), F.crc32(F.col("event_type").cast("binary")).alias("label"))
    got = evaluate.majority_rate(rows, ["g"])
    return rounded(evaluate.with_skill(got.withColumn("accuracy", F.lit(0.9)), "accuracy", "majority_rate").drop("accuracy"), {"majority_rate": 6, "skill": 6})


@query("""WITH n AS (SELECT label::BIGINT AS class, count(*) AS n FROM embeddings GROUP BY 1), c AS (SELECT unnest(range(0, 12)) AS class) SELECT class, coalesce(n, 0) AS n, round(coalesce(n, 0) / (SELECT sum(n) FROM n), 9)::DOUBLE AS share FROM c LEFT JOIN n USING (class)""")
def class_balance(spark, sf_dir):
    return rounded(evaluate.class_balance(table(spark, sf_dir, "embeddings"), range(12)), {"share": 9})


FILL = EV + """, f AS (SELECT user_id, seq, value AS a, (t_ms - min(t_ms) OVER p) / (max(t_ms) OVER p - min(t_ms) OVER p) AS f, count(*) OVER p AS n FROM ev WINDOW p AS (PARTITION BY user_id))"""


def _fill(spark, sf_dir) -> DataFrame:
    w = in_order(["user_id"], "seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = ev(spark, sf_dir)
    return rows.withColumn("fill", (F.col("t_ms") - F.min("t_ms").over(w)) / (F.max("t_ms").over(w) - F.min("t_ms").over(w))).select("user_id", "seq", F.col("value").alias("a"), "fill")


@query(FILL + """, k AS (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY a) + (count(*) OVER (PARTITION BY user_id, a) - 1) / 2.0::DOUBLE AS ra, rank() OVER (PARTITION BY user_id ORDER BY f) + (count(*) OVER (PARTITION BY user_id, f) - 1) / 2.0::DOUBLE AS rf FROM f)
SELECT user_id, count(*) AS n, round(regr_slope(a, f), 4)::DOUBLE AS slope, round(regr_intercept(a, f), 4)::DOUBLE AS intercept, round(corr(ra, rf), 6)::DOUBLE AS rho FROM k GROUP BY 1 HAVING count(*) >= 3""")
def ols_fill_response(spark, sf_dir):
    got = evaluate.fill_response(_fill(spark, sf_dir), ["user_id"], "a", "fill")
    return rounded(got.select("user_id", "n", "slope", "intercept", "rho"), {"slope": 4, "intercept": 4, "rho": 6})


@query(FILL + """, h AS (SELECT *, CASE WHEN seq - 1 < n // 2 THEN 'first' ELSE 'second' END AS half FROM f) SELECT user_id, half, count(*) AS n, round(regr_slope(a, f), 4)::DOUBLE AS slope FROM h GROUP BY 1, 2 HAVING count(*) >= 3""")
def split_half(spark, sf_dir):
    got = evaluate.split_half(_fill(spark, sf_dir), ["user_id"], "seq", "a", "fill")
    return rounded(got.select("user_id", "half", "n", "slope"), {"slope": 4})


@query(EV + """ SELECT a.user_id, a.event_id AS click_id, b.event_id AS view_id FROM ev a JOIN ev b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'view' AND abs(a.t_ms - b.t_ms) <= 7200000""")
def band_join_pairs(spark, sf_dir):
    rows = ev(spark, sf_dir)
    a = rows.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), F.col("t_ms").alias("ta"))
    b = rows.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("t_ms").alias("tb"))
    return joins.band_join(a, b, ["user_id"], "ta", "tb", 7_200_000.0).select("user_id", "click_id", "view_id")


def _match(spark, sf_dir):
    rows = ev(spark, sf_dir)
    p, q = (rows.where(F.col("event_type") == k).select("user_id", "t_ms") for k in ("click", "view"))
    return p, q, joins.match_events(p, q, ["user_id"], 86_400_000.0)


@query("""WITH s AS (SELECT count(*) AS n, avg(l_quantity) AS m1, avg(l_discount) AS m2, avg(l_extendedprice) AS my, stddev_pop(l_quantity) AS s1, stddev_pop(l_discount) AS s2, covar_pop(l_quantity, l_discount) AS c12, covar_pop(l_quantity, l_extendedprice) AS c1, covar_pop(l_discount, l_extendedprice) AS c2 FROM lineitem),
z AS (SELECT *, n + 10.0::DOUBLE AS a, n * c12 / (s1 * s2) AS b, n * c1 / s1 AS u, n * c2 / s2 AS v FROM s), w AS (SELECT *, (u * a - v * b) / (a * a - b * b) AS k1, (v * a - u * b) / (a * a - b * b) AS k2 FROM z)
SELECT l_linenumber, round(avg(my + (l_quantity - m1) / s1 * k1 + (l_discount - m2) / s2 * k2), 3)::DOUBLE AS predicted FROM lineitem, w GROUP BY 1""")
def ridge_fit_predict(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    model = stats.fit_ridge(rows, ["l_quantity", "l_discount"], "l_extendedprice", 10.0)
    return rows.groupBy("l_linenumber").agg(r(F.avg(model.predict()), 3).alias("predicted"))


@query("""WITH e AS (SELECT vec_id, label, vec_id % 5 AS fold, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS p FROM embeddings), f AS (SELECT unnest(range(0, 5)) AS k), t AS (SELECT k, e.* FROM e, f WHERE fold <> k),
m AS (SELECT k, p, avg(v) AS m, CASE WHEN stddev_pop(v) > 1e-9 THEN stddev_pop(v) ELSE 1 END AS s FROM t GROUP BY 1, 2), c AS (SELECT k, label, t.p, (avg(v) - any_value(m)) / any_value(s) AS c FROM t JOIN m USING (k, p) GROUP BY 1, 2, 3),
d AS (SELECT e.vec_id, e.label AS truth, c.label, sum(((v - m) / s - c) ** 2) AS d FROM e JOIN m ON e.fold = m.k AND e.p = m.p JOIN c ON c.k = e.fold AND c.p = e.p GROUP BY 1, 2, 3)
SELECT vec_id, truth AS label, label AS predicted FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, label) = 1""")
def nearest_centroid_cv(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"), (F.col("vec_id") % 5).alias("fold"))
    return stats.nearest_centroid_cv(rows, "x", "label", "fold").select("vec_id", "label", "predicted")


def _paired(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey", (F.col("o_orderkey") % 2).alias("side")).agg(F.round(F.avg("o_totalprice"), 6).alias("value"))
    return stats.paired(rows.where("side = 0").drop("side"), rows.where("side = 1").drop("side"), ["o_custkey"], "value")


PAIRED = "WITH v AS (SELECT o_custkey, o_orderkey % 2 AS side, round(avg(o_totalprice), 6)::DOUBLE AS v FROM orders GROUP BY 1, 2), d AS (SELECT a.o_custkey, a.v AS value_a, b.v AS value_b, b.v - a.v AS diff FROM v a JOIN v b ON a.o_custkey = b.o_custkey AND a.side = 0 AND b.side = 1)"


@query(PAIRED + " SELECT o_custkey, value_a, value_b, round(diff, 6)::DOUBLE AS diff FROM d")
def paired_join(spark, sf_dir):
    return rounded(_paired(spark, sf_dir), {"diff": 6})


@query(PAIRED + ", k AS (SELECT round(diff, 6) AS diff, rank() OVER (ORDER BY abs(round(diff, 6))) + (count(*) OVER (PARTITION BY abs(round(diff, 6))) - 1) / 2.0::DOUBLE AS r FROM d WHERE round(diff, 6) <> 0) SELECT coalesce(sum(r) FILTER (diff > 0), 0)::DOUBLE AS w_plus, coalesce(sum(r) FILTER (diff < 0), 0)::DOUBLE AS w_minus, count(*) AS n FROM k")
def wilcoxon_w(spark, sf_dir):
    got = stats.wilcoxon(rounded(_paired(spark, sf_dir), {"diff": 6}))
    return spark.createDataFrame([(float(got["w_plus"]), float(got["w_minus"]), int(got["n"]))], "w_plus double, w_minus double, n long")


@query("""WITH e AS (SELECT l_linenumber, (l_quantity - 25) / 2 AS e FROM lineitem) SELECT l_linenumber, count(*) AS n, round(median(abs(e)), 4)::DOUBLE AS median_abs, round(stddev_samp(e), 4)::DOUBLE AS sd, round(quantile_cont(abs(e), 0.9), 4)::DOUBLE AS p90_abs, round(max(abs(e)), 4)::DOUBLE AS worst_abs, round(avg(e), 4)::DOUBLE AS bias, round(avg((abs(e) <= 5)::INT), 6)::DOUBLE AS within_5 FROM e GROUP BY 1""")
def error_table(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_linenumber", ((F.col("l_quantity") - 25) / 2).alias("e"))
    return rounded(evaluate.error_table(rows, ["l_linenumber"], "e"), {"median_abs": 4, "sd": 4, "p90_abs": 4, "worst_abs": 4, "bias": 4, "within_5": 6})


@query("""WITH s AS (SELECT o_orderpriority AS channel, o_totalprice / 500000 AS f1, o_totalprice % 97 AS mad_ms, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice % 31 - 15 END AS c FROM orders)
SELECT channel, count(*) AS n, round(median(f1), 6)::DOUBLE AS f1_median, round(min(f1), 6)::DOUBLE AS f1_min, round(median(mad_ms), 4)::DOUBLE AS mad_median, round(median(abs(c)), 4)::DOUBLE AS count_err_median FROM s GROUP BY 1""")
def score_summary(spark, sf_dir):
    p = F.col("o_totalprice")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("channel"), (p / 500000).alias("f1"), (p % 97).alias("mad_ms"), F.when(F.col("o_orderkey") % 7 != 0, p % 31 - 15).otherwise(F.lit(float("nan"))).alias("count_err_pct"))
    return rounded(evaluate.summarise(rows, ["channel"]), {"f1_median": 6, "f1_min": 6, "mad_median": 4, "count_err_median": 4})


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def best_rows(spark, sf_dir):
    return evaluate.best_rows(table(spark, sf_dir, "orders"), ["o_custkey"], "o_totalprice", "o_orderkey").select("o_custkey", "o_orderkey")


@query("""WITH d AS (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS s FROM lineitem GROUP BY 1), g AS (SELECT n, var_pop(s / n) AS e2, count(*) AS k FROM d GROUP BY 1) SELECT round(sqrt(greatest(0, regr_intercept(e2, 1.0::DOUBLE / n))), 4)::DOUBLE AS floor, round(sqrt(greatest(0, regr_slope(e2, 1.0::DOUBLE / n))), 4)::DOUBLE AS b FROM g""")
def variance_split(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("s"))
    return rounded(stats.variance_split(d.groupBy("n").agg(F.var_pop(F.col("s") / F.col("n")).alias("e2")), "n", "e2"), {"floor": 4, "b": 4})


@query(EV + """, l AS (SELECT user_id, seq, value, lag(value) OVER (PARTITION BY user_id ORDER BY seq) AS prev FROM ev) SELECT user_id, round(stddev_pop(value), 4)::DOUBLE AS sd_left, round(stddev_pop(coalesce(prev, value)), 4)::DOUBLE AS sd_right, round(avg((value = coalesce(prev, value))::INT), 6)::DOUBLE AS identical, round(corr(value, coalesce(prev, value)), 6)::DOUBLE AS correlation, round(stddev_pop(value - coalesce(prev, value)), 4)::DOUBLE AS sd_diff FROM l GROUP BY 1""")
def channel_report(spark, sf_dir):
    rows = ev(spark, sf_dir).withColumn("right", F.coalesce(F.lag("value").over(in_order(["user_id"], "seq")), F.col("value")))
    return rounded(health.channel_report(rows, ["user_id"], "value", "right"), {"sd_left": 4, "sd_right": 4, "identical": 6, "correlation": 6, "sd_diff": 4})


@query(EV + """, l AS (SELECT user_id, seq, value, coalesce(lag(value, 2) OVER (PARTITION BY user_id ORDER BY seq), value) AS rt FROM ev), k AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM l),
s AS (SELECT k.*, unnest(range(-4, 5)) AS lag FROM k), p AS (SELECT s.user_id, s.lag, round(stddev_pop(s.value - o.rt), 9) AS sd FROM s JOIN k o ON o.user_id = s.user_id AND o.seq = s.seq - s.lag WHERE s.seq > 4 AND s.seq <= s.n - 4 GROUP BY 1, 2)
SELECT user_id, lag::INT AS lag, round(sd, 6)::DOUBLE AS sd FROM p QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY sd, lag) = 1""")
def best_lag(spark, sf_dir):
    rows = ev(spark, sf_dir).withColumn("right", F.coalesce(F.lag("value", 2).over(in_order(["user_id"], "seq")), F.col("value")))
    return rounded(health.best_lag(rows, ["user_id"], "seq", "value", "right"), {"sd": 6}).where("sd is not null")


# ---- sessions, documents of settings


@query("""WITH l AS (SELECT user_id, value, [sin(value), cos(value), sin(value * 2)] AS x FROM events), e AS (SELECT user_id, value, x, list_max(x) AS m FROM l), p AS (SELECT user_id, value, x[3] = m AND x[1] < m AND x[2] < m AS is2, x[2] = m AND x[1] < m AS is1, exp(x[3] - m) / (exp(x[1] - m) + exp(x[2] - m) + exp(x[3] - m)) AS p2 FROM e)
SELECT user_id, count(*) FILTER (is1) AS suck_count, count(*) FILTER (is2 AND p2 >= 0.5) AS swallow_count, round(coalesce(sum(value) FILTER (is2), sum(value)) * 0.5, 4)::DOUBLE AS total_volume_ml FROM p GROUP BY 1""")
def session_rollup(spark, sf_dir):
    v = F.col("value")
    rows = table(spark, sf_dir, "events").select("user_id", "value", F.array(F.sin(v), F.cos(v), F.sin(v * 2)).alias("logits"))
    return rounded(evaluate.session_rollup(rows, ["user_id"], "logits", "value", 0.5), {"total_volume_ml": 4})


@query("""SELECT event_type, count(*) AS n, count(*) FILTER ((props->>'$.k')::INT > 50) AS n_large, count(*) FILTER (json_extract(props, '$.missing') IS NULL) AS n_absent FROM events GROUP BY 1""")
def json_rules(spark, sf_dir):
    from tidewell.sources.sidecars import at, has

    rows = table(spark, sf_dir, "events").select("event_type", F.parse_json("props").alias("doc"))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(at("doc", "k", "int") > 50).alias("n_large"), F.count_if(~has("doc", "missing")).alias("n_absent"))


@query("""WITH w AS (SELECT o_orderkey, o_totalprice AS a, o_totalprice + (o_orderkey % 11) - 5 AS b FROM orders) SELECT o_orderkey, round((greatest(0, b - a) / 1.03)::FLOAT::DOUBLE, 3)::DOUBLE AS volume FROM w""")
def volume_targets(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("a"), (F.col("o_totalprice") + F.col("o_orderkey") % 11 - 5).alias("b"))
    return rounded(evaluate.volume_targets(rows, "a", "b").select("o_orderkey", "volume"), {"volume": 3})


# ---- spectra and detection


def _signal(spark, sf_dir) -> DataFrame:
    grid = _grid(spark, sf_dir, 24 * 1000.0 / DAY).select("user_id", "grid_idx", "t_ms")
    return resample.resample_linear(_once(spark, sf_dir).select("user_id", "seq", "t_ms", "value"), grid, ["user_id"], ["value"], order="seq")


@query()
def detect_cycles(spark, sf_dir):
    from tidewell.operators.detect import Detector, detect_events

    rows = _signal(spark, sf_dir).withColumn("t_ms", F.col("grid_idx") * 50.0)
    return detect_events(rows, ["user_id"], "t_ms", "value", Detector(band_cpm=(20.0, 120.0), grid_hz=20.0))


@query()
def detection_summary(spark, sf_dir):
    from tidewell.operators.detect import Detector, detection_summary

    rows = _signal(spark, sf_dir).withColumn("t_ms", F.col("grid_idx") * 50.0)
    return detection_summary(rows, ["user_id"], "t_ms", "value", Detector(band_cpm=(20.0, 120.0), grid_hz=20.0))


from tidewell.plans import session_queries  # noqa: E402, F401  registers more queries

"""More registered queries over the test tables: session checks, matching, splits, folds, spectra, reports; each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import convert as V
from tidewell.operators import clock, evaluate, features, joins, model, quality, stats
from tidewell.plans import reports
from tidewell.plans.queries import DAY, EV, GRID, LERP, PAIRED, _match, _paired, _signal, ev, query, r, rounded, table

# ---- clocks, units, contracts


@query(EV + """, raw AS (SELECT *, floor(t_ms * 10)::BIGINT % 4294967296 AS raw FROM ev), d AS (SELECT *, CASE WHEN raw - lag(raw) OVER w < -2147483648 THEN 1 ELSE 0 END AS fell FROM raw WINDOW w AS (PARTITION BY user_id ORDER BY seq)),
u AS (SELECT user_id, event_id, raw::DOUBLE + sum(fell) OVER (PARTITION BY user_id ORDER BY seq) * 4294967296.0::DOUBLE AS u FROM d), m AS (SELECT user_id, round_even((5e10::DOUBLE - median(u)) / 4294967296.0::DOUBLE, 0) AS p FROM u GROUP BY 1)
SELECT user_id, event_id, round((1.000025::DOUBLE * (u + p * 4294967296.0::DOUBLE) * 1e-6::DOUBLE + 7.5::DOUBLE - 3.0::DOUBLE) * 1000.0::DOUBLE, 3)::DOUBLE AS t_ms FROM u JOIN m USING (user_id)""")
def device_to_session_time(spark, sf_dir):
    rows = ev(spark, sf_dir).drop("t_ms").join(ev(spark, sf_dir).select("event_id", (F.floor(F.col("t_ms") * 10).cast("long") % 4294967296).alias("raw")), "event_id").withColumn("centre", F.lit(5e10))
    got = clock.align_device(rows, ["user_id"], "seq", "raw", "centre")
    return got.select("user_id", "event_id", r(clock.to_session_ms(F.col("device_us"), F.lit(1.000025), F.lit(7.5), F.lit(3.0)), 3).alias("t_ms"))


@query("""SELECT l_linenumber, round(avg((l_extendedprice * 0.00059820565::DOUBLE)::FLOAT::DOUBLE), 6)::DOUBLE AS acceleration, round(avg((l_quantity * 0.00875::DOUBLE)::FLOAT::DOUBLE), 6)::DOUBLE AS rotation, round(avg((l_quantity * 6.09e-4::DOUBLE)::FLOAT::DOUBLE), 8)::DOUBLE AS pressure FROM lineitem GROUP BY 1""")
def motion_and_sound_units(spark, sf_dir):
    p, q = F.col("l_extendedprice"), F.col("l_quantity")
    mean = lambda x, d: r(F.avg(x.cast("double")), d)
    return table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(mean(V.acceleration(p), 6).alias("acceleration"), mean(V.rotation_rate(q), 6).alias("rotation"), mean(V.pascals(q), 8).alias("pressure"))


@query(EV + """, s AS (SELECT user_id, event_type, t_ms, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY seq) AS n, t_ms - lag(t_ms) OVER (PARTITION BY user_id, event_type ORDER BY seq) AS d FROM ev WHERE event_type IN ('click', 'view')),
g AS (SELECT user_id, event_type AS stream, count(*) AS n, min(t_ms) AS lo, max(t_ms) AS hi, median(d) AS step FROM s GROUP BY 1, 2), u AS (SELECT user_id, stream FROM (SELECT DISTINCT user_id FROM g), (SELECT unnest(['click', 'view']) AS stream)), a AS (SELECT user_id, stream, n, lo, hi, step FROM u LEFT JOIN g USING (user_id, stream)),
sc AS (SELECT user_id, CASE WHEN event_id % 50 <> 0 THEN value END AS v, value - lag(value) OVER w AS dv, CASE WHEN lag(event_id % 50 <> 0) OVER w AND event_id % 50 <> 0 THEN value - lag(value) OVER w END AS d FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY seq)), sg AS (SELECT user_id, count(*) AS n, count(*) FILTER (v IS NULL) AS bad, min(d) AS fall FROM sc GROUP BY 1),
i AS (SELECT user_id, 'error' AS level, stream || ': no channel gone' AS message FROM a WHERE stream = 'view' UNION ALL SELECT user_id, 'error', stream || ': empty' FROM a WHERE n IS NULL
UNION ALL SELECT user_id, 'warning', printf('%s: %.1f Hz instead of %.1f', stream, 1000 / step, 0.00001::DOUBLE) FROM a WHERE step > 0 AND abs(1000 / step / 0.00001::DOUBLE - 1) > 0.25
UNION ALL SELECT user_id, 'error', printf('streams overlap by %.2f s, less than 2000000.0', o) FROM (SELECT user_id, (min(hi) - max(lo)) / 1000 AS o, min(coalesce(n, 0)) AS least FROM a GROUP BY 1) WHERE least > 0 AND NOT o >= 2000000
UNION ALL SELECT user_id, 'error', printf('scale: %d non-finite readings', bad) FROM sg WHERE n >= 2 AND bad > 0 UNION ALL SELECT user_id, 'warning', printf('scale: falls by %.2f g', -fall) FROM sg WHERE n >= 2 AND bad = 0 AND fall < -0.5)
SELECT user_id, level, message FROM i""")
def session_contract(spark, sf_dir):
    rows = ev(spark, sf_dir)
    streams = {k: rows.where(F.col("event_type") == k).select("user_id", "seq", "t_ms", "value") for k in ("click", "view")}
    scale = rows.select("user_id", "seq", F.when(F.col("event_id") % 50 != 0, F.col("value")).alias("scale_g"))
    return quality.session_issues(streams, {"click": ["value"], "view": ["value", "gone"]}, {"click": 1e-5, "view": 1e-5}, scale, "user_id", least_overlap_s=2e6)


@query(EV + """, d AS (SELECT user_id, t_ms - lag(t_ms) OVER (PARTITION BY user_id ORDER BY seq) AS d FROM ev), s AS (SELECT user_id, count(*) AS n, count(*) FILTER (d <= 0) AS flat, count(*) FILTER (d > 259200000) AS gaps FROM d GROUP BY 1)
SELECT user_id, array_to_string(list_filter([CASE WHEN n < 2 THEN 'fewer than two samples' END, CASE WHEN flat > 0 THEN 'time does not rise' END, CASE WHEN gaps > 0 THEN 'dropouts' END], lambda x: x IS NOT NULL), ', ') AS reasons, NOT (n < 2 OR flat > 0 OR gaps > 0) AS ok, n::DOUBLE AS n FROM s""")
def timestamp_report(spark, sf_dir):
    got = quality.check_timestamps(ev(spark, sf_dir), ["user_id"], "seq", "t_ms", 3 * DAY)
    return got.select("user_id", F.array_join("reasons", ", ").alias("reasons"), "ok", F.col("stats")["n"].alias("n"))


@query("""SELECT event_type, array_to_string(list_filter([CASE WHEN avg((value <= -32000 OR value >= 150)::INT) > 0.02 THEN 'value at its rail' END], lambda x: x IS NOT NULL), ', ') AS reasons, NOT avg((value <= -32000 OR value >= 150)::INT) > 0.02 AS ok FROM events GROUP BY 1""")
def saturation_report(spark, sf_dir):
    got = quality.check_saturation(table(spark, sf_dir, "events"), ["event_type"], ["value"], "mic", {"mic": (-32000, 150)})
    return got.select("event_type", F.array_join("reasons", ", ").alias("reasons"), "ok")


# ---- filters and rollups


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (event_id % 100 >= 25) AS n_confident, count(*) FILTER (event_id % 3 = 0) AS n_ok FROM events GROUP BY 1""")
def event_filters(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("confidence", (F.col("event_id") % 100) / 100.0).withColumn("quality", F.when(F.col("event_id") % 3 == 0, " ok ").otherwise("weak"))
    n = lambda df, name: df.groupBy("event_type").agg(F.count(F.lit(1)).alias(name))
    return n(rows, "n").join(n(evaluate.confident(rows, 0.25), "n_confident"), "event_type").join(n(evaluate.quality_ok(rows), "n_ok"), "event_type")


@query("SELECT DISTINCT event_type AS type FROM events WHERE event_type NOT IN ('click', 'view')")
def unknown_types(spark, sf_dir):
    return evaluate.unknown_types(table(spark, sf_dir, "events").withColumnRenamed("event_type", "type"), ["click", "view"])


@query("""WITH i AS (SELECT s_nationkey AS stem, 'f' || (s_suppkey % 3) AS field, max(s_acctbal) > 0 AS w FROM supplier GROUP BY 1, 2) SELECT field, count(*) AS n FROM i WHERE w GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM (SELECT s_nationkey FROM supplier WHERE s_suppkey % 3 = 0 GROUP BY 1 HAVING max(s_acctbal) > 0))""")
def recurring_issues(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").groupBy("s_nationkey", F.concat(F.lit("f"), (F.col("s_suppkey") % 3).cast("string")).alias("field")).agg(F.when(F.max("s_acctbal") > 0, "warning").otherwise("error").alias("level"))
    n = rows.where("field = 'f0' and level = 'warning'").count()
    return evaluate.recurring(rows.withColumnRenamed("s_nationkey", "stem"), n)


@query("""WITH l AS (SELECT l_extendedprice AS c, unnest([{'feature': 'l_discount', 'v': l_discount}, {'feature': 'l_quantity', 'v': l_quantity}, {'feature': 'l_tax', 'v': l_tax}], recursive := true) FROM lineitem),
k AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY feature ORDER BY c) + (count(*) OVER (PARTITION BY feature, c) - 1) / 2.0::DOUBLE AS b FROM l)
SELECT feature, round(corr(a, b), 6)::DOUBLE AS rho, count(*) AS n FROM k GROUP BY 1""")
def condition_correlations(spark, sf_dir):
    return rounded(evaluate.condition_correlations(table(spark, sf_dir, "lineitem"), ["l_discount", "l_quantity", "l_tax"], "l_extendedprice"), {"rho": 6})


@query(EV + " SELECT user_id, round(sum(value) * 0.5::DOUBLE, 4)::DOUBLE AS reconstructed_ml, round((arg_max(value, seq) - arg_min(value, seq)) / 1.03::DOUBLE, 4)::DOUBLE AS measured_ml FROM ev GROUP BY 1")
def volume_check(spark, sf_dir):
    rows = ev(spark, sf_dir)
    got = evaluate.volume_check(rows.withColumnRenamed("value", "volume"), rows.select("user_id", "seq", F.col("value").alias("scale_g")), ["user_id"], 0.5, "seq")
    return rounded(got, {"reconstructed_ml": 4, "measured_ml": 4})


@query("""SELECT o_orderkey, round(o_totalprice / 500000, 9)::DOUBLE AS f1 FROM orders WHERE o_orderkey % 11 <> 0 ORDER BY o_totalprice / 500000, o_orderkey LIMIT 5""")
def worst_scores(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice") / 500000).otherwise(F.lit(float("nan"))).alias("f1"))
    return rounded(evaluate.worst_rows(rows, "f1", 5, ["o_orderkey"]), {"f1": 9})


@query("""WITH s AS (SELECT o_custkey % 20 AS stem, o_orderpriority AS channel, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END AS sign, max(o_totalprice) AS f1 FROM orders GROUP BY 1, 2, 3)
SELECT channel, count(*) FILTER (sign = 1) AS n_up, count(*) FILTER (sign = -1) AS n_down FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY stem, channel ORDER BY f1 DESC, sign) = 1) GROUP BY 1""")
def polarity_by_channel(spark, sf_dir):
    sign = F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(-1).alias("sign")
    scores = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 20).alias("stem"), F.col("o_orderpriority").alias("channel"), sign).agg(F.max("o_totalprice").alias("f1"))
    return reports.polarity_table(scores, ["stem"])


@query(PAIRED + " SELECT count(*) AS n, count(*) FILTER (diff < 0) AS better, count(*) FILTER (diff > 0) AS worse, round(median(diff), 6)::DOUBLE AS median_diff FROM d")
def paired_report(spark, sf_dir):
    return rounded(reports.paired_counts(_paired(spark, sf_dir)), {"median_diff": 6})


@query("""WITH t AS (SELECT l_orderkey % 7 AS k, l_suppkey AS run, l_quantity AS x, l_tax * 100 AS gap, l_extendedprice / 1000 AS flow, ln(greatest(l_extendedprice / 1000, 0) + 1) AS y FROM lineitem), f AS (SELECT DISTINCT k FROM t),
m AS (SELECT f.k, count(*) AS n, avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, covar_pop(x, y) AS c, avg(flow) AS mean FROM f JOIN t ON t.k <> f.k GROUP BY 1), w AS (SELECT *, n * c / sx / (n + 1.0::DOUBLE) AS b FROM m),
a AS (SELECT w.k, avg(exp(y - (my + (x - mx) / sx * b))) AS a FROM w JOIN t ON t.k <> w.k GROUP BY 1), p AS (SELECT t.run, gap, flow, greatest(exp(my + (x - mx) / sx * b) * a - 1, 0) AS ridge, mean FROM t JOIN w USING (k) JOIN a USING (k)),
l AS (SELECT run, gap, flow, 'ridge' AS model, ridge AS v FROM p UNION ALL SELECT run, gap, flow, 'single', ridge FROM p UNION ALL SELECT run, gap, flow, 'mean', mean FROM p), e AS (SELECT model, count(*) AS n, avg(abs(v - flow)) AS mae, avg(v - flow) AS bias FROM l GROUP BY 1),
g AS (SELECT model, run, 100 * (sum(v * gap / 60) - sum(flow * gap / 60)) / nullif(sum(flow * gap / 60), 0) AS e FROM l GROUP BY 1, 2), q AS (SELECT model, count(e) AS n_runs, median(abs(e)) AS median_abs FROM g GROUP BY 1)
SELECT model, n, round(mae, 4)::DOUBLE AS mae, round(bias, 4)::DOUBLE AS bias, n_runs, round(median_abs, 3)::DOUBLE AS median_abs FROM e JOIN q USING (model)""")
def fold_report(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 7).alias("k"), F.col("l_suppkey").alias("run"), "l_quantity", (F.col("l_tax") * 100).alias("gap_s"), (F.col("l_extendedprice") / 1000).alias("flow"))
    got = reports.fold_report(rows, "k", "run", ["l_quantity"])
    out = got["events"].select("model", "n", "mae", "bias").join(got["errors"].select("model", F.col("n").alias("n_runs"), "median_abs"), "model")
    return rounded(out, {"mae": 4, "bias": 4, "median_abs": 3})


# ---- matching


MATCH = EV + """, c AS (SELECT user_id, t_ms, row_number() OVER (PARTITION BY user_id ORDER BY t_ms) - 1 AS i FROM ev WHERE event_type = 'click'), v AS (SELECT user_id, t_ms, row_number() OVER (PARTITION BY user_id ORDER BY t_ms) - 1 AS j FROM ev WHERE event_type = 'view'),
p AS (SELECT c.user_id, i, j, c.t_ms AS pred_t, v.t_ms AS true_t, c.t_ms - v.t_ms AS dt, row_number() OVER (PARTITION BY c.user_id ORDER BY abs(c.t_ms - v.t_ms), i, j) AS k FROM c JOIN v ON c.user_id = v.user_id AND abs(c.t_ms - v.t_ms) <= 86400000.0::DOUBLE),
g AS (SELECT user_id, 0::BIGINT AS k, []::BIGINT[] AS a, []::BIGINT[] AS b FROM (SELECT DISTINCT user_id FROM p) UNION ALL
SELECT g.user_id, p.k, CASE WHEN list_contains(a, i) OR list_contains(b, j) THEN a ELSE list_append(a, i) END, CASE WHEN list_contains(a, i) OR list_contains(b, j) THEN b ELSE list_append(b, j) END FROM g JOIN p ON p.user_id = g.user_id AND p.k = g.k + 1),
last AS (SELECT user_id, a, b FROM g QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1), m AS (SELECT p.user_id, p.i, p.j, pred_t, true_t, dt FROM p JOIN (SELECT user_id, unnest(a) AS i, unnest(b) AS j FROM last) USING (user_id, i, j))"""
MATCH = MATCH.replace("WITH ev", "WITH RECURSIVE ev", 1)


@query(MATCH + " SELECT user_id, i, j, round(pred_t, 3)::DOUBLE AS pred_t, round(true_t, 3)::DOUBLE AS true_t, round(dt, 3)::DOUBLE AS dt FROM m")
def greedy_match(spark, sf_dir):
    return rounded(_match(spark, sf_dir)[2], {"pred_t": 3, "true_t": 3, "dt": 3})


@query(MATCH + """, s AS (SELECT user_id, median(dt) AS c FROM m GROUP BY 1), d AS (SELECT user_id, count(*) AS n, avg(dt) AS bias, median(abs(dt - c)) AS mad, sqrt(avg(dt * dt)) AS rmse FROM m JOIN s USING (user_id) GROUP BY 1),
a AS (SELECT coalesce(x.user_id, y.user_id) AS user_id, coalesce(x.n, 0) AS n_pred, coalesce(y.n, 0) AS n_true FROM (SELECT user_id, count(*) AS n FROM c GROUP BY 1) x FULL JOIN (SELECT user_id, count(*) AS n FROM v GROUP BY 1) y ON x.user_id = y.user_id),
f AS (SELECT a.*, coalesce(n, 0) AS n_matched, coalesce(n / nullif(n_pred, 0), 0) AS pr, coalesce(n / nullif(n_true, 0), 0) AS re, bias, mad, rmse FROM a LEFT JOIN d USING (user_id))
SELECT user_id, n_pred, n_true, n_matched, round(pr, 9)::DOUBLE AS precision, round(re, 9)::DOUBLE AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 9)::DOUBLE AS f1, round(bias, 3)::DOUBLE AS bias, round(mad, 3)::DOUBLE AS mad, round(rmse, 3)::DOUBLE AS rmse, n_pred - n_true AS count_error, round(100.0 * (n_pred - n_true) / nullif(n_true, 0), 6)::DOUBLE AS count_error_pct FROM f""")
def match_scores(spark, sf_dir):
    p, q, m = _match(spark, sf_dir)
    return rounded(evaluate.match_scores(m, p, q, ["user_id"]), {"precision": 9, "recall": 9, "f1": 9, "bias": 3, "mad": 3, "rmse": 3, "count_error_pct": 6})


@query(MATCH + """, d AS (SELECT user_id, j, t_ms - floor(t_ms / 1000) * 1000 AS depth FROM v), k AS (SELECT user_id, j, (rank() OVER (PARTITION BY user_id ORDER BY depth) + (count(*) OVER (PARTITION BY user_id, depth) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY user_id) AS depth_rank FROM d)
SELECT user_id, j, round(depth_rank, 9)::DOUBLE AS depth_rank FROM k ANTI JOIN m USING (user_id, j)""")
def missed_events(spark, sf_dir):
    p, q, m = _match(spark, sf_dir)
    true = joins.numbered(q.withColumn("depth", F.col("t_ms") - F.floor(F.col("t_ms") / 1000) * 1000), ["user_id"], "t_ms", "j")
    return rounded(evaluate.missed_events(true, m, ["user_id"]).select("user_id", "j", "depth_rank"), {"depth_rank": 9})


# ---- splits, folds, resampling


@query("""WITH e AS (SELECT vec_id, label, fold, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS p FROM (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY md5('0:' || vec_id), vec_id) - 1) % 5 AS fold FROM embeddings)), f AS (SELECT unnest(range(0, 5)) AS k), t AS (SELECT k, e.* FROM e, f WHERE fold <> k),
m AS (SELECT k, p, avg(v) AS m, CASE WHEN stddev_pop(v) > 1e-9 THEN stddev_pop(v) ELSE 1 END AS s FROM t GROUP BY 1, 2), c AS (SELECT k, label, t.p, (avg(v) - any_value(m)) / any_value(s) AS c FROM t JOIN m USING (k, p) GROUP BY 1, 2, 3),
d AS (SELECT e.vec_id, e.label AS truth, c.label, sum(((v - m) / s - c) ** 2) AS d FROM e JOIN m ON e.fold = m.k AND e.p = m.p JOIN c ON c.k = e.fold AND c.p = e.p GROUP BY 1, 2, 3), b AS (SELECT truth, label FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, label) = 1),
g AS (SELECT truth, count(*) AS n, count(*) FILTER (truth = label) AS ok FROM b GROUP BY 1), h AS (SELECT sum(ok) / sum(n) AS a, max(n) / sum(n) AS c, sum(n) AS n, count(*) AS k FROM g)
SELECT round(a, 9)::DOUBLE AS accuracy, round(c, 9)::DOUBLE AS chance, n::BIGINT AS n, k AS n_groups, round((a - c) / (1 - c), 9)::DOUBLE AS skill FROM h""")
def confound_probe(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    got = stats.confound_probe(stats.nearest_centroid_cv(stats.stratified_folds(rows, "label", "vec_id", 5), "x", "label", "fold"), "label")
    return rounded(got, {"accuracy": 9, "chance": 9, "skill": 9})


@query("""WITH u AS (SELECT user_id, row_number() OVER (ORDER BY md5('0:' || user_id), user_id) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM events)) SELECT user_id, CASE WHEN k <= greatest(1, round_even(n * 0.2::DOUBLE, 0)) THEN 'val' ELSE 'train' END AS split FROM u""")
def session_split(spark, sf_dir):
    return stats.session_split(table(spark, sf_dir, "events"), "user_id", 0.2)


@query(PAIRED + """, s AS (SELECT list(diff ORDER BY diff) AS v, count(*) AS n FROM d), i AS (SELECT k, n, s.v, unnest(range(1, n + 1)) AS i FROM (SELECT unnest(range(0, 20000)) AS k), s), x0 AS (SELECT k, n, v, (k * 1103515245 + i * 69069 + 12345) % 2147483647 AS x FROM i), x1 AS (SELECT k, n, v, (x * x + x + 7919) % 2147483647 AS x FROM x0),
x2 AS (SELECT k, n, v, (x * x + x + 104729) % 2147483647 AS x FROM x1), x3 AS (SELECT k, n, v, (x * x + x + 1299709) % 2147483647 AS x FROM x2), m AS (SELECT k, median(v[x % n + 1]) AS m FROM x3 GROUP BY 1)
SELECT round(quantile_cont(m, 0.025), 4)::DOUBLE AS lo, round(quantile_cont(m, 0.975), 4)::DOUBLE AS hi FROM m""")
def bootstrap_ci(spark, sf_dir):
    return rounded(stats.bootstrap_median(_paired(spark, sf_dir), "diff", 20000), {"lo": 4, "hi": 4})


# ---- sequences and losses


@query(EV + """, s AS (SELECT user_id, list(CASE WHEN event_id % 4 = 3 THEN -100 ELSE event_id % 4 END ORDER BY seq) AS labels, list(CASE WHEN event_id % 5 <> 0 THEN value ELSE 0 END ORDER BY seq) AS volume, list((event_id % 5 <> 0)::INT ORDER BY seq) AS mask, count(*) AS n FROM ev GROUP BY 1),
b AS (SELECT *, (row_number() OVER (ORDER BY md5(user_id::VARCHAR), user_id) - 1) // 16 AS batch FROM s), l AS (SELECT *, max(n) OVER (PARTITION BY batch) AS longest FROM b)
SELECT batch, user_id, n::INT AS length, array_to_string(list_concat(labels, list_transform(range(longest - n), lambda x: -100)), ',') AS labels, array_to_string(list_concat(mask, list_transform(range(longest - n), lambda x: 0)), ',') AS mask, round(list_sum(volume), 3)::DOUBLE AS volume, longest::INT AS padded FROM l""")
def collate_sessions(spark, sf_dir):
    i = F.col("event_id")
    rows = ev(spark, sf_dir).select("user_id", F.col("seq").alias("window_idx"), F.when(i % 4 != 3, i % 4).alias("label"), F.when(i % 5 != 0, F.col("value")).alias("volume"))
    got = model.collate(rows, 16, "user_id", ())
    total = F.aggregate("volume", F.lit(0.0), lambda a, b: a + b)
    return got.select("batch", "user_id", "length", F.array_join("labels", ",").alias("labels"), F.array_join(F.transform("vol_mask", lambda x: x.cast("int")), ",").alias("mask"), r(total, 3).alias("volume"), F.size("labels").alias("padded"))


@query("""WITH l AS (SELECT [sin(value), cos(value), sin(value * 2)] AS x, CASE WHEN event_id % 4 = 3 THEN -100 ELSE event_id % 4 END AS y, CASE WHEN event_id % 5 <> 0 THEN value END AS v, value * 0.9::DOUBLE AS p FROM events),
e AS (SELECT CASE WHEN y <> -100 THEN ln(list_sum(list_transform(x, lambda t: exp(t)))) - x[y + 1] END AS c, (p - v) ** 2 AS s FROM l) SELECT round(avg(c), 8)::DOUBLE AS classification, round(sum(s) / count(s), 5)::DOUBLE AS volume, round(avg(c) + 0.5::DOUBLE * sum(s) / count(s), 5)::DOUBLE AS combined FROM e""")
def training_losses(spark, sf_dir):
    v, i = F.col("value"), F.col("event_id")
    rows = table(spark, sf_dir, "events").select(F.array(F.sin(v), F.cos(v), F.sin(v * 2)).alias("logits"), F.when(i % 4 == 3, F.lit(-100)).otherwise(i % 4).alias("label"), F.when(i % 5 != 0, v).alias("volume"), (v * 0.9).alias("volume_pred"))
    return rounded(model.losses(rows, weights=(1.0, 0.5)), {"classification": 8, "volume": 5, "combined": 5})


# ---- spectra


@query(GRID.replace("86400000.0::DOUBLE)::BIGINT", "3600000.0::DOUBLE)::BIGINT").replace("grid_idx * 86400000.0::DOUBLE", "grid_idx * 3600000.0::DOUBLE") + ", e1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, t_ms ORDER BY seq) AS k FROM ev) WHERE k = 1), " + LERP + """,
s AS (SELECT user_id, grid_idx AS i, (CASE WHEN ta IS NULL THEN vb WHEN tb IS NULL OR ta = tb THEN va ELSE va + (vb - va) * (t - ta) / (tb - ta) END)::FLOAT::DOUBLE AS x, count(*) OVER (PARTITION BY user_id) AS n FROM a JOIN b USING (user_id, grid_idx)),
z AS (SELECT user_id, i, x, n, least(n, 256)::BIGINT AS w, x - avg(x) OVER (PARTITION BY user_id) AS y FROM s), q AS (SELECT *, w - w // 2 AS step, (n - w // 2) // (w - w // 2) AS k FROM z), p AS (SELECT * FROM (SELECT *, unnest(range(0, k)) AS g FROM q) WHERE i >= g * step AND i < g * step + w),
h AS (SELECT user_id, g, w, i - g * step AS j, (y - avg(y) OVER (PARTITION BY user_id, g)) * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * (i - g * step) / w)) AS y FROM p),
d AS (SELECT user_id, f, any_value(w) AS w, (sum(y * cos(2 * pi() * ((f * j) % w) / w)) ** 2 + sum(y * sin(2 * pi() * ((f * j) % w) / w)) ** 2) AS p FROM (SELECT user_id, g, w, j, y, unnest(range(0, w // 2 + 1)) AS f FROM h) GROUP BY user_id, g, f),
o AS (SELECT user_id, f, f * 24.0::DOUBLE / any_value(w) AS hz, avg(p) * CASE WHEN f = 0 OR 2 * f = any_value(w) THEN 1 ELSE 2 END AS p FROM d GROUP BY 1, 2)
SELECT user_id, round(arg_max(hz, p) FILTER (hz >= 1 AND hz <= 10) * 60, 6)::DOUBLE AS rate_cpm, round(sum(p) FILTER (hz >= 1 AND hz <= 10) / sum(p), 6)::DOUBLE AS in_band FROM o GROUP BY 1""")
def welch_rate(spark, sf_dir):
    from tidewell.operators.detect import rate_by_series

    return rounded(rate_by_series(_signal(spark, sf_dir), ["user_id"], "grid_idx", "value", 24.0, (60.0, 600.0)), {"rate_cpm": 6, "in_band": 6})


BINS = """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), s AS (SELECT vec_id, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS j FROM e),
b AS (SELECT vec_id, f, sum(v * cos(2 * pi() * ((f * j) % 64) / 64)) AS re, sum(v * sin(2 * pi() * ((f * j) % 64) / 64)) AS im, sum((v - m) * cos(2 * pi() * ((f * j) % 64) / 64)) AS cre, sum((v - m) * sin(2 * pi() * ((f * j) % 64) / 64)) AS cim,
sum(v * w * cos(2 * pi() * ((f * j) % 64) / 64)) AS hre, sum(v * w * sin(2 * pi() * ((f * j) % 64) / 64)) AS him FROM (SELECT vec_id, j, v, avg(v) OVER (PARTITION BY vec_id) AS m, 0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * j / 63) AS w, unnest(range(0, 33)) AS f FROM s) GROUP BY 1, 2)"""


@query(BINS + """, h AS (SELECT vec_id, f, sqrt(hre ** 2 + him ** 2) + 1e-8::DOUBLE AS m, re ** 2 + im ** 2 AS p, cre ** 2 + cim ** 2 AS c, ln(sqrt(re ** 2 + im ** 2) + 2e-8::DOUBLE) AS l FROM b), t AS (SELECT vec_id, sum(m) AS m, sum(f * m) / sum(m) AS centre FROM h GROUP BY 1),
k AS (SELECT h.vec_id, f, p, c, l, h.m / t.m AS share, centre, sum(h.m / t.m) OVER (PARTITION BY h.vec_id ORDER BY f) AS reached FROM h JOIN t ON t.vec_id = h.vec_id)
SELECT vec_id, (arg_max(f, c) FILTER (f > 0))::DOUBLE AS dominant, round(any_value(centre), 6)::DOUBLE AS centroid, least(count(*) FILTER (reached < 0.85), 32)::DOUBLE AS rolloff, round(sqrt(sum((f - centre) ** 2 * share)), 6)::DOUBLE AS bandwidth, round((sum(p) FILTER (f >= 1.28::DOUBLE AND f <= 9.6::DOUBLE)) / (sum(p) + 1e-8::DOUBLE), 6)::DOUBLE AS band_ratio,
round(sum(l), 4)::DOUBLE AS c0, round(sum(l * cos(2 * pi() * f / 33)), 4)::DOUBLE AS c1, round(sum(l * cos(2 * pi() * ((12 * f) % 33) / 33)), 4)::DOUBLE AS c12 FROM k GROUP BY 1""")
def spectral_shape(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    got = features.spectral_features(rows, ["vec_id"], "x", 64.0)
    got = got.select("vec_id", "dominant", "centroid", "rolloff", "bandwidth", "band_ratio", *[F.col("cepstrum")[i].alias(f"c{i}") for i in (0, 1, 12)])
    return rounded(got, {"centroid": 6, "bandwidth": 6, "band_ratio": 6, "c0": 4, "c1": 4, "c12": 4})


@query(BINS + """, z AS (SELECT vec_id, v, sign(v - avg(v) OVER (PARTITION BY vec_id)) <> lag(sign(v - m)) OVER (PARTITION BY vec_id ORDER BY j) AS z FROM (SELECT vec_id, j, v, avg(v) OVER (PARTITION BY vec_id) AS m FROM s)), g AS (SELECT vec_id, avg(v * v) AS p, avg(z::INT) AS z FROM z GROUP BY 1),
q AS (SELECT vec_id, sum(re ** 2 + im ** 2) FILTER (f * 62.5::DOUBLE >= 150 AND f * 62.5::DOUBLE <= 1200) / (sum(re ** 2 + im ** 2) + 1e-8::DOUBLE) AS ratio FROM b GROUP BY 1)
SELECT vec_id, round(ln(p + 1e-8::DOUBLE), 6)::DOUBLE AS log_energy, round(sqrt(p), 8)::DOUBLE AS rms, round(z, 8)::DOUBLE AS zcr, round(ratio, 6)::DOUBLE AS band_ratio FROM g JOIN q USING (vec_id)""")
def sound_features(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return rounded(features.sound_features(rows, ["vec_id"], "x", 4000.0).select("vec_id", "log_energy", "rms", "zcr", "band_ratio"), {"log_energy": 6, "rms": 8, "zcr": 8, "band_ratio": 6})


@query(EV + """, m AS (SELECT user_id, seq, t_ms, max(value) OVER (PARTITION BY user_id ORDER BY seq) AS mass FROM ev), t AS (SELECT user_id, max(mass) AS total, max(seq) AS last FROM m GROUP BY 1)
SELECT user_id, coalesce(min(seq) FILTER (mass >= 50), any_value(last)) AS first_at, coalesce(min(seq) FILTER (mass >= total - 20), any_value(last)) AS last_at FROM m JOIN t USING (user_id) GROUP BY 1""")
def time_at_mass(spark, sf_dir):
    return reports.support(ev(spark, sf_dir).select("user_id", F.col("seq").alias("t_s"), F.col("value").alias("grams")), ["user_id"], 50.0, 20.0).select("user_id", F.col("_lo_").alias("first_at"), F.col("_hi_").alias("last_at"))

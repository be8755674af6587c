import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.functions import convert as V
from tidewell.operators import clock, evaluate, features, joins, model, quality, resample, stats, windows
from tidewell.plans import reports
from tidewell.sources.synthetic import generate_sessions
from tidewell.config import Network


def series(spark, times, values, name="x"):
    return spark.createDataFrame([(0, i, float(t), None if v is None else float(v)) for i, (t, v) in enumerate(zip(times, values, strict=True))], f"k int, seq int, t_ms double, {name} double")


def test_conversion_floors_keep_their_sign(spark):
    df = spark.createDataFrame([(0.0,), (-1e-9,), (2.0**22,)], "c double")
    got = [r[0] for r in df.select(V.stretch(F.col("c"))).collect()]
    assert got[0] > 1e8 and got[1] < -1e8 and abs(got[2] - 1500.0) < 1e-3
    assert abs(df.limit(3).select(V.bend(F.lit(2.0**23))).first()[0] - 2.048) < 1e-6
    assert abs(df.select(V.pascals(F.lit(1.0), None, -26.0)).first()[0] - 1 / (10 ** (-26 / 20) * 32768)) < 1e-9


def test_repair_and_its_limit(spark):
    t = [0, 4, 2, 12, 16]
    df = series(spark, t, t)
    assert [r.t_ms for r in clock.repaired(df, ["k"], "seq").orderBy("seq").collect()] == [0, 4, 4, 12, 16]
    with pytest.raises(clock.TimestampError, match="75"):
        clock.repaired(series(spark, [0, 100, 25], [0, 0, 0]), ["k"], "seq")


def test_resampling_a_line_and_its_ends(spark):
    t = np.linspace(0, 1000, 20)
    grid = resample.make_grid(spark.createDataFrame([(0, -100.0, 1100.0)], "k int, t0_ms double, t1_ms double"), 50.0).select("k", "grid_idx", "t_ms")
    got = resample.resample_linear(series(spark, t, 2 * t + 5), grid, ["k"], ["x"], order="seq").toPandas()
    assert np.abs(got.x - (2 * got.t_ms.clip(0, 1000) + 5)).max() < 1e-3
    with pytest.raises(ValueError):
        resample.make_grid(grid, 0)


def test_dropped_samples(spark):
    x = [float(i) for i in range(1, 21)]
    x[5] = 0.0
    got = [r.x for r in resample.fill_gaps(series(spark, range(20), x), ["k"], "seq", "x").orderBy("seq").collect()]
    assert got == [float(i) for i in range(1, 21)]
    assert {r.x for r in resample.fill_gaps(series(spark, range(4), [0, 0, 5, None]), ["k"], "seq", "x").collect()} == {0.0}


def test_envelope_fills_between_bins_and_zeros(spark):
    grid = resample.make_grid(spark.createDataFrame([(0, 0.0, 40.0), (1, 0.0, 40.0)], "k int, t0_ms double, t1_ms double"), 100.0)
    got = resample.envelope(series(spark, [0, 1, 30, 31], [3, 4, 6, 6]), grid.select("k", "grid_idx", "t0_ms"), ["k"], "x", 100.0).orderBy("k", "grid_idx").collect()
    first = np.sqrt(12.5)
    assert np.allclose([r.envelope for r in got[:5]], [first, first + (6 - first) / 3, first + 2 * (6 - first) / 3, 6, 6]) and {r.envelope for r in got[5:]} == {0.0}


def test_window_ends_and_event_conventions(spark):
    df = series(spark, np.arange(30) * 5.0, np.arange(30))
    w = windows.make_windows(df, ["k"], "t_ms", 10, 5).orderBy("window_idx").toPandas()
    assert w.window_idx.tolist() == [0, 1, 2, 3, 4] and (w.t_end_ms - w.t_start_ms == 45).all()
    shape = spark.createDataFrame([(0, 0, 0.0, 45.0), (0, 1, 25.0, 70.0)], "k int, window_idx long, t_start_ms double, t_end_ms double")
    ev = spark.createDataFrame([(0, 0.0, "suck"), (0, 45.0, "swallow"), (0, 30.0, "swallow"), (0, 70.0, "suck")], "k int, t_ms double, type string")
    classes = ("silence", "suck", "swallow")
    assert [r.label for r in evaluate.window_labels(shape, ev, ["k"], classes, 45.0).orderBy("window_idx").collect()] == [1, 2]
    assert [r.n_events for r in evaluate.window_counts(shape, ev, ["k"], 45.0).orderBy("window_idx").collect()] == [3, 3]
    with pytest.raises(ValueError, match="burp"):
        evaluate.window_labels(shape, ev.withColumn("type", F.lit("burp")), ["k"], classes, 45.0)


def test_interval_join_left_keeps_empty_intervals(spark):
    spans = spark.createDataFrame([(0, 0.0, 10.0), (0, 50.0, 60.0), (None, 0.0, 1.0)], "k int, a double, b double")
    points = spark.createDataFrame([(0, 5.0), (0, 10.0)], "k int, t double")
    assert joins.interval_join(points, spans, ["k"], "t", "a", "b", 7.0, how="left").count() == 3
    assert joins.interval_join(points, spans, ["k"], "t", "a", "b", 7.0, closed=True).count() == 2


def test_matching_is_greedy_and_one_to_one(spark):
    rng = np.random.default_rng(0)
    p, q = np.sort(rng.integers(0, 400, 60)), np.sort(rng.integers(0, 400, 60))
    df = lambda x: spark.createDataFrame([(0, float(v)) for v in x], "k int, t_ms double")
    got = sorted((r.i, r.j) for r in joins.match_events(df(p), df(q), ["k"], 6.0).collect())
    want, a, b = [], set(), set()
    for _, i, j in sorted((abs(x - y), i, j) for i, x in enumerate(p) for j, y in enumerate(q) if abs(x - y) <= 6):
        if i not in a and j not in b:
            want.append((i, j))
            a.add(i)
            b.add(j)
    assert got == sorted(want)
    t = np.arange(20) * 60000 / 42 + 1000
    double = np.sort(np.concatenate([t, t + 200]))
    s = evaluate.match_scores(joins.match_events(df(double), df(t), ["k"], 100.0), df(double), df(t), ["k"]).first()
    assert (s.recall, s.precision, s.count_error_pct) == (1.0, 0.5, 100.0)


def test_quality_reports(spark):
    t = np.arange(200) * 1000 / 19.0
    t[100:] += 500
    r = quality.check_timestamps(series(spark, t, t), ["k"], "seq").first()
    assert r.reasons == ["dropouts"] and not r.ok and r.stats["n_dropouts"] == 1
    assert quality.check_timestamps(series(spark, [1], [1]), ["k"], "seq").first().reasons == ["fewer than two samples"]
    assert quality.check_saturation(series(spark, t, t * 1e9), ["k"], ["x"], "strain").first().reasons == ["x at its rail"]
    assert quality.check_saturation(series(spark, t, t), ["k"], ["x"], "unheard of").first().ok


def test_features_in_engine_equal_the_kernel(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((40, 6))
    df = spark.createDataFrame([(0, i, *map(float, r)) for i, r in enumerate(x)], "window_idx int, sample int, a double, b double, c double, d double, e double, f double")
    got = features.series_stats(df, ["window_idx"], "a").first()
    v = features.strain_block(x[:, 0][None, :], 200.0)[0]
    assert np.allclose([got[n] for n in ("mean", "std", "range", "rms", "slope", "p2p", "zcr", "energy")], [*v[:7], v[8]])
    assert np.allclose(list(features.motion_stats(df, ["window_idx"], list("abcdef")).first())[1:], features.motion_block(x.T[None])[0])
    assert features.window_block(rng.standard_normal((3, 16, 40)), rng.standard_normal((3, 2, 64)), 200.0, 8000.0).shape == (3, features.FEATURES) == (3, 130)


def test_ridge_separability_and_rank_tests(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 3)) + 50
    y = 3 + 2 * x[:, 0] - x[:, 1]
    df = spark.createDataFrame([(*map(float, r), 7.0, float(v)) for r, v in zip(x, y, strict=True)], "a double, b double, c double, flat double, y double")
    m = stats.fit_ridge(df, ["a", "b", "c", "flat"], "y", 1e-6)
    s = evaluate.regression_scores(df, m.predict(), F.col("y")).first()
    assert s.r2 > 0.999 and m.coef[3] == 0 and m.n_active == 3
    z = (x - x.mean(0)) / x.std(0)
    want = np.linalg.solve(z.T @ z + 9 * np.eye(3), z.T @ (y - y.mean()))
    assert np.allclose(stats.fit_ridge(df, ["a", "b", "c"], "y", 9.0).coef, want)
    rows = [(i, i % 3, (rng.standard_normal(4) * 0.3 + 3 * (i % 3)).tolist()) for i in range(240)]
    probe = stats.confound_probe(stats.nearest_centroid_cv(stats.stratified_folds(spark.createDataFrame(rows, "id int, g int, x array<double>"), "g", "id", 5), "x", "g", "fold"), "g").first()
    assert probe.accuracy > 0.95 and probe.skill > 0.9
    d = spark.createDataFrame([(1.0,), (-2.0,), (3.0,), (4.0,), (0.0,)], "diff double")
    w = stats.wilcoxon(d)
    assert (w["w"], w["n"], w["p"]) == (2.0, 4, 0.375)
    lo, hi = stats.bootstrap_median(spark.createDataFrame([(float(i),) for i in range(101)], "x double"), "x", 300).first()
    assert 35 < lo < 50 < hi < 65


def test_fill_response_halves(spark):
    f = np.linspace(1, 0, 60)
    df = spark.createDataFrame([(0, i, float(0.5 + 0.5 * v), float(v)) for i, v in enumerate(f)], "k int, seq int, a double, f double")
    r = evaluate.fill_response(df, ["k"], "a", "f").first()
    assert abs(r.pct_change + 50) < 1e-6 and abs(r.rho - 1) < 1e-9
    assert evaluate.split_half(df, ["k"], "seq", "a", "f").count() == 2
    flat = evaluate.fill_response(df.withColumn("f", F.lit(1.0)), ["k"], "a", "f").first()
    assert flat.slope is None and flat.rho is None and abs(flat.intercept - 0.75) < 1e-9


def test_scores_at_their_edges(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "p double, t double")
    assert evaluate.regression_scores(df, F.col("p"), F.col("t")).first().r2 is None
    a = evaluate.volume_agreement(df, F.col("p"), F.col("t")).first()
    assert a.loa_low == a.loa_high == a.bias == -1
    ignored = spark.createDataFrame([(-100,)], "label long")
    assert evaluate.majority_rate(ignored).first()[0] is None
    assert [r.n for r in evaluate.class_balance(ignored, [0, 1]).collect()] == [0, 0]


def test_model_shapes_losses_and_training(spark):
    net = Network(filters=(4, 4), embedding=8, fusion=8, hidden=4, layers=1)
    data = generate_sessions(spark, 2, windows=6, samples=64)
    w = model.init_weights(net)
    got = model.predict(data, w, net=net)
    rows = got.collect()
    assert len(rows) == 12 and {len(r.logits) for r in rows} == {3} and all(r.volume_pred >= 0 for r in rows)
    both = got.join(data.withColumn("window_idx", F.col("window_idx").cast("long")), ["session_id", "window_idx"])
    ls = model.losses(both).first()
    assert ls.classification > 0 and abs(ls.combined - ls.classification - ls.volume) < 1e-9
    assert model.losses(both.withColumn("label", F.lit(-100)).withColumn("volume", F.lit(None).cast("double"))).first().combined == 0
    again = {(r.session_id, r.window_idx): r.label for r in generate_sessions(spark, 2, windows=6, samples=64).collect()}
    assert again == {(r.session_id, r.window_idx): r.label for r in data.collect()}
    small = model.Training(batch_size=2, rate=0.02, epochs_synthetic=4, epochs_finetune=2)
    trained, history = model.pretrain(data, small, net)
    assert len(history) == 4 and history[-1]["loss"] < history[0]["loss"] and not np.allclose(trained["conv0.mean"], 0)
    again, second = model.pretrain(data, small, net)
    assert second == history and all(np.array_equal(trained[k], again[k]) for k in trained)
    bare = data.withColumn("label", F.lit(None).cast("long"))
    tuned, history, labelled = model.finetune(bare, trained, small, net)
    assert not labelled and history[0]["classification"] == 0 and np.allclose(tuned["class.1.b"], trained["class.1.b"]) and not np.allclose(tuned["volume.1.w"], trained["volume.1.w"])
    with pytest.raises(ValueError, match="no sessions"):
        model.pretrain(data.limit(0), small, net)
    with pytest.raises(NotImplementedError):
        model.sequence_labels()
    roll = evaluate.session_rollup(got, ["session_id"], "logits", "volume_pred", 0.5).collect()
    assert len(roll) == 2
    with pytest.raises(ValueError):
        evaluate.session_rollup(got, ["session_id"], "logits", "volume_pred", 0.0)


def test_event_regression_reports(spark):
    rng = np.random.default_rng(0)
    strain, scale, events = [], [], []
    for run in range(8):
        t = np.arange(0, 60, 0.05)
        gain = 1 + run / 4
        strain += [(run, run % 3, float(x), float(100 + gain * np.sin(2 * np.pi * 0.7 * x) + 0.01 * rng.standard_normal()), float(200 + gain * np.cos(2 * np.pi * 0.7 * x))) for x in t]
        scale += [(run, run % 3, float(x), float(gain * x)) for x in np.arange(0, 60, 0.5)]
        events += [(run, run % 3, float(x)) for x in np.arange(1, 59, 1 / 0.7)]
    by = ["run", "level"]
    df = reports.event_features(spark.createDataFrame(strain, "run int, level int, t_s double, a double, b double"), spark.createDataFrame(scale, "run int, level int, t_s double, grams double"), spark.createDataFrame(events, "run int, level int, t_s double"), by, ["a", "b"]).cache()
    assert df.groupBy("run").count().count() == 8
    r = df.where("run = 4").agg(F.avg("flow")).first()[0]
    assert abs(r - 120) < 6
    got = reports.fold_report(df, "run", "run", ["la_a", "la_b", "log_gap"])
    scores = {x.model: x for x in got["events"].collect()}
    assert scores["ridge"].mae < scores["mean"].mae and got["totals"].count() == 24
    curve = reports.learning_curve(df, "run", "level", ["la_a"], sizes=(4, 6, 99), repeats=2)
    assert curve["curve"].count() == 2
    a = got["totals"].where("model = 'ridge'").select("run", F.lit(1).alias("level"), F.col("error_pct").alias("signed_err_pct"))
    b = got["totals"].where("model = 'mean'").select("run", F.lit(1).alias("level"), F.col("error_pct").alias("signed_err_pct"))
    c = reports.compare_sources(a, b, ("run", "level"), draws=50)
    assert c["counts"].first().n == 8 and 0 < c["wilcoxon"]["p"] <= 1


def test_sweep_scores_channels(spark):
    t = np.arange(0, 60000, 20.0)
    x = np.cos(2 * np.pi * 0.7 * t / 1000)
    rng = np.random.default_rng(0)
    rows = [(0, float(a), float(100 * b), float(-100 * b), float(n)) for a, b, n in zip(t, x, rng.standard_normal(len(t)), strict=True)]
    df = spark.createDataFrame(rows, "run int, t_ms double, up double, down double, noise double")
    ref = spark.createDataFrame([(0, float((k + 0.5) / 0.7 * 1000)) for k in range(41)], "run int, t_ms double")
    got = reports.strain_sweep(df, ref, ["run"], ["up", "down", "noise"], 100.0)
    f1 = {(r.channel, r.sign): r.f1 for r in got["scores"].collect()}
    assert f1["up", 1] > 0.95 and f1["down", -1] > 0.95 and f1["up", -1] < 0.2
    assert {r.channel: r.sign for r in got["polarity"].collect()}["down"] == -1
    c = reports.consensus_scores(df, ref, ["run"], ["up", "down"], 100.0, polarity={"up": 1, "down": -1}).collect()
    assert {r.left_out for r in c} == {"none", "up", "down"}
    env = spark.createDataFrame([("r", i, float((1 + 0.8 * np.sin(2 * np.pi * 0.8 * i / 500)) * v)) for i, v in enumerate(rng.standard_normal(60000))], "stem string, seq int, x double")
    rate = reports.acoustic_rates(env, ["stem"], spark.createDataFrame([("r", 48.0)], "stem string, cycle_rate_cpm double"), 500.0)
    assert rate["rates"].first().error < 2.5


def test_network_gradients_are_the_numerical_ones():
    net = Network(channels=3, filters=(4, 3), kernel=3, embedding=4, hand=5, fusion=6, hidden=3, layers=2, classes=3, dropout=0.3)
    rng = np.random.default_rng(0)
    w = {k: v.astype(float) + (rng.random(v.shape) if k.endswith("var") else 0) for k, v in model.init_weights(net, 1).items()}
    frames, hand = rng.standard_normal((5, 3, 9)), rng.standard_normal((5, 5))
    labels, volume = np.array([0, 2, -100, 1, 1]), np.array([0.5, np.nan, 0.2, 0.1, 0.3])
    for seed in (None, 7):
        got = lambda seed=seed: model.session_gradient(w, frames, hand, labels, volume, (0.7, 0.4), net, None if seed is None else np.random.default_rng(seed))
        loss = lambda: 0.7 * (g := got()).classification + 0.4 * g.volume
        grads = got().grads
        for k in (k for k in w if not k.endswith(model.RUNNING)):
            for _ in range(4):
                at = tuple(int(rng.integers(n)) for n in w[k].shape)
                old, w[k][at] = w[k][at], w[k][at] + 1e-6
                up, w[k][at] = loss(), old - 1e-6
                down, w[k][at] = loss(), old
                assert abs((up - down) / 2e-6 - grads[k][at]) < 1e-5 + 1e-4 * abs(grads[k][at]), k


def test_islands_match_like_the_whole(spark):
    rng = np.random.default_rng(3)
    p, q = np.sort(rng.random(60) * 100).round(3), np.sort(rng.random(70) * 100).round(3)
    pairs = sorted((abs(a - b), i, j) for i, a in enumerate(p) for j, b in enumerate(q) if abs(a - b) <= 1.5)
    want, seen_i, seen_j = set(), set(), set()
    for _, i, j in pairs:
        if i not in seen_i and j not in seen_j:
            want.add((i, j))
            seen_i.add(i)
            seen_j.add(j)
    frame = lambda x: spark.createDataFrame([(1, float(v)) for v in x], "k int, t_ms double")
    assert {(r.i, r.j) for r in joins.match_events(frame(p), frame(q), ["k"], 1.5).collect()} == want


def test_signed_ranks_do_not_depend_on_ranges(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(-9, 10, 400) / 2, rng.standard_normal(300).round(2)])
    a = np.abs(x[x != 0])
    rank = np.asarray([(a < v).sum() + ((a == v).sum() + 1) / 2 for v in a])
    got = stats.wilcoxon(spark.createDataFrame([(float(v),) for v in x], "diff double"))
    assert got["w_plus"] == rank[x[x != 0] > 0].sum() and got["w_minus"] == rank[x[x != 0] < 0].sum() and got["n"] == len(a)
    assert stats.wilcoxon(spark.createDataFrame([], "diff double"))["n"] == 0


def test_numbers_in_issues_are_rounded_on_their_exact_value(spark):
    ends = [1903805805.0, 1473523095.0, 125.0, 375.0]
    streams = {k: spark.createDataFrame([(i, n, t) for i, end in enumerate(ends) for n, t in enumerate((0.0, end))], "session_id int, seq int, t_ms double") for k in ("a", "b")}
    got = quality.session_issues(streams, {"a": [], "b": []}, {"a": 1.0, "b": 1.0}, least_overlap_s=2e6)
    overlaps = {r.session_id: r.message for r in got.where("message like 'streams%'").collect()}
    assert overlaps == {i: f"streams overlap by {end / 1000:.2f} s, less than 2000000.0" for i, end in enumerate(ends)}


def test_crossings_do_not_depend_on_how_the_mean_was_summed(spark):
    windows = [  # one value of each is the mean
        ([10.08, 6.98, 5.64, 19.13, 21.14, 52.4, 17.24, 15.36, 3.83, 1.8], 3 / 9),
        ([9.97, 48.25, 0.54, 20.7, 65.19, 62.33, 22.86, 31.26, 10.81, 40.69], 7 / 9),
        ([23.15, 13.99, 2.61, 62.72, 47.3, 1.32, 27.89, 5.83, 1.4, 286.79], 4 / 9),
        ([4.69, 169.84, 65.41, 36.83, 91.75, 118.89, 127.59, 87.49, 134.81, 80.2], 7 / 9),
    ]
    for turn in range(3):
        rows = [(i, n, x) for i, (w, _) in enumerate(windows) for n, x in enumerate(w)]
        rows = rows[::-1] if turn == 1 else sorted(rows, key=lambda r: r[2]) if turn == 2 else rows
        got = features.series_stats(spark.createDataFrame(rows, "window_idx int, sample int, a double").coalesce(1), ["window_idx"], "a")
        assert {r.window_idx: round(r.zcr, 9) for r in got.collect()} == {i: round(z, 9) for i, (_, z) in enumerate(windows)}
    assert np.allclose(features.strain_block(np.array([w for w, _ in windows]), 10.0)[:, 6], [z for _, z in windows])


def test_draws_are_of_all_rows_and_their_middles_exact(spark):
    from itertools import islice

    def place(k, i, n):
        x = (k * 1103515245 + i * 69069 + 3 * 40503 + 12345) % 2147483647
        for add in (7919, 104729, 1299709):
            x = (x * x + x + add) % 2147483647
        return x % n

    picks = lambda k, n: np.sort(np.concatenate(list(stats.places(k, n, 3))))
    assert all(picks(k, n).tolist() == sorted(place(k, i, n) for i in range(1, n + 1)) for k in (0, 7, 19_999) for n in (40, 40_000))
    for n in (1, 2, 3, 40_001, 100_002):
        for k in (0, 19_999):
            p = picks(k, n)
            assert stats.middle_places(k, n, 3) == (p[(n - 1) // 2] + 1, p[n // 2] + 1)
    assert next(islice(stats.places(0, 1 << 40, 3), 1)).max() < stats.PRIME
    n, draws = 100_002, 40
    rows = spark.range(n).select(F.floor(F.col("id") / 3).cast("double").alias("x"))
    mid = [np.median(picks(k, n) // 3) for k in range(draws)]
    assert np.allclose(stats.bootstrap_median(rows, "x", draws, seed=3).first(), np.quantile(mid, [0.025, 0.975]))
    assert tuple(stats.bootstrap_median(rows.where("x < 0"), "x", draws).first()) == (None, None)


def test_a_middle_far_from_the_rows_middle_is_found(monkeypatch):
    uneven = lambda draw, n, seed: iter(np.array_split((np.arange(n) // 10).astype(np.uint32), 7))
    monkeypatch.setattr(stats, "places", uneven)
    n = 200_000
    assert stats.middle_places(0, n, 0) == ((n // 2 - 1) // 10 + 1, n // 2 // 10 + 1)

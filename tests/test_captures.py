import json
import os

import numpy as np
import pandas as pd
import pytest

from tidewell.config import Pipeline, Sensors
from tidewell.operators.quality import ContractError
from tidewell.plans import reports
from tidewell.plans.process import process_session
from tidewell.sources import captures as C
from tidewell.sources import sidecars
from tidewell.sources.synthetic import write_session

WRAP = 2**32


def write_rig(root, stem="run", seconds=30.0, rig=True, device_t0=500.0, skews=(25.0, -35.0), resolved=True):
    """A capture whose clocks are known: host = (1 + skew) * device + offset, counters of 32 bits of microseconds."""
    os.makedirs(root, exist_ok=True)
    host0 = 1000.0
    boards = {"sensor": skews[0]} | ({"rig": skews[1]} if rig else {})
    us = lambda host, skew: np.mod(np.round(((np.asarray(host) - host0) / (1 + skew * 1e-6) + device_t0) * 1e6), WRAP).astype(np.int64)
    put = lambda name, **cols: pd.DataFrame(cols).to_csv(f"{root}/{stem}_{name}.csv", index=False)
    time = lambda hz: host0 + np.arange(int(seconds * hz)) / hz
    for b, skew in boards.items():
        t = time(1)
        put(f"{b}_sync", host_mono_s=t, device_ts_us=us(t, skew))
    t = time(80)
    wave = np.cos(2 * np.pi * 0.7 * (t - host0))
    names = ["Radial_N", "Radial_E", "Radial_S", "Radial_W", "Arc_Inner_E", "Arc_Outer_E", "Arc_Inner_W", "Arc_Outer_W"]
    put("sensor_strain", scan_t_us=us(t, skews[0]), **{f"ch{i}_{n}": 2_000_000 + 500_000 * wave + i for i, n in enumerate(names)})
    t = time(416)
    put("sensor_imu", time_us=us(t, skews[0]), **{c: np.sin(t) + 1 for c in ("ax_ms2", "ay_ms2", "az_ms2", "gx_dps", "gy_dps", "gz_dps")})
    t = time(2000)
    put("sensor_audio", time_us=us(t, skews[0]), block_idx=0, left=(1000 * np.sin(t * 300)).astype(int), right=9999)
    t = time(10)
    put("sensor_scale", host_mono_s=t, grams=np.linspace(0, 103, len(t)))
    info = lambda s: {"skew_ppm": s, "skew_se_ppm": 2.0, "skew_confidence": "resolved" if resolved else "weak", "skew_applied": s, "jitter_ms": 0.5}
    session = {"session": stem, "schema": 2, "alignment": {b: info(s) for b, s in boards.items()}}
    sensor = {"run": {"cycle_rate_cpm": 42.0, "vacuum_level": 3} if rig else {}, "conversion": {"strain": {"a": 1}}, "files": {"strain": f"{stem}_sensor_strain.csv", "gone": "nowhere.csv"}}
    docs = {"session": session, "sensor": sensor}
    if rig:
        t = time(180)
        psi = -np.cos(2 * np.pi * 0.7 * (t - host0)) - 0.5
        put("rig_pressure", time_us=us(t, skews[1]), p_raw=(psi + 15) * (15099494 - 1677722) / 30 + 1677722)
        put("rig_temp", time_us=us(time(1), skews[1]), tmp117_raw=2936)
        docs["rig"] = {"conversion": {"rig": {"pressure": {"out_min_counts": 1677722, "out_max_counts": 15099494, "p_min_psi": -15, "p_max_psi": 15}, "tmp117": {"c_per_count": 0.0078125}}}, "files": {}}
    for d, doc in docs.items():
        with open(f"{root}/{stem}_{d}.json", "w") as f:
            json.dump(doc, f)
    return str(root)


def test_rig_clocks_pressure_and_rollover(spark, tmp_path):
    for t0, wraps in ((500.0, 0), (WRAP / 1e6 - 12, 1)):
        root = write_rig(tmp_path / f"w{wraps}", device_t0=t0)
        cap = C.open_capture(spark, root)
        for board, skew in (("sensor", 25.0), ("rig", -35.0)):
            c = cap.clocks[board]
            assert c["wraps"] == wraps and abs(c["slope"] - 1 - skew * 1e-6) < 1e-9 and c["residual_ms"] < 1 and not c["suspicious"]
        assert cap.t0_host_s == 1000.0 and cap.layout == C.RIG and cap.vacuum_level == 3
        x = C.load_pressure(spark, cap).toPandas().sort_values("t_ms")
        assert abs(x.t_ms.iloc[0]) < 0.01 and abs(x.t_ms.iloc[-1] - (30 - 1 / 180) * 1000) < 0.01
        assert np.abs(x.psi - (-np.cos(2 * np.pi * 0.7 * x.t_ms / 1000) - 0.5)).max() < 1e-3
    assert abs(C.load_temperature(spark, cap).first()["celsius"] - 22.9375) < 1e-6
    got = reports.derive_events(spark, root).first()
    assert got.error is None and abs(got.n_events - 21) <= 2 and abs(got.rate_cpm - 42) < 1.5
    assert {r.n_wraps for r in reports.wrap_scan(spark, root)["report"].collect()} == {1}


def test_live_capture(spark, tmp_path):
    root = write_rig(tmp_path, rig=False)
    cap = C.open_capture(spark, root)
    assert cap.layout == C.LIVE == C.detect_layout(spark, root)
    with pytest.raises(C.MissingRigBoard):
        C.load_pressure(spark, cap)


def test_stems_skew_and_fallback(spark, tmp_path):
    root = write_rig(tmp_path, "a")
    write_rig(tmp_path, "b", skews=(-99.0, -35.0), resolved=False)
    with pytest.raises(ValueError, match="name one of"):
        C.open_capture(spark, root)
    assert abs(C.open_capture(spark, root, "b").clocks["sensor"]["skew_ppm"] - 25) < 1e-9
    with pytest.raises(ValueError, match="strict"):
        C.open_capture(spark, root, "b", C.STRICT)
    issues = {(r.stem, r.level, r.field) for r in sidecars.validate_dataset(spark, root).collect()}
    assert ("a", "error", "files.gone") in issues and ("b", "warning", "alignment.sensor.skew_confidence") in issues
    assert ("a", "warning", "alignment.sensor.skew_confidence") not in issues and ("a", "warning", "fill") in issues
    frozen = {(r.level, r.field) for r in sidecars.validate_dataset(spark, root, True).collect()}
    assert ("error", "fill") in frozen


def test_flat_session_end_to_end(spark, tmp_path):
    folder = write_session(str(tmp_path / "s"), seconds=12)
    s, p = Sensors(), Pipeline()
    done = process_session(C.load_session(spark, folder), C.load_events(spark, folder), s, p)
    rows = done.windows.toPandas().sort_values("window_idx")
    assert len(rows) == 10 and (rows.t_end_ms - rows.t_start_ms - 1995).abs().max() < 1e-6
    assert set(rows.label) <= {0, 1, 2} and {len(h) for h in rows.hand} == {130}
    assert {(len(f), len(f[0])) for f in rows.frames} == {(16, 400)}
    assert all(np.isfinite(np.asarray(h, float)).all() for h in rows.hand)
    gain = rows.volume.sum() * done.correction
    assert abs(gain - 10.0) < 2.0
    # the features inside the engine agree with the vector
    assert np.abs(np.asarray(rows.frames.iloc[0][9], float)).max() == 0
    done.release()


def test_rig_session_becomes_windows(spark, tmp_path):
    session = C.load_session(spark, write_rig(tmp_path, seconds=10))
    assert session.unit_of("imu") == C.PHYSICAL and session.unit_of("strain") == C.COUNTS
    done = process_session(session, native_sound=False)
    assert done.windows.count() == 8 and done.windows.where("label is not null").count() == 0


def test_contract_lists_all_errors(spark, tmp_path):
    folder = write_session(str(tmp_path), seconds=2)
    with pytest.raises(ContractError, match="overlap"):
        process_session(C.load_session(spark, folder))
    with pytest.raises(FileNotFoundError):
        C.detect_layout(spark, str(tmp_path / "none"))
    pd.DataFrame({"t_ms": [1.0]}).to_csv(tmp_path / "imu.csv", index=False)
    with pytest.raises(ValueError, match="acc_x"):
        C.load_session(spark, folder)


def test_events_files(spark, tmp_path):
    folder = str(tmp_path)
    assert C.load_events(spark, folder) is None
    pd.DataFrame({"t_ms": [2.0, 1.0], "type": ["suck", "swallow"]}).to_csv(tmp_path / "events.csv", index=False)
    assert [r.t_ms for r in C.load_events(spark, folder, "x").collect()] == [1.0, 2.0]
    pd.DataFrame({"t_ms": ["a", 1.0], "type": ["suck", "suck"]}).to_csv(tmp_path / "x_events.csv", index=False)
    with pytest.raises(ValueError, match="finite"):
        C.load_events(spark, folder, "x")
    C.write_events(spark.createDataFrame([(1.0, "suck")], "t_ms double, type string"), f"{folder}/out", {"detector": "d"})
    assert "_SUCCESS" in C.names(spark, f"{folder}/out/events.csv")
    with pytest.raises(NotImplementedError):
        C.export_edge()


def test_all_sessions_go_through_one_plan(spark, tmp_path):
    for name, t0 in (("a", 500.0), ("b", WRAP / 1e6 - 4)):
        write_rig(tmp_path / "rig", name, seconds=9, device_t0=t0)
    caps = C.open_captures(spark, str(tmp_path / "rig"))
    assert {(r.session_id, r.board): r.wraps for r in caps.fits.collect()} == {("a", "sensor"): 0, ("a", "rig"): 0, ("b", "sensor"): 1, ("b", "rig"): 1}
    session = C.load_captures(caps)
    done = process_session(session, native_sound=False)
    rows = done.windows.select("session_id", "window_idx", "volume", "t_start_ms").toPandas()
    assert rows.groupby("session_id").size().to_dict() == {"a": 7, "b": 7}
    one = process_session(C.load_rig(spark, str(tmp_path / "rig"), "b"), native_sound=False).windows.select("window_idx", "volume").toPandas().sort_values("window_idx")
    assert np.allclose(rows[rows.session_id == "b"].sort_values("window_idx").volume, one.volume, atol=1e-4)
    assert session.repairs.count() == 0 and {r.stream for r in session.measured.collect()} == {"strain", "imu", "mic"}
    got = {r.stem: r for r in reports.derive_events(spark, str(tmp_path / "rig"), out=str(tmp_path / "out")).collect()}
    assert set(got) == {"a", "b"} and all(r.error is None and abs(r.n_events - 6) <= 2 for r in got.values())
    pinned = {r.stem: json.loads(r.value) for r in spark.read.text(str(tmp_path / "out/events_detector")).collect()}
    assert abs(pinned["b"]["resolved"]["estimated_rate_cpm"] - 42) < 12 and pinned["a"]["n_events"] == got["a"].n_events
    written = spark.read.option("header", True).csv(str(tmp_path / "out/events"))
    assert {"t_ms", "type", "amplitude_psi", "confidence", "stem"} == set(written.columns) and written.where("amplitude_psi is null").count() == 0


def test_flat_folders_and_broken_sessions(spark, tmp_path):
    for name, seconds in (("x", 8), ("y", 7), ("short", 3)):
        write_session(str(tmp_path / name), seconds=seconds, seed=len(name))
    root = str(tmp_path)
    session, events = C.load_sessions(spark, root), C.load_all_events(spark, root)
    with pytest.raises(ContractError, match="short: streams overlap"):
        process_session(session, events)
    done = process_session(session, events, strict=False, native_sound=False)
    assert {r["session_id"]: r["count"] for r in done.windows.groupBy("session_id").count().collect()} == {"x": 6, "y": 5}
    assert {r.session_id for r in done.issues.where("level = 'error'").collect()} == {"short"}
    done.release()


def test_epoch_is_the_middle_of_the_sync_range(spark, tmp_path):
    # sync points crowd at the beginning, so their median lies far from the middle
    root = write_rig(tmp_path, seconds=30)
    t = 1000.0 + np.concatenate([np.linspace(0, 1, 40), [29.0]])
    us = np.mod(np.round(((t - 1000) / (1 + 25e-6) + 500) * 1e6), WRAP).astype(np.int64)
    pd.DataFrame({"host_mono_s": t, "device_ts_us": us}).to_csv(f"{root}/run_sensor_sync.csv", index=False)
    c = C.open_capture(spark, root).clocks["sensor"]
    assert c["centre_us"] == (c["device_lo_us"] + c["device_hi_us"]) / 2
    pd.DataFrame({"host_mono_s": t[:1].repeat(2), "device_ts_us": us[:1].repeat(2)}).to_csv(f"{root}/run_sensor_sync.csv", index=False)
    assert C.open_capture(spark, root).clocks["sensor"]["centre_us"] is None


def test_scale_readings_are_checked_from_two_on(spark, tmp_path):
    folder = write_session(str(tmp_path / "s"), seconds=6)
    scale = pd.read_csv(f"{folder}/scale.csv")
    scale.iloc[:1].to_csv(f"{folder}/scale.csv", index=False)
    process_session(C.load_session(spark, folder), native_sound=False).release()
    scale.scale_g = scale.scale_g.astype(object)
    scale.loc[3, "scale_g"] = "broken"
    scale.to_csv(f"{folder}/scale.csv", index=False)
    with pytest.raises(ContractError, match="non-finite readings"):
        process_session(C.load_session(spark, folder))


def test_events_keep_their_amplitude(spark, tmp_path):
    folder = str(tmp_path / "f")
    os.makedirs(folder)
    events = spark.createDataFrame([(1.0, "suck", 2.5, 0.5)], "t_ms double, type string, amplitude_psi float, confidence float")
    C.write_events(events, folder, {"detector": "d"})
    got = C.load_events(spark, folder).first()
    assert (got.t_ms, got.type, got.amplitude_psi, got.confidence, got.session_id) == (1.0, "suck", 2.5, 0.5, "f")

import numpy as np
import pytest

from tidewell.operators import detect as D
from tidewell.operators import kernels as K
from tidewell.operators.windows import ema


def pump(cpm=42.0, harmonic=0.0, seconds=120, fs=180, noise=0.01):
    t = np.arange(int(seconds * fs)) / fs
    p = 2 * np.pi * cpm / 60 * t
    return t * 1000, -np.cos(p) - harmonic * np.cos(2 * p) - 0.5 + noise * np.random.default_rng(0).standard_normal(len(t))


@pytest.mark.parametrize("harmonic,spread", [(0.0, 2), (0.6, 3)])
def test_pump_cycles(harmonic, spread):
    f = D.detect(*pump(harmonic=harmonic))
    assert abs(len(f.t_ms) - 84) <= spread and abs(f.rate_cpm - 42) <= 1.5 and f.rate_cv < 0.1
    assert f.amplitude.dtype == np.float32 and ((f.confidence >= 0) & (f.confidence <= 1)).all()


def test_fast_pump_and_refusals():
    assert abs(D.detect(*pump(110), D.Detector(band_cpm=(60, 180))).rate_cpm - 110) <= 3
    with pytest.raises(ValueError, match="too short"):
        D.detect(*pump(seconds=3))
    with pytest.raises(ValueError, match="zero variance"):
        D.detect(np.arange(0, 60000, 10.0), np.zeros(6000))
    for bad in ({"band_cpm": (50, 20)}, {"convention": "middle"}, {"band_fraction": 2}):
        with pytest.raises(ValueError):
            D.Detector(**bad)


def test_onsets_come_before_troughs():
    a, b = D.detect(*pump()), D.detect(*pump(), D.Detector(convention=D.ONSET))
    assert (b.t_ms <= a.t_ms).all() and 200 < np.median(a.t_ms - b.t_ms) < 600


def test_welch_finds_power_and_line():
    x = np.random.default_rng(1).standard_normal(8192)
    f, p = K.welch(x, 100, 512)
    assert abs(p.sum() * (f[1] - f[0]) - x.var()) < 0.05
    assert abs(K.cycle_rate(np.sin(2 * np.pi * 0.7 * np.arange(12000) / 100), 100, (20, 120)) - 42) <= 4.5


def test_bandpass_edges_and_zero_phase():
    s = K.butter_bandpass(2, 0.01, 0.05)
    w = np.exp(-1j * np.pi * np.array([0.01, np.sqrt(0.01 * 0.05), 0.05, 0.0]))
    h = np.abs(np.prod([(a[0] + a[1] * w + a[2] * w**2) / (a[3] + a[4] * w + a[5] * w**2) for a in s], axis=0))
    assert np.allclose(h[[0, 2]], np.sqrt(0.5), atol=1e-9) and h[1] > 0.99 and h[3] < 1e-9
    t = np.arange(4000)
    x = np.sin(np.pi * 0.0224 * t)
    assert np.abs(K.zero_phase(s, x)[500:-500] - x[500:-500]).max() < 0.02


def test_peaks():
    x = np.array([0, 1, 0, 2, 2, 2, 0, 3, 0, 0.5, 0.0])
    at, high = K.find_peaks(x)
    assert at.tolist() == [1, 4, 7, 9] and high.tolist() == [1, 2, 3, 0.5]
    assert K.find_peaks(x, distance=4)[0].tolist() == [1, 7] or K.find_peaks(x, distance=4)[0].tolist() == [7]
    assert K.find_peaks(x, prominence=1.5)[0].tolist() == [4, 7]


def test_consensus_ignores_dead_and_flips():
    t = np.arange(6000) / 50
    cycle = np.cos(2 * np.pi * 0.7 * t)
    names = list(D.POLARITY)
    block = np.stack([100 * (s or 0) * cycle + np.random.default_rng(i).standard_normal(len(t)) for i, s in enumerate(D.POLARITY.values())], axis=1)
    f = D.consensus_events(t * 1000, block, names)
    assert abs(len(f.t_ms) - 84) <= 2 and abs(f.rate_cpm - 42) < 1
    with pytest.raises(ValueError, match="known polarity"):
        D.consensus(block, 50, ["x"] * 8)
    assert D.polarities(t * 1000, cycle)[0][0] in (1, -1)
    whole = D.strain_candidates(t * 1000, block)
    assert {s for s, _ in whole} == {1, -1} and abs(D.strain_baseline(t * 1000, block).rate_cpm - 42) < 1
    with pytest.raises(ValueError, match="do not rise"):
        D.strain_candidates(np.zeros(len(t)), block)
    assert D.most_rhythmic(block, 50, (20, 120)) != names.index("Arc_2_out")


def test_ema_is_the_recurrence():
    x = np.random.default_rng(0).standard_normal(40000) * 10 + 3
    for alpha in (0.001, 0.5, 0.97):
        y, want = 2.0, []
        for v in x:
            y = alpha * v + (1 - alpha) * y
            want.append(y)
        assert np.abs(ema(x, alpha, 2.0) - want).max() < 1e-9


def test_strain_and_sound_band_leaves_out_fast_harmonics():
    t = np.arange(12000) / 100
    x = np.sin(2 * np.pi * 42 / 60 * t) + 1.5 * np.sin(2 * np.pi * 100 / 60 * t)
    assert abs(D.strain_rate(x[:, None], 100) - 42) < 4 and abs(D.acoustic_rate(x, 100) - 42) < 4
    assert abs(D.strain_rate(x[:, None], 100, (20.0, 120.0)) - 100) < 4


def test_params_are_pinned_with_what_they_came_to():
    f = D.detect(*pump())
    got = f.params["resolved"]
    assert f.params["detector"] == D.NAME and f.params["config"]["band_cpm"] == [20.0, 120.0]
    assert abs(got["estimated_rate_cpm"] - 42) < 4 and got["bandpass_hz"][0] < 0.7 < got["bandpass_hz"][1] and got["prominence_psi"] > 0 and got["noise_sigma_psi"] > 0


def test_prominence_against_its_definition():
    rng = np.random.default_rng(3)
    for _ in range(400):
        x = rng.integers(0, rng.integers(2, 9), rng.integers(3, 40)).astype(float)
        at, high = K.spaced_peaks(x, int(rng.integers(1, 6)))
        for p, h in zip(at.tolist(), high.tolist(), strict=True):
            left = [i for i in range(p) if x[i] > x[p]]
            right = [i for i in range(p, len(x)) if x[i] > x[p]]
            low = max(x[left[-1] + 1 if left else 0 : p + 1].min(), x[p : right[0] if right else len(x)].min())
            assert h == x[p] - low


def test_filter_by_strides_is_the_recurrence():
    rng = np.random.default_rng(4)
    sections = K.butter_bandpass(2, 0.007, 0.02)
    for n in (40, 127, 128, 129, 1000):
        x = rng.standard_normal(n).cumsum()
        y, level = x, x[0]
        for b0, b1, b2, _, a1, a2 in sections.tolist():
            gain = (b0 + b1 + b2) / (1 + a1 + a2)
            s1, s2, out = level * (gain - b0), level * (b2 - a2 * gain), []
            for v in y:
                out.append(b0 * v + s1)
                s1, s2 = b1 * v - a1 * out[-1] + s2, b2 * v - a2 * out[-1]
            y, level = np.asarray(out), level * gain
        assert np.abs(K._cascade(sections, x) - y).max() < 1e-9

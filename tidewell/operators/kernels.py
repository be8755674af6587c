"""Signal kernels in numpy, from their public definitions: spectra, band-pass filtering, peaks, spectral features."""

from __future__ import annotations

import numpy as np


def welch(x: np.ndarray, fs: float, nperseg: int) -> tuple[np.ndarray, np.ndarray]:
    """One-sided power density: segments of nperseg, half overlapping, each less its mean under a periodic Hann window."""
    x = np.asarray(x, np.float64)
    step = nperseg - nperseg // 2
    count = (len(x) - nperseg // 2) // step
    if nperseg < 1 or count < 1:
        raise ValueError(f"{len(x)} samples hold no segment of {nperseg}")
    pieces = np.lib.stride_tricks.sliding_window_view(x, nperseg)[::step][:count]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(nperseg) / nperseg)
    power = np.abs(np.fft.rfft((pieces - pieces.mean(axis=1, keepdims=True)) * window, axis=1)) ** 2
    power /= fs * (window * window).sum()
    inner = slice(1, None if nperseg % 2 else -1)
    power[:, inner] *= 2
    return np.fft.rfftfreq(nperseg, 1 / fs), power.mean(axis=0)


def segment_length(n: int, fs: float, low_hz: float) -> int:
    return int(min(n, max(256, fs / low_hz * 4)))


def cycle_rate(x: np.ndarray, fs: float, band: tuple[float, float]) -> float:
    """Cycles a minute where the spectrum inside the band (a minute, ends in) is largest."""
    f, p = welch(x, fs, segment_length(len(x), fs, band[0] / 60))
    inside = np.flatnonzero((f >= band[0] / 60) & (f <= band[1] / 60))
    if not len(inside):
        raise ValueError(f"no spectral bin between {band[0]} and {band[1]} cycles a minute")
    return float(f[inside[np.argmax(p[inside])]] * 60)


def band_fraction(block: np.ndarray, fs: float, band: tuple[float, float]) -> np.ndarray:
    """Of each column: power inside the band over all power, 0 without power."""
    out = np.zeros(block.shape[1])
    for c in range(block.shape[1]):
        f, p = welch(block[:, c], fs, segment_length(len(block), fs, band[0] / 60))
        total = p.sum()
        out[c] = p[(f >= band[0] / 60) & (f <= band[1] / 60)].sum() / total if total > 0 else 0.0
    return out


def butter_bandpass(order: int, low: float, high: float) -> np.ndarray:
    """Butterworth band-pass as biquads (b0 b1 b2 1 a1 a2); edges as shares of the Nyquist rate."""
    m = np.arange(1 - order, order, 2)
    prototype = -np.exp(1j * np.pi * m / (2 * order))
    warped = 4 * np.tan(np.pi * np.array([low, high]) / 2)
    width, centre = warped[1] - warped[0], np.sqrt(warped[0] * warped[1])
    half = prototype * width / 2
    root = np.sqrt(half**2 - centre**2)
    analog = np.concatenate([half + root, half - root])
    digital = (4 + analog) / (4 - analog)
    gain = width**order * np.real(4.0**order / np.prod(4 - analog))
    upper = sorted(digital[np.imag(digital) > 1e-14], key=lambda p: abs(abs(p) - 1))
    real = np.sort(np.real(digital[np.abs(np.imag(digital)) <= 1e-14]))
    pairs = [(p, np.conj(p)) for p in upper] + [(real[i], real[i + 1]) for i in range(0, len(real) - 1, 2)]
    sections = [[1.0, 0.0, -1.0, 1.0, -np.real(a + b), np.real(a * b)] for a, b in pairs[::-1]]
    sections = np.asarray(sections)
    sections[0, :3] *= gain
    return sections


STRIDE = 128


def _section(b: np.ndarray, a: np.ndarray, x: np.ndarray, level: float) -> tuple[np.ndarray, float]:
    """One biquad along x, from the steady state of an input of `level`; and the level that comes out of it.

    x is cut into strides. Inside a stride the answer is a product with the truncated impulse response; only the two state
    numbers pass from stride to stride.
    """
    through = b.sum() / (1 + a.sum())
    state = level * np.array([through - b[0], b[2] - a[1] * through])
    turn, feed = np.array([[-a[0], 1.0], [-a[1], 0.0]]), b[1:] - a * b[0]
    powers = np.empty((STRIDE + 1, 2, 2))
    powers[0] = np.eye(2)
    for i in range(STRIDE):
        powers[i + 1] = powers[i] @ turn
    response = np.concatenate([[b[0]], powers[: STRIDE - 1, 0] @ feed])
    at = np.arange(STRIDE)
    spread = np.where(at[:, None] >= at, response[at[:, None] - at], 0.0)
    gather = powers[STRIDE - 1 :: -1][:STRIDE] @ feed
    rows = -(-len(x) // STRIDE)
    cut = np.concatenate([x, np.zeros(rows * STRIDE - len(x))]).reshape(rows, STRIDE)
    pushed, whole = cut @ gather, powers[STRIDE]
    states = np.empty((rows, 2))
    for i in range(rows):
        states[i] = state
        state = whole @ state + pushed[i]
    return (cut @ spread.T + states @ powers[:STRIDE, 0].T).ravel()[: len(x)], level * through


def _cascade(sections: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Run the biquads from the steady state of the first sample."""
    level = float(x[0])
    for row in sections:
        x, level = _section(row[:3], row[4:], x, level)
    return x


def zero_phase(sections: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Filter forwards and backwards over an oddly mirrored extension of the ends."""
    at_origin = int(min((sections[:, 2] == 0).sum(), (sections[:, 5] == 0).sum()))
    pad = 3 * (2 * len(sections) + 1 - at_origin)
    x = np.asarray(x, np.float64)
    if len(x) <= pad:
        raise ValueError(f"need more than {pad} samples to filter, not {len(x)}")
    longer = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    return _cascade(sections, _cascade(sections, longer)[::-1])[::-1][pad:-pad]


def spaced_peaks(x: np.ndarray, distance: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Local maxima (a plateau's middle, rounded down) at least `distance` apart, smaller ones going first; and their prominences."""
    x = np.asarray(x, np.float64)
    if len(x) < 3:
        return np.empty(0, int), np.empty(0)
    starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    ends = np.concatenate([starts[1:] - 1, [len(x) - 1]])
    level = x[starts]
    top = np.flatnonzero((level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])) + 1
    peaks = (starts[top] + ends[top]) // 2
    keep = np.ones(len(peaks), bool)
    for i in np.argsort(x[peaks], kind="stable")[::-1]:
        if keep[i]:
            lo, hi = np.searchsorted(peaks, peaks[i] - distance, side="right"), np.searchsorted(peaks, peaks[i] + distance, side="left")
            keep[lo:hi] = False
            keep[i] = True
    return peaks[keep], _prominences(x, peaks)[keep] if len(peaks) else np.empty(0)


def find_peaks(x: np.ndarray, distance: int = 1, prominence: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """spaced_peaks of at least that prominence."""
    peaks, height = spaced_peaks(x, distance)
    return peaks[height >= prominence], height[height >= prominence]


def _prominences(x: np.ndarray, peaks: np.ndarray) -> np.ndarray:
    """Height of each local maximum over the higher of the two lowest points between it and higher ground (or the end) on either side.

    The way from one maximum to the next holds one lowest point. A stack of maxima that still see each other, each with the
    lowest point since the one below it, gives the lowest point of one side in one pass.
    """
    edge = np.concatenate([[0], peaks, [len(x)]])
    lowest = np.minimum.reduceat(x, edge[:-1])  # between each maximum (or the start) and the next (or the end)
    high = x[peaks]

    def side(first: float, heights: list[float], troughs: list[float]) -> np.ndarray:
        """troughs[i] lies just before heights[i]; `first` is the level of the end they are counted from."""
        seen: list[tuple[float, float]] = [(first, np.inf)]
        out = np.empty(len(heights))
        for i, (h, low) in enumerate(zip(heights, troughs, strict=True)):
            while seen and seen[-1][0] <= h:
                low = min(low, seen.pop()[1])
            out[i] = low
            seen.append((h, low))
        return out

    left = side(float(x[0]), high.tolist(), lowest[:-1].tolist())
    right = side(float(x[-1]), high[::-1].tolist(), lowest[:0:-1].tolist())[::-1]
    return high - np.maximum(left, right)


def robust_sigma(x: np.ndarray) -> float:
    return float(1.4826 * np.median(np.abs(x - np.median(x)))) if len(x) else 0.0


#: The floors that keep logarithms and shares finite, the roll-off's share, and how many cepstral numbers there are.
MAGNITUDE_FLOOR, POWER_FLOOR, LOG_FLOOR, ROLL_OFF, CEPSTRAL = 1e-8, 1e-8, 2e-8, 0.85, 13


def dominant_frequency(block: np.ndarray, fs: float) -> np.ndarray:
    """Of each row: frequency of the largest bin of the spectrum less its mean, never the constant one; 0 for a flat or too short one."""
    n = block.shape[1]
    if n < 2:
        return np.zeros(len(block))
    rest = block - block.mean(axis=1, keepdims=True)
    best = np.abs(np.fft.rfft(rest, axis=1))[:, 1:].argmax(axis=1) + 1
    return np.where(np.isclose(rest, 0).all(axis=1), 0.0, best * (fs / n))


def spectral_shape(block: np.ndarray, fs: float) -> np.ndarray:
    """Of each row, as three columns: centroid, roll-off and bandwidth of its magnitudes under a symmetric Hann window."""
    n = block.shape[1]
    power = np.abs(np.fft.rfft(block * np.hanning(n), axis=1)) + MAGNITUDE_FLOOR
    power /= power.sum(axis=1, keepdims=True)
    bins = np.fft.rfftfreq(n, 1 / fs)
    middle = power @ bins
    gap = bins - middle[:, None]
    reached = np.minimum((np.cumsum(power, axis=1) < ROLL_OFF).sum(axis=1), len(bins) - 1)
    return np.column_stack([middle, bins[reached], np.sqrt(np.einsum("rb,rb,rb->r", power, gap, gap))])


def power_ratio(block: np.ndarray, fs: float, low: float = 150.0, high: float = 1200.0) -> np.ndarray:
    """Of each row: its power in the band (ends in) as a share of all of it."""
    power = np.square(np.abs(np.fft.rfft(block, axis=1)))
    bins = np.fft.rfftfreq(block.shape[1], 1 / fs)
    first, stop = np.searchsorted(bins, low), np.searchsorted(bins, high, side="right")
    return power[:, first:stop].sum(axis=1) / (power.sum(axis=1) + POWER_FLOOR)


def cepstrum(block: np.ndarray, n: int = CEPSTRAL) -> np.ndarray:
    """Of each row: the first n real parts of the transform of its log spectrum, zero-padded."""
    found = np.fft.rfft(np.log(np.abs(np.fft.rfft(block, axis=1)) + LOG_FLOOR), axis=1).real[:, :n]
    return np.pad(found, ((0, 0), (0, n - found.shape[1])))

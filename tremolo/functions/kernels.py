"""Numeric kernels on numpy arrays: what SQL can't express. Textbook definitions."""

from __future__ import annotations

import struct

import numpy as np

from tremolo import config


def amplitude_spectrum(x: np.ndarray, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """(frequencies, magnitudes) of the periodic-Hann-windowed transform, scaled to amplitudes."""
    n = len(x)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    mag = np.abs(np.fft.rfft(x * window)) * 2 / n
    mag[0] /= 2
    if n % 2 == 0:
        mag[-1] /= 2
    return np.arange(len(mag)) * fs / n, mag


def find_peaks(y: np.ndarray, least: float) -> np.ndarray:
    """Places of local maxima (plateaus: their middle, rounded down; no ends) with at least this prominence."""
    peaks, prominence = peak_prominences(y)
    return peaks[prominence >= least]


def peak_prominences(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of local maxima, and their prominences."""
    if len(y) < 3:
        return np.zeros(0, int), np.zeros(0)
    start = np.flatnonzero(np.concatenate([[True], y[1:] != y[:-1]]))
    end = np.concatenate([start[1:], [len(y)]]) - 1
    level = y[start]
    top = np.flatnonzero((level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])) + 1
    peaks = (start[top] + end[top]) // 2
    if not len(peaks):
        return peaks, np.zeros(0)

    def basin(values: np.ndarray) -> np.ndarray:
        """For each place the least value between it and the last higher one before it, by a stack."""
        low, stack = values.copy(), []
        for i, v in enumerate(values):
            m = v
            while stack and stack[-1][0] <= v:
                m = min(m, stack.pop()[1])
            low[i] = m
            stack.append((v, m))
        return low

    return peaks, y[peaks] - np.maximum(basin(y)[peaks], basin(y[::-1])[::-1][peaks])


def butter_sections(low: float, high: float, order: int = 4) -> list[tuple[np.ndarray, np.ndarray]]:
    """A Butterworth band-pass as sections (b, a) of second order; edges as shares of the Nyquist frequency.

    Sections keep narrow bands stable, whose whole polynomial would not be.
    """
    poles = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    w1, w2 = 4 * np.tan(np.pi * low / 2), 4 * np.tan(np.pi * high / 2)
    width, centre = w2 - w1, np.sqrt(w1 * w2)
    half = poles * width / 2
    root = np.sqrt(half**2 - centre**2 + 0j)
    analog = np.concatenate([half + root, half - root])
    digital = (4 + analog) / (4 - analog)
    gain = float(np.real(width**order * 4.0**order / np.prod(4 - analog)))
    upper = sorted((p for p in digital if p.imag > 0), key=abs)
    if len(upper) == order:  # the others are their conjugates
        pairs = [(p, p.conjugate()) for p in upper]
    else:  # a wide band may have real poles
        real = sorted((p for p in digital if p.imag == 0), key=abs)
        pairs = [(p, p.conjugate()) for p in upper] + list(zip(real[::2], real[1::2]))
    each = gain ** (1 / order)
    return [(np.array([each, 0.0, -each]), np.array([1.0, -(p + q).real, (p * q).real])) for p, q in pairs]


#: Points that the filter takes at a step.
STEP = 64


def _run(b: np.ndarray, a: np.ndarray, x: np.ndarray, z: np.ndarray) -> np.ndarray:
    """The difference equation from the state ``z``, in blocks of STEP points.

    What a block's points add to its outputs and to the state after it are two products for all blocks at
    once; only the state is carried from block to block.
    """
    n = len(z)
    on = np.zeros((n, n))
    on[:, 0] = -a[1:]
    on[np.arange(n - 1), np.arange(1, n)] = 1
    into = b[1:] - a[1:] * b[0]
    seen, after, row, column = np.zeros((STEP, n)), np.zeros((n, STEP)), np.eye(n)[0], into
    for k in range(STEP):
        seen[k], after[:, STEP - 1 - k] = row, column
        row, column = row @ on, on @ column
    response = np.concatenate([[b[0]], seen[:-1] @ into])
    lag = np.arange(STEP)[:, None] - np.arange(STEP)
    blocks = np.concatenate([x, np.zeros(-len(x) % STEP)]).reshape(-1, STEP)
    pushed, whole = blocks @ after.T, np.linalg.matrix_power(on, STEP)
    states = np.zeros((len(blocks), n))
    for k in range(len(blocks)):
        states[k] = z
        z = whole @ z + pushed[k]
    return (blocks @ np.where(lag >= 0, response[np.abs(lag)], 0.0).T + states @ seen.T).ravel()[: len(x)]


def zero_phase(sections: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray) -> np.ndarray:
    """Forward and backward filtering with odd extension and steady-state starts."""
    pad = 3 * (2 * len(sections) + 1)
    if len(x) <= pad:
        raise ValueError(f"the filter needs more than {pad} points")

    def through(y: np.ndarray) -> np.ndarray:
        level = y[0]  # the state is that of a constant signal of the first value
        for b, a in sections:
            out = level * b.sum() / a.sum()
            y = _run(b, a, y, np.array([out - b[0] * level, b[2] * level - a[2] * out]))
            level = out
        return y

    ext = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    return through(through(ext)[::-1])[::-1][pad:-pad]


def bandpass(x: np.ndarray, fs: float, band: tuple | None = None) -> tuple[np.ndarray, list[float], str]:
    """(filtered, band, rule); a band that reaches the Nyquist frequency means no filter, one from 0 Hz or below is refused."""
    nyquist = fs / 2
    rule = "default" if band is None else "given"
    lo, hi = (config.RESONANCE_BAND[0] * nyquist, config.RESONANCE_BAND[1] * nyquist) if band is None else map(float, band)
    if not (np.isfinite(lo) and np.isfinite(hi) and 0 < lo < hi):
        raise ValueError("invalid_argument: the band needs two rising finite numbers above 0")
    if hi >= nyquist:
        return x, [0.0, nyquist], "unfiltered"
    return zero_phase(butter_sections(lo / nyquist, hi / nyquist), x), [lo, hi], rule


def envelope_spectrum(x: np.ndarray, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum of the analytic signal's modulus less its mean."""
    n = len(x)
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    env = np.abs(np.fft.ifft(np.fft.fft(x) * gain))
    return amplitude_spectrum(env - env.mean(), fs)


def bucket_bounds(n: int, points: int) -> list[tuple[int, int]]:
    c = min(points, n)
    return [(i * n // c, (i + 1) * n // c) for i in range(c)] if c else []


def wav_bytes(x: np.ndarray, fs: float) -> bytes:
    """Mono 16-bit PCM, scaled to its largest modulus."""
    top = np.abs(x).max() if len(x) else 0.0
    pcm = np.round(x / top * config.WAV_HEADROOM * config.WAV_SCALE).astype("<i2") if top > 0 else np.zeros(len(x), "<i2")
    data, rate = pcm.tobytes(), int(round(fs))
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16) + b"data" + struct.pack("<I", len(data)) + data


def kurtosis(x: np.ndarray) -> float:
    n, m2 = len(x), float(np.mean(x**2))
    if m2 <= 0:
        return 0.0
    g = float(np.mean(x**4)) / m2**2 - 3
    k = ((n - 1) * ((n + 1) * g + 6)) / ((n - 2) * (n - 3)) + 3 if n > 3 else g + 3
    return k if np.isfinite(k) else 0.0

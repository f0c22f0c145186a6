"""Feature extraction by sample: one grouped kernel for spectra and envelopes, one for plots and sound."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremolo import config
from tremolo.functions import kernels
from tremolo.operators.spectra import band_edges
from tremolo.session import dealt

_PEAK = "struct<frequency:double,amplitude:double>"
_MATCH = "struct<label:string,frequency:double,nearest_peak:double,deviation_pct:double,peak_amplitude:double,harmonic_order:int>"
_BASES = "struct<shaft:double,bpfo:double,bpfi:double,bsf:double,ftf:double,bsf_2x:double>"
_ENERGY = "struct<bpfo:double,bpfi:double,bsf:double,ftf:double>"
ENVELOPE = f"struct<band_hz:array<double>,band_rule:string,characteristic_frequencies:{_BASES},characteristic_energy:{_ENERGY},characteristic_peaks:array<{_MATCH}>,envelope_peaks:array<{_PEAK}>>"
FEATURES = (
    "sample_id string, n_samples long, sampling_rate double, rms double, peak double, kurtosis double, crest_factor double, dominant_frequency double, dominant_amplitude double, "
    f"band_energy map<string,double>, spectrum_peaks array<{_PEAK}>, envelope {ENVELOPE}, error struct<code:string,message:string>"
)
SERIES = "sample_id string, waveform_min array<double>, waveform_max array<double>, spectrum_freq array<double>, spectrum_mag array<double>, envelope_freq array<double>, envelope_mag array<double>, wav binary"


def _f(v: float | None, digits: int = 6) -> float | None:
    return round(float(v), digits) if v is not None and np.isfinite(v) else None


def _hz(v: float) -> str:
    return f"{v:.0f}" if v == int(v) else f"{v:.1f}"


def frequencies(rpm: float) -> dict[str, float]:
    """Characteristic frequencies of the bearing, 4 digits."""
    shaft, r = rpm / 60, config.BALL_DIAMETER / config.PITCH_DIAMETER * np.cos(np.radians(config.CONTACT_ANGLE))
    out = {
        "shaft": shaft, "bpfo": shaft * config.BALLS / 2 * (1 - r), "bpfi": shaft * config.BALLS / 2 * (1 + r),
        "bsf": shaft * config.PITCH_DIAMETER / (2 * config.BALL_DIAMETER) * (1 - r * r), "ftf": shaft / 2 * (1 - r),
    }
    return {k: round(float(v), 4) for k, v in out.items()}


def envelope(x: np.ndarray, fs: float, rpm: float, band: tuple | None = None) -> dict | None:
    """Energies and peaks of the envelope spectrum at the families' harmonics; null if the signal is too short to filter.

    Peaks stand out by a set share of the spectrum's largest value; of those near a harmonic the highest counts.
    """
    if len(x) <= 27:
        return None
    narrow, edges, rule = kernels.bandpass(x, fs, band)
    freq, mag = kernels.envelope_spectrum(narrow, fs)
    base, step = frequencies(rpm), fs / len(x)
    tops = kernels.find_peaks(mag, config.PROMINENCE_RATIO * mag.max()) if mag.max() > 0 else np.zeros(0, int)
    tops = tops[freq[tops] > 0]
    energy, matches = {}, []
    for family in ("ftf", "bsf", "bpfo", "bpfi"):
        total = 0.0
        for order in config.HARMONICS:
            target = base[family] * order
            reach = max(config.ENVELOPE_TOLERANCE * target, step)
            total += float((mag[np.abs(freq - target) <= reach] ** 2).sum())
            near = tops[np.abs(freq[tops] - target) <= reach]
            if len(near):
                best = near[np.argmax(mag[near])]
                matches.append({"label": family.upper(), "frequency": _f(target, 4), "nearest_peak": _f(freq[best], 4), "deviation_pct": _f(abs(freq[best] - target) / target * 100, 2), "peak_amplitude": _f(mag[best], 12), "harmonic_order": order})
        energy[family] = _f(total, 12)
    tops = np.sort(tops[np.argsort(-mag[tops], kind="stable")][:10])
    return {
        "band_hz": [_f(v, 4) for v in edges], "band_rule": rule, "characteristic_frequencies": base | {"bsf_2x": _f(2 * base["bsf"], 4)}, "characteristic_energy": {k: energy[k] for k in config.FAMILIES},
        "characteristic_peaks": matches, "envelope_peaks": [{"frequency": _f(freq[k], 4), "amplitude": _f(mag[k], 12)} for k in tops],
    }


def selected_peaks(freq: np.ndarray, mag: np.ndarray, band_high: float) -> list[dict]:
    """The 5 highest of all peaks and the 20 highest of those up to ``band_high``, by frequency.

    Peaks are found in the whole spectrum both times; in the band the prominence is measured
    against the largest bin of the band.
    """
    inside = freq <= band_high
    peaks, prominence = kernels.peak_prominences(mag)
    chosen: set[int] = set()
    for top, most, ok in ((mag.max(initial=0.0), config.GLOBAL_PEAKS, freq > 0), (mag[inside].max(initial=0.0), config.BAND_PEAKS, inside & (freq > 0))):
        if top > 0:
            k = peaks[(prominence >= config.PROMINENCE_RATIO * top) & ok[peaks]]
            chosen |= set(k[np.argsort(-mag[k], kind="stable")][:most].tolist())
    return [{"frequency": _f(freq[k], 4), "amplitude": _f(mag[k])} for k in sorted(chosen)]


def features_of(sample_id: str, x: np.ndarray, fs: float, rpm: float | None, edges: list | None = None, band: tuple | None = None) -> dict:
    out = dict.fromkeys(c.split()[0] for c in FEATURES.split(", ") if " " in c) | {"sample_id": sample_id, "n_samples": len(x), "sampling_rate": fs, "error": None}
    out = {k: out.get(k) for k in ("sample_id", "n_samples", "sampling_rate", "rms", "peak", "kurtosis", "crest_factor", "dominant_frequency", "dominant_amplitude", "band_energy", "spectrum_peaks", "envelope", "error")}
    if not (fs and np.isfinite(fs) and fs > 0):
        return out | {"error": {"code": "invalid_argument", "message": "the sampling rate must be finite and positive"}}
    if len(x) < 2:
        return out | {"error": {"code": "insufficient_data", "message": "two points at least are needed"}}
    x = x - x.mean()
    rms, peak = float(np.sqrt(np.mean(x**2))), float(np.abs(x).max())
    freq, mag = kernels.amplitude_spectrum(x, fs)
    k = int(mag.argmax())
    edges = band_edges(edges, fs)
    bands = {}
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        inside = (freq >= a) & ((freq <= b) if i == len(edges) - 2 else (freq < b))
        bands[f"{_hz(a)}-{_hz(b)}Hz"] = _f((mag[inside] ** 2).sum())
    high = min(config.BAND_ORDER * max(frequencies(rpm)[f] for f in config.FAMILIES) if rpm else config.LOW_BAND_HZ, float(freq[-1]))
    return out | {
        "rms": _f(rms), "peak": _f(peak), "kurtosis": _f(kernels.kurtosis(x)), "crest_factor": _f(peak / rms if rms > 0 else 0.0), "dominant_frequency": _f(freq[k], 4), "dominant_amplitude": _f(mag[k]),
        "band_energy": bands, "spectrum_peaks": selected_peaks(freq, mag, high), "envelope": envelope(x, fs, rpm, band) if rpm else None,
    }


def extract_features(signals: DataFrame, samples: DataFrame, edges: list | None = None, band: tuple | None = None) -> DataFrame:
    """FEATURES and rotation_speed of each row of ``samples``, computed once however many requests name it.

    ``samples`` has sample_id, sampling_rate and rotation_speed (null: no envelope), no row twice. A sample's points
    meet in one task, as its transform needs them all; samples are spread over tasks. Failures are a
    struct in ``error``, not exceptions.
    """
    if edges is not None:
        band_edges(edges, 0.0)  # broken ones fail before any work
    rows = signals.join(samples.select("sample_id", F.col("sampling_rate").cast("double").alias("fs"), F.col("rotation_speed").cast("double").alias("rpm")), "sample_id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        rpm = asked = pdf.rpm.iloc[0]
        rpm = float(rpm) if pd.notna(rpm) and np.isfinite(rpm) and rpm > 0 else None
        made = features_of(pdf.sample_id.iloc[0], pdf.amplitude.to_numpy(float), float(pdf.fs.iloc[0]), rpm, edges, band)
        return pd.DataFrame([made | {"rotation_speed": asked}])

    return dealt(rows.select("sample_id", "idx", "amplitude", "fs", "rpm"), "sample_id", "fs", "rpm").groupBy("sample_id", "fs", "rpm").applyInPandas(run, f"{FEATURES}, rotation_speed double")


def extract_series(signals: DataFrame, samples: DataFrame) -> DataFrame:
    """SERIES of each sample for plots and sound; apart from the features, so that plans without it don't pay for it."""
    rows = signals.join(samples.select("sample_id", F.col("sampling_rate").cast("double").alias("fs")), "sample_id")

    def thinned(freq: np.ndarray, mag: np.ndarray, points: int) -> tuple[list, list]:
        at = [a + int(mag[a:b].argmax()) for a, b in kernels.bucket_bounds(len(mag), points)]
        return freq[at].tolist(), mag[at].tolist()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        x, fs = pdf.amplitude.to_numpy(float), float(pdf.fs.iloc[0])
        x = x - x.mean()
        bounds = kernels.bucket_bounds(len(x), config.WAVEFORM_POINTS)
        freq, mag = kernels.amplitude_spectrum(x, fs)
        sf, sm = thinned(freq, mag, config.SPECTRUM_POINTS)
        ef, em = [], []
        if len(x) > 27:
            freq, mag = kernels.envelope_spectrum(kernels.bandpass(x, fs)[0], fs)
            low = freq <= config.ENVELOPE_HZ
            ef, em = thinned(freq[low], mag[low], config.ENVELOPE_POINTS)
        return pd.DataFrame([{"sample_id": pdf.sample_id.iloc[0], "waveform_min": [float(x[a:b].min()) for a, b in bounds], "waveform_max": [float(x[a:b].max()) for a, b in bounds], "spectrum_freq": sf, "spectrum_mag": sm, "envelope_freq": ef, "envelope_mag": em, "wav": kernels.wav_bytes(x, fs)}])

    return dealt(rows.select("sample_id", "idx", "amplitude", "fs"), "sample_id").groupBy("sample_id").applyInPandas(run, SERIES)

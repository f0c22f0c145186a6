"""Transforms and filters over many tasks against the kernels and numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremolo.functions import kernels
from tremolo.operators import long_signals as L


def signal(spark, xs):
    rows = [(s, k, float(v)) for s, x in xs.items() for k, v in enumerate(x)]
    return spark.createDataFrame(rows, "sample_id string, idx long, amplitude double").repartition(5)


def arrays(df, *columns):
    out = {}
    for r in df.collect():
        out.setdefault(r.sample_id, []).append(tuple(r[c] for c in columns))
    return {s: np.array(sorted(v)) for s, v in out.items()}


@pytest.fixture
def small(monkeypatch):
    """Groups, columns and blocks so small that short signals take many."""
    monkeypatch.setattr(L, "GROUP", 40)
    monkeypatch.setattr(L, "LONGEST", 30)
    monkeypatch.setattr(L, "BLOCK", 50)


def test_spectra_of_any_length(spark, small):
    rng = np.random.default_rng(1)
    xs = {f"n{n}": rng.normal(size=n) for n in (2, 3, 30, 31, 97, 128, 360, 500, 899)}  # primes and products with large primes go by the chirp
    rates = spark.createDataFrame([(s, 10.0 * len(x)) for s, x in xs.items()], "sample_id string, fs double")
    got = arrays(L.amplitude_spectrum(signal(spark, xs), rates), "bin", "freq", "mag")
    assert got.keys() == xs.keys()
    for s, x in xs.items():
        freq, mag = kernels.amplitude_spectrum(x - x.mean(), 10.0 * len(x))
        assert len(got[s]) == len(freq) and np.allclose(got[s][:, 1], freq) and np.allclose(got[s][:, 2], mag, atol=1e-9)


def test_two_to_the_22_points(spark):
    n = 1 << 22
    value = F.sin(F.col("id") * 0.01) + F.cos(F.col("id") * 1.7) + F.pmod(F.col("id") * 7919, F.lit(1009)) / 1009.0
    df = spark.range(n).select(F.lit("x").alias("sample_id"), F.col("id").alias("idx"), value.alias("amplitude"))
    got = L.amplitude_spectrum(df, spark.createDataFrame([("x", 12000.0)], "sample_id string, fs double")).select("bin", "mag").toPandas().sort_values("bin")
    k = np.arange(n)
    x = np.sin(k * 0.01) + np.cos(k * 1.7) + (k * 7919 % 1009) / 1009.0
    assert len(got) == n // 2 + 1 and np.abs(got.mag.to_numpy() - kernels.amplitude_spectrum(x - x.mean(), 12000.0)[1]).max() < 1e-9
    rows, cols, step, band = L._layout(n)
    assert rows * cols == n and rows * step <= L.GROUP and cols * band <= L.GROUP  # no group of a task holds more


def test_filter_across_blocks(spark, small):
    rng = np.random.default_rng(2)
    xs = {f"n{n}": rng.normal(size=n) + 3 for n in (20, 27, 28, 49, 50, 100, 473, 1000)}
    got = arrays(L.bandpass(signal(spark, xs), 0.3, 0.7), "idx", "amplitude")
    assert got.keys() == {s for s, x in xs.items() if len(x) > 27}
    for s, y in got.items():
        want = kernels.zero_phase(kernels.butter_sections(0.3, 0.7), xs[s])
        assert len(y) == len(want) and np.abs(y[:, 1] - want).max() < 1e-9


def test_envelope_spectrum(spark, small):
    rng = np.random.default_rng(3)
    xs = {"a": rng.normal(size=600), "b": np.sin(np.arange(301) * 1.5) * (1 + np.sin(np.arange(301) / 9))}
    rates = spark.createDataFrame([("a", 600.0), ("b", 301.0)], "sample_id string, fs double")
    got = arrays(L.envelope_spectrum(signal(spark, xs), rates, 0.33, 0.83), "bin", "mag")
    for s, x in xs.items():
        mag = kernels.envelope_spectrum(kernels.zero_phase(kernels.butter_sections(0.33, 0.83), x), float(len(x)))[1]
        assert np.abs(got[s][:, 1] - mag).max() < 1e-9

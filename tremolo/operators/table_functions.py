"""Table functions for SQL: features, spectra and comparisons of the signals of a table argument.

``register`` makes them known to a session. Spark deals the argument's rows out by its PARTITION BY columns and hands
a partition over in its order, one sample at a time::

    SELECT * FROM signal_features(TABLE(signals) PARTITION BY sample_id ORDER BY idx)
    SELECT * FROM signal_spectrum(TABLE(signals) PARTITION BY sample_id ORDER BY idx)
    SELECT * FROM signal_comparison(TABLE(pairs) PARTITION BY request_id ORDER BY (side, idx))

``signals`` has sample_id, idx, amplitude, sampling_rate and rotation_speed; ``pairs`` has these (but sample_id) beside
request_id and side, 'normal' or 'abnormal'. A partition without a sample's id, or of several samples, has the first row's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from tremolo import config
from tremolo.functions import kernels
from tremolo.operators.features import FEATURES, features_of

_NAMES = [c.split()[0] for c in FEATURES.split(", ")]


class _Points:
    """The points of a partition, as numbers, with the first row's other columns."""

    def __init__(self) -> None:
        self.first: Row | None = None
        self.points: list[float] = []

    def add(self, row: Row) -> None:
        self.first = self.first or row
        self.points.append(float("nan") if row["amplitude"] is None else float(row["amplitude"]))

    def speed(self) -> float | None:
        rpm = self.first["rotation_speed"]
        return float(rpm) if rpm is not None and np.isfinite(rpm) and rpm > 0 else None

    def features(self, name: str) -> dict:
        return features_of(name, np.array(self.points), float(self.first["sampling_rate"] or 0), self.speed())


class _Features:
    def __init__(self) -> None:
        self.own = _Points()

    def eval(self, row: Row) -> None:
        self.own.add(row)

    def terminate(self) -> Iterator[tuple]:
        if self.own.first is not None:
            made = self.own.features(self.own.first["sample_id"])
            yield tuple(made[c] for c in _NAMES) + (self.own.first["rotation_speed"],)


class _Spectrum:
    def __init__(self) -> None:
        self.own = _Points()

    def eval(self, row: Row) -> None:
        self.own.add(row)

    def terminate(self) -> Iterator[tuple]:
        if len(self.own.points) > 1:
            x = np.array(self.own.points)
            freq, mag = kernels.amplitude_spectrum(x - x.mean(), float(self.own.first["sampling_rate"]))
            for k, (f, m) in enumerate(zip(freq.tolist(), mag.tolist())):
                yield self.own.first["sample_id"], k, f, m


class _Comparison:
    """Of each feature both sides' values, their difference and ratio, and whether it counts as changed."""

    def __init__(self) -> None:
        self.sides = {"normal": _Points(), "abnormal": _Points()}

    def eval(self, row: Row) -> None:
        if row["side"] in self.sides:
            self.sides[row["side"]].add(row)

    def terminate(self) -> Iterator[tuple]:
        if any(s.first is None for s in self.sides.values()):
            return
        n, a = (self.sides[k].features(k) for k in ("normal", "abnormal"))
        for f in config.FEATURES:
            x, y = n[f], a[f]
            if x is None or y is None:
                continue
            ratio = round(y / x, 4) if x else None
            yield self.sides["normal"].first["request_id"], f, round(x, 4), round(y, 4), round(y - x, 4), ratio, ratio is not None and abs(ratio - 1) >= config.CHANGE_THRESHOLD


def register(spark: SparkSession) -> None:
    """Makes signal_features, signal_spectrum and signal_comparison known to SQL."""
    spark.udtf.register("signal_features", udtf(_Features, returnType=f"{FEATURES}, rotation_speed double"))
    spark.udtf.register("signal_spectrum", udtf(_Spectrum, returnType="sample_id string, bin long, freq double, mag double"))
    spark.udtf.register("signal_comparison", udtf(_Comparison, returnType="request_id string, feature string, normal double, abnormal double, delta double, ratio double, changed boolean"))

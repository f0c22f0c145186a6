"""Transform and filter of signals too long for one task: no task holds more than a block or a few columns of a signal.

The transform is taken in two steps: of a signal's points laid out in N1 rows and N2 columns, columns are transformed,
turned by their twiddle factors, dealt out again by row, and rows are transformed. A length without
suitable factors is transformed by convolution with a chirp. The filter runs block by block; what a block makes of the
state before it is an affine map, so states come from composing these maps in order, and blocks are independent again.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremolo.functions import kernels
from tremolo.session import Stage, dealt

#: Points to a task's group in a transform; the longest row or column that is transformed as such.
GROUP, LONGEST = 1 << 16, 1 << 20
#: Points to a block of the filter.
BLOCK = 1 << 16

_VALUES = "sample_id string, idx long, re double, im double"
_TILES = "sample_id string, n long, rows long, cols long, step long, band long, at long, re array<double>, im array<double>"


def factors(n: int) -> tuple[int, int] | None:
    """(rows, columns) of the layout, as near to a square as divisors allow; none if a column would be longer than LONGEST."""
    rows = next(k for k in range(math.isqrt(n), 0, -1) if n % k == 0) if n else 0
    return (rows, n // rows) if rows and n // rows <= LONGEST else None


def _layout(n: int) -> tuple[int, int, int, int]:
    """(rows, columns, columns to a group, rows to a group); zeros for a length that has to go by the chirp."""
    found = factors(n)
    if not found:
        return 0, 0, 0, 0
    rows, cols = found
    return rows, cols, max(1, GROUP // rows), max(1, GROUP // cols)


def _sized(sizes: DataFrame) -> DataFrame:
    """``sizes`` (sample_id, n) with the layout of each length."""

    @F.pandas_udf("rows long, cols long, step long, band long")
    def layout(n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(n.map(_layout).tolist(), columns=["rows", "cols", "step", "band"])

    return sizes.select("sample_id", "n", layout("n").alias("l")).select("sample_id", "n", "l.*")


def transform(values: DataFrame, sizes: DataFrame) -> DataFrame:
    """(sample_id, idx, re, im): the discrete transform of ``values`` (sample_id, idx, re, im), idx from 0 to the sample's ``n`` less 1.

    ``sizes`` has (sample_id, n), one row a sample; points that ``values`` lacks are 0. Lengths that aren't a product of two numbers
    up to LONGEST go by Bluestein's chirp, three transforms of a power of two.
    """
    stage = Stage(values.sparkSession, "transform")
    sizes = stage.write(_sized(sizes))
    plain = _two_steps(values, sizes.where("rows > 0"))
    odd = stage.write(sizes.where("rows = 0").select("sample_id", "n"))
    return plain if odd.isEmpty() else plain.unionByName(_chirped(values, odd, stage))


def _two_steps(values: DataFrame, sizes: DataFrame) -> DataFrame:
    # A long sample is a hot key: points meet their sizes by broadcast if Spark finds these small, else in a join that it splits.
    rows = values.join(sizes, "sample_id")

    def columns(pdf: pd.DataFrame) -> pd.DataFrame:
        sample, n, r, c, step, band = (pdf[k].iloc[0] for k in ("sample_id", "n", "rows", "cols", "step", "band"))
        first = int(pdf.idx.iloc[0] % c) // step * step
        width = min(step, c - first)
        x = np.zeros((r, width), complex)
        at = pdf.idx.to_numpy()
        x[at // c, at % c - first] = pdf.re.to_numpy() + 1j * pdf.im.to_numpy()
        # Products of row and column numbers are below n, so the turns are exact.
        x = np.fft.fft(x, axis=0) * np.exp(-2j * np.pi * np.outer(np.arange(r), np.arange(first, first + width)) / n)
        tiles = [x[k : k + band].ravel() for k in range(0, r, band)]
        return pd.DataFrame({"sample_id": sample, "n": n, "rows": r, "cols": c, "step": step, "band": band, "at": [k * (1 << 32) + first for k in range(len(tiles))], "re": [t.real for t in tiles], "im": [t.imag for t in tiles]})

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        sample, n, r, c, step, band = (pdf[k].iloc[0] for k in ("sample_id", "n", "rows", "cols", "step", "band"))
        first = int(pdf["at"].iloc[0] >> 32) * band
        height = min(band, r - first)
        x = np.zeros((height, c), complex)
        for at, re, im in zip(pdf["at"], pdf.re, pdf.im):
            low = int(at & 0xFFFFFFFF)
            width = min(step, c - low)
            x[:, low : low + width] = (np.asarray(re) + 1j * np.asarray(im)).reshape(height, width)
        x = np.fft.fft(x, axis=1)
        idx = first + np.arange(height)[:, None] + r * np.arange(c)
        return pd.DataFrame({"sample_id": sample, "idx": idx.ravel(), "re": x.real.ravel(), "im": x.imag.ravel()})

    group = F.floor(F.pmod(F.col("idx"), F.col("cols")) / F.col("step")).alias("_g")
    tiles = rows.select(*rows.columns, group).groupBy("sample_id", "_g").applyInPandas(columns, _TILES)
    return tiles.withColumn("_b", F.shiftright("at", 32)).groupBy("sample_id", "_b").applyInPandas(across, _VALUES)


def _times(re: Column, im: Column, turn: Column) -> tuple[Column, Column]:
    """(re, im) of a value turned by exp(i turn)."""
    return re * F.cos(turn) - im * F.sin(turn), re * F.sin(turn) + im * F.cos(turn)


def _chirped(values: DataFrame, sizes: DataFrame, stage: Stage) -> DataFrame:
    """By the identity jk = (j^2 + k^2 - (k - j)^2) / 2 a transform of any length is a convolution with a chirp, which goes by a power of two."""
    power = F.pow(F.lit(2.0), F.ceil(F.log2(2 * F.col("n") - 1))).cast("long")
    sizes = stage.write(sizes.withColumn("m", power))
    whole = sizes.select("sample_id", F.col("m").alias("n"))
    angle = F.lit(math.pi) * F.pmod(F.col("idx") * F.col("idx"), 2 * F.col("n")) / F.col("n")
    re, im = _times(F.col("re"), F.col("im"), -angle)
    a = transform(values.join(sizes, "sample_id").select("sample_id", "idx", re.alias("re"), im.alias("im")), whole)
    spread = sizes.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / GROUP))))
    spread = dealt(spread, "sample_id", "_part").withColumn("idx", F.explode(F.sequence(F.col("_part") * GROUP, F.least((F.col("_part") + 1) * GROUP, F.col("n")) - 1)))
    both = spread.withColumn("at", F.explode(F.when(F.col("idx") > 0, F.array("idx", F.col("m") - F.col("idx"))).otherwise(F.array("idx"))))
    b = transform(both.select("sample_id", F.col("at").alias("idx"), F.cos(angle).alias("re"), F.sin(angle).alias("im")), whole).select("sample_id", "idx", F.col("re").alias("br"), F.col("im").alias("bi"))
    # The inverse is the transform of the conjugate, conjugated, over m.
    product = a.join(b, ["sample_id", "idx"]).select("sample_id", "idx", (F.col("re") * F.col("br") - F.col("im") * F.col("bi")).alias("re"), (-(F.col("re") * F.col("bi") + F.col("im") * F.col("br"))).alias("im"))
    back = transform(product, whole).join(sizes, "sample_id").where(F.col("idx") < F.col("n"))
    re, im = _times(F.col("re") / F.col("m"), -F.col("im") / F.col("m"), -angle)
    return back.select("sample_id", "idx", re.alias("re"), im.alias("im"))


def _levels(signals: DataFrame, stage: Stage) -> DataFrame:
    return stage.write(signals.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.avg("amplitude").alias("mean")))


def amplitude_spectrum(signals: DataFrame, rates: DataFrame) -> DataFrame:
    """(sample_id, bin, freq, mag) of whole signals (sample_id, idx from 0 without gaps, amplitude) of any length.

    The same as the kernel's: less the mean, by a periodic Hann window, scaled to amplitudes. ``rates`` has (sample_id, fs).
    """
    stage = Stage(signals.sparkSession, "spectrum")
    levels = _levels(signals, stage)
    hann = 0.5 - 0.5 * F.cos(F.lit(2 * math.pi) * F.col("idx") / F.col("n"))
    rows = signals.join(levels, "sample_id").select("sample_id", "idx", ((F.col("amplitude") - F.col("mean")) * hann).alias("re"), F.lit(0.0).alias("im"))
    made = transform(rows, levels.select("sample_id", "n")).join(levels.join(rates, "sample_id"), "sample_id").where(F.col("idx") <= F.col("n") / 2)
    edge = (F.col("idx") == 0) | (2 * F.col("idx") == F.col("n"))
    mag = F.hypot("re", "im") * F.when(edge, 1.0).otherwise(2.0) / F.col("n")
    return made.select("sample_id", F.col("idx").alias("bin"), (F.col("idx") * F.col("fs") / F.col("n")).alias("freq"), mag.alias("mag"))


def envelope(signals: DataFrame) -> DataFrame:
    """(sample_id, idx, amplitude): the modulus of the analytic signal, by a transform and its inverse."""
    stage = Stage(signals.sparkSession, "envelope")
    sizes = _levels(signals, stage).select("sample_id", "n")
    there = transform(signals.select("sample_id", "idx", F.col("amplitude").alias("re"), F.lit(0.0).alias("im")), sizes).join(sizes, "sample_id")
    k, n = F.col("idx"), F.col("n")
    gain = F.when((k == 0) | (2 * k == n), 1.0).when(2 * k < n, 2.0).otherwise(0.0)
    back = transform(there.select("sample_id", "idx", (F.col("re") * gain).alias("re"), (-F.col("im") * gain).alias("im")), sizes).join(sizes, "sample_id")
    return back.select("sample_id", "idx", (F.hypot("re", "im") / F.col("n")).alias("amplitude"))


# --- the filter ---


def _through(sections: list, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(outputs, state after) of a block that all sections run over, one after another; a state has two numbers a section."""
    after = []
    for k, (b, a) in enumerate(sections):
        y = kernels._run(b, a, x, state[2 * k : 2 * k + 2])
        # The state that the last two inputs and outputs leave behind.
        before_x, before_y = (x[-2], y[-2]) if len(x) > 1 else (None, None)
        last = b[2] * x[-1] - a[2] * y[-1]
        first = b[1] * x[-1] - a[1] * y[-1] + (b[2] * before_x - a[2] * before_y if len(x) > 1 else state[2 * k + 1])
        after += [first, last]
        x = y
    return x, np.array(after)


def _steady(sections: list, level: float) -> np.ndarray:
    """The state of a signal that has always been ``level``."""
    out = []
    for b, a in sections:
        now = level * b.sum() / a.sum()
        out += [now - b[0] * level, b[2] * level - a[2] * now]
        level = now
    return np.array(out)


def _pass(blocks: DataFrame, sections: list, backward: bool, stage: Stage) -> DataFrame:
    """``blocks`` (sample_id, block, x), filtered from the first to the last or back: push each block from a zero state, compose
    the maps in order, run each block from its own state."""
    turn = (lambda x: np.asarray(x, float)[::-1]) if backward else (lambda x: np.asarray(x, float))
    width = 2 * len(sections)

    def pushed(batches):
        for pdf in batches:
            rows = [(turn(x)[0], len(x), _through(sections, turn(x), np.zeros(width))[1]) for x in pdf.x]
            yield pd.DataFrame({"sample_id": pdf.sample_id, "block": pdf.block, "head": [r[0] for r in rows], "size": [r[1] for r in rows], "push": [r[2] for r in rows]})

    def composed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block", ascending=not backward)
        maps: dict[int, np.ndarray] = {}
        state, states = _steady(sections, float(pdf["head"].iloc[0])), []
        for size, push in zip(pdf["size"], pdf["push"]):
            states.append(state)
            if size not in maps:  # two lengths at most
                maps[size] = np.stack([_through(sections, np.zeros(size), unit)[1] for unit in np.eye(width)], 1)
            state = maps[size] @ state + np.asarray(push)
        return pd.DataFrame({"sample_id": pdf.sample_id, "block": pdf.block, "state": states})

    def run(batches):
        for pdf in batches:
            out = [turn(_through(sections, turn(x), np.asarray(s, float))[0]) for x, s in zip(pdf.x, pdf.state)]
            yield pd.DataFrame({"sample_id": pdf.sample_id, "block": pdf.block, "x": out})

    pushes = blocks.mapInPandas(pushed, "sample_id string, block long, head double, size long, push array<double>")
    states = stage.write(pushes.groupBy("sample_id").applyInPandas(composed, "sample_id string, block long, state array<double>"))
    return stage.write(blocks.join(states, ["sample_id", "block"]).select("sample_id", "block", "x", "state").mapInPandas(run, "sample_id string, block long, x array<double>"))


def bandpass(signals: DataFrame, low: float, high: float) -> DataFrame:
    """(sample_id, idx, amplitude): signals (idx from 0 without gaps) filtered forward and backward, as the kernel does; edges are shares of the Nyquist frequency.

    Points are in blocks of BLOCK; of a block a single row with its state, two numbers a section, meets those of its signal's other
    blocks. Signals of 27 points or fewer are too short, and give no rows.
    """
    stage = Stage(signals.sparkSession, "filter")
    sections = kernels.butter_sections(low, high)
    pad = 3 * (2 * len(sections) + 1)
    ends = F.min_by("amplitude", "idx").alias("first"), F.max_by("amplitude", "idx").alias("last")
    sizes = stage.write(signals.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), *ends).where(F.col("n") > pad))
    rows = signals.select("sample_id", "idx", "amplitude").join(sizes, "sample_id")
    at = lambda e, x: F.struct(e.alias("at"), x.alias("x"))
    idx, n, x = F.col("idx"), F.col("n"), F.col("amplitude")
    own = F.array(at(idx + pad, x))
    head = F.when((idx > 0) & (idx <= pad), F.array(at(pad - idx, 2 * F.col("first") - x)))
    tail = F.when((idx < n - 1) & (idx >= n - 1 - pad), F.array(at(2 * n - 2 - idx + pad, 2 * F.col("last") - x)))
    none = F.array().cast("array<struct<at:bigint,x:double>>")
    points = rows.select("sample_id", F.explode(F.concat(own, F.coalesce(head, none), F.coalesce(tail, none))).alias("p")).select("sample_id", "p.*")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"])
    blocks = stage.write(dealt(points.withColumn("block", F.floor(F.col("at") / BLOCK)), "sample_id", "block").groupBy("sample_id", "block").agg(ordered.alias("x")))
    done = _pass(_pass(blocks, sections, False, stage), sections, True, stage)
    flat = done.select("sample_id", "block", F.posexplode("x").alias("k", "amplitude")).withColumn("idx", F.col("block") * BLOCK + F.col("k") - pad)
    return flat.join(sizes, "sample_id").where((F.col("idx") >= 0) & (F.col("idx") < F.col("n"))).select("sample_id", "idx", "amplitude")


def envelope_spectrum(signals: DataFrame, rates: DataFrame, low: float, high: float) -> DataFrame:
    """(sample_id, bin, freq, mag): the spectrum of the envelope of the band, for signals of any length."""
    return amplitude_spectrum(envelope(Stage(signals.sparkSession, "band").write(bandpass(signals, low, high))), rates)

"""Amplitude spectra in relational form, their peaks, bands and characteristic frequencies."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tremolo.config import BANDS, DOMINANCE_MARGIN, ENVELOPE_TOLERANCE, FAMILIES, HARMONICS, MIN_ENERGY, PEAK_TOLERANCE, PROMINENCE_RATIO
from tremolo.functions.scalars import band_label
from tremolo.session import dealt


def relational_dft(signals: DataFrame, n: int, fs: float) -> DataFrame:
    """(sample_id, bin, freq, mag) of each sample's first ``n`` points (those that have as many).

    The Hann-windowed discrete transform as a join of points and bins and two sums; the
    magnitude is 2/n of the modulus, of the first bin and an even length's last one half of that.
    It makes n * n / 2 rows a sample, in the task where its points are: samples are dealt out once, by their
    id. For short windows; longer ones go to the kernels.
    """
    of = Window.partitionBy("sample_id")
    first = dealt(signals.where(F.col("idx") < n), "sample_id").withColumns({"_mean": F.avg("amplitude").over(of), "_n": F.count(F.lit(1)).over(of)}).where(F.col("_n") == n)
    hann = 0.5 - 0.5 * F.cos(F.lit(2 * math.pi) * F.col("idx") / n)
    rows = first.select("sample_id", "idx", ((F.col("amplitude") - F.col("_mean")) * hann).alias("x"))
    rows = rows.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n // 2))))
    turn = F.lit(2 * math.pi) * F.pmod(F.col("idx") * F.col("bin"), F.lit(n)) / n
    sums = rows.groupBy("sample_id", "bin").agg(F.sum(F.col("x") * F.cos(turn)).alias("re"), F.sum(F.col("x") * F.sin(turn)).alias("im"))
    edge = (F.col("bin") == 0) | ((F.col("bin") == n // 2) if n % 2 == 0 else F.lit(False))
    mag = F.sqrt(F.col("re") ** 2 + F.col("im") ** 2) * F.when(edge, 1.0 / n).otherwise(2.0 / n)
    return sums.select("sample_id", F.col("bin").cast("long").alias("bin"), (F.col("bin") * fs / n).alias("freq"), mag.alias("mag"))


def dominant(spectrum: DataFrame) -> DataFrame:
    """(sample_id, dominant_frequency, dominant_amplitude): the largest magnitude, the first if several."""
    top = F.max_by(F.struct("freq", "mag"), F.struct(F.col("mag"), -F.col("bin")))
    return spectrum.groupBy("sample_id").agg(top.alias("t")).select("sample_id", F.col("t.freq").alias("dominant_frequency"), F.col("t.mag").alias("dominant_amplitude"))


def band_edges(given: list | None, fs: float) -> list[float]:
    """Edges of bands: five equal ones up to the Nyquist frequency, rising numbers, or pairs of which each begins where the one before ends.

    ValueError if they don't rise. Of pairs the first's lower and all upper edges count.
    """
    if given is None:
        return equal_bands(fs)
    if given and all(isinstance(x, (list, tuple)) and len(x) == 2 for x in given):
        given = [given[0][0], *(high for _, high in given)]
    try:
        edges = [float(x) for x in given]
    except (TypeError, ValueError) as e:
        raise ValueError("invalid_argument: band edges must be numbers") from e
    if len(edges) < 2 or any(not b > a for a, b in zip(edges, edges[1:])):
        raise ValueError("invalid_argument: band edges must rise")
    return edges


def band_energy(spectrum: DataFrame, edges: list) -> DataFrame:
    """(sample_id, band, label, energy): squared magnitudes by band; the last band holds its upper edge.

    Bands are told by comparisons alone, so that the test is compiled wherever Spark moves it.
    """
    edges = band_edges(edges, 0.0)
    last = len(edges) - 2
    band = F.when(F.col("freq") < edges[0], None)
    for k, high in enumerate(edges[1:]):
        band = band.when(F.col("freq") < high if k < last else F.col("freq") <= high, k)
    rows = spectrum.select("sample_id", band.alias("band"), (F.col("mag") ** 2).alias("e")).groupBy("sample_id", "band").agg(F.sum("e").alias("energy")).where("band IS NOT NULL")
    at = lambda k: F.element_at(F.array(*map(F.lit, edges)), (k + 1).cast("int"))
    return rows.select("sample_id", F.col("band").cast("long").alias("band"), band_label(at(F.col("band")), at(F.col("band") + 1)).alias("label"), "energy")


def equal_bands(fs: float, n: int = BANDS) -> list[float]:
    return [fs / 2 * k / n for k in range(n + 1)]


def local_maxima(spectrum: DataFrame) -> DataFrame:
    """Rows higher than both neighbours; of a plateau its middle (rounded down); ends never."""
    order = Window.partitionBy("sample_id").orderBy("bin")
    fresh = F.when(F.lag("mag").over(order).eqNullSafe(F.col("mag")), 0).otherwise(1)
    places = F.array_sort(F.collect_list(F.struct("bin", "freq")))
    runs = spectrum.withColumn("_fresh", fresh).withColumn("_run", F.sum("_fresh").over(order)).groupBy("sample_id", "_run").agg(places.alias("_p"), F.first("mag").alias("mag"))
    along = Window.partitionBy("sample_id").orderBy("_run")
    tops = runs.withColumn("_l", F.lag("mag").over(along)).withColumn("_r", F.lead("mag").over(along)).where("_l < mag AND _r < mag")
    return tops.withColumn("_p", F.get("_p", F.floor((F.size("_p") - 1) / 2).cast("int"))).select("sample_id", "_p.*", "mag")


class _Basins:
    """Peaks of one spectrum with their prominences, from its points in order, by a stack of falling heights.

    A point leaves the stack when a higher one comes; then all that its prominence depends on has passed: the least values
    back to the last higher point and on to this one. Held are the points not passed by a higher one yet.
    """

    def __init__(self) -> None:
        self.run: list[tuple] = []  # (bin, freq) of the plateau at hand
        self.level = self.before = None
        # [height, (bin, freq) if a peak, least to the left, least after it]; the end before the first point stands as a wall
        self.stack: list[list] = [[math.inf, None, math.inf, math.inf]]

    def point(self, bin: int, freq: float, mag: float) -> Iterator[tuple]:
        if self.run and mag == self.level:
            self.run.append((bin, freq))
            return
        if self.run:
            yield from self._push(self.before is not None and self.before < self.level and mag < self.level)
            self.before = self.level
        self.run, self.level = [(bin, freq)], mag

    def end(self) -> Iterator[tuple]:
        if self.run:
            yield from self._push(False)
        while len(self.stack) > 1:
            yield from self._pop()

    def _push(self, peak: bool) -> Iterator[tuple]:
        h = self.level
        while self.stack[-1][0] < h:
            yield from self._pop()
        last = self.stack[-1]
        last[3] = left = min(last[3], h)
        if last[0] == h:  # as high is no wall: what lies before it counts too
            left = min(left, last[2])
        self.stack.append([h, self.run[(len(self.run) - 1) // 2] if peak else None, left, h])

    def _pop(self) -> Iterator[tuple]:
        height, place, left, right = self.stack.pop()
        self.stack[-1][3] = min(self.stack[-1][3], right)
        if place:
            yield *place, height, height - max(left, right)


def prominences(spectrum: DataFrame) -> DataFrame:
    """Local maxima with their prominence: height above the higher of the two lowest points between
    the peak and the next higher value on either side (or the end).

    One pass over each sample's points in order, as a stream: no join, and no spectrum is held whole. Null
    magnitudes count as no point.
    """
    schema = spectrum.select("sample_id", "bin", "freq", "mag").schema.add("prominence", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, basins, out = None, None, []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out)) or [[]] * len(schema)
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], names=schema.names)
            out.clear()
            return made

        arrow = to_arrow_schema(schema)
        for rows in batches:
            for sample, bin, freq, mag in zip(*(c.to_pylist() for c in rows.columns)):
                if basins is None or sample != now:
                    out += ((now, *p) for p in basins.end()) if basins else ()
                    now, basins = sample, _Basins()
                out += ((now, *p) for p in basins.point(bin, freq, mag))
            yield batch()
        if basins:
            out += ((now, *p) for p in basins.end())
            yield batch()

    ordered = spectrum.where("mag IS NOT NULL").select("sample_id", "bin", "freq", "mag").repartition("sample_id").sortWithinPartitions("sample_id", "bin")
    return ordered.mapInArrow(run, schema)


def prominent(peaks: DataFrame, spectrum: DataFrame, ratio: float = PROMINENCE_RATIO) -> DataFrame:
    """Peaks above 0 Hz with at least ``ratio`` of the spectrum's maximum as prominence."""
    top = spectrum.groupBy("sample_id").agg(F.max("mag").alias("_top")).where("_top > 0")
    return peaks.join(top, "sample_id").where((F.col("prominence") >= ratio * F.col("_top")) & (F.col("freq") > 0)).drop("_top")


def harmonic_targets(frequencies: DataFrame, harmonics: tuple[int, ...] = HARMONICS) -> DataFrame:
    """(key columns, family, family_pos, harmonic, target) from one column for each family."""
    keys = [c for c in frequencies.columns if c not in FAMILIES]
    family = F.explode(F.array(*[F.struct(F.lit(f).alias("family"), F.lit(k).cast("long").alias("family_pos"), F.col(f).alias("base")) for k, f in enumerate(FAMILIES)]))
    rows = frequencies.select(*keys, family.alias("f")).select(*keys, "f.*", F.explode(F.array(*map(F.lit, harmonics))).alias("harmonic"))
    return rows.select(*keys, "family", "family_pos", F.col("harmonic").cast("long").alias("harmonic"), (F.col("base") * F.col("harmonic")).alias("target"))


def nearest_matches(peaks: DataFrame, targets: DataFrame, resolution: float, tolerance: float = PEAK_TOLERANCE) -> DataFrame:
    """For each sample and target the nearest peak (the lower one, if equally near) within tolerance.

    ``targets`` holds a dozen rows for all samples, or has a sample_id of its own. A merge: peaks and targets stand
    in one order of frequency, and each target looks back to the last peak and forth to the next; no pairs are made.
    """
    names = ["family", "harmonic", "target"]
    kinds = dict(targets.dtypes)
    peak = F.struct("freq", "mag")
    none = lambda c: F.lit(None).cast(kinds[c]).alias(c)
    if "sample_id" in targets.columns:
        blank = F.lit(None).cast(f"struct<freq:{dict(peaks.dtypes)['freq']},mag:{dict(peaks.dtypes)['mag']}>")
        both = peaks.select("sample_id", F.col("freq").alias("_at"), peak.alias("_peak"), *map(none, names)).unionByName(targets.select("sample_id", F.col("target").alias("_at"), blank.alias("_peak"), *names))
    else:  # a sample's first peak brings them all with it
        all_targets = targets.agg(F.collect_list(F.struct(*names)).alias("_t"))
        first = F.row_number().over(Window.partitionBy("sample_id").orderBy("freq")) == 1
        own = F.array(F.struct(F.col("freq").alias("_at"), peak.alias("_peak"), *map(none, names)))
        asked = F.transform("_t", lambda t: F.struct(t["target"].alias("_at"), F.when(F.lit(False), peak).alias("_peak"), *[t[c].alias(c) for c in names]))
        rows = peaks.withColumn("_first", first).join(F.broadcast(all_targets))
        both = rows.select("sample_id", F.explode(F.when(F.col("_first"), F.concat(own, asked)).otherwise(own)).alias("_r")).select("sample_id", "_r.*")
    of = Window.partitionBy("sample_id")
    last = F.last("_peak", ignorenulls=True).over(of.orderBy("_at", F.col("_peak").isNull()).rowsBetween(Window.unboundedPreceding, 0))
    after = F.last("_peak", ignorenulls=True).over(of.orderBy(F.desc("_at"), F.col("_peak").isNull()).rowsBetween(Window.unboundedPreceding, 0))
    gap = lambda p: F.abs(p["freq"] - F.col("target"))
    met = both.withColumn("_b", last).withColumn("_a", after).where(F.col("target").isNotNull())
    near = F.when(gap(F.col("_a")) < gap(F.col("_b")), F.col("_a")).otherwise(F.coalesce("_b", "_a"))
    close = gap(F.col("_n")) <= F.greatest(tolerance * F.col("target"), F.lit(resolution))
    found = met.withColumn("_n", near).where(close)
    return found.select("sample_id", *names, F.col("_n.freq").alias("nearest_peak"), F.col("_n.mag").alias("peak_amplitude"), (gap(F.col("_n")) / F.col("target") * 100).alias("deviation_pct"))


def family_energy(spectrum: DataFrame, targets: DataFrame, resolution: float, tolerance: float = ENVELOPE_TOLERANCE) -> DataFrame:
    """Squared magnitudes within tolerance of a family's harmonics. Windows may overlap; a bin counts in each.

    A range join: bins and targets meet in cells as wide as the widest window, so each
    bin is compared with the targets of its own and the two next cells only.
    """
    reach = F.greatest(tolerance * F.col("target"), F.lit(resolution))
    width = F.lit(max(resolution, 1e-9) * 64)
    span = F.sequence(F.floor((F.col("target") - reach) / width), F.floor((F.col("target") + reach) / width))
    cells = targets.withColumn("_reach", reach).withColumn("_cell", F.explode(span))
    rows = spectrum.withColumn("_cell", F.floor(F.col("freq") / width))
    on = ["_cell"] + (["sample_id"] if "sample_id" in targets.columns else [])
    met = rows.join(cells, on).where(F.abs(F.col("freq") - F.col("target")) <= F.col("_reach"))
    return met.groupBy("sample_id", "family", "family_pos").agg(F.sum(F.col("mag") ** 2).alias("energy"))


def family_ranks(energy: DataFrame) -> DataFrame:
    """Families by energy (ties: their fixed order), the leader's margin over the second, and whether it is a tie."""
    order = Window.partitionBy("sample_id").orderBy(F.desc("energy"), "family_pos")
    rows = energy.withColumn("rank", F.row_number().over(order).cast("long")).withColumn("_next", F.lead("energy").over(order))
    margin = F.when((F.col("rank") == 1) & (F.col("_next") > 0), F.col("energy") / F.col("_next"))
    rows = rows.withColumn("margin", margin)
    return rows.select("sample_id", "family", "energy", "rank", "margin", ((F.col("rank") == 1) & (F.col("energy") >= MIN_ENERGY)).alias("is_dominant"), F.coalesce(margin < DOMINANCE_MARGIN, F.lit(False)).alias("ambiguous"))

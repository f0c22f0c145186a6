"""Signals as long tables: (sample_id, idx, ts, amplitude), and what is computed by sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremolo.functions.scalars import rounded


#: Points to a block where neighbours are looked up.
BLOCK = 4096


def indexed(df: DataFrame, key: str, block: Column, *order: str) -> DataFrame:
    """``df`` with idx, the row's place (from 0) by ``order`` within ``key``.

    ``block`` must not fall as the order rises. Rows are numbered within blocks, and blocks are
    offset by the sums of those before, so no task needs all rows of a key.
    """
    rows = df.withColumn("_block", block)
    within = F.row_number().over(Window.partitionBy(key, "_block").orderBy(*order)) - 1
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = rows.groupBy(key, "_block").agg(F.count(F.lit(1)).alias("_n")).select(key, "_block", F.coalesce(before, F.lit(0)).alias("_before"))
    numbered = rows.withColumn("_k", within).join(offsets, [key, "_block"])
    return numbered.withColumn("idx", (F.col("_k") + F.col("_before")).cast("long")).drop("_block", "_k", "_before")


def from_events(events: DataFrame) -> DataFrame:
    """The events of each type as a signal, in the order of (ts, event_id)."""
    rows = events.where("event_type IS NOT NULL AND value IS NOT NULL").select(F.col("event_type").alias("sample_id"), "ts", "event_id", F.col("value").alias("amplitude"))
    made = indexed(rows, "sample_id", F.date_trunc("day", "ts"), "ts", "event_id")
    return made.select("sample_id", "idx", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), "amplitude")


def unbiased_kurtosis(x: Column) -> Column:
    """Pearson's kurtosis without bias (3 for a normal law); of 3 values or fewer the biased one, of constants 0."""
    n, g = F.count(x).cast("double"), F.kurtosis(x)
    whole = ((n - 1) * ((n + 1) * g + 6)) / ((n - 2) * (n - 3)) + 3
    return F.coalesce(F.when(n > 3, whole).otherwise(g + 3), F.lit(0.0))


def stats(signals: DataFrame, *by: str, x: str = "amplitude") -> DataFrame:
    """n, mean, and rms, peak, kurtosis and crest factor of the values less their mean.

    One aggregation: the centred root mean square is the standard deviation, the centred peak
    comes from the extremes. Values aren't rounded here.
    """
    by = by or ("sample_id",)
    v = F.col(x)
    sums = signals.groupBy(*by).agg(F.count(v).alias("n_samples"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("rms"), F.min(v).alias("_lo"), F.max(v).alias("_hi"), unbiased_kurtosis(v).alias("kurtosis"))
    peak = F.greatest(F.col("_hi") - F.col("mean"), F.col("mean") - F.col("_lo"))
    crest = F.when(F.col("rms") > 0, peak / F.col("rms")).otherwise(0.0)
    return sums.select(*by, "n_samples", "mean", "rms", peak.alias("peak"), "kurtosis", crest.alias("crest_factor"))


def rounded_stats(signals: DataFrame) -> DataFrame:
    s = stats(signals)
    return s.select("sample_id", "n_samples", *[rounded(F.col(c)).alias(c) for c in ("rms", "peak", "kurtosis", "crest_factor")])


def sampling_rate(signals: DataFrame) -> DataFrame:
    """(sample_id, rate): one over the median interval; null with under two points or a median of 0 or less.

    Intervals are taken within blocks of points, those between blocks from their last and first
    points. The median is of counted intervals, which tasks add up before they meet.
    """
    rows = signals.withColumn("_block", F.floor(F.col("idx") / BLOCK).cast("long"))
    inner = rows.select("sample_id", (F.col("ts") - F.lag("ts").over(Window.partitionBy("sample_id", "_block").orderBy("idx"))).alias("_d"), (F.col("idx") % BLOCK == 0).alias("_first")).where("NOT _first").drop("_first")
    ends = rows.where((F.col("idx") % BLOCK == 0) | ((F.col("idx") + 1) % BLOCK == 0)).groupBy("sample_id", (F.floor((F.col("idx") + 1) / BLOCK)).alias("_at"))
    border = ends.agg(F.max(F.when(F.col("idx") % BLOCK == 0, F.col("ts"))).alias("_a"), F.max(F.when((F.col("idx") + 1) % BLOCK == 0, F.col("ts"))).alias("_z"))
    steps = inner.unionByName(border.where("_a IS NOT NULL AND _z IS NOT NULL").select("sample_id", (F.col("_a") - F.col("_z")).alias("_d")))
    counted = steps.where("_d IS NOT NULL").groupBy("sample_id", "_d").agg(F.count(F.lit(1)).alias("_n"))
    known = signals.select("sample_id").distinct()
    median = known.join(counted.groupBy("sample_id").agg(F.percentile("_d", F.lit(0.5), F.col("_n")).alias("_m")), "sample_id", "left")
    return median.select("sample_id", F.when(F.col("_m") > 0, 1 / F.col("_m")).alias("rate"))


def count_windows(signals: DataFrame, size: int) -> DataFrame:
    """Statistics of whole, non-overlapping windows of ``size`` points."""
    windows = signals.withColumn("window", F.floor(F.col("idx") / size).cast("long"))
    return stats(windows, "sample_id", "window").where(F.col("n_samples") == size)


def window_checks(signals: DataFrame, size: int) -> DataFrame:
    """Of each whole window: its non-finite values, and whether all are zero; ``usable`` if neither."""
    bad = F.isnan("amplitude") | (F.abs("amplitude") == float("inf"))
    w = signals.groupBy("sample_id", F.floor(F.col("idx") / size).cast("long").alias("window"))
    rows = w.agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("non_finite"), F.bool_and(F.col("amplitude") == 0).alias("all_zero"))
    return rows.where(F.col("n") == size).select("sample_id", "window", "non_finite", "all_zero", ((F.col("non_finite") == 0) & ~F.col("all_zero")).alias("usable"))


def bucketed(signals: DataFrame, points: int, at: str = "idx") -> DataFrame:
    """``signals`` with bucket: of n points in order, c = min(points, n) buckets; the i-th begins at floor(i n / c)."""
    sizes = signals.groupBy("sample_id").agg(F.count(F.lit(1)).alias("_n"))
    c = F.least(F.lit(points), F.col("_n"))
    bucket = F.floor((((F.col(at) + 1) * c) - 1) / F.col("_n")).cast("long")
    return signals.join(sizes, "sample_id").withColumn("bucket", bucket).drop("_n")


def bucket_minmax(signals: DataFrame, points: int) -> DataFrame:
    """A waveform's envelope for plots: the least and largest value of each bucket."""
    return bucketed(signals, points).groupBy("sample_id", "bucket").agg(F.min("amplitude").alias("lo"), F.max("amplitude").alias("hi"))


def bucket_argmax(spectrum: DataFrame, points: int) -> DataFrame:
    """A spectrum thinned without loss of peaks: each bucket's largest magnitude (the first, if equal) and its frequency."""
    top = F.max_by(F.struct("freq", "mag"), F.struct(F.col("mag"), -F.col("bin")))
    rows = bucketed(spectrum, points, "bin").groupBy("sample_id", "bucket").agg(top.alias("t"))
    return rows.select("sample_id", "bucket", "t.freq", "t.mag")

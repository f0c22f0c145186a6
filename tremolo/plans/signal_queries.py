"""Signal queries over the events table: each event type is a signal, ``view`` is the baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremolo import config
from tremolo.functions.scalars import change, fault_frequencies, rounded
from tremolo.operators import signals as sig
from tremolo.operators import spectra
from tremolo.session import Stage

#: Points of a window for short spectra, and its nominal rate (bins are then 1 Hz apart).
N, FS = 256, 256.0
RPM = 600.0
BASELINE = "view"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _signals(spark, sf_dir):
    return sig.from_events(load(spark, sf_dir, "events"))


def _r(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in names})


def signal_stats(spark, sf_dir):
    return _r(sig.stats(_signals(spark, sf_dir)), "mean", "rms", "peak", "kurtosis", "crest_factor")


_STATS = """SELECT event_type AS sample_id, count(*) AS n_samples, avg(value) AS mean, stddev_pop(value) AS rms,
  greatest(max(value) - avg(value), avg(value) - min(value)) AS peak, kurtosis(value) + 3 AS kurtosis
  FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL GROUP BY event_type"""
_SIGNAL = """SELECT event_type AS sample_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS idx,
  epoch_us(ts) / 1e6 AS ts, value AS amplitude FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL"""


def sampling_rate_inference(spark, sf_dir):
    return _r(sig.sampling_rate(_signals(spark, sf_dir)), "rate", digits=8)


def _pairs(stats: DataFrame) -> DataFrame:
    base = stats.where(F.col("sample_id") == BASELINE)
    n = base.select(*[F.col(c).alias(f"n_{c}") for c in base.columns])
    return stats.where(F.col("sample_id") != BASELINE).join(n, F.lit(BASELINE) == F.col("n_sample_id"))


_NAMES = ("rms", "peak", "kurtosis", "crest_factor")


def compare_changes(spark, sf_dir):
    pairs = _pairs(sig.stats(_signals(spark, sf_dir)))
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"n_{f}").alias("normal"), F.col(f).alias("abnormal")) for f in _NAMES]))
    rows = pairs.select("sample_id", rows.alias("f")).select("sample_id", "f.*")
    block = change(F.col("normal"), F.col("abnormal"))
    return rows.select("sample_id", "feature", block.alias("c")).select("sample_id", "feature", "c.*")


_CHANGES = f"""WITH s AS ({_STATS}), t AS (SELECT *, CASE WHEN rms > 0 THEN peak / rms ELSE 0 END AS crest_factor FROM s),
  l AS ({' UNION ALL '.join(f"SELECT sample_id, '{f}' AS feature, {f} AS v FROM t" for f in _NAMES)})
  SELECT a.sample_id, a.feature, round(n.v, 4) AS normal, round(a.v, 4) AS abnormal, round(a.v - n.v, 4) AS delta,
    CASE WHEN n.v <> 0 THEN round(a.v / n.v, 4) END AS ratio
  FROM l a JOIN l n ON a.feature = n.feature AND n.sample_id = '{BASELINE}' WHERE a.sample_id <> '{BASELINE}'"""


def changed_features(spark, sf_dir):
    rows = compare_changes(spark, sf_dir)
    off = F.abs(F.col("ratio") - 1)
    flagged = rows.withColumn("changed", F.coalesce(off >= config.CHANGE_THRESHOLD, F.lit(False)))
    return flagged.select("sample_id", "feature", "ratio", "changed")


def count_windows(spark, sf_dir):
    return _r(sig.count_windows(_signals(spark, sf_dir), 100).select("sample_id", "window", "n_samples", "rms", "peak"), "rms", "peak")


def window_checks(spark, sf_dir):
    return sig.window_checks(_signals(spark, sf_dir), 100)


def bucket_minmax(spark, sf_dir):
    return sig.bucket_minmax(_signals(spark, sf_dir), config.WAVEFORM_POINTS)


def _blocks(spark, sf_dir, points: int) -> DataFrame:
    """Every whole block of so many points of each event type: a sample each, named by type and block. A type's last points, fewer than a block, are left over."""
    rows = _signals(spark, sf_dir).withColumn("block", F.floor(F.col("idx") / points))
    whole = F.count(F.lit(1)).over(Window.partitionBy("sample_id", "block"))
    rows = rows.withColumn("_n", whole).where(F.col("_n") == points)
    return rows.select(F.concat("sample_id", F.lit("-"), F.col("block").cast("string")).alias("sample_id"), F.col("sample_id").alias("kind"), "block", (F.col("idx") % points).alias("idx"), "amplitude")


def _dft(spark, sf_dir):
    return spectra.relational_dft(_blocks(spark, sf_dir, N).select("sample_id", "idx", "amplitude"), N, FS)


_DFT = f"""g AS ({_SIGNAL}), f AS (SELECT sample_id || '-' || (idx // {N}) AS sample_id, idx % {N} AS idx, amplitude FROM g),
  m AS (SELECT sample_id, avg(amplitude) AS mean FROM f GROUP BY 1 HAVING count(*) = {N}),
  x AS (SELECT sample_id, idx, (amplitude - mean) * (0.5 - 0.5 * cos(2 * pi() * idx / {N})) AS x FROM f JOIN m USING (sample_id)),
  d AS (SELECT sample_id, bin, sum(x * cos(2 * pi() * ((idx * bin) % {N}) / {N})) AS re, sum(x * sin(2 * pi() * ((idx * bin) % {N}) / {N})) AS im
    FROM x, range(0, {N // 2 + 1}) AS b(bin) GROUP BY 1, 2),
  spec AS (SELECT sample_id, bin, bin * {FS} / {N} AS freq, sqrt(re * re + im * im) * CASE WHEN bin IN (0, {N // 2}) THEN 1.0 ELSE 2.0 END / {N} AS mag FROM d)"""


def dft_spectrum(spark, sf_dir):
    return _r(_dft(spark, sf_dir), "mag")


def dominant_frequency(spark, sf_dir):
    return _r(spectra.dominant(_dft(spark, sf_dir)), "dominant_amplitude")


def band_energy(spark, sf_dir):
    return _r(spectra.band_energy(_dft(spark, sf_dir), spectra.equal_bands(FS)), "energy")


_BANDS = f"""bands AS (SELECT sample_id, least(CAST(floor(freq / {FS / 2 / config.BANDS}) AS BIGINT), {config.BANDS - 1}) AS band, sum(mag * mag) AS energy FROM spec GROUP BY 1, 2)"""
_EDGES = spectra.equal_bands(FS)


def _text(x: float) -> str:
    return f"{x:.0f}" if x == int(x) else f"{x:.1f}"


_LABEL = "CASE band " + " ".join(f"WHEN {k} THEN '{_text(_EDGES[k])}-{_text(_EDGES[k + 1])}Hz'" for k in range(config.BANDS)) + " END"


def band_change_outer(spark, sf_dir):
    """Union of the bands of each window and of the baseline's of the same number; what one lacks counts as 0; the band of the largest change is marked."""
    e = spectra.band_energy(_dft(spark, sf_dir), spectra.equal_bands(FS))
    e = e.withColumns({"kind": F.substring_index("sample_id", "-", 1), "window": F.substring_index("sample_id", "-", -1)})
    n = e.where(F.col("kind") == BASELINE).select("window", "band", F.col("energy").alias("n"))
    a = e.where(F.col("kind") != BASELINE)
    n = a.select("sample_id", "window").distinct().join(n, "window").drop("window")
    both = n.join(a.select("sample_id", "band", F.col("energy").alias("a")), ["sample_id", "band"], "full_outer").na.fill(0.0, ["n", "a"])
    rank = F.row_number().over(Window.partitionBy("sample_id").orderBy(F.desc(F.abs(F.col("a") - F.col("n"))), "band"))
    rows = both.select("sample_id", "band", F.col("n").alias("normal"), F.col("a").alias("abnormal"), (F.col("a") - F.col("n")).alias("delta"), (rank == 1).alias("largest"))
    return _r(rows, "normal", "abnormal", "delta", digits=3)


def local_maxima_prominence(spark, sf_dir):
    return _r(spectra.prominences(_dft(spark, sf_dir)), "mag", "prominence")


def _targets(spark) -> DataFrame:
    f = fault_frequencies(F.lit(RPM))
    return spectra.harmonic_targets(spark.range(1).select(*[f[x].alias(x) for x in config.FAMILIES]))


_FREQ = {x: round(v, 4) for x, v in {
    "bpfo": RPM / 60 * config.BALLS / 2 * (1 - config.BALL_DIAMETER / config.PITCH_DIAMETER), "bpfi": RPM / 60 * config.BALLS / 2 * (1 + config.BALL_DIAMETER / config.PITCH_DIAMETER),
    "bsf": RPM / 60 * config.PITCH_DIAMETER / (2 * config.BALL_DIAMETER) * (1 - (config.BALL_DIAMETER / config.PITCH_DIAMETER) ** 2), "ftf": RPM / 120 * (1 - config.BALL_DIAMETER / config.PITCH_DIAMETER),
}.items()}
_TARGETS = "targets(family, family_pos, harmonic, target) AS (VALUES " + ", ".join(f"('{f}', {k}, {h}, CAST({_FREQ[f]} AS DOUBLE) * {h})" for k, f in enumerate(config.FAMILIES) for h in (1, 2, 3)) + ")"
_PEAKS = "maxima AS (SELECT * FROM (SELECT *, lag(mag) OVER w AS l, lead(mag) OVER w AS r FROM spec WINDOW w AS (PARTITION BY sample_id ORDER BY bin)) WHERE l < mag AND r < mag)"


def harmonic_nearest_match(spark, sf_dir):
    found = spectra.nearest_matches(spectra.local_maxima(_dft(spark, sf_dir)), _targets(spark), FS / N)
    return _r(found, "target", "nearest_peak", "peak_amplitude", "deviation_pct", digits=3)


def _energy(spark, sf_dir):
    return spectra.family_energy(_dft(spark, sf_dir), _targets(spark), FS / N)


def family_energy_range_join(spark, sf_dir):
    return _r(_energy(spark, sf_dir), "energy")


_FAMILY = f"energy AS (SELECT sample_id, family, family_pos, sum(mag * mag) AS energy FROM spec JOIN targets ON abs(freq - target) <= greatest({config.ENVELOPE_TOLERANCE} * target, {FS / N}) GROUP BY 1, 2, 3)"


def family_rank_margin(spark, sf_dir):
    return _r(spectra.family_ranks(_energy(spark, sf_dir)), "energy", "margin")


def bucket_argmax(spark, sf_dir):
    return _r(sig.bucket_argmax(_dft(spark, sf_dir), 20), "mag")


def long_spectrum(spark, sf_dir):
    """The spectrum of each event type's whole signal, whatever its length, at a rate of FS."""
    from tremolo.operators.long_signals import amplitude_spectrum

    signals = _signals(spark, sf_dir)
    rates = signals.select("sample_id").distinct().withColumn("fs", F.lit(FS))
    return _r(amplitude_spectrum(Stage(spark, "long").write(signals), rates), "freq", "mag", digits=5)


def long_envelope_peaks(spark, sf_dir):
    """Prominent peaks of the envelope spectrum of each event type's whole signal; no SQL can express the filter."""
    from tremolo.operators.long_signals import envelope_spectrum

    signals = _signals(spark, sf_dir)
    rates = signals.select("sample_id").distinct().withColumn("fs", F.lit(DIAGNOSIS_FS))
    spectrum = Stage(spark, "long").write(envelope_spectrum(Stage(spark, "long").write(signals), rates, *config.RESONANCE_BAND))
    return _r(spectra.prominent(spectra.prominences(spectrum), spectrum), "freq", "mag", "prominence")


def fault_frequency_table(spark, sf_dir):
    part = load(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 60.0).alias("rpm"))
    f = fault_frequencies(F.col("rpm"))
    return part.select("p_partkey", *[F.round(c, 3).alias(x) for x, c in f.items()])


_RATIO = config.BALL_DIAMETER / config.PITCH_DIAMETER


def quality_checks(spark, sf_dir):
    """Of each event type against the baseline: lengths, comparability and rate as in validation."""
    from tremolo.operators.validate import length_checks

    n = load(spark, sf_dir, "events").groupBy(F.col("event_type").alias("sample_id")).agg(F.count("value").alias("n"), F.count_if(F.col("value").isNull()).alias("missing"))
    b = n.where(F.col("sample_id") == BASELINE).select(F.col("n").alias("n_normal"))
    rows = n.where(F.col("sample_id") != BASELINE).join(b, F.lit(True))
    return length_checks(rows.select("sample_id", "missing", "n_normal", F.col("n").alias("n_abnormal")))


#: A diagnosis compares two signals of so many points at this rate.
DIAGNOSIS_POINTS, DIAGNOSIS_FS, DIAGNOSIS_RPM = 1024, 12000.0, 1797.0


def envelope_features(spark, sf_dir):
    """Kernel features of each whole block, envelopes included; no SQL can express the filter."""
    from tremolo.operators.features import extract_features

    blocks = _blocks(spark, sf_dir, DIAGNOSIS_POINTS)
    samples = blocks.select("sample_id").distinct().withColumns({"sampling_rate": F.lit(DIAGNOSIS_FS), "rotation_speed": F.lit(DIAGNOSIS_RPM)})
    f = extract_features(blocks, samples)
    e = F.col("envelope.characteristic_energy")
    return f.select("sample_id", "n_samples", "rms", "kurtosis", "crest_factor", "dominant_frequency", *[e[x].alias(x) for x in config.FAMILIES], F.size("spectrum_peaks").alias("peaks"), F.size("envelope.envelope_peaks").alias("envelope_peaks"))


def diagnosis_batch(spark, sf_dir):
    """Every block of another type compared with the baseline's of the same number: features, comparison, clauses, ranks.

    A type's last points, fewer than a block, and blocks whose number the baseline lacks are rows with a status of their own.
    """
    from tremolo.operators import rules
    from tremolo.operators.compare import compare
    from tremolo.operators.features import extract_features

    stage = Stage(spark, "batch")
    blocks = stage.write(_blocks(spark, sf_dir, DIAGNOSIS_POINTS))
    ids = stage.write(blocks.select("sample_id", "kind", "block").distinct())
    samples = ids.select("sample_id", F.lit(DIAGNOSIS_FS).alias("sampling_rate"), F.lit(DIAGNOSIS_RPM).alias("rotation_speed"))
    # Written, as the comparison reads them for either side; and the comparison, as the clauses read each of its columns often.
    features = stage.write(extract_features(blocks, samples))
    base = ids.where(F.col("kind") == BASELINE).select("block", F.col("sample_id").alias("normal_id"))
    asked = ids.where(F.col("kind") != BASELINE).join(base, "block", "left")
    pairs = asked.where("normal_id IS NOT NULL").select(F.col("sample_id").alias("request_id"), "normal_id", F.col("sample_id").alias("abnormal_id"), F.lit(DIAGNOSIS_FS).alias("sampling_rate"), F.lit(DIAGNOSIS_RPM).alias("rotation_speed"))
    checks = rules.checked(stage.write(compare(pairs, features)), rules.clause_table(spark))
    done = rules.tallied(checks, "request_id", "fault_type").withColumn("status", F.lit("compared"))
    alone = asked.where("normal_id IS NULL").select(F.col("sample_id").alias("request_id"), F.lit("no_baseline").alias("status"))
    n = _signals(spark, sf_dir).groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))
    rest = n.where((F.col("n") % DIAGNOSIS_POINTS > 0) & (F.col("sample_id") != BASELINE))
    short = rest.select(F.concat("sample_id", F.lit("-"), F.floor(F.col("n") / DIAGNOSIS_POINTS).cast("string")).alias("request_id"), F.lit("short_block").alias("status"))
    return done.unionByName(alone.unionByName(short), allowMissingColumns=True)


QUERIES = {
    "envelope_features": envelope_features,
    "diagnosis_batch": diagnosis_batch,
    "changed_features": changed_features,
    "signal_stats": signal_stats,
    "sampling_rate_inference": sampling_rate_inference,
    "compare_changes": compare_changes,
    "count_windows": count_windows,
    "window_checks": window_checks,
    "bucket_minmax": bucket_minmax,
    "bucket_argmax": bucket_argmax,
    "dft_spectrum": dft_spectrum,
    "dominant_frequency": dominant_frequency,
    "band_energy": band_energy,
    "band_change_outer": band_change_outer,
    "local_maxima_prominence": local_maxima_prominence,
    "harmonic_nearest_match": harmonic_nearest_match,
    "family_energy_range_join": family_energy_range_join,
    "family_rank_margin": family_rank_margin,
    "fault_frequencies": fault_frequency_table,
    "long_spectrum": long_spectrum,
    "long_envelope_peaks": long_envelope_peaks,
    "quality_checks": quality_checks,
}

_BUCKET = "((idx + 1) * least({0}, n) - 1) // n"
ORACLE = {
    "signal_stats": f"SELECT sample_id, n_samples, round(mean, 4) AS mean, round(rms, 4) AS rms, round(peak, 4) AS peak, round(kurtosis, 4) AS kurtosis, round(CASE WHEN rms > 0 THEN peak / rms ELSE 0 END, 4) AS crest_factor FROM ({_STATS})",
    "sampling_rate_inference": f"WITH s AS ({_SIGNAL}) SELECT sample_id, round(CASE WHEN m > 0 THEN 1 / m END, 8) AS rate FROM (SELECT sample_id, median(d) AS m FROM (SELECT sample_id, ts - lag(ts) OVER (PARTITION BY sample_id ORDER BY idx) AS d FROM s) GROUP BY 1)",
    "compare_changes": _CHANGES,
    "changed_features": f"SELECT sample_id, feature, ratio, coalesce(abs(ratio - 1) >= {config.CHANGE_THRESHOLD}, false) AS changed FROM ({_CHANGES})",
    "count_windows": f"WITH s AS ({_SIGNAL}) SELECT sample_id, idx // 100 AS window, count(*) AS n_samples, round(stddev_pop(amplitude), 4) AS rms, round(greatest(max(amplitude) - avg(amplitude), avg(amplitude) - min(amplitude)), 4) AS peak FROM s GROUP BY 1, 2 HAVING count(*) = 100",
    "window_checks": f"WITH s AS ({_SIGNAL}) SELECT sample_id, idx // 100 AS window, count(*) FILTER (NOT isfinite(amplitude)) AS non_finite, bool_and(amplitude = 0) AS all_zero, count(*) FILTER (NOT isfinite(amplitude)) = 0 AND NOT bool_and(amplitude = 0) AS usable FROM s GROUP BY 1, 2 HAVING count(*) = 100",
    "bucket_minmax": f"WITH s AS ({_SIGNAL}), t AS (SELECT *, count(*) OVER (PARTITION BY sample_id) AS n FROM s) SELECT sample_id, {_BUCKET.format(config.WAVEFORM_POINTS)} AS bucket, min(amplitude) AS lo, max(amplitude) AS hi FROM t GROUP BY 1, 2",
    "bucket_argmax": f"WITH {_DFT}, t AS (SELECT *, bin AS idx, count(*) OVER (PARTITION BY sample_id) AS n FROM spec), r AS (SELECT *, {_BUCKET.format(20)} AS bucket FROM t), q AS (SELECT *, row_number() OVER (PARTITION BY sample_id, bucket ORDER BY mag DESC, bin) AS k FROM r) SELECT sample_id, CAST(bucket AS BIGINT) AS bucket, freq, round(mag, 4) AS mag FROM q WHERE k = 1",
    "dft_spectrum": f"WITH {_DFT} SELECT sample_id, bin, freq, round(mag, 4) AS mag FROM spec",
    "dominant_frequency": f"WITH {_DFT} SELECT sample_id, freq AS dominant_frequency, round(mag, 4) AS dominant_amplitude FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY mag DESC, bin) AS k FROM spec) WHERE k = 1",
    "band_energy": f"WITH {_DFT}, {_BANDS} SELECT sample_id, band, {_LABEL} AS label, round(energy, 4) AS energy FROM bands",
    "band_change_outer": f"WITH {_DFT}, {_BANDS}, e AS (SELECT *, split_part(sample_id, '-', 1) AS kind, split_part(sample_id, '-', 2) AS w FROM bands), n AS (SELECT w, band, energy FROM e WHERE kind = '{BASELINE}'), a AS (SELECT * FROM e WHERE kind <> '{BASELINE}'), i AS (SELECT DISTINCT sample_id, w FROM a), nn AS (SELECT i.sample_id, n.band, n.energy FROM n JOIN i ON n.w = i.w), j AS (SELECT coalesce(nn.sample_id, a.sample_id) AS sample_id, coalesce(nn.band, a.band) AS band, coalesce(nn.energy, 0) AS n, coalesce(a.energy, 0) AS a FROM nn FULL JOIN a ON nn.sample_id = a.sample_id AND nn.band = a.band) SELECT sample_id, band, round(n, 3) AS normal, round(a, 3) AS abnormal, round(a - n, 3) AS delta, row_number() OVER (PARTITION BY sample_id ORDER BY abs(a - n) DESC, band) = 1 AS largest FROM j",
    "local_maxima_prominence": f"""WITH {_DFT}, {_PEAKS}, w AS (SELECT p.sample_id, p.bin, p.freq, p.mag, max(s.bin) FILTER (s.bin < p.bin AND s.mag > p.mag) AS wl, min(s.bin) FILTER (s.bin > p.bin AND s.mag > p.mag) AS wr FROM maxima p JOIN spec s USING (sample_id) GROUP BY 1, 2, 3, 4),
      q AS (SELECT w.sample_id, w.bin, w.freq, w.mag, min(s.mag) FILTER (s.bin <= w.bin AND s.bin > coalesce(wl, -1)) AS a, min(s.mag) FILTER (s.bin >= w.bin AND s.bin < coalesce(wr, 1000000)) AS z FROM w JOIN spec s ON s.sample_id = w.sample_id GROUP BY 1, 2, 3, 4)
      SELECT sample_id, bin, freq, round(mag, 4) AS mag, round(mag - greatest(a, z), 4) AS prominence FROM q""",
    "harmonic_nearest_match": f"""WITH {_DFT}, {_PEAKS}, {_TARGETS}, j AS (SELECT p.sample_id, t.family, CAST(t.harmonic AS BIGINT) AS harmonic, t.target, p.freq, p.mag, row_number() OVER (PARTITION BY p.sample_id, t.family, t.harmonic ORDER BY abs(p.freq - t.target), p.freq) AS k FROM maxima p, targets t)
      SELECT sample_id, family, harmonic, round(target, 3) AS target, round(freq, 3) AS nearest_peak, round(mag, 3) AS peak_amplitude, round(abs(freq - target) / target * 100, 3) AS deviation_pct FROM j WHERE k = 1 AND abs(freq - target) <= greatest({config.PEAK_TOLERANCE} * target, {FS / N})""",
    "long_spectrum": f"""WITH s AS ({_SIGNAL}), t AS (SELECT sample_id, idx, amplitude, count(*) OVER w AS n, avg(amplitude) OVER w AS mean FROM s WINDOW w AS (PARTITION BY sample_id)),
      x AS (SELECT sample_id, idx, n, (amplitude - mean) * (0.5 - 0.5 * cos(2 * pi() * idx / n)) AS x FROM t), b AS (SELECT sample_id, n, unnest(range(0, n // 2 + 1)) AS bin FROM (SELECT DISTINCT sample_id, n FROM t)),
      d AS (SELECT x.sample_id, x.n, b.bin, sum(x * cos(2 * pi() * ((idx * bin) % x.n) / x.n)) AS re, sum(x * sin(2 * pi() * ((idx * bin) % x.n) / x.n)) AS im FROM x JOIN b ON b.sample_id = x.sample_id GROUP BY 1, 2, 3)
      SELECT sample_id, bin, round(bin * {FS} / n, 5) AS freq, round(sqrt(re * re + im * im) * CASE WHEN bin = 0 OR 2 * bin = n THEN 1.0 ELSE 2.0 END / n, 5) AS mag FROM d""",
    "family_energy_range_join": f"WITH {_DFT}, {_TARGETS}, {_FAMILY} SELECT sample_id, family, CAST(family_pos AS BIGINT) AS family_pos, round(energy, 4) AS energy FROM energy",
    "family_rank_margin": f"""WITH {_DFT}, {_TARGETS}, {_FAMILY}, r AS (SELECT *, row_number() OVER w AS rank, lead(energy) OVER w AS nxt FROM energy WINDOW w AS (PARTITION BY sample_id ORDER BY energy DESC, family_pos)), q AS (SELECT *, CASE WHEN rank = 1 AND nxt > 0 THEN energy / nxt END AS m FROM r)
      SELECT sample_id, family, round(energy, 4) AS energy, rank, round(m, 4) AS margin, rank = 1 AND energy >= {config.MIN_ENERGY} AS is_dominant, coalesce(m < {config.DOMINANCE_MARGIN}, false) AS ambiguous FROM q""",
    "fault_frequencies": f"""WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS shaft FROM part) SELECT p_partkey, round(shaft, 3) AS shaft, round(round(shaft * {config.BALLS / 2} * {1 - _RATIO!r}, 4), 3) AS bpfo, round(round(shaft * {config.BALLS / 2} * {1 + _RATIO!r}, 4), 3) AS bpfi,
      round(round(shaft * {config.PITCH_DIAMETER / (2 * config.BALL_DIAMETER)!r} * {1 - _RATIO**2!r}, 4), 3) AS bsf, round(round(shaft / 2 * {1 - _RATIO!r}, 4), 3) AS ftf FROM p""",
    "quality_checks": f"""WITH n AS (SELECT event_type AS sample_id, count(value) AS n, count(*) - count(value) AS missing FROM events GROUP BY 1), b AS (SELECT n AS n_normal FROM n WHERE sample_id = '{BASELINE}'), j AS (SELECT sample_id, missing, n_normal, n AS n_abnormal FROM n, b WHERE sample_id <> '{BASELINE}')
      SELECT *, n_normal >= {config.MIN_SAMPLES} AND n_abnormal >= {config.MIN_SAMPLES} AS length_ok, n_normal = n_abnormal OR (n_normal >= {config.MIN_SAMPLES} AND n_abnormal >= {config.MIN_SAMPLES}) AS comparable,
      CASE WHEN n_normal > 0 AND n_abnormal > 0 AND n_normal <> n_abnormal THEN CASE WHEN n_normal >= {config.MIN_SAMPLES} AND n_abnormal >= {config.MIN_SAMPLES} THEN 'warning' ELSE 'error' END END AS length_issue FROM j""",
}

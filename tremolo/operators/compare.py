"""Comparison of a suspect sample's features with its baseline's, as struct expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremolo import config
from tremolo.functions.scalars import change, fault_frequencies, formatted, percent, rounded, trend


def _matches(peaks: Column, families: dict[str, Column], resolution: Column) -> Column:
    """The peak nearest to each family's harmonics, the first if several, within tolerance: one pass over an array of the harmonics."""
    targets = F.array(*[F.struct(F.lit(name.upper()).alias("label"), F.lit(order).alias("order"), (families[name] * order).alias("at")) for name in config.FAMILIES for order in config.HARMONICS])

    def nearest(t: Column) -> Column:
        return F.array_min(F.transform(peaks, lambda p, i: F.struct(F.abs(p["frequency"] - t["at"]).alias("gap"), i.alias("i"), p["frequency"].alias("f"), p["amplitude"].alias("a"))))

    def match(m: Column) -> Column:
        t, near = m["t"], m["near"]
        return F.when(near["gap"] <= F.greatest(F.lit(config.PEAK_TOLERANCE) * t["at"], resolution), F.struct(
            t["label"].alias("label"), F.round(t["at"], 4).alias("frequency"), F.round(near["f"], 4).alias("nearest_peak"), F.round(near["gap"] / t["at"] * 100, 2).alias("deviation_pct"),
            F.round(near["a"], 6).alias("peak_amplitude"), t["order"].alias("harmonic_order"),
        ))

    met = F.transform(targets, lambda t: F.struct(t.alias("t"), nearest(t).alias("near")))
    return F.filter(F.transform(met, match), lambda m: m.isNotNull())


def compare(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """One row for each pair (request_id, normal_id, abnormal_id, sampling_rate, rotation_speed): the comparison's blocks.

    Both sides' features are those at the pair's rate and speed.

    Ratios come from features rounded to 6 digits, blocks are rounded to 4. Bands of either side
    count, what one lacks as 0. Without envelopes on both sides characteristic_changes and dominant
    are null; without a rotation speed there are no matches.
    """
    side = lambda k: features.select(*[F.col(c).alias(f"{k}_{c}") for c in features.columns])
    same = lambda k, id: (F.col(id) == F.col(f"{k}_sample_id")) & F.col("sampling_rate").eqNullSafe(F.col(f"{k}_sampling_rate")) & F.col("rotation_speed").eqNullSafe(F.col(f"{k}_rotation_speed"))
    rows = pairs.join(side("n"), same("n", "normal_id")).join(side("a"), same("a", "abnormal_id"))
    blocks = {f: change(F.col(f"n_{f}"), F.col(f"a_{f}"), f != "dominant_frequency") for f in config.FEATURES}
    rows = rows.withColumn("feature_changes", F.struct(*[b.alias(f) for f, b in blocks.items()]))
    labels = F.array_union(F.map_keys("n_band_energy"), F.map_keys("a_band_energy"))
    energy = lambda side, k: F.coalesce(F.element_at(F.col(side), k), F.lit(0.0))
    bands = F.transform(labels, lambda k: F.struct(k.alias("band"), change(energy("n_band_energy", k), energy("a_band_energy", k)).alias("change")))
    rows = rows.withColumn("band_changes", bands)
    n, a = F.col("n_dominant_frequency"), F.col("a_dominant_frequency")
    rows = rows.withColumn("frequency_change", F.struct(n.alias("normal_dominant"), a.alias("abnormal_dominant"), rounded(a - n, 4).alias("shift_hz")))
    off = lambda f: F.abs(F.col(f"feature_changes.{f}.ratio") - 1) >= config.CHANGE_THRESHOLD
    changed = F.filter(F.array(*[F.when(off(f), F.lit(f)) for f in config.FEATURES if f != "dominant_frequency"]), lambda x: x.isNotNull())
    rows = rows.withColumn("changed_features", changed)

    both = F.col("n_envelope").isNotNull() & F.col("a_envelope").isNotNull()

    def family(k: int, f: str) -> Column:
        b, s = F.coalesce(F.col(f"n_envelope.characteristic_energy.{f}"), F.lit(0.0)), F.coalesce(F.col(f"a_envelope.characteristic_energy.{f}"), F.lit(0.0))
        seen = b >= config.BASELINE_DETECTED * s
        return F.struct(
            (-s).alias("_order"), F.lit(k).alias("_pos"), F.lit(f.upper()).alias("label"), F.col(f"a_envelope.characteristic_frequencies.{f}").alias("frequency_hz"), F.round(b, 12).alias("normal"), F.round(s, 12).alias("abnormal"),
            F.round(s - b, 12).alias("delta"), F.when(seen & (b != 0), rounded(F.try_divide(s, b), 4)).alias("ratio"), seen.alias("detected_in_baseline"),
        )

    rows = rows.withColumn("characteristic_changes", F.when(both, F.array(*[family(k, f) for k, f in enumerate(config.FAMILIES)])))
    ranked = F.array_sort("characteristic_changes")
    best, second = F.element_at(ranked, 1), F.element_at(ranked, 2)
    margin = F.when(second["abnormal"] > 0, best["abnormal"] / second["abnormal"])
    tie = F.coalesce(margin < config.DOMINANCE_MARGIN, F.lit(False))
    dominant = F.struct(
        best["label"].alias("label"), best["frequency_hz"].alias("frequency_hz"), F.round(best["abnormal"], 6).alias("abnormal_energy"), best["normal"].alias("normal_energy"), best["ratio"].alias("ratio"), best["detected_in_baseline"].alias("detected_in_baseline"),
        tie.alias("ambiguous"), rounded(margin, 4).alias("margin_ratio"), F.when(tie, F.array(best["label"], second["label"])).otherwise(F.array().cast("array<string>")).alias("tied"),
    )
    rows = rows.withColumn("dominant", F.when(both & (best["abnormal"] >= config.MIN_ENERGY), dominant))
    families = fault_frequencies(F.col("rotation_speed"))
    resolution = F.coalesce(F.col("a_sampling_rate") / F.nullif(F.col("a_n_samples"), F.lit(0)), F.lit(1.0))
    rows = rows.withColumn("fault_frequencies", F.when(F.col("rotation_speed") > 0, F.struct(*[c.alias(k) for k, c in families.items()])))
    rows = rows.withColumn("matches", F.when(F.col("fault_frequencies").isNotNull(), _matches(F.col("a_spectrum_peaks"), {k: F.col(f"fault_frequencies.{k}") for k in families}, resolution)))
    rows = rows.withColumn("evidence", evidence())
    return rows.select("request_id", "feature_changes", "band_changes", "frequency_change", "changed_features", "characteristic_changes", "dominant", "fault_frequencies", "matches", "evidence")


def evidence() -> Column:
    """At most six lines in a fixed order; a line on the dominant amplitude if there are fewer than three."""
    f = lambda name, part: F.col(f"feature_changes.{name}.{part}")
    big = lambda name: F.coalesce(F.abs(f(name, "ratio") - 1) >= config.CHANGE_THRESHOLD, F.lit(False))
    from_to = lambda name, fmt: formatted(f"from {fmt} to {fmt}", f(name, "normal"), f(name, "abnormal"))
    word = F.when(~big("kurtosis"), "no clear change").when(f("kurtosis", "ratio") >= 1, "stronger impulses").otherwise("weaker impulses")
    d = F.col("dominant")
    tied = formatted("envelope energies of %s and %s are too close to rank (ratio %.4f)", F.element_at(d["tied"], 1), F.element_at(d["tied"], 2), d["margin_ratio"])
    leads = formatted("%s (%.1f Hz) and its harmonics hold the most envelope energy (%.4f)", d["label"], d["frequency_hz"], d["abnormal_energy"])
    known = F.filter("band_changes", lambda b: b["change"]["ratio"].isNotNull())
    widest = F.array_max(F.transform(known, lambda b, i: F.struct(F.abs(b["change"]["delta"]).alias("d"), (-i).alias("i"), b.alias("b"))))["b"]
    top = F.array_max(F.transform("a_envelope.characteristic_peaks", lambda p, i: F.struct(p["peak_amplitude"].alias("a"), (-i).alias("i"), p.alias("p"))))["p"]
    shift = F.col("frequency_change")
    lines = F.filter(F.array(
        F.concat(F.lit("RMS "), from_to("rms", "%.4f"), F.lit(", "), trend(f("rms", "ratio")), F.lit(" "), percent(f("rms", "ratio"))),
        F.concat(F.lit("kurtosis "), from_to("kurtosis", "%.2f"), F.lit(", "), word),
        F.when(d.isNotNull(), F.when(d["ambiguous"], tied).otherwise(leads)),
        F.when(d.isNotNull() & top.isNotNull(), formatted("a clear envelope peak at harmonic %d of %s (%.1f Hz, off by %.2f%%)", top["harmonic_order"], top["label"], top["nearest_peak"], top["deviation_pct"])),
        F.when(widest.isNotNull(), F.concat(F.lit("energy of band "), widest["band"], formatted(" from %.6f to %.6f, ", widest["change"]["normal"], widest["change"]["abnormal"]), trend(widest["change"]["ratio"]), F.lit(" "), percent(widest["change"]["ratio"]))),
        F.when(shift["normal_dominant"] != shift["abnormal_dominant"], formatted("dominant frequency moved from %.1f Hz to %.1f Hz", shift["normal_dominant"], shift["abnormal_dominant"])).otherwise(formatted("dominant frequency stays at %.1f Hz", shift["normal_dominant"])),
        F.when(big("peak"), F.concat(F.lit("peak "), from_to("peak", "%.4f"), F.lit(", "), trend(f("peak", "ratio")), F.lit(" "), percent(f("peak", "ratio")))),
        F.when(big("crest_factor"), F.concat(F.lit("crest factor "), from_to("crest_factor", "%.2f"), F.lit(", "), trend(f("crest_factor", "ratio")))),
    ), lambda x: x.isNotNull())
    spare = F.concat(F.lit("dominant amplitude "), from_to("dominant_amplitude", "%.4f"))
    return F.slice(F.when(F.size(lines) < 3, F.array_append(lines, spare)).otherwise(lines), 1, 6)

"""Reports: a struct of sections and its Markdown, one row for each request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremolo import config
from tremolo.functions.scalars import formatted, percent, short_number, trend

SECTIONS = (
    "Subject", "Data quality", "Feature comparison", "Band energy", "Spectrum", "Envelope spectrum", "Evidence", "Knowledge candidates", "Conclusion", "Sources", "Review suggestions",
)
#: What to do next, by conclusion; others get the general line.
ADVICE = {
    "inner_race_fault": "inspect the inner race and look for sidebands at the shaft frequency",
    "outer_race_fault": "inspect the outer race in the load zone",
    "ball_fault": "inspect the rolling elements; compare with the cage frequency",
    "cage_fault": "inspect the cage and the lubrication",
    "misalignment": "check the coupling's alignment",
    "unbalance": "check the rotor's balance",
}


def table(header: list[str], rows: Column) -> Column:
    """A Markdown table of an array of arrays of cells."""
    top = F.lit("| " + " | ".join(header) + " |\n|" + "---|" * len(header) + "\n")
    return F.concat(top, F.array_join(F.transform(rows, lambda r: F.concat(F.lit("| "), F.array_join(r, " | ", "-"), F.lit(" |"))), "\n"))


def bullets(lines: Column) -> Column:
    return F.when(F.size(lines) > 0, F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x)), "\n")).otherwise("- none")


def _feature_rows() -> Column:
    rows = []
    for f in config.FEATURES:
        c = F.col(f"feature_changes.{f}")
        note = F.when(c["ratio"].isNull(), F.lit("-")).otherwise(F.concat(trend(c["ratio"]), F.lit(" "), percent(c["ratio"])))
        rows.append(F.array(F.lit(f), short_number(c["normal"]), short_number(c["abnormal"]), short_number(c["delta"]), short_number(c["ratio"]), note))
    return F.array(*rows)


def _listed(items: Column) -> Column:
    return F.array_join(items, "; ")


def _times(ratio: Column) -> Column:
    return F.coalesce(F.concat(F.lit("about "), short_number(ratio), F.lit(" times")), F.lit("no ratio"))


def changed_bands(most: int = 2) -> Column:
    """The bands whose energy differs most, the widest first; of equal differences the lower band."""
    ranked = F.array_sort(F.transform("band_changes", lambda b, i: F.struct((-F.abs(b["change"]["abnormal"] - b["change"]["normal"])).alias("d"), i.alias("i"), b.alias("b"))))
    return F.transform(F.slice(ranked, 1, most), lambda r: r["b"])


def leading_families(most: int = 3) -> Column:
    """The families of the most envelope energy in the suspect; of equal energies in their fixed order."""
    return F.slice(F.array_sort("characteristic_changes"), 1, most)


def spectrum_notes() -> Column:
    """Lines on the dominant frequency, the bands that changed most, the theoretical frequencies, aligned peaks and changed features."""
    shift, f = F.col("frequency_change"), F.col("fault_frequencies")
    moved = formatted("the dominant frequency moved from %.1f Hz to %.1f Hz (%+.1f Hz)", shift["normal_dominant"], shift["abnormal_dominant"], shift["shift_hz"])
    bands = F.transform(changed_bands(), lambda b: F.concat(b["band"], formatted(" from %.6f to %.6f (", b["change"]["normal"], b["change"]["abnormal"]), _times(b["change"]["ratio"]), F.lit(")")))
    peaks = F.transform("matches", lambda m: F.concat(m["label"], F.when(m["harmonic_order"] > 1, F.concat(F.lit("×"), m["harmonic_order"].cast("string"))).otherwise(""), formatted(" %.2f Hz: peak at %.2f Hz, off by %.2f%%, amplitude ", m["frequency"], m["nearest_peak"], m["deviation_pct"]), short_number(m["peak_amplitude"])))
    return F.filter(F.array(
        F.when(shift["normal_dominant"] == shift["abnormal_dominant"], formatted("the dominant frequency stays at %.1f Hz", shift["normal_dominant"])).otherwise(moved),
        F.when(F.size("band_changes") > 0, F.concat(F.lit("bands that changed most: "), _listed(bands))),
        F.when(f.isNotNull(), formatted("at %.1f rpm: shaft %.2f Hz, BPFO %.2f Hz, BPFI %.2f Hz, BSF %.2f Hz, FTF %.2f Hz", "rotation_speed", f["shaft"], f["bpfo"], f["bpfi"], f["bsf"], f["ftf"])),
        F.when(F.size("matches") > 0, F.concat(F.lit("aligned peaks: "), _listed(peaks))).when(f.isNotNull(), "no peak of the suspect aligns with a harmonic of BPFO, BPFI, BSF or FTF"),
        F.when(F.size("changed_features") > 0, F.concat(F.lit("changed features: "), F.array_join("changed_features", ", "))),
    ), lambda x: x.isNotNull())


def envelope_notes() -> Column:
    """Lines on the leading or tied families and on the three of the most energy; energies in scientific notation, as they span decades. Null without envelopes."""
    changes, d = F.col("characteristic_changes"), F.col("dominant")
    energy = lambda v: formatted("%.2e", v)
    base = lambda c: F.when(c["detected_in_baseline"], F.concat(F.lit("baseline "), energy(c["normal"]), F.lit(", "), _times(c["ratio"]))).otherwise("not in the baseline")
    of = lambda label: F.get(F.filter(changes, lambda c: c["label"] == label), F.lit(0))
    named = lambda c: F.concat(c["label"], formatted(" (%.1f Hz) ", c["frequency_hz"]), energy(c["abnormal"]), F.lit(" ("), base(c), F.lit(")"))
    lines = F.filter(F.array(
        F.when(d["ambiguous"], F.concat(F.lit("the energies of these families are close, none leads: "), _listed(F.transform(d["tied"], lambda t: named(of(t)))))).when(d.isNotNull(), F.concat(F.lit("the band of its harmonics has the most energy: "), named(of(d["label"])))),
        F.concat(F.lit("energies: "), _listed(F.transform(leading_families(), lambda c: F.concat(c["label"], F.lit(" "), energy(c["abnormal"]))))),
        F.when(d.isNull(), "no component of the envelope spectrum stands out at BPFO, BPFI, BSF or FTF"),
    ), lambda x: x.isNotNull())
    return F.when(changes.isNotNull(), lines)


def suggestions() -> Column:
    """Review notes, advice for the conclusion and standing suggestions, each once in this order."""
    advice = F.lit("compare with the machine's history")
    for k, v in ADVICE.items():
        advice = F.when(F.col("conclusion") == k, v).otherwise(advice)
    weak = F.when(F.col("confidence") != "high", "measure again under the same load and speed")
    return F.filter(F.array_distinct(F.concat("reviews", F.array(advice, weak, F.lit("confirm by inspection before maintenance")))), lambda x: x.isNotNull())


def reports(requests: DataFrame, validation: DataFrame, comparisons: DataFrame, candidates: DataFrame, checks: DataFrame, verdicts: DataFrame, sources: DataFrame) -> DataFrame:
    """(request_id, status, report, markdown); both null for requests that ended in an error.

    ``sources`` has fault_type, name, url, locator. The conclusion's sources are those of its type,
    else of the first candidate. Nulls are shown as dashes.
    """
    own = checks.groupBy("request_id", "fault_type").agg(F.array_sort(F.collect_list(F.struct("pos", "clause_id", "expectation", "actual", "state"))).alias("clauses"))
    listed = candidates.join(own, ["request_id", "fault_type"], "left").groupBy("request_id").agg(
        F.array_sort(F.collect_list(F.struct("align_rank", "fault_type", "title", "score", "factor", "alignment_score", "state", "evidence", "clauses"))).alias("candidates")
    )
    refs = sources.groupBy("fault_type").agg(F.array_sort(F.collect_set(F.struct("name", "url", "locator"))).alias("refs"))
    rows = requests.join(verdicts, "request_id").join(validation.drop("valid"), "request_id", "left").join(comparisons, "request_id", "left").join(listed, "request_id", "left")
    hidden = F.col("branch") == "no_significant_change"
    none = F.array().cast(listed.schema["candidates"].dataType)
    rows = rows.withColumn("candidates", F.when(hidden, none).otherwise(F.coalesce("candidates", none)))
    first = F.get("candidates", F.lit(0))["fault_type"]
    rows = rows.withColumn("_source", F.when(F.col("conclusion").isin("unconfirmed"), first).otherwise(F.col("conclusion"))).join(refs.withColumnRenamed("fault_type", "_source"), "_source", "left")
    rows = rows.withColumn("suggestions", suggestions())
    refs_of = F.when(hidden, F.array().cast(refs.schema["refs"].dataType)).otherwise(F.coalesce("refs", F.array().cast(refs.schema["refs"].dataType)))
    report = F.struct(
        "conclusion", "status", "branch", "confidence", "confidence_reason", "evidence", "feature_changes", "band_changes", "frequency_change", "characteristic_changes", "dominant", "matches", "candidates",
        spectrum_notes().alias("spectrum_notes"), envelope_notes().alias("envelope_notes"), refs_of.alias("sources"), "suggestions",
    )
    e = lambda c, t: F.coalesce(c, F.array().cast(t))
    bands = F.transform("band_changes", lambda b: F.array(b["band"], short_number(b["change"]["normal"]), short_number(b["change"]["abnormal"]), short_number(b["change"]["ratio"])))
    families = F.transform(e(F.col("characteristic_changes"), comparisons.schema["characteristic_changes"].dataType), lambda c: F.array(c["label"], formatted("%.2f", c["frequency_hz"]), formatted("%.3e", c["normal"]), formatted("%.3e", c["abnormal"]), short_number(c["ratio"])))
    known = F.transform("candidates", lambda c: F.array(c["fault_type"], formatted("%.4f", c["score"]), formatted("%.4f", c["alignment_score"]), c["state"], F.array_join(F.transform(F.filter(F.coalesce(c["clauses"], F.array().cast(own.schema["clauses"].dataType)), lambda x: x["state"] == "miss"), lambda x: x["clause_id"]), " ")))
    parts = [
        F.concat(F.lit("baseline "), "normal_id", F.lit(", suspect "), "abnormal_id", formatted(", %.0f Hz, %.0f rpm", "sampling_rate", "rotation_speed")),
        F.concat(formatted("%d and %d points; ", F.coalesce("n_normal", F.lit(0)), F.coalesce("n_abnormal", F.lit(0))), F.size(F.coalesce("warnings", F.array().cast(validation.schema["warnings"].dataType))).cast("string"), F.lit(" warnings")),
        table(["feature", "baseline", "suspect", "difference", "ratio", "change"], _feature_rows()), table(["band", "baseline", "suspect", "ratio"], bands), bullets(spectrum_notes()),
        F.concat(table(["family", "Hz", "baseline", "suspect", "ratio"], families), F.lit("\n\n"), bullets(F.coalesce(envelope_notes(), F.array().cast("array<string>")))), bullets(F.col("evidence")), table(["type", "score", "alignment", "clauses", "missed"], known),
        F.concat("conclusion", F.lit(", confidence "), "confidence", F.lit(": "), "confidence_reason"), bullets(F.transform(refs_of, lambda s: F.concat_ws(" ", s["name"], s["url"], s["locator"]))), bullets(F.col("suggestions")),
    ]
    text = F.concat_ws("\n\n", *[F.concat(F.lit(f"## {k + 1}. {name}\n\n"), F.coalesce(p, F.lit("-"))) for k, (name, p) in enumerate(zip(SECTIONS, parts))])
    shown = F.col("status") != "error"
    return rows.select("request_id", "status", F.when(shown, report).alias("report"), F.when(shown, text).alias("markdown"))

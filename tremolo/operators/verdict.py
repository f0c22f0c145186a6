"""The decision: guards in a fixed order, review notes, and confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremolo import config
from tremolo.functions.scalars import formatted, positive


def no_change() -> Column:
    """No changed feature, no ratio off by the threshold, and the dominant frequency stays."""
    off = F.lit(False)
    for f in config.FEATURES:
        off = off | F.coalesce(F.abs(F.col(f"feature_changes.{f}.ratio") - 1) >= config.CHANGE_THRESHOLD, F.lit(False))
    return (F.coalesce(F.size("changed_features"), F.lit(0)) <= 0) & ~off & (F.abs(F.coalesce(F.col("frequency_change.shift_hz"), F.lit(0.0))) < 1e-9)


def evidence_conflict() -> Column:
    """A note where the time domain changed and the frequency domain did not, or the reverse."""
    big = lambda f: F.coalesce(F.abs(F.col(f"feature_changes.{f}.ratio") - 1) >= config.CHANGE_THRESHOLD, F.lit(False))
    time = (F.coalesce(F.size("changed_features"), F.lit(0)) > 0) | big("rms") | big("kurtosis")
    freq = F.coalesce(F.abs("frequency_change.shift_hz") >= 2, F.lit(False)) | F.coalesce(F.col("dominant.ratio") >= 2, F.lit(False))
    return F.when(time & ~freq, "time-domain change without a change in frequency; review").when(freq & ~time, "frequency change without a time-domain change; review")


def leaders(candidates: DataFrame, by: str) -> DataFrame:
    """(by, top, second, n): each request's first two candidates in the order of alignment."""
    packed = F.struct("align_rank", "fault_type", "frequency_family", "score", "alignment_score", "state", "misses")
    best = candidates.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min(packed).alias("top"))
    second = candidates.where("align_rank = 2").select(by, packed.alias("second"))
    return best.join(second, by, "left")


def confidence(top: Column, second: Column, n: Column, tied: Column) -> Column:
    """low, medium or high from retrieval scores; a tie, under two candidates or a first in conflict with its clauses is low."""
    s = top["score"]
    level = F.when(tied | (n < 2) | (s < 0.5), "low").when((s >= 0.6) & (s - second["score"] >= 0.08), "high").otherwise("medium")
    return F.when(n.isNull() | (n == 0), "low").when(top["state"] == "conflict", "low").otherwise(level)


def well_formed() -> Column:
    """Whether a request names both samples and has a finite rate and speed above 0."""
    named = F.coalesce((F.trim("normal_id") != "") & (F.trim("abnormal_id") != ""), F.lit(False))
    return named & positive(F.col("sampling_rate")).isNotNull() & positive(F.col("rotation_speed")).isNotNull()


def verdicts(requests: DataFrame, validation: DataFrame, comparisons: DataFrame, features: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row for each request: status, branch, conclusion, confidence, confidence_reason, reviews, error.

    The first that holds decides: an invalid request; data that is invalid or not comparable; no
    significant change; a short signal; a tie of families that the first candidate isn't part of; no
    candidate over the threshold. Review notes never change the status.
    """
    seconds = features.select(F.col("sample_id").alias("abnormal_id"), "sampling_rate", "rotation_speed", (F.col("n_samples") / F.col("sampling_rate")).alias("seconds"), F.col("error").alias("feature_error"))
    rows = requests.join(validation.select("request_id", "valid", "comparable", "errors"), "request_id", "left").join(seconds, ["abnormal_id", "sampling_rate", "rotation_speed"], "left")
    rows = rows.join(comparisons, "request_id", "left").join(leaders(candidates, "request_id"), "request_id", "left")
    bad = ~well_formed()
    tied = F.coalesce(F.col("dominant.ambiguous"), F.lit(False))
    own = F.coalesce(F.array_contains("dominant.tied", F.col("top.frequency_family")), F.lit(False))
    failed = ~F.coalesce(F.col("valid") & F.col("comparable"), F.lit(False))
    branch = (
        F.when(bad, "invalid_argument").when(failed, "invalid_data").when(F.col("feature_error").isNotNull(), "tool_error").when(no_change(), "no_significant_change")
        .when(F.coalesce(F.col("seconds") < config.MIN_SECONDS, F.lit(False)), "short_signal").when(tied & ~own, "tied_families").when(F.col("top").isNull(), "no_candidate").otherwise("ok")
    )
    rows = rows.withColumn("branch", branch)
    status = F.when(F.col("branch").isin("invalid_argument", "invalid_data", "tool_error"), "error").when(F.col("branch") == "ok", "ok").otherwise("insufficient_evidence")
    gap = F.col("top.score") - F.col("second.score")
    notes = F.filter(F.array(
        F.when(gap < config.CANDIDATE_GAP, "the first two candidates score alike; review"), evidence_conflict(),
        F.when((F.col("top.state") == "conflict") & (F.col("top.misses") > 0), "the first candidate's clauses contradict the data; review"),
    ), lambda x: x.isNotNull())
    ok = F.col("branch") == "ok"
    shown = F.col("branch") != "no_significant_change"
    level = confidence(F.col("top"), F.col("second"), F.coalesce("n", F.lit(0)), tied)
    reason = F.when(F.coalesce("n", F.lit(0)) == 0, "no candidate").otherwise(formatted("first score %.4f of %d candidates, clauses %s", "top.score", "n", "top.state"))
    error = F.when(status == "error", F.coalesce(F.when(bad, F.lit("invalid_argument")), F.get("errors", F.lit(0))["code"], F.col("feature_error.code"), F.lit("internal_error")))
    return rows.select(
        "request_id", status.alias("status"), "branch", F.when(ok, F.col("top.fault_type")).when(status != "error", "unconfirmed").alias("conclusion"), F.when(status != "error", F.when(shown, level).otherwise("low")).alias("confidence"),
        F.when(status != "error", reason).alias("confidence_reason"), F.when(ok, notes).otherwise(F.array().cast("array<string>")).alias("reviews"), error.alias("error"), (F.coalesce(tied, F.lit(False)) & own).alias("tie_resolved"),
    )


def gaps(candidates: DataFrame, by: str) -> DataFrame:
    """(by, gap): the first score less the second, in the order of alignment; it can be negative."""
    order = Window.partitionBy(by).orderBy("align_rank")
    return candidates.withColumn("gap", F.col("score") - F.lead("score").over(order)).where("align_rank = 1").select(by, "gap")

"""Validation of signal pairs: independent checks as columns; errors and warnings as arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremolo.config import MIN_SAMPLES, RATE_TOLERANCE
from tremolo.functions.scalars import positive


def _issue(code: str, field: str, message: Column) -> Column:
    return F.struct(F.lit(code).alias("code"), message.alias("message"), F.lit(field).alias("field"))


def length_checks(pairs: DataFrame, least: int = MIN_SAMPLES) -> DataFrame:
    """Adds length_ok, comparable (two empty signals are) and length_issue (null, warning or error)."""
    n, a = F.col("n_normal"), F.col("n_abnormal")
    long_enough = (n >= least) & (a >= least)
    issue = F.when((n > 0) & (a > 0) & (n != a), F.when(long_enough, "warning").otherwise("error"))
    return pairs.withColumns({"length_ok": long_enough, "comparable": (n == a) | long_enough, "length_issue": issue})


def validate(requests: DataFrame, scans: DataFrame, least: int = MIN_SAMPLES) -> DataFrame:
    """One row for each request: valid, comparable, errors, warnings, checks, n_normal, n_abnormal.

    ``requests`` has request_id, normal_id, abnormal_id, sampling_rate; ``scans`` has a row for
    each sample: sample_id, n_samples, rate (inferred, or null), file_error (or null) and
    errors, warnings (arrays of code, message, field). Errors keep this order: both files' own, rate,
    rates against the files, lengths, comparability. It never raises.
    """
    side = lambda k: scans.select(*[F.col(c).alias(f"{k}_{c}") for c in ("sample_id", "n_samples", "rate", "file_error", "errors", "warnings")])
    rows = requests.join(side("n"), F.col("normal_id") == F.col("n_sample_id"), "left").join(side("a"), F.col("abnormal_id") == F.col("a_sample_id"), "left")
    fs = positive(F.col("sampling_rate"))
    rows = rows.withColumns({"fs": fs, "n_normal": F.coalesce("n_n_samples", F.lit(0)), "n_abnormal": F.coalesce("a_n_samples", F.lit(0))})
    rows = length_checks(rows, least)
    none = F.array().cast("array<struct<code:string,message:string,field:string>>")

    def named(errors: Column, slot: str) -> Column:
        return F.transform(F.coalesce(errors, none), lambda e: F.struct(e["code"].alias("code"), F.concat(F.lit(f"{slot}: "), e["message"]).alias("message"), e["field"].alias("field")))

    def one(condition: Column, issue: Column) -> Column:
        return F.when(F.coalesce(condition, F.lit(False)), F.array(issue)).otherwise(none)

    def missing(k: str, slot: str) -> Column:
        known = F.coalesce(F.col(f"{k}_file_error.code"), F.lit("file_not_found"))
        text = F.concat(F.lit(f"{slot}: "), F.coalesce(F.col(f"{k}_file_error.message"), F.lit("no such sample")))
        failed = F.col(f"{k}_sample_id").isNull() | F.col(f"{k}_file_error").isNotNull()
        return F.when(failed, F.array(F.struct(known.alias("code"), text.alias("message"), F.lit("path").alias("field")))).otherwise(named(F.col(f"{k}_errors"), slot))

    def off(k: str) -> Column:
        return F.abs(F.col(f"{k}_rate") - F.col("fs")) / F.col("fs") > RATE_TOLERANCE

    usable = (F.col("n_normal") > 0) & (F.col("n_abnormal") > 0)
    parts = [missing("n", "normal"), missing("a", "abnormal"), one(F.col("fs").isNull(), _issue("invalid_value", "sampling_rate", F.lit("the sampling rate must be finite and positive")))]
    for k, slot in (("n", "normal"), ("a", "abnormal")):
        parts.append(one(off(k), _issue("sampling_rate_mismatch", "sampling_rate", F.format_string(f"{slot}: timestamps suggest about %.1f Hz", F.col(f"{k}_rate")))))
    for slot in ("normal", "abnormal"):
        parts.append(one(usable & (F.col(f"n_{slot}") < least), _issue("insufficient_data", "n_samples", F.format_string(f"{slot}: only %d points, at least {least} are needed", F.col(f"n_{slot}")))))
    lengths = F.format_string("lengths differ (%d and %d)", "n_normal", "n_abnormal")
    parts.append(one(F.col("length_issue") == "error", _issue("incomparable_length", "n_samples", lengths)))
    rows = rows.withColumn("errors", F.concat(*parts))
    warnings = F.concat(named(F.col("n_warnings"), "normal"), named(F.col("a_warnings"), "abnormal"), one(F.col("length_issue") == "warning", _issue("incomparable_length", "n_samples", lengths)))
    has = lambda *codes: F.exists("errors", lambda e: e["code"].isin(*codes))
    read = F.col("n_sample_id").isNotNull() & F.col("a_sample_id").isNotNull() & F.col("n_file_error").isNull() & F.col("a_file_error").isNull()
    checks = F.struct(
        (read & ~has("file_format")).alias("format"), (read & ~has("missing_column")).alias("columns"),
        (read & usable & ~F.exists("errors", lambda e: e["code"].isin("missing_value", "invalid_value") & (e["field"] != "sampling_rate")) & F.col("fs").isNotNull()).alias("values"),
        F.col("length_ok").alias("length"), (F.col("fs").isNotNull() & ~F.coalesce(off("n"), F.lit(False)) & ~F.coalesce(off("a"), F.lit(False))).alias("sampling_rate"), F.col("comparable").alias("comparability"),
    )
    valid = ~F.exists("errors", lambda e: e["code"] != "incomparable_length")
    return rows.select("request_id", valid.alias("valid"), "comparable", "errors", warnings.alias("warnings"), checks.alias("checks"), "n_normal", "n_abnormal")

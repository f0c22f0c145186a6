"""The rule engine: clauses over 15 metrics and 6 operators with three-valued logic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremolo.config import FACTOR_BASE, FACTOR_SPAN, SHAFT_TOLERANCE

#: fault type, metric, operator, value, family, order (fixed values).
_RULES = [
    ("ball_fault", "rms_ratio", ">=", "1.3", None, None),
    ("ball_fault", "kurtosis_ratio", "<", "1.3", None, None),
    ("ball_fault", "crest_factor_ratio", "<", "1.2", None, None),
    ("ball_fault", "dominant_ambiguous", "==", "true", None, None),
    ("ball_fault", "tied_family", "==", "true", "BSF", None),
    ("cage_fault", "peak_match_orders", ">=", "1", "FTF", None),
    ("cage_fault", "envelope_rank", "<=", "2", "FTF", None),
    ("cage_fault", "kurtosis_ratio", "<", "1.3", None, None),
    ("inner_race_fault", "rms_ratio", ">=", "1.3", None, None),
    ("inner_race_fault", "kurtosis_ratio", ">=", "1.3", None, None),
    ("inner_race_fault", "crest_factor_ratio", ">=", "1.2", None, None),
    ("inner_race_fault", "peak_match_orders", ">=", "2", "BPFI", None),
    ("inner_race_fault", "envelope_rank", "<=", "1", "BPFI", None),
    ("inner_race_fault", "envelope_margin", ">=", "1.15", None, None),
    ("misalignment", "dominant_near_shaft", "==", "true", None, "2"),
    ("normal", "changed_feature_count", "<=", "0", None, None),
    ("normal", "dominant_shift_hz", "<", "1.0", None, None),
    ("outer_race_fault", "rms_ratio", ">=", "1.3", None, None),
    ("outer_race_fault", "kurtosis_ratio", ">=", "1.3", None, None),
    ("outer_race_fault", "crest_factor_ratio", ">=", "1.2", None, None),
    ("outer_race_fault", "peak_match_orders", ">=", "2", "BPFO", None),
    ("outer_race_fault", "envelope_rank", "<=", "1", "BPFO", None),
    ("outer_race_fault", "envelope_margin", ">=", "1.15", None, None),
    ("unbalance", "dominant_near_shaft", "==", "true", None, "1"),
]
#: The same with a clause id in second place: the type and the clause's number among those of its type.
CLAUSES = [(kind, f"{kind}/{sum(r[0] == kind for r in _RULES[: k + 1])}", *rest) for k, (kind, *rest) in enumerate(_RULES)]
#: Words that stand for true and false (fixed values).
TRUE, FALSE = ("true", "1", "yes", "是", "成立"), ("false", "0", "no", "否", "不成立")
BOOLEAN_METRICS = ("dominant_near_shaft", "dominant_ambiguous", "tied_family")
METRICS = (
    "rms_ratio", "peak_ratio", "kurtosis_ratio", "crest_factor_ratio", "dominant_amplitude_ratio", "changed_feature_count", "dominant_shift_hz", "dominant_near_shaft",
    "envelope_energy", "envelope_ratio", "envelope_rank", "envelope_margin", "dominant_ambiguous", "peak_match_orders", "tied_family",
)


def clause_table(spark) -> DataFrame:
    rows = [(k, *c) for k, c in enumerate(CLAUSES)]
    return spark.createDataFrame(rows, "pos long, fault_type string, clause_id string, metric string, op string, value string, family string, order string")


def typed(value: Column, boolean: Column) -> Column:
    """A clause's value as a double: words for truth as 1 and 0 for boolean metrics, else a number; null if neither."""
    word = F.lower(F.trim(value))
    return F.when(boolean, F.when(word.isin(*TRUE), 1.0).when(word.isin(*FALSE), 0.0)).otherwise(word.try_cast("double"))


def _family(of: Column, part: str, name: Column) -> Column:
    found = F.filter(of, lambda c: c["label"] == F.upper(name))
    return F.when(F.size(found) > 0, F.get(found, F.lit(0))[part])


def actual() -> Column:
    """The value of the clause's metric from the comparison's columns; null where it is unknown."""
    metric, family = F.col("metric"), F.col("family")
    ratio = {f"{f}_ratio": F.col(f"feature_changes.{f}.ratio") for f in ("rms", "peak", "kurtosis", "crest_factor", "dominant_amplitude")}
    shaft = F.col("fault_frequencies.shaft") * F.coalesce(F.col("order").try_cast("double"), F.lit(1.0))
    near = (F.abs(F.col("frequency_change.abnormal_dominant") - shaft) / F.nullif(shaft, F.lit(0.0)) <= SHAFT_TOLERANCE).cast("double")
    changes = F.col("characteristic_changes")
    order = F.transform(F.array_sort(changes), lambda c: c["label"])
    rank = F.nullif(F.array_position(order, F.upper(family)), F.lit(0)).cast("double")
    matched = F.size(F.filter("matches", lambda m: m["label"] == F.upper(family))).cast("double")
    values = ratio | {
        "changed_feature_count": F.when(F.col("changed_features").isNotNull(), F.size("changed_features").cast("double")),
        "dominant_shift_hz": F.abs("frequency_change.shift_hz"),
        "dominant_near_shaft": F.when(shaft > 0, near),
        "envelope_energy": _family(changes, "abnormal", family),
        "envelope_ratio": _family(changes, "ratio", family),
        "envelope_rank": rank,
        "envelope_margin": F.col("dominant.margin_ratio"),
        "dominant_ambiguous": F.col("dominant.ambiguous").cast("double"),
        "peak_match_orders": F.when(F.col("matches").isNotNull() & family.isNotNull(), matched),
        "tied_family": F.when(F.col("dominant.ambiguous") & (F.size("dominant.tied") > 0) & family.isNotNull(), F.array_contains("dominant.tied", F.upper(family)).cast("double")),
    }
    out = F.lit(None).cast("double")
    for name, v in values.items():
        out = F.when(metric == name, v).otherwise(out)
    return out


def state(actual: Column, op: Column, expected: Column) -> Column:
    """hit, miss or unknown; an unknown operator or a null on either side is unknown."""
    holds = F.when(op == ">=", actual >= expected).when(op == "<=", actual <= expected).when(op == ">", actual > expected).when(op == "<", actual < expected).when(op == "==", actual == expected).when(op == "!=", actual != expected)
    return F.when(holds.isNull(), "unknown").when(holds, "hit").otherwise("miss")


def expected_text() -> Column:
    return F.concat(F.col("metric"), F.coalesce(F.concat(F.lit("("), "family", F.lit(")")), F.lit("")), F.lit(" "), F.col("op"), F.lit(" "), F.col("value"))


def checked(facts: DataFrame, clauses: DataFrame) -> DataFrame:
    """``clauses`` joined to ``facts`` (columns of the comparison, request_id): adds actual, expected, state, expectation.

    Clauses are two dozen rows; Spark broadcasts them by their known size.
    """
    rows = facts.join(clauses, "fault_type") if "fault_type" in facts.columns else facts.join(clauses, F.lit(True))
    rows = rows.withColumn("actual", actual()).withColumn("expected", typed(F.col("value"), F.col("metric").isin(*BOOLEAN_METRICS)))
    return rows.withColumn("state", state(F.col("actual"), F.col("op"), F.col("expected"))).withColumn("expectation", expected_text())


def summary(hits: Column, misses: Column, total: Column) -> Column:
    return F.when(total == 0, "none").when(hits + misses == 0, "unverified").when(misses == 0, "consistent").when(misses < hits, "partial").otherwise("conflict")


def factor(hits: Column, misses: Column) -> Column:
    n = hits + misses
    return F.when(n == 0, 1.0).otherwise(F.round(FACTOR_BASE + FACTOR_SPAN * hits / F.nullif(n, F.lit(0)), 4))


def tallied(checks: DataFrame, *by: str) -> DataFrame:
    """hits, misses, unknowns, checked, total, state and factor of each group's clauses."""
    n = lambda s: F.count_if(F.col("state") == s)
    rows = checks.groupBy(*by).agg(n("hit").alias("hits"), n("miss").alias("misses"), n("unknown").alias("unknowns"), F.count(F.lit(1)).alias("total"))
    h, m = F.col("hits"), F.col("misses")
    return rows.select(*by, "hits", "misses", "unknowns", (h + m).alias("checked"), "total", summary(h, m, F.col("total")).alias("state"), factor(h, m).alias("factor"))


def reranked(candidates: DataFrame, tallies: DataFrame, *by: str) -> DataFrame:
    """Candidates with their tallies, alignment_score (score times factor, 4 digits) and align_rank; ties keep the order of retrieval."""
    rows = candidates.join(tallies, [*by, "fault_type"], "left")
    rows = rows.withColumns({"factor": F.coalesce("factor", F.lit(1.0)), "state": F.coalesce("state", F.lit("none"))}).withColumn("alignment_score", F.round(F.col("score") * F.col("factor"), 4))
    order = Window.partitionBy(*by).orderBy(F.desc("alignment_score"), "rank")
    return rows.withColumn("align_rank", F.row_number().over(order).cast("long"))

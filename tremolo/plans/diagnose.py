"""The whole diagnosis as one batch plan over a table of requests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremolo import config
from tremolo.operators import compare, features, report, retrieval, rules, search, validate, verdict
from tremolo.session import Stage


@dataclass
class Diagnosis:
    """The tables of a run; features and comparisons are written, the others are lazy and can be used alone."""

    validation: DataFrame
    features: DataFrame
    comparisons: DataFrame
    queries: DataFrame
    candidates: DataFrame
    checks: DataFrame
    verdicts: DataFrame
    reports: DataFrame


def candidates(queries: DataFrame, entries: DataFrame, comparisons: DataFrame, top_k: int = config.TOP_K, threshold: float = config.SCORE_THRESHOLD, embed=None, index_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(candidates, checks): entries that score at least ``threshold`` for each query, re-ranked by their clauses.

    With ``embed`` (a function from a text column to a vector column) chunks are searched by words and vectors
    (stored ones, with ``index_path``), else entries by words; so too where that fails, with the reason in the rows.
    """
    docs = entries.select("entry_index", "fault_type", "title", "frequency_family", "typical_features", "frequency_signature")
    found = search.search(queries, entries, embed, index_path, top_k)
    rows = found.rows.where(F.col("score") >= threshold).join(docs, "entry_index").join(queries, "request_id")
    clause = entries.select("fault_type", F.posexplode("criteria").alias("pos", "c")).select("fault_type", F.col("pos").cast("long").alias("pos"), F.col("c.id").alias("clause_id"), F.col("c.claim").alias("claim"), "c.metric", "c.op", "c.value", "c.family", "c.order")
    facts = rows.select("request_id", "fault_type").join(comparisons, "request_id")
    checks = rules.checked(facts, clause)
    tallies = rules.tallied(checks, "request_id", "fault_type")
    made = rules.reranked(rows, tallies, "request_id").withColumn("misses", F.coalesce("misses", F.lit(0)))
    hits = search.clause_hits(queries, entries).where("claim <> ''").groupBy("request_id", "entry_index").agg(F.array_sort(F.collect_list(F.struct("k", "id", "claim", F.round("score", 4).alias("score")))).alias("clause_hits"))
    none = F.array().cast(hits.schema["clause_hits"].dataType)
    made = made.join(hits, ["request_id", "entry_index"], "left").withColumn("clause_hits", F.coalesce("clause_hits", none))
    picked = retrieval.picked_evidence(F.col("query"), F.col("clause_hits"), F.col("typical_features"), F.col("frequency_signature"))
    return made.withColumn("evidence", picked).drop("query"), checks


def projected(candidates: DataFrame, checks: DataFrame, sources: DataFrame) -> DataFrame:
    """What is shown of each candidate: type, title, both scores, its clauses, first source, evidence and family, in the order of alignment.

    ``sources`` has fault_type, name, url and locator in the entries' order, as ``first_sources`` gives them.
    """
    clauses = checks.groupBy("request_id", "fault_type").agg(F.array_sort(F.collect_list(F.struct("pos", "clause_id", "expectation", "actual", "state"))).alias("criteria_check"))
    rows = candidates.join(clauses, ["request_id", "fault_type"], "left").join(sources, "fault_type", "left")
    return rows.select("request_id", "align_rank", "fault_type", "title", "score", "alignment_score", "criteria_check", F.col("name").alias("source"), F.col("url").alias("source_url"), "locator", "evidence", "frequency_family")


def first_sources(entries: DataFrame) -> DataFrame:
    """(fault_type, name, url, locator): each entry's first source."""
    return entries.select("fault_type", F.get("sources", F.lit(0)).alias("s")).select("fault_type", "s.*")


def diagnose(requests: DataFrame, signals: DataFrame, scans: DataFrame, entries: DataFrame, embed=None, threshold: float = config.SCORE_THRESHOLD, index_path: str | None = None) -> Diagnosis:
    """Diagnoses each row of ``requests`` (request_id, normal_id, abnormal_id, sampling_rate, rotation_speed).

    Features are extracted once for each sample, rate and speed however many requests name it, and only of
    requests that passed validation; rejected requests stay as rows with a status of error.
    """
    validation = validate.validate(requests, scans)
    good = requests.join(validation.where("valid AND comparable").select("request_id"), "request_id", "left_semi").where(verdict.well_formed())
    sides = good.select("sampling_rate", "rotation_speed", F.explode(F.array("normal_id", "abnormal_id")).alias("sample_id"))
    stage = Stage(signals.sparkSession, "diagnosis")
    made = stage.write(features.extract_features(signals, sides.distinct()))
    comparisons = compare.compare(good.select("request_id", "normal_id", "abnormal_id", "sampling_rate", "rotation_speed"), made)
    comparisons = stage.write(comparisons)
    queries = comparisons.select("request_id", retrieval.build_query().alias("query"))
    found, checks = candidates(queries, entries, comparisons, threshold=threshold, embed=embed, index_path=index_path)
    found, checks = stage.write(found), stage.write(checks)  # verdicts and reports read them several times
    decided = verdict.verdicts(requests, validation, comparisons, made, found)
    sources = entries.select("fault_type", F.explode("sources").alias("s")).select("fault_type", "s.*")
    made_reports = report.reports(requests, validation, comparisons, found, checks, decided, sources)
    return Diagnosis(validation, made, comparisons, queries, found, checks, decided, made_reports)

"""The optional language model: prompts as a column, a pluggable call, and checks of what comes back."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremolo.functions.scalars import formatted, json_object, urls


def prompt() -> Column:
    """What the model is told of a request: evidence, candidates with their clauses, and the types that it may name.

    Columns: evidence (array of lines), candidates (array with fault_type, score, state).
    """
    known = F.transform("candidates", lambda c: F.concat(c["fault_type"], formatted(" (score %.4f, clauses ", c["score"]), c["state"], F.lit(")")))
    allowed = F.array_join(F.array_union(F.transform("candidates", lambda c: c["fault_type"]), F.array(F.lit("unconfirmed"))), ", ")
    return F.concat(
        F.lit("Evidence:\n- "), F.array_join("evidence", "\n- "), F.lit("\nCandidates:\n- "), F.array_join(known, "\n- "),
        F.lit("\nAnswer with a JSON object with the keys fault_type, summary and sources. fault_type must be one of: "), allowed, F.lit("."),
    )


def accepted(answer: Column, allowed: Column, sources: Column) -> Column:
    """The answer's JSON object as a struct, or null: its fault_type must be allowed and its URLs agree with a known source.

    A URL agrees if it begins with a source or a source begins with it.
    """
    body = F.from_json(json_object(answer), "fault_type string, summary string, sources array<string>")
    named = F.array_union(F.coalesce(body["sources"], F.array().cast("array<string>")), urls(F.coalesce(body["summary"], F.lit(""))))
    fits = F.forall(F.filter(named, lambda u: u.startswith("http")), lambda u: F.exists(sources, lambda s: u.startswith(s) | s.startswith(u)))
    return F.when(F.array_contains(allowed, body["fault_type"]) & fits, body)


def reworded(reports: DataFrame, call: Callable[[Column], Column] | None) -> DataFrame:
    """``reports`` (conclusion, evidence, candidates, sources: array of URLs) with mode, conclusion and summary.

    ``call`` turns a prompt column into an answer column (such as a pandas UDF). Without it, or where its answer is not
    accepted, the conclusion stays and the mode says so; a model never gets past the rules.
    """
    if call is None:
        return reports.withColumns({"mode": F.lit("template"), "summary": F.array_join("evidence", "; ")})
    allowed = F.array_union(F.transform("candidates", lambda c: c["fault_type"]), F.array(F.lit("unconfirmed")))
    rows = reports.withColumn("_answer", accepted(call(prompt()), allowed, F.col("sources")))
    ok = F.col("_answer").isNotNull()
    return rows.withColumns({
        "mode": F.when(ok, "model").otherwise("template_fallback"), "summary": F.coalesce("_answer.summary", F.array_join("evidence", "; ")), "conclusion": F.coalesce("_answer.fault_type", "conclusion"),
    }).drop("_answer")


#: Failures that may pass if tried again (fixed values).
RETRYABLE = ("mcp_connection_error", "mcp_timeout", "mcp_protocol_error", "internal_error")


class ToolError(Exception):
    def __init__(self, code: str, message: str = ""):
        super().__init__(message or code)
        self.code = code


def bounded(call: Callable, most: int, retries: int = 1, warn: Callable[[str], None] = lambda text: None) -> Callable:
    """``call`` that works ``most`` times at most and is tried again ``retries`` times where it fails with a retryable code.

    Tries again don't count. Beyond the limit it raises max_tool_calls_exceeded without a call; other codes
    are raised at once. For calls outside Spark; tasks are tried again by Spark itself (spark.task.maxFailures).
    """
    used = 0

    def run(*args, **kwargs):
        nonlocal used
        if used >= most:
            raise ToolError("max_tool_calls_exceeded", f"no more than {most} calls are allowed")
        used += 1
        for k in range(retries + 1):
            try:
                return call(*args, **kwargs)
            except ToolError as e:
                if e.code not in RETRYABLE or k == retries:
                    raise
                warn(f"{e.code}, try {k + 2}: {e}")

    return run


def load_settings(path: str, environment: dict[str, str] | None = None) -> dict[str, str]:
    """``KEY=VALUE`` lines of a file; comments are passed over, and what the environment has stands."""
    found: dict[str, str] = {}
    if os.path.isfile(path):
        with open(path, encoding="utf-8") as f:
            for line in map(str.strip, f):
                if line and not line.startswith("#") and "=" in line:
                    key, _, value = line.partition("=")
                    found[key.strip()] = value.strip().strip("\"'")
    return found | dict(os.environ if environment is None else environment)

"""Queries over single parts of the diagnosis: files, numbers, entries, requests, events and messages made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremolo import config
from tremolo.functions import scalars
from tremolo.operators import retrieval, sessions, verdict
from tremolo.plans import signal_queries
from tremolo.plans.signal_queries import load
from tremolo.sources import knowledge
from tremolo.sources import signals as files

#: What stands in a file instead of some values, by event_id modulo 50.
_ODD = {0: "", 1: "null", 2: "NaN", 3: "--", 4: "1e400", 5: " 7.25 ", 6: "1,2"}


def csv_scan(spark, sf_dir):
    """Each type's events of a day as a CSV file with some broken values: what a scan tells of it, line by line."""
    e = load(spark, sf_dir, "events").where("event_type IS NOT NULL AND value IS NOT NULL")
    text = F.format_string("%.4f", "value")
    for k, odd in _ODD.items():
        text = F.when(F.col("event_id") % 50 == k, odd).otherwise(text)
    line = F.concat(F.format_string("%.6f,", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6), text)
    rows = e.select(F.concat("event_type", F.lit("-"), F.date_format("ts", "yyyyMMdd")).alias("sample_id"), F.struct("ts", "event_id", line.alias("t")).alias("r"))
    body = rows.groupBy("sample_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["t"]), "\n").alias("b"))
    content = F.concat(F.lit("Timestamp, Amplitude\n"), "b").cast("binary")
    signals, scans = files.scan(body.select("sample_id", content.alias("content"), F.octet_length(content).cast("long").alias("size")))
    totals = signals.groupBy("sample_id").agg(F.round(F.sum("amplitude"), 3).alias("total"), F.max("idx").alias("last"))
    n = lambda code: F.size(F.filter("errors", lambda x: x["code"] == code)).cast("long")
    found = scans.select("sample_id", "mode", "n_samples", F.round("rate", 6).alias("rate"), n("missing_value").alias("missing"), n("invalid_value").alias("invalid"), F.get("errors", F.lit(0))["message"].alias("first_error"))
    return found.join(totals, "sample_id", "left")


def csv_lines(spark, sf_dir):
    """The lines of each type's signal as a file."""
    return files.csv_lines(signal_queries._signals(spark, sf_dir)).select("sample_id", "idx", "value")


def number_parsing(spark, sf_dir):
    """Numbers in texts: prices with what may and may not stand around digits."""
    forms = ["%s", " %s ", "+%s", "%sd", "%s.5.", "1_%s", "%se2", ".%s", "NaN%s"]
    price = F.format_string("%d", F.floor("p_retailprice"))
    rows = load(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.array(*[F.concat(F.lit(f.partition("%s")[0]), price, F.lit(f.partition("%s")[2])) for f in forms])).alias("form", "text"))
    return rows.select("p_partkey", "form", "text", scalars.parsed(F.col("text")).alias("number"))


def short_numbers(spark, sf_dir):
    """Four significant digits, and what is said of ratios."""
    rows = load(spark, sf_dir, "orders").select("o_orderkey", ((F.floor(F.col("o_totalprice")) + 0.01) * F.pow(F.lit(10.0), (F.col("o_orderkey") % 9 - 6))).alias("v"), F.when(F.col("o_orderkey") % 11 != 0, F.floor(F.col("o_totalprice") / 100) / 1000).alias("ratio"))
    return rows.select("o_orderkey", scalars.short_number(F.round("v", 9)).alias("short"), scalars.trend(F.col("ratio")).alias("trend"), scalars.percent(F.col("ratio")).alias("percent"))


def file_names(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", scalars.file_name(F.col("url")).alias("name"))


def front_matter(spark, sf_dir):
    """Parts written as knowledge entries and read back."""
    p = F.format_string(
        "---\nfault_type: %s\ntitle: %s: no. %d\ntypical_features:\n  - %s\n  - size %d\ncriteria:\n  - id: c%d | metric: rms_ratio | op: \">=\" | value: %d | claim:  | family: bpfo\n  - plain\nempty:\n---\n\n%s\n",
        "p_type", "p_name", "p_partkey", "p_brand", "p_size", "p_partkey", "p_size", "p_name",
    )
    text = F.when(F.col("p_partkey") % 10 == 0, "no front matter").when(F.col("p_partkey") % 10 == 1, F.concat(F.lit("﻿"), F.replace(p, F.lit("\n"), F.lit("\r\n")))).otherwise(p)
    rows = knowledge.front_matter(load(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("name"), text.alias("text")))
    clause = knowledge.list_item(F.get(F.col("lists")["criteria"], F.lit(0)))
    return rows.select(
        F.col("name").cast("long").alias("p_partkey"), F.col("meta")["fault_type"].alias("fault_type"), F.col("meta")["title"].alias("title"), F.array_join(F.col("lists")["typical_features"], "|").alias("features"),
        clause["id"].alias("clause_id"), clause["op"].alias("op"), clause["value"].alias("value"), clause["claim"].alias("claim"), knowledge.list_item(F.get(F.col("lists")["criteria"], F.lit(1))).isNull().alias("plain"), "body",
    )


def match_orders(spark, sf_dir):
    """Of each window and family that aligns with peaks: its harmonics and the largest deviation."""
    from tremolo.operators import spectra

    found = spectra.nearest_matches(spectra.local_maxima(signal_queries._dft(spark, sf_dir)), signal_queries._targets(spark), signal_queries.FS / signal_queries.N)
    rows = found.select("sample_id", F.struct(F.col("family").alias("label"), F.col("harmonic").alias("harmonic_order"), "deviation_pct").alias("m"))
    made = rows.groupBy("sample_id").agg(F.array_sort(F.collect_list("m")).alias("ms")).select("sample_id", F.explode(retrieval.match_orders(F.col("ms"))).alias("o"))
    return made.select("sample_id", F.col("o.label").alias("family"), F.array_join(F.col("o.orders").cast("array<string>"), " ").alias("orders"), F.round("o.deviation_pct", 3).alias("deviation_pct"))


def timed_events(spark, sf_dir):
    """Each user's events in order, with the time since the first."""
    e = load(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.concat("event_type", F.lit("-"), F.col("event_id").cast("string")).alias("event"), F.col("ts").cast("timestamp").alias("at"))
    return sessions.timed_events(e).select("session_id", "event", "seq", "elapsed_ms")


def windowed_stats(spark, sf_dir):
    """The statistics that streams give by type and day, over the whole table."""
    from tremolo.streaming.signals import windowed_stats as stats

    rows = stats(load(spark, sf_dir, "events"))
    return rows.select("sample_id", F.unix_micros("start").alias("start_us"), "n_samples", *[F.round(c, 8).alias(c) for c in ("mean", "rms", "peak", "kurtosis", "crest_factor")])


def message_append(spark, sf_dir):
    """A note for each conversation, appended to all messages: ids go on from the largest."""
    c = load(spark, sf_dir, "conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL")
    m = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("double").alias("created_at"), "role", F.col("text").alias("content"), F.lit(None).cast("string").alias("meta"))
    new = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("conv_id").cast("string").alias("session_id"), (F.col("conv_id") * 1.5).alias("created_at"), F.lit("user").alias("role"), F.concat(F.lit("turns: "), F.col("n").cast("string")).alias("content"), F.lit(None).cast("string").alias("meta"))
    return sessions.appended(m, new).select("id", "session_id", "role", F.md5(F.coalesce("content", F.lit(""))).alias("md5"))


def session_upsert(spark, sf_dir):
    """Customers as sessions, with those of one nation replaced by newer ones."""
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session_id"), F.col("c_nationkey").cast("double").alias("created_at"), F.lit("old").alias("state"))
    new = c.where("created_at = 3").select("session_id", (F.col("created_at") + 100).alias("created_at"), F.lit("new").alias("state"))
    return sessions.upserted(c, new)


def rejected_types(spark, sf_dir):
    """Part types that a text names, though it may only name its own."""
    p = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("session_id"), F.col("p_type").alias("fault_type"))
    known = p.select("fault_type").distinct()
    named = p.join(known.select(F.col("fault_type").alias("other")), F.col("other") >= F.col("fault_type"))
    text = named.groupBy("session_id").agg(F.concat(F.lit("it is "), F.array_join(F.array_sort(F.collect_set("other")), " or ")).alias("answer"))
    return sessions.rejected_types(text, p, known, "answer", "session_id")


# --- requests: a part's size says what is wrong with its request ---


def _requests(spark, sf_dir) -> tuple[DataFrame, ...]:
    x = F.col("p_size")
    part = load(spark, sf_dir, "part")
    key, none = F.col("p_partkey").alias("request_id"), F.lit(None).cast("double")
    rate = F.when(x == 1, float("nan")).when(x == 2, -1.0).otherwise(12000.0).alias("sampling_rate")
    speed = F.when(x == 3, float("inf")).otherwise(1797.0).alias("rotation_speed")
    abnormal = F.concat(F.lit("a"), F.col("p_partkey").cast("string"))
    requests = part.select(key, F.when(x == 4, " ").otherwise("n").alias("normal_id"), abnormal.alias("abnormal_id"), rate, speed)
    issue = F.struct(F.lit("missing_value").alias("code"), F.lit("m").alias("message"), F.lit("f").alias("field"))
    validation = part.select(key, (x != 5).alias("valid"), (x != 6).alias("comparable"), F.when(x.isin(5, 6), F.array(issue)).otherwise(F.array().cast("array<struct<code:string,message:string,field:string>>")).alias("errors"))
    error = F.when(x == 10, F.struct(F.lit("insufficient_data").alias("code"), F.lit("m").alias("message")))
    made = part.select(abnormal.alias("sample_id"), rate, speed, F.when(x.between(7, 9), 2000).otherwise(12000).cast("long").alias("n_samples"), error.alias("error"))
    still = x.between(11, 15)
    ratio = F.struct(none.alias("normal"), none.alias("abnormal"), none.alias("delta"), F.when(still, 1.1).otherwise(2.0).alias("ratio"))
    tied = x.between(16, 25)
    dominant = F.struct(tied.alias("ambiguous"), F.when(tied, F.array(F.lit("BPFO"), F.lit("BPFI"))).otherwise(F.array().cast("array<string>")).alias("tied"), F.when(x % 4 == 0, 3.0).otherwise(1.0).alias("ratio"))
    comparisons = part.select(
        key, F.struct(*[ratio.alias(f) for f in ("rms", "peak", "kurtosis", "crest_factor", "dominant_frequency", "dominant_amplitude")]).alias("feature_changes"),
        F.when(still, F.array().cast("array<string>")).otherwise(F.array(F.lit("rms"))).alias("changed_features"), F.struct(F.when(still, 0.0).otherwise(x - 40.0).alias("shift_hz")).alias("frequency_change"), dominant.alias("dominant"),
    )
    top = F.round(0.45 + x / 200, 4)
    state = F.when(x % 7 == 0, "conflict").otherwise("consistent")
    each = lambda k, kind, family, score, s: F.struct(F.lit(k).cast("long").alias("align_rank"), F.lit(kind).alias("fault_type"), family.alias("frequency_family"), score.alias("score"), score.alias("alignment_score"), s.alias("state"), F.when(s == "conflict", 1).otherwise(0).cast("long").alias("misses"))
    two = F.array(each(1, "first", F.when(x % 2 == 0, "BPFI").otherwise("FTF"), top, state), each(2, "second", F.lit("BPFO"), F.round(top - (x % 10) / 100, 4), F.lit("partial")))
    found = part.where(~x.between(26, 28)).select(key, F.explode(two).alias("c")).select("request_id", "c.*")
    return requests, validation, comparisons, made, found


def verdict_branches(spark, sf_dir):
    """The decision for each request: its guards in order, confidence and reviews."""
    return verdict.verdicts(*_requests(spark, sf_dir)).select("request_id", "status", "branch", "conclusion", "confidence", F.size("reviews").cast("long").alias("reviews"), "error", "tie_resolved")


QUERIES = {
    f.__name__: f
    for f in (csv_scan, csv_lines, number_parsing, short_numbers, file_names, front_matter, match_orders, timed_events, windowed_stats, message_append, session_upsert, rejected_types, verdict_branches)
}

_TEXT = "CASE event_id % 50 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _ODD.items()) + " ELSE printf('%.4f', value) END"
_NUMBER = r"'^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$'"
_FORMS = "[p, ' ' || p || ' ', '+' || p, p || 'd', p || '.5.', '1_' || p, p || 'e2', '.' || p, 'NaN' || p]"
_MATCHES = f"""near AS (SELECT * FROM (SELECT p.sample_id, t.family, t.harmonic, abs(p.freq - t.target) / t.target * 100 AS dev, t.target, p.freq, row_number() OVER (PARTITION BY p.sample_id, t.family, t.harmonic ORDER BY abs(p.freq - t.target), p.freq) AS k FROM maxima p, targets t)
  WHERE k = 1 AND abs(freq - target) <= greatest({config.PEAK_TOLERANCE} * target, {signal_queries.FS / signal_queries.N}))"""
_KURTOSIS = "CASE WHEN count(value) > 3 THEN coalesce(kurtosis(value) + 3, 0) ELSE coalesce(kurtosis_pop(value) + 3, 0) END"
ORACLE = {
    "csv_scan": f"""WITH e AS (SELECT event_type || '-' || strftime(ts, '%Y%m%d') AS sample_id, ts, event_id, CAST(printf('%.6f', epoch_us(ts) / 1e6) AS DOUBLE) AS sec, {_TEXT} AS t FROM events WHERE event_type IS NOT NULL AND value IS NOT NULL),
      q AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY ts, event_id) + 1 AS line FROM e),
      s AS (SELECT *, CASE WHEN t = '1,2' THEN NULL WHEN regexp_matches(trim(t), {_NUMBER}) AND isfinite(TRY_CAST(trim(t) AS DOUBLE)) THEN TRY_CAST(trim(t) AS DOUBLE) END AS v FROM q),
      g AS (SELECT sample_id, median(d) AS m FROM (SELECT sample_id, sec - lag(sec) OVER (PARTITION BY sample_id ORDER BY line) AS d FROM s WHERE v IS NOT NULL) GROUP BY 1),
      f AS (SELECT sample_id, count(v) AS n_samples, count(*) FILTER (v IS NULL AND t = '') AS missing, count(*) FILTER (v IS NULL AND t <> '') AS invalid, min(line) FILTER (v IS NULL) AS bad, arg_min(t, line) FILTER (v IS NULL) AS bad_text, round(sum(v), 3) AS total FROM s GROUP BY 1)
      SELECT sample_id, 'pair' AS mode, n_samples, round(CASE WHEN m > 0 THEN 1 / m END, 6) AS rate, missing, invalid, 'line ' || bad || CASE bad_text WHEN '1,2' THEN ': row is invalid' WHEN '' THEN ': amplitude is missing' ELSE ': amplitude is invalid' END AS first_error, total, CASE WHEN n_samples > 0 THEN n_samples - 1 END AS last FROM f LEFT JOIN g USING (sample_id)""",
    "csv_lines": f"WITH s AS ({signal_queries._SIGNAL}) SELECT sample_id, idx, printf('%.6f,%.8g', ts, amplitude) AS value FROM s UNION ALL SELECT DISTINCT sample_id, -1, 'timestamp,amplitude' FROM s",
    "number_parsing": f"WITH p AS (SELECT p_partkey, CAST(CAST(floor(p_retailprice) AS BIGINT) AS VARCHAR) AS p FROM part), f AS (SELECT p_partkey, unnest(range(9)) AS form, unnest({_FORMS}) AS text FROM p) SELECT p_partkey, CAST(form AS INTEGER) AS form, text, CASE WHEN regexp_matches(trim(text), {_NUMBER}) THEN CAST(trim(text) AS DOUBLE) END AS number FROM f",
    "short_numbers": "WITH o AS (SELECT o_orderkey, round((floor(o_totalprice) + 0.01) * pow(10.0, o_orderkey % 9 - 6), 9) AS v, CASE WHEN o_orderkey % 11 <> 0 THEN floor(o_totalprice / 100) / 1000 END AS r FROM orders) SELECT o_orderkey, printf('%.4g', v) AS short, CASE WHEN r IS NULL THEN 'changed' WHEN r >= 1 THEN 'rose' ELSE 'fell' END AS trend, coalesce(printf('%.0f%%', abs(r - 1) * 100), 'unknown') AS percent FROM o",
    "file_names": r"SELECT page_id, regexp_extract(url, '[^/\\]*$') AS name FROM pages",
    "front_matter": "SELECT p_partkey, CASE WHEN p_partkey % 10 <> 0 THEN p_type END AS fault_type, CASE WHEN p_partkey % 10 <> 0 THEN p_name || ': no. ' || p_partkey END AS title, CASE WHEN p_partkey % 10 <> 0 THEN p_brand || '|size ' || p_size END AS features, CASE WHEN p_partkey % 10 <> 0 THEN 'c' || p_partkey END AS clause_id, CASE WHEN p_partkey % 10 <> 0 THEN '\">=\"' END AS op, CASE WHEN p_partkey % 10 <> 0 THEN CAST(p_size AS VARCHAR) END AS value, CAST(NULL AS VARCHAR) AS claim, true AS plain, CASE WHEN p_partkey % 10 <> 0 THEN p_name ELSE 'no front matter' END AS body FROM part",
    "match_orders": f"WITH {signal_queries._DFT}, {signal_queries._PEAKS}, {signal_queries._TARGETS}, {_MATCHES} SELECT sample_id, family, string_agg(CAST(harmonic AS VARCHAR), ' ' ORDER BY harmonic) AS orders, round(max(dev), 3) AS deviation_pct FROM near GROUP BY 1, 2",
    "timed_events": "SELECT user_id AS session_id, event_type || '-' || event_id AS event, row_number() OVER (w ORDER BY ts, event_type || '-' || event_id) - 1 AS seq, (epoch_us(ts) - min(epoch_us(ts)) OVER w) // 1000 AS elapsed_ms FROM events WINDOW w AS (PARTITION BY user_id)",
    "windowed_stats": f"WITH s AS (SELECT event_type AS sample_id, epoch_us(date_trunc('day', ts)) AS start_us, count(value) AS n_samples, avg(value) AS mean, stddev_pop(value) AS rms, greatest(max(value) - avg(value), avg(value) - min(value)) AS peak, {_KURTOSIS} AS kurtosis FROM events WHERE event_type IS NOT NULL AND value IS NOT NULL GROUP BY 1, 2) SELECT sample_id, start_us, n_samples, round(mean, 8) AS mean, round(rms, 8) AS rms, round(peak, 8) AS peak, round(kurtosis, 8) AS kurtosis, round(CASE WHEN rms > 0 THEN peak / rms ELSE 0 END, 8) AS crest_factor FROM s",
    "message_append": "WITH c AS (SELECT * FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL), n AS (SELECT conv_id, conv_id * 1.5 AS made, count(*) AS n FROM c GROUP BY 1) SELECT conv_id * 1000 + turn AS id, CAST(conv_id AS VARCHAR) AS session_id, role, md5(coalesce(text, '')) AS md5 FROM c UNION ALL SELECT (SELECT max(conv_id * 1000 + turn) FROM c) + row_number() OVER (ORDER BY made, CAST(conv_id AS VARCHAR)), CAST(conv_id AS VARCHAR), 'user', md5('turns: ' || n) FROM n",
    "session_upsert": "SELECT c_custkey AS session_id, CASE WHEN c_nationkey = 3 THEN 103.0 ELSE CAST(c_nationkey AS DOUBLE) END::DOUBLE AS created_at, CASE WHEN c_nationkey = 3 THEN 'new' ELSE 'old' END AS state FROM customer",
    "rejected_types": "SELECT p_partkey AS session_id, k.t AS fault_type FROM part, (SELECT DISTINCT p_type AS t FROM part) k WHERE k.t > p_type AND k.t <> 'normal'",
    "verdict_branches": """WITH p AS (SELECT p_partkey AS request_id, p_size AS x, round(0.45 + p_size / 200.0, 4) AS s, round(round(0.45 + p_size / 200.0, 4) - (p_size % 10) / 100.0, 4) AS s2 FROM part),
      b AS (SELECT *, CASE WHEN x IN (1, 2, 3, 4) THEN 'invalid_argument' WHEN x IN (5, 6) THEN 'invalid_data' WHEN x = 10 THEN 'tool_error' WHEN x BETWEEN 11 AND 15 THEN 'no_significant_change' WHEN x BETWEEN 7 AND 9 THEN 'short_signal' WHEN x BETWEEN 16 AND 25 AND x % 2 = 1 THEN 'tied_families' WHEN x BETWEEN 26 AND 28 THEN 'no_candidate' ELSE 'ok' END AS branch FROM p),
      v AS (SELECT *, CASE WHEN branch IN ('invalid_argument', 'invalid_data', 'tool_error') THEN 'error' WHEN branch = 'ok' THEN 'ok' ELSE 'insufficient_evidence' END AS status, x BETWEEN 26 AND 28 AS none, abs(x - 40.0) >= 2 OR x % 4 = 0 AS freq FROM b)
      SELECT request_id, status, branch, CASE WHEN status = 'ok' THEN 'first' WHEN status <> 'error' THEN 'unconfirmed' END AS conclusion,
        CASE WHEN status = 'error' THEN NULL WHEN branch = 'no_significant_change' OR none OR x % 7 = 0 OR x BETWEEN 16 AND 25 OR s < 0.5 THEN 'low' WHEN s >= 0.6 AND s - s2 >= 0.08 THEN 'high' ELSE 'medium' END AS confidence,
        CASE WHEN branch = 'ok' THEN CAST(s - s2 < 0.05 AS BIGINT) + CAST(NOT freq AS BIGINT) + CAST(x % 7 = 0 AS BIGINT) ELSE 0 END AS reviews,
        CASE branch WHEN 'invalid_argument' THEN 'invalid_argument' WHEN 'invalid_data' THEN 'missing_value' WHEN 'tool_error' THEN 'insufficient_data' END AS error, x BETWEEN 16 AND 25 AND x % 2 = 0 AS tie_resolved FROM v""",
}
